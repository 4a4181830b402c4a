"""Classify, retrieve and analyse whole tables of tickets: the request surface as functions over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.functions.text import SPACE, classifier_text
from deskmill.operators import gates, ml, search

LIMITATIONS = ("Queue labels are those of the data, not of an organisation's routing.", "Relevance without human labels means an equal queue.", "Drafts are for review and are never sent.", "There is no sign-in; run it where only reviewers can reach it.")


@dataclass
class Service:
    """A fitted classifier with its terms, an index, and the corpus that evidence comes from (id, subject, body, answer, queue, priority)."""

    model: ml.Calibrated
    terms: DataFrame
    index: search.LexicalIndex
    corpus: DataFrame
    top_k: int = gates.DEFAULT_TOP_K

    def accepted(self, tickets: DataFrame) -> DataFrame:
        """doc_id, text of valid (doc_id, subject, body) rows."""
        ok = gates.validate_requests(tickets).filter("rejected is null")
        return ok.select("doc_id", classifier_text(F.col("subject"), F.col("body")).alias("text"))

    def classify(self, tickets: DataFrame, k: int = 3) -> DataFrame:
        """doc_id, predicted, confidence, routes."""
        t = self.accepted(tickets)
        x = ml.features(t, self.terms, "text").withColumn(self.model.label, F.lit(None).cast("string"))
        return ml.routes(self.model.scores(x), k).select(F.col("vec_id").alias("doc_id"), "predicted", "confidence", "routes")

    def retrieve(self, tickets: DataFrame, k: int | None = None) -> DataFrame:
        """doc_id and its evidence; ``k`` of None or 0 means the default."""
        t = self.accepted(tickets)
        queries = t.select(F.col("doc_id").alias("id")).join(self.index.transform(t), "id", "left")
        return gates.evidence(search.lexical_top_k(self.index.rows, queries, k or self.top_k), self.corpus).withColumnRenamed("query_id", "doc_id")

    def analyze(self, tickets: DataFrame, k: int | None = None) -> DataFrame:
        """analysis_id (a hash of the ticket), doc_id, predicted, confidence, priority (never predicted: null), evidence, gate, status, draft,
        citations, reasons of every valid ticket."""
        c, e, t = self.classify(tickets), self.retrieve(tickets, k), self.accepted(tickets)
        none = F.array().cast(e.schema["evidence"].dataType)
        r = t.join(c, "doc_id").join(e, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "predicted", "confidence", "routes", F.coalesce("evidence", none).alias("evidence"))
        made, why = gates.drafts(r).select("id", "gate", "status", "draft", "citations"), gates.reasons(r)
        key = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.regexp_replace("text", SPACE, " ")), 256)
        out = r.join(made, "id").join(why, "id")
        return out.select(key.alias("analysis_id"), F.col("id").alias("doc_id"), "predicted", "confidence", F.lit(None).cast("string").alias("priority"), "routes", "evidence", "gate", "status", "draft", "citations", "reasons")

    def model_info(self) -> dict:
        return {
            "classifier": {"kind": "calibrated_svc", "folds": len(self.model.models), "labels": [r["label"] for r in self.model.encoder.orderBy("index").collect()]}, "priority": {"supported": False},
            "retrieval": {"kind": "tfidf", "corpus_size": self.index.count, "top_k": self.top_k, "min_evidence": gates.MIN_EVIDENCE}, "drafting": {"min_confidence": gates.MIN_CONFIDENCE, "human_review_required": True},
        }

    def health(self) -> dict:
        """Whether every part can be read."""
        errors = []
        for name, df in (("terms", self.terms), ("index", self.index.rows), ("corpus", self.corpus), ("encoder", self.model.encoder)):
            try:
                if df.isEmpty():
                    errors.append(f"{name} is empty")
            except Exception as e:  # noqa: BLE001  a part that cannot be read is what this reports
                errors.append(f"{name}: {type(e).__name__}")
        return {"status": "error" if errors else "ok", "ready": not errors, "errors": errors}
