"""A training corpus from raw documents: five stages, each one operator, each on all that the stage before kept."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm import decontaminate, langid, ngram_join, packing, runindex
from deskmill.llm.queries import table, vocabulary
from deskmill.llm.store import cut, drop

PASSAGE_WORDS = 51
#: Documents fit by 0.39 or more on sf0.1 and 0.33 on check_l; against sf0.1, texts in nine other languages by 0.01 to 0.29, a short Dutch one by 0.32.
LEAST_FIT = 0.3
SHORT_TEXT = 20  # characters; the few n-grams of shorter texts do not say that no language fits


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and, from SHORT_TEXT characters on, is like one of the languages; the training set is what the
    input labels."""
    found = langid.identify(docs, docs.select("lang", "text"))
    keep = found.filter("lang_pred <> 'und'").select(F.col("doc_id").alias("keep_id"), "fit")
    like = (keep["fit"] >= LEAST_FIT) | (F.length(docs["text"]) < SHORT_TEXT)
    return docs.join(keep, (docs["doc_id"] == keep["keep_id"]) & like, "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies (five-word shingles, similarity 0.8 or more). One row of it stays:
    of rows that repeat an id the one with the fullest text, as the join reads them."""
    found = ngram_join.jaccard_components(docs, 5, Fraction(4, 5))
    keep = found.filter("component_id = doc_id").select(F.col("doc_id").alias("keep_id"))
    kept = docs.join(keep, docs["doc_id"] == keep["keep_id"], "left_semi")
    repeated = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again_id")), "repeated-ids")
    if repeated.isEmpty():
        return kept
    again = kept["doc_id"] == repeated["again_id"]
    filled = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \x09-\x0D]+", ""))
    one = kept.join(repeated, again, "left_semi").groupBy(F.col("doc_id").alias("again_id")).agg(F.max_by(F.struct(*docs.columns), F.struct(filled, F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))).alias("r"))
    return kept.join(repeated, again, "left_anti").unionByName(one.select("r.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, or of 400 bytes or more, that occur elsewhere; documents without a word left go. A
    character that a cut divides goes."""
    out = runindex.strip_repeats(docs, words=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(out.schema["n_chars"].dataType))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy, exact or edited, of a benchmark item."""
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["bad_id"], "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: one row per piece, with its ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Alignment, learned profiles and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
