"""Human-review state from an append-only log of actions: only the first valid action of a pending record counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.functions.text import blank_to_null, preview, utc_text
from deskmill.sources.keyed import Keyed

#: Action to state.
STATES = {"accept": "approved", "edit": "edited", "reroute": "edited", "reject": "rejected", "mark_insufficient": "rejected"}


def state_for(action: Column) -> Column:
    out = F.when(F.lit(False), None)
    for k, v in STATES.items():
        out = out.when(action == k, v)
    return out


def valid(action: Column, draft: Column, queue: Column) -> Column:
    """An edit needs a text and a reroute a queue."""
    return F.when(action == "edit", blank_to_null(draft).isNotNull()).when(action == "reroute", blank_to_null(queue).isNotNull()).otherwise(action.isin(*STATES))


def states(actions: DataFrame) -> DataFrame:
    """analysis_id, action, state, final_queue, at, rejected_actions; columns analysis_id, seq, at, action, draft, queue, predicted_queue.

    A minimum by (at, seq), so a record with very many actions is never gathered.
    """
    ok = valid(F.col("action"), F.col("draft"), F.col("queue"))
    first = F.min(F.when(ok, F.struct("at", "seq", "action", "queue", "predicted_queue"))).alias("f")
    one = actions.groupBy("analysis_id").agg(first, F.count("*").alias("n"))
    final = F.when(F.col("f.action") == "reroute", F.col("f.queue")).when(F.col("f.action") == "accept", F.col("f.predicted_queue"))
    return one.select("analysis_id", F.col("f.action").alias("action"), F.coalesce(state_for(F.col("f.action")), F.lit("pending")).alias("state"), final.alias("final_queue"), F.col("f.at").alias("at"), (F.col("n") - F.col("f").isNotNull().cast("long")).alias("rejected_actions"))


def recent(states_: DataFrame, n: int) -> DataFrame:
    return states_.orderBy(F.desc_nulls_last("at"), F.desc("analysis_id")).limit(n)


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """New records, unless an id is taken or a confidence is out of range."""
    if new.join(log, "analysis_id", "left_semi").limit(1).count():
        raise ValueError("analysis_id exists already")
    if new.filter("queue_confidence not between 0 and 1 or trim(coalesce(ticket_text, '')) = ''").limit(1).count():
        raise ValueError("queue_confidence or ticket_text is not valid")
    return log.unionByName(new)


#: A review record's columns.
RECORD = "analysis_id string, created_at timestamp, ticket_text string, ticket_hash string, predicted_queue string, queue_confidence double, evidence string, draft string, provider string, state string"


def records(analyses: DataFrame) -> DataFrame:
    """Pending records from analyses: hash of the raw text, evidence ids and provider metadata as JSON text, blank drafts as null."""
    return analyses.select(
        "analysis_id", "created_at", "ticket_text", F.sha2("ticket_text", 256).alias("ticket_hash"), "predicted_queue", "queue_confidence", F.to_json("evidence_ids").alias("evidence"), blank_to_null(F.col("draft")).alias("draft"), F.to_json("provider").alias("provider"), F.lit("pending").alias("state")
    )


#: What a review adds to a record.
REVIEWED = "action string, final_queue string, final_draft string, notes string, reviewed_at timestamp"


def store(spark: SparkSession, path: str) -> Keyed:
    """The review records under ``path``, by analysis_id; a new folder is an empty store."""
    return Keyed(spark, path, f"{RECORD}, {REVIEWED}", "analysis_id")


def create(kept: Keyed, new: DataFrame) -> int:
    """New pending records; an id that is taken, also by a writer at the same time, is an error. Returns the version."""
    version = kept.version()
    names = new.sparkSession.createDataFrame([], kept.schema)
    full = new.select(*new.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in names.schema if f.name not in new.columns))
    old = kept.read(version)
    append(old.select(*new.columns), new)
    return kept.commit(full, version)


def submit(kept: Keyed, actions: DataFrame, version: int | None = None) -> int:
    """Review actions (analysis_id, action, queue, draft, notes, at), one a record, applied to pending records as of ``version``, by
    default the latest. An unknown record, one that is not pending, or an action that is not valid is an error; so is a record that moved since
    that version (``Conflict``). Returns the new version."""
    version = kept.version() if version is None else version
    a = actions.select(*(F.col(c).alias(f"a_{c}") for c in ("analysis_id", "action", "queue", "draft", "notes", "at")))
    joined = a.join(kept.read(version), F.col("a_analysis_id") == F.col("analysis_id"), "left")
    problem = (
        F.when(F.col("analysis_id").isNull(), "unknown record").when(F.col("state") != "pending", "not pending")
        .when(~F.coalesce(valid(F.col("a_action"), F.col("a_draft"), F.col("a_queue")), F.lit(False)), "not valid")
    )
    wrong = joined.select("a_analysis_id", problem.alias("problem")).filter("problem is not null").orderBy("a_analysis_id").first()
    if wrong:
        raise ValueError(f"{wrong['a_analysis_id']}: {wrong['problem']}")
    queue = F.when(F.col("a_action") == "reroute", F.col("a_queue")).when(F.col("a_action") == "accept", F.col("predicted_queue"))
    moved = {"state": state_for(F.col("a_action")), "action": F.col("a_action"), "final_queue": queue, "final_draft": F.when(F.col("a_action") == "edit", F.col("a_draft")).when(F.col("a_action") == "accept", F.col("draft")), "notes": blank_to_null(F.col("a_notes")), "reviewed_at": F.col("a_at")}
    return kept.commit(joined.withColumns(moved), version)


def decoded(stored: DataFrame) -> DataFrame:
    """Records with evidence ids as an array and provider metadata as a map; text that is not JSON becomes null."""
    return stored.withColumns({"evidence_ids": F.from_json("evidence", "array<string>"), "provider_fields": F.from_json("provider", "map<string,string>")})


def frame(stored: DataFrame, n: int = 100) -> DataFrame:
    """The newest records as a review table: short text, UTC time, number of evidence ids."""
    d = decoded(stored)
    shown = d.select("analysis_id", "created_at", utc_text(F.col("created_at")).alias("created"), "state", "predicted_queue", F.round("queue_confidence", 3).alias("confidence"), F.coalesce(F.size("evidence_ids"), F.lit(0)).alias("n_evidence"), preview(F.col("ticket_text"), 180).alias("ticket"))
    return shown.orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(n).drop("created_at")


def by_state(stored: DataFrame, state: str | None, n: int) -> DataFrame:
    """Newest records, of one state if given."""
    if state is not None and state not in ("pending", *STATES.values()):
        raise ValueError(f"unknown review state {state}")
    if n <= 0:
        raise ValueError("the limit must be positive")
    rows = stored if state is None else stored.filter(F.col("state") == state)
    return rows.orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(n)


def one(stored: DataFrame, analysis_id: str) -> DataFrame:
    return stored.filter(F.col("analysis_id") == analysis_id)
