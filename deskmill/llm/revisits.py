"""WARC revisit resolution: not-modified records get the body of the latest earlier full response.

Records are rows: record_id, record_type ('response' or 'revisit'), url, at (timestamp), status, etag, last_modified, headers (map),
body. An as-of join finds, for every revisit, the latest full response of the same canonical URL that is strictly earlier. Validators
are checked: where both have an ETag, the weak comparison must agree; else, where both have Last-Modified, those must agree. Where nothing
can be compared the revisit stays without a body. Headers of the revisit that a 304 response may carry (RFC 9110, 15.4.5) replace the
stored ones; all others stay.

The join is a union and one window per (canonical URL, time range): the last full response so far travels as its id only, and bodies are
joined back by record id. URLs of more than ``HOT_ROWS`` records are cut into time ranges at quantiles of their times; the last response of
each range goes on to the next ones. No cross join, no collect.

Rows: a null URL or time resolves to nothing ('no_base'). Of responses at the same time the greatest record_id counts. Responses with other
statuses than 200 and records of other or no type are no base and pass as they are, with an outcome of their own. Every row gives one row: records that repeat an id, time, URL and validators get the same answer, and of
responses that share an id the one with the greatest status and body is the base. Bodies of any length are moved, never cut. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.llm.store import cut

#: Fields a 304 response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Lower-case host without 'www.', no scheme, port, fragment, tracking or session query, trailing slash or '.html'."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(u, "^[^/?]*", 0), ":(80|443)$", ""))
    rest = F.regexp_replace(u, "^[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), r"\.html$", ""), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), "(^|&)(utm_[a-z]*|ref|sessionid)=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(F.regexp_replace(host, "^www[.]", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


HOT_ROWS, RANGES = 100_000, 256


def _bases(keys: DataFrame, hot_rows: int) -> DataFrame:
    """keys with ``base``, the latest full response (``own``) of the same URL before the record. At one time revisits come first."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    place = ("at", F.when(F.col("record_type") == "revisit", 0).otherwise(1), "record_id")
    many = keys.groupBy(F.col("url_key").alias("hot_key")).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("hot_key")
    of_hot = F.col("url_key") == F.col("hot_key")
    edges = F.percentile_approx(F.unix_micros("at"), [i / RANGES for i in range(1, RANGES)], 10_000).alias("edges")
    hot = cut(keys.join(many, of_hot, "left_semi").groupBy(F.col("url_key").alias("hot_key")).agg(edges), "hot-urls")
    if hot.isEmpty():
        return keys.withColumn("base", F.last("own", ignorenulls=True).over(before(Window.partitionBy("url_key").orderBy(*place))))
    ranged = keys.join(hot, of_hot, "left").withColumn("part", F.coalesce(F.size(F.filter("edges", lambda e: e < F.unix_micros("at"))), F.lit(0))).drop("hot_key", "edges")
    here = ranged.withColumn("here", F.last("own", ignorenulls=True).over(before(Window.partitionBy("url_key", "part").orderBy(*place))))
    # the last response of each range, carried to the ranges after it; only URLs that were cut have any
    last = ranged.join(hot, of_hot, "left_semi").filter("own is not null").groupBy("url_key", "part").agg(F.max_by("own", F.struct("at", "record_id")).alias("own"))
    parts = hot.select(F.col("hot_key").alias("url_key"), F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("part")).join(last, ["url_key", "part"], "left")  # RANGES rows a hot URL
    carried = parts.select(F.col("url_key").alias("c_key"), F.col("part").alias("c_part"), F.last("own", ignorenulls=True).over(before(Window.partitionBy("url_key").orderBy("part"))).alias("carried")).filter("carried is not null")
    return here.join(carried, (F.col("url_key") == F.col("c_key")) & (F.col("part") == F.col("c_part")), "left").withColumn("base", F.coalesce("here", "carried"))


def resolve(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """record_id, url_key, record_type, base_id, outcome, status, headers, body.

    outcome: 'full' (a response of status 200), 'other_status' (another response), 'other_type' (no response, no revisit), 'resolved', 'validator_mismatch', 'unverified' (no validator that both have), or 'no_base'; base, body and
    status of unresolved revisits are null.
    """
    r = records.select("record_id", "record_type", canonical_url(F.col("url")).alias("url_key"), "at", "status", "etag", "last_modified", "headers", "body")
    full = (F.col("record_type") == "response") & (F.col("status") == 200)
    same = ("record_id", "url_key", "at", "etag", "last_modified")
    own = F.when(full, F.struct(F.col("record_id").alias("id"), F.col("etag").alias("etag"), F.col("last_modified").alias("modified")))
    keys = cut(r.select(*same, "record_type", own.alias("own")).filter("url_key is not null and at is not null"), "revisit-keys")
    named = _bases(keys, hot_rows).filter("record_type = 'revisit' and base is not null")
    agree = F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), _weak(F.col("etag")) == _weak(F.col("base.etag"))).when(
        F.col("last_modified").isNotNull() & F.col("base.modified").isNotNull(), F.col("last_modified") == F.col("base.modified")
    )
    outcome = F.when(agree, "resolved").when(~agree, "validator_mismatch").otherwise("unverified")
    found = named.groupBy(*(F.col(c).alias(f"v_{c}") for c in same)).agg(F.max(F.struct(F.col("base.id").alias("id"), outcome.alias("outcome"))).alias("v"))  # one row for rows that are alike
    found = found.select(*(f"v_{c}" for c in same), F.when(F.col("v.outcome") == "resolved", F.col("v.id")).alias("base_id"), F.col("v.outcome").alias("found"))
    content = F.struct("status", "headers", "body")
    bodies = r.filter(full & F.col("url_key").isNotNull() & F.col("at").isNotNull())
    if keys.filter("own is not null").groupBy("record_id").count().filter("count > 1").isEmpty():
        bodies = bodies.select(F.col("record_id").alias("b_id"), content.alias("b"))
    else:
        bodies = bodies.groupBy(F.col("record_id").alias("b_id")).agg(F.max_by(content, F.struct("status", "body")).alias("b"))
    # only revisits are joined, so a body is shuffled once; responses pass as they are
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    alike = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"v_{c}")) for c in same))
    joined = r.filter(revisit).drop("status", "body").join(found, alike, "left").join(bodies, (F.coalesce("base_id", "record_id") == F.col("b_id")) & F.col("base_id").isNotNull(), "left")  # rows without a base are spread by their own id
    good = F.col("base_id").isNotNull()
    allowed = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k).isin(*PERMITTED))
    names = F.transform(F.map_keys(allowed), lambda k: F.lower(k))
    kept = F.map_filter(F.coalesce("b.headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(names, F.lower(k)))
    resolved = joined.select(
        "record_id", "url_key", "record_type", "base_id", F.coalesce("found", F.lit("no_base")).alias("outcome"),
        F.when(good, F.col("b.status")).alias("status"), F.when(good, F.map_concat(kept, allowed)).otherwise(F.col("headers")).alias("headers"), F.when(good, F.col("b.body")).alias("body"),
    )
    kind = F.when(full, "full").when(F.col("record_type") == "response", "other_status").otherwise("other_type")
    rest = r.filter(~revisit).select("record_id", "url_key", "record_type", F.lit(None).cast(r.schema["record_id"].dataType).alias("base_id"), kind.alias("outcome"), "status", "headers", "body")
    return rest.unionByName(resolved)
