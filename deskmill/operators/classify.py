"""Classifier evaluation from a long (id, truth, label, p) table, and a nearest-centroid classifier to feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.functions.text import clamp_probability
from deskmill.operators import profile
from deskmill.sources.store import cut

GRID = [round(0.05 * i, 2) for i in range(21)]
#: Ten equal bins as floating point makes them.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]
MIN_COVERAGE, LOW_SUPPORT, LOW_RECALL = 0.70, 100, 0.60


def vector_split(c: Column) -> Column:
    d = F.substring(F.sha2(c.cast("string"), 256), 1, 1)
    return F.when(d <= "a", "train").when(d <= "d", "validation").otherwise("test")


def centroid_scores(vectors: DataFrame, sharpness: float = 10.0) -> DataFrame:
    """vec_id, split, truth, label, p: softmax of the dot products with each label's mean training vector, to nine digits."""
    long = vectors.select("vec_id", "label", vector_split(F.col("vec_id")).alias("split"), F.posexplode("embedding").alias("i", "x"))
    centre = long.filter("split = 'train'").groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centres = centre.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))  # as many rows as labels
    dot = F.aggregate(F.zip_with("embedding", "c", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    raw = vectors.select("vec_id", F.col("label").alias("truth"), "embedding", vector_split(F.col("vec_id")).alias("split")).crossJoin(F.broadcast(centres)).select("vec_id", "split", "truth", "label", F.exp(sharpness * dot).alias("e"))
    total = raw.groupBy("vec_id").agg(F.sum("e").alias("t"))
    return raw.join(total, "vec_id").select("vec_id", "split", "truth", "label", F.round(F.col("e") / F.col("t"), 9).alias("p"))


def predictions(scores: DataFrame) -> DataFrame:
    """vec_id, split, truth, predicted, confidence, top3; ties by label."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("minus"), "label")))
    one = scores.groupBy("vec_id", "split", "truth").agg(order.alias("o"))
    return one.select("vec_id", "split", "truth", F.col("o")[0]["label"].alias("predicted"), (-F.col("o")[0]["minus"]).alias("confidence"), F.transform(F.slice("o", 1, 3), lambda x: x["label"]).alias("top3"))


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def per_class(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision, recall, F1, support of every label of ``labels`` (label); 0 where a denominator is 0."""
    hit = F.sum((F.col("truth") == F.col("predicted")).cast("long"))
    t = pred.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("support"), hit.alias("tp"))
    p = pred.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("called"))
    x = labels.join(t, "label", "left").join(p, "label", "left").fillna(0, ["support", "tp", "called"])
    x = x.withColumns({"precision": F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return x.select("label", "precision", "recall", f1.alias("f1"), "support")


def summary(pred: DataFrame, labels: DataFrame) -> DataFrame:
    c = per_class(pred, labels).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    a = pred.agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"), F.avg(F.array_contains("top3", F.col("truth")).cast("double")).alias("top3_accuracy"))
    both = a.crossJoin(c)  # one row each
    return both.select("n", *(F.round(k, 6).alias(k) for k in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "top3_accuracy")))


def bins(pred: DataFrame) -> DataFrame:
    """Equal-width bins, left-inclusive, the last closed; an empty bin is zeros. A row's bin is the number of inner edges that it reaches."""
    edges = pred.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))], "bin long, low double, high double")
    own = sum((F.col("confidence") >= e).cast("long") for e in EDGES[1:-1])
    x = pred.filter(F.col("confidence").between(EDGES[0], EDGES[-1])).groupBy(own.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("a"))
    return edges.join(x, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("c", F.lit(0.0)), 6).alias("mean_confidence"), F.round(F.coalesce("a", F.lit(0.0)), 6).alias("accuracy"))


def calibration(scores: DataFrame, pred: DataFrame) -> DataFrame:
    y = (F.col("truth") == F.col("label")).cast("double")
    s = scores.groupBy("vec_id").agg(F.sum(F.pow(F.col("p") - y, F.lit(2.0))).alias("b"), F.sum(F.when(F.col("truth") == F.col("label"), -F.log(F.greatest(F.col("p"), F.lit(1e-15))))).alias("l")).agg(F.round(F.avg("b"), 6).alias("brier"), F.round(F.avg("l"), 6).alias("log_loss"))
    e = bins(pred).agg(F.round(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n"), F.lit(0.0)), 5).alias("ece"))
    return s.crossJoin(e)


def coverage_curve(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """Coverage, review rate, accuracy and macro-F1 of rows at or above each threshold.

    Rows are counted once, by (thresholds reached, truth, predicted); the curve is made of those few counts.
    """
    spark = pred.sparkSession
    reached = sum((F.col("confidence") >= t).cast("int") for t in GRID)
    counts = cut(pred.groupBy(reached.alias("reached"), "truth", "predicted").agg(F.count("*").alias("c")), "curve-counts")
    grid = F.broadcast(spark.createDataFrame([(i, t) for i, t in enumerate(GRID, 1)], "place int, threshold double"))
    above = counts.join(grid, F.col("reached") >= F.col("place"))
    right = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("c")).otherwise(0))
    a = above.groupBy("threshold").agg(F.sum("c").alias("covered"), right.alias("right"))
    t = above.groupBy("threshold", F.col("truth").alias("label")).agg(F.sum("c").alias("support"), right.alias("tp"))
    p = above.groupBy("threshold", F.col("predicted").alias("label")).agg(F.sum("c").alias("called"))
    m = t.join(p, ["threshold", "label"]).groupBy("threshold").agg(F.sum(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("called")), F.lit(0.0))).alias("f1_sum"))
    one = counts.agg(F.sum("c").alias("total")).crossJoin(labels.agg(F.count("*").alias("k")))  # one row
    out = grid.crossJoin(one).join(a, "threshold", "left").join(m, "threshold", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = zero(F.try_divide("covered", "total"))
    return out.select("threshold", F.coalesce("covered", F.lit(0)).alias("covered"), F.round(share, 6).alias("coverage"), F.round(1.0 - share, 6).alias("review_rate"), F.round(zero(F.try_divide("right", "covered")), 6).alias("accuracy"), F.round(zero(F.try_divide("f1_sum", "k")), 6).alias("macro_f1"))


def select_abstention(curve: DataFrame, minimum: float = MIN_COVERAGE) -> DataFrame:
    """Best of the thresholds with enough coverage (all, if none has): macro-F1, accuracy, coverage, then the lowest."""
    return curve.withColumn("enough", F.col("coverage") >= minimum).orderBy(F.desc("enough"), F.desc("macro_f1"), F.desc("accuracy"), F.desc("coverage"), "threshold").limit(1).select("threshold", "coverage", "accuracy", "macro_f1")


def per_queue_confidence(pred: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    middle = profile.describe(pred.withColumnRenamed("truth", "label"), ["label"], "confidence", ("median",)).select("label", F.col("median").alias("median_confidence"))
    q = pred.groupBy(F.col("truth").alias("label")).agg(F.round(F.avg((F.col("confidence") < threshold).cast("double")), 6).alias("review_rate"))
    c = per_class(pred, labels).join(q, "label", "left").join(middle, "label", "left")
    return c.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support", "median_confidence", "review_rate", (F.col("support") < LOW_SUPPORT).alias("low_support"), (F.col("recall") < LOW_RECALL).alias("low_recall"))


def class_weights(labels: DataFrame, column: str) -> DataFrame:
    n = labels.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("t") / (F.col("k") * F.col("n")), 6).alias("weight"))


# ---- scores and labels --------------------------------------------------------------------------------------------


def normalized(scores: DataFrame) -> DataFrame:
    """(vec_id, label, p): p clipped to 0..1 and divided by its row's sum; a row of zeros stays as it is."""
    clipped = scores.withColumn("p", clamp_probability(F.col("p")))
    total = clipped.groupBy("vec_id").agg(F.sum("p").alias("t"))
    return clipped.join(total, "vec_id").select(*scores.columns[: scores.columns.index("p")], F.when(F.col("t") > 0, F.col("p") / F.col("t")).otherwise(F.col("p")).alias("p"))


def wide_confusion(pred: DataFrame, labels: list) -> DataFrame:
    """One row per true label and one column per predicted label of ``labels``, zeros where there are none."""
    counts = pred.groupBy(F.col("truth").alias("label")).pivot("predicted", labels).agg(F.count(F.lit(1)))
    names = pred.sparkSession.createDataFrame([(x,) for x in labels], T.StructType([T.StructField("label", pred.schema["truth"].dataType)]))
    return names.join(counts, "label", "left").fillna(0)


def encode_labels(labels: DataFrame) -> DataFrame:
    """label, index: distinct labels of ``labels`` (label) in order. As many rows as labels."""
    return labels.select("label").filter("label is not null").distinct().select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("long").alias("index"))


def to_index(df: DataFrame, column: str, encoder: DataFrame, out: str = "index") -> DataFrame:
    """df with the index of its label, null for a label that the encoder was not fitted on."""
    e = encoder.select(F.col("label").alias("_label"), F.col("index").alias(out))
    return df.join(e, df[column] == e["_label"], "left").drop("_label")


def to_label(df: DataFrame, column: str, encoder: DataFrame, out: str = "label") -> DataFrame:
    """df with the label of its index, null for an index that the encoder does not have."""
    e = encoder.select(F.col("index").alias("_index"), F.col("label").alias(out))
    return df.join(e, df[column] == e["_index"], "left").drop("_index")


# ---- comparison ---------------------------------------------------------------------------------------------------

METRICS = ("accuracy", "macro_f1", "weighted_f1", "top3_accuracy")


def compare(a: DataFrame, b: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, first, second, delta (second less first) of two one-row metric frames."""
    long = lambda df, name: df.select(*(F.col(x).cast("double").alias(x) for x in names)).unpivot([], list(names), "metric", name)
    return long(a, "first").join(long(b, "second"), "metric").select("metric", "first", "second", F.round(F.col("second") - F.col("first"), 6).alias("delta"))


def select_model(metrics: DataFrame) -> DataFrame:
    """The best row of (model, metrics): macro-F1, weighted F1, accuracy, then the last name."""
    return metrics.orderBy(F.desc("macro_f1"), F.desc("weighted_f1"), F.desc("accuracy"), F.desc("model")).limit(1)


def deployment(metrics: DataFrame, present: str, other: str) -> DataFrame:
    """present, other, decision: the other model is taken only if its macro-F1 is strictly higher."""
    f1 = lambda m: F.max(F.when(F.col("model") == m, F.col("macro_f1")))
    one = metrics.agg(f1(present).alias("a"), f1(other).alias("b"))
    return one.select(F.col("a").alias("present_f1"), F.col("b").alias("other_f1"), F.when(F.col("b") > F.col("a"), other).otherwise(present).alias("decision"))
