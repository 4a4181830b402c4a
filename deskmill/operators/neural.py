"""The neural comparison model: word embedding, one convolution, maximum over places, a softmax; trained data-parallel.

Parameters live on the driver (their size is that of the model: vocabulary x embedding) and go to the tasks as a broadcast. An epoch deals the
rows into steps by a hash of their id; in a step every task sums the gradient of its rows, these are added up piece by piece over all tasks
(pieces of words that did not occur are not sent), and the driver takes one Adam step.

Everything random comes from the seed: first values, and dropout from a hash of seed, step, row and unit. So a run does not depend on how rows
are dealt to tasks, but for the order in which floats are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.operators import classify, ml, reports
from deskmill.operators.search import read_config, write_config
from deskmill.operators.sums import summed
from deskmill.sources.store import cut, drop

#: The model's sizes and regularisation.
EMBEDDING, FILTERS, WIDTH = 64, 64, 5
DROP_WORDS, DROP_TOP = 0.20, 0.40
L2_WORDS, L2_KERNEL = 1e-6, 1e-5
EPOCHS, PATIENCE, STEPS, RATE, SEED = 12, 2, 8, 5e-3, 42
ROWS = 64  # of a task's forward pass


@dataclass
class Model:
    """Parameters by name, the classes in order, and the seed."""

    p: dict[str, np.ndarray]
    classes: list[str]
    seed: int = SEED

    @classmethod
    def new(cls, classes: list[str], words: int = ml.VOCABULARY, embedding: int = EMBEDDING, filters: int = FILTERS, seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed)
        even = lambda a, b, *shape: rng.uniform(-np.sqrt(6 / (a + b)), np.sqrt(6 / (a + b)), shape)
        k = len(classes)
        return cls({"words": rng.uniform(-0.05, 0.05, (words, embedding)), "kernel": even(WIDTH * embedding, WIDTH * filters, WIDTH, embedding, filters), "bias": np.zeros(filters), "top": even(filters, k, filters, k), "shift": np.zeros(k)}, list(classes), seed)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(k, list(v.shape), v.astype("<f8").tobytes()) for k, v in self.p.items()]
        spark.createDataFrame(rows, "name string, shape array<int>, numbers binary").write.mode("overwrite").parquet(f"{path}/parameters")
        write_config(spark, path, {"kind": "conv1d", "classes": self.classes, "seed": self.seed})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        config = read_config(spark, path, "conv1d", ("parameters",))
        rows = spark.read.parquet(f"{path}/parameters").collect()
        return cls({r["name"]: np.frombuffer(r["numbers"], "<f8").reshape(r["shape"]).copy() for r in rows}, config["classes"], config["seed"])


def _random(seed: int, step: int, row: np.ndarray, units: int) -> np.ndarray:
    """Numbers from 0 to 1 by row and unit."""
    x = (row.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(units, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64((seed * 0x165667B19E3779F9 + step * 0x27D4EB2F165667C5) % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return (x ^ (x >> np.uint64(31))).astype(float) / 2.0**64


def _windows(x: np.ndarray) -> np.ndarray:
    """A view of the ``WIDTH`` places from each place on, side by side; windows that run over the end of a row are never asked for."""
    flat = x.reshape(-1, x.shape[2])
    return np.lib.stride_tricks.as_strided(flat, (len(flat) - WIDTH + 1, WIDTH * x.shape[2]), flat.strides, writeable=False)


def _forward(p: dict[str, np.ndarray], ids: np.ndarray, masks: tuple[np.ndarray, np.ndarray] | None) -> dict[str, np.ndarray]:
    n, length = ids.shape
    half, wide = WIDTH // 2, length + WIDTH - 1
    filters = p["kernel"].shape[2]
    x = np.zeros((n, wide, p["words"].shape[1]))
    x[:, half : half + length] = p["words"][ids]
    if masks:
        x *= masks[0][:, None, :]
    kernel = np.ascontiguousarray(p["kernel"].reshape(-1, filters).T)
    at, top = np.empty((n, filters), np.int64), np.empty((n, filters))
    for row in range(n):  # a row's windows and values stay in the cache
        h = kernel @ _windows(x[row : row + 1]).T
        at[row] = h.argmax(axis=1)
        top[row] = h[np.arange(filters), at[row]]
    top = np.maximum(top + p["bias"], 0.0)
    out = top * masks[1] if masks else top
    z = out @ p["top"] + p["shift"]
    z -= z.max(axis=1, keepdims=True)
    chance = np.exp(z)
    chance /= chance.sum(axis=1, keepdims=True)
    return {"x": x, "at": at, "top": top, "out": out, "chance": chance}


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, which come in order, and the sums of their rows."""
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values, first, axis=0) if len(keys) else values


def gradient(p: dict[str, np.ndarray], ids: np.ndarray, y: np.ndarray, w: np.ndarray, masks: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Summed weighted loss (without regularisation), its gradient but for words, and the words that a maximum reaches with their gradients."""
    f = _forward(p, ids, masks)
    n, length = ids.shape
    loss = float(-(w * np.log(np.maximum(f["chance"][np.arange(n), y], 1e-300))).sum())
    dz = f["chance"].copy()
    dz[np.arange(n), y] -= 1
    dz *= w[:, None]
    dtop = dz @ p["top"].T
    if masks:
        dtop = dtop * masks[1]
    dtop = np.where(f["top"] > 0, dtop, 0.0)
    embedding, filters = p["kernel"].shape[1:]
    unit, row = np.nonzero(dtop.T)  # only the place of a filter's maximum has a gradient
    slope, place = dtop[row, unit], f["at"][row, unit]
    which, own = _sums(unit, _windows(f["x"])[row * f["x"].shape[1] + place] * slope[:, None])
    dkernel = np.zeros((filters, WIDTH * embedding))
    dkernel[which] = own
    into = np.ascontiguousarray(p["kernel"].transpose(2, 0, 1))  # filter, place of the window, embedding
    spots = place[:, None] + np.arange(WIDTH) - WIDTH // 2
    inside = (spots >= 0) & (spots < length)
    which, k = np.nonzero(inside)
    word = ids[row[which], spots[inside]]
    order = np.argsort(word, kind="stable")
    which, k = which[order], k[order]
    back = into[unit[which], k] * slope[which, None]
    if masks:
        back *= masks[0][row[which]]
    words, dwords = _sums(word[order], back)
    return loss, {"kernel": dkernel.T.reshape(p["kernel"].shape), "bias": dtop.sum(axis=0), "top": f["out"].T @ dz, "shift": dz.sum(axis=0)}, words, dwords


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("ids").flatten().to_numpy().reshape(batch.num_rows, -1)
    return (batch.column("doc_id").to_numpy(), ids, *(batch.column(c).to_numpy() for c in ("y", "w")))


def step_gradient(rows: DataFrame, model: Model, step: int, dropout: bool = True) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss and gradient summed over (doc_id, ids, y, w) rows, and how many they are."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model.p)  # as large as the model
    seed = model.seed

    def totals(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        p = sent.value
        total = {"loss": np.zeros(2), **{k: np.zeros_like(x) for k, x in p.items()}}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                doc, ids, y, w = _columns(batch.slice(lo, ROWS))
                masks = None
                if dropout:
                    masks = tuple((_random(seed + k, step, doc, size) >= rate) / (1 - rate) for k, (size, rate) in enumerate(((p["words"].shape[1], DROP_WORDS), (p["top"].shape[0], DROP_TOP))))
                part, g, which, own = gradient(p, ids, y, w, masks)
                total["loss"] += (part, len(doc))
                for k, x in g.items():
                    total[k] += x
                total["words"][which] += own
        return total

    found = summed(rows, totals, {"loss": (2,), **{k: x.shape for k, x in model.p.items()}})
    sent.unpersist()
    loss, count = found.pop("loss")
    return float(loss), int(count), found


@dataclass
class Adam:
    rate: float = RATE
    steps: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, x in g.items():
            m = self.first[k] = 0.9 * self.first.get(k, 0.0) + 0.1 * x
            v = self.second[k] = 0.999 * self.second.get(k, 0.0) + 0.001 * x * x
            p[k] = p[k] - self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7)


def scores(model: Model, rows: DataFrame) -> DataFrame:
    """vec_id, truth, label, p of (doc_id, ids, truth) rows: a row per class."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model.p)
    classes = model.classes

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = part.column("ids").flatten().to_numpy().reshape(part.num_rows, -1)
                chance = _forward(sent.value, ids, None)["chance"]
                row = pa.array(np.repeat(np.arange(len(ids)), len(classes)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("truth").take(row), pa.array(classes * len(ids), pa.string()), pa.array(chance.reshape(-1))], ["vec_id", "truth", "label", "p"])

    return rows.select("doc_id", "ids", F.col("truth").cast("string").alias("truth")).mapInArrow(predict, "vec_id long, truth string, label string, p double")


def log_loss(found: DataFrame) -> float:
    """Mean loss of rows whose class is known to the model; a class that it does not know counts as a chance of 1e-15."""
    own = found.groupBy("vec_id").agg(F.max(F.when(F.col("truth") == F.col("label"), F.col("p"))).alias("p"))
    return own.agg(F.avg(-F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-15))))).first()[0] or 0.0


@dataclass
class Fitted:
    """The best model, and loss, val_loss of each epoch."""

    model: Model
    history: list[dict]


def fit(train: DataFrame, validation: DataFrame, classes: list[str], words: int = ml.VOCABULARY, *, epochs: int = EPOCHS, patience: int = PATIENCE, steps: int = STEPS, rate: float = RATE, seed: int = SEED, embedding: int = EMBEDDING, filters: int = FILTERS) -> Fitted:
    """From (doc_id, ids, truth) rows. Rows weigh by the inverse frequency of their class; training ends when the validation loss has not
    fallen for ``patience`` epochs, and the parameters of its least value are kept."""
    if not classes or train.isEmpty():
        raise ValueError("no training rows")
    spark = train.sparkSession
    model = Model.new(classes, words, embedding, filters, seed)
    weight = classify.class_weights(train, "truth").select(F.col("label").alias("w_label"), F.col("weight").alias("w"))
    code = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "y_label string, y long")  # a row a class
    ready = train.join(F.broadcast(weight), F.col("truth") == F.col("w_label")).join(F.broadcast(code), F.col("truth") == F.col("y_label"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(steps)).cast("int")
    rows = cut(ready.select("doc_id", "ids", "y", F.col("w").cast("double").alias("w"), fold.alias("fold")), "neural-rows", by="fold")
    held = cut(validation.select("doc_id", "ids", "truth"), "neural-validation")
    adam, best, history, waited = Adam(rate), (np.inf, model.p), [], 0
    order = np.random.default_rng(seed)
    for epoch in range(epochs):
        loss, count = 0.0, 0
        for k in order.permutation(steps):
            part, n, g = step_gradient(rows.filter(F.col("fold") == int(k)), model, epoch * steps + int(k))
            if not n:
                continue
            loss, count = loss + part, count + n
            g = {name: x / n for name, x in g.items()}
            g["words"] += 2 * L2_WORDS * model.p["words"]
            g["kernel"] += 2 * L2_KERNEL * model.p["kernel"]
            model.p = dict(model.p)  # the best ones stay as they are
            adam.step(model.p, g)
        seen = log_loss(scores(model, held))
        history.append({"epoch": epoch, "loss": loss / max(1, count), "val_loss": seen})
        if seen < best[0]:
            best, waited = (seen, model.p), 0
        else:
            waited += 1
            if waited == patience:
                break
    drop(rows, held)
    return Fitted(Model(best[1], classes, seed), history)


def train_and_evaluate(prepared: DataFrame, label: str = "queue", most: int = ml.VOCABULARY, **how) -> tuple[Fitted, DataFrame, dict]:
    """The fitted model, its vocabulary, and the report, from (doc_id, split, classifier_text, label) rows. Vocabulary and model see the training
    split; validation ends training; the test split is only reported."""
    rows = cut(prepared.filter(F.col(label).isNotNull()).select("doc_id", "split", "classifier_text", F.col(label).alias("truth")), "neural-texts")
    part = lambda df, s: df.filter(F.col("split") == s)
    vocabulary = cut(ml.fit_vocabulary(part(rows, "train"), most=most), "neural-vocabulary")
    x = cut(ml.sequences(rows, vocabulary, keep=("split", "truth")), "neural-sequences")
    classes = [r["truth"] for r in part(rows, "train").select("truth").distinct().orderBy("truth").collect()]  # as many as classes
    fitted = fit(part(x, "train"), part(x, "validation"), classes, most, **how)
    names = prepared.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    report: dict = {"classes": classes, "history": fitted.history, "epochs_run": len(fitted.history), "metrics": {}}
    for s in ("validation", "test"):
        found = cut(scores(fitted.model, part(x, s)), f"neural-{s}")
        pred = classify.predictions(found.withColumn("split", F.lit(s)))
        report["metrics"][s] = {**reports.nested(classify.summary(pred, names)), **reports.nested(classify.calibration(found, pred))}
    drop(rows, x)
    return fitted, vocabulary, report


def comparison(spark: SparkSession, models: dict[str, dict[str, dict]]) -> DataFrame:
    """model, split, accuracy, macro_f1, weighted_f1, top3_accuracy, log_loss, ece: a row per model and split of their reports' metrics."""
    names = ("accuracy", "macro_f1", "weighted_f1", "top3_accuracy", "log_loss", "ece")
    rows = [(m, s, *(float(x[k]) if x.get(k) is not None else None for k in names)) for m, splits in models.items() for s, x in splits.items()]
    return spark.createDataFrame(rows, "model string, split string, " + ", ".join(f"{k} double" for k in names))
