"""Language identification: sparse multinomial logistic regression.

Features are character n-grams (1 to 3) of the lower-cased text, hashed into
``FEATURES`` slots; a value is the n-gram's share of the text times its inverse
document frequency. Document frequencies are counted by Spark over all training
rows. The weights are fitted by follow-the-regularised-leader (proximal, with
per-weight rates) under an elastic net, which leaves most weights at zero, on a
bounded sample of labelled rows: at most ``SAMPLE`` rows, shared out evenly among all
labels that occur, but at least ``LEAST`` of each, taken in seeded hash order, whole texts. A fifth of the
sample is kept from the fit and sets the temperature that calibrates the scores.

The share of a text makes the score a mean over its n-grams, so a prediction is
one pass over the text and a table look-up per n-gram.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and
all texts if nothing could be learned; rows with a null id are never learned from
and are not held out; null labels are not learned from; rows equal in id, label and text count once in the
sample; ties in probability go to
the label that is smaller in code point order; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from runlens.llm.common import column, free, ship, slices, without
from runlens.llm.mixing import seeded_order

FEATURES = 1 << 16
ORDERS = 3
SAMPLE, LEAST = 3000, 10
#: Labels up to which the weights are held as a table; of more, only the weights that are not zero.
DENSE = 64
#: Hex digits of the hash by which rows are counted before the sample is cut.
PREFIX = 5
#: Brings the values of a text to a length of about one.
SCALE = 16.0
#: Rate, its smoothing, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
EPOCHS = 4
#: Characters whose n-grams are looked up together.
CHUNK = 1 << 20


def slots(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a text, in chunks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, len(codes), CHUNK):
        part = codes[at:at + CHUNK + ORDERS - 1]
        h = np.zeros(len(part), np.uint64)
        for order in range(ORDERS):
            if order:
                h = h[:-1]
            starts = min(CHUNK, len(h))
            h = h * np.uint64(1_000_003) + part[order:order + len(h)] + np.uint64(order + 1)
            if starts > 0:
                mixed = h[:starts] * np.uint64(0x9E3779B97F4A7C15)
                yield (mixed >> np.uint64(48)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray | None  # FEATURES x labels: scale x idf x weight
    bias: np.ndarray
    temperature: float
    sparse: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # of many labels: row starts, labels and weights

    def _sums(self, s: np.ndarray) -> np.ndarray:
        if self.table is None:
            starts, of, weight = self.sparse
            counts = np.bincount(s, minlength=FEATURES)
            at = np.flatnonzero(counts)
            sizes = starts[at + 1] - starts[at]
            i = np.arange(sizes.sum()) + np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes)
            return np.bincount(of[i], weights=weight[i] * np.repeat(counts[at], sizes), minlength=len(self.labels))
        return self.table[s].sum(axis=0, dtype=np.float64) if len(s) < FEATURES else np.bincount(s, minlength=FEATURES) @ self.table

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.labels)), 0
        for s in slots(text):
            n += len(s)
            total += self._sums(s)
        return softmax((total / max(n, 1) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return "und", 0.0
        p = self.probabilities(text)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Follower:
    """Follow-the-regularised-leader state of a multinomial model."""

    def __init__(self, labels: int):
        self.z, self.n = np.zeros((FEATURES + 1, labels)), np.zeros((FEATURES + 1, labels))  # the last row is the bias

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, FEATURES), np.append(x, 1.0)
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, seed: int = 7) -> Model:
    """``rows``: label, feature numbers and shares, in a fixed order."""
    labels = sorted({r[0] for r in rows})
    number = {k: i for i, k in enumerate(labels)}
    data = [(at, share * idf[at] * SCALE, number[label]) for label, at, share in rows]
    kept = [i for i in range(len(data)) if i % 5 == 4]  # rows come in hash order
    used = [i for i in range(len(data)) if i % 5 != 4]
    state, rng = Follower(len(labels)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            state.learn(*data[i])
    w = state.weights(slice(None))
    temperature = 1.0
    if kept:
        logits = np.array([x @ w[at] + w[FEATURES] for at, x, _ in (data[i] for i in kept)])
        truth = np.array([data[i][2] for i in kept])

        def loss(log_t: float) -> float:
            p = softmax(logits / np.exp(log_t))
            return -float(np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-300)).mean())

        low, high, golden = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
        for _ in range(40):  # the loss has one minimum
            a, b = high - golden * (high - low), low + golden * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        temperature = float(np.exp((low + high) / 2))
    if len(labels) <= DENSE:
        return Model(labels, (SCALE * idf[:, None] * w[:FEATURES]).astype(np.float32), w[FEATURES], temperature)
    at, of = np.nonzero(w[:FEATURES])
    starts = np.searchsorted(at, np.arange(FEATURES + 1))
    return Model(labels, None, w[FEATURES], temperature, (starts, of, (SCALE * idf[at] * w[at, of]).astype(np.float32)))


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fit on rows (doc_id, text, lang) that are not held out."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "text", F.col("lang").cast("string").alias("lang"), seeded_order(F.col("doc_id"), "lang").alias("h"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, n = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, bool), 0
        for batch in batches:
            for text in batch.column("text"):
                for s in slots(text.as_py()):
                    seen[s] = True
                df += seen
                seen[:] = False
                n += 1
        df[FEATURES] = n  # documents
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], names=["feature", "n"])

    table = rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1)
    df[table.column("feature").to_numpy()] = table.column("n").to_numpy()
    idf = np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1

    # the sample: per label the first rows in hash order. Counts per label and hash prefix tell in which prefix the
    # share of a label ends, so only rows up to there are numbered
    rows = rows.withColumn("b", F.substring("h", 1, PREFIX))
    counts = rows.groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select("lang").distinct().count()
    if not labels:
        return Model([], None, np.zeros(0), 1.0)
    share = max(LEAST, SAMPLE // labels)
    before = Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ends = counts.withColumn("above", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("above") < share).groupBy("lang").agg(F.max("b").alias("end"))
    near = rows.join(F.broadcast(ends), "lang").where(F.col("b") <= F.col("end"))  # a row per label, less than the model has
    near = near.select("lang", "h", F.sha2("text", 256).alias("t"), "text").dropDuplicates(["lang", "h", "t"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    picked = near.withColumn("place", place).where(F.col("place") <= share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share = [], []
            for text in batch.column("text"):
                n = sum((np.bincount(s, minlength=FEATURES) for s in slots(text.as_py())), np.zeros(FEATURES, np.int64))
                i = np.flatnonzero(n)
                at.append(i.astype(np.int32).tobytes())
                share.append((n[i] / max(n.sum(), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(at, pa.binary()), pa.array(share, pa.binary())],
                                             names=["lang", "h", "at", "share"])

    sample = picked.select("lang", "h", "text").mapInArrow(features, "lang string, h string, at binary, share binary").collect()
    sample.sort(key=lambda r: (r["h"], r["lang"], bytes(r["at"])))
    return fit([(r["lang"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32).astype(float)) for r in sample], idf)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows with lang_pred and score added; the model is fitted on the rows themselves.

    Columns named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs.select(
        column(docs, id_col).alias("doc_id"), column(docs, text_col).cast("string").alias("text"), column(docs, lang_col).alias("lang"))))
    kept = docs.select(*[column(docs, c) for c in without(docs, ("lang_pred", "score"))])
    # a string column is read where it is, so that no batch holds its texts twice
    plain_text = text_col in kept.columns and isinstance(kept.schema[text_col].dataType, StringType)
    held = text_col if plain_text else free(docs, "_text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.value.predict(t.as_py()) for t in batch.column(held)]
            plain = batch if plain_text else batch.drop_columns([held])
            yield pa.RecordBatch.from_arrays(
                [*plain.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*plain.schema.names, "lang_pred", "score"])

    schema = StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    rows = kept if plain_text else kept.withColumn(held, column(docs, text_col).cast("string"))
    return rows.mapInArrow(predict, schema)
