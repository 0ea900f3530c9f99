"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Words are runs of letters and digits or runs of other signs, lower-cased and hashed to ``BUCKETS`` buckets; marks stand for words in
capitals, a word equal to the one before, and a line equal to an earlier one. Every bucket has a sparse ternary index vector; its
context vector is the sum of the index vectors of its neighbours (two on each side) over the fitting sample, counted in whole
numbers by Spark, so that it does not depend on the order of tasks. A document is the mean over its words of (index, context)
vectors and the logarithm of its length. A numpy network (tanh layer, logistic output) is fitted on a bounded sample of labelled
rows, and its logit is divided by a temperature that minimises the log loss on a fifth of that sample kept apart.

The sample is the ``sample_rows`` labelled documents with the smallest hashes of their ids; it is the only bound. All documents are
scored, whole.

Edge cases: a null or empty text has the zero vector and a score like any other. Rows with a null id or null label are not learned from;
several labels for an id count as the smallest. Without labels, or with one class, every score is the smoothed base rate.
Repeated rows each get a row. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import cut, small_batches

BUCKETS, DIM, NONZERO, HIDDEN = 1 << 15, 64, 4, 32
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_CAPITALS, _AGAIN, _LINE = " capitals", " again", " line"


def tokens(text: str | None) -> list[str]:
    """Words of a text and the marks for capitals, repeated words and repeated lines."""
    raw = _TOKEN.findall(text or "")
    out = [x.lower() for x in raw]
    marks = [_CAPITALS] * sum(len(x) > 1 and x.isupper() for x in raw) + [_AGAIN] * sum(map(str.__eq__, out, out[1:]))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return out + marks + [_LINE] * (len(lines) - len(set(lines)))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs (BUCKETS x NONZERO) of the sparse index vectors."""
    draw = np.random.Generator(np.random.PCG64(20240501))
    return draw.integers(0, DIM, (BUCKETS, NONZERO)), draw.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1


class Buckets(dict):
    """Buckets of words; forgets what it holds beyond 100,000 words, as a worker keeps it through the stages that follow."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        b = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
        return b


def contexts(texts: list[str | None]) -> np.ndarray:
    """Sums of neighbours' index vectors over texts, BUCKETS x DIM whole numbers."""
    at, sign = index_vectors()
    out, bucket = np.zeros(BUCKETS * DIM, dtype=np.int64), Buckets()
    for text in texts:
        ids = np.fromiter(map(bucket.__getitem__, tokens(text)), dtype=np.int64)
        for step in (1, 2):
            for u, v in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                for k in range(NONZERO):
                    np.add.at(out, u * DIM + at[v, k], sign[v, k])
    return out.reshape(BUCKETS, DIM)


@dataclass
class Model:
    """Unit context vectors (BUCKETS x DIM, half precision), the scaling of features, the two layers and the temperature."""

    context: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.mean) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -40, 40)))


def unit(context: np.ndarray) -> np.ndarray:
    """Context sums scaled to length one, in half precision: what is sent to the tasks."""
    norm = np.sqrt((context.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (context / np.maximum(norm, 1)).astype(np.float16)


_LAST: list[np.ndarray] = []


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Index vectors beside context vectors. A worker keeps those of its last model."""
    if not _LAST or _LAST[0] is not context:
        at, sign = index_vectors()
        own = np.zeros((BUCKETS, DIM), dtype=np.float32)
        np.add.at(own, (np.arange(BUCKETS)[:, None], at), sign.astype(np.float32))
        _LAST[:] = [context, np.hstack([own, context.astype(np.float32)])]
    return _LAST[1]


def pool(texts, words: np.ndarray, bucket: Buckets) -> np.ndarray:
    """Mean word vector and log length of each text."""
    out = np.zeros((len(texts), words.shape[1] + 1))
    for i, text in enumerate(texts):
        n = Counter(tokens(text))
        if n:
            ids, count = np.fromiter(map(bucket.__getitem__, n), dtype=np.int64), np.fromiter(n.values(), dtype=np.float32)
            total = int(count.sum())
            out[i, :-1] = count @ words[ids] / total
            out[i, -1] = np.log1p(total)
    return out


def train(pooled: np.ndarray, label: np.ndarray, apart: np.ndarray, context: np.ndarray, epochs: int = 40) -> Model:
    """Network fitted by Adam on the rows not ``apart``; temperature on those apart. Seeded, so reruns agree."""
    draw = np.random.Generator(np.random.PCG64(7))
    x, y = pooled[~apart], label[~apart].astype(float)
    rate = (label.sum() + 1) / (len(label) + 2)
    flat = np.log(rate / (1 - rate))
    d = 2 * DIM + 1
    if len(x) < 10 or len(np.unique(y)) < 2:
        return Model(context, np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), flat, 1.0)
    m = Model(context, x.mean(axis=0), x.std(axis=0) + 1e-3, draw.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), flat, 1.0)
    x = (x - m.mean) / m.scale
    p = [m.w1, m.b1, m.w2, np.array([m.b2])]
    first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for s in range(0, len(x), 256):
            xb, yb = x[order[s : s + 256]], y[order[s : s + 256]]
            h = np.tanh(xb @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - yb) / len(xb)
            gh = np.outer(g, p[2]) * (1 - h * h)
            t += 1
            for k, grad in enumerate((xb.T @ gh + 1e-3 * p[0], gh.sum(axis=0), h.T @ g + 1e-3 * p[2], np.array([g.sum()]))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = p[k] - 0.003 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])
    if apart.sum() >= 20:
        z, yv = m.logits(pooled[apart]), label[apart]
        heat = np.exp(np.linspace(np.log(0.25), np.log(8), 64))
        m.temperature = float(min(heat, key=lambda c: np.logaddexp(0, np.where(yv > 0, -z, z) / c).mean()))
    return m


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 12_000) -> Model:
    """Model from the labelled documents; ``labels`` holds only rows that may be learned from.

    ``sample_rows`` bounds what is fitted on. Texts stay on the executors: the driver gets the sample's ids, whole-number context
    sums (BUCKETS rows) and pooled vectors (sample_rows rows).
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = known.withColumn("o", F.xxhash64("k")).orderBy("o", "k").limit(sample_rows).select("k", "y").collect()
    sample = spark.createDataFrame(chosen, known.schema)
    learn = cut(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(sample), "k").dropDuplicates(["k"]))

    def context_rows(batches):
        total = np.zeros((BUCKETS, DIM), dtype=np.int64)
        for batch in batches:
            total += contexts(list(batch["text"]))
        used = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"bucket": used, "v": pd.Series(list(total[used]), dtype=object)})

    sums = learn.select("text").mapInPandas(context_rows, "bucket long, v array<long>").groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)])
    got = sums.toArrow()
    context = np.zeros((BUCKETS, DIM), dtype=np.int64)
    context[got.column("bucket").to_numpy()] = np.column_stack([got.column(f"v{i}").to_numpy() for i in range(DIM)]) if len(got) else 0
    shared = spark.sparkContext.broadcast(sent := unit(context))

    def pooled_rows(batches):
        bucket = Buckets()
        for batch in batches:
            x = pool(list(batch["text"]), word_vectors(shared.value), bucket).astype(np.float32)
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"], "x": pd.Series([r.tobytes() for r in x], dtype=object)})

    rows = learn.mapInPandas(pooled_rows, f"k {learn.schema['k'].dataType.simpleString()}, y int, x binary").orderBy("k").toArrow()
    shared.unpersist()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype=np.float32).reshape(-1, 2 * DIM + 1).astype(np.float64)
    apart = np.array([zlib.crc32(b"apart %s" % str(k).encode()) % 5 == 0 for k in rows.column("k").to_pylist()], dtype=bool)
    return train(x, np.array(rows.column("y").to_pylist(), dtype=int), apart, sent)


def score(model: Model, docs: DataFrame, text_col: str = "text") -> Column:
    """Calibrated probability of label 1, of a whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series(m.score(pool(list(texts), word_vectors(m.context), _BUCKETS)) if len(texts) else [], dtype="float64")

    return of(F.col(text_col))


_BUCKETS = Buckets()
