"""Quality rules with line labelling: a linear-chain conditional random field marks each line as content or boilerplate.

Each line (split at line feeds, lines without a word left out) gets a vector of ``FEATURES``. The field's score of a labelling is the
sum of each line's label weights times its features and of a weight for each pair of neighbouring labels; Viterbi decoding finds the
best labelling. A document is kept by the field if content lines hold at least ``min_share`` of its words.

The weights are fitted here, by gradient ascent on the conditional likelihood, with distant labels: every line of a labelled document
has the document's quality label. The fit uses a bounded sample: the ``sample_rows`` labelled documents with the smallest hashes
of their ids, those of at most ``sample_lines`` lines. All documents are decoded, whole.

Edge cases: a null or empty text has no words and no lines, share 0, and fails the base rule. Rows with null ids or labels are
not learned from. Without labels, or with one class, ``DEFAULT`` weights decide. Repeated rows each get a row. An empty table
gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import blob, cut, small_batches

FEATURES = ("bias", "log_words", "short", "word_length", "capitals", "symbols", "digits", "marks", "bars", "ends", "repeats", "again", "first", "last")
SYMBOLS = b"#*$%&|<>"
_UPPER, _LETTER, _DIGIT, _MARK, _SPACE, _SYMBOL, _TAIL = (np.zeros(256, dtype=bool) for _ in range(7))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = _DIGIT[48:58] = _SPACE[32] = _SPACE[9:14] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_SYMBOL[list(SYMBOLS)] = True
_TAIL[128:192] = True  # bytes inside a code point


@dataclass
class Field:
    """Label weights (2 x features) and transition weights (2 x 2); label 1 is content."""

    labels: np.ndarray
    steps: np.ndarray


#: Used where nothing can be fitted: long lines of plain words that end in a mark are content; capitals, symbols, bars and repeats aren't.
DEFAULT = Field(np.vstack([np.zeros(14), np.array([0.5, 0.6, -0.5, 0, -4, -8, -2, -1, -6, 0.5, -4, -2, 0, 0.0])]), np.array([[1.0, 0.0], [0.0, 1.0]]))


def base_counts(text: str | None, b: bytes) -> tuple[int, int, int]:
    """word_chars, n_symbols and n_dup_lines of a text and its bytes."""
    chars = len(text or "") - (len(b) - len(b.translate(None, b" \t\n\r\x0b\x0c")))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    return chars, symbols, len(lines) - len(set(lines))


def _repeated(words: list[bytes]) -> np.ndarray:
    """Which words lie in a window of three words that occurs twice or more."""
    out = np.zeros(len(words), dtype=bool)
    if len(words) < 4:
        return out
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) > 1_000_000:  # keep the product of three within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    out[:-2] |= twice
    out[1:-1] |= twice
    out[2:] |= twice
    return out


def line_features(b: bytes, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x FEATURES) and word counts of the lines that have a word. ``repeated``: see ``_repeated``."""
    a = np.frombuffer(b + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(a == 10)
    starts = np.r_[0, ends[:-1] + 1]
    space = _SPACE[a]
    word_start = ~space & np.r_[True, space[:-1]]
    per = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    n = per(word_start)
    keep = n > 0
    if not keep.any():
        return np.zeros((0, len(FEATURES))), np.zeros(0, dtype=np.int64)
    first_word = (np.cumsum(n) - n)[keep]
    n = n[keep]
    full = lambda mask: per(mask)[keep]
    solid = np.maximum(full(~space & ~_TAIL[a]), 1)
    letters = np.maximum(full(_LETTER[a] & ~_TAIL[a]), 1)
    rep = np.r_[0, np.cumsum(repeated)]
    lines = b.split(b"\n")
    seen: set[bytes] = set()
    again, closing = np.zeros(len(n)), np.zeros(len(n))
    for i, k in enumerate(np.flatnonzero(keep)):
        line = lines[k]
        again[i] = line in seen
        seen.add(line)
        closing[i] = line.rstrip()[-1:] in (b".", b"!", b"?", b":")
    x = np.zeros((len(n), len(FEATURES)))
    x[:, 0] = 1
    x[:, 1] = np.log1p(n) / 3
    x[:, 2] = n < 5
    x[:, 3] = np.minimum(solid / n, 20) / 5
    x[:, 4] = full(_UPPER[a]) / letters
    x[:, 5] = full(_SYMBOL[a]) / solid
    x[:, 6] = full(_DIGIT[a]) / solid
    x[:, 7] = full(_MARK[a]) / solid
    x[:, 8] = np.minimum(full(a == 124) / n, 1)
    x[:, 9] = closing
    x[:, 10] = (rep[first_word + n] - rep[first_word]) / n
    x[:, 11] = again
    x[0, 12] = 1
    x[-1, 13] = 1
    return x, n


def viterbi(field: Field, x: np.ndarray) -> np.ndarray:
    """Best labelling of a document's lines; ties go to content."""
    u = x @ field.labels.T
    best, back = u[0].copy() if len(u) else None, np.zeros((len(u), 2), dtype=np.int8)
    s = field.steps
    for t in range(1, len(u)):
        from0, from1 = best[0] + s[0], best[1] + s[1]
        back[t] = from1 >= from0
        best = np.maximum(from0, from1) + u[t]
    out = np.zeros(len(u), dtype=np.int8)
    if len(u):
        out[-1] = best[1] >= best[0]
        for t in range(len(u) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
    return out


def gradient(field: Field, xs: list[np.ndarray], ys: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of constant labellings ``ys`` and its gradient, by forward and backward sums over padded documents."""
    longest, k = max(len(x) for x in xs), len(xs)
    lengths = np.array([len(x) for x in xs])
    x = np.zeros((k, longest, len(FEATURES)))
    for i, v in enumerate(xs):
        x[i, : len(v)] = v
    u = x @ field.labels.T
    alpha, beta = np.zeros((k, longest, 2)), np.zeros((k, longest, 2))
    alpha[:, 0] = u[:, 0]
    for t in range(1, longest):
        alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + field.steps, axis=1) + u[:, t]
    for t in range(longest - 2, -1, -1):
        inner = np.logaddexp.reduce(field.steps + (u[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where((t < lengths - 1)[:, None], inner, 0)
    z = np.logaddexp.reduce(alpha[np.arange(k), lengths - 1], axis=1)
    live = (np.arange(longest) < lengths[:, None])[..., None]
    p = np.exp(np.clip(alpha + beta - z[:, None, None], -60, 0)) * live
    true = np.eye(2)[ys][:, None, :] * live
    g_labels = np.einsum("ktl,ktf->lf", true - p, x)
    pair = np.exp(np.clip(alpha[:, :-1, :, None] + field.steps + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], -60, 0)) * live[:, 1:, :, None]
    g_steps = -pair.sum(axis=(0, 1))
    np.add.at(g_steps, (ys, ys), lengths - 1)
    score = u[np.arange(k), :, ys] * live[..., 0]
    return float(score.sum() + (field.steps[ys, ys] * (lengths - 1)).sum() - z.sum()), g_labels, g_steps


def train(xs: list[np.ndarray], ys: np.ndarray, rounds: int = 60) -> Field:
    """Field fitted by Adam over groups of documents of like length. Seeded, so reruns agree."""
    if len(xs) < 20 or len(np.unique(ys)) < 2:
        return DEFAULT
    by_length = sorted(range(len(xs)), key=lambda i: len(xs[i]))
    groups = [by_length[i : i + 256] for i in range(0, len(xs), 256)]
    p = [np.zeros((2, len(FEATURES))), np.zeros((2, 2))]
    first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    draw = np.random.Generator(np.random.PCG64(11))
    for _ in range(rounds):
        for g in draw.permutation(len(groups)):
            _, gl, gs = gradient(Field(*p), [xs[i] for i in groups[g]], ys[groups[g]])
            n = sum(len(xs[i]) for i in groups[g])
            t += 1
            for k, grad in enumerate((gl / n - 1e-3 * p[0], gs / n - 1e-3 * p[1])):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = p[k] + 0.03 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Field(*p)


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", sample_rows: int = 4_000, sample_lines: int = 200) -> Field:
    """Field from the labelled documents. The driver gets features of at most sample_rows x sample_lines lines, never texts."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = known.withColumn("o", F.xxhash64("k")).orderBy("o", "k").limit(sample_rows).select("k", "y").collect()
    sample = spark.createDataFrame(chosen, known.schema)
    learn = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(sample), "k").dropDuplicates(["k"])

    def rows(batches):
        for batch in batches:
            found = [line_features(b := blob(t), _repeated(b.split()))[0] for t in batch["text"]]
            fits = [0 < len(x) <= sample_lines for x in found]
            x = pd.Series([x.ravel() for x, ok in zip(found, fits, strict=True) if ok], dtype=object)
            yield pd.DataFrame({"k": batch["k"][fits].reset_index(drop=True), "y": batch["y"][fits].reset_index(drop=True), "x": x})

    got = cut(learn.mapInPandas(rows, f"k {learn.schema['k'].dataType.simpleString()}, y int, x array<double>")).orderBy("k").collect()
    return train([np.array(r["x"]).reshape(-1, len(FEATURES)) for r in got], np.array([r["y"] for r in got], dtype=int))


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double, labels string"


def judge(field: Field, docs: DataFrame, text_col: str = "text", min_share: float = 0.5) -> Column:
    """Struct with the base counts and the field's verdict; ``labels`` has a letter for each line with a word: C (content) or B."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf(_RESULT)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_judged(shared.value, t, min_share) for t in texts], columns=[x.split()[0] for x in _RESULT.split(", ")])

    return of(F.col(text_col))


def _judged(field: Field, text: str | None, min_share: float) -> tuple:
    b = blob(text)
    words = b.split()
    repeated = _repeated(words)
    chars, symbols, dup = base_counts(text, b)
    n, rep = len(words), int(repeated.sum())
    x, in_line = line_features(b, repeated)
    y = viterbi(field, x)
    share = float(in_line[y == 1].sum() / n) if n else 0.0
    failed = n < 50 or 100 * rep > 50 * n
    return n, chars, symbols, dup, rep, failed, not failed and share >= min_share, len(y), int(y.sum()), share, "".join("BC"[v] for v in y)
