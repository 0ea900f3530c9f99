"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model (two words) over lower-cased words and an end token, learned from the training rows, without pruning:
``p(w | h) = (c(hw) + MASS p(w)) / (c(h) + MASS)`` over ``p(w) = (c(w) + ADD) / (N + ADD (V + 1))``. As an automaton, the start and
every word seen in training is a state; it has an arc for each word that followed it, weighing ``log10 p(w | h)``, and a failure arc to the
root, weighing ``log10 (MASS / (c(h) + MASS))``, where every word has an arc weighing ``log10 p(w)``. A text is scored by one
traversal from left to right that carries the state and adds up weights.

The model is as large as the corpus, so no task holds it. Documents are dealt to bundles of about ``BUNDLE_CHARS`` by a hash. A
bundle asks for its distinct n-grams, one row for each range of hashes, with its own training counts; a range (whose number
grows with the input) adds up the counts and answers each bundle in the order asked; the bundle then builds the part of the automaton
that its own documents can reach, and traverses it. A frequent n-gram is asked for once by a bundle, so no range is hot.

Words are identified by XXH64 and word pairs by a mix of two of them.

Edge cases: a null or empty text is the end token alone. A row with a null id is a training row. Repeated rows each get a row and
count each. An empty table gives no rows; with no training rows every token has the probability 1 of an empty model. Only the id
and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import blob, small_batches

ADD, MASS = 0.1, 4.0
#: Code points of a bundle's texts, and of the texts whose n-grams a range of hashes holds.
BUNDLE_CHARS, RANGE_CHARS = 4_000_000, 8_000_000
END = b" end"  # no word holds a space
_START = np.uint64(0xA5A5_5A5A_C3C3_3C3C)


def words(text: str | None) -> list[bytes]:
    """Tokens of a text: its words, A-Z lower-cased, and the end."""
    return [*blob(text).lower().split(), END]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the range, of ``ranges`` equal ones, that a hash lies in."""
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def squeeze(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte by byte: the upper bytes of all are zeros side by side, which the shuffle compresses."""
    return np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def expand(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel().cumsum(dtype=np.uint64)


class Bundle:
    """Tokens and distinct n-grams of some documents. Nothing in it depends on the order of the documents but ``docs``."""

    def __init__(self, texts, learn, ranges: int) -> None:
        ids: dict[bytes, int] = {}
        self.docs = [np.array([ids.setdefault(w, len(ids)) for w in words(t)], dtype=np.int64) for t in texts]
        self.size = len(ids)  # the start's number as a state
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), dtype=np.uint64, count=len(ids))
        with_start = np.append(own, _START)
        now = np.concatenate(self.docs)
        before = np.concatenate([np.r_[self.size, d[:-1]] for d in self.docs])
        counts = np.repeat(np.asarray(learn, dtype=np.int64), [len(d) for d in self.docs])
        self.pairs, place = np.unique(before * (self.size + 1) + now, return_inverse=True)
        seen = np.r_[np.bincount(now, counts, self.size), np.bincount(place, counts, len(self.pairs))].astype(np.int64)
        h = np.r_[own, _mix(with_start[self.pairs // (self.size + 1)], own[self.pairs % (self.size + 1)])]
        single = np.r_[np.ones(self.size, dtype=bool), np.zeros(len(self.pairs), dtype=bool)]
        at = _range(h, ranges)
        self.order = np.lexsort((single, h))
        self.hashes, self.seen, self.ranges = h[self.order], seen[self.order], at[self.order]

    def asked(self):
        """(range, hashes, counts) of each range that the bundle has n-grams in."""
        cut = np.flatnonzero(np.diff(self.ranges)) + 1
        for s, e in zip(np.r_[0, cut], np.r_[cut, len(self.ranges)], strict=True):
            yield int(self.ranges[s]), self.hashes[s:e], self.seen[s:e]

    def totals(self, answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Counts over all training documents of the bundle's words and pairs, from each range's answer."""
        out = np.zeros(len(self.order), dtype=np.int64)
        out[self.order] = np.concatenate([answers[r] for r, _, _ in self.asked()])
        return out[: self.size], out[self.size :]


def pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, those of 255 or more apart."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.int64).tobytes()


def unpack(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, dtype=np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, dtype=np.int64)
    return out


class Automaton:
    """States with arcs (by state and word) and failure arcs to the root."""

    def __init__(self, bundle: Bundle, count: np.ndarray, pairs: np.ndarray, n: int, v: int, starts: int) -> None:
        p = (count + ADD) / (n + ADD * (v + 1))
        before, now = np.divmod(bundle.pairs, bundle.size + 1)
        state = np.append(count, starts)
        self.root = np.log10(p).tolist()
        self.failure = np.log10(MASS / (state + MASS)).tolist()
        known = np.flatnonzero(pairs > 0)
        weight = np.log10((pairs[known] + MASS * p[now[known]]) / (state[before[known]] + MASS))
        self.arcs = dict(zip(bundle.pairs[known].tolist(), weight.tolist(), strict=True))
        self.start, self.width = bundle.size, bundle.size + 1

    def score(self, tokens: list[int]) -> float:
        """log10 probability of a text: one traversal."""
        state, total, arcs, width = self.start, 0.0, self.arcs.get, self.width
        root, failure = self.root, self.failure
        for w in tokens:
            weight = arcs(state * width + w)
            total += failure[state] + root[w] if weight is None else weight
            state = w
        return total


def vocabulary(docs: DataFrame, ranges: int) -> DataFrame:
    """One row (n, v, starts): training tokens, distinct ones, training documents. ``docs`` has t and learn."""

    def distinct(batches):
        held: set[bytes] = set()
        n = texts = chars = 0

        def rows():
            h = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, held), dtype=np.uint64, count=len(held)))
            at = _range(h, ranges)
            cut = np.flatnonzero(np.diff(at)) + 1
            parts = [] if not len(h) else [(int(at[s]), squeeze(h[s:e]), 0, 0) for s, e in zip(np.r_[0, cut], np.r_[cut, len(h)], strict=True)]
            return pd.DataFrame([*parts, (0, b"", n, texts)], columns=["r", "h", "n", "texts"])

        for batch in batches:
            for t in batch["t"]:
                w = words(t)
                held.update(w)
                n, texts, chars = n + len(w), texts + 1, chars + len(t or "")
                if chars > BUNDLE_CHARS:
                    yield rows()
                    held.clear()
                    n = texts = chars = 0
        yield rows()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        v = len(np.unique(np.concatenate([expand(h) for h in rows["h"]])))
        return pd.DataFrame({"n": [int(rows["n"].sum())], "v": [v], "texts": [int(rows["texts"].sum())]})

    parts = docs.where("learn").select("t").mapInPandas(distinct, "r long, h binary, n long, texts long")
    whole = parts.groupBy("r").applyInPandas(merged, "n long, v long, texts long")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return whole.agg(zero("n").alias("n"), zero("v").alias("v"), zero("texts").alias("starts"))


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    chars = given.agg(F.sum(F.length("t"))).first()[0] or 0
    bundles, ranges = max(1, -(-chars // BUNDLE_CHARS)), max(1, -(-chars // RANGE_CHARS))
    n, v, starts = vocabulary(given.select("t", (~F.col("held_out")).alias("learn")), ranges).first()
    dealt = given.withColumn("bundle", F.pmod(F.xxhash64("id", "t"), F.lit(bundles)))

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        b = Bundle(rows["t"], ~rows["held_out"].to_numpy(dtype=bool), ranges)
        out = [(int(rows["bundle"].iloc[0]), r, squeeze(h), *pack(c)) for r, h, c in b.asked()]
        return pd.DataFrame(out, columns=["bundle", "r", "h", "small", "large"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = [expand(h) for h in rows["h"]]
        counts = [unpack(s, x) for s, x in zip(rows["small"], rows["large"], strict=True)]
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts)).astype(np.int64)[place]
        parts = [pack(x) for x in np.split(total, np.cumsum([len(h) for h in hashes])[:-1])]
        return pd.DataFrame({"bundle": rows["bundle"], "r": rows["r"], "small": [p[0] for p in parts], "large": [p[1] for p in parts]})

    def traverse(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = Bundle(rows["t"], ~rows["held_out"].to_numpy(dtype=bool), ranges)
        count, pairs = b.totals({r: unpack(s, x) for r, s, x in zip(answers["r"], answers["small"], answers["large"], strict=True)})
        automaton = Automaton(b, count, pairs, n, v, starts)
        base, known = np.array(automaton.root), count > 0
        return pd.DataFrame(
            {
                "id": rows["id"],
                "held_out": rows["held_out"],
                "n_tokens": [len(d) for d in b.docs],
                "n_known": [int(known[d].sum()) for d in b.docs],
                "train_tokens": n,
                "base_score": [float(base[d].sum()) for d in b.docs],
                "score": [automaton.score(d.tolist()) for d in b.docs],
            }
        )

    asked = dealt.groupBy("bundle").applyInPandas(ask, "bundle long, r long, h binary, small binary, large binary")
    answered = asked.groupBy("r").applyInPandas(answer, "bundle long, r long, small binary, large binary")
    id_type = given.schema["id"].dataType.simpleString()
    return dealt.groupBy("bundle").cogroup(answered.groupBy("bundle")).applyInPandas(
        traverse, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
