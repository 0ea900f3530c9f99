"""Grouping of spelling variants by Bloom-guided neighbourhoods.

1. ``vocabulary``: words of all texts with their number, merged in the tasks before the shuffle.
2. ``filters``: blocked Bloom filters over the vocabulary, one shard a word length, made by an aggregation of 64-bit blocks. A shard that
   is larger than ``FILTER_BYTES`` is divided into slices by the words' hashes; shards and slices are packed into rounds of at most that size,
   so that what is broadcast is bounded however large the vocabulary grows.
3. ``neighbours``: every word's edits (all deletions, and replacements by larger signs; the other way round is found from the other word)
   are made as hashes by prefix sums, probed against the shard of their length, and only positives are spelt out, shuffled and joined
   with the vocabulary, which removes the filter's false positives. Nothing depends on the filter but the number of rows shuffled.
4. ``variants``: each word's form and root; roots by doubling the links.

Edge cases: a null or empty text has no words. Repeated rows count each. An empty table gives no rows. Of two near words of equal number the
smaller in code-point order is the form. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import cut, small_batches, written

#: Largest round of filters, in bytes, and bits a word.
FILTER_BYTES, BITS = 32 << 20, 20
#: Blocks that are sent to the driver as one row.
CHUNK = 1 << 13
#: Distinct words that a task holds at once.
KNOWN = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_UPPER = {c: c + 32 for c in range(65, 91)}


def runs(text: str | None, least: int) -> Counter:
    """Maximal runs of letters of ``least`` code points or more, A-Z lower-cased, with their number."""
    out: Counter = Counter()
    if text:
        for w, n in Counter(re.findall(f"[A-Za-zÀ-ÿ]{{{least},}}", text)).items():
            out[w.lower() if w.isascii() else w.translate(_UPPER)] += n
    return out


def misspelt(start: int, run: str, every: int) -> str:
    """``run``, without one of its signs where ``every`` divides the CRC-32 of the text's id and the run (``start``: that of ``<id>:``)."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_len: int = 5, least_n: int = 3, misspell: int | None = None) -> DataFrame:
    """(word, n): words of at least ``least_len`` code points that occur at least ``least_n`` times in all texts.

    With ``misspell`` one in so many (text, run) loses a sign first, by a hash; a null id reads as ``null`` there.
    """

    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, t in zip(batch["id"], batch["t"], strict=True):
                found = runs(t, least_len)
                if misspell:
                    start = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                    for w, n in found.items():
                        held[misspelt(start, w, misspell)] += n
                else:
                    held.update(found)
                if len(held) > KNOWN:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    found = rows.mapInPandas(counted, "word string, n long").where(F.length("word") >= least_len)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# Hashes: that of a word is the sum of its signs times powers of BASE, so that an edit's hash needs no spelling.


def _mixed(h: np.ndarray) -> np.ndarray:
    x = h ^ (h >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _signs(some: list[str]) -> np.ndarray:
    """Code points of words of one length: words x places."""
    return np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(some), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    """BASE to n - 1, ..., 1, 0."""
    return np.array([pow(int(BASE), i, 1 << 64) for i in range(n - 1, -1, -1)], dtype=np.uint64)


def hashes(signs: np.ndarray) -> np.ndarray:
    return (signs * _powers(signs.shape[1])).sum(axis=1, dtype=np.uint64)


def deletions(signs: np.ndarray) -> np.ndarray:
    """Hash of each word without each of its signs: words x places."""
    n = signs.shape[1]
    p = _powers(n)
    after = signs * p
    tail = after[:, ::-1].cumsum(axis=1, dtype=np.uint64)[:, ::-1] - after
    before = (signs[:, :-1] * p[1:]).cumsum(axis=1, dtype=np.uint64)
    return tail + np.hstack([np.zeros((len(signs), 1), dtype=np.uint64), before])


def place(h: np.ndarray, blocks: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, block and the three bits in its 64 of each hash."""
    x = _mixed(h)
    part = (x >> np.uint64(48)) % np.uint64(slices)
    block = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(blocks)) >> np.uint64(32)
    y = _mixed(x + BASE)
    one = np.uint64(1)
    bits = (one << (y & np.uint64(63))) | (one << ((y >> np.uint64(6)) & np.uint64(63))) | (one << ((y >> np.uint64(12)) & np.uint64(63)))
    return part.astype(np.int64), block.astype(np.int64), bits


def layout(sizes: dict[int, int], limit: int = FILTER_BYTES) -> list[dict[tuple[int, int], tuple[int, int, int]]]:
    """Rounds of shards: (length, slice) to (first block, blocks, slices of that length). A round's blocks take ``limit`` bytes at most."""
    out: list[dict] = []
    used = limit
    for length, n in sorted(sizes.items()):
        blocks = max(1, -(-n * BITS // 64))
        slices = -(-blocks * 8 // limit)
        each = -(-blocks // slices)
        for s in range(slices):
            if used + each * 8 > limit:
                out.append({})
                used = 0
            out[-1][(length, s)] = (used // 8, each, slices)
            used += each * 8
    return out


def grouped(some: list[str]):
    """Places of the words of each length."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(some):
        groups.setdefault(len(w), []).append(i)
    return groups.items()


def filters(words: DataFrame, shards: dict) -> np.ndarray:
    """The blocks of a round's shards. The driver gets as many bytes as the round has."""

    def marked(batches):
        for b in batches:
            some = b["word"].tolist()
            for n, g in grouped(some):
                slices = next((v[2] for k, v in shards.items() if k[0] == n), 0)
                if not slices:
                    continue
                for (length, s), (first, blocks, _) in shards.items():
                    if length == n:
                        part, block, bits = place(hashes(_signs([some[i] for i in g])), blocks, slices)
                        yield pd.DataFrame({"block": first + block[part == s], "bits": bits[part == s].view(np.int64)})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(CHUNK, dtype=np.int64)
        out[rows["block"].to_numpy() % CHUNK] = rows["bits"].to_numpy()
        return pd.DataFrame({"chunk": [int(rows["block"].iloc[0]) // CHUNK], "bits": [out.tobytes()]})

    blocks = words.select("word").mapInPandas(marked, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    chunks = blocks.withColumn("chunk", F.floor(F.col("block") / CHUNK)).groupBy("chunk").applyInPandas(lambda r: packed(r), "chunk long, bits binary")
    total = max(first + n for first, n, _ in shards.values())
    out = np.zeros(-(-total // CHUNK) * CHUNK, dtype=np.uint64)
    for r in chunks.toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["bits"], dtype=np.uint64)
    return out


class Probe:
    """Edits of words that a round's filters may hold."""

    def __init__(self, shards: dict, blocks: np.ndarray, alphabet: list[int]) -> None:
        self.shards, self.blocks = shards, blocks
        self.alphabet = np.array(sorted(alphabet), dtype=np.uint64)

    def held(self, length: int, h: np.ndarray) -> np.ndarray:
        """Whether each hash of a word of ``length`` may be in the vocabulary."""
        out = np.zeros(h.shape, dtype=bool)
        for (n, s), (first, size, slices) in self.shards.items():
            if n == length:
                part, block, bits = place(h, size, slices)
                out |= (part == s) & ((self.blocks[first + block] & bits) == bits)
        return out

    def edits(self, some: list[str], at_once: int = 2000):
        """(word's place, edited word): positives among the deletions and the replacements by larger signs."""
        for n, g in grouped(some):
            for s in range(0, len(g), at_once):
                here = g[s : s + at_once]
                signs = _signs([some[i] for i in here])
                if any(k[0] == n - 1 for k in self.shards):
                    # Of a run of equal signs only the first one's deletion is tried: the others give the same word.
                    first = np.hstack([np.ones((len(here), 1), dtype=bool), signs[:, 1:] != signs[:, :-1]])
                    w, at = np.nonzero(self.held(n - 1, deletions(signs)) & first)
                    for i, p in zip(w.tolist(), at.tolist(), strict=True):
                        word = some[here[i]]
                        yield here[i], word[:p] + word[p + 1 :]
                if any(k[0] == n for k in self.shards):
                    whole, powers = hashes(signs), _powers(n)
                    for p in range(n):
                        own = signs[:, p]
                        w, a = np.nonzero(self.alphabet[None, :] > own[:, None])
                        h = whole[w] + (self.alphabet[a] - own[w]) * powers[p]
                        hit = np.flatnonzero(self.held(n, h))
                        for i, c in zip(w[hit].tolist(), a[hit].tolist(), strict=True):
                            word = some[here[i]]
                            yield here[i], word[:p] + chr(int(self.alphabet[c])) + word[p + 1 :]


def neighbours(words: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n) in both directions, for all words that differ by one inserted, deleted or replaced sign. ``words`` is unique."""
    spark = words.sparkSession
    sizes = {r["k"]: r["n"] for r in words.groupBy(F.length("word").alias("k")).agg(F.count("*").alias("n")).collect()}  # one row a length
    points = words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().collect()  # one row a sign
    alphabet = [ord(r["c"]) for r in points]
    found = None
    for shards in layout(sizes, limit):
        held = spark.sparkContext.broadcast(Probe(shards, filters(words, shards), alphabet))

        def probed(batches, held=held):
            for b in batches:
                some = b["word"].tolist()
                hits = list(held.value.edits(some))
                if hits:
                    yield pd.DataFrame({"word": [some[i] for i, _ in hits], "n": b["n"].to_numpy()[[i for i, _ in hits]], "near": [e for _, e in hits]})

        some = words.mapInPandas(probed, "word string, n long, near string")
        found = some if found is None else found.unionAll(some)
    if found is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    pairs = cut(found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n"))
    return pairs.unionAll(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by doubling. ``links`` (word, form) has a row for each word with a form.

    Numbers grow at least twofold along a chain, so chains are short and there is no ring. One number a round reaches the driver.
    """
    at = cut(links.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not further.where("moved").limit(1).count():
            return at
        at = further.drop("moved")


def variants(words: DataFrame, *, factor: int = 2, limit: int = FILTER_BYTES) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root), one for each of ``words`` (word, n).

    ``form`` is the near word of largest number, if that is at least ``factor`` times the word's own.
    """
    words = written(words)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = neighbours(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    fits = -F.col("b.minus") >= factor * F.col("n")
    known = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("b.form")).alias("form"), F.when(fits, -F.col("b.minus")).alias("form_n")))
    ends = roots(known.where("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
