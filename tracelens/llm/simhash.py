"""SimHash near-duplicates by pivot distance tables.

1. ``fingerprint``: 64-bit SimHash of a whole text's word shingles (XXH64, seed 42).
2. ``pivot_table``: for every distinct fingerprint its Hamming distances to ``PIVOTS`` reference fingerprints, for each 16-bit
   block and in all.
3. ``links``: two fingerprints at most ``bits`` (2) apart differ in at most two of the four blocks, so in two blocks all pivot
   distances agree: candidates come from an equi-join on the pivot distances of two blocks (six keys a fingerprint). A pair whose
   largest coordinate difference exceeds ``bits`` is discarded, as no coordinate can differ by more than the distance itself;
   survivors are verified by the Hamming distance. A pair is given once, under its first agreeing key.
4. ``near_duplicates``: exact copies are collapsed before the join, links are merged by star contraction.

Edge cases: a null or empty text has fingerprint 0 and is linked like any other. Null ids never become a component's id unless all
its ids are null. Repeated rows each get a row. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import blob, components, cut, small_batches

N_PIVOTS, BLOCKS, WIDTH = 16, 4, 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Reference fingerprints: fixed pseudo-random ones, independent of the data.
PIVOTS = [_signed(xxhash.xxh64_intdigest(f"pivot {i}", seed=7)) for i in range(N_PIVOTS)]
MASKS = [_signed(((1 << WIDTH) - 1) << (WIDTH * j)) for j in range(BLOCKS)]
#: Pairs of blocks in which two fingerprints may agree.
KEYS = [(i, j) for i in range(BLOCKS) for j in range(i)]


def simhash(text: bytes, words: int = 3) -> int:
    """Fingerprint of a text, as an unsigned number."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), dtype="<u8", count=max(1, len(w) - words + 1))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text_col: str, words: int = 3) -> Column:
    """Fingerprint column (long, the bits of the unsigned value)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(simhash(blob(t), words)) for t in texts], dtype="int64")

    return of(F.col(text_col))


def pivot_table(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` with ``d0``, ``d1``: distances to the pivots, eight to a long, and ``k0``..``k3``: each block's distances, hashed to one key."""
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) for p in PIVOTS]
    packed = []
    for half in (far[: N_PIVOTS // 2], far[N_PIVOTS // 2 :]):
        total = F.lit(0).cast("long")
        for i, d in enumerate(half):
            total = total.bitwiseOR(F.shiftleft(d.cast("long"), 8 * i))
        packed.append(total)
    block = [F.xxhash64(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(m))) for p in PIVOTS]) for m in MASKS]
    return prints.select("fp", *[c.alias(f"d{i}") for i, c in enumerate(packed)], *[c.alias(f"k{i}") for i, c in enumerate(block)])


def _coordinate_gap(a: str, b: str) -> Column:
    """Largest difference of two fingerprints' pivot distances."""
    part = lambda side, i: F.shiftright(F.col(f"{side}.d{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255))
    return F.greatest(*[F.abs(part(a, i) - part(b, i)) for i in range(N_PIVOTS)])


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most ``bits`` (0 to 2) apart, each once."""
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2: four blocks leave two that agree for up to two differing bits")
    table = pivot_table(prints)
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), f"k{i}", f"k{j}").alias("key")) for n, (i, j) in enumerate(KEYS)])
    keyed = table.withColumn("at", F.explode(keys)).select("at.key", "at.n", "fp", "d0", "d1", *[f"k{i}" for i in range(BLOCKS)])
    same = [F.col(f"a.k{i}") == F.col(f"b.k{i}") for i in range(BLOCKS)]
    first = F.lit(len(KEYS))
    for n, (i, j) in reversed(list(enumerate(KEYS))):
        first = F.when(same[i] & same[j], F.lit(n)).otherwise(first)
    on = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (_coordinate_gap("a", "b") <= bits)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits)
        & (F.col("a.n") == first)
    )
    return keyed.alias("a").join(keyed.alias("b"), on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """Rows (id, fp, component_id), one for each row of ``docs``; component_id is the smallest id reachable over links."""
    small_batches(docs.sparkSession)
    marked = cut(docs.select(F.col(id_col), fingerprint(text_col, words).alias("fp")))
    return marked.join(classes(marked, id_col, bits), "fp").select(F.col(id_col), "fp", "component_id")


def classes(marked: DataFrame, id_col: str, bits: int = 2) -> DataFrame:
    """Rows (fp, root, component_id), one for each distinct fingerprint; root is the smallest fingerprint of the component."""
    prints = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(prints.select("fp"), bits))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def hex_print(column: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` without the near copies: of each component the row with the smallest id stays (null ids last), one row among equal ids.

    The row that stays is chosen by a hash of its text where ids are equal. Only ids and fingerprints are shuffled: the choice is
    made over (root, id, text hash), as components may share an id, and joined back to the rows by these.
    """
    small_batches(docs.sparkSession)
    marked = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), fingerprint(text_col, words).alias("fp")))
    in_class = marked.join(classes(marked, "id", bits), "fp")
    stays = in_class.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("m"))
    stays = stays.select("m.no_id", F.coalesce("m.id", F.lit(0)).alias("k_id"), "m.th").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.lit(0)).alias("k_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    met = rows.join(stays, ["no_id", "k_id", "th"], "left_semi")
    one = Window.partitionBy("no_id", "k_id", "th").orderBy("k_id")
    return met.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")
