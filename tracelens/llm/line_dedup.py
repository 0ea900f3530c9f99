"""Line dedup by content-defined chunks of lines.

A document's lines are hashed; a rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is divisible by
``divisor``, once the chunk has two lines. A boundary depends only on the lines beside it, so that inserting or deleting lines moves
no boundary further on. A line of ``long_line`` words or more is a chunk of its own, as a passage in one line repeats as much as one
in several. Chunks of two lines with words or more, and long lines, that occur more than once in the whole table (other documents or the same
one) are removed but for the first occurrence, by (id, hash of the text, place).

With ``passages`` the units are not chunks but pairs of lines with words that follow each other (blank lines between them aside) and
long lines, so that a passage's units depend on its own lines alone: of a passage of two lines or more that occurred before, every
line goes, whatever stands around it. The first occurrence of every line in a unit stays.

Equal hashes only nominate: the bytes of all nominated chunks are compared (smallest and largest text of each hash, merged before
the shuffle), and chunks whose hashes collide are told apart by their bytes.

Edge cases: a null text stays null and an empty one empty, with nothing removed. Null ids come last in the order of occurrences.
Rows equal in id and text count as one document: all keep the same chunks. A text of one short line is never touched. An empty
table gives no rows. All columns are kept; a column named like a result gives way to it.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import blob, cut, over, small_batches, written

WINDOW, BASE, WHOLE = 2, 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunks(text: str | None, divisor: int = 2, long_line: int = 50) -> list[tuple[int, int, bool]]:
    """Chunks of a text as (first line, line after the last, may be removed)."""
    lines = blob(text).split(b"\n")
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    words = [len(x.split()) for x in lines]
    out, start, rolling = [], 0, 0
    oldest = pow(BASE, WINDOW, 1 << 64)

    def close(end: int) -> None:
        nonlocal start
        if end > start:
            out.append((start, end, sum(w > 0 for w in words[start:end]) >= 2 or max(words[start:end]) >= long_line))
            start = end

    for i, h in enumerate(hashes):
        rolling = (rolling * BASE + h - (hashes[i - WINDOW] * oldest if i >= WINDOW else 0)) & WHOLE
        if words[i] >= long_line:
            close(i)
            close(i + 1)
        elif i - start >= 1 and (rolling >> 17) % divisor == 0:
            close(i + 1)
    close(len(lines))
    return out


def pairs(text: str | None, long_line: int = 50) -> list[tuple[int, int, int, bytes]]:
    """Units of a text as (place, first line, line after the last, bytes): neighbouring lines with words at even places, long lines at odd ones."""
    lines = blob(text).split(b"\n")
    worded = [(i, n) for i, n in enumerate(len(x.split()) for x in lines) if n]
    out = []
    for at, (i, n) in enumerate(worded):
        if at + 1 < len(worded):
            j = worded[at + 1][0]
            out.append((2 * i, i, j + 1, lines[i] + b"\n" + lines[j]))
        if n >= long_line:
            out.append((2 * i + 1, i, i + 1, lines[i]))
    return out


def _of(text: str | None, how: tuple) -> list[tuple[int, int, int, bytes]]:
    """Place, first line, line after the last and bytes of each unit that may be removed."""
    if not text:
        return []
    *sizes, passages = how
    if passages:
        return pairs(text, sizes[1])
    lines = blob(text).split(b"\n")
    return [(i, a, b, b"\n".join(lines[a:b])) for i, (a, b, counts) in enumerate(chunks(text, *sizes)) if counts]


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", divisor: int = 2, long_line: int = 50, passages: bool = False) -> DataFrame:
    """``docs`` with repeated chunks (with ``passages``: runs of lines) cut out of the text, and ``removed_chunks``, ``removed_lines``, ``removed_chars``."""
    small_batches(docs.sparkSession)
    how = (divisor, long_line, passages)
    key = ["no_id", "k_id", "th"]

    @F.pandas_udf("array<struct<place:int,h:long>>")
    def hashed(texts: pd.Series) -> pd.Series:
        sign = lambda x: x - (1 << 64) if x >> 63 else x
        return pd.Series([[(i, sign(xxhash.xxh64_intdigest(x))) for i, _, _, x in _of(t, how)] for t in texts], dtype=object)

    t = F.col(f"row.`{text_col}`")  # the text is held once
    whole = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).isNull().alias("no_id"),
        F.coalesce(F.col(id_col), F.lit(0)).alias("k_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
    )
    found = cut(whole.select(*key, F.explode(hashed(t)).alias("c")).select(*key, "c.place", "c.h"))
    twice = found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(*key, "place")).alias("first")).where("n > 1").drop("n")
    named = found.join(twice, "h").select(*key, F.struct("place", "h", (F.struct(*key, "place") == F.col("first")).alias("stays")).alias("c"))
    per_doc = named.groupBy(*key).agg(F.collect_set("c").alias("cs"))  # a document's own chunks
    joined = written(whole.join(per_doc, key, "left"))

    @F.pandas_udf("array<struct<place:int,h:long,bytes:binary>>")
    def shown(texts: pd.Series, cs: pd.Series) -> pd.Series:
        out = []
        for t, named in zip(texts, cs, strict=True):
            h = {c["place"]: c["h"] for c in named}
            out.append([(i, h[i], x) for i, _, _, x in _of(t, how) if i in h])
        return pd.Series(out, dtype=object)

    texts = joined.where("cs is not null").select(*key, F.explode(shown(t, "cs")).alias("c")).select(*key, "c.*")
    clash = cut(texts.groupBy("h").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a != b").select("h"))
    joined = _told_apart(joined, texts, clash, key) if clash.count() else joined.withColumn("also", F.lit(None).cast("array<int>"))

    @F.pandas_udf("text string, removed_chunks long, removed_lines long, removed_chars long")
    def stripped(texts: pd.Series, cs: pd.Series, also: pd.Series) -> pd.DataFrame:
        out = []
        for t, named, more in zip(texts, cs, also, strict=True):
            keep = set(() if more is None else more)
            gone = {c["place"] for c in named if not c["stays"] and c["place"] not in keep} if named is not None else set()
            if not gone:
                out.append((t, 0, 0, 0))
                continue
            lines, dead, before = t.split("\n"), set(), {}
            for i, a, b, x in _of(t, how):
                if i in gone:
                    # Of lines that are all alike the first two are the first occurrence, which the second pair overlaps.
                    dead.update(range(before[x] if before.get(x, 0) > a else a, b))
                elif passages:
                    before[x] = b
            new = "\n".join(x for i, x in enumerate(lines) if i not in dead)
            runs = sum(i - 1 not in dead for i in dead) if passages else len(gone)
            out.append((new, runs, len(dead), len(t) - len(new)))
        return pd.DataFrame(out, columns=["text", "removed_chunks", "removed_lines", "removed_chars"])

    done = joined.select("row", stripped(t, "cs", "also").alias("s"))
    return over("row", done, {text_col: F.col("s.text"), **{c: F.col(f"s.{c}") for c in ("removed_chunks", "removed_lines", "removed_chars")}})


def _told_apart(joined: DataFrame, texts: DataFrame, clash: DataFrame, key: list[str]) -> DataFrame:
    """``joined`` with ``also``: places that stay as they are the first with their bytes, among chunks whose hashes collide."""
    mixed = texts.join(clash, "h")
    first = mixed.groupBy("h", "bytes").agg(F.min(F.struct(*key, "place")).alias("f")).select(*[f"f.{k}" for k in (*key, "place")])
    return joined.join(first.groupBy(*key).agg(F.collect_set("place").alias("also")), key, "left")
