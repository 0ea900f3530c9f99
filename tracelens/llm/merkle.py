"""Merkle manifest of a dataset: a tree over each source's documents in the order of their ids, and a tree over the sources.

1. ``leaves``: the digest of each document's fields, and of the text with A-Z lower-cased where the row is picked for tampering. Rows
   alike in source, id and digests are one row with a number.
2. ``ranked``: leaf coordinates without sorting. A source's ids are a compressed bitmap: 64-bit words of the ids that occur, words without an
   id left out, merged by OR. Words count their bits (the popcount directory) inside a container of ``CONTAINER`` words, and a tree scan
   over the containers gives what lies before each. A leaf's place is its container's and word's offset and the number of bits below
   its own. Words in which an id occurs more than once, or that hold the null ids, count rows instead: by (bit, first digits of the digest).
3. ``levels``: nodes are dealt by place // ``FAN`` and put into a slot array keyed by place % ``FAN``, whose digest is the node above; a level
   has a sixteenth of the rows of the one below.
4. ``manifest``: coming down from the root, every node hands its children the digests beside their path; a leaf's proof and its
   recomputed root follow from them.

H(x) is the lower-case hex SHA-256. No task holds more than a node's children or a word's leaves.

Edge cases: a null field reads ``-``, an empty one ``0:``. Null ids come last in their source, ordered by digest; rows with one id are ordered by
digest, and equal rows take places side by side (each a leaf of its own). A null source is a source, the first. A source with one leaf has
that leaf as its subroot; one source's subroot is the root. A null id is never tampered with. An empty table gives no rows. Only the
columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import cut, written
from tracelens.operators.scan import tree_scan

FAN, FAN_BITS = 16, 4
#: Bits of a word's number inside its container.
CONTAINER = 10
#: The word of null ids: behind all words of ids.
NO_ID = 1 << 57
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Equal rows that one task makes places for.
COPIES = 4096


def framed(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, fields: list[str], tampered: Column, *, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(source, id, leaf, folded, n): the distinct leaves; ``folded`` is the leaf after tampering (the same where ``tampered`` is not true)."""
    leaf = digest(*[framed(F.col(c)) for c in fields])
    changed = digest(*[framed(F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c)) for c in fields])
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), F.when(tampered, changed).alias("changed"))
    rows = rows.withColumn("folded", F.coalesce("changed", "leaf")).drop("changed")
    return rows.groupBy("source", "id", "leaf", "folded").agg(F.count("*").alias("n"))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, the first of the ``n`` places that each row's leaves take in their source."""
    x = rows.withColumn("word", F.coalesce(F.shiftright("id", 6), F.lit(NO_ID))).withColumn("bit", F.col("id").bitwiseAND(F.lit(63)).cast("int"))
    words = x.groupBy("source", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, coalesce(bit, 0))")).alias("bits"), F.count("*").alias("rows"), F.sum("n").alias("leaves"), F.count_if(F.col("bit").isNull()).alias("no_id")
    )
    words = cut(words.withColumn("plain", (F.col("leaves") == F.bit_count("bits")) & (F.col("no_id") == 0)))
    box = F.shiftright("word", CONTAINER)
    inside = Window.partitionBy("source", box).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    boxes = tree_scan(words.groupBy("source", box.alias("box")).agg(F.sum("leaves").alias("leaves")), ["source"], "box", {"before": (F.col("leaves"), "sum")})
    directory = words.withColumn("at", F.coalesce(F.sum("leaves").over(inside), F.lit(0))).alias("w").join(
        boxes.select(F.col("source").alias("s"), F.col("box"), F.coalesce("before", F.lit(0)).alias("base")).alias("b"), F.col("w.source").eqNullSafe(F.col("s")) & (F.shiftright(F.col("w.word"), CONTAINER) == F.col("b.box"))
    )
    directory = directory.select(F.col("source").alias("s"), F.col("word").alias("k"), "bits", "plain", (F.col("at") + F.col("base")).alias("offset"))
    met = x.join(directory, F.col("source").eqNullSafe(F.col("s")) & (F.col("word") == F.col("k"))).drop("s", "k")
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    plain = met.where("plain").select(*rows.columns, (F.col("offset") + below).alias("place"))
    if not words.where("not plain").limit(1).count():
        return plain
    mixed = cut(met.where("not plain").withColumn("key", F.coalesce("bit", F.lit(0)).cast("long") * (1 << 32) + F.conv(F.substring("leaf", 1, 8), 16, 10).cast("long")))
    keys = mixed.groupBy("source", "word", "key").agg(F.sum("n").alias("leaves"))
    keys = tree_scan(keys, ["source", "word"], "key", {"before": (F.col("leaves"), "sum")}).select(F.col("source").alias("s"), F.col("word").alias("k"), F.col("key").alias("kk"), F.coalesce("before", F.lit(0)).alias("before"))
    among = Window.partitionBy("source", "word", "key").orderBy("leaf", "folded").rowsBetween(Window.unboundedPreceding, -1)
    rest = mixed.withColumn("own", F.coalesce(F.sum("n").over(among), F.lit(0))).join(keys, F.col("source").eqNullSafe(F.col("s")) & (F.col("word") == F.col("k")) & (F.col("key") == F.col("kk")))
    return plain.unionByName(rest.select(*rows.columns, (F.col("offset") + F.col("before") + F.col("own")).alias("place")))


def places(rows: DataFrame) -> DataFrame:
    """One row for each leaf: a row of ``n`` equal leaves becomes ``n`` rows with places side by side, ``COPIES`` a task at most."""
    one = rows.where("n = 1").drop("n")
    many = rows.where("n > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    many = many.withColumn("spread", F.xxhash64("source", "id", "leaf", "chunk")).repartition("spread")
    last = F.least(F.col("n") - 1, F.col("chunk") * COPIES + COPIES - 1)
    many = many.withColumn("nth", F.explode(F.sequence(F.col("chunk") * COPIES, last))).withColumn("place", F.col("place") + F.col("nth"))
    return one.unionByName(many.drop("n", "chunk", "spread", "nth"))


def _nodes(level: int) -> Column:
    """Nodes of a tree's level, of ``total`` leaves."""
    return F.ceil(F.col("total") / float(FAN**level))


def levels(nodes: DataFrame, deepest: int, payload: list[str]) -> list[DataFrame]:
    """Slot arrays level by level: rows (source, total, place, slots, digest); ``nodes`` has (source, total, place, digest, payload).

    The first level's slots also hold the leaves' payload.
    """
    out: list[DataFrame] = []
    for level in range(1, deepest + 1):
        below = (out[-1] if out else nodes).where(_nodes(level - 1) > 1)
        slot = F.struct(F.col("place").bitwiseAND(F.lit(FAN - 1)).cast("int").alias("at"), "digest", *(payload if level == 1 else []))
        arrays = below.groupBy("source", "total", F.shiftright("place", FAN_BITS).alias("place")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        out.append(written(arrays.withColumn("digest", digest(F.concat_ws("", F.col("slots.digest"))))))
    return out


def depth(total: int) -> int:
    """Levels above ``total`` leaves."""
    level, n = 0, total
    while n > 1:
        level, n = level + 1, -(-n // FAN)
    return level


def tops(nodes: DataFrame, arrays: list[DataFrame]) -> DataFrame:
    """(source, total, digest): what remains of each tree. A tree of one leaf has it in ``nodes``."""
    keep = ["source", "total", "digest"]
    out = nodes.where("total = 1").select(*keep)
    for level, a in enumerate(arrays, 1):
        out = out.unionByName(a.where(_nodes(level) == 1).select(*keep))
    return out


def paths(top: DataFrame, arrays: list[DataFrame], handed: list[str], payload: list[str]) -> DataFrame:
    """Leaves of the trees of more than one leaf, with ``path``: what stands left and right of the way up, from the leaf's run to the root.

    ``top`` has (source, total, path) and the columns ``handed`` down to all leaves.
    """
    done, here = None, None
    for level in range(len(arrays), 0, -1):
        starts = top.where((_nodes(level) == 1) & (_nodes(level - 1) > 1)).select("source", F.lit(0).cast("long").alias("place"), "path", *handed)
        up = (starts if here is None else here.unionByName(starts)).withColumnsRenamed({"source": "s", "place": "p"})
        met = arrays[level - 1].drop("digest").join(up, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p"))).select("source", "place", "slots", "path", *handed)
        beside = lambda at, side: F.concat_ws("", F.transform(F.filter("slots", lambda s: side(s["at"], F.col(at))), lambda s: s["digest"]))
        each = met.select("*", F.explode("slots").alias("slot")).withColumn("at", F.col("slot.at"))
        step = F.struct(beside("at", lambda a, b: a < b).alias("l"), beside("at", lambda a, b: a > b).alias("r"))
        each = each.withColumn("path", F.concat(F.array(step), F.col("path")))
        child = (F.col("place") * FAN + F.col("at")).alias("place")
        if level == 1:
            done = each.select("source", child, "path", F.col("slot.digest").alias("digest"), *[F.col(f"slot.{c}") for c in payload], *handed)
        else:
            here = each.select("source", child, "path", *handed)
    return done


def manifest(docs: DataFrame, *, fields: list[str], tampered: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row a document: (source, id, place, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``folded_root`` is recomputed from the (where ``tampered``, changed) leaf and the original digests beside its path; ``verified`` says
    whether it is the root.
    """
    never = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = written(leaves(docs, fields, never, id_col=id_col, source_col=source_col, text_col=text_col))
    totals = cut(rows.groupBy("source").agg(F.sum("n").alias("total")))
    sizes = totals.select(F.col("source").alias("s"), "total")
    placed = places(ranked(rows)).join(sizes, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("leaf", "digest")
    payload = ["id", "folded"]
    nodes = written(placed.select("source", "total", "place", "digest", *payload))
    most = totals.agg(F.max("total").alias("m")).first()["m"] or 0
    arrays = levels(nodes, depth(most), payload)
    # The tree over the sources: one row a source from here on.
    subroots = cut(tops(nodes, arrays).withColumnsRenamed({"total": "leaves", "digest": "subroot"}))
    order = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("source"))  # one row a source
    count = totals.count()
    over = subroots.select(F.lit(0).alias("source"), F.lit(count).cast("long").alias("total"), (F.row_number().over(order) - 1).cast("long").alias("place"), F.col("subroot").alias("digest"), F.col("source").alias("name"), "leaves")
    named = ["name", "leaves"]
    above = levels(over, depth(count), named)
    no_path = F.array().cast("array<struct<l:string,r:string>>")
    root = tops(over, above).select("source", "total", no_path.alias("path"), F.col("digest").alias("root"))
    alone = over.where("total = 1").select("name", "leaves", F.col("digest").alias("subroot"), no_path.alias("path"), F.col("digest").alias("root"))
    if above:
        alone = paths(root, above, ["root"], named).select("name", "leaves", F.col("digest").alias("subroot"), "path", "root")
    top = cut(alone.withColumnsRenamed({"name": "source", "leaves": "total"}))
    keep = ["source", "id", "place", "digest", "folded", "path", "subroot", "root"]
    single = nodes.where("total = 1").join(top.select(F.col("source").alias("s"), "path", "subroot", "root"), F.col("source").eqNullSafe(F.col("s"))).select(*keep)
    found = single if not arrays else paths(top, arrays, ["subroot", "root"], payload).select(*keep).unionByName(single)
    proof = digest(F.concat_ws("", F.transform("path", lambda s: F.concat(s["l"], s["r"]))))
    folded = F.aggregate("path", F.col("folded"), lambda acc, s: digest(s["l"], acc, s["r"]))
    out = found.select("source", "id", "place", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
