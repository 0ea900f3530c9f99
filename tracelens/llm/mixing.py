"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1. ``targets``: words wanted of each source (weights, shares, caps).
2. ``plan``: each source's documents are permuted by a hash. Prefix sums over hash prefixes (at most 256 children a node, so
   that no window holds a source) give every document its place in its source's word sequence.
3. ``quotas``: a source is read in passes. A pass that the target takes whole wants all its blocks of ``block_words`` words, the last one only as
   many as the rest of the target needs.
4. ``split``: the quotas of all passes are split among the output shards from the root down. A node hands its left child half of its blocks: how
   many of each pass is one multivariate-hypergeometric draw, made pass by pass from what is left (``hypergeometric``, by inversion
   from the mode outwards). A node also owns a run of each pass's permuted blocks; the left child's part of it is as long as its quota and half of what
   the quota leaves over. So quotas stay exact, runs are disjoint, and which blocks are drawn follows from the draws.
5. ``draw``: a shard draws the first blocks of its runs. Documents of a pass that is not whole are taken along the drawn blocks, shard by shard, and then
   along the others, until the rest of the target: words differ from a target by half a document at most. A shard shuffles its own documents.

Edge cases: a null text or one without words has size 0 and is never drawn. A null source is a source of its own, the last one.
Null ids are ids like any other. Repeated rows are separate documents that share their draws as evenly as possible. An empty table
gives no rows. Only the id, text and source columns are read: other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import WORD, cut
from tracelens.operators.scan import tree_scan

#: Hex digits of a hash in the two upper levels of the prefix tree.
TOP, LEAF = 2, 4


def n_words(text: str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: str, text_col: str, seed: str) -> Column:
    """A document's place in the permutation: a hash of seed, id and text."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text).cast("binary"))


def source_key(source_col: str) -> list[Column]:
    """A source as two columns that are never null: ``no_source`` and ``sk``."""
    return [F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("sk")]


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per document: id, source, size in words, and its place in the permutation (``h``)."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        *source_key(source_col),
        n_words(text_col).alias("size"),
        row_hash(id_col, text_col, seed).alias("h"),
    )


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its size and target.

    Sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` times all sizes. A target stops at ``cap``
    times its source's size and what it leaves is shared anew. That is water-filling: ``target = min(cap * size, level * weight)``;
    in the order of ``cap * size / weight`` the level is the first that does not exceed its own source's bound. The table has one
    row per source, so its windows are small.
    """
    whole = Window.partitionBy(F.lit(1))
    by_name = whole.orderBy("no_source", "sk")
    by_bound = whole.orderBy("bound", "place")
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    per = sized.groupBy("no_source", "sk").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        per.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", w)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("bound", F.col("most") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(whole))
        .withColumn("left", F.lit(float(share)) * F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("free", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("free"))
    )
    fits = F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", "place", "level"))).over(whole)
    level = fits["level"]
    return ranked.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))).select(
        "no_source", "sk", "source_size", "target"
    )


def plan(docs: DataFrame, *, weights=(3, 1, 2), share=1.5, cap=2.0, seed="mix", id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per document with its source's size and target, and ``start``: words of its source before it in the permutation."""
    keys = ["no_source", "sk"]
    sized = cut(
        sizes(docs, id_col, text_col, source_col, seed)
        .withColumn("b1", F.substring("h", 1, TOP))
        .withColumn("b2", F.substring("h", 1, LEAF))
    )
    before = (Window.unboundedPreceding, -1)
    leaf = sized.groupBy(*keys, "b1", "b2").agg(F.sum("size").alias("s2"))
    top = leaf.groupBy(*keys, "b1").agg(F.sum("s2").alias("s1")).join(targets(sized, weights, share, cap), keys)
    top = top.withColumn("start1", F.coalesce(F.sum("s1").over(Window.partitionBy(*keys).orderBy("b1").rowsBetween(*before)), F.lit(0))).drop("s1")
    leaf = leaf.withColumn("start2", F.coalesce(F.sum("s2").over(Window.partitionBy(*keys, "b1").orderBy("b2").rowsBetween(*before)), F.lit(0))).drop("s2")
    within = Window.partitionBy(*keys, "b2").orderBy("h", "size", "id")
    # Written once, without texts: what follows reads it three times.
    return cut(
        sized.drop("b1")
        .join(leaf.join(top, [*keys, "b1"]).drop("b1"), [*keys, "b2"])
        .withColumn("start3", F.coalesce(F.sum("size").over(within.rowsBetween(*before)), F.lit(0)))
        .withColumn("start", F.col("start1") + F.col("start2") + F.col("start3"))
        .withColumn("nth", F.row_number().over(within))
        .drop("start1", "start2", "start3", "b2")
    )


PASS = ["no_source", "sk", "pass"]


def uniform(*parts) -> Column:
    """A number from 0 to 1 (52 bits) by a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` balls, out of ``total`` of which ``marked`` count, do count: the value at ``u`` of the inverted distribution.

    Weights follow from the mode's by their ratios, as far as twelve deviations out; beyond, they are below what a double can add.
    """
    n, k, d = (c.cast("double") for c in (total, marked, drawn))
    down = lambda i: i * (n - k - d + i) / ((k - i + 1) * (d - i + 1))  # noqa: E731 (weight of i - 1 over that of i)
    up = lambda i: (k - i) * (d - i) / ((i + 1) * (n - k - d + i + 1))
    step = lambda ratio: lambda s, i: _let(s["w"] * ratio(i), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(marked, drawn)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("long")))
    balls = F.greatest(n, F.lit(1.0))
    spread = F.sqrt(F.greatest(F.lit(0.0), d * k / balls * (n - k) / balls * (n - d) / F.greatest(n - 1, F.lit(1.0))))
    width = (F.ceil(12 * spread) + 12).cast("long")
    ends = F.struct(mode.alias("mode"), F.greatest(low, mode - width).alias("first"), F.least(high, mode + width).alias("last"))

    def sums(e):
        below = F.when(e["first"] < e["mode"], F.aggregate(F.sequence(e["mode"], e["first"] + 1, F.lit(-1).cast("long")), start, step(down))).otherwise(start)
        above = F.when(e["last"] > e["mode"], F.aggregate(F.sequence(e["mode"], e["last"] - 1), start, step(up))).otherwise(start)
        return F.struct(e["first"].alias("first"), e["last"].alias("last"), below.alias("below"), above["sum"].alias("above"))

    def at(x):
        none = F.struct(x["below"]["w"].alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at"))
        found = lambda s, i, goal: F.when(s["at"].isNull() & (s["sum"] + s["w"] > goal), i).otherwise(s["at"])
        walk = lambda goal: lambda s, i: F.struct((s["w"] * up(i)).alias("w"), (s["sum"] + s["w"]).alias("sum"), found(s, i, goal).alias("at"))
        return _let(u * (x["below"]["sum"] + x["above"] + 1.0), lambda goal: F.coalesce(F.aggregate(F.sequence(x["first"], x["last"]), none, walk(goal))["at"], x["last"]))

    return _let(_let(ends, sums), at)


def quotas(wanted: DataFrame, *, block_words: int, cap: float = 2.0) -> DataFrame:
    """(no_source, sk, pass, rest, whole, blocks, quota): the passes over each source of positive size, from one row a source with its size and target."""
    passes = wanted.where("source_size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(1, -int(-cap // 1)) - 1))))
    rest = F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - F.col("pass") * F.col("source_size")))
    x = passes.withColumn("rest", rest).withColumn("whole", F.col("rest") >= F.col("source_size")).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    quota = F.when(F.col("whole"), F.col("blocks")).otherwise(F.ceil(F.col("rest") / F.lit(block_words)).cast("long"))
    return x.where("rest > 0").select(*PASS, "rest", "whole", "blocks", quota.alias("quota"))


def _drawing(seed: str, level: int):
    """One pass's draw at a node, as a step over the node's urn: (balls, draws, out) without what is drawn."""

    def step(s, c):
        u = uniform(F.lit(seed), F.lit(level), F.col("node").cast("string"), c["no_source"].cast("string"), c["sk"], c["pass"].cast("string"))
        got = _let(u, lambda v: hypergeometric(s["balls"], c["quota"], s["draws"], v))
        return _let(got, lambda g: F.struct((s["balls"] - c["quota"]).alias("balls"), (s["draws"] - g).alias("draws"), F.array_append(s["out"], g).alias("out")))

    return step


def split(wanted: DataFrame, *, shards: int, seed: str) -> DataFrame:
    """Leaves of the tree: rows (no_source, sk, pass, shard, first, length, quota), from one row a pass with its blocks and quota.

    A level is one row for each node and pass; a node's passes are one array, of as many entries as there are passes over sources.
    """
    at = wanted.select(F.lit(0).cast("long").alias("node"), *PASS, F.lit(0).cast("long").alias("first"), F.col("blocks").alias("length"), "quota")
    kept = [*PASS, "first", "length", "quota"]
    for level in range(max(0, shards - 1).bit_length()):
        nodes = at.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("urn"), F.sum("quota").alias("all"))
        half = F.floor(F.col("all") / 2).cast("long")
        begin = F.struct(F.col("all").alias("balls"), half.alias("draws"), F.array().cast("array<bigint>").alias("out"))

        left = F.aggregate("urn", begin, _drawing(seed, level))["out"]
        each = nodes.select("node", F.explode(F.arrays_zip("urn", left.alias("left"))).alias("c")).select("node", *[F.col(f"c.urn.{k}") for k in kept], F.col("c.left").alias("left"))
        mine = F.col("left") + F.floor((F.col("length") - F.col("quota")) / 2).cast("long")
        a = F.struct((F.col("node") * 2).alias("node"), F.col("first").alias("first"), mine.alias("length"), F.col("left").alias("quota"))
        b = F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("first") + mine).alias("first"), (F.col("length") - mine).alias("length"), (F.col("quota") - F.col("left")).alias("quota"))
        at = each.select(*PASS, F.explode(F.array(a, b)).alias("n")).select("n.node", *PASS, "n.first", "n.length", "n.quota").where("length > 0")
    return at.withColumnRenamed("node", "shard").select(*PASS, "shard", "first", "length", "quota")


def blocks(leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """(no_source, sk, pass, block, shard, turn): every block of every pass, with the shard that owns it and its turn: drawn ones first, shard by shard."""
    group = 1 << 12
    x = tree_scan(leaves, PASS, "shard", {"q": (F.col("quota"), "sum")}).withColumn("q", F.coalesce("q", F.lit(0))).join(wanted.select(*PASS, F.col("quota").alias("all")), PASS)
    runs = x.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / group).cast("long"))))
    inside = F.sequence(F.col("run") * group, F.least(F.col("length"), (F.col("run") + 1) * group) - 1)
    x = runs.withColumn("i", F.explode(inside))
    turn = F.when(F.col("i") < F.col("quota"), F.col("q") + F.col("i")).otherwise(F.col("all") + F.col("first") - F.col("q") + F.col("i") - F.col("quota"))
    return x.select(*PASS, (F.col("first") + F.col("i")).alias("block"), "shard", turn.alias("turn"))


def draw(planned: DataFrame, *, cap: float = 2.0, block_words: int = 4096, shard_words: int = 4_000_000, seed: str = "mix") -> DataFrame:
    """The mix: a row (id, source, size, h, nth, pass, shard, position) for each time a document is drawn."""
    wanted = planned.groupBy("no_source", "sk").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    wanted = cut(quotas(wanted, block_words=block_words, cap=cap))
    total = wanted.agg(F.sum("rest")).first()[0] or 0.0  # one number
    shards = 1 << max(0, int(total // shard_words)).bit_length()
    dealt = blocks(cut(split(wanted, shards=shards, seed=seed)), wanted)
    own = F.least(F.floor((F.col("start") + F.col("size") / 2) / F.lit(block_words)).cast("long"), F.col("blocks") - 1)
    rows = planned.where("size > 0").join(wanted.drop("quota"), ["no_source", "sk"]).withColumn("block", own).drop("blocks")
    met = cut(rows.join(dealt, [*PASS, "block"]).select("id", "source", *PASS, "size", "h", "nth", "start", "rest", "whole", "block", "shard", "turn"))
    part = met.where("not whole")
    turns = part.groupBy(*PASS, "turn").agg(F.sum("size").alias("words"))
    turns = tree_scan(turns, PASS, "turn", {"before": (F.col("words"), "sum")}).select(*PASS, "turn", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy(*PASS, "turn").orderBy("start", "h", "nth").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(turns, [*PASS, "turn"]).where(F.col("before") + F.col("within") + F.col("size") / 2 <= F.col("rest"))
    drawn = met.where("whole").select("id", "source", *PASS, "size", "h", "nth", "shard").unionByName(part.select("id", "source", *PASS, "size", "h", "nth", "shard"))
    shuffled = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "h", "nth", "pass").cast("binary")))
    return drawn.withColumn("position", F.row_number().over(shuffled))


def taken(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per document of the plan: how often the mix takes it, and the first shard that does (null: none)."""
    keys = ["no_source", "sk", "h", "nth"]
    times = drawn.groupBy(*keys).agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    return planned.join(times, keys, "left").withColumn("times", F.coalesce(F.col("times"), F.lit(0)))


#: Rows that are equal in source, id and text, in one array of ``mix_documents``.
COPIES = 1 << 12


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mix draws it, with the same columns, shard by shard and in each shard's own order.

    Rows are matched by source, hash and their number among rows equal in source, id and text. Texts move twice, as they are most of the disk that a
    run needs: to their draws, which lie in arrays by that number so that numbering and join share one shuffle, and from there to their shards.
    """
    planned = plan(docs, **how)
    own = ["no_source", "sk", "h"]
    drawn = draw(planned, cap=how.get("cap", 2.0), seed=how.get("seed", "mix")).select(*own, "nth", F.struct("shard", "position").alias("use"))
    nth = drawn.withColumn("of", F.dense_rank().over(Window.partitionBy(*own).orderBy("nth")) - 1)
    uses = nth.groupBy(*own, "of").agg(F.collect_list("use").alias("uses"))
    runs = uses.groupBy(*own, F.floor(F.col("of") / COPIES).alias("run")).agg(F.min("of").alias("from"), F.sort_array(F.collect_list(F.struct("of", "uses")))["uses"].alias("at"))

    h = row_hash(how.get("id_col", "doc_id"), how.get("text_col", "text"), how.get("seed", "mix"))
    rows = docs.select(F.struct("*").alias("row"), *source_key(how.get("source_col", "source")), h.alias("h"))
    rows = rows.withColumn("of", F.row_number().over(Window.partitionBy(*own).orderBy("h")) - 1)
    # A range, as an equation would be a further key, by which the texts would be shuffled again.
    same = [rows[k] == runs[k] for k in own] + [rows["of"] >= runs["from"], rows["of"] < runs["from"] + COPIES]
    met = rows.join(runs, same).select("row", F.explode(F.get("at", rows["of"] - F.col("from"))).alias("use"))
    return met.select("row", "use.*").repartition("shard").sortWithinPartitions("shard", "position").select("row.*")
