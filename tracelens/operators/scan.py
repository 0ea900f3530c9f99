"""Ordered state over long groups without a task that holds a group: trees of bounded fan-out over buckets of an order.

``tree_scan`` adds up (or carries) what lies before each bucket. The other functions scan rows inside single (group, bucket) pairs and take
the state at the bucket's start from ``tree_scan`` over one row a bucket. A bucket is a long that grows with the order's first column; the
caller chooses its width so that one bucket of one group fits a task (an hour of one user, a thousand job ids).

Groups may be null. Order columns must not be null, and rows must differ in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A node of the tree has up to 2**FAN_BITS children.
FAN_BITS = 10
_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def _join_on(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """Left join on keys that may be null on both sides."""
    on = pairs[0][0].eqNullSafe(pairs[0][1])
    for a, b in pairs[1:]:
        on = on & a.eqNullSafe(b)
    return left.join(right, on, "left")


def _both(how: str, a: Column, b: Column) -> Column:
    if how == "sum":
        return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.greatest(a, b) if how == "max" else F.least(a, b)


def tree_depth(low: int | None, high: int | None, bits: int = FAN_BITS) -> int:
    """Levels that a tree over keys from ``low`` to ``high`` needs until the upmost has 2**bits nodes at most."""
    depth = 1
    while low is not None and (high >> bits * (depth - 1)) - (low >> bits * (depth - 1)) >= 1 << bits:
        depth += 1
    return depth


def tree_scan(df: DataFrame, groups: list[str], key: str, scans: dict[str, tuple[Column, str]], *, backward: bool = False, bits: int = FAN_BITS) -> DataFrame:
    """``df`` (one row for each group and ``key``, a long) with each scan's merge over all smaller keys of the group.

    A scan is (column, "sum", "max" or "min"); null where no key comes before. ``backward``: over all larger keys. Going up, nodes merge
    their children; coming down, every node gets what lies before it from its parent and its siblings. No window holds more than the
    2**bits children of one node; the number of levels follows from the range of the keys.
    """
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    depth = tree_depth(ends["low"], ends["high"], bits)
    kept = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    names = [f"_g{i}" for i in range(len(groups))]
    levels = [df.select(F.struct("*").alias("_row"), *kept, F.col(key).alias("_k"), *[c.alias(f"_v_{n}") for n, (c, _) in scans.items()])]
    for _ in range(depth - 1):
        merged = [_MERGE[how](f"_v_{n}").alias(f"_v_{n}") for n, (_, how) in scans.items()]
        levels.append(levels[-1].groupBy(*names, F.shiftright("_k", bits).alias("_k")).agg(*merged))
    first = F.desc("_k") if backward else F.asc("_k")
    above = None
    for at in reversed(range(depth)):
        siblings = [*names] if above is None else [*names, F.shiftright("_k", bits)]
        before = Window.partitionBy(*siblings or [F.lit(1)]).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
        here = levels[at].select("*", *[_MERGE[how](f"_v_{n}").over(before).alias(f"_b_{n}") for n, (_, how) in scans.items()])
        if above is not None:
            up = above.select(F.col("_k").alias("_up"), *[F.col(x).alias(f"_u{x}") for x in names], *[F.col(f"_b_{n}").alias(f"_o_{n}") for n in scans])
            here = _join_on(here, up, [(F.shiftright("_k", bits), F.col("_up")), *[(F.col(x), F.col(f"_u{x}")) for x in names]])
            here = here.withColumns({f"_b_{n}": _both(how, F.col(f"_o_{n}"), F.col(f"_b_{n}")) for n, (_, how) in scans.items()})
        above = here
    return above.select("_row.*", *[F.col(f"_b_{n}").alias(n) for n in scans])


def _carried(x: DataFrame, groups: list[str], totals: dict[str, Column], how: str, *, backward: bool = False) -> DataFrame:
    """``x`` (with its bucket ``_b``) and, as ``totals``' names, what the buckets before hold in all."""
    per = x.groupBy(*groups, "_b").agg(*[c.alias(f"_t_{n}") for n, c in totals.items()])
    per = tree_scan(per, groups, "_b", {n: (F.col(f"_t_{n}"), how) for n in totals}, backward=backward)
    per = per.select(F.col("_b").alias("_at"), *[F.col(g).alias(f"_p{i}") for i, g in enumerate(groups)], *totals)
    return _join_on(x, per, [(F.col("_b"), F.col("_at")), *[(F.col(g), F.col(f"_p{i}")) for i, g in enumerate(groups)]]).drop("_at", *[f"_p{i}" for i in range(len(groups))])


def running_sums(df: DataFrame, groups: list[str], bucket: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (the row itself included) in each group's order."""
    x = df.withColumn("_b", bucket.cast("long")).withColumns({f"_x_{n}": c for n, c in sums.items()})
    out = _carried(x, groups, {f"_o_{n}": F.sum(f"_x_{n}") for n in sums}, "sum")
    inside = Window.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({n: F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.sum(f"_x_{n}").over(inside) for n in sums})
    return out.drop("_b", *[f"_x_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def beside(df: DataFrame, groups: list[str], bucket: Column, order: list[str], values: dict[str, Column], *, after: bool = False) -> DataFrame:
    """``df`` with ``values`` of the row before (``after``: of the row behind) in each group's order; null where there is none."""
    x = df.withColumn("_b", bucket.cast("long")).withColumn("_s", F.struct(*order, *[c.alias(f"_v_{n}") for n, c in values.items()]))
    end = F.min("_s") if after else F.max("_s")  # the first or last row of a bucket, as rows differ in the order
    out = _carried(x, groups, {"_c": end}, "min" if after else "max", backward=after)
    inside = Window.partitionBy(*groups, "_b").orderBy(*order)
    near = F.lead("_s").over(inside) if after else F.lag("_s").over(inside)
    out = out.withColumn("_n", F.coalesce(near, F.col("_c")))
    return out.withColumns({n: F.col(f"_n._v_{n}") for n in values}).drop("_b", "_s", "_c", "_n")


def known(df: DataFrame, groups: list[str], bucket: Column, order: list[str], values: dict[str, Column], where: Column, *, after: bool = False) -> DataFrame:
    """``df`` with ``values`` of the last row up to and with this one that fulfils ``where`` (``after``: of the first from this one on)."""
    x = df.withColumn("_b", bucket.cast("long")).withColumn("_s", F.when(where, F.struct(*order, *[c.alias(f"_v_{n}") for n, c in values.items()])))
    end = F.min("_s") if after else F.max("_s")
    out = _carried(x, groups, {"_c": end}, "min" if after else "max", backward=after)
    inside = Window.partitionBy(*groups, "_b").orderBy(*order)
    if after:
        near = F.first("_s", True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    else:
        near = F.last("_s", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_n", F.coalesce(near, F.col("_c")))
    return out.withColumns({n: F.col(f"_n._v_{n}") for n in values}).drop("_b", "_s", "_c", "_n")
