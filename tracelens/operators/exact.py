"""Exact order statistics without a task that holds a whole group: counts narrow down what decides, rows are ranked only there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.operators import scan
from tracelens.operators.graph import cut

#: Distinct values of a group that one window ranks; a round of counting divides a range by 2**ROUND_BITS.
RANKED, ROUND_BITS = 4096, 12
_BEFORE = (Window.unboundedPreceding, -1)


def _before(n: str, groups: list, order: list) -> Column:
    return F.coalesce(F.sum(n).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(*_BEFORE)), F.lit(0))


def order_key(value: Column, kind: T.DataType) -> Column:
    """A long in the order of the value: the number itself, or the bits of a double, of which those of negative numbers are turned round.

    -0.0 is 0.0; NaN comes last, as Spark sorts it.
    """
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return value.cast("long")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp"))
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float], weight: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles of a number: rows (groups, p, q). Null values are left out; ``groups`` must not be null.
    With ``weight`` a row stands for that many.

    Radix selection: distinct values are counted once. Each round then counts, by the leading bits of an order-preserving key, only the
    ranges that hold a wanted rank, and narrows each to one of their parts, until no deciding range holds more than ``RANKED`` distinct values; those
    are ranked in a window. The range of the keys sets the first round's bits, so there is no width to choose, and no window holds more than
    2**ROUND_BITS counts or ``RANKED`` values, however many values a group has and however they lie.
    """
    x = df.where(F.col(value).isNotNull())
    values = cut(x.groupBy(*groups, order_key(F.col(value), df.schema[value].dataType).alias("_k")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"), F.first(F.col(value).cast("double")).alias("_v")))
    ends = values.agg(F.min("_k").alias("low"), F.max("_k").alias("high")).first()
    shift = 0 if ends["low"] is None else max(0, (ends["low"] ^ ends["high"]).bit_length() - ROUND_BITS)
    if ends["low"] is not None and (ends["low"] < 0) != (ends["high"] < 0):
        shift = 64 - ROUND_BITS  # the sign decides, too
    total = values.groupBy(*groups).agg(F.sum("_n").alias("_all"), F.count("*").alias("_distinct"))
    at = total.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("_at", F.col("p") * (F.col("_all") - 1))
    # One row for each wanted rank: its range of keys (all at first) and the number of values below the range.
    ranks = at.select(*groups, "p", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"), F.lit(None).cast("long").alias("_part"), F.lit(0).cast("long").alias("_low"), "_distinct")
    ranks = cut(ranks)
    above = None
    while ranks.where(F.col("_distinct") > RANKED).limit(1).count():
        ranks = cut(_narrowed(values, ranks, groups, above, shift))
        above, shift = shift, max(0, shift - ROUND_BITS)
    met = _inside(values, ranks, groups, above)
    met = met.withColumn("_low", F.col("_low") + _before("_n", [*groups, "p", "_rank"], ["_k"]))
    met = met.where((F.col("_low") <= F.col("_rank")) & (F.col("_rank") < F.col("_low") + F.col("_n")))
    got = met.groupBy(*groups, "p").agg(F.min_by("_v", "_k").alias("_a"), F.max_by("_v", "_k").alias("_z"), F.first("_at").alias("_at"))
    return got.select(*groups, "p", (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("q"))


def _inside(values: DataFrame, ranks: DataFrame, groups: list[str], above: int | None) -> DataFrame:
    """Values in each rank's range; the range is what has ``_part`` as its key's bits above ``above`` (None: all)."""
    if above is None:
        return values.join(ranks, groups)
    return values.withColumn("_part", F.shiftright("_k", above)).join(ranks, [*groups, "_part"])


def _narrowed(values: DataFrame, ranks: DataFrame, groups: list[str], above: int | None, shift: int) -> DataFrame:
    """``ranks`` with each range narrowed to the part that holds the rank; counts are made once for ranks that share a range."""
    shared = ranks.select(*groups, *([] if above is None else ["_part"])).distinct()
    within = values if above is None else values.withColumn("_part", F.shiftright("_k", above))
    counts = within.join(shared, shared.columns).groupBy(*shared.columns, F.shiftright("_k", shift).alias("_to")).agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"))
    counts = counts.withColumn("_lower", _before("_n", shared.columns, ["_to"]))
    met = ranks.drop("_distinct", *(["_part"] if above is None else [])).join(counts, shared.columns).withColumn("_low", F.col("_low") + F.col("_lower"))
    met = met.where((F.col("_low") <= F.col("_rank")) & (F.col("_rank") < F.col("_low") + F.col("_n")))
    return met.select(*groups, "p", "_at", "_rank", F.col("_to").alias("_part"), "_low", F.col("_d").alias("_distinct"))


def wide_quantiles(df: DataFrame, groups: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """Quantiles as columns: one row for each group."""
    q = quantiles(df, groups, value, list(named.values()))
    return q.groupBy(*groups).agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 6).alias(k) for k, p in named.items()])


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on their order: readings as decimals of nine places, added up without rounding."""
    return F.sum(value.cast("decimal(28,9)"))


def exact_mean(value: Column, digits: int = 6) -> Column:
    """Mean by ``exact_sum``, divided once and rounded."""
    return F.round(exact_sum(value).cast("double") / F.count(value), digits)


def co_moments(df: DataFrame, groups: list[str], x: str, ys: list[str], digits: int = 4) -> DataFrame:
    """Least-squares lines and correlations of each of ``ys`` (numbers of five places) over ``x`` (a whole number), all in one pass.

    Columns n_y, slope_y, intercept_y and corr_y of the rows in which y is known. Sums of x, y, xx, xy and yy are whole decimals, so they
    do not depend on the rows' order; they are divided once. A line over one x, and a correlation with a constant, are null.
    """
    sums, out = [], []
    d = lambda c: c.cast("double")
    for y in ys:
        at = F.when(F.col(y).isNotNull(), F.col(x)).cast("decimal(18,0)")
        v = F.col(y).cast("decimal(18,5)")
        for k, c in (("x", at), ("xx", at * at), ("y", v), ("xy", at * v), ("yy", v * v)):
            sums.append(F.sum(c).alias(f"_{k}_{y}"))
        sums.append(F.count(y).alias(f"n_{y}"))
        n, sx, sxx, sy, sxy, syy = (d(F.col(c)) for c in (f"n_{y}", f"_x_{y}", f"_xx_{y}", f"_y_{y}", f"_xy_{y}", f"_yy_{y}"))
        both, own, other = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
        slope = F.when(own > 0, both / own)
        out += [F.col(f"n_{y}"), F.round(slope, digits).alias(f"slope_{y}"), F.round((sy - slope * sx) / n, digits).alias(f"intercept_{y}"), F.round(F.when((own > 0) & (other > 0), both / F.sqrt(own * other)), digits).alias(f"corr_{y}")]
    return df.groupBy(*groups).agg(*sums).select(*groups, *out)


def prefix_sums(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (this row included) in the order of ``bucket`` and, inside a bucket, of ``order``.

    Windows run inside single buckets; what lies before a bucket comes from a tree of bounded fan-out over the buckets.
    """
    return scan.running_sums(df, [], bucket, order, sums)


def rank_select(df: DataFrame, strata: list[str], order: str, tie: str, quota: Column) -> DataFrame:
    """The ``quota`` rows of each stratum that come first by ``order`` (a hexadecimal hash) and ``tie``. ``quota`` may use ``_size``.

    The hash's first three digits are counted; digits below the one in which the quota falls are taken whole, and only the rows of
    that one are ranked. ``strata`` must not be null.
    """
    x = df.withColumn("_d", F.substring(order, 1, 3))
    per = x.groupBy(*strata, "_d").agg(F.count("*").alias("_n"))
    per = per.withColumn("_before", _before("_n", strata, ["_d"])).withColumn("_size", F.sum("_n").over(Window.partitionBy(*strata))).withColumn("_quota", quota).where("_before < _quota")
    met = x.join(per, [*strata, "_d"])
    whole = met.where("_before + _n <= _quota")
    edge = met.where("_before + _n > _quota").withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_d").orderBy(order, tie))).where("_before + _r <= _quota")
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))
