"""Aggregates, rankings and array operations that many queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.percentiles import clipped, percentiles
from weft.scratch import written


def where(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Equality filters; a None leaves its column free."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; with a constant k Spark cuts groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def top_list(df: DataFrame, keys: list[str], order: list[Column], value: str, k: int, out: str) -> DataFrame:
    """The first k values of each key as an ordered array."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", value))), lambda x: x[value]).alias(out))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with each row's place in `order`, from 1 on. Rows are dealt out by ranges and sorted there; only the ranges' sizes meet on the driver,
    so no task sees all rows. `df` should be written, and `order` end with something that tells rows apart: equal ones share a range."""
    ordered = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_w_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_w_at", 33), F.col("_w_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_w_part long, _w_start long"))
    return ordered.join(offsets, part == F.col("_w_part"), "left").withColumn(out, F.col("_w_start") + within + 1).drop("_w_at", "_w_part", "_w_start")


def percentile(df: DataFrame, column: str, share: float) -> float | None:
    """The exact percentile of one column, see `percentiles`."""
    return percentiles(df, [column], share)[column]


def clipped_by_percentile(df: DataFrame, column: str, share: float, out: str, missing: float | None = None) -> DataFrame:
    """column divided by its exact percentile, between 0 and 1; 0 for a missing value, and everywhere if the percentile isn't above 0."""
    return clipped(df, {column: out}, share, missing)


def median_difference(df: DataFrame, key: str, value: str, group: str, case: str, control: str, least: int, threshold: float) -> DataFrame:
    """Median of case minus median of control for each key; both need `least` rows and the difference a magnitude of `threshold`."""
    both = df.filter(F.col(group).isin(case, control)).groupBy(key).agg(
        F.median(F.when(F.col(group) == case, F.col(value))).alias("a"),
        F.median(F.when(F.col(group) == control, F.col(value))).alias("b"),
        F.count_if(F.col(group) == case).alias("na"),
        F.count_if(F.col(group) == control).alias("nb"),
    )
    diff = F.col("a") - F.col("b")
    return both.filter((F.col("na") >= least) & (F.col("nb") >= least) & (F.abs(diff) >= threshold)).select(key, F.round(diff, 6).alias("diff"), F.when(diff >= 0, "up").otherwise("down").alias("direction"))


def ordered_distinct(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """Each key's values once, in the order of their first occurrence."""
    firsts = df.groupBy(key, value).agg(F.min(order).alias("_i"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", value))), lambda x: x[value]).alias(out))


def precision_recall(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """hits, extra, missed, precision, recall and F1; an empty side counts as 1."""
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    c = g.join(p, keys, "full").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("hits"), F.count_if(F.col("g").isNull()).alias("extra"), F.count_if(F.col("p").isNull()).alias("missed"))
    share = lambda rest: F.when(F.col("hits") + F.col(rest) == 0, F.lit(1.0)).otherwise(F.col("hits") / (F.col("hits") + F.col(rest)))
    c = c.withColumn("precision", share("extra")).withColumn("recall", share("missed"))
    return c.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page of an ordered result, with the total and whether more follows; sizes are 1 to 200."""
    size, number = max(1, min(size, 200)), max(0, number)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(size * number).limit(size).join(F.broadcast(total)).withColumn("has_more", F.col("total") > size * (number + 1))


def sorted_by(df: DataFrame, allowed: dict[str, list[Column]], key: str) -> DataFrame:
    """Orders by one of the allowed sort keys, the first if it isn't one."""
    return df.orderBy(*allowed.get(key, next(iter(allowed.values()))))


def additions(old: str, new: str) -> Column:
    """What `new` has and `old` hasn't."""
    return F.array_except(new, old)


def without(values: str, delta: str) -> Column:
    """`values` less the delta; repeats of others stay."""
    return F.filter(values, lambda x: ~F.array_contains(F.col(delta), x))
