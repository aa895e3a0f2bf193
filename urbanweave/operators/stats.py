"""Distributions, error statistics and difference accounting as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanweave.functions.columns import r6
from urbanweave.functions.tables import checkpoint


def quantiles(df: DataFrame, value: str, by: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of every group: by, and one column a name of `wanted`.

    Values are dealt to tasks by ranges; the sizes of the ranges give each its first rank, so
    no group and no map of its values is held in one task. Nulls and NaN take no part.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(by).alias("g"), F.col(value).alias("v"), F.monotonically_increasing_id().alias("tie"))
    rows = checkpoint(rows.repartitionByRange("g", "v", "tie").withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("g", "part").agg(F.count("*").alias("n"))
    parts = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("g", "part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("g", "part").orderBy("v", "tie"))
    ranked = rows.withColumn("rank", rank).join(sizes, ["g", "part"]).withColumn("rank", F.col("rank") + F.col("before") - 1)
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    pick = lambda where: F.max(F.when(F.col("rank") == where, F.col("v")))
    out = ranked.groupBy("g").agg(F.max("n").alias("n"), *[x for name, p in at.items() for x in (pick(F.floor(p)).alias(f"low_{name}"), pick(F.ceil(p)).alias(f"high_{name}"))])
    mixed = lambda name, p: F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * (p - F.floor(p))
    return out.select(F.col("g").alias(by), *[r6(mixed(name, p)).alias(name) for name, p in at.items()])


def _with_quantiles(df: DataFrame, value: str, by: str | None, wanted: dict[str, float], sums: list[Column]) -> DataFrame:
    rows = df.withColumn("one_group", F.lit(1)) if by is None else df
    key = by or "one_group"
    facts = (rows.groupBy(key) if by else rows).agg(*sums)
    facts = facts if by else facts.withColumn(key, F.lit(1))
    out = facts.join(quantiles(rows, value, key, wanted), key, "left")
    return out if by else out.drop(key)


def distribution(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Count, zeros, positives, mean and five exact quantiles of finite values, for all rows or for every group."""
    v = F.when(~F.isnan(value), F.col(value))
    sums = [F.count(v).alias("n"), F.count_if(v == 0).alias("n_zero"), F.count_if(v > 0).alias("n_positive"), r6(F.avg(v)).alias("mean"), r6(F.min(v)).alias("low"), r6(F.max(v)).alias("high")]
    return _with_quantiles(df, value, by, {"p05": 0.05, "median": 0.5, "p95": 0.95}, sums)


def errors(df: DataFrame, value: str, limits: tuple[float, ...] = (0.05, 0.1, 0.2, 0.5)) -> DataFrame:
    """Count, extremes, mean, mean absolute and root mean square error, exact quantiles, and counts beyond limits."""
    v = F.col(value)
    sums = [F.count(v).alias("n"), r6(F.min(v)).alias("low"), r6(F.max(v)).alias("high"), r6(F.avg(v)).alias("mean"), r6(F.avg(F.abs(v))).alias("mae"), r6(F.sqrt(F.avg(v * v))).alias("rmse")]
    return _with_quantiles(df, value, None, {"p01": 0.01, "median": 0.5, "p99": 0.99}, sums + [F.count_if(F.abs(v) > t).alias(f"over_{int(t * 100)}") for t in limits])


def by_regions(df: DataFrame, regions: dict[str, Column]) -> DataFrame:
    """One copy of a row for every region it lies in (regions may overlap)."""
    return df.withColumn("region", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in regions.items()]))))


def agreement(a: Column, b: Column) -> list[Column]:
    """Cells true in both, in one or in none, and intersection over union; cells unknown in either are excluded."""
    known = a.isNotNull() & b.isNotNull()
    both, either = F.count_if(known & a & b), F.count_if(known & (a | b))
    return [both.alias("both"), F.count_if(known & a & ~b).alias("a_only"), F.count_if(known & ~a & b).alias("b_only"), F.count_if(known & ~a & ~b).alias("neither"), F.count_if(~known).alias("excluded"), r6(F.try_divide(both.cast("double"), either)).alias("iou")]


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation; null with fewer than two rows or without spread in either."""
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), r6(F.corr(a, b)))


#: Hex digits that name a group of row hashes, level by level up to the root of a content digest.
LEVELS = (5, 3, 1)


def row_text(columns: list[str]) -> Column:
    """A row as one text: each value behind its length in code points, null as ~, so no two rows read alike."""
    parts = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.concat(*parts)


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and content digest of a table, whatever its order: n, digest.

    Every row is hashed; equal hashes become one line with their number. The sorted lines of all that begins with the
    same five digits are hashed, those hashes with what they are of by three digits, by one, and at the root: a tree that tasks
    build in parts, of the whole hashes. One row changed, lost or doubled changes the root. An empty table has a digest as well.
    """
    line = F.concat_ws(":", "h", F.col("n").cast("string")).alias("line")
    level = df.select(F.sha2(row_text(columns), 256).alias("h")).groupBy("h").agg(F.count("*").alias("n")).select("h", line, "n")
    lines = F.array_join(F.array_sort(F.collect_list("line")), ",")
    for digits in LEVELS:
        level = level.groupBy(F.substring("h", 1, digits).alias("h")).agg(F.sha2(lines, 256).alias("d"), F.sum("n").alias("n"))
        level = level.select("h", F.concat_ws(":", "h", "d").alias("line"), "n")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(lines, 256).alias("digest"))


def edit_summary(edits: DataFrame, by: str, before: str, after: str, rejected: Column, key: str) -> DataFrame:
    """What edits changed, by kind: moved (sum of absolute changes), largest, changed (how many), and every rejected id.

    One row a rejected id, with the facts of its kind beside it, and one with a null id for a kind without any: no list of ids grows with the table.
    """
    change = F.abs(F.col(after) - F.col(before))
    facts = edits.groupBy(by).agg(F.sum(change).alias("moved"), F.max(change).alias("largest"), F.count_if(change != 0).alias("changed"))
    return facts.join(edits.where(rejected).select(by, F.col(key).alias("rejected")), by, "left")


def tied_largest(values: DataFrame, by: str, value: str, key: str, tolerance: float = 1e-8) -> DataFrame:
    """The largest value of every group and each id that has it, to within `tolerance`: by, n (values above 0), largest, id; one row a tied id."""
    most = values.groupBy(by).agg(F.count_if(F.col(value) > 0).alias("n"), F.max(value).alias("largest"))
    j = values.join(most, by).where(F.abs(F.col(value) - F.col("largest")) <= tolerance)
    return j.select(by, "n", "largest", F.col(key).alias("id"))
