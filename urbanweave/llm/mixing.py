"""Mixing of sources to target weights with DataFrame functions only.

Every document gets a hash-random key. Keys are cut into equal ranges per source, so the
order within a source is a range sort: totals of the ranges give each range its offset, a
window inside a range gives the rest, and together they are the prefix sum of words over
the whole source without any source meeting in one task. Whole epochs are taken first; the
last one ends at the exact word budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanweave.llm.spark import checkpoint

#: Key ranges per source: rows of one range are summed in one task (they hold no text).
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Words to take of each source of `totals` (source, source_size): adds target.

    Sources in code-point order, null last, weigh `weights` in turn. Targets share
    `share` x all words by weight and stop at `most` x the source's words; what is over
    goes to the others by weight until none is above. That ends where every source below
    its stop has the same target per weight, found by filling sources in the order in
    which they reach their stops. Runs over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    ranked = ranked.withColumn("stopped", F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.greatest(F.lit(0.0), (F.col("goal") - F.col("stopped")) / F.col("heavy")))
    # The first source, in this order, whose stop lies above its level fixes the level of all that follow.
    ranked = ranked.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") < F.col("stop"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.select("source", "source_size", F.coalesce(F.least("stop", F.col("level") * F.col("weight")), F.col("stop")).alias("target"))


def mix(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", count: Column | None = None) -> DataFrame:
    """How many words the mix takes of every document.

    Returns doc_id, source, size, source_size, target, taken. `taken` counts repeats: whole
    epochs first, then documents in hash order up to the word budget; the document at the
    cut gives the words still missing. Null and empty texts have size 0 and give nothing.
    A null source is a source of its own. Repeated rows are counted each. An empty table
    gives an empty result. The same rows give the same result on every run.
    """
    size = word_count(F.col(text)) if count is None else count
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    # 60 bits of an MD5 are a random key that any engine can compute again.
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("key", key).withColumn("part", F.floor(F.col("key") / F.lit((1 << 60) // RANGES)).cast("int"))
    rows = rows.withColumn("has", F.col("source").isNotNull()).withColumn("name", F.coalesce("source", F.lit("")))
    # The texts are read once: what is left of them is a few numbers a document.
    dealt = checkpoint(rows.select("doc_id", "name", "has", "part", "key", "size").repartition("name", "has", "part"))
    parts = dealt.groupBy("name", "has", "part").agg(F.sum("size").alias("part_size"))
    totals = parts.groupBy("name", "has").agg(F.sum("part_size").alias("source_size")).select(F.when(F.col("has"), F.col("name")).alias("source"), "source_size")
    targets = source_targets(totals, list(weights), share, most)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNotNull().alias("has"), "source_size", "target")
    by_part = Window.partitionBy("name", "has").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(by_part), F.lit(0))).join(targets, ["name", "has"])
    inside = Window.partitionBy("name", "has", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts.select("name", "has", "part", "offset", "source_size", "target"), ["name", "has", "part"])
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("within")))
    return placed.select("doc_id", F.when(F.col("has"), F.col("name")).alias("source"), "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many whole times as the words taken of it round to.

    Copies keep all columns of `docs`; a document of which less than half was taken in the
    last epoch is left out of that epoch. Documents without words are left out. Rows that
    share a doc_id share the rounding of each.
    """
    taken = mix(docs, **options).where("size > 0").groupBy("doc_id", "size").agg(F.max("taken").alias("taken"))
    taken = taken.select("doc_id", "size", F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int").alias("copies")).where("copies > 0")
    whole = docs.select(F.col(options.get("doc_id", "doc_id")).alias("doc_id"), word_count(F.col(options.get("text", "text"))).alias("size"), F.struct("*").alias("row"))
    return whole.join(taken, ["doc_id", "size"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
