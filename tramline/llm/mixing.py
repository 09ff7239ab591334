"""Mixing sources to target weights by capped water-filling with seeded whole and fractional repetitions.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source of size 0 takes nothing; repeated rows
stand as rows of their own; ties in the seeded order go by id and a hash of the text; a very long text is only counted, where it lies; extra
columns are left out unless keep names them; with no rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

#: Digits of the seeded hash that first split a source: 16 ** 3 slices.
SLICE_DIGITS = 3


def water_fill(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0) -> DataFrame:
    """Adds target to (source, source_size): its weight's share of all sizes, clamped at max_epochs times its size, the excess reshared by weight.

    The clamped sources are those of least size per weight, so one ordering of the sources gives the fixed point of the
    rounds of clamping: with k clamped, the level is (total - clamped) / (weight of the rest).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("top", F.lit(max_epochs) * F.col("source_size"))
    by_need = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = (
        rows.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("clamped", F.coalesce(F.sum("top").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("clamped")) / F.col("rest"))
    )
    # The first source in order of need that stays under its top sets the level for all after it.
    free = F.col("top") >= F.col("level") * F.col("weight")
    rows = rows.withColumn("final", F.min_by(F.when(free, F.col("level")), F.when(free, F.col("top") / F.col("weight"))).over(every))
    return rows.select("source", "source_size", F.coalesce(F.least("top", F.col("final") * F.col("weight")), F.lit(0.0)).alias("target"))


def draw(id_col: str, seed: int) -> Column:
    """A seeded order of documents that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix repeats each document: id, size, source_size, target, repeats, taken, and the columns of keep (kept with each row: keys, not texts).

    Each document is taken floor(target / source size) times whole. What is left of the target goes to the source's documents in
    the order of a seeded hash, whole, until their sizes reach it. The order is cut in slices by the hash's first digits;
    slice sums find the slice in which the target is reached, and only that slice is ordered row by row.
    """
    base = docs.select(
        F.col(id_col), F.col(source_col).alias("source"), word_count(text_col).alias("size"), draw(id_col, seed).alias("u"), F.xxhash64(text_col).alias("tie"), *[F.col(c).alias(f"kept_{c}") for c in keep]
    ).withColumn("slice", F.substring("u", 1, SLICE_DIGITS))
    base = stored(base, "mix")
    slices = stored(base.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "mix-slices")
    targets = water_fill(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)).withColumn(
        "left", F.when(F.col("whole") < max_epochs, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
    )
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        slices.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
        .join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
        .drop("s2")
        .withColumn("state", F.when(F.col("left") <= 0, 0).when(F.col("before") + F.col("slice_size") <= F.col("left"), 2).when(F.col("before") < F.col("left"), 1).otherwise(0))
    )
    plan = stored(plan, "mix-plan").withColumnsRenamed({"source": "s2", "slice": "v2"})
    rows = base.join(plan, F.col("source").eqNullSafe(F.col("s2")) & (F.col("slice") == F.col("v2"))).drop("s2", "v2")
    within = Window.partitionBy("source", "slice").orderBy("u", F.col(id_col), "tie")
    edge = rows.where("state = 1").withColumn("sum", F.col("before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("more", F.when(F.col("sum") - F.col("size") / 2 <= F.col("left"), 1).otherwise(0)).drop("sum")
    sure = rows.where("state <> 1").withColumn("more", F.when(F.col("state") == 2, 1).otherwise(0))
    out = sure.unionByName(edge).withColumn("repeats", (F.col("whole") + F.col("more")).cast("long"))
    return out.select(id_col, "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), *[f"kept_{c}" for c in keep])
