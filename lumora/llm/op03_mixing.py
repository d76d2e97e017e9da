"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents are shuffled by a hash. Each copy of a document finishes at the virtual time: words of its source up to and including it,
divided by its source's target. The copies are ranged by that time and cut where they fill the budget.
Running sums are taken within ranges of some thousands of rows, on top of the sums of the ranges before, so
no source and no sort lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.session import cut

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 4_000  # rows in a range of a running sum, about; one with four times as many is split
SMALL_ROWS = 100_000  # a table of so many narrow rows at most may be broadcast


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has been counted to be small."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def running(df: DataFrame, order: str, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of `value` over the rows of lower `order` (a long, unique among those equal in `by`) as `name`, in two levels."""
    df = df.withColumn("_block", F.expr(f"{order} div 1024"))
    blocks = df.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(blocks, [*by, "_block"]).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_block", "_base")


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sources(source, ...) with rank and weight: by code point, null last, the weights repeating."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*map(F.lit, weights))
    return sources.withColumn("rank", rank).withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))


def targets(sources: DataFrame, budget: Column, max_repeats: int) -> DataFrame:
    """sources(source, rank, weight, total) with target: the budget by weight, none above max_repeats * total, the excess reshared.

    The level at which all shares stand is found on the sources in the order in which they reach their cap.
    """
    cap = F.col("total") * max_repeats
    order = Window.orderBy(cap / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("budget", budget)
    df = df.withColumn("left", F.col("budget") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    df = df.withColumn("open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    df = df.withColumn("level", F.col("left").cast("double") / F.col("open"))
    fits = cap >= F.col("level") * F.col("weight")
    df = df.withColumn("level", F.min(F.when(fits, F.struct(cap / F.col("weight"), "rank", "level"))).over(Window.partitionBy())["level"])
    target = F.least(cap.cast("double"), F.col("level") * F.col("weight"))
    return df.withColumn("target", F.coalesce(target, cap.cast("double"))).drop("left", "open", "level", "budget")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for each row of docs(doc_id, source, text).

    size counts the words of the text (null, empty or blank: 0); the budget is all words. A document is taken whole,
    `copies` times from 0 to max_repeats. Null sources are one source, the last. Rows without words are never taken.
    Rows of one doc_id follow one another in the shuffle, in no defined order, each with copies of its own; so do those whose doc_id
    is null, as the empty id. Other columns are ignored, but for those named in `keep`, which come out too. An empty
    table gives an empty result.
    """
    sized = docs.select("doc_id", "source", *keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = cut(sized.withColumns({"shuffle": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), "row": F.monotonically_increasing_id()}))
    sources = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("rows"))
    sources = cyclic_weights(sources, weights)
    sources = cut(targets(sources, F.sum("total").over(Window.partitionBy()), max_repeats))
    budget = sources.agg(F.sum("total")).first()[0] or 0
    named = sized.join(_small(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranged = named.withColumn("range", F.expr(f"shiftright(cast(conv(substring(shuffle, 1, 8), 16, 10) as bigint) * (1 + rows div {RANGE_ROWS}), 32)"))
    crowded = ranged.groupBy("rank", "range").agg(F.count("*").alias("n")).where(F.col("n") > 4 * RANGE_ROWS)  # rows of repeated doc_ids
    crowded = cut(crowded.select("rank", "range", F.expr(f"least(n div {RANGE_ROWS}, 1048575)").alias("parts")))
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    ranged = ranged.join(_small(crowded), ["rank", "range"], "left").withColumn("range", F.shiftleft("range", 20) + part).drop("parts")
    sums = ranged.groupBy("rank", "range").agg(F.sum("size").alias("sum")).withColumn("at", F.shiftright("range", 20))
    whole = cut(running(sums.groupBy("rank", "at").agg(F.sum("sum").alias("sum")), "at", "sum", "base", ("rank",)))
    earlier = Window.partitionBy("rank", "at").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.join(_small(whole.drop("sum")), ["rank", "at"]).select("rank", "range", (F.col("base") + F.coalesce(F.sum("sum").over(earlier), F.lit(0))).alias("base"))
    so_far = F.sum("size").over(Window.partitionBy("rank", "range").orderBy("shuffle", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0))
    sums = cut(sums)
    queued = cut(ranged.join(_small(sums), ["rank", "range"]).withColumn("upto", F.col("base") + so_far).select("doc_id", "source", *keep, "size", "shuffle", "rank", "total", "target", "upto"))

    def finish(copy: Column) -> Column:
        return F.try_divide((F.col("upto") + copy * F.col("total")).cast("double"), F.col("target"))

    passes = F.ceil(F.try_divide(F.col("target"), F.col("total"))).cast("int")
    copies = queued.where("size > 0 and target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), passes - 1)))
    copies = copies.select("size", "rank", "shuffle", "doc_id", "copy", finish(F.col("copy")).alias("finish"))
    ranges = 1 + max_repeats * queued.count() // RANGE_ROWS
    slot = lambda time: F.floor(time * ranges).cast("long")
    slots = running(copies.groupBy(slot(F.col("finish")).alias("slot")).agg(F.sum("size").alias("sum")), "slot", "sum", "base")
    last = slots.where(F.col("base") < budget).agg(F.max(F.struct("slot", "base")).alias("x")).first().x
    if last is None:
        taken_copies = F.lit(0)
    else:
        order = Window.partitionBy("slot").orderBy("finish", "rank", "shuffle", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
        at_end = copies.withColumn("slot", slot(F.col("finish"))).where(F.col("slot") == last.slot).withColumn("upto", F.sum("size").over(order))
        key = ("finish", "rank", "shuffle", "doc_id", "copy")
        edge = at_end.where(F.col("upto") + last.base <= budget).agg(F.max(F.struct(*key)).alias("x")).first().x
        taken_copies = F.lit(0)
        for copy in range(max_repeats):
            time = finish(F.lit(copy))
            inside = slot(time) < last.slot
            if edge is not None:
                here = F.struct(time.alias("finish"), "rank", "shuffle", "doc_id", F.lit(copy).alias("copy"))
                there = F.struct(F.lit(edge.finish).alias("finish"), F.lit(edge["rank"]).alias("rank"), F.lit(edge.shuffle).alias("shuffle"), F.lit(edge.doc_id).cast("long").alias("doc_id"), F.lit(edge["copy"]).alias("copy"))
                inside = inside | ((slot(time) == last.slot) & (here <= there))
            taken_copies += F.when((F.lit(copy) < passes) & inside, 1).otherwise(0)
        taken_copies = F.when((F.col("size") > 0) & (F.col("target") > 0), taken_copies).otherwise(0)
    out = queued.withColumn("copies", taken_copies.cast("int"))
    return out.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *keep)
