"""Mixing sources to target weights, in DataFrame functions only.

Capped water-filling: every source gets its weight's share of all words, but at most `epochs` times its own size; what a
clamped source can't take is shared out again by weight. With sources in the order of size / weight, the level at which
clamping all sources before i leaves the rest is (total - their caps) / (weights from i on). It rises while sources have to be
clamped and falls afterwards, so its largest value is the level at which no further source is above its cap, and a target is
min(cap, weight * level). This is the fixed point of the repeated redistribution, without repeating it.

A document is taken whole floor(target / size of the source) times; the rest of the target is met by taking documents once more in
the order of a seeded digest, up to the one whose middle passes the rest. Running totals are kept within (source, digest
range), so a source with most of the rows is spread over all ranges; only the sums of ranges and one row per source go further.

Defined cases: a null or empty text has size 0 and is taken 0 words; null is a source of its own, last in order; equal rows are
taken alike or differ by one repetition; an empty table gives no rows; further columns are ignored; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winback.llm.common import cut, only

EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 42
#: Hex digits of the digest that make a range: 4096 ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key(source: Column) -> list[Column]:
    """The source as two columns that join and sort null after all names."""
    return [source.isNull().alias("unnamed"), F.coalesce(source, F.lit("")).alias("name")]


def digest(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(unnamed, name, source_size, target): one row per source. The windows here see one row per source."""
    sums = sized.groupBy("unnamed", "name").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy("unnamed", "name")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (order % len(weights) + 1).cast("int"))
    ordered = Window.orderBy(F.col("source_size") / F.col("weight"), "unnamed", "name")
    before, onward = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * epochs).over(before), F.lit(0))
    leveled = sums.withColumn("weight", weight).withColumn("level", left / F.sum("weight").over(onward))
    return leveled.select("unnamed", "name", "source_size",
                          F.least((F.col("source_size") * epochs).cast("double"), F.col("weight") * F.max("level").over(everything)).alias("target"))


def placed(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: int) -> DataFrame:
    """Sizes and targets of every document with whole, the times its source is taken in full, and once_more, whether it is taken once more."""
    sized = cut(only(docs, doc_id="doc_id", source="source", text="text").select(
        "doc_id", *key(F.col("source")), word_count(F.col("text")).alias("size"), digest(F.col("doc_id"), seed).alias("draw"))
        .withColumn("range", F.substring("draw", 1, RANGE_DIGITS)), "mix-sizes")
    keys = ["unnamed", "name", "range"]
    inside = Window.partitionBy(*keys).orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranges = sized.groupBy(*keys).agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("unnamed", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = ranges.join(targets(sized, weights, epochs), ["unnamed", "name"]).select(
        *keys, "source_size", "target", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead"))
    rows = sized.withColumn("upto", F.sum("size").over(inside)).join(plan, keys)
    middle = F.col("ahead") + F.col("upto") - F.col("size") / 2
    return rows.withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))).withColumn(
        "once_more", (F.col("size") > 0) & (middle <= F.col("target") - F.col("whole") * F.col("source_size")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    return placed(docs, weights, epochs, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("once_more").cast("long"))).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it. One row per source, with the last place taken once more, is joined to the texts."""
    place = lambda *c: F.struct(*[x.alias(n) for n, x in zip(("draw", "doc_id", "size"), c)])
    last = cut(placed(docs, weights, epochs, seed).groupBy("unnamed", "name").agg(
        F.max("whole").alias("whole"), F.max(F.when(F.col("once_more"), place(F.col("draw"), F.col("doc_id"), F.col("size")))).alias("last")), "mix-places")
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, source, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "source", "text"))
    rows = own.select("*", *key(source), place(digest(doc_id, seed), doc_id, word_count(text)).alias("place")).join(last, ["unnamed", "name"])
    times = F.when(F.col("place.size") > 0, F.col("whole") + F.coalesce(F.col("place") <= F.col("last"), F.lit(False)).cast("long")).otherwise(0)
    turns = F.explode(F.array_repeat(F.lit(1), times.cast("int")))
    return rows.select(*own.columns, turns.alias("turn")).drop("turn").toDF(*names)
