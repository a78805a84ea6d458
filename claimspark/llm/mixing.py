"""Mix sources to target weights by Pareto order sampling.

A source whose target is f times its size takes floor(f) certain copies of each document.
The rest of the target is a sample: each document gets a random odds u / (1 - u) from a
seeded draw, divided by its inclusion odds, and documents are taken in that order until
their words fill the rest. The inclusion odds grow with the square root of the size, as a
long document spends the rest in fewer, cheaper pieces; the order of a Pareto sample only
depends on the ratio of the odds, so no scale has to be solved for.

The order is cut without sorting a source: words per source and rank block are summed,
the block that holds the cut is divided again, and only what is left of it is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import WORD, materialize, text_of

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 20
#: Rank blocks per level; two levels leave about a 16-millionth of a source to order.
BLOCKS = 4096


def size_of(text: Column) -> Column:
    """Words in the text: word characters without one before them."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A seeded draw in (0, 1) that only depends on the key: the first 52 bits of its md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources are ordered by code point, null last, and weigh `weights`, repeating. They share
    `share` of all sizes by weight; a target above `most` times its source's size stops there
    and the excess is shared by weight among the others until none is above.
    """
    per_source = materialize(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "sources")
    # One row per source: the number of sources, not of documents, meets in these windows.
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(place == i, F.lit(w)).otherwise(weight)
    table = per_source.withColumn("weight", weight.cast("long"))
    # Level of a cut: what is left for the sources after it, per unit of weight, if all before it stop at their limit.
    # In the order of limit / weight the level rises up to the right cut and falls after it.
    table = table.withColumn("limit", F.lit(most).cast("long") * F.col("source_size"))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    stopped, passed = F.coalesce(F.sum("limit").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - stopped
    table = table.withColumn("level", left / (F.sum("weight").over(everything) - passed)).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.col("level"))
    return table.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def _rank(seed: int) -> Column:
    """Random odds divided by inclusion odds, for rows with id, size and share (the part of the source to sample)."""
    u = uniform(F.col("id"), seed)
    # Null where nothing is to be sampled: a share of 0 or a document without words.
    return F.try_divide(u / (F.lit(1.0) - u), F.col("share") / (F.lit(1.0) - F.col("share")) * F.sqrt(F.col("size").cast("double")))


def _place(level: int) -> Column:
    """Block of a rank at a level, in rank order; each block of a level lies in one block of the level above."""
    return F.floor(F.col("rank") / (F.lit(1.0) + F.col("rank")) * F.lit(float(BLOCKS**level))).cast("long")


def _cut_block(rows: DataFrame, level: int) -> DataFrame:
    """Per source: the block in which the running sum of words reaches the rest, and the words before it."""
    sums = rows.groupBy("key", "rest", "base", _place(level).alias("block")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # BLOCKS rows at most
    run = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut = run.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
    return cut.select("key", F.col("block").alias("cut"), F.col("before").alias("base"))


def source_cuts(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per source: key, target, source_size, certain copies, share and the cut (rank, id) of its sample.

    A document is in the sample if its (rank, id) is at most the cut. The document at the
    border is in if that brings the sum nearer to the target.
    """
    plan = targets.withColumn("key", _source_key(F.col("source"))).withColumn("certain", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)))
    plan = plan.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    plan = materialize(plan.withColumn("share", F.coalesce(F.try_divide(F.col("rest"), F.col("source_size")), F.lit(0.0))).drop("source"), "mixing-plan")
    open_rows = plan.filter("rest > 0").select("key", "rest", "share")
    rows = sized.filter("size > 0").withColumn("key", _source_key(F.col("source"))).join(open_rows, "key")
    rows = rows.select("key", "rest", "id", "size", _rank(seed).alias("rank"), F.lit(0).cast("long").alias("base"))
    first = materialize(_cut_block(rows, 1), "mixing-cut")
    within = rows.drop("base").join(first, "key").filter(_place(1) == F.col("cut"))
    within = materialize(within.drop("cut"), "mixing-cut")
    second = _cut_block(within, 2)
    last = within.drop("base").join(second, "key").filter(_place(2) == F.col("cut"))
    before = Window.partitionBy("key").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, -1)  # about a 16-millionth of a source
    run = last.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    spot = F.struct(F.col("rank"), F.col("id"))
    inside = F.col("before") + F.col("size") / F.lit(2.0) < F.col("rest")
    border = run.groupBy("key").agg(F.max(F.when(inside, spot)).alias("upto"), F.min(spot).alias("start"), F.first("cut").alias("cut"))
    return materialize(plan.join(border, "key", "left"), "mixing-cuts")


def _taken_copies(seed: int) -> Column:
    """Copies of a row that has id, size and the columns of its source's cut."""
    rank = _rank(seed)
    at_or_below = F.struct(rank.alias("rank"), F.col("id")) <= F.col("upto")
    below_block = F.struct(rank.alias("rank"), F.col("id")) < F.col("start")
    sampled = (F.col("rest") > 0) & (F.col("size") > 0) & (below_block | F.coalesce(at_or_below, F.lit(False)))
    return (F.col("certain") + F.coalesce(sampled, F.lit(False)).cast("long")).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    return materialize(narrow, "sizes")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **targets) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, copies, taken (words, repeats counted).

    Null and empty texts have size 0 and take nothing. Sources without words have the target 0.
    Repeated rows have the same rank and are taken alike. The draw depends on the identifier and
    the seed, so reruns and other partitionings agree. An empty table gives an empty table.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    cuts = source_cuts(sized, source_targets(sized, **targets), seed)
    joined = sized.withColumn("key", _source_key(F.col("source"))).join(cuts, "key").withColumn("copies", _taken_copies(seed))
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **targets) -> DataFrame:
    """The mixture itself: every row of `docs` as often as it is taken, with its columns.

    Whether a row is taken only depends on the row and its source's cut, so the texts are not shuffled
    as long as the table of sources is small enough to be sent to the tasks.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    cuts = source_cuts(sized, source_targets(sized, **targets), seed)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(id_col).alias("id"),
        size_of(F.col(text_col)).alias("size"),
        _source_key(F.col(source_col)).alias("key"),
    )
    counted = packed.join(cuts, "key").withColumn("copies", _taken_copies(seed))
    copies = counted.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copies.select([F.col("doc").getField(c).alias(c) for c in docs.columns])
