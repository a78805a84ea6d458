"""Exact duplicates by a tree merge of sorted digest runs.

Every partition of the digest table is a run: its distinct digests with the smallest
identifier and the number of rows. The runs are dealt once by ranges of digests and sorted, so that each task holds
the same piece of every run. Then, in each round, run 2k and run 2k + 1 are merged in order: equal digests
meet, and the smallest identifier stays. After log2(runs) rounds one sorted run is left. A digest only counts as
equal if the byte length and a second hash agree as well, in every round. The rounds move no row between tasks.

A run is never one task, and a digest that holds a third of all rows is at most one row per run when it is dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.bloom import drop_listed
from claimspark.llm.common import materialize, text_of

FAN_IN = 2
_KEY = ("digest", "n_bytes", "check")


def normalized(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is the empty text."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow, written row per input row: identifier, row number, run and the digest triple."""
    norm = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("norm"))
    narrow = norm.select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
    )
    return materialize(narrow, "digests")


def merge_runs(digests: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per different text: the digest triple, the smallest (identifier, row) and the number of rows.

    Ties on the identifier go to the smaller row number; a null identifier comes last. `fan_in` neighbouring runs become one
    per round.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    runs = (digests.agg(F.max("run")).first()[0] or 0) + 1
    first = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col("row").alias("row"))
    level = digests.groupBy("run", *_KEY).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size"))
    # A range of digests is a subset of the grouping keys, so Spark needs no further exchange below.
    level = level.repartitionByRange("digest").sortWithinPartitions(*_KEY, "run")
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.groupBy(*_KEY, F.floor(F.col("run") / fan_in).cast("int").alias("run")).agg(F.min("first").alias("first"), F.sum("size").alias("size"))
    return level.select(*_KEY, F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id_col, row, digest (binary), keep_id, group_size, kept.

    Of rows with equal normalised texts the one with the smallest identifier is kept;
    repeated identifiers keep one row. Null texts count as empty. An empty table gives an
    empty table. Other input columns are ignored.
    """
    digests = digest_table(docs, id_col, text_col)
    groups = merge_runs(digests, fan_in)
    # Only texts with several rows are looked up, by a join whose left side Spark can split.
    several = groups.filter("size > 1")
    joined = digests.join(several, list(_KEY), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "row",
        "digest",
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row"))).alias("kept"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `exact_groups` drops; all columns stay."""
    names = docs.columns
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
        _row_key(F.col(id_col), F.unhex(F.sha2(normalized(F.col(text_col)), 256))).alias("key"),
    )
    groups = exact_groups(docs, id_col, text_col).filter("group_size > 1")
    groups = groups.groupBy(_row_key(F.col(id_col), F.col("digest")).alias("key")).agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("rows"))
    groups = materialize(groups, "exact-groups")
    kept = drop_listed(marked, "key", groups.filter("not any_kept"))
    # Rows that repeat both identifier and text can't be told apart: one of them stays.
    twice = groups.filter("any_kept and rows > 1")
    if twice.limit(1).count():
        kept = drop_listed(kept, "key", twice).unionByName(kept.join(twice.select("key"), "key", "left_semi").dropDuplicates(["key"]).select("doc", "key"))
    return kept.select([F.col("doc").getField(c).alias(c) for c in names])


def _row_key(key: Column, digest: Column) -> Column:
    return F.concat(digest, F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
