"""Left joins to keyed tables that hold up when one key has a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.operators.ordering import global_rank
from claimspark.session import materialize

HOT_ROWS = 1_000_000  # a key with more rows than this is spread over several tasks
SPREAD = 64
MASK_BLOCKS = 1 << 18  # rows of a key mask with 256 places each: 8 MB of bits, however many keys there are
MOST_HOT = 100_000  # keys that a table of hot keys may hold, as it is sent to every task


def suffix_overlap(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str) -> DataFrame:
    """Rename the columns of `right` that `left` also has (join keys apart)."""
    taken = set(left.columns) - set(on)
    return right.select([F.col(f"`{c}`").alias(c + suffix) if c in taken else F.col(f"`{c}`") for c in right.columns])


def _match(left: DataFrame, right: DataFrame, names: Sequence[tuple[str, str]], null_safe: bool) -> Column:
    tests = [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in names]
    return reduce(lambda x, y: x & y, tests)


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows: at most rows / hot_rows of them, so small by construction."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).drop("_n")


def hot_keys_through(df: DataFrame, key: str, via: DataFrame, target: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hot values of `target` that the rows of `df` will get from `via` (one row per `key`).

    Rows are counted per key before they meet `via`, so the detection itself has no hot key. With their numbers of rows (`_n`).
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    met = counts.join(via.select(key, target), key, "left")
    return met.groupBy(target).agg(F.sum("_n").alias("_n")).where(F.col("_n") > hot_rows)


def checked_hot(counts: DataFrame, columns: Sequence[str], n: str = "_n") -> DataFrame | None:
    """The hot keys of a table of keys and numbers of rows: None if there are none, the hottest if there are more than `MOST_HOT`.

    The table is written once and counted, so what is broadcast later has a known size, and a join
    without hot keys stays a plain one.
    """
    table = materialize(counts, "hot-keys")
    size = table.count()
    if not size:
        return None
    if size > MOST_HOT:
        top = table.orderBy(F.col(n).desc()).limit(MOST_HOT)
        return materialize(top.select(*columns), "hot-keys")
    return table.select(*columns)


def hot_keys_by_column(df: DataFrame, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> dict[str, DataFrame | None]:
    """Hot keys of several key columns from one pass: per column a table of its values, or None if no value is hot.

    A null key counts like a value, for it gathers rows in one task too.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(entries).alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = checked_hot(counts, ["column", "value"])
    if hot is None:
        return dict.fromkeys(columns)
    found = {r["column"] for r in hot.select("column").distinct().collect()}  # one row per key column at most
    types = dict(df.dtypes)
    return {c: hot.where(F.col("column") == c).select(F.col("value").cast(types[c]).alias(c)) if c in found else None for c in columns}


def _mask_place(column: Column) -> tuple[Column, Column]:
    """Block and place within it of a hashed key; a null key has a place too."""
    hashed = F.xxhash64(column.cast("string"))
    return F.pmod(hashed, F.lit(MASK_BLOCKS)).cast("int"), F.pmod(F.shiftright(hashed, 40), F.lit(256)).cast("int")


def key_mask(keys: DataFrame, column: str) -> DataFrame:
    """The places on which the keys of a table fall, at most `MASK_BLOCKS` rows of four words; written once."""
    block, place = _mask_place(F.col(column))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)
    words = [F.bit_or(F.when(F.floor(place / 64) == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(4)]
    return materialize(keys.groupBy(block.alias("_block")).agg(F.array(*words).alias("_words")), "key-mask")


def perhaps_among(df: DataFrame, column: str, mask: DataFrame) -> DataFrame:
    """Rows whose key has a place in the mask: all with a masked key, and few others. They are filtered where they are read."""
    block, place = _mask_place(df[column])
    hit = F.getbit(F.get(mask["_words"], F.floor(place / 64).cast("int")), place % 64) == 1
    return df.join(F.broadcast(mask), (block == mask["_block"]) & hit, "left_semi")


def among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is in `keys`, a table of distinct keys under the name `_wanted`; null is a key like any other."""
    return df.join(keys, df[column].eqNullSafe(keys["_wanted"]), "left_semi")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    suffix: str = "_r",
    null_safe: bool = False,
    spread_by: Sequence[str] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """`left` left-joined to `right`, which has few rows per key (mostly one).

    Rows of the `hot` keys get a salt from `spread_by` and meet copies of their right row,
    so a key with a third of the rows is joined by many tasks. Rows with a null key cannot
    match (unless `null_safe`) and are spread too. Without `hot` this is a plain join, for
    keys that are unique on the left.

    `hot` comes from `hot_keys` of a table that is cheap to read, not of `left`: a chain of
    lookups would otherwise run its first part once more per lookup. `hot_keys_by_column` and `checked_hot` know its size.
    """
    on = [on] if isinstance(on, str) else list(on)
    right = suffix_overlap(left, right, on, suffix)
    extra = [c for c in right.columns if c not in on]
    keyed = right.select(*[F.col(c).alias(f"_k_{c}") for c in on], *extra)
    pairs = [(c, f"_k_{c}") for c in on]
    if hot is None:
        joined = left.join(keyed, _match(left, keyed, pairs, null_safe), "left")
        return joined.select(*left.columns, *extra)

    hot = hot.select(*[F.col(c).alias(f"_h_{c}") for c in on], F.lit(True).alias("_hot"))
    hot_names = [f"_h_{c}" for c in on]
    marked = left.join(F.broadcast(hot), _match(left, hot, list(zip(on, hot_names, strict=True)), null_safe), "left")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by or left.columns]), F.lit(SPREAD)).cast("int")
    loose = F.coalesce(F.col("_hot"), F.lit(False))
    if not null_safe:
        loose = loose | reduce(lambda x, y: x | y, [F.col(c).isNull() for c in on])
    salted = marked.withColumn("_salt", F.when(loose, spread).otherwise(F.lit(0))).drop("_hot", *hot_names)

    copies_of = [(f"_k_{c}", f"_h_{c}") for c in on]
    slots = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    copies = (
        keyed.join(F.broadcast(hot), _match(keyed, hot, copies_of, null_safe), "left")
        .withColumn("_slot", F.explode(slots))
        .drop("_hot", *hot_names)
    )
    joined = salted.join(copies, _match(salted, copies, pairs, null_safe) & (salted["_salt"] == copies["_slot"]), "left")
    return joined.select(*left.columns, *extra)


def rank_aligned_mapping(long_values: DataFrame, short_values: DataFrame, value: str) -> DataFrame:
    """Map the k-th most common value of one table to the k-th of the other.

    Empty when the two tables have different numbers of distinct values. Ties go by value.
    """

    def ranked(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col(value).alias(name)).agg(F.count(F.lit(1)).alias("n"))
        return global_rank(counts, [F.col("n").desc(), F.col(name).asc()], "rank").select(name, "rank")

    left, right = ranked(long_values, "long_value"), ranked(short_values, "short_value")
    sizes = left.agg(F.count(F.lit(1)).alias("_a")).crossJoin(right.agg(F.count(F.lit(1)).alias("_b")))  # one row
    return (
        left.join(right, "rank")
        .crossJoin(F.broadcast(sizes.where(F.col("_a") == F.col("_b"))))
        .select("rank", "long_value", "short_value")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key (null is a key too). Each map task passes on one row per key."""
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by_key)).where(F.col("_rn") == 1).drop("_rn")


def file_order(df: DataFrame) -> list[Column]:
    """The order column of a scan (`_order`) or of a table (`row_no`) if there is one, then all columns."""
    marks = [F.col(c) for c in ("_order", "row_no") if c in df.columns]
    return marks + [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c not in ("_order", "row_no")]


def first_per_key(df: DataFrame, key: str) -> DataFrame:
    """`keep_first` in file order, without the order column."""
    return keep_first(df, [key], file_order(df)).drop("_order", "row_no")


def merge_on_key(tables: Sequence[DataFrame], key: str, null_safe: bool = False) -> DataFrame:
    """Full outer join of tables that share one key, so that all of them shuffle alike."""
    merged = tables[0]
    for table in tables[1:]:
        if null_safe:
            right = table.withColumnRenamed(key, "_key")
            merged = merged.join(right, merged[key].eqNullSafe(right["_key"]), "full")
            merged = merged.withColumn(key, F.coalesce(key, "_key")).drop("_key")
        else:
            merged = merged.join(table, key, "full")
    return merged


def duplicate_row_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows share their key with another row."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint")
    return counts.agg(total.alias("duplicate_rows"))
