"""A blocked Bloom filter as DataFrame expressions.

It has a fixed number of 256-bit blocks, so its broadcast has a proven bound at any number
of keys (65,536 blocks of four longs: 2 MB of bits). More keys only raise the share of
possible hits. Each key sets eight bits of one block, two in each of its four words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 65_536
#: Upper bound of `blocks`: what a broadcast of the filter may hold.
MOST_BLOCKS = 262_144
_WORDS = 4
_BITS_PER_WORD = 2


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column, word: int) -> Column:
    """The bits that a key sets in one word of its block."""
    digest = F.xxhash64(F.lit(word + 1), key)
    out = None
    for j in range(_BITS_PER_WORD):
        place = F.shiftrightunsigned(digest, 6 * j + 20).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def build_filter(listed: DataFrame, key: str = "canonical", blocks: int = BLOCKS) -> DataFrame:
    """One row per used block: block, w0 .. w3. At most `blocks` rows."""
    if not 1 <= blocks <= MOST_BLOCKS:
        raise ValueError(f"blocks must be between 1 and {MOST_BLOCKS}")
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(*[F.bit_or(_mask(F.col(key), i)).alias(f"w{i}") for i in range(_WORDS)])


def possible_hits(urls: DataFrame, bloom: DataFrame, key: str = "canonical", blocks: int = BLOCKS) -> DataFrame:
    """`urls` with a boolean `possible`: false means that the key isn't listed."""
    hit = F.col("w0").isNotNull()
    for i in range(_WORDS):
        mask = _mask(F.col(key), i)
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    # At most MOST_BLOCKS rows of five numbers.
    joined = urls.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(bloom), "block", "left")
    return joined.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("block", *[f"w{i}" for i in range(_WORDS)])


def drop_listed(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of `df` whose `key` is not in the column `key` of `gone`.

    Rows that the filter lets pass are certain to stay and are not shuffled; the exact
    join looks at the possible hits alone.
    """
    tested = possible_hits(df, build_filter(gone, key), key)
    certain = tested.filter("not possible").drop("possible")
    return certain.unionByName(tested.filter("possible").drop("possible").join(gone.select(key), key, "left_anti"))
