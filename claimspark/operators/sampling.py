"""Samples of an exact size, as a filter.

Rows are ordered by their seeded draw. The n-th smallest draw is found from counts per
leading bits, so no row is sorted or moved to sample: the sample is then
`draw <= cutoff`, evaluated where the rows already are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.draws import DRAW_BITS, draw
from claimspark.session import materialize

_LEVEL_BITS = 12  # 4,096 counters per pass
_SMALL_BUCKET = 5_000


@dataclass(frozen=True)
class Cut:
    """Takes every row up to (draw, key). `draw` None with `all` False takes none."""

    all: bool = False
    draw: int | None = None
    key: str | None = None

    def takes(self, draw_col: Column, key_col: Column) -> Column:
        if self.all:
            return F.lit(True)
        if self.draw is None:
            return F.lit(False)
        at = F.lit(self.draw)
        return (draw_col < at) | ((draw_col == at) & (_text(key_col) <= F.lit(self.key)))


def _text(key: Column) -> Column:
    """Keys compare as text; null is the empty text, for its draw too."""
    return F.coalesce(key.cast("string"), F.lit(""))


def find_cut(df: DataFrame, n: int, draw_col: str, key_col: str) -> Cut:
    """The cut that takes exactly n rows of `df` (all of them if there are fewer).

    `key_col` must be unique; null counts as one key. One to five passes that only count by a few bits of the draw.
    """
    if n <= 0:
        return Cut()
    rows, left, shift = df.select(draw_col, _text(F.col(key_col)).alias(key_col)), n, DRAW_BITS
    while True:
        shift -= _LEVEL_BITS
        counts = rows.groupBy(F.shiftright(draw_col, shift).alias("bucket")).count().collect()  # at most 2^12 rows
        chosen = None
        for bucket, count in sorted((r["bucket"], r["count"]) for r in counts):
            if left <= count:
                chosen = (bucket, count)
                break
            left -= count
        if chosen is None:
            return Cut(all=True)
        rows = rows.where(F.shiftright(draw_col, shift) == chosen[0])
        if chosen[1] <= _SMALL_BUCKET or shift == 0:
            break
    last = rows.orderBy(draw_col, key_col).limit(left).collect()[-1]
    return Cut(draw=last[draw_col], key=last[key_col])


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement; all rows if there are not more, none if n <= 0.

    `key` must be unique: rows that share a key, null too, are taken or left together.
    """
    pool = materialize(df.select(draw(F.col(key), seed).alias("_draw"), key), "draws")
    cut = find_cut(pool, n, "_draw", key)
    return df.where(cut.takes(draw(F.col(key), seed), F.col(key).cast("string")))


def downsample_negatives(df: DataFrame, positive: Column, key: str, rate: float = 0.35, seed: int = 42) -> DataFrame:
    """Keep every positive row and as many others as make positives `rate` of the whole."""
    positive = F.coalesce(positive, F.lit(False))
    sizes = df.agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")).collect()[0]
    keep = int(sizes["pos"] / rate) - sizes["pos"]
    if keep >= sizes["neg"]:
        return df
    pool = materialize(df.where(~positive).select(draw(F.col(key), seed).alias("_draw"), key), "draws")
    cut = find_cut(pool, keep, "_draw", key)
    return df.where(positive | cut.takes(draw(F.col(key), seed), F.col(key).cast("string")))


def split_by_group(df: DataFrame, group: str, eval_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `split` (train/eval) so that no group is in both; `eval_share` of the groups go to eval."""
    groups = materialize(df.select(group).distinct().withColumn("_draw", draw(F.col(group), seed)), "groups")
    total = groups.count()
    wanted = -int(-eval_share * total // 1)
    cut = find_cut(groups, wanted, "_draw", group)
    in_eval = cut.takes(draw(F.col(group), seed), F.col(group).cast("string"))
    return df.withColumn("split", F.when(in_eval, "eval").otherwise("train"))
