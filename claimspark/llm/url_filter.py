"""Block listed URLs: a blocked Bloom filter passes possible hits to an exact hash join.

Only possible hits are shuffled to the join; the exact join decides, so false positives of
the filter never show.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.bloom import BLOCKS, build_filter, possible_hits
from claimspark.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, ASCII letters lower-cased; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without `www.`, a closing slash or `.html`; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/+|\.html?)\z", ""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Index into `rules` of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("int")
    for i, rule in sorted(enumerate(rules), key=lambda x: len(x[1].name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, listed.

    The longest fitting rule decides; without one, a listed canonical URL is blocked and
    any other allowed. `listed` has a column `url`; nulls and repeats in it don't count,
    and neither does a URL without `://`. Null URLs of pages get empty host and path and are allowed.
    """
    names = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("canonical")).filter("canonical != ''").distinct()
    names = materialize(names, "listed-urls")
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = parts.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    tested = possible_hits(parts, build_filter(names, blocks=blocks), blocks=blocks)
    hits = tested.filter("possible").join(names.withColumn("listed", F.lit(True)), "canonical", "left")
    rest = tested.filter("not possible").withColumn("listed", F.lit(False))
    both = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(rest)
    index = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = both.withColumn("rule_no", index)
    name, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    for i, rule in enumerate(rules):
        name = F.when(F.col("rule_no") == i, F.lit(rule.name)).otherwise(name)
        verdict = F.when(F.col("rule_no") == i, F.lit(rule.verdict)).otherwise(verdict)
    return ruled.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), verdict.alias("verdict"), "listed")
