"""Per-encounter and per-claim summaries.

Each child table is grouped once. Every aggregate combines on the map side, and the
sets it carries are no larger than the cell they end up in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import is_blank, normalize_filter_text
from claimspark.functions.values import to_number
from claimspark.operators.joins import among, key_mask, perhaps_among
from claimspark.session import materialize

MANY_ROWS = 100_000  # child rows of one encounter that may be listed in one cell of a task
ROW_BUCKETS = 1 << 16  # groups of encounters whose rows are counted together first


def sorted_set(c: Column) -> Column:
    return F.sort_array(F.collect_set(c))


def pipe_set(c: Column) -> Column:
    """Sorted distinct values joined by '|', without nulls."""
    return F.concat_ws("|", sorted_set(c.cast("string")))


def pipe_set_no_blank(c: Column) -> Column:
    """As `pipe_set`, and blank values are left out; other values are not trimmed."""
    return pipe_set(F.when(~is_blank(c), c))


def any_yes(c: Column) -> Column:
    return F.when(F.bool_or(normalize_filter_text(c) == "yes"), "Yes").otherwise("No")


@dataclass(frozen=True)
class Child:
    """A child table with its code column, the prefix of its summary, and optionally a description column."""

    table: DataFrame
    code: str
    prefix: str
    desc: str | None = None
    codes_name: str | None = None


def child_profiles(children: Sequence[Child], key: str, keep_blank: bool = True, wanted: DataFrame | None = None) -> DataFrame:
    """Summaries of several child tables, one row per key: rows, distinct codes, and pipe lists of codes and descriptions.

    The tables are stacked as (key, table, field, value) and counted per value, which spreads a key with many rows
    over its values, the null key too; one more grouping by key makes all cells, to which the counted values are moved as
    they are: a key's values lie apart, so lists begun before the move would only add empty lists. `keep_blank` leaves blank codes in the lists. With `wanted`
    (a table of keys) only these keys are summarised, the null key if it is among them.
    """
    parts = []
    if wanted is not None:
        mask = key_mask(wanted, key)
        children = [replace(child, table=perhaps_among(child.table, key, mask)) for child in children]
    for i, child in enumerate(children):
        fields = [F.struct(F.lit("code").alias("_field"), F.col(child.code).cast("string").alias("_value"))]
        if child.desc:
            fields.append(F.struct(F.lit("desc").alias("_field"), F.col(child.desc).cast("string").alias("_value")))
        parts.append(child.table.select(key, F.lit(i).alias("_table"), F.explode(F.array(*fields)).alias("_entry")).select(key, "_table", "_entry.*"))
    stacked = reduce(DataFrame.unionByName, parts)
    if wanted is not None:
        stacked = among(stacked, key, wanted.select(F.col(key).alias("_wanted")).distinct())
    cells = stacked.groupBy(key, "_table", "_field", "_value").agg(F.count(F.lit(1)).alias("_n"))
    out, names = [], []
    for i, child in enumerate(children):
        code = (F.col("_table") == i) & (F.col("_field") == "code")
        desc = (F.col("_table") == i) & (F.col("_field") == "desc")
        listed = F.lit(True) if keep_blank else ~is_blank(F.col("_value"))
        prefix, codes = child.prefix, child.codes_name or f"{child.prefix}_codes"
        out += [
            F.sum(F.when(code, F.col("_n"))).alias(f"{prefix}_count"),
            F.count(F.when(code & F.col("_value").isNotNull(), 1)).alias(f"{prefix}_distinct"),
            F.sort_array(F.collect_list(F.when(code & listed, F.col("_value")))).alias(codes),
        ]
        here = F.col(f"{prefix}_count").isNotNull()
        names += [F.col(f"{prefix}_count"), F.when(here, F.col(f"{prefix}_distinct")).alias(f"{prefix}_distinct"), F.when(here, F.concat_ws("|", codes)).alias(codes)]
        if child.desc:
            out.append(F.sort_array(F.collect_list(F.when(desc & ~is_blank(F.col("_value")), F.col("_value")))).alias(f"{prefix}_descriptions"))
            names.append(F.when(here, F.concat_ws("|", f"{prefix}_descriptions")).alias(f"{prefix}_descriptions"))
    return cells.repartition(key).groupBy(key).agg(*out).select(key, *names)


def child_summary(table: DataFrame, key: str, code: str, prefix: str) -> DataFrame:
    """Rows, distinct codes and the pipe list of codes per key. Null keys are dropped."""
    return child_profiles([Child(table.where(F.col(key).isNotNull()), code, prefix)], key)


def child_summary_text(
    table: DataFrame, key: str, code: str, prefix: str, desc: str | None = None, codes_name: str | None = None
) -> DataFrame:
    """As `child_summary` with descriptions; blanks leave the lists, and null keys stay as a key."""
    return child_profiles([Child(table, code, prefix, desc, codes_name)], key, keep_blank=False)


# List columns of a claim's denials and where they come from
DENIAL_LISTS = {
    "denial_ids": "denial_id",
    "denial_reason_codes": "denial_reason_code",
    "denial_reason_descriptions": "denial_reason_description",
    "denial_dates": "denial_date",
    "appeal_statuses": "appeal_status",
    "appeal_resolution_dates": "appeal_resolution_date",
    "final_outcomes": "final_outcome",
}


def claim_denials(denials: DataFrame, null_claims: bool = True) -> DataFrame:
    """All denials of a claim in one row.

    Denials without claim id are a group of their own if `null_claims`; their values are made distinct one field at a time
    over all tasks before they meet in that group's cells. Pass False where no claim lacks its id.
    """
    amount = F.coalesce(to_number(F.col("denied_amount")), F.lit(0.0))
    measures = [F.sum(amount).alias("denied_amount_sum"), F.max(amount).alias("denied_amount_max"), any_yes(F.col("appeal_filed")).alias("appeal_filed_any")]
    of_claims = (
        denials.where(F.col("claim_id").isNotNull())
        .groupBy("claim_id")
        .agg(*[pipe_set_no_blank(F.col(source)).alias(name) for name, source in DENIAL_LISTS.items()], *measures)
    )
    if not null_claims:
        return of_claims
    lost = denials.where(F.col("claim_id").isNull())
    entries = F.array(*[F.struct(F.lit(name).alias("field"), F.col(source).cast("string").alias("value")) for name, source in DENIAL_LISTS.items()])
    values = lost.select(F.explode(entries).alias("e")).select("e.*").where(~is_blank(F.col("value"))).distinct()
    lists = values.groupBy().agg(*[F.concat_ws("|", F.sort_array(F.collect_list(F.when(F.col("field") == name, F.col("value"))))).alias(name) for name in DENIAL_LISTS])
    totals = lost.groupBy("claim_id").agg(*measures)  # one row, or none
    return of_claims.unionByName(totals.crossJoin(F.broadcast(lists)))  # one row


def top_two(df: DataFrame, key: str, value: str) -> DataFrame:
    """Largest and second largest non-null value per key (equal values count twice).

    The rank filter is applied on the map side too, so each map task passes on at most
    two rows per key.
    """
    order = Window.partitionBy(key).orderBy(F.col(value).desc())
    return (
        df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
        .select(key, value)
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= 2)
        .groupBy(key)
        .agg(
            F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("largest"),
            F.max(F.when(F.col("_rn") == 2, F.col(value))).alias("second_largest"),
        )
    )


def _items(value: str) -> Column:
    """Distinct non-null values of rows grouped per value, with how often each occurs, sorted."""
    pair = F.struct(F.col(value).alias("value"), F.col("_n").alias("n"))
    return F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), pair)))


def _merged_set(c: str) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))


def _first_places(sorted_values: str) -> Column:
    """Where each distinct value of a sorted list begins, in one pass over the list."""
    values = F.col(sorted_values)
    places = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1)))


def _listed_items(df: DataFrame, listed: str, items: str) -> DataFrame:
    """Replace the sorted list `listed` by `items`, as `_items` makes them from rows grouped per value."""
    starts = df.withColumn("_starts", _first_places(listed))

    def item(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("_starts"), i + 1), F.size(listed))
        return F.struct(F.get(F.col(listed), start).alias("value"), (end - start).cast("bigint").alias("n"))

    return starts.withColumn(items, F.transform("_starts", item)).drop("_starts", listed)


def _any_encounter_over(table: DataFrame, many_rows: int) -> bool:
    """Whether an encounter has more than `many_rows` rows.

    Rows are counted per bucket of hashed encounters, so no encounter is shuffled; only those of buckets with
    too many rows are counted one by one.
    """

    def over(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > many_rows).select(key)

    rows = table.select("encounter_id", F.pmod(F.xxhash64("encounter_id"), F.lit(ROW_BUCKETS)).alias("_bucket"))
    full = materialize(over(rows, "_bucket"), "full-buckets")
    if not full.limit(1).count():
        return False
    perhaps = rows.join(F.broadcast(full), "_bucket", "left_semi")  # at most one row per bucket
    return over(perhaps, "encounter_id").limit(1).count() > 0


def diagnosis_profile(diagnoses: DataFrame, code_prefix: str = "Z", many_rows: int = MANY_ROWS) -> DataFrame:
    """Codes, descriptions and flags per encounter.

    One grouping, in which each map task puts the rows of an encounter together. If some encounter has more than
    `many_rows` rows, rows are first grouped per encounter and code, so that it is small before it meets one task.
    """
    diagnoses = diagnoses.where(F.col("encounter_id").isNotNull())
    has_prefix = F.coalesce(F.col("diagnosis_code").startswith(code_prefix), F.lit(False))
    if _any_encounter_over(diagnoses, many_rows):
        per_code = diagnoses.groupBy("encounter_id", "diagnosis_code").agg(
            F.count(F.lit(1)).alias("_n"),
            F.collect_set("diagnosis_description").alias("_descs"),
            F.bool_or("chronic_flag").alias("_chronic"),
            F.bool_or("primary_flag").alias("_primary"),
        )
        profile = per_code.groupBy("encounter_id").agg(
            _merged_set("_descs").alias("diag_descs"),
            F.coalesce(F.bool_or("_chronic"), F.lit(False)).alias("has_chronic"),
            F.bool_or("_primary").alias("has_primary"),
            F.bool_or(has_prefix).alias("has_z_code"),
            _items("diagnosis_code").alias("diag_items"),
        )
    else:
        grouped = diagnoses.groupBy("encounter_id").agg(
            sorted_set(F.col("diagnosis_description")).alias("diag_descs"),
            F.coalesce(F.bool_or("chronic_flag"), F.lit(False)).alias("has_chronic"),
            F.bool_or("primary_flag").alias("has_primary"),
            F.bool_or(has_prefix).alias("has_z_code"),
            F.sort_array(F.collect_list("diagnosis_code")).alias("_codes"),
        )
        profile = _listed_items(grouped, "_codes", "diag_items")
    return profile.withColumn("diag_codes", F.col("diag_items.value"))


def procedure_profile(procedures: DataFrame, many_rows: int = MANY_ROWS) -> DataFrame:
    """Codes, descriptions, text and the two largest costs per encounter, grouped as in `diagnosis_profile`.

    The few columns that are used are written once.
    """
    used = procedures.where(F.col("encounter_id").isNotNull()).select(
        "encounter_id", "procedure_code", F.col("procedure_id").isNotNull().alias("_id"), "procedure_description", "procedure_cost"
    )
    used = materialize(used, "procedures")
    ids = F.count(F.when(F.col("_id"), 1))
    if _any_encounter_over(used, many_rows):
        per_code = used.groupBy("encounter_id", "procedure_code").agg(
            F.count(F.lit(1)).alias("_n"), ids.alias("_ids"), F.collect_set("procedure_description").alias("_descs")
        )
        base = per_code.groupBy("encounter_id").agg(
            F.sum("_ids").alias("proc_count"),
            _merged_set("_descs").alias("proc_descs"),
            _items("procedure_code").alias("proc_items"),
        )
        costs = top_two(used, "encounter_id", "procedure_cost").select(
            "encounter_id", F.col("largest").alias("proc_max_cost"), F.col("second_largest").alias("proc_second_cost")
        )
        base = base.join(costs, "encounter_id", "left")
    else:
        grouped = used.groupBy("encounter_id").agg(
            ids.alias("proc_count"),
            sorted_set(F.col("procedure_description")).alias("proc_descs"),
            F.sort_array(F.collect_list("procedure_code")).alias("_codes"),
            F.sort_array(F.collect_list("procedure_cost"), asc=False).alias("_costs"),
        )
        base = _listed_items(grouped, "_codes", "proc_items").withColumns(
            {"proc_max_cost": F.get("_costs", F.lit(0)), "proc_second_cost": F.get("_costs", F.lit(1))}
        )
    keywords = F.array_join(F.sort_array(F.array_distinct(F.transform("proc_descs", lambda d: F.lower(d)))), " ")
    return base.withColumns({"proc_codes": F.col("proc_items.value"), "proc_keywords": keywords}).select(
        "encounter_id", "proc_count", "proc_descs", "proc_items", "proc_codes", "proc_keywords", "proc_max_cost", "proc_second_cost"
    )


def max_numeric_suffix(df: DataFrame, column: str, prefix: str = "DEN") -> DataFrame:
    """One row: the largest number among ids that are the prefix and digits only; 0 if none."""
    digits = F.regexp_extract(F.col(column), f"^{prefix}([0-9]+)$", 1).try_cast("bigint")
    return df.agg(F.coalesce(F.max(digits), F.lit(0).cast("bigint")).alias("max_number"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts per value; with `top`, the most frequent ones, ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts if top is None else counts.orderBy(F.col("n").desc(), F.col(column).asc_nulls_last()).limit(top)


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives per positive."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg((neg / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def run_summary(claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row of counts over cleaned claims."""
    denied = F.col("claim_status") == "Denied"
    totals = claims.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(denied).alias("denied"),
        F.count_if(~denied).alias("paid"),
        F.count_if(denied & (F.col("denial_reason_clean") == "")).alias("denied_no_reason"),
    )
    return totals.crossJoin(mapping.agg(F.count(F.lit(1)).alias("mapped_reasons")))  # one row each


def label_distribution(df: DataFrame, label: str = "label_denied", by: Sequence[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
