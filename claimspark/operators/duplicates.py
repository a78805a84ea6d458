"""Claims that repeat an earlier claim of the same patient.

Each group's original is one map-side combined minimum; the other rows look it up. No
group is gathered, and no pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.values import bucket_50, is_true, relative_difference
from claimspark.operators.joins import HOT_ROWS, key_mask, lookup_join, perhaps_among
from claimspark.session import materialize

MAX_RATIO = 0.2
TAG_BITS = 40  # of a group's hash, by which rows are counted first


def _group_key(kind: int, *values: Column) -> Column:
    """Key of a group, or null if a value is missing. The length of the first value keeps keys apart."""
    text = [v.cast("string") for v in values]
    key = F.concat_ws("|", F.lit(str(kind)), F.length(text[0]).cast("string"), *text)
    present = F.lit(True)
    for v in values:
        present = present & v.isNotNull()
    return F.when(present, key)


def duplicate_evidence_table(pool: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Claims that repeat another: `claim_id` and `dup_visit`, `dup_bucket`, `dup_similar` (records or null).

    A claim can match in three ways: same patient and visit day, same patient and amount
    bucket (both against the earliest billed claim of the group), or an amount within a
    fifth of the patient's lowest. `pool` needs unique claim ids and should be a written
    table; only six of its columns are read.

    Each row is looked at under its three keys at once. Rows alone in their group leave first: hashed keys are counted, and a
    mask of those that come again filters the scan. Then one aggregate finds the originals of all
    groups and which groups are hot, one join brings them back, and one aggregate puts a claim's records together.
    """
    narrow = pool.select(
        "claim_id",
        "patient_id",
        "visit_dt",
        bucket_50(F.col("billed_amount")).alias("billed_bucket"),
        "billed_amount",
        "claim_billing_dt",
    )
    patient = F.col("patient_id")
    keys = F.array(_group_key(1, patient, F.col("visit_dt")), _group_key(2, patient, F.col("billed_bucket")), _group_key(3, patient))
    rows = narrow.select("*", F.posexplode(keys).alias("_kind", "_group")).where(F.col("_group").isNotNull())
    rows = rows.withColumn("_tag", F.shiftrightunsigned(F.xxhash64("_group"), 64 - TAG_BITS))
    again = rows.groupBy("_tag").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = perhaps_among(rows, "_tag", key_mask(again, "_tag")).drop("_tag")
    # the earliest billed claim, or in groups of the third kind the one with the lowest amount
    by_amount = F.col("_kind") == 2
    order = F.struct(
        F.when(by_amount, F.col("billed_amount").isNull()).otherwise(F.col("claim_billing_dt").isNull()).alias("missing"),
        F.when(~by_amount, F.col("claim_billing_dt")).alias("billed_on"),
        F.when(by_amount, F.col("billed_amount")).alias("amount"),
        "claim_id",
        "billed_amount",
        "visit_dt",
    )
    groups = rows.groupBy("_group").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = materialize(groups, "duplicate-groups")
    hot = groups.where(F.col("_n") > hot_rows).select("_group")  # at most three times rows / hot_rows groups
    met = lookup_join(rows, groups.drop("_n"), "_group", spread_by=["claim_id"], hot=hot).where("_first is not null")

    first = F.col("_first")
    other = F.col("claim_id") != first["claim_id"]
    difference = F.abs(F.coalesce(F.col("billed_amount"), F.lit(0.0)) - F.coalesce(first["billed_amount"], F.lit(0.0)))
    pair = F.struct(
        first["claim_id"].alias("original_claim_id"),
        F.lit(True).alias("same_patient"),
        difference.alias("amount_diff"),
        is_true(F.col("visit_dt") == first["visit_dt"]).alias("visit_match"),
        F.col("billed_bucket").alias("bucket"),
    )
    ratio = relative_difference(F.col("billed_amount"), first["billed_amount"])
    similar = F.struct(
        first["claim_id"].alias("original_claim_id"),
        F.lit(True).alias("same_patient"),
        ratio.alias("amount_ratio"),
        F.lit(False).alias("visit_match"),
        F.col("billed_bucket").alias("bucket"),
    )
    repeats = met.where(other & ((F.col("_kind") != 2) | is_true(ratio <= MAX_RATIO)))
    # a claim has one row per kind
    return repeats.groupBy("claim_id").agg(
        F.max(F.when(F.col("_kind") == 0, pair)).alias("dup_visit"),
        F.max(F.when(F.col("_kind") == 1, pair)).alias("dup_bucket"),
        F.max(F.when(F.col("_kind") == 2, similar)).alias("dup_similar"),
    )
