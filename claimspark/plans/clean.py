"""Clean claims, reconcile their denial reasons, and build the enriched table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import normalize_text, strip
from claimspark.operators.aggregates import Child, child_profiles
from claimspark.operators.joins import (
    HOT_ROWS,
    first_per_key,
    checked_hot,
    hot_keys_by_column,
    hot_keys_through,
    lookup_join,
    merge_on_key,
    rank_aligned_mapping,
)
from claimspark.operators.sampling import downsample_negatives, split_by_group
from claimspark.session import materialize
from claimspark.sources.tables import ClaimTables

TARGET_DENIAL_RATE = 0.35
EVAL_SHARE = 0.2

# Columns that give the label away, and columns that identify people
LEAK_COLUMNS = (
    "label_reason", "denial_reason", "denial_reason_norm", "denial_reason_norm_denials", "denial_reason_clean",
    "claim_status", "paid_amount",
)
PII_COLUMNS = (
    "billing_id", "provider_id", "patient_id_enc", "first_name", "last_name", "address", "city", "state", "zip",
    "phone", "email", "registration_date", "name", "department_prov", "contact_info", "email_prov",
)


def _column_or_null(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def paid_or_denied(claims: DataFrame) -> DataFrame:
    """Trim the status, then keep exactly 'Paid' and 'Denied'."""
    return claims.withColumn("claim_status", strip(F.col("claim_status"))).where(
        F.col("claim_status").isin("Paid", "Denied")
    )


def reason_if_denied(reason: Column, status: str = "claim_status") -> Column:
    """Only a denied claim has a reason; others have the empty text."""
    return F.when(F.col(status) == "Denied", reason).otherwise("")


def reconcile_reasons(
    claims: DataFrame, denials: DataFrame, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Claims with `denial_reason_clean`, and the mapping from denial texts to claim texts.

    A denied claim keeps its own normalised reason, else gets the one of its first denial,
    put into the wording of the claims if both sides have equally many distinct reasons.
    """
    claims = paid_or_denied(claims).withColumn(
        "denial_reason_norm", normalize_text(_column_or_null(claims, "denial_reason"))
    )
    denials = denials.withColumn(
        "denial_reason_norm", normalize_text(_column_or_null(denials, "denial_reason_description"))
    )
    denied = F.col("claim_status") == "Denied"
    mapping = materialize(rank_aligned_mapping(denials, claims.where(denied), "denial_reason_norm"), "reasons")
    first = first_per_key(denials, "claim_id").select(
        "claim_id", F.col("denial_reason_norm").alias("denial_reason_norm_denials")
    )
    first = lookup_join(
        first,
        mapping.select(F.col("long_value").alias("denial_reason_norm_denials"), "short_value"),
        "denial_reason_norm_denials",
        spread_by=["claim_id"],
        hot=hot_keys_by_column(
            denials.select(F.col("denial_reason_norm").alias("denial_reason_norm_denials")),
            ["denial_reason_norm_denials"],
            hot_rows,
        )["denial_reason_norm_denials"],
    )
    joined = lookup_join(claims, first, "claim_id", null_safe=True)  # ids are unique on both sides
    other = F.coalesce(F.col("short_value"), F.col("denial_reason_norm_denials"), F.lit(""))
    reason = F.when(F.col("denial_reason_norm") != "", F.col("denial_reason_norm")).otherwise(other)
    cleaned = joined.withColumn("denial_reason_clean", reason_if_denied(reason)).drop("short_value")
    return cleaned, mapping


def clean_claims(claims: DataFrame, denials: DataFrame, balanced: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row per claim id with a clean reason; `balanced` thins the paid claims. Also the mapping."""
    cleaned, mapping = reconcile_reasons(first_per_key(claims, "claim_id"), denials)
    cleaned = materialize(cleaned, "cleaned")  # an output of its own, read several times from here on
    if balanced:
        cleaned = downsample_negatives(cleaned, F.col("claim_status") == "Denied", "claim_id", TARGET_DENIAL_RATE)
    return cleaned, mapping


def clean_variant(raw: ClaimTables, augmented: tuple[DataFrame, DataFrame] | None, variant: str) -> DataFrame:
    """Cleaned claims of the variant 'raw', 'augmented' or 'balanced'."""
    if variant == "augmented":
        if augmented is None:
            raise ValueError("no augmented claims given")
        return clean_claims(*augmented)[0]
    return clean_claims(raw.claims, raw.denials, balanced=variant == "balanced")[0]


def encounter_side(tables: ClaimTables) -> DataFrame:
    """Encounters with the summaries of their four child tables, grouped together; the same for every variant."""
    key = "encounter_id"
    children = [
        Child(tables.diagnoses, "diagnosis_code", "diag"),
        Child(tables.procedures, "procedure_code", "proc"),
        Child(tables.lab_tests, "test_code", "lab"),
        Child(tables.medications, "drug_name", "med"),
    ]
    children = [replace(c, table=c.table.where(F.col(key).isNotNull())) for c in children]
    return merge_on_key([first_per_key(tables.encounters, key), child_profiles(children, key)], key)


def star_join(
    claims: DataFrame, encounters: DataFrame, patients: DataFrame, providers: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Claims with their encounter, patient and provider; clashing names get a suffix.

    `claims` should be a written table: its key columns are also counted for hot keys.
    """
    spread = ["claim_id"]
    hot = hot_keys_by_column(claims, ["encounter_id", "patient_id"], hot_rows)
    hot_providers = checked_hot(hot_keys_through(claims, "encounter_id", encounters, "provider_id", hot_rows), ["provider_id"])
    joined = lookup_join(claims, encounters, "encounter_id", "_enc", spread_by=spread, hot=hot["encounter_id"])
    joined = lookup_join(joined, patients, "patient_id", "_pat", spread_by=spread, hot=hot["patient_id"])
    return lookup_join(
        joined, providers, "provider_id", "_prov", null_safe=True, spread_by=spread, hot=hot_providers
    )


def enrich(claims: DataFrame, tables: ClaimTables, encounters: DataFrame | None = None) -> DataFrame:
    """Cleaned claims in one wide table without leaking or personal columns, with `label_denied`."""
    keyed = claims.dropna(subset=["encounter_id", "patient_id"])
    joined = star_join(
        keyed,
        materialize(encounter_side(tables), "encounter-side") if encounters is None else encounters,
        first_per_key(tables.patients, "patient_id"),
        first_per_key(tables.providers, "provider_id"),
    )
    fills = {}
    for name in joined.columns:
        if name.endswith(("_count", "_distinct")):
            fills[name] = F.coalesce(F.col(name), F.lit(0).cast("bigint"))
        elif name.endswith("_codes"):
            fills[name] = F.coalesce(F.col(name), F.lit(""))
    return with_labels(joined.withColumns(fills)).drop(*LEAK_COLUMNS, *PII_COLUMNS)


def with_labels(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "label_denied": (F.col("claim_status").eqNullSafe("Denied")).cast("int"),
            "label_reason": F.coalesce(F.col("denial_reason_clean"), F.lit("")),
        }
    )


def split_train_eval(enriched: DataFrame, eval_share: float = EVAL_SHARE, seed: int = 42) -> DataFrame:
    """Add `split`; a patient is in one part only. The enriched rows are written once."""
    return split_by_group(materialize(enriched, "enriched"), "patient_id", eval_share, seed)
