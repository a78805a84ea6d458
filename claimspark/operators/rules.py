"""Denial rules: who is a candidate, and the evidence that goes with it.

A rule is two expressions over one feature row, so all rules are one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.functions.text import (
    any_word_ci,
    contains_ci,
    equals_ci,
    first_word_ci,
    is_blank,
    is_empty_list,
    present_names,
    row_json,
)
from claimspark.functions.values import cost_ratio, format_date, is_true

TIMELY_DAYS = 180
SENIOR_AGE = 65
BUNDLE_RATIO = 0.8
HIGH_COST_QUANTILE = 0.9
NON_COVERED_QUANTILE = 0.85

# Words that mark a service as not covered, and the departments watched for it
NON_COVERED_WORDS = (
    "cosmetic", "fertility", "ivf", "chiro", "dental", "experimental", "rhinoplasty", "implant", "hair",
    "laser resurfacing",
)
WATCHED_DEPARTMENTS = ("dermatology", "obstetrics", "orthopedics", "psychiatry")


@dataclass(frozen=True)
class RuleSpec:
    code: str
    description: str
    profile: str
    predicate: Column
    evidence: Column  # JSON text
    by_filing_days: bool = False  # takes the longest delays instead of a sample
    by_duplicates: bool = False  # its predicate is the only one that reads the duplicate evidence


def not_denied() -> Column:
    """Status other than exactly 'Denied'; a missing status counts as other."""
    return ~F.col("claim_status").eqNullSafe("Denied")


def senior_without_medicare() -> Column:
    return is_true(F.col("age") >= SENIOR_AGE) & ~contains_ci(F.col("insurance_type"), "medicare")


def visit_before_registration() -> Column:
    return is_true(F.col("visit_dt") < F.col("registration_dt"))


def coverage_reason() -> Column:
    return F.when(senior_without_medicare(), "age-payer-mismatch").otherwise("registration-after-visit")


def needs_authorization(high_cost: float | None) -> Column:
    return (
        is_true(equals_ci(F.col("admission_type"), "elective"))
        | contains_ci(F.col("visit_type"), "inpatient")
        | at_least(high_cost)
    )


def at_least(threshold: float | None) -> Column:
    """Billed amount at or above a threshold; false when either is missing."""
    return is_true(F.col("billed_amount") >= F.lit(threshold).cast("double"))


def missing_fields() -> Column:
    return present_names(
        [
            ("phone", is_blank(F.col("phone"))),
            ("email", is_blank(F.col("email"))),
            ("address", is_blank(F.col("address"))),
            ("diagnosis", is_empty_list(F.col("diag_items"))),
            ("procedure", is_empty_list(F.col("proc_items"))),
        ]
    )


def bundled() -> Column:
    ratio = cost_ratio(F.col("proc_second_cost"), F.col("proc_max_cost"))
    return is_true((F.col("proc_count") >= 2) & (ratio <= BUNDLE_RATIO))


def duplicate_evidence() -> Column:
    """First kind of match wins: same visit, same amount bucket, similar amount."""
    options = {"ignoreNullFields": "false"}
    return F.coalesce(*[F.to_json(c, options) for c in ("dup_visit", "dup_bucket", "dup_similar")])


def _occurrences(items: str) -> Column:
    return F.transform(F.col(items), lambda item: item["n"])


# Codes, wordings and appeal profiles, in the order the rules take claims
RULE_TEXTS: tuple[tuple[str, str, str], ...] = (
    ("CO22", "This care may be covered by another payer per coordination of benefits.", "appeal_win"),
    ("CO197", "Precertification/authorization/notification absent.", "appeal_mix"),
    ("CO50", "These services are not medically necessary.", "appeal_split"),
    ("CO16", "Claim lacks required information.", "appeal_easy"),
    ("CO18", "Exact duplicate claim/service.", "no_appeal"),
    ("CO29", "The time limit for filing has expired.", "no_appeal_hard"),
    ("CO27", "Expenses incurred after coverage terminated.", "no_appeal_hard"),
    ("CO96", "Non-covered charge(s).", "no_appeal"),
    (
        "CO97",
        "The benefit for this service is included in the payment for another service/procedure.",
        "no_appeal",
    ),
)


def denial_rules(
    high_cost: float | None,
    non_covered_cost: float | None,
    words: Sequence[str] = NON_COVERED_WORDS,
    departments: Sequence[str] = WATCHED_DEPARTMENTS,
) -> list[RuleSpec]:
    """The nine rules. The thresholds are quantiles of the billed amounts of the pool."""
    keyword = first_word_ci(F.col("proc_keywords"), words)
    z_code, chronic = is_true(F.col("has_z_code")), is_true(F.col("has_chronic"))
    billed = F.col("billed_amount")
    ratio = cost_ratio(F.col("proc_second_cost"), F.col("proc_max_cost"))
    rules = {
        "CO22": (
            senior_without_medicare(),
            row_json(F.col("age"), F.col("insurance_type").alias("payer")),
        ),
        "CO197": (
            needs_authorization(high_cost),
            row_json(F.col("admission_type"), at_least(high_cost).alias("high_cost"), billed),
        ),
        "CO50": (
            at_least(high_cost) & (z_code | ~chronic),
            row_json(
                billed,
                z_code.alias("has_z_code"),
                chronic.alias("has_chronic"),
                F.col("diag_codes").alias("diagnosis_codes"),
                _occurrences("diag_items").alias("diagnosis_code_counts"),
            ),
        ),
        "CO16": (F.size(missing_fields()) > 0, row_json(missing_fields().alias("missing"))),
        "CO18": (duplicate_evidence().isNotNull(), duplicate_evidence()),
        "CO29": (F.col("days_to_file").isNotNull(), row_json(F.col("days_to_file"))),
        "CO27": (
            senior_without_medicare() | visit_before_registration(),
            row_json(
                coverage_reason().alias("reason"),
                F.col("age"),
                F.col("insurance_type").alias("payer"),
                format_date(F.col("visit_dt")).alias("visit_date"),
                format_date(F.col("registration_dt")).alias("registration_date"),
            ),
        ),
        "CO96": (
            keyword.isNotNull()
            | ((z_code | any_word_ci(F.col("department"), departments)) & at_least(non_covered_cost)),
            row_json(keyword.alias("keyword"), z_code.alias("has_z_code"), billed, F.col("department")),
        ),
        "CO97": (
            bundled(),
            row_json(
                F.col("proc_count"),
                ratio.alias("cost_ratio"),
                F.col("proc_codes"),
                _occurrences("proc_items").alias("proc_code_counts"),
            ),
        ),
    }
    return [
        RuleSpec(code, text, profile, *rules[code], by_filing_days=code == "CO29", by_duplicates=code == "CO18")
        for code, text, profile in RULE_TEXTS
    ]


# ---- dates and appeals of a new denial -----------------------------------------------

# Offset of the denial from its base date, half-open in days
DENIAL_OFFSETS = {"CO18": (3, 4), "CO29": (0, 1), "CO197": (5, 12)}
DEFAULT_DENIAL_OFFSET = (7, 21)
FALLBACK_DATE = "2025-03-01"

# Profile -> (share approved, resolution offset half-open in days)
APPEALS = {
    "appeal_win": (1.0, (7, 22)),
    "appeal_easy": (1.0, (5, 15)),
    "appeal_mix": (0.3, (10, 25)),
    "appeal_split": (0.5, (10, 30)),
}
