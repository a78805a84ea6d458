"""Date, appeal and id of a new denial, drawn from its claim id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimspark.functions.draws import bernoulli, random_int
from claimspark.operators.rules import APPEALS, DEFAULT_DENIAL_OFFSET, DENIAL_OFFSETS, FALLBACK_DATE


def base_date(billing: Column, visit: Column) -> Column:
    return F.coalesce(billing, visit, F.lit(FALLBACK_DATE).cast("date"))


def denial_date(base: Column, code: Column, key: Column, seed: int = 42) -> Column:
    """Base date plus an offset that depends on the reason code."""

    def offset(bounds: tuple[int, int]) -> Column:
        low, high = bounds
        return F.lit(low) if high - low == 1 else random_int(key, low, high, "denial", seed)

    days = F.when(F.lit(False), F.lit(0))
    for known, bounds in DENIAL_OFFSETS.items():
        days = days.when(code == known, offset(bounds))
    return F.date_add(base, days.otherwise(offset(DEFAULT_DENIAL_OFFSET)))


def appeal(profile: Column, denied_on: Column, key: Column, seed: int = 42) -> Column:
    """Record of appeal_filed, appeal_status, appeal_resolution_date (date) and final_outcome."""
    approved, resolved = F.when(F.lit(False), F.lit(False)), F.when(F.lit(False), F.lit(None).cast("date"))
    for name, (share, (low, high)) in APPEALS.items():
        won = F.lit(True) if share >= 1 else bernoulli(key, share, "appeal", seed)
        approved = approved.when(profile == name, won)
        resolved = resolved.when(profile == name, F.date_add(denied_on, random_int(key, low, high, "resolution", seed)))
    filed = F.coalesce(profile.isin(list(APPEALS)), F.lit(False))
    return F.struct(
        F.when(filed, "Yes").otherwise("No").alias("appeal_filed"),
        F.when(~filed, "").when(approved, "Approved").otherwise("Denied").alias("appeal_status"),
        resolved.alias("appeal_resolution_date"),
        F.when(filed & approved, "Paid").otherwise("Written off").alias("final_outcome"),
    )


def denial_id(number: Column) -> Column:
    """'DEN' and at least five digits; longer numbers are not cut."""
    return F.format_string("DEN%05d", number)
