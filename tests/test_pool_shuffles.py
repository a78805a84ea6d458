"""What leaves before it is shuffled: rows alone in their group, counts per encounter, lists with one value, columns without use."""

from datetime import date

from pyspark.sql import functions as F

from claimspark.operators import aggregates, duplicates
from claimspark.operators.aggregates import Child, _any_encounter_over, child_profiles
from claimspark.plans import augment


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_alone_in_their_group_are_not_grouped(spark, monkeypatch):
    rows = [
        ("a", "p1", date(2020, 1, 1), 100.0, date(2020, 1, 5)),
        ("b", "p1", date(2020, 1, 1), 105.0, date(2020, 1, 6)),
        ("c", "p2", date(2020, 1, 1), 100.0, date(2020, 1, 5)),
        ("d", "p3", None, None, None),
        ("e", None, date(2020, 1, 1), 100.0, date(2020, 1, 5)),
        ("f", "p1", date(2021, 1, 1), 900.0, None),
    ]
    pool = spark.createDataFrame(rows, "claim_id string, patient_id string, visit_dt date, billed_amount double, claim_billing_dt date")
    written = {}
    plain = duplicates.materialize
    monkeypatch.setattr(duplicates, "materialize", lambda df, label: written.setdefault(label, (_plan(df), plain(df, label)))[1])
    found = {r["claim_id"]: r for r in duplicates.duplicate_evidence_table(pool).collect()}
    assert "LeftSemi" in written["duplicate-groups"][0]
    assert set(found) == {"b"}
    assert found["b"]["dup_visit"]["original_claim_id"] == "a" and found["b"]["dup_bucket"]["original_claim_id"] == "a"
    assert found["b"]["dup_similar"]["original_claim_id"] == "a"


def test_encounters_are_counted_in_buckets_first(spark, monkeypatch):
    table = spark.range(40).select((F.col("id") % 8).cast("string").alias("encounter_id"))
    labels, plain = [], aggregates.materialize
    monkeypatch.setattr(aggregates, "materialize", lambda df, label: labels.append(label) or plain(df, label))
    monkeypatch.setattr(aggregates, "ROW_BUCKETS", 1)
    assert not _any_encounter_over(table, 5)  # the one bucket has 40 rows, no encounter more than 5
    assert _any_encounter_over(table, 4)
    monkeypatch.setattr(aggregates, "ROW_BUCKETS", 1 << 16)
    assert not _any_encounter_over(table, 5) and _any_encounter_over(table, 4)
    assert not _any_encounter_over(table.where("false"), 0)
    assert labels == ["full-buckets"] * 5


def test_counted_values_are_moved_before_lists_are_begun(spark):
    rows = [("1", "x"), ("1", "x"), ("1", "y"), ("2", None), (None, "z")]
    table = spark.createDataFrame(rows, "encounter_id string, code string")
    profiles = child_profiles([Child(table, "code", "diag"), Child(table.where("code = 'y'"), "code", "lab")], "encounter_id")
    plan = _plan(profiles)
    assert plan.index("partial_collect_list") < plan.index("Exchange")
    found = {r["encounter_id"]: r for r in profiles.collect()}
    assert (found["1"]["diag_count"], found["1"]["diag_distinct"], found["1"]["diag_codes"]) == (3, 2, "x|y")
    assert (found["1"]["lab_count"], found["1"]["lab_codes"]) == (1, "y") and found["2"]["lab_count"] is None
    assert (found["2"]["diag_count"], found["2"]["diag_distinct"], found["2"]["diag_codes"]) == (1, 0, "")
    assert found[None]["diag_codes"] == "z"


def test_only_what_a_denial_is_made_of_is_ranked(spark, monkeypatch):
    rows = [("b", 0, "CO1", "t", "p", 5.0, date(2020, 1, 5), date(2020, 1, 1), ["wide"]), ("a", 1, "CO2", "u", "p", 6.0, date(2020, 1, 6), date(2020, 1, 2), ["wide"])]
    selected = spark.createDataFrame(
        rows, "claim_id string, category_no int, category string, reason_text string, profile string, billed_amount double, claim_billing_dt date, visit_dt date, proc_descs array<string>"
    )
    denials = spark.createDataFrame([("x", "DEN00007")], "claim_id string, denial_id string")
    ranked, plain = [], augment.global_rank
    monkeypatch.setattr(augment, "global_rank", lambda df, *more: ranked.append(df.columns) or plain(df, *more))
    found = {r["claim_id"]: r for r in augment.new_denials(selected, denials).collect()}
    assert "proc_descs" not in ranked[0]
    assert (found["b"]["denial_id"], found["a"]["denial_id"]) == ("DEN00008", "DEN00009")
    assert (found["a"]["denial_reason_code"], found["a"]["denied_amount"]) == ("CO2", 6.0)
