"""Steps whose cost must follow the input: plans and counts that were worse before."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from claimspark.operators import aggregates as G
from claimspark.plans import augment as A
from claimspark.plans import enrichment as E


def _features(spark):
    rows = [
        ("1", "Paid", date(2024, 1, 5), 100.0, "e1", "p1", date(2024, 1, 1)),
        ("1", "Paid", date(2024, 1, 4), 110.0, "e2", "p1", date(2024, 1, 1)),  # the earlier row of claim 1
        ("2", "Paid", date(2024, 1, 6), 105.0, "e3", "p1", date(2024, 1, 1)),
        ("3", None, None, None, None, None, None),
        ("4", "Denied", date(2024, 1, 6), 105.0, "e3", "p1", date(2024, 1, 1)),
        (None, "Paid", date(2024, 1, 6), 105.0, "e3", "p1", date(2024, 1, 1)),
    ]
    names = "claim_id string, claim_status string, claim_billing_dt date, billed_amount double, encounter_id string, patient_id string, visit_dt date"
    return spark.createDataFrame(rows, names)


def test_pool_is_unique_and_joined_only_where_evidence_is_read(spark):
    pool = A.candidate_pool(_features(spark))
    assert {r["claim_id"]: r["billed_amount"] for r in pool.collect()} == {"1": 110.0, "2": 105.0, "3": None}
    assert pool.where("dup_visit.original_claim_id = '1'").select("claim_id").collect() == [("2",)]
    plan = pool.select("claim_id", "billed_amount")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_profiles_are_the_same_listed_at_once_or_grouped_per_code_first(spark):
    rows = [("a", "x", "i", "Big Anvil", 3.0), ("a", "x", None, "big anvil", 3.0), ("a", "y", "i", None, None), ("b", None, "i", "Gizmo", 1.0), (None, "z", "i", "lost", 9.0)]
    procedures = spark.createDataFrame(rows, "encounter_id string, procedure_code string, procedure_id string, procedure_description string, procedure_cost double")
    once, spread = G.procedure_profile(procedures), G.procedure_profile(procedures, many_rows=0)
    assert sorted(once.collect()) == sorted(spread.collect()) and once.columns == spread.columns
    first = once.where("encounter_id = 'a'").first()
    assert [tuple(i) for i in first["proc_items"]] == [("x", 2), ("y", 1)] and (first["proc_max_cost"], first["proc_second_cost"]) == (3.0, 3.0)

    rows = [("a", "Z1", "d", True, None), ("a", "Z1", "c", None, False), ("a", "q", None, False, True), ("b", None, None, None, None)]
    diagnoses = spark.createDataFrame(rows, "encounter_id string, diagnosis_code string, diagnosis_description string, chronic_flag boolean, primary_flag boolean")
    once, spread = G.diagnosis_profile(diagnoses), G.diagnosis_profile(diagnoses, many_rows=0)
    assert sorted(map(str, once.collect())) == sorted(map(str, spread.collect()))


def test_procedures_are_grouped_once_and_costs_need_no_second_join(spark):
    rows = [("a", "x", "i", "Big Anvil", 3.0)]
    procedures = spark.createDataFrame(rows, "encounter_id string, procedure_code string, procedure_id string, procedure_description string, procedure_cost double")
    plan = G.procedure_profile(procedures)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_reasonings_read_their_claims_a_fixed_number_of_times(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    mark = F.udf(counted, "string").asNondeterministic()
    claims = spark.range(12).select(F.col("id").cast("string").alias("claim_id")).withColumn("denial_reason", F.lit("late"))
    claims = claims.withColumn("visit_type", mark(F.concat(F.lit("visit "), "claim_id")))
    found = E.reasonings(claims, str(tmp_path / "cache"), lambda prompts: ['{"risk_level": "LOW"}'] * len(prompts), rounds=9, wait=0.0)
    assert found.count() == 12 and seen.value <= 3 * 12
