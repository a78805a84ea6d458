"""Joins, ordering, sampling, aggregates and metrics against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimspark.functions.draws import draw
from claimspark.operators import aggregates as G
from claimspark.operators import metrics as M
from claimspark.operators.duplicates import duplicate_evidence_table
from claimspark.operators.folds import with_group_folds, with_stratified_folds
from claimspark.operators import joins as J
from claimspark.operators.joins import first_per_key, hot_keys, hot_keys_by_column, hot_keys_through, lookup_join, rank_aligned_mapping
from claimspark.operators.ordering import exact_quantiles_of, global_rank, running_totals
from claimspark.operators.sampling import downsample_negatives, find_cut, sample_exact, split_by_group


def test_lookup_join_with_hot_and_null_keys(spark):
    left = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k")
    )
    right = spark.createDataFrame([(7, "seven"), (10, "ten"), (None, "none")], "k long, name string")
    for null_safe, nulls in ((False, None), (True, "none")):
        hot = hot_keys(left, ["k"], 100)
        assert hot.count() == 2  # seven and null
        joined = lookup_join(left, right, "k", null_safe=null_safe, spread_by=["id"], hot=hot)
        plain = lookup_join(left, right, "k", null_safe=null_safe)
        rows = sorted(map(tuple, joined.collect()))
        assert rows == sorted(map(tuple, plain.collect()))
        assert len(rows) == 1000
        assert {r[2] for r in rows if r[1] is None} == {nulls}


def test_lookup_join_spreads_a_hot_key(spark):
    left = spark.range(2000).select("id", F.lit(1).alias("k"))
    right = spark.createDataFrame([(1, "a")], "k int, name string")
    joined = lookup_join(left, right, "k", spread_by=["id"], hot=hot_keys(left, ["k"], 10))
    assert joined.where("name = 'a'").count() == 2000
    via = spark.createDataFrame([(1, "p")], "k int, p string")
    assert [tuple(r)[:1] for r in hot_keys_through(left, "k", via, "p", 10).collect()] == [("p",)]


def test_suffix_only_on_overlap(spark):
    left = spark.createDataFrame([(1, "a")], "k int, x string")
    right = spark.createDataFrame([(1, "b", "c")], "k int, x string, y string")
    assert lookup_join(left, right, "k", "_enc").columns == ["k", "x", "x_enc", "y"]


def test_global_rank_and_totals_do_not_depend_on_partitions(spark):
    values = [(i, random.Random(i).randrange(5), 1 + i % 3) for i in range(500)]
    df = spark.createDataFrame(values, "id int, v int, w int")
    expected = {r[0]: n for n, r in enumerate(sorted(values, key=lambda r: (-r[1], r[0])), 1)}
    for parts in (1, 7):
        ranked = global_rank(df.repartition(parts), [F.col("v").desc(), F.col("id")])
        assert {r["id"]: r["rank"] for r in ranked.collect()} == expected
        totals = running_totals(df.repartition(parts), [F.col("id")], ["w"]).orderBy("id").collect()
        assert [r["cum_w"] for r in totals[:4]] == [1, 3, 6, 7]
        assert {r["total_w"] for r in totals} == {sum(v[2] for v in values)}


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in (1, 2, 2, 3, 10)] + [(None, None)], "a double, b double")
    found = exact_quantiles_of(df, ["b", "a"], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert found["b"] == [1.0] * 5
    assert found["a"] == pytest.approx([1.0, 2.0, 2.0, 7.2, 10.0])


def test_cut_takes_exactly_n(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"), draw(F.col("id")).alias("d")).cache()
    for n in (0, 1, 777, 19999, 20000, 30000):
        cut = find_cut(df, n, "d", "k")
        assert df.where(cut.takes(F.col("d"), F.col("k"))).count() == min(n, 20000)


def test_cut_on_equal_draws(spark):
    df = spark.range(9000).select(F.col("id").cast("string").alias("k"), F.lit(5).cast("long").alias("d"))
    cut = find_cut(df, 8000, "d", "k")
    assert df.where(cut.takes(F.col("d"), F.col("k"))).count() == 8000


def test_sample_is_stable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    a = {r[0] for r in sample_exact(df, 100, "k").collect()}
    b = {r[0] for r in sample_exact(df.repartition(9), 100, "k").collect()}
    assert a == b and len(a) == 100


def test_downsample(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") < 70).alias("pos"))
    kept = downsample_negatives(df, F.col("pos"), "k", 0.35)
    assert kept.where("pos").count() == 70 and kept.count() == int(70 / 0.35)
    assert downsample_negatives(df, F.col("pos"), "k", 0.01).count() == 1000


def test_split_and_folds_with_half_of_the_rows_in_one_group(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 500, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"))
    split = split_by_group(df, "g")
    sides = split.groupBy("g").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).collect()[0][0]
    in_eval = split.where("split = 'eval'").select("g").distinct().count()
    assert sides == 1 and in_eval == math.ceil(0.2 * 41)
    folded = with_group_folds(df, "g", 3, ["id"], hot_rows=100)
    assert folded.count() == 1000
    assert folded.groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).collect()[0][0] == 1
    strat = with_stratified_folds(df.withColumn("y", (F.col("id") % 10 == 0).cast("int")), "y", "id", 5)
    assert {r["count"] for r in strat.where("y = 1").groupBy("fold").count().collect()} == {20}


def test_child_summaries(spark):
    rows = [("e1", "B"), ("e1", "A"), ("e1", "A"), ("e1", None), ("e1", " "), (None, "C"), (None, None)]
    df = spark.createDataFrame(rows, "e string, c string")
    assert [tuple(r) for r in G.child_summary(df, "e", "c", "x").collect()] == [("e1", 5, 3, " |A|B")]
    text = {r["e"]: tuple(r)[1:] for r in G.child_summary_text(df, "e", "c", "x").collect()}
    assert text == {"e1": (5, 3, "A|B"), None: (2, 1, "C")}


def test_top_two(spark):
    rows = [("a", 5.0), ("a", 5.0), ("a", 3.0), ("b", 7.0), ("c", None), ("c", 4.0), ("d", 0.0), ("d", 0.0)]
    found = {r[0]: (r[1], r[2]) for r in G.top_two(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert found == {"a": (5.0, 5.0), "b": (7.0, None), "c": (4.0, None), "d": (0.0, 0.0)}


def test_rank_limits_apply_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = G.top_two(df, "k", "v")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_profiles_keep_every_occurrence(spark):
    rows = [("e", "Z1", "d1", True, None), ("e", "Z1", "d1", None, False), ("e", None, None, None, None), (None, "Q", "d", True, True)]
    df = spark.createDataFrame(
        rows, "encounter_id string, diagnosis_code string, diagnosis_description string, primary_flag boolean, chronic_flag boolean"
    )
    (row,) = G.diagnosis_profile(df).collect()
    assert row["diag_codes"] == ["Z1"] and [tuple(i) for i in row["diag_items"]] == [("Z1", 2)]
    assert row["has_z_code"] and not row["has_chronic"] and row["has_primary"]


def test_denial_lists(spark):
    df = spark.createDataFrame(
        [("c", "DEN2", " ", 5.0, " YES "), ("c", "DEN1", "x", None, "No")],
        "claim_id string, denial_id string, final_outcome string, denied_amount double, appeal_filed string",
    )
    for name in ("denial_reason_code", "denial_reason_description", "denial_date", "appeal_status", "appeal_resolution_date"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    row = G.claim_denials(df).collect()[0]
    assert (row["denial_ids"], row["final_outcomes"], row["denied_amount_sum"]) == ("DEN1|DEN2", "x", 5.0)
    assert row["appeal_filed_any"] == "Yes" and row["denial_reason_codes"] == ""
    ids = spark.createDataFrame([("DEN99999",), ("XDEN5",), ("DEN7x",), (None,)], "denial_id string")
    assert G.max_numeric_suffix(ids, "denial_id").collect()[0][0] == 99999


def test_keep_first_counts_null_as_a_key(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("k", 3, "c"), ("k", 4, "d")], "k string, row_no int, v string")
    assert sorted(r["v"] for r in first_per_key(df, "k").collect()) == ["a", "c"]


def test_rank_mapping(spark):
    def table(text):
        return spark.createDataFrame([(c,) for c in text], "r string")

    equal = rank_aligned_mapping(table("xxxyyz"), table("aabccc"), "r").collect()
    assert {r["long_value"]: r["short_value"] for r in equal} == {"x": "c", "y": "a", "z": "b"}
    assert rank_aligned_mapping(table("xxy"), table("abc"), "r").count() == 0


def brute_metrics(rows, t):
    positives = sum(y for _, y in rows)
    ap, best, seen = 0.0, None, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(y for x, y in rows if x >= s), sum(x >= s for x, _ in rows)
        precision, recall = tp / n, tp / positives if positives else 0.0
        ap += (recall - seen) * precision
        seen = recall
        f1 = 2 * precision * recall / max(precision + recall, 1e-12)
        if best is None or f1 >= best[0]:
            best = (f1, s)
    tp = sum(y for x, y in rows if x >= t)
    flagged = sum(x >= t for x, _ in rows)
    f1 = 2 * tp / (flagged + positives) if flagged + positives else 0.0
    accuracy = sum((x >= t) == bool(y) for x, y in rows) / len(rows)
    return ap, f1, accuracy, best[1], best[0]


@pytest.mark.parametrize(
    "rows",
    [
        [(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)],
        [(0.5, 1), (0.5, 0), (0.5, 1), (0.2, 0)],
        [(0.5, 0), (0.4, 0)],
        [(0.9, 1), (0.1, 1)],
        [(round(random.Random(i).random(), 2), i % 4 == 0) for i in range(300)],
    ],
)
def test_metrics(spark, rows):
    rows = [(float(s), int(y)) for s, y in rows]
    df = spark.createDataFrame(rows, "score double, label int")
    assert tuple(M.ranking_metrics(df, 0.5).collect()[0]) == pytest.approx(brute_metrics(rows, 0.5))
    sweep = M.cost_sweep(df, M.SWEEP_COARSE).collect()
    for r in sweep:
        assert r["tp"] == sum(y for s, y in rows if s >= r["threshold"])
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == len(rows)
        assert r["cost"] == r["fp"] + 5 * r["fn"]
    cheapest = min(sweep, key=lambda r: (r["cost"], r["threshold"]))
    assert M.best_cost(M.cost_sweep(df, M.SWEEP_COARSE)).collect()[0]["threshold"] == cheapest["threshold"]


def test_hot_keys_of_several_columns_and_their_bound(spark, monkeypatch):
    rows = [("a" if i % 2 else None, i % 3, i) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, n int, id int")
    found = hot_keys_by_column(df, ["k", "n", "id"], 30)
    assert {r[0] for r in found["k"].collect()} == {"a", None} and found["n"] is None and found["id"] is None
    assert dict(found["k"].dtypes) == {"k": "string"}
    assert hot_keys_by_column(df, ["id"], 5) == {"id": None}
    several = hot_keys_by_column(df, ["n"], 20)["n"]
    assert {r[0] for r in several.collect()} == {0, 1, 2} and dict(several.dtypes) == {"n": "int"}
    monkeypatch.setattr(J, "MOST_HOT", 1)
    assert len(J.checked_hot(df.groupBy("k").agg(F.count("*").alias("_n")), ["k"]).collect()) == 1
    right = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    for hot in (None, found["k"]):
        joined = lookup_join(df, right, "k", null_safe=True, spread_by=["id"], hot=hot)
        assert {(r["k"], r["v"]) for r in joined.collect()} == {("a", 1), (None, 2)} and joined.count() == 90


def test_children_of_a_third_orphaned_and_of_wanted_keys(spark):
    """Four tables in two exchanges; rows without key are summarised only if the key is wanted."""
    rows = [(None if i % 3 == 0 else str(i % 20), f"c{i % 7}", " " if i % 5 == 0 else f"d{i % 4}") for i in range(3000)]
    table = spark.createDataFrame(rows, "k string, code string, desc string")
    children = [G.Child(table, "code", "a", "desc"), G.Child(table.where("k <> '1'"), "code", "b"), G.Child(table, "desc", "c")]
    found = {r["k"]: r for r in G.child_profiles(children, "k", keep_blank=False).collect()}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        r = found[key]
        assert (r["a_count"], r["a_distinct"], r["a_codes"]) == (len(own), len({x[1] for x in own}), "|".join(sorted({x[1] for x in own})))
        assert r["a_descriptions"] == r["c_codes"] == "|".join(sorted({x[2] for x in own if x[2].strip()}))
        assert r["c_distinct"] == len({x[2] for x in own})
        assert r["b_count"] is None if key in ("1", None) else r["b_count"] == len(own)
    wanted = spark.createDataFrame([("2",), ("2",), ("none",)], "k string")
    some = G.child_profiles(children, "k", wanted=wanted)
    assert [r["k"] for r in some.collect()] == ["2"]
    with_null = G.child_profiles(children, "k", wanted=wanted.unionByName(spark.createDataFrame([(None,)], "k string")))
    assert {r["k"] for r in with_null.collect()} == {"2", None}
    plan = G.child_profiles(children, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "Join" not in plan


def test_denials_without_claim(spark):
    rows = [("1", "D1", "a", 5.0, "Yes"), ("1", "D2", "b", 7.0, "No")] + [(None, f"X{i:03}", "a" if i % 2 else " ", float(i), None) for i in range(200)]
    df = spark.createDataFrame(rows, "claim_id string, denial_id string, denial_reason_code string, denied_amount double, appeal_filed string")
    for name in ("denial_reason_description", "denial_date", "appeal_status", "appeal_resolution_date", "final_outcome"):
        df = df.withColumn(name, F.lit("same"))
    found = {r["claim_id"]: r for r in G.claim_denials(df).collect()}
    assert set(found) == {"1", None} and set(r["claim_id"] for r in G.claim_denials(df, null_claims=False).collect()) == {"1"}
    lost = found[None]
    assert lost["denial_ids"] == "|".join(f"X{i:03}" for i in range(200)) and lost["denial_reason_codes"] == "a" and lost["denial_dates"] == "same"
    assert (lost["denied_amount_sum"], lost["denied_amount_max"], lost["appeal_filed_any"]) == (19900.0, 199.0, "No")
    assert found["1"]["denial_ids"] == "D1|D2" and found["1"]["appeal_filed_any"] == "Yes"
    assert {r["claim_id"] for r in G.claim_denials(df.where("claim_id is not null")).collect()} == {"1"}


def test_duplicates_with_half_the_rows_on_one_key(spark):
    """Against a loop over the claims, with and without spreading the hot groups."""
    rng = random.Random(6)
    rows = [(f"c{i:03}", "p" if i % 2 else f"q{i % 9}", rng.choice([None, "2024-01-01", "2024-01-02"]), rng.choice([None, 40.0, 60.0, 100.0, 119.0]), rng.choice([None, "2024-02-01", "2024-02-02"])) for i in range(300)]
    df = spark.createDataFrame(rows, "claim_id string, patient_id string, v string, billed_amount double, b string").select(
        "claim_id", "patient_id", F.col("v").cast("date").alias("visit_dt"), "billed_amount", F.col("b").cast("date").alias("claim_billing_dt")
    )
    late, bucket = "9999", lambda x: None if x is None else round(x / 50) * 50
    first = {}
    for c, p, v, x, b in rows:
        for key, order in ((("v", p, v), (b or late, c)), (("b", p, bucket(x)), (b or late, c)), (("a", p), (x is None, x or 0.0, c))):
            if None not in key:
                first[key] = min(first.get(key, (order, c, x)), (order, c, x))
    expected = {}
    for c, p, v, x, b in rows:
        found = {}
        if v is not None and first["v", p, v][1] != c:
            found["dup_visit"] = first["v", p, v][1]
        if x is not None and first["b", p, bucket(x)][1] != c:
            found["dup_bucket"] = first["b", p, bucket(x)][1]
        low = first["a", p]
        if low[1] != c and x is not None and low[2] is not None and abs(x - low[2]) / max(low[2], 1) <= 0.2:
            found["dup_similar"] = low[1]
        if found:
            expected[c] = found
    for hot_rows in (1, 40, 1000):
        table = duplicate_evidence_table(df, hot_rows).collect()
        found = {r["claim_id"]: {n: r[n]["original_claim_id"] for n in ("dup_visit", "dup_bucket", "dup_similar") if r[n]} for r in table}
        assert found == expected and len(table) == len(expected)
