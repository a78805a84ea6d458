"""Selection passes, cleaning, knowledge base, caches and training on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimspark.functions.draws import draw
from claimspark.operators import isotonic as I
from claimspark.operators import quotas as Q
from claimspark.operators.duplicates import duplicate_evidence_table
from claimspark.operators.rules import RULE_TEXTS, RuleSpec
from claimspark.plans import augment as A
from claimspark.plans import clean as C
from claimspark.plans import enrichment as E
from claimspark.plans import knowledge_base as K
from claimspark.plans import training as M
from claimspark.sources import roles, sinks, tables

SMALL = "/root/testdata/sf0.001"


def brute_selection(rows, need, rules):
    """The passes one claim at a time. rows: id, draw, days, set of rules."""
    quota, taken, count = math.ceil(need / rules), {}, [0] * rules

    def take(rule, n):
        if rule == 5:
            longest = sorted((r for r in rows if 5 in r[3]), key=lambda r: (-r[2], r[1], r[0]))[:n]
            picks = [r for r in longest if r[0] not in taken]
        else:
            picks = sorted((r for r in rows if rule in r[3] and r[0] not in taken), key=lambda r: (r[1], r[0]))[:n]
        for r in picks:
            taken[r[0]] = rule
            count[rule] += 1
        return len(picks)

    for rule in range(rules):
        take(rule, quota)
    for rule in range(rules):
        if len(taken) < need and count[rule] < quota:
            take(rule, quota - count[rule])
    free = [r for r in rows if r[0] not in taken]
    wishes = []
    for rule in range(rules):
        if rule != 5:
            queue = sorted((r[4][rule], r[0]) for r in free if rule in r[3])
            wishes += [(claim, place, rule) for place, (_, claim) in enumerate(queue)]
    best, queues = {}, {}
    for claim, place, rule in wishes:
        best[claim] = min(best.get(claim, (place, rule)), (place, rule))
    for claim, (place, rule) in best.items():
        queues.setdefault(rule, []).append((place, claim))
    turns = sorted((turn, rule, claim) for rule, queue in queues.items() for turn, (_, claim) in enumerate(sorted(queue)))
    for _, rule, claim in turns[: max(0, need - len(taken))]:
        taken[claim] = rule
    rest = sorted((r for r in rows if r[0] not in taken), key=lambda r: (r[1], r[0]))
    for r in rest[: max(0, need - len(taken))]:
        taken[r[0]] = 2
    return taken


@pytest.mark.parametrize(("need", "share"), [(30, 0.3), (90, 0.1), (170, 0.05), (400, 0.5)])
def test_selection_matches_brute_force(spark, need, share):
    rng = random.Random(need)
    raw = [(str(i), rng.randrange(-50, 400), [k for k in range(9) if rng.random() < share]) for i in range(300)]
    df = spark.createDataFrame(raw, "claim_id string, days_to_file int, hits array<int>")
    pool = df.withColumns({"_draw": draw(F.col("claim_id")), "billed_amount": F.lit(1.0)}).cache()
    rules = [
        RuleSpec(code, text, profile, F.array_contains("hits", i), F.lit("{}"), by_filing_days=i == 5)
        for i, (code, text, profile) in enumerate(RULE_TEXTS)
    ]
    selection = A.select_claims(pool, rules, need)
    own = F.array(*[A.robin_draw(F.lit(i)) for i in range(9)])
    rows = [(r["claim_id"], r["_draw"], r["days_to_file"], set(r["hits"]), r["own"]) for r in pool.withColumn("own", own).collect()]
    found = {r["claim_id"]: r["category_no"] for r in selection.rows(pool).collect()}
    assert found == brute_selection(rows, need, 9)


def test_robin_quotas_are_those_of_dealing_one_by_one():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.choice([0, rng.randrange(6), rng.randrange(60)]) for _ in range(rng.randrange(10))]
        need, left, dealt = rng.randrange(100), list(sizes), [0] * len(sizes)
        while sum(dealt) < need and any(left):
            for i in range(len(sizes)):
                if left[i] and sum(dealt) < need:
                    left[i] -= 1
                    dealt[i] += 1
        assert A.robin_quotas(sizes, need) == dealt


@pytest.mark.parametrize("fetch", [0, 5, 2000])
def test_quotas_match_taking_row_by_row(spark, monkeypatch, fetch):
    """Also when no range is fetched before its draws are told apart to the last bit."""
    monkeypatch.setattr(Q, "FETCH", fetch)
    rng = random.Random(fetch)
    # draws that agree in many leading bits, and some that are equal
    rows = [(f"c{i:03}", rng.choice([rng.randrange(1 << 60), (5 << 40) + rng.randrange(40)]), rng.randrange(16)) for i in range(400)]
    quotas = Q.Quotas(spark.createDataFrame(rows, "claim_id string, _draw long, _mask int"))
    takes = [Q.Take(0, 37), Q.Take(1, 80), Q.Take(2, 60, of_all=True), Q.Take(3, None), Q.Take(0, 20), Q.Take(1, 0), Q.Take(2, 10_000)]
    cuts, sizes = quotas.cuts(takes)
    taken, ordered = set(), sorted(rows, key=lambda r: (r[1], r[0]))
    for take, cut, size in zip(takes, cuts, sizes):
        fit = [r[0] for r in ordered if r[2] >> take.bit & 1 and (take.of_all or r[0] not in taken)][: take.n]
        new = set(fit) - taken
        inside = {r[0] for r in rows if r[2] >> take.bit & 1 and (cut.all or (cut.draw is not None and (r[1], r[0]) <= (cut.draw, cut.key)))}
        assert inside - taken == new and size == len(new)
        taken |= new
    assert quotas.jobs <= (20 if fetch < 2000 else 4)


def test_half_of_the_claims_on_one_draw_bucket_and_no_claims(spark):
    rows = spark.range(6000).selectExpr("cast(id as string) as claim_id", "case when id % 2 = 0 then 7L else id end as _draw", "1 as _mask")
    cuts, sizes = Q.Quotas(rows).cuts([Q.Take(0, 1500)])
    assert sizes == [1500] and rows.where(cuts[0].takes(F.col("_draw"), F.col("claim_id"))).count() == 1500
    assert Q.Quotas(rows.limit(0)).cuts([Q.Take(0, 5)])[1] == [0]


def test_duplicate_kinds(spark):
    rows = [
        ("1", "p", "2024-01-01", 100.0, "2024-02-01"),
        ("2", "p", "2024-01-01", 900.0, "2024-01-15"),  # same visit, billed first
        ("3", "p", "2024-05-01", 101.0, "2024-03-01"),  # 3, 4 and 5 share the bucket of 1
        ("4", "p", "2024-06-01", 120.0, "2024-03-02"),  # at exactly 20 %
        ("5", "p", "2024-07-01", 120.5, "2024-03-03"),
        ("6", "q", None, 0.5, None),
        ("7", "q", None, 0.6, None),  # base below 1
        ("8", "q", None, None, None),
        ("9", None, "2024-01-01", 100.0, "2024-01-01"),
    ]
    df = spark.createDataFrame(rows, "claim_id string, patient_id string, v string, billed_amount double, b string").select(
        "claim_id", "patient_id", F.col("v").cast("date").alias("visit_dt"), "billed_amount", F.col("b").cast("date").alias("claim_billing_dt")
    )
    for hot_rows in (1, 1000):
        found = {r["claim_id"]: r for r in duplicate_evidence_table(df, hot_rows).collect()}
        assert {k for k, r in found.items() if r["dup_visit"]} == {"1"}
        assert found["1"]["dup_visit"]["original_claim_id"] == "2" and found["1"]["dup_visit"]["amount_diff"] == 800.0
        assert {k for k, r in found.items() if r["dup_bucket"]} == {"3", "4", "5", "7"}  # 120.5 / 50 rounds to 2
        assert {k for k, r in found.items() if r["dup_similar"]} == {"3", "4", "7"}
    assert duplicate_evidence_table(df.where("claim_id = '9'")).count() == 0


@pytest.fixture(scope="module")
def small(spark):
    return roles.load(spark, SMALL)


def test_augmentation_reaches_the_target(spark, small):
    done = A.augment(small, words=roles.KEYWORDS, departments=roles.DEPARTMENTS)
    totals = done.summary.collect()[0]
    assert totals["final_denied"] == totals["target_denied"]
    assert done.claims.where("claim_status = 'Denied'").count() == totals["final_denied"]
    ids = [r["claim_id"] for r in done.selected.select("claim_id").collect()]
    assert len(ids) == len(set(ids)) == totals["new_denials_added"]
    new = done.denials.select("denial_id").join(small.denials.select("denial_id"), "denial_id", "left_anti")
    numbers = sorted(int(r[0][3:]) for r in new.collect())
    assert numbers == list(range(numbers[0], numbers[0] + len(ids)))
    assert done.selected.where("evidence is null").count() == 0


def test_augmentation_passthrough(spark, small):
    done = A.augment(small, ratio=0.0)
    assert done.summary.collect()[0]["new_denials_added"] == 0
    assert done.claims.exceptAll(small.claims).count() == 0


def test_missing_evidence_is_an_error(spark):
    bad = spark.createDataFrame([("CO22", None)], "category string, evidence string")
    with pytest.raises(ValueError, match="CO22"):
        A.check_evidence(bad)


def test_reasons(spark):
    claims = spark.createDataFrame(
        [("1", " Denied ", "Late."), ("2", "Denied", None), ("3", "Paid", "x"), ("4", "denied", "y"), ("5", "Denied", " ")],
        "claim_id string, claim_status string, denial_reason string",
    )
    denials = spark.createDataFrame(
        [("2", "D1", "too LATE"), ("1", "D2", "too late"), ("5", "D3", None)],
        "claim_id string, denial_id string, denial_reason_description string",
    )
    cleaned, mapping = C.reconcile_reasons(claims, denials)
    found = {r["claim_id"]: r["denial_reason_clean"] for r in cleaned.collect()}
    # two distinct texts on each side: '' (2) and 'late' (1) against 'too late' (2) and '' (1)
    assert {r["long_value"]: r["short_value"] for r in mapping.collect()} == {"too late": "", "": "late"}
    assert found == {"1": "late", "2": "", "3": "", "5": "late"}


def test_knowledge_base_matches_null_keys_and_drops_self_pay(spark, small):
    kb = K.build_knowledge_base(small).cache()
    assert kb.where("lower(trim(claim_status)) <> 'denied'").count() == 0
    assert kb.where("payment_method = 'Self-Pay' or insurance_provider like '%Self%'").count() == 0
    held, rest = K.split_holdout(kb, 7)
    assert held.count() == 7 and rest.count() == kb.count() - 7
    assert held.join(rest, "claim_id").count() == 0
    assert "last_name" not in K.build_knowledge_base(small, drop_people=True).columns


def test_holdout_text(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "A")], "claim_id string, denial_reason string, first_name string")
    sinks.write_holdout_markdown(df, str(tmp_path / "a"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "a")).collect())
    assert text.startswith("# Denied Claims Holdout") and '"denial_reason" : null' in text
    assert "### Claim 1 — Expected: Denied — Reason:  — Payer:  — Patient: A " in text
    sinks.write_holdout_markdown(df.limit(0), str(tmp_path / "b"))
    assert "_No denied claims available._" in [r[0] for r in spark.read.text(str(tmp_path / "b")).collect()]


def test_csv_null_words_and_source_choice(spark, tmp_path):
    (tmp_path / "m.csv").write_text('encounter_id,drug_name\n1,NA\n2,"a, b"\n,None\n')
    read = tables.read_csv_table(spark, str(tmp_path / "m.csv"), "medications")
    assert [(r[0], r[1]) for r in read.orderBy("_order").collect()] == [("1", None), ("2", "a, b"), (None, None)]
    there, gone = str(tmp_path / "m.csv"), str(tmp_path / "gone.csv")
    assert tables.resolve_sources(spark, ("r", "r"), (there, there))[2]
    assert not tables.resolve_sources(spark, ("r", "r"), (there, gone))[2]
    assert not tables.resolve_sources(spark, ("r", "r"), (there, there), no_augment=True)[2]


def test_reasoning_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    claims = spark.createDataFrame([(str(i), float(i)) for i in range(20)], "claim_id string, billed_amount double")

    def answer(prompts):
        if any("$13.00" in p for p in prompts):
            raise RuntimeError("no answer for this one")
        return ['{"risk_level": "LOW"}' for _ in prompts]

    def refuse(prompts):
        raise RuntimeError("asked again")

    first = {r[0]: r[1] for r in E.reasonings(claims, path, answer, rounds=3, tries=2, wait=0.0).collect()}
    assert len(first) == 20 and first["13"] == E.UNAVAILABLE
    assert first["1"].startswith("Denial risk: LOW. Denial factors: Unknown.")
    shuffled = claims.repartition(5)
    assert {r[0]: r[1] for r in E.reasonings(shuffled, path, refuse, tries=1).collect()} == first
    changed = claims.withColumn("billed_amount", F.when(F.col("claim_id") == "1", 99.0).otherwise(F.col("billed_amount")))
    again = {r[0]: r[1] for r in E.reasonings(changed, path, lambda ps: ['{"risk_level": "HIGH"}'] * len(ps)).collect()}
    assert again["1"].startswith("Denial risk: HIGH") and again["2"] == first["2"] and len(again) == 20


def test_reasonings_of_claims_without_identifier_and_calls_in_flight(spark, tmp_path):
    rows = [(None if i % 3 == 0 else str(i), float(i)) for i in range(60)] + [(None, 0.0)]
    claims = spark.createDataFrame(rows, "claim_id string, billed_amount double").repartition(2)
    log = str(tmp_path / "log")

    def answer(prompts):
        import threading
        import time

        with open(log, "a") as file:
            file.write(f"{threading.active_count()} {len(prompts)}\n")
        time.sleep(0.02)
        return ['{"risk_level": "LOW"}' for _ in prompts]

    def refuse(prompts):
        raise RuntimeError("asked again")

    path = str(tmp_path / "cache")
    found = E.reasonings(claims, path, answer, share_rows=25, request_rows=2, in_flight=4)
    assert found.count() == 61 and found.where("claim_id is null").count() == 21
    assert found.where("reasoning like 'Denial risk: LOW%'").count() == 61
    calls = [tuple(map(int, line.split())) for line in open(log)]
    assert max(size for _, size in calls) == 2 and sum(size for _, size in calls) == 60  # the repeated row is asked for once
    assert E.reasonings(claims, path, refuse, tries=1).where("reasoning like 'Denial risk: LOW%'").count() == 61
    vectors = E.embeddings(found, str(tmp_path / "vectors"), lambda texts: [[float(len(t))] for t in texts])
    assert vectors.where("claim_id is null").count() == 21


def test_a_failed_run_keeps_its_finished_shares(spark, tmp_path):
    claims = spark.createDataFrame([(str(i), float(i)) for i in range(40)], "claim_id string, billed_amount double")
    path = str(tmp_path / "cache")

    def some(prompts):
        if any("$7.00" in p for p in prompts):
            raise SystemExit("the worker is gone")
        return ['{"risk_level": "LOW"}' for _ in prompts]

    with pytest.raises(Exception):
        E.reasonings(claims, path, some, rounds=4, tries=1)
    done = spark.read.parquet(path).count() if tables.path_exists(spark, path) else 0

    def rest(prompts):
        return ['{"risk_level": "HIGH"}' for _ in prompts]

    again = E.reasonings(claims, path, rest, rounds=4)
    assert again.where("reasoning like 'Denial risk: LOW%'").count() == done and again.count() == 40


def test_training_beats_the_base_rate_and_covers_each_row_once(spark):
    rng = random.Random(1)
    rows = [(str(i), f"p{i % 60}", rng.choice("abc"), rng.random() * 10, "") for i in range(600)]
    df = spark.createDataFrame(rows, "claim_id string, patient_id string, kind string, billed_amount double, note string")
    df = df.withColumn("proc_count", (F.col("billed_amount") % 4).cast("int")).withColumn(
        "label_denied", ((F.col("kind") == "a") & (F.col("billed_amount") > 3)).cast("int")
    )
    df = M.materialize(df, "toy")
    train, evaluation = df.where("cast(claim_id as int) < 450"), df.where("cast(claim_id as int) >= 450")
    folded = M.materialize(M.with_folds(train, 3), "toy-folds")
    scores, _ = M.out_of_fold(folded, 3, lambda d: M.fit_model(d, M.TreeConfig(2, 3, 0.3, weighted=True)))
    assert scores.count() == 450 and scores.select("claim_id").distinct().count() == 450
    for encoding in ("one_hot", "target"):
        result = M.train_single(train, evaluation, M.TreeConfig(2, 3, 0.3, encoding=encoding), k=2)
        assert M.average_precision(result.eval_scores) > 0.6
    calibrated = M.calibrate(
        M.with_stratified_folds(train.drop("patient_id"), "label_denied", "claim_id", 2), 2,
        lambda d: M.fit_model(d, M.TreeConfig(2, 3, 0.3)),
    )
    assert M.average_precision(calibrated.score(evaluation)) > 0.6


def test_a_unique_text_column_gives_nothing_away(spark):
    """Rates leave the row's own label out, so training on an identifier in disguise changes nothing."""
    rng = random.Random(8)
    rows = [(str(i), f"p{i % 90}", rng.choice("abcd"), rng.random() * 10, f"note {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "claim_id string, patient_id string, kind string, billed_amount double, note string")
    chance = F.when(F.col("kind") == "a", 0.8).otherwise(0.2)
    df = M.materialize(df.withColumn("label_denied", (draw(F.col("claim_id"), "y") % 1000 < 1000 * chance).cast("int")), "noisy")
    text = ["kind", "note"]
    numbered = M._numbered(df)
    rates = M.value_rates(numbered, text, "label_denied")
    inside = M.with_rates(numbered, rates, text, leave_out=True)
    assert inside.select("note_rate").distinct().count() == 1 and inside.count() == 900
    plain = {r["kind"]: r for r in df.groupBy("kind").agg(F.sum("label_denied").alias("p"), F.count("*").alias("n")).collect()}
    seen = {r["kind"]: r["kind_rate"] for r in M.with_rates(numbered, rates, text, leave_out=False).select("kind", "kind_rate").distinct().collect()}
    base = sum(r["p"] for r in plain.values()) / 900
    assert all(seen[k] == pytest.approx((r["p"] + base) / (r["n"] + 1)) for k, r in plain.items())
    train, evaluation = df.where("cast(claim_id as int) < 600"), df.where("cast(claim_id as int) >= 600")
    config = M.TreeConfig(4, 3, 0.3, encoding="target")
    found = [M.average_precision(M.fit_model(t, config).score(e)) for t, e in ((train, evaluation), (train.drop("note"), evaluation.drop("note")))]
    assert found[0] == pytest.approx(found[1], abs=1e-9)


@pytest.mark.parametrize("size", [40, 20_000])
def test_isotonic_fit_equals_the_library(spark, size):
    from pyspark.ml.regression import IsotonicRegression

    rng = random.Random(size)
    rows = [(round(rng.random(), 2 if i % 2 else 5),) for i in range(500)]
    rows = [(x, int(rng.random() < x * x)) for (x,) in rows] + [(0.3 + i / 1000, 1 - i // 30) for i in range(60)]
    df = spark.createDataFrame(rows, "score double, label int")
    points = df.groupBy("score").agg(F.avg("label").alias("rate"), F.count("*").cast("double").alias("w"))
    library = IsotonicRegression(featuresCol="score", labelCol="rate", weightCol="w").fit(points)
    knots = I.fit_isotonic(df, "label", range_size=size)
    grid = spark.createDataFrame([(i / 777 - 0.1,) for i in range(950)] + [(None,)] + [(r[0],) for r in rows[:50]], "score double").repartition(3)
    expected = {r["score"]: r["prediction"] for r in library.setFeaturesCol("score").transform(grid.where("score is not null")).collect()}
    found = [(r["score"], r["value"]) for r in I.apply_isotonic(grid, knots, "score", "value").collect()]
    assert len(found) == 1001 and all(v is None if x is None else v == pytest.approx(expected[x], abs=1e-9) for x, v in found)


def test_isotonic_fit_of_falling_and_of_no_labels(spark):
    falling = spark.createDataFrame([(float(i), int(i < 50)) for i in range(100)], "score double, label int")
    assert {r["value"] for r in I.fit_isotonic(falling, "label", range_size=30).collect()} == {0.5}
    none = I.fit_isotonic(falling.limit(0), "label")
    assert none.count() == 0 and I.apply_isotonic(falling, none, "score", "value").where("value is not null").count() == 0
