"""Sources and sinks (S) and modelling jobs (M)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from claimspark.catalog.registry import query, scratch
from claimspark.catalog.relational import augmented_claims, enriched, knowledge_base, scored, tables_raw
from claimspark.catalog.scalar import _DESCRIPTION
from claimspark.catalog.sql_parts import CODE_OF, FIRST_EVIDENCE, KB_COLUMNS
from claimspark.catalog.sql_parts import draw as draw_sql
from claimspark.functions.text import PROMPT_HEAD, PROMPT_TAIL
from claimspark.operators.metrics import SWEEP_COARSE, SWEEP_FINE, best_cost, confusion, cost_sweep, ranking_metrics
from claimspark.operators.sampling import split_by_group
from claimspark.plans import augment as A
from claimspark.plans import enrichment as E
from claimspark.plans import training as M
from claimspark.plans.clean import split_train_eval
from claimspark.plans.knowledge_base import build_knowledge_base, split_holdout
from claimspark.session import materialize
from claimspark.sources import roles, sinks, tables

_COSTS = """select threshold, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, (fp + 5 * fn)::double as cost, round((fp + 5 * fn) / (tp + fp + fn + tn), 6) as cost_per_example
 from (select threshold, count(*) filter (where score >= threshold and label = 1) as tp, count(*) filter (where score >= threshold and label = 0) as fp,
  count(*) filter (where score < threshold and label = 1) as fn, count(*) filter (where score < threshold and label = 0) as tn
  from scored cross join (select unnest([{0}]) as threshold) group by threshold)"""


def _costs(thresholds):
    return _COSTS.format(", ".join(f"{t}::double" for t in thresholds))


def _report_sql():
    """All seven sections of the report on the scored events."""

    def ranking(section, at):
        return f"""select '{section}' as section, null::double as threshold, metric, value from
     (select ap, round(2.0::double * tp / greatest(tp + fp + p, 1), 6) as f1_at_threshold, round((tp + tn)::double / (p + n), 6) as accuracy_at_threshold, best_f1_threshold, best_f1
      from (select *, tp + fn as p, fp + tn as n from {at}), ranks) unpivot (value for metric in (ap, f1_at_threshold, accuracy_at_threshold, best_f1_threshold, best_f1))"""

    def cells(section, at):
        return f"""select '{section}', null, metric, value::double from (select tn, fp, fn, tp from {at}) unpivot (value for metric in (tn, fp, fn, tp))"""

    def costs(section, of):
        return f"""select '{section}', threshold, metric, value from (select threshold, tp::double as tp, fp::double as fp, fn::double as fn, tn::double as tn, precision, recall, f1,
      cost, cost_per_example from {of}) unpivot (value for metric in (tp, fp, fn, tn, precision, recall, f1, cost, cost_per_example))"""

    def at(threshold):
        return f"""(select count(*) filter (where score < {threshold} and label = 0) as tn, count(*) filter (where score >= {threshold} and label = 0) as fp,
      count(*) filter (where score < {threshold} and label = 1) as fn, count(*) filter (where score >= {threshold} and label = 1) as tp from scored)"""

    curve = "(select *, 2 * (cum_pos / cum_n) * (cum_pos / total_pos) / greatest(cum_pos / cum_n + cum_pos / total_pos, 1e-12::double) as curve_f1 from pr_curve)"
    sections = [
        ranking("metrics_default", "half"), ranking("metrics_best_f1", "best"), cells("confusion_0_5", "half"), cells("confusion_best_f1", "best"),
        costs("cost_sweep", "costs"), costs("best_cost", "cheapest"),
        "select 'recommended_threshold', null, metric, value from (select best_f1_threshold as best_f1, threshold as best_cost from ranks, cheapest) unpivot (value for metric in (best_f1, best_cost))",
    ]
    return f"""with ranks as (select round(sum(pos / total_pos * cum_pos / cum_n), 6) as ap, arg_max(score, (curve_f1, -score)) as best_f1_threshold, round(max(curve_f1), 6) as best_f1 from {curve}),
    half as {at("0.5::double")}, best as {at("(select best_f1_threshold from ranks)")}, costs as ({_costs(SWEEP_FINE)}),
    cheapest as (select * from costs order by cost, threshold limit 1)
    select 'events' as part, section, threshold, metric, round(value, 6) as value from ({" union all ".join(sections)})"""


_REPORT = _report_sql()


# ---- S -------------------------------------------------------------------------------


def _csv(df, spark, label):
    path = scratch(spark, label)
    sinks.write_table(df, path, "csv")
    return path


@query(
    "s01_read_csv",
    "select patient_id, age, insurance_type, phone, email, address, registration_date from patients",
)
def s01(spark, folder):
    path = _csv(roles.patients(spark, folder), spark, "patients")
    read = tables.typed(tables.read_csv_table(spark, path, "patients", tables.read_header(spark, path)))
    return read.select("patient_id", "age", "insurance_type", "phone", "email", "address", "registration_date")


@query("s01_claim_tables", f"select {', '.join(KB_COLUMNS)} from kb")
def s01_tables(spark, folder):
    """All nine tables written as CSV, read with their headers, and joined to the knowledge base. Resubmitted claims keep their order in the file."""
    made, path = tables_raw(spark, folder), scratch(spark, "nine")
    for name, field in tables.TABLE_FIELDS.items():
        table = getattr(made, field)
        ordered = table.orderBy("row_no").drop("row_no") if "row_no" in table.columns else table
        sinks.write_table(ordered, f"{path}/{name}.csv", "csv")
    kb = build_knowledge_base(tables.read_claim_tables(spark, path))
    return kb.withColumn("denied_amount_sum", F.round("denied_amount_sum", 2)).select(KB_COLUMNS)


_SPLIT = f"""select o_orderkey, o_custkey, case when place <= ceil(0.2::double * groups) then 'eval' else 'train' end as part from orders join
 (select o_custkey, row_number() over (order by {draw_sql("o_custkey::varchar")}, o_custkey) as place, count(*) over () as groups
  from (select distinct o_custkey from orders)) using (o_custkey)"""


def _written_split(spark, folder):
    path = scratch(spark, "split")
    orders = roles.read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    sinks.write_split(split_by_group(orders, "o_custkey"), path)
    return path


@query("s02_read_split", _SPLIT)
def s02(spark, folder):
    train, evaluation = tables.read_split(spark, _written_split(spark, folder))
    return train.withColumn("part", F.lit("train")).unionByName(evaluation.withColumn("part", F.lit("eval")))


@query(
    "s03_resolve_sources",
    "select claim_id, denial_id, false as used_augmented from denials",
)
def s03(spark, folder):
    """Only one file of the augmented pair exists, so the raw pair is read."""
    raw = _csv(roles.denials(spark, folder), spark, "denials")
    missing = scratch(spark, "not-there")
    _, denials, used = tables.resolve_sources(spark, (raw, raw), (raw, missing))
    read = tables.read_csv_table(spark, denials, "denials", tables.read_header(spark, denials))
    return read.select("claim_id", "denial_id", F.lit(used).alias("used_augmented"))


@query("s04_default_training_input", f"select o_orderkey, o_custkey from ({_SPLIT}) where part = 'train'")
def s04(spark, folder):
    chosen = tables.default_training_folder(spark, scratch(spark, "not-there"), _written_split(spark, folder))
    return tables.read_split(spark, chosen)[0]


@query("s05_write_csv", "select claim_id, denial_id, denied_amount, appeal_filed from denials")
def s05(spark, folder):
    path = _csv(roles.denials(spark, folder), spark, "denials")
    read = tables.typed(tables.read_csv_table(spark, path, "denials", tables.read_header(spark, path)))
    return read.select("claim_id", "denial_id", "denied_amount", "appeal_filed")


@query("s06_passthrough", "select claim_id, claim_status, paid_amount from claims")
def s06(spark, folder):
    result = A.augment(roles.load(spark, folder), ratio=0.01, words=roles.KEYWORDS, departments=roles.DEPARTMENTS)
    return result.claims.select("claim_id", "claim_status", "paid_amount")


@query(
    "s07_augmentation_summary",
    f"""select 'total' as section, name as key, value::double as number, null::varchar as text from
     (select total_claims, current_denied, target_denied, need_new as new_denials_added, current_denied + need_new as final_denied from sizes)
     unpivot (value for name in (total_claims, current_denied, target_denied, new_denials_added, final_denied))
    union all select 'category', {CODE_OF}, count(*)::double, null from selected group by category_no
    union all select 'sample', claim_id, billed_amount, {CODE_OF} || ' ' || {FIRST_EVIDENCE} from
     (select * from selected join pool using (claim_id) order by category_no, claim_id limit 20)""",
)
def s07(spark, folder):
    """The whole augmentation's summary as one JSON document, and read from it again."""
    result = A.augment(roles.load(spark, folder), words=roles.KEYWORDS, departments=roles.DEPARTMENTS)
    path = scratch(spark, "summary")
    sinks.write_document(sinks.summary_document(result.summary, result.category_counts, result.samples), path)
    names = result.summary.columns
    sample = "struct<claim_id: string, category: string, evidence: string, billed_amount: double>"
    schema = f"{', '.join(f'{n} double' for n in names)}, per_category_counts map<string, double>, samples array<{sample}>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*")
    none = F.lit(None).cast("string")
    totals = doc.select(F.explode(F.create_map(*[v for n in names for v in (F.lit(n), F.col(n))])).alias("key", "number"))
    counts = doc.select(F.explode("per_category_counts").alias("key", "number"))
    samples = doc.select(F.explode("samples").alias("s"))
    return (
        totals.select(F.lit("total").alias("section"), "key", "number", none.alias("text"))
        .unionByName(counts.select(F.lit("category").alias("section"), "key", "number", none.alias("text")))
        .unionByName(
            samples.select(F.lit("sample").alias("section"), F.col("s.claim_id").alias("key"), F.col("s.billed_amount").alias("number"), F.concat_ws(" ", "s.category", "s.evidence").alias("text"))
        )
    )


@query("s08_metrics_json", _REPORT)
def s08(spark, folder):
    """All sections in one JSON document, and read from it again."""
    path = scratch(spark, "metrics")
    sinks.write_document(sinks.report_document(M.metrics_report(scored(spark, folder), "events", SWEEP_FINE, "label")), path)
    entry = "array<struct<threshold: double, metric: string, value: double>>"
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, map<string, {entry}>>").alias("doc"))
    sections = parsed.select(F.explode("doc").alias("part", "sections")).select("part", F.explode("sections").alias("section", "entries"))
    rows = sections.select("part", "section", F.explode("entries").alias("e")).select("part", "section", "e.*")
    return rows.withColumn("value", F.round("value", 6))


@query(
    "s09_holdout_markdown",
    f"""select '### Claim ' || claim_id || ' — Expected: Denied — Reason: ' || denial_reason || ' — Payer: ' || insurance_provider
    || ' — Patient: Pat ' || last_name as header, {", ".join(KB_COLUMNS)} from kb order by {draw_sql("claim_id")}, claim_id limit 50""",
)
def s09(spark, folder):
    """Headers of the written sections, and the rows read from their bodies."""
    held, _ = split_holdout(knowledge_base(spark, folder), 50)
    path = scratch(spark, "holdout")
    sinks.write_holdout_markdown(held, path)
    text = spark.read.text(path, wholetext=True).where(F.length("value") > 0)
    sections = text.select(F.explode(F.split("value", "(?m)^(?=### Claim )")).alias("section")).where("section like '### Claim%'")
    parsed = sections.select(
        F.regexp_extract("section", "^[^\n]*", 0).alias("header"), F.from_json(F.regexp_extract("section", "(?s)```json\n(.*)\n```", 1), held.schema).alias("row")
    ).select("header", "row.*")
    return parsed.withColumn("denied_amount_sum", F.round("denied_amount_sum", 2)).select("header", *KB_COLUMNS)


_SPLIT_ROWS = "select claim_id, in_eval, label_denied from enriched join split_groups using (patient_id)"


@query("s10_persist_model", f"select claim_id, 0.0::double as difference, label_denied::int as predicted from ({_SPLIT_ROWS}) where in_eval")
def s10(spark, folder):
    """The model read back scores as the model that was written."""
    train, evaluation = model_input(spark, folder, answered=True)
    model = M.fit_model(train, M.LEAFWISE)
    path = scratch(spark, "model")
    sinks.save_model(model.pipeline, path)
    again = replace(model, pipeline=PipelineModel.load(path))
    both = again.score(model.score(evaluation, "before"), "after")
    difference = F.round(F.abs(F.col("before") - F.col("after")), 9)
    return both.select("claim_id", difference.alias("difference"), (F.col("after") >= 0.5).cast("int").alias("predicted"))


_PROMPT = f"'{PROMPT_HEAD}' || {_DESCRIPTION} || '{PROMPT_TAIL}'"
_REASONED = f"""select claim_id, 'Denial risk: HIGH. Denial factors: late; code. Approval factors: none. Summary: ' || md5({_PROMPT}) as reasoning
 from claims c left join encounters e on c.encounter_id = e.encounter_id left join patients p on c.patient_id = p.patient_id"""


def _predict():
    """A stand-in for a language model that answers with the digest of the prompt."""

    def predict(prompts: list[str]) -> list[str]:
        import hashlib
        import json as j

        base = {"denial_reasons": ["late", "code"], "approval_reasons": ["none"], "risk_level": "HIGH"}
        return [j.dumps({**base, "reasoning_summary": hashlib.md5(p.encode()).hexdigest()}) for p in prompts]

    return predict


def _no_predict():
    def predict(prompts: list[str]) -> list[str]:
        raise RuntimeError("asked again")

    return predict


def _describable(spark, folder):
    visits = roles.encounters(spark, folder).drop("patient_id")
    people = roles.patients(spark, folder)
    joined = roles.claims(spark, folder).join(visits, "encounter_id", "left").join(people, "patient_id", "left")
    return materialize(joined, "describable")


@query("s11_reasoning_cache", _REASONED)
def s11(spark, folder):
    """The second run finds every claim in the table and asks nothing."""
    claims, path = _describable(spark, folder), scratch(spark, "reasonings")
    E.reasonings(claims, path, _predict(), rounds=2)
    return E.reasonings(claims, path, _no_predict(), tries=1)


def _encode():
    """A stand-in for a text encoder: size and two letter counts."""

    def encode(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("a")), float(t.count("e"))] for t in texts]

    return encode


def _no_encode():
    def encode(texts: list[str]) -> list[list[float]]:
        raise RuntimeError("encoded again")

    return encode


_ENCODED = """select doc_id, length(text)::double as size, (length(text) - length(replace(text, 'a', '')))::double as a,
 (length(text) - length(replace(text, 'e', '')))::double as e from documents"""


def _documents(spark, folder):
    return roles.read(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("claim_id"), "text")


def _vector_columns(vectors):
    return vectors.select(
        F.col("claim_id").cast("bigint").alias("doc_id"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("size", "a", "e"))],
    )


@query("s12_embedding_cache", _ENCODED)
def s12(spark, folder):
    texts, path = _documents(spark, folder), scratch(spark, "embeddings")
    E.embeddings(texts, path, _encode(), "text")
    return _vector_columns(E.embeddings(texts, path, _no_encode(), "text"))


# ---- M -------------------------------------------------------------------------------


def model_input(spark, folder, variant="raw", answered=False):
    """Training and evaluation rows of the enriched claims of a variant.

    `answered` adds a number column that tells the labels apart. A model that learns anything ranks all denied claims
    first then, so SQL knows every rate and count of its report; a constant model gets them wrong.
    """
    rows = augmented_claims(spark, folder) if variant == "augmented" else enriched(spark, folder, variant == "balanced")
    if answered:
        rows = rows.withColumn("answer", F.col(M.LABEL) * 4.0 + F.length("claim_id") % 3)
    rows = materialize(split_train_eval(rows), "split")
    return tuple(rows.where(F.col("split") == part).drop("split") for part in ("train", "eval"))


@query(
    "m01_preprocess",
    """with modes as (select 'insurance_type' as name, insurance_type as v, count(*) as n from patients where insurance_type is not null group by all
     union all select 'gender', gender, count(*) from patients group by all union all select 'ethnicity', ethnicity, count(*) from patients group by all)
    select name, v as mode, null::double as median from (select *, row_number() over (partition by name order by n desc, v) as rn from modes) where rn = 1
    union all select 'age', null, round(quantile_cont(age, 0.5), 4) from patients""",
)
def m01(spark, folder):
    people = roles.patients(spark, folder)
    fills = M.learn_fills(people, ["insurance_type", "gender", "ethnicity"], ["age"])
    rows = [(n, v, None) for n, v in fills.modes.items()] + [(n, None, round(v, 4)) for n, v in fills.medians.items()]
    return spark.createDataFrame(rows, "name string, mode string, median double")


@query("m01_encode", f"select claim_id, {M.HASH_WIDTH} as slots, true as numbers_kept, true as within from ({_SPLIT_ROWS}) where not in_eval")
def m01_encode(spark, folder):
    """Hash slots of the encoded vectors, whether all number columns have a place, and whether no more slots are used than there are text columns."""
    train, _ = model_input(spark, folder)
    text, numbers = M.feature_columns(train)
    ready = M.filled(train, M.learn_fills(train, text, numbers), text, numbers)
    fitted = Pipeline(stages=M.encoder_stages(text, numbers, {}, "one_hot")).fit(ready)
    dense = vector_to_array("features")
    hashed = F.slice(dense, len(numbers) + 1, M.HASH_WIDTH)
    used = F.size(F.filter(hashed, lambda v: v != 0))
    return fitted.transform(ready).select(
        "claim_id",
        F.size(hashed).alias("slots"),
        (F.size(dense) == M.HASH_WIDTH + len(numbers)).alias("numbers_kept"),
        used.between(1, len(text)).alias("within"),
    )


@query(
    "m02_ranking_metrics",
    """select round(sum(pos / total_pos * cum_pos / cum_n), 6) as ap,
    round(2.0::double * sum(pos) filter (where score >= 0.1::double) / (sum(n) filter (where score >= 0.1::double) + sum(pos)), 6) as f1_at_threshold,
    round((sum(n) - sum(n) filter (where score >= 0.1::double) - sum(pos) + 2 * sum(pos) filter (where score >= 0.1::double))::double / sum(n), 6) as accuracy_at_threshold,
    round(arg_max(score, (f1, -score)), 6) as best_f1_threshold, round(max(f1), 6) as best_f1
    from (select *, 2 * (cum_pos / cum_n) * (cum_pos / total_pos) / greatest(cum_pos / cum_n + cum_pos / total_pos, 1e-12::double) as f1 from pr_curve)""",
)
def m02(spark, folder):
    metrics = ranking_metrics(scored(spark, folder), 0.1)
    return metrics.select(*[F.round(c, 6).alias(c) for c in metrics.columns])


def _rounded_sweep(spark, folder, thresholds):
    sweep = cost_sweep(scored(spark, folder), thresholds)
    exact = {"threshold", "tp", "fp", "fn", "tn", "cost"}
    return sweep.select(*[c if c in exact else F.round(c, 6).alias(c) for c in sweep.columns])


@query("m03_cost_sweep", _costs(SWEEP_FINE))
def m03(spark, folder):
    return _rounded_sweep(spark, folder, SWEEP_FINE)


@query("m04_best_cost", f"select * from ({_costs(SWEEP_COARSE)}) order by cost, threshold limit 1")
def m04(spark, folder):
    return best_cost(_rounded_sweep(spark, folder, SWEEP_COARSE))


@query(
    "m05_out_of_fold",
    f"""with t as (select claim_id, patient_id, label_denied from enriched join split_groups using (patient_id) where not in_eval),
    g as (select patient_id, row_number() over (order by count(*) desc, patient_id) - 1 as i from t group by patient_id)
    select claim_id, (case when (i // 3) % 2 = 0 then i % 3 else 2 - i % 3 end)::int as fold, label_denied::int as predicted from t join g using (patient_id)""",
)
def m05(spark, folder):
    train, _ = model_input(spark, folder, answered=True)
    folded = materialize(M.with_folds(train, 3), "folds")
    scores, _ = M.out_of_fold(folded, 3, M.LEAFWISE, fills=M.fold_fills(folded, 3))
    return scores.select("claim_id", "fold", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Metrics whose value is a threshold, which depends on the model's scale.
_CUTS = ("best_f1_threshold", "at_threshold")


def _whole(report):
    """All rows of a report. Thresholds the model chose are null, and so are counts at thresholds near 0 and 1, where a perfect order is not enough."""
    swept = F.col("section") == "cost_sweep"
    known = ~F.col("metric").isin(*_CUTS) & (F.col("section") != "recommended_threshold") & (~swept | F.col("threshold").between(0.25, 0.75))
    return report.select(
        "part",
        "section",
        F.when(F.col("section").isin("cost_sweep", "sweep"), F.col("threshold")).alias("threshold"),
        "metric",
        F.when(known, F.round("value", 6)).alias("value"),
    )


_RANKING = [("ap", "1"), ("f1_at_threshold", "1"), ("accuracy_at_threshold", "1"), ("best_f1_threshold", "null"), ("best_f1", "1")]
_CELLS = [("tn", "negatives"), ("fp", "0"), ("fn", "0"), ("tp", "positives")]
_SWEPT = [("tp", "positives"), ("fp", "0"), ("fn", "0"), ("tn", "negatives"), ("precision", "1"), ("recall", "1"), ("f1", "1"), ("cost", "0"), ("cost_per_example", "0")]


def _perfect_sql(thresholds, settings=0):
    """Every row of the report of a model that puts all denied claims first."""

    def rows(section, entries, threshold="null"):
        return [f"select part, '{section}' as section, {threshold}::double as threshold, '{m}' as metric, {v}::double as value from parts" for m, v in entries]

    report = rows("metrics_default", _RANKING) + rows("metrics_best_f1", _RANKING) + rows("confusion_0_5", _CELLS) + rows("confusion_best_f1", _CELLS)
    report += rows("best_cost", _SWEPT) + rows("recommended_threshold", [("best_f1", "null"), ("best_cost", "null")])
    for t in thresholds:
        report += rows("cost_sweep", _SWEPT if 0.25 <= t <= 0.75 else [(m, "null") for m, _ in _SWEPT], repr(round(float(t), 4)))
    extra = []
    for n in range(1, settings + 1):
        tried = rows("metrics_default", _RANKING) + rows("best_cost", [*_SWEPT, ("at_threshold", "null")])
        extra.append(f"select 'setting_{n}_' || part as part, section, threshold, metric, value from ({' union all '.join(tried)})")
        extra += [f"select 'sweep', 'sweep', {n}, '{m}', 1" for m in ("ap_eval", "ap_cv")]
    if settings:
        extra += ["select 'sweep', 'choice', null, 'config', 1", "select 'sweep', 'choice', null, 'calibrated', 0"]
    return f"""with parts as (select case when in_eval then 'eval' else 'cv' end as part, sum(label_denied) as positives, count(*) - sum(label_denied) as negatives
     from ({_SPLIT_ROWS}) group by all)
    {" union all ".join(report + extra)}"""


@query("m06_boosted_sweep", _perfect_sql(SWEEP_FINE, len(M.SWEEP)))
def m06(spark, folder):
    """All settings, with their folds and the calibration."""
    return _whole(M.train_sweep(*model_input(spark, folder, answered=True)).report)


@query("m07_boosted_single", _perfect_sql(SWEEP_COARSE))
def m07(spark, folder):
    return _whole(M.train_single(*model_input(spark, folder, answered=True), M.LEAFWISE).report)


@query("m08_boosted_categorical", _perfect_sql(SWEEP_COARSE))
def m08(spark, folder):
    return _whole(M.train_single(*model_input(spark, folder, answered=True), M.CATEGORICAL).report)


@query("m09_isotonic_calibration", f"select claim_id, label_denied::double as score from ({_SPLIT_ROWS}) where in_eval")
def m09(spark, folder):
    """Calibrated scores of a perfect order are the labels."""
    train, evaluation = model_input(spark, folder, answered=True)
    folded = materialize(M.with_stratified_folds(train, M.LABEL, "claim_id", 3), "folds")
    scores = M.calibrate(folded, 3, M.LEAFWISE, fills=M.fold_fills(folded, 3)).score(evaluation)
    return scores.select("claim_id", F.round("score", 6).alias("score"))


@query(
    "m10_variants",
    """with labels_of as (select 'raw' as variant, label_denied from enriched union all
     select 'balanced', label_denied from enriched join (select claim_id from balanced) using (claim_id) union all
     select 'augmented', (s or trim(claim_status) = 'Denied')::int from (select *, claim_id in (select claim_id from selected) as s from claims)
      where (s or trim(claim_status) in ('Paid', 'Denied')) and encounter_id is not null and patient_id is not null)
    select variant, sum(label_denied)::bigint as tp, 0::bigint as fp, 0::bigint as fn, (count(*) - sum(label_denied))::bigint as tn from labels_of group by variant""",
)
def m10(spark, folder):
    """Confusion of the three variants, training and evaluation rows together."""
    splits = {variant: model_input(spark, folder, variant, answered=True) for variant in ("raw", "augmented", "balanced")}
    report = M.run_variants(splits, lambda train, evaluation: M.train_single(train, evaluation, M.LEAFWISE))
    cells = report.where(F.col("section") == "confusion_0_5")
    return cells.groupBy("variant").agg(*[F.sum(F.when(F.col("metric") == m, F.col("value"))).cast("bigint").alias(m) for m in ("tp", "fp", "fn", "tn")])


@query("m11_metrics_report", _REPORT)
def m11(spark, folder):
    return M.metrics_report(scored(spark, folder), "events", SWEEP_FINE, "label").withColumn("value", F.round("value", 6))


@query("m12_reasoning", _REASONED)
def m12(spark, folder):
    return E.reasonings(_describable(spark, folder), scratch(spark, "reasonings"), _predict())


@query("m13_embedding", _ENCODED)
def m13(spark, folder):
    return _vector_columns(E.embeddings(_documents(spark, folder), scratch(spark, "embeddings"), _encode(), "text"))


@query("m14_reasoning_model", _perfect_sql(SWEEP_COARSE))
def m14(spark, folder):
    """Base features plus embeddings of the reasoning texts, on the scale of the training texts."""
    train, evaluation = model_input(spark, folder, answered=True)
    texts = [E.reasonings(part, scratch(spark, "reasonings"), _predict()) for part in (train, evaluation)]
    embedder = E.fit_embedder(texts[0], dims=E.EMBED_BATCH)
    vectors = [materialize(E.hashed_embeddings(t, embedder), "vectors") for t in texts]
    return _whole(E.train_with_reasoning(train, evaluation, *vectors, E.EMBED_BATCH, M.CATEGORICAL).report)
