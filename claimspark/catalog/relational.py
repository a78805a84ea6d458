"""Joins (J), aggregates (G), ranking and sampling (R), set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.catalog.registry import query
from claimspark.catalog.sql_parts import CODE_OF, FIRST_EVIDENCE
from claimspark.catalog.sql_parts import draw as draw_sql
from claimspark.catalog.sql_parts import pipe
from claimspark.functions import text as X

from claimspark.operators import aggregates as G
from claimspark.operators.folds import with_group_folds, with_stratified_folds
from claimspark.operators.joins import (
    duplicate_row_count,
    first_per_key,
    hot_keys,
    keep_first,
    lookup_join,
    rank_aligned_mapping,
)
from claimspark.operators.metrics import confusion, cost_sweep, precision_recall_curve
from claimspark.operators.ordering import exact_quantiles_of, global_rank
from claimspark.operators.sampling import downsample_negatives, sample_exact, split_by_group
from claimspark.plans import augment as A
from claimspark.plans import clean as C
from claimspark.plans import knowledge_base as K
from claimspark.plans.enrichment import with_embedding_columns
from claimspark.sources import roles


# ---- J -------------------------------------------------------------------------------


@query(
    "j01_star_enrich",
    """select c.claim_id, e.visit_type, e.department, e.patient_id as patient_id_enc, p.age, r.specialty, r.department as department_prov
    from claims c left join encounters e on c.encounter_id = e.encounter_id left join patients p on c.patient_id = p.patient_id
    left join providers r on e.provider_id is not distinct from r.provider_id""",
)
def j01(spark, folder):
    joined = C.star_join(
        roles.claims(spark, folder),
        roles.encounters(spark, folder),
        roles.patients(spark, folder),
        roles.providers(spark, folder),
    )
    return joined.select("claim_id", "visit_type", "department", "patient_id_enc", "age", "specialty", "department_prov")


@query(
    "j02_feature_join",
    "select claim_id, age, insurance_type, proc_count, proc_codes, diag_codes, days_to_file from feat",
)
def j02(spark, folder):
    return A.claim_features(roles.load(spark, folder)).select(
        "claim_id",
        "age",
        "insurance_type",
        "proc_count",
        F.when(F.col("proc_codes").isNotNull(), F.concat_ws("|", "proc_codes")).alias("proc_codes"),
        F.when(F.col("diag_codes").isNotNull(), F.concat_ws("|", "diag_codes")).alias("diag_codes"),
        "days_to_file",
    )


@query(
    "j03_null_key_join",
    """select c.claim_id, c.encounter_id, n.lines from claims c left join (select encounter_id, count(*) as lines from diagnoses group by encounter_id) n
    on c.encounter_id is not distinct from n.encounter_id""",
)
def j03(spark, folder):
    lines = roles.diagnoses(spark, folder).groupBy("encounter_id").agg(F.count(F.lit(1)).alias("lines"))
    claims = roles.claims(spark, folder)
    hot = hot_keys(claims, ["encounter_id"], 100)  # the null key is hot here
    joined = lookup_join(claims, lines, "encounter_id", null_safe=True, spread_by=["claim_id"], hot=hot)
    return joined.select("claim_id", "encounter_id", "lines")


@query(
    "j04_child_aggregates",
    """select encounter_id, diag_count, diag_distinct, diag_codes, proc_count, proc_distinct, md5(proc_codes) as proc_digest,
    lab_count, lab_codes, med_count, med_distinct from encounter_enriched""",
)
def j04(spark, folder):
    side = C.encounter_side(roles.load(spark, folder))
    return side.select(
        "encounter_id",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("diag_count", "diag_distinct", "proc_count", "proc_distinct")],
        F.coalesce("diag_codes", F.lit("")).alias("diag_codes"),
        F.md5(F.coalesce("proc_codes", F.lit(""))).alias("proc_digest"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("lab_count", "med_count", "med_distinct")],
        F.coalesce("lab_codes", F.lit("")).alias("lab_codes"),
    )


@query(
    "j05_claim_denials",
    "select c.claim_id, denial_ids, denied_amount_sum, denied_amount_max, appeal_filed_any from claims c left join denial_agg d on c.claim_id = d.claim_id",
)
def j05(spark, folder):
    joined = lookup_join(roles.claims(spark, folder), G.claim_denials(roles.denials(spark, folder)), "claim_id")
    return joined.select(
        "claim_id",
        "denial_ids",
        F.round("denied_amount_sum", 2).alias("denied_amount_sum"),
        "denied_amount_max",
        "appeal_filed_any",
    )


@query(
    "j06_first_denial",
    "select c.claim_id, denial_reason_norm_denials as reason from claims c left join first_denial d on c.claim_id = d.claim_id",
)
def j06(spark, folder):
    denials = roles.denials(spark, folder).withColumn("reason", X.normalize_text(F.col("denial_reason_description")))
    first = first_per_key(denials, "claim_id").select("claim_id", "reason")
    return lookup_join(roles.claims(spark, folder).select("claim_id"), first, "claim_id")


@query("j07_rank_aligned_mapping", "select rank, long_value, short_value from reason_map")
def j07(spark, folder):
    claims = C.paid_or_denied(first_per_key(roles.claims_with_resubmissions(spark, folder), "claim_id"))
    denied = claims.where("claim_status = 'Denied'").select(X.normalize_text(F.col("denial_reason")).alias("reason"))
    texts = roles.denials(spark, folder).select(X.normalize_text(F.col("denial_reason_description")).alias("reason"))
    return rank_aligned_mapping(texts, denied, "reason")


@query("j08_anti_join", "select claim_id, billed_amount from claims where claim_id not in (select claim_id from denials)")
def j08(spark, folder):
    taken = roles.denials(spark, folder).select("claim_id")
    return roles.claims(spark, folder).join(taken, "claim_id", "left_anti").select("claim_id", "billed_amount")


@query("j09_semi_join", "select claim_id, billed_amount from claims where claim_id in (select claim_id from denials)")
def j09(spark, folder):
    taken = roles.denials(spark, folder).select("claim_id")
    return roles.claims(spark, folder).join(taken, "claim_id", "left_semi").select("claim_id", "billed_amount")


@query(
    "j10_reattach_features",
    "select d.claim_id, d.denial_id, d.denied_amount, c.billed_amount, c.claim_status from denials d left join claims c on d.claim_id = c.claim_id",
)
def j10(spark, folder):
    selected = roles.denials(spark, folder).select("claim_id", "denial_id", "denied_amount")
    hot = hot_keys(selected, ["claim_id"], 3)
    joined = lookup_join(
        selected, roles.claims(spark, folder), "claim_id", "_feat", spread_by=["denial_id"], hot=hot
    )
    return joined.select("claim_id", "denial_id", "denied_amount", "billed_amount", "claim_status")


@query(
    "j11_group_pairing",
    """select claim_id, original_claim_id from (select claim_id, first_value(claim_id) over (partition by patient_id
    order by claim_billing_dt nulls last, claim_id) as original_claim_id from pool where patient_id is not null) where claim_id <> original_claim_id""",
)
def j11(spark, folder):
    pool = A.claim_features(roles.load(spark, folder)).where("not (claim_status <=> 'Denied')")
    first = (
        pool.where("patient_id is not null")
        .groupBy("patient_id")
        .agg(F.min(F.struct(F.col("claim_billing_dt").isNull(), "claim_billing_dt", "claim_id")).alias("o"))
        .select("patient_id", F.col("o.claim_id").alias("original_claim_id"))
    )
    hot = hot_keys(roles.claims(spark, folder), ["patient_id"], 20)
    joined = lookup_join(pool.select("claim_id", "patient_id"), first, "patient_id", spread_by=["claim_id"], hot=hot)
    return joined.where("claim_id <> original_claim_id").select("claim_id", "original_claim_id")


_SWEEP = "(select unnest([0.05::double, 0.1::double, 0.2::double, 0.3::double, 0.4::double, 0.5::double]) as threshold)"


@query(
    "j12_threshold_scores",
    f"""select threshold, count(*) filter (where score >= threshold and label = 1) as tp, count(*) filter (where score >= threshold and label = 0) as fp
    from scored cross join {_SWEEP} group by threshold""",
)
def j12(spark, folder):
    return cost_sweep(scored(spark, folder), (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)).select("threshold", "tp", "fp")


@query(
    "j13_feature_embedding_join",
    f"""select d.doc_id, d.lang, {", ".join(f"e.embedding[{i + 1}]::double as emb_{i}" for i in range(64))}
    from documents d left join embeddings e on d.doc_id = e.vec_id""",
)
def j13(spark, folder):
    base = roles.read(spark, folder, "documents").select(F.col("doc_id").alias("claim_id"), "lang")
    vectors = roles.read(spark, folder, "embeddings").select(F.col("vec_id").alias("claim_id"), "embedding")
    return with_embedding_columns(base, vectors, 64, "emb_").withColumnRenamed("claim_id", "doc_id")


# ---- G -------------------------------------------------------------------------------


@query("g01_child_summary", "select encounter_id, diag_count, diag_distinct, diag_codes from child_diag")
def g01(spark, folder):
    return G.child_summary(roles.diagnoses(spark, folder), "encounter_id", "diagnosis_code", "diag")


@query(
    "g02_child_summary_text",
    "select encounter_id, proc_count, proc_distinct, md5(proc_codes) as codes, proc_descriptions from child_proc_text",
)
def g02(spark, folder):
    summary = G.child_summary_text(
        roles.procedures(spark, folder), "encounter_id", "procedure_code", "proc", "procedure_description"
    )
    return summary.select(
        "encounter_id", "proc_count", "proc_distinct", F.md5("proc_codes").alias("codes"), "proc_descriptions"
    )


@query(
    "g03_pipe_set_no_blank",
    "select encounter_id, lab_descriptions as names from child_lab_text",
)
def g03(spark, folder):
    return roles.lab_tests(spark, folder).groupBy("encounter_id").agg(
        G.pipe_set_no_blank(F.col("test_name")).alias("names")
    )


@query("g04_any_yes", "select claim_id, appeal_filed_any from denial_agg")
def g04(spark, folder):
    return roles.denials(spark, folder).groupBy("claim_id").agg(
        G.any_yes(F.col("appeal_filed")).alias("appeal_filed_any")
    )


@query("g05_medication_summary", "select encounter_id, med_count, med_distinct, med_names from child_med_text")
def g05(spark, folder):
    return G.child_summary_text(
        roles.medications(spark, folder), "encounter_id", "drug_name", "med", codes_name="med_names"
    )


@query(
    "g06_keep_first",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (select *, row_number() over (partition by l_orderkey, l_linenumber
    order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as rn from lineitem) where rn = 1""",
)
def g06(spark, folder):
    lines = roles.read(spark, folder, "lineitem")
    order = [c for c in lines.columns if c not in ("l_orderkey", "l_linenumber")]
    first = keep_first(lines, ["l_orderkey", "l_linenumber"], [F.col(c) for c in order])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "g06_duplicate_rows",
    "select coalesce(sum(n) filter (where n > 1), 0)::bigint as duplicate_rows from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)",
)
def g06_count(spark, folder):
    return duplicate_row_count(roles.read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("g07_claim_denials", "select * from denial_agg")
def g07(spark, folder):
    return G.claim_denials(roles.denials(spark, folder)).withColumn(
        "denied_amount_sum", F.round("denied_amount_sum", 2)
    )


@query("g08_diagnosis_profile", "select encounter_id, diag_codes, diag_descs, has_chronic, has_primary, has_z_code from diag_agg")
def g08(spark, folder):
    return G.diagnosis_profile(roles.diagnoses(spark, folder)).select(
        "encounter_id",
        F.concat_ws("|", "diag_codes").alias("diag_codes"),
        F.concat_ws("|", "diag_descs").alias("diag_descs"),
        "has_chronic",
        "has_primary",
        "has_z_code",
    )


@query("g09_procedure_profile", "select encounter_id, proc_count, proc_codes, proc_descs, proc_keywords, proc_max_cost, proc_second_cost from proc_agg")
def g09(spark, folder):
    return G.procedure_profile(roles.procedures(spark, folder)).select(
        "encounter_id",
        "proc_count",
        F.concat_ws("|", "proc_codes").alias("proc_codes"),
        F.concat_ws("|", "proc_descs").alias("proc_descs"),
        "proc_keywords",
        "proc_max_cost",
        "proc_second_cost",
    )


@query(
    "g10_second_largest",
    """select l_orderkey, p[1] as largest, p[2] as second_largest from
    (select l_orderkey, list_sort(list(l_extendedprice), 'DESC') as p from lineitem group by l_orderkey)""",
)
def g10(spark, folder):
    return G.top_two(roles.read(spark, folder, "lineitem"), "l_orderkey", "l_extendedprice")


@query(
    "g11_exact_quantiles",
    """select 'o_totalprice' as name, round(quantile_cont(o_totalprice, 0.9), 4) as p90, round(quantile_cont(o_totalprice, 0.85), 4) as p85,
    round(quantile_cont(o_totalprice, 0.25), 4) as p25 from orders union all
    select 'o_custkey', round(quantile_cont(o_custkey::double, 0.9), 4), round(quantile_cont(o_custkey::double, 0.85), 4),
    round(quantile_cont(o_custkey::double, 0.25), 4) from orders""",
)
def g11(spark, folder):
    found = exact_quantiles_of(roles.read(spark, folder, "orders"), ["o_totalprice", "o_custkey"], [0.9, 0.85, 0.25])
    rows = [(name, *[round(v, 4) for v in values]) for name, values in found.items()]
    return spark.createDataFrame(rows, "name string, p90 double, p85 double, p25 double")


@query("g12_top_values", "select p_name, count(*) as n from part group by p_name order by n desc, p_name limit 10")
def g12(spark, folder):
    return G.value_counts(roles.read(spark, folder, "part"), "p_name", 10)


@query(
    "g13_run_summary",
    """select count(*) as total, count(*) filter (where claim_status = 'Denied') as denied, count(*) filter (where claim_status <> 'Denied') as paid,
    count(*) filter (where claim_status = 'Denied' and denial_reason_clean = '') as denied_no_reason,
    (select count(*) from reason_map) as mapped_reasons from cleaned""",
)
def g13(spark, folder):
    claims, mapping = C.clean_claims(roles.claims_with_resubmissions(spark, folder), roles.denials(spark, folder))
    return G.run_summary(claims, mapping)


@query(
    "g14_label_distribution",
    """select case when in_eval then 'eval' else 'train' end as split, label_denied, count(*) as n
    from enriched join split_groups using (patient_id) group by all""",
)
def g14(spark, folder):
    return G.label_distribution(C.split_train_eval(enriched(spark, folder)))


@query(
    "g15_class_weight",
    "select round(count(*) filter (where label = 0)::double / greatest(count(*) filter (where label = 1), 1), 6) as pos_weight from scored",
)
def g15(spark, folder):
    return G.class_weight(scored(spark, folder), "label").select(F.round("pos_weight", 6).alias("pos_weight"))


@query(
    "g16_max_suffix",
    "select coalesce(max(try_cast(nullif(regexp_extract(denial_id, '^DEN([0-9]+)$', 1), '') as bigint)), 0)::bigint as max_number from denials",
)
def g16(spark, folder):
    return G.max_numeric_suffix(roles.denials(spark, folder), "denial_id")


@query(
    "g17_confusion",
    """select count(*) filter (where score < 0.1::double and label = 0) as tn, count(*) filter (where score >= 0.1::double and label = 0) as fp,
    count(*) filter (where score < 0.1::double and label = 1) as fn, count(*) filter (where score >= 0.1::double and label = 1) as tp from scored""",
)
def g17(spark, folder):
    return confusion(scored(spark, folder), 0.1)


def scored(spark, folder):
    """Events as scored rows."""
    return roles.read(spark, folder, "events").select(
        "event_id", (F.col("value") / 500).alias("score"), (F.col("event_type") == "error").cast("int").alias("label")
    )


def tables_raw(spark, folder):
    """The claims tables with resubmitted claims in file order."""
    from dataclasses import replace

    return replace(roles.load(spark, folder), claims=roles.claims_with_resubmissions(spark, folder))


def enriched(spark, folder, balanced=False):
    tables = tables_raw(spark, folder)
    return C.enrich(C.clean_claims(tables.claims, tables.denials, balanced)[0], tables)


def augmented_cleaned(spark, folder):
    """The tables and their claims after augmentation and cleaning."""
    from claimspark.plans import augment as A

    tables = roles.load(spark, folder)
    result = A.augment(tables, words=roles.KEYWORDS, departments=roles.DEPARTMENTS)
    return tables, C.clean_variant(tables, (result.claims, result.denials), "augmented")


def augmented_claims(spark, folder):
    """Augmentation, cleaning and enrichment in a row."""
    tables, cleaned = augmented_cleaned(spark, folder)
    return C.enrich(cleaned, tables)


# ---- R -------------------------------------------------------------------------------


@query("r01_sample_exact", f"select doc_id, lang from documents order by {draw_sql('doc_id::varchar')}, doc_id limit 50")
def r01(spark, folder):
    return sample_exact(roles.read(spark, folder, "documents"), 50, "doc_id").select("doc_id", "lang")


@query(
    "r03_downsample",
    "select claim_id, claim_status, denial_reason_clean from balanced",
)
def r03(spark, folder):
    claims = C.clean_claims(roles.claims_with_resubmissions(spark, folder), roles.denials(spark, folder))[0]
    kept = downsample_negatives(claims, F.col("claim_status") == "Denied", "claim_id")
    return kept.select("claim_id", "claim_status", "denial_reason_clean")


@query(
    "r04_group_split",
    f"""select o_orderkey, o_custkey, case when row_number <= ceil(0.2::double * groups) then 'eval' else 'train' end as split from orders join
    (select o_custkey, row_number() over (order by {draw_sql("o_custkey::varchar")}, o_custkey) as row_number, count(*) over () as groups
     from (select distinct o_custkey from orders)) using (o_custkey)""",
)
def r04(spark, folder):
    return split_by_group(roles.read(spark, folder, "orders"), "o_custkey").select("o_orderkey", "o_custkey", "split")


@query(
    "r05_group_folds",
    """select o_orderkey, (case when (i // 3) % 2 = 0 then i % 3 else 2 - i % 3 end)::int as fold from orders join
    (select o_custkey, row_number() over (order by count(*) desc, o_custkey) - 1 as i from orders group by o_custkey) using (o_custkey)""",
)
def r05(spark, folder):
    orders = roles.read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return with_group_folds(orders, "o_custkey", 3, ["o_orderkey"], hot_rows=15).select("o_orderkey", "fold")


@query(
    "r06_stratified_folds",
    f"""select event_id, label, ((row_number() over (partition by label order by {draw_sql("event_id::varchar")}, event_id) - 1) % 5)::int as fold from scored""",
)
def r06(spark, folder):
    return with_stratified_folds(scored(spark, folder).select("event_id", "label"), "label", "event_id", 5)


@query(
    "r07_holdout",
    f"""select claim_id, row_number() over (order by {draw_sql("claim_id")}, claim_id) <= 50 as held_out from kb""",
)
def r07(spark, folder):
    held, rest = K.split_holdout(knowledge_base(spark, folder).select("claim_id"), 50)
    return held.withColumn("held_out", F.lit(True)).unionByName(rest.withColumn("held_out", F.lit(False)))


def knowledge_base(spark, folder):
    from claimspark.session import materialize

    return materialize(K.build_knowledge_base(tables_raw(spark, folder)), "kb")


@query(
    "r08_longest_delays",
    "select claim_id, days_to_file from flags where c06 order by days_to_file desc, draw, claim_id limit (select category_quota from sizes)",
)
def r08(spark, folder):
    tables = roles.load(spark, folder)
    pool = A.candidate_pool(A.claim_features(tables))
    rules = A.pool_rules(pool, roles.KEYWORDS, roles.DEPARTMENTS)
    selection = A.Selection(A.rule_flags(pool, rules), rules)
    selection.take_in_order(A._sizes(tables.claims, 9, A.TARGET_RATIO).quota, only=[5])
    return selection.rows(pool).select("claim_id", "days_to_file")


@query(
    "r09_group_original",
    """select o_custkey, o_orderkey as original from (select *, row_number() over (partition by o_custkey order by o_orderdate nulls last, o_orderkey) as rn
    from orders) where rn = 1""",
)
def r09(spark, folder):
    first = keep_first(roles.read(spark, folder, "orders"), ["o_custkey"], [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")])
    return first.select("o_custkey", F.col("o_orderkey").alias("original"))


@query(
    "r10_precision_recall_curve",
    """select score, cum_n::bigint as flagged, cum_pos::bigint as hits, round(cum_pos / cum_n, 6) as precision,
    round(cum_pos / total_pos, 6) as recall from pr_curve""",
)
def r10(spark, folder):
    return precision_recall_curve(scored(spark, folder)).select(
        "score",
        F.col("cum_n").alias("flagged"),
        F.col("cum_pos").alias("hits"),
        F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"),
    )


@query(
    "r11_sequential_ids",
    "select event_id, row_number() over (order by event_type, event_id) as number from events",
)
def r11(spark, folder):
    events = roles.read(spark, folder, "events").select("event_id", "event_type")
    return global_rank(events, [F.col("event_type"), F.col("event_id")], "number").select("event_id", "number")


@query(
    "r12_first_rows",
    f"""select category_no - 1 as category_no, claim_id, {CODE_OF} as category, {FIRST_EVIDENCE} as evidence, billed_amount
    from (select * from picked join pool using (claim_id) order by category_no, claim_id limit 20)""",
)
def r12(spark, folder):
    from claimspark.catalog.denials import priority_selection

    return A.selection_samples(priority_selection(spark, folder)[1])


# ---- U -------------------------------------------------------------------------------


@query(
    "u01_union_preferred_tail",
    """select claim_id, days_to_file, days_to_file >= 180 as preferred from pool where days_to_file is not null""",
)
def u01(spark, folder):
    pool = A.claim_features(roles.load(spark, folder)).where("not (claim_status <=> 'Denied') and days_to_file is not null")
    narrow = pool.select("claim_id", "days_to_file")
    timely = A.prefers_timely(F.col("days_to_file"))
    return narrow.where(timely).withColumn("preferred", F.lit(True)).unionByName(
        narrow.where(~timely).withColumn("preferred", F.lit(False))
    )


@query("u02_append_picks", "select claim_id, 1 as category_no from flags where c01 union all select claim_id, 3 from flags where c03")
def u02(spark, folder):
    pool = A.candidate_pool(A.claim_features(roles.load(spark, folder)))
    rules = A.pool_rules(pool, roles.KEYWORDS, roles.DEPARTMENTS)
    parts = [pool.where(rules[i].predicate).select("claim_id", F.lit(i + 1).alias("category_no")) for i in (0, 2)]
    return parts[0].unionByName(parts[1])


@query(
    "u03_union_missing_columns",
    """select claim_id, denial_id, denied_amount, null::varchar as note from denials union all
    select claim_id, null, null, claim_status from claims where claim_status = 'Pending'""",
)
def u03(spark, folder):
    old = roles.denials(spark, folder).select("claim_id", "denial_id", "denied_amount")
    new = roles.claims(spark, folder).where("claim_status = 'Pending'").select("claim_id", F.col("claim_status").alias("note"))
    return old.unionByName(new, allowMissingColumns=True)


@query(
    "u04_denied_and_sampled",
    f"""select claim_id from claims where claim_status = 'Denied' union all (select claim_id from claims where claim_status is distinct from 'Denied'
    order by {draw_sql("claim_id")}, claim_id limit 700)""",
)
def u04(spark, folder):
    claims = roles.claims(spark, folder)
    others = sample_exact(claims.where("not (claim_status <=> 'Denied')"), 700, "claim_id")
    return claims.where("claim_status = 'Denied'").unionByName(others).select("claim_id")


@query("u05_first_pair_per_claim", "select claim_id, kind, original_claim_id from dup_first")
def u05(spark, folder):
    pool = A.candidate_pool(A.claim_features(roles.load(spark, folder)))
    pairs = None
    for kind, name in enumerate(("dup_visit", "dup_bucket", "dup_similar"), 1):
        part = pool.where(F.col(name).isNotNull()).select(
            "claim_id", F.lit(kind).alias("kind"), F.col(f"{name}.original_claim_id").alias("original_claim_id")
        )
        pairs = part if pairs is None else pairs.unionByName(part)
    return keep_first(pairs, ["claim_id"], [F.col("kind")])


@query("u06_distinct_codes", f"select l_shipdate::date::varchar as day, {pipe('l_returnflag')} as flags_seen from lineitem group by l_shipdate::date")
def u06(spark, folder):
    return (
        roles.read(spark, folder, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").cast("string").alias("day"))
        .agg(G.pipe_set(F.col("l_returnflag")).alias("flags_seen"))
    )


