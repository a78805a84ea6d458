"""Denial rules (C), duplicates (D) and the augmentation, cleaning and knowledge base jobs (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.catalog.registry import query
from claimspark.catalog.relational import augmented_cleaned, enriched, knowledge_base, tables_raw
from claimspark.catalog.scalar import resolved_sql, won_sql
from claimspark.catalog.sql_parts import CODE_OF, KB_COLUMNS, RATIO, TEXT_OF, rand_int
from claimspark.functions.values import cost_ratio
from claimspark.operators import rules as R
from claimspark.plans import augment as A
from claimspark.plans import clean as C
from claimspark.session import materialize
from claimspark.sources import roles


def pool_and_rules(spark, folder):
    pool = A.candidate_pool(A.claim_features(roles.load(spark, folder)))
    return pool, A.pool_rules(pool, roles.KEYWORDS, roles.DEPARTMENTS)


def priority_selection(spark, folder):
    """The pool and the rows the first pass selects."""
    tables = roles.load(spark, folder)
    pool, rules = pool_and_rules(spark, folder)
    selection = A.Selection(A.rule_flags(pool, rules), rules)
    A.priority_pass(selection, A._sizes(tables.claims, 9, A.TARGET_RATIO).quota)
    return pool, materialize(selection.rows(pool), "selection")


# ---- C -------------------------------------------------------------------------------


def _rule(number: int, columns):
    def build(spark, folder):
        pool, rules = pool_and_rules(spark, folder)
        return pool.where(rules[number].predicate).select("claim_id", *columns(rules[number]))

    return build


def _field(name: str, kind: str = "string"):
    """A field of the evidence record."""
    return lambda rule: F.get_json_object(rule.evidence, f"$.{name}").cast(kind).alias(name)


def _fields(*names):
    made = [_field(*n) if isinstance(n, tuple) else _field(n) for n in names]
    return lambda rule: [m(rule) for m in made]


query("c01_coordination", "select claim_id, age, insurance_type as payer from flags where c01")(
    _rule(0, _fields(("age", "double"), "payer"))
)
query(
    "c02_authorization",
    "select claim_id, admission_type, coalesce(billed_amount >= p90, false) as high_cost, billed_amount from flags where c02",
)(_rule(1, _fields("admission_type", ("high_cost", "boolean"), ("billed_amount", "double"))))
query(
    "c03_necessity",
    "select claim_id, billed_amount, has_z_code, has_chronic, diag_codes from (select * replace (coalesce(has_z_code, false) as has_z_code,"
    " coalesce(has_chronic, false) as has_chronic) from flags) where c03",
)(
    _rule(
        2,
        lambda rule: [
            *_fields(("billed_amount", "double"), ("has_z_code", "boolean"), ("has_chronic", "boolean"))(rule),
            F.when(F.col("diag_codes").isNotNull(), F.concat_ws("|", "diag_codes")).alias("diag_codes"),
        ],
    )
)
query("c04_missing_information", "select claim_id, missing from flags where c04")(
    _rule(
        3,
        lambda rule: [
            F.array_join(F.from_json(rule.evidence, "missing array<string>")["missing"], ",").alias("missing")
        ],
    )
)
query("c05_duplicate", "select f.claim_id, d.original_claim_id from flags f join dup_first d using (claim_id) where c05")(
    _rule(4, _fields("original_claim_id"))
)
query("c06_late_filing", "select claim_id, days_to_file from flags where c06")(
    _rule(5, _fields(("days_to_file", "int")))
)
query(
    "c07_coverage",
    """select claim_id, case when c01 then 'age-payer-mismatch' else 'registration-after-visit' end as reason, age,
    coalesce(strftime(visit_dt, '%d-%m-%Y'), '') as visit_date, coalesce(strftime(registration_dt, '%d-%m-%Y'), '') as registration_date
    from flags where c07""",
)(_rule(6, _fields("reason", ("age", "double"), "visit_date", "registration_date")))
query(
    "c08_non_covered",
    "select claim_id, keyword, coalesce(has_z_code, false) as has_z_code, billed_amount, department from flags where c08",
)(_rule(7, _fields("keyword", ("has_z_code", "boolean"), ("billed_amount", "double"), "department")))
query(
    "c09_bundled",
    f"select claim_id, proc_count, round({RATIO}, 6) as cost_ratio, proc_codes from flags where c09",
)(
    _rule(
        8,
        lambda rule: [
            F.col("proc_count"),
            F.round(cost_ratio(F.col("proc_second_cost"), F.col("proc_max_cost")), 6).alias("cost_ratio"),
            F.concat_ws("|", "proc_codes").alias("proc_codes"),
        ],
    )
)


# ---- D -------------------------------------------------------------------------------


def _duplicates(name: str, measure: str):
    def build(spark, folder):
        pool, _ = pool_and_rules(spark, folder)
        found = pool.where(F.col(name).isNotNull())
        return found.select(
            "claim_id",
            F.col(f"{name}.original_claim_id").alias("original_claim_id"),
            F.round(F.col(f"{name}.{measure}"), 4).alias("measure"),
            F.col(f"{name}.visit_match").alias("visit_match"),
            F.col(f"{name}.bucket").alias("bucket"),
        )

    return build


for _key, _name, _measure in (
    ("d01_dup_same_visit", "dup_visit", "amount_diff"),
    ("d02_dup_same_bucket", "dup_bucket", "amount_diff"),
    ("d03_dup_similar_amount", "dup_similar", "amount_ratio"),
):
    query(_key, f"select claim_id, original_claim_id, round(measure, 4) as measure, visit_match, bucket from {_name}")(
        _duplicates(_name, _measure)
    )


@query("d04_dup_first_kind", "select claim_id, original_claim_id, kind from dup_first")
def d04(spark, folder):
    pool, _ = pool_and_rules(spark, folder)
    kind = F.when(F.col("dup_visit").isNotNull(), 1).when(F.col("dup_bucket").isNotNull(), 2)
    original = F.get_json_object(R.duplicate_evidence(), "$.original_claim_id").alias("original_claim_id")
    return pool.where(R.duplicate_evidence().isNotNull()).select("claim_id", original, kind.otherwise(3).alias("kind"))


# ---- A -------------------------------------------------------------------------------


@query("a01_target_sizes", "select total_claims, current_denied, target_denied, need_new, category_quota from sizes")
def a01(spark, folder):
    return A.target_sizes(roles.claims(spark, folder))


@query("a02_priority_pass", f"select claim_id, {CODE_OF} as category from picked")
def a02(spark, folder):
    return priority_selection(spark, folder)[1].select("claim_id", "category")


@query("g18_category_counts", f"select {CODE_OF} as category, count(*) as n from picked group by all")
def g18(spark, folder):
    return A.category_counts(priority_selection(spark, folder)[1])


def _selection(spark, folder):
    tables = roles.load(spark, folder)
    pool, rules = pool_and_rules(spark, folder)
    return pool, A.Selection(A.rule_flags(pool, rules), rules), A._sizes(tables.claims, 9, A.TARGET_RATIO)


@query("a03_shortage_pass", f"select claim_id, {CODE_OF} as category from shortage_picked")
def a03(spark, folder):
    """Half the quotas first, so that this pass has rules to fill up."""
    pool, selection, sizes = _selection(spark, folder)
    A.priority_pass(selection, sizes.quota // 2)
    A.shortage_pass(selection, sizes.quota, sizes.need)
    return selection.rows(pool).select("claim_id", "category")


@query("a04_round_robin_pass", f"select claim_id, {CODE_OF} as category from (select * from picked union all select * from dealt)")
def a04(spark, folder):
    """All passes up to the round robin."""
    pool, selection, sizes = _selection(spark, folder)
    A.priority_pass(selection, sizes.quota)
    A.round_robin_pass(selection, sizes.need)
    return selection.rows(pool).select("claim_id", "category")


@query(
    "a05_fallback_pass",
    f"""select claim_id, {CODE_OF} as category, fallback, case when fallback then billed_amount end as billed_amount
    from half_selected join pool using (claim_id)""",
)
def a05(spark, folder):
    """Half the quotas, and the rest of the need from claims no rule took."""
    pool, selection, sizes = _selection(spark, folder)
    A.priority_pass(selection, sizes.quota // 2)
    A.fallback_pass(selection, sizes.need)
    fallback = F.coalesce(F.get_json_object("evidence", "$.fallback") == "true", F.lit(False))
    amount = F.when(fallback, F.get_json_object("evidence", "$.billed_amount").cast("double"))
    return selection.rows(pool).select("claim_id", "category", fallback.alias("fallback"), amount.alias("billed_amount"))


@query(
    "a06_apply_denials",
    """select claim_id, case when s then 'Denied' else claim_status end as claim_status, case when s then 0.0::double else paid_amount end as paid_amount
    from (select *, claim_id in (select claim_id from picked) as s from claims)""",
)
def a06(spark, folder):
    _, selected = priority_selection(spark, folder)
    return A.apply_denials(roles.claims(spark, folder), selected).select("claim_id", "claim_status", "paid_amount")


_PROFILE_OF_CODE = (
    "case category_no when 1 then 'appeal_win' when 2 then 'appeal_mix' when 3 then 'appeal_split' when 4 then 'appeal_easy' else 'none' end"
)
_OFFSET = (
    f"case category_no when 5 then 3 when 6 then 0 when 2 then {rand_int('claim_id', 5, 12, 'denial')}"
    f" else {rand_int('claim_id', 7, 21, 'denial')} end"
)


@query(
    "a07_emit_denials",
    f"""select claim_id, denial_id, denial_reason_code, denial_reason_description, denied_amount, denial_date, appeal_filed, appeal_status, appeal_resolution_date, final_outcome
    from denials union all
    select claim_id, printf('DEN%05d', last + number) as denial_id, {CODE_OF}, {TEXT_OF}, billed_amount, strftime(denied_on, '%d-%m-%Y'),
     case when profile = 'none' then 'No' else 'Yes' end, case when profile = 'none' then '' when won then 'Approved' else 'Denied' end,
     {resolved_sql("claim_id", "profile", "denied_on")}, case when coalesce(won, false) then 'Paid' else 'Written off' end
    from (select *, {won_sql("claim_id", "profile")} as won from (select *, {_PROFILE_OF_CODE} as profile,
      coalesce(claim_billing_dt, visit_dt, date '2025-03-01') + to_days({_OFFSET}) as denied_on,
      row_number() over (order by category_no, claim_id) as number,
      (select max(try_cast(nullif(regexp_extract(denial_id, '^DEN([0-9]+)$', 1), '') as bigint)) from denials) as last
     from picked join pool using (claim_id)))""",
)
def a07(spark, folder):
    _, selected = priority_selection(spark, folder)
    denials = roles.denials(spark, folder)
    return denials.unionByName(A.new_denials(selected, denials), allowMissingColumns=True).drop("_order")


@query("a08_reconcile_reasons", "select claim_id, claim_status, denial_reason_norm, denial_reason_norm_denials, denial_reason_clean from cleaned")
def a08(spark, folder):
    claims = C.clean_claims(roles.claims_with_resubmissions(spark, folder), roles.denials(spark, folder))[0]
    return claims.select(
        "claim_id", "claim_status", "denial_reason_norm", "denial_reason_norm_denials", "denial_reason_clean"
    )


@query(
    "a09_clean_variants",
    """select 'raw' as variant, claim_id, claim_status, billed_amount, denial_reason_clean from cleaned union all
    select 'balanced', claim_id, claim_status, billed_amount, denial_reason_clean from balanced union all
    select 'augmented', claim_id, claim_status, billed_amount, denial_reason_clean from cleaned_augmented""",
)
def a09(spark, folder):
    tables = tables_raw(spark, folder)
    parts = [("augmented", augmented_cleaned(spark, folder)[1])]
    parts += [(variant, C.clean_variant(tables, None, variant)) for variant in ("raw", "balanced")]
    rows = [claims.select(F.lit(v).alias("variant"), "claim_id", "claim_status", "billed_amount", "denial_reason_clean") for v, claims in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("a10_enriched_dataset", "select * from enriched")
def a10(spark, folder):
    return enriched(spark, folder)


@query(
    "a13_augmented_chain",
    """select claim_id, case when s then 'Denied' else trim(claim_status) end as claim_status,
     case when encounter_id is not null and patient_id is not null then (s or trim(claim_status) = 'Denied')::int end as label_denied
    from (select *, claim_id in (select claim_id from selected) as s from claims) where s or trim(claim_status) in ('Paid', 'Denied')""",
)
def a13(spark, folder):
    """Every augmented and cleaned claim, with its label if enrichment keeps it."""
    tables, cleaned = augmented_cleaned(spark, folder)
    cleaned = materialize(cleaned, "augmented-cleaned")
    labels = C.enrich(cleaned, tables).select("claim_id", "label_denied")
    return cleaned.select("claim_id", "claim_status").join(labels, "claim_id", "left")


@query("a10_train_eval_split", "select claim_id, patient_id, case when in_eval then 'eval' else 'train' end as split from enriched join split_groups using (patient_id)")
def a10_split(spark, folder):
    return C.split_train_eval(enriched(spark, folder)).select("claim_id", "patient_id", "split")


@query("a11_knowledge_base", f"select {', '.join(KB_COLUMNS)} from kb")
def a11(spark, folder):
    kb = knowledge_base(spark, folder).withColumn("denied_amount_sum", F.round("denied_amount_sum", 2))
    return kb.select(KB_COLUMNS)


_FEATURES = (
    "claim_id billed_amount paid_amount age insurance_type visit_type department admission_type proc_count proc_keywords proc_max_cost"
    " proc_second_cost has_chronic has_primary has_z_code days_to_file"
).split()


@query(
    "a12_claim_features",
    f"""select {", ".join(_FEATURES)}, strftime(claim_billing_dt, '%Y-%m-%d') as billed_on, strftime(visit_dt, '%Y-%m-%d') as visited_on,
    strftime(registration_dt, '%Y-%m-%d') as registered_on, diag_codes, proc_codes from feat""",
)
def a12(spark, folder):
    features = A.claim_features(roles.load(spark, folder))
    days = {"billed_on": "claim_billing_dt", "visited_on": "visit_dt", "registered_on": "registration_dt"}
    return features.select(
        *_FEATURES,
        *[F.date_format(c, "yyyy-MM-dd").alias(n) for n, c in days.items()],
        *[F.when(F.col(c).isNotNull(), F.concat_ws("|", c)).alias(c) for c in ("diag_codes", "proc_codes")],
    )


