"""Projections, predicates (P) and scalar functions (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.catalog.registry import query
from claimspark.catalog.sql_parts import SENIOR, blank, day, draw32, norm, norm_filter, rand_int
from claimspark.functions import text as X
from claimspark.functions import values as V
from claimspark.functions.denials import appeal, base_date, denial_date, denial_id
from claimspark.functions.draws import bernoulli, random_int
from claimspark.operators import rules as R
from claimspark.operators.aggregates import max_numeric_suffix
from claimspark.operators.joins import suffix_overlap
from claimspark.operators.ordering import exact_quantiles
from claimspark.plans import augment as A
from claimspark.plans.clean import LEAK_COLUMNS, PII_COLUMNS, paid_or_denied, reason_if_denied, with_labels
from claimspark.plans.knowledge_base import denied_claims, without_self_pay
from claimspark.plans.training import feature_columns
from claimspark.sources import roles

P_COLUMNS = ["claim_id", "claim_status", "billed_amount"]
P_SQL = "claim_id, claim_status, billed_amount"


# ---- P -------------------------------------------------------------------------------


@query(
    "p01_drop_columns",
    "select patient_id, age, gender, ethnicity, marital_status, insurance_type from patients",
)
def p01(spark, folder):
    return roles.patients(spark, folder).drop(*LEAK_COLUMNS, *PII_COLUMNS)


@query(
    "p02_suffix_overlap",
    "select p.provider_id, p.department, e.department as department_enc, e.patient_id, e.encounter_id from providers p"
    " join encounters e on p.provider_id = e.provider_id",
)
def p02(spark, folder):
    left = roles.providers(spark, folder).select("provider_id", "department")
    right = roles.encounters(spark, folder).select("provider_id", "department", "patient_id", "encounter_id")
    return left.join(suffix_overlap(left, right, ["provider_id"], "_enc"), "provider_id")


@query(
    "p03_require_keys",
    f"select {P_SQL} from claims where encounter_id is not null and patient_id is not null",
)
def p03(spark, folder):
    return roles.claims(spark, folder).dropna(subset=["encounter_id", "patient_id"]).select(P_COLUMNS)


@query(
    "p04_status_domain",
    "select claim_id, trim(claim_status) as claim_status, billed_amount from claims where trim(claim_status) in ('Paid', 'Denied')",
)
def p04(spark, folder):
    return paid_or_denied(roles.claims(spark, folder)).select(P_COLUMNS)


@query("p05_denied_only", f"select {P_SQL} from claims where {norm_filter('claim_status')} = 'denied'")
def p05(spark, folder):
    return denied_claims(roles.claims(spark, folder)).select(P_COLUMNS)


@query("p06_candidate_pool", f"select {P_SQL} from claims where claim_status is distinct from 'Denied' and claim_id is not null")
def p06(spark, folder):
    return roles.claims(spark, folder).where(R.not_denied() & F.col("claim_id").isNotNull()).select(P_COLUMNS)


@query(
    "p07_self_pay_exclusion",
    f"""select c.claim_id, p.insurance_type from claims c left join patients p on c.patient_id is not distinct from p.patient_id
    where not ({norm_filter("payment_method")} in ('self-pay', 'self pay') or {norm_filter("insurance_provider")} in ('self-pay', 'self pay')
    or {norm_filter("insurance_type")} in ('self-pay', 'self pay'))""",
)
def p07(spark, folder):
    kept = without_self_pay(roles.claims(spark, folder), roles.patients(spark, folder))
    return kept.select("claim_id", "insurance_type")


@query(
    "p08_labels",
    "select claim_id, (claim_status is not distinct from 'Denied')::int as label_denied, coalesce(denial_reason, '') as label_reason from claims",
)
def p08(spark, folder):
    claims = roles.claims(spark, folder).withColumn("denial_reason_clean", F.col("denial_reason"))
    return with_labels(claims).select("claim_id", "label_denied", "label_reason")


@query(
    "p09_feature_split",
    "select patient_id, 10 as categorical, 1 as numeric_features from patients",
)
def p09(spark, folder):
    people = roles.patients(spark, folder).drop("first_name", "last_name", "phone")
    text, numbers = feature_columns(people)
    return people.select(
        "patient_id", F.lit(len(text)).alias("categorical"), F.lit(len(numbers)).alias("numeric_features")
    )


@query(
    "p10_reason_case",
    f"select claim_id, case when {SENIOR} then 'age-payer-mismatch' else 'registration-after-visit' end as reason from feat",
)
def p10(spark, folder):
    return A.claim_features(roles.load(spark, folder)).select("claim_id", R.coverage_reason().alias("reason"))


@query(
    "p11_update_by_keys",
    """select claim_id, case when d then 'Denied' else claim_status end as claim_status, case when d then 0.0::double else paid_amount end as paid_amount
    from (select c.*, c.claim_id in (select claim_id from denials) as d from claims c)""",
)
def p11(spark, folder):
    ids = roles.denials(spark, folder).select("claim_id").distinct()
    return A.apply_denials(roles.claims(spark, folder), ids).select("claim_id", "claim_status", "paid_amount")


@query(
    "p12_clear_reason",
    "select claim_id, case when claim_status is not distinct from 'Denied' then denial_reason else '' end as denial_reason from claims",
)
def p12(spark, folder):
    return roles.claims(spark, folder).select("claim_id", reason_if_denied(F.col("denial_reason")).alias("denial_reason"))


@query("p13_column_pruning", "select claim_id, denial_reason_description from denials")
def p13(spark, folder):
    return roles.denials(spark, folder).select("claim_id", "denial_reason_description")


@query(
    "p14_evidence_record",
    """select claim_id, '{"age":' || coalesce(age::varchar, 'null') || ',"payer":' || coalesce('"' || insurance_type || '"', 'null') || '}' as evidence
    from claims left join patients using (patient_id)""",
)
def p14(spark, folder):
    joined = roles.claims(spark, folder).join(roles.patients(spark, folder), "patient_id", "left")
    return joined.select("claim_id", R.denial_rules(None, None)[0].evidence.alias("evidence"))


@query("p15_evidence_check", "select count(*) as claims_checked, 0::bigint as without_evidence from flags where c01")
def p15(spark, folder):
    pool = A.candidate_pool(A.claim_features(roles.load(spark, folder)))
    rule = A.pool_rules(pool, roles.KEYWORDS, roles.DEPARTMENTS)[0]
    picked = pool.where(rule.predicate).withColumns({"evidence": rule.evidence, "category": F.lit(rule.code)})
    A.check_evidence(picked)
    return picked.agg(
        F.count(F.lit(1)).alias("claims_checked"), F.count_if(F.col("evidence").isNull()).alias("without_evidence")
    )


# ---- T -------------------------------------------------------------------------------

_MIXED_DATES = """case o_custkey % 5 when 0 then concat(year(o_orderdate), '-01-02') when 1 then concat('13/02/', year(o_orderdate))
 when 2 then 'bad' when 3 then null else concat('17-0', 1 + o_custkey % 9, '-', year(o_orderdate)) end"""


@query("t01_parse_date", f"select o_orderkey, strftime({day(_MIXED_DATES)}, '%Y-%m-%d') as parsed from orders")
def t01(spark, folder):
    text = F.expr(_MIXED_DATES)
    return roles.read(spark, folder, "orders").select(
        "o_orderkey", F.date_format(V.parse_date(text), "yyyy-MM-dd").alias("parsed")
    )


@query("t02_format_date", "select encounter_id, coalesce(visit_date, '') as visit_text from encounters")
def t02(spark, folder):
    return roles.encounters(spark, folder).select(
        "encounter_id", V.format_date(V.parse_date(F.col("visit_date"))).alias("visit_text")
    )


_MIXED_NUMBERS = "case event_type when 'click' then 'abc' when 'view' then concat(event_id, '.5') when 'error' then '' when 'signup' then null else concat('-', user_id) end"


@query("t03_to_number", f"select event_id, try_cast({_MIXED_NUMBERS} as double) as number from events")
def t03(spark, folder):
    return roles.read(spark, folder, "events").select("event_id", V.to_number(F.expr(_MIXED_NUMBERS)).alias("number"))


_MIXED_FLAGS = "case event_type when 'click' then 'true' when 'view' then 'FALSE' when 'error' then null when 'signup' then 'True' else 'yes' end"


@query("t04_to_flag", f"select event_id, case upper({_MIXED_FLAGS}) when 'TRUE' then true when 'FALSE' then false end as flag from events")
def t04(spark, folder):
    return roles.read(spark, folder, "events").select("event_id", V.to_flag(F.expr(_MIXED_FLAGS)).alias("flag"))


@query("t05_normalize_text", f"select doc_id, md5({norm('text')}) as digest, length({norm('text')}) as size from documents")
def t05(spark, folder):
    clean = X.normalize_text(F.col("text"))
    return roles.read(spark, folder, "documents").select(
        "doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("size")
    )


@query("t06_normalize_filter_text", f"select doc_id, md5({norm_filter('text')}) as digest from documents")
def t06(spark, folder):
    return roles.read(spark, folder, "documents").select(
        "doc_id", F.md5(X.normalize_filter_text(F.col("text"))).alias("digest")
    )


@query(
    "t07_contains",
    "select doc_id, contains(lower(text), 'license') as has_part, regexp_matches(text, '(?i)(password|email|copyright)') as has_word from documents",
)
def t07(spark, folder):
    return roles.read(spark, folder, "documents").select(
        "doc_id",
        X.contains_ci(F.col("text"), "License").alias("has_part"),
        X.any_word_ci(F.col("text"), ("password", "email", "copyright")).alias("has_word"),
    )


@query("t08_equals_ci", "select encounter_id, lower(admission_type) = 'elective' as elective from encounters")
def t08(spark, folder):
    return roles.encounters(spark, folder).select(
        "encounter_id", X.equals_ci(F.col("admission_type"), "ELECTIVE").alias("elective")
    )


_WORDS = ("license", "copyright", "email", "password", "http")


@query("t09_first_word", f"select doc_id, nullif(regexp_extract(text, '(?i)({'|'.join(_WORDS)})', 1), '') as word from documents")
def t09(spark, folder):
    return roles.read(spark, folder, "documents").select(
        "doc_id", X.first_word_ci(F.col("text"), _WORDS).alias("word")
    )


@query(
    "t10_any_prefix",
    "select encounter_id, coalesce(bool_or(diagnosis_code like 'Z%'), false) as has_z from diagnoses group by encounter_id",
)
def t10(spark, folder):
    codes = roles.diagnoses(spark, folder).groupBy("encounter_id").agg(F.collect_set("diagnosis_code").alias("codes"))
    return codes.select("encounter_id", X.any_prefix(F.col("codes"), "Z").alias("has_z"))


@query(
    "t11_blank",
    f"select patient_id, {blank('phone')} as no_phone, {blank('email')} as no_email from patients",
)
def t11(spark, folder):
    return roles.patients(spark, folder).select(
        "patient_id", X.is_blank(F.col("phone")).alias("no_phone"), X.is_blank(F.col("email")).alias("no_email")
    )


@query("t12_empty_list", "select claim_id, coalesce(diag_codes, '') = '' as no_diagnosis, coalesce(proc_codes, '') = '' as no_procedure from feat")
def t12(spark, folder):
    return A.claim_features(roles.load(spark, folder)).select(
        "claim_id",
        X.is_empty_list(F.col("diag_items")).alias("no_diagnosis"),
        X.is_empty_list(F.col("proc_items")).alias("no_procedure"),
    )


@query("t13_missing_fields", "select claim_id, missing from flags")
def t13(spark, folder):
    features = A.claim_features(roles.load(spark, folder)).where(R.not_denied())
    return features.select("claim_id", F.array_join(R.missing_fields(), ",").alias("missing"))


@query("t14_days_between", f"select encounter_id, date_diff('day', {day('visit_date')}, {day('discharge_date')})::int as days from encounters")
def t14(spark, folder):
    days = V.days_between(V.parse_date(F.col("discharge_date")), V.parse_date(F.col("visit_date")))
    return roles.encounters(spark, folder).select("encounter_id", days.alias("days"))


@query(
    "t15_bucket_50",
    "select o_orderkey, round_even(o_totalprice / 50, 0) * 50 as bucket, round_even(25.0::double * (o_orderkey % 9) / 50, 0) * 50 as half_bucket from orders",
)
def t15(spark, folder):
    return roles.read(spark, folder, "orders").select(
        "o_orderkey",
        V.bucket_50(F.col("o_totalprice")).alias("bucket"),
        V.bucket_50(F.lit(25.0) * (F.col("o_orderkey") % 9)).alias("half_bucket"),
    )


@query(
    "t16_relative_difference",
    """select l_orderkey, l_linenumber, l_partkey, round(abs(l_quantity - l_extendedprice) / greatest(l_extendedprice, 1::double), 6) as difference,
    round(abs(l_tax - l_discount) / greatest(l_discount, 1::double), 2) as floored from lineitem""",
)
def t16(spark, folder):
    difference = V.relative_difference(F.col("l_quantity"), F.col("l_extendedprice"))
    floored = V.relative_difference(F.col("l_tax"), F.col("l_discount"))
    return roles.read(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(difference, 6).alias("difference"),
        F.round(floored, 2).alias("floored"),
    )


@query("t17_cost_ratio", "select claim_id, round(proc_second_cost / nullif(proc_max_cost, 0), 6) as ratio from feat")
def t17(spark, folder):
    ratio = V.cost_ratio(F.col("proc_second_cost"), F.col("proc_max_cost"))
    return A.claim_features(roles.load(spark, folder)).select("claim_id", F.round(ratio, 6).alias("ratio"))


_BASE = f"coalesce(case when c.patient_id is not null then {day('claim_billing_date')} end, {day('visit_date')}, date '2025-03-01')"


def _dated(spark, folder):
    claims, visits = roles.claims(spark, folder), roles.encounters(spark, folder).drop("patient_id")
    billing = F.when(F.col("patient_id").isNotNull(), V.parse_date(F.col("claim_billing_date")))
    return claims.join(visits, "encounter_id", "left").select(
        "claim_id", base_date(billing, V.parse_date(F.col("visit_date"))).alias("base")
    )


_DATED = f"(select c.claim_id, {_BASE} as base from claims c left join encounters e on c.encounter_id = e.encounter_id)"


@query("t18_date_fallback", f"select claim_id, strftime(base, '%d-%m-%Y') as base from {_DATED}")
def t18(spark, folder):
    return _dated(spark, folder).select("claim_id", V.format_date(F.col("base")).alias("base"))


_T_CODES = ("CO18", "CO29", "CO197", "CO22")


@query(
    "t19_denial_date",
    "select claim_id, "
    + ", ".join(
        f"strftime(base + to_days({days}), '%d-%m-%Y') as {code.lower()}"
        for code, days in zip(
            _T_CODES,
            ("3", "0", rand_int("claim_id", 5, 12, "denial"), rand_int("claim_id", 7, 21, "denial")),
            strict=True,
        )
    )
    + f" from {_DATED}",
)
def t19(spark, folder):
    key = F.col("claim_id")
    return _dated(spark, folder).select(
        "claim_id",
        *[V.format_date(denial_date(F.col("base"), F.lit(c), key)).alias(c.lower()) for c in _T_CODES],
    )


_PROFILES = ("appeal_win", "appeal_easy", "appeal_mix", "appeal_split", "no_appeal")
_PROFILE_OF = (
    "case o_orderpriority when '1-URGENT' then 'appeal_win' when '2-HIGH' then 'appeal_easy' when '3-MEDIUM' then 'appeal_mix'"
    " when '4-NOT SPECIFIED' then 'appeal_split' else 'no_appeal' end"
)


def won_sql(key: str, profile: str) -> str:
    return (
        f"case when {profile} in ('appeal_win', 'appeal_easy') then true"
        f" when {profile} = 'appeal_mix' then {draw32(key, 'appeal')} / 4294967296::double < 0.3::double"
        f" when {profile} = 'appeal_split' then {draw32(key, 'appeal')} / 4294967296::double < 0.5::double end"
    )


def resolved_sql(key: str, profile: str, base: str) -> str:
    bounds = {"appeal_win": (7, 22), "appeal_easy": (5, 15), "appeal_mix": (10, 25), "appeal_split": (10, 30)}
    cases = " ".join(
        f"when '{p}' then strftime({base} + to_days({rand_int(key, lo, hi, 'resolution')}), '%d-%m-%Y')"
        for p, (lo, hi) in bounds.items()
    )
    return f"case {profile} {cases} else '' end"


@query(
    "t20_appeal",
    f"""select claim_id, case when profile = 'no_appeal' then 'No' else 'Yes' end as appeal_filed,
    case when profile = 'no_appeal' then '' when won then 'Approved' else 'Denied' end as appeal_status,
    case when coalesce(won, false) then 'Paid' else 'Written off' end as final_outcome,
    {resolved_sql("claim_id", "profile", "base")} as appeal_resolution_date
    from (select *, {won_sql("claim_id", "profile")} as won from
     (select o_orderkey::varchar as claim_id, o_orderdate as base, {_PROFILE_OF} as profile from orders))""",
)
def t20(spark, folder):
    key = F.col("o_orderkey").cast("string")
    record = appeal(F.expr(_PROFILE_OF), F.col("o_orderdate").cast("date"), key)
    return (
        roles.read(spark, folder, "orders")
        .select(key.alias("claim_id"), record.alias("a"))
        .select(
            "claim_id",
            "a.appeal_filed",
            "a.appeal_status",
            "a.final_outcome",
            V.format_date(F.col("a.appeal_resolution_date")).alias("appeal_resolution_date"),
        )
    )


@query(
    "t21_next_ids",
    """select claim_id, printf('DEN%05d', (select coalesce(max(try_cast(nullif(regexp_extract(denial_id, '^DEN([0-9]+)$', 1), '') as bigint)), 0)
     from denials) + row_number() over (order by claim_id)) as denial_id from claims""",
)
def t21(spark, folder):
    from claimspark.operators.ordering import global_rank

    last = max_numeric_suffix(roles.denials(spark, folder), "denial_id").collect()[0]["max_number"]
    ranked = global_rank(roles.claims(spark, folder).select("claim_id"), [F.col("claim_id")], "number")
    return ranked.select("claim_id", denial_id(F.lit(last) + F.col("number")).alias("denial_id"))


@query("t22_log_amount", "select claim_id, round(ln(1 + coalesce(billed_amount, 0)), 6) as log_billed from claims")
def t22(spark, folder):
    return roles.claims(spark, folder).select(
        "claim_id", F.round(V.log_amount(F.col("billed_amount")), 6).alias("log_billed")
    )


@query(
    "t23_quartile_bucket",
    """select l_orderkey, 'bin_' || len(list_filter(edges, lambda e: e < n)) as bucket from line_counts cross join
    (select list_sort(list_distinct(quantile_cont(n::double, [0.25, 0.5, 0.75]))) as edges from line_counts)""",
)
def t23(spark, folder):
    counts = roles.read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    edges = exact_quantiles(counts, "n", [0.25, 0.5, 0.75])
    return counts.select("l_orderkey", V.bucket_label(F.col("n"), edges).alias("bucket"))


def _description_sql(columns: str) -> str:
    from claimspark.functions.text import DESCRIPTION_LINES

    present = set(columns.split())
    pieces = []
    for n, line in enumerate(DESCRIPTION_LINES):
        text = ("\n" if n else "") + line
        while "{" in text:
            before, _, rest = text.partition("{")
            slot, _, text = rest.partition("}")
            name, _, default = slot.partition(":")
            pieces.append("'" + before + "'")
            if name == "billed_amount":
                pieces.append(f"coalesce(printf('%.2f', billed_amount), '{default}')")
            elif name in present:
                pieces.append(f"coalesce({name}::varchar, '{default}')")
            else:
                pieces.append(f"'{default}'")
        pieces.append("'" + text + "'")
    return " || ".join(pieces)


_DESCRIBED = "age gender ethnicity insurance_type insurance_provider payment_method visit_type department reason_for_visit admission_type length_of_stay"
_DESCRIPTION = _description_sql(_DESCRIBED)
_DESCRIBED_FROM = "claims c left join encounters e on c.encounter_id = e.encounter_id left join patients p on c.patient_id = p.patient_id"


def _described(spark, folder):
    visits = roles.encounters(spark, folder).drop("patient_id")
    joined = roles.claims(spark, folder).join(visits, "encounter_id", "left")
    joined = joined.join(roles.patients(spark, folder), "patient_id", "left").select("claim_id", "billed_amount", *_DESCRIBED.split())
    return joined.select("claim_id", X.claim_description(joined.columns).alias("description"))


@query("t24_claim_description", f"select claim_id, {_DESCRIPTION} as description from {_DESCRIBED_FROM}")
def t24(spark, folder):
    return _described(spark, folder)


@query(
    "t25_prompt",
    "select claim_id, md5('" + X.PROMPT_HEAD + f"' || {_DESCRIPTION} || '" + X.PROMPT_TAIL + f"') as digest from {_DESCRIBED_FROM}",
)
def t25(spark, folder):
    return _described(spark, folder).select("claim_id", F.md5(X.claim_prompt(F.col("description"))).alias("digest"))


_REPLY = """case event_type
 when 'click' then concat('  {"denial_reasons": ["late ', event_id, '", "code"], "approval_reasons": ["ok"], "risk_level": "HIGH", "reasoning_summary": "S', user_id, '"} ')
 when 'view' then concat('```json', chr(10), '{"denial_reasons": ["x"], "approval_reasons": ["a", "b', user_id, '"], "risk_level": "LOW", "reasoning_summary": "T"}', chr(10), '```')
 when 'error' then concat('```', chr(10), '{"denial_reasons": ["y', event_id, '"], "risk_level": "MEDIUM", "reasoning_summary": "no end"}')
 when 'signup' then concat('I cannot say for ', event_id)
 else concat('[', event_id, ', 2]') end"""
_REPLY_PARTS = f"""(select event_id, body, json_valid(body) as ok, body like '{{%' as is_object from (select event_id,
 case when starts_with(trim(r), '```') then regexp_replace(regexp_replace(trim(r), '^```[^\\n]*\\n', ''), '\\n```$', '') else trim(r) end as body
 from (select event_id, {_REPLY} as r from events)))"""
_LIST = "array_to_string(from_json(json_extract(case when ok and is_object then body end, '$.{0}'), '[\"VARCHAR\"]'), '; ')"


@query(
    "t26_parse_reply",
    f"""select event_id,
    case when not ok then 'MEDIUM' when is_object then json_extract_string(case when ok then body end, '$.risk_level') end as risk_level,
    case when not ok then 'Unable to analyze' else {_LIST.format("denial_reasons")} end as denial_reasons,
    case when not ok then 'Unable to analyze' else {_LIST.format("approval_reasons")} end as approval_reasons,
    case when not ok then 'Analysis failed - using default assessment' when is_object
     then json_extract_string(case when ok then body end, '$.reasoning_summary') end as summary
    from {_REPLY_PARTS}""",
)
def t26(spark, folder):
    reply = X.parse_reply(F.expr(_REPLY))
    return (
        roles.read(spark, folder, "events")
        .select("event_id", reply.alias("r"))
        .select(
            "event_id",
            "r.risk_level",
            F.array_join("r.denial_reasons", "; ").alias("denial_reasons"),
            F.array_join("r.approval_reasons", "; ").alias("approval_reasons"),
            F.col("r.reasoning_summary").alias("summary"),
        )
    )


@query(
    "t27_reasoning_text",
    f"""select event_id, case
    when not ok then 'Denial risk: MEDIUM. Denial factors: Unable to analyze. Approval factors: Unable to analyze. Summary: Analysis failed - using default assessment'
    when is_object then 'Denial risk: ' || coalesce(json_extract_string(case when ok then body end, '$.risk_level'), 'MEDIUM')
     || '. Denial factors: ' || coalesce({_LIST.format("denial_reasons")}, 'Unknown') || '. Approval factors: '
     || coalesce({_LIST.format("approval_reasons")}, 'Unknown') || '. Summary: ' || coalesce(json_extract_string(case when ok then body end, '$.reasoning_summary'), '')
    else '{X.UNAVAILABLE}' end as reasoning from {_REPLY_PARTS}""",
)
def t27(spark, folder):
    return roles.read(spark, folder, "events").select(
        "event_id", X.reasoning_text(X.parse_reply(F.expr(_REPLY))).alias("reasoning")
    )


@query(
    "t28_row_json",
    """select patient_id, '{"phone":' || coalesce('"' || phone || '"', 'null') || ',"city":"' || city || '"}' as json from patients""",
)
def t28(spark, folder):
    return roles.patients(spark, folder).select("patient_id", X.row_json("phone", "city").alias("json"))


@query(
    "t29_fill_missing",
    """select c.claim_id, coalesce(billed_amount, 0) as billed_amount, coalesce(denial_reason, '') as denial_reason,
    coalesce(d.diag_count, 0) as diag_count from claims c left join child_diag d on c.encounter_id = d.encounter_id""",
)
def t29(spark, folder):
    from claimspark.operators.aggregates import child_summary

    counts = child_summary(roles.diagnoses(spark, folder), "encounter_id", "diagnosis_code", "diag")
    joined = roles.claims(spark, folder).join(counts, "encounter_id", "left")
    return V.fill_missing(joined.select("claim_id", "billed_amount", "denial_reason", "diag_count"))


@query(
    "r02_random_draws",
    f"""select o_orderkey, {rand_int("o_orderkey::varchar", 5, 12, "x")} as number,
    {draw32("o_orderkey::varchar", "y")} / 4294967296::double < 0.3::double as hit from orders""",
)
def r02(spark, folder):
    key = F.col("o_orderkey")
    return roles.read(spark, folder, "orders").select(
        "o_orderkey", random_int(key, 5, 12, "x").alias("number"), bernoulli(key, 0.3, "y").alias("hit")
    )


