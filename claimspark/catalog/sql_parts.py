"""SQL of the shared steps: features, pool, rules, cleaned and enriched claims."""

from __future__ import annotations

from claimspark.catalog.roles_sql import ROLES
from claimspark.operators.rules import RULE_TEXTS
from claimspark.sources.roles import DEPARTMENTS, KEYWORDS


def draw(key: str, seed: str = "42") -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::bigint"


def draw32(key: str, salt: str, seed: str = "42") -> str:
    return f"('0x' || substr(md5('{seed}:{salt}:' || {key}), 1, 8))::bigint"


def rand_int(key: str, low: int, high: int, salt: str) -> str:
    return f"({low} + {draw32(key, salt)} % {high - low})::int"


def day(c: str) -> str:
    return f"try_strptime({c}, '%d-%m-%Y')::date"


def norm_filter(c: str) -> str:
    return (
        rf"regexp_replace(lower(regexp_replace(coalesce({c}, ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), "
        r"'[\s\p{Z}]+', ' ', 'g')"
    )


def norm(c: str) -> str:
    return f"regexp_replace({norm_filter(c)}, '[.]+$', '')"


def blank(c: str) -> str:
    return f"coalesce(trim({c}), '') = ''"


def pipe(c: str, keep: str = "true") -> str:
    return f"coalesce(string_agg(distinct {c}, '|' order by {c}) filter (where {c} is not null and {keep}), '')"


def pipe_text(c: str) -> str:
    return pipe(c, f"trim({c}) <> ''")


def _child(table: str, code: str, prefix: str) -> str:
    return f"""
 select encounter_id, count(*) as {prefix}_count, count(distinct {code}) as {prefix}_distinct, {pipe(code)} as {prefix}_codes
 from {table} where encounter_id is not null group by encounter_id"""


def _child_text(table: str, code: str, prefix: str, desc: str | None, codes: str | None = None) -> str:
    more = f", {pipe_text(desc)} as {prefix}_descriptions" if desc else ""
    return f"""
 select encounter_id, count(*) as {prefix}_count, count(distinct {code}) as {prefix}_distinct,
  {pipe_text(code)} as {codes or prefix + "_codes"}{more}
 from {table} group by encounter_id"""


SENIOR = "(coalesce(age >= 65, false) and not coalesce(contains(lower(insurance_type), 'medicare'), false))"
RATIO = "(proc_second_cost / nullif(proc_max_cost, 0))"

PARTS: dict[str, str] = dict(ROLES)
PARTS |= {
    "proc_costs": """
 select encounter_id, list_sort(list(procedure_cost) filter (where procedure_cost is not null), 'DESC') as costs
 from procedures where encounter_id is not null group by encounter_id""",
    "proc_agg": f"""
 select p.encounter_id, count(procedure_id) as proc_count, {pipe("procedure_code")} as proc_codes,
  {pipe("procedure_description")} as proc_descs, string_agg(distinct lower(procedure_description), ' ' order by lower(procedure_description)) as proc_keywords,
  any_value(costs[1]) as proc_max_cost, any_value(costs[2]) as proc_second_cost
 from procedures p join proc_costs using (encounter_id) group by p.encounter_id""",
    "diag_agg": f"""
 select encounter_id, {pipe("diagnosis_code")} as diag_codes, {pipe("diagnosis_description")} as diag_descs,
  coalesce(bool_or(chronic_flag), false) as has_chronic, bool_or(primary_flag) as has_primary,
  coalesce(bool_or(diagnosis_code like 'Z%'), false) as has_z_code
 from diagnoses where encounter_id is not null group by encounter_id""",
    "feat": f"""
 select c.*, {day("claim_billing_date")} as claim_billing_dt, {day("visit_date")} as visit_dt, {day("discharge_date")} as discharge_dt,
  provider_id, visit_date, discharge_date, visit_type, department, reason_for_visit, admission_type, length_of_stay,
  age, insurance_type, phone, email, address, {day("registration_date")} as registration_dt,
  coalesce(proc_count, 0) as proc_count, proc_codes, proc_descs, proc_keywords, proc_max_cost, proc_second_cost,
  diag_codes, diag_descs, has_chronic, has_primary, has_z_code,
  date_diff('day', {day("visit_date")}, {day("claim_billing_date")})::int as days_to_file
 from claims c left join encounters e on c.encounter_id is not distinct from e.encounter_id
 left join patients p on c.patient_id is not distinct from p.patient_id
 left join proc_agg on c.encounter_id = proc_agg.encounter_id left join diag_agg on c.encounter_id = diag_agg.encounter_id""",
    "pool": f"""
 select *, round_even(billed_amount / 50, 0) * 50 as billed_bucket, {draw("claim_id")} as draw
 from feat where claim_status is distinct from 'Denied' and claim_id is not null""",
    "cuts": "select quantile_cont(billed_amount, 0.9) as p90, quantile_cont(billed_amount, 0.85) as p85 from pool",
    "dup_visit": """
 select claim_id, 1 as kind, oid as original_claim_id, abs(coalesce(billed_amount, 0) - coalesce(oamt, 0)) as measure,
  true as visit_match, billed_bucket as bucket
 from (select *, first_value(claim_id) over w as oid, first_value(billed_amount) over w as oamt from pool
  where patient_id is not null and visit_dt is not null
  window w as (partition by patient_id, visit_dt order by claim_billing_dt nulls last, claim_id)) where claim_id <> oid""",
    "dup_bucket": """
 select claim_id, 2 as kind, oid as original_claim_id, abs(coalesce(billed_amount, 0) - coalesce(oamt, 0)) as measure,
  coalesce(visit_dt = ovis, false) as visit_match, billed_bucket as bucket
 from (select *, first_value(claim_id) over w as oid, first_value(billed_amount) over w as oamt, first_value(visit_dt) over w as ovis
  from pool where patient_id is not null and billed_bucket is not null
  window w as (partition by patient_id, billed_bucket order by claim_billing_dt nulls last, claim_id)) where claim_id <> oid""",
    "dup_similar": """
 select claim_id, 3 as kind, oid as original_claim_id, abs(billed_amount - oamt) / greatest(oamt, 1::double) as measure,
  false as visit_match, billed_bucket as bucket
 from (select *, first_value(claim_id) over w as oid, first_value(billed_amount) over w as oamt from pool where patient_id is not null
  window w as (partition by patient_id order by billed_amount nulls last, claim_id))
 where claim_id <> oid and abs(billed_amount - oamt) / greatest(oamt, 1::double) <= 0.2::double""",
    "dup_first": """
 select * exclude rn from (select *, row_number() over (partition by claim_id order by kind) as rn from
  (select * from dup_visit union all select * from dup_bucket union all select * from dup_similar)) where rn = 1""",
    "flags": f"""
 select pool.*, p90, p85, dup_first.kind as dup_kind,
  nullif(regexp_extract(proc_keywords, '(?i)({"|".join(KEYWORDS)})', 1), '') as keyword,
  array_to_string(list_filter([case when {blank("phone")} then 'phone' end, case when {blank("email")} then 'email' end,
   case when {blank("address")} then 'address' end, case when coalesce(diag_codes, '') = '' then 'diagnosis' end,
   case when coalesce(proc_codes, '') = '' then 'procedure' end], lambda v: v is not null), ',') as missing,
  {SENIOR} as c01,
  coalesce(lower(admission_type) = 'elective', false) or coalesce(contains(lower(visit_type), 'inpatient'), false)
   or coalesce(billed_amount >= p90, false) as c02,
  coalesce(billed_amount >= p90, false) and (coalesce(has_z_code, false) or not coalesce(has_chronic, false)) as c03,
  missing <> '' as c04, dup_kind is not null as c05, days_to_file is not null as c06,
  {SENIOR} or coalesce(visit_dt < registration_dt, false) as c07,
  keyword is not null or ((coalesce(has_z_code, false) or coalesce(regexp_matches(department, '(?i)({"|".join(DEPARTMENTS)})'), false))
   and coalesce(billed_amount >= p85, false)) as c08,
  coalesce(proc_count >= 2 and {RATIO} <= 0.8::double, false) as c09
 from pool cross join cuts left join dup_first on pool.claim_id = dup_first.claim_id""",
    "sizes": """
 select total_claims, current_denied, target_denied, greatest(0, target_denied - current_denied) as need_new,
  ceil(greatest(0, target_denied - current_denied) / 9.0)::bigint as category_quota
 from (select count(*) as total_claims, count(*) filter (where claim_status = 'Denied') as current_denied,
  ceil(count(*) * 0.3::double)::bigint as target_denied from claims)""",
}


def _pick_steps(name: str, quota: str) -> str:
    """<name>1 .. <name>9: one part per rule, each leaving out the earlier picks; gives their union."""
    for i in range(1, 10):
        earlier = " union all ".join(f"select claim_id from {name}{j}" for j in range(1, i))
        fresh = f"claim_id not in ({earlier})" if earlier else "true"
        if i == 6:
            PARTS[f"{name}6"] = f"""
 select claim_id, 6 as category_no from (select claim_id from flags where c06
  order by days_to_file desc, draw, claim_id limit ({quota})) where {fresh}"""
        else:
            PARTS[f"{name}{i}"] = f"""
 select claim_id, {i} as category_no from flags where c0{i} and {fresh}
 order by draw, claim_id limit ({quota})"""
    return " union all ".join(f"select * from {name}{i}" for i in range(1, 10))


def _more_steps() -> str:
    """more1 .. more9: rules below the quota after the half quotas take more while the need is not met."""
    for i in (1, 2, 3, 4, 5, 7, 8, 9):
        taken = " union all ".join(["select * from half_picked", *[f"select * from more{j}" for j in range(1, i) if j != 6]])
        PARTS[f"more{i}"] = f"""
 select claim_id, {i} as category_no from flags where c0{i} and claim_id not in (select claim_id from ({taken})) order by draw, claim_id
 limit (select case when (select count(*) from ({taken})) < need_new
  then greatest(0, category_quota - (select count(*) from half_picked where category_no = {i})) else 0 end from sizes)"""
    return " union all ".join(["select * from half_picked", *[f"select * from more{i}" for i in (1, 2, 3, 4, 5, 7, 8, 9)]])


PARTS["picked"] = _pick_steps("pick", "select category_quota from sizes")
PARTS["half_picked"] = _pick_steps("half", "select category_quota // 2 from sizes")
PARTS["shortage_picked"] = _more_steps()
PARTS |= {
    "wishes": f"""
 select claim_id, rule, row_number() over (partition by rule order by {draw("rule || ':' || claim_id", "robin")}, claim_id) as wish from
  ({" union all ".join(f"select claim_id, {i - 1} as rule from flags where c0{i}" for i in (1, 2, 3, 4, 5, 7, 8, 9))})
 where claim_id not in (select claim_id from picked)""",
    "turns": """
 select claim_id, rule, row_number() over (partition by rule order by wish) as turn from
  (select *, row_number() over (partition by claim_id order by wish, rule) as best from wishes) where best = 1""",
    "dealt": """
 select claim_id, rule + 1 as category_no from turns order by turn, rule
 limit (select greatest(0, need_new - (select count(*) from picked)) from sizes)""",
    "residual": """
 select claim_id, 3 as category_no from flags where claim_id not in (select claim_id from picked union all select claim_id from dealt)
 order by draw, claim_id limit (select greatest(0, need_new - (select count(*) from picked) - (select count(*) from dealt)) from sizes)""",
    "selected": """
 select *, false as fallback from picked union all select *, false from dealt union all select *, true from residual""",
    "half_selected": """
 select *, false as fallback from half_picked union all (select claim_id, 3 as category_no, true from flags
 where claim_id not in (select claim_id from half_picked)
 order by draw, claim_id limit (select need_new - (select count(*) from half_picked) from sizes))""",
}

_CODES = ("CO22", "CO197", "CO50", "CO16", "CO18", "CO29", "CO27", "CO96", "CO97")
CODE_OF = "case category_no " + " ".join(f"when {i + 1} then '{c}'" for i, c in enumerate(_CODES)) + " end"
TEXT_OF = "case category_no " + " ".join(f"when {i + 1} then '{text}'" for i, (_, text, _) in enumerate(RULE_TEXTS)) + " end"
#: Evidence of the first rule, whose claims come first among the samples.
FIRST_EVIDENCE = """case category_no when 1 then '{"age":' || coalesce(age::varchar, 'null') || ',"payer":' || coalesce('"' || insurance_type || '"', 'null') || '}' end"""
KB_COLUMNS = (
    "claim_id encounter_id patient_id billed_amount denial_reason insurance_type provider_id visit_date department length_of_stay patient_id_enc"
    " age phone email last_name insurance_type_pat specialty department_prov email_prov diag_count diag_distinct diag_codes diag_descriptions"
    " proc_count proc_distinct proc_codes proc_descriptions lab_count lab_distinct lab_codes lab_descriptions med_count med_distinct med_names"
    " denial_ids denial_reason_codes denial_reason_descriptions denial_dates appeal_statuses final_outcomes denied_amount_sum denied_amount_max"
    " appeal_filed_any appeal_resolution_dates"
).split()

PARTS |= {
    "encounter_enriched": f"""
 select e.*, coalesce(diag_count, 0) as diag_count, coalesce(diag_distinct, 0) as diag_distinct, coalesce(diag_codes, '') as diag_codes,
  coalesce(proc_count, 0) as proc_count, coalesce(proc_distinct, 0) as proc_distinct, coalesce(proc_codes, '') as proc_codes,
  coalesce(lab_count, 0) as lab_count, coalesce(lab_distinct, 0) as lab_distinct, coalesce(lab_codes, '') as lab_codes,
  coalesce(med_count, 0) as med_count, coalesce(med_distinct, 0) as med_distinct, coalesce(med_codes, '') as med_codes
 from encounters e left join ({_child("diagnoses", "diagnosis_code", "diag")}) using (encounter_id)
 left join ({_child("procedures", "procedure_code", "proc")}) using (encounter_id)
 left join ({_child("lab_tests", "test_code", "lab")}) using (encounter_id)
 left join ({_child("medications", "drug_name", "med")}) using (encounter_id)""",
    "claims_once": """
 select * exclude (rn, row_no) from (select *, row_number() over (partition by claim_id order by row_no) as rn from claims_raw) where rn = 1""",
    "valid": f"""
 select * replace (trim(claim_status) as claim_status), {norm("denial_reason")} as denial_reason_norm
 from claims_once where trim(claim_status) in ('Paid', 'Denied')""",
    "denials_norm": f"select *, {norm('denial_reason_description')} as reason_norm from denials",
    "first_denial": """
 select claim_id, reason_norm as denial_reason_norm_denials from (select *, row_number() over (partition by claim_id order by
  claim_id nulls last, denial_id nulls last, denial_reason_code nulls last, denial_reason_description nulls last, denied_amount nulls last,
  denial_date nulls last, appeal_filed nulls last, appeal_status nulls last, appeal_resolution_date nulls last,
  final_outcome nulls last, reason_norm) as rn from denials_norm) where rn = 1""",
    "balance": """
 select floor(count(*) filter (where claim_status = 'Denied') / 0.35::double)::bigint - count(*) filter (where claim_status = 'Denied') as keep
 from cleaned""",
    "balanced": f"""
 select * from cleaned where claim_status = 'Denied' union all
 (select * from cleaned where claim_status <> 'Denied' order by {draw("claim_id")}, claim_id limit (select keep from balance))""",
    "enriched": """
 select c.claim_id, c.encounter_id, c.patient_id, c.claim_billing_date, c.billed_amount, c.payment_method, c.insurance_provider,
  e.visit_date, e.discharge_date, e.visit_type, e.department, e.reason_for_visit, e.admission_type, e.length_of_stay,
  diag_count, diag_distinct, diag_codes, proc_count, proc_distinct, proc_codes, lab_count, lab_distinct, lab_codes,
  med_count, med_distinct, med_codes, age, gender, ethnicity, marital_status, insurance_type,
  specialty, years_experience, npi, location, (claim_status = 'Denied')::int as label_denied
 from cleaned c left join encounter_enriched e on c.encounter_id = e.encounter_id
 left join patients p on c.patient_id = p.patient_id left join providers r on e.provider_id is not distinct from r.provider_id
 where c.encounter_id is not null and c.patient_id is not null""",
    "split_groups": f"""
 select patient_id, row_number() over (order by {draw("patient_id")}, patient_id) <= ceil(0.2::double * count(*) over ()) as in_eval
 from (select distinct patient_id from enriched)""",
    "denial_agg": f"""
 select claim_id, {pipe_text("denial_id")} as denial_ids, {pipe_text("denial_reason_code")} as denial_reason_codes,
  {pipe_text("denial_reason_description")} as denial_reason_descriptions, {pipe_text("denial_date")} as denial_dates,
  {pipe_text("appeal_status")} as appeal_statuses, {pipe_text("appeal_resolution_date")} as appeal_resolution_dates,
  {pipe_text("final_outcome")} as final_outcomes, round(sum(coalesce(denied_amount, 0)), 2) as denied_amount_sum,
  max(coalesce(denied_amount, 0)) as denied_amount_max,
  case when bool_or({norm_filter("appeal_filed")} = 'yes') then 'Yes' else 'No' end as appeal_filed_any
 from denials group by claim_id""",
    "insured": f"""
 select c.*, p.insurance_type as insurance_type_first from claims_once c left join patients p on c.patient_id is not distinct from p.patient_id
 where {norm_filter("claim_status")} = 'denied' and not ({norm_filter("payment_method")} in ('self-pay', 'self pay')
  or {norm_filter("insurance_provider")} in ('self-pay', 'self pay') or {norm_filter("p.insurance_type")} in ('self-pay', 'self pay'))""",
    "kb": f"""
 select c.* exclude (insurance_type_first) replace (coalesce(c.encounter_id, '') as encounter_id, coalesce(c.patient_id, '') as patient_id,
   coalesce(billed_amount, 0) as billed_amount, coalesce(denial_reason, '') as denial_reason),
  coalesce(insurance_type_first, '') as insurance_type, coalesce(e.provider_id, '') as provider_id, coalesce(visit_date, '') as visit_date,
  coalesce(e.department, '') as department, coalesce(length_of_stay, 0) as length_of_stay, coalesce(e.patient_id, '') as patient_id_enc,
  coalesce(age, 0) as age, coalesce(phone, '') as phone, coalesce(p.email, '') as email, coalesce(last_name, '') as last_name,
  coalesce(p.insurance_type, '') as insurance_type_pat, coalesce(specialty, '') as specialty, coalesce(r.department, '') as department_prov,
  coalesce(r.email, '') as email_prov,
  coalesce(diag_count, 0) as diag_count, coalesce(diag_distinct, 0) as diag_distinct, coalesce(diag_codes, '') as diag_codes,
  coalesce(diag_descriptions, '') as diag_descriptions, coalesce(proc_count, 0) as proc_count, coalesce(proc_distinct, 0) as proc_distinct,
  coalesce(proc_codes, '') as proc_codes, coalesce(proc_descriptions, '') as proc_descriptions, coalesce(lab_count, 0) as lab_count,
  coalesce(lab_distinct, 0) as lab_distinct, coalesce(lab_codes, '') as lab_codes, coalesce(lab_descriptions, '') as lab_descriptions,
  coalesce(med_count, 0) as med_count, coalesce(med_distinct, 0) as med_distinct, coalesce(med_names, '') as med_names,
  coalesce(denial_ids, '') as denial_ids, coalesce(denial_reason_codes, '') as denial_reason_codes, coalesce(denial_dates, '') as denial_dates,
  coalesce(appeal_statuses, '') as appeal_statuses, coalesce(final_outcomes, '') as final_outcomes, coalesce(denial_reason_descriptions, '') as denial_reason_descriptions,
  coalesce(denied_amount_sum, 0) as denied_amount_sum, coalesce(denied_amount_max, 0) as denied_amount_max,
  coalesce(appeal_filed_any, '') as appeal_filed_any, coalesce(appeal_resolution_dates, '') as appeal_resolution_dates
 from insured c left join encounters e on c.encounter_id is not distinct from e.encounter_id
 left join patients p on c.patient_id is not distinct from p.patient_id
 left join providers r on e.provider_id is not distinct from r.provider_id
 left join ({_child_text("diagnoses", "diagnosis_code", "diag", "diagnosis_description")}) d on c.encounter_id is not distinct from d.encounter_id
 left join ({_child_text("procedures", "procedure_code", "proc", "procedure_description")}) q on c.encounter_id is not distinct from q.encounter_id
 left join ({_child_text("lab_tests", "test_code", "lab", "test_name")}) l on c.encounter_id is not distinct from l.encounter_id
 left join ({_child_text("medications", "drug_name", "med", None, "med_names")}) m on c.encounter_id is not distinct from m.encounter_id
 left join denial_agg a on c.claim_id is not distinct from a.claim_id""",
    "scored": "select event_id, (value / 500)::double as score, (event_type = 'error')::int as label from events",
    "pr_curve": """
 select score, pos, n, sum(pos) over w as cum_pos, sum(n) over w as cum_n, sum(pos) over () as total_pos from
  (select score, sum(label) as pos, count(*) as n from scored group by score) window w as (order by score desc)""",
    "line_counts": "select l_orderkey, count(*) as n from lineitem group by l_orderkey",
}
PARTS |= {
    "valid_augmented": f"""
 select * exclude (s) replace (case when s then 'Denied' else trim(claim_status) end as claim_status), {norm("denial_reason")} as denial_reason_norm
 from (select *, claim_id in (select claim_id from selected) as s from claims) where s or trim(claim_status) in ('Paid', 'Denied')""",
    "denials_norm_augmented": f"""
 select *, {norm("denial_reason_description")} as reason_norm from (select claim_id, denial_id, denial_reason_description from denials union all
  select claim_id, printf('DEN%05d', last + number), {TEXT_OF} from (select *, row_number() over (order by category_no, claim_id) as number,
   (select max(try_cast(nullif(regexp_extract(denial_id, '^DEN([0-9]+)$', 1), '') as bigint)) from denials) as last from selected))""",
    "first_denial_augmented": """
 select claim_id, reason_norm as denial_reason_norm_denials from (select *, row_number() over (partition by claim_id order by
  denial_id nulls last, reason_norm) as rn from denials_norm_augmented) where rn = 1""",
}
for _end in ("", "_augmented"):
    PARTS[f"reason_map{_end}"] = f"""
 select l.rank, long_value, short_value from
  (select reason_norm as long_value, row_number() over (order by count(*) desc, reason_norm) as rank from denials_norm{_end} group by reason_norm) l
  join (select denial_reason_norm as short_value, row_number() over (order by count(*) desc, denial_reason_norm) as rank
   from valid{_end} where claim_status = 'Denied' group by denial_reason_norm) s on l.rank = s.rank
 where (select count(distinct reason_norm) from denials_norm{_end}) =
  (select count(distinct denial_reason_norm) from valid{_end} where claim_status = 'Denied')"""
    PARTS[f"cleaned{_end}"] = f"""
 select v.*, denial_reason_norm_denials, case when claim_status <> 'Denied' then '' when denial_reason_norm <> '' then denial_reason_norm
  else coalesce(short_value, denial_reason_norm_denials, '') end as denial_reason_clean
 from valid{_end} v left join first_denial{_end} f on v.claim_id = f.claim_id left join reason_map{_end} m on f.denial_reason_norm_denials = m.long_value"""
PARTS["child_diag"] = _child("diagnoses", "diagnosis_code", "diag")
PARTS["child_proc_text"] = _child_text("procedures", "procedure_code", "proc", "procedure_description")
PARTS["child_lab_text"] = _child_text("lab_tests", "test_code", "lab", "test_name")
PARTS["child_med_text"] = _child_text("medications", "drug_name", "med", None, "med_names")
