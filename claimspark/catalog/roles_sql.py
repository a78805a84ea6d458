"""The claims roles of `sources.roles` as SQL, one common table expression per role."""

from __future__ import annotations

import re

ROLES: dict[str, str] = {
    "claims": """
 select o_orderkey::varchar as claim_id,
  case when o_orderkey % 97 <> 0 then o_orderkey::varchar end as encounter_id,
  case when o_orderkey % 101 <> 0 then o_custkey::varchar end as patient_id,
  'B' || o_orderkey::varchar as billing_id,
  strftime(o_orderdate, '%d-%m-%Y') as claim_billing_date,
  case when o_orderkey % 103 <> 0 then o_totalprice end as billed_amount,
  case when day(o_orderdate) in (1, 11, 21) then 0.0::double else o_totalprice end as paid_amount,
  case when o_orderkey % 89 = 0 then null when day(o_orderdate) in (1, 11, 21) then 'Denied'
   when day(o_orderdate) in (2, 12) then 'Pending' when day(o_orderdate) = 22 then 'denied '
   when day(o_orderdate) in (3, 13) then ' Paid ' else 'Paid' end as claim_status,
  case when day(o_orderdate) in (1, 11, 21) and o_custkey % 9 <> 0 then '  ' || o_orderpriority || '.' end as denial_reason,
  case when o_orderpriority = '5-LOW' then 'Self-Pay' else 'Insurance' end as payment_method,
  case when o_custkey % 11 = 0 then ' Self  Pay ' else 'Payer ' || (o_custkey % 7)::varchar end as insurance_provider
 from orders""",
    "claims_raw": """
 select *, 0 as row_no from claims union all by name
 select * replace (billed_amount + 1 as billed_amount), 1 as row_no from claims where claim_status = 'Pending'""",
    "encounters": """
 select o_orderkey::varchar as encounter_id, o_custkey::varchar as patient_id, supp::varchar as provider_id,
  strftime(first_day, '%d-%m-%Y') as visit_date, strftime(last_day, '%d-%m-%Y') as discharge_date,
  case when o_orderkey % 10 = 0 then 'Inpatient Stay' else 'Outpatient' end as visit_type,
  r_name as department, o_orderstatus as reason_for_visit,
  case when o_orderpriority = '1-URGENT' then 'Elective' else 'Emergency' end as admission_type,
  date_diff('day', first_day, last_day)::double as length_of_stay
 from orders
 left join (select l_orderkey, min(l_suppkey) as supp, min(l_shipdate)::date as first_day, max(l_shipdate)::date as last_day
  from lineitem group by l_orderkey) on o_orderkey = l_orderkey
 left join (select c_custkey, r_name from customer join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey) on o_custkey = c_custkey""",
    "diagnoses": """
 select case when not (l_orderkey % 50 = 0 and l_linenumber = 7) then l_orderkey::varchar end as encounter_id,
  case when l_linenumber <> 6 then (case when l_returnflag = 'R' then 'Z' else l_returnflag end) || l_linestatus end as diagnosis_code,
  'Finding ' || l_returnflag as diagnosis_description,
  l_linenumber = 1 as primary_flag,
  case when l_linestatus = 'O' then true when l_linenumber < 5 then false end as chronic_flag
 from lineitem""",
    "procedures": """
 select case when not (l_orderkey % 50 = 0 and l_linenumber = 7) then l_orderkey::varchar end as encounter_id,
  case when l_linenumber <> 5 then l_orderkey::varchar || '-' || l_linenumber::varchar end as procedure_id,
  'P' || l_partkey::varchar as procedure_code,
  upper(p_name[1]) || p_name[2:] as procedure_description,
  case when l_linenumber <> 7 then l_extendedprice end as procedure_cost
 from lineitem left join part on l_partkey = p_partkey""",
    "lab_tests": """
 select case when not (l_orderkey % 50 = 0 and l_linenumber = 7) then l_orderkey::varchar end as encounter_id,
  'L' || l_linenumber::varchar as test_code,
  case when l_linenumber = 2 then '  ' else 'Panel ' || l_linenumber::varchar end as test_name
 from lineitem""",
    "medications": """
 select case when not (l_orderkey % 50 = 0 and l_linenumber = 7) then l_orderkey::varchar end as encounter_id,
  p_brand as drug_name
 from lineitem left join part on l_partkey = p_partkey""",
    "patients": """
 select c_custkey::varchar as patient_id, 'Pat' as first_name, c_name as last_name,
  case when c_custkey % 17 <> 0 then (18 + c_custkey % 70)::double end as age,
  case when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
  'E' || (c_custkey % 5)::varchar as ethnicity, 'S' || (c_custkey % 3)::varchar as marital_status,
  case when c_mktsegment = 'MACHINERY' then 'Medicare Advantage'
   when c_mktsegment = 'BUILDING' and c_custkey % 3 = 0 then null else c_mktsegment end as insurance_type,
  case when c_acctbal >= 0 then '555-' || c_custkey::varchar end as phone,
  case when c_custkey % 19 = 0 then '  ' else 'p' || c_custkey::varchar || '@x.org' end as email,
  case when c_custkey % 23 <> 0 then c_custkey::varchar || ' Main St' end as address,
  n_name as city, 'CA' as state, '9' || c_custkey::varchar as zip,
  strftime(date '1996-01-01' + to_days((c_custkey % 365)::int), '%d-%m-%Y') as registration_date
 from customer left join nation on c_nationkey = n_nationkey""",
    "providers": """
 select s_suppkey::varchar as provider_id, s_name as name, 'D' || (s_suppkey % 8)::varchar as department,
  'Specialty ' || (s_suppkey % 6)::varchar as specialty, (s_suppkey % 40)::double as years_experience,
  'N' || s_suppkey::varchar as npi, 'Site ' || (s_suppkey % 4)::varchar as location,
  'd' || s_suppkey::varchar || '@x.org' as email, 'call' as contact_info
 from supplier""",
    "denials": """
 select l_orderkey::varchar as claim_id,
  case when l_linenumber = 4 then 'XDEN' || l_orderkey::varchar
   else printf('DEN%05d', l_orderkey * 10 + l_linenumber) end as denial_id,
  'CO' || l_linenumber::varchar as denial_reason_code,
  case when l_linenumber <> 7 then lower(c_mktsegment) || ' ...' end as denial_reason_description,
  case when l_linenumber <> 3 then l_extendedprice end as denied_amount,
  strftime(l_shipdate, '%d-%m-%Y') as denial_date,
  case when l_linenumber % 2 = 0 then ' YES ' else 'No' end as appeal_filed,
  case when l_linenumber % 2 = 0 then 'Approved' else '' end as appeal_status,
  case when l_linenumber % 2 = 0 then strftime(l_shipdate + to_days(9), '%d-%m-%Y') end as appeal_resolution_date,
  case when l_linenumber % 2 = 0 then 'Paid' else 'Written off' end as final_outcome
 from lineitem join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
 where l_returnflag = 'R' and day(o_orderdate) in (1, 11, 21)""",
}


def with_parts(query: str, parts: dict[str, str]) -> str:
    """`query` behind a WITH clause of the parts it names, directly or through other parts."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in parts:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(parts[name])
                needed.append(name)

    visit(query)
    body = query.strip()
    clauses = [f"{name} as ({parts[name]})" for name in needed]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(clauses + [body[5:]]) if clauses else body
    return ("with " + ",\n".join(clauses) + "\n" + body) if clauses else body
