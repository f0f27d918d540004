"""The derived clinical and billing tables as SQL, for the equivalent SQL of each query."""

from __future__ import annotations

import re

GENDER = "case when c_custkey % 97 = 0 then null when c_custkey % 2 = 0 then 'F' else 'M' end"

TABLES = {
    "person": f"""
        select c_custkey as person_id, {GENDER} as gender,
          case when c_custkey % 61 = 0 then date '1996-02-29'
            else make_date(cast(1940 + c_custkey % 65 as int), cast(1 + c_custkey % 12 as int),
              cast(1 + c_custkey % 28 as int)) end as birthdate,
          case when c_custkey % 50 = 49 then 1 else 0 end as voided
        from customer""",
    "person_address": """
        select c_custkey as person_id, n_name as county_district,
          case when c_custkey % 83 = 0 then null else r_name end as state_province,
          case when c_custkey % 70 = 69 then 1 else 0 end as voided
        from customer join nation on c_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
    "patient_identifier": """
        select c_custkey as patient_id, c_name as identifier, 3 as identifier_type, 0 as voided
        from customer
        union all
        select c_custkey, concat('ALT-', cast(c_custkey as varchar)), 2, 0
        from customer where c_custkey % 5 = 0""",
    "concept_name": """
        select * from (values
          (1, 'Coded Diagnosis', 'FULLY_SPECIFIED', 0), (1, 'Dx', 'SHORT', 0),
          (10, 'Diabetes, Type 1', 'FULLY_SPECIFIED', 0),
          (11, 'Diabetes, Type 2', 'FULLY_SPECIFIED', 0),
          (12, 'Diabetes I, uncomplicated', 'FULLY_SPECIFIED', 0),
          (13, 'Diabetes, Juvenile', 'FULLY_SPECIFIED', 0),
          (14, 'Diabetes II, uncomplicated', 'FULLY_SPECIFIED', 0),
          (15, 'Hypertension', 'FULLY_SPECIFIED', 0), (16, 'Malaria', 'FULLY_SPECIFIED', 0),
          (17, 'Asthma', 'FULLY_SPECIFIED', 0), (17, 'Asthma (old)', 'FULLY_SPECIFIED', 1),
          (20, 'BMI', 'FULLY_SPECIFIED', 0), (21, 'BMI Status', 'FULLY_SPECIFIED', 0),
          (22, 'FBS', 'FULLY_SPECIFIED', 0), (23, 'Hb1AC', 'FULLY_SPECIFIED', 0),
          (24, 'Systolic', 'FULLY_SPECIFIED', 0), (25, 'Diastolic', 'FULLY_SPECIFIED', 0)
        ) as t(concept_id, name, concept_name_type, voided)""",
    "visit": """
        select o_orderkey as visit_id, o_custkey as patient_id, o_orderdate as date_started,
          case when o_orderkey % 100 = 99 then 1 else 0 end as voided
        from orders""",
    "line": """
        select l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber as e,
          min(l_quantity) as q, any_value(o_custkey) as o_custkey,
          any_value(o_orderdate) as o_orderdate
        from lineitem join orders on l_orderkey = o_orderkey
        group by l_orderkey, l_linenumber""",
    "encounter": """
        select e as encounter_id, l_orderkey as visit_id,
          concat('enc-', cast(e as varchar)) as uuid, o_custkey as patient_id,
          case when e % 41 = 0 then 1 else 0 end as voided
        from line""",
    "obs": """
        select e as obs_id, o_custkey as person_id, e as encounter_id,
          case when l_linenumber <= 2 then 1 when l_linenumber = 3 then 20
            when l_linenumber = 4 and l_orderkey % 2 = 0 then 22 when l_linenumber = 4 then 23
            when l_linenumber = 5 then 24 when l_linenumber = 6 then 25 else 21 end as concept_id,
          case when l_linenumber <= 2 then 10 + l_orderkey % 8 end as value_coded,
          case when l_linenumber between 3 and 6 and e % 11 <> 0 then q end as value_numeric,
          case when l_linenumber = 7 then case when q < 18 then 'Underweight'
            when q < 25 then 'Normal' when q < 35 then 'Overweight' else 'Obese' end
            end as value_text,
          o_orderdate as obs_datetime, case when e % 37 = 0 then 1 else 0 end as voided
        from line""",
    "sale_order_line": """
        select l_orderkey * 10 + l_linenumber % 4 as order_id,
          concat('enc-', cast(l_orderkey * 10 + l_linenumber as varchar)) as external_id
        from lineitem where l_linenumber in (1, 3, 5)""",
    "sale_order": """
        select distinct s as id,
          case when s % 13 = 0 then null
            else cast((s * 7919) % 500000 as double) / 100 end as amount_total,
          case l_orderkey % 3 when 0 then 'OPD' when 1 then 'IPD' end as care_setting
        from (select l_orderkey, l_orderkey * 10 + l_linenumber % 4 as s
              from lineitem where l_linenumber in (1, 3, 5))""",
    "v": f"""
        select c_name as id, {GENDER} as gender, n_name as district, r_name as state,
          o_orderdate as visit_date, o_orderpriority as diagnosis,
          o_orderstatus as care_setting, o_totalprice as amount
        from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
}


def sql(query: str, **ctes: str) -> str:
    """``query`` with the derived tables it needs, and ``ctes`` after them, put in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\w+", text)):
            if word in TABLES and word not in needed and word not in ctes:
                need(TABLES[word])
                needed.append(word)

    for text in [*ctes.values(), query]:
        need(text)
    parts = [f"{name} as ({TABLES[name]})" for name in needed]
    parts += [f"{name} as ({text})" for name, text in ctes.items()]
    return (f"with {', '.join(parts)} " if parts else "") + query
