"""SQL equivalent to each query, in the dialect of the checking engine (DuckDB)."""

from __future__ import annotations

from checks.adapter_sql import sql

ORACLE: dict[str, str] = {}

RANGE = "timestamp '1996-01-01' and {0} < timestamp '1999-01-01'"
AGE = """(year({1}) - year({0}) - case when month({1}) < month({0})
  or (month({1}) = month({0}) and day({1}) < day({0})) then 1 else 0 end)"""
TODAY = "date '2024-01-01'"
DIABETES = """('Diabetes, Type 1', 'Diabetes, Type 2', 'Diabetes I, uncomplicated',
  'Diabetes, Juvenile', 'Diabetes II, uncomplicated')"""


def in_range(column: str) -> str:
    return f"{column} >= {RANGE.format(column)}"


def age(birthdate: str, day: str = TODAY) -> str:
    return f"cast({AGE.format(birthdate, day)} as int)"


def start_of(interval: str, column: str = "visit_date") -> str:
    unit = {"Years": "year", "Quarters": "quarter", "Months": "month"}[interval]
    return f"cast(date_trunc('{unit}', {column}) as timestamp)"


def percent(part: str, whole: str) -> str:
    """Two decimals, ties to even, on integers."""
    rest = f"((10000 * {part}) % {whole})"
    down = f"((10000 * {part} - {rest}) // {whole})"
    up = f"case when 2 * {rest} > {whole} or (2 * {rest} = {whole} and {down} % 2 = 1) then 1 else 0 end"
    return f"(cast({down} + {up} as double) / cast(100 as double))"


# --- sources and sinks ---------------------------------------------------------------

ORACLE["scan_clinical"] = sql(
    "select obs_id, person_id, cast(concept_id as bigint) as concept_id, value_numeric, "
    "value_text, obs_datetime from obs where voided = 0"
)
ORACLE["scan_billing"] = sql("select id, amount_total, care_setting from sale_order")
ORACLE["sql_source"] = sql("select distinct order_id, external_id from sale_order_line")
FLAT = """id as "ID", gender as "Gender", district as "District", state as "State",
  visit_date as "Visit Date", diagnosis as "Diagnosis", care_setting as "Care Setting",
  amount as "Amount" """
ORACLE["export_csv"] = sql(
    f"""select {FLAT}, '  ' || district || chr(10) || '"quoted", ' || gender || ' ' || chr(9) as "Note" from v"""
)
ORACLE["export_crosstab_csv"] = sql(
    """select diagnosis as "Diagnosis", count(case when gender = 'F' then 1 end) as "F",
    count(case when gender = 'M' then 1 end) as "M" from v group by diagnosis"""
)

# --- filters and projections ---------------------------------------------------------

ORACLE["filter_active"] = sql("select encounter_id, visit_id, uuid from encounter where voided = 0")
ORACLE["filter_in_list"] = (
    "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')"
)
CODED = """(select concept_id from concept_name where name = 'Coded Diagnosis'
  and concept_name_type = 'FULLY_SPECIFIED' and voided = 0)"""
ORACLE["filter_scalar_lookup"] = sql(
    f"select obs_id, person_id, value_coded from obs where voided = 0 and concept_id = {CODED}"
)
ORACLE["filter_date_range"] = sql(
    f"""select id as "ID", visit_date as "Visit Date" from v where {in_range('visit_date')}"""
)
ORACLE["fetch_all_switch"] = sql(
    f"""select 'all' as fetch, count(*) as n from v union all
    select 'range', count(*) from v where {in_range('visit_date')}"""
)
ORACLE["filter_any_not_null"] = sql(
    """select obs_id, value_numeric, value_text from obs
    where voided = 0 and (value_numeric is not null or value_text is not null)"""
)
ORACLE["project_rename"] = sql(
    """select person_id, county_district as "District", state_province as "Home State"
    from person_address where voided = 0"""
)
NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]
ORACLE["select_numeric_columns"] = " union all ".join(
    f"""select '{name}' as "column", count({name}) as n, cast(min({name}) as double) as least,
    cast(max({name}) as double) as greatest from lineitem"""
    for name in NUMERIC
)
ORACLE["table_view"] = sql(
    f"""select {FLAT} from v where diagnosis ilike '%high%' and gender in ('F', 'M')
    and amount between 1000 and 450000 and visit_date >= timestamp '1996-01-01'
    and visit_date < timestamp '1998-01-01'
    order by state nulls first, amount desc nulls last, id nulls first, gender nulls first,
    district nulls first, visit_date nulls first, diagnosis nulls first,
    care_setting nulls first limit 25 offset 50"""
)

ORACLE["table_view_deep"] = """select l_orderkey, l_linenumber, l_shipdate, l_extendedprice from lineitem
  order by l_shipdate desc nulls last, l_extendedprice nulls first, l_orderkey nulls first, l_linenumber nulls first
  limit 25 offset 4975"""
ORACLE["table_view_after"] = """select o_orderkey, o_orderdate, o_totalprice from orders
  where o_orderdate >= '1996-01-01' order by o_orderdate, o_totalprice desc, o_orderkey limit 40"""

# --- joins ---------------------------------------------------------------------------

NAMES = """(select concept_id, name from concept_name
  where voided = 0 and concept_name_type = 'FULLY_SPECIFIED')"""
ORACLE["join_concept_names"] = sql(
    f"""select obs_id, value_coded, name from obs join {NAMES} c on value_coded = c.concept_id
    where voided = 0"""
)
PATIENT_DIM = f"""select p.person_id, p.gender as "Gender", {age('p.birthdate')} as "Age",
  a.county_district as "District", a.state_province as "State", i.identifier
  from person p join person_address a on p.person_id = a.person_id
  join patient_identifier i on p.person_id = i.patient_id
  where p.voided = 0 and a.voided = 0 and i.voided = 0 and i.identifier_type = 3"""
ORACLE["join_patient_dim"] = sql(PATIENT_DIM)
LINKS = "(select distinct order_id, external_id from sale_order_line)"
ORACLE["join_left_orders"] = sql(
    f"""select encounter_id, e.uuid, order_id, external_id from
    (select encounter_id, case when encounter_id % 41 <> 0 then uuid end as uuid
     from encounter) e
    left join {LINKS} l on e.uuid is not distinct from l.external_id"""
)
ORACLE["join_left_amounts"] = sql(
    f"""select encounter_id, order_id, amount_total, care_setting from encounter e
    left join {LINKS} l on e.uuid = l.external_id left join sale_order s on l.order_id = s.id
    where e.voided = 0"""
)


def cohort(names: str, everything: bool = False) -> str:
    seen = "true" if everything else in_range("obs_datetime")
    return f"""select distinct person_id, encounter_id from obs where voided = 0
      and concept_id = {CODED} and value_coded in
      (select concept_id from {NAMES} where name in {names}) and {seen}"""


ORACLE["semi_join_ids"] = sql(
    """select encounter_id, visit_id from encounter e where voided = 0 and exists (
      select 1 from encounter d where d.voided = 0 and d.visit_id = e.visit_id and exists (
        select 1 from cohort c where c.encounter_id = d.encounter_id))""",
    cohort=cohort(DIABETES),
)
SIZES = "(values ('small', 1, 12), ('medium', 10, 30), ('large', 31, 45)) as r(category, lo, hi)"
LINE = "l_orderkey, l_linenumber, l_quantity, l_discount"
ORACLE["derive_one_var"] = (
    f"""select {LINE}, category as "Size" from lineitem join {SIZES} on l_quantity between lo and hi"""
)
ORACLE["derive_two_var"] = f"""select {LINE}, category as "Deal" from lineitem
  join (values ('bulk', 25, 50, cast(0.05 as double), cast(0.1 as double)),
    ('plain', 1, 50, cast(0 as double), cast(0.02 as double)),
    ('tiny bargain', 1, 5, cast(0.06 as double), cast(0.1 as double)))
    as r(category, lo, hi, lo2, hi2)
  on l_quantity between lo and hi and l_discount between lo2 and hi2"""

PAYMENTS = f"""select visit_id, care_setting,
  case when count(*) = count(amount_total)
    then cast(sum(cast(amount_total as decimal(24, 6))) as double) end as "Amount"
  from (select distinct e.visit_id, l.order_id from encounter e
        left join {LINKS} l on e.uuid = l.external_id where e.voided = 0) o
  left join sale_order s on o.order_id = s.id group by visit_id, care_setting"""
COHORT_VISITS = """select w.patient_id, d.date_started, p.care_setting, p."Amount" as amount
  from (select distinct visit_id, patient_id from encounter where voided = 0
        and encounter_id in (select encounter_id from cohort)) w
  join visit d on w.visit_id = d.visit_id and d.voided = 0
  join payments p on w.visit_id = p.visit_id"""
ORACLE["join_patient_visits"] = sql(
    f"""select d.person_id, c.name, count(*) as n from dim d
    join cohort_visits w on d.person_id = w.patient_id
    join obs o on o.person_id = d.person_id and o.voided = 0
    join {NAMES} c on o.concept_id = c.concept_id
    where c.name in ('BMI', 'BMI Status', 'FBS', 'Hb1AC')
    and d.person_id in (select person_id from cohort)
    group by d.person_id, c.name""",
    cohort=cohort(DIABETES),
    payments=PAYMENTS,
    cohort_visits=COHORT_VISITS,
    dim=PATIENT_DIM,
)
GEO = """(select n_name as address, cast(n_nationkey * 7 - 80 as double) as lat,
  cast(n_nationkey * 13 - 160 as double) as lon from nation where n_nationkey <> 5)"""
PLACES = "(select {0} as place, count(*) as total from v where {0} is not null group by {0})"
ORACLE["join_geocodes"] = sql(
    f"""select place, total, lat, lon from {PLACES.format('district')} c
    left join {GEO} g on c.place = g.address"""
)
ORACLE["geocode_misses"] = sql(
    f"""select place, total, concat('India ', place) as lookup from {PLACES.format('district')} c
    where not exists (select 1 from {GEO} g where c.place = g.address)"""
)

# --- aggregation ---------------------------------------------------------------------


def interval_counts(factors: list[str], interval: str, source: str = "v") -> str:
    named = ", ".join(f'{factor} as "{title(factor)}"' for factor in factors)
    return f"""select {named}, {start_of(interval)} as "{interval}", count(*) as total
      from {source} group by all"""


def title(name: str) -> str:
    return name.replace("_", " ").title()


ORACLE["count_by_interval"] = sql(interval_counts(["diagnosis", "gender"], "Months"))
ORACLE["visit_payments"] = sql(PAYMENTS)
ORACLE["distinct_rows"] = ORACLE["sql_source"]


def whole(interval: str) -> str:
    return f"""cast(sum(total) over (partition by "{interval}") as bigint)"""


ORACLE["proportion_by_interval"] = sql(
    f"""select "Diagnosis", "Months", total, {percent('total', 'whole')} as percentage
    from (select *, {whole('Months')} as whole from cells)""",
    cells=interval_counts(["diagnosis"], "Months"),
)
ORACLE["crosstab_one"] = sql(
    'select gender as "Gender", count(*) as n from v where gender is not null group by gender'
)


def crosstab(first: str, second: str) -> str:
    return f"""select a.{first} as "{first.upper() if first == 'id' else title(first)}",
      b.{second} as "{title(second)}", count(v.{first}) as n
      from (select distinct {first} from v where {first} is not null) a
      cross join (select distinct {second} from v where {second} is not null) b
      left join v on v.{first} = a.{first} and v.{second} = b.{second}
      group by a.{first}, b.{second}"""


ORACLE["crosstab_two"] = sql(crosstab("id", "gender"))
ORACLE["crosstab_proportional"] = sql(
    """select "Diagnosis", "Gender", n, cast(n as double) / (select sum(n) from t) as prop
    from t""",
    t=crosstab("diagnosis", "gender"),
)


def items(
    source: str, by: str, factors: str, n: int, y: str = "total", order: str = "desc",
    strict: bool = False,
) -> str:
    """The item filter: rows ranked within n, then the first n of them in factor order."""
    if strict:
        return f"""select * exclude (k) from (select *, row_number() over (partition by {by}
          order by {y} {order}, {factors}) as k from {source}) where k <= {n}"""
    return f"""select * exclude (k, j) from (
      select *, row_number() over (partition by {by} order by {factors}) as j from (
        select *, rank() over (partition by {by} order by {y} {order}) as k from {source})
      where k <= {n}) where j <= {n}"""


FUNCS = {"sum": "sum(y)", "mean": "avg(y)", "sd": "stddev_samp(y)", "median": "median(y)"}


def summaries(y: str) -> str:
    lines = " union all ".join(
        f"""select '{name}' as func, "Quarters", "Gender", round(cast({f} as double), 6) as value
        from lines group by "Quarters", "Gender" """
        for name, f in FUNCS.items()
    )
    ranked = items("shares", '"Quarters", "Gender"', '"Diagnosis" nulls last', 3, y)
    return sql(
        lines,
        cells=interval_counts(["diagnosis", "gender"], "Quarters"),
        shares=f"""select *, {percent('total', 'whole')} as percentage
          from (select *, {whole('Quarters')} as whole from cells)""",
        lines=f"select *, {y} as y from ({ranked})",
    )


ORACLE["summary_line"] = summaries("total")
ORACLE["summary_line_percentage"] = summaries("percentage")


def boxes(keys: str) -> str:
    return f"""select {keys}, q1, median, q3,
      least(q1, min(case when y between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then y end)) as lower,
      greatest(q3, max(case when y between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then y end)) as upper
      from fenced group by {keys}, q1, median, q3"""


def fences(keys: str, quantile: str = "quantile_cont") -> str:
    on = " and ".join(f"points.{key} is not distinct from q.{key}" for key in keys.split(", "))
    return f"""select points.*, q1, median, q3 from points join (
      select {keys}, {quantile}(y, 0.25) as q1, {quantile}(y, 0.5) as median,
        {quantile}(y, 0.75) as q3 from points group by {keys}) q on {on}"""


FOUR = "round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, round(lower, 4) as lower, round(upper, 4) as upper"
EVENTS = f"""select {start_of('Months', 'ts')} as "Months", event_type, value as y from events"""
FILLED = '"Months", event_type'
ORACLE["box_stats"] = sql(
    f'select "Months", {FOUR} from boxes',
    points=f'select {start_of("Months")} as "Months", amount as y from v',
    fenced=fences('"Months"'),
    boxes=boxes('"Months"'),
)
# exact in rank as long as a group has fewer values than the sketch's accuracy
ORACLE["box_stats_approximate"] = sql(
    f'select "Months", {FOUR} from boxes',
    points=f'select {start_of("Months")} as "Months", amount as y from v',
    fenced=fences('"Months"', "quantile_disc"),
    boxes=boxes('"Months"'),
)
ORACLE["box_stats_filled"] = sql(
    f"select {FILLED}, {FOUR} from boxes", points=EVENTS, fenced=fences(FILLED), boxes=boxes(FILLED)
)
ORACLE["box_outliers"] = sql(
    f"""select {FILLED}, y as value from fenced
    where y < q1 - 1.5 * (q3 - q1) or y > q3 + 1.5 * (q3 - q1)""",
    points=EVENTS,
    fenced=fences(FILLED),
)


def histogram(keys: str = "") -> str:
    """Bins of column x of `xs`, `w` wide; a minimum on an edge goes to the bin above."""
    return f"""select bin * w as center, {keys} count(*) as n from (
      select *, greatest(ceil((x - w / 2) / w - 1e-8),
        floor(((select min(x) from xs) - w / 2) / w) + 1) as bin from xs)
      group by all"""


ORACLE["histogram_width"] = sql(
    histogram("l_returnflag,"),
    xs="select l_quantity as x, cast(10 as double) as w, l_returnflag from lineitem",
)
ORACLE["histogram_default"] = sql(
    f"select round(center, 4) as center, n from ({histogram()})",
    xs="select amount as x, (select (max(amount) - min(amount)) / 29 from v) as w from v",
)
ORACLE["count_by_place"] = sql(
    """select "State" as place, count(*) as total from dim where "State" is not null group by 1""",
    dim=PATIENT_DIM,
)
ORACLE["place_argmax"] = sql(
    f"select place, total from {PLACES.format('district')} order by total desc, place limit 1"
)
GRID_ENDS = """date_trunc('year', min(visit_date)) as lo,
  case when date_trunc('year', max(q)) = max(q) then max(q)
    else date_trunc('year', max(q)) + interval 1 year end as hi"""
TICKS = "cast(unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 3 months)) as timestamp) as tick"
ORACLE["interval_domain"] = sql(
    f"""select {TICKS} from
    (select {GRID_ENDS} from (select *, date_trunc('quarter', visit_date) as q from v))"""
)
ORACLE["scatter_points"] = """select l_quantity, l_discount, l_returnflag, count(*) as n
  from lineitem where l_quantity is not null and l_discount is not null group by all"""

# the finest of the grids of 1, 2, 4 ... 512 cells a side with at most 500 filled cells
ORACLE["scatter_thinned"] = """
  with points as (select l_extendedprice::double as x, l_quantity::double as y, l_returnflag as c from lineitem
    where l_extendedprice is not null and l_quantity is not null),
  edges as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from points),
  cells as (select least(floor((x - x0) / (x1 - x0) * 512), 511)::bigint as i,
    least(floor((y - y0) / (y1 - y0) * 512), 511)::bigint as j, c, count(*) as n from points, edges group by all),
  levels as (select unnest(range(0, 10)) as level),
  grids as (select level, i // (2 ** (9 - level))::bigint as i, j // (2 ** (9 - level))::bigint as j, c, sum(n)::bigint as n
    from cells, levels group by all),
  chosen as (select max(level) as level from (select level from grids group by level having count(*) <= 500))
  select x0 + (i + 0.5) * (x1 - x0) / (2 ** level)::double as l_extendedprice,
    y0 + (j + 0.5) * (y1 - y0) / (2 ** level)::double as l_quantity, c as l_returnflag, n
  from grids join chosen using (level), edges"""

# --- window, ranking, de-duplication -------------------------------------------------

ORACLE["latest_with_ties"] = """select o_custkey, o_orderkey, o_orderdate from (
  select *, rank() over (partition by o_custkey order by o_orderdate desc) as k from orders)
  where k = 1"""
ORACLE["latest_with_many_ties"] = sql(
    """select grp, o_orderkey, yr from (
      select *, max(yr) over (partition by grp) as newest from (
        select o_orderkey, o_orderkey % 2 * (o_custkey % 9) as grp,
          cast(date_trunc('year', o_orderdate) as timestamp) as yr from orders))
    where yr = newest"""
)
ORACLE["share_denominator"] = sql(
    f"""select *, {whole('Quarters')} as "countT" from cells""",
    cells=interval_counts(["diagnosis", "gender"], "Quarters"),
)
MONTHLY = interval_counts(["diagnosis", "gender"], "Months")
BY = '"Months", "Gender"'
FACTORS = '"Diagnosis" nulls last, "Gender" nulls last'
ORACLE["top_items"] = sql(items("cells", BY, FACTORS, 2), cells=MONTHLY)
ORACLE["top_items_strict"] = sql(items("cells", BY, FACTORS, 2, strict=True), cells=MONTHLY)
ORACLE["bottom_items"] = sql(
    items("cells", '"Quarters"', '"District" nulls last', 5, order="asc"),
    cells=interval_counts(["district"], "Quarters"),
)
ORACLE["dedup_keep_first"] = """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber
  order by l_quantity, l_extendedprice, l_partkey, l_suppkey) = 1"""

# --- set operations and reshaping ----------------------------------------------------

ORACLE["union_categories"] = ORACLE["derive_one_var"]
NUMBER_TEXT = """case when value_numeric = floor(value_numeric)
  then cast(cast(value_numeric as bigint) as varchar) else cast(value_numeric as varchar) end"""
ORACLE["unpivot_values"] = sql(
    f"""select obs_id, "Key", "Value" from (
      unpivot (select obs_id, cast(value_coded as varchar) as value_coded,
        {NUMBER_TEXT} as value_numeric, value_text from obs where voided = 0)
      on value_coded, value_numeric, value_text into name "Key" value "Value")"""
)
FIRST_VALUES = f"""select person_id, c.name,
  arg_min(struct_pack(num := value_numeric, txt := value_text), obs_id) as first
  from obs join {NAMES} c on obs.concept_id = c.concept_id
  where voided = 0 and (value_numeric is not null or value_text is not null)
  group by person_id, c.name"""
ORACLE["pivot_variables"] = sql(
    """select person_id, max(case when name = 'BMI' then first.num end) as "BMI",
      max(case when name = 'BMI Status' then first.txt end) as "BMI Status",
      max(case when name = 'FBS' then first.num end) as "FBS",
      max(case when name = 'Hb1AC' then first.num end) as "Hb1AC"
    from values_ where name in ('BMI', 'BMI Status', 'FBS', 'Hb1AC') group by person_id""",
    values_=FIRST_VALUES,
)
ORACLE["retype_columns"] = sql(
    """select obs_id, cast(value_numeric as int) as whole, cast(obs_id as double) + 0.5 as number,
      case when concept_id = 1 then true when concept_id = 20 then false end as flag,
      coalesce(value_text, cast(concept_id as varchar)) as mixed from obs where voided = 0"""
)

# --- scalar functions ----------------------------------------------------------------

ORACLE["age_years"] = sql(
    f"""select visit_id, {age('birthdate', 'cast(date_started as date)')} as age_at_visit,
      {age('birthdate')} as age
    from visit w join person p on w.patient_id = p.person_id where w.voided = 0 and p.voided = 0"""
)
ORACLE["parse_date"] = sql(
    "select person_id, case when voided = 0 then birthdate end as birthdate from person"
)
ORACLE["parse_datetime"] = sql(
    "select visit_id, case when voided = 0 then date_started end as started from visit"
)
for _key, _interval in (("bucket_year", "Years"), ("bucket_quarter", "Quarters"), ("bucket_month", "Months")):
    ORACLE[_key] = f"""select event_id, {start_of(_interval, 'ts')} as bucket from events
      union all select o_orderkey, {start_of(_interval, 'o_orderdate')} from orders"""
ORACLE["bucket_label"] = sql(
    " union all ".join(
        f"""select gender as "Gender", strftime({start_of(interval)}, '{form}') as label,
        count(*) as total from v group by all"""
        for interval, form in (("Years", "%Y"), ("Quarters", "%b-%Y"), ("Months", "%b-%Y"))
    )
)
ORACLE["ceil_year"] = """select o_orderkey, cast(case
  when date_trunc('year', o_orderdate) = o_orderdate then o_orderdate
  else date_trunc('year', o_orderdate) + interval 1 year end as timestamp) as year_end from orders"""
ORACLE["date_grid"] = sql(
    f"""select "Gender", {TICKS} from (select gender as "Gender", {GRID_ENDS}
    from (select *, visit_date as q from v) group by gender)"""
)
ORACLE["round_percent"] = sql(
    f"""select total, whole as "countT", {percent('total', 'whole')} as percentage
    from (select *, {whole('Months')} as whole from cells)""",
    cells=MONTHLY,
)
ORACLE["if_between"] = """select l_orderkey, l_linenumber,
  case when l_quantity >= 10 and l_quantity <= 20 then 'middle' end as level from lineitem"""
ORACLE["is_missing"] = sql(
    """select obs_id, value_numeric is null as no_number,
    value_numeric is not null or value_text is not null as has_value from obs where voided = 0"""
)
ORACLE["day_arith"] = """select o_orderkey, cast(o_orderdate as date) + 1 as following,
  cast(o_orderdate as date) - 365 as year_before from orders"""

# --- datasets, charts, extension points ----------------------------------------------

ORACLE["dataset_general"] = sql(
    f"""select identifier as "ID", "Gender", "Age", "District", "State",
      obs_datetime as "Visit Date", c.name as "Diagnosis"
    from (select *, max(obs_datetime) over (partition by person_id, value_coded) as last
          from dim join (select person_id, value_coded, obs_datetime from obs
            where voided = 0 and concept_id = {CODED} and {in_range('obs_datetime')}) o
          using (person_id)) d
    join {NAMES} c on d.value_coded = c.concept_id where obs_datetime = last""",
    dim=PATIENT_DIM,
)


def disease(names: str, variables: dict[str, str], values: str, everything: bool = False) -> str:
    """One patient row per identifier, and the picked value of each variable."""
    cells = ", ".join(
        f"""max(case when name = '{name}' then {field} end) as "{name}" """
        for name, field in variables.items()
    )
    listed = ", ".join(f"'{name}'" for name in variables)
    chosen = ", ".join(f'"{name}"' for name in variables)
    return sql(
        f"""select identifier as "ID", "Age", "State", "District", "Gender",
          date_started as "Visit Date", amount as "Amount", care_setting as "Care Setting", {chosen}
        from (select *, row_number() over (partition by identifier order by
                date_started nulls last, care_setting nulls last, amount nulls last,
                "District" nulls last, "State" nulls last) as k
              from dim join cohort_visits w on dim.person_id = w.patient_id) d
        join (select person_id, {cells} from ({values}) where name in ({listed})
              and (num is not null or txt is not null) group by person_id) x
          on d.person_id = x.person_id
        where k = 1 and d.person_id in (select person_id from cohort)""",
        cohort=cohort(names, everything),
        payments=PAYMENTS,
        cohort_visits=COHORT_VISITS,
        dim=PATIENT_DIM,
    )


MEASURED = f"""select o.*, c.name from obs o join {NAMES} c on o.concept_id = c.concept_id
  where o.voided = 0"""
FIRST_RECORDED = f"""select person_id, name, value_numeric as num, value_text as txt
  from ({MEASURED}) where value_numeric is not null or value_text is not null
  qualify row_number() over (partition by person_id, name order by obs_id) = 1"""
LATEST_RECORDED = f"""select person_id, name, value_numeric as num, value_text as txt
  from ({MEASURED}) qualify row_number() over (partition by person_id, name
    order by obs_datetime desc, obs_id) = 1"""
DIABETES_VARIABLES = {"BMI": "num", "BMI Status": "txt", "FBS": "num", "Hb1AC": "num"}
HYPERTENSION_VARIABLES = {"BMI": "num", "BMI Status": "txt", "Systolic": "num", "Diastolic": "num"}
ORACLE["dataset_diabetes"] = disease(DIABETES, DIABETES_VARIABLES, FIRST_RECORDED)
ORACLE["dataset_diabetes_all"] = disease(DIABETES, DIABETES_VARIABLES, FIRST_RECORDED, True)
ORACLE["dataset_hypertension"] = disease(
    "('Hypertension')", HYPERTENSION_VARIABLES, LATEST_RECORDED
)
ORACLE["user_dataset"] = sql(f"select {FLAT} from v where {in_range('visit_date')}")
ORACLE["runtime_columns"] = sql(
    """select visit_date as "Visit Date", care_setting as "Care Setting", count(*) as n
    from v group by all"""
)
ORACLE["summary_by_name"] = sql(
    " union all ".join(
        f"""select '{name}' as func, "Years", round(cast({FUNCS[name].replace('y', 'total')
            .replace('stddev_samp', 'stddev_samp')} as double), 6) as value
        from cells group by "Years" """
        for name in ("mean", "sd")
    ),
    cells=interval_counts(["district"], "Years"),
)


def measured(plot: str, source: str, measures: list[str], f1="null", f2="null", at="null") -> str:
    return " union all ".join(
        f"""select '{plot}' as title, cast({f1} as varchar) as factor1,
        cast({f2} as varchar) as factor2, cast({at} as timestamp) as bucket,
        '{m}' as measure, round(cast({m} as double), 4) as value from {source}"""
        for m in measures
    )


PRICES = "(values ('low', 0, 150000), ('middle', 100000, 300000), ('high', 300001, 450000)) as r(price, lo, hi)"
ORACLE["run_dashboard"] = sql(
    " union all ".join(
        [
            measured("Visits", "bars", ["total"], '"Diagnosis"', '"Gender"', '"Months"'),
            measured("Share of settings", "settings", ["percentage"], '"Care Setting"', at='"Quarters"'),
            measured("Price classes", "classes", ["percentage"], '"Price"', '"State"', '"Years"'),
            measured("Amounts", "amounts", ["center", "n"], f2="care_setting"),
            measured("Amount by year", "boxes", ["q1", "median", "q3", "lower", "upper"],
                     f2='"State"', at='"Years"'),
            measured("Amount by year / outliers", "outliers", ["Amount"], f2='"State"', at='"Years"'),
            measured("Districts", "districts", ["total", "lat", "lon"], "place"),
            measured("Districts / center", "center", ["total", "lat", "lon"], "place"),
            measured("Districts / to look up", "missing", ["unknown"], "place", "lookup"),
        ]
    ),
    flat=f"select * from v where {in_range('visit_date')}",
    bars=interval_counts(["diagnosis", "gender"], "Months", "flat"),
    settings=f"""select *, {percent('total', 'whole')} as percentage from (
      select *, {whole('Quarters')} as whole
      from ({interval_counts(['care_setting'], 'Quarters', 'flat')}))""",
    classes=f"""select *, {percent('total', 'whole')} as percentage from (
      select *, {whole('Years')} as whole from ({interval_counts(
        ['price', 'state'], 'Years', f'(select * from flat join {PRICES} on amount between lo and hi)')}))""",
    xs="select amount as x, (select (max(amount) - min(amount)) / 29 from flat) as w, care_setting from flat",
    amounts=histogram("care_setting,"),
    points=f'select {start_of("Years")} as "Years", state as "State", amount as y from flat',
    fenced=fences('"Years", "State"'),
    boxes=boxes('"Years", "State"'),
    outliers="""select "Years", "State", y as "Amount" from fenced
      where y < q1 - 1.5 * (q3 - q1) or y > q3 + 1.5 * (q3 - q1)""",
    districts=f"""select place, total, lat, lon from (select district as place, count(*) as total
      from flat where district is not null group by district) c left join {GEO} g on c.place = g.address""",
    center="select * from districts order by total desc, place limit 1",
    missing="""select place, 'India ' || place as lookup, 1 as unknown from districts where lat is null""",
)
ORACLE["chart_bar"] = sql(
    f"""select "Diagnosis", "State", "Quarters", percentage from
    ({items('shares', '"Quarters", "State"', '"Diagnosis" nulls last', 2, 'percentage')})""",
    cells=interval_counts(["diagnosis", "state"], "Quarters"),
    shares=f"""select *, {percent('total', 'whole')} as percentage
      from (select *, {whole('Quarters')} as whole from cells)""",
)
ORACLE["chart_line"] = sql(
    items("cells", '"Months"', '"Diagnosis" nulls last', 3, order="asc"),
    cells=interval_counts(["diagnosis"], "Months"),
)
ORACLE["chart_map"] = ORACLE["join_geocodes"]
ORACLE["chart_map_center"] = sql(
    f"""select place, total, lat, lon from {PLACES.format('state')} c
    left join {GEO} g on c.place = g.address order by total desc, place limit 1"""
)
