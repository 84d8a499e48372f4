"""Checking SQL for DuckDB: every registered query once more, written independently.

A statement is put together from named parts; parts it builds on are added in front.
"""

from __future__ import annotations

import re

from haulbook.plans.fixtures import FEEDS
from haulbook.plans.tables import AS_OF, CENSUS_LOADED, ENRICHED, MEASURED
from haulbook.schemas import BASIC_CATEGORIES, STATE_NAMES, US_STATE_CODES

PARTS: dict[str, str] = {}
CHECKS: dict[str, str] = {}

SITE = "https://directory.example"


# --- expressions ----------------------------------------------------------------------
def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean(x: str, width: int | None = None) -> str:
    cut = f"left({strip(x)}, {width})" if width else strip(x)
    return f"nullif({cut}, '')"


def integer(x: str) -> str:
    return (
        f"case when regexp_full_match({strip(x)}, '[+-]?[0-9]+') "
        f"then try_cast({strip(x)} as integer) end"
    )


def number(x: str) -> str:
    """Beyond 1e20 the largest decimal(38,18), with the number's sign."""
    s, largest = strip(x), "cast('99999999999999999999.999999999999999999' as decimal(38,18))"
    shape = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?"
    return (
        f"coalesce(try_cast({s} as decimal(38,18)), case when regexp_full_match({s}, '{shape}') "
        f"then case when try_cast({s} as double) >= 1e20 then {largest} "
        f"when try_cast({s} as double) <= -1e20 then -{largest} end end)"
    )


def day(x: str) -> str:
    s = f"left({strip(x)}, 10)"
    parts = f"split_part({s}, '-', "
    month = f"((instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', upper({parts}2))) + 2) // 3)"
    yy = f"cast({parts}3) as integer)"
    return (
        f"case when regexp_full_match({s}, '[0-9]{{1,2}}-[A-Za-z]{{3}}-[0-9]{{2}}') "
        f"then make_date(case when {yy} >= 69 then 1900 else 2000 end + {yy}, "
        f"cast({month} as bigint), cast({parts}1) as bigint)) "
        f"when regexp_full_match({s}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then try_cast({s} as date) end"
    )


def flag(x: str) -> str:
    return f"case when {x} is not null then lower({strip(x)}) in ('y', 'yes', 'true', '1') end"


def slug(name: str, dot: str) -> str:
    ascii_ = f"lower(strip_accents(replace(coalesce({name}, 'carrier'), '''', '-')))"
    digits = rf"regexp_replace({ascii_}, '([0-9]),([0-9])', '\1\2', 'g')"
    dashed = f"trim(regexp_replace({digits}, '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif(trim(left({dashed}, 200), '-'), ''), 'carrier') || '-usdot-' || {dot}"


OPERATION = (
    "case carrier_operation when 'A' then 'Interstate' when 'B' then 'Intrastate Hazmat' "
    "when 'C' then 'Intrastate Non-Hazmat' end"
)
POWER = f"case when {integer('power_units')} <= 150000 then {integer('power_units')} end"
US = ", ".join(f"'{s}'" for s in US_STATE_CODES)
DOT = "cast(usdot_number as bigint)"
FLEET = f"total_vehicles desc nulls last, {DOT}, usdot_number"
COUNTERS = (
    "unsafe_viol", "fatigued_viol", "dr_fitness_viol", "subt_alcohol_viol", "vh_maint_viol", "hm_viol",
)
VIOLATION_SUM = " + ".join(f"coalesce({integer(n)}, 0)" for n in COUNTERS)
KEYED = "regexp_full_match({}, '[0-9]{{1,20}}')".format(strip("dot_number"))

TEXT_FIELDS = (
    "mc_number", "legal_name", "dba_name", "address", "city", "state", "zip", "phone", "email",
    "operation_type", "carrier_classification", "authority_status", "safety_rating", "duns_number",
)
COUNT_FIELDS = ("total_vehicles", "total_drivers")
CENSUS_FIELDS = (
    "legal_name", "address", "city", "state", "zip", "phone", "operation_type",
    "carrier_classification", "total_vehicles",
)
COLUMNS = (
    "usdot_number", "mc_number", "legal_name", "dba_name", "address", "city", "state", "zip",
    "phone", "email", "operation_type", "carrier_classification", "total_vehicles",
    "total_drivers", "authority_status", "safety_rating", "duns_number", "slug", "is_active",
    "created_at", "updated_at", "last_scraped_at",
)
SUMMARY = (
    "usdot_number, mc_number, legal_name, dba_name, city, state, operation_type, "
    "total_vehicles, total_drivers, safety_rating, slug"
)
DETAIL = (
    SUMMARY + ", address, zip, phone, email, carrier_classification, authority_status, "
    "duns_number, is_active, cast(last_scraped_at as varchar) as last_scraped_at"
)
CARRIER_TEXT = ", ".join(
    f"cast({n} as varchar) as {n}" if n.endswith("_at") else n for n in COLUMNS
)

# --- parts: clean feeds ---------------------------------------------------------------
PARTS["w_census"] = f"""
select src_seq, {clean('dot_number', 20)} as usdot_number, {clean('legal_name', 255)} as legal_name,
       {clean('phy_street', 10000)} as address, {clean('phy_city', 100)} as city,
       {clean('phy_state', 10)} as state, {clean('phy_zip', 20)} as zip, {clean('phone', 50)} as phone,
       {OPERATION} as operation_type, {clean('business_org_desc', 100)} as carrier_classification,
       {POWER} as total_vehicles, {slug(clean('legal_name', 255), clean('dot_number', 20))} as slug,
       coalesce(status_code = 'A', false) as is_active, add_date
from fx_census where {KEYED}"""

PARTS["w_basics"] = f"""
select {strip('dot_number')} as usdot_number, {integer('insp_total')} as insp_total,
       {", ".join(f"{number(p + '_measure')} as {p}_measure, {flag(p + '_ac')} as {p}_ac" for p in BASIC_CATEGORIES)},
       src_id
from fx_basics where {KEYED}"""

PARTS["w_inspections"] = f"""
select {strip('dot_number')} as usdot_number, {day('insp_date')} as inspection_date,
       case when insp_level_id <> '' then 'Level ' || insp_level_id end as inspection_type,
       {clean('report_state', 10)} as state, {integer('driver_oos_total')} as oos_drivers,
       {integer('vehicle_oos_total')} as oos_vehicles, {VIOLATION_SUM} as violations_found, src_id
from fx_inspections where {KEYED}"""

PARTS["w_violations"] = f"""
select {strip('dot_number')} as usdot_number, {clean('viol_code', 20)} as violation_code,
       {clean('section_desc')} as violation_description, {day('insp_date')} as violation_date,
       {flag('oos_indicator')} as oos_indicator, {integer('severity_weight')} as severity_weight,
       tie_1, tie_2, tie_3
from fx_violations where {KEYED}"""

_pick = {
    "mc_number": "coalesce(nullif(mc_number, ''), nullif(docket_number[1], ''))",
    "legal_name": "legal_name", "dba_name": "dba_name", "address": "phy_street", "city": "phy_city",
    "phone": "coalesce(nullif(phone, ''), nullif(telephone, ''))", "email": "email_address",
    "authority_status": "authority_status", "safety_rating": "safety_rating",
    "duns_number": "dun_bradstreet_no",
}
_width = {
    "mc_number": 20, "address": 10000, "city": 100, "phone": 50, "authority_status": 50,
    "safety_rating": 50, "duns_number": 20,
}
_picked_dot = clean("coalesce(nullif(usdot_number, ''), nullif(dot_number, ''))", 20)
_commaless = "replace(coalesce(nullif({}, ''), null), ',', '')"
PARTS["w_enrichment"] = f"""
select {_picked_dot} as usdot_number,
       {", ".join((clean(_pick[n], _width.get(n, 255)) if n in _pick else "cast(null as varchar)") + f" as {n}" for n in TEXT_FIELDS)},
       {integer(_commaless.format('nbr_power_unit'))} as total_vehicles,
       {integer(_commaless.format('driver_total'))} as total_drivers, src_seq
from fx_enrichment where regexp_full_match({_picked_dot}, '[0-9]{{1,20}}')"""


# --- parts: merges --------------------------------------------------------------------
def folded(batch: str, fields: tuple[str, ...]) -> str:
    picks = ", ".join(f"arg_max({f}, src_seq) filter (where {f} is not null) as {f}" for f in fields)
    return (
        f"select usdot_number, first(legal_name order by src_seq) as first_name, {picks} "
        f"from {batch} group by usdot_number"
    )


def newest(rows: str) -> str:
    return (
        f"select * exclude (rn) from (select *, row_number() over (partition by usdot_number "
        f"order by src_seq desc) as rn from {rows}) where rn = 1"
    )


def inserted(rows: str, at: str) -> str:
    """A census load into an empty directory."""
    known = CENSUS_FIELDS + ("usdot_number", "slug", "is_active")
    cols = []
    for n in COLUMNS:
        if n in ("created_at", "updated_at"):
            cols.append(f"timestamp '{at}' as {n}")
        elif n in known:
            cols.append(n)
        else:
            kind = {"total_drivers": "integer", "last_scraped_at": "timestamp"}.get(n, "varchar")
            cols.append(f"cast(null as {kind}) as {n}")
    return f"select {', '.join(cols)} from ({newest(rows)})"


def upserted(old: str, batch: str, at: str, fields: tuple[str, ...]) -> str:
    """Field-wise upsert of a folded batch."""
    cols = []
    for n in COLUMNS:
        if n == "usdot_number":
            cols.append("coalesce(n.usdot_number, o.usdot_number) as usdot_number")
        elif n in fields:
            cols.append(f"coalesce(n.{n}, o.{n}) as {n}")
        elif n == "slug":
            built = slug("coalesce(n.first_name, o.legal_name)", "n.usdot_number")
            cols.append(f"case when n.usdot_number is null then o.slug else coalesce(o.slug, {built}) end as slug")
        elif n == "is_active":
            cols.append("case when o.usdot_number is null then true else o.is_active end as is_active")
        elif n == "created_at":
            cols.append(f"case when o.usdot_number is null then timestamp '{at}' else o.created_at end as created_at")
        elif n in ("updated_at", "last_scraped_at"):
            cols.append(f"case when n.usdot_number is null then o.{n} else timestamp '{at}' end as {n}")
        else:
            cols.append(f"o.{n}")
    return f"select {', '.join(cols)} from {old} o full join {batch} n on o.usdot_number = n.usdot_number"


def loaded(old: str, rows: str, at: str) -> str:
    """A census load into a directory."""
    cols = []
    for n in COLUMNS:
        if n == "usdot_number" or n in CENSUS_FIELDS:
            cols.append(f"coalesce(n.{n}, o.{n}) as {n}")
        elif n == "slug":
            cols.append("case when o.usdot_number is null then n.slug else o.slug end as slug")
        elif n == "is_active":
            cols.append("case when n.usdot_number is null then o.is_active else n.is_active end as is_active")
        elif n == "created_at":
            cols.append(f"case when o.usdot_number is null then timestamp '{at}' else o.created_at end as created_at")
        elif n == "updated_at":
            cols.append(f"case when n.usdot_number is null then o.updated_at else timestamp '{at}' end as updated_at")
        else:
            cols.append(f"o.{n}")
    return (
        f"select {', '.join(cols)} from {old} o full join ({newest(rows)}) n "
        f"on o.usdot_number = n.usdot_number"
    )


ALL_FIELDS = TEXT_FIELDS + COUNT_FIELDS
PARTS["w_active"] = "select * from w_census where is_active"
PARTS["w_first"] = inserted("w_active", CENSUS_LOADED)
PARTS["w_folded"] = folded("w_enrichment", ALL_FIELDS)
PARTS["w_carriers"] = upserted("w_first", "w_folded", ENRICHED, ALL_FIELDS)
PARTS["w_measures"] = " union all ".join(
    f"select usdot_number, insp_total, '{category}' as basic_category, {p}_measure as measure, "
    f"{p}_ac as acute from w_basics"
    for p, category in BASIC_CATEGORIES.items()
)
PARTS["w_scores"] = f"""
select usdot_number, basic_category, cast(round(measure, 2) as decimal(8,2)) as score,
       cast(null as integer) as percentile, case when acute then 'alert' else 'ok' end as alert_status,
       date '{MEASURED}' as measured_date
from w_measures
where insp_total > 0 and measure is not null and abs(round(measure, 2)) <= 999999.99
  and usdot_number in (select usdot_number from w_carriers)"""
PARTS["w_insp"] = "select * from w_inspections where usdot_number in (select usdot_number from w_carriers)"
PARTS["w_viol"] = "select * from w_violations where usdot_number in (select usdot_number from w_carriers)"
PARTS["w_totals"] = """
select c.usdot_number, coalesce(i.n, 0) as inspections_total, coalesce(v.n, 0) as violations_total
from w_carriers c
left join (select usdot_number, count(*) as n from w_insp group by 1) i using (usdot_number)
left join (select usdot_number, count(*) as n from w_viol group by 1) v using (usdot_number)"""
PARTS["w_states"] = "select * from (values " + ", ".join(
    f"({i}, '{code}', '{name}')" for i, (code, name) in enumerate(STATE_NAMES.items())
) + ") as s(ordinal, state_code, state_name)"
PARTS["w_base"] = """
select c.*, t.inspections_total, t.violations_total, s.state_code, s.state_name,
       coalesce(c.legal_name, 'USDOT ' || c.usdot_number) as name
from w_carriers c join w_totals t using (usdot_number)
left join w_states s on upper(c.state) = s.state_code"""
PARTS["w_months"] = """
select usdot_number, strftime(inspection_date, '%Y-%m') as month, count(*) as count
from w_insp where inspection_date is not null group by 1, 2"""
PARTS["w_alerts"] = "select usdot_number, bool_or(alert_status = 'alert') as any_alert from w_scores group by 1"

# --- sources and sinks ----------------------------------------------------------------
_census = (
    "dot_number, legal_name, phy_street, phy_city, phy_state, phy_zip, phone, "
    "carrier_operation, business_org_desc, power_units, status_code"
)
CHECKS["s01_census_scan"] = f"select {_census} from fx_census"
CHECKS["s02_basics_scan"] = "select * from fx_basics"
CHECKS["s03_inspections_scan"] = "select * from fx_inspections"
CHECKS["s04_violations_scan"] = (
    "select cast(null as varchar) as src_id, dot_number, viol_code, section_desc, insp_date, "
    "oos_indicator, severity_weight from fx_violations"
)
CHECKS["s05_active_scan"] = f"select {_census} from fx_census where status_code = 'A'"
CHECKS["s06_resume_scan"] = """
select src_seq, dot_number from fx_census
where try_cast(dot_number as bigint) > (
  select max(cast(usdot_number as bigint)) from w_census where add_date <= '20240102')"""
CHECKS["s07_bounded_scan"] = (
    "select src_id, dot_number from fx_basics order by cast(dot_number as bigint) limit 500"
)
CHECKS["s08_new_registrations"] = """
select src_seq, dot_number, add_date from fx_census
where add_date >= '20240224' and status_code = 'A'"""
_viol = (
    "usdot_number, violation_code, violation_description, cast(violation_date as varchar) as "
    "violation_date, oos_indicator, severity_weight, tie_1, tie_2, tie_3"
)
_insp = (
    "usdot_number, cast(inspection_date as varchar) as inspection_date, inspection_type, state, "
    "oos_drivers, oos_vehicles, violations_found, src_id"
)
CHECKS["s09_replace_snapshot"] = f"select {_viol} from w_viol"
CHECKS["s10_append_rows"] = f"select {_insp} from w_insp"
CHECKS["s11_profile_export"] = """
select t.usdot_number, c.safety_rating, cast(coalesce(s.n, 0) as integer) as scores,
       cast(least(inspections_total, 50) as integer) as inspections,
       cast(least(violations_total, 10) as integer) as violations,
       inspections_total, violations_total, cast(coalesce(m.n, 0) as integer) as months
from w_totals t join w_carriers c using (usdot_number)
left join (select usdot_number, count(*) as n from w_scores group by 1) s using (usdot_number)
left join (select usdot_number, count(*) as n from w_months group by 1) m using (usdot_number)"""
CHECKS["s12_row_counts"] = """
select 'carriers' as "table", count(*) as "rows" from w_carriers
union all select 'inspections', count(*) from w_insp
union all select 'violations', count(*) from w_viol
union all select 'safety_scores', count(*) from w_scores
union all select 'subscribers', count(*) from fx_subscribers"""

# --- scalar functions -----------------------------------------------------------------
CHECKS["c01_clean_text"] = (
    f"select src_seq, {clean('legal_name', 12)} as name, {clean('phy_city', 100)} as city from fx_census"
)
CHECKS["c02_strict_int"] = f"select src_seq, {integer('power_units')} as power_units from fx_census"
CHECKS["c03_loose_int"] = f"""
select src_seq, {integer("replace(nbr_power_unit, ',', '')")} as vehicles,
       {integer("replace(driver_total, ',', '')")} as drivers from fx_enrichment"""
CHECKS["c04_num"] = "select src_id, " + ", ".join(
    f"cast({number(p + '_measure')} as varchar) as {p}" for p in BASIC_CATEGORIES
) + " from fx_basics"
CHECKS["c05_feed_date"] = f"select src_id, cast({day('insp_date')} as varchar) as day from fx_inspections"
CHECKS["c06_flag"] = "select src_id, " + ", ".join(
    f"{flag(p + '_ac')} as {p}" for p in BASIC_CATEGORIES
) + " from fx_basics"
CHECKS["c07_valid_key"] = f"select src_seq, {KEYED} as valid from fx_census"
CHECKS["c07_rejected_keys"] = f"""
select feed, case when dot is null then 'missing key' else 'key not all digits' end as reason,
       count(*) as "rows"
from (select 'census' as feed, {clean('dot_number', 20)} as dot from fx_census
      union all select 'basics', {clean('dot_number')} from fx_basics)
where dot is null or not regexp_full_match(dot, '[0-9]{{1,20}}') group by 1, 2"""
CHECKS["c08_operation_name"] = f"select src_seq, {OPERATION} as operation_type from fx_census"
CHECKS["c09_fleet_cap"] = f"select src_seq, {POWER} as vehicles from fx_census"
CHECKS["c10_active_flag"] = "select src_seq, status_code is not distinct from 'A' as is_active from fx_census"
CHECKS["c11_slug"] = f"select src_seq, {slug(clean('legal_name', 255), 'dot_number')} as slug from fx_census"
CHECKS["c12_slug_parse"] = """
select request_no, case when contains(requested_slug, '-usdot-')
  and regexp_full_match(list_last(string_split(requested_slug, '-usdot-')), '[0-9]+')
  then list_last(string_split(requested_slug, '-usdot-')) end as dot
from fx_slug_requests"""
CHECKS["c13_first_present"] = """
select src_seq, case when coalesce(usdot_number, '') <> '' then usdot_number else nullif(dot_number, '') end as dot,
       case when coalesce(phone, '') <> '' then phone else nullif(telephone, '') end as phone,
       nullif(email_address, '') as email, cast(null as varchar) as state
from fx_enrichment"""
CHECKS["c14_first_element"] = "select src_seq, docket_number[1] as docket from fx_enrichment"
CHECKS["c15_violation_total"] = f"select src_id, {VIOLATION_SUM} as violations_found from fx_inspections"
CHECKS["c16_inspection_label"] = (
    "select src_id, case when insp_level_id <> '' then 'Level ' || insp_level_id end as label from fx_inspections"
)
CHECKS["c17_report_state"] = f"select src_id, {clean('report_state', 10)} as state from fx_inspections"
CHECKS["c18_violation_fields"] = """
select violation_code, violation_description, cast(violation_date as varchar) as violation_date,
       oos_indicator, severity_weight, tie_1 from w_violations"""
CHECKS["c19_month_key"] = f"select src_id, strftime({day('insp_date')}, '%Y-%m') as month from fx_inspections"
CHECKS["c20_alert_label"] = "select src_id, " + ", ".join(
    f"case when {flag(p + '_ac')} then 'alert' else 'ok' end as {p}" for p in BASIC_CATEGORIES
) + " from fx_basics"
CHECKS["c21_measure_2dp"] = "select src_id, " + ", ".join(
    f"cast(try_cast(round({number(p + '_measure')}, 2) as decimal(8,2)) as varchar) as {p}"
    for p in BASIC_CATEGORIES
) + " from fx_basics"
CHECKS["c22_state_argument"] = "select usdot_number, state from w_carriers where is_active and state = 'TX'"
CHECKS["c23_api_key_hash"] = "select subscription_id, sha256(api_key) as api_key_hash from fx_subscribers"
CHECKS["c24_state_name"] = """
select usdot_number, state, state_name from w_carriers
left join w_states on upper(state) = state_code"""
CHECKS["c25_xml_escape"] = """
select src_seq, replace(replace(replace(replace(replace(
  coalesce(legal_name, '<none>') || ' & "co"''s', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&quot;'), '''', '&apos;') as xml from fx_census"""
CHECKS["c26_thousands"] = f"select src_seq, format('{{:,}}', {integer('power_units')}) as vehicles from fx_census"
CHECKS["c27_display_defaults"] = """
select usdot_number, coalesce(legal_name, 'USDOT ' || usdot_number) as name,
       coalesce(safety_rating, 'Not Rated') as rating from w_carriers"""
CHECKS["c27_out_of_service_total"] = (
    "select src_id, coalesce(oos_vehicles, 0) + coalesce(oos_drivers, 0) as oos from w_insp"
)

# --- row builders ---------------------------------------------------------------------
CHECKS["p01_clean_census"] = "select * exclude (add_date) from w_census"
CHECKS["p02_clean_basics"] = "select usdot_number, insp_total, src_id, " + ", ".join(
    f"cast({p}_measure as varchar) as {p}_measure, {p}_ac" for p in BASIC_CATEGORIES
) + " from w_basics"
CHECKS["p03_clean_inspections"] = f"select {_insp} from w_inspections"
CHECKS["p04_clean_violations"] = f"select {_viol} from w_violations"
CHECKS["p05_map_incremental"] = f"""
select dot_number as usdot_number, legal_name, phy_street as address, phy_city as city,
       phy_state as state, phy_zip as zip, phone, {OPERATION} as operation_type,
       business_org_desc as carrier_classification, {POWER} as total_vehicles, src_seq from fx_census"""
CHECKS["p06_normalize_enrichment"] = "select * from w_enrichment"
CHECKS["p07_unpivot_measures"] = (
    "select usdot_number, insp_total, basic_category, cast(measure as varchar) as measure, acute from w_measures"
)
CHECKS["p08_scored_only"] = CHECKS["p07_unpivot_measures"] + " where insp_total > 0 and measure is not null"
CHECKS["p09_summary"] = f"select {SUMMARY} from w_carriers"
CHECKS["p10_detail"] = f"select {DETAIL} from w_carriers"

# --- filters, searches, lookups -------------------------------------------------------
CHECKS["f01_list_carriers"] = f"""
select {SUMMARY} from w_carriers where is_active and operation_type = 'Interstate'
and total_vehicles between 100 and 5000"""
CHECKS["f01_list_rated"] = f"""
select {SUMMARY} from w_carriers where is_active and state = 'CA' and safety_rating = 'Satisfactory'"""
CHECKS["f02_search_number"] = f"""
select {SUMMARY} from w_carriers where usdot_number = '100004' or mc_number = '100004'
union all select {SUMMARY} from w_carriers where usdot_number = '700004' or mc_number = '700004'"""
for _key, _pattern in (
    ("f03_search_name", "%#00000_1%llc%"), ("f03_search_plain", "%dba BUILD%"), ("f03_search_blank", "%%"),
    ("f05_indexed_search", "%renamed%"),
    ("f05_kept_search", "%second supplier%"),
):
    CHECKS[_key] = (
        f"select {SUMMARY} from w_carriers where legal_name ilike '{_pattern}' or dba_name ilike '{_pattern}'"
    )
CHECKS["f04_batch_search"] = """
select term_id, term, usdot_number from fx_terms join w_carriers
on case when regexp_full_match(trim(term), '[0-9]+')
   then usdot_number = trim(term) or coalesce(mc_number = trim(term), false)
   else coalesce(legal_name ilike '%' || trim(term) || '%', false)
     or coalesce(dba_name ilike '%' || trim(term) || '%', false) end"""
CHECKS["f05_gram_index"] = """
select distinct usdot_number, substr(name, cast(i as bigint), 3) as gram
from (select usdot_number, lower(n) as name, unnest(range(1, cast(length(n) - 1 as bigint))) as i
      from (select usdot_number, unnest([legal_name, dba_name]) as n from w_carriers)
      where length(n) >= 3)"""
CHECKS["f06_lookup"] = f"""
select src_id, {DETAIL} from fx_basics join w_carriers on dot_number = usdot_number"""
CHECKS["f06_lookup_misses"] = """
select dot_number as asked, src_id from fx_basics
where dot_number not in (select usdot_number from w_carriers)"""
PARTS["w_slug_hits"] = """
select r.request_no, r.requested_slug, coalesce(e.usdot_number, d.usdot_number) as usdot_number,
       coalesce(e.slug, d.slug) as slug
from fx_slug_requests r
left join w_carriers e on e.slug = r.requested_slug
left join w_carriers d on e.slug is null
     and r.requested_slug like '%-usdot-%'
     and d.usdot_number = list_last(string_split(r.requested_slug, '-usdot-'))
where coalesce(e.usdot_number, d.usdot_number) is not null"""
CHECKS["f07_lookup_slug"] = "select * from w_slug_hits"
CHECKS["f08_in_us"] = f"select usdot_number, state from w_carriers where state in ({US})"
CHECKS["f09_redirects"] = "select * from w_slug_hits where requested_slug <> slug"

# --- joins and merges -----------------------------------------------------------------
_score = (
    "usdot_number, basic_category, cast(score as varchar) as score, percentile, alert_status, "
    "cast(measured_date as varchar) as measured_date"
)
CHECKS["j01_scores"] = f"select {_score} from w_scores"
CHECKS["j01_score_rejects"] = """
select usdot_number, basic_category, cast(measure as varchar) as measure,
       'measure out of range' as reason
from w_measures where insp_total > 0 and abs(round(measure, 2)) > 999999.99"""
CHECKS["j02_inspections"] = f"select {_insp} from w_insp"
CHECKS["j03_violations"] = f"select {_viol} from w_viol"
CHECKS["j04_resolve_batch"] = f"select {_viol} from w_viol"
CHECKS["j05_replace_scores"] = f"""
select {_score} from w_scores
union all
select usdot_number, 'Unsafe Driving', '0.50', null, 'ok', '2024-01-01' from w_carriers
where usdot_number not in (select usdot_number from w_basics)"""
PARTS["w_early"] = "select * from w_census where is_active and add_date < '20240301'"
PARTS["w_early_directory"] = inserted("w_early", "2024-02-01 00:00:00")
PARTS["w_richer"] = upserted("w_early_directory", "w_folded", "2024-02-15 00:00:00", ALL_FIELDS)
PARTS["w_march"] = loaded("w_richer", "w_census", CENSUS_LOADED)
CHECKS["j06_census_upsert"] = f"select {CARRIER_TEXT} from w_march"
CHECKS["j07_field_upsert"] = f"select {CARRIER_TEXT} from w_carriers"
_raw_fields = (
    ("legal_name", "legal_name", 255), ("address", "phy_street", 10000), ("city", "phy_city", 100),
    ("state", "phy_state", 10), ("zip", "phy_zip", 20), ("phone", "phone", 50),
    ("carrier_classification", "business_org_desc", 100),
)
PARTS["w_fresh"] = f"""
select src_seq, {clean('dot_number', 20)} as usdot_number,
       {", ".join(f"{clean(raw, w)} as {n}" for n, raw, w in _raw_fields)},
       {OPERATION} as operation_type, {POWER} as total_vehicles
from fx_census where add_date >= '20240224' and status_code = 'A' and {KEYED}"""
PARTS["w_fresh_folded"] = folded("w_fresh", CENSUS_FIELDS)
PARTS["w_after_fresh"] = upserted("w_first", "w_fresh_folded", ENRICHED, CENSUS_FIELDS)
CHECKS["j07_incremental"] = f"select {CARRIER_TEXT} from w_after_fresh"
CHECKS["j08_fold_batch"] = "select * exclude (first_name) from w_folded"
CHECKS["j09_newest_per_key"] = f"select * exclude (add_date) from ({newest('w_census')})"
PARTS["w_inactive"] = "select * from w_census where not is_active"
PARTS["w_after_inactive"] = loaded("w_first", "w_inactive", ENRICHED)
CHECKS["j10_absent_unchanged"] = """
select usdot_number, legal_name, is_active, cast(updated_at as varchar) as updated_at from w_after_inactive"""
CHECKS["j11_with_scores"] = """
select c.usdot_number, coalesce(string_agg(basic_category || ':' || score || ':' || alert_status, '|'
       order by basic_category || ':' || score || ':' || alert_status), '') as scores
from w_carriers c left join w_scores s on c.usdot_number = s.usdot_number group by 1"""
_plan = "case price_id when 'pri_s' then 'standard' when 'pri_p' then 'pro' else 'growth' end"
CHECKS["j12_price_plan"] = f"select seq, price_id, {_plan} as plan from fx_subscription_events"
CHECKS["j12_first_price"] = f"""
select seq, event_type, sub_id, status, customer_id, price_id, {_plan} as plan from fx_subscription_events"""
CHECKS["j13_request_subscriber"] = """
select r.request_id, s.subscription_id, s.status as subscription_status
from fx_requests r left join fx_subscribers s on r.api_key = s.api_key"""

# --- aggregations ---------------------------------------------------------------------
PARTS["w_stats"] = f"""
select (select count(*) from w_carriers where is_active) as total_carriers,
       (select count(*) from w_insp) as total_inspections,
       (select count(*) from w_viol) as total_violations,
       (select count(*) from w_scores) as total_safety_scores,
       (select count(distinct usdot_number) from w_scores) as scored_carriers,
       (select count(distinct usdot_number) from w_scores where alert_status = 'alert') as carriers_with_alerts,
       (select count(distinct state) from w_carriers where state in ({US})) as states"""
PARTS["w_by_state"] = f"""
select state, count(*) as count from w_carriers where is_active and state in ({US}) group by state"""
PARTS["w_by_month"] = """
select strftime(inspection_date, '%Y-%m') as month, count(*) as count from w_insp
where inspection_date is not null group by 1"""
PARTS["w_latest_month"] = """
select month as inspections_month, count as inspections_last_month
from (select * from w_by_month order by month desc limit 2) order by count desc, month desc limit 1"""
PARTS["w_new_week"] = """
select count(dot_number) as new_carriers_this_week from fx_census
where add_date >= '20240227' and status_code = 'A'"""
PARTS["w_share"] = """
select alert_pct, case when alert_pct = 0 then '<1' else cast(alert_pct as varchar) end as alert_text,
       100 - alert_pct as no_alert_pct
from (select case when scored_carriers > 0 then
        cast(floor(100.0 * carriers_with_alerts / scored_carriers + 0.5) as bigint) end as alert_pct from w_stats)"""
CHECKS["a01_directory_stats"] = "select * from w_stats"
CHECKS["a02_carriers_by_state"] = "select * from w_by_state"
CHECKS["a03_inspections_by_month"] = "select * from w_by_month"
CHECKS["a04_latest_month"] = "select * from w_latest_month"
CHECKS["a05_new_this_week"] = "select * from w_new_week"
CHECKS["a06_carrier_totals"] = "select * from w_totals"
CHECKS["a07_monthly_series"] = "select * from w_months"
CHECKS["a08_any_alert"] = "select * from w_alerts"
CHECKS["a09_violation_rate"] = """
select usdot_number, case when inspections_total > 0
  then cast(violations_total as double) / cast(inspections_total as double) else 0.0 end as rate from w_totals"""
CHECKS["a10_alert_share"] = "select * from w_share"
CHECKS["a11_key_bounds"] = f"select min({DOT}) as min_dot, max({DOT}) as max_dot from w_census"
CHECKS["a12_band_report"] = f"""
select cast(floor(({DOT} - (select min({DOT}) from w_census)) / 300) as bigint) as band,
       count(*) as "rows", min({DOT}) as min_dot, max({DOT}) as max_dot from w_census group by 1"""
CHECKS["a13_ingest_account"] = """
select (select count(*) from fx_census where add_date >= '20240224' and status_code = 'A') as total_records,
       (select count(*) from w_fresh) as processed_records"""
CHECKS["a14_trend_points"] = """
select usdot_number, cast(row_number() over (partition by usdot_number order by month) - 1 as integer) as position,
       cast(count as double) / greatest(max(count) over (partition by usdot_number), 1) as point,
       min(month) over (partition by usdot_number) as first_month,
       max(month) over (partition by usdot_number) as last_month
from w_months qualify count(*) over (partition by usdot_number) >= 2"""

# --- orders, pages, top lists ---------------------------------------------------------
CHECKS["k01_fleet_order"] = f"""
select row_number() over (order by {FLEET}) as rank, usdot_number, total_vehicles from w_carriers"""
CHECKS["k02_page"] = f"""
select cast(row_number() over (order by {FLEET}) - 1 as integer) as position, {SUMMARY},
       n as total, 2 as page, 5 as per_page, greatest(1, cast(ceil(n / 5) as bigint)) as pages
from (select *, count(*) over () as n from w_carriers where is_active and state = 'TX'
      order by {FLEET} limit 5 offset 5)"""
CHECKS["k02_page_past_end"] = """
select 0 as items, count(*) as total, 5000 as page, 100 as per_page,
       greatest(1, cast(ceil(count(*) / 100) as bigint)) as pages from w_carriers where is_active"""
CHECKS["k03_top_fleets"] = f"""
select {SUMMARY} from w_carriers where is_active and slug is not null order by {FLEET} limit 100"""
PARTS["w_slug_rank"] = f"""
select row_number() over (order by {DOT}, usdot_number) - 1 as i, slug
from w_carriers where is_active and slug is not null"""
CHECKS["k04_slug_pages"] = "select i // 100 as page, i % 100 as position, slug from w_slug_rank"
PARTS["w_top_insp"] = """
select *, row_number() over (partition by usdot_number order by inspection_date desc nulls last, src_id) as rn
from w_insp qualify rn <= 50"""
PARTS["w_top_viol"] = """
select *, row_number() over (partition by usdot_number order by violation_date desc nulls last,
       violation_code nulls last, tie_1, tie_2, tie_3) as rn
from w_viol qualify rn <= 10"""
CHECKS["k05_latest_inspections"] = """
select usdot_number, cast(rn as integer) as rn, src_id, cast(inspection_date as varchar) as inspection_date,
       inspection_type, violations_found from w_top_insp"""
CHECKS["k06_latest_violations"] = """
select usdot_number, cast(rn as integer) as rn, violation_code, cast(violation_date as varchar) as violation_date,
       tie_1, tie_2, tie_3 from w_top_viol"""
PARTS["w_top_states"] = """
select state, state_name, count from w_by_state join w_states on state = state_code
order by count desc, state limit 10"""
CHECKS["k07_top_states"] = "select * from w_top_states"
PARTS["w_positions"] = f"""
select state, state_name, (position - 1) // 25 + 1 as page, position,
       (position - 1) % 25 < 10 as listed, usdot_number, name, slug
from (select *, row_number() over (partition by state order by {FLEET}) as position
      from w_base where is_active and state = state_code)"""
CHECKS["k08_state_positions"] = "select * from w_positions"
PARTS["w_runs"] = """
select job_id, arg_max(source, seq) as source, arg_max(status, seq) as status,
       cast(null as bigint) as usdot_range_start, cast(null as bigint) as usdot_range_end,
       max(total_records) as total_records, max(processed_records) as processed_records,
       max(left(error_message, 2000)) as error_message, max(started_at) as started_at,
       max(completed_at) as completed_at
from fx_ledger group by job_id"""
PARTS["w_last_success"] = """
select source, max(job_id) as job_id, arg_max(completed_at, job_id) as completed_at
from w_runs where status = 'completed' group by source"""
CHECKS["k09_last_success"] = (
    "select source, job_id, cast(completed_at as varchar) as completed_at from w_last_success"
)
CHECKS["u01_union_of_counts"] = CHECKS["s12_row_counts"]
CHECKS["u02_batch_keys"] = "select distinct usdot_number from w_violations"

# --- documents ------------------------------------------------------------------------
CHECKS["d01_profile_parts"] = """
select usdot_number, 'totals' as part, cast(0 as integer) as position,
       coalesce(safety_rating, '-') || ';' || inspections_total || ';' || violations_total as entry from w_base
union all
select usdot_number, 'safety_scores',
       cast(row_number() over (partition by usdot_number order by basic_category) - 1 as integer),
       basic_category || ';' || score || ';' || alert_status from w_scores
union all
select usdot_number, 'inspections', cast(rn - 1 as integer),
       coalesce(cast(inspection_date as varchar), '-') || ';' || coalesce(inspection_type, '-') || ';' ||
       violations_found || ';' || coalesce(state, '-') from w_top_insp
union all
select usdot_number, 'violations', cast(rn - 1 as integer),
       coalesce(cast(violation_date as varchar), '-') || ';' || coalesce(violation_code, '-') || ';' ||
       coalesce(cast(severity_weight as varchar), '-') from w_top_viol
union all
select usdot_number, 'inspections_monthly',
       cast(row_number() over (partition by usdot_number order by month) - 1 as integer),
       month || ';' || count from w_months"""
PARTS["w_answers"] = """
select *, 'USDOT ' || usdot_number || ' is the FMCSA registration number for ' || name
  || case when city is not null and state is not null
     then ', a motor carrier based in ' || city || ', ' || state else '' end || '.'
  || case when total_vehicles <> 0
     then ' The company operates ' || format('{:,}', total_vehicles) || ' vehicles'
       || case when total_drivers <> 0 then ' with ' || format('{:,}', total_drivers) || ' drivers.' else '.' end
     else '' end
  || case when inspections_total > 0
     then ' It has ' || format('{:,}', inspections_total) || ' roadside inspections and '
       || format('{:,}', violations_total) || ' violations on record in the last 24 months.'
     else '' end as answer
from w_base"""
PARTS["w_faqs"] = """
select usdot_number, 1 as n, 'What is USDOT ' || usdot_number || '?' as q, answer as a from w_answers
union all
select usdot_number, 2, 'How many violations does ' || name || ' have?',
       name || ' has ' || format('{:,}', violations_total) || ' recorded violations in the last 24 months across '
       || format('{:,}', inspections_total) || ' roadside inspections, according to public FMCSA data.'
from w_answers where violations_total > 0
union all
select usdot_number, 3, 'Is ' || name || ' authorized to operate?',
       case when authority_status is not null
            then name || '''s registration status is ' || authority_status || ' according to FMCSA records.'
            else name || ' is registered with the FMCSA under USDOT ' || usdot_number ||
                 '. Check the FMCSA SAFER system for current operating authority.' end
from w_answers"""
CHECKS["d02_answers"] = "select usdot_number, answer from w_answers"
CHECKS["d03_faqs"] = "select usdot_number, q, a from w_faqs"


def member(name: str, value: str, first: bool = False) -> str:
    """A JSON member as text, left out when null."""
    comma = "" if first else ","
    return f"coalesce('{comma}\"{name}\":' || to_json({value}), '')"


_address = " || ".join(
    [
        "'{\"@type\":\"PostalAddress\"'",
        member("streetAddress", "address"), member("addressLocality", "city"),
        member("addressRegion", "state"), member("postalCode", "zip"),
        "',\"addressCountry\":\"US\"}'",
    ]
)
CHECKS["d04_organization_json"] = f"""
select usdot_number, '{{"@context":"https://schema.org","@type":"Organization"'
  || {member('name', 'name')} || {member('alternateName', 'dba_name')}
  || {member('identifier', "'USDOT ' || usdot_number")} || {member('url', f"'{SITE}/carrier/' || slug")}
  || {member('telephone', 'phone')}
  || case when address is not null or city is not null then ',"address":' || {_address} else '' end
  || '}}' as document
from w_base"""
CHECKS["d05_breadcrumb_json"] = f"""
select usdot_number, '{{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":['
  || '{{"@type":"ListItem","position":1,"name":"Home","item":"{SITE}"}}'
  || case when state_code is not null then ',{{"@type":"ListItem","position":2,"name":"' || state_name
       || '","item":"{SITE}/state/' || lower(state_code) || '"}}' else '' end
  || ',{{"@type":"ListItem","position":' || case when state_code is not null then '3' else '2' end
  || ',"name":' || to_json(name) || ',"item":"{SITE}/carrier/' || slug || '"}}' || ']}}' as document
from w_base"""
CHECKS["d06_faq_json"] = """
select usdot_number, '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[' ||
  string_agg('{"@type":"Question","name":' || to_json(q) || ',"acceptedAnswer":{"@type":"Answer","text":'
             || to_json(a) || '}}', ',' order by n) || ']}' as document
from w_faqs group by usdot_number"""
CHECKS["d07_page_metadata"] = """
select usdot_number, name || ' (USDOT ' || usdot_number || ') | Safety Record' as title,
       'View safety data, inspections and violations for ' || name || '. USDOT ' || usdot_number
       || coalesce(', based in ' || state, '') || '.' as description,
       '/carrier/' || slug as canonical
from w_base"""
CHECKS["d08_coverage"] = """
select usdot_number, city || ', ' || coalesce(state_name, state, '') as headquarters,
       case when operation_type = 'Interstate' then 'Interstate (operates across state lines)'
            when operation_type is not null
            then coalesce(state_name, state, 'Home state') || ' only (' || operation_type || ')' end as coverage
from w_base"""
CHECKS["d09_offers"] = """
select usdot_number,
       case when coalesce(any_alert, false)
              or (inspections_total > 0 and violations_total >= 2 * inspections_total) then 'compliance,insurance'
            when total_vehicles <= 10 then 'factoring,insurance' else 'insurance,compliance' end as offers
from w_base left join w_alerts using (usdot_number)"""
CHECKS["d10_state_item_lists"] = f"""
select s.state_code as state, coalesce(p.page, 1) as page,
       '{{"@context":"https://schema.org","@type":"ItemList","name":"Trucking companies in ' || s.state_name
       || '","numberOfItems":' || coalesce(t.total, 0) || ',"itemListElement":[' || coalesce(p.items, '')
       || ']}}' as document
from w_states s
left join (select state, count(*) as total from w_positions group by 1) t on t.state = s.state_code
left join (select state, page, string_agg('{{"@type":"ListItem","position":' || position || ',"name":'
             || to_json(name) || ',"url":"{SITE}/carrier/' || slug || '"}}', ',' order by position) as items
           from w_positions where listed group by 1, 2) p on p.state = s.state_code"""
PARTS["w_urls"] = f"""
select cast(0 as bigint) as file, cast(position as bigint) as position, '{SITE}' || path as url
from (values (0, ''), (1, '/search'), (2, '/api-access'), (3, '/blog'), (4, '/terms'), (5, '/privacy'),
             (6, '/refunds')) as v(position, path)
union all select 0, 7 + ordinal, '{SITE}/state/' || lower(state_code) from w_states
union all select i // 400 + 1, i % 400, '{SITE}/carrier/' || slug from w_slug_rank"""
CHECKS["d11_sitemap_urls"] = "select * from w_urls"
CHECKS["d11_sitemap_files"] = """
select file, '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
  || string_agg('<url><loc>' || url || '</loc></url>', '' order by position) || '</urlset>' as xml
from w_urls group by file"""
PARTS["w_index"] = f"""
select file, '{SITE}/sitemaps/' || file as url
from (select unnest(range(0, 2 + greatest(0, cast(ceil(count(*) / 400) as bigint) - 1))) as file
      from w_carriers where is_active)"""
CHECKS["d12_sitemap_index"] = "select * from w_index"
CHECKS["d12_sitemap_index_xml"] = """
select '<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
  || string_agg('<sitemap><loc>' || url || '</loc></sitemap>', '' order by file) || '</sitemapindex>' as xml
from w_index"""
CHECKS["d13_fleet_sanity"] = """
select usdot_number, case when total_vehicles > 1000 and inspections_total = 0 then null
       when total_vehicles > 5000 and inspections_total < ceil(total_vehicles / 100) then null
       else total_vehicles end as total_vehicles
from w_base"""
CHECKS["d14_home_summary"] = """
select w_stats.*, w_share.*, w_latest_month.*, w_new_week.*,
       (select string_agg(state || ':' || count, ',' order by count desc, state) from w_top_states) as top_states
from w_stats, w_share, w_latest_month, w_new_week"""

# --- subscriptions, metering, ledger --------------------------------------------------
PARTS["w_sub_events"] = f"""
select sub_id as subscription_id, seq, coalesce(status, 'active') as status, customer_id, {_plan} as plan
from fx_subscription_events
where event_type like 'subscription.%' and sub_id is not null"""
PARTS["w_sub_fold"] = """
select subscription_id, arg_max(status, seq) as status, arg_max(plan, seq) as plan,
       arg_max(customer_id, seq) filter (where customer_id is not null) as customer_id
from w_sub_events group by 1"""
# A subscription that is new, or ever leaves the plan it had, takes the quota of its last plan.
CHECKS["b01_subscription_fold"] = """
select coalesce(f.subscription_id, s.subscription_id) as subscription_id, f.customer_id,
       coalesce(f.plan, s.plan) as plan, coalesce(f.status, s.status) as status,
       cast(case when f.subscription_id is null then s.monthly_quota
            when s.subscription_id is not null and not exists (
                 select 1 from w_sub_events e where e.subscription_id = s.subscription_id and e.plan <> s.plan)
            then s.monthly_quota
            else case f.plan when 'standard' then 150000 when 'pro' then 300000 else 50000 end
            end as integer) as monthly_quota
from fx_subscribers s full join w_sub_fold f on s.subscription_id = f.subscription_id"""
PARTS["w_access"] = """
select r.*, s.subscription_id, s.monthly_quota,
       case when s.subscription_id is null then 401
            when s.status not in ('active', 'trialing') then 403 else 200 end as access
from fx_requests r left join fx_subscribers s on r.api_key = s.api_key"""
CHECKS["b02_access"] = "select request_id, access from w_access"
CHECKS["b02_bearer_access"] = "select request_id, case when request_id % 13 = 0 then 401 else access end as access from w_access"
PARTS["w_billed"] = "select * from w_access where access = 200 and endpoint <> '/api/v1/usage'"
PARTS["w_days"] = "select distinct subscription_id, req_date from w_billed"
PARTS["w_next"] = """
select d.subscription_id, d.req_date, min(e.req_date) as next_start
from w_days d left join w_days e on e.subscription_id = d.subscription_id and e.req_date >= d.req_date + 30
group by 1, 2"""
PARTS["w_starts"] = """
select subscription_id, min(req_date) as period_start from w_days group by 1
union all
select n.subscription_id, n.next_start from w_starts s
join w_next n on n.subscription_id = s.subscription_id and n.req_date = s.period_start
where n.next_start is not null"""
PARTS["w_metered"] = """
select *, row_number() over (partition by subscription_id, period_start order by req_date, request_id) as nth
from (select b.*, (select max(s.period_start) from w_starts s
                   where s.subscription_id = b.subscription_id and s.period_start <= b.req_date) as period_start
      from w_billed b)"""
_outcomes = """
select a.request_id, cast(a.req_date as varchar) as req_date, a.subscription_id, a.endpoint,
       case when a.access <> 200 then a.access when m.request_id is null or m.nth <= m.monthly_quota then 200
            else 429 end as outcome,
       cast(m.period_start as varchar) as period_start
from w_access a left join w_metered m on a.request_id = m.request_id"""
CHECKS["b03_metered_requests"] = _outcomes
CHECKS["b04_usage_report"] = """
select s.subscription_id, s.plan, s.status, cast(s.monthly_quota as integer) as monthly_quota,
       least(coalesce(u.n, 0), s.monthly_quota) as usage_count,
       greatest(s.monthly_quota - least(coalesce(u.n, 0), s.monthly_quota), 0) as remaining,
       cast(u.period_start as varchar) as period_start
from fx_subscribers s
left join (select subscription_id, period_start, count(*) as n from w_metered group by 1, 2
           qualify row_number() over (partition by subscription_id order by period_start desc) = 1) u
using (subscription_id)"""
CHECKS["b05_ledger_state"] = """
select job_id, source, status, usdot_range_start, usdot_range_end, total_records, processed_records,
       error_message, cast(started_at as varchar) as started_at, cast(completed_at as varchar) as completed_at
from w_runs"""
CHECKS["b06_due_sources"] = """
select l.source, cast(s.completed_at as varchar) as last_completed_at,
       coalesce(timestamp '2024-01-31 12:00:00' - s.completed_at >= interval 24 hour, true) as due
from (select distinct source from fx_ledger) l left join w_last_success s using (source)"""

# --- streams: each equals its batch twin ----------------------------------------------
CHECKS["t01_incremental_stream"] = CHECKS["j07_incremental"]
CHECKS["t02_direct_violations_stream"] = CHECKS["j03_violations"]
CHECKS["t03_once_per_row_stream"] = CHECKS["p03_clean_inspections"]
CHECKS["t04_metering_stream"] = CHECKS["b03_metered_requests"]
PARTS["w_middle"] = "select (min(request_id) + max(request_id)) // 2 as middle from fx_requests"
PARTS["w_late_access"] = """
select r.*, r.request_id > middle as late,
       case when r.request_id > middle then l.subscription_id else s.subscription_id end as subscription_id,
       case when r.request_id > middle then l.monthly_quota else s.monthly_quota end as monthly_quota,
       case when r.request_id > middle
            then case when l.subscription_id is null then 401 when l.status not in ('active', 'trialing') then 403 else 200 end
            else case when s.subscription_id is null then 401 when s.status not in ('active', 'trialing') then 403 else 200 end
            end as access
from fx_requests r cross join w_middle left join fx_subscribers s on r.api_key = s.api_key
left join fx_subscribers_later l on r.api_key = l.api_key"""
PARTS["w_late_billed"] = "select * from w_late_access where access = 200 and endpoint <> '/api/v1/usage'"
PARTS["w_late_days"] = "select distinct subscription_id, req_date from w_late_billed"
PARTS["w_late_next"] = PARTS["w_next"].replace("w_days", "w_late_days")
PARTS["w_late_starts"] = (
    PARTS["w_starts"].replace("w_days", "w_late_days").replace("w_starts", "w_late_starts").replace("w_next", "w_late_next")
)
PARTS["w_late_periods"] = """
select b.*, (select max(s.period_start) from w_late_starts s
             where s.subscription_id = b.subscription_id and s.period_start <= b.req_date) as period_start
from w_late_billed b"""
# Denied requests do not count: before the change a period used its quota at most.
PARTS["w_late_metered"] = """
select p.*, row_number() over (partition by subscription_id, period_start, late order by req_date, request_id)
       + case when late then coalesce(u.used, 0) else 0 end as nth
from w_late_periods p
left join (select subscription_id, period_start, least(count(*), max(monthly_quota)) as used
           from w_late_periods where not late group by 1, 2) u using (subscription_id, period_start)"""
CHECKS["t04_changing_subscribers_stream"] = _outcomes.replace("w_access", "w_late_access").replace("w_metered", "w_late_metered")
CHECKS["t05_subscription_stream"] = CHECKS["b01_subscription_fold"]
CHECKS["t06_monthly_counts_stream"] = CHECKS["a03_inspections_by_month"]

# What the names of the feed become, written out.
CHECKS["c11_transliterated"] = """
select src_seq, case src_seq % 8
         when 0 then 'nguyen-van-tai-' || src_seq
         when 1 then 'metaphores-psukhres-theseas-' || src_seq
         when 2 then 'shchedryi-put-gruzovye-perevozki-' || src_seq
         when 3 then 'obrien-sons-' || src_seq
         when 4 then 'cafe-s-abc-co-' || src_seq
         when 5 then 'tshiritsh-ljubljana-' || lower(trim(replace(name, 'Ћирић Љубљана', '')))
         when 6 then lower(split_part(name, ' ', 1)) || '-x-' || src_seq
         else 'lodz-strasse-' || lower(trim(replace(name, 'Łódź Straße', ''))) end as slug
from fx_foreign_names"""

# The same answers, kept by changes or read from pages.
for _name, _plain in (
    ("s01_census_pages", "s01_census_scan"), ("s02_basics_pages", "s02_basics_scan"),
    ("s03_inspections_pages", "s03_inspections_scan"), ("s04_violations_pages", "s04_violations_scan"),
    ("s06_resume_by_id", "s03_inspections_scan"), ("a13_observed_account", "a13_ingest_account"),
    ("s10_merged_folders", "s10_append_rows"), ("f05_kept_index", "f05_gram_index"), ("f04_kept_batch_search", "f04_batch_search"),
    ("j06_delta_upsert", "j06_census_upsert"), ("j07_delta_upsert", "j07_field_upsert"),
    ("a01_kept_stats", "a01_directory_stats"), ("a02_kept_by_state", "a02_carriers_by_state"),
    ("a03_kept_by_month", "a03_inspections_by_month"), ("d14_kept_home", "d14_home_summary"),
):
    CHECKS[_name] = CHECKS[_plain]


def statement(body: str) -> str:
    """A body with all parts it needs, in order."""
    parts = {**FEEDS, **PARTS}
    names = re.compile(r"\b(?:fx|w)_[a-z_]+\b")
    ordered: list[str] = []

    def visit(text: str, of: str | None) -> None:
        for name in dict.fromkeys(names.findall(text)):
            if name != of and name in parts and name not in ordered:
                visit(parts[name], name)
                ordered.append(name)

    visit(body, None)
    head = ",\n".join(f"{n} as ({parts[n].strip()})" for n in ordered)
    return f"with recursive {head}\n{body.strip()}" if head else body.strip()


def oracle_sql() -> dict[str, str]:
    return {name: statement(body) for name, body in CHECKS.items()}
