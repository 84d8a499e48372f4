"""Raw feeds in the shapes of the real ones, derived from the given tables.

The texts run unchanged on Spark and on DuckDB, so both sides of a check read the same
input. They carry the dirt of the real feeds on purpose: stray spaces, empty strings,
bad keys, repeated keys, unknown codes, impossible fleets, two date formats, null flags,
carriers that one feed has and another has not.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BASE_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")

FEEDS: dict[str, str] = {}

FEEDS["fx_state"] = r"""
select k, code from (values (0,'AL'),(1,'AZ'),(2,'AR'),(3,'CA'),(4,'CO'),(5,'CT'),(6,'DE'),
 (7,'DC'),(8,'FL'),(9,'GA'),(10,'HI'),(11,'ID'),(12,'IL'),(13,'IN'),(14,'IA'),(15,'KS'),
 (16,'KY'),(17,'LA'),(18,'ME'),(19,'MD'),(20,'TX'),(21,'NY'),(22,'GU'),(23,'ON'),(24,'AB')) as v(k, code)
"""

FEEDS["fx_census"] = r"""
select c.c_custkey as src_seq,
       case when c.c_custkey % 101 = 100 then 'X' || cast(c.c_custkey as string)
            else cast(c.c_custkey + 100000 as string) end as dot_number,
       case when c.c_custkey % 97 = 0 then null
            when c.c_custkey % 7 = 0 then '  ' || c.c_name || ', LLC.  '
            else c.c_name end as legal_name,
       cast(c.c_custkey as string) || ' MAIN ST' as phy_street,
       case when c.c_custkey % 13 = 0 then '' else 'CITY ' || cast(c.c_nationkey as string) end as phy_city,
       s.code as phy_state,
       lpad(cast(c.c_custkey as string), 5, '0') as phy_zip,
       case when c.c_custkey % 5 = 0 then null else '555' || lpad(cast(c.c_custkey as string), 7, '0') end as phone,
       case c.c_mktsegment when 'BUILDING' then 'A' when 'AUTOMOBILE' then 'A'
            when 'MACHINERY' then 'B' when 'HOUSEHOLD' then 'C' else 'X' end as carrier_operation,
       c.c_mktsegment as business_org_desc,
       case when c.c_acctbal < 0 then null when c.c_custkey % 17 = 0 then 'n/a'
            else cast(cast(floor(c.c_acctbal) as bigint) * (case when c.c_custkey % 50 = 0 then 1000 else 1 end) as string)
       end as power_units,
       case when c.c_custkey % 10 = 9 then 'I' else 'A' end as status_code,
       replace(cast(date '2024-01-01' + cast(c.c_custkey % 60 as int) as string), '-', '') as add_date
from customer c left join fx_state s on c.c_nationkey = s.k
union all
select 1000000 + c.c_custkey, cast(c.c_custkey + 100000 as string), c.c_name || ' RENAMED', null, '', null, null,
       '5550000000', 'A', null, '7', 'A', '20240301'
from customer c where c.c_custkey % 20 = 0
"""

FEEDS["fx_basics"] = r"""
select cast(c_custkey + 1 as string) as src_id,
       cast(c_custkey + 100000 as string) as dot_number,
       cast(c_custkey % 5 as string) as insp_total,
       case when c_custkey % 3 = 0 then null else cast(abs(cast(c_acctbal as decimal(12,2))) * 0.137 as string) end as unsafe_driv_measure,
       case when c_custkey % 11 = 0 then 'Y' when c_custkey % 11 = 1 then null else 'N' end as unsafe_driv_ac,
       cast(abs(cast(c_acctbal as decimal(12,2))) * 0.071 as string) as hos_driv_measure,
       case when c_custkey % 6 = 0 then 'yes' else '' end as hos_driv_ac,
       case when c_custkey % 4 = 0 then '' when c_custkey % 25 = 1 then '1e25' when c_custkey % 25 = 2 then '-3000000.5'
            else '1.005' end as driv_fit_measure, 'N' as driv_fit_ac,
       case when c_custkey % 9 = 0 then '0' else null end as contr_subst_measure, 'true' as contr_subst_ac,
       case when c_custkey % 8 = 0 then 'bad' else '2.5' end as veh_maint_measure, '0' as veh_maint_ac
from customer where c_custkey % 4 < 3
"""

FEEDS["fx_inspections"] = r"""
select cast(o_orderkey as string) as src_id,
       cast(o_custkey + 100000 as string) as dot_number,
       case when o_orderkey % 29 = 0 then 'unknown'
            when o_orderkey % 2 = 0 then
              lpad(cast(extract(day from o_orderdate) as string), 2, '0') || '-' ||
              substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', cast(extract(month from o_orderdate) as int) * 3 - 2, 3) || '-' ||
              substr(cast(extract(year from o_orderdate) as string), 3, 2)
            else cast(cast(o_orderdate as date) as string) || 'T00:00:00.000' end as insp_date,
       substr(o_orderpriority, 1, 1) as insp_level_id,
       case when o_orderkey % 31 = 0 then ' ' else s.code end as report_state,
       cast(o_orderkey % 3 as string) as driver_oos_total,
       case when o_orderkey % 10 = 0 then null else cast(o_orderkey % 2 as string) end as vehicle_oos_total,
       cast(o_orderkey % 4 as string) as unsafe_viol, cast(o_orderkey % 5 as string) as fatigued_viol,
       null as dr_fitness_viol, '' as subt_alcohol_viol,
       case when o_orderkey % 6 = 0 then 'x' else '1' end as vh_maint_viol, '0' as hm_viol
from orders left join fx_state s on o_custkey % 25 = s.k
"""

FEEDS["fx_violations"] = r"""
select cast(o.o_custkey + 100000 as string) as dot_number,
       '39' || cast(l.l_partkey % 9 as string) || '.' || cast(l.l_linenumber as string) || l.l_returnflag as viol_code,
       case when l.l_partkey % 23 = 0 then '  ' else p.p_name end as section_desc,
       cast(cast(l.l_shipdate as date) as string) as insp_date,
       case l.l_returnflag when 'R' then 'Y' when 'A' then 'N' else null end as oos_indicator,
       cast(l.l_linenumber as string) as severity_weight,
       l.l_orderkey as tie_1, l.l_partkey as tie_2, l.l_suppkey as tie_3
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
left join part p on l.l_partkey = p.p_partkey
"""

FEEDS["fx_subscribers"] = r"""
select 'sub_' || cast(user_id as string) as subscription_id,
       'key-' || cast(user_id as string) as api_key,
       case user_id % 3 when 0 then 'growth' when 1 then 'standard' else 'pro' end as plan,
       case user_id % 9 when 0 then 'canceled' when 1 then 'trialing' when 2 then 'past_due' else 'active' end as status,
       3 + user_id % 15 as monthly_quota
from (select distinct user_id from events) u where user_id % 17 <> 0
"""

# The same subscribers later on: some new, cancelled, back, under another key or quota.
FEEDS["fx_subscribers_later"] = r"""
select 'sub_' || cast(user_id as string) as subscription_id,
       case when user_id % 5 = 0 then 'rotated-' else 'key-' end || cast(user_id as string) as api_key,
       case user_id % 3 when 0 then 'growth' when 1 then 'standard' else 'pro' end as plan,
       case user_id % 7 when 0 then 'canceled' when 1 then 'active'
            else case user_id % 9 when 0 then 'canceled' when 1 then 'trialing' when 2 then 'past_due' else 'active' end end as status,
       3 + user_id % 15 + user_id % 4 * 2 - 2 as monthly_quota
from (select distinct user_id from events) u where user_id % 17 <> 0 or user_id % 2 = 0
"""

FEEDS["fx_requests"] = r"""
select event_id as request_id,
       date '2024-01-01' + cast((extract(day from ts) - 1) * 3 as int) as req_date,
       case when event_type = 'error' then null else 'key-' || cast(user_id as string) end as api_key,
       case event_type when 'purchase' then '/api/v1/usage' when 'click' then '/api/v1/carriers/search'
            else '/api/v1/carriers' end as endpoint
from events
"""

FEEDS["fx_subscription_events"] = r"""
select event_id as seq,
       case event_type when 'signup' then 'subscription.created' when 'purchase' then 'subscription.updated'
            else 'transaction.completed' end as event_type,
       case when event_id % 41 = 0 then null else 'sub_' || cast(user_id % 40 as string) end as sub_id,
       case when event_id % 7 = 0 then 'canceled' when event_id % 5 = 0 then null else 'active' end as status,
       case when event_id % 3 = 0 then null else 'ctm_' || cast(user_id as string) end as customer_id,
       case event_id % 5 when 0 then 'pri_g' when 1 then 'pri_s' when 2 then 'pri_p' when 3 then 'pri_future' else null end as price_id
from events
"""

# Enrichment records under several field names: two per carrier now and then, some for
# carriers the census does not know.
FEEDS["fx_enrichment"] = r"""
select c_custkey as src_seq,
       case when c_mktsegment = 'FURNITURE' then 'unknown' when c_custkey % 19 = 0 then ''
            else cast(c_custkey + 100000 as string) end as usdot_number,
       case when c_mktsegment = 'HOUSEHOLD' then 'none' else ' ' || cast(c_custkey + 100000 as string) end as dot_number,
       case when c_custkey % 4 = 0 then cast(700000 + c_custkey as string) else null end as mc_number,
       split('MC' || cast(c_custkey as string) || ',MC0', ',') as docket_number,
       case when c_custkey % 6 = 0 then '' else null end as legal_name,
       case when c_custkey % 3 = 0 then 'DBA ' || c_mktsegment || ' ' || cast(c_custkey as string) else ' ' end as dba_name,
       cast(null as string) as phy_street,
       case when c_custkey % 20 = 0 then 'RETOWN' else '' end as phy_city,
       '' as phone,
       case when c_custkey % 8 = 0 then ' 555-' || cast(c_custkey as string) else null end as telephone,
       lower(c_name) || '@example.com' as email_address,
       case when c_acctbal < 0 then '1,' || lpad(cast(c_custkey % 1000 as string), 3, '0') else '' end as nbr_power_unit,
       cast(c_custkey % 40 as string) as driver_total,
       case c_custkey % 5 when 0 then 'AUTHORIZED' when 1 then 'NOT AUTHORIZED' else null end as authority_status,
       case c_custkey % 6 when 0 then 'Satisfactory' when 1 then 'Conditional' when 2 then 'Unsatisfactory' else null end as safety_rating,
       cast(900000000 + c_custkey as string) as dun_bradstreet_no
from customer
union all
select 2000000 + s_suppkey, cast(s_suppkey * 7 + 100000 as string), null, null, split('', ','),
       case when s_suppkey % 2 = 0 then 'Updated ' || s_name else null end, 'Second ' || s_name, null, null, null, null,
       case when s_suppkey % 3 = 0 then null else 'second@example.com' end, null, 'n/a', null, null, null
from supplier
union all
select 3000000 + s_suppkey, cast(s_suppkey + 900000 as string), null, null, split('MC9', ','),
       'Caf' || chr(233) || ' ' || s_name || ' & Sons', null, null, 'NEWTOWN', null, null, null, '3', '2', null, null, null
from supplier
"""

# Search terms of every kind: USDOT and MC numbers, plain text, wildcards, no hit at all.
FEEDS["fx_terms"] = r"""
select s_suppkey as term_id,
       case s_suppkey % 8
            when 0 then cast(s_suppkey * 3 + 100000 as string)
            when 1 then ' ' || cast(700000 + s_suppkey * 4 as string) || ' '
            when 2 then 'OMER#0000' || lpad(cast(s_suppkey as string), 4, '0')
            when 3 then lpad(cast(s_suppkey * 7 as string), 6, '0') || ', llc'
            when 4 then '#%' || lpad(cast(s_suppkey as string), 4, '0') || '_, l'
            when 5 then 'second ' || lower(s_name)
            when 6 then '_' || lpad(cast(s_suppkey as string), 5, '0')
            else 'no such carrier ' || cast(s_suppkey as string) end as term
from supplier
"""

# Slugs as visitors ask for them: current, outdated, doubled, garbage.
FEEDS["fx_slug_requests"] = r"""
select o_orderkey as request_no,
       case o_orderkey % 4
            when 0 then 'customer-' || lpad(cast(o_custkey as string), 9, '0') || '-usdot-' || cast(o_custkey + 100000 as string)
            when 1 then 'former-name-usdot-' || cast(o_custkey + 100000 as string)
            when 2 then 'x-usdot-1-usdot-' || cast(o_custkey + 100000 as string)
            else 'not-a-slug-' || cast(o_custkey as string) end as requested_slug
from orders
"""

# Names beyond Latin letters, and names with character references.
FEEDS["fx_foreign_names"] = r"""
select c_custkey as src_seq,
       case c_custkey % 8
            when 0 then 'Nguyễn Vận Tải ' || cast(c_custkey as string)
            when 1 then 'ΜΕΤΑΦΟΡΕΣ Ψυχρές Θησέας ' || cast(c_custkey as string)
            when 2 then 'Щедрый Путь Грузовые Перевозки ' || cast(c_custkey as string)
            when 3 then 'O&#39;Brien &#38; Sons ' || cast(c_custkey as string)
            when 4 then 'Caf&#233;s &#x41;BC &amp; Co ' || cast(c_custkey as string)
            when 5 then 'Ћирић Љубљана ' || c_mktsegment
            when 6 then c_mktsegment || ' &#999999; &#x; &# 日本 ' || cast(c_custkey as string)
            else 'Łódź Straße ' || c_mktsegment end as name
from customer
"""

# Ledger of load runs: a run starts, and then completes, fails or is left hanging.
FEEDS["fx_ledger"] = r"""
select event_id as seq,
       event_id - event_id % 2 as job_id,
       'feed-' || cast((event_id - event_id % 2) % 14 as string) as source,
       case when event_id % 2 = 0 or event_type = 'view' then 'running'
            when event_type = 'error' then 'failed' else 'completed' end as status,
       case when event_id % 2 = 1 and event_type <> 'view' then user_id * 10 else null end as total_records,
       case when event_id % 2 = 1 and event_type <> 'view' then user_id * 9 else null end as processed_records,
       case when event_id % 2 = 1 and event_type = 'error' then repeat(props, 300) else null end as error_message,
       case when event_id % 2 = 0 then cast(ts as timestamp) else null end as started_at,
       case when event_id % 2 = 1 and event_type <> 'view' then cast(ts as timestamp) else null end as completed_at
from events
"""

# The subscription events as they arrive: nested JSON, the price behind an empty item.
FEEDS["fx_event_bodies"] = r"""
select seq,
       '{"event_type":"' || event_type || '","data":{' ||
       case when sub_id is null then '' else '"id":"' || sub_id || '",' end ||
       case when status is null then '' else '"status":"' || status || '",' end ||
       case when customer_id is null then '' else '"customer_id":"' || customer_id || '",' end ||
       '"items":[{"price":{"id":""}}' ||
       case when price_id is null then '' else ',{"price":{"id":"' || price_id || '"}}' end ||
       ']}}' as body
from fx_subscription_events
"""


_SCHEMAS: dict[str, StructType] = {}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per process."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def feed_sql(name: str) -> str:
    """A feed's text with the feeds it builds on in front."""
    needed: list[str] = []

    def visit(feed: str) -> None:
        for other in FEEDS:
            if other != feed and other not in needed and re.search(rf"\b{other}\b", FEEDS[feed]):
                visit(other)
        needed.append(feed)

    visit(name)
    head = ", ".join(f"{n} as ({FEEDS[n].strip()})" for n in needed[:-1])
    return (f"with {head} " if head else "") + FEEDS[name].strip()


def feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw feed over the tables in `sf_dir`; nothing is read yet."""
    text = feed_sql(name)
    for table in BASE_TABLES:
        if re.search(rf"\b{table}\b", text):
            base_table(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(text)
