"""Relations of the crawl-and-enrichment model, derived from the star-schema test tables.

Each is portable SQL over the base tables. ``with_relations`` puts those that a query needs (and what they need) before
it as common table expressions; Catalyst prunes their columns and pushes filters to the scans.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: "Now" of every query.
NOW = "timestamp '1998-08-02 00:00:00'"

RELATIONS: dict[str, str] = {
    "fraternities": "select n_nationkey as id, lower(n_name) as slug, n_name as name, n_regionkey as region_id from {nation}",
    "sources": """select s_suppkey as id, s_nationkey as fraternity_id, s_name as slug, s_acctbal > 0 as active,
        case when s_acctbal > 5000 then 'html_directory' when s_acctbal > 0 then 'script_embedded' else 'unsupported' end as source_type,
        s_acctbal / 10000 as health from {supplier}""",
    "chapters": """select c_custkey as id, c_nationkey as fraternity_id, c_name as name,
        case when c_custkey % 11 = 0 then null else 'School ' || cast(c_custkey % 37 as varchar(20)) end as university,
        case when c_custkey % 5 = 0 then null when c_custkey % 37 % 3 = 0 then 'TX' when c_custkey % 37 % 3 = 1 then 'NY' else 'CA' end as state,
        case c_mktsegment when 'MACHINERY' then 'inactive' when 'FURNITURE' then 'unknown' else 'active' end as chapter_status,
        case when c_acctbal > 3000 then 'https://c' || cast(c_custkey as varchar(20)) || '.example.edu' end as website_url,
        case when c_custkey % 3 = 0 then 'https://www.instagram.com/c' || cast(c_custkey % 400 as varchar(20)) end as instagram_url,
        case when c_acctbal > 0 then 'c' || cast(c_custkey as varchar(20)) || '@example.edu' end as contact_email,
        case c_custkey % 4 when 0 then 'chapter_specific' when 1 then 'school_specific' when 2 then 'national_generic' end as email_specificity,
        case c_custkey % 3 when 0 then 'national_specific_to_chapter' when 1 then 'national_generic' end as instagram_specificity,
        case when c_acctbal < -500 then 'confirmed_absent' when c_acctbal > 3000 then 'found' else 'missing' end as website_state,
        c_acctbal as score from {customer}""",
    "crawl_runs": """select o_orderkey as id, cast(o_custkey % 10 + 1 as bigint) as source_id,
        case when o_orderstatus = 'F' then 'succeeded' when o_orderstatus = 'P' then 'partial' when o_orderkey % 3 = 0 then 'failed' else 'running' end as status,
        o_orderdate as started_at, cast(floor(o_totalprice / 1000) as bigint) as pages, cast(floor(o_totalprice / 400) as bigint) as records,
        o_orderpriority as session_id, case when o_orderkey % 2 = 0 then 'adaptive' else 'legacy' end as family from {orders}""",
    "field_jobs": """select o_orderkey as id, o_custkey as chapter_id, o_orderkey as crawl_run_id,
        case o_orderkey % 5 when 0 then 'verify_school_match' when 1 then 'verify_website' when 2 then 'find_website' when 3 then 'find_instagram' else 'find_email' end as field_name,
        case when o_orderkey % 13 = 0 then 'failed' when o_orderstatus = 'F' then 'done' when o_orderstatus = 'P' then 'running' else 'queued' end as status,
        case o_custkey % 7 when 0 then 'deferred' when 1 then 'blocked_provider' when 2 then 'blocked_dependency' when 3 then 'blocked_repairable' when 4 then 'blocked_invalid' when 5 then 'actionable' end as queue_state,
        case o_orderkey % 6 when 0 then 'provider_degraded' when 1 then ' ' when 2 then 'website_required' when 3 then 'queued_for_entity_repair' when 4 then 'transient_network' end as blocked_reason,
        case when o_orderstatus = 'F' then case o_orderkey % 3 when 0 then 'updated' when 1 then 'review_required' else 'terminal_no_signal' end end as terminal_outcome,
        cast(substr(o_orderpriority, 1, 1) as int) as priority, cast(o_orderkey % 4 as int) as attempts, o_orderdate as scheduled_at, o_totalprice as payload_value from {orders}""",
    "evidence": """select l_orderkey * 10 + l_linenumber as id, l_orderkey as job_id, l_partkey as chapter_id, l_suppkey as source_id,
        case l_linenumber % 4 when 0 then 'contact_email' when 1 then 'instagram_url' when 2 then 'website_url' else 'chapter_status' end as field_name,
        l_returnflag || '-' || cast(l_linenumber as varchar(20)) as field_value, l_discount as confidence, l_shipdate as created_at,
        case l_returnflag when 'A' then 'accepted' when 'R' then 'rejected' end as reason_code,
        case l_linestatus when 'F' then 'chapter_specific' else 'national_generic' end as contact_specificity, l_quantity as weight from {lineitem}""",
    "observations": """select event_id as id, user_id as session_id, ts as created_at, event_type as selected_action, value as risk_score,
        case event_type when 'error' then 'timeout' when 'view' then 'empty' else 'records' end as outcome,
        case when event_id > 1 then event_id - 1 - event_id % 7 end as parent_id, cast(event_id % 5 as int) as n_flags,
        case event_id % 3 when 0 then 'directory:static' when 1 then 'directory:map' else 'index:none' end as context_bucket,
        case event_id % 4 when 0 then 'found' when 1 then 'missing' else 'review' end as predicted,
        case event_id % 3 when 0 then 'found' when 1 then 'missing' else 'review' end as actual from {events}""",
    "rewards": """select event_id as id, user_id as session_id, event_type as action_type, value - 50 as reward_value,
        case when event_id % 4 = 0 then 'delayed' when event_id % 9 = 0 then 'terminal' else 'immediate' end as reward_stage,
        case when event_id % 4 = 0 then 0.8 else 1.0 end as discount_factor, event_id - event_id % 4 as attributed_id, ts as created_at from {events}""",
    "attempts": """select event_id as id, case user_id % 4 when 0 then 'searxng' when 1 then 'bing' when 2 then 'brave' else 'tavily' end as provider,
        event_type as endpoint, case event_type when 'error' then 'failed' when 'view' then 'empty' else 'success' end as status,
        cast(floor(value * 10) as int) as latency_ms, cast(user_id % 6 as int) as result_count, ts as created_at from {events}""",
    "workers": """select s_suppkey as id, case s_suppkey % 2 when 0 then 'contact_resolution' else 'crawl' end as lane,
        case s_suppkey % 5 when 0 then 'stopped' else 'active' end as status,
        case when s_suppkey % 3 = 0 then null when s_acctbal > 2000 then timestamp '1998-08-03 00:00:00' when s_acctbal > 0 then timestamp '1998-08-02 00:00:00' else timestamp '1998-08-01 00:00:00' end as lease_expires_at from {supplier}""",
    "alerts": """select event_id as id, case when value > 90 then 'critical' when value > 50 then 'warning' else 'info' end as severity,
        case when event_id % 3 = 0 then 'resolved' else 'open' end as status, event_type || ':' || cast(user_id as varchar(20)) as fingerprint, ts as created_at from {events}""",
    "review_items": """select conv_id * 1000 + turn as id, conv_id as chapter_id, role as reason, case turn % 3 when 0 then 'open' when 1 then 'triaged' else 'resolved' end as status,
        turn, length(text) as size from {conversations}""",
    "goldset": "select doc_id as case_id, quality as expected, case when toxic = 1 then 0 else 1 end as predicted from {labels}",
    "templates": "select p_partkey as id, p_type as signature, p_brand as host_family, p_size as visits, p_retailprice as mean_yield from {part}",
}

# What the SQL of two relations above needs is found by name.
_NAME = re.compile(r"\b(" + "|".join(RELATIONS) + r")\b")


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in dict.fromkeys(_NAME.findall(re.sub(r"'[^']*'", "''", sql))):
        if name not in seen:
            _needed(RELATIONS[name], seen)
            seen.append(name)
    return seen


def with_relations(sql: str) -> str:
    """sql with the relations it names as common table expressions; base tables stand in braces."""
    body = sql.strip()
    ctes = ",\n".join(f"{n} as ({RELATIONS[n]})" for n in _needed(sql, []))
    if not ctes:
        return body
    recursive = re.match(r"(?i)with\s+recursive\s+", body)
    if recursive:
        return f"with recursive {ctes},\n{body[recursive.end() :]}"
    inner = re.match(r"(?i)with\s+", body)
    return f"with {ctes},\n{body[inner.end() :]}" if inner else f"with {ctes}\n{body}"


def _filled(sql: str, of) -> str:
    return re.sub(r"\{(" + "|".join(BASE) + r")\}", lambda m: of(m[1]), with_relations(sql).replace("{now}", NOW))


def duck_sql(sql: str) -> str:
    return _filled(sql, lambda t: t)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df's rows over all tasks by a unique key: a narrow table is one small file, however much is made of its rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, deal: dict[str, str] | None = None) -> DataFrame:
    """deal: the unique keys of base tables that are dealt over all tasks before the rest."""
    views = {t: f"dealt_{t}_{uuid.uuid4().hex}" for t in deal or {}}
    for t, view in views.items():
        dealt(spark.read.parquet(f"{sf_dir}/{t}.parquet"), deal[t]).createOrReplaceTempView(view)
    df = spark.sql(_filled(sql, lambda t: views.get(t) or f"parquet.`{sf_dir}/{t}.parquet`"))
    for view in views.values():
        spark.catalog.dropTempView(view)
    return df


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"select * from {name}")
