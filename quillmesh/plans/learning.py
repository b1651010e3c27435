"""Queries of template profiles, action scores and choices as of each decision, each with SQL of the whole rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import campuses as C
from quillmesh.operators import frontier as R
from quillmesh.operators import policies as P
from quillmesh.plans.analogs import duck_sql, run_sql
from quillmesh.plans.decisions import _if, _list, _pick
from quillmesh.plans.rulings import PAGES

Query = Callable[[SparkSession, str], DataFrame]

#: Page visits in order of time, each decided before it was made; one template has a third of them.
VISITS = f"""select event_id as id, ts, case when user_id % 3 = 0 then 'directory|t1|r0' when user_id % 31 <> 1 then 'index|t' || cast(user_id % 20 as varchar(20)) end as signature, case when user_id % 7 = 0 then '__structural__' else 'example.org' end as host_family,
    {_pick(11, *P.PRIORS, of="event_id")} as action, {_pick(5, "extract_table", "extract_script_json", "extract_repeated_block", of="(event_id + 1)")} as family, cast(floor(coalesce(value, 0) / 25) as bigint) as chapter_yield, cast(event_id % 4 as bigint) as contact_yield,
    event_type = 'error' as timeout, coalesce(value, 0) < 25 as empty, cast(round(value - 50, 4) as decimal(18, 4)) as reward,
    {_pick(4, "directory", "index", "detail", of="(event_id + 2)")} as role, {_pick(6, "static_directory", "locator_map", "article", of="(event_id + 3)")} as page_type, event_id % 9 = 0 as has_map, event_id % 8 = 0 as has_script_json,
    cast(event_id % 6 as int) as tables, cast(event_id % 7 as int) as repeated, event_id % 13 / 4e0 as keyword, event_id % 10 / 8e0 as requeue_risk, event_id % 6 = 0 as training from {{events}}"""

#: Contexts of contact jobs.
JOBS = f"""select id, case field_name when 'verify_school_match' then 'verify_school' else field_name end as field_type, id % 3 = 0 as supporting_page, {_pick(5, "chapter_site", "school_affiliation_page", "nationals_chapter_page", "other", of="(id + 1)")} as supporting_scope,
    id % 4 = 1 as website_unmet, {_pick(4, "unknown", "matched", "mismatch", of="(id + 2)")} as school_status, id % 7 < 3 as healthy, id % 7 >= 3 as degraded, cast(attempts + id % 2 as int) as queries, id % 5 <> 2 as identity, id % 6 = 5 as website, id % 8 < 3 as target,
    field_name in ('verify_school_match', 'verify_website') as authoritative, case when id % 7 < 3 then 0.15e0 else 1e0 end as timeout_risk, case when queue_state = 'deferred' then 0.8e0 else 0.2e0 end as requeue_risk, cast(id % 11 as double) / 2 as seen from field_jobs"""

#: Pages with a given profile of their template, or none.
MADE = f"""select id, {_pick(4, "directory", "index", "detail", of="(id + 2)")} as role, {_pick(6, "static_directory", "locator_map", "article", of="(id + 3)")} as page_type, id % 9 = 0 as has_map, id % 8 = 0 as has_script_json, cast(id % 6 as int) as tables, cast(id % 7 as int) as repeated, id % 13 / 4e0 as keyword,
    id % 3 <> 0 as profiled, {_pick(5, "extract_table", "expand_internal_links", "stop_branch", of="id")} as best_action, {_pick(4, "extract_table", "extract_script_json", of="(id + 1)")} as best_family, id % 17 / 4e0 as chapters_, id % 19 / 4e0 as contacts_, id % 5 / 4e0 as empty_, id % 7 / 8e0 as timeout_, id % 4 / 2e0 as timeout_risk, id % 5 / 4e0 as requeue_risk from ({PAGES}) c"""

_PAGE = ["role", "page_type", "has_map", "has_script_json", "tables", "repeated", "keyword", "requeue_risk", "training"]


def _asks(visits: DataFrame) -> DataFrame:
    return visits.select("id", "ts", "signature", "host_family", *_PAGE)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = run_sql(spark, sf_dir, VISITS)
    x = P.profiles_before(visits, _asks(visits).select("id", "ts", "signature", "host_family"))
    means = ["chapter_yield", "contact_yield", "empty_rate", "timeout_rate"]
    return x.select("id", "profile.visits", *(F.round(f"profile.{c}", 6).alias(c) for c in means), "profile.best_action", "profile.best_family")


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = run_sql(spark, sf_dir, VISITS)
    asks = P.observed_before(visits.select("ts", "id", "action", "reward"), P.profiles_before(visits, _asks(visits)), [*P.PRIORS])
    scored = P.action_scores(asks.withColumn("timeout_risk", F.coalesce("profile.timeout_rate", F.lit(0.0))))
    return P.chosen_action(scored, "id", F.col("training")).select("id", "action", "score", F.array_join("flags", ",").alias("flags"))


def made_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.struct(F.lit(1).alias("visits"), F.col("chapters_").alias("chapter_yield"), F.col("contacts_").alias("contact_yield"), F.col("empty_").alias("empty_rate"), F.col("timeout_").alias("timeout_rate"), "best_action", "best_family")
    observed = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("extract_table"), F.col("id") % 9 / 2.0, F.lit("skip_page"), F.lit(4.0))).otherwise(F.create_map(F.lit("stop_branch"), F.lit(1.0)))
    rows = run_sql(spark, sf_dir, MADE).withColumns({"profile": F.when(F.col("profiled"), given), "observed": observed})
    return P.action_scores(rows).select("id", "action", "score", "predicted")


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, f"select * from ({JOBS}) j")
    return P.enrichment_scores(rows.withColumn("observed", F.when(F.col("id") % 4 != 0, F.create_map(F.lit("search_web"), "seen", F.lit("defer"), -F.col("seen")))))


_U = "cast({0} as varchar(20))"


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for every supplier over a page for every part; links double, halve and go on by names of parts."""
    page = lambda k: f"'https://x.org/p' || {_U.format(k)}"
    pages = run_sql(spark, sf_dir, f"select {page('p_partkey')} as url, cast(p_size % 3 as bigint) as records, p_size % 7 = 0 as has_map, cast(p_size % 5 as int) as repeated from {{part}}")
    ways = [("2 * p_partkey", "'Our chapters'"), ("2 * p_partkey + 1", "p_name"), ("cast(floor(p_partkey / 3) as bigint)", "'Chapter directory'"), ("p_partkey + 7", "'News of alumni'")]
    links = run_sql(spark, sf_dir, " union all ".join(f"select {page('p_partkey')} as at, {n} as ordinal, {page(k)} as link, {a} as anchor from {{part}}" for n, (k, a) in enumerate(ways)))
    sessions = run_sql(spark, sf_dir, f"select s_suppkey as session_id, case when s_suppkey % 9 = 0 then 'https://y.org/' else 'https://www.x.org/' end as source_url, array({page('s_suppkey % 50 + 1')}, {page('s_nationkey + 3')}) as seeds from {{supplier}}")
    return R.crawl(sessions, pages, links, R.Budget(pages=6, empty=3, saturation=0, records=4))[1]


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    school = _pick(4, "State University", "University of X", "Y College", of="(id + 1)")
    rows = run_sql(spark, sf_dir, f"select id, url, title, text, {school} as school from ({PAGES}) c")
    return rows.select("id", C.greek_policy(*map(F.col, ("school", "url", "title", "text"))).alias("x")).select("id", "x.*")


QUERIES: dict[str, Query] = {
    "d19_campus_policies": policies,
    "d13_crawl_stops": crawls,
    "d08_action_scores": made_scores,
    "d08_profiles_before": profiles,
    "d09_enrichment_scores": lambda spark, sf_dir: enrichment(spark, sf_dir).select("id", "action", "score"),
    "d10_best_enrichment": lambda spark, sf_dir: P.chosen_action(enrichment(spark, sf_dir), "id", guarded=False).select("id", "action", "score"),
    "d10_learned_choices": choices,
}

# The same rules in SQL ------------------------------------------------------------------------------------------------

_RISKS = f"case when action in ('{"', '".join(P.RISKY)}') then least(greatest(timeout_risk, 0e0), 1e0) * 0.75e0 + least(greatest(requeue_risk, 0e0), 1e0) * 0.35e0 else 0e0 end"


def _values(priors: dict[str, float]) -> str:
    return f"(values {', '.join(f"('{k}', {v}e0, {n})" for n, (k, v) in enumerate(priors.items()))}) a(action, prior, place)"


def _scored(rows: str, observed: str) -> str:
    """Columns of a row and action, with pred; rows has a column profiled."""
    return f"""select *, round((base + 0.15e0 * keyword)::decimal(20, 10), 4)::double as score, round(base::decimal(20, 10), 4)::double as predicted from (select *, prior + case when action = 'extract_locator_api' and has_map then 2e0 when action = 'extract_script_json' and has_script_json then 1.7e0 when action = 'extract_table' then least(tables, 3) * 0.7e0
        when action = 'extract_repeated_block' then least(repeated, 4) * 0.5e0 when action in ('expand_internal_links', 'expand_same_section_links', 'expand_map_children') and role in ('directory', 'index') then 0.5e0 when action = 'extract_stubs_only' and page_type in ('static_directory', 'locator_map') then 0.6e0 else 0e0 end
        + case when profiled then {_if("best_action = action", 1.4)} + {_if("best_family = action", 1.2)} + least(chapters_, 3e0) * 0.2e0 + least(contacts_, 3e0) * 0.15e0 - least(empty_, 1e0) * 0.8e0 - least(timeout_, 1e0) * 0.8e0 else 0e0 end
        + 0.2e0 * {observed} - {_RISKS} as base from {rows})"""


_PROFILES = f"""v as ({VISITS}), w as (select *, count(*) over b as n, coalesce(sum(chapter_yield) over b, 0) as sc, coalesce(sum(contact_yield) over b, 0) as sk, coalesce(sum(empty::int) over b, 0) as se, coalesce(sum(timeout::int) over b, 0) as st from v window b as (partition by signature, host_family order by ts, id rows between unbounded preceding and 1 preceding)),
    l as (select *, last_value(case when (chapter_yield + contact_yield) * n >= sc + sk then {{'a': action, 'f': family}} end ignore nulls) over (partition by signature, host_family order by ts, id rows between unbounded preceding and 1 preceding) as led from w),
    p as (select *, n > 0 and signature is not null as profiled, sc / n::double as chapters_, sk / n::double as contacts_, se / n::double as empty_, st / n::double as timeout_, led.a as best_action, led.f as best_family from l)"""
_SHOWN = ", ".join(f"case when profiled then {c} end as {n}" for c, n in [("n", "visits"), *((f"round({c}, 6)", n) for c, n in (("chapters_", "chapter_yield"), ("contacts_", "contact_yield"), ("empty_", "empty_rate"), ("timeout_", "timeout_rate"))), ("best_action", "best_action"), ("best_family", "best_family")])
_SEEN = ", ".join(f"{f} filter (where action = '{a}' and reward is not null) over o as {p}{i}" for i, a in enumerate(P.PRIORS) for p, f in (("n", "count(*)"), ("s", "sum(reward)")))
_EACH = ", ".join(f"{{'action': '{a}', 'prior': {v}e0, 'place': {i}, 'mean_': case when n{i} > 0 then s{i}::double / n{i} else 0e0 end}}" for i, (a, v) in enumerate(P.PRIORS.items()))
_CHOICES = f"""with {_PROFILES}, q as (select *, case when profiled then timeout_ else 0e0 end as timeout_risk, {_SEEN} from p window o as (order by ts, id rows between unbounded preceding and 1 preceding)),
    u as (select * exclude (action, family, a), a.action as action, a.prior as prior, a.place as place, a.mean_ as mean_ from (select *, unnest([{_EACH}]) as a from q)), s as ({_scored("u", "mean_")}),
    r as (select *, row_number() over (partition by id order by score desc, place) as r, lead(score) over (partition by id order by score desc, place) as second_, action in {_list(P.RISKY)} as risky, min(place) over (partition by id) from s),
    f as (select *, [case when risky and timeout_risk >= 0.8e0 then 'high_timeout_risk' end, case when risky and requeue_risk >= 0.7e0 then 'high_requeue_risk' end, case when action = 'expand_internal_links' and second_ >= score - 0.05e0 then 'prefer_safer_near_tie' end] as marks from r where r = 1),
    g as (select id, case when training then '' else array_to_string(list_filter(marks, lambda m: m is not null), ',') end as flags from f)
    select r.id, r.action, r.score, g.flags from r join g using (id) qualify row_number() over (partition by r.id order by case when g.flags <> '' then risky::int else 0 end, r.r) = 1"""

_ENRICHED = f"""select id, action, place, round((prior + case action when 'parse_supporting_page' then case when supporting_page and coalesce(supporting_scope in ('chapter_site', 'school_affiliation_page', 'nationals_chapter_page'), false) then 2.45e0 when supporting_page then 2e0 else 0e0 end when 'verify_school' then {_if("field_type = 'verify_school' or coalesce(school_status, '') in ('unknown', '') or authoritative", 1.5)}
    when 'verify_website' then {_if("field_type in ('verify_website', 'find_website') or website", 1.35)} when 'search_web' then {_if("healthy and not supporting_page", 1.0)} when 'search_social' then {_if("healthy and field_type = 'find_instagram'", 0.95)} when 'defer' then {_if("degraded or website_unmet or not identity", 1.45)}
    when 'stop_no_signal' then {_if("queries >= 3 and not supporting_page and not healthy", 0.85)} else {_if("not identity and target", 0.7)} end + 0.2e0 * case when id % 4 <> 0 and action = 'search_web' then seen when id % 4 <> 0 and action = 'defer' then -seen else 0e0 end - {_RISKS})::decimal(20, 10), 4)::double as score from ({JOBS}) j cross join {_values(P.ENRICH_PRIORS)}"""
_GIVEN = "case when id % 3 = 0 and action = 'extract_table' then id % 9 / 2e0 when id % 3 = 0 and action = 'skip_page' then 4e0 when id % 3 <> 0 and action = 'stop_branch' then 1e0 else 0e0 end"

ORACLE_SQL: dict[str, str] = {name: duck_sql(sql) for name, sql in {
    "d08_action_scores": f"select id, action, score, predicted from ({_scored(f'(select * from ({MADE}) m cross join {_values(P.PRIORS)})', _GIVEN)})",
    "d08_profiles_before": f"with {_PROFILES} select id, {_SHOWN} from p",
    "d09_enrichment_scores": f"select id, action, score from ({_ENRICHED}) e",
    "d10_best_enrichment": f"select id, action, score from ({_ENRICHED}) e qualify row_number() over (partition by id order by score desc, place) = 1",
    "d10_learned_choices": _CHOICES,
}.items()}
