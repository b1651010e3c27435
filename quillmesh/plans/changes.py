"""Queries of merges, job outcomes, record sources and page readers over rows and pages made from the test tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.operators import mutations as M
from quillmesh.operators import scoring as D
from quillmesh.plans.analogs import NOW, duck_sql, relation, run_sql
from quillmesh.plans.decisions import _list, _path, _pick
from quillmesh.plans.rulings import _PROFILE, PAGES, _profile
from quillmesh.sources import html as H
from quillmesh.sources import records as R

Query = Callable[[SparkSession, str], DataFrame]


def _sql(rows: str, make: Callable[[DataFrame], DataFrame], deal: dict[str, str] | None = None) -> Query:
    return lambda spark, sf_dir: make(run_sql(spark, sf_dir, rows, deal))


def _two(old: str, new: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(run_sql(spark, sf_dir, old), run_sql(spark, sf_dir, new))


# Merges: rows of the table and those that come in.
_CHAPTERS = "select id, name, state, website_url, contact_email from chapters"
_FOUND = "select chapter_id * 2 as id, max(field_value) as name, max(case when confidence > 0.05 then 'https://' || field_value || '.org' end) as website_url, max(case when reason_code = 'accepted' then field_value || '@x.org' end) as contact_email from evidence group by 1"
_FRONTIER = "select session_id % 20 as crawl_session_id, 'https://x.org/' || cast(id % 60 as varchar(9)) as canonical_url, max(risk_score) as score_total, max(context_bucket) as score_components, max(case when id % 3 = 0 then outcome end) as anchor_text from observations group by 1, 2"
_LINKS = "select session_id % 25 as crawl_session_id, 'https://x.org/' || cast(id % 80 as varchar(9)) as canonical_url, max(reward_value + 50) as score_total, max(reward_stage) as score_components, max(action_type) as anchor_text from rewards where id % 7 = 0 group by 1, 2"
_PROFILES = "select id, slug, source_type, cast(health as double) as health from sources"
_SEEN = "select source_id * 2 as id, max(case when confidence > 0.09 then field_name end) as source_type, max(cast(confidence as double) * 8) as health from evidence group by 1"
_QUEUE = "select chapter_id, field_name, max(priority) as priority, max(blocked_reason) as blocked_reason from field_jobs group by 1, 2"
_AGAIN = "select id as chapter_id, 'find_email' as field_name, cast(id % 7 as int) as priority, cast(null as varchar(9)) as blocked_reason from chapters where id % 3 = 0"
_REQUESTS = "select id, case status when 'partial' then 'queued' else status end as status, started_at, case when id % 11 = 0 then 'deferred' end as queue_state from crawl_runs"
_JOBS = "select id, chapter_id, field_name, status, terminal_outcome, attempts, cast(scheduled_at as timestamp) as scheduled_at, payload_value from field_jobs"


def _completed(part: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        jobs = run_sql(spark, sf_dir, _JOBS)
        x = D.job_outcome(F.col("payload_value") > 100_000, F.col("payload_value") / 200_000, F.lit(0.85), F.col("attempts"), F.lit(3))
        outcomes = jobs.where("status = 'running'").select("id", x.alias("x"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"), F.lit(0.9).alias("confidence")).select("id", "x.*", "value", "confidence")
        out = M.completed(jobs.drop("payload_value", "attempts"), outcomes, F.expr(NOW))[part]
        return out

    return run


def _inactive(part: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chapters = relation(spark, sf_dir, "chapters").select("id", "chapter_status", "website_url", "instagram_url", "contact_email")
        jobs = relation(spark, sf_dir, "field_jobs").select("id", "chapter_id", "status")
        return M.inactivated(chapters, jobs, chapters.where("id % 4 = 1").select("id"))[part]

    return run


def _handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = relation(spark, sf_dir, "chapters").select("id", "instagram_url")
    best = chapters.where("id % 5 < 3").select(F.col("id").alias("chapter_id"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("handle"))
    kept, new = (M.resolved_instagram(chapters, best, r).select("id", F.col("instagram_url").alias(c)) for r, c in ((False, "kept"), (True, "replaced")))
    return kept.join(new, "id")


# Pages and documents as sources hold them -----------------------------------------------------------------------------

_S = "cast(p_partkey as varchar(20))"
_SCHOOL = "'School ' || cast(p_partkey % 37 as varchar(20))"
#: Pages with a table (with a header, without one, or none), two zones, links and JSON-LD or an inline array.
MADE = f"""select p_partkey as page_id, 'https://c' || {_S} || '.example.edu/list/' as url, '<html><head><title>T</title>' ||
    case p_partkey % 5 when 0 then '<script type="application/ld+json">{{"name": "Rho ' || {_S} || '", "url": "https://rho.org", "address": {{"addressLocality": "Waco", "addressRegion": "TX"}}, "@id": "x1"}}</script>' when 1 then '<script>var d = [{{"chapterName": "Tau ' || {_S} || '", "school": "Rice", "state": " "}}, {{"city": "Nome"}}];</script>' else '' end || '</head><body>' ||
    case p_partkey % 4 when 0 then '<table><tr><th>School</th><th>Chapter</th><th>E-Mail</th><th>State</th></tr><tr><td>' || {_SCHOOL} || '</td><td>Beta ' || {_S} || '</td><td>b' || {_S} || '@x.org</td><td>TX</td></tr><tr><td>Empty</td><td> </td><td></td><td>NY</td></tr></table>'
        when 1 then '<table><tr><td>Zeta ' || {_S} || '</td><td>' || {_SCHOOL} || '</td><td>Waco</td></tr></table>' else '<p>No table</p>' end ||
    case p_partkey % 3 when 0 then '<h2>Recognized chapters</h2><p>Alpha Beta</p><h2>Loss of recognition</h2><p>Kappa Sigma</p>' when 1 then '<h3>Suspended groups</h3><p>Mu Nu</p><h3>Staff</h3>' else '' end ||
    '<a href="mailto:C' || {_S} || '@Example.edu?subject=x">Mail</a> <a href="https://www.instagram.com/c' || {_S} || '_x/">IG</a> <a href="https://www.instagram.com/p/Ab1/">Post</a><p>jane (at) rice (dot) edu</p></body></html>' as html from {{part}}"""
#: KML files with two placemarks of one chapter and one of another.
PLACES = f"""select p_partkey as page_id, '<kml><Placemark><name>' || {_SCHOOL} || ' - Beta ' || {_S} || '</name><description><![CDATA[Website: https://b.org/#a<br>Location: Waco, TX]]></description></Placemark><Placemark id="2"><name>' || upper({_SCHOOL}) || ' - BETA ' || {_S} || '</name></Placemark>' ||
    case when p_partkey % 3 = 0 then '<Placemark><name>Rho</name><description>location: Nome&lt;br&gt;website: none</description></Placemark>' else '' end || '</kml>' as html from {{part}}"""
#: JSON arrays of objects: whole, with a missing key, empty, broken or null.
LISTS = f"""select p_partkey as id, case p_partkey % 5 when 0 then '[{{"school": "S' || {_S} || '", "n": 1}}, {{"school": "T", "n": ' || cast(p_partkey % 9 as varchar(9)) || '}}]' when 1 then '[{{"n": 3}}]' when 2 then '[]' when 3 then cast(null as varchar(9)) else '' end as doc from {{part}}"""
#: Pages that each link to two more, so that rounds of a crawl walk down a tree.
LINKED = f"""select p_partkey as page_id, 'https://x.org/p' || {_S} as url, '<html><body><a href="/p' || cast(2 * p_partkey as varchar(20)) || '">A</a> <a href="p' || cast(2 * p_partkey + 1 as varchar(20)) || '#top">B</a> <a href="/p1">C</a></body></html>' as html from {{part}}"""
#: Paths of directories, profiles and other pages.
PATHS = f"""select page_id as id, coalesce({_pick(15, "https://x.org/find-a-chapter/new-york/12", "https://x.org/Our_History/", "https://x.org/", "https://x.org/district-of-columbia/2020/very-long-token-of-a-path-that-is-cut", "https://x.org/join/recruit", "https://x.org/news/chapter", "https://x.org/campus/contact-us", "https://x.org/a/b/c/d", "https://x.org", of="page_id")}, url) as url from {{pages}}"""


#: Pages are made of parts after these are dealt over all tasks, so that only keys are shuffled.
_PARTS = {"part": "p_partkey"}


def _parsed(make: Callable[[DataFrame], DataFrame]) -> Query:
    return _sql(MADE, lambda d: make(H.parsed(d)), _PARTS)


def tables(d: DataFrame) -> DataFrame:
    return H.table_records(d).select("page_id", "row", "name", "university_name", "city", "state", "contact_email")


def by_plan(d: DataFrame) -> DataFrame:
    plans = d.select("page_id", F.when(F.col("page_id") % 2 == 0, "table").otherwise("script_json").alias("primary"))
    return R.extracted(d, plans).select("page_id", "strategy", "name", "university_name")


def zones(d: DataFrame) -> DataFrame:
    return H.status_zones(d).select("page_id", "zone_heading", "zone_text", "zone_type", "confidence")


def hints(d: DataFrame) -> DataFrame:
    return H.contact_hints(d).select("page_id", F.array_join("emails", ",").alias("emails"), F.array_join("instagrams", ",").alias("instagrams"))


def walks(d: DataFrame) -> DataFrame:
    starts = d.sparkSession.createDataFrame([("s", "https://x.org/p1"), ("t", "https://x.org/p5")], "session_id string, url string")
    return H.crawl_rounds(starts, H.parsed(d), 3, 5).select("session_id", "link", "depth", F.round("score", 4).alias("score"))


def _route(d: DataFrame) -> DataFrame:
    return d.select("id", S.route_class(S.url_path("url")).alias("route"))


QUERIES: dict[str, Query] = {
    "c10_routes": _sql(PATHS, _route),
    "d30_made_zones": _parsed(zones),
    "d46_walks": _sql(LINKED, walks, _PARTS),
    "d47_made_hints": _parsed(hints),
    "s03_table_records": _parsed(tables),
    "s06_json_records": _parsed(lambda d: H.json_records(d).select("page_id", "name", "university_name", "city", "state", "website_url", "external_id", "confidence")),
    "s07_kml_records": _sql(PLACES, lambda d: H.kml_records(d).select("page_id", "mark", "name", "university_name", "city", "state", "website_url"), _PARTS),
    "s08_extracted": _parsed(by_plan),
    "s09_embedded_data": _parsed(lambda d: d.select("page_id", H.embedded_data().alias("x")).select("page_id", "x.kind")),
    "s19_unnested": _sql(LISTS, lambda d: R.unnested(d, "id", "doc", "school string, n int")),
    "u02_discovery_upsert": _two(_CHAPTERS, _FOUND, lambda old, new: M.merged(old, new, ["id"], fill=["name", "website_url", "contact_email"])),
    "u03_frontier_upsert": _two(_FRONTIER, _LINKS, M.frontier_merged),
    "u04_profile_upsert": _two(_PROFILES, _SEEN, lambda old, new: M.merged(old, new, ["id"], fill=["source_type"], greatest=["health"])),
    "u06_requeued": _two(_QUEUE, _AGAIN, lambda old, new: M.merged(old, new, ["chapter_id", "field_name"], greatest=["priority"])),
    "u08_claimed_requests": _sql(_REQUESTS, lambda d: M.claimed(d, [F.col("started_at"), F.col("id")], 30, "w2").select("id", "status", "claimed_by")),
    "u12_completed_jobs": _completed(0),
    "u12_review_items": _completed(1),
    "u12_provenance": _completed(2),
    "u16_inactivated": _inactive(0),
    "u16_closed_jobs": _inactive(1),
    "u17_resolved_handles": _handles,
}

# SQL ------------------------------------------------------------------------------------------------------------------


def _merge(old: str, new: str, keys: str, columns: str) -> str:
    return f"select {', '.join(f'coalesce(o.{k}, n.{k}) as {k}' for k in keys.split(', '))}, {columns} from ({old}) o full join ({new}) n on {' and '.join(f'o.{k} = n.{k}' for k in keys.split(', '))}"


_OUTCOME = f"""x as (select *, case when status <> 'running' then null when payload_value > 100000 and payload_value / 200000 >= 0.85 then 'complete' when payload_value > 100000 then 'review' when attempts >= 3 then 'fail_terminal' else 'requeue' end as a from ({_JOBS}) j)"""
_STATES = _list([s.replace(" ", "-") for s in S.STATES if s != "district of columbia"] + ["dc"])
_TOKEN = f"case when list_contains({_STATES}, t) then 'state' when regexp_matches(t, '^[0-9]+$') then 'num' else substr(t, 1, 20) end"
_HITS = {name: f"len(list_filter(k, lambda t: len(list_filter({_list(words)}, lambda w: contains(t, w))) > 0))" for name, words in S.ROUTES.items()}
_TABLES = f"""select p_partkey as page_id, 1 as row, 'Beta ' || {_S} as name, {_SCHOOL} as university_name, null as city, 'TX' as state, 'b' || {_S} || '@x.org' as contact_email from {{part}} where p_partkey % 4 = 0
    union all select p_partkey, 0, 'Zeta ' || {_S}, {_SCHOOL}, 'Waco', null, null from {{part}} where p_partkey % 4 = 1"""
_JSONS = f"""select p_partkey as page_id, 'Rho ' || {_S} as name, null as university_name, 'Waco' as city, 'TX' as state, 'https://rho.org' as website_url, 'x1' as external_id, 0.95e0 as confidence from {{part}} where p_partkey % 5 = 0
    union all select p_partkey, 'Tau ' || {_S}, 'Rice', null, null, null, null, 0.55e0 from {{part}} where p_partkey % 5 = 1"""

def _routes(rows: str, key: str = "id") -> str:
    return f"""with p as (select id, {_path("url")} as path from ({rows}) u), r as (select id, list_transform(list_filter(string_split(lower(path), '/'), lambda t: t <> ''), lambda t: replace(t, '_', '-')) as t from p), k as (select id, list_transform(t, lambda t: {_TOKEN}) as k from r),
        h as (select id, k, {", ".join(f'{v} as "{n}"' for n, v in _HITS.items())} from k), b as (select *, greatest({", ".join(f'"{n}"' for n in _HITS)}) as best from h)
        select {key}, case when len(k) = 0 then 'root' when best = 0 then 'generic:' || array_to_string(k[1:3], '-') {" ".join(f"""when "{n}" = best then '{n}'""" for n in _HITS)} end as route from b"""


def _level(depth: int) -> str:
    """The best five pages that the level before links to and no level before holds."""
    seen = " union all ".join(f"select s, i from l{d}" for d in range(depth))
    found = f"select distinct l.s, n.i from l{depth - 1} l join n on n.i in (2 * l.i, 2 * l.i + 1, 1) where (l.s, n.i) not in ({seen})"
    return f"l{depth} as (select s, i from ({found}) f qualify row_number() over (partition by s order by 'https://x.org/p' || i) <= 5)"


#: The records of domain.records normalised: their names need no calming and their schools are named in full.
_NORMAL = """select cast(id as int) as ordinal, regexp_replace(regexp_replace(lower(concat_ws('-', name, university)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, name, university as university_name, cast(null as varchar) as city, state, website_url, instagram_url, contact_email, cast(id as varchar) as external_id,
    case when university is null then 'repairable_candidate' else 'canonical_valid' end as validity_class, 'https://example.edu/chapters' as source_url, 0.8e0 as source_confidence from chapters"""
#: The text that ends each page made.
_END = "Mail IG Post jane (at) rice (dot) edu"

_SQL: dict[str, str] = {
    "c10_routes": _routes(PATHS),
    "c10_route_classes": _routes("select page_id as id, url from {pages}", "id as page_id"),
    "d36_normalized": _NORMAL,
    "d36_provenance": f"select ordinal, source_confidence as confidence, field_name, field_value from (unpivot ({_NORMAL}) on name, university_name, city, state, website_url, instagram_url, contact_email, external_id into name field_name value field_value) u",
    "d30_made_zones": f"""select p_partkey as page_id, h as zone_heading, t as zone_text, k as zone_type, c as confidence from {{part}} join (values (0, 'Recognized chapters', 'Alpha Beta', 'recognized', 0.9e0), (0, 'Loss of recognition', 'Kappa Sigma {_END}', 'unrecognized', 0.9e0),
        (1, 'Suspended groups', 'Mu Nu', 'suspended', 0.9e0), (1, 'Staff', '{_END}', null, 0.3e0)) z(m, h, t, k, c) on p_partkey % 3 = m
        union all select p_partkey, '', case p_partkey % 4 when 0 then 'School Chapter E-Mail State ' || {_SCHOOL} || ' Beta ' || {_S} || ' b' || {_S} || '@x.org TX Empty NY' when 1 then 'Zeta ' || {_S} || ' ' || {_SCHOOL} || ' Waco' else 'No table' end || case when p_partkey % 3 = 2 then ' {_END}' else '' end, null, 0.3e0 from {{part}}""",
    "d46_walks": f"""with n as (select p_partkey as i from {{part}}), l0 as (select * from (values ('s', 1), ('t', 5)) v(s, i)), {", ".join(map(_level, (1, 2, 3)))},
        a as ({" union all ".join(f"select s, i, {d} as depth from l{d}" for d in range(4))}) select s as session_id, 'https://x.org/p' || i as link, depth, case when depth = 0 then 0e0 else round(1e0 - 0.45e0 * depth, 4) end as score from a""",
    "d47_made_hints": f"select p_partkey as page_id, 'c' || {_S} || '@example.edu' || case when p_partkey % 4 = 0 then ',b' || {_S} || '@x.org' else '' end || ',jane@rice.edu' as emails, 'https://www.instagram.com/c' || {_S} || '_x' as instagrams from {{part}}",
    "s03_table_records": _TABLES,
    "s06_json_records": _JSONS,
    "s07_kml_records": f"""select p_partkey as page_id, 0 as mark, 'Beta ' || {_S} as name, {_SCHOOL} as university_name, 'Waco' as city, 'TX' as state, 'https://b.org/' as website_url from {{part}} union all select p_partkey, 2, 'Rho', null, 'Nome', null, null from {{part}} where p_partkey % 3 = 0""",
    "s08_extracted": f"select page_id, 'table' as strategy, name, university_name from ({_TABLES}) t where page_id % 2 = 0 union all select page_id, 'script_json', name, university_name from ({_JSONS}) j where page_id % 2 = 1",
    "s09_embedded_data": "select p_partkey as page_id, case p_partkey % 5 when 0 then 'json_ld' when 1 then 'script_array' end as kind from {part}",
    "s19_unnested": f"select p_partkey as id, 0 as ordinal, 'S' || {_S} as school, 1 as n from {{part}} where p_partkey % 5 = 0 union all select p_partkey, 1, 'T', p_partkey % 9 from {{part}} where p_partkey % 5 = 0 union all select p_partkey, 0, null, 3 from {{part}} where p_partkey % 5 = 1",
    "u02_discovery_upsert": _merge(_CHAPTERS, _FOUND, "id", "coalesce(n.name, o.name) as name, o.state, coalesce(n.website_url, o.website_url) as website_url, coalesce(n.contact_email, o.contact_email) as contact_email"),
    "u03_frontier_upsert": _merge(_FRONTIER, _LINKS, "crawl_session_id, canonical_url", "greatest(o.score_total, n.score_total) as score_total, case when o.score_total is null or n.score_total >= o.score_total then n.score_components else o.score_components end as score_components, coalesce(o.anchor_text, n.anchor_text) as anchor_text"),
    "u04_profile_upsert": _merge(_PROFILES, _SEEN, "id", "o.slug, coalesce(n.source_type, o.source_type) as source_type, greatest(o.health, n.health) as health"),
    "u06_requeued": _merge(_QUEUE, _AGAIN, "chapter_id, field_name", "greatest(o.priority, n.priority) as priority, case when n.chapter_id is null then o.blocked_reason end as blocked_reason"),
    "u08_claimed_requests": f"with r as ({_REQUESTS}), h as (select id from r where status = 'queued' and coalesce(queue_state, 'actionable') = 'actionable' order by started_at, id limit 30) select r.id, case when h.id is null then r.status else 'running' end as status, case when h.id is not null then 'w2' end as claimed_by from r left join h on h.id = r.id",
    "u12_completed_jobs": f"""with {_OUTCOME} select id, chapter_id, field_name, case when a in ('complete', 'review') then 'done' when a = 'requeue' then 'queued' when a = 'fail_terminal' then 'failed' else status end as status, case a when 'complete' then 'updated' when 'review' then 'review_required' when 'fail_terminal' then 'terminal_no_signal' else terminal_outcome end as terminal_outcome,
        case when a = 'requeue' then {{now}} + to_seconds(cast(60 * pow(2, greatest(attempts - 1, 0)) as bigint)) else scheduled_at end as scheduled_at from x""",
    "u12_review_items": f"with {_OUTCOME} select id, chapter_id, field_name, 'v' || id as value from x where a = 'review'",
    "u12_provenance": f"with {_OUTCOME} select chapter_id, field_name, 'v' || id as field_value, 0.9e0 as confidence from x where a = 'complete'",
    "u16_inactivated": f"select id, case when id % 4 = 1 then 'inactive' else chapter_status end as chapter_status, {', '.join(f'case when id % 4 <> 1 then {c} end as {c}' for c in ('website_url', 'instagram_url', 'contact_email'))} from chapters",
    "u16_closed_jobs": "select j.id, chapter_id, case when c.id is not null and status in ('queued', 'running') then 'done' else status end as status from field_jobs j left join (select id from chapters where id % 4 = 1) c on c.id = chapter_id",
    "u17_resolved_handles": "with x as (select id, instagram_url as old, case when id % 5 < 3 then 'https://www.instagram.com/h' || id end as new from chapters) select id, coalesce(old, new) as kept, coalesce(new, old) as replaced from x",
}

ORACLE_SQL: dict[str, str] = {k: duck_sql(v) for k, v in _SQL.items()}
