"""Queries of page, campus, entity and job decisions, each with SQL that computes the whole rule.

The cases are made from the test tables so that every branch of a rule is reached.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.operators import candidates as C
from quillmesh.operators import scoring as D
from quillmesh.plans.analogs import duck_sql, run_sql
from quillmesh.plans.decisions import FOUND, _below, _host, _if, _joined, _list, _path, _pick
from quillmesh.plans.phrases import _LETTERS, _PERSON, _WORDS, PHRASES

Query = Callable[[SparkSession, str], DataFrame]

#: Pages of campuses and organisations by URL, title and text, with links to them.
PAGES = f"""select p_partkey as id, {_pick(12, "https://greek.state.edu/recognized-chapters", "https://sigmachi.org/", "https://news.example.com/article/7", "https://www.reddit.com/r/x", "https://x.edu/conduct/hazing", "http://A.B.Example.CO.uk/our-chapters/?p=1", "nothing", "https://localhost/toolkit", "mailto:a@b.org", "https://www.facebook.com/find-a-chapter", None, "https://y.edu/directory", of="p_partkey")} as url,
    {_pick(7, "Chapter status", "News", "Registered student organization", "Loss of recognition", "Welcome", "Hazing", of="(p_partkey + 1)")} as title,
    {_pick(13, "Recognized fraternities at State", "Campus life", "The chapter and its rush week", "Officers of our Chapter", "The national office lists all chapters", "National news", "This campus does not permit fraternities", "Currently recognized chapters of Greek life", "Formerly recognized chapters of the archive", "Fraternities are prohibited here", "Active chapters of 1990 in a historical list", "Member login: sign in to view", of="(p_partkey + 2)")} as text,
    {_pick(11, "Find a Chapter news", " Our chapters ", "Chapter Map", "Award toolkit", " ", "Chapter profile blog", "Staff Directory", "Go to site", "Chapter roll and chapter directory", "Resource", of="(p_partkey + 3)")} as label,
    {_pick(5, "directory", "index", "detail", "search", of="(p_partkey + 4)")} as role from {{part}}"""

#: Values found for contacts.
CONTACTS = f"""select p_partkey as id, {_pick(41, "https://www.instagram.com/sigma_chi", "@kappa.sigma", "instagram.com/tke?hl=en", "https://instagram.com/p/Cx12", "https://www.instagram.com/reel/abc/", "https://instagram.com/tv/9", "https://instagram.com/stories/rho/1", "https://instagram.com/explore/tags/x", "https://instagram.com/locations/5/rice", "https://www.instagram.com/@beta_rho/",
    "p", "accounts", "logo.png", "1234567", "ab", "a name that is far too long for any handle", "https://example.org/sigma", "Info@Rice.EDU", "mailto:Jane.Doe@state.edu?subject=Hi", "MAILTO:rho%40x.org", "bob+tag@x.org", "bob@x", "@", "/team", "//cdn.example.org/a#b", " HTTPS://Example.org/a#top ", "ftp://x.org", "index.html", "sigma chi", " ", "", None,
    "HTTP://INSTAGRAM.COM/Upper", "@reels", "zeta_1", "https://www.instagram.com/", "a%20b@x.org", "x@y.co?cc=z", "about", "office@a-b.example.com", of="p_partkey")} as x, p_partkey % 11 / 10e0 as sure from {{part}}"""

#: Records of chapters: a phrase or a first line as name, with a school and a snippet.
RECORDS = f"""select id, x, case id % 9 when 0 then null when 1 then 'Home' when 2 then ' ' else 'Rice University' end as school, case id % 8 when 0 then 'From Wikipedia, the free one' when 1 then null else 'chapter list' end as snippet,
    case id % 10 when 0 then 'tag-alpha' when 1 then 'wp-content' when 2 then null else 'alpha-wp-' end as slug from ({PHRASES}) p
    union all select 1000000 + p_partkey, {_pick(31, "Home", "No 5", "1999", "42.5 %", "1998-1999", "3rd", "rank 12", "References", "Total enrollment", "Chapter of the Year", "Western Division", "Alpha Beta Region", "John Smith", "Alpha Beta", " ", None, "TBA", "Scholarship winners", "edit", "Learn more", "Beta Rho", "Gamma Delta Award", "N/A", "white", "21st", "conference", of="p_partkey")},
    case p_partkey % 4 when 0 then null when 1 then 'search' else 'State College' end, case when p_partkey % 5 = 0 then 'wikipedia' else '' end, null from {{part}}"""

#: Handles found for chapters, one row each.
SWEPT = f"select id % 40 as chapter_id, regexp_extract(handle, 'com/(.*)', 1) as handle, max(title) as text from ({FOUND}) f where handle is not null group by 1, 2"


def _on(cases: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(run_sql(spark, sf_dir, f"select * from ({cases}) c"))


def _is(k: int, below: int = 1) -> Column:
    return F.col("id") % k < below


def _profile() -> Column:
    i = F.col("id")
    flags = {"has_json_ld": _is(17), "has_script_json": _is(13), "has_map": _is(11)}
    numbers = {"tables": F.when(_is(3), i % 4).otherwise(0), "repeated": i % 7 % 4, "cards": i % 5 % 3, "anchors": i % 3, "links": i % 19}
    return F.struct(F.col("role").alias("role"), *(c.alias(k) for k, c in (flags | numbers).items()))


_PROFILE = "id % 17 = 0 as has_json_ld, id % 13 = 0 as has_script_json, id % 11 = 0 as has_map, case when id % 3 = 0 then id % 4 else 0 end as tables, id % 7 % 4 as repeated, id % 5 % 3 as cards, id % 3 as anchors, id % 19 as links, case when id % 6 = 0 then 'https://x.org/api' end as api"


def _api() -> Column:
    return F.when(_is(6), "https://x.org/api")


def plans(d: DataFrame) -> DataFrame:
    d = d.withColumn("p", _profile()).withColumn("kind", D.source_class(F.col("p")))
    x = D.extraction_plan(F.col("p"), F.col("kind"), _is(5), _api())
    return d.select("id", "kind.*", x.alias("x")).select("id", "page_type", "confidence", "strategy", "follow_links", "x.primary", F.array_join("x.fallbacks", ",").alias("fallbacks"))


def link_scores(d: DataFrame) -> DataFrame:
    return d.select("id", D.chapter_link_score(F.col("label"), F.col("url"), F.col("text")).alias("x")).select("id", "x.score", F.array_join("x.reasons", ",").alias("reasons"))


def domains(d: DataFrame) -> DataFrame:
    i = F.col("id")
    x = D.official_domain(_is(2), _is(3), i % 4, i % 3, i % 6, _is(5), _is(7, 3), i % 4 == 1, _is(9), _is(13))
    return d.select("id", x.alias("x")).select("id", "x.*")


def tokens(d: DataFrame) -> DataFrame:
    x = D.identity_tokens(F.col("name"), F.col("school"), F.col("chapter"))
    return d.select("id", x.alias("x")).select("id", *(F.array_join(f"x.{c}", ",").alias(c) for c in ("fraternity", "school", "chapter")))


def campus(d: DataFrame) -> DataFrame:
    return d.select("id", D.campus_source(F.col("url"), F.col("title"), F.col("text"), S.url_host("url").endswith(".edu")).alias("x")).select("id", "x.source_type", "x.authority_tier", *(F.round(f"x.{c}", 6).alias(c) for c in ("currentness", "completeness")))


def zones(d: DataFrame) -> DataFrame:
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, [*D.POSITIVE_ZONES, *D.NEGATIVE_ZONES, "other"])), (i % 9 + 1).cast("int"))
    m = d.select((i % 50).alias("chapter_id"), kind.alias("zone_type"), i.alias("zone_order"), (i % 5).alias("authority_tier"), (i % 8 / 8.0).alias("currentness"), (i % 3 / 4.0).alias("zone_confidence"), (i % 11 / 16.0).alias("match_confidence"))
    return D.best_zone(m).select("chapter_id", "positive", "zone_order", F.round("zone_score", 6).alias("zone_score"))


def alerts(d: DataFrame) -> DataFrame:
    runs = d.select("id", (F.col("id") % 40 / 100.0).alias("mismatch_rate"), F.array(F.struct(F.lit("drift").alias("name"), (~_is(3)).alias("passed")), F.struct(F.lit("uplift").alias("name"), (~_is(4)).alias("passed"))).alias("checks"))
    return D.benchmark_alerts(runs)


def audits(d: DataFrame) -> DataFrame:
    return d.select("id", D.contact_audit(F.col("x"), F.col("sure")).alias("audit"))


def low_signals(d: DataFrame) -> DataFrame:
    results = d.select(F.concat_ws(" ", "name", F.col("id") % 97).alias("query"), "url", "title", "snippet")
    return D.low_signal_queries(results, C.BLOCKED_SOURCE_HOSTS)


def smoke(d: DataFrame) -> DataFrame:
    return D.smoke_flags(d.select(F.concat_ws(" ", "name", F.col("id") % 97).alias("query"), "url", "title", "snippet"))


def instagrams(d: DataFrame) -> DataFrame:
    words = lambda c, *more: F.concat(F.split(F.lower(F.coalesce(c, F.lit("none"))), " "), F.array(*more))
    named = F.replace(F.lower("name"), F.lit(" "), F.lit(""))
    handle, i = F.regexp_extract("handle", "com/(.*)", 1), F.col("id")
    source = F.element_at(F.array(*map(F.lit, [*D.SOURCE_PRIORS, "unheard_of"])), (i % 16 + 1).cast("int"))
    kind = F.when(_is(3), "chapter_specific").when(i % 3 == 1, "national_generic")
    d = d.select("id", source.alias("source"), D.instagram_score(handle, F.col("title"), source, kind, words(F.col("name"), named), words(F.col("school")), words(F.col("chapter")), _is(10)).alias("x"))
    return d.select("id", "source", F.round("x.score", 4).alias("score"), F.array_join("x.rejects", ",").alias("rejects"), D.resolution(F.col("x.score"), F.col("source")).alias("action"))


def swept(d: DataFrame) -> DataFrame:
    i = F.col("chapter_id")
    kind = F.element_at(F.array(*map(F.lit, [*D.SOURCE_PRIORS, "unheard_of"])), ((i * 7 + F.length("handle")) % 16 + 1).cast("int"))
    candidates = d.select("chapter_id", "handle", "text", kind.alias("source_type"), F.when(i % 3 == 0, "chapter_specific").otherwise("national_generic").alias("contact_specificity"))
    of = lambda k, *words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    split = lambda c: F.split(F.lower(c), " ")
    name = of(i, "Sigma Chi", "Kappa Sigma", "Tau Kappa Epsilon")
    identities = d.select("chapter_id").distinct().select("chapter_id", F.concat(split(name), F.array(F.replace(F.lower(name), F.lit(" "), F.lit("")))).alias("fraternity"), split(of(i, "Texas Tech University", "State College", "Rice University", "none")).alias("school"), split(of(i + 1, "Beta Rho", "Texas Tech Chapter", "Zeta")).alias("chapter"))
    taken = d.where(i % 3 == 0).groupBy("handle").agg(F.min("chapter_id").alias("chapter_id"))
    best = D.sweep(candidates, identities, taken)
    return best.select("chapter_id", "handle", F.col("source_type").alias("source"), F.round("score", 4).alias("score"), F.array_join("rejects", ",").alias("rejects"), "action")


def best_sources(d: DataFrame) -> DataFrame:
    i = F.col("id")
    c = d.select((i % 40).alias("fraternity_id"), "url", F.when(~_is(4), i % 6 / 5.0).alias("health"), F.concat(F.lit("s"), i.cast("string")).alias("slug"))
    return D.best_source(c).select("fraternity_id", "slug")


def validities(d: DataFrame) -> DataFrame:
    school = S.blank_to_null("school")
    return d.select("id", D.validity(F.col("x"), school, S.institution_signals("x"), S.greek_phrases("x")).alias("validity"))


QUERIES: dict[str, Query] = {
    "c08_host_families": _on(PAGES, lambda d: d.select("id", S.host_family("url").alias("family"))),
    "c13_emails": _on(CONTACTS, lambda d: d.select("id", S.as_email("x").alias("email"))),
    "c14_instagrams": _on(CONTACTS, lambda d: d.select("id", S.as_instagram("x").alias("profile"), S.instagram_kind("x").alias("kind"), S.instagram_handle("x").alias("handle"))),
    "c33_field_states": _on(CONTACTS, lambda d: d.select("id", S.field_state("x", "sure").alias("state"), S.confidence_tier("sure").alias("tier"))),
    "d03_extraction_plans": _on(PAGES, plans),
    "d04_layouts": _on(PAGES, lambda d: d.select("id", D.layout(_profile()).alias("x")).select("id", "x.*")),
    "d07_link_scores": _on(PAGES, link_scores),
    "d17_official_domains": _on(PAGES, domains),
    "d18_site_scopes": _on(PAGES, lambda d: d.select("id", D.site_scope(F.col("url"), F.concat_ws(" ", "title", "text")).alias("x")).select("id", "x.*")),
    "d19_greek_policies": _on(PAGES, lambda d: d.select("id", D.greek_policy(~_is(4), F.concat_ws(" ", "title", "text")).alias("x")).select("id", "x.*")),
    "d20_roster_verdicts": _on(PAGES, lambda d: d.select("id", D.roster_verdict(~_is(4), _is(3), F.col("id") % 5, _is(13), _is(11)).alias("x")).select("id", "x.*")),
    "d25_instagram_scores": _on(FOUND, instagrams),
    "d28_identity_tokens": _on(FOUND, tokens),
    "d29_campus_sources": _on(PAGES, campus),
    "d31_best_zones": _on(PAGES, zones),
    "d35_validities": _on(RECORDS, validities),
    "d40_benchmark_alerts": _on(PAGES, alerts),
    "d41_search_queries": _on(FOUND, lambda d: d.select("id", F.array_join(D.search_queries(F.col("name"), F.col("school"), F.col("chapter")), "|").alias("queries"))),
    "d44_index_modes": _on(PAGES, lambda d: d.select("id", D.index_mode(_profile(), F.when(_is(23), "locator_map").otherwise("x"), F.col("text"), _api(), F.when(_is(29), "mixed")).alias("x")).select("id", "x.*")),
    "d49_contact_audits": _on(CONTACTS, audits),
    "d51_handle_sweep": _on(SWEPT, swept),
    "d56_best_sources": _on(PAGES, best_sources),
    "f16_invalid_reasons": _on(RECORDS, lambda d: d.select("id", S.invalid_reason("x", "school", "snippet").alias("reason"))),
    "f17_navigation": _on(RECORDS, lambda d: d.select("id", S.is_navigation("x", "school", "slug").alias("navigation"))),
    "f19_low_signals": _on(FOUND, low_signals),
    "f20_smoke_flags": _on(FOUND, smoke),
}

# SQL ------------------------------------------------------------------------------------------------------------------


def _cases(*cases: tuple[str, str], other: str = "null") -> str:
    return "case " + " ".join(f"when {test} then {value}" for test, value in cases) + f" else {other} end"


def _made(cases: list[tuple[str, str, float]], other: tuple[str, float], kind: str, sure: str = "confidence") -> str:
    """Two columns of one ladder of (test, kind, confidence)."""
    return f"{_cases(*((t, f"'{k}'") for t, k, _ in cases), other=f"'{other[0]}'")} as {kind}, {_cases(*((t, f'{v}e0') for t, _, v in cases), other=f'{other[1]}e0')} as {sure}"


_PROFILED = f"p as (select *, {_PROFILE} from ({PAGES}) c)"
_CLASS_CASES = [("has_json_ld", "script_embedded_data", 0.9), ("has_script_json", "script_embedded_data", 0.8), ("has_map", "locator_map", 0.8), ("tables > 0 and dir_", "static_directory", 0.9), ("repeated >= 2 and dir_", "static_directory", 0.85), ("repeated >= 1 and dir_", "static_directory", 0.7), ("dir_ and links >= 10", "static_directory", 0.65)]
_STATIC = "page_type = 'static_directory'"
_PLAN = f"""with {_PROFILED}, q as (select *, coalesce(role = 'directory', false) as dir_, id % 5 = 0 as embedded from p),
    c as (select *, {_made(_CLASS_CASES, ("unsupported_or_unclear", 0.0), "page_type")}, {_cases(("has_json_ld or has_script_json", "'script_json'"), ("has_map", "'locator_api'"), ("tables > 0 and dir_", "'table'"), ("dir_ and (repeated >= 1 or links >= 10)", "'repeated_block'"), other="'review'")} as strategy, case when tables > 0 then 'table' else 'repeated_block' end as first_, case when tables > 0 then 'repeated_block' else 'table' end as second_ from q)
    select id, page_type, confidence, strategy, not (has_json_ld or has_script_json or has_map or tables > 0 or repeated >= 1) and dir_ and links >= 10 as follow_links,
    {_cases((f"{_STATIC} and confidence >= 0.75e0", "first_"), ("embedded and api is not null", "'locator_api'"), ("embedded", "'script_json'"), (_STATIC, "first_"), ("confidence >= 0.75e0", "strategy"), other="'review'")} as primary,
    {_cases((f"{_STATIC} and confidence >= 0.75e0", "concat_ws(',', second_, case when embedded then 'script_json' end, 'review')"), ("embedded and api is not null", "'script_json,review'"), ("embedded", "'review'"), (_STATIC, "second_ || ',review'"), ("confidence >= 0.75e0", "'review'"), other="''")} as fallbacks from c"""

_LAYOUTS = [("tables > 0", "table", 0.92), ("cards >= 1 and repeated >= 2", "mixed_cards", 0.9), ("cards >= 2", "explicit_cards", 0.88), ("anchors >= 2", "anchor_cards", 0.86), ("links >= 6", "linked_list", 0.78), ("repeated >= 2", "repeated_blocks", 0.72)]


def _first(text: str, words: list[str]) -> str:
    return f"list_filter({_list(words)}, lambda m: contains({text}, m))[1]"


_LINKS = f"""with x as (select id, lower(trim(coalesce(label, ''))) as low, lower(trim(coalesce(url, ''))) as u, lower(trim(coalesce(text, ''))) as ctx from ({PAGES}) c), y as (select *, {_path("u")} as path from x),
    z as (select *, {_first("path", D.URL_UP)} as up, {_first("path", D.URL_DOWN)} as down, list_filter({_list(D.LABEL_UP)}, lambda m: contains(low, m)) as good, list_filter({_list(D.LABEL_DOWN)}, lambda m: contains(low, m)) as bad, regexp_matches(ctx, 'chapter|university|college') as near, regexp_matches(u, 'instagram\\.com|facebook\\.com|x\\.com') as social, regexp_matches(u, '^(mailto|tel):') as contact from y)
    select id, case when contact then 0e0 else round(greatest(0e0, least(1e0, 0.5e0 * len(good) - 0.6e0 * len(bad) + {_if("up is not null", 0.25)} - {_if("down is not null", 0.35)} + {_if("near", 0.2)} - {_if("social", 0.2)})), 6) end as score,
    case when contact then 'contact_scheme_not_chapter_link' else array_to_string(list_transform(good || bad, lambda m: 'label:' || m) || case when up is not null then ['url:' || up] else [] end || case when down is not null then ['url:' || down] else [] end || case when near then ['context:chapter_or_school'] else [] end || case when social then ['social_profile_url'] else [] end, ',') end as reasons from z"""

_DOMAIN = f"""with x as (select id, id % 7 < 3 as edu, id % 13 = 0 as rejected, round(greatest(0e0, least(1e0, 0.22e0 + {_if("id % 2 = 0", 0.24)} + {_if("id % 3 = 0", 0.14)} + {_if("id % 5 = 0", 0.18)} + {_if("id % 7 < 3", 0.08)} + {_if("id % 7 >= 3 and id % 4 <> 1", 0.06)} - {_if("id % 9 = 0", 0.2)}
    + least(0.18e0, (id % 4) * 0.08e0) + least(0.16e0, (id % 3) * 0.08e0) + least(0.16e0, (id % 6) * 0.05e0))), 4) as s from ({PAGES}) c)
    select id, case when rejected then 'reject' when not edu and s >= 0.76e0 then 'official' when edu and s >= 0.72e0 then 'affiliation' when s >= 0.54e0 then 'weak' else 'reject' end as decision, case when rejected then 0e0 else s end as confidence from x"""

_LOW = f"x as (select id, lower(concat_ws(' ', title, text)) as low, coalesce(ends_with({_host('url')}, '.edu'), false) as edu, id % 4 <> 0 as official from ({PAGES}) c)"
_SCOPES = [("edu and regexp_matches(low, 'recognized|fraternit')", "school_affiliation_page", 0.88), ("edu", "school_affiliation_page", 0.7), ("contains(low, 'chapter') and regexp_matches(low, 'rush|recruit|brothers|officers')", "chapter_site", 0.82), ("contains(low, 'national') and contains(low, 'chapters')", "nationals_generic", 0.78), ("contains(low, 'national')", "nationals_generic", 0.58)]
_POLICIES = [
    ("not official", "unknown", 0.0),
    ("regexp_matches(low, 'does not (permit|allow|recognize)|prohibit|banned|not permitted') and regexp_matches(low, 'fraternit|sororit|greek')", "banned", 0.97),
    ("regexp_matches(low, 'current(ly)? recognized|recognized (chapters|organizations)|active chapters') and not regexp_matches(low, 'former|historical|archive')", "allowed", 0.9),
]
_VERDICTS = [("id % 13 = 0", "unknown", 0.15), ("id % 11 = 0", "unknown", 0.2), ("id % 4 <> 0 and id % 3 = 0", "confirmed_active", 0.93), ("id % 4 <> 0 and id % 5 >= 3", "confirmed_inactive", 0.9)]

#: Source types of campus pages by pattern with tier, currentness and completeness; fixed values.
_CAMPUS = [("does not (permit|recognize) (fraternit|greek)|no greek", "no_greek_policy", 0, 0.95, 0.9), ("chapter status|recognized chapters|chapter roster|our chapters", "status_page", 1, 0.9, 0.9), ("loss of recognition|suspended (chapters|organizations)", "suspended_page", 2, 0.85, 0.8), ("registered student organization", "rso_directory", 3, 0.75, 0.7), ("conduct|hazing", "conduct_page", 4, 0.7, 0.6), ("news|article", "article", 5, 0.5, 0.4)]


def _of_campus(place: int, other: str) -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v) if place == 2 else f"{v}e0"
    return _cases(*((f"regexp_matches(low, '{c[0]}')", value(c[place])) for c in _CAMPUS), other=other)


_CAMPUS_SQL = f"""with x as (select id, lower(concat_ws(' ', title, url, text)) as low, coalesce(ends_with({_host("url")}, '.edu'), false) as official from ({PAGES}) c), y as (select *, {_of_campus(1, "'unknown'")} as t, {_of_campus(2, "7")} as tier, {_of_campus(3, "0.4e0")} as cur, {_of_campus(4, "0.3e0")} as comp from x)
    select id, t as source_type, case when official then tier else greatest(tier, 5) end as authority_tier, case when official then cur else least(cur, 0.55e0) end as currentness, case when official then comp else least(comp, 0.65e0) end as completeness from y"""

_ZONES = f"""with x as (select id % 50 as chapter_id, case when id % 9 < 3 then true when id % 9 < 8 then false end as positive, id as zone_order, round(1.1e0 - id % 5 * 0.08e0 + (id % 8 / 8e0 + id % 3 / 4e0 + id % 11 / 16e0) * 0.5e0, 6) as zone_score from ({PAGES}) c)
    select chapter_id, positive, zone_order, zone_score from x where positive is not null qualify row_number() over (partition by chapter_id, positive order by zone_score desc, zone_order) = 1"""

_LABEL = r"trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}%]+', ' ', 'g'))"
_NAV = f"(list_contains({_list(S.NAVIGATION)}, n) or list_contains({_list(S.NAVIGATION)}, m)"
_SLUGGED = "regexp_replace(regexp_replace(lower(trim(concat_ws('-', x, school))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_GREEKS = rf"len(regexp_extract_all(x, '(?i)\b(?:{_LETTERS})(?:\s+(?:{_LETTERS})){{1,3}}\b'))"
_PREFIXED = "'^(wp-|page-|category-|tag-|author-)'"


def _has(text: str, words: list[str]) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w))) > 0"


def _reason(words: str) -> str:
    """The first reason, from n (label of the name), m (of the school) and t (of the snippet)."""
    return _cases(
        ("n = ''", "'identity_semantically_invalid'"), (f"{_NAV} or regexp_matches({_SLUGGED}, {_PREFIXED}))", "'navigation_noise'"), ("regexp_matches(n, '^[0-9]{4}$|^[0-9.]+ ?%$')", "'year_or_percentage'"), (r"regexp_matches(n, '\b(18|19|20)[0-9]{2} (18|19|20)[0-9]{2}\b')", "'year_range'"),
        ("regexp_matches(n, '^(no |rank |top )?[0-9]+(st|nd|rd|th)?$')", "'ranking_row'"), (f"contains({words}, 'wikipedia') or regexp_matches(n, '^(edit|citation needed|references|external links)$')", "'wiki_artifact'"), (_has("n", S.DEMOGRAPHICS), "'demographic_row'"), (_has("n", S.AWARDS), "'award_row'"),
        (f"{_has('n', S.DIVISIONS)} and {_GREEKS} = 0", "'division_row'"), (_PERSON, "'person_name'"),
    )


_LABELLED = f"l as (select *, {_WORDS}, {_LABEL.format('x')} as n, {_LABEL.format('school')} as m, {_LABEL.format('snippet')} as t from ({RECORDS}) r)"
_VALID = rf"""with l as (select id, x, nullif(trim(coalesce(school, '')), '') as school from ({RECORDS}) r), k as (select *, {_WORDS}, {_LABEL.format("x")} as n, {_LABEL.format("school")} as m, trim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9%]+', ' ', 'g')) as p from l),
    g as (select *, coalesce({_GREEKS}, 0) as greeks, coalesce({_PERSON}, false) as person, {_reason("''")} as reason from k),
    s as (select *, case when p = '' or person or regexp_matches(p, '^[0-9]+ ?%?$|\b(18|19|20)[0-9]{{2}} (18|19|20)[0-9]{{2}}\b|^(no|rank|top) ?[0-9]+|^[0-9]+(st|nd|rd|th)\b') then 0 when regexp_matches(p, '{"|".join(S.SCHOOL_TOKENS)}') then 2 when contains(p, ' ') and not regexp_matches(p, '{"|".join(S.DIVISIONS)}') then 1 else 0 end as signals from g)
    select id, case when reason is not null and not (greeks > 0 and person) then 'invalid_non_chapter' when school is not null and (greeks > 0 or signals >= 1) then 'canonical_valid' when school is not null then 'provisional_candidate' else 'repairable_candidate' end as validity from s"""

_ALERTS = f"""with x as (select id, id % 40 as rate, id % 3 <> 0 as a, id % 4 <> 0 as b from ({PAGES}) c), y as (select id, 'gate:drift' as kind, 'warning' as severity from x where not a union all select id, 'gate:uplift', 'warning' from x where not b union all select id, 'mismatch', case when rate >= 25 then 'critical' else 'warning' end from x where rate >= 10)
    select id, kind, severity, kind || ':' || id as fingerprint from y"""

_SQUEEZED = r"trim(regexp_replace(concat_ws(' ', {}), '\s+', ' ', 'g'))"
_SEARCHES = f"""with x as (select id, trim(coalesce(name, '')) as f, trim(coalesce(school, '')) as s, trim(coalesce(chapter, '')) as c from ({FOUND}) d),
    y as (select id, [{", ".join(_SQUEEZED.format(p) for p in ("f, s, 'chapter'", "f, c, s", "'site:instagram.com', f, s", "s, 'fraternity recognized chapters'", "f, s, 'email contact'"))}] as q from x) select id, array_to_string(list_filter(q, lambda a, i: list_position(q, a) = i), '|') as queries from y"""

_GATED = _has("lower(coalesce(text, ''))", ["member portal", "member login", "sign in to view", "directory login"])
_MODE_CASES = [("id % 29 = 0", "mixed", 0.98, "source_metadata_override"), (_GATED, "member_portal_gated", 0.9, "member_portal_keywords"), ("id % 23 = 0 or api is not null", "map_or_api_locator", 0.9, "locator_or_api_hint"), ("tables > 0 or repeated >= 2", "direct_chapter_list", 0.85, "table_or_repeated_blocks"), ("role = 'directory' and links >= 12", "internal_detail_pages", 0.7, "directory_with_many_links"), ("role in ('directory', 'index')", "mixed", 0.55, "mixed_directory_indicators")]

_RAW = "regexp_replace(trim(x), '^@', '')"
_PROFILES = rf"""h as (select *, {_RAW} as raw, trim(coalesce(x, '')) as full_ from ({CONTACTS}) c), i as (select *, case when contains(lower(raw), 'instagram.com/') then regexp_extract(raw, '(?i)instagram\.com/@?([^/?#\s]+)', 1) when starts_with(lower(raw), 'http') then '' else regexp_extract(raw, '^@?([^/?#\s]+)', 1) end as handle from h),
    j as (select id, x, sure, full_, lower(case when starts_with(full_, 'http') then regexp_extract(full_, '^https?://[^/]*/+([^/?#]+)', 1) else regexp_extract(full_, '^@?([^/?#]+)', 1) end) as head, case when handle <> '' and not list_contains({_list(S.RESERVED_HANDLES)}, lower(handle)) and not regexp_matches(lower(handle), '\.(html?|php|aspx?|jsp|png|jpe?g|gif|svg|css|js)$') then handle end as handle from i),
    k as (select *, case when head = 'p' then 'post' when head in ('reel', 'tv') then 'reel' when head = 'stories' then 'story' when head in ('location', 'locations') then 'location' when head = 'explore' then 'explore' when coalesce(regexp_matches(handle, '^[A-Za-z0-9_.]{{3,30}}$') and not regexp_matches(handle, '^[0-9]{{6,}}$'), false) then 'profile' else 'other' end as kind from j)"""

_QUALITY = f"""with c as (select id, url, {_host("url")} as host, {_path("url")} as path from ({PAGES}) d), g as (select *, lower(host || case when path = '' then '/' else path end) as at_, regexp_replace(path, '/+$', '') as bare from c),
    h as (select *, len(list_filter({_list(C.POSITIVE_URL_MARKERS)}, lambda m: contains(at_, m))) as pos, len(list_filter({_list(C.WEAK_URL_MARKERS)}, lambda m: contains(at_, m))) as weak, len(list_filter({_list(C.WEAK_HOST_MARKERS)}, lambda m: contains(host, m))) as poor, len(list_filter({_list(C.GENERIC_PATH_MARKERS)}, lambda m: ends_with(bare, '/' || m))) as gen, {_below("host", C.BLOCKED_SOURCE_HOSTS)} as blocked, len(list_filter(string_split(bare, '/'), lambda p: p <> '')) as depth from g),
    q as (select *, case when coalesce(host, '') = '' then 0e0 else round(greatest(0e0, least(1e0, 0.55e0 - {_if("blocked", 0.7)} + least(0.35e0, pos * 0.08e0) - least(0.75e0, weak * 0.24e0) - case when pos = 0 then least(0.4e0, gen * 0.16e0) else 0e0 end - least(0.7e0, poor * 0.3e0) + case when depth = 0 then -0.12e0 when depth >= 2 then 0.06e0 else 0e0 end)), 6) end as score from h)
    select id % 40 as fraternity_id, 's' || id as slug from q qualify row_number() over (partition by id % 40 order by score desc, case when id % 4 <> 0 then id % 6 / 5e0 end desc nulls last, 's' || id desc) = 1"""

_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: len(w) > 2))"
_QUERY = "concat_ws(' ', name, id % 97)"
_LOWSIG = f"""with x as (select {_QUERY} as query, title, snippet, {_host("url")} as host from ({FOUND}) c), y as (select query, len(list_intersect({_TERMS.format("query")}, {_TERMS.format("concat_ws(' ', title, snippet)")})) as shared, coalesce({_below("host", C.BLOCKED_SOURCE_HOSTS)}, false) as low from x)
    select query, max(shared) < 2 or count(*) filter (where low) >= greatest(2, count(*) // 2) as low_signal from y group by 1"""
_SMOKE = f"""with x as (select {_QUERY} as query, lower(concat_ws(' ', title, snippet, url)) as low, {_host("url")} as host, lower({_path("url")}) as path from ({FOUND}) c),
    y as (select query, bool_or(ends_with(host, '.edu') or regexp_matches(low, 'greek life|fraternity and sorority life|recognized chapters|student organizations')) as official, bool_or(regexp_matches(path, 'chapter-directory|find-a-chapter|chapters|chapter-listing') or not ends_with(host, '.edu') and regexp_matches(low, 'chapter directory|find a chapter|our chapters')) as national,
      bool_or(regexp_matches(host, 'reddit[.]com|quora[.]com|wikipedia[.]org|facebook[.]com')) as odd from x group by 1)
    select query, official, national, official or national as accepted, not (official or national or odd) as review, odd and not (official or national) as unsafe from y"""


def _share(wanted: str) -> str:
    hit = f"len(list_filter({wanted}, lambda w: len(w) >= 4 and contains(replace(low, ' ', ''), w))) > 0"
    return f"greatest(0e0, least(1e0, greatest(len(list_intersect(list_distinct(regexp_split_to_array(low, '[^a-z0-9]+')), {wanted})) / cast(least(len({wanted}), 2) as double), case when {hit} then 0.9e0 else 0e0 end)))"


_TYPES = [*D.SOURCE_PRIORS, "unheard_of"]
_OPEN = "source in ('search_result_profile', 'generated_handle_search', 'existing_db_value')"
def _scored(rows: str, keys: str) -> str:
    """Scores of candidates: rows hold keys, near, low, source, taken and the words fw, sw and cw."""
    return f"""with x as ({rows}),
    y as (select *, {_share("fw")} as f, {_share("sw")} as s, {_share("cw")} as c, {_cases(*((f"source = '{k}'", f"{v}e0") for k, v in D.SOURCE_PRIORS.items()), other="0.5e0")} as trust from x),
    z as (select *, list_transform(list_filter({_list(D.NEGATIVE_MARKERS)}, lambda m: contains(low, m)), lambda m: 'marker:' || m) || case when taken then ['cross_chapter_reuse'] else [] end || case when source = 'generated_handle_search' then ['generated_without_confirmation'] else [] end || case when {_OPEN} and s <= 0 and c <= 0 then ['wrong_school'] else [] end || case when {_OPEN} and f <= 0 then ['wrong_fraternity'] else [] end as rejects from y),
    w as (select {keys}, source, rejects, case when len(rejects) > 0 then 0e0 else round(greatest(0e0, least(1e0, trust * 0.35e0 + f * 0.2e0 + s * 0.16e0 + c * 0.08e0 + case when f > 0 and (s > 0 or c > 0) then 1e0 when f > 0 then 0.5e0 else 0e0 end * 0.08e0 + greatest(0e0, least(1e0, (f + s + c) / 2)) * 0.06e0 + case when near then 1e0 else 0.4e0 end * 0.04e0 + case when taken then 0e0 else 1e0 end * 0.03e0)), 4) end as score from z)
    select {keys}, source, score, array_to_string(rejects, ',') as rejects, case when score >= {_cases(*((f"source = '{k}'", f"{v}e0") for k, v in D.WRITE_THRESHOLDS.items()), other="0.9e0")} then 'write' when score >= 0.82e0 then 'review' else 'reject' end as action from w"""


_INSTAGRAM = _scored(
    f"""select id, id % 3 = 0 as near, lower(concat_ws(' ', regexp_extract(handle, 'com/(.*)', 1), title)) as low, ({_list(_TYPES)})[id % 16 + 1] as source, id % 10 = 0 as taken, string_split(lower(name), ' ') || [replace(lower(name), ' ', '')] as fw, string_split(lower(coalesce(school, 'none')), ' ') as sw, string_split(lower(coalesce(chapter, 'none')), ' ') as cw from ({FOUND}) c""",
    "id",
)
_NAMED = f"""select chapter_id, handle, text, {_pick(3, "Sigma Chi", "Kappa Sigma", "Tau Kappa Epsilon", of="chapter_id")} as name, {_pick(4, "Texas Tech University", "State College", "Rice University", "none", of="chapter_id")} as school, {_pick(3, "Beta Rho", "Texas Tech Chapter", "Zeta", of="(chapter_id + 1)")} as chapter from ({SWEPT}) s"""
_SWEEP = _scored(
    f"""select chapter_id, s.handle, chapter_id % 3 = 0 as near, lower(concat_ws(' ', s.handle, text)) as low, ({_list(_TYPES)})[(chapter_id * 7 + length(s.handle)) % 16 + 1] as source, coalesce(owner <> chapter_id, false) as taken, string_split(lower(name), ' ') || [replace(lower(name), ' ', '')] as fw, string_split(lower(school), ' ') as sw, string_split(lower(chapter), ' ') as cw
        from ({_NAMED}) s left join (select handle, min(chapter_id) as owner from ({SWEPT}) t where chapter_id % 3 = 0 group by 1) o on o.handle = s.handle""",
    "chapter_id, handle",
)

_STOP = _list(["of", "the", "at", "and", "for", "in"])


def _forms(x: str) -> str:
    first = f"array_to_string(list_transform(list_filter(regexp_split_to_array(lower(trim({x})), '[^a-z0-9]+'), lambda w: w <> '' and not list_contains({_STOP}, w)), lambda w: w[1]), '')"
    return f"[lower({x}), {_joined(x)}, {first}]"


def _distinct(q: str) -> str:
    return f"array_to_string(list_filter(list_filter({q}, lambda a: a <> ''), lambda a, i: list_position(list_filter({q}, lambda b: b <> ''), a) = i), ',')"


_TOKENS = f"with x as (select id, {_forms('name')} as f, case when school is null then null else {_forms('school')} end as s, case when chapter is null then null else {_forms('chapter')} end as c from ({FOUND}) d) select id, {_distinct('f')} as fraternity, coalesce({_distinct('s')}, '') as school, coalesce({_distinct('c')}, '') as chapter from x"

_SQL: dict[str, str] = {
    "c08_host_families": f"with h as (select id, url, {_host('url')} as host from ({PAGES}) c), l as (select *, list_filter(string_split(host, '.'), lambda p: p <> '') as l from h) select id, case when len(l) >= 2 then l[-2] || '.' || l[-1] else host end as family from l",
    "c13_emails": rf"with e as (select id, trim(split_part(url_decode(replace(regexp_replace(trim(x), '(?i)^mailto:', ''), '+', '%2B')), '?', 1)) as raw from ({CONTACTS}) c) select id, case when regexp_matches(raw, '{S.EMAIL}') then lower(raw) end as email from e",
    "c14_instagrams": f"with {_PROFILES} select id, 'https://www.instagram.com/' || handle as profile, kind, case when kind = 'profile' then handle end as handle from k",
    "c33_field_states": f"select id, case when trim(coalesce(x, '')) = '' then 'missing' when sure >= 0.6e0 then 'found' else 'low_confidence' end as state, case when sure >= 0.8e0 then 'high' when sure >= 0.6e0 then 'medium' else 'low' end as tier from ({CONTACTS}) c",
    "d03_extraction_plans": _PLAN,
    "d04_layouts": f"with {_PROFILED} select id, {_made(_LAYOUTS, ('unclear', 0.2), 'layout')} from p",
    "d07_link_scores": _LINKS,
    "d17_official_domains": _DOMAIN,
    "d18_site_scopes": f"with {_LOW} select id, {_made(_SCOPES, ('other', 0.35), 'scope')} from x",
    "d19_greek_policies": f"with {_LOW} select id, {_made(_POLICIES, ('unknown', 0.28), 'policy')} from x",
    "d20_roster_verdicts": f"select id, {_made(_VERDICTS, ('unknown', 0.3), 'verdict')} from ({PAGES}) c",
    "d25_instagram_scores": _INSTAGRAM,
    "d28_identity_tokens": _TOKENS,
    "d29_campus_sources": _CAMPUS_SQL,
    "d31_best_zones": _ZONES,
    "d35_validities": _VALID,
    "d40_benchmark_alerts": _ALERTS,
    "d41_search_queries": _SEARCHES,
    "d44_index_modes": f"with {_PROFILED} select id, {_made([c[:3] for c in _MODE_CASES], ('mixed', 0.35), 'mode')}, {_cases(*((c[0], f"'{c[3]}'") for c in _MODE_CASES), other="'fallback_mixed'")} as reason from p",
    "d49_contact_audits": f"with {_PROFILES} select id, case when full_ = '' then 'missing' when kind <> 'profile' then 'clear' when sure >= 0.9e0 then 'keep' when sure >= 0.6e0 then 'review' else 'clear' end as audit from k",
    "d51_handle_sweep": f"with scored as ({_SWEEP}) select * from scored qualify row_number() over (partition by chapter_id order by score desc, handle) = 1",
    "d56_best_sources": _QUALITY,
    "f16_invalid_reasons": f"with {_LABELLED} select id, {_reason('t')} as reason from l",
    "f17_navigation": f"with {_LABELLED} select id, {_NAV} or regexp_matches(slug, {_PREFIXED})) as navigation from l",
    "f19_low_signals": _LOWSIG,
    "f20_smoke_flags": _SMOKE,
}

ORACLE_SQL: dict[str, str] = {k: duck_sql(v) for k, v in _SQL.items()}
