"""Queries of the decisions on contact and source candidates, each with SQL that computes the whole rule.

The cases are made from the test tables so that every branch of a rule is reached.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.operators import candidates as C
from quillmesh.operators import organisations as O
from quillmesh.operators import scoring as D
from quillmesh.plans.analogs import duck_sql, run_sql

Query = Callable[[SparkSession, str], DataFrame]


def _pick(k: int, *cases: str | None, of: str = "id") -> str:
    """SQL of the case that the id's remainder by k names; null for others."""
    quoted = [f"when {i} then '{c}'" for i, c in enumerate(cases) if c is not None]
    return f"case {of} % {k} {' '.join(quoted)} end"


#: Search results and found contacts: page URLs of the table among others, with texts of documents.
FOUND = f"""select id, coalesce({_pick(13, None, "https://www.sigmachi.org/chapters/find-a-chapter", "https://sigmachi.org/", "https://www.reddit.com/r/sigma", "https://greeklife.state.edu/organization/list", "https://alumni.kappasigma.org/members/news.pdf",
    "https://linktr.ee/x", "https://tke.org/about", "https://travel.example.com/resort/island", "https://chapters.example.org/our-chapters/texas/", "https://dynamic.omegafi.com/login", "nothing", "https://www.kappasigma.org/history")}, url) as url,
    {_pick(6, "Official Sigma Chi International Fraternity", "Kappa Sigma chapter directory", "Tau Kappa Epsilon", "Software tutorial", "Alumni of Sigma Chi")} as title,
    {_pick(7, "The official website of the chapter", "A fraternity with chapters and brotherhood: Sigma Chi", "vacation on an island", "directory of Kappa Sigma", "greek life and ifc")} as snippet,
    {_pick(3, "Sigma Chi", "Kappa Sigma", "Tau Kappa Epsilon")} as name, {_pick(3, "sigma-chi", "kappa-sigma", "tau-kappa-epsilon")} as slug,
    id % 12 + 1 as rank_, {_pick(7, "provenance", "search_result", "search_page", "chapter_website", "nationals_directory", "source_page", of="(id + 2)")} as provider,
    {_pick(5, "https://www.state.edu/orgs/list", "https://greek.tech.example.com/chapters/", "https://example.org/contact", "https://facebook.com/x", of="(id + 1)")} as doc_url,
    {_pick(4, "https://sigmachi.org/", "https://kappasigma.org/chapters", "https://example.org", of="(id + 3)")} as source_url, {_pick(3, "Beta Rho", "Texas Tech Chapter", "Zeta", of="(id + 1)")} as chapter, {_pick(4, "Texas Tech University", "State College", "Rice University")} as school,
    {_pick(8, "info@sigmachi.org", "betarho@gmail.com", "jane.doe@state.edu", "office@greek.tech.example.com", "rho@yahoo.com", "HQ@tke.org", "sigma@rice.edu", "x@example.org", of="(id + 5)")} as email,
    {_pick(12, *(f"https://www.instagram.com/{h}" for h in ("ttusigmachi_texastechchapter", "kappasigma.state", "tke_betarho", "sc", "ks_ttu", "riceuniversity", "sigchi.official", "ttukappasigma", "hq", "sigma_chi_ttc", "rice", "tau.kappa.epsilon_zeta")))} as handle,
    text from (select page_id as id, url, text from {{pages}} left join {{documents}} on doc_id = page_id) t"""

#: Found addresses and their jobs: documents that name the job's organisation and school, others of like names, or none.
MAILS = f"""select id, provider, doc_url, source_url, title, chapter, {_pick(4, "sigma-chi", "kappa-sigma", "tau-kappa-epsilon", "phi-gamma-delta-national", of="(id + 1)")} as slug,
    {_pick(7, "Texas Tech University", "University of Texas", "Rice University", "Florida State University", "State College", "University of the South", of="(id + 2)")} as school, {_pick(5, "https://ttusigchi.example.org/", "https://www.x.org", of="(id + 1)")} as website,
    coalesce({_pick(14, "info@sigmachi.org", "ttu.president@gmail.com", "betarho@gmail.com", "jane.doe@state.edu", "office@greek.tech.example.com", "greeklife@ttu.edu", "john_smith12@mail.ttusigchi.example.org", "HQ@tke.org", "sigmachi@rice.edu", "x@example.org", "jane.roe@tech.example.com", "rush-chair@kappasigma.org", "fsu.zeta@yahoo.com", of="(id + 5)")}, email) as email,
    coalesce({_pick(15, "Contact the president of Sigma Chi at Texas Tech University. ", "The North University of Texas chapter of FIJI. ", "Texas State University news and events. ", "Kappa Sigma at Rice University: officers. ", "University of Florida, Tau Kappa Epsilon. ", "Delta Chi fraternity and Beta Theta Pi. ",
      "Sigma Chi, University of Texas. Email the rush chair of Beta Rho. ", "TKE at Texas Tech: scholarships. ", "Leadership of Phi Gamma Delta at the University of the South. ", "Rice University Zeta chapter of Kappa Sigma. ", of="(id + 3)")}, '') || text as text
    from ({FOUND}) f"""

#: Evidence of handles: names of source types, page scopes and specificities.
TYPED = f"""select id, {_pick(29, *C.SOURCE_TYPE_ALIASES, " Search ", "authoritative_bundle", "unheard_of")} as named, {_pick(5, "school_specific", "national_specific_to_chapter", "chapter_specific", " ", of="(id + 3)")} as specificity,
    {_pick(7, "school_page", "international", "chapter_site", "the chapter_website", of="(id + 1)")} as scope, {_pick(11, "https://x.edu/a", "https://n.org/chapter-directory", "https://n.org/find-a-chapter", "https://n.org/chapters/1", "https://instagram.com/x", "https://y.org/page", " ", of="(id + 2)")} as url,
    {_pick(3, "bing", " ")} as provider, {_pick(4, "q", " ", of="(id + 1)")} as query from (select l_orderkey * 10 + l_linenumber as id from {{lineitem}}) t"""


def _free() -> dict[str, Column]:
    return {"overlap": F.col("id") % 9, "relevant": F.col("id") % 7 != 0}


def _words() -> Column:
    return C.job_keywords(F.col("slug"), F.col("chapter"), F.lit(None).cast("string"), F.col("school"))


def _campus() -> Column:
    return F.array(F.lit("Tech.example.com"))


def _on(cases: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(run_sql(spark, sf_dir, f"select * from ({cases}) c"))


def _guard() -> Column:
    return C.source_identity(F.col("url"), F.col("title"), F.col("snippet"), F.col("name"), F.col("slug"))


def discovery(d: DataFrame) -> DataFrame:
    d = d.withColumn("g", _guard())
    score = C.discovery_score(F.col("url"), F.col("title"), F.col("snippet"), F.col("rank_"), F.col("name"), F.col("slug"), F.col("g"))
    return d.select("id", "g.decision", F.round("g.confidence", 4).alias("confidence"), "g.reason", F.round(score, 6).alias("score"))


def websites(d: DataFrame) -> DataFrame:
    tier = C.website_tier(F.col("url"), _campus(), F.col("source_url"))
    score = C.website_score(F.col("url"), F.col("provider"), F.col("doc_url"), F.col("title"), F.col("text"), _words(), _campus(), F.col("source_url"))
    return d.select("id", tier.alias("tier"), F.round(score, 6).alias("score"))


def emails(d: DataFrame) -> DataFrame:
    d = d.withColumn("job", O.job_facts(F.col("slug"), F.col("chapter"), F.lit(None).cast("string"), F.col("school")))
    tier = C.website_tier(F.col("doc_url"), _campus(), F.col("source_url"))
    d, looks = O.mail_facts(d, F.col("email"), F.col("job"), *(F.col(c) for c in ("provider", "doc_url", "title", "text")), tier, _campus(), F.col("source_url"), F.col("website"))
    score = C.email_score(F.col("email"), F.col("provider"), F.col("doc_url"), F.col("title"), F.col("text"), _words(), tier, looks, mailto=F.col("id") % 2 == 0, obfuscated=F.col("id") % 5 == 0)
    facts = {k: v for k, v in vars(looks).items() if k != "low_signal"}
    return d.select("id", *(v.alias(k) for k, v in facts.items()), F.round(score, 6).alias("score"))


def handles(d: DataFrame) -> DataFrame:
    match = C.handle_match(S.instagram_handle("handle"), F.col("name"), F.array(F.lit("SigChi")), F.col("school"), F.col("chapter"))
    score = C.handle_score(F.col("handle"), F.col("provider"), F.col("title"), F.col("text"), F.when(F.col("id") % 5 == 0, F.lit("Site:instagram.com x")), _words(), direct=F.col("id") % 4 == 0, match=match, generic=F.col("id") % 10 == 0, **_free())
    return d.select("id", match.alias("match"), F.round(score, 6).alias("score"))


def qualities(d: DataFrame) -> DataFrame:
    d = d.select("id", C.source_quality(F.col("url")).alias("q"))
    return d.select("id", F.round("q.score", 6).alias("score"), "q.is_weak", "q.is_blocked", F.array_join("q.reasons", ",").alias("reasons"), C.official_directory(F.col("q")).alias("official"))


def promotions(d: DataFrame) -> DataFrame:
    official = C.official_directory(C.source_quality(F.col("url")))
    kind = F.when(F.col("id") % 3 == 0, "national").when(F.col("id") % 3 == 1, " institutional ").otherwise("social")
    return d.select("id", C.promotion(F.col("source_url"), F.col("school"), F.col("id") % 2 == 0, official, kind).alias("promoted"))


def resolutions(d: DataFrame) -> DataFrame:
    source = C.source_type(*(F.col(c) for c in ("named", "specificity", "scope", "url", "provider", "query")))
    return d.select("id", source.alias("source")).select("id", "source", D.resolution(F.lit(0.8) + F.col("id") % 20 / 100.0, F.col("source")).alias("resolution"))


def source_types(d: DataFrame) -> DataFrame:
    source = C.source_type(*(F.col(c) for c in ("named", "specificity", "scope", "url", "provider", "query")))
    return d.groupBy(source.alias("canonical")).agg(F.count("*").alias("n"))


def exclusive(d: DataFrame) -> DataFrame:
    c = d.select((F.col("id") % 40).alias("chapter_id"), (F.col("id") % 23).cast("string").alias("handle"), (F.col("id") % 17 / 17.0).alias("score"))
    return D.exclusive_best(c).select("chapter_id", "handle", F.round("score", 9).alias("score"))


QUERIES: dict[str, Query] = {
    "c38_source_quality": _on(FOUND, qualities),
    "c42_org_densities": lambda spark, sf_dir: run_sql(spark, sf_dir, f"select id, repeat(coalesce(title, '') || ' ' || coalesce(snippet, ''), cast(id % 9 as int)) || ' ' || text as t from ({FOUND}) c").select("id", S.org_density("t").alias("density")),
    "d15_discovery_scores": _on(FOUND, discovery),
    "d22_email_scores": _on(MAILS, emails),
    "d23_handle_scores": _on(FOUND, handles),
    "d24_website_scores": _on(FOUND, websites),
    "d26_resolutions": _on(TYPED, resolutions),
    "d27_exclusive_handles": _on(FOUND, exclusive),
    "d34_capabilities": _on(FOUND, lambda d: d.select("id", D.national_capability(F.col("url"), F.concat_ws(" ", "title", F.when(F.col("id") % 4 == 0, "Active and inactive").when(F.col("id") % 17 == 1, "dormant chapters")), F.coalesce("snippet", F.lit(""))).alias("capability"))),
    "d39_promotions": _on(FOUND, promotions),
    "f08_source_type": _on(TYPED, source_types),
}

# SQL ------------------------------------------------------------------------------------------------------------------


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _found(text: str, words: list[str]) -> str:
    return f"list_filter({_list(words)}, lambda m: contains({text}, m))"


def _n(text: str, words: list[str]) -> str:
    return f"len({_found(text, words)})"


def _host(url: str) -> str:
    return rf"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"


def _path(url: str) -> str:
    return rf"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"


def _below(host: str, hosts: list[str]) -> str:
    return f"(len(list_filter({_list(hosts)}, lambda b: {host} = b or ends_with({host}, '.' || b))) > 0)"


def _joined(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def _tier(url: str) -> str:
    h, s = _host(f"case when contains({url}, '://') then {url} else 'https://' || {url} end"), _host("source_url")
    return f"""case when coalesce({url}, '') = '' then 'unknown' when {_below(h, C.BLOCKED_WEBSITE_HOSTS)} then 'blocked' when {_below(h, C.TIER2_WEBSITE_HOSTS)} then 'tier2'
        when ends_with({h}, '.edu') or {_below(h, ["tech.example.com"])} or coalesce({s} <> '' and ({h} = {s} or ends_with({h}, '.' || {s})), false) then 'tier1' else 'unknown' end"""


def _base(points: dict[str, float], default: float) -> str:
    return "case provider " + " ".join(f"when '{k}' then {v}e0" for k, v in points.items()) + f" else {default}e0 end"


def _hits(first: str) -> str:
    words = "list_filter(list_distinct(string_split(regexp_replace(lower(concat_ws('-', slug, trim(chapter), trim(school))), '[^a-z0-9]+', '-', 'g'), '-')), lambda w: len(w) >= 3)"
    return f"len(list_filter({words}, lambda w: contains(lower(concat_ws(' ', {first}, title, substr(text, 1, 200))), w)))"


def _if(test: str, points: float) -> str:
    return f"case when {test} then {points}e0 else 0e0 end"


_WEB = f"""with c as ({FOUND}), f as (select *, {_tier("url")} as tier, {_tier("doc_url")} as doc_tier, {_n("lower(url)", C.LISTING_MARKERS)} > 0 as listing, coalesce({_n("lower(doc_url)", C.LISTING_MARKERS)} > 0, false) as doc_listing,
        {_host("url")} as host, coalesce({_host("doc_url")}, '') as doc_host, provider = 'search_page' as on_page from c),
    s as (select *, {_base(C.WEBSITE_BASE, C.WEBSITE_DEFAULT)} + {_if("regexp_matches(lower(text), 'website|official')", 0.08)} + {_if("tier = 'tier1'", 0.08)} + {_if("doc_tier = 'tier1'", 0.08)} + {_if("on_page and doc_host <> '' and host <> '' and host <> doc_host", 0.05)}
        + {_if("on_page and doc_tier = 'tier1' and doc_listing", 0.08)} + {_if("on_page and doc_tier = 'tier1' and doc_listing and host <> '' and host <> doc_host and not listing", 0.08)} - {_if("listing", 0.18)} - {_if("listing and provider = 'search_result'", 0.12)} as raw from f)
    select id, tier, case when tier = 'blocked' then 0e0 else round(greatest(0e0, least(0.95e0, case when tier = 'tier2' then least(raw - 0.08e0, 0.78e0) else raw end + 0.03e0 * {_hits("url")})), 6) end as score from s"""

def _plain(*parts: str) -> str:
    return f"trim(regexp_replace(lower(concat_ws(' ', {', '.join(parts)})), '[^a-z0-9]+', ' ', 'g'))"


def _split(text: str, keep: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '' and {keep})"


_SHORT = "w not in ('the', 'and', 'of', 'for')"
_FIRSTS = "array_to_string(list_transform(" + _split("{0}", "w not in ('of', 'the', 'and', 'at')") + ", lambda w: w[1]), '')"


def _telling(text: str) -> str:
    long = _split(text, f"len(w) >= 4 and not list_contains({_list(O.MATCH_STOPWORDS)}, w)")
    return f"case when len({long}) > 0 then {long} else {_split(text, f'len(w) >= 3 and {_SHORT}')} end"


_ALL_GREEK = _list([*S.GREEK.values()])
_RUNS = "\\b(?:" + "|".join(S.GREEK.values()) + ")(?:\\s+(?:" + "|".join(S.GREEK.values()) + ")){1,3}\\b"


def _own(x: str) -> str:
    """Whether a plain text names the organisation."""
    j = f"replace({x}, ' ', '')"
    return f"""(phrase <> '' and {x} <> '' and (contains({x}, phrase) or contains({j}, replace(phrase, ' ', '')) or len(list_filter(aliases, lambda a: contains({x}, a) or case when regexp_full_match(replace(a, ' ', ''), '[a-z]{{1,3}}')
        then contains(' ' || {x} || ' ', ' ' || replace(a, ' ', '') || ' ') else contains({j}, replace(a, ' ', '')) end)) > 0
        or len(tokens) > 0 and len(list_filter(tokens, lambda w: contains({x}, w))) >= case when len(list_filter(tokens, lambda w: not list_contains({_ALL_GREEK}, w))) = 0 then len(tokens) else least(len(tokens), 2) end))"""


def _other(x: str) -> str:
    return f"({x} <> '' and phrase <> '' and not contains({x}, phrase) and regexp_matches({x}, '{_RUNS}'))"


_MAIL = f"""with c as ({MAILS}), n as (select *, {_plain("replace(coalesce(slug, ''), '-', ' ')")} as shown, {_plain("coalesce(school, '')")} as sch, {_plain("coalesce(chapter, '')")} as cha, {_tier("doc_url")} as doc_tier,
        lower(split_part(email, '@', 1)) as local_, lower(split_part(email, '@', 2)) as dom, coalesce(provider in ('search_result', 'search_page'), false) as searched,
        {_plain("title", "substr(text, 1, 1200)", "doc_url", "email")} as near, {_plain("title", "substr(text, 1, 1200)", "doc_url")} as page, {_plain("title", "substr(text, 1, 900)", "doc_url")} as front, {_plain("title", "substr(text, 1, 300)", "doc_url")} as start_, {_plain("title")} as head from c),
    o as (select *, array_to_string({_split("shown", f"not list_contains({_list(O.NO_IDENTITY)}, w)")}, ' ') as phrase, {_split("shown", f"len(w) >= 3 and {_SHORT}")} as own_words, {_telling("sch")} as sw, {_telling("cha")} as cw, regexp_replace(local_, '[^a-z0-9]+', '', 'g') as lj, {_FIRSTS.format("shown")} as ini, {_FIRSTS.format("sch")} as sini from n),
    p as (select *, {_split("phrase", f"len(w) >= 3 and {_SHORT}")} as tokens, {_FIRSTS.format("phrase")} as pini, list_filter(cw, lambda w: not list_contains(sw, w) and not list_contains(own_words, w) and not list_contains({_list(O.CHAPTER_STOPWORDS)}, w)) as signal_ from o),
    q as (select *, list_filter([phrase, case when len(replace(phrase, ' ', '')) >= 6 then replace(phrase, ' ', '') else '' end, case when len(pini) >= 2 then pini else '' end, array_to_string({_split("phrase", "true")}[1:2], ' '), array_to_string({_split("shown", "w not in ('main', 'national')")}, ' '),
          case phrase {" ".join(f"when '{k}' then '{v[0]}'" for k, v in O.SEARCH_NAMES.items())} else '' end], lambda a: a <> '') as aliases,
        starts_with(sch, 'university of ') as of_, regexp_replace(sch, '^university of | state university$', '') as core, case when sch <> '' then regexp_extract(near, '\\b([a-z0-9]+) ' || sch || '\\b', 1) else '' end as pre from p),
    r as (select *, {_own("near")} as own, sch <> '' and (of_ and pre <> '' and not list_contains({_list(O.PREFIXES_ALLOWED)}, pre) and not list_contains(own_words, pre) and not list_contains(tokens, pre)
          or of_ and core <> '' and contains(near, core || ' state') or ends_with(sch, ' state university') and core <> '' and contains(near, 'university of ' || core) and not contains(near, sch)) as clash,
        len(list_filter(signal_, lambda w: contains(near, w))) > 0 as chap, lj <> '' and (contains(lj, replace(shown, ' ', '')) or len(sini) >= 3 and contains(lj, sini) or len(list_filter(cw, lambda w: len(w) >= 4 and contains(lj, w))) > 0 or len(ini) >= 3 and contains(lj, ini)) as identity,
        list_contains({_list(O.OFFICE_PREFIXES)}, local_) or {_n("local_", O.OFFICE_MARKERS)} > 0 as office, regexp_full_match(local_, '[a-z]{{2,}}[._-][a-z]{{2,}}[0-9]{{0,4}}') as person, {_n("page", O.ROLE_MARKERS)} > 0 as contact_page, {_n("front", O.LOW_SIGNAL_MARKERS)} > 0 as low_,
        dom <> '' and (ends_with(dom, '.edu') or {" or ".join(f"coalesce({h} <> '' and (dom = {h} or ends_with(dom, '.' || {h})), false)" for h in (_host("website"), _host("source_url"), "'tech.example.com'"))}) as known_domain from q),
    s as (select *, not clash and (sch <> '' and contains(near, sch) or len(sw) > 0 and len(list_filter(sw, lambda w: contains(near, w))) >= least(len(sw), 2)) as at_school, {_other("head")} or {_other("start_")} and not {_own("start_")} as other from r),
    t as (select *, case when clash then false when office and not identity then coalesce(provider = 'chapter_website', false) and own and contact_page and (at_school or chap)
          when coalesce(provider = 'provenance', false) and known_domain and not office and not other then true when doc_tier = 'tier1' and coalesce(provider <> 'provenance', true) and not (own or chap or identity) then false
          else identity and (at_school or chap or own) or own and (at_school or chap) and known_domain or contact_page and (at_school or chap) and known_domain and not office end as relevant,
        at_school::int * 2 + own::int * 2 + chap::int + known_domain::int as overlap from s)
    select id, identity, office, person, known_domain, overlap, contact_page, relevant, round(greatest(0e0, least(0.95e0, {_base(C.EMAIL_BASE, C.EMAIL_DEFAULT)} + {_if("id % 2 = 0", 0.05)} - {_if("id % 5 = 0", 0.04)} + 0.02e0 * {_hits("email")} + 0.025e0 * least(6, overlap) + {_if("doc_tier = 'tier1'", 0.05)} - {_if("doc_tier = 'blocked'", 0.25)}
        + {_if("regexp_matches(lower(doc_url), 'contact|officer|leadership|board|about|staff')", 0.03)} - {_if(f"list_contains({_list(C.GENERIC_EMAIL_PREFIXES)}, local_)", 0.08)} + {_if("ends_with(dom, '.edu')", 0.05)} + {_if("known_domain", 0.04)}
        - {_if(f"list_contains({_list(C.FREE_EMAIL_DOMAINS)}, dom) and searched", 0.08)} - {_if("searched and not identity", 0.12)} - {_if("searched and office", 0.08)} - {_if("person and not identity", 0.16)} - {_if("low_", 0.2)} + {_if("contact_page", 0.03)} - {_if("not relevant", 0.24)})), 6) as score from t"""

_NAMED = f"trim(regexp_replace(combined, '\\s+', ' ', 'g'))"
_CLASH = f"""not contains({_NAMED}, lower(name)) and not contains({_NAMED}, replace(slug, '-', ' ')) and not contains({_NAMED}, replace(slug, '-', '')) and not (len({_FIRSTS.format("lower(name)")}) >= 3 and contains({_NAMED}, {_FIRSTS.format("lower(name)")})) and regexp_matches({_NAMED}, '{_RUNS}')"""

_DISCOVERY = f"""with c as ({FOUND}), f as (select *, lower(coalesce(title, '')) as t, lower(coalesce(snippet, '')) as s, {_host("url")} as host, lower({_path("url")}) as path, {_joined("name")} as wanted from c),
    g as (select *, concat_ws(' ', t, s, host, path) as combined, concat_ws(' ', t, s, path) as tsp, trim(regexp_replace(concat_ws(' ', t, s, host, path), '[^a-z0-9]+', ' ', 'g')) as plain, {_joined("host")} as jh, list_filter(string_split(path, '/'), lambda p: p <> '') as segs from f),
    h as (select *, len(list_filter(string_split(lower(name), ' '), lambda w: contains(jh, w))) as tokens, {_n("tsp", C.IDENTITY_DIRECTORY_MARKERS)} > 0 as dir_, {_n("plain", C.IDENTITY_CONTEXT_MARKERS)} as ctx, {_n("tsp", C.CONTEXT_MARKERS)} as ctx2, len(segs) = 1 and list_contains({_list(C.GENERIC_SEGMENTS)}, segs[1]) as generic from g),
    i as (select *, 0.18e0 + {_if(f"contains({_joined('t')}, wanted) or contains({_joined('s')}, wanted) or contains(jh, wanted) or contains({_joined('path')}, wanted)", 0.3)} + {_if(f"contains(jh || {_joined('path')}, replace(slug, '-', ''))", 0.18)} + case when tokens >= 2 then 0.14e0 when tokens = 1 then 0.08e0 else 0e0 end
        + {_if("dir_", 0.16)} + case when ctx >= 2 then 0.12e0 when ctx = 1 then 0.06e0 else 0e0 end - {_if("len(segs) = 0", 0.05)} - {_if("generic and not dir_", 0.18)} as raw from h),
    j as (select *, case when host = '' then 'missing_host' when {_below("host", C.BLOCKED_SOURCE_HOSTS)} then 'blocked_host' when {_CLASH} then 'cross_fraternity_conflict' when {_n("plain", C.OTHER_MARKERS)} > 0 and ctx = 0 then 'non_org_context' when round(raw, 9) >= 0.48 then 'identity' else 'low_identity_confidence' end as reason from i),
    k as (select *, case when reason <> 'identity' then 'reject' when round(raw, 9) >= 0.72 then 'match' else 'weak_match' end as decision, case when reason in ('missing_host', 'blocked_host') then 0e0 when reason = 'cross_fraternity_conflict' then 0.05e0 when reason = 'non_org_context' then greatest(0e0, least(raw, 0.2e0)) else greatest(0e0, least(raw, 0.99e0)) end as confidence,
        0.36e0 + {_if(f"contains({_joined('t')}, wanted)", 0.2)} + {_if(f"contains({_joined('s')}, wanted)", 0.1)} + {_if("contains(jh, wanted)", 0.16)} + {_if(" or ".join(f"slug = '{k}' and {_below('host', v)}" for k, v in C.HOST_HINTS.items()), 0.35)} + case when tokens >= 2 then 0.12e0 when tokens = 1 then 0.06e0 else 0e0 end
        + case when {_n("path", C.DIRECTORY_MARKERS)} > 0 then 0.12e0 when generic then -0.18e0 else 0e0 end + {_if("regexp_matches(t, 'official|international|fraternity')", 0.08)} + {_if("regexp_matches(s, 'official|chapter|directory|fraternity')", 0.06)} - {_if("contains(tsp, 'alumni')", 0.3)} - {_if("ends_with(path, '.pdf')", 0.25)}
        + case when ctx2 = 0 then -0.2e0 when ctx2 >= 2 then 0.08e0 else 0e0 end - {_if(f"{_n('tsp', C.OTHER_MARKERS)} > 0 and ctx2 = 0", 0.18)} - {_if("regexp_matches(tsp, 'travel|vacation|resort|island') and ctx2 = 0", 0.2)} as found from j),
    l as (select *, case decision when 'match' then found + 0.12e0 when 'weak_match' then found + 0.02e0 else least(found, 0.25e0) end as guarded from k)
    select id, decision, round(confidence, 4) as confidence, reason, round(greatest(0e0, least(0.99e0, case when reason = 'cross_fraternity_conflict' then 0e0 else guarded end - {_if("reason = 'blocked_host'", 0.45)} + greatest(0e0, 0.08e0 - (rank_ - 1) * 0.01e0))), 6) as score from l"""

_QUALITY = f"""with c as ({FOUND}), f as (select id, school, source_url, {_host("url")} as host, {_path("url")} as path from c),
    g as (select *, lower(host || case when path = '' then '/' else path end) as at_, regexp_replace(path, '/+$', '') as bare from f),
    h as (select *, {_found("at_", C.POSITIVE_URL_MARKERS)} as pos, {_found("at_", C.WEAK_URL_MARKERS)} as weak, {_found("host", C.WEAK_HOST_MARKERS)} as poor, list_filter({_list(C.GENERIC_PATH_MARKERS)}, lambda m: ends_with(bare, '/' || m)) as gen0, {_below("host", C.BLOCKED_SOURCE_HOSTS)} as blocked, len(list_filter(string_split(bare, '/'), lambda p: p <> '')) as depth from g),
    i as (select *, case when len(pos) = 0 then gen0 else [] end as gen from h),
    j as (select *, round(greatest(0e0, least(1e0, 0.55e0 - {_if("blocked", 0.7)} + least(0.35e0, len(pos) * 0.08e0) - least(0.75e0, len(weak) * 0.24e0) - least(0.4e0, len(gen) * 0.16e0) - least(0.7e0, len(poor) * 0.3e0) + case when depth = 0 then -0.12e0 when depth >= 2 then 0.06e0 else 0e0 end)), 9) as sure from i),
    q as (select id, school, source_url, host = '' as bad, case when host = '' then 0e0 else round(sure, 6) end as score, host = '' or blocked or sure < 0.45e0 or len(weak) > 0 or len(poor) > 0 as is_weak, host <> '' and blocked as is_blocked,
        case when host = '' then 'invalid_url' else array_to_string(case when blocked then ['blocked_host'] else [] end || list_transform(pos, lambda m: 'positive:' || m) || list_transform(weak, lambda m: 'weak:' || m) || list_transform(gen, lambda m: 'generic_info:' || m) || list_transform(poor, lambda m: 'weak_host:' || m)
            || case when depth = 0 then ['generic_root_path'] when depth >= 2 then ['deeper_path'] else [] end, ',') end as reasons, len(pos) > 0 or depth >= 2 as strong from j)
    select *, not bad and not is_blocked and not is_weak and strong as official from q"""

_MATCH = f"""case when contains(h, {_joined("name")}) or contains(h, 'sigchi') then 2 when len(ini) >= 3 and contains(h, ini) then 1 else 0 end
    + coalesce(case when len(sini) >= 3 and contains(h, sini) then 2 when len(list_filter(string_split(lower(school), ' '), lambda w: len(w) >= 5 and contains(h, w))) > 0 then 1 else 0 end, 0)
    + case when len({_joined("chapter")}) >= 4 and contains(h, {_joined("chapter")}) or len(cini) >= 1 and len(cini) >= 2 and contains(h, cini) then 1 else 0 end"""
_INITIALS = "array_to_string(list_transform(list_filter(string_split(lower({0}), ' '), lambda w: w not in ('of', 'the', 'and')), lambda w: w[1]), '')"
_HANDLE = f"""with c as ({FOUND}), f as (select *, {_joined("regexp_extract(handle, 'com/(.*)', 1)")} as h, {_INITIALS.format("name")} as ini, {_INITIALS.format("school")} as sini, {_INITIALS.format("chapter")} as cini from c), g as (select *, {_MATCH} as match from f)
    select id, match, round(greatest(0e0, least(0.95e0, {_base(C.HANDLE_BASE, C.HANDLE_DEFAULT)} + {_if("id % 4 = 0", 0.04)} + 0.02e0 * {_hits("handle")} + 0.03e0 * least(match, 5) + 0.025e0 * least(id % 9, 6) + {_if("id % 5 = 0", 0.03)} - {_if("id % 10 = 0", 0.1)} - {_if("id % 7 = 0", 0.24)})), 6) as score from g"""

_SOURCE = f"""with c as ({TYPED}), f as (select id, lower(trim(coalesce(named, ''))) as n, lower(trim(coalesce(specificity, ''))) as k, lower(trim(coalesce(scope, ''))) as p, lower(trim(coalesce(url, ''))) as u, trim(coalesce(provider, '')) as v, trim(coalesce(query, '')) as q from c),
    s as (select id, case when list_contains({_list(C.SOURCE_TYPES)}, n) then n {" ".join(f"when n = '{k}' then '{v}'" for k, v in C.SOURCE_TYPE_ALIASES.items() if k not in C.SOURCE_TYPES)}
        when k = 'school_specific' or starts_with(p, 'school') or contains(u, '.edu') then 'official_school_chapter_page' when k = 'national_specific_to_chapter' or contains(p, 'nation') or contains(u, 'chapter-directory') or contains(u, 'find-a-chapter') or contains(u, '/chapters') then 'nationals_chapter_page'
        when k = 'chapter_specific' or contains(p, 'chapter_website') or contains(p, 'chapter_site') then 'verified_chapter_website' when contains(u, 'instagram.com/') or v <> '' or q <> '' then 'search_result_profile' when u <> '' then 'provenance_supporting_page' else 'search_result_profile' end as source from f)"""

_DENSITY = "(" + " + ".join(f"(len(t) - len(replace(t, '{w}', ''))) // {len(w)}" for w in S.ORG_WORDS) + ")"

_SQL: dict[str, str] = {
    "c38_source_quality": f"select id, score, is_weak, is_blocked, reasons, official from ({_QUALITY}) x",
    "c42_org_densities": f"with x as (select id, lower(repeat(coalesce(title, '') || ' ' || coalesce(snippet, ''), cast(id % 9 as int)) || ' ' || text) as t from ({FOUND}) c), n as (select id, t, {_DENSITY} as h from x) select id, case when h >= 18 then 0.98e0 when h >= 10 then 0.9e0 when h >= 5 then 0.78e0 when h >= 2 then 0.58e0 else 0.28e0 end as density from n",
    "d15_discovery_scores": _DISCOVERY,
    "d22_email_scores": _MAIL,
    "d23_handle_scores": _HANDLE,
    "d24_website_scores": _WEB,
    "d26_resolutions": f"""{_SOURCE} select id, source, case when round(0.8e0 + id % 20 / 100e0, 9) >= case {" ".join(f"when source = '{k}' then {v}e0" for k, v in D.WRITE_THRESHOLDS.items())} else 0.9e0 end then 'write' when round(0.8e0 + id % 20 / 100e0, 9) >= 0.82e0 then 'review' else 'reject' end as resolution from s""",
    "d34_capabilities": f"""with x as (select id, trim(regexp_replace(lower(concat_ws(' ', url, concat_ws(' ', title, case when id % 4 = 0 then 'Active and inactive' when id % 17 = 1 then 'dormant chapters' end), coalesce(snippet, ''))), '\\s+', ' ', 'g')) as t from ({FOUND}) c)
        select id, case when contains(t, 'dormant chapters') or contains(t, 'active chapters and colonies') then 'active_dormant_split' when contains(t, 'active') and contains(t, 'inactive') then 'all_status' when regexp_matches(t, 'map|locator') and (len(t) - len(replace(t, 'chapter', ''))) // 7 < 5 then 'map_with_status_filter'
        when regexp_matches(t, 'history|historical|chapter roll|archives') then 'history_roll' when regexp_matches(t, 'don t see a chapter at your school|bring|start a chapter|our chapters|chapter directory') then 'active_only' else 'unknown' end as capability from x""",
    "f08_source_type": f"{_SOURCE} select source as canonical, count(*) as n from s group by 1",
    "d39_promotions": f"select id, source_url is not null and school is not null and (id % 2 = 0 or official and id % 3 < 2) as promoted from ({_QUALITY}) x",
}

ORACLE_SQL: dict[str, str] = {k: duck_sql(v) for k, v in _SQL.items()}
