"""Scores of contact and source candidates as Column expressions. Names in brackets are the survey's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.operators.organisations import Mail, names_another

# Fixed values ---------------------------------------------------------------------------------------------------------

#: Hosts that are no organisation's own website, and hosts of link pages (each with all hosts below).
BLOCKED_WEBSITE_HOSTS = "reddit.com facebook.com instagram.com twitter.com x.com youtube.com linkedin.com bing.com stackoverflow.com stackexchange.com github.com sigmaaldrich.com sigma-aldrich.com milliporesigma.com merckmillipore.com".split()
TIER2_WEBSITE_HOSTS = "linktr.ee beacons.ai bio.site campsite.bio allmylinks.com lnk.bio stan.store".split()
#: Hosts that are no source of chapters.
BLOCKED_SOURCE_HOSTS = "wikipedia.org reddit.com facebook.com instagram.com linkedin.com x.com twitter.com stackoverflow.com stackexchange.com github.com medium.com quora.com wiktionary.org".split()
FREE_EMAIL_DOMAINS = "gmail.com googlemail.com yahoo.com outlook.com hotmail.com live.com aol.com icloud.com me.com protonmail.com".split()
GENERIC_EMAIL_PREFIXES = "info contact admin office hello membership national nationals headquarters hq ihq".split()
#: Parts of URLs that list organisations.
LISTING_MARKERS = ["studentorg", "student-org", "student-orgs", "organization", "organizations", "greek-life", "greeklife", "/greek/", "/orgs/", "/clubs/", "/chapter/", "/chapters/", "/fsl/"]
#: Base of a score by where a candidate comes from; DEFAULT for others.
WEBSITE_BASE, WEBSITE_DEFAULT = {"provenance": 0.72, "search_result": 0.82, "search_page": 0.86, "chapter_website": 0.9, "nationals_directory": 0.88}, 0.68
EMAIL_BASE, EMAIL_DEFAULT = {"provenance": 0.7, "chapter_website": 0.86, "nationals_directory": 0.84, "search_result": 0.68, "search_page": 0.8}, 0.65
HANDLE_BASE, HANDLE_DEFAULT = {"provenance": 0.8, "chapter_website": 0.9, "source_page": 0.85, "nationals_directory": 0.88, "instagram_probe": 0.84, "search_result": 0.8, "search_page": 0.82}, 0.68
#: Marks of source URLs.
POSITIVE_URL_MARKERS = "chapter chapters chapter-directory chapter-locator chapterlocator chapter-roll chapters-by-state find-a-chapter findachapter locate locate-chapter chapter-listing chapterlisting our-chapters active-chapters locations locator map campuses undergraduate undergraduates".split()
WEAK_URL_MARKERS = "alumni alumni-groups alumnigroups member members memberhub portal login account donate store shop merchandise".split()
GENERIC_PATH_MARKERS = "about history ideals mission values join news events careers contact staff board".split()
WEAK_HOST_MARKERS = ["dynamic.omegafi.com", "omegafi.com"]
#: Marks of search results about organisations.
DIRECTORY_MARKERS = "chapter-directory chapters chapter directory chapter-locator chapterlocator find-a-chapter findachapter locate locate-chapter chapter-listing chapterlisting locations locator chapter-roll chapters-by-state active-chapters campuses undergraduates our-chapters".split()
IDENTITY_DIRECTORY_MARKERS = ["chapter-directory", "chapters", "chapter list", "chapter", "directory", "find a chapter", "find-a-chapter", "findachapter", "locations", "locator", "chapter-roll", "our chapters", "active chapters", "colonies"]
GENERIC_SEGMENTS = "about history ideals mission values recruitment join news events careers contact staff board foundation housing merchandise giving".split()
CONTEXT_MARKERS = ["fraternity", "chapter", "chapters", "greek life", "brotherhood", "interfraternity", "ifc"]
IDENTITY_CONTEXT_MARKERS = ["fraternity", "chapter", "chapters", "colony", "colonies", "greek life", "interfraternity", "ifc", "brotherhood"]
OTHER_MARKERS = ["function", "programming", "software", "tutorial", "question", "forum", "how to", "travel", "vacation", "resort", "island", "hotel", "airline", "store", "shop", "merchandise"]
HOST_HINTS = {"phi-gamma-delta": ["phigam.org"], "sigma-chi": ["sigmachi.org"], "alpha-tau-omega": ["ato.org"], "pi-kappa-alpha": ["pikes.org", "pikapp.org"], "tau-kappa-epsilon": ["tke.org"], "kappa-sigma": ["kappasigma.org"], "theta-xi": ["thetaxi.org"]}
#: Source types of handles, other names of them.
SOURCE_TYPE_ALIASES = {
    "official_school": "official_school_chapter_page", "official_school_page": "official_school_chapter_page", "school_page": "official_school_chapter_page", "school_directory": "official_school_directory_row",
    "chapter_site": "verified_chapter_website", "chapter_website": "verified_chapter_website", "chapter_website_structured_data": "chapter_website_structured_data", "chapter_website_social_link": "chapter_website_social_link",
    "nationals": "nationals_chapter_page", "nationals_page": "nationals_chapter_page", "nationals_row": "nationals_directory_row", "national_directory_row": "nationals_directory_row",
    "search": "search_result_profile", "search_result": "search_result_profile", "instagram_search": "search_result_profile", "generated_handle": "generated_handle_search",
    "provenance": "provenance_supporting_page", "supporting_page": "provenance_supporting_page", "source_page": "provenance_supporting_page", "existing_db": "existing_db_value",
}

SOURCE_TYPES = ["existing_db_value", "provenance_supporting_page", "authoritative_bundle", "nationals_chapter_entry", "nationals_chapter_page", "nationals_directory_row", "official_school_chapter_page", "official_school_directory_row", "verified_chapter_website", "chapter_website_structured_data", "chapter_website_social_link", "search_result_profile", "generated_handle_search", "national_following_seed", "review_override"]

# ----------------------------------------------------------------------------------------------------------------------


def _hits(text: Column, words: list[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), text.contains)


def _if(c: Column, points: float) -> Column:
    return F.when(c, F.lit(float(points))).otherwise(0.0)


def _base(provider: Column, points: dict[str, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in points.items() for x in kv)), provider), F.lit(default))


def _bounded(x: Column, most: float) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(most), x)), 9)


def _full(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(u == "", u).when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))


def job_keywords(*names: Column) -> Column:
    """Distinct parts of three letters or more of the names' slugs, in order."""
    parts = F.flatten(F.array(*(F.split(F.coalesce(S.slugify(n), F.lit("")), "-") for n in names)))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 3))


def context_hits(keywords: Column, *texts: Column) -> Column:
    """Keywords that a text holds as parts."""
    low = F.lower(F.concat_ws(" ", *texts))
    return F.size(F.filter(keywords, low.contains))


def listing_url(url: Column) -> Column:
    return _any(F.lower(F.coalesce(url, F.lit(""))), LISTING_MARKERS)


def website_tier(url: Column, campus_domains: Column, source_url: Column) -> Column:
    """[D24] blocked, tier2 (link pages), tier1 (.edu, campus domains and the source's host, with hosts below) or unknown."""
    host, source = S.url_host(_full(url)), S.url_host(source_url)
    campus = F.exists(campus_domains, lambda d: (host == F.lower(d)) | host.endswith(F.concat(F.lit("."), F.lower(d))))
    own = (source != "") & ((host == source) | host.endswith(F.concat(F.lit("."), source)))
    return (
        F.when(host == "", "unknown").when(S.on_hosts(host, BLOCKED_WEBSITE_HOSTS), "blocked").when(S.on_hosts(host, TIER2_WEBSITE_HOSTS), "tier2")
        .when(host.endswith(".edu") | F.coalesce(campus, F.lit(False)) | F.coalesce(own, F.lit(False)), "tier1").otherwise("unknown")
    )


def website_score(url: Column, provider: Column, doc_url: Column, title: Column, text: Column, keywords: Column, campus_domains: Column, source_url: Column) -> Column:
    """[D24] Confidence of a website found in a document, 0 to 0.95."""
    tier, doc_tier = website_tier(url, campus_domains, source_url), website_tier(doc_url, campus_domains, source_url)
    low, host, doc_host = F.lower(F.coalesce(text, F.lit(""))), S.url_host(url), S.url_host(F.coalesce(doc_url, F.lit("")))
    listing, doc_listing, on_page = listing_url(url), listing_url(doc_url), provider == "search_page"
    apart = (host != "") & (host != doc_host)
    rows = (doc_tier == "tier1") & on_page & doc_listing
    score = (
        _base(provider, WEBSITE_BASE, WEBSITE_DEFAULT) + _if(low.contains("website") | low.contains("official"), 0.08) + _if(tier == "tier1", 0.08) + _if(doc_tier == "tier1", 0.08)
        + _if(on_page & (doc_host != "") & apart, 0.05) + _if(rows, 0.08) + _if(rows & apart & ~listing, 0.08) - _if(listing, 0.18) - _if(listing & (provider == "search_result"), 0.12)
    )
    score = F.when(tier == "tier2", F.least(score - 0.08, F.lit(0.78))).otherwise(score)
    return F.when(tier == "blocked", 0.0).otherwise(_bounded(score + 0.03 * context_hits(keywords, url, title, F.substring(text, 1, 200)), 0.95))


def email_score(email: Column, provider: Column, doc_url: Column, title: Column, text: Column, keywords: Column, doc_tier: Column, looks: Mail, *, mailto: Column, obfuscated: Column) -> Column:
    """[D22] Confidence of an address found in a document, 0 to 0.95. looks: of ``organisations.mail_facts``."""
    local, domain = F.lower(F.substring_index(email, "@", 1)), F.lower(F.substring_index(email, "@", -1))
    searched = F.coalesce(provider.isin("search_result", "search_page"), F.lit(False))
    score = (
        _base(provider, EMAIL_BASE, EMAIL_DEFAULT) + _if(mailto, 0.05) - _if(obfuscated, 0.04) + 0.02 * context_hits(keywords, email, title, F.substring(text, 1, 200)) + 0.025 * F.least(F.lit(6), looks.overlap)
        + _if(doc_tier == "tier1", 0.05) - _if(doc_tier == "blocked", 0.25) + _if(_any(F.lower(F.coalesce(doc_url, F.lit(""))), ["contact", "officer", "leadership", "board", "about", "staff"]), 0.03)
        - _if(local.isin(GENERIC_EMAIL_PREFIXES), 0.08) + _if(domain.endswith(".edu"), 0.05) + _if(looks.known_domain, 0.04) - _if(domain.isin(FREE_EMAIL_DOMAINS) & searched, 0.08)
        - _if(searched & ~looks.identity, 0.12) - _if(looks.office & searched, 0.08) - _if(looks.person & ~looks.identity, 0.16) - _if(looks.low_signal, 0.2) + _if(looks.contact_page, 0.03) - _if(~looks.relevant, 0.24)
    )
    return _bounded(score, 0.95)


def handle_match(handle: Column, fraternity: Column, aliases: Column, school: Column, chapter: Column) -> Column:
    """[D23] 0 to 5 points for the names that a handle holds."""
    h = S.compact_key(handle)
    holds = lambda x, least: (F.length(x) >= least) & h.contains(x)
    f = F.when(holds(S.compact_key(fraternity), 1) | F.exists(aliases, lambda a: holds(S.compact_key(a), 3)), 2).when(holds(S.initials(fraternity), 3), 1).otherwise(0)
    s = F.when(holds(S.initials(school), 3), 2).when(F.exists(F.split(F.lower(school), "[^a-z0-9]+"), lambda t: holds(t, 5)), 1).otherwise(0)
    c = F.when(holds(S.compact_key(chapter), 4) | holds(S.initials(chapter), 2), 1).otherwise(0)
    return f + s + c


def handle_score(url: Column, provider: Column, title: Column, text: Column, query: Column, keywords: Column, *, direct: Column, match: Column, overlap: Column, generic: Column, relevant: Column) -> Column:
    """[D23] Confidence of an Instagram profile found in a document, 0 to 0.95."""
    score = (
        _base(provider, HANDLE_BASE, HANDLE_DEFAULT) + _if(direct, 0.04) + 0.02 * context_hits(keywords, url, title, F.substring(text, 1, 200)) + 0.03 * F.least(match, F.lit(5)) + 0.025 * F.least(overlap, F.lit(6))
        + _if(F.lower(F.coalesce(query, F.lit(""))).contains("site:instagram.com"), 0.03) - _if(generic, 0.1) - _if(~relevant, 0.24)
    )
    return _bounded(score, 0.95)


def source_identity(url: Column, title: Column, snippet: Column, name: Column, slug: Column) -> Column:
    """[D16] struct of decision (match, weak_match, reject), confidence and reason."""
    host, path = S.url_host(url), F.lower(S.url_path(url))
    parts = [F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(snippet, F.lit(""))), host, path]
    text = F.concat_ws(" ", *parts)
    plain = F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))
    wanted = S.compact_key(name)
    phrase = (wanted != "") & F.exists(F.array(*map(S.compact_key, parts)), lambda p: p.contains(wanted))
    tokens = F.size(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: (t != "") & S.compact_key(host).contains(t)))
    directory, context = _any(F.concat_ws(" ", parts[0], parts[1], path), IDENTITY_DIRECTORY_MARKERS), _hits(plain, IDENTITY_CONTEXT_MARKERS)
    segments = F.filter(F.split(path, "/"), lambda p: p != "")
    generic = (F.size(segments) == 1) & F.get(segments, F.lit(0)).isin(GENERIC_SEGMENTS) & ~directory
    score = (
        0.18 + _if(phrase, 0.3) + _if((slug != "") & S.compact_key(F.concat(host, path)).contains(F.replace(slug, F.lit("-"), F.lit(""))), 0.18) + F.when(tokens >= 2, 0.14).when(tokens == 1, 0.08).otherwise(0.0)
        + _if(directory, 0.16) + F.when(context >= 2, 0.12).when(context == 1, 0.06).otherwise(0.0) - _if(F.size(segments) == 0, 0.05) - _if(generic, 0.18)
    )
    made = lambda d, c, r: F.struct(F.lit(d).alias("decision"), (c if isinstance(c, Column) else F.lit(float(c))).alias("confidence"), F.lit(r).alias("reason"))
    sure = _bounded(score, 0.99)
    return (
        F.when(host == "", made("reject", 0, "missing_host"))
        .when(S.on_hosts(host, BLOCKED_SOURCE_HOSTS), made("reject", 0, "blocked_host"))
        .when(names_another(name, slug, title, snippet, host, path), made("reject", 0.05, "cross_fraternity_conflict"))
        .when(_any(plain, OTHER_MARKERS) & (context == 0), made("reject", _bounded(score, 0.2), "non_org_context"))
        .when(sure >= 0.72, made("match", F.bround(sure, 4), "identity"))
        .when(sure >= 0.48, made("weak_match", F.bround(sure, 4), "identity"))
        .otherwise(made("reject", F.bround(sure, 4), "low_identity_confidence"))
    )


def discovery_score(url: Column, title: Column, snippet: Column, rank: Column, name: Column, slug: Column, guard: Column) -> Column:
    """[D15] Confidence of a search result as an organisation's source, 0 to 0.99. guard: of ``source_identity``."""
    t, s = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(snippet, F.lit("")))
    host, path = S.url_host(url), F.lower(S.url_path(url))
    text, wanted, joined = F.concat_ws(" ", t, s, path), S.compact_key(name), S.compact_key(host)
    hints = F.coalesce(*(F.when(slug == k, S.on_hosts(host, v)) for k, v in HOST_HINTS.items()), F.lit(False))
    tokens = F.size(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: (x != "") & joined.contains(x)))
    segments = F.filter(F.split(path, "/"), lambda p: p != "")
    generic = (F.size(segments) == 1) & F.get(segments, F.lit(0)).isin(GENERIC_SEGMENTS)
    context = _hits(text, CONTEXT_MARKERS)
    score = (
        0.36 + _if((wanted != "") & S.compact_key(t).contains(wanted), 0.2) + _if((wanted != "") & S.compact_key(s).contains(wanted), 0.1) + _if((wanted != "") & joined.contains(wanted), 0.16) + _if(hints, 0.35)
        + F.when(tokens >= 2, 0.12).when(tokens == 1, 0.06).otherwise(0.0) + F.when(_any(path, DIRECTORY_MARKERS), 0.12).when(generic, -0.18).otherwise(0.0)
        + _if(_any(t, ["official", "international", "fraternity"]), 0.08) + _if(_any(s, ["official", "chapter", "directory", "fraternity"]), 0.06) - _if(text.contains("alumni"), 0.3) - _if(path.endswith(".pdf"), 0.25)
        + F.when(context == 0, -0.2).when(context >= 2, 0.08).otherwise(0.0) - _if(_any(text, OTHER_MARKERS) & (context == 0), 0.18) - _if(_any(text, ["travel", "vacation", "resort", "island"]) & (context == 0), 0.2)
    )
    score = F.when(guard["decision"] == "match", score + 0.12).when(guard["decision"] == "weak_match", score + 0.02).otherwise(F.least(score, F.lit(0.25)))
    score = F.when(guard["reason"] == "cross_fraternity_conflict", 0.0).otherwise(score) - _if(guard["reason"] == "blocked_host", 0.45)
    return _bounded(score + F.greatest(F.lit(0.0), 0.08 - (F.greatest(rank, F.lit(1)) - 1) * 0.01), 0.99)


def source_quality(url: Column) -> Column:
    """[C38] struct of score (0 to 1), is_weak, is_blocked and reasons of a source's URL."""
    host = F.regexp_replace(S.url_host(url), ":[0-9]*$", "")
    path = S.url_path(url)
    at, bare = F.lower(F.concat(host, F.when(path == "", "/").otherwise(path))), F.regexp_replace(path, "/+$", "")
    found = lambda words, test: F.filter(F.array(*map(F.lit, words)), test)
    positive, weak, poor = found(POSITIVE_URL_MARKERS, at.contains), found(WEAK_URL_MARKERS, at.contains), found(WEAK_HOST_MARKERS, host.contains)
    generic = F.when(F.size(positive) == 0, found(GENERIC_PATH_MARKERS, lambda m: bare.endswith(F.concat(F.lit("/"), m)))).otherwise(F.slice(weak, 1, 0))
    blocked = S.on_hosts(host, BLOCKED_SOURCE_HOSTS)
    depth = F.size(F.filter(F.split(bare, "/"), lambda p: p != ""))
    named = lambda prefix, xs: F.transform(xs, lambda x: F.concat(F.lit(prefix), x))
    score = 0.55 - _if(blocked, 0.7) + F.least(F.lit(0.35), F.size(positive) * 0.08) - F.least(F.lit(0.75), F.size(weak) * 0.24) - F.least(F.lit(0.4), F.size(generic) * 0.16) - F.least(F.lit(0.7), F.size(poor) * 0.3) + F.when(depth == 0, -0.12).when(depth >= 2, 0.06).otherwise(0.0)
    sure = _bounded(score, 1.0)
    reasons = F.concat(
        F.array_compact(F.array(F.when(blocked, "blocked_host"))), named("positive:", positive), named("weak:", weak), named("generic_info:", generic), named("weak_host:", poor),
        F.array_compact(F.array(F.when(depth == 0, "generic_root_path").when(depth >= 2, "deeper_path"))),
    )
    made = lambda score, weak, blocked, why: F.struct(score.alias("score"), weak.alias("is_weak"), blocked.alias("is_blocked"), why.alias("reasons"))
    missing, invalid = (made(F.lit(0.0), F.lit(True), F.lit(False), F.array(F.lit(r))) for r in ("missing_url", "invalid_url"))
    is_weak = blocked | (sure < 0.45) | (F.size(weak) > 0) | (F.size(poor) > 0)
    return F.when(F.coalesce(url, F.lit("")) == "", missing).when(host == "", invalid).otherwise(made(sure, is_weak, blocked, reasons))


def official_directory(quality: Column) -> Column:
    """Whether a URL of this quality looks like an official directory."""
    return ~quality["is_blocked"] & ~quality["is_weak"] & F.exists(quality["reasons"], lambda r: r.startswith("positive:") | (r == "deeper_path"))


def promotion(source: Column, school: Column, contact: Column, official_source: Column, source_class: Column) -> Column:
    """[D39] Whether a provisional chapter is promoted: with a source, a school, and a contact or official evidence."""
    official = F.coalesce(official_source, F.lit(False)) & F.coalesce(F.trim(source_class).isin("national", "institutional"), F.lit(False))
    return source.isNotNull() & S.blank_to_null(school).isNotNull() & (F.coalesce(contact, F.lit(False)) | official)


def source_type(named: Column, specificity: Column, scope: Column, url: Column, provider: Column, query: Column) -> Column:
    """The source type of a handle's evidence: by its own name for it, else by its page and how it was found."""
    low = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    n, kind, page, at = low(named), low(specificity), low(scope), low(url)
    return (
        F.when(n.isin(SOURCE_TYPES), n)
        .when(n.isin([*SOURCE_TYPE_ALIASES]), F.try_element_at(F.create_map(*(F.lit(x) for kv in SOURCE_TYPE_ALIASES.items() for x in kv)), n))
        .when((kind == "school_specific") | page.startswith("school") | at.contains(".edu"), "official_school_chapter_page")
        .when((kind == "national_specific_to_chapter") | page.contains("nation") | _any(at, ["chapter-directory", "find-a-chapter", "/chapters"]), "nationals_chapter_page")
        .when((kind == "chapter_specific") | _any(page, ["chapter_website", "chapter_site"]), "verified_chapter_website")
        .when(at.contains("instagram.com/") | (low(provider) != "") | (low(query) != ""), "search_result_profile")
        .when(at != "", "provenance_supporting_page")
        .otherwise("search_result_profile")
    )
