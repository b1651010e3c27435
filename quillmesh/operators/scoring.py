"""Scores and decisions of the domain as Column expressions and DataFrame operators.

Weights and thresholds are fixed values. Names in brackets are the survey's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.operators import organisations as O
from quillmesh.operators.candidates import BLOCKED_SOURCE_HOSTS, source_quality


def when_sum(*terms: tuple[Column, float]) -> Column:
    return sum((F.when(c, float(w)).otherwise(0.0) for c, w in terms), F.lit(0.0))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


# Pages ---------------------------------------------------------------------------------------------------------------


def source_class(p: Column, llm: bool = False) -> Column:
    """[D02] struct of page_type, confidence, strategy and follow_links from a page profile (see pages.PROFILE)."""
    made = lambda kind, conf, strategy, follow=False: F.struct(F.lit(kind).alias("page_type"), (conf if isinstance(conf, Column) else F.lit(float(conf))).alias("confidence"), F.lit(strategy).alias("strategy"), F.lit(follow).alias("follow_links"))
    directory = p["role"] == "directory"
    return (
        F.when(p["has_json_ld"], made("script_embedded_data", 0.9, "script_json"))
        .when(p["has_script_json"], made("script_embedded_data", 0.8, "script_json"))
        .when(p["has_map"], made("locator_map", 0.8, "locator_api"))
        .when((p["tables"] > 0) & directory, made("static_directory", 0.9, "table"))
        .when((p["repeated"] >= 1) & directory, made("static_directory", F.when(p["repeated"] >= 2, 0.85).otherwise(0.7), "repeated_block"))
        .when(directory & (p["links"] >= 10), made("static_directory", 0.65, "repeated_block", True))
        .otherwise(made("unsupported_or_unclear", 0.25 if llm else 0.0, "llm" if llm else "review"))
    )


def extraction_plan(p: Column, c: Column, embedded: Column, api_url: Column, llm: bool = False) -> Column:
    """[D03] struct of primary and fallbacks from profile, class, whether data is embedded, and an API's URL."""
    made = lambda first, *rest: F.struct((first if isinstance(first, Column) else F.lit(first)).alias("primary"), F.array_compact(F.array(*(r if isinstance(r, Column) else F.lit(r) for r in rest), F.lit(None).cast("string"))).alias("fallbacks"))
    table, other = F.when(p["tables"] > 0, "table").otherwise("repeated_block"), F.when(p["tables"] > 0, "repeated_block").otherwise("table")
    static = c["page_type"] == "static_directory"
    return (
        F.when(static & (c["confidence"] >= 0.75), made(table, other, F.when(embedded, "script_json"), "review"))
        .when(embedded & api_url.isNotNull(), made("locator_api", "script_json", "review"))
        .when(embedded, made("script_json", "review"))
        .when(static, made(table, other, "review"))
        .when(c["confidence"] >= 0.75, made(c["strategy"], "review"))
        .when(F.lit(llm) & (c["strategy"] == "llm"), made("llm", "review"))
        .otherwise(made("review"))
    )


def layout(p: Column) -> Column:
    """[D04] struct of layout and confidence."""
    made = lambda kind, conf: F.struct(F.lit(kind).alias("layout"), F.lit(conf).alias("confidence"))
    return F.when(p["tables"] > 0, made("table", 0.92)).when((p["cards"] >= 1) & (p["repeated"] >= 2), made("mixed_cards", 0.9)).when(p["cards"] >= 2, made("explicit_cards", 0.88)).when(p["anchors"] >= 2, made("anchor_cards", 0.86)).when(p["links"] >= 6, made("linked_list", 0.78)).when(p["repeated"] >= 2, made("repeated_blocks", 0.72)).otherwise(made("unclear", 0.2))


def index_mode(p: Column, page_type: Column, html: Column, api_url: Column, override: Column) -> Column:
    """[D44] struct of mode, confidence and reason of a page that lists chapters, from its profile, class and text."""
    low = F.lower(html)
    gated = F.exists(F.array(*map(F.lit, ["member portal", "member login", "sign in to view", "directory login"])), low.contains)
    made = lambda m, c, r: F.struct((m if isinstance(m, Column) else F.lit(m)).alias("mode"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    return (
        F.when(F.coalesce(override, F.lit("")) != "", made(override, 0.98, "source_metadata_override"))
        .when(gated, made("member_portal_gated", 0.9, "member_portal_keywords"))
        .when((page_type == "locator_map") | api_url.isNotNull(), made("map_or_api_locator", 0.9, "locator_or_api_hint"))
        .when((p["tables"] > 0) | (p["repeated"] >= 2), made("direct_chapter_list", 0.85, "table_or_repeated_blocks"))
        .when((p["role"] == "directory") & (p["links"] >= 12), made("internal_detail_pages", 0.7, "directory_with_many_links"))
        .when(p["role"].isin("directory", "index"), made("mixed", 0.55, "mixed_directory_indicators"))
        .otherwise(made("mixed", 0.35, "fallback_mixed"))
    )


def frontier_score(url: Column, anchor: Column, depth: Column, source_url: Column, has_map: Column, repeated: Column, template_bonus: Column, parent_bonus: Column, selected: Column) -> Column:
    """[D06] struct of score and components."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = {
        "same_host": F.when(S.url_host(url) == S.url_host(source_url), 1.0).otherwise(-3.0),
        "keyword": S.keyword_score(F.concat_ws(" ", S.url_path(url), query, anchor)),
        "map_bonus": F.when(has_map, 0.6).otherwise(0.0),
        "repeated_bonus": F.least(repeated, F.lit(4)) * 0.15,
        "template_bonus": template_bonus.cast("double"),
        "parent_success_bonus": parent_bonus.cast("double"),
        "depth_penalty": depth * -0.45,
        "duplicate_penalty": selected * -0.8,
    }
    return F.struct(F.bround(sum(parts.values(), F.lit(0.0)), 4).alias("score"), F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v))).alias("components"))


LABEL_UP = ["go to site", "chapter website", "find a chapter", "our chapters", "chapter directory", "chapter roll", "chapter map", "chapter profile"]
LABEL_DOWN = ["news", "blog", "resource", "toolkit", "award", "staff directory", "member directory"]
URL_UP = ["chapters", "chapter-directory", "find-a-chapter", "chapter-roll", "chapter", "directory"]
URL_DOWN = ["news", "blog", "resource", "toolkit", "award", "staff"]


def chapter_link_score(label: Column, url: Column, context: Column) -> Column:
    """[D07] struct of score (0 to 1) and reasons."""
    low, u, ctx = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (label, url, context))
    path = S.url_path(u)
    one = lambda words, prefix: F.coalesce(*(F.when(path.contains(w), F.lit(prefix + w)) for w in words))
    up, down = one(URL_UP, "url:"), one(URL_DOWN, "url:")
    near = ctx.rlike("chapter|university|college")
    social = u.rlike(r"instagram\.com|facebook\.com|x\.com")
    score = when_sum(*((low.contains(w), 0.5) for w in LABEL_UP), *((low.contains(w), -0.6) for w in LABEL_DOWN), (up.isNotNull(), 0.25), (down.isNotNull(), -0.35), (near, 0.2), (social, -0.2))
    reasons = F.array_compact(F.array(*(F.when(low.contains(w), "label:" + w) for w in LABEL_UP + LABEL_DOWN), up, down, F.when(near, "context:chapter_or_school"), F.when(social, "social_profile_url")))
    contact = u.rlike("^(mailto|tel):")
    return F.struct(F.when(contact, 0.0).otherwise(F.round(clamp(score), 6)).alias("score"), F.when(contact, F.array(F.lit("contact_scheme_not_chapter_link"))).otherwise(reasons).alias("reasons"))


# Adaptive crawl ------------------------------------------------------------------------------------------------------

def immediate_reward(chapters: Column, websites: Column, instagrams: Column, emails: Column, links: Column, timeout: Column, review: Column, valid_missing: Column, verified: Column) -> Column:
    """[D11]"""
    contacts = websites + instagrams + emails
    return F.bround(
        when_sum((timeout, -3.0), ((chapters == 0) & (valid_missing <= 0), -2.0), (review, -0.5))
        + chapters * 5.0 + websites * 2.0 + instagrams * 2.0 + emails * 3.0
        + F.when((chapters > 0) & (contacts == 0), chapters * 1.0).otherwise(0.0)
        + F.greatest(verified, F.lit(0)) * 1.5 + F.greatest(valid_missing, F.lit(0)) * 0.35 + F.least(links, F.lit(6)) * 0.25,
        4,
    )


def terminal_reward(status: Column, stop_reason: Column, efficiency: Column, upserted: Column, canonical: Column, provisional: Column, inline: Column, invalid: Column, repairable: Column, reviews: Column, saturated: Column) -> Column:
    """[D12]"""
    capped = lambda c, n, w: F.least(F.greatest(c, F.lit(0)), F.lit(n)) * w
    flat = when_sum((status == "succeeded", 1.0), (status == "failed", -1.5), (stop_reason.isin("frontier_empty", "seed_frontier_empty"), 0.25), (stop_reason == "page_budget_exhausted", -0.4), (saturated & (canonical == 0), -0.75), ((upserted == 0) & (reviews > 0), -0.25))
    return F.bround(clamp(efficiency, -1.0, 1.0) * 2.0 + flat + capped(canonical, 6, 0.75) + capped(inline, 6, 0.4) + capped(provisional, 4, 0.2) + capped(invalid, 8, 0.08) + capped(repairable, 8, 0.04) - capped(reviews, 12, 0.08), 4)


def stop_reason(pages: Column, max_pages: Column, frontier: Column, empty: Column, max_empty: Column, records: Column, high: Column, low_streak: Column, saturation: Column, score: Column, least: Column) -> Column:
    """[D13] The first reason to stop, or null."""
    return (
        F.when((max_pages > 0) & (pages >= max_pages), "page_budget_exhausted")
        .when(frontier <= 0, "frontier_empty")
        .when((max_empty > 0) & (empty >= max_empty), "empty_streak_exhausted")
        .when((high > 0) & (records >= high) & (pages >= 2) & (low_streak >= 1), "high_yield_saturated")
        .when((saturation > 0) & (low_streak >= saturation), "saturation_reached")
        .when(score < least, "min_score_floor")
    )


def delayed_credit(observations: DataFrame, rewards: DataFrame, gamma: float = 0.8, hops: int = 4) -> DataFrame:
    """[W10] Credit of each reward for its observation's ancestors: reward x gamma^hop, zeros dropped.

    observations: id, parent_id, selected_action; rewards: id, reward_value, attributed_id. Hops are bounded joins.
    """
    step = observations.select(F.col("id").alias("at"), F.col("parent_id").alias("up"))
    walk = rewards.select(F.col("id").alias("reward_id"), "reward_value", F.col("attributed_id").alias("at"))
    parts = []
    for hop in range(1, hops + 1):
        walk = walk.join(step, "at").where("up is not null").select("reward_id", "reward_value", F.col("up").alias("at"))
        parts.append(walk.select("reward_id", "at", F.lit(hop).alias("hop"), F.bround(F.col("reward_value") * min(max(gamma, 0.0), 1.0) ** hop, 4).alias("credit")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("credit <> 0").join(observations.select(F.col("id").alias("at"), "selected_action"), "at")


def replayed_policy(snapshot: DataFrame, rewards: DataFrame) -> DataFrame:
    """[D14] A policy snapshot (action, n, mean) with the count and discounted sum of more rewards merged in."""
    new = rewards.groupBy(F.col("action_type").alias("action")).agg(F.count("*").alias("k"), F.sum(F.col("reward_value") * F.col("discount_factor")).alias("s"))
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    total = F.coalesce(F.col("mean") * F.col("n"), F.lit(0.0)) + F.coalesce("s", F.lit(0.0))
    return snapshot.join(new, "action", "full_outer").select("action", (n + k).alias("n"), S.safe_ratio(total, n + k).alias("mean"))


# Candidates ----------------------------------------------------------------------------------------------------------

#: Fixed values.
SOURCE_PRIORS = {
    "official_school_chapter_page": 0.97, "official_school_directory_row": 0.97, "verified_chapter_website": 0.95, "chapter_website_structured_data": 0.92, "chapter_website_social_link": 0.92,
    "nationals_directory_row": 0.93, "nationals_chapter_entry": 0.93, "nationals_chapter_page": 0.92, "authoritative_bundle": 0.95, "provenance_supporting_page": 0.9, "search_result_profile": 0.72,
    "generated_handle_search": 0.6, "existing_db_value": 0.5, "national_following_seed": 0.35, "review_override": 1.0,
}
NEGATIVE_MARKERS = ["hq", "national", "international", "foundation", "ifc", "panhellenic", "greeklife", "greek_life", "fsl", "office", "alumni"]
WRITE_THRESHOLDS = {
    "official_school_chapter_page": 0.88, "official_school_directory_row": 0.88, "verified_chapter_website": 0.88, "chapter_website_structured_data": 0.88, "chapter_website_social_link": 0.88, "authoritative_bundle": 0.88,
    "provenance_supporting_page": 0.84, "nationals_directory_row": 0.9, "nationals_chapter_entry": 0.9, "nationals_chapter_page": 0.9, "search_result_profile": 0.94, "generated_handle_search": 0.94,
}


def overlap(tokens: Column, wanted: Column) -> Column:
    """[U-E] Share of wanted tokens (at least one) that are among tokens."""
    return S.safe_ratio(F.size(F.array_intersect(tokens, wanted)).cast("double"), F.least(F.size(wanted), F.lit(2)).cast("double"))


def instagram_score(handle: Column, text: Column, source: Column, specificity: Column, fraternity: Column, school: Column, chapter: Column, taken: Column) -> Column:
    """[D25] struct of score and rejects: eight weighted features; any reject makes the score 0."""
    low = F.lower(F.concat_ws(" ", handle, text))
    tokens = F.array_distinct(F.split(low, "[^a-z0-9]+"))
    compacts = lambda wanted: F.exists(wanted, lambda w: (F.length(w) >= 4) & F.replace(low, F.lit(" "), F.lit("")).contains(w)).cast("double")
    f, s, c = (clamp(F.greatest(overlap(tokens, w), compacts(w) * 0.9)) for w in (fraternity, school, chapter))
    trust = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SOURCE_PRIORS.items() for x in kv)), source), F.lit(0.5))
    pattern = F.when((f > 0) & ((s > 0) | (c > 0)), 1.0).when(f > 0, 0.5).otherwise(0.0)
    local = F.when(specificity.isin("chapter_specific", "school_specific", "national_specific_to_chapter"), 1.0).otherwise(0.4)
    open_source = source.isin("search_result_profile", "generated_handle_search", "existing_db_value")
    rejects = F.array_compact(F.array(*(F.when(low.contains(m), "marker:" + m) for m in NEGATIVE_MARKERS), F.when(taken, "cross_chapter_reuse"), F.when(source == "generated_handle_search", "generated_without_confirmation"), F.when(open_source & (s <= 0) & (c <= 0), "wrong_school"), F.when(open_source & (f <= 0), "wrong_fraternity")))
    score = F.bround(clamp(trust * 0.35 + f * 0.2 + s * 0.16 + c * 0.08 + pattern * 0.08 + clamp((f + s + c) / 2) * 0.06 + local * 0.04 + F.when(taken, 0.0).otherwise(1.0) * 0.03), 4)
    return F.struct(F.when(F.size(rejects) > 0, 0.0).otherwise(score).alias("score"), rejects.alias("rejects"))


def resolution(score: Column, source: Column) -> Column:
    """[D26] write, review or reject by the source's threshold."""
    least = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WRITE_THRESHOLDS.items() for x in kv)), source), F.lit(0.9))
    return F.when(score >= least, "write").when(score >= 0.82, "review").otherwise("reject")


def kept(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed where the session names a shared folder, else persisted."""
    spark = df.sparkSession
    if path := spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return df.checkpoint()
    return df.persist()


def exclusive_best(candidates: DataFrame) -> DataFrame:
    """[D27] One candidate per chapter and one chapter per handle: chapters take their best free handle, lowest id first.

    candidates: chapter_id, handle, score. Losers of a round try again without the handles and chapters that are settled,
    until a round settles nobody. A round settles a chapter for each handle that is wanted, so rounds are as many as the
    longest chain of chapters that lose to each other.
    """
    free = candidates.groupBy("chapter_id", "handle").agg(F.max("score").alias("score"))
    settled = free.limit(0)
    best = Window.partitionBy("chapter_id").orderBy(F.col("score").desc(), "handle")
    while True:
        first = free.withColumn("r", F.row_number().over(best)).where("r = 1").groupBy("handle").agg(F.min(F.struct("chapter_id", "score")).alias("x"))
        picks = kept(first.select("x.chapter_id", "handle", "x.score"))
        if picks.isEmpty():
            return settled
        settled = settled.unionByName(picks)
        free = kept(free.join(picks.select("chapter_id"), "chapter_id", "left_anti").join(picks.select("handle"), "handle", "left_anti").select("chapter_id", "handle", "score"))


def official_domain(identity: Column, slug: Column, chapter_hits: Column, school_hits: Column, affiliation_hits: Column, specific: Column, edu: Column, directory: Column, generic: Column, rejected: Column) -> Column:
    """[D17] struct of decision and confidence."""
    cap = lambda n, most, w: F.least(F.lit(most), n * w)
    score = 0.22 + when_sum((identity, 0.24), (slug, 0.14), (specific, 0.18), (edu, 0.08), (~edu & ~directory, 0.06), (generic, -0.2)) + cap(chapter_hits, 0.18, 0.08) + cap(school_hits, 0.16, 0.08) + cap(affiliation_hits, 0.16, 0.05)
    score = F.round(clamp(score), 4)
    return F.struct(F.when(rejected, "reject").when(~edu & (score >= 0.76), "official").when(edu & (score >= 0.72), "affiliation").when(score >= 0.54, "weak").otherwise("reject").alias("decision"), F.when(rejected, 0.0).otherwise(score).alias("confidence"))


def site_scope(url: Column, text: Column) -> Column:
    """[D18] struct of scope and confidence."""
    low, edu = F.lower(text), S.url_host(url).endswith(".edu")
    made = lambda s, c: F.struct(F.lit(s).alias("scope"), F.lit(c).alias("confidence"))
    return F.when(edu & low.rlike("recognized|fraternit"), made("school_affiliation_page", 0.88)).when(edu, made("school_affiliation_page", 0.7)).when(low.contains("chapter") & low.rlike("rush|recruit|brothers|officers"), made("chapter_site", 0.82)).when(low.contains("national") & low.contains("chapters"), made("nationals_generic", 0.78)).when(low.contains("national"), made("nationals_generic", 0.58)).otherwise(made("other", 0.35))


def greek_policy(official: Column, text: Column) -> Column:
    """[D19] struct of policy and confidence: banned, allowed or unknown."""
    low = F.lower(text)
    strong, soft = low.rlike("does not (permit|allow|recognize)|prohibit|banned|not permitted"), low.rlike("fraternit|sororit|greek")
    current, past = low.rlike("current(ly)? recognized|recognized (chapters|organizations)|active chapters"), low.rlike("former|historical|archive")
    made = lambda p, c: F.struct(F.lit(p).alias("policy"), F.lit(c).alias("confidence"))
    return F.when(~official, made("unknown", 0.0)).when(strong & soft, made("banned", 0.97)).when(current & ~past, made("allowed", 0.9)).otherwise(made("unknown", 0.28))


def roster_verdict(official: Column, on_roster: Column, organisations: Column, historical: Column, article: Column) -> Column:
    """[D20] struct of verdict and confidence."""
    made = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("confidence"))
    return F.when(historical, made("unknown", 0.15)).when(article, made("unknown", 0.2)).when(official & on_roster, made("confirmed_active", 0.93)).when(official & (organisations >= 3), made("confirmed_inactive", 0.9)).otherwise(made("unknown", 0.3))


# Status --------------------------------------------------------------------------------------------------------------

POSITIVE_ZONES = ["recognized", "active", "probation"]
NEGATIVE_ZONES = ["suspended", "closed", "dismissed", "expelled", "unrecognized"]


def campus_source(url: Column, title: Column, text: Column, official: Column) -> Column:
    """[D29] struct of source_type, authority_tier, currentness and completeness."""
    low = F.lower(F.concat_ws(" ", title, url, text))
    made = lambda t, tier, cur, comp: F.struct(F.lit(t).alias("source_type"), F.when(official, tier).otherwise(F.greatest(F.lit(tier), F.lit(5))).alias("authority_tier"), F.when(official, cur).otherwise(F.least(F.lit(cur), F.lit(0.55))).alias("currentness"), F.when(official, comp).otherwise(F.least(F.lit(comp), F.lit(0.65))).alias("completeness"))
    return (
        F.when(low.rlike("does not (permit|recognize) (fraternit|greek)|no greek"), made("no_greek_policy", 0, 0.95, 0.9))
        .when(low.rlike("chapter status|recognized chapters|chapter roster|our chapters"), made("status_page", 1, 0.9, 0.9))
        .when(low.rlike("loss of recognition|suspended (chapters|organizations)"), made("suspended_page", 2, 0.85, 0.8))
        .when(low.rlike("registered student organization"), made("rso_directory", 3, 0.75, 0.7))
        .when(low.rlike("conduct|hazing"), made("conduct_page", 4, 0.7, 0.6))
        .when(low.rlike("news|article"), made("article", 5, 0.5, 0.4))
        .otherwise(made("unknown", 7, 0.4, 0.3))
    )


def best_zone(matches: DataFrame) -> DataFrame:
    """[D31] The best-scored zone of each chapter and sign; the earliest of equals.

    matches: chapter_id, zone_type, zone_order, authority_tier, currentness, zone_confidence, match_confidence.
    """
    score = 1.1 - F.col("authority_tier") * 0.08 + (F.col("currentness") + F.col("zone_confidence") + F.col("match_confidence")) * 0.5
    df = matches.withColumn("positive", F.when(F.col("zone_type").isin(POSITIVE_ZONES), True).when(F.col("zone_type").isin(NEGATIVE_ZONES), False)).where("positive is not null").withColumn("zone_score", F.round(score, 9))
    order = Window.partitionBy("chapter_id", "positive").orderBy(F.col("zone_score").desc(), "zone_order")
    return df.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def chapter_status(chapters: DataFrame, matches: DataFrame) -> DataFrame:
    """[D32] chapter_id, final_status, reason_code and confidence.

    chapters: chapter_id, banned (policy), absent (conclusive roster without it), national (status or null) and
    national_confidence; matches as for best_zone.
    """
    best = best_zone(matches)
    rank = F.round(F.col("currentness") + 1.0 - F.col("authority_tier") * 0.1, 9)
    conf = F.greatest("match_confidence", "zone_confidence")
    side = lambda sign, p: best.where(F.col("positive") == sign).select("chapter_id", rank.alias(f"{p}_rank"), conf.alias(f"{p}_conf"))
    df = chapters.join(side(True, "pos"), "chapter_id", "left").join(side(False, "neg"), "chapter_id", "left")
    pos, neg = F.col("pos_rank").isNotNull(), F.col("neg_rank").isNotNull()
    active = pos & (~neg | (F.col("pos_rank") >= F.col("neg_rank")))
    gone = F.col("national").isin("inactive", "dormant", "closed")
    made = lambda s, r, c: F.struct(F.lit(s).alias("final_status"), F.lit(r).alias("reason_code"), c.cast("double").alias("confidence"))
    d = (
        F.when(F.col("banned"), made("inactive", "official_school_policy_prohibits_fraternities", F.lit(0.98)))
        .when(active, made("active", "official_school_current_recognition", F.least(F.lit(0.97), F.col("pos_conf"))))
        .when(neg, made("inactive", "official_school_negative_status", F.least(F.lit(0.98), F.col("neg_conf"))))
        .when(F.col("absent"), made("inactive", "absent_from_conclusive_roster", F.lit(0.9)))
        .when(gone, made("review", "national_all_status_directory_inactive_school_unknown", F.least(F.lit(0.82), F.col("national_confidence"))))
        .otherwise(made("unknown", "no_conclusive_school_status_evidence", F.lit(0.3)))
    )
    flags = F.array_compact(F.array(F.when(pos & gone, "school_active_national_inactive_conflict"), F.when(neg & (F.col("national") == "active"), "school_inactive_national_active_conflict"), F.when(pos & neg, "stale_source_conflict")))
    return df.select("chapter_id", d.alias("d"), flags.alias("conflict_flags")).select("chapter_id", "d.*", "conflict_flags")


def roster_conclusive(tier: Column, currentness: Column, completeness: Column, zones: Column, greek_hits: Column, recognition: Column) -> Column:
    """[D33]"""
    return (tier <= 2) & (currentness >= 0.70) & (completeness >= 0.85) & (zones >= 1) & (greek_hits >= 5) & recognition


def national_capability(url: Column, title: Column, text: Column) -> Column:
    """[D34] What a national directory tells of its chapters' statuses. Of the text, 8,000 characters are its head."""
    low = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", url, title, F.substring(text, 1, 8000))), r"\s+", " "))
    any_of = lambda *words: F.exists(F.array(*map(F.lit, words)), low.contains)
    return (
        F.when(any_of("dormant chapters", "active chapters and colonies"), "active_dormant_split")
        .when(low.contains("active") & low.contains("inactive"), "all_status")
        .when(any_of("map", "locator", "chapter map") & (F.regexp_count(low, F.lit("chapter")) < 5), "map_with_status_filter")
        .when(any_of("history", "historical", "chapter roll", "archives"), "history_roll")
        .when(any_of("don t see a chapter at your school", "bring", "start a chapter", "our chapters", "chapter directory"), "active_only")
        .otherwise("unknown")
    )


def alias_matches(zones: DataFrame, aliases: DataFrame) -> DataFrame:
    """[J18] zone_id, fraternity_id and alias where the zone's text holds the alias's words in order, however many they are.

    zones: zone_id (unique), text; aliases: fraternity_id, alias.
    """
    a = aliases.select("fraternity_id", "alias", O.name_key("alias").alias("key")).where("key <> ''")
    found = O.marks(zones.select("zone_id", "text"), a, "zone_id").select("zone_id", "key").distinct()
    return found.join(a, "key").select("zone_id", "fraternity_id", "alias").distinct()


def validity(name: Column, school: Column, signals: Column, greek: Column) -> Column:
    """[D35] canonical_valid, repairable_candidate, provisional_candidate or invalid_non_chapter (null names, too)."""
    letters = F.coalesce(F.size(greek) > 0, F.lit(False))
    junk = S.invalid_reason(name, school, F.lit("")).isNotNull() & ~(letters & F.coalesce(S.looks_like_person(name), F.lit(False)))
    return F.when(junk, "invalid_non_chapter").when(school.isNotNull() & (letters | (signals >= 1)), "canonical_valid").when(school.isNotNull(), "provisional_candidate").otherwise("repairable_candidate")


FIELDS = ["name", "university_name", "city", "state", "website_url", "instagram_url", "contact_email", "external_id"]


def normalized_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[D36] Chapters and their provenance, one row per filled field, from extracted records (see FIXTURES)."""
    greek = S.greek_phrases("name")
    school = F.coalesce(S.blank_to_null("university_name"), S.school_in("source_snippet"))
    chapters = records.select(
        "ordinal", S.slugify(F.concat_ws("-", "name", school)).alias("slug"), S.calm_title("name").alias("name"), school.alias("university_name"), S.blank_to_null("city").alias("city"), S.state_code("state").alias("state"),
        S.as_website("website_url", F.col("source_url")).alias("website_url"), S.as_instagram("instagram_url").alias("instagram_url"), S.as_email("contact_email").alias("contact_email"), S.blank_to_null("external_id").alias("external_id"),
        validity(F.col("name"), school, S.institution_signals(F.coalesce(school, F.lit(""))), greek).alias("validity_class"), "source_url", "source_confidence",
    )
    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("field_value")) for f in FIELDS))
    provenance = chapters.select("ordinal", "source_url", F.col("source_confidence").alias("confidence"), F.inline(cells)).where("field_value is not null")
    return chapters, provenance


def best_records(records: DataFrame, with_school: bool = True) -> DataFrame:
    """[W05, W06] The best record of each name and university: confidence, then richness, then the first."""
    extra = ["university_name"] if with_school else []
    rich = S.richness("city", "state", "website_url", "instagram_url", "contact_email", *extra)
    order = Window.partitionBy(F.lower(F.trim("name")), F.lower(F.trim(F.coalesce("university_name", F.lit(""))))).orderBy(F.col("source_confidence").desc_nulls_last(), rich.desc(), "ordinal")
    return records.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def triaged(jobs: DataFrame) -> DataFrame:
    """[D37] Patches of queued jobs: new state, reason and delay from validity, degraded providers and missing sites.

    jobs: id, field_name, validity_class, provider_degraded, has_website, pending_website. The batch is saturated where
    at least 12 were triaged and 70 % of them blocked.
    """
    made = lambda s, r, d: F.struct(F.lit(s).alias("queue_state"), F.lit(r).alias("blocked_reason"), (d if isinstance(d, Column) else F.lit(d)).alias("delay_s"))
    needs = F.col("field_name").isin("find_email", "find_instagram") & ~F.col("has_website")
    patch = (
        F.when(F.col("validity_class") == "invalid_non_chapter", made("blocked_invalid", "invalid_entity", 0))
        .when(F.col("validity_class") == "repairable_candidate", made("blocked_repairable", "queued_for_entity_repair", 900))
        .when(F.col("validity_class") == "provisional_candidate", made("deferred", "provisional_entity", 86_400))
        .when(F.col("provider_degraded") & F.col("field_name").startswith("find_"), made("blocked_provider", "provider_degraded", 300))
        .when(needs, made("blocked_dependency", "website_required", F.when(F.col("pending_website"), 300).otherwise(1800)))
        .otherwise(made("actionable", None, 0))
    )
    return jobs.select("id", "field_name", patch.alias("p")).select("id", "field_name", "p.*")


def saturation(patches: DataFrame) -> DataFrame:
    blocked = F.count_if(F.col("queue_state").startswith("blocked"))
    return patches.agg(F.count("*").alias("triaged"), blocked.alias("blocked"), ((F.count("*") >= 12) & (blocked / F.greatest(F.count("*"), F.lit(1)) >= 0.7)).alias("saturated"))


def job_outcome(found: Column, confidence: Column, threshold: Column, attempts: Column, most: Column, base_s: int = 60) -> Column:
    """[D38, T04] struct of action and backoff: complete, review, requeue (base x 2^(attempts - 1)) or fail_terminal."""
    action = F.when(found & (confidence >= threshold), "complete").when(found, "review").when(attempts >= most, "fail_terminal").otherwise("requeue")
    return F.struct(action.alias("action"), F.when(action == "requeue", (F.lit(base_s) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)))).cast("long")).otherwise(F.lit(0).cast("long")).alias("backoff_s"))


# Confidence from which a contact is written, or counts as found, by where it comes from.
SEARCHED = ["search_result", "search_page"]
WRITE_SEARCHED = {"website_url": 0.95, "contact_email": 0.9, "instagram_url": 0.88}
FOUND_PAGE = {"website_url": 0.96, "contact_email": 0.92, "instagram_url": 0.88}
FOUND_RESULT = {"website_url": 0.96, "contact_email": 0.92, "instagram_url": 0.9}


def _by_field(field: Column, points: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, p in points.items():
        out = F.when(field == name, p).otherwise(out)
    return out


def write_threshold(field: Column, provider: Column, tier: Column, source_tier: Column) -> Column:
    """[D38] Confidence from which a candidate is written. tier, source_tier: of its site and of its source (see website_tier)."""
    site, searched = field == "website_url", F.coalesce(provider.isin(SEARCHED), F.lit(False))
    first = F.coalesce((tier == "tier1") | (source_tier == "tier1"), F.lit(False))
    return (
        F.when(site & (tier == "tier2"), 1.0)
        .when(site & searched, F.when(first, 0.9).when(provider == "search_result", 0.98).otherwise(0.95))
        .when(searched, _by_field(field, WRITE_SEARCHED, 0.85))
        .otherwise(0.65)
    )


def found_threshold(field: Column, provider: Column, tier: Column, source_tier: Column) -> Column:
    """[D38] Confidence from which a written candidate counts as found, not as unsure."""
    site, searched = field == "website_url", F.coalesce(provider.isin(SEARCHED), F.lit(False))
    first = F.coalesce((tier == "tier1") | (source_tier == "tier1"), F.lit(False))
    return (
        F.when(site & (tier == "tier2"), 0.99)
        .when(site & searched & first, 0.92)
        .when(provider == "search_page", _by_field(field, FOUND_PAGE, 0.9))
        .when(provider == "search_result", _by_field(field, FOUND_RESULT, 0.9))
        .otherwise(0.85)
    )


def benchmark_alerts(runs: DataFrame) -> DataFrame:
    """[D40] Alerts of runs: id, mismatch_rate, checks (an array of struct name, passed)."""
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: F.struct(F.concat(F.lit("gate:"), c["name"]).alias("kind"), F.lit("warning").alias("severity")))
    drift = F.when(F.col("mismatch_rate") >= 0.25, F.array(F.struct(F.lit("mismatch").alias("kind"), F.lit("critical").alias("severity")))).when(F.col("mismatch_rate") >= 0.1, F.array(F.struct(F.lit("mismatch").alias("kind"), F.lit("warning").alias("severity")))).otherwise(F.filter(failed, lambda c: F.lit(False)))
    return runs.select("id", F.inline(F.concat(failed, drift))).withColumn("fingerprint", F.concat_ws(":", "kind", F.col("id").cast("string")))


def search_queries(fraternity: Column, school: Column, chapter: Column) -> Column:
    """[D41] Distinct search queries for a chapter, in order."""
    f, s, c = (F.coalesce(S.blank_to_null(x), F.lit("")) for x in (fraternity, school, chapter))
    q = lambda *parts: F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))
    return F.array_distinct(F.array(q(f, s, F.lit("chapter")), q(f, c, s), q(F.lit("site:instagram.com"), f, s), q(s, F.lit("fraternity recognized chapters")), q(f, s, F.lit("email contact"))))


def identity_tokens(fraternity: Column, school: Column, chapter: Column) -> Column:
    """[D28] struct of alias arrays."""
    forms = lambda x: F.array_distinct(F.filter(F.array(F.lower(x), S.compact_key(x), S.initials(x)), lambda t: t != ""))
    return F.struct(forms(fraternity).alias("fraternity"), forms(school).alias("school"), forms(chapter).alias("chapter"))


def contact_audit(value: Column, score: Column) -> Column:
    """[D49] What becomes of an existing value."""
    return F.when(S.blank_to_null(value).isNull(), "missing").when(S.instagram_kind(value) != "profile", "clear").when(score >= 0.9, "keep").when(score >= 0.6, "review").otherwise("clear")


# Searches ------------------------------------------------------------------------------------------------------------


def low_signal_queries(results: DataFrame, low_hosts: list[str]) -> DataFrame:
    """query and low_signal: no result shares two words with it, or too many come from low-signal hosts.

    results: query, url, title, snippet.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    shared = F.size(F.array_intersect(words(F.col("query")), words(F.concat_ws(" ", "title", "snippet"))))
    low = S.on_hosts(S.url_host("url"), low_hosts)
    return results.groupBy("query").agg(((F.max(shared) < 2) | (F.count_if(low) >= F.greatest(F.lit(2), F.floor(F.count("*") / 2)))).alias("low_signal"))


# Marks of results that are a school's, an organisation's or nobody's evidence.
SCHOOL_RESULT_MARKERS = ["greek life", "fraternity and sorority life", "recognized chapters", "student organizations"]
DIRECTORY_PATH_MARKERS = ["chapter-directory", "find-a-chapter", "chapters", "chapter-listing"]
DIRECTORY_TEXT_MARKERS = ["chapter directory", "find a chapter", "our chapters"]
UNSAFE_RESULT_HOSTS = ["reddit.com", "quora.com", "wikipedia.org", "facebook.com"]


def smoke_flags(results: DataFrame) -> DataFrame:
    """Flags of each query's results (query, url, title, snippet): a school's page or a directory of chapters is
    evidence; without any, results ask for review, or are unsafe where one comes from a host that proves nothing."""
    any_of = lambda text, words: F.coalesce(sum((text.contains(w).cast("int") for w in words), F.lit(0)) > 0, F.lit(False))
    rows = results.select("query", F.lower(F.concat_ws(" ", "title", "snippet", "url")).alias("low"), S.url_host("url").alias("host"), F.lower(S.url_path("url")).alias("path"))
    edu = F.coalesce(F.col("host").endswith(".edu"), F.lit(False))
    official = F.bool_or(edu | any_of(F.col("low"), SCHOOL_RESULT_MARKERS)).alias("official")
    national = F.bool_or(any_of(F.col("path"), DIRECTORY_PATH_MARKERS) | (~edu & any_of(F.col("low"), DIRECTORY_TEXT_MARKERS))).alias("national")
    found = rows.groupBy("query").agg(official, national, F.bool_or(any_of(F.col("host"), UNSAFE_RESULT_HOSTS)).alias("odd"))
    accepted = F.col("official") | F.col("national")
    return found.select("query", "official", "national", accepted.alias("accepted"), (~accepted & ~F.col("odd")).alias("review"), (F.col("odd") & ~accepted).alias("unsafe"))


def fuzzy_alias_matches(zones: DataFrame, aliases: DataFrame, least: float = 0.68) -> DataFrame:
    """[J18, Q9] zone_id, fraternity_id and ratio where a whole short zone text resembles an alias.

    Candidates share a word of three letters or more; the ratio is that of the standard library's sequence matcher.
    """
    from collections.abc import Iterator

    import pandas as pd

    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    z = zones.select("zone_id", "text", F.explode(words(F.col("text"))).alias("w"))
    a = aliases.select("fraternity_id", "alias", F.explode(words(F.col("alias"))).alias("w"))
    pairs = z.join(a, "w").where(F.length("text") <= 3 * F.length("alias")).select("zone_id", "fraternity_id", "text", "alias").distinct()

    def ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for b in batches:
            b = b.assign(ratio=[SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(b["alias"], b["text"], strict=True)])
            yield b.loc[b["ratio"] >= least, ["zone_id", "fraternity_id", "ratio"]]

    return pairs.mapInPandas(ratio, "zone_id long, fraternity_id long, ratio double")


def campus_index(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[D52] Sources and zones of parsed campus pages (with school_name); the policy source is the one of tier 0."""
    from quillmesh.sources import html as H

    official = S.url_host("url").endswith(".edu")
    sources = pages.select("page_id", F.col("url").alias("source_url"), campus_source(F.col("url"), F.col("title"), F.col("text"), official).alias("s")).select("page_id", "source_url", "s.*")
    return sources, H.status_zones(pages)


def sweep(candidates: DataFrame, identities: DataFrame, taken: DataFrame) -> DataFrame:
    """[D51, D50, J15] Scored candidates of a run's chapters and what becomes of each chapter's best one.

    candidates: chapter_id, handle, text, source_type, contact_specificity; identities: chapter_id and the three alias
    arrays; taken: handle, chapter_id of existing assignments.
    """
    c = candidates.join(identities, "chapter_id")
    used = taken.select("handle", F.col("chapter_id").alias("owner")).distinct()
    other = c.select("chapter_id", "handle").distinct().join(used, "handle").where("owner <> chapter_id").select("chapter_id", "handle").distinct().withColumn("taken", F.lit(True))
    c = c.join(other, ["chapter_id", "handle"], "left")
    s = instagram_score(F.col("handle"), F.col("text"), F.col("source_type"), F.col("contact_specificity"), F.col("fraternity"), F.col("school"), F.col("chapter"), F.coalesce("taken", F.lit(False)))
    c = c.withColumn("s", s).select("chapter_id", "handle", "source_type", "s.score", "s.rejects")
    order = Window.partitionBy("chapter_id").orderBy(F.col("score").desc(), "handle")
    best = c.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return best.withColumn("action", resolution(F.col("score"), F.col("source_type")))


def best_source(candidates: DataFrame) -> DataFrame:
    """[D56, K08] The best source of each fraternity: quality of its URL, then health, then slug."""
    order = Window.partitionBy("fraternity_id").orderBy(source_quality(F.col("url"))["score"].desc(), F.col("health").desc_nulls_last(), F.col("slug").desc())
    return candidates.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
