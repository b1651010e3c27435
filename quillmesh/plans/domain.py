"""Queries that apply the domain's functions and operators to the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.operators import mutations as M
from quillmesh.operators import policies as P
from quillmesh.operators import scoring as D
from quillmesh.plans.analogs import NOW, duck_sql, relation
from quillmesh.sources import html as H

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(relation(spark, sf_dir, name))


def _table_on(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_table(spark, sf_dir, name))


def _pages(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(H.parsed(_table(spark, sf_dir, "pages")))


def immediate(df: DataFrame) -> DataFrame:
    n = lambda k: (F.col("id") % k).cast("int")
    return df.select("id", D.immediate_reward(n(4), n(3), n(2), n(5), n(9), F.col("outcome") == "timeout", F.col("n_flags") > 3, n(6) - 3, n(7) - 4).alias("reward"))


def terminal(df: DataFrame) -> DataFrame:
    n = lambda k: (F.col("id") % k).cast("int")
    reason = F.when(n(4) == 0, "frontier_empty").when(n(4) == 1, "page_budget_exhausted")
    return df.select("id", D.terminal_reward(F.col("status"), reason, F.col("records") / 100.0 - 1, n(3), n(8), n(6), n(7), n(9), n(10), n(14), n(5) == 0).alias("reward"))


def stops(df: DataFrame) -> DataFrame:
    n = lambda k: (F.col("id") % k).cast("int")
    return df.select("id", D.stop_reason(n(13), F.lit(12), n(11), n(5), F.lit(4), n(50), F.lit(30), n(3), F.lit(2), F.col("risk_score"), F.lit(20.0)).alias("reason"))


def credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = relation(spark, sf_dir, "observations")
    rew = relation(spark, sf_dir, "rewards").where("reward_stage = 'delayed'")
    return D.delayed_credit(obs, rew, 0.5, 2).select("reward_id", F.col("at").alias("observation_id"), "hop", "credit")


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewards = relation(spark, sf_dir, "rewards")
    old = rewards.where("reward_stage = 'immediate'").groupBy(F.col("action_type").alias("action")).agg(F.count("*").alias("n"), F.avg("reward_value").alias("mean"))
    return D.replayed_policy(old, rewards.where("reward_stage = 'delayed'"))


def outcomes(df: DataFrame) -> DataFrame:
    field = F.when(F.col("field_name") == "find_website", "website_url").when(F.col("field_name") == "find_email", "contact_email").when(F.col("field_name") == "find_instagram", "instagram_url").otherwise(F.col("field_name"))
    of = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("id") % len(names) + 1).cast("int"))
    facts = field, of("search_result", "search_page", "provenance", None, "chapter_website", "search_result"), of("tier1", "tier2", "unknown", None, "blocked", "unknown", "unknown"), F.when(F.col("id") % 4 == 1, "tier1")
    sure = F.round(0.6 + F.col("id") % 41 / 100, 2)
    write, found = D.write_threshold(*facts), D.found_threshold(*facts)
    x = D.job_outcome(F.col("payload_value") > 100_000, sure, write, F.col("attempts"), F.lit(3))
    return df.select("id", write.alias("write"), found.alias("found"), x["action"].alias("action"), F.when(x["action"] == "complete", F.when(sure >= found, "found").otherwise("low_confidence")).alias("state"), x["backoff_s"].alias("backoff_s"))


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, chapters = relation(spark, sf_dir, "field_jobs").where("status = 'queued'"), relation(spark, sf_dir, "chapters")
    kind = F.when(F.col("university").isNull(), "repairable_candidate").when(F.col("chapter_status") == "unknown", "provisional_candidate").otherwise("canonical_valid")
    c = chapters.select(F.col("id").alias("chapter_id"), kind.alias("validity_class"), F.col("website_url").isNotNull().alias("has_website"))
    df = jobs.join(c, "chapter_id").withColumn("provider_degraded", F.coalesce(F.col("blocked_reason") == "provider_degraded", F.lit(False))).withColumn("pending_website", F.col("attempts") > 1)
    return D.triaged(df)


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = relation(spark, sf_dir, "chapters").select("id", "name", "website_url", "contact_email", "score")
    new = relation(spark, sf_dir, "evidence").groupBy(F.col("chapter_id").alias("id")).agg(F.max("field_value").alias("name"), F.max(F.when(F.col("confidence") > 0.05, F.col("field_value"))).alias("website_url"), F.max("weight").alias("score"))
    return M.merged(old, new, ["id"], fill=["website_url"], greatest=["score"])


def claim(df: DataFrame) -> DataFrame:
    return M.claimed(df, [F.col("priority").desc(), F.col("scheduled_at"), F.col("id")], 40, "w1").select("id", "status", "claimed_by")


def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = relation(spark, sf_dir, "field_jobs").select("id", "chapter_id", "field_name", "status")
    new = relation(spark, sf_dir, "chapters").select((-F.col("id")).alias("id"), F.col("id").alias("chapter_id"), F.lit("find_email").alias("field_name"), F.lit("queued").alias("status"))
    return M.absent_only(jobs, new, ["chapter_id", "field_name"])


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = relation(spark, sf_dir, "review_items").select("id", "status")
    return M.transitioned(items, items.select("id", F.when(F.col("id") % 2 == 0, "resolved").otherwise("ignored").alias("to")))[0]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relation(spark, sf_dir, "chapters")
    return c.select(
        F.col("id").cast("int").alias("ordinal"), F.col("name"), F.col("university").alias("university_name"), F.lit(None).cast("string").alias("city"), "state", "website_url", "instagram_url", "contact_email",
        F.col("id").cast("string").alias("external_id"), F.lit("https://example.edu/chapters").alias("source_url"), F.lit("").alias("source_snippet"), F.lit(0.8).alias("source_confidence"),
    )


def adaptive_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    several = records(spark, sf_dir).withColumns({"name": F.concat(F.lit(" Chapter "), (F.col("ordinal") % 60).cast("string")), "source_confidence": F.col("ordinal") % 4 / 4.0})
    return D.best_records(several, False).select("ordinal")


def scored_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = H.parsed(_table(spark, sf_dir, "pages")).select("page_id", "url", H.profile().alias("p"))
    script = F.col("has_script_json") | F.col("has_json_ld")
    ctx = pages.select(
        "page_id", "p.*", D.source_class(F.col("p"))["page_type"].alias("page_type"), S.keyword_score("url").alias("keyword"), F.lit(0.1).alias("timeout_risk"), F.lit(0.2).alias("requeue_risk"),
        F.create_map(F.lit("extract_table"), F.lit(1.0)).alias("observed"), F.lit(None).cast("struct<chapter_yield:double,contact_yield:double,empty_rate:double,timeout_rate:double,best_action:string,best_family:string>").alias("profile"),
    ).withColumn("has_script_json", script)
    return P.chosen_action(P.action_scores(ctx), "page_id").select("page_id", "action", "score")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return H.crawl_rounds(pages.select(F.lit("s").alias("session_id"), "url"), H.parsed(pages), 2)


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = relation(spark, sf_dir, "evidence")
    zone = F.when(F.col("reason_code") == "accepted", "recognized").when(F.col("reason_code") == "rejected", "suspended").otherwise("other")
    m = e.select("chapter_id", zone.alias("zone_type"), F.col("id").alias("zone_order"), (F.col("source_id") % 5).cast("int").alias("authority_tier"), (F.col("weight") / 50).alias("currentness"), F.lit(0.9).alias("zone_confidence"), (0.5 + F.col("confidence")).alias("match_confidence"))
    c = relation(spark, sf_dir, "chapters").select(F.col("id").alias("chapter_id"), (F.col("id") % 50 == 0).alias("banned"), (F.col("id") % 7 == 0).alias("absent"), F.col("chapter_status").alias("national"), F.lit(0.9).alias("national_confidence"))
    return D.chapter_status(c, m).select("chapter_id", "final_status", "reason_code", F.round("confidence", 6).alias("confidence"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("zone_id"), "text")
    whole = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fraternity_id"), F.col("text").alias("alias"))
    names = whole.unionByName(whole.withColumn("alias", F.split("alias", r"\.")[0]))
    return D.alias_matches(zones, names.distinct()).groupBy("fraternity_id", "alias").agg(F.count("*").alias("zones"))


QUERIES: dict[str, Query] = {
    "c01_slug_variants": _on("chapters", lambda d: d.select("id", S.slugify("university").alias("slug"), S.school_slug("university").alias("school_slug"), S.school_slug_edges("university").alias("edge_slug"), S.compact_key_quirk("university").alias("quirk"), S.compact_key("university").alias("compact"))),
    "c07_canonical_urls": _table_on("pages", lambda d: d.select("page_id", S.canonical_url("url").alias("canonical"), S.host_family("url").alias("family"))),
    "c10_route_classes": _table_on("pages", lambda d: d.select("page_id", S.route_class(S.url_path("url")).alias("route"))),
    "c12_contacts": _on("chapters", lambda d: d.select("id", S.as_website("website_url").alias("website"), S.as_email("contact_email").alias("email"), S.as_instagram("instagram_url").alias("instagram"), S.instagram_kind("instagram_url").alias("kind"), S.instagram_handle("instagram_url").alias("handle"))),
    "c18_emails_in_texts": _table_on("documents", lambda d: d.select("doc_id", F.explode(S.emails_in("text")).alias("email"))),
    "c24_richness": _on("chapters", lambda d: d.select("id", S.richness("website_url", "instagram_url", "contact_email", "state").alias("richness"), S.field_state("website_url", F.lit(0.7)).alias("website_state"), S.confidence_tier(F.col("score") / 10000).alias("tier"))),
    "c34_keyword_scores": _table_on("pages", lambda d: d.select("page_id", S.keyword_score("url").alias("score"))),
    "c40_json_guarded_sum": _table_on("events", lambda d: d.groupBy("event_type").agg(F.sum(S.json_number("props", "$.k")).alias("total"), F.count(S.json_number("props", "$.none")).alias("missing"))),
    "d01_page_profiles": _pages(lambda d: d.select("page_id", H.profile().alias("p")).select("page_id", "p.*")),
    "d02_source_classes": _pages(lambda d: d.select("page_id", H.profile().alias("p")).select("page_id", D.source_class(F.col("p")).alias("c")).select("page_id", "c.*")),
    "d05_frontier_links": _pages(H.frontier_links),
    "d06_frontier_scores": _pages(lambda d: H.frontier_links(d).select("page_id", "link", D.frontier_score(F.col("link"), F.col("anchor"), F.lit(1), F.col("source_url"), F.lit(False), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0))["score"].alias("score"))),
    "d08_chosen_actions": scored_actions,
    "d11_immediate_rewards": _on("observations", immediate),
    "d12_terminal_rewards": _on("crawl_runs", terminal),
    "d13_stop_reasons": _on("observations", stops),
    "d14_policy_replay": policy,
    "d30_status_zones": _pages(H.status_zones),
    "d32_chapter_status": statuses,
    "d36_normalized": lambda spark, sf_dir: D.normalized_records(records(spark, sf_dir))[0],
    "d36_provenance": lambda spark, sf_dir: D.normalized_records(records(spark, sf_dir))[1].drop("source_url"),
    "d37_triage": triage,
    "d38_job_outcomes": _on("field_jobs", outcomes),
    "d46_crawl_rounds": rounds,
    "d47_contact_hints": _pages(H.contact_hints),
    "j18_alias_zones": aliases,
    "k06_directory_links": _pages(H.directory_links),
    "s18_requested_jobs": _on("chapters", lambda d: M.requested(d, ["find_email", "find_website"])),
    "u01_chapter_upsert": upsert,
    "u05_insert_absent": insert_absent,
    "u07_claim": _on("field_jobs", claim),
    "u15_review_transitions": review,
    "u20_outreach": _on("chapters", lambda d: M.outreach(d, "c1", "Hi {chapter}", "From {university}{nobody}").drop("body")),
    "w06_best_records": adaptive_best,
    "w10_delayed_credit": credit,
}

SLUG = "regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_SQL: dict[str, str] = {
    "c01_slug_variants": f"select id, {SLUG.format('university')} as slug, regexp_replace(regexp_replace(lower(trim(university)), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') as school_slug, regexp_replace(lower(university), '[^a-z0-9]+', '-', 'g') as edge_slug, lower(regexp_replace(university, '[^a-z0-9]+', '', 'g')) as quirk, regexp_replace(lower(university), '[^a-z0-9]+', '', 'g') as compact from chapters",
    "j18_alias_zones": """with b as (select item_id as fraternity_id, text as alias from {benchmark}), a as (select * from b union select fraternity_id, split_part(alias, '.', 1) from b),
        k as (select *, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) as key from a), z as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' as t from {documents})
        select fraternity_id, alias, count(*) as zones from k join z on key <> '' and contains(t, ' ' || key || ' ') group by 1, 2""",
    "c07_canonical_urls": r"""with u as (select page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) as host, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path,
        list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not starts_with(lower(p), 'utm_') and lower(split_part(p, '=', 1)) not in ('fbclid','gclid','mc_cid','mc_eid','mkt_tok','igshid','ref','ref_src','ref_url','source')) as q from {pages})
        select page_id, scheme || '://' || host || case when path = '' then '/' else path end || case when len(q) = 0 then '' else '?' || array_to_string(q, '&') end as canonical, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as family from u""",
    "c12_contacts": "select id, website_url as website, lower(contact_email) as email, instagram_url as instagram, case when instagram_url is null then 'other' when length(split_part(instagram_url, '/', 4)) >= 3 then 'profile' else 'other' end as kind, case when length(split_part(instagram_url, '/', 4)) >= 3 then split_part(instagram_url, '/', 4) end as handle from chapters",
    "c18_emails_in_texts": r"select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}'), lambda x: lower(x)))) as email from {documents}",
    "c24_richness": "select id, (website_url is not null)::int + (instagram_url is not null)::int + (contact_email is not null)::int + (state is not null)::int as richness, case when website_url is null then 'missing' else 'found' end as website_state, case when score / 10000 >= 0.8 then 'high' when score / 10000 >= 0.6 then 'medium' else 'low' end as tier from chapters",
    "c34_keyword_scores": "select page_id, round(" + " + ".join(f"case when contains(lower(url), '{k}') then {w} else 0 end" for k, w in S.KEYWORDS.items()) + ", 6)::double as score from {pages}",
    "c40_json_guarded_sum": "select event_type, sum(cast(json_extract_string(props, '$.k') as double)) as total, 0::bigint as missing from {events} group by event_type",
    "d11_immediate_rewards": """with x as (select id, id % 4 as c, id % 3 as w, id % 2 as i, id % 5 as e, id % 9 as l, outcome = 'timeout' as t, n_flags > 3 as r, id % 6 - 3 as v, id % 7 - 4 as s from observations)
        select id, (case when t then -3e0 else 0 end + case when c = 0 and v <= 0 then -2e0 else 0 end + c * 5e0 + w * 2e0 + i * 2e0 + e * 3e0 + case when c > 0 and w + i + e = 0 then c else 0 end + greatest(s, 0) * 1.5e0 + greatest(v, 0) * 0.35e0 + least(l, 6) * 0.25e0 + case when r then -0.5e0 else 0 end) as reward from x""",
    "d13_stop_reasons": "select id, case when id % 13 >= 12 then 'page_budget_exhausted' when id % 11 <= 0 then 'frontier_empty' when id % 5 >= 4 then 'empty_streak_exhausted' when id % 50 >= 30 and id % 13 >= 2 and id % 3 >= 1 then 'high_yield_saturated' when id % 3 >= 2 then 'saturation_reached' when risk_score < 20 then 'min_score_floor' end as reason from observations",
    "d14_policy_replay": "select action_type as action, count(*) as n, (sum(case when reward_stage = 'immediate' then reward_value else 0 end) + sum(case when reward_stage = 'delayed' then reward_value * 0.8e0 else 0 end)) / count(*) as mean from rewards where reward_stage in ('immediate', 'delayed') group by 1",
    "d37_triage": """with x as (select j.*, case when c.university is null then 'r' when c.chapter_status = 'unknown' then 'p' else 'v' end as k, c.website_url is not null as site from field_jobs j join chapters c on c.id = j.chapter_id where j.status = 'queued'),
        y as (select *, case when k = 'r' then 1 when k = 'p' then 2 when coalesce(blocked_reason = 'provider_degraded', false) and starts_with(field_name, 'find_') then 3 when field_name in ('find_email', 'find_instagram') and not site then 4 else 5 end as c from x)
        select id, field_name, case c when 1 then 'blocked_repairable' when 2 then 'deferred' when 3 then 'blocked_provider' when 4 then 'blocked_dependency' else 'actionable' end as queue_state, case c when 1 then 'queued_for_entity_repair' when 2 then 'provisional_entity' when 3 then 'provider_degraded' when 4 then 'website_required' end as blocked_reason,
        case c when 1 then 900 when 2 then 86400 when 3 then 300 when 4 then case when attempts > 1 then 300 else 1800 end else 0 end as delay_s from y""",
    "d38_job_outcomes": """with j as (select *, case field_name when 'find_website' then 'website_url' when 'find_email' then 'contact_email' when 'find_instagram' then 'instagram_url' else field_name end as f,
          ['search_result', 'search_page', 'provenance', null, 'chapter_website', 'search_result'][id % 6 + 1] as p, ['tier1', 'tier2', 'unknown', null, 'blocked', 'unknown', 'unknown'][id % 7 + 1] as t, id % 4 = 1 as st, round(0.6e0 + id % 41 / 100e0, 2) as sure from field_jobs),
        k as (select *, coalesce(p in ('search_result', 'search_page'), false) as searched, coalesce(t = 'tier1', false) or st as one, coalesce(t = 'tier2', false) as two from j),
        l as (select *, case when f = 'website_url' and two then 1e0 when f = 'website_url' and searched and one then 0.9e0 when f = 'website_url' and p = 'search_result' then 0.98e0 when f = 'website_url' and p = 'search_page' then 0.95e0 when searched and f = 'contact_email' then 0.9e0 when searched and f = 'instagram_url' then 0.88e0 when searched then 0.85e0 else 0.65e0 end as write,
          case when f = 'website_url' and two then 0.99e0 when f = 'website_url' and searched and one then 0.92e0 when searched and f = 'website_url' then 0.96e0 when searched and f = 'contact_email' then 0.92e0 when p = 'search_page' and f = 'instagram_url' then 0.88e0 when searched then 0.9e0 else 0.85e0 end as found from k),
        m as (select *, case when payload_value > 100000 and sure >= write then 'complete' when payload_value > 100000 then 'review' when attempts >= 3 then 'fail_terminal' else 'requeue' end as action from l)
        select id, write, found, action, case when action = 'complete' then case when sure >= found then 'found' else 'low_confidence' end end as state, case when action = 'requeue' then 60 * cast(pow(2, greatest(attempts - 1, 0)) as bigint) else 0 end as backoff_s from m""",
    "d32_chapter_status": """with m as (select chapter_id, case reason_code when 'accepted' then true when 'rejected' then false end as positive, id, source_id % 5 as tier, weight / 50 as cur, 0.5e0 + confidence as mc from evidence where reason_code is not null),
        b as (select *, row_number() over (partition by chapter_id, positive order by round(1.1e0 - tier * 0.08e0 + (cur + 0.9e0 + mc) * 0.5e0, 9) desc, id) as rn from m),
        p as (select chapter_id, round(cur + 1 - tier * 0.1e0, 9) as r, greatest(mc, 0.9e0) as c from b where rn = 1 and positive), n as (select chapter_id, round(cur + 1 - tier * 0.1e0, 9) as r, greatest(mc, 0.9e0) as c from b where rn = 1 and not positive),
        x as (select c.id, c.chapter_status as nat, p.r as pr, p.c as pc, n.r as nr, n.c as nc, case when c.id % 50 = 0 then 1 when p.r is not null and (n.r is null or p.r >= n.r) then 2 when n.r is not null then 3 when c.id % 7 = 0 then 4 when c.chapter_status in ('inactive', 'dormant', 'closed') then 5 else 6 end as k from chapters c left join p on p.chapter_id = c.id left join n on n.chapter_id = c.id)
        select id as chapter_id, case k when 1 then 'inactive' when 2 then 'active' when 3 then 'inactive' when 4 then 'inactive' when 5 then 'review' else 'unknown' end as final_status,
        case k when 1 then 'official_school_policy_prohibits_fraternities' when 2 then 'official_school_current_recognition' when 3 then 'official_school_negative_status' when 4 then 'absent_from_conclusive_roster' when 5 then 'national_all_status_directory_inactive_school_unknown' else 'no_conclusive_school_status_evidence' end as reason_code,
        round(case k when 1 then 0.98e0 when 2 then least(0.97e0, pc) when 3 then least(0.98e0, nc) when 4 then 0.9e0 when 5 then 0.82e0 else 0.3e0 end, 6) as confidence from x""",
    "s18_requested_jobs": "select id, f as field_name from chapters cross join (values ('find_email'), ('find_website')) v(f)",
    "u01_chapter_upsert": """with n as (select chapter_id as id, max(field_value) as name, max(case when confidence > 0.05 then field_value end) as website_url, max(weight) as score from evidence group by 1)
        select coalesce(c.id, n.id) as id, case when n.id is null then c.name else n.name end as name, coalesce(n.website_url, c.website_url) as website_url, c.contact_email, case when c.score is null then n.score when n.score is null then c.score else greatest(c.score, n.score) end as score from chapters c full outer join n on n.id = c.id""",
    "u05_insert_absent": "select id, chapter_id, field_name, status from field_jobs union all select -c.id, c.id, 'find_email', 'queued' from chapters c where not exists (select 1 from field_jobs j where j.chapter_id = c.id and j.field_name = 'find_email' and j.status in ('queued', 'running'))",
    "u07_claim": "with h as (select id from field_jobs where status = 'queued' and coalesce(queue_state, 'actionable') = 'actionable' order by priority desc, scheduled_at nulls first, id limit 40) select j.id, case when h.id is not null then 'running' else j.status end as status, case when h.id is not null then 'w1' end as claimed_by from field_jobs j left join h on h.id = j.id",
    "u15_review_transitions": "select id, case when id % 2 = 0 then case when status = 'triaged' then 'resolved' else status end else case when status in ('open', 'triaged') then 'ignored' else status end end as status from review_items",
    "u20_outreach": "select 'c1' as campaign_id, id as chapter_id, contact_email, 'Hi ' || name as subject from chapters where contact_email is not null and email_specificity in ('chapter_specific', 'school_specific', 'national_specific_to_chapter')",
    "d12_terminal_rewards": """select id, round(greatest(-1e0, least(1e0, records / 100e0 - 1)) * 2 + case status when 'succeeded' then 1e0 when 'failed' then -1.5e0 else 0e0 end + case id % 4 when 0 then 0.25e0 when 1 then -0.4e0 else 0e0 end
        + case when id % 5 = 0 and id % 8 = 0 then -0.75e0 else 0e0 end + case when id % 3 = 0 and id % 14 > 0 then -0.25e0 else 0e0 end + least(id % 8, 6) * 0.75e0 + least(id % 7, 6) * 0.4e0 + least(id % 6, 4) * 0.2e0
        + least(id % 9, 8) * 0.08e0 + least(id % 10, 8) * 0.04e0 - least(id % 14, 12) * 0.08e0, 4) as reward from crawl_runs""",
    "w06_best_records": """select id as ordinal from (select id, row_number() over (partition by id % 60, coalesce(lower(trim(university)), '') order by id % 4 desc,
        case when state is null then 0 else 1 end + case when website_url is null then 0 else 1 end + case when instagram_url is null then 0 else 1 end + case when contact_email is null then 0 else 1 end desc, id) as rn from chapters) x where rn = 1""",
    "w10_delayed_credit": """with recursive walk(reward_id, v, at_id, hop) as (select id, reward_value, attributed_id, 0 from rewards where reward_stage = 'delayed' union all
        select w.reward_id, w.v, o.parent_id, w.hop + 1 from walk w join observations o on o.id = w.at_id where o.parent_id is not null and w.hop < 2)
        select w.reward_id, w.at_id as observation_id, w.hop, round(w.v * pow(0.5e0, w.hop), 4) as credit from walk w join observations o on o.id = w.at_id where w.hop > 0 and round(w.v * pow(0.5e0, w.hop), 4) <> 0""",
}

ORACLE_SQL: dict[str, str] = {k: duck_sql(v) for k, v in _SQL.items()}
__all__ = ["NOW", "ORACLE_SQL", "QUERIES"]
