"""Queries that apply single scalar functions, decisions and mutations to the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.operators import mutations as M
from quillmesh.operators import scoring as D
from quillmesh.plans.analogs import duck_sql, relation

Query = Callable[[SparkSession, str], DataFrame]

#: Lease ends and times of resolution are set to this.
THEN = "timestamp '1998-09-01 00:00:00'"


def _on(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(relation(spark, sf_dir, name))


def _texts(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _by(k: int, *cases: Column | str) -> Column:
    """The case that the id's remainder by k names; the last one otherwise."""
    made = [F.lit(c) if isinstance(c, str) else c for c in cases]
    out = F.when(F.col("id") % k == 0, made[0])
    for i, c in enumerate(made[1:-1], 1):
        out = out.when(F.col("id") % k == i, c)
    return out.otherwise(made[-1])


def signatures(d: DataFrame) -> DataFrame:
    v = F.col("visits")
    return d.select("id", S.structural_signature(F.lit("directory"), v % 5, v % 6, v * 3, F.lit("https://example.edu/"), v % 2 == 0, v % 3 == 0, v % 7 == 0).alias("signature"))


def candidates(d: DataFrame) -> DataFrame:
    raw = _by(3, F.col("website_url"), F.concat(F.lit("mailto:"), "contact_email"), F.concat(F.lit("@c"), F.col("id").cast("string"), F.lit("_x")))
    return d.select("id", raw.alias("raw")).withColumn("x", S.as_candidate("raw", "website")).select("id", "x.kind", "x.value", "x.coerced")


def targets(d: DataFrame) -> DataFrame:
    x = S.target_class(F.lit("https://c1.example.edu/x"), F.coalesce("website_url", "instagram_url"))
    return d.select("id", x["target"].alias("target"), x["follow_allowed"].alias("follow_allowed"))


def conclusive(d: DataFrame) -> DataFrame:
    i = F.col("id")
    return d.select("id", D.roster_conclusive(i % 4, i % 10 / 10.0, F.lit(0.9), i % 3, i % 13, i % 2 == 0).alias("conclusive"))


def leases(d: DataFrame) -> DataFrame:
    return M.leased(d.select("id", "lease_expires_at"), d.where("id % 2 = 0").select("id"), F.expr(THEN))


QUERIES: dict[str, Query] = {
    "c03_discovery_slugs": _on("chapters", lambda d: d.select("id", S.discovery_slug(F.concat(F.lit("ΑΒ & "), "name")).alias("slug"), S.compact(F.concat(F.lit("ΑΒ "), "name")).alias("compact"))),
    "c09_signatures": _on("templates", signatures),
    "c11_without_host": _on("templates", lambda d: d.select("id", S.without_host(F.concat(F.lit("example.org|"), "signature")).alias("a"), S.without_host(F.concat(F.lit("role|"), "signature")).alias("b"))),
    "c15_candidates": _on("chapters", candidates),
    "c26_first_filled": _on("chapters", lambda d: d.select("id", S.first_filled("website_url", F.lit(" "), "contact_email", "instagram_url").alias("contact"))),
    "c27_initials": _on("chapters", lambda d: d.select("id", S.initials(F.concat(F.lit("University of the "), F.coalesce("university", F.lit("East")))).alias("initials"))),
    "c36_rendered": _on("chapters", lambda d: d.select("id", S.rendered(F.lit("Hi {name}, {state}{nobody}!"), {"name": F.col("name"), "state": F.col("state")}).alias("text"))),
    "c39_ratios": _on("crawl_runs", lambda d: d.select("id", S.safe_ratio("records", F.col("pages") - 100).alias("ratio"))),
    "c41_buckets": _on("review_items", lambda d: d.select("id", S.context_bucket(F.col("reason"), F.col("status"), F.col("turn") % 2 == 0, F.col("turn") % 3).alias("bucket"))),
    "d33_conclusive_rosters": _on("chapters", conclusive),
    "d42_specificity": _on("chapters", lambda d: d.select("id", S.contact_specificity(_by(5, "chapter_site", "school_affiliation_page", "nationals_chapter_page", "nationals_generic", "elsewhere")).alias("specificity"))),
    "f18_blocked_hosts": _on("chapters", lambda d: d.select("id", S.on_hosts(S.url_host("website_url"), ["example.edu"]).alias("inside"), S.on_hosts(S.url_host("website_url"), ["ample.edu"]).alias("beside"))),
    "f21_target_classes": _on("chapters", targets),
    "s11_search_targets": _on("chapters", lambda d: d.select("id", S.search_target(F.concat(F.lit("https://duckduckgo.com/l/?x=1&uddg="), F.url_encode("website_url"))).alias("target"))),
    "u09_leases": _on("workers", leases),
    "u14_resolved_alerts": _on("alerts", lambda d: M.resolved_alerts(d, "view", F.expr(THEN)).select("id", "status", "resolved_at")),
    "u19_deleted": _on("review_items", lambda d: M.without(d.select("id", "reason"), d.where("turn % 2 = 0").select("id"))),
}

_SLUG = "regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_SQL: dict[str, str] = {
    "c03_discovery_slugs": f"select id, 'alpha-beta-and-' || {_SLUG} as slug, 'alphabeta' || regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') as compact from chapters",
    "c09_signatures": """select id, concat('directory|t', least(visits % 5, 3), '|r', least(visits % 6, 4), '|l', least(visits * 3 // 10, 5), '|root|',
        case when visits % 2 = 0 then 'json' else 'nojson' end, '-', case when visits % 3 = 0 then 'map' else 'nomap' end, '-', case when visits % 7 = 0 then 'page' else 'single' end) as signature from templates""",
    "c11_without_host": "select id, signature as a, 'role|' || signature as b from templates",
    "c15_candidates": """with x as (select id, case id % 3 when 0 then website_url when 1 then contact_email else 'https://www.instagram.com/c' || id || '_x' end as value from chapters)
        select id, case when value is not null then case id % 3 when 0 then 'website' when 1 then 'email' else 'instagram' end end as kind, value, case when value is not null then id % 3 <> 0 end as coerced from x""",
    "c26_first_filled": "select id, coalesce(website_url, contact_email, instagram_url) as contact from chapters",
    "c27_initials": "select id, case when university is null then 'ue' else 'us' || substr(split_part(university, ' ', 2), 1, 1) end as initials from chapters",
    "c36_rendered": "select id, concat('Hi ', name, ', ', coalesce(state, ''), '!') as text from chapters",
    "c39_ratios": "select id, case when pages > 100 then records / cast(pages - 100 as double) else 0e0 end as ratio from crawl_runs",
    "c41_buckets": "select id, concat_ws(':', reason, status, case when turn % 2 = 0 then 'map' else 'nomap' end, case when turn % 3 > 0 then 'table' else 'notable' end) as bucket from review_items",
    "d33_conclusive_rosters": "select id, id % 4 <= 2 and id % 10 >= 7 and id % 3 >= 1 and id % 13 >= 5 and id % 2 = 0 as conclusive from chapters",
    "d42_specificity": "select id, case id % 5 when 0 then 'chapter_specific' when 1 then 'school_specific' when 2 then 'national_specific_to_chapter' when 3 then 'national_generic' else 'ambiguous' end as specificity from chapters",
    "f18_blocked_hosts": "select id, website_url is not null as inside, false as beside from chapters",
    "f21_target_classes": """select id, case when website_url is not null then case when id = 1 then 'national' else 'institutional' end when instagram_url is not null then 'social' else 'unknown' end as target, website_url is not null as follow_allowed from chapters""",
    "s11_search_targets": "select id, website_url as target from chapters",
    "u09_leases": f"select id, case when id % 2 = 0 then {THEN} else lease_expires_at end as lease_expires_at from workers",
    "u14_resolved_alerts": f"select id, case when status = 'open' and starts_with(fingerprint, 'view') then 'resolved' else status end as status, case when status = 'open' and starts_with(fingerprint, 'view') then {THEN} end as resolved_at from alerts",
    "u19_deleted": "select id, reason from review_items where turn % 2 <> 0",
}

ORACLE_SQL: dict[str, str] = {k: duck_sql(v) for k, v in _SQL.items()}
