"""Queries of names in zones and of blocks and stubs in pages, each with SQL or a plain twin in the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import organisations as O
from quillmesh.plans.analogs import duck_sql, run_sql
from quillmesh.plans.decisions import _list, _pick, _split
from quillmesh.sources import blocks as B
from quillmesh.sources import html as H

Query = Callable[[SparkSession, str], DataFrame]

#: Organisations of the nations' table by names of Greek letters.
ORGS = f"""select n_nationkey as organisation_id, {_pick(14, "Sigma Chi", "Kappa Sigma", "Phi Gamma Delta", "Delta Chi", "Alpha Tau Omega", "Pi Kappa Alpha", "Sigma Alpha Epsilon", "Phi Kappa", "Beta Upsilon Chi", "Sigma", "Theta Xi", "Tau Kappa Epsilon", "Kappa Alpha", "Chi Psi", of="n_nationkey")} as name,
    {_pick(14, "sigma-chi", "kappa-sigma", "phi-gamma-delta", "delta-chi", "alpha-tau-omega", "pi-kappa-alpha", "sigma-alpha-epsilon", "phi-kappa", "beta-upsilon-chi", "sigma", "theta-xi", "tau-kappa-epsilon", "kappa-alpha-order", "chi-psi", of="n_nationkey")} as slug,
    {_pick(14, "Sig Chi", None, "Phi Gam", None, None, "PIKES", None, None, None, None, None, "TKE", of="n_nationkey")} as other from {{nation}}"""
#: Zones of campus pages: whole documents, most with names of organisations and schools before them.
ZONES = f"""select doc_id as zone_id, {_pick(6, "Texas Tech University", None, "Rice University", "State College", "", of="doc_id")} as school, coalesce({_pick(19, "Recognized chapters at Texas Tech University: Sigma Chi, Kappa-Sigma and TKE.", "ΣΧ and ΦΓΔ, active on campus.", "FIJI and the d chi house.", "The University of Texas and the University of Ohio, Sigma Chi fraternity.",
    "Chapters: Pi Kappa Alpha Sigma Chi Psi Delta Chi", "Sigma Alpha Epsilon, sig ep. TTU greek life, suspended", "BYX at Rice University", "kappa alpha order; Kappa Alpha; phi kappa; sigma", "Alpha Tau Omega was on probation at some college", "tke pikes fiji ato sae byx", "Phi Gam, Phi Gamma Delta, Phi Kappa Sigma (organization)", of="doc_id")} || ' ', '') || text as text from {{documents}}"""


def zone_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = run_sql(spark, sf_dir, f"select * from ({ORGS}) o").withColumn("aliases", F.when(F.col("other").isNotNull(), F.array("other")))
    return O.zone_matches(run_sql(spark, sf_dir, f"select * from ({ZONES}) z"), orgs)


def _key(x: str) -> str:
    """Only letters that the zones have are spelled out."""
    spelled = f"replace(replace(replace(replace(replace({x}, 'Σ', ' sigma '), 'Χ', ' chi '), 'Φ', ' phi '), 'Γ', ' gamma '), 'Δ', ' delta ')"
    return f"trim(regexp_replace(lower(coalesce({spelled}, '')), '[^a-z0-9]+', ' ', 'g'))"


_NICKS = "case " + " ".join(f"when n = '{k}' then {_list(v)}" for k, v in O.NICKNAMES.items()) + " else [] end"
_ZONE_SQL = f"""with o as (select organisation_id, {_key("name")} as n, [{_key("name")}, {_key("slug")}, {_key("replace(slug, '-', ' ')")}, {_key("other")}] as own from ({ORGS}) o),
    a as (select organisation_id, n, {_NICKS} as nicks, list_filter(own || {_NICKS}, lambda k: k <> '') as keys from o),
    k as (select organisation_id, keys[i] as alias, i, list_contains(nicks, keys[i]) as nick from (select *, unnest(range(1, len(keys) + 1)) as i from a) a where not list_contains({_list(O.AMBIGUOUS)}, keys[i])),
    z as (select zone_id, {_key("text")} as t, {_key("school")} as s from ({ZONES}) z),
    f as (select *, array_to_string(list_transform({_split("s", "w not in ('of', 'the', 'and', 'at')")}, lambda w: w[1]), '') as ini, len(list_filter({_list(O.ZONE_CONTEXT)}, lambda m: contains(t, m))) > 0 as context from z),
    g as (select *, s <> '' and (len(t) - len(replace(t, 'university', '')) >= 20 and not contains(t, s) or not (contains(t, s) or ini <> '' and contains(' ' || t || ' ', ' ' || ini || ' ')) and len(list_filter({_list(O.CAMPUS_MARKERS)}, lambda m: contains(t, m))) > 0) as elsewhere from f),
    m as (select zone_id, organisation_id, context, alias, row_number() over (partition by zone_id, organisation_id order by i) as r from g, k where not elsewhere and (context or nick) and contains(' ' || t || ' ', ' ' || alias || ' '))
    select zone_id, organisation_id, alias, case when context then 'exact_alias' else 'nickname' end as method, case when context then 0.99e0 else 0.94e0 end as confidence from m where r = 1"""

#: Made blocks of directory pages, one a kind of reader, before the given pages' own HTML.
SNIPPETS = [
    '<div class="dir"><section><h2>Texas</h2><ul><li>Sigma Chi, Beta Rho, Texas Tech University <a href="/chapters/beta-rho">Chapter profile of Beta Rho</a></li><li>Kappa Sigma, Rice University</li></ul></section></div>',
    "<script>var m = {'TX': {'hover': '<p>TEXAS o\\'brien</p>', 'url': 'https://x.org/tx'}, NY: {url: \"https://x.org/ny\", n: [1, {a: 2}], hover: \"<p>new york</p>\"}, bad: {hover: '<p>x</p>'</script>",
    '<div class="wix-image"><a href="/chapters/">All</a><div><a href="/chapters/beta-rho">Read</a></div><section>At Rice University <a href="/chapters/x">More</a></section></div>',
    '<section><h3 class="big chaptername">Rice University</h3><a href="https://facebook.com/x">f</a><a href="https://sigmachi.org/rice">site</a> <a href="mailto:a@rice.edu">mail</a></section><div class="chaptername">State College</div>',
    "<p>Beta Rho chapter Texas Tech University</p><p>GAMMA XI CHAPTER RICE UNIVERSITY</p><span>Our history: ALPHA CHAPTER OHIO UNIVERSITY</span>",
    '<ul><li class="chapter-card">Beta Rho - Rice University <a href="https://x.org/rice">w</a></li><li class="chapter-card">Zeta - State College</li></ul>',
]
BLOCKS = f"""select page_id, url, html, {_pick(4, "Texas Tech University", "Rice University", "University of Texas", of="page_id")} as school, {_pick(3, "Sigma Chi", "Kappa Sigma", of="page_id")} as organisation from {{pages}}"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.element_at(F.array(*map(F.lit, [*SNIPPETS, ""])), (F.col("page_id") % 7 + 1).cast("int"))
    return run_sql(spark, sf_dir, f"select * from ({BLOCKS}) b").withColumn("html", F.concat(made, F.coalesce("html", F.lit(""))))


def stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _blocks(spark, sf_dir)
    cards = H.stub_records(H.parsed(pages)).withColumns({"detail_url": F.col("website_url"), "outbound_url": F.col("website_url"), "provenance": F.lit("card"), "place": F.col("card")})
    return B.chapter_stubs(B.trees(pages.select("page_id", "url", "html", B.wix_like(F.col("html")).alias("wix"))), cards)


QUERIES: dict[str, Query] = {
    "d21_directory_blocks": lambda spark, sf_dir: B.directory_blocks(_blocks(spark, sf_dir)),
    "d45_chapter_stubs": stubs,
    "j18_zone_matches": zone_matches,
    "s05_stubs": lambda spark, sf_dir: H.stub_records(H.parsed(_blocks(spark, sf_dir))),
}
ORACLE_SQL: dict[str, str] = {"j18_zone_matches": duck_sql(_ZONE_SQL)}
