import random
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import mutations as M
from quillmesh.operators import scoring as D
from quillmesh.sources import html as H

PAGE = """<html><head><title>Our Chapters</title><script type="application/ld+json">[{"@type":"EducationalOrganization","@id":"7","name":"Beta","schoolName":"West College","address":{"addressLocality":"Reno","addressRegion":"NV"},"url":"https://west.example.edu"}]</script>
<script>window.rows = [{"chapterId":"1","chapterName":"Alpha","schoolName":"North College","city":"Austin","state":"TX"}];</script></head>
<body><h1>Recognized chapters</h1><table><tr><th>Chapter</th><th>School</th><th>Website</th></tr><tr><td>Alpha</td><td>North College</td><td>https://a.example.org</td></tr></table>
<ul><li class="chapter-item"><a href="/x?utm_source=1">Gamma - South College</a></li><li class="chapter-item"><a href="mailto:Bob@Example.org">Mail</a></li><li class="chapter-item">Delta</li></ul>
<h2>Suspended</h2><p>Omega</p><a href="https://instagram.com/alpha_house">ig</a></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return H.parsed(spark.createDataFrame([(1, "https://site.example.org/dir/", PAGE), (2, "https://site.example.org/none", None)], "page_id long, url string, html string")).cache()


def test_profile_and_class(page):
    r = page.select("page_id", H.profile().alias("p")).select("page_id", "p", D.source_class(F.col("p")).alias("c")).orderBy("page_id").collect()
    assert r[0]["p"]["tables"] == 1 and r[0]["p"]["has_json_ld"] and r[0]["p"]["role"] == "directory"
    assert (r[0]["c"]["page_type"], r[0]["c"]["confidence"]) == ("script_embedded_data", 0.9)
    assert r[1]["c"]["page_type"] == "unsupported_or_unclear"


def test_records(page):
    t = H.table_records(page).first()
    assert (t["name"], t["university_name"], t["website_url"]) == ("Alpha", "North College", "https://a.example.org")
    j = {r["name"]: r for r in H.json_records(page).collect()}
    assert j["Beta"]["city"] == "Reno" and j["Alpha"]["external_id"] == "1" and j["Beta"]["confidence"] == 1.0
    assert {r["name"] for r in H.stub_records(page).collect()} >= {"Gamma", "Delta"}


def test_links_zones_hints(page):
    assert [r["link"] for r in H.frontier_links(page).orderBy("ordinal").collect()] == ["https://site.example.org/x", "https://instagram.com/alpha_house"]
    zones = {r["zone_heading"]: r["zone_type"] for r in H.status_zones(page).collect()}
    assert zones["Recognized chapters"] == "recognized" and zones["Suspended"] == "suspended"
    h = H.contact_hints(page).where("page_id = 1").first()
    assert h["emails"] == ["bob@example.org"] and h["instagrams"] == ["https://www.instagram.com/alpha_house"]


def test_directory_links_are_the_best_of_all_links_by_whole_labels(spark):
    rng = random.Random(6)
    away = "".join(f'<a href="https://away{k}.example.org/">away</a>' for k in range(45))
    near = "".join(f'<a href="/p{k}">page {k}</a>' for k in range(45))
    late = '<a href="/chapters">Our Chapters</a><a href="/chapters?utm_source=x">again</a>'
    long = f'<a href="/long">{"word " * 60}find a chapter</a>'
    paths = [rng.choice(["chapters", "staff", "news", "about"]) + f"/{rng.randint(0, 400)}" for _ in range(600)]
    many = "".join(f'<a href="/{p}">{rng.choice(["Our Chapters", "Blog", ""])}</a>' for p in paths)
    pages = H.parsed(spark.createDataFrame([(1, "https://a.example.org/", away + late), (2, "https://b.example.org/", near + late), (3, "https://c.example.org/", long), (4, "https://d.example.org/", many)], "page_id int, url string, html string"))
    found = {k: [r for r in H.directory_links(pages).orderBy("page_id", "rank").collect() if r["page_id"] == k] for k in (1, 2, 3, 4)}
    assert [(r["link"], r["anchor"], r["ordinal"], r["score"]) for r in found[1]] == [("https://a.example.org/chapters", "Our Chapters", 45, 0.75)]
    assert [r["link"].split("/")[-1] for r in found[2]] == ["chapters", "p9", "p8", "p7", "p6", "p5", "p44", "p43"]
    assert [(r["score"], len(r["anchor"])) for r in found[3]] == [(0.5, 314)]
    # page 4 against a plain walk: the first label of each URL, all of them scored, then the best eight
    first = {}
    for p, label in zip(paths, re.findall(r">([^<]*)</a>", many), strict=True):
        first.setdefault(f"https://d.example.org/{p}", label)
    score = lambda u, label: max(0.0, min(1.0, 0.5 * (label == "Our Chapters") - 0.6 * (label == "Blog") + 0.25 * ("chapter" in u) - 0.35 * ("staff" in u or "news" in u)))
    best = sorted(((score(u, x), u) for u, x in first.items()), reverse=True)[:8]
    assert len(first) > 300 and [(r["score"], r["link"]) for r in found[4]] == best
    assert H.frontier_links(pages).where("page_id = 3").first()["anchor"] == ("word " * 60)[:180]
    assert [r["count"] for r in H.frontier_links(pages).groupBy("page_id").count().orderBy("page_id").collect()] == [40, 40, 1, 40]


def test_kml(spark):
    kml = "<kml><Placemark><name>North College - Alpha</name><description><![CDATA[Location: Austin, TX<br>Website: https://a.example.org]]></description></Placemark><Placemark><name>North College - Alpha</name></Placemark><Placemark><name>Solo</name></Placemark></kml>"
    r = H.kml_records(spark.createDataFrame([(1, kml)], "page_id long, html string")).orderBy("mark").collect()
    assert [(x["name"], x["university_name"], x["state"]) for x in r] == [("Alpha", "North College", "TX"), ("Solo", None, None)]


def test_rewards_and_stops(spark):
    i, b = (lambda v: F.lit(v)), (lambda v: F.lit(v))
    df = spark.range(1).select(D.immediate_reward(i(2), i(1), i(0), i(1), i(9), b(False), b(True), i(0), i(1)).alias("r"), D.stop_reason(i(5), i(5), i(3), i(0), i(0), i(0), i(0), i(0), i(0), F.lit(1.0), F.lit(0.0)).alias("s"))
    assert tuple(df.first()) == (pytest.approx(10 + 2 + 3 + 1.5 + 1.5 - 0.5), "page_budget_exhausted")


def test_status_prefers_active_on_ties(spark):
    m = spark.createDataFrame([(1, "recognized", 1, 1, 0.9, 0.9, 0.9), (1, "closed", 2, 1, 0.9, 0.9, 0.9), (2, "closed", 1, 2, 0.8, 0.7, 0.9)], "chapter_id long, zone_type string, zone_order int, authority_tier int, currentness double, zone_confidence double, match_confidence double")
    c = spark.createDataFrame([(1, False, False, "closed", 0.9), (2, False, False, None, None), (3, False, False, "dormant", 0.9), (4, True, False, None, None)], "chapter_id long, banned boolean, absent boolean, national string, national_confidence double")
    r = {x["chapter_id"]: x for x in D.chapter_status(c, m).collect()}
    assert [r[k]["final_status"] for k in (1, 2, 3, 4)] == ["active", "inactive", "review", "inactive"]
    assert set(r[1]["conflict_flags"]) == {"school_active_national_inactive_conflict", "stale_source_conflict"}
    assert r[3]["confidence"] == pytest.approx(0.82)


def test_best_records_first_wins(spark):
    rows = [(1, "A", "U", 0.8), (2, "a ", "u", 0.8), (3, "A", "U", 0.7)]
    df = spark.createDataFrame(rows, "ordinal int, name string, university_name string, source_confidence double").withColumns({c: F.lit(None).cast("string") for c in ("city", "state", "website_url", "instagram_url", "contact_email")})
    assert [r["ordinal"] for r in D.best_records(df).collect()] == [1]


def test_alias_join(spark):
    z = spark.createDataFrame([(1, "The ΦΔΘ house and Sigma Nu"), (2, "nothing")], "zone_id long, text string")
    a = spark.createDataFrame([(1, "Phi Delta Theta"), (2, "sigma nu"), (3, "zeta")], "fraternity_id long, alias string")
    assert sorted((r["zone_id"], r["fraternity_id"]) for r in D.alias_matches(z, a).collect()) == [(1, 1), (1, 2)]


def test_alias_join_takes_whole_aliases_of_any_length(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    aliases = sorted({" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 6, 7, 9) for _ in range(4)})
    z = spark.createDataFrame([*enumerate(texts), (99, None)], "zone_id long, text string")
    a = spark.createDataFrame([*enumerate(aliases), (99, " ")], "fraternity_id long, alias string")
    got = sorted((r["zone_id"], r["fraternity_id"]) for r in D.alias_matches(z, a).collect())
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, x in enumerate(aliases) if f" {x} " in f" {t} ")


def exclusive(rows):
    """Chapters take their best free handle, the lowest id first, until nobody takes one."""
    settled, free = {}, dict(sorted(rows.items()))
    while free:
        wants = {}
        for (c, h), s in free.items():
            if c not in wants or (-s, h) < (-wants[c][1], wants[c][0]):
                wants[c] = (h, s)
        taken = {}
        for c, (h, _) in wants.items():
            taken[h] = min(c, taken.get(h, c))
        settled |= {c: h for h, c in taken.items()}
        free = {(c, h): s for (c, h), s in free.items() if c not in settled and h not in taken}
    return settled


def test_exclusive_best_goes_on_until_nobody_is_left(spark):
    rng = random.Random(5)
    rows = {(rng.randint(0, 30), f"h{rng.randint(0, 12)}"): rng.randint(0, 4) / 4 for _ in range(150)}
    rows |= {(100 + k, "hot"): 1.0 for k in range(20)} | {(100 + k, f"h{k}x"): 0.5 for k in range(20)}
    c = spark.createDataFrame([(*k, s) for k, s in rows.items()], "chapter_id long, handle string, score double")
    assert {r["chapter_id"]: r["handle"] for r in D.exclusive_best(c).collect()} == exclusive(rows)
    assert D.exclusive_best(c.limit(0)).count() == 0


def test_exclusive_best(spark):
    c = spark.createDataFrame([(1, "h", 0.9), (2, "h", 0.95), (2, "g", 0.5)], "chapter_id long, handle string, score double")
    assert {(r["chapter_id"], r["handle"]) for r in D.exclusive_best(c).collect()} == {(1, "h"), (2, "g")}


def test_merge_rules_and_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "u1", 5), (2, "b", None, 1)], "id int, name string, url string, score int")
    new = spark.createDataFrame([(1, "A", None, 3), (3, "c", "u3", 9)], "id int, name string, url string, score int")
    table = M.Snapshots(spark, str(tmp_path / "t"))
    assert table.version() == 0
    table.write(old)
    for _ in range(2):  # merging again changes nothing
        table.write(M.merged(table.read(), new, ["id"], fill=["url"], greatest=["score"]))
        assert sorted(map(tuple, table.read().collect())) == [(1, "A", "u1", 5), (2, "b", None, 1), (3, "c", "u3", 9)]
    assert table.version() == 3 and table.read(1).count() == 2


def test_review_transitions(spark):
    items = spark.createDataFrame([(1, "open"), (2, "resolved")], "id int, status string")
    changes = spark.createDataFrame([(1, "triaged"), (2, "open")], "id int, to string")
    good, bad = M.transitioned(items, changes)
    assert sorted(map(tuple, good.collect())) == [(1, "triaged"), (2, "resolved")] and bad.count() == 1


def test_streams(spark, tmp_path):
    from quillmesh.streaming import events as E

    src = str(tmp_path / "in")
    spark.createDataFrame([(i, i % 3, "error" if i < 4 else "view", float(i)) for i in range(8)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600).cast("timestamp_ntz")).coalesce(1).write.parquet(src)
    stream = E.event_stream(spark, src)
    found = []
    E.run_available(E.breaker(stream.select(F.lit("k").alias("key"), "ts", (F.col("event_type") == "error").alias("failed"))), lambda df, _: found.extend(df.orderBy("ts").collect()), str(tmp_path / "c1"))
    assert [r["streak"] for r in found] == [1, 2, 3, 4, 0, 0, 0, 0] and found[2]["open"]
    E.run_available(stream.select(F.col("event_type").alias("key"), "value"), E.running_means(spark, str(tmp_path / "m")), str(tmp_path / "c2"))
    assert {r["key"]: r["n"] for r in M.Snapshots(spark, str(tmp_path / "m")).read().collect()} == {"error": 4, "view": 4}


def test_registry_seeds_and_sinks(spark, page, tmp_path):
    import json

    from quillmesh.plans import api, catalogue
    from quillmesh.sources import records as R

    plans = spark.createDataFrame([(1, "script_json")], "page_id long, primary string")
    assert {r["name"] for r in R.extracted(page, plans).collect()} == {"Alpha", "Beta"}
    path = tmp_path / "seed.json"
    path.write_text(json.dumps([{"name": "Phi & Delta", "base": "https://a.example.org", "status": 200, "chapterish_links": [{"text": "x", "url": "y"}]}]))
    s = R.seeds(spark, str(path)).first()
    assert (s["fraternity_slug"], s["confidence"]) == ("phi-and-delta", 0.85)
    df = spark.createDataFrame([(1, '[{"a": 1}, {"a": 2}]')], "id long, j string")
    assert [r["a"] for r in R.unnested(df, "id", "j", "a:int").orderBy("ordinal").collect()] == [1, 2]
    assert "| id |" in R.markdown("t", df.select("id")) and json.loads(R.envelope(df.select("id"))) == {"success": True, "data": [{"id": 1}]}
    known = set(catalogue.queries())
    assert all(q in known for names in [*api.COMMANDS.values(), *api.ROUTES.values()] for q in names)


def test_validity_and_searches(spark):
    rows = [("Home", None), ("2019", "U"), ("Alpha Beta", "West College"), ("John Smith", "West College"), ("Alpha", None)]
    df = spark.createDataFrame(rows, "name string, school string")
    from quillmesh.functions import scalars as S

    got = [r["v"] for r in df.select(D.validity(F.col("name"), F.col("school"), S.institution_signals("school"), S.greek_phrases("name")).alias("v")).collect()]
    assert got == ["invalid_non_chapter", "invalid_non_chapter", "canonical_valid", "invalid_non_chapter", "repairable_candidate"]
    res = spark.createDataFrame([("alpha west college", "https://x.org", "Alpha of West", ""), ("q two", "https://junk.example", "none", "")], "query string, url string, title string, snippet string")
    assert {r["query"]: r["low_signal"] for r in D.low_signal_queries(res, ["junk.example"]).collect()} == {"alpha west college": False, "q two": True}
    z, a = spark.createDataFrame([(1, "Sigma Nuu")], "zone_id long, text string"), spark.createDataFrame([(7, "Sigma Nu")], "fraternity_id long, alias string")
    assert D.fuzzy_alias_matches(z, a).first()["fraternity_id"] == 7
