"""Template profiles, observed rewards, scores and choices against plain Python, one decision after the other."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import policies as P

VISIT = "signature string, host_family string, ts int, id int, action string, family string, chapter_yield long, contact_yield long, timeout boolean, empty boolean"


def plain_profiles(visits, asks):
    """Each upsert in turn, with exact means."""
    out, state = {}, {}
    steps = [(v[2], v[3], 1, v) for v in visits if v[0] is not None and v[1] is not None] + [(a[2], a[3], 0, a) for a in asks]
    for _, _, kind, row in sorted(steps, key=lambda s: s[:3]):
        key = row[:2]
        p = state.get(key)
        if kind == 0:
            out[row[3]] = None if p is None else (p["n"], *(p["s"][i] / p["n"] for i in range(4)), *p["best"])
            continue
        new = [row[6] or 0, row[7] or 0, int(row[9] or 0), int(row[8] or 0)]
        if p is None:
            state[key] = {"n": 1, "s": new, "best": row[4:6]}
            continue
        if (new[0] + new[1]) * p["n"] >= p["s"][0] + p["s"][1]:
            p["best"] = row[4:6]
        p["n"] += 1
        p["s"] = [a + b for a, b in zip(p["s"], new, strict=True)]
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_profiles_before(spark, partitions):
    draw = random.Random(3)
    key = lambda: draw.choice([("hot", "h")] * 4 + [("a", "h"), ("a", "g"), (None, "h")])
    visits = [(*key(), draw.randrange(60), i, draw.choice("xyz"), draw.choice(["f", "g", None]), draw.choice([0, 1, 2, 5, None]), draw.randrange(3), draw.random() < 0.2, draw.choice([True, False, None])) for i in range(400)]
    asks = [(*key(), draw.choice([*range(60), 1000]), i, "kept") for i in range(100, 500)] + [("never", "seen", 5, 900, "kept")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = P.profiles_before(spark.createDataFrame(visits, VISIT), spark.createDataFrame(asks, "signature string, host_family string, ts int, id int, more string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r["more"] for r in got} == {"kept"} and len(got) == len(asks)
    assert {r["id"]: r["profile"] and tuple(r["profile"]) for r in got} == plain_profiles(visits, asks)


def test_profiles_of_empty_tables(spark):
    none = spark.createDataFrame([], VISIT)
    asks = spark.createDataFrame([("s", "h", 1, 1)], "signature string, host_family string, ts int, id int")
    assert P.profiles_before(none, asks).first()["profile"] is None
    assert P.profiles_before(none, asks.limit(0)).count() == 0


def test_observed_before(spark):
    draw = random.Random(4)
    rewards = [(draw.randrange(30), i, draw.choice(["a", "b", "c", "other"]), draw.choice([None, 1.5, -2.25, 0.1234])) for i in range(300)]
    asks = [(draw.randrange(31), i) for i in range(250, 350)]
    got = P.observed_before(spark.createDataFrame(rewards, "ts int, id int, action string, reward double"), spark.createDataFrame(asks, "ts int, id int"), ["a", "b", "c"]).collect()
    assert len(got) == len(asks)
    for r in got:
        for a in "abc":
            seen = [x for t, i, b, x in rewards if b == a and x is not None and (t, i) < (r["ts"], r["id"])]
            assert r["observed"].get(a) == (pytest.approx(sum(seen) / len(seen)) if seen else None)


PROFILE = "struct<chapter_yield:double,contact_yield:double,empty_rate:double,timeout_rate:double,best_action:string,best_family:string>"
CONTEXT = f"page_type string, role string, has_map boolean, has_script_json boolean, tables int, repeated int, keyword double, profile {PROFILE}, observed map<string,double>, timeout_risk double, requeue_risk double"


def scores(spark, **given):
    base = dict(page_type="article", role="detail", has_map=False, has_script_json=False, tables=0, repeated=0, keyword=0.0, profile=None, observed={}, timeout_risk=0.0, requeue_risk=0.0) | given
    row = tuple(base[c.split(" ")[0]] for c in CONTEXT.split(", "))
    return {r["action"]: r["score"] for r in P.action_scores(spark.createDataFrame([row], CONTEXT)).collect()}


def test_action_scores_by_branch(spark):
    plain = scores(spark)
    assert plain == P.PRIORS

    def gains(**given):
        return {a: round(x - P.PRIORS[a], 4) for a, x in scores(spark, **given).items() if x != P.PRIORS[a]}

    assert gains(has_map=True) == {"extract_locator_api": 2.0}
    assert gains(has_script_json=True) == {"extract_script_json": 1.7}
    assert gains(tables=9) == {"extract_table": 2.1}
    assert gains(tables=None, repeated=None) == {}
    assert gains(repeated=3) == {"extract_repeated_block": 1.5}
    assert gains(role="index") == dict.fromkeys(P.EXPANDING, 0.5)
    assert gains(page_type="locator_map") == {"extract_stubs_only": 0.6}
    assert gains(role="directory", page_type="static_directory").get("extract_stubs_only") == 0.6
    assert gains(observed={"skip_page": 2.0, "other": 9.0}) == {"skip_page": 0.4}
    assert gains(timeout_risk=2.0, requeue_risk=0.5) == dict.fromkeys(["expand_internal_links", "expand_map_children", "extract_locator_api"], -0.925)
    assert gains(keyword=2.0) == dict.fromkeys(P.PRIORS, 0.3)
    both = gains(profile=(4.0, 1.0, 0.5, 0.25, "extract_table", "extract_table"))
    assert both.pop("extract_table") == 2.75 and set(both.values()) == {0.15}


JOB = "field_type string, supporting_page boolean, supporting_scope string, website_unmet boolean, school_status string, healthy boolean, degraded boolean, queries int, identity boolean, website boolean, target boolean, authoritative boolean, observed map<string,double>, timeout_risk double, requeue_risk double"


def test_enrichment_scores_by_branch(spark):
    calm = dict(field_type="find_email", supporting_page=False, supporting_scope=None, website_unmet=False, school_status="matched", healthy=False, degraded=False, queries=0, identity=True, website=False, target=False, authoritative=False, observed=None, timeout_risk=0.0, requeue_risk=0.0)

    def gains(**given):
        row = tuple((calm | given)[c.split(" ")[0]] for c in JOB.split(", "))
        got = {r["action"]: r["score"] for r in P.enrichment_scores(spark.createDataFrame([row], JOB)).collect()}
        return {a: round(x - P.ENRICH_PRIORS[a], 4) for a, x in got.items() if x != P.ENRICH_PRIORS[a]}

    assert gains() == {}
    assert gains(supporting_page=True) == {"parse_supporting_page": 2.0}
    assert gains(supporting_page=True, supporting_scope="chapter_site") == {"parse_supporting_page": 2.45}
    assert gains(school_status=None) == gains(school_status="unknown") == gains(authoritative=True) == gains(field_type="verify_school") == {"verify_school": 1.5}
    assert gains(field_type="find_website") == gains(website=True) == {"verify_website": 1.35}
    assert gains(healthy=True) == {"search_web": 1.0}
    assert gains(healthy=True, supporting_page=True, field_type="find_instagram") == {"parse_supporting_page": 2.0, "search_social": 0.95}
    assert gains(degraded=True) == gains(website_unmet=True) == gains(identity=False) == {"defer": 1.45}
    assert gains(identity=None, target=True) == {"defer": 1.45, "review_required": 0.7}
    assert gains(queries=3) == {"stop_no_signal": 0.85} and gains(queries=3, healthy=True) == {"search_web": 1.0}
    assert gains(timeout_risk=1.0, observed={"defer": -1.0}) == {"search_web": -0.75, "search_social": -0.75, "defer": -0.2}


def chosen(spark, rows, **given):
    df = spark.createDataFrame([(1, n, a, s, t, q) for n, (a, s, t, q) in enumerate(rows)], "id int, place int, action string, score double, timeout_risk double, requeue_risk double")
    r = P.chosen_action(df, "id", **given).first()
    return r["action"], r["flags"]


def test_guards(spark):
    risky = [("extract_locator_api", 3.0, 0.8, 0.7), ("search_web", 2.0, 0.8, 0.7), ("extract_table", 1.0, 0.8, 0.7)]
    assert chosen(spark, risky) == ("extract_table", ["high_timeout_risk", "high_requeue_risk"])
    assert chosen(spark, risky[:2]) == ("extract_locator_api", ["high_timeout_risk", "high_requeue_risk"])
    assert chosen(spark, risky, training=F.lit(True)) == chosen(spark, risky, shadow=True) == chosen(spark, risky, guarded=False) == ("extract_locator_api", [])
    near = [("skip_page", 1.0, 0.0, 0.0), ("expand_internal_links", 1.05, 0.0, 0.0)]
    assert chosen(spark, near) == ("skip_page", ["prefer_safer_near_tie"])
    assert chosen(spark, [("skip_page", 0.99, 0.0, 0.0), near[1]]) == ("expand_internal_links", [])
    assert chosen(spark, [("skip_page", 1.0, None, None), ("extract_table", 1.0, None, None)]) == ("skip_page", [])


def test_exploring(spark):
    df = spark.range(3000).select("id", F.inline(F.array(*(F.struct(F.lit(n).alias("place"), F.lit(a).alias("action"), F.lit(s).alias("score")) for n, (a, s) in enumerate([("a", 2.0), ("b", 1.0), ("c", 0.0)])))))
    got = P.chosen_action(df, "id", guarded=False, epsilon=0.3, seed=5)
    counts = {r["action"]: r["count"] for r in got.groupBy("action").count().collect()}
    assert sum(counts.values()) == 3000 and 0.75 < counts["a"] / 3000 < 0.85 and min(counts["b"], counts["c"]) > 220
    assert got.where("not explored and action <> 'a'").count() == 0
    assert sorted(got.collect()) == sorted(P.chosen_action(df.repartition(5), "id", guarded=False, epsilon=0.3, seed=5).collect())
