"""Names in texts against plain searches, both ways of finding them; guards, contacts and jobs case by case."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import candidates as C
from quillmesh.operators import organisations as O


def plain_marks(text, keys):
    words = text.split(" ")
    return sorted((k, i) for k in keys for i in range(len(words)) if words[i : i + len(k.split(" "))] == k.split(" "))


def test_automaton_finds_what_a_plain_search_finds():
    rng = random.Random(1)
    for _ in range(300):
        keys = sorted({" ".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        text = " ".join(rng.choices("abcd", k=rng.randint(1, 80)))
        automaton = O.WordAutomaton(keys)
        assert sorted((keys[n], end - keys[n].count(" ")) for n, end in automaton.scan(text.split(" "))) == plain_marks(text, keys)


@pytest.mark.parametrize("most", [O.AUTOMATON_WORDS, 0])
def test_marks_of_both_ways(spark, most):
    rng = random.Random(2)
    keys = sorted({" ".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(20)})
    texts = [(i, " ".join(rng.choices(["a", "B", "c", "d", "Ω"], k=rng.randint(0, 40))), "x") for i in range(40)] + [(99, None, None), (98, "", "y"), (97, "a b c " * 30_000, "z")]
    df = spark.createDataFrame(texts, "id long, text string, at string")
    got = O.marks(df.withColumnRenamed("at", "extra"), spark.createDataFrame([(k,) for k in keys for _ in (1, 2)], "key string"), "id", most=most)
    want = [(i, e, k, at) for i, t, e in texts if i < 97 for k, at in plain_marks((t or "").lower().replace("ω", "omega").replace("  ", " "), keys)]
    rows = got.where("id <> 97").collect()
    assert sorted((r["id"], r["extra"], r["key"], r["at"]) for r in rows) == sorted(want) and got.where("id = 97").count() >= 90_000
    assert O.marks(df.limit(0).drop("at"), spark.createDataFrame([], "key string"), "id", most=most).count() == 0


def test_names_in_order(spark):
    o = spark.createDataFrame([(1, "Phi Gamma Delta", "phi-gamma-delta", ["Phi Gam", "FIJI"]), (2, "ΣΧ", "sigma-chi", None), (3, None, None, None)], "organisation_id int, name string, slug string, aliases array<string>")
    by = {}
    for r in O.names(o).orderBy("organisation_id", "rank").collect():
        by.setdefault(r["organisation_id"], []).append((r["key"], r["nickname"]))
    assert by == {1: [("phi gamma delta", False), ("phi gam", False), ("fiji", True)], 2: [("sigma chi", False)]}


ORGS = [(1, "Sigma Chi", "sigma-chi", None), (2, "Delta Chi", "delta-chi", None), (3, "Phi Gamma Delta", "phi-gamma-delta", None), (4, "Phi Kappa", "phi-kappa", None)]
ZONES = {
    1: ("Recognized fraternities: Sigma Chi", None, [(1, "sigma chi", "exact_alias")]),
    2: ("Sigma Chi", None, []),  # no context
    3: ("Come to the FIJI house", None, [(3, "fiji", "nickname")]),
    4: ("FIJI chapter, Delta Chi chapter", None, [(2, "delta chi", "exact_alias"), (3, "fiji", "exact_alias")]),
    5: ("Sigma Chi chapter at the University of Ohio", "Rice University", []),  # another campus
    6: ("Sigma Chi chapter at Rice University, once at Ohio University", "Rice University", [(1, "sigma chi", "exact_alias")]),
    7: ("University and University list, RU, Sigma Chi chapter", "Rice University", []),  # twice a university, not this one
    8: ("TTU college chapters: Sigma Chi", "Texas Tech University", [(1, "sigma chi", "exact_alias")]),
    9: ("Phi Kappa chapter", None, []),  # too short to tell
    10: ("The greek delta chi phi gamma delta", "", [(2, "delta chi", "exact_alias"), (3, "phi gamma delta", "exact_alias")]),
    11: ("chapter of sigmachi and deltachi", None, []),
    12: (None, None, []),
}


@pytest.mark.parametrize("most", [O.AUTOMATON_WORDS, 0])
def test_zone_guards(spark, most):
    zones = spark.createDataFrame([(k, t, s) for k, (t, s, _) in ZONES.items()], "zone_id int, text string, school string")
    orgs = spark.createDataFrame(ORGS, "organisation_id int, name string, slug string, aliases array<string>")
    got = {k: [] for k in ZONES}
    for r in O.zone_matches(zones, orgs, most).orderBy("organisation_id").collect():
        got[r["zone_id"]].append((r["organisation_id"], r["alias"], r["method"]))
    assert got == {k: want for k, (_, _, want) in ZONES.items()}


CONFLICTS = [
    ("Sigma Chi", "sigma-chi", "Kappa Sigma chapters", True),
    ("Sigma Chi", "sigma-chi", "Sigma Chi and Kappa Sigma", False),  # its own name is there, too
    ("Sigma Chi", "sigma-chi", "sigmachi.org Delta Chi", False),  # by its joined slug
    ("Phi Gamma Delta", "phi-gamma-delta", "FIJI and Delta Chi", False),
    ("Phi Gamma Delta", "phi-gamma-delta", "pgd: Delta Chi", False),  # three initials
    ("Sigma Chi", "sigma-chi", "sc: Delta Chi", True),  # two don't count
    ("Sigma Chi", "sigma-chi", "alpha only", False),
    ("Sigma Chi", "sigma-chi", "ΔΧ house", True),
    (None, None, "Delta Chi", False),
    ("Sigma Chi", "sigma-chi", None, False),
]


def test_conflicting_names(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CONFLICTS)], "i int, name string, slug string, t string")
    got = {r["i"]: r["c"] for r in df.select("i", O.names_another(F.col("name"), F.col("slug"), F.col("t")).alias("c")).collect()}
    assert got == {i: c[3] for i, c in enumerate(CONFLICTS)}
    row = df.limit(1).select(C.source_identity(F.lit("https://x.org/chapters"), F.lit("Kappa Sigma chapters"), F.lit(""), F.lit("Sigma Chi"), F.lit("sigma-chi")).alias("g")).first()["g"]
    assert (row["decision"], row["confidence"], row["reason"]) == ("reject", 0.05, "cross_fraternity_conflict")


JOBS = [  # slug, chapter, chapter slug, school, text, (organisation, school, school conflict, chapter)
    ("sigma-chi", "Beta Rho", None, "Texas Tech University", "sigma chi at texas tech", (True, True, False, False)),
    ("sigma-chi", "Red Raider Chapter", None, "Texas Tech University", "raider", (False, False, False, True)),
    ("sigma-chi", "Texas Tech Chapter", "lubbock-house", "Texas Tech University", "lubbock", (False, False, False, True)),
    ("phi-gamma-delta", None, None, "University of Texas", "fiji of the north university of texas", (True, False, True, False)),
    ("phi-gamma-delta", None, None, "University of Texas", "the university of texas", (False, True, False, False)),
    ("phi-gamma-delta", None, None, "University of Texas", "texas state", (False, False, True, False)),
    ("phi-gamma-delta", None, None, "Florida State University", "university of florida", (False, False, True, False)),
    ("phi-gamma-delta", None, None, "Florida State University", "florida state university and university of florida", (False, True, False, False)),
    ("tau-kappa-epsilon", None, None, "Rice University", "epsilon of tau near kappa rice", (True, True, False, False)),  # Greek words in any order
    ("farmhouse-national", None, None, None, "the farmhouse", (True, False, False, False)),
    (None, None, None, None, "anything", (False, False, False, False)),
]


def test_job_matches(spark):
    df = spark.createDataFrame([(i, *j[:5]) for i, j in enumerate(JOBS)], "i int, slug string, chapter string, chapter_slug string, school string, t string")
    df = df.withColumn("job", O.job_facts(F.col("slug"), F.col("chapter"), F.col("chapter_slug"), F.col("school")))
    tests = (O.organisation_matches, O.school_matches, O.school_conflicts, O.chapter_matches)
    got = {r[0]: tuple(r[1:]) for r in df.select("i", *(f(F.col("job"), F.col("t")).alias(f.__name__) for f in tests)).collect()}
    assert got == {i: j[5] for i, j in enumerate(JOBS)}


MAILS = [  # address, provider, page, text, {fact: value}
    ("info@sigmachi.org", "search_page", "https://x.org/", "", {"office": True, "identity": False, "relevant": False}),
    ("office@x.org", "chapter_website", "https://x.org/", "Contact Sigma Chi at Texas Tech", {"office": True, "contact_page": True, "relevant": True}),
    ("sigmachi.ttu@gmail.com", "search_page", "https://x.org/", "Texas Tech", {"identity": True, "relevant": True, "person": True}),
    ("ttu99@gmail.com", "search_page", "https://x.org/", "nothing", {"identity": True, "relevant": False}),
    ("jane.doe@ttu.edu", "search_page", "https://x.org/", "Sigma Chi, Texas Tech", {"person": True, "identity": False, "known_domain": True, "overlap": 5, "relevant": True}),
    ("jane.doe@x.org", "search_page", "https://x.org/", "Sigma Chi, Texas Tech", {"known_domain": False, "relevant": False}),
    ("jane.doe@mail.own.org", "provenance", "https://x.org/", "nothing", {"known_domain": True, "relevant": True}),
    ("jane.doe@mail.own.org", "provenance", "https://x.org/", "Delta Psi", {"known_domain": True, "relevant": False}),
    ("jane.doe@ttu.edu", "search_page", "https://www.ttu.edu/", "president of the club, Texas Tech", {"relevant": False, "contact_page": True}),  # a school's page that names nobody
    ("jane.doe@ttu.edu", "search_page", "https://x.org/", "president, Texas Tech scholarships", {"relevant": True, "low_signal": True}),
    ("betarho@gmail.com", "search_page", "https://x.org/", "Sigma Chi", {"identity": True, "relevant": True}),
]


def test_mail_facts(spark):
    df = spark.createDataFrame([(i, *m[:4]) for i, m in enumerate(MAILS)], "i int, email string, provider string, url string, t string")
    df = df.withColumn("job", O.job_facts(F.lit("sigma-chi"), F.lit("Beta Rho"), F.lit(None).cast("string"), F.lit("Texas Tech University")))
    campus, source, website = F.array(F.lit("ttu.edu")), F.lit("https://own.org/list"), F.lit(None).cast("string")
    df, looks = O.mail_facts(df, F.col("email"), F.col("job"), F.col("provider"), F.col("url"), F.lit(""), F.col("t"), C.website_tier(F.col("url"), campus, source), campus, source, website)
    for r in df.select("i", *(v.alias(k) for k, v in vars(looks).items())).collect():
        want = MAILS[r["i"]][4]
        assert {k: r[k] for k in want} == want, MAILS[r["i"]]
