"""Campus policies, a case a branch."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import campuses as C

CASES = [
    ("Rice University", "https://example.com/rules", "", "no greek life at rice university", "non_official_school_source"),
    ("Rice University", None, None, None, "non_official_school_source"),
    (None, "https://rice.edu", "", "no greek life", "non_official_school_source"),
    ("Rice University", "https://www.riceu.org/", "", "greek life", "no_conclusive_policy_signal"),
    ("Baylor University", "https://bu.baylor.edu/", "", "Welcome", "no_conclusive_policy_signal"),
    ("Massachusetts Institute of Technology", "https://mit.edu/", "Greek life", "recognized chapters", "school_identity_missing"),
    ("University of Texas", "https://utexas.edu/", "", "There are  no fraternities and no greek life", "strong_ban_phrase"),
    ("Rice University", "https://rice.edu/life", "Rice", "Recognized chapters of the Interfraternity Council", "current_official_greek_life_context"),
    ("Rice University", "https://rice.edu/life", "Rice", "Recognized chapters: hazing violations", "no_conclusive_policy_signal"),
    ("Rice University", "https://rice.edu/life", "Rice", "x" * 2400 + " recognized chapters", "no_conclusive_policy_signal"),
]
POLICY = {"strong_ban_phrase": ("banned", 0.97), "current_official_greek_life_context": ("allowed", 0.9), "no_conclusive_policy_signal": ("unknown", 0.28)}


@pytest.mark.parametrize("n", [1])
def test_greek_policies(spark, n):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "i int, school string, url string, title string, text string")
    got = {r["i"]: tuple(r["x"]) for r in df.repartition(n).select("i", C.greek_policy(*map(F.col, ("school", "url", "title", "text"))).alias("x")).collect()}
    assert {i: g[2] for i, g in got.items()} == {i: c[4] for i, c in enumerate(CASES)}
    assert all(g[:2] == POLICY.get(g[2], ("unknown", 0.0)) for g in got.values())
