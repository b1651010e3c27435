import pytest
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


CASES = [
    (S.slugify, "  Ohio State -- University! ", "ohio-state-university"),
    (S.school_slug, "Université de Montréal", "université-de-montréal"),
    (S.school_slug_edges, "Ohio State U.", "ohio-state-u-"),
    (S.compact_key_quirk, "Ohio State University", "hiotateniversity"),
    (S.compact_key, "Ohio State University", "ohiostateuniversity"),
    (S.discovery_slug, "ΦΔΘ & Co", "phi-delta-theta-and-co"),
    (S.state_code, "New-York", "NY"),
    (S.state_code_strict, "New-York", None),
    (S.state_code, "tx", "TX"),
    (S.state_code, "nowhere", None),
    (S.canonical_url, "HTTP://Www.Example.COM/a/b/?utm_source=x&q=1&ref=y#top", "http://www.example.com/a/b?q=1"),
    (S.canonical_url, "https://example.com", "https://example.com/"),
    (S.host_family, "https://a.b.example.org/x", "example.org"),
    (S.route_class, "/find-a-chapter/texas", "chapter-directory"),
    (S.route_class, "/", "root"),
    (S.route_class, "/texas/12/zz/yy", "generic:state-num-zz"),
    (S.as_website, "//example.com/a#b", "https://example.com/a"),
    (S.as_website, "mailto:a@b.co", None),
    (S.as_email, "mailto:Bob%40Example.com?subject=x", "bob@example.com"),
    (S.as_email, "a+b@example.com", "a+b@example.com"),
    (S.as_instagram, "@some.house", "https://www.instagram.com/some.house"),
    (S.as_instagram, "https://instagram.com/p/", None),
    (S.as_instagram, "index.html", None),
    (S.instagram_kind, "https://www.instagram.com/reel/abc", "reel"),
    (S.instagram_kind, "https://www.instagram.com/house_tx/", "profile"),
    (S.instagram_kind, None, "other"),
    (S.deobfuscated, "bob (at) example [dot] com", "bob@example.com"),
    (S.calm_title, "ALPHA BETA", "Alpha Beta"),
    (S.initials, "University of the North", "un"),
    (S.greek_names, "ΧΦ", "chi phi"),
    (S.school_in, "a house at the University of Texas", "University of Texas"),
    (S.without_host, "example.com|role|t1", "role|t1"),
    (S.contact_specificity, "chapter_site", "chapter_specific"),
    (S.search_target, "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fb&x=1", "https://a.example/b"),
    (S.search_target, "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9hLmV4YW1wbGUvYg&x=1", "https://a.example/b"),
]


@pytest.mark.parametrize("fn, value, want", CASES)
def test_cases(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_keyword_score_counts_parts_of_words(spark):
    assert one(spark, S.keyword_score, "our Chapters") == pytest.approx(4.2)


def test_lists_and_structs(spark):
    assert one(spark, S.emails_in, "A@x.org b@y.com a@X.org") == ["a@x.org", "b@y.com"]
    assert one(spark, S.described, "City: Austin<br>Site: http://x.org") == {"city": "Austin", "site": "http://x.org"}
    assert tuple(one(spark, S.city_state, "Austin, TX")) == ("Austin", "TX")
    assert one(spark, S.greek_phrases, "the Alpha Beta house") == ["Alpha Beta"]
    assert one(spark, S.looks_like_person, "John Smith") is True
    assert tuple(one(spark, S.heading_parts, "Alpha - State College")) == ("Alpha", "State College")
    made = one(spark, lambda c: S.as_candidate(c, "website"), "@house")
    assert (made["kind"], made["coerced"]) == ("instagram", True)
