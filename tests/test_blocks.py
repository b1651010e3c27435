"""Trees, blocks and stubs of made pages against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.sources import blocks as B

GREEK = ["sigma", "chi", "kappa"]


def made_tree(rng, depth=0):
    """(tag, children) with words and links among the children."""
    tag = rng.choice(["div", "li", "section", "span", "td", "p", "article"])
    words = ["rice university", "Rice", "University", "Sigma Chi", "Σ", "kappa", "and more", "x", "Delta-Chi"]
    kids = [rng.choice(words) if rng.random() < 0.5 or depth > 4 else ("a", [rng.choice(words)]) if rng.random() < 0.3 else made_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))]
    return tag, kids


def shown(node):
    if isinstance(node, str):
        return f" {node} "
    return f"<{node[0]}{' href=/x' if node[0] == 'a' else ''}>{''.join(map(shown, node[1]))}</{node[0]}>"


def pieces(node):
    """Texts between tags, those side by side in one."""
    out, last = [], False
    for kid in node[1]:
        if isinstance(kid, str):
            if last:
                out[-1] += f"  {kid}"
            else:
                out.append(kid)
            last = True
        else:
            out += pieces(kid)
            last = False
    return out


def plain_best(root, phrases, own):
    """(score, text) of the best block, by walking every subtree anew."""
    best = (0, None)

    def links(node):
        return sum((k[0] == "a") + links(k) for k in node[1] if not isinstance(k, str))

    def visit(node):
        nonlocal best
        text = " ".join(pieces(node))
        letters = B.re.sub("[^a-z0-9]", "", B.normal(text))
        if node[0] in B.BLOCK_TAGS and any(p in letters for p in phrases):
            greek = {w for w in B.re.findall("[a-z]+", B.normal(text)) if w in set(B.S.GREEK.values())}
            score = 3 + min(2, len(greek)) + (own in letters) + (links(node) > 0)
            if score > best[0]:
                best = (score, text)
        for kid in node[1]:
            if not isinstance(kid, str):
                visit(kid)

    visit(root)
    return best


def test_best_blocks_equal_a_walk_of_every_subtree(spark):
    rng = random.Random(4)
    roots = {i: ("body", [made_tree(rng) for _ in range(3)]) for i in range(150)}
    df = spark.createDataFrame([(i, "https://x.org/a/", shown(r), "Rice University", "Sigma Chi") for i, r in roots.items()], "page_id int, url string, html string, school string, organisation string")
    got = {r["page_id"]: r for r in B.directory_blocks(df).collect()}
    for i, root in roots.items():
        score, text = plain_best(root, {"riceuniversity", "rice"}, "sigmachi")
        r = got[i]
        assert r["score"] == score and r["decision"] == ("matched_block" if score else "no_match") and r["confidence"] == (round(min(0.96, 0.55 + 0.08 * score), 4) if score else 0.0)
        assert (r["block"] or "").split() == (text or "")[:1200].split(), (shown(root), text)


def test_odd_pages_and_deep_ones(spark):
    deep = "<div>" * 3000 + "Rice University" + "</div>" * 3000
    many = "<div>" + "<a href=q>Rice University</a>" * 3000 + "</div>"
    pages = [(1, None, None), (2, "", "Rice"), (3, "<div>Rice", "Rice"), (4, "</div></p>Rice", "Rice"), (5, deep, "Rice"), (6, many, "Rice"), (7, "<li>University of <b>Texas</b> Austin<li>x", "University of Texas Austin"), (8, "<div>x</div>", None)]
    df = spark.createDataFrame([(i, "https://x.org/", h, s, None) for i, h, s in pages], "page_id int, url string, html string, school string, organisation string")
    got = {r["page_id"]: (r["score"], None if r["links"] is None else len(r["links"])) for r in B.directory_blocks(df).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (3, 0), 4: (0, None), 5: (3, 0), 6: (4, 10), 7: (3, 0), 8: (0, None)}
    assert B.directory_blocks(df.limit(0)).count() == 0


SCRIPTS = [
    ("var a = {b: 1, 'c': \"x}\", d: {e: `f`}};", [{"e": "f"}, {"b": "1", "c": "x}"}]),
    ("{a: 'it\\'s', // {no: 1}\n b: 2 /* } */}", [{"a": "it's", "b": "2"}]),
    ("[{a: 1}, {a: 2}]", [{"a": "1"}, {"a": "2"}]),
    ("{a: [1, 2, {b: 3}], c: fn(x), d: -1.5}", [{"b": "3"}, {"c": "fn", "d": "-1.5"}]),
    ("if (x) { y } {a: 1", []),
    ("} ] {a: 'b'}", [{"a": "b"}]),
    ("{a: 'open", []),
    ("{}", []),
]


@pytest.mark.parametrize("script,want", SCRIPTS)
def test_objects_in_scripts(script, want):
    assert list(B.script_objects(script)) == want


def read(spark, reader, html, url="https://x.org/list", wix=False):
    t = B.trees(spark.createDataFrame([(1, url, html, wix)], "page_id int, url string, html string, wix boolean"))
    return sorted((r["name"], r["university_name"], r["detail_url"], r["outbound_url"], round(r["confidence"], 4), r["provenance"]) for r in reader(t).collect())


def test_anchors(spark):
    html = """<h2>Beta Rho</h2><p>at Rice University <a href="/chapters/br">Go to site</a></p><div>Texas Tech University <a href="https://y.org/find-a-chapter/z">Zeta chapter profile</a> <a href="/news/chapters">Our chapters in short</a>
        <a href="mailto:c@x.org">our chapters</a> <a href="">our chapters</a> <a href="/q">chapter news</a></div><a href="/chapters">our chapters, staff directory</a>"""
    first, second = "https://x.org/chapters/br", "https://y.org/find-a-chapter/z"
    want = [("Beta Rho", "Rice University", first, first, 0.95, "anchor_list"), ("Zeta chapter profile", "Tech University", second, second, 0.95, "anchor_list")]
    assert read(spark, B.anchor_stubs, html) == want


def test_map_objects(spark):
    html = """<script>m = {'TX': {'hover': '<p>TEXAS o\\'brien</p>', 'url': 'https://x.org/tx'}, ny: {url: "https://x.org/ny", hover: "<p>new york</p>"}, c: {hover: "<p>again</p>", url: "https://x.org/ny"}, d: {hover: "no", url: "https://x.org/d"}, e: {hover: "<p>x</p>", url: "/e"}}</script>"""
    x, y = "https://x.org/tx", "https://x.org/ny"
    assert read(spark, B.map_stubs, html) == [("New York", None, y, y, 0.78, "map_config"), ("Texas O'Brien", None, x, x, 0.78, "map_config")]


def test_wix_links(spark):
    html = """<div>all <a href="/chapters/">All</a></div><div><a href="/chapters/beta-rho">Read</a></div><section>At Rice University <a href="/chapters/x">More</a></section><a href="https://other.org/chapters/y">no</a>"""
    want = [("Beta Rho", None, "https://x.org/chapters/beta-rho", "https://x.org/chapters/beta-rho", 0.78, "wix_chapter_link"), ("Rice University", "Rice University", "https://x.org/chapters/x", "https://x.org/chapters/x", 0.78, "wix_chapter_link")]
    assert read(spark, B.wix_stubs, html, wix=True) == want and read(spark, B.wix_stubs, html) == []
    assert len(read(spark, B.wix_stubs, html, url="https://me.wixsite.com/list")) == 2


def test_elementor_blocks(spark):
    html = """<section><h3 class="big chaptername">Rice University</h3><a href="https://facebook.com/x">f</a><a href="https://s.org/rice">site</a><a href="mailto:a@rice.edu">mail</a></section><div><b class="chaptername">State College</b><a href="https://x.com/q">x</a><a href="/own">own</a></div><b class="chaptername">abc</b>"""
    u = "https://x.org/list"
    assert read(spark, B.elementor_stubs, html) == [("Rice University", "Rice University", u, "mailto:a@rice.edu", 0.82, "elementor_chaptername"), ("State College", "State College", u, "https://x.org/own", 0.82, "elementor_chaptername")]


def test_roll_texts(spark):
    html = "<p>Beta Rho chapter Texas A&amp;M University</p><p>BETA  RHO CHAPTER TEXAS A&amp;M UNIVERSITY</p><span>Our history: ALPHA CHAPTER OHIO UNIVERSITY</span><p>ZETA CHAPTER AT HOME</p><h2>O'NEIL-X CHAPTER ST. JOHN'S COLLEGE</h2>"
    u = "https://x.org/list"
    assert read(spark, B.roll_stubs, html) == [("Beta Rho", "Texas A&M University", u, None, 0.74, "chapter_roll_text"), ("O'Neil-X", "St. John'S College", u, None, 0.74, "chapter_roll_text")]


def test_union_keeps_the_surest_and_of_equals_the_first(spark):
    html = """<p>BETA RHO CHAPTER RICE UNIVERSITY</p><section><h3 class="chaptername">Rice University</h3></section><section>Rice University <a href="/chapters/x">y</a></section>"""
    t = B.trees(spark.createDataFrame([(1, "https://x.org/list", html, True)], "page_id int, url string, html string, wix boolean"))
    other = spark.createDataFrame([(1, "beta-rho", "rice university", "d", "o", 0.74, "mine", 5), (1, "Zeta", None, "d", "o", 0.1, "mine", 6)], "page_id int, name string, university_name string, detail_url string, outbound_url string, confidence double, provenance string, place int")
    got = sorted((r["name"], r["confidence"], r["provenance"]) for r in B.chapter_stubs(t, other).collect())
    assert got == [("Rice University", 0.82, "elementor_chaptername"), ("Zeta", 0.1, "mine"), ("beta-rho", 0.74, "mine")]


def test_every_reader_finds_stubs_in_the_query(spark):
    from quillmesh.plans import guards

    sf = "/root/testdata/sf0.001"
    by = {r["provenance"]: r["count"] for r in guards.QUERIES["d45_chapter_stubs"](spark, sf).groupBy("provenance").count().collect()}
    assert set(by) >= {"card", "anchor_list", "map_config", "wix_chapter_link", "elementor_chaptername", "chapter_roll_text"}
    assert guards.QUERIES["s05_stubs"](spark, sf).count() > 0
    assert guards.QUERIES["d21_directory_blocks"](spark, sf).where(F.col("score") >= 6).count() > 0
