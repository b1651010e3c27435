"""Pages as trees in columns: nodes with intervals, the best block of a directory page, and stubs of chapters by reader.

``trees`` parses a page once on the executors. A node's subtree is an interval of node numbers, of characters of the
page's text and of its letters and digits alone, so that what a block holds (phrases, names of Greek letters, links) is
a test of ranges, however deep blocks lie in one another. Objects in scripts are read by a scanner that balances brackets
outside strings and bears what isn't JSON. Names in brackets are the survey's.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.sources.html import HEADINGS, VOID, resolved, slices

# Fixed values ---------------------------------------------------------------------------------------------------------

BLOCK_TAGS = ["div", "li", "article", "section", "a", "td"]
SCHOOL_WORDS = ["university", "college", "institute", "school", "of", "the", "at"]
GENERIC_LABELS = ["go to site", "chapter website", "view chapter", "learn more", "details"]
SOCIAL_HOSTS = ["facebook.com", "instagram.com", "linkedin.com", "x.com", "twitter.com"]
WIX_MARKERS = ["wix-image", "wix-code", "wix-data"]
ROLL_TAGS = ["h1", "h2", "h3", "h4", "p", "div", "span"]
ROLL_BLOCKED = ["org quick links", "quick links", "donate", "careers", "privacy statement", "contact us", "member development", "leadership institute", "officer training academy", "request a program", "our history", "scholarships", "alumni", "foundation", "policies", "history", "system"]
IRRELEVANT_TARGETS = ["/start-a-chapter", "start a chapter", "/careers", "/career", "/about-us", "/about/", "/history", "/notable", "/news", "/blog", "/events", "/event", "/foundation", "/donate", "/scholarship", "/alumni", "/leadership", "/staff", "/privacy", "/terms", "/contact-us"]
ROLL_PATTERN = r"([A-Z][A-Z\s\-']+?)\s+CHAPTER\s+([A-Z][A-Z\s\-'.&]+(?:UNIVERSITY|COLLEGE|INSTITUTE|SCHOOL))"
SCHOOL_PATTERN = r"([A-Z][A-Za-z&.'\-]+\s(?:University|College|Institute|State University|School|Campus))"

# ----------------------------------------------------------------------------------------------------------------------

NODE = "tag string, css string, href string, parent int, end int, low int, high int, from int, to int, links_before int, links_in int, box int, frame int, heading int"
_NODE = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split(" ") for x in NODE.split(", "))]))
_MARK = pa.list_(pa.struct([("name", pa.string()), ("at", pa.int32()), ("to", pa.int32())]))
_OBJECTS = pa.list_(pa.map_(pa.string(), pa.string()))
_GREEK = re.compile(r"\b(?:" + "|".join(sorted(S.GREEK.values(), key=len, reverse=True)) + r")\b")
_SPELLED = {ord(k): f" {v} " for c, v in S.GREEK.items() for k in (c, c.lower())} | {ord("ς"): " sigma "}
_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|[{}\[\]:,]|[A-Za-z_$][\w$]*|-?\d+(?:\.\d+)?""", re.S)
_UNQUOTE = re.compile(r"\\(.)", re.S)


def normal(text: str) -> str:
    """Lower case, Greek letters by their names, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text.lower()).translate(_SPELLED).split())


def script_objects(script: str) -> Iterator[dict[str, str]]:
    """The plain values by key of every object in a script, inner ones first; objects that don't end are left out."""
    open_: list[dict[str, str] | None] = []
    key = before = None
    for found in _TOKEN.finditer(script):
        token = found[0]
        if token[:2] in ("//", "/*"):
            continue
        if token == "{":
            open_.append({})
        elif token == "[":
            open_.append(None)
        elif token in "]}":
            if open_ and (open_[-1] is None) == (token == "]"):
                made = open_.pop()
                if made:
                    yield made
        elif token == ":":
            key = before
        elif token != ",":
            value = _UNQUOTE.sub(r"\1", token[1:-1]) if token[0] in "'\"`" else token
            if key is not None and open_ and open_[-1] is not None:
                open_[-1][key] = value
            before, key = value, None
            continue
        if token != ":":
            key = None
        before = None


class _Tree(HTMLParser):
    """Nodes in document order; text between two tags is one piece, pieces are joined by a space."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.marks: list[dict] = []
        self.joined: list[str] = []
        self.scripts: list[str] = []
        self.buffer: list[str] = []
        self.length = self.letters = self.links = 0
        self.heading, self.skip = -1, None

    def flush(self) -> None:
        piece = "".join(self.buffer).strip()
        self.buffer.clear()
        if piece:
            at = self.length + (1 if self.pieces else 0)
            plain = normal(piece)
            for m in dict.fromkeys(_GREEK.findall(plain)):
                self.marks.append({"name": m, "at": at, "to": at + len(piece)})
            self.pieces.append(piece)
            self.joined.append(re.sub("[^a-z0-9]", "", plain))
            self.length, self.letters = at + len(piece), self.letters + len(self.joined[-1])
            for k in reversed(self.open):  # the first piece below a node; what is above one that has begun has begun, too
                if self.nodes[k]["low"] >= 0:
                    break
                self.nodes[k]["low"], self.nodes[k]["from"] = at, self.letters - len(self.joined[-1])

    def above(self, kind: str, tags: set[str]) -> int:
        """The nearest open node of the tags."""
        up = self.open[-1] if self.open else -1
        return up if up < 0 or self.nodes[up]["tag"] in tags else self.nodes[up][kind]

    def close_node(self, k: int) -> None:
        node = self.nodes[k]
        node["end"], node["links_in"] = len(self.nodes), self.links - node["links_before"] - (node["tag"] == "a" and node["href"] is not None)
        if node["low"] < 0:
            node["low"] = node["high"] = self.length
            node["from"] = node["to"] = self.letters
        else:
            node["high"], node["to"] = self.length, self.letters

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.flush()
        if tag in ("script", "style", "template"):
            self.skip = tag
            if tag == "script":
                self.scripts.append("")
        a = dict(attrs)
        href = a.get("href") if "href" not in a or a["href"] is not None else ""
        self.nodes.append({
            "tag": tag, "css": a.get("class"), "href": href, "parent": self.open[-1] if self.open else -1, "low": -1, "from": -1, "links_before": self.links,
            "box": self.above("box", {"article", "section", "div", "li"}), "frame": self.above("frame", {"section", "article", "div"}), "heading": self.heading,
        })
        k = len(self.nodes) - 1
        if tag == "a" and href is not None:
            self.links += 1
        if tag in HEADINGS - {"h5", "h6"}:
            self.heading = k
        if tag in VOID:
            self.close_node(k)
        else:
            self.open.append(k)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag == self.skip:
            self.skip = None
        for place in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[place]]["tag"] == tag:
                for k in reversed(self.open[place:]):
                    self.close_node(k)
                del self.open[place:]
                break

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        if self.skip == "script":
            self.scripts[-1] += data
        elif not self.skip:
            self.buffer.append(data)

    def done(self, wanted: list[str]) -> dict:
        self.close()
        self.flush()
        for k in reversed(self.open):
            self.close_node(k)
        letters = "".join(self.joined)
        for phrase in dict.fromkeys(w for w in wanted if w):
            at = letters.find(phrase)
            while at >= 0:
                self.marks.append({"name": "=" + phrase, "at": at, "to": at + len(phrase)})
                at = letters.find(phrase, at + 1)
        objects = [list(o.items()) for s in self.scripts for o in script_objects(s)]
        return {"text": " ".join(self.pieces), "nodes": self.nodes, "marks": self.marks, "objects": objects}


def _tree(html: str | None, wanted: list[str] | None) -> dict:
    p = _Tree()
    p.feed(html or "")
    return p.done(wanted or [])


def trees(pages: DataFrame, wanted: Column | None = None, html: str = "html") -> DataFrame:
    """All columns of pages but the HTML, and text, nodes, marks and objects of each page; null HTML is an empty page.

    marks: names of Greek letters by characters of the text, and every place of the wanted phrases (lower-case letters
    and digits alone) by the page's letters and digits.
    """
    phrases = wanted if wanted is not None else F.expr("cast(array() as array<string>)")
    rows = pages.select(*(c for c in pages.columns if c != html), F.col(html).alias("_html"), phrases.alias("_wanted"))
    kept = rows.schema.fields[:-2]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            n = whole.num_columns
            for batch in slices(whole, n - 2):
                made = [_tree(h.as_py(), w.as_py()) for h, w in zip(batch.column(n - 2), batch.column(n - 1), strict=True)]
                kinds = {"text": pa.string(), "nodes": _NODE, "marks": _MARK, "objects": _OBJECTS}
                columns = [*batch.columns[:-2], *(pa.array([m[c] for m in made], k) for c, k in kinds.items())]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *kinds])

    return rows.mapInArrow(run, f"{schema}, text string, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, marks array<struct<name:string,at:int,to:int>>, objects array<map<string,string>>")


def _text(node: Column) -> Column:
    return F.substring("text", node["low"] + 1, node["high"] - node["low"])


def school_phrases(school: Column) -> Column:
    """What a school is known by, as letters and digits alone: its name, the name without words of schools, University of X and X Y."""
    words = F.filter(F.split(F.lower(S.greek_names(F.coalesce(school, F.lit("")))), "[^a-z0-9]+"), lambda w: w != "")
    core = F.filter(words, lambda w: ~w.isin(SCHOOL_WORDS))
    of = (F.get(words, F.lit(0)) == "university") & (F.get(words, F.lit(1)) == "of") & (F.size(core) > 0)
    of_words = lambda n: F.when(of & (F.size(core) >= n), F.concat(F.lit("universityof"), F.array_join(F.slice(core, 1, n), ""))).otherwise("")
    return F.array_distinct(F.filter(F.array(F.array_join(words, ""), F.array_join(core, ""), of_words(1), of_words(2)), lambda p: p != ""))


def directory_blocks(pages: DataFrame) -> DataFrame:
    """[D21] page_id, decision, score, confidence, block, links and greek_tokens: the block that best fits school and organisation.

    pages: page_id, url, html, school, organisation. A block that holds a phrase of the school scores 3, up to 2 for
    names of Greek letters, 1 for the organisation and 1 for links; of equals the first in the document stays.
    """
    pages = pages.select("page_id", "url", "html", school_phrases(F.col("school")).alias("phrases"), S.compact(F.coalesce("organisation", F.lit(""))).alias("own"))
    t = trees(pages, F.concat("phrases", F.array("own"))).withColumns({
        "school": F.filter("marks", lambda m: m["name"].startswith("=") & F.array_contains("phrases", F.substring(m["name"], 2, 1 << 30))),
        "named": F.filter("marks", lambda m: (F.col("own") != "") & (m["name"] == F.concat(F.lit("="), "own"))),
        "greek": F.filter("marks", lambda m: ~m["name"].startswith("=")),
    })
    among = lambda n: lambda m: (m["at"] >= n["from"]) & (m["to"] <= n["to"])
    greek_in = lambda n: F.array_distinct(F.transform(F.filter("greek", lambda m: (m["at"] >= n["low"]) & (m["to"] <= n["high"])), lambda m: m["name"]))
    places = F.filter(F.transform("nodes", lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: x["n"]["tag"].isin(BLOCK_TAGS) & F.exists("school", among(x["n"])))
    score = lambda n: 3 + F.least(F.lit(2), F.size(greek_in(n))) + F.exists("named", among(n)).cast("int") + (n["links_in"] > 0).cast("int")
    best = F.array_max(F.transform(places, lambda x: F.struct(score(x["n"]).alias("score"), (-x["i"]).alias("order"))))
    t = t.withColumn("best", F.when(F.size("school") > 0, best)).withColumn("n", F.get("nodes", -F.col("best.order")))
    inner = F.slice("nodes", 2 - F.col("best.order"), F.greatest(F.lit(0), F.col("n.end") + F.col("best.order") - 1))
    hrefs = F.filter(F.transform(F.filter(inner, lambda x: (x["tag"] == "a") & x["href"].isNotNull()), lambda x: resolved(F.trim(x["href"]), F.col("url"))), lambda u: u != "")
    found = F.col("best").isNotNull()
    return t.select(
        "page_id", F.when(found, "matched_block").otherwise("no_match").alias("decision"), F.coalesce("best.score", F.lit(0)).alias("score"),
        F.when(found, F.round(F.least(F.lit(0.96), 0.55 + 0.08 * F.col("best.score")), 4)).otherwise(0.0).alias("confidence"),
        F.when(found, F.substring(_text(F.col("n")), 1, 1200)).alias("block"), F.when(found, F.slice(hrefs, 1, 10)).alias("links"), F.when(found, F.array_sort(greek_in(F.col("n")))).alias("greek_tokens"),
    )


# Stubs ----------------------------------------------------------------------------------------------------------------

STUB = ["page_id", "name", "university_name", "detail_url", "outbound_url", "confidence", "provenance"]


def titled(x: Column) -> Column:
    """Every run of letters with its first in upper case."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), 0), F.initcap), "")


def _school_in(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(x, r"\s+", " "), SCHOOL_PATTERN, 1), F.lit(""))


def _any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def _stubs(df: DataFrame, name: Column, school: Column, detail: Column, outbound: Column, confidence: Column, provenance: str) -> DataFrame:
    return df.select("page_id", name.alias("name"), school.alias("university_name"), detail.alias("detail_url"), outbound.alias("outbound_url"), confidence.cast("double").alias("confidence"), F.lit(provenance).alias("provenance"), F.col("i").alias("place"))


def _picked(t: DataFrame, test: Callable[[Column], Column], facts: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """page_id, url, the number i and the facts of each node that passes; only these leave the page's row."""
    nodes = F.filter(F.transform("nodes", lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: test(x["n"]))
    made = F.transform(nodes, lambda x: F.struct(x["i"].alias("i"), *(v.alias(k) for k, v in facts(x["n"], x["i"]).items())))
    return t.select("page_id", "url", F.explode(made).alias("x")).select("page_id", "url", "x.*")


def _linked(n: Column) -> Column:
    return (n["tag"] == "a") & F.coalesce(F.trim(n["href"]) != "", F.lit(False))


def _at(place: Column, other: Column) -> Column:
    """The text of the node at a place, else another one's."""
    return F.when(place >= 0, _text(F.get("nodes", place))).otherwise(other)


def anchor_stubs(t: DataFrame) -> DataFrame:
    """Links that score as chapters' (0.65 or more), by label, or by the heading before them where the label says nothing."""
    from quillmesh.operators.scoring import chapter_link_score

    a = _picked(t, _linked, lambda n, i: {"href": F.trim(n["href"]), "label": _text(n), "context": _at(n["parent"], _text(n)), "head": _at(n["heading"], F.lit(""))})
    whole = F.when(F.col("href").rlike("(?i)^([a-z][a-z0-9+.-]*:|//)"), F.col("href")).otherwise(F.concat(F.lit("page://here/"), "href"))  # its own path counts, not the page's
    a = a.where("label <> ''").withColumn("score", chapter_link_score(F.col("label"), whole, F.col("context"))["score"]).where("score >= 0.65")
    a = a.withColumn("name", F.trim(F.when(F.lower(F.trim("label")).isin(GENERIC_LABELS), F.col("head")).otherwise(F.col("label")))).withColumn("at", resolved(F.col("href"), F.col("url")))
    a = a.where((F.length("name") >= 3) & ~_any(F.lower(F.concat_ws(" ", "at", "label", "context")), IRRELEVANT_TARGETS))
    return _stubs(a, F.col("name"), _school_in(F.col("context")), F.col("at"), F.col("at"), F.col("score"), "anchor_list")


def map_stubs(t: DataFrame) -> DataFrame:
    """Objects in scripts with a hover text in a paragraph and a URL: the states of a map; one a page and URL."""
    o = t.select("page_id", "url", F.posexplode("objects").alias("i", "o"))
    value = lambda k: F.element_at(F.filter(F.map_values(F.map_filter("o", lambda name, _: F.lower(name) == k)), lambda v: v.isNotNull()), 1)
    o = o.where(F.exists(F.map_keys("o"), lambda k: F.lower(k) == "hover") & F.exists(F.map_keys("o"), lambda k: F.lower(k) == "url"))
    o = o.select("page_id", "url", "i", F.trim(F.regexp_extract(value("hover"), "(?i)^<p>([^<]+)</p>$", 1)).alias("label"), F.trim(value("url")).alias("href"))
    o = o.where((F.col("label") != "") & F.col("href").rlike("(?i)^https?://.")).withColumn("at", resolved(F.col("href"), F.col("url")))
    first = o.groupBy("page_id", "at").agg(F.min(F.struct("i", "label")).alias("f")).select("page_id", "at", "f.i", "f.label")
    return _stubs(first, titled(F.col("label")), F.lit(None).cast("string"), F.col("at"), F.col("at"), F.lit(0.78), "map_config")


def wix_stubs(t: DataFrame) -> DataFrame:
    """On pages of one site builder (column wix): links below /chapters/, by the school in their block, else by their path."""
    host = S.url_host("url")
    built = t.where(host.contains("wixsite.com") | host.contains("wix.com") | F.col("wix"))
    a = _picked(built, _linked, lambda n, i: {"at": resolved(F.trim(n["href"]), F.col("url")), "label": _text(n), "context": _at(n["box"], _text(n))})
    path = F.lower(S.url_path("at"))
    a = a.where((S.url_host("at") != "") & S.url_host("at").contains(S.url_host("url")) & path.contains("/chapters/") & (F.regexp_replace(path, "/+$", "") != "/chapters"))
    slug = F.initcap(F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.element_at(F.split(path, "/chapters/"), -1), "^/+|/+$", ""), F.lit("-"), F.lit(" ")), r"\s+", " ")))
    a = a.withColumn("school", _school_in(F.col("context"))).withColumn("name", F.trim(F.coalesce("school", F.nullif(slug, F.lit("")), "label")))
    return _stubs(a.where(F.length("name") >= 3), F.col("name"), F.col("school"), F.col("at"), F.col("at"), F.lit(0.78), "wix_chapter_link")


def elementor_stubs(t: DataFrame) -> DataFrame:
    """Nodes of class chaptername: the school, with the first address, else the first website that is no social one, of their block."""
    def facts(n: Column, i: Column) -> dict[str, Column]:
        k = F.when(n["frame"] >= 0, n["frame"]).otherwise(i)
        inner = F.slice("nodes", k + 2, F.greatest(F.lit(0), F.get("nodes", k)["end"] - k - 1))
        links = F.transform(F.filter(inner, lambda x: (x["tag"] == "a") & F.coalesce(x["href"] != "", F.lit(False))), lambda x: resolved(x["href"], F.col("url")))
        return {"school": _text(n), "links": links}

    c = _picked(t, lambda n: F.array_contains(F.split(F.coalesce(n["css"], F.lit("")), r"\s+"), "chaptername"), facts).where(F.length("school") >= 5)
    mail = F.get(F.filter("links", lambda u: F.lower(u).startswith("mailto:")), 0)
    site = F.get(F.filter("links", lambda u: u.startswith("http") & ~_any(F.lower(u), SOCIAL_HOSTS)), 0)
    return _stubs(c, F.col("school"), F.col("school"), F.col("url"), F.coalesce(mail, site), F.lit(0.82), "elementor_chaptername")


def roll_stubs(t: DataFrame) -> DataFrame:
    """Short texts like NAME CHAPTER SCHOOL UNIVERSITY; one a page, name and school."""
    short = lambda n: n["tag"].isin(ROLL_TAGS) & (n["high"] - n["low"]).between(20, 4000)
    r = _picked(t, short, lambda n, i: {"x": F.trim(F.regexp_replace(_text(n), r"\s+", " "))})
    r = r.where(F.length("x").between(20, 180)).withColumn("x", F.upper("x")).where(F.col("x").contains(" CHAPTER ") & ~_any(F.col("x"), [m.upper() for m in ROLL_BLOCKED]))
    part = lambda k: F.trim(F.regexp_replace(titled(F.regexp_extract("x", ROLL_PATTERN, k)), r"\s+", " "))
    r = r.select("page_id", "url", "i", part(1).alias("name"), part(2).alias("school")).where((F.col("name") != "") & (F.length("name") <= 80) & (F.length("school") <= 120))
    first = r.groupBy("page_id", F.lower("name").alias("a"), F.lower("school").alias("b")).agg(F.min(F.struct("i", "url", "name", "school")).alias("f")).select("page_id", "f.*")
    return _stubs(first, F.col("name"), F.col("school"), F.col("url"), F.lit(None).cast("string"), F.lit(0.74), "chapter_roll_text")


READERS = [anchor_stubs, map_stubs, wix_stubs, elementor_stubs, roll_stubs]


def chapter_stubs(t: DataFrame, *others: DataFrame) -> DataFrame:
    """[D45] The stubs of all readers (and of others, with STUB's columns and place): of one name and school on a page the surest, of equals the first.

    t: ``trees`` of pages with page_id, url and wix, written if it is dear: each reader goes through it once.
    """
    every = [r.select(*STUB, "place", F.lit(k).alias("reader")) for k, r in enumerate([*others, *(read(t) for read in READERS)])]
    union = every[0]
    for more in every[1:]:
        union = union.unionByName(more)
    key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rest = [c for c in STUB if c not in ("page_id", "confidence")]
    best = F.max_by(F.struct(*rest, "confidence"), F.struct("confidence", (-F.col("reader")).alias("r"), (-F.col("place")).alias("p"))).alias("s")
    return union.groupBy("page_id", key(F.col("name")).alias("k1"), key(F.col("university_name")).alias("k2")).agg(best).select("page_id", "s.*").select(STUB)


def wix_like(html: Column) -> Column:
    """Whether a page bears the marks of the site builder of ``wix_stubs``."""
    return _any(F.lower(F.coalesce(html, F.lit(""))), WIX_MARKERS)
