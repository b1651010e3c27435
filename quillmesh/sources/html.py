"""HTML pages to facts: one parse per page on the executors, everything after it in columns.

``parsed`` runs the standard library's parser once per page in a mapInArrow, a bounded number of pages at a time, and
returns tables, links, cards, headings, scripts and text as nested columns. Profiles, records, links and zones are
derived from those columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S

SKIPPED = {"script", "style", "noscript", "template"}
BLOCKS = {"li", "article", "div", "section", "tr", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "td", "th", "br"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

SCHEMA = (
    "title string, text string, n_elements int, links array<struct<href:string,label:string>>, tables array<array<array<string>>>, "
    "cards array<struct<css:string,text:string,href:string>>, sections array<struct<heading:string,text:string>>, scripts array<string>, json_ld array<string>, "
    "iframes array<string>, data_attrs array<string>, repeated int"
)
_TEXTS = pa.list_(pa.string())
_ARROW = {
    "title": pa.string(), "text": pa.string(), "n_elements": pa.int32(), "links": pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())])), "tables": pa.list_(pa.list_(_TEXTS)),
    "cards": pa.list_(pa.struct([(c, pa.string()) for c in ("css", "text", "href")])), "sections": pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())])), "scripts": _TEXTS, "json_ld": _TEXTS,
    "iframes": _TEXTS, "data_attrs": _TEXTS, "repeated": pa.int32(),
}
#: Pages and bytes of HTML that are parsed at a time; a longer page is parsed alone.
PAGES, BYTES = 256, 1 << 20


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.n = "", 0
        self.text: list[str] = []
        self.links: list[list[str]] = []
        self.tables: list[list[list[str]]] = []
        self.cards: list[dict] = []
        self.sections: list[list[str]] = [["", ""]]
        self.scripts: list[str] = []
        self.json_ld: list[str] = []
        self.iframes: list[str] = []
        self.data: list[str] = []
        self.classes: dict[tuple[str, str], int] = {}
        self.open: list[tuple[str, dict | None]] = []
        self.skip = self.kind = None
        self.link = self.heading = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        self.n += 1
        if tag in SKIPPED:
            self.skip, self.kind = tag, a.get("type", "")
            if tag == "script":
                (self.json_ld if "ld+json" in self.kind else self.scripts).append("")
            return
        if tag in BLOCKS:
            self._add(" ")
        css = a.get("class", "")
        if css and tag in ("li", "div", "article", "section", "a", "tr"):
            self.classes[tag, css.split()[0]] = self.classes.get((tag, css.split()[0]), 0) + 1
        card = None
        if tag in ("li", "div", "article") and (re.search(r"chapter|card|item|location|archive", css) or any(k.startswith("data-chapter") for k in a)):
            card = {"css": css, "text": "", "href": None}
            self.cards.append(card)
        self.data += [f"{k}={v}" for k, v in a.items() if k.startswith("data-") and v]
        if tag == "a" and a.get("href"):
            self.link = [a["href"], ""]
            self.links.append(self.link)
            for _, c in self.open:
                if c is not None and c["href"] is None:
                    c["href"] = a["href"]
        elif tag == "iframe":
            self.iframes.append(a.get("src", ""))
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")
        elif tag in HEADINGS:
            self.sections.append(["", ""])
            self.heading = tag
        if tag not in VOID:
            self.open.append((tag, card))

    def handle_endtag(self, tag: str) -> None:
        if tag == self.skip:
            self.skip = None
            return
        if tag == "a":
            self.link = None
        if tag == self.heading:
            self.heading = None
        if tag in BLOCKS:
            self._add(" ")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def _add(self, data: str) -> None:
        self.text.append(data)
        if self.link:
            self.link[1] += data
        for _, c in self.open:
            if c is not None:
                c["text"] += data
        tags = [t for t, _ in self.open]
        if self.tables and self.tables[-1] and self.tables[-1][-1] and ("td" in tags or "th" in tags):
            self.tables[-1][-1][-1] += data
        if self.heading:
            self.sections[-1][0] += data
        else:
            self.sections[-1][1] += data

    def handle_data(self, data: str) -> None:
        if self.skip == "script":
            (self.json_ld if "ld+json" in self.kind else self.scripts)[-1] += data
        elif not self.skip:
            if any(t == "title" for t, _ in self.open):
                self.title += data
            else:
                self._add(data)


def _clean(s: str | None) -> str | None:
    return None if s is None else " ".join(s.split())


def _parse(html: str | None) -> dict:
    p = _Page()
    p.feed(html or "")
    p.close()
    return {
        "title": _clean(p.title), "text": _clean("".join(p.text)), "n_elements": p.n,
        "links": [{"href": h.strip(), "label": _clean(t)} for h, t in p.links],
        "tables": [[[_clean(c) for c in r] for r in t if r] for t in p.tables if t],
        "cards": [{k: _clean(v) for k, v in c.items()} for c in p.cards],
        "sections": [{"heading": _clean(h), "text": _clean(t)} for h, t in p.sections if h.strip() or t.strip()],
        "scripts": [s for s in p.scripts if s.strip()], "json_ld": [s for s in p.json_ld if s.strip()],
        "iframes": [s for s in p.iframes if s], "data_attrs": p.data, "repeated": sum(1 for n in p.classes.values() if n >= 3),
    }


def slices(batch: pa.RecordBatch, html: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most PAGES rows and BYTES of the HTML in a column, so that few parsed pages are held at once."""
    at = held = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(html)), 0).to_pylist()):
        if k > at and (k - at == PAGES or held + n > BYTES):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < len(batch):
        yield batch.slice(at)


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url and the columns of SCHEMA for every page; null HTML is an empty page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                made = [_parse(h.as_py()) for h in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[c] for m in made], k) for c, k in _ARROW.items())], [key, url, *_ARROW])

    return pages.select(key, url, html).mapInArrow(run, f"{key} {kind}, {url} string, {SCHEMA}")


def profile() -> Column:
    """[D01] struct: counts of tables, links, cards and repeated blocks, flags and the page's role."""
    low = F.lower(F.concat_ws(" ", "title", "text"))
    many = F.size("links") >= 10
    pages = F.exists("links", lambda x: F.lower(x["label"]).rlike(r"^(next|previous|older|newer|page \d+|»|«)$") | x["href"].rlike(r"[?&]page=\d"))
    has_map = F.exists("iframes", lambda s: s.rlike(r"(?i)google\.com/maps|mapbox|kml")) | F.exists("scripts", lambda s: s.rlike(r"(?i)mapplic|leaflet|google\.maps|mapboxgl"))
    script_json = F.exists("scripts", lambda s: s.rlike(r"(?s)=\s*[\[{].*[\]}]"))
    role = F.when(low.rlike("chapter (directory|roll|list)|find a chapter|our chapters|chapters") & ((F.size("tables") > 0) | (F.size("cards") >= 2) | many), "directory").when(many & low.rlike("directory|index|members"), "index").when(F.size("links") > 0, "content").otherwise("unknown")
    return F.struct(
        F.size("tables").alias("tables"), F.size("links").alias("links"), F.size("cards").alias("cards"), F.col("repeated").alias("repeated"), F.size(F.filter("cards", lambda c: c["href"].isNotNull())).alias("anchors"),
        (F.size("json_ld") > 0).alias("has_json_ld"), script_json.alias("has_script_json"), has_map.alias("has_map"), pages.alias("has_pagination"), role.alias("role"),
    )


SYNONYMS = {
    "name": ["chapter", "chapter name", "name", "organization"],
    "university_name": ["university", "school", "college", "institution", "campus"],
    "city": ["city", "town"],
    "state": ["state", "province", "st"],
    "website_url": ["website", "site", "url", "link"],
    "instagram_url": ["instagram", "ig"],
    "contact_email": ["email", "e-mail", "contact", "contact email"],
}


def table_records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """[S03, S04] Records of tables: columns by the header's synonyms, by position where the header names none."""
    t = pages.select(key, F.posexplode("tables").alias("table", "rows"))
    header = F.transform(F.get("rows", 0), F.lower)
    index = {f: F.coalesce(*(F.nullif(F.array_position(header, w), F.lit(0)) for w in words)) for f, words in SYNONYMS.items()}
    named = F.coalesce(*index.values()).isNotNull()
    t = t.select(key, "table", "rows", named.alias("named"), *(v.alias(f"i_{f}") for f, v in index.items()))
    t = t.select(key, "table", "named", *(f"i_{f}" for f in SYNONYMS), F.posexplode("rows").alias("row", "cells")).where("not named or row > 0")
    fallback = {"name": 0, "university_name": 1, "city": 2, "state": 3}
    cell = lambda f: S.blank_to_null(F.when(F.col("named"), F.get("cells", (F.col(f"i_{f}") - 1).cast("int"))).otherwise(F.get("cells", fallback[f]) if f in fallback else F.lit(None).cast("string")))
    return t.select(key, "table", "row", *(cell(f).alias(f) for f in SYNONYMS)).where("name is not null")


def stub_records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """[S05, D45] Stubs of cards and linked lists: name, place and link."""
    c = pages.select(key, "url", F.posexplode("cards").alias("card", "c"))
    parts = S.heading_parts(F.col("c.text"))
    return c.select(key, "card", F.coalesce(parts["name"], F.col("c.text")).alias("name"), parts["school"].alias("university_name"), S.as_website(F.col("c.href"), F.col("url")).alias("website_url"), F.lit(0.6).alias("confidence")).where("name <> ''")


JSON_KEYS = {
    "name": ["name", "chapterName", "chapter_name", "title"],
    "university_name": ["schoolName", "school", "university", "universityName", "college"],
    "city": ["city", "address.addressLocality", "addressLocality", "location.city"],
    "state": ["state", "address.addressRegion", "addressRegion", "location.state"],
    "website_url": ["url", "websiteUrl", "website", "link"],
    "external_id": ["chapterId", "id", "@id"],
}


def json_records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """[S06] Records of JSON-LD and inline JSON arrays, fields by the first synonym that is filled, with confidence."""
    arrays = F.transform(F.regexp_extract_all(F.array_join("scripts", "\n"), F.lit(r"(?s)=\s*(\[\s*\{.*?\}\s*\])"), 1), lambda s: F.struct(s.alias("doc"), F.lit(False).alias("ld")))
    ld = F.transform("json_ld", lambda s: F.struct(F.when(F.trim(s).startswith("["), s).otherwise(F.concat(F.lit("["), s, F.lit("]"))).alias("doc"), F.lit(True).alias("ld")))
    docs = pages.select(key, F.explode(F.concat(ld, arrays)).alias("d"))
    items = docs.select(key, "d.ld", F.posexplode(F.from_json("d.doc", "array<string>")).alias("item", "doc"))
    value = lambda names: S.first_filled(*(F.get_json_object("doc", "$." + n if "@" not in n else f"$['{n}']") for n in names))
    df = items.select(key, "item", "ld", *(value(names).alias(f) for f, names in JSON_KEYS.items()))
    filled = sum((F.col(f).isNotNull().cast("int") for f in ("university_name", "city", "state", "website_url")), F.lit(0))
    conf = F.least(F.lit(1.0), F.round(0.45 + 0.1 * filled + F.when(F.col("external_id").isNotNull(), 0.1).otherwise(0.0) + F.when(F.col("ld"), 0.1).otherwise(0.0), 2))
    return df.where("name is not null").withColumn("confidence", conf)


def kml_records(docs: DataFrame, key: str = "page_id", kml: str = "html") -> DataFrame:
    """[S07] Records of KML placemarks, one per name and university; a name is "University - Chapter"."""
    marks = docs.select(key, F.posexplode(F.regexp_extract_all(kml, F.lit(r"(?s)<Placemark[^>]*>(.*?)</Placemark>"), 1)).alias("mark", "x"))
    plain = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    d = marks.select(key, "mark", plain("name").alias("title"), S.described(F.regexp_replace(F.regexp_replace(plain("description"), "&lt;", "<"), "&gt;", ">")).alias("d"))
    parts = F.split("title", r"\s+-\s+", 2)
    place = S.locator_city_state(F.try_element_at("d", F.lit("location")))
    df = d.select(key, "mark", F.coalesce(F.get(parts, 1), F.col("title")).alias("name"), F.when(F.size(parts) > 1, F.get(parts, 0)).alias("university_name"), place["city"].alias("city"), place["state"].alias("state"), S.as_website(F.try_element_at("d", F.lit("website"))).alias("website_url"))
    first = F.min("mark").alias("first")
    keys = df.groupBy(key, F.lower("name").alias("n"), F.lower(F.coalesce("university_name", F.lit(""))).alias("u")).agg(first)
    return df.join(keys.select(key, F.col("first").alias("mark")), [key, "mark"], "left_semi")


def embedded_data() -> Column:
    """[S09] struct of kind and value of the first embedded data found: KML frame, JSON-LD, data attribute, array, API."""
    made = lambda kind, v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    find = lambda col, pattern: F.get(F.filter(col, lambda s: s.rlike(pattern)), 0)
    scripts = F.array_join("scripts", "\n")
    return F.coalesce(made("kml_iframe", find("iframes", r"(?i)kml|mid=")), made("json_ld", F.get("json_ld", 0)), made("data_attribute", find("data_attrs", r"=\s*[\[{]")), made("script_array", F.nullif(F.regexp_extract(scripts, r"(?s)=\s*(\[\s*\{.*?\}\s*\])", 1), F.lit(""))), made("api_url", F.nullif(F.regexp_extract(scripts, r"[\"'](https?://[^\"']*(?:api|json)[^\"']*)[\"']", 1), F.lit(""))))


def resolved(href: Column, base: Column) -> Column:
    """A link's absolute URL on a page."""
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(?:/.*)?/", 0)
    scheme = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).when(href.rlike("^[?#]"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), href))


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, source_url, ordinal, link and label: every distinct canonical link of each page, in order, with its first label.

    Links are sorted by URL and place and met with the one before them, so a page takes n log n of its links.
    """
    fine = F.filter("links", lambda x: ~x["href"].rlike("(?i)^(mailto|tel|javascript):") & (x["href"] != ""))
    made = F.transform(fine, lambda x, i: F.struct(S.canonical_url(resolved(x["href"], F.col("url"))).alias("link"), i.alias("at"), x["label"].alias("label")))
    first = F.filter("all", lambda x, i: (i == 0) | ~x["link"].eqNullSafe(F.get("all", i - 1)["link"]))
    placed = F.sort_array(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["link"].alias("link"), x["label"].alias("label"))))
    df = pages.select(key, F.col("url").alias("source_url"), F.sort_array(made).alias("all")).select(key, "source_url", F.posexplode(placed).alias("ordinal", "x"))
    return df.select(key, "source_url", "ordinal", F.col("x.link").alias("link"), F.when(F.col("x.link").isNotNull(), F.col("x.label")).alias("label"))


def frontier_links(pages: DataFrame, key: str = "page_id", most: int = 40) -> DataFrame:
    """[D05] The first ``most`` distinct canonical links of each page, in order; anchors are 180 characters at most."""
    return page_links(pages, key).where(F.col("ordinal") < most).select(key, "source_url", "ordinal", "link", F.nullif(F.substring("label", 1, 180), F.lit("")).alias("anchor"))


ZONES = {"suspended": "suspend", "closed": "closed|inactive", "dismissed": "dismiss", "expelled": "expel", "unrecognized": "unrecognized|loss of recognition|not recognized", "probation": "probation", "recognized": "recognized|active|in good standing|chapters|fraternities"}


def status_zones(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """[D30] Zones of a campus page: a heading and the text up to the next one, typed by the heading's words."""
    z = pages.select(key, "url", F.posexplode("sections").alias("zone_order", "s"))
    low = F.lower("s.heading")
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(ZONES.items()):
        kind = F.when(low.rlike(pattern), name).otherwise(kind)
    return z.select(key, F.col("url").alias("source_url"), "zone_order", F.col("s.heading").alias("zone_heading"), F.col("s.text").alias("zone_text"), kind.alias("zone_type"), F.when(kind.isNull(), 0.3).when(F.length("s.text") > 0, 0.9).otherwise(0.5).alias("confidence"))


def contact_hints(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """[D47, D48] Addresses and Instagram profiles of each page, from links, text and JSON-LD."""
    mail = F.transform(F.filter("links", lambda x: F.lower(x["href"]).startswith("mailto:")), lambda x: S.as_email(x["href"]))
    emails = F.array_distinct(F.array_compact(F.concat(mail, S.emails_in(S.deobfuscated("text")))))
    raw = F.concat(F.transform("links", lambda x: x["href"]), F.regexp_extract_all(F.array_join("json_ld", " "), F.lit(r"https?://(?:www\.)?instagram\.com/[A-Za-z0-9_.]+/?"), 0))
    grams = F.transform(F.filter(raw, lambda u: F.lower(u).contains("instagram.com/")), lambda u: F.when(S.instagram_kind(u) == "profile", S.as_instagram(u)))
    return pages.select(key, emails.alias("emails"), F.array_distinct(F.array_compact(grams)).alias("instagrams"))


def directory_links(pages: DataFrame, key: str = "page_id", most: int = 8) -> DataFrame:
    """[K06, D21] The ``most`` best-scored same-host links of each page, of all its links and by their whole labels."""
    from quillmesh.operators.scoring import chapter_link_score

    from pyspark.sql import Window

    df = page_links(pages, key).where(S.url_host("link") == S.url_host("source_url")).select(key, "source_url", "ordinal", "link", F.nullif("label", F.lit("")).alias("anchor"))
    df = df.withColumn("score", chapter_link_score(F.coalesce("anchor", F.lit("")), F.col("link"), F.lit(""))["score"])
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("link").desc())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("confidence", F.least(F.lit(0.95), F.round(0.55 + 0.05 * F.col("score"), 4)))


def crawl_rounds(seeds: DataFrame, pages: DataFrame, rounds: int = 3, per_session: int = 20) -> DataFrame:
    """[D46, K02, T05] Follow links for a bounded number of rounds: fetch is a join with the parsed pages.

    seeds: session_id, url. Each round scores the frontier, keeps the best ``per_session`` per session that weren't
    visited, joins their pages and adds their links. Pages are parsed once; links and each round's frontier are kept.
    """
    from pyspark.sql import Window

    from quillmesh.operators.scoring import frontier_score, kept

    pages = kept(pages.select("page_id", "url", "links"))
    links = kept(frontier_links(pages).select(S.canonical_url("source_url").alias("at"), "link", "anchor"))
    known = pages.select(S.canonical_url("url").alias("link")).distinct()
    visited = seeds.select("session_id", S.canonical_url("url").alias("link"), F.lit(0).alias("depth"), F.lit(0.0).alias("score")).distinct()
    front = visited
    for depth in range(1, rounds + 1):
        found = front.select("session_id", F.col("link").alias("at")).join(links, "at")
        zero = F.lit(0)
        score = frontier_score(F.col("link"), F.col("anchor"), F.lit(depth), F.col("at"), F.lit(False), zero, zero, zero, zero)["score"]
        new = found.withColumn("score", score).groupBy("session_id", "link").agg(F.max("score").alias("score"))
        new = new.join(visited, ["session_id", "link"], "left_anti").join(known, "link", "left_semi")
        order = Window.partitionBy("session_id").orderBy(F.col("score").desc(), "link")
        front = kept(new.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_session).select("session_id", "link", F.lit(depth).alias("depth"), "score"))
        visited = visited.unionByName(front)
    return visited
