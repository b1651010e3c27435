"""Which organisations texts name, under which guards, and what a contact says of the job it is for.

``marks`` finds every name of every organisation in every text. As long as all names together have at most
AUTOMATON_WORDS words, they go to the tasks as one word automaton, and a text costs one step a word however many names
there are; beyond that, words are joined with the names' first words and only the runs that begin with one are looked up.
Names in brackets are the survey's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S

#: Words of all names together up to which the automaton is built; about 100 MB in a Python worker.
AUTOMATON_WORDS = 300_000

# Fixed values ---------------------------------------------------------------------------------------------------------

#: Names that are too short to tell an organisation by.
AMBIGUOUS = ["delta", "phi", "phi kappa", "sigma", "alpha"]
NICKNAMES = {"phi gamma delta": ["fiji"], "alpha tau omega": ["ato"], "sigma alpha epsilon": ["sae", "sig ep", "sigep"], "beta upsilon chi": ["byx"], "pi kappa alpha": ["pike"], "delta chi": ["d chi", "dchi"]}
#: Other words for an organisation in searches.
SEARCH_NAMES = {"phi gamma delta": ["fiji"], "alpha tau omega": ["ato"], "sigma alpha epsilon": ["sae"], "beta upsilon chi": ["byx"], "pi kappa alpha": ["pike"]}
ZONE_CONTEXT = ["fraternity", "chapter", "greek", "ifc", "interfraternity", "recognized", "suspended", "active", "probation", "suspension", "scorecard", "organization"]
CAMPUS_MARKERS = ["university of", "college", "state university", "william mary", "university"]
NO_IDENTITY = ["main", "national", "nationals"]
MATCH_STOPWORDS = "university college campus chapter official site email contact instagram profile fraternity house the and for".split()
CHAPTER_STOPWORDS = "chapter colony active inactive associate associates provisional suspended rechartered interest group".split()
PREFIXES_ALLOWED = "the a an at of for chapter fraternity sorority greek life".split()
OFFICE_PREFIXES = "info contact admin office hello membership national nationals headquarters hq ihq".split()
OFFICE_MARKERS = "admission admissions advisor fsl greeklife greek.life graduateprogram graduateprograms ifc leadership ofsl osfl office operator reslife studentengagement studentaffairs studentinvolvement student.life studentlife studentorg studentorganization studentorganizations".split()
ROLE_MARKERS = ["advisor", "board", "contact", "contacts", "email", "executive", "leadership", "officer", "officers", "president", "recruit", "recruitment", "rush", "secretary", "treasurer", "vice president"]
LOW_SIGNAL_MARKERS = [
    "admission", "admissions", "apply", "applying", "archive", "archives", "archivesspace", "article", "articles", "award", "awards", "book export", "calendar", "commencement", "encyclopedia", "event", "events", "fellow", "fellows", "fellowship",
    "history", "in memoriam", "magazine", "memorial", "news", "obit", "obits", "obituar", "our fellows", "prize", "prizes", "profile", "profiles", "publication", "publications", "review", "scholarship", "scholarships", "special collections",
    "student voices", "summer", "urology", "visiting writers", "voices",
]

# Names in texts -------------------------------------------------------------------------------------------------------


def name_key(x: Column | str) -> Column:
    """Words of lower-cased ASCII letters and digits, Greek letters by their names."""
    text = F.col(x) if isinstance(x, str) else x
    spelled = F.when(text.rlike("[Ͱ-Ͽ]"), S.greek_names(text)).otherwise(text)
    return F.trim(F.regexp_replace(F.lower(F.coalesce(spelled, F.lit(""))), "[^a-z0-9]+", " "))


def names(organisations: DataFrame) -> DataFrame:
    """organisation_id, key, rank and nickname of every distinct name; organisations: organisation_id, name, slug, aliases.

    In order: the name, the slug, its words, the given aliases (null: none), the known nicknames.
    """
    nick = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), name_key("name")), F.expr("cast(array() as array<string>)"))
    given = F.coalesce("aliases", F.expr("cast(array() as array<string>)"))
    slug = F.coalesce("slug", F.lit(""))
    every = F.concat(F.array(F.coalesce("name", F.lit("")), slug, F.replace(slug, F.lit("-"), F.lit(" "))), given, nick)
    keys = F.array_distinct(F.filter(F.transform(every, name_key), lambda k: k != ""))
    rows = organisations.select("organisation_id", nick.alias("nick"), F.posexplode(keys).alias("rank", "key"))
    return rows.select("organisation_id", "key", "rank", F.array_contains("nick", F.col("key")).alias("nickname"))


class WordAutomaton:
    """Finds all of many word runs in one pass over a text's words."""

    def __init__(self, keys: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.ends = [0], [()]
        for n, key in enumerate(keys):
            node = 0
            for word in key.split(" "):
                if word not in self.next[node]:
                    self.next[node][word] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append(())
                node = self.next[node][word]
            self.ends[node] += (n,)
        queue = list(self.next[0].values())
        for node in queue:  # parents come before their children
            for word, child in self.next[node].items():
                back = self.fail[node]
                while back and word not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(word, 0)
                self.ends[child] += self.ends[self.fail[child]]
                queue.append(child)

    def scan(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(number of the key, place of its last word) of every run."""
        node, steps, fail, ends = 0, self.next, self.fail, self.ends
        for at, word in enumerate(words):
            while node and word not in steps[node]:
                node = fail[node]
            node = steps[node].get(word, 0)
            for n in ends[node]:
                yield n, at


def _by_automaton(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts has ``words`` (a key) as its last column; the others come with each find."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)
    kept = texts.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    sizes = [k.count(" ") + 1 for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_ = shared.value
        automaton = WordAutomaton(names_)
        for batch in batches:
            rows, found, at = [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for n, end in automaton.scan((text.as_py() or "").split(" ")):
                    rows.append(i)
                    found.append(names_[n])
                    at.append(end - sizes[n] + 1)
            places = pa.array(rows, pa.int64())
            columns = [*(c.take(places) for c in batch.columns[:-1]), pa.array(found, pa.string()), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "key", "at"])

    return texts.mapInArrow(run, f"{schema}, key string, at int")


def _by_join(texts: DataFrame, keys: DataFrame, row_id: str) -> DataFrame:
    keys = keys.select("key").distinct()
    firsts = keys.select(F.split("key", " ").alias("w")).select(F.col("w")[0].alias("first"), F.size("w").alias("n")).groupBy("first").agg(F.collect_set("n").alias("lengths"))
    starts = texts.select(row_id, F.posexplode(F.split("words", " ")).alias("at", "first")).join(firsts, "first")
    starts = starts.groupBy(row_id).agg(F.collect_list(F.struct("at", "lengths")).alias("starts"))
    runs = texts.join(starts, row_id).withColumn("w", F.split("words", " ")).select(*texts.columns[:-1], "w", F.explode("starts").alias("s")).select(*texts.columns[:-1], "w", F.col("s.at").alias("at"), F.explode("s.lengths").alias("n"))
    runs = runs.where(F.col("at") + F.col("n") <= F.size("w")).select(*texts.columns[:-1], F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("key"), "at")
    return runs.join(keys, "key", "left_semi").select(*texts.columns[:-1], "key", "at")


def marks(texts: DataFrame, keys: DataFrame, row_id: str, text: str = "text", most: int = AUTOMATON_WORDS) -> DataFrame:
    """All columns of texts but the text, and the key and place (first word) of every name in it; keys: key.

    row_id is unique. Names that overlap or hold one another are found each. Null texts hold none.
    """
    return found_in(texts.select(*(c for c in texts.columns if c != text), name_key(text).alias("words")), keys, row_id, most)


def found_in(rows: DataFrame, keys: DataFrame, row_id: str, most: int = AUTOMATON_WORDS) -> DataFrame:
    """``marks`` of rows whose last column, words, is a key already."""
    distinct = keys.select("key").distinct()
    size = distinct.agg(F.sum(F.size(F.split("key", " ")))).first()[0] or 0
    if size > most:
        return _by_join(rows, distinct, row_id)
    return _by_automaton(rows, sorted(r[0] for r in distinct.collect()))


def other_campus(text: Column, school: Column) -> Column:
    """Whether a zone (a key) seems to speak of another campus than the school (a key)."""
    initials = F.array_join(F.transform(F.filter(F.split(school, " "), lambda w: (w != "") & ~w.isin("of", "the", "and", "at")), lambda w: F.substring(w, 1, 1)), "")
    own = text.contains(school) | ((initials != "") & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), initials, F.lit(" "))))
    twice = (F.regexp_count(text, F.lit("university")) >= 2) & ~text.contains(school)
    return (school != "") & (twice | (~own & _any(text, CAMPUS_MARKERS)))


def zone_matches(zones: DataFrame, organisations: DataFrame, most: int = AUTOMATON_WORDS) -> DataFrame:
    """[J18] zone_id, organisation_id, alias, method and confidence of every organisation that a zone names.

    zones: zone_id (unique), text and the school of their campus (null: unknown). A zone that seems to speak of another
    campus names none. In a context of chapters any name counts, the first of an organisation's in order; without one
    only nicknames do.
    """
    n = names(organisations).where(~F.col("key").isin(AMBIGUOUS))
    keyed = zones.select("zone_id", name_key("text").alias("words"), name_key("school").alias("campus"))
    rows = keyed.select("zone_id", _any(F.col("words"), ZONE_CONTEXT).alias("context"), other_campus(F.col("words"), F.col("campus")).alias("elsewhere"), "words")
    found = found_in(rows.where("not elsewhere").select("zone_id", "context", "words"), n, "zone_id", most).select("zone_id", "context", "key").distinct().join(n, "key").where("context or nickname")
    first = F.min(F.struct("rank", F.col("key").alias("alias"))).alias("f")
    found = found.groupBy("zone_id", "organisation_id", "context").agg(first)
    return found.select("zone_id", "organisation_id", "f.alias", F.when(F.col("context"), "exact_alias").otherwise("nickname").alias("method"), F.when(F.col("context"), 0.99).otherwise(0.94).alias("confidence"))


# Conflicts ------------------------------------------------------------------------------------------------------------


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, map(text.contains, words))  # evaluates the text once, unlike a lambda over an array


def _plain(*parts: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), "[^a-z0-9]+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _initials(text: Column, skipped: tuple[str, ...] = ("of", "the", "and", "at")) -> Column:
    words = F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(*skipped)) if skipped else _words(text)
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def _mapped(names_: dict[str, list[str]], key: Column) -> Column:
    pairs = (x for k, v in names_.items() for x in (F.lit(k), F.array(*map(F.lit, v))))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.expr("cast(array() as array<string>)"))


def names_another(name: Column, slug: Column, *parts: Column) -> Column:
    """[D16] Whether a result names another organisation of Greek letters and not this one by any of its names."""
    text = F.trim(F.regexp_replace(F.lower(S.greek_names(F.concat_ws(" ", *parts))), r"\s+", " "))
    name, slug = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(slug, F.lit("")))
    initials = _initials(F.trim(F.regexp_replace(name, "[^a-z0-9]+", " ")), ())
    own = F.concat(F.array(F.trim(name), F.replace(slug, F.lit("-"), F.lit(" ")), F.when(F.length(initials) >= 3, initials).otherwise(""), F.replace(slug, F.lit("-"), F.lit(""))), _mapped(SEARCH_NAMES, F.trim(name)))
    own = F.filter(own, lambda p: p != "")
    return (F.size(own) > 0) & ~F.exists(own, text.contains) & (F.size(S.greek_phrases(text)) > 0)


# Jobs and contacts ----------------------------------------------------------------------------------------------------


def _significant(text: Column) -> Column:
    """Telling words of a plain text: of four letters or more, else of three."""
    words = _words(text)
    long = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(MATCH_STOPWORDS))
    return F.when(F.size(long) > 0, long).otherwise(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "of", "for")))


def job_facts(slug: Column, chapter: Column, chapter_slug: Column, school: Column) -> Column:
    """struct of what texts are matched with: the organisation's, the school's and the chapter's names and words."""
    shown, school, chapter = _plain(F.replace(F.coalesce(slug, F.lit("")), F.lit("-"), F.lit(" "))), _plain(F.coalesce(school, F.lit(""))), _plain(F.coalesce(chapter, F.lit("")))
    kept = F.array_join(F.filter(_words(shown), lambda w: ~w.isin(NO_IDENTITY)), " ")
    phrase = F.when(kept != "", kept).otherwise(shown)
    tokens = F.filter(_words(phrase), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "of", "for"))
    joined = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    initials, slugged = _initials(phrase), F.array_join(F.filter(_words(shown), lambda w: ~w.isin("main", "national")), " ")
    aliases = F.concat(F.array(phrase, F.when(F.length(joined(phrase)) >= 6, joined(phrase)).otherwise(""), F.when(F.length(initials) >= 2, initials).otherwise(""), F.when(F.size(_words(phrase)) >= 2, F.array_join(F.slice(_words(phrase), 1, 2), " ")).otherwise(""), slugged), _mapped(SEARCH_NAMES, phrase))
    own_words = F.filter(_words(shown), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "of", "for"))
    signal = lambda x: F.filter(_significant(x), lambda w: ~F.array_contains(_significant(school), w) & ~F.array_contains(own_words, w) & ~w.isin(CHAPTER_STOPWORDS))
    by_slug = _plain(F.coalesce(chapter_slug, F.lit("")))
    return F.struct(
        phrase.alias("phrase"), tokens.alias("tokens"), F.array_distinct(F.filter(aliases, lambda a: a != "")).alias("aliases"), joined(shown).alias("compact"), _initials(shown).alias("initials"), F.array_distinct(F.concat(tokens, own_words)).alias("own_words"),
        chapter.alias("chapter"), _initials(chapter).alias("chapter_initials"), school.alias("school"), _significant(school).alias("school_words"), _initials(school).alias("school_initials"), _significant(chapter).alias("chapter_words"), F.when(F.size(signal(chapter)) > 0, signal(chapter)).otherwise(signal(by_slug)).alias("chapter_signal"),
    )


def organisation_matches(job: Column, text: Column) -> Column:
    """Whether a plain text names the job's organisation, by phrase, alias or its words."""
    joined, padded = F.replace(text, F.lit(" "), F.lit("")), F.concat(F.lit(" "), text, F.lit(" "))
    short = lambda a: F.length(a).between(1, 3) & a.rlike("^[a-z]+$")
    holds = lambda a: text.contains(a) | F.when(short(F.replace(a, F.lit(" "), F.lit(""))), padded.contains(F.concat(F.lit(" "), F.replace(a, F.lit(" "), F.lit("")), F.lit(" ")))).otherwise(joined.contains(F.replace(a, F.lit(" "), F.lit(""))))
    greek = F.forall(job["tokens"], lambda w: w.isin([*S.GREEK.values()]))
    hits = F.size(F.filter(job["tokens"], text.contains))
    words = F.when(greek, hits == F.size(job["tokens"])).otherwise(hits >= F.least(F.size(job["tokens"]), F.lit(2)))
    by_phrase = text.contains(job["phrase"]) | joined.contains(F.replace(job["phrase"], F.lit(" "), F.lit("")))
    return (job["phrase"] != "") & (text != "") & (by_phrase | F.exists(job["aliases"], holds) | ((F.size(job["tokens"]) > 0) & words))


def school_conflicts(job: Column, text: Column) -> Column:
    """Whether a plain text speaks of another school of a like name: of X, X State and X of the wrong kind."""
    school, of = job["school"], job["school"].startswith("university of ")
    core = F.regexp_replace(school, "^university of | state university$", "")
    before = F.call_function("regexp_extract", text, F.concat(F.lit(r"\b([a-z0-9]+) "), school, F.lit(r"\b")), F.lit(1))
    prefixed = of & (before != "") & ~before.isin(PREFIXES_ALLOWED) & ~F.array_contains(job["own_words"], before)
    stated = of & (core != "") & text.contains(F.concat(core, F.lit(" state")))
    other = school.endswith(" state university") & (core != "") & text.contains(F.concat(F.lit("university of "), core)) & ~text.contains(school)
    return (school != "") & (text != "") & (prefixed | stated | other)


def school_matches(job: Column, text: Column) -> Column:
    words = job["school_words"]
    hits = F.size(F.filter(words, text.contains))
    named = ((job["school"] != "") & text.contains(job["school"])) | ((F.size(words) > 0) & (hits >= F.least(F.size(words), F.lit(2))))
    return ~school_conflicts(job, text) & named


def chapter_matches(job: Column, text: Column) -> Column:
    return F.exists(job["chapter_signal"], text.contains)


def names_other_organisation(job: Column, title: Column, start: Column) -> Column:
    """Whether a document names another organisation: in its (plain) title, or at its (plain) start without the job's."""
    other = lambda x: (x != "") & (job["phrase"] != "") & ~x.contains(job["phrase"]) & (F.size(S.greek_phrases(x)) > 0)
    return other(title) | (other(start) & ~organisation_matches(job, start))


@dataclass(frozen=True)
class Mail:
    """What an address looks like to a job, as Columns."""

    identity: Column
    office: Column
    person: Column
    known_domain: Column
    overlap: Column
    contact_page: Column
    low_signal: Column
    relevant: Column


def mail_facts(df: DataFrame, email: Column, job: Column, provider: Column, doc_url: Column, title: Column, text: Column, doc_tier: Column, campus_domains: Column, source_url: Column, website: Column) -> tuple[DataFrame, Mail]:
    """[D22] From an address, its document and the job (``job_facts``); df gets the texts that the facts are read from."""
    limits = {"_near": 1200, "_page": 1200, "_front": 900, "_start": 300}
    df = df.withColumns({k: _plain(title, F.substring(text, 1, n), doc_url, *([email] if k == "_near" else [])) for k, n in limits.items()} | {"_head": _plain(title), "_job": job, "_tier": doc_tier})
    near, page, front, start, head, job, doc_tier = map(F.col, ("_near", "_page", "_front", "_start", "_head", "_job", "_tier"))
    local, domain = F.lower(F.substring_index(email, "@", 1)), F.when(email.contains("@"), F.lower(F.trim(F.substring_index(email, "@", -1)))).otherwise("")
    joined = F.regexp_replace(local, "[^a-z0-9]+", "")
    holds = lambda x, least: (F.length(x) >= least) & joined.contains(x)
    at = lambda host: F.coalesce((host != "") & ((domain == host) | domain.endswith(F.concat(F.lit("."), host))), F.lit(False))
    df = df.withColumns({
        "_identity": (joined != "") & (holds(job["compact"], 1) | holds(job["school_initials"], 3) | F.exists(job["chapter_words"], lambda w: holds(w, 4)) | holds(job["initials"], 3)),
        "_office": local.isin(OFFICE_PREFIXES) | _any(local, OFFICE_MARKERS),
        "_known": (domain != "") & (domain.endswith(".edu") | at(S.url_host(website)) | at(S.url_host(source_url)) | F.coalesce(F.exists(campus_domains, lambda d: at(F.lower(d))), F.lit(False))),
        "_clash": school_conflicts(job, near), "_school": school_matches(job, near), "_own": organisation_matches(job, near), "_chapter": chapter_matches(job, near), "_contact": _any(page, ROLE_MARKERS),
        "_other": names_other_organisation(job, head, start),
    })
    identity, office, known, clash, school, own, chapter, contact, other = map(F.col, ("_identity", "_office", "_known", "_clash", "_school", "_own", "_chapter", "_contact", "_other"))
    strong, tier1 = contact & (school | chapter), doc_tier == "tier1"
    relevant = (
        F.when(clash, False)
        .when(office & ~identity, F.coalesce(provider == "chapter_website", F.lit(False)) & own & strong)
        .when((provider == "provenance") & known & ~office & ~other, True)
        .when(tier1 & F.coalesce(provider != "provenance", F.lit(True)) & ~(own | chapter | identity), False)
        .otherwise((identity & (school | chapter | own)) | (own & (school | chapter) & known) | (strong & known & ~office))
    )
    overlap = reduce(lambda a, b: a + b, (F.when(c, p).otherwise(0) for c, p in ((school, 2), (own, 2), (chapter, 1), (known, 1))))
    return df, Mail(identity, office, local.rlike("^[a-z]{2,}[._-][a-z]{2,}[0-9]{0,4}$"), known, overlap, contact, _any(front, LOW_SIGNAL_MARKERS), relevant)


def mail_alone(email: Column, job: Column, looks: Mail) -> Column:
    """Whether an address speaks for the job without any document."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(email, F.lit(""))), "[^a-z0-9]+", " "))
    own = organisation_matches(job, text)
    return F.when(looks.office & ~looks.identity, False).otherwise((looks.identity & (looks.known_domain | own)) | (own & school_matches(job, text)))
