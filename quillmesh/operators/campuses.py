"""Whether a campus lets organisations be, read from its own pages. Names in brackets are the survey's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S

# Fixed values ---------------------------------------------------------------------------------------------------------

NO_NAME = ["university", "college", "institute", "school", "of", "the", "at"]
#: Words that tell no school from another.
NO_IDENTITY = "chapter chapters colony colonies fraternity international official national nationals the and for at of university college campus".split()
BANS = ["banned fraternities", "banned from campus", "abolish the fraternity system", "abolished the fraternity system", "no active greek life chapters", "there are no fraternities", "fraternities are no longer", "no greek life", "no fraternities on campus"]
BAN_SIGNALS = ["fraternit", "greek life", "greek organizations", "board of trustees", "abolish", "banned", "suspended", "discontinued", "no longer"]
ALLOWED = ["fraternity and sorority life", "recognized chapters", "interfraternity council", "fraternity chapters", "student organizations", "fraternities"]
CHAPTER_LISTS = ["chapters at", "fraternity chapters", "recognized chapters", "chapter scorecards", "active chapters", "community scorecard", "chapter list", "councils and chapters"]
PAST = ["unrecognized orgs", "unrecognized organizations", "hazing", "violations", "conduct", "archive", "archives", "history", "historical"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, map(text.contains, words))


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(S.greek_names(F.coalesce(text, F.lit("")))), r"\s+", " "))


def _without(words: Column, dropped: list[str]) -> Column:
    return F.filter(words, lambda w: (w != "") & ~w.isin(*dropped))


def own_host(host: Column, school: Column) -> Column:
    """Whether a host is the school's: by its telling words, their starts or its initials."""
    name, text = plain(school), F.replace(F.lower(F.coalesce(host, F.lit(""))), F.lit("."), F.lit(" "))
    words = F.filter(_without(F.split(name, "[^a-z0-9]+"), NO_IDENTITY), lambda w: F.length(w) >= 4)
    kept, broad = _without(F.split(name, " "), NO_NAME), _without(F.split(name, " "), ["of", "the", "at"])
    initials = lambda x: F.when(F.size(x) >= 2, F.array_join(F.transform(F.slice(x, 1, 4), lambda w: F.substring(w, 1, 1)), "")).otherwise("")
    of = F.when(name.startswith("university of ") & (F.size(kept) > 0), F.concat(F.lit("u"), F.substring(F.get(kept, F.lit(0)), 1, 4))).otherwise("")
    starts = F.transform(F.filter(kept, lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 6))
    aliases = F.filter(F.concat(starts, F.array(of, initials(kept), initials(broad))), lambda a: F.length(a) >= 3)
    hits, short = F.size(F.filter(words, text.contains)), F.exists(aliases, text.contains)
    named = (F.size(words) > 0) | (F.size(aliases) > 0)
    return F.when(text.endswith(" edu"), (hits >= 1) | short).otherwise(named & ((hits >= F.least(F.size(words), F.lit(2))) | short))


def names_school(text: Column, school: Column) -> Column:
    """Whether a plain text names the school, in full or by its telling words, letters and digits alone."""
    name = plain(school)
    words = F.filter(F.split(name, "[^a-z0-9]+"), lambda w: w != "")
    kept, of = _without(words, NO_NAME), (F.get(words, F.lit(0)) == "university") & (F.get(words, F.lit(1)) == "of")
    compact = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    first = F.when(of & (F.size(kept) > 0), F.concat(F.lit("universityof"), F.get(kept, F.lit(0)))).otherwise("")
    phrases = F.array(compact(name), F.array_join(kept, ""), F.coalesce(first, F.lit("")))
    return F.exists(phrases, lambda p: (p != "") & compact(text).contains(p))


def greek_policy(school: Column, url: Column, title: Column, text: Column) -> Column:
    """[D19] struct of policy (banned, allowed or unknown), confidence and reason.

    Read are the title, the first 2,400 characters of the text and the address; nulls are empty.
    """
    every = plain(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (title, F.substring(text, 1, 2400), url))))
    made = lambda p, c, r: F.struct(F.lit(p).alias("policy"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    ban = _any(every, BANS)
    signals = reduce(lambda a, b: a + b, (every.contains(w).cast("int") for w in BAN_SIGNALS))
    return (
        F.when(~own_host(F.coalesce(S.url_host(url), F.lit("")), school), made("unknown", 0.0, "non_official_school_source"))
        .when(~names_school(every, school) & ~ban, made("unknown", 0.0, "school_identity_missing"))
        .when(ban & (signals >= 2), made("banned", 0.97, "strong_ban_phrase"))
        .when(_any(every, ALLOWED) & _any(every, CHAPTER_LISTS) & ~_any(every, PAST), made("allowed", 0.9, "current_official_greek_life_context"))
        .otherwise(made("unknown", 0.28, "no_conclusive_policy_signal"))
    )
