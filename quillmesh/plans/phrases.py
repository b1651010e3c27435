"""Queries that apply the text functions to phrases that reach their branches, and to lines of documents, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.plans.analogs import duck_sql, run_sql

Query = Callable[[SparkSession, str], DataFrame]

WORDS = [
    "Texas", "new-york", "N.Y.", "ca", "district of columbia", "Ontario", "T X", "rhode island", "ny (upstate)", "zz",
    "jane (at) rice [dot] edu", "bob@x.org", "A {AT} b (dot) c ( Dot ) org", "at dot", "( at )",
    "Austin, TX", "Houston", "Paris, Lamar, TX", " , CA", "Town,", "Sigma Chi - Rice University", "Beta Rho (Texas Tech)", "Zeta: State", "Kappa|Sigma", "Mu | Omega College", "A-B", "BETA RHO CHAPTER", "Beta RHO", "ΑΒΓ HOUSE", "123", "SIGMA 4 chi",
    "12 Main Street", "PO Box 12", "P. O. Box 9", "Dallas TX 75001", "5 Oak", "100 Elm Ave, Suite 2", "Streetwise 12", "7 way",
    "City: Austin<br>State: <b>TX</b>", "a: 1<BR/>A: 2<br />b : x: y", "none", "Key:<br>: v", "<i>Year</i>: 1999",
    "John Smith", "Alpha Smith", "Mary-Ann O'neil", "J. Smith", "John Paul van Dam", "Rice University", "Anna B. Cole Ford Hill", "Chapter House",
    "to the University of Texas Austin, then", "now at Rice University in town", "Boston College 1999", "Georgia Institute of Technology", "the university of texas", "College", "Texas A&M University",
    "Alpha Beta", "the Alpha Beta Gamma of sigma CHI", "Alpha", "alphabet beta", "Delta Epsilon Zeta Eta Theta Iota", "west region", "1998 1999", "no 5", "3rd place", "42 %", "blue lakes", "lakes", "Southern Conference", "tech",
]

_CASES = " ".join("when {} then '{}'".format(i, w.replace("'", "''")) for i, w in enumerate(WORDS))
#: A phrase or the first line of a text, for each document.
PHRASES = f"select doc_id as id, coalesce(case doc_id % {len(WORDS) + 9} {_CASES} end, trim(split_part(text, chr(10), 1))) as x from {{documents}} where text is not null"


def _on(*columns: Callable[[], Column]) -> Query:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, PHRASES).select("id", *(c() for c in columns))


def _sorted_pairs() -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(S.described("x")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


QUERIES: dict[str, Query] = {
    "c05_states": _on(lambda: S.state_code("x").alias("state"), lambda: S.state_code_strict("x").alias("strict")),
    "c17_deobfuscated": _on(lambda: S.deobfuscated("x").alias("email")),
    "c19_places": _on(lambda: S.city_state("x")["city"].alias("city"), lambda: S.city_state("x")["state"].alias("state"), lambda: S.locator_city_state("x")["city"].alias("first"), lambda: S.locator_city_state("x")["state"].alias("last")),
    "c21_headings": _on(lambda: S.heading_parts("x")["name"].alias("name"), lambda: S.heading_parts("x")["school"].alias("school")),
    "c22_calm_titles": _on(lambda: S.calm_title("x").alias("calm")),
    "c23_addresses": _on(lambda: S.looks_like_address("x").alias("address")),
    "c25_descriptions": _on(lambda: _sorted_pairs().alias("pairs")),
    "c29_greek_phrases": _on(lambda: F.array_join(S.greek_phrases("x"), ";").alias("phrases")),
    "c30_people": _on(lambda: S.looks_like_person("x").alias("person")),
    "c31_schools": _on(lambda: S.school_in("x").alias("school")),
    "c32_signals": _on(lambda: S.institution_signals("x").alias("signals")),
}


def _state(x: str) -> str:
    names = " ".join(f"when '{k}' then '{v}'" for k, v in S.STATES.items())
    codes = "[" + ", ".join(f"'{v}'" for v in S.STATES.values()) + "]"
    return f"case when list_contains({codes}, upper({x})) then upper({x}) else case {x} {names} end end"


_LETTERS = "|".join(S.GREEK.values())
_NAME = r"[A-Z][A-Za-z.&''\-]+"
_PERSON = rf"(len(words) between 2 and 4 and len(list_filter(words, lambda w: not (regexp_matches(w, '^[A-Z][a-z''\-]+\.?$') and not regexp_matches(lower(w), '^({_LETTERS}|university|college|school|institute|state|chapter|colony)$')))) = 0)"
_WORDS = r"regexp_split_to_array(trim(x), '\s+') as words"
_HEADING = r"'^\s*(.+?)\s*(?:[-–—|:]\s+|\()\s*(.+?)\)?\s*$'"
_BLANK = "nullif(trim({}), '')"

_SQL: dict[str, str] = {
    "c05_states": f"with p as ({PHRASES}), q as (select id, trim(regexp_replace(lower(x), '[^a-z]+', ' ', 'g')) as a, trim(regexp_replace(lower(x), '[^a-z ]', '', 'g')) as b from p) select id, {_state('a')} as state, {_state('b')} as strict from q",
    "c17_deobfuscated": rf"select id, regexp_replace(regexp_replace(x, '\s*[\(\[\{{]\s*at\s*[\)\]\}}]\s*', '@', 'gi'), '\s*[\(\[\{{]\s*dot\s*[\)\]\}}]\s*', '.', 'gi') as email from ({PHRASES}) p",
    "c19_places": f"""select id, {_BLANK.format("split_part(x, ',', 1)")} as city, case when contains(x, ',') then {_BLANK.format("substr(x, strpos(x, ',') + 1)")} end as state,
        {_BLANK.format("split_part(x, ',', 1)")} as first, case when contains(x, ',') then {_BLANK.format("split_part(x, ',', -1)")} end as last from ({PHRASES}) p""",
    "c21_headings": f"select id, nullif(regexp_extract(x, {_HEADING}, 1), '') as name, nullif(regexp_extract(x, {_HEADING}, 2), '') as school from ({PHRASES}) p",
    "c22_calm_titles": rf"""with p as ({PHRASES}), q as (select id, x, len(regexp_replace(x, '\P{{L}}', '', 'g')) as n, len(regexp_replace(x, '\P{{Lu}}', '', 'g')) as u from p)
        select id, case when n > 0 and u >= 0.7e0 * n then array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') else x end as calm from q""",
    "c23_addresses": rf"select id, regexp_matches(x, '\b\d{{1,6}}\s+\S+.*\b(st|street|ave|avenue|rd|road|blvd|boulevard|dr|drive|ln|lane|way|court|ct|hwy)\b|\b[A-Z]{{2}}\s+\d{{5}}\b|\bp\.?\s*o\.?\s*box\b', 'i') as address from ({PHRASES}) p",
    "c25_descriptions": rf"""with p as ({PHRASES}), l as (select id, unnest(regexp_split_to_array(x, '(?i)<br\s*/?>')) as line, generate_subscripts(regexp_split_to_array(x, '(?i)<br\s*/?>'), 1) as place from p),
        t as (select id, place, trim(regexp_replace(line, '<[^>]+>', '', 'g')) as line from l), k as (select id, place, lower(trim(split_part(line, ':', 1))) as k, trim(substr(line, strpos(line, ':') + 1)) as v from t where contains(line, ':')),
        d as (select id, k, first(v order by place) as v from k group by 1, 2), j as (select id, string_agg(k || '=' || v, ';' order by k || '=' || v) as pairs from d group by 1) select p.id, coalesce(pairs, '') as pairs from p left join j on j.id = p.id""",
    "c29_greek_phrases": rf"select id, array_to_string(regexp_extract_all(x, '(?i)\b(?:{_LETTERS})(?:\s+(?:{_LETTERS})){{1,3}}\b'), ';') as phrases from ({PHRASES}) p",
    "c30_people": f"select id, {_PERSON} as person from (select *, {_WORDS} from ({PHRASES}) p) q",
    "c31_schools": rf"""select id, coalesce(nullif(regexp_extract(x, '\bUniversity of {_NAME}(?:\s+{_NAME}){{0,2}}'), ''), nullif(regexp_extract(x, '\b{_NAME}(?:\s+{_NAME}){{0,3}} University\b'), ''), nullif(regexp_extract(x, '\b{_NAME}(?:\s+{_NAME}){{0,2}} College\b'), ''),
        nullif(regexp_extract(x, '\b{_NAME}(?:\s+{_NAME}){{0,2}} Institute of Technology\b'), '')) as school from ({PHRASES}) p""",
    "c32_signals": rf"""with q as (select id, {_PERSON} as person, trim(regexp_replace(lower(x), '[^a-z0-9%]+', ' ', 'g')) as l from (select *, {_WORDS} from ({PHRASES}) p) w)
        select id, case when l = '' or person or regexp_matches(l, '^[0-9]+ ?%?$|\b(18|19|20)[0-9]{{2}} (18|19|20)[0-9]{{2}}\b|^(no|rank|top) ?[0-9]+|^[0-9]+(st|nd|rd|th)\b') then 0 when regexp_matches(l, '{"|".join(S.SCHOOL_TOKENS)}') then 2
        when contains(l, ' ') and not regexp_matches(l, '{"|".join(S.DIVISIONS)}') then 1 else 0 end as signals from q""",
}

ORACLE_SQL: dict[str, str] = {k: duck_sql(v) for k, v in _SQL.items()}
