"""Quality rules with host-level verdicts, in DataFrame functions only.

Each text is measured once (words, symbols, repeated lines and repeated five-word windows). The failures of the base
rule are summed by host, each host's rate is shrunk toward all hosts' by a beta prior fitted to them by moments, and a
host whose shrunk rate is over HOST_LIMIT takes all its documents with it.

Defined cases: null text counts as no words and fails; a null host has no host verdict; repeated rows count and return
once each; a host exactly at the limit stays; very long texts are measured whole, their windows sorted within the row; an
empty table gives no rows; other columns are passed along by ``measured`` in the struct ``row``. Window equality is that
of 64-bit hashes of the words, word by word in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import WHITE, table, written

HOST_LIMIT = 0.5
WINDOW = 5
#: Up to so many rejected hosts are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 100_000


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, r"[ \t-\r]+", -1))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """row (all columns), host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    df = docs.select(F.struct("*").alias("row")).withColumn("words", words_of(F.col("row.text")))
    df = df.select(
        "row",
        F.col(f"row.`{host}`").alias("host"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    gram = lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW)))
    none = F.expr("cast(array() as array<bigint>)")
    df = df.select(
        "row", "host", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), gram)).otherwise(none).alias("grams"),
    )
    pairs = F.expr("cast(array() as array<struct<g:bigint,i:int>>)")
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(pairs)).drop("grams")
    twice = lambda x, k: (x["g"] == F.get("sorted", k - 1)["g"]) | (x["g"] == F.get("sorted", k + 1)["g"])
    df = df.withColumn("at", F.array_sort(F.transform(F.filter("sorted", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"]))).drop("sorted")
    steps = F.transform("at", lambda x, k: F.least(F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", covered).drop("at")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n, failed and rate (shrunk) of each host, from rows with host and base_failed."""
    hosts = written(rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed")))
    rate = F.col("failed") / F.col("n")
    p = hosts.agg(F.sum("failed").alias("k"), F.sum("n").alias("n"), F.count("*").alias("hosts"), F.var_samp(rate).alias("var"), F.avg(F.lit(1.0) / F.col("n")).alias("noise")).first()
    mean = min(max((p["k"] or 0) / (p["n"] or 1), 1e-6), 1 - 1e-6)
    spread = max((p["var"] or 0.0) - mean * (1 - mean) * (p["noise"] or 0.0), mean * (1 - mean) / 1e4)  # between hosts
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)
    return hosts.select("host", "n", "failed", ((F.col("failed") + mean * weight) / (F.col("n") + weight)).alias("rate"))


def judged(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """rows (written, with host and base_failed) and their verdict, kept."""
    bad = written(host_rates(rows).where(F.col("rate") > limit).select(F.col("host").alias("bad_host")))
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    joined = rows.join(bad, rows["host"] == F.col("bad_host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull()).drop("bad_host")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = written(measured(docs).select(F.col("row.doc_id").alias("doc_id"), "host", *COUNTS))
    return judged(rows).select("doc_id", *COUNTS, "kept")


OP6_SQL = r"""
with d as (
  select row_number() over () as k, doc_id, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), g as (
  select k, i, array_to_string(w[i : i + 4], ' ') as gram from (select k, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
), twice as (
  select k, i from (select k, i, count(*) over (partition by k, gram) as c from g) where c > 1
), covered as (
  select k, count(distinct j) as n from (select k, unnest(range(i, i + 5)) as j from twice) group by k
), m as (
  select d.k, doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d) d left join covered using (k)
), b as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m
), h as (
  select source, count(*) as n, count(*) filter (base_failed) as failed from b where source is not null group by source
), p as (
  select least(greatest(sum(failed) / greatest(sum(n), 1), 1e-6), 1 - 1e-6) as mean, coalesce(var_samp(failed / n), 0) as var, avg(1.0 / n) as noise from h
), q as (
  select mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * noise, mean * (1 - mean) / 1e4) - 1, 1.0), 1e4) as weight from p
), bad as (
  select source from h, q where (failed + mean * weight) / (n + weight) > 0.5
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (source is null or source not in (select source from bad)) as kept
from b
"""
