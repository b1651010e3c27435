"""URL filters by a sort-merge range join.

A rule is a host and a path prefix; it covers the host, all its subdomains, and every path that starts with its path.
With the host reversed ("com.example", then a zero byte, then the path), the prefix of a rule becomes one interval of
keys. Rules of one host nest or lie apart, so a sorted sweep over their opening and closing keys with a stack of the
active rules cuts the keys into stretches with one innermost rule each. The stretches are then merged into the URLs'
sort order: every bucket of URLs is swept once for each host depth that rules have, and the last stretch begun before a
key says which rule holds. URLs are dealt to buckets by hash, so a hot host is spread; the rules are copied to each
bucket, of which there is one per BUCKET_ROWS URLs (or per shuffle partition).

Defined cases: a null URL or one without "://" has an empty host and path and no rule; repeated rows are judged once
each; of rules with equal host and path, block holds; the longest fitting rule (host plus path) wins, of equally long
ones that with more host labels; without a rule the verdict is allow; very long URLs are compared whole; an empty table
or no rules work; columns of any other name are passed along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import lower_ascii, table

BUCKET_ROWS = 500_000
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw) + F.lit(1), F.length(rest) + F.lit(1))
    return lower_ascii(raw), F.regexp_extract(tail, "^[^?#]*", 0)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules as a DataFrame of host, path and verdict."""
    rows = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), r, strict=True))) for r in rules]
    empty = "cast(array() as array<struct<host string, path string, verdict string>>)"
    return spark.range(1).select(F.inline(F.array(*rows) if rows else F.expr(empty)))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.encode(F.array_join(F.reverse(labels), "."), "utf-8"), F.lit(b"\x00"), F.encode(path, "utf-8"))


def stretches(rules: DataFrame) -> DataFrame:
    """depth, key and the innermost rule (null: none) from that key on."""
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split("host", r"\.", -1)
    key = _key(labels, F.col("path"))
    rule = F.struct(F.concat("host", "path").alias("rule"), F.col("verdict"))
    event = lambda at, opens: F.struct(at.alias("key"), F.lit(opens).alias("opens"), rule.alias("rule"))
    events = rules.select("host", F.size(labels).alias("depth"), F.explode(F.array(event(key, 1), event(F.concat(key, F.lit(b"\xff")), 0))).alias("e"))
    kind = "struct<rule:string,verdict:string>"
    start = F.expr(f"named_struct('stack', cast(array() as array<{kind}>), 'out', cast(array() as array<struct<key:binary,rule:{kind}>>))")

    def step(acc: Column, e: Column) -> Column:
        stack = F.when(e["opens"] == 1, F.array_append(acc["stack"], e["rule"])).otherwise(F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0))))
        return F.struct(stack.alias("stack"), F.array_append(acc["out"], F.struct(e["key"].alias("key"), F.get(stack, F.size(stack) - 1).alias("rule"))).alias("out"))

    swept = F.aggregate(F.array_sort(F.collect_list("e")), start, step)["out"]
    return events.groupBy("host", "depth").agg(swept.alias("out")).select("depth", F.explode("out").alias("o")).select("depth", "o.key", "o.rule")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """All columns of pages as the struct ``row``, with host, path, rule and verdict."""
    spark = pages.sparkSession
    cuts = stretches(rules)
    depth = cuts.agg(F.max("depth")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pages.count() / BUCKET_ROWS))
    host, path = host_path(F.col(url))
    urls = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    keys = [F.when(F.size(labels) >= d, _key(F.slice(labels, -d, d), F.col("path"))).alias(f"key{d}") for d in range(1, depth + 1)]
    found = urls.select(F.pmod(F.xxhash64("host", "path", F.monotonically_increasing_id()), F.lit(buckets)).alias("bucket"), F.lit(1).alias("kind"), "row", "host", "path", *keys)
    if depth:
        at = lambda d, c: F.when(F.col("depth") == d, c)
        copies = cuts.select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"),
            F.lit(0).alias("kind"),
            *(at(d, F.col("key")).alias(f"key{d}") for d in range(1, depth + 1)),
            *(at(d, F.struct("rule")).alias(f"cut{d}") for d in range(1, depth + 1)),
        )
        found = found.unionByName(copies, allowMissingColumns=True)
        for d in range(1, depth + 1):
            swept = Window.partitionBy("bucket").orderBy(F.col(f"key{d}").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
            found = found.withColumn(f"cut{d}", F.last(f"cut{d}", ignorenulls=True).over(swept))
        found = found.where("kind = 1")
    best = [F.when(F.col(f"cut{d}.rule").isNotNull(), F.struct(F.length(F.col(f"cut{d}.rule.rule")).alias("n"), F.lit(d).alias("d"), F.col(f"cut{d}.rule.rule").alias("rule"), F.col(f"cut{d}.rule.verdict").alias("verdict"))) for d in range(1, depth + 1)]
    nothing = F.expr("cast(null as struct<n:int,d:int,rule:string,verdict:string>)")
    return found.select("row", "host", "path", F.greatest(nothing, nothing, *best).alias("b")).select("row", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules_table(spark, RULES)).select("row.page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, regexp_extract(rest, '^[^/?#]*', 0) as raw, rest from u
), p as (
  select page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) as path
  from h
), r as (
  select page_id, host, path, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/'
  end as rule from p
)
select page_id, host, path, rule,
  case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
from r
"""
