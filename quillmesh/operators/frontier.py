"""Crawls of many sessions at once: each round every session visits the best page of its frontier, until it has a reason to stop.

A round is a handful of joins over all sessions that still run. What is found, visited and spent is written after every
round to the cluster's shared folder and read back, so that the plan of the hundredth round is as short as the first's
and a lost executor repeats tasks of one round. Names in brackets are the survey's.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.operators.scoring import frontier_score, stop_reason


@dataclass(frozen=True)
class Budget:
    """Limits of a session; 0 lifts a limit on pages, empty pages, records or saturation. Defaults are fixed values."""

    pages: int = 40
    depth: int = 3
    links: int = 8  # queued from one page
    links_of_rich: int = 3  # queued from a page that gave records
    empty: int = 5
    saturation: int = 4
    records: int = 60
    score: float = 0.1


FOUND = "session_id {0}, link string, score double, depth int, created long, ordinal int"
STEPS = "session_id {0}, source_url string, stop_reason string, link string, score double, depth int, got long, pages int, records long, streak int"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared one; a temporary one only where none is set, as in tests."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or os.path.join(tempfile.gettempdir(), 'quillmesh')}/{name}-{uuid.uuid4().hex}"


class _Log:
    """A table that grows by a folder a round."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, n: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/round={n}")

    def read(self, n: int | None = None) -> DataFrame:
        if n is not None:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={n}")
        return self.spark.read.schema(f"{self.schema}, round int").parquet(self.path)


def crawl(sessions: DataFrame, pages: DataFrame, links: DataFrame, budget: Budget = Budget(), folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """[D46, D13, K02, T05, U03] The pages that each session visits, in order, and why it stopped.

    sessions: session_id (unique), source_url, seeds (an array; null: none). pages: url (canonical, unique), records,
    has_map, repeated. links: at (a page's url), ordinal, link (canonical), anchor. Links to pages that aren't among pages
    or belong to another host family than the source are never queued.

    A session visits the queued page of the best score, then least depth, then the one found first, ties by address. A
    page that is found again keeps its depth and place and the greater of its scores. A page queues the first of its links
    that reach the least score. Returns visits (session_id, step from 1, link, score, depth, records) and stops
    (session_id, stop_reason, pages, records, streak of pages without records). Rounds are as many as the pages of the
    longest session; with no limit on pages they end when every frontier is empty.
    """
    spark = sessions.sparkSession
    kind = sessions.schema["session_id"].dataType.simpleString()
    folder = folder or shared_folder(spark, "crawl")
    found, steps = _Log(spark, f"{folder}/found", FOUND.format(kind)), _Log(spark, f"{folder}/steps", STEPS.format(kind))

    seeds = sessions.select("session_id", F.posexplode("seeds").alias("ordinal", "u")).select("session_id", S.canonical_url("u").alias("link"), F.lit(5.0).alias("score"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("created"), "ordinal")
    known = pages.select(F.col("url").alias("link"), F.coalesce(F.col("records").cast("long"), F.lit(0)).alias("got"), F.coalesce("has_map", F.lit(False)).alias("has_map"), F.coalesce("repeated", F.lit(0)).alias("repeated"))
    found.add(0, seeds.join(known, "link", "left_semi").select("session_id", "link", "score", "depth", "created", "ordinal"))
    ways = f"{folder}/ways"
    links.join(known.select("link"), "link", "left_semi").join(known.select(F.col("link").alias("at"), "has_map", "repeated"), "at").select("at", "ordinal", "link", "anchor", "has_map", "repeated").write.mode("overwrite").parquet(ways)
    none = {"stop_reason": "string", "link": "string", "score": "double", "depth": "int", "got": "long"}
    zeros = {"pages": "int", "records": "long", "streak": "int"}
    steps.add(0, sessions.select("session_id", "source_url", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), *(F.lit(0).cast(t).alias(c) for c, t in zeros.items())))

    n = 0
    while not steps.read(n).where("stop_reason is null").isEmpty():
        n += 1
        running = steps.read(n - 1).where("stop_reason is null")
        steps.add(n, _step(running, _heads(running, found.read(), steps.read()), known, budget))
        found.add(n, _expanded(steps.read(n).where("stop_reason is null"), spark.read.parquet(ways), n, budget))
    done = steps.read()
    visits = done.where("link is not null").select("session_id", F.col("round").alias("step"), "link", "score", "depth", F.col("got").alias("records"))
    return visits, done.where("stop_reason is not null").select("session_id", "stop_reason", "pages", "records", "streak")


def _heads(running: DataFrame, found: DataFrame, steps: DataFrame) -> DataFrame:
    """session_id, how many pages are queued and the head of the queue, for sessions that run and have one."""
    ids = running.select("session_id")
    first = F.struct("created", "ordinal")
    queued = found.join(ids, "session_id", "left_semi").groupBy("session_id", "link").agg(F.max("score").alias("score"), F.min_by("depth", first).alias("depth"), F.min(first).alias("first"))
    seen = steps.where("link is not null").join(ids, "session_id", "left_semi").select("session_id", "link")
    head = F.min(F.struct((-F.col("score")).alias("down"), "depth", "first", "link")).alias("head")
    return queued.join(seen, ["session_id", "link"], "left_anti").groupBy("session_id").agg(F.count("*").alias("queued"), head)


def _step(running: DataFrame, heads: DataFrame, known: DataFrame, b: Budget) -> DataFrame:
    rows = running.withColumnRenamed("score", "last").drop("stop_reason", "link", "depth", "got").join(heads, "session_id", "left")
    lit, streak, score = F.lit, F.col("streak"), -F.col("head.down")
    reason = stop_reason(F.col("pages"), lit(b.pages), F.coalesce("queued", lit(0)), streak, lit(b.empty), F.col("records"), lit(b.records), streak, lit(b.saturation), F.col("last"), lit(b.score))
    rows = rows.withColumn("stop_reason", F.coalesce(reason, F.when(score < b.score, "min_score_floor")))
    go = F.col("stop_reason").isNull()
    rows = rows.select("session_id", "source_url", "stop_reason", F.when(go, F.col("head.link")).alias("link"), F.when(go, score).alias("score"), F.when(go, F.col("head.depth")).alias("depth"), "pages", "records", "streak")
    rows = rows.join(known.select("link", "got"), "link", "left")
    got = F.coalesce("got", lit(0))
    return rows.select(
        "session_id", "source_url", "stop_reason", "link", "score", "depth", "got", (F.col("pages") + F.col("link").isNotNull().cast("int")).alias("pages"), (F.col("records") + got).alias("records"),
        F.when(F.col("link").isNull(), streak).when(got > 0, 0).otherwise(streak + 1).cast("int").alias("streak"),
    )


def _expanded(visited: DataFrame, ways: DataFrame, n: int, b: Budget) -> DataFrame:
    """What the pages of a round queue."""
    front = visited.where(F.col("depth") < b.depth).select("session_id", "source_url", F.col("link").alias("at"), "depth", "got")
    rows = front.join(ways, "at").where(S.host_family("link").eqNullSafe(S.host_family("source_url"))).withColumn("depth", F.col("depth") + 1)
    bonus = F.when(F.col("got") > 0, 0.4).otherwise(0.0)
    score = frontier_score(F.col("link"), F.nullif(F.coalesce("anchor", F.lit("")), F.lit("")), F.col("depth"), F.col("source_url"), F.col("has_map"), F.col("repeated"), F.lit(0.2), bonus, F.lit(0))["score"]
    rows = rows.withColumn("score", score).where(F.col("score") >= b.score)
    place = F.row_number().over(Window.partitionBy("session_id", "at").orderBy("ordinal", "link"))
    most = F.when(F.col("got") > 0, max(2, min(b.links, b.links_of_rich))).otherwise(b.links)
    return rows.withColumn("place", place).where(F.col("place") <= most).select("session_id", "link", "score", "depth", F.lit(n).cast("long").alias("created"), F.col("place").alias("ordinal"))
