"""Merge-style writes over versioned Parquet snapshots.

Spark has no constraints and Parquet no updates, so a mutation is a full-outer join (or an anti join) that yields the
next snapshot; ``Snapshots`` writes it beside the old one and moves a pointer. A single writer owns a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Snapshots:
    """Versions of a table under a folder: v=N, and the latest complete one is what readers see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version whose write was completed; 0 for none."""
        jvm, path, fs = self._fs()
        if not fs.exists(path):
            return 0
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version or self.version()}")

    def write(self, df: DataFrame) -> DataFrame:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={v}")
        return self.read(v)


def merged(old: DataFrame, new: DataFrame, keys: list[str], fill: list[str] = (), greatest: list[str] = (), maps: list[str] = ()) -> DataFrame:
    """[U01, U02, U04, U06] Upsert: rows of new win, but columns in ``fill`` keep the old value where the new is null,
    those in ``greatest`` take the larger, and those in ``maps`` are merged key by key."""
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("n"))

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), (F.col(f"n.{c}") if c in new.columns else None)
        if b is None:
            return a
        if c in fill:
            return F.coalesce(b, a)
        if c in greatest:
            return F.greatest(a, b)
        if c in maps:
            kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
            return F.coalesce(F.map_concat(kept, b), b, a)
        return F.when(F.col("n").isNotNull(), b).otherwise(a)

    return o.join(n, keys, "full_outer").select(*keys, *(value(c).alias(c) for c in old.columns if c not in keys))


def frontier_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """[U03] Frontier upsert by session and URL: the larger score with its components, ties to the new; anchors stay."""
    keys = ["crawl_session_id", "canonical_url"]
    o, n = (d.select(*keys, F.struct("score_total", "score_components", "anchor_text").alias(k)) for d, k in ((old, "o"), (new, "n")))
    newer = F.col("o").isNull() | (F.col("n.score_total") >= F.col("o.score_total"))
    pick = lambda c: F.when(newer & F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, keys, "full_outer").select(*keys, pick("score_total").alias("score_total"), pick("score_components").alias("score_components"), F.coalesce("o.anchor_text", "n.anchor_text").alias("anchor_text"))


def absent_only(jobs: DataFrame, new: DataFrame, keys: list[str], active: list[str] = ("queued", "running")) -> DataFrame:
    """[U05, U14] jobs with those of new that have no active row of the same key; one row per key of new."""
    first = Window.partitionBy(*keys).orderBy("id")
    fresh = new.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").join(jobs.where(F.col("status").isin(*active)).select(*keys), keys, "left_anti")
    return jobs.unionByName(fresh, allowMissingColumns=True)


def claimed(jobs: DataFrame, order: list[Column], n: int, worker: str) -> DataFrame:
    """[U07, U08] The first n queued, actionable jobs, marked as running by a worker; the rest as they were."""
    free = (F.col("status") == "queued") & (F.coalesce("queue_state", F.lit("actionable")) == "actionable")
    head = jobs.where(free).orderBy(*order).limit(n).select("id", F.lit(worker).alias("_by"))
    return jobs.join(F.broadcast(head), "id", "left").withColumn("status", F.when(F.col("_by").isNotNull(), "running").otherwise(F.col("status"))).withColumn("claimed_by", F.col("_by")).drop("_by")


def leased(rows: DataFrame, ids: DataFrame, until: Column) -> DataFrame:
    """[U09] Leases of the given ids moved to ``until`` (null releases)."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "id", "left").withColumn("lease_expires_at", F.when(F.col("_hit"), until).otherwise(F.col("lease_expires_at"))).drop("_hit")


def recovered(jobs: DataFrame, now: Column, age: str = "15 minutes") -> DataFrame:
    """[U10, T02] Running jobs that started too long ago go back to the queue with one attempt less."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {age}"))
    return jobs.withColumns({"status": F.when(stale, "queued").otherwise(F.col("status")), "attempts": F.when(stale, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")), "started_at": F.when(~stale, F.col("started_at"))})


def completed(jobs: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """[U12] Next jobs, review items and provenance from outcomes (id, action, backoff_s, value, confidence)."""
    j = jobs.join(outcomes.select("id", F.struct("action", "backoff_s", "value", "confidence").alias("x")), "id", "left")
    a = F.col("x.action")
    status = F.when(a.isin("complete", "review"), "done").when(a == "requeue", "queued").when(a == "fail_terminal", "failed").otherwise(F.col("status"))
    outcome = F.when(a == "complete", "updated").when(a == "review", "review_required").when(a == "fail_terminal", "terminal_no_signal").otherwise(F.col("terminal_outcome"))
    later = F.when(a == "requeue", now + F.make_dt_interval(secs=F.col("x.backoff_s"))).otherwise(F.col("scheduled_at"))
    nxt = j.withColumns({"status": status, "terminal_outcome": outcome, "scheduled_at": later}).drop("x")
    review = j.where(a == "review").select("id", "chapter_id", "field_name", F.col("x.value").alias("value"))
    prov = j.where(a == "complete").select("chapter_id", "field_name", F.col("x.value").alias("field_value"), F.col("x.confidence").alias("confidence"))
    return nxt, review, prov


#: [U15] Allowed changes of a review item's state; to the same state is allowed, too.
TRANSITIONS = [("open", "triaged"), ("open", "ignored"), ("triaged", "resolved"), ("triaged", "ignored")]


def transitioned(items: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[U15] Items after allowed changes (id, to), and the changes that were rejected."""
    j = changes.join(items.select("id", F.col("status").alias("from")), "id")
    ok = (F.col("from") == F.col("to"))
    for a, b in TRANSITIONS:
        ok = ok | ((F.col("from") == a) & (F.col("to") == b))
    good = j.where(ok).select("id", "to")
    return items.join(good, "id", "left").withColumn("status", F.coalesce("to", "status")).drop("to"), j.where(~ok)


def inactivated(chapters: DataFrame, jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[U16] Chapters of the given ids become inactive without contacts, and their open jobs are done."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    blank = {c: F.when(F.col("_hit").isNull(), F.col(c)) for c in ("website_url", "instagram_url", "contact_email") if c in chapters.columns}
    c = chapters.join(hit, "id", "left").withColumns({"chapter_status": F.when(F.col("_hit"), "inactive").otherwise(F.col("chapter_status")), **blank}).drop("_hit")
    j = jobs.join(hit.withColumnRenamed("id", "chapter_id"), "chapter_id", "left").withColumn("status", F.when(F.col("_hit") & F.col("status").isin("queued", "running"), "done").otherwise(F.col("status"))).drop("_hit")
    return c, j


def resolved_instagram(chapters: DataFrame, best: DataFrame, replace: bool = False) -> DataFrame:
    """[U17] Handles written where there is none, or everywhere if replacing is allowed."""
    b = best.select(F.col("chapter_id").alias("id"), F.concat(F.lit("https://www.instagram.com/"), F.col("handle")).alias("_new"))
    new = F.coalesce("_new", "instagram_url") if replace else F.coalesce("instagram_url", "_new")
    return chapters.join(b, "id", "left").withColumn("instagram_url", new).drop("_new")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """[U19]"""
    return rows.join(ids.select("id"), "id", "left_anti")


def resolved_alerts(alerts: DataFrame, prefix: str, now: Column) -> DataFrame:
    """[U14] Open alerts whose fingerprint has the prefix are resolved."""
    hit = (F.col("status") == "open") & F.col("fingerprint").startswith(prefix)
    return alerts.withColumns({"status": F.when(hit, "resolved").otherwise(F.col("status")), "resolved_at": F.when(hit, now)})


def requested(ids: DataFrame, fields: list[str]) -> DataFrame:
    """[S18, U06] A row for each id and field."""
    return ids.select("id", F.explode(F.array(*map(F.lit, fields))).alias("field_name"))


def outreach(chapters: DataFrame, campaign: str, subject: str, body: str) -> DataFrame:
    """[U20] Recipients of a campaign: trusted addresses with rendered texts, one per chapter."""
    from quillmesh.functions.scalars import rendered

    values = {"chapter": F.col("name"), "university": F.col("university"), "email": F.col("contact_email")}
    good = chapters.where(F.col("contact_email").isNotNull() & F.col("email_specificity").isin("chapter_specific", "school_specific", "national_specific_to_chapter"))
    return good.select(F.lit(campaign).alias("campaign_id"), F.col("id").alias("chapter_id"), "contact_email", rendered(F.lit(subject), values).alias("subject"), rendered(F.lit(body), values).alias("body"))
