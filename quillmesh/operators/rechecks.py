"""Rechecks of search providers in mid-batch: after each stretch of a claimed batch the rest is searched in a new order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Jobs between two rechecks, attempts that make a provider's rate count, the least rate.
EVERY, ENOUGH, LEAST = 25, 4, 0.25


def reordered(order: Column, health: Column, least: float = LEAST) -> Column:
    """Providers after a recheck: those with enough attempts and the least rate by rate, then the others, then those of
    the first two that fell below. health: a map from provider to attempts and successes."""
    at = lambda p: F.try_element_at(health, p)
    tried = lambda p: F.coalesce(at(p)["attempts"] >= ENOUGH, F.lit(False))
    rate = lambda p: at(p)["successes"] / at(p)["attempts"]
    good, bad = (lambda p: tried(p) & (rate(p) >= least)), (lambda p, i: (i < 2) & tried(p) & (rate(p) < least))
    numbered = F.transform(order, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    ranked = F.array_sort(F.transform(F.filter(numbered, lambda x: good(x["p"])), lambda x: F.struct((-rate(x["p"])).alias("r"), x["i"].alias("i"), x["p"].alias("p"))))
    names = lambda xs: F.transform(xs, lambda x: x["p"])
    stable = names(F.filter(numbered, lambda x: ~good(x["p"]) & ~bad(x["p"], x["i"])))
    return F.concat(names(ranked), stable, names(F.filter(numbered, lambda x: bad(x["p"], x["i"]))))


def all_below(order: Column, health: Column, least: float = LEAST) -> Column:
    """Whether every provider with enough attempts is below the least rate, and there is one."""
    rates = F.filter(F.transform(order, lambda p: F.when(F.try_element_at(health, p)["attempts"] >= ENOUGH, F.try_element_at(health, p)["successes"] / F.try_element_at(health, p)["attempts"])), lambda r: r.isNotNull())
    return (F.size(rates) > 0) & F.forall(rates, lambda r: r < least)


def planned(batch: DataFrame, attempts: DataFrame, order: list[str], every: int = EVERY, least: float = LEAST) -> DataFrame:
    """[T09] Every job of the batches once, with its stretch, the order of providers it is searched in and whether its
    batch runs degraded by then.

    batch: worker_id, id, rank (from 0, the order of the claim); attempts: worker_id, stretch, provider, succeeded: what
    was tried while a stretch ran. After a batch is degraded it is not rechecked. A claimed batch is bounded by its
    limit, so one array holds its stretches.
    """
    health = attempts.groupBy("worker_id", "stretch", "provider").agg(F.count("*").alias("attempts"), F.count_if("succeeded").alias("successes"))
    health = health.groupBy("worker_id", "stretch").agg(F.map_from_entries(F.collect_list(F.struct("provider", F.struct("attempts", "successes")))).alias("health"))
    jobs = batch.withColumn("stretch", F.floor(F.col("rank") / every).cast("long"))
    spans = jobs.select("worker_id", "stretch").distinct().join(health, ["worker_id", "stretch"], "left")
    spans = spans.groupBy("worker_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "health")), lambda a, b: (a["stretch"] - b["stretch"]).cast("int")).alias("spans"))
    first = F.array(*map(F.lit, order))
    entry = lambda stretch, now, degraded: F.struct(stretch.alias("stretch"), now.alias("order"), degraded.alias("degraded"))
    start = F.struct(first.alias("order"), F.lit(False).alias("degraded"), F.expr("cast(array() as array<struct<stretch:bigint,order:array<string>,degraded:boolean>>)").alias("plan"))

    def step(now: Column, span: Column) -> Column:
        known = span["health"].isNotNull() & ~now["degraded"]
        new = F.when(known, reordered(now["order"], span["health"], least)).otherwise(now["order"])
        worse = now["degraded"] | (known & all_below(new, span["health"], least))
        return F.struct(new.alias("order"), worse.alias("degraded"), F.concat(now["plan"], F.array(entry(span["stretch"], now["order"], now["degraded"]))).alias("plan"))

    plan = spans.select("worker_id", F.explode(F.aggregate("spans", start, step, lambda x: x["plan"])).alias("s")).select("worker_id", "s.*")
    return jobs.join(plan, ["worker_id", "stretch"]).select("worker_id", "id", "rank", "stretch", "order", "degraded")


def claimed_batches(jobs: DataFrame, by: list[Column], limit: int) -> DataFrame:
    """worker_id, id and rank of the first jobs of each worker, no job twice: jobs have one worker_id each."""
    own = Window.partitionBy("worker_id").orderBy(*by)
    return jobs.select("worker_id", "id", (F.row_number().over(own) - 1).alias("rank")).where(F.col("rank") < limit)
