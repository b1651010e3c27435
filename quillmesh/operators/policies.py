"""What a crawl or a contact job does next: how templates and actions had fared before each decision, scores and choice.

``before`` joins decisions with what had happened until then. Events and decisions are laid out along each key's line by
one range partitioning over key and time, so that a key with a third of all rows lies in as many blocks as its rows fill;
sums run inside a block, and what a block inherits comes from the sums of those before it, a row a key and block.
Names in brackets are the survey's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.scoring import clamp, kept, when_sum

# Fixed values ---------------------------------------------------------------------------------------------------------

PRIORS = {"extract_locator_api": 2.5, "extract_script_json": 2.1, "extract_table": 1.6, "extract_repeated_block": 1.4, "extract_stubs_only": 1.0, "expand_map_children": 0.9, "expand_same_section_links": 0.8, "expand_internal_links": 0.4, "review_branch": -0.5, "skip_page": -0.6, "stop_branch": -1.0}
ENRICH_PRIORS = {"parse_supporting_page": 1.9, "verify_school": 1.4, "verify_website": 1.2, "search_web": 0.45, "search_social": 0.3, "defer": 0.55, "stop_no_signal": -0.55, "review_required": -0.8}
#: Actions that timeouts and requeues count against.
RISKY = ["expand_internal_links", "expand_map_children", "extract_locator_api", "search_web", "search_social"]
EXPANDING = ["expand_internal_links", "expand_same_section_links", "expand_map_children"]
#: Scopes of a supporting page that speaks for one chapter.
OWN_SCOPES = ["chapter_site", "school_affiliation_page", "nationals_chapter_page"]

# What had happened before ---------------------------------------------------------------------------------------------


def _blocks(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, *key, *order).withColumn("block", F.spark_partition_id()))


def _inside(key: list[str], order: list[str]):
    return Window.partitionBy(*key, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _inherited(key: list[str]):
    return Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def before(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with ``block`` and, under each name of sums, that column's sum over the rows of the key before this one.

    order decides what comes first and is unique within a key; nulls come first. Sums of longs and decimals are exact.
    An empty key is one line of all rows.
    """
    rows = _blocks(rows, key, order)
    totals = rows.groupBy(*key, "block").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    totals = totals.select(*key, "block", *(F.sum(k).over(_inherited(key)).alias(f"_{k}") for k in sums))
    out = rows.withColumns({k: F.sum(c).over(_inside(key, order)) for k, c in sums.items()}).join(totals, [*key, "block"], "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"_{k}"), F.lit(0)) for k in sums}).drop(*(f"_{k}" for k in sums))


def profiles_before(visits: DataFrame, asks: DataFrame) -> DataFrame:
    """[T08, W11] asks with ``profile``, the profile of their template as the visits before them had left it.

    visits: signature, host_family, ts, id, action, family, chapter_yield, contact_yield (longs), timeout, empty
    (booleans). asks: signature, host_family, ts, id and any more. What comes before is decided by ts, then id; a visit
    does not count for an ask of its own ts and id. The profile is a struct of visits, the mean yields, the rates of
    empty pages and timeouts, and the best action and family: those of the last visit that brought as much as the mean
    before it. It is null without an earlier visit or without a template.
    """
    key, order = ["signature", "host_family"], ["ts", "id", "kind"]
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    numbers = ["chapter_yield", "contact_yield", "timeout", "empty"]
    seen = visits.where("signature is not null and host_family is not null").select(*key, "ts", "id", F.lit(1).alias("kind"), F.struct("action", "family").alias("best"), *map(number, numbers))
    asked = asks.select(*key, "ts", "id", F.lit(0).alias("kind"), F.struct(*asks.columns).alias("ask"))
    rows = before(seen.unionByName(asked, allowMissingColumns=True), key, order, {"n_visits": F.col("kind").cast("long"), **{f"s_{c}": F.col(c) for c in numbers}})
    brought = F.col("chapter_yield") + F.col("contact_yield")
    rows = rows.withColumn("led", F.when((F.col("kind") == 1) & (brought * F.col("n_visits") >= F.col("s_chapter_yield") + F.col("s_contact_yield")), F.col("best")))
    led = rows.where("led is not null").groupBy(*key, "block").agg(F.max_by("led", F.struct("ts", "id")).alias("led"))
    every = rows.select(*key, "block").distinct().join(led, [*key, "block"], "left")
    every = every.select(*key, "block", F.last("led", ignorenulls=True).over(_inherited(key)).alias("led_before"))
    rows = rows.withColumn("led", F.last("led", ignorenulls=True).over(_inside(key, order))).where("kind = 0").join(every, [*key, "block"], "left")
    best = F.coalesce("led", "led_before")
    mean = lambda c: (F.col(f"s_{c}").cast("double") / F.col("n_visits")).alias(c)
    profile = F.struct(F.col("n_visits").alias("visits"), mean("chapter_yield"), mean("contact_yield"), mean("empty").alias("empty_rate"), mean("timeout").alias("timeout_rate"), best["action"].alias("best_action"), best["family"].alias("best_family"))
    return rows.select("ask.*", F.when(F.col("n_visits") > 0, profile).alias("profile"))


def observed_before(rewards: DataFrame, asks: DataFrame, actions: list[str]) -> DataFrame:
    """[D14] asks with ``observed``, a map from each action that had been rewarded before to its mean reward.

    rewards: ts, id, action, reward (rounded to 4 places); asks: ts, id and any more. A reward does not count for an ask
    of its own ts and id. Actions other than those given are left out, as are null rewards.
    """
    reward = F.round(F.col("reward"), 4).cast("decimal(18,4)")
    seen = rewards.where(F.col("action").isin(actions) & F.col("reward").isNotNull()).select("ts", "id", F.lit(1).alias("kind"), "action", reward.alias("reward"))
    asked = asks.select("ts", "id", F.lit(0).alias("kind"), F.struct(*asks.columns).alias("ask"))
    sums = {f"{p}{i}": F.when(F.col("action") == a, c) for i, a in enumerate(actions) for p, c in (("n", F.lit(1).cast("long")), ("s", F.col("reward")))}
    rows = before(seen.unionByName(asked, allowMissingColumns=True), [], ["ts", "id", "kind"], sums).where("kind = 0")
    means = F.array(*(F.when(F.col(f"n{i}") > 0, F.struct(F.lit(a).alias("key"), (F.col(f"s{i}").cast("double") / F.col(f"n{i}")).alias("value"))) for i, a in enumerate(actions)))
    return rows.select("ask.*", F.map_from_entries(F.array_compact(means)).alias("observed"))


# Scores and choice ----------------------------------------------------------------------------------------------------


def _actions(contexts: DataFrame, priors: dict[str, float], actions: Column | None) -> DataFrame:
    given = F.array(*map(F.lit, priors)) if actions is None else actions
    df = contexts.select("*", F.posexplode(given).alias("place", "action"))
    prior = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in priors.items() for x in kv)), F.col("action")), F.lit(0.0))
    return df.withColumn("prior", prior)


def _observed() -> Column:
    return F.coalesce(F.try_element_at("observed", F.col("action")), F.lit(0.0)) * 0.2


def _rounded(x: Column) -> Column:
    return F.round(x.cast("decimal(20,10)"), 4).cast("double")  # halves are told as decimals, whatever the order of the sum


def _risk(weights: tuple[float, float]) -> Column:
    risk = clamp(F.coalesce("timeout_risk", F.lit(0.0))) * weights[0] + clamp(F.coalesce("requeue_risk", F.lit(0.0))) * weights[1]
    return F.when(F.col("action").isin(RISKY), risk).otherwise(0.0)


def action_scores(contexts: DataFrame, actions: Column | None = None, weights: tuple[float, float] = (0.75, 0.35)) -> DataFrame:
    """[D08] A row for each context and action with its place among the given actions, score and predicted reward.

    contexts: page_type, role, has_map, has_script_json, tables, repeated, keyword, profile (as of ``profiles_before`` or
    null), observed (a map from action to mean reward), timeout_risk, requeue_risk. actions: an array column, all without it.
    """
    df, a, p = _actions(contexts, PRIORS, actions), F.col("action"), F.col("profile")
    structural = (
        F.when((a == "extract_locator_api") & F.col("has_map"), 2.0)
        .when((a == "extract_script_json") & F.col("has_script_json"), 1.7)
        .when(a == "extract_table", F.least(F.coalesce("tables", F.lit(0)), F.lit(3)) * 0.7)
        .when(a == "extract_repeated_block", F.least(F.coalesce("repeated", F.lit(0)), F.lit(4)) * 0.5)
        .when(a.isin(EXPANDING) & F.col("role").isin("directory", "index"), 0.5)
        .when((a == "extract_stubs_only") & F.col("page_type").isin("static_directory", "locator_map"), 0.6)
        .otherwise(0.0)
    )
    most = lambda c, n: F.least(p[c], F.lit(float(n)))
    template = when_sum((p["best_action"] == a, 1.4), (p["best_family"] == a, 1.2)) + most("chapter_yield", 3) * 0.2 + most("contact_yield", 3) * 0.15 - most("empty_rate", 1) * 0.8 - most("timeout_rate", 1) * 0.8
    predicted = F.col("prior") + structural + F.when(p.isNotNull(), template).otherwise(0.0) + _observed() - _risk(weights)
    return df.withColumns({"score": _rounded(predicted + 0.15 * F.coalesce("keyword", F.lit(0.0))), "predicted": _rounded(predicted)}).drop("prior")


def enrichment_scores(contexts: DataFrame, weights: tuple[float, float] = (0.75, 0.35)) -> DataFrame:
    """[D09] As ``action_scores`` for contact jobs.

    contexts: field_type, supporting_page (boolean), supporting_scope, website_unmet, school_status, healthy and degraded
    (the provider's window), queries (made before), identity (complete), website (a candidate), target (has a value),
    authoritative (validation needed), observed, timeout_risk, requeue_risk. Null booleans are false, null texts empty.
    """
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    a, page, healthy, identity, field = F.col("action"), true("supporting_page"), true("healthy"), true("identity"), text("field_type")
    bonus = {
        "parse_supporting_page": F.when(page & text("supporting_scope").isin(OWN_SCOPES), 2.45).when(page, 2.0),
        "verify_school": F.when((field == "verify_school") | text("school_status").isin("unknown", "") | true("authoritative"), 1.5),
        "verify_website": F.when(field.isin("verify_website", "find_website") | true("website"), 1.35),
        "search_web": F.when(healthy & ~page, 1.0),
        "search_social": F.when(healthy & (field == "find_instagram"), 0.95),
        "defer": F.when(true("degraded") | true("website_unmet") | ~identity, 1.45),
        "stop_no_signal": F.when((F.coalesce("queries", F.lit(0)) >= 3) & ~page & ~healthy, 0.85),
        "review_required": F.when(~identity & true("target"), 0.7),
    }
    structural = F.coalesce(*(F.when(a == k, v) for k, v in bonus.items()), F.lit(0.0))
    score = _rounded(F.col("prior") + structural + _observed() - _risk(weights))
    return _actions(contexts, ENRICH_PRIORS, None).withColumn("score", score).drop("prior")


def chosen_action(scored: DataFrame, key: str, training: Column | None = None, guarded: bool = True, shadow: bool = False, epsilon: float = 0.0, seed: int = 0) -> DataFrame:
    """[D10] key, action, score, explored and flags of the action that each key takes.

    The best score is chosen, the first in place of equals; with epsilon a draw by key and seed takes any action instead.
    A choice that is flagged (unless training) gives way to the best action that is not risky, if there is one, else to
    the best. guarded: scored has timeout_risk and requeue_risk, alike for all actions of a key; contact jobs have no
    such guard. shadow: neither draws nor guards. A key has a dozen actions.
    """
    draw = lambda n, m: F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(n)), m)
    risks = [F.first(c).alias(f"_{c}") for c in ("timeout_risk", "requeue_risk")] if guarded else []
    rows = scored.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "place", "action"))).alias("r"), F.first(F.lit(False) if training is None else training).alias("_training"), *risks)
    explored = F.lit(False) if shadow or epsilon <= 0 else draw(1, F.lit(1_000_000)) < epsilon * 1_000_000
    rows = rows.withColumns({"explored": explored}).withColumn("s", F.when(F.col("explored"), F.get("r", draw(2, F.size("r").cast("long")).cast("int"))).otherwise(F.get("r", F.lit(0))))
    s, second = F.col("s"), F.get("r", F.lit(1))
    tests = {"prefer_safer_near_tie": (s["action"] == "expand_internal_links") & (-second["down"] >= -s["down"] - 0.05)}
    if guarded:
        tests = {"high_timeout_risk": s["action"].isin(RISKY) & (F.col("_timeout_risk") >= 0.8), "high_requeue_risk": s["action"].isin(RISKY) & (F.col("_requeue_risk") >= 0.7)} | tests
    live = F.lit(not shadow) & ~F.coalesce("_training", F.lit(False))
    flags = F.array_compact(F.array(*(F.when(live & t, F.lit(k)) for k, t in tests.items())))
    safer = F.coalesce(F.get(F.filter("r", lambda x: ~x["action"].isin(RISKY)), F.lit(0)), F.get("r", F.lit(0)))
    rows = rows.withColumn("flags", flags).withColumn("c", F.when(F.size("flags") > 0, safer).otherwise(s))
    return rows.select(key, "c.action", (-F.col("c.down")).alias("score"), "explored", "flags")
