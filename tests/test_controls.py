"""Contracts, patch logs, rechecks and breakers against plain Python, one step after the other."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import contracts as K
from quillmesh.operators import organisations as O
from quillmesh.operators import patches as P
from quillmesh.operators import rechecks as R
from quillmesh.streaming import breakers as T

# Contracts ------------------------------------------------------------------------------------------------------------


def test_contract_reasons_and_counts(spark, tmp_path):
    schema = "id int, source_slug string, source_url string, field_name string, field_value string, source_snippet string, confidence double"
    rows = [(1, "s", "u", "f", None, None, 0.5), (2, "", "u", "f", "v", "x", 1.5), (3, None, None, "", None, None, None), (4, "s", "u", "f", None, None, -0.1), (5, "s", "", "f", None, None, float("nan"))]
    sink, held, seen = K.split(spark.createDataFrame(rows, schema), K.PROVENANCE, "id")
    sink.write.parquet(str(tmp_path / "sink"))
    got = {r["id"]: r["reasons"] for r in held.collect()}
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()] == [1]
    assert got == {2: ["min_length:source_slug", "maximum:confidence"], 3: ["type:source_slug", "type:source_url", "min_length:field_name", "type:confidence"], 4: ["minimum:confidence"], 5: ["minimum:confidence", "maximum:confidence"]}
    assert (seen.get["rows"], seen.get["quarantined"], seen.get["type:source_url"], seen.get["minimum:confidence"]) == (5, 4, 1, 2)


def test_contract_of_columns(spark):
    df = spark.createDataFrame([("s", "u", 1, "0.5")], "source_slug string, source_url string, field_name int, confidence string")
    assert K.checked(df, K.PROVENANCE).first()["reasons"] == ["type:field_name", "type:confidence"]
    assert K.checked(df.drop("source_slug"), K.PROVENANCE).first()["reasons"][0] == "required:source_slug"
    with pytest.raises(ValueError, match="other"):
        K.checked(df.withColumn("other", F.lit(1)), K.PROVENANCE)
    assert K.checked(df.limit(0), K.PROVENANCE).count() == 0


# Patches --------------------------------------------------------------------------------------------------------------

ROW = "id int, website_url string, contact_email string, instagram_url string, field_states map<string,string>, patched_pass int"
LOG = "id int, pass_no int, seq int, field string, previous string, value string, reason string"


def plain_applied(rows, log):
    out = {}
    for i, w, e, g, states, done in rows:
        now, touched, reasons, last, gone = dict(zip(P.FIELDS, (w, e, g), strict=True)), set(), [], done, False
        for _, no, _, field, previous, value, reason in sorted((p for p in log if p[0] == i), key=lambda p: p[1:3]):
            if done is not None and no <= done:
                continue
            last = max(last or 0, no)
            if gone:
                continue
            if field == "*":
                gone = True
            elif now[field] == previous:
                now[field] = value
                reasons.append(f"{field}:{reason}")
                touched.add(field)
        if not gone:
            out[i] = (*(now[f] for f in P.FIELDS), (states or {}) | {f: "missing" if now[f] is None else "found" for f in touched}, last, reasons)
    return out


def as_dict(df):
    return {r["id"]: (*(r[f] for f in P.FIELDS), r["field_states"], r["patched_pass"], r["reasons"]) for r in df.collect()}


def test_patch_logs_equal_one_step_after_the_other_and_twice_is_once(spark):
    rng = random.Random(7)
    values = ["a", "b", None]
    rows = [(i, rng.choice(values), rng.choice(values), rng.choice(values), rng.choice([None, {"website_url": "found", "x": "y"}]), rng.choice([None, None, 1])) for i in range(120)]
    log = [(rng.randrange(130), no, k, rng.choice([*P.FIELDS, *P.FIELDS, "*"] if rng.random() < 0.2 else P.FIELDS), rng.choice(values), rng.choice(values), f"r{no}") for no in (1, 2, 3) for k in range(120)]
    df, patches = spark.createDataFrame(rows, ROW), spark.createDataFrame(log, LOG)
    once = P.applied(df, patches)
    assert as_dict(once) == plain_applied(rows, log)
    again = P.applied(once.drop("reasons"), patches)
    unchanged = {k: (*v[:-1], []) for k, v in as_dict(once).items()}
    assert as_dict(again) == unchanged
    parts = P.applied(P.applied(df, patches.where("pass_no < 2")).drop("reasons"), patches.where("pass_no >= 2"))
    assert {k: v[:-1] for k, v in as_dict(parts).items()} == {k: v[:-1] for k, v in as_dict(once).items()}
    assert as_dict(P.applied(df, patches.limit(0))).keys() == {r[0] for r in rows}


HANDLES = [  # handle, (organisation, local, brand, score)
    ("sigmachihq", (True, False, False, 2)),
    ("ttusigmachi", (True, True, False, 4)),
    ("texastechuniversity", (False, True, True, 1)),
    ("ttu", (False, True, True, 2)),
    ("raidertexas", (False, True, False, 2)),
    ("other", (False, False, False, 0)),
    ("", (False, False, False, 0)),
]


def test_handles(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HANDLES)], "i int, h string")
    df = P.handle_facts(df, F.col("h"), O.job_facts(F.lit("sigma-chi"), F.lit("Raider Chapter"), F.lit(None).cast("string"), F.lit("Texas Tech University")))
    got = {r["i"]: (r["h_organisation"], r["h_local"], r["h_brand"], r["h_score"]) for r in df.collect()}
    want = {i: w for i, (_, w) in enumerate(HANDLES)}
    want[4] = (False, True, False, 1)  # the chapter's name with the word chapter isn't in it, "texas" is
    assert got == want


# Rechecks -------------------------------------------------------------------------------------------------------------


def plain_order(order, health):
    rate = lambda p: health[p][1] / health[p][0]
    tried = lambda p: p in health and health[p][0] >= 4
    ranked = sorted((p for p in order if tried(p) and rate(p) >= 0.25), key=lambda p: (-rate(p), order.index(p)))
    demoted = [p for i, p in enumerate(order) if i < 2 and tried(p) and rate(p) < 0.25]
    return ranked + [p for p in order if p not in ranked and p not in demoted] + demoted


def test_rechecks_equal_a_loop(spark):
    rng = random.Random(8)
    names, batch, tried, want = ["a", "b", "c", "d"], [], [], {}
    for w in range(12):
        n, order, degraded = rng.randint(1, 40), names, False
        health = {}
        for s in range(9):
            for p in rng.sample(names, rng.randint(0, 4)):
                goods = [rng.random() < rng.choice([0.05, 0.3, 0.9]) for _ in range(rng.randint(1, 8))]
                tried += [(w, s, p, g) for g in goods]
                health.setdefault(s, {})[p] = (len(goods), sum(goods))
        for k in range(n):
            if k and k % 5 == 0 and not degraded and (h := health.get(k // 5 - 1)):
                order = plain_order(order, h)
                rates = [h[p][1] / h[p][0] for p in order if p in h and h[p][0] >= 4]
                degraded = bool(rates) and all(r < 0.25 for r in rates)
            batch.append((w, w * 100 + k, k))
            want[w * 100 + k] = (k // 5, order, degraded)
    df = R.planned(spark.createDataFrame(batch, "worker_id int, id int, rank int"), spark.createDataFrame(tried, "worker_id int, stretch long, provider string, succeeded boolean"), names, every=5)
    rows = df.collect()
    assert len(rows) == len(batch) and {r["id"]: (r["stretch"], r["order"], r["degraded"]) for r in rows} == want
    assert any(d for _, _, d in want.values()) and len({tuple(o) for _, o, _ in want.values()}) > 3


# Breakers -------------------------------------------------------------------------------------------------------------


def write_events(spark, path, rows):
    df = spark.createDataFrame(rows, "key string, id long, ms long, failed boolean").select("key", "id", F.timestamp_millis(F.col("ms") + 1_700_000_000_000).alias("ts"), "failed")
    df.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("key string, id long, ts timestamp, failed boolean").option("maxFilesPerTrigger", 1).parquet(path)


def test_breakers_by_the_events_time(spark, tmp_path):
    path, found = str(tmp_path / "in"), []
    minute = 60_000
    write_events(spark, path, [("a", i, i * minute, i in (1, 2, 3)) for i in range(4)] + [("b", 9, 0, True)])
    write_events(spark, path, [("a", 4, 4 * minute, False), ("a", 5, 9 * minute, True), ("a", 6, 15 * minute, False)])
    write_events(spark, path, [("b", 10, 600 * minute, False)])  # the others' time alone closes what is open
    query = T.breakers(stream(spark, path), 3, 300, "1 minute").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: found.extend(df.collect())).start()
    query.awaitTermination()
    a = {r["id"]: (r["state"], r["streak"]) for r in found if r["key"] == "a" and r["id"] is not None}
    assert a == {0: ("closed", 0), 1: ("closed", 1), 2: ("closed", 2), 3: ("open", 3), 4: ("refused", 3), 5: ("open", 4), 6: ("closed", 0)}
    assert all(r["state"] == "half_open" and r["key"] == "a" for r in found if r["id"] is None)


def test_time_alone_half_opens_a_breaker(spark, tmp_path):
    path, found = str(tmp_path / "in"), []
    write_events(spark, path, [("a", i, i, True) for i in range(3)])
    query = T.breakers(stream(spark, path), 3, 2).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").foreachBatch(lambda df, _: found.extend(df.collect())).start()
    try:
        end = time.time() + 60
        while time.time() < end and not any(r["state"] == "half_open" for r in found):
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r["id"], r["state"]) for r in found] == [(0, "closed"), (1, "closed"), (2, "open"), (None, "half_open")]
