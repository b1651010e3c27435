"""Record sources and report sinks: parser registry, seeds, gold sets, exports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import scalars as S
from quillmesh.sources import html as H

#: [S08] Parsers by strategy: parsed pages to records. Add an entry to extend.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"table": H.table_records, "repeated_block": H.stub_records, "script_json": H.json_records}


def extracted(pages: DataFrame, plans: DataFrame) -> DataFrame:
    """Records of every page by its plan (page_id, primary), all strategies in one lineage."""
    out = None
    for strategy, parse in PARSERS.items():
        mine = pages.join(plans.where(F.col("primary") == strategy).select("page_id"), "page_id", "left_semi")
        rows = parse(mine).withColumn("strategy", F.lit(strategy))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """[S12] A JSON list of checked sources as registry rows, with a confidence from status and chapter-like links."""
    schema = "name string, base string, status int, final_url string, chapterish_links array<struct<text:string,url:string>>, error string"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    links = F.coalesce(F.size("chapterish_links"), F.lit(0))
    confidence = F.when(F.col("status") != 200, 0.3).when(links >= 3, 0.95).when(links >= 1, 0.85).otherwise(0.6)
    return raw.select(S.discovery_slug("name").alias("fraternity_slug"), "name", F.coalesce("final_url", "base").alias("national_url"), F.col("status").alias("http_status"), links.alias("links"), confidence.alias("confidence"), (F.col("status") == 200).alias("is_active"))


def goldset(spark: SparkSession, path: str) -> DataFrame:
    """[S13] Cases of a gold set, one JSON object a line."""
    return spark.read.schema("case_id string, school_name string, fraternity_name string, fraternity_slug string, expected_final_status string, expected_school_recognition_status string, fixture_paths array<string>").json(path)


def unnested(df: DataFrame, key: str, column: str, fields: str) -> DataFrame:
    """[S19] Rows of a column that holds a JSON array of objects; fields is the objects' DDL."""
    return df.select(key, F.posexplode(F.from_json(column, f"array<struct<{fields}>>")).alias("ordinal", "x")).select(key, "ordinal", "x.*")


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """[S10] Offline search results, targets unwrapped from redirects; providers in their order."""
    raw = spark.read.schema("query string, provider string, rank int, url string, title string, snippet string").json(path)
    return raw.withColumn("url", S.search_target("url")).dropDuplicates(["query", "url"])


def markdown(title: str, df: DataFrame, most: int = 1000) -> str:
    """[S16] A report table of at most ``most`` rows."""
    rows = df.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]) + "\n"


def export(df: DataFrame, path: str, kind: str) -> None:
    """[S17] A distributed export as json, csv or parquet."""
    if kind not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown kind {kind}")
    getattr(df.write.mode("overwrite"), kind)(path, **({"header": True} if kind == "csv" else {}))


def appended(df: DataFrame, path: str) -> None:
    """[S15] Rows added to an append-only event table."""
    df.write.mode("append").parquet(path)


def envelope(df: DataFrame, most: int = 1000) -> str:
    """The read routes' answer: {"success": true, "data": [...]}, bounded like a page."""
    return json.dumps({"success": True, "data": [json.loads(x) for x in df.limit(most).toJSON().collect()]})
