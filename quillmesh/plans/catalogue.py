"""All queries of the library by name, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.plans import analogs, changes, controls, decisions, domain, elements, guards, kpi, learning, phrases, rulings

Query = Callable[[SparkSession, str], DataFrame]


def _spark_dialect(sql: str) -> str:
    sql = sql.replace("{g}", kpi.SPARK_GLOBAL)
    return re.sub(r"regexp_matches\(", "regexp_like(", sql)


def _report(sql: str) -> Query:
    return lambda spark, sf_dir: analogs.run_sql(spark, sf_dir, _spark_dialect(sql))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(kpi.SQL["a04_queue_by_field"])(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: _report(sql) for name, sql in kpi.SQL.items()} | domain.QUERIES | elements.QUERIES | decisions.QUERIES | phrases.QUERIES | rulings.QUERIES | changes.QUERIES | guards.QUERIES | controls.QUERIES | learning.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: analogs.duck_sql(sql.replace("{g}", kpi.DUCK_GLOBAL)) for name, sql in kpi.SQL.items()} | domain.ORACLE_SQL | elements.ORACLE_SQL | decisions.ORACLE_SQL | phrases.ORACLE_SQL | rulings.ORACLE_SQL | changes.ORACLE_SQL | guards.ORACLE_SQL | controls.ORACLE_SQL | learning.ORACLE_SQL | {name: analogs.duck_sql(sql) for name, sql in kpi.PLAIN.items()}
