"""Contracts before a sink: rules as data, checked in one pass that splits rows into sink and quarantine with reasons.

A contract is a rule for each column; ``violations`` compiles it into one expression, so the check costs no shuffle and
no second read. What was kept and held back, and why, is counted by an ``Observation`` while the sink is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StringType


@dataclass(frozen=True)
class Rule:
    """kind: string, number, strings (a list) or states (a map of strings); null is fine only where ``nullable``."""

    kind: str = "string"
    required: bool = False
    nullable: bool = False
    min_length: int = 0
    values: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None

    def fits(self, kind: DataType) -> bool:
        if self.kind == "number":
            return isinstance(kind, NumericType)
        if self.kind == "strings":
            return isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType)
        if self.kind == "states":
            return isinstance(kind, MapType) and isinstance(kind.valueType, StringType)
        return isinstance(kind, StringType)


Contract = dict[str, Rule]

# The contracts of chapters and of their provenance.
CHAPTER: Contract = {
    "fraternity_slug": Rule(required=True, min_length=1),
    "source_slug": Rule(required=True, min_length=1),
    "external_id": Rule(nullable=True),
    "slug": Rule(required=True, min_length=1),
    "name": Rule(required=True, min_length=1),
    "university_name": Rule(nullable=True),
    "city": Rule(nullable=True),
    "state": Rule(nullable=True),
    "country": Rule(required=True, min_length=1),
    "website_url": Rule(nullable=True),
    "chapter_status": Rule(required=True, values=("active", "inactive", "unknown")),
    "missing_optional_fields": Rule("strings", required=True),
    "field_states": Rule("states"),
}
PROVENANCE: Contract = {
    "source_slug": Rule(required=True, min_length=1),
    "source_url": Rule(required=True),
    "field_name": Rule(required=True, min_length=1),
    "field_value": Rule(nullable=True),
    "source_snippet": Rule(nullable=True),
    "confidence": Rule("number", required=True, least=0.0, most=1.0),
}


def violations(df: DataFrame, contract: Contract) -> Column:
    """array of rule:column for every rule that a row breaks, in order of the contract.

    A required column that df lacks and a column of another type break their rule in every row; a column that the
    contract doesn't know raises, as such rows could never be written.
    """
    if unknown := [c for c in df.columns if c not in contract]:
        raise ValueError(f"not in the contract: {', '.join(unknown)}")
    found = []
    for name, rule in contract.items():
        broken = lambda test, kind, name=name: F.when(test, F.lit(f"{kind}:{name}"))
        if name not in df.columns:
            if rule.required:
                found.append(F.lit(f"required:{name}"))
            continue
        value = F.col(f"`{name}`")
        if not rule.fits(df.schema[name].dataType):
            found.append(broken(value.isNotNull() | F.lit(not rule.nullable), "type"))
            continue
        if not rule.nullable:
            found.append(broken(value.isNull(), "type"))
        if rule.min_length:
            found.append(broken(F.length(value) < rule.min_length, "min_length"))
        if rule.values:
            found.append(broken(~value.isin(*rule.values), "enum"))
        if rule.least is not None:
            found.append(broken(F.isnan(value.cast("double")) | (value < rule.least), "minimum"))
        if rule.most is not None:
            found.append(broken(value > rule.most, "maximum"))
        if rule.kind == "strings":
            found.append(broken(F.exists(value, lambda x: x.isNull()), "items"))
        if rule.kind == "states":
            found.append(broken(F.exists(F.map_values(value), lambda x: x.isNull()), "values"))
    return F.array_compact(F.array(*found)) if found else F.expr("cast(array() as array<string>)")


def checked(df: DataFrame, contract: Contract, key: str | None = None) -> DataFrame:
    """df with ``reasons`` (empty: the row keeps the contract); the key column, if given, is outside the contract."""
    return df.withColumn("reasons", violations(df.drop(key) if key else df, contract))


def split(df: DataFrame, contract: Contract, key: str | None = None) -> tuple[DataFrame, DataFrame, Observation]:
    """[S14] (sink, quarantine with reasons, counts). The counts are there once the sink has been written."""
    rows, seen = checked(df, contract, key), Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size("reasons") > 0).alias("quarantined")]
    rules = dict.fromkeys(f"{kind}:{name}" for name in contract for kind in ("required", "type", "min_length", "enum", "minimum", "maximum", "items", "values"))
    counts += [F.count_if(F.array_contains("reasons", r)).alias(r) for r in rules]
    return rows.observe(seen, *counts).where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0), seen
