"""Merkle manifest of a dataset: a digest a row, a tree a group, one root over all, and a proof for each row.

Rows get their place in their group without a single-task sort. Aligned blocks of 2 ** HEIGHT leaves are walked recursively in
postorder: each call returns its subtree's digest and, while unwinding, appends each half's digest to the proofs of the
leaves in the other half. The blocks' roots are the leaves of the next distributed walk, and so on; the groups' roots go
through the same walks in order of the group. Proofs are gathered on the way down, where a block meets the proof of its
own root, so the leaves' proofs are never written.

Defined cases: null fields have a form of their own; null text, group or id are values like others (null comes first);
rows that share an id are ordered by digest, equal rows are leaves each; a lone leaf is its group's root; very long texts
are hashed whole and once, and never shuffled; an empty table gives no rows; extra columns are carried along, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import held_out, table, written
from quillmesh.llm.order import numbered

#: Levels of a block; it has two to this power leaves.
HEIGHT = 10
PROOF = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value's part of a leaf: its byte count and itself, or a dash for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def combine(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def walk(nodes: list[str], height: int, low: int = 0, proofs: list[list[tuple[str, str]]] | None = None) -> str:
    """Digest of the subtree of this height at ``low``; siblings (before, after) are appended to the contained leaves' proofs."""
    if not height:
        return nodes[low]
    mid, high = low + (1 << height - 1), min(low + (1 << height), len(nodes))
    left = walk(nodes, height - 1, low, proofs)
    right = walk(nodes, height - 1, mid, proofs) if mid < high else ""
    if proofs is not None:
        for k in range(low, high):
            proofs[k].append(("", right) if k < mid else (left, ""))
    return combine(left, right)


def _levels(members: int, height: int) -> int:
    """Of a block in a tree of so many nodes: all, unless the tree is this block alone."""
    return min(height, (members - 1).bit_length())


def tops(nodes: DataFrame, height: int) -> DataFrame:
    """The blocks' roots as nodes of the next walk: tree, position, members, node."""
    tree = nodes.schema["tree"]
    names = ["tree", "position", "members", "node"]

    def work(block: pa.Table) -> pa.Table:
        block = block.sort_by("position").combine_chunks()
        members = block["members"][0].as_py()
        top = walk(block["node"].to_pylist(), _levels(members, height))
        return pa.table([block["tree"].slice(0, 1), pa.array([block["position"][0].as_py() >> height], pa.int64()), pa.array([-(-members >> height)], pa.int64()), pa.array([top], pa.string())], names=names)

    blocks = nodes.select(*names, F.shiftright("position", height).alias("block")).groupBy("tree", "block")
    return blocks.applyInArrow(work, f"tree {tree.dataType.simpleString()}, position long, members long, node string")


def unwound(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """nodes with the proof (up to the root) and other columns of their block's root, found in above by tree and position."""
    more = [c for c in above.columns if c not in ("tree", "position", "proof")]

    def work(block: pa.Table, top: pa.Table) -> pa.Table:
        block = block.sort_by("position").drop_columns("block").combine_chunks()
        proofs: list[list[tuple[str, str]]] = [[] for _ in range(len(block))]
        walk(block["node"].to_pylist(), _levels(block["members"][0].as_py(), height), 0, proofs)
        rest = [(x["before"], x["after"]) for x in top["proof"][0].as_py()]
        length = len(proofs[0]) + len(rest)
        flat = [x for own in proofs for x in (*own, *rest)]
        sides = [pa.array([x[k] for x in flat], pa.string()) for k in (0, 1)]
        offsets = pa.array(range(0, length * len(block) + 1, length) if length else [0] * (len(block) + 1), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(sides, ["before", "after"]))
        for c in more:
            block = block.append_column(c, pc.take(top[c], pa.array([0] * len(block))))
        return block.append_column("proof", lists)

    fields = [*nodes.schema.fields, *(above.schema[c] for c in more)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    left = nodes.withColumn("block", F.shiftright("position", height)).groupBy("tree", "block")
    right = above.select("tree", F.col("position").alias("block"), "proof", *more).groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(work, f"{schema}, proof {PROOF}")


def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes of each walk, up to one node a tree."""
    levels = [nodes, written(tops(nodes, height))]
    while not levels[-1].where("members > 1").isEmpty():
        levels.append(written(tops(levels[-1], height)))
    return levels


def descend(levels: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The first level's nodes with their proofs; above has those of the last level's."""
    for nodes in levels[-2:0:-1]:
        above = written(unwound(nodes, above, height).drop("members", "node"))
    return unwound(levels[0], above, height)


def manifest(leaves: DataFrame, group: str, order: list[str], digest: str = "leaf", height: int = HEIGHT) -> DataFrame:
    """leaves (one digest a row) with subroot, root and proof: the siblings before and after the node, level by level."""
    rows = leaves.select(F.col(f"`{group}`").alias("tree"), F.col(f"`{digest}`").alias("node"), *(F.col(f"`{c}`").alias(f"by{k}") for k, c in enumerate(order)), F.struct("*").alias("row"))
    placed = written(numbered(rows, "tree", [*(f"by{k}" for k in range(len(order))), "node"]).select("tree", "position", "members", "node", "row"))
    levels = climb(placed, height)
    trees = levels[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("of"), "node")
    upper = climb(written(numbered(trees, "tree", ["of"])), height)
    top = upper[-1].select("tree", "position", F.col("node").alias("root"), F.expr(f"cast(array() as {PROOF})").alias("proof"))
    above = descend(upper, top, height).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("position"), F.col("node").alias("subroot"), "root", "proof")
    return descend(levels, written(above), height).select("row.*", "subroot", "root", "proof")


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof give."""
    return F.aggregate(proof, digest, lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    of = lambda n_chars: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.when(held_out(F.col("doc_id"), 7, 0), of(F.col("n_chars") + 1))
    leaves = docs.select("doc_id", "lang", of(F.col("n_chars")).alias("leaf"), tampered.alias("claim"))
    rows = manifest(written(leaves), "lang", ["doc_id"])
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("claim", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_UP = "select t, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from {0} where n > 1 group by t, level, pos // 2, n"
_CRC = """xor(list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295)"""
OP13_SQL = f"""
with recursive c as (
  select *, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by t) as n from (
    select doc_id, coalesce('=' || lang, '') as t, {_LEAF.format("n_chars")} as leaf,
      case when {_CRC} % 7 = 0 then {_LEAF.format("(n_chars + 1)")} end as claim from documents)
), low(t, level, pos, n, h) as (
  select t, 0, pos, n, leaf from c union all {_UP.format("low")}
), s as (
  select t, h as subroot, row_number() over (order by encode(t)) - 1 as top, count(*) over () as n from low where n = 1
), high(t, level, pos, n, h) as (
  select '', 0, top, n, subroot from s union all {_UP.format("high")}
), k as (
  select row_number() over () as k, doc_id, leaf, claim, t, pos, subroot, top, (select h from high where n = 1) as root from c join s using (t)
), steps as (
  select k, a.level, if(p & 1 = 1, 'L', 'R') || coalesce(h, '') as step
  from (select k, t, level, pos >> level as p from k join (select distinct t, level from low where n > 1) using (t)) a
  left join low b on a.t = b.t and a.level = b.level and b.pos = xor(p, 1)
  union all
  select k, 1000 + a.level, if(p & 1 = 1, 'L', 'R') || coalesce(h, '')
  from (select k, level, top >> level as p from k, (select distinct level from high where n > 1)) a
  left join high b on a.level = b.level and b.pos = xor(p, 1)
), f as (
  select k.*, coalesce(p.steps, []) as steps from k left join (select k, list(step order by level) as steps from steps group by k) p using (k)
), g as (
  select *, list_reduce(list_prepend(coalesce(claim, leaf), steps), lambda h, x: sha256(if(x[1] = 'L', x[2:] || h, h || x[2:]))) as folded_root,
    sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) as proof_sha256 from f
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from g
"""
