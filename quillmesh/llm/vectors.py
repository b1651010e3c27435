"""Near-duplicate embeddings by random-hyperplane sign hashing with exact verification.

Equal vectors of a label are one class. Each class is hashed by the signs of its products with random hyperplanes into
several tables; buckets with company are dealt to tasks, large ones as pairs of chunks of at most CHUNK classes, and
every pair in a bucket is verified by its cosine in double precision. A pair counts in the first table in which it
meets. Tasks return sums of links and a spanning forest, never pairs. Components are joined over all tables.

The number of tables follows from the threshold, so that a pair exactly at it is met with the probability RECALL. The
number of signs is the one of least cost for the classes of the largest label: a row for each table, and COMPANY rows'
work for each class met there by chance; so the work grows with n to the power 1.2 at most.

Defined cases: vectors that are null, zero, or hold null or non-finite parts, rows with a null label, and vectors of
another length link with nothing; equal vectors link with each other; rows that share a vec_id are one vector with
several values, each of which gets a row; repeated rows return once each and count as links of each other; ties at the
threshold link; an empty table gives no rows; other columns are ignored. Parts keep the precision of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import table, written
from quillmesh.llm.graph import components

THRESHOLD = 0.93
RECALL = 0.9995
LEAST_SIGNS, MOST_SIGNS = 8, 30
#: The work of verifying a class met by chance, in rows of a table.
COMPANY = 10
#: Classes of a chunk, and those of a block up to which blocks are verified together.
CHUNK, FEW = 1024, 24


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs in a table, tables) of least cost for n classes."""

    def tables(signs: int) -> int:
        return max(1, math.ceil(math.log(1 - recall) / math.log1p(-((1 - math.acos(threshold) / math.pi) ** signs))))

    signs = min(range(LEAST_SIGNS, MOST_SIGNS + 1), key=lambda s: tables(s) * (1 + COMPANY * n / 2**s))
    return signs, tables(signs)


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a column of lists without nulls, the rows of each length and their values as a matrix."""
    lengths, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, values[(ends[rows] - size)[:, None] + np.arange(size)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # no overflow or underflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def hashed(classes: DataFrame, signs: int, tables: int, seed: int = 11) -> DataFrame:
    """classes (node, label, n, embedding) with size and codes, an array of one integer a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(signs, dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            codes, lengths = np.zeros((len(batch), tables), np.int32), np.zeros(len(batch), np.int32)
            for rows, vectors in _lists(batch.column("embedding")):
                size = vectors.shape[1]
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, signs * tables))
                for k in range(0, len(rows), 2000):
                    some = rows[k : k + 2000]
                    codes[some] = (_unit(vectors[k : k + 2000]) @ planes[size] >= 0).reshape(len(some), tables, signs) @ powers
                lengths[rows] = size
            ends = pa.array(np.arange(0, len(batch) * tables + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], [*batch.schema.names, "size", "codes"])

    parts = classes.schema["embedding"].dataType.simpleString()
    return classes.mapInArrow(run, f"node long, label string, n long, embedding {parts}, size int, codes array<int>")


KEY = ["label", "size", "t", "code", "x", "y"]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over links (i, j)."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _linked(u: np.ndarray, cuts: np.ndarray, cross: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block that link. cuts: the ends of blocks; cross: by block, whether only pairs of its two
    chunks are meant; first: by row, whether it is of the first chunk."""
    found = []
    sizes = np.diff(cuts)
    for k in np.flatnonzero(sizes > FEW):
        a, b = cuts[k], cuts[k + 1]
        if cross[k]:
            x, y = a + np.flatnonzero(first[a:b]), a + np.flatnonzero(~first[a:b])
            i, j = np.nonzero(u[x] @ u[y].T >= threshold)
            found.append((x[i], y[j]))
        else:
            i, j = np.nonzero(np.triu(u[a:b] @ u[a:b].T >= threshold, 1))
            found.append((a + i, a + j))
    small = np.flatnonzero(sizes <= FEW)
    until = np.repeat(cuts[1:], sizes)
    at = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in small]) if len(small) else np.zeros(0, np.int64)
    crossed = np.repeat(cross, sizes)
    for d in range(1, FEW):
        at = at[at + d < until[at]]
        for k in range(0, len(at), 20_000):
            i = at[k : k + 20_000]
            i = i[~crossed[i] | (first[i] != first[i + d])]
            near = i[np.einsum("ij,ij->i", u[i], u[i + d]) >= threshold]
            found.append((near, near + d))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _verify(threshold: float):
    def work(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        n, t, node = (rows.column(c).to_numpy() for c in ("n", "t", "node"))
        chunk, x, y = (rows.column(c).to_numpy() for c in ("chunk", "x", "y"))
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        which = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        for at, vectors in _lists(rows.column("embedding").combine_chunks()):  # a block has vectors of one length
            blocks, ends = np.unique(which[at], return_index=True)
            a, b = _linked(_unit(vectors), np.append(ends, len(at)), (x != y)[cuts[blocks]], (chunk == x)[at], threshold)
            i.append(at[a])
            j.append(at[b])
        i, j = np.concatenate(i), np.concatenate(j)
        new = np.ones(len(i), bool)
        for k in range(0, len(i), 100_000):  # pairs that met in a table before have been counted there
            a, b = i[k : k + 100_000], j[k : k + 100_000]
            new[k : k + 100_000] = ~((codes[a] == codes[b]) & (np.arange(codes.shape[1]) < t[a][:, None])).any(1)
        i, j = i[new], j[new]
        sums = np.bincount(i, weights=n[j], minlength=len(rows)) + np.bincount(j, weights=n[i], minlength=len(rows))
        root = _forest(len(rows), i, j)
        some = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(sums[some].astype(np.int64)), pa.array(node[root[some]])], ["node", "n_links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if len(rows):
                changed = np.zeros(len(rows) - 1, bool)
                for c in KEY:
                    codes = rows.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
                    changed |= codes[1:] != codes[:-1]
                cuts = np.concatenate([[0], np.flatnonzero(changed) + 1])
                held = rows.slice(cuts[-1])
                if len(cuts) > 1:
                    yield work(rows.slice(0, cuts[-1]), cuts)
        if held is not None:
            yield work(held, np.array([0, len(held)]))

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of rows (vec_id, embedding, label)."""
    exact = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(exact).alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).select("node", "label", "n", "embedding"))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    codes = written(hashed(classes, *tables_for(most, threshold)))
    codes = codes.withColumn("value", F.xxhash64("embedding"))  # rows of one vec_id may differ
    met = codes.select("node", "label", "value", "size", F.posexplode("codes").alias("t", "code"))
    bucket = ["label", "size", "t", "code"]
    full = met.groupBy(*bucket).agg(F.count("*").alias("c")).where("c > 1")
    chunks = F.ceil(F.col("c") / chunk).cast("int")
    members = met.join(full, bucket).select("node", "label", "value", "t", "code", chunks.alias("chunks"), F.pmod(F.xxhash64("node", F.lit(5)), chunks).cast("int").alias("chunk"))
    dealt = members.join(codes.drop("size"), ["node", "label", "value"]).withColumn("size", F.size("embedding")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("label", "size", "t", "code", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "node", "n", "embedding", "codes")
    found = written(dealt.repartition(*KEY).sortWithinPartitions(*KEY, "node").mapInArrow(_verify(threshold), "node long, n_links long, root long"))
    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = classes.join(links, "node", "left").join(parts, "node", "left").select("label", "embedding", "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(classes, ["label", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
