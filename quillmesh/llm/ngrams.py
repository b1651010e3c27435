"""Exact Jaccard join over word n-grams by universe partitioning.

A text's set holds its distinct word shingles, as 64-bit hashes. Sets of a size band [lo, hi] that reach the similarity
differ in at most H shingles, so of the segments into which hashing deals the universe, some must agree:

* ``subsets``: with the segments in (H + 1 + g) / 2 groups of three, each two of a group are indexed as one subset. A
  segment that differs takes two subsets of its group at first, then the last one, so g + 1 subsets stay equal;
* ``deletion``: with H // 2 + 1 segments, at least one differs by one shingle at most; each segment's hash and those of
  its one-deletion neighbourhood are indexed.

Each band gets the kind of least cost: index entries, and COMPANY times the entries that it is expected to share with a
text that shares SHARE of its shingles. Costs decide inside the bands of subsets, too: a hash that more than HOT texts
share (empty segments, parts of passages that many documents hold) is dear. A text leaves out its g last hashes, as far
as they are dear, in an order in which dear ones come last. That loses nothing: of the g + 1 hashes that two similar
texts share, the first in this order has g others behind it in both texts, so neither leaves it out.

Texts with equal sets are one class and join through it; bands in which H is 0 need nothing else. Buckets with the same
members count once. They are then worked off in rounds: each bucket's pivot against the others, verified on the whole
texts, then components, then only buckets that still hold several components, with another pivot; at last all pairs of
different components, in blocks of at most BLOCK x BLOCK inside the tasks. Before texts are compared, cells of the
universe are, each with one bit that says whether the set has an odd number of shingles there: no more cells differ than
shingles do, so pairs beyond the bound fall out, and blocks return only what is left. Cells grow with the set, so that
they stay as telling for long texts. Every pair that shares a bucket is either judged or within one component already.

Work is dealt by hash; hashes that the sample shows to be very common are salted. Tasks stream sorted rows and hold no
bucket.

Defined cases: null or empty text (no words) has an empty set and links with nothing; fewer words than a shingle form
one shingle; very long texts are taken whole; rows that share a doc_id are one document with several texts; a row with
a null doc_id gets its set size, a null component and no links; repeated rows return once each; ties take the smallest
doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import table, written
from quillmesh.llm.graph import components

#: A segment hash shared by more texts than this is dear.
HOT = 8
#: The share of a text's shingles that costs suppose another text to share, and the weight of an entry shared by chance.
SHARE, COMPANY = 0.6, 3
#: Size bands grow by this factor.
RATIO = 1.5
#: The band number that marks a row about a text rather than a segment.
TEXT = 63
#: Pivot rounds at most before the rest is compared in blocks, and the side of a block.
ROUNDS, BLOCK = 3, 256
#: Partners of one pivot that are verified in one group.
GROUP = 128
#: Cells that are compared before texts: FEWEST, or a power of two of at least twice the set.
FEWEST = 2048
#: Ids are broadcast up to this number; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Texts in the sample that finds hashes to salt, the share of it that makes one common, and the salts.
SAMPLE, COMMON, SALTS = 4000, 0.02, 32
#: Buckets whose pairs are so many times their rows at most are compared in blocks without more rounds.
FEW_PAIRS = 32

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


#: Words of up to so many bytes are hashed by sums over their bytes, for all words at once; longer ones singly.
SHORT = 64
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90))
with np.errstate(over="ignore"):
    _BYTES = np.where(_WHITE, np.uint64(0), mixed((_LOWER.astype(np.uint64) + np.uint64(1)) * _A))
    _PLACES = np.append(mixed(np.arange(1, SHORT + 1, dtype=np.uint64) * _B) | np.uint64(1), np.uint64(0))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text in lower case (A-Z), in order."""
    raw = text.encode()
    codes = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(~_WHITE[codes], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(starts), 100_000):
            first, last = starts[k : k + 100_000], ends[k : k + 100_000]
            at = np.arange(last[-1] - first[0]) - np.repeat(first - first[0], np.diff(np.append(first, last[-1])))
            out[k : k + 100_000] = np.add.reduceat(_BYTES[codes[first[0] : last[-1]]] * _PLACES[np.minimum(at, SHORT)], first - first[0])
        for k in np.flatnonzero(ends - starts > SHORT):
            out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].lower())
        return mixed(out + (ends - starts).astype(np.uint64) * _C)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mixed((out + h[k : len(h) - n + 1 + k]) * _A)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def cells(items: np.ndarray) -> bytes:
    """Whether a set has an odd number of shingles in each cell of the universe, as bits."""
    n = max(FEWEST, 1 << (2 * len(items)).bit_length())
    odd = np.bincount((items & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Cells of several sets as a matrix of ``width`` bytes in words of eight; finer ones are folded."""
    rows = [np.frombuffer(c, np.uint64) for c in bits]
    return np.stack([r if 8 * len(r) == width else np.bitwise_xor.reduce(r.reshape(-1, width // 8)) for r in rows])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cells in which rows of x and y differ: no more than the sets differ in shingles."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


class Plan:
    """Bands and what each indexes, for a similarity of num / den."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.lo: list[int] = []
        self.band: list[tuple[int, bool, int]] = []  # segments (none: nothing to index), deletion, slack
        lo = 1
        while lo <= largest and len(self.lo) < TEXT:
            hi = max(lo, int(lo * RATIO)) if len(self.lo) < TEXT - 1 else largest
            self.band.append(self._choose((lo + hi) / 2, 2 * hi * (den - num) // (den + num)))
            self.lo.append(lo)
            lo = hi + 1

    @staticmethod
    def _choose(size: float, h: int) -> tuple[int, bool, int]:
        if not h:
            return 0, False, 0
        groups = (h + 1 + h // 4 + 2 + 1) // 2
        other = 2 * size / (3 * groups) * (1 - SHARE)  # shingles of a subset that the other text lacks, on average
        subsets = 3 * groups * (1 + COMPANY * np.exp(-other))
        segments = h // 2 + 1
        other = size / segments * (1 - SHARE)
        deletion = size + segments + COMPANY * segments * np.exp(-other) * (1 + other)
        return (segments, True, 0) if deletion < subsets else (3 * groups, False, 2 * groups - h - 1)

    def bands(self, size: int) -> list[int]:
        """Bands in which a set of this size can have a partner of the band's sizes that is no smaller."""
        b = int(np.searchsorted(self.lo, size, "right")) - 1
        found = [b]
        while b + 1 < len(self.lo) and self.den * size >= self.num * self.lo[b + 1]:
            b += 1
            found.append(b)
        return [b for b in found if self.band[b][0]]

    def keys(self, items: np.ndarray, band: int) -> np.ndarray:
        """Index hashes of a set in a band; the low six bits are the band."""
        m, deletion, _ = self.band[band]
        with np.errstate(over="ignore"):
            x = mixed(items + np.uint64(band + 1))
            seg = ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            x = mixed(x ^ _A)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, seg, x)
            place = np.arange(m, dtype=np.uint64) * _A + np.uint64(band)
            keys = mixed(sums ^ mixed(place))
            if deletion:
                keys = np.concatenate([keys, mixed((sums[seg] - x) ^ mixed(place[seg]))])
            else:
                threes = keys.reshape(-1, 3)
                keys = mixed(threes * _A + np.roll(threes, -1, axis=1)).ravel()
        return keys & ~np.uint64(63) | np.uint64(band)


@cache
def plan(num: int, den: int) -> Plan:
    return Plan(num, den)


_ROWS = "key long, salt int, doc long, info binary"


def _index(width: int, p: Plan, common: np.ndarray):
    """Rows of each text: one about it (info: digest and size), and one for each index hash of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, docs, infos = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                items = shingles(text.as_py(), width)
                digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                infos.append((doc, digest + len(items).to_bytes(8, "big") + cells(items)))
                if len(items) and digest not in seen:  # copies within a task are indexed once
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(digest)
                    for band in p.bands(len(items)):
                        keys.append(p.keys(items, band))
                        docs.append(np.full(len(keys[-1]), doc, np.int64))
                if len(docs) >= 2000:
                    yield from rows(keys, docs)
                    keys, docs = [], []
            yield from rows(keys, docs)
            ids = np.array([d for d, _ in infos], np.int64)
            key = mixed(ids.astype(np.uint64)) | np.uint64(TEXT)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array([i for _, i in infos], pa.binary())], ["key", "salt", "doc", "info"])

    def rows(keys: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if keys:
            key, doc = np.concatenate(keys), np.concatenate(docs)
            salt = np.zeros(len(key), np.int32)
            if len(common):
                salt = np.where(np.isin(key, common), (mixed(doc.astype(np.uint64)) % np.uint64(SALTS)).astype(np.int32) + 1, 0).astype(np.int32)
            for a in range(0, len(key), 100_000):
                b = a + 100_000
                n = len(key[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(key[a:b].view(np.int64)), pa.array(salt[a:b]), pa.array(doc[a:b]), pa.nulls(n, pa.binary())], ["key", "salt", "doc", "info"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those about texts and those of hashes that several texts share; dear: 1 if dear, 2 if salted."""
    held_key, held_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    dear_key = None  # the key of a run of which HOT + 1 rows have gone out already

    def out(key: np.ndarray, doc: np.ndarray, dear: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(dear), pa.nulls(len(key), pa.binary())], ["key", "doc", "dear", "info"])

    def runs(key: np.ndarray, doc: np.ndarray, salt: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held_key, held_doc, dear_key
        key, doc = np.concatenate([held_key, key]), np.concatenate([held_doc, doc])
        salt = np.concatenate([np.zeros(len(held_key), np.int32), salt])
        held_key, held_doc = key[:0], doc[:0]
        if not len(key):
            return
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        lengths = np.diff(np.concatenate([starts, [len(key)]]))
        dear = np.repeat((lengths > HOT) | (key[starts] == dear_key if dear_key is not None else False), lengths) | (salt > 0)
        keep = np.repeat(lengths > 1, lengths) | dear
        if not last:
            if dear[-1]:
                dear_key = key[-1]
            else:
                held_key, held_doc = key[starts[-1] :].copy(), doc[starts[-1] :].copy()
                keep[starts[-1] :] = False
        if keep.any():
            yield out(key[keep], doc[keep], (dear + (salt > 0)).astype(np.int32)[keep])

    for batch in batches:
        key, salt, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        texts = key & 63 == TEXT
        if texts.any():
            mask = pa.array(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask), pa.array(np.zeros(int(texts.sum()), np.int32)), batch.column(3).filter(mask)], ["key", "doc", "dear", "info"])
        yield from runs(key[~texts], doc[~texts], salt[~texts], False)
    yield from runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), True)


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shingles(text.as_py(), width)) for text in batch.column(0)], pa.int64())], ["n_shingles"])

    return run


def _verify(width: int, num: int, den: int):
    """Of rows sorted by pivot, part and whether they are the pivot, the pairs that link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pivots = None, []
        for batch in batches:
            found = []
            for a, part, other, b, text in zip(batch["a"], batch["part"], batch["other"], batch["b"], batch["text"], strict=True):
                items = shingles(text, width)
                if (a, part) != at:
                    at, pivots = (a, part), []
                if not other:
                    pivots.append(items)
                    continue
                for p in pivots:
                    most, least = max(len(p), len(items)), min(len(p), len(items))
                    if least and den * least >= num * most:
                        same = len(np.intersect1d(p, items, assume_unique=True))
                        if den * same >= num * (len(p) + len(items) - same):
                            found.append((a, b))
                            break
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _possible(num: int, den: int):
    """Of pairs with the sizes and cells of both sides, those whose cells allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            x, y = (batch.column(k).to_pylist() for k in (4, 5))
            widths = np.minimum([len(c) for c in x], [len(c) for c in y])
            keep = np.zeros(len(n), bool)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                for k in range(0, len(at), step := max(1, 4_000_000 // int(width))):
                    some = at[k : k + step]
                    far = apart(folded([x[i] for i in some], width), folded([y[i] for i in some], width))
                    keep[some] = far * (den + num) <= (n[some] + m[some]) * (den - num)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _blocks(num: int, den: int):
    """Of rows sorted by key, x and y, the pairs of different components whose cells allow the similarity.

    Rows have key, x, y, chunk, node, comp, n and cells; with x = y all pairs of the block are meant, else those of
    chunk x with chunk y.
    """

    def pairs_of(until: np.ndarray, cross: np.ndarray, chunk: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """until: the end of each row's block; pairs are taken by their distance, for all blocks at once."""
        found = [(node[:0], node[:0])]
        at, d = np.arange(len(node)), 0
        while len(at):
            d += 1
            at = at[at + d < until[at]]
            some = at[(comp[at] != comp[at + d]) & (~cross[at] | (chunk[at] != chunk[at + d]))]
            step = max(1, 1_000_000 // bits.shape[1])
            for k in range(0, len(some), step):
                i, j = some[k : k + step], some[k : k + step] + d
                near = apart(bits[i], bits[j]) * (den + num) <= (n[i] + n[j]) * (den - num)
                i, j = node[i[near]], node[j[near]]
                found.append((np.minimum(i, j), np.maximum(i, j)))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = yield from work(rows, False)
        if held is not None:
            yield from work(held, True)

    def work(rows: pd.DataFrame, last: bool):
        if not len(rows):
            return None
        key, x, y, chunk, node, comp, n = (rows[c].to_numpy() for c in ("key", "x", "y", "chunk", "node", "comp", "n"))
        ends = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        cuts = [0, *ends.tolist(), *([len(rows)] if last else [])]
        m = cuts[-1]
        sizes, blocks = np.diff(cuts), rows["cells"].iloc[:m].to_list()
        widths = np.array([len(c) for c in blocks], np.int64)
        least = np.repeat(np.minimum.reduceat(widths, cuts[:-1]), sizes) if m else widths  # in a block, cells are as fine as its coarsest
        which = np.repeat(np.arange(len(sizes)), sizes)
        for width in np.unique(least):
            at = np.flatnonzero(least == width)
            until = np.searchsorted(which[at], which[at], "right")
            bits = folded([blocks[i] for i in at], width)
            first, second = pairs_of(until, (x != y)[at], chunk[at], node[at], comp[at], n[at], bits)
            yield pd.DataFrame({"a": first, "b": second}).drop_duplicates()
        return None if last else rows.iloc[cuts[-1] :]

    return run


def small(df: DataFrame) -> DataFrame:
    """df of single ids, marked for broadcast if its count is within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


class Join:
    """Classes and components of documents (doc_id, text) by shingles of ``width`` words and a Jaccard of num / den."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.width, self.num, self.den, self.plan = width, num, den, plan(num, den)

    def _indexed(self) -> DataFrame:
        n = self.docs.count()
        none = np.zeros(0, np.uint64)
        scale = 1 << 30
        some = self.docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(scale)) < int(scale * min(1.0, SAMPLE / max(n, 1))))
        counts = some.mapInArrow(_index(self.width, self.plan, none), _ROWS).where("info is null").groupBy("key").count()
        least = max(HOT, int(COMMON * min(n, SAMPLE)))  # at most (hashes a text) / COMMON keys reach it
        common = np.array(sorted(r["key"] for r in counts.where(F.col("count") > least).collect()), np.int64).view(np.uint64)
        rows = self.docs.mapInArrow(_index(self.width, self.plan, common), _ROWS)
        rows = rows.repartition("key", "salt").sortWithinPartitions("key", "doc")
        return written(rows.mapInArrow(_buckets, "key long, doc long, dear int, info binary"))

    def _verified(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("cells").alias(f"cells_{c}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "cells_a", "cells_b")
        pairs = written(near.mapInArrow(_possible(self.num, self.den), "a long, b long").distinct())
        nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("b")).distinct())
        texts = self.docs.withColumnRenamed("doc_id", "b").join(small(nodes), "b", "left_semi")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
        pairs = written(pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "part", "b"))
        pivots = pairs.select("a", "part").distinct().select("a", "part", F.lit(False).alias("other"), F.col("a").alias("b"))
        rows = pivots.unionByName(pairs.select("a", "part", F.lit(True).alias("other"), "b")).join(texts, "b")
        rows = rows.select("a", "part", "other", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", "other", "b")
        return written(rows.mapInPandas(_verify(self.width, self.num, self.den), "a long, b long").distinct())

    def _blocked(self, rows: DataFrame, sketches: DataFrame) -> DataFrame:
        """Possible pairs (a, b) of different components in the buckets of rows (key, node, comp)."""
        sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
        dealt = rows.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(9)), F.col("chunks")).cast("int"))
        dealt = dealt.join(sketches, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = dealt.select("key", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "node", "comp", "n", "cells")
        blocks = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        return blocks.mapInPandas(_blocks(self.num, self.den), "a long, b long").distinct()

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, n_shingles, node) of every text, and (node, component) of linked nodes, the smallest ids of classes."""
        indexed = self._indexed()
        spans = indexed.where("info is not null")
        n = F.conv(F.hex(F.substring("info", 17, 8)), 16, 10).cast("long")
        spans = spans.select(F.col("doc").alias("doc_id"), F.substring("info", 1, 16).alias("digest"), n.alias("n_shingles"), F.substring("info", 25, 1 << 30).alias("cells"))
        classes = spans.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1").select("digest", "node")
        classes = written(classes)  # so that both sides of the join are shuffles, whose hot partitions can be split
        spans = written(spans.join(classes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node"), "cells"))
        sketches = spans.where("doc_id = node").select("node", F.col("n_shingles").alias("n"), "cells").distinct()
        spans = spans.drop("cells")
        moved = spans.where("doc_id <> node").select(F.col("doc_id").alias("doc"), "node").distinct()

        slack = F.element_at(F.array(*(F.lit(s) for _, _, s in self.plan.band)), (F.col("key").bitwiseAND(63) + 1).cast("int"))
        rows = indexed.where("info is null").join(moved, "doc", "left").select("key", F.coalesce("node", "doc").alias("node"), "dear").distinct()
        rows = rows.withColumn("dear", F.when(slack > 0, F.col("dear")).otherwise(0))
        last = F.row_number().over(Window.partitionBy("node", F.col("key").bitwiseAND(63)).orderBy(F.desc("dear"), "key"))
        rows = rows.where("dear = 0").select("key", "node").unionByName(rows.where("dear > 0").withColumn("last", last).where(F.col("last") > slack).select("key", "node"))
        rows = written(rows)
        members = rows.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("c > 1")
        rows = written(rows.join(members.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"))

        links = parts = tested = None
        for k in range(ROUNDS + 1):
            if parts is not None:
                rows = rows.drop("comp").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
                several = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
                rows = written(rows.join(several, "key", "left_semi"))
            else:
                rows = rows.withColumn("comp", F.col("node"))
            by = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
            left, n = by.agg(F.sum("pairs"), F.sum("n")).first()
            if not left:
                break
            last = k == ROUNDS or k and left <= FEW_PAIRS * n
            if last:
                pairs = self._blocked(rows, sketches)
            else:
                order = F.struct((F.xxhash64("node", F.lit(k)) if k else F.lit(0)).alias("h"), "node", "comp")
                pivot = rows.groupBy("key").agg(F.min(order).alias("p"))
                pairs = rows.join(pivot, "key").where("node <> p.node and comp <> p.comp").select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = written(pairs)
            found = self._verified(pairs, sketches)
            links = found if links is None else links.unionByName(found)
            parts = written(components(links))
            if last:
                break
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            tested = both if tested is None else tested.unionByName(both)
        if parts is None:
            parts = rows.select("node", F.col("node").alias("component")).limit(0)
        return spans, parts


def similar(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of docs."""
    spans, parts = Join(docs, width, num, den).run()
    out = spans.join(parts, "node", "left")
    known = out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    nulls = docs.where("doc_id is null").select("text").mapInArrow(_sizes(width), "n_shingles long")
    nulls = nulls.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(nulls)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90, 100)
