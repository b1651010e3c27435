"""Best-fit packing of tokenized documents into sequences.

Bounded-space online best-fit: a fixed number of open bins, held in a bitset keyed by their free space. A piece goes to
the fullest open bin that has room; when too many bins are open, the fullest one closes. Each task packs its own
hash-dealt share of the pieces, in look-ahead blocks sorted by length, so the waste per task is its last open bins.

Defined cases: null or empty text is the end token alone; repeated rows are packed once each; of bins with equal free
space the last opened is taken; very long texts are encoded whole and cut into pieces; an empty table gives no rows;
columns other than the id and text are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Memo, table, tokenizer_file

SEQUENCE = 1024
END = 2
OPEN_BINS = 4096
BLOCK = 16384
#: A single space between two characters that aren't white space always begins a new word of the byte-level pattern.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class ByteIds:
    """Ids of whole texts as the tokenizers library gives them, as little-endian unsigned 32-bit bytes; words are memoised.

    The library's pattern ends a word before each single space or line feed between two non-space characters, and
    encodes words apart, so the ids of a text are the ids of its stretches between such places. With a file of the same
    vocabulary as ranks, tiktoken encodes the stretches that can hold no special token; it gives the same ids sooner.
    """

    def __init__(self, path: str, ranks: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})._core_bpe
        self.first = Memo(lambda w: self._clean(w, ""), 20_000)
        self.later = Memo(lambda w: self._clean(w, "" if w[:1] == "\n" else " "))

    def _ids(self, text: str) -> bytes:
        if self.plain and not any(s in text for s in self.special):
            return array("I", self.plain.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _clean(self, word: str, before: str) -> bytes | None:
        shown = word if before else word[1:] if word[:1] == "\n" else word
        return None if not shown or shown[0].isspace() or shown[-1].isspace() else self._ids(before + word)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.replace("\n", " \n").split(" ")
        try:
            return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))
        except TypeError:  # white space beside a space: cut only between clean neighbours
            parts = _CUT.split(text)
            return b"".join(self._ids(p if i == 0 else " " + p) for i, p in enumerate(parts))


@cache
def _encoder(path: str, ranks: str | None) -> ByteIds:
    return ByteIds(path, ranks)


def pieces_of(ids: bytes, size: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only longer ones are cut, and only the first may be short."""
    n = len(ids) // 4
    cuts = [0, *range(n % size or size, n, size), n] if n > size else [0, n]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def token_pieces(docs: DataFrame, path: str, ranks: str | None = None, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = _encoder(path, ranks), end.to_bytes(4, "little")
        for batch in batches:
            rows = [
                (doc, *piece)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for piece in pieces_of(ids_of(text.as_py() or "") + last, size)
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.bits, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_ = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fits = self.bits >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.size, self.next
            self.next += 1
        left = free - length
        if left:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, free


def pack(pieces: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, block: int = BLOCK) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length (1 to size)."""
    names = pieces.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(size, open_bins, TaskContext.get().partitionId() << 40)

        def placed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            lengths = rows["length"].to_numpy()
            order = np.argsort(-lengths, kind="stable")
            at = [bins.put(n) for n in lengths[order].tolist()]
            rows = rows.take(pa.array(order))
            rows = rows.append_column("sequence_id", pa.array([a for a, _ in at], pa.int64()))
            return rows.append_column("offset", pa.array([size - b for _, b in at], pa.int64())).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= block:
                yield from placed(held)
                held = []
        if held:
            yield from placed(held)

    dealt = F.xxhash64(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return (
        pieces.repartition(*names)  # so that rows of one id, or of none, are spread
        .sortWithinPartitions(dealt, *names)
        .mapInArrow(task, f"{schema}, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    ranks = None if path else tokenizer_file("byte_bpe_50k.tiktoken")
    return pack(token_pieces(docs, path or tokenizer_file("byte_bpe_50k.json"), ranks, size), size)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
