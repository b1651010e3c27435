"""Exact encoding and decoding with a SentencePiece merge-type (BPE) model, without its library.

Encoding by backtracking: all vocabulary matches of a stretch come from one Aho-Corasick pass; tokens are taken longest
first, a token may follow another only if re-merging the two together gives just these two, and a bitfield remembers
positions from which no valid end was reached. A sequence in which all neighbours are compatible is the one that merging
gives. No piece holds a word-begin mark after another character, so stretches between such places are encoded apart
and memoised.

Defined cases: null or empty text has no ids and decodes to the empty text; characters outside the vocabulary become
byte pieces; of equal merges the leftmost is made, as in the library; very long texts are encoded whole, stretch by
stretch; repeated rows give one row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Memo, table, tokenizer_file

MARK = "▁"
_STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only merge-type models with byte pieces and no text rules are supported")
        self.text = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a word-begin mark after another character")
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.hidden = {i for i, p in enumerate(model.pieces) if p.type in (2, 3)}
        self.prefix = norm.add_dummy_prefix
        self.breaks = not any("\n" in p for p in self.id)  # then a line feed is a byte piece, and nothing merges over it
        self.decoded = [p.replace(MARK, " ") for p in self.text]
        self.decimal = [str(i) for i in range(len(self.text))]
        self.size = [len(p) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.pairs = Memo(self._compatible, 200_000)
        self.stretches = Memo(self._stretch, 20_000)
        self.words = Memo(lambda w: self._stretch(w if w[0] == "\n" else MARK + w) if w and MARK not in w else None)

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored pair first, the leftmost of equals. For short texts."""
        parts, score = list(text), self.score
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        a, b = self.text[pair[0]], self.text[pair[1]]
        return self.merged(a + b) == [a, b]

    def _run(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        size, pairs, end = self.size, self.pairs, len(text)
        found: list[list[int]] = [[] for _ in text]
        for last, i in self.automaton.iter(text):
            found[last - size[i] + 1].append(i)  # shortest first at each start
        dead = 0
        taken: list[int] = []
        at, before = 0, -1
        tries = found[0]
        k = len(tries)
        while True:
            while k:
                k -= 1
                i = tries[k]
                to = at + size[i]
                if not dead >> to & 1 and (before < 0 or pairs[before, i]):
                    break
            else:
                dead |= 1 << at
                i = taken.pop()
                at -= size[i]
                before = taken[-1] if taken else -1
                tries = found[at]
                k = tries.index(i)
                continue
            taken.append(i)
            if to == end:
                return taken
            at, before = to, i
            tries = found[at]
            k = len(tries)

    def ids(self, text: str) -> list[int]:
        """Ids of one stretch."""
        out: list[int] = []
        run = 0
        for k, ch in enumerate(text):
            if ch not in self.id:
                if k > run:
                    out += self._run(text[run:k])
                out += [self.byte_id[b] for b in ch.encode()]
                run = k + 1
        return out + self._run(text[run:]) if run < len(text) else out

    def raw(self, ids: list[int]) -> str:
        """Decoded text of ids, the first word-begin mark not yet removed."""
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.hidden:
                out += self.decoded[i].encode()
        return out.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        text = self.raw(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _stretch(self, text: str) -> tuple[str, str]:
        ids = self.ids(text)
        plain = self.byte_of.keys().isdisjoint(ids)
        return ",".join([self.decimal[i] for i in ids]), "".join([self.decoded[i] for i in ids]) if plain else self.raw(ids)

    def encode_decode(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by commas, decoded text)."""
        if not text:
            return "", ""
        found = [None]
        if self.prefix and self.breaks and text[0] != "\n":
            found = list(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))
        if None in found:
            marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
            found = list(map(self.stretches.__getitem__, _STRETCH.findall(marked)))
        decoded = "".join([d for _, d in found])
        return ",".join([i for i, _ in found]), decoded[1:] if self.prefix and decoded.startswith(" ") else decoded

    def encode(self, text: str) -> list[int]:
        ids = self.encode_decode(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and decoded text of every document."""
    return _mapped(docs, path, False)


def _mapped(docs: DataFrame, path: str | None, digests: bool) -> DataFrame:
    path = path or tokenizer_file("piece_bpe_32k.model")

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1):
                ids, decoded = m.encode_decode(text.as_py() or "")
                counts.append(ids.count(",") + 1 if ids else 0)
                first.append(sha(ids) if digests else ids)
                second.append(sha(decoded) if digests else decoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names)

    schema = "ids_sha256 string, decoded_sha256 string" if digests else "ids string, decoded string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_tokens long, {schema}")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(table(spark, sf_dir, "documents"), None, True)
