"""Fill-in-middle transformation over a sparse checkpoint index.

A text is counted once in units (words with the white space before them, and what white space is left at its end); every
so many units the byte and code-point offsets are noted. A cut after a given unit is then found by binary search among
these checkpoints and a rescan of less than one interval. Cuts and forms are drawn from a digest of seed and id, so
reruns and lost tasks repeat them.

Defined cases: null text is empty, and empty texts stay plain; texts that hold a mark stay plain; a null id draws as an
empty one; repeated rows and ids return once each, with the same draws; texts without white space are one unit, white
space alone is one unit; very long texts cost one linear pass and an index of a unit count over the interval; equal cuts
leave the middle empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
EVERY = 256
_UNIT = rb"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
_ONE = re.compile(_UNIT)
_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rule:
    """seed of the draws, percent of texts that are transformed, percent of those with the suffix first, checkpoint interval."""

    seed: int = 42
    percent: int = 50
    suffix_first: int = 80
    every: int = EVERY


def code_points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUED))


class Checkpoints:
    """Byte and code-point offsets after every so many units of a UTF-8 text, and the number of units in all."""

    def __init__(self, data: bytes, every: int = EVERY):
        self.data, self.units, self.bytes, self.chars = data, [0], [0], [0]
        run, at, chars = re.compile(rb"(?:%b){%d}+" % (_UNIT, every)), 0, 0
        while found := run.match(data, at):
            chars += code_points(data[at : found.end()])
            at = found.end()
            self.units.append(self.units[-1] + every)
            self.bytes.append(at)
            self.chars.append(chars)
        n = self.units[-1]
        while found := _ONE.match(data, at):
            at, n = found.end(), n + 1
        self.n = n + (at < len(data))

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the end of so many units."""
        k = bisect_right(self.units, unit) - 1
        at = self.bytes[k]
        for _ in range(unit - self.units[k]):
            found = _ONE.match(self.data, at)
            at = found.end() if found else len(self.data)
        return at, self.chars[k] + code_points(self.data[self.bytes[k] : at])


def transform(doc_id: int | None, data: bytes, rule: Rule) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix and of the middle, output)."""
    index = Checkpoints(data, rule.every)
    drawn = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(drawn[k : k + 4], "big") for k in (0, 4, 8, 12))
    if not data or h3 % 100 >= rule.percent or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, data
    (a, chars_a), (b, chars_b) = map(index.cut, sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    prefix, middle, suffix, p, s, m = data[:a], data[a:b], data[b:], PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < rule.suffix_first:
        return index.n, "spm", chars_a, chars_b - chars_a, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, "psm", chars_a, chars_b - chars_a, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output (text) of each row."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = [(i, *transform(i, t.as_py() or b"", rule)) for i, t in zip(ids, texts, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    out = plain.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form was made of; no mark stands in a text that isn't plain."""
    part = lambda k: F.get(F.split(output, "<[PSM]>", -1), k)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(back, 256)}).drop("output")


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t from documents
), n as (
  select *, len(t)::bigint as n, ('0x' || h[1:8])::bigint % (len(t) + 1) as u, ('0x' || h[9:16])::bigint % (len(t) + 1) as v,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form from d
), c as (
  select *, array_to_string(t[1:least(u, v)], '') as p, array_to_string(t[least(u, v) + 1:greatest(u, v)], '') as m, array_to_string(t[greatest(u, v) + 1:], '') as s from n
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from c
"""
