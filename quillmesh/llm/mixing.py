"""Mixing sources to target weights along a low-discrepancy schedule.

Every source's documents are shuffled by a digest onto a line of words, cut into blocks of BLOCK words. The van der
Corput points of as many binary digits as all slots need are mapped through the sources' cumulative slot counts: the
point's number is its time, the source whose interval holds it owns the slot. Points of whole digits stand on a grid, so
each source gets exactly the slots of its target, spread evenly over any stretch of time. A slot's rank among its
source's, in closed form from the interval's bounds, names the block it takes: rank over the blocks gives the epoch, the
rest the block. The last slot of a source may take part of its block, so a source's words meet its target to a word.

Defined cases: null text has no words, and rows without words are taken zero times; a null source is a source of its
own, the last; null and repeated ids and equal rows count once each (equal rows may swap places, which no result shows);
very long texts lie over many blocks; a source without words has target 0; an empty table gives no rows; columns other
than id, text and source are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import table, written
from quillmesh.llm.order import numbered

BLOCK = 256
#: Rows of a bucket of a line, about; a level of buckets sums at most 2 ** LEVEL of the next.
BUCKET, LEVEL = 1024, 12
#: Slots that one row of the schedule is spread from, and such rows a task.
CHUNK, CHUNKS = 4096, 4
DIGEST_BITS = 60


@dataclass(frozen=True)
class Mix:
    """weights, repeating over the sources in order; words of the mix per word of the corpus; most uses of a word; seed."""

    weights: tuple[int, ...] = (3, 1, 2)
    total: float = 1.5
    most: float = 2.0
    seed: int = 42
    block: int = BLOCK


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, key (of the source, sorting null last), size in words, place (a digest's first bits) of each row."""
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    words = F.regexp_count(text, F.lit(r"[^ \t-\r]+"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)), 256)
    place = F.conv(F.substring(digest, 1, DIGEST_BITS // 4), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), words.cast("long").alias("size"), place.alias("place"))


def lined(rows: DataFrame) -> DataFrame:
    """rows with ``start``, the words before them on their source's line, and ``at``, their place in their ``bucket``.

    Sums run over levels of buckets of the digest, each window over a bounded number of rows, however hot the source.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows.count()) / BUCKET)))
    bucket = F.shiftright("place", DIGEST_BITS - bits).alias("bucket") if bits else F.lit(0).cast("long").alias("bucket")
    levels, width = [rows.groupBy("key", bucket).agg(F.sum("size").alias("words"))], bits
    while width > LEVEL:
        levels.append(levels[-1].groupBy("key", F.shiftright("bucket", LEVEL).alias("bucket")).agg(F.sum("words").alias("words")))
        width -= LEVEL
    above: DataFrame | None = None
    for level in reversed([written(x) for x in levels]):
        level = level.withColumn("upper", F.shiftright("bucket", LEVEL) if above is not None else F.lit(0).cast("long"))
        before = F.sum("words").over(Window.partitionBy("key", "upper").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        level = level.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
        if above is not None:
            level = level.join(above.select("key", F.col("bucket").alias("upper"), F.col("before").alias("first")), ["key", "upper"]).withColumn("before", F.col("before") + F.col("first"))
        above = level.select("key", "bucket", "before")
    own = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size")
    inside = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = rows.select("*", bucket).withColumns({"inside": inside, "at": F.row_number().over(own)})
    return placed.join(above, ["key", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def targeted(sources: DataFrame, mix: Mix) -> DataFrame:
    """key, words, weight and target of each source; what is above a source's most words is shared anew by weight."""
    spread = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("position") % len(mix.weights) + 1).cast("int"))
    every = sources.withColumn("tree", F.lit(0))
    rows = written(numbered(every, "tree", ["key"]).select("key", "words", spread.alias("weight"), (F.col("words") * mix.most).alias("most")))
    total = mix.total * (rows.agg(F.sum("words")).first()[0] or 0)
    share = 0.0
    while True:  # each round holds back more sources than the last, or is the last
        capped = F.col("most") <= F.col("weight") * share
        held, free = rows.agg(F.sum(F.when(capped, F.col("most")).otherwise(0.0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if not free:
            break
        last, share = share, (total - held) / free
        if share <= last:
            break
    return rows.select("key", "words", "weight", F.least(F.col("most"), F.col("weight") * F.lit(share)).alias("target"))


def reversed_bits(value: Column, digits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.conv(value.cast("string"), 10, 2), digits, "0")), 2, 10).cast("long")


def before(time: Column, bound: Column, turned: Column, digits: int) -> Column:
    """How many points of earlier times lie below the bound; turned is the bound with its digits reversed.

    The points below the bound are one class of times modulo a power of two for each digit one of the bound.
    """
    one = F.lit(1).cast("long")

    def add(total: Column, digit: Column) -> Column:
        mask = F.call_function("shiftleft", one, digit)
        return total + F.when(turned.bitwiseAND(mask) != 0, F.call_function("shiftright", time - turned.bitwiseAND(mask - 1) + 2 * mask - 1, digit + 1)).otherwise(0)

    return F.when(bound >= 1 << digits, time).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(digits - 1)), F.lit(0).cast("long"), add))


def schedule(sources: DataFrame, mix: Mix) -> DataFrame:
    """slot (its time), key, epoch, block and words of every slot, from sources with words and (whole) quota."""
    block, words, quota = F.lit(mix.block), F.col("words"), F.col("quota")
    blocks = F.ceil(words / block)
    rest = quota % F.greatest(words, F.lit(1))
    slots = F.floor(quota / F.greatest(words, F.lit(1))) * blocks + F.ceil(rest / block)
    counted = sources.where("words > 0").select(F.lit(0).alias("tree"), "key", words, quota, blocks.cast("long").alias("blocks"), slots.cast("long").alias("slots")).where("slots > 0")
    own = Window.partitionBy("upper").orderBy("position")
    ranked = written(numbered(counted, "tree", ["key"]).withColumn("upper", F.shiftright("position", LEVEL)))
    groups = written(ranked.groupBy("upper").agg(F.sum("slots").alias("slots")))
    first = F.coalesce(F.sum("slots").over(Window.orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("upper", first.alias("first"))
    low = F.coalesce(F.sum("slots").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = ranked.withColumn("low", low).join(groups, "upper").withColumn("low", F.col("low") + F.col("first")).withColumn("high", F.col("low") + F.col("slots"))
    bounds = written(bounds.select("key", "words", "quota", "blocks", "low", "high"))
    every = bounds.agg(F.max("high")).first()[0] or 1
    digits = max(1, (every - 1).bit_length())
    bounds = bounds.withColumns({"low_turned": reversed_bits(F.col("low"), digits), "high_turned": reversed_bits(F.col("high") % (1 << digits), digits)})
    chunks = bounds.withColumn("chunk", F.explode(F.expr(f"sequence(low, high - 1, {CHUNK}L)"))).repartition(-(-every // (CHUNK * CHUNKS)), "key", "chunk")
    points = chunks.withColumn("point", F.explode(F.expr(f"sequence(chunk, least(chunk + {CHUNK - 1}L, high - 1))")))
    points = points.withColumn("slot", reversed_bits(F.col("point"), digits))
    rank = before(F.col("slot"), F.col("high"), F.col("high_turned"), digits) - before(F.col("slot"), F.col("low"), F.col("low_turned"), digits)
    points = points.withColumn("rank", rank)
    points = points.withColumns({"epoch": F.floor(F.col("rank") / F.col("blocks")), "block": F.col("rank") % F.col("blocks")})
    begun = F.col("epoch") * words + F.col("block") * block
    return points.select("slot", "key", "epoch", "block", F.least(block, words - F.col("block") * block, quota - begun).alias("words"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The rows (key, bucket, at, doc_id, size, source_size, target) and the mix's pieces of them.

    A piece: slot, epoch, key, bucket, at, first (word of the row) and taken (words). In order of slot and first word,
    the pieces are the mix.
    """
    rows = written(lined(written(sized(docs, mix.seed))))
    sources = written(targeted(rows.groupBy("key").agg(F.sum("size").alias("words")), mix))
    slots = written(schedule(sources.withColumn("quota", F.floor(F.col("target") + 0.5)), mix).withColumnRenamed("words", "allowed"))  # so that its size is known to the join
    block = mix.block
    parts = rows.where("size > 0").select("key", "bucket", "at", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    begun = F.col("block") * block
    parts = parts.withColumn("first", F.greatest(begun - F.col("start"), F.lit(0))).withColumn("until", F.least(begun + block - F.col("start"), F.col("size")))
    joined = parts.join(slots, ["key", "block"])
    taken = F.least(F.col("until"), begun + F.col("allowed") - F.col("start")) - F.col("first")
    pieces = joined.select("slot", "epoch", "key", "bucket", "at", "first", taken.alias("taken")).where("taken > 0")
    return rows.join(sources.select("key", F.col("words").alias("source_size"), "target"), "key").drop("start", "place"), pieces


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mixed(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("key", "bucket", "at").agg(F.sum("taken").alias("taken"))
    return rows.join(taken, ["key", "bucket", "at"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


OP12_SQL = r"""
with recursive d as (
  select doc_id, if(source is null, '1', '0' || source) as key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || sha256('42:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')))[1:15])::bigint as place from documents
), l as (
  select *, coalesce(sum(size) over (partition by key order by place, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as start from d
), s as (
  select key, sum(size)::bigint as words, [3, 1, 2][(row_number() over (order by encode(key)) - 1) % 3 + 1] as weight from d group by key
), t as (
  select sum(words) * 1.5::double as total from s
), shares(i, share) as (
  select 0, 0.0::double union all
  select i + 1, (any_value(total) - sum(if(words * 2.0::double <= weight * share, words * 2.0::double, 0))) / nullif(sum(if(words * 2.0::double <= weight * share, 0, weight)), 0)
  from shares, s, t where i < 60 group by i
), q as (
  select key, words, least(words * 2.0::double, weight * (select max(share) from shares)) as target from s
)
select doc_id, size, words as source_size, target,
  (if(words = 0, 0, floor(target + 0.5)::bigint // words * size) + if(words = 0, 0, greatest(0, least(start + size, floor(target + 0.5)::bigint % words) - start)))::bigint as taken
from l join q using (key)
"""
