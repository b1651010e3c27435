"""Language identification as inference of a mixture of languages.

Character bigrams and trigrams (inside padded words, hashed to DIMS) give each word a likelihood in every language.
Expectation-maximisation over a text's words estimates the share of each language in it; languages are added to the set
one by one while the likelihood gains more than a penalty of BIC kind. The prediction is the largest share of the set,
the score that share. A text in which one language has a share of 0.95 or more is taken as that language's without
trying sets, and a set is tried with the eight largest other languages that have a share above 0.02: both save time on
texts that no set would change, and hold for every text whatever its size.

The model is fitted on a bounded sample of labelled texts: about SAMPLE of each language, chosen by a hash of the id.

Defined cases: null text or text without a letter, and any text when nothing could be learned, is "und" with score 0;
of equal shares the language first in order is taken; very long texts count whole, word by word; repeated rows are
predicted once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Memo, held_out, table

DIMS = 1 << 15
SAMPLE = 2000
ROUNDS = 8
PENALTY = 3.0
CHUNK = 200_000
KEPT = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_DIM = Memo(lambda g: zlib.crc32(g.encode()) % DIMS, 200_000)


def grams(word: str) -> list[int]:
    """Hashed bigrams and trigrams of the padded word."""
    w = f" {word} "
    at = _DIM.__getitem__
    return [at(w[i : i + 2]) for i in range(len(w) - 1)] + [at(w[i : i + 3]) for i in range(len(w) - 2)]


def sampled(docs: DataFrame, label: str, most: int, seed: int = 0) -> DataFrame:
    """About ``most`` rows of each label, chosen by a hash of doc_id; all where there are fewer."""
    counts = {r[label]: r["count"] for r in docs.groupBy(label).count().collect()}
    scale = 1 << 30
    limits = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(scale, int(scale * most / n)))))) if counts else None
    if limits is None:
        return docs.limit(0)
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(scale)) < F.element_at(limits, F.col(label)))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: DIMS x languages."""
        self.langs = langs
        total = counts + 0.05
        self.log = np.log(total / total.sum(0)).astype(np.float32) / 2  # two overlapping orders
        self.words: dict[str, bytes] = {}

    def _likelihoods(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods, words x languages; those of single words are kept for the next texts."""
        if len(self.words) > KEPT:
            self.words.clear()
        missing = list(set(words) - self.words.keys())
        if missing:
            found = [grams(w) for w in missing]
            starts = np.cumsum([0, *map(len, found[:-1])])
            rows = np.add.reduceat(self.log[[g for x in found for g in x]], starts, 0)
            self.words.update(zip(missing, map(bytes, rows), strict=True))
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.float32).reshape(-1, len(self.langs))

    def _set(self, like: np.ndarray, share: np.ndarray) -> tuple[int, float]:
        """Index and share of the main language of a text that may hold several; like: words x languages."""
        n = len(like)
        chosen = [int(np.argmax(like.sum(0)))]
        best, shares = like[:, chosen[0]].sum(), np.ones(1)
        others = [k for k in np.argsort(-share) if k != chosen[0] and share[k] > 0.02][:8]
        for k in others:
            some = chosen + [int(k)]
            top = like[:, some].max(1)
            p = np.exp(like[:, some] - top[:, None])
            pi = share[some] / share[some].sum()
            for _ in range(ROUNDS):
                r = p * pi
                pi = (r / r.sum(1, keepdims=True)).mean(0)
            now = float((np.log((p * pi).sum(1)) + top).sum())
            if now - best > PENALTY * 0.5 * np.log(n + 1):
                chosen, best, shares = some, now, pi
        k = int(np.argmax(shares))
        return chosen[k], float(shares[k])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return out
        at, held, rows = 0, [], []

        def flush() -> None:
            if not rows:
                return
            like = self._likelihoods(held)
            sizes = np.array([n for _, n in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            p = np.exp(like - like.max(1, keepdims=True))
            share = np.full((len(rows), len(self.langs)), 1 / len(self.langs), np.float32)
            for _ in range(ROUNDS):
                r = p * np.repeat(share, sizes, 0)
                r /= r.sum(1, keepdims=True)
                share = np.add.reduceat(r, starts, 0) / sizes[:, None]
            for k, (i, n) in enumerate(rows):
                main = int(np.argmax(share[k]))
                part = float(share[k, main])
                if part < 0.95:
                    main, part = self._set(like[starts[k] : starts[k] + n].astype(np.float64), share[k].astype(np.float64))
                out[i] = self.langs[main], min(1.0, part)
            held.clear()
            rows.clear()

        for i, text in enumerate(texts):
            found = words_of(text) if text else []
            if found and not found[0].isalpha() and not any(c.isalpha() for c in text):
                found = []  # only other alphanumeric signs, such as raised digits
            if found:
                held += found
                rows.append((i, len(found)))
                at += len(found)
            if at >= CHUNK:
                flush()
                at = 0
        flush()
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: labelled rows with doc_id, text and lang; whole texts of a bounded sample are counted on the executors."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                found.setdefault(lang, Counter()).update(words_of(text or ""))
        for lang, words in found.items():
            sums = np.zeros(DIMS, np.int64)
            for word, n in words.items():
                np.add.at(sums, grams(word), n)
            where = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "gram": where.astype(np.int32), "n": sums[where]})

    labelled = docs.where("lang is not null").select("doc_id", "text", "lang")
    counted = sampled(labelled, "lang", sample).select("text", "lang").mapInPandas(count, "lang string, gram int, n long")
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most DIMS rows a language
    langs = sorted(set(sums["lang"]))
    counts = np.zeros((DIMS, len(langs)))
    counts[sums["gram"].to_numpy(), [langs.index(x) for x in sums["lang"]]] = sums["n"]
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, keep: list[str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``keep`` of docs (which has text) with the prediction and its score under the given names."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.langs, m.log = shared.value
        m.words = {}
        for batch in batches:
            found = m.predict(batch.column("text").to_pylist())
            kept = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*keep, lang, score])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.mapInArrow(run, f"{fields}, {lang} string, {score} double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
