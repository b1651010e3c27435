"""Quality classification by attention-based multiple-instance learning.

A text is a bag of passages, blocks of BLOCK bytes of its UTF-8 form over its whole length. A passage is its byte
histogram (square roots of shares) and its share of distinct four-byte strings, which a learned layer encodes; gated attention, learned from the labels of whole
documents only, weighs the passages, and the weighted mean of their encodings is scored.

The model is fitted on a bounded sample: about SAMPLE labelled texts of each label, chosen by a hash of the id, of at
most LONGEST bytes. Scoring reads all passages of all texts.

Defined cases: null or empty text has one empty passage; a score of exactly 0.5 counts as label 1; very long texts are
scored by all their passages; repeated rows are scored once each; an empty table gives no
rows; with fewer than two labels to learn from, all scores are the share of label 1 (0.5 without labels); other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import held_out, table
from quillmesh.llm.language import sampled

BLOCK = 512
SAMPLE = 2500
LONGEST = 100_000
DIMS = 257
HIDDEN, ATTEND = 24, 12
EPOCHS, BATCH, RATE = 25, 64, 0.01
GROUP = 4_000_000


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Byte histograms of all passages and shares of distinct strings (n x DIMS) and the number of passages of each text."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([max(1, -(-len(b) // BLOCK)) for b in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(b) for b in raw])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    block = np.repeat(first, lengths) + within // BLOCK
    hist = np.bincount(block * 256 + data, minlength=int(sizes.sum()) * 256).reshape(-1, 256).astype(np.float32)
    filled = np.maximum(hist.sum(1, keepdims=True), 1)
    seen = np.zeros((len(hist), 2048), bool)
    if len(data) > 3:
        d = data.astype(np.uint32)
        code = (d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24) * np.uint32(2654435761) >> np.uint32(21)
        inside = block[:-3] == block[3:]
        seen[block[:-3][inside], code[inside]] = True
    return np.concatenate([np.sqrt(hist / filled), seen.sum(1, keepdims=True, dtype=np.float32) / filled], 1), sizes


class Attention:
    """Gated attention over encoded passages; parameters in a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray] | None, share: float = 0.5):
        self.p, self.share = params, share

    @staticmethod
    def start(seed: int = 7) -> dict[str, np.ndarray]:
        rng = np.random.default_rng(seed)
        init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        return {"W": init(DIMS, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTEND), "U": init(HIDDEN, ATTEND), "w": init(ATTEND, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple:
        p = self.p
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (tv * su) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, 0)
        score = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return starts, h, tv, su, a, z, score

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(sizes), self.share)
        return self.forward(x, sizes)[-1].astype(float)

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        starts, h, tv, su, a, z, score = self.forward(x, sizes)
        ds = ((score - y) * weight / len(y)).astype(np.float32)
        dz = np.repeat(ds[:, None] * p["c"], sizes, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dsu = de[:, None] * p["w"] * su, de[:, None] * p["w"] * tv
        dv, du = dt * (1 - tv**2), dsu * su * (1 - su)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (tv * su).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Attention:
    if len(labels) == 0 or labels.min() == labels.max():
        return Attention(None, float(labels.mean()) if len(labels) else 0.5)
    model, rng = Attention(Attention.start(seed)), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            g = model.gradients(np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some]), labels[some], weight[some])
            step += 1
            for name, v in model.p.items():
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                s[name] = 0.999 * s[name] + 0.001 * g[name] ** 2
                v -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention:
    """docs: doc_id, text; labels: doc_id, quality, of rows that may be learned from."""
    chosen = sampled(labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")), "quality", sample)
    joined = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "doc_id")  # about 2 x sample rows

    def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, sizes = passages(batch["text"].tolist())
                parts = np.split((x * 65535).astype(np.uint16), np.cumsum(sizes)[:-1])
                yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "bag": [p.tobytes() for p in parts]})

    rows = joined.select("doc_id", "quality", "text").mapInPandas(histograms, "doc_id long, quality int, bag binary").toPandas()
    rows = rows.sort_values(["doc_id", "quality", "bag"])
    bags = [np.frombuffer(b, np.uint16).reshape(-1, DIMS).astype(np.float32) / 65535 for b in rows["bag"]]
    return train(bags, rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Attention, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.p, model.share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Attention(*shared.value)
        for batch in batches:
            texts, found, at, size = batch.column("text").to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= GROUP or i == len(texts) - 1:
                    found.append(m.scores(*passages(texts[at : i + 1])))
                    at, size = i + 1, 0
            scores = np.concatenate(found) if found else np.zeros(0)
            kept = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs, labels.where(~held))
    return score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
