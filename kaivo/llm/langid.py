"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

A text's subwords are its 3- and 4-byte grams over letters (ASCII lower-cased, other ASCII as single blanks). Each hashes to
an embedding; their mean goes through a linear layer. Both are trained by stochastic gradient descent in numpy on a bounded
sample. As the layer is linear, embedding and layer are multiplied out once, so that a prediction averages a few numbers per gram.
A temperature fitted on documents held back from training calibrates the scores; the rejection threshold follows from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kaivo.llm.scratch import bounded
from kaivo.llm.texts import Texts, slices, sums_by

#: Bound of the training sample: so many labelled documents, one window of so many characters of each.
SAMPLE, WINDOW = 3000, 1500
BUCKETS, SIZE = 1 << 16, 16
EPOCHS, BATCH, RATE = 6, 32, 20.0
#: Share of rightly recognised calibration documents that may be rejected; scores from CERTAIN on never are.
LOSS, CERTAIN = 0.002, 0.5
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' subwords, one text after the other, and how many each has."""
    spaced = np.insert(_FOLD[t.data], np.append(t.off[:-1], [len(t.data)] * 3), 32)
    keep = np.concatenate([[True], (spaced[1:] != 32) | (spaced[:-1] != 32)])
    starts = t.off[:-1] + np.arange(t.n)
    keep[starts] = True  # each text keeps its leading blank
    new = np.concatenate([[0], np.cumsum(keep)])
    s = spaced[keep].astype(np.uint32)
    off = np.append(new[starts], new[len(t.data) + t.n])
    row = np.repeat(np.arange(t.n), np.diff(off))
    n = len(row)
    s = np.concatenate([s, np.full(4, 32, dtype=np.uint32)])
    three = s[:n] | s[1 : n + 1] << np.uint32(8) | s[2 : n + 2] << np.uint32(16)
    four = three | s[3 : n + 3] << np.uint32(24)
    left = np.append(off[1:], 0)[row] - np.arange(n) if n else np.zeros(0, dtype=np.int64)  # bytes to the text's end; one blank follows it
    out = []
    for x, size, salt in ((three, 3, 0x9E3779B1), (four, 4, 0x85EBCA77)):
        h = x * np.uint32(salt)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        out.append((h & np.uint32(BUCKETS - 1), left + 1 >= size))
    used = np.stack([out[0][1], out[1][1]], axis=1)
    both = np.stack([out[0][0], out[1][0]], axis=1)[used]
    return both.astype(np.int64), np.bincount(row, weights=used.sum(axis=1), minlength=t.n).astype(np.int64) if n else np.zeros(t.n, dtype=np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (languages, BUCKETS): embedding times layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, t: Texts) -> np.ndarray:
        ids, counts = grams(t)
        return np.stack([sums_by(row[ids].astype(np.float64), counts) for row in self.table], axis=1) / np.maximum(counts, 1)[:, None] + self.bias

    def scores(self, t: Texts) -> np.ndarray:
        z = self.logits(t) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _texts(texts: list[str]) -> Texts:
    raw = [t.encode() for t in texts]
    return Texts(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """A model of the languages in ``langs``; None without any. A fifth of the documents calibrate it."""
    languages = sorted(set(langs))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in langs])
    n, k = len(texts), len(languages)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    held, own = (order[: n // 5], order[n // 5 :]) if n >= 50 else (order, order)
    emb = rng.normal(0, 0.1, (BUCKETS, SIZE))
    layer, bias = np.zeros((SIZE, k)), np.zeros(k)
    rows, counts = [], np.zeros(n, dtype=np.int64)
    for at in range(0, n, 100):  # in portions, for the driver's memory
        ids, some = grams(_texts(texts[at : at + 100]))
        counts[at : at + 100] = some
        for e, c in zip(np.cumsum(some), some, strict=True):
            seen, times = np.unique(ids[e - c : e], return_counts=True)
            rows.append((seen.astype(np.int32), times.astype(np.float32)))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(own), BATCH):
            some = [d for d in own[at : at + BATCH] if counts[d]]
            if not some:
                continue
            sizes = np.array([len(rows[d][0]) for d in some])
            grs = np.concatenate([rows[d][0] for d in some])
            share = np.concatenate([rows[d][1] / counts[d] for d in some])
            start = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(emb[grs] * share[:, None], start)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ layer.T
            layer -= rate * mean.T @ p
            bias -= 0.05 * rate * p.sum(axis=0)
            np.subtract.at(emb, grs, rate * share[:, None] * np.repeat(back, sizes, axis=0))
        rng.shuffle(own)
    model = Model(languages, np.ascontiguousarray((emb @ layer).T.astype(np.float32)), bias)
    z = np.concatenate([model.logits(_texts([texts[d] for d in held[at : at + 100]])) for at in range(0, len(held), 100)])
    right = y[held]

    def loss(temperature: float) -> float:
        x = z / temperature
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(held)), right]).mean())

    model.temperature = min((float(x) for x in np.geomspace(0.05, 20, 61)), key=loss)
    x = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    x /= x.sum(axis=1, keepdims=True)
    good = x.max(axis=1)[x.argmax(axis=1) == right]
    model.threshold = min(CERTAIN, float(np.quantile(good, LOSS))) if len(good) else 0.0
    return model


def sampled(docs: DataFrame, sample: int = SAMPLE, window: int = WINDOW) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from: at most ``sample`` rows (smallest hash of doc_id), one window of ``window`` characters each.

    Only rows with text and lang whose crc32(doc_id as text) mod 4 isn't 2.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where("crc32(cast(doc_id as string)) % 4 <> 2").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
    # first by a hash threshold, so that tasks send no more than the sample in all, however many they are
    share = min(1.0, 1.3 * (sample + 50) / max(rows.select("doc_id", "lang").count(), 1))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    start = F.expr(f"1 + pmod(xxhash64(doc_id, 5), greatest(1, length(text) - {window}))").cast("int")
    got = rows.select("doc_id", "lang", F.substring("text", start, F.lit(window)).alias("text")).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id", "lang", "text").limit(sample).collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    return train(*sampled(docs, sample))


def _judged(model: Model | None, t: Texts, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language (its number; the one after the last: unknown), score and whether it is rejected, of each text."""
    unknown = len(model.languages) if model else 0
    if model is None:
        return np.zeros(t.n, dtype=np.int64), np.zeros(t.n), np.ones(t.n, dtype=bool)
    p = model.scores(t)
    best = np.where(letters, p.argmax(axis=1), unknown)
    score = np.where(letters, p.max(axis=1), 0.0).round(9)  # the last bits depend on what else is in the batch
    return best, score, (score < model.threshold) | (best == unknown)


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of ``docs`` (doc_id, text), from its whole text.

    lang_pred: a language of the model, ``und`` (score 0, rejected) for a text that is null or has no letter. Without a model (no
    labelled text to learn from) all are ``und``. score: the calibrated probability. rejected: score below the model's threshold.
    Repeated rows give repeated rows; an empty table none; other columns are ignored.
    """
    names = [*(model.languages if model else []), UNKNOWN]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * BUCKETS * 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in slices(batches):
            best, score, rejected = _judged(shared.value, t, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[k] for k in best], pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    text = F.col("text").cast("string")
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _letters(text).alias("letters"), text.alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language isn't rejected: each by its own text, whatever its doc_id. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in slices(batches):
            rejected = _judged(shared.value, t, batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool))[2]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).filter(pa.array(~rejected))

    names = docs.columns
    work = bounded(docs).toDF(*(f"c{k}" for k in range(len(names))))  # names that can't clash with others here
    text = F.col(f"c{names.index('text')}").cast("string")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in work.schema.fields)
    return work.select(*work.columns, _letters(text).alias("letters"), text.alias("text")).mapInArrow(run, schema).toDF(*names)
