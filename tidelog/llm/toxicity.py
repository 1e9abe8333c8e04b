"""Toxicity: a bag of subword embeddings averaged into a linear softmax."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table
from .words import LOWERED, SEPARATOR

#: Hash buckets of the subword table, embedding size and byte lengths of n-grams.
BUCKETS, DIM, GRAMS = 1 << 17, 8, (4, 5, 6)
#: Bound of the training sample: labelled rows of either class, in the order of a
#: hash of doc_id, the bytes of one text of it (longer ones are not drawn) and those
#: of all its texts of a class.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TOTAL = (3600, 1200), 20_000, 16 << 20
EPOCHS, BATCH, RATE, SEED = 12, 64, 1.0, 7
THRESHOLD = 0.3
HELD_OUT = 2


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every subword: byte n-grams of the words with one
    mark at either end, A-Z in lower case."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" " * max(GRAMS), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    sep = SEPARATOR[data]
    byte = np.where(sep, np.uint8(32), LOWERED[data]).astype(np.uint32)
    n = len(doc)
    found, of = [], []
    h = byte.copy()
    inner = np.zeros(len(data), bool)  # a separator strictly inside the n-gram
    for k in range(2, max(GRAMS) + 1):
        with np.errstate(over="ignore"):
            h = h[: len(data) - k + 1] * np.uint32(0x01000193) + byte[k - 1 :] * np.uint32(0x85EBCA6B)
        if k > 2:
            inner = inner[: len(data) - k + 1] | sep[k - 2 : len(data) - 1]
        else:
            inner = inner[: len(data) - 1]
        if k in GRAMS:
            at = np.flatnonzero(~inner[:n])
            with np.errstate(over="ignore"):
                x = h[at] ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                found.append((x ^ (x >> np.uint32(13))) % np.uint32(BUCKETS))
            of.append(doc[at])
    return np.concatenate(found), np.concatenate(of)


def train(texts: list[bytes], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): embeddings and softmax are trained together by
    AdaGrad; for scoring their product is one number a bucket. One class only, or
    no rows: all zero, with a bias that favours that class."""
    n = len(texts)
    if n == 0 or toxic.min() == toxic.max():
        return np.zeros(BUCKETS), 0.0 if n == 0 else (4.0 if toxic[0] else -4.0)
    rng = np.random.default_rng(SEED)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 1.0, (DIM, 2)), np.zeros(2)
    ge, gw, gb = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    target, order = np.eye(2)[toxic.astype(int)], rng.permutation(n)
    # Batches are made up once: their subwords, each one's place among them, its share
    # of its text (the average's weight) and the first of each text.
    batches = []
    for lo in range(0, n, BATCH):
        bags = [(i, *np.unique(subwords([texts[i]])[0], return_counts=True)) for i in order[lo : lo + BATCH]]
        bags = [x for x in bags if len(x[1])]
        if bags:
            size = np.array([len(x[1]) for x in bags])
            unique, inverse = np.unique(np.concatenate([x[1] for x in bags]), return_inverse=True)
            share = np.concatenate([x[2] / x[2].sum() for x in bags]).astype(np.float32)
            batches.append((np.array([x[0] for x in bags]), size, unique, inverse.astype(np.int32), share))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            rows, size, unique, inverse, share = batches[k]
            x = np.add.reduceat(e[unique][inverse] * share[:, None], np.cumsum(size) - size)
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[rows]) / len(rows)
            dw, db = x.T @ d, d.sum(0)
            pull = np.repeat(d @ w.T, size, axis=0) * share[:, None]
            de = np.stack([np.bincount(inverse, pull[:, j], len(unique)) for j in range(DIM)], 1)
            ge[unique] += (de**2).mean(1)
            e[unique] -= RATE * de / np.sqrt(ge[unique])[:, None]
            gw += dw**2
            w -= RATE * dw / np.sqrt(gw)
            gb += db**2
            b -= RATE * db / np.sqrt(gb)
    return e @ (w[:, 1] - w[:, 0]), float(b[1] - b[0])


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled rows outside the held-out fold, in
    one task; the driver gets the score of each bucket and the bias."""
    lab = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(F.col("doc_id").alias("of"), "toxic")
    share = {r[0]: r[1] for r in lab.groupBy("toxic").count().collect()}
    # A share of the ids by their hash, twice the bound in expectation, since some
    # have no text of the size; so the sample is the same however rows are dealt.
    place = F.pmod(F.xxhash64("of"), F.lit(1 << 40))
    few = [(F.col("toxic") == k) & (place < int(min(1.0, 2 * SAMPLE_ROWS[k] / n) * (1 << 40))) for k, n in share.items()]
    if not few:
        return np.zeros(BUCKETS, np.float32), 0.0
    ids = lab.where(few[0] | few[-1]).select("of", "toxic", place.alias("place"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = d.join(F.broadcast(ids), F.col("doc_id") == F.col("of")).select("place", "doc_id", F.col("toxic").cast("int").alias("toxic"), "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic, drawn, size = [], [], [0, 0], [0, 0]
        for batch in batches:
            for k, t in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                if drawn[k] < SAMPLE_ROWS[k] and size[k] + len(t) <= SAMPLE_TOTAL:
                    texts.append(t)
                    toxic.append(k)
                    drawn[k], size[k] = drawn[k] + 1, size[k] + len(t)
        weights, bias = train(texts, np.array(toxic))
        if all(drawn):
            # The sample's classes aren't in the labels' proportion; the bias makes up for it.
            bias += math.log(share[1] / share[0]) - math.log(drawn[1] / drawn[0])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])

    sample = rows.repartition(1).sortWithinPartitions("place", "doc_id", "text")
    found = sample.mapInArrow(learn, "weights binary, bias double").collect()
    return (np.frombuffer(found[0][0], np.float32), found[0][1]) if found else (np.zeros(BUCKETS, np.float32), 0.0)


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs (doc_id, text) with a score from 0 to 1; null and empty texts get that
    of the bias alone. Every byte of every text is read, in chunks."""
    weights, bias = model
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for b in batches:
            scores = []
            for part in rows_of(iter([b]), "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                ids, of = subwords(texts)
                total = np.bincount(of, minlength=len(texts))
                z = np.bincount(of, s[ids], len(texts)) / np.maximum(total, 1) + bias
                scores.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
            if scores:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(scores), pa.float64())], ["doc_id", "score"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, held_out, score, predicted (score >= THRESHOLD).

    Only texts are scored; labels serve training alone, a document with several
    labels counts as toxic if one says so, and other label values are ignored.
    Without any label all scores are 0.5.
    """
    out = score_texts(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
