"""Mixture-controlled packing of token ids into sequences."""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, table, written
from .words import U, Words, words

#: Length of a sequence; the id after each document.
LENGTH, END = 4096, 2
#: Sources with a queue of their own; those beyond, by tokens, are the leaves of a
#: tree that divides one more queue.
QUEUES = 40
#: Sources of one task that builds a part of the tree, on average.
LEAVES = 4096
#: Documents that one running sum covers, on average, of all sources together.
RUN = 1024
#: Words whose ids a worker keeps between batches.
CACHE = 1 << 20
#: Stop and comma.
STOPS = [0x2E, 0x2C]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for the bytes 0 to 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i] .. first[i] + size[i] - 1 for every i, in a row."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


class Merges:
    """Byte-pair merges of many words at once: in every round each word applies its
    pair of lowest rank, wherever it occurs, from left to right."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        #: Ids of a byte inside a word, and as its last one.
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = pd.Index(np.array([vocab[x] << 32 | vocab[y] for x, y in pairs], np.int64))
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.none = len(pairs)

    def __call__(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each) of words given by their
        bytes in a row and their numbers of bytes, none of which is 0."""
        ids, word = self.inner[data], np.repeat(np.arange(len(size)), size)
        tail = np.cumsum(size) - 1
        ids[tail] = self.last[data[tail]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank = np.full(len(ids), self.none)
            inside = np.flatnonzero(word[:-1] == word[1:])
            at = self.pairs.get_indexer(ids[inside] << 32 | ids[inside + 1])
            rank[inside] = np.where(at >= 0, at, self.none)
            new = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, new), np.diff(new, append=len(ids)))
            over = least == self.none
            if over.any():
                done.append((word[over], ids[over]))
                word, ids, rank, least = word[~over], ids[~over], rank[~over], least[~over]
            hit = np.flatnonzero(rank == least)
            # Of overlapping places, every second one from the left.
            run = np.diff(hit, prepend=-2) != 1
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            ids, word = ids[stay], word[stay]
        word, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(size))


class WordEncoder:
    """Ids of whole texts from the ids of their words.

    The tokenizer never joins across space or 09-0D, so the ids of a text are
    those of its words in a row. Words of Latin-1 letters with a stop or comma at
    most, which normalisation leaves but for case and the tokenizer's pattern
    splits into just these two, go through Merges; the tokenizer encodes the
    others. Ids of up to CACHE words, by 64-bit hash, are kept between batches.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(file), Merges(file)
        self.forget()

    def forget(self) -> None:
        self.known, self.first, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)"""
        n = end - start
        b = data[ranges(start, n)]
        ends = np.cumsum(n)
        stop = np.isin(b[ends - 1], STOPS) & (n > 1)
        lead = b == 0xC3
        after = np.concatenate([[False], lead[:-1]])
        low = b | 0x20
        letter = (low >= 97) & (low <= 122) & (b < 128) | lead | after & (b != 0x97) & (b != 0xB7)
        letter[(ends - 1)[stop]] = True
        plain = np.logical_and.reduceat(letter, ends - n)
        # Latin-1 capitals are C3 80 to C3 9E, small ones 20 above.
        b = np.where((b >= 65) & (b <= 90) | after & (b >= 0x80) & (b <= 0x9E), b + 0x20, b).astype(np.uint8)
        # A plain word is one or two pieces for the merges: its letters and its stop.
        good, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        two = stop[good]
        piece = np.ones(len(good) + int(two.sum()), np.int64)
        at = np.arange(len(good)) + np.cumsum(two) - two
        piece[at] = n[good] - two
        flat, each = self.merges(b[np.repeat(plain, n)], piece)
        size = np.zeros(len(n), np.int64)
        size[good] = np.add.reduceat(each, at) if len(at) else 0
        raw = [data[s:e].tobytes().decode() for s, e in zip(start[odd].tolist(), end[odd].tolist())]
        rest = [x.ids for x in self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)]
        size[odd] = [len(x) for x in rest]
        out = np.zeros(int(size.sum()), np.uint32)
        first = np.cumsum(size) - size
        out[ranges(first[good], size[good])] = flat
        out[ranges(first[odd], size[odd])] = np.fromiter(itertools.chain.from_iterable(rest), np.uint32)
        return out, size

    def learn(self, w: Words, key: np.ndarray, at: np.ndarray) -> None:
        """Keep the ids of the words `at`, which have the hashes key."""
        flat, size = self.encode(w.data, w.start[at], w.end[at])
        order = np.argsort(key)
        first = np.cumsum(size) - size + len(self.flat)
        place = np.searchsorted(self.known, key[order])
        self.known = np.insert(self.known, place, key[order])
        self.first, self.size = np.insert(self.first, place, first[order]), np.insert(self.size, place, size[order])
        self.flat = np.concatenate([self.flat, flat])

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)"""
        w = words(col)
        if not len(w.hash):
            return np.zeros(0, np.uint32), np.zeros(len(col), np.int64)
        which, key = pd.factorize(w.hash)
        at = np.zeros(len(key), np.int64)
        at[which] = np.arange(len(which))
        if len(self.known) > CACHE:
            self.forget()
        place = np.searchsorted(self.known, key)
        new = np.ones(len(key), bool)
        old = np.flatnonzero(place < len(self.known))
        new[old] = self.known[place[old]] != key[old]
        if new.any():
            self.learn(w, key[new], at[new])
            place = np.searchsorted(self.known, key)
        first, size = self.first[place][which], self.size[place][which]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.flat[ranges(first, size)], total[w.first[1:]] - total[w.first[:-1]]


@functools.lru_cache(1)
def encoder(file: str) -> WordEncoder:
    """One a worker, so that tasks in turn use the words already known."""
    return WordEncoder(file)


def tokenized(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, source, n (ids with END), ids (little-endian unsigned 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file)
        for b in rows_of(batches, "text", 1 << 22):
            ids, size = encode(b.column("text"))
            off = np.concatenate([[0], np.cumsum(size)])
            full = np.insert(ids.astype("<u4"), off[1:], END).astype("<u4")
            out = off * 4 + np.arange(len(off)) * 4
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(out.astype(np.int64).tobytes()), pa.py_buffer(full.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(size + 1, pa.int64()), binary.cast(pa.binary())], ["doc_id", "source", "n", "ids"])

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return d.mapInArrow(run, "doc_id long, source string, n long, ids binary")


class Mixture:
    """Deficit round-robin in closed form.

    Queue q, of total[q] ids, has had floor(w * LENGTH * total[q] / sum) ids after
    w windows: its deficit, the fraction, is carried from window to window and,
    being a function of w, from partition to partition without any message. The
    largest queue takes up what the others' fractions leave of a window; where that
    is more than it has, after the last window, those of the largest fractions take
    one id more each.
    """

    def __init__(self, total: list[int]):
        """The largest queue must be the last one."""
        self.total = [int(t) for t in total]
        self.sum = sum(self.total)
        self.windows = self.sum // LENGTH
        # The last queue has sum / len(total) ids or more, so before the last window
        # it has LENGTH / len(total) left, more than the others' fractions.
        assert len(self.total) * len(self.total) <= LENGTH
        assert all(a <= b for a, b in zip(self.taken(self.windows), self.total))

    def taken(self, w: int) -> list[int]:
        """Ids of each queue in the first w windows (all of them after the last)."""
        if w > self.windows:
            return self.total
        got = [w * LENGTH * t // max(self.sum, 1) for t in self.total[:-1]]
        last = w * LENGTH - sum(got)
        if last > self.total[-1]:
            part = [w * LENGTH * t % self.sum for t in self.total[:-1]]
            for q in sorted(range(len(got)), key=lambda q: -part[q])[: last - self.total[-1]]:
                got[q] += 1
            last = self.total[-1]
        return [*got, last]

    def window_of(self, q: int, at: int) -> int:
        """The window that holds place `at` of queue q."""
        w = min(at * self.sum // (LENGTH * max(self.total[q], 1)), self.windows)
        while self.taken(w)[q] > at:
            w -= 1
        while self.taken(w + 1)[q] <= at:
            w += 1
        return w


def paths(weights: list[int]) -> list[list[int]]:
    """For each weight, its steps down a Huffman tree: the weight of the child, less
    than 0 for a right one. An inner node has two thirds of its parent at most, so
    rounding adds up to less than 3 ids on the way down, whatever the depth."""
    heap = [(w, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    for made in range(len(weights), 2 * len(weights) - 1):
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (made, a), (made, -b)
        heapq.heappush(heap, (a + b, made, made))
    out = []
    for node in range(len(weights)):
        path = []
        while node in up:
            node, step = up[node]
            path.append(step)
        out.append(path[::-1])
    return out


def divide(total: int, path: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(low, high, ids left of the leaf) of the leaf's ids when the root, of total ids,
    has its ids low to high. Of the first t ids of a node the left child has
    floor(t * left / node), so both children grow with t, one of them by one a step,
    and end at their totals: no id is lost and no deficit needs to be kept."""
    before = 0
    for step in path:
        left = step if step > 0 else total + step
        a, b = low * left // total, high * left // total
        if step > 0:
            low, high, total = a, b, step
        else:
            low, high, total, before = low - a, high - b, -step, before + b - a
    return low, high, before


def climb(total: int, path: list[int], at: int) -> int:
    """The place at the root of place `at` of the leaf."""
    for parent, step in reversed(list(zip([total, *map(abs, path)], path))):
        at = -(-(at + 1) * parent // step) - 1 if step > 0 else at * parent // -step
    return at


def tail_parts(n: int) -> list[tuple[int, int]]:
    """Powers of two, falling, that make up the ids after the last full window."""
    out, at = [], 0
    for b in range(n.bit_length() - 1, -1, -1):
        if n >> b & 1:
            out.append((at, 1 << b))
            at += 1 << b
    return out


def cut(q: int, at: int, n: int, mix: Mixture, path: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of the pieces of n ids that
    lie from place `at` on in queue q, or in the leaf at the end of path in it."""
    out, done = [], 0
    path = path or []
    w = mix.window_of(q, climb(mix.total[q], path, at))
    low = mix.taken(w)
    while done < n:
        high = mix.taken(w + 1)
        first, end, before = divide(mix.total[q], path, low[q], high[q])
        m = min(n - done, end - (at + done))
        if m > 0:
            offset = sum(high[:q]) - sum(low[:q]) + before + at + done - first
            if w < mix.windows:
                out.append((done, m, w, offset))
            else:
                for k, (lo, size) in enumerate(tail_parts(mix.sum - mix.windows * LENGTH)):
                    a, b = max(offset, lo), min(offset + m, lo + size)
                    if a < b:
                        out.append((done + a - offset, b - a, w + k, a - lo))
            done += m
        w, low = w + 1, high
    return out


def leaf_paths(totals: DataFrame, count: int) -> DataFrame:
    """source, path (steps down to it, see paths()) of each row of totals (source,
    ids), of which there are count. A driver's tree has groups of sources as leaves,
    one row for LEAVES sources; each group's task adds its own tree below."""
    groups = max(1, count // LEAVES)
    t = totals.select("source", "ids", F.pmod(F.xxhash64("source"), F.lit(groups)).alias("part"))
    sums = [tuple(r) for r in t.groupBy("part").agg(F.sum("ids")).orderBy("part").collect()]
    above = totals.sparkSession.sparkContext.broadcast(dict(zip([g for g, _ in sums], paths([n for _, n in sums]))))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ids", "source"])
        head = above.value[int(pdf["part"].iloc[0])]
        return pd.DataFrame({"source": pdf["source"], "path": [head + p for p in paths(pdf["ids"].tolist())]})

    return t.groupBy("part").applyInPandas(tree, "source string, path array<long>")


def pack(docs: DataFrame, file: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The windows of LENGTH ids have the sources in the proportion of the corpus: after
    every window each of the QUEUES largest is less than one id off its share (the
    largest queue: QUEUES ids), and each of the others, however many, less than 5
    ids off its share of what their common queue has had. Nothing is
    padded: the ids after the last full window form sequences of falling powers of
    two. Null texts are empty, and an empty document is its END id; null sources
    count as ''. Rows that repeat a doc_id or a text are packed each. Without rows
    there is no sequence.
    """
    file = file or tokenizer_file()
    t = written(tokenized(docs, file).withColumn("row", F.monotonically_increasing_id()))
    totals = t.groupBy("source").agg(F.sum("n").alias("ids"), F.count("*").alias("rows"))
    # At most QUEUES rows by source come to the driver, and one for the rest.
    totals = written(totals)
    top = [tuple(r) for r in totals.orderBy(F.desc("ids"), "source").limit(QUEUES).collect()]
    all_ids, all_rows = totals.agg(F.coalesce(F.sum("ids"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    rest = all_ids - sum(r[1] for r in top)
    # The largest queue, of a source or of the rest, is the last.
    size = [(r[1], r[0]) for r in top] + ([(rest, None)] if rest or not top else [])
    size.sort(key=lambda x: (x[0], x[1] or ""))
    names, other = {s: q for q, (_, s) in enumerate(size) if s is not None}, next((q for q, (_, s) in enumerate(size) if s is None), 0)
    mix = Mixture([n for n, _ in size])
    keys = ["queue", "source"] if rest else ["queue"]
    buckets = max(1, int(all_rows) // RUN)
    queue = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("source")], F.lit(other)) if names else F.lit(0)
    own = [F.when(queue == other, F.col("source")).otherwise("").alias("source")] if rest else []
    narrow = t.select("row", "n", queue.cast("int").alias("queue"), *own, F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket"))
    # Places in the queues, or in the sources of the common one: sums of buckets
    # first, then running sums inside a bucket.
    sums = narrow.groupBy(*keys, "bucket").agg(F.sum("n").alias("ids"), F.count("*").alias("rows"))
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "bucket", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("base"))
    path = F.lit(None).cast("array<long>").alias("path")
    if rest:
        # A source has at most one row a bucket here, however many documents it has.
        few = totals.where(~F.col("source").isin(list(names)))
        leaves = leaf_paths(few, few.count()).withColumnRenamed("source", "leaf")
        base = base.join(leaves, (base["queue"] == other) & (base["source"] == F.col("leaf")), "left").drop("leaf")
        path = F.col("path")
    inside = Window.partitionBy(*keys, "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, [*keys, "bucket"])
    placed = placed.select("row", "queue", path, (F.col("base") + F.col("before")).alias("at"))
    wide = t.select("row", "doc_id", "n", "ids").join(placed, "row").select("doc_id", "n", "ids", "queue", "at", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, "ids", 4 << 20):
            out = []
            for doc, n, ids, q, at, path in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "queue", "at", "path"))):
                for start, m, seq, off in cut(q, at, n, mix, path):
                    out.append((doc, start, m, zlib.crc32(ids[4 * start : 4 * (start + m)]), n, seq, off))
            cols = list(zip(*out)) or [()] * 7
            names_ = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names_)

    return wide.mapInArrow(run, PIECES)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
