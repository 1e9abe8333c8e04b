"""Substring deduplication by relative Lempel-Ziv parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_left_join, passing, rows_of, table, written
from .words import SEQ, Spans, U, mix, sliding, words

#: Words of a window; anchors are GRAM-word hashes that are least among RUN
#: neighbours. RUN + GRAM - 1 = WINDOW: equal windows have an anchor in common.
WINDOW, GRAM = 50, 16
RUN = WINDOW - GRAM + 1
#: Stands for the end of a document of any length.
END = 2**31 - 1
#: Bits of the filter of ids with shared anchors, whose size is the same at all sizes of
#: the data; texts that it lets pass are shuffled to their ranges, the others are not.
FILTER_BITS = 1 << 25


def anchors_of(h: np.ndarray, doc: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """(places of the anchors of all texts, k-gram hashes)"""
    g = spans.grams(GRAM)
    if len(g) < RUN:
        return np.zeros(0, np.int64), g
    least = sliding(g, RUN, np.minimum).copy()
    least[doc[: len(least)] != doc[WINDOW - 1 :][: len(least)]] = 0  # not one text
    pad = np.zeros(RUN - 1, U)
    most = sliding(np.concatenate([pad, least, pad]), RUN, np.maximum)
    return np.flatnonzero((most == g) & (most > 0)), g


def covered(ranges: list[dict], n: int) -> np.ndarray:
    """Which of n places lie in any range s to e (exclusive, clipped to n)."""
    step = np.zeros(n + 1, np.int32)
    if ranges:
        s, e = (np.array([x[k] for x in ranges]) for k in ("s", "e"))
        np.add.at(step, np.minimum(s, n), 1)
        np.add.at(step, np.clip(e, np.minimum(s, n), n), -1)
    return np.cumsum(step[:n]) > 0


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, key, at (place), anchor, block: the hash of all words from this anchor to
    the end of the next one of the document (at its last: to the document's end),
    head: at the first, the hash of all words up to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, "text"):
            w = words(b.column("text"))
            spans = Spans(w.hash, SEQ[0])
            p, g = anchors_of(w.hash, w.doc, spans)
            if not len(p):
                continue
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            doc = w.doc[p]
            last = np.append(doc[1:] != doc[:-1], True)
            first = np.insert(last[:-1], 0, True)
            other = Spans(w.hash, SEQ[1])
            block = other.of(p, np.where(last, w.first[doc + 1], np.append(p[1:], 0) + GRAM))
            block[last] = mix(block[last])
            head = other.of(w.first[doc], p + GRAM)
            keys = b.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc], pa.int64()), pa.array(keys[doc], pa.int64()), pa.array((p - w.first[doc]).astype(np.int32)), pa.array(g[p].view(np.int64)), pa.array(block.view(np.int64)), pa.array(head.view(np.int64), mask=~first)], ["doc_id", "key", "at", "anchor", "block", "head"])

    return docs.mapInArrow(run, "doc_id long, key long, at int, anchor long, block long, head long")


def factors(at: np.ndarray, source: np.ndarray, source_at: np.ndarray, same: np.ndarray, head: np.ndarray, own: int) -> tuple[list, list, list]:
    """Greedy parse: (copies, open, need). A copy is a maximal word range (s, e) of
    WINDOW words or more that one earlier document holds verbatim, as blocks that
    go on there where they go on here; e is END where it reaches the document's
    end. The windows that hold an anchor of an earlier document and lie in no copy
    start in the ranges open; each holds an anchor whose number is in need."""
    out, open_, need, i = [], [], [], 0
    back = WINDOW - GRAM
    while i < len(at):
        j = i
        if source[i] < own:
            while j + 1 < len(at) and same[j] and source[j + 1] == source[i] and source_at[j + 1] - source_at[j] == at[j + 1] - at[j]:
                j += 1
            # The last block of a document is the same only where it also ends there.
            tail = bool(same[j]) and j + 1 == len(at)
            s, e = 0 if head[i] else int(at[i]), END if tail else int(at[j]) + GRAM
            if e - s >= WINDOW:
                out.append((s, e))
                if not head[i]:
                    open_.append((max(s - back, 0), s))
                    need.append(i)
                if not tail:
                    open_.append((e - WINDOW + 1, int(at[j]) + 1))
                    need.append(j)
            else:
                open_ += [(max(int(x) - back, 0), int(x) + 1) for x in at[i : j + 1]]
                need += range(i, j + 1)
        i = j + 1
    return out, open_, need


def parsed(hits: DataFrame) -> DataFrame:
    """hit_id, hit_key, copies, open, need (anchors), own (anchors that begin here, with
    their places) of every document with shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for own, key, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = {k: found.values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "source", "source_at", "same", "head", "anchor")}
                copies, open_, need = factors(x["at"], x["source"], x["source_at"], x["same"], x["head"], own)
                mine = x["source"] == own
                rows.append((own, key, copies, open_, np.unique(x["anchor"][need]).tolist(), list(zip(x["at"][mine].tolist(), x["anchor"][mine].tolist()))))
            pair = lambda y, z, t: pa.list_(pa.struct([(y, pa.int32()), (z, t)]))
            kinds = [pa.int64(), pa.int64(), pair("s", "e", pa.int32()), pair("s", "e", pa.int32()), pa.list_(pa.int64()), pair("at", "anchor", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] if k in (0, 1, 4) else [dict(zip([f.name for f in t.value_type], v)) for v in r[k]] for r in rows], t) for k, t in enumerate(kinds)], ["hit_id", "hit_key", "copies", "open", "need", "own"])

    return hits.mapInArrow(run, "hit_id long, hit_key long, copies array<struct<s:int,e:int>>, open array<struct<s:int,e:int>>, need array<long>, own array<struct<at:int,anchor:long>>")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, n_words, n_removed, kept_sha256.

    The index holds the anchors of all documents with their earliest place (by
    doc_id). Each document is parsed greedily into factors against it; a factor of
    WINDOW words or more is a copy. Windows that hold an anchor of an earlier
    document and lie in no such factor, those at factor boundaries, are then looked
    up one by one by 128-bit hashes among such windows of all documents and, of the
    documents where their anchors begin, the windows around these anchors; the
    earliest document that has a window never has it inside a factor, so none is
    missed. Where the ids concerned are few by count they go to the texts, and only
    texts with shared anchors are shuffled.
    Texts meet their ranges in the same joins at every size; a filter of fixed size
    keeps those without shared anchors out of the shuffle.
    Null and word-free texts keep nothing (hash of ''). Documents of fewer than
    WINDOW words lose nothing. Rows that share a doc_id are judged each against the
    documents with smaller ones; rows without one lose nothing and are no source. Other
    columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("key", F.xxhash64("text"))
    a = written(anchors(d.where("doc_id is not null")))
    place = F.struct("doc_id", "at", "block", "head")
    index = a.groupBy("anchor").agg(F.min(place).alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("size"))
    index = index.where(F.col("last") > F.col("source.doc_id")).select("anchor", "size", F.col("source.doc_id").alias("source"), F.col("source.at").alias("source_at"), F.col("source.block").alias("source_block"), F.col("source.head").alias("source_head"))
    hits = hot_left_join(a, index, ["anchor"], "size", "doc_id", "inner")
    equal = lambda c: F.coalesce(F.col(c) == F.col(f"source_{c}"), F.lit(False)).alias("same" if c == "block" else c)
    hits = hits.select("doc_id", "key", F.struct("at", "source", "source_at", equal("block"), equal("head"), "anchor").alias("x"))
    # Rows that repeat a doc_id and text have the same anchors, which count once.
    hits = hits.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("x")).alias("anchors"))
    p = written(parsed(hits))

    need = p.select(F.explode("need").alias("need")).distinct()
    own = p.select(F.col("hit_id").alias("own_id"), F.col("hit_key").alias("own_key"), F.explode("own").alias("x")).select("own_id", "own_key", "x.at", "x.anchor")
    own = own.join(need, F.col("anchor") == F.col("need"), "left_semi").groupBy("own_id", "own_key").agg(F.collect_set("at").alias("around"))
    ranges = p.join(own, (F.col("hit_id") == F.col("own_id")) & (F.col("hit_key") == F.col("own_key")), "left").where("size(open) > 0 or around is not null")
    near = lambda x: F.struct(F.greatest(x - (WINDOW - GRAM), F.lit(0)).alias("s"), (x + 1).alias("e"))
    ranges = written(ranges.select("hit_id", "hit_key", "copies", F.concat("open", F.transform(F.coalesce("around", F.array().cast("array<int>")), near)).alias("open")))
    of = lambda id_, key: (F.col("doc_id") == F.col(id_)) & (F.col("key") == F.col(key))
    texts = passing(d, "doc_id", ranges.select("hit_id"), FILTER_BITS).where("maybe")
    texts = texts.join(ranges.hint("merge"), of("hit_id", "hit_key")).select("doc_id", "key", "text", "copies", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, "text"):
            w = words(b.column("text"))
            one, two = (Spans(w.hash, s).grams(WINDOW) for s in SEQ)
            got = []
            for i, (own, key, copies, open_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "copies", "open")))):
                n = int(w.first[i + 1] - w.first[i])
                if n < WINDOW:
                    continue
                wanted = covered(open_, n)[: n - WINDOW + 1]
                for x in copies:
                    wanted[x["s"] : max(min(x["e"], n) - WINDOW + 1, 0)] = False
                start = np.flatnonzero(wanted)
                got.append((own, key, start, w.first[i] + start))
            if got:
                every = np.concatenate([x[3] for x in got])
                ids, keys = (pa.array(np.repeat([x[k] for x in got], [len(x[2]) for x in got]), pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(np.concatenate([x[2] for x in got]).astype(np.int32)), pa.array(one[every].view(np.int64)), pa.array(two[every].view(np.int64))], ["doc_id", "key", "start", "h1", "h2"])

    windows = written(texts.mapInArrow(run, "doc_id long, key long, start int, h1 long, h2 long"))
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("size")).where("last > first").drop("last")
    dup = hot_left_join(windows, first, ["h1", "h2"], "size", "doc_id", "inner").where(F.col("first") < F.col("doc_id"))
    dup = dup.groupBy(F.col("doc_id").alias("dup_id"), F.col("key").alias("dup_key")).agg(F.collect_set(F.struct(F.col("start").alias("s"), (F.col("start") + WINDOW).alias("e"))).alias("more"))
    marks = p.join(dup, (F.col("hit_id") == F.col("dup_id")) & (F.col("hit_key") == F.col("dup_key")), "left")
    marks = marks.select(F.col("hit_id").alias("mark_id"), F.col("hit_key").alias("mark_key"), F.concat("copies", F.coalesce("more", F.slice("copies", 1, 0))).alias("gone"))
    marks = written(marks.where("size(gone) > 0"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, "text"):
            out = []
            for own, text, gone in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("gone").to_pylist()):
                w = text.split()
                n = len(w)
                if gone:
                    w = [w[k] for k in np.flatnonzero(~covered([x for x in gone if min(x["e"], n) - x["s"] >= WINDOW], n))]
                out.append((own, n, n - len(w), hashlib.sha256(b" ".join(w)).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    final = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    d = passing(d, "doc_id", marks.select("mark_id"), FILTER_BITS)
    marked = d.where("maybe").join(marks.hint("merge"), of("mark_id", "mark_key"), "left").select("doc_id", "text", "gone")
    rest = d.where("not maybe").select("doc_id", "text", F.lit(None).cast("array<struct<s:int,e:int>>").alias("gone"))
    return marked.mapInArrow(remove, final).unionByName(rest.mapInArrow(remove, final))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM g GROUP BY h),
x AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (h) WHERE m < doc_id)),
r AS (SELECT doc_id, list(p) AS ps FROM x GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ps), 0) AS c, list_filter(w, lambda t, i : ps IS NULL OR NOT list_contains(ps, i)) AS keep FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n AS n_words, c AS n_removed, sha256(array_to_string(keep, ' ')) AS kept_sha256 FROM k"""
}
