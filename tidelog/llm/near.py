"""Near-duplicates: an LSH forest proposes families, full sets confirm links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, table, written
from .components import components
from .words import SEQ, Spans, U, mix, words

SHINGLE = 5
#: Sorted orders of the forest, and the minima of a label in an order, 16 bits each.
#: At depth 4 two sets of similarity 0.75 stay apart in all orders with a chance of
#: 5 in a million.
TREES, LABEL = 32, 6
#: Neighbours in an order are candidates from these common depths on: 3 where a
#: region of depth 3 has at most SPARSE sets, 4 in others, 5 or 6 where regions of
#: depth 4 or 5 have more than DENSE sets in one Arrow batch.
SPARSE, DENSE = 8, 4096
#: Sets that one task compares with each other; larger families go by blocks.
#: The same for the shingles of these sets (8 bytes each).
BLOCK, WEIGHT = 2000, 8_000_000
#: Bits (a power of two) of the filter of family members' ids that each task holds.
#: It has this size whatever the data are; with many more ids than bits it lets all
#: texts pass, and the join behind it decides alone.
FILTER_BITS = 1 << 26


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the sets in a row, sorted in each; first of each text): distinct
    five-word shingles, the whole sequence where there are fewer words."""
    w = words(col, lower=True)
    n = np.diff(w.first)
    spans = Spans(w.hash, SEQ[0])
    g = spans.grams(SHINGLE)
    at = np.flatnonzero(w.doc[: len(g)] == w.doc[SHINGLE - 1 :]) if len(g) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    doc = np.concatenate([w.doc[at], short])
    h = np.concatenate([g[at], spans.of(w.first[short], w.first[short + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _seeds() -> np.ndarray:
    return mix(np.arange(1, TREES * LABEL + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set), and the label of the set in
    each order: its first four minima in head, the others in tail (null: empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds()
        for b in rows_of(batches, "text"):
            h, first = shingle_sets(b.column("text"))
            n = np.diff(first)
            full = np.flatnonzero(n)
            keys: list = [None] * len(n)
            head = tail = np.zeros((0, TREES), np.int64)
            if len(full):
                at = first[full]
                with np.errstate(over="ignore"):
                    one, two = np.add.reduceat(mix(h ^ U(0xA5A5)), at), np.add.reduceat(mix(h ^ U(0x5A5A1)), at)
                    x = h ^ (h >> U(31))
                    # 16 bits of each minimum, spread by its order and depth.
                    m = np.stack([mix(np.minimum.reduceat(x * s, at) ^ s) >> U(48) for s in seeds]).reshape(TREES, LABEL, len(full))
                head = (m[:, 0] << U(48) | m[:, 1] << U(32) | m[:, 2] << U(16) | m[:, 3]).view(np.int64).T
                tail = (m[:, 4] << U(16) | m[:, 5]).astype(np.uint32).view(np.int32).T
                for j, i in enumerate(full):
                    keys[i] = one[j].tobytes() + two[j].tobytes()
            offsets = pa.array(np.concatenate([[0], np.cumsum(n > 0)]) * TREES, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).reshape(-1), t)) for x, t in ((head, pa.int64()), (tail, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *lists], ["doc_id", "n_shingles", "set_key", "head", "tail"])

    d = docs.select(F.col("doc_id").cast("long"), "text")
    return d.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, head array<long>, tail array<int>")


def neighbours(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For labels in sorted order, the place of the first label that each one is
    joined to (its own: none): the first of the run whose neighbours share prefixes
    of the region's depth or longer."""
    n = len(head)
    lcp = np.zeros(n, np.int8)  # minima shared with the label before
    apart = (head[1:] ^ head[:-1]).view(U)
    rest = (tail[1:] ^ tail[:-1]).view(np.uint32)
    for depth in range(1, 5):
        lcp[1:] += (apart >> U(64 - 16 * depth)) == 0
    lcp[1:] += (apart == 0) & (rest >> np.uint32(16) == 0)
    lcp[1:] += (apart == 0) & (rest == 0)

    def size(depth: int) -> np.ndarray:
        at = np.flatnonzero(lcp < depth)
        m = np.diff(at, append=n)
        return np.repeat(m, m)

    need = np.where(size(3) <= SPARSE, 3, 4)
    need = np.where(size(4) > DENSE, np.where(size(5) > DENSE, 6, 5), need)
    start = np.flatnonzero(lcp < need)
    return np.repeat(start, np.diff(start, append=n))


def candidate_edges(sets: DataFrame) -> DataFrame:
    """(a, b), a > b, of sets (id, head, tail): neighbours in a sorted order whose
    longest common prefix has the adaptive depth become connected, without pairs.

    All orders are dealt out by ranges of (label, id), so a hot region is cut like
    any other. A part joins the ids of each of its runs to the first of them; its two
    ends also leave marks, which join across parts at depth 4 (3, where few meet).
    """
    t = sets.select("id", F.explode(F.arrays_zip("head", "tail")).alias("x")).select("x.head", "x.tail", "id")
    t = t.repartitionByRange("head", "tail", "id").sortWithinPartitions("head", "tail", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row of a batch is carried to the next, so runs go on across batches.
        carry = first = None
        for b in batches:
            if not b.num_rows:
                continue
            c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            first = first or [x[:1] for x in c]
            if carry is not None:
                c = [np.concatenate([p, x]) for p, x in zip(carry, c)]
            carry = [x[-1:] for x in c]
            to = neighbours(c[0], c[1].astype(np.int32))
            u, v = c[2], c[2][to]
            new = u != v
            pair = np.unique(np.stack([np.maximum(u, v)[new], np.minimum(u, v)[new]]), axis=1)
            yield edges_of(pair[0], pair[1], None)
        if first is not None:
            ids, heads = (np.concatenate([first[i], carry[i]]) for i in (2, 0))
            yield edges_of(ids, ids, heads)

    def edges_of(a, b, head) -> pa.RecordBatch:
        marks = pa.nulls(len(a), pa.int64()) if head is None else pa.array(head, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), marks], ["a", "b", "head"])

    got = written(t.mapInArrow(run, "a long, b long, head long"))
    # Two marks a part: a narrow table, whatever the data are.
    marks = got.where("head is not null").select("a", "head", F.shiftright("head", 16).alias("top"))
    deep, top = Window.partitionBy("head"), Window.partitionBy("top")
    marks = marks.select("a", F.min("a").over(deep).alias("deep"), F.when(F.count("*").over(top) <= SPARSE, F.min("a").over(top)).alias("shallow"))
    met = marks.select("a", F.explode(F.array("deep", "shallow")).alias("b")).where("a > b")
    return got.where("head is null").select("a", "b").unionByName(met)


def linked(sizes: np.ndarray, sets: list[np.ndarray], left: int | None = None) -> np.ndarray:
    """For each set the number of the first set of its component under links (with
    left: only those between the first left sets and the others); a link: 100 *
    common >= 75 * union.

    Sets come in rising size. A set is compared with those of other components
    alone, up to the size that can link, so copies of one text cost one pass. Linked
    sets share one of the rarest shingles of each, a quarter of the set and one more;
    others that don't are left out, where that saves work.
    """
    m = len(sets)
    root = np.arange(m)
    if m < 2:
        return root
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    doc = np.repeat(np.arange(m), sizes)
    rare = rank[ids][np.lexsort((rank[ids], doc))]
    short = sizes - -(-75 * sizes // 100) + 1
    head = np.arange(len(rare)) - np.repeat(first[:-1], sizes) < np.repeat(short, sizes)
    order = np.argsort(rare[head], kind="stable")
    posts = doc[head][order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(rare[head], minlength=len(count)))])
    mark = np.zeros(len(count), bool)
    for i in range(m if left is None else left):
        lo = i + 1 if left is None else left
        low = np.searchsorted(sizes[lo:], -(-75 * sizes[i] // 100)) + lo
        high = np.searchsorted(sizes[lo:], 100 * sizes[i] // 75, side="right") + lo
        if low >= high:
            continue
        own = rare[first[i] : first[i] + short[i]]
        found = begin[own + 1] - begin[own]
        if found.sum() < first[high] - first[low]:
            off = np.cumsum(found) - found
            near = posts[np.arange(int(found.sum())) + np.repeat(begin[own] - off, found)]
            todo = np.unique(near[(near >= low) & (near < high)])
            todo = todo[root[todo] != root[i]]
        else:
            todo = low + np.flatnonzero(root[low:high] != root[i])
        if not len(todo):
            continue
        own = ids[first[i] : first[i + 1]]
        mark[own] = True
        n = sizes[todo]
        if 2 * len(todo) > high - low:  # most of them: no need to pick them out
            common = np.add.reduceat(mark[ids[first[low] : first[high]]], first[low:high] - first[low], dtype=np.int32)[todo - low]
        else:
            off = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(first[todo] - off, n)
            common = np.add.reduceat(mark[ids[at]], off, dtype=np.int32)
        mark[own] = False
        for j in todo[100 * common >= 75 * (sizes[i] + n - common)]:
            a, b = sorted((root[i], root[j]))
            if a != b:
                root[root == b] = a
    return root


def _place(c: str) -> F.Column:
    """The bit of an id in the filter."""
    return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of all ids set; at most FILTER_BITS / 64 numbers come
    to the driver."""
    at = ids.select(_place("id").alias("at"))
    word = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    got = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, U)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(U)
    return out


def true_links(docs: DataFrame, families: DataFrame) -> DataFrame:
    """(a, b) links that connect what is connected within families (id, family, n):
    stars around the least id, final where the family is one task's.

    A family of at most BLOCK sets and WEIGHT shingles is one task's. A larger one
    is dealt to blocks by size class (steps of 4/3: linked sets are at most one
    class apart) and a hash; each pair of blocks that can hold a link is one
    task's. Places are settled on narrow rows. Texts aren't shuffled: each task that
    reads them makes the sets of ids that pass a filter of fixed size, and these meet
    their places in a join.
    """
    c = F.floor(F.log(F.greatest("n", F.lit(1))) / F.log(F.lit(4 / 3))).cast("int")
    f = families.select("id", "family", "n", c.alias("c"))
    blocks = F.ceil(F.greatest(F.col("m") / (BLOCK // 2), F.col("w") / (WEIGHT // 2))).cast("int")
    near = f.groupBy("family", "c").agg(F.count("*").alias("m"), F.sum("n").alias("w")).withColumn("own", blocks)
    # A family has a row for each class of size here, some dozens at most.
    own, order = Window.partitionBy("family"), Window.partitionBy("family").orderBy("c")
    beside = lambda x, step: F.when(x(F.col("c")).over(order) == F.col("c") + step, x(F.col("own")).over(order)).otherwise(0)
    small = (F.sum("m").over(own) <= BLOCK) & (F.sum("w").over(own) <= WEIGHT)
    plan = near.select(F.col("family").alias("of"), F.col("c").alias("class"), "own", small.alias("small"), beside(F.lead, 1).alias("up"), beside(F.lag, -1).alias("down"))
    rows = f.join(written(plan), (F.col("family") == F.col("of")) & (F.col("c") == F.col("class")))
    zero = F.lit(0)
    r = F.pmod(F.xxhash64("id"), F.col("own")).cast("int")
    place = lambda c1, r1, c2, r2, side: F.struct(c1.alias("c1"), r1.alias("r1"), c2.alias("c2"), r2.alias("r2"), F.lit(side).alias("side"))
    c, seq = F.col("c"), lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    mine = F.transform(seq(F.col("own")), lambda s: F.when(s < r, place(c, s, c, r, 1)).otherwise(place(c, r, c, s, 0)))
    up = F.when(F.col("up") > 0, F.transform(seq(F.col("up")), lambda s: place(c, r, c + 1, s, 0))).otherwise(F.slice(mine, 1, 0))
    down = F.when(F.col("down") > 0, F.transform(seq(F.col("down")), lambda s: place(c - 1, s, c, r, 1))).otherwise(F.slice(mine, 1, 0))
    whole = F.array(place(F.lit(-1), zero, F.lit(-1), zero, 0))
    placed = written(rows.select("id", "family", F.when(F.col("small"), whole).otherwise(F.concat(mine, up, down)).alias("places")))
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(placed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.column("place").to_numpy(zero_copy_only=False).astype(np.int64)
            maybe = bits.value[at >> 6] >> (at & 63).astype(U) & U(1) > 0
            for b in rows_of(iter([whole.filter(pa.array(maybe))]), "text"):
                h, first = shingle_sets(b.column("text"))
                out = [h[first[i] : first[i + 1]].tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "s"])

    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _place("doc_id").alias("place"), "text")
    # The same join at every size: a broadcast of few places would hide its shuffle.
    sets = d.mapInArrow(run, "doc_id long, n long, s binary").join(placed.hint("merge"), F.col("doc_id") == F.col("id"))
    keys = ["family", "c1", "r1", "c2", "r2"]
    rows = sets.select("id", "family", "n", "s", F.explode("places").alias("p")).select("id", "family", "n", "s", "p.*")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        same = key[1:3] == key[3:5]
        frame = frame.sort_values(["side", "n", "id"])
        root = linked(frame.n.to_numpy(), [np.frombuffer(x, U) for x in frame.s], None if same else int((frame.side == 0).sum()))
        out = pd.DataFrame({"a": frame.id.to_numpy(), "root": root})
        out["b"] = out.groupby("root")["a"].transform("min")
        return out.loc[out.a != out.b, ["a", "b"]].astype("int64")

    return rows.groupBy(*keys).applyInPandas(compare, "a long, b long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, n_shingles, component_id, kept.

    Equal sets are one candidate, the smallest doc_id of them. Documents without
    words, and null texts, have an empty set, are linked with nothing and stay.
    Rows that share a doc_id are one document with several texts; rows without one
    are linked with nothing, have the component of an equal set, if there is one, and
    stay. Other columns are ignored. Sets are compared by 64-bit hashes of
    shingles, over whole texts; candidates come from the forest, and within a
    family that it connects every pair that sizes allow is decided on full sets.
    """
    sig = written(signatures(docs))
    # The candidate of each distinct set: its smallest doc_id, with the set's labels.
    first = F.min(F.struct("doc_id", "n_shingles", "head", "tail"))
    reps = written(sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(first.alias("x")).select(F.col("set_key").alias("key"), F.col("x.doc_id").alias("id"), F.col("x.n_shingles").alias("n"), "x.head", "x.tail"))
    family = components(candidate_edges(reps.select("id", "head", "tail"))).withColumnRenamed("id", "member")
    families = written(reps.select("id", "n").join(family, F.col("id") == F.col("member")).select("id", F.col("component_id").alias("family"), "n"))
    found = components(true_links(docs, families)).select(F.col("id").alias("known"), "component_id")
    reps = written(reps.select("key", "id").join(found, F.col("id") == F.col("known"), "left").select("key", F.coalesce("component_id", "id").alias("least")))
    out = sig.join(reps, F.col("set_key") == F.col("key"), "left")
    comp = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op8_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)"""
}
