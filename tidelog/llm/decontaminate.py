"""Benchmark decontamination by winnowing (DataFrame and SQL functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table, written

#: Words of a window, and of a k-gram. A window holds RUN k-grams, the least of which
#: both sides select: no shared window can be missed.
WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits (a power of two) of the filter of the benchmark's fingerprints, which is part of
#: the plan and has this size whatever the benchmark; a full one lets all k-grams pass.
FILTER_BITS = 1 << 22
#: Bytes of the benchmark's windows up to which they are broadcast; more are shuffled.
BROADCAST_BYTES = 64 << 20


def word_array(text: Column) -> Column:
    """Words of a text with A-Z lowered; null and word-free texts give []."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: the optimizer can't copy it into
    the loops of body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(c: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(c, start, n), " ")


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _gram(h: Column, at: Column, n: int) -> Column:
    """Hash of the n words from place `at` (0: the first), from the words' hashes."""
    return F.xxhash64(F.lit(n), *[F.get(h, at + i) for i in range(n)])


def _places(size: Column, n: Column | int) -> Column:
    """The places 0 .. size - n of runs of n, none if there are fewer than n."""
    return F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))


def _grams(h: Column, n: int = GRAM) -> Column:
    return F.transform(_places(F.size(h), n), lambda i: _gram(h, i, n))


def _selected(g: Column, at: Column) -> Column:
    """Whether winnowing selects the k-gram: it is the least of a run that holds it."""
    low, high = F.greatest(at - (RUN - 1), F.lit(0)), F.least(at, F.size(g) - RUN)
    runs = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.exists(runs, lambda s: F.array_min(F.slice(g, s + 1, RUN)) == F.get(g, at))


def _marks(items: DataFrame) -> DataFrame:
    """The hashes to look for (h): the least k-grams of items of WINDOW words or more,
    the first k-gram of those from GRAM words on, all words of shorter ones."""
    h = items.select(_hashes(F.col("w")).alias("h"), F.size("w").alias("n"))
    long = _let(_grams(F.col("h")), lambda g: F.transform(_places(F.size(g), RUN), lambda s: F.array_min(F.slice(g, s + 1, RUN))))
    one = F.when(F.col("n") >= GRAM, _gram(F.col("h"), F.lit(0), GRAM))
    for k in range(1, GRAM):
        one = one.when(F.col("n") == k, _gram(F.col("h"), F.lit(0), k))
    return h.select(F.explode(F.when(F.col("n") >= WINDOW, long).otherwise(F.array(one))).alias("h")).distinct()


def _filter(marks: DataFrame) -> Callable[[Column], Column]:
    """A test of hashes that is true of all marks and of few others."""
    at = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = marks.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    held = [0] * (FILTER_BITS // 64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).collect():  # FILTER_BITS / 64 rows at most
        held[word] = bits
    bits = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")

    def test(h: Column) -> Column:
        place = h.bitwiseAND(F.lit(FILTER_BITS - 1))
        word = F.get(bits, F.shiftright(place, 6).cast("int"))
        # A shift by more than 63 counts modulo 64.
        return F.call_function("shiftright", word, place.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return test


def _to_check(w: Column, test: Callable[[Column], Column], lengths: list[int]) -> Column:
    """The windows of a document that may be an item's: structs of n (words), at (place)
    and window (text)."""
    # Lambdas of arrays take one parameter; a second would get the element's index.
    fits = lambda n: lambda i: i + n <= F.size(w)
    marked = lambda h, n: lambda i: test(_gram(h, i, n))

    def windows_at(places: Column, n: int) -> Column:
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("n"), i.cast("int").alias("at"), _joined(w, i + 1, n).alias("window")))

    short = [n for n in lengths if n < GRAM]
    middle = [n for n in lengths if GRAM <= n < WINDOW]

    def found(h: Column) -> Column:
        def of(g: Column) -> Column:
            def near(at: Column) -> Column:
                parts = [windows_at(F.filter(at, fits(n)), n) for n in middle]
                if WINDOW in lengths:
                    kept = F.filter(at, lambda i: _selected(g, i))
                    around = lambda i: F.sequence(F.greatest(i - (RUN - 1), F.lit(0)), F.least(i, F.size(w) - WINDOW))
                    starts = F.array_distinct(F.flatten(F.transform(kept, around)))
                    parts.append(windows_at(starts, WINDOW))
                return F.concat(*parts)

            places = F.filter(_places(F.size(h), GRAM), lambda i: test(F.get(g, i)))
            return _let(places, near)

        parts = [windows_at(F.filter(_places(F.size(h), n), marked(h, n)), n) for n in short]
        if middle or WINDOW in lengths:
            parts.append(_let(_grams(h), of))
        return F.concat(*parts)

    return _let(_hashes(w), found)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every row of docs with its benchmark overlap: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated.

    Both sides select winnowed 5-gram hashes. A document's k-grams are tested against a
    filter of the items' before anything leaves its row; those that pass and are
    selected are extended to all ten-word windows around them, which meet the items'
    windows in a join on the texts. A word is hit if it lies in any occurrence of a
    window. An item of one to nine words is one window, found by its first five words
    or, if shorter, by all of them, in the same pass. Items without words, and null
    texts, match nothing. Without any item all documents are clean (items_sha256 of the
    empty string). Repeated items with different ids count each, null ids not at all;
    rows that repeat a doc_id, or have none, are judged one by one. Other columns are
    ignored.
    """
    it = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    windows = it.select("item_id", size.alias("n"), F.explode(_places(F.size("w"), size)).alias("at"), "w")
    windows = windows.select("item_id", "n", _joined(F.col("w"), F.col("at") + 1, F.col("n")).alias("window"))
    texts = written(windows.groupBy(F.col("n").alias("of_n"), F.col("window").alias("of_window")).agg(F.collect_set("item_id").alias("ids")))
    got = texts.groupBy("of_n").agg(F.sum(F.octet_length("of_window") + 64 * F.size("ids") + 100)).collect()  # WINDOW rows at most
    lengths = sorted(r[0] for r in got)
    w = _let(word_array(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), (_to_check(w, _filter(_marks(it)), lengths) if lengths else F.lit(None).cast("array<struct<n:int,at:int,window:string>>")).alias("windows")))
    # Written once: the texts are read and cut into words a single time.
    judged = written(docs.select("doc_id", w.alias("x")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "x.n_words", "x.windows"))
    if sum(r[1] for r in got) <= BROADCAST_BYTES:
        texts = F.broadcast(texts)
    seen = judged.select("row", F.explode("windows").alias("x")).select("row", "x.*")
    hit = seen.join(texts, (F.col("n") == F.col("of_n")) & (F.col("window") == F.col("of_window")))
    # A document's own windows bound a group.
    found = hit.groupBy(F.col("row").alias("hit_row")).agg(F.collect_list(F.struct("at", "n")).alias("s"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    under = F.flatten(F.transform("s", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    found = found.select("hit_row", F.size(F.array_distinct(under)).cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("ids"), ","), 256).alias("items_sha256"))
    out = judged.select("row", "doc_id", "n_words").join(found, F.col("row") == F.col("hit_row"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op9_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x : x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, n, i, g FROM dw WHERE (n, g) IN (SELECT (n, g) FROM bw)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, item_id FROM hits JOIN bw USING (n, g)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
}
