"""Registered queries against their SQL, and the pipeline stage by stage."""

import html
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in cur.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect()) == want


def test_html_pages(spark):
    """op6 on the driver's pages against plain patterns for how these pages are made: the
    article's blocks, without tags, in order."""
    block = re.compile(r"</?(?:h[1-6]|p|div|li|ul|ol|table|tr|td|th|blockquote|pre|section|article)\b[^>]*>", re.I)
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.QUERIES["op6_html_text"](spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        inner = re.split(r"</article>|<footer", re.split(r"<article[^>]*>", page.html, maxsplit=1)[1])[0]
        inner = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inner, flags=re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in block.split(inner)]
        want = "\n".join(x for x in parts if x)
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), page.url), i


def test_toxicity_table(spark):
    """op7's scores against plain code over the same weights, and on the held-out fold."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = toxicity.fit(docs, labels)
    again, same = toxicity.fit(docs.repartition(3), labels)
    assert bias == same and (weights == again).all()
    got = {r.doc_id: r for r in queries.QUERIES["op7_toxicity"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    mask = 0xFFFFFFFF
    for r in rows[:60]:
        total = n = 0
        for word in re.split(rb"[\x20\x09-\x0D]+", (r.text or "").encode()):
            b = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in word) + b" "
            for k in toxicity.GRAMS:
                for i in range(len(b) - k + 1) if word else ():
                    h = b[i]
                    for c in b[i + 1 : i + k]:
                        h = h * 0x01000193 + c * 0x85EBCA6B & mask
                    h ^= k * 0x9E3779B1 & mask
                    h = (h ^ h >> 15) * 0x2C1B3C6D & mask
                    total, n = total + weights[(h ^ h >> 13) % toxicity.BUCKETS], n + 1
        want = 1 / (1 + np.exp(-np.clip(total / max(n, 1) + bias, -60, 60)))
        assert abs(got[r.doc_id].score - want) < 1e-4 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = sorted((r.score, truth[i]) for i, r in got.items() if r.held_out and truth.get(i) is not None)
    ranks = [k for k, (_, y) in enumerate(held) if y]
    assert ranks and (sum(ranks) - len(ranks) * (len(ranks) - 1) / 2) / (len(ranks) * (len(held) - len(ranks))) > 0.75


def test_pipeline_odd_rows(spark):
    """Null and repeated doc_ids, null texts and clashing columns pass the stages."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    # Rows without a doc_id that are clean stay; equal ones are one document of its own.
    odd = base.where("doc_id < 3").withColumn("text", F.lit("nobody wrote this one before")).withColumn("doc_id", F.lit(None).cast("long")).unionByName(base.where("doc_id in (4, 4)"))
    blank = base.where("doc_id = 5").withColumn("doc_id", F.lit(900).cast("long")).withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    docs = base.unionByName(odd).unionByName(blank).withColumn("kept_id", F.lit(1)).withColumn("row", F.lit("x")).withColumn("n", F.lit(2))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.where("doc_id is null").count() in (1, 3), name
        docs = out
    assert 0 < docs.count() < n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select(F.countDistinct("doc_id")).first()[0] == docs.count()
