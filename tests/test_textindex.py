"""The written text index against searches of all documents: pages, pruning, headlines, updates, compaction, the stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import search
from foliant.operators.textindex import TextIndex, keep_up

SCHEMA = "doc_id long, text string, created_at timestamp, source string"


def rows(n, seed=1):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "Übung", "x1", "rare"]
    out = []
    for i in range(n):
        some = r.choices(words, [9, 6, 4, 3, 8, 8, 2, 2, 0.05], k=r.choice([0, 1, 5, 30, 120]))
        if r.random() < 0.03:
            some += ["alpha"] * 40 + ["beta"] * 30
        out.append((i, r.choice([" ", ", ", "\n"]).join(some) if i % 17 else None, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=r.randint(0, 50)), f"s{i % 3}"))
    return out


QUERIES = ["alpha", "alpha beta", "the GAMMA, delta", "übung x1", "rare", "rare alpha", "the of", "absent", "absent alpha"]


def same(index, docs, queries=QUERIES, pages=((20, 0), (5, 7), (100, 0))):
    for q in queries:
        for limit, offset in pages:
            got = index.search(q, limit, offset).select("doc_id", "rank").collect()
            assert got == search.search(docs, q, limit, offset, stemmed=index.stemmed).select("doc_id", "rank").collect(), (q, limit, offset)


def test_pages_and_pruning(spark, tmp_path):
    docs = spark.createDataFrame(rows(3000), SCHEMA).repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    index = TextIndex(spark, str(tmp_path / "index"))
    index.add(docs, 0)
    same(index, docs)
    # the blocks that can reach a page of five are few of those that hold the terms
    for terms in (["alpha"], ["alpha", "beta"]):
        held, read = index.bounds(terms).count(), index.reachable(terms, 5).count()
        assert held > 20 and read < held / 2, (terms, held, read)
    # only the folders of the terms are read, and the bounds need no entries
    plan = index.bounds(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "entries" not in plan
    with pytest.raises(ValueError):
        index.search("", 1, 0)


def test_stemmed(spark, tmp_path):
    texts = ["running runs", "He ran; a runner", "happy filings of possibly", "Happily filed", None, "", "the"]
    docs = spark.createDataFrame([(i, t, datetime.datetime(2024, 1, 1), "s") for i, t in enumerate(texts)], SCHEMA)
    index = TextIndex(spark, str(tmp_path / "index"), stemmed=True)
    index.add(docs, 0)
    same(index, docs, ["run", "happy file", "possible", "running"], [(20, 0)])
    shown = index.headlines(index.search("runs"), "runs").collect()
    assert [r["snippet"] for r in shown] == ["<b>running</b> <b>runs</b>"]


def plain_headline(text, term):
    import re

    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    hit = [text[a:b].lower() == term for a, b in spans]
    lo = max((i for i in range(len(hit)) if hit[i]), key=lambda i: (sum(hit[i : i + 35]), -i))
    hi = max(i for i in range(lo, min(lo + 35, len(hit))) if hit[i]) + 1
    while hi - lo < 15 and (lo > 0 or hi < len(spans)):
        lo, hi = max(0, lo - 1), min(len(spans), hi + 1)
    hi = min(hi, lo + 35)
    out, at = [], spans[lo][0]
    for i in range(lo, hi):
        a, b = spans[i]
        out.append(text[at:a] + (f"<b>{text[a:b]}</b>" if hit[i] else text[a:b]))
        at = b
    return "".join(out)


def test_headlines(spark, tmp_path):
    r = random.Random(4)
    texts = [" ".join(r.choices(["pad", "Hit", "near,", "(x)", "the"], [20, r.choice([1, 3]), 4, 2, 3], k=r.choice([1, 3, 14, 16, 40, 300]))) for _ in range(60)] + ["hit", "a hit", "... hit!"]
    docs = spark.createDataFrame([(i, t, datetime.datetime(2024, 1, 1), "s") for i, t in enumerate(texts)], SCHEMA)
    index = TextIndex(spark, str(tmp_path / "index"))
    index.add(docs, 0)
    got = {x["doc_id"]: x["snippet"] for x in index.headlines(index.search("hit", 100), "hit").collect()}
    assert got == {i: plain_headline(t, "hit") for i, t in enumerate(texts) if "hit" in t.lower()} and len(got) > 20


def test_updates(spark, tmp_path):
    """Generations of changes and deletions, repeated ones, and what compaction makes of them, equal a rebuild."""
    first, later = rows(600), rows(600, 2)
    index = TextIndex(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(first, SCHEMA), 0)
    state = {r[0]: r for r in first}
    r = random.Random(7)
    for g in (1, 2, 3):
        some = [later[i] if r.random() < 0.7 else (i, None, later[i][2], "s") for i in r.sample(range(600), 90)] + [(1000 + g, "alpha beta new", datetime.datetime(2025, 1, g), "s")]
        state |= {x[0]: x for x in some}
        for _ in range(2):  # the second time as a batch that is repeated after a failure
            index.add(spark.createDataFrame(some, SCHEMA), g)
    docs = spark.createDataFrame(list(state.values()), SCHEMA)
    some = ["alpha beta", "rare", "the gamma"]
    same(index, docs, some, [(20, 0), (100, 0)])
    rebuilt = TextIndex(spark, str(tmp_path / "again"))
    rebuilt.add(docs, 0)
    whole = index.compact(4)
    flat = lambda x: sorted((r["lexeme"], r["e"]["doc_id"], r["e"]["tf"], tuple(r["e"]["places"])) for r in x.postings().select("lexeme", F.explode("entries").alias("e")).collect())
    assert flat(whole) == flat(rebuilt) and whole.generations() == [4]
    same(whole, docs, some, [(20, 0)])
    # a compacted index takes further generations
    whole.add(spark.createDataFrame([(1001, None, None, None)], SCHEMA), 5)
    same(whole, docs.where("doc_id <> 1001"), ["new"], [(20, 0)])


def test_stream(spark, tmp_path):
    """Updates that arrive as files, several of one document in a batch, give what a rebuild gives."""
    schema = "doc_id long, seq long, text string, created_at timestamp, source string"
    index, state, seq = TextIndex(spark, str(tmp_path / "index")), {}, 0
    r = random.Random(5)
    for batch in range(2):
        some = []
        for x in r.choices(rows(200, batch), k=150):
            seq += 1
            some.append((x[0], seq, x[1], *x[2:]))
            state[x[0]] = x
        spark.createDataFrame(some, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        keep_up(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), index, str(tmp_path / "check")).awaitTermination()
    assert index.generations() == [1, 2]
    same(index, spark.createDataFrame(list(state.values()), SCHEMA), ["alpha", "beta gamma"], [(50, 0)])
