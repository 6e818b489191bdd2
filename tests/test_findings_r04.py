"""Findings of round 4: each test fails on the code that the finding was about."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from foliant.operators import structure, wordgrids

WORD = "struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["native_tables_structured", "native_word_grids"])
def test_grids_without_shuffle(spark, small, name):
    """words, grids and lines stay in their document's row, so nothing is shuffled and no table is written in between."""
    shown = plan(e.queries()[name](spark, small))
    assert "Exchange" not in shown and "foliant-tables" not in shown and shown.count("documents.parquet") == 1


def placed(r, n):
    """Words of n pages, which stand apart; some have no box, no text or no page."""
    words = []
    for p in [*range(n - 1), None] if n else []:
        y = 0.0
        for _ in range(r.randint(1, 6)):
            y += r.choice([12, 12, 12, 60])
            for c in range(r.choice([1, 2, 3, 3, 3])):
                words += [(p, c * 100.0 + k * 24, y, c * 100.0 + k * 24 + 20, y + 10, r.choice(["a", "bb", "é", "z", " ", None])) for k in range(r.choice([1, 1, 2]))]
        if r.random() < 0.1:
            words.append((p, None, 1.0, 2.0, 3.0, "x"))
    r.shuffle(words)
    return words


def test_document_grids(spark):
    """grids of words in their documents' rows are those of the same words as rows that stand anywhere."""
    r = random.Random(4)
    docs = [(i, f"text {i}", None if i % 9 == 4 else placed(r, i % 4)) for i in range(60)]
    df = spark.createDataFrame(docs, f"doc_id int, `a text` string, w array<{WORD}>")
    got = wordgrids.document_grids(df.repartition(3), F.col("w"), keep=["doc_id", "a text"]).collect()
    assert sorted(map(str, wordgrids.document_grids(df, F.col("w")).drop("w").collect())) == sorted(map(str, got))
    words = df.select("doc_id", F.inline("w"))
    want = {}
    for x in wordgrids.word_grids(words).collect():
        want.setdefault(x["doc_id"], []).append((x["page"], x["table_no"], x["rows"]))
    key = lambda g: (g[0] is not None, g[0] or 0, g[1])
    assert {x["doc_id"]: [tuple(g) for g in x["grids"]] for x in got if x["grids"]} == {d: sorted(g, key=key) for d, g in want.items()} and len(want) > 20
    assert sorted((x["doc_id"], x["a text"]) for x in got) == [(i, t) for i, t, _ in docs]


def test_documents_over_batches(monkeypatch):
    """a document whose words come in several batches is one, however they are cut."""
    r = random.Random(5)
    rows = []
    for d in range(12):
        words = placed(r, d % 5) or [(None,) * 6]
        rows += [(d if i == 0 else None, i == 0, *w) for i, w in enumerate(words)]
    names = ["doc_id", "_first", "_page", "_x0", "_y0", "_x1", "_y1", "_text"]
    types = [pa.int64(), pa.bool_(), pa.int64(), *[pa.float64()] * 4, pa.string()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(size, chunk):
        monkeypatch.setattr(wordgrids, "CHUNK", chunk)
        batches = [whole.slice(i, size) for i in range(0, len(rows), size)]
        return [x for b in wordgrids._of_documents(1)(batches) for x in b.to_pylist()]

    sort = lambda out: [(x["doc_id"], sorted(map(repr, x["grids"]))) for x in out]
    want = sort(run(len(rows), 10**9))
    assert [d for d, _ in want] == list(range(12)) and sum(len(g) for _, g in want) > 5
    assert all(sort(run(size, chunk)) == want for size in (1, 2, 7, 50) for chunk in (1, 9, 40))
    assert list(wordgrids._of_documents(1)([])) == []


def test_structure_without_shuffle(spark):
    """parse_structure keeps lines in their row; rows with a null or repeated id are documents of their own."""
    docs = spark.createDataFrame([(1, "A:\nx"), (1, "p | q\ny\nr  s"), (None, "B:\nz"), (2, None)], "doc_id int, text string")
    made = structure.parse_structure(docs)
    assert "Exchange" not in plan(made)
    found = [(x["doc_id"], [tuple(s) for s in x["structure"]["sections"]], [(t["raw_lines"], t["rows"]) for t in x["structure"]["tables"]]) for x in made.collect()]
    assert found == [(1, [("A", "x")], []), (1, [("General", "y")], [(["p | q"], [["p", "q"]]), (["r  s"], [["r", "s"]])]), (None, [("B", "z")], []), (2, [], [])]
