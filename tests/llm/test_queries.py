"""The queries on the smallest tables, and the pipeline stage by stage."""

import os

import pytest

from compare import of_duck, of_spark

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_queries(spark, duck):
    from foliant.llm import queries as q

    made = q.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in made) == list(range(1, 14))
    for name, sql in q.oracle_sql().items():
        assert of_spark(made[name](spark, SMALL)) == of_duck(duck, sql), name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for i, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, before, SMALL)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        kept, had = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (out, before))
        assert kept <= had and kept, name
        if i < len(c.STAGES) - 1:
            assert out.columns == docs.columns
        before = out
    assert {r["doc_id"] for r in c.run(spark, SMALL).select("doc_id").collect()} == kept


def odd_corpus():
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, leaks, junk, null and repeated ids, repeated rows, empty texts."""
    import random

    from test_small import base_words

    r = random.Random(31)
    rows = []
    for i in range(150):
        w = base_words(r, r.randint(60, 200))
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            w[7] = "zzz"
            rows.append((1000 + i, " ".join(w)))
    texts = [t for _, t in rows]
    rows += [(None, texts[3]), (None, " ".join(base_words(r, 90))), (5, texts[5]), (5, " ".join(base_words(r, 80))), (None, "one"), (7, "two words"), (None, None), (2000, None), (2001, "")]
    rows += [(3000, texts[9]), (3001, " ".join(base_words(r, 100))), (3001, None)]
    rows += [rows[-2]] * 2
    rows += [(4000 + i, " ".join(w + "&&&$$$" for w in base_words(r, 100))) for i in range(4)]
    rows += [(None, " ".join(w + "&&&###" for w in base_words(r, 100)))]
    items = [" ".join(base_words(r, 30)) + ". " + " ".join(base_words(r, 4)) + "." for _ in range(5)]
    rows += [(i, " ".join(base_words(r, 60)) + " " + items[k] + " " + " ".join(base_words(r, 60))) for k, i in enumerate([5000, 5001, None, 5003, 5003])]
    rows += [(6000, " ".join(base_words(r, 70)) + " mail ann.lee@mail.org or +1 743 555 3824 now")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], items


def test_pipeline_brute_force(spark, tmp_path):
    """Each stage's rows, on what the one before kept, against plain Python."""
    from collections import Counter

    import corpus_pipeline as c
    import public_tokenizers as p
    import tiktoken
    from test_small import roots, shingles

    from foliant.llm import quality_rules as q
    from foliant.llm.byte_bpe import load_ranks
    from foliant.llm.pii_crf import find, masked, trained
    from foliant.llm.scratch import Scratch

    rows, items = odd_corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = lambda rows: spark.createDataFrame(rows, schema).repartition(3)
    run = lambda stage, rows: [tuple(r) for r in stage(spark, frame(rows), str(tmp_path)).collect()]

    # quality: the verdict of each distinct text, judged among the same rows under ids of their own
    own = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], schema)
    kept = {x["doc_id"] for x in q.judged(own, Scratch(spark, "own")).where("kept").collect()}
    good = run(c.quality, rows)
    assert Counter(good) == Counter(r for k, r in enumerate(rows) if k in kept)
    assert not any(t is None or len(t.split()) < 50 or "&&&" in t for _, t, *_ in good) and any(i is None for i, *_ in good)

    # near duplicates, of the rows before quality too, with texts of few words and repeated rows
    for some in (rows, good):
        root = roots([shingles(r[1], 5) for r in some], lambda a, b: 10 * a >= 8 * b)
        counts = Counter(r[0] for r in some)
        out = run(c.near_duplicates, some)
        left = Counter(out)
        for g in set(root):
            members = [some[k] for k in range(len(some)) if root[k] == g]
            plain = [m for m in members if m[0] is not None and counts[m[0]] == 1]
            if plain:
                assert left[min(plain)] == 1
                left[min(plain)] -= 1
            else:
                taken = next(m for m in members if left[m] > 0)
                left[taken] -= 1
        assert not +left
    # decontamination: the planted rows and no other
    clean = run(c.decontaminated, out)
    assert Counter(clean) == Counter(r for r in out if not any(item in (r[1] or "") for item in items)) and len(out) - len(clean) == 5
    hidden = run(c.private, clean)
    assert Counter((r[0], r[1]) for r in hidden) == Counter((i, t and masked(t, find(t, trained())[1])) for i, t, *_ in clean)
    assert any("[EMAIL]" in (r[1] or "") and "[PHONE]" in r[1] for r in hidden) and all(r[4] == len(r[1]) for r in hidden if r[1] is not None)
    tokens = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=load_ranks(p.path("byte_bpe_50k.tiktoken")), special_tokens={})
    final = run(c.encoded, [*hidden, rows[-1], (None, None, None, None, None), (None, "", None, None, None)])
    expected = Counter((i, tuple(tokens.encode_ordinary(t or ""))) for i, t, *_ in [*hidden, rows[-1], (None, None), (None, "")])
    assert Counter((r[0], tuple(r[4])) for r in final) == expected


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_odd_rows(spark, empty):
    """Nulls in every column and repeated rows: quality leaves none of them; the other stages keep what the docstrings say."""
    import corpus_pipeline as c

    rows = [] if empty else [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "a b", None, None, None), (3, "a b", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    expected = {"quality_rules": 0, "ngram_jaccard": len(rows) - (not empty), "decontamination": len(rows), "pii": len(rows), "byte_bpe": len(rows)}
    for name, stage in c.STAGES:
        assert stage(spark, docs, SMALL).count() == expected[name], name


def test_pipeline_clashing_columns(spark):
    """Extra columns keep their values in every stage but the last, also under names that a stage could want for itself."""
    import corpus_pipeline as c

    names = ["_row", "_ID", "_id_", "_n", "_w", "n", "kept", "component_id", "item_id", "lcs", "a.b", "spans", "ids", "row", "rep", "g", "s", "key", "_c0"]
    rows, _ = odd_corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    marked = [(*r, *(f"{n}{k}" for n in names)) for k, r in enumerate(rows)]
    of = {r[5]: r for r in marked}
    docs = spark.createDataFrame(marked, schema)
    for name, stage in c.STAGES:
        out = stage(spark, docs, SMALL)
        got = out.collect()
        assert got, name
        if name != "byte_bpe":
            assert out.columns == docs.columns
            for r in map(tuple, got):
                whole = of[r[5]]
                assert r[5:] == whole[5:] and r[0] == whole[0] and (name == "pii" or r == whole)
