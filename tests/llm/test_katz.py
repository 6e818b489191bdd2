"""Katz backoff against a plain dictionary model, its sums, and odd tables."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_small import WORD, corpus, frame


def column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


class Plain:
    """The model by dictionaries; None is an end, and UNKNOWN any word that training lacks."""

    MOST = 5

    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for t in texts:
            w = words(t)
            self.c1.update(w)
            self.c2.update(zip([None, *w[:-1]], w, strict=True))
        self.n = sum(self.c1.values())
        self.d1, self.d2 = self.discounts(self.c1), self.discounts(self.c2)
        self.left = 1 - sum(self.kept(self.d1, c) for c in self.c1.values()) / self.n
        self.scale = 1
        if self.left < 1e-12:
            self.left = 1 / (self.n + 1)
            self.scale = 1 - self.left
        self.after = {}
        for (h, w), c in self.c2.items():
            self.after.setdefault(h, []).append((w, c))

    def discounts(self, counts):
        n = Counter(counts.values())
        for k in range(self.MOST, 0, -1):
            if all(n[r] for r in range(1, k + 2)):
                a = (k + 1) * n[k + 1] / n[1]
                if a == 1:
                    continue
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, k + 1)}
                if all(0 < x < 1 for x in d.values()):
                    return d
        x = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return {r: 1 - x / r for r in range(1, self.MOST + 1)}

    def kept(self, d, c):
        return c * d.get(c, 1)

    def one(self, w):
        return self.scale * self.kept(self.d1, self.c1[w]) / self.n if w in self.c1 else self.left

    def two(self, h, w):
        if h not in self.c1:
            return self.one(w)
        n, kept = self.c1[h], sum(self.kept(self.d2, c) for _, c in self.after[h])
        if kept > n * (1 - 1e-12):
            n += 1
        if (h, w) in self.c2:
            return self.kept(self.d2, self.c2[h, w]) / n
        return (1 - kept / n) / (1 - sum(self.one(x) for x, _ in self.after[h])) * self.one(w)


def words(t):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check(rows, got):
    model = Plain([t for i, t in rows if not held(i)])
    v = len(model.c1)
    expected = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((model.c1[x] + 1) / (model.n + v + 1)) for x in w)
        score = sum(math.log10(model.two(h, x)) for h, x in zip([None, *w[:-1]], w, strict=True))
        expected.append((i, held(i), len(w), sum(x in model.c1 for x in w), model.n, base, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(expected)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6, rel=1e-9)
    return model


@pytest.mark.parametrize("chunk", [1 << 23, 700])
def test_katz(spark, chunk, monkeypatch):
    """With small chunks texts are cut, the tables have many parts, and frequent histories are dealt out."""
    from foliant.llm import katz

    texts = corpus(8, 40)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, texts[-3])]
    monkeypatch.setattr(katz, "CHUNK", chunk)
    got = katz.score_documents(frame(spark, texts, null_id=True), column(), chunk=chunk).collect()
    model = check(rows, got)
    everything = [*model.c1, "never seen"]
    for h in [None, "the", "zzz", next(w for w in model.c1 if w and model.c1[w] == 1)]:
        assert sum(model.two(h, w) for w in everything) == pytest.approx(1, abs=1e-9)


def test_sums_to_one(spark):
    """The operator's own probabilities of all words after a history add up to one."""
    from foliant.llm.katz import score_documents

    train = ["a b c a b d a", "b a b a c c d e", "e f a b", "a a a a a a a b b b b b b b"] * 3
    rows = [(i, t) for i, t in enumerate(train)]
    vocabulary = sorted({w for t in train for w in t.split()})
    for h in ("a", "b", "f"):
        # what differs between "h w" and "h" is the word's probability and how the text goes on
        asked = [(100 + k, f"{h} {w}") for k, w in enumerate([*vocabulary, "unseen"])] + [(99, h)]
        docs = spark.createDataFrame([*rows, *asked], "doc_id long, text string")
        got = {r["doc_id"]: r["score"] for r in score_documents(docs, F.col("doc_id") >= 99).collect()}
        model = Plain(train)
        start = model.two(None, h)
        total = sum(10 ** got[100 + k] / start / model.two(w, None) for k, w in enumerate([*vocabulary, "unseen"])) + 10 ** got[99] / start
        assert total == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("rows", [[], [(2, None)], [(2, ""), (2, "")], [(17, "only held out")], [(2, "x " * 50)], [(2, "a b"), (2, "a b"), (None, "a b")], [(2, "a b"), (17, "b c a")]])
def test_katz_of_tiny_tables(spark, rows):
    from foliant.llm.katz import score_documents

    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string"), column()).collect()
    if any(not held(i) for i, _ in rows):
        check(rows, got)
    else:
        assert [(r["score"], r["base_score"], r["train_tokens"]) for r in got] == [(0.0, 0.0, 0)] * len(rows)
