"""Fill-in-middle and the Merkle manifest against plain Python, with odd rows and tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from test_small import corpus

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, idx long, g string, output string, proof string, root string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def odd_rows():
    r = random.Random(3)
    texts = [*corpus(2, 30), "  lead", "trail \n", " \t ", "<P> x", "a <S>b c", "x<M", "a<", "<P y S> z", "　ü \U0001f600 b\x85c\xa0d", "e\rf\x0bg\x0ch", "w" * 5000, "q " * 20_000]
    rows = [(i, t, r.choice(["en", "de", None, "ü", "Z", "z\u0000"]), r.choice(["s", None, "ß"]), r.choice([None, len(t or "")]), 1, 2, "g", "o", "p", "r") for i, t in enumerate(texts)]
    rows += [rows[7]] * 3 + [(None, "no id at all, but a text", None, None, None, *[None] * 6), (None, *[None] * 10), (-5, "below zero, and some words", "en", "s", 2**63 - 1, *[None] * 6)]
    return rows


def plain_forms(i, t):
    t = t or ""
    u = UNIT.findall(t)
    h = sha(f"42:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("events", [1 << 20, 3])
def test_fill_middle(spark, monkeypatch, events):
    from foliant.llm import fill_middle as f

    monkeypatch.setattr(f, "EVENTS", events)
    rows = odd_rows()
    automaton, rule = f.Rule().automaton(), f.Rule()
    assert [(i, *f.arranged(rule, automaton, i, t or "")) for i, t, *_ in rows] == [plain_forms(i, t) for i, t, *_ in rows]
    got = f.fill_middle(spark.createDataFrame(rows, SCHEMA).repartition(3)).withColumn("back", f.restored()).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain_forms(i, t) for i, t, *_ in rows), key=key)
    assert sorted(((r["doc_id"], r["back"]) for r in got), key=key) == sorted(((i, t or "") for i, t, *_ in rows), key=key)
    assert len({r["form"] for r in got}) == 3


def test_fill_middle_rules(spark):
    """Other sentinels, also ones that are patterns, and shares of none and all."""
    from foliant.llm import fill_middle as f

    rows = [(i, f"some words {i} and (.*) more of them") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for moved, first, forms in ((0, 50, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})):
        rule = f.Rule("|.", "|+", "|$", moved, first, "other")
        got = f.fill_middle(docs, rule).withColumn("back", f.restored(rule)).collect()
        assert {r["form"] for r in got} == forms and {(r["doc_id"], r["back"]) for r in got} == set(rows)


def up(level):
    return [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]


def siblings(level, i):
    """The digests beside node i and those above it, None where there is none, and on which side they stand; the last node."""
    out = []
    while len(level) > 1:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, bool(i & 1)))
        level, i = up(level), i // 2
    return out, level[0]


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(field, (r[0], r[3], r[2], r[4], r[1]))))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for v in by.values():
        v.sort(key=lambda x: x[:3])
    subroots = [siblings([x[2] for x in by[g]], 0)[1] for g in langs]
    for k, g in enumerate(langs):
        for i, (_, _, d, r) in enumerate(by[g]):
            low, root = siblings([x[2] for x in by[g]], i)
            high, total = siblings(subroots, k)
            yield r[0], d, root, total, tuple(low + high)


@pytest.mark.parametrize(("block", "layer", "broadcast"), [(10, 2, 20_000), (1, 1, 0), (2, 3, 20_000), (3, 2, 0)])
def test_merkle(spark, monkeypatch, block, layer, broadcast):
    """Every row's proof, with groups of several levels of blocks; each proof leads to the root."""
    from foliant.llm import merkle as m

    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "LAYER", layer)
    monkeypatch.setattr(m, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(m.walk, "__defaults__", (layer,))
    rows = odd_rows()
    if block == 1:  # blocks in closures keep their module's values, so the smallest ones go by plain functions below
        rows = rows[:40]
    made = m.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), carry=F.col("source"))
    got = made.withColumn("end", m.folded(F.col("leaf"), F.col("proof"))).collect()
    key = lambda r: tuple((x is not None, x) for x in r[:4]) + (str(r[4]),)
    flat = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((p["digest"], p["left"]) for p in r["proof"])) for r in got]
    assert sorted(flat, key=key) == sorted(plain_manifest(rows), key=key)
    assert all(r["end"] == r["root"] for r in got) and len({r["root"] for r in got}) == 1


@pytest.mark.parametrize("layer", [1, 2, 3, 4, 9])
def test_walk(layer):
    """Paths of every leaf of trees of every size up to 70, with few nodes kept at a time."""
    from foliant.llm import merkle as m

    for n in range(1, 70):
        leaves = [sha(str(i)) for i in range(n)]
        height = (n - 1).bit_length()
        paths = list(m.walk(leaves, height, layer))
        assert paths == [[d for d, _ in siblings(leaves, i)[0]] for i in range(n)]
        assert m.top(leaves, height) == siblings(leaves, 0)[1]
        # a block that is one of several has the full height, with nodes hashed alone up to its root
        node = siblings(leaves, 0)[1]
        for _ in range(2):
            node = sha(node)
        assert m.top(leaves, height + 2) == node and [p[-2:] for p in m.walk(leaves, height + 2, layer)] == [[None, None]] * n


def test_walk_keeps_few_nodes(monkeypatch):
    from foliant.llm import merkle as m

    trees = []

    class Counted(m.Growing):
        def __init__(self, *a):
            super().__init__(*a)
            trees.append(self)

    monkeypatch.setattr(m, "Growing", Counted)
    for _ in m.walk([str(i) for i in range(1 << 10)], 10, 2):
        pass
    # a layer's subtree has 2 + 4 nodes of its own, and waiting ones below; five layers have two such trees each
    assert max(len(t.kept) for t in trees) <= 6 and max(len(t.waiting) for t in trees) <= 10


def test_merkle_finds_changes(spark):
    """A changed row no longer leads to the root, an untouched one does; an empty table and a single row work."""
    from foliant.llm import merkle as m

    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    made = m.manifest(docs, carry=m.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.concat("text", F.lit("."))))
    got = made.select(m.folded(F.col("leaf"), F.col("proof")) == F.col("root"), m.folded(F.col("carried"), F.col("proof")) == F.col("root"), F.col("doc_id")).collect()
    with_text = {r[0] for r in rows if r[1] is not None}
    assert all(a for a, _, _ in got) and all(b is not True for _, b, i in got if i in with_text and i is not None)
    assert m.manifest(docs.limit(0)).collect() == []
    (one,) = m.manifest(spark.createDataFrame([rows[8]], SCHEMA)).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []
