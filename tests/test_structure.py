"""Sections and tables against a small model of the rules, and single cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators.structure import clean_native_tables, parse_structure

GRID = "array<array<array<string>>>"


def parsed(spark, text, native=None, ruled=None, source=None):
    df = spark.createDataFrame([(1, text, native, ruled, source)], f"doc_id int, text string, native_tables {GRID}, ruled_regions array<struct<bbox:array<int>,page:int,region_text:string,source:string>>, text_source string")
    s = parse_structure(df).first()["structure"]
    return [(x["title"], x["content"]) for x in s["sections"]], s["tables"]


def model(text, heuristic=True):
    """Plain rules, for comparison."""
    secs, tabs, title, body, open_, before = [], [], None, [], False, ""

    def close():
        if title is not None or body:
            secs.append((title or "General", "\n".join(body)))

    for raw in re.split("\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]", text or ""):
        s = raw.strip()
        if not s:
            before = ""
            continue
        if heuristic and ("|" in s or "\t" in s or "  " in s):
            parts = s.split("|") if "|" in s else s.split("\t") if "\t" in s else re.split(" {2,}", s)
            if not open_:
                tabs.append([])
            open_ = True
            tabs[-1].append([c.strip() for c in parts if c.strip()])
        else:
            open_ = False
            letters = [c for c in s if c.isalpha()]
            digit = any(c.isdigit() for c in s + before)
            if len(s) <= 80 and not digit and (s.endswith(":") or (letters and all(c.isupper() for c in letters))):
                close()
                title, body = s.rstrip(":"), []
            else:
                body.append(s)
        before = s
    close()
    return secs, tabs


def test_null_and_empty(spark):
    assert parsed(spark, None) == ([], []) == parsed(spark, "")


def test_headers(spark):
    assert parsed(spark, "NAME:\nAnn\n\nFINDINGS\nfine")[0] == [("NAME", "Ann"), ("FINDINGS", "fine")]
    assert parsed(spark, "Hb 11.4\nCOLORIMETRIC\nx")[0] == [("General", "Hb 11.4\nCOLORIMETRIC\nx")]
    assert parsed(spark, "Hb 11.4\n\nNote:\nx")[0] == [("General", "Hb 11.4"), ("Note", "x")]


def test_random_texts(spark):
    r = random.Random(3)
    pool = ["HEAD", "Head:", "x", "a  b", "a | b", "|", "t\tu", "5", "10³", "", "  ", " ", "ÄÖ", "ǅ", "अ", "٣ X", "A" * 80, "B" * 81, "::", "① Y"]
    texts = ["".join(r.choice(pool) + r.choice(["\n", "\r\n", "\x0b", "\x85", " ", "\n\n"]) for _ in range(r.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id int, text string")
    for row in parse_structure(df).collect():
        s = row["structure"]
        assert ([(x["title"], x["content"]) for x in s["sections"]], [x["rows"] for x in s["tables"]]) == model(texts[row["doc_id"]]), texts[row["doc_id"]]


def test_precedence(spark):
    grid, region = [[["a", None], ["b", "c"]]], [([1, 2, 3, 4], 0, "Name 1", "ruled_line_region")]
    text = "p | q\nHEAD\nbody"
    secs, tabs = parsed(spark, text, grid, region)
    assert [x["source"] for x in tabs] == ["native_pdf"] and tabs[0]["raw_lines"] == ["a | ", "b | c"] and secs[0] == ("General", "p | q")
    secs, tabs = parsed(spark, text, [], region)
    assert [(x["source"], x["rows"], x["region_text"], x["bbox"]) for x in tabs] == [("ruled_line_region", None, "Name 1", [1, 2, 3, 4])]
    assert parsed(spark, text, [[["one"]]])[1] == []  # rejected grids bring nothing back
    assert parsed(spark, text)[1][0]["rows"] == [["p", "q"]]
    assert parsed(spark, text, source="ocr")[1] == []


@pytest.mark.parametrize(("grid", "kept"), [([["a"], ["b"]], 0), ([["a", "b"]], 0), ([["a", "b"], ["c", "d"]], 1), ([["a", "b"], ["c"]], 0), ([], 0), ([["A\nB", ""], ["c", "d"]], 0), ([["A\nB", ""], ["Count", ""], ["c", "d"]], 1)])
def test_grids(spark, grid, kept):
    df = spark.createDataFrame([([grid],)], f"t {GRID}")
    assert df.select(F.size(clean_native_tables(F.col("t")))).first()[0] == kept


def test_digits_are_pythons(spark):
    # beyond the basic plane the two may know different versions of Unicode
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars if c.isdigit() or c.isnumeric()], "c string")
    got = {r[0] for r in df.where(t.has_digit(F.col("c"))).collect()}
    assert got == {c for c in chars if c.isdigit()}
