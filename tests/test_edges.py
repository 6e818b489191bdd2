"""Rows with edge cases that the tables lack: the same rules as the catalogue's queries, against DuckDB on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from compare import of_duck, of_spark
from foliant.functions.text import EDGES
from foliant.operators import evaluation, export, search, state, structure
from foliant.plans.catalog import CELLS, _cells, lines_sql, literal, values
from foliant.sources import files

CASES = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


#: Texts with every branch that the tables lack.
EDGE_TEXTS = [
    (1, "NAME:\nJohn Smith\n\nRESULTS\nAll normal"), (2, "PANEL\nTest  Value\nHb  14\n\nWBC  7\nafter"), (3, "A | B | C\n1 || 3"), (4, "just some prose\nmore prose"),
    (5, "::\nbody"), (6, "VALUE 12\nCAPS AFTER DIGIT\nx"), (7, "VALUE 12\n\nCAPS AFTER BLANK\nx"), (8, "A\r\nb\x0bc\x0cd\x1ce\x85f g"), (9, ""), (10, None),
    (11, " HEAD　\n body "), (12, "x\ty\t\tz\nEND"), (13, "A" * 80 + "\nx\n" + "B" * 81 + "\ny"), (14, "10³ UNITS\nNEXT\nLAST"),
    (15, "ǅ TITLE\nbody"), (16, "अआ\nDEVA ०\nEND"), (17, "   \n\t\n"), (18, "HEAD"), (19, "a  b\n\n\nc  d\ntext\ne  f"), (20, "| |  |\n  |"), (21, "① ITEM\nB:"), (22, "Tail: :\n:"),
]
EDGE = values(EDGE_TEXTS, "doc_id, text")


def _edge(spark):
    return spark.createDataFrame(EDGE_TEXTS, "doc_id int, text string")


@query(lines_sql(EDGE) + "SELECT doc_id, part, title, content FROM sections")
def structure_edge_cases(spark, d):
    return structure.sections(structure.lines(_edge(spark)))


@query(lines_sql(EDGE) + CELLS)
def structure_edge_cells(spark, d):
    return _cells(structure.heuristic_tables(structure.lines(_edge(spark))))


GRIDS = [
    (1, [[["Test", "Value"], ["Hb", None]]]), (2, []), (3, [[["a", "b"], ["c"]], [], [["a", "b"], ["c", "d"]]]), (4, [[["a"], ["b"]], [["a", "b"]]]),
    (5, [[["Clinic\nAddress", None, ""], ["Count", "", None], ["x", "1", "2"]]]), (6, [[["A\nB", ""], ["c", "d"]]]), (7, [[[" ", None], ["", ""], ["k", "v"], ["m", "n"]]]), (8, None),
]


@query(
    "WITH g AS (SELECT doc_id, unnest(from_json(j, '[[[\"VARCHAR\"]]]')) AS t, generate_subscripts(from_json(j, '[[[\"VARCHAR\"]]]'), 1) AS k FROM " + values([(i, None if g is None else json.dumps(g)) for i, g in GRIDS], "doc_id, j") + "), "
    f"f AS (SELECT doc_id, k, list_filter(t, lambda r: CASE len(list_filter(r, lambda c: c IS NOT NULL AND regexp_replace(c, '{EDGES}', '', 'g') <> '')) WHEN 0 THEN false WHEN 1 THEN NOT contains(list_filter(r, lambda c: c IS NOT NULL AND regexp_replace(c, '{EDGES}', '', 'g') <> '')[1], chr(10)) ELSE true END) AS t "
    "FROM g WHERE len(t) >= 2 AND len(t[1]) >= 2 AND len(list_filter(t, lambda r: len(r) <> len(t[1]))) = 0), "
    "n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS table_no, t FROM f WHERE len(t) >= 2) "
    "SELECT doc_id, table_no, CAST(i AS BIGINT) AS row_no, array_to_string(list_transform(t[i], lambda c: coalesce(c, '')), ' | ') AS raw_line FROM n, unnest(range(1, len(t) + 1)) AS u(i)"
)
def native_tables_clean(spark, d):
    g = spark.createDataFrame(GRIDS, "doc_id int, t array<array<array<string>>>").select("doc_id", F.posexplode(structure.clean_native_tables(F.col("t"))).alias("k", "x"))
    rows = g.select("doc_id", (F.col("k") + 1).cast("long").alias("table_no"), F.posexplode("x.raw_lines").alias("r", "raw_line"))
    return rows.select("doc_id", "table_no", (F.col("r") + 1).cast("long").alias("row_no"), "raw_line")


REGIONS = [(1, 1, 10, "Name Value\nHb 14"), (1, 2, 20, "  \n"), (2, 1, 30, None), (2, 2, 40, "ok"), (3, 1, 50, " ")]


@query("SELECT doc_id, CAST(x AS BIGINT) AS x, text AS region_text FROM " + values(REGIONS, "doc_id, ord, x, text") + f" WHERE text IS NOT NULL AND regexp_replace(text, '{EDGES}', '', 'g') <> ''")
def ruled_regions_clean(spark, d):
    r = spark.createDataFrame(REGIONS, "doc_id int, ord int, x int, text string").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.array("x", "x", "x", "x").alias("bbox"), F.col("text").alias("region_text")))).alias("r"))
    return r.select("doc_id", F.explode(structure.clean_ruled_regions(F.col("r"))).alias("t")).select("doc_id", F.col("t.bbox")[0].cast("long").alias("x"), "t.region_text")


NAMES = [("a.pdf", "%PDF-1.4"), ("b.PDF", "x"), ("c.png", "%PDF"), ("d.png", "PNG"), (".pdf", "x"), ("e/.pdf", ""), ("f.pdf\n", "x"), (None, "%PD"), ("", "%PDFx"), ("x/y/z.tiff", "II")]


@query("SELECT name, head, coalesce(regexp_matches(lower(name), '[^/]\\.pdf\\z'), false) OR left(head, 4) = '%PDF' AS is_pdf, coalesce(nullif(string_split(coalesce(nullif(name, ''), 'upload'), '/')[-1], ''), 'upload') AS base FROM " + values(NAMES, "name, head"))
def pdf_routing(spark, d):
    df = spark.createDataFrame(NAMES, "name string, head string")
    key = files.storage_key(F.lit("k"), F.col("name"))
    return df.select("name", "head", files.is_pdf(F.col("name"), F.encode("head", "utf-8")).alias("is_pdf"), F.substring(key, F.lit(3), F.length(key)).alias("base"))


KEYS = [("a/b.png", True), ("../x", False), ("a/../../x", False), ("a/../b", True), ("/etc", False), ("a/./b/..", True), ("", True), ("..", False)]


@query("SELECT key, ok AS inside FROM (VALUES " + ", ".join(f"({literal(k)}, {str(v).lower()})" for k, v in KEYS) + ") AS v(key, ok)")
def path_guard(spark, d):
    return spark.createDataFrame([(k,) for k, _ in KEYS], "key string").select("key", files.inside_root(F.col("key")).alias("inside"))


LANGS = [("eng",), ("eng+guj",), ("eng+guj+nep",), ("Eng",), ("en",), ("eng+",), ("eng\n",), ("",), ("fra+deu+xyz+xyz",), ("eng guj",)]


@query("SELECT lang, CASE WHEN NOT regexp_full_match(lang, '[a-z]{3}(\\+[a-z]{3})*') THEN '422' WHEN len(m) > 0 THEN '400:' || array_to_string(m, ',') ELSE 'ok' END AS outcome FROM (SELECT lang, list_sort(list_distinct(list_filter(string_split(lang, '+'), lambda x: x NOT IN ('eng', 'fra', 'guj')))) AS m FROM " + values(LANGS, "lang") + ")")
def lang_validate(spark, d):
    return spark.createDataFrame(LANGS, "lang string").select("lang", files.lang_outcome(F.col("lang"), ["eng", "fra", "guj"]).alias("outcome"))


PAYLOADS = [
    (1, json.dumps({"text": "t", "text_source": "native_pdf", "images": [{"page": 0, "image_base64": "aGVsbG8="}, {"page": 1, "image_base64": "!!!"}, {"page": 2}, {"page": 3, "image_base64": ""}], "table_regions": [{"region_text": "x"}, {"region_text": " "}]})),
    (2, json.dumps({"text": "only"})), (3, "{}"),
]


@query("SELECT * FROM (VALUES (1, 't', 'native_pdf', 0, 1, 1), (2, 'only', 'ocr', 0, 0, 0), (3, '', 'ocr', 0, 0, 0)) AS v(id, text, text_source, n_tables, n_regions, n_images)")
def payload_decode(spark, d):
    p = files.payload(F.col("j"))
    return spark.createDataFrame(PAYLOADS, "id int, j string").select("id", p.alias("p")).select("id", "p.text", "p.text_source", F.size("p.tables").alias("n_tables"), F.size("p.table_regions").alias("n_regions"), F.size("p.images").alias("n_images"))


SNIPPETS = [(1, "a <b>hit</b> and <b>two</b>"), (2, "none"), (3, "<b>x</b>"), (4, "a < b & <i>c</i>"), (5, "open <b>rest"), (6, "")]


@query("SELECT * FROM (VALUES (1, 1, 'a ', false), (1, 2, 'hit', true), (1, 3, ' and ', false), (1, 4, 'two', true), (2, 1, 'none', false), (3, 1, 'x', true), (4, 1, 'a < b & <i>c</i>', false), (5, 1, 'open ', false), (5, 2, 'rest', true)) AS v(id, n, text, bold)")
def highlight_parse(spark, d):
    s = spark.createDataFrame(SNIPPETS, "id int, s string").select("id", F.posexplode(search.highlighted(F.col("s"))).alias("k", "x"))
    return s.select("id", (F.col("k") + 1).alias("n"), "x.text", "x.bold")


FIGURES = [(1, 0, 2, 50.0, "embedded", "photo"), (1, 1, 0, 90.5, None, None), (1, 2, 0, 10.0, "detected", ""), (1, 3, None, None, "", "logo"), (1, 4, 0, 10.0, "embedded", "chart"), (2, 0, 1, 5.0, "detected", "stamp")]


@query("SELECT doc_id, ord, n, 'Figure ' || n || ' (page ' || (coalesce(page, 0) + 1) || ', ' || coalesce(nullif(source, ''), '?') || ': ' || coalesce(nullif(guess, ''), 'unknown') || ')' AS caption FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 0), coalesce(top, 0), ord) AS n FROM " + values(FIGURES, "doc_id, ord, page, top, source, guess") + ")")
def figure_captions(spark, d):
    f = spark.createDataFrame(FIGURES, "doc_id int, ord int, page int, top double, source string, region_type_guess string")
    f = f.withColumn("bbox", F.when(F.col("top").isNotNull(), F.array(F.lit(0.0), "top", F.lit(1.0), F.lit(1.0))))
    return export.figures(f).select("doc_id", "ord", F.col("n").cast("long").alias("n"), "caption")


@query("SELECT v, CASE WHEN v IS NULL THEN 'n/a' ELSE printf('%.2f', CAST(v AS DOUBLE)) || 's' END AS shown FROM (VALUES (1.006::DOUBLE), (1234567.891), (0.0), (NULL), (99.999)) AS t(v)")
def eval_format(spark, d):
    return spark.createDataFrame([(1.006,), (1234567.891,), (0.0,), (None,), (99.999,)], "v double").select("v", evaluation.shown(F.col("v"), 2, "s").alias("shown"))


PATHS = [("labs/a.pdf", "labs"), ("Scan_01.png", "scan"), ("__ab__12.pdf", "ab"), ("ab1.pdf", "uncategorized"), ("12.pdf", "uncategorized"), ("---.pdf", "uncategorized"), ("x/y/z.jpg", "x"), ("Report-final.PDF", "report-final")]


@query("SELECT * FROM " + values(PATHS, "path, category"))
def eval_categories(spark, d):
    return spark.createDataFrame([(p,) for p, _ in PATHS], "path string").select("path", evaluation.category(F.col("path")).alias("category"))


FAILURES = [(1, "extract", "timeout", "x", 240.0), (2, "extract", "timeout", "x", 0.5), (3, "extract", "http", "refused", 1.0), (4, "structure", "bug", "bad", 1.0), (5, "extract", None, None, 1.0)]


@query("SELECT * FROM (VALUES (1, 'OCR service timed out after 240s'), (2, 'OCR service timed out after 0.5s'), (3, 'OCR extraction failed: refused'), (4, 'Structure parsing failed: bad'), (5, NULL)) AS v(id, error)")
def failure_routing(spark, d):
    f = spark.createDataFrame(FAILURES, "id int, stage string, kind string, message string, seconds double")
    return f.select("id", state.failure(F.col("stage"), F.col("kind"), F.col("message"), F.col("seconds")).alias("error"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_edges(spark, duck, name):
    made, sql = CASES[name]
    assert of_spark(made(spark, None)) == of_duck(duck, sql)
