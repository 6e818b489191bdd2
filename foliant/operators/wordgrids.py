"""Grids from the boxes of words, for pages whose text is embedded: rows, cells, tables and columns by the places of a page's words.

Words that overlap vertically are a row; of its words those with a wide gap before them begin a cell. Rows of two or more cells
that follow each other are a table, and its columns are what the cells cover when laid over one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.structure import LEAST_COLUMNS, LEAST_ROWS

#: In heights of a word: how far words of a row may overlap the row above, the least gap between cells, the most between rows of a table.
OVERLAP, CELL_GAP, ROW_GAP = 0.3, 1.0, 2.5


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row begins a run of equal keys; keys are in order."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _count(new: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many rows of a run are new so far; first begins the runs."""
    c = np.cumsum(new)
    start = np.flatnonzero(first)
    return c - np.repeat(c[start] - new[start], np.diff(np.append(start, len(new))))


def _highest(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The greatest value of a run before each row; what the first row of a run has means nothing."""
    best, begin = value.copy(), np.flatnonzero(first)
    place = np.arange(len(value)) - np.repeat(begin, np.diff(np.append(begin, len(value))))
    step, longest = 1, place.max(initial=0)
    while step <= longest:
        best[step:] = np.where(place[step:] >= step, np.maximum(best[step:], best[:-step]), best[step:])
        step *= 2
    return np.append(best[:1], best[:-1])


def _order(*keys: np.ndarray) -> np.ndarray:
    """The stable order of rows by keys, the first one above the others; most often they are in order."""
    tie = np.ones(max(len(keys[0]) - 1, 0), dtype=bool)
    for k in keys:
        if (tie & ~(k[:-1] <= k[1:])).any():
            return np.lexsort(keys[::-1])
        tie &= k[:-1] == k[1:]
    return np.arange(len(keys[0]))


def _above(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """a > b as Spark has it: NaN, of infinite boxes, is above all."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _lists(size: np.ndarray, items: pa.Array) -> pa.Array:
    """The items as lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), items)


def _texts(texts: pa.Array, order: np.ndarray, first: np.ndarray) -> pa.Array:
    """The texts of each run, in order, joined by blanks."""
    mine = texts.take(pa.array(order))
    return mine if first.all() else pc.binary_join(_lists(np.diff(np.append(np.flatnonzero(first), len(first))), mine), " ")


def _page_grids(page: np.ndarray, x0, y0, x1, y1, texts: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pages, numbers on their page, and rows of the tables in whole pages' words, all of these with a box and a text; rank orders the texts."""
    if not len(page):
        return page, page, _lists(page, _lists(page, texts))
    height = y1 - y0
    down = _order(page, (y0 + y1) / 2, x0, rank)
    first = _firsts(page[down])
    row = np.empty(len(page), dtype=np.int64)
    row[down] = _count(first | ~_above(_highest(y1[down], first) - OVERLAP * height[down], y0[down]), first)
    across = _order(page, row, x0, x1, rank)
    first = _firsts(page[across], row[across])
    new = first | _above(x0[across] - _highest(x1[across], first), CELL_GAP * height[across])
    # cells, in the order of their page, row and place
    at = np.flatnonzero(new)
    text = _texts(texts, across, new)
    page, row, cell = page[across][at], row[across][at], _count(new, first)[at]
    x0, y0 = (np.minimum.reduceat(v[across], at) for v in (x0, y0))
    x1, y1 = (np.maximum.reduceat(v[across], at) for v in (x1, y1))
    # rows: a table ends before a row of one cell and before a wide gap
    at = np.flatnonzero(_firsts(page, row))
    n = np.diff(np.append(at, len(page)))
    top, bottom, of = np.minimum.reduceat(y0, at), np.maximum.reduceat(y1, at), page[at]
    first = _firsts(of)
    apart = first | (n < LEAST_COLUMNS)
    apart[1:] |= (n[:-1] < LEAST_COLUMNS) | _above(top[1:] - bottom[:-1], ROW_GAP * (bottom[1:] - top[1:]))
    # of tables with two rows at least: others have no grid
    begin = np.flatnonzero(apart)
    rows = np.diff(np.append(begin, len(n)))
    table = np.repeat(_count(apart, first), n)
    kept = np.repeat((n >= LEAST_COLUMNS) & np.repeat(rows >= LEAST_ROWS, rows), n)
    page, row, cell, table, x0, x1 = (v[kept] for v in (page, row, cell, table, x0, x1))
    text = text.filter(pa.array(kept))
    if not len(page):
        return page, page, _lists(page, _lists(page, text))
    over = _order(page, table, x0, x1, row)
    first = _firsts(page[over], table[over])
    column = np.empty(len(page), dtype=np.int64)
    column[over] = _count(first | _above(x0[over], _highest(x1[over], first)), first)
    # cells of one row that cover a column together are one
    order = _order(page, table, row, column, cell)
    page, table, row, column = page[order], table[order], row[order], column[order]
    new = _firsts(page, table, row, column)
    text = _texts(text, order, new)
    page, table, row, column = page[new], table[new], row[new], column[new]
    first, begins = _firsts(page, table), _firsts(page, table, row)
    starts = np.flatnonzero(first)
    width, rows = np.maximum.reduceat(column, starts), np.add.reduceat(begins.astype(np.int64), starts)
    sound = (width >= LEAST_COLUMNS) & (rows >= LEAST_ROWS)
    kept = np.repeat(sound, np.diff(np.append(starts, len(page))))
    of, width, rows = page[starts][sound], width[sound], rows[sound]
    # each cell has its place in the grids, all laid end to end
    wide = np.repeat(width, rows)
    place = (np.cumsum(wide) - wide)[np.cumsum(begins[kept]) - 1] + column[kept] - 1
    at = np.full(wide.sum(), -1)
    at[place] = np.flatnonzero(kept)
    return of, _count(np.ones(len(of), dtype=np.int64), _firsts(of)), _lists(rows, _lists(wide, text.take(pa.array(at, mask=at < 0))))


def _found(page: np.ndarray, boxes: Iterable[pa.Array], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tables, as _page_grids() has them, of words whose pages are numbered; a word without a sound box spoils its page."""
    x0, y0, x1, y1 = (pc.fill_null(b, np.nan).to_numpy(zero_copy_only=False) for b in boxes)
    sound = (x0 <= x1) & (y0 < y1)
    texts = pc.utf8_trim(texts, " ")
    good = np.ones(page.max(initial=-1) + 1, dtype=bool)
    good[page[~sound]] = False
    some = np.flatnonzero(good[page] & pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False))
    texts = texts.take(pa.array(some))
    coded = texts.dictionary_encode()
    place = np.empty(len(coded.dictionary), dtype=np.int64)
    place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
    return _page_grids(page[some], *(v[some] for v in (x0, y0, x1, y1)), texts, place[coded.indices.to_numpy()])


PACKED = ("x0", "y0", "x1", "y1", "text")


def _packed(batches) -> Iterator[pa.RecordBatch]:
    """Words that follow each other on a page as one row of lists."""
    for batch in batches:
        if not batch.num_rows:
            continue
        same = [batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for i in (0, 1)]
        at = np.flatnonzero(_firsts(*same))
        offsets = pa.array(np.append(at, batch.num_rows), pa.int32())
        keys = [batch.column(i).take(pa.array(at)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(offsets, batch.column(i)) for i in range(2, 7))], names=[*batch.schema.names[:2], *PACKED])


def _grids(batches) -> Iterator[pa.RecordBatch]:
    """Grids of pages, each row one page's runs of words (doc_id, page, runs)."""
    for batch in batches:
        runs = batch.column(2)
        count = pc.list_value_length(runs).to_numpy(zero_copy_only=False)
        flat = runs.flatten()
        fields = [flat.field(i) for i in range(5)]
        words = np.asarray(pc.list_value_length(fields[4]).to_numpy(zero_copy_only=False), dtype=np.int64)
        page = np.repeat(np.repeat(np.arange(len(count)), count), words)
        of, number, rows = _found(page, (f.flatten() for f in fields[:4]), fields[4].flatten())
        keys = [batch.column(i).take(pa.array(of)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(number, pa.int32()), rows], names=[*batch.schema.names[:2], "table_no", "rows"])


#: So many words, of whole documents, are worked out at once.
CHUNK = 30_000


def _whole(batches: Iterable[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, parted only before those whose column `first` is true."""
    held, n = [], 0
    for batch in batches:
        at = np.flatnonzero(batch.column(first).to_numpy(zero_copy_only=False))
        if len(at) and n + at[-1] >= CHUNK:
            yield pa.concat_batches([*held, batch.slice(0, at[-1])])
            held, n, batch = [], 0, batch.slice(at[-1])
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.concat_batches(held)


def _of_documents(kept: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of words that follow each other by documents, documents with their grids: so many columns of theirs, whether a word is a document's first, page, box, text."""

    def run(batches):
        for words in _whole(batches, kept):
            first = words.column(kept).to_numpy(zero_copy_only=False)
            doc = np.cumsum(first) - 1
            pages = words.column(kept + 1).dictionary_encode(null_encoding="encode")
            code = pages.indices.to_numpy(zero_copy_only=False)
            # words of a page may stand apart
            at = np.flatnonzero(_firsts(doc, code))
            known, number = np.unique(doc[at] * len(pages.dictionary) + code[at], return_inverse=True)
            page = np.repeat(number, np.diff(np.append(at, len(doc))))
            of, table_no, rows = _found(page, words.columns[kept + 2 : kept + 6], words.column(kept + 6))
            of_doc, of_page = np.divmod(known[of], len(pages.dictionary))
            grids = pa.StructArray.from_arrays([pages.dictionary.take(pa.array(of_page)), pa.array(table_no, pa.int32()), rows], names=["page", "table_no", "rows"])
            firsts = pa.array(np.flatnonzero(first))
            out = [words.column(i).take(firsts) for i in range(kept)]
            yield pa.RecordBatch.from_arrays([*out, _lists(np.bincount(of_doc, minlength=len(firsts)), grids)], names=[*words.schema.names[:kept], "grids"])

    return run


def word_grids(words: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, rows) of words (doc_id, page, x0, y0, x1, y1, text): grids by page from above, null where a row has no cell.

    rows go into structure.clean_native_tables(). A page on which a word has no box, or one that is no box, yields none; other
    pages keep theirs. Words without text count for nothing. A page's words are one task's: they are packed where they stand,
    meet with one shuffle, and many pages are worked out at once.
    """
    kind = {c: words.schema[c].dataType.simpleString() for c in ("doc_id", "page")}
    keys = ", ".join(f"{c} {k}" for c, k in kind.items())
    words = words.select("doc_id", "page", *(F.col(c).cast("double").alias(c) for c in PACKED[:4]), "text")
    packed = words.mapInArrow(_packed, f"{keys}, " + ", ".join(f"{c} array<{'string' if c == 'text' else 'double'}>" for c in PACKED))
    pages = packed.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*PACKED)).alias("runs"))
    return pages.mapInArrow(_grids, f"{keys}, table_no int, rows array<array<string>>")


def document_grids(docs: DataFrame, words: Column, box: Callable[[Column, Column], Column] = lambda i, w: w, keep: Iterable[str] | None = None) -> DataFrame:
    """docs, or the columns keep of it, with grids, an array of (page, table_no, rows) by page and place as word_grids() has them, of the words in each document's own row.

    words is an array, of structs (page, x0, y0, x1, y1, text) or of what box makes such a struct of, given a word's number and the
    word. Nothing moves and nothing is joined: a row's words follow each other in its task, and the first one carries the row's columns.
    Where words is a column of docs, it need not be kept; a document of 400,000 words took 16 s with it and 4 s without.
    """
    keep = docs.columns if keep is None else list(keep)
    rows = docs.select("*", F.posexplode_outer(words).alias("_i", "_w"))
    first, at = F.coalesce(F.col("_i") == 0, F.lit(True)), box(F.col("_i"), F.col("_w"))
    rows = rows.select(*(F.when(first, F.col(f"`{c}`")).alias(c) for c in keep), first.alias("_first"), at["page"].alias("_page"), *(at[c].cast("double").alias(f"_{c}") for c in PACKED[:4]), at["text"].alias("_text"))
    page = rows.schema["_page"].dataType
    grid = T.StructType([T.StructField("page", page), T.StructField("table_no", T.IntegerType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))])
    kept = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    made = rows.mapInArrow(_of_documents(len(kept)), T.StructType([*kept, T.StructField("grids", T.ArrayType(grid))]))
    return made.withColumn("grids", F.array_sort("grids"))


def native_tables(words: DataFrame) -> DataFrame:
    """(doc_id, native_tables) for parse_structure(): all grids of a document by page and place."""
    grids = word_grids(words).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "table_no", "rows"))).alias("g"))
    return grids.select("doc_id", F.transform("g", lambda g: g["rows"]).alias("native_tables"))
