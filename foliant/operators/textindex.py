"""A written text index: postings with positions, in blocks with a bound each, kept up by generations.

A block is a run of some documents; a row of the table of postings holds what one lexeme has in one block: its documents, the
places of its words, the greatest count and the newest date. A search adds up the bounds of the blocks that hold all terms,
works out the best of them, and then reads only blocks that can still reach the page. Headlines come from the places.

Each batch of new, changed or deleted documents is one more generation beside the others, which are never rewritten: what an
older generation says of a document is void once a newer one has it. compact() makes one generation of all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.stem import porter
from foliant.operators.search import MAX_WORDS, MIN_WORDS, TOKEN, USUAL, check_page, query_terms, stop_words
from foliant.sources.shared import file_system, remove

#: Bits of a document's number in its block, so 128 documents; and of a block's number in its generation.
BLOCK_BITS, GENERATION_BITS = 7, 42
#: Folders by lexeme.
PARTS = 16
#: Blocks whose rows are formed at once.
AT_ONCE = 8
#: Documents with a later version that are broadcast at most when generations are made one; more are joined by a shuffle.
BROADCAST_DOCS = 4_000_000
#: Blocks that the first look takes, at least.
FIRST = 16


def _rank(count: Column) -> Column:
    return count / (count + F.lit(1.0))


def _lexemes(docs: pa.RecordBatch, stops: frozenset[str], stemmed: bool) -> pa.RecordBatch:
    """(lexeme, block, top, newest, entries) of some blocks' documents (doc_id, created_at, block, words)."""
    words, block = docs.column("words"), docs.column("block").to_numpy()
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    counted = np.array([w not in stops for w in names], dtype=bool)
    lexemes = sorted({porter(w) for w in names}) if stemmed else names
    number = {w: i for i, w in enumerate(lexemes)}
    of = np.array([number[porter(w) if stemmed else w] for w in names], dtype=np.int64)
    size = pc.list_value_length(words).to_numpy()
    doc, code = np.repeat(np.arange(len(size)), size), coded.indices.to_numpy()
    # a place counts all words of the text as it is; stop words leave no postings
    place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    some = counted[code]
    doc, place, code = doc[some], place[some], of[code[some]]
    run = np.cumsum(np.append(0, block[1:] != block[:-1]))
    key = code * (run[-1] + 1) + run[doc]
    order = np.argsort(key, kind="stable")
    key, doc, place, code = key[order], doc[order], place[order], code[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    row, entry = np.flatnonzero(new), np.flatnonzero(new | np.append(True, doc[1:] != doc[:-1])[: len(key)])
    tf, mine = np.diff(np.append(entry, len(key))), doc[entry]
    ends = np.searchsorted(entry, np.append(row, len(key)))
    created = docs.column("created_at")
    by_date = pc.sort_indices(created, null_placement="at_start").to_numpy().astype(np.int64)
    rank = np.empty(len(by_date), dtype=np.int64)
    rank[by_date] = np.arange(len(by_date))
    top, newest = (np.maximum.reduceat(x, ends[:-1]) if len(row) else np.zeros(0, dtype=np.int64) for x in (tf, rank[mine]))
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    places = lists(np.append(entry, len(key)), pa.array(place, pa.int32()))
    entries = pa.StructArray.from_arrays([docs.column("doc_id").take(pa.array(mine)), created.take(pa.array(mine)), pa.array(tf, pa.int64()), places], names=["doc_id", "created_at", "tf", "places"])
    columns = [pa.array(lexemes, pa.string()).take(pa.array(code[row])), pa.array(block[doc[row]]), pa.array(top, pa.int64()), created.take(pa.array(by_date[newest])), lists(ends, entries)]
    return pa.RecordBatch.from_arrays(columns, names=["lexeme", "block", "top", "newest", "entries"])


def _inverted(stops: frozenset[str], stemmed: bool):
    """The function of Arrow batches that makes rows of postings, AT_ONCE blocks at a time; a block that two batches share has rows of both."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            starts = [*np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])[::AT_ONCE].tolist(), len(block)]
            for a, b in itertools.pairwise(starts):
                yield _lexemes(batch.slice(a, b - a), stops, stemmed)

    return run


class TextIndex:
    """An index in a folder that the driver and all executors share: postings, and the documents (doc_id, text, created_at, …)."""

    def __init__(self, spark: SparkSession, root: str, stemmed: bool = False, parts: int = PARTS):
        self.spark, self.root, self.stemmed, self.parts = spark, root, stemmed, parts

    def generations(self) -> list[int]:
        fs, p = file_system(self.spark, f"{self.root}/docs")
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p)) if fs.exists(p) else []

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/docs")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings")

    def add(self, docs: DataFrame, generation: int) -> None:
        """Writes docs as a generation, over what it had, so that a repeated batch changes nothing.

        A doc_id stands in it once; one that an earlier generation has is replaced, by nothing if its text is null.
        """
        number = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
        docs = docs.withColumn("block", F.lit(generation << GENERATION_BITS) + number)
        folder = f"{self.root}/docs/gen={generation}"
        docs.write.mode("overwrite").parquet(folder)
        self._write(self._rows(self.spark.read.parquet(folder)), generation)

    def _rows(self, docs: DataFrame) -> DataFrame:
        """(part, lexeme, block, top, newest, entries): rows of blocks, formed where their documents are, so nothing is shuffled."""
        words = F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.lower).alias("words")
        rows = docs.where("text is not null").select("doc_id", "created_at", "block", words)
        kind = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "created_at")}
        schema = f"lexeme string, block long, top long, newest {kind['created_at']}, entries array<struct<doc_id:{kind['doc_id']},created_at:{kind['created_at']},tf:bigint,places:array<int>>>"
        return rows.mapInArrow(_inverted(frozenset(stop_words(self.spark)), self.stemmed), schema).withColumn("part", self._part(F.col("lexeme")))

    def _write(self, rows: DataFrame, generation: int) -> None:
        rows.sortWithinPartitions("part", "lexeme", "block").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/postings/gen={generation}")

    def _part(self, lexeme: Column) -> Column:
        return F.pmod(F.xxhash64(lexeme), F.lit(self.parts)).cast("int")

    def _of(self, terms: list[str]) -> DataFrame:
        """The postings of terms: their folders alone are read."""
        each = [(F.col("part") == self._part(F.lit(t))) & (F.col("lexeme") == t) for t in terms]
        return self.postings().where(reduce(lambda a, b: a | b, each, F.lit(False)))

    def _living(self, hits: DataFrame) -> DataFrame:
        """hits (doc_id, gen, …) without those of documents that a newer generation has."""
        gens = self.generations()
        if len(gens) < 2:
            return hits
        newer = self.documents().where(F.col("gen") > gens[0]).select(F.col("doc_id").alias("_d"), F.col("gen").alias("_g"))
        return hits.join(newer, (F.col("doc_id") == F.col("_d")) & (F.col("_g") > F.col("gen")), "left_anti")

    def bounds(self, terms: list[str]) -> DataFrame:
        """(gen, block, bound, newest) of the blocks that hold all terms; no document's rank in a block is above the bound."""
        # a block whose documents were read by two tasks has a row of each
        each = self._of(terms).groupBy("gen", "block", "lexeme").agg(F.max("top").alias("top"), F.max("newest").alias("newest"))
        rows = each.groupBy("gen", "block").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(_rank(F.col("top"))), 6).alias("bound"), F.min("newest").alias("newest"))
        return rows.where(F.col("n") == len(terms)).drop("n")

    def _scored(self, terms: list[str], blocks: DataFrame) -> DataFrame:
        """(gen, block, doc_id, created_at, rank) of the living documents of blocks that hold all terms."""
        entries = self._of(terms).join(blocks.select("gen", "block"), ["gen", "block"], "left_semi").select("gen", "block", F.explode("entries").alias("e"))
        hits = entries.groupBy("gen", "block", F.col("e.doc_id").alias("doc_id"), F.col("e.created_at").alias("created_at")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(_rank(F.col("e.tf"))), 6).alias("rank"))
        return self._living(hits.where(F.col("n") == len(terms)).drop("n"))

    def reachable(self, terms: list[str], need: int) -> DataFrame:
        """The blocks of bounds() that can hold one of the best `need` documents: those not below the last of the first blocks' best."""
        bounds = self.bounds(terms)
        first = bounds.orderBy(F.desc("bound"), F.desc("newest"), "block").limit(max(FIRST, need))
        best = self._scored(terms, first).orderBy(F.desc("rank"), F.desc("created_at")).offset(need - 1).limit(1).select("rank", "created_at").collect()
        if not best:
            return bounds
        rank, newest = best[0]
        return bounds.where((F.col("bound") > rank) | ((F.col("bound") == rank) & (F.col("newest") >= F.lit(newest))))

    def search(self, query: str, limit: int = USUAL, offset: int = 0) -> DataFrame:
        """The page of documents that hold all terms, as search() gives it, with rank, gen and block; whole texts are not read for it.

        Best rank first, then newest, then least doc_id. A query of stop words only has no hits.
        """
        check_page(query, limit, offset)
        terms = query_terms(self.spark, query, self.stemmed)
        docs = self.documents()
        if not terms:
            return docs.where("false").withColumn("rank", F.lit(0.0))
        hits = self._scored(terms, self.reachable(terms, limit + offset))
        order = (F.desc("rank"), F.desc("created_at"), F.col("doc_id"))
        page = hits.orderBy(*order).offset(offset).limit(limit)
        # the page is small: at most MOST rows
        return docs.join(F.broadcast(page.select("gen", "block", "doc_id", "rank")), ["gen", "block", "doc_id"]).orderBy(*order)

    def headlines(self, page: DataFrame, query: str) -> DataFrame:
        """page, as search() gives it, with snippet: at most MAX_WORDS words from the window that holds most hits, these in <b> marks.

        Of windows with as many hits the first; it ends with its last hit and grows to MIN_WORDS on both sides.
        """
        terms = query_terms(self.spark, query, self.stemmed)
        keys = ["gen", "block", "doc_id"]
        entries = self._of(terms).join(F.broadcast(page.select("gen", "block").distinct()), ["gen", "block"], "left_semi").select("gen", "block", F.explode("entries").alias("e"))
        places = entries.select("gen", "block", F.col("e.doc_id").alias("doc_id"), F.explode("e.places").alias("place"))
        ahead = Window.partitionBy(*keys).orderBy("place").rangeBetween(0, MAX_WORDS - 1)
        seen = places.withColumns({"n": F.count(F.lit(1)).over(ahead), "last": F.max("place").over(ahead)})
        best = seen.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("place")).alias("from"), "last")).alias("b"), F.collect_set("place").alias("hits"))
        best = best.select(*keys, (-F.col("b.from")).alias("lo"), (F.col("b.last") + 1).alias("hi"), "hits")
        parts = {"_w": F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)), "_g": F.split(F.coalesce("text", F.lit("")), TOKEN)}
        shown = snippet(F.col("_w"), F.col("_g"), F.col("lo"), F.col("hi"), F.col("hits"))
        return page.join(best, keys, "left").withColumns(parts).withColumn("snippet", shown).drop("lo", "hi", "hits", *parts)

    def _void(self, out: TextIndex) -> DataFrame:
        """(gen, block, void): the documents of a block that a newer generation has, written beside out's; broadcast where they are few."""
        newest = self.documents().where(F.col("gen") > self.generations()[0]).groupBy("doc_id").agg(F.max("gen").alias("_g"))
        old = self.documents().select("gen", "block", "doc_id").join(newest, "doc_id").where(F.col("_g") > F.col("gen"))
        path = f"{out.root}/void"
        old.groupBy("gen", "block").agg(F.collect_list("doc_id").alias("void")).write.mode("overwrite").parquet(path)
        void = self.spark.read.parquet(path)
        n = void.agg(F.sum(F.size("void"))).first()[0]
        return F.broadcast(void) if (n or 0) <= BROADCAST_DOCS else void

    def compact(self, generation: int) -> TextIndex:
        """The same index as one generation in a folder of its own, without void rows; texts are not read for the postings."""
        out = TextIndex(self.spark, f"{self.root}-{generation}", self.stemmed, self.parts)
        void = self._void(out)
        gone = lambda i: F.coalesce(F.array_contains("void", i), F.lit(False))
        docs = self.documents().where("text is not null").join(void, ["gen", "block"], "left").where(~gone(F.col("doc_id")))
        docs.drop("gen", "void").write.mode("overwrite").parquet(f"{out.root}/docs/gen={generation}")
        rows = self.postings().join(void, ["gen", "block"], "left")
        rows = rows.withColumn("entries", F.when(F.col("void").isNull(), F.col("entries")).otherwise(F.filter("entries", lambda e: ~gone(e["doc_id"])))).where(F.size("entries") > 0)
        best = {"top": F.array_max(F.transform("entries", lambda e: e["tf"])), "newest": F.array_max(F.transform("entries", lambda e: e["created_at"]))}
        out._write(rows.withColumns(best).select("lexeme", "block", "top", "newest", "entries", "part"), generation)
        remove(self.spark, f"{out.root}/void")
        return out

    def drop(self) -> None:
        remove(self.spark, self.root)


def snippet(words: Column, gaps: Column, lo: Column, hi: Column, hits: Column) -> Column:
    """The words lo to hi of a text, grown to MIN_WORDS, the hits (places) in <b> marks; of null places the first MIN_WORDS words.

    gaps: what stands before each word, and after the last.
    """
    n, lo, hi = F.size(words), F.coalesce(lo, F.lit(0)), F.coalesce(hi, F.lit(0))
    wide = lambda k: (F.least(n, hi + k) - F.greatest(F.lit(0), lo - k) >= MIN_WORDS) | ((lo <= k) & (hi + k >= n))
    by = F.get(F.filter(F.sequence(F.lit(0), F.lit(MIN_WORDS)), wide), F.lit(0))
    first, end = F.greatest(F.lit(0), lo - by), F.least(n, hi + by)
    end = F.least(end, first + MAX_WORDS)
    shown = lambda i: F.when(F.array_contains(hits, i), F.concat(F.lit("<b>"), F.get(words, i), F.lit("</b>"))).otherwise(F.get(words, i))
    parts = F.transform(F.sequence(first, end - 1), lambda i: F.concat(F.when(i > first, F.get(gaps, i)).otherwise(""), shown(i)))
    return F.when(n > 0, F.array_join(parts, "")).otherwise("")


def keep_up(updates: DataFrame, index: TextIndex, checkpoint: str, every: str | None = None):
    """Starts the query that adds each batch of a stream (doc_id, seq, text, created_at, …) to index as a generation.

    Of a document's rows in a batch the one with the greatest seq counts; a null text deletes. Generation 0 is what was there
    before the stream began, if anything.
    """

    def batch(df: DataFrame, n: int) -> None:
        rows = [c for c in df.columns if c not in ("doc_id", "seq")]
        last = df.groupBy("doc_id").agg(F.max_by(F.struct(*rows), "seq").alias("r")).select("doc_id", "r.*")
        index.add(last, n + 1)

    stream = updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
