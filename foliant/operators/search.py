"""Full-text search over postings, with a declared rank, paging, snippets and the parsing of their marks.

The rank is sum(tf / (tf + 1)) over the query's terms, rounded to six places: it grows with each term's
frequency and stays below their number. It stands in for the database's own formula. Stop words are
Spark's English list.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from foliant.functions.stem import porter

TOKEN = r"[\p{L}\p{Nd}]+"
MOST, USUAL = 100, 20
MAX_WORDS, MIN_WORDS = 35, 15


def stop_words(spark) -> list[str]:
    return sorted(StopWordsRemover.loadDefaultStopWords("english"))


def tokens(text: Column, stops: list[str]) -> Column:
    """Lower-cased words without stop words; none for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stops))


@F.pandas_udf(StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(porter)


@F.pandas_udf(ArrayType(StringType()))
def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [porter(w) for w in ws])


def postings(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """(doc_id, lexeme, tf): the inverted table that a search joins instead of scanning texts."""
    words = tokens(F.col("text"), stop_words(docs.sparkSession))
    counted = docs.where("text is not null").select("doc_id", F.explode(words).alias("lexeme")).groupBy("doc_id", "lexeme").agg(F.count("*").alias("tf"))
    if not stemmed:
        return counted
    # each distinct lexeme is stemmed once
    stems = counted.select("lexeme").distinct().withColumn("stem", _stem("lexeme"))
    return counted.join(stems, "lexeme").groupBy("doc_id", F.col("stem").alias("lexeme")).agg(F.sum("tf").alias("tf"))


def query_terms(spark, query: str, stemmed: bool = False) -> list[str]:
    stops = set(stop_words(spark))
    words = [w for w in re.findall(r"[^\W_]+", query.lower()) if w not in stops]
    return sorted({porter(w) if stemmed else w for w in words})


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def check_page(query: str, limit: int, offset: int) -> None:
    if not query:
        raise ValueError("the query is empty")
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be 1 to {MOST}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def search(docs: DataFrame, query: str, limit: int = USUAL, offset: int = 0, stemmed: bool = False) -> DataFrame:
    """The page of docs (doc_id, text, created_at, …) that hold all terms, best rank first, then newest, then least id.

    Any status matches; null texts never do, nor does a query of stop words only.
    """
    check_page(query, limit, offset)
    spark = docs.sparkSession
    terms = query_terms(spark, query, stemmed)
    words = tokens(F.col("text"), stop_words(spark))
    if stemmed:
        # a stem, but for its last letter, begins the word, so only such words of only such documents are stemmed
        likely = F.filter(words, lambda w: reduce(lambda a, b: a | b, (w.startswith(t[:-1]) for t in terms), F.lit(False)))
        docs = docs.withColumn("_l", likely).where(F.size("_l") >= max(1, len(terms)))
        words = _stemmed("_l")
    # terms are few: each document counts them in its own row, so nothing is shuffled before the top of the page
    hits = docs.where("text is not null").withColumn("_w", F.filter(words, lambda w: w.isin(terms) if terms else F.lit(False)))
    counts = [_count("_w", t) for t in terms]
    rank = sum((c / (c + F.lit(1.0)) for c in counts), F.lit(0.0))
    match = F.lit(bool(terms))
    for c in counts:
        match = match & (c > 0)
    ranked = hits.where(match).withColumn("rank", F.round(rank, 6)).drop("_w", "_l")
    return ranked.orderBy(F.desc("rank"), F.desc("created_at"), "doc_id").offset(offset).limit(limit)


def search_postings(index: DataFrame, docs: DataFrame, query: str, limit: int = USUAL, offset: int = 0, stemmed: bool = False) -> DataFrame:
    """What search() gives, by an inverted table as postings() makes it: only the query's lexemes are read, and no text.

    docs: (doc_id, created_at, …), of which only the documents that hold all terms are looked up.
    """
    check_page(query, limit, offset)
    terms = query_terms(docs.sparkSession, query, stemmed)
    mine = index.where(F.col("lexeme").isin(terms) if terms else F.lit(False))
    rank = F.round(F.sum(F.col("tf") / (F.col("tf") + F.lit(1.0))), 6)
    hits = mine.groupBy("doc_id").agg(F.count("*").alias("_n"), rank.alias("rank")).where(F.col("_n") == len(terms)).drop("_n")
    return docs.join(hits, "doc_id").orderBy(F.desc("rank"), F.desc("created_at"), "doc_id").offset(offset).limit(limit)


def headline(terms: list[str], stemmed: bool = False):
    """Column function: the words around the densest hits, at most MAX_WORDS, hits in <b> marks; null text gives an empty one."""
    wanted = frozenset(terms)

    @F.pandas_udf(StringType())
    def of(texts: pd.Series) -> pd.Series:
        def one(text):
            spans = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
            hit = [(porter(w) if stemmed else w) in wanted for w in ((text[a:b]).lower() for a, b in spans)]
            if not spans:
                return ""
            if not any(hit):
                lo, hi = 0, min(len(spans), MIN_WORDS)
            else:
                total, best, lo = [0], -1, 0
                for h in hit:
                    total.append(total[-1] + h)
                for i, h in enumerate(hit):
                    if h and (n := total[min(i + MAX_WORDS, len(hit))] - total[i]) > best:
                        best, lo = n, i
                hi = max(i for i in range(lo, min(lo + MAX_WORDS, len(hit))) if hit[i]) + 1
                while hi - lo < MIN_WORDS and (lo > 0 or hi < len(spans)):
                    lo, hi = max(0, lo - 1), min(len(spans), hi + 1)
                hi = min(hi, lo + MAX_WORDS)
            out, at = [], spans[lo][0]
            for i in range(lo, hi):
                a, b = spans[i]
                out.append(text[at:a] + (f"<b>{text[a:b]}</b>" if hit[i] else text[a:b]))
                at = b
            return "".join(out)

        return texts.map(one)

    return of


def highlighted(snippet: Column) -> Column:
    """A snippet as array<struct<text,bold>>: only <b> and </b> are marks, all else is text; an unclosed mark runs to the end."""
    parts = F.split(snippet, r"(?=</?b>)")
    marked = F.transform(parts, lambda p: F.struct(F.regexp_replace(p, "^</?b>", "").alias("text"), p.startswith("<b>").alias("bold")))
    return F.filter(marked, lambda x: x["text"] != "")
