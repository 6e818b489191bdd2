"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Base statistics of each text are counted by column expressions; texts that fail the base rules go.
The others' transformed statistics are compared with their language and source: a minimum covariance
determinant estimate, regularised by floors, gives a Mahalanobis distance, beyond which a text is
rejected. Concentration steps run from several starts; the one of least determinant goes on until
the determinant stands still, and is scaled to be consistent for normal data.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, small_or_shuffled

WHITE = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"
#: Share of a group's texts that the estimate is fitted on.
SUBSET = 0.75
#: Concentration steps from each start, and at most from the best one; it ends where no log-determinant moves by more than STILL.
FIRST_STEPS, MOST_STEPS, STILL = 2, 6, 1e-2
#: Groups of fewer texts are pooled by language, and pools of fewer into one.
LEAST = 60
#: Groups of which the tables are broadcast at most.
BROADCAST_ROWS = 20_000
#: Names of the statistics and the standard deviation that each has at least: the regularisation of the covariance.
FLOORS = {"z_length": 1.0, "z_word": 0.5, "z_symbols": 0.06, "z_lines": 0.25, "z_repeats": 0.15}
NAMES = list(FLOORS)
P = len(NAMES)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Bits of a window's position in its sort key; longer texts are sorted by the windows themselves.
_POSITION = 20


def chi2_cdf(x: float, p: int) -> float:
    """Of chi-square with p degrees of freedom, by the series of the incomplete gamma function."""
    a, x = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


#: Squared distance beyond which a text is rejected: what one normal text in 1000 reaches.
CUTOFF = chi2_quantile(0.999, P)
#: What the covariance of the innermost SUBSET of normal data is multiplied by to be that of all.
CONSISTENT = SUBSET / chi2_cdf(chi2_quantile(SUBSET, P), P + 2)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+"))


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are sorted by hash and position, neighbours compared word by word. If two different windows clash, or positions
    are too large for the key, the windows themselves are sorted.
    """

    def covered(s: Column, at, same) -> Column:
        dup = F.filter(s, lambda x, k: ((k > 0) & same(x, F.get(s, k - 1))) | same(x, F.get(s, k + 1)))
        places = F.array_sort(F.transform(dup, at))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda acc: acc["n"])

    def of(w: Column) -> Column:
        windows = F.sequence(F.lit(0), F.size(w) - 3)
        mask = (1 << _POSITION) - 1
        low = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
        hashed = lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _POSITION).bitwiseOR(i.cast("long"))
        near = lambda x, y: F.coalesce(F.shiftrightunsigned(x, _POSITION) == F.shiftrightunsigned(y, _POSITION), F.lit(False))
        equal = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
        same = lambda x, y: F.coalesce(near(x, y) & equal(low(x), low(y)), F.lit(False))
        plain = F.array_sort(F.transform(windows, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))
        exact = _let(plain, lambda s: covered(s, lambda x: x["i"], lambda x, y: F.coalesce(x["t"] == y["t"], F.lit(False))))
        clash = lambda s: F.exists(F.transform(s, lambda x, k: near(x, F.get(s, k + 1)) & ~same(x, F.get(s, k + 1))), lambda x: x)
        short = _let(F.sort_array(F.transform(windows, hashed)), lambda s: F.when(clash(s), exact).otherwise(covered(s, low, same)))
        return F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) <= mask, short).otherwise(exact)

    return _let(w, of)


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, lang, source of every text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    kept = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    counted = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *kept,
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("lines"),
        _let(words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("words"),
    )
    return counted.select("doc_id", "lang", "source", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", (F.col("lines.n") - F.col("lines.d")).alias("n_dup_lines"), F.col("words.r").alias("n_repeat_words"), F.col("lines.n").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed(stats: DataFrame) -> DataFrame:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    z = [F.log1p(n), F.col("word_chars") / n, F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n)]
    return stats.select("*", *(x.alias(c) for x, c in zip(z, NAMES, strict=True)))


def _factor(groups: DataFrame, scale: float = 1.0) -> DataFrame:
    """groups (g, start, m_i, c_i_j) to centres, the Cholesky factor l_i_j of the regularised covariance, and its log-determinant e."""
    out = groups
    for i in range(P):  # a row of the factor needs the rows before it
        row: dict[int, Column] = {}
        for j in range(i + 1):
            value = F.coalesce(F.col(f"c_{i}_{j}"), F.lit(0.0)) * scale
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + F.lit(FLOORS[NAMES[i]] ** 2)
            for k in range(j):
                value = value - row[k] * (row[k] if i == j else F.col(f"l_{j}_{k}"))
            row[j] = F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l_{j}_{j}")
        out = out.select("*", *(row[j].alias(f"l_{i}_{j}") for j in range(i))) if i else out
        diagonal = F.greatest(F.coalesce(F.col(f"c_{i}_{i}"), F.lit(0.0)) * scale, F.lit(0.0)) + F.lit(FLOORS[NAMES[i]] ** 2)
        for k in range(i):
            diagonal = diagonal - F.col(f"l_{i}_{k}") * F.col(f"l_{i}_{k}")
        out = out.select("*", F.sqrt(F.greatest(diagonal, F.lit(1e-9))).alias(f"l_{i}_{i}"))
    return out.select("g", "start", *_FIT[:-1], reduce(lambda x, i: x + 2 * F.log(F.col(f"l_{i}_{i}")), range(1, P), 2 * F.log(F.col("l_0_0"))).alias("e"))


_FIT = [*(f"m_{i}" for i in range(P)), *(f"l_{i}_{j}" for i, j in _PAIRS), "e"]


def _distance(y: list[Column]) -> Column:
    """Squared Mahalanobis distance of a row that carries its group's centre and factor, by forward substitution."""
    solved: list[Column] = []
    for i in range(P):
        value = y[i] - F.col(f"m_{i}")
        for j, z in enumerate(solved):
            value = value - F.col(f"l_{i}_{j}") * z
        solved.append(value / F.col(f"l_{i}_{i}"))
    return sum((z * z for z in solved[1:]), solved[0] * solved[0])


def _moments(rows: DataFrame) -> DataFrame:
    """For each g and start means m_i and covariances c_i_j of rows; statistics y_i are about 0."""
    y = [F.col(f"y_{i}") for i in range(P)]
    sums = rows.groupBy("g", "start").agg(F.count("*").alias("n"), *(F.sum(y[i]).alias(f"s_{i}") for i in range(P)), *(F.sum(y[i] * y[j]).alias(f"s_{i}_{j}") for i, j in _PAIRS))
    mean = lambda *i: F.col("_".join(["s", *map(str, i)])) / F.col("n")
    return sums.select("g", "start", *(mean(i).alias(f"m_{i}") for i in range(P)), *((mean(i, j) - mean(i) * mean(j)).alias(f"c_{i}_{j}") for i, j in _PAIRS))


def _joined(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    return rows.join(small_or_shuffled(groups, BROADCAST_ROWS), ["g", *keys])


def _nearest(rows: DataFrame, groups: DataFrame, distance: Column, scratch: Scratch) -> DataFrame:
    """Moments of the SUBSET of each group's rows that are nearest, for each start; distance is over the columns of rows and groups (g, start, …)."""
    near = lambda groups, *more: _joined(rows, groups).select("g", "start", *(f"y_{i}" for i in range(P)), *more, distance.alias("d"))
    cut = near(groups).groupBy("g", "start").agg(F.percentile_approx("d", F.lit(SUBSET), F.lit(1000)).alias("cut"))
    cut = scratch.save(_joined(groups, scratch.save(cut, "cut"), "start"), "cuts")
    return scratch.save(_moments(near(cut, "cut").where("d <= cut")), "moments")


def fitted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (g, y_0..): statistics less their group's medians, to a row for each group: the consistent estimate, as by _factor.

    Starts: medians and absolute deviations; means and covariances of all; those of the rows nearest to the medians.
    """
    y = [F.col(f"y_{i}") for i in range(P)]
    spread = scratch.save(rows.groupBy("g").agg(*(F.percentile_approx(F.abs(y[i]), F.lit(0.5), F.lit(1000)).alias(f"d_{i}") for i in range(P))), "spread")
    wide = [F.pow(F.col(f"d_{i}") * 1.4826, 2) for i in range(P)]
    first = spread.select("g", F.lit(0).alias("start"), *(F.lit(0.0).alias(f"m_{i}") for i in range(P)), *((wide[i] if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS))
    far = reduce(F.greatest, (F.abs(y[i]) / F.sqrt(wide[i] + FLOORS[NAMES[i]] ** 2) for i in range(P)))
    twice = spread.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("start"))
    others = _nearest(rows, scratch.save(twice, "twice"), F.when(F.col("start") == 2, far).otherwise(F.lit(0.0)), scratch)
    fit = scratch.save(_factor(first.unionByName(others)), "fit")
    for _ in range(FIRST_STEPS):
        fit = scratch.save(_factor(_nearest(rows, fit, _distance(y), scratch)), "fit")
    best = F.min(F.struct("e", "start", *_FIT[:-1])).alias("x")
    fit = scratch.save(fit.groupBy("g").agg(best).select("g", "x.start", *(f"x.{c}" for c in _FIT)), "best")
    for _ in range(MOST_STEPS):
        moments = _nearest(rows, fit, _distance(y), scratch)
        new = scratch.save(_factor(moments), "fit")
        moved = _joined(new.select("g", "e"), fit.select("g", F.col("e").alias("old"))).agg(F.max(F.abs(F.col("e") - F.col("old")))).first()[0]
        fit = new
        if moved is None or moved <= STILL:
            break
    return _factor(moments, CONSISTENT).drop("start")


def judged(docs: DataFrame, scratch: Scratch, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """base_statistics plus base_failed, distance and kept of every text.

    Texts that fail the base rules have no distance and are not kept. A null language or source is a group of its own.
    The estimates are made of all texts that pass the base rules, however many. Each row is judged, whatever its id; other
    columns are ignored. No texts give an empty table. Only tables of a row for each language and source are joined to the
    texts' statistics, by broadcast up to BROADCAST_ROWS of them.
    """
    stats = scratch.save(base_statistics(docs, id_col, text_col).withColumn("base_failed", base_failed()), "stats")
    good = transformed(stats.where("not base_failed"))
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    sizes = scratch.save(good.groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    pools = scratch.save(sizes.where(F.col("n") < LEAST).groupBy(F.col("lang").alias("pool")).agg(F.sum("n").alias("k")), "pools")
    level = F.when(F.col("n") >= LEAST, F.concat_ws("\x01", mark("lang_"), mark("source_"))).when(F.col("k") >= LEAST, mark("lang_")).otherwise(F.lit("*"))
    named = sizes.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "n")
    names = scratch.save(named.join(small_or_shuffled(pools, BROADCAST_ROWS), F.col("lang_").eqNullSafe(F.col("pool")), "left").select("lang_", "source_", level.alias("g")), "groups")
    small = small_or_shuffled(names, BROADCAST_ROWS)
    grouped = lambda x, how: x.join(small, x["lang"].eqNullSafe(F.col("lang_")) & x["source"].eqNullSafe(F.col("source_")), how)
    vectors = scratch.save(grouped(good, "inner").select("g", *NAMES), "vectors")
    middle = scratch.save(vectors.groupBy("g").agg(*(F.percentile_approx(c, F.lit(0.5), F.lit(1000)).alias(f"o_{i}") for i, c in enumerate(NAMES))), "middle")
    centred = [(F.col(c) - F.col(f"o_{i}")).alias(f"y_{i}") for i, c in enumerate(NAMES)]
    rows = scratch.save(_joined(vectors, middle).select("g", *centred), "centred")
    fit = scratch.save(_joined(fitted(rows, scratch), middle), "estimate")
    placed = grouped(transformed(stats), "left").join(small_or_shuffled(fit, BROADCAST_ROWS), "g", "left")
    out = placed.withColumn("distance", F.when(~F.col("base_failed"), _distance(centred)))
    return out.select(*stats.columns, "distance").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def quality_rules(docs: DataFrame, **columns) -> DataFrame:
    """judged() with a scratch folder of its own, in the order of columns that reports use."""
    out = judged(docs, Scratch(docs.sparkSession, "quality"), **columns)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
