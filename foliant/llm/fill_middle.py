"""Fill-in-middle: texts cut at two drawn units, their middle moved to the end.

One Aho-Corasick automaton holds the blanks, which are the ASCII characters that change a text's class from word to blank, and
the sentinels. Its events are all that is looked at: a gap between two blanks is one word, so it ends one unit, and a running
sum over the gaps gives the number of units before each event. The cut after k units is looked up by that rank.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.textbytes import column_bytes, row_chunks, trimmed

#: What parts words (a fixed value).
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SENTINEL = 1
#: Events that are taken from the automaton at once, and bytes of texts that are sent at once; a longer text is alone.
EVENTS, CHUNK = 1 << 20, 4 << 20


@dataclass(frozen=True)
class Rule:
    """Sentinels before prefix, suffix and middle; percents of texts that are moved, and of these in suffix-first form; the seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    moved: int = 50
    suffix_first: int = 80
    seed: str = "42"

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for c in BLANKS:
            out.add_word(c, 0)
        for s in (self.prefix, self.suffix, self.middle):
            out.add_word(s, SENTINEL)
        out.make_automaton()
        return out

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers of 32 bits for an id; a null id has the digest of the seed alone."""
        h = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


class Units:
    """The ends of a text's units by rank: a unit is a word with the blanks before it, or the blanks at the end."""

    def __init__(self, automaton: ahocorasick.Automaton, text: str):
        self.size, self.sentinel, events = len(text), False, automaton.iter(text)
        parts, before = [], -1
        while True:
            some = np.fromiter(_take(events, EVENTS), dtype="i8,i1")
            if not len(some):
                break
            self.sentinel |= bool((some["f1"] == SENTINEL).any())
            at = some["f0"][some["f1"] != SENTINEL]
            if not len(at):
                continue
            gap = np.diff(at, prepend=before) > 1  # a word lies between this blank and the one before
            parts.append(at[gap])
            before = int(at[-1])
        self.ends = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        # whatever follows the last of these ends, a word or blanks, is one unit more
        self.n = len(self.ends) + (self.size > 0)

    def end(self, rank: int) -> int:
        """Where the first rank units end."""
        return 0 if not rank else self.size if rank == self.n else int(self.ends[rank - 1])


def _take(events, n: int):
    for _, e in zip(range(n), events):
        yield e


def arranged(rule: Rule, automaton: ahocorasick.Automaton, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix and of the middle, output) of one text."""
    units = Units(automaton, text)
    h1, h2, h3, h4 = rule.draws(doc_id)
    if not text or units.sentinel or h3 % 100 >= rule.moved:
        return units.n, "plain", None, None, text
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    x, y = units.end(a), units.end(b)
    first, last = (rule.prefix + text[:x], rule.suffix + text[y:])
    if h4 % 100 < rule.suffix_first:
        return units.n, "spm", x, y - x, last + first + rule.middle + text[x:y]
    return units.n, "psm", x, y - x, first + last + rule.middle + text[x:y]


FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _run(rule: Rule):
    def run(batches):
        automaton = rule.automaton()
        for batch in batches:
            _, offsets = column_bytes(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK):
                ids = batch.column(0).slice(a, b - a)
                got = [arranged(rule, automaton, i, t or "") for i, t in zip(ids.to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return trimmed(run)


def fill_middle(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one for each row of docs, whole texts.

    A null or empty text has no units and stays plain, as does a text that holds a sentinel. Each row is drawn by its id alone,
    so rows that repeat one come out alike, and rows with a null id share one draw. Other columns are ignored; an empty table
    gives an empty one. Nothing is shuffled; a very long text is cut in one task, its events some MB at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_run(rule), FORMS)


def restored(rule: Rule = Rule(), output: str = "output", form: str = "form") -> Column:
    """The text that an output of the given form was made of. A text with sentinels stays plain, so three places part it."""
    marks = "|".join(rf"\Q{s}\E" for s in (rule.prefix, rule.suffix, rule.middle))
    part = F.split(F.col(output), marks, -1)
    text = F.when(F.col(form) == "psm", F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))))
    return text.when(F.col(form) == "spm", F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))).otherwise(F.col(output))
