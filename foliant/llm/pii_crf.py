"""Personal data by patterns and a semi-Markov conditional random field.

The base patterns are deterministic. What they leave open around digits and @ is segmented by the
field: features of whole spans score each candidate segment under each kind, and a dynamic programme
over segments of bounded length chooses boundaries and kinds together. The field is trained here, by
gradient ascent on the exact likelihood of generated sentences with known segments.

Features are made of running counts over a text, for all candidates of all its regions at once. A segment
of negative score is never part of the best segmentation, since leaving its atoms outside scores 0; only
the others enter the programme.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.textbytes import trimmed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[0-9]")
#: Atoms and characters of one candidate segment at most, and characters at least.
MOST_ATOMS, MOST_CHARS, LEAST_CHARS = 13, 96, 6
#: Characters around a trigger that belong to its region, and before a segment in which a keyword announces it.
MARGIN, BEFORE = 96, 24
#: What a segment of a kind may look like as a whole; being one of these matches is a feature, and no more than that.
SHAPES = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+(?![A-Za-z0-9@_-])"),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z]|[-.][0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z(+.-])(?:\+[0-9](?:[\x20().-]{0,2}[0-9]){6,14}|\([0-9]{2,4}\)[\x20-]?[0-9](?:[\x20.-]?[0-9]){5,9}|[0-9]{3}[-.\x20][0-9]{3}[-.\x20][0-9]{4})(?![0-9A-Za-z]|[-.][0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}(?![A-Za-z0-9])"),
}
KEYWORDS = {
    "email": ("mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd"),
}


_KEYWORDS = {kind: re.compile("|".join(words), re.I) for kind, words in KEYWORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    """As a leftmost search for LOCAL+@DOMAIN finds them, in linear time."""
    out, last, at = [], 0, t.find("@")
    while at >= 0:
        if at >= last:
            s = at
            while s > last and t[s - 1] in LOCAL:
                s -= 1
            if s < at and (m := DOMAIN.match(t, at + 1)):
                out.append((s, m.end()))
                last = m.end()
        at = t.find("@", at + 1)
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; code points, end exclusive."""
    out = [("email", s, e) for s, e in _emails(t)]
    if not DIGITS.search(t):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


class Marks:
    """Running counts and word bounds of a text, made once."""

    def __init__(self, t: str):
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.digit = (code >= 48) & (code <= 57)
        self.letter = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
        for c in np.unique(code[code > 127]).tolist():
            if chr(c).isalnum():
                self.letter |= code == c
        self.alnum = self.digit | self.letter
        self.at, self.space = code == 64, code == 32
        self.opens = (code == 43) | (code == 40)
        self.glue = self.alnum | self.at | (code == 46)
        self.n = len(code)
        count = lambda m: np.concatenate(([0], np.cumsum(m)))
        self.digits, self.letters, self.ats, self.spaces = count(self.digit), count(self.letter), count(self.at), count(self.space)
        before = np.concatenate(([False], self.alnum[:-1]))
        self.start = ~(self.alnum & before)  # of atoms: a run of letters and digits, or one other character
        self.starts = np.flatnonzero(self.start)
        self.ends = np.append(self.starts[1:], self.n)


def regions(t: str, taken: list[tuple[int, int]], marks: Marks | None = None) -> list[tuple[int, int]]:
    """Stretches of MARGIN around triggers outside what is taken, to the bounds of words; they touch nothing that is taken and one another nowhere."""
    marks = marks or Marks(t)
    merged: list[list[int]] = []
    for a, b in sorted(taken):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    lows, highs = np.array([0, *(b for _, b in merged)]), np.array([*(a for a, _ in merged), marks.n])
    trigger = np.flatnonzero(marks.digit | marks.at)
    gap = np.searchsorted(lows, trigger, "right") - 1
    trigger, gap = trigger[trigger < highs[gap]], gap[trigger < highs[gap]]
    if not len(trigger):
        return []
    atom = lambda at: np.searchsorted(marks.starts, at, "right") - 1
    lo = np.maximum(marks.starts[atom(np.maximum(trigger - MARGIN, 0))], lows[gap])
    hi = np.minimum(marks.ends[atom(np.minimum(trigger + MARGIN, marks.n - 1))], highs[gap])
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > np.maximum.accumulate(hi)[:-1])) | np.concatenate(([False], gap[1:] != gap[:-1])))
    return list(zip(lo[new].tolist(), np.maximum.reduceat(hi, new).tolist(), strict=True))


#: Shared by all kinds but for the last three, which are of the kind's own shape and keywords.
N_FEATURES = 12
WIDTH = N_FEATURES + 3


def candidates(t: str, spans: list[tuple[int, int]], marks: Marks | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the candidate segments in the regions spans, and features (segments, kinds, WIDTH)."""
    m = marks or Marks(t)
    lo, hi = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
    # atoms of the regions; one that a region's end cuts is cut
    inside = [np.unique(np.concatenate(([a], m.starts[np.searchsorted(m.starts, a) : np.searchsorted(m.starts, b)]))) for a, b in spans]
    start = np.concatenate(inside) if inside else np.zeros(0, np.int64)
    region = np.repeat(np.arange(len(inside)), [len(x) for x in inside])
    end = np.append(start[1:], 0)
    last = np.flatnonzero(np.append(region[1:] != region[:-1], True)) if len(region) else region
    end[last] = hi[region[last]]
    begins = m.alnum[start] | m.opens[start]
    closes = m.alnum[end - 1]
    first, final = [], []
    for k in range(min(MOST_ATOMS, len(start))):
        i = np.arange(len(start) - k)
        j = i + k
        ok = begins[i] & closes[j] & (region[i] == region[j])
        i, j = i[ok], j[ok]
        s, e = start[i], end[j]
        ok = (e - s >= LEAST_CHARS) & (e - s <= MOST_CHARS) & (m.digits[e] - m.digits[s] + m.ats[e] - m.ats[s] > 0)
        first.append(s[ok])
        final.append(e[ok])
    s, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, final))
    order = np.lexsort((s, e))
    s, e = s[order], e[order]
    n, digits, letters, spaces = e - s, m.digits[e] - m.digits[s], m.letters[e] - m.letters[s], m.spaces[e] - m.spaces[s]
    left, right = (s > 0) & m.glue[np.maximum(s - 1, 0)], (e < m.n) & (m.alnum | m.at)[np.minimum(e, m.n - 1)]
    shared = np.stack([
        np.ones(len(s)), np.minimum(n, 60) / 20, left, right, m.ats[e] > m.ats[s], digits >= 7, digits >= 13, letters > 0,
        (letters > 0) & (digits > 3) & (n >= 16) & (digits + letters == n), spaces > 3, n - digits - letters > digits + letters, m.opens[s],
    ], 1).astype(np.float64) if len(s) else np.zeros((0, N_FEATURES))
    out = np.zeros((len(s), len(KINDS), WIDTH))
    out[:, :, :N_FEATURES] = shared[:, None, :]
    if len(s):
        key = s * (m.n + 1) + e
        for c, kind in enumerate(KINDS):
            found, said = [], []
            for a, b in spans:
                found += [x.start() * (m.n + 1) + x.end() for x in SHAPES[kind].finditer(t, a, b) if kind != "card" or luhn("".join(DIGITS.findall(x[0])))]
                said += [x.span() for x in _KEYWORDS[kind].finditer(t, max(0, a - BEFORE), b)]
            fits = np.isin(key, np.array(found, dtype=np.int64))
            told = np.zeros(len(s), dtype=bool)
            if said:
                said = np.array(sorted(set(said), key=lambda x: x[1]))
                k = np.searchsorted(said[:, 1], s, "right") - 1
                told = (k >= 0) & (said[np.maximum(k, 0), 0] >= s - BEFORE)
            out[:, c, N_FEATURES:] = np.stack((fits, told, fits & told), 1)
    return s, e, out


def _forward(ends: list[int], segments: list[tuple[int, int]], score: np.ndarray) -> np.ndarray:
    """Log-sums up to each bound (ends[0] is the region's start) over all segmentations; what lies outside segments scores 0."""
    place = {b: i for i, b in enumerate(ends)}
    by: list[list[int]] = [[] for _ in ends]
    for k, (_, b) in enumerate(segments):
        by[place[b]].append(k)
    alpha = np.zeros(len(ends))
    for j in range(1, len(ends)):
        parts = [np.array([alpha[j - 1]])] + [alpha[place[segments[k][0]]] + score[k] for k in by[j]]
        alpha[j] = np.logaddexp.reduce(np.concatenate(parts)) if len(parts) > 1 else alpha[j - 1]
    return alpha


def decode(t: str, spans: list[tuple[int, int]], weights: np.ndarray, marks: Marks | None = None) -> list[tuple[str, int, int]]:
    """The best segmentation of the regions spans: its segments as (kind, start, end)."""
    s, e, f = candidates(t, spans, marks)
    score = np.einsum("skf,kf->sk", f, weights)
    kind, top = score.argmax(1), score.max(1) if len(s) else np.zeros(0)
    some = np.flatnonzero(top > 0)
    if not len(some):
        return []
    s, e, kind, top = (x[some].tolist() for x in (s, e, kind, top))
    # segments are in order of their ends: the best of those that end no later than each, with or without it
    best, back = [0.0], [None]
    for k in range(len(s)):
        i = bisect.bisect_right(e, s[k], 0, k)
        with_it = best[i] + top[k]
        best.append(max(best[-1], with_it))
        back.append((k, i) if with_it > best[-2] else None)
    out, k = [], len(s)
    while k > 0:
        if back[k] is None:
            k -= 1
        else:
            out.append((KINDS[kind[back[k][0]]], s[back[k][0]], e[back[k][0]]))
            k = back[k][1]
    return out[::-1]


def sentences(n: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated texts with their segments: each kind with and without an announcing word, and look-alikes that are none."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))

    def card(good=True):
        d = digit(r.choice((14, 15, 15, 18)))
        d += next(c for c in "0123456789" if luhn(d + c) == good)
        return d if r.random() < 0.5 else r.choice(" -").join(d[i : i + 4] for i in range(0, len(d), 4))

    make = {
        "email": lambda: f"{word()}{r.choice(('', '.', '_'))}{word()}{r.choice(('', digit(2)))}@{word()}.{r.choice(('com', 'org', 'net'))}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice((f"+{digit(2)} {digit(3)} {digit(3)} {digit(4)}", f"({digit(3)}) {digit(3)}-{digit(4)}", f"+{digit(11)}", f"{digit(3)}-{digit(3)}-{digit(4)}")),
        "secret": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((24, 32, 40)))),
    }
    none = [lambda: card(False), lambda: digit(r.randint(1, 6)), lambda: f"{digit(1)}.{digit(2)}", lambda: f"{digit(4)}-{digit(2)}-{digit(2)}", lambda: f"{word()}{digit(2)}", lambda: f"@{word()}", lambda: f"{digit(2)}:{digit(2)}", lambda: f"{digit(9)}{digit(12)}", lambda: f"http://{word()}.com/{digit(4)}"]
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.3:
                text += r.choice(none)() + " "
                continue
            kind = r.choice(KINDS)
            if kind == "secret" or r.random() < 0.4:
                text += r.choice(KEYWORDS[kind]) + r.choice((": ", " = ", ' = "', " "))
            x = make[kind]()
            gold.append((kind, len(text), len(text) + len(x)))
            text += x + r.choice((" ", ". ", '" ', ", "))
        out.append((text + word(), gold))
    return out


#: Training sentences, steps and step length.
SENTENCES, TRAIN_STEPS, RATE, DECAY = 200, 60, 0.3, 0.002


@functools.cache
def trained(n: int = SENTENCES, steps: int = TRAIN_STEPS) -> np.ndarray:
    """Weights (kinds, WIDTH) by gradient ascent on the likelihood of generated sentences."""
    data = []
    for text, gold in sentences(n):
        marks = Marks(text)
        s, e, f = candidates(text, [(0, len(text))], marks)
        segments = list(zip(s.tolist(), e.tolist(), strict=True))
        at = {x: k for k, x in enumerate(segments)}
        seen = np.zeros(f.shape[1:])
        for kind, a, b in gold:
            if (k := at.get((a, b))) is not None:
                seen[KINDS.index(kind)] += f[k, KINDS.index(kind)]
        bounds = sorted({0, len(text), *s.tolist(), *e.tolist()})
        if segments:
            data.append((bounds, segments, [-b for b in reversed(bounds)], [(-b, -a) for a, b in segments], f, seen))
    w, m, v = np.zeros((len(KINDS), WIDTH)), 0.0, 0.0
    for step in range(1, steps + 1):
        grad = -DECAY * w * n
        for bounds, segments, mirrored, turned, f, seen in data:
            score = np.einsum("skf,kf->sk", f, w)
            alpha, beta = _forward(bounds, segments, score), _forward(mirrored, turned, score)
            before, after = {b: x for b, x in zip(bounds, alpha, strict=True)}, {-b: x for b, x in zip(mirrored, beta, strict=True)}
            outside = np.array([before[a] + after[b] for a, b in segments])
            p = np.exp(outside[:, None] + score - alpha[-1])
            grad += seen - np.einsum("sk,skf->kf", p, f)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def find(t: str, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: base ones and those that the field adds where no base span stands."""
    if not TRIGGER.search(t):
        return [], []
    base, marks = base_spans(t), Marks(t)
    open_ = regions(t, [(s, e) for _, s, e in base], marks)
    more = decode(t, open_, weights, marks) if open_ else []
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def masked(t: str, spans: list[tuple[str, int, int]]) -> str:
    """t with each span, or union of overlapping spans, replaced by the first one's kind in brackets."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [t[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join([*out, t[last:]])


def _listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _detect(weights: np.ndarray, with_text: bool):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(1).to_pylist()
                found = [find(t or "", weights) for t in texts]
                counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in BASE]
                cols = [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b, _ in found]), pa.array([_listed(s) for _, s in found])]
                names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
                if with_text:
                    cols.append(pa.array([t if t is None or not s else masked(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string()))
                    names.append("masked")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return trimmed(run)


def personal_data(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans[, masked]) of whole texts.

    Counts and base_sha256 are of the base patterns; spans also has what the field adds, of kind secret too. Null and empty
    texts have no spans; masked is null where the text is. Each row is read for itself, so null and repeated ids and repeated
    rows give a row each; other columns are ignored; an empty table gives an empty one. Very long texts are read whole, in
    time that grows with their length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + (", masked string" if with_text else "")
    return rows.mapInArrow(_detect(trained(), with_text), schema)


def _mask(weights: np.ndarray, text_at: int, size_at: int | None):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                out = []
                for t in part.column(text_at).to_pylist():
                    spans = find(t or "", weights)[1]
                    out.append(masked(t, spans) if spans else t)
                cols = list(part.columns)
                cols[text_at] = pa.array(out, part.schema.field(text_at).type)
                if size_at is not None:
                    cols[size_at] = pa.array([None if t is None else len(t) for t in out], part.schema.field(size_at).type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return trimmed(run)


def mask_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets, and the length column, if there is one, made anew."""
    size = docs.columns.index(size_col) if size_col in docs.columns else None
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots are no names to the call
    return plain.mapInArrow(_mask(trained(), docs.columns.index(text_col), size), plain.schema).toDF(*docs.columns)
