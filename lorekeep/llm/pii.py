"""Personal data: fixed patterns, and more spans by a semi-Markov conditional random field.

The fixed patterns (e-mail, IP, card, phone) always count. Around digits and @ signs the text is cut into atoms (runs of
letters, runs of digits, single other characters), and the field scores whole candidate segments of up to ``LONGEST`` atoms for
each kind by features of the span as a whole: its digits, its check sum, its separators, its parts, what stands beside it.
Dynamic programming over segments gives the best segmentation, choosing boundaries and kinds together, and forward-backward
sums over segmentations give each segment's probability. Weights are fitted by gradient ascent on the likelihood of the fixed
patterns' spans in a bounded sample of stretches; what else the field finds with a probability of ``SURE`` or more, off the fixed
spans, is added: a phone number without its plus sign, say.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: Atoms in a segment at most, texts and stretches of the training sample at most, steps of the ascent, ridge, least probability of
#: added spans.
LONGEST, SAMPLE, STRETCHES, STEPS, RIDGE, SURE = 14, 1500, 6000, 20, 2e-3, 0.95

# The base patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # begins and ends with whole runs of digits, as without these marks
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_ATOM = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]")
#: Characters without digit or @ that end a stretch, and characters of context kept on both sides.
_QUIET, _MARGIN = 24, 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, found from their @ signs; the part before an @ begins where its run of characters does."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in "._%+-" or "0" <= text[start - 1] <= "9" or "A" <= text[start - 1] <= "Z" or "a" <= text[start - 1] <= "z"):
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start; leftmost and non-overlapping within a kind, failed matches dropped."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text around digits and @ signs; a candidate lies within one."""
    start = end = None
    for m in _TRIGGER.finditer(text):
        if start is None:
            start = m.start()
        elif m.start() - end > _QUIET:
            yield max(0, start - _MARGIN), min(len(text), end + _MARGIN)
            start = m.start()
        end = m.end()
    if start is not None:
        yield max(0, start - _MARGIN), min(len(text), end + _MARGIN)


#: Names of the features of a whole span; each kind has a weight for each.
FEATURES = (
    "bias", "one_at", "name_before_at", "host_with_dots", "letters_at_end", "four_parts", "parts_of_a_byte", "only_dots", "card_digits", "check_sum",
    "even_groups", "no_letters", "plus_first", "phone_digits", "round_brackets", "phone_signs", "loose_before", "loose_after", "long_run", "other_signs", "digits_before", "digits_after",
)


def span_features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that hold for text[start:end]."""
    s, d = text[start:end], _digits(text[start:end])
    letters = any(c.isalpha() for c in s)
    local, at, host = s.partition("@")
    parts = s.split(".")
    numeric = not letters and "@" not in s
    bytes_like = numeric and len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)  # isdigit alone takes signs that int() refuses
    groups = re.split(r"[ -]", s)
    before, after = text[max(0, start - 1) : start], text[end : end + 2]
    on = (
        True, s.count("@") == 1, bool(at and local and not re.search(r"[^A-Za-z0-9._%+-]", local)), bool(at and re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", host)),
        letters and s[-1].isalpha(), bytes_like, bytes_like and all(len(p) <= 3 and int(p) <= 255 for p in parts),
        numeric and "." in s and not re.search(r"[^0-9.]", s), 16 <= len(d) <= 19, 16 <= len(d) <= 19 and luhn(d),
        len({len(g) for g in groups[:-1]}) == 1 and len(groups) > 1, numeric, s[0] == "+", 8 <= len(d) <= 15, bool(re.search(r"\([0-9]+\)", s)), numeric and bool(re.search(r"[ -]", s)),
        not re.match(r"[\w.%+-]", before), not re.match(r"[.-]?\w", after), bool(re.search(r"[0-9]{11}", s)), bool(re.search(r"[^A-Za-z0-9@._%+\-() ]", s)),
        bool(re.search(r"[0-9+]", text[max(0, start - 2) : start])), bool(re.search(r"[0-9]", text[end : end + 2])),
    )
    return [i for i, x in enumerate(on) if x]


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Atom boundaries of a stretch, and segments (first atom, past last, features) that may be personal data: those that
    begin and end like it and hold an @ with a dot after it, seven digits, or four with three dots."""
    bounds = [start]
    for m in _ATOM.finditer(text, start, end):
        bounds.append(m.end())
    kinds = [text[b] if b < len(text) else "" for b in bounds]
    count = [0]
    for a, b in zip(bounds, bounds[1:], strict=False):
        count.append(count[-1] + (b - a if "0" <= text[a] <= "9" else 0))
    out = []
    n = len(bounds) - 1
    for i in range(n):
        c = kinds[i]
        if not (c.isalnum() or c in "+("):
            continue
        at = dot = False
        dots = 0
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            a = text[bounds[j - 1]]
            if a == "@":
                at = True
            elif a == ".":
                dot, dots = at, dots + 1
            elif a in "\n\t" or (a.isspace() and (at or bounds[j] - bounds[j - 1] > 1)):
                break
            if a.isalnum() and ((at and dot) or (not at and count[j] - count[i] >= (4 if dots == 3 else 7))):
                out.append((i, j, span_features(text, bounds[i], bounds[j])))
    return bounds, out


def _scored(segments: list, weights: np.ndarray) -> np.ndarray:
    """(segments, kinds) scores."""
    out = np.zeros((len(segments), len(KINDS)))
    for k, (_, _, f) in enumerate(segments):
        out[k] = weights[:, f].sum(1)
    return out


def posteriors(n: int, segments: list[tuple[int, int, list[int]]], scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log of the sum over segmentations of n atoms, and the probability of each (segment, kind).

    A segmentation covers the atoms with segments of a kind and single atoms of none, which score 0.
    """
    ends, begins = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    top = np.logaddexp.reduce(scores, axis=1) if len(scores) else []
    for k, (i, j, _) in enumerate(segments):
        ends[j].append((i, top[k]))
        begins[i].append((j, top[k]))
    a, b = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        a[j] = a[j - 1]
        for i, s in ends[j]:
            a[j] = np.logaddexp(a[j], a[i] + s)
    for i in range(n - 1, -1, -1):
        b[i] = b[i + 1]
        for j, s in begins[i]:
            b[i] = np.logaddexp(b[i], b[j] + s)
    p = np.zeros_like(scores)
    for k, (i, j, _) in enumerate(segments):
        p[k] = np.exp(a[i] + scores[k] + b[j] - a[n])
    return float(a[n]), p


def best(n: int, segments: list[tuple[int, int, list[int]]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(segment, kind) numbers of the best segmentation."""
    ends = [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(segments):
        kind = int(np.argmax(scores[k]))
        ends[j].append((i, float(scores[k, kind]), k, kind))
    value, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for i, s, k, kind in ends[j]:
            if value[i] + s > value[j]:
                value[j], back[j] = value[i] + s, (i, k, kind)
    out, j = [], n
    while j:
        if back[j]:
            i, k, kind = back[j]
            out.append((k, kind))
            j = i
        else:
            j -= 1
    return out[::-1]


def field_spans(text: str, weights: np.ndarray) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, probability) of the best segmentation of each stretch."""
    out = []
    for start, end in stretches(text):
        bounds, segments = candidates(text, start, end)
        if not segments:
            continue
        scores = _scored(segments, weights)
        if scores.max() <= 0:
            continue
        _, p = posteriors(len(bounds) - 1, segments, scores)
        out += [(KINDS[kind], bounds[segments[k][0]], bounds[segments[k][1]], float(p[k, kind])) for k, kind in best(len(bounds) - 1, segments, scores)]
    return out


def all_spans(text: str, weights: np.ndarray, sure: float = SURE) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and those with what the field adds off them, both by kind and start."""
    base = base_spans(text)
    # field spans come in order and apart; the base, by start, is walked along with them, the furthest end so far being enough
    at, i, reach, more = sorted((s, e) for _, s, e in base), 0, -1, []
    for kind, s, e, p in field_spans(text, weights):
        while i < len(at) and at[i][0] < e:
            reach = max(reach, at[i][1])
            i += 1
        if p >= sure and reach <= s:
            more.append((kind, s, e))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda x: (order[x[0]], x[1], x[2]))


def _gradient(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood and its gradient over stretches: base spans are the truth."""

    def run(batches):
        g, like, n = np.zeros_like(weights), 0.0, 0
        for b in batches:
            for text in b.column(0).to_pylist():
                gold = base_spans(text)
                for start, end in stretches(text):
                    bounds, segments = candidates(text, start, end)
                    if not segments:
                        continue
                    scores = _scored(segments, weights)
                    z, p = posteriors(len(bounds) - 1, segments, scores)
                    like, n = like - z, n + 1
                    at = {(bounds[i], bounds[j]): k for k, (i, j, _) in enumerate(segments)}
                    taken = []
                    for kind, s, e in gold:
                        k = at.get((s, e))
                        if k is not None and not any(s < y and x < e for x, y in taken):
                            taken.append((s, e))
                            p[k, KINDS.index(kind)] -= 1
                            like += scores[k, KINDS.index(kind)]
                    for k, (_, _, f) in enumerate(segments):
                        g[:, f] -= p[k][:, None]
        total = np.concatenate([[like, n], g.ravel()])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": total})

    sums = rows.select("text").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(2 + weights.size)
    for r in sums:
        out[r.i] = r.v
    n = max(out[1], 1)
    return out[0] / n, out[2:].reshape(weights.shape) / n


def _near_digits(batches):
    """The stretches of each text, with all that features look at, a row each."""
    for b in batches:
        cut = [t[max(0, s - 2) : e + 2] for t in b.column(0).to_pylist() for s, e in stretches(t)]
        yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string())], names=["text"])


def train(docs: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights (kinds, features) from a bounded sample of the texts with digits or @ signs and of the stretches in these."""
    texts = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    some = texts.select("h").distinct().orderBy("h").limit(SAMPLE)  # hashes only: copies count once
    rows = texts.join(F.broadcast(some), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    rows = rows.select("text").mapInArrow(_near_digits, "text string").select(F.xxhash64("text").alias("h"), "text")
    rows = written(rows.orderBy("h", "text").limit(STRETCHES).select("text").repartition(8, "text"), "sample")
    w = np.zeros((len(KINDS), len(FEATURES)))
    w[:, 0] = -2.0
    mean = square = 0.0
    for step in range(1, steps + 1):
        _, g = _gradient(rows, w)
        g = g - RIDGE * w
        mean, square = 0.8 * mean + 0.2 * g, 0.9 * square + 0.1 * g * g
        w = w + 0.5 * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.9**step)) + 1e-8)
    return w


def _text_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def found(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``.

    Counts and the digest are of the base spans; ``spans`` has all. Null texts count as empty; repeated rows each come out; null
    ids are kept; an empty table gives no rows.
    """
    weights = train(docs) if weights is None else weights
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                counts, digest, spans = [[] for _ in KINDS], [], []
                for text in part.column(1).to_pylist():
                    base, every = all_spans(text or "", weights)
                    for k, c in zip(KINDS, counts, strict=True):
                        c.append(sum(x[0] == k for x in base))
                    digest.append(hashlib.sha256(_text_of(base).encode()).hexdigest())
                    spans.append(_text_of(every))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=names)

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def masked_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or spans that overlap, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text``; a column ``n_chars`` is brought up to date. Null texts stay null, repeated
    rows each come out, an empty table stays empty. Rows travel as structs, so that columns may have any name."""
    weights = train(docs) if weights is None else weights

    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                row = b.column(0).slice(lo, 1000)
                parts = row.flatten()
                parts[at] = pa.array([None if t is None else masked_text(t, all_spans(t, weights)[1]) for t in parts[at].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, names=docs_columns)], names=["row"])

    docs_columns = docs.columns
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.mapInArrow(run, rows.schema)
    if "n_chars" in docs.columns:
        rows = rows.select(F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)).alias("row"))
    return rows.select("row.*")
