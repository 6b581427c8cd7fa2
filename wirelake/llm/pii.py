"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns fix what is always reported. The field then looks at windows round whatever could be
personal data and cuts each window's tokens into segments: an entity of up to ``MAX_TOKENS`` tokens, or a
single token outside. Features describe a whole candidate segment (digit groups, checksum, separators,
edges, the cue word before it), so boundaries and kinds are chosen together by one dynamic programme over
(end, kind) with bounded entity length. Its weights come from maximum likelihood by forward-backward sums
over windows of a bounded sample, with base matches and altered copies of them as the truth.

Windows are found in whole texts, so nothing depends on a text's length but time.

Defined cases: a null or empty text has no spans; equal texts have equal spans; every row gives a row, rows of
equal or null id each their own; a very long text takes time in proportion to its length; an empty table trains
on the altered copies of built-in examples alone; further columns are ignored; offsets are code points.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import Taken, batch_of, bounded_batches, text_of

KINDS = ("email", "ip", "card", "phone")
#: Documents at most that the weights are learnt from, taken in the order of a hash of doc_id.
TRAIN_DOCS = 4000
TRAIN_WINDOWS = 300
#: Altered copies of each built-in example that holds an entity.
COPIES = 40
MAX_TOKENS = 16
#: Characters round a trigger that a window holds.
BEFORE, AFTER = 48, 48
#: Characters from which a run of triggers is cut into several windows.
RUN = 1500

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The matches of IP, tried only where a run of digits begins (a later digit of it leads no further) and never given back.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")

_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|\((?:at|dot)\)|\[(?:at|dot)\]|(?<=\s)dot(?=\s)")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
# Words before a value that tell its kind.
_CUES = {
    "email": {"email", "mail", "mailto", "contact", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "addr", "from"},
    "card": {"card", "visa", "credit", "mastercard", "amex", "karte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "cell", "telefon", "telefono"},
}


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches that do not overlap, kind by kind; those failing their check are dropped."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *m.span()) for m in _emails(text)]
    if not _DIGIT.search(text):
        return found
    if text.count(".") >= 3:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")


def _emails(text: str) -> Iterator[re.Match]:
    """The matches of EMAIL, tried only where the characters before an @ begin: no other place can match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


# --- the field ---------------------------------------------------------------------------------------


@dataclass
class Window:
    text: str
    tokens: list[tuple[int, int]]
    segments: list[tuple[int, int]]  # first token, end token
    features: np.ndarray  # segments x features


def windows(text: str) -> Iterator[tuple[int, str, int, int]]:
    """(offset, text, start, end) round all triggers; overlapping ones are one window, cut at spaces.

    A run of over RUN characters is cut at each end; there the window goes on by more tokens than an entity
    may have. Start and end bound the window's own part: its spans are those that begin there.
    """
    lo = hi = 0
    inside = False  # lo is a cut inside a run
    for m in _TRIGGER.finditer(text):
        apart = hi == 0 or m.start() - BEFORE > hi
        if apart or hi - lo > RUN:
            if hi:
                yield _padded(text, lo, hi, inside, not apart)
            inside = not apart
            lo = hi if inside else max(hi, m.start() - BEFORE)
            while not inside and 0 < lo < m.start() and not text[lo - 1].isspace():
                lo += 1
        hi = max(hi, min(len(text), m.end() + AFTER))
        while hi < len(text) and hi < m.end() + AFTER + 24 and not text[hi].isspace():
            hi += 1
    if hi:
        yield _padded(text, lo, hi, inside, False)


def _padded(text: str, lo: int, hi: int, left: bool, right: bool) -> tuple[int, str, int, int]:
    """The window of the part from lo to hi, with MAX_TOKENS tokens and one more beyond each end that is a cut."""
    start, end, size = lo, hi, 256
    while left and start:
        start = max(0, lo - size)
        before = [m.start() + start for m in _TOKEN.finditer(text[start:lo])]
        if len(before) > MAX_TOKENS + 1:  # the first may be the rest of a longer one
            start = before[-MAX_TOKENS - 1]
            break
        size *= 2
    if right:
        for _, m in zip(range(MAX_TOKENS + 1), _TOKEN.finditer(text, hi)):
            end = m.end()
    return start, text[start:end], lo, hi


N_FEATURES = 37


def _features(text: str, start: int, end: int, cue: str) -> list[int]:
    """The features of the whole span that hold, as numbers below N_FEATURES."""
    span = text[start:end]
    groups = _DIGIT_RUNS.findall(span)
    n = sum(map(len, groups))
    on = [0, 1 if n == 0 else 2 if n < 8 else 33 if n == 8 else 34 if n == 9 else 3 if n < 12 else 4 if n <= 15 else 5 if n <= 19 else 6]
    letters = any(c.isalpha() for c in span)
    marks = {c for c in span if not c.isalnum()}
    at = span.count("@")
    worded = bool(_AT_WORD.search(span))
    dotted = "." in marks or bool(_DOT_WORD.search(span))
    on.append(7 if at == 1 else 8 if at else 9 if worded else 10)
    if (at == 1 or worded) and dotted and span[-1].isalpha():
        on.append(11)
    if len(groups) == 4 and not letters and all(_small(g) for g in groups):
        on.append(12 if marks <= {"."} else 13)
    if not letters and 16 <= n <= 19:
        on.append(14 if luhn("".join(groups)) else 15)
    if not letters and 8 <= n <= 15:
        on.append(16 if span[0] in "+(" else 17)
    if letters and not at and not worded:
        on.append(18)
    if letters and _INNER_SPACE.search(_WORDED.sub("", span)):
        on.append(35)  # more words than an address is written with
    if worded and _ADDRESS.fullmatch(span):
        on.append(36)
    on.append(19 if not marks else 20 if len(marks - {" "}) <= 1 else 21 if not marks - set(" +().-") else 22)
    on.append(23 if span[0].isdigit() else 24 if span[0] in "+(" else 25 if span[0].isalpha() else 26)
    clean = (start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "+@._-")) and (end == len(text) or not (text[end].isalnum() or text[end] in "@_-"))
    on.append(27 if clean else 28)
    for i, kind in enumerate(KINDS):
        if cue in _CUES[kind]:
            on.append(29 + i)
    return on


_DIGIT_RUNS = re.compile(r"[0-9]+")
_AT_WORD = re.compile(r"\((?:at)\)|\[(?:at)\]|\sat\s")
_WORDED = re.compile(r"\s*(?:\((?:at|dot)\)|\[(?:at|dot)\])\s*|\s(?:at|dot)(?=\s)\s")
_INNER_SPACE = re.compile(r"\s")
#: The shape of a written-out address as a whole.
_ADDRESS = re.compile(r"[\w.%+-]++\s*(?:\(at\)|\[at\]|(?<=\s)at(?=\s))\s*[\w-]++(?:\s*(?:\.|\((?:dot)\)|\[(?:dot)\]|(?<=\s)dot(?=\s))\s*[\w-]++)++")
_DOT_WORD = re.compile(r"\((?:dot)\)|\[(?:dot)\]|\sdot\s")


def window_of(text: str) -> Window:
    """Tokens of a window and the segments that could be an entity: clean edges, a digit or at sign inside."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    n = len(tokens)
    carries = [bool(_TRIGGER.match(text, a)) for a, _ in tokens]
    gap = [i > 0 and tokens[i][0] - tokens[i - 1][1] for i in range(n)]
    segments, rows = [], []
    cue = ""
    for i, (a, b) in enumerate(tokens):
        first = text[a]
        glued = i > 0 and not gap[i] and (text[a - 1].isalnum() or text[a - 1] in "@._+-")
        if not glued and (first.isdigit() or first in "+(" or first.isalpha()):
            carried, words = False, 0
            for j in range(i, min(n, i + MAX_TOKENS)):
                if j > i and (gap[j] > 2 or "\n" in text[tokens[j - 1][1] : tokens[j][0]]):
                    break
                carried |= carries[j]
                words += text[tokens[j][0]].isalpha() and (j == i or bool(gap[j]))
                if words > 9:
                    break
                end = tokens[j][1]
                if not carried or not text[end - 1].isalnum() or (end < len(text) and text[end].isalnum()):
                    continue
                if first.isalpha() and not ("@" in text[a:end] or _AT_WORD.search(text[a:end])):
                    continue
                segments.append((i, j + 1))
                row = np.zeros(N_FEATURES)
                row[_features(text, a, end, cue)] = 1
                rows.append(row)
        if first.isalpha():
            cue = text[a:b].lower()
    return Window(text, tokens, segments, np.array(rows) if rows else np.zeros((0, N_FEATURES)))


class Field:
    """Weights: of span features by kind, of a kind after another (0: outside), of an outside token."""

    def __init__(self):
        k = len(KINDS)
        self.spans, self.steps = np.zeros((N_FEATURES, k)), np.zeros((k + 1, k + 1))

    def _by_end(self, w: Window) -> list[list[tuple[int, int]]]:
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(w.tokens) + 1)]
        for s, (i, j) in enumerate(w.segments):
            ends[j].append((i, s))
        return ends

    def best(self, w: Window) -> list[tuple[str, int, int]]:
        """The best segmentation's entities, as (kind, start, end) in the window's text."""
        n, k = len(w.tokens), len(KINDS)
        if not w.segments:
            return []
        scores, ends = (w.features @ self.spans).tolist(), self._by_end(w)
        steps = self.steps.tolist()
        best = [[0.0] + [-math.inf] * k] + [[-math.inf] * (k + 1) for _ in range(n)]
        back: list[list] = [[None] * (k + 1) for _ in range(n + 1)]
        for t in range(1, n + 1):
            best[t][0], back[t][0] = max((best[t - 1][y] + steps[y][0], (t - 1, y)) for y in range(k + 1))
            for i, s in ends[t]:
                for y in range(k):
                    top, prev = max((best[i][z] + steps[z][y + 1], z) for z in range(k + 1))
                    if top + scores[s][y] > best[t][y + 1]:
                        best[t][y + 1], back[t][y + 1] = top + scores[s][y], (i, prev)
        t, y, found = n, max(range(k + 1), key=lambda z: best[n][z]), []
        while t:
            i, z = back[t][y]
            if y:
                found.append((KINDS[y - 1], w.tokens[i][0], w.tokens[t - 1][1]))
            t, y = i, z
        return found[::-1]

    def gradient(self, w: Window, truth: dict[int, int], spans: np.ndarray, steps: np.ndarray) -> float:
        """Adds the log likelihood's gradient of one window to spans and steps. truth: kind by segment."""
        n, k = len(w.tokens), len(KINDS)
        scores, ends = w.features @ self.spans, self._by_end(w)
        fwd = np.full((n + 1, k + 1), -np.inf)
        fwd[0, 0] = 0
        edges = []
        for t in range(1, n + 1):
            fwd[t, 0] = np.logaddexp.reduce(fwd[t - 1] + self.steps[:, 0])
            for i, s in ends[t]:
                into = np.logaddexp.reduce(fwd[i][:, None] + self.steps[:, 1:], axis=0) + scores[s]
                fwd[t, 1:] = np.logaddexp(fwd[t, 1:], into)
                edges.append((i, t, s))
        bwd = np.full((n + 1, k + 1), -np.inf)
        bwd[n] = 0
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for i, t, s in edges:
            starts[i].append((t, s))
        for i in range(n - 1, -1, -1):
            bwd[i] = self.steps[:, 0] + bwd[i + 1, 0]
            for t, s in starts[i]:
                bwd[i] = np.logaddexp(bwd[i], np.logaddexp.reduce(self.steps[:, 1:] + scores[s] + bwd[t, 1:], axis=1))
        total = np.logaddexp.reduce(fwd[n])
        for i in range(n):
            steps[:, 0] -= np.exp(fwd[i] + self.steps[:, 0] + bwd[i + 1, 0] - total)
        for i, t, s in edges:
            p = np.exp(fwd[i][:, None] + self.steps[:, 1:] + scores[s] + bwd[t, 1:] - total)
            steps[:, 1:] -= p
            spans -= np.outer(w.features[s], p.sum(axis=0))
        by_first = {w.segments[s][0]: (w.segments[s][1], s, y) for s, y in truth.items()}
        t, y, gold = 0, 0, 0.0
        while t < n:
            end, s, z = by_first.get(t, (t + 1, None, -1))
            steps[y, z + 1] += 1
            gold += self.steps[y, z + 1]
            if s is not None:
                spans[:, z] += w.features[s]
                gold += scores[s, z]
            t, y = end, z + 1
        return float(gold - total)


def altered(text: str, spans: list[tuple[str, int, int]], rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A copy in which some entities are written in ways that the base patterns miss; the spans follow."""
    out, shifted, done = [], [], 0
    size = 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < done:
            continue
        value = text[a:b]
        if kind == "email":
            value = value.replace("@", rng.choice([" at ", " (at) ", "[at]", "@"])).replace(".", rng.choice([" dot ", "(dot)", "."]))
        elif kind == "phone":
            d = digits_of(value)
            value = rng.choice([value[1:], f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", value])
        elif kind == "card":
            d = digits_of(value)
            value = rng.choice([".", "/", "  "]).join(d[i : i + 4] for i in range(0, len(d), 4)).strip() if rng.random() < 0.7 else value
        elif kind == "ip":
            value = value.replace(".", rng.choice(["[.]", ".", " . "]))
        value = value.strip()
        part = text[done:a]
        out += [part, value]
        shifted.append((kind, size + len(part), size + len(part) + len(value)))
        size += len(part) + len(value)
        done = b
    out.append(text[done:])
    return "".join(out), shifted


# Examples that the field knows even where the sample holds none.
_EXAMPLES = (
    "please write to jane.doe@example.com for more",
    "the host 192.0.2.17 was seen again",
    "paid with card 4111111111111111 last week",
    "call me at +1 (212) 555-0143 after five",
    "order 48213 of 2021 came with 12 parts",
    "token = 5f2a9c41d07b6e38 in the file v1.2.3",
    "released 2020-10-11 as version 1.2.3",
    "between 2019-01-31 and 2021-03-04 or on 12.05.2021",
    "at 10:42:17 on 2024-02-29 there were 1,204,331 rows",
)


def train(texts: list[str], seed: int = 7, rounds: int = 12) -> Field:
    """Maximum likelihood with a small penalty, by AdaGrad steps over windows in a seeded order."""
    rng = random.Random(seed)
    examples: list[tuple[Window, dict[int, int]]] = []

    def take(text: str, spans: list[tuple[str, int, int]]) -> None:
        w, truth = window_of(text), {}
        at = {(w.tokens[i][0], w.tokens[j - 1][1]): s for s, (i, j) in enumerate(w.segments)}
        done = -1
        for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
            if a >= done and (s := at.get((a, b))) is not None:
                truth[s], done = KINDS.index(kind), b
        if w.segments:
            examples.append((w, truth))

    texts = sorted(texts)
    for text in _EXAMPLES:  # as often as the ways of writing need, whatever the sample holds
        for _ in range(COPIES if base_spans(text) else 0):
            take(*altered(text, base_spans(text), rng))
    for text in [*_EXAMPLES, *(rng.sample(texts, TRAIN_WINDOWS) if len(texts) > TRAIN_WINDOWS else texts)]:
        spans = base_spans(text)
        take(text, spans)
        if spans:
            take(*altered(text, spans, rng))
            take(*altered(text, spans, rng))
    field = Field()
    sums, step_sums = np.full_like(field.spans, 1e-2), np.full_like(field.steps, 1e-2)
    for _ in range(rounds):
        rng.shuffle(examples)
        for k in range(0, len(examples), 16):
            spans, steps = -0.002 * field.spans, -0.002 * field.steps
            for w, truth in examples[k : k + 16]:
                field.gradient(w, truth, spans, steps)
            sums += spans**2
            step_sums += steps**2
            field.spans += 0.5 * spans / np.sqrt(sums)
            field.steps += 0.5 * steps / np.sqrt(step_sums)
    return field


def fit(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Learn from the windows of at most train_docs documents; only short windows reach the driver."""
    bounded_batches(documents.sparkSession)
    order = F.xxhash64(F.col("doc_id").cast("long"))
    last = documents.select(order.alias("h")).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    if last is None:
        return train([])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"window": [w for text in batch.column(0).to_pylist() for _, w, _, _ in windows(text) if len(w) <= 400]}, schema=pa.schema([("window", pa.string())]))

    kept = documents.filter(order <= last).select(text_of().alias("text")).mapInArrow(task, "window string")
    rows = kept.groupBy("window").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("window"), "window").limit(TRAIN_WINDOWS).collect()
    return train([r[0] for r in rows])


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def all_spans(text: str, field: Field) -> list[dict]:
    base = base_spans(text)
    found = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base]
    taken = Taken([(a, b) for _, a, b in base])
    done = 0
    for at, part, start, end in windows(text):
        for kind, a, b in field.best(window_of(part)):
            if not max(start, done) <= at + a < end:
                continue
            done = at + b
            if not taken.overlaps(at + a, at + b):
                found.append({"kind": kind, "start": at + a, "end": at + b, "base": False})
    found.sort(key=lambda x: (KINDS.index(x["kind"]), x["start"], x["end"]))
    return found


def find_personal_data(documents: DataFrame, field: Field) -> DataFrame:
    """Per document all spans, by kind, then start; base tells the fixed patterns' spans from the field's."""
    bounded_batches(documents.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(_SPANS, {"doc_id": batch.column(0).to_pylist(), "spans": [all_spans(x.as_py(), field) for x in batch.column(1)]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(task, SPANS)
