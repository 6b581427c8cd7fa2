"""Secrets by base patterns and by assignment-aware lexing.

The base patterns fix what is always reported. Lines that assign something are then lexed as source or
configuration syntax (``name = "literal"``, ``name: literal``, ``name => literal``, JSON pairs, XML attributes
and elements that hold one word, ``export``/``--name value`` forms) into name-literal pairs. Constants propagate: a name on the right side
stands for the literals assigned to it earlier in the text, so the sensitivity of ``db_password = K`` reaches
the literal of ``K = "..."``, also through sums of parts. A literal is scored by the most sensitive name that
it reaches and by its own form (length, character classes, entropy, placeholder words); from ``MIN_SCORE``
on it is a span of kind ``literal``, unless a base span covers it.

Defined cases: a null or empty text has no spans; equal texts have equal spans; every row gives a row, rows of
equal or null id each their own; a very long text takes time in proportion to its length; an empty table gives
no rows; further columns are ignored; offsets are code points.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import Taken, batch_of, bounded_batches, text_of

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")
MIN_SCORE = 1.0

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

# Parts of names and how much they tell.
_NAMES = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "private": 0.6, "key": 0.5, "auth": 0.6, "bearer": 0.8, "signing": 0.5, "access": 0.4, "license": 0.3, "salt": 0.5,
}
_DULL = {"example", "changeme", "placeholder", "dummy", "sample", "none", "null", "true", "false", "undefined", "todo", "xxxx", "your", "redacted"}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches that do not overlap, kind by kind; an assigned value under 12 characters drops its match."""
    lower = text.lower()
    found: list[tuple[str, int, int]] = []
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


# --- lexing ------------------------------------------------------------------------------------------

_LEX = re.compile(
    r"""(?P<quote>["'])|(?P<arrow>=>|:=|={2,3}|!=|<=|>=)|(?P<op>[=:+,;(){}\[\]<>])|(?P<dash>--[A-Za-z][\w-]*)"""
    r"""|(?P<word>[A-Za-z0-9_$/.@+~!%^&*-]+)|(?P<line>\n)|(?P<other>\S)"""
)
_ASSIGNS = ("=", ":", "=>", ":=")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>\s*([^<\s]+)\s*</\1\s*>")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


#: What a string holds after its quote, up to the quote that closes it or the line end.
_BODY = {q: re.compile(rf"[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+") for q in "\"'"}


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(sort, start, end) of all tokens; a quote that nothing closes is one by itself.

    Where nothing closes a quote, nothing closes the same quotes after it up to there (each of them is escaped),
    so a line is looked through once for each sort of quote.
    """
    open_to, at, more = {'"': 0, "'": 0}, 0, True
    while more:
        more = False
        for m in _LEX.finditer(text, at):
            start, end = m.span()
            if m.lastgroup != "quote":
                yield m.lastgroup, start, end
                continue
            quote = text[start]
            if start >= open_to[quote]:
                end = _BODY[quote].match(text, end).end()
                if text.startswith(quote, end):
                    yield "string", start, end + 1
                    at, more = end + 1, True
                    break
                open_to[quote] = end
            yield "other", start, start + 1


def assignments(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(name, its right side's strings and words as (sort, start, end)) in the order of the text."""
    before: tuple[str, int, int] | None = None
    name, parts, want = None, [], False
    for sort, start, end in tokens(text):
        value = text[start:end]
        if sort == "dash":  # --name value
            if name and parts:
                yield name, parts
            name, parts, want, before = value.lstrip("-"), [], True, None
            continue
        if (sort == "op" or sort == "arrow") and value in _ASSIGNS and before is not None:
            if name and parts:
                if parts[-1][1:] == before[1:]:
                    parts.pop()
                if parts:
                    yield name, parts
            inner = text[before[1] : before[2]]
            name, parts, want = inner.strip("\"'"), [], True
            before = None
            continue
        if sort in ("string", "word"):
            token = (sort, start, end)
            if want:
                parts.append(token)
                want = False
            before = token
            continue
        if name and sort == "op" and value == "+" and parts:
            want = True
            continue
        if name and sort == "op" and value in "([{" and want:  # a call's or list's first argument counts
            continue
        if name and (parts or sort == "line"):
            if parts:
                yield name, parts
            name, parts, want = None, [], False
        if sort == "line":
            before = None
    if name and parts:
        yield name, parts


def elements(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """The same for XML elements whose text is one word, of sort text."""
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            yield m.group(1), [("text", *m.span(2))]


def sensitivity(name: str) -> float:
    """The sum of what a name's parts tell, 1 at most."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = "".join(parts)
    total = sum(_NAMES.get(p, 0.0) for p in parts)
    if "apikey" in joined or "accesskey" in joined or "privatekey" in joined:
        total = 1.0
    return min(1.0, total)


def form(literal: str) -> float:
    """How far a literal looks like a generated secret, -1 to 1."""
    n = len(literal)
    if n < 8 or " " in literal or any(w in literal.lower() for w in _DULL) or literal.startswith(("http://", "https://", "${", "$(", "%(", "{{", "/")):
        return -1.0
    classes = sum((any(c.islower() for c in literal), any(c.isupper() for c in literal), any(c.isdigit() for c in literal), any(not c.isalnum() for c in literal)))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    if classes < 2 and n < 20:
        return -1.0
    return max(-1.0, min(1.0, 0.25 * (classes - 1) + 0.25 * (entropy - 2.5) + 0.02 * min(n - 8, 16)))


def literal_spans(text: str) -> list[tuple[str, int, int]]:
    if not any(c in text for c in "=:") and "--" not in text and "</" not in text:
        return []
    # a node for each assignment: its own literals, and the earlier assignments whose literals it stands for too
    nodes: list[tuple[list[tuple[int, int]], list[int]]] = []
    tells: list[float] = []
    known: dict[str, int] = {}
    for name, parts in heapq.merge(assignments(text), elements(text), key=lambda x: x[1][0][1]):
        literals, earlier = [], []
        for sort, a, b in parts:
            value = text[a:b]
            if sort == "word" and value in known:
                earlier.append(known[value])
            elif sort == "string":
                literals.append((a + 1, b - 1))
            elif sort == "text":
                literals.append((a, b))
            else:
                literals.append((a, a + len(value.rstrip(".,;"))))
        known[name] = len(nodes)
        nodes.append((literals, earlier))
        tells.append(sensitivity(name))
    reach: dict[tuple[int, int], float] = {}
    for i in range(len(nodes) - 1, -1, -1):  # what a name tells goes back to all that it stands for
        if tells[i] > 0:
            for x in nodes[i][0]:
                reach[x] = max(reach.get(x, 0.0), tells[i])
            for k in nodes[i][1]:
                tells[k] = max(tells[k], tells[i])
    found: list[tuple[str, int, int]] = []
    for (a, b), s in sorted(reach.items()):
        if b > a and s + form(text[a:b]) >= MIN_SCORE and not (found and a < found[-1][2]):  # an element's text may hold a pair
            found.append(("literal", a, b))
    return found


def all_spans(text: str) -> list[dict]:
    base = base_spans(text)
    found = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base]
    taken = Taken([(a, b) for _, a, b in base])
    found += [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in literal_spans(text) if not taken.overlaps(a, b)]
    found.sort(key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))
    return found


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def find_secrets(documents: DataFrame) -> DataFrame:
    """Per document all spans, by start, then kind; base tells the fixed patterns' spans from the lexer's."""
    bounded_batches(documents.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(_SPANS, {"doc_id": batch.column(0).to_pylist(), "spans": [all_spans(x.as_py()) for x in batch.column(1)]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(task, SPANS)
