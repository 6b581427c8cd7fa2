"""Toxicity by a convolutional text classifier, trained in numpy.

A word is embedded as the sum of hashed rows: one of the whole word, one of each run of ``GRAM`` bytes in it
(ends marked), so compounds of a telling stem are known too. Filters of several widths run over the word vectors of the whole text; each filter's largest response over all
positions goes into a logistic layer. Only the positions of those largest responses pass gradients back, so
embeddings of words that never mattered stay zero and words never seen say nothing.

A first model, fitted in the driver on a bounded part of the labelled rows, only gives the start: ``PASSES`` over all
labelled rows follow, in which Spark sums their gradients and their scores by label, and each moves the model. The model of the
least loss over all rows counts. A part of the rows, left out of the fitting, calibrates a decision threshold for
each language from counts of all their scores; the score itself depends on the text alone.

Defined cases: a null or empty text scores as a text of no words; equal texts score the same; without
training rows of both labels every score is 0; languages without enough calibration rows, and null, use the
threshold over all languages; rows without a label are never learnt from; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import batch_of, bounded_batches, column_or_null, few, text_of, written

#: Labelled rows at most that the first model is fitted on: toxic ones, and clean ones.
TRAIN_TOXIC, TRAIN_CLEAN = 1000, 2500
#: Characters at most of all their texts: rows are taken in their order while they fit as a whole.
TRAIN_CHARS = 100_000_000
ROWS = 1 << 18
GRAM = 5
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PAD = max(WIDTHS) - 1
#: Passes over all labelled rows; each but the last moves the model, by so much at most in a number.
PASSES, TABLE_RATE, RATE = 2, 0.05, 0.01
#: Scores are counted in so many steps; sums over all rows are whole numbers of 1 / UNIT, so their order is nothing to them.
STEPS, UNIT = 10_000, 1 << 24
#: predicted is 1 from this score on.
CUT = 0.7
#: Words that a task's memory of word vectors holds before it starts anew.
REMEMBERED = 400_000

_SPACE = bytes.maketrans(bytes(range(65, 91)) + bytes(i for i in range(128) if not chr(i).isalnum()), bytes(range(97, 123)) + b" " * sum(not chr(i).isalnum() for i in range(128)))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between white space and ASCII punctuation."""
    return text.encode("utf-8", "replace").translate(_SPACE).split()


_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words, one word's after another's, and where each word's begin."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(b"".join(b"<%s>" % w for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(size) - size
    within = np.arange(len(b)) - np.repeat(first, size)
    whole = np.add.reduceat(b * _POWERS[within % 256], first)
    grams = np.maximum(1, size - GRAM + 1)  # a short word has one gram: itself
    starts = np.cumsum(grams + 1) - (grams + 1)
    at = np.repeat(first - starts - 1, grams + 1) + np.arange(int((grams + 1).sum()))  # of a gram; a word's first row is the whole word
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([b, np.zeros(GRAM, np.uint64)])
    ends = np.repeat(first + size, grams + 1)
    for j in range(GRAM):
        inside = at + j < ends
        h = h * np.uint64(0x100000001B3) + np.where(inside, padded[np.maximum(at, 0) + j], 0)
    h[starts] = whole
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(46)).astype(np.int64), starts


def vectors(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[rows], starts, axis=0) if len(starts) else np.zeros((0, table.shape[1]), np.float32)


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # width x DIM x FILTERS each
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict = field(default_factory=dict)  # by language; None: over all
    fitted: bool = True

    def pooled(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest response of every filter in each text. x: word vectors, PAD + 1 zero rows after each text."""
        found = []
        ends = np.append(starts[1:], len(x))
        for k, w in enumerate(self.filters):
            a = x @ w[0]
            for j in range(1, len(w)):
                a[:-j] += x[j:] @ w[j]
            for j in range(1, PAD + 1):  # places from which a filter would reach into the next text: nothing lies there
                a[ends - j] = 0
            found.append(np.maximum.reduceat(a, starts, axis=0) + self.bias[k])
        return np.maximum(np.concatenate(found, axis=1), 0)

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = self.pooled(x, starts) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.thresholds.get(None, CUT))


class Scorer:
    """Scores batches of texts, remembering the vectors of words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.vectors = np.zeros((1, DIM), np.float32)  # row 0: padding

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.model.fitted:
            return np.zeros(len(texts))
        ids, starts = self.laid_out(texts)
        return self.model.scores(self.vectors[ids], starts)

    def laid_out(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of vectors for all words, PAD + 1 of padding after each text, and where each text begins."""
        if len(self.known) > REMEMBERED:
            self._clear()
        lists = [words_of(t) for t in texts]
        new = list(dict.fromkeys(w for ws in lists for w in ws if w not in self.known))
        if new:
            first = len(self.vectors)
            self.vectors = np.concatenate([self.vectors, vectors(self.model.table, *hashed(new))])
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        starts = np.cumsum([0] + [len(ws) + PAD + 1 for ws in lists])
        ids = np.zeros(starts[-1], np.int64)
        for ws, at in zip(lists, starts, strict=False):
            ids[at : at + len(ws)] = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
        return ids, starts[:-1]


class Gradients(Scorer):
    """Sums over texts: of the gradients of the log loss, of their squares, of the texts that they could come from; of the loss.

    Without steps, which no model is moved by, of the loss alone.
    """

    def __init__(self, model: Model, weight: float, steps: bool = True):
        self.weight, self.steps, self.loss, self.texts = weight, steps, 0.0, 0
        if steps:
            self.dense = np.zeros((3, len(flat(model))))
            self.rows = np.zeros((ROWS, DIM + 2))
        super().__init__(model)

    def _clear(self) -> None:
        if self.steps and getattr(self, "known", None):
            rows, starts = hashed(list(self.known))
            held = np.diff(np.append(starts, len(rows)))
            np.add.at(self.rows, rows, np.repeat(self.words[1 : len(held) + 1], held, axis=0))
        super()._clear()
        self.words = np.zeros((1, DIM + 2))

    def add(self, texts: list[str], labels: np.ndarray) -> None:
        m = self.model
        ids, starts = self.laid_out(texts)
        if self.steps and len(self.words) < len(self.vectors):
            self.words = np.concatenate([self.words, np.zeros((len(self.vectors) - len(self.words), DIM + 2))])
        x = self.vectors[ids]
        ends = np.append(starts[1:], len(x))
        which = np.repeat(np.arange(len(texts)), ends - starts)
        tops, found = [], []
        for k, w in enumerate(m.filters):
            a = x @ w[0]
            for j in range(1, len(w)):
                a[:-j] += x[j:] @ w[j]
            for j in range(1, PAD + 1):
                a[ends - j] = 0
            most = np.maximum.reduceat(a, starts, axis=0)
            if self.steps:
                at, f = np.nonzero(a == most[which])
                _, first = np.unique(which[at] * FILTERS + f, return_index=True)  # of equal responses the first
                tops.append(at[first].reshape(len(texts), FILTERS))
            found.append(most + m.bias[k])
        z = np.maximum(np.concatenate(found, axis=1), 0).astype(np.float64)
        u = np.clip(z @ m.out + m.shift, -30, 30)
        worth = np.where(labels == 1, self.weight, 1.0)
        self.loss += float((worth * np.logaddexp(0, np.where(labels == 1, -u, u))).sum())
        self.texts += len(texts)
        if not self.steps:
            return
        g = (1 / (1 + np.exp(-u)) - labels) * worth
        back = g[:, None] * m.out * (z > 0)
        parts = []
        for k, w in enumerate(m.filters):
            b = back[:, k * FILTERS : (k + 1) * FILTERS]
            open_ = z[:, k * FILTERS : (k + 1) * FILTERS] > 0
            for j in range(len(w)):
                grads = x[tops[k] + j].transpose(0, 2, 1) * b[:, None, :]  # texts x DIM x FILTERS
                parts.append((grads.sum(0), (grads**2).sum(0), np.broadcast_to(open_.sum(0), w[j].shape)))
                word = ids[tops[k] + j]
                live = (word > 0) & open_
                moved = (b[:, :, None] * w[j].T)[live]
                np.add.at(self.words, word[live], np.concatenate([moved, (moved**2).sum(1, keepdims=True), np.ones((len(moved), 1))], axis=1))
        parts.append((back.sum(0), (back**2).sum(0), (z > 0).sum(0)))
        parts.append(((g[:, None] * z).sum(0), ((g[:, None] * z) ** 2).sum(0), np.full(z.shape[1], len(g))))
        parts.append((g.sum(), (g * g).sum(), len(g)))
        self.dense += np.stack([np.concatenate([np.ravel(part[i]) for part in parts]) for i in range(3)])

    def sums(self) -> dict[tuple[str, int], list[float]]:
        if not self.steps:
            return {("loss", 0): [self.loss, float(self.texts), *[0.0] * DIM]}
        self._clear()
        found = {("row", int(i)): self.rows[i].tolist() for i in np.flatnonzero(self.rows[:, -1])}
        found |= {("dense", i): [*column, *[0.0] * (DIM - 1)] for i, column in enumerate(self.dense.T.tolist())}
        return found | {("loss", 0): [self.loss, float(self.texts), *[0.0] * DIM]}


def flat(m: Model) -> np.ndarray:
    """Filters, bias, output and shift of a model in one row."""
    return np.concatenate([*(w.ravel() for w in m.filters), m.bias.ravel(), m.out, [m.shift]])


def agreed(mean: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Mean over root mean square, from -1 to 1; gradients far below 1e-3 count for little, as sums in UNIT tell nothing of their squares."""
    return np.clip(mean / (np.sqrt(square) + 1e-3), -1, 1)


def row_steps(rows: np.ndarray) -> np.ndarray:
    """By how much rows of the table move, from their sums."""
    n = rows[:, -1:]
    return (TABLE_RATE * agreed(rows[:, :DIM] / n, rows[:, DIM : DIM + 1] / n)).astype(np.float32)


def moved(m: Model, rows: np.ndarray, at: np.ndarray, dense: np.ndarray) -> Model:
    """The model after one step: each number moves by its gradients' mean over their root mean square, times the rate.

    So what all rows agree on moves by the rate, and what few of many rows ask for moves little. rows: row_steps of the table's rows at.
    """
    table = m.table.copy()
    table[at] -= rows
    n = np.maximum(dense[:, 2], 1)
    values = flat(m) - RATE * agreed(dense[:, 0] / n, dense[:, 1] / n)
    ends = np.cumsum([w.size for w in m.filters] + [m.bias.size, m.out.size])
    parts = np.split(values, ends)
    filters = [p.reshape(w.shape).astype(np.float32) for p, w in zip(parts, m.filters, strict=False)]
    return Model(table, filters, parts[-3].reshape(m.bias.shape).astype(np.float32), parts[-2].astype(np.float32), float(parts[-1][0]))


def train(examples: list[tuple[tuple[np.ndarray, np.ndarray], int]], seed: int = 11, steps: int = 12_000) -> Model:
    """AdaGrad steps on the log loss, one text at a time, in a seeded order; words are left out at random.

    Every text is seen four times at least, more often where there are few.
    """
    rng = np.random.default_rng(seed)
    k = len(WIDTHS)
    m = Model(np.zeros((ROWS, DIM), np.float32), [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros((k, FILTERS), np.float32), rng.uniform(0.2, 0.6, k * FILTERS).astype(np.float32), -1.0)
    m.bias += 0.05
    sums = {"table": np.full(ROWS, 1e-2, np.float32), "out": np.full_like(m.out, 1e-2), "bias": np.full_like(m.bias, 1e-2), "shift": 1e-2}
    filter_sums = [np.full_like(w, 1e-1) for w in m.filters]
    positive = sum(y for _, y in examples)
    weight = (len(examples) - positive) / max(1, positive)
    rounds = max(4, min(40, steps // max(1, len(examples))))
    for turn in range(rounds):
        rate = 0.3 / (1 + 4 * turn / rounds)
        for i in rng.permutation(len(examples)):
            (rows, starts), y = examples[i]
            kept = np.flatnonzero(rng.random(len(starts)) < 0.8)
            ends = np.append(starts[1:], len(rows))
            n = len(kept)
            x = np.zeros((n + PAD + 1, DIM), np.float32)
            x[:n] = vectors(m.table, rows, starts)[kept]
            tops, found = [], []
            for q, w in enumerate(m.filters):
                a = x @ w[0]
                for j in range(1, len(w)):
                    a[:-j] += x[j:] @ w[j]
                top = a.argmax(axis=0)
                tops.append(top)
                found.append(a[top, range(FILTERS)] + m.bias[q])
            z = np.maximum(np.concatenate(found), 0)
            p = 1 / (1 + np.exp(-float(np.clip(z @ m.out + m.shift, -30, 30))))
            g = (p - y) * (weight if y else 1.0)
            if abs(g) < 1e-3:
                continue
            back = g * m.out * (z > 0)
            sums["out"] += (g * z) ** 2
            m.out -= rate * (g * z + 1e-4 * m.out) / np.sqrt(sums["out"])
            sums["shift"] += g * g
            m.shift -= rate * g / sums["shift"] ** 0.5
            for q, w in enumerate(m.filters):
                b = back[q * FILTERS : (q + 1) * FILTERS]
                sums["bias"][q] += b * b
                m.bias[q] -= rate * b / np.sqrt(sums["bias"][q])
                for j in range(len(w)):
                    at = tops[q] + j
                    grad = x[at].T * b  # DIM x FILTERS
                    filter_sums[q][j] += grad * grad
                    words = w[j].T * b[:, None]  # FILTERS x DIM
                    w[j] -= rate * 0.3 * grad / np.sqrt(filter_sums[q][j])
                    live = (at < n) & (b != 0)
                    for t, d in zip(kept[at[live]], words[live], strict=True):
                        own = rows[starts[t] : ends[t]]
                        sums["table"][own] += float(d @ d)
                        m.table[own] -= 0.5 * rate * d / np.sqrt(sums["table"][own])[:, None]
    return m


def calibrated(m: Model, counts: list[tuple[str | None, int, int, int]], least: int = 5) -> Model:
    """Thresholds by language: the middle of the widest gap of scores that has the best F1 there.

    counts: of all calibrating rows by lang and score (in STEPS): how many are toxic, how many clean.
    """
    for lang in {None, *(x[0] for x in counts)}:
        by_score: dict[int, list[int]] = {}
        for at, step, toxic, clean in counts:
            if lang is None or at == lang:
                own = by_score.setdefault(step, [0, 0])
                own[0], own[1] = own[0] + toxic, own[1] + clean
        steps = sorted(by_score)
        positive, total = sum(x[0] for x in by_score.values()), sum(map(sum, by_score.values()))
        if positive < least or total - positive < least:
            continue
        best = (-1.0, 0.0, CUT)
        bounds = [0.0, *(x / STEPS for x in steps), 1.0]
        right, called = positive, total
        for i in range(len(steps) + 1):  # from the i-th score on, all are called toxic
            f1 = 2 * right / (called + positive)
            gap = bounds[i + 1] - bounds[i]
            if (f1, gap) > best[:2]:
                best = (f1, gap, min(0.95, max(0.3, (bounds[i] + bounds[i + 1]) / 2)))
            if i < len(steps):
                toxic, clean = by_score[steps[i]]
                right, called = right - toxic, called - toxic - clean
        m.thresholds[lang] = best[2]
    return m


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, most_toxic: int = TRAIN_TOXIC, most_clean: int = TRAIN_CLEAN, most_chars: int = TRAIN_CHARS) -> Model:
    """Fit on all labelled rows but held-out ones, from a start on at most so many rows and characters in the order of a hash of doc_id.

    The labelled texts are written once and read in each pass; sums alone come to the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    known = few(known, "labels")
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic"))
    picked = known.filter("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(known.filter("toxic = 0").orderBy(*order).limit(most_clean))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), column_or_null(documents, "lang", "string").alias("lang"))
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most_toxic + most_clean)
    so_far = F.sum(F.char_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # of most_toxic + most_clean rows
    rows = rows.withColumn("_so_far", so_far).filter(F.col("_so_far") <= most_chars).toLocalIterator()
    examples = [(r["doc_id"], (tuple(x.astype(np.int32) for x in hashed(words_of(r["text"]))), r["toxic"])) for r in rows]
    kept = [x for i, x in enumerate(examples) if i % 5]
    if len({y for _, (_, y) in kept}) < 2:
        return Model(np.zeros((2, DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0, fitted=False)
    # a fifth calibrates: of the start's rows those left out, of all others by a hash
    started = {doc_id for doc_id, _ in kept}
    beside = {doc_id for doc_id, _ in examples} - started
    listed = lambda ids: F.col("doc_id").isin(*sorted(ids)) if ids else F.lit(False)
    role = F.when(listed(started), False).when(listed(beside), True).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0)
    labelled = written(texts.join(known, "doc_id").select("toxic", role.alias("calibrates"), "lang", "text"), "labelled")
    counts = {r["toxic"]: r["n"] for r in labelled.filter("NOT calibrates").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model, best = train([x for _, x in kept]), None
    del examples, kept  # the driver holds no text's hashes beside the sums
    for turn in range(PASSES):
        sums = _summed(labelled, model, counts.get(0, 0) / max(1, counts.get(1, 0)), steps=turn < PASSES - 1)
        if best is None or sums["loss"] < best[0]:
            best = (sums["loss"], model, sums["scores"])
        if turn < PASSES - 1:
            model = moved(model, sums["rows"], sums["at"], sums["dense"])
    return calibrated(best[1], best[2])


_SUMS = pa.schema([("kind", pa.string()), ("at", pa.int64()), ("lang", pa.string()), *((f"v{i}", pa.int64()) for i in range(DIM + 2))])


_STEPS = pa.schema([("at", pa.int64()), *((f"v{i}", pa.float32()) for i in range(DIM))])


def _summed(labelled: DataFrame, model: Model, weight: float, steps: bool = True) -> dict:
    """Over all labelled rows: loss, counts of scores, and, with steps, those of the table (rows, at which rows) and sums of gradients of all other numbers.

    The sums are written, and the table's steps are worked out where they lie, so that the driver gets nothing but these.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Gradients(shared.value, weight, steps)
        plain, scores = Scorer(shared.value), {}
        for batch in batches:
            toxic, calibrates, langs, texts = (batch.column(i).to_pylist() for i in range(4))
            for role in (False, True):
                chosen = [i for i, c in enumerate(calibrates) if c == role]
                while chosen:
                    size, part = 0, []
                    while chosen and (not part or size + len(texts[chosen[-1]]) <= 2_000_000):
                        part.append(chosen.pop())
                        size += len(texts[part[-1]])
                    if not role:
                        own.add([texts[i] for i in part], np.array([toxic[i] for i in part]))
                        continue
                    for i, score in zip(part, plain.score([texts[i] for i in part]).tolist(), strict=True):
                        scores.setdefault((round(score * STEPS), langs[i]), [0] * (DIM + 2))[1 - toxic[i]] += 1
        sums = own.sums()
        found = [(kind, at, None, [round(v * UNIT) for v in values]) for (kind, at), values in sums.items()] + [("score", step, lang, values) for (step, lang), values in scores.items()]
        for i in range(0, len(found), 20_000):
            part = found[i : i + 20_000]
            columns = {"kind": [x[0] for x in part], "at": [x[1] for x in part], "lang": [x[2] for x in part]}
            yield batch_of(_SUMS, columns | {f"v{j}": [x[3][j] for x in part] for j in range(DIM + 2)})

    kinds = "kind string, at long, lang string, " + ", ".join(f"v{i} long" for i in range(DIM + 2))
    total = written(labelled.mapInArrow(task, kinds).groupBy("kind", "at", "lang").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM + 2))), "sums")
    shared.destroy()
    other = total.filter("kind <> 'row'").toArrow()
    kind, at = np.array(other["kind"].to_pylist(), dtype=object), other["at"].to_numpy()
    values = np.stack([other[f"v{i}"].to_numpy() for i in range(DIM + 2)], axis=1)
    scored, langs = np.flatnonzero(kind == "score"), other["lang"].to_pylist()
    found = {"loss": int(values[kind == "loss", 0].sum()), "scores": [(langs[i], int(at[i]), int(values[i, 0]), int(values[i, 1])) for i in scored]}
    if not steps:
        return found

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = row_steps(np.stack([batch.column(f"v{i}").to_numpy() for i in range(DIM + 2)], axis=1) / UNIT)
            yield pa.RecordBatch.from_arrays([batch.column("at"), *(pa.array(rows[:, i]) for i in range(DIM))], schema=_STEPS)

    moves = total.filter("kind = 'row'").select("at", *(f"v{i}" for i in range(DIM + 2))).mapInArrow(stepped, "at long, " + ", ".join(f"v{i} float" for i in range(DIM))).toArrow()
    dense = np.flatnonzero(kind == "dense")
    dense = dense[np.argsort(at[dense])]
    return found | {"rows": np.stack([moves[f"v{i}"].to_numpy() for i in range(DIM)], axis=1), "at": moves["at"].to_numpy(), "dense": values[dense, :3] / UNIT}


SCORES = "doc_id long, lang string, score double, flagged boolean"
_SCORES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64()), ("flagged", pa.bool_())])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per document its score and whether it reaches its language's threshold."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts, langs = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            found: list[float] = []
            part: list[str] = []
            size = 0
            for text in [*texts, None]:
                if part and (text is None or size > 2_000_000):
                    found += scorer.score(part).tolist()
                    part, size = [], 0
                if text is not None:
                    part.append(text)
                    size += len(text)
            yield batch_of(_SCORES, {"doc_id": batch.column(0).to_pylist(), "lang": langs, "score": found, "flagged": [shared.value.fitted and s >= shared.value.threshold(at) for s, at in zip(found, langs, strict=True)]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), column_or_null(documents, "lang", "string").alias("lang"), text_of().alias("text")).mapInArrow(task, SCORES)


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns and rows.

    Rows are matched by text, not by doc_id, so repeated or null ids do no harm: each row is scored where it
    stands and carried through the task.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(fit(documents, labels))
    names = documents.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, model = Scorer(shared.value), shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(names.index("text")).to_pylist()]
            langs = batch.column(names.index("lang")).to_pylist() if "lang" in names else [None] * len(texts)
            keep: list[bool] = []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 2_000_000):
                    size += len(texts[end])
                    end += 1
                scores = scorer.score(texts[at:end])
                keep += [not (model.fitted and s >= model.threshold(lang)) for s, lang in zip(scores, langs[at:end], strict=True)]
                at = end
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(task, documents.schema)
