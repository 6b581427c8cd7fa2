"""The corpus operators against plain versions, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wirelake.llm import ann, chat, fingerprint, jaccard, linetemplates, mixing, packing, pii, queries, secrets, toxicity
from wirelake.llm.common import read_table

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
SAME = "one two three four five six seven eight nine ten"
ODD = [(0, None), (1, ""), (2, " \n\t "), (3, "a b"), (4, SAME), (5, SAME.upper()), (6, LONG), (None, SAME), (4, SAME), (7, "ünï cödé 1 2 3 4"), (8, "\n\n\n"), (9, "a b")]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, budget long, line_hash long, id long, component long, bucket int, range int, copy boolean, a long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, None if d == 3 else "en", None if d == 4 else f"src{d}", 5, 0.5, "x", 1, 2, 3, 4, 5, 6, True, 7) for d, t in ODD], EXTRA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read_table(spark, sf, "documents")


# --- n-gram join -------------------------------------------------------------------------------------


def word_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def by_hand(rows):
    """doc_id: (size, component) over all pairs."""
    sets = [(d, word_set(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def check_join(frame, rows):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame).collect()}
    assert found == by_hand(rows)


def test_join_on_edited_copies(spark):
    rng = random.Random(1)
    rows = []
    for group in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.choice([3, 5, 6, 9, 20, 60, 200]))]
        for _ in range(8):
            words = [w if rng.random() > 0.02 else "zz" + str(rng.randrange(9)) for w in base]
            if rng.random() < 0.5:
                words = words[: len(words) - rng.randrange(1 + len(words) // 6)]
            rows.append((len(rows) * 3 % 97 * 100 + len(rows), " ".join(words)))
    check_join(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_join_where_runs_span_components(spark):
    """A shared passage makes signatures meet that don't link; chains link only through the middle."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"d{i}q{j}" for j in range(i % 5))) for i in range(30)]
    words = [f"c{i}" for i in range(100)]
    rows += [(100 + k, " ".join(words[k * 4 :] + [f"t{j}" for j in range(k * 4)])) for k in range(6)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_join_on_the_table(docs):
    check_join(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_join_odd(odd, empty):
    found = jaccard.join(odd).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert [by_id[i]["n_shingles"] for i in (0, 1, 2, 3, 4, 8)] == [0, 0, 0, 1, 6, 0]
    assert by_id[0]["component_id"] == 0 and by_id[9]["component_id"] == 3
    assert by_id[5]["component_id"] == by_id[4]["component_id"] == by_id[None]["component_id"]
    assert jaccard.join(empty).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (0, 1, 2, 3, 4, 6, 7, 8)]


def test_join_tells_rows_of_one_id_apart(spark):
    """Repeated ids with different texts, repeated rows and null ids: every row is a document."""
    rng = random.Random(23)
    prose = lambda: [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(80)]
    rows = []
    for k in range(12):
        a, b = prose(), prose()
        rows += [(10 * k + 1, " ".join(a)), (10 * k + 1, " ".join(b)), (10 * k + 2, " ".join(["zz", *b[1:]]))]
    c = prose()
    rows += [(None, " ".join(c)), (None, " ".join(prose())), (500, " ".join(["yy", *c[1:]])), (500, " ".join(["yy", *c[1:]])), (None, ""), (7, None), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    by_row = by_hand([(i, t) for i, (_, t) in enumerate(rows)])
    smallest = {}
    for i, (_, at) in by_row.items():
        ids = [rows[j][0] for j, (_, other) in by_row.items() if other == at and rows[j][0] is not None]
        smallest[i] = min(ids, default=None)
    expected = collections.Counter((rows[i][0], n, smallest[i]) for i, (n, _) in by_row.items())
    assert collections.Counter(tuple(r) for r in jaccard.join(frame).collect()) == expected
    kept = collections.Counter(tuple(r) for r in jaccard.one_of_each(frame).collect())
    places = {}
    for i, (n, at) in by_row.items():
        if n:
            places.setdefault(at, []).append((rows[i][0] is None, rows[i][0] or 0))
    ids = [tuple(min(p)) for p in places.values()] + [(d is None, d or 0) for d, t in rows if not t]
    assert sorted((d is None, d or 0) for d, _ in kept.elements()) == sorted(ids)


def test_signatures_are_shared(spark):
    """The bound behind the join: linked sets share a signature, whatever their sizes."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64))
        drop = int(rng.integers(0, n // 5 + 1))
        add = int(rng.integers(0, n // 8 + 1))
        t = np.unique(np.concatenate([np.delete(s, rng.choice(len(s), drop, replace=False)), rng.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(s, t))
        if 100 * both >= 80 * (len(s) + len(t) - both) and len(t):
            assert len(np.intersect1d(jaccard.all_signatures(s), jaccard.all_signatures(t)))
            flips = int(sum(bin(int(x) & (2**64 - 1)).count("1") for x in jaccard.parity(s) ^ jaccard.parity(t)))
            assert 9 * flips <= len(s) + len(t)


def test_document_rows_are_spread():
    """A group of copies, even of one id, lies in no single bucket."""
    import pyarrow as pa

    for same in ("", SAME):
        texts = pa.RecordBatch.from_arrays([pa.array([5] * 6400, pa.int64()), pa.array([same] * 6400)], names=["id", "text"])
        rows = [r for b in jaccard.Dealer(32).batches(iter([texts])) for r in b.to_pylist() if r["signature"] is None]
        assert len(rows) == 6400 and max(collections.Counter(r["bucket"] for r in rows).values()) == 200


def test_tiny_sets_send_no_signatures():
    """Sets that link with equal ones alone aren't dealt."""
    import pyarrow as pa

    tiny = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([" ".join(f"{i}w{j}" for j in range(1 + i % 7)) for i in range(200)])], names=["id", "text"])
    rows = [r for b in jaccard.Dealer(32).batches(iter([tiny])) for r in b.to_pylist()]
    assert len(rows) == 200 and all(r["signature"] is None for r in rows)


def test_join_on_tiny_sets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 11)))) for i in range(300)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"), rows)


# --- line templates ----------------------------------------------------------------------------------


def templates_by_hand(rows):
    """Kept text of each row, by the docstring's rules."""
    cut = lambda t: re.findall(r".*?[.!?] |.*\n|.+\Z", t or "")
    split = lambda part: part.strip(" \n").split(" ")
    mask = lambda part: tuple("<*>" if re.search("[0-9]", t) else t for t in split(part))
    bare = lambda part: part[:-1] if part[-1] == "\n" or part[-2:] in (". ", "! ", "? ") else part
    lines = [[(x.strip(" "), mask(x)) for x in {bare(part) for part in cut(t)} if len(split(x)) >= 4] for _, t in rows]
    docs = collections.Counter(m for own in lines for _, m in own)
    leaf = lambda m: (len(m), *m[:3])
    fresh = [sum(len(x) for x, m in own if docs[m] > 1) <= 0.5 * sum(len(x) for x, _ in own) and bool(own) for own in lines]
    leaves = collections.defaultdict(dict)
    for m, n in docs.items():
        leaves[leaf(m)][m] = n
    template = {}
    for k, kinds in leaves.items():
        if len(kinds) > 1 and sum(kinds.values()) >= 3:
            fixed = {}
            for i in range(k[0]):
                c = collections.Counter()
                for m, n in kinds.items():
                    c[m[i]] += n
                token, n = c.most_common(1)[0]
                if n >= 0.6 * sum(kinds.values()):
                    fixed[i] = token
            if len(fixed) - 3 >= 0.7 * (k[0] - 3):
                template |= {m: k for m in kinds if all(m[i] == t for i, t in fixed.items())}
    by_line, others = collections.Counter(), set()
    for ok, own in zip(fresh, lines):
        found = {m for _, m in own} | {("leaf", template[m]) for _, m in own if m in template}
        if ok:
            by_line.update(found)
        else:
            others |= found
    by_line.update(others)
    gone = {m for m, n in by_line.items() if n >= 3} | {m for m, k in template.items() if by_line["leaf", k] >= 3}
    return [t if t is None else "".join(x for x in cut(t) if not (len(split(x)) >= 4 and mask(x) in gone)) for _, t in rows]


def test_templates_by_hand(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(n))
    rows = []
    for i in range(60):
        lines = [prose(rng.randrange(5, 12)) for _ in range(rng.randrange(3, 8))]
        if i % 3 == 0:
            lines.insert(1, f"Page {i} of 99 was printed on day {i % 7}")
        if i % 4 == 0:
            lines.append("All rights are held by the makers of this text")
        if i % 5 == 0:
            lines.append(f"user {rng.choice(['ann', 'bob', 'cy'])} has logged in from host at the gate with key")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[7][1]) for i in range(5)] + [(200, None), (201, ""), (202, "\n \n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in linetemplates.drop_recurring(frame).collect()}
    assert found == dict(zip([d for d, _ in rows], templates_by_hand(rows)))
    assert "rights" not in "".join(t or "" for t in found.values()) and found[100] == rows[7][1]


def test_passages_inside_lines_go(spark):
    """Sentences of a passage set into long lines; copies of whole documents keep their text."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(6, 14))) + "."
    passage = [sentence() for _ in range(6)]
    rows = []
    for i in range(40):
        own = [sentence() for _ in range(20)]
        at = rng.randrange(20)
        rows.append((i, " ".join(own[:at] + (passage if i % 5 == 0 else []) + own[at:])))
    rows += [(100 + i, rows[1][1]) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in linetemplates.drop_recurring(frame).collect()}
    assert found == dict(zip([d for d, _ in rows], templates_by_hand(rows)))
    assert not any(s in t for s in passage for t in found.values())
    assert all(found[d] == t for d, t in rows if d % 5 or d >= 100)
    many = linetemplates._cleaned(frame, 3, most=0)[0].select("doc_id", "text")  # by a join, as where many recur
    assert {r["doc_id"]: r["text"] for r in many.collect()} == found


def test_parts_join_to_the_text(spark, docs):
    rng = random.Random(22)
    rows = [("".join(rng.choice(["a", "b ", ". ", ".", "\n", "? ", "! ", " ", "é", "\x01"]) for _ in range(rng.randrange(30))),) for _ in range(500)]
    frame = spark.createDataFrame(rows, "text string").unionByName(docs.select("text"))
    pattern = F.regexp_extract_all("text", F.lit(linetemplates.PART), F.lit(0))
    found = frame.select("text", linetemplates.parts_of(F.col("text")).alias("parts"), pattern.alias("by_pattern")).collect()
    assert all("".join(r["parts"]) == r["text"] and r["parts"] == r["by_pattern"] == linetemplates._cut(r["text"]) for r in found)


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as the operators' own names come back with their values, also from the other way of each."""
    names = ["_parts", "_dropped", "_drop_id", "_Drop", "_all", "_kept", "_mix_id", "_mix_lang", "_mix_source", "_mix_copies", "_jaccard_key", "_key_id", "_key_shared", "low", "high", "chars", "row"]
    rows = [(d, f"{SAME} number {d} of words {' '.join(f'q{d}z{i}' for i in range(40))}", "en", "src1", *(70 + d + k for k in range(len(names)))) for d in range(4)]
    rows.append((3, "another text of the same id", "en", "src1", *rows[3][4:]))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    whole = sorted(map(tuple, frame.collect()))
    joined, *_ = linetemplates._cleaned(frame, 3, most=0)
    for out in (linetemplates.drop_recurring(frame, 100), joined.select(*frame.columns), jaccard.one_of_each(frame), mixing.mix(frame, mixing.Mixture(share=1, of=1, epochs=1))):
        assert out.columns == frame.columns and sorted(map(tuple, out.collect())) == whole


def test_templates_odd(odd, empty):
    out = linetemplates.drop_recurring(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert linetemplates.drop_recurring(empty).count() == 0
    assert linetemplates.report(odd).count() == len(ODD)


# --- mixing ------------------------------------------------------------------------------------------


def test_water_filling(spark):
    rows = [("web", "en", "src0", 1000), ("web", "en", "src1", 10), ("web", "de", "src0", 50), ("forum", "en", "src9", 20), ("news", "en", "src14", 400), ("reference", None, None, 300)]
    frame = spark.createDataFrame(rows, "domain string, lang string, source string, supply long")
    found = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(frame, mixing.Mixture(epochs=2)).collect()}
    total = 1780 // 2
    # forum can give 40 of its share; the others divide the rest 40:20:10
    rest = total - 40
    web, news, reference = rest * 40 // 70, rest * 20 // 70, rest * 10 // 70
    assert found[("forum", "en", "src9")] == 40 and found[("news", "en", "src14")] == news and found[("reference", None, None)] == reference
    de = min(100, web * 25 // 65)
    assert found[("web", "de", "src0")] == de  # what German can't take goes to English, its sibling
    assert found[("web", "en", "src1")] == 20 and found[("web", "en", "src0")] == web - de - 20


def test_prefix_and_epochs(docs):
    found = mixing.copies(docs).toPandas()
    for _, leaf in found.groupby(["domain", "lang", "source"]):
        whole = leaf.n_copies.min()
        assert leaf.n_copies.max() - whole <= 1
        order = leaf.assign(h=[hashlib.md5(f"mix-1:{whole}:{d}".encode()).hexdigest() for d in leaf.doc_id]).sort_values("h")
        assert list(order.n_copies) == sorted(order.n_copies, reverse=True)  # a prefix
    assert mixing.mix(docs).count() == found.n_copies.sum()


def test_mixing_odd(odd, empty):
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(odd, mixing.Mixture(share=2, of=1))
    assert out.columns == odd.columns and out.filter("doc_id IS NULL").count() >= 1


# --- toxicity ----------------------------------------------------------------------------------------


def toxic_rows(n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
        if bad := i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["zorkish", "quuxed", "zorklike"])
        rows.append((i, " ".join(words), "en" if i % 2 else "de", int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(frame.drop("toxic"), frame.select("doc_id", "toxic"))
    found = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    held = [(y, found[d]["score"]) for d, _, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(held) > 80
    right = sum((s >= 0.7) == bool(y) for y, s in held)
    assert right >= 0.95 * len(held)
    kept = toxicity.keep_clean(frame.select("doc_id", "text", "lang"), frame.select("doc_id", "toxic"))
    gone = {d for d, _, _, _ in rows} - {r["doc_id"] for r in kept.collect()}
    bad = {d for d, _, _, y in rows if y}
    assert len(gone & bad) >= 0.95 * len(bad) and len(gone - bad) <= 6


def test_toxicity_learns_from_rows_beyond_the_start(spark):
    """A telling word and a language that only rows past the start's limits have are learnt and calibrated."""
    rows = toxic_rows(600)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    place = {r["doc_id"]: r["h"] for r in frame.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    early = {d for y in (0, 1) for d in sorted((d for d, _, _, at in rows if at == y and zlib.crc32(str(d).encode()) % 3 != 1), key=place.get)[:60]}
    changed = [(d, text if d in early or not y else f"{text} blorfing", lang if d in early else "fr", y) for d, text, lang, y in rows]
    later = spark.createDataFrame(changed, frame.schema)
    models = [toxicity.fit(f.drop("toxic"), f.select("doc_id", "toxic"), 60, 60) for f in (frame, later)]
    assert "fr" in models[1].thresholds and "fr" not in models[0].thresholds
    scores = [toxicity.Scorer(m).score(["hag bed blorfing cafe", "hag bed cafe"]) for m in models]
    assert scores[1][0] - scores[1][1] > scores[0][0] - scores[0][1]


def test_toxicity_driver_gets_steps_alone(spark):
    """The table's sums stay where they lie: the driver gets steps of four bytes, and in the last pass none."""
    rng = np.random.default_rng(5)
    k = len(toxicity.WIDTHS)
    normal = lambda *size: rng.normal(0, 0.5, size).astype(np.float32)
    model = toxicity.Model(normal(toxicity.ROWS, toxicity.DIM), [normal(w, toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS], normal(k, toxicity.FILTERS), normal(k * toxicity.FILTERS), -0.2)
    rows = [(i % 2, i % 3 == 0, "en", f"one two w{i} w{i * 7}") for i in range(40)]
    labelled = spark.createDataFrame(rows, "toxic int, calibrates boolean, lang string, text string").repartition(1)
    moving, last = toxicity._summed(labelled, model, 2.0), toxicity._summed(labelled, model, 2.0, steps=False)
    own = toxicity.Gradients(model, 2.0)
    own.add([r[3] for r in rows if not r[1]], np.array([r[0] for r in rows if not r[1]]))
    sums = {at: np.round(np.array(v) * toxicity.UNIT) / toxicity.UNIT for (kind, at), v in own.sums().items() if kind == "row"}
    assert moving["rows"].dtype == np.float32 and set(moving["at"].tolist()) == set(sums)
    assert np.allclose(moving["rows"], toxicity.row_steps(np.array([sums[at] for at in moving["at"].tolist()])), atol=1e-4)
    assert set(last) == {"loss", "scores"} and abs(last["loss"] - moving["loss"]) <= 1 and sorted(last["scores"]) == sorted(moving["scores"])


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    normal = lambda *size: rng.normal(0, 0.5, size).astype(np.float32)
    k = len(toxicity.WIDTHS)
    model = toxicity.Model(normal(toxicity.ROWS, toxicity.DIM), [normal(w, toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS], normal(k, toxicity.FILTERS), normal(k * toxicity.FILTERS), -0.2)
    texts, labels = ["one two three", "", "four two", "five six seven eight nine"], np.array([1, 0, 0, 1])

    def sums(m):
        own = toxicity.Gradients(m, 2.0)
        own.add(texts, labels)
        return own.sums()

    found = sums(model)
    assert found["loss", 0][1] == 4
    out = model.out.size
    for part, first in ((model.filters[1], model.filters[0].size), (model.bias, sum(w.size for w in model.filters)), (model.out, sum(w.size for w in model.filters) + model.bias.size)):
        for i in range(0, min(part.size, out), 5):
            held, losses = part.flat[i], []
            for step in (1e-3, -1e-3):
                part.flat[i] = held + step
                losses.append(sums(model)["loss", 0][0])
            part.flat[i] = held
            assert abs((losses[0] - losses[1]) / 2e-3 - found["dense", first + i][0]) < 0.01
    row = toxicity.hashed([b"two"])[0][0]
    held, losses = model.table[row, 2], []
    for step in (1e-3, -1e-3):
        model.table[row, 2] = held + step
        losses.append(sums(model)["loss", 0][0])
    model.table[row, 2] = held
    assert abs((losses[0] - losses[1]) / 2e-3 - found.get(("row", int(row)), [0.0] * 10)[2]) < 0.01


def test_toxicity_flags_and_inputs(spark):
    frame = spark.createDataFrame([(i, "x", "en") for i in range(50)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["h"] for r in frame.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(0, 0), (4, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    scores = [(r["doc_id"], r["score"]) for r in toxicity.score(odd, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for _, s in scores)
    assert toxicity.score(empty, model).count() == 0
    assert not toxicity.fit(empty, labels).fitted
    out = toxicity.keep_clean(odd, labels)
    assert out.columns == odd.columns and out.count() == len(ODD)


def test_scores_equal_a_plain_forward_pass(spark):
    """Every filter at every position of every text, by loops, against the batched scores."""
    rng = np.random.default_rng(6)
    k = len(toxicity.WIDTHS)
    normal = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    model = toxicity.Model(normal(toxicity.ROWS, toxicity.DIM), [normal(w, toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS], normal(k, toxicity.FILTERS), normal(k * toxicity.FILTERS), -0.2)
    texts = ["", "one", "one two", "One two, three! four", "é ü", SAME * 3, None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    for i, text in enumerate(texts):
        words = []
        for word in toxicity.words_of(text or ""):
            rows, _ = toxicity.hashed([word])
            words.append(sum((model.table[r].astype(np.float64) for r in rows), np.zeros(toxicity.DIM)))
        padded = words + [np.zeros(toxicity.DIM)] * (toxicity.PAD + 1)
        pooled = []
        for q, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max(sum(float((padded + [np.zeros(toxicity.DIM)] * width)[p + j] @ model.filters[q][j][:, f].astype(np.float64)) for j in range(width)) for p in range(len(words) + toxicity.PAD + 1))
                pooled.append(max(0.0, best + float(model.bias[q][f])))
        z = sum(a * float(b) for a, b in zip(pooled, model.out)) + model.shift
        assert abs(found[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_word_rows():
    words = [b"a", b"abc", b"abcd", b"loweilo", b"loweiig"]
    rows, starts = toxicity.hashed(words)
    assert list(np.diff(np.append(starts, len(rows)))) == [2, 2, 3, 6, 6]
    own = [set(x.tolist()) for x in np.split(rows, starts[1:])]
    assert own[3] & own[4] and not own[0] & own[3]
    alone, _ = toxicity.hashed([b"loweiig"])
    assert set(alone.tolist()) == own[4]


# --- personal data and secrets -----------------------------------------------------------------------


def plain_luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_pii(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return found


def test_pii_base(docs):
    rng = random.Random(8)
    texts = [r["text"] for r in docs.select("text").collect()]
    texts += ["".join(rng.choice(["a", ".", "@", "-", "1", "4111111111111111", " ", "+1", "(", "0.0", "255", "é", "%"]) for _ in range(25)) for _ in range(4000)]
    for text in texts:
        assert pii.base_spans(text) == plain_pii(text)


def test_field_finds_altered_writing():
    rng = random.Random(9)
    texts = []
    for i in range(120):
        d = [rng.randrange(10) for _ in range(15)]
        card = next("".join(map(str, d)) + str(c) for c in range(10) if pii.luhn("".join(map(str, d)) + str(c)))
        texts += [f"so write to ab{i}.x@site{i % 7}.example.com and wait", f"seen at 10.{i}.3.{i % 200} today", f"paid {card} now", f"call +1 ({200 + i}) 555-{1000 + i} later", f"in {1990 + i % 30} there were {i} of {i * 37} things", f"on 20{10 + i % 15}-0{1 + i % 9}-1{i % 10} we met"]
    field = pii.train(texts)
    kinds = lambda t: [(s["kind"], t[s["start"] : s["end"]]) for s in pii.all_spans(t, field)]
    assert ("phone", "212-555-0188") in kinds("please call 212-555-0188 today")
    assert ("card", "4111.1111.1111.1111") in kinds("the card 4111.1111.1111.1111 was used")
    assert kinds("or write to jane at example dot com now") == [("email", "jane at example dot com")]
    assert kinds("we met on 2021-03-04 and 12 others came") == []
    text = "mail x.y@z.example.com or +1 (212) 555-0143 4111111111111111"
    assert {tuple(s) for s in plain_pii(text)} <= {(s["kind"], s["start"], s["end"]) for s in pii.all_spans(text, field)}


def test_written_out_addresses_have_their_bounds():
    """By the built-in examples alone: whole addresses, without the words before and after."""
    field = pii.train([])
    for value in ("user58[at]site8.example.com", "user40 (at) site.example.org", "jane at example dot com"):
        text = f"please mail {value} today"
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in pii.all_spans(text, field)] == [("email", value)]


def test_field_sees_every_trigger_and_cuts_no_entity():
    rng = random.Random(11)
    field = pii.Field()
    field.spans[11, pii.KINDS.index("email")] = 1.0  # an at sign or word, dotted, a letter last
    for text in ("jane[at]example.com", "jane (at) example.com"):
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in pii.all_spans(text, field)] == [("email", text)]
    field = pii.train([f"call +1 ({200 + i + rng.randrange(9)}) 555-{1000 + i} later" for i in range(60)])
    for between in (" ; ", " and ", ", "):
        numbers = [f"{210 + i % 7}-555-{1000 + i}" for i in range(600)]
        text = "x " + between.join(numbers)
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in pii.all_spans(text, field)] == [("phone", x) for x in numbers]


def test_windows_hold_all_segments():
    """Each segment that could be an entity lies whole in the window in whose own part it begins."""
    rng = random.Random(12)
    text = " ".join(rng.choice(["7", "12", "a@b.c", "x", "4111 1111", "(at)", "9" * 30]) for _ in range(3000))
    whole = pii.window_of(text)
    spans = {(whole.tokens[i][0], whole.tokens[j - 1][1]) for i, j in whole.segments}
    found = []
    for at, part, start, end in pii.windows(text):
        w = pii.window_of(part)
        found += [s for i, j in w.segments if start <= (s := (at + w.tokens[i][0], at + w.tokens[j - 1][1]))[0] < end]
    assert len(found) == len(set(found)) and set(found) == spans


def test_field_gradient():
    field = pii.Field()
    rng = np.random.default_rng(0)
    field.spans[:] = rng.normal(0, 0.3, field.spans.shape)
    field.steps[:] = rng.normal(0, 0.3, field.steps.shape)
    w = pii.window_of("call 212-555-0188 or 10.0.0.1 now")
    truth = {0: 3}
    spans, steps = np.zeros_like(field.spans), np.zeros_like(field.steps)
    base = field.gradient(w, truth, spans, steps)
    for index in [(0, 3), (4, 3), (12, 1), (27, 0)]:
        field.spans[index] += 1e-5
        moved = field.gradient(w, truth, np.zeros_like(spans), np.zeros_like(steps))
        field.spans[index] -= 1e-5
        assert abs((moved - base) / 1e-5 - spans[index]) < 1e-3


def plain_secrets(text):
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [("assign", *m.span()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]


def test_secret_base(docs):
    rng = random.Random(10)
    texts = [r["text"] for r in docs.select("text").collect()]
    texts += ["".join(rng.choice(["token", "=", "AKIA", "abcdef0", '"', " ", "Z9", "deadbeef", "PassWord", ":", "\n", "api_key", "ſecret", "toKen"]) for _ in range(14)) for _ in range(4000)]
    for text in texts:
        assert secrets.base_spans(text) == plain_secrets(text)


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('K = "Zx9!kfPq02LmRt77"\ndb_password = K', "Zx9!kfPq02LmRt77"),
        ('{"user": "bob", "pwd": "hT5$kk29Lm0Q"}', "hT5$kk29Lm0Q"),
        ("run --auth-token Zx9kfPq02LmRt77", "Zx9kfPq02LmRt77"),
        ('const authKey = "Ab3xYz09QqLm11Pd" + "zz"', "Ab3xYz09QqLm11Pd"),
        ('pwd = "changeme"', None),
        ('name = "Zx9!kfPq02LmRt77"', None),
        ("the note: see page 3", None),
        ("\n".join(['n0 = "Zx9!kfPq02LmRt77"', *(f"n{i + 1} = n{i}" for i in range(30)), "db_password = n30"]), "Zx9!kfPq02LmRt77"),
        ('x = "a b"\n' + 'x = x + "c d"\n' * 100 + 'x = x + "Zx9!kfPq02LmRt77"\npwd = x', "Zx9!kfPq02LmRt77"),
        ("<user>bob</user><password>hT5$kk29Lm0Q</password>", "hT5$kk29Lm0Q"),
        ("<c:password type='x'>\n  hT5$kk29Lm0Q\n</c:password>", "hT5$kk29Lm0Q"),
        ("<name>hT5$kk29Lm0Q</name> <password>see page 3</password>", None),
    ],
)
def test_lexing(text, literal):
    found = [text[s["start"] : s["end"]] for s in secrets.all_spans(text) if s["kind"] == "literal"]
    assert found == ([literal] if literal else [])


def test_long_sums_take_linear_time():
    text = 'x = "a b"\n' + 'x = x + "c d"\n' * 100_000 + 'x = x + "Zx9!kfPq02LmRt77"\npwd = x'
    assert [text[a:b] for _, a, b in secrets.literal_spans(text)] == ["Zx9!kfPq02LmRt77"]


def digest(spans, kinds, order):
    """The digest columns of a query from spans (kind, start, end, base), in plain code."""
    join = lambda own: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in sorted(own, key=order))
    base = [x for x in spans if x[3]]
    return *(sum(k == kind for k, _, _, _ in base) for kind in kinds), hashlib.sha256(join(base).encode()).hexdigest(), join(spans)


def test_digests(spark, sf, docs):
    """The columns of op4 and op8 on the whole table against plain code."""
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    flat = lambda spans: [(x["kind"], x["start"], x["end"], x["base"]) for x in spans]
    for r in queries.op8_secrets(spark, sf).collect():
        base = [(k, a, b, True) for k, a, b in plain_secrets(texts[r["doc_id"]])]
        every = flat(secrets.all_spans(texts[r["doc_id"]]))
        assert [x for x in every if x[3]] == sorted(base, key=lambda x: (x[1], secrets.KINDS.index(x[0]))) and len(r) == 6
        assert tuple(r)[1:] == digest(every, secrets.BASE_KINDS, lambda x: (x[1], secrets.KINDS.index(x[0])))
    field = pii.fit(docs)
    for r in queries.op4_personal_data(spark, sf).collect():
        base = [(k, a, b, True) for k, a, b in plain_pii(texts[r["doc_id"]])]
        every = flat(pii.all_spans(texts[r["doc_id"]], field))
        assert sorted(x for x in every if x[3]) == sorted(base)
        assert tuple(r)[1:] == digest(every, pii.KINDS, lambda x: (pii.KINDS.index(x[0]), x[1]))


def test_field_equals_all_segmentations():
    """The dynamic programme against every segmentation of a short window."""
    rng = np.random.default_rng(4)
    for text in ("call 212-555-0188 or x", "at 10.0.0.1 now", "a@b.c 4111 1111"):
        w = pii.window_of(text)
        n = len(w.tokens)
        for _ in range(5):
            field = pii.Field()
            field.spans[:] = rng.normal(0, 1, field.spans.shape)
            field.steps[:] = rng.normal(0, 1, field.steps.shape)
            scores = w.features @ field.spans
            best = (-np.inf, None)
            stack = [(0, 0, 0.0, ())]
            while stack:
                t, y, total, chosen = stack.pop()
                if t == n:
                    best = max(best, (total, chosen))
                    continue
                stack.append((t + 1, 0, total + field.steps[y, 0], chosen))
                for s, (i, j) in enumerate(w.segments):
                    if i == t:
                        stack += [(j, z + 1, total + field.steps[y, z + 1] + scores[s, z], (*chosen, (pii.KINDS[z], w.tokens[i][0], w.tokens[j - 1][1]))) for z in range(len(pii.KINDS))]
            assert tuple(field.best(w)) == best[1]


def test_long_texts_take_linear_time():
    """Ten thousand numbers and as many pairs in one text are found, all of them."""
    text = "call +1 (212) 555-0143 now " * 10_000
    assert len([s for s in pii.all_spans(text, pii.Field()) if s["base"]]) == 10_000
    text = "".join(f'k{i} = "Zx9!kfPq{i:05d}LmRt77"\ndb_pwd_{i} = k{i}\ntoken: 0123456789abcdef{i:05d}\n' for i in range(10_000))
    assert sum(s["kind"] == "literal" for s in secrets.all_spans(text)) == 10_000


def seconds(f, text):
    began = time.process_time()
    f(text)
    return time.process_time() - began


def test_unbroken_runs_take_linear_time():
    """Runs of digits, of points and digits, of escaped quotes, a million characters each."""
    field = pii.Field()
    for text in ("1" * 1_000_000 + ".1.1.x", "1.1 " * 250_000, "9" * 300_000 + "." + "9" * 300_000 + ".", "+1" * 300_000, "a@" * 300_000):
        assert seconds(pii.base_spans, text) < 20
    assert seconds(lambda t: pii.all_spans(t, field), "1" * 300_000 + ".1.1.x") < 30
    for text in ('k = "' + '\\"' * 300_000, "k = '" + "\\'" * 300_000 + "\n", "k = " + "\"'" * 200_000 + '"' + "\\\\" * 100_000):
        assert seconds(secrets.all_spans, text) < 20


def test_lexer_equals_its_pattern():
    """The tokens against one pattern with strings in it."""
    string = r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|"""
    plain = re.compile(string + secrets._LEX.pattern.replace("quote", "other0"))
    rng = random.Random(30)
    for _ in range(20_000):
        text = "".join(rng.choice(['"', "'", "\\", "\n", "a", " ", "=", "--k", ":", "é"]) for _ in range(rng.randrange(16)))
        assert list(secrets.tokens(text)) == [(m.lastgroup.rstrip("0"), *m.span()) for m in plain.finditer(text)]


def test_scans_odd(odd, empty):
    for scan in (lambda d: pii.find_personal_data(d, pii.fit(d)), secrets.find_secrets):
        found = scan(odd).collect()
        assert len(found) == len(ODD)
        assert all(r["spans"] == [] for r in found if r["doc_id"] in (0, 1, 2))
        assert scan(empty).count() == 0


# --- nearest neighbours ------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 1, (150, 24)) for c in rng.normal(0, 4, (8, 24))]).astype(np.float32)
    x[5:45] = x[4]  # ties
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [(5000, None, ""), (5001, [0.0] * 24, ""), (5002, [float("nan")] + [1.0] * 23, ""), (5003, [1.0] * 5, ""), (5004, [None] + [1.0] * 23, ""), (None, [1.0] * 24, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = collections.defaultdict(list)
    for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 1200, 20))
    hits = 0
    x = x.astype(np.float64)
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        assert [r for r, _, _ in sorted(got)] == list(range(1, 11))
        assert [s for _, _, s in sorted(got)] == pytest.approx([d[v] for _, v, _ in sorted(got)])
        hits += len(set(best) & {v for _, v, _ in got})
    assert hits >= 0.9 * 10 * len(found)
    assert [v for _, v, _ in sorted(found[20])] == [4, *range(5, 14)]


def test_neighbours_few(spark):
    """Repeated ids: every row is a query of its own, and a candidate for all others."""
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(frame, F.col("vec_id") == 0).collect())
    assert found == [(0, 1, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 1, 1.414214), (0, 2, 1, 1.414214)]
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [3.0, 0.0])], "vec_id long, embedding array<double>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(frame, F.col("vec_id") == 0).collect())
    assert found == [(0, 1, 0, 2.0), (0, 1, 1, 1.414214), (0, 2, 0, 2.0), (0, 2, 1, 3.162278)]
    assert ann.search(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_on_the_table(spark, sf):
    """Recall of at least 0.9 against all distances, and exact scores, on the real vectors."""
    table = read_table(spark, sf, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = collections.defaultdict(dict)
    for r in queries.op6_neighbours(spark, sf).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = [int(ids[k]) for k in np.lexsort((ids, d))[:10]]
        assert sorted(got) == list(range(1, 11)) and [got[k][1] for k in sorted(got)] == pytest.approx([float(d[ids == got[k][0]][0]) for k in sorted(got)])
        hits += len(set(best) & {v for v, _ in got.values()})
    assert hits >= 0.9 * 10 * len(found)


def recall(spark, vectors, every):
    """Share of the ten true neighbours found, over all rows whose id is divisible by every."""
    x = np.array(vectors, np.float64)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for r in ann.search(frame, F.col("vec_id") % every == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), every):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argpartition(d, 10)[:10].tolist()))
    return hits / (10 * len(range(0, len(x), every)))


def test_neighbours_recall_on_larger_tables(spark):
    """A hundred queries over the vectors of the larger table; five hundred over clustered ones."""
    rows = [r["embedding"] for r in read_table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").collect()]
    assert recall(spark, [v for v in rows if v is not None and any(v) and all(c is not None and np.isfinite(c) for c in v)], 20) >= 0.9
    rng = np.random.default_rng(17)
    assert recall(spark, rng.normal(0, 1, (100, 32))[rng.integers(0, 100, 10_000)] + rng.normal(0, 0.3, (10_000, 32)), 20) >= 0.9


# --- chat --------------------------------------------------------------------------------------------


def test_escape_round_trip():
    rng = random.Random(13)
    for _ in range(20_000):
        text = "".join(rng.choice("#\\</:@t\n ") for _ in range(rng.randrange(14)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert "##" not in escaped and "</" not in escaped


def test_chat_round_trip(spark):
    rng = random.Random(14)
    pieces = ["### Assistant: ", "</turn>\n", "\\", "#", "<", "hi", "", "\n", ": ", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool: x", "@a"]), "".join(rng.choice(pieces) for _ in range(5)) if rng.random() < 0.9 else None, 1) for c in range(40) for t in range(rng.randrange(1, 6))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment long")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        said = "".join(t for role, t in own if role == "assistant")
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (found[conv]["n_turns"], found[conv]["loss_chars"]) == (len(own), len(said))
        assert found[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    text = "".join(r["text"] for r in chat.format_conversations(frame.filter("conv_id = 3")).collect())
    assert len(text) == found[3]["formatted_chars"]


def test_chat_order(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 1, "assistant", "b"), (3, 0, "system", "s"), (3, 0, "user", "u"), (4, 0, "user", "x"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r["valid"] for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert found == {1: True, 2: False, 3: True, 4: False, None: False}
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


# --- fingerprints ------------------------------------------------------------------------------------


def test_fingerprints(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    off = []
    seen = {}
    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert (found[d]["n_chars"], found[d]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = word_set(text.lower()), word_set(edited.lower())
        off.append(found[d]["near_edited"] - len(a & b) / len(a | b))
        assert seen.setdefault(text, found[d]["fingerprint"]) == found[d]["fingerprint"]
        assert len(found[d]["fingerprint"]) == fingerprint.BINS * fingerprint.BITS // 4
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06


def test_fingerprint_is_unbiased_for_short_texts(spark):
    rng = random.Random(15)
    rows = []
    for _ in range(250):
        words = [str(rng.randrange(10**6)) for _ in range(24)]
        rows.append((" ".join(words), " ".join(words[:19] + [str(rng.randrange(10**6)) for _ in range(5)])))
    frame = spark.createDataFrame(rows, "p string, q string")
    both = fingerprint.with_fingerprint(fingerprint.with_fingerprint(frame, "p", "x"), "q", "y").select(fingerprint.likeness(F.col("x"), F.col("y")).alias("l"), F.size("x").alias("n")).collect()
    assert {r["n"] for r in both} == {fingerprint.BINS}
    assert abs(np.mean([r["l"] for r in both]) - 15 / 25) < 0.03


def test_fingerprints_odd(odd, empty):
    found = fingerprint.fingerprints(odd).collect()
    assert len(found) == len(ODD)
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (0, 1)}) == 1
    assert fingerprint.fingerprints(empty).count() == 0


def test_next_documents_with_hot_ids(spark):
    rng = random.Random(16)
    rows = [(rng.choice([None, 7, 7, 7, rng.randrange(-50, 4000)]), f"text {rng.randrange(700)}") for _ in range(3000)]
    rows += [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (8, None), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")

    def place(row):
        text = (row[1] or "").encode()
        return -(1 << 63) if row[0] is None else row[0], xxhash.xxh64_intdigest(text, 42) >> 1, text

    order = sorted(rows, key=place)
    pairs = sorted((place(a), (order[(i + 1) % len(order)][1] or "").encode()) for i, a in enumerate(order))
    for range_rows, most in ((10_000, 8), (100, 1000), (100, 4), (20, 3)):
        ranges = collections.defaultdict(list)
        for r in fingerprint.with_next(frame, range_rows, most).collect():
            ranges[r["block"], r["slice"], r["part"]].append(r)
        got = []
        for own in ranges.values():
            own.sort(key=lambda r: (r["copy"], *(place(r) if not r["copy"] else ())))
            assert [r["copy"] for r in own] == [False] * (len(own) - 1) + [True]
            got += [(place(a), b["text"].encode()) for a, b in zip(own, own[1:], strict=False)]
        assert sorted(got) == pairs
        # an id that fills several blocks is cut; one that fills less than a block may stay in one range
        blocks = max(1, min(most, len(rows) // range_rows))
        assert max(map(len, ranges.values())) <= 2 * len(rows) / blocks
        assert blocks == 1 or sum(any(r["key"] == 7 for r in own) for own in ranges.values()) > blocks // 2


# --- packing -----------------------------------------------------------------------------------------


def check_packing(frame, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = frame.collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    tokens = padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.02 * tokens
    return pieces


def test_packing(docs):
    check_packing(packing.pack(docs, queries.VOCABULARY), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_packing_fills_and_balances(spark):
    rng = random.Random(16)
    rows = [(i, "word " * rng.choice([1, 7, 30, 100, 200, 400, 900, 3000])) for i in range(300)]
    pieces = check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.VOCABULARY), rows)
    tiers = {r["tier"] for r in pieces}
    assert {1024, 128} <= tiers
    groups = collections.Counter()
    for r in pieces:
        groups[(r["tier"], r["step_group"])] += r["length"]
    for tier in tiers:
        last = max(g for t, g in groups if t == tier)
        assert all(n == packing.STEP_TOKENS for (t, g), n in groups.items() if t == tier and g < last)


def test_step_groups_are_full_across_tasks(spark):
    rng = random.Random(17)
    rows = [(i, "word " * rng.choice([1, 7, 30, 100, 200, 400, 900, 3000])) for i in range(600)]
    pieces = check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), queries.VOCABULARY), rows)
    assert len({r["sequence_id"] >> 40 for r in pieces}) == 5
    groups, sequences = collections.Counter(), collections.defaultdict(set)
    for r in pieces:
        groups[(r["tier"], r["step_group"])] += r["length"]
        sequences[r["sequence_id"]].add((r["tier"], r["step_group"]))
    assert all(len(x) == 1 for x in sequences.values())
    for tier in {t for t, _ in groups}:
        own = [groups[t, g] for t, g in sorted(groups) if t == tier]
        assert own[:-1] == [packing.STEP_TOKENS] * (len(own) - 1) and own[-1] <= packing.STEP_TOKENS
    assert max(g for t, g in groups if t == 1024) > 5


def test_packing_odd(odd, empty):
    assert packing.pack(empty, queries.VOCABULARY).count() == 0
    rows = [(d, t) for d, t in ODD if d not in (4, None)]
    check_packing(packing.pack(odd.filter("doc_id <> 4"), queries.VOCABULARY), rows)
