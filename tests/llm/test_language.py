"""Language identification: held-out accuracy, a plain version, and awkward rows."""

from __future__ import annotations

import random
import zlib

import pytest
import zstandard

from wirelake.llm import langid
from wirelake.llm.common import read_table

WORDS = {"xx": "lorem ipsum dolor sit amet consectetur".split(), "yy": "veritas ratio publica civitas homo novus".split(), "zz": "kala vesi metsa talo jarvi saari".split()}
KIND = "doc_id long, text string, lang string, source string, score double, rank int, mark long, piece string, n long"


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, prose(rng, lang := "xyz"[i % 3] * 2, 1 + rng.randrange(60)), lang) for i in range(300)]
    out += [(1000 + i, out[0][1], "xx") for i in range(200)]  # many copies
    out += [(5, None, "xx"), (6, "", "yy"), (7, "12 34 !!", "zz"), (None, prose(rng, "zz", 20), None), (8, "x", None), (9, prose(rng, "yy", 60_000), None), (9, prose(rng, "yy", 60_000), "zz"), (4, "É", "xx")]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5, 1, 2, "p", 3) for r in rows], KIND)


def test_equals_a_plain_version(frame, rows):
    """One shot for each block and language, all sizes compared."""
    model = langid.fit(frame)
    found = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["lang_pred"], round(r["score"], 9)) for r in langid.identify(frame, model).collect())
    plain = []
    for doc_id, text, _ in rows:
        words = "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
        data, best = " ".join(words).encode(), ("und", 0.0)
        if data:
            size = {}
            for lang, content in model.dictionaries.items():
                coder = lambda: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)  # noqa: E731, B023
                size[lang] = sum(len(coder().compress(data[i : i + 1024])) for i in range(0, min(len(data), 10**9), 1024))
            least = min(size.values())
            best = next(lang for lang in model.dictionaries if size[lang] == least), round(1 / sum(0.6 ** min(n - least, 500) for n in size.values()), 9)
        plain.append((doc_id is not None, doc_id or 0, *best))
    assert found == sorted(plain)


def test_learns_from_labelled_rows_only(spark, frame, rows):
    model = langid.fit(frame)
    assert list(model.dictionaries) == ["xx", "yy", "zz"]
    first = rows[0][1].encode()
    assert model.dictionaries["xx"].count(first) <= 2  # copies are one piece
    other = spark.createDataFrame([(d, t, lang if zlib.crc32(str(d).encode()) % 4 != 2 else "qq") for d, t, lang in rows if d is not None], "doc_id long, text string, lang string")
    assert langid.fit(other).dictionaries == langid.fit(frame.filter("doc_id IS NOT NULL")).dictionaries  # held-out labels say nothing


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found) and len(found) > 150
    sure = [r for r in found if r["accepted"]]
    assert sum(r["lang"] == r["lang_pred"] for r in sure) >= 0.98 * len(sure) and len(sure) >= 0.9 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_odd(spark, frame):
    model = langid.fit(frame)
    by_id = {}
    for r in langid.identify(frame, model).collect():
        by_id.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, by_id.values())) == frame.count()
    assert all(any(r["lang_pred"] == "und" and r["score"] == 0 for r in by_id[d]) for d in (5, 6, 7)) and {r["lang_pred"] for r in by_id[9]} >= {"yy"}
    empty = spark.createDataFrame([], KIND)
    assert langid.fit(empty) == langid.Model() and langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(frame, langid.Model()).collect()} == {"und"}
    assert langid.keep_language(frame, model, ("yy",), 1.0).count() == 0
