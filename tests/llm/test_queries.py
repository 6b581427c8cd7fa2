"""The registered corpus queries: SQL twins, columns, and the pipeline's stages on planted cases."""

from __future__ import annotations

import importlib
import random

import duckdb
import pytest

from wirelake.llm import queries

TABLES = "documents embeddings benchmark labels conversations".split()
COLUMNS = {
    "op1_mixing": {"doc_id", "n_copies"},
    "op2_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op4_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op5_line_templates": {"doc_id", "n_lines", "n_dropped"},
    "op6_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op7_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op8_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op9_fingerprint": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op11_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op12_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op13_structure_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
}


def test_names():
    assert list(queries.QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in queries.SQL])
def test_rows(spark, sf, name):
    frame = queries.QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(frame.columns) and frame.count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(frame.columns)
    result = con.execute(queries.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, map(tuple, frame.select(*names).collect()))) == sorted(map(repr, result.fetchall()))


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_pipeline_stages(spark, pipeline, tmp_path):
    """Planted toxic documents, lines, copies; each stage on what its predecessor kept."""
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    docs, labels = [], []
    for i in range(400):
        lines = [prose(rng.randrange(8, 20)) for _ in range(6)]
        if toxic := i % 4 == 0:
            lines[2] += " zorkish quuxed zorklike zorkish"
        if i % 9 == 1:
            lines.insert(3, passage)
        docs.append((i, "\n".join(lines), rng.choice(["en", "de"]), f"src{i % 19}", 0))
        labels.append((i, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 4]
    for k in range(20):
        docs.append((1000 + k, clean[0][1], "en", "src0", 0))
        words = clean[2][1].split(" ")
        words[k] = "edited"
        docs.append((2000 + k, " ".join(words), "en", "src0", 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, kept = spark.createDataFrame(docs, schema), []
    for name, stage in pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept.append(frame)
        if name != "packing":
            assert frame.columns == [x.split()[0] for x in schema.split(", ")]
    ids = lambda f: {r["doc_id"] for r in f.select("doc_id").collect()}
    after = ids(kept[0])
    assert len({i for i in after if i < 400 and i % 4 == 0}) <= 5 and len({d[0] for d in clean} - after) <= 5
    texts = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    assert not any(passage in t for t in texts.values())
    assert ids(kept[1]) == after
    third = ids(kept[2])
    assert len([i for i in third if i >= 1000]) == 0 and {d[0] for d in clean} & after <= third
    mixed = [r["doc_id"] for r in kept[3].collect()]
    assert set(mixed) <= third and max(map(mixed.count, set(mixed))) <= 2
    assert ids(kept[4]) == set(mixed)


def test_pipeline_runs(spark, sf, pipeline):
    assert pipeline.run(spark, sf).count() > 0
    assert pipeline.ORACLE_SQL is None and [n for n, _ in pipeline.STAGES][0] == "toxicity"
