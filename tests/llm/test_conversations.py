"""The conversation operators against all alignments, plain tries, and their SQL on awkward rows."""

from __future__ import annotations

import hashlib
import random
import time

import duckdb
import pytest

from wirelake.llm import prefixtrie, queries, turnrepair

KIND = "conv_id long, turn long, role string, text string, audit string, cost long, kind int, digest string, block int, depth int"
LONG = "word " * 100_000 + "end."


def odd_rows():
    """Null parts, repeated and tied rows, roles of all sorts, blank, long and cut texts."""
    rng = random.Random(3)
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG), (2, None, None, None), (2, None, "user", "a."), (3, 0, "", "a."), (3, 5, "sys", "b"), (4, 0, "user", ""), (None, 0, "user", "x."), (None, 1, "assistant", "y."), (-21, 3, "user", "z!")]
    for c in range(5, 90):
        for t in range(rng.randrange(9)):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["one.", "two?", " \t\n", "three", "é. ", None, "", "four! \v"])))
    return rows + rows[3:30]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(*r, "x", 1, 2, "y", 3, 4) for r in odd_rows()]
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], KIND).write.parquet(f"{folder}/none/conversations.parquet")
    return folder


def check_sql(spark, folder, name):
    found = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    wanted = con.sql(queries.SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    # a text key, as nulls don't compare
    assert sorted(map(str, map(tuple, found.select(*sorted(found.columns)).collect()))) == sorted(map(str, wanted.select(*(f'"{c}"' for c in sorted(wanted.columns))).fetchall()))


# --- prefix trie -------------------------------------------------------------------------------------


def plain_trie(conversations):
    """conv_id, depth: (parent, members, children, leaves, savings, digest) of every node, by plain dictionaries."""
    members, words = {}, {(): 0}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
            if d:
                words[tuple(turns[:d])] = len(turns[d - 1][1].split())
    name = {key: (min(m), len(key)) for key, m in members.items()}
    below = {key: [] for key in members}
    for key in members:
        if key:
            below[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in below[key]) or 1
        saved[key] = sum(saved[k] for k in below[key]) + (len(members[key]) - 1) * words[key]
    ended = {key: ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(key)))) for key, m in members.items()}
    return {name[key]: (name[key[:-1]][0] if key else None, len(m), len(below[key]), leaves[key], saved[key], hashlib.sha256(ended[key].encode()).hexdigest()) for key, m in members.items()}


@pytest.fixture
def many_ranges(spark):
    """Ranges as small as a cluster's are many: none are merged."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_equals_dictionaries(spark, many_ranges):
    """Shared beginnings, one very long conversation, a node with many children; lists ranked on several levels."""
    rng = random.Random(8)
    conversations = {0: [], 1: [("user", f"w{i} of it") for i in range(300)]}
    for c in range(2, 120):
        other = conversations[rng.choice(sorted(conversations))]
        conversations[c] = other[: rng.randrange(len(other) + 1)] + [("user", f"a b{rng.randrange(3)}") for _ in range(rng.randrange(4))]
    conversations |= {c: [("assistant", f"own {c} words")] for c in range(200, 300)}
    conversations |= {c: conversations[1] for c in range(300, 340)}
    rows = [(c, d, role, text) for c, turns in conversations.items() for d, (role, text) in enumerate(turns, 1)] + [(c, 0, None, "") for c, turns in conversations.items() if not turns]
    frame = spark.createDataFrame(rows, "conv_id long, depth int, role string, text string")
    turns = frame.selectExpr("conv_id", "depth", "depth div 50 AS block", "xxhash64(role, text) AS a", "xxhash64(text, role) AS b", "CAST(regexp_count(text, '[^ ]+') AS LONG) AS words")
    found = {tuple(r[:2]): tuple(r[2:]) for r in prefixtrie.trie(turns, most=12).collect()}
    assert found == plain_trie(conversations)


def test_trie_odd(spark, odd, many_ranges):
    check_sql(spark, odd, "op11_prefix_trie")
    assert queries.QUERIES["op11_prefix_trie"](spark, f"{odd}/none").count() == 0


# --- structure repair --------------------------------------------------------------------------------


def all_alignments(initials, faults, string):
    """(cost, audit) of every way to make a string of the turns."""
    if not initials and not string:
        yield 0, ""
    if initials:
        for cost, audit in all_alignments(initials[1:], faults[1:], string):
            yield cost + 2, "D" + audit
    if string and string[0] != "s":
        for cost, audit in all_alignments(initials, faults, string[1:]):
            yield cost + 5, "I" + audit
    if initials and string and faults[0] in "-t" and (initials[0] == string[0] or string[0] != "s"):
        for cost, audit in all_alignments(initials[1:], faults[1:], string[1:]):
            yield cost + (initials[0] != string[0]) + 5 * (faults[0] == "t"), ("K" if initials[0] == string[0] else "R") + audit


def test_repair_equals_all_alignments():
    rng = random.Random(5)
    strings = ["", *(s + "ua" * k for k in (1, 2, 3) for s in ("", "s"))]
    for _ in range(400):
        n = rng.randrange(6)
        initials, faults = "".join(rng.choice("suax") for _ in range(n)), "".join(rng.choice("---tbd") for _ in range(n))
        assert turnrepair.repair(initials, faults) == min(x for s in strings for x in all_alignments(initials, faults, s)), (initials, faults)


def test_long_conversations_are_repaired_in_near_linear_time():
    rng = random.Random(6)
    initials, faults = "su" + "".join("au"[i % 2] if rng.random() > 0.05 else "u" for i in range(8_000)), "".join(rng.choices("-tbd", [90, 4, 3, 3], k=8_002))
    began = time.process_time()
    cost, audit = turnrepair.repair(initials, faults)
    assert time.process_time() - began < 60
    assert sum(2 * (x == "D") + (x == "R") + 5 * (x == "I") for x in audit) <= cost
    kept = "".join("?" if x == "R" else c for x, c in zip(audit.replace("I", ""), initials) if x != "D")
    assert audit.replace("I", "") and len(audit.replace("I", "")) == len(initials) and kept[0] in "su?"


def test_repaired_conversations_alternate(spark, sf):
    from wirelake.llm.common import read_table

    rows = turnrepair.damaged(read_table(spark, sf, "conversations"))
    turns = turnrepair.repaired(rows, turnrepair.audits(rows)).filter("position IS NOT NULL").orderBy("conv_id", "position").collect()
    by_conv = {}
    for r in turns:
        by_conv.setdefault(r["conv_id"], []).append(r)
    for found in by_conv.values():
        assert [r["position"] for r in found] == list(range(len(found)))
        initials = "".join(r["role"][0] for r in found)
        assert initials.removeprefix("s") and initials.removeprefix("s") == "ua" * (len(initials) // 2)
        assert all(r["text"].strip() for r in found if r["edit"] in "KR") and all(r["text"] == "" for r in found if r["edit"] == "I")


def test_repair_odd(spark, odd):
    check_sql(spark, odd, "op13_structure_repair")
    assert queries.QUERIES["op13_structure_repair"](spark, f"{odd}/none").count() == 0
