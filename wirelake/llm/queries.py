"""The corpus queries that the entry module registers: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm import ann, chat, fingerprint, jaccard, langid, linetemplates, mixing, packing, pii, prefixtrie, secrets, toxicity, turnrepair
from wirelake.llm.common import read_table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter(base["kind"], F.lit(kind).__eq__)).cast("long").alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(read_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), "flagged")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return _digest(pii.find_personal_data(documents, pii.fit(documents)), pii.KINDS)


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetemplates.report(read_table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(probe)))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(prefixtrie.shared_first(read_table(spark, sf_dir, "conversations")))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turnrepair.damaged(read_table(spark, sf_dir, "conversations"))
    found = written(turnrepair.audits(rows), "audits")
    digests = turnrepair.digests(turnrepair.repaired(rows, found)).select(F.col("conv_id").alias("repaired_id"), "repaired_sha256")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("repaired_id"))).drop("repaired_id")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_personal_data": op4_personal_data,
    "op5_line_templates": op5_line_templates,
    "op6_neighbours": op6_neighbours,
    "op7_chat_format": op7_chat_format,
    "op8_secrets": op8_secrets,
    "op9_fingerprint": op9_fingerprint,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_language": op12_language,
    "op13_structure_repair": op13_structure_repair,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_M = mixing.DEFAULT


def _weights(name: str, weights: dict) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {_M.other} END" if weights else str(_M.other)


#: A table crc(t) of one row: the 256 remainders.
_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII expression, where crc(t) is at hand."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


def _step(state: str, cost: str, letter: str) -> str:
    """A state (cost in eight digits, then the audit so far) after one more edit."""
    return f"(lpad(({state}[1:8]::INT + {cost})::VARCHAR, 8, '0') || {state}[9:] || '{letter}')"


#: The least audits that end without a turn (p), after s, u and a; a cost of 50 million: none.
_NONE = "'50000000'"
_INSERTED_U = f"least(u, {_step('p', '5', 'I')}, {_step('s', '5', 'I')}, {_step('a', '5', 'I')})"
_TURN_COST = "CASE WHEN f = 't' THEN 5 ELSE 0 END"


def _filled(want: str, state: str) -> str:
    """A turn kept or given another role after a state."""
    return f"CASE WHEN f IN ('b', 'd') THEN {_NONE} WHEN c = '{want}' THEN {_step(state, _TURN_COST, 'K')} ELSE {_step(state, f'1 + {_TURN_COST}', 'R')} END"


def _shared(children: str, parent: str, name: str) -> str:
    """children (capacity, weight, total, and names) with budget: the parent's total shared among them."""
    order = f"PARTITION BY {parent} ORDER BY capacity / weight, {name} NULLS FIRST"
    return f"""(SELECT * EXCLUDE (short, before, rest, heavy), CASE WHEN short THEN capacity ELSE least(capacity, (rest * weight) // heavy) END AS budget FROM
 (SELECT *, total - coalesce(sum(capacity) FILTER (short) OVER (PARTITION BY {parent}), 0)::BIGINT AS rest, (sum(weight) FILTER (NOT short) OVER (PARTITION BY {parent}))::BIGINT AS heavy FROM
 (SELECT * EXCLUDE (short), min(short::INT) OVER ({order} ROWS UNBOUNDED PRECEDING) = 1 AS short FROM
 (SELECT *, capacity * (sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) <= (total - before) * weight AS short FROM
 (SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM {children})))))"""


SQL: dict[str, str] = {
    "op1_mixing": rf"""
WITH d AS (SELECT doc_id, lang, source, sum(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')))::BIGINT AS n_tokens FROM documents GROUP BY ALL),
 r AS (SELECT *, CASE WHEN k < 8 THEN 'web' WHEN k < 13 THEN 'forum' WHEN k < 17 THEN 'news' ELSE 'reference' END AS domain FROM (SELECT *, TRY_CAST(regexp_extract(source, '[0-9]+$') AS INT) AS k FROM d)),
 leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::BIGINT * {_M.epochs} AS capacity FROM r GROUP BY ALL),
 dom AS (SELECT domain, 1 AS one, sum(capacity)::BIGINT AS capacity, {_weights('domain', _M.domains)} AS weight, least((SELECT sum(supply)::BIGINT FROM leaf) * {_M.share} // {_M.of}, (SELECT sum(capacity)::BIGINT FROM leaf)) AS total FROM leaf GROUP BY 1),
 dom2 AS {_shared('dom', 'one', 'domain')},
 lng AS (SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, {_weights('l.lang', _M.langs)} AS weight, any_value(dom2.budget) AS total FROM leaf l JOIN dom2 USING (domain) GROUP BY 1, 2),
 lng2 AS {_shared('lng', 'domain', 'lang')},
 src AS (SELECT l.domain, l.lang, l.source, l.supply, l.capacity, {_weights('l.source', _M.sources)} AS weight, lng2.budget AS total FROM leaf l JOIN lng2 ON l.domain = lng2.domain AND l.lang IS NOT DISTINCT FROM lng2.lang),
 src2 AS {_shared('src', 'domain, lang', 'source')},
 f AS (SELECT r.*, s.supply, s.budget, CASE WHEN s.supply > 0 THEN s.budget // s.supply ELSE 1 END AS whole FROM r JOIN src2 s ON r.domain = s.domain AND r.lang IS NOT DISTINCT FROM s.lang AND r.source IS NOT DISTINCT FROM s.source),
 g AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{_M.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - n_tokens AS start FROM f)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN start < budget - whole * supply AND whole < {_M.epochs} THEN 1 ELSE 0 END)::INT AS n_copies FROM g""",
    "op2_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, text FROM documents),
 w AS (SELECT row, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM d),
 s AS (SELECT row, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
 n AS (SELECT row, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.row AS a, b.row AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.row < b.row GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
 t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 c AS (SELECT row, row AS r FROM d UNION SELECT c.row, t.b FROM c JOIN t ON t.a = c.r),
 m AS (SELECT c.row, min(x.doc_id) AS component_id FROM c JOIN d x ON x.row = c.r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN m ON m.row = d.row LEFT JOIN n ON n.row = d.row""",
    "op5_line_templates": rf"""
WITH l AS (SELECT doc_id, pos, part, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END for x in string_split(trim(part, ' ' || chr(10)), ' ')] AS tokens
  FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{linetemplates.PART}') AS parts FROM documents))),
 u AS (SELECT doc_id, tokens, length(part) AS chars FROM (SELECT doc_id, trim(part, ' ') AS part, tokens FROM (SELECT DISTINCT doc_id, regexp_replace(part, '([.!?]) \z|\n\z', '\1') AS part, tokens FROM l)) WHERE len(tokens) >= {linetemplates.MIN_TOKENS}),
 k AS (SELECT tokens, count(*) AS docs, [len(tokens)::VARCHAR] || tokens[1:{linetemplates.LEADING}] AS leaf FROM u GROUP BY tokens),
 own AS (SELECT doc_id FROM u JOIN k USING (tokens) GROUP BY 1 HAVING sum(CASE WHEN docs > 1 THEN chars ELSE 0 END) <= {linetemplates.COPIED} * sum(chars)),
 mixed AS (SELECT leaf FROM k GROUP BY 1 HAVING sum(docs) >= {linetemplates.MIN_DOCS} AND count(*) > 1),
 parts AS (SELECT leaf, tokens, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM k JOIN mixed USING (leaf)),
 common AS (SELECT leaf, pos, token, sum(docs) AS docs FROM parts GROUP BY ALL),
 fixed AS (SELECT leaf, pos, token FROM (SELECT *, sum(docs) OVER (PARTITION BY leaf, pos) AS every FROM common) WHERE docs >= {linetemplates.STEADY} * every),
 sizes AS (SELECT leaf, count(*) AS n_fixed FROM fixed GROUP BY 1),
 template AS (SELECT leaf, tokens FROM (SELECT leaf, tokens, count(*) AS met FROM parts JOIN fixed USING (leaf, pos, token) GROUP BY ALL) JOIN sizes USING (leaf) WHERE met = n_fixed AND n_fixed - {linetemplates.LEADING} >= {linetemplates.FIXED} * (len(tokens) - {linetemplates.LEADING})),
 followed AS (SELECT u.doc_id, tokens, own.doc_id IS NOT NULL AS own FROM u LEFT JOIN own ON own.doc_id = u.doc_id),
 gone AS (SELECT tokens FROM followed GROUP BY 1 HAVING count(*) FILTER (own) + max((NOT own)::INT) >= {linetemplates.MIN_DOCS}
  UNION SELECT tokens FROM template WHERE leaf IN (SELECT leaf FROM (SELECT DISTINCT leaf, doc_id, own FROM followed JOIN template USING (tokens)) GROUP BY 1 HAVING count(*) FILTER (own) + max((NOT own)::INT) >= {linetemplates.MIN_DOCS})),
 kept AS (SELECT l.doc_id, pos, part, gone.tokens IS NOT NULL AS out FROM l LEFT JOIN gone ON gone.tokens = l.tokens AND len(l.tokens) >= {linetemplates.MIN_TOKENS})
SELECT d.doc_id, count(pos) AS n_lines, (count(*) FILTER (out))::INT AS n_dropped, length(coalesce(string_agg(part, '' ORDER BY pos) FILTER (NOT out), '')) AS kept_chars, sha256(coalesce(string_agg(part, '' ORDER BY pos) FILTER (NOT out), '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id GROUP BY 1""",
    "op7_chat_format": r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
 t AS (SELECT *, coalesce(lag(role) OVER w, '') AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last,
  length(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '#')) - len(regexp_extract_all(text, '#+')) + len(regexp_extract_all(text, '#:')) + len(regexp_extract_all(text, '</')) + length(role) + 14 AS size
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars,
 bool_and(before || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AND (NOT last OR role = 'assistant')) AS valid FROM t GROUP BY 1""",
    "op11_prefix_trie": rf"""
WITH {_CRC_TABLE},
 o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
 r AS (SELECT c.conv_id, 0 AS own, place, role, text FROM c JOIN o ON o.conv_id = c.base AND place <= h UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND place > h),
 t AS (SELECT conv_id, row_number() OVER w AS depth, text, list(md5(len(role) || ':' || role || text)) OVER w AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place)),
 m AS (SELECT conv_id, depth, key, len(regexp_extract_all(text, '{_WORD}')) AS words FROM t UNION ALL SELECT conv_id, 0, []::VARCHAR[], 0 FROM c),
 e AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY 1),
 n AS (SELECT depth, key, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (depth = last) AS ended FROM m JOIN e USING (conv_id) GROUP BY 1, 2),
 f AS (SELECT n.*, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND k.key[1:n.depth] = n.key) AS n_children, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]),
 s AS (SELECT f.depth, f.key, count(*) FILTER (d.n_children = 0) AS n_leaves, sum(d.saved)::BIGINT AS saved_tokens FROM f JOIN f d ON d.depth >= f.depth AND d.key[1:f.depth] = f.key GROUP BY 1, 2)
SELECT conv_id, f.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ended, '')) AS ends_sha256 FROM f JOIN s ON s.depth = f.depth AND s.key = f.key""",
    "op13_structure_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
 k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
 d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE k WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
 r AS (SELECT conv_id, turn, i, role, text, CASE role WHEN '' THEN '?' ELSE role[1] END AS c,
  CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN body[-1] IN ('.', '!', '?') THEN '-' ELSE 't' END AS f FROM o),
 b AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM r) GROUP BY 1),
 dp AS (SELECT conv_id, 0::BIGINT AS i, '00000000' AS p, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL SELECT conv_id, i + 1, {_step('p', '2', 'D')}, least({_step('s', '2', 'D')}, CASE WHEN c = 's' AND f IN ('-', 't') THEN {_step('p', _TURN_COST, 'K')} ELSE {_NONE} END),
   least({_step('u', '2', 'D')}, {_filled('u', 'p')}, {_filled('u', 's')}, {_filled('u', 'a')}), least({_step('a', '2', 'D')}, {_filled('a', 'u')})
   FROM (SELECT e.* EXCLUDE (a), least(e.a, {_step('e.u', '5', 'I')}) AS a, r.c, r.f FROM (SELECT conv_id, i, p, s, {_INSERTED_U} AS u, a FROM dp) e JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i + 1)),
 best AS (SELECT conv_id, least(p, a, {_step('u', '5', 'I')}) AS state FROM dp JOIN b USING (conv_id) WHERE dp.i = b.n UNION ALL SELECT NULL, least(p, a, {_step('u', '5', 'I')}) FROM dp JOIN b ON dp.conv_id IS NULL AND b.conv_id IS NULL WHERE dp.i = b.n),
 l AS (SELECT conv_id, unnest(string_split(state[9:], '')) AS letter, generate_subscripts(string_split(state[9:], ''), 1) AS nth FROM best),
 m AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS place, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY nth)),
 g AS (SELECT m.conv_id, string_agg(CASE letter WHEN 'K' THEN r.role || ':' || r.text ELSE CASE (place - odd) % 2 WHEN 1 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN r.text ELSE '' END END, chr(10) ORDER BY nth) AS body
  FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i WHERE letter <> 'D' GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(state[1:8]::BIGINT, 0) AS cost, coalesce(state[9:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
