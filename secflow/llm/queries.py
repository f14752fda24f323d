"""Queries of the training-data operators over the whole supplied tables, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.llm import byte_bpe, conversations, decontaminate, merkle, near, privacy, quality, shards, substrings, suffixes, token_files, toxicity, warc
from secflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

WORD_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(quality.ledger(table(spark, sf_dir, "documents")))


OP1_SQL = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORD_SQL} AS w FROM documents),
g AS (SELECT doc_id, text, w, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS g FROM w),
u AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM g),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM u) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM t, (SELECT unnest([0, 1, 2]) AS d) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM g),
m AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 coalesce(r.n, 0) AS n_repeat_words, CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words FROM l LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words < 50 AS b0, 100 * n_repeat_words > 50 * n_words AS b1, 10 * n_symbols > 2 * n_words AS b2,
 n_lines >= 3 AND 10 * n_dup_lines > 4 * n_lines AS b3, word_chars < 2 * n_words OR word_chars > 15 * n_words AS b4, 10 * n_letter_words < 6 * n_words AS b5 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letter_words, base_failed, 'production' AS policy, NOT (base_failed OR b2 OR b3 OR b5) AS kept,
CAST(CAST(b0 AS INT) + 2 * CAST(b1 AS INT) + 4 * CAST(b2 AS INT) + 8 * CAST(b3 AS INT) + 16 * CAST(b4 AS INT) + 32 * CAST(b5 AS INT) AS BIGINT) AS fail_bits FROM f"""


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.PREDICT_AT).cast("int").alias("predicted"), "spans")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", F.when(F.col("kind") == "revisit", F.col("full")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(F.col("sha1")).alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP5_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY n, h) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND keeper <> page_id THEN keeper END AS refers_to FROM k"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


PLAIN_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
OP6_SQL = rf"""WITH d AS (SELECT doc_id, {PLAIN_SQL} AS w FROM documents), b AS (SELECT item_id, {PLAIN_SQL} AS w FROM benchmark),
i AS (SELECT item_id, unnest([array_to_string(w[i : i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS t, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT t, m FROM i), x AS (SELECT DISTINCT m FROM k),
p AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, x WHERE len(w) >= m),
h AS (SELECT doc_id, s, p.m, t FROM p JOIN k ON p.m = k.m AND array_to_string(w[s : s + p.m - 1], ' ') = k.t),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS q FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h JOIN i USING (t, m)) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = privacy.spans(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return rows.select(F.col("id").alias("doc_id"), *[of(n).alias(f"n_{k}") for n, k in enumerate(privacy.KINDS[:4])],
                       F.sha2(privacy.listed(F.filter("spans", lambda x: x["kind"] < 4)), 256).alias("base_sha256"), privacy.listed(F.col("spans")).alias("spans"))


def op9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


LOWER_SQL = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
OP9_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, {LOWER_SQL} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), j AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p, q FROM j JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT p, q FROM e UNION SELECT r.p, e.q FROM r JOIN e ON r.q = e.p), c AS (SELECT p, min(q) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.p = d.doc_id"""


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""WITH d AS (SELECT doc_id, {WORD_SQL} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35), h AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM r), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


#: crc32 of the ASCII texts ``k``, from a table of 256 entries made by eight shifts of each byte.
CRC_SQL = """b(i, c, r) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, r + 1 FROM b WHERE r < 8),
crcs AS (SELECT i, c FROM b WHERE r = 8),
crc(k, j, c) AS (SELECT k, 0, 4294967295 FROM keys UNION ALL SELECT crc.k, j + 1, xor(crc.c >> 8, crcs.c) FROM crc JOIN crcs ON crcs.i = xor(crc.c & 255, ascii(substr(crc.k, j + 1, 1))) WHERE j < length(crc.k)),
sums AS (SELECT k, xor(c, 4294967295) AS crc FROM crc WHERE j = length(k))"""
FIELD_SQL = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in merkle.FIELDS)
OP11_SQL = f"""WITH RECURSIVE keys AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS k FROM documents WHERE doc_id IS NOT NULL), {CRC_SQL},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({FIELD_SQL}) AS leaf, sha256({FIELD_SQL.replace("CAST(n_chars AS", "CAST(n_chars + 1 AS")}) AS forged, coalesce(crc % {merkle.TAMPER} = 0, FALSE) AS hit
 FROM documents LEFT JOIN sums ON k = CAST(doc_id AS VARCHAR)),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t(tree, lvl, l) AS (SELECT tree, 0, list(leaf ORDER BY pos) FROM p GROUP BY tree UNION ALL SELECT tree, lvl + 1, [sha256(l[i] || coalesce(l[i + 1], '')) FOR i IN range(1, len(l) + 1, 2)] FROM t WHERE len(l) > 1),
s AS (SELECT tree, lvl AS h, l[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM t WHERE len(l) = 1),
u(lvl, l) AS (SELECT 0, list(subroot ORDER BY place) FROM s UNION ALL SELECT lvl + 1, [sha256(l[i] || coalesce(l[i + 1], '')) FOR i IN range(1, len(l) + 1, 2)] FROM u WHERE len(l) > 1),
f(doc_id, tree, pos, lvl, h, place, cur, proof, leaf) AS (SELECT doc_id, p.tree, pos, 0, h, place, CASE WHEN hit THEN forged ELSE leaf END, '', leaf FROM p JOIN s ON s.tree = p.tree
 UNION ALL SELECT doc_id, f.tree, pos // 2, f.lvl + 1, h, place, sha256(CASE WHEN pos % 2 = 1 THEN t.l[pos] || cur ELSE cur || coalesce(t.l[pos + 2], '') END), proof || coalesce(CASE WHEN pos % 2 = 1 THEN t.l[pos] ELSE t.l[pos + 2] END, ''), leaf
 FROM f JOIN t ON t.tree = f.tree AND t.lvl = f.lvl WHERE len(t.l) > 1),
g(doc_id, tree, pos, lvl, cur, proof, leaf) AS (SELECT doc_id, tree, place, 0, cur, proof, leaf FROM f WHERE lvl = h
 UNION ALL SELECT doc_id, tree, pos // 2, g.lvl + 1, sha256(CASE WHEN pos % 2 = 1 THEN u.l[pos] || cur ELSE cur || coalesce(u.l[pos + 2], '') END), proof || coalesce(CASE WHEN pos % 2 = 1 THEN u.l[pos] ELSE u.l[pos + 2] END, ''), leaf
 FROM g JOIN u ON u.lvl = g.lvl WHERE len(u.l) > 1)
SELECT doc_id, leaf, subroot, l[1] AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = l[1] AS verified FROM g JOIN s USING (tree) JOIN u ON u.lvl = g.lvl WHERE len(u.l) = 1"""


def _best(*options: str) -> str:
    return f"least({', '.join(options)})"


def _grown(state: str, cost: str, edits: str, line: str, began: bool) -> str:
    """A state ``cost edits chr(1) rows`` with more of each; null stays null. Cost comes first, so ``least`` picks the cheapest, then the least edits."""
    cut = f"strpos({state}, chr(1))"
    new = "" if not line else f" || {line if not began else f'chr(10) || {line}'}"
    return f"(lpad(CAST(CAST({state}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10, {cut} - 10) || '{edits}' || substr({state}, {cut}){new})"


def _op12_sql() -> str:
    """The repair as a recursion over a conversation's rows with one text for each place in the grammar."""
    extra, may = "CASE WHEN fault = 3 THEN 1 ELSE 0 END", "fault NOT IN (1, 2)"
    when = lambda cond, x: f"CASE WHEN {cond} THEN {x} END"
    user, aide = "('user:' || text)", "('assistant:' || text)"
    keep = lambda s, i, began: when(f"{may} AND initial = '{i}'", _grown(s, extra, "K", "(role || ':' || text)", began))
    rerole = lambda s, line, began: when(may, _grown(s, f"2 + {extra}", "R", line, began))
    delete = lambda s: _grown(s, "3", "D", "", True)
    # places with an insertion before the row
    into_u = lambda s, began: _grown(s, "2", "I", "'user:'", began)
    before_u = _best(into_u("s0", False), into_u("s1", True), into_u("s3", True))
    before_a = _grown("s2", "2", "I", "'assistant:'", True)
    to_u = [f(s, *more, began) for s, began in (("s0", False), ("s1", True), ("s3", True), ("i3", True)) for f, more in ((keep, ("u",)), (rerole, (user,)))]
    to_a = [f(s, *more, True) for s in ("s2", "i2") for f, more in ((keep, ("a",)), (rerole, (aide,)))]
    s0, s1 = delete("s0"), _best(delete("s1"), keep("s0", "s", False))
    s2, s3 = _best(delete("s2"), delete("i2"), *to_u), _best(delete("s3"), delete("i3"), *to_a)
    last_u = _grown("s2", "2", "I", "'assistant:'", True)
    return rf"""WITH RECURSIVE keys AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations), {CRC_SQL},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS what FROM conversations JOIN sums ON k = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
a AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c, (SELECT unnest([1, 2]) AS n) WHERE what <> 0 AND (n = 1 OR what = 3)),
m AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l FROM a),
r AS MATERIALIZED (SELECT conv_id, turn, role, text, initial, CASE WHEN l = '' THEN 1 WHEN seen > 1 THEN 2 WHEN l[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS j, lag(initial) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS prior FROM m),
w(conv_id, j, s0, s1, s2, s3) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000' || chr(1), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM r
 UNION ALL SELECT conv_id, j, {s0}, {s1}, {s2}, {s3} FROM (SELECT w.conv_id, r.j, role, text, initial, fault, s0, s1, s2, s3, {before_u} AS i2, {before_a} AS i3 FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.j = w.j + 1)),
z AS (SELECT conv_id, max(j) AS last FROM w GROUP BY 1), e AS (SELECT w.conv_id, {_best("s0", "s3", last_u)} AS s FROM w JOIN z ON w.conv_id IS NOT DISTINCT FROM z.conv_id AND w.j = z.last),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
 count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(CAST(s[1:9] AS BIGINT), 0) AS cost, coalesce(substr(s, 10, strpos(s, chr(1)) - 10), '') AS audit, sha256(coalesce(substr(s, strpos(s, chr(1)) + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


OP12_SQL = _op12_sql()


QUERIES: dict[str, Query] = {"op1_quality": op1_quality, "op2_shards": op2_shards, "op3_toxicity": op3_toxicity, "op4_byte_bpe": op4_byte_bpe, "op5_warc": op5_warc,
                             "op6_decontaminate": op6_decontaminate, "op7_suffixes": op7_suffixes, "op8_privacy": op8_privacy, "op9_near": op9_near,
                             "op10_substrings": op10_substrings, "op11_merkle": op11_merkle, "op12_conversations": op12_conversations, "op13_token_files": op13_token_files}
ORACLES: dict[str, str] = {"op1_quality": OP1_SQL, "op5_warc": OP5_SQL, "op6_decontaminate": OP6_SQL, "op9_near": OP9_SQL, "op10_substrings": OP10_SQL, "op11_merkle": OP11_SQL, "op12_conversations": OP12_SQL}
