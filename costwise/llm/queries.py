"""The registered queries ``opN_*``: each reads its whole table, calls its operator with the
parameters for production, and derives the columns of its contract from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwise.llm import (
    chat, decontaminate, langid, main_text, ngram_join, packing, secret_scan, spelling, suffix_tree, token_count, top_k, trie, warc,
)
from costwise.llm.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, archive, with_record=False)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Params(ids=False)).drop("piece")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.with_spans(table(spark, sf_dir, "documents"))
    base = [F.col(f"spans_{k}") for k in ("assign", "access", "hex")]
    every = [F.col(f"spans_{r.kind}") for r in secret_scan.RULES]
    return found.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{k}") for k, c in zip(("assign", "access", "hex"), base, strict=True)],
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(every).alias("spans"),
    )


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), spelling.Params(misspell=199))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), trie.Params(family=20, most_shared=4))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(said)
    return chat.digests(stored(chat.format_chats(rows), "chats"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_top_k": op7_top_k,
    "op8_token_count": op8_token_count,
    "op9_main_text": op9_main_text,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_chat_format": op13_chat_format,
}

#: A-Z lowered, words by the contract's separators, sets of 4-word shingles; links by a self join, components by closure.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
         WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

#: Base32 by fives of hexadecimal digits (20 bits, four letters each).
OP2_SQL = r"""
WITH d AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
e AS (
  SELECT page_id, octet_length(b) AS payload_bytes,
    list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([32768, 1024, 32, 1],
      lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS INT) // q) % 32 AS INT) + 1, 1)),
      'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM d),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM e)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to FROM k
"""

OP7_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: CRC-32 by bytes: the table of 256 remainders is made by the polynomial's rule. Only U+0000 to U+00FF occur in the strings.
_CRC_TABLE = """
tab AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), list_transform(range(0, 8), lambda k: CAST(0 AS BIGINT))),
  lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t)"""


def _crc(text: str) -> str:
    data = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda x, y: xor(x // 256, t[xor(x, y) % 256 + 1])), 4294967295)"


#: Near words: the same word with one letter left out at the same place, or one is the other with a letter left out.
OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY doc_id, w),
h AS (SELECT w, n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM c, tab),
m AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
i AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM v),
d AS MATERIALIZED (SELECT word, k, substr(word, 1, CAST(k - 1 AS INT)) || substr(word, CAST(k + 1 AS INT)) AS s FROM i),
p AS (
  SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.k = b.k AND a.s = b.s AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.s UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.s),
q AS (SELECT p.a AS word, v.n AS near_n, p.b AS near FROM p JOIN v ON v.word = p.b),
best AS (
  SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM q),
f AS MATERIALIZED (
  SELECT v.word, v.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, CASE WHEN b.near_n >= 5 * v.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 5 * v.n THEN b.near_n END AS form_n
  FROM v LEFT JOIN best b ON b.word = v.word AND b.k = 1),
walk AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(roots.root, f.word) AS root FROM f LEFT JOIN roots ON roots.word = f.word
"""

#: Sequences are named by a chain of SHA-256; a subtree's nodes are those whose smallest member's path runs through its top.
OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM c, tab),
s AS (
  SELECT h.conv_id, t.pos, role, text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, t.pos, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
r AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, role, text FROM s),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS d, '' AS k, '' AS up, CAST(0 AS BIGINT) AS words FROM c
  UNION ALL
  SELECT r.conv_id, r.d, sha256(path.k || length(r.role) || ':' || r.role || r.text), path.k,
    CAST(len(regexp_extract_all(r.text, '[^\x20\x09-\x0D]+')) AS BIGINT) FROM path JOIN r ON r.conv_id = path.conv_id AND r.d = path.d + 1),
node AS MATERIALIZED (SELECT d, k, min(up) AS up, min(conv_id) AS m, count(*) AS n, max(words) AS words FROM path GROUP BY d, k),
named AS MATERIALIZED (SELECT path.conv_id, path.d, node.m FROM path JOIN node ON node.d = path.d AND node.k = path.k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY d, up),
full_node AS MATERIALIZED (
  SELECT node.d, node.k, node.m, node.n, (node.n - 1) * node.words AS saved, coalesce(kids.kids, 0) AS kids, up.m AS parent
  FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k LEFT JOIN node up ON up.d = node.d - 1 AND up.k = node.up),
total AS (
  SELECT named.m, named.d, sum(f.saved) AS saved, count(*) FILTER (f.kids = 0) AS leaves
  FROM full_node f JOIN named ON named.conv_id = f.m AND named.d <= f.d GROUP BY named.m, named.d),
ends AS (
  SELECT named.m, named.d, string_agg(CAST(named.conv_id AS VARCHAR), ',' ORDER BY named.conv_id) AS ids
  FROM named JOIN (SELECT conv_id, max(d) AS d FROM path GROUP BY conv_id) l ON l.conv_id = named.conv_id AND l.d = named.d GROUP BY named.m, named.d)
SELECT f.m AS conv_id, f.d AS depth, f.parent AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.kids AS BIGINT) AS n_children,
  CAST(total.leaves AS BIGINT) AS n_leaves, CAST(total.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM full_node f JOIN total ON total.m = f.m AND total.d = f.d LEFT JOIN ends ON ends.m = f.m AND ends.d = f.d
"""

#: Windows of the production parameters: 1024 tokens, 256 of history, blocks of 16 budgets, turn by turn.
OP13_SQL = r"""
WITH RECURSIVE a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
b AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}]{1,6}|[^\p{L}\p{M}\p{Nd}\x20\x09-\x0D]')) + 4 AS tok,
    replace(replace(replace(text, '\', '\b'), '<turn>', '\lturn>'), '</turn>', '\l/turn>') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '<turn>', '\lturn>'), '</turn>', '\l/turn>'), chr(10), '\n') AS head FROM a),
t AS MATERIALIZED (
  SELECT *, length(head) + length(body) + 15 AS len, sum(tok) OVER (PARTITION BY conv_id ORDER BY pos) - tok AS start FROM b),
y AS (SELECT conv_id, min(pos) AS pos FROM t WHERE role = 'system' GROUP BY conv_id),
z AS (SELECT t.conv_id, t.pos, t.tok, t.len, t.start // 16384 AS blk FROM y JOIN t ON t.conv_id = y.conv_id AND t.pos = y.pos WHERE t.tok <= 256),
u AS MATERIALIZED (
  SELECT t.*, t.start // 16384 AS blk, 768 - coalesce(z.tok, 0) AS room FROM t LEFT JOIN z ON z.conv_id = t.conv_id AND z.blk <= t.start // 16384),
w AS (
  SELECT conv_id, pos, blk, pos AS f, start AS begin, tok AS used FROM u WHERE pos = 1
  UNION ALL
  SELECT u.conv_id, u.pos, u.blk, CASE WHEN g THEN u.pos ELSE w.f END, CASE WHEN g THEN u.start ELSE w.begin END, CASE WHEN g THEN u.tok ELSE w.used + u.tok END
  FROM w JOIN (SELECT * FROM u) u ON u.conv_id = w.conv_id AND u.pos = w.pos + 1, LATERAL (SELECT u.blk <> w.blk OR w.used + u.tok > u.room AS g) x),
e AS (SELECT DISTINCT conv_id, f, begin FROM w),
k AS (
  SELECT e.conv_id, e.f, sum(t.len) AS len, min(t.pos) AS lead FROM e JOIN t ON t.conv_id = e.conv_id AND t.pos < e.f AND t.start + 256 >= e.begin GROUP BY e.conv_id, e.f),
x AS (
  SELECT e.conv_id, sum(coalesce(k.len, 0) + CASE WHEN z.pos < coalesce(k.lead, e.f) THEN z.len ELSE 0 END) AS repeated
  FROM e LEFT JOIN k ON k.conv_id = e.conv_id AND k.f = e.f LEFT JOIN z ON z.conv_id = e.conv_id GROUP BY e.conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(len) + max(x.repeated) AS BIGINT) AS formatted_chars
FROM t JOIN x ON x.conv_id = t.conv_id GROUP BY t.conv_id
"""

ORACLES: dict[str, str] = {
    "op11_spelling": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_chat_format": OP13_SQL,
    "op7_top_k": OP7_SQL,
    "op2_warc": OP2_SQL,
    "op3_ngram_jaccard": OP3_SQL,
}
