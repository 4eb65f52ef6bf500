"""Registered queries of this subpackage over the given tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import counts, langid, neardup, packing, pieces, pseudonyms, quality, repair, secret_spans, sketches, spelling, topk, turns
from .encoding import default_path
from .frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def held_out() -> Column:
    """Documents kept from every fit: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def pseudonym_key(spark: SparkSession) -> bytes:
    """Secret of the pseudonyms. A cluster must set it; on one machine (tests) an unset key is a fixed one."""
    key = spark.conf.get("spark.tallyforge.pseudonym.key", None)
    if key is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.tallyforge.pseudonym.key: anyone can undo pseudonyms of a known key")
    return (key or "no secret").encode()


@query
def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(table(spark, sf_dir, "documents"), pseudonym_key(spark))


@query
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), end_id=1)


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = repair.write_token_files(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"), end_id=2)
    return repair.read_token_files(files)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), limit=1024)


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(table(spark, sf_dir, "documents"), default_path("piece_bpe_32k.model"))


ORACLES["op3_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op2_near_duplicates"] = """
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; see ``secret_spans``."""
    return secret_spans.report(table(spark, sf_dir, "documents"))


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of every conversation after damage; see ``turns``."""
    return turns.report(table(spark, sf_dir, "conversations"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents; see ``spelling``."""
    return spelling.report(table(spark, sf_dir, "documents"))


#: The 256 entries of the crc32 by its rule, as a list column t.
_CRC_TABLE = """(SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(i)))"""


def _crc(text):
    """crc32 of a string of code points below 256, as SQL over a table with the column t of _CRC_TABLE."""
    points = (f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [(194 + (ord(ch) // 192))::BIGINT, (128 + ord(ch) % 64)::BIGINT] END))")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {points}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"


ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE crc AS MATERIALIZED {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
own AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, w, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT w, k, {_crc("d || ':' || w")} AS h FROM own, crc),
said AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM said WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM words, unnest(range(length(word))) r(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY 1),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root FROM formed f JOIN chain c USING (word) JOIN formed z ON z.word = c.at AND z.form IS NULL
"""

_SPACE = r"[\x20\x09-\x0D]"
ORACLES["op12_turn_repair"] = rf"""
WITH RECURSIVE crc AS MATERIALIZED {_CRC_TABLE},
spaced AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations, crc),
harmed AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM spaced, unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) c(copy) WHERE harm <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM harmed),
seen AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?]{_SPACE}*$') AS is_cut FROM placed),
judged AS MATERIALIZED (SELECT *, is_blank OR again AS gone, NOT is_blank AND NOT again AND is_cut AS cut FROM seen),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (NOT is_blank AND again) AS duplicate, count(*) FILTER (cut) AS truncated,
   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY 1),
-- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
free(q, p) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
extra(q, p, k) AS (SELECT q, q, 0 FROM free UNION ALL SELECT q, p, 1 FROM free UNION ALL SELECT a.q, b.p, 2 FROM free a JOIN free b ON b.q = a.p UNION ALL SELECT a.q, c.p, 3 FROM free a JOIN free b ON b.q = a.p JOIN free c ON c.q = b.p),
kept(q, initial, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
moves AS MATERIALIZED (
  SELECT conv_id, i, e.q, k * 2 + 3 AS cost, repeat('I', k) || 'D' AS letters, e.p FROM judged, extra e
  UNION ALL SELECT conv_id, i, e.q, k * 2 + cut::INT, repeat('I', k) || 'K', t.p FROM judged j JOIN kept t ON t.initial = j.initial JOIN extra e ON e.p = t.q WHERE NOT gone
  UNION ALL SELECT conv_id, i, e.q, k * 2 + 2 + cut::INT, repeat('I', k) || 'R', f.p FROM judged, extra e JOIN free f ON f.q = e.p WHERE NOT gone),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit FROM facts
  UNION ALL SELECT conv_id, i, q, cost, audit FROM (
    SELECT w.conv_id, m.i, m.p AS q, w.cost + m.cost AS cost, w.audit || m.letters AS audit,
      row_number() OVER (PARTITION BY w.conv_id, m.p ORDER BY w.cost + m.cost, w.audit || m.letters) AS rn
    FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.q = w.q) WHERE rn = 1),
ends AS (SELECT f.conv_id, arg_min(w.cost + 2 * k, (w.cost + 2 * k, w.audit || repeat('I', k))) AS cost, arg_min(w.audit || repeat('I', k), (w.cost + 2 * k, w.audit || repeat('I', k))) AS audit
  FROM facts f JOIN walk w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n JOIN extra e ON e.q = w.q WHERE e.p IN (0, 3) GROUP BY 1),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS pos FROM ends WHERE audit <> ''),
steps AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS place FROM letters),
left_ AS (SELECT s.conv_id, s.place, s.letter, j.role, j.text, first_value(s.letter = 'K' AND j.initial = 's') OVER (PARTITION BY s.conv_id ORDER BY s.place) AS opened
  FROM steps s LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i AND s.letter <> 'I' WHERE s.letter <> 'D'),
shown AS (SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (place - opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS sha FROM left_ GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN shown s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""
