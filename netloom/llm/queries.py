"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import collocations, conversation_repair, decontamination, embedding_dedup, html_extraction, jaccard_join, license_scan, quality_rules, sentencepiece_codec, token_counts, token_output, url_filters, warc
from netloom.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_measures(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    read = warc.read_archive(spark, path)
    stored = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


URL_RULES = (
    url_filters.UrlRule("allow", "com", "/"),
    url_filters.UrlRule("block", "example.com", "/en/"),
    url_filters.UrlRule("allow", "www.example.com", "/en/"),
    url_filters.UrlRule("block", "net", "/es/"),
    url_filters.UrlRule("block", "net", "/fr/"),
)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.document_licenses(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids again and compares."""
    path = _tokenizer("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = sentencepiece_codec.encode(docs.withColumn("sent", F.xxhash64(F.replace("text", F.lit("▁"), F.lit(" ")))), path, carry=("sent",))
    back = sentencepiece_codec.decode(encoded, path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.length("text").cast("long").alias("n_chars"), (F.xxhash64("text") == F.col("sent")).alias("round_trip"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_token_records(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return token_output.read_token_records(manifest, with_ids=False).withColumnRenamed("key", "doc_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair_report(conversation_repair.damaged(talks)).withColumnRenamed("conv_id", "found_id")
    every = talks.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), empty)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_quality_rules,
    op2_html_extraction,
    op3_warc,
    op4_url_filters,
    op5_license_scan,
    op6_decontamination,
    op7_jaccard_join,
    op8_sentencepiece,
    op9_token_counts,
    op10_token_output,
    op11_collocations,
    op12_conversation_repair,
    op13_embedding_dedup,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_STOP = "', '".join(dict.fromkeys(quality_rules.STOP_WORDS.split()))

QUALITY_SQL = f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (
  SELECT *, list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i+4], ' ')) AS gs FROM w),
h AS (
  SELECT *, list_distinct(list_filter(gs, lambda x, i: list_position(gs, x) < i)) AS rs FROM g),
s AS (
  SELECT *, list_filter(range(1, len(gs) + 1), lambda i: list_contains(rs, gs[i])) AS starts FROM h),
m AS (
  SELECT doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
    (CASE WHEN len(starts) = 0 THEN 0 ELSE 5 + coalesce(list_sum(list_transform(range(2, len(starts) + 1), lambda k: least(5, starts[k] - starts[k-1]))), 0) END)::BIGINT AS n_repeat_words,
    length(text) - length(replace(text, '!', '')) AS n_excl,
    len(list_filter(ws, lambda x: lower(x) IN ('{_STOP}'))) AS n_stop FROM s),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * n_symbols > 5 * word_chars
    OR 100 * n_excl > 30 * n_words OR (coalesce(lower(lang) IN ('en', 'de', 'fr', 'es'), false) AND n_words >= 40 AND n_stop < 0.02 * n_words)
    OR (n_words >= 10 AND 100 * n_dup_lines > 50 * n_lines)) AS kept
FROM b"""

URL_SQL = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (
  SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
  FROM u, r WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN j USING (page_id)"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.d = f.d"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, i, s.n, array_to_string(ws[i:i + s.n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(ws) - s.n + 2)) t(i)),
h AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""


COLLOCATIONS_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM w, unnest([1, 2, 3]) s(m), unnest(range(1, len(ws) - m + 2)) t(i)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 10),
k AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (1000000 * c.a * c.a) // (l.a * r.a) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(b) AS b
  FROM (SELECT lang, a AS b, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE m = 3))
  GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)::BIGINT AS rank, b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.b IS NULL OR 100 * i.b < 50 * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000"""

REPAIR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE z END))) AS crc
  FROM conversations),
k AS (SELECT *, xor(crc, 4294967295::BIGINT) % 20 AS kind FROM d),
a AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM a),
f AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM i),
r AS (SELECT *, blank OR seen AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM f),
g(q, ins, to_q, price, edits, lines) AS (VALUES
  (0, 0, 0, 0, '', []::VARCHAR[]), (1, 0, 1, 0, '', []), (2, 0, 2, 0, '', []), (3, 0, 3, 0, '', []),
  (0, 1, 2, 5, 'I', ['user:']), (0, 2, 3, 10, 'II', ['user:', 'assistant:']), (1, 1, 2, 5, 'I', ['user:']), (1, 2, 3, 10, 'II', ['user:', 'assistant:']),
  (2, 1, 3, 5, 'I', ['assistant:']), (3, 1, 2, 5, 'I', ['user:'])),
e(edit, q, initial, to_q, price, who) AS (VALUES
  ('K', 0, 's', 1, 0, NULL), ('K', 0, 'u', 2, 0, NULL), ('K', 1, 'u', 2, 0, NULL), ('K', 2, 'a', 3, 0, NULL), ('K', 3, 'u', 2, 0, NULL),
  ('R', 0, NULL, 2, 1, 'user'), ('R', 1, NULL, 2, 1, 'user'), ('R', 2, NULL, 3, 1, 'assistant'), ('R', 3, NULL, 2, 1, 'user'),
  ('D', 0, NULL, 0, 2, NULL), ('D', 1, NULL, 1, 2, NULL), ('D', 2, NULL, 2, 2, NULL), ('D', 3, NULL, 3, 2, NULL)),
s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM i
  UNION ALL
  SELECT conv_id, i, q, min(best) AS best FROM (
    SELECT s.conv_id, r.i, e.to_q AS q, {
      'cost': s.best.cost + g.price + e.price + CASE WHEN e.edit = 'D' THEN 0 ELSE r.more END, 'audit': s.best.audit || g.edits || e.edit,
      'lines': list_concat(s.best.lines, g.lines, CASE WHEN e.edit = 'D' THEN [] ELSE [coalesce(e.who, r.role) || ':' || r.text] END)} AS best
    FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1 JOIN g ON g.q = s.q
    JOIN e ON e.q = g.to_q AND (e.edit = 'D' OR NOT r.gone) AND (e.edit <> 'K' OR e.initial = r.role[1])
  ) GROUP BY conv_id, i, q),
z AS (
  SELECT s.conv_id, min({'cost': s.best.cost + g.price, 'audit': s.best.audit || g.edits, 'lines': list_concat(s.best.lines, g.lines)}) AS best
  FROM s JOIN (SELECT conv_id, max(i) AS m FROM i GROUP BY conv_id) t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.m = s.i JOIN g ON g.q = s.q AND g.to_q IN (0, 3) GROUP BY s.conv_id),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
    count(*) FILTER (NOT gone AND cut) AS truncated, count(*) FILTER (i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id"""

EMBEDDING_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT a AS vec_id, (SELECT count(*) FROM p WHERE p.a = r.a) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM r GROUP BY a"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": QUALITY_SQL,
        "op3_warc": WARC_SQL,
        "op4_url_filters": URL_SQL,
        "op6_decontamination": DECONTAMINATION_SQL,
        "op11_collocations": COLLOCATIONS_SQL,
        "op12_conversation_repair": REPAIR_SQL,
        "op13_embedding_dedup": EMBEDDING_SQL,
    }
