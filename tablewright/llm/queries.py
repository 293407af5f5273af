"""The registered queries of this package, one per operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.llm import alignment, caps, chat, html, lexical, linededup, minhash, mixing, quality, sentencepieces, sharding, token_orc, warc
from tablewright.llm.common import documents
from tablewright.plans.registry import Registry

QUERIES = Registry()


@QUERIES.add("op7_sharding")
def op7_sharding(spark, folder):
    """Every document into shards 0 to 39; the law is the number of rows."""
    placed = sharding.shard(documents(spark, folder))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


MIX_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS prefix
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS spot,
    [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight
  FROM sizes),
stops AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop, 2.0::DOUBLE * source_size / weight AS stop_level,
    1.5::DOUBLE * sum(source_size) OVER () AS budget FROM weighed),
levels AS (
  SELECT *, (budget - coalesce(sum(stop) OVER (ORDER BY stop_level, spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY stop_level, spot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM stops),
targets AS (
  SELECT source, source_size, least(stop, weight * (SELECT arg_min(level, (stop_level, spot)) FROM levels
    WHERE level <= stop_level)) AS target FROM levels),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
    CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS rest FROM targets),
runs AS (
  SELECT source, prefix, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY prefix) AS BIGINT) AS upto
  FROM (SELECT source, prefix, CAST(sum(size) AS BIGINT) AS n FROM docs GROUP BY ALL)),
crossing AS (
  SELECT r.source, min(u.prefix) AS prefix, arg_min(u.upto, u.prefix) AS upto, arg_min(u.n, u.prefix) AS n
  FROM rests r JOIN runs u ON r.source IS NOT DISTINCT FROM u.source WHERE u.upto > r.rest GROUP BY r.source),
cuts AS (
  SELECT r.*, CASE WHEN r.source_size = 0 THEN 0 ELSE coalesce(c.prefix
    + CASE WHEN c.upto - r.rest < r.rest - (c.upto - c.n) THEN 1 ELSE 0 END, 1 << 36) END AS below
  FROM rests r LEFT JOIN crossing c ON r.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, d.size, c.source_size, round(c.target, 4) AS target,
  d.size * (c.passes + CASE WHEN d.prefix < c.below THEN 1 ELSE 0 END) AS taken
FROM docs d JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""


@QUERIES.add("op9_mixing", MIX_SQL)
def op9_mixing(spark, folder):
    mixed = mixing.mix(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


@QUERIES.add("op8_minhash")
def op8_minhash(spark, folder):
    return minhash.near_duplicates(documents(spark, folder))


@QUERIES.add("op6_quality")
def op6_quality(spark, folder):
    found = quality.judged(documents(spark, folder))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@QUERIES.add("op3_token_orc")
def op3_token_orc(spark, folder):
    return token_orc.round_trip(documents(spark, folder))


@QUERIES.add("op4_sentencepieces")
def op4_sentencepieces(spark, folder):
    """Every text encoded and decoded again; sizes and digests of both."""
    back = sentencepieces.decoded(sentencepieces.encoded(documents(spark, folder)))
    return back.select(
        "doc_id", "n_ids", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n < 100 OR page_id = min(page_id) OVER (PARTITION BY d) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= 100 AND page_id > min(page_id) OVER (PARTITION BY d) THEN min(page_id) OVER (PARTITION BY d) END AS refers_to,
  true AS digest_ok
FROM p
"""


@QUERIES.add("op5_warc", WARC_SQL)
def op5_warc(spark, folder):
    return warc.captures(documents(spark, folder, "pages"))


@QUERIES.add("op1_html")
def op1_html(spark, folder):
    return html.main_texts(documents(spark, folder, "pages"))


@QUERIES.add("op10_caps")
def op10_caps(spark, folder):
    return caps.near_vectors(documents(spark, folder, "embeddings"))


CHAT_SQL = """
WITH calls AS (
  SELECT conv_id, turn, text, 'c' || turn AS call_id, CASE WHEN turn % 4 < 2 THEN 'ask' ELSE 'brief' END AS name,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
chains AS (
  SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM calls),
placed AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, chain ORDER BY turn) - 1 AS level FROM chains)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS position,
  CAST(p.level AS INT) AS level,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN c.call_id IS NULL THEN 0 WHEN c.name = 'ask' THEN CAST(length(c.text) < 1 AS INT) + CAST(c.words < 3 AS INT)
    ELSE CAST(length(c.text) > 400 AS INT) + CAST(c.words < 1 AS INT) END AS n_errors,
  md5('{"arguments":' || coalesce('{"text":' || to_json(c.text)::VARCHAR || ',"words":' || c.words || '}', 'null')
    || ',"id":"' || coalesce(c.call_id, r.call_id) || '","name":' || coalesce('"' || c.name || '"', 'null')
    || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}') AS json_md5
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn
"""


@QUERIES.add("op2_tool_calls", CHAT_SQL)
def op2_tool_calls(spark, folder):
    """Turns of conversations read as calls and results, linked, ordered and written."""
    calls, results = chat.turns_as_calls(documents(spark, folder, "conversations"))
    rows = chat.transcript(calls, results, chat.TURN_TOOLS)
    return rows.select(
        "conv_id",
        "call_id",
        "position",
        "level",
        "status",
        F.size("errors").alias("n_errors"),
        F.md5(F.col("json").cast("binary")).alias("json_md5"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL_SQL = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
lengths AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM sizes, whole),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings, whole GROUP BY term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@QUERIES.add("op12_lexical", LEXICAL_SQL)
def op12_lexical(spark, folder):
    """The ten best documents for each benchmark item."""
    return lexical.search(documents(spark, folder), documents(spark, folder, "benchmark"))


LINES_SQL = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM cut),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT y.*, coalesce(f.first < y.doc_id, false) AS gone FROM keyed y LEFT JOIN firsts f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@QUERIES.add("op13_linededup", LINES_SQL)
def op13_linededup(spark, folder):
    """Lines that several documents share, left in the first of them."""
    kept = linededup.unrepeated_lines(documents(spark, folder).select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


@QUERIES.add("op11_alignment")
def op11_alignment(spark, folder):
    """Tokens of two vocabularies aligned in every document."""
    return alignment.scored(documents(spark, folder))
