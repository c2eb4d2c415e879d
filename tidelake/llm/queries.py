"""The queries opN_<name> over the whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import audio_fingerprints, exact_dedup, html_extraction, mixing, ngram_join, packing, tool_calls, toxicity, url_lists, warc
from tidelake.llm.common import small_batches, table


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Pages carry no fetch time: one is made from the id, seconds after 2024-01-01 within a year.
FIRST_FETCH, YEAR = 1_704_067_200, 31_536_000


def fetch_seconds():
    return F.lit(FIRST_FETCH) + (F.col("page_id") * 7919) % YEAR


def op1_external_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.capture_history(table(spark, sf_dir, "pages"), "page_id", "url", "html", F.timestamp_seconds(fetch_seconds()))
    return merged.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url_key", "timestamp", "range_no", "position"
    )


def _listed_patterns(pages: DataFrame) -> DataFrame:
    """List entries for the hosts and domains of pages: by the first digit of the pattern's digest, some are added at
    a time of that year, some of these are removed 30 days later, and some come back after 60."""
    hosts = pages.select(url_lists.host(F.col("url")).alias("h")).distinct().where("h <> ''")
    patterns = hosts.select(F.explode(F.filter(url_lists.keys_of(F.concat(F.lit("http://"), F.col("h"))), lambda k: ~k.contains("/"))).alias("pattern")).distinct()
    digest = F.md5("pattern")
    rows = patterns.select("pattern", F.conv(F.substring(digest, 1, 1), 16, 10).cast("int").alias("d"), (F.lit(FIRST_FETCH) + F.conv(F.substring(digest, 2, 7), 16, 10).cast("long") % YEAR).alias("t"))
    category = F.concat(F.lit("c"), (F.col("d") % 3).cast("string")).alias("category")
    added = rows.where("d < 9").select("pattern", category, F.col("t").alias("listed_at"), F.lit("add").alias("action"))
    removed = rows.where("d < 6").select("pattern", category, (F.col("t") + 30 * 86400).alias("listed_at"), F.lit("remove").alias("action"))
    again = rows.where("d < 3").select("pattern", F.lit("again").alias("category"), (F.col("t") + 60 * 86400).alias("listed_at"), F.lit("add").alias("action"))
    return added.unionByName(removed).unionByName(again)


def op2_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", fetch_seconds().alias("fetched_at"))
    return url_lists.evaluate(pages, _listed_patterns(pages))


OP2_SQL = rf"""
WITH c AS (
  SELECT page_id, url, {FIRST_FETCH} + (page_id * 7919) % {YEAR} AS fetched_at,
         string_split(lower(regexp_extract(url, '{url_lists.HOST}', 1)), '.') AS labels
  FROM pages
), keys AS (
  SELECT DISTINCT page_id, url, fetched_at, array_to_string(labels[i:], '.') AS pattern
  FROM (SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM c) WHERE array_to_string(labels, '.') <> ''
), p AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 1) AS INT) AS d, {FIRST_FETCH} + CAST('0x' || substr(md5(pattern), 2, 7) AS BIGINT) % {YEAR} AS t
  FROM (SELECT DISTINCT pattern FROM keys)
), entries AS (
  SELECT pattern, 'c' || (d % 3) AS category, t AS listed_at, 'add' AS action FROM p WHERE d < 9
  UNION ALL SELECT pattern, 'c' || (d % 3), t + {30 * 86400}, 'remove' FROM p WHERE d < 6
  UNION ALL SELECT pattern, 'again', t + {60 * 86400}, 'add' FROM p WHERE d < 3
), v AS (
  SELECT *, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to FROM entries
), hit AS (
  SELECT k.page_id, v.pattern, v.category, v.listed_at,
         row_number() OVER (PARTITION BY k.page_id ORDER BY length(v.pattern) DESC, v.pattern) AS n
  FROM keys k JOIN v ON v.pattern = k.pattern AND v.action = 'add' AND k.fetched_at >= v.listed_at AND (v.valid_to IS NULL OR k.fetched_at < v.valid_to)
)
SELECT c.page_id, c.url, CAST(c.fetched_at AS BIGINT) AS fetched_at, hit.page_id IS NOT NULL AS blocked, hit.pattern AS matched_pattern,
       hit.category AS matched_category, CAST(hit.listed_at AS BIGINT) AS listed_at
FROM c LEFT JOIN hit ON hit.page_id = c.page_id AND hit.n = 1
"""

#: Conversations carry no tool calls: every user turn is made one, the turn after it its result.
TOOLS = {
    "search": {"text": ("string", True), "n": ("integer", True)},
    "lookup": {"text": ("string", True), "n": ("integer", False), "deep": ("boolean", False)},
    "compute": {"text": ("string", True), "n": ("integer", True), "note": ("string", False)},
}


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    quoted = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    n = F.char_length("text").cast("string")
    users = turns.where("role = 'user'")
    calls = users.select(
        name(F.col("turn")).alias("call_id"), "conv_id", "turn",
        F.when(F.col("turn") % 3 == 0, "search").when(F.col("turn") % 3 == 1, "lookup").otherwise("compute").alias("name"),
        F.concat(F.lit('{ "text" : '), quoted, F.when(F.col("turn") % 4 == 2, F.concat(F.lit(', "n": "'), n, F.lit('"'))).otherwise(F.concat(F.lit(', "n": '), n)), F.when(F.col("turn") % 6 == 4, F.lit(', "deep": true')).otherwise(F.lit("")), F.lit(" }")).alias("arguments"),
        F.array(name(F.col("turn") - 2)).alias("depends_on"),
    )
    results = turns.where("role <> 'user'").select(name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    found = tool_calls.linked_calls(calls, results, TOOLS)
    return found.select("call_id", "conv_id", "turn", "name", "level", "result_turn", "n_results", F.array_join("faults", "; ").alias("faults"), "json")


OP3_SQL = r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
lv AS (
  SELECT conv_id, turn, 0 AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL
  SELECT u.conv_id, u.turn, lv.level + 1 FROM lv JOIN u ON u.conv_id = lv.conv_id AND u.turn = lv.turn + 2
), r AS (
  SELECT conv_id, turn - 1 AS at, min(turn) AS result_turn, count(*) AS n, arg_min(text, (turn, text)) AS content
  FROM conversations WHERE role <> 'user' GROUP BY ALL
), c AS (
  SELECT u.conv_id, u.turn, 'call-' || u.conv_id || '-' || u.turn AS call_id,
         CASE u.turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'compute' END AS name,
         u.turn % 4 = 2 AS text_n, u.turn % 6 = 4 AS deep, to_json(u.text) AS q, length(u.text) AS n, lv.level, r.result_turn, coalesce(r.n, 0) AS n_results, r.content
  FROM u JOIN lv ON lv.conv_id = u.conv_id AND lv.turn = u.turn LEFT JOIN r ON r.conv_id = u.conv_id AND r.at = u.turn
)
SELECT call_id, conv_id, turn, name, CAST(level AS INT) AS level, result_turn, CAST(n_results AS BIGINT) AS n_results,
       concat_ws('; ', CASE WHEN text_n THEN 'n is not integer' END, CASE WHEN deep AND name <> 'lookup' THEN 'unknown deep' END) AS faults,
       '{"arguments":{' || CASE WHEN deep THEN '"deep":true,' ELSE '' END || '"n":' || CASE WHEN text_n THEN '"' || n || '"' ELSE CAST(n AS VARCHAR) END || ',"text":' || q
         || '},"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM c
"""

#: Embeddings stand for recordings: each value is a note of an eighth of a second, its pitch by its size.
RATE, NOTE = 4096, 512


def _melody(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        tunes = []
        for vector in batch.column(1):
            v = np.nan_to_num(np.array(vector.as_py() or [], float))
            pitch = 45 + np.floor(np.clip((v + 0.4) / 0.8, 0, 0.999) * 36)
            phase = np.repeat(440 * 2 ** ((pitch - 69) / 12) * (2 * np.pi / RATE), NOTE).cumsum()
            tunes.append(np.sin(phase).astype(np.float32))
        ends = np.cumsum([0, *map(len, tunes)]).astype(np.int32)
        samples = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*tunes, np.empty(0, np.float32)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), samples], ["vec_id", "samples"])


def op9_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    media = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(_melody, "vec_id long, samples array<float>")
    return audio_fingerprints.search(audio_fingerprints.fingerprints(media, "vec_id", "samples", RATE), "vec_id", F.col("vec_id") % 20 == 0)


def op10_maximum_scoring_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extraction.extract_text(pages, html_extraction.fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def held_out(doc_id: str = "doc_id"):
    """The fold whose labels are never learnt."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return toxicity.fit(docs, labels)


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.decide(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, keep_id = doc_id AS kept, text_sha256 FROM g
"""


def op6_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), *vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS ss
  FROM w
), u AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS s FROM g
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT g.doc_id, CAST(len(g.ss) AS BIGINT) AS n_shingles, c.component_id
FROM g JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = g.doc_id
"""

#: Powers that temper the present token shares to targets: sources halfway to equal, languages and topics nearly kept.
MIX_POWERS = {"source": 0.5, "lang": 0.8, "topic": 0.9}
#: Topics are length classes here, as documents carry none: under 100, 1,000, 10,000 characters, and above.
TOPIC_EDGES = (100, 1_000, 10_000)


def mix_columns() -> dict:
    n = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    topic = F.lit("t0")
    for i, edge in enumerate(TOPIC_EDGES, 1):
        topic = F.when(n >= edge, f"t{i}").otherwise(topic)
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}


def mix_tokens():
    """Words stand for tokens: runs of characters other than blanks."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", 0).otherwise(F.char_length(squeezed) - F.char_length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1)


def op8_iterative_proportional_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = mixing.calibrated(docs, mix_columns(), mix_tokens(), MIX_POWERS)
    number = mixing.uniform(F.col("doc_id"))
    return found.select("doc_id", F.round("mix_probability", 6).alias("probability"), F.round("mix_cell_weight", 9).alias("cell_weight"), (number < F.col("mix_probability")).alias("kept"))


def _op8_sql() -> str:
    steps, last = [], "w0"
    for sweep in range(mixing.SWEEPS):
        for c in ("source", "lang", "topic"):
            name = f"w_{sweep}_{c}"
            steps.append(f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * t.target / sum(c.w) OVER (PARTITION BY c.{c}) AS w FROM {last} c JOIN t_{c} t ON c.{c} = t.v)")
            last = name
    targets = [f"t_{c} AS MATERIALIZED (SELECT v, p / sum(p) OVER () AS target FROM (SELECT {c} AS v, pow(CAST(sum(tokens) AS DOUBLE), {MIX_POWERS[c]}) AS p FROM cells GROUP BY {c} HAVING sum(tokens) > 0))" for c in ("source", "lang", "topic")]
    a, b, c = TOPIC_EDGES
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, length(coalesce(text, '')) AS n,
         trim(regexp_replace(coalesce(text, ''), '[ 	-
]+', ' ', 'g')) AS s
  FROM documents
), e AS MATERIALIZED (
  SELECT doc_id, source, lang, CASE WHEN n >= {c} THEN 't3' WHEN n >= {b} THEN 't2' WHEN n >= {a} THEN 't1' ELSE 't0' END AS topic,
         CASE WHEN s = '' THEN 0 ELSE length(s) - length(replace(s, ' ', '')) + 1 END AS tokens
  FROM d
), cells AS MATERIALIZED (
  SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY ALL
), {", ".join(targets)}, w0 AS MATERIALIZED (
  SELECT source, lang, topic, tokens, CAST(tokens AS DOUBLE) AS w FROM cells WHERE tokens > 0
), {", ".join(steps)}, p AS MATERIALIZED (
  SELECT *, (w / tokens) / max(w / tokens) OVER () AS p FROM {last}
)
SELECT e.doc_id, round(CASE WHEN e.tokens > 0 THEN coalesce(p.p, 0) ELSE 0 END, 6) AS probability, round(coalesce(p.w, 0), 9) AS cell_weight,
       CAST(CAST('0x' || substr(md5('mix:' || CAST(e.doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / {float(16**13)} < CASE WHEN e.tokens > 0 THEN coalesce(p.p, 0) ELSE 0 END AS kept
FROM e LEFT JOIN p ON p.source = e.source AND p.lang = e.lang AND p.topic = e.topic
"""


QUERIES = {
    "op2_temporal_list_join": op2_temporal_list_join,
    "op3_tool_call_linking": op3_tool_call_linking,
    "op9_chroma_fingerprints": op9_chroma_fingerprints,
    "op1_external_index_merge": op1_external_index_merge,
    "op10_maximum_scoring_subsequence": op10_maximum_scoring_subsequence,
    "op8_iterative_proportional_fitting": op8_iterative_proportional_fitting,
    "op4_compression_toxicity": op4_compression_toxicity,
    "op5_heavy_hitter_dedup": op5_heavy_hitter_dedup,
    "op6_hierarchical_packing": op6_hierarchical_packing,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
}
ORACLES = {"op2_temporal_list_join": OP2_SQL, "op3_tool_call_linking": OP3_SQL, "op5_heavy_hitter_dedup": OP5_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op8_iterative_proportional_fitting": _op8_sql()}
