"""The training-data queries, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import classifier, conversation_trie, decontaminate, html_text, license_scan, mixing, near_dup, pseudo_likelihood, quality_rules, reply_trees, sharding, warc_zip
from .shared import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.cluster(_read(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op2_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality_prob", 6).alias("quality_prob"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"))


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, turn, role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").withColumn("text", F.lit(said))
    return reply_trees.digests(reply_trees.conversations(reply_trees.chain(told.unionByName(extra))))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archives = warc_zip.write_archives(_read(spark, sf_dir, "pages"), scratch.path("zip"), scratch)
    return warc_zip.read_archives(archives).drop("url", "payload")


def op9_cgk_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_read(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hyperminhash": op1_hyperminhash,
    "op2_site_templates": op2_site_templates,
    "op3_subword_quality": op3_subword_quality,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op5_quality_rules": op5_quality_rules,
    "op6_kd_shards": op6_kd_shards,
    "op7_reply_trees": op7_reply_trees,
    "op8_zip_warc": op8_zip_warc,
    "op9_cgk_decontaminate": op9_cgk_decontaminate,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_scan": op12_license_scan,
}


def _rules_sql() -> str:
    """op5 in DuckDB: the signals by list functions, EM as a chain of one-row tables over the counted vote patterns."""
    rules = list(quality_rules.RULES)
    smooth, votes = quality_rules.SMOOTH, ", ".join(f"v_{r}" for r in rules)
    case = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{r}" for r, (bad, good) in quality_rules.RULES.items())
    sql = f"""WITH base AS MATERIALIZED (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
      FROM documents),
    win AS (SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM base, unnest(range(1, len(w) - 1)) AS u(i)),
    twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY rid),
    signals AS (
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_distinct(w)) AS n_distinct, len(lines) AS n_lines,
             length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims,
             length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS n_letters,
             len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_marked
      FROM base LEFT JOIN covered c USING (rid)),
    voted AS MATERIALIZED (SELECT *, {case} FROM signals),
    patterns AS MATERIALIZED (SELECT {votes}, count(*) AS n FROM voted GROUP BY {votes}),
    q0 AS MATERIALIZED (SELECT *, CASE WHEN len(list_filter([{votes}], lambda x: x = -1)) > 1 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS q FROM patterns)"""
    for k in range(quality_rules.STEPS):
        share = lambda r, v, of: f"ln((coalesce(sum(n * {of}) FILTER (v_{r} = {v}), 0) + {smooth}) / (coalesce(sum(n * {of}) FILTER (v_{r} <> 0), 0) + {2 * smooth}))"
        cells = [f"{share(r, v, 'q')} - {share(r, v, '(1 - q)')} AS o_{r}_{v + 1}" for r in rules for v in (-1, 1)]
        sql += f""",
    m{k} AS MATERIALIZED (SELECT ln((sum(n * q) + {smooth}) / (sum(n * (1 - q)) + {smooth})) AS prior, {", ".join(cells)} FROM q{k}),
    q{k + 1} AS MATERIALIZED (SELECT {votes}, n, 1 / (1 + exp(-({_odds(rules)}))) AS q FROM patterns, m{k})"""
    return f"""{sql}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND q >= 0.5 AS kept, round(q, 6) AS quality_prob
    FROM voted JOIN q{quality_rules.STEPS} USING ({votes})"""


def _odds(rules: list[str]) -> str:
    return "prior + " + " + ".join(f"CASE v_{r} WHEN 1 THEN o_{r}_2 WHEN -1 THEN o_{r}_0 ELSE 0 END" for r in rules)


#: op1 in DuckDB: all pairs that share a shingle, exactly, and reachability.
_NEAR_DUP_SQL = """WITH RECURSIVE base AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    shingles AS MATERIALIZED (
      SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM base, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3
        UNION ALL SELECT doc_id, concat_ws(' ', w[1], w[2]) FROM base WHERE len(w) IN (1, 2))),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM common c JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c.n >= 85 * (s.n + t.n - c.n)),
    linked AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(node, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, linked.b FROM reach JOIN linked ON linked.a = reach.far),
    least_of AS (SELECT node, min(far) AS component_id FROM reach GROUP BY node)
    SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least_of ON node = d.doc_id"""


#: op7 in DuckDB: the turns and the learned texts by conversation, and the template's lengths.
_CHAT_SQL = """WITH told AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(15 + length(role) + length(text) + len(regexp_extract_all(text, '(?m)^\\\\*### |\\\\*</turn>'))) AS BIGINT) AS formatted_chars
    FROM told GROUP BY conv_id"""

#: op8 in DuckDB: digests, and the largest page of each large payload.
_WARC_SQL = """WITH paid AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    told AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM paid)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN response <> page_id THEN response END AS refers_to
    FROM told"""


ORACLES: dict[str, str] = {"op7_reply_trees": _CHAT_SQL, "op8_zip_warc": _WARC_SQL, "op1_hyperminhash": _NEAR_DUP_SQL, "op5_quality_rules": _rules_sql(), "op11_prefix_trie": conversation_trie.ORACLE, "op12_license_scan": license_scan.oracle()}
