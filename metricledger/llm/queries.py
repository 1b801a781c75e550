"""The dealt operators as queries over the given tables, with production parameters, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger.llm import decontam, merkle, minhash, packing, phrases, quality, rules, sharding, simhash, substring, toxicity, urls, warc
from metricledger.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def op1_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def _scored(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op6_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("url")


def op7_deletion_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = warc.round_trip(table(spark, sf_dir, "pages")).where("is_last")
    return last.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


def op9_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op10_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels"))).drop("ratio")


def op11_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op12_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_hamming_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_minimax_sharding,
        op2_swap_packing,
        op3_window_decontamination,
        op4_chunk_dedup,
        op5_additive_quality,
        op6_url_automaton,
        op7_deletion_simhash,
        op8_warc_chunks,
        op9_channel_toxicity,
        op10_ratio_rules,
        op11_merkle_climb,
        op12_toivonen_phrases,
        op13_hamming_minhash,
    )
}

_HOST = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '')"


def _coded(field: str) -> str:
    return f"coalesce(strlen({field}::VARCHAR) || ':' || {field}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({_coded('doc_id')} || {_coded('source')} || {_coded('lang')} || {_coded(n_chars)} || {_coded('text')})"


_CRC = """xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


TWINS: dict[str, str] = {
    "op6_url_automaton": f"""
        WITH parts AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        ruled AS (
            SELECT *, CASE WHEN {_fits('example.net', '/en/')} THEN 'example.net/en/' WHEN {_fits('example.com', '/de/')} THEN 'example.com/de/'
                           WHEN {_fits('org', '/fr/')} THEN 'org/fr/' WHEN {_fits('net', '/')} THEN 'net/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
                    WHEN host LIKE '%spam%' OR host LIKE '%cheap%pill%' OR host LIKE '%casino%' THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op8_warc_chunks": """
        WITH digests AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        firsts AS (SELECT payload_digest, min(page_id) AS first FROM digests WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM digests d LEFT JOIN firsts f ON d.payload_digest = f.payload_digest""",
    "op11_merkle_climb": f"""
        WITH RECURSIVE
        rows AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS seen FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows),
        tree AS (
            SELECT lang, 0 AS level, pos, n, leaf AS h FROM placed
            UNION ALL
            SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
        subs AS (SELECT lang, level AS height, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        top AS (
            SELECT 0 AS level, pos, n, h FROM subs
            UNION ALL
            SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
        climb AS (
            SELECT doc_id, lang, leaf, 0 AS level, pos, seen AS folded, '' AS proof FROM placed
            UNION ALL
            SELECT c.doc_id, c.lang, c.leaf, c.level + 1, c.pos // 2,
                   sha256(CASE WHEN s.h IS NULL THEN folded WHEN c.pos % 2 = 1 THEN s.h || folded ELSE folded || s.h END), proof || coalesce(s.h, '')
            FROM climb c JOIN subs u ON c.lang IS NOT DISTINCT FROM u.lang AND c.level < u.height
            LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1)),
        over AS (
            SELECT c.doc_id, c.leaf, u.h AS subroot, 0 AS level, u.pos, c.folded, c.proof
            FROM climb c JOIN subs u ON c.lang IS NOT DISTINCT FROM u.lang AND c.level = u.height
            UNION ALL
            SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.pos // 2,
                   sha256(CASE WHEN s.h IS NULL THEN folded WHEN c.pos % 2 = 1 THEN s.h || folded ELSE folded || s.h END), proof || coalesce(s.h, '')
            FROM over c JOIN (SELECT level AS height FROM top WHERE n = 1) t ON c.level < t.height
            LEFT JOIN top s ON s.level = c.level AND s.pos = xor(c.pos, 1))
        SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
        FROM over c JOIN top t ON t.n = 1 AND c.level = t.level""",
    "op12_toivonen_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        runs AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM words, range(1, 5) AS t(k) WHERE len(w) >= k),
        found AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
        candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM found WHERE k > 1),
        parts AS (
            SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
            FROM candidates, range(1, 4) AS t(cut) WHERE cut < k),
        cuts AS (
            SELECT p.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
            FROM parts p JOIN found x ON x.lang = p.lang AND x.phrase = head JOIN found y ON y.lang = p.lang AND y.phrase = tail),
        scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inside AS (
            SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer
            FROM candidates, range(2, 4) AS t(j), range(1, 4) AS u(i) WHERE j < k AND i + j - 1 <= k GROUP BY ALL),
        kept AS (SELECT s.* FROM scored s LEFT JOIN inside i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
