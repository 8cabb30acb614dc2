"""The queries of this subpackage and their DuckDB twins.

Each applies its operator, with its production parameters, to the whole of its
table, and returns the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.llm import align, arc, chat, decontam, embed_dedup, licenses, packing, quality, rules, shards, simhash, toxicity, trie
from reviewlab.llm.common import fold, piece_model, read, shared_path, tokenizer_file

#: bytes of text in a shard at most
SHARD_BYTES = 1 << 20


#: a score from which on a document counts as good, or as toxic
CUT = 0.7


def _with_fold(scores: DataFrame, n: int, held: int) -> DataFrame:
    return scores.select("doc_id", (fold(F.col("doc_id"), n) == held).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return _with_fold(scores, 4, 2)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(read(spark, sf_dir, "embeddings"), 0.98)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return _with_fold(scores, 3, 1)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = arc.pages_to_warc(read(spark, sf_dir, "pages"), shared_path(spark, "warc"), 1000)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 0.8)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"), 0.8)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file(), 1024)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_documents(read(spark, sf_dir, "conversations"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = shared_path(spark, "shards")
    shards.write_shards(shards.extendible_shards(docs, "doc_id", F.octet_length("text"), SHARD_BYTES), path)
    back = shards.read_shards(spark, path, docs.schema).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "shard")
    sizes = back.groupBy("shard").agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return back.join(sizes, "shard").select("doc_id", "n_bytes", "shard", "shard_bytes", "shard_rows")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.family_trie(read(spark, sf_dir, "conversations"), family=5, heads=9)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(read(spark, sf_dir, "documents"), tokenizer_file(), piece_model())


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_packing": op8_packing,
    "op9_chat": op9_chat,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_alignment": op12_alignment,
    "op13_quality_rules": op13_quality_rules,
}

_STOP = ", ".join(f"'{x}'" for x in sorted({v for ws in rules.STOP_WORDS.values() for w in ws for v in (w, w.capitalize())}))

ORACLES: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE good AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach(u, w) AS (
          SELECT vec_id, vec_id FROM embeddings
          UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.w)
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.u = e.vec_id) AS n_links,
          (SELECT min(w) FROM reach r WHERE r.u = e.vec_id) AS component_id,
          (SELECT min(w) FROM reach r WHERE r.u = e.vec_id) = e.vec_id AS kept
        FROM embeddings e""",
    "op4_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT payload_digest AS d, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN m ON m.d = p.payload_digest AND p.payload_bytes >= 1000""",
    "op9_chat": f"""
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
                ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS len FROM t),
        p AS (SELECT conv_id, len, string_agg(coalesce(md5(role), '-') || '/' || coalesce(md5(text), '-'), ';')
                OVER (PARTITION BY conv_id ORDER BY len) AS pre, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM r),
        g AS (SELECT pre, len AS n_turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM p WHERE len = n_turns GROUP BY ALL),
        k AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pre = g.pre AND p.len = g.n_turns AND p.n_turns > g.n_turns))
        SELECT k.conv_id, (r.len - 1) // {chat.BLOCK} AS segment, k.n_turns, k.n_equal,
          string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10)
            || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY len) AS rendered
        FROM k JOIN r ON r.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL""",
    "op10_sharding": f"""
        WITH d AS (SELECT doc_id, strlen(text) AS n_bytes,
                lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
        p AS (SELECT doc_id, n_bytes, d AS depth, bits[1:d] AS shard FROM d, generate_series(0, 60) AS s(d)),
        s AS (SELECT shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY 1),
        f AS (SELECT p.doc_id, p.n_bytes, p.shard, s.shard_bytes, s.shard_rows,
                row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
              FROM p JOIN s USING (shard) WHERE s.shard_bytes <= {SHARD_BYTES} OR s.shard_rows = 1)
        SELECT doc_id, n_bytes, shard, shard_bytes, shard_rows FROM f WHERE k = 1""",
    "op11_prefix_trie": """
        WITH t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
              ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
        bits AS (  -- crc32: each byte, then its eight shifts
          SELECT conv_id, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
              lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM (SELECT DISTINCT conv_id FROM t)),
        c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(steps, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
              WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 9 AS h FROM bits),
        r AS (SELECT c.conv_id, t.pos, md5(t.role) || md5(t.text) AS k, strlen(t.text) AS bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
              UNION ALL SELECT c.conv_id, t.pos + 1000000, md5(t.role) || md5(t.text), strlen(t.text) FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
        p AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS bytes FROM c
              UNION ALL SELECT conv_id, row_number() OVER w, md5(string_agg(k, ',') OVER w), bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
        n AS (SELECT path, depth, bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY ALL),
        up AS (SELECT n.path, q.path AS up FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
        kids AS (SELECT up AS path, count(*) AS n_children FROM up GROUP BY 1),
        sums AS (SELECT q.path, count(*) FILTER (WHERE kids.path IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
                 FROM n LEFT JOIN kids USING (path) JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY 1),
        ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM
                 (SELECT conv_id, path FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY 1)
        SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
          coalesce(ends, sha256('')) AS ends_sha256
        FROM n LEFT JOIN up USING (path) LEFT JOIN n o ON o.path = up.up LEFT JOIN kids ON kids.path = n.path
          JOIN sums ON sums.path = n.path LEFT JOIN ends ON ends.path = n.path""",
    "op13_quality_rules": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
        g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS words FROM w, unnest(range(1, len(ws) - 6)) AS s(i)),
        a AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, words) > 1),
        v AS (SELECT r, sum(n)::BIGINT AS n_repeat_words FROM
                (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM a) GROUP BY r),
        m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
                len(list_filter(ws, lambda x: regexp_matches(x, '[^!-@\\[-`{{-~]'))) AS n_letters,
                len(list_filter(ws, lambda x: rtrim(x, '.,;:!?') IN ({_STOP}))) AS n_stop,
                len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\x09-\\x0D]*[-*•·‣]'))) AS n_bullets,
                len(list_filter(ls, lambda x: regexp_matches(x, '([.][.][.]|…)[ \\x09-\\x0D]*$'))) AS n_ellipses
              FROM w LEFT JOIN v USING (r)),
        b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1 AND n_letters / n_words >= 0.8
            AND n_stop / n_words >= 0.06 AND n_dup_lines / n_lines <= 0.3 AND n_bullets / n_lines <= 0.9 AND n_ellipses / n_lines <= 0.3 AS kept
        FROM b""",
}
