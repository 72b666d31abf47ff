"""The registered queries of the training-data operators and their SQL.

Every query reads its whole table and returns the operator's full result.
``SQL`` holds DuckDB SQL where SQL can express a query; the others are tested
against a brute-force version in ``tests/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm import (alignment, bottomk, bytebpe, chat, exact, ngram_join, packing, quality, spotsigs, substring,
                        token_counts, training_order, turn_trie)
from lectio.llm.common import read_table
from lectio.session import scratch_path


def op1_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    trees = token_counts.build_trees(docs.select("doc_id", "text", token_counts.demo_edits().alias("edits")))
    return token_counts.apply_edits(trees).select(
        "doc_id", "tokens_before", "tokens_after", "chars_before", "chars_after", "n_edits", "chars_encoded",
        F.size("leaf_tokens").cast("long").alias("n_leaves"))


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


#: Records of a shard: 8 MB each, so that small tables have several.
SHARD_SLOTS = 1 << 12


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "training-order")
    manifest = training_order.materialise(read_table(spark, sf_dir, "documents"), out, shard_slots=SHARD_SLOTS)
    rows = training_order.records(manifest, out, shard_slots=SHARD_SLOTS)
    return rows.select("slot", "shard", "byte_offset", "length", F.crc32("ids").alias("ids_crc32"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bytebpe.decode(bytebpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.with_edited(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "next_fingerprint",
        spotsigs.likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        spotsigs.likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
        F.size("signatures").cast("long").alias("n_signatures"),
        spotsigs.length_class(F.col("signatures")).alias("length_class"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.cut(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
                       F.size("spans").cast("long").alias("n_spans"))


#: A conversation whose texts hold markers of several templates.
HARD_TEXT = r"\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    records = rows.unionByName(hard).select(
        "conv_id", "turn", F.to_variant_object(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("record"))
    made = chat.format_turns(chat.canonical(records), "conv_id", ["turn"])
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       F.array_join(chat.read_learned(F.col("formatted"), F.col("loss_spans")), "").alias("learned"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.family_trie(read_table(spark, sf_dir, "conversations"))


def op13_bottomk_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_edit_token_counts": op1_edit_token_counts,
    "op2_cost_packing": op2_cost_packing,
    "op3_training_order": op3_training_order,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_spotsigs": op5_spotsigs,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_weak_label_quality": op10_weak_label_quality,
    "op11_token_alignment": op11_token_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bottomk_near_dedup": op13_bottomk_near_dedup,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _escaped(c: str) -> str:
    return rf"replace(replace(replace({c}, '\', '\0'), '<', '\1'), '>', '\2')"


SQL = {
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                              lambda x: x <> '') AS words FROM documents),
        g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram
              FROM d, unnest(range(1, len(words) - 11)) AS r(i)),
        f AS (SELECT gram, min(doc_id) AS source FROM g GROUP BY gram),
        hit AS (SELECT DISTINCT g.doc_id, g.i + j AS p FROM g JOIN f USING (gram), range(13) AS r(j)
                WHERE source < g.doc_id),
        w AS (SELECT doc_id, p, words[p] AS word FROM d, unnest(range(1, len(words) + 1)) AS r(p)),
        k AS (SELECT w.doc_id, count(h.p) AS n_removed,
                     string_agg(word, ' ' ORDER BY w.p) FILTER (h.p IS NULL) AS kept,
                     count(*) FILTER (h.p IS NOT NULL AND NOT EXISTS (
                         SELECT 1 FROM hit AS b WHERE b.doc_id = h.doc_id AND b.p = h.p - 1)) AS n_spans
              FROM w LEFT JOIN hit AS h ON h.doc_id = w.doc_id AND h.p = w.p GROUP BY w.doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
        FROM d LEFT JOIN k USING (doc_id)""",
    "op7_chat_formatting": rf"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END,
                          '\### Assistant: </turn> ok' FROM range(2) AS r(i))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               sum(22 + length({_escaped('role')}) + length({_escaped('text')}))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op8_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_FOLDED} AS folded FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(folded) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY folded)""",
    # the id's CRC-32 bit by bit; prefixes as the joined hashes of their turns
    "op12_prefix_trie": """
        WITH RECURSIVE crc AS (
          SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS v
          FROM conversations WHERE conv_id IS NOT NULL
          UNION ALL
          SELECT c, s, k + 1, CASE WHEN w & 1 = 1 THEN xor(w >> 1, CAST(3988292384 AS BIGINT)) ELSE w >> 1 END FROM (
            SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE v END AS w
            FROM crc WHERE k < 8 * length(s))),
        fam AS (SELECT c, c - c % 5 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE k = 8 * length(s)),
        own AS (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
                       strlen(coalesce(text, '')) AS size, turn, coalesce(role, '') AS role FROM conversations),
        turns AS (SELECT c, t, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, t) - 1 AS place
                  FROM own),
        made AS (SELECT f.c, t, size, place FROM fam AS f JOIN turns AS b ON b.c = f.base AND place < h
                 UNION ALL SELECT f.c, t, size, place FROM fam AS f JOIN turns AS o ON o.c = f.c AND place >= h),
        p AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY place) AS depth, size,
                     string_agg(t, '') OVER (PARTITION BY c ORDER BY place) AS key FROM made
              UNION ALL SELECT c, 0, 0, '' FROM fam),
        node AS (SELECT key, depth, size, min(c) AS conv, count(*) AS n FROM p GROUP BY key, depth, size),
        kids AS (SELECT substr(key, 1, length(key) - 32) AS key, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1),
        ends AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest
                 FROM (SELECT c, max_by(key, depth) AS key FROM p GROUP BY c) GROUP BY key),
        sums AS (SELECT a.key, CAST(sum((u.n - 1) * u.size) AS BIGINT) AS saved,
                        count(*) FILTER (NOT EXISTS (SELECT 1 FROM kids WHERE kids.key = u.key)) AS leaves
                 FROM node AS u JOIN p AS a ON a.c = u.conv AND a.depth <= u.depth GROUP BY a.key)
        SELECT v.conv AS conv_id, v.depth, up.conv AS parent_conv_id, v.n AS n_convs, coalesce(k, 0) AS n_children,
               leaves AS n_leaves, saved AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
        FROM node AS v JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key)
        LEFT JOIN node AS up ON v.depth > 0 AND up.key = substr(v.key, 1, length(v.key) - 32)""",
}
