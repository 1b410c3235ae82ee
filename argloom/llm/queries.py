"""Registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argloom.llm import byte_bpe, conversation_trie, exact_dedup, jaccard, kd_shards, mixing, quality, secrets, substring_dedup, token_count, toxicity, warc, whitening


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), length=35)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, *secrets.fit(secrets.labelled(docs)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=1000)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir), n=5, threshold=0.8)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), max_epochs=3)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(documents(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.family_trie(table(spark, sf_dir, "conversations"), family=100, heads=6)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard(documents(spark, sf_dir), dims=("source", "lang", "n_chars"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS leader, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS nth FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND nth > 1 THEN leader END AS refers_to
FROM q
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 3.0::DOUBLE / weight AS level,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS water
  FROM named WINDOW w AS (ORDER BY source_size * 3.0::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size,
         CASE WHEN level <= (SELECT arg_min(water, level) FROM ranked WHERE water <= level) THEN (source_size * 3)::DOUBLE
              ELSE weight * (SELECT arg_min(water, level) FROM ranked WHERE water <= level) END AS target
  FROM ranked),
cum AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM sized)
SELECT doc_id, size, source_size, target,
       CAST(size * (CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END
            + CASE WHEN 2 * upto - size <= 2 * (target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM cum JOIN aimed ON cum.source IS NOT DISTINCT FROM aimed.source
"""

#: The table of CRC-32, and the checksum of the bytes of which ``hexes`` are the hexadecimal digits.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""


def _crc(hexes: str) -> str:
    octets = f"list_transform(regexp_extract_all({hexes}, '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


def _op13_level(k: int) -> str:
    """One level of the tree: ends of the nodes, their widest dimension, and the rows that go left."""
    spread = [f"CASE WHEN w{c} > 0 THEN (b{c} - a{c}) / w{c} ELSE 0.0::DOUBLE END" for c in range(3)]
    return f"""
n{k} AS (SELECT node, sum(size) / 2 AS want, {", ".join(f"min(c{c}) AS a{c}, max(c{c}) AS b{c}" for c in range(3))} FROM l{k} GROUP BY node),
x{k} AS (SELECT node, want, {", ".join(f"{e} AS s{c}" for c, e in enumerate(spread))} FROM n{k}, ends),
o{k} AS (SELECT l.*, want, CASE WHEN s0 >= s1 AND s0 >= s2 THEN c0 WHEN s1 >= s2 THEN c1 ELSE c2 END AS key FROM l{k} l JOIN x{k} USING (node)),
p{k} AS (SELECT *, 2 * sum(size) OVER (PARTITION BY node ORDER BY key, k1, k2, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size <= 2 * want AS goes_left FROM o{k}),
l{k + 1} AS (SELECT * EXCLUDE (node, want, key, goes_left), 2 * node + CASE WHEN goes_left THEN 0 ELSE 1 END AS node FROM p{k})"""


def _op13_shared(column: str) -> str:
    """Hexadecimal digits that all values of a column have at their start, whole bytes."""
    ends = f"min(hex(encode({column}))) AS a, max(hex(encode({column}))) AS b"
    return f"(SELECT coalesce(max(i), 0) // 2 * 2 FROM (SELECT a, b, unnest(range(1, 1 + least(len(a), len(b)))) AS i FROM (SELECT {ends} FROM documents)) WHERE a[1:i] = b[1:i])"


OP13_SQL = f"""
WITH {CRC_TABLE},
chars AS (SELECT min(n_chars)::DOUBLE AS least, max(n_chars)::DOUBLE AS most FROM documents),
l0 AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc("hex(encode(coalesce(text, '')))")} AS text_crc32,
         coalesce(('0x' || rpad(substr(hex(encode(source)), 1 + {_op13_shared("source")}, 12), 12, '0'))::BIGINT, -1) AS c0,
         coalesce(('0x' || rpad(substr(hex(encode(lang)), 1 + {_op13_shared("lang")}, 12), 12, '0'))::BIGINT, -1) AS c1,
         coalesce(CASE WHEN least = most THEN 0 ELSE floor((n_chars::DOUBLE - least) / (most - least) * 281474976710655.0::DOUBLE)::BIGINT END, -1) AS c2,
         ('0x' || md5(coalesce(text, ''))[1:12])::BIGINT AS k1, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:12])::BIGINT AS k2, 1 AS node
  FROM documents, crc_table, chars),
ends AS (SELECT {", ".join(f"max(c{c}) - min(c{c}) AS w{c}" for c in range(3))} FROM l0),{",".join(map(_op13_level, range(4)))}
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, (node - 16)::INT AS shard,
       row_number() OVER (PARTITION BY node ORDER BY xor(k1, k2), doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM l4
"""

OP11_SQL = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS mark, len(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS own, {_crc("hex(encode(c::VARCHAR))")} % 6 AS h, c - c % 100 AS host FROM turns, crc_table GROUP BY c, crcs),
heads AS (SELECT v.c, v.h, v.host, least(v.h, coalesce(w.own, 0)) AS taken FROM convs v LEFT JOIN convs w ON w.c = v.host),
rebuilt AS (
  SELECT h.c, pos, mark, chars FROM heads h JOIN turns t ON t.c = h.host WHERE pos <= taken
  UNION ALL SELECT h.c, pos - h + taken, mark, chars FROM heads h JOIN turns t ON t.c = h.c WHERE pos > h),
whole AS (SELECT c, coalesce(list(mark ORDER BY pos) FILTER (mark IS NOT NULL), []) AS marks, list(chars ORDER BY pos) FILTER (mark IS NOT NULL) AS chars FROM heads LEFT JOIN rebuilt USING (c) GROUP BY c),
starts AS (SELECT c, marks, chars, unnest(range(0, len(marks) + 1)) AS depth FROM whole),
nodes AS (
  SELECT array_to_string(marks[1:depth], '') AS node, depth, min(c) AS conv_id, count(*) AS n, max(coalesce(chars[depth], 0)) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = len(marks)), '')) AS ends_sha256
  FROM starts GROUP BY ALL),
children AS (SELECT node[1:64 * (depth - 1)] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
tall AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
above AS (SELECT node[1:64 * i] AS node, sum((n - 1) * chars) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM tall) GROUP BY ALL)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n AS n_convs, t.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, t.ends_sha256
FROM tall t JOIN above USING (node) LEFT JOIN nodes p ON t.depth > 0 AND p.node = t.node[1:64 * (t.depth - 1)]
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op9_mixing": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op13_sharding": OP13_SQL}
