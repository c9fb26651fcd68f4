"""The registered corpus queries, one per numbered operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import bpe, chat, clusters, counts, dedup, kmeans_tree, packing, pii, quality, topk, toxicity, transport, trie
from pixelloom.llm.common import table

#: The key of the pseudonyms here; a user of the operator passes their own.
PII_KEY = b"public key of the registered queries"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = transport.store_streams(documents(spark, sf_dir))
    read = transport.read_streams(stored)
    size = F.length("payload")
    times = F.transform("units", lambda u: u["pts"])
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), F.col("packets")),
        F.concat(F.lit("units="), F.size("units")),
        F.concat(F.lit("random_access="), F.size(F.filter("units", lambda u: u["random_access"]))),
        F.concat(F.lit("pts="), F.array_min(times), F.lit(".."), F.array_max(times)),
        F.concat(F.lit("lost="), F.col("lost_bytes")),
        F.concat(F.lit("continuity_errors="), F.col("continuity_errors")),
        F.concat(F.lit("table_errors="), F.col("table_errors")),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_bpe(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN).drop("text")
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids")
    return bpe.decode_bpe(digests, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return chat.read_conversations(chat.format_turns(turns.unionByName(added)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(documents(spark, sf_dir), PII_KEY)
    return made.select("doc_id", "text", F.size("pii").alias("n_pii"), F.array_join(F.transform("pii", lambda p: F.concat_ws(":", p["kind"], p["start"], p["length"])), " ").alias("spans"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op9_quality_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie.prefix_trie(trie.sequences(trie.rebuilt(turns)))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(clusters.whole_vectors(table(spark, sf_dir, "embeddings")))


def op13_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kmeans_tree.usable(table(spark, sf_dir, "embeddings"))
    return kmeans_tree.neighbours(vectors.where(F.col("vec_id") % 20 == 0), vectors)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_transport_streams": op1_transport_streams,
    "op2_order_minhash": op2_order_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii_pseudonyms": op7_pii_pseudonyms,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_quality_field": op9_quality_field,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_kmeans_tree": op13_kmeans_tree,
}


def kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds of op12 one after the other."""
    steps = [
        """WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS INTEGER) AS cluster, q AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), q) <= {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, q, unnest(arg_min(p, (p.distance, p.cluster))) FROM (
    SELECT vec_id, q, {{'cluster': cluster, 'distance': CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)}} AS p FROM v CROSS JOIN c{r}
  ) GROUP BY vec_id, q
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(mean ORDER BY dim) AS c FROM (
      SELECT cluster, dim, CAST(floor(sum(q[dim]) / count(*)) AS BIGINT) AS mean FROM a{r} CROSS JOIN (SELECT unnest(range(1, 65)) AS dim) GROUP BY cluster, dim
    ) GROUP BY cluster
  ) m ON m.cluster = c{r}.cluster
)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, a{rounds}.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a{rounds}.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS nth,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), i AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
      list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT i.conv_id, t.nth, mark, size FROM i JOIN t ON t.conv_id = i.base AND t.nth <= h
  UNION ALL SELECT i.conv_id, t.nth + 9, mark, size FROM i JOIN t ON t.conv_id = i.conv_id AND t.nth > h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(mark, '') OVER w AS name, size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY nth)
), q AS (
  SELECT conv_id, depth, name, size, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM (SELECT * FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM i)
), n AS (
  SELECT name, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM q GROUP BY name
), k AS (
  SELECT up.name, up.conv_id, count(*) AS n_children FROM n JOIN n up ON n.depth = up.depth + 1 AND left(n.name, 64 * CAST(up.depth AS INTEGER)) = up.name GROUP BY ALL
), s AS (
  SELECT a.name, count(*) FILTER (k.name IS NULL) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM n a JOIN n b ON b.depth >= a.depth AND starts_with(b.name, a.name) LEFT JOIN k ON k.name = b.name GROUP BY a.name
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.name = n.name LEFT JOIN k ON k.name = n.name LEFT JOIN n up ON up.depth = n.depth - 1 AND up.name = left(n.name, 64 * CAST(n.depth - 1 AS INTEGER))
""",
    "op12_centroid_clusters": kmeans_sql(),
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op5_chat_format": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (
  SELECT *, '<s>[INST] ' || regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '(<|\\[)(\\\\*)(/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g')
    || chr(10) || regexp_replace(text, '(<|\\[)(\\\\*)(/?s>|/?INST\\])', '\\1\\\\\\2\\3', 'g') || ' [/INST]</s>' || chr(10) AS formatted
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, formatted)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
}
