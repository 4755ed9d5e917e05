"""One query per operator over its whole table, and the SQL that states the same rows where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateframe.llm import decontamination, interpolation, language, merkle, minhash, packing, pii, pq_search, sharding, token_counts, toxicity, va_search, whitening
from rateframe.llm.encoding import vocabulary_path
from rateframe.llm.textops import remainder

Query = Callable[[SparkSession, str], DataFrame]
MAX_TOKENS = 2048
END_ID = 1
SHARD_BYTES = 1 << 20
SIMILAR_PERCENT = 75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"), F.md5("text").alias("text_md5"))
    return sharding.shards(docs, ["doc_id"], F.col("text_bytes"), SHARD_BYTES).select("doc_id", "bytes", "shard", "depth", "page")


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=SIMILAR_PERCENT)


def op3_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = interpolation.scores(table(spark, sf_dir, "documents"), train=remainder("doc_id", 7) != 2)
    held_out = (remainder("doc_id", 7) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_weakly_supervised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(F.transform(base, lambda s: s["kind"]), kind)) for kind in pii.KINDS]
    counts = [(F.size(base) - n).cast("long").alias(f"n_{kind}") for kind, n in zip(pii.KINDS, counts)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


def toxicity_model(docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """A model that learns from labelled documents among ``docs``, but none of the held-out fifth."""
    labels = table(docs.sparkSession, sf_dir, "labels")
    return toxicity.train(docs, labels, trainable=lambda doc_id: remainder(doc_id, 5) != 0)


def op6_subsequence_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity_model(docs, sf_dir))
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in sequences of production length, with a checksum in place of the ids."""
    pieces = packing.pack(docs, vocabulary_path(), END_ID, MAX_TOKENS)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "cut_before", "cut_after",
    )


def op7_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op8_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, trainable=remainder("doc_id", 4) != 2)
    found = language.languages(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, benchmark, threshold=SIMILAR_PERCENT / 100)


def op10_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ``kept_points``: code points of the longest prefix, in whole units, within the limit."""
    docs = table(spark, sf_dir, "documents")
    stored = token_counts.prefix_counts(docs, vocabulary_path())
    tokens = token_counts.total_tokens()
    return stored.select(
        "doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > MAX_TOKENS).alias("over_limit"),
        token_counts.longest_prefix(MAX_TOKENS).alias("kept_points"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    joined_lines = merkle.leaf_digest(*fields, F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(remainder("doc_id", 2) == 0, joined_lines)
    found = merkle.fold(merkle.manifest(docs, merkle.leaf_digest(*fields, F.col("text")), replacement=tampered))
    return found.withColumnRenamed("id", "doc_id")


def op12_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op13_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_search.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


QUERIES: dict[str, Query] = {
    "op1_extendible_sharding": op1_extendible_sharding,
    "op2_minhash_near_duplicates": op2_minhash_near_duplicates,
    "op3_vector_approximation": op3_vector_approximation,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_weakly_supervised_pii": op5_weakly_supervised_pii,
    "op6_subsequence_kernel_toxicity": op6_subsequence_kernel_toxicity,
    "op7_concatenate_and_cut": op7_concatenate_and_cut,
    "op8_hierarchical_language": op8_hierarchical_language,
    "op9_simhash_decontamination": op9_simhash_decontamination,
    "op10_prefix_token_counts": op10_prefix_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_qdwh_whitening": op12_qdwh_whitening,
    "op13_product_quantisation": op13_product_quantisation,
}
STATEMENTS: dict[str, str] = {
    "op1_extendible_sharding": f"""
WITH hashed AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
        CAST('0x' || substr(md5(coalesce('=' || CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS h
    FROM documents
), levels AS (
    SELECT doc_id, bytes, h, depth, h >> (60 - depth) AS prefix FROM hashed, (SELECT unnest(range(0, 61)) AS depth)
), sums AS (
    SELECT depth, prefix FROM levels GROUP BY depth, prefix HAVING sum(bytes) <= {SHARD_BYTES} OR min(h) = max(h)
), leaves AS (
    SELECT doc_id, bytes, h, min(levels.depth) AS depth FROM levels JOIN sums USING (depth, prefix) GROUP BY doc_id, bytes, h
)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), CAST(depth AS INTEGER), '0') END AS shard,
    CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page
FROM leaves
""",
    "op3_vector_approximation": """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id != c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_merkle_manifest": """
WITH RECURSIVE rows_ AS (
    SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS id_text FROM documents
), crcs AS (
    SELECT *, list_reduce(
        list_concat([4294967295], flatten(list_transform(string_split(id_text, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END
    ) & 1 = 1 AS even
    FROM rows_
), fields AS (
    SELECT doc_id, source,
        coalesce(strlen(id_text) || ':' || id_text, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
        text, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS changed
    FROM crcs
), leaves AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS other
    FROM fields
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
    FROM leaves
), nodes AS (
    SELECT source, 0 AS level, place, leaf AS hash, n FROM placed
    UNION ALL
    SELECT source, level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (n + 2) // 3
    FROM nodes WHERE n > 1 GROUP BY source, level, place // 3, n
), subroots AS (
    SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, level AS height, count(*) OVER () AS n
    FROM nodes WHERE n = 1
), top AS (
    SELECT 0 AS level, place, subroot AS hash, n FROM subroots
    UNION ALL
    SELECT level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), (n + 2) // 3
    FROM top WHERE n > 1 GROUP BY level, place // 3, n
), runs AS (
    SELECT 's' || coalesce('=' || source, '-') AS tree, level, place // 3 AS run, list(hash ORDER BY place) AS hashes
    FROM nodes WHERE n > 1 GROUP BY ALL
    UNION ALL
    SELECT 'top', level, place // 3, list(hash ORDER BY place) FROM top WHERE n > 1 GROUP BY ALL
), below AS (
    SELECT doc_id, leaf, source, 0 AS level, place, other AS hash, '' AS proof, n FROM placed
    UNION ALL
    SELECT doc_id, leaf, source, b.level + 1, place // 3,
        sha256(array_to_string(list_transform(hashes, lambda x, i: CASE WHEN i - 1 = place % 3 THEN hash ELSE x END), '')),
        proof || array_to_string(list_filter(hashes, lambda x, i: i - 1 != place % 3), ''), (n + 2) // 3
    FROM below b JOIN runs r ON r.tree = 's' || coalesce('=' || source, '-') AND r.level = b.level AND r.run = place // 3
    WHERE n > 1
), above AS (
    SELECT doc_id, leaf, subroot, 0 AS level, s.place, hash, proof, s.n
    FROM below b JOIN subroots s ON s.source IS NOT DISTINCT FROM b.source WHERE b.n = 1
    UNION ALL
    SELECT doc_id, leaf, subroot, a.level + 1, place // 3,
        sha256(array_to_string(list_transform(hashes, lambda x, i: CASE WHEN i - 1 = place % 3 THEN hash ELSE x END), '')),
        proof || array_to_string(list_filter(hashes, lambda x, i: i - 1 != place % 3), ''), (n + 2) // 3
    FROM above a JOIN runs r ON r.tree = 'top' AND r.level = a.level AND r.run = place // 3
    WHERE n > 1
)
SELECT doc_id, leaf, subroot, (SELECT hash FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, hash AS folded_root,
    hash = (SELECT hash FROM top WHERE n = 1) AS verified
FROM above WHERE n = 1
""",
}
