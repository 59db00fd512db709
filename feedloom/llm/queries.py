"""The registered queries of the training-data operators: thin forms with fixed result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import (
    decontamination, exact, hard_negatives, language, lines, mixing, pii, quality, resampling, secret_scan, sharding, simhash,
    suffixes,
)
from feedloom.llm.common import read_table, text_or_empty


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(read_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(read_table(spark, sf_dir, "documents"))
    return language.identify(read_table(spark, sf_dir, "pages"), model).drop("url")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.drop_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in pii.KINDS]
    counts = [(F.size(kinds) - c).cast("long").alias(f"n_{k}") for c, k in zip(counts, pii.KINDS, strict=True)]
    joined = lambda column: F.array_join(F.transform(
        column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"),
                        joined("all_spans").alias("spans"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    pairs = decontamination.contaminated(docs, items, F.col("doc_id"), F.col("item_id"), mixed=True)
    return pairs.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "coverage", "n_slots", "consistent")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"),
                               anchor=F.col("id") % 100 == 0)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return resampling.scored(docs, target, keep=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}")  # noqa: B023
              for kind in secret_scan.KINDS]
    joined = lambda column: F.array_join(F.transform(
        column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"),
                        joined("all_spans").alias("spans"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_suffixes": op4_suffixes,
    "op5_exact": op5_exact,
    "op6_language": op6_language,
    "op7_lines": op7_lines,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_resampling": op12_resampling,
    "op13_secrets": op13_secrets,
}

ORACLES = {
    "op5_exact": """
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op7_lines": """
        WITH l AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (
          SELECT doc_id, line, pos, translate(
                   regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        due AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT k.doc_id, count(*) AS n_lines, count(due.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (due.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN due USING (key) GROUP BY k.doc_id""",
    "op11_hard_negatives": """
        WITH r AS (
          SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)),
        a AS (SELECT * FROM r WHERE id % 100 = 0),
        s AS (
          SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
          FROM a JOIN r ON a.id <> r.id),
        p AS (
          SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (
          SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
                 row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
          FROM p JOIN s USING (anchor_id)
          WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_resampling": """
        WITH bytes AS (
          SELECT list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c, i
          FROM range(256) t(i)),
        crc AS (SELECT list(c ORDER BY i) AS tab FROM bytes),
        d AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
          FROM documents),
        b AS (
          SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
          FROM benchmark),
        n AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL),
        w AS (SELECT DISTINCT word FROM (SELECT word FROM n UNION ALL SELECT word FROM b)),
        k AS (
          SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(word))),
                   lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INT + 1, 2))::BIGINT),
                   lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
          FROM w, crc),
        s AS (SELECT bucket, sum(n) AS n FROM n JOIN k USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM b JOIN k USING (word) GROUP BY bucket),
        totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
        gain AS (
          SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000)))) AS gain
          FROM s LEFT JOIN t USING (bucket), totals),
        weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM n JOIN k USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (
          SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                   / 4294967296::DOUBLE)))::BIGINT AS score
          FROM d LEFT JOIN weights USING (doc_id)),
        ranked AS (
          SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS due
          FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= due * 10 // 100 THEN place END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)""",
}
