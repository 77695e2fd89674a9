"""The queries ``opN_<name>``: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curve_packing, exact_dedup, filter_audit, html_extract, importance, license_scan, mixing, packing, quality, secret_scan, simhash, substring_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.simhash_groups(_read(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(_read(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document stands in its source's directory, a hundred ids to each below it."""
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    found = license_scan.license_scan(_read(spark, sf_dir, "documents"), path)
    return found.select(F.col("id").alias("doc_id"), "path", "license", F.round("cosine", 6).alias("cosine"), "basis", "origin")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return q.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)],
        F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.importance(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack_along_curve(_read(spark, sf_dir, "documents"), tokenizer_path()).drop("row").withColumnsRenamed({"id": "doc_id", "key": "curve_key"})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash": op3_simhash,
    "op4_source_mixing": op4_source_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_html_extract": op10_html_extract,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_curve_packing": op12_curve_packing,
    "op13_filter_audit": op13_filter_audit,
}

#: The others read tokens, XXH64, a trained model, binomial bounds or markup; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    # The clamped sources are the first by cap over weight; the level is that before the first one which it doesn't reach.
    "op4_source_mixing": r"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('20240917:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
        totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
        weighed AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
        levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth
            FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        final AS (SELECT arg_min(level, nth) AS level FROM levels WHERE weight * level < cap),
        targets AS (SELECT source, source_size, CASE WHEN f.level IS NULL OR weight * f.level >= cap THEN CAST(cap AS DOUBLE) ELSE weight * f.level END AS target FROM weighed, final f),
        parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
        placed AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(digest, 1, 8) AS BIGINT) % 4096, digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
        SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(0, greatest(CAST(floor(target + 0.5) AS BIGINT) - whole * source_size, 0) - before)) AS BIGINT) AS taken
        FROM placed JOIN parts ON placed.source IS NOT DISTINCT FROM parts.source""",
    # CRC-32 a byte at a time, by the table that eight steps of the polynomial give.
    "op11_importance_resampling": r"""WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
        texts AS (SELECT 0 AS aim, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
        split AS (SELECT aim, doc_id, row_number() OVER () AS nr, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
        features AS (SELECT aim, nr, unnest(words) AS word FROM split),
        counts AS (SELECT word, count(*) FILTER (aim = 0) AS s, count(*) FILTER (aim = 1) AS t FROM features GROUP BY 1),
        codes AS (SELECT *, list_transform(range(1, 2 * octet_length(encode(word)), 2), lambda i: CAST('0x' || substr(hex(encode(word)), i, 2) AS BIGINT)) AS codes FROM counts),
        hashed AS (SELECT word, s, t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM codes, tab),
        sums AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY 1),
        gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM sums),
        weights AS (SELECT nr, CAST(sum(gain) AS BIGINT) AS weight FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE aim = 0 GROUP BY 1),
        scored AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM split LEFT JOIN weights USING (nr) WHERE aim = 0),
        fit AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM fit UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20""",
    # Failures as bits: a state is what the bits before a step leave.
    "op13_filter_audit": r"""WITH words AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        marked AS (SELECT d.doc_id, part, coalesce(q, false) AS good, coalesce(t, false) AS toxic, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS C,
            regexp_matches(text, '[#$%&*|]') AS D, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS E
            FROM words d LEFT JOIN (SELECT doc_id, max(quality) = 1 AS q, max(toxic) = 1 AS t FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id),
        masks AS (SELECT part, good, toxic, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS mask, count(*) AS n FROM marked GROUP BY ALL),
        letters AS (SELECT i, chr(CAST(65 + i AS INT)) AS f FROM range(5) t(i)),
        perms AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (SELECT filter_order, CAST(s AS INT) AS step, 1 << (ascii(filter_order[s]) - 65) AS bit, coalesce((SELECT sum(1 << i) FROM letters WHERE instr(filter_order[1:s - 1], f) > 0), 0)::INT AS before FROM perms, range(1, 6) t(s)),
        counted AS (SELECT part, filter_order, step, bit, CAST(sum(n) FILTER (mask & (before | bit) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS removed, CAST(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS BIGINT) AS redundant,
            CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails, CAST(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND good) AS BIGINT) AS good_lost, CAST(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND toxic) AS BIGINT) AS toxic_lost FROM masks, steps GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
            CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted""",
}
