"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .class_lm import score_texts
from .common import held_out, stored, table
from .decontaminate import leaks
from .exact_dedup import exact_duplicates
from .langid import fit as fit_languages
from .langid import identify
from .main_text import extract
from .mixing import mix
from .near_dedup import near_duplicates
from .pii import counted, find_pii, listed, scored
from .quality import fit as fit_quality
from .quality import score as score_quality
from .token_counts import build, edit_kept, read_ranks


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit_quality(docs.where(~out), labels.where(~out))
    return score_quality(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and after two edits of each, made on the kept trees: a cut at a third of it and a note put in at two thirds."""
    ranks = read_ranks()
    kept = stored(build(table(spark, sf_dir, "documents"), ranks, keep_text=True), "token-trees")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    third = F.floor(n / 3)
    edits = F.array(
        F.struct(third.alias("start"), F.least(F.lit(16), n - third).cast("long").alias("length"), F.lit("").alias("inserted")),
        F.struct(F.floor(2 * n / 3).alias("start"), F.lit(0).cast("long").alias("length"), F.lit(" [edited]").alias("inserted")),
    )
    return edit_kept(kept, edits, ranks).drop("leaf_chars", "leaf_tokens")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit_languages(docs.where(~out))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "doc_word", "item_words", "matched", "best", "needed")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 7, 2)
    return score_texts(table(spark, sf_dir, "documents"), ~out).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[counted(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        *[counted(spans, k).alias(f"n_{k}") for k in ("iban", "ssn", "access_key", "secret")],
        scored(spans).alias("scores"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_main_text": op4_main_text,
    "op5_language": op5_language,
    "op6_decontaminate": op6_decontaminate,
    "op7_class_lm": op7_class_lm,
    "op8_pii": op8_pii,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": r"""
        WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS place FROM documents),
        totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
        weighed AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM totals),
        ratios AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM weighed),
        levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 150 / 100.0 - CAST(sum(cap) OVER b - cap AS DOUBLE)) / CAST(sum(weight) OVER () - sum(weight) OVER b + weight AS DOUBLE) AS level
                   FROM ratios WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
        first_open AS (SELECT level AS common FROM levels WHERE ratio > level ORDER BY ratio, source LIMIT 1),
        targets AS (SELECT source, source_size, CASE WHEN ratio > level THEN weight * (SELECT common FROM first_open) ELSE CAST(cap AS DOUBLE) END AS target FROM levels),
        block AS (SELECT greatest(1, least(4096, min(source_size) FILTER (source_size > 0) // 1024)) AS b FROM targets),
        seats AS (SELECT source, target, unnest(range(1, CAST(ceil(target / (SELECT b FROM block)) AS BIGINT) + 60)) AS seat FROM targets),
        won AS (SELECT source, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, source ASC NULLS LAST) AS r FROM seats WHERE target > 0),
        quotas AS (SELECT source, count(*) AS quota FROM won WHERE r <= (SELECT round(sum(target) / (SELECT b FROM block)) FROM targets) GROUP BY source),
        rows_of AS (SELECT source, count(*) FILTER (size > 0) AS source_rows FROM sizes GROUP BY source),
        shards AS (SELECT t.*, coalesce(quota, 0) AS quota, greatest(1, CAST(ceil(source_size / 262144) AS BIGINT), CAST(ceil(source_rows / 65536) AS BIGINT)) AS n_shards
                   FROM targets t LEFT JOIN quotas q ON t.source IS NOT DISTINCT FROM q.source JOIN rows_of n ON t.source IS NOT DISTINCT FROM n.source),
        placed AS (SELECT s.doc_id, s.source, s.size, h.source_size, h.target, h.quota, place, CAST('0x' || substr(place, 1, 7) AS BIGINT) % n_shards AS shard,
                          CAST('0x' || substr(place, 1, 7) AS BIGINT) % n_shards % CAST(ceil(sqrt(n_shards)) AS BIGINT) AS part
                   FROM sizes s JOIN shards h ON s.source IS NOT DISTINCT FROM h.source),
        part_sizes AS (SELECT source, part, any_value(quota) AS quota, CAST(sum(size) AS BIGINT) AS part_size FROM placed WHERE size > 0 GROUP BY source, part),
        part_seats AS (SELECT source, part, quota, part_size, unnest(range(1, 2 * CAST(ceil(part_size / (SELECT b FROM block)) AS BIGINT) + 60)) AS seat FROM part_sizes),
        part_won AS (SELECT source, part, quota, row_number() OVER (PARTITION BY source ORDER BY part_size / (2 * seat - 1) DESC, part) AS r FROM part_seats),
        part_quotas AS (SELECT source, part, count(*) AS part_quota FROM part_won WHERE r <= quota GROUP BY source, part),
        shard_sizes AS (SELECT p.source, p.part, shard, coalesce(any_value(part_quota), 0) AS quota, CAST(sum(size) AS BIGINT) AS shard_size
                        FROM placed p LEFT JOIN part_quotas w ON p.source IS NOT DISTINCT FROM w.source AND p.part = w.part WHERE size > 0 GROUP BY p.source, p.part, shard),
        shard_seats AS (SELECT source, part, shard, quota, shard_size, unnest(range(1, 2 * CAST(ceil(shard_size / (SELECT b FROM block)) AS BIGINT) + 60)) AS seat FROM shard_sizes),
        shard_won AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source, part ORDER BY shard_size / (2 * seat - 1) DESC, shard) AS r FROM shard_seats),
        shard_quotas AS (SELECT source, shard, count(*) AS won FROM shard_won WHERE r <= quota GROUP BY source, shard),
        runs AS (SELECT z.source, z.shard, z.shard_size, least(coalesce(won, 0) * b, 2 * z.shard_size) AS words,
                        b * (CAST('0x' || substr(md5('mix-1:start:' || coalesce(z.source, 'null') || ':' || z.shard), 1, 7) AS BIGINT) % greatest(1, CAST(ceil(z.shard_size / b) AS BIGINT))) AS start
                 FROM shard_sizes z CROSS JOIN block LEFT JOIN shard_quotas w ON z.source IS NOT DISTINCT FROM w.source AND z.shard = w.shard),
        bounds AS (SELECT p.*, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS high FROM placed p WHERE size > 0),
        cut AS (SELECT x.doc_id, x.size, x.source_size, x.target, x.high, x.high - x.size AS low, r.shard_size, r.start, r.words,
                       CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS passes, start + CASE WHEN shard_size > 0 THEN words % shard_size ELSE 0 END AS stop
                FROM bounds x JOIN runs r ON x.source IS NOT DISTINCT FROM r.source AND x.shard = r.shard)
        SELECT doc_id, size, source_size, target,
               CAST(passes * size + greatest(0, least(high, stop, shard_size) - greatest(low, start)) + greatest(0, least(high, stop - shard_size) - low) AS BIGINT) AS taken
        FROM cut
        UNION ALL SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) FROM placed WHERE size = 0
    """,
    "op8_pii": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        m AS (
            SELECT r, 0 AS k, 'email' AS kind, 90 AS own, 10 AS bonus, 'mail|contact|write|kontakt|correo|courriel' AS context, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS vs, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gs FROM t
            UNION ALL SELECT r, 1 AS k, 'ip' AS kind, 70 AS own, 20 AS bonus, '\bip\b|address|host|server|login|adresse|direcci' AS context, regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS vs, string_split_regex(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS gs FROM t
            UNION ALL SELECT r, 2 AS k, 'card' AS kind, 80 AS own, 20 AS bonus, 'card|visa|credit|payment|karte|carte|tarjeta' AS context, regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+') AS vs, string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') AS gs FROM t
            UNION ALL SELECT r, 3 AS k, 'phone' AS kind, 70 AS own, 20 AS bonus, 'phone|\btel|call|mobile|fax|anruf|appel|llama' AS context, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') AS vs, string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') AS gs FROM t
            UNION ALL SELECT r, 4 AS k, 'iban' AS kind, 80 AS own, 10 AS bonus, 'iban|account|bank|konto|compte|cuenta' AS context, regexp_extract_all(text, '[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)') AS vs, string_split_regex(text, '[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)') AS gs FROM t
            UNION ALL SELECT r, 5 AS k, 'ssn' AS kind, 40 AS own, 30 AS bonus, 'ssn|social sec|sozialvers|seguridad social|curit. sociale' AS context, regexp_extract_all(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AS vs, string_split_regex(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AS gs FROM t
            UNION ALL SELECT r, 6 AS k, 'access_key' AS kind, 80 AS own, 10 AS bonus, 'key|secret|aws' AS context, regexp_extract_all(text, 'AKIA[0-9A-Z]{16}') AS vs, string_split_regex(text, 'AKIA[0-9A-Z]{16}') AS gs FROM t
            UNION ALL SELECT r, 7 AS k, 'secret' AS kind, 30 AS own, 40 AS bonus, 'passw|contrase|mot de passe|secret|token|api.?key|credential' AS context, regexp_extract_all(text, '[0-9A-Za-z+/_-]{16,}') AS vs, string_split_regex(text, '[0-9A-Za-z+/_-]{16,}') AS gs FROM t),
        p AS (SELECT r, k, kind, own, bonus, context, unnest(vs) AS v, unnest(range(1, len(vs) + 1)) AS i, gs, list_transform(gs, lambda g: len(g)) AS gaps, list_transform(vs, lambda x: len(x)) AS ls FROM m WHERE len(vs) > 0),
        s AS (SELECT r, k, kind, own, bonus, context, v, gs[i] AS before, coalesce(gs[i + 1], '') AS after, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(ls[1:i - 1]), 0) AS BIGINT) AS a, replace(v, ' ', '') AS c FROM p),
        sound AS (SELECT r, k, kind, a, a + len(v) AS b, own + CASE WHEN regexp_matches(lower(right(before, 40)), context) THEN bonus ELSE 0 END AS score FROM s WHERE CASE kind
            WHEN 'email' THEN true
            WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(right(p, 4) AS INT), 999) > 255)) = 0
            WHEN 'card' THEN len(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len(regexp_replace(v, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS INT) WHEN CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS INT) > 4 THEN 2 * CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS INT) - 9 ELSE 2 * CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[i] AS INT) END)) % 10 = 0
            WHEN 'phone' THEN len(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 10 AND 15
            WHEN 'iban' THEN len(c) BETWEEN 15 AND 34 AND list_reduce(list_transform(range(0, len(c) + 1), lambda i: CASE WHEN i = 0 THEN CAST(0 AS BIGINT) WHEN i <= len(c) - 4 THEN CASE WHEN c[i + 4] >= 'A' THEN ascii(c[i + 4]) - 55 ELSE ascii(c[i + 4]) - 48 END WHEN c[i - len(c) + 4] >= 'A' THEN ascii(c[i - len(c) + 4]) - 55 ELSE ascii(c[i - len(c) + 4]) - 48 END), lambda x, d: (CASE WHEN d > 9 THEN x * 100 + d ELSE x * 10 + d END) % 97) = 1
            WHEN 'secret' THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
            ELSE true END AND (kind NOT IN ('iban', 'ssn', 'access_key') OR NOT (regexp_matches(before, '[0-9A-Za-z]$') OR regexp_matches(after, '^[0-9A-Za-z]')))),
        ok AS (SELECT * FROM sound WHERE k < 4 OR score >= 50),
        g AS (SELECT r, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 4) AS l, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans, string_agg(score, ',' ORDER BY a, k) AS scores, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'iban') AS n_iban, count(*) FILTER (kind = 'ssn') AS n_ssn, count(*) FILTER (kind = 'access_key') AS n_access_key, count(*) FILTER (kind = 'secret') AS n_secret FROM ok GROUP BY r)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_iban, 0) AS n_iban, coalesce(n_ssn, 0) AS n_ssn, coalesce(n_access_key, 0) AS n_access_key, coalesce(n_secret, 0) AS n_secret, sha256(coalesce(l, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
        FROM t LEFT JOIN g USING (r)
    """,
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
        r AS (SELECT doc_id, norm,
                     first_value(doc_id) OVER w AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size,
                     row_number() OVER w = 1 AS kept
              FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id ASC NULLS LAST))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(norm) AS text_sha256 FROM r
    """,
}
