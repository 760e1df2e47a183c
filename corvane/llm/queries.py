"""The operators as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, fingerprints, langid, lines, minhash, mixing, resampling, secrets, substrings, suffixes, topk, urls, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as bad where the label of its id has quality 0."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", F.round("score", 6).alias("score"), "rejected")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_fingerprints": op2_fingerprints,
    "op3_mix": op3_mix,
    "op4_minhash": op4_minhash,
    "op5_substrings": op5_substrings,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_urls": op8_urls,
    "op9_langid": op9_langid,
    "op10_suffixes": op10_suffixes,
    "op11_lines": op11_lines,
    "op12_whiten": op12_whiten,
    "op13_resample": op13_resample,
}

ORACLE_SQL = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), ranked AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank
            FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op5_substrings": r"""
        WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, row_number() OVER () AS rid FROM documents),
          p AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w),
          s AS (SELECT p.rid, p.i, array_to_string(w.ws[p.i:p.i + 34], ' ') AS g FROM p JOIN w USING (rid) WHERE p.i + 34 <= p.n),
          twice AS (SELECT rid, i FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
          marked AS (SELECT p.rid, p.i, max(CASE WHEN t.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.rid ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN twice t USING (rid, i)),
          kept AS (SELECT rid, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(CASE WHEN gone = 0 THEN w.ws[i] END, ' ' ORDER BY i), '') AS k FROM marked JOIN w USING (rid) GROUP BY rid)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)
    """,
    "op8_urls": r"""
        WITH u AS MATERIALIZED (SELECT row_number() OVER () AS id, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
          lab AS (SELECT doc_id AS page_id, count(*) AS n, sum(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
          h AS (SELECT host, string_split(host, '.') AS l, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM u LEFT JOIN lab USING (page_id) WHERE host <> '' GROUP BY host),
          hosts0 AS (SELECT host, n, bad, CASE WHEN array_to_string(l[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
                       CASE WHEN array_to_string(l[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk') THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h),
          domains0 AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts0 GROUP BY 1, 2),
          suffixes0 AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains0 GROUP BY 1),
          suffixes1 AS (SELECT *, ((SELECT sum(bad) FROM suffixes0) + 1)::DOUBLE / ((SELECT sum(n) FROM suffixes0) + 2) AS prior FROM suffixes0),
          suffixes2_fit AS (SELECT sum(round(n * (bad / n - prior) * (bad / n - prior), 9)::DECIMAL(30,9))::DOUBLE AS spread, sum(round(prior * (1 - prior), 9)::DECIMAL(30,9))::DOUBLE AS noise,
            sum(round(n * prior * (1 - prior), 9)::DECIMAL(30,9))::DOUBLE AS mass, count(*)::DOUBLE AS groups, sum(n)::DOUBLE AS total FROM suffixes1 WHERE n > 0),
          suffixes2_s AS (SELECT coalesce(CASE WHEN total > groups AND (spread - noise) / (total - groups) > 0 THEN greatest(1.0::DOUBLE, least(50.0::DOUBLE, (mass / total) / ((spread - noise) / (total - groups)) - 1)) END, 50.0::DOUBLE) AS strength FROM suffixes2_fit),
          suffixes2 AS (SELECT r.*, strength, (bad + prior * strength) / (n + strength) AS mean FROM suffixes1 r, suffixes2_s),
          domains1 AS (SELECT d.*, s.mean AS prior FROM domains0 d JOIN suffixes2 s USING (suffix)),
          domains2_fit AS (SELECT sum(round(n * (bad / n - prior) * (bad / n - prior), 9)::DECIMAL(30,9))::DOUBLE AS spread, sum(round(prior * (1 - prior), 9)::DECIMAL(30,9))::DOUBLE AS noise,
            sum(round(n * prior * (1 - prior), 9)::DECIMAL(30,9))::DOUBLE AS mass, count(*)::DOUBLE AS groups, sum(n)::DOUBLE AS total FROM domains1 WHERE n > 0),
          domains2_s AS (SELECT coalesce(CASE WHEN total > groups AND (spread - noise) / (total - groups) > 0 THEN greatest(1.0::DOUBLE, least(50.0::DOUBLE, (mass / total) / ((spread - noise) / (total - groups)) - 1)) END, 50.0::DOUBLE) AS strength FROM domains2_fit),
          domains2 AS (SELECT r.*, strength, (bad + prior * strength) / (n + strength) AS mean FROM domains1 r, domains2_s),
          hosts1 AS (SELECT h.*, d.mean AS prior FROM hosts0 h JOIN domains2 d USING (domain)),
          hosts2_fit AS (SELECT sum(round(n * (bad / n - prior) * (bad / n - prior), 9)::DECIMAL(30,9))::DOUBLE AS spread, sum(round(prior * (1 - prior), 9)::DECIMAL(30,9))::DOUBLE AS noise,
            sum(round(n * prior * (1 - prior), 9)::DECIMAL(30,9))::DOUBLE AS mass, count(*)::DOUBLE AS groups, sum(n)::DOUBLE AS total FROM hosts1 WHERE n > 0),
          hosts2_s AS (SELECT coalesce(CASE WHEN total > groups AND (spread - noise) / (total - groups) > 0 THEN greatest(1.0::DOUBLE, least(50.0::DOUBLE, (mass / total) / ((spread - noise) / (total - groups)) - 1)) END, 50.0::DOUBLE) AS strength FROM hosts2_fit),
          hosts2 AS (SELECT r.*, strength, (bad + prior * strength) / (n + strength) AS mean, 1.6449::DOUBLE AS z, 1.6449::DOUBLE * 1.6449::DOUBLE AS zz,
            ((SELECT sum(bad) FROM suffixes0) + 1)::DOUBLE / ((SELECT sum(n) FROM suffixes0) + 2) AS root FROM hosts1 r, hosts2_s),
          r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) r(rh, rp, rv)),
          judged AS (SELECT u.id, rh || rp AS rule, rv FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
                     QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY length(rh || rp) DESC) = 1)
        SELECT page_id, u.host, path, rule, coalesce(rv, CASE WHEN round((mean + zz / ((n + strength) * 2) - z * sqrt(mean * (1 - mean) / (n + strength) + zz / ((n + strength) * (n + strength) * 4))) / (zz / (n + strength) + 1), 9) > round(root, 9) THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN judged USING (id) LEFT JOIN hosts2 USING (host)
    """,
    "op10_suffixes": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER (ORDER BY doc_id NULLS FIRST, CASE WHEN doc_id IS NULL THEN substr(md5(coalesce(text, '')), 1, 15) END, encode(coalesce(text, ''))) AS rid FROM documents),
          b AS (SELECT rid, h, unnest(range(0, length(h) // 2, 500)) AS base, length(h) // 2 AS n FROM d),
          c AS MATERIALIZED (SELECT rid, base, n, substr(h, 2 * base + 1, 1200) AS piece FROM b),
          p AS (SELECT rid, base, n, piece, unnest(range(0, least(500, n - base))) AS o FROM c),
          s AS (SELECT rid, base + o AS i, md5_number(substr(piece, 2 * o + 1, 200)) AS m FROM p WHERE base + o + 100 <= n),
          again AS (SELECT rid, i FROM s QUALIFY row_number() OVER (PARTITION BY m ORDER BY rid, i) > 1),
          marked AS (SELECT p.rid, base + o AS i, substr(piece, 2 * o + 1, 2) AS byte,
                       max(CASE WHEN a.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.rid ORDER BY base + o ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
                     FROM p LEFT JOIN again a ON a.rid = p.rid AND a.i = base + o),
          runs AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS starts FROM marked),
          kept AS (SELECT rid, sum(gone)::BIGINT AS n_removed, sum(starts)::BIGINT AS n_spans, coalesce(string_agg(CASE WHEN gone = 0 THEN byte END, '' ORDER BY i), '') AS k FROM runs GROUP BY rid)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
        FROM d LEFT JOIN kept USING (rid)
    """,
    "op11_lines": r"""
        WITH l AS (SELECT rid, doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
                   FROM (SELECT rid, doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i
                         FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
          s AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k
                HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
          m AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS gone FROM l LEFT JOIN s ON s.k = l.k)
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN NOT gone THEN l END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM m GROUP BY rid, doc_id
    """,
}
