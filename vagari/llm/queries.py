"""Registered queries of this subpackage with production parameters, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_BYTES, SHARD_OVERHEAD = 2 << 20, 16
MIX_WEIGHTS, MIX_MOST = (5, 2, 1), 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The byte-level vocabulary's file, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def url_rules() -> list:
    from .url_filter import host_rule, word_rule

    listed = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    return [host_rule(*r) for r in listed] + [word_rule("spam", "farm"), word_rule("cheap", "pills")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of lines and the numbers (from 0) of those that go."""
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules()).select("page_id", "host", "path", "rule", "verdict")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import TopKParams, top_k

    return top_k(table(spark, sf_dir, "embeddings"), TopKParams(k=10, scale=1024, every=100))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import MinHashParams, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), MinHashParams(words=5, num=85, den=100))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_digest

    return token_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), end_id=0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import PackParams, pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), PackParams(tokenizer_file()))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import MixParams, mix

    _, documents = mix(table(spark, sf_dir, "documents"), MixParams(weights=MIX_WEIGHTS, most=MIX_MOST))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import EmbeddingParams, near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), EmbeddingParams(threshold=0.95))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict

    return predict(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES, overhead=SHARD_OVERHEAD)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_digest

    return fill_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import main_text

    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_top_k, op4_minhash_dedup, op5_token_files, op6_packing, op7_mixing, op8_embedding_dedup, op9_language_id, op10_sharding, op11_fill_in_middle, op12_alignment, op13_main_text)}

_OP2 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (SELECT page_id, host, path, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN verdict WHEN regexp_matches(host, '(^|[.-])(spam[.-]farm|cheap[.-]pills)($|[.-])') THEN 'block' ELSE 'allow' END AS verdict
FROM j WHERE k = 1
"""

_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP7 = r"""
WITH base AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                     md5(CAST(doc_id AS VARCHAR) || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM base GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s1),
s3 AS (SELECT *, 3 * total AS cap, row_number() OVER (ORDER BY 3 * total / CAST(w AS DOUBLE), sid) AS k FROM s2),
s4 AS (SELECT *, ((SELECT sum(total) FROM s3) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
                 CAST((SELECT sum(w) FROM s3) - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM s3),
cut AS (SELECT min(k) AS k FROM s4 WHERE cap / CAST(w AS DOUBLE) > level),
s5 AS (SELECT s4.*, CASE WHEN s4.k < (SELECT k FROM cut) OR (SELECT k FROM cut) IS NULL THEN CAST(cap AS DOUBLE) ELSE w * (SELECT level FROM s4 x WHERE x.k = (SELECT k FROM cut)) END AS target FROM s4),
d AS (SELECT base.doc_id, base.size, s5.total, s5.target, CAST(floor(s5.target) AS BIGINT) AS words,
             sum(base.size) OVER (PARTITION BY s5.sid ORDER BY base.h, base.doc_id ROWS UNBOUNDED PRECEDING) - base.size AS pos
      FROM base JOIN s5 ON base.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, total AS source_size, target,
       CAST(CASE WHEN total = 0 THEN 0 ELSE (words // total) * size + greatest(0, least(pos + size, words % total) - pos) END AS BIGINT) AS taken
FROM d
"""

_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT r.id AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.c) AS component_id, r.id = min(r.c) AS kept
FROM r LEFT JOIN n USING (id) GROUP BY r.id
"""

_OP10 = f"""
WITH base AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + {SHARD_OVERHEAD} AS BIGINT) AS n_bytes,
                     CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents),
cells AS (SELECT d, h >> (32 - d) AS p, sum(n_bytes) AS b, count(*) AS n FROM base, range(0, 33) t(d) GROUP BY ALL),
fits AS (SELECT * FROM cells WHERE b <= {SHARD_BYTES} OR n = 1),
low AS (SELECT base.doc_id, base.n_bytes, base.h, min(fits.d) AS d FROM base JOIN fits ON base.h >> (32 - fits.d) = fits.p GROUP BY ALL)
SELECT doc_id, n_bytes, CAST(low.d AS INTEGER) AS depth, 's' || substr(lpad(bin(h), 32, '0'), 1, CAST(low.d AS INTEGER)) AS shard_id,
       CAST(fits.b AS BIGINT) AS shard_bytes, CAST(fits.n AS BIGINT) AS shard_rows
FROM low JOIN fits ON low.d = fits.d AND low.h >> (32 - low.d) = fits.p
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
e AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                                   WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
             array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
             array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""

ORACLES = {"op2_url_filter": _OP2, "op3_top_k": _OP3, "op7_mixing": _OP7, "op8_embedding_dedup": _OP8, "op10_sharding": _OP10, "op11_fill_in_middle": _OP11}
