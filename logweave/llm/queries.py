"""The corpus operators bound to the test tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_tokenizers
from .common import new_table_path
from .fingerprints import edited_fingerprints
from .grammar_ids import read_ids, write_ids
from .html_text import main_text
from .licenses import find_licenses
from .media import read_media, write_media
from .minhash import near_duplicates
from .packing import pack_documents
from .piece_coding import encode_pieces
from .quality import fit_resampling, resample
from .toxicity import fit_toxicity, is_held_out, score_toxicity
from .vector_links import vector_links
from .walsh_clusters import cluster_vectors


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~is_held_out()))
    return score_toxicity(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars", "n_template")


def op3_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resample(docs, fit_resampling(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


def op4_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path)


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "media")
    write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_media(spark, path)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_walsh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_html_text,
        op3_resampling,
        op4_grammar_ids,
        op5_media_chunks,
        op6_licenses,
        op7_vector_links,
        op8_packing,
        op9_near_duplicates,
        op10_piece_coding,
        op11_alignment,
        op12_fingerprints,
        op13_walsh_clusters,
    )
}

_OP7_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 r(id, reached) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a)
 SELECT m.vec_id, coalesce(n, 0) AS n_links, coalesce(c, m.vec_id) AS component_id, coalesce(c, m.vec_id) = m.vec_id AS kept FROM embeddings m
 LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) k ON k.a = m.vec_id LEFT JOIN (SELECT id, min(reached) AS c FROM r GROUP BY 1) g ON g.id = m.vec_id"""

_OP9_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
 u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
 r(id, reached) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a)
 SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN (SELECT id, min(reached) AS c FROM r GROUP BY 1) g ON g.id = s.doc_id"""



def _op13_sql(clusters: int = 16, rounds: int = 3) -> str:
    nearest = lambda centroids: f"""SELECT vec_id, r, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT x.vec_id, x.r, x.v, c.k, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i])))::BIGINT AS d FROM x, {centroids} c) GROUP BY ALL"""
    parts = [
        """x AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM x ORDER BY sha256('1:' || vec_id) LIMIT {clusters})",
    ]
    for t in range(rounds):
        parts.append(f"a{t} AS ({nearest(f'c{t}')})")
        parts.append(
            f"""m{t} AS (SELECT k, list(q ORDER BY i) AS c FROM (SELECT k, i, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q FROM (SELECT k, unnest(v) AS e, unnest(range(1, 65)) AS i FROM a{t}) GROUP BY k, i) GROUP BY k)"""
        )
        parts.append(f"c{t + 1} AS (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{t} o LEFT JOIN m{t} n ON n.k = o.k)")
    parts.append(f"f AS ({nearest(f'c{rounds}')})")
    return (
        "WITH " + ", ".join(parts) + f""" SELECT vec_id, f.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c ON c.k = f.k"""
    )


#: DuckDB SQL where SQL expresses the operator; tests hold the others against brute force.
ORACLES: dict[str, str] = {"op7_vector_links": _OP7_SQL, "op9_near_duplicates": _OP9_SQL, "op13_walsh_clusters": _op13_sql()}
