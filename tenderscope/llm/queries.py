"""One registered query per corpus operator, with production parameters over the
whole table it is meant for, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .cascade import quality_cascade
from .common import scratch, table, written
from .maintext import extract_main_text
from .merkle import fold as fold_path
from .merkle import leaf_hash, merkle_manifest, path_hash
from .mixing import curriculum, mixture_plan
from .nsbounds import cluster_vectors, with_inertia
from .packing import pack
from .quality import fit as fit_quality
from .quality import labelled_sample, score
from .secrets import find_secrets
from .sharding import shard_by_bytes
from .sigtree import near_duplicates
from .transducer import count_tokens
from .vamana import build_index, search_index


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, 64 open windows per partition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, vocabulary("word_bpe_49k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def fold(id_col: str = "doc_id"):
    """crc32 of the id's text modulo 3; fold 1 is never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def op2_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from boosted trees fitted on the labels outside fold 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold() != 1)
    model = fit_quality(labelled_sample(docs, labels, "quality"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE token counts of every text by finite-state transduction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("byte_bpe_50k.json"))


def op4_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mixture takes, with the training times of its copies: the first copies (and the
    documents that are not taken) of the range-sorted curriculum."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    copies = curriculum(mixture_plan(docs), rest=True).where("copy IS NULL OR copy = 0")
    return copies.select(
        "doc_id", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
        "position", F.get("positions", F.lit(1)).alias("second_position")) \
        .withColumn("position", F.round("position", 6)).withColumn("second_position", F.round("second_position", 6))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         CASE turn WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0 ELSE 0.5 END AS u0,
         CASE turn WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 ELSE 1.5 END AS u1 FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (
               ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT *, least(2.0::DOUBLE * source_size, max(lev) OVER () * w) AS target FROM l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u0, t.u1,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS q
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - q::BIGINT)) AS t0,
         greatest(0, least(size, floor(target)::BIGINT - q::BIGINT - source_size)) AS t1 FROM c)
SELECT doc_id, size, source_size, target, (t0 + t1)::BIGINT AS taken,
       round(CASE WHEN t0 = 0 THEN NULL WHEN u0 = u1 THEN q / target
                  ELSE (sqrt(u0 * u0 + 2 * (u1 - u0) * (q / target)) - u0) / (u1 - u0) END, 6) AS position,
       round(CASE WHEN t1 = 0 THEN NULL WHEN u0 = u1 THEN (q + source_size) / target
                  ELSE (sqrt(u0 * u0 + 2 * (u1 - u0) * ((q + source_size) / target)) - u0) / (u1 - u0) END, 6) AS second_position
FROM k
"""


def op5_vamana_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector, by beam search of every shard's pruned graph."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = search_index(build_index(vectors, k=5), vectors.where("vec_id % 50 = 0"), k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate secrets of all documents with the forest's score and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return find_secrets(docs).select("doc_id", "start", "length", F.crc32(F.col("value").cast("binary")).alias("value_crc32"),
                                     "score", "is_secret")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of the short-circuit rule cascade for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                        "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
i AS (SELECT row_number() OVER () AS r, * FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(ws[1:-3]) AS a, unnest(ws[2:-2]) AS b, unnest(ws[3:]) AS c
      FROM i WHERE len(ws) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM p),
e AS (SELECT r, count(DISTINCT x)::BIGINT AS rep
      FROM (SELECT r, unnest([i, i + 1, i + 2]) AS x FROM g WHERE n > 1) GROUP BY r),
s AS (
  SELECT doc_id, text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words
  FROM i LEFT JOIN e USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words
            OR 100 * n_dup_lines > 30 * (length(text) - length(replace(text, chr(10), '')) + 1)
            OR 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))
                 > length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))
            OR 5 * (length(text) - length(replace(text, '!', ''))) > n_words
            OR 2 * (length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) < word_chars) AS kept
FROM b
"""


def op8_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.9 of their 3-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op9_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as Simple-8b blocks in ascending doc_id order, then read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scratch(spark, "simple8b")
    simple8b.write_tokens(docs, out, vocabulary("word_bpe_49k.json"))
    return simple8b.read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen contiguous shards of near-equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_by_bytes(docs, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that it leads to after tampering with every seventh."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    def leaf(n_chars):
        return leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(F.col("n_chars") + 1))
    manifest = merkle_manifest(docs, F.col("lang"), F.col("doc_id"), leaf(F.col("n_chars")),
                               {"doc_id": F.col("doc_id"), "tampered": tampered}, fanout=2)
    return (manifest.withColumn("folded_root", fold_path(F.coalesce("tampered", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", path_hash(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS mid,
         coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS mid2,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
l AS (SELECT doc_id, lang, sha256(head || mid || tail) AS leaf, sha256(head || mid2 || tail) AS other FROM d),
x AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
low AS (
  SELECT g, 0 AS lv, i, leaf AS h, n FROM x
  UNION ALL
  SELECT g, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY g, lv, i // 2, n),
sub AS (SELECT g, h, lv AS depth, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT 0 AS lv, g AS i, h, n FROM sub
  UNION ALL
  SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lv, i // 2, n),
steps AS (
  SELECT x.g, x.i, v.lv, (x.i >> v.lv) & 1 AS odd, coalesce(s.h, '') AS h
  FROM x JOIN sub ON x.g = sub.g CROSS JOIN LATERAL (SELECT unnest(range(0, sub.depth)) AS lv) v
  LEFT JOIN low s ON s.g = x.g AND s.lv = v.lv AND s.i = xor(x.i >> v.lv, 1)
  UNION ALL
  SELECT x.g, x.i, sub.depth + v.lv, (x.g >> v.lv) & 1, coalesce(s.h, '')
  FROM x JOIN sub ON x.g = sub.g CROSS JOIN LATERAL (SELECT unnest(range(0, (SELECT max(lv) FROM top))) AS lv) v
  LEFT JOIN top s ON s.lv = v.lv AND s.i = xor(x.g >> v.lv, 1)),
proof AS (SELECT g, i, sha256(string_agg(h, '' ORDER BY lv)) AS proof FROM steps GROUP BY g, i),
folded AS (
  SELECT g, i, 0 AS lv, CASE WHEN crc % 7 = 0 THEN other ELSE leaf END AS h
  FROM (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                  lambda a, b: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END,
                                           xor(a, b)), 4294967295)) AS crc FROM x)
  UNION ALL
  SELECT f.g, f.i, f.lv + 1, sha256(CASE WHEN s.odd = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM folded f JOIN steps s ON s.g = f.g AND s.i = f.i AND s.lv = f.lv)
SELECT x.doc_id, x.leaf, sub.h AS subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256,
       e.h AS folded_root, e.h = root.h AS verified
FROM x JOIN sub USING (g) CROSS JOIN (SELECT h FROM top WHERE n = 1) root LEFT JOIN proof p ON p.g = x.g AND p.i = x.i
JOIN (SELECT g, i, arg_max(h, lv) AS h FROM folded GROUP BY g, i) e ON e.g = x.g AND e.i = x.i
"""


def op12_density_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article text of every page by composite text density."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_nsbounds_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every 64-component vector after ten rounds over eight centroids."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    assigned, history = cluster_vectors(vectors, dims=64, clusters=8, rounds=10, scale=1024, salt="3")
    return with_inertia(written(assigned), history[-1])


def _op13_sql(clusters: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same rounds as one chain of tables: vectors by component, distances to all centroids, floored means."""
    steps = [f"""e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (SELECT r, unnest(range({dims})) AS d, unnest(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS x FROM e),
o AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT c, d, x FROM o JOIN v USING (r) WHERE c < {clusters})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist
  FROM (SELECT r, c, sum((v.x - w.x) * (v.x - w.x))::BIGINT AS dist FROM v JOIN c{k} w USING (d) GROUP BY r, c) GROUP BY r)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN v USING (r) GROUP BY c, d),
c{k + 1} AS MATERIALIZED (SELECT w.c, w.d, coalesce((s - ((s % n) + n) % n) // n, w.x) AS x FROM c{k} w LEFT JOIN m{k} USING (c, d))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(dist) OVER ())::BIGINT AS inertia, h.s AS centroid_sha256
FROM a{rounds} a JOIN e USING (r)
JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS s FROM c{rounds} GROUP BY c) h ON h.c = a.c"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bounded_packing": op1_bounded_packing,
    "op2_boosted_quality": op2_boosted_quality,
    "op3_transducer_counts": op3_transducer_counts,
    "op4_curriculum_mixing": op4_curriculum_mixing,
    "op5_vamana_neighbours": op5_vamana_neighbours,
    "op6_forest_secrets": op6_forest_secrets,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_signature_trees": op8_signature_trees,
    "op9_simple8b_tokens": op9_simple8b_tokens,
    "op10_byte_shards": op10_byte_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_density_text": op12_density_text,
    "op13_nsbounds_clusters": op13_nsbounds_clusters,
}

ORACLES: dict[str, str] = {"op4_curriculum_mixing": OP4_SQL, "op7_quality_cascade": OP7_SQL,
                           "op11_merkle_manifest": OP11_SQL, "op13_nsbounds_clusters": OP13_SQL}
