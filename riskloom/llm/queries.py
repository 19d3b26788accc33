"""Registered queries of the training-data operators: each applies one operator,
with production parameters, to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import divergence, manifest, mixing, mtree, nbsvm, packing, secrets, segment, sharding, simhash, spotsigs, suffix, surrogate
from riskloom.llm.common import documents, hex16
from riskloom.sources.tables import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.fit(secrets.document_samples(docs)))
    return found.select("doc_id", *[secrets.of_kind("_base", k).alias(f"n_{name}") for k, (name, *_) in enumerate(secrets.BASE)],
                        F.sha2(secrets.listed("_base"), 256).alias("base_sha256"), secrets.listed("_spans").alias("spans"))


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared_with_next(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.fingerprint("sigs").alias("fingerprint"),
        spotsigs.fingerprint("edited_sigs").alias("edited_fingerprint"), "near_edited", "near_next",
        spotsigs.length_partition("sigs").alias("length_partition"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    key = spark.conf.get("spark.riskloom.surrogateKey", surrogate.KEY)
    count = lambda kind: F.size(F.filter("_hits", lambda h: h["kind"] == kind)).alias(f"n_{kind}")
    return surrogate.pseudonymised(docs, key).select("doc_id", "text", *[count(k) for k in surrogate.KINDS])


def op5_gumbel_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sampled(documents(spark, sf_dir))


def op6_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.crc32("text").alias("text_crc32"))
    placed = sharding.shard(rows, "doc_id", F.col("bytes") + sharding.ROW_BYTES, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                         F.col("vslot").alias("virtual_slot"), F.col("next_shard").alias("rebalanced_shard"))


def op7_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.quantised(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return mtree.search(vectors, F.col("id") % 20 == 0)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.with_cuts(documents(spark, sf_dir))
    n_bytes = F.octet_length("text").cast("bigint")
    removed = F.aggregate("_cuts", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["at"])
    return cut.select("doc_id", n_bytes.alias("n_bytes"), F.coalesce(removed, F.lit(0)).alias("n_removed"),
                      F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts")).cast("bigint").alias("n_spans"),
                      F.sha2(suffix.kept_bytes(), 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = nbsvm.fit(docs, read_table(spark, sf_dir, "labels"))
    return nbsvm.scored(docs, model).select("doc_id", nbsvm.held_out().alias("held_out"), "score",
                                            (F.col("score") >= nbsvm.KEEP_AT).cast("int").alias("predicted"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_documents(documents(spark, sf_dir))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(read_table(spark, sf_dir, "documents", manifest.FIELDS))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents", ["lang", "source", "text"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scan, op2_spot_signatures, op3_simhash_near_dedup, op4_surrogates, op5_gumbel_segmentation,
    op6_virtual_slot_sharding, op7_mtree_search,
    op8_suffix_dedup, op9_quality_classifier, op10_harmonic_packing, op11_pivotal_mixing,
    op12_merkle_manifest, op13_divergence_audit)}
ORACLES: dict[str, str] = {
    "op7_mtree_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS rid,
                list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1),
                        lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
                    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc
            FROM documents),
        f AS (
            SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
            FROM d),
        l AS (
            SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed
            FROM f),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
        own AS (
            SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY source
            UNION ALL
            SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], '')))
            FROM own WHERE len(nodes) > 1),
        subs AS (
            SELECT source, nodes[1] AS subroot, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
            FROM own WHERE len(nodes) = 1),
        over_ AS (
            SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subs
            UNION ALL
            SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], '')))
            FROM over_ WHERE len(nodes) > 1),
        top AS (SELECT nodes[1] AS root, level AS depth FROM over_ WHERE len(nodes) = 1),
        steps AS (
            SELECT source, level, nodes FROM own WHERE len(nodes) > 1
            UNION ALL
            SELECT s.source, s.depth + o.level, o.nodes FROM subs s, over_ o WHERE len(o.nodes) > 1),
        walk AS (
            SELECT p.rid, p.source, 0 AS level, p.pos AS pos, p.changed AS digest, '' AS siblings, s.depth, s.pos AS sub_pos, s.depth + t.depth AS height
            FROM p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source, top t
            UNION ALL
            SELECT w.rid, w.source, w.level + 1, a.at // 3,
                sha256(array_to_string(n.nodes[a.at - a.at % 3 + 1:a.at], '') || w.digest || array_to_string(n.nodes[a.at + 2:a.at - a.at % 3 + 3], '')),
                w.siblings || array_to_string(n.nodes[a.at - a.at % 3 + 1:a.at], '') || array_to_string(n.nodes[a.at + 2:a.at - a.at % 3 + 3], ''),
                w.depth, w.sub_pos, w.height
            FROM walk w JOIN steps n ON n.source IS NOT DISTINCT FROM w.source AND n.level = w.level,
                LATERAL (SELECT CASE WHEN w.level = w.depth THEN w.sub_pos ELSE w.pos END AS at) a
            WHERE w.level < w.height)
        SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(w.siblings) AS proof_sha256, w.digest AS folded_root, w.digest = t.root AS verified
        FROM p JOIN subs s ON s.source IS NOT DISTINCT FROM p.source JOIN walk w ON w.rid = p.rid AND w.level = w.height, top t""",
    "op13_divergence_audit": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
        c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS c FROM tok t JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
        g AS (SELECT g.lang, g.source, coalesce(n.n, 0)::HUGEINT AS n, v.v FROM (SELECT DISTINCT lang, source FROM d) g
              LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) n ON n.lang = g.lang AND n.source = g.source
              LEFT JOIN v ON v.lang = g.lang),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v) AS p
              FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)::HUGEINT) // ((sum(sum(c)) OVER (PARTITION BY lang))::HUGEINT + 2 * any_value(v)) AS q
              FROM c JOIN v USING (lang) GROUP BY lang, term),
        pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS f
                    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
                ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        term AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value
              FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
        u AS (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term),
        r AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM u)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM r WHERE part = 'pair' OR k <= 10""",
}
