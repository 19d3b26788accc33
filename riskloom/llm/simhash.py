"""SimHash near-duplicates by pigeonhole blocks.

The 64 fingerprint bits are split into ``blocks`` parts.  Two fingerprints that
differ in at most ``max_bits`` bits agree on at least ``blocks - max_bits``
parts, so they meet under one of the keys made of that many parts; what meets is
verified by Hamming distance.  Links are made between distinct fingerprints only
and a key's group yields a spanning forest of its links, never all pairs.  A
group over ``chunk`` fingerprints is dealt in pairs of chunks, so that no task
holds more than two chunks of it.  Components come from repeated star
contraction over written tables.

Nulls: a null text is the empty text; texts without words have fingerprint zero
and link like any other.  A null id takes part, but is never a component's
smallest id.  Repeated rows keep one row each.  An empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import hex16, long_text_batches, release_memory, texts, written

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCKS = 5
CHUNK = 1024
PIECE = 1 << 16


def simhash(data: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of UTF-8 ``data`` (A-Z lower-cased, words split at ASCII white space)."""
    w = data.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = w[at:at + PIECE + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if n > 1 or len(w) == shingle else [b" ".join(w)]
        digest = np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), np.uint8)
        votes += np.unpackbits(digest.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, row, fp`` (signed long) for every row of ``docs(doc_id, row, text)``."""
    long_text_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            fps = [simhash(t.encode(), shingle) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row": pdf["row"], "fp": np.array(fps, np.int64)})
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint"), "row", "text").mapInPandas(run, "doc_id bigint, row string, fp bigint")


def block_keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """Array of the keys of ``fp``: every choice of ``blocks - max_bits`` parts, tagged by the choice."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, edge[i]).bitwiseAND(F.lit((1 << (edge[i + 1] - edge[i])) - 1)) for i in range(blocks)]
    return F.array(*[
        F.struct(F.lit(tag).alias("tag"), _joined([(part[i], edge[i + 1] - edge[i]) for i in chosen]).alias("parts"))
        for tag, chosen in enumerate(combinations(range(blocks), blocks - max_bits))])


def _joined(parts) -> Column:
    out = F.lit(0).cast("bigint")
    for col, width in parts:
        out = F.shiftleft(out, width).bitwiseOR(col)
    return out


def spanning_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (Hamming distance at most ``max_bits``) within ``fps``."""
    bits, out = fps.view(np.uint64), []
    left = np.arange(len(fps))
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            u = stack.pop()
            near = np.bitwise_count(bits[left] ^ bits[u]) <= max_bits
            hit = left[near]
            out += [(int(fps[u]), int(fps[v])) for v in hit]
            stack += list(hit)
            left = left[~near]
    return out


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp`` that give the same components as all links."""
    keyed = written(distinct.select("fp", F.explode(block_keys(F.col("fp"), max_bits, blocks)).alias("k"))
                    .select("fp", "k.*"), "blocks")
    sizes = written(keyed.groupBy("tag", "parts").agg(F.count("*").alias("n")).filter("n > 1"), "block-sizes")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = (keyed.join(sizes, ["tag", "parts"])
           .withColumn("chunks", chunks)
           .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
           .groupBy("tag", "parts", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
           .agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1))

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def forest(groups: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in spanning_links(np.asarray(g, np.int64), max_bits)] for g in groups])

    return met.select(F.explode(forest("fps")).alias("l")).select("l.*").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (the smallest node reachable) for the nodes of ``edges(a, b)``, by star contraction."""
    def checksum(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def stars(e, large: bool):
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else \
            e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(least, "a")
        if large:
            return out.filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return (out.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(least.select("a", F.col("m").alias("b")))).distinct()

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = checksum(now)
    while seen[0]:
        now = written(stars(written(stars(now, True), "large"), False), "small")
        if (got := checksum(now)) == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def labelled(docs: DataFrame, shingle: int, max_bits: int, blocks: int, chunk: int) -> DataFrame:
    """``doc_id, row, fp, label, component_id`` for every row of ``docs(doc_id, row, text)``."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("lo")), "distinct")
    labels = components(links(distinct, max_bits, blocks, chunk))
    grouped = (distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
               .withColumn("label", F.coalesce("label", "fp")))
    smallest = grouped.groupBy("label").agg(F.min("lo").alias("component_id"))
    return fps.join(grouped.join(smallest, "label").select("fp", "label", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
                    chunk: int = CHUNK) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``."""
    rows = texts(docs).withColumn("row", F.lit(""))
    return labelled(rows, shingle, max_bits, blocks, chunk).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
                 chunk: int = CHUNK) -> DataFrame:
    """One row of each component of ``docs``, its columns unchanged: the one of the
    smallest id (null ids last), of equal ids the one of the smallest row hash."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    row = F.concat(hex16(F.xxhash64(*every)), hex16(F.xxhash64(F.lit(1), *every)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    keep = labelled(rows, shingle, max_bits, blocks, chunk).groupBy("label").agg(first.alias("f")).select(F.col("f.row").alias("_kept"))
    own = docs.select(F.struct(*every).alias("own"), row.alias("_row"))     # its columns may have any names
    return own.join(keep, F.col("_row") == F.col("_kept")).dropDuplicates(["_row"]).select("own.*")
