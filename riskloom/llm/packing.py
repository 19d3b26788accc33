"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A piece of ``n`` tokens is of class ``m = capacity // n``: a bin of that class
holds exactly ``m`` pieces, each in a slot of ``capacity // m`` tokens.  A
document is cut where its length would waste more than ``waste`` of a slot: the
head then has exactly the next class's slot size and the rest is classed anew.
Workers (hash buckets of pieces) fill their own bins of each class without
looking at each other.  What they leave over, fewer than ``m`` pieces a class,
goes through the same step with a sixteenth of the buckets, until one bucket is
left; its rest (under ``sum(m - 1)`` pieces over the classes, a number that the
capacity alone fixes) is placed first-fit by decreasing length.

Nulls: a null text is the empty text, one closing token.  Repeated rows are
packed once each.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import long_text_batches, release_memory, written

CAPACITY = 2048
WASTE = 1 / 64
END_ID = 1
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, m int"


@functools.lru_cache(maxsize=8192)
def classes(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> tuple[tuple[int, int], ...]:
    """Cuts of ``n < capacity`` tokens as (length, class)."""
    out = []
    while n:
        m = capacity // n
        slot = capacity // m
        if slot - n <= waste * slot:
            out.append((n, m))
            break
        head = capacity // (m + 1)
        out.append((head, m + 1))
        n -= head
    return tuple(out)


def cuts(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[tuple[int, int]]:
    return [(capacity, 1)] * (n // capacity) + list(classes(n % capacity, capacity, waste))


class Tokens:
    """Ids of whole texts by the byte-level BPE vocabulary at ``ranks_path``;
    ``special`` strings are one id each, as the tokenizer file has it."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def __call__(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())


@functools.lru_cache(maxsize=1)
def tokenizer() -> Tokens:
    """A worker's tokenizer, kept from task to task."""
    import public_tokenizers as P
    return Tokens(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256})


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, waste: float = WASTE,
                  make_tokens=tokenizer) -> DataFrame:
    """Pieces of every document of ``docs(doc_id, text)``, its closing id in the last one."""
    long_text_batches(docs.sparkSession)

    def run(batches):
        tokens = make_tokens()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(tokens(text), END_ID).astype("<u4")
                n, at = len(ids), 0
                for length, m in cuts(n, capacity, waste):
                    rows.append((doc, at, length, zlib.crc32(ids[at:at + length]), n, m))
                    at += length
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "m"])
            yield out.astype({"doc_id": "Int64"})
        release_memory()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, PIECES)


def first_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of each length: by decreasing length, to the fullest open bin with room (bins kept by room left)."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        left = next((r for r in range(n, capacity + 1) if room[r]), None)
        if left is None:
            b, left = bins, capacity
            bins += 1
        else:
            b = room[left].pop()
        out[i] = b
        room[left - n].append(b)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_pieces: int = 200_000) -> DataFrame:
    """``pieces`` (each with ``length`` and class ``m``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    todo, done, level = written(pieces, "pieces"), [], 0
    buckets = max(1, -(-todo.count() // bucket_pieces))
    cols = [c for c in todo.columns if c != "m"]
    while True:
        own = Window.partitionBy("bucket", "m")
        ranked = (todo.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", F.lit(level)), F.lit(buckets)))
                  .withColumn("rn", F.row_number().over(own.orderBy("doc_id", "start", "ids_crc32")) - 1)
                  .withColumn("whole", F.floor(F.count("*").over(own) / F.col("m")) * F.col("m"))
                  .withColumn("bin", F.floor(F.col("rn") / F.col("m"))))
        inside = Window.partitionBy("bucket", "m", "bin").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("bigint"))
        number = (((F.lit(level) * F.lit(1 << 22) + F.col("bucket")) * F.lit(capacity + 1) + F.col("m"))
                  * F.lit(1 << 20) + F.col("bin")).cast("bigint")
        ranked = written(ranked.withColumn("sequence_id", number), "ranked")
        done.append(ranked.filter("rn < whole").select(*cols, "sequence_id", "offset"))
        rest = ranked.filter("rn >= whole")
        if buckets == 1:
            break
        todo, level, buckets = rest.select(*cols, "m"), level + 1, -(-buckets // 16)
    left = rest.select(*cols).orderBy("doc_id", "start", "ids_crc32").collect()    # under sum(m - 1) over the classes
    fill: dict[int, int] = {}
    rows = []
    top = ((level + 1) << 22) * (capacity + 1) << 20
    for r, b in zip(left, first_fit([r["length"] for r in left], capacity)):
        rows.append((*r, top + b, fill.get(b, 0)))
        fill[b] = fill.get(b, 0) + r["length"]
    out = spark.createDataFrame(rows, done[0].schema)
    for d in done:
        out = out.union(d)
    return out
