"""Merkle manifest of a dataset: a SHA-256 midstate tree over its rows.

A leaf is the digest of a row's fields.  Per source, leaves ascend by id and every
three consecutive nodes become the digest of their hex digests, level by level, up
to the source's subroot; the subroots, by source, likewise give the root.  Partial
runs, a single node among them, are hashed too; a lone leaf is its own subroot.

The tree is built in blocks of ``RUN ** HEIGHT`` consecutive nodes.  A task builds
whole blocks; each parent keeps a copy of its hash state before every child slot.
Block tops are the nodes of the next stage, so ``log(n) / log(RUN ** HEIGHT)``
stages reach the subroot, whatever the size of a source, and places are found by
ranges, so a hot source lies in many tasks.  Coming down, a block's path upwards
(its runs' digests and its slots) is one row a block.  :func:`folded` then takes
a replaced leaf up: in every run it resumes the state kept before the slot with the
replacement and the right siblings only; left siblings are never hashed again (for
the path above a block its states are set up once a block).

Nulls: a null field is written ``-``; a null source is a source of its own (the
first); null ids come first.  Rows with one id are ordered by leaf; equal rows are
leaves of their own.  Empty texts have length 0; very long ones are hashed by the
engine.  An empty table has no proofs.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ordinals, written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RUN = 3
HEIGHT = 8
DIGEST = 64

_TOPS = "source string, pos long, digest string"
_UPS = "source string, block long, up string"


def leaf(*fields: Column) -> Column:
    """SHA-256, in hex, of the fields one after another: ``-`` or byte count, ``:``, value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(f.cast("string")) for f in fields]), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where the id's checksum is even, else null (as for texts that this leaves alone)."""
    hit = (F.crc32(doc_id.cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit("")))


def depth(total: int) -> int:
    """Levels above ``total`` nodes."""
    levels = 0
    while total > 1:
        total, levels = -(-total // RUN), levels + 1
    return levels


def block_levels(total: int, height: int) -> int:
    """Levels that a block of a row of ``total`` nodes is raised by: all blocks by ``height``,
    or by what is left where one block holds the row."""
    return min(depth(total), height)


class Block:
    """Consecutive nodes and all levels above them.  ``levels[k]`` holds level k's digests,
    ``states[k]`` the states kept by their parents: before slot j of parent p at ``p * RUN + j``."""

    def __init__(self, digests: list[bytes], levels: int):
        self.levels, self.states = [digests], []
        for _ in range(levels):
            nodes, kept, up = self.levels[-1], [], []
            for i in range(0, len(nodes), RUN):
                state = hashlib.sha256()
                for node in nodes[i:i + RUN]:
                    kept.append(state.copy())
                    state.update(node)
                up.append(state.hexdigest().encode())
            self.states.append(kept)
            self.levels.append(up)

    def top(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, at: int) -> bytes:
        """Digests of the other nodes of each run on the way up from node ``at``."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % RUN
            out += nodes[first:at] + nodes[at + 1:first + RUN]
            at //= RUN
        return b"".join(out)

    def fold(self, at: int, digest: bytes) -> bytes:
        """The top with ``digest`` in place of node ``at``."""
        for nodes, kept in zip(self.levels, self.states):
            state = kept[at].copy()
            state.update(digest)
            for right in nodes[at + 1:at - at % RUN + RUN]:
                state.update(right)
            digest, at = state.hexdigest().encode(), at // RUN
        return digest

    def path(self, at: int) -> str:
        """The runs on the way up from node ``at``, as text: per level the slot, then all digests of the run."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % RUN
            out.append(f"{at - first}" + b"".join(nodes[first:first + RUN]).decode())
            at //= RUN
        return ",".join(out)


class Path:
    """A stored path upwards, ready to fold: the state before its slot and the right siblings per level."""

    def __init__(self, text: str):
        self.steps, self.others = [], b""
        for step in filter(None, text.split(",")):
            slot, run = int(step[0]) * DIGEST, step[1:].encode()
            state = hashlib.sha256(run[:slot])
            self.steps.append((state, run[slot + DIGEST:]))
            self.others += run[:slot] + run[slot + DIGEST:]

    def fold(self, digest: bytes) -> bytes:
        for kept, right in self.steps:
            state = kept.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def blocks_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole (source, block) groups of rows that come sorted by them, one after another."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        keys = list(zip(frame["source"].where(frame["source"].notna(), None), frame["block"].tolist()))
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if lo == hi:
                continue
            if held and keys[lo] != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[lo:hi])
            last = keys[lo]
    if held:
        yield pd.concat(held, ignore_index=True)


def _grouped(nodes: DataFrame, *order: str) -> DataFrame:
    """Blocks over all tasks, each in one piece and in order."""
    return nodes.repartition("source", "block").sortWithinPartitions("source", "block", *order)


def _source(part: pd.DataFrame):
    s = part["source"].iloc[0]
    return None if s is None or s != s else s


def _digests(column: pd.Series) -> list[bytes]:
    return [d.encode() for d in column.tolist()]


def stages(nodes: DataFrame, height: int, tag: str) -> list[DataFrame]:
    """Node tables ``source, block, pos, total, digest`` from ``nodes(source, pos, total, digest)``
    up to one node a source; every stage's nodes are the block tops of the one before."""
    size = RUN ** height

    def tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in blocks_of(frames):
            block = Block(_digests(part["digest"]), block_levels(int(part["total"].iloc[0]), height))
            yield pd.DataFrame({"source": [_source(part)], "pos": [int(part["block"].iloc[0])], "digest": [block.top().decode()]})

    blocked = lambda df: df.select("source", F.floor(F.col("pos") / size).alias("block"), "pos", "total", "digest")
    out = [blocked(nodes)]
    most = nodes.agg(F.max("total").alias("n")).first()["n"] or 0
    while most > 1:
        now = out[-1]
        sizes = now.filter("pos = 0").select(F.col("source").alias("of"), F.ceil(F.col("total") / size).alias("total"))
        up = written(_grouped(now.select("source", "block", "pos", "total", "digest"), "pos").mapInPandas(tops, _TOPS), f"{tag}-tops")
        out.append(written(blocked(up.join(sizes, up["source"].eqNullSafe(sizes["of"])).select("source", "pos", "total", "digest")), f"{tag}-nodes"))
        most = -(-most // size)
    return out


def _with_ups(rows: DataFrame, ups: DataFrame) -> DataFrame:
    """Blocks of ``rows``, each led by its row of ``ups`` (as place -1)."""
    kinds = {c: t for c, t in rows.dtypes if c not in ("source", "block", "pos", "total")}
    lead = ups.select("source", "block", F.lit(-1).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("total"),
                      *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], "up")
    return _grouped(lead.unionByName(rows.withColumn("up", F.lit(None).cast("string"))), "pos")


def paths(stage: DataFrame, ups: DataFrame, height: int, tag: str) -> DataFrame:
    """``source, block, up`` per node of ``stage``, which is a block of the stage below: its
    way up inside its own block, then that block's path in ``ups``."""
    def down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in blocks_of(frames):
            above, part = part["up"].iloc[0], part.iloc[1:]
            block = Block(_digests(part["digest"]), block_levels(int(part["total"].iloc[0]), height))
            yield pd.DataFrame({"source": part["source"], "block": part["pos"],
                                "up": [",".join(filter(None, (block.path(at), above))) for at in range(len(part))]})
    return written(_with_ups(stage, ups).mapInPandas(down, _UPS), tag)


def proofs(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row of ``docs``: its ``leaf``, ``subroot`` and ``root``, ``proof_sha256`` (digest of its
    siblings), ``folded_root`` from the tampered leaf (the row's own, where it is not tampered
    with) and whether that equals the root."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    other = tampered_text(doc_id, text.cast("string"))
    rows = docs.select(doc_id.alias("doc_id"), source.cast("string").alias("source"), leaf(doc_id, source, lang, n_chars, text).alias("digest"),
                       F.when(other.isNotNull(), leaf(doc_id, source, lang, n_chars, other)).alias("changed"))
    return folded(ordinals(rows, ["source"], [F.col("doc_id").asc_nulls_first(), "digest"], "merkle-leaves"), height)


def folded(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Proofs of ``leaves(doc_id, source, digest, changed, pos, total)``; ``changed`` replaces the
    digest where it is not null."""
    id_type = dict(leaves.dtypes)["doc_id"]
    own = stages(leaves, height, "merkle-source")
    subroots = written(own[-1].select("source", F.col("digest").alias("subroot")), "merkle-subroots")
    ranked = written(ordinals(subroots, [], [F.col("source").asc_nulls_first()], "merkle-order"), "merkle-ranked")
    over = stages(ranked.select(F.lit(None).cast("string").alias("source"), "pos", "total", F.col("subroot").alias("digest")), height, "merkle-root")
    ups = over[-1].select("source", "block", F.lit("").alias("up"))
    for stage in reversed(over):
        ups = paths(stage, ups, height, "merkle-root-paths")
    ups = ranked.join(ups, ranked["pos"] == ups["block"]).select(ranked["source"], F.lit(0).cast("bigint").alias("block"), "up")
    for stage in reversed(own[1:]):
        ups = paths(stage, ups, height, "merkle-paths")

    def prove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in blocks_of(frames):
            path, part = Path(part["up"].iloc[0]), part.iloc[1:]
            digests = _digests(part["digest"])
            block = Block(digests, block_levels(int(part["total"].iloc[0]), height))
            proof, fold = [], []
            for at, (digest, changed) in enumerate(zip(digests, part["changed"].tolist())):
                proof.append(hashlib.sha256(block.siblings(at) + path.others).hexdigest())
                fold.append(path.fold(block.fold(at, changed.encode() if isinstance(changed, str) else digest)).decode())
            yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "leaf": part["digest"], "proof_sha256": proof, "folded_root": fold})

    rows = leaves.select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.floor(F.col("pos") / RUN ** height).alias("block"),
                         "pos", "total", "digest", "changed")
    proven = _with_ups(rows, ups).mapInPandas(prove, "doc_id string, source string, leaf string, proof_sha256 string, folded_root string")
    root = over[-1].first()
    subroots = subroots.withColumnRenamed("source", "of")
    return proven.join(subroots, proven["source"].eqNullSafe(subroots["of"])).select(
        F.col("doc_id").cast(id_type).alias("doc_id"), "leaf", "subroot", F.lit(root and root["digest"]).cast("string").alias("root"), "proof_sha256",
        "folded_root", (F.col("folded_root") == F.lit(root and root["digest"]).cast("string")).alias("verified"))
