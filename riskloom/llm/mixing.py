"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; a document's expected number of copies is its
source's rate, target / words, which is rounded to whole copies so that the words
of each source stay at its target:

* Large documents (over ``1 / LARGE`` of their source's words, so fewer than
  ``LARGE`` a source) come first, largest first.  Each is paired with all smaller
  documents of its source as one partner: mass in words moves at random one way or
  the other until the document has a whole number of copies or the partner has no
  more to give (0 copies) or to take (``MOST`` copies).  Odds are such that nobody's
  expected words change; a document whose partner is exhausted is then settled the
  way that the partner can make up for, or else to the nearer number.
* The rest, which still share one rate, are cut into leaves of ``LEAF`` rows.  In a
  leaf the fractional documents are paired; a pair moves mass until one of the two is
  integral, the other meets the next document.  A leaf leaves at most one fractional
  document; these residuals are joined by the same rule, ``LEAF`` leaves a node,
  level after level up to one per source, which goes to the nearer whole number.

So a source's words differ from its target by at most half of one document, of a
size up to ``1 / LARGE`` of the source where it has that many small ones (a source
whose bulk is one document can miss by up to half of that).

Order and draws depend on the rows alone (places by hash, generators seeded by
source, level and node), not on partitions.  Nulls: a null text has no words, a null
source is a source (the last one), null ids are kept.  Repeated rows are rows of
their own; rows equal in all columns are interchangeable.  Documents without words
take nothing.  Sources without words have target 0.  An empty table gives an empty
result.  Very long texts are only counted.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ordinals, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
LARGE = 1000
LEAF = 10_000
SEED = 20

_ROW = "doc_id string, source string, size long"
_SETTLED = _ROW + ", node long, mass double, copies long"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: weights 5, 2, 1, ... by
    source order share the sum of all sizes, capped at ``MOST`` times the source's."""
    placed = ordinals(sizes, [], [F.col("source").asc_nulls_last()], "mix-sources")
    at = (F.col("pos") % len(WEIGHTS)).cast("int") + 1
    weighed = written(placed.select("source", "source_size", F.element_at(F.array(*map(F.lit, WEIGHTS)), at).cast("bigint").alias("w")), "mix-weights")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    share, weight = total, 1
    over = None
    done = -1
    while True:     # each round caps at least one more source
        row = weighed.agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("s") if over is not None else F.lit(0).alias("s"),
                          F.coalesce(F.sum(F.when(over, 0).otherwise(F.col("w"))) if over is not None else F.sum("w"), F.lit(0)).alias("w"),
                          F.coalesce(F.sum(F.when(over, 1)) if over is not None else F.lit(0), F.lit(0)).alias("n")).first()
        if row["n"] == done:
            break
        done, share, weight = row["n"], total - MOST * row["s"], max(row["w"], 1)
        exact = "decimal(38,0)"
        over = F.lit(share).cast(exact) * F.col("w") > F.lit(MOST * weight).cast(exact) * F.col("source_size")
    target = F.when(over, F.col("source_size") * float(MOST)).otherwise(F.lit(float(share)) * F.col("w") / F.lit(float(weight)))
    return written(weighed.select("source", "source_size", target.alias("target")), "mix-targets")


def _seed(source, *more) -> np.random.Generator:
    return np.random.default_rng([SEED, *more, zlib.crc32(b"" if source is None else b"=" + source.encode())])


def _name(source):
    return None if source is None or source != source else source


def settle_large(part: pd.DataFrame) -> pd.DataFrame:
    """Copies of one source's large documents; a last row without id holds what is
    left for the small ones: ``size`` words with a total ``mass``."""
    part = part.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first")
    source = _name(part["source"].iloc[0])
    draw = _seed(source).random(len(part))
    rest, mass = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
    copies = []
    for size, u in zip(part["size"].tolist(), draw):
        rate = min(max(mass / rest, 0.0), float(MOST))
        rest -= size
        mine = rate * size
        mass = max(mass - mine, 0.0) if rest else 0.0
        low = math.floor(rate)
        part_words = mine - low * size
        up, down = min(size - part_words, mass), min(part_words, max(MOST * rest - mass, 0.0))
        if low >= MOST or part_words <= 0:
            copies.append(low)
            continue
        if u * (up + down) < down:
            part_words, mass = part_words + up, mass - up
        elif up + down > 0:
            part_words, mass = part_words - down, mass + down
        if 0 < part_words < size:       # the partner is at its bound: settled the way that it can make up for
            if mass <= 0 and part_words <= MOST * rest:
                part_words, mass = 0, part_words
            elif mass > 0 and size - part_words <= mass:
                part_words, mass = size, mass - (size - part_words)
        copies.append(low + (1 if 2 * part_words >= size else 0))
    out = part[["doc_id", "source", "size"]].assign(node=-1, mass=np.nan, copies=copies)
    left = pd.DataFrame({"doc_id": [None], "source": [source], "size": [rest], "node": [-2], "mass": [mass], "copies": [None]})
    return pd.concat([out.astype({"copies": "Int64"}), left.astype({"copies": "Int64"})], ignore_index=True)


def settle_node(part: pd.DataFrame, level: int) -> pd.DataFrame:
    """One node of the tree: documents (or residuals of lower nodes) in order of
    ``pos``, each with ``mass`` words above ``low`` copies.  All come back settled
    but one at most, which keeps its mass."""
    part = part.sort_values("pos", kind="stable").reset_index(drop=True)
    source, node = _name(part["source"].iloc[0]), int(part["node"].iloc[0])
    size, mass, low = part["size"].tolist(), part["mass"].tolist(), part["low"].tolist()
    draw = _seed(source, level, node).random(len(size)).tolist()
    copies: list[int | None] = [None] * len(size)
    held = None
    for j, (a, m) in enumerate(zip(size, mass)):
        if m <= 0 or m >= a:
            copies[j] = low[j] + (1 if a and m >= a else 0)
            continue
        if held is None:
            held = j
            continue
        i = held
        ai, mi = size[i], mass[i]
        up, down = min(ai - mi, m), min(mi, a - m)
        if draw[j] * (up + down) < down:        # words move to the held one
            full, spent = up == ai - mi, up == m
            mass[i], mass[j] = mi + up, m - up
            if full:
                copies[i] = low[i] + 1
            if spent:
                copies[j] = low[j]
        else:
            spent, full = down == mi, down == a - m
            mass[i], mass[j] = mi - down, m + down
            if spent:
                copies[i] = low[i]
            if full:
                copies[j] = low[j] + 1
        held = next((k for k in (i, j) if copies[k] is None), None)
    return pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "size": part["size"], "low": part["low"],
                         "node": part["node"], "mass": mass, "copies": pd.array(copies, dtype="Int64")})


def mix(docs: DataFrame, leaf: int = LEAF, large: int = LARGE) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every row of ``docs(doc_id, source, text)``."""
    id_type = dict(docs.dtypes)["doc_id"]
    rows = written(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               words(F.col("text").cast("string")).alias("size"),
                               F.xxhash64("text", "doc_id").alias("h")), "mix-rows")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    joined = _with(rows, goal)
    big = F.col("size") * large > F.col("source_size")
    first = written(joined.filter(big).groupBy("source").applyInPandas(settle_large, _SETTLED), "mix-large")
    left = first.filter("node = -2").select("source", F.col("size").alias("left_size"), F.col("mass").alias("left_mass"))
    rate = F.coalesce(F.col("left_mass") / F.nullif(F.col("left_size"), F.lit(0)), F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    small = _with(joined.filter(~big), left).withColumn("rate", F.least(F.greatest(rate, F.lit(0.0)), F.lit(float(MOST))))
    small = small.select("doc_id", "source", "size", "h", F.floor("rate").alias("low"), ((F.col("rate") - F.floor("rate")) * F.col("size")).alias("mass"))
    level, nodes = 0, ordinals(small, ["source"], ["h", "doc_id", "size"], "mix-order")
    settled = [first.filter("node = -1").select("doc_id", "source", "size", "copies")]
    while True:
        nodes = nodes.select("doc_id", "source", "size", "low", "mass", "pos", F.floor(F.col("pos") / leaf).alias("node"))
        step = written(nodes.groupBy("source", "node").applyInPandas(_node_step(level), _SETTLED + ", low long"), f"mix-level-{level}")
        settled.append(step.filter("copies IS NOT NULL").select("doc_id", "source", "size", "copies"))
        nodes = step.filter("copies IS NULL").select("doc_id", "source", "size", "low", "mass", F.col("node").alias("pos"))
        if not step.agg(F.max("node").alias("m")).first()["m"]:
            break
        level += 1
    settled.append(nodes.select("doc_id", "source", "size", (F.col("low") + (2 * F.col("mass") >= F.col("size")).cast("int")).alias("copies")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return _with(out, goal).select(F.col("doc_id").cast(id_type).alias("doc_id"), "source", "size", "source_size", "target", "copies")


def _node_step(level: int):
    def step(part: pd.DataFrame) -> pd.DataFrame:
        return settle_node(part, level)
    return step


def _with(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of one row a source; Spark picks the join by that table's size."""
    other = per_source.withColumnRenamed("source", "source_")
    return rows.join(other, rows["source"].eqNullSafe(other["source_"]), "left").drop("source_")


def drawn(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``plan`` (of :func:`mix`) says,
    in the columns of ``docs``.  Rows with one id and source share their copies evenly:
    of the copies of all of them, each gets the whole part and the first ones, by the
    place in their text order, one more."""
    per = plan.groupBy(F.col("doc_id").alias("doc_id_"), F.col("source").alias("source_"), F.col("size").alias("size_")) \
        .agg(F.sum("copies").alias("copies_"), F.count("*").alias("rows_"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"),
                         words(F.col("text").cast("string")).alias("size"))
    numbered = ordinals(packed, ["doc_id", "source", "size"], [F.xxhash64("row")], "mix-drawn")
    hit = numbered.join(per, numbered["doc_id"].eqNullSafe(per["doc_id_"]) & numbered["source"].eqNullSafe(per["source_"])
                        & (numbered["size"] == per["size_"]))
    own = F.floor(F.col("copies_") / F.col("rows_")) + (F.col("pos") < F.col("copies_") % F.col("rows_")).cast("int")
    return hit.select("row", F.explode(F.array_repeat(F.lit(0), own.cast("int"))).alias("copy")).select("row.*")
