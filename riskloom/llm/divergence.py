"""Source divergence audit: how the sources of a language differ in its frequent terms.

Frequent terms are found by iceberg prefix refinement.  Each of a document's distinct
terms, in byte order, is new from the first level on whose prefix differs from the
term's before; so a prefix's number of distinct documents is a plain sum over the
terms that are new at its level.  These sums are taken per group over all documents
that a task reads (``HELD`` of them at a time), and only they are written.  Level k looks at prefixes of ``FIRST * 2 ** k`` bytes: those in
fewer than ``LEAST`` documents of the language are discarded with all their terms;
prefixes shorter than the level are complete terms and kept; the rest are extended by
the next level, until none is left.  Only kept terms are counted by source.

Divergences of sources are sums over all kept terms.  Terms are dealt to chunks; a
chunk holds a table of its terms by the language's sources (chunks of languages with
many sources are dealt again by blocks of ``TILE`` sources) and adds up its share of
every pair of sources, so what is shuffled is one number a pair and chunk.

All arithmetic is in integers.  Nulls: a null text, language or source counts as the
empty one.  Empty texts and texts without terms still make their group occur.  Repeated
rows are documents of their own.  Terms of any length are refined; whole texts are
read.  A language without kept terms has pairs of value 0.  Ties go to the smaller
item.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import long_text_batches, ordinals, written

LEAST = 10
FIRST = 6
TOP = 10
CHUNK = 1000
TILE = 512
SCALE = 1_000_000_000
#: Kept prefixes are sent to all workers up to this many bytes; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Term counts that a task holds before it writes them out.
HELD = 800_000

#: A-Z in lower case, other ASCII than letters as spaces, all bytes of other characters as they are.
_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """All terms of a text, in order, as UTF-8."""
    return text.encode().translate(_BYTES).split()


def fresh_terms(terms: set[bytes]) -> list[list[bytes]]:
    """Distinct terms by the first level at which each one's prefix is new, in byte order.
    Only terms that share their first prefix are sorted."""
    head = itemgetter(slice(FIRST))
    one = dict(zip(map(head, terms), terms))
    if len(one) == len(terms):
        return [list(terms)]
    shared = {}
    for term in terms.difference(one.values()):
        shared.setdefault(term[:FIRST], []).append(term)
    levels = [[]]
    for start, group in shared.items():
        group.append(one[start])
        group.sort()
        last = one[start] = group[0]
        for term in group[1:]:
            length, level = FIRST * 2, 1
            while term[:length] == last[:length]:
                length, level = length * 2, level + 1
            while len(levels) <= level:
                levels.append([])
            levels[level].append(term)
            last = term
    levels[0] = list(one.values())
    return levels


class Held:
    """Counts of a task's documents so far, by group: occurrences of each term, and per level
    the documents in which it is new."""

    def __init__(self):
        self.groups: dict[tuple, tuple[Counter, defaultdict]] = {}

    def add(self, lang: str, source: str, text: str) -> None:
        terms = terms_of(text)
        if not terms:
            return
        counts, fresh = self.groups.setdefault((lang, source), (Counter(), defaultdict(Counter)))
        counts.update(terms)
        for level, new in enumerate(fresh_terms(set(terms))):
            fresh[level].update(new)

    def size(self) -> int:
        return sum(len(counts) for counts, _ in self.groups.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, fresh) in self.groups.items():
            for level in sorted(fresh):
                terms = fresh[level]
                n = len(terms)
                # a term's occurrences go with its lowest level
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(terms), pa.binary()),
                     pa.array([level] * n, pa.int32()), pa.array(list(terms.values()), pa.int64()), pa.array([counts.pop(t, 0) for t in terms], pa.int64())],
                    ["lang", "source", "term", "level", "docs", "n"])
        self.groups = {}


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Held()
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            held.add(*row)
        if held.size() > HELD:
            yield from held.batches()
    yield from held.batches()


def postings(docs: DataFrame) -> DataFrame:
    """``lang, source, term, level, docs, n`` of ``docs(lang, source, text)`` (no nulls): partial
    sums, to be added up, of the documents in which a term is new at a level, and of its occurrences."""
    long_text_batches(docs.sparkSession, 200)
    return docs.select("lang", "source", "text").mapInArrow(_postings, "lang string, source string, term binary, level int, docs long, n long")


def _sized(kept: DataFrame) -> DataFrame:
    """A hint to send ``kept`` to all workers, if its measured size allows."""
    row = kept.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("b")).first()
    return F.broadcast(kept) if (row["b"] or 0) + 100 * row["n"] <= BROADCAST_BYTES else kept


def prefix(term: Column, length: int) -> Column:
    return F.substring(term, 1, length)


def kept_terms(found: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, term`` of the terms in at least ``least`` documents of their language, by
    refinement over ``found`` (of :func:`postings`, written)."""
    done, candidates, length, level = None, found, FIRST, 0
    while True:
        counted = candidates.filter(F.col("level") <= level).groupBy("lang", prefix(F.col("term"), length).alias("term")).agg(F.sum("docs").alias("docs"))
        kept = written(counted.filter(F.col("docs") >= least).select("lang", "term"), f"iceberg-{level}")
        whole = kept.filter(F.octet_length("term") < length)
        done = whole if done is None else done.unionByName(whole)
        open_ = kept.filter(F.octet_length("term") == length)
        if open_.isEmpty():
            return written(done, "iceberg-terms")
        open_ = _sized(open_).select(F.col("lang").alias("lang_"), F.col("term").alias("term_"))
        longer = found.filter(F.octet_length("term") >= length)     # no other term has an open prefix
        candidates = longer.join(open_, (longer["lang"] == open_["lang_"]) & (prefix(longer["term"], length) == open_["term_"]), "left_semi")
        length, level = length * 2, level + 1


def _p(count: Column, n: Column, v: Column) -> Column:
    exact = "decimal(19,0)"
    whole = F.call_function("div", F.lit(SCALE).cast(exact) * (count + 2).cast(exact), F.nullif((n + 2 * v).cast(exact), F.lit(0).cast(exact)))
    return whole.cast("bigint") + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(terms: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
    """One chunk's share of the divergence of the tile's sources to all later ones."""
    heads = heads.sort_values("pos")
    base = heads["p0"].to_numpy(np.int64)
    code, rows = pd.factorize(terms["term"])
    p = np.repeat(base[None, :], len(rows), axis=0)
    p[code, terms["at"].to_numpy(np.int64)] = terms["p"].to_numpy(np.int64)
    left, right, sums = [], [], []
    first = int(heads["tile"].iloc[0]) * TILE
    for i in range(first, min(first + TILE, len(base))):
        mine, rest = p[:, i:i + 1], p[:, i + 1:]
        gap = mine - rest
        sums.append((gap * gap // (mine + rest)).sum(axis=0))
        left.append(np.full(rest.shape[1], i))
        right.append(np.arange(i + 1, len(base)))
    return pd.DataFrame({"lang": heads["lang"].iloc[0], "i": np.concatenate(left), "j": np.concatenate(right), "f": np.concatenate(sums)})


def pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of a language's sources."""
    chunks = F.greatest(F.ceil(F.col("v") / CHUNK), F.lit(1))
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / TILE).cast("int")))
    mine = counts.select("lang", "term", F.col("pos").alias("at"), "p", F.pmod(F.xxhash64("term"), chunks).alias("chunk"), "total").withColumn("tile", tiles)
    heads = groups.select("lang", "pos", "p0", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks.cast("bigint") - 1)).alias("chunk")) \
        .withColumn("tile", tiles)
    keys = ["lang", "chunk", "tile"]
    sums = mine.drop("total").groupBy(*keys).cogroup(heads.drop("total").groupBy(*keys)).applyInPandas(pair_sums, "lang string, i long, j long, f long")
    sums = written(sums.groupBy("lang", "i", "j").agg(F.sum("f").alias("value")), "divergence-pairs")
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    name = lambda at, to: groups.select(F.col("lang").alias(f"lang_{at}"), F.col("pos").alias(f"pos_{at}"), F.col("source").alias(to))
    a, b = name("i", "source"), name("j", "item")
    return both.join(a, (both["lang"] == a["lang_i"]) & (both["i"] == a["pos_i"])) \
        .join(b, (both["lang"] == b["lang_j"]) & (both["j"] == b["pos_j"])).select("lang", "source", "item", "value")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` over all of ``docs(lang, source, text)``."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = written(postings(docs), "postings")
    kept = kept_terms(found, least)
    hint = _sized(kept).select(F.col("lang").alias("lang_"), F.col("term").alias("term_"))
    counts = written(found.join(hint, (found["lang"] == hint["lang_"]) & (found["term"] == hint["term_"]), "left_semi")
                     .groupBy("lang", "source", "term").agg(F.sum("n").alias("c")), "divergence-counts")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"))
    group_n = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    lang_n = counts.groupBy("lang").agg(F.sum("c").alias("lang_n"))
    groups = ordinals(docs.select("lang", "source").distinct(), ["lang"], ["source"], "divergence-sources")
    zero = F.lit(0).cast("bigint")
    groups = groups.join(group_n, ["lang", "source"], "left").join(per_lang, "lang", "left").join(lang_n, "lang", "left") \
        .select("lang", "source", "pos", "total", *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "lang_n")])
    groups = written(groups.withColumn("p0", F.coalesce(_p(zero, F.col("n"), F.col("v")), zero)), "divergence-groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("c"), F.col("n"), F.col("v")))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("c").alias("lang_c"))
    q = _p(F.col("lang_c"), F.col("lang_n"), F.col("v"))
    terms = shares.join(of_lang, ["lang", "term"]).withColumn("q", q).filter("p > q") \
        .select("lang", "source", F.col("term").cast("string").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(ranked(pairs(groups, shares)), "pair").unionByName(out(ranked(terms).filter(F.col("rank") <= top), "term"))
