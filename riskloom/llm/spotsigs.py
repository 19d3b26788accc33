"""SpotSigs document fingerprints.

A signature starts at a run of common words (the anchor) and chains it with the
``CHAIN`` content words that follow, common words between them skipped.  A text
without such a run is signed at every content word, one without words by itself.
The fingerprint is the sorted set of 32-bit signature hashes, 8 hex digits each.
Two fingerprints are compared by Jaccard likeness; sets are partitioned by length
so that sets whose sizes alone rule out the wanted likeness are never intersected.

Nulls: a null text is the empty text, with an empty fingerprint (likeness 1 to an
empty one, else 0).  Repeated rows give equal fingerprints.  The next document is
by ascending id, null ids first, then by text; after the last comes the first; a
lone document is its own next.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import int_array, written

CHAIN = 2
LIKENESS = 0.8
MARK = "\u0001"
# Common words of English, German, French and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "avec", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "como", "con", "del", "el", "las", "los", "para", "por", "se", "su", "y",
)


def with_signatures(df: DataFrame, text: str, to: str, chain: int = CHAIN, anchors=ANCHORS) -> DataFrame:
    """Column ``to``: the sorted distinct signature hashes of column ``text``."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    marked = F.array_join(F.transform(words, lambda w: F.concat(
        F.when(w.isin(*anchors), F.lit(MARK)).otherwise(F.lit(" ")), w)), "")
    tok = f"_{to}_tokens"       # [0]: anchors before the first content word; then a content word and the anchors after it
    df = df.withColumn(tok, F.split(marked, " ", -1))
    word = lambda i: F.substring_index(F.get(F.col(tok), i), MARK, 1)
    last = F.size(tok) - 1

    def chained(i):
        return F.concat_ws(" ", *[F.when(i + k <= last, word(i + k)) for k in range(1, chain + 1)])

    spots = F.transform(F.col(tok), lambda t, i: F.when(
        (F.instr(t, MARK) > 0) & (i < last), short(F.xxhash64(F.substring(t, F.instr(t, MARK), F.char_length(t)), chained(i)))))
    df = df.withColumn(f"{tok}_s", F.filter(spots, lambda x: x.isNotNull()))
    every = F.transform(F.sequence(F.lit(0), last - 1), lambda i: short(F.xxhash64(F.lit(""), chained(i))))
    sigs = (F.when(F.size(f"{tok}_s") > 0, F.col(f"{tok}_s"))
            .when(F.size(tok) > 1, every)
            .when(F.col(text) != "", F.array(short(F.xxhash64(F.col(text)))))
            .otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(to, F.sort_array(F.array_distinct(sigs))).drop(tok, f"{tok}_s")


def short(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def fingerprint(sigs: str) -> Column:
    return F.lower(F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def length_partition(sigs: str, likeness: float = LIKENESS) -> Column:
    """Partition of a set by its length: sets that reach ``likeness`` are in the same or in neighbouring partitions."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1))) / F.lit(math.log(1 / likeness))).cast("int")


def jaccard(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard likeness; 0 without comparing where the set lengths cannot reach ``least``."""
    na, nb = F.size(a), F.size(b)
    both = F.size(F.array_intersect(F.col(a), F.col(b))).cast("double")
    return (F.when(F.greatest(na, nb) == 0, F.lit(1.0))
            .when((F.least(na, nb) == 0) | (F.least(na, nb) < least * F.greatest(na, nb)), F.lit(0.0))
            .when((na == nb) & (F.col(a) == F.col(b)), F.lit(1.0))
            .otherwise(both / (na + nb - F.size(F.array_intersect(F.col(a), F.col(b))))))


def near_pairs(sets: DataFrame, least: float = LIKENESS) -> DataFrame:
    """Pairs ``a < b`` of ids of ``sets(id, sigs)``, distinct non-empty sets, whose
    likeness is at least ``least``.

    A set is indexed under the ``floor((1 - least) * n) + 1`` rarest of its ``n``
    signatures: two near sets share one of these.  They meet on (length partition,
    signature), a set probing its own partition and the next longer one."""
    seen = sets.select("id", F.size("sigs").alias("n"), length_partition("sigs", least).alias("p"), F.explode("sigs").alias("s"))
    df = seen.join(seen.groupBy("s").agg(F.count("*").alias("df")), "s").filter("df > 1")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    # signatures that no other set has come first in the order, so they use up places of the prefix
    alone = seen.join(df.select("id", "s"), ["id", "s"], "left_anti").groupBy("id").agg(F.count("*").alias("alone"))
    prefix = written(df.withColumn("r", rank).join(alone, "id", "left").withColumn("r", F.col("r") + F.coalesce("alone", F.lit(0)))
                     .filter(F.col("r") <= F.floor((1 - least) * F.col("n") + 1e-9) + 1).select("id", "n", "p", "s"), "prefix")
    probe = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("p"))
    met = (probe.join(prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s", "p"), ["p", "s"])
           .filter("a <> b and (na < nb or na = nb and a < b)").filter(F.col("na") >= least * F.col("nb") - 1e-9)
           .select("a", "b").distinct())
    full = (met.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
            .withColumn("likeness", jaccard("sa", "sb", least)).filter(F.col("likeness") >= least))
    return full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def in_sequence(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with ``_bucket, _key, _ghost``: rows dealt into ranges of
    ascending ids, one range to a shuffle partition, each range also holding (as a
    ghost) the rows that begin the next one; the last range, those of the first."""
    spark = docs.sparkSession
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = keyed.agg(F.min("_key").alias("lo"), F.percentile_approx("_key", F.array(*[F.lit((i + 0.5) / n) for i in range(n)]), F.lit(20 * n)).alias("q")).first()
    cuts = sorted({row["lo"], *(row["q"] or [])} - {None}) or [0]
    at, step = int_array(cuts, "bigint"), 1 << (len(cuts).bit_length() - 1)
    powers = []
    while step:
        powers.append(step)
        step //= 2
    key = F.col("_key")
    bucket = F.aggregate(int_array(powers), F.lit(0), lambda lo, p: F.when(
        (lo + p <= len(cuts)) & (F.element_at(at, F.least(lo + p, F.lit(len(cuts)))) <= key), lo + p).otherwise(lo))
    df = keyed.withColumn("_bucket", bucket)
    first = F.element_at(at, F.greatest("_bucket", F.lit(1))) == key
    before = F.when(F.col("_bucket") > 1, F.col("_bucket") - 1).otherwise(F.lit(len(cuts)))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("ghost"))
    places = F.when(first, F.array(own, F.struct(before.alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(own))
    return (df.withColumn("_place", F.explode(places)).withColumn("_bucket", F.col("_place.b"))
            .withColumn("_ghost", F.col("_place.ghost")).drop("_place"))


def compared_with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with signatures of each text (``sigs``), its edited
    text (``edited``, ``edited_sigs``) and likenesses ``near_edited, near_next``."""
    placed = in_sequence(docs).repartition("_bucket")
    order = Window.partitionBy("_bucket").orderBy("_ghost", "_key", "text")
    df = (with_signatures(placed, "text", "sigs")
          .withColumn("_next", F.lead("text").over(order)).withColumn("_next_sigs", F.lead("sigs").over(order))
          .filter("_ghost = 0"))
    df = df.withColumn("n_chars", F.char_length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("_next", F.lit(1), cut)))
    df = with_signatures(df, "edited", "edited_sigs")
    return (df.withColumn("near_edited", jaccard("sigs", "edited_sigs")).withColumn("near_next", jaccard("sigs", "_next_sigs"))
            .drop("_bucket", "_key", "_ghost", "_next", "_next_sigs"))
