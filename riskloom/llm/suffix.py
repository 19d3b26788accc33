"""Suffix-array deduplication with longest-previous-factor arrays.

Every ``depth``-byte window of a text is given to one anchor, the window's
``GRAM``-byte string of the smallest hash: equal windows pick equal anchors.  A
text becomes runs of windows with one anchor, and only runs whose anchor is found
elsewhere are looked at further.  Equal runs settle each other.  Of the rest, the
distinct runs of an anchor meet in one task: their windows are put in suffix
order, and previous and next smaller text positions in that order give the longest
earlier match of each window (its longest previous factor); one of ``depth`` bytes
marks a later copy, a window matched only by later ones is a first copy.  Anchors
with over ``RUNS`` distinct runs are settled by grouping window digests instead, so
that no task holds more than that.

Texts are UTF-8 bytes and a match never crosses a text.  Windows are judged on the
input.  ``keep="none"`` removes every copy, ``keep="first"`` keeps the one of the
smallest (id, position).  Nulls: a null text is the empty text; null ids come first.
Repeated rows are copies of each other (with ``keep="first"``, rows equal in id and text
are one place, kept or cut alike).  Texts shorter than ``depth`` lose nothing.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import long_text_batches, release_memory, written

DEPTH = 200
GRAM = 32
RUNS = 1000
PIECE = 1 << 17
BUNDLE = 30_000
BITS = 1 << 24
_PLACE = np.uint64(20)
_RUNS = "k bigint, row bigint, h bigint, c bigint, lo int, hi int"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(1, 2 ** 63, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Runs of a byte string's windows: (anchor hash, first window, last window)."""

    def __init__(self, depth: int = DEPTH, gram: int = GRAM):
        self.depth, self.gram, self.w = depth, gram, depth - gram + 1
        self.up = self.down = np.ones(1, np.uint64)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """Hash of the gram at each position."""
        if len(self.up) < len(data) + 1:
            n = max(len(data) + 1, 1 << 14)
            self.up = _powers(int(_BASE), n)
            self.down = _powers(pow(int(_BASE), -1, 1 << 64), n)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.up[:len(data)], out=total[1:])
        n = len(data) - self.gram + 1
        h = (total[self.gram:] - total[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def piece(self, data: np.ndarray):
        h = self.grams(data)
        n, w = len(h), self.w
        key = (h >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64)      # the leftmost wins a tie
        rows = -(-n // w)
        full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        full[:n] = key
        before = np.minimum.accumulate(full.reshape(rows, w), axis=1).ravel()
        after = np.minimum.accumulate(full.reshape(rows, w)[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:n - w + 1], before[w - 1:n])
        at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hi = np.append(lo[1:], len(at)) - 1
        return h[at[lo]].view(np.int64), lo, hi

    def runs(self, data: bytes):
        buf = np.frombuffer(data, np.uint8)
        parts = [(*self.piece(buf[at:at + PIECE + self.depth - 1]), at)
                 for at in range(0, len(buf) - self.depth + 1, PIECE)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + p[3] for p in parts]),
                np.concatenate([p[2] + p[3] for p in parts]))


def window_runs(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``k, row, h, c, lo, hi``: the runs of every text of ``docs(k, row, text)``; ``h`` hashes the anchor, ``c`` the run's bytes."""
    def run(batches):
        anchors = Anchors(depth)
        for pdf in batches:
            cols = [[] for _ in range(6)]
            for k, row, text in zip(pdf["k"], pdf["row"], pdf["text"]):
                data = text.encode()
                if len(data) < depth:
                    continue
                h, lo, hi = anchors.runs(data)
                c = [xxhash.xxh3_64_intdigest(data[a:b + depth]) for a, b in zip(lo.tolist(), hi.tolist())]
                for out, v in zip(cols, (np.full(len(h), k, np.int64), np.full(len(h), row, np.int64), h,
                                         np.array(c, np.uint64).view(np.int64), lo.astype(np.int32), hi.astype(np.int32))):
                    out.append(v)
            if cols[0]:
                yield pd.DataFrame({n: np.concatenate(v) for n, v in zip(("k", "row", "h", "c", "lo", "hi"), cols)})
        release_memory()

    return docs.select("k", "row", "text").mapInPandas(run, _RUNS)


def _smaller(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the common prefix with the nearest earlier
    place whose text position is smaller, by pointer jumping; ``lcp[i]`` is shared by
    places ``i - 1`` and ``i``."""
    n = len(pos)
    to = np.arange(-1, n - 1)
    shared = lcp.copy()
    todo = np.flatnonzero((to >= 0) & (pos[np.maximum(to, 0)] > pos))
    while len(todo):
        via = to[todo]
        shared[todo] = np.minimum(shared[todo], shared[via])
        to[todo] = to[via]
        left = to[todo]
        todo = todo[(left >= 0) & (pos[np.maximum(left, 0)] > pos[todo])]
    return np.where(to >= 0, shared, 0)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the ``depth``-byte windows at ``starts`` (ascending): the longest common
    prefix with an earlier window, and with any other one."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    win = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, depth)[starts])
    order = np.argsort(win.view(f"S{depth}").ravel(), kind="stable")
    differ = win[order[1:]] != win[order[:-1]]
    lcp = np.zeros(len(starts) + 1, np.int64)
    lcp[1:-1] = np.where(differ.any(1), differ.argmax(1), depth)
    pos = order                                                     # places in ``starts`` order as text positions
    before = _smaller(pos, lcp[:-1])
    behind = _smaller(pos[::-1], lcp[1:][::-1])[::-1]
    earlier, other = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    earlier[order] = np.maximum(before, behind)
    other[order] = np.maximum(lcp[:-1], lcp[1:])
    return earlier, other


def _intervals(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


_SPANS = "array<struct<a:int,b:int>>"
_SETTLED = f"h bigint, c bigint, earlier {_SPANS}, other {_SPANS}"


def settle(runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """For distinct runs ``h, c, k, row, lo, data``: the windows (intervals of
    offsets) that an earlier run, and that any other run, of the same anchor has."""
    def bundle(pdf):
        pdf = pdf.sort_values(["k", "row", "lo"], kind="stable")
        sizes = pdf["data"].map(len).to_numpy(np.int64)
        ends = np.cumsum(sizes)
        counts = sizes - depth + 1
        first = np.cumsum(counts) - counts
        starts = np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(ends - sizes, counts)
        earlier, other = longest_previous_factors(np.frombuffer(b"".join(pdf["data"]), np.uint8), starts, depth)
        rows = [(h, c, _intervals(earlier[f:f + n] >= depth), _intervals(other[f:f + n] >= depth))
                for h, c, f, n in zip(pdf["h"], pdf["c"], first, counts)]
        return pd.DataFrame(rows, columns=["h", "c", "earlier", "other"])

    def run(batches):
        held, n = [], 0
        for pdf in batches:                 # ordered by anchor; a bundle ends where an anchor does
            edges = np.flatnonzero(np.concatenate([[True], pdf["h"].to_numpy()[1:] != pdf["h"].to_numpy()[:-1]])) if len(pdf) else []
            for i, a in enumerate(edges):
                part = pdf.iloc[a:edges[i + 1] if i + 1 < len(edges) else len(pdf)]
                if n >= BUNDLE and held[-1]["h"].iloc[-1] != part["h"].iloc[0]:
                    yield bundle(pd.concat(held))
                    held, n = [], 0
                held.append(part)
                n += int(part["data"].map(len).sum()) - len(part) * (depth - 1)
        if held:
            yield bundle(pd.concat(held))
        del held
        release_memory()

    return runs.repartition("h").sortWithinPartitions("h").mapInPandas(run, _SETTLED)


def settle_by_digest(runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """As ``settle``, for anchors with many distinct runs: windows grouped by a 128-bit digest over all workers."""
    def digests(batches):
        for pdf in batches:
            rows = [(h, c, k, row, lo, off, d[:8], d[8:]) for h, c, k, row, lo, data in
                    zip(pdf["h"], pdf["c"], pdf["k"], pdf["row"], pdf["lo"], pdf["data"])
                    for off in range(len(data) - depth + 1) for d in [xxhash.xxh3_128_digest(data[off:off + depth])]]
            out = pd.DataFrame(rows, columns=["h", "c", "k", "row", "lo", "off", "d", "e"])
            for x in ("d", "e"):
                out[x] = np.frombuffer(b"".join(out[x]), np.int64)
            yield out

    wins = written(runs.mapInPandas(digests, "h bigint, c bigint, k bigint, row bigint, lo int, off int, d bigint, e bigint"), "windows")
    place = F.struct("k", "row", (F.col("lo") + F.col("off")).alias("at"))
    firsts = written(wins.groupBy("d", "e").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "firsts")
    hits = wins.withColumn("place", place).join(firsts, ["d", "e"]).groupBy("h", "c").agg(
        F.sort_array(F.collect_list("off")).alias("other"),
        F.sort_array(F.collect_list(F.when(F.col("place") != F.col("first"), F.col("off")))).alias("earlier"))
    each = lambda c: F.transform(c, lambda o: F.struct(o.alias("a"), o.alias("b")))
    return hits.select("h", "c", each("earlier").alias("earlier"), each("other").alias("other"))


def key_bit(k: str = "k", row: str = "row") -> Column:
    return F.pmod(F.xxhash64(k, row), F.lit(BITS))


def maybe_in(rows: DataFrame, keys: DataFrame, k: str = "k", row: str = "row") -> DataFrame:
    """``rows`` with ``_maybe``: true for every row of ``keys(k, row)`` and seldom for others,
    by one bit for each hashed key, ``BITS`` bits whatever the input's size."""
    parts = (keys.select(key_bit().alias("bit")).groupBy(F.shiftright("bit", 15).alias("_word"))
             .agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("_bits")))
    place = F.col("_bit").bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1
    return (rows.withColumn("_bit", key_bit(k, row)).withColumn("_word", F.shiftright("_bit", 15))
            .join(F.broadcast(parts), "_word", "left")
            .select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(hit, F.lit(False)).alias("_maybe")))


def removed_spans(docs: DataFrame, keep: str = "none", depth: int = DEPTH, runs_limit: int = RUNS) -> DataFrame:
    """``k, row, cuts``: for texts of ``docs(k, row, text)`` that lose bytes, the
    maximal removed runs as (start, end) byte positions, ends exclusive."""
    long_text_batches(docs.sparkSession)
    every = written(window_runs(docs, depth), "runs")
    # tables of their own on the right of the joins below, so that a hot key's rows can be split over tasks
    shared = written(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared")
    every = written(every.join(shared, "h"), "shared-runs")
    distinct = written(every.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k", "row", "lo", "hi")).alias("rep"))
                       .select("h", "c", "n", "rep.*"), "distinct-runs")
    groups = distinct.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    mixed = written(distinct.join(groups, "h"), "mixed-runs")
    wanted = mixed.groupBy("k", "row").agg(F.collect_list(F.struct("h", "c", "m", "lo", "hi")).alias("runs"))

    def cut_out(batches):
        for pdf in batches:
            rows = [(r["h"], r["c"], r["m"], k, row, r["lo"], data[r["lo"]:r["hi"] + depth])
                    for k, row, text, runs in zip(pdf["k"], pdf["row"], pdf["text"], pdf["runs"])
                    for data in [text.encode()] for r in runs]
            yield pd.DataFrame(rows, columns=["h", "c", "m", "k", "row", "lo", "data"])
        release_memory()

    some = maybe_in(docs.select("k", "row", "text"), mixed).filter("_maybe").drop("_maybe")
    data = (some.join(wanted, ["k", "row"]).mapInPandas(
        cut_out, "h bigint, c bigint, m bigint, k bigint, row bigint, lo int, data binary").dropDuplicates(["h", "c"]))
    data = written(data, "run-bytes")
    settled = settle(data.filter(F.col("m") <= runs_limit), depth)
    if not data.filter(F.col("m") > runs_limit).isEmpty():
        settled = settled.union(settle_by_digest(data.filter(F.col("m") > runs_limit), depth))
    settled = written(settled, "settled")
    known = written(distinct.join(settled, ["h", "c"], "left").select(
        "h", "c", "n", F.col("k").alias("k0"), F.col("row").alias("row0"), F.col("lo").alias("lo0"), "earlier", "other"), "known")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("hi") - F.col("lo")).alias("b")))
    if keep == "none":
        windows = F.when(F.col("n") > 1, whole).otherwise(F.col("other"))
    else:
        first = (F.col("k") == F.col("k0")) & (F.col("row") == F.col("row0")) & (F.col("lo") == F.col("lo0"))
        windows = F.when(first, F.col("earlier")).otherwise(whole)
    # a run's spans stay one array: copies of a passage in many texts make no further rows
    spans = F.transform(windows, lambda w: F.struct((F.col("lo") + w["a"]).alias("at"), (F.col("lo") + w["b"] + depth).alias("end")))
    hits = every.join(known, ["h", "c"]).select("k", "row", spans.alias("s")).filter(F.size("s") > 0)

    def merge(acc, s):
        joins = (F.size(acc) > 0) & (s["at"] <= F.element_at(acc, -1)["end"])
        last = F.element_at(acc, -1)
        grown = F.struct(last["at"].alias("at"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(F.array_sort(F.flatten("s")), F.array().cast("array<struct<at:int,end:int>>"),
                         lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(merge(acc, s)))
    return written(hits.groupBy("k", "row").agg(F.collect_set("s").alias("s")).select("k", "row", merged.alias("cuts")), "cuts")


def with_cuts(docs: DataFrame, keep: str = "none", depth: int = DEPTH, runs_limit: int = RUNS) -> DataFrame:
    """``docs`` with ``_cuts``, the removed byte spans of its text (null where nothing goes).
    Only texts that may lose bytes are shuffled."""
    own = docs.columns
    plain = F.coalesce("text", F.lit(""))
    keyed = (docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))).withColumn("_row", F.xxhash64("doc_id", plain)))
    slim = keyed.select(F.col("_k").alias("k"), F.col("_row").alias("row"), plain.alias("text"))
    cuts = removed_spans(slim, keep, depth, runs_limit).select(F.col("k").alias("_k"), F.col("row").alias("_row"), F.col("cuts").alias("_cuts"))
    tested = maybe_in(keyed, cuts.select(F.col("_k").alias("k"), F.col("_row").alias("row")), "_k", "_row")
    touched = tested.filter("_maybe").join(cuts, ["_k", "_row"], "left")
    untouched = tested.filter("not _maybe").withColumn("_cuts", F.lit(None).cast("array<struct<at:int,end:int>>"))
    names = [F.col(f"`{c}`") for c in own]
    return touched.select(*names, "_cuts").union(untouched.select(*names, "_cuts"))


def kept_bytes(text: str = "text", cuts: str = "_cuts") -> Column:
    """The bytes that stay, concatenated."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    first = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("out"))
    cut = F.aggregate(cuts, first, lambda acc, s: F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(data, acc["at"] + 1, s["at"] - acc["at"])).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(data, acc["at"] + 1, F.octet_length(data))))
    return F.when(F.col(cuts).isNull(), data).otherwise(cut)


def kept_characters(text: str = "text", cuts: str = "_cuts") -> Column:
    """The text without its cuts, spans shrunk to whole characters."""
    spans = F.col(cuts)

    def shrink(data, at, step):
        """``at`` moved by ``step`` over the rest of a character (up to three bytes)."""
        inside, moved = F.lit(True), F.lit(0)
        for i in range(3):
            inside = inside & F.substring(data, at + i * step + 1, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
            moved = moved + F.when(inside, step).otherwise(0)
        return at + moved

    def piece(data, i):
        start = F.when(i == 0, 0).otherwise(shrink(data, F.get(spans, i - 1)["end"], -1))
        end = F.when(i == F.size(spans), F.octet_length(data)).otherwise(shrink(data, F.get(spans, i)["at"], 1))
        return F.substring(data, start + 1, end - start).cast("string")

    # the bytes as a lambda's variable: taken from the row once, not once a span
    whole = F.transform(F.array(F.col(text).cast("binary")), lambda data: F.array_join(
        F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: piece(data, i)), ""))
    return F.get(whole, F.lit(0))


def cut_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` without later copies of repeated passages, first copies kept: spans
    shrink to whole characters, ``n_chars`` follows, texts that lose all go."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "doc_id", "text")
    marked = with_cuts(own, "first", depth)
    same = marked.filter("_cuts is null").select("own.*")
    less = marked.filter("_cuts is not null").withColumn("_left", kept_characters()).filter("_left <> ''")
    changed = {"text": F.col("_left"), "n_chars": F.char_length("_left").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return same.union(less.select(*[changed.get(c, F.col("own").getField(c)).alias(c) for c in docs.columns]))
