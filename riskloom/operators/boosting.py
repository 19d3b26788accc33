"""The fit of MLlib's boosted trees over blocks of binned rows.

The trees are those of ``GBTClassifier`` for the same settings and partitions of the
input: candidate thresholds from the weighted sample, rows left out per tree, features
drawn per node, the variance gain and the order among equal gains follow MLlib, random
numbers included.  What differs is how sums are taken.  Rows are binned once (a byte a
value) and kept in blocks; a level's sums are counted column by column, a pair of sibling
nodes by the rows of the smaller one and its parent, and a tree that is done is added to
the margins held beside the rows.  (Sums of float values in another order may decide
otherwise between splits that are equal up to rounding.)

* :func:`fit` grows one model: on the driver's tasks level by level, or, for up to
  ``LOCAL_ROWS`` rows, in one task.  A node's sums are added up on the driver while those
  of a level are at most ``SENT`` bytes, by a shuffle beyond that.
* :func:`fit_many` grows several models of one table: each in a task of its own where the
  binned table is at most ``SHARED`` bytes, else one after the other.

Margins are not checkpointed: every ``RESTART`` trees they are taken anew from the rows
and the trees so far, which bounds the lineage.
"""

from __future__ import annotations

import functools
import json
import math
import random
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import scratch_path

ROWS = 65_536               # of a block
LOCAL_ROWS = 200_000
SHARED = 48_000_000
SENT = 64_000_000
RESTART = 50
EPSILON = 2.0 ** -52
TIE = 1e-12                 # of a node's mean square
_LOW = (1 << 64) - 1


# ---- random numbers of the JVM ------------------------------------------------------------
def _murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 (32 bits) of whole 4-byte words."""
    rot = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    h = seed & 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h = (rot(h ^ rot(k, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def xor_seed(seed: int) -> int:
    """The first state of Spark's XORShiftRandom."""
    data = (seed & _LOW).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _step(s: int) -> int:
    s ^= s << 21 & _LOW
    s ^= s >> 35
    return s ^ (s << 4 & _LOW)


def xor_int(seed: int) -> int:
    """The first ``nextInt`` of XORShiftRandom(seed)."""
    v = _step(xor_seed(seed)) & 0xFFFFFFFF
    return v - (1 << 32) if v >> 31 else v


@functools.cache
def _jump(power: int) -> tuple:
    """2^power steps (they are linear over bits): the images of single bits, and a table by byte."""
    if power == 0:
        bits = [_step(1 << i) for i in range(64)]
    else:
        half = _jump(power - 1)[0]
        bits = [_jumped(half, b) for b in half]
    table = np.zeros((8, 256), np.uint64)
    for byte in range(8):
        for v in range(256):
            table[byte, v] = _jumped(bits[8 * byte:8 * byte + 8], v)
    return bits, table


def _jumped(bits: list, s: int) -> int:
    out, i = 0, 0
    while s:
        if s & 1:
            out ^= bits[i]
        s >>= 1
        i += 1
    return out


def uniforms(seed: int, first: int, n: int) -> np.ndarray:
    """``nextDouble`` number ``first .. first + n`` of XORShiftRandom(seed)."""
    s, skip, power = xor_seed(seed), 2 * first, 0
    while skip:
        if skip & 1:
            s = _jumped(_jump(power)[0], s)
        skip, power = skip >> 1, power + 1
    states = np.empty(max(2 * n, 1), np.uint64)
    states[0], had, power = _step(s), 1, 0
    while had < 2 * n:
        more = min(had, 2 * n - had)
        old = states[:more].view(np.uint8).reshape(more, 8)     # little endian
        table = _jump(power)[1]
        new = table[0].take(old[:, 0])
        for byte in range(1, 8):
            new ^= table[byte].take(old[:, byte])
        states[had:had + more] = new
        had, power = had + more, power + 1
    states = states[:2 * n]
    high, low = states[0::2] & np.uint64((1 << 26) - 1), states[1::2] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(np.float64) * 2.0 ** -53


class JavaRandom:
    """java.util.Random, as far as ``nextLong``."""

    def __init__(self, seed: int):
        self.s = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next(self) -> int:
        self.s = (self.s * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        v = self.s >> 16
        return v - (1 << 32) if v >> 31 else v

    def long(self) -> int:
        return ((self._next() << 32) + self._next()) & _LOW


def reservoir(n: int, k: int, seed: int) -> list[int]:
    """``k`` of ``range(n)``, in the order of SamplingUtils.reservoirSampleAndCount."""
    out, s = list(range(k)), xor_seed(seed)
    for i in range(k, n):
        high = s = _step(s)
        s = _step(s)
        at = int((((high & (1 << 26) - 1) << 27) + (s & (1 << 27) - 1)) * 2.0 ** -53 * (i + 1))
        if at < k:
            out[at] = i
    return out


# ---- one model's state ---------------------------------------------------------------------
@dataclass
class Settings:
    """What of ``GBTClassifier``'s parameters a fit goes by."""
    rounds: int
    depth: int
    step: float
    rate: float
    per_node: int
    min_rows: int
    min_gain: float
    seed: int


def settings_of(stage, n_features: int) -> Settings:
    get = lambda name: stage.getOrDefault(name)
    share = get("featureSubsetStrategy")
    return Settings(get("maxIter"), get("maxDepth"), get("stepSize"), get("subsamplingRate"), math.ceil(float(share) * n_features),
                    get("minInstancesPerNode"), get("minInfoGain"), get("seed"))


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf points at itself.  A feature is its place
    among the columns that have a threshold: the others are not held."""
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)         # bins up to it go left
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    stats: list = field(default_factory=list)       # weight, sum, sum of squares, rows
    impurity: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, stats, impurity) -> int:
        i = len(self.feature)
        for name, v in (("feature", -1), ("cut", 0), ("left", i), ("right", i), ("stats", stats), ("impurity", impurity), ("gain", -1.0)):
            getattr(self, name).append(v)
        return i

    def value(self, i: int) -> float:
        w, s = self.stats[i][:2]
        return s / w if w else 0.0

    def arrays(self) -> tuple:
        """For :func:`walked`: feature, cut, children, predictions, depth."""
        depth = [0] * len(self.feature)
        for i, f in enumerate(self.feature):
            if f >= 0:
                depth[self.left[i]] = depth[self.right[i]] = depth[i] + 1
        return (np.maximum(np.array(self.feature), 0), 2 * np.array(self.cut, np.uint8), np.array([self.right, self.left]).T.ravel(),
                np.array([self.value(i) for i in range(len(self.feature))]), max(depth, default=0))


def walked(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The node every row ends at."""
    feature, cut, children, _, depth = tree
    n = bins.shape[1]
    at, rows, flat = np.zeros(n, np.intp), np.arange(n), bins.ravel()
    for _ in range(depth):
        left = flat.take(feature.take(at) * n + rows) <= cut.take(at)
        at = children.take(2 * at + left)
    return at


def _variance(w: float, s: float, q: float) -> float:
    return (q - s * s / w) / w if w else 0.0


class Growing:
    """A tree in the making: the nodes that are open at its present level and their features."""

    def __init__(self, st: Settings, splits: np.ndarray, number: int):
        self.st, self.splits, self.tree, self.level = st, splits, Tree(), 0
        self.column = np.cumsum(splits > 0) - 1         # place among the columns that have a threshold
        self.rng = JavaRandom(st.seed + number)
        self.stack = [self.tree.add((0.0, 0.0, 0.0, 0), 0.0)]
        self._open()

    def _open(self):
        n = len(self.splits)
        self.nodes, self.stack = self.stack, []
        if self.st.per_node < n:
            self.features = np.array([reservoir(n, self.st.per_node, self.rng.long()) for _ in self.nodes]).reshape(len(self.nodes), self.st.per_node)
        else:
            self.features = np.tile(np.arange(n), (len(self.nodes), 1))

    def take(self, hist: np.ndarray) -> None:
        """Split the open nodes by ``hist``: rows, weights, sums, sums of squares by (node, feature, bin)."""
        st, tree = self.st, self.tree
        column = np.maximum(self.column[self.features], 0)
        sums = np.cumsum(hist[:3, np.arange(len(self.nodes))[:, None], column], axis=3)     # 3, nodes, features, bins
        raw, w, s = sums[..., :-1]
        all_raw, all_w, all_s = sums[..., -1:]
        ok = np.arange(raw.shape[2]) < self.splits[self.features][..., None]
        ok &= (raw >= st.min_rows) & (all_raw - raw >= st.min_rows)
        right = all_s - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (s * s / w + right * right / (all_w - w) - all_s * all_s / all_w) / all_w       # of the variance
        ok &= gain >= st.min_gain
        gain = np.where(ok, gain, -np.inf).reshape(len(self.nodes), -1)

        def stats(i: int, j: int, bins: int) -> tuple:
            return (float(sums[1, i, j, bins]), float(sums[2, i, j, bins]), float(hist[3, i, column[i, j], :bins + 1].sum()), int(round(sums[0, i, j, bins])))

        if self.level == 0:
            tree.stats[0] = stats(0, 0, raw.shape[2])
            tree.impurity[0] = _variance(*tree.stats[0][:3])
        # gains that differ by rounding are equal, however the sums were taken: the first one counts, none of nothing
        near = TIE * np.array([[tree.stats[i][2] / tree.stats[i][0] if tree.stats[i][0] else 0.0] for i in self.nodes])
        best = (gain >= gain.max(axis=1, keepdims=True) - near).argmax(axis=1)
        stack = []
        for i, (node, b) in enumerate(zip(self.nodes, best.tolist())):
            if not gain[i, b] > near[i, 0]:     # a leaf
                if np.isneginf(gain[i, b]):
                    tree.impurity[node] = -1.0  # no split is allowed
                continue
            j, cut = divmod(b, raw.shape[2])
            tree.feature[node], tree.cut[node], tree.gain[node] = int(column[i, j]), cut, float(gain[i, b])
            left, whole = stats(i, j, cut), stats(i, j, raw.shape[2])
            for side, own in (("left", left), ("right", tuple(x - y for x, y in zip(whole, left)))):
                child = tree.add(own, _variance(*own[:3]))
                getattr(tree, side)[node] = child
                if self.level + 1 < st.depth and abs(tree.impurity[child]) >= EPSILON:
                    stack.insert(0, child)
        self.level += 1
        self.stack = stack
        self._open()


# ---- sums of a block ----------------------------------------------------------------------
def residuals(number: int, margin: np.ndarray, pos: np.ndarray) -> np.ndarray:
    y = 2.0 * pos - 1
    if number == 0:
        return y
    with np.errstate(over="ignore"):
        return 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def histogram(bins: np.ndarray, slot: np.ndarray, pos: np.ndarray, r: np.ndarray, ratio: float, nodes: int, width: int) -> np.ndarray:
    """4 x nodes x features x bins of the rows of ``bins`` (twice the bins' numbers)."""
    size, shape = 2 * nodes * width, (nodes, width, 2)
    out = np.empty((4, nodes, len(bins), width))
    s = np.where(pos, ratio, 1.0) * r
    q = s * r
    base = slot * (2 * width) + pos         # a bin's negatives and positives side by side
    for f, own in enumerate(bins):
        at = base + own
        count, sums, squares = (np.bincount(at, x, size).reshape(shape) for x in (None, s, q))
        out[0, :, f] = count[..., 0] + count[..., 1]
        out[1, :, f] = count[..., 0] + ratio * count[..., 1]
        out[2, :, f] = sums[..., 0] + sums[..., 1]
        out[3, :, f] = squares[..., 0] + squares[..., 1]
    return out


@dataclass
class Block:
    part: int
    first: int                  # of its partition's rows
    bins: np.ndarray            # features x rows, twice the bins' numbers
    pos: np.ndarray
    margin: np.ndarray | None = None


def _drawn(st: Settings, number: int, b: Block) -> np.ndarray | None:
    """The rows that the tree is grown on (None: all)."""
    if st.rate >= 1.0:
        return None
    return np.flatnonzero(uniforms(st.seed + number + b.part + 1, b.first, len(b.pos)) < st.rate)


def _added(margin: np.ndarray, number: int, tree: tuple, bins: np.ndarray, step: float) -> np.ndarray:
    return margin + tree[3].take(walked(tree, bins)) * (step if number else 1.0)


# ---- growing -------------------------------------------------------------------------------
def grown(st: Settings, splits: np.ndarray, width: int, number: int, sums) -> Tree:
    """One tree; ``sums(tree, slot_of, nodes)`` gives the sums of the nodes that have a slot.
    Of two open siblings the smaller one is asked for, the other is what their parent has more."""
    g, kept = Growing(st, splits, number), {}
    while g.nodes:
        tree = g.tree
        parent = {c: i for i, f in enumerate(tree.feature) if f >= 0 for c in (tree.left[i], tree.right[i])}
        place = {node: i for i, node in enumerate(g.nodes)}
        other = {node: tree.left[parent[node]] + tree.right[parent[node]] - node for node in g.nodes if node in parent}
        rows = lambda node: (tree.stats[node][3], node)
        asked = [node for node in g.nodes if other.get(node) not in place or parent[node] not in kept or rows(node) < rows(other[node])]
        slot_of = np.full(len(tree.feature), -1)
        slot_of[asked] = np.arange(len(asked))
        got = sums(tree.arrays(), slot_of, len(asked))
        hist = np.empty((4, len(g.nodes), *got.shape[2:]))
        for i, node in enumerate(asked):
            hist[:, place[node]] = got[:, i]
        for node in set(g.nodes).difference(asked):
            hist[:, place[node]] = kept[parent[node]] - hist[:, place[other[node]]]
        kept = {node: hist[:, i] for i, node in enumerate(g.nodes)} if hist.nbytes <= SENT else {}
        g.take(hist)
    return g.tree


def _block_sums(st: Settings, number: int, b: Block, tree: tuple, slot_of: np.ndarray, nodes: int, width: int, ratio: float) -> np.ndarray:
    slot, act = slot_of.take(walked(tree, b.bins)), _drawn(st, number, b)
    act = np.flatnonzero(slot >= 0) if act is None else act[slot.take(act) >= 0]
    r = residuals(number, b.margin, b.pos).take(act)
    return histogram(b.bins.take(act, axis=1), slot.take(act), b.pos.take(act), r, ratio, nodes, width)


def grown_here(blocks: list[Block], st: Settings, splits: np.ndarray, ratio: float, width: int) -> list[Tree]:
    """All trees in this process."""
    blocks = [Block(b.part, b.first, b.bins, b.pos, np.zeros(len(b.pos))) for b in blocks]
    trees = []
    for number in range(st.rounds):
        trees.append(grown(st, splits, width, number, lambda tree, slot_of, n, number=number: functools.reduce(
            np.add, [_block_sums(st, number, b, tree, slot_of, n, width, ratio) for b in blocks])))
        blocks = list(_advanced(number, trees[-1].arrays(), st.step)(blocks))
    return trees


def _level(st: Settings, number: int, tree: tuple, slot_of: np.ndarray, nodes: int, width: int, ratio: float):
    """A task's sums for the nodes that have a slot."""
    def run(blocks):
        total = None
        for b in blocks:
            own = _block_sums(st, number, b, tree, slot_of, nodes, width, ratio)
            total = own if total is None else total + own
        if total is not None:
            yield total
    return run


def _advanced(number: int, tree: tuple, step: float):
    def run(blocks):
        for b in blocks:
            yield Block(b.part, b.first, b.bins, b.pos, _added(b.margin, number, tree, b.bins, step))
    return run


def _restarted(trees: list[tuple], step: float):
    def run(blocks):
        for b in blocks:
            margin = np.zeros(len(b.pos))
            for number, tree in enumerate(trees):
                margin = _added(margin, number, tree, b.bins, step)
            yield Block(b.part, b.first, b.bins, b.pos, margin)
    return run


def _sums(state, task, nodes: int, parts: int, cells: int) -> np.ndarray:
    """The level's sums over all tasks."""
    if parts * nodes * cells * 32 <= SENT:
        return functools.reduce(np.add, state.mapPartitions(task).collect())
    per_node = state.mapPartitions(lambda it: ((i, h[:, i]) for h in task(it) for i in range(nodes)))
    found = dict(per_node.reduceByKey(np.add, min(nodes, parts)).collect())
    return np.stack([found[i] for i in range(nodes)], axis=1)


def grown_over(blocks, parts: int, st: Settings, splits: np.ndarray, ratio: float, width: int) -> list[Tree]:
    """All trees, level by level over the tasks; ``blocks`` is a cached RDD of :class:`Block`."""
    trees, done, state = [], [], None
    cells = int((splits > 0).sum()) * width
    for number in range(st.rounds):
        old = state
        made = blocks.mapPartitions(_restarted(list(done), st.step)) if number % RESTART == 0 else old.mapPartitions(_advanced(number - 1, done[-1], st.step))
        state = made.persist(StorageLevel.MEMORY_AND_DISK)

        def sums(tree, slot_of, nodes, number=number, state=state):
            return _sums(state, _level(st, number, tree, slot_of, nodes, width, ratio), nodes, parts, cells)

        trees.append(grown(st, splits, width, number, sums))
        done.append(trees[-1].arrays())
        if old is not None:
            old.unpersist()             # the margins after it are there
    if state is not None:
        state.unpersist()
    return trees


# ---- input ---------------------------------------------------------------------------------
def thresholds(values: np.ndarray, weights: np.ndarray, share: float, rows: int, weight: float, bins: int) -> np.ndarray:
    """MLlib's candidate thresholds of a column from its (sampled) rows."""
    some = values != 0
    v, inv = np.unique(values[some], return_inverse=True)
    c = np.bincount(inv, weights[some], len(v))
    zero = share * weight - c.sum()
    if len(v) == 0:
        return np.zeros(0)
    if zero > EPSILON * int(some.sum()) * 100:
        at = int(np.searchsorted(v, 0.0))
        v, c = np.insert(v, at, 0.0), np.insert(c, at, zero)
    middle = (v[:-1] + v[1:]) / 2.0
    if len(v) - 1 <= bins - 1:
        return middle
    stride = share * weight / bins
    out, now, target = [], c[0], stride
    for i in range(1, len(v)):
        before, now = now, now + c[i]
        if abs(before - target) < abs(now - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _sample(rows: DataFrame, share: float, seed: int) -> pd.DataFrame:
    """The rows that MLlib would take: the same positions of the same partitions."""
    if share < 1.0:
        spark = rows.sparkSession
        picked = rows._jdf.toJavaRDD().sample(False, share, seed)
        rows = DataFrame(spark._jsparkSession.createDataFrame(picked, rows._jdf.schema()), spark)
    return rows.toPandas()


def _binned(names: list, label: str, cuts: list):
    def run(frames):
        part, first, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            nonlocal first, held, size
            pdf = pd.concat(held)
            bins = np.empty((len(names), len(pdf)), np.uint8)
            for f, c in enumerate(names):
                bins[f] = 2 * np.searchsorted(cuts[f], pdf[c].to_numpy())
            out = pd.DataFrame({"part": [part], "first": [first], "bins": [bins.tobytes()],
                                "pos": [(pdf[label].to_numpy() == 1).astype(np.uint8).tobytes()]})
            first, held, size = first + len(pdf), [], 0
            return out

        for pdf in frames:
            while len(pdf):
                held.append(pdf[:ROWS - size])
                pdf, size = pdf[ROWS - size:], size + len(held[-1])
                if size == ROWS:
                    yield block()
        if size:
            yield block()
    return run


def _block(row, columns: int) -> Block:
    return Block(row["part"], row["first"], np.frombuffer(row["bins"], np.uint8).reshape(columns, -1), np.frombuffer(row["pos"], np.uint8))


@dataclass
class Table:
    """The binned training rows."""
    blocks: object              # a cached RDD
    cuts: list
    splits: np.ndarray
    width: int
    rows: int
    parts: int
    ratio: float


def table(train: DataFrame, features, label: str, ratio: float, bins: int, seed: int) -> Table | None:
    """None where the rows are not for this fit: values that are NULL or NaN, or other labels than 0 and 1."""
    names = list(features)
    rows = train.select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(names)], F.col(f"`{label}`").cast("double").alias("y"))
    cols = [f"f{i}" for i in range(len(names))]
    hole = functools.reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in cols], F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0))
    n, pos, holes = rows.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 1), F.count_if(hole)).first()
    if not n or holes or not names:
        return None
    bins = min(bins, n)
    weight = (n - pos) + ratio * pos
    need = max(bins * bins, 10_000)
    share = need / n if need < n else 1.0
    pdf = _sample(rows, share, xor_int(seed))
    w = np.where(pdf["y"].to_numpy() == 1, ratio, 1.0)
    cuts = [thresholds(pdf[c].to_numpy(), w, share, n, weight, bins) for c in cols]
    held = [i for i, c in enumerate(cuts) if len(c)]
    if not held or max(map(len, cuts)) > 126:
        return None
    out = rows.select(*[cols[i] for i in held], "y").mapInPandas(_binned([cols[i] for i in held], "y", [cuts[i] for i in held]), "part int, first long, bins binary, pos binary")
    columns = len(held)
    blocks = out.rdd.map(lambda r: _block(r, columns)).persist(StorageLevel.MEMORY_AND_DISK)
    return Table(blocks, cuts, np.array([len(c) for c in cuts]), max(map(len, cuts)) + 1, n, blocks.getNumPartitions(), ratio)


# ---- the stored model ----------------------------------------------------------------------
def _nodes(tree: Tree, cuts: list, held: list) -> list[tuple]:
    """Rows of MLlib's node format, in preorder; leaves of one parent with equal predictions are joined."""
    leaf = [f < 0 for f in tree.feature]
    for i in reversed(range(len(tree.feature))):
        a, b = tree.left[i], tree.right[i]
        if not leaf[i] and leaf[a] and leaf[b] and tree.value(a) == tree.value(b):
            leaf[i] = True
    out: list = []

    def visit(i: int) -> int:
        at = len(out)
        w, s, q, raw = tree.stats[i]
        imp = tree.impurity[i]
        if leaf[i]:
            value = tree.value(tree.left[i]) if tree.feature[i] >= 0 else tree.value(i)
            out.append((at, value, imp, [w, s, q], raw, -1.0, -1, -1, (-1, [], -1)))
            return at
        out.append(None)
        left, right = visit(tree.left[i]), visit(tree.right[i])
        feature = held[tree.feature[i]]
        threshold = float(cuts[feature][tree.cut[i]])
        out[at] = (at, tree.value(i), imp, [w, s, q], raw, tree.gain[i], left, right, (feature, [threshold], -1))
        return at

    visit(0)
    return out


_NODE = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
         "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


def _meta(cls: str, uid: str, version: str, params: dict, defaults: dict, **more) -> str:
    return json.dumps({"class": cls, "timestamp": int(time.time() * 1000), "sparkVersion": version, "uid": uid, "paramMap": params, "defaultParamMap": defaults, **more})


def model(spark, stage, trees: list[Tree], cuts: list) -> GBTClassificationModel:
    """The trees as the model that ``stage`` would have fitted, stored in MLlib's format and loaded."""
    plain = lambda m: {p.name: v for p, v in m.items()}
    params, defaults = plain(stage._paramMap), plain(stage._defaultParamMap)
    own = {k: v for k, v in params.items() if k in ("featuresCol", "labelCol", "maxDepth", "minInstancesPerNode", "minInfoGain", "seed", "weightCol")}
    own_defaults = {k: v for k, v in defaults.items() if k not in ("featureSubsetStrategy", "lossType", "maxIter", "probabilityCol", "rawPredictionCol", "stepSize", "subsamplingRate", "validationTol")}
    path = scratch_path(spark, f"trees-{uuid.uuid4().hex}")
    version = spark.version
    meta = _meta("org.apache.spark.ml.classification.GBTClassificationModel", stage.uid, version, params, defaults, numFeatures=len(cuts), numTrees=len(trees))
    tree_meta = [(i, _meta("org.apache.spark.ml.regression.DecisionTreeRegressionModel", f"dtr_{random.randrange(1 << 48):012x}", version, own, own_defaults),
                  stage.getOrDefault("stepSize") if i else 1.0) for i in range(len(trees))]
    held = [i for i, c in enumerate(cuts) if len(c)]
    nodes = [(i, n) for i, t in enumerate(trees) for n in _nodes(t, cuts, held)]
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(tree_meta, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, _NODE).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


# ---- fits ------------------------------------------------------------------------------------
def _grown_here(t: Table, settings: list[Settings]) -> list[list[Tree]]:
    """Every model in a task of its own, over a copy of the binned table."""
    sc = t.blocks.context
    blocks = sc.broadcast(t.blocks.collect())
    splits, ratio, width = t.splits, t.ratio, t.width

    def run(of):
        return [(i, grown_here(blocks.value, st, splits, ratio, width)) for i, st in of]

    order = sorted(enumerate(settings), key=lambda x: -x[1].rounds * x[1].depth)        # the longest ones first
    found = dict(sc.parallelize(order, len(order)).mapPartitions(run).collect())
    blocks.destroy()
    return [found[i] for i in range(len(settings))]


@dataclass
class Fitted:
    """Grown trees with the thresholds of their columns."""
    trees: list
    cuts: list
    step: float

    def nodes(self) -> int:
        """How many nodes the stored model has."""
        held = [i for i, c in enumerate(self.cuts) if len(c)]
        return sum(len(_nodes(t, self.cuts, held)) for t in self.trees)


def grown_many(train: DataFrame, features, label: str, ratio: float, stages: list) -> list[Fitted] | None:
    """What each of ``stages`` (``GBTClassifier`` of one seed) fits; None: not for this fit."""
    names = list(features)
    t = table(train, names, label, ratio, stages[0].getOrDefault("maxBins"), stages[0].getOrDefault("seed"))
    if t is None:
        return None
    settings = [settings_of(s, len(names)) for s in stages]
    if t.rows <= LOCAL_ROWS or (len(settings) > 1 and t.rows * len(names) <= SHARED):
        trees = _grown_here(t, settings)
    else:
        trees = [grown_over(t.blocks, t.parts, st, t.splits, ratio, t.width) for st in settings]
    t.blocks.unpersist()
    return [Fitted(own, t.cuts, st.step) for own, st in zip(trees, settings)]


def with_score(df: DataFrame, features, fitted: Fitted, keep, out: str = "raw_score") -> DataFrame:
    """``keep`` columns and the probability that the stored model gives (rows without holes)."""
    names = [c for c, cut in zip(features, fitted.cuts) if len(cut)]
    cuts = [cut for cut in fitted.cuts if len(cut)]
    trees, step = [t.arrays() for t in fitted.trees], fitted.step

    def run(frames):
        for pdf in frames:
            bins = np.empty((len(names), len(pdf)), np.uint8)
            for f, c in enumerate(names):
                bins[f] = 2 * np.searchsorted(cuts[f], pdf[c].to_numpy(float))
            margin = np.zeros(len(pdf))
            for number, tree in enumerate(trees):
                margin = _added(margin, number, tree, bins, step)
            yield pdf[list(keep)].assign(**{out: 1.0 / (1.0 + np.exp(-2.0 * margin))})

    return df.select(*dict.fromkeys([*keep, *names])).mapInPandas(run, df.select(*keep).schema.add(out, "double"))


def fit_many(train: DataFrame, features, label: str, ratio: float, pipelines: list) -> list[PipelineModel] | None:
    """The models of ``pipelines`` (assembler and ``GBTClassifier`` of one seed); None: not for this fit."""
    stages = [p.getStages()[-1] for p in pipelines]
    found = grown_many(train, features, label, ratio, stages)
    return found and [PipelineModel([p.getStages()[0], model(train.sparkSession, s, f.trees, f.cuts)]) for p, s, f in zip(pipelines, stages, found)]
