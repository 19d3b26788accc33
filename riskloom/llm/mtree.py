"""Exact top-k search by inner product over M-trees.

Inner product becomes a metric by one more coordinate, ``sqrt(M - |x|^2)`` for a
row and 0 for a query (``M``: largest squared length of a row): the distance then
is ``sqrt(|q|^2 + M - 2 q.x)``, smallest where the product is largest.  Rows are
dealt by hash into parts of bounded size and every part is bulk-loaded as a paged
M-tree: routing nodes with covering radius, leaf pages with covering radius and
distance to their node, entries with distance to their page's routing object.  A
block of queries walks a part's pages best first (smallest lower bound next);
triangle inequality over the stored distances skips nodes, pages and entries, and
products are exact integers.  The best of all parts are merged.

Every row meets every block of queries, in tasks of at most a part and a block,
so no task grows with the input.  Rows with a null id or vector, or a null or
non-finite component, take no part; shorter vectors count as ending in zeros.
Rows of the query's own id are not its neighbours; repeated rows of other ids are
each reported.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import written

TOP = 20
PART_ROWS = 16_384
BLOCK_ROWS = 2_048
PAGE_ROWS = 128
SLACK = 1e-7
PAGES = "part int, node int, node_at binary, node_radius double, at binary, radius double, parent double, ids binary, rows binary, far binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``id, v``: components as ``floor(scale * x)``; rows that take no part are left out."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(~bad)
            .select(F.col(id_col).cast("bigint").alias("id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("v")))


def _matrix(vs, dims: int) -> np.ndarray:
    out = np.zeros((len(vs), dims), np.int64)
    for i, v in enumerate(vs):
        out[i, :len(v)] = v
    return out


def _distances(a: np.ndarray, lift_a: np.ndarray, b: np.ndarray, lift_b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T) + (lift_a[:, None] - lift_b[None]) ** 2
    return np.sqrt(np.maximum(sq, 0))


def load_pages(ids: np.ndarray, rows: np.ndarray, most: float, page_rows: int = PAGE_ROWS):
    """Bulk load: nearest of about one routing object a page's rows, then pages of neighbours by distance to it."""
    x = rows.astype(float)
    lift = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
    rng = np.random.default_rng(len(ids))
    _, distinct = np.unique(rows, axis=0, return_index=True)
    pivots = rng.permutation(np.sort(distinct))[:max(1, -(-len(ids) // (4 * page_rows)))]
    d = _distances(x, lift, x[pivots], lift[pivots])
    home = d.argmin(1)
    for node, p in enumerate(pivots):
        own = np.flatnonzero(home == node)
        if not len(own):
            continue
        to = d[own, node]
        own = own[np.argsort(to, kind="stable")]
        for at in range(0, len(own), page_rows):
            page = own[at:at + page_rows]
            mid = page[len(page) // 2]
            far = _distances(x[page], lift[page], x[[mid]], lift[[mid]])[:, 0]
            route = lambda i: np.append(x[i], lift[i]).tobytes()
            yield (node, route(p), float(to.max()), route(mid), float(far.max()), float(d[mid, node]),
                   ids[page].tobytes(), rows[page].tobytes(), far.tobytes())


def best_first(queries: np.ndarray, qids: np.ndarray, pages: pd.DataFrame, most: float, k: int = TOP):
    """Top ``k`` (ids, scores; -1 for none) of every query over a part's pages."""
    dims, n = queries.shape[1], len(queries)
    q = queries.astype(float)
    lift0 = np.zeros(n)
    sq = (q * q).sum(1)
    routes = lambda col: np.array([np.frombuffer(b, float) for b in pages[col]])
    node_at, at = routes("node_at"), routes("at")
    node_radius, radius, parent = (pages[c].to_numpy(float) for c in ("node_radius", "radius", "parent"))
    to_node = _distances(q, lift0, node_at[:, :dims], node_at[:, dims])
    low = np.maximum(to_node - node_radius, np.abs(to_node - parent) - radius)    # bounds from stored distances alone
    low = np.maximum(low, 0)
    entries = [(np.frombuffer(i, np.int64), np.frombuffer(r, np.int64).reshape(-1, dims), np.frombuffer(f, float))
               for i, r, f in zip(pages["ids"], pages["rows"], pages["far"])]
    big = max([1.0, np.abs(q).max(initial=0)]) * max([1.0, *(np.abs(e[1]).max(initial=0) for e in entries)]) * dims >= 2 ** 52
    size = most + np.abs(sq)

    def reach(bound, rows_):        # largest score possible at a distance of at least ``bound``
        return (size[rows_] - bound * bound) / 2 + SLACK * (1 + size[rows_])

    ids = np.full((n, k), -1, np.int64)
    none = np.iinfo(np.int64).min
    top = np.full((n, k), none, np.int64)
    order = np.argsort(low, axis=1, kind="stable")
    alive = np.arange(n)
    for step in range(len(pages)):
        page_of = order[alive, step]
        kth = top[alive, -1]
        go = (kth == none) | (reach(low[alive, page_of], alive) >= kth)
        alive, page_of = alive[go], page_of[go]        # later pages are no nearer, so the others are done
        if not len(alive):
            break
        for page in np.unique(page_of):
            who = alive[page_of == page]
            d = _distances(q[who], lift0[who], at[[page], :dims], at[[page], dims])[:, 0]
            kth = top[who, -1]
            go = (kth == none) | (reach(np.maximum(d - radius[page], 0), who) >= kth)
            who, d, kth = who[go], d[go], kth[go]
            if not len(who):
                continue
            eid, rows, far = entries[page]
            near = (kth[:, None] == none) | (reach(np.abs(d[:, None] - far[None]).T, who).T >= kth[:, None])
            use = near.any(0)
            if not use.any():
                continue
            cand = queries[who] @ rows[use].T if big else (q[who] @ rows[use].T.astype(float)).astype(np.int64)
            mine = eid[use][None] == qids[who][:, None]
            better = ((cand >= kth[:, None]) & ~mine).any(1)
            if not better.any():
                continue
            who, cand, mine = who[better], cand[better], mine[better]
            s = np.concatenate([top[who], np.where(mine, none, cand)], axis=1)
            i = np.concatenate([ids[who], np.where(mine, -1, np.broadcast_to(eid[use], cand.shape))], axis=1)
            pick = np.lexsort((i, ~s), axis=-1)[:, :k]      # ~s: descending without overflow
            top[who], ids[who] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    return ids, np.where(top == none, 0, top), top != none


def build(vectors: DataFrame, dims: int, most: float, n: int, part_rows: int = PART_ROWS, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The pages of the M-trees over ``vectors(id, v)``."""
    parts = max(1, -(-n // part_rows))

    def tree(key, pdf):
        rows = _matrix(pdf["v"], dims)
        out = pd.DataFrame(load_pages(pdf["id"].to_numpy(np.int64), rows, most, page_rows), columns=[
            "node", "node_at", "node_radius", "at", "radius", "parent", "ids", "rows", "far"])
        out.insert(0, "part", int(key[0]))
        return out

    salted = vectors.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
    return salted.groupBy("part").applyInPandas(tree, PAGES)


def search(vectors: DataFrame, is_query: Column, k: int = TOP, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS,
           page_rows: int = PAGE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query row of ``vectors(id, v)``."""
    vectors = written(vectors, "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    r = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(length).alias("most")).first()
    n, dims, most = r["n"], max(r["dims"] or 0, 1), r["most"] or 0.0
    parts = max(1, -(-n // part_rows))
    pages = written(build(vectors, dims, most, n, part_rows, page_rows), "pages")
    queries = vectors.filter(is_query).distinct().withColumn("row", F.xxhash64("v"))
    blocks = max(1, -(-queries.count() // block_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).cast("int"))
    left = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def walk(key, page, query):
        cols = {"query_id": "int64", "row": "int64", "vec_id": "int64", "score": "int64"}
        if not len(page) or not len(query):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in cols.items()})
        qids = query["id"].to_numpy(np.int64)
        ids, score, found = best_first(_matrix(query["v"], dims), qids, page, most, k)
        at = np.nonzero(found)
        return pd.DataFrame({"query_id": qids[at[0]], "row": query["row"].to_numpy(np.int64)[at[0]], "vec_id": ids[at], "score": score[at]})

    near = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(
        walk, "query_id bigint, row bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return (near.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
