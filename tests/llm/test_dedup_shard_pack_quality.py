import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from riskloom.llm import nbsvm, packing, sharding, simhash
from riskloom.llm.queries import QUERIES
from tests.conftest import SF001, SF01
from tests.llm.helpers import EDGE, EXTRA, table


def run(spark, n, sf):
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def texts(sf):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()


# ---- SimHash

def brute_simhash(text):
    b = (text or "").encode().lower()
    w = b.split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = list(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 3:
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_against_brute_force(spark):
    got = run(spark, 3, SF001)
    fps = {i: brute_simhash(t) for i, t in texts(SF001)}
    comp = brute_components(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_links_join_what_is_close(spark):
    """Random fingerprints with planted neighbours and chains; one group larger than a chunk."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 40)
    fps = set(int(x) for x in base)
    for b in base[:20]:
        x = int(b)
        for _ in range(30):
            for k in rng.choice(63, rng.integers(1, 5), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    for chunk in (1024, 4):
        labels = {r.node: r.label for r in simhash.components(simhash.links(df, chunk=chunk)).collect()}
        want = brute_components({x: x for x in fps})
        assert {x: labels.get(x, x) for x in fps} == want


def test_simhash_edges(spark, tmp_path):
    got = run(spark, 3, table(spark, EDGE, tmp_path, extra=EXTRA))
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["component_id"] == by[1]["component_id"] == by[2]["component_id"] == 0
    assert by[0]["fingerprint"] == "0" * 16
    assert by[5]["component_id"] == 4 and by[None]["component_id"] is None
    assert run(spark, 3, table(spark, [], tmp_path / "e")) == []
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 3, 4, 7, None} <= set(ids) and not {1, 2, 5} & set(ids)


# ---- sharding

def test_sharding_law_and_places(spark):
    got = run(spark, 6, SF01)
    want = dict(texts(SF01))
    size = defaultdict(int)
    places = defaultdict(list)
    for r in got:
        b = (want[r["doc_id"]] or "").encode()
        assert r["size"] == len(b) + 8 and r["text_crc32"] == zlib.crc32(b)
        size[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert sorted(size) == list(range(24)) and len(got) == len(want)
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in got)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r["rebalanced_shard"] for r in got if r["rebalanced_shard"] != r["shard"]} == {24}
    slot = {}
    assert all(slot.setdefault(r["virtual_slot"], r["shard"]) == r["shard"] for r in got)


def test_map_versions(spark, tmp_path):
    size = [(i * 37) % 101 for i in range(64)]
    one = sharding.build_map(size, 4)
    load = [sum(s for s, m in zip(size, one) if m == k) for k in range(4)]
    assert max(load) - min(load) <= 10
    two = sharding.add_shard(one, size, 4)
    assert all(a == b or b == 4 for a, b in zip(one, two))
    assert abs(sum(s for s, m in zip(size, two) if m == 4) - sum(size) / 5) < 101
    path = str(tmp_path / "map")
    sharding.save_map(sharding.map_frame(spark, one, size, [1] * 64, 1), path)
    sharding.save_map(sharding.map_frame(spark, two, size, [1] * 64, 2), path)
    assert sharding.load_map(spark, path, 1) == one and sharding.load_map(spark, path, 2) == two


def test_sharding_edges(spark, tmp_path):
    got = run(spark, 6, table(spark, EDGE, tmp_path, extra=EXTRA))
    assert len(got) == len(EDGE)
    assert {r["size"] for r in got if r["doc_id"] in (0, 1)} == {8}
    assert run(spark, 6, table(spark, [], tmp_path / "e")) == []


# ---- packing

@pytest.fixture(scope="module")
def reference_tokens():
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [1]


def check_packed(got, rows, tokens):
    ids = {i: tokens(t) for i, t in rows}
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own) and r["length"] > 0
        at[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.asarray(own[r["start"]:at[r["doc_id"]]], "<u4").tobytes())
    assert dict(at) == {i: len(x) for i, x in ids.items()}
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    used = padded = 0
    for parts in seqs.values():
        end = 0
        for off, n in sorted(parts):
            assert off == end
            end += n
        assert end <= 2048
        used += end
        padded += end if end & (end - 1) == 0 else 2048
    return used / padded


def test_packing(spark, reference_tokens):
    assert check_packed(run(spark, 10, SF001), texts(SF001), reference_tokens) > 0.97
    assert check_packed(run(spark, 10, SF01), texts(SF01), reference_tokens) > 0.98


def test_packing_many_buckets(spark):
    rows = [(i, i * 7 % 13, 1 + i * i % 2048, 0, 0) for i in range(6000)]
    pieces = spark.createDataFrame([(*r, 2048 // r[2]) for r in rows], "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, m int")
    got = packing.pack(pieces, bucket_pieces=150).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 6000
    for parts in seqs.values():
        end = 0
        for off, n in sorted(parts):
            assert off == end
            end += n
        assert end <= 2048


def test_cuts_cover_every_length():
    for n in range(1, 5000):
        c = packing.cuts(n)
        assert sum(k for k, _ in c) == n and all(k * m <= 2048 for k, m in c)


def test_packing_edges(spark, tmp_path, reference_tokens):
    rows = [(i, t) for i, t in dict(EDGE).items()] + [(9, "a<|endoftext|>b")]
    check_packed(run(spark, 10, table(spark, rows, tmp_path, extra=EXTRA)), rows, reference_tokens)
    assert len(run(spark, 10, table(spark, [(1, ""), (1, "")], tmp_path / "d"))) == 2
    assert run(spark, 10, table(spark, [], tmp_path / "e")) == []


# ---- quality classifier

def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = run(spark, 9, sf)
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    assert len(got) == 10000
    held = [(r, labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    good = np.mean([r["predicted"] for r, y in held if y == 1])
    bad = np.mean([r["predicted"] for r, y in held if y == 0])
    assert good > 0.99 and bad < 0.1, (good, bad)


def test_dual_coordinate_descent_solves_the_dual():
    """Against the optimality conditions of the hinge-loss dual on a small problem."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(40)]
    y = np.where(rng.random(40) > 0.5, 1.0, -1.0)
    vals = [np.ones(8) / np.sqrt(8) for _ in rows]
    w = nbsvm.dual_coordinate_descent(rows, vals, y, np.ones(40), rounds=2000, tol=1e-10)
    primal = 0.5 * w @ w + sum(max(0, 1 - t * (w[x] @ v)) for x, v, t in zip(rows, vals, y))
    for _ in range(300):
        d = np.zeros_like(w)
        d[:50] = rng.normal(size=50) * 10 ** rng.uniform(-4, 0)
        z = w + d
        assert 0.5 * z @ z + sum(max(0, 1 - t * (z[x] @ v)) for x, v, t in zip(rows, vals, y)) >= primal - 1e-6


def test_quality_edges(spark, tmp_path):
    lab = "doc_id bigint, quality int, toxic int"
    sf = table(spark, EDGE, tmp_path, extra=EXTRA)
    table(spark, [(4, 1, 0), (3, 0, 0), (6, None, 0), (None, 1, 0), (5, 1, 0), (5, 0, 0)], tmp_path, "labels", lab)
    got = run(spark, 9, sf)
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    table(spark, [], tmp_path, "labels", lab)
    assert {r["score"] for r in run(spark, 9, sf)} == {0.5}
    table(spark, [], tmp_path)
    assert run(spark, 9, sf) == []
