"""Mixing, Merkle manifest and divergence audit against brute force and SQL."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import divergence, manifest, mixing, queries
from tests.llm.helpers import DOCS, EDGE, EXTRA, LONG, table

RICH = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in [
    (1, "Éa b\nc\n", "fr", "web"), (2, None, None, None), (3, "", "en", "web"), (4, "a b c d", "en", ""), (4, "a b c d", "en", ""),
    (5, "A b, a-B x1y\nz", "en", "web"), (None, "no\nid\n", "en", "web"), (None, "no\nid\n", "en", None), (6, LONG, "en", "books"),
    (7, "日本語 text 𝒳𝒴\n ß İ", "ja", "web"), (8, "x" * 5000 + " y", "en", "books"), (9, "x" * 5000 + "z", "en", "books"),
    *[(20 + i, f"alpha beta{'s' * (i % 3)} gamma\n\tdelta {'word ' * (i % 7)}", "en", f"s{i % 4}") for i in range(60)],
    *[(100 + i, "x" * 5000 + f" common {i}", "en", "books") for i in range(11)]]]


@pytest.fixture(scope="module")
def rich(spark, tmp_path_factory):
    return table(spark, RICH, tmp_path_factory.mktemp("rich"), schema=T.StructType(DOCS.fields), extra=[*EXTRA] + ["pos", "tie", "range", "total", "h"])


def oracle(name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return con.execute(queries.ORACLES[name]).to_arrow_table().to_pylist()


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def dicts(out):
    return sorted((tuple(r[c] for c in sorted(r)) for r in out), key=repr)


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        new = {s for s in free if t[s] > 3 * sizes[s]}
        if not new:
            return {**t, **{s: 3 * sizes[s] for s in capped}}
        capped |= new


def check_mix(out, near):
    sizes = collections.Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    goal, taken = water_fill(dict(sizes)), collections.Counter()
    for r in out:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]], rel=1e-12)
        taken[r["source"]] += r["size"] * r["copies"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= near(s), (s, taken[s], goal[s])


def test_mix_reaches_targets_over_several_levels(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"),
                                    F.expr("repeat('w ', cast(1 + id * 7919 % 90 as int))").alias("text"))
    out = [r.asDict() for r in mixing.mix(docs, leaf=10, large=200).collect()]
    assert len(out) == 3000 and len({r["doc_id"] for r in out}) == 3000
    check_mix(out, lambda s: 45 + 1e-6)
    again = mixing.mix(docs.repartition(7, "text"), leaf=10, large=200)
    assert rows(again) == sorted((tuple(r[c] for c in sorted(r)) for r in out), key=repr)


def test_mix_one_document_holds_most_words(spark):
    docs = spark.createDataFrame([(0, "a", "w " * 1000)] + [(i, "a", "w " * 10) for i in range(1, 60)] + [(100 + i, "b", "w " * 20) for i in range(200)]
                                 + [(400 + i, "c", "w") for i in range(5)], "doc_id long, source string, text string")
    check_mix([r.asDict() for r in mixing.mix(docs).collect()], lambda s: 10)


def test_mix_edges(spark, rich, tmp_path):
    out = queries.op11_pivotal_mixing(spark, rich)
    got = [r.asDict() for r in out.collect()]
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in RICH)
    text = collections.defaultdict(list)
    for i, t, *_ in RICH:
        text[i].append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    for r in got:
        assert r["size"] in text[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    empty = [r.asDict() for r in mixing.mix(spark.createDataFrame([(1, None, "en", None, None), (2, "", "en", "a", 0)], DOCS)).collect()]
    assert [(r["target"], r["size"] * r["copies"]) for r in empty] == [(0.0, 0), (0.0, 0)]
    assert queries.op11_pivotal_mixing(spark, table(spark, EDGE, tmp_path)).count() == len(EDGE)


def test_mixture_holds_each_row_as_often_as_planned(spark, rich):
    docs = spark.read.parquet(f"{rich}/documents.parquet").withColumn("text", F.substring("text", 1, 200))
    plan = mixing.written(mixing.mix(docs), "plan")
    mixed = mixing.drawn(docs, plan)
    assert mixed.columns == docs.columns
    count = lambda df, n: {(r["doc_id"], r["source"]): r["n"] for r in df.groupBy("doc_id", "source").agg(n.alias("n")).collect() if r["n"]}
    assert count(mixed, F.count("*")) == count(plan, F.sum("copies"))


def test_pivotal_node_keeps_mass_and_expectation(monkeypatch):
    size, mass = [7, 3, 11, 5, 2, 9], [2.1, 0.9, 3.3, 1.5, 0.6, 2.7]
    part = pd.DataFrame({"doc_id": list("abcdef"), "source": "s", "size": size, "low": 1, "pos": range(6), "node": 0, "mass": mass})
    seen = np.zeros(6)
    for seed in range(4000):
        monkeypatch.setattr(mixing, "SEED", seed)
        out = mixing.settle_node(part, 0)
        held = out["copies"].isna()
        assert held.sum() <= 1
        words = np.where(held, out["mass"], (out["copies"].fillna(1).astype(float) - 1) * out["size"])
        assert words.sum() == pytest.approx(sum(mass))
        seen += words
    assert np.allclose(seen / 4000, mass, atol=0.25)


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(recs):
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    by = collections.defaultdict(list)
    for r in recs:
        by[r[3]].append(r)
    for k in by:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([leaf(r, r[1]) for r in by[k]]) for k in by}
    top = tree([trees[k][-1][0] for k in order])
    out = []
    for k in by:
        for at, r in enumerate(by[k]):
            bad = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now, others = leaf(r, r[1].replace("\n", "") if bad else r[1]), ""
            for levels, i in ((trees[k], at), (top, order.index(k))):
                for nodes in levels[:-1]:
                    run, j = nodes[i - i % 3:i - i % 3 + 3], i % 3
                    others += "".join(run[:j] + run[j + 1:])
                    now, i = digest("".join(run[:j] + [now] + run[j + 1:])), i // 3
            root = top[-1][0]
            out.append({"doc_id": r[0], "leaf": leaf(r, r[1]), "subroot": trees[k][-1][0], "root": root, "proof_sha256": digest(others), "folded_root": now, "verified": now == root})
    return dicts(out)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_equals_brute_force(spark, rich, height):
    docs = spark.read.parquet(f"{rich}/documents.parquet")
    got = rows(manifest.proofs(docs, height))
    assert got == brute_manifest(RICH)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_sql_agrees(spark, rich):
    assert dicts(oracle("op12_merkle_manifest", rich)) == brute_manifest(RICH) == rows(queries.op12_merkle_manifest(spark, rich))


def test_manifest_small_tables(spark):
    for recs in ([], [(1, "a\nb", "en", "s", 3)], [(1, "a", "en", None, 1), (2, "b", "en", "s", 1)], [(0, None, None, None, None)]):
        assert rows(manifest.proofs(spark.createDataFrame(recs, DOCS))) == brute_manifest(recs)


def test_fold_resumes_the_kept_state(monkeypatch):
    block = manifest.Block([digest(str(i)).encode() for i in range(9)], 2)
    hashed = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def copy(self):
            return Counting(self.inner.copy())

        def update(self, data):
            hashed.append(len(data))
            self.inner.update(data)

        def hexdigest(self):
            return self.inner.hexdigest()

    block.states = [[Counting(s) for s in level] for level in block.states]
    assert block.fold(8, digest("8").encode()) == block.top() and hashed == [64, 64]     # last slots: no left sibling again
    hashed.clear()
    assert block.fold(0, digest("x").encode()) != block.top() and hashed == [64] * 6


def test_divergence_equals_sql(spark, rich):
    got = queries.op13_divergence_audit(spark, rich)
    assert [f.dataType for f in got.select("value", "rank").schema] == [T.LongType(), T.IntegerType()]
    assert rows(got) == dicts(oracle("op13_divergence_audit", rich))
    assert {r["item"] for r in got.filter("part = 'term'").collect()} >= {"x" * 5000, "alpha"}


def test_divergence_empty_and_without_terms(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    lone = divergence.audit(spark.createDataFrame([(1, None, None, None, None), (2, "a", None, "b", 1), (3, "1 2", "en", "b", 3)], DOCS))
    assert rows(lone) == dicts([{"lang": "", "source": a, "part": "pair", "item": b, "value": 0, "rank": 1} for a, b in (("", "b"), ("b", ""))])


def test_refinement_keeps_what_direct_counts_keep(spark):
    texts = [" ".join(f"{'ab' * (i % 9)}{'xyz'[j % 3]}{'q' * (j * i % 40)}" for j in range(12)) for i in range(80)]
    docs = spark.createDataFrame([(f"l{i % 2}", "s", t) for i, t in enumerate(texts)], "lang string, source string, text string")
    kept = divergence.kept_terms(divergence.written(divergence.postings(docs), "p"), 5)
    direct = collections.Counter((f"l{i % 2}", w) for i, t in enumerate(texts) for w in set(t.split()))
    assert {(r["lang"], bytes(r["term"]).decode()) for r in kept.collect()} == {k for k, n in direct.items() if n >= 5}
    assert kept.count() == kept.distinct().count()


def test_terms_are_the_contract_matches():
    for text in ("", "aB-C\x00dÉÀ日本 x1y_z\x7f~q ẞ", "\u0080  Z", "@[`{az AZ"):
        want = [re.sub("[A-Z]", lambda m: m.group().lower(), m) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        assert [t.decode() for t in divergence.terms_of(text)] == want


def test_pair_sums_by_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    heads = pd.DataFrame({"lang": "en", "pos": range(7), "p0": rng.integers(1, 50, 7)})
    terms = pd.DataFrame([(f"t{t}", s, int(rng.integers(1, 10**9))) for t in range(6) for s in range(7) if rng.random() < 0.6], columns=["term", "at", "p"])
    monkeypatch.setattr(divergence, "TILE", 3)
    got = pd.concat([divergence.pair_sums(terms, heads.assign(tile=t)) for t in range(3)])
    p = {(t, s): int(heads["p0"][s]) for t in terms["term"].unique() for s in range(7)} | {(t, s): v for t, s, v in terms.itertuples(index=False)}
    want = {(i, j): sum((p[t, i] - p[t, j]) ** 2 // (p[t, i] + p[t, j]) for t in terms["term"].unique()) for i in range(7) for j in range(i + 1, 7)}
    assert {(i, j): f for _, i, j, f in got.itertuples(index=False)} == want
