"""The cutting of repeats is expressions and joins: no Python worker holds texts or the filter."""

import random

from pyspark.sql import functions as F

from riskloom.llm import suffix

SPANS = "array<struct<at:int,end:int>>"


def shrunk(text, spans):
    data, at, parts = text.encode(), 0, []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]]).decode()


def test_spans_shrink_to_whole_characters(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        text = "".join(rng.choices("aé日😀 ", k=rng.randint(60, 200)))
        n = len(text.encode())
        ends = sorted(rng.sample(range(0, n + 1, 9), 2 * rng.randint(1, 3)))
        rows.append((i, text, [(a + (a and rng.randint(0, 2)), min(n, b + rng.randint(0, 2))) for a, b in zip(ends[::2], ends[1::2])]))
    rows.append((150, "é" * 99, [(0, 198)]))
    rows.append((151, "日😀" * 60, [(1, 420)]))
    frame = spark.createDataFrame(rows, f"i int, text string, _cuts {SPANS}")
    got = {r.i: r.t for r in frame.select("i", suffix.kept_characters().alias("t")).collect()}
    assert got == {i: shrunk(t, s) for i, t, s in rows}


def test_filter_is_true_for_every_key(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").alias("k"), F.hash("id").cast("long").alias("row"))
    rows = spark.range(0, 3000).select(F.col("id").alias("k"), F.hash("id").cast("long").alias("row"))
    got = {r.k: r._maybe for r in suffix.maybe_in(rows, keys).collect()}
    assert len(got) == 3000 and all(got[k] for k in range(0, 3000, 3)) and sum(got.values()) < 1010
    assert suffix.maybe_in(rows, keys.limit(0)).filter("_maybe").count() == 0


def test_cut_texts_ends_without_python(spark):
    line = "".join(random.Random(1).choices("abcdéfgh", k=300))
    docs = spark.createDataFrame([(i, f"{i} {line}", None) for i in range(4)], "doc_id long, text string, lang string")
    out = suffix.cut_texts(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[0] == docs.filter("doc_id = 0").first().text and all(len(left[i].encode()) < 10 for i in (1, 2, 3))
