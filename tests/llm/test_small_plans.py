"""A model is one literal of the plan that masks secrets; a run's spans are one row of repeats."""

import pyspark.sql.functions as F

from riskloom.llm import secrets, suffix


def test_model_is_once_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "user path/Xq9LkZt83MvRw2YbNc5Ph7Df kept", 1)], "doc_id long, text string, n_chars int")
    model = [0.123456789 + i for i in range(secrets.SYMBOLS ** 2)]
    literal = len(",".join(f"{v:.9g}" for v in model))
    plan = secrets.masked_texts(docs, model)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 4 * literal


def test_spans_are_not_exploded(spark):
    same = "".join(chr(97 + i * i % 23) + str(i) for i in range(120))
    docs = spark.createDataFrame([(i, f"own start {i} " + same + f" own end {i * 7}") for i in range(5)], "doc_id long, text string")
    slim = docs.selectExpr("doc_id as k", "xxhash64(doc_id, text) as row", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    plain, exploded = F.explode, []
    suffix.F.explode = lambda c: exploded.append(c) or plain(c)
    try:
        cuts = {r["k"]: [(s["at"], s["end"]) for s in r["cuts"]] for r in suffix.removed_spans(slim, "first").collect()}
    finally:
        suffix.F.explode = plain
    assert not exploded
    found = lambda t: (t.index(same), t.index(same) + len(same))
    assert set(cuts) == {1, 2, 3, 4}
    for k, spans in cuts.items():
        (lo, hi), = spans
        a, b = found(texts[k])
        assert lo <= a and hi >= b
