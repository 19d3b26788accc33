"""The classifier's fit holds the sample once, as it came, and gives its memory back."""

import numpy as np

from riskloom.llm import nbsvm


def test_fit_holds_small_rows_and_releases(spark, monkeypatch):
    seen, released = [], []
    plain = nbsvm.fit_weights
    monkeypatch.setattr(nbsvm, "fit_weights", lambda rows, y: seen.extend(rows) or plain(rows, y))
    monkeypatch.setattr(nbsvm, "release_memory", lambda: released.append(1))
    docs = spark.createDataFrame([(i, f"{'good plain words' if i % 2 else 'bad $$ ##'} {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    weights, a, b = nbsvm.fit(docs, labels)
    assert released and all(x.itemsize == 4 for x in seen)
    wide = plain([x.astype(np.int64) for x in seen[-50:]], np.array([1.0, -1.0] * 25))
    assert np.array_equal(wide, plain(seen[-50:], np.array([1.0, -1.0] * 25)))
