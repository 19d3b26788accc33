"""One surrogate per given name, patterns on very long texts, and any column names."""

import re

from pyspark.sql import functions as F

from riskloom.llm import surrogate


def rewritten(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in surrogate.pseudonymised(docs, "k").collect()}


def test_a_given_name_agrees_over_titles_and_texts(spark):
    out = rewritten(spark, ["Dr. John Smith came.", "Mr. John Smith left. John called.", "Prof. John Smith", "Mrs. Kim Lee, Ms. Kim Lee, Mr. Kim Lee",
                            "Write to Mr. John Smith at john.smith@mail.example.com or 555 123 4567.", "nothing here", None, ""])
    name = re.match(r"Dr\. (\S+ \S+) came\.", out[0]).group(1)
    given, family = name.split()
    assert given in surrogate.GIVEN["latin", "m"].split() and "John" not in name and "Smith" not in name
    assert out[1] == f"Mr. {name} left. {given} called." and out[2] == f"Prof. {name}"
    kims = set(re.findall(r"M(?:rs|s|r)\. (\S+) ", out[3]))
    assert len(kims) == 1 and kims <= set(surrogate.GIVEN["latin", "f"].split())
    assert out[4].startswith(f"Write to Mr. {name} at ") and "john" not in out[4] and "123 4567" not in out[4] and "example.com" in out[4]
    assert out[5] == "nothing here" and out[6] is None and out[7] == ""


def test_very_long_repeats_are_matched(spark):
    n = 20_000
    labels = ".".join(["ab"] * n)
    out = rewritten(spark, ["Mr. J" + "o" * n, "Mr. " + "Jo " * n, "Mr. " * n + "Jo Doe", f"x@{labels}.com. Next", "Mr. " + "de " * n + "Doe", "-" * n, "Jo-" * n])
    assert all(len(t) > n // 2 for i, t in out.items() if i)
    assert re.fullmatch(r"Mr\. [A-Z][a-z]+", out[0]) and "Doe" not in out[2] and "Doe" not in out[4]
    assert out[3].endswith(".ab.com. Next") and not out[3].startswith("x@ab.ab.")
    assert out[5] == "-" * n and out[6] == "Jo-" * n


def test_addresses_end_where_they_did(spark):
    out = rewritten(spark, ["mail a@b.co. Then", "mail a@b.co.1x", "no a@b", "two a@bb.cc.dd,e@ff.gg"])
    assert re.fullmatch(r"mail [a-z]@b\.co\. Then", out[0]) and re.fullmatch(r"mail [a-z]@b\.co\.1x", out[1])
    assert out[2] == "no a@b" and re.fullmatch(r"two [a-z]@[a-z]{2}\.cc\.dd,[a-z]@ff\.gg", out[3])


def test_columns_of_any_name_are_kept(spark):
    names = ("id", "row", "_id", "_names", "_gaps", "_late", "_text", "_found", "_alone", "place", "lang")
    docs = spark.createDataFrame([(1, "Mr. Jo Doe"), (2, "no"), (2, "no"), (None, None)], "doc_id long, text string")
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(f"v{i}"))
    out = surrogate.pseudonymised(docs, "k").collect()
    assert len(out) == 4 and all(r[c] == f"v{i}" for r in out for i, c in enumerate(names))
