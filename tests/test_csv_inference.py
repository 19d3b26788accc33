"""Types inferred from whole CSV files, against a second reader's; malformed rows kept."""

import duckdb
import pytest

from riskloom.sources.tables import infer_csv

SPARK = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "VARCHAR": "string"}


@pytest.fixture()
def mixed(tmp_path):
    lines = ["i,f,b,d,t,s,gap,late,big"]
    for k in range(3000):
        lines.append(f"{k},{k / 4},{'true' if k % 2 else 'false'},2024-01-{k % 28 + 1:02d},2024-01-01 0{k % 10}:00:00,\"a, {k}\",{k if k % 3 else ''},"
                     f"{'oops' if k == 2990 else k},{10**17 + k}")
    path = tmp_path / "m.csv"
    path.write_text("\n".join(lines) + "\n")
    return path


def test_types_equal_duckdbs(spark, mixed):
    got = infer_csv(spark, str(mixed))
    want = duckdb.sql(f"DESCRIBE SELECT * FROM read_csv('{mixed}', sample_size=-1)").fetchall()
    assert dict(got.dtypes[:-1]) == {n: SPARK[t] for n, t, *_ in want}
    same = duckdb.sql(f"SELECT sum(i), sum(f), count(b), max(d), count(gap), max(late), max(big) FROM read_csv('{mixed}', sample_size=-1)").fetchall()[0]
    row = got.selectExpr("sum(i)", "sum(f)", "count(b)", "max(d)", "count(gap)", "max(late)", "max(big)").first()
    assert tuple(row) == same and got.where("_malformed IS NOT NULL").count() == 0


def test_malformed_rows_are_kept_and_do_not_change_types(spark, mixed):
    with open(mixed, "a") as f:
        f.write("1,2\nx,y,z\n" + ",".join("1" * 12) + "\n")
    got = infer_csv(spark, str(mixed)).cache()
    assert dict(got.dtypes)["i"] == "bigint" and dict(got.dtypes)["f"] == "double" and got.count() == 3003
    bad = got.where("_malformed IS NOT NULL").collect()
    assert sorted(r["_malformed"] for r in bad) == sorted(["1,2", "x,y,z", ",".join("1" * 12)]) and all(r["i"] is None for r in bad)


def test_empty_and_clashing_names(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("_malformed,a\n")
    assert infer_csv(spark, str(p)).columns == ["_malformed", "a", "_malformed_"] and infer_csv(spark, str(p)).count() == 0
    p.write_text("_malformed,a\n5,\n6,\n")
    assert infer_csv(spark, str(p)).dtypes == [("_malformed", "bigint"), ("a", "string"), ("_malformed_", "string")]
