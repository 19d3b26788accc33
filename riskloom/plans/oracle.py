"""Oracle SQL registry: ``name -> DuckDB SQL`` over the driver tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def _count_if_as_filter(sql: str) -> str:
    """``count_if(x)`` → ``count(*) FILTER (WHERE x)``: same value, BIGINT like
    Spark's ``count_if`` (DuckDB's count_if is HUGEINT)."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth = j + len(tok), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append("count(*) FILTER (WHERE " + _count_if_as_filter(sql[j + len(tok):k - 1]) + ")")
        i = k


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = _count_if_as_filter(sql)


def all_oracles() -> dict[str, str]:
    from riskloom.plans.registry import all_queries
    all_queries()
    return dict(ORACLE)
