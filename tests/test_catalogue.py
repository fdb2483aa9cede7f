"""Every query of the catalogue against its SQL, in DuckDB, on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from docloom.plans import catalogue

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _value(v):
    return "~" if v is None else round(float(v), 7) if isinstance(v, float | decimal.Decimal) else v


def _rows(rows, columns):
    return sorted(([_value(r[c]) for c in columns] for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    found = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in found.description]
    want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert want
    assert _rows([r.asDict() for r in df.collect()], columns) == _rows(want, columns)
    kinds = {c: str(t) for c, t, *_ in duck.execute(f"DESCRIBE {catalogue.SQL[name]}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "best_score", "blocked", "reason", "prompt", "citation"]
    assert df.limit(1).count() == 1


def test_hybrid_gate_indexes_texts_where_they_lie(spark, monkeypatch):
    """What is indexed hasn't been joined with its vectors, which would move every text."""
    from docloom.operators import bm25

    seen, index = [], bm25.index
    monkeypatch.setattr(bm25, "index", lambda units, *a: seen.append(units) or index(units, *a))
    assert catalogue.QUERIES["hybrid_gate"](spark, str(SF)).count()
    assert len(seen) == 1 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
