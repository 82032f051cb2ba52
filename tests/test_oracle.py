"""Every registered query against its SQL, values and types."""

import pytest
from oracle import connect, spark_rows, sql_rows

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
TYPES = {
    "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "bigint", "hugeint": "hugeint",
    "string": "varchar", "timestamp_ntz": "timestamp", "float": "float",
}


def spark_types(df):
    return {n: TYPES.get(t.split("<")[0], t.split("<")[0]) for n, t in df.dtypes}


def sql_types(con, sql):
    out = {}
    for name, kind in con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall():
        kind = kind.lower()
        out[name] = "array" if kind.endswith("[]") else TYPES.get(kind, kind)
    return out


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    own = {q for q in QUERIES if not q.startswith("op") and q != "pipeline"}
    assert own - set(ORACLE) == {"chunk_structural"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    assert spark_types(df) == sql_types(con, ORACLE[name])
    assert spark_rows(df) == sql_rows(con, ORACLE[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
