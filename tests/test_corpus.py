"""The corpus of the search queries: which joins move texts, and documents that meet several vectors or none."""

import pytest
from oracle import connect, spark_rows, sql_rows

from dossier.operators.fusion import rerank
from dossier.queries.tables import CORPUS, corpus, search_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_do_not_meet_vectors_that_nobody_asks_for(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    assert "Join" not in plan(chunks.select("chunk_id", "text", "doc_type", "direction"))
    assert "Join LeftOuter" in plan(chunks.select("chunk_id", "issued_on"))


def test_texts_are_cut_to_the_pool_before_they_meet_vectors(spark, sf_dir):
    pool = spark.createDataFrame([(3, 4, 1), (3, 5, 2), (5, 5, 1)], "query_id long, chunk_id long, fused_rank int")
    out = rerank(pool, search_queries(spark, sf_dir), corpus(spark, sf_dir), 2, keep=["doc_no", "issued_on"])
    lines = plan(out).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    text = next(i for i, line in enumerate(lines) if "Relation" in line and "n_chars" in line)
    # From the documents up, the first join is the cut to the pool.
    above = [line for i, line in enumerate(lines[:text]) if "Join" in line and all(depth(line) < depth(x) for x in lines[i + 1 : text + 1])]
    assert "LeftSemi" in above[-1] and "LeftOuter" in above[-2]
    assert sorted((r["query_id"], r["chunk_id"]) for r in out.collect()) == [(3, 4), (3, 5), (5, 5)]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory, sf_dir):
    """The given tables with vectors that stand twice or under no id."""
    path, con = tmp_path_factory.mktemp("repeated"), connect(sf_dir)
    for name in ("documents", "benchmark"):
        con.execute(f"COPY {name} TO '{path}/{name}.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE vec_id % 7 = 0
        UNION ALL SELECT * REPLACE (NULL AS vec_id) FROM embeddings WHERE vec_id < 3) TO '{path}/embeddings.parquet' (FORMAT parquet)""")
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return str(path), con


def test_documents_with_several_vectors_stand_once_for_each(spark, repeated):
    path, con = repeated
    chunks = corpus(spark, path)
    assert "Join" in plan(chunks.select("chunk_id", "text"))
    assert spark_rows(chunks.drop("embedding")) == sql_rows(con, f"WITH {CORPUS} SELECT * EXCLUDE (embedding) FROM corpus")
