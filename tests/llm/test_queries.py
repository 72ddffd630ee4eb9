"""Every query on empty tables and on odd rows: nulls, blanks, repeats, columns whose names the operators use themselves."""

import pytest

from loam.llm import queries

DIR = "/root/testdata/sf0.001"
EXTRA = "'r' AS _row, 1 AS _doc, 'f' AS fp, 2 AS node, 3 AS size, 4 AS copies, 5 AS score, 'x' AS shard, 6 AS slot, 7 AS part, 8 AS head, 'k' AS key, 9 AS h, 1 AS n, 2 AS id, 3 AS v, 4 AS bucket".split(", ")


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(spark, tmp_path_factory, request):
    where = tmp_path_factory.mktemp(request.param)
    some = 30 if request.param == "odd" else 0
    for name in ("documents", "embeddings", "pages", "labels"):
        df = spark.read.parquet(f"{DIR}/{name}.parquet")
        df = df.orderBy(df.columns[0]).limit(some)
        blank = spark.createDataFrame([tuple(None for _ in df.columns)] * (2 if some else 0), df.schema)
        df.unionByName(blank).unionByName(df.limit(3)).selectExpr("*", *EXTRA).coalesce(1).write.parquet(f"{where}/{name}.parquet")
    return str(where), some


@pytest.mark.parametrize("name", list(queries.queries()))
def test_a_row_for_each_row(spark, folder, name):
    where, some = folder
    found = queries.queries()[name](spark, where)
    rows = found.collect()
    assert len(set(found.columns)) == len(found.columns)
    if name == "op6_packing":  # a row a piece
        assert (len(rows) >= 35) == (some > 0)
    else:
        assert len(rows) == (35 if some else 0)
