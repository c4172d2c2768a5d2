"""Queries that SQL can express, against their SQL."""

import math
import random

import pytest

from arbolex.llm import queries
from tests.compare import TABLES, differences

from .test_substrings import edited


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, tmp_path, name):
    import duckdb

    from .fixtures import frame

    frame(spark, [*edited(9)[:70], "a\nb\na\n\n a", None]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    turns = [(1, 0, "user", 'hi "you"\n\t\\ é <b>'), (1, 1, "assistant", None), (None, None, None, ""), (2, 0, "system", " be good "), (2, 0, "system", " be good ")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    rng = random.Random(6)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(6)], rng.randrange(4)) for i in range(300)] + [(400, None, 1), (450, [math.nan] * 6, 1), (500, [0.5] * 6, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert "documents" in TABLES
    assert differences(spark, con, str(tmp_path), queries.QUERIES[name], queries.ORACLES[name]) is None
