"""Every query with a twin on the odd tables (test_oracle.py has them on the driver's), and every query on empty tables."""

import pytest

from quiver.llm.queries import ORACLE, QUERIES
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_odd_tables(spark, odd_dir, name):
    assert compare(spark, odd_dir, name, QUERIES[name], ORACLE[name], duck(odd_dir))["status"] == "ok"


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, odd_dir, tmp_path, name):
    for table in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
