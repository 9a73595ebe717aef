import pytest

from terrapane.llm.registry import ORACLE_SQL, QUERIES


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, duck, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = duck().sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda df: df[columns].sort_values("doc_id").reset_index(drop=True)
    import pandas as pd

    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)
