import pandas as pd
import pytest

import __spark_entry__
from terrapane.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql_agrees(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck().sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def tidy(df):
        df = df[columns].copy()
        for c in columns:
            if df[c].dtype == object or "datetime" in str(df[c].dtype):
                df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "year") else str(v))
        return df.sort_values([c for c in columns if df[c].dtype.kind != "f"] + [c for c in columns if df[c].dtype.kind == "f"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, atol=2e-6)
