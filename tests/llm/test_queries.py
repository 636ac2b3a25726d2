import pytest

from quorumlake.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs_with_distinct_rows_and_no_nulls(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    n = df.count()
    if name.endswith("_found"):
        assert df.distinct().count() == n
        assert df.where(" or ".join(f"{c} is null" for c in df.columns)).isEmpty()


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
