"""Every driver query through files against its SQL in DuckDB."""

import pytest

from strandloom.queries import files
from tests.test_queries import duck, tidy  # noqa: F401


@pytest.mark.parametrize("name", sorted(files.SQL))
def test_file_query_equals_sql(spark, duck, sf, name):  # noqa: F811
    got = files.QUERIES[name](spark, sf)
    found = duck.execute(files.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    assert tidy(tuple(r[c] for c in names) for r in got.collect()) == tidy(found.fetchall())
