"""Every registered query against its SQL, on the smallest tables."""

import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from quillspan import catalog

DATA = "/root/testdata/sf0.001"


def clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(clean(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(clean(r[c]) for c in cols) for r in df.select(*cols).collect()), key=repr)
    if name not in catalog.ORACLE:
        assert rows
        return
    got = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(clean(r[i]) for i in at) for r in got.fetchall()), key=repr)
