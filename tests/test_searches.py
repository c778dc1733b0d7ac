"""Searches for a stated set of queries against the same searches for one item."""

import math

import pytest

from starloom import evaluators, queries, searches  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMES = [n for n in queries.QUERIES if n.endswith("_set")]


@pytest.mark.parametrize("name", NAMES)
def test_set_of_one_is_the_search_for_it(spark, name):
    one = 3 if name[:3] in ("v20", "v22") else 7
    alone = queries.QUERIES[name.removesuffix("_set")](spark, SF)
    found = queries.QUERIES[name](spark, SF, f"item = {one}").drop("q")
    assert set(found.columns) == set(alone.columns)
    names = sorted(found.columns, key=lambda c: (dict(found.dtypes)[c] == "double", c))
    got, expected = (sorted(tuple(r[c] for c in names) for r in x.collect()) for x in (found, alone))
    assert len(got) == len(expected) > 0
    for a, b in zip(got, expected, strict=True):
        assert all(math.isclose(x, y, abs_tol=2.1e-5 if "rho" in names else 2.1e-6) if isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", ["v16_slot_search_set", "v18_self_cosines_set", "v19_saliency_set"])
def test_every_stated_item_is_asked(spark, name):
    items = searches.packed(spark, SF).where("true" if name.startswith("v18") else searches.STATED).count()
    rows = queries.QUERIES[name](spark, SF).groupBy("q").count().collect()
    assert len(rows) == items and {r["count"] for r in rows} == {{"v16": 11, "v18": 24, "v19": 8}[name[:3]]}
