"""Property-based checks of the exact-quantile and Mann-Whitney paths."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kestrel.operators import ranks as RN
from kestrel.operators.stats.tests import mann_whitney_u

values = st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=values, b=values, q=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_quantiles_and_u_match_brute_force(spark, a, b, q):
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r[RN.quantile_name("q", q)] for r in RN.exact_quantiles(df, "v", [q], ["g"], prefix="q").collect()}
    assert got["a"] == pytest.approx(float(np.quantile(a, q)))
    assert got["b"] == pytest.approx(float(np.quantile(b, q)))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = mann_whitney_u(df, "g", "v", "a", "b").collect()[0]
    assert r["u_statistic"] == pytest.approx(u)
    t = {}
    for v in a + b:
        t[v] = t.get(v, 0) + 1
    assert r["tie_term"] == pytest.approx(sum(c ** 3 - c for c in t.values()))
