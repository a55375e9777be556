"""Property tests: exact order statistics against a plain sort on random
samples with duplicates, nulls and NaN (few examples: each runs Spark jobs)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kiln.operators.quantiles import order_statistics

values = st.lists(st.one_of(st.sampled_from([0.0, 1.5, -2.0, 7.0]), st.floats(-1e6, 1e6),
                            st.none(), st.just(float("nan"))), min_size=1, max_size=400)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, data=st.data())
def test_order_statistics_match_sort(spark, vals, data):
    clean = sorted(v for v in vals if v is not None and not math.isnan(v))
    if not clean:
        return
    ranks = data.draw(st.sets(st.integers(0, len(clean) - 1), min_size=1, max_size=5))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = order_statistics(df, {"v": ranks}, buckets=4)["v"]
    assert got == {r: clean[r] for r in ranks}
