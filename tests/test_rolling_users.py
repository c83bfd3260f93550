import datetime as dt
import random

from quern.operators import results as R
from quern.plans import load_all


def test_sketches_within_error_of_exact(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 20000), dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.choice([d for d in range(60) if d % 9]), seconds=rng.randint(0, 86399))) for _ in range(60000)]
    rows += [(None, dt.datetime(2024, 1, 2)), (5, None)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    exact = {r.day: r for r in R.rolling_active_users_exact(df).collect()}
    rough = {r.day: r for r in R.rolling_active_users(R.day_sketches(df)).collect()}
    assert exact.keys() == rough.keys()  # days with activity only; gaps (every ninth day) stay out
    for day, r in exact.items():
        for col in ("users_7d", "users_30d"):
            assert abs(rough[day][col] - r[col]) <= 0.05 * r[col] + 1, (day, col)
    first = min(exact)
    assert exact[first].users_7d == len({u for u, t in rows if u is not None and t is not None and t.date() == first})


def test_registered_queries_agree(spark, sf_dir):
    q = load_all().QUERIES
    exact = {r.day: r for r in q["b12_rolling_active_users_exact"](spark, sf_dir).collect()}
    rough = {r.day: r for r in q["b12_rolling_active_users"](spark, sf_dir).collect()}
    assert exact.keys() == rough.keys() and exact
    assert all(abs(rough[d].users_30d - exact[d].users_30d) <= 0.05 * exact[d].users_30d + 1 for d in exact)
