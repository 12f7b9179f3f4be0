import datetime as dt
import random

import pandas as pd
import pytest

from granary.contract import TemporalContinuityError
from granary.operators import regrid

SCHEMA = "sku_id string, timestamp timestamp_ntz, demand_qty double, lead_time_days long"


def day(n):
    return dt.datetime(2024, 2, 27) + dt.timedelta(days=n)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def oracle(rows):
    frame = pd.DataFrame(rows, columns=["sku_id", "timestamp", "demand_qty", "lead_time_days"])
    out = []
    for sku, g in frame.groupby("sku_id"):
        days = pd.DataFrame({"timestamp": pd.date_range(g.timestamp.min(), g.timestamp.max(), freq="D")})
        m = days.merge(g, on="timestamp", how="left")
        m["demand_qty"] = m.demand_qty.fillna(0.0)
        m["lead_time_days"] = m.lead_time_days.ffill().bfill()
        out += [(sku, r.timestamp.to_pydatetime(), r.demand_qty, int(r.lead_time_days)) for r in m.itertuples()]
    return sorted(out)


def test_gaps_and_single_day(spark):
    rows = [("A", day(0), 108.0, 17), ("A", day(3), 50.0, 9), ("B", day(1), 5.0, 2)]
    got = rows_of(regrid.regrid_daily(spark.createDataFrame(rows, SCHEMA)))
    assert got == [("A", day(0), 108.0, 17), ("A", day(1), 0.0, 17), ("A", day(2), 0.0, 17), ("A", day(3), 50.0, 9), ("B", day(1), 5.0, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_both_plans_equal_pandas(spark, seed):
    r = random.Random(seed)
    rows = [(f"s{s}", day(d), float(r.randint(0, 9)), r.randint(1, 30)) for s in range(6) for d in sorted(r.sample(range(400), r.randint(1, 25)))]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = oracle(rows)
    assert rows_of(regrid.regrid_unique(frame)) == want
    assert rows_of(regrid.regrid_general(frame)) == want


def test_plan_has_one_exchange(spark):
    frame = spark.createDataFrame([("A", day(0), 1.0, 1)], SCHEMA)
    plan = regrid.regrid_unique(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_direct_calls(spark):
    def run(*rows, **k):
        return regrid.regrid_daily(spark.createDataFrame(list(rows), SCHEMA), **k)

    filled = rows_of(run(("A", day(0), None, None), ("A", day(1), 2.0, 4), ("A", day(2), 1.0, None)))
    assert filled == [("A", day(0), 0.0, 4), ("A", day(1), 2.0, 4), ("A", day(2), 1.0, 4)]
    off = day(2) + dt.timedelta(hours=5)
    assert rows_of(run(("A", day(0), 1.0, 4), ("A", off, 9.0, 5)))[-1] == ("A", day(2), 0.0, 4)
    assert [r[0] for r in rows_of(run((None, day(0), 1.0, 4), ("A", day(0), 1.0, 4)))] == ["A"]
    for bad in ([("A", day(0), 1.0, 1), ("A", day(0), 2.0, 1)], [("A", day(0), 1.0, None)], []):
        with pytest.raises(TemporalContinuityError):
            run(*bad)
    with pytest.raises(TemporalContinuityError):
        run(("A", day(0), 1.0, 1), ("A", day(50), 1.0, 1), max_span_days=50)
    with pytest.raises(TemporalContinuityError):
        regrid.regrid_daily(spark.createDataFrame([("A",)], "sku_id string"))
    with pytest.raises(Exception, match=regrid.SPAN_ERROR):
        run(("A", day(0), 1.0, 1), ("A", day(30), 1.0, 1), ("A", day(50), 1.0, 1), max_span_days=50, validated=True).collect()
    assert len(rows_of(run(("A", day(0), 1.0, 1), ("A", day(30), 1.0, 1), ("A", day(50), 1.0, 1), max_span_days=51, validated=True))) == 51


def test_validated_frames_start_no_job(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    regrid.regrid_daily(spark.createDataFrame([("A", day(0), 1.0, 1)], SCHEMA), validated=True)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
