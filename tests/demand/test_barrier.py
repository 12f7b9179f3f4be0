import datetime as dt
import math

import pytest

from granary.contract import SchemaBarrierError
from granary.operators.barrier import validate_aligned, violations
from granary.sources.csv_files import ROW_INDEX

GOOD = {"sku_id": "A", "timestamp": "2024-10-01", "demand_qty": "3", "lead_time_days": "7"}


def frame(spark, *changes):
    rows = [(*{**GOOD, **c}.values(), i) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, f"sku_id string, timestamp string, demand_qty string, lead_time_days string, {ROW_INDEX} long")


def test_typed_output(spark):
    got = validate_aligned(frame(spark, {"sku_id": " A\t", "lead_time_days": "17.0", "demand_qty": "0"}, {"timestamp": "20241002T101500", "demand_qty": "inf"}))
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "timestamp_ntz", "double", "bigint"]
    assert sorted(map(tuple, got.collect())) == [("A", dt.datetime(2024, 10, 1), 0.0, 17), ("A", dt.datetime(2024, 10, 2), math.inf, 7)]


@pytest.mark.parametrize(
    ("change", "column"),
    [
        ({"timestamp": ""}, "timestamp"), ({"timestamp": "2024-02-30"}, "timestamp"), ({"timestamp": "2024-10-01T00:00:00Z"}, "timestamp"), ({"timestamp": None}, "timestamp"),
        ({"demand_qty": "-1"}, "demand_qty"), ({"demand_qty": "1d"}, "demand_qty"), ({"demand_qty": "nan"}, None),
        ({"lead_time_days": "0"}, "lead_time_days"), ({"lead_time_days": "1.5"}, "lead_time_days"), ({"lead_time_days": "inf"}, "lead_time_days"), ({"lead_time_days": "nan"}, "lead_time_days"),
        ({"sku_id": "  "}, None),
    ],
)
def test_first_violation(spark, change, column):
    with pytest.raises(SchemaBarrierError) as e:
        validate_aligned(frame(spark, {"sku_id": "B"}, change, {"timestamp": "x"}))
    assert (e.value.row_index, e.value.column) == (1, column)


def test_order_within_a_row_and_duplicates_last(spark):
    bad = frame(spark, {}, {}, {"timestamp": "x", "demand_qty": "-1"})
    assert [(r["row_index"], r["column"]) for r in violations(bad).collect()] == [(2, "timestamp")]
    with pytest.raises(SchemaBarrierError) as e:
        validate_aligned(frame(spark, {"sku_id": "B"}, {}, {"timestamp": "2024-10-01T09:00"}))
    assert (e.value.row_index, e.value.column) == (1, None)


def test_frame_shape(spark):
    with pytest.raises(SchemaBarrierError):
        validate_aligned(frame(spark))
    with pytest.raises(SchemaBarrierError):
        validate_aligned(frame(spark, {}).select("timestamp", "sku_id", "demand_qty", "lead_time_days"))
