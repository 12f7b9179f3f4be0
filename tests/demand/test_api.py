"""The public surface: what callers of the ingestion library import, and the calls they make."""

import inspect

import pytest

from granary import api

CALLS = {
    "run_ingest": {"provider", "data_root", "timeout"},
    "run_semantic_pipeline": {"frame", "provider", "timeout"},
    "extract_csv": {"data_root"},
    "export_parquet": {"destination", "data_root"},
    "probe_headers": {"frame", "provider", "timeout"},
    "post_json": {"payload", "timeout", "headers", "params"},
    "configure_json_logger": {"name", "level", "stream"},
    "log_ingestion_event": {"logger", "message", "file_hash", "row_count", "level"},
    "resolve_model": {"provider", "model"},
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_calls(name):
    assert set(inspect.signature(getattr(api, name)).parameters) >= CALLS[name]


def test_errors_and_contracts():
    assert issubclass(api.LlmTimeoutError, api.LlmError) and issubclass(api.UnknownModelError, ValueError)
    assert api.CANONICAL == ("sku_id", "timestamp", "demand_qty", "lead_time_days")
    for method, arguments in (("fit", ["self", "y"]), ("predict", ["self", "horizon"])):
        assert list(inspect.signature(getattr(api.BaseForecaster, method)).parameters) == arguments

    class Constant(api.BaseForecaster):
        def fit(self, y):
            return self

        def predict(self, horizon):
            return [self.seed] * horizon

    assert Constant(seed=3).fit([]).predict(horizon=2) == [3, 3]
    assert all(hasattr(api, n) for n in api.__all__)
