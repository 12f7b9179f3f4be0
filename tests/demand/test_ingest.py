import datetime as dt
import io
import json
import logging

import pytest

from granary import cli, providers
from granary.contract import HeaderMapping, SemanticAlignmentError
from granary.logs import JsonFormatter, configure_json_logger, log_ingestion_event
from granary.operators.align import apply_header_mapping, resolve_column
from granary.plans.ingest import run_ingest
from granary.probe import build_alignment_prompt, parse_header_mapping, probe_headers

MAPPING = {"sku_id": "Item_ID", "timestamp": "Date", "demand_qty": "Avg_Usage_Per_Day", "lead_time_days": "Restock_Lead_Time"}
CSV = "Date,Item_ID,Item_Name,Current_Stock,Avg_Usage_Per_Day,Restock_Lead_Time\n2024-10-01,105,Mask,1542,108,17\n2024-10-04,105,Mask,1400,50,12\n"


class Fake:
    def __init__(self, answer=None, error=None):
        self.answer, self.error, self.asked = json.dumps(MAPPING) if answer is None else answer, error, []

    def complete(self, prompt, *, temperature, timeout):
        self.asked.append((prompt, temperature, timeout))
        if self.error:
            raise self.error
        return self.answer


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([("2024-10-01", "105", "Mask", "1542", "108", "17")], ", ".join(f"{c} string" for c in CSV.split("\n")[0].split(",")))


def test_mapping(raw):
    done = apply_header_mapping(raw, HeaderMapping(**{**MAPPING, "sku_id": "item_id"}))
    assert done.frame.columns == list(MAPPING) and done.dropped_columns == ("Item_Name", "Current_Stock") and done.mapping.sku_id == "Item_ID"
    for bad in ({"sku_id": None}, {"sku_id": "Nope"}, {"sku_id": "Date"}):
        with pytest.raises(SemanticAlignmentError):
            apply_header_mapping(raw, HeaderMapping(**{**MAPPING, **bad}))
    assert resolve_column("a", ["A", "a"]) == "a"
    with pytest.raises(SemanticAlignmentError):
        resolve_column("aB", ["AB", "ab"])


def test_probe(raw):
    fake = Fake(f"```json\n{json.dumps({**MAPPING, 'more': 1})}\n```")
    assert probe_headers(raw, fake, timeout=3).frame.first()["demand_qty"] == "108"
    prompt, temperature, timeout = fake.asked[0]
    assert (temperature, timeout) == (0.0, 3) and "Current_Stock" in prompt and "1542" in prompt and "never demand" in prompt
    for answer in ("no", "[1]", json.dumps(dict.fromkeys(MAPPING)), json.dumps({**MAPPING, "sku_id": 3})):
        with pytest.raises(SemanticAlignmentError):
            probe_headers(raw, Fake(answer))
    with pytest.raises(providers.LlmTimeoutError):
        probe_headers(raw, Fake(error=providers.LlmTimeoutError("late")))
    with pytest.raises(ValueError):
        build_alignment_prompt(raw.limit(0))
    assert parse_header_mapping('{"sku_id": " "}').unmapped_fields() == list(MAPPING)


def test_end_to_end(spark, tmp_path):
    (tmp_path / "inv.csv").write_text(CSV)
    done = run_ingest(spark, tmp_path / "inv.csv", Fake(), data_root=tmp_path / "data")
    rows = sorted(map(tuple, spark.read.parquet(str(done.parquet_path)).collect()))
    assert [r[2] for r in rows] == [108.0, 0.0, 0.0, 50.0] and [r[3] for r in rows] == [17, 17, 17, 12]
    assert rows[1][1] == dt.datetime(2024, 10, 2) and done.parquet_path.name == "inv.parquet" and done.source.row_count == 2


@pytest.mark.parametrize(
    ("fake", "csv", "code"),
    [
        (Fake(), CSV, 0),
        (Fake("{}"), CSV, 2),
        (Fake(), CSV.replace("108", "-1"), 3),
        (Fake(error=providers.LlmTimeoutError("late")), CSV, 4),
        (Fake(error=providers.LlmProviderError("HTTP 503", status_code=503)), CSV, 1),
        (Fake(), CSV + "1,2,3,4,5,6,7\n", 1),
    ],
)
def test_exit_codes(spark, tmp_path, monkeypatch, capsys, fake, csv, code):
    (tmp_path / "inv.csv").write_text(csv)
    monkeypatch.setattr(cli, "build_llm_provider", lambda *a, **k: fake)
    got = cli.main(["ingest", "--csv", str(tmp_path / "inv.csv"), "--api-key", "sesame", "--data-root", str(tmp_path / "data")])
    out = capsys.readouterr()
    assert got == code and "sesame" not in out.out + out.err


def test_cli_without_session(tmp_path, monkeypatch, capsys):
    assert cli.main(["models", "--provider", "google"]) == 0 and "(default)" in capsys.readouterr().out
    assert cli.main(["models", "--provider", "other"]) == 1
    for name in ("GRANARY_LLM_API_KEY", "GEMINI_API_KEY", "GOOGLE_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert cli.main(["ingest", "--csv", "x.csv", "--model", "none", "--api-key", "k"]) == 1
    assert cli.main(["ingest", "--csv", "x.csv"]) == 1
    monkeypatch.setenv("GOOGLE_API_KEY", " k ")
    assert cli.resolve_api_key("gemini", " ") == "k"


def test_providers(monkeypatch):
    sent = []

    def post(url, **k):
        sent.append((url, k))
        return answers.pop(0)

    monkeypatch.setattr(providers, "post_json", post)
    answers = [
        {"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}, {"choices": [{"message": {"content": " c "}}]}, {"content": [{"type": "x", "text": "n"}, {"type": "text", "text": "d"}]},
    ]
    got = [providers.build_llm_provider(n, "key").complete("hi", temperature=0.0, timeout=1) for n in ("google", "gpt", "claude")]
    assert got == ["ab", "c", "d"] and sent[0][1]["params"] == {"key": "key"} and sent[2][1]["payload"]["max_tokens"] == 1024
    for name in providers.MODELS:
        answers[:] = [{}]
        with pytest.raises(providers.LlmProviderError):
            providers.build_llm_provider(name, "key").complete("hi", temperature=0.0, timeout=1)
        with pytest.raises(ValueError):
            providers.build_llm_provider(name, " ")
        assert providers.resolve_model(name, None) == providers.DEFAULTS[name] in providers.get_available_models(name)
    with pytest.raises(providers.UnknownModelError):
        providers.build_llm_provider("openai", "k", model="claude-haiku-4-5")
    with pytest.raises(providers.UnknownProviderError):
        providers.build_llm_provider("cohere", "k")


def test_post_json_errors(monkeypatch):
    import urllib.error

    def answering(x):
        def opened(*a, **k):
            if isinstance(x, Exception):
                raise x
            return io.BytesIO(x)

        monkeypatch.setattr(providers.urllib.request, "urlopen", opened)
        return lambda: providers.post_json("http://x", payload={}, timeout=1, params={"key": "sesame"})

    assert answering(b'{"a": 1}')() == {"a": 1}
    with pytest.raises(providers.LlmTimeoutError):
        answering(TimeoutError())()
    for x in (urllib.error.HTTPError("http://x?key=sesame", 401, "", None, None), urllib.error.URLError("down"), b"no", b"[]"):
        with pytest.raises(providers.LlmProviderError) as e:
            answering(x)()
        assert "sesame" not in str(e.value)


def test_answers_of_other_shapes():
    for answer in ({}, {"candidates": []}, {"candidates": [None]}, {"candidates": {"0": 1}}, {"candidates": [{"content": {"parts": "ab"}}]}, {"candidates": [{"content": {"parts": [None, {"text": None}]}}]}):
        assert not any(providers.GeminiProvider("k", model="m").texts(answer))
    assert providers.dig({"a": [{"b": 1}]}, "a", 0, "b") == 1 and providers.dig([1], "a") is None and providers.dig("ab", 0) is None


def test_logs():
    out = io.StringIO()
    logger = configure_json_logger("granary.test", stream=out)
    assert configure_json_logger("granary.test") is logger and len(logger.handlers) == 1
    log_ingestion_event(logger, "done", file_hash="ab", row_count=3)
    try:
        raise ValueError("x\ny")
    except ValueError:
        logger.exception("bad")
    first, second = map(json.loads, out.getvalue().splitlines())
    assert (first["file_hash"], first["row_count"], first["level"]) == ("ab", 3, "INFO") and "ValueError" in second["exception"]
    assert first["module"] == second["module"] == "test_ingest" and list(first) == ["timestamp", "level", "module", "file_hash", "row_count", "message"]
    assert dt.datetime.fromisoformat(first["timestamp"]).utcoffset() == dt.timedelta(0)
    assert isinstance(logger.handlers[0].formatter, JsonFormatter) and not logger.propagate and logger.level == logging.INFO
