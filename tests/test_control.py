import gzip
import os

import pytest

from sluice.errors import EngineError
from sluice.plans import control
from sluice.sources import telemetry


def test_settings():
    assert control.settings({"a": True}, "bad", {"a": 2})["a"] == "2" and control.settings({"a": True})["a"] == "true"


def test_payload_and_delivery(tmp_path):
    logs = telemetry.resource_logs([{"pipeline": "p", "flow": "f", "level": "ERROR", "message": "m", "time_ms": 5, "rows": 3}])
    (record,) = logs[0]["scopeLogs"][0]["logRecords"]
    assert record["severityNumber"] == 17 and record["timeUnixNano"] == "5000000" and {"key": "rows", "value": {"intValue": "3"}} in record["attributes"]
    for _ in range(2):
        made = telemetry.to_folder(logs, str(tmp_path), "g", "r", compress=True)
    assert os.listdir(tmp_path) == ["g-r.jsonl.gz"] and gzip.open(made.detail).read().count(b"\n") == 1
    answers, slept = [(503, {}), (429, {"Retry-After": "7"}), (200, {})], []
    assert telemetry.to_http(logs, "http://x", lambda *a: answers.pop(0), sleep=slept.append).ok and slept == [1.0, 7.0]
    assert not telemetry.to_http(logs, "http://x", lambda *a: (400, {})).ok and telemetry.pause(10) == 30.0
    ok, bad = telemetry.Delivery("a", True), telemetry.Delivery("b", False)
    assert len(telemetry.deliver([lambda: bad, lambda: ok, lambda: 1 / 0])) == 3
    with pytest.raises(EngineError):
        telemetry.deliver([lambda: bad])
