"""Flow telemetry as OTLP log records: payload, and delivery to a folder or over HTTP."""

from __future__ import annotations

import gzip
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..errors import EngineError

#: Answers after which a delivery is tried again, and the longest pause between tries (fixed values).
RETRIED, LONGEST = (429, 500, 502, 503, 504), 30.0
#: Seconds that one request may take.
TIMEOUT = 30.0
#: Rows of one request of the streaming sink.
POSTED = 1_000
#: Severity numbers of the log data model (fixed values).
SEVERITY = {"INFO": 9, "WARN": 13, "ERROR": 17}


def attribute(key: str, value: object) -> dict:
    kind = "boolValue" if isinstance(value, bool) else "intValue" if isinstance(value, int) else "doubleValue" if isinstance(value, float) else "stringValue"
    return {"key": key, "value": {kind: str(value) if kind in ("stringValue", "intValue") else value}}


def resource_logs(rows: Sequence[Mapping], service: str = "sluice") -> list[dict]:
    """One entry per pipeline of rows (pipeline, flow, level, message, time_ms, further attributes)."""
    by: dict[str, list[dict]] = {}
    for r in rows:
        extra = [attribute(k, v) for k, v in r.items() if k not in ("pipeline", "level", "message", "time_ms") and v is not None]
        record = {"timeUnixNano": str(int(r["time_ms"]) * 1_000_000), "severityText": r["level"], "severityNumber": SEVERITY.get(r["level"], 9), "body": {"stringValue": r["message"]}, "attributes": extra}
        by.setdefault(r["pipeline"], []).append(record)
    return [{"resource": {"attributes": [attribute("service.name", service), attribute("pipeline.id", p)]}, "scopeLogs": [{"scope": {"name": service}, "logRecords": records}]} for p, records in sorted(by.items())]


@dataclass(frozen=True)
class Delivery:
    destination: str
    ok: bool
    detail: str = ""


def to_folder(logs: Sequence[Mapping], folder: str, group: str, run: str, compress: bool = False) -> Delivery:
    """One JSON line per entry under a name that a second delivery of the run overwrites."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{group}-{run}.jsonl" + (".gz" if compress else ""))
    data = "".join(json.dumps(x, sort_keys=True) + "\n" for x in logs).encode()
    with open(path + ".part", "wb") as f:
        f.write(gzip.compress(data, mtime=0) if compress else data)
    os.replace(path + ".part", path)
    return Delivery(folder, True, path)


def pause(attempt: int, first: float = 1.0, said: str | None = None) -> float:
    """Seconds before the next try: what the server said, else doubling; never over LONGEST."""
    return min(LONGEST, float(said) if said and said.replace(".", "", 1).isdigit() else first * 2**attempt)


def to_http(logs: Sequence[Mapping], url: str, post: Callable[[str, bytes, dict], tuple[int, dict]] | None = None, headers: Mapping[str, str] | None = None, tries: int = 5, sleep=time.sleep) -> Delivery:
    """Posts the logs; answers in RETRIED and network errors are tried again, after a pause that doubles."""
    body, post, said = json.dumps({"resourceLogs": list(logs)}).encode(), post or http_post, "no try"
    for attempt in range(tries):
        wait = None
        try:
            status, answer = post(url, body, {"Content-Type": "application/json", **(headers or {})})
        except OSError as e:
            said = f"{type(e).__name__}: {e}"
        else:
            said, wait = str(status), answer.get("Retry-After")
            if status < 300:
                return Delivery(url, True, said)
            if status not in RETRIED:
                break
        if attempt + 1 < tries:
            sleep(pause(attempt, said=wait))
    return Delivery(url, False, said)


def http_post(url: str, body: bytes, headers: Mapping[str, str]) -> tuple[int, dict]:
    """(status, answer's headers) of one request; an error of the network is an OSError."""
    request = urllib.request.Request(url, data=body, headers=dict(headers), method="POST")
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return answer.status, dict(answer.headers)
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers)


def deliver(deliveries: Sequence[Callable[[], Delivery]]) -> list[Delivery]:
    """Runs all; one that fails does not stop the others, and only if all fail it is an error."""
    out = []
    for d in deliveries:
        try:
            out.append(d())
        except Exception as e:  # noqa: BLE001
            out.append(Delivery("?", False, str(e)))
    if out and not any(d.ok for d in out):
        raise EngineError(f"no destination took the telemetry: {[d.detail for d in out]}")
    return out


class OtlpWriter(DataSourceStreamWriter):
    """Each task posts its rows, grouped by pipeline, in requests of bounded size; one that fails fails the batch.

    Options: url, header.<name>, tries. The rows have pipeline, level, message, time_ms and further attributes.
    """

    def __init__(self, schema, options):
        self.names, self.url, self.tries = schema.names, options["url"], int(options.get("tries", 5))
        # Option names come in lower case; header names don't depend on it.
        self.headers = {k.removeprefix("header."): v for k, v in options.items() if k.startswith("header.")}
        if absent := {"pipeline", "level", "message", "time_ms"} - set(self.names):
            raise EngineError(f"OTLP sink: columns are missing: {sorted(absent)}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        held: list[dict] = []

        def send() -> None:
            if held and not (made := to_http(resource_logs(held), self.url, headers=self.headers, tries=self.tries)).ok:
                raise EngineError(f"{self.url} did not take the telemetry: {made.detail}")
            held.clear()

        for row in iterator:
            held.append(dict(zip(self.names, row)))
            if len(held) >= POSTED:
                send()
        send()
        return WriterCommitMessage()


class OtlpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "otlp"

    def streamWriter(self, schema, overwrite: bool) -> OtlpWriter:  # noqa: N802
        return OtlpWriter(schema, self.options)
