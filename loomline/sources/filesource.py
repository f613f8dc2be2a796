"""Spark data sources (Python Data Source API) for whole-file formats: traces, findings logs and test reports.

register(spark) makes the formats known; then spark.read.format("otlp_traces").load(path), spark.readStream.format(...), df.write.format(...).save(path). path is a
file or a folder, on any file system that pyarrow opens (local, HDFS, S3): executors open the files themselves. Reading deals files out into partitions
by size; a stream reads files once each, in order of their time and name; a writer's files appear when the job commits, and a failed job leaves none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PARTITION_BYTES = 32 << 20


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[int, str, int]]:
    """(time in ns, path, size) of the files of a folder and its folders, by time and path; hidden ones and those without the suffix aside."""
    from pyarrow import fs

    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffix)]
    below = lambda f: f.path[len(at) :].lstrip("/")
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found if not any(p.startswith(("_", ".")) for p in below(f).split("/")))


@dataclass
class Files(InputPartition):
    """The files of one task."""

    paths: tuple[str, ...]


def packed(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Files in their order, so many together that a partition has about `most` bytes."""
    out: list[list[str]] = []
    room = 0
    for _, path, size in files:
        if not out or room < size:
            out.append([])
            room = most
        out[-1].append(path)
        room -= size
    return [Files(tuple(p)) for p in out]


class FileFormat(DataSource):
    """A format whose files hold a whole document each. A subclass has name, suffix, columns (DDL), parse() and, if it can be written, render()."""

    suffix = ""
    columns = ""

    @staticmethod
    def parse(data: bytes) -> Iterable[tuple]:
        """The rows of a file."""
        raise NotImplementedError

    @staticmethod
    def render(rows: Iterable[dict]) -> bytes:
        """A file of rows."""
        raise NotImplementedError

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options, self.suffix, self.parse)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options, self.suffix, self.parse)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, self.suffix, self.render, overwrite)


def rows_of(files: Files, root: str, parse) -> Iterator[tuple]:
    system, _ = opened(root)
    for path in files.paths:
        with system.open_input_stream(path) as f:
            data = f.read()
        try:
            rows = list(parse(data))
        except Exception as e:
            raise ValueError(f"cannot read {path}: {e}") from e
        yield from rows


class Reader(DataSourceReader):
    def __init__(self, options, suffix: str, parse):
        self.path, self.most, self.suffix, self.parse = options["path"], int(options.get("partitionBytes", PARTITION_BYTES)), suffix, parse

    def partitions(self) -> list[Files]:
        return packed(listed(self.path, self.suffix), self.most) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(partition, self.path, self.parse)


class StreamReader(DataSourceStreamReader):
    """Offsets are the time and path of the last file."""

    def __init__(self, options, suffix: str, parse):
        self.path, self.most, self.suffix, self.parse = options["path"], int(options.get("partitionBytes", PARTITION_BYTES)), suffix, parse

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path, self.suffix)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        key = lambda o: (o["time"], o["path"])
        return packed([f for f in listed(self.path, self.suffix) if key(start) < f[:2] <= key(end)], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(partition, self.path, self.parse)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    paths: tuple[str, ...]


class Writer(DataSourceWriter):
    """Tasks write under hidden names; the driver renames what the committed tasks wrote, and deletes the rest."""

    def __init__(self, options, suffix: str, render, overwrite: bool):
        self.path, self.most, self.suffix, self.render, self.overwrite = options["path"], int(options.get("rowsPerFile", 50_000)), suffix, render, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from itertools import batched

        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        paths = []
        for rows in batched(iterator, self.most):
            paths.append(f"{at}/_{self.job}-{uuid.uuid4().hex}{self.suffix}")
            with system.open_output_stream(paths[-1]) as f:
                f.write(self.render([r.asDict(recursive=True) for r in rows]))
        return Written(tuple(paths))

    def commit(self, messages: list[Written]) -> None:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        before = [p for _, p, _ in listed(self.path, self.suffix)] if self.overwrite else []
        new = [p for m in messages if m for p in m.paths]
        for p in new:
            system.move(p, p.replace(f"/_{self.job}-", "/part-"))
        for p in before:
            system.delete_file(p)
        self._clean()

    def abort(self, messages: list[Written]) -> None:
        self._clean()

    def _clean(self) -> None:
        """What tasks that failed or ran twice have left."""
        from pyarrow import fs

        system, at = opened(self.path)
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                system.delete_file(f.path)


def from_any(v: dict | None) -> str | None:
    """The text of a typed value; arrays and key lists as JSON."""
    if not v:
        return None
    kind, x = next(iter(v.items()))
    if kind == "boolValue":
        return "true" if x else "false"
    if kind == "arrayValue":
        return json.dumps([from_any(e) for e in x.get("values", [])], ensure_ascii=False)
    if kind == "kvlistValue":
        return json.dumps({e["key"]: from_any(e.get("value")) for e in x.get("values", [])}, ensure_ascii=False)
    return str(x)


def to_any(text: str | None) -> dict:
    """The typed value of a text: a JSON array or object, else bool before int before double before string."""
    import re

    if text is None:
        return {}
    if text[:1] in ("[", "{"):
        try:
            x = json.loads(text)
        except ValueError:
            return {"stringValue": text}
        plain = lambda e: e if isinstance(e, str) or e is None else json.dumps(e, ensure_ascii=False)
        if isinstance(x, list):
            return {"arrayValue": {"values": [to_any(plain(e)) for e in x]}}
        return {"kvlistValue": {"values": [{"key": k, "value": to_any(plain(e))} for k, e in x.items()]}}
    if text in ("true", "false"):
        return {"boolValue": text == "true"}
    if re.fullmatch(r"-?\d{1,18}", text):
        return {"intValue": text}
    if re.fullmatch(r"-?\d+\.\d+", text):
        return {"doubleValue": float(text)}
    return {"stringValue": text}


def _attributes(items: list | None) -> dict:
    return {a["key"]: from_any(a.get("value")) for a in items or []}


def _ms(nanos: str | int | None) -> float | None:
    return None if nanos is None else int(nanos) / 1e6


def _nanos(ms: float | None) -> str:
    return str(round((ms or 0.0) * 1000) * 1000)


class Traces(FileFormat):
    """OTLP trace files in JSON: a row a span. Resource attributes come with each span. Times are milliseconds, to the microsecond when written."""

    suffix = ".json"
    columns = (
        "trace_id string, span_id string, parent_span_id string, name string, kind int, start_ms double, end_ms double, attributes map<string,string>, "
        "events array<struct<name:string,at_ms:double,attributes:map<string,string>>>, status_code int, status_message string, scope string, resource map<string,string>"
    )

    @classmethod
    def name(cls) -> str:
        return "otlp_traces"

    @staticmethod
    def parse(data: bytes) -> Iterator[tuple]:
        for r in (json.loads(data) if data.strip() else {}).get("resourceSpans") or []:
            resource = _attributes((r.get("resource") or {}).get("attributes"))
            for scope in r.get("scopeSpans") or []:
                for s in scope.get("spans") or []:
                    events = [(e.get("name"), _ms(e.get("timeUnixNano")), _attributes(e.get("attributes"))) for e in s.get("events") or []]
                    status = s.get("status") or {}
                    yield (s.get("traceId"), s.get("spanId"), s.get("parentSpanId") or None, s.get("name"), s.get("kind", 0), _ms(s.get("startTimeUnixNano")), _ms(s.get("endTimeUnixNano")), _attributes(s.get("attributes")), events, status.get("code", 0), status.get("message", ""), (scope.get("scope") or {}).get("name"), resource)

    @staticmethod
    def render(rows: Iterable[dict]) -> bytes:
        listed_ = lambda m: [{"key": k, "value": to_any(v)} for k, v in sorted((m or {}).items())]
        groups: dict[str, dict] = {}
        for r in rows:
            resource, scope = listed_(r.get("resource")), r.get("scope")
            group = groups.setdefault(json.dumps([resource, scope]), {"resource": {"attributes": resource}, "scopeSpans": [{"scope": {"name": scope} if scope else {}, "spans": []}]})
            span = {"traceId": r["trace_id"], "spanId": r["span_id"], "name": r["name"], "kind": r.get("kind") or 0, "startTimeUnixNano": _nanos(r["start_ms"]), "endTimeUnixNano": _nanos(r["end_ms"]), "attributes": listed_(r.get("attributes"))}
            if r.get("parent_span_id"):
                span["parentSpanId"] = r["parent_span_id"]
            if r.get("events"):
                span["events"] = [{"name": e["name"], "timeUnixNano": _nanos(e["at_ms"]), "attributes": listed_(e["attributes"])} for e in r["events"]]
            span["status"] = {"code": r.get("status_code") or 0} | ({"message": r["status_message"]} if r.get("status_message") else {})
            group["scopeSpans"][0]["spans"].append(span)
        return json.dumps({"resourceSpans": list(groups.values())}, ensure_ascii=False).encode()


class Findings(FileFormat):
    """SARIF 2.1.0 logs: a row a result."""

    suffix = ".sarif"
    columns = "tool string, rule_id string, level string, message string, file_path string, line int, fingerprint string"

    @classmethod
    def name(cls) -> str:
        return "sarif_results"

    @staticmethod
    def parse(data: bytes) -> Iterator[tuple]:
        for run in (json.loads(data) if data.strip() else {}).get("runs") or []:
            tool = ((run.get("tool") or {}).get("driver") or {}).get("name")
            for r in run.get("results") or []:
                at = ((r.get("locations") or [{}])[0] or {}).get("physicalLocation") or {}
                prints = r.get("partialFingerprints") or {}
                yield (tool, r.get("ruleId"), r.get("level", "warning"), (r.get("message") or {}).get("text"), (at.get("artifactLocation") or {}).get("uri"), (at.get("region") or {}).get("startLine"), next(iter(prints.values()), None))

    @staticmethod
    def render(rows: Iterable[dict]) -> bytes:
        runs: dict[str, list] = {}
        for r in rows:
            place = {"artifactLocation": {"uri": r["file_path"]}} | ({"region": {"startLine": r["line"]}} if r.get("line") is not None else {})
            result = {"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": place}]}
            runs.setdefault(r["tool"], []).append(result | ({"partialFingerprints": {"primary": r["fingerprint"]}} if r.get("fingerprint") else {}))
        return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": t}}, "results": x} for t, x in runs.items()]}, ensure_ascii=False).encode()


class TestReports(FileFormat):
    """JUnit XML reports: a row a test case, over nested suites."""

    __test__ = False
    suffix = ".xml"
    columns = "suite string, file string, name string, seconds double, outcome string, message string"

    @classmethod
    def name(cls) -> str:
        return "junit_cases"

    @staticmethod
    def parse(data: bytes) -> Iterator[tuple]:
        from xml.etree import ElementTree

        def walk(node, suite):
            if node.tag == "testcase":
                bad = next((c for c in node if c.tag in ("failure", "error", "skipped")), None)
                outcome = "passed" if bad is None else {"failure": "failed"}.get(bad.tag, bad.tag)
                yield (suite, node.get("file") or node.get("classname"), node.get("name"), float(node.get("time") or 0), outcome, None if bad is None else bad.get("message") or (bad.text or "").strip() or None)
            for child in node:
                yield from walk(child, node.get("name") if node.tag == "testsuite" else suite)

        return walk(ElementTree.fromstring(data), None)

    @staticmethod
    def render(rows: Iterable[dict]) -> bytes:
        from xml.etree import ElementTree

        top, suites = ElementTree.Element("testsuites"), {}
        for r in rows:
            name = r.get("suite") or ""
            suite = suites[name] if name in suites else suites.setdefault(name, ElementTree.SubElement(top, "testsuite", {"name": name} if name else {}))
            case = ElementTree.SubElement(suite, "testcase", {"file": r["file"] or "", "name": r["name"] or "", "time": repr(r.get("seconds") or 0.0)})
            tag = {"failed": "failure"}.get(r["outcome"], r["outcome"])
            if tag != "passed":
                ElementTree.SubElement(case, tag, {"message": r["message"]} if r.get("message") else {})
        return ElementTree.tostring(top, encoding="utf-8")


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (Traces, Findings, TestReports):
        spark.dataSource.register(source)
