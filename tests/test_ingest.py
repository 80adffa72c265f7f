"""What comes in: lines that try to hide, numbers of lines, late rows, documents of memory tools."""

import gzip
import json
import os
import random
import re

import pytest

from tidelog.operators import memory, memory_timeline, rules, timeline
from tidelog.sources import lines, logs, memory_documents
from tidelog.sources import memory as tools
from tidelog.streaming import lanes, streams

AT = "2024-01-01T00:00:00Z h "
S = "\u0001"


@pytest.mark.parametrize(
    "line, want",
    [
        (f"sshd[1]: Failed password for evil{S}203.0.113.9 from 10.0.0.1 port 22", ("ssh_login_failure", f"evil{S}203.0.113.9", "10.0.0.1", 22, None)),
        (f"sshd[1]: Failed\tpassword\tfor\tinvalid  user {S}{S} from 10.0.0.1 port 22", ("ssh_invalid_user", f"{S}{S}", "10.0.0.1", 22, None)),
        (f"sshd[1]: Accepted publickey for ü{S} from fe80::1 port 22 ssh2{S}", ("ssh_login_success", f"ü{S}", "fe80::1", 22, None)),
        (f"sudo: a{S}b : TTY=t ; PWD=/{S} ; USER=root ; COMMAND=/bin/x {S} y{S}", ("sudo_command", f"a{S}b", None, None, f"/bin/x {S} y{S}")),
        (f"cron[7]: pam_unix(cron:session): session opened for user{S} x {S}u", ("generic_syslog", None, None, None, None)),
        (f"cron[7]: pam_unix(cron:session): session opened for user {S}u", ("session_open", f"{S}u", None, None, None)),
        (f"kernel: one{S}two{S}{S}three", ("generic_syslog", None, None, None, None)),
    ],
)
def test_control_characters_hide_nothing(spark, line, want):
    lines = spark.createDataFrame([("f", 1, AT + line)], "source_path string, line_number long, line string")
    r = logs.parse_logs(lines).collect()[0]
    assert (r.event_type, r.user, r.src_ip, r.src_port, r.command) == want
    assert r.message == line.split(": ", 1)[1] and r.hostname == "h" and r.ts_class == 0


def test_a_line_of_no_form_keeps_its_text(spark):
    lines = spark.createDataFrame([("f", 1, f"a{S}b{S}c{S}d{S}e{S}f"), ("f", 2, S)], "source_path string, line_number long, line string")
    assert [(r.event_type, r.message, r.hostname) for r in logs.parse_logs(lines).orderBy("line_number").collect()] == [("unknown_format", f"a{S}b{S}c{S}d{S}e{S}f", None), ("unknown_format", S, None)]


def test_numbers_of_files_in_many_blocks(spark, tmp_path, monkeypatch):
    whole = b"".join(b"%d %s%s" % (k, b"x" * (k * 7919 % 90), (b"\n", b"\r\n", b"\r")[k % 3]) for k in range(3000)) + b"bad \xff\xfe\nlast"
    (tmp_path / "a.log").write_bytes(whole)
    (tmp_path / "b.log").write_bytes(b"\n\n")
    (tmp_path / "none.log").write_bytes(b"")
    with gzip.open(tmp_path / "c.log.gz", "wb") as f:
        f.write(b"x\ny\n" * 500)
    want = {("a.log", k + 1, t) for k, t in enumerate(re.split("\r\n|\r|\n", whole.decode("utf-8", "replace")))} | {("b.log", k, "") for k in (1, 2)} | {("c.log.gz", k + 1, "xy"[k % 2]) for k in range(1000)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for few in (lines.BROADCAST_BLOCKS, 0):
            monkeypatch.setattr(lines, "BROADCAST_BLOCKS", few)
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
            got = [(os.path.basename(r.source_path), r.line_number, r.line) for r in lines.read_lines(spark, str(tmp_path)).collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def line(second, text="Failed password for u from 10.0.0.1 port 22", zone="+00:00"):
    return f"2024-01-01T10:{second // 60:02d}:{second % 60:02d}{zone} h sshd[1]: {text}"


def deliver(spark, tmp_path, name, *rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("\n".join(rows) + "\n")
    lanes.ingest_logs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 60)


def lane(spark, tmp_path, name):
    return sorted((r.batch, os.path.basename(r.source_path), r.line_number) for r in lanes.read_lane(spark, str(tmp_path / "out"), name).collect())


def test_late_rows_have_a_lane(spark, tmp_path):
    deliver(spark, tmp_path, "a.log", line(100), line(200), "no header", line(150, zone=""))
    deliver(spark, tmp_path, "b.log", line(141), line(140), line(139), line(300))  # 200 s less 60 s is the bound: what is not after it is late
    deliver(spark, tmp_path, "c.log", "nothing with a time")
    deliver(spark, tmp_path, "d.log", line(240), line(241), line(500))
    assert lane(spark, tmp_path, "on_time") == [(0, "a.log", 1), (0, "a.log", 2), (1, "b.log", 1), (1, "b.log", 4), (3, "d.log", 2), (3, "d.log", 3)]
    assert lane(spark, tmp_path, "late") == [(1, "b.log", 2), (1, "b.log", 3), (3, "d.log", 1)]
    assert lane(spark, tmp_path, "untimed") == [(0, "a.log", 3), (0, "a.log", 4), (2, "c.log", 1)]
    marks = [tuple(r) for r in lanes.read_marks(spark, str(tmp_path / "out")).orderBy("batch").select("batch", "on_time", "late", "untimed").collect()]
    assert marks == [(0, 2, 0, 2), (1, 2, 2, 0), (2, 0, 0, 1), (3, 2, 1, 0)]


def test_a_batch_run_again_writes_the_same(spark, tmp_path):
    deliver(spark, tmp_path, "a.log", line(100), line(200))
    deliver(spark, tmp_path, "b.log", line(10), line(300))
    before = {n: lane(spark, tmp_path, n) for n in ("on_time", "late", "untimed")}
    raw = spark.read.text(str(tmp_path / "in" / "b.log")).select(*lines.place(), "value")
    lanes.Lanes(str(tmp_path / "out"), 60, lanes.parsed_lines())(raw, 1)
    assert {n: lane(spark, tmp_path, n) for n in before} == before and before["late"] == [(1, "b.log", 1)]


def test_ids_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    deliver(spark, tmp_path, "a.log", line(1), line(1), line(2), "no header")
    deliver(spark, tmp_path, "b.log", line(1), line(2))
    live = spark.read.parquet(str(tmp_path / "out")).drop("batch", "lane")
    ids = lambda rows: sorted(r.event_id for r in timeline.log_events(rows).collect())
    batch = ids(logs.parse_logs(lines.read_lines(spark, str(tmp_path / "in"))))
    assert ids(live) == batch and len(set(batch)) == 6


def test_state_is_bounded_by_the_delay(spark, tmp_path):
    """Twelve deliveries of a minute each, with repeats: what is on time loses nothing in a de-duplicating stream, which keeps the last minutes only."""
    for k in range(12):
        deliver(spark, tmp_path, f"{k:02d}.log", *(line(60 * k + s, f"Failed password for u{s % 2} from 10.0.0.1 port {s}") for s in range(0, 60, 2)), line(60 * k, "Failed password for u0 from 10.0.0.1 port 0"))
    rows = lanes.stream_lane(spark, str(tmp_path / "out"))
    kept = streams.deduplicate(rows, ["line"], 60)
    query = kept.select("line").writeStream.format("parquet").option("path", str(tmp_path / "once")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 12 * 30
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 0 and lanes.read_lane(spark, str(tmp_path / "out"), "late").count() == 0
    (tmp_path / "in" / "z.log").write_text(line(3599) + "\n")
    lanes.ingest_logs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 60)
    query = kept.select("line").writeStream.format("parquet").option("path", str(tmp_path / "once")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # all that was a delay behind is gone


U = "0123456789abcdef0123456789abcdef"


def load(spark, *documents):
    text = lambda d: d if d is None or isinstance(d, str) else json.dumps(d)
    return memory_documents.load(spark.createDataFrame([(f"d{k}", text(d)) for k, d in enumerate(documents)], "source string, value string"))


def process(**more):
    return {"artifact_id": f"MEMPROC-{U}", "evidence_id": "MEM-1", "pid": 7, "process_name": "sh"} | more


def test_memory_documents_by_shape(spark):
    socket, module = {"artifact_id": f"MEMNET-{U}", "evidence_id": "MEM-1", "protocol": "TCP"}, {"artifact_id": f"MEMMOD-{U}", "evidence_id": "MEM-1", "module_name": "m"}
    event = {"event_id": f"MEMEVT-{U}", "evidence_id": "MEM-1", "timestamp": "2024-01-01T00:00:00Z"}
    out = load(spark, [process(), socket], {"artifacts": [module, event, [process()]]}, process(pid="8"), {"artifacts": {"a": 1}}, '[{"pid": 1', "", None, "7", "[]", [None, "x", '{"pid": 1}'])
    got = sorted((r.source, -1 if r.position is None else r.position, r.kind or "", r.reason or "") for r in out.collect())
    assert got == [
        ("d0", 0, "process", ""), ("d0", 1, "socket", ""), ("d1", 0, "module", ""), ("d1", 1, "event", ""), ("d1", 2, "", "NO_OBJECT"), ("d2", 0, "process", ""), ("d3", 0, "", "UNKNOWN_SHAPE"), ("d4", -1, "", "UNREADABLE_DOCUMENT"),
        ("d5", -1, "", "UNREADABLE_DOCUMENT"), ("d6", -1, "", "UNREADABLE_DOCUMENT"), ("d7", -1, "", "UNREADABLE_DOCUMENT"), ("d9", 0, "", "NO_OBJECT"), ("d9", 1, "", "NO_OBJECT"), ("d9", 2, "", "NO_OBJECT"),
    ]
    assert memory_documents.processes(out).count() == 2 and memory_documents.refused(out).count() == 9


@pytest.mark.parametrize(
    "changed, reason",
    [
        ({}, None), ({"pid": "12"}, None), ({"pid": 3.7}, None), ({"pid": "x"}, "INVALID_PID"), ({"pid": -1}, "INVALID_PID"), ({"pid": None}, "INVALID_PID"), ({"ppid": -2}, "INVALID_PPID"), ({"ppid": None}, None),
        ({"artifact_id": "MEMPROC-1"}, "INVALID_ID"), ({"artifact_id": "other"}, "INVALID_ID"), ({"artifact_id": None}, "MISSING_ID"), ({"artifact_id": 5}, "INVALID_ID"), ({"evidence_id": " "}, "MISSING_EVIDENCE"),
        ({"process_name": "\u0001 "}, "MISSING_NAME"), ({"local_port": 70000}, "INVALID_PORT"), ({"local_port": "70"}, None),
    ],
)
def test_refused_objects(spark, changed, reason):
    r = load(spark, process(**changed)).collect()[0]
    assert (r.kind, r.reason) == ("process", reason)


def test_memory_timeline_order_and_duplicates(spark):
    p = process(created_at="2024-01-01T10:00:00+02:00", exit_time="2024-01-01 09:00:00", raw_attributes={"a": 1, "b": [2]}, source_row_indices=[4])
    out = memory_timeline.reconstruct(load(spark, [p, process(created_at="N/A", exit_time="-", pid=9)], [p], {**p, "created_at": "2024-01-01T08:00:00Z"}, [{**p, "evidence_id": "MEM-0"}])).collect()
    got = [(r.ts_class, r.ts_us, r.event_type, r.evidence_id, r.raw_timestamp, r.n) for r in out]
    at = 1704096000_000000
    assert got == [
        (0, at, "process_created", "MEM-0", "2024-01-01T10:00:00+02:00", 1), (0, at, "process_created", "MEM-1", "2024-01-01T08:00:00Z", 1), (0, at, "process_created", "MEM-1", p["created_at"], 2),
        (1, at + 3600_000000, "process_exited", "MEM-0", p["exit_time"], 1), (1, at + 3600_000000, "process_exited", "MEM-1", p["exit_time"], 3), (2, None, "process_observed", "MEM-1", None, 1),
    ]
    assert out[1].attributes == {"a": "1", "b": "[2]"}
    assert load(spark).count() == 0 and memory_timeline.reconstruct(load(spark)).count() == 0


def test_triage_keeps_evidence_apart(spark):
    made = lambda k, **m: process(artifact_id=f"MEMPROC-{k:032x}", **m)
    a = [made(1, pid=5, created_at="2024-01-01T10:00:00Z"), made(2, pid=6, ppid=5, created_at="2024-01-01T10:00:01Z", process_name="x")]
    b = [made(3, pid=5, evidence_id="MEM-2"), made(3, pid=5, evidence_id="MEM-2"), {"artifact_id": "MEMMOD-1", "evidence_id": "MEM-2", "module_name": "m"}]
    within = rules.Rule("two", event_types=("process_created", "process_observed"), window=300.0)
    got = {(r.evidence_id, r.measure, r.name): r.n for r in memory_timeline.triage(load(spark, a, b), [rules.memory_process_rule(["sh", "x"]), within]).collect()}
    assert got[("MEM-1", "links", "PARENT_CHILD_PROCESS")] == 1 and ("MEM-2", "links", "PARENT_CHILD_PROCESS") not in got
    assert got[("MEM-2", "duplicates", "all")] == 1 and got[("MEM-2", "class", "unanchored")] == 1 and got[("MEM-2", "refused", "INVALID_ID")] == 1
    assert got[("MEM-1", "rule", "Memory process name")] == 2 and got[("MEM-2", "rule", "Memory process name")] == 1 and not any(k[2] == "two" for k in got)


def test_paths_and_addresses_of_modules(spark):
    r = random.Random(5)
    paths = ["/a/b/c.ko", "c.ko", "/B/c.ko ", "o", ".ko", "/x", "", " ", None, "/very/long" * 30 + "/c.ko"]
    ps = [(f"E{k % 2}", f"p{k}", r.choice(paths), r.choice([None, "", "0x10-0x20;0x7f00", "0x7f0012"])) for k in range(40)]
    ms = [(f"E{k % 2}", f"m{k}", r.choice(paths), r.choice([None, "", "0x10", "0x7f00", "0xdead"])) for k in range(40)]
    fold = lambda x: (x or "").strip().lower()
    want = set()
    for e, p, image, regions in ps:
        for f, m, own, base in ms:
            by_path = e == f and fold(image) and fold(own) and (fold(image).endswith(fold(own)) or fold(own).endswith(fold(image)))
            if by_path or (e == f and base and base in (regions or "")):
                want.add((p, m, bool(by_path) and fold(image) == fold(own), "path_binding" if by_path else "base_address_binding"))
    out = memory.process_module(spark.createDataFrame(ps, "evidence_id string, artifact_id string, image_path string, memory_regions string"), spark.createDataFrame(ms, "evidence_id string, artifact_id string, path string, base_address string"))
    got = [(x.from_id, x.to_id, x.exact, x.binding) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want and {w[3] for w in want} == {"path_binding", "base_address_binding"}


def test_documents_that_begin_inside_a_line(spark):
    rows = spark.createDataFrame([("a", 'progress 100 [{"PID": 5}]'), ("b", 'x {"rows": [{"PID": 6}]} done'), ("c", 'log [1]\n[{"PID": 7}]\nend'), ("d", "no document [ here")], "source string, value string")
    got = sorted((r.source, (r.row or {}).get("PID"), r.reason) for r in tools.read_tool_json(rows).collect())
    assert got == [("a", "5", None), ("b", "6", None), ("c", "7", None), ("d", None, "UNREADABLE_DOCUMENT")]
