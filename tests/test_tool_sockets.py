"""Rows of tools that list sockets: names of columns, ends, and what is refused."""

import pytest

from tidelog.sources import memory_sockets

ROW = "evidence_id string, plugin string, execution_id string, row_index int, row map<string,string>"


def read(spark, *rows, plugin="windows.netscan"):
    df = spark.createDataFrame([("E", plugin, "X", k, row) for k, row in enumerate(rows)], ROW)
    return memory_sockets.sockets(df).orderBy("row_index").collect()


@pytest.mark.parametrize(
    "at, port, want",
    [
        ("10.0.0.1", "80", ("10.0.0.1", 80)), ("10.0.0.1:443", None, ("10.0.0.1", 443)), ("10.0.0.1:443", "80", ("10.0.0.1", 80)), ("10.0.0.1:443", "*", ("10.0.0.1", 443)), ("[FE80::1]:22", None, ("fe80::1", 22)), ("[FE80::1]", "0x16", ("fe80::1", 22)),
        ("fe80::1", "1", ("fe80::1", 1)), ("::", "0", ("::", 0)), ("*:*", None, ("*", None)), ("*", "*", ("*", None)), (" - ", "n/a", (None, None)), (None, None, (None, None)), ("10.0.0.1:x", None, "INVALID_PORT"), ("a", "70000", "INVALID_PORT"), ("a", "-5", "INVALID_PORT"), ("a\u0001b ", None, ("ab", None)),
    ],
)
def test_ends(spark, at, port, want):
    for names in (("LocalAddr", "LocalPort"), ("Foreign Address", "RPort")):
        r = read(spark, {"Proto": "tcp", **{n: v for n, v in zip(names, (at, port)) if v is not None}})[0]
        got = (r.local_address, r.local_port) if names[0] == "LocalAddr" else (r.remote_address, r.remote_port)
        assert (r.reason == want) if isinstance(want, str) else (r.reason is None and got == want)


def test_names_by_plugin_and_refusals(spark):
    win = read(spark, {"Proto": "tcp ", "Owner": "a.exe", "OwnerPID": "12", "TimeCreated": "2024-01-01T00:00:00Z", "Offset": "255", "State": "*"}, {"Family": "AF_INET"}, {"Proto": "TCP", "Protocol": "tcp", "PID": "5", "Pid": "0x5"}, {"Proto": "TCP", "Protocol": "udp"}, {"Proto": "n/a"}, {"Proto": "T", "PID": "x"}, {"Proto": "T", "PID": "-", "Pid": ""}, {"Proto": "T", "State": "a", "Status": "b"}, None)
    assert (win[0].protocol, win[0].process_name, win[0].pid, win[0].offset, win[0].created_class, win[0].created_us, win[0].state) == ("TCP", "a.exe", 12, "0xff", 0, 1704067200_000000, None)
    assert [r.reason for r in win] == [None, "MISSING_PROTOCOL", None, "CONFLICTING_ALIASES", "MISSING_PROTOCOL", "INVALID_PID", None, "CONFLICTING_ALIASES", "MALFORMED_RECORD"]
    assert win[2].pid == 5
    linux = read(spark, {"Family": "AF_INET", "COMM": "sshd", "Owner": "x", "OwnerPID": "7"}, plugin="linux.sockstat")[0]
    assert (linux.protocol, linux.process_name, linux.pid, linux.reason) == ("AF_INET", "sshd", None, None)


def test_duplicates_are_one_artifact(spark):
    rows = [("E", "p", "X", k, {"Proto": "tcp", "LocalAddr": "a:1" if k != 2 else "A", **({"LPort": "1"} if k == 2 else {})}) for k in range(4)] + [("F", "p", "X", 0, {"Proto": "tcp", "LocalAddr": "a:1"})]
    out = memory_sockets.artifacts(spark.createDataFrame(rows, ROW)).collect()
    assert sorted((r.evidence_id, list(r.row_indices), r.duplicates) for r in out) == [("E", [0, 1, 2, 3], 3), ("F", [0], 0)] and len({r.artifact_id for r in out}) == 2
    assert memory_sockets.sockets(spark.createDataFrame([], ROW)).count() == 0
