"""Small literal rows: boundaries, missing times, identities, rules, chains."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tidelog.functions import ids, net, paths, times
from tidelog.operators import correlate, integrity, rules, timeline
from tidelog.sources import accounts, lines, logs, memory, network, persistence
from tidelog.streaming import streams

EVENT = "event_id string, ts_class int, ts_us long, category string, event_type string, username string, source_ip string, source_path string, session_id string, status string, source_artifact_id string, source_line long, source_event_id string, description string, raw_data string"


def events(spark, *rows):
    """(id, class, seconds, type, user)"""
    full = [(i, c, None if s is None else int(s * 1_000_000), "authentication", t, u, None, "f", None, "SUCCESS", None, k, None, "d", None) for k, (i, c, s, t, u) in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def pairs(df):
    return sorted((r.event_a, r.event_b) for r in df.collect())


def test_window_bounds_are_included(spark):
    e = events(spark, ("a", 0, 0, "x", "u"), ("b", 0, 300, "x", "v"), ("c", 0, 300.000001, "x", "w"))
    assert pairs(correlate.temporal(e)) == [("a", "b"), ("b", "c")]


def test_classes_never_compare(spark):
    e = events(spark, ("a", 0, 0, "x", "u"), ("b", 1, 0, "x", "u"), ("c", 2, None, "x", "u"))
    assert pairs(correlate.temporal(e)) == []
    assert pairs(correlate.same_user(e)) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert pairs(correlate.same_user(e, untimed=False)) == []


def test_bucketed_join_equals_nested_loop(spark):
    rows = [(f"e{k}", k % 3 // 2, (k * 7919) % 5000, "x", f"u{k % 3}") for k in range(120)]
    want = sorted(tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 100)
    assert pairs(correlate.temporal(events(spark, *rows).repartition(7), 100.0)) == want


def test_untimed_links_count_what_the_pairs_hold(spark):
    e = events(spark, ("a", 0, 0.0, "x", "u"), ("b", 0, 10.0, "x", "u"), ("c", 1, 0.0, "x", "u"), ("d", 2, None, "x", "u"), ("e", 2, None, "x", "u"))
    apart = correlate.same_path(e).filter("delta_seconds is null").collect()
    got = {r.event_id: r.n_links for r in correlate.untimed_links(e, correlate.path_identity()).collect()}
    assert got == {k: sum(k in (r.event_a, r.event_b) for r in apart) for k in "abcde"} == {"a": 3, "b": 3, "c": 4, "d": 4, "e": 4}


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_untimed_pairs_of_busy_identities(spark, block):
    rows = [(f"e{k:02}", (0, 1, 2, 2, None)[k % 5], None if k % 5 in (2, 3) or k % 13 == 0 else 7.0 * k, "x", ("u", "u", "v", None)[k % 4]) for k in range(60)]
    known = [(r[0], 2 if r[1] is None or r[2] is None else r[1], r[4]) for r in rows if r[4]]
    want = sorted((a[0], b[0]) for a in known for b in known if a[0] < b[0] and a[2] == b[2] and (a[1] != b[1] or a[1] == 2))
    e = events(spark, *rows).withColumn("ident", correlate.user_identity()).filter("ident is not null")
    found = correlate.untimed_pairs(correlate.side(e, "a", ["ident"]), correlate.side(e, "b", ["ident"]), block)
    assert pairs(found.selectExpr("event_id_a event_a", "event_id_b event_b")) == want
    assert pairs(correlate.same_user(events(spark, *rows)).filter("delta_seconds is null")) == want


@pytest.mark.parametrize("name", ["links_same_user", "links_same_session"])
def test_links_of_equal_identity_hold_untimed_pairs(spark, sf, name):
    from tidelog.plans import queries

    assert queries.queries()[name](spark, sf).filter("delta_seconds is null").count() > 0


def test_authentication_before_privilege(spark):
    e = events(spark, ("a", 0, 10, "ssh_login_success", "u"), ("b", 0, 20, "sudo_command", "u"), ("c", 0, 5, "sudo_command", "u"), ("d", 0, 30, "sudo_command", "other"), ("n", 0, 40, "sudo_command", None))
    got = pairs(correlate.authentication_privilege(e))
    assert ("a", "b") in got and ("a", "c") not in got and ("a", "d") not in got and ("a", "n") in got


def test_sequence_takes_every_combination(spark):
    e = events(spark, ("f1", 0, 0, "ssh_login_failure", "u"), ("f2", 0, 1, "ssh_login_failure", "v"), ("s", 0, 2, "ssh_login_success", "w"), ("late", 0, 400, "ssh_login_success", "w"))
    got = sorted(r.event_ids for r in rules.sequence(e, rules.failure_then_success()).collect())
    assert got == [["f1", "s"], ["f2", "s"]]


def test_rules_refuse_code_and_endless_sequences():
    with pytest.raises(ValueError):
        rules.Rule("x", conditions=(rules.Condition("a", "equals", len),))
    with pytest.raises(ValueError):
        rules.Rule("x", event_types=("a", "b"))


def test_conditions(spark):
    df = spark.createDataFrame([("5", "true", None)], "n string, b string, m string")
    c = lambda name, *more: rules.compare(F.col(name), *more, kind=df.schema[name].dataType)
    checks = [
        # as the rules of the reference have it: a text is no number, and a missing field differs from nothing
        (c("n", "==", 5), False), (c("n", ">", 4.5), False), (c("b", "equals", 1), False), (c("m", "exists"), False), (c("m", "!=", "x"), False),
        (c("n", "in", [4, 5]), False), (c("n", "in", ["4", "5"]), True), (c("n", "ends_with", "5"), True), (c("m", "contains", "a"), False),
    ]
    for column, want in checks:
        assert df.select(column.alias("x")).first().x is want


def test_deduplication_is_idempotent(spark):
    e = events(spark, ("b", 0, 0, "x", "u"), ("a", 0, 0, "x", "u")).drop("source_line")
    e = e.withColumn("source_line", F.lit(1).cast("long"))
    once = timeline.deduplicate(e)
    assert [r.event_id for r in once.collect()] == ["a"]
    assert timeline.deduplicate(once).collect() == once.collect()


def test_times(spark):
    texts = ["2024-02-29T10:00:00Z", "2024/02/29 10:00:00", "2024-02-29 10:00:00.5 UTC", "2024-02-29", "2023-02-29T10:00:00Z", "2024-02-29T10:00:00-03:30", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c, us = times.normalize(F.col("t"))
    got = [(r.c, r.us) for r in df.select(c.alias("c"), us.alias("us")).collect()]
    base = 1709200800000000
    assert got == [(0, base), (1, base), (0, base + 500000), (2, None), (2, None), (0, base + 12600000000), (2, None), (2, None)]


def test_uuid5(spark):
    space = ids.namespace("t")
    keys = ["", "a", "grün", "x" * 300]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.u for r in df.select(ids.uuid5(space, F.col("k")).alias("u")).collect()] == [str(uuid.uuid5(space, k)) for k in keys]


def test_addresses(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("8.8.8.8",), ("256.1.1.1",), ("01.2.3.4",), ("2001:DB8::0:1",), ("100.64.1.1",), (None,)], "ip string")
    got = df.select(net.normalize_ip(F.col("ip"), ipv6=True).alias("n"), net.is_private_ip(F.col("ip")).alias("p")).collect()
    assert [(r.n, r.p) for r in got] == [("10.0.0.1", True), ("8.8.8.8", False), (None, False), (None, False), ("2001:db8::1", False), ("100.64.1.1", True), (None, False)]


def test_paths(spark):
    df = spark.createDataFrame([("./etc/passwd",), ("home/a/.ssh/id_rsa",), ("home/a/b/c.txt",), ("srv/x",)], "p string")
    assert [tuple(r) for r in df.select(*paths.classify(F.col("p"))).collect()] == [("account", "passwd", True), ("ssh", "ssh_key", True), ("user_fs", "user_file", True), ("generic", "generic_file", False)]
    bad = ["a/../b", "/a", "a\\b", "C:x", "a/", "./a", "a//b", "", None, "a/b"]
    df = spark.createDataFrame([(p,) for p in bad], "p string")
    assert [r[0] for r in df.select(paths.entry_path_status(F.col("p"))).collect()] == ["parent", "absolute", "backslash", "drive", "trailing_slash", "segment", "segment", "empty", "empty", "ok"]


LINES = [
    "2024-01-02T03:04:05+00:00 h sshd[7]: Failed password for invalid user bob from 1.2.3.4 port 5 ssh2",
    "Jan  2 03:04:05 h sshd[7]: Invalid user eve from 1.2.3.4",
    "Jan  2 03:04:05 h sudo: al : TTY=pts/1 ; PWD=/x ; USER=root ; COMMAND=/bin/ls -l ",
    "Jan  2 03:04:05 h su: pam_unix(su:auth): authentication failure; logname=l uid=0 euid=0 tty=t ruser=ru rhost=rh",
    "Jan  2 03:04:05 h login: session opened for user alice(uid=1000)",
    "   ",
    "not a log line",
]


def test_log_lines(spark):
    lines = spark.createDataFrame([("var/log/auth.log", k + 1, x) for k, x in enumerate(LINES)], "source_path string, line_number long, line string")
    got = {r.line_number: r for r in logs.parse_logs(lines, 2024).collect()}
    assert [got[k].event_type for k in range(1, 8)] == ["ssh_invalid_user", "ssh_invalid_user", "sudo_command", "generic_syslog", "session_open", "unknown_format", "unknown_format"]
    assert (got[1].user, got[1].src_ip, got[1].src_port, got[1].ts_class) == ("bob", "1.2.3.4", 5, 0)
    assert (got[3].user, got[3].command, got[3].target_user, got[3].ts_class) == ("al", "/bin/ls -l", "root", 1)
    assert got[5].user == "alice(uid=1000)"
    assert logs.classify(logs.parse_header(lines, 2024), strip_uid=True).filter("line_number = 5").first().user == "alice"
    auth = {r.line_number: r for r in logs.authentication_rows(logs.parse_logs(lines, 2024)).collect()}
    assert (auth[4].auth_type, auth[4].username, auth[4].source_ip, auth[4].status) == ("authentication_failure", "ru", "rh", "FAILURE")
    assert auth[7].auth_type == "unknown_auth_event"
    assert logs.pam_detail(logs.parse_logs(lines)).first().ruser == "ru"


def text_file(spark, path, *lines):
    return spark.createDataFrame([(path, k + 1, x) for k, x in enumerate(lines)], "source_path string, line_number long, line string")


def test_account_files(spark):
    s = {r.username: r for r in accounts.shadow(text_file(spark, "etc/shadow", "a:$6$x$y:1", "b:!:1", "c::1", "d:!$1$z:1")).collect()}
    assert (s["a"].hash_family, s["a"].hash, s["b"].locked, s["c"].empty, s["d"].hash_family) == ("sha512", "[REDACTED]", True, True, "md5")
    r = accounts.sudoers(text_file(spark, "etc/sudoers", "Defaults x", "# c", "al ALL=(root) NOPASSWD: /bin/a, /bin/b", "User_Alias A = b")).orderBy("line_number").collect()
    assert (r[0].principal, r[0].runas, r[0].tags, r[0].commands, r[1].kind) == ("al", "root", ["NOPASSWD"], ["/bin/a", "/bin/b"], "UNPARSED")
    k = accounts.authorized_keys(text_file(spark, "home/al/.ssh/authorized_keys", 'no-pty ssh-ed25519 AAAA al at home', "junk")).collect()
    assert [(x.owner, x.key_type, x.comment) for x in k] == [("al", "ssh-ed25519", "al at home")]


def test_persistence_files(spark):
    unit = persistence.systemd(text_file(spark, "etc/systemd/system/a.service", "[Unit]", "Description=d", "[Service]", "ExecStart=/bin/x", "ExecStart=/bin/y", "User=u")).collect()
    assert sorted((r.command, r.description, r.user) for r in unit) == [("/bin/x", "d", "u"), ("/bin/y", "d", "u")]
    cron = persistence.cron(text_file(spark, "etc/crontab", "A=b", "* * * * * root /x y", "@daily root /z", "junk")).orderBy("line_number").collect()
    assert [(r.kind, r.user, r.command) for r in cron] == [("ENVIRONMENT", None, None), ("JOB", "root", "/x y"), ("JOB", "root", "/z"), ("MALFORMED", None, None)]
    assert [r.job for r in persistence.anacron(text_file(spark, "etc/anacrontab", "1 5 cron.daily run it", "x")).collect()] == ["cron.daily"]
    assert [r.library for r in persistence.preload(text_file(spark, "etc/ld.so.preload", "/a.so /b.so")).collect()] == ["/a.so", "/b.so"]
    assert [r.hint for r in persistence.shell_startup(text_file(spark, "home/a/.bashrc", "export A=1", "alias b=c", ". x", "ls")).orderBy("line_number").collect()] == ["export", "alias", "source", "command"]
    assert persistence.autostart(text_file(spark, "x.desktop", "[D]", "Name=a", "Exec=b", "Exec=c")).first().command == "c"
    assert persistence.kernel_modules(text_file(spark, "etc/modprobe.d/x.conf", "blacklist foo")).first().module == "foo"
    links = spark.createDataFrame([("etc/systemd/system/multi-user.target.wants/a.service", "/lib/a.service"), ("etc/x", None)], "relative_path string, link_target string")
    assert persistence.enablement(links).first().unit == "a.service"


def test_memory_values(spark):
    df = spark.createDataFrame([("0x1F", "run --password hunter2 x", "api_token=abc key")], "n string, a string, b string")
    r = df.select(memory.number(F.col("n")).alias("n"), memory.redact(F.col("a")).alias("a"), memory.redact(F.col("b")).alias("b")).first()
    assert (r.n, r.a, r.b) == (31, "run --password [REDACTED] x", "api_token=[REDACTED] key")
    tool = spark.createDataFrame([("s", 'log line\n[{"PID": 1}, {"PID": 2}]'), ("t", '{"rows": [{"PID": 3}]}')], "source string, value string")
    assert sorted(r.row["PID"] for r in memory.read_tool_json(tool).collect()) == ["1", "2", "3"]


def test_http_limits(spark):
    head = "GET / HTTP/1.1\r\nHost: a\r\nHost: b\r\nAuthorization: x\r\n\r\nbody: y"
    r = network.http_heads(spark.createDataFrame([(1, head), (2, "BREW / HTTP/1.1\r\n\r\n")], "page_id int, payload string")).collect()
    assert [(x.page_id, x.host, x.headers) for x in r] == [(1, "a", "host=a;host=b;authorization=[REDACTED]")]


def test_broken_chain(spark):
    rows = [("L", k, f"e{k}", f"2024-01-0{k}", "RECEIVED", "i", "a", "b") for k in range(1, 5)]
    built = integrity.build_chain(spark.createDataFrame(rows, "ledger_id string, seq int, event_id string, happened string, action_type string, item_id string, actor string, recipient string"))
    assert integrity.verify_chain(built).filter("problem is not null").count() == 0
    gone = integrity.verify_chain(built.filter("seq <> 2"))
    assert {(r.seq, r.problem) for r in gone.collect()} == {(1, None), (3, "SEQUENCE"), (4, "SEQUENCE")}
    forged = built.withColumn("record_hash", F.when(F.col("seq") == 2, F.lit("0")).otherwise(F.col("record_hash")))
    assert {(r.seq, r.problem) for r in integrity.verify_chain(forged).collect() if r.problem} == {(2, "ALTERED_RECORD"), (3, "BROKEN_LINK")}


def test_long_ledger_is_a_stream(spark, capsys):
    cols = "ledger_id string, seq int, event_id string, happened string, action_type string, item_id string, actor string, recipient string"
    rows = spark.range(3000).selectExpr("if(id % 10 = 0, 'M', 'L') AS ledger_id", "CAST(id AS INT) AS seq", *(f"CAST(id AS STRING) AS {c}" for c in ("event_id", "happened", "action_type", "item_id", "actor")), "CAST(NULL AS STRING) AS recipient")
    built = integrity.build_chain(rows.repartition(5).select(*[c.split()[0] for c in cols.split(", ")]))
    built.explain()
    assert "collect_list" not in capsys.readouterr().out  # no ledger in one row
    last = dict.fromkeys("LM", "0" * 64)
    for r in sorted(built.collect(), key=lambda r: r.seq):
        body = json.dumps({c: r[c] for c in sorted(integrity.FIELDS)}, separators=(",", ":"))
        assert r.previous_hash == last[r.ledger_id]
        last[r.ledger_id] = hashlib.sha256((r.previous_hash + body).encode()).hexdigest()
        assert r.record_hash == last[r.ledger_id]


def test_manifest_needs_every_algorithm(spark):
    entries = spark.createDataFrame([("a", "md5", "1"), ("a", "sha256", "2"), ("b", "md5", "1"), ("b", "sha256", "x"), ("c", "crc", "1")], "relative_path string, algorithm string, digest string")
    files = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2"), ("c", "1", "2")], "relative_path string, md5 string, sha256 string")
    assert {r.relative_path: r.status for r in integrity.verify_manifest(entries, files).collect()} == {"a": "VERIFIED", "b": "MISMATCH", "c": "UNSUPPORTED_ALGORITHM"}


def test_streams_equal_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.failure_then_success(live, 300), str(tmp_path / "out"), str(tmp_path / "cp"))
    f, s = src.filter("event_type = 'error'"), src.filter("event_type = 'signup'")
    gap = F.col("s.ts").cast("double") - F.col("f.ts").cast("double")
    want = f.alias("f").join(s.alias("s"), (gap >= 0) & (gap <= 300)).count()
    assert spark.read.parquet(out).count() == want > 0


def test_json_documents(spark, tmp_path):
    from tidelog.sources import reports

    d = tmp_path / "r"
    d.mkdir()
    (d / "a.json").write_text('{"events": ["x"], "correlations": [], "detections": [{"matched": true}, {"matched": false}]}')
    (d / "b.json").write_text('{"report_type": "Timeline"}')
    (d / "c.json").write_text("{broken")
    r = {x.source_path[-6:]: x for x in reports.report_counts(reports.read_reports(spark, str(d))).collect()}
    assert [(r[k].kind, r[k].events, r[k].detections, r[k].matched) for k in sorted(r)] == [("investigation", 1, 2, 1), ("timeline", 0, 0, 0), ("invalid", 0, 0, 0)]
    (tmp_path / "m.json").write_text('{"entries": [{"relative_path": "a", "size_bytes": 1, "hashes": {"md5": "x", "sha256": "y"}}]}')
    assert sorted(tuple(x) for x in reports.read_manifest(spark, str(tmp_path / "m.json")).collect()) == [("a", 1, "md5", "x"), ("a", 1, "sha256", "y")]
    (tmp_path / "l.json").write_text('{"ledger_id": "L", "events": [{"seq": 1, "record_hash": "h"}, {"seq": 2}]}')
    kept, refused = reports.read_ledger(spark, str(tmp_path / "l.json"))
    assert [x.seq for x in kept.collect()] == [1] and [x.seq for x in refused.collect()] == [2]
    notes = spark.createDataFrame([('{"releasing": "a", "receiving": "b"}',), ("old",)], "n string").select(reports.transfer_fields(F.col("n")).alias("t"))
    assert [x.t and x.t.receiving for x in notes.collect()] == ["b", None]


def test_read_lines(spark, tmp_path):
    import gzip

    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\n\nthree\n")
    with gzip.open(tmp_path / "b.log.gz", "wb") as f:
        f.write(b"x\ny")
    got = sorted((r.source_path[-4:], r.line_number, r.line) for r in lines.read_lines(spark, str(tmp_path / "*.log*")).collect())
    assert got == [(".log", 1, "one"), (".log", 2, "two"), (".log", 3, ""), (".log", 4, "three"), ("g.gz", 1, "x"), ("g.gz", 2, "y")]


@pytest.mark.parametrize("text, want", [
    ("--private-key x y", "--private-key [REDACTED] y"), ("-key: x", "-key: [REDACTED]"), ("--client_secret=x", "--client_secret=[REDACTED]"), ("--ACCESS_TOKEN x", "--ACCESS_TOKEN [REDACTED]"),
    ("private_key=x", "private_key=[REDACTED]"), ("access_token = x, b", "access_token = [REDACTED], b"), ("password='a b' c", "password=[REDACTED] c"), ('--token "a b";', "--token [REDACTED];"),
    ("no-password required", "no-password required"), ("token=x", "token=x"), ("key: x", "key: x"), ("--sort-key x", "--sort-key x"), ("--key-file x", "--key-file x"), ("my_password=x", "my_password=x"),
])
def test_redaction(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(memory.redact(F.col("t")).alias("t")).first().t == want


def test_tool_documents(spark):
    docs = [
        ("object with another list", 'log [1]\n{"columns": ["PID", "x"], "rows": [{"PID": 3}, {"PID": 4}]}'), ("data", '{"data": [{"PID": 5}]}'), ("one row", '{"PID": 6, "Name": "a"}'), ("list", '  [{"PID": 7}]'),
        ("broken", '[{"PID": 1}, {"PID"'), ("no document", "nothing here"), ("empty list", "[]"),
    ]
    got = sorted((r.source, r.row_index, r.row and r.row["PID"], r.reason) for r in memory.read_tool_json(spark.createDataFrame(docs, "source string, value string")).collect())
    assert got == [
        ("broken", None, None, "UNREADABLE_DOCUMENT"), ("data", 0, "5", None), ("list", 0, "7", None), ("no document", None, None, "NO_DOCUMENT"),
        ("object with another list", 0, "3", None), ("object with another list", 1, "4", None), ("one row", 0, "6", None),
    ]


def test_predicates(spark):
    schema = "n int, d double, b boolean, t string, a array<string>, m map<string,string>, s struct<x: int, y: map<string,string>>, attributes map<string,string>"
    row = (1, 5.0, True, "abc", ["abc", "de"], {"k": "v"}, (7, {"p.q": "r"}), {"user": "u", "a.b": "c"})
    events = spark.createDataFrame([row, (None,) * 8], schema)
    cases = [
        ("n", "=", 1, True), ("n", "=", 1.0, True), ("n", "=", True, False), ("n", "=", "1", False), ("n", "!=", 2, True), ("n", "!=", "1", True), ("b", "=", True, True), ("b", "=", 1, False), ("b", ">", 0, False),
        ("t", "=", "abc", True), ("t", "!=", "x", True), ("t", "contains", "b", True), ("t", "in", "xabcx", True), ("t", "in", ["x", "abc"], True), ("t", "in", ["x"], False), ("t", "in", ("a", 1), False), ("t", ">", 1, False), ("t", "starts_with", "ab", True), ("t", "ends_with", "ab", False),
        ("a", "contains", "abc", True), ("a", "contains", "b", False), ("a", "=", ["abc", "de"], True), ("a", "=", ["abc"], False), ("m", "contains", "k", True), ("m", "contains", "v", False), ("m.k", "=", "v", True), ("d", ">=", 5, True), ("d", "<", "9", False),
        ("s.x", "=", 7, True), ("s.y.p.q", "=", "r", True), ("s.z", "!=", 1, False), ("user", "=", "u", True), ("attributes.user", "=", "u", True), ("a.b", "=", "c", False), ("attributes.a.b", "=", "c", True), ("gone", "!=", "x", False), ("gone", "exists", False, True), ("n", "exists", None, True),
    ]
    hits = [rules.test(events.schema, rules.Condition(f, op, v)).alias(str(k)) for k, (f, op, v, _) in enumerate(cases)]
    present, missing = events.select(*hits).collect()
    assert {c: bool(present[k]) for k, c in enumerate(map(str, cases))} == {str(c): c[3] for c in cases}
    assert [k for k in range(len(cases)) if missing[k]] == [k for k, c in enumerate(cases) if c[1] == "exists" and c[2] is False]


def test_manifest_statuses(spark):
    entries = [("a", "SHA256", "2"), ("b", "sha512", "3"), ("../c", "md5", "1"), ("d", "md5", "1"), ("e", "md5", "1"), ("f", "md5", "1")]
    files = spark.createDataFrame([(k, "1", "2", k == "e", k == "f") for k in "abef"], "relative_path string, md5 string, sha256 string, is_link boolean, unreadable boolean")
    got = integrity.verify_manifest(spark.createDataFrame(entries, "relative_path string, algorithm string, digest string"), files)
    assert {r.relative_path: r.status for r in got.collect()} == {"a": "VERIFIED", "b": "UNSUPPORTED_ALGORITHM", "../c": "PATH_TRAVERSAL_DETECTED", "d": "FILE_MISSING", "e": "SYMLINK_REJECTED", "f": "PERMISSION_DENIED"}


def test_identities_fall_back(spark):
    e = spark.createDataFrame([({"user": " u "}, None), ({"account": "a", "src_ip": "1.2.3.4", "file_path": "/x/y", "session": "9"}, "z"), ({"username": " ", "user": "u", "hostname": "h", "path": "p"}, "z"), ({"source_host": "s"}, "z")], "attributes map<string,string>, source_path string")
    got = e.select(*(f(e).alias(n) for n, f in (("u", correlate.user_identity), ("s", correlate.source_identity), ("p", correlate.path_identity), ("x", correlate.session_identity)))).collect()
    assert [tuple(r) for r in got] == [("u", None, None, None), ("a", "1.2.3.4", "x/y", "9"), (None, "h", "p", None), (None, "s", "z", None)]
    c = spark.createDataFrame([("process", {"command": "SUDO ls"}), ("process", {"command": "ls"}), ("process", None)], "event_type string, attributes map<string,string>")
    assert [r.p for r in c.select(correlate.is_privilege(c).alias("p")).collect()] == [True, False, False]


def test_secret_headers(spark):
    names = ["Authorization", "Proxy-Authorization", "Cookie", "Set-Cookie", "X-Api-Key", "Api-Key", "X-Auth-Token"]
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"{n}: v\r\n" for n in names)
    r = network.http_heads(spark.createDataFrame([(1, head)], "page_id int, payload string")).first()
    assert [x.endswith("[REDACTED]") for x in r.headers.split(";")] == [True] * 6 + [False] and r.status_code == 200


def test_log_stream_and_rows_without_a_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"2024-01-01T10:00:0{k}+00:00 h sshd[1]: Failed password for u{k % 2} from 10.0.0.1 port 22 ssh2" for k in range(6)]
    (tmp_path / "in" / "a.log").write_text("\n".join([*lines, "2024-01-01T10:00:00 h x: naive", "no header", lines[0]]) + "\n")
    run = lambda df, name: spark.read.parquet(streams.run_once(df, str(tmp_path / name), str(tmp_path / f"{name}-cp")))
    live = lambda: streams.read_logs(spark, str(tmp_path / "in"))
    assert run(live(), "timed").count() == 7
    assert run(streams.deduplicate(live(), ["line"], 60).select("line", "user"), "once").count() == 6
    late = spark.read.text(str(tmp_path / "in")).select(F.lit("a.log").alias("source_path"), F.lit(None).cast("long").alias("line_number"), F.col("value").alias("line"))
    assert streams.untimed(logs.parse_logs(late)).count() == 2  # rows without an aware time have no place in event time
    # a later file moves the watermark, so that the windows before it are given out
    (tmp_path / "in" / "b.log").write_text("2024-01-01T12:00:00+00:00 h sshd[1]: Failed password for z from 10.0.0.1 port 22 ssh2\n")
    burst = run(streams.bursts(live(), "user", "1 minute", "1 minute", 3), "bursts").collect()
    assert {(r.user, r.n) for r in burst} == {("u0", 4), ("u1", 3)}
    session = run(streams.sessions(live(), "user", "1 minute"), "sessions").collect()
    assert {(r.user, r.n) for r in session} == {("u0", 4), ("u1", 3)}


def test_packet_stream_equals_batch(spark, sf, tmp_path):
    from tidelog.plans.views import view

    rows = view(spark, sf, "packets").limit(50).withColumn("ts_us", F.col("sec").cast("long") * 1_000_000)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.packets(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == sorted(r.event_id for r in network.packet_events(spark.read.parquet(str(tmp_path / "in"))).collect())


def test_catalogue_and_sinks(spark, sf, tmp_path):
    from tidelog.operators import artifacts
    from tidelog.plans.views import view

    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a").write_bytes(b"abc")
    (tmp_path / "d" / "sub" / "b").write_bytes(b"\0")
    found = {r.path[-1]: (r.size_bytes, r.md5, r.sha256) for r in artifacts.catalogue(spark, str(tmp_path / "d")).collect()}
    assert found == {k: (len(c), hashlib.md5(c).hexdigest(), hashlib.sha256(c).hexdigest()) for k, c in (("a", b"abc"), ("b", b"\0"))}
    lines = view(spark, sf, "account_lines").limit(40)
    table = artifacts.unify(accounts.passwd(lines), "account", "user")
    artifacts.write_csv(table, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == artifacts.COLUMNS and back.count() == table.count() > 0
    e = view(spark, sf, "timeline").limit(30)
    artifacts.write_timeline(e, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("category = 'log'").count() == e.filter("category = 'log'").count()
    artifacts.write_timeline(e, str(tmp_path / "j"), "json")
    ids_back = [json.loads(x)["event_id"] for f in sorted((tmp_path / "j").glob("*.json")) for x in f.read_text().splitlines()]
    assert ids_back == [r.event_id for r in timeline.order(e).collect()]


def test_one_timeline_of_all_sources(spark):
    packets = spark.createDataFrame([("e1", 0, 5, "network", "tcp_packet", "1.2.3.4", 22), ("e0", 0, 5, "network", "tcp_packet", "1.2.3.4", 22), ("e2", 0, 5, "network", "tcp_packet", "1.2.3.4", 23)], "event_id string, ts_class int, ts_us long, category string, event_type string, src_ip string, dst_port int")
    files = spark.createDataFrame([("f", 2, "filesystem", {"Owner": "root", "k": None}), ("g", 2, "filesystem", None)], "event_id string, ts_class int, category string, attributes map<string,string>")
    out = timeline.unite(packets, files)
    got = {r.event_id: dict(r.attributes) for r in out.collect()}
    assert got == {"e0": {"src_ip": "1.2.3.4", "dst_port": "22"}, "e2": {"src_ip": "1.2.3.4", "dst_port": "23"}, "f": {"Owner": "root", "k": None}} | ({"g": {}} if "g" in got else {})
    assert {r.event_id for r in timeline.query(out, text="OWNER").collect()} == {"f"} and {r.event_id for r in timeline.query(out, text="1.2.3", case=True).collect()} == {"e0", "e2"}
    assert [r.s for r in out.filter("event_id = 'e0'").select(correlate.source_identity(out).alias("s")).collect()] == ["1.2.3.4"]
    assert rules.single(out, [rules.Rule("port", conditions=(rules.Condition("dst_port", "=", "23"),))]).count() == 1
