"""Kinds of host rows at once; parents of rows; counts in place of pairs."""

import itertools

from tests.test_links import random_events
from tidelog.operators import host_artifacts, memory, timeline


def lines(spark, *rows):
    return spark.createDataFrame([(p, k, t) for k, (p, t) in enumerate(rows)], "source_path string, line_number long, line string")


def test_scopes_of_startup_files(spark):
    df = lines(spark, ("home/u/.bashrc", "x"), ("root/.profile", "x"), ("etc/profile", "x"), ("var/spool/cron/u", "@daily x"), ("etc/crontab", "bad"), ("home/u/.config/autostart/a.desktop", "Name=n"))
    got = {(r.mechanism, r.scope): (r.n, r.malformed) for r in host_artifacts.startup_counts(host_artifacts.startup_rows(df)).collect()}
    assert got == {("shell_startup", "user"): (2, 0), ("shell_startup", "system"): (1, 0), ("cron", "user"): (1, 0), ("cron", "system"): (1, 1), ("autostart", "user"): (1, 0)}


def test_account_summary(spark):
    df = lines(spark, ("etc/passwd", "root:x:0:0::/root:/bin/sh"), ("etc/passwd", "u:x:5:5::/:/bin/sh"), ("etc/group", "g:x:5:u,root"), ("etc/shadow", "u:!:1"), ("etc/shadow", "v::1"), ("etc/sudoers", "u ALL=(root) NOPASSWD: /bin/a"), ("root/.ssh/authorized_keys", "ssh-rsa A c"))
    got = {r.measure: r.n for r in host_artifacts.account_summary(df).collect()}
    assert got == {"users": 2, "privileged users": 1, "groups": 1, "memberships": 2, "credentials": 2, "locked": 1, "empty": 1, "with password": 0, "sudo rules": 1, "sudo unparsed": 0, "sudo without password": 1, "ssh keys": 1, "key owners": 1}
    assert {r.category for r in host_artifacts.collection(df).collect()} == {"account", "group", "credential_metadata", "privilege", "ssh_key"}
    assert host_artifacts.account_summary(df.limit(0)).count() == 13 and host_artifacts.collection(df.limit(0)).count() == 0


def test_parents_of_repeated_paths(spark):
    files = spark.createDataFrame([("a", "F2"), ("a", "F1"), ("b", "F3")], "relative_path string, artifact_id string")
    rows = spark.createDataFrame([("a", None), ("a", "given"), ("c", None)], "source_path string, source_artifact_id string")
    got = sorted((r.source_path, r.source_artifact_id or "") for r in timeline.resolve_parents(rows, files).collect())
    assert got == [("a", "F1"), ("a", "given"), ("c", "")]


def test_counts_in_place_of_pairs(spark):
    rows = [("E1", f"a{k}", "x" if k < 4 else None) for k in range(6)] + [("E2", f"b{k}", "x") for k in range(3)] + [("E2", "c", "y")]
    df = spark.createDataFrame(rows, "evidence_id string, artifact_id string, plugin string")
    want = {}
    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and a[2] is not None and a[2] == b[2]:
            want[a[0], a[2]] = want.get((a[0], a[2]), 0) + 1
    assert {(r.evidence_id, r.value): r.n for r in memory.shared_counts(df, "plugin", "K").collect()} == want


def test_summary_by_category(spark):
    _, events = random_events(spark, 2, 60)
    twice = events.unionByName(events.filter("category = 'log'").withColumn("event_id", events["event_id"]))
    before = {r.category: r["count"] for r in twice.groupBy("category").count().collect()}
    kept = {r.category: r["count"] for r in timeline.deduplicate(twice).groupBy("category").count().collect()}
    assert {r.category: (r.total, r.kept, r.removed) for r in timeline.summary_by(twice).collect()} == {c: (before[c], kept[c], before[c] - kept[c]) for c in before}
