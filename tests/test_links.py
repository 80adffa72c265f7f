"""Positions on the timeline, and links that follow from them, against plain loops."""

import random

import pytest

from tests.test_operators import EVENT
from tidelog.operators import correlate, timeline

TYPES = [("ssh_login_success", "SUCCESS"), ("ssh_login_failure", "FAILURE"), ("sudo_command", "SUCCESS"), ("group_modified", "FAILED"), ("other", None)]


def random_events(spark, seed, n=120):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        kind, status = r.choice(TYPES)
        c = r.choice([0, 1, 2, 2])
        at = None if c == 2 else r.randint(0, 10) * 1_000_000
        rows.append((f"e{k}", c, at, r.choice(["authentication", "log"]), kind, r.choice(["u", "v", "w", None, " "]), None, r.choice(["f", "g", None]), None, status, None, r.choice([None, 1, 2]), None, "d", None))
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, EVENT).repartition(5)


def order(e):
    return (e[1], e[2] or 0, e[7] or "", -1 if e[11] is None else e[11], e[10] or "", e[12] or "", e[4], e[13], e[0])


def plain_pairs(rows):
    auth = lambda e: e[9] not in ("FAILURE", "FAILED") if e[3] == "authentication" else e[4] == "ssh_login_success"
    privilege = lambda e: e[4] in ("sudo_command", "group_modified")
    user = lambda e: (e[5] or "").strip() or None
    inorder = sorted(rows, key=order)
    return [(a[0], b[0], user(a), user(b)) for i, a in enumerate(inorder) for b in inorder[i + 1 :] if None in (a[2], b[2]) and auth(a) and privilege(b) and (user(a) == user(b) or None in (user(a), user(b)))]


@pytest.mark.parametrize("seed, block", [(1, 1 << 16), (2, 3), (3, 1), (4, 10)])
def test_privilege_without_time_counts_all_pairs(spark, seed, block):
    rows, df = random_events(spark, seed)
    pairs = plain_pairs(rows)
    want = {}
    for a, b, user_a, user_b in pairs:
        for key in ((a, "authentication", user_a), (b, "privilege", user_b)):
            want[key] = want.get(key, 0) + 1
    got = {(r.event_id, r.role, r.value): r.n_links for r in correlate.privilege_without_time(df, block).collect()}
    assert got == want and len(want) > 20
    some = [f"e{k}" for k in range(0, 120, 7)]
    listed = {(r.event_a, r.event_b, r.value) for r in correlate.linked_without_time(df, some).collect()}
    assert listed == {(a, b, x or y or "unknown") for a, b, x, y in pairs if a in some or b in some}


def test_positions(spark):
    rows, df = random_events(spark, 9, 300)
    got = {r.event_id: r.position for r in timeline.with_position(df, 7).collect()}
    assert got == {e[0]: k + 1 for k, e in enumerate(sorted(rows, key=order))}
    assert timeline.with_position(df.limit(0)).count() == 0 and correlate.privilege_without_time(df.limit(0)).count() == 0


def test_mirrored_pairs_are_one_row(spark):
    rows = [(e, 0, 5, "authentication", "sudo_command", "u", None, "f", None, "SUCCESS", s, 1, None, "d", None) for e, s in (("a", "S1"), ("b", "S0"))]
    out = correlate.authentication_privilege(spark.createDataFrame(rows, EVENT)).collect()
    assert [(r.event_a, r.event_b, r.sources) for r in out] == [("a", "b", ["S1", "S0"])]
