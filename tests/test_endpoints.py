"""Host and network events by sets of endpoints against a plain loop; answers, offered protocols and ids of rules."""

import ipaddress
import random

from pyspark.sql import functions as F

from tidelog.functions import net
from tidelog.operators import correlate, rules
from tidelog.sources import network

HOST = "event_id string, ts_class int, ts_us long, category string, event_type string, username string, source_ip string, session_id string, source_port int, attributes map<string,string>"
NET = "event_id string, ts_class int, ts_us long, category string, event_type string, username string, session_id string, src_ip string, dst_ip string, src_port int, dst_port int"
IPS = ["10.0.0.1", " 10.0.0.2 ", "8.8.8.8", "2001:DB8::1", "2001:db8:0:0::1", "fe80::1", "2606:4700::1111", "x", "1.2.3.04", None]


def canonical(text):
    try:
        return str(ipaddress.ip_address((text or "").strip()))
    except ValueError:
        return None


def test_endpoint_sets_equal_a_plain_loop(spark):
    r = random.Random(7)
    at = lambda: (lambda c: (c, None if c == 2 else r.randint(0, 30) * 1_000_000))(r.choice([0, 0, 0, 1, 2]))
    hosts = [(f"h{k}", *at(), r.choice(["log", "Authentication"]), "t", r.choice(["Bob", "eve", " ", None]), r.choice(IPS), r.choice(["s1", "s2", None]), r.choice([80, 0, 70000, None]), r.choice([None, {"client_ip": r.choice(IPS[:7]), "port": r.choice(["22", "443", "x"])}])) for k in range(80)]
    nets = [(f"n{k}", *at(), "network", "t", r.choice(["bob", "EVE", None]), r.choice(["s1", "s3", None]), r.choice(IPS), r.choice(IPS), r.choice([22, 80, None]), r.choice([443, None])) for k in range(80)]
    known, clean, want = ["8.8.8.8"], lambda x: (x or "").strip() or None, {}
    for h in hosts:
        ips = {canonical(x) for x in (h[6], (h[9] or {}).get("client_ip"))} - {None}
        mine = {p for p in [h[8], *([int(h[9]["port"])] if h[9] and h[9]["port"].isdigit() else [])] if p and 1 <= p <= 65535}
        for n in nets:
            hu, nu, hs, ns = (clean(x) for x in (h[5], n[5], h[7], n[6]))
            hu, nu = hu and hu.lower(), nu and nu.lower()
            ends = [canonical(n[7]), canonical(n[8])]
            if h[1] != n[1] or h[1] == 2 or abs(h[2] - n[2]) > 10_000_000 or (hu and nu and hu != nu) or (hs and ns and hs != ns):
                continue
            common = ips & set(ends)
            way = ("ip_match", min(common)) if common else ("host_endpoint_ip_match", "8.8.8.8") if known[0] in ends else ("user_match", hu) if hu and hu == nu else ("session_match", hs) if hs and hs == ns else None
            if way:
                by_ip = "ip" in way[0].split("_")
                theirs = {p for p in n[9:] if p}
                private = by_ip and not ipaddress.ip_address(way[1]).is_global
                notes = [correlate.NOTES["private" if private else "shared"]] * by_ip + [correlate.NOTES["ports"]] * bool(mine and not mine & theirs)
                want[h[0], n[0]] = (*way, "outbound" if by_ip and way[1] == ends[0] else "inbound" if by_ip else None, bool(mine & theirs), bool(hu and hu == nu), private, notes)
    out = correlate.host_network(spark.createDataFrame(hosts, HOST).repartition(3), spark.createDataFrame(nets, NET), 10.0, known).collect()
    assert len(out) == len(want) > 100 and {w[0] for w in want.values()} == {"ip_match", "host_endpoint_ip_match", "user_match", "session_match"}
    for x in out:
        assert (x.dimension, x.value, x.direction, x.port_aligned, x.user_aligned, x.private_address, x.notes) == want[x.host_event, x.network_event]


def test_private_addresses_of_both_versions(spark):
    texts = ["10.0.0.1", "8.8.8.8", "100.64.0.1", "::1", "fe80::1", "2606:4700::1", "fc00::1", "ff02::1", "::", "no", "a:b", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "ip string").select(net.is_private_ip(F.col("ip"), ipv6=True)).collect()]
    assert got == [True, False, True, True, True, False, True, True, True, False, False, False]


def test_answers_and_offered_protocols(spark):
    rows = [
        (1, "q.org", None, None, [("q.org", "A", "192.0.2.1"), ("q.org", "A", "192.0.2.2")]), (2, "r.org", None, None, [("r.org", "A", "192.0.2.10")]), (3, "s.org", None, None, None), (4, None, "t.org", ["h2", "http/1.1"], None), (5, None, "u.org", [], None),
    ]
    packets = spark.createDataFrame(rows, f"frame_number long, query_name string, server_name string, alpn_protocols array<string>, answers {network.ANSWERS}")
    packets = packets.select("*", F.lit("c").alias("capture"), F.lit(1).cast("long").alias("ts_us"), *(F.lit(None).cast(k).alias(c) for c, k in (("src_ip", "string"), ("dst_ip", "string"), ("src_port", "int"), ("dst_port", "int"), ("transport_protocol", "string"), ("query_type", "string"), ("response_code", "int"), ("tls_version", "int"))))
    events = network.application_events(packets)
    frame = {r.event_id: r.source_line for r in events.collect()}
    hit = lambda rule: sorted(frame[r.event_ids[0]] for r in rules.evaluate(events, [rule]).collect())
    assert hit(rules.dns_rule(answer="192.0.2.2")) == [1] and hit(rules.dns_rule(answer="192.0.2.1")) == [1] and hit(rules.dns_rule("r.org", answer="192.0.2.1")) == []
    assert hit(rules.tls_rule(alpn="h2")) == [4] and hit(rules.tls_rule("u.org", alpn="h2")) == [] and hit(rules.Rule("named", conditions=(rules.Condition("answers.name", "contains", "r.org"),))) == [2]
    bare = packets.drop("answers", "alpn_protocols", "query_type")
    assert network.application_events(bare).count() == 5 and rules.evaluate(network.application_events(bare), [rules.dns_rule(answer="x")]).count() == 0


def test_rules_of_one_name_are_told_apart(spark):
    a, b = rules.dns_rule("a"), rules.dns_rule("b")
    assert a.rule_id != b.rule_id and a.rule_id == rules.dns_rule("a").rule_id
    assert rules.Rule("x", event_types=("p", "q"), window=1).rule_id == rules.Rule(" x ", event_types=("q", "p"), window=1).rule_id != rules.Rule("x", event_types=("p",)).rule_id
    events = spark.createDataFrame([("e", 0, 1, "network", "dns_query", "ab")], "event_id string, ts_class int, ts_us long, category string, event_type string, query_name string")
    starts = [rules.Rule("q", conditions=(rules.Condition("query_name", op, v),)) for op, v in (("starts_with", "a"), ("ends_with", "b"))]
    assert rules.evaluate(events, starts).count() == 2
