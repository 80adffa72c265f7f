"""Links between events of one timeline, each unordered pair once.

`band_join` is the shared primitive: times are dealt into buckets of the window's width, each row of
one side looks into three buckets, so the join is an equi-join on (keys, bucket) with a filter behind
it. A busy key is spread by its buckets, and adaptive execution splits a bucket that is still large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ids, times
from tidelog.functions.net import is_private_ip, normalize_ips
from tidelog.functions.once import once
from tidelog.functions.paths import normalize_path
from tidelog.functions.shared import materialize
from tidelog.operators import timeline

WINDOW = 300.0
#: Events of one identity and class that untimed pairs are made of in one block.
BLOCK = 4096
# Event types that count as privilege use, and as successful authentication.
PRIVILEGE_TYPES = ["sudo_command", "sudo_rule", "su_session", "privilege_escalation", "group_modified", "shadow_modified", "account_privilege_granted"]
AUTHENTICATED_TYPES = ["ssh_login_success", "session_open", "authentication_success", "login_success"]
FAILED = ["FAILURE", "FAILED"]

SIDE = ["event_id", "ts_class", "ts_us", "category", "event_type", "username", "source_ip", "source_path", "session_id", "status", "source_artifact_id"]


def side(events: DataFrame, suffix: str, extra: list[str] = ()) -> DataFrame:
    return events.select(*(F.col(c).alias(f"{c}_{suffix}") for c in [*SIDE, *extra] if c in events.columns))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], window: float, after: bool = False, spread: str = "a") -> DataFrame:
    """Pairs of equal keys and class within the window seconds; after: the right one not before the left one.

    left has the suffix _a, right _b; keys are named without it. Rows without a time pair with none. The rows of the side
    to spread look into all buckets in reach and are shuffled as often; the others are shuffled once.
    """
    us = int(window * 1_000_000)
    width = max(1, us)
    bucket = lambda s: F.floor(F.col(f"ts_us_{s}") / width).cast("long")
    reach = {"a": (0, 1), "b": (-1, 0)}[spread] if after else (-1, 0, 1)
    at = lambda s: F.explode(F.array(*(bucket(s) + k for k in reach))) if s == spread else bucket(s)
    a = left.filter((F.col("ts_class_a") != times.MISSING) & F.col("ts_us_a").isNotNull()).withColumn("_bucket", at("a"))
    b = right.filter((F.col("ts_class_b") != times.MISSING) & F.col("ts_us_b").isNotNull()).withColumn("_bucket_b", at("b"))
    on = [F.col("_bucket") == F.col("_bucket_b"), F.col("ts_class_a") == F.col("ts_class_b"), *(F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys)]
    gap = F.col("ts_us_b") - F.col("ts_us_a")
    return a.join(b, reduce(lambda x, y: x & y, on)).filter(gap.between(0, us) if after else F.abs(gap) <= us).drop("_bucket", "_bucket_b")


def delta() -> Column:
    return times.delta_seconds(F.col("ts_class_a"), F.col("ts_us_a"), F.col("ts_class_b"), F.col("ts_us_b"))


def edges(pairs: DataFrame, kind: str, value: Column | None = None) -> DataFrame:
    """relation, event_a, event_b (in order), value, delta_seconds, start_us, end_us of pairs, and sources where they have artifact ids."""
    same = times.comparable(F.col("ts_class_a"), F.col("ts_class_b"))
    sources = []
    if "source_artifact_id_a" in pairs.columns:
        sources = [F.array_distinct(F.array_compact(F.when(F.col("event_id_a") <= F.col("event_id_b"), F.array("source_artifact_id_a", "source_artifact_id_b")).otherwise(F.array("source_artifact_id_b", "source_artifact_id_a")))).alias("sources")]
    return pairs.select(
        F.lit(kind).alias("relation"), F.least("event_id_a", "event_id_b").alias("event_a"), F.greatest("event_id_a", "event_id_b").alias("event_b"),
        (F.lit(None).cast("string") if value is None else value).alias("value"), delta().alias("delta_seconds"),
        F.when(same, F.least("ts_us_a", "ts_us_b")).alias("start_us"), F.when(same, F.greatest("ts_us_a", "ts_us_b")).alias("end_us"),
        *sources,
    )


def temporal(events: DataFrame, window: float = WINDOW) -> DataFrame:
    """Same class and within the window.

    The timed events are written once with what the edges need, and joined with the later ones: the earlier event of
    a pair (of one instant: that of the smaller id) looks into two buckets.
    """
    timed = events.filter((F.col("ts_class") != times.MISSING) & F.col("ts_us").isNotNull())
    rows = materialize(timed.select(*(c for c in ("event_id", "ts_class", "ts_us", "source_artifact_id") if c in events.columns)), "timed", clean=True)
    pairs = band_join(side(rows, "a"), side(rows, "b"), [], window, after=True)
    in_order = (F.col("ts_us_a") < F.col("ts_us_b")) | (F.col("event_id_a") < F.col("event_id_b"))
    return edges(pairs.filter(in_order & (F.col("event_id_a") != F.col("event_id_b"))), "TEMPORAL")


def first_of(columns: list[str], *names: str) -> Column:
    """The first of these fields that an event has, as a column or else as a key of its attributes; null if blank."""
    have = []
    for c in names:
        have += [F.col(c).cast("string")] if c in columns else []
        have += [F.try_element_at("attributes", F.lit(c))] if "attributes" in columns else []
    return F.nullif(times.strip(F.coalesce(*have, F.lit(None).cast("string"))), F.lit(""))


# The fields of each identity, first to last.
USER = ["username", "user", "account"]
SOURCE = ["source_ip", "src_ip", "hostname", "source_host"]
PATH = ["path", "target_path", "file_path"]
SESSION = ["session_id", "session"]
#: Columns of an event where no table is given.
TIMELINE = ["username", "source_ip", "source_path", "session_id"]


def user_identity(events: DataFrame | None = None) -> Column:
    return first_of(TIMELINE if events is None else events.columns, *USER)


def source_identity(events: DataFrame | None = None) -> Column:
    return first_of(TIMELINE if events is None else events.columns, *SOURCE)


def path_identity(events: DataFrame | None = None) -> Column:
    return F.nullif(normalize_path(first_of(TIMELINE if events is None else events.columns, *PATH, "source_path")), F.lit(""))


def session_identity(events: DataFrame | None = None) -> Column:
    return first_of(TIMELINE if events is None else events.columns, *SESSION)


def same_identity(events: DataFrame, kind: str, identity: Column, window: float = WINDOW, untimed: bool = True) -> DataFrame:
    """Equal identity and within the window; with untimed also pairs whose times do not compare (they grow with the square of an identity's events)."""
    rows = events.withColumn("ident", identity).filter(F.col("ident").isNotNull())
    if untimed:  # written once: several joins read it
        rows = materialize(rows.select(*(c for c in [*SIDE, "ident"] if c in rows.columns)), "identities")
    a, b = side(rows, "a", ["ident"]), side(rows, "b", ["ident"])
    pairs = band_join(a, b, ["ident"], window).filter(F.col("event_id_a") < F.col("event_id_b"))
    if untimed:
        pairs = pairs.unionByName(untimed_pairs(a, b).select(pairs.columns))
    return edges(pairs, kind, F.col("ident_a"))


def untimed_pairs(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of equal identity whose times do not compare, each once: of different classes, or without a time both.

    The join is on identity and class, each event of the left asks for the classes that it does not compare with, so
    timed pairs of one class are never made. Of a class of an identity with more than block events the right ones are
    dealt into blocks that the left ones all go to: no task joins the whole of a busy identity.
    """
    known = lambda s: F.when(F.col(f"ts_class_{s}").isNull() | F.col(f"ts_us_{s}").isNull(), times.MISSING).otherwise(F.col(f"ts_class_{s}"))
    classes = F.array(*map(F.lit, [times.AWARE, times.NAIVE, times.MISSING]))
    a = a.withColumn("_class", F.explode(F.filter(classes, lambda c: ~times.comparable(known("a"), c))))
    b = b.withColumn("_class_b", known("b"))
    busy = b.groupBy(F.col("ident_b").alias("_ident"), F.col("_class_b").alias("_of")).agg(F.count("*").alias("n")).filter(F.col("n") > block)
    busy = F.broadcast(busy.select("_ident", "_of", F.ceil(F.col("n") / block).cast("int").alias("_blocks")))  # fewer rows than blocks of events
    blocks = F.coalesce("_blocks", F.lit(1))
    a = a.join(busy, (F.col("ident_a") == F.col("_ident")) & (F.col("_class") == F.col("_of")), "left")
    a = a.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_ident", "_of", "_blocks")
    b = b.join(busy, (F.col("ident_b") == F.col("_ident")) & (F.col("_class_b") == F.col("_of")), "left")
    b = b.withColumn("_block_b", F.pmod(F.xxhash64("event_id_b"), blocks).cast("int")).drop("_ident", "_of", "_blocks")
    on = (F.col("ident_a") == F.col("ident_b")) & (F.col("_class") == F.col("_class_b")) & (F.col("_block") == F.col("_block_b"))
    return a.join(b, on & (F.col("event_id_a") < F.col("event_id_b")))


def untimed_links(events: DataFrame, identity: Column) -> DataFrame:
    """event_id, value, ts_class, n_links: of each event with an identity, how many events of equal identity have times that do not compare with its own.

    These links as membership and counts: two events of one value are linked where their classes differ or
    both have no time. Counted by value and class, so the rows grow with the events, not with their pairs.
    """
    rows = events.withColumn("value", identity).filter(F.col("value").isNotNull())
    classes = rows.groupBy("value", "ts_class").agg(F.count("*").alias("alike"))
    totals = classes.groupBy("value").agg(F.sum("alike").alias("total"))
    missing = F.col("ts_class") == times.MISSING
    links = classes.join(totals, "value").select("value", "ts_class", (F.col("total") - F.when(missing, F.lit(1)).otherwise(F.col("alike"))).alias("n_links"))
    return rows.select("event_id", "value", "ts_class").join(links, ["value", "ts_class"]).select("event_id", "value", "ts_class", "n_links")


def same_user(events: DataFrame, window: float = WINDOW, untimed: bool = True) -> DataFrame:
    return same_identity(events, "SAME_USER", user_identity(events), window, untimed)


def same_source(events: DataFrame, window: float = WINDOW, untimed: bool = True) -> DataFrame:
    return same_identity(events, "SAME_SOURCE", source_identity(events), window, untimed)


def same_path(events: DataFrame, window: float = WINDOW, untimed: bool = True) -> DataFrame:
    return same_identity(events, "SAME_PATH", path_identity(events), window, untimed)


def same_session(events: DataFrame, window: float = WINDOW, untimed: bool = True) -> DataFrame:
    return same_identity(events, "SAME_SESSION", session_identity(events), window, untimed)


def is_authentication() -> Column:
    status = F.upper(F.coalesce("status", F.lit("")))
    return F.when(F.lower("category") == "authentication", ~status.isin(FAILED)).otherwise(F.lower("event_type").isin(AUTHENTICATED_TYPES))


def is_privilege(events: DataFrame) -> Column:
    t = F.lower("event_type")
    command = F.coalesce(F.lower(first_of(events.columns, "command")), F.lit(""))
    return t.isin(PRIVILEGE_TYPES) | t.contains("sudo") | t.contains("privilege") | command.contains("sudo")


def authentication_privilege(events: DataFrame, window: float = WINDOW) -> DataFrame:
    """Authentication followed by privilege use, users equal or one absent, by comparable times (`privilege_without_time` has the others).

    The events of either role are written once with what the edges need. The interval join has one branch for equal
    users and one for rows without a user, so that a busy user is joined inside its own buckets only. Two events that
    both have both roles, at one instant, are a pair in the order of their ids only.
    """
    timed = events.filter((F.col("ts_class") != times.MISSING) & F.col("ts_us").isNotNull())
    rows = materialize(roles(timed).select(*(c for c in ("event_id", "ts_class", "ts_us", "source_artifact_id") if c in events.columns), "ident", "auth", "privilege"), "roles", clean=True)
    auth, priv = (side(rows.filter(role), s, ["ident", other]) for role, s, other in (("auth", "a", "privilege"), ("privilege", "b", "auth")))
    equal = band_join(auth, priv, ["ident"], window, after=True)
    absent = band_join(auth, priv.filter("ident_b is null"), [], window, after=True).unionByName(
        band_join(auth.filter("ident_a is null"), priv.filter("ident_b is not null"), [], window, after=True)
    )
    mirrored = F.col("privilege_a") & F.col("auth_b") & (F.col("ts_us_a") == F.col("ts_us_b")) & (F.col("event_id_a") > F.col("event_id_b"))
    pairs = equal.unionByName(absent).filter((F.col("event_id_a") != F.col("event_id_b")) & ~mirrored)
    return edges(pairs, "AUTHENTICATION_PRIVILEGE", F.coalesce("ident_a", "ident_b", F.lit("unknown")))


def privilege_without_time(events: DataFrame, block: int = timeline.BLOCK) -> DataFrame:
    """The links of authentication to privilege use of which one event or both have no time: as membership and counts.

    Where a time is missing the order of the timeline decides: events without a time stand behind all others, so such
    a link leads from an authentication, timed or not, to a privilege use without a time at a later position, with
    users equal or one absent. Given is a row for each event and role that has such links: event_id, role
    (authentication or privilege), value (its user) and n_links. An event may have both roles, and is not linked to
    itself. Pairs grow with the product of the two sides, these rows with the events; `linked_without_time` lists the
    pairs of chosen events.

    An authentication is counted under its user (or under absence) and once more under everybody; a privilege use
    asks for its user and for absence, or for everybody where it has no user itself.
    """
    rows = roles(events)
    untimed, timed = rows.filter(F.col("ts_class") == times.MISSING), rows.filter((F.col("ts_class") != times.MISSING) & F.col("auth"))
    placed = timeline.with_position(untimed)
    told = F.when(F.col("ident").isNull(), F.struct(F.lit("absent").alias("kind"), F.lit("").alias("user"))).otherwise(F.struct(F.lit("user").alias("kind"), F.col("ident").alias("user")))
    anybody, nobody = (F.struct(F.lit(k).alias("kind"), F.lit("").alias("user")) for k in ("any", "absent"))
    as_auth = F.explode(F.array(told, anybody)).alias("key")
    as_privilege = F.explode(F.when(F.col("ident").isNull(), F.array(anybody)).otherwise(F.array(told, nobody))).alias("key")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    a = placed.filter("auth").select("event_id", F.lit("authentication").alias("role"), "ident", "position", as_auth, one.alias("a"), none.alias("b"))
    b = placed.filter("privilege").select("event_id", F.lit("privilege").alias("role"), "ident", "position", as_privilege, none.alias("a"), one.alias("b"))
    among = timeline.counts_around(a.unionByName(b), "key", block)
    found = among.select("event_id", "role", F.col("ident").alias("value"), F.when(F.col("role") == "privilege", F.col("a_before")).otherwise(F.col("b_after")).alias("n"))
    # timed authentications stand before every event without a time: totals are enough
    early = timed.select("event_id", "ident", as_auth)
    early_sums, late_sums = early.groupBy("key").agg(F.count("*").alias("n")), b.groupBy("key").agg(F.count("*").alias("n"))
    found = found.unionByName(_by_key(b, early_sums).select("event_id", F.lit("privilege").alias("role"), F.col("ident").alias("value"), "n"))
    found = found.unionByName(_by_key(early, late_sums).select("event_id", F.lit("authentication").alias("role"), F.col("ident").alias("value"), "n"))
    return found.groupBy("event_id", "role", "value").agg(F.sum("n").alias("n_links")).filter("n_links > 0")


def _by_key(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """rows with n of their key; the two keys that all rows may share are two rows, broadcast."""
    shared = F.col("key.kind") != "user"
    return rows.filter(~shared).join(sums.filter(~shared), "key").unionByName(rows.filter(shared).join(F.broadcast(sums.filter(shared)), "key"))


def roles(events: DataFrame) -> DataFrame:
    """Events of authentication or privilege use, with ident, auth and privilege."""
    rows = events.withColumn("ident", user_identity(events)).withColumn("auth", F.coalesce(is_authentication(), F.lit(False))).withColumn("privilege", F.coalesce(is_privilege(events), F.lit(False)))
    return rows.filter("auth or privilege")


def linked_without_time(events: DataFrame, event_ids: list[str]) -> DataFrame:
    """The pairs of `privilege_without_time` (event_a: authentication, event_b: privilege use) of the given events, in either role."""
    rows = roles(events).withColumn("late", F.col("ts_class") == times.MISSING).select("event_id", "ident", "auth", "privilege", "late", F.struct(*timeline.sort_key()).alias("key"))
    chosen = F.broadcast(rows.filter(F.col("event_id").isin(event_ids)))  # as many as are given
    sided = lambda d, s: d.select(*(F.col(c).alias(f"{c}_{s}") for c in rows.columns))
    fits = (F.col("auth_a") & F.col("privilege_b") & F.col("late_b")) & (F.col("key_a") < F.col("key_b")) & F.coalesce(F.col("ident_a") == F.col("ident_b"), F.lit(True))
    pairs = sided(chosen, "a").join(sided(rows, "b"), fits).unionByName(sided(rows, "a").join(sided(chosen, "b"), fits))
    return pairs.select(F.col("event_id_a").alias("event_a"), F.col("event_id_b").alias("event_b"), F.coalesce("ident_a", "ident_b", F.lit("unknown")).alias("value")).distinct()


# Fields of a host event that hold an address, and those that hold a port.
HOST_ADDRESSES = ["source_ip", "src_ip", "client_ip", "remote_ip", "target_ip", "destination_ip", "dst_ip", "ip_address", "host_ip"]
HOST_PORTS = ["source_port", "src_port", "port", "target_port", "dst_port"]
NOTES = {
    "private": "the address is private, loopback or reserved: it may be translated, assigned anew or used twice",
    "shared": "an address is not a machine: proxies, translation or dynamic assignment may stand between",
    "ports": "the ports of the host event are not those of the packet",
}


def each_field(events: DataFrame, names: list[str]) -> Column:
    """The values of all these fields, as columns or as keys of the attributes, as an array of texts; null where an event has none."""
    have = []
    for c in names:
        have += [F.col(c).cast("string")] if c in events.columns else []
        have += [F.try_element_at("attributes", F.lit(c))] if "attributes" in events.columns else []
    return F.array(*have) if have else F.array().cast("array<string>")


def fields_of(events: DataFrame, names: list[str]) -> Column:
    """The values of all these fields that an event has."""
    return F.array_compact(each_field(events, names))


def addressed(rows: DataFrame, raw: str) -> DataFrame:
    """rows with `ends`, the canonical addresses (of both versions) in place of the texts of raw, and `ips`, the distinct ones. Only rows with a colon go through Python."""
    colon = F.exists(raw, lambda x: F.coalesce(x.contains(":"), F.lit(False)))
    four, six = rows.filter(~colon), rows.filter(colon)
    both = once(four, "ends", normalize_ips(F.col(raw))).unionByName(once(six, "ends", normalize_ips(F.col(raw), ipv6=True)))
    return both.drop(raw).withColumn("ips", F.array_distinct(F.array_compact("ends")))


def ports(events: DataFrame, names: list[str]) -> Column:
    """The distinct ports of an event, in order."""
    valid = F.filter(F.transform(fields_of(events, names), lambda p: F.when(F.trim(p).rlike("^[0-9]{1,5}$"), F.trim(p).try_cast("int"))), lambda p: p.between(1, 65535))
    return F.array_sort(F.array_distinct(valid))


#: Distinct keys of the host events up to which network events without any of them are left out before the join (a broadcast of that many rows).
ASKED = 1 << 18


def host_network(host: DataFrame, network: DataFrame, window: float = WINDOW, known_ips: list[str] = ()) -> DataFrame:
    """Host events against network events by address, known host address, user or session; the first that holds wins.

    A host event has the set of all addresses and ports that its fields name (columns or attributes, both versions of
    addresses), a network event its two ends. Times must compare. A different user or session on both sides rejects the
    pair. The smallest common address is reported, with notes on what it does not tell. known_ips are the host's own.

    One join on way and key. A row of a key carries the addresses that would win over it, so that of the keys of a pair
    only the best gives a row: pairs are not grouped, and nothing is fetched for them. Both tables are read several
    times: write before what is costly to compute.
    """
    has = lambda d, names: any(c in d.columns for c in [*names, "attributes"])
    by_user, by_session = (has(host, names) and has(network, names) for names in (USER, SESSION))
    columns = {"src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int"}
    network = reduce(lambda d, c: d if c in d.columns else d.withColumn(c, F.lit(None).cast(columns[c])), columns, network)
    timed = (F.col("ts_class") != times.MISSING) & F.col("ts_us").isNotNull()
    told = lambda d: d.filter(timed).withColumn("user", F.lower(user_identity(d)) if by_user else F.lit(None).cast("string")).withColumn("session", session_identity(d) if by_session else F.lit(None).cast("string"))
    at = ["event_id", "ts_class", "ts_us", "user", "session"]
    h, n = told(host.filter(F.lower("category") != "network")), told(network.filter(F.lower("category") == "network"))
    spread = "a" if h.count() <= n.count() else "b"  # the rows of the smaller side are the ones to repeat
    h = addressed(h.select(*at, ports(h, HOST_PORTS).alias("ports"), each_field(h, HOST_ADDRESSES).alias("raw")), "raw")
    n = addressed(n.select(*at, ports(n, ["src_port", "dst_port"]).alias("net_ports"), F.array("src_ip", "dst_ip", *(F.try_element_at("attributes", F.lit(c)) for c in ("src_ip", "dst_ip") if "attributes" in n.columns)).alias("raw")), "raw")
    own = F.array(*(F.lit(k) for k in known_ips)) if known_ips else None
    known = F.array_min(F.array_intersect(own, F.col("ips"))) if known_ips else F.lit(None).cast("string")
    direction = lambda k: F.when(k == F.col("ends")[0], "outbound").when(k == F.col("ends")[1], "inbound")

    def key(rank: int, k: Column, better: Column, *more: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), k.alias("k"), better.alias("better"), *more)

    def keys(more, *ways: tuple[int, Column, Column | None]) -> Column:
        """The keys of a row: its addresses, and the given ways where they have a key and their condition holds."""
        every = [F.transform("ips", lambda k: key(1, k, F.filter("ips", lambda x: x < k), *more(k)))]
        for rank, k, cond in ways:
            there = k.isNotNull() if cond is None else k.isNotNull() & cond
            every.append(F.filter(F.array(F.when(there, key(rank, k, F.col("ips"), *more(k)))), lambda x: x.isNotNull()))
        return F.concat(*every)

    named = [(3, F.col("user"))] * by_user + [(4, F.col("session"))] * by_session
    of_host = keys(lambda k: [], *((2, F.lit(k), None) for k in dict.fromkeys(known_ips)), *((rank, c, None) for rank, c in named))
    of_net = keys(lambda k: [direction(k).alias("direction")], *([(2, known, None)] if known_ips else []), *((rank, c, known.isNull()) for rank, c in named))
    h = h.select(*(F.col(c).alias(f"{c}_a") for c in at), "ports", F.explode(of_host).alias("_a")).select("*", *(F.col(f"_a.{c}").alias(f"{c}_a") for c in ("rank", "k", "better"))).drop("_a")
    n = n.select(*(F.col(c).alias(f"{c}_b") for c in at), "net_ports", F.explode(of_net).alias("_b")).select("*", *(F.col(f"_b.{c}").alias(f"{c}_b") for c in ("rank", "k", "better")), "_b.direction").drop("_b")
    asked = h.select(F.col("rank_a").alias("rank_b"), F.col("k_a").alias("k_b")).distinct()
    if asked.limit(ASKED + 1).count() <= ASKED:
        n = n.join(F.broadcast(asked), ["rank_b", "k_b"], "left_semi")
    equal_user = F.coalesce(F.col("user_a") == F.col("user_b"), F.lit(False))
    conflict = F.coalesce(F.col("user_a") != F.col("user_b"), F.lit(False)) | F.coalesce(F.col("session_a") != F.col("session_b"), F.lit(False))
    beaten = F.arrays_overlap("better_a", "better_b") | ((F.col("rank_a") == 4) & equal_user)
    m = band_join(h, n, ["rank", "k"], window, spread=spread).filter(~conflict & ~beaten).withColumns({"rank": F.col("rank_a"), "value": F.col("k_a")})
    names = F.array(*map(F.lit, ["ip_match", "host_endpoint_ip_match", "user_match", "session_match"]))
    addressed_by = F.col("rank") <= 2
    private = F.coalesce(addressed_by & is_private_ip(F.col("value"), ipv6=True), F.lit(False))
    aligned = F.arrays_overlap("ports", "net_ports")
    notes = F.array_compact(F.array(F.when(addressed_by, F.when(private, NOTES["private"]).otherwise(NOTES["shared"])), F.when((F.size("ports") > 0) & ~aligned, NOTES["ports"])))
    return m.select(
        F.col("event_id_a").alias("host_event"), F.col("event_id_b").alias("network_event"), F.element_at(names, F.col("rank")).alias("dimension"), "value", (F.abs(F.col("ts_us_a") - F.col("ts_us_b")) / F.lit(1_000_000.0)).alias("delta_seconds"),
        F.when(addressed_by, F.col("direction")).alias("direction"), F.coalesce(aligned, F.lit(False)).alias("port_aligned"),
        equal_user.alias("user_aligned"), private.alias("private_address"), F.least("ts_us_a", "ts_us_b").alias("start_us"), F.greatest("ts_us_a", "ts_us_b").alias("end_us"), notes.alias("notes"),
    )


def host_network_edges(found: DataFrame) -> DataFrame:
    """The pairs of host_network as edges of one relation, with their dimension, direction and alignment, as rules on links need them."""
    ends = {"event_a": F.least("host_event", "network_event"), "event_b": F.greatest("host_event", "network_event"), "relation": F.lit("HOST_NETWORK")}
    return found.withColumns(ends).drop("host_event", "network_event")


def with_ids(links: DataFrame, unique: bool = False) -> DataFrame:
    """Edges with their id, one row an id.

    unique: no edge is there twice, as in the links of one kind over events of different ids. Then none is looked
    for, and the pairs, which may be far more than the events, are not shuffled.
    """
    named = links.withColumn("edge_id", ids.edge_id(F.col("relation"), F.col("event_a"), F.col("event_b")))
    return named if unique else named.dropDuplicates(["edge_id"])


def top(links: DataFrame, most: int) -> DataFrame:
    """The first edges by start (missing last), relation and events. The cap is on this order, not on discovery."""
    return links.orderBy(F.col("start_us").asc_nulls_last(), "relation", "event_a", "event_b").limit(most)


def counts(links: DataFrame) -> DataFrame:
    return links.groupBy("relation").agg(F.count("*").alias("n"), F.min("delta_seconds").alias("least"), F.max("delta_seconds").alias("most"))
