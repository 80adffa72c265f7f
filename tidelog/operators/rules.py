"""Declarative rules over single events, linked pairs and ordered sequences, compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import ids, times
from tidelog.functions.shared import materialize
from tidelog.operators.correlate import WINDOW

# Symbolic forms of the operators.
ALIASES = {
    "==": "equals",
    "=": "equals",
    "!=": "not_equals",
    ">": "greater_than",
    ">=": "greater_or_equal",
    "<": "less_than",
    "<=": "less_or_equal",
}


@dataclass(frozen=True)
class Condition:
    """field operator value; the field is a column or a dotted path into structs and maps, else a key of `attributes`."""

    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Rule:
    name: str
    explanation: str = ""
    categories: tuple[str, ...] = ()
    event_types: tuple[str, ...] = ()
    relations: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()
    window: float | None = None
    tags: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a rule needs a name")
        if any(callable(c.value) for c in self.conditions):
            raise ValueError("rules hold values, no code")
        if len(set(self.event_types)) > 1 and not self.relations and self.window is None:
            raise ValueError("a sequence needs a window")

    @property
    def rule_id(self) -> str:
        """Of all that tells one rule from another: rules of one name with other types or conditions are other rules."""
        asked = [",".join(sorted(set(self.event_types))), ",".join(sorted(set(self.relations))), ";".join(sorted(f"{c.field} {ALIASES.get(c.operator, c.operator)} {c.value!r}" for c in self.conditions))]
        return f"RULE-{ids.uuid.uuid5(ids.namespace('rule'), ':'.join([self.name.strip(), *(a for a in asked if a)]))}"


def type_of(value: Any) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    return T.DoubleType() if isinstance(value, (int, float)) else T.StringType()


def equal(actual: Column, value: Any, kind: T.DataType) -> Column:
    """Equality within one type: numbers with numbers, booleans with booleans, texts with texts."""
    if isinstance(kind, T.ArrayType) and isinstance(value, (list, tuple)):
        same = [equal(F.get(actual, F.lit(k)), v, kind.elementType) for k, v in enumerate(value)]
        return reduce(lambda x, y: x & y, same, F.size(actual) == len(value))
    wanted = type_of(value)
    if isinstance(kind, T.NumericType) and isinstance(wanted, T.DoubleType):
        return F.coalesce(actual.cast("double") == F.lit(float(value)), F.lit(False))
    alike = type(kind) is type(wanted) and not isinstance(value, (list, tuple, dict))
    return F.coalesce(actual == F.lit(value), F.lit(False)) if alike else F.lit(False)


def compare(actual: Column, operator: str, value: Any = None, kind: T.DataType | None = None) -> Column:
    """One predicate on a column of the given type (where none is given: of the value's).

    A missing field holds for `exists` false only. Numbers compare as doubles, and never with booleans or
    texts. `contains` is a part of a text, a member of an array, a key of a map; `in` a member of a list, or
    a part of the value if that is a text.
    """
    op = ALIASES.get(operator, operator)
    if op == "exists":
        return actual.isNotNull() if value in (None, True) else actual.isNull()
    if kind is None:
        kind = type_of(next(iter(value), None) if isinstance(value, (list, tuple, set, frozenset)) else value)
    text, no = isinstance(kind, T.StringType) and isinstance(value, str), F.lit(False)
    if op == "equals":
        hit = equal(actual, value, kind)
    elif op == "not_equals":
        hit = ~equal(actual, value, kind)
    elif op == "in":
        if isinstance(value, (list, tuple, set, frozenset)):
            hit = reduce(lambda x, y: x | y, (equal(actual, v, kind) for v in value), no)
        else:
            hit = F.lit(value).contains(actual) if text else no
    elif op == "contains":
        if isinstance(kind, T.ArrayType):
            hit = F.exists(actual, lambda x: equal(x, value, kind.elementType))
        elif isinstance(kind, T.MapType):
            hit = F.exists(F.map_keys(actual), lambda x: equal(x, value, kind.keyType))
        else:
            hit = actual.contains(value) if text else no
    elif op == "starts_with":
        hit = actual.startswith(value) if text else no
    elif op == "ends_with":
        hit = actual.endswith(value) if text else no
    else:
        numbers = isinstance(kind, T.NumericType) and isinstance(type_of(value), T.DoubleType)
        moments = isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(value, datetime)
        a, b = (actual.cast("double"), F.lit(float(value))) if numbers else (actual, F.lit(value))
        ordered = {"greater_than": lambda: a > b, "greater_or_equal": lambda: a >= b, "less_than": lambda: a < b, "less_or_equal": lambda: a <= b}[op]
        hit = ordered() if numbers or moments else no
    return actual.isNotNull() & F.coalesce(hit, no)


def look_up(schema: T.StructType, name: str, suffix: str = "") -> tuple[Column, T.DataType]:
    """A field by its dotted path: columns, fields of structs (of an array of structs: that field of every element), keys of maps; else a key of the attributes map. With its type."""
    missing = F.lit(None).cast("string"), T.StringType()
    head, _, rest = name.partition(".")
    if head in schema.fieldNames():
        col, kind = F.col(f"`{head}{suffix}`"), schema[head].dataType
    elif "attributes" in schema.fieldNames() and head != "attributes":
        col, kind, rest = F.col(f"attributes{suffix}"), schema["attributes"].dataType, name
    else:
        return missing
    while rest:
        if isinstance(kind, T.MapType):  # a key may hold dots itself
            return F.try_element_at(col, F.lit(rest)), kind.valueType
        head, _, rest = rest.partition(".")
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and head in kind.elementType.fieldNames():  # of every element
            col, kind = col[head], T.ArrayType(kind.elementType[head].dataType)
            continue
        if not isinstance(kind, T.StructType) or head not in kind.fieldNames():
            return missing
        col, kind = col[head], kind[head].dataType
    return col, kind


def test(schema: T.StructType, c: Condition, name: str | None = None, suffix: str = "") -> Column:
    col, kind = look_up(schema, name or c.field, suffix)
    return compare(col, c.operator, c.value, kind)


def holds(schema: T.StructType, rule: Rule, suffix: str = "") -> Column:
    return reduce(lambda a, b: a & b, (test(schema, c, suffix=suffix) for c in rule.conditions), F.lit(True))


DETECTION = ["rule_id", "rule_name", "event_ids", "start_us", "end_us", "delta_seconds"]


def single(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules over one event each, all in one scan: category among the rule's, its type, all conditions."""
    hits = []
    for r in rules:
        ok = holds(events.schema, r)
        ok = ok & F.col("category").isin(list(r.categories)) if r.categories else ok
        ok = ok & F.col("event_type").isin(list(r.event_types)) if r.event_types else ok
        hits.append(F.when(ok, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"))))
    out = events.select("*", F.explode(F.array_compact(F.array(*hits))).alias("r"))
    return out.select("r.*", F.array("event_id").alias("event_ids"), F.col("ts_us").alias("start_us"), F.col("ts_us").alias("end_us"), F.when(F.col("ts_class") != times.MISSING, F.lit(0.0)).alias("delta_seconds"))


def linked(events: DataFrame, links: DataFrame, rule: Rule, closed: bool = False) -> DataFrame:
    """A rule over edges: the relation, all categories and all types on the two events, the rule's window, all conditions.

    An edge counts if both of its events are there. closed: the links were made of these events, so that they are; a
    rule that asks nothing of the events then doesn't look them up.

    A condition on a bare field holds on the edge or on an event; `correlation.f` names the edge's field,
    `events[0].f` and `events[1].f` those of the edge's first and second event.
    """
    cols = [c for c in events.columns]
    pair = links.filter(F.col("relation").isin(list(rule.relations)))
    if rule.window is not None:
        pair = pair.filter(F.col("delta_seconds") <= rule.window)
    bare = not rule.categories and not rule.event_types and not rule.conditions
    for s in () if closed and bare else ("a", "b"):
        pair = pair.join(events.select(*(F.col(c).alias(f"{c}_{s}") for c in cols)), F.col(f"event_{s}") == F.col(f"event_id_{s}"))
    on_any = lambda col, v: (F.col(f"{col}_a") == v) | (F.col(f"{col}_b") == v)
    ok = F.lit(True)
    for c in rule.categories:
        ok = ok & on_any("category", c)
    for t in rule.event_types:
        ok = ok & on_any("event_type", t)
    for c in rule.conditions:
        place, _, rest = c.field.partition(".")
        if place == "correlation" and rest:
            ok = ok & test(links.schema, c, rest)
        elif place in ("events[0]", "events[1]") and rest:
            ok = ok & test(events.schema, c, rest, "_a" if place == "events[0]" else "_b")
        else:
            edge = test(links.schema, c) if c.field.partition(".")[0] in links.columns else F.lit(False)
            ok = ok & (edge | test(events.schema, c, suffix="_a") | test(events.schema, c, suffix="_b"))
    return pair.filter(ok).select(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), F.array("event_a", "event_b").alias("event_ids"), "start_us", "end_us", "delta_seconds")


#: What the order of the timeline looks at behind the time and before the id.
ORDERED = ["source_path", "source_line", "source_artifact_id", "source_event_id", "event_type", "description"]


def _later(prefix_a: str, prefix_b: str) -> Column:
    """Whether event b stands after event a in timeline order (times of one class)."""
    parts = ["ts_us", *ORDERED, "event_id"]
    key = lambda s: F.struct(*(F.coalesce(F.col(f"{c}{s}"), F.lit(-1 if c in ("ts_us", "source_line") else "")).alias(c) for c in parts))
    return key(prefix_b) > key(prefix_a)


def sequence(events: DataFrame, rule: Rule) -> DataFrame:
    """k different types in timeline order, each within the window of the first event, every combination.

    Times to the first event compare, so all are of one class. Time is dealt into buckets of the window's width. The first
    event stays in its own, each later one looks into its own and the one before, and all k - 1 joins are on the first
    event's bucket and class: only events are shuffled, the combinations, which may be far more, stay where they are.
    """
    types = list(dict.fromkeys(rule.event_types))
    rows = events.filter(F.col("category").isin(list(rule.categories))) if rule.categories else events
    rows = rows.filter((F.col("ts_class") != times.MISSING) & F.col("ts_us").isNotNull() & F.col("event_type").isin(types))
    us = int(rule.window * 1_000_000)
    bucket = F.floor(F.col("ts_us") / max(1, us)).cast("long")
    keep = [c for c in ("event_id", "ts_class", "ts_us", *ORDERED) if c in rows.columns]
    rows = materialize(rows.select(keep), "steps", clean=True)  # every step reads it
    step = lambda t, where: rows.filter(F.col("event_type") == t).select(*keep, where.alias("bucket"))
    sided = lambda d, s: d.select(*(F.col(c).alias(f"{c}{s}") for c in d.columns))
    chain, sides = sided(step(types[0], bucket), "_a"), ["_a"]
    for k, t in enumerate(types[1:]):
        s = f"_s{k}"
        gap = F.col(f"ts_us{s}") - F.col("ts_us_a")
        on = (F.col("bucket_a") == F.col(f"bucket{s}")) & (F.col("ts_class_a") == F.col(f"ts_class{s}"))
        chain = chain.join(sided(step(t, F.explode(F.array(bucket, bucket - 1))), s), on).filter(gap.between(0, us) & _later(sides[-1], s))
        sides.append(s)
    last = F.col(f"ts_us{sides[-1]}")
    return chain.select(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), F.array(*(f"event_id{s}" for s in sides)).alias("event_ids"), F.col("ts_us_a").alias("start_us"), last.alias("end_us"), ((last - F.col("ts_us_a")) / F.lit(1_000_000.0)).alias("delta_seconds"))


def evaluate(events: DataFrame, rules: list[Rule], links: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """Detections of all rules, each once.

    unique: no two events have one id, and the links are of these events, no pair twice. No detection of a rule can then
    be there twice, and the detections, which may be far more than the events, are not shuffled to look for one.
    """
    if unique:
        rules = list({r.rule_id: r for r in rules}.values())
    one = [r for r in rules if not r.relations and len(set(r.event_types)) <= 1]
    parts = [single(events, one)] if one else []
    parts += [sequence(events, r) for r in rules if not r.relations and len(set(r.event_types)) > 1]
    parts += [linked(events, links, r, closed=unique) for r in rules if r.relations and links is not None]
    out = reduce(lambda a, b: a.unionByName(b), parts).withColumn("detection_id", ids.detection_id(F.col("rule_id"), F.col("event_ids")))
    return out if unique else out.dropDuplicates(["detection_id"])


def detection_order(detections: DataFrame) -> DataFrame:
    """By start (missing last), rule and events. The id follows from rule and events; it is made behind the sort and not shuffled."""
    out = detections.drop("detection_id").orderBy(F.col("start_us").asc_nulls_last(), "rule_id", "event_ids")
    return out.withColumn("detection_id", ids.detection_id(F.col("rule_id"), F.col("event_ids"))).select(detections.columns)


def counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("rule_name").agg(F.count("*").alias("n"))


def findings(detections: DataFrame, most: int = 25) -> DataFrame:
    """Per rule: how many, first and last time; the most frequent rules."""
    return detections.groupBy("rule_name").agg(F.count("*").alias("n"), F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us")).orderBy(F.desc("n"), "rule_name").limit(most)


def ssh_then_sudo(window: float = WINDOW) -> Rule:
    return Rule("SSH login followed by sudo", "Observed a successful SSH login followed by a sudo command of the same identity.", ("authentication",), ("ssh_login_success", "sudo_command"), ("AUTHENTICATION_PRIVILEGE",), window=window)


def failure_then_success(window: float = WINDOW) -> Rule:
    return Rule("SSH failure followed by success", "Observed a failed SSH login followed by a successful one.", ("authentication",), ("ssh_login_failure", "ssh_login_success"), window=window)


def account_then_privilege(window: float = WINDOW, account: str = "user_added", privilege: str = "sudo_command") -> Rule:
    return Rule("Account activity followed by privilege use", "Observed account activity followed by privilege use.", ("account", "authentication"), (account, privilege), window=window)


def privilege_then_persistence(window: float = WINDOW, trigger: str = "sudo_command", persistence: str = "cron_job_scheduled") -> Rule:
    return Rule("Privilege use followed by persistence change", "Observed privilege use followed by a change of startup configuration.", ("authentication", "persistence"), (trigger, persistence), window=window)


def host_pack(window: float = WINDOW) -> list[Rule]:
    return [ssh_then_sudo(window), failure_then_success(window), account_then_privilege(window), privilege_then_persistence(window)]


def field_rule(name: str, category: str, event_types: tuple[str, ...] = (), /, **wanted: Any) -> Rule:
    """A rule over one event: each named field equals its value, or is one of a list."""
    conditions = tuple(Condition(f, "in" if isinstance(v, (list, tuple)) else "equals", v) for f, v in wanted.items() if v is not None)
    return Rule(name, f"Observed {name}.", (category,), event_types, conditions=conditions)


def dns_rule(query_name: str | None = None, answer: str | None = None, query_type: str | None = None, **more: Any) -> Rule:
    """A query by name or type, or one whose answers hold a value."""
    rule = field_rule("DNS query", "network", ("dns_query",), query_name=query_name, query_type=query_type, **more)
    return rule if answer is None else replace(rule, conditions=(*rule.conditions, Condition("answers.data", "contains", answer)))


def http_rule(host: str | None = None, method: str | None = None, status: int | None = None, target: str | None = None) -> Rule:
    return field_rule("HTTP message", "network", ("http_message",), host=host, method=method, status_code=status, target=target)


def tls_rule(server_name: str | None = None, alpn: str | None = None, **more: Any) -> Rule:
    """A hello by server name, or one that offers a protocol."""
    rule = field_rule("TLS server name", "network", ("tls_hello",), server_name=server_name, **more)
    return rule if alpn is None else replace(rule, conditions=(*rule.conditions, Condition("alpn_protocols", "contains", alpn)))


def protocol_rule(transport: str | None = None, dst_port: int | None = None, src_ip: str | None = None, dst_ip: str | None = None) -> Rule:
    return field_rule("Network protocol and port", "network", (), transport_protocol=transport, dst_port=dst_port, src_ip=src_ip, dst_ip=dst_ip)


def host_network_rule(window: float = WINDOW) -> Rule:
    return Rule("Host event with network event", "Observed a host event and a network event of the same endpoint.", (), (), ("HOST_NETWORK",), window=window)


def network_pack(query_name: str, server_name: str, host: str, transport: str, port: int, window: float = WINDOW) -> list[Rule]:
    return [dns_rule(query_name), tls_rule(server_name), http_rule(host), protocol_rule(transport, port), host_network_rule(window)]


def memory_process_rule(name: str | list[str]) -> Rule:
    return field_rule("Memory process name", "memory", (), event_type=["process_created", "process_observed"], name=name)


def memory_socket_rule(port: int | None = None, state: str | None = None, protocol: str | None = None) -> Rule:
    return field_rule("Memory socket", "memory", (), event_type=["socket_created", "socket_observed"], local_port=port, state=state, protocol=protocol)


def memory_module_rule(name: str | None = None, path_prefix: str | None = None) -> Rule:
    conditions = tuple(c for c in (Condition("name", "equals", name), Condition("path", "starts_with", path_prefix)) if c.value is not None)
    return Rule("Memory module", "Observed a module.", ("memory",), ("module_observed",), conditions=conditions)


def memory_link_rule(relation: str, **wanted: Any) -> Rule:
    """Edges of memory artifacts of one relation, with fields of either side."""
    return Rule(f"Memory link {relation}", "Observed a link of memory artifacts.", (), (), (relation,), tuple(Condition(k, "equals", v) for k, v in wanted.items()))


def memory_pack(name: str, port: int, prefix: str) -> list[Rule]:
    return [memory_process_rule(name), memory_socket_rule(port), memory_module_rule(path_prefix=prefix), memory_link_rule("PROCESS_NETWORK_SOCKET"), memory_link_rule("PARENT_CHILD_PROCESS")]
