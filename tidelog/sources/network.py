"""Packet tables to network events, and the application views of DNS, TLS and HTTP."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ids
from tidelog.functions.once import once
from tidelog.functions.times import strip

# Response codes, version names, secret headers, limits of an HTTP head.
DNS_STATUS = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
TLS_VERSION = {768: "SSL 3.0", 769: "TLS 1.0", 770: "TLS 1.1", 771: "TLS 1.2", 772: "TLS 1.3"}
SECRET_HEADERS = ["authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key"]
HEAD_LINES, HEAD_CHARS = 64, 8192
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "CONNECT", "TRACE"]


def names_of(table: dict, key: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key], F.concat(F.lit("CODE"), key.cast("string")))


def packet_class() -> Column:
    """Later fragments first, then ARP, transport, first fragments, network layer, anything else."""
    fragment = F.coalesce("fragment_offset", F.lit(0)) > 0
    transport = F.upper(F.coalesce("transport_protocol", F.lit("")))
    network = F.upper(F.coalesce("network_protocol", F.lit("")))
    return (
        F.when(fragment, "ip_fragment").when(network == "ARP", "arp_packet").when(transport.isin("TCP", "UDP", "ICMP", "ICMPV6"), F.concat(F.lower(transport), F.lit("_packet")))
        .when(network.isin("IPV4", "IPV6"), F.concat(F.lower(network), F.lit("_packet"))).otherwise("generic_packet")
    )


def describe(kind: Column) -> Column:
    """A factual sentence."""
    end = lambda ip, port: F.concat(F.coalesce(ip, F.lit("unknown")), F.lit(":"), F.coalesce(F.col(port).cast("string"), F.lit("?")))
    src, dst = F.coalesce("src_ip", F.lit("unknown")), F.coalesce("dst_ip", F.lit("unknown"))
    return (
        F.when(kind.isin("tcp_packet", "udp_packet"), F.concat(F.lit("Observed "), F.upper(F.substring(kind, 1, 3)), F.lit(" packet from "), end(F.col("src_ip"), "src_port"), F.lit(" to "), end(F.col("dst_ip"), "dst_port")))
        .when(kind == "ip_fragment", F.concat(F.lit("Observed IP fragment from "), src, F.lit(" to "), dst, F.lit(" (offset "), F.col("fragment_offset").cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("Observed packet from "), src, F.lit(" to "), dst))
    )


def packet_id() -> Column:
    return ids.uuid5(ids.namespace("packet"), ids.joined(F.col("capture"), F.col("frame_number"), F.col("ts_us"), F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port")))


def packet_events(packets: DataFrame) -> DataFrame:
    """One network event a packet; line is the frame."""
    rows = packets.withColumn("packet_id", packet_id()).withColumn("kind", packet_class())
    return rows.select(
        ids.uuid5(ids.namespace("event"), ids.joined(F.col("packet_id"), F.col("kind"))).alias("event_id"), F.lit(0).alias("ts_class"), "ts_us", F.lit("network").alias("category"), F.col("kind").alias("event_type"), describe(F.col("kind")).alias("description"),
        F.col("capture").alias("source_path"), F.col("frame_number").alias("source_line"), F.col("packet_id").alias("source_event_id"), "src_ip", "dst_ip", "src_port", "dst_port", "transport_protocol", "query_name", "server_name",
    )


APPLICATION = ["query_name", "server_name", "response_code", "tls_version", "host", "method", "target", "status_code", "query_type", "answers", "alpn_protocols"]
ANSWERS = "array<struct<name:string,type:string,data:string>>"


def application_events(packets: DataFrame) -> DataFrame:
    """One event a packet with application content: TLS, else HTTP, else DNS.

    The columns server_name and tls_version, payload (the start of an HTTP message), query_name and
    response_code are looked at where the table has them; codes come out as names, a status as a number. So are
    answers (an array of structs with name, type and data) and query_type of DNS, and alpn_protocols (an array) of TLS.
    """
    have = lambda c, kind="string": F.col(c) if c in packets.columns else F.lit(None).cast(kind)
    rows = packets.withColumns({"server_name": have("server_name"), "query_name": have("query_name"), "payload": have("payload"), "_rcode": have("response_code", "int"), "_tls": have("tls_version", "int"), "query_type": have("query_type"), "answers": have("answers", ANSWERS), "alpn_protocols": have("alpn_protocols", "array<string>")})
    tls, http = F.col("server_name").isNotNull(), F.coalesce(is_http_head(F.col("payload")), F.lit(False))
    kind = F.when(tls, "tls_hello").when(http, "http_message").when(F.col("query_name").isNotNull(), "dns_query")
    rows = once(rows.withColumn("packet_id", packet_id()), "kind", kind).filter("kind is not null")
    names = ["method", "target", "status_code", "host"]
    plain = rows.filter("kind <> 'http_message'").withColumns({c: F.lit(None).cast("int" if c == "status_code" else "string") for c in names})
    heads = http_heads(rows.filter("kind = 'http_message'")).select(*rows.columns, *names)
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    text = (
        F.when(F.col("kind") == "tls_hello", F.concat(F.lit("Observed TLS server name "), "server_name")).when(F.col("kind") == "dns_query", F.concat(F.lit("Observed DNS query for "), "query_name"))
        .when(F.col("method").isNotNull(), F.concat(F.lit("Observed HTTP request "), "method", F.lit(" "), "target")).otherwise(F.concat(F.lit("Observed HTTP response "), F.col("status_code").cast("string")))
    )
    return plain.unionByName(heads).select(
        ids.uuid5(ids.namespace("event"), ids.joined(F.col("packet_id"), F.col("kind"))).alias("event_id"), F.lit(0).alias("ts_class"), "ts_us", F.lit("network").alias("category"), F.col("kind").alias("event_type"), text.alias("description"),
        F.col("capture").alias("source_path"), F.col("frame_number").alias("source_line"), F.col("packet_id").alias("source_event_id"), "src_ip", "dst_ip", "src_port", "dst_port", "transport_protocol", "query_name", "server_name",
        of("dns_query", F.col("query_type")).alias("query_type"), of("dns_query", F.col("answers")).alias("answers"), of("tls_hello", F.col("alpn_protocols")).alias("alpn_protocols"),
        of("dns_query", names_of(DNS_STATUS, F.col("_rcode"))).alias("response_code"), of("tls_hello", names_of(TLS_VERSION, F.col("_tls"))).alias("tls_version"), "host", "method", "target", "status_code",
    )


def network_events(packets: DataFrame, both: bool = True) -> DataFrame:
    """Packet and application events; with both=False a packet gives its application event, else its packet event."""
    every = application_events(packets)
    if both:
        return packet_events(packets).unionByName(every, allowMissingColumns=True)
    test = [F.col(c).isNull() for c in ("server_name", "query_name") if c in packets.columns]
    test += [~F.coalesce(is_http_head(F.col("payload")), F.lit(False))] if "payload" in packets.columns else []
    plain = packets.filter(reduce(lambda a, b: a & b, test)) if test else packets
    return packet_events(plain).unionByName(every, allowMissingColumns=True)


# first lines of an HTTP message
REQUEST, RESPONSE = r"^([A-Z]+) (\S+) (HTTP/\d\.\d)$", r"^(HTTP/\d\.\d) (\d{3})(?: .*)?$"


def is_http_head(payload: Column) -> Column:
    """Whether a payload begins like an HTTP request of a known method, or like a response."""
    first = F.substring_index(F.substring(payload, 1, HEAD_CHARS), "\r\n", 1)
    return (first.rlike(REQUEST) & F.regexp_extract(first, REQUEST, 1).isin(HTTP_METHODS)) | first.rlike(RESPONSE)


def http_heads(payloads: DataFrame) -> DataFrame:
    """payloads with method, target, version, status_code, host, user_agent, content_type, content_length, server, headers; rows that are no HTTP head are left out.

    At most 64 lines and 8192 characters are read; the first of repeated headers counts; six secret
    headers are redacted.
    """
    head = F.split(F.substring_index(F.substring("payload", 1, HEAD_CHARS), "\r\n\r\n", 1), "\r\n")
    rows = once(payloads, "_lines", F.slice(head, 1, HEAD_LINES))
    first = F.col("_lines")[0]
    request, response = REQUEST, RESPONSE
    is_request = first.rlike(request) & F.regexp_extract(first, request, 1).isin(HTTP_METHODS)
    rows = rows.filter(is_request | first.rlike(response))
    pairs = F.transform(F.filter(F.slice("_lines", 2, HEAD_LINES), lambda x: x.contains(":")), lambda x: F.struct(F.lower(strip(F.substring_index(x, ":", 1))).alias("k"), strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    rows = once(rows, "_h", F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.when(p["k"].isin(SECRET_HEADERS), "[REDACTED]").otherwise(p["v"]).alias("v"))))
    header = lambda name: F.get(F.filter("_h", lambda p: p["k"] == name), F.lit(0))["v"]
    return rows.select(
        *payloads.columns, F.when(is_request, F.regexp_extract(first, request, 1)).alias("method"), F.when(is_request, F.regexp_extract(first, request, 2)).alias("target"),
        F.when(is_request, F.regexp_extract(first, request, 3)).otherwise(F.regexp_extract(first, response, 1)).alias("version"), F.when(~is_request, F.regexp_extract(first, response, 2).try_cast("int")).alias("status_code"),
        header("host").alias("host"), header("user-agent").alias("user_agent"), header("content-type").alias("content_type"), header("content-length").try_cast("long").alias("content_length"), header("server").alias("server"),
        F.array_join(F.transform("_h", lambda p: F.concat(p["k"], F.lit("="), p["v"])), ";").alias("headers"),
    )
