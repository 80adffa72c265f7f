"""Views over the driver tables, one SQL text for Spark and DuckDB with a few words of dialect.

A view's text names tables and other views in braces; a few functions differ and are named as {iso:x}.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DIALECT = {
    "spark": {
        "iso": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "us": "unix_micros(CAST({0} AS TIMESTAMP))", "sha256": "sha2({0}, 256)", "div": "({0} DIV {1})",
        "hexlow": "lower(hex({0}))", "lines": "split({0}, '\\n')", "concat_agg": "array_join(array_sort(collect_list({0})), ',')", "at": "timestamp_seconds(1704067200 + {0})",
    },
    "duckdb": {
        "iso": "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')", "us": "epoch_us({0})", "sha256": "sha256({0})", "div": "({0} // {1})",
        "hexlow": "lower(to_hex({0}))", "lines": "string_split({0}, chr(10))", "concat_agg": "coalesce(string_agg({0}, ',' ORDER BY {0}), '')", "at": "to_timestamp(1704067200 + {0})",
    },
}

VIEWS = {
    "log_lines": """
SELECT CASE WHEN user_id % 4 = 0 THEN 'var/log/syslog' ELSE 'var/log/auth.log' END AS source_path, event_id + 1 AS line_number,
  CASE WHEN event_id % 97 = 0 THEN 'garbage ' || CAST(event_id AS STRING)
  ELSE [iso:ts] || '+00:00 host' || CAST(user_id % 5 AS STRING) || ' ' || CASE event_type
    WHEN 'error' THEN 'sshd[9]: Failed password for u' || CAST(user_id AS STRING) || ' from 10.0.0.' || CAST(user_id % 250 AS STRING) || ' port ' || CAST(1024 + event_id % 60000 AS STRING) || ' ssh2'
    WHEN 'signup' THEN 'sshd[9]: Accepted publickey for u' || CAST(user_id AS STRING) || ' from 10.0.0.' || CAST(user_id % 250 AS STRING) || ' port ' || CAST(1024 + event_id % 60000 AS STRING) || ' ssh2'
    WHEN 'purchase' THEN 'sudo: u' || CAST(user_id AS STRING) || ' : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/c' || CAST(event_id % 7 AS STRING)
    WHEN 'view' THEN 'cron[7]: pam_unix(cron:session): session opened for user u' || CAST(user_id AS STRING)
    ELSE 'kernel: click ' || CAST(event_id AS STRING) END END AS line
FROM {events}""",
    "packets": """
SELECT capture, row_number() OVER (PARTITION BY capture ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS frame_number, sec, src_ip, dst_ip, src_port, dst_port, network_protocol, transport_protocol, fragment_offset, query_name, server_name
FROM (SELECT *, 'cap' || CAST(l_suppkey % 8 AS STRING) AS capture, 1704067200 + (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 2592000 AS sec,
  '10.0.' || CAST(l_suppkey % 250 AS STRING) || '.' || CAST(l_linenumber AS STRING) AS src_ip, '10.0.0.' || CAST(l_partkey % 250 AS STRING) AS dst_ip,
  CAST(1024 + l_orderkey % 60000 AS INT) AS src_port, CASE l_returnflag WHEN 'A' THEN 22 WHEN 'N' THEN 443 ELSE 53 END AS dst_port,
  'IPV4' AS network_protocol, CASE WHEN l_returnflag IN ('A', 'N') THEN 'TCP' ELSE 'UDP' END AS transport_protocol,
  CAST(CASE WHEN l_linenumber = 7 THEN l_orderkey % 3 ELSE 0 END AS INT) AS fragment_offset,
  CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'h' || CAST(l_partkey % 50 AS STRING) || '.example.org' END AS query_name,
  CASE WHEN l_returnflag = 'N' THEN 's' || CAST(l_partkey % 50 AS STRING) || '.portal.org' END AS server_name FROM {lineitem}) AS p""",
    "packets_app": """
SELECT *, CAST(CASE WHEN server_name IS NOT NULL THEN 769 + frame_number % 5 END AS INT) AS tls_version, CAST(CASE WHEN query_name IS NOT NULL THEN frame_number % 7 END AS INT) AS response_code,
  CASE WHEN frame_number % 4 = 0 THEN 'GET /p' || CAST(frame_number % 50 AS STRING) || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || CAST(frame_number % 20 AS STRING) || chr(13) || chr(10) || chr(13) || chr(10)
    WHEN frame_number % 4 = 1 THEN 'HTTP/1.1 ' || CAST(200 + frame_number % 3 AS STRING) || ' x' || chr(13) || chr(10) WHEN frame_number % 4 = 2 THEN 'no head' END AS payload FROM {packets}""",
    "account_lines": """
SELECT 'etc/passwd' AS source_path, c_custkey AS line_number, CASE WHEN c_custkey % 40 = 0 THEN 'broken' ELSE 'u' || CAST(c_custkey AS STRING) || ':x:' || CAST(c_custkey AS STRING) || ':' || CAST(c_nationkey AS STRING) || ':' || c_name || ':/home/u' || CAST(c_custkey AS STRING) || ':/bin/sh' END AS line FROM {customer}
UNION ALL
SELECT 'etc/group', CAST(n_nationkey + 1 AS BIGINT), 'g' || lower(n_name) || ':x:' || CAST(n_nationkey AS STRING) || ':' || coalesce(m, '') FROM {nation}
LEFT JOIN (SELECT c_nationkey, [concat_agg:'u' || CAST(c_custkey AS STRING)] AS m FROM {customer} WHERE c_custkey % 10 = 0 GROUP BY c_nationkey) AS g ON c_nationkey = n_nationkey""",
    "mem_processes": """
SELECT 'MEM-' || CAST(c_custkey % 5 AS STRING) AS evidence_id, plugin, 'X' || CAST([div:c_custkey,10] AS STRING) AS execution_id, row_index, CAST(c_custkey AS STRING) AS pid_upper,
  CASE WHEN c_custkey % 60 = 0 THEN CAST(c_custkey + 1 AS STRING) END AS pid_mixed, CAST([div:c_custkey,25] * 5 + c_custkey % 5 AS STRING) AS ppid_text,
  CASE WHEN plugin = 'psscan' AND c_custkey % 45 = 0 THEN 'q' ELSE 'p' END || CAST(c_nationkey AS STRING) AS image_name, 1704067200 + c_custkey * 7919 % 86400 AS created_sec,
  '/opt/' || CAST(c_nationkey AS STRING) || '/bin' || CAST(c_custkey % 50 AS STRING) AS image_path
FROM (SELECT c_custkey, c_nationkey, 'pslist' AS plugin, c_custkey * 4 AS row_index FROM {customer}
  UNION ALL SELECT c_custkey, c_nationkey, 'pslist', c_custkey * 4 + 1 FROM {customer} WHERE c_custkey % 25 = 0
  UNION ALL SELECT c_custkey, c_nationkey, 'psscan', c_custkey * 4 + 2 FROM {customer} WHERE c_custkey % 15 = 0) AS c""",
    "mem_sockets": """
SELECT 'MEM-' || CAST(o_custkey % 5 AS STRING) AS evidence_id, o_orderkey AS row_index, 'TCPv4' AS proto, '10.1.' || CAST(o_custkey % 250 AS STRING) || '.2' AS local_addr, CAST(o_orderkey % 70000 AS STRING) AS local_port,
  '10.2.0.' || CAST(o_orderkey % 250 AS STRING) AS foreign_addr, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'established' ELSE 'listening' END AS state, CAST(o_custkey AS STRING) AS pid_text FROM {orders}""",
    "catalogue": """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'var/log/auth.log.' || CAST(doc_id AS STRING) WHEN 1 THEN 'etc/ssh/c' || CAST(doc_id AS STRING) WHEN 2 THEN 'home/u' || CAST(doc_id AS STRING) || '/.ssh/id_' || CAST(doc_id AS STRING)
  WHEN 3 THEN 'home/u' || CAST(doc_id AS STRING) || '/n.txt' WHEN 4 THEN 'etc/passwd' ELSE 'opt/x' || CAST(doc_id AS STRING) END AS relative_path,
  CAST(length(text) AS BIGINT) AS size_chars, md5(text) AS md5, [sha256:text] AS sha256 FROM {documents}""",
    "manifest": """
SELECT CASE WHEN doc_id % 110 = 0 THEN '../d/' ELSE 'd/' END || CAST(doc_id AS STRING) AS relative_path, CASE WHEN doc_id % 90 = 0 THEN 'sha9' ELSE 'sha256' END AS algorithm,
  CASE WHEN doc_id % 50 = 0 THEN [sha256:'wrong'] ELSE [sha256:text] END AS digest FROM {documents}""",
    "files": "SELECT 'd/' || CAST(doc_id AS STRING) AS relative_path, md5(text) AS md5, [sha256:text] AS sha256 FROM {documents} WHERE doc_id % 70 <> 0",
    "custody_actions": """
SELECT 'L' || CAST(o_custkey % 100 AS STRING) AS ledger_id, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS seq, 'E' || CAST(o_orderkey AS STRING) AS event_id, [iso:o_orderdate] AS happened,
  CASE o_orderstatus WHEN 'F' THEN 'RECEIVED' WHEN 'O' THEN 'TRANSFERRED' ELSE 'ANALYZED' END AS action_type, 'I' || CAST(o_custkey % 7 AS STRING) AS item_id, 'a' || CAST(o_orderkey % 4 AS STRING) AS actor,
  'a' || CAST((o_orderkey + o_custkey) % 4 AS STRING) AS recipient, o_orderkey AS okey FROM {orders}""",
    "timeline": """
SELECT CAST(event_id AS STRING) || suffix AS event_id, CAST(CASE WHEN user_id % 13 = 0 THEN 2 WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS ts_class, CASE WHEN user_id % 13 <> 0 THEN [us:ts] END AS ts_us,
  CASE event_type WHEN 'view' THEN 'log' WHEN 'click' THEN 'network' ELSE 'authentication' END AS category,
  CASE event_type WHEN 'error' THEN 'ssh_login_failure' WHEN 'signup' THEN 'ssh_login_success' WHEN 'purchase' THEN 'sudo_command' WHEN 'view' THEN 'session_open' ELSE 'tcp_packet' END AS event_type,
  event_type || ' by u' || CAST(user_id AS STRING) AS description, 'var/log/f' || CAST(user_id % 20 AS STRING) || '.log' AS source_path, event_id AS source_line, 'A' || CAST(user_id % 20 AS STRING) AS source_artifact_id,
  'S' || CAST(event_id AS STRING) AS source_event_id, props AS raw_data, 'u' || CAST(user_id AS STRING) AS username, '10.0.0.' || CAST(user_id % 250 AS STRING) AS source_ip, 's' || CAST([div:event_id,50] AS STRING) AS session_id,
  CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status
FROM (SELECT *, '' AS suffix FROM {events} UNION ALL SELECT *, 'b' AS suffix FROM {events} WHERE event_id % 20 = 0) AS e""",
    "mem_modules": """
SELECT 'MEM-' || CAST(p_partkey % 5 AS STRING) AS evidence_id, p_partkey AS row_index, p_name AS name_text, CASE WHEN p_partkey % 20 = 0 THEN '/tmp' ELSE '' END || '/opt/' || CAST(p_size % 25 AS STRING) || '/bin' || CAST(p_partkey % 50 AS STRING) AS path_text,
  '0x' || [hexlow:p_partkey * 4096] AS base_text, CAST(p_size * 4096 AS STRING) AS size_text FROM {part}""",
    "config_lines": """
SELECT 'etc/shadow' AS source_path, CAST(c_custkey AS BIGINT) AS line_number, 'u' || CAST(c_custkey AS STRING) || ':' || CASE c_custkey % 40 WHEN 0 THEN '!' WHEN 10 THEN '$6$s$abc' WHEN 20 THEN '' ELSE '$y$j9T$x' END || ':19000:0:99999:7:::' AS line FROM {customer} WHERE c_custkey % 10 = 0
UNION ALL SELECT 'etc/sudoers' AS source_path, CAST(c_custkey AS BIGINT) AS line_number, CASE WHEN c_custkey % 20 = 1 THEN 'u' || CAST(c_custkey AS STRING) || ' ALL=(root) NOPASSWD: /bin/a, /bin/b' || CAST(c_custkey AS STRING) ELSE 'User_Alias A' || CAST(c_custkey AS STRING) || ' = x' END AS line FROM {customer} WHERE c_custkey % 10 = 1
UNION ALL SELECT 'home/u' || CAST(c_custkey AS STRING) || '/.ssh/authorized_keys' AS source_path, CAST(1 AS BIGINT) AS line_number, 'ssh-ed25519 AAAA u' || CAST(c_custkey AS STRING) || '@h' AS line FROM {customer} WHERE c_custkey % 10 = 2
UNION ALL SELECT 'etc/systemd/system/s' || CAST(c_custkey AS STRING) || '.service' AS source_path, CAST(1 AS BIGINT) AS line_number, '[Unit]' AS line FROM {customer} WHERE c_custkey % 10 = 3
UNION ALL SELECT 'etc/systemd/system/s' || CAST(c_custkey AS STRING) || '.service' AS source_path, CAST(2 AS BIGINT) AS line_number, 'Description=d' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 3
UNION ALL SELECT 'etc/systemd/system/s' || CAST(c_custkey AS STRING) || '.service' AS source_path, CAST(3 AS BIGINT) AS line_number, '[Service]' AS line FROM {customer} WHERE c_custkey % 10 = 3
UNION ALL SELECT 'etc/systemd/system/s' || CAST(c_custkey AS STRING) || '.service' AS source_path, CAST(4 AS BIGINT) AS line_number, 'ExecStart=/bin/s' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 3
UNION ALL SELECT 'etc/systemd/system/s' || CAST(c_custkey AS STRING) || '.service' AS source_path, CAST(5 AS BIGINT) AS line_number, 'User=u' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 3
UNION ALL SELECT 'etc/cron.d/c' || CAST(c_custkey AS STRING) AS source_path, CAST(1 AS BIGINT) AS line_number, CASE WHEN c_custkey % 20 = 4 THEN '*/5 * * * * root /bin/c' || CAST(c_custkey AS STRING) || ' x' ELSE 'junk' END AS line FROM {customer} WHERE c_custkey % 10 = 4
UNION ALL SELECT 'etc/cron.d/c' || CAST(c_custkey AS STRING) AS source_path, CAST(2 AS BIGINT) AS line_number, '@daily u' || CAST(c_custkey AS STRING) || ' /bin/d' AS line FROM {customer} WHERE c_custkey % 10 = 4
UNION ALL SELECT 'etc/cron.d/c' || CAST(c_custkey AS STRING) AS source_path, CAST(3 AS BIGINT) AS line_number, 'SHELL=/bin/sh' AS line FROM {customer} WHERE c_custkey % 10 = 4
UNION ALL SELECT 'etc/anacrontab' AS source_path, CAST(c_custkey AS BIGINT) AS line_number, '7 ' || CAST(c_custkey % 9 AS STRING) || ' job' || CAST(c_custkey AS STRING) || ' /bin/run ' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 5
UNION ALL SELECT 'home/u' || CAST(c_custkey AS STRING) || '/.bashrc' AS source_path, CAST(1 AS BIGINT) AS line_number, 'export A=' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 6
UNION ALL SELECT 'home/u' || CAST(c_custkey AS STRING) || '/.bashrc' AS source_path, CAST(2 AS BIGINT) AS line_number, 'alias l=ls' AS line FROM {customer} WHERE c_custkey % 10 = 6
UNION ALL SELECT 'home/u' || CAST(c_custkey AS STRING) || '/.bashrc' AS source_path, CAST(3 AS BIGINT) AS line_number, '# note' AS line FROM {customer} WHERE c_custkey % 10 = 6
UNION ALL SELECT 'home/u' || CAST(c_custkey AS STRING) || '/.bashrc' AS source_path, CAST(4 AS BIGINT) AS line_number, '/bin/e' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 6
UNION ALL SELECT 'home/u' || CAST(c_custkey AS STRING) || '/.config/autostart/a.desktop' AS source_path, CAST(1 AS BIGINT) AS line_number, 'Name=n' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 7
UNION ALL SELECT 'home/u' || CAST(c_custkey AS STRING) || '/.config/autostart/a.desktop' AS source_path, CAST(2 AS BIGINT) AS line_number, 'Exec=/bin/x' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 7
UNION ALL SELECT 'home/u' || CAST(c_custkey AS STRING) || '/.config/autostart/a.desktop' AS source_path, CAST(3 AS BIGINT) AS line_number, 'Exec=/bin/y' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 7
UNION ALL SELECT 'etc/ld.so.preload' AS source_path, CAST(c_custkey AS BIGINT) AS line_number, '/lib/a' || CAST(c_custkey AS STRING) || '.so /lib/b.so' AS line FROM {customer} WHERE c_custkey % 10 = 8
UNION ALL SELECT 'etc/modules' AS source_path, CAST(c_custkey AS BIGINT) AS line_number, 'mod' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 9
UNION ALL SELECT 'etc/modprobe.d/m' || CAST(c_custkey AS STRING) || '.conf' AS source_path, CAST(1 AS BIGINT) AS line_number, 'blacklist m' || CAST(c_custkey AS STRING) AS line FROM {customer} WHERE c_custkey % 10 = 9""",
    "unit_links": """
SELECT 'etc/systemd/system/t' || CAST(c_custkey % 3 AS STRING) || '.target.wants/s' || CAST(c_custkey AS STRING) || '.service' AS relative_path,
  CASE WHEN c_custkey % 2 = 0 THEN '/lib/s' || CAST(c_custkey AS STRING) || '.service' END AS link_target FROM {customer}
UNION ALL SELECT 'etc/x' || CAST(c_custkey AS STRING), '/y' FROM {customer}""",
    "pam_lines": """
SELECT 'var/log/auth.log' AS source_path, event_id + 1 AS line_number, [iso:ts] || '+00:00 host sshd[9]: ' || CASE WHEN event_type = 'error' THEN 'pam_unix(sshd:auth): authentication failure; logname='
  || CASE WHEN event_id % 3 = 0 THEN 'l' || CAST(user_id AS STRING) ELSE '' END || ' uid=0 euid=0 tty=ssh ruser= rhost=10.0.0.' || CAST(user_id % 250 AS STRING)
  || CASE WHEN event_id % 2 = 0 THEN '  user=u' || CAST(user_id AS STRING) ELSE '' END ELSE 'other message' END AS line FROM {events}""",
    "http_heads": """
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN chr(1) || chr(2) || 'binary' WHEN page_id % 7 = 0 THEN 'HTTP/1.1 404 Not Found' || chr(13) || chr(10) || 'Server: s' || CAST(page_id % 3 AS STRING) || chr(13) || chr(10) || 'Content-Length: ' || CAST(page_id AS STRING) || chr(13) || chr(10) || chr(13) || chr(10)
  ELSE 'GET /p/' || CAST(page_id AS STRING) || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || CAST(page_id % 10 AS STRING) || '.example.org' || chr(13) || chr(10) || 'Cookie: s=' || CAST(page_id AS STRING) || chr(13) || chr(10) || chr(13) || chr(10) END AS payload FROM {pages}""",
    "hostile_lines": """
SELECT 'var/log/auth.log' AS source_path, event_id + 1 AS line_number, [iso:ts] || 'Z' || gap || 'host' || gap || CASE event_type
    WHEN 'error' THEN 'sshd[9]:' || gap || 'Failed' || gap || 'password' || gap || 'for' || gap || CASE WHEN event_id % 4 = 0 THEN 'invalid' || gap || 'user' || gap ELSE '' END || who || gap || 'from' || gap || '10.0.0.1' || gap || 'port' || gap || '22'
    WHEN 'signup' THEN 'sshd[9]:' || gap || 'Accepted' || gap || 'publickey' || gap || 'for' || gap || who || gap || 'from' || gap || '10.0.0.1' || gap || 'port' || gap || '22' || gap || 'ssh2'
    WHEN 'purchase' THEN 'sudo:' || gap || who || ' :' || gap || 'TTY=pts/0 ;' || gap || 'PWD=/tmp ;' || gap || 'USER=root ;' || gap || 'COMMAND=/bin/c ' || who || chr(1) || ' -- ' || who
    WHEN 'view' THEN 'cron[7]: pam_unix(cron:session): session opened for user' || gap || who
    ELSE 'kernel: ' || who || chr(1) || 'click' || chr(1) || chr(1) || CAST(event_id AS STRING) END AS line
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN chr(9) ELSE ' ' || chr(9) END AS gap,
  CASE event_id % 5 WHEN 0 THEN 'u' WHEN 1 THEN 'u' || chr(1) WHEN 2 THEN chr(1) || 'u' || chr(1) || '10.9.9.9' WHEN 3 THEN 'ü日' ELSE 'ü' || chr(1) || 'x' END || CAST(user_id AS STRING) AS who FROM {events}) AS e""",
    "mem_documents": """
SELECT 'doc' || CAST(k AS STRING) AS source, CASE k % 9
    WHEN 0 THEN '[' || proc || ',' || net || ']' WHEN 1 THEN o || '"artifacts":[' || proc || ',' || module || ',5]' || c WHEN 2 THEN proc WHEN 3 THEN '[' || module || ',' || o || '"foo":1' || c || ']'
    WHEN 4 THEN '[' || o || '"pid":' || CAST(k AS STRING) WHEN 5 THEN '[' || proc || ', ' || proc || ']' WHEN 6 THEN o || '"case":"x","artifacts":[' || net || ',' || event || ']' || c WHEN 7 THEN '[]'
    ELSE '[' || replace(proc, '"process_name":"p', '"process_name":"') || ',' || replace(net, '"local_port":"', '"local_port":"9') || ']' END AS value
FROM (
  SELECT k, o, c, o || '"artifact_id":"MEMPROC-' || md5('p' || CAST(k AS STRING)) || '","evidence_id":"MEM-' || CAST(k % 4 AS STRING) || '","pid":' || CASE WHEN k % 11 = 0 THEN '-' ELSE '' END || CAST(k % 97 AS STRING) || ',"ppid":"' || CAST(k % 13 AS STRING)
      || '","process_name":"p' || CASE WHEN k % 18 = 8 THEN '' ELSE CAST(nation AS STRING) END || '","execution_id":"VOLEXEC-' || CAST(k % 31 AS STRING) || '","source_row_indices":[' || CAST(k AS STRING) || ',1],"created_at":' || CASE WHEN k % 3 = 0 THEN '"2024-01-0' || CAST(1 + k % 9 AS STRING) || 'T10:00:00Z"' WHEN k % 3 = 1 THEN 'null' ELSE '"2024-01-01 1' || CAST(k % 10 AS STRING) || ':00:00"' END
      || ',"exit_time":' || CASE WHEN k % 5 = 0 THEN '"2024-01-20T00:00:00.5+02:00"' ELSE '"n/a"' END || ',"raw_attributes":' || o || '"ImagePath":"/opt/' || CAST(nation AS STRING) || '","N":' || CAST(k % 2 AS STRING) || c || c AS proc,
    o || '"artifact_id":"MEMNET-' || md5('n' || CAST(k AS STRING)) || '","evidence_id":"MEM-' || CAST(k % 4 AS STRING) || '","protocol":"TCPv4","local_address":"10.0.0.1","local_port":"' || CAST(1000 + k % 9000 AS STRING) || '","pid":' || CAST(k % 97 AS STRING) || ',"state":"LISTENING"' || c AS net,
    o || '"module_name":"m' || CAST(nation AS STRING) || '","evidence_id":"MEM-' || CAST(k % 4 AS STRING) || '","artifact_id":"' || CASE WHEN k % 8 = 1 THEN 'x' ELSE 'MEMMOD-' || md5('m' || CAST(k AS STRING)) END || '","size_bytes":4096,"driver_path":"/lib/m' || CAST(nation AS STRING) || '.ko"' || c AS module,
    o || '"event_id":"MEMEVT-' || md5('e' || CAST(k AS STRING)) || '","evidence_id":"MEM-' || CAST(k % 4 AS STRING) || '","artifact_category":"process","event_type":"kept","description":"d","timestamp":"2024-02-01T00:00:00Z"' || c AS event
  FROM (SELECT c_custkey AS k, c_nationkey AS nation, chr(123) AS o, chr(125) AS c FROM {customer}) AS x
) AS y""",
    "custody_events": """
SELECT 'L' || CAST(o_custkey % 60 AS STRING) AS ledger_id, row_number() OVER (PARTITION BY o_custkey % 60 ORDER BY o_orderkey) - 1 AS sequence_number, o_orderkey AS k,
  'COCEVT-' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-4' || substr(m, 14, 3) || '-a' || substr(m, 18, 3) || '-' || substr(m, 21, 12) AS event_id,
  CASE WHEN o_orderkey % 23 = 0 THEN 'no time' WHEN o_orderkey % 10 = 0 THEN [iso:o_orderdate] WHEN o_orderkey % 2 = 0 THEN [iso:o_orderdate] || '+02:00' ELSE [iso:o_orderdate] || 'Z' END AS timestamp,
  CASE WHEN o_orderkey % 4 = 0 THEN 'MANUAL_ENTRY' ELSE 'HOST_SYSTEM_CLOCK' END AS timestamp_source,
  CASE WHEN o_orderkey % 6 = 0 THEN 'EVIDENCE_RECEIVED' WHEN o_orderkey % 6 IN (1, 2, 4) THEN 'CUSTODY_TRANSFERRED' ELSE 'ANALYSIS_STARTED' END AS action_type, 'I' || CAST(o_custkey % 7 AS STRING) AS evidence_id,
  'a' || CAST(o_orderkey % 3 AS STRING) AS actor_name, CASE WHEN o_orderkey % 7 = 0 THEN 'room ' || CAST(o_orderkey % 5 AS STRING) END AS source_location, CASE WHEN o_orderkey % 5 = 0 THEN 'shelf ü' || CAST(o_orderkey % 11 AS STRING) END AS destination_location,
  CASE WHEN o_orderkey % 3 = 0 THEN [sha256:'I' || CAST(o_custkey % 7 AS STRING) || CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE '' END] END AS digest, 'a' || CAST(o_orderkey % 4 AS STRING) AS releasing, 'a' || CAST(o_orderkey % 3 AS STRING) AS receiving,
  CASE WHEN o_orderkey % 6 IN (1, 2) THEN chr(123) || '"transfer_id":"COCTRAN-' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-4' || substr(m, 14, 3) || '-b' || substr(m, 18, 3) || '-' || substr(m, 21, 12) || '","releasing_actor":' || chr(123) || '"declared_identity":"a' || CAST(o_orderkey % 4 AS STRING) || '"' || chr(125)
    || ',"receiving_actor":' || chr(123) || '"declared_identity":"a' || CAST(o_orderkey % 3 AS STRING) || '","role":"r"' || chr(125) || ',"destination_location":"lab ' || CAST(o_orderkey % 2 AS STRING) || '"' || chr(125) WHEN o_orderkey % 6 = 4 THEN 'by hand' END AS notes
FROM (SELECT *, md5('c' || CAST(o_orderkey AS STRING)) AS m FROM {orders}) AS o""",
}

#: Views that Spark reads by a text of its own, with the same rows. Packets are numbered on the columns of the table, and their texts are made afterwards: fewer bytes go through the shuffle.
OF_SPARK = {
    "packets": """
SELECT 'cap' || CAST(l_suppkey % 8 AS STRING) AS capture, frame_number, 1704067200 + (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 2592000 AS sec,
  '10.0.' || CAST(l_suppkey % 250 AS STRING) || '.' || CAST(l_linenumber AS STRING) AS src_ip, '10.0.0.' || CAST(l_partkey % 250 AS STRING) AS dst_ip,
  CAST(1024 + l_orderkey % 60000 AS INT) AS src_port, CASE l_returnflag WHEN 'A' THEN 22 WHEN 'N' THEN 443 ELSE 53 END AS dst_port,
  'IPV4' AS network_protocol, CASE WHEN l_returnflag IN ('A', 'N') THEN 'TCP' ELSE 'UDP' END AS transport_protocol,
  CAST(CASE WHEN l_linenumber = 7 THEN l_orderkey % 3 ELSE 0 END AS INT) AS fragment_offset,
  CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'h' || CAST(l_partkey % 50 AS STRING) || '.example.org' END AS query_name,
  CASE WHEN l_returnflag = 'N' THEN 's' || CAST(l_partkey % 50 AS STRING) || '.portal.org' END AS server_name
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS frame_number FROM {lineitem}) AS p""",
}


def dialect(text: str, name: str) -> str:
    """The text with its functions in the words of one engine; innermost first."""
    words = DIALECT[name]
    while m := re.search(r"\[(\w+):([^\[\]]*)\]", text):
        if m[1] not in words:
            break
        args = m[2].split(",") if "{1}" in words[m[1]] else [m[2]]
        text = text[: m.start()] + words[m[1]].format(*args) + text[m.end() :]
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view, by name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = dialect(OF_SPARK.get(name, VIEWS[name]), "spark")
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def oracle(query: str, *names: str) -> str:
    """DuckDB SQL of a query over views: the views as common table expressions before it."""
    order: list[str] = []
    for n in names:
        order += [n] if n not in order else []
    ctes = [f"{n} AS ({dialect(VIEWS[n], 'duckdb').replace('{', '').replace('}', '')})" for n in order]
    body = dialect(query, "duckdb").strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[14:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
