"""Network tables derived from the given tables, for the registered queries.

The same text runs on both engines but for the function that gives microseconds
and the table names; ``spark`` reads Parquet, the oracle has views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKETS = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
             CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM events)
SELECT event_id AS packet_id,
  CASE WHEN user_id % 10 = 0 THEN 1704067200.0e0 + user_id*7 + seq*60 + (event_id % 3)*0.5e0
       WHEN user_id % 10 = 1 THEN 1704067200.0e0 + user_id*7 + floor(seq/16.0e0)*600 + (seq % 16)*0.25e0
       ELSE {micros}/1000000.0e0 END AS timestamp,
  concat('10.0.', user_id % 4, '.', user_id % 250 + 1) AS src_ip,
  CASE WHEN event_type='signup' AND user_id % 10 <> 0 THEN '8.8.8.8'
       WHEN user_id % 10 = 2 THEN '86.59.21.38'
       ELSE concat('203.0.', user_id % 7, '.', (user_id*17) % 200 + 1) END AS dst_ip,
  CAST(40000 + user_id AS INT) AS src_port,
  CASE WHEN event_type='signup' AND user_id % 10 <> 0 THEN 53 WHEN user_id % 10 = 2 THEN 9001 ELSE 443 END AS dst_port,
  CASE WHEN user_id % 10 = 0 THEN 'TLS' WHEN event_type='signup' THEN 'DNS' WHEN event_type='error' THEN 'TCP' ELSE 'TLS' END AS protocol,
  CASE WHEN user_id % 10 = 2 THEN 541*(1 + k % 3) + k % 11 ELSE CAST(64 + (k*13) % 1400 AS INT) END AS size,
  CASE WHEN user_id % 15 = 3 THEN 30 + k % 90 WHEN user_id % 2 = 0 THEN 64 ELSE 128 END AS ttl,
  CASE WHEN event_type='signup' AND user_id % 10 <> 0 THEN
     CASE WHEN user_id % 5 = 1 THEN concat(md5(concat('q',event_id)),'.', substr(md5(concat('r',event_id)),1,8), '.tunnel', user_id % 3, '.xyz')
          ELSE concat('www', k % 10, '.example.com') END END AS dns_query,
  CASE WHEN event_type='signup' AND user_id % 10 <> 0 THEN CASE WHEN user_id % 5 = 1 THEN 'TXT' ELSE 'A' END END AS dns_type
FROM e"""

FLOWS = """SELECT substr(md5(concat('f',l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',CAST(floor(l_extendedprice*100) AS BIGINT))),1,16) AS flow_id,
  concat('s', o_custkey % 8) AS session_id, concat('t', o_custkey % 3) AS tenant_id,
  CASE WHEN l_partkey % 40 = 0 THEN concat('198.51.', l_suppkey % 5, '.', l_suppkey % 200 + 1)
       ELSE concat('10.0.', o_custkey % 4, '.', o_custkey % 250 + 1) END AS src_ip,
  CASE WHEN l_partkey % 3 = 0 THEN concat('10.0.', l_suppkey % 4, '.', (l_suppkey*3) % 250 + 1)
       WHEN l_partkey % 50 = 1 THEN '185.220.101.47' WHEN l_partkey % 50 = 2 THEN '86.59.21.38'
       ELSE concat('203.0.', l_suppkey % 7, '.', l_suppkey % 200 + 1) END AS dst_ip,
  CAST(30000 + l_orderkey % 20000 AS INT) AS src_port,
  CASE l_partkey % 12 WHEN 0 THEN 445 WHEN 1 THEN 22 WHEN 2 THEN 3389 WHEN 3 THEN 88 WHEN 4 THEN 53 WHEN 5 THEN 4444 WHEN 6 THEN 389 WHEN 7 THEN 8443 ELSE 443 END AS dst_port,
  CASE l_partkey % 12 WHEN 4 THEN 'DNS' WHEN 0 THEN 'SMB' WHEN 1 THEN 'SSH' WHEN 2 THEN 'RDP' WHEN 3 THEN 'TCP' WHEN 6 THEN 'TCP' ELSE 'TLS' END AS protocol,
  {micros}/1000000.0e0 + l_linenumber*2 + (l_orderkey % 86400) AS start_time,
  CAST(l_quantity*0.5e0 AS DOUBLE) AS session_duration,
  CAST(l_quantity AS INT) AS packet_count,
  CAST(floor(l_extendedprice) AS BIGINT) * CASE WHEN o_custkey % 97 = 0 THEN 1000 ELSE 1 END AS total_bytes,
  CASE WHEN l_partkey % 12 >= 5 AND l_partkey % 12 <> 6 THEN CASE l_suppkey % 4 WHEN 0 THEN 'TLS 1.0' WHEN 1 THEN 'TLS 1.2' ELSE 'TLS 1.3' END END AS tls_version,
  CASE WHEN l_partkey % 12 >= 7 THEN CASE WHEN l_suppkey % 9 = 0 THEN concat(substr(md5(concat('s',l_suppkey)),1,24),'.top') ELSE concat('host', l_suppkey % 30, '.example.net') END END AS sni,
  CASE WHEN l_partkey % 12 >= 5 AND l_partkey % 12 <> 6 THEN CASE WHEN o_custkey % 61 = 0 THEN 'e7d705a3286e19ea42f587b344ee6865' ELSE md5(concat('j', o_custkey % 23)) END END AS ja3
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

ALERTS = """SELECT concat('a', o_orderkey) AS alert_id, concat('t', o_custkey % 3) AS tenant_id, concat('s', o_custkey % 8) AS session_id,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'LOW' ELSE 'INFO' END AS severity,
  CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'resolved' ELSE 'triaged' END AS status,
  CASE o_custkey % 5 WHEN 0 THEN 'beacon' WHEN 1 THEN 'exfiltration' WHEN 2 THEN 'dga' WHEN 3 THEN 'lateral_movement' ELSE 'anomaly' END AS category,
  concat('u', o_custkey % 7) AS assignee,
  concat('10.0.', o_custkey % 4, '.', o_custkey % 250 + 1) AS src_ip, concat('203.0.', o_orderkey % 7, '.', o_orderkey % 200 + 1) AS dst_ip,
  {micros}/1000000.0e0 AS created, {micros}/1000000.0e0 + (o_orderkey % 100)*3600.0e0 AS resolved,
  CAST(o_totalprice AS DOUBLE) AS price
FROM orders"""


def _derive(spark: SparkSession, sf_dir: str, sql: str, column: str, tables) -> DataFrame:
    text = sql.format(micros=f"unix_micros(CAST({column} AS TIMESTAMP))")
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        import re

        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **read)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, PACKETS, "ts", ("events",))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, FLOWS, "o_orderdate", ("lineitem", "orders"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, ALERTS, "o_orderdate", ("orders",))


def duck(*names: str) -> str:
    """``WITH`` clause that defines the derived tables for the oracle."""
    of = {"packets": (PACKETS, "ts"), "flows": (FLOWS, "o_orderdate"), "alerts": (ALERTS, "o_orderdate")}
    return "WITH " + ",\n".join(f"{n} AS ({of[n][0].format(micros=f'epoch_us({of[n][1]})')})" for n in names)
