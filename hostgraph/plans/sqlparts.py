"""DuckDB SQL fragments that restate the Spark operators for the correctness oracle.

They are plain CTE text over the driver's pre-registered views; nothing here runs on
Spark.  Each fragment mirrors one DataFrame operator so a mismatch points at one place.
"""
from __future__ import annotations

from ..functions.columns import width_seconds


def _host(expr: str) -> str:
    return (f"(CASE WHEN {expr} < 50 THEN '192.168.10.' ELSE '10.0.0.' END "
            f"|| CAST({expr} AS VARCHAR))")


FLOWS = f"""flows AS (
  SELECT event_id AS row_id,
         {_host('user_id')} AS src,
         {_host("CAST(json_extract_string(props, '$.k') AS BIGINT)")} AS dst,
         ts,
         value AS bytes,
         CASE WHEN event_type = 'view' THEN 'BENIGN'
              WHEN event_type = 'error' AND user_id = 8 THEN 'Infiltration'
              ELSE event_type END AS label,
         dayname(ts) AS day,
         CAST(((event_id * 7919) % 65536 + 65536) % 65536 AS INTEGER) AS dst_port
  FROM events)"""

RAW_FLOWS = """raw AS (
  SELECT CASE WHEN row_id % 97 = 0 THEN NULL ELSE row_id END AS row_id,
         CASE WHEN row_id % 97 = 0 THEN NULL ELSE src END AS src,
         CASE WHEN row_id % 97 = 0 THEN NULL ELSE dst END AS dst,
         CASE WHEN row_id % 97 = 0 THEN NULL ELSE ts END AS ts,
         CASE WHEN row_id % 97 = 0 THEN NULL
              WHEN row_id % 7 = 0 THEN NULL
              WHEN row_id % 11 = 0 THEN 'Infinity'::DOUBLE
              WHEN row_id % 13 = 0 THEN '-Infinity'::DOUBLE
              WHEN row_id % 17 = 0 THEN 'NaN'::DOUBLE
              ELSE bytes END AS bytes,
         CASE WHEN row_id % 5 = 0 AND label <> 'BENIGN'
              THEN '  Web Attack ' || chr(150) || ' ' || label || ' ' ELSE label END AS label,
         CASE WHEN row_id % 97 = 0 THEN NULL ELSE dst_port END AS dst_port,
         day || CASE WHEN day = 'Thursday' AND hour(ts) < 12 THEN '-WorkingHours-Morning-WebAttacks'
                     WHEN day = 'Thursday' THEN '-WorkingHours-Afternoon-Infilteration'
                     WHEN day = 'Friday' AND hour(ts) < 12 THEN '-WorkingHours-Morning'
                     WHEN day = 'Friday' AND row_id % 2 = 0 THEN '-WorkingHours-Afternoon-DDos'
                     WHEN day = 'Friday' THEN '-WorkingHours-Afternoon-PortScan'
                     WHEN day = 'Wednesday' THEN '-workingHours'
                     ELSE '-WorkingHours' END || '.pcap_ISCX.csv' AS source_file,
         row_id + copy * 1000000000000 AS capture_pos
  FROM (SELECT *, unnest(CASE WHEN row_id % 89 = 5 THEN [0, 1] ELSE [0] END) AS copy FROM flows) f)"""


def bucket(width: str, ts: str = "ts") -> str:
    secs = width_seconds(width)
    if secs is None:
        return f"date_trunc('{width.split()[-1]}', {ts})"
    us = secs * 1_000_000
    return f"make_timestamp(epoch_us({ts}) - ((epoch_us({ts}) % {us}) + {us}) % {us})"


def edges(width: str, source: str = "flows") -> str:
    return f"""edges AS (
  SELECT {bucket(width)} AS bucket, src, dst, count(*) AS flow_count,
         coalesce(sum(bytes), 0.0) AS total_bytes
  FROM {source}
  WHERE src IS NOT NULL AND dst IS NOT NULL AND ts IS NOT NULL
  GROUP BY 1, 2, 3)"""


HOST_BUCKET = """ed AS (
  SELECT *, CAST(bucket = min(bucket) OVER (PARTITION BY src, dst) AS INTEGER) AS is_new FROM edges),
ends AS (
  SELECT bucket, src AS host, 1 AS o, 0 AS i, flow_count AS fv, total_bytes AS bv, is_new AS nw FROM ed
  UNION ALL
  SELECT bucket, dst AS host, 0, 1, 0, 0.0, 0 FROM ed),
hb AS (
  SELECT bucket, host,
         CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in,
         CAST(sum(fv) AS BIGINT) AS flow_volume, sum(bv) AS byte_volume,
         CASE WHEN sum(o) > 0 THEN sum(nw) / sum(o) END AS novelty_score
  FROM ends GROUP BY 1, 2)"""


def _z(feat: str, eps: float, name: str) -> str:
    return (f"CASE WHEN {feat} IS NOT NULL AND count({feat}) OVER p >= 2 THEN "
            f"({feat} - avg({feat}) OVER p) / (stddev_samp({feat}) OVER p + {eps}) END AS {name}")


BASELINES = f"""bidx AS (
  SELECT bucket, row_number() OVER (ORDER BY bucket) AS bucket_idx FROM (SELECT DISTINCT bucket FROM hb) b),
hf AS (
  SELECT hb.*,
         CASE WHEN lag(bucket_idx) OVER w = bucket_idx - 1
              THEN (fan_in + fan_out) / lag(fan_in + fan_out) OVER w END AS degree_ratio_change,
         {_z('fan_out', 1.0, 'fan_out_zscore')},
         {_z('fan_in', 1.0, 'fan_in_zscore')},
         {_z('novelty_score', 0.05, 'novelty_zscore')},
         {_z('flow_volume', 1.0, 'flow_volume_zscore')},
         {_z('byte_volume', 1.0, 'byte_volume_zscore')}
  FROM hb JOIN bidx USING (bucket)
  WINDOW w AS (PARTITION BY host ORDER BY bucket),
         p AS (PARTITION BY host ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r6(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) AS {alias or expr}"


def pagerank_ctes(steps: int = 100, alpha: float = 0.85, tol: float = 1e-6) -> str:
    """PageRank with per-bucket convergence, unrolled to ``steps`` iterations (a frozen
    bucket keeps its vector), over the ``edges`` CTE.  Ends with CTE ``pr``."""
    parts = ["""outw AS MATERIALIZED (SELECT bucket, src, sum(flow_count) AS w FROM edges GROUP BY 1, 2)""",
             """en AS MATERIALIZED (SELECT e.bucket, e.src, e.dst, e.flow_count / o.w AS p
  FROM edges e JOIN outw o USING (bucket, src))""",
             """nd AS MATERIALIZED (
  SELECT x.bucket, x.host, o.src IS NULL AS dangling, count(*) OVER (PARTITION BY x.bucket) AS n
  FROM (SELECT DISTINCT bucket, host FROM (SELECT bucket, src AS host FROM edges
                                           UNION ALL SELECT bucket, dst FROM edges) a) x
  LEFT JOIN outw o ON o.bucket = x.bucket AND o.src = x.host)""",
             """s0 AS MATERIALIZED (SELECT bucket, host, dangling, n, 1.0 / n AS rank, FALSE AS done FROM nd)"""]
    for i in range(steps):
        parts.append(f"""c{i} AS MATERIALIZED (SELECT en.bucket, en.dst AS host, sum(s.rank * en.p) AS s
  FROM s{i} s JOIN en ON en.bucket = s.bucket AND en.src = s.host WHERE NOT s.done GROUP BY 1, 2)""")
        parts.append(f"""b{i} AS MATERIALIZED (SELECT bucket,
  coalesce(sum(CASE WHEN dangling THEN rank END), 0.0) AS dm FROM s{i} GROUP BY 1)""")
        parts.append(f"""x{i} AS MATERIALIZED (SELECT s.bucket, s.host, s.dangling, s.n, s.done, s.rank AS prev,
  CASE WHEN s.done THEN s.rank ELSE {alpha} * (coalesce(c.s, 0.0) + b.dm / s.n) + {1 - alpha} / s.n END AS rank
  FROM s{i} s JOIN b{i} b USING (bucket) LEFT JOIN c{i} c USING (bucket, host))""")
        parts.append(f"""s{i + 1} AS MATERIALIZED (SELECT bucket, host, dangling, n, rank,
  done OR sum(abs(rank - prev)) OVER (PARTITION BY bucket) < n * {tol} AS done FROM x{i})""")
    parts.append(f"pr AS (SELECT bucket, host, rank AS pagerank FROM s{steps})")
    return ",\n".join(parts)


CLUSTERING = """und AS (SELECT bucket, least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS m
  FROM edges WHERE src <> dst GROUP BY 1, 2, 3),
udeg AS (SELECT bucket, x AS host, sum(m) AS d, count_if(m = 2) AS b FROM
  (SELECT bucket, u AS x, m FROM und UNION ALL SELECT bucket, v, m FROM und) e GROUP BY 1, 2),
tri AS (SELECT a.bucket, a.u AS x, a.v AS y, b.v AS z, a.m * b.m * c.m AS t
  FROM und a JOIN und b ON a.bucket = b.bucket AND a.u = b.u AND a.v < b.v
  JOIN und c ON c.bucket = a.bucket AND c.u = a.v AND c.v = b.v),
tw AS (SELECT bucket, host, sum(t) AS tw FROM
  (SELECT bucket, x AS host, t FROM tri UNION ALL SELECT bucket, y, t FROM tri
   UNION ALL SELECT bucket, z, t FROM tri) q GROUP BY 1, 2),
nodes AS (SELECT DISTINCT bucket, host FROM (SELECT bucket, src AS host FROM edges
                                             UNION ALL SELECT bucket, dst FROM edges) a),
cc AS (SELECT n.bucket, n.host,
  CASE WHEN tw.tw IS NULL OR d * (d - 1) - 2 * b <= 0 THEN 0.0
       ELSE tw.tw / (d * (d - 1) - 2 * b) END AS clustering_coefficient
  FROM nodes n LEFT JOIN udeg USING (bucket, host) LEFT JOIN tw USING (bucket, host))"""
