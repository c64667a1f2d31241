"""The same results as plain SQL for a second engine, assembled from shared table expressions."""

from __future__ import annotations

import math

import numpy as np

from .catalog import GIVEN_FOREST, GIVEN_NETWORK, GIVEN_OFFSET, GIVEN_SVM

PACKETS = """
packets as (
  select 'h' || cast(user_id % 8 as varchar) as host_id, event_id, epoch_us(ts) as us,
         cast((user_id * 2654435761) % 4294967296 as bigint) as dst_ip,
         cast(json_extract_string(props, '$.k') as integer) as dst_port,
         cast(40 + cast(floor(value) as integer) as integer) as pkt_len,
         case when event_type in ('click','view') then 6
              when event_type in ('purchase','signup') then 17 else 1 end as protocol
  from events)"""

# every packet once for each window it is in
MEMBERS = """
ordered as (
  select *, lag(us) over (partition by host_id order by us, event_id) as prev from packets),
sessioned as (
  select *, max(case when prev is null or us - prev > 1800000000 then us end)
              over (partition by host_id order by us, event_id rows unbounded preceding) as session_us
  from ordered),
members as (
  select 'tumbling' as window_type, us - us % 21600000000 as start_us,
         us - us % 21600000000 + 21600000000 as end_us, * from packets
  union all
  select 'sliding', s.start_us, s.start_us + 86400000000, p.*
  from packets p, unnest(generate_series(
    greatest(us - us % 21600000000 - 64800000000, 0), us - us % 21600000000, 21600000000)) as s(start_us)
  union all
  select 'session', session_us, null, host_id, event_id, us, dst_ip, dst_port, pkt_len, protocol from sessioned)"""

PROFILES = """
gaps as (
  select *, (us - lag(us) over (partition by host_id, window_type, start_us order by us, event_id)) / 1e6 as gap
  from members),
grouped as (
  select host_id, window_type, start_us, coalesce(max(end_us), max(us)) as end_us,
         count(*) as packets, cast(sum(pkt_len) as bigint) as bytes,
         count(distinct dst_ip) as uniq_dst_ip, count(distinct dst_port) as uniq_dst_port,
         count(*) filter (where protocol = 6) as proto_tcp,
         count(*) filter (where protocol = 17) as proto_udp,
         count(*) filter (where protocol not in (6, 17)) as proto_other,
         coalesce(avg(gap), 0) as conn_interval_avg, coalesce(stddev_pop(gap), 0) as conn_interval_std
  from gaps group by host_id, window_type, start_us),
profiles as (
  select host_id, window_type, start_us as window_start_us, end_us as window_end_us, packets, bytes,
         packets / greatest((end_us - start_us) / 1e6, 1e-6) as pps,
         bytes * 8 / greatest((end_us - start_us) / 1e6, 1e-6) as bps,
         uniq_dst_ip, uniq_dst_port, proto_tcp, proto_udp, proto_other, conn_interval_avg, conn_interval_std
  from grouped)"""

_PROFILE_OUT = """
select host_id, window_type, window_start_us, window_end_us, packets, bytes, round(pps, 6) as pps,
       round(bps, 6) as bps, uniq_dst_ip, uniq_dst_port, proto_tcp, proto_udp, proto_other,
       round(conn_interval_avg + 1.23e-7, 6) as conn_interval_avg,
       round(conn_interval_std + 1.23e-7, 6) as conn_interval_std
from profiles"""

RULES = """
rule_hits as (
  select host_id, window_type, window_start_us, window_end_us, 'rule:volume' as detector, 'dos' as category,
         case when score > 0.5 then 3 else 2 end as severity, round(score, 4) as risk_score
  from (select *, least(1.0, greatest(pps / 0.0007, bps / 100000000.0) / 3.0) as score from profiles
        where pps > 0.0007 or bps > 100000000.0)
  union all
  select host_id, window_type, window_start_us, window_end_us, 'rule:port_scan', 'scan',
         case when score > 0.6 then 3 else 2 end, round(score, 4)
  from (select *, least(1.0, uniq_dst_port / 45.0) as score from profiles where uniq_dst_port >= 15)
  union all
  select host_id, window_type, window_start_us, window_end_us, 'rule:host_scan', 'scan',
         case when score > 0.6 then 3 else 2 end, round(score, 4)
  from (select *, least(1.0, uniq_dst_ip / 33.0) as score from profiles where uniq_dst_ip >= 11)
  union all
  select host_id, window_type, window_start_us, window_end_us, 'rule:beaconing', 'c2',
         case when score > 0.8 then 4 else 3 end, score
  from (select *, round(0.5 + 0.5 * (1.0 - least(1.0, conn_interval_std / 320.0)), 4) as score from profiles
        where window_type = 'session' and packets >= 5 and conn_interval_avg > 0 and conn_interval_std <= 320.0)),
rule_alerts as (select *, '' as model_version from rule_hits)"""


def _ewma(metric: str) -> str:
    """Next mean and variance of one metric, and its z-score against the state before."""
    return f"""
         case when sqrt(f.v_{metric}) > 1e-9 then (n.{metric} - f.m_{metric}) / sqrt(f.v_{metric}) else 0 end,
         f.m_{metric} + 0.2 * (n.{metric} - f.m_{metric}),
         0.8 * (f.v_{metric} + 0.2 * (n.{metric} - f.m_{metric}) * (n.{metric} - f.m_{metric}))"""


_METRICS = ["pps", "bps", "uniq_dst_ip", "uniq_dst_port"]

def zscore(source: str = "profiles") -> str:
    """The per-host fold as a recursive query."""
    return f"""
numbered as (
  select host_id, window_type, window_start_us, window_end_us,
         cast(pps as double) as pps, cast(bps as double) as bps,
         cast(uniq_dst_ip as double) as uniq_dst_ip, cast(uniq_dst_port as double) as uniq_dst_port,
         row_number() over (partition by host_id order by window_end_us,
           case window_type when 'tumbling' then 1 when 'sliding' then 2 else 3 end, window_start_us) as n
  from {source}),
folded as (
  select host_id, n, {", ".join(f"cast(0 as double) as z_{m}, {m} as m_{m}, cast(0 as double) as v_{m}" for m in _METRICS)}
  from numbered where n = 1
  union all
  select n.host_id, n.n, {", ".join(_ewma(m) for m in _METRICS)}
  from folded f join numbered n on n.host_id = f.host_id and n.n = f.n + 1),
flagged as (
  select host_id, n, {", ".join(f"case when abs(z_{m}) >= 4 then abs(round(z_{m}, 2)) end as z_{m}" for m in _METRICS)}
  from folded),
zscore_alerts as (
  select host_id, window_type, window_start_us, window_end_us, 'ml:zscore' as detector, 'anomaly' as category,
         case when risk > 0.6 then 3 else 2 end as severity,
         cast(round(cast(risk as decimal(18, 10)), 4) as double) as risk_score, '' as model_version
  from (select n.*, least(1.0, greatest(z_pps, z_bps, z_uniq_dst_ip, z_uniq_dst_port) / 8.0) as risk
        from flagged join numbered n using (host_id, n)
        where coalesce(z_pps, z_bps, z_uniq_dst_ip, z_uniq_dst_port) is not null))"""


ZSCORE = zscore()

COMBINED = """
found as (select * from rule_alerts union all select * from zscore_alerts),
best as (
  select host_id, window_type, window_start_us, window_end_us,
         max(risk_score) filter (where detector like 'rule%') as rule_risk,
         max(risk_score) filter (where detector like 'ml%' or detector like 'nn%') as model_risk,
         count(*) as alerts
  from found group by all)"""

_COMBINED_OUT = """
select *, round((coalesce(rule_risk, 0) * 0.6 + coalesce(model_risk, 0) * 0.4)
   / (case when rule_risk is null then 0 else 0.6 end + case when model_risk is null then 0 else 0.4 end), 4)
   as combined_risk
from best"""


def alerts_out(table: str) -> str:
    return f"""
select sha1(host_id || '|' || cast(window_start_us // 1000000 as varchar) || '|' || detector) as alert_id, *
from {table}"""


def sql(*parts: str, recursive: bool = False) -> str:
    """Table expressions followed by the final select."""
    return f"with {'recursive ' if recursive else ''}{','.join(parts[:-1])}\n{parts[-1]}"


def _profiles(kind: str | None = None) -> str:
    return sql(PACKETS, MEMBERS, PROFILES, _PROFILE_OUT + (f" where window_type = '{kind}'" if kind else ""))


def _text(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S.%f')"


def _ms(us: str) -> str:
    return f"{us} - {us} % 1000"


_LOADED = """
select host_id, window_type, window_start_us - window_start_us % 1000 as window_start_us,
       window_end_us - window_end_us % 1000 as window_end_us, packets, bytes, round(pps, 6) as pps,
       round(bps, 6) as bps, uniq_dst_ip, uniq_dst_port, proto_tcp, proto_udp, proto_other,
       round(conn_interval_avg + 1.23e-7, 6) as conn_interval_avg,
       round(conn_interval_std + 1.23e-7, 6) as conn_interval_std
from profiles where window_type = 'tumbling'"""

CAPTURE = """
capture as (
  select host_id, event_id, us * 1000 + event_id % 1000 as timestamp_ns,
         (event_id * 40503) % 4294967296 as src_ip, dst_ip,
         cast(1024 + event_id % 50000 as integer) as src_port, dst_port, cast(pkt_len as bigint) as pkt_len, protocol,
         case protocol when 6 then 'HOOK_TC' when 17 then 'HOOK_XDP' else 'HOOK_CGROUP_SKB' end as hook,
         case when dst_port < 50 then 'INGRESS' else 'EGRESS' end as direction,
         cast(1 + dst_port % 3 as bigint) as ifindex
  from packets)"""

_FRAMES = """
select host_id, event_id, src_ip, dst_ip, pkt_len, protocol,
       case when protocol = 6 or (protocol = 17 and dst_port >= 20) then src_port else 0 end as src_port,
       case when protocol = 6 or (protocol = 17 and dst_port >= 20) then dst_port else 0 end as dst_port
from capture"""

_PACKED = """
select host_id, max(timestamp_ns) as batch_ts, count(*) as packets, min(timestamp_ns) as first_ns,
       cast(sum(pkt_len) as bigint) as bytes
from (select *, timestamp_ns // 86400000000000 as tick,
             (row_number() over (partition by host_id, timestamp_ns // 86400000000000 order by timestamp_ns) - 1) // 16 as part
      from capture)
group by host_id, tick, part"""

_HOSTS = """
select 'h' || s_suppkey as host_id, s_name as hostname, 'linux' as os,
       case when s_suppkey % 2 = 0 then 'x86_64' else 'aarch64' end as arch,
       '6.1.' || s_nationkey as kernel_version,
       '1:lo,' || (s_suppkey % 7 + 2) || ':eth0' as interfaces,
       1700000000 + s_suppkey as boot_time_sec, (1700000000 + s_suppkey) * 1000000000 as register_ts
from supplier"""

_SCOPES = """
select scope, host_id, count(*) as packets, cast(sum(pkt_len) as bigint) as bytes
from capture join (values
  ('interface/ingress', 'HOOK_XDP', 'INGRESS', true), ('interface/egress', 'HOOK_TC', 'EGRESS', true),
  ('interface/both', 'HOOK_TC', null, true), ('cgroup/ingress', 'HOOK_CGROUP_SKB', 'INGRESS', false),
  ('cgroup/egress', 'HOOK_CGROUP_SKB', 'EGRESS', false), ('cgroup/both', 'HOOK_CGROUP_SKB', null, false)
  ) s(scope, h, d, one_of) on hook = h and (d is null or direction = d) and (not one_of or ifindex in (1, 2))
group by all"""

_LATE = """
select arrival, event_id, top - 3600000000 as watermark_us, us < top - 3600000000 as is_late
from (select *, greatest(coalesce(max(us) over (order by arrival rows between unbounded preceding and 1 preceding), 0), 0) as top
      from (select *, event_id - event_id % 1000 + (event_id * 37) % 1000 as arrival from packets))"""

_FEATURES = [
    "packets", "bytes", "pps", "bps", "uniq_dst_ip", "uniq_dst_port",
    "proto_tcp", "proto_udp", "proto_other", "conn_interval_avg", "conn_interval_std",
]

KMEANS = f"""
centres as (select window_type, {", ".join(f"avg({f}) as {f}" for f in _FEATURES)} from profiles group by window_type),
distances as (
  select p.host_id, p.window_type, p.window_start_us, p.window_end_us,
         min(sqrt({" + ".join(f"(p.{f} - c.{f}) * (p.{f} - c.{f})" for f in _FEATURES)})) as distance
  from profiles p cross join centres c group by all),
kmeans_alerts as (
  select host_id, window_type, window_start_us, window_end_us, 'ml:kmeans' as detector, 'anomaly' as category,
         case when risk > 0.6 then 3 else 2 end as severity, round(risk, 4) as risk_score, 'v1' as model_version
  from (select *, least(1.0, distance / (2 * limit_)) as risk
        from distances, (select quantile_cont(distance, 0.99) as limit_ from distances) where distance > limit_))"""



def _depth(tree: list[tuple], at: int = 0) -> str:
    feature, threshold, left, right, depth = tree[at]
    if feature < 0:
        return f"{depth}"
    return f"case when {_FEATURES[feature]} <= {threshold} then {_depth(tree, left)} else {_depth(tree, right)} end"


def _forest() -> str:
    scale = 2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256
    mean = " + ".join(f"({_depth(tree)})" for tree in GIVEN_FOREST)
    return f"""
forest_scores as (select *, -pow(2.0::double, -(({mean})::double / {len(GIVEN_FOREST)}) / {scale!r}::double) - ({GIVEN_OFFSET}::double) as decision from profiles),
forest_alerts as (
  select host_id, window_type, window_start_us, window_end_us, 'ml:isoforest' as detector, 'anomaly' as category,
         case when risk > 0.8 then 4 when risk > 0.6 then 3 else 2 end as severity, round(risk, 4) as risk_score, 'v1' as model_version
  from (select *, greatest(0.0, least(1.0, 0.5 - decision)) as risk from forest_scores where decision < 0))"""


def _svm() -> str:
    n, gamma = GIVEN_SVM["n_features"], GIVEN_SVM["gamma"]
    rng = np.random.default_rng(42)
    directions = rng.normal(0.0, 1.0, (len(_FEATURES), n)) * np.sqrt(2.0 * gamma)
    phases = rng.uniform(0.0, 2.0 * np.pi, n)
    terms = []
    for j, w in enumerate(GIVEN_SVM["w"]):
        inner = " + ".join(f"{f} * ({directions[i][j].item()!r}::double)" for i, f in enumerate(_FEATURES))
        terms.append(f"({w}::double) * sqrt(2.0 / {n}) * cos({inner} + {phases[j].item()!r}::double)")
    return f"""
svm_alerts as (
  select host_id, window_type, window_start_us, window_end_us, 'ml:ocsvm' as detector, 'anomaly' as category,
         2 as severity, 0.7::double as risk_score, 'v1' as model_version
  from profiles where {" + ".join(terms)} - ({GIVEN_SVM["offset"]}::double) < 0)"""


def _network() -> str:
    m, size = GIVEN_NETWORK, GIVEN_NETWORK["sizes"]
    w, inner, d = m["weights"], size[1], size[0]
    scaled = [f"(({f} - {m['mean'][i]}::double) / {m['scale'][i]}::double)" for i, f in enumerate(_FEATURES)]
    hidden = ", ".join(
        "greatest(0.0, " + " + ".join(f"{x} * ({w[i * inner + j]}::double)" for i, x in enumerate(scaled)) + f" + ({w[d * inner + j]}::double)) as h{j}"
        for j in range(inner))
    base = d * inner + inner
    back = [
        "pow(" + " + ".join(f"h{j} * ({w[base + j * d + i]}::double)" for j in range(inner)) + f" + ({w[base + inner * d + i]}::double) - {scaled[i]}, 2)"
        for i in range(d)]
    return f"""
hidden as (select *, {hidden} from profiles),
errors as (select *, ({" + ".join(back)}) / {d} as error from hidden),
network_alerts as (
  select host_id, window_type, window_start_us, window_end_us, 'nn:mlp' as detector, 'anomaly' as category,
         case when risk > 0.6 then 3 else 2 end as severity, round(risk, 4) as risk_score, 'v1' as model_version
  from (select *, least(1.0, error / (2 * {m["threshold"]})) as risk from errors where error > {m["threshold"]}))"""


_ALL = (PACKETS, MEMBERS, PROFILES)

# windows that a stream over all packets has closed; its watermark has milliseconds
CLOSED = """
mark as (select max(us) // 1000 * 1000 - 3600000000 as wm from packets),
closed as (
  select profiles.* from profiles, mark
  where case when window_type = 'session' then wm - window_end_us > 1800000000 else window_end_us <= wm end)"""

# micro-batches of the files by arrival, with the one without data before the restart and at the end: file and watermark
_REPORTS = """
arrived as (select *, event_id - event_id % 1000 + (event_id * 37) % 1000 as arrival from packets),
filed as (select *, floor(arrival * 8 / (max(arrival) over () + 1))::int as file from arrived),
tops as (
  select f.file, coalesce((select max(us) // 1000 * 1000 - 3600000000 from filed where file < f.file), 0) as wm from range(9) f(file)),
steps as (
  select case when file >= 4 then file + 1 else file end as step, case when file < 8 then file end as file, wm from tops
  union all select 4, null, wm from tops where file = 4),
fixed as (
  select members.* exclude (host_id), members.host_id, s.step from members join filed using (event_id) join steps s on s.file = filed.file
  where window_type <> 'session'),
told as (
  select fixed.*, (select min(step) from steps where steps.step >= fixed.step and wm >= end_us) as batch from fixed)"""

_REPORTED = """
select host_id, window_type, start_us, count(*) as packets, cast(sum(pkt_len) as bigint) as bytes, count(distinct dst_ip) as uniq_dst_ip,
       count(distinct dst_port) as uniq_dst_port, min(us) as first_us, max(us) as last_us
from told where batch is not null group by host_id, window_type, start_us, batch
union all
select host_id, 'late', null, count(*), null, null, null, null, null
from filed join steps using (file) where us < wm group by host_id"""


def _closed(kind: str | None = None) -> str:
    out = _PROFILE_OUT.replace("from profiles", "from closed")
    return sql(*_ALL, CLOSED, out + (f" where window_type = '{kind}'" if kind else ""))


ORACLES: dict[str, str] = {
    "packets_view": sql(PACKETS, "select * rename (us as ts_us) from packets"),
    "tumbling_profiles": _profiles("tumbling"),
    "sliding_profiles": _profiles("sliding"),
    "session_profiles": _profiles("session"),
    "all_profiles": _profiles(),
    "rule_alerts_tumbling": sql(*_ALL, RULES, alerts_out("rule_alerts") + " where window_type = 'tumbling'"),
    "rule_alerts_all": sql(*_ALL, RULES, alerts_out("rule_alerts")),
    "zscore_alerts": sql(*_ALL, ZSCORE, alerts_out("zscore_alerts"), recursive=True),
    "combined_risk": sql(*_ALL, RULES, ZSCORE, COMBINED, _COMBINED_OUT, recursive=True),
    "profiles_json": sql(*_ALL, f"""
select host_id as key, host_id, {_text("window_start_us")} as window_start, {_text("window_end_us")} as window_end,
       * exclude (host_id, window_start_us, window_end_us)
from ({_PROFILE_OUT})"""),
    "alerts_json": sql(*_ALL, RULES, f"""
select host_id as key, alert_id, host_id, {_text("window_start_us")} as detected_at, {_text("window_start_us")} as window_start,
       detector, category, severity, risk_score, model_version,
       case detector when 'rule:volume' then 'bps,bps_thr,pps,pps_thr' when 'rule:port_scan' then 'threshold,uniq_dst_port'
         when 'rule:host_scan' then 'threshold,uniq_dst_ip' else 'conn_interval_avg,conn_interval_std,connections' end as details
from ({alerts_out("rule_alerts")})"""),
    "profiles_loaded": sql(*_ALL, _LOADED),
    "profiles_quarantined": sql(*_ALL, """
select 'not a message of this schema' as error, count(*) as messages from events
union all select 'unknown window type', count(*) from profiles where window_type = 'tumbling'"""),
    "alerts_loaded": sql(*_ALL, RULES, f"""
select alert_id, host_id, detector, category, severity, risk_score, model_version,
       {_ms("window_start_us")} as detected_at_us, {_ms("window_start_us")} as window_start_us
from ({alerts_out("rule_alerts")})"""),
    "alert_tables_loaded": sql(*_ALL, RULES, f"""
select alert_id, host_id, detector, category, severity, risk_score, model_version,
       {_ms("window_start_us")} as detected_at_us, {_ms("window_start_us")} as window_start_us
from ({alerts_out("rule_alerts")})"""),
    "feature_columns": sql(*_ALL, f"""
select host_id, window_type, window_start_us, window_type as named, 'tumbling' as unnamed, feature, number, number as at_place
from (select host_id, window_type, window_start_us, {", ".join(f"{f}::double as {f}" for f in _FEATURES)} from ({_PROFILE_OUT}))
unpivot (number for feature in ({", ".join(_FEATURES)}))"""),
    "clustered_layout": sql(*_ALL, """
select strftime(make_timestamp(window_start_us), '%Y-%m-%d') as day, 2 * count(*) as profiles, 0::bigint as out_of_order from profiles group by day"""),
    "latest_profiles": sql(*_ALL, """
select host_id, window_type, window_start_us, packets + 3 as packets, cast(3 as bigint) as version from profiles"""),
    "latest_alerts": sql(*_ALL, RULES, f"""
select host_id, window_start_us as detected_at_us, detector, any_value(alert_id) as alert_id,
       30 + max(length(window_type)) as version
from ({alerts_out("rule_alerts")}) group by all"""),
    "recent_profiles": sql(*_ALL, _PROFILE_OUT + " where window_start_us >= (1705752000 - 72 * 3600)::bigint * 1000000"),
    "retained_profiles": sql(
        *_ALL, _PROFILE_OUT + " where window_start_us // 1000000 > 1707566400 - 30 * 86400"),
    "profile_history": sql(*_ALL, f"""
select * replace (packets + 1000 as packets) from ({_PROFILE_OUT})
where window_start_us >= (1705752000 - 72 * 3600)::bigint * 1000000"""),
    "alert_details": sql(*_ALL, """
said as (
  select host_id, 'rule:volume' as detector, window_type, window_start_us, window_end_us,
         unnest([{'metric': 'pps', 'number': pps}, {'metric': 'bps', 'number': bps},
                 {'metric': 'pps_thr', 'number': 0.0007::double}, {'metric': 'bps_thr', 'number': 100000000.0::double}], recursive := true)
  from profiles where pps > 0.0007 or bps > 100000000.0
  union all
  select host_id, 'rule:port_scan', window_type, window_start_us, window_end_us,
         unnest([{'metric': 'uniq_dst_port', 'number': uniq_dst_port::double}, {'metric': 'threshold', 'number': 15.0::double}], recursive := true)
  from profiles where uniq_dst_port >= 15
  union all
  select host_id, 'rule:host_scan', window_type, window_start_us, window_end_us,
         unnest([{'metric': 'uniq_dst_ip', 'number': uniq_dst_ip::double}, {'metric': 'threshold', 'number': 11.0::double}], recursive := true)
  from profiles where uniq_dst_ip >= 11
  union all
  select host_id, 'rule:beaconing', window_type, window_start_us, window_end_us,
         unnest([{'metric': 'conn_interval_avg', 'number': conn_interval_avg + 1.23e-7}, {'metric': 'conn_interval_std', 'number': conn_interval_std + 1.23e-7},
                 {'metric': 'connections', 'number': packets::double}], recursive := true)
  from profiles where window_type = 'session' and packets >= 5 and conn_interval_avg > 0 and conn_interval_std <= 320.0)""", """
select host_id, detector, window_type, window_start_us, window_end_us, metric, round(number, 6) as number from said"""),
    "analyzer_view": sql(PACKETS, "select host_id, us as ts_us, dst_ip, dst_port, pkt_len::bigint as pkt_len, protocol from packets"),
    "nonempty_batches": sql(PACKETS, CAPTURE, f"select host_id, packets as events, batch_ts from ({_PACKED})"),
    "batch_pack": sql(PACKETS, CAPTURE, _PACKED),
    "batch_roundtrip": sql(PACKETS, CAPTURE, "select * exclude (event_id) from capture"),
    "host_registrations": _HOSTS,
    "frame_decode": sql(PACKETS, CAPTURE, _FRAMES),
    "ip_decode": sql(PACKETS, CAPTURE, _FRAMES),
    "record_decode": sql(PACKETS, CAPTURE, "select * rename (timestamp_ns as ktime_ns) from capture"),
    "wallclock": sql(PACKETS, CAPTURE, """
select host_id, event_id, timestamp_ns + cast(host_id[2:] as bigint) * 1000000000 + 17 as timestamp_ns from capture"""),
    "capture_scope": sql(PACKETS, CAPTURE, _SCOPES),
    "late_events": sql(PACKETS, _LATE),
    "stream_tumbling": _closed("tumbling"),
    "stream_sliding": _closed("sliding"),
    "stream_session": _closed("session"),
    "stream_tumbling_batches": _closed("tumbling"),
    "stream_session_batches": _closed("session"),
    "stream_all": _closed(),
    "live_alerts": sql(*_ALL, CLOSED, RULES.replace("from profiles", "from closed"), f"""
select alert_id, host_id, detector, category, severity, risk_score, model_version,
       window_start_us as detected_at_us, window_start_us
from ({alerts_out("rule_alerts")})"""),
    "stream_late": sql(PACKETS, MEMBERS, _REPORTS, _REPORTED),
    "live_all_alerts": sql(
        *_ALL, CLOSED, "turn as (select closed.* from closed, mark where window_end_us < wm - 1800000000)",
        RULES.replace("from profiles", "from closed"), zscore("turn"), _forest().replace("from profiles", "from closed"), f"""
select alert_id, host_id, detector, category, severity, risk_score, model_version,
       window_start_us as detected_at_us, window_start_us
from ({alerts_out("rule_alerts")} union all {alerts_out("zscore_alerts")} union all {alerts_out("forest_alerts")})""", recursive=True),
    "stream_zscore": sql(*_ALL, ZSCORE, alerts_out("zscore_alerts"), recursive=True),
    "tables_loaded": sql(*_ALL, _LOADED),
    "all_alerts": sql(
        *_ALL, RULES, ZSCORE, _forest(),
        " union all ".join(alerts_out(t) for t in ("rule_alerts", "zscore_alerts", "forest_alerts")), recursive=True),
    "second_pass_model": sql(
        *_ALL, "history as (select * replace (packets + 1000 as packets) from profiles where window_start_us >= (1705752000 - 240 * 3600)::bigint * 1000000)",
        _forest().replace("from profiles", "from history"), alerts_out("forest_alerts")),
    "training_invariants": sql(*_ALL, """
select core, count(*) as profiles, true as one_each, true as rare, true as in_range, true as same_again
from profiles, (values ('isoforest'), ('kmeans')) c(core) group by core"""),
    "isoforest_given_forest": sql(*_ALL, _forest(), alerts_out("forest_alerts")),
    "ocsvm_given_weights": sql(*_ALL, _svm(), alerts_out("svm_alerts")),
    "mlp_given_weights": sql(*_ALL, _network(), alerts_out("network_alerts")),
    "kmeans_given_centres": sql(*_ALL, KMEANS, alerts_out("kmeans_alerts")),
    "second_pass_zscore": sql(
        *_ALL, "history as (select * from profiles where window_start_us >= (1705752000 - 240 * 3600)::bigint * 1000000)",
        zscore("history"), alerts_out("zscore_alerts"), recursive=True),
}
