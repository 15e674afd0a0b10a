"""The registered queries once more, in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from fleetmetrics.functions import checks as C

_METRIC_EVENTS = {
    "gpu_utilization": "click",
    "memory_utilization": "view",
    "memory_used_mb": "error",
    "memory_free_mb": None,
    "temperature": "signup",
    "power_draw": "purchase",
    "sm_clock_mhz": None,
    "memory_clock_mhz": None,
}
METRICS = tuple(_METRIC_EVENTS)
_IDENTITY = "cluster_id, hostname, gpu_id"

_MAPPED = """
    concat('cluster-', (user_id // 8) % 3) as cluster_id,
    concat('gpu-node-', lpad(cast(user_id // 8 as varchar), 5, '0')) as hostname,
    cast(user_id % 8 as varchar) as gpu_id,
    concat('nvidia', user_id % 8) as device,
    concat('GPU-', lpad(cast(user_id as varchar), 8, '0')) as uuid,
    case user_id % 2 when 0 then 'H100' else 'A100' end as model_name"""

_WIDE_METRICS = ", ".join(
    f"cast(case when event_type = '{e}' then value else 0 end as float) as {m}"
    if e else f"cast(0 as float) as {m}"
    for m, e in _METRIC_EVENTS.items()
)


def rnd(col: str, digits: int = 4, name: str | None = None) -> str:
    return f"round(cast({col} as double), {digits}) as {name or col.split('.')[-1]}"


_ROUNDED = ", ".join(rnd(m) for m in METRICS)
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_UNIX = "cast(floor(epoch(date_trunc('second', ts))) as bigint)"
_TELEMETRY_ID = f"concat(hostname, '_', gpu_id, '_', {_UNIX})"
_AS_OF = "timestamp '2024-01-31 00:00:00'"

_CTES = {
    "readings": f"""select event_id as seq, ts, {_MAPPED},
        case event_type when 'click' then 'gpu_utilization' when 'view' then 'memory_utilization'
          when 'signup' then 'temperature' when 'purchase' then 'power_draw'
          else 'memory_used_mb' end as metric_name,
        value, props as labels_raw from events""",
    "wide": f"select event_id as seq, ts, {_MAPPED}, {_WIDE_METRICS} from events",
    "doubled": """select * from wide union all by name
        select * replace (seq + 10000000 as seq, cast(power_draw + 1 as float) as power_draw)
        from wide""",
    "latest": f"""select * from (select *, row_number() over (
        partition by {_IDENTITY} order by ts desc, seq desc) as rn from wide) where rn = 1""",
    "hosts": """select cluster_id, hostname, min(ts) as created_at, max(ts) as last_seen
        from wide group by all""",
    "gpus": f"""select {_IDENTITY}, arg_min(uuid, seq) as uuid, arg_min(device, seq) as device,
        arg_min(model_name, seq) as device_name, min(ts) as created_at, max(ts) as updated_at
        from wide group by {_IDENTITY}""",
    "status": f"""select g.*, l.gpu_utilization as utilization_percent,
        l.memory_utilization as memory_used_percent, l.temperature as temperature_celsius,
        l.power_draw as power_draw_watts,
        l.temperature < 85 and l.gpu_utilization >= 0 as healthy, l.ts as last_updated
        from gpus g left join latest l using ({_IDENTITY})""",
    "host_counts": """select cluster_id, count(distinct hostname) as host_count
        from hosts group by 1""",
    "gpu_counts": """select cluster_id, count(*) as gpu_count, count(*) filter (healthy) as healthy_count
        from status group by 1""",
    "messages": """select event_id as seq, concat('m-', event_id) as message_id,
        event_type as topic,
        concat('/telemetry/queue/', event_type, '/', lpad(cast(event_id as varchar), 12, '0'))
          as stream_key,
        ts as created_at, ts + to_hours(cast(floor(value) as integer)) as expires_at, user_id
        from events""",
    "acks": """select concat(case when value < 20 then 'm-' else 'lost-' end, event_id)
          as message_id,
        event_type as topic, concat('consumer-', user_id) as consumer_id,
        ts + interval 1 day as acked_at
        from events where value < 20 or (value >= 100 and event_type = 'error')""",
    "heartbeats": """select event_id as seq,
        case user_id % 3 when 0 then 'collector' when 1 then 'gateway' else 'streamer' end
          as service_type,
        concat('i-', user_id) as instance_id, ts,
        case event_type when 'error' then 'unhealthy' else 'healthy' end as health
        from events""",
    "divided": """select * replace (case event_type when 'view' then ts - interval 10 days else ts end as ts),
        case event_type when 'click' then 5.0 when 'view' then 50.0
        when 'signup' then 250.0 when 'purchase' then 900.0 else 500.0 end::double as divisor from events""",
    "metrics": """select event_id as seq, ts, concat('svc-', event_type) as service_type,
        concat('i-', user_id) as instance_id,
        least(value / divisor, 1.0::double) as cpu_usage,
        least(value / (divisor * 2), 1.0::double) as memory_usage,
        value * 25 / divisor as queue_depth,
        case when value > 80 then 'unhealthy' else 'healthy' end as health from divided""",
    "newest_metrics": """select * from (select *, row_number() over (
        partition by service_type, instance_id order by ts desc, seq desc) as rn from metrics)
        where rn = 1""",
    "loads": """select service_type, count(*) as n, count(*) filter (health = 'healthy') as healthy,
        avg(cpu_usage * 0.3::double + memory_usage * 0.3::double
          + least(queue_depth / 100, 1.0::double) * 0.4::double) as load
        from newest_metrics where ts >= timestamp '2024-01-29 00:00:00' group by 1""",
    "decisions": """select concat('svc-', event_type) as service_type,
        case when event_type = 'click' then 'no_action' when value > 15 then 'scale_up'
          else 'scale_down' end as action, ts
        from events where event_type in ('purchase', 'click')""",
    "last_decisions": """select service_type, arg_max(action, ts) as action, max(ts) as ts
        from decisions group by 1""",
    "rules": """select concat('svc-', event_type) as service_type,
        count(distinct user_id) + 1 as max_instances from events group by 1""",
    "changelog": """select event_id as seq, concat('gpu-', user_id) as key,
        case event_type when 'error' then 'DELETE' else 'PUT' end as op, props as value, ts
        from events""",
    "known_messages": """select m.*, a.message_id is not null as acked,
        expires_at >= timestamp '2024-01-31 00:00:00' as alive
        from messages m left join (select distinct message_id from acks) a using (message_id)""",
    "fates": """select m.message_id, m.topic, m.expires_at,
        min(a.acked_at) as acked_at from messages m left join acks a using (message_id)
        group by all""",
    "some_hosts": """select * replace (case when seq % 7 = 0 then null else hostname end as hostname)
        from readings""",
    "batched": """select *, hostname as "partition", cast(floor((row_number() over (
        partition by hostname order by seq) - 1) / 100) as bigint) as batch_no from some_hosts""",
    "wide_csv": f"""select seq, date_trunc('second', ts) as ts,
        case when greatest({', '.join(METRICS)}) < 5 then '' else hostname end as hostname,
        gpu_id, uuid, device, model_name, {', '.join(METRICS)} from wide""",
    "requests": """select
        case user_id % 8 when 0 then '' when 1 then concat('gpu@', user_id)
          when 2 then repeat('g', 101) when 3 then concat('gpu-0', chr(10))
          else concat('GPU_', user_id) end as gpu_id,
        case user_id % 8 when 4 then '' when 5 then '-invalid' when 6 then 'x'
          when 7 then repeat('h', 254) else concat('node-', user_id, '.example.com') end
          as hostname,
        case event_type when 'error' then 'cluster@1' when 'view' then ''
          when 'signup' then repeat('c', 51) else 'prod-1' end as cluster_id,
        case event_type when 'error' then null when 'view' then ts - interval 750 days
          else ts end as t0,
        case event_type when 'click' then ts + interval 31 days
          when 'purchase' then ts - interval 1 hour else null end as t1,
        event_type in ('error', 'view') as bad_end, event_type,
        case event_type when 'signup' then cast(floor(value) as bigint)
          when 'view' then 0 when 'purchase' then cast(floor(value * 100) as bigint) end as number
        from events""",
}

_NEEDS = {
    "doubled": ["wide"], "latest": ["wide"], "hosts": ["wide"], "gpus": ["wide"],
    "status": ["gpus", "latest"], "host_counts": ["hosts"], "gpu_counts": ["status"],
    "metrics": ["divided"], "newest_metrics": ["metrics"], "loads": ["newest_metrics"],
    "last_decisions": ["decisions"], "known_messages": ["messages", "acks"],
    "fates": ["messages", "acks"], "some_hosts": ["readings"], "batched": ["some_hosts"], "wide_csv": ["wide"],
}


def _with(body: str, *names: str, recursive: str = "") -> str:
    """The body after the table expressions it names, and those they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({_CTES[n]})" for n in ordered] + ([recursive] if recursive else [])
    if not parts:
        return body
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}"


_MAIN = """(gpu_id like '%GPU-00000012%' or uuid like '%GPU-00000012%')
    and date_trunc('second', ts) >= timestamp '2024-01-05 00:00:00'
    and date_trunc('second', ts) <= timestamp '2024-01-20 00:00:00'
    order by date_trunc('second', ts) desc, seq desc limit 50"""

_FIRST_MESSAGES = """select * from (select *, row_number() over (
    partition by topic order by stream_key) as rn from messages)"""


def _errors() -> str:
    """One row per failed check of the requests."""
    id_ok = "'^[a-zA-Z0-9_-]+$'"

    def rule(field: str, *cases: tuple[str, str]) -> str:
        whens = " ".join(f"when {c} then '{m}'" for c, m in cases)
        return f"select '{field}' as field, case {whens} end as message from requests"

    start = [
        ("event_type = 'error'", C.START_INVALID),
        ("t0 < timestamp '2022-01-15 00:00:00'", C.START_OLD),
    ]
    end = [
        ("bad_end", C.END_INVALID),
        ("t1 > timestamp '2024-01-15 01:00:00'", C.END_AHEAD),
    ]
    span = [
        ("s0 > s1", C.RANGE_REVERSED),
        ("s1 - s0 > interval 30 days", C.RANGE_LONG),
    ]
    timed = """(select *, date_trunc('second', t0) as s0, date_trunc('second', t1) as s1
        from requests)"""
    chain = [("start_time", c, m) for c, m in start] + [("end_time", c, m) for c, m in end] + [
        ("time_range", c, m) for c, m in span
    ]
    fields = " ".join(f"when {c.replace('t0', 's0').replace('t1', 's1')} then '{f}'" for f, c, _ in chain)
    texts = " ".join(f"when {c.replace('t0', 's0').replace('t1', 's1')} then '{m}'" for _, c, m in chain)
    times = f"select case {fields} end as field, case {texts} end as message from {timed}"
    return " union all ".join(
        [
            rule(
                "gpu_id", ("gpu_id = ''", C.GPU_ID_REQUIRED), ("strlen(gpu_id) > 100", C.GPU_ID_LONG),
                (f"not regexp_full_match(gpu_id, {id_ok})", C.GPU_ID_INVALID),
            ),
            rule(
                "hostname", ("hostname = ''", C.HOSTNAME_REQUIRED),
                ("strlen(hostname) > 253", C.HOSTNAME_LONG),
                (
                    "not regexp_full_match(hostname, '[a-zA-Z0-9][a-zA-Z0-9.-]*[a-zA-Z0-9]')",
                    C.HOSTNAME_INVALID,
                ),
            ),
            rule(
                "cluster_id", ("cluster_id = ''", C.CLUSTER_ID_REQUIRED),
                ("strlen(cluster_id) > 50", C.CLUSTER_ID_LONG),
                (f"not regexp_full_match(cluster_id, {id_ok})", C.CLUSTER_ID_INVALID),
            ),
            times,
            rule(
                "limit", ("event_type = 'error'", C.LIMIT_INVALID),
                ("number <= 0", C.LIMIT_POSITIVE), ("number > 1000", C.LIMIT_LARGE.format(1000)),
            ),
        ]
    )


_LONG_METRICS = " union all ".join(
    f"select seq, uuid, '{m}' as metric_name, {rnd(m, name='value')} from wide" for m in METRICS
)

_BUCKET = """numbered as (
      select seq, hostname, ts, row_number() over (partition by hostname order by ts, seq) as rn
      from readings),
    refilled as (
      select seq, hostname, ts, rn, 2.0::double as filled from numbered where rn = 1
      union all
      select n.seq, n.hostname, n.ts, n.rn,
        least(2.0::double,
          (case when r.filled >= 1 then r.filled - 1 else r.filled end)
          + (epoch_us(n.ts) - epoch_us(r.ts)) / 1e6::double * (1.0::double / 86400))
      from refilled r join numbered n on n.hostname = r.hostname and n.rn = r.rn + 1)"""

_SESSIONS = """select service_type, instance_id, min(ts) as up_from,
      max(ts) + interval 12 hours as down_at, arg_max(health, ts) as health,
      count(*) as heartbeats
    from (
      select *, count(*) filter (gap) over (partition by service_type, instance_id order by ts
        rows unbounded preceding) as session
      from (select *, ts - lag(ts) over (partition by service_type, instance_id order by ts)
          >= interval 12 hours as gap from heartbeats))
    group by service_type, instance_id, session
    having max(ts) + interval 12 hours <= (select max(ts) from heartbeats)"""

_CHANGES = """select seq, key, case when op = 'DELETE' then 'delete'
      when coalesce(lag(op) over (partition by key order by seq), 'DELETE') = 'DELETE'
        then 'create' else 'update' end as event_type from changelog"""

_REJECTS = "case when hostname = '' then 'missing required fields' end"


def _window(hours: int) -> str:
    return f"""{_IDENTITY}, date_trunc('hour', ts) as window_start,
      date_trunc('hour', ts) + interval {hours} hour as window_end"""


ORACLES: dict[str, str] = {
    "readings_by_gpu_api": _with(
        f"""select {_ISO} as "timestamp", gpu_id, hostname, {_ROUNDED}
        from (select * from wide where {_MAIN})""", "wide"),
    "telemetry_by_gpu": _with(
        f"select seq, hostname, gpu_id, metric_name, value from readings where {_MAIN}",
        "readings"),
    "match_gpu_exact": _with(
        "select seq, uuid, ts, value from readings where uuid = 'GPU-00000012'", "readings"),
    "telemetry_oldest_first": _with(
        """select seq, ts, hostname, gpu_id, value from readings
        where ts >= timestamp '2024-01-10 12:00:00' order by ts, seq limit 200""", "readings"),
    "filter_readings": _with(
        """select seq, ts, metric_name, value from readings
        where hostname = 'gpu-node-00001' and (contains(gpu_id, '3') or contains(uuid, '3'))
          and date_trunc('second', ts)
            between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-28 00:00:00'
        order by date_trunc('second', ts) desc, seq desc limit 100""", "readings"),
    "gpu_metrics": _with(
        """select seq, ts, metric_name, value from readings where cluster_id = 'cluster-1'
        and hostname = 'gpu-node-00001' and gpu_id = '4'""", "readings"),
    "latest_readings": _with(
        f"""select {_IDENTITY}, seq, ts, metric_name, value from (
          select *, row_number() over (partition by {_IDENTITY} order by ts desc, seq desc) as rn
          from readings) where rn = 1""", "readings"),
    "page_rows": _with(
        """select seq, ts, value from readings
        order by ts desc, seq desc limit 50 offset 100""", "readings"),
    "page_summary": _with(
        """select count(*) as total_count, count(*) > 150 as has_more from readings""", "readings"),
    "page_deep": _with(
        """select seq, ts, value from (
          select *, row_number() over (order by date_trunc('second', ts) desc, seq desc) as rn, count(*) over () as n
          from readings)
        where rn > n // 2 and rn <= n // 2 + 50""", "readings"),
    "match_known_gpu": _with(
        """select seq, uuid, gpu_id, value from readings
        where gpu_id like '%U-0000001%' or uuid like '%U-0000001%'""", "readings"),
    "page_after": _with(
        """select seq, ts, value from readings where (ts, seq) <
        (timestamp '2024-01-15 12:00:00', 0) order by ts desc, seq desc limit 75""", "readings"),
    "reading_span": _with(
        """select hostname, metric_name, min(ts) as first_ts, max(ts) as last_ts,
        count(*) as record_count from readings group by 1, 2""", "readings"),
    "long_to_wide": _with(
        f"""select date_trunc('second', ts) as ts, {_IDENTITY}, arg_max(uuid, seq) as uuid,
          arg_max(device, seq) as device, arg_max(model_name, seq) as model_name, """
        + ", ".join(
            f"""round(coalesce(cast(cast(arg_max(value, seq) filter (metric_name = '{m}')
            as float) as double), 0), 4) as {m}""" for m in METRICS)
        + f" from readings group by date_trunc('second', ts), {_IDENTITY}", "readings"),
    "wide_to_long": _with(_LONG_METRICS, "wide"),
    "upsert_last_write": _with(
        f"""select telemetry_id, {_IDENTITY}, seq, {rnd('power_draw')} from (
          select *, row_number() over (partition by cluster_id, telemetry_id order by seq desc)
            as rn from (select *, {_TELEMETRY_ID} as telemetry_id from doubled)) where rn = 1""",
        "doubled"),
    "stamp_lineage": _with(
        f"""select {_TELEMETRY_ID} as telemetry_id, 'collector-1' as collector_id,
        'batch_1706659200' as batch_id, {_AS_OF} as collected_at,
        cast(0 as integer) as custom_count from wide""", "wide"),
    "health_flag": _with(
        """select hostname, temperature < 85 and gpu_utilization >= 0 as healthy, count(*) as n
        from wide group by 1, 2""", "wide"),
    "windowed_utilisation": _with(
        f"""select {_window(1)}, count(*) as readings,
        round(avg(cast(gpu_utilization as double)), 4) as avg_gpu_utilization,
        {rnd('max(gpu_utilization)', name='max_gpu_utilization')},
        round(avg(cast(memory_utilization as double)), 4) as avg_memory_utilization,
        {rnd('max(memory_utilization)', name='max_memory_utilization')},
        {rnd('max(temperature)', name='max_temperature')}
        from wide group by all""", "wide"),
    "windowed_utilisation_sliding": _with(
        f"""select cluster_id, window_start, count(*) as gpu_windows,
          cast(sum(n) as bigint) as readings from (
            select {_IDENTITY}, window_start, count(*) as n from (
              select *, date_trunc('hour', ts) - to_hours(h) as window_start
              from wide, (values (0), (1)) as t(h)) group by all)
          group by 1, 2""", "wide"),
    "parse_numbers": """select event_id as seq,
        case event_type when 'click' then round(cast(cast(value as float) as double), 4)
          else 0.0 end as as_float32,
        event_type = 'signup' and value > 0 as huge_float64,
        case when event_type in ('click', 'purchase') then round(value, 4) else 0.0 end
          as as_float64 from events""",
    "parse_ts": f"""select event_id as seq, case event_type
        when 'click' then date_trunc('millisecond', ts) when 'view' then date_trunc('second', ts)
        when 'signup' then date_trunc('second', ts) - interval 2 hours
        else {_AS_OF} end as parsed from events""",
    "clean_text": """select event_id as seq, cast(user_id as varchar) as cleaned,
        case when event_type = 'click' then 'click' else cast(user_id as varchar) end as first_set,
        concat('a', user_id, chr(9), 'b') as sanitized from events""",
    "resolve_relative_time": f"""select event_id as seq, case event_type
        when 'click' then {_AS_OF} - to_seconds(k) when 'view' then {_AS_OF} + to_minutes(k)
        when 'signup' then {_AS_OF} - to_hours(k) when 'purchase' then {_AS_OF} + to_days(k)
        end as "at" from (select *, cast(json_extract(props, '$.k') as integer) as k
        from events)""",
    "classify_key": _with(
        f"""select seq, case metric_name when 'gpu_utilization' then 'gpu'
          when 'temperature' then 'data' when 'power_draw' then 'other'
          when 'memory_utilization' then 'host' else 'cluster' end as kind,
        cluster_id as cluster,
        case when metric_name <> 'memory_used_mb' then hostname end as host,
        case when metric_name not in ('memory_used_mb', 'memory_utilization') then gpu_id end as gpu,
        case when metric_name = 'temperature' then {_TELEMETRY_ID} end as point
        from readings""", "readings"),
    "headers_json": """select event_id as seq, case when event_type = 'error' then '{}'
        else concat('{"type":"', event_type, '","user":"', user_id, '"}') end as headers_json
        from events""",
    "quality_report": _with(
        f"""select field, message, count(*) as n from ({_errors()})
        where message is not null group by 1, 2""", "requests"),
    "drop_missing_identity": _with(
        """select seq, case when value >= 5 then 'good' else 'missing required fields' end
        as outcome from readings""", "readings"),
    "register_hosts": _with(
        """select cluster_id, hostname, 'unknown' as ip_address, created_at, 'active' as state,
        true as healthy, last_seen, 'ok' as ping from hosts""", "hosts"),
    "register_gpus": _with(
        f"""select {_IDENTITY}, uuid, device, device_name, 'unknown' as driver_version,
        created_at, updated_at from gpus""", "gpus"),
    "gpu_status": _with(
        f"""select {_IDENTITY}, uuid, 'active' as state, {rnd('utilization_percent')},
        {rnd('memory_used_percent')}, {rnd('temperature_celsius')}, {rnd('power_draw_watts')},
        healthy, last_updated from status""", "status"),
    "list_gpus": _with(
        """select gpu_id as id, uuid, hostname, device_name as name, device, 'active' as status
        from (select *, row_number() over (partition by uuid order by concat(
          '/telemetry/clusters/', cluster_id, '/hosts/', hostname, '/gpus/', gpu_id) desc) as rn
          from gpus) where rn = 1""", "gpus"),
    "list_clusters": _with(
        """select cluster_id as id, cluster_id as name, 'active' as status,
        host_count, gpu_count from host_counts join gpu_counts using (cluster_id)""",
        "host_counts", "gpu_counts"),
    "list_hosts": _with("select distinct hostname from readings", "readings"),
    "list_gpus_of_host": _with(
        """select gpu_id, uuid from gpus where hostname = 'gpu-node-00001'
        and cluster_id = 'cluster-1'""", "gpus"),
    "get_gpu": _with(
        f"""select {_IDENTITY}, uuid from gpus where hostname = 'gpu-node-00001'
        and cluster_id = 'cluster-1' and gpu_id = '4'""", "gpus"),
    "get_host": _with(
        """select hostname, created_at from hosts where hostname = 'gpu-node-00001'
        and cluster_id = 'cluster-1'""", "hosts"),
    "fleet_tree": _with(
        """select s.cluster_id, cast(h.host_count as integer) as total_hosts,
        cast(g.gpu_count as integer) as total_gpus, s.hostname, cast(0 as bigint) as part,
        string_agg(concat_ws('/', gpu_id, uuid, device_name, 'active',
          case when healthy then 'ok' else 'hot' end), ',' order by gpu_id) as gpus
        from status s join host_counts h using (cluster_id) join gpu_counts g using (cluster_id)
        group by 1, 2, 3, 4, 5""", "status", "host_counts", "gpu_counts"),
    "cluster_metadata": _with(
        """select cluster_id, cast(host_count as integer) as total_hosts,
        cast(gpu_count as integer) as total_gpus, cast(host_count as integer) as active_hosts,
        cast(healthy_count as integer) as active_gpus
        from host_counts join gpu_counts using (cluster_id)""", "host_counts", "gpu_counts"),
    "cluster_counts": _with(
        """select cluster_id, host_count, gpu_count
        from host_counts join gpu_counts using (cluster_id)""", "host_counts", "gpu_counts"),
    "get_cluster": _with(
        """select cluster_id, host_count, gpu_count from host_counts
        join gpu_counts using (cluster_id) where cluster_id = 'cluster-1'""",
        "host_counts", "gpu_counts"),
    "hosts_with_gpu_count": _with(
        """select cluster_id, hostname, 'active' as status, count(*) as gpu_count
        from gpus group by 1, 2""", "gpus"),
    "cluster_stats": _with(
        """select cluster_id, cast(host_count as integer) as total_hosts,
        cast(gpu_count as integer) as total_gpus, cast(healthy_count as integer) as active_gpus,
        m.* exclude (cluster_id) from host_counts join gpu_counts using (cluster_id)
        join (select cluster_id, count(*) as telemetry_records,
          round(avg(cast(gpu_utilization as double)), 4) as average_gpu_util,
          round(avg(cast(memory_utilization as double)), 4) as average_memory_util,
          max(ts) as last_updated from wide group by 1) m using (cluster_id)""",
        "host_counts", "gpu_counts"),
    "reconcile_counts": _with(
        """select *, floor(stored * 10000 / expected) / 100 as percent,
        case when stored = 0 then 'none' when stored = expected then 'complete'
          else 'partial' end as status
        from (select hostname, count(*) as expected, count(*) filter (value >= 5) as stored
          from readings group by 1)""", "readings"),
    "missing_readings": _with(
        f"""select telemetry_id, seq, value from (
          select *, {_TELEMETRY_ID} as telemetry_id from readings) r
        where not exists (select 1 from (select *, {_TELEMETRY_ID} as telemetry_id from readings
          where value >= 5) s where s.cluster_id = r.cluster_id
          and s.telemetry_id = r.telemetry_id)""", "readings"),
    "ingest_stats": _with(
        """select hostname as source_file, count(*) filter (value >= 5) as processed, count(*) as total,
        count(*) filter (value < 5) as skipped, round(count(*) filter (value >= 5) / 10.0::double, 2)
          as records_per_second from readings group by 1""", "readings"),
    "sender_metrics": """select
        cast(sum(cast(floor(value) as bigint)) filter (event_type <> 'error') as bigint)
          as total_processed,
        count(*) filter (event_type <> 'error') as total_batches,
        count(*) filter (event_type = 'error') as total_errors, max(ts) as last_process_time,
        round(cast(sum(cast(floor(value) as bigint)) filter (event_type <> 'error') as double)
          / (30 * 86400), 6) as processing_rate from events""",
    "union_inputs": _with(
        """select cluster_id, is_wide, count(*) as n from (
          select cluster_id, false as is_wide from readings
          union all select cluster_id, true from readings) group by 1, 2""", "readings"),
    "encode_messages": _with(
        f"""select concat(hostname, '_', gpu_id, '_', lpad(cast(seq as varchar), 19, '0')) as message_id,
        'telemetry' as topic,
        concat('/telemetry/queue/telemetry/1706659200000000000_', lpad(cast(seq as varchar), 19, '0'), '_',
          hostname, '_', gpu_id) as stream_key, {_AS_OF} as created_at, {_AS_OF} + interval 1 hour as expires_at,
        false as processed, cast(0 as integer) as retries, {_ISO} as header_timestamp,
        uuid as payload_uuid, {_ROUNDED} from wide""", "wide"),
    "consume_encoded": _with(
        """select lpad(cast(seq as varchar), 19, '0') as number, hostname from wide
        order by seq limit 120""", "wide"),
    "decode_messages": _with(
        "select concat(hostname, '_', gpu_id, '_', lpad(cast(seq as varchar), 19, '0')) as message_id, "
        f"""case when gpu_id = '7' then '{{"gpu_id": '
        when gpu_id = '6' then concat('{{"gpu_id": "6"}} ', 'xyz') when gpu_id = '5' then '  '
        when gpu_id = '4' then '' else {_ISO} end as "timestamp", """
        "case when gpu_id < '4' then hostname end as hostname, "
        "case when gpu_id < '4' then uuid end as uuid, "
        + ", ".join(
            f"case when gpu_id < '4' then round(cast({m} as double), 4) end as {m}"
            for m in METRICS)
        + " from wide", "wide"),
    "live_messages": _with(
        f"select message_id, expires_at from messages where expires_at >= {_AS_OF}", "messages"),
    "expired_messages": _with(
        f"select message_id from messages where expires_at < {_AS_OF}", "messages"),
    "expired_unacked": _with(
        f"""select message_id, topic, expires_at from fates where expires_at < {_AS_OF}
        and (acked_at is null or acked_at > expires_at)""", "fates"),
    "consume_fifo": _with(
        f"""select message_id, stream_key from ({_FIRST_MESSAGES}) where rn <= 200
        and topic = 'click' and expires_at >= timestamp '2024-01-04 00:00:00'""", "messages"),
    "consume_many": _with(
        f"""select message_id, topic from ({_FIRST_MESSAGES}) where rn <= 100
        and topic in ('click', 'view', 'error')
        and expires_at >= timestamp '2024-01-04 00:00:00'""", "messages"),
    "claim_work": _with(
        f"""select message_id, concat('c-', (rn - 1) % 3) as consumer_id,
        concat('/processing/c-', (rn - 1) % 3, '/1704326400000000000_',
          lpad(cast(seq as varchar), 12, '0')) as processing_key
        from ({_FIRST_MESSAGES}) where rn <= 120 and topic = 'view'
        and expires_at >= timestamp '2024-01-04 00:00:00'""", "messages"),
    "claim_remaining": _with(
        f"""select message_id, topic from ({_FIRST_MESSAGES})
        where not (rn <= 120 and topic = 'view')""", "messages"),
    "ack_remaining": _with(
        "select message_id, topic from known_messages where not acked", "known_messages"),
    "ack_outcome": _with(
        """select distinct a.message_id, case when m.message_id is null then 'failed'
        else 'acked' end as outcome from acks a left join messages m using (message_id)""",
        "acks", "messages"),
    "list_topics": _with("select distinct topic from messages", "messages"),
    "queue_depth": _with("select topic, count(*) as depth from messages group by 1", "messages"),
    "topic_stats": _with(
        """select topic, count(*) as message_count, any_value(consumers) as consumer_count,
        max(created_at) as last_message, count(*) filter (acked) as processed_count,
        count(*) filter (not acked and alive) as pending_count
        from known_messages join (select topic, count(distinct consumer_id) as consumers
          from acks group by 1) using (topic) group by 1""", "known_messages"),
    "queue_totals": _with(
        """select count(*) as total_messages,
        count(*) filter (not acked and alive) as pending_messages,
        count(*) filter (acked) as processed_messages,
        (select count(distinct message_id) from acks
          where message_id not in (select message_id from messages)) as failed_messages
        from known_messages""", "known_messages"),
    "recover_orphans": _with(
        f"""select message_id, case when in_process then concat('/telemetry/queue/', topic,
          '/1706659200000000000_', message_id, '_1706659200') else stream_key end as stream_key
        from (select *, expires_at - created_at >= interval 50 hours as in_process from messages)
        where not in_process or created_at < {_AS_OF} - interval 10 days""", "messages"),
    "recover_still_processing": _with(
        f"""select message_id, stream_key from messages
        where expires_at - created_at >= interval 50 hours
        and created_at >= {_AS_OF} - interval 10 days""", "messages"),
    "pack_batches": _with(
        """select "partition", batch_no, count(*) as n, min(ts) as first_ts, max(ts) as last_ts,
        min(seq) as first_seq, max(seq) as last_seq from batched group by 1, 2""", "batched"),
    "explode_batches": _with(
        """select concat(gpu_id, '-', cast(floor((row_number() over (
          partition by gpu_id order by seq) - 1) / 500) as bigint)) as batch_id,
        date_trunc('second', ts) as "timestamp", metric_name, gpu_id, uuid, hostname, value,
        labels_raw from readings""", "readings"),
    "classify_changes": _with(_CHANGES, "changelog"),
    "current_config": _with(
        """select key, case when arg_max(op, seq) = 'PUT' then arg_max(value, seq)
        else '{"k": -1}' end as value from changelog group by 1""", "changelog"),
    "snapshot_diff": _with(
        """select * from (select hostname, gpu_id, metric_name, case when o.v is null then 'create'
          when n.v is null then 'delete' when o.v <> n.v then 'update' end as event_type
        from (select hostname, gpu_id, metric_name, arg_max(round(value, 0), seq) as v
          from readings where ts < timestamp '2024-01-16 00:00:00' group by 1, 2, 3) o
        full join (select hostname, gpu_id, metric_name, arg_max(round(value, 0), seq) as v
          from readings where ts >= timestamp '2024-01-16 00:00:00' group by 1, 2, 3) n
        using (hostname, gpu_id, metric_name)) where event_type is not null""", "readings"),
    "live_services_now": _with(
        """select service_type, instance_id, max(ts) as ts, arg_max(health, ts) as health
        from heartbeats where ts <= timestamp '2024-01-20 00:00:00' group by 1, 2
        having max(ts) > timestamp '2024-01-19 18:00:00'""", "heartbeats"),
    "latest_instance_metrics": _with(
        f"""select service_type, instance_id, seq, ts, {rnd('cpu_usage', 6)},
        {rnd('memory_usage', 6)}, {rnd('queue_depth', 6)}, health from newest_metrics""",
        "newest_metrics"),
    "service_load": _with(
        """select service_type, round(coalesce(load, 0), 6) as load,
        coalesce(n, 0) as instance_count, coalesce(healthy, 0) as healthy_count
        from (select distinct service_type from metrics) left join loads using (service_type)""",
        "loads"),
    "in_cooldown": _with(
        """select service_type, coalesce(action <> 'no_action'
          and timestamp '2024-01-30 00:00:00' - ts < interval 4 hours, false) as in_cooldown
        from rules left join last_decisions using (service_type)""", "rules", "last_decisions"),
    "scaling_decisions": _with(
        f"""select service_type, cast(coalesce(n, 0) as integer) as current_count,
        case when n is null or cooling then 'no_action'
          when load > 0.8 and n < max_instances then 'scale_up'
          when load < 0.3 and n > 1 then 'scale_down' else 'no_action' end as action,
        cast(case when n is null then 1 when cooling then n
          when load > 0.8 and n < max_instances then n + 1
          when load < 0.3 and n > 1 then n - 1 else n end as integer) as recommended_count,
        case when not known then 'no metrics available'
          when n is null then 'no recent metrics available'
          when cooling then 'in cooldown period'
          when load > 0.8 and n < max_instances
            then printf('high load detected: %.2f%% > 80.00%%', load * 100)
          when load < 0.3 and n > 1 then printf('low load detected: %.2f%% < 30.00%%', load * 100)
          else printf('load within acceptable range: %.2f%%', load * 100) end as reason,
        cast(case when n is null then 0.5 when cooling then 0.8
          when (load > 0.8 and n < max_instances) or (load < 0.3 and n > 1) then 1.0
          else 0.9 end as double) as confidence, {_AS_OF} as ts
        from (select r.*, l.n, l.load, k.service_type is not null as known,
            coalesce(d.action <> 'no_action' and {_AS_OF} - d.ts < interval 4 hours, false)
              as cooling
          from rules r left join loads l using (service_type)
          left join (select distinct service_type from metrics) k using (service_type)
          left join last_decisions d using (service_type))""",
        "rules", "loads", "last_decisions"),
    "publish_decisions": _with("select service_type, action, ts from last_decisions",
                               "last_decisions"),
    "throttle_batch": _with(
        "select seq, hostname, ts, filled >= 1 as allowed from refilled",
        "readings", recursive=_BUCKET),
    "read_wide_csv": _with(
        f"""select ts, hostname, gpu_id, uuid, device, model_name, {_ROUNDED},
        {_REJECTS} as reject_reason from wide_csv""", "wide_csv"),
    "read_long_csv": _with(
        """select date_trunc('second', ts) as ts, 'default-cluster' as cluster_id, metric_name,
        gpu_id, device, uuid, model_name, hostname, '' as container, '' as pod, '' as "namespace",
        value, concat('k="', uuid, '",x="', metric_name, '"') as labels_raw from readings""",
        "readings"),
    "ingest_manifest": _with(
        """select 'processed' as status, '' as error, 'wide' as form,
          count(*) filter (hostname <> '') as record_count, count(*) as total_records,
          count(*) filter (hostname = '') as skipped_records, true as hashed from wide_csv
        union all select 'processed', '', 'long', count(*), count(*), 0, true from readings
        union all select 'error', 'missing required headers: [timestamp hostname]', 'bad', 0, 0, 0, true
        union all select 'error', 'missing required headers: [any metric]', 'none', 0, 0, 0, true""",
        "wide_csv", "readings"),
    "select_input_files": """with sizes as (
          select event_type, sum(length(cast(event_id as varchar)) + 1) + 9 as size from events group by 1)
        select concat('event_type=', event_type) as folder, cast(size as bigint) as size from sizes
        where size <= (select avg(size) from sizes)""",
    "ingest_folder_job": _with(
        f"""select {_ISO} as "timestamp", hostname, gpu_id, uuid, {_ROUNDED} from wide_csv
        where hostname <> ''""", "wide_csv"),
    "write_readings": _with(
        """select cluster_id, strftime(ts, '%Y-%m-%d') as event_date, count(*) as n,
        max(seq) as last_seq
        from readings where date_trunc('second', ts)
          between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-20 18:00:00'
        group by 1, 2""", "readings"),
    "import_kv_dump": _with(
        f"""select cluster_id, count(*) as n, 'point' as kind from wide group by 1
        union all select cluster_id, gpu_count, 'gpu' from gpu_counts
        union all select cluster_id, host_count, 'host' from host_counts
        union all select cluster_id, 1, 'cluster' from host_counts""",
        "wide", "gpu_counts", "host_counts"),
    "broken_kv_values": _with(
        """select concat('/telemetry/clusters/', cluster_id, '/hosts/', hostname, '/gpus/', gpu_id, '/data/', seq)
          as key, 'data' as kind, case when gpu_id = '7' then '{"uuid":"' end as value
        from wide where gpu_id in ('6', '7')""", "wide"),
    "run_ingest_stream": _with(
        f"""select hostname, gpu_id, {_ISO} as "timestamp", coalesce({_REJECTS}, '') as reason,
        round(cast(temperature as double), 4) as temperature, round(cast(power_draw as double), 4) as power_draw
        from wide_csv""", "wide_csv"),
    "custom_metrics": _with(
        f"""select telemetry_id, seq from (
          select *, row_number() over (partition by telemetry_id order by ts desc, seq desc) as rn
          from (select *, {_TELEMETRY_ID} as telemetry_id from wide_csv where {_REJECTS} is null)) where rn = 1""",
        "wide_csv"),
    "ingest_by_two_streams": _with(
        f"""select hostname, gpu_id, {_ISO} as "timestamp", coalesce({_REJECTS}, '') as reason,
        round(cast(temperature as double), 4) as temperature, round(cast(power_draw as double), 4) as power_draw
        from wide_csv""", "wide_csv"),
    "ingest_long_folder": _with(
        f"""select {_ISO.replace('ts', "date_trunc('second', ts)")} as "timestamp", hostname, gpu_id, uuid,
        {', '.join(f"round(cast(cast(coalesce(arg_max(value, ts) filter (metric_name = '{m}'), 0) as float) as double), 4) as {m}" for m in METRICS)}
        from readings group by date_trunc('second', ts), hostname, gpu_id, uuid""", "readings"),
    "walk_pages": _with("select seq, ts from readings", "readings"),
    "all_readings_of_gpu": _with(
        f"""select seq, hostname, gpu_id from wide where uuid like '%GPU-0000000%'""", "wide"),
    "write_with_retry": _with("select seq, ts from readings", "readings"),
    "run_collect_stream": _with(
        f"""select telemetry_id, uuid, {rnd('power_draw')} from (
          select *, row_number() over (partition by telemetry_id order by seq desc) as rn
          from (select *, {_TELEMETRY_ID} as telemetry_id from doubled)) where rn = 1""",
        "doubled"),
    "collected_cluster_stats": _with(
        f"""select cluster_id, count(distinct hostname)::integer as total_hosts,
          count(distinct (hostname, gpu_id))::integer as total_gpus, count(*) as telemetry_records,
          round(avg(cast(gpu_utilization as double)), 4) as average_gpu_util,
          round(avg(cast(memory_utilization as double)), 4) as average_memory_util,
          date_trunc('second', max(ts))::timestamp as last_updated
        from (
          select * replace ('cluster-0' as cluster_id), row_number() over (partition by telemetry_id order by seq desc) as rn
          from (select *, {_TELEMETRY_ID} as telemetry_id from doubled))
        where rn = 1 group by 1""",
        "doubled"),
    "collected_by_two_streams": _with(
        f"""select telemetry_id, uuid, {rnd('power_draw')} from (
          select *, row_number() over (partition by telemetry_id order by seq desc) as rn
          from (select *, {_TELEMETRY_ID} as telemetry_id from doubled))
        where rn = 1 and date_trunc('second', ts)
          between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-20 18:00:00'""",
        "doubled"),
    "collected_status": _with(
        f"""select hostname, gpu_id, g.uuid, g.device_name,
        l.temperature < 85 and l.gpu_utilization >= 0 as healthy,
        round(cast(cast(l.power_draw + 1 as float) as double), 4) as power_draw_watts
        from gpus g join latest l using ({_IDENTITY})""", "gpus", "latest"),
    "collect_messages_job": _with(
        """select 'default-cluster' as cluster_id, hostname,
        date_trunc('second', min(ts)) as created_at, count(distinct gpu_id) as gpus,
        count(distinct (gpu_id, date_trunc('second', ts))) as points from wide group by hostname""", "wide"),
    "snapshot_then_tail": _with("select message_id, topic, created_at from messages", "messages"),
    "dedup_stream": _with(f"select {_IDENTITY}, uuid, device_name as model_name from gpus", "gpus"),
    "latest_status_stream": _with(
        f"""select {_IDENTITY}, seq, ts, value from (
          select *, row_number() over (partition by {_IDENTITY} order by ts desc, seq desc) as rn
          from readings) where rn = 1""", "readings"),
    "status_from_state": _with(
        f"""select {_IDENTITY}, {rnd('utilization_percent')}, {rnd('memory_used_percent')},
        {rnd('temperature_celsius')}, {rnd('power_draw_watts')}, healthy from status""", "status"),
    "expire_stream": _with(
        """select message_id, topic, expires_at as expired_at from fates
        where (acked_at is null or acked_at > expires_at)
          and epoch_ms(expires_at) + 1 <= (select least(
            (select epoch_ms(max(created_at)) from messages),
            (select epoch_ms(max(acked_at)) from acks)))""", "fates"),
    "liveness_stream": _with(_SESSIONS, "heartbeats"),
    "throttle_stream": _with(
        "select seq, hostname, filled >= 1 as allowed from refilled",
        "readings", recursive=_BUCKET),
    "change_feed": _with(_CHANGES, "changelog"),
    "batch_stream": _with(
        'select "partition", batch_no, count(*) as n from batched group by 1, 2', "batched"),
    "windowed_utilisation_stream": _with(
        f"""select {_IDENTITY}, date_trunc('hour', ts) as window_start, count(*) as readings,
        round(avg(cast(gpu_utilization as double)), 4) as avg_gpu_utilization,
        {rnd('max(temperature)', name='max_temperature')} from wide
        group by {_IDENTITY}, date_trunc('hour', ts)
        having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from wide)""", "wide"),
}
