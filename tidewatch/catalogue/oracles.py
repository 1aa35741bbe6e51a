"""Plain SQL with the same answers as the queries, for an independent engine (DuckDB)."""

from __future__ import annotations

from tidewatch.catalogue.forest_sql import ensemble_ctes as forest_ensemble_ctes
from tidewatch.catalogue.forest_sql import scored_ctes, walk_ctes

# Building blocks

EVENTS = """
ev as (select event_type as stream, event_id, ts, user_id, value, props,
         cast(json_extract_string(props, '$.k') as double) as k from events)
"""


def fit_ctes(source: str, keys: str, order: str) -> str:
    """``f``: rows with position ``i``, series length ``n`` and fit length ``kk``."""
    return f"""
o as (select *, row_number() over (partition by {keys} order by {order}) - 1 as i,
        count(*) over (partition by {keys}) as n from {source}),
f as (select *, least(greatest(cast(floor(n * cast(0.8 as double)) as bigint), 10), n - 1) as kk
        from o where n >= 10)
"""


def mad_ctes(tag: str, column: str, key: str, fit: str = "f", limit: str = "i < kk") -> str:
    """``p_<tag>``: median, mad and threshold per series; ``s_<tag>``: scored rows."""
    return f"""
v_{tag} as (select {key}, kk, {column} as v,
     row_number() over (partition by {key} order by {column}) - 1 as r from {fit} where {limit}),
m_{tag} as (select {key}, any_value(kk) as kk,
     (max(case when r = (kk - 1) // 2 then v end) + max(case when r = kk // 2 then v end)) / 2 as med
     from v_{tag} group by {key}),
d_{tag} as (select a.{key}, m.kk, abs(v - med) as d,
     row_number() over (partition by a.{key} order by abs(v - med)) - 1 as r
     from v_{tag} a join m_{tag} m on a.{key} = m.{key}),
q_{tag} as (select {key}, greatest((max(case when r = (kk - 1) // 2 then d end)
       + max(case when r = kk // 2 then d end)) / 2, cast(1e-9 as double)) as mad,
     max(case when r = cast(floor((kk - 1) * cast(95.0 as double) / 100.0) as bigint) then d end) as top
     from d_{tag} group by {key}),
p_{tag} as (select m.{key}, med, mad, top / (cast(1.4826 as double) * mad) as thr
     from m_{tag} m join q_{tag} q on m.{key} = q.{key}),
s_{tag} as (select f.*, med, mad, thr, abs({column} - med) / (cast(1.4826 as double) * mad) as z
     from f join p_{tag} p on f.{key} = p.{key})
"""


EVENT_FIT = "with " + EVENTS + "," + fit_ctes("ev", "stream", "ts, event_id")
EVENT_MAD = EVENT_FIT + "," + mad_ctes("v", "value", "stream")


def ensemble_ctes(percentile: float = 95.0, tag: str = "") -> str:
    """``e<tag>``: events with both scores, the combined score, its threshold and the flag."""
    return f"""
b{tag} as (select stream, min(z) as lo, max(z) as hi from s_v where i < kk group by stream),
c{tag} as (select stream, min(z) as lo, max(z) as hi from s_k where i < kk group by stream),
w{tag} as (select a.stream, a.event_id, a.ts, a.value, a.k, a.i, a.kk, a.z as z_v, a.thr as thr_v,
     x.z as z_k, x.thr as thr_k,
     0.0::double + cast(0.6 as double) / cast(1.0 as double)
         * (case when b.hi = b.lo then 0.0 else (a.z - b.lo) / (b.hi - b.lo) end)
       + cast(0.4 as double) / cast(1.0 as double)
         * (case when c.hi = c.lo then 0.0 else (x.z - c.lo) / (c.hi - c.lo) end) as combined
     from s_v a join s_k x on a.event_id = x.event_id
     join b{tag} b on a.stream = b.stream join c{tag} c on a.stream = c.stream),
t{tag} as (select stream, combined as ethr from (select stream, combined, kk,
       row_number() over (partition by stream order by combined) - 1 as r from w{tag} where i < kk) z
     where r = cast(floor((kk - 1) * cast({percentile} as double) / 100.0) as bigint)),
e{tag} as (select w.*, ethr, combined > ethr as flag from w{tag} w join t{tag} t on w.stream = t.stream)
"""


EVENT_ENSEMBLE = EVENT_MAD + "," + mad_ctes("k", "k", "stream") + "," + ensemble_ctes()

ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || (case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end) || '+00:00'"

LABELS = """
lab as (select e.event_id, e.event_type as stream,
     cast(exists (select 1 from events x where x.event_type = 'error' and x.user_id = e.user_id
       and e.ts between x.ts and x.ts + interval 6 hours) as int) as label from events e)
"""

QUALITY = """
     count(*) filter (where label and flag) as tp,
     count(*) filter (where not label and flag) as fp,
     count(*) filter (where label and not flag) as fn
"""

RATED = """
     cast(tp as bigint) as true_positives, cast(fp as bigint) as false_positives,
     cast(fn as bigint) as false_negatives,
     round(case when tp + fp = 0 then 0.0 else tp / cast(tp + fp as double) end, 6) as "precision",
     round(case when tp + fn = 0 then 0.0 else tp / cast(tp + fn as double) end, 6) as recall,
     round(case when tp = 0 then 0.0 else 2.0 * (tp / cast(tp + fp as double)) * (tp / cast(tp + fn as double))
       / (tp / cast(tp + fp as double) + tp / cast(tp + fn as double)) end, 6) as f1
"""


def draw(*parts: str) -> str:
    """The hash of the parts as a number in [0, 1)."""
    text = ", ".join(parts)
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::bigint / 4294967296.0::double)"


def normal(*parts: str) -> str:
    radius, angle = draw("'radius'", *parts), draw("'angle'", *parts)
    return f"(sqrt(-2.0 * ln(1.0 - {radius})) * cos(2.0 * pi() * {angle}))"


INJECT = (
    "with "
    + EVENTS
    + f""",
x as (select stream, event_id, ts, value, row_number() over (partition by stream order by ts, event_id) - 1 as idx,
      count(*) over (partition by stream) as n from ev),
pool as (select *, {draw("'43'", "'pick'", "stream", "idx::varchar")} as pick from x
  where idx >= greatest(10, floor(n * 0.1::double))
    and idx < greatest(greatest(10, floor(n * 0.1::double)) + 1, floor(n * 0.9::double))),
chosen as (select stream, idx from (select *, row_number() over (partition by stream order by pick, idx) as r
      from pool) z where r <= 50),
"""
)


def inject_sql(kind: str, columns: str = "", digits: str = ", 6") -> str:
    """Events with injected anomalies; ``kind`` is an SQL expression over stream and idx."""
    ids = ["stream", "idx::varchar"]
    sign = f"(case when {draw(chr(39) + '43' + chr(39), chr(39) + 'sign' + chr(39), *ids)} < 0.5 then -1.0 else 1.0 end)"
    up = {
        name: draw("'43'", f"'{name}'", "x.stream", "x.idx::varchar")
        for name in ("point", "contextual")
    }
    sign = sign.replace("stream, idx", "x.stream, x.idx")
    return (
        INJECT
        + f"""
kinds as (select stream, idx, {kind} as kind from chosen),
ctx as (select k.stream, k.idx, avg(y.value) as context from kinds k
   join x y on y.stream = k.stream and y.idx between k.idx - 5 and k.idx - 1
   where k.kind = 'contextual' group by 1, 2),
drift as (select stream, idx + off as idx, sum((5.0 + 5.0 * {draw("'43'", "'drift'", "stream", "idx::varchar")})
   * exp(-0.3::double * off)) as shift
   from (select stream, idx, unnest([0, 1, 2, 3, 4]) as off from kinds where kind = 'drift') z group by 1, 2)
select x.event_id, {"round" if digits else ""}((case when kind = 'point' then value + {sign} * (20.0 + 20.0 * {up["point"]})
     when kind = 'contextual' then coalesce(context, value) + (8.0 + 7.0 * {up["contextual"]})
     else value end) + case when kind = 'contextual' then 0.0 else coalesce(shift, 0.0) end{digits}) as value,
   kind is not null or shift is not null as label {columns}
from x left join kinds using (stream, idx) left join ctx using (stream, idx) left join drift using (stream, idx)
"""
    )


def ranked_draws(purpose: str) -> str:
    """``x``: events with ``idx`` and their rank ``r`` by the draw for this purpose, per stream."""
    return f"""with o as (select event_type as stream, event_id,
        row_number() over (partition by event_type order by ts, event_id) - 1 as idx from events),
      x as (select *, row_number() over (partition by stream
        order by {draw("'42'", f"'{purpose}'", "stream", "idx::varchar")}, idx) as r from o)
"""


def fixed(number: str, digits: int) -> str:
    """A number as text with so many decimals, halves away from zero."""
    return f"cast(cast(cast({number} as varchar) as decimal(38, 20)) as decimal(38, {digits}))::varchar"


def mad_texts(column: str, tag: str) -> str:
    """Summary and rules of a median detector over ``column`` as a list."""
    z, limit = fixed(f"z_{tag}", 2), fixed(f"thr_{tag}", 2)
    value, median = fixed(column, 2), fixed(f"m_{tag}", 2)
    return f"""[{value} || ' lies ' || case when {column} >= m_{tag} then 'above' else 'below' end || ' the usual '
        || {median} || ': robust z-score ' || {z} || ', allowed are ' || {limit} || '.',
      'The fit window has the median ' || {median},
      'Half of its values lie within ' || {fixed(f"d_{tag}", 4)} || ' of it',
      'At ' || {value} || ', {column} is ' || {z} || ' times 1.4826 such distances away',
      'A z-score of ' || {z} || case when z_{tag} > thr_{tag} then ' is over' else ' is within' end
        || ' the limit of ' || {limit}]"""


LABELLED_SERIES = """
with w as (select min(ts) as first from events where event_type = 'error' group by date_trunc('day', ts)),
l as (select event_id, ts as observed_at, value,
        exists (select 1 from w where ts between first and first + interval 1 hour)::int as label from events)
"""

EVENT_FOREST = EVENT_FIT + "," + scored_ctes("f", "stream", "event_id", ["value", "k"])

# Both neutral values of a flagged event, and the scores with one feature set to its own.
ATTRIBUTION = (
    EVENT_FOREST
    + """,
middle as (
  select stream, (max(case when rv = (kk - 1) // 2 then value end) + max(case when rv = kk // 2 then value end)) / 2 as value,
    (max(case when rk = (kk - 1) // 2 then k end) + max(case when rk = kk // 2 then k end)) / 2 as k
  from (select *, row_number() over (partition by stream order by value) - 1 as rv,
          row_number() over (partition by stream order by k) - 1 as rk from f where i < kk) z group by stream),
without as (
  select a.s, a.event_id::varchar || ':value' as id, [m.value, a.k] as p from forest a join middle m using (stream) where fflag
  union all
  select a.s, a.event_id::varchar || ':k', [a.value, m.k] from forest a join middle m using (stream) where fflag),"""
    + walk_ctes("without", "changed")
    + """
select a.stream, a.event_id, round(v.sample - a.sample, 4) + 0.0 as value, round(c.sample - a.sample, 4) + 0.0 as k
from forest a join changed v on v.s = a.s and v.id = a.event_id::varchar || ':value'
join changed c on c.s = a.s and c.id = a.event_id::varchar || ':k'"""
)

STORED = f"""
stored as (select *, sha256(stream) as sid, sha256(concat_ws('|', sha256(stream), epoch_us(ts)::varchar,
    '{{"k":' || k::varchar || ',"value":' || value::varchar || '}}')) as fp from ev)
"""
DETECTED = (
    "with " + EVENTS + "," + STORED + "," + fit_ctes("stored", "sid", "ts, fp") + "," + mad_ctes("v", "value", "sid")
    + "," + scored_ctes("s_v", "sid", "fp", ["value"]) + "," + forest_ensemble_ctes("forest", "sid")
)

INJECTED = (
    "with injected as ("
    + inject_sql("'point'", ", x.stream, x.ts", "")
    + "),"
    + fit_ctes("injected", "stream", "ts, event_id")
    + ","
    + mad_ctes("v", "value", "stream")
    + ","
    + scored_ctes("s_v", "stream", "event_id", ["value"])
    + ","
    + forest_ensemble_ctes("forest", "stream")
    + f""",
flags as (select stream, label, unnest(['mad', 'isolation_forest', 'ensemble']) as detector,
    unnest([z > thr, fflag, flag]) as flag from fused),
counted as (select stream, detector, count(*) as n, {QUALITY} from flags group by 1, 2),
rated as (select stream, detector, n, {RATED} from counted)
select stream, detector, true_positives, false_positives, false_negatives, round("precision", 4) as "precision",
  round(recall, 4) as recall, round(f1, 4) as f1,
  round(false_positives / (n * 60.0::double / 3600.0::double), 4) as false_positives_per_hour from rated"""
)

RUNS = """
with ev as (
  select o_orderkey::varchar as run_id, o_custkey::varchar as stream_id,
    case when o_orderkey % 3 = 0 then 'detection' else 'ingestion' end as run_type,
    o_orderdate as started_at,
    case when o_orderstatus = 'O' then null else o_orderdate + interval 1 day end as finished_at,
    case o_orderstatus when 'O' then 'running' when 'F' then 'completed' else 'failed' end as status,
    case when o_orderstatus = 'O' then 0 else floor(o_totalprice)::bigint end as row_count,
    case when o_orderstatus = 'O' then null else 2::bigint end as alerts_created,
    md5(o_orderkey::varchar) as content_hash, o_orderpriority as batch_id, o_custkey
  from orders)
"""

FINGERPRINT = "sha256(concat_ws('|', event_type, epoch_us(ts)::varchar, props))"


def digest(fingerprint: str) -> str:
    return f"""sha256(concat_ws('|', count(*)::varchar,
      sum(('0x' || substr({fingerprint}, 1, 15))::bigint)::varchar,
      bit_xor(('0x' || substr({fingerprint}, 16, 15))::bigint)::varchar))"""


HOURLY = """
with h as (select event_type as stream_id, date_trunc('hour', ts) as hour, floor(value)::bigint::varchar as payload, ts,
   sha256(concat_ws('|', event_type, epoch_us(date_trunc('hour', ts))::varchar, floor(value)::bigint::varchar))
     as row_fingerprint from events)
"""

_SQL = {
    "conform_events": "select event_id, ts as observed_at, value from events",
    "split_invalid_rows": """
        select event_id, event_type <> 'purchase' as accepted,
          case when event_type = 'purchase' then null else value end as value from events""",
    "csv_source": "select event_id, event_type, ts as observed_at, value from events",
    "parquet_source": """
        select event_id, event_type, null::varchar as payload_value, ts as observed_at, value from events""",
    "payload_fields": f"""
        select event_id, event_type as stream, user_id, cast(json_extract_string(props, '$.k') as double) as k,
          'events' as dataset, cast(value > 50 as int) as high, {ISO} as seen, value from events""",
    "label_windows": "with " + LABELS + "select event_id, label from lab",
    "daily_revenue_lines": """
        select date_trunc('day', l_shipdate) as observed_at, round(sum(l_quantity * l_extendedprice), 2) as value,
          count(*) as invoice_lines from lineitem group by 1""",
    "daily_quantity_lines": """
        select date_trunc('day', l_shipdate) as observed_at, sum(l_quantity) as value,
          count(*) as invoice_lines from lineitem group by 1""",
    "retail_csv": """
        select date_trunc('day', l_shipdate) as observed_at, sum(l_quantity) as value,
          count(*) as invoice_lines, 'daily_quantity' as aggregate from lineitem group by 1""",
    "sql_snapshot": """
        select date_trunc('day', o_orderdate) as observed_at, o_orderpriority as priority,
          round(sum(o_totalprice), 2) as value from orders group by 1, 2""",
    "hourly_event_count": """
        select date_trunc('hour', ts) as observed_at, cast(count(*) as double) as value from events group by 1""",
    "hourly_event_mean": """
        select date_trunc('hour', ts) as observed_at, round(avg(value), 6) as value from events group by 1""",
    "replay_values": "select event_type as stream_name, ts as observed_at, value from events",
    "json_extract_props": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "message_parse": """
        select event_id as "offset", ts as observed_at, value, event_type as source,
          cast(json_extract_string(props, '$.k') as bigint) as k, cast(user_id % 4 as int) as kafka_partition,
          event_id as kafka_offset from events""",
    "message_quarantine": """
        select event_id as "offset", case event_type
            when 'click' then 'Unsupported timestamp value'
            when 'error' then 'Missing value field in message: value'
            when 'purchase' then 'Expected JSON object in message'
            when 'signup' then 'Unsupported value' end as problem from events""",
    "message_offsets": """
        select 'observations' as topic, cast(user_id % 4 as int) as "partition", min(event_id) as first_offset,
          max(event_id) as last_offset, count(*) as messages from events group by 1, 2""",
    "messages_out": f"select {ISO} as ts, value as reading, 'events' as source from events",
    "row_fingerprints": f"select event_id, {FINGERPRINT} as row_fingerprint from events",
    "content_hash": f"""
        select event_type as stream_id, {digest("fp")} as content_hash, count(*) as records_read
        from (select event_type, {FINGERPRINT} as fp from events) z group by 1""",
    "batch_hash": f"""
        select event_type as stream_id, {digest("fp")} as content_hash, count(*) as records_read
        from (select event_type, sha256(concat_ws('|', {FINGERPRINT}, 'observations', (user_id % 4)::varchar,
              event_id::varchar)) as fp from events) z group by 1""",
    "backfill_md5": f"select event_id, md5(event_type || {ISO} || props) as row_fingerprint from events",
    "append_dedupe": HOURLY
    + """, k as (
        select stream_id, row_fingerprint, bool_or(ts < timestamp '2024-01-15 12:30:00') as early from h group by 1, 2)
        select stream_id, row_fingerprint, case when early then 'first' else 'second' end as run_id from k""",
    "duplicate_rows": HOURLY
    + "select stream_id, row_fingerprint, count(*) as copies from h group by 1, 2 having count(*) > 1",
    "runs_current": RUNS
    + """select run_id, stream_id, run_type, status, started_at, finished_at, row_count, content_hash from ev""",
    "latest_run": RUNS
    + """select stream_id, run_id, batch_id from (select *, row_number() over (partition by stream_id
          order by finished_at desc nulls last, started_at desc, run_id desc) as r from ev
          where status = 'completed') z where r = 1""",
    "runs_newest": RUNS
    + """select run_id, run_type, status, started_at, finished_at, (-1)::bigint as observations_scored,
          coalesce(alerts_created, -1) as alerts_created, row_count as records_written from ev
          where o_custkey = (select o_custkey from orders group by 1 order by count(*) desc, 1 limit 1)
          order by started_at desc, run_id limit 20""",
    "streams_current": """
        with v as (select o_custkey::varchar as stream_id, o_orderpriority as config,
            o_orderdate + to_seconds((o_orderkey % 86400)::bigint) as event_at from orders)
        select stream_id, stream_id as name, 'csv_batch' as source_type, arg_max(config, event_at) as config,
          min(event_at) as created_at, max(event_at) as updated_at from v group by 1""",
    "ingest_counts": """
        with c as (select event_type as stream_name, count(*) as n,
            count(distinct (ts, value, json_extract_string(props, '$.k'))) as d from events group by 1)
        select stream_name, n as records_read, d as records_written, n - d as records_duplicate, false as skipped from c
        union all
        select stream_name, d, 0, 0, true from c""",
    "stream_deletion": """
        with e as (select *, (select min(event_type) from events) as gone from events),
        c as (select event_type as name, count(distinct (ts, value, json_extract_string(props, '$.k'))) as observations,
            max((event_type <> gone)::int) as stays
          from e where event_type <> gone or ts >= timestamp '2024-01-15 12:30:00' group by 1)
        select name, observations, observations * stays as after_deletion from c""",
    "labelled_files": """
        select row_number() over (order by date_trunc('hour', ts), event_id) - 1 as idx,
          date_trunc('hour', ts)::timestamp as observed_at, value, event_id % 7 = 0 as label from events""",
    "labelled_series": LABELLED_SERIES + "select event_id, observed_at, value, 'events' as dataset, label from l",
    "labelled_points": LABELLED_SERIES
    + "select count(*) as stored, count(*) as points, count(*) filter (where label = 1) as labelled_points from l",
    "ingest_file": "select count(*) as observations from events",
    "fit_window": EVENT_FIT + "select event_id, i < kk as is_fit from f",
    "series_ranks": EVENT_FIT + 'select event_id, i as "rank", n from o',
    "short_series": """
        select o_custkey, count(*) as n from orders group by 1 having count(*) < 10""",
    "floor_percentile": """
        select o_orderpriority, o_totalprice as p95 from (select o_orderpriority, o_totalprice,
            row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as r,
            count(*) over (partition by o_orderpriority) as n from orders) z
        where r = cast(floor((n - 1) * cast(95.0 as double) / 100.0) as bigint)""",
    "feature_values": """
        select sha256(concat_ws('|', sha256(event_type), epoch_us(ts)::varchar, '{"k":' ||
            cast(json_extract_string(props, '$.k') as double)::varchar || ',"value":' || value::varchar || '}'))
            as row_fingerprint,
          ts as observed_at, value, cast(json_extract_string(props, '$.k') as double) as k from events""",
    "mad_params": EVENT_MAD
    + "select stream, round(med, 6) as median, round(mad, 6) as mad, round(thr, 6) as threshold from p_v",
    "mad_flags": EVENT_MAD + "select stream, event_id, round(z, 6) as score, z > thr as is_anomaly from s_v",
    "mad_by_user": "with "
    + EVENTS
    + ","
    + fit_ctes("ev", "user_id", "ts, event_id")
    + ","
    + mad_ctes("u", "value", "user_id")
    + "select user_id, event_id, round(z, 6) as score, z > thr as is_anomaly from s_u",
    "mad_lineitem": """
        with f as (select l_returnflag || '|' || l_linestatus as g, l_returnflag, l_linestatus, l_extendedprice,
            count(*) over (partition by l_returnflag, l_linestatus) as kk from lineitem),"""
    + mad_ctes("l", "l_extendedprice", "g", limit="true")
    + """select split_part(g, '|', 1) as l_returnflag, split_part(g, '|', 2) as l_linestatus,
          round(med, 6) as median, round(mad, 6) as mad, round(thr, 6) as threshold from p_l""",
    "min_max_scores": EVENT_MAD
    + """, b as (select stream, min(z) as lo, max(z) as hi from s_v where i < kk group by stream)
        select event_id, round(case when hi = lo then 0.0 else (z - lo) / (hi - lo) end, 6) as scaled
        from s_v join b on s_v.stream = b.stream""",
    "ensemble_flags": EVENT_ENSEMBLE
    + """select stream, event_id, round(combined, 6) as ensemble, round(ethr, 6) as threshold,
          flag as is_anomaly from e""",
    "scores_by_detector": EVENT_ENSEMBLE
    + """select event_id, 'mad_value' as detector, round(z_v, 6) as score, z_v > thr_v as is_anomaly from e
        union all select event_id, 'mad_k', round(z_k, 6), z_k > thr_k from e
        union all select event_id, 'ensemble', round(combined, 6), flag from e""",
    "forest_flags": EVENT_FOREST
    + "select stream, event_id, round(fscore, 6) as score, fflag as is_anomaly from forest",
    "forest_embeddings": "with emb as (select label, vec_id, embedding from embeddings),"
    + fit_ctes("emb", "label", "vec_id")
    + ","
    + scored_ctes("f", "label", "vec_id", [f"embedding[{i + 1}]" for i in range(64)])
    + "select label, vec_id, round(fscore, 6) as score, fflag as is_anomaly from forest",
    "forest_attribution": ATTRIBUTION,
    "detect_all": DETECTED
    + """select stream as stream_name, 'completed' as status, count(*) as observations_scored,
          count(*) filter (where flag) as alerts_created, round(any_value(ethr), 6) as ensemble_threshold
        from fused group by 1""",
    "benchmark_injected": INJECTED,
    "forest_score_range": """
        select event_type as stream, count(*) as n, 0.0::double as low, 1.0::double as high from events group by 1""",
    "detect_two_features": EVENT_ENSEMBLE
    + """select stream as stream_name, 'completed' as status, count(*) as observations_scored,
          count(*) filter (where flag) as alerts_created, round(any_value(ethr), 6) as ensemble_threshold
        from e group by 1""",
    "alerts_current": EVENT_MAD
    + ","
    + mad_ctes("k", "k", "stream")
    + ","
    + ensemble_ctes(97.0, "1")
    + ","
    + ensemble_ctes(95.0, "2")
    + """select e2.stream || ':' || e2.event_id as alert_id, 'run1' as run_id, round(e2.combined, 6) as score,
          case when e1.flag then timestamp '2024-01-01 00:00:00' else timestamp '2024-01-01 00:00:01' end
            as created_at, not e1.flag as inserted
        from e2 join e1 on e1.event_id = e2.event_id where e2.flag""",
    "explain_mad_values": EVENT_MAD
    + """select event_id, round(z, 4) as contribution, round(value, 6) as observed_value, round(med, 6) as median,
          round(mad, 6) as mad, round(thr, 6) as threshold, 4::int as rules,
          case when value >= med then 'above' else 'below' end as direction from s_v where z > thr""",
    "primary_signal": EVENT_ENSEMBLE
    + "select event_id, case when z_v >= z_k then 'mad_value' else 'mad_k' end as primary_detector from e where flag",
    "feature_contributions": EVENT_ENSEMBLE
    + """select event_id, round(0.0 + round(z_v, 4) * 0.6::double, 4) as share_value,
          round(0.0 + round(z_k, 4) * 0.4::double, 4) as share_k from e where flag""",
    "alert_explanations": EVENT_ENSEMBLE
    + f"""select event_id::varchar as alert_id, case when z_v >= z_k then 'mad_value' else 'mad_k' end
            as primary_detector, round(combined, 4) as ensemble_score, round(ethr, 4) as ensemble_threshold, value,
          {ISO} as observed_at, round(z_k, 4) as score_k, 9::int as rules, 2::int as detectors from e where flag""",
    "streams_with_alerts": EVENT_ENSEMBLE
    + "select stream as name, count(*) filter (where flag) as alert_count from e group by 1",
    "alerts_newest": EVENT_ENSEMBLE
    + f"""select event_id::varchar as alert_id, {ISO} as observed_at, round(combined, 6) as score from e
        where flag and stream = 'error' order by ts desc, event_id::varchar limit 20""",
    "alert_details": EVENT_ENSEMBLE
    + f"""select event_id::varchar as alert_id, stream as stream_name, round(combined, 6) as score, value,
          {ISO} as observed_at, round(combined, 4) as ensemble_score, round(ethr, 4) as ensemble_threshold
        from e where flag""",
    "notifications": EVENT_ENSEMBLE
    + f"""select event_id::varchar as alert_id, stream, value, 'ensemble' as detector, {ISO} as observed_at
        from e where flag""",
    "alert_texts": EVENT_ENSEMBLE
    + f""", x as (select e.*, s.med as m_v, s.mad as d_v, t.med as m_k, t.mad as d_k
          from e join p_v s using (stream) join p_k t using (stream) where flag),
        y as (select *, {mad_texts("value", "v")} as texts_v, {mad_texts("k", "k")} as texts_k from x),
        z as (select *, 'Together the detectors score ' || {fixed("combined", 3)} || ' where ' || {fixed("ethr", 3)}
            || ' is allowed. First of all: ' || case when z_v >= z_k then texts_v[1] else texts_k[1] end as summary from y)
        select event_id::varchar as alert_id, summary,
          'The combined score ' || {fixed("combined", 3)} || ' is over the limit of ' || {fixed("ethr", 3)} || chr(10)
            || array_to_string(texts_v[2:] || texts_k[2:], chr(10)) as rules,
          ':rotating_light: *Anomaly alert* — `' || stream || '`' || chr(10) || '*Score*: `' || {{score}}
            || '` at `' || {ISO} || '`' || chr(10) || summary as text from z""".replace("{score}", "combined::varchar"),
    "alerts_per_run": EVENT_ENSEMBLE
    + "select stream as run_id, count(*) filter (where flag) as alerts from e group by 1",
    "observation_counts": "select event_type as stream_id, count(*) as observations from events group by 1",
    "flag_quality": EVENT_MAD
    + ","
    + LABELS
    + f""", r as (select s.stream, label = 1 as label, z > thr as flag from s_v s join lab l on s.event_id = l.event_id),
        c as (select stream, {QUALITY} from r group by 1)
        select stream, {RATED}, round(fp / 720.0::double, 6) as per_hour from c""",
    "flag_sets": EVENT_MAD
    + ","
    + LABELS
    + f""", r as (select label = 1 as label, z > thr as flag from s_v s join lab l on s.event_id = l.event_id),
        c as (select {QUALITY} from r)
        select tp as true_positives, fp as false_positives, fn as false_negatives from c""",
    "label_quality": "with d as (select doc_id, lang, cast(n_chars as double) as n_chars from documents),"
    + fit_ctes("d", "lang", "doc_id")
    + ","
    + mad_ctes("d", "n_chars", "lang")
    + f""", r as (select toxic = 1 as label, z > thr as flag from s_d s join labels l on s.doc_id = l.doc_id),
        c as (select {QUALITY} from r) select {RATED} from c""",
    "baseline_values": "with "
    + EVENTS
    + f""", x as (select stream, event_id,
          row_number() over (partition by stream order by ts, event_id) - 1 as idx from ev)
        select event_id,
          round(20.0 + sin(idx / 25.0) + {normal("'42'", "stream", "idx::varchar")} * 0.5, 6) as baseline,
          round(20.0 + (idx % 50) * 0.1::double + {normal("'42'", "stream", "idx::varchar")} * 0.2::double, 6) as sample
        from x""",
    "sample_spikes": ranked_draws("spike")
    + f"""select event_id, timestamp '2024-01-01 00:00:00' + to_seconds(idx * 60) as observed_at, r <= 20 as spike,
          round(20.0 + (idx % 50) * 0.1::double + {normal("'42'", "stream", "idx::varchar")} * 0.2::double
            + case when r <= 20 then 30.0 + 20.0 * {draw("'42'", "'height'", "stream", "idx::varchar")} else 0.0 end, 6)
            as value from x""",
    "labelled_sample": ranked_draws("label")
    + f"""select event_id, r <= 30 as label,
          round(20.0 + {normal("'42'", "stream", "idx::varchar")} * 0.5 + case when r > 30 then 0.0
            when {draw("'42'", "'sign'", "stream", "idx::varchar")} < 0.5
            then -(20.0 + 20.0 * {draw("'42'", "'point'", "stream", "idx::varchar")})
            else 20.0 + 20.0 * {draw("'42'", "'point'", "stream", "idx::varchar")} end, 6) as value from x""",
    "injection_places": INJECT + "done as (select 1) select stream, idx from chosen",
    "inject_point": inject_sql("'point'"),
    "inject_contextual": inject_sql("'contextual'"),
    "inject_drift": inject_sql("'drift'"),
    "inject_mixed": inject_sql(
        "list_element(['point', 'contextual', 'drift'], "
        f"(floor({draw(chr(39) + '43' + chr(39), chr(39) + 'kind' + chr(39), 'stream', 'idx::varchar')} * 3) + 1)::int)",
        ", kind",
    ),
    "retail_sample_daily": """
        with d as (select distinct date_diff('day', date '1992-01-01', l_shipdate::date) as day from lineitem),
        l as (select day, unnest(range(0, 20 + (day % 7) * 3)) as line from d),
        a as (select day, (1 + (day + line) % 5) * (case when day = 90 and line < 3 then 25 else 1 end)
            * round(2.5::double + ((day + line) % 10) * 0.35::double, 2) as amount from l)
        select timestamp '2011-01-01' + to_days(day::int) as observed_at, round(sum(amount), 4) as value,
          count(*) as invoice_lines from a group by 1""",
    "flags_by_detector": EVENT_ENSEMBLE
    + """select stream, 'mad_value' as detector, count(*) filter (where z_v > thr_v) as flagged from e group by 1
        union all select stream, 'mad_k', count(*) filter (where z_k > thr_k) from e group by 1
        union all select stream, 'ensemble', count(*) filter (where flag) from e group by 1""",
    "stream_ingest": """
        select count(*) as observations, round(sum(value), 2) as total, min(ts) as first, max(ts) as last from events""",
}


def oracle_sql() -> dict[str, str]:
    """SQL per query."""
    return _SQL | {
        "label_quality_long": _SQL["label_quality"],
        "runs_compacted": _SQL["runs_current"],
        "alerts_compacted": _SQL["alerts_current"],
    }
