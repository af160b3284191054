"""Request, batch, config and delivery tables derived from the given tables.

The given events are clean and typed; the operators here work on raw JSON, on
config tables and on logs. Each derivation is one SQL text over whole tables that
both Spark and the checking database can run; `@name[arg | arg]` marks the few
spots where the dialects differ, and `{table}` another table or derivation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

COMMON = {
    "shape": (
        "concat(substr({0},1,8),'-',substr({0},9,4),'-4',substr({0},14,3),"
        "'-a',substr({0},18,3),'-',substr({0},21,12))"
    ),
    "uuid4": (
        "concat(substr(md5({0}),1,8),'-',substr(md5({0}),9,4),'-4',substr(md5({0}),14,3),"
        "'-a',substr(md5({0}),18,3),'-',substr(md5({0}),21,12))"
    ),
    "div": "cast(floor({0} / {1}.0) as bigint)",
}
SPARK = COMMON | {
    "iso": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
    "ms": "timestamp_millis(unix_millis(cast({0} as timestamp)) + cast({1} as bigint))",
    "list": "array({0})",
    "step": "named_struct('id', {0}, 'type', {1}, 'name', {2}, 'config', {3})",
    "trigger": "named_struct('type', {0}, 'events', {1})",
    "bodies": "array_join(transform(array_sort(collect_list(struct(pos, raw))), x -> x.raw), ',')",
    "upto": "explode(sequence(1, cast({0} as int)))",
    "from0": "explode(sequence(0, {0} - 1))",
    "each": "explode(array({0}))",
    "digits": "regexp_extract({0}, '[0-9]+', 0)",
}
DUCKDB = COMMON | {
    "iso": "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')",
    "ms": "(date_trunc('millisecond', {0}) + to_milliseconds(cast({1} as bigint)))",
    "list": "list_value({0})",
    "step": "struct_pack(id := {0}, type := {1}, name := {2}, config := {3})",
    "trigger": "struct_pack(type := {0}, events := {1})",
    "bodies": "string_agg(raw, ',' order by pos)",
    "upto": "unnest(range(1, cast({0} as bigint) + 1))",
    "from0": "unnest(range(0, {0}))",
    "each": "unnest(list_value({0}))",
    "digits": "regexp_extract({0}, '[0-9]+')",
}

_MACRO = re.compile(r"@(\w+)\[([^\[\]@]*)\]")


def render(sql: str, forms: dict[str, str]) -> str:
    """Fill the dialect spots, innermost first."""
    while _MACRO.search(sql):
        sql = _MACRO.sub(lambda m: forms[m[1]].format(*(a.strip() for a in m[2].split("|"))), sql)
    return sql


# The text of one request. `event_id % 97` picks the dirty cases; all other rows are valid.
_RAW = """
case when event_id % 97 = 14 then '{"event":"app.click"'
     when event_id % 97 = 18 then '["app.click"]'
else concat('{', concat_ws(',',
    case event_id % 97 when 1 then '"event":"App.Click"' when 2 then '"event":"signup"'
        when 3 then '"event":"user.signed_up"' when 12 then concat('"event":"app.click', chr(92), 'n"')
        when 15 then '"event":"App.Old","event":"app.view"' when 19 then null
        else concat('"event":"app.', event_type, '"') end,
    case event_id % 97 when 4 then '"correlationId":"not-a-uuid"'
        else concat('"correlationId":"', @shape[hc], '"') end,
    case when event_id % 97 = 13 then '"eventId":""' when event_id % 89 = 0 then null
        else concat('"eventId":"', @shape[he], '"') end,
    case event_id % 97 when 7 then '"timestamp":"2024-02-30T00:00:00Z"'
        when 20 then '"timestamp":"20240229"' when 21 then null
        else concat('"timestamp":"', @iso[ts], '"') end,
    case when event_id % 97 = 10 then '"source":""' when event_id % 3 = 0 then '"source":"web"'
        when event_id % 3 = 1 then '"source":"mobile"' else '"source":"server"' end,
    '"version":"1.0"',
    case when event_id % 97 = 5 then null when event_id % 97 = 6 then '"userId":""'
        when event_id % 97 = 17 then '"userId":5' when event_id % 10 = 9 then null
        else concat('"userId":"user_', user_id, '"') end,
    case when event_id % 97 in (5, 6, 17) or event_id % 10 <> 9 then null
        else concat('"anonymousId":"anon_', user_id, '"') end,
    case when event_id % 97 = 16 then '"sessionId":null' when event_id % 4 = 0 then null
        else concat('"sessionId":"sess_', user_id, '_', @div[event_id | 500], '"') end,
    case event_id % 97 when 8 then '"properties":[1]'
        else concat('"properties":', PROPERTIES) end,
    case when event_id % 3 = 0 then concat('"context":', CONTEXT) else null end,
    case event_id % 97 when 9 then '"foo":1' else null end
), '}') end
"""
_PROPERTIES = (
    "concat('{\"k\":', @digits[props], ',\"total\":', cast(round(value * 100) as bigint), '}')"
)
_CONTEXT = (
    "concat('{\"app\":{\"name\":\"shop\",\"version\":\"1.', event_id % 7, '\"},\"campaign\":"
    "{\"medium\":\"cpc\",\"name\":\"c', event_id % 11, '\",\"source\":\"s', event_id % 5,"
    " '\"},\"locale\":\"en\"}')"
)
# The events with the digests behind their ids, each computed once per row.
_HASHED = """(select *, md5(concat('c', @div[event_id | 10])) as hc, md5(cast(ID_SEED as string)) as he,
    md5(concat('row', event_id)) as hr from {events})"""
_RAW = _RAW.replace("PROPERTIES", _PROPERTIES).replace("CONTEXT", _CONTEXT)

DERIVED = {
    # One request per event.
    "raw_events": """
        select concat('req_', event_id) as batch_id, 0 as pos, cast(0 as bigint) as arrival_seq,
            case when event_id % 97 = 11 then null else concat('ws_', @div[user_id | 3]) end as workspace_id,
            @ms[ts | 0] as arrived_at, """ + _RAW + """ as raw
        from """ + _HASHED.replace("ID_SEED", "event_id"),
    # The same requests with replays 1 h, 24 h and 23 h 59 min later.
    "raw_arrivals": """
        select concat(batch_id, '_', n) as batch_id, pos, cast(n as bigint) as arrival_seq, workspace_id,
            @ms[arrived_at | case n when 0 then 0 when 1 then 3600000 when 2 then 86400000 else 86340000 end] as arrived_at,
            raw
        from (select *, @from0[4] as n from (
            select *, cast(replace(batch_id, 'req_', '') as bigint) as seed from {raw_events}))
        where n = 0 or (n = 1 and seed % 7 = 0) or (n = 2 and seed % 13 = 0) or (n = 3 and seed % 91 = 0)
    """,
    "arrivals": """
        select event_id, workspace_id, cast(n as bigint) as arrival_seq,
            @ms[ts | case n when 0 then 0 when 1 then 3600000 when 2 then 86400000 else 86340000 end] as arrived_at
        from (select @shape[he] as event_id, event_id as seed, ts,
                concat('ws_', @div[user_id | 3]) as workspace_id, @from0[4] as n from """ + _HASHED.replace("ID_SEED", "event_id") + """)
        where n = 0 or (n = 1 and seed % 7 = 0) or (n = 2 and seed % 13 = 0) or (n = 3 and seed % 91 = 0)
    """,
    # Events of a batch call: per 200 events one batch of 101 and eleven of nine.
    "batch_items": """
        select concat('b_', @div[event_id | 200], '_',
                case when event_id % 200 < 101 then 'big' else cast(@div[(event_id % 200 - 101) | 9] as string) end) as batch_id,
            cast(case when event_id % 200 < 101 then event_id % 200 else (event_id % 200 - 101) % 9 end as int) as pos,
            concat('ws_', @div[event_id | 200]) as workspace_id, ts, event_id, """
    + _RAW + """ as raw
        from """ + _HASHED.replace("ID_SEED", "(event_id - case when event_id % 15 = 8 then 1 else 0 end)"),
    # Clean events of each 200 in the order of their ids, as a body of 100 and one of 101.
    "full_items": """
        select concat('b_', block, '_', size) as batch_id, cast(nr as int) as pos, concat('ws_', block) as workspace_id, ts, event_id, raw
        from (select *, @each['100', '101'] as size from (
            select *, @div[event_id | 200] as block, row_number() over (partition by @div[event_id | 200] order by event_id) - 1 as nr
            from {clean_items}))
        where nr < cast(size as int)
    """,
    "clean_items": """
        select event_id, ts, """ + _RAW + """ as raw
        from """ + _HASHED.replace("ID_SEED", "event_id") + """ where event_id % 97 > 21
    """,
    "all_items": """
        select batch_id, pos, workspace_id, ts, event_id, raw from {batch_items}
        union all select batch_id, pos, workspace_id, ts, event_id, raw from {full_items}
    """,
    # The bodies, plus an empty one, one that is no array and one with a stray field per 200 events.
    "batch_bodies": """
        select batch_id, case when substr(batch_id, length(batch_id) - 1, 2) = '_3' then null else min(workspace_id) end as workspace_id,
            @ms[min(ts) | 0] as arrived_at, cast(0 as bigint) as arrival_seq,
            concat('{"events":[', @bodies[], ']}') as raw
        from {all_items} group by batch_id
        union all
        select concat('b_', block, '_', k), concat('ws_', block), started, cast(0 as bigint),
            case k when 'empty' then '{"events":[]}' when 'scalar' then '{"events":5}'
                else '{"extra":1,"events":[]}' end
        from (select block, started, @each['empty', 'scalar', 'stray'] as k from (
            select @div[event_id | 200] as block, @ms[min(ts) | 0] as started from {events} group by 1))
    """,
    # Stored rows, typed straight from the events.
    "stored": """
        select @shape[hr] as id, concat('ws_', @div[user_id | 3]) as workspace_id,
            @shape[he] as event_id, @shape[hc] as correlation_id,
            concat('app.', event_type) as event_name,
            case event_id % 3 when 0 then 'web' when 1 then 'mobile' else 'server' end as source, '1.0' as version,
            case when event_id % 10 = 9 then null else concat('user_', user_id) end as user_id,
            case when event_id % 10 = 9 then concat('anon_', user_id) else null end as anonymous_id,
            case when event_id % 4 = 0 then null
                else concat('sess_', user_id, '_', @div[event_id | 500]) end as session_id,
            """ + _PROPERTIES + """ as properties,
            case when event_id % 3 = 0 then """ + _CONTEXT + """ else '{}' end as context,
            @ms[ts | 0] as received_at, @ms[ts | event_id % 5000] as ingested_at, @iso[ts] as received_text
        from """ + _HASHED.replace("ID_SEED", "event_id"),
    # Three pipelines per workspace, one customer each.
    "pipelines": """
        select @uuid4[concat('p', c)] as id, concat('ws_', @div[c | 3]) as workspace_id,
            concat('Flow ', c_name) as name, case when c % 4 = 0 then null else c_mktsegment end as description,
            @trigger['event' | case c % 6 when 0 then E1 when 1 then E2 when 2 then E3 when 3 then E4
                when 4 then E5 else E6 end] as trigger,
            case when c % 17 = 0 then STEPS_SHORT else STEPS_LONG end as steps,
            c % 5 <> 0 as enabled,
            @ms[timestamp '2024-01-01 00:00:00' | c * 60000] as created_at,
            @ms[timestamp '2024-01-01 00:00:00' | c * 90000] as updated_at
        from (select c_custkey as c, * from {customer})
    """,
    # One destination per customer, credentials in plain text.
    "destinations": """
        select @uuid4[concat('d', c_custkey)] as id, concat('ws_', @div[c_custkey | 3]) as workspace_id,
            concat('Sink ', c_name) as name,
            case c_custkey % 8 when 0 then 'postgres' when 1 then 'mysql' when 2 then 'slack' when 3 then 'discord'
                when 4 then 'webhook' when 5 then 's3' when 6 then 'email' else 'elasticsearch' end as type,
            concat('{"token":"t', c_custkey, '","url":"https://example.org/', c_custkey, '"}') as config,
            @ms[timestamp '2024-01-01 00:00:00' | c_custkey * 60000] as created_at,
            @ms[timestamp '2024-01-01 00:00:00' | c_custkey * 90000] as updated_at
        from {customer}
    """,
    # Submitted pipeline definitions, `c_custkey % 31` picks the broken ones.
    "pipeline_requests": """
        select concat('preq_', c) as request_id, concat('ws_', @div[c | 3]) as workspace_id,
            concat('{', concat_ws(',',
                case c % 31 when 1 then '"name":7' when 2 then null else concat('"name":"Flow ', c, '"') end,
                case c % 31 when 3 then '"description":3' when 4 then '"description":null' else '"description":"d"' end,
                case c % 31 when 5 then null when 6 then '"trigger":{"type":"cron","events":["app.view"]}'
                    when 7 then '"trigger":{"type":"event","events":[]}' when 8 then '"trigger":{"type":"event","events":[1]}'
                    when 9 then '"trigger":{"type":"event","events":"app.view"}'
                    else '"trigger":{"type":"event","events":["app.view"]}' end,
                case c % 31 when 10 then null when 11 then '"steps":{}' when 12 then '"steps":[]'
                    else concat('"steps":[{"id":"', case when c % 31 = 13 then 'x' else @uuid4[concat('s', c)] end,
                        '","type":"', case when c % 31 = 14 then 'loop' else 'filter' end, '","name":',
                        case when c % 31 = 15 then '1' else '"n"' end, ',"config":',
                        case when c % 31 = 16 then '[]' else '{}' end, '}]') end,
                case c % 31 when 17 then '"enabled":"yes"' when 18 then '"enabled":false' when 19 then '"enabled":null'
                    else null end,
                case c % 31 when 20 then '"owner":1' else null end
            ), '}') as raw
        from (select c_custkey as c from {customer})
    """,
    "destination_requests": """
        select concat('dreq_', c) as request_id, concat('ws_', @div[c | 3]) as workspace_id,
            concat('{', concat_ws(',',
                case c % 13 when 1 then null when 2 then '"name":1' else concat('"name":"Sink ', c, '"') end,
                case c % 13 when 3 then null when 4 then '"type":"ftp"' else '"type":"slack"' end,
                case c % 13 when 5 then null when 6 then '"config":[]' when 7 then '"config":"x"'
                    else concat('"config":{"token":"t', c, '"}') end,
                case c % 13 when 8 then '"iv":"00"' else null end
            ), '}') as raw
        from (select c_custkey as c from {customer})
    """,
    # Changes to pipelines from the orders: updates, deletes, re-creations, unknown ids, null names.
    "patches": """
        select @uuid4[concat(case when o % 23 = 0 then 'unknown' else 'p' end, c)] as id,
            concat('ws_', @div[c | 3]) as workspace_id, o as version,
            case when o % 11 = 5 then 'delete' when o % 11 = 6 then 'create' else 'update' end as op,
            @ms[timestamp '2024-03-01 00:00:00' | o * 1000] as changed_at,
            case when o % 11 = 5 then '{}'
                when o % 11 = 6 then concat('{"name":"new ', o, '","trigger":{"events":["app.view"],"type":"event"},"steps":[]}')
                when o % 7 = 0 then '{"description":null}'
                when o % 7 = 1 then '{"name":null}'
                when o % 7 = 2 then concat('{"name":"n', o, '"}')
                when o % 7 = 3 then '{"enabled":false}'
                when o % 7 = 4 then concat('{"description":"d', o, '","enabled":true}')
                when o % 91 = 5 then '{"enabled":"maybe"}' when o % 91 = 12 then '{"name":5}'
                when o % 91 = 19 then '{"steps":{}}' when o % 91 = 26 then '{"trigger":"x"}'
                when o % 91 = 33 then '{"owner":1}' when o % 91 = 40 then '{"description":7}'
                when o % 91 = 47 then '{"steps":[{"id":"x","type":"filter","name":"n","config":{}}]}'
                else '{"steps":[]}' end as patch
        from (select o_orderkey as o, o_custkey as c from {orders})
    """,
    # Changes of destinations: as patches, with new credentials and broken ones.
    "destination_patches": """
        select @uuid4[concat(case when o % 23 = 0 then 'unknown' else 'd' end, c)] as id,
            concat('ws_', @div[c | 3]) as workspace_id, o as version,
            case when o % 11 = 5 then 'delete' when o % 11 = 6 then 'create' else 'update' end as op,
            @ms[timestamp '2024-03-01 00:00:00' | o * 1000] as changed_at,
            case when o % 11 = 5 then '{}'
                when o % 11 = 6 then concat('{"name":"new ', o, '","type":"slack","config":{"token":"n', o, '"}}')
                when o % 7 = 0 then concat('{"config":{"token":"t', o, '"}}')
                when o % 7 = 1 then '{"config":null}'
                when o % 7 = 2 then concat('{"name":"n', o, '"}')
                when o % 7 = 3 then '{"type":"email"}'
                when o % 7 = 4 then '{"type":"fax"}'
                when o % 7 = 5 then '{"config":"x"}'
                else concat('{"owner":', o, '}') end as patch
        from (select o_orderkey as o, o_custkey as c from {orders})
    """,
    # Each event goes to one destination, in 1 to 4 attempts spaced by the backoff; some dead ones
    # are replayed a day later, from attempt 1.
    "attempts": """
        select @uuid4[concat('a', seed, '_', n)] as id, event_id, destination_id, status, attempt_number, error, attempted_at
        from {first_attempts}
        union all
        select @uuid4[concat('replay', seed)] as id, event_id, destination_id, 'delivered' as status, cast(1 as int) as attempt_number,
            cast(null as string) as error, @ms[attempted_at | 86400000] as attempted_at
        from {first_attempts} where status = 'dead_lettered' and seed % 22 = 0
    """,
    "first_attempts": """
        select seed, n, @uuid4[concat('a', seed, '_', n)] as id, event_id, destination_id,
            case when n < tries then 'failed' when seed % 11 = 0 then 'dead_lettered'
                when seed % 19 = 0 then 'pending' else 'delivered' end as status,
            cast(n as int) as attempt_number,
            case when n < tries or seed % 11 = 0 then 'timeout' else null end as error,
            @ms[ts | 1000 * (power(2, n - 1) - 1)] as attempted_at
        from (select event_id as seed, @uuid4[cast(event_id as string)] as event_id, ts,
                @uuid4[concat('d', user_id)] as destination_id,
                1 + event_id % 4 as tries, @upto[1 + event_id % 4] as n from {events})
    """,
    # When each message was put on a queue and taken off it.
    "queue_log": """
        select case event_id % 3 when 0 then 'ingestion.events' when 1 then 'pipeline.events' else 'delivery.events' end as queue,
            @uuid4[concat('m', event_id)] as message_id, @uuid4[cast(event_id as string)] as event_id,
            concat('{"n":', event_id, '}') as value, @ms[ts | 0] as published_at,
            case when event_id % 17 = 0 then null else @ms[ts | event_id % 30 * 3600000] end as consumed_at
        from {events}
    """,
    # Published messages with varied routing keys.
    "messages": """
        select @uuid4[concat('m', event_id)] as message_id,
            case event_id % 7 when 0 then 'event.ingested' when 1 then 'event' when 2 then 'event.a.b'
                when 3 then concat('order.', event_type, '.created') when 4 then 'dead.ingestion.events'
                when 5 then concat('order.', event_type) else concat('metric.u', user_id) end as routing_key
        from {events}
    """,
    # Identify calls: one per order, two or more versions of the traits per user.
    "identifies": """
        select concat('user_', o_custkey) as user_id, @ms[timestamp '2024-01-01 00:00:00' | o_orderkey * 1000] as seen_at,
            @uuid4[concat('i', o_orderkey)] as id,
            concat('{', concat_ws(',', case when o_orderkey % 3 = 0 then null else concat('"plan":"p', o_orderkey % 5, '"') end,
                concat('"spend":', cast(round(o_totalprice) as bigint)),
                case when o_orderkey % 4 = 0 then concat('"status":"', o_orderstatus, '"') else null end), '}') as traits
        from {orders}
    """,
    "groups": """
        select concat('user_', o_custkey) as user_id, concat('group_', o_custkey % 40 + o_orderkey % 3) as group_id,
            @ms[timestamp '2024-01-01 00:00:00' | o_orderkey * 1000] as seen_at, @uuid4[concat('g', o_orderkey)] as id,
            concat('{', concat_ws(',', concat('"seats":', o_orderkey % 9),
                case when o_orderkey % 2 = 0 then concat('"tier":"t', o_orderkey % 4, '"') else null end), '}') as traits
        from {orders}
    """,
    "profiles": """
        select concat('user_', c_custkey) as user_id, c_mktsegment as segment, n_name as nation, r_name as region
        from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
    """,
    # One alert rule per customer, for the customer's workspace.
    "rules": """
        select concat('rule_', c) as rule_id, concat('ws_', @div[c | 3]) as workspace_id,
            case c % 3 when 0 then 'app.error' when 1 then 'app.purchase' else null end as event_name,
            case when c % 2 = 0 then 'count' else 'total' end as metric,
            case c % 4 when 0 then 3600 when 1 then 21600 else 86400 end as window_seconds,
            case c % 5 when 0 then 'gt' when 1 then 'gte' when 2 then 'gt' when 3 then 'gte' else 'lt' end as op,
            cast(case when c % 2 = 0 then 1 + c % 3 else 2000 + c % 9 * 500 end as double) as threshold,
            cast(case when c % 7 < 4 then 172800 else 0 end as bigint) as cooldown_seconds
        from (select c_custkey as c from {customer})
    """,
    # Bindings of queues to patterns: the shared ones and one per customer's own metric.
    "bindings": """
        select distinct substr(b, 1, instr(b, '=') - 1) as queue, substr(b, instr(b, '=') + 1) as pattern
        from (select @each['ingestion.events=event.#', 'audit.events=event.*', 'dead_letter.queue=dead.#',
                'exact.events=event.ingested', 'order.events=order.*.created', 'all.events=#',
                'created.events=#.created', concat('user.', c_custkey, '=metric.u', c_custkey)] as b
            from {customer})
    """,
    # Monthly allowance of each workspace.
    "quotas": """
        select concat('ws_', @div[c_custkey | 3]) as workspace_id, cast(sum(50 + c_custkey % 20) as bigint) as quota
        from {customer} group by 1
    """,
}

# Event lists and steps of the pipelines; `<<` and `>>` stand for JSON brackets.
_PARTS = {
    "E1": "@list['app.purchase']",
    "E2": "@list['app.signup', 'app.click']",
    "E3": "@list['app.never']",
    "E4": "@list['app.view', 'app.view']",
    "E5": "@list['app.error', 'app.purchase']",
    "E6": "@list['app.click']",
    "STEPS_SHORT": "@list[FILTER, DELIVER]",
    "STEPS_LONG": "@list[FILTER, TRANSFORM, ENRICH, DELIVER]",
    "FILTER": """@step[@uuid4[concat('s1', c)] | 'filter' | 'only some' | case c % 4
        when 0 then '{"minTotal":1000}'
        when 1 then '{"clauses":<<{"field":"properties.k","op":"gt","value":"30"},{"field":"source","op":"ne","value":"server"}>>}'
        when 2 then '{"clauses":<<{"field":"context.app.name","op":"eq","value":"shop"}>>}'
        else concat('{"clauses":<<{"field":"event","op":"regex","value":"', case when c % 44 = 3 then '(' else '^app' end,
            '"},{"field":"userId","op":"exists"}>>}') end]""",
    "TRANSFORM": """@step[@uuid4[concat('s2', c)] | 'transform' | 'reshape' | case c % 3
        when 0 then '{"rename":{"k":"key"},"set":{"flag":true}}'
        when 1 then '{"remove":<<"k">>}'
        else '{"set":{"total":0}}' end]""",
    "ENRICH": """@step[@uuid4[concat('s3', c)] | 'enrich' | 'profile' |
        '{"on":"userId","prefix":"customer_","select":<<"nation","segment">>,"table":"profiles"}']""",
    "DELIVER": """@step[@uuid4[concat('s4', c)] | 'destination' | 'send' |
        concat('{"destinationId":"', @uuid4[concat(case when c % 13 = 0 then 'none' else 'd' end, c)], '"}')]""",
}
for _name, _text in _PARTS.items():
    DERIVED["pipelines"] = DERIVED["pipelines"].replace(_name, _text)

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_NAME = re.compile(r"\{(" + "|".join((*TABLES, *DERIVED)) + r")\}")


def derivation(name: str, forms: dict[str, str], base: str) -> str:
    """Full SQL of a derivation; `base` is the pattern of a given table's name."""

    def fill(match: re.Match) -> str:
        inner = match[1]
        return f"({expand(inner)})" if inner in DERIVED else base.format(inner)

    def expand(which: str) -> str:
        return _NAME.sub(fill, render(DERIVED[which], forms).replace("<<", "[").replace(">>", "]"))

    return expand(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the parquet files in `sf_dir`."""
    return spark.sql(derivation(name, SPARK, "parquet.`" + sf_dir + "/{0}.parquet`"))


def duckdb_sql(name: str) -> str:
    """The same derived table for the checking database."""
    return derivation(name, DUCKDB, "{0}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
