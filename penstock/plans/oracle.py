"""SQL checks of the registered queries, for DuckDB on the same tables.

The derived inputs are shared (`fixtures.duckdb_sql`); everything the operators do
is written again here in plain SQL.
"""

from __future__ import annotations

from penstock.plans.fixtures import duckdb_sql

UUID4 = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
FIELDS = (
    "event", "correlationId", "eventId", "timestamp", "source", "version",
    "userId", "anonymousId", "sessionId", "properties", "context",
)


def d(name: str) -> str:
    return f"({duckdb_sql(name)})"


def content_id(*parts: str) -> str:
    digest = "sha256(concat_ws('|', " + ", ".join(f"coalesce(cast({p} as varchar), '')" for p in parts) + "))"
    return (
        f"(select substr(h,1,8)||'-'||substr(h,9,4)||'-4'||substr(h,14,3)||'-a'||substr(h,18,3)||'-'||substr(h,21,12)"
        f" from (select {digest} as h))"
    )


# --- requests: parse and validate ---------------------------------------------------------


# The one key that some requests repeat, without its first value: the last one counts.
LAST = """replace(raw, '"event":"App.Old",', '')"""


def parsed(source: str) -> str:
    """Adds j (the JSON object or NULL), k_* (JSON types) and t_* (texts)."""
    kinds = ", ".join(f"json_type(j, '$.{f}') as k_{f}" for f in FIELDS)
    texts = ", ".join(f"j->>'$.{f}' as t_{f}" for f in FIELDS)
    return f"""(select *, {kinds}, {texts} from (
        select *, case when json_valid(raw) then case when json_type(raw) = 'OBJECT' then cast({LAST} as json) end end as j
        from {source}))"""


def missing(f: str) -> str:
    return f"coalesce(k_{f}, 'NULL') = 'NULL'"


def string(f: str) -> str:
    return f"coalesce(k_{f}, '') = 'VARCHAR'"


def filled(f: str) -> str:
    return f"not ({missing(f)}) and not ({string(f)} and t_{f} = '')"


def uuid(f: str) -> str:
    return f"({string(f)} and regexp_matches(t_{f}, '{UUID4}'))"


STAMP_OK = (
    "(" + string("timestamp") + " and regexp_matches(t_timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T')"
    " and try_cast(replace(replace(t_timestamp, 'T', ' '), 'Z', '') as timestamp) is not null)"
)
WHO = "userId or anonymousId is required"
RULES = [
    ("event", 'event must be dot notation lowercase, e.g. "order.created"',
     string("event") + " and regexp_full_match(t_event, '[a-z][a-z0-9]*([.][a-z][a-z0-9]*)+')"),
    ("event", "event should not be empty", filled("event")),
    ("event", "event must be a string", string("event")),
    ("correlationId", "correlationId must be a UUID", uuid("correlationId")),
    ("eventId", "eventId must be a UUID", f"{missing('eventId')} or {uuid('eventId')}"),
    ("timestamp", None, f"{missing('timestamp')} or {STAMP_OK}"),
    ("source", "source should not be empty", filled("source")),
    ("source", "source must be a string", string("source")),
    ("version", "version should not be empty", filled("version")),
    ("version", "version must be a string", string("version")),
    ("userId", WHO, f"({filled('anonymousId')}) or ({filled('userId')})"),
    ("userId", "userId must be a string", f"({filled('anonymousId')}) or {string('userId')}"),
    ("anonymousId", WHO, f"({filled('userId')}) or ({filled('anonymousId')})"),
    ("anonymousId", "anonymousId must be a string", f"({filled('userId')}) or {string('anonymousId')}"),
    ("sessionId", "sessionId must be a string", f"{missing('sessionId')} or {string('sessionId')}"),
    ("properties", "properties must be an object", f"{missing('properties')} or k_properties = 'OBJECT'"),
    ("context", "context must be an object", f"{missing('context')} or k_context = 'OBJECT'"),
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def validated(source: str) -> str:
    """Adds errs: LIST of (field, message)."""
    stamp = (
        "case when regexp_full_match(t_timestamp, '[0-9]{8}') then 'unsupported timestamp form'"
        " else 'timestamp must be a valid ISO 8601 date string' end"
    )
    rules = ", ".join(
        f"case when ({holds}) then null else struct_pack(field := '{f}', message := {quoted(m) if m else stamp}) end"
        for f, m, holds in RULES
    )
    known = ", ".join(f"'{f}'" for f in FIELDS)
    unknown = (
        f"list_transform(list_filter(json_keys(j), lambda k: k not in ({known})),"
        " lambda k: struct_pack(field := k, message := 'property ' || k || ' should not exist'))"
    )
    return f"""(select *, list_concat(
            case when j is null then [struct_pack(field := 'body', message := 'body must be a JSON object')]
                else list_concat(list_filter([{rules}], lambda e: e is not null), {unknown}) end,
            case when coalesce(workspace_id, '') = ''
                then [struct_pack(field := 'x-workspace-id', message := 'x-workspace-id header is required')] else [] end
        ) as errs from {parsed(source)})"""


ERRORS_TEXT = "array_to_string(list_transform(errs, lambda e: e.field || ': ' || e.message), '; ')"


def normalized(source: str) -> str:
    """Stored-row columns of valid requests; keeps batch_id, pos, arrived_at, arrival_seq."""
    request = ("batch_id", "pos", "arrival_seq", "epoch_ms(arrived_at)")
    stamp = "coalesce(t_timestamp, strftime(arrived_at, '%Y-%m-%dT%H:%M:%S.%gZ'))"
    return f"""(select {content_id("'row'", *request)} as id, workspace_id,
        coalesce(t_eventId, {content_id("'event'", *request)}) as event_id,
        t_correlationId as correlation_id, t_event as event_name, t_source as source, t_version as version,
        t_userId as user_id, t_anonymousId as anonymous_id, t_sessionId as session_id,
        case when {missing('properties')} then '{{}}' else cast(j->'$.properties' as varchar) end as properties,
        case when {missing('context')} then '{{}}' else cast(j->'$.context' as varchar) end as context,
        cast(replace(replace({stamp}, 'T', ' '), 'Z', '') as timestamp) as received_at,
        arrived_at as ingested_at, {stamp} as received_text, batch_id, pos, arrived_at, arrival_seq
    from {source})"""


def deduped(source: str, order: str = "arrived_at, arrival_seq") -> str:
    return f"""(select *, case when row_number() over w = 1 then 'accepted'
            when arrived_at < first_value(arrived_at) over w + interval 24 hour then 'duplicate' else 'conflict' end as status
        from {source} window w as (partition by event_id order by {order}))"""


VALID = f"(select * from {validated(d('raw_events'))} where len(errs) = 0)"
VALID_ARRIVALS = f"(select * from {validated(d('raw_arrivals'))} where len(errs) = 0)"

# A body is unreadable when one of its items is no JSON; items of readable bodies are validated one by one.
BODY_OK = "json_valid(raw)"
ITEMS = f"""(select i.batch_id, i.pos, b.workspace_id, b.arrived_at, b.arrival_seq, i.raw, b.batch_size from {d('all_items')} i
    join (select *, json_array_length(raw, '$.events') as batch_size from {d('batch_bodies')} where {BODY_OK}) b using (batch_id))"""
ODD_BODIES = f"""(select batch_id, cast(null as integer) as pos,
        case when {BODY_OK} and raw like '%"events":[]%' then 0 end as batch_size,
        case when {BODY_OK} and raw like '%"extra"%' then 1 else 0 end as n_unknown, workspace_id,
        case when {BODY_OK} and raw like '%"events":[]%' then 1
             when {BODY_OK} then 3 else 3 end as own_errors
    from {d('batch_bodies')} where not {BODY_OK} or raw like '%"events":[]%' or raw like '%"events":5%')"""
ADMISSION = f"""(select batch_id, pos, n_errors, max(n_errors) over (partition by batch_id) = 0 as admitted from (
    select batch_id, pos, cast(len(errs) + case when batch_size > 100 then 1 else 0 end as integer) as n_errors
    from {validated(ITEMS)}
    union all
    select batch_id, pos, cast(own_errors + n_unknown as integer) from {ODD_BODIES}))"""
ADMITTED = f"""(select * from {validated(ITEMS)} where batch_id in
    (select batch_id from {ADMISSION} where admitted))"""
BATCHED = deduped(normalized(ADMITTED), "arrived_at, arrival_seq, batch_id, pos")


# --- pipelines ----------------------------------------------------------------------------

TRIGGERS = f"""(select distinct p.id as pipeline_id, p.workspace_id, p.steps, t.event_name
    from {d('pipelines')} p, unnest(p.trigger.events) t(event_name) where p.enabled)"""
MATCHED = f"""(select s.*, t.pipeline_id, t.steps, cast(json_extract_string(s.properties, '$.k') as bigint) as k,
        cast(json_extract_string(s.properties, '$.total') as bigint) as total,
        t.steps[1].config as c1, t.steps[2].config as c2
    from {d('stored')} s join {TRIGGERS} t on s.workspace_id = t.workspace_id and s.event_name = t.event_name)"""
HOLDS = """(case when c1 like '%minTotal%' then total >= 1000
    when c1 like '%properties.k%' then k > 30 and source <> 'server'
    when c1 like '%context.app.name%' then coalesce(json_extract_string(context, '$.app.name') = 'shop', false)
    when c1 like '%"value":"("%' then false else user_id is not null end)"""
BAD = """(c1 like '%"value":"("%')"""
RESHAPED = """case when c2 like '%rename%' then 'flag,key,total' when c2 like '%remove%' then 'total' else 'k,total' end as keys,
    case when c2 like '%"set":{"total":0}%' then '0' else cast(total as varchar) end as total,
    case when c2 like '%remove%' then null else cast(k as varchar) end as k"""
SENT = f"""(select *, json_extract_string(steps[len(steps)].config, '$.destinationId') as destination_id
    from {MATCHED} where {HOLDS})"""
# The properties after the steps, keys in order.
PAYLOAD = """'{' || concat_ws(',', case when nation is not null and len(steps) = 4 then '"customer_nation":"' || nation || '","customer_segment":"' || segment || '"' end,
    case when len(steps) = 4 and c2 like '%rename%' then '"flag":true' end,
    case when len(steps) <> 4 or c2 like '%"set":{"total":0}%' then '"k":' || k when c2 like '%rename%' then '"key":' || k end,
    '"total":' || case when len(steps) = 4 and c2 like '%"set":{"total":0}%' then 0 else total end) || '}'"""
FANNED = f"""(select m.event_id, m.pipeline_id, m.destination_id, dest.type, m.ingested_at, m.workspace_id, m.event_name, {PAYLOAD} as payload
    from {SENT} m left join {d('profiles')} using (user_id) left join {d('destinations')} dest
        on dest.id = m.destination_id and dest.workspace_id = m.workspace_id)"""
EXECUTED = f"""(select m.event_id, m.pipeline_id,
        case when {BAD} or {HOLDS} and f.destination_id is not null and f.type is null then 'failed' else 'completed' end as status,
        case when {BAD} then 'bad_filter' when {HOLDS} and f.destination_id is not null and f.type is null then 'unknown_destination' end as error,
        cast(case when {HOLDS} then 1 else 0 end as integer) as n_sends,
        m.received_at, m.ingested_at
    from {MATCHED} m left join {FANNED} f on f.event_id = m.event_id and f.pipeline_id = m.pipeline_id)"""

# --- patches ------------------------------------------------------------------------------

# Replays one row's patches in version order: the state is whether the row exists.
_BROKEN = """(json_type(patch, '$.name') <> 'VARCHAR' or json_type(patch, '$.enabled') <> 'BOOLEAN' or json_type(patch, '$.steps') <> 'ARRAY'
    or json_type(patch, '$.trigger') <> 'OBJECT' or json_type(patch, '$.description') not in ('VARCHAR', 'NULL')
    or json_exists(patch, '$.owner') or json_extract_string(patch, '$.steps[0].id') = 'x')"""
PATCHED = f"""(select p.*, coalesce({_BROKEN}, false) as broken, c.id is not null as known from {d('patches')} p
    left join {d('pipelines')} c on c.id = p.id and c.workspace_id = p.workspace_id)"""
OUTCOMES = f"""(select *, case when broken then 'invalid' when op = 'create' and alive then 'exists'
        when op <> 'create' and not alive then 'not_found' else 'applied' end as outcome
    from (select *, coalesce(last_value(case when not broken and op <> 'update' then op end ignore nulls) over (
            partition by id, workspace_id order by version rows between unbounded preceding and 1 preceding) = 'create', known) as alive
        from {PATCHED}))"""
APPLIED = f"(select * from {OUTCOMES} where outcome = 'applied')"


def _field(name: str, fresh: str = "null") -> str:
    """Last value set in the row's present life, as JSON; creations set every field."""
    given = f"json_exists(patch, '$.{name}')"
    return f"arg_max(case when {given} then cast(patch->'$.{name}' as varchar) else '{fresh}' end, version) filter ({given} or op = 'create')"


PATCH_STATE = f"""(select id, workspace_id, {_field('name')} as n_name, {_field('description')} as n_desc,
        {_field('enabled', 'true')} as n_enabled, {_field('steps')} as n_steps, {_field('trigger')} as n_trigger,
        arg_max(op, version) filter (op <> 'update') as life,
        max(changed_at) filter (op = 'create') as created, arg_max(changed_at, version) as touched
    from {APPLIED} group by id, workspace_id)"""


def _text(json: str) -> str:
    return f"json_extract_string({json}, '$')"


APPLY = f"""select coalesce(c.id, n.id) as id, coalesce(c.workspace_id, n.workspace_id) as workspace_id,
        case when n_name is not null then {_text('n_name')} else c.name end as name,
        case when n_desc is not null then {_text('n_desc')} else c.description end as description,
        case when n_enabled is not null then n_enabled = 'true' else c.enabled end as enabled,
        cast(case when n_steps is not null then json_array_length(n_steps) else len(c.steps) end as integer) as n_steps,
        case when n_trigger is not null then json_extract_string(n_trigger, '$.events[0]')
            else array_to_string(c.trigger.events, ',') end as events,
        epoch_ms(case when life is not null then created else c.created_at end) as created_at_ms,
        epoch_ms(coalesce(touched, c.updated_at)) as updated_at_ms
    from {d('pipelines')} c full outer join {PATCH_STATE} n on c.id = n.id and c.workspace_id = n.workspace_id
    where coalesce(life <> 'delete', true)"""

# The same for destinations: every broken change is refused as a whole.
_CHANGED = f"""(select *, case when broken then 'invalid' when op = 'create' and alive then 'exists'
        when op <> 'create' and not alive then 'not_found' else 'applied' end as outcome
    from (select *, coalesce(last_value(case when not broken and op <> 'update' then op end ignore nulls) over (
            partition by id, workspace_id order by version rows between unbounded preceding and 1 preceding) = 'create', known) as alive
        from (select p.*, c.id is not null as known, coalesce(json_type(patch, '$.config') <> 'OBJECT' or json_extract_string(patch, '$.type') = 'fax'
                or json_exists(patch, '$.owner'), false) as broken
            from {d('destination_patches')} p left join {d('destinations')} c on c.id = p.id and c.workspace_id = p.workspace_id)))"""
_CHANGES = f"""(select id, workspace_id, {_field('name')} as n_name, {_field('type')} as n_type, {_field('config')} as n_config,
        arg_max(op, version) filter (op <> 'update') as life,
        max(changed_at) filter (op = 'create') as created, arg_max(changed_at, version) as touched
    from {_CHANGED} where outcome = 'applied' group by id, workspace_id)"""
DESTINATIONS = f"""select coalesce(c.id, n.id) as id, coalesce(c.workspace_id, n.workspace_id) as workspace_id,
        case when n_name is not null then {_text('n_name')} else c.name end as name,
        case when n_type is not null then {_text('n_type')} else c.type end as type, coalesce(n_config, c.config) as config,
        epoch_ms(case when life is not null then created else c.created_at end) as created_at_ms,
        epoch_ms(coalesce(touched, c.updated_at)) as updated_at_ms
    from {d('destinations')} c full outer join {_CHANGES} n on c.id = n.id and c.workspace_id = n.workspace_id
    where coalesce(life <> 'delete', true)"""

CONFIG_REQUESTS = f"""(select id, case when version % 5 = 0 then 'ws_0' else workspace_id end as workspace_id,
    version as request from {d('patches')})"""

# Expected errors by the case a submitted definition was made with.
PIPELINE_ERRORS = {
    1: "name: name must be a string", 2: "name: name must be a string",
    3: "description: description must be a string",
    5: "trigger: trigger must be an object",
    6: "trigger.type: type must be one of the following values: event",
    7: "trigger.events: events must contain at least 1 elements",
    8: "trigger.events: each value in events must be a string",
    9: "trigger.events: events must contain at least 1 elements; trigger.events: each value in events must be a string;"
       " trigger.events: events must be an array",
    10: "steps: steps must be an array", 11: "steps: steps must be an array",
    13: "steps.0.id: id must be a UUID",
    14: "steps.0.type: type must be one of the following values: filter, transform, enrich, destination",
    15: "steps.0.name: name must be a string", 16: "steps.0.config: config must be an object",
    17: "enabled: enabled must be a boolean value", 20: "owner: property owner should not exist",
}
TYPES = "postgres, mysql, slack, discord, webhook, s3, email, elasticsearch"
DESTINATION_ERRORS = {
    1: "name: name must be a string", 2: "name: name must be a string",
    3: f"type: type must be one of the following values: {TYPES}",
    4: f"type: type must be one of the following values: {TYPES}",
    5: "config: config must be an object", 6: "config: config must be an object", 7: "config: config must be an object",
    8: "iv: property iv should not exist",
}


def by_case(number: str, texts: dict[int, str]) -> str:
    return f"case {number} " + " ".join(f"when {k} then {quoted(t)}" for k, t in texts.items()) + " else '' end"


def request_number(prefix: str) -> str:
    return f"cast(replace(request_id, '{prefix}', '') as bigint)"


def topic_regex() -> str:
    """Patterns as regular expressions over the routing key with a dot before each word."""
    return (
        "'^' || replace(replace(regexp_replace('.' || pattern, '[.]', '[.]', 'g'), '[.]#', '([.][^.]*)*'),"
        " '[.]*', '[.][^.]*') || '$'"
    )


def throughput() -> str:
    return f"""select epoch_ms(time_bucket(interval 6 hour, received_at, timestamp '1970-01-01')) as bucket_ms,
        workspace_id, event_name, count(*) as n, cast(grouping(workspace_id) * 2 + grouping(event_name) as integer) as level
        from {d('stored')} group by grouping sets ((bucket_ms, workspace_id, event_name), (bucket_ms, workspace_id), (bucket_ms))"""


LATEST = f"""(select event_id, destination_id, arg_max(status, row(attempted_at, attempt_number, id)) as status,
        count(*) as attempts, max(attempted_at) as last_attempt_at
    from {d('attempts')} group by all)"""
AS_OF = "timestamp '2024-01-31 00:00:00'"
EXPIRED = f"""(select *, 'dead.' || queue as routing_key, published_at + interval 24 hour as dead_at from {d('queue_log')}
    where coalesce(consumed_at, {AS_OF}) - published_at >= interval 24 hour)"""
SESSIONS = f"""(select *, sum(fresh) over (partition by workspace_id, who order by received_at, event_id) as nr from (
    select *, case when received_at - lag(received_at) over (partition by workspace_id, who order by received_at, event_id)
        < interval 2 hour then 0 else 1 end as fresh
    from (select *, coalesce(user_id, anonymous_id) as who from {d('stored')} where session_id is null)))"""
ISLANDS = f"""(select *, sum(fresh) over (partition by workspace_id, kind, session order by received_at, event_id) as nr from (
    select *, case when received_at - lag(received_at) over (partition by workspace_id, kind, session order by received_at, event_id) < width then 0 else 1 end as fresh
    from (select *, case when session_id is null then 'gap' else 'id' end as kind, coalesce(session_id, user_id, anonymous_id) as session,
            case when session_id is null then interval 2 hour else interval 24 hour end as width from {d('stored')})))"""
# Every window of every rule between the first of January and AS_OF, empty ones as well.
ALERT_WINDOWS = f"""(select rule_id, r.workspace_id, op, threshold, window_seconds, cooldown_seconds, w.opens as window_start, e.n, case when e.n is null then 0 else e.value end as value
    from {d('rules')} r cross join unnest(range(cast(ceil(1704067200 / window_seconds) * window_seconds as bigint), cast(floor(1706659200 / window_seconds) * window_seconds as bigint), cast(window_seconds as bigint))) w(opens)
    left join (select rule_id, cast(floor(epoch(received_at) / window_seconds) * window_seconds as bigint) as opens, count(*) as n,
            cast(case when any_value(metric) = 'count' then count(*) else sum(cast(properties->>'$.total' as bigint)) end as bigint) as value
        from {d('rules')} r join {d('stored')} s on s.workspace_id = r.workspace_id and (r.event_name is null or r.event_name = s.event_name)
        group by 1, 2) e using (rule_id, opens))"""
ALERTS = f"""(select *, coalesce(window_start - lag(window_start) over (partition by rule_id order by window_start) < cooldown_seconds, false) as suppressed
    from {ALERT_WINDOWS} where case op when 'gt' then value > threshold when 'gte' then value >= threshold
        when 'lt' then value < threshold else value <= threshold end)"""
ALERT_GAPS = f"""(select *, case when n is null then sum(case when n is null and before_empty and window_start - before = window_seconds then 0 else 1 end)
            over (partition by rule_id order by window_start) else -window_start end as island
    from (select *, lag(window_start) over w as before, lag(n is null) over w as before_empty from {ALERTS} window w as (partition by rule_id order by window_start)))"""


def traits(owner: str, table: str) -> str:
    return f"""(select {owner}, '{{' || string_agg('"' || key || '":' || value, ',' order by key) || '}}' as traits from (
        select {owner}, key, arg_max(cast(json_extract(traits, '$.' || key) as varchar), seen_at) as value
        from (select *, unnest(json_keys(traits)) as key from {d(table)}) group by 1, 2) group by 1)"""


def closed_windows(width: int, slide: int) -> str:
    """Windows whose end the watermark (latest event less one hour) has passed, by the second run."""
    copies = ", ".join(str(i) for i in range(width // slide))
    start = f"time_bucket(interval {slide} hour, received_at, timestamp '1970-01-01') - to_hours(cast(i * {slide} as integer))"
    return f"""select epoch_ms({start}) as bucket_ms, workspace_id, event_name, count(*) as n
        from (select *, unnest([{copies}]) as i from {d('stored')}) group by all
        having max({start}) + interval {width} hour <= (select max(received_at) - interval 1 hour from {d('stored')})"""


ENVELOPE = f"""'{{"meta":{{"messageId":"' || {content_id("'message'", 'id')} || '","correlationId":"' || correlation_id || '","timestamp":"'
            || strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%gZ') || '","source":"ingestion","version":"1.0","workspaceId":"' || workspace_id
            || '"}},"payload":{{"eventId":"' || event_id || '","event":"' || event_name || '","source":"' || source || '","version":"1.0"'
            || coalesce(',"userId":"' || user_id || '"', '') || coalesce(',"anonymousId":"' || anonymous_id || '"', '')
            || coalesce(',"sessionId":"' || session_id || '"', '') || ',"properties":' || properties || ',"context":' || context
            || ',"receivedAt":"' || received_text || '"}}}}'"""


def oracle_sql() -> dict[str, str]:
    quarantine_fields = f"array_to_string(list_transform(errs, lambda e: e.message), '; ')"
    return {
        "parse_raw_events": f"""select batch_id, array_to_string(list_sort(json_keys(j)), ',') as keys, t_event as event,
            case when j is not null then k_sessionId is not null end as has_session,
            {missing('sessionId')} as no_session,
            case when k_properties = 'OBJECT' then cast(j->'$.properties' as varchar) end as properties
            from {parsed(d('raw_events'))}""",
        "explode_event_batch": f"""select batch_id, pos, cast(batch_size as integer) as batch_size,
            t_eventId as event_id, cast(0 as integer) as n_unknown from {parsed(ITEMS)}
            union all select batch_id, pos, batch_size, null, n_unknown from {ODD_BODIES}""",
        "validate_events": f"""select batch_id, cast(len(errs) as integer) as n_errors, {ERRORS_TEXT} as errors
            from {validated(d('raw_events'))}""",
        "valid_events": f"select batch_id, workspace_id, epoch_ms(arrived_at) as arrived_at_ms from {VALID}",
        "quarantine_events": f"""select batch_id, workspace_id, cast(400 as integer) as status_code, 'Bad Request' as error,
            {quarantine_fields} as message, t_correlationId as correlation_id, raw
            from {validated(d('raw_events'))} where len(errs) > 0""",
        "batch_admission": f"select * from {ADMISSION}",
        "reject_summary": f"""select e.field, e.message, count(*) as n, cast(400 as integer) as status_code, 'warn' as level
            from (select unnest(errs) as e from {validated(d('raw_events'))}) group by e.field, e.message""",
        "normalize_events": f"""select * exclude (batch_id, pos, arrived_at, arrival_seq, received_at, ingested_at),
            epoch_ms(received_at) as received_at_ms, epoch_ms(ingested_at) as ingested_at_ms from {normalized(VALID)}""",
        "correlation_fill": f"""select batch_id, coalesce(t_correlationId, {content_id("'correlation'", 'batch_id', 'pos')}) as correlation_id
            from {parsed(d('raw_events'))}""",
        "dedupe_status": f"""select event_id, arrival_seq, workspace_id, epoch_ms(arrived_at) as arrived_at_ms, status
            from {deduped(d('arrivals'))}""",
        "dedupe_against_store": f"""select case when s.at is null then a.status when a.arrived_at < s.at + interval 24 hour
                then 'duplicate' else 'conflict' end as status, arrival_seq, event_id
            from {deduped(d('arrivals'))} a left join
                (select event_id, min(ingested_at) as at from {d('stored')} where event_name <> 'app.click' group by 1) s using (event_id)
            """,
        "already_ingested": f"""select event_id, arrival_seq from {d('arrivals')} where event_id not in
            (select event_id from {d('stored')} where event_name = 'app.purchase')""",
        "events_store": f"""select id, event_id, workspace_id, event_name, cast(cast(received_at as date) as varchar) as received_date,
            properties, epoch_ms(received_at) as received_at_ms from {deduped(normalized(VALID_ARRIVALS))} where status = 'accepted'""",
        "event_counts": f"""select workspace_id, event_name, count(*) as n from {deduped(normalized(VALID_ARRIVALS))}
            where status = 'accepted' group by all""",
        "event_envelope": f"select 'event.ingested' as routing_key, {ENVELOPE} as value from {d('stored')}",
        "ingest_results": f"""select batch_id, string_agg(pos || ':' || event_id || ':' || status, ',' order by pos) as results
            from {BATCHED} group by 1""",
        "batch_summary": f"""select batch_id, count(*) filter (status = 'accepted') as accepted,
            count(*) filter (status = 'duplicate') as duplicates, count(*) filter (status = 'conflict') as conflicts
            from {BATCHED} group by 1""",
        "config_scan": f"""select id, workspace_id, name, description, enabled, cast(len(steps) as integer) as n_steps,
            array_to_string(trigger.events, ',') as events from {d('pipelines')}""",
        "workspace_scope": f"""select id, workspace_id, name, type from {d('destinations')} where workspace_id =
            (select workspace_id from {d('stored')} group by 1 order by count(*) desc, 1 limit 1)""",
        "workspace_list": f"""select workspace_id, id, name, epoch_ms(created_at) as created_at_ms from {d('pipelines')}
            order by workspace_id, created_at desc, id""",
        "lookup_scoped": f"""select r.request, r.id, r.workspace_id, p.id is not null as found, p.name from {CONFIG_REQUESTS} r
            left join {d('pipelines')} p on p.id = r.id and p.workspace_id = r.workspace_id""",
        "not_found_report": f"""select r.request, r.workspace_id, cast(404 as integer) as status_code,
            'Pipeline ' || r.id || ' not found' as message from {CONFIG_REQUESTS} r where not exists
            (select 1 from {d('pipelines')} p where p.id = r.id and p.workspace_id = r.workspace_id)""",
        "enabled_pipelines": f"select id, workspace_id from {d('pipelines')} where enabled",
        "public_destinations": f"""select id, workspace_id, name, type, epoch_ms(created_at) as created_at_ms,
            epoch_ms(updated_at) as updated_at_ms from {d('destinations')}""",
        "validate_pipelines": f"""select request_id, {by_case(request_number('preq_') + ' % 31', PIPELINE_ERRORS)} as errors
            from {d('pipeline_requests')}""",
        "pipeline_defaults": f"""select {content_id("'definition'", 'request_id')} as id, raw->>'$.name' as name,
            raw->>'$.description' as description, coalesce(cast(raw->>'$.enabled' as boolean), true) as enabled,
            cast(json_array_length(raw, '$.steps') as integer) as n_steps, raw->>'$.trigger.events[0]' as events
            from {d('pipeline_requests')}
            where {request_number('preq_')} % 31 not in ({', '.join(str(k) for k in PIPELINE_ERRORS)})""",
        "validate_destinations": f"""select request_id, {by_case(request_number('dreq_') + ' % 13', DESTINATION_ERRORS)} as errors
            from {d('destination_requests')}""",
        "patch_outcomes": f"select id, version, op, outcome from {OUTCOMES}",
        "apply_patches": APPLY,
        "encrypt_column": f"""select id, cast(24 as integer) as iv_digits, cast(16 as integer) as tag_bytes, true as hidden
            from {d('destinations')}""",
        "decrypt_column": f"""select id, case when substr(md5(id), 1, 1) < '5' then null else config end as config
            from {d('destinations')}""",
        "credentials_updated": f"""select id, case when changed then 'Renamed ' || name else name end as name, type,
            case when changed and substr(md5(id), 2, 1) < '5' then '{{"token":"new"}}' else config end as config,
            epoch_ms(case when changed then {AS_OF} else updated_at end) as updated_at_ms
            from (select *, substr(md5(id), 1, 1) < '8' as changed from {d('destinations')})""",
        "destination_outcomes": f"select id, version, op, outcome from {_CHANGED}",
        "destination_patches": DESTINATIONS,
        "retry_schedule": f"""select id, attempt_number, cast(least(1000 * power(2, attempt_number - 1), 30000) as bigint) as delay_ms,
            false as exhausted, epoch_ms(attempted_at) + cast(least(1000 * power(2, attempt_number - 1), 30000) as bigint) as next_attempt_at_ms
            from {d('attempts')} where status = 'failed'""",
        "trigger_match": f"select event_id, pipeline_id, event_name, cast(len(steps) as integer) as n_steps from {MATCHED}",
        "filter_step": f"select event_id, pipeline_id from {MATCHED} where {HOLDS}",
        "transform_step": f"""select event_id, pipeline_id, {RESHAPED} from {MATCHED} where len(steps) = 4
            union all select event_id, pipeline_id, 'k,total', cast(total as varchar), cast(k as varchar) from {MATCHED} where len(steps) <> 4""",
        "enrich_step": f"""select event_id, pipeline_id, nation, segment,
            cast(case when nation is null then 2 else 4 end as integer) as n_props
            from {MATCHED} left join {d('profiles')} using (user_id) where len(steps) = 4
            union all select event_id, pipeline_id, null, null, cast(2 as integer) from {MATCHED} where len(steps) <> 4""",
        "destination_fanout": f"select event_id, pipeline_id, destination_id, type from {FANNED}",
        "destination_sinks": f"""select event_id, destination_id, type, case
                when type in ('postgres', 'mysql', 's3') then payload
                when type = 'slack' then '{{"text":"' || event_name || ' ' || replace(payload, '"', chr(92) || '"') || '"}}'
                when type = 'discord' then '{{"content":"' || event_name || ' ' || replace(payload, '"', chr(92) || '"') || '"}}'
                when type = 'email' then '{{"subject":"' || event_name || '","body":"' || event_name || ' ' || replace(payload, '"', chr(92) || '"') || '"}}'
                else '{{"event_id":"' || event_id || '","event_name":"' || event_name || '","properties":' || payload || '}}' end as body
            from {FANNED} where type is not null""",
        "execution_rows": f"""select event_id, pipeline_id, status, error, n_sends, epoch_ms(received_at) as started_at_ms,
            epoch_ms(ingested_at) as completed_at_ms from {EXECUTED}""",
        "executions_by_status": f"""select pipeline_id, status, count(*) as n, cast(sum(n_sends) as bigint) as n_sends,
            round(avg(epoch_ms(ingested_at) - epoch_ms(received_at)), 3) as mean_ms,
            max(epoch_ms(ingested_at) - epoch_ms(received_at)) as max_ms from {EXECUTED} group by 1, 2""",
        "route_topics": f"""select distinct message_id, routing_key, queue from {d('messages')} m
            join {d('bindings')} b on regexp_matches('.' || m.routing_key, {topic_regex()})""",
        "delivery_latest": f"""select event_id, destination_id, status, attempts, epoch_ms(last_attempt_at) as last_attempt_at_ms
            from {LATEST}""",
        "delivery_outcomes": f"""select destination_id, count(*) filter (status = 'pending') as pending,
            count(*) filter (status = 'delivered') as delivered, count(*) filter (status = 'failed') as failed,
            count(*) filter (status = 'dead_lettered') as dead_lettered, round(avg(attempts), 6) as mean_attempts,
            round(count(*) filter (status = 'delivered' and attempts = 1) / count(*), 6) as first_try_rate
            from {LATEST} group by 1""",
        "destination_health": f"""select destination_id, count(*) filter (run = 0) as trailing_failures,
            case when count(*) filter (run = 0) >= 2 then 'open' else 'closed' end as state,
            epoch_ms(max(attempted_at) filter (status = 'delivered')) as last_success_at_ms
            from (select *, sum(case when status = 'delivered' then 1 else 0 end) over (
                    partition by destination_id order by attempted_at desc, id desc) as run
                from {d('attempts')} where status <> 'pending') group by 1""",
        "expire_messages": f"select message_id, queue, routing_key, epoch_ms(dead_at) as dead_at_ms from {EXPIRED}",
        "dead_letter": f"""select 'expired' as reason, queue, routing_key, event_id, null as destination_id, value as message, null as error,
                epoch_ms(dead_at) as dead_at_ms from {EXPIRED}
            union all select 'exhausted', 'delivery.events', 'dead.delivery.events', event_id, destination_id, m.message, error,
                epoch_ms(attempted_at) from {d('attempts')} left join (select event_id, {ENVELOPE} as message from {d('stored')}) m using (event_id)
                where status = 'dead_lettered'
            union all select 'unknown_destination', 'pipeline.events', 'dead.pipeline.events', event_id, destination_id, payload, null,
                epoch_ms(ingested_at) from {FANNED} where type is null""",
        "dlq_replay": f"""select a.event_id, destination_id, 'delivery.retry' as routing_key, cast(1 as integer) as attempt,
            '2024-01-31T00:00:00.000Z' as replayed_at, event_name, properties, received_text from {d('attempts')} a left join {d('stored')} using (event_id)
            where status = 'dead_lettered' and attempt_number > 1 and not exists (select 1 from {d('attempts')} again
                where again.event_id = a.event_id and again.destination_id = a.destination_id and again.status = 'delivered')""",
        "context_flatten": f"""select event_id, context->>'$.app.name' as app_name, context->>'$.app.version' as app_version,
            context->>'$.campaign.source' as campaign_source, context->>'$.campaign.medium' as campaign_medium,
            context->>'$.campaign.name' as campaign_name, context->>'$.locale' as locale, context->>'$.timezone' as timezone
            from {d('stored')}""",
        "page_events": f"""select event_id, event_name as name, user_id, anonymous_id, properties, context
            from {d('stored')} where event_name = 'app.view'""",
        "identify_traits": f"select * from {traits('user_id', 'identifies')}",
        "group_membership": f"""select user_id, group_id, calls, traits, epoch_ms(first_at) as first_at_ms, epoch_ms(last_at) as last_at_ms
            from (select user_id, group_id, count(*) as calls, min(seen_at) as first_at, max(seen_at) as last_at
                from {d('groups')} group by 1, 2) join {traits('group_id', 'groups')} using (group_id)""",
        "session_rollup": f"""select workspace_id, 'id' as kind, session_id as session, count(*) as events,
                epoch_ms(min(received_at)) as started_at_ms, epoch_ms(max(received_at)) as ended_at_ms
            from {d('stored')} where session_id is not null group by workspace_id, session_id
            union all select workspace_id, 'gap', who, count(*), epoch_ms(min(received_at)), epoch_ms(max(received_at))
            from {SESSIONS} group by workspace_id, who, nr""",
        "latest_events": f"""select workspace_id, rank, event_id, epoch_ms(received_at) as received_at_ms from (
            select *, row_number() over (partition by workspace_id order by received_at desc, event_id) as rank
            from {d('stored')}) where rank <= 10""",
        "correlation_trace": f"""select correlation_id, event_id, epoch_ms(received_at) as received_at_ms,
            epoch_ms(received_at) - epoch_ms(lag(received_at) over (partition by correlation_id order by received_at, event_id)) as gap_ms
            from {d('stored')}""",
        "throughput_series": throughput(),
        "active_users": f"""select epoch_ms(date_trunc('day', received_at)) as bucket_ms, workspace_id,
            count(distinct coalesce(user_id, anonymous_id)) as users from {d('stored')} group by 1, 2""",
        "active_users_approx": f"""select epoch_ms(date_trunc('day', received_at)) as bucket_ms, workspace_id,
            count(distinct coalesce(user_id, anonymous_id)) as users, true as close from {d('stored')} group by 1, 2""",
        "read_model": f"""select cast(cast(received_at as date) as varchar) as day, workspace_id, event_name, count(*) as events,
            count(distinct coalesce(user_id, anonymous_id)) as users,
            cast(sum(cast(properties->>'$.total' as bigint)) as bigint) as total,
            count(*) filter (status = 'delivered') as delivered, count(*) filter (status = 'dead_lettered') as dead_lettered,
            max(quota) as quota
            from {d('stored')} left join {LATEST} using (event_id) left join {d('quotas')} using (workspace_id)
            group by 1, 2, 3""",
        "read_model_runs": f"""select cast(cast(received_at as date) as varchar) as day, workspace_id, event_name, count(*) as events,
            count(distinct coalesce(user_id, anonymous_id)) as users,
            cast(sum(cast(properties->>'$.total' as bigint)) as bigint) as total,
            count(*) filter (status = 'delivered') as delivered, count(*) filter (status = 'dead_lettered') as dead_lettered,
            max(quota) as quota
            from {d('stored')} left join {LATEST} using (event_id) left join {d('quotas')} using (workspace_id)
            group by 1, 2, 3""",
        "active_users_spans": f"""select cast(span as integer) as span, cast(day as varchar) as day, workspace_id, count(distinct who) as users, true as close
            from (select workspace_id, who, span, cast(unnest(range(seen, least(seen + to_days(cast(span as integer)), timestamp '2024-02-01'), interval 1 day)) as date) as day
                from (select distinct workspace_id, coalesce(user_id, anonymous_id) as who, cast(date_trunc('day', received_at) as timestamp) as seen, unnest([7, 28]) as span from {d('stored')}))
            group by 1, 2, 3""",
        "edge_limit_audit": f"""with recursive o as (select event_id, workspace_id, epoch_ms(received_at) as t,
                row_number() over (partition by workspace_id order by epoch_ms(received_at), event_id) as i from {d('stored')}),
            r as (select *, cast(21600000 as bigint) as level from o where i = 1 union all
                select o.*, greatest(0, r.level - (o.t - r.t)) + 21600000 from r join o on o.workspace_id = r.workspace_id and o.i = r.i + 1)
            select event_id, workspace_id, cast(level as bigint) as level, level > 3 * 21600000 as over_limit from r""",
        "alert_rules_with_silence": f"""select rule_id, any_value(workspace_id) as workspace_id, min(window_start) as window_start, count(*) as windows,
            cast(min(value) as bigint) as value, arg_min(suppressed, window_start) as suppressed,
            count(*) > 1 and arg_max(suppressed, window_start) as repeats_suppressed from {ALERT_GAPS} group by rule_id, island""",
        "workspace_quota": f"""select workspace_id, month, used, quota, coalesce(used > quota, false) as over
            from (select workspace_id, strftime(ingested_at, '%Y-%m') as month, count(*) as used from {d('stored')} group by 1, 2)
            left join {d('quotas')} using (workspace_id)""",
        "rate_limit_audit": f"""select event_id, workspace_id, in_window, in_window > 3 as over_limit, in_window > 5 as over_burst
            from (select *, count(*) over (partition by workspace_id order by received_at
                range between interval 6 hour preceding and current row) as in_window from {d('stored')})""",
        "alert_rules": f"""select rule_id, workspace_id, window_start, value,
            coalesce(window_start - lag(window_start) over (partition by rule_id order by window_start) < cooldown_seconds, false) as suppressed
            from (select rule_id, r.workspace_id, cast(floor(epoch(received_at) / window_seconds) * window_seconds as bigint) as window_start,
                    cast(case when any_value(metric) = 'count' then count(*) else sum(cast(properties->>'$.total' as bigint)) end as bigint) as value,
                    any_value(op) as op, any_value(threshold) as threshold, any_value(cooldown_seconds) as cooldown_seconds
                from {d('rules')} r join {d('stored')} s on s.workspace_id = r.workspace_id
                    and (r.event_name is null or r.event_name = s.event_name) group by 1, 2, 3)
            where case op when 'gt' then value > threshold when 'gte' then value >= threshold
                when 'lt' then value < threshold else value <= threshold end""",
        "stream_ingest": f"""select batch_id, status from {deduped(normalized(VALID))}
            union all select batch_id, 'quarantined' from {validated(d('raw_events'))} where len(errs) > 0""",
        "stream_dedupe": f"select batch_id, event_id, arrival_seq, status from {deduped(normalized(VALID_ARRIVALS))}",
        "stream_labels": f"select event_id, arrival_seq, status from {deduped(d('arrivals'))}",
        "stream_accepted": f"select distinct event_id from {d('arrivals')}",
        "late_rows": f"""select epoch_ms(time_bucket(interval 6 hour, received_at, timestamp '1970-01-01')) as bucket_ms, workspace_id, event_name,
            count(*) as stored, count(*) filter (md5(event_id) >= '1') as n, count(*) filter (md5(event_id) < '1') as late
            from {d('stored')} group by 1, 2, 3 having count(*) filter (md5(event_id) < '1') > 0 and count(*) filter (md5(event_id) >= '1') > 0""",
        "masked_failures": f"""select 500 as status_code, 'Internal Server Error' as error, 'An unexpected error occurred' as message,
            correlation_id, 'error' as level from {d('stored')}""",
        "queue_source": f"""select 'event.ingested' as routing_key, event_id, epoch_ms(ingested_at) as published_at_ms
            from {d('stored')}""",
        "stream_pipeline": f"select pipeline_id, event_id, status, error, n_sends from {EXECUTED}",
        "stream_sessions": f"""select workspace_id, kind, session, cast(sum(events) as bigint) as events, epoch_ms(min(started)) as started_at_ms, epoch_ms(max(ended)) as ended_at_ms
            from (select workspace_id, kind, session, nr, count(*) as events, min(received_at) as started, max(received_at) as ended
                from {ISLANDS} group by workspace_id, kind, session, nr, width
                having max(received_at) + width <= (select max(received_at) - interval 4 day from {d('stored')}))
            group by workspace_id, kind, session, case when kind = 'gap' then nr end""",
        "stream_expiry": f"""select message_id, queue, 'dead.' || queue as routing_key, epoch_ms(published_at + interval 24 hour) as dead_at_ms from {d('queue_log')}
            where coalesce(consumed_at >= published_at + interval 24 hour, true)
                and published_at + interval 25 hour <= (select least(max(published_at), max(consumed_at)) from {d('queue_log')})""",
        "stream_throughput": closed_windows(6, 6),
        "stream_throughput_sliding": closed_windows(12, 6),
    }
