"""Time-bucketed measures, read models, quotas, rate audits and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penstock.operators.delivery import delivery_latest
from penstock.operators.skew import on_keys, sliced, spanning_keys


def throughput_series(store: DataFrame, bucket: str = "1 hour", totals: bool = False) -> DataFrame:
    """Events per bucket, workspace and name; with `totals` also per workspace and bucket, and per bucket.

    Totals are rolled up from the finest counts, so events are read and shuffled once.
    """
    finest = store.groupBy(
        F.window("received_at", bucket).start.alias("bucket"), "workspace_id", "event_name"
    ).agg(F.count(F.lit(1)).alias("n"))
    if not totals:
        return finest
    rolled = finest.rollup("bucket", "workspace_id", "event_name").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("level")
    )
    return rolled.filter(F.col("bucket").isNotNull())


def _person() -> Column:
    return F.coalesce("user_id", "anonymous_id")


def active_users(store: DataFrame, bucket: str = "1 day") -> DataFrame:
    """Exact distinct people per bucket and workspace."""
    return store.groupBy(F.window("received_at", bucket).start.alias("bucket"), "workspace_id").agg(
        F.count_distinct(_person()).alias("users")
    )


def active_users_approx(store: DataFrame, bucket: str = "1 day", rsd: float = 0.02) -> DataFrame:
    """Distinct people from a sketch: one pass, no shuffle of people."""
    return store.groupBy(F.window("received_at", bucket).start.alias("bucket"), "workspace_id").agg(
        F.approx_count_distinct(_person(), rsd).alias("users")
    )


def user_sketches(store: DataFrame, log_size: int = 14) -> DataFrame:
    """One mergeable sketch of the distinct people per day and workspace; its size doesn't grow with them."""
    return store.groupBy(F.to_date("received_at").alias("day"), "workspace_id").agg(F.hll_sketch_agg(_person(), F.lit(log_size)).alias("people"))


def active_users_spans(sketches: DataFrame, until: Column, spans: tuple[int, ...] = (7, 28)) -> DataFrame:
    """Distinct people of the `span` days up to each day, by merging daily sketches; no event is read again.

    Spans overlap, so a day's sketch goes into as many of them as they have days. `until` is the last day.
    """
    ends = F.array(*[F.struct(F.lit(span).alias("span"), F.sequence("day", F.least(F.date_add("day", span - 1), until)).alias("days")) for span in spans])
    spread = sketches.filter(F.col("day") <= until).select("workspace_id", "people", F.explode(ends).alias("_s"))
    spread = spread.select("workspace_id", "people", "_s.span", F.explode("_s.days").alias("day"))
    return spread.groupBy("span", "day", "workspace_id").agg(F.hll_sketch_estimate(F.hll_union_agg("people")).alias("users"))


def read_model(store: DataFrame, attempts: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Wide daily rows per workspace and event name: volume, people, value, and delivery outcomes."""
    outcome = delivery_latest(attempts).groupBy("event_id").agg(
        F.count_if(F.col("status") == "delivered").alias("_delivered"),
        F.count_if(F.col("status") == "dead_lettered").alias("_dead"),
    )
    day = F.to_date("received_at")
    daily = (
        store.join(outcome, "event_id", "left")
        .groupBy(day.alias("day"), "workspace_id", "event_name")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_distinct(_person()).alias("users"),
            F.sum(F.get_json_object("properties", "$.total").try_cast("bigint")).alias("total"),
            F.coalesce(F.sum("_delivered"), F.lit(0)).alias("delivered"),
            F.coalesce(F.sum("_dead"), F.lit(0)).alias("dead_lettered"),
        )
    )
    return daily.join(workspaces, "workspace_id", "left")


def workspace_quota(store: DataFrame, quotas: DataFrame) -> DataFrame:
    """Monthly events against the allowance; workspaces without one have a NULL quota and are never over."""
    used = store.groupBy("workspace_id", F.date_format("ingested_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("used")
    )
    joined = used.join(quotas, "workspace_id", "left")
    return joined.withColumn("over", F.coalesce(F.col("used") > F.col("quota"), F.lit(False)))


def rate_limit_audit(
    requests: DataFrame, key: str, at: str, window_ms: int, limit: int, burst: int
) -> DataFrame:
    """Add `in_window`, the requests of the same key in the `window_ms` up to each request.

    `over_limit` marks counts above the limit, `over_burst` those above limit and
    burst. A request counts as one from its time on and leaves the count one
    millisecond after the window, so the count is a running sum, linear in the
    number of requests. The sum runs within slices of ten windows, and each slice starts from
    what the slices before it add up to: a busy key is counted by many tasks.
    """
    width = 10 * window_ms
    ms = F.unix_millis(at)
    steps = F.array(
        F.struct(ms.alias("at"), F.lit(1).alias("step")), F.struct((ms + window_ms + 1).alias("at"), F.lit(-1).alias("step"))
    )
    moves = requests.select("*", F.explode(steps).alias("_move")).withColumn("_slice", F.floor(F.col("_move.at") / width))
    totals = moves.groupBy(key, "_slice").agg(F.sum("_move.step").alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(key).alias("_key"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    running = Window.partitionBy(key, "_slice").orderBy(F.col("_move.at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = moves.withColumn("_inside", F.sum("_move.step").over(running)).filter("_move.step = 1")
    return (
        counted.join(carried, counted[key].eqNullSafe(carried["_key"]) & (counted["_slice"] == carried["_of"]))
        .withColumn("in_window", F.col("_inside") + F.col("_before"))
        .withColumn("over_limit", F.col("in_window") > limit)
        .withColumn("over_burst", F.col("in_window") > limit + burst)
        .drop("_move", "_slice", "_inside", "_key", "_of", "_before")
    )


def edge_limit_audit(requests: DataFrame, key: str, at: str, order: str, rate: int, burst: int, per_ms: int = 1000) -> DataFrame:
    """Add `level` and `over_limit`: the draining bucket of each key, `rate` requests per `per_ms` and a `burst`.

    Each request fills one, whether it would be let through or not: this is the demand on
    the limit, the form that can be computed in parts; a limiter that doesn't count what it refuses
    lets through more. Level = max(0, level - what drained since) + 1, in units of 1 / `per_ms` of a
    request; over the limit is what stands above the burst and the one being served.

    Unrolled, the level is a difference between n * per_ms - rate * t (for the nth request at t) and the least
    such value so far. So a slice needs from those before it a count and a minimum, and a hot key is cut anywhere.
    """
    rows = sliced(requests.withColumn("_ms", F.unix_millis(at)), [key], ["_ms", order], "edge-limit")
    spec = Window.partitionBy(key, "_slice").orderBy("_ms", order)
    local = rows.withColumn("_n", F.row_number().over(spec).cast("bigint"))
    local = local.withColumn("_term", F.col("_n") * per_ms - F.col("_ms") * rate)
    local = local.withColumn("_low", F.min("_term").over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per_slice = local.groupBy(key, "_slice").agg(F.max("_n").alias("_rows"), F.min("_low").alias("_least"))
    per_slice = on_keys(per_slice, spanning_keys(rows, [key]), [key], "inner")
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    carried = carried.select(key, "_slice", "_before", F.min(F.col("_least") + F.col("_before") * per_ms).over(earlier).alias("_lowest"))
    before = F.coalesce("_before", F.lit(0)) * per_ms
    level = before + F.col("_term") + per_ms - F.least("_lowest", before + F.col("_low"))
    return (
        on_keys(local, carried, [key, "_slice"], "left")
        .withColumn("level", level)
        .withColumn("over_limit", F.col("level") > (burst + 1) * per_ms)
        .drop("_ms", "_slice", "_n", "_term", "_low", "_before", "_lowest")
    )


def alert_rules(store: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts: windows in which a rule's measure passes its threshold.

    Rules (rule_id, workspace_id, event_name or NULL for any, metric count or total,
    window_seconds, op gt/gte/lt/lte, threshold, cooldown_seconds). Windows are
    multiples of a minute; events are reduced to minutes before they meet the rules.
    A breach within the cooldown of the breach before it is marked `suppressed`.
    Windows without events are not evaluated.
    """
    if not rules.filter("window_seconds % 60 <> 0 or window_seconds <= 0").isEmpty():
        raise ValueError("alert windows must be whole minutes")
    breached = _measured(store, rules).filter(_breach(F.col("value")))
    before = F.lag("window_start").over(Window.partitionBy("rule_id").orderBy("window_start"))
    return breached.withColumn(
        "suppressed",
        F.coalesce(F.col("window_start") - before < F.col("cooldown_seconds"), F.lit(False)),
    )


def _measured(store: DataFrame, rules: DataFrame) -> DataFrame:
    """The value of each rule in each window that has events, with what else the rule says."""
    total = F.get_json_object("properties", "$.total").try_cast("bigint")
    minute = F.floor(F.unix_seconds("received_at") / 60) * 60
    per_minute = store.groupBy("workspace_id", "event_name", minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(total).alias("total")
    )
    # a rule of one name meets the minutes of that name; a rule of any name, minutes summed over names
    per_any = per_minute.groupBy("workspace_id", "minute").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    named = per_minute.join(rules.filter(F.col("event_name").isNotNull()), ["workspace_id", "event_name"]).drop("event_name")
    joined = named.unionByName(per_any.join(rules.filter(F.col("event_name").isNull()).drop("event_name"), "workspace_id"))
    width = F.col("window_seconds")
    return joined.groupBy(
        "rule_id", "workspace_id", "metric", "op", "threshold", "window_seconds", "cooldown_seconds",
        (F.floor(F.col("minute") / width) * width).alias("window_start"),
    ).agg(F.sum(F.when(F.col("metric") == "count", F.col("n")).otherwise(F.col("total"))).alias("value"))


def _breach(value: Column) -> Column:
    threshold = F.col("threshold")
    tests = {"gt": value > threshold, "gte": value >= threshold, "lt": value < threshold, "lte": value <= threshold}
    return reduce(lambda acc, name: acc | ((F.col("op") == name) & tests[name]), tests, F.lit(False))


def alert_rules_with_silence(store: DataFrame, rules: DataFrame, since: Column, until: Column) -> DataFrame:
    """Alerts as `alert_rules` gives them, and those of windows without events, whose value is 0.

    Windows lie whole between `since` and `until`. Empty windows that follow each other are one row with
    their number (`windows`): `suppressed` is said of the first, `repeats_suppressed` of the
    others, which follow it at the window's own distance. So silence costs rows per gap, not per
    window, and a rule that no event ever meets has one.
    """
    width = F.col("window_seconds")
    first = F.ceil(F.unix_seconds(since) / width) * width
    end = F.floor(F.unix_seconds(until) / width) * width  # of the last window
    quiet = rules.filter(_breach(F.lit(0))).select(
        "rule_id", "workspace_id", "metric", "op", "threshold", "window_seconds", "cooldown_seconds", (first - width).alias("window_start"), F.lit(None).cast("bigint").alias("value")
    )
    measured = _measured(store, rules).filter((F.col("window_start") >= first) & (F.col("window_start") + width <= end))
    met = measured.withColumn("_edge", F.lit(False)).unionByName(quiet.withColumn("_edge", F.lit(True)))  # an edge stands before the first window
    following = F.coalesce(F.lead("window_start").over(Window.partitionBy("rule_id").orderBy("window_start")), end)
    met = met.withColumn("_empty", F.when(_breach(F.lit(0)), F.greatest(F.lit(0), (following - F.col("window_start")) / width - 1)).otherwise(0).cast("bigint"))
    kinds = F.array(
        F.struct(F.col("window_start").alias("at"), F.lit(1).cast("bigint").alias("n"), F.col("value").cast("bigint").alias("v"), (~F.col("_edge") & F.coalesce(_breach(F.col("value")), F.lit(False))).alias("holds")),
        F.struct((F.col("window_start") + width).alias("at"), F.col("_empty").alias("n"), F.lit(0).cast("bigint").alias("v"), (F.col("_empty") > 0).alias("holds")),
    )
    alerts = met.select("rule_id", "workspace_id", "window_seconds", "cooldown_seconds", F.explode(kinds).alias("_k")).filter("_k.holds").select(
        "rule_id", "workspace_id", "window_seconds", "cooldown_seconds", F.col("_k.at").alias("window_start"), F.col("_k.n").alias("windows"), F.col("_k.v").alias("value")
    )
    last = F.lag(F.col("window_start") + (F.col("windows") - 1) * width).over(Window.partitionBy("rule_id").orderBy("window_start"))
    return alerts.withColumn("suppressed", F.coalesce(F.col("window_start") - last < F.col("cooldown_seconds"), F.lit(False))).withColumn(
        "repeats_suppressed", (F.col("windows") > 1) & (width < F.col("cooldown_seconds"))
    )
