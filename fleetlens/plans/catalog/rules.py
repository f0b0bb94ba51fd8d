"""Scraped series, the evaluation grid and the alert rules."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens import fixtures
from fleetlens.operators import fleet, series
from fleetlens.operators.ordered import with_history
from fleetlens.plans import rules
from fleetlens.plans.catalog.base import DETECTIONS, EVENTS, SCORED, TELEMETRY, query
from fleetlens.plans.catalog.fleet import FRAMES
from fleetlens.plans.catalog.health import scored

SAMPLED = ["battery_percent", "altitude_m", "connected", "temperature_c", "signal_dbm"]
LABELS = ["drone_id", "swarm_id"]

_SAMPLE_SQL = " UNION ALL ".join(
    f"""SELECT '{fleet.GAUGES[f]}' AS metric, drone_id, swarm_id, (us // 5000000 + 1) * 5000000 AS sample_us,
      arg_max({f}::DOUBLE, us) AS value FROM tele GROUP BY drone_id, swarm_id, us // 5000000"""
    for f in SAMPLED
)
SAMPLES = TELEMETRY + f", sample AS ({_SAMPLE_SQL})"


def grid_sql(source: str, labels: str, name: str = "grid", lookback: int | None = 300, end: str | None = None) -> str:
    """Every series at every tick by an as-of join, independent of the interval form used in Spark."""
    end = end or f"(SELECT (max(sample_us) + 14999999) // 15000000 * 15000000 FROM {source})"
    bound = "" if lookback is None else f" AND g.tick - s.sample_us < {lookback * 1_000_000}"
    on = " AND ".join(f"g.{label} = s.{label}" for label in labels.split(", "))
    return f"""{name}_ticks AS (
  SELECT {labels}, unnest(range((min(sample_us) + 14999999) // 15000000 * 15000000, {end} + 1, 15000000)) AS tick
  FROM {source} GROUP BY {labels}),
{name} AS (
  SELECT g.*, s.value, s.sample_us FROM {name}_ticks g ASOF JOIN {source} s ON {on} AND g.tick >= s.sample_us
  WHERE true{bound})"""


def state_sql(condition: str, labels: str, for_s: int | str, source: str = "grid") -> str:
    return f"""met AS (SELECT * FROM {source} WHERE {condition}),
marked AS (
  SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY {labels} ORDER BY tick) = 15000000 THEN 0 ELSE 1 END AS opens FROM met),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY {labels} ORDER BY tick) AS run FROM marked),
stated AS (
  SELECT *, min(tick) OVER (PARTITION BY {labels}, run) AS since,
    CASE WHEN tick - min(tick) OVER (PARTITION BY {labels}, run) >= {for_s} * 1000000 THEN 'firing' ELSE 'pending' END AS state
  FROM numbered)"""


@query("scraped_series", f"WITH {SAMPLES} SELECT * REPLACE (R4(value) AS value) FROM sample")
def scraped_series(spark, sf_dir):
    return series.scrape(fixtures.telemetry(spark, sf_dir), SAMPLED).withColumn("value", F.round("value", 4))


@query("evaluation_grid", f"""WITH {SAMPLES}, {grid_sql("sample", "metric, drone_id, swarm_id", lookback=45)}
SELECT metric, drone_id, swarm_id, tick, sample_us, R4(value) AS value FROM grid""")
def evaluation_grid(spark, sf_dir):
    t = fixtures.telemetry(spark, sf_dir)
    g = series.on_grid(series.scrape(t, SAMPLED), ["metric", *LABELS], lookback_s=45, end_us=series.grid_end(t))
    return g.withColumn("value", F.round("value", 4))


@query("labelled_series", f"""WITH {SAMPLES}
SELECT metric, drone_id AS label_drone, swarm_id AS label_swarm, count(*) AS n FROM sample GROUP BY ALL""")
def labelled_series(spark, sf_dir):
    s = series.as_labels(series.scrape(fixtures.telemetry(spark, sf_dir), SAMPLED), LABELS)
    return s.groupBy("metric", F.col("labels")["drone_id"].alias("label_drone"),
                     F.col("labels")["swarm_id"].alias("label_swarm")).agg(F.count(F.lit(1)).alias("n"))


def _gauge_rule(name, alert, field):
    rule = rules.RULES[alert]
    op = "=" if rule.op == "==" else rule.op

    @query(name, f"""WITH {SAMPLES}, one AS (SELECT * FROM sample WHERE metric = '{rule.metric}'),
{grid_sql("one", "drone_id, swarm_id")}, {state_sql(f"value {op} {rule.threshold}", "drone_id, swarm_id", rule.for_s)}
SELECT drone_id, swarm_id, tick, since, state, R4(value) AS value FROM stated""")
    def run(spark, sf_dir):
        t = fixtures.telemetry(spark, sf_dir)
        samples = series.scrape(t, [field]).drop("metric")
        active = rules.evaluate(series.on_grid(samples, LABELS, end_us=series.grid_end(t)), rule, LABELS)
        return active.withColumn("value", F.round("value", 4))


_gauge_rule("rule_battery_critical", "DroneBatteryCritical", "battery_percent")
_gauge_rule("rule_battery_low", "DroneBatteryLow", "battery_percent")
_gauge_rule("rule_altitude_exceeded", "DroneAltitudeExceeded", "altitude_m")

CONNECTED = TELEMETRY + """,
conn AS (
  SELECT drone_id, swarm_id, (us // 5000000 + 1) * 5000000 AS sample_us, arg_max(connected::INT::DOUBLE, us) AS value
  FROM tele GROUP BY drone_id, swarm_id, us // 5000000),
reach AS (
  SELECT *, coalesce(lead(sample_us) OVER (PARTITION BY drone_id, swarm_id ORDER BY sample_us),
    (SELECT (max(us) + 4999999) // 5000000 * 5000000 FROM tele) + 5000000) AS until FROM conn),
link AS (
  SELECT drone_id, swarm_id, sample_us, value FROM conn
  UNION ALL SELECT drone_id, swarm_id, sample_us + 30000000, 0e0 FROM reach WHERE sample_us + 30000000 < until)"""


@query("rule_connection_lost", f"""WITH {CONNECTED}, {grid_sql("link", "drone_id, swarm_id")},
{state_sql("value = 0", "drone_id, swarm_id", 15)}
SELECT drone_id, swarm_id, tick, since, state, value FROM stated""")
def rule_connection_lost(spark, sf_dir):
    grid = series.on_grid(series.connected_samples(fixtures.telemetry(spark, sf_dir)), LABELS)
    return rules.evaluate(grid, rules.RULES["DroneConnectionLost"], LABELS)


def _count_rule(name, minimum):
    rule = replace(rules.RULES["SwarmDroneCountLow"], threshold=minimum)

    @query(name, f"""WITH {CONNECTED}, {grid_sql("link", "drone_id, swarm_id")},
fleet AS (SELECT 'fleet' AS scope, tick, count(*) FILTER (value = 1)::DOUBLE AS value FROM grid GROUP BY tick),
{state_sql(f"value < {minimum}", "scope", 60, "fleet")}
SELECT scope, tick, since, state, value FROM stated""")
    def run(spark, sf_dir):
        grid = series.on_grid(series.connected_samples(fixtures.telemetry(spark, sf_dir)), LABELS)
        return rules.evaluate(rules.connected_count(grid), rule, ["scope"])


_count_rule("rule_drone_count_low", 3.0)
_count_rule("rule_drone_count_below_140", 140.0)


def _latency_rule(name, threshold, for_s):
    rule = replace(rules.RULES["InferenceLatencyHigh"], threshold=threshold, for_s=for_s)

    @query(name, f"""WITH {FRAMES},
lat AS (SELECT drone_id, (us // 15000000 + 1) * 15000000 AS sample_us,
  sum(latency_s::DECIMAL(18,8))::DOUBLE / count(*) AS value FROM frame GROUP BY drone_id, us // 15000000),
{grid_sql("lat", "drone_id")}, {state_sql(f"value > {threshold}::DOUBLE", "drone_id", for_s)}
SELECT drone_id, tick, since, state, R4(value) AS value FROM stated""")
    def run(spark, sf_dir):
        means = rules.mean_series(fixtures.frames(spark, sf_dir), ["drone_id"], "latency_s")
        active = rules.evaluate(series.on_grid(means, ["drone_id"]), rule, ["drone_id"])
        return active.withColumn("value", F.round("value", 4))


_latency_rule("rule_latency_high", 0.5, 120)
_latency_rule("rule_latency_above_300ms", 0.3, 30)


@query("rule_motor_anomaly", f"""WITH {TELEMETRY},
motor AS (SELECT drone_id, swarm_id, us, unnest(motor_rpm) AS rpm, generate_subscripts(motor_rpm, 1) - 1 AS i FROM tele),
one AS (SELECT drone_id, swarm_id, 'motor_' || i AS motor_id, (us // 5000000 + 1) * 5000000 AS sample_us, arg_max(rpm, us) AS value
  FROM motor GROUP BY drone_id, swarm_id, i, us // 5000000),
{grid_sql("one", "drone_id, swarm_id, motor_id")},
mean AS (SELECT *, avg(value) OVER (PARTITION BY drone_id, swarm_id, tick) AS mu FROM grid),
dev AS (SELECT drone_id, swarm_id, motor_id, tick, CASE WHEN mu <> 0 THEN abs(value - mu) / mu END AS value FROM mean),
{state_sql("value > 3e-1", "drone_id, swarm_id, motor_id", 30, "dev")}
SELECT drone_id, swarm_id, motor_id, tick, since, state, R4(value) AS value FROM stated""")
def rule_motor_anomaly(spark, sf_dir):
    labels = [*LABELS, "motor_id"]
    t = fixtures.telemetry(spark, sf_dir)
    grid = series.on_grid(series.scrape_motors(t), labels, end_us=series.grid_end(t))
    active = rules.evaluate(rules.motor_deviation(grid), rules.RULES["DroneMotorAnomaly"], labels)
    return active.withColumn("value", F.round("value", 4))


@query("rule_health_score_low", f"""WITH {SCORED},
one AS (SELECT drone_id, swarm_id, (us // 5000000 + 1) * 5000000 AS sample_us, arg_max(overall_score, us) * 100 AS value
  FROM scored GROUP BY drone_id, swarm_id, us // 5000000),
{grid_sql("one", "drone_id, swarm_id")}, {state_sql("value < 50", "drone_id, swarm_id", 60)}
SELECT drone_id, swarm_id, tick, since, state, R4(value) AS value FROM stated""")
def rule_health_score_low(spark, sf_dir):
    scores = scored(spark, sf_dir).withColumn("drone_health_score", F.col("overall_score") * 100)
    samples = series.scrape(scores, ["drone_health_score"]).drop("metric")
    end = series.grid_end(fixtures.telemetry(spark, sf_dir))
    active = rules.evaluate(series.on_grid(samples, LABELS, end_us=end), rules.RULES["DroneHealthScoreLow"], LABELS)
    return active.withColumn("value", F.round("value", 4))


# Metrics of all thirteen rules: those that drones report, and others derived from them by a factor.
REPORTED = ["battery_percent", "altitude_m", "connected"]
DERIVED = {
    "connected_drones": ("drone_battery_percent", 0.05), "inference_latency_seconds": ("drone_altitude_meters", 0.003),
    "drone_motor_deviation": ("drone_altitude_meters", 0.002), "consumer_lag": ("drone_altitude_meters", 90.0),
    "job_restarts": ("drone_battery_percent", 0.03), "job_uptime": ("drone_connected", 1.0),
    "checkpoint_failures_increase": ("drone_connected", 2.0), "disk_usage_ratio": ("drone_battery_percent", 0.01),
    "drone_health_score": ("drone_battery_percent", 0.8),
}
ALL_LABELS = ["drone_id", "swarm_id", "motor_id", "group", "job_name"]


def _text(value):
    return "'" + value.replace("'", "''") + "'"


_RULE_VALUES = "(VALUES " + ", ".join(
    f"('{r.alert}', '{r.metric}', '{r.op}', {r.threshold}, {r.for_s}, '{r.severity}', '{r.team}', {_text(r.summary)}, {_text(r.description)})"
    for r in rules.RULES.values()
) + ") AS r(alert, metric, op, threshold, for_s, severity, team, summary_template, description_template)"
_DERIVED_VALUES = "(VALUES " + ", ".join(f"('{m}', '{source}', {factor}::DOUBLE)" for m, (source, factor) in DERIVED.items()) + \
    ") AS d(derived, metric, factor)"
_FILLED = """replace(replace(replace(replace(replace(replace(replace({t}, '{{drone_id}}', drone_id), '{{swarm_id}}', swarm_id),
  '{{motor_id}}', 'motor_1'), '{{group}}', 'group ' || swarm_id), '{{job_name}}', 'job ' || swarm_id),
  '{{percentage}}', R2(value * 100)::VARCHAR || '%'), '{{value}}', R2(value)::VARCHAR)"""


@query("all_threshold_rules", f"""WITH {SAMPLES}, {grid_sql("sample", "metric, drone_id, swarm_id")},
every AS (
  SELECT metric, drone_id, swarm_id, tick, value FROM grid
  UNION ALL SELECT derived, drone_id, swarm_id, tick, value * factor FROM grid JOIN {_DERIVED_VALUES} USING (metric)),
ruled AS (SELECT g.*, r.* EXCLUDE (metric) FROM every g JOIN {_RULE_VALUES} ON g.metric = r.metric),
{state_sql("(op = '<' AND value < threshold) OR (op = '>' AND value > threshold) OR (op = '==' AND value = threshold)", "alert, drone_id, swarm_id", "for_s", "ruled")}
SELECT alert, drone_id, swarm_id, tick, state, severity, team, {_FILLED.format(t="summary_template")} AS summary,
  {_FILLED.format(t="description_template")} AS description
FROM stated""")
def all_threshold_rules(spark, sf_dir):
    t = fixtures.telemetry(spark, sf_dir)
    grid = series.on_grid(series.scrape(t, REPORTED), ["metric", *LABELS], end_us=series.grid_end(t))
    entries = [F.struct(F.lit(m).alias("metric"), F.lit(source).alias("source"), F.lit(factor).alias("factor"))
               for m, (source, factor) in DERIVED.items()]
    derived = grid.withColumn("_d", F.explode(F.filter(F.array(*entries), lambda e: e["source"] == F.col("metric")))).withColumns(
        {"metric": F.col("_d.metric"), "value": F.col("value") * F.col("_d.factor")}).drop("_d")
    labelled = grid.unionByName(derived).withColumns({
        "motor_id": F.lit("motor_1"), "group": F.concat(F.lit("group "), "swarm_id"), "job_name": F.concat(F.lit("job "), "swarm_id")})
    active = rules.evaluate_all(labelled, list(rules.RULES.values()), ALL_LABELS)
    return active.select("alert", *LABELS, "tick", "state", "severity", "team", "summary", "description")


COUNTERS = EVENTS + """,
per AS (
  SELECT swarm_id AS job_name, (us // 5000000 + 1) * 5000000 AS sample_us, count(*) FILTER (event_type = 'error') AS errors, count(*) AS total
  FROM ev GROUP BY 1, 2),
counter AS (
  SELECT job_name, sample_us, (sum(errors) OVER w % 50)::DOUBLE AS value, sum(errors) OVER w::DOUBLE AS used, sum(total) OVER w::DOUBLE AS total
  FROM per WINDOW w AS (PARTITION BY job_name ORDER BY sample_us))"""


def counters(spark, sf_dir):
    """A counter per swarm that restarts at 50, and two that do not; one row per scrape."""
    at = (series.floor_to("us", 5) + 5 * series.SECOND).alias("sample_us")
    per = fixtures.timed_events(spark, sf_dir).groupBy(F.col("swarm_id").alias("job_name"), at).agg(
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("total")
    )
    running = Window.partitionBy("job_name").orderBy("sample_us")
    return per.select(
        "job_name", "sample_us", (F.sum("errors").over(running) % 50).cast("double").alias("value"),
        F.sum("errors").over(running).cast("double").alias("used"), F.sum("total").over(running).cast("double").alias("total"),
    )


@query("rule_job_restarting", f"""WITH {COUNTERS}, {grid_sql("counter", "job_name")}, {state_sql("value > 2", "job_name", 60)}
SELECT job_name, tick, since, state, value FROM stated""")
def rule_job_restarting(spark, sf_dir):
    grid = series.on_grid(counters(spark, sf_dir), ["job_name"])
    return rules.evaluate(grid, rules.RULES["JobRestarting"], ["job_name"])


@query("rule_job_down", f"""WITH {COUNTERS}, up AS (SELECT job_name, sample_us, floor(value / 10) AS value FROM counter),
{grid_sql("up", "job_name")}, {state_sql("value = 0", "job_name", 30)}
SELECT job_name, tick, since, state, value FROM stated""")
def rule_job_down(spark, sf_dir):
    up = counters(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    return rules.evaluate(series.on_grid(up, ["job_name"]), rules.RULES["JobDown"], ["job_name"])


_INCREASE = COUNTERS + """,
steps AS (
  SELECT job_name, sample_us, value, lag(value) OVER (PARTITION BY job_name ORDER BY sample_us) AS before FROM counter),
grown AS (
  SELECT job_name, sample_us, sum(CASE WHEN before IS NULL THEN 0e0 WHEN value < before THEN value ELSE value - before END)
    OVER (PARTITION BY job_name ORDER BY sample_us RANGE 300000000 PRECEDING) AS increase
  FROM steps)"""


@query("counter_increase", f"WITH {_INCREASE} SELECT job_name, sample_us, increase FROM grown")
def counter_increase(spark, sf_dir):
    return series.increase(counters(spark, sf_dir), ["job_name"]).select("job_name", "sample_us", "increase")


@query("rule_checkpoint_failed", f"""WITH {_INCREASE}, inc AS (SELECT job_name, sample_us, increase AS value FROM grown),
{grid_sql("inc", "job_name")}, {state_sql("value > 0", "job_name", 0)}
SELECT job_name, tick, since, state, value FROM stated""")
def rule_checkpoint_failed(spark, sf_dir):
    grown = series.increase(counters(spark, sf_dir), ["job_name"]).select(
        "job_name", "sample_us", F.col("increase").alias("value")
    )
    return rules.evaluate(series.on_grid(grown, ["job_name"]), rules.RULES["CheckpointFailed"], ["job_name"])


_RATIO = COUNTERS + f""",
u AS (SELECT job_name, sample_us, used AS value FROM counter), v AS (SELECT job_name, sample_us, total AS value FROM counter),
{grid_sql("u", "job_name", "gu")}, {grid_sql("v", "job_name", "gv")},
ratio AS (SELECT job_name, tick, gu.value / gv.value AS value FROM gu JOIN gv USING (job_name, tick) WHERE gv.value <> 0)"""


@query("series_ratio", f"""WITH {_RATIO} SELECT job_name, tick, R4(value) AS value, R2(value * 100)::VARCHAR || '%' AS text FROM ratio""")
def series_ratio(spark, sf_dir):
    return _ratio(spark, sf_dir).select("job_name", "tick", F.round("value", 4).alias("value"),
                                        rules.percentage("value").alias("text"))


def _ratio(spark, sf_dir):
    c = counters(spark, sf_dir)
    used = series.on_grid(c.select("job_name", "sample_us", F.col("used").alias("value")), ["job_name"])
    total = series.on_grid(c.select("job_name", "sample_us", F.col("total").alias("value")), ["job_name"])
    return series.combine(used, total, ["job_name"], "ratio")


@query("rule_usage_high", f"""WITH {_RATIO}, {state_sql("value > 18e-2", "job_name", 60, "ratio")}
SELECT job_name, tick, since, state, R4(value) AS value FROM stated""")
def rule_usage_high(spark, sf_dir):
    rule = replace(rules.RULES["DiskUsageHigh"], threshold=0.18, for_s=60)
    return rules.evaluate(_ratio(spark, sf_dir), rule, ["job_name"]).withColumn("value", F.round("value", 4))


OFFSETS = EVENTS + """,
log AS (
  SELECT user_id % 6 AS partition, us, row_number() OVER (PARTITION BY user_id % 6 ORDER BY us, event_id) - 1 AS "offset" FROM ev),
head AS (
  SELECT partition, (us // 5000000 + 1) * 5000000 AS sample_us, max("offset")::DOUBLE AS value FROM log GROUP BY 1, 2),
done AS (SELECT partition, sample_us, value - partition * 20 AS value FROM head)"""


def offsets(spark, sf_dir):
    """Highest offset per partition and scrape."""
    e = fixtures.timed_events(spark, sf_dir).withColumn("partition", F.col("user_id") % 6)
    log = with_history(e, ["partition"], "us", "event_id", position="pos")
    at = (series.floor_to("us", 5) + 5 * series.SECOND).alias("sample_us")
    return log.groupBy("partition", at).agg((F.max("pos") - 1).cast("double").alias("value"))


@query("rule_consumer_lag", f"""WITH {OFFSETS}, {grid_sql("head", "partition", "gh")}, {grid_sql("done", "partition", "gd")},
lag AS (SELECT partition, tick, gh.value - gd.value AS value FROM gh JOIN gd USING (partition, tick)),
{state_sql("value > 50", "partition", 300, "lag")}
SELECT partition, tick, since, state, value FROM stated""")
def rule_consumer_lag(spark, sf_dir):
    head = offsets(spark, sf_dir)
    done = head.withColumn("value", F.col("value") - F.col("partition") * 20)
    lag = series.combine(series.on_grid(head, ["partition"]), series.on_grid(done, ["partition"]), ["partition"], "difference")
    rule = replace(rules.RULES["ConsumerLag"], threshold=50.0)
    return rules.evaluate(lag, rule, ["partition"])


# Every rule over the series that its own operators give. Limits that these tables never reach are lowered.
LOWERED = [replace(r, threshold={"SwarmDroneCountLow": 140.0, "ConsumerLag": 50.0, "DiskUsageHigh": 0.18}.get(r.alert, r.threshold))
           for r in rules.RULES.values()]
_LOWERED_VALUES = "(VALUES " + ", ".join(
    f"('{r.alert}', '{r.metric}', '{r.op}', {r.threshold}::DOUBLE, {r.for_s}, '{r.severity}', '{r.team}', {_text(r.summary)}, {_text(r.description)})"
    for r in LOWERED) + ") AS r(alert, metric, op, threshold, for_s, severity, team, summary_template, description_template)"


def _series_of(metric: str, source: str, *labels: str, value: str = "value") -> str:
    named = [f"{label}::VARCHAR AS {label}" if label in labels else f"NULL::VARCHAR AS {label}" for label in ALL_LABELS]
    return f"SELECT '{metric}' AS metric, {', '.join(named)}, tick, {value}::DOUBLE AS value FROM {source}"


def _filled(template: str) -> str:
    text = template
    for label in ALL_LABELS:
        text = f"replace({text}, '{{{label}}}', coalesce({label}, ''))"
    return f"replace(replace({text}, '{{percentage}}', R2(value * 100)::VARCHAR || '%'), '{{value}}', R2(value)::VARCHAR)"


_DRONE, _JOB = ("drone_id", "swarm_id"), ("job_name",)
_EVERY_SERIES = f"""WITH {SCORED}{SAMPLES[len(TELEMETRY):]}, one AS (SELECT * FROM sample WHERE metric IN ('drone_battery_percent', 'drone_altitude_meters')),
{grid_sql("one", "metric, drone_id, swarm_id", "g_gauge")}{CONNECTED[len(TELEMETRY):]},
{grid_sql("link", "drone_id, swarm_id", "g_link")},
fleet AS (SELECT tick, count(*) FILTER (value = 1)::DOUBLE AS value FROM g_link GROUP BY tick), {FRAMES},
lat AS (SELECT drone_id, (us // 15000000 + 1) * 15000000 AS sample_us, sum(latency_s::DECIMAL(18,8))::DOUBLE / count(*) AS value
  FROM frame GROUP BY drone_id, us // 15000000), {grid_sql("lat", "drone_id", "g_lat")},
motor AS (SELECT drone_id, swarm_id, us, unnest(motor_rpm) AS rpm, generate_subscripts(motor_rpm, 1) - 1 AS i FROM tele),
rpm AS (SELECT drone_id, swarm_id, 'motor_' || i AS motor_id, (us // 5000000 + 1) * 5000000 AS sample_us, arg_max(rpm, us) AS value
  FROM motor GROUP BY drone_id, swarm_id, i, us // 5000000), {grid_sql("rpm", "drone_id, swarm_id, motor_id", "g_rpm")},
mean AS (SELECT *, avg(value) OVER (PARTITION BY drone_id, swarm_id, tick) AS mu FROM g_rpm),
dev AS (SELECT drone_id, swarm_id, motor_id, tick, CASE WHEN mu <> 0 THEN abs(value - mu) / mu END AS value FROM mean),
health AS (SELECT drone_id, swarm_id, (us // 5000000 + 1) * 5000000 AS sample_us, arg_max(overall_score, us) * 100 AS value
  FROM scored GROUP BY drone_id, swarm_id, us // 5000000), {grid_sql("health", "drone_id, swarm_id", "g_health")}{_RATIO[len(EVENTS):]},
{grid_sql("counter", "job_name", "g_count")}, up AS (SELECT job_name, sample_us, floor(value / 10) AS value FROM counter),
{grid_sql("up", "job_name", "g_up")}{_INCREASE[len(COUNTERS):]}, inc AS (SELECT job_name, sample_us, increase AS value FROM grown),
{grid_sql("inc", "job_name", "g_inc")}{OFFSETS[len(EVENTS):]}, {grid_sql("head", "partition", "gh")}, {grid_sql("done", "partition", "gd")},
lag_of AS (SELECT partition::VARCHAR AS "group", tick, gh.value - gd.value AS value FROM gh JOIN gd USING (partition, tick)),
every AS (
  {_series_of("drone_battery_percent", "g_gauge WHERE metric = 'drone_battery_percent'", *_DRONE)}
  UNION ALL {_series_of("drone_altitude_meters", "g_gauge WHERE metric = 'drone_altitude_meters'", *_DRONE)}
  UNION ALL {_series_of("drone_connected", "g_link", *_DRONE)} UNION ALL {_series_of("connected_drones", "fleet")}
  UNION ALL {_series_of("inference_latency_seconds", "g_lat", "drone_id")}
  UNION ALL {_series_of("drone_motor_deviation", "dev", *_DRONE, "motor_id")}
  UNION ALL {_series_of("drone_health_score", "g_health", *_DRONE)}
  UNION ALL {_series_of("consumer_lag", "lag_of", "group").replace("group::VARCHAR AS group", '"group"')}
  UNION ALL {_series_of("job_restarts", "g_count", *_JOB)} UNION ALL {_series_of("job_uptime", "g_up", *_JOB)}
  UNION ALL {_series_of("checkpoint_failures_increase", "g_inc", *_JOB)} UNION ALL {_series_of("disk_usage_ratio", "ratio", *_JOB)}),
ruled AS (SELECT g.*, r.* EXCLUDE (metric) FROM every g JOIN {_LOWERED_VALUES} ON g.metric = r.metric),
{state_sql("(op = '<' AND value < threshold) OR (op = '>' AND value > threshold) OR (op = '==' AND value = threshold)",
           'alert, drone_id, swarm_id, motor_id, "group", job_name', "for_s", "ruled")}
SELECT alert, drone_id, swarm_id, motor_id, job_name, tick, since, state, severity, {_filled("summary_template")} AS summary,
  {_filled("description_template")} AS description FROM stated"""
_EVERY_SERIES = _EVERY_SERIES.replace("NULL::VARCHAR AS group", 'NULL::VARCHAR AS "group"').replace("coalesce(group, '')", """coalesce("group", '')""")


@query("all_rules_over_own_series", _EVERY_SERIES)
def all_rules_over_own_series(spark, sf_dir):
    """All thirteen rules in one evaluation, each over the series of its own operators."""
    t = fixtures.telemetry(spark, sf_dir)
    end = series.grid_end(t)
    gauges = series.on_grid(series.scrape(t, ["battery_percent", "altitude_m"]), ["metric", *LABELS], end_us=end)
    link = series.on_grid(series.connected_samples(t), LABELS)
    latency = series.on_grid(rules.mean_series(fixtures.frames(spark, sf_dir), ["drone_id"], "latency_s"), ["drone_id"])
    motors = rules.motor_deviation(series.on_grid(series.scrape_motors(t), [*LABELS, "motor_id"], end_us=end))
    scores = scored(spark, sf_dir).withColumn("drone_health_score", F.col("overall_score") * 100)
    health = series.on_grid(series.scrape(scores, ["drone_health_score"]).drop("metric"), LABELS, end_us=end)
    head = offsets(spark, sf_dir)
    done = head.withColumn("value", F.col("value") - F.col("partition") * 20)
    lag = series.combine(series.on_grid(head, ["partition"]), series.on_grid(done, ["partition"]), ["partition"], "difference")
    c = counters(spark, sf_dir)
    counts = series.on_grid(c, ["job_name"])
    up = series.on_grid(c.withColumn("value", F.floor(F.col("value") / 10).cast("double")), ["job_name"])
    grown = series.increase(c, ["job_name"]).select("job_name", "sample_us", F.col("increase").alias("value"))
    every = [
        (gauges, None), (link, "drone_connected"), (rules.connected_count(link), "connected_drones"), (latency, "inference_latency_seconds"),
        (motors, "drone_motor_deviation"), (health, "drone_health_score"),
        (lag.withColumn("group", F.col("partition").cast("string")), "consumer_lag"), (counts, "job_restarts"), (up, "job_uptime"),
        (series.on_grid(grown, ["job_name"]), "checkpoint_failures_increase"), (_ratio(spark, sf_dir), "disk_usage_ratio"),
    ]

    def shaped(grid, metric):
        grid = grid if metric is None else grid.withColumn("metric", F.lit(metric))
        labels = [F.col(c) if c in grid.columns else F.lit(None).cast("string").alias(c) for c in ALL_LABELS]
        return grid.select("metric", *labels, "tick", F.col("value").cast("double").alias("value"))

    grids = reduce(DataFrame.unionByName, [shaped(g, m) for g, m in every])
    active = rules.evaluate_all(grids, LOWERED, ALL_LABELS)
    return active.select("alert", *LABELS, "motor_id", "job_name", "tick", "since", "state", "severity", "summary", "description")


@query("stale_data", f"""WITH {TELEMETRY},
seen AS (SELECT drone_id, us AS sample_us, us::DOUBLE AS value FROM tele WHERE drone_id <> 'drone-0003'),
{grid_sql("seen", "drone_id", lookback=None, end="(SELECT (max(us) + 14999999) // 15000000 * 15000000 FROM tele)")}
SELECT drone_id, tick, R6((tick - sample_us) / 1e6) AS silent_s FROM grid WHERE tick - sample_us >= 60000000""")
def stale_data(spark, sf_dir):
    t = fixtures.telemetry(spark, sf_dir)
    running = t.select("drone_id").filter("drone_id <> 'drone-0003'")
    return rules.stale_data(t, running).withColumn("silent_s", F.round("silent_s", 6))


@query("confidence_drift", f"""WITH {DETECTIONS},
m AS (SELECT us // 10000000 * 10000000 AS start_us, count(*) AS n, sum(conf::DECIMAL(18,6)) AS total FROM det GROUP BY 1),
c AS (SELECT start_us, n, total::DOUBLE / n AS mean, sum(total) OVER w::DOUBLE / sum(n) OVER w AS baseline
  FROM m WINDOW w AS (ORDER BY start_us ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT start_us, n, R4(mean) AS mean_confidence, R4(baseline) AS baseline, R4(mean / baseline) AS ratio,
  coalesce(mean / baseline < 7e-1, false) AS drifted FROM c""")
def confidence_drift(spark, sf_dir):
    d = rules.confidence_drift(fixtures.detections(spark, sf_dir))
    return d.select("start_us", "n", "drifted", *[F.round(c, 4).alias(c) for c in ("mean_confidence", "baseline", "ratio")])


@query("heartbeat_availability", f"""WITH {TELEMETRY},
h AS (SELECT DISTINCT drone_id, (us + 14999999) // 15000000 AS tick FROM tele)
SELECT drone_id, count(*) AS ticks_heard, R4(count(*) / (SELECT max(tick) - min(tick) + 1 FROM h)) AS availability,
  count(*) / (SELECT max(tick) - min(tick) + 1 FROM h) >= 999e-3 AS met FROM h GROUP BY drone_id""")
def heartbeat_availability(spark, sf_dir):
    return rules.availability(fixtures.telemetry(spark, sf_dir)).withColumn("availability", F.round("availability", 4))


@query("retention", f"WITH {TELEMETRY} SELECT drone_id, count(*) AS n FROM tele WHERE us >= (SELECT max(us) FROM tele) - 300000000 GROUP BY drone_id")
def retention(spark, sf_dir):
    return series.retain(fixtures.telemetry(spark, sf_dir), 300).groupBy("drone_id").agg(F.count(F.lit(1)).alias("n"))
