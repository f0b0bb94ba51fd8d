"""Fleet metrics, lookups, commands and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import fixtures
from fleetlens.operators import commands, fleet, lookups, normalise
from fleetlens.plans.catalog.base import DETECTIONS, EVENTS, TELEMETRY, query
from fleetlens.session import written

FRAMES = DETECTIONS + """,
frame AS (
  SELECT frame_no, drone_id, min(us) AS us, 'yolov26s' AS model_name,
    ['ULTRA_FAST', 'FAST', 'BALANCED', 'ACCURATE'][frame_no % 4 + 1] AS speed_mode,
    1e-2 + (frame_no % 60) * 1e-2 AS latency_s, 1e0 / (1e-2 + (frame_no % 60) * 1e-2) AS fps
  FROM det GROUP BY frame_no, drone_id)"""

CLASSES = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(lookups.CLASS_NAMES)) + ") AS classes(cls_id, class_name)"

_GAUGE_SQL = " UNION ALL ".join(
    f"SELECT drone_id, swarm_id, '{metric}' AS metric, arg_max({field}::DOUBLE, us) AS value FROM tele GROUP BY drone_id, swarm_id"
    for field, metric in fleet.GAUGES.items()
)


@query("latest_gauges", f"WITH {TELEMETRY}, g AS ({_GAUGE_SQL}) SELECT drone_id, swarm_id, metric, R4(value) AS value FROM g")
def latest_gauges(spark, sf_dir):
    return fleet.gauges(fixtures.telemetry(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query("motor_gauges", f"""WITH {TELEMETRY},
m AS (SELECT drone_id, swarm_id, us, unnest(motor_rpm) AS rpm, generate_subscripts(motor_rpm, 1) - 1 AS motor FROM tele)
SELECT drone_id, swarm_id, 'motor_' || motor AS motor_id, arg_max(rpm, us) AS value FROM m GROUP BY drone_id, swarm_id, motor""")
def motor_gauges(spark, sf_dir):
    return fleet.motor_gauges(fixtures.telemetry(spark, sf_dir))


_LE = " UNION ALL ".join(
    [f"SELECT drone_id, model_name, speed_mode, '{b}' AS le, count(*) FILTER (latency_s <= {b}::DOUBLE) AS n, "
     "sum(latency_s) AS latency_sum, count(*) AS latency_count FROM frame GROUP BY ALL" for b in fleet.LATENCY_BOUNDS]
    + ["SELECT drone_id, model_name, speed_mode, '+Inf' AS le, count(*) AS n, sum(latency_s) AS latency_sum, "
       "count(*) AS latency_count FROM frame GROUP BY ALL"]
)


@query("latency_histogram", f"WITH {FRAMES}, h AS ({_LE}) SELECT * EXCLUDE (latency_sum), R4(latency_sum) AS latency_sum FROM h")
def latency_histogram(spark, sf_dir):
    h = fleet.latency_histogram(fixtures.frames(spark, sf_dir))
    return h.withColumn("latency_sum", F.round("latency_sum", 4))


@query("latest_fps", f"""WITH {FRAMES}
SELECT drone_id, model_name, R4(arg_max(fps, frame_no)) AS fps FROM frame GROUP BY drone_id, model_name""")
def latest_fps(spark, sf_dir):
    return fleet.latest_fps(fixtures.frames(spark, sf_dir), "frame_no").withColumn("fps", F.round("fps", 4))


@query("active_drones", f"""WITH {TELEMETRY},
seen AS (SELECT drone_id, arg_max(swarm_id, us) AS swarm_id, max(us) AS last_us FROM tele GROUP BY drone_id)
SELECT swarm_id, count(*) FILTER ((SELECT max(us) FROM tele) - last_us < 30000000) AS active_drones
FROM seen GROUP BY swarm_id""")
def active_drones(spark, sf_dir):
    return fleet.swarm_status(fixtures.telemetry(spark, sf_dir)).select("swarm_id", "active_drones")


@query("connection_state", f"""WITH {TELEMETRY},
seen AS (SELECT drone_id, arg_max(swarm_id, us) AS swarm_id, max(us) AS last_seen_us, arg_max(connected, us) AS c FROM tele GROUP BY drone_id)
SELECT drone_id, swarm_id, last_seen_us,
  CASE WHEN (SELECT max(us) FROM tele) - last_seen_us < 30000000 AND c THEN 1 ELSE 0 END AS connected FROM seen""")
def connection_state(spark, sf_dir):
    return fleet.connection_state(fixtures.telemetry(spark, sf_dir))


@query("swarm_health", f"""WITH {TELEMETRY},
seen AS (
  SELECT drone_id, arg_max(swarm_id, us) AS swarm_id, max(us) AS last_us,
    4e-1 * least(arg_max(battery_percent, us) / 100e0, 1e0) + 3e-1 * least((arg_max(signal_dbm, us) + 100e0) / 60e0, 1e0)
      + 3e-1 * greatest(1e0 - greatest((arg_max(temperature_c, us) - 60e0) / 40e0, 0e0), 0e0) AS score
  FROM tele GROUP BY drone_id)
SELECT swarm_id, R3(avg(score) FILTER ((SELECT max(us) FROM tele) - last_us < 30000000)) AS health_score
FROM seen GROUP BY swarm_id""")
def swarm_health(spark, sf_dir):
    return fleet.swarm_status(fixtures.telemetry(spark, sf_dir)).select("swarm_id", "health_score")


@query("service_summary", f"WITH {FRAMES} SELECT count(*) AS requests_served, R1(avg(latency_s) * 1000) AS avg_latency_ms FROM frame")
def service_summary(spark, sf_dir):
    return fleet.service_summary(fixtures.frames(spark, sf_dir))


@query("latency_quantiles", f"""WITH {FRAMES}
SELECT speed_mode, R4(quantile_cont(latency_s, 0.5)) AS p50, R4(quantile_cont(latency_s, 0.95)) AS p95,
  R4(quantile_cont(latency_s, 0.99)) AS p99 FROM frame GROUP BY speed_mode""")
def latency_quantiles(spark, sf_dir):
    q = fleet.exact_quantiles(fixtures.frames(spark, sf_dir), "latency_s", ["speed_mode"])
    return q.select("speed_mode", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


def _between(q: float, name: str) -> str:
    low, high = (f"max(CASE WHEN rn = {way}({q} * (n - 1)) THEN v END)" for way in ("floor", "ceil"))
    share = f"max({q} * (n - 1) - floor({q} * (n - 1)))"
    return (f"CASE WHEN ({low} = {high} OR {share} = 0) AND isfinite({low}) THEN R4({low}) WHEN {low} = {high} OR {share} = 0 THEN {low} "
            f"WHEN isinf({high}) THEN {high} WHEN isinf({low}) THEN {low} ELSE R4({low} + ({high} - {low}) * {share}) END AS {name}")


@query("latency_quantiles_not_finite", f"""WITH {FRAMES},
odd AS (SELECT speed_mode, CASE frame_no % 25 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN NULL
  ELSE latency_s END AS v FROM frame),
ranked AS (SELECT speed_mode, v, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY speed_mode) AS n
  FROM odd WHERE NOT isnan(v) WINDOW w AS (PARTITION BY speed_mode ORDER BY v)),
found AS (SELECT speed_mode, {_between(0.02, "p2")}, {_between(0.5, "p50")}, {_between(0.97, "p97")} FROM ranked GROUP BY speed_mode)
SELECT speed_mode, p2, p50, p97 FROM found""")
def latency_quantiles_not_finite(spark, sf_dir):
    part = F.col("frame_no") % 25
    odd = F.when(part == 0, F.lit(float("inf"))).when(part == 1, F.lit(float("-inf"))).when(part == 2, F.lit(float("nan"))).when(
        part != 3, F.col("latency_s"))
    frames = fixtures.frames(spark, sf_dir).withColumn("latency_s", odd)
    q = fleet.exact_quantiles(frames, "latency_s", ["speed_mode"], at=(0.02, 0.5, 0.97))
    return q.select("speed_mode", *[F.round(c, 4).alias(c) for c in ("p2", "p50", "p97")])


@query("latency_quantiles_sketch", f"""WITH {FRAMES}
SELECT speed_mode, R4(quantile_disc(latency_s, 0.5)) AS p50, R4(quantile_disc(latency_s, 0.95)) AS p95,
  R4(quantile_disc(latency_s, 0.99)) AS p99 FROM frame GROUP BY speed_mode""")
def latency_quantiles_sketch(spark, sf_dir):
    q = fleet.quantiles(fixtures.frames(spark, sf_dir), "latency_s", ["speed_mode"])
    return q.select("speed_mode", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


_RANKED = "sum(n) AS n, true AS p50_in_rank, true AS p95_in_rank, true AS p99_in_rank"


@query("latency_quantiles_merged", f"""WITH {TELEMETRY}, per AS (SELECT drone_id, swarm_id, count(*) AS n FROM tele GROUP BY ALL)
SELECT drone_id AS scope, {_RANKED} FROM per GROUP BY drone_id UNION ALL SELECT swarm_id, {_RANKED} FROM per GROUP BY swarm_id
UNION ALL SELECT 'fleet', {_RANKED} FROM per""")
def latency_quantiles_merged(spark, sf_dir):
    """Sketches per drone and ten seconds, merged up to drones, swarms and the fleet. What is checked is the rank: the
    rows below a quantile and those up to it must enclose its place, give or take a hundredth of the rows."""
    t = fixtures.telemetry(spark, sf_dir).select("drone_id", "swarm_id", "us", F.col("altitude_m").alias("v"))
    sketches = written(fleet.quantile_sketches(t, "v", ["drone_id", "swarm_id"], 10.0), "sketches")
    levels = [("drone_id", F.col("drone_id")), ("swarm_id", F.col("swarm_id")), ("fleet", F.lit("fleet"))]
    out = []
    for _, scope in levels:
        found = fleet.merged_quantiles(sketches.withColumn("scope", scope), ["scope"])
        placed = t.withColumn("scope", scope).join(found, "scope").groupBy("scope", "n").agg(*[
            (F.count_if(F.col("v") < F.col(f"p{q}")) <= F.first("n") * (q / 100 + 0.01) + 1).alias(f"low{q}") for q in (50, 95, 99)], *[
            (F.count_if(F.col("v") <= F.col(f"p{q}")) >= F.first("n") * (q / 100 - 0.01) - 1).alias(f"high{q}") for q in (50, 95, 99)])
        out.append(placed.select("scope", "n", *[(F.col(f"low{q}") & F.col(f"high{q}")).alias(f"p{q}_in_rank") for q in (50, 95, 99)]))
    return out[0].unionByName(out[1]).unionByName(out[2])


_STATUS = """,
last AS (SELECT drone_id, arg_max(battery_percent, us) AS b, arg_max(altitude_m, us) AS a FROM tele GROUP BY drone_id),
status AS (
  SELECT drone_id, printf('%s: bat=%.0f%% alt=%.1fm', drone_id, R0(b), R1(a)) AS status FROM last)"""


@query("drone_status", f"WITH {TELEMETRY}{_STATUS} SELECT drone_id, status FROM status")
def drone_status(spark, sf_dir):
    return fleet.drone_status(fixtures.telemetry(spark, sf_dir)).select("drone_id", "status")


@query("status_lines", f"""WITH {TELEMETRY}{_STATUS}
SELECT left(drone_id, len(drone_id) - 2) AS line, string_agg(status, ' | ' ORDER BY status) AS status_line
FROM status GROUP BY line""")
def status_lines(spark, sf_dir):
    hundred = F.expr("substring(drone_id, 1, length(drone_id) - 2)")
    return fleet.status_lines(fixtures.telemetry(spark, sf_dir), hundred)


@query("targets_in_view", f"""WITH {DETECTIONS}
SELECT det_id, drone_id, frame_no FROM det
WHERE (drone_id, frame_no) IN (SELECT drone_id, max(frame_no) FROM det GROUP BY drone_id)""")
def targets_in_view(spark, sf_dir):
    return fleet.targets_in_view(fixtures.detections(spark, sf_dir)).select("det_id", "drone_id", "frame_no")


@query("target_summary", f"""WITH {DETECTIONS}
SELECT drone_id, string_agg('#' || det_idx || ' ' || class_name || CASE WHEN det_idx = 3 THEN ' (LOCKED)' ELSE '' END, ', ' ORDER BY det_idx) AS targets
FROM det JOIN {CLASSES} USING (cls_id)
WHERE (drone_id, frame_no) IN (SELECT drone_id, max(frame_no) FROM det GROUP BY drone_id) GROUP BY drone_id""")
def target_summary(spark, sf_dir):
    named = lookups.with_class_name(fixtures.detections(spark, sf_dir), lookups.class_table(spark))
    view = fleet.targets_in_view(named).withColumn("track_id", F.col("det_idx"))
    return fleet.target_summary(view, locked_id=3)


@query("class_lookup", f"""WITH {DETECTIONS}
SELECT coalesce(class_name, 'unknown') AS class_name, count(*) AS n
FROM (SELECT * REPLACE (cls_id + det_idx // 7 * 5 AS cls_id) FROM det) d LEFT JOIN {CLASSES} USING (cls_id) GROUP BY 1""")
def class_lookup(spark, sf_dir):
    d = fixtures.detections(spark, sf_dir).withColumn("cls_id", F.col("cls_id") + F.expr("det_idx div 7") * 5)
    return lookups.with_class_name(d, lookups.class_table(spark)).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


_MODES = "(VALUES " + ", ".join(f"('{m}', {i}, {r}, {c}, {o}::DOUBLE, {f})" for m, i, r, c, o, f in lookups.SPEED_MODES) + \
    ") AS modes(config_mode, imgsz, tile_rows, tile_cols, overlap, target_fps)"


@query("speed_config", f"""WITH {FRAMES},
f AS (SELECT frame_no, CASE WHEN frame_no % 9 = 0 THEN 'CUSTOM' ELSE speed_mode END AS speed_mode FROM frame)
SELECT frame_no, speed_mode, config_mode, imgsz::BIGINT AS imgsz, tile_rows::BIGINT AS tile_rows,
  tile_cols::BIGINT AS tile_cols, overlap, target_fps::BIGINT AS target_fps
FROM f JOIN {_MODES} ON config_mode = CASE WHEN speed_mode = 'CUSTOM' THEN 'FAST' ELSE speed_mode END""")
def speed_config(spark, sf_dir):
    f = fixtures.frames(spark, sf_dir).select("frame_no", "speed_mode")
    f = f.withColumn("speed_mode", F.when(F.col("frame_no") % 9 == 0, "CUSTOM").otherwise(F.col("speed_mode")))
    return lookups.with_speed_config(f, lookups.speed_table(spark))


COMMANDS = EVENTS + """,
cmd AS (
  SELECT event_id, drone_id, us, ['land', 'return_home', 'hover', 'patrol'][event_id % 4 + 1] AS command
  FROM ev WHERE event_type = 'purchase'),
side AS (SELECT event_id, drone_id, us FROM ev WHERE event_type <> 'purchase')"""

_MODE_SQL = """CASE command WHEN 'land' THEN 'emergency' WHEN 'return_home' THEN 'return_home' WHEN 'hover' THEN 'idle'
  WHEN 'patrol' THEN 'patrol' WHEN 'engage_target' THEN 'follow' ELSE 'unknown' END"""


@query("command_modes", f"WITH {COMMANDS} SELECT event_id, drone_id, command, {_MODE_SQL} AS mode FROM cmd")
def command_modes(spark, sf_dir):
    c = fixtures.commands(spark, sf_dir)
    return c.select("event_id", "drone_id", "command", commands.command_mode("command").alias("mode"))


@query("current_mode", f"WITH {COMMANDS} SELECT drone_id, arg_max({_MODE_SQL}, us) AS mode FROM cmd GROUP BY drone_id")
def current_mode(spark, sf_dir):
    return commands.current_mode(fixtures.commands(spark, sf_dir))


_ASOF = COMMANDS + """,
matched AS (
  SELECT c.event_id, c.drone_id, c.us, s.event_id AS telemetry_id, (c.us - s.us) / 1000e0 AS latency_ms
  FROM cmd c ASOF LEFT JOIN side s ON c.drone_id = s.drone_id AND c.us >= s.us)"""


@query("command_latency", f"WITH {_ASOF} SELECT event_id, drone_id, telemetry_id, R3(latency_ms) AS latency_ms FROM matched")
def command_latency(spark, sf_dir):
    m = commands.command_latency(fixtures.commands(spark, sf_dir), fixtures.command_side_telemetry(spark, sf_dir))
    return m.select("event_id", "drone_id", F.col("telemetry.event_id").alias("telemetry_id"),
                    F.round("latency_ms", 3).alias("latency_ms"))


@query("command_latency_slo", f"""WITH {_ASOF}
SELECT R3(quantile_cont(latency_ms, 0.95)) AS p95, quantile_cont(latency_ms, 0.95) <= 200 AS met FROM matched""")
def command_latency_slo(spark, sf_dir):
    m = commands.command_latency(fixtures.commands(spark, sf_dir), fixtures.command_side_telemetry(spark, sf_dir))
    q = fleet.exact_quantiles(m, "latency_ms", at=[0.95])
    return q.select(F.round("p95", 3).alias("p95"), (F.col("p95") <= 200).alias("met"))


@query("battery_events", f"""WITH {TELEMETRY}
SELECT event_id, drone_id, CASE WHEN battery_percent < 10 THEN 'critical_battery' ELSE 'low_battery' END AS event_type,
  'Battery at ' || R2(battery_percent)::VARCHAR || '%' AS details FROM tele WHERE battery_percent < 20""")
def battery_events(spark, sf_dir):
    t = fixtures.telemetry(spark, sf_dir)
    events = commands.battery_events(t)
    # the bridge reports the percentage with two digits
    return events.withColumn(
        "details", F.concat(F.lit("Battery at "), F.round("battery_percent", 2).cast("string"), F.lit("%"))
    ).select("event_id", "drone_id", "event_type", "details")


@query("threats", f"""WITH {TELEMETRY}
SELECT event_id, CASE WHEN battery_percent < 20 AND NOT connected THEN 'THREATS: [''CRITICAL BATTERY'', ''DISCONNECTED'']'
  WHEN battery_percent < 20 THEN 'THREATS: [''CRITICAL BATTERY'']' WHEN NOT connected THEN 'THREATS: [''DISCONNECTED'']'
  ELSE 'No immediate threats.' END AS threat_text FROM tele""")
def threats(spark, sf_dir):
    return commands.threats(fixtures.telemetry(spark, sf_dir)).select("event_id", "threat_text")


def _routing(name, rules, tool_calls):
    cases = " ".join(
        f"WHEN {' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)} THEN '{target}'" for target, words in rules
    )
    tools = "WHEN role = 'tool' THEN 'tools' " if tool_calls else ""

    @query(name, f"SELECT conv_id, turn, CASE {tools}{cases} ELSE 'end' END AS destination FROM conversations")
    def run(spark, sf_dir):
        has_calls = F.col("role") == "tool" if tool_calls else None
        return fixtures.table(spark, sf_dir, "conversations").select(
            "conv_id", "turn", commands.route("text", rules, has_calls).alias("destination")
        )


_routing("message_routing", commands.ROUTES, False)
_routing("message_routing_tools", commands.TOOL_ROUTES, True)

ENTITY = """,
entity AS (
  SELECT event_id, user_id AS entity_id, (event_id % 1000)::DOUBLE AS x, (event_id % 700)::DOUBLE AS y, value - 5e0 AS z,
    (event_id % 11)::DOUBLE AS vx, (event_id % 7)::DOUBLE AS vy, (event_id % 3)::DOUBLE AS vz, (event_id % 101)::DOUBLE AS battery_level
  FROM ev)"""


def entities(spark, sf_dir):
    eid = F.col("event_id")
    return fixtures.timed_events(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("entity_id"), (eid % 1000).cast("double").alias("x"),
        (eid % 700).cast("double").alias("y"), (F.col("value") - 5.0).alias("z"),
        (eid % 11).cast("double").alias("vx"), (eid % 7).cast("double").alias("vy"), (eid % 3).cast("double").alias("vz"),
        (eid % 101).cast("double").alias("battery_level"), F.lit(22.2).alias("battery_voltage_current"),
        F.array(*[F.lit(8500.0)] * 4).alias("motor_speeds"), (eid % 50 == 0).alias("collided"),
    )


@query("local_frame_telemetry", f"""WITH {EVENTS}{ENTITY}
SELECT event_id, 'drone-' || lpad(entity_id::VARCHAR, greatest(3, len(entity_id::VARCHAR))::INT, '0') AS drone_id, R4(sqrt(vx*vx + vy*vy + vz*vz)) AS velocity_ms,
  R4(greatest(z, 0e0)) AS altitude_m, R6(x * 9e-6) AS latitude, R6(y * 11e-6) AS longitude,
  R4(25e0 + sqrt(vx*vx + vy*vy + vz*vz) * 5e-1) AS temperature_c, R4(-40e0 - greatest(z, 0e0) * 3e-1) AS signal_dbm,
  battery_level > 0 AS connected FROM entity""")
def local_frame_telemetry(spark, sf_dir):
    t = normalise.from_local_frame(entities(spark, sf_dir))
    return t.select("event_id", "drone_id", F.round("velocity_ms", 4).alias("velocity_ms"),
                    F.round("altitude_m", 4).alias("altitude_m"), F.round("latitude", 6).alias("latitude"),
                    F.round("longitude", 6).alias("longitude"), F.round("temperature_c", 4).alias("temperature_c"),
                    F.round("signal_dbm", 4).alias("signal_dbm"), "connected")


@query("axis_mapping", f"""WITH {EVENTS}{ENTITY} SELECT event_id, R4(-z) AS z, event_id % 50 <> 0 AS connected FROM entity""")
def axis_mapping(spark, sf_dir):
    return normalise.map_axes(entities(spark, sf_dir)).select("event_id", F.round("z", 4).alias("z"), "connected")


@query("insert_if_absent", """
SELECT name, sum(n)::BIGINT AS n FROM (
  SELECT DISTINCT o_orderpriority AS name, 1 AS n FROM orders WHERE o_totalprice > 200000
  UNION SELECT DISTINCT event_type, 1 FROM events
  UNION SELECT DISTINCT o_orderpriority, 1 FROM orders) GROUP BY name""")
def insert_if_absent(spark, sf_dir):
    orders = fixtures.table(spark, sf_dir, "orders")
    existing = orders.filter("o_totalprice > 200000").select(F.col("o_orderpriority").alias("name")).distinct()
    wanted = orders.select(F.col("o_orderpriority").alias("name")).union(
        fixtures.table(spark, sf_dir, "events").select("event_type")
    )
    return lookups.insert_if_absent(existing, wanted, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
