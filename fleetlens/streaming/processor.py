"""The one stateful Python step: previous record and alert cooldown per drone.

Spark keys and shuffles the stream, keeps the state and expires it. A call of the step costs tens of milliseconds and a
row handed to it as pandas tens of microseconds, however little is done with them. So drones are keyed by a bucket, and a
task packs its records of a bucket into one row; the step judges all drones of a bucket at once, as arrays.
Scores, flags and alert rows are columns again afterwards, shared with the batch path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from fleetlens.operators.anomalies import (
    CV_CRITICAL, CV_LIMIT, DRAIN_CRITICAL, DRAIN_LIMIT, GPS_MAX_VELOCITY, GPS_SPEED_LIMIT, HEAT_CRITICAL, HEAT_LIMIT,
    METERS_PER_DEGREE, MIN_STEP_S, STATE_TTL_S,
)
from fleetlens.operators.cooldown import CRITICAL_S, WARNING_S

PREV = ["prev_us", "prev_battery", "prev_lat", "prev_lon"]
#: ``emitted`` has a bit for each of ``KINDS``.
ADDED = "prev_us bigint, prev_battery double, prev_lat double, prev_lon double, late boolean, emitted int"
KINDS = ["rapid_battery_drain", "motor_imbalance", "gps_drift", "overheating"]
#: Keys of the state; records and bytes that a task packs at a time, and records of a packed row of results.
BUCKETS = 256
PACK_ROWS, PACK_BYTES, RESULT_ROWS = 65_536, 16_000_000, 8192
_BUCKET, _PACKED = "_bucket", "_bucket int, packed binary"


def _bytes_of(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _table_of(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per bucket and so many records, with the records as an Arrow stream."""
    def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some)
        bucket = table[_BUCKET].to_numpy()
        order = np.argsort(bucket, kind="stable")
        rows = table.drop_columns(_BUCKET).take(pa.array(order)).combine_chunks()
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = np.append(starts[1:], len(order))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[order][starts], pa.int32()), pa.array([_bytes_of(rows.slice(a, b - a)) for a, b in zip(starts, ends)], pa.binary())],
            [_BUCKET, "packed"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= PACK_ROWS or sum(b.nbytes for b in waiting) >= PACK_BYTES:
            yield packed(waiting)
            waiting = []
    if waiting:
        yield packed(waiting)


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in batch.column(0):
            yield from _table_of(one.as_py()).to_batches()


def with_drone_state(telemetry: DataFrame, ttl_ms: int = STATE_TTL_S * 1000) -> DataFrame:
    """A stream with the columns of ``PREV``, ``late`` and ``emitted`` (array of alert types) of :class:`HealthProcessor`."""
    schema = StructType([*telemetry.schema.fields, *StructType.fromDDL(ADDED).fields])
    bucket = F.pmod(F.xxhash64("drone_id"), F.lit(BUCKETS)).cast("int")
    packed = telemetry.withColumn(_BUCKET, bucket).mapInArrow(_pack, _PACKED)
    stated = packed.groupBy(_BUCKET).transformWithStateInPandas(HealthProcessor(ttl_ms), "packed binary", "Append", "ProcessingTime")
    rows = stated.mapInArrow(_unpack, schema)
    kinds = [F.when(F.col("emitted").bitwiseAND(1 << i) != 0, F.lit(kind)) for i, kind in enumerate(KINDS)]
    return rows.withColumn("emitted", F.array_compact(F.array(*kinds)))


class DroneStates:
    """What is kept of the drones of a bucket: last record, drain rate and last alerts, each with the time it expires."""

    FIELDS = {"us": np.int64, "battery": float, "lat": float, "lon": float, "until": np.int64, "rate": float, "rate_until": np.int64,
              **{f"last_{k}": np.int64 for k in KINDS}, **{f"until_{k}": np.int64 for k in KINDS}}

    def __init__(self, stored: bytes | None, now: int) -> None:
        table = _table_of(stored) if stored is not None else None
        self.drones = table["drone"].to_pylist() if table is not None else []
        self.place = {drone: i for i, drone in enumerate(self.drones)}
        self.columns = {name: table[name].to_numpy().copy() if table is not None else np.zeros(0, kind) for name, kind in self.FIELDS.items()}
        self.now = now

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def places(self, drones: list) -> np.ndarray:
        """Where drones are kept; new ones get a place."""
        for drone in drones:
            if self.place.setdefault(drone, len(self.drones)) == len(self.drones):
                self.drones.append(drone)
        for name, kind in self.FIELDS.items():
            self.columns[name] = np.concatenate([self.columns[name], np.zeros(len(self.drones) - len(self.columns[name]), kind)])
        return np.array([self.place[drone] for drone in drones], dtype=np.int64)

    def stored(self) -> bytes:
        """Without drones of which all has expired."""
        alive = np.max([self[n] for n in self.FIELDS if n.startswith(("until", "rate_until"))], axis=0) > self.now
        kept = np.flatnonzero(alive)
        return _bytes_of(pa.table({"drone": pa.array([self.drones[i] for i in kept.tolist()], pa.string()),
                                   **{name: values[kept] for name, values in self.columns.items()}}))


class HealthProcessor(StatefulProcessor):
    """Adds the previous record and the alert types that pass the cooldown to every record.

    A key is a bucket of drones, its rows are packed records. Records of a drone are taken in event-time order within a
    micro-batch. A record older than the drone's state is late: it is passed on without a previous record and does not
    change the state. What is kept of a drone expires by itself, in the bucket's state, which expires with the last of them.
    """

    def __init__(self, ttl_ms: int = STATE_TTL_S * 1000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getValueState("drones", "drones binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        records = pa.concat_tables([_table_of(p) for chunk in rows for p in chunk["packed"]]).combine_chunks()
        stored = self.states.get()
        states = DroneStates(bytes(stored[0]) if stored is not None else None, timer_values.getCurrentProcessingTimeInMs())
        judged = self.judged(records, states)
        self.states.update((states.stored(),))
        yield pd.DataFrame({"packed": [_bytes_of(judged.slice(at, RESULT_ROWS)) for at in range(0, judged.num_rows, RESULT_ROWS)]})

    def judged(self, records: pa.Table, states: DroneStates) -> pa.Table:
        """The records with the added columns, and the states brought up to date."""
        drones = records["drone_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        keyed = pa.table({"drone": drones.indices, "us": records["us"], "event_id": records["event_id"]})
        records = records.take(order := pc.sort_indices(keyed, sort_keys=[(c, "ascending") for c in keyed.column_names]))
        drone = drones.indices.to_numpy()[order.to_numpy()]
        place = states.places(drones.dictionary.to_pylist())[drone]
        us, battery, lat, lon = values = [records["us"].to_numpy(), *(self._floats(records, c) for c in ("battery_percent", "latitude", "longitude"))]

        before = [states[c][place] for c in ("us", "battery", "lat", "lon")]
        known = states["until"][place] > states.now
        late = known & (us < before[0])
        first = np.diff(drone, prepend=-1) != 0  # record of its drone
        head = ~late & (first | np.concatenate(([False], late[:-1])))
        shifted = [np.where(late | head, kept, np.roll(v, 1)) for v, kept in zip(values, before)]
        has_prev = ~late & (~head | known)
        has_prev &= us - shifted[0] < self.ttl_ms * 1000

        drain = self._drain(us, battery, shifted, has_prev)
        emitted = self._cool(us, records, drain, self._drifted(records, values, shifted, has_prev), place, states)

        until = states.now + self.ttl_ms
        last = np.append(first[1:], True) & ~late  # late ones come first
        for name, v in zip(("us", "battery", "lat", "lon"), values):
            states[name][place[last]] = v[last]
        states["until"][place[last]] = until
        rated = ~np.isnan(drain)  # the last value of a drone stays
        states["rate"][place[rated]], states["rate_until"][place[rated]] = drain[rated], until

        for name, v in zip(PREV, shifted):
            records = records.append_column(name, pa.array(v, mask=~has_prev | (v != v)))
        return records.append_column("late", pa.array(late)).append_column("emitted", pa.array(emitted, pa.int32()))

    @staticmethod
    def _floats(records: pa.Table, name: str) -> np.ndarray:
        return pc.cast(records[name], pa.float64()).to_numpy()

    @staticmethod
    def _drain(us, battery, shifted, has_prev) -> np.ndarray:
        later = has_prev & (us > shifted[0])
        dt = np.where(later, (us - shifted[0]) / 1e6, 1.0)
        return np.where(later, (shifted[1] - battery) / dt, np.nan)

    @classmethod
    def _drifted(cls, records, values, shifted, has_prev) -> np.ndarray:
        dlat = np.abs(values[2] - shifted[2]) * METERS_PER_DEGREE
        dlon = np.abs(values[3] - shifted[3]) * METERS_PER_DEGREE
        dt = np.maximum((values[0] - shifted[0]) / 1e6, MIN_STEP_S)
        speed = np.sqrt(dlat * dlat + dlon * dlon) / dt
        return has_prev & (speed > GPS_SPEED_LIMIT) & (cls._floats(records, "velocity_ms") < GPS_MAX_VELOCITY)

    def _cool(self, us, records, drain, drifted, place, states) -> np.ndarray:
        """Bits of the alert types that go out: an alert does if its period has passed since the last one that did."""
        heat, cv = self._floats(records, "temperature_c"), self._floats(records, "rpm_cv")
        kinds = {
            "rapid_battery_drain": (drain > DRAIN_LIMIT, drain >= DRAIN_CRITICAL),
            "motor_imbalance": (cv > CV_LIMIT, cv >= CV_CRITICAL),
            "gps_drift": (drifted, np.zeros(len(us), dtype=bool)),
            "overheating": (heat > HEAT_LIMIT, heat > HEAT_CRITICAL),
        }
        emitted = np.zeros(len(us), dtype=np.int32)
        for bit, kind in enumerate(KINDS):
            raised, critical = kinds[kind]
            rows = np.flatnonzero(raised)
            due = us[rows] - np.where(critical[rows], CRITICAL_S * 1e6, WARNING_S * 1e6).astype(np.int64)
            last = np.where(states[f"until_{kind}"] > states.now, states[f"last_{kind}"], 0).tolist()
            out = []
            for row, at, d, u in zip(rows.tolist(), place[rows].tolist(), due.tolist(), us[rows].tolist()):
                if d > last[at]:
                    last[at] = u
                    out.append(row)
            emitted[out] |= 1 << bit
            states[f"last_{kind}"][place[out]] = us[out]
            states[f"until_{kind}"][place[out]] = states.now + self.ttl_ms
        return emitted

    def close(self) -> None:
        pass


class FixFilter(StatefulProcessor):
    """Marks fixes that cannot be reached from the last *accepted* fix at the allowed speed."""

    def __init__(self, columns: list[str], max_speed_ms: float, ttl_ms: int = STATE_TTL_S * 1000):
        self.columns, self.max_speed_ms, self.ttl_ms = columns, max_speed_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "us bigint, lat double, lon double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], ignore_index=True)
        state = self.accepted.get()
        last = (int(state[0]), float(state[1]), float(state[2])) if state is not None else None
        spoofed = []
        for us, lat, lon in zip(batch["us"], batch["latitude"], batch["longitude"]):
            bad = False
            if last is not None:
                jump = np.hypot((lat - last[1]) * METERS_PER_DEGREE, (lon - last[2]) * METERS_PER_DEGREE)
                bad = bool(jump / max((us - last[0]) / 1e6, MIN_STEP_S) > self.max_speed_ms)
            if not bad and (last is None or us >= last[0]):
                last = (int(us), float(lat), float(lon))
            spoofed.append(bad)
        if last is not None:
            self.accepted.update(last)
        yield batch[self.columns].assign(spoofed=spoofed)

    def close(self) -> None:
        pass
