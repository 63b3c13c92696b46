"""Stateful steps on streams of frames.

``in_order`` comes first where frames count: it puts each batch of a camera in order (Spark hands rows over in any order), tells a restart
from a late row, and gives every row its epoch and the instant of the frame before it. The steps behind it are keyed by
camera and epoch, and by zone, rule and class or by track where they can be, so a restart begins with empty state and what it left is
cleared by a timer. A row older than what its epoch has processed in earlier batches is late: it changes nothing, in every
processor here, and ``late_frames`` and ``late_rows`` give those rows themselves, to be counted or kept. So a stream gives the batch result as long as
batches follow each other in event time; order inside a batch does not matter. A batch's rows of one key are in
memory together, so bound batches at the source (``maxFilesPerTrigger`` and the like).

Frames, hits and detections go from step to step as packs of one key (``packs``), not as rows. A pack is behind the watermark when all its rows are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import geometry, keys
from ..functions.clock import SECOND, micros
from ..functions.rules import CROWD_RULE, DIRECTIONS, STATIONARY, UNKNOWN
from ..operators import zones as Z
from ..operators.risk import LEVELS
from ..operators.sessions import Reattach
from ..operators.steps import OpenTracks, Stay, Stays, frames_of
from ..session import filled_up
from ..sources.frames import explode_detections
from .packs import bodies, dump, packed, rows_of, split, unpacked


@dataclass(frozen=True)
class Restart:
    """How long a camera may be silent, or a row behind, before it counts as a restart."""

    horizon_s: float = 3600.0


@dataclass(frozen=True)
class RuleSettings:
    expire_s: float = 5.0
    heartbeat_s: float = 1.0
    tz_offset_hours: float = 7.0
    reattach: Reattach | None = field(default_factory=Reattach)
    restart: Restart = field(default_factory=Restart)
    #: How far cameras may lie apart in time; rows further behind are dropped.
    watermark: str = "10 minutes"


EVENT_SCHEMA = (
    "camera_id string, zone_id string, rule_id string, rule_type string, track_key string, object_type string, "
    "confidence double, us bigint, seq bigint, first_us bigint, first_seq bigint, heartbeat_index bigint, "
    "source_event_id string, reattached_from string, epoch int"
)


class _Blob(StatefulProcessor):
    """A processor whose state is one JSON text per key, holding only what is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = handle.getValueState("state", "body string")

    def load(self) -> dict:
        return json.loads(self.store.get()[0]) if self.store.exists() else {}

    def save(self, state: dict) -> None:
        self.store.update((json.dumps(state),))

    def close(self) -> None:
        pass


ORDER_SCHEMA = "epoch int, prev_us bigint, clock_us bigint, late boolean"


class OrderProcessor(StatefulProcessor):
    """Epoch and newest frame of one camera; that is all that is kept of it.

    A frame goes on if neither its sequence nor its clock is behind the newest one. If one of them is behind and the other
    ahead, or both are behind by more than the horizon, or nothing came for so long, a new epoch begins. A frame that is behind by
    both is late, and so is one that was processed in an earlier batch. ``clock_us`` is the instant moved so that it never goes
    back from epoch to epoch (and a second on, as the first watermark is the year 1970); watermarks and timers behind this step go by it.
    """

    def __init__(self, horizon_s: float):
        self.horizon = micros(horizon_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("order", "epoch int, us bigint, seq bigint, prev bigint, shift bigint")

    @staticmethod
    def _frames(us: np.ndarray, seq: np.ndarray, newest: int | None, at: int | None) -> np.ndarray:
        """Places of the frames ``(us, seq)`` along the clock, or along the sequence if less goes back that way, seen from the newest frame."""
        def back(order: np.ndarray) -> int:
            u, s = us[order], seq[order]
            first = 0 if newest is None else int(u[0] < newest or s[0] < at)
            return first + int(((u[1:] < u[:-1]) | (s[1:] < s[:-1])).sum())

        by_clock, by_seq = np.lexsort((seq, us)), np.lexsort((us, seq))
        return by_seq if back(by_seq) < back(by_clock) else by_clock

    def _known(self, us: np.ndarray, seq: np.ndarray) -> pd.DataFrame:
        """Epoch, instant before, clock and lateness of rows in any order; the state goes on to their newest frame."""
        epoch, newest, at, prev, shift = self.state.get() if self.state.exists() else (0, None, None, None, SECOND)
        # A row's frame is its place among the frames of the batch, so that each is looked at once.
        rows = pd.DataFrame({"us": us, "seq": seq})
        place, frames = rows.groupby(["us", "seq"], sort=False).ngroup().to_numpy(), rows.drop_duplicates()
        clocks, numbers = frames["us"].to_numpy(), frames["seq"].to_numpy()
        order = self._frames(clocks, numbers, newest, at)
        u, s = clocks[order], numbers[order]
        gaps = np.diff(u)
        if (newest is None or (newest < u[0] <= newest + self.horizon and s[0] > at)) and (
                (gaps > 0).all() and (gaps <= self.horizon).all() and (np.diff(s) > 0).all()):
            # All frames follow the newest one and each other.
            before = pd.array(np.concatenate([[newest or 0], u[:-1]]), dtype="Int64")
            if newest is None:
                before[0] = prev
            known = pd.DataFrame({"epoch": epoch, "prev_us": before, "clock_us": u + shift, "late": False})
            self.state.update((epoch, int(u[-1]), int(s[-1]), None if before[-1] is pd.NA else int(before[-1]), shift))
            return known.iloc[np.argsort(order)[place]].reset_index(drop=True)
        found: list = [None] * len(frames)
        for k in order.tolist():
            us, seq, late = int(clocks[k]), int(numbers[k]), False
            if newest is not None:
                ahead = us >= newest and seq > at
                if ahead and us - newest <= self.horizon:
                    prev = newest if us > newest else prev
                elif ahead or us > newest or seq > at or newest - us > self.horizon:
                    epoch, prev, shift = epoch + 1, None, max(shift, newest + shift - us)
                else:
                    late = True
            if not late:
                newest, at = us, seq
            found[k] = (epoch, None if late else prev, us + shift, late)
        self.state.update((epoch, newest, at, prev, shift))
        known = pd.DataFrame(found, columns=["epoch", "prev_us", "clock_us", "late"]).astype({"prev_us": "Int64"})
        return known.iloc[place].reset_index(drop=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        known = self._known(batch["us"].to_numpy(), batch["seq"].to_numpy())
        yield pd.concat([batch.reset_index(drop=True), known], axis=1)

    def close(self) -> None:
        pass


class PackedOrderProcessor(OrderProcessor):
    """``OrderProcessor`` on packs. Rows go on in packs by epoch and ``by``, with the newest clock of each."""

    def __init__(self, horizon_s: float, key: str, by: list[str], late: bool | None, without: list[str]):
        super().__init__(horizon_s)
        self.key, self.by, self.late, self.without = key, by, late, without

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = rows_of(rows)
        known = self._known(table.column("us").to_numpy(), table.column("seq").to_numpy())
        for name, kind in (("epoch", pa.int32()), ("prev_us", pa.int64()), ("clock_us", pa.int64()), ("late", pa.bool_())):
            table = table.append_column(name, pa.array(known[name], kind))
        if self.late is not None:
            table = table.filter(pa.array(known["late"].to_numpy() == self.late))
        packs = []
        for (epoch, *of), piece in split(table, ["epoch", *self.by]):
            clock = int(piece.column("clock_us").to_numpy().max())
            packs.append((*key, epoch, *of, clock, dump(piece.drop_columns(self.without))))
        yield pd.DataFrame(packs, columns=[self.key, "epoch", *self.by, "clock_us", "body"])


def _ordered(
    stream: DataFrame, restart: Restart, key: str, by: list[str] = [], late: bool | None = None, without: list[str] = []
) -> tuple[DataFrame, T.StructType]:
    """Rows with ``ORDER_SCHEMA`` as packs with ``key``, ``epoch``, ``by`` and ``clock_us``, and the schema of their rows; ``late`` ones alone, or all but these."""
    rows = T.StructType([f for f in [*stream.schema.fields, *T._parse_datatype_string(ORDER_SCHEMA).fields] if f.name not in without])
    schema = T._parse_datatype_string("epoch int, clock_us bigint, body binary").fields
    schema = T.StructType([stream.schema[key], schema[0], *[stream.schema[c] for c in by], *schema[1:]])
    step = PackedOrderProcessor(restart.horizon_s, key, by, late, without)
    return packed(stream, [key]).groupBy(key).transformWithStateInPandas(step, schema, outputMode="Append", timeMode="None"), rows


def in_order(stream: DataFrame, restart: Restart = Restart(), key: str = "camera_id") -> DataFrame:
    """Rows of a stream (with ``us`` and ``seq``) with ``epoch``, ``prev_us`` (the instant before, in the epoch), ``clock_us`` and ``late``."""
    return unpacked(*_ordered(stream, restart, key))


STAY_STATE = (
    "turn bigint, first_us bigint, first_seq bigint, origin string, last_us bigint, x double, y double, area double, came_from string, "
    "published_us bigint, published bigint, event_id string"
)
_STAY_FIELDS = [c.split(" ")[0] for c in STAY_STATE.split(", ")][1:]


class RuleProcessor(StatefulProcessor):
    """Stays and their heartbeats of one camera, epoch, zone, rule and class; or the crowd of one rule.

    Open stays are entries of a map. They go when their objects were missing for too long, and all of them when the
    camera has been silent for the horizon, after which a new epoch begins.
    """

    def __init__(self, settings: RuleSettings):
        self.s = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stays = handle.getMapState("stays", "key string", STAY_STATE)

    def close(self) -> None:
        pass

    def _load(self) -> Stays:
        r = self.s.reattach or Reattach(grace_s=0, distance_px=-1)
        book = Stays(micros(self.s.expire_s), micros(r.grace_s), r.distance_px, r.low_ratio, r.high_ratio)
        saved = sorted(((tuple(v), k[0]) for k, v in self.stays.iterator()), key=lambda e: e[0][0])
        book.open = {key: Stay(key, **dict(zip(_STAY_FIELDS, v[1:], strict=True))) for v, key in saved}
        return book

    def _save(self, before: set[str], open_now: dict[str, Stay]) -> None:
        for key in before - set(open_now):
            self.stays.removeKey((key,))
        for turn, (key, stay) in enumerate(open_now.items()):
            self.stays.updateValue((key,), (turn, *[getattr(stay, f) for f in _STAY_FIELDS]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = rows_of(rows).to_pandas().sort_values(["us", "seq", "det_index"], kind="stable", na_position="first")
        book = self._load()
        before = set(book.open)
        out: list[tuple] = []
        last = clock = None
        for (us, seq), frame in groupby(batch.itertuples(index=False), key=lambda h: (h.us, h.seq)):
            hits = list(frame)
            us, seq, h = int(us), int(seq), hits[0]
            prev = None if h.prev_us != h.prev_us or h.prev_us is None else int(h.prev_us)
            last, clock = us, int(h.clock_us)
            if h.rule_type == CROWD_RULE:
                self._crowd(out, key, book, hits, us, seq, prev)
                continue
            for h in hits:
                stay = book.see(h.track_key, us, seq, prev, h.fx, h.fy, h.area)
                self._publish(out, key, h, stay, h.track_key, h.class_name, h.confidence, us, seq)
        book.open = {k: s for k, s in book.open.items() if last - s.last_us <= micros(self.s.expire_s)}
        self._save(before, book.open)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((clock + micros(self.s.restart.horizon_s)) // 1000 + 1)
        names = [c.split(" ")[0] for c in EVENT_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stays.clear()
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in EVENT_SCHEMA.split(", ")])

    def _crowd(self, out, key, book: Stays, rows: list, us: int, seq: int, prev: int | None) -> None:
        people = len({h.track_key for h in rows})
        if people < rows[0].people_threshold:
            return
        held = book.open.get(keys.CROWD)
        if held is None or held.last_us not in (prev, us):
            held = book.open[keys.CROWD] = Stay(keys.CROWD, us, seq, keys.CROWD, us)
        held.last_us = us
        sure = [h.confidence for h in rows if h.confidence == h.confidence and h.confidence is not None]
        kind = rows[0].rule_object_type
        self._publish(out, key, rows[0], held, f"{people} objects", kind if isinstance(kind, str) and kind else "person",
                      min(sure) if sure else None, us, seq)

    def _publish(self, out, key, h, stay: Stay, shown, kind, confidence, us, seq) -> None:
        camera, epoch, zone, rule = key[:4]
        if us - stay.first_us < h.duration_threshold * SECOND:
            return
        if stay.published_us is not None and us - stay.published_us < micros(self.s.heartbeat_s):
            return
        stay.event_id = stay.event_id or "|".join([camera, zone, rule, stay.key, str(stay.first_seq)])
        stay.published_us, stay.published = us, stay.published + 1
        out.append((camera, zone, rule, h.rule_type, shown, kind, confidence, us, seq, stay.first_us,
                    stay.first_seq, stay.published, stay.event_id, stay.came_from, epoch))


def _hits_with_frames(frames: DataFrame, zones, rules, tz: float) -> DataFrame:
    """Rule hits, and for frames without any a row that only says the frame was processed."""
    detections = Z.with_track_key(explode_detections(frames))
    hits = Z.match_rules(Z.match_zones(detections, zones), rules, tz)
    foot = geometry.foot_point(F.col("bbox"))
    row = hits.select(
        "camera_id", "us", "seq", F.col("det_index").cast("double").alias("det_index"), "zone_id", "rule_id", "rule_type",
        "track_key", "class_name", "rule_object_type", F.col("confidence").cast("double").alias("confidence"),
        F.col("people_threshold").cast("double").alias("people_threshold"), "duration_threshold",
        foot["x"].alias("fx"), foot["y"].alias("fy"), geometry.bbox_area(F.col("bbox")).alias("area"),
    )
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in row.schema.fields[3:]]
    return row.unionByName(frames.select("camera_id", "us", "seq", *blank))


HIT_SCHEMA = (
    "camera_id string, us bigint, seq bigint, det_index double, zone_id string, rule_id string, rule_type string, track_key string, "
    "class_name string, rule_object_type string, confidence double, people_threshold double, duration_threshold double, fx double, fy double, area double"
)


#: Files of a batch of hits.
HIT_FILES = 64


def write_hits(frames: DataFrame, zones: Callable[[], DataFrame], rules: Callable[[], DataFrame], folder: str, checkpoint: str, tz: float = 7.0, **trigger):
    """Rule hits of a stream of frames as files, each batch under the configuration of its time.

    ``zones`` and ``rules`` are asked once a batch (``config.refreshing_dimension`` keeps what they give for some seconds), so a
    changed zone or rule holds from the next batch on, which a join fixed when the stream starts can't do. ``stream_hits``
    goes on from the files. A batch is written under its number, so one that is repeated replaces itself. It is seen as a whole and
    has ``HIT_FILES`` files, so that ``stream_hits`` takes it as one batch: of one that is cut the frames would meet as late ones.
    """
    names = [c.split(" ")[0] for c in HIT_SCHEMA.split(", ")]

    def step(batch: DataFrame, number: int) -> None:
        hits = _hits_with_frames(batch, Z.prepare_zones(zones()), Z.prepare_rules(rules()), tz)
        typed = hits.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in HIT_SCHEMA.split(", ")])
        spark, place = batch.sparkSession, f"batch={number:012d}"
        typed.select(*names).coalesce(HIT_FILES).write.mode("overwrite").parquet(f"{folder}/_making/{place}")
        filled_up(spark, f"{folder}/_making/{place}", typed.schema, HIT_FILES)
        made, seen = [spark._jvm.org.apache.hadoop.fs.Path(f"{folder}{below}/{place}") for below in ("/_making", "")]
        fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(seen, True)
        if not fs.rename(made, seen):
            raise OSError(f"{seen} can't be written")

    return frames.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_hits(spark: SparkSession, folder: str, settings: RuleSettings = RuleSettings(), files_per_batch: int = HIT_FILES) -> DataFrame:
    """Published events of the hits that ``write_hits`` wrote, as a stream."""
    rows = spark.readStream.schema(HIT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(folder)
    return _events_of(rows, settings)


def _events_of(rows: DataFrame, settings: RuleSettings) -> DataFrame:
    crowd = F.col("rule_type") == CROWD_RULE
    ruled = F.col("rule_id").isNotNull() & F.col("duration_threshold").isNotNull() & (~crowd | F.col("people_threshold").isNotNull())
    # All rows say that their frame was processed; those of no rule go no further than that.
    marked = rows.withColumns({"of": F.when(crowd, F.lit(keys.CROWD)).otherwise(F.col("class_name")), "ruled": F.coalesce(ruled, F.lit(False))})
    of = ["zone_id", "rule_id", "of", "ruled"]
    ready, _ = _ordered(marked, settings.restart, "camera_id", of, late=False, without=["camera_id", "epoch", "late", *of])
    ready = ready.where("ruled").drop("ruled").withColumn("ts", F.timestamp_micros("clock_us")).withWatermark("ts", settings.watermark)
    return ready.groupBy("camera_id", "epoch", "zone_id", "rule_id", "of").transformWithStateInPandas(
        RuleProcessor(settings), EVENT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def stream_rules(
    frames: DataFrame, zones, rules, settings: RuleSettings = RuleSettings()
) -> DataFrame:
    """Published events of a stream of frames (with ``detections``), as ``heartbeat_events`` gives them.

    Zones and rules are those at the start (``write_hits`` asks for them anew) and joined without state; then one step
    per camera finds restarts and previous frames, and one per camera, epoch, zone, rule and class keeps its open stays.
    """
    return _events_of(_hits_with_frames(frames, zones, rules, settings.tz_offset_hours), settings)


class TrackProcessor(StatefulProcessor):
    """Open tracks of one camera and epoch, per class; ids count over all classes. All goes when the camera has been silent for the horizon."""

    def __init__(self, min_iou: float, max_missing: int, horizon_s: float):
        self.min_iou, self.max_missing, self.horizon = min_iou, max_missing, micros(horizon_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "n bigint")
        self.numbers = handle.getMapState("numbers", "kind string", "n bigint")
        self.tracks = handle.getMapState("tracks", "id bigint", "kind string, n bigint, x1 double, y1 double, x2 double, y2 double, seq bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = rows_of(rows).to_pandas()
        batch = batch.assign(__c=-batch["confidence"].fillna(0.0)).sort_values(["class_name", "seq", "__c", "det_index"], kind="stable", ignore_index=True)
        made = self.made.get()[0] if self.made.exists() else 0
        books: dict[str, OpenTracks] = {}
        ids: dict[tuple[str, int], int] = {}
        # Numbers within a class follow the ids, so ties go to the lower one as in a batch.
        saved = sorted((k[0], *v) for k, v in self.tracks.iterator())
        for kind, n in [(k[0], v[0]) for k, v in self.numbers.iterator()]:
            books[kind] = OpenTracks(self.min_iou, self.max_missing)
            books[kind].made = n
        for ident, kind, n, *box, seq in saved:
            books[kind].open[n] = [tuple(box), seq]
            ids[kind, n] = ident
        kinds, seqs = batch["class_name"].tolist(), batch["seq"].to_numpy()
        boxes = list(batch[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None))
        numbers, fresh = [], []
        for at, end in frames_of(seqs, (batch["class_name"] != batch["class_name"].shift()).to_numpy()):
            book = books.setdefault(kinds[at], OpenTracks(self.min_iou, self.max_missing))
            for n, new in book.see_all(int(seqs[at]), boxes[at:end]):
                numbers.append(n)
                fresh.append(new)
        # Ids count the tracks of all classes in the order they begin.
        begun = batch[["seq", "__c", "det_index"]][fresh].sort_values(["seq", "__c", "det_index"], kind="stable").index
        for at in begun:
            made += 1
            ids[kinds[at], numbers[at]] = made
        found = [ids[pair] for pair in zip(kinds, numbers)]
        last = int(batch["seq"].max())
        alive = {ids[kind, n]: (kind, n, *t[0], t[1]) for kind, b in books.items() for n, t in b.open.items() if last - t[1] <= self.max_missing}
        for ident in {s[0] for s in saved} - set(alive):
            self.tracks.removeKey((ident,))
        for ident, row in alive.items():
            self.tracks.updateValue((ident,), row)
        for kind, book in books.items():
            self.numbers.updateValue((kind,), (book.made,))
        self.made.update((made,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(batch["clock_us"].max()) + self.horizon) // 1000 + 1)
        out = batch[["seq", "us", "det_index", "class_name", "confidence", "x1", "y1", "x2", "y2"]].copy()
        out.insert(0, "camera_id", key[0])
        out["track_id"] = found
        out["epoch"] = key[1]
        yield bodies(pa.Table.from_pandas(out, preserve_index=False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.made, self.numbers, self.tracks):
            state.clear()
        yield pd.DataFrame(columns=["body"])


TRACK_SCHEMA = (
    "camera_id string, seq bigint, us bigint, det_index int, class_name string, confidence double, x1 double, y1 double, "
    "x2 double, y2 double, track_id bigint, epoch int"
)


def stream_track(
    detections: DataFrame, min_iou: float = 0.3, max_missing: int = 45, restart: Restart = Restart(), watermark: str = "10 minutes"
) -> DataFrame:
    """Track ids on a stream of detections, as ``tracking.track`` gives them; each ``epoch`` of a camera counts anew."""
    flat = detections.select(
        "camera_id", "seq", "us", "det_index", F.coalesce("class_name", F.lit("object")).alias("class_name"),
        "confidence", *[F.col("bbox")[c].alias(c) for c in ("x1", "y1", "x2", "y2")],
    )
    ready, _ = _ordered(flat, restart, "camera_id", late=False, without=["camera_id", "epoch", "late", "prev_us"])
    ready = ready.withColumn("ts", F.timestamp_micros("clock_us")).withWatermark("ts", watermark)
    tracks = ready.groupBy("camera_id", "epoch").transformWithStateInPandas(
        TrackProcessor(min_iou, max_missing, restart.horizon_s), "body binary", outputMode="Append", timeMode="EventTime"
    )
    return unpacked(tracks, TRACK_SCHEMA)


#: A camera's tracks are dealt to so many keys of state.
MOTION_SHARES = 16

MOTION_SCHEMA = (
    "camera_id string, epoch int, track_key string, us bigint, seq bigint, direction string, angle_deg double, speed_px_s double, "
    "dx double, dy double, window_s double"
)


class MotionProcessor(StatefulProcessor):
    """Last second of the tracks of one epoch and share, one list of points; forgotten when none has been seen for a while.

    The state is read and written once for all tracks of a batch, as a key of its own for each track would cost more than its rows.
    """

    def __init__(self, window_s: float, min_ratio: float, still_ratio: float, forget_s: float):
        self.window_s, self.min_ratio, self.still_ratio, self.forget_s = window_s, min_ratio, still_ratio, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "track_key string, us bigint, x double, y double")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reach = micros(self.window_s)
        batch = rows_of(rows)
        batch = batch.take(np.argsort(batch.column("seq").to_numpy(), kind="stable"))
        us, last = batch.column("us").to_numpy(), int(pc.max(batch.column("us")).as_py())
        # The points that are known come first, then the rows along the sequence; and so along each track.
        saved = list(self.points.get()) if self.points.exists() else []
        old = [np.array([p[i] for p in saved], dtype=kind) for i, kind in ((1, np.int64), (2, float), (3, float))]
        tracks = pa.concat_arrays([pa.array([p[0] for p in saved], pa.string()), batch.column("track_key").combine_chunks()]).dictionary_encode(null_encoding="encode")
        codes = tracks.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        t, x, y = [np.concatenate([a, b])[order] for a, b in zip(old, (us, self._floats(batch, "fx"), self._floats(batch, "fy")))]
        first = self._first(codes[order], t, reach)
        width = np.concatenate([np.full(len(saved), 640.0), self._floats(batch, "frame_w")])[order]
        figures = self._motion(t[first], x[first], y[first], t, x, y, np.where((width == 0) | np.isnan(width), 640.0, width))
        fresh = order >= len(saved)
        at, names = order[fresh] - len(saved), np.array(DIRECTIONS_KNOWN)
        n = len(at)
        yield bodies(pa.table({
            "camera_id": pa.array([key[0]] * n, pa.string()), "epoch": pa.array(np.full(n, key[1]), pa.int32()),
            "track_key": batch.column("track_key").take(at), "us": batch.column("us").take(at), "seq": batch.column("seq").take(at),
            "direction": pa.array(names[figures[0][fresh]], pa.string()),
            **{c: pa.array(v[fresh], pa.float64(), from_pandas=True) for c, v in zip(("angle_deg", "speed_px_s", "dx", "dy", "window_s"), figures[1:])}}))
        # The clock of an epoch doesn't go back, so older points are of no more use.
        near = last - t <= reach
        kept = tracks.dictionary.take(tracks.indices.take(order[near])).to_pylist()
        self.points.put([(k, *p) for k, *p in zip(kept, t[near].tolist(), x[near].tolist(), y[near].tolist())])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pc.max(batch.column("clock_us")).as_py()) // 1000 + int(self.forget_s * 1000))

    @staticmethod
    def _floats(batch: pa.Table, name: str) -> np.ndarray:
        return batch.column(name).cast(pa.float64()).to_numpy()

    @staticmethod
    def _first(codes: np.ndarray, t: np.ndarray, reach: int) -> np.ndarray:
        """Place of the oldest point of each point's track that is not more than ``reach`` before it; points lie by track and time."""
        first = np.arange(len(t))
        heads = np.concatenate([[True], codes[1:] != codes[:-1]]) if len(t) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(heads, first, 0))
        moving = first.copy()
        # As many rounds as a track has points within reach.
        while len(moving):
            back = first[moving] - 1
            moving = moving[(back >= head[moving]) & (t[moving] - t[back] <= reach)]
            first[moving] -= 1
        return first

    def _motion(self, t0, x0, y0, t1, x1, y1, width) -> tuple:
        """Number of the direction, then angle, speed, way and span; all but the first are NaN while history is too short."""
        known = (t1 - t0 >= micros(self.window_s * self.min_ratio)) & (t1 > t0)
        dx, dy, span = x1 - x0, y1 - y0, np.where(known, (t1 - t0) / SECOND, np.nan)
        known &= ~np.isnan(dx) & ~np.isnan(dy)
        speed, angle = np.hypot(dx, dy) / span, np.degrees(np.arctan2(-dy, dx)) % 360.0
        eighth = ((np.where(known, angle, 0.0) + 22.5) // 45).astype(int) % 8
        name = np.where(known, np.where(speed < self.still_ratio * width, 8, eighth), 9)
        return name, *[np.where(known, rounded(v, digits), np.nan) for v, digits in ((angle, 1), (speed, 1), (dx, 1), (dy, 1), (span, 2))]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.points.clear()
        yield pd.DataFrame(columns=["body"])


#: Directions by number, then what stands still and what isn't known yet.
DIRECTIONS_KNOWN = [*DIRECTIONS, STATIONARY, UNKNOWN]


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """``round`` of each value; numpy's own scales the value first, which moves some of those that lie half-way."""
    scaled = values * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    for k in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-6).tolist():
        out[k] = round(float(values[k]), digits)
    return out


def stream_motion(
    detections: DataFrame, window_s: float = 1.0, min_ratio: float = 0.5, still_ratio: float = 0.02,
    forget_s: float = 5.0, watermark: str = "10 seconds", restart: Restart = Restart(),
) -> DataFrame:
    """Motion per detection on a stream; state is the last second of each track seen lately. A restart of the camera begins anew."""
    foot = geometry.foot_point(F.col("bbox"))
    flat = detections.select(
        "camera_id", "track_key", "us", "seq", F.col("frame_w").cast("double").alias("frame_w"), foot["x"].alias("fx"), foot["y"].alias("fy"),
    )
    flat = flat.withColumn("share", F.pmod(F.xxhash64("track_key"), F.lit(MOTION_SHARES)))
    ready, _ = _ordered(flat, restart, "camera_id", ["share"], late=False, without=["camera_id", "epoch", "late", "prev_us", "share"])
    ready = ready.withColumn("ts", F.timestamp_micros("clock_us")).withWatermark("ts", watermark)
    moved = ready.groupBy("camera_id", "epoch", "share").transformWithStateInPandas(
        MotionProcessor(window_s, min_ratio, still_ratio, forget_s), "body binary", outputMode="Append", timeMode="EventTime"
    )
    return unpacked(moved, MOTION_SCHEMA)


ALERT_SCHEMA = "dedup_key string, alert_us bigint, change string, at_us bigint, active_source_count bigint, last_seen_us bigint"


class AlertProcessor(_Blob):
    """The open alert of one dedup key, and the sources the key has seen.

    A source that comes back must not count as new, so it is remembered for ``remember_s`` after it was last
    seen; the forgotten ones are cleared when an alert ends.
    """

    def __init__(self, window_s: float, grace_s: float, remember_s: float):
        self.gap, self.grace, self.remember = micros(min(window_s, grace_s)), micros(grace_s), micros(remember_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sources = handle.getMapState("sources", "id string", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.load()
        out = []
        batch = pd.concat(list(rows)).sort_values(["us", "last_seq", "source_event_id"], kind="stable")
        if s:
            batch = batch[batch["us"] >= s["last"]]
        if batch.empty:
            return
        # Each source is asked for and written once a batch, as each time costs far more than a row.
        latest = batch.groupby("source_event_id", sort=False)["us"].last()
        seen = {source for source in latest.index if self.sources.containsKey((source,))}
        for source, us in latest.items():
            self.sources.updateValue((source,), (int(us),))
        for us, source in zip(batch["us"].tolist(), batch["source_event_id"].tolist()):
            us = int(us)
            fresh = source not in seen
            seen.add(source)
            if s and us - s["last"] > self.gap:
                if not s.get("closed"):
                    out.append((key[0], s["open"], "RESOLVED", s["last"] + self.grace, s["n"], s["last"]))
                s = {}
            if not s:
                s = {"open": us, "last": us, "n": 1}
                out.append((key[0], us, "CREATED", us, 1, us))
            else:
                s["n"] += int(fresh)
                s["last"] = max(us, s["last"])
                out.append((key[0], s["open"], "UPDATED", us, s["n"], s["last"]))
        self.save(s)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((s["last"] + self.grace) // 1000 + 1)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ALERT_SCHEMA.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.load()
        out = []
        if s and not s.get("closed"):
            s["closed"] = True
            self.save(s)
            out.append((key[0], s["open"], "RESOLVED", s["last"] + self.grace, s["n"], s["last"]))
            old = [k for k, v in self.sources.iterator() if s["last"] - v[0] > self.remember]
            for k in old:
                self.sources.removeKey(k)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ALERT_SCHEMA.split(", ")])


def stream_alerts(
    events: DataFrame, window_s: float = 120.0, grace_s: float = 30.0, watermark: str = "10 seconds", remember_s: float = 86400.0
) -> DataFrame:
    """Changes of alerts on a stream of events: created, updated, resolved.

    ``UPDATED`` follows every event. An alert ends ``grace_s`` after it was last seen, whether a timer tells or a
    later event of its key, as ``alerts.alert_sessions`` has it with ``sweeps=False``.
    """
    keyed = events.select(
        keys.alert_dedup_key(F.col("camera_id"), F.col("zone_id"), F.col("event_type"), F.col("object_type")).alias("dedup_key"),
        "source_event_id", "us", "last_seq", F.timestamp_micros("us").alias("ts"),
    ).withWatermark("ts", watermark)
    return keyed.groupBy("dedup_key").transformWithStateInPandas(
        AlertProcessor(window_s, grace_s, remember_s), ALERT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


RISK_SCHEMA = "location_id string, alert_from_us bigint, at_us bigint, change string, level string"


class RiskProcessor(_Blob):
    """Active sources of one location and its open alert."""

    def __init__(self, grace_s: float, working_from: int, working_to: int):
        self.grace, self.hours = micros(grace_s), (working_from, working_to)

    def _level(self, n: int, us: int) -> str:
        minute = us // (60 * SECOND) % 1440
        if n >= 2 and not self.hours[0] <= minute < self.hours[1]:
            return LEVELS[3]
        return LEVELS[min(n, 3)]

    def _hours(self, s: dict, out: list, place: str, now: int) -> None:
        """Tell of levels that working hours changed after the last step and before ``now``; only two sources are so changed."""
        if s.get("open") is None or s.get("at") is None or s.get("n") != 2:
            return
        day = 86400 * SECOND
        borders = sorted(
            d * day + b * 60 * SECOND for d in range(s["at"] // day, now // day + 1) for b in {self.hours[0] % 1440, self.hours[1] % 1440})
        for at in borders:
            if s["at"] < at < now:
                level = self._level(2, at)
                if level != s["level"]:
                    out.append((place, s["open"], at, "LEVEL_CHANGED", level))
                    s["level"] = level

    def _next_border(self, us: int) -> int:
        day = 86400 * SECOND
        return min(x for d in (0, 1) for b in self.hours if (x := (us // day + d) * day + b % 1440 * 60 * SECOND) > us)

    def _close(self, s: dict, out: list, place: str, now: int) -> None:
        quiet = s.get("quiet")
        if s.get("open") is not None and quiet is not None and now - quiet > self.grace:
            out.append((place, s["open"], quiet + self.grace, "CLOSED", s["level"]))
            s.update(open=None, quiet=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.load() or {"on": {}, "open": None, "quiet": None, "level": None}
        out: list = []
        batch = pd.concat(list(rows)).sort_values("us", kind="stable")
        if s.get("at") is not None:
            batch = batch[batch["us"] >= s["at"]]
        if batch.empty:
            return
        for us, changes in groupby(batch.itertuples(index=False), key=lambda r: r.us):
            before = sum(n > 0 for n in s["on"].values())
            for r in changes:
                s["on"][r.source] = s["on"].get(r.source, 0) + int(r.delta)
            now = sum(n > 0 for n in s["on"].values())
            if now == before:
                continue
            us = int(us)
            self._hours(s, out, key[0], us)
            s["at"], s["n"] = us, now
            self._close(s, out, key[0], us)
            if now == 0:
                s["quiet"] = us
                continue
            level, s["quiet"] = self._level(now, us), None
            if s["open"] is None:
                s["open"] = us
                out.append((key[0], us, us, "CREATED", level))
            elif level != s["level"]:
                out.append((key[0], s["open"], us, "LEVEL_CHANGED", level))
            s["level"] = level
        s["on"] = {k: n for k, n in s["on"].items() if n}
        self.save(s)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._wait(s)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RISK_SCHEMA.split(", ")])

    def _wait(self, s: dict) -> None:
        if s["open"] is not None and s["quiet"] is not None:
            self.handle.registerTimer((s["quiet"] + self.grace) // 1000 + 1)
        elif s["open"] is not None and s.get("n") == 2 and (self.hours[1] - self.hours[0]) % 1440:
            self.handle.registerTimer(self._next_border(s["at"]) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self.load(), []
        if s:
            now = expiredTimerInfo.getExpiryTimeInMs() * 1000
            self._close(s, out, key[0], now)
            self._hours(s, out, key[0], now)
            if s["open"] is not None and s["quiet"] is None:
                s["at"] = now - 1
                self._wait(s)
            self.save(s)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RISK_SCHEMA.split(", ")])


def stream_risk_alerts(
    steps: DataFrame, grace_s: float = 30.0, working_from: int = 0, working_to: int = 1440, watermark: str = "10 seconds"
) -> DataFrame:
    """Alert changes per location on a stream of source steps (``location_id source us delta``).

    ``delta`` is 1 where a source becomes active and -1 where it stops, as the ends of the spans that
    ``risk.risk_levels`` takes. The result is that of ``risk.risk_alert_changes``; closing needs the
    watermark to pass the grace.
    """
    flat = steps.select("location_id", "source", "us", "delta", F.timestamp_micros("us").alias("ts")).withWatermark("ts", watermark)
    return flat.groupBy("location_id").transformWithStateInPandas(
        RiskProcessor(grace_s, working_from, working_to), RISK_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


LATE_SCHEMA = "us bigint, body string"


class LateProcessor(_Blob):
    """Rows older than the newest of their key's earlier batches."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.load().get("us")
        batch = pd.concat(list(rows))
        newest = int(batch["us"].max())
        self.save({"us": newest if done is None else max(done, newest)})
        yield batch[batch["us"] < done][["us", "body"]] if done is not None else batch[["us", "body"]].iloc[:0]


def late_rows(stream: DataFrame, keys_: list[str]) -> DataFrame:
    """What the processors of events leave out: rows of a stream (with ``us``) that come after a newer batch of their key."""
    packed = stream.select(*keys_, "us", F.to_json(F.struct(*stream.columns)).alias("body"))
    late = packed.groupBy(*keys_).transformWithStateInPandas(LateProcessor(), LATE_SCHEMA, outputMode="Append", timeMode="None")
    return late.select(F.from_json("body", stream.schema).alias("r")).select("r.*")


def late_frames(stream: DataFrame, restart: Restart = Restart(), key: str = "camera_id") -> DataFrame:
    """What the processors of frames leave out: rows of a stream (with ``us`` and ``seq``) behind what their epoch had processed, and which that is."""
    return unpacked(*_ordered(stream, restart, key, late=True)).drop("late", "prev_us", "clock_us")
