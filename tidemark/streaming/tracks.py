"""Linking of detections as they arrive, with typed state and a timer for each open track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Tracking
from ..operators.tracking import Linker

DEFAULT = Tracking()
OUT = "clip_id string, sample_idx int, det_idx int, track_id int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LinkProcessor(StatefulProcessor):
    """State of a clip: detections that wait for their turn, open tracks and the number of tracks so far.

    A detection waits until the watermark has passed its time, so that samples that come late or out of order are still
    linked in order. A track is dropped by its timer once it can be extended no more.
    """

    def __init__(self, scale: float, c: Tracking):
        self.scale, self.c = scale, c

    def init(self, handle: StatefulProcessorHandle) -> None:
        box = [T.StructField(k, T.DoubleType()) for k in "xywh"]
        self.handle = handle
        place = T.StructType([T.StructField("sample_idx", T.IntegerType()), T.StructField("det_idx", T.IntegerType())])
        self.waiting = handle.getMapState("waiting", place, T.StructType([T.StructField("ms", T.LongType()), T.StructField("score", T.DoubleType()), *box]))
        self.open = handle.getMapState("open", T.StructType([T.StructField("track_id", T.IntegerType())]), T.StructType([T.StructField("seen", T.IntegerType()), T.StructField("ends", T.LongType()), *box]))
        self.made = handle.getValueState("made", T.StructType([T.StructField("n", T.IntegerType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for part in rows:
            for r in part.itertuples(index=False):
                ms = r.at.value // 1_000_000
                times.add(ms)
                self.waiting.updateValue((int(r.sample_idx), int(r.det_idx)), (ms, float(r.score), float(r.x), float(r.y), float(r.w), float(r.h)))
        for ms in times:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due: dict[int, list[tuple]] = {}
        for (sample, det), (ms, score, *box) in list(self.waiting.iterator()):
            if ms <= now:
                due.setdefault(sample, []).append((-score, det, ms, box))
        tracks = {t: (seen, ends, box) for (t,), (seen, ends, *box) in list(self.open.iterator())}
        for t in [t for t, (_, ends, _) in tracks.items() if ends <= now and not due]:
            self.open.removeKey((t,))
            del tracks[t]
        if not due:
            return
        linker = Linker(self.scale, self.c)
        linker.made = self.made.get()[0] if self.made.exists() else 0
        linker.ids = sorted(tracks)
        linker.seen, linker.boxes = [tracks[t][0] for t in linker.ids], [list(tracks[t][2]) for t in linker.ids]
        step = 1000 / self.c.sample_fps
        out, ends = [], {}
        for sample in sorted(due):
            found = sorted(due[sample])
            ids = linker.add(sample, np.array([box for *_, box in found]))
            for (_, det, ms, _), t in zip(found, ids):
                out.append((key[0], sample, det, t))
                ends[t] = max(ends.get(t, 0), int(ms + (self.c.link_gap + 1) * step))
                self.waiting.removeKey((sample, det))
        kept = dict(zip(linker.ids, zip(linker.seen, linker.boxes)))
        for t in tracks:
            if t not in kept:
                self.open.removeKey((t,))
        for t, at in ends.items():
            if t in kept:
                seen, box = kept[t]
                self.open.updateValue((t,), (seen, at, *box))
                self.handle.registerTimer(at)
        self.made.update((linker.made,))
        yield pd.DataFrame(out, columns=["clip_id", "sample_idx", "det_idx", "track_id"]).astype({"sample_idx": "int32", "det_idx": "int32", "track_id": "int32"})

    def close(self) -> None:
        pass


def link_stream(detections: DataFrame, scale: float = 1.0, c: Tracking = DEFAULT, delay: str = "10 seconds") -> DataFrame:
    """Track of each detection (clip_id, sample_idx, det_idx, x, y, w, h, score, at) of a stream, as link_tracks gives it.

    at is when a sample was taken; it rises with sample_idx in a clip. Samples may come in any order and over several batches
    up to the delay; later ones are left out by the watermark. A detection that comes twice counts once. Rows come out once the
    watermark has passed their time. State is typed and kept in RocksDB: it holds what waits and the open tracks of each
    clip, which go by a timer, so it does not grow with a clip's length.
    """
    detections.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = detections.select("clip_id", "sample_idx", "det_idx", *"xywh", "score", "at").withWatermark("at", delay)
    return rows.groupBy("clip_id").transformWithStateInPandas(statefulProcessor=LinkProcessor(scale, c), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
