"""Tracks from detections: greedy linking by nearest centre, then merging of fragments.

Both go through a clip's samples in order and have no form as a join. Detections are dealt by clip and sorted once; a task
goes along its rows as Arrow columns, sample by sample. Linking holds a clip's open tracks only, merging its boxes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Tracking

DEFAULT = Tracking()
BOXES = "clip_id string, track_id int, fragments int, sample_idx int, x double, y double, w double, h double"


def keep_wide(detections: DataFrame, c: Tracking = DEFAULT, width: int | None = None) -> DataFrame:
    """Detections that are wide enough for the width that they were made at."""
    return detections.where(F.col("w") >= max(int((width or c.detect_width) * c.narrowest_fraction), c.narrowest))


def best_first(detections: DataFrame) -> DataFrame:
    """For each sample its detections as an array by falling score, in their order on ties."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "det_idx", "x", "y", "w", "h", "score")))
    return detections.groupBy("clip_id", "sample_idx").agg(F.transform(ordered, lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), d["w"].alias("w"), d["h"].alias("h"), d["score"].alias("score"))).alias("detections"))


#: Up to so many pairs of open tracks and boxes are all measured; of more only those in neighbouring cells.
DENSE = 1024
#: Up to so many are measured one by one, as arrays would cost more.
SMALL = 16


def near_pairs(old: np.ndarray, new: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and distances of old and new boxes (rows of x, y, w, h) whose centres lie within limit of the wider one's width.

    Centres are put on a grid of cells as wide as the widest box allows, so that only boxes of neighbouring cells are
    measured, however many there are in a sample.
    """
    a, b = old[:, :2] + old[:, 2:] / 2, new[:, :2] + new[:, 2:] / 2
    cell = limit * max(old[:, 2].max(initial=0), new[:, 2].max(initial=0))
    if len(old) * len(new) <= DENSE:
        i, k = np.repeat(np.arange(len(old)), len(new)), np.tile(np.arange(len(new)), len(old))
    elif not 0 < cell < np.inf:
        i = k = np.zeros(0, np.int64)
    else:
        i, k = _grid(np.floor(a / cell), np.floor(b / cell))
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.hypot(b[k, 0] - a[i, 0], b[k, 1] - a[i, 1]) / np.maximum(old[i, 2], new[k, 2])
    good = far <= limit
    return i[good], k[good], far[good]


def _grid(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of a and b whose cells are the same or neighbours."""
    rows, columns = np.unique(b[:, 0]), np.unique(b[:, 1])
    code = lambda x, y: x * len(columns) + y
    key = code(np.searchsorted(rows, b[:, 0]), np.searchsorted(columns, b[:, 1]))
    order = np.argsort(key, kind="stable")
    key = key[order]
    left, right = [], []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            x = np.minimum(np.searchsorted(rows, a[:, 0] + dx), len(rows) - 1)
            y = np.minimum(np.searchsorted(columns, a[:, 1] + dy), len(columns) - 1)
            some = np.flatnonzero((rows[x] == a[:, 0] + dx) & (columns[y] == a[:, 1] + dy))
            wanted = code(x[some], y[some])
            lo, hi = np.searchsorted(key, wanted), np.searchsorted(key, wanted, side="right")
            n = hi - lo
            left.append(np.repeat(some, n))
            right.append(order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)])
    return np.concatenate(left), np.concatenate(right)


class Linker:
    """Open tracks of one clip in the order that they began. Samples are handed in by rising number; a track ends after a gap
    of more than c.link_gap."""

    def __init__(self, scale: float = 1.0, c: Tracking = DEFAULT):
        self.scale, self.c, self.made = scale, c, 0
        self.ids: list[int] = []
        self.seen: list[int] = []
        self.boxes: list[list[float]] = []

    def _pairs(self, new: list[list[float]]) -> list[tuple[float, int, int]]:
        """(distance, track, box) of all that may be linked, by rising distance, track and box."""
        limit = self.c.link_distance
        if len(new) * len(self.boxes) > SMALL:
            i, k, far = near_pairs(np.array(self.boxes), np.array(new), limit)
            return sorted(zip(far.tolist(), i.tolist(), k.tolist()))
        out = []
        for i, (x, y, w, h) in enumerate(self.boxes):
            for k, (u, v, p, q) in enumerate(new):
                widest = max(w, p)
                if widest > 0 and (far := float(np.hypot(u + p / 2 - (x + w / 2), v + q / 2 - (y + h / 2))) / widest) <= limit:
                    out.append((far, i, k))
        return sorted(out) if len(out) > 1 else out

    def add(self, sample: int, boxes: np.ndarray) -> list[int]:
        """The track of each box (rows of x, y, w, h); a pair is linked by rising (distance, track, box), once each."""
        new = (boxes.reshape(-1, 4) * self.scale).tolist()
        if self.seen and sample - min(self.seen) > self.c.link_gap:
            open_ = [i for i, s in enumerate(self.seen) if sample - s <= self.c.link_gap]
            self.ids, self.seen, self.boxes = ([x[i] for i in open_] for x in (self.ids, self.seen, self.boxes))
        out = [-1] * len(new)
        taken = set()
        for _, i, k in self._pairs(new):
            if out[k] < 0 and i not in taken:
                taken.add(i)
                out[k], self.seen[i], self.boxes[i] = self.ids[i], sample, new[k]
        for k, t in enumerate(out):
            if t < 0:
                out[k] = self.made
                self.ids.append(self.made)
                self.seen.append(sample)
                self.boxes.append(new[k])
                self.made += 1
        return out


def merge(track: np.ndarray, sample: np.ndarray, boxes: np.ndarray, c: Tracking = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """The track that each row's fragment is part of, and of how many: each track, by its first sample, joins the first before
    it that has no sample in common and a median centre nearby. Medians are those of what has been merged so far."""
    order = np.lexsort((sample, track))
    ids, first = np.unique(track[order], return_index=True)
    parts = np.split(order, first[1:])
    out, middle, samples, rows = [], np.zeros((0, 4)), [], []
    for k in sorted(range(len(ids)), key=lambda k: sample[parts[k][0]]):
        own = parts[k]
        mine, mine_at = np.median(boxes[own], axis=0), set(sample[own].tolist())
        shift = (mine[:2] + mine[2:] / 2) - (middle[:, :2] + middle[:, 2:] / 2)
        near = np.flatnonzero(np.hypot(shift[:, 0], shift[:, 1]) <= c.merge_distance * np.maximum(mine[2], middle[:, 2]))
        m = next((m for m in near.tolist() if samples[m].isdisjoint(mine_at)), None)
        if m is None:
            out.append([ids[k], 1])
            middle = np.concatenate([middle, mine[None]])
            samples.append(mine_at)
            rows.append(own)
        else:
            out[m][1] += 1
            samples[m] |= mine_at
            rows[m] = np.concatenate([rows[m], own])
            middle[m] = np.median(boxes[rows[m]], axis=0)
    whole, pieces = np.empty(len(track), np.int64), np.empty(len(track), np.int64)
    for (t, n), at in zip(out, rows):
        whole[at], pieces[at] = t, n
    return whole, pieces


def _borders(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where samples begin in rows sorted by clip and sample, with the end; and whether a clip begins there."""
    n = len(table)
    clip = table["clip_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    sample = table["sample_idx"].to_numpy()
    turn = np.concatenate([[True], clip[1:] != clip[:-1]])
    at = np.flatnonzero(turn | np.concatenate([[True], sample[1:] != sample[:-1]]))
    return np.concatenate([at, [n]]), turn[at]


def _track(detections: DataFrame, scale: float, c: Tracking, merged: bool) -> DataFrame:
    """Tracks of all clips. Rows wait in the task only for the end of their sample, or of their clip if it is merged."""

    def out(rows: pa.Table, track: np.ndarray) -> Iterator[pa.RecordBatch]:
        boxes = np.column_stack([rows[k].to_numpy() for k in "xywh"]) * scale
        sample, pieces = rows["sample_idx"].to_numpy(), np.ones(len(rows), np.int64)
        if merged:
            track, pieces = merge(track, sample.astype(np.int64), boxes, c)
        arrays = [rows["clip_id"].combine_chunks(), pa.array(track, pa.int32()), pa.array(pieces, pa.int32()), pa.array(sample, pa.int32()), *[pa.array(boxes[:, k]) for k in range(4)]]
        yield from pa.Table.from_arrays(arrays, names=["clip_id", "track_id", "fragments", "sample_idx", *"xywh"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, held, tracks, waiting = Linker(scale, c), [], [], run  # run: no clip yet

        def samples(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """Link all samples of rows but the last, which may go on in the next batch; keep what is not done."""
            nonlocal linker, held, tracks, waiting
            at, turn = _borders(rows)
            n = len(turn) - (not last)
            boxes, numbers = np.column_stack([rows[k].to_numpy() for k in "xywh"]), rows["sample_idx"].to_numpy()
            begun = 0
            for k in range(n):
                if turn[k] and (k or waiting is run or waiting != rows["clip_id"][0].as_py()):
                    if tracks:
                        held.append(rows.slice(begun, at[k] - begun))
                        yield from out(pa.concat_tables(held), np.array(tracks, np.int64))
                    linker, held, tracks, begun = Linker(scale, c), [], [], at[k]
                tracks += linker.add(int(numbers[at[k]]), boxes[at[k] : at[k + 1]])
            if n:
                waiting = rows["clip_id"][int(at[n - 1])].as_py()
                held.append(rows.slice(begun, at[n] - begun))
                if last or not merged:
                    yield from out(pa.concat_tables(held), np.array(tracks, np.int64))
                    held, tracks = [], []

        left = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if left is None else pa.concat_tables([left, rows]).combine_chunks()
                yield from samples(rows, last=False)
                begin = int(_borders(rows)[0][-2])
                left = rows.slice(begin)
        if left is not None:
            yield from samples(left.combine_chunks(), last=True)

    rows = detections.select("clip_id", F.col("sample_idx").cast("int").alias("sample_idx"), *[F.coalesce(F.col(k).cast("double"), F.lit(float("nan"))).alias(k) for k in "xywh"], "score", "det_idx")
    dealt = rows.where("sample_idx is not null").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "clip_id").sortWithinPartitions("clip_id", "sample_idx", F.desc("score"), "det_idx")
    return dealt.select("clip_id", "sample_idx", *"xywh").mapInArrow(run, BOXES)


def link_tracks(detections: DataFrame, scale: float = 1.0, c: Tracking = DEFAULT) -> DataFrame:
    """Boxes (in source pixels) of tracks of detections (clip_id, sample_idx, det_idx, x, y, w, h, score)."""
    return _track(detections, scale, c, merged=False)


def track_people(detections: DataFrame, scale: float = 1.0, c: Tracking = DEFAULT) -> DataFrame:
    """As link_tracks, with the fragments of one person merged."""
    return _track(detections, scale, c, merged=True)
