"""Hooks for models: detectors, scorers and transcribers as Arrow functions with a checked result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scratch import Scratch

#: Results of the usual hooks.
DETECTIONS = "array<struct<sample_idx:int,det_idx:int,x:double,y:double,w:double,h:double,score:double>>"
REPLY = "string"
TRANSCRIPT = "struct<language:string,duration_seconds:double,segments:array<struct<start:double,end:double,text:string>>,words:array<struct<start:double,end:double,word:string>>>"


@dataclass(frozen=True)
class Hook:
    """A model: start() loads it, once in each worker, and returns a function of one item's inputs.

    result is the type of what the function returns, as a DDL string. batch is the number of items that are handed to a
    worker together; only one is held by the function at a time.
    """

    name: str
    inputs: tuple[str, ...]
    result: str
    start: Callable[[], Callable[..., object]]
    batch: int = 16
    version: str = field(default="1")


_HOOKS: dict[str, Hook] = {}
_STARTED: dict[tuple[str, str], Callable[..., object]] = {}


def register(hook: Hook) -> Hook:
    """Make a hook known by its name; a name that is taken by another one is an error."""
    known = _HOOKS.setdefault(hook.name, hook)
    if known != hook:
        raise ValueError(f"another hook is called {hook.name}")
    return hook


def get(name: str) -> Hook:
    if name not in _HOOKS:
        raise KeyError(f"no hook is called {name}; known: {', '.join(sorted(_HOOKS)) or 'none'}")
    return _HOOKS[name]


def _started(hook: Hook) -> Callable[..., object]:
    key = (hook.name, hook.version)
    if key not in _STARTED:
        _STARTED[key] = hook.start()
    return _STARTED[key]


def _text(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"


def _check(value: object, kind: T.DataType) -> None:
    """An error if a result lacks a field of its type or has others; null fits everywhere."""
    if value is None:
        return
    if isinstance(kind, T.ArrayType):
        for x in value:
            _check(x, kind.elementType)
    elif isinstance(kind, T.StructType):
        if not isinstance(value, dict) or set(value) != set(kind.names):
            raise TypeError(f"fields {kind.names} are needed")
        for f in kind.fields:
            _check(value[f.name], f.dataType)


def run_hook(rows: DataFrame, hook: Hook | str, keep: list[str] | None = None) -> DataFrame:
    """rows' kept columns with found (the hook's result for the row) and error (null if all went well).

    An item that fails, or whose result does not have the hook's type, gives a row with its error and a null result; the
    others are not touched. A model that cannot be started fails the job, as no item could be handled. Rows are not
    shuffled; a worker starts a model once, however many tasks it runs. found and error replace columns of these names.
    """
    hook = get(hook) if isinstance(hook, str) else hook
    missing = [c for c in hook.inputs if c not in rows.columns]
    if missing:
        raise ValueError(f"{hook.name} needs columns {missing}")
    kept = [c for c in (keep if keep is not None else rows.columns) if c not in ("found", "error")]
    source = rows.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(hook.inputs)])
    result = T._parse_datatype_string(hook.result)
    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField("found", result), T.StructField("error", T.StringType())])
    kind = to_arrow_type(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            for at in range(0, batch.num_rows, hook.batch):
                model = model or _started(hook)
                part = batch.slice(at, hook.batch)
                values, errors = [], []
                for i in range(part.num_rows):
                    try:
                        value = model(*[part.column(len(kept) + k)[i].as_py() for k in range(len(hook.inputs))])
                        _check(value, result)
                        values.append(pa.array([value], kind))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - whatever a model raises belongs to its item
                        values.append(pa.nulls(1, kind))
                        errors.append(_text(e))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.concat_arrays(values), pa.array(errors, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def detect(media: DataFrame, hook: Hook | str) -> tuple[DataFrame, DataFrame]:
    """Detections (clip_id, sample_idx, det_idx, x, y, w, h, score) of media (clip_id and the hook's inputs), and the clips that
    failed, with their errors, which are to be cropped to the centre. The model runs once: its results are written to the
    shared folder, and both tables read them."""
    done = Scratch(media.sparkSession).keep(run_hook(media, hook, keep=["clip_id"]))
    return done.select("clip_id", F.explode("found").alias("d")).select("clip_id", "d.*"), done.where("error is not null").select("clip_id", "error")


def reply(listings: DataFrame, hook: Hook | str) -> DataFrame:
    """Replies (job_id, raw, error) of a scorer to listings (job_id, listing); a failed one is null, so its job is ranked by the heuristic."""
    return run_hook(listings, hook, keep=["job_id"]).select("job_id", F.col("found").alias("raw"), "error")


def transcribe(audio: DataFrame, hook: Hook | str) -> DataFrame:
    """Transcripts (job_id, language, duration_seconds, segments, words, error) of audio (job_id and the hook's inputs)."""
    return run_hook(audio, hook, keep=["job_id"]).select("job_id", "found.*", "error")
