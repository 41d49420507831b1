"""Queries over the driver's tables, one for each operator. Each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numeric import even, exact_round, fixed, let
from ..operators import captions, debug, layout, scoring, selection, series, tracking, windows
from ..sources import clip_files, ingest, jobs, sinks
from ..streaming import intake
from . import render

WIDTH, HEIGHT = 60, 34
#: The stages that events of users stand for.
EVENT_STAGES = {"signup": "importing", "view": "transcribing", "click": "ranking", "purchase": "done", "error": "error"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def six(column: str):
    """Six decimals: sums of doubles differ in the last bits between engines."""
    return F.round(F.col(column), 6).alias(column)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.timeline(ingest.conversations(spark, sf_dir))


def segments_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.seconds(ingest.segments(ingest.conversations(spark, sf_dir)))


def candidates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.candidates(segments_of(spark, sf_dir))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_best(scoring.heuristic(candidates_of(spark, sf_dir)))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    cs = lambda c: F.bround(F.col(c) * 100).cast("long")
    return chosen(spark, sf_dir).select("job_id", "clip_idx", cs("start_s").alias("start_cs"), cs("end_s").alias("end_cs"))


def samples(spark: SparkSession, sf_dir: str) -> int:
    """Samples of an event clip: half-days from the first event to the last."""
    return ingest.event_grid(spark, sf_dir)[1]


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.track_stats(ingest.event_boxes(spark, sf_dir), samples(spark, sf_dir))


def event_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("clip_id")).distinct().withColumn("width", F.lit(WIDTH))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = series.gather(ingest.event_series(spark, sf_dir))
    return points.select("clip_id", series.fill(F.col("points"), samples(spark, sf_dir)).alias("v"))


def unrolled(rows: DataFrame, column: str = "v") -> DataFrame:
    out = rows.select("clip_id", F.posexplode(column).alias("sample_idx", "v"))
    return out.select("clip_id", F.col("sample_idx").cast("int").alias("sample_idx"), six("v"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each conversation: its turns as ids, the length of their texts and a quarter of the turn as scores.

    In all the shapes that replies take: alone, wrapped, as a map, in prose of the first turn's words, with numbers as texts,
    with two lists, among junk, with repeated ids, and one that cannot be used.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text", (F.length("text") + F.col("turn") / 4).alias("score"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "score"))).alias("t"), F.min_by("text", "turn").alias("first"))
    item = lambda x: F.struct(x["turn"].alias("id"), x["score"].alias("score"))
    texts = lambda x: F.struct(x["turn"].cast("string").alias("id"), F.concat(F.lit(" "), x["score"].cast("string")).alias("score"))
    bad = lambda x: F.struct(x["turn"].alias("id"), F.lit(-1.0).alias("score"))
    items, low = F.to_json(F.transform("t", item)), F.to_json(F.transform("t", bad))
    inner = lambda j: F.substring(j, F.lit(2), F.length(j) - 2)
    prose = F.translate("first", '[]{}"', "")
    shape = F.col("conv_id") % 9
    raw = (
        F.when(shape == 0, items)
        .when(shape == 1, F.concat(F.lit('{"scores":'), items, F.lit(',"model":"m"}')))
        .when(shape == 2, F.to_json(F.map_from_arrays(F.transform("t", lambda x: x["turn"].cast("string")), F.transform("t", lambda x: x["score"]))))
        .when(shape == 3, F.concat(prose, F.lit(": "), items, F.lit("\n"), prose))
        .when(shape == 4, F.to_json(F.transform("t", texts)))
        .when(shape == 5, F.concat(F.lit('{"z":'), items, F.lit(',"a":'), low, F.lit("}")))
        .when(shape == 6, F.concat(F.lit('[5,null,{"id":1},["a"],'), inner(items), F.lit(',{"id":"x y","score":1},{"id":2,"score":null}]')))
        .when(shape == 7, F.concat(F.lit("["), inner(low), F.lit(","), inner(items), F.lit("]")))
        .otherwise(F.to_json(F.element_at(F.transform("t", item), 1)))
    )
    return turns.select(F.col("conv_id").cast("string").alias("job_id"), raw.alias("raw"))


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs: the event's number names the stage."""
    names = F.array(*[F.lit(x) for x in ("queued", "importing", "transcribing", "ranking", "clipping", "done", "error")])
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_id").cast("string").alias("id"), F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("stage"), F.lit("hidden").alias("traceback"))


@query
def word_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.seconds(words(spark, sf_dir)).select("job_id", "word_idx", "start_s", "end_s", "word")


@query
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_of(spark, sf_dir).select("job_id", "seg_idx", "start_s", "end_s", "text")


@query
def window_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.enumerate_windows(segments_of(spark, sf_dir))


@query
def window_enumeration_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.binned_windows(segments_of(spark, sf_dir))


@query
def window_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.thin(windows.enumerate_windows(segments_of(spark, sf_dir))).select("job_id", "bucket", "i", "j", "start_s", "end_s", "text")


@query
def even_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_jobs = ingest.seconds(ingest.segments(ingest.documents(spark, sf_dir), one_turn=True, keep_text=False))
    return windows.candidates(long_jobs, texts=False).select("job_id", "id", "start_s", "end_s")


@query
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_of(spark, sf_dir)


@query
def prompt_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.prompt_listing(candidates_of(spark, sf_dir))


@query
def heuristic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.heuristic(candidates_of(spark, sf_dir)).select("job_id", "id", six("score"))


@query
def parse_scores_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.parse_replies(replies(spark, sf_dir))


@query
def score_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select(F.col("conv_id").cast("string").alias("job_id"), (F.col("turn") % 3).cast("int").alias("id"), F.col("turn").alias("pos"), F.length("text").cast("double").alias("score"))
    return scoring.last_scores(rows)


@query
def score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.join_scores(candidates_of(spark, sf_dir), scoring.parse_replies(replies(spark, sf_dir))).select("job_id", "id", "score")


@query
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rank(candidates_of(spark, sf_dir), scoring.parse_replies(replies(spark, sf_dir))).select("job_id", "id", six("score"), "note")


@query
def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir).select("job_id", "clip_idx", "id", "start_s", "end_s", "text", six("score"))


@query
def clip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.clip_words(words(spark, sf_dir), clips(spark, sf_dir))


@query
def caption_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.chunks(clip_words(spark, sf_dir))


@query
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.lines(caption_chunks(spark, sf_dir))


@query
def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.caption_files(caption_lines(spark, sf_dir)).select("job_id", "clip_idx", F.md5("value").alias("md5"), F.length("value").cast("long").alias("size"))


@query
def track_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select("clip_id", "track_id", "samples", six("coverage"))


@query
def track_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select("clip_id", "track_id", six("span"))


@query
def track_longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select("clip_id", "track_id", "longest_gap")


@query
def track_median_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).select("clip_id", "track_id", *[six(f"median_{c}") for c in "xywh"], six("center_x"))


@query
def track_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ranked(stats(spark, sf_dir)).select("clip_id", "track_id", "rank")


@query
def persistent_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ranked(stats(spark, sf_dir)).where("persistent").select("clip_id", "track_id")


@query
def layout_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = layout.plan_layout(stats(spark, sf_dir), event_clips(spark, sf_dir))
    return plan.select("clip_id", "layout", "reason", F.array_join(F.transform("tracks", lambda t: t.cast("string")), ",").alias("tracks"), six("separation"))


@query
def layout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.metrics(stats(spark, sf_dir), event_clips(spark, sf_dir), samples(spark, sf_dir))
    rows = found.select("*", F.posexplode_outer("tracks").alias("place", "t"))
    box = [F.get("t.median_box", k).alias(f"median_{c}") for k, c in enumerate("xywh")]
    limits = [F.col(f"thresholds.{k}").alias(k) for k in ("persistent_coverage", "min_separation_frac")]
    return rows.select("clip_id", "samples", "clip_seconds", "place", "t.id", "t.coverage", "t.span", "t.longest_gap_s", "t.fragments", *box, *limits, "separation", "strength_ratio", "second_span", "second_longest_gap_s")


@query
def layout_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = layout.note(layout.plan_layout(stats(spark, sf_dir), event_clips(spark, sf_dir)), samples(spark, sf_dir))
    return plan.select("clip_id", "note", text.layout_label(F.col("layout")).alias("label"))


@query
def series_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unrolled(filled(spark, sf_dir))


@query
def series_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unrolled(filled(spark, sf_dir).withColumn("v", series.moving_average(F.col("v"), 3)))


@query
def series_deadzone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unrolled(filled(spark, sf_dir).withColumn("v", series.dead_zone(F.col("v"), F.lit(5.0))))


@query
def series_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unrolled(series.smooth(filled(spark, sf_dir), F.lit(20.0), F.lit(float(WIDTH))), "origin")


@query
def series_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = filled(spark, sf_dir).withColumn("v", F.transform("v", lambda x: F.floor(x * 4) / F.lit(4.0)))
    rows = coarse.select("clip_id", F.explode(series.keyframes(F.col("v"))).alias("k"))
    return rows.select("clip_id", "k.t", "k.v")


@query
def keyframe_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = filled(spark, sf_dir).select("clip_id", F.size("v").alias("n"), series.keyframes(F.col("v")).alias("keys"))
    times = F.sequence(F.lit(0), F.col("n") - 1)
    return unrolled(keys.select("clip_id", let(F.col("keys"), lambda keys: F.transform(times, lambda i: series.value_at(keys, i / F.lit(2.0)))).alias("v")))


@query
def crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = events.select("event_id", (F.col("event_id") % 1500 + 300).cast("int").alias("width"), (F.col("event_id") % 900 + 200).cast("int").alias("height"), "value")
    w, h = series.single_size(F.col("width"), F.col("height"))
    w2, h2 = series.half_size(F.col("width"), F.col("height"), F.col("value"))
    return size.select("event_id", w.cast("int").alias("single_w"), h.cast("int").alias("single_h"), w2.cast("int").alias("half_w"), h2.cast("int").alias("half_h"), even(F.col("width")).alias("even_w"))


@query
def debug_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stats(spark, sf_dir).select("clip_id", "track_id", F.col("samples").alias("n"))
    return sizes.select("clip_id", "track_id", F.array_join(F.transform(series.debug_tiles(F.col("n")), lambda i: i.cast("string")), ",").alias("tiles"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = event_clips(spark, sf_dir).withColumn("height", F.lit(HEIGHT))
    return layout.crop_regions(layout.plan_layout(stats(spark, sf_dir), clips), ingest.event_boxes(spark, sf_dir), clips, samples(spark, sf_dir))


@query
def crop_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir).select("clip_id", "layout", F.posexplode("regions").alias("place", "r"))
    first, last = F.element_at("r.x_keys", F.lit(1)), F.element_at("r.x_keys", F.lit(-1))
    return rows.select("clip_id", "layout", "place", "r.track_id", "r.w", "r.h", F.size("r.x_keys").alias("n_keys"), first["v"].alias("x_first"), last["v"].alias("x_last"), F.element_at("r.y_keys", F.lit(1))["v"].alias("y_first"))


@query
def debug_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = samples(spark, sf_dir)
    plan = layout.note(layout.plan_layout(stats(spark, sf_dir), event_clips(spark, sf_dir)), n)
    rows = debug.tiles(plan.select("clip_id"), n).join(plan.select("clip_id", debug.title(F.col("layout"), F.col("note"), F.lit("stub"), n).alias("title")), "clip_id")
    return rows.select("clip_id", "tile", "row", "column", "sample_idx", "caption", "title")


@query
def debug_track_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = debug.tiles(event_clips(spark, sf_dir), samples(spark, sf_dir))
    return debug.track_boxes(shown, ingest.event_boxes(spark, sf_dir), stats(spark, sf_dir), scale=1.5)


@query
def debug_region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = debug.tiles(event_clips(spark, sf_dir), samples(spark, sf_dir))
    return debug.region_boxes(shown, regions(spark, sf_dir), scale=1.5)


@query
def filter_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = text.filter_path(F.concat(F.lit("C:\\clips\\"), "clip_id", F.lit(".ass")))
    plan = layout.plan_layout(stats(spark, sf_dir), event_clips(spark, sf_dir)).select("clip_id", "layout")
    rows = plan.join(regions(spark, sf_dir).drop("layout"), "clip_id", "left")
    return rows.select("clip_id", "layout", render.filter_graph(F.col("layout"), F.col("regions"), captions).alias("graph"))


def planned_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlight clips with the layout of the event clip of their job's number; the centre crop where there is none."""
    plan = layout.plan_layout(stats(spark, sf_dir), event_clips(spark, sf_dir)).select(F.col("clip_id").alias("job_id"), "layout")
    rows = chosen(spark, sf_dir).join(plan, "job_id", "left")
    return clip_files.clip_names(rows.withColumn("layout", F.coalesce("layout", F.lit("CENTER_CROP"))))


@query
def render_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planned_clips(spark, sf_dir)
    script = F.when(F.col("layout") != "CENTER_CROP", F.col("filter_file"))
    args = render.command(F.lit("source.mp4"), F.col("start_s"), F.col("end_s"), text.filter_option(F.lit(7)), script, F.col("caption_file"), F.col("clip_file"))
    return rows.select("job_id", "clip_idx", F.array_join(args, " ").alias("command"))


@query
def clip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.clip_records(planned_clips(spark, sf_dir), "/output").select("job_id", "layout", "index", "start_s", "end_s", "duration", six("score"), "url", "filename")


@query
def exact_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves that are exact in binary, halves that only seem so in decimals, and values off any grid."""
    v = F.col("value")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.explode(F.array(F.round(v, 0) / 8, F.round(v, 2) + 0.005, v * 1.0037, -v / 7, F.round(v, 2) * 1000 + 0.0005)).alias("x"))
    return rows.select("event_id", "x", exact_round(F.col("x"), 2).alias("hundredths"), exact_round(F.col("x"), 3).alias("thousandths"), exact_round(F.col("x"), 0).alias("whole"), fixed(F.col("x"), 1).alias("text"), fixed(F.col("x"), 3).alias("long_text"))


@query
def window_thinning_off_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at times that are no whole centiseconds."""
    off = segments_of(spark, sf_dir).withColumns({"start_s": F.col("start_s") * 1.0003 + 0.005, "end_s": F.col("end_s") * 1.0003 + 0.005})
    return windows.thin(windows.enumerate_windows(off)).select("job_id", "bucket", "i", "j", "start_s", "end_s")


@query
def greedy_selection_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all windows of a job, not of 40 candidates, those that a greedy choice takes."""
    every = windows.enumerate_windows(segments_of(spark, sf_dir))
    scored = scoring.heuristic(every.withColumn("id", (F.col("i") * 100_000 + F.col("j")).cast("int")))
    return selection.select_spread(scored, texts=False).select("job_id", "clip_idx", "id", "start_s", "end_s")


@query
def link_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.link_tracks(ingest.event_detections(spark, sf_dir))


@query
def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track_people(ingest.event_detections(spark, sf_dir))


@query
def detection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.event_detections(spark, sf_dir).withColumn("w", F.col("x"))
    return tracking.keep_wide(rows).groupBy("clip_id").agg(F.count("*").alias("n"))


@query
def detections_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracking.best_first(ingest.event_detections(spark, sf_dir).withColumn("score", F.col("x")))
    return rows.select("clip_id", "sample_idx", F.size("detections").alias("n"), six2("detections"))


def six2(column: str):
    return F.round(F.element_at(F.col(column), F.lit(1))["score"], 6).alias("best")


@query
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stage_counts(job_rows(spark, sf_dir))


@query
def job_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.health(job_rows(spark, sf_dir)).select("status", "running", "queued", "known")


@query
def job_public_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.public_view(jobs.with_status(job_rows(spark, sf_dir)))


@query
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.look_up(job_rows(spark, sf_dir), "7")


def user_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs, in the state that their last event leaves them in."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stage = F.col("event_type")
    for kind, name in EVENT_STAGES.items():
        stage = F.when(F.col("event_type") == kind, name).otherwise(stage)
    moves = events.select(F.col("user_id").cast("string").alias("id"), F.struct("ts", "event_id").alias("seq"), stage.alias("stage"), fixed(F.col("value"), 1).alias("detail"), F.when(stage == "error", F.col("props")).alias("error"))
    first = events.select(F.col("user_id").cast("string").alias("id")).distinct().select("id", F.lit("queued").alias("stage"), F.lit("").alias("status"), F.lit("").alias("detail"), F.lit(None).cast("string").alias("error"))
    return intake.latest_states(first, moves)


@query
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_jobs(spark, sf_dir)


@query
def job_states_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.health(user_jobs(spark, sf_dir)).select("status", "running", "queued", "known")


@query
def url_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" https://youtu.be/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return pages.select("page_id", text.is_source_url(url).alias("ok"))


@query
def public_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = F.concat(F.lit("clip_"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, ".mp4\n").when(F.col("page_id") % 4 == 1, ".mov").otherwise(".mp4"))
    return pages.select("page_id", text.is_public_file(name).alias("ok"))


@query
def served_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips in folders named by the paths of pages, with as many steps back as the page's number of lines allows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/?(.*)$", 1)
    back = F.repeat(F.lit("../"), (F.length("html") % 5).cast("int"))
    folder = F.concat(F.lit("./"), path, F.lit("//"), back)
    return pages.select("page_id", text.is_served(F.lit("/srv/out"), folder, F.lit("clip_1.mp4")).alias("ok"))


@query
def source_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = F.when(F.col("page_id") % 5 == 3, ".mp4").otherwise(".webm")
    return ingest.pick_source(pages.select((F.col("page_id") % 20).cast("string").alias("job_id"), F.concat(F.lit("source."), F.lpad(F.col("page_id").cast("string"), 9, "0"), kind).alias("path")))


@query
def encoder_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    version = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("n"), (F.col("page_id") % 10).cast("string"), F.lit(".1"))).when(F.col("page_id") % 3 == 1, F.concat((F.col("page_id") % 12).cast("string"), F.lit(".0.2-full"))).otherwise("N-127233-g0")
    major = text.encoder_major(F.concat(F.lit("ffmpeg version "), version, F.lit(" built")))
    return pages.select("page_id", major.alias("major"), text.filter_option(major).alias("option"))


@query
def page_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", text.clock(F.col("value") * 10).alias("clock"), text.html_escape(F.col("props")).alias("props"))
