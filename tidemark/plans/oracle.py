"""The same queries in SQL, composed from common table expressions over the raw tables."""

from __future__ import annotations

from ..sources.sinks import HEADER

_WORDS = """
raw_words AS (
  SELECT CAST(conv_id AS VARCHAR) AS job_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: len(w) > 0) AS parts FROM conversations
), spread AS (
  SELECT job_id, turn, unnest(parts) AS word, unnest(range(1, len(parts) + 1)) AS pos FROM raw_words
), numbered AS (
  SELECT job_id, turn, word, row_number() OVER (PARTITION BY job_id ORDER BY turn, pos) - 1 AS k FROM spread
), words AS (
  SELECT job_id, CAST(k AS INTEGER) AS word_idx, turn, k * 40 + turn * 150 AS start_cs, k * 40 + turn * 150 + 36 AS end_cs, word FROM numbered
)"""
_SEGMENTS = """
marked AS (
  SELECT *, CASE WHEN coalesce(right(lag(word) OVER o, 1) IN ('.', '!', '?') OR lag(turn) OVER o <> turn, true) THEN 1 ELSE 0 END AS fresh
  FROM words WINDOW o AS (PARTITION BY job_id ORDER BY word_idx)
), grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) - 1 AS seg FROM marked
), segments AS (
  SELECT job_id, CAST(seg AS INTEGER) AS seg_idx, min(start_cs) / 100.0::DOUBLE AS start_s, max(end_cs) / 100.0::DOUBLE AS end_s, string_agg(word, ' ' ORDER BY word_idx) AS text
  FROM grouped GROUP BY job_id, seg
)"""
_PAIRS = """
pairs AS (
  SELECT a.job_id, a.seg_idx AS i, b.seg_idx AS j, a.start_s, b.end_s, b.end_s - a.start_s AS d
  FROM segments a JOIN segments b ON a.job_id = b.job_id AND b.seg_idx >= a.seg_idx AND b.start_s <= a.start_s + 60.0::DOUBLE
), open_pairs AS (
  SELECT *, max(d) OVER (PARTITION BY job_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pairs
), spans AS (
  SELECT job_id, i, j, start_s, end_s FROM open_pairs WHERE d BETWEEN 20.0::DOUBLE AND 60.0::DOUBLE AND (before IS NULL OR before < 40.0::DOUBLE)
)"""
_WINDOWS = """
windows AS (
  SELECT p.job_id, p.i, p.j, p.start_s, p.end_s, string_agg(s.text, ' ' ORDER BY s.seg_idx) AS text
  FROM spans p JOIN segments s ON s.job_id = p.job_id AND s.seg_idx BETWEEN p.i AND p.j
  GROUP BY p.job_id, p.i, p.j, p.start_s, p.end_s
)"""
_THIN = """
bucketed AS (
  SELECT job_id, CAST(floor(start_s / 8.0::DOUBLE) AS BIGINT) AS bucket, i, j, start_s, end_s, text FROM windows
), thin AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, bucket ORDER BY abs(end_s - start_s - 40.0::DOUBLE), i, j) AS r FROM bucketed
  ) WHERE r = 1
)"""
_NUMBER = """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_s) - 1 AS p, count(*) OVER (PARTITION BY job_id) AS n FROM thin
), picks AS (
  SELECT DISTINCT job_id, n, k, CASE WHEN n <= 40 THEN k ELSE CAST(floor(k * (n / 40.0::DOUBLE)) AS BIGINT) END AS p
  FROM (SELECT DISTINCT job_id, n FROM placed), range(0, 40) AS r(k)
), candidates AS (
  SELECT c.job_id, CAST(k.k AS INTEGER) AS id, c.start_s, c.end_s, c.text FROM placed c JOIN picks k ON c.job_id = k.job_id AND c.p = k.p
)"""
_SCORED = """
scored AS (
  SELECT *, len(string_split_regex(text, '\\s+')) / greatest(end_s - start_s, 1.0::DOUBLE) * 2
    + (1.0::DOUBLE - abs(end_s - start_s - 40.0::DOUBLE) / 40.0::DOUBLE) * 3
    + (CASE WHEN right(text, 1) IN ('.', '!', '?') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) * 2 AS score
  FROM candidates
)"""
_CHOSEN = """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, id) AS r FROM scored
), picked AS (
  SELECT job_id, r, CASE WHEN true THEN [struct_pack(s := start_s, e := end_s)] END AS taken, true AS kept FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.job_id, o.r,
    CASE WHEN len(p.taken) < 5 AND len(list_filter(p.taken, lambda t: o.start_s < t.e AND t.s < o.end_s)) = 0 THEN list_append(p.taken, struct_pack(s := o.start_s, e := o.end_s)) ELSE p.taken END,
    len(p.taken) < 5 AND len(list_filter(p.taken, lambda t: o.start_s < t.e AND t.s < o.end_s)) = 0
  FROM picked p JOIN ordered o ON o.job_id = p.job_id AND o.r = p.r + 1
), chosen AS (
  SELECT o.job_id, CAST(row_number() OVER (PARTITION BY o.job_id ORDER BY o.start_s) - 1 AS INTEGER) AS clip_idx, o.id, o.start_s, o.end_s, o.text, o.score
  FROM ordered o JOIN picked p ON o.job_id = p.job_id AND o.r = p.r WHERE p.kept
)"""
_CLIP_WORDS = """
clips AS (
  SELECT job_id, clip_idx, CAST(round_even(start_s * 100, 0) AS BIGINT) AS start_cs, CAST(round_even(end_s * 100, 0) AS BIGINT) AS end_cs FROM chosen
), clip_words AS (
  SELECT w.job_id, c.clip_idx, w.word_idx, w.start_cs - c.start_cs AS from_cs, w.end_cs - c.start_cs AS to_cs, w.word
  FROM words w JOIN clips c ON w.job_id = c.job_id AND w.end_cs > c.start_cs AND w.start_cs < c.end_cs
)"""
_CHUNKS = """
cuts AS (
  SELECT *, CASE WHEN coalesce(from_cs - lag(to_cs) OVER o > 100 OR right(lag(word) OVER o, 1) IN ('.', '!', '?', ','), false) THEN 1 ELSE 0 END AS cut
  FROM clip_words WINDOW o AS (PARTITION BY job_id, clip_idx ORDER BY word_idx)
), sessions AS (
  SELECT *, sum(cut) OVER (PARTITION BY job_id, clip_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS session FROM cuts
), parts AS (
  SELECT *, (row_number() OVER (PARTITION BY job_id, clip_idx, session ORDER BY word_idx) - 1) // 4 AS part FROM sessions
), chunk_rows AS (
  SELECT job_id, clip_idx, session, part, arg_min(from_cs, word_idx) AS from_cs, arg_max(to_cs, word_idx) AS to_cs, string_agg(word, ' ' ORDER BY word_idx) AS text
  FROM parts GROUP BY job_id, clip_idx, session, part
), chunks AS (
  SELECT job_id, clip_idx, CAST(row_number() OVER (PARTITION BY job_id, clip_idx ORDER BY session, part) - 1 AS INTEGER) AS chunk_idx, from_cs, to_cs, text FROM chunk_rows
)"""
_TIME = "(t // 360000) || ':' || lpad(CAST(t // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(t % 100 AS VARCHAR), 2, '0')"
_LINES = f"""
dialogue AS (
  SELECT job_id, clip_idx, chunk_idx,
    'Dialogue: 0,' || {_TIME.replace("t //", "greatest(from_cs, 0) //").replace("t %", "greatest(from_cs, 0) %")} || ',' || {_TIME.replace("t //", "greatest(to_cs, 0) //").replace("t %", "greatest(to_cs, 0) %")}
    || ',Default,,0,0,0,,' || translate(replace(text, '\\', '\\\\'), '{{}}', '()') AS line
  FROM chunks
)"""
_BINS = """
first_day AS (
  SELECT min(CAST(ts AS DATE)) AS day FROM events
), event_bins AS (
  SELECT CAST(user_id AS VARCHAR) AS clip_id, event_type, value, CAST(date_diff('day', (SELECT day FROM first_day), CAST(ts AS DATE)) * 2 + hour(ts) // 12 AS INTEGER) AS sample_idx
  FROM events WHERE ts IS NOT NULL
), size AS (
  SELECT max(sample_idx) + 1 AS n FROM event_bins
)"""
_TRACKS = """
centres AS (
  SELECT clip_id, event_type, sample_idx, median(value) AS cx FROM event_bins GROUP BY clip_id, event_type, sample_idx
), firsts AS (
  SELECT clip_id, event_type, min(sample_idx) AS f FROM centres GROUP BY clip_id, event_type
), ids AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY f, event_type) - 1 AS INTEGER) AS track_id FROM firsts
), boxes AS (
  SELECT c.clip_id, i.track_id, c.sample_idx, c.cx - 4 AS x, c.cx / 2 AS y, 8.0::DOUBLE AS w, 10.0::DOUBLE AS h,
    c.sample_idx - lag(c.sample_idx) OVER (PARTITION BY c.clip_id, i.track_id ORDER BY c.sample_idx) - 1 AS gap
  FROM centres c JOIN ids i ON c.clip_id = i.clip_id AND c.event_type = i.event_type
), stats AS (
  SELECT clip_id, track_id, CAST(count(*) AS INTEGER) AS samples, count(*) / (SELECT n FROM size)::DOUBLE AS coverage, (max(sample_idx) - min(sample_idx) + 1) / (SELECT n FROM size)::DOUBLE AS span,
    coalesce(max(gap), 0) / 2.0::DOUBLE AS longest_gap, min(sample_idx) AS first_idx,
    median(x) AS median_x, median(y) AS median_y, median(w) AS median_w, median(h) AS median_h, median(x) + median(w) / 2 AS center_x
  FROM boxes GROUP BY clip_id, track_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY coverage DESC, first_idx, track_id) AS INTEGER) AS rank,
    coverage >= 0.4::DOUBLE OR (coverage >= 0.25::DOUBLE AND span >= 0.7::DOUBLE) AS persistent
  FROM stats
)"""
_LAYOUT = """
good AS (
  SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY rank) AS k FROM ranked WHERE persistent
), event_clips AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS clip_id FROM events
), joined AS (
  SELECT c.clip_id, r.track_id AS t0, r.coverage AS c0, a.track_id AS t1, b.track_id AS t2, a.coverage AS c1, b.coverage AS c2, b.span AS s2,
    a.center_x AS x1, b.center_x AS x2, abs(a.center_x - b.center_x) / 60 AS separation, b.longest_gap AS g2,
    s.coverage AS cn, s.span AS sn, abs(r.center_x - s.center_x) / 60 AS separation_n
  FROM event_clips c LEFT JOIN ranked r ON r.clip_id = c.clip_id AND r.rank = 1 LEFT JOIN ranked s ON s.clip_id = c.clip_id AND s.rank = 2
  LEFT JOIN good a ON a.clip_id = c.clip_id AND a.k = 1 LEFT JOIN good b ON b.clip_id = c.clip_id AND b.k = 2
), decided AS (
  SELECT *, CASE
      WHEN t0 IS NULL THEN 'no faces'
      WHEN t2 IS NOT NULL AND separation < 0.15::DOUBLE THEN 'too close'
      WHEN t2 IS NOT NULL AND c2 < 0.5::DOUBLE * c1 AND s2 < 0.7::DOUBLE THEN 'second face dominated'
      WHEN t2 IS NOT NULL THEN 'two persistent faces'
      WHEN c0 >= 0.3::DOUBLE THEN 'one persistent face'
      ELSE 'faces too sporadic' END AS reason
  FROM joined
), planned AS (
  SELECT *, CASE WHEN reason IN ('no faces', 'faces too sporadic') THEN 'CENTER_CROP' WHEN reason = 'two persistent faces' THEN 'TWO_PERSON' ELSE 'SINGLE_PERSON' END AS layout FROM decided
)"""


def _filled(points: str, name: str) -> str:
    """name: points (clip_id, sample_idx, v) at every sample, linear between them."""
    return f"""
{name}_grid AS (
  SELECT c.clip_id, CAST(r.i AS INTEGER) AS sample_idx, p.v, CASE WHEN p.v IS NOT NULL THEN CAST(r.i AS INTEGER) END AS s
  FROM (SELECT DISTINCT clip_id FROM {points}) c CROSS JOIN (SELECT unnest(range(0, n)) AS i FROM size) r LEFT JOIN {points} p ON p.clip_id = c.clip_id AND p.sample_idx = r.i
), {name}_sided AS (
  SELECT clip_id, sample_idx,
    last_value(v IGNORE NULLS) OVER b AS v0, last_value(s IGNORE NULLS) OVER b AS s0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(s IGNORE NULLS) OVER a AS s1
  FROM {name}_grid
  WINDOW b AS (PARTITION BY clip_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY clip_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), {name} AS (
  SELECT clip_id, sample_idx, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR s0 = s1 THEN v0 ELSE v0 + (v1 - v0) / (s1 - s0) * (sample_idx - s0) END AS v FROM {name}_sided
)"""


_SERIES = (
    """
points AS (
  SELECT clip_id, sample_idx, median(value) AS v FROM event_bins GROUP BY clip_id, sample_idx
)""",
    _filled("points", "filled"),
)


def _average(source: str, name: str, half: int) -> str:
    return f"""
{name} AS (
  SELECT a.clip_id, a.sample_idx, sum(b.v ORDER BY o.o) / {2 * half + 1}.0::DOUBLE AS v
  FROM {source} a CROSS JOIN range(-{half}, {half + 1}) AS o(o) JOIN {source} b ON b.clip_id = a.clip_id AND b.sample_idx = greatest(0, least((SELECT n - 1 FROM size), a.sample_idx + o.o))
  GROUP BY a.clip_id, a.sample_idx
)"""


def _dead(source: str, name: str, dead: str) -> str:
    return f"""
{name} AS (
  SELECT clip_id, sample_idx, v FROM {source} WHERE sample_idx = 0
  UNION ALL
  SELECT x.clip_id, x.sample_idx, CASE WHEN abs(x.v - d.v) > {dead} THEN x.v ELSE d.v END
  FROM {name} d JOIN {source} x ON x.clip_id = d.clip_id AND x.sample_idx = d.sample_idx + 1
)"""


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


_TO_WINDOWS = (_WORDS, _SEGMENTS, _PAIRS, _WINDOWS)
_TO_CANDIDATES = (*_TO_WINDOWS, _THIN, _NUMBER)
_TO_CHOSEN = (*_TO_CANDIDATES, _SCORED, _CHOSEN)
_TO_CHUNKS = (*_TO_CHOSEN, _CLIP_WORDS, _CHUNKS)
_TO_TRACKS = (_BINS, _TRACKS)
_TO_SERIES = (_BINS, *_SERIES)
_DOCUMENT_WORDS = _WORDS.replace("CAST(conv_id AS VARCHAR) AS job_id, turn,", "CAST(doc_id AS VARCHAR) AS job_id, 0::BIGINT AS turn,").replace("FROM conversations", "FROM documents")
_KEYS = """
coarse AS (
  SELECT clip_id, sample_idx, floor(v * 4) / 4.0::DOUBLE AS v FROM filled
), sides AS (
  SELECT clip_id, sample_idx, round_even(v, 1) AS r, lag(v) OVER o AS a, lead(v) OVER o AS b FROM coarse WINDOW o AS (PARTITION BY clip_id ORDER BY sample_idx)
)"""
_REPLY = """
replied AS (
  SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(turn AS BIGINT) AS id, CAST(length(text) + turn / 4.0::DOUBLE AS DOUBLE) AS score FROM conversations WHERE conv_id % 9 <> 8
)"""
_TWO_74 = 2**74


def _exact(x: str, digits: int, body: str) -> str:
    """body of p.x, p.n (whole part of its size) and p.u (the rest in units of the last digit, rounded half-even): exact, as
    the rest times 2^74 is a whole number."""
    one, half = _TWO_74, _TWO_74 // 2
    odd = f"p.h // {one} % 2 = 1" if digits else f"(p.h // {one} + CAST(p.n AS HUGEINT)) % 2 = 1"
    units = f"p.h // {one} + CASE WHEN p.h % {one} > {half} OR (p.h % {one} = {half} AND {odd}) THEN 1 ELSE 0 END"
    first = f"list_transform([CAST({x} AS DOUBLE)], lambda z: struct_pack(x := z, n := floor(abs(z)), h := CAST((abs(z) - floor(abs(z))) * {float(one)!r}::DOUBLE AS HUGEINT) * {10**digits}))"
    return f"list_transform(list_transform({first}, lambda p: struct_pack(x := p.x, n := p.n, u := {units})), lambda p: {body})[1]"


def _rounded(x: str, digits: int) -> str:
    return _exact(x, digits, f"CASE WHEN p.x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * ((p.n * {10**digits} + CAST(p.u AS DOUBLE)) / {10**digits}.0::DOUBLE)")


def _fixed(x: str, digits: int) -> str:
    unit = 10**digits
    text = f"CAST(CAST(p.n AS HUGEINT) + p.u // {unit} AS VARCHAR)" + (f" || '.' || lpad(CAST(p.u % {unit} AS VARCHAR), {digits}, '0')" if digits else "")
    return _exact(x, digits, f"CASE WHEN p.x < 0 THEN '-' ELSE '' END || {text}")


def _percent(x: str) -> str:
    return f"{_fixed(f'{x} * 100', 0)} || '%'"


_SHOWN = """
shown AS (
  SELECT clip_id, layout, 0 AS place, CASE WHEN layout = 'SINGLE_PERSON' THEN coalesce(CASE WHEN t2 IS NOT NULL THEN t1 END, t0) WHEN x1 <= x2 THEN t1 ELSE t2 END AS track_id FROM planned WHERE layout <> 'CENTER_CROP'
  UNION ALL SELECT clip_id, layout, 1, CASE WHEN x1 <= x2 THEN t2 ELSE t1 END FROM planned WHERE layout = 'TWO_PERSON'
), heights AS (
  SELECT s.*, s.clip_id || '/' || s.place AS key, least(greatest(t.median_h * 3.2::DOUBLE, 34 * 0.45::DOUBLE), 34.0::DOUBLE) AS hh FROM shown s JOIN stats t ON t.clip_id = s.clip_id AND t.track_id = s.track_id
), regions AS (
  SELECT clip_id, layout, place, track_id, key,
    CAST(CASE WHEN layout = 'TWO_PERSON' THEN round_even((CASE WHEN hh * 9 / 8 > 60 THEN 60 ELSE hh * 9 / 8 END) / 2, 0) * 2 ELSE round_even(34 * 9 / 16.0::DOUBLE / 2, 0) * 2 END AS INTEGER) AS w,
    CAST(CASE WHEN layout = 'TWO_PERSON' THEN round_even((CASE WHEN hh * 9 / 8 > 60 THEN 60 * 8 / 9.0::DOUBLE ELSE hh END) / 2, 0) * 2 ELSE 34 END AS INTEGER) AS h
  FROM heights
), x_points AS (
  SELECT r.key AS clip_id, b.sample_idx, b.x + b.w / 2 AS v FROM regions r JOIN boxes b ON b.clip_id = r.clip_id AND b.track_id = r.track_id
), y_points AS (
  SELECT r.key AS clip_id, b.sample_idx, b.y + b.h / 2 AS v FROM regions r JOIN boxes b ON b.clip_id = r.clip_id AND b.track_id = r.track_id
)"""


def _smoothed(source: str, name: str, size: str, limit: int) -> tuple[str, ...]:
    """name: where a crop begins that follows source, and its keyframes (clip_id, sample_idx, t, v) as name_keys."""
    moves = f"""
{name}_dead AS (
  SELECT clip_id, sample_idx, v FROM {name}_mean WHERE sample_idx = 0
  UNION ALL
  SELECT x.clip_id, x.sample_idx, CASE WHEN abs(x.v - d.v) > 0.06::DOUBLE * r.{size} THEN x.v ELSE d.v END
  FROM {name}_dead d JOIN {name}_mean x ON x.clip_id = d.clip_id AND x.sample_idx = d.sample_idx + 1 JOIN regions r ON r.key = x.clip_id
)"""
    origin = f"""
{name} AS (
  SELECT g.clip_id, g.sample_idx, least(greatest(g.v - r.{size} / 2.0::DOUBLE, 0.0::DOUBLE), greatest({limit} - r.{size}, 0)::DOUBLE) AS v FROM {name}_glide g JOIN regions r ON r.key = g.clip_id
), {name}_sides AS (
  SELECT clip_id, sample_idx, {_rounded("v", 1)} AS r, lag(v) OVER o AS a, lead(v) OVER o AS b FROM {name} WINDOW o AS (PARTITION BY clip_id ORDER BY sample_idx)
), {name}_keys AS (
  SELECT clip_id, sample_idx, sample_idx / 2.0::DOUBLE AS t, r AS v FROM {name}_sides WHERE sample_idx IN (0, (SELECT n - 1 FROM size)) OR NOT (abs(r - a) < 0.5 AND abs(r - b) < 0.5)
)"""
    return (_average(source, f"{name}_mean", 3), moves, _average(f"{name}_dead", f"{name}_glide", 2), origin)


_REGIONS = (
    _SHOWN,
    _filled("x_points", "xs"),
    _filled("y_points", "ys"),
    *_smoothed("xs", "x_crop", "w", 60),
    f"ys_low AS (SELECT y.clip_id, y.sample_idx, y.v + r.h * {0.5 - 0.42!r}::DOUBLE AS v FROM ys y JOIN regions r ON r.key = y.clip_id WHERE r.layout = 'TWO_PERSON')",
    *_smoothed("ys_low", "y_crop", "h", 34),
    f"""
y_keys AS (
  SELECT * FROM y_crop_keys
  UNION ALL
  SELECT r.key, 0, 0.0::DOUBLE, {_rounded("least(greatest(m.v - r.h * 0.4::DOUBLE, 0.0::DOUBLE), greatest(34 - r.h, 0)::DOUBLE)", 1)}
  FROM regions r JOIN (SELECT clip_id, median(v) AS v FROM ys GROUP BY clip_id) m ON m.clip_id = r.key WHERE r.layout = 'SINGLE_PERSON'
)""",
)


def _expression(keys: str, name: str) -> str:
    """name: the nested text of each clip_id's keyframes."""
    piece = f"'if(lt(t,' || {_fixed('t1', 3)} || '),(' || {_fixed('v', 1)} || '+(' || {_fixed('v1 - v', 1)} || ')*(t-' || {_fixed('t', 3)} || ')/' || {_fixed('greatest(t1 - t, 0.001::DOUBLE)', 3)} || '),'"
    return f"""
{name}_next AS (
  SELECT *, lead(t) OVER o AS t1, lead(v) OVER o AS v1, first_value(v) OVER o AS f FROM {keys} WINDOW o AS (PARTITION BY clip_id ORDER BY t)
), {name}_pieces AS (
  SELECT clip_id, t, abs(v - f) < 0.5 AS still, {_fixed("f", 1)} AS first, {_fixed("v", 1)} AS own, CASE WHEN t1 IS NOT NULL THEN {piece} END AS piece FROM {name}_next
), {name} AS (
  SELECT clip_id, CASE WHEN count(*) = 1 OR bool_and(still) THEN min(first) ELSE string_agg(piece, '' ORDER BY t) || arg_max(own, t) || repeat(')', CAST(count(*) - 1 AS INTEGER)) END AS text
  FROM {name}_pieces GROUP BY clip_id
)"""


_TILES = """
tiles AS (
  SELECT CAST(i AS INTEGER) AS tile, CAST(CASE WHEN i = m - 1 THEN CASE WHEN m > 1 THEN n - 1 ELSE 0 END ELSE floor(i * ((n - 1) / greatest(m - 1, 1)::DOUBLE)) END AS INTEGER) AS sample_idx
  FROM (SELECT n, least(n, 12) AS m, unnest(range(0, least(n, 12))) AS i FROM size)
)"""


def _key_at(keys: str, name: str) -> str:
    """name: the value of each region's keyframes at each tile, cut down to a whole number."""
    return f"""
{name}_near AS (
  SELECT k.clip_id, p.tile, p.sample_idx / 2.0::DOUBLE AS t, max(k.t) FILTER (k.t <= p.sample_idx / 2.0::DOUBLE) AS t0, arg_max(k.v, k.t) FILTER (k.t <= p.sample_idx / 2.0::DOUBLE) AS v0,
    min(k.t) FILTER (k.t > p.sample_idx / 2.0::DOUBLE) AS t1, arg_min(k.v, k.t) FILTER (k.t > p.sample_idx / 2.0::DOUBLE) AS v1
  FROM {keys} k CROSS JOIN tiles p GROUP BY k.clip_id, p.tile, p.sample_idx
), {name} AS (
  SELECT clip_id, tile, CAST(trunc(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END) AS INTEGER) AS v FROM {name}_near
)"""


def _pixel(x: str) -> str:
    return f"CAST(trunc(({x}) * {1.0 / 1.5!r}::DOUBLE) AS INTEGER)"


_LINKED = """
detections AS (
  SELECT clip_id, sample_idx, value AS x, CAST(row_number() OVER (PARTITION BY clip_id, sample_idx ORDER BY value DESC, event_type) - 1 AS INTEGER) AS i FROM event_bins
), taken_at AS (
  SELECT clip_id, sample_idx AS s, row_number() OVER (PARTITION BY clip_id ORDER BY sample_idx) AS k, list(struct_pack(i := i, x := x) ORDER BY i) AS dets FROM detections GROUP BY clip_id, sample_idx
), linking AS (
  SELECT clip_id, k, s, dets AS todo, CAST([] AS STRUCT(id INTEGER, seen INTEGER, x DOUBLE)[]) AS tracks, 0 AS made, CAST([] AS STRUCT(track INTEGER, s INTEGER, x DOUBLE)[]) AS out FROM taken_at WHERE k = 1
  UNION ALL
  SELECT clip_id, CASE WHEN best IS NULL THEN k + 1 ELSE k END, CASE WHEN best IS NULL THEN next_s ELSE s END,
    CASE WHEN best IS NULL THEN next_dets ELSE list_filter(todo, lambda d: d.i <> best.i) END,
    CASE WHEN best IS NULL THEN list_concat(tracks, list_transform(todo, lambda d, j: struct_pack(id := CAST(made + j - 1 AS INTEGER), seen := s, x := d.x)))
      ELSE list_transform(tracks, lambda t: CASE WHEN t.id = best.t THEN struct_pack(id := t.id, seen := s, x := best.x) ELSE t END) END,
    CASE WHEN best IS NULL THEN CAST(made + len(todo) AS INTEGER) ELSE made END,
    CASE WHEN best IS NULL THEN list_transform(todo, lambda d, j: struct_pack(track := CAST(made + j - 1 AS INTEGER), s := s, x := d.x)) ELSE [struct_pack(track := best.t, s := s, x := best.x)] END
  FROM (
    SELECT l.*, n.s AS next_s, n.dets AS next_dets, list_min(flatten(list_transform(l.todo, lambda d: list_transform(
      list_filter(l.tracks, lambda t: t.seen < l.s AND l.s - t.seen <= 16 AND abs((d.x + 4) - (t.x + 4)) / 8 <= 1),
      lambda t: struct_pack(far := abs((d.x + 4) - (t.x + 4)) / 8, t := t.id, i := d.i, x := d.x))))) AS best
    FROM linking l LEFT JOIN taken_at n ON n.clip_id = l.clip_id AND n.k = l.k + 1 WHERE l.todo IS NOT NULL
  )
), linked AS (
  SELECT clip_id, o.track AS track_id, o.s AS sample_idx, o.x AS x FROM (SELECT clip_id, unnest(out) AS o FROM linking)
)"""
_MERGED = """
pieces AS (
  SELECT clip_id, track_id, row_number() OVER (PARTITION BY clip_id ORDER BY min(sample_idx), track_id) AS k, list(struct_pack(s := sample_idx, x := x) ORDER BY sample_idx) AS own FROM linked GROUP BY clip_id, track_id
), merging AS (
  SELECT clip_id, k, [struct_pack(id := track_id, n := 1, own := own)] AS people FROM pieces WHERE k = 1
  UNION ALL
  SELECT clip_id, k, CASE WHEN spot IS NULL THEN list_append(people, struct_pack(id := track_id, n := 1, own := own))
    ELSE list_transform(people, lambda m, j: CASE WHEN j = spot THEN struct_pack(id := m.id, n := m.n + 1, own := list_concat(m.own, own)) ELSE m END) END
  FROM (
    SELECT p.clip_id, p.k, p.track_id, p.own, m.people, nullif(list_position(list_transform(m.people, lambda q:
      NOT list_has_any(list_transform(q.own, lambda o: o.s), list_transform(p.own, lambda o: o.s))
      AND abs((list_aggregate(list_transform(q.own, lambda o: o.x), 'median') + 4) - (list_aggregate(list_transform(p.own, lambda o: o.x), 'median') + 4)) <= 8), true), 0) AS spot
    FROM merging m JOIN pieces p ON p.clip_id = m.clip_id AND p.k = m.k + 1
  )
), people AS (
  SELECT clip_id, unnest(people) AS q FROM (SELECT *, max(k) OVER (PARTITION BY clip_id) AS last FROM merging) WHERE k = last
), merged AS (
  SELECT clip_id, q.id AS track_id, q.n AS fragments, unnest(q.own) AS o FROM people
)"""
_JOBS = """
jobs AS (
  SELECT CAST(event_id AS VARCHAR) AS id, (['queued', 'importing', 'transcribing', 'ranking', 'clipping', 'done', 'error'])[event_id % 7 + 1] AS stage FROM events
)"""

_STATES = """
states AS (
  SELECT CAST(user_id AS VARCHAR) AS id, CASE event_type WHEN 'signup' THEN 'importing' WHEN 'view' THEN 'transcribing' WHEN 'click' THEN 'ranking' WHEN 'purchase' THEN 'done' ELSE event_type END AS stage, value, props
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
)"""

SQL: dict[str, str] = {
    "word_timeline": _with(_WORDS, select="SELECT job_id, word_idx, start_cs / 100.0::DOUBLE AS start_s, end_cs / 100.0::DOUBLE AS end_s, word FROM words"),
    "segments": _with(_WORDS, _SEGMENTS, select="SELECT job_id, seg_idx, start_s, end_s, text FROM segments"),
    "window_enumeration": _with(*_TO_WINDOWS, select="SELECT job_id, i, j, start_s, end_s, text FROM windows"),
    "window_enumeration_binned": _with(_WORDS, _SEGMENTS, _PAIRS, select="SELECT job_id, i, j, start_s, end_s FROM spans"),
    "window_thinning": _with(*_TO_WINDOWS, _THIN, select="SELECT job_id, bucket, i, j, start_s, end_s, text FROM thin"),
    "even_sampling": _with(_DOCUMENT_WORDS, _SEGMENTS, _PAIRS, "windows AS (SELECT *, '' AS text FROM spans)", _THIN, _NUMBER, select="SELECT job_id, id, start_s, end_s FROM candidates"),
    "candidate_ids": _with(*_TO_CANDIDATES, select="SELECT job_id, id, start_s, end_s, text FROM candidates"),
    "prompt_listing": _with(*_TO_CANDIDATES, select="SELECT job_id, string_agg('[id=' || id || '] (' || CAST(round_even(end_s - start_s, 0) AS INTEGER) || 's) ' || text, chr(10) || chr(10) ORDER BY id) AS listing FROM candidates GROUP BY job_id"),
    "heuristic_scores": _with(*_TO_CANDIDATES, _SCORED, select="SELECT job_id, id, round(score, 6) AS score FROM scored"),
    "parse_scores_tolerant": _with(_REPLY, select="SELECT job_id, CAST(id AS BIGINT) AS id, CAST(score AS DOUBLE) AS score FROM replied"),
    "score_dedup": "SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(turn % 3 AS INTEGER) AS id, CAST(arg_max(length(text), turn) AS DOUBLE) AS score FROM conversations GROUP BY conv_id, turn % 3",
    "score_join": _with(*_TO_CANDIDATES, _REPLY, select="SELECT c.job_id, c.id, coalesce(CAST(r.score AS DOUBLE), 0.0::DOUBLE) AS score FROM candidates c LEFT JOIN replied r ON c.job_id = r.job_id AND c.id = r.id"),
    "ranked_candidates": _with(
        *_TO_CANDIDATES,
        _SCORED,
        _REPLY,
        select="""SELECT c.job_id, c.id, CASE WHEN h.job_id IS NULL THEN round(c.score, 6) ELSE coalesce(CAST(r.score AS DOUBLE), 0.0::DOUBLE) END AS score,
  CASE WHEN h.job_id IS NULL THEN 'Ollama unavailable (ValueError); used heuristic ranking' ELSE 'ranked by model' END AS note
FROM scored c LEFT JOIN (SELECT DISTINCT job_id FROM replied) h ON h.job_id = c.job_id LEFT JOIN replied r ON r.job_id = c.job_id AND r.id = c.id""",
    ),
    "greedy_selection": _with(*_TO_CHOSEN, select="SELECT job_id, clip_idx, id, start_s, end_s, text, round(score, 6) AS score FROM chosen"),
    "clip_words": _with(*_TO_CHOSEN, _CLIP_WORDS, select="SELECT job_id, clip_idx, word_idx, from_cs, to_cs, word FROM clip_words"),
    "caption_chunks": _with(*_TO_CHUNKS, select="SELECT job_id, clip_idx, chunk_idx, from_cs, to_cs, text FROM chunks"),
    "caption_lines": _with(*_TO_CHUNKS, _LINES, select="SELECT job_id, clip_idx, chunk_idx, line FROM dialogue"),
    "caption_files": _with(
        *_TO_CHUNKS,
        _LINES,
        f"files AS (SELECT job_id, clip_idx, '{HEADER.format(alignment=2)}' || string_agg(line, chr(10) ORDER BY chunk_idx) || chr(10) AS value FROM dialogue GROUP BY job_id, clip_idx)",
        select="SELECT job_id, clip_idx, md5(value) AS md5, length(value) AS size FROM files",
    ),
    "exact_rounding": f"""
SELECT event_id, x, {_rounded("x", 2)} AS hundredths, {_rounded("x", 3)} AS thousandths, {_rounded("x", 0)} AS whole, {_fixed("x", 1)} AS text, {_fixed("x", 3)} AS long_text
FROM (SELECT event_id, unnest([round(value, 0) / 8, round(value, 2) + 0.005::DOUBLE, value * 1.0037::DOUBLE, -value / 7, round(value, 2) * 1000 + 0.0005::DOUBLE]) AS x FROM events)""",
    "window_thinning_off_grid": _with(
        _WORDS,
        _SEGMENTS.replace("segments AS (", "even_segments AS ("),
        "segments AS (SELECT job_id, seg_idx, start_s * 1.0003::DOUBLE + 0.005::DOUBLE AS start_s, end_s * 1.0003::DOUBLE + 0.005::DOUBLE AS end_s, text FROM even_segments)",
        _PAIRS,
        f"windows AS (SELECT job_id, i, j, {_rounded('start_s', 2)} AS start_s, {_rounded('end_s', 2)} AS end_s, '' AS text FROM spans)",
        _THIN,
        select="SELECT job_id, bucket, i, j, start_s, end_s FROM thin",
    ),
    "greedy_selection_spread": _with(
        *_TO_WINDOWS, "candidates AS (SELECT job_id, CAST(i * 100000 + j AS INTEGER) AS id, start_s, end_s, text FROM windows)", _SCORED, _CHOSEN, select="SELECT job_id, clip_idx, id, start_s, end_s FROM chosen"
    ),
    "layout_metrics": _with(
        *_TO_TRACKS,
        select=f"""SELECT c.clip_id, CAST((SELECT n FROM size) AS INTEGER) AS samples, (SELECT n FROM size) / 2.0::DOUBLE AS clip_seconds, r.rank - 1 AS place, r.track_id AS id,
  {_rounded("r.coverage", 3)} AS coverage, {_rounded("r.span", 3)} AS span, {_rounded("r.longest_gap", 1)} AS longest_gap_s, CASE WHEN r.track_id IS NOT NULL THEN 1 END AS fragments,
  {", ".join(f"{_rounded(f'r.median_{k}', 1)} AS median_{k}" for k in "xywh")}, 0.4::DOUBLE AS persistent_coverage, 0.15::DOUBLE AS min_separation_frac,
  {_rounded("abs(a.center_x - b.center_x) / 60", 3)} AS separation, {_rounded("b.coverage / a.coverage", 3)} AS strength_ratio, {_rounded("b.span", 3)} AS second_span, {_rounded("b.longest_gap", 1)} AS second_longest_gap_s
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS clip_id FROM events) c LEFT JOIN ranked r ON r.clip_id = c.clip_id
LEFT JOIN ranked a ON a.clip_id = c.clip_id AND a.rank = 1 LEFT JOIN ranked b ON b.clip_id = c.clip_id AND b.rank = 2""",
    ),
    "layout_notes": _with(
        *_TO_TRACKS,
        _LAYOUT,
        select=f"""SELECT clip_id, CASE WHEN t0 IS NULL THEN 'no frames or no faces detected'
  WHEN t2 IS NOT NULL THEN reason || ' (coverage ' || {_percent("c1")} || ' / ' || {_percent("c2")} || ', ratio ' || {_fixed("c2 / c1", 2)} || ', span ' || {_percent("s2")} || ', gap ' || {_fixed("g2", 0)}
    || 's, separation ' || {_percent("separation")} || ', samples ' || (SELECT n FROM size) || ')'
  WHEN layout = 'SINGLE_PERSON' THEN reason || ' (coverage ' || {_percent("c0")} || ', samples ' || (SELECT n FROM size)
    || coalesce(', second face coverage ' || {_percent("cn")} || ' span ' || {_percent("sn")} || ' separation ' || {_percent("separation_n")}, '') || ')'
  ELSE reason || ' (best coverage ' || {_percent("c0")} || ', samples ' || (SELECT n FROM size) || ')' END AS note,
  CASE layout WHEN 'TWO_PERSON' THEN 'split-screen' WHEN 'SINGLE_PERSON' THEN 'face-centred' ELSE 'centre crop' END AS label
FROM planned""",
    ),
    "debug_tiles": _with(
        *_TO_TRACKS,
        select="""SELECT clip_id, track_id, array_to_string(list_transform(range(0, least(samples, 12)), lambda i: CAST(CASE WHEN i = least(samples, 12) - 1 THEN CASE WHEN samples > 1 THEN samples - 1 ELSE 0 END
  ELSE CAST(floor(i * ((samples - 1) / greatest(least(samples, 12) - 1, 1)::DOUBLE)) AS INTEGER) END AS VARCHAR)), ',') AS tiles FROM stats""",
    ),
    "keyframe_lookup": _with(
        *_TO_SERIES,
        _KEYS.replace("floor(v * 4) / 4.0::DOUBLE AS v", "v").replace("round_even(v, 1)", _rounded("v", 1)),
        "keys AS (SELECT clip_id, sample_idx, sample_idx / 2.0::DOUBLE AS t, r AS v FROM sides WHERE sample_idx IN (0, (SELECT n - 1 FROM size)) OR NOT (abs(r - a) < 0.5 AND abs(r - b) < 0.5))",
        """near AS (
  SELECT f.clip_id, f.sample_idx, f.sample_idx / 2.0::DOUBLE AS t, last_value(k.v IGNORE NULLS) OVER b AS v0, last_value(k.t IGNORE NULLS) OVER b AS t0, first_value(k.v IGNORE NULLS) OVER a AS v1, first_value(k.t IGNORE NULLS) OVER a AS t1
  FROM filled f LEFT JOIN keys k ON k.clip_id = f.clip_id AND k.sample_idx = f.sample_idx
  WINDOW b AS (PARTITION BY f.clip_id ORDER BY f.sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY f.clip_id ORDER BY f.sample_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
)""",
        select="SELECT clip_id, sample_idx, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS v FROM near",
    ),
    "crop_regions": _with(
        *_TO_TRACKS,
        _LAYOUT,
        *_REGIONS,
        select="""SELECT r.clip_id, r.layout, r.place, r.track_id, r.w, r.h, CAST(x.n AS INTEGER) AS n_keys, x.a AS x_first, x.b AS x_last, y.a AS y_first
FROM regions r JOIN (SELECT clip_id, count(*) AS n, arg_min(v, t) AS a, arg_max(v, t) AS b FROM x_crop_keys GROUP BY clip_id) x ON x.clip_id = r.key
JOIN (SELECT clip_id, arg_min(v, t) AS a FROM y_keys GROUP BY clip_id) y ON y.clip_id = r.key""",
    ),
    "filter_graphs": _with(
        *_TO_TRACKS,
        _LAYOUT,
        *_REGIONS,
        _expression("x_crop_keys", "x_text"),
        _expression("y_keys", "y_text"),
        """crops AS (
  SELECT r.clip_id, r.place, 'crop=' || r.w || ':' || r.h || ':x=''' || x.text || ''':y=''' || y.text || '''' AS crop FROM regions r JOIN x_text x ON x.clip_id = r.key JOIN y_text y ON y.clip_id = r.key
)""",
        select="""SELECT p.clip_id, p.layout, CASE p.layout WHEN 'SINGLE_PERSON' THEN '[0:v]' || a.crop || ',scale=1080:1920,setsar=1,ass=''C\\:/clips/' || p.clip_id || '.ass''[v]'
  WHEN 'TWO_PERSON' THEN '[0:v]split=2[a][b];[a]' || a.crop || ',scale=1080:960,setsar=1[top];[b]' || b.crop || ',scale=1080:960,setsar=1[bot];[top][bot]vstack=inputs=2,ass=''C\\:/clips/' || p.clip_id || '.ass''[v]' END AS graph
FROM planned p LEFT JOIN crops a ON a.clip_id = p.clip_id AND a.place = 0 LEFT JOIN crops b ON b.clip_id = p.clip_id AND b.place = 1""",
    ),
    "render_commands": _with(
        *_TO_CHOSEN,
        *_TO_TRACKS,
        _LAYOUT,
        select=f"""SELECT c.job_id, c.clip_idx, 'ffmpeg -y -hide_banner -loglevel error -ss ' || {_fixed("c.start_s", 3)} || ' -t ' || {_fixed("c.end_s - c.start_s", 3)} || ' -i source.mp4 '
  || CASE WHEN coalesce(p.layout, 'CENTER_CROP') = 'CENTER_CROP' THEN '-vf scale=w=1080:h=1920:force_original_aspect_ratio=increase,crop=1080:1920,setsar=1,ass=''clip_' || (c.clip_idx + 1) || '.ass'''
    ELSE '-/filter_complex clip_' || (c.clip_idx + 1) || '.filter -map [v] -map 0:a?' END
  || ' -r 30 -c:v libx264 -preset veryfast -crf 23 -pix_fmt yuv420p -c:a aac -b:a 128k -ac 2 -movflags +faststart clip_' || (c.clip_idx + 1) || '.mp4' AS command
FROM chosen c LEFT JOIN planned p ON p.clip_id = c.job_id""",
    ),
    "clip_records": _with(
        *_TO_CHOSEN,
        *_TO_TRACKS,
        _LAYOUT,
        select=f"""SELECT c.job_id, coalesce(p.layout, 'CENTER_CROP') AS layout, c.clip_idx + 1 AS index, c.start_s, c.end_s, {_rounded("c.end_s - c.start_s", 1)} AS duration, round(c.score, 6) AS score,
  '/output/' || c.job_id || '/clip_' || (c.clip_idx + 1) || '.mp4' AS url, 'clip_' || (c.clip_idx + 1) || '.mp4' AS filename FROM chosen c LEFT JOIN planned p ON p.clip_id = c.job_id""",
    ),
    "link_tracks": _with(_BINS, _LINKED, select="SELECT clip_id, track_id, 1 AS fragments, sample_idx, x, 20.0::DOUBLE AS y, 8.0::DOUBLE AS w, 10.0::DOUBLE AS h FROM linked"),
    "merge_fragments": _with(_BINS, _LINKED, _MERGED, select="SELECT clip_id, track_id, fragments, o.s AS sample_idx, o.x AS x, 20.0::DOUBLE AS y, 8.0::DOUBLE AS w, 10.0::DOUBLE AS h FROM merged"),
    "served_files": """
SELECT page_id, resolved LIKE '/srv/out/%' AS ok FROM (
  SELECT page_id, list_reduce(list_concat([''], list_filter(string_split('srv/out/./' || path || '//' || repeat('../', CAST(length(html) % 5 AS INTEGER)) || '/clip_1.mp4', '/'), lambda p: p NOT IN ('', '.'))),
    lambda a, p: CASE WHEN p = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || p END) AS resolved
  FROM (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1) AS path FROM pages)
)""",
    "debug_track_boxes": _with(
        *_TO_TRACKS,
        _TILES,
        f"""corners AS (
  SELECT b.clip_id, p.tile, b.track_id, {_pixel("b.x")} AS x1, {_pixel("b.y")} AS y1, {_pixel("b.x + b.w")} AS x2, {_pixel("b.y + b.h")} AS y2, '#' || b.track_id || ' ' || {_percent("s.coverage")} AS label
  FROM boxes b JOIN tiles p ON p.sample_idx = b.sample_idx JOIN stats s ON s.clip_id = b.clip_id AND s.track_id = b.track_id
)""",
        select="SELECT *, greatest(y1 - 4, 12) AS label_y FROM corners",
    ),
    "debug_region_boxes": _with(
        *_TO_TRACKS,
        _LAYOUT,
        *_REGIONS,
        _TILES,
        _key_at("x_crop_keys", "x_at"),
        _key_at("y_keys", "y_at"),
        select=f"""SELECT r.clip_id, x.tile, r.place, {_pixel("x.v")} AS x1, {_pixel("y.v")} AS y1, {_pixel("x.v + r.w")} AS x2, {_pixel("y.v + r.h")} AS y2
FROM regions r JOIN x_at x ON x.clip_id = r.key JOIN y_at y ON y.clip_id = r.key AND y.tile = x.tile""",
    ),
    "debug_captions": _with(
        *_TO_TRACKS,
        _LAYOUT,
        _TILES,
        select=f"""SELECT clip_id, tile, tile // 3 AS row, tile % 3 AS "column", sample_idx, 't=' || {_fixed("sample_idx / 2.0::DOUBLE", 1)} || 's' AS caption,
  layout || ' | ' || CASE WHEN t0 IS NULL THEN 'no frames or no faces detected'
  WHEN t2 IS NOT NULL THEN reason || ' (coverage ' || {_percent("c1")} || ' / ' || {_percent("c2")} || ', ratio ' || {_fixed("c2 / c1", 2)} || ', span ' || {_percent("s2")} || ', gap ' || {_fixed("g2", 0)}
    || 's, separation ' || {_percent("separation")} || ', samples ' || (SELECT n FROM size) || ')'
  WHEN layout = 'SINGLE_PERSON' THEN reason || ' (coverage ' || {_percent("c0")} || ', samples ' || (SELECT n FROM size)
    || coalesce(', second face coverage ' || {_percent("cn")} || ' span ' || {_percent("sn")} || ' separation ' || {_percent("separation_n")}, '') || ')'
  ELSE reason || ' (best coverage ' || {_percent("c0")} || ', samples ' || (SELECT n FROM size) || ')' END || ' | detector=stub | samples=' || (SELECT n FROM size) AS title FROM planned CROSS JOIN tiles""",
    ),
    "track_coverage": _with(*_TO_TRACKS, select="SELECT clip_id, track_id, samples, round(coverage, 6) AS coverage FROM stats"),
    "track_span": _with(*_TO_TRACKS, select="SELECT clip_id, track_id, round(span, 6) AS span FROM stats"),
    "track_longest_gap": _with(*_TO_TRACKS, select="SELECT clip_id, track_id, longest_gap FROM stats"),
    "track_median_box": _with(*_TO_TRACKS, select="SELECT clip_id, track_id, round(median_x, 6) AS median_x, round(median_y, 6) AS median_y, round(median_w, 6) AS median_w, round(median_h, 6) AS median_h, round(center_x, 6) AS center_x FROM stats"),
    "track_ranking": _with(*_TO_TRACKS, select="SELECT clip_id, track_id, rank FROM ranked"),
    "persistent_tracks": _with(*_TO_TRACKS, select="SELECT clip_id, track_id FROM ranked WHERE persistent"),
    "layout_classification": _with(
        *_TO_TRACKS,
        _LAYOUT,
        select="""SELECT clip_id, layout, reason, CASE WHEN layout = 'CENTER_CROP' THEN '' WHEN layout = 'TWO_PERSON' THEN CASE WHEN x1 <= x2 THEN t1 || ',' || t2 ELSE t2 || ',' || t1 END
  WHEN t2 IS NOT NULL THEN CAST(t1 AS VARCHAR) ELSE CAST(t0 AS VARCHAR) END AS tracks, round(separation, 6) AS separation FROM planned""",
    ),
    "series_gap_fill": _with(*_TO_SERIES, select="SELECT clip_id, sample_idx, round(v, 6) AS v FROM filled"),
    "series_moving_average": _with(*_TO_SERIES, _average("filled", "averaged", 3), select="SELECT clip_id, sample_idx, round(v, 6) AS v FROM averaged"),
    "series_deadzone": _with(*_TO_SERIES, _dead("filled", "dead", "5.0::DOUBLE"), select="SELECT clip_id, sample_idx, round(v, 6) AS v FROM dead"),
    "series_smooth": _with(
        *_TO_SERIES, _average("filled", "a1", 3), _dead("a1", "d1", "(0.06::DOUBLE * 20.0::DOUBLE)"), _average("d1", "a2", 2), select="SELECT clip_id, sample_idx, round(least(greatest(v - 10, 0.0::DOUBLE), 40.0::DOUBLE), 6) AS v FROM a2"
    ),
    "series_keyframes": _with(*_TO_SERIES, _KEYS, select="SELECT clip_id, sample_idx / 2.0::DOUBLE AS t, r AS v FROM sides WHERE sample_idx IN (0, (SELECT n - 1 FROM size)) OR NOT (abs(r - a) < 0.5 AND abs(r - b) < 0.5)"),
    "crop_geometry": """
SELECT event_id,
  CAST(CASE WHEN w9 > width THEN round_even(width / 2.0::DOUBLE, 0) * 2 ELSE w9 END AS INTEGER) AS single_w,
  CAST(CASE WHEN w9 > width THEN round_even(width * 16 / 9.0::DOUBLE / 2, 0) * 2 ELSE height END AS INTEGER) AS single_h,
  CAST(round_even((CASE WHEN h * 9 / 8 > width THEN width ELSE h * 9 / 8 END) / 2, 0) * 2 AS INTEGER) AS half_w,
  CAST(round_even((CASE WHEN h * 9 / 8 > width THEN width * 8 / 9.0::DOUBLE ELSE h END) / 2, 0) * 2 AS INTEGER) AS half_h,
  CAST(round_even(width / 2.0::DOUBLE, 0) * 2 AS INTEGER) AS even_w
FROM (
  SELECT *, round_even(height * 9 / 16.0::DOUBLE / 2, 0) * 2 AS w9, least(greatest(value * 3.2::DOUBLE, height * 0.45::DOUBLE), height::DOUBLE) AS h
  FROM (SELECT event_id, CAST(event_id % 1500 + 300 AS INTEGER) AS width, CAST(event_id % 900 + 200 AS INTEGER) AS height, value FROM events)
)""",
    "detection_filter": _with(_BINS, select="SELECT clip_id, count(*) AS n FROM event_bins WHERE value >= 22 GROUP BY clip_id"),
    "detections_best_first": _with(_BINS, select="SELECT clip_id, sample_idx, CAST(count(*) AS INTEGER) AS n, round(max(value), 6) AS best FROM event_bins GROUP BY clip_id, sample_idx"),
    "job_status_counts": _with(_JOBS, select="SELECT stage, count(*) AS n FROM jobs GROUP BY stage"),
    "job_health": _with(_JOBS, select="SELECT 'ok' AS status, count(*) FILTER (stage IN ('importing', 'transcribing', 'ranking', 'clipping')) AS running, count(*) FILTER (stage = 'queued') AS queued, count(*) AS known FROM jobs"),
    "job_public_view": _with(
        _JOBS,
        select="""SELECT id, stage, CASE stage WHEN 'queued' THEN 'Waiting for a free slot...' WHEN 'importing' THEN 'Importing video...' WHEN 'transcribing' THEN 'Transcribing...'
  WHEN 'ranking' THEN 'Finding best moments...' WHEN 'clipping' THEN 'Creating clips...' WHEN 'done' THEN 'Done.' ELSE 'Error.' END AS status FROM jobs""",
    ),
    "job_lookup": _with(_JOBS, select="SELECT id, stage FROM jobs WHERE id = '7'"),
    "job_states": _with(
        _STATES,
        select=f"""SELECT id, stage, CASE stage WHEN 'importing' THEN 'Importing video...' WHEN 'transcribing' THEN 'Transcribing...' WHEN 'ranking' THEN 'Finding best moments...' WHEN 'done' THEN 'Done.' ELSE 'Error.' END AS status,
  {_fixed("value", 1)} AS detail, CASE WHEN stage = 'error' THEN props END AS error FROM states""",
    ),
    "job_states_health": _with(_STATES, select="SELECT 'ok' AS status, count(*) FILTER (stage IN ('importing', 'transcribing', 'ranking')) AS running, CAST(0 AS BIGINT) AS queued, count(*) AS known FROM states"),
    "url_validation": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN true ELSE contains(url, 'youtube.com/') OR contains(url, 'youtu.be/') END AS ok FROM pages",
    "public_files": "SELECT page_id, page_id % 4 IN (2, 3) AS ok FROM pages",
    "source_pick": """
SELECT job_id, path FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY NOT ends_with(path, '.mp4'), path) AS r
  FROM (SELECT CAST(page_id % 20 AS VARCHAR) AS job_id, 'source.' || lpad(CAST(page_id AS VARCHAR), 9, '0') || CASE WHEN page_id % 5 = 3 THEN '.mp4' ELSE '.webm' END AS path FROM pages)
) WHERE r = 1""",
    "encoder_versions": """
SELECT page_id, CAST(major AS INTEGER) AS major, CASE WHEN major < 7 THEN '-filter_complex_script' ELSE '-/filter_complex' END AS option
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id % 10 WHEN 1 THEN page_id % 12 END AS major FROM pages)""",
    "page_clock": """
SELECT event_id, (CAST(floor(value * 10) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(floor(value * 10) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock,
  replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS props FROM events""",
}
