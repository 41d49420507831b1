"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are held against those of its language, by
Jensen-Shannon distance. The language's are summed over all documents. Texts too short for a histogram pass that test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[ \t-\r]"
SYMBOLS = r"[#*$%&|<>]"
RUN = 8  # words in a window for repeats
#: Frequent words of English, French, German and Spanish; fixed values.
COMMON = (
    "the of and to in a is that it for was with as on "
    "de la le les et des un une du que est dans "
    "der die und den von zu das mit ist nicht ein auf "
    "el en los las por con del una para se como al"
).split()
#: What is taken out of the text, in this order, to count characters of each class.
CLASSES = {"lower": "[a-z]+", "space": r"[ \t-\r]+", "beyond": r"[^\x00-\x7F]+", "upper": "[A-Z]+", "symbol": SYMBOLS + "+", "point": r"[.,;:!?'\"()-]+", "digit": "[0-9]+"}
MIN_CHARS, MIN_WORDS = 300, 80
#: A language's own histogram must rest on so many words.
MIN_REFERENCE = 5_000
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.29
#: Languages whose references are broadcast; beyond that they are joined by a shuffle.
MAX_BROADCAST = 10_000
ALL = "\x00"


def base_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the histograms.

    A null text has no words. Each column that is used more than once is a step of its own, so that it is computed once.
    """
    keep = docs.columns if keep is None else keep
    kept = [F.col(f"`{c}`") for c in keep]
    t = docs.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    rest = F.col("__t")
    sizes = ["__chars"]
    t = t.withColumn("__chars", F.char_length("__t"))
    for name, pattern in CLASSES.items():
        t = t.withColumn(f"__r_{name}", F.regexp_replace(rest, pattern, ""))
        rest = F.col(f"__r_{name}")
        sizes.append(f"__r_{name}")
    length = lambda c: F.col(c) if c == "__chars" else F.char_length(c)
    counts = {name: length(before) - length(after) for name, before, after in zip(CLASSES, sizes, sizes[1:])}
    t = t.select(
        *kept,
        "__t",
        *[c.cast("long").alias(f"__n_{n}") for n, c in counts.items()],
        F.char_length(sizes[-1]).cast("long").alias("__n_other"),
        F.array_remove(F.split("__t", SPACE + "+"), "").alias("__words"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^ \t-\r]")).alias("__lines"),
    )
    t = t.withColumn("__n", F.size("__words"))
    t = t.withColumn("__w", F.when(F.col("__n") >= RUN, F.transform(F.sequence(F.lit(1), F.col("__n") - RUN + 1), lambda i: F.xxhash64(F.slice("__words", i, RUN)))))
    t = t.withColumn("__twice", F.size(F.array_distinct("__w")) < F.size("__w"))
    t = t.withColumn("__sorted", F.when(F.col("__twice"), F.sort_array(F.transform("__w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda k: F.try_element_at("__sorted", k)["h"]
    t = t.withColumn("__at", F.sort_array(F.transform(F.filter("__sorted", lambda x, k: F.coalesce(F.when(k > 0, same(k) == x["h"]), F.lit(False)) | F.coalesce(same(k + 2) == x["h"], F.lit(False))), lambda x: x["i"])))
    steps = F.zip_with(F.slice("__at", F.lit(1), F.size("__at") - 1), F.slice("__at", F.lit(2), F.size("__at") - 1), lambda a, b: F.least(b - a, F.lit(RUN)))
    t = t.withColumn("__repeat", F.when(F.size("__at") > 0, F.aggregate(steps, F.lit(0), lambda a, b: a + b) + RUN).otherwise(0))
    t = t.withColumn("__frequent", F.concat(F.lit(" "), F.array_join(F.filter("__words", lambda w: w.isin(COMMON)), "  "), F.lit(" ")))
    hits = [((F.octet_length("__frequent") - F.octet_length(F.replace("__frequent", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in COMMON]
    return t.select(
        *kept,
        F.col("__n").cast("long").alias("n_words"),
        (F.char_length("__t") - F.col("__n_space")).cast("long").alias("word_chars"),
        F.col("__n_symbol").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.col("__repeat").cast("long").alias("n_repeat_words"),
        F.array(*[F.col(f"__n_{n}") for n in [*CLASSES, "other"]]).alias("class_counts"),
        F.array(*hits).alias("word_counts"),
    )


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def js_distance(p: Column, q: Column) -> Column:
    """The square root of the Jensen-Shannon divergence (in bits) of two histograms of shares."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda x, y: x + y) / 2, F.lit(0.0)))


def references(counts: DataFrame, lang: str) -> DataFrame:
    """Summed histograms (as shares) of each language, and of all documents under ALL."""
    key = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(ALL))
    classes, words = len(CLASSES) + 1, len(COMMON)
    sums = [F.sum(F.col("class_counts")[i]).alias(f"c{i}") for i in range(classes)] + [F.sum(F.col("word_counts")[i]).alias(f"w{i}") for i in range(words)]
    by = counts.groupBy(key.alias("__key")).agg(*sums, F.sum("n_words").alias("n"))
    total = by.agg(*[F.sum(c).alias(c) for c in by.columns[1:]]).select(F.lit(ALL).alias("__key"), *by.columns[1:])
    by = by.where(F.col("__key") != ALL).union(total)
    all_classes = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(classes)])
    return by.where(F.col("n") >= MIN_REFERENCE).select(
        "__key",
        shares(F.array(*[F.col(f"c{i}") for i in range(classes)]), all_classes).alias("__q_class"),
        shares(F.array(*[F.col(f"w{i}") for i in range(words)], F.col("n") - reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(words)])), F.col("n")).alias("__q_word"),
    )


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs with the base counts, base_failed, class_distance, word_distance and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. Otherwise kept says that both distances to
    the reference of the row's language are within bounds; a distance is null, and passes, where the text or the
    reference is too short. A null lang, and one whose reference is too short, is held against all documents. Null
    texts fail. Rows are judged one by one, repeated rows and ties too, but count in the references; whole texts count,
    however long; an empty table gives no rows. Result columns replace columns of docs of their names, other columns keep
    theirs, whatever they are.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_counts", "word_counts", "base_failed", "class_distance", "word_distance", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    plain = docs.select(row.alias("__row"), F.col(f"`{lang}`").alias("__lang"), F.col(f"`{text}`").alias("__text"))
    counts = cut(base_counts(plain, "__text", ["__row", "__lang"]))
    known = references(counts, "__lang")
    named = known.select(F.col("__key").alias("__has"))
    few = counts.select("__lang").distinct().limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    near = F.broadcast if few else lambda x: x
    key = F.coalesce(F.col("__lang").cast("string"), F.lit(ALL))
    rows = counts.join(near(named), key == F.col("__has"), "left").withColumn("__use", F.coalesce("__has", F.lit(ALL)))
    rows = rows.join(near(known), F.col("__use") == F.col("__key"), "left")
    chars = F.aggregate("class_counts", F.lit(0).cast("long"), lambda a, b: a + b)
    counted = F.aggregate("word_counts", F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.withColumn("__all", chars).withColumn("__rest", F.col("n_words") - counted)
    rows = rows.withColumn("class_distance", F.when(F.col("__all") >= MIN_CHARS, js_distance(shares(F.col("class_counts"), F.col("__all")), F.col("__q_class"))))
    rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, js_distance(shares(F.concat("word_counts", F.array("__rest")), F.col("n_words")), F.col("__q_word"))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near_enough = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return rows.select(*[F.col(f"__row.`{c}`") for c in keep], *new[:7], failed.alias("base_failed"), "class_distance", "word_distance", (~failed & near_enough).alias("kept"))


def _class_sql(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"length(t) - length(regexp_replace(t, '{quoted}', '', 'g'))"


_SPACE_SQL = "[ \\x09-\\x0D]"
_CLASS_SQL = {n: _class_sql(_SPACE_SQL + "+" if n == "space" else r"[^\x00-\x7F]+" if n == "beyond" else p) for n, p in CLASSES.items()}
_COMMON_SQL = ", ".join(f"'{w}'" for w in COMMON)
#: The same in SQL, with distances rounded to six decimals. A document's histograms are rows (kind, bin, k) here.
ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT r, doc_id, lang, t, list_filter(string_split_regex(t, '{_SPACE_SQL}+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \\x09-\\x0D]')) AS lines,
    [{", ".join(_CLASS_SQL.values())}] AS classes
  FROM texts
), counted AS (
  SELECT *, len(words) AS n_words, list_append(classes, length(t) - list_sum(classes)) AS all_classes FROM parts
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w) AS times
  FROM (SELECT r, i, array_to_string(list_slice(words, i, i + {RUN - 1}), ' ') AS w FROM (SELECT r, words, unnest(range(1, n_words - {RUN} + 2)) AS i FROM counted))
), repeats AS (
  SELECT r, sum(coalesce(least(after - i, {RUN}), {RUN})) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM windows WHERE times > 1) GROUP BY r
), base AS (
  SELECT c.r, c.doc_id, c.lang, CAST(c.n_words AS BIGINT) AS n_words, CAST(length(c.t) - ({_CLASS_SQL["space"]}) AS BIGINT) AS word_chars, CAST({_CLASS_SQL["symbol"]} AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars
  FROM counted c LEFT JOIN repeats p ON p.r = c.r
), word_bins AS (
  SELECT r, word, count(*) AS k FROM (SELECT r, unnest(words) AS word FROM counted) WHERE word IN ({_COMMON_SQL}) GROUP BY r, word
), bins AS (
  SELECT r, 'class' AS kind, CAST(i AS VARCHAR) AS bin, CAST(all_classes[i] AS BIGINT) AS k FROM (SELECT r, all_classes, unnest(range(1, {len(CLASSES) + 2})) AS i FROM counted)
  UNION ALL SELECT c.r, 'word', v.word, coalesce(b.k, 0) FROM counted c CROSS JOIN (SELECT unnest([{_COMMON_SQL}]) AS word) v LEFT JOIN word_bins b ON b.r = c.r AND b.word = v.word
  UNION ALL SELECT c.r, 'word', ' rest', c.n_words - coalesce(b.k, 0) FROM counted c LEFT JOIN (SELECT r, sum(k) AS k FROM word_bins GROUP BY r) b ON b.r = c.r
), sums AS (
  SELECT b.lang AS name, x.kind, x.bin, sum(x.k) AS k FROM bins x JOIN base b ON b.r = x.r WHERE b.lang IS NOT NULL GROUP BY b.lang, x.kind, x.bin
  UNION ALL SELECT chr(0), kind, bin, sum(k) FROM bins GROUP BY kind, bin
), known AS (
  SELECT coalesce(lang, chr(0)) AS name FROM (SELECT lang, n_words FROM base UNION ALL SELECT NULL, n_words FROM base WHERE lang IS NOT NULL) GROUP BY lang HAVING sum(n_words) >= {MIN_REFERENCE}
), shares AS (
  SELECT name, kind, bin, k / sum(k) OVER (PARTITION BY name, kind) AS q FROM sums SEMI JOIN known USING (name)
), used AS (
  SELECT b.*, coalesce(k.name, chr(0)) AS use FROM base b LEFT JOIN known k ON k.name = b.lang
), terms AS (
  SELECT u.r, x.kind, x.k / CASE x.kind WHEN 'class' THEN u.chars ELSE u.n_words END::DOUBLE AS p, s.q
  FROM used u JOIN bins x ON x.r = u.r JOIN shares s ON s.name = u.use AND s.kind = x.kind AND s.bin = x.bin
  WHERE CASE x.kind WHEN 'class' THEN u.chars >= {MIN_CHARS} ELSE u.n_words >= {MIN_WORDS} END
), distances AS (
  SELECT r, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d FROM terms GROUP BY r, kind
), judged AS (
  SELECT u.*, c.d AS c, w.d AS w, u.n_words < 20 OR 100 * u.n_repeat_words > 30 * u.n_words AS failed
  FROM used u LEFT JOIN distances c ON c.r = u.r AND c.kind = 'class' LEFT JOIN distances w ON w.r = u.r AND w.kind = 'word'
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND coalesce(c, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(w, 0) <= {MAX_WORD_DISTANCE} AS kept, round(c, 6) AS class_distance, round(w, 6) AS word_distance FROM judged
"""
