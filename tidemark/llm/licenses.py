"""License scans: runs of lines are held against license templates by the Dice coefficient of their word bigrams.

Two sets of bigrams whose Dice coefficient is at least t have sizes within a factor of (2 - t) / t, and at least
t / (2 - t) of the smaller possible set in common. So a template is only tried where enough of its bigrams stand, and
only on runs of lines of a fitting size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import alnum_words, annotate, bool_lut, find_keys, groups_of, text_bytes
from .license_texts import TEMPLATES
from .winnow import grams

THRESHOLD = 0.8


def bigrams(text: str) -> np.ndarray:
    """Hashes of the distinct word bigrams of a text. Words are letters and digits; case and punctuation do not count."""
    data = np.frombuffer(text.encode(), np.uint8)
    words, _, _, _ = alnum_words(data, np.array([0, len(data)]))
    return np.unique(grams(words, 2))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.names = [n for n, _ in templates]
        sets = [bigrams(t) for _, t in templates]
        if any(not len(s) for s in sets):
            raise ValueError("a template needs two words")
        self.sizes = np.array([len(s) for s in sets])
        self.threshold = threshold
        self.least = [ceil(threshold / (2 - threshold) * n - 1e-9) for n in self.sizes]
        self.most = [int((2 - threshold) / threshold * n + 1e-9) for n in self.sizes]
        self.sets = sets
        self.keys = np.unique(np.concatenate(sets))
        self.lut = bool_lut(self.keys)
        holders = defaultdict(list)
        for t, own in enumerate(sets):
            for k in np.searchsorted(self.keys, own):
                holders[int(k)].append(t)
        self.first = np.concatenate([[0], np.cumsum([len(holders[k]) for k in range(len(self.keys))])])
        self.holders = np.array([t for k in range(len(self.keys)) for t in holders[k]], np.int64)

    def scan(self, data: np.ndarray, at: np.ndarray) -> list[list[dict]]:
        """For each row its matches, best first; of runs that overlap for one template the best, earliest, shortest."""
        out: list[list[dict]] = [[] for _ in range(len(at) - 1)]
        words, starts, _, first = alnum_words(data, at)
        pairs = grams(words, 2)
        near, place = find_keys(self.keys, self.lut, pairs)
        row = np.searchsorted(first, near, side="right") - 1
        inside = near + 1 < first[row + 1]
        near, place, row = near[inside], place[inside], row[inside]
        if not len(near):
            return out
        count = self.first[place + 1] - self.first[place]
        spot = np.repeat(np.arange(len(near)), count)
        template = self.holders[np.arange(len(spot)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[place], count)]
        code = np.unique((row[spot] * len(self.names) + template) * len(self.keys) + place[spot]) // len(self.keys)
        code, shared = np.unique(code, return_counts=True)
        for c in code[shared >= np.array(self.least)[code % len(self.names)]]:
            r, t = divmod(int(c), len(self.names))
            mine = np.unique(near[spot[(row[spot] == r) & (template == t)]])
            out[r] += self.runs(data[at[r] : at[r + 1]], pairs, starts - at[r], int(first[r]), int(first[r + 1]), mine, t)
        for found in out:
            found.sort(key=lambda m: (-m["dice"], m["license"], m["first_line"]))
        return out

    def runs(self, raw: np.ndarray, pairs: np.ndarray, starts: np.ndarray, lo: int, hi: int, mine: np.ndarray, t: int) -> list[dict]:
        """Matches of template t among all runs of lines of a text whose words are lo to hi and whose bigrams at mine are the template's.

        A run's bigrams are those at the first place of each from its start on. Starts are taken from the last to the first: a
        place that comes in front takes the next place of its bigram out of a linked list, so the list always holds the first
        places in order. From each start it is followed over at most self.most[t] bigrams; lines that add none cost
        nothing. Only lines that add a bigram of the template end a run, as any other line makes it no better.
        """
        breaks = np.flatnonzero(raw == 10)
        line = np.searchsorted(breaks, starts[lo:hi])
        first_line, first_word = np.unique(line, return_index=True)
        word_of = dict(zip(first_line.tolist(), first_word.tolist()))
        near = mine - lo
        lines = np.unique(np.concatenate([line[near], line[near + 1]])).tolist()
        end = int(near[-1]) + 1  # no later bigram is the template's
        code = np.unique(pairs[lo : lo + end], return_inverse=True)[1].tolist()
        good = np.isin(pairs[lo : lo + end], self.sets[t]).tolist()
        ends_in = line[1 : end + 1].tolist()
        after, before, first = [end] * (end + 1), [-1] * (end + 1), [end] * (max(code) + 1)
        head, size, most, found = end, int(self.sizes[t]), self.most[t], []
        place = end
        for a in reversed(lines):
            for p in range(place - 1, word_of[a] - 1, -1):
                old = first[code[p]]
                if old < end:  # p comes before it
                    left, right = before[old], after[old]
                    if left < 0:
                        head = right
                    else:
                        after[left] = right
                    before[right] = left
                first[code[p]] = p
                after[p], before[p], before[head] = head, -1, p
                head = p
            place = min(place, word_of[a])
            p, seen, common, last, gained = head, 0, 0, -1, False
            while p < end:
                if ends_in[p] != last:
                    if gained and (dice := 2 * common / (seen + size)) >= self.threshold:
                        found.append((-dice, a, last))
                    last, gained = ends_in[p], False
                seen += 1
                if seen > most:
                    gained = False
                    break
                if good[p]:
                    common += 1
                    gained = True
                p = after[p]
            if gained and (dice := 2 * common / (seen + size)) >= self.threshold:
                found.append((-dice, a, last))
        firsts: list[int] = []  # of the runs that are taken, which do not overlap
        taken: dict[int, tuple[int, float]] = {}
        for dice, a, b in sorted(found):
            i = bisect_right(firsts, b)
            if i == 0 or taken[firsts[i - 1]][0] < a:
                firsts.insert(i, a)
                taken[a] = b, -dice
        return [{"license": self.names[t], "dice": taken[a][1], "first_line": a, "last_line": taken[a][0]} for a in firsts]


MATCH = T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("first_line", T.LongType()), T.StructField("last_line", T.LongType())])


def find_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """docs with license (of the best match, null if none), dice (its coefficient, 0 if none), n_matches and matches.

    Every run of whole lines of a text is a candidate (lines count from 0), however often its lines repeat, but no part of a
    line: a licence inside a longer line is missed where the line's other words take it below the threshold. Texts without two words (null, empty) match
    nothing. Ties go to the license that comes first by name, then the earlier run. Rows are taken one by one, repeated
    rows too; an empty table stays empty. The work grows with the length of a text. Result columns replace columns of
    docs of their names; other columns keep theirs, whatever they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast((templates, threshold))
    fields = [T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("n_matches", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))]
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int64()), ("last_line", pa.int64())]))

    def make():
        scanner = Scanner(*shared.value)

        def compute(texts: pa.Array) -> list[pa.Array]:
            data, at = text_bytes(texts)
            found = []
            for lo, hi in groups_of(at, 1 << 20):
                found += scanner.scan(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            return [
                pa.array([m[0]["license"] if m else None for m in found], pa.string()),
                pa.array([m[0]["dice"] if m else 0.0 for m in found], pa.float64()),
                pa.array([len(m) for m in found], pa.int64()),
                pa.array(found, kind),
            ]

        return compute

    return annotate(docs, [text], fields, make, keep)
