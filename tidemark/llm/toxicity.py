"""Toxicity by a linear-chain conditional random field over words.

Words of labelled documents are tagged toxic or clean. Where only documents are labelled, a word is tagged toxic in a
toxic document if it is one that stands in far more toxic than clean documents. A two-state chain with weights for each
word and its neighbours is fitted to the tags in numpy; forward-backward marginals give each word's probability of being
toxic, which aggregate to a document's score and the byte offsets of its toxic spans.

Chains of all documents of a batch are worked through as one: a document's first word starts anew whatever stands before
it, and the two-state recursions are solved in chunks side by side, so the length of a text costs no extra steps.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, annotate, bool_lut, find_keys, groups_of, small_batches, text_bytes, tidy

#: Labelled documents of each class that training takes at most, about; the same number at every input size.
SAMPLE = 1_500
SAMPLE_BYTES = 8 << 20
#: A word of a toxic document is tagged if it stands beside this many different pairs of neighbours in toxic documents,
#: and is so many times as frequent there as in clean ones.
SUPPORT, LIKELIER = 12, 8
CHUNK = 64


def solve(gain: np.ndarray, a: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], start: float) -> np.ndarray:
    """r[t] = gain[t] * (a0 + a1 r[t-1]) / (a2 + a3 r[t-1]) for every t, with r[-1] = start; a0 to a3 may vary with t.

    Each chunk's maps are multiplied out first, so that all chunks can then be run side by side.
    """
    n = len(gain)
    size = -(-n // CHUNK)
    pad = lambda x, fill: np.concatenate([np.broadcast_to(x, n), np.full(size * CHUNK - n, fill)]).reshape(size, CHUNK)
    g, a0, a1, a2, a3 = pad(gain, 1.0), pad(a[0], 0.0), pad(a[1], 1.0), pad(a[2], 1.0), pad(a[3], 0.0)
    top0, top1, low0, low1 = np.zeros(size), np.ones(size), np.ones(size), np.zeros(size)  # r = (top0 + top1 x) / (low0 + low1 x)
    for t in range(CHUNK):
        n0, n1 = g[:, t] * (a0[:, t] * low0 + a1[:, t] * top0), g[:, t] * (a0[:, t] * low1 + a1[:, t] * top1)
        d0, d1 = a2[:, t] * low0 + a3[:, t] * top0, a2[:, t] * low1 + a3[:, t] * top1
        scale = 1 / (n0 + n1 + d0 + d1)
        top0, top1, low0, low1 = n0 * scale, n1 * scale, d0 * scale, d1 * scale
    first = np.empty(size)
    x = start
    for i in range(size):
        first[i] = x
        x = (top0[i] + top1[i] * x) / (low0[i] + low1[i] * x)
    out = np.empty((size, CHUNK))
    r = first
    for t in range(CHUNK):
        r = g[:, t] * (a0[:, t] + a1[:, t] * r) / (a2[:, t] + a3[:, t] * r)
        out[:, t] = r
    return out.reshape(-1)[:n]


@dataclass
class Chain:
    """keys: hashes of the known words, sorted. weight[0..2]: of a word itself, of the one before, of the one after."""

    keys: np.ndarray
    weight: np.ndarray
    bias: float
    start: float
    move: np.ndarray  # 2 x 2, logarithms
    score: np.ndarray  # of the document: constant, largest log-odds, logarithm of the expected number of toxic words

    def __post_init__(self) -> None:
        self.lut = bool_lut(self.keys)

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Numbers of known words; the number of keys stands for all others."""
        out = np.full(len(words), len(self.keys), np.int64)
        near, place = find_keys(self.keys, self.lut, words)
        out[near] = place
        return out

    def log_gain(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-odds of toxic against clean from the words alone."""
        w = np.concatenate([self.weight, np.zeros((3, 1))], 1)
        out = self.bias + w[0][ids]
        before, after = w[1][ids[:-1]], w[2][ids[1:]]
        inside = np.ones(len(ids), bool)
        inside[first] = False
        out[1:] += np.where(inside[1:], before, 0)
        out[:-1] += np.where(inside[1:], after, 0)
        return out

    def odds(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word its odds of being toxic, and the forward and backward odds that make it. first: of each document."""
        n = len(ids)
        if not n:
            return np.zeros(0), np.zeros(0), np.zeros(0)
        gain = np.exp(np.clip(self.log_gain(ids, first), -30, 30))
        stay = np.exp(self.move)
        fresh = np.zeros(n, bool)
        fresh[first] = True
        begin = float(np.exp(self.start))
        ahead = solve(gain, (np.where(fresh, begin, stay[0, 1]), np.where(fresh, 0, stay[1, 1]), np.where(fresh, 1, stay[0, 0]), np.where(fresh, 0, stay[1, 0])), begin)
        # Backwards: b[t] = (m10 + m11 g[t+1] b[t+1]) / (m00 + m01 g[t+1] b[t+1]), and 1 at a document's last word.
        ends = np.ones(n, bool)
        ends[:-1] = fresh[1:]
        following = np.concatenate([gain[1:], [1.0]])
        back = solve(np.ones(n), tuple(np.where(ends, e, x)[::-1] for e, x in ((1.0, stay[1, 0]), (0.0, stay[1, 1] * following), (1.0, stay[0, 0]), (0.0, stay[0, 1] * following))), 1.0)[::-1]
        return ahead * back, ahead, back

    def evidence(self, odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each document a constant, the largest log-odds and the logarithm of the expected number of toxic words."""
        first_or_end = np.minimum(first, max(0, len(odds) - 1))
        sizes = np.diff(np.r_[first, len(odds)])
        out = np.zeros((len(first), 3))
        out[:, 0], out[:, 1], out[:, 2] = 1, -12, np.log(1e-5)
        if len(odds):
            full = sizes > 0
            start = first_or_end[full]
            log = np.clip(np.log(odds), -12, 5)
            out[full, 1] = np.maximum.reduceat(log, start)
            out[full, 2] = np.log(np.add.reduceat(odds / (1 + odds), start) + 1e-5)
        return out


def tagged(ids: np.ndarray, first: np.ndarray, toxic: np.ndarray, known: int, weights: np.ndarray) -> np.ndarray:
    """Tags of the words of labelled documents: those of a toxic document that are far likelier in toxic documents.

    Support is counted by different neighbours, not by documents: words of a passage that is copied have the same.
    """
    sizes = np.diff(np.r_[first, len(ids)])
    doc = np.repeat(np.arange(len(first)), sizes)
    begin, stop = first[sizes > 0], (first + sizes - 1)[sizes > 0]
    before, after = np.roll(ids, 1), np.roll(ids, -1)
    before[begin], after[stop] = known, known
    around = before * (known + 1) + after
    seen = ids < known
    bad, good, support = np.zeros(known), np.zeros(known), np.zeros(known)
    if seen.any():
        _, at = np.unique(np.stack([ids[seen], around[seen], toxic[doc[seen]].astype(np.int64)], 1), axis=0, return_index=True)
        own, share, label = ids[seen][at], weights[doc[seen]][at], toxic[doc[seen]][at]
        bad = np.bincount(own, weights=label * share, minlength=known)
        good = np.bincount(own, weights=(1 - label) * share, minlength=known)
        support = np.bincount(own, weights=label, minlength=known)
    per_bad = float((toxic * weights)[doc].sum()) + 1 if len(doc) else 1.0
    per_good = float(((1 - toxic) * weights)[doc].sum()) + 1 if len(doc) else 1.0
    ratio = np.log((bad + 0.5) / per_bad) - np.log((good + 0.5) / per_good)
    marked = np.append((ratio > np.log(LIKELIER)) & (support >= SUPPORT), False)
    return marked[ids] & (toxic[doc] == 1)


def fit(texts: list[str], toxic: list[int], weights: list[float] | None = None, spans: list[list[tuple[int, int]]] | None = None, rounds: int = 40) -> Chain | None:
    """A chain of labelled documents; None if there are none of either class.

    spans, if given, are the byte offsets of each text's toxic words; else words are tagged by their documents' labels.
    weights undo uneven sampling of the classes.
    """
    if not texts or len(set(toxic)) < 2:
        return None
    order = sorted(range(len(texts)), key=lambda i: (texts[i] or "", toxic[i]))
    texts, toxic = [texts[i] for i in order], np.array([toxic[i] for i in order], float)
    share = np.array([weights[i] for i in order]) if weights else np.ones(len(texts))
    data, at = text_bytes(pa.array(texts, pa.string()))
    parts = []
    for lo, hi in groups_of(at, 1 << 20):
        words, begins, ends, first = alnum_words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        parts.append((words, begins + at[lo], ends + at[lo], np.diff(first)))
    words, begins, ends, sizes = (np.concatenate(x) for x in zip(*parts))
    first = np.cumsum(sizes) - sizes
    keys, n = np.unique(words, return_counts=True)
    chain = Chain(keys[n >= 3], np.zeros((3, int((n >= 3).sum()))), -4.0, 0.0, np.zeros((2, 2)), np.array([-2.0, 1.0, 0.0]))
    ids = chain.ids(words)
    known = len(chain.keys)
    if spans is None:
        tag = tagged(ids, first, toxic, known, share)
    else:
        tag = np.zeros(len(ids), bool)
        for i, own in enumerate([spans[i] for i in order]):
            for a, b in own:
                tag[first[i] : first[i + 1] if i + 1 < len(first) else len(ids)] |= ((begins < at[i] + b) & (ends > at[i] + a))[first[i] : first[i + 1] if i + 1 < len(first) else len(ids)]
    starts = first[np.diff(np.r_[first, len(ids)]) > 0]
    fresh = np.zeros(len(ids), bool)
    fresh[starts] = True
    target = tag.astype(float)
    moves = np.zeros((2, 2))
    np.add.at(moves, (tag[:-1].astype(int)[~fresh[1:]], tag[1:].astype(int)[~fresh[1:]]), 1)
    slots = [known + 1] * 3
    memory = [np.full(s, 1e-6) for s in slots]
    flat = [1e-6, np.full((2, 2), 1e-6)]
    for _ in range(rounds):
        odds, ahead, back = chain.odds(ids, starts)
        p = odds / (1 + odds)
        error = target - p
        inside = ~fresh[1:]
        # Expected moves from the pair marginals.
        m = np.exp(chain.move)
        gain = np.exp(np.clip(chain.log_gain(ids, starts), -30, 30))[1:]
        x, y = ahead[:-1], gain * back[1:]
        joint = np.stack([np.full(len(x), m[0, 0]), m[0, 1] * y, m[1, 0] * x, m[1, 1] * x * y])
        joint = (joint / joint.sum(0))[:, inside].sum(1).reshape(2, 2)
        gradients = [
            np.bincount(ids, weights=error, minlength=known + 1),
            np.bincount(ids[:-1][inside], weights=error[1:][inside], minlength=known + 1),
            np.bincount(ids[1:][inside], weights=error[:-1][inside], minlength=known + 1),
        ]
        for k, grad in enumerate(gradients):
            grad[:known] -= 0.05 * chain.weight[k]
            memory[k] += grad**2
            chain.weight[k] += (1.5 * grad / np.sqrt(memory[k]))[:known]
        total = float(error.sum())
        flat[0] += total**2
        chain.bias += 0.3 * total / np.sqrt(flat[0])
        moved = moves - joint
        moved[0, 0] = 0  # one of the four is free
        flat[1] += moved**2
        chain.move += 0.2 * moved / np.sqrt(flat[1])
        np.clip(chain.move, -4, 4, out=chain.move)
    odds, _, _ = chain.odds(ids, starts)
    evidence = chain.evidence(odds, first)
    b = chain.score
    for _ in range(400):  # logistic regression by Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(evidence @ b, -30, 30)))
        grad = evidence.T @ (share * (toxic - q)) - 1e-3 * b
        hess = (evidence * (share * q * (1 - q))[:, None]).T @ evidence + 1e-3 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    chain.score = b
    return chain


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Chain | None:
    """A chain of documents (id, text) and labels (id, toxic), fitted on a sample of bounded size, in one task.

    Of several labels of a document the largest counts; null labels and ids are left out; a null text is empty. Ids and
    lengths are joined first to find the classes' sizes. The sample is drawn from the labels by a hash of the id, so its
    ids are few enough to broadcast and no text is shuffled.
    """
    marks = labels.where("toxic is not null and id is not null").groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    lengths = docs.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    sizes = {r.toxic: r for r in lengths.join(marks, "id").groupBy("toxic").agg(F.count("*").alias("n"), F.avg("bytes").alias("bytes")).collect()}
    share = {k: min(per_class, r.n, max(20, int(most_bytes / 2 / max(1.0, r.bytes)))) / r.n for k, r in sizes.items()}
    if len(share) < 2:
        return None
    limit = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    drawn = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(1 << 20) * limit)
    rows = docs.join(F.broadcast(drawn), "id").select("text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        toxic: list[int] = []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            toxic += batch.column(1).to_pylist()
        chain = fit(texts, toxic, [1 / share[x] for x in toxic])
        if chain is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])

    small_batches(docs.sparkSession)
    found = rows.repartition(1).mapInArrow(tidy(learn), "chain binary").collect()
    return pickle.loads(found[0].chain) if found else None


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def score(docs: DataFrame, chain: Chain | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score, predicted (1 if score is 0.5 or more) and toxic_spans, the UTF-8 byte offsets of toxic runs.

    A word is toxic if its marginal is 0.5 or more. Texts without words (null, empty) get the score of no evidence, and
    all texts score 0 if there was nothing to learn from. Whole texts count, one row at a time; repeated rows, ties and
    empty tables need no care. Result columns replace columns of docs of their names; other columns keep theirs, whatever
    they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_spans", SPANS)]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        chain = shared.value

        def compute(texts: pa.Array) -> list[pa.Array]:
            data, at = text_bytes(texts)
            scores, spans = np.zeros(len(at) - 1), [[] for _ in range(len(at) - 1)]
            for lo, hi in groups_of(at, 1 << 20) if chain is not None else ():
                words, begins, ends, first = alnum_words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                own = first[:-1]
                ids = chain.ids(words)
                odds, _, _ = chain.odds(ids, own[np.diff(first) > 0])
                scores[lo:hi] = 1 / (1 + np.exp(-np.clip(chain.evidence(odds, own) @ chain.score, -30, 30)))
                toxic = np.flatnonzero(odds >= 1)
                for w, row in zip(toxic, np.searchsorted(first, toxic, side="right") - 1):
                    base, runs = at[lo + row] - at[lo], spans[lo + row]
                    if runs and w and odds[w - 1] >= 1 and w > first[row]:
                        runs[-1]["end"] = int(ends[w] - base)
                    else:
                        runs.append({"start": int(begins[w] - base), "end": int(ends[w] - base)})
            return [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, kind)]

        return compute

    return annotate(docs, [text], fields, make, keep)


def drop_toxic(docs: DataFrame, chain: Chain | None, text: str = "text") -> DataFrame:
    """The documents that are not predicted to be toxic, with their own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("content"))
    return score(rows, chain, text="content", keep=["row"]).where("predicted = 0").select("row.*")
