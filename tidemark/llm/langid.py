"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of 2 to 4 bytes of the lower-cased UTF-8 text that lie within a word and its borders. The model is
trained by stochastic gradient descent in numpy on a bounded sample; a temperature, and a threshold below which a
prediction is rejected, are fitted on a part of the sample that training does not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, groups_of, text_bytes

SIZES = (2, 3, 4)
BITS = 16
WIDTH = 16
#: Documents of a language that training takes at most, about; the same number at every input size.
SAMPLE = 800
#: Texts of the sample together, about; fewer documents are taken if they are long.
SAMPLE_BYTES = 24 << 20
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[[0x20, *range(0x09, 0x0E)]] = 0x20
_FOLD[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def subwords(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the buckets of all subwords, and where each row's begin in them."""
    fold = _FOLD[data]
    space = fold == 0x20
    inner = np.concatenate([[0], np.cumsum(space)])
    row_end = np.repeat(at[1:], np.diff(at))
    wide = fold.astype(np.uint32)
    out = []
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(len(at), np.int64)))
            continue
        key = np.full(n, size, np.uint32)
        for j in range(size):
            key = key * np.uint32(0x01000193) ^ wide[j : j + n]
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        # A border may be the first or the last byte; none lies between. Runs end in their own row.
        between = inner[size - 1 : size - 1 + n] - inner[1 : 1 + n]
        good = np.flatnonzero((between == 0) & (np.arange(n) + size <= row_end[:n]) & ~(space[:n] & space[1 : 1 + n]))
        out.append((key[good].astype(np.int64), np.searchsorted(good, at)))
    return out


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive numbers of first."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket, (languages, buckets): embedding times output weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        parts = subwords(data, at)
        count = sum(np.diff(first) for _, first in parts)
        logits = np.empty((len(at) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            logits[:, k] = sum(row_sums(self.table[k][keys], first) for keys, first in parts)
        logits = (logits / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 1) -> Model | None:
    """A model of (text, language) rows; None if there are none. The order of the rows does not matter."""
    if not texts:
        return None
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))
    languages = sorted(set(labels))
    index = {x: i for i, x in enumerate(languages)}
    random = np.random.default_rng(seed)
    order = [order[i] for i in random.permutation(len(order))]
    rows = []
    for i in order:
        raw = np.frombuffer((texts[i] or "").encode(), np.uint8)
        keys = np.concatenate([k for k, _ in subwords(raw, np.array([0, len(raw)]))])
        if len(keys):
            own, n = np.unique(keys, return_counts=True)
            rows.append((own, (n / n.sum()).astype(np.float32), index[labels[i]]))
    embed = random.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    weight = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    held = rows[: len(rows) // 5] if len(rows) >= 50 else []
    train = rows[len(held) :]
    steps, step = max(1, epochs * len(train)), 0
    scale = 40.0  # averages of many subwords are small: their gradients are scaled up
    for _ in range(epochs):
        for i in random.permutation(len(train)):
            own, share, label = train[i]
            now = rate * (1 - step / steps)
            step += 1
            hidden = share @ embed[own]
            z = hidden @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weight @ p
            weight -= now * np.outer(hidden, p)
            bias -= now * 0.1 * p
            embed[own] -= (now * scale * share)[:, None] * back
    logits = lambda some: np.array([share @ embed[own] @ weight + bias for own, share, _ in some])
    temperature, threshold = 1.0, 0.0
    if held:
        z, truth = logits(held), np.array([r[2] for r in held])
        best = np.inf
        for t in np.geomspace(0.05, 5, 60):
            x = z / t
            x -= x.max(1, keepdims=True)
            loss = np.mean(np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), truth])
            if loss < best - 1e-9:
                best, temperature = loss, float(t)
        x = np.exp((z - z.max(1, keepdims=True)) / temperature)
        top = (x / x.sum(1, keepdims=True)).max(1)
        right = z.argmax(1) == truth
        # The lowest threshold at which at most 1 in 200 of the accepted held-back rows is wrong.
        for t in np.linspace(0, 0.99, 100):
            if not (top >= t).any() or 1 - right[top >= t].mean() <= 0.005:
                threshold = float(t)
                break
    return Model(languages, np.ascontiguousarray((embed @ weight).T.astype(np.float32)), bias, temperature, threshold)


def sample(labelled: DataFrame, per_language: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """About per_language rows of each label of labelled (id, text, label), by a hash of the id; all where there are fewer."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.octet_length("text")).alias("bytes")).collect()
    if not sizes:
        return labelled.select("text", "label").limit(0)
    take = {r.label: min(per_language, r.n, max(20, int(most_bytes / len(sizes) / max(1.0, r.bytes)))) / r.n for r in sizes}
    share = F.create_map(*[F.lit(x) for k, v in take.items() for x in (k, float(v))])
    return labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(1 << 20) * F.try_element_at(share, F.col("label"))).select("text", "label")


def train(labelled: DataFrame, **options: int) -> Model | None:
    """A model of labelled (id, text, label) rows, fitted on a sample of bounded size that is gathered on the driver."""
    rows = [(r.text, r.label) for r in sample(labelled.where("label is not null and text is not null"), **options).toLocalIterator()]
    return fit([t for t, _ in rows], [x for _, x in rows])


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (the calibrated probability) and rejected (the score is below the model's threshold).

    A text that is null or has no letter, and every text if there was nothing to learn from, is `und` with score 0 and
    rejected. Of languages with the same probability the first by name counts. Whole texts count, however long. Rows are
    taken one by one, repeated rows too, and an empty table gives no rows. Result columns replace columns of docs of their
    names; other columns keep theirs, whatever they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def make():
        model = shared.value

        def compute(texts: pa.Array) -> list[pa.Array]:
            data, at = text_bytes(texts)
            names, scores, refused = [], [], []
            for lo, hi in groups_of(at, 1 << 19):
                part, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                letters = row_sums(_ASCII_LETTER[part], own) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = any(c.isalpha() for c in part[own[i] : own[i + 1]].tobytes().decode())
                if model is None:
                    letters[:] = False
                    p = np.zeros((hi - lo, 1))
                else:
                    p = model.probabilities(part, own)
                for i, best in enumerate(p.argmax(1)):
                    names.append(model.languages[best] if letters[i] else UNKNOWN)
                    scores.append(float(p[i, best]) if letters[i] else 0.0)
                    refused.append(not letters[i] or scores[-1] < model.threshold)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(refused, pa.bool_())]

        return compute

    return annotate(docs, [text], fields, make, keep)
