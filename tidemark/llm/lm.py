"""Language-model scores: a unigram base, and a causal self-attention model over subword ids, in numpy.

A frequent word of the training texts (A-Z lower-cased) is a subword as it stands, another is known to the model by its
ending. Each word, and the end of a text, belongs to a class: the most frequent words to one of their own, others to that
of their ending. The model gives the next word's class by attention over the subwords before it, on top of a bias by the
last word's class; the word within its class is as likely as in the unigram base. So a text's score is its base score and
what the model knows of its classes beyond their shares. Classes come in groups: first the group is chosen, then the class
in it. Texts are scored in windows of STRIDE words that see STRIDE more before them; windows overlap so that each word is
scored once, in batches with a causal mask.

Counts of words, classes and pairs of classes are taken over all training texts. Weights are trained where the texts are,
once on every window of every training text: in each of ROUNDS rounds every task starts from the same weights and trains
on its share of the round's texts, and the weights are averaged over the tasks in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, cut, groups_of, keep_heap, small_batches, span_hashes, text_bytes

STRIDE = 16
WIDTH = 32
WHOLE = 1 << 12  # words that are subwords as they stand, at most
ENDINGS = 1 << 12  # rows of the input embedding for other words
START = WHOLE + ENDINGS  # the row that stands before a text
GROUPS = 16
CLASSES = GROUPS * GROUPS
SINGLE = 111  # most frequent words, each a class of its own
END_CLASS = SINGLE  # of the end of a text
LAST_CLASS = CLASSES - 1  # of endings that are too rare for a class of their own
ROUNDS = 3
STEP = 512  # blocks that a training step takes
BLOCKS = 64  # blocks that are scored at a time: few enough for a processor's cache
MOST = 60.0  # logits are cut at this, below what overflows
#: Words whose counts are broadcast: the most frequent, this many at most. The others are joined by a shuffle.
HEAD = 1 << 19
END_KEY = 0  # stands for the end of a text among the words' hashes
AVERAGED = 16  # averages of weights that reach the driver at most

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and byte after the last of each word, and for each row of at the number of its first word."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    keys = span_hashes(_LOWER[data], starts, ends).view(np.int64)
    return np.where(keys == END_KEY, 1, keys)


class Table:
    """Sorted 64-bit keys that are spread evenly, found by their top bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, len(keys).bit_length() + 1)
        self.half = 1 << (self.bits - 1)
        self.first = np.append(np.searchsorted(keys, np.arange(-self.half, self.half) << (64 - self.bits)), len(keys)).astype(np.int32)

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are among the keys, and where."""
        if not len(self.keys):
            return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
        bucket = (values >> (64 - self.bits)) + self.half
        place = self.first[bucket].astype(np.int64)
        stop = self.first[bucket + 1]
        left = np.flatnonzero(place < stop)
        hit = np.zeros(len(values), bool)
        while len(left):
            same = self.keys[place[left]] == values[left]
            hit[left[same]] = True
            left = left[~same]
            place[left] += 1
            left = left[place[left] < stop[left]]
        place[~hit] = 0
        return hit, place


def word_endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last two bytes of each word as a number; a word of one byte has zero before it."""
    low = _LOWER[data].astype(np.int64)
    return low[ends - 1] | np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)] << 8, 0)


@dataclass
class Vocabulary:
    whole: Table  # keys of words that are subwords
    rank: np.ndarray  # of each by frequency, which is its row of the embedding; below SINGLE also its class
    class_of: np.ndarray  # of each ending
    mass: np.ndarray  # logarithm of each class's share under the unigram base

    @classmethod
    def of(cls, words: pa.Table, endings: pa.Table, ends: int) -> Vocabulary:
        """Of frequent words (k, c, e), of endings (e, c, n: all words' occurrences and kinds), and the number of texts.

        Each class of endings also has the base's share of a word that training has not seen; so a class's words have
        probabilities that add up to 1.
        """
        keys, counts, own = (words[x].to_numpy() for x in ("k", "c", "e"))
        order = np.lexsort((keys, -counts))[:WHOLE]
        keys, counts, own = keys[order], counts[order].astype(float), own[order]
        place = np.argsort(keys)
        rank = place.astype(np.int32)  # of the sorted keys
        total, kinds = np.zeros(1 << 16), np.zeros(1 << 16)
        total[endings["e"].to_numpy()] = endings["c"].to_numpy()
        kinds[endings["e"].to_numpy()] = endings["n"].to_numpy()
        single = counts[:SINGLE]
        np.add.at(total, own[:SINGLE], -single)
        np.add.at(kinds, own[:SINGLE], -1)
        weight = total + 0.1 * kinds
        often = np.argsort(-weight, kind="stable")[: CLASSES - SINGLE - 2]
        class_of = np.full(1 << 16, LAST_CLASS, np.int32)
        class_of[often] = np.arange(SINGLE + 1, CLASSES - 1)
        mass = np.bincount(class_of, weights=weight, minlength=CLASSES) + 0.1
        mass[:SINGLE] = 0.1
        mass[: len(single)] = single + 0.1
        mass[END_CLASS] = ends + 0.1
        base = weight.sum() + (single + 0.1).sum() + (ends + 0.1 if ends else 0.0) + 0.1
        return cls(Table(keys[place]), rank, class_of, np.log(mass) - np.log(base))

    def split(self, data: np.ndarray, at: np.ndarray, found: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of all rows, and the end of each row, its embedding's row and its class; and where rows begin.

        found: the words (see words_of) and their keys, if they are known.
        """
        starts, ends, first, *keys = found or words_of(data, at)
        hit, place = self.whole.places(keys[0] if keys else word_keys(data, starts, ends))
        ending = word_endings(data, starts, ends)
        spread = (ending.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        n = len(at) - 1
        row_first = first + np.arange(n + 1)
        is_end = np.zeros(len(starts) + n, bool)
        is_end[row_first[1:] - 1] = True
        rows, classes = np.full(len(is_end), START, np.int32), np.full(len(is_end), END_CLASS, np.int32)
        rank = self.rank[place] if len(self.rank) else place
        rows[~is_end] = np.where(hit, rank, WHOLE + spread.astype(np.int32))
        classes[~is_end] = np.where(hit & (rank < SINGLE), rank, self.class_of[ending])
        return rows, classes, row_first


def windows(rows: np.ndarray, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of STRIDE slots; each row's are preceded by an empty block.

    Returns for each slot the embedding's row of the word before, that word's class (CLASSES at the start), and the
    number of the word that it predicts or -1.
    """
    sizes = np.diff(first)
    blocks = 1 + -(-sizes // STRIDE)
    begin = np.concatenate([[0], np.cumsum(blocks)]) * STRIDE
    slot = np.arange(len(rows)) + np.repeat(begin[:-1] + STRIDE - first[:-1], sizes)
    target = np.full(begin[-1], -1, np.int64)
    target[slot] = np.arange(len(rows))
    before = np.full(begin[-1], START, np.int32)
    last = np.full(begin[-1], CLASSES, np.int32)
    inner = np.ones(len(rows), bool)
    inner[first[:-1]] = False
    own = np.flatnonzero(inner)
    before[slot[own]] = rows[own - 1]
    last[slot[own]] = classes[own - 1]
    return before, last, target


NAMES = ("embed", "mix", "near", "up", "lift", "down", "group", "inner")


def fresh_weights(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    make = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
    return {
        "embed": make(0.5, START + 1, WIDTH), "mix": make(WIDTH**-0.5, WIDTH, 3 * WIDTH),  # queries, keys and values
        "near": np.zeros(2 * STRIDE, np.float32), "up": make(WIDTH**-0.5, WIDTH, 2 * WIDTH), "lift": np.zeros(2 * WIDTH, np.float32),
        "down": make(0.1, 2 * WIDTH, WIDTH), "group": np.zeros((WIDTH, GROUPS), np.float32), "inner": np.zeros((GROUPS, WIDTH, GROUPS), np.float32),
    }


_I, _J = np.arange(STRIDE)[:, None], np.arange(2 * STRIDE)[None, :]
_BACK = np.clip(_I + STRIDE - _J, 0, 2 * STRIDE - 1)  # how far back each key is
_AHEAD = _J > _I + STRIDE


def forward(w: dict[str, np.ndarray], bias: tuple[np.ndarray, np.ndarray], before: np.ndarray, last: np.ndarray, seen: np.ndarray, target: np.ndarray, label: np.ndarray, learn: bool = True) -> dict[str, np.ndarray]:
    """The logarithm of the probability of every slot's label that has a target, with what backward needs if
    learn says so.

    Slots come in whole blocks; seen are those that hold a word. A block with targets has its row's block before it, so
    targets of the first block are left out.
    bias: of groups, and of classes in their group, by the last class. label: classes by slot.
    """
    x = w["embed"].take(before, 0)
    filled, use = seen.reshape(-1, STRIDE), np.flatnonzero(target[STRIDE:] >= 0)
    qkv = x @ w["mix"]
    # Every block but the first, with the block before it: views of neighbours in memory, so that nothing is copied.
    row, item = qkv.strides
    pairs = np.lib.stride_tricks.as_strided(qkv, (len(filled) - 1, 2 * STRIDE, 3 * WIDTH), (STRIDE * row, row, item))
    keys, values = pairs[:, :, WIDTH : 2 * WIDTH], pairs[:, :, 2 * WIDTH :]
    q = pairs[:, STRIDE:, :WIDTH]
    hidden = np.float32(-1e9)
    s = q @ keys.transpose(0, 2, 1)
    s *= np.float32(WIDTH**-0.5)
    s += np.where(_AHEAD, hidden, w["near"][_BACK])
    if not filled.all():
        s += np.where(np.concatenate([filled[:-1], filled[1:]], 1), np.float32(0), hidden)[:, None, :]
    e = np.exp(np.minimum(s, MOST, out=s), out=s)
    share = e @ np.ones((2 * STRIDE, 1), np.float32)
    share[share == 0] = 1  # slots without a word
    e /= share
    z = (e @ values).reshape(-1, WIDTH)
    z += x[STRIDE:]
    if len(use) < len(z):
        z = z.take(use, 0)
    u = z @ w["up"]
    u += w["lift"]
    r = np.maximum(u, 0, out=u)
    h = r @ w["down"]
    h += z
    number, before_class, own = (a[STRIDE:][use] for a in (target, last, label))
    group = own // GROUPS
    top = bias[0][before_class] + h @ w["group"]
    order = np.argsort(group.astype(np.uint8), kind="stable")
    edge = np.searchsorted(group[order], np.arange(GROUPS + 1))
    hs = h.take(order, 0)
    inner = bias[1][before_class[order], group[order]]
    for g in range(GROUPS):
        inner[edge[g] : edge[g + 1]] += hs[edge[g] : edge[g + 1]] @ w["inner"][g]
    n = np.arange(len(own))
    shares, logs = [], np.zeros(len(own), np.float32)
    for logits, chosen, of in ((top, group, n), (inner, own[order] % GROUPS, order)):
        np.minimum(logits, MOST, out=logits)
        logs[of] += logits[n, chosen]
        np.exp(logits, out=logits)
        total = logits @ np.ones(GROUPS, np.float32)
        logs[of] -= np.log(np.maximum(total, 1e-37))
        if learn:
            logits /= total[:, None]
            shares.append(logits)
    if not learn:
        return {"log": logs, "number": number}
    return {"before": before, "x": x, "q": q, "keys": keys, "values": values, "a": e, "z": z, "r": r, "h": h, "hs": hs, "order": order, "edge": edge, "top": shares[0], "inner": shares[1], "label": own, "log": logs, "use": use, "number": number}


def backward(w: dict[str, np.ndarray], f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log-probability of the labels."""
    label, order, edge = f["label"], f["order"], f["edge"]
    n = np.arange(len(label))
    top, inner = f["top"], f["inner"]
    top[n, label // GROUPS] -= 1
    inner[n, label[order] % GROUPS] -= 1
    top /= len(label)
    inner /= len(label)
    out = {"group": f["h"].T @ top, "inner": np.empty_like(w["inner"])}
    dh = top @ w["group"].T
    back = np.empty_like(f["hs"])
    for g in range(GROUPS):
        part = slice(edge[g], edge[g + 1])
        out["inner"][g] = f["hs"][part].T @ inner[part]
        back[part] = inner[part] @ w["inner"][g].T
    dh[order] += back
    out["down"] = f["r"].T @ dh
    du = dh @ w["down"].T
    du *= f["r"] > 0
    out["up"], out["lift"] = f["z"].T @ du, du.sum(0)
    dh += du @ w["up"].T
    dz = dh
    if len(f["use"]) < len(f["x"]) - STRIDE:
        dz = np.zeros((len(f["x"]) - STRIDE, WIDTH), np.float32)
        dz[f["use"]] = dh
    da_out = dz.reshape(-1, STRIDE, WIDTH)
    a = f["a"]
    dvalues = a.transpose(0, 2, 1) @ da_out
    ds = da_out @ f["values"].transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", ds, a)[:, :, None]
    ds *= a
    out["near"] = np.bincount(_BACK.reshape(-1), weights=ds.sum(0).reshape(-1), minlength=2 * STRIDE).astype(np.float32)
    mixed = np.empty((len(f["x"]) // STRIDE, STRIDE, 3 * WIDTH), np.float32)
    mixed[0] = 0
    ds *= np.float32(WIDTH**-0.5)
    np.matmul(ds, f["keys"], out=mixed[1:, :, :WIDTH])
    dkeys = ds.transpose(0, 2, 1) @ f["q"]
    for at, part in ((WIDTH, dkeys), (2 * WIDTH, dvalues)):
        mixed[1:, :, at : at + WIDTH] = part[:, STRIDE:]
        mixed[:-1, :, at : at + WIDTH] += part[:, :STRIDE]
    mixed = mixed.reshape(-1, 3 * WIDTH)
    out["mix"] = f["x"].T @ mixed
    dx = mixed @ w["mix"].T
    dx[STRIDE:] += dz
    order = np.argsort(f["before"].astype(np.uint16), kind="stable")
    rows = f["before"][order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    out["embed"] = (rows[first], np.add.reduceat(dx.take(order, 0), first, axis=0))
    return out


class Trainer:
    """Adam steps over all windows of the texts that are handed in; rows of the embedding move only when they are met."""

    def __init__(self, vocabulary: Vocabulary, bias: tuple[np.ndarray, np.ndarray], weights: dict[str, np.ndarray], rate: float = 6e-3):
        self.v, self.bias, self.rate = vocabulary, bias, rate
        self.w = {k: x.copy() for k, x in weights.items()}
        self.m = {k: np.zeros_like(x) for k, x in self.w.items()}
        self.s = {k: np.zeros_like(x) for k, x in self.w.items()}
        self.t = self.seen = 0
        self.held: list[np.ndarray] = []

    def add(self, data: np.ndarray, at: np.ndarray) -> None:
        """Learn from the rows' blocks; what makes no whole step is held, from the block before it on."""
        rows, classes, first = self.v.split(data, at)
        before, last, target = windows(rows, classes, first)
        if not len(target):
            return
        goal = np.where(target >= 0, classes[np.maximum(target, 0)], -1)
        blocks = [x.reshape(-1, STRIDE) for x in (before, last, goal)]
        if self.held:
            blocks = [np.concatenate(x) for x in zip(self.held, blocks)]
        lo = 0
        while len(blocks[0]) - lo > STEP:
            self.step(*[x[lo : lo + STEP + 1] for x in blocks])
            lo += STEP
        self.held = [x[lo:].copy() for x in blocks]

    def finish(self) -> None:
        """Learn from the blocks that are held."""
        if self.held and len(self.held[0]) > 1:
            self.step(*self.held)
        self.held = []

    def step(self, before: np.ndarray, last: np.ndarray, goal: np.ndarray) -> None:
        seen = goal >= 0
        asked = np.where(seen, np.arange(goal.size).reshape(goal.shape), -1)
        asked[0] = -1  # the first block only gives context
        if not (asked >= 0).any():
            return
        f = forward(self.w, self.bias, before.reshape(-1), last.reshape(-1), seen.reshape(-1), asked.reshape(-1), goal.reshape(-1))
        self.t += 1
        self.seen += len(f["label"])
        rate = self.rate * min(1.0, self.t / 8) / (1 + self.t / 400) ** 0.5
        for k, g in backward(self.w, f).items():
            rows, g = g if k == "embed" else (slice(None), g)
            m, s = self.m[k][rows], self.s[k][rows]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            self.m[k][rows], self.s[k][rows] = m, s
            self.w[k][rows] -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-8)


def pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in NAMES]).astype(np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, x in fresh_weights().items():
        out[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def log_gains(v: Vocabulary, bias: tuple[np.ndarray, np.ndarray], w: dict[str, np.ndarray], data: np.ndarray, at: np.ndarray, found: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """For each row's text the log10 of its classes' probability under the model over that under the unigram base."""
    rows, classes, first = v.split(data, at, found)
    before, last, target = windows(rows, classes, first)
    label = classes[np.maximum(target, 0)] if len(classes) else target
    blocks = len(target) // STRIDE
    score = np.empty(len(rows))
    for lo in range(1, blocks, BLOCKS):  # the first block is empty
        part = slice((lo - 1) * STRIDE, min(blocks, lo + BLOCKS) * STRIDE)
        asked = target[part].copy()
        asked[:STRIDE] = -1
        if (asked >= 0).any():
            f = forward(w, bias, before[part], last[part], target[part] >= 0, asked, label[part], learn=False)
            score[f["number"]] = f["log"]
    score -= v.mass[classes]
    total = np.concatenate([[0.0], np.cumsum(score)])
    return (total[first[1:]] - total[first[:-1]]) / np.log(10)


def alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of keys, and where in it each different key begins."""
    order = np.argsort(keys)
    own = keys[order]
    return order, np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else order


def counted(texts: DataFrame) -> DataFrame:
    """k, c and e: each word's key (END_KEY for the ends of texts), how often it stands in all texts, and its ending."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            keys, counts, endings = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, edge = alike(keys)
            keys, n, endings = keys[order[edge]], np.add.reduceat(counts[order], edge), endings[order[edge]]
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(endings.astype(np.int32))], names=["k", "c", "e"])

        size = 0
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for lo, hi in groups_of(at, 1 << 20):
                part, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                starts, ends, _ = words_of(part, own)
                keys = word_keys(part, starts, ends)
                order, edge = alike(keys)
                first = order[edge]
                held.append((keys[first], np.diff(np.append(edge, len(keys))), word_endings(part, starts[first], ends[first])))
                held.append((np.array([END_KEY]), np.array([hi - lo]), np.array([0])))
                size += len(edge)
            if size > 1_500_000:
                yield merged()
                size = 0
        if held:
            yield merged()

    return texts.select("text").mapInArrow(run, "k long, c long, e int").groupBy("k").agg(F.sum("c").alias("c"), F.min("e").alias("e"))


def count_pairs(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each class follows each (or the start of a text), over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = shared.value, np.zeros((CLASSES + 1) * CLASSES, np.int64)
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for lo, hi in groups_of(at, 1 << 20):
                _, classes, first = v.split(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                last = np.concatenate([[CLASSES], classes[:-1]])
                last[first[:-1]] = CLASSES
                total += np.bincount(last * CLASSES + classes, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "c"])

    rows = texts.select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros((CLASSES + 1) * CLASSES)
    out[rows["k"].to_numpy()] = rows["c"].to_numpy()
    return out.reshape(CLASSES + 1, CLASSES)


def pair_bias(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of a group after each class, and of a class in its group, smoothed by the classes' shares."""
    share = (pairs.sum(0) + 0.1) / (pairs.sum() + 0.1 * CLASSES)
    p = ((pairs + 20 * share) / (pairs.sum(1, keepdims=True) + 20)).reshape(-1, GROUPS, GROUPS)
    group = p.sum(2)
    return np.log(group).astype(np.float32), np.log(p / group[:, :, None]).astype(np.float32)


def train_weights(texts: DataFrame, vocabulary: Vocabulary, bias: tuple[np.ndarray, np.ndarray], weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights that each task trains from the given ones, averaged by the words that it saw."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, bias, weights))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        trainer = Trainer(*shared.value)
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for lo, hi in groups_of(at, 1 << 20):
                trainer.add(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        trainer.finish()
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(trainer.seen)]), pa.array([pack(trainer.w).tobytes()], pa.binary())], names=["n", "w"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0.0
        for batch in batches:
            for weight, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                flat = np.frombuffer(raw, np.float32).astype(np.float64) * weight
                total, n = flat if total is None else total + flat, n + weight
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])

    some = texts.select("text").mapInArrow(learn, "n double, w binary")
    rows = some.repartition(AVERAGED).mapInArrow(average, "n double, w binary").collect()
    if not rows:
        return weights
    n = sum(r.n for r in rows)
    return unpack(sum(np.frombuffer(r.w, np.float32).astype(np.float64) * r.n for r in sorted(rows, key=lambda r: (r.n, bytes(r.w)))) / n)


@dataclass
class Model:
    vocabulary: Vocabulary
    bias: tuple[np.ndarray, np.ndarray]
    weights: dict[str, np.ndarray]


def fit(texts: DataFrame, words: DataFrame) -> Model:
    """A model of the training texts (key, text); words are their counted words (k, c, e)."""
    own = words.where(F.col("k") != END_KEY)
    ends = words.where(F.col("k") == END_KEY).agg(F.sum("c").alias("n")).first()["n"] or 0
    endings = own.groupBy("e").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()  # 2^16 rows at most
    vocabulary = Vocabulary.of(most_frequent(own, WHOLE), endings, ends)
    bias, weights = pair_bias(count_pairs(texts, vocabulary)), fresh_weights()
    for i in range(ROUNDS):
        weights = train_weights(texts.where(F.pmod("key", F.lit(ROUNDS)) == i), vocabulary, bias, weights)
    return Model(vocabulary, bias, weights)


def most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """Rows (k, c) above the lowest power of two as a count that at most so many reach."""
    sizes = {r.p: r.n for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}
    power, reach = 64, 0
    while power > 0 and reach + sizes.get(power - 1, 0) <= most:
        power -= 1
        reach += sizes.get(power, 0)
    return counts.where(F.col("c") >= F.lit(float(2**power))).toArrow()


def score(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score and score.

    training is a condition on docs: the rows to learn from. Words are what white space parts, A-Z lower-cased; each text
    ends with a token of its own. base_score is the text's log10 probability under add-0.1 unigrams of the training
    tokens, score under the attention model. A null text is empty. Rows that repeat are scored each, and learnt from
    each; ties between words as frequent are broken by their hashes. Very long texts are cut into windows like any other.
    Without training rows all base probabilities are 1, and the model knows no word. An empty table gives no rows. Other
    columns of docs, whatever their names, are read only by training.

    The counts of the HEAD most frequent words are broadcast; occurrences of the others are joined with their counts.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), training.alias("learn"))
    base = base.select("doc_id", "text", "learn", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), "text").alias("key"))
    words = cut(counted(base.where("learn")))
    size = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(size["n"] or 0), int(size["v"])
    model = fit(base.where("learn"), words)
    head = pa.concat_tables([most_frequent(words.where(F.col("k") != END_KEY), HEAD), words.where(F.col("k") == END_KEY).toArrow()]).select(["k", "c"])
    under = np.log10(n + 0.1 * (v + 1)) if n else np.log10(0.1)
    order = np.argsort(head["k"].to_numpy())
    keys, logs = head["k"].to_numpy()[order], np.log10(head["c"].to_numpy()[order] + 0.1) - under
    shared = spark.sparkContext.broadcast((Table(keys), logs))
    known_model = spark.sparkContext.broadcast(model)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _ = shared.value
        for batch in batches:
            own_keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, at = text_bytes(batch.column(1))
            for lo, hi in groups_of(at, 1 << 20):
                part, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                starts, ends, first = words_of(part, own)
                w = word_keys(part, starts, ends)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                left = np.flatnonzero(~keys.places(w)[0])
                order = left[np.lexsort((w[left], row[left]))]
                w, row = w[order], row[order]
                edge = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (row[1:] != row[:-1])]) if len(w) else np.zeros(0, np.int64)
                n = np.diff(np.r_[edge, len(w)])
                # A row of its own, which stands for no word, tells how often the document itself repeats.
                all_keys = np.concatenate([own_keys[lo + row[edge]], own_keys[lo:hi]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(all_keys), pa.array(np.concatenate([w[edge], own_keys[lo:hi]])), pa.array(np.concatenate([n, np.zeros(hi - lo, np.int64)])), pa.array(np.concatenate([np.zeros(len(edge), np.int64), np.ones(hi - lo, np.int64)]))],
                    names=["key", "w", "n", "copies"],
                )

    small_batches(spark)
    tail = base.select("key", "text").mapInArrow(rest, "key long, w long, n long, copies long")
    gained = tail.join(words.select(F.col("k").alias("w"), "c"), "w", "left").groupBy("key").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.1)) - F.lit(float(under)))).alias("s"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"),
        F.sum("copies").alias("copies"),
    )

    fields = [T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("head_known", T.LongType()), ("head_score", T.DoubleType()), ("gain", T.DoubleType()))]

    def make():
        keep_heap()
        (keys, logs), model = shared.value, known_model.value
        logs = np.append(logs, 0.0)

        def compute(texts: pa.Array) -> list[pa.Array]:
            data, at = text_bytes(texts)
            count, known, base_score, gains = [], [], [], []
            for lo, hi in groups_of(at, 1 << 19):
                part, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                starts, ends, first = words_of(part, own)
                own_keys = word_keys(part, starts, ends)
                hit, place = keys.places(own_keys)
                end_hit, end_place = keys.places(np.array([END_KEY]))
                end_log = logs[end_place[0]] if end_hit[0] else 0.0
                count.append(np.diff(first) + 1)
                total = np.concatenate([[0], np.cumsum(hit)])
                known.append(total[first[1:]] - total[first[:-1]] + end_hit[0])
                total = np.concatenate([[0.0], np.cumsum(np.where(hit, logs[place], 0.0))])
                base_score.append(total[first[1:]] - total[first[:-1]] + end_log)
                gains.append(log_gains(model.vocabulary, model.bias, model.weights, part, own, (starts, ends, first, own_keys)))
            join = lambda x, kind: pa.array(np.concatenate(x).astype(kind))
            return [join(count, np.int64), join(known, np.int64), join(base_score, np.float64), join(gains, np.float64)]

        return compute

    rows = annotate(base.select("doc_id", "key", "text"), ["text"], fields, make, ["doc_id", "key"])
    rows = rows.join(gained, "key", "left")
    times = F.coalesce("copies", F.lit(1))
    return rows.select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce(F.col("k") / times, F.lit(0)).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce(F.col("s") / times, F.lit(0.0))).alias("base_score"),
        (F.col("head_score") + F.coalesce(F.col("s") / times, F.lit(0.0)) + F.col("gain")).alias("score"),
    )
