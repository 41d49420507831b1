"""Byte-pair encoding by a dynamic program over prefixes.

For every prefix of a word there is exactly one token that ends its encoding. An automaton gives the tokens that are
suffixes of the prefix, longest first; the one that stands compatibly after the last token of what is left of it is the
answer. Two tokens stand compatibly side by side if undoing their merges, latest first, never meets a pair that would
have been merged across their border earlier. Following the back-pointers gives the ids that merging by rank gives,
without a queue of merges.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import annotate

END = "</w>"
#: Added to the code point of a word's last symbol, so that it is a symbol of its own.
LAST = 0x10000
#: A worker forgets its words' encodings when they take about this many bytes, and pair tests beyond this many.
WORDS_BYTES, PAIRS_KEPT = 96 << 20, 400_000
#: What a word takes beside its characters: entries of two dictionaries and three strings.
ENTRY_BYTES = 420
#: Words that take more are not kept beyond their text.
LONG_WORD = 1 << 14


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Texts with characters beyond these take the library's own normaliser and splitter; texts of these are in NFC.
BEYOND = re.compile("[^\\0-\\u017f]")


def latin(category: str) -> str:
    """The Latin characters of a general category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == category and chr(c) not in "\u2028\u2029")


class WordBpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library with word-end symbols."""

    def __init__(self, definition: str):
        made = json.loads(definition)
        model = made["model"]
        if model.get("end_of_word_suffix") != END:
            raise ValueError("a vocabulary with word-end symbols is needed")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.text_of = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        joined = {}
        halves: dict[int, tuple[int, int]] = {}
        order: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            whole = self.ids[a + b]
            if whole not in halves:
                halves[whole] = (self.ids[a], self.ids[b])
                order[whole] = rank
                joined[self.ids[a], self.ids[b]] = whole
        self.halves, self.order, self.joined = halves, order, joined
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if i in halves or len(token.removesuffix(END)) == 1:
                symbols = self.symbols(token)
                self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.table = byte_symbols()
        self.bytes_of = {c: b for b, c in self.table.items()}
        self.whole = Tokenizer.from_str(definition)
        pattern = next(p["pattern"]["Regex"] for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        for name in ("L", "N"):
            pattern = pattern.replace(f"[\\p{{{name}}}]", f"[{latin(name)}]").replace(f"\\p{{{name}}}", latin(name))
        self.words = re.compile(pattern.replace("\\s", latin("Z") + "\\t\\n\\x0b\\f\\r\\x85"))
        self.specials = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.ids_cache = Cache(self)
        self.text_cache: dict[str, str] = {}

    @staticmethod
    def symbols(token: str) -> str:
        if token.endswith(END) and len(token) > len(END):
            token = token.removesuffix(END)
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between these two tokens."""
        key = (left, right)
        known = self.known_pairs.get(key)
        if known is None:
            known = self.known_pairs[key] = self._keeps_border(left, right)
        return known

    def _keeps_border(self, left: int, right: int) -> bool:
        order, halves = self.order, self.halves
        bound = len(order) + 1  # a merge across the border comes first if its rank is below this
        while True:
            across = self.joined.get((left, right))
            if across is not None and order[across] < bound:
                return False
            made_left, made_right = order.get(left, -1), order.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                # At one rank merges run from the left, so a later merge across the border would need a lower rank.
                bound, left = made_left, halves[left][1]
            else:
                # Of equal pairs the leftmost merges first: one across the border precedes the right token's own.
                bound, right = made_right + 1, halves[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        table = self.table
        symbols = "".join([table[b] for b in word.encode()])
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + LAST)
        last: list[int] = [-1] * len(symbols)
        back: list[int] = [0] * len(symbols)
        pairs = self.known_pairs
        for end, (token, size) in self.automaton.iter(symbols):
            if last[end] >= 0:
                continue
            start = end - size
            if start >= 0:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[end], back[end] = token, start
        out, at = [], len(symbols) - 1
        while at >= 0:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def pre_tokens(self, text: str) -> list[str]:
        if BEYOND.search(text):  # Unicode tables differ between versions: the library's own rules hold
            parts = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))
            return [bytes([self.bytes_of[c] for c in p]).decode() for p, _ in parts]
        return self.words.findall(text.lower())

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text; the latter as they stand."""
        if self.specials is None or "<|" not in text:
            return self.pre_tokens(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self.pre_tokens(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.pre_tokens(text[at:])

    def entry(self, piece: str) -> tuple[str, str]:
        """A piece's ids and its tokens, each joined by spaces."""
        ids = [self.added[piece]] if piece in self.added else self.encode_word(piece)
        return " ".join(map(str, ids)), " ".join([self.text_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in self.entry(p)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the library joins the tokens by spaces."""
        return " ".join([self.text_of[i] for i in ids])

    def encoded(self, text: str) -> tuple[str, str]:
        """A text's ids and its decoded text. Every id stands for one token, so both are put together by piece."""
        if self.ids_cache.bytes > WORDS_BYTES:
            self.ids_cache.clear()
            self.text_cache.clear()
            self.ids_cache.bytes = 0
        if len(self.known_pairs) > PAIRS_KEPT:
            self.known_pairs.clear()
        pieces = self.pieces(text)
        return " ".join(map(self.ids_cache.__getitem__, pieces)), " ".join(map(self.text_cache.__getitem__, pieces))


class Cache(dict):
    """Pieces' ids; a new piece is encoded, and its tokens are kept beside."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.bytes = 0

    def __missing__(self, piece: str) -> str:
        entry = self.bpe.entry(piece)
        size = len(piece) + len(entry[0]) + len(entry[1])
        if size < LONG_WORD:
            self[piece], self.bpe.text_cache[piece] = entry
            self.bytes += size + ENTRY_BYTES
        else:
            self.bpe.text_cache[piece] = entry[1]
            self.bytes += WORDS_BYTES  # kept until the next text
        return entry[0]


_LOADED: dict[str, WordBpe] = {}


def loaded(definition: str) -> WordBpe:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(definition)
    return _LOADED[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep: list[str] | None = None, with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256, token_ids if with_ids, and decoded if with_text, of every whole text.

    A null or empty text has no tokens. Rows are taken one by one, so repeated rows, ties and an empty table need no
    care. A column of docs with the name of a result gives way to it. The vocabulary file is read on the driver and
    broadcast (under 2 MB).
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)))
    if with_text:
        fields.append(T.StructField("decoded", T.StringType()))

    def make():
        bpe = loaded(shared.value)

        def compute(texts: pa.Array) -> list[pa.Array]:
            n, h, d, all_ids, all_texts = [], [], [], [], []
            for value in texts:
                ids, back = bpe.encoded(value.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                h.append(hashlib.sha256(ids.encode()).hexdigest())
                d.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.fromstring(ids, np.int32, sep=" "))
                if with_text:
                    all_texts.append(back)
            out = [pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())]
            if with_ids:
                edges = pa.array(np.cumsum([0, *map(len, all_ids)]), pa.int32())
                values = pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32), pa.int32())
                out.append(pa.ListArray.from_arrays(edges, values, pa.list_(pa.field("element", pa.int32(), False))))
            return [*out, pa.array(all_texts, pa.string())] if with_text else out

        return compute

    return annotate(docs, [text], fields, make, keep)
