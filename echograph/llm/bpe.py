"""BPE over a tokenizers .json file: merging by segment trees (op 9) and by ragged arrays (op 7)."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Bytes, by estimate, of chunks between white space whose encoding a task remembers; beyond that it starts anew.
REMEMBERED = 24 << 20
#: Bytes of text whose ids and decoded form a task holds at once.
HELD = 1 << 20
_NONE = np.int64(1) << 62
# The pre-tokenizer's pattern, with white space as Unicode defines it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Python's split() also cuts at these, which are not white space to the pattern.
_ODD = regex.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


class Model:
    """A word-end BPE vocabulary: NFC, lower case, split by pattern, bytes as letters, merges by rank."""

    def __init__(self, source: str | bytes):
        """``source`` is the file's path, or what it holds."""
        path = source if isinstance(source, str) else "vocabulary"
        if isinstance(source, str):
            with open(source, "rb") as f:
                source = f.read()
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or spec.get("decoder") or model.get("byte_fallback"):
            raise ValueError(f"{path}: only BPE with word ends and without a decoder is supported")
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, k in [*vocab.items(), *self.special.items()]:
            self.tokens[k] = text
        letters = _byte_letters()
        self.plain = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + "</w>"] for x in letters], np.int64)
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        # A rule may be applied at all its places of a sequence at once if what it makes takes part in later rules only.
        first_use = np.full(len(self.tokens), len(merges), np.int64)
        np.minimum.at(first_use, left, np.arange(len(merges)))
        np.minimum.at(first_use, right, np.arange(len(merges)))
        self.at_once = first_use[self.made] > np.arange(len(merges))
        self.pattern, self.lines = regex.compile(_PATTERN), regex.compile(_PATTERN + "|\n")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # first guess of a pair's place among the keys: a table over hashed pairs
        self.bits = 18
        self.slots = [np.full(1 << self.bits, -1, np.int64) for _ in range(2)]
        spill = []
        for k in range(len(self.keys)):
            h = int(self._slot(self.keys[k : k + 1])[0])
            for s in self.slots:
                if s[h] < 0:
                    s[h] = k
                    break
            else:
                spill.append(k)
        self.spill = np.array(spill, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where no rule joins it."""
        keys = left << 20 | right
        h = self._slot(keys)
        out = np.full(len(keys), _NONE)
        for s in self.slots:
            at = s[h]
            hit = (at >= 0) & (self.keys[at] == keys)
            out[hit] = self.ranks[at[hit]]
        if len(self.spill) and len(keys):
            at = np.minimum(np.searchsorted(self.keys[self.spill], keys), len(self.spill) - 1)
            hit = self.keys[self.spill[at]] == keys
            out[hit] = self.ranks[self.spill[at[hit]]]
        return out

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(self.normal(text))

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter. White space is left to the pattern, which passes over it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """What stands between white space, and special tokens by themselves; no pre-token crosses these."""
        out = []
        for k, part in enumerate(self.specials.split(text) if self.specials and "<|" in text else [text]):
            if k % 2:
                out.append(part)
            else:
                out += regex.split(r"\p{White_Space}+", part) if _ODD.search(part) else part.split()
        return out

    def start(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' first symbols one after another, and each word's length."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        out = self.plain[data]
        ends = np.cumsum(sizes) - 1
        out[ends] = self.final[data[ends]]
        return out, sizes


def merge_ragged(model: Model, words: list[str]) -> np.ndarray:
    """How many symbols are left of each word.

    All words' symbols are one array; in each round every word applies its lowest-ranked pair (at
    all places, from the left, where that can't be told from one at a time; else leftmost), all words
    at once, and the array closes up. Words that have no pair left go.
    """
    counts = np.zeros(len(words), np.int64)
    symbols, sizes = model.start(words)
    owner = np.repeat(np.arange(len(words)), sizes)
    inner = owner[:-1] == owner[1:]
    ranks = np.full(len(symbols), _NONE)
    ranks[:-1][inner] = model.rank(symbols[:-1][inner], symbols[1:][inner])
    while len(symbols):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.minimum.reduceat(ranks, starts)
        sizes = np.diff(starts, append=len(symbols))
        done = least == _NONE
        if done.any():
            counts[owner[starts[done]]] = sizes[done]
            keep = np.repeat(~done, sizes)
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            least, sizes = least[~done], sizes[~done]
            if not len(symbols):
                break
            starts = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(ranks == np.repeat(least, sizes))
        # pairs that overlap (a run of one symbol): every second of a run, from the left; rules that can't be applied at once: the first of a word
        run = np.cumsum(np.diff(hit, prepend=-2) != 1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
        even = (np.arange(len(hit)) - first[run - 1]) % 2 == 0
        lead = np.diff(owner[hit], prepend=-1) != 0
        hit = hit[np.where(model.at_once[ranks[hit]], even, lead)]
        symbols[hit] = model.made[ranks[hit]]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[hit] = True
        symbols, owner, ranks, changed = symbols[keep], owner[keep], ranks[keep], changed[keep]
        at = np.flatnonzero(changed)
        at = np.unique(np.concatenate([at, at[at > 0] - 1]))
        inner = (at + 1 < len(symbols)) & (owner[np.minimum(at + 1, len(symbols) - 1)] == owner[at])
        ranks[at[~inner]] = _NONE
        at = at[inner]
        ranks[at] = model.rank(symbols[at], symbols[at + 1])
    return counts


def _counted(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For a Coder that counts: each word's one number is its count."""
    return merge_ragged(model, words), np.ones(len(words), np.int64)


def merge_trees(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that are left of the words one after another, and how many of each.

    Each word has a segment tree over the ranks of its adjacent pairs; the root holds the least
    rank with the leftmost place (rank, place as one number). A step applies that pair and renews the
    at most three leaves that it touches, and their ancestors. Words of like length step together
    as rows of one array; each word follows its own tree until its root holds no pair.
    """
    symbols, sizes = model.start(words)
    offsets = np.cumsum(sizes) - sizes
    left, parts = np.zeros(len(words), np.int64), []
    level = np.maximum(1, np.ceil(np.log2(np.maximum(sizes, 2)))).astype(np.int64)
    for depth in np.unique(level):
        group = np.flatnonzero(level == depth)
        width = 1 << int(depth)
        rows = max(1, (1 << 18) // width)
        for k in range(0, len(group), rows):
            part = group[k : k + rows]
            flat, left[part] = _step_trees(model, symbols, offsets[part], sizes[part], int(depth), width)
            parts.append((part, flat))
    starts = np.cumsum(left) - left
    out = np.zeros(int(left.sum()), np.int64)
    for part, flat in parts:
        out[ragged(starts[part], left[part])] = flat
    return out, left


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _step_trees(model: Model, symbols: np.ndarray, offsets: np.ndarray, size: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(width)
    syms = np.where(place < size[:, None], symbols[np.minimum(offsets[:, None] + place, len(symbols) - 1)], -1)
    after = np.where(place + 1 < size[:, None], place + 1, width)
    before = np.broadcast_to(place - 1, syms.shape).copy()
    tree = np.full((len(size), 2 * width), _NONE)
    r, c = np.nonzero(after < width)
    rank = model.rank(syms[r, c], syms[r, c + 1])
    tree[r, width + c] = np.where(rank < _NONE, rank << 30 | c, _NONE)
    for d in range(depth - 1, -1, -1):
        a = 1 << d
        tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
    flat = tree.reshape(-1)
    active = np.flatnonzero(tree[:, 1] < _NONE)

    def pair(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        n = after[r, c]
        inner = np.flatnonzero(n < width)
        value = np.full(len(r), _NONE)
        if len(inner):
            rank = model.rank(syms[r[inner], c[inner]], syms[r[inner], n[inner]])
            value[inner] = np.where(rank < _NONE, rank << 30 | c[inner], _NONE)
        return value

    while len(active):
        root = tree[active, 1]
        c = root & ((1 << 30) - 1)
        gone = after[active, c]
        syms[active, c] = model.made[root >> 30]
        far = after[active, gone]
        after[active, c] = far
        syms[active, gone] = -1
        some = far < width
        before[active[some], far[some]] = c[some]
        prev = before[active, c]
        some = prev >= 0
        r, p = active[some], prev[some]
        # the leaves of the pair before, the new pair and the one that is gone, then their ancestors level by level
        rows, at = np.concatenate([active, r]), np.concatenate([c, p])
        tree[rows, at + width] = pair(rows, at)
        tree[active, gone + width] = _NONE
        rows, at = np.concatenate([rows, active]) * (2 * width), np.concatenate([at, gone]) + width
        for _ in range(depth):
            at = at >> 1
            child = rows + 2 * at
            flat[rows + at] = np.minimum(flat[child], flat[child + 1])
        active = active[tree[active, 1] < _NONE]
    left = syms >= 0
    return syms[left], left.sum(1)


class Coder:
    """Encodes texts by their chunks; what a chunk comes to is remembered within a task, up to a bound.

    ``merge`` takes words to (symbols, sizes), and ``special`` has what stands for each special
    token. A batch's new words are merged together.
    """

    def __init__(self, model: Model, merge: Callable[[Model, list[str]], tuple[np.ndarray, np.ndarray]], special: list[int]):
        self.model, self.merge, self.special = model, merge, special
        self.clear()

    def clear(self) -> None:
        self.known = {s: k for k, s in enumerate(self.model.special)}
        self.flat = np.array(self.special, np.int64)
        self.sizes = np.ones(len(self.known), np.int64)
        self.held = 0

    def learn(self, new: list[str]) -> None:
        index = {"\n": 0}
        order = np.array([index.setdefault(w, len(index)) for w in self.model.lines.findall(self.model.normal("\n".join(new)) + "\n")], np.int64)
        del index["\n"]
        symbols, sizes = self.merge(self.model, list(index)) if index else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        sizes = np.concatenate([[0], sizes])
        starts = np.cumsum(sizes) - sizes
        each = sizes[order]
        ends = np.cumsum(each)[np.flatnonzero(order == 0)]
        self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
        self.flat = np.concatenate([self.flat, symbols[ragged(starts[order], each)]])
        self.sizes = np.concatenate([self.sizes, np.diff(ends, prepend=0)])
        self.held += sum(map(len, new)) + 8 * len(symbols) + 150 * len(new)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' symbols one after another, and how many of each text."""
        parts = [self.model.chunks(t) if t else [] for t in texts]
        new = set().union(*parts) - self.known.keys()
        if self.held > REMEMBERED:
            self.clear()
            new = set().union(*parts) - self.known.keys()
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64)
        each = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum([0, *map(len, parts)])]
        return self.flat[ragged((np.cumsum(self.sizes) - self.sizes)[at], each)], np.diff(ends)


def _model(spark: SparkSession, path: str) -> Callable[[], Model]:
    """Makes the vocabulary once a Python worker: from the file's bytes, broadcast (a fixed vocabulary, checked to be under 64 MB)."""
    import os

    if os.path.getsize(path) > 64 << 20:
        raise ValueError(f"{path}: larger than a vocabulary file")
    with open(path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def get() -> Model:
        global _made
        if _made is None or _made[0] != path:
            _made = (path, Model(held.value))
        return _made[1]

    return get


_made: tuple[str, Model] | None = None


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Tokens are counted as the library does without begin, end or added special tokens; the strings of
    special tokens inside a text count as those tokens. A null text counts as empty; repeated
    rows give a row each; other columns of any name are ignored; an empty table gives an empty result. A text of any length is
    counted whole, in one task, which holds that text and its distinct words at once.
    """
    get = _model(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        coder = Coder(model, _counted, [1] * len(model.special))
        for batch in slices(batches, "text", 2 << 20):
            counts, each = coder.encode(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(each)])]
            tokens = np.diff(ends)
            sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    found = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def encode(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, ids (array of int), as the library encodes without added special tokens.

    A null text counts as empty (no ids); repeated rows give a row each; an empty table gives an
    empty result.
    """
    get = _model(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        coder = Coder(model, merge_trees, [*model.special.values()])
        for batch in slices(batches, "text", 2 << 20):
            ids, each = coder.encode(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], [id_col, "ids"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, ids array<int>")


def _digests(names: pa.Array, ids: np.ndarray, each: np.ndarray) -> list[str]:
    """The SHA-256 of each text's names joined by a space."""
    ends = pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, names.take(pa.array(ids))), " ")
    _, offsets, data = joined.buffers()
    at, raw = np.frombuffer(offsets, np.int32)[: len(joined) + 1].tolist(), memoryview(data) if data else b""
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])]


def round_trip(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_tokens, ids_sha256, decoded_sha256, of what ``encode`` and ``decode`` give.

    Both in one step: ids and decoded texts stay in the task, about HELD bytes of text at a time (a longer
    text by itself), and only their digests (hex SHA-256 of the decimal ids joined by a space, and of the decoded
    text) leave it. A null text counts as empty; repeated rows give a row each; other columns are
    ignored; an empty table gives an empty result. A text of any length is coded whole, in one task, which holds the text, its ids and
    what they decode to.
    """
    get = _model(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        coder = Coder(model, merge_trees, [*model.special.values()])
        names, numbers = pa.array(model.tokens), pa.array(map(str, range(len(model.tokens))))
        for batch in slices(batches, "text", HELD):
            ids, each = coder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each), pa.array(_digests(numbers, ids, each), pa.string()), pa.array(_digests(names, ids, each), pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(spark: SparkSession, coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns and decoded: the tokens of ids_col joined by a space, special tokens kept. Null ids give null."""
    get = _model(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        names = pa.array(model.tokens)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = part.column(part.schema.get_field_index(ids_col))
                texts = pa.ListArray.from_arrays(ids.offsets, names.take(ids.values), mask=ids.is_null() if ids.null_count else None) if not ids.offset else pa.array([None if x is None else [model.tokens[y] for y in x] for x in ids.to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(texts, " ")], [*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(run, f"{fields}, decoded string")
