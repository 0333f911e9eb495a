"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

A training word's id is its rank by frequency, roughly, so that common words have short ids; sorted
arrays of the words' 64-bit hashes tell the ids. Map tasks send blocks of distinct n-grams with
counts, one block for each shard, so that counting costs Spark a few rows a task. A shard is a task's
worth of tokens: n-grams are dealt to shards by the hash of their context, and those of a context
whose words are all so frequent that it might exceed a shard are spread over several. Tasks merge
a shard and write to the shared folder, in one file, a sorted array of its contexts' hashes, for each
context what smoothing needs of its counts, and the sorted ids of the words that follow, each in one
number with its count. A shard holds a range of hashes, so that one sort of a chunk's contexts deals
them to shards and puts them in a shard's order.
They send on what the next lower order counts: how many different words stand before an n-gram.
Workers that score map the arrays into memory; the driver holds sizes and frequent words only.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, new_path, stage, without
from weftgraph.llm.wordhash import BLOCK_BYTES, GOLDEN, U64, first_bytes, mix, word_hashes

#: Words of an n-gram unless another order is asked for.
ORDER = 3
#: Tokens of a shard, words of a shard of the vocabulary, ids of a block of per-word counts.
SHARD_TOKENS, SHARD_WORDS, BLOCK_IDS = 1_500_000, 1_000_000, 1_000_000
#: Tokens that are looked up and sent together, and distinct words that a task holds.
CHUNK, HELD_WORDS = 1_000_000, 1_000_000
#: Shards whose sums one task adds up, arrays that a worker keeps mapped, and keeps in memory of a store that can't be mapped.
FAN_IN, MAPPED, FETCHED = 16, 8, 8
#: Bits of a context's total, of its n-grams with the count 1 and with 2, and a total that does not fit into them.
TOTAL_BITS = 10
FULL = (1 << TOTAL_BITS) - 1
#: Stands for the end of a text among the hashes of words.
END = 0x656E64206F66


class Store:
    """Arrays as files in the shared folder, mapped into memory where that is a file system; of any other store read whole."""

    def __init__(self, uri: str):
        self.uri = uri
        self.local = uri.split(":", 1)[1].replace("//", "", 1) if uri.startswith("file:") else uri if uri.startswith("/") else None

    def write(self, name: str, data: np.ndarray) -> None:
        if self.local is None:
            from pyarrow import fs

            files, path = fs.FileSystem.from_uri(self.uri)
            files.create_dir(path)
            with files.open_output_stream(f"{path}/{name}") as out:
                out.write(memoryview(np.ascontiguousarray(data)).cast("B"))
            return
        os.makedirs(self.local, exist_ok=True)
        part = f"{self.local}/.{name}.{uuid.uuid4().hex}"
        np.ascontiguousarray(data).tofile(part)
        os.replace(part, f"{self.local}/{name}")  # whole or not at all, whichever attempt of a task comes last

    def open(self, name: str) -> np.ndarray:
        """The bytes of an array."""
        if self.local is None:
            from pyarrow import fs

            files, root = fs.FileSystem.from_uri(self.uri)
            with files.open_input_stream(f"{root}/{name}") as source:
                return np.frombuffer(source.read(), np.uint8)
        path = f"{self.local}/{name}"
        return np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, np.uint8)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes each as hold the largest."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def widened(data: np.ndarray, n: int) -> np.ndarray:
    """`n` numbers of `narrow` from their bytes."""
    return data.view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]) if n else np.zeros(0, np.uint8)


#: Stands for a count that does not fit into a byte.
LARGE = 255


def write_counts(store: Store, name: str, counts: np.ndarray) -> None:
    """A byte for each count; those of LARGE and more once more with their places."""
    store.write(name, np.minimum(counts, LARGE).astype(np.uint8))
    at = np.flatnonzero(counts >= LARGE)
    store.write(f"{name}-large", np.concatenate([at, counts[at]]).astype(np.int64))


@dataclass
class Model:
    """What the driver knows of a model: sizes of shards, frequent words, discounts by order."""

    uri: str
    order: int = ORDER
    vocabulary_bits: int = 0
    words: int = 0
    tokens: int = 0
    shards: int = 1
    often: dict[int, int] = field(default_factory=dict)  # shards that a frequent word would fill
    types: int = 0
    freed: float = 0.0  # of the word counts, what the discounts took
    discounts: dict[int, list[float]] = field(default_factory=dict)

    @property
    def begin(self) -> int:
        return self.words

    @property
    def unknown(self) -> int:
        return self.words + 1

    @property
    def id_bits(self) -> int:
        return self.unknown.bit_length()

    @property
    def entry(self) -> tuple[type, int]:
        """Type of the numbers that hold a word's id and a count, and the bits of the count."""
        return (np.uint32, 32 - self.id_bits) if self.id_bits <= 30 else (np.uint64, 64 - self.id_bits)


def discounts(found: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from how many n-grams have counts 1 to 4."""
    t1, t2, t3, t4 = found
    if not t1 or not t2:
        return [0.0, 0.5, 1.0, 1.5]
    y = t1 / (t1 + 2 * t2)
    raw = (1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3 if t3 else 1.5)
    return [0.0, *(min(max(d, 0.05), k) for k, d in enumerate(raw, 1))]


def fold(keys: np.ndarray | np.uint64, ids: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of all words but the last, 0 without any, and the last words' ids."""
    return mix(keys * GOLDEN + ids.astype(U64) + U64(1))


def nearly_sorted(keys: np.ndarray) -> np.ndarray:
    """The order of 64-bit keys but for as many of their lowest bits as a place takes: keys and places are sorted in one number."""
    bits = U64(max(1, len(keys)).bit_length())
    return (np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=U64)) & ((U64(1) << bits) - U64(1))).astype(np.int64)


def keys_of(columns: list[np.ndarray]) -> np.ndarray:
    """Keys of n-grams from the ids of their first words, second words and so on."""
    keys = np.zeros(len(columns[0]), U64)
    for ids in columns:
        keys = fold(keys, ids)
    return keys


def fill_of(ids: np.ndarray, model: Model) -> np.ndarray:
    """Shards that each word would fill. A context's n-grams are spread over as many as its rarest word would fill."""
    if not model.often:
        return np.ones(len(ids), np.int64)
    known = np.array(sorted(model.often))
    fill = np.array([model.often[x] for x in known])
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where(known[at] == ids, fill[at], 1)


def first_shard(context_keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a context, or the first of several: the larger the key, the later."""
    return (((context_keys >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


def part_of(last: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which of its context's shards, counted from the first, an n-gram is in, by its last word."""
    return (mix(last.astype(U64) + GOLDEN) % parts.astype(U64)).astype(np.int64)


def _by(values: np.ndarray, along: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct value with the places where it stands, these in the order of `along`."""
    small = values.astype(np.uint16) if len(values) and 0 <= values.min() and values.max() < 1 << 16 else values  # sorted faster
    if along is None:
        order = np.argsort(small, kind="stable")
    else:
        first = np.argsort(along)
        order = first[np.argsort(small[first], kind="stable")]
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(values[at[0]]), at


def find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted `known`, and whether the keys are there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class Lookup:
    """A worker's view of the model."""

    def __init__(self, model: Model):
        self.model, self.store = model, Store(model.uri)
        self.bytes = lru_cache(maxsize=FETCHED if self.store.local is None else MAPPED)(self.store.open)

    def array(self, name: str, dtype: type) -> np.ndarray:
        return self.bytes(name).view(dtype)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of hashes of words, the model's unknown id for unknown ones, and how often they stand in the training texts."""
        ids, seen = np.full(len(hashes), self.model.unknown, np.int64), np.zeros(len(hashes), np.int64)
        if self.model.words:
            bits = self.model.vocabulary_bits
            for k, rows in _by((hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)):
                known = self.array(f"words-{k}", np.uint64)
                at, there = find(known, hashes[rows])
                ids[rows[there]] = widened(self.bytes(f"ids-{k}"), len(known))[at[there]]
                seen[rows[there]] = self.small(f"seen-{k}", at[there])
        return ids, seen

    def small(self, name: str, at: np.ndarray) -> np.ndarray:
        """Counts of `write_counts` at the places given."""
        out = self.bytes(name)[at].astype(np.int64)
        big = np.flatnonzero(out == LARGE)
        if len(big):
            places, counts = self.array(f"{name}-large", np.int64).reshape(2, -1)
            out[big] = counts[np.searchsorted(places, at[big])]
        return out

    def follows(self, ids: np.ndarray) -> np.ndarray:
        """How many different words stand before each."""
        out = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids < self.model.words)
        for block, rows in _by(ids[known] // BLOCK_IDS):
            out[known[rows]] = self.small(f"follows-{block}", ids[known[rows]] - block * BLOCK_IDS)
        return out

    def shard(self, n: int, k: int) -> tuple[np.ndarray, ...]:
        """What `write_shard` wrote."""
        data = self.bytes(f"{n}-{k}")
        sizes = data[:32].view(np.int64).tolist()
        cuts = 32 + 8 * np.cumsum([0, sizes[0], sizes[0] + 1, 4 * sizes[1], 2 * sizes[2]])
        contexts, about, totals, counts = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        return contexts.view(U64), about.view(U64), totals.view(np.int64).reshape(4, -1), counts.view(np.int64).reshape(2, -1), data[cuts[-1] :].view(self.model.entry[0])

    def level(self, n: int, keys: np.ndarray, parts: np.ndarray, context: np.ndarray, last: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct contexts of n-grams: sum of counts, and what the discounts `cut` take of them. Of distinct n-grams, by their contexts' places in rising order and their last words: counts."""
        total, freed, counts = self._level(n, keys, context, last, cut, 0)
        spread = np.flatnonzero(parts[context] > 1) if parts.max(initial=0) > 1 else np.zeros(0, np.int64)
        part = part_of(last[spread], parts[context[spread]])
        for k in range(1, int(parts.max(initial=0))):  # the other shards of the contexts that have several
            of, grams = np.flatnonzero(parts > k), spread[part == k]
            more = self._level(n, keys[of], np.searchsorted(of, context[grams]), last[grams], cut, k)
            total[of] += more[0]
            freed[of] += more[1]
            counts[grams] = more[2]
        return total, freed, counts

    def _level(self, n: int, keys: np.ndarray, context: np.ndarray, last: np.ndarray, cut: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`level` in one shard of each context."""
        begins = np.concatenate([[0], np.cumsum(np.bincount(context, minlength=len(keys)))])
        order = nearly_sorted(keys)
        where = first_shard(keys[order], self.model.shards)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(order)]])
        shards = ((where[cuts[:-1]] + part) % self.model.shards).tolist() if len(where) else []
        del where
        total, freed, found = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(last), np.int64)
        for k, a, b in zip(shards, cuts[:-1].tolist(), cuts[1:].tolist(), strict=False):
            contexts, about, totals, counts, entries = self.shard(n, k)
            at, there = find(contexts, keys[order[a:b]])
            at, to = at[there], order[a:b][there]
            if not len(at):
                continue
            first, end = ((about[x] >> U64(3 * TOTAL_BITS)).astype(np.int64) for x in (at, at + 1))
            all_, ones, twos = ((about[at] >> U64(x * TOTAL_BITS) & U64(FULL)).astype(np.int64) for x in (2, 1, 0))
            if totals.shape[1]:
                full = np.flatnonzero(all_ == FULL)
                all_[full], ones[full], twos[full] = totals[1:, np.searchsorted(totals[0], at[full])]
            total[to] = all_
            freed[to] = cut[1] * ones + cut[2] * twos + cut[3] * (end - first - ones - twos)
            own = begins[to + 1] - begins[to]
            rows = np.repeat(begins[to] - np.cumsum(own) + own, own) + np.arange(own.sum())
            found[rows] = self.among(entries, counts, np.repeat(first, own), np.repeat(end, own), last[rows])
        return total, freed, found

    def among(self, entries: np.ndarray, large: np.ndarray, low: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts of words, 0 of those that are not there, each sought between two places in a shard's entries."""
        kind, bits = self.model.entry
        place = np.int32 if len(entries) < 1 << 31 else np.int64
        at, sizes, least = low.astype(place), (end - low).astype(place), words.astype(kind) << kind(bits)
        open_ = np.flatnonzero(sizes)
        first, left, value = at[open_], sizes[open_], least[open_]
        while (more := left > 1).any():  # as many steps as the longest stretch needs; who is done drops out when half are
            if 2 * np.count_nonzero(more) < len(more):
                at[open_[~more]] = first[~more] + (entries[first[~more]] < value[~more])
                open_, first, left, value = open_[more], first[more], left[more], value[more]
            half = left >> 1
            left -= half
            first += half * (entries[first + half - (half > 0)] < value)
        at[open_] = first + (entries[first] < value)
        inside = np.flatnonzero(at < end)
        entry = entries[at[inside]]
        hit = (entry >> kind(bits)) == words[inside].astype(kind)
        out = np.zeros(len(words), np.int64)
        out[inside] = np.where(hit, entry & kind((1 << bits) - 1), 0)
        if large.shape[1]:
            full = np.flatnonzero(out == (1 << bits) - 1)
            out[full] = large[1, np.searchsorted(large[0], at[full])]
        return out


def write_shard(store: Store, model: Model, n: int, k: int, contexts: np.ndarray, starts: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
    """One file of a shard: sizes; sorted keys of contexts; for each its first n-gram, total, and n-grams with the counts 1 and 2, in one number;
    places, totals and so on of the contexts whose totals do not fit; places and counts of the n-grams whose counts do not fit; words and counts.
    """
    kind, bits = model.entry
    totals = np.zeros((3, len(contexts)), np.int64)
    if len(contexts):
        for row, values in enumerate((counts, counts == 1, counts == 2)):
            totals[row] = np.add.reduceat(values.astype(np.int64), starts[:-1])
    full, large = np.flatnonzero(totals[0] >= FULL), np.flatnonzero(counts >= (1 << bits) - 1)
    about = starts.astype(U64) << U64(3 * TOTAL_BITS)
    for row, place in enumerate((2, 1, 0)):
        about[:-1] |= np.minimum(totals[row], FULL).astype(U64) << U64(place * TOTAL_BITS)
    entries = (words.astype(kind) << kind(bits)) | np.minimum(counts, (1 << bits) - 1).astype(kind)
    whole = (np.array([len(contexts), len(full), len(large), 0]), contexts.astype(U64), about, full, totals[:, full], large, counts[large], entries)
    store.write(f"{n}-{k}", np.concatenate([np.ascontiguousarray(x).ravel().view(np.uint8) for x in whole]))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane; the first byte tells how many planes."""
    values = narrow(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return bytes([values.itemsize]) + zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"u{data[0]}").ravel().astype(np.int64)


def merged(columns: list[np.ndarray], counts: np.ndarray, model: Model, by_key: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams and their summed counts, in the order of their contexts' keys and then of words; or in any order, of ids where these fit into 64 bits."""
    if not len(counts):
        return columns, counts
    bits = model.id_bits
    if not by_key and len(columns) * bits <= 64:
        key = columns[0].astype(U64)
        for ids in columns[1:]:
            key = (key << U64(bits)) | ids.astype(U64)
        order = np.argsort(key)
    else:
        keys = keys_of(columns[:-1])
        first = np.argsort(keys)
        context = np.concatenate([[0], np.cumsum(np.diff(keys[first]) != 0)])
        key = (context.astype(U64) << U64(bits)) | columns[-1][first].astype(U64)
        again = np.argsort(key)
        order, key = first[again], key[again]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return [x[order[starts]] for x in columns], np.add.reduceat(counts[order], starts)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [x[order[starts]] for x in columns], np.add.reduceat(counts[order], starts)


BLOCKS = "kind int, shard int, grams binary, counts binary, t1 long, t2 long, t3 long, t4 long, types long"


def to_shards(model: Model, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """A block for each shard of distinct n-grams with counts, in the order they come in."""
    where = first_shard(keys_of(columns[:-1]), model.shards)
    if model.often:
        parts = fill_of(columns[0], model)
        for ids in columns[1:-1]:
            parts = np.minimum(parts, fill_of(ids, model))
        spread = np.flatnonzero(parts > 1)
        where[spread] = (where[spread] + part_of(columns[-1][spread], parts[spread])) % model.shards
    for k, rows in _by(where):
        yield k, pack(np.concatenate([x[rows] for x in columns])), pack(counts[rows])


def texts_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, an end after each text, and each text's number of tokens."""
    joined = b"\n".join(texts)
    words = word_hashes(joined, lower=True)
    if len(texts) == 1:
        sizes = np.array([len(words)])
    else:
        places = np.flatnonzero(first_bytes(joined))
        borders = np.cumsum([len(x) + 1 for x in texts])
        sizes = np.diff(np.searchsorted(places, borders), prepend=0)
    return np.insert(words, np.cumsum(sizes), U64(END)), sizes + 1


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def _utf8(text: str) -> Column:
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_utf8")


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): hashes of all words and of the end, with counts, a row each for a task or a part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, U64), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1])], names=["word", "n"])

        for tokens, _ in _token_runs(batches, 0):
            words, counts = np.unique(tokens, return_counts=True)
            distinct, back = np.unique(np.concatenate([held[0], words]), return_inverse=True)
            held = distinct, np.bincount(back, weights=np.concatenate([held[1], counts]), minlength=len(distinct)).astype(np.int64)
            if len(distinct) > HELD_WORDS:
                yield told()
                held = np.zeros(0, U64), np.zeros(0, np.int64)
        yield told()

    return texts.mapInArrow(run, "word long, n long")


def _token_runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of about CHUNK tokens' worth of texts at a time, over the borders of batches, and each text's number of tokens."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[bytes] = []
    size = held = 0

    def run() -> tuple[np.ndarray, np.ndarray]:
        out = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()  # not held while the run is worked on
        return out

    for batch in batches:
        for text in batch.column(column):
            waiting.append(text.as_py())
            size += len(waiting[-1])
            if size >= BLOCK_BYTES:
                parts.append(texts_hashes(waiting))
                held, waiting, size = held + len(parts[-1][0]), [], 0
                if held >= CHUNK:
                    yield run()
                    held = 0
    if waiting:
        parts.append(texts_hashes(waiting))
    if parts:
        yield run()


@dataclass
class Chunk:
    """Documents: their distinct words' hashes, each token's place among these, tokens of each document."""

    hashes: np.ndarray
    at: np.ndarray
    sizes: np.ndarray


@dataclass
class Grams:
    """The distinct n-grams of a chunk, n-gram k ending at tokens where index is k (kept of the longest alone).

    word: the place of the last word among the chunk's; context: the place of the words before it among
    the chunk's (n-1)-grams, in rising order, or one past them at the beginning of a text; suffix: that of
    all words but the first.
    """

    word: np.ndarray
    index: np.ndarray
    context: np.ndarray
    suffix: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[Chunk]:
    for tokens, sizes in _token_runs(batches, column):
        order = nearly_sorted(tokens)
        if (tokens[order[1:]] < tokens[order[:-1]]).any():
            order = np.argsort(tokens)
        tokens = tokens[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        back = np.empty(len(order), np.int32)
        back[order] = np.cumsum(new, dtype=np.int32) - 1
        chunk = Chunk(tokens[new], back, sizes)
        del tokens, order, new, back
        yield chunk


def grams_of(chunk: Chunk, model: Model) -> list[Grams]:
    """The chunk's words, pairs of words and so on up to the model's order; before a text its beginning stands as often as needed.

    With words in the order of their ids the n-grams are in the order of their ids too.
    """
    nothing, size = np.zeros(0, np.int32), len(chunk.hashes)
    out = [Grams(np.arange(size, dtype=np.int32), chunk.at, nothing, nothing)]
    starts = np.concatenate([[0], np.cumsum(chunk.sizes)[:-1]])
    for _ in range(2, model.order + 1):
        lower = out[-1]
        key = np.empty(len(chunk.at), np.int64)
        key[1:] = lower.index[:-1]
        key[starts] = len(lower.word)
        key *= size
        key += chunk.at
        bits = len(key).bit_length()
        if (len(lower.word) + 1) * size <= 1 << (63 - bits):
            key <<= bits
            order = nearly_sorted(key.view(U64))
            key >>= bits
        else:
            order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        index = np.empty(len(order), np.int32)
        index[order] = np.cumsum(new, dtype=np.int32) - 1
        distinct = key[new]
        context = distinct // size
        out.append(Grams((distinct - context * size).astype(np.int32), index, context.astype(np.int32), lower.index[order[new]]))
        lower.index = nothing
    return out


def columns_of(grams: list[Grams], ids: np.ndarray, model: Model) -> list[np.ndarray]:
    """Ids of the first words of the longest n-grams, of the second words and so on."""
    columns = [ids]
    for own in grams[1:]:
        before = [np.append(x, model.begin)[own.context] for x in columns]
        columns = [*before, ids[own.word]]
    return columns


def by_id(chunk: Chunk, lookup: Lookup) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk with its words in the order of their ids, their ids and how often they were seen."""
    ids, seen = lookup.words(chunk.hashes)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids))
    return Chunk(chunk.hashes[order], place[chunk.at], chunk.sizes), ids[order], seen[order]


def _send_grams(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for chunk in _chunks(batches, 0):
            chunk, ids, _ = by_id(chunk, lookup)
            found = grams_of(chunk, model)
            for shard, grams, counts in to_shards(model, columns_of(found, ids, model), np.bincount(found[-1].index)):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([grams], pa.binary()), pa.array([counts], pa.binary())], names=["shard", "grams", "counts"])

    return run


def _store_shard(model: Model, n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Merge a shard of n-grams, write it, and send on what the next lower order counts: kind 1, by shard, or 2, by block of words."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, store = int(rows["shard"].iloc[0]), Store(model.uri)
        parts = [unpack(x).reshape(n, -1) for x in rows["grams"]]
        columns = [np.concatenate([x[c] for x in parts]) for c in range(n)]
        del parts
        columns, counts = merged(columns, np.concatenate([unpack(x) for x in rows["counts"]]), model, True)
        keys = keys_of(columns[:-1])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        write_shard(store, model, n, shard, keys[first], np.append(first, len(keys)), columns[-1], counts)
        out = [(0, shard, b"", b"", *(int((counts == k).sum()) for k in (1, 2, 3, 4)), len(counts))]
        if n > 2:
            # behind the beginning of a text there is nothing else to count than how often
            lower, sums = merged(columns[1:], np.where(columns[1] == model.begin, counts, 1), model, False)
            out += [(1, *block, 0, 0, 0, 0, 0) for block in to_shards(model, lower, sums)]
        else:
            words, sums = np.unique(columns[1], return_counts=True)
            out += [(2, block, pack(words[at] - block * BLOCK_IDS), pack(sums[at]), 0, 0, 0, 0, 0) for block, at in _by(words // BLOCK_IDS)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in BLOCKS.split(", ")])

    return run


SUMS = "block int, part int, ids binary, sums binary"


def _added(rows: pd.DataFrame, model: Model) -> np.ndarray:
    """The sum of all rows of a block."""
    total = np.zeros(max(0, min(BLOCK_IDS, model.words - int(rows["block"].iloc[0]) * BLOCK_IDS)), np.int64)
    for ids, sums in zip(rows["ids"], rows["sums"], strict=True):
        total[unpack(ids)] += unpack(sums)  # a row has an id once
    return total


def _join_parts(model: Model) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One row for the rows of a block and part."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        total = _added(rows, model)
        ids = np.flatnonzero(total)
        return pd.DataFrame([(rows["block"].iloc[0], rows["part"].iloc[0], pack(ids), pack(total[ids]))], columns=["block", "part", "ids", "sums"])

    return run


def _store_block(model: Model) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block, total = int(rows["block"].iloc[0]), _added(rows, model)
        write_counts(Store(model.uri), f"follows-{block}", total)
        return pd.DataFrame([(block, *((total == k).sum() for k in (1, 2, 3, 4)), (total > 0).sum(), total.sum())], columns=["block", "t1", "t2", "t3", "t4", "types", "all"])

    return run


def _store_vocabulary(vocabulary: DataFrame, model: Model) -> None:
    """Ids go to the words by the binary order of magnitude of their counts, largest first, and by hash within."""
    size = vocabulary.count()
    bits = model.vocabulary_bits = max(0, int(np.ceil(np.log2(max(1, size) / SHARD_WORDS))))
    shard = F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)
    ranked = vocabulary.select("word", "n", shard.alias("shard"), F.floor(F.log2("n")).cast("int").alias("size"))
    told = ranked.groupBy("shard", "size").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()
    offsets: dict[int, dict[int, int]] = {}
    for x in sorted(told, key=lambda x: (-x["size"], x.shard)):
        offsets.setdefault(x.shard, {})[x["size"]] = model.words
        model.words += x.words
        model.tokens += x.tokens
    uri, most = model.uri, SHARD_TOKENS

    def keep_words(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(word=rows["word"].to_numpy(np.int64).view(np.uint64)).sort_values("word")
        k, n, sizes = int(rows["shard"].iloc[0]), rows["n"].to_numpy(np.int64), rows["size"].to_numpy()
        ids = np.zeros(len(rows), np.int64)
        for size_, at in _by(sizes):
            ids[at] = offsets[k][size_] + np.arange(len(at))
        store = Store(uri)
        store.write(f"words-{k}", rows["word"].to_numpy())
        store.write(f"ids-{k}", narrow(ids))
        write_counts(store, f"seen-{k}", n)
        often = np.flatnonzero(n > most)
        return pd.DataFrame({"often": [ids[often].tolist()], "times": [n[often].tolist()]})

    for x in ranked.groupBy("shard").applyInPandas(keep_words, "often array<long>, times array<long>").collect():
        model.often |= {w: -(-n // most) for w, n in zip(x.often, x.times, strict=True)}
    for k in set(range(1 << bits)) - set(offsets):
        Store(uri).write(f"words-{k}", np.zeros(0, np.uint64))
        Store(uri).write(f"ids-{k}", np.zeros(0, np.uint8))
        write_counts(Store(uri), f"seen-{k}", np.zeros(0, np.int64))


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Count and store the model of the column _utf8 of `texts`, of n-grams up to `order` words, two at least."""
    if order < 2:
        raise ValueError("an order of 2 at least")
    model = Model(new_path(texts.sparkSession, "ngrams"), order)
    vocabulary = stage(count_words(texts).groupBy("word").agg(F.sum("n").alias("n")), "ngram-words")
    _store_vocabulary(vocabulary, model)
    if not model.words:
        return model
    model.shards = -(-model.tokens // SHARD_TOKENS)
    ends = vocabulary.where(F.col("word") == END).first().n
    if ends > SHARD_TOKENS:
        model.often[model.begin] = -(-ends // SHARD_TOKENS)
    blocks = texts.mapInArrow(_send_grams(model), "shard int, grams binary, counts binary")
    for n in range(order, 1, -1):
        sent = stage(blocks.repartition(model.shards, "shard").groupBy("shard").applyInPandas(_store_shard(model, n), BLOCKS), "ngram-blocks")
        told = sent.where("kind = 0").agg(*(F.sum(x) for x in ("t1", "t2", "t3", "t4")), F.collect_set("shard")).first()
        model.discounts[n] = discounts(list(told[:4]))
        for k in set(range(model.shards)) - set(told[4]):
            write_shard(Store(model.uri), model, n, k, np.zeros(0, U64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        blocks = sent.where("kind = 1").select("shard", "grams", "counts")
    stored = sent.where("kind = 2").select(F.col("shard").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("grams").alias("ids"), F.col("counts").alias("sums"))
    left = model.shards
    parts = F.pmod(F.xxhash64("row"), F.lit(-(-left // FAN_IN))).cast("int")
    stored = stored.withColumn("part", parts).select("block", "part", "ids", "sums")
    while left > FAN_IN:  # every shard tells of most words: a tree keeps what a task adds up bounded
        left = -(-left // FAN_IN)
        joined = stage(stored.groupBy("block", "part").applyInPandas(_join_parts(model), SUMS), "ngram-sums")
        stored = joined.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
    found = stored.groupBy("block").applyInPandas(_store_block(model), "block int, t1 long, t2 long, t3 long, t4 long, types long, all long").collect()
    t1, t2, t3, t4, types, model.types = (sum(x[k] for x in found) for k in range(1, 7))
    cut = model.discounts[1] = discounts([t1, t2, t3, t4])
    model.freed = cut[1] * t1 + cut[2] * t2 + cut[3] * (types - t1 - t2)
    for block in set(range((model.words - 1) // BLOCK_IDS + 1)) - {x.block for x in found}:
        write_counts(Store(model.uri), f"follows-{block}", np.zeros(min(BLOCK_IDS, model.words - block * BLOCK_IDS), np.int64))
    return model


def probabilities(model: Model, lookup: Lookup, grams: list[Grams], ids: np.ndarray) -> np.ndarray:
    """Of each distinct n-gram of the highest order, the probability of its last word behind the others. ids: of the chunk's words."""
    even = 1.0 / (model.words + 1)  # one part for each word and one for all unknown
    if not model.types:
        return np.full(len(grams[-1].word), even)
    follows, cut = lookup.follows(ids), np.array(model.discounts[1])
    found = (follows - cut[np.minimum(follows, 3)]) / model.types + model.freed / model.types * even
    fill, parts = fill_of(ids, model), np.zeros(0, np.int64)
    keys, begin = fold(U64(0), ids), fold(np.zeros(1, U64), np.array([model.begin]))
    of_begin = fill_of(np.array([model.begin]), model)
    for n in range(2, model.order + 1):
        own, cut = grams[n - 1], np.array(model.discounts[n])
        before = np.concatenate([keys, begin])  # of all contexts, the beginning last
        parts = np.concatenate([fill if n == 2 else np.minimum(parts[grams[n - 2].context], fill[grams[n - 2].word]), of_begin])
        last = ids[own.word]
        total, freed, counts = lookup.level(n, before, parts, own.context, last, cut)
        passed = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
        total = np.maximum(total, 1)
        keys = fold(before[own.context], last) if n < model.order else None
        found = (counts - cut[np.minimum(counts, 3)]) / total[own.context] + passed[own.context] * found[own.suffix]
        begin = fold(begin, np.array([model.begin]))
    return found


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until their last columns hold about CHUNK tokens' bytes."""
    held: list[pa.RecordBatch] = []

    def one() -> pa.RecordBatch:
        return next(iter(pa.Table.from_batches(held).combine_chunks().to_batches()), held[0])

    for batch in batches:
        held.append(batch)
        if sum(x.column(x.num_columns - 1).nbytes for x in held) >= 6 * CHUNK:
            yield one()
            held = []
    if held:
        yield one()


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for batch in _joined(batches):
            last = batch.num_columns - 1
            made: list[list[np.ndarray]] = [[] for _ in range(4)]
            for chunk in _chunks(iter([batch]), last):
                starts = np.concatenate([[0], np.cumsum(chunk.sizes)[:-1]])
                chunk, ids, seen = by_id(chunk, lookup)
                grams = grams_of(chunk, model)
                add_one = np.log10((seen + 1) / (model.tokens + model.words + 1))
                score = np.log10(probabilities(model, lookup, grams, ids))
                for to, values in zip(made, (chunk.sizes, np.add.reduceat((seen > 0).astype(np.int64)[chunk.at], starts), np.add.reduceat(add_one[chunk.at], starts), np.add.reduceat(score[grams[-1].index], starts)), strict=True):
                    to.append(values)
            n, known, base, own = (np.concatenate(x) if x else np.zeros(0) for x in made)
            columns = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *columns], names=[*batch.schema.names[:last], *(x.split()[0] for x in RESULT.split(", "))])

    return run


RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", order: int = ORDER) -> DataFrame:
    """`docs` with held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    The model of `order` words learns from all rows that `held_out` leaves, over whole texts. Tokens are words between
    ASCII white space in lower case (A-Z alone) and one end for each text. base_score: add-one unigram
    log10 probability; score: that of the model; perplexity: 10 ** (-score / n_tokens). A null text
    counts as empty, a row without an id is learned from; repeated rows count each time; without a row
    to learn from every token has the probability 1. No rows give no rows. Input columns named as an
    added one are replaced.
    """
    bound_batches(docs.sparkSession)
    keep = without(docs, ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity", "_utf8"])
    marked = docs.select(*keep, held_out(F.col(id_col)).alias("held_out"), _utf8(text))
    model = train(marked.where(~F.col("held_out")).select("_utf8"), order)
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in marked.schema.fields[:-1])
    scored = marked.mapInArrow(_score(model), f"{schema}, {RESULT}")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
