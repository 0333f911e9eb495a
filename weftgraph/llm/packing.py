"""Best-fit packing of tokenised documents into sequences of a fixed length.

The lengths' histogram is all that the driver sees. Its configuration linear program is solved by
multiplicative weights: lengths that are served too little gain weight, and a knapsack by dynamic
programming finds the configurations that the weights price highest. The fractions are rounded
down to whole sequences, what that leaves is solved and rounded again, and only the last pieces are
packed best fit. Each piece then finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bound_batches, gapless_rank, stage
from weftgraph.llm.memory import remembered

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


#: Share of the demand that a solution leaves to the next; rounds of a solution; solutions one after the other.
LEFT_OVER, ROUNDS, SOLUTIONS = 0.02, 400, 8
#: Share of the demand, and sequences, that a round should serve: less widens its steps, more narrows them.
PACE, PACE_SEQUENCES = 0.003, 25


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """For each room 0..capacity the dearest filling's worth and the last length put in (0: a unit stays empty); prices[l] of length l, -inf for none."""
    best, last, worth = np.zeros(capacity + 1), [0] * (capacity + 1), np.empty(capacity)
    for room in range(1, capacity + 1):
        own = np.add(best[room - 1 :: -1], prices[1 : room + 1], out=worth[:room])
        k = int(own.argmax())
        if own[k] > best[room - 1] + 1e-12:
            best[room], last[room] = own[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, last


def _filling(last: list[int], room: int) -> dict[int, int]:
    """How often each length stands in the dearest filling of `room`."""
    counts: dict[int, int] = {}
    while room > 0:
        k = last[room]
        if k:
            counts[k] = counts.get(k, 0) + 1
        room -= k or 1
    return counts


def solve_configurations(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = 0.02, slack: float = 0.02) -> list[tuple[Pattern, float]]:
    """Fractional solution of the configuration program by multiplicative weights: patterns and how often each is used.

    A length's price is its size times a weight, which falls exponentially as it is served ahead of
    the others and grows as it lags. In each round the knapsack gives the dearest configuration that
    holds each length; those within `slack` of the dearest of all are used until a length in them is
    served further ahead of the whole than the round's step allows. No length is served beyond its demand.
    """
    size = np.arange(capacity + 1) / capacity
    wanted = demand[: capacity + 1].astype(float)
    left, step, before = wanted.copy(), 0.1, 1.0
    pace = max(PACE, PACE_SEQUENCES / max(1.0, float((wanted * size).sum())))
    uses: dict[Pattern, float] = {}
    for turn in range(rounds):
        share = float((left * size).sum() / (wanted * size).sum())
        if share < LEFT_OVER:
            break
        if turn:
            step = min(1.0, step * 1.3) if share > before * (1 - pace) else max(0.05, step * 0.95)
        before = share
        room = np.maximum(left - wanted * share * (1 - step), 0)
        open_ = np.flatnonzero((room > 0) & (left > 1e-9 * wanted))
        if not len(open_):
            break
        prices = np.full(capacity + 1, -np.inf)
        prices[open_] = size[open_] * np.exp(rate * np.clip(left[open_] / wanted[open_] / share - 1, -3, 3))
        best, last = knapsack(prices, capacity)
        worth = prices[open_] + best[capacity - open_]
        least, moved = worth.max() * (1 - slack), 0.0
        for k in np.argsort(-worth, kind="stable").tolist():
            if worth[k] < least:
                break
            first = int(open_[k])
            counts = _filling(last, capacity - first)
            counts[first] = counts.get(first, 0) + 1
            if any(n > wanted[x] for x, n in counts.items()):
                continue  # more of a length than there are pieces
            use = min(float(room[x]) / n for x, n in counts.items())
            if use > 0:
                pattern = tuple(sorted(counts.items(), reverse=True))
                uses[pattern] = uses.get(pattern, 0.0) + use
                for x, n in counts.items():
                    room[x] -= use * n
                    left[x] -= use * n
                moved += use
        if moved <= 0 and step >= 1:
            break
    return sorted(uses.items(), key=lambda x: -x[1])


def _best_fit(left: np.ndarray, capacity: int) -> Pattern:
    """The longest length left, then again and again the longest that still fits."""
    counts: dict[int, int] = {}
    room, have = capacity, np.flatnonzero(left)
    while room and len(have):
        k = int(np.searchsorted(have, room, side="right")) - 1
        if k < 0:
            break
        length = int(have[k])
        n = min(int(left[length]), room // length)
        counts[length] = n
        room -= n * length
        have = have[:k]
    return tuple(counts.items())


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the program's dual value at prices of each length's size."""
    return -(-int((histogram * np.arange(len(histogram))).sum()) // capacity)


def plan_sequences(histogram: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Configurations and whole numbers of sequences that hold exactly the pieces of the histogram (index: length).

    The program's uses are rounded down and what that leaves is solved again. Once the whole parts
    are under a tenth of what is left, each configuration is used once more at most where its pieces
    are left; only the few pieces beyond that are packed best fit.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[Pattern, int]] = []

    def take(pattern: Pattern, times: int) -> None:
        out.append((pattern, times))
        for k, n in pattern:
            left[k] -= n * times

    if left[capacity]:
        take(((capacity, 1),), int(left[capacity]))
    for turn in range(SOLUTIONS):
        if not left.any():
            break
        uses = solve_configurations(left, capacity)
        whole = [(pattern, int(use + 1e-9)) for pattern, use in uses if use >= 1 - 1e-9]
        for pattern, times in whole:
            take(pattern, times)
        if sum(times for _, times in whole) <= lower_bound(left, capacity) / 9 or turn == SOLUTIONS - 1:
            for pattern, _ in uses:
                if all(left[k] >= n for k, n in pattern):
                    take(pattern, 1)
            break
    while left.any():
        pattern = _best_fit(left, capacity)
        take(pattern, min(int(left[k]) // n for k, n in pattern))
    return out


def _visible_bytes() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(hidden)}


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, the same as of encoding it in one go.

    The pre-tokens of a byte-level BPE never join a character with white space after it, so the
    words between single spaces and line ends are encoded apart and remembered. Texts with other
    white space are encoded whole.
    """

    MOST = 1_000_000

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.end = np.array([end_id], "<u4").tobytes()
        self.plain = all(len(self.encode(x)) == 4 for x in ("\n", ".", ",")) and self.encode("a, b.\nc") == b"".join(map(self.encode, ("a", ",", " b", ".", "\n", "c")))
        self.line_end = self.encode("\n")
        # a word of letters alone is one pre-token, which the merges can take without the rest of the machinery
        model, visible = tokenizer.model, _visible_bytes()
        self.merge = lambda text: np.array([x.id for x in model.tokenize(text.encode().decode("latin-1").translate(visible))], "<u4").tobytes()
        self.direct = all(self.merge(x) == self.encode(x) for x in (" naïve", "Ünder", " of", " 世界", " ñá"))
        self.first, self.later = self._memory(""), self._memory(" ")

    def _memory(self, lead: str) -> dict[str, bytes]:
        encode, merge, direct, tails = self.encode, self.merge, self.direct, {x: self.encode(x) for x in ".,"}

        class Memory(dict):
            def __missing__(self, word: str) -> bytes:
                if word[-1:] in tails and word[-2:-1].isalpha():
                    made = self[word[:-1]] + tails[word[-1]]
                elif direct and word.isalpha():
                    made = merge(lead + word)
                else:
                    made = encode(lead + word)
                self[word] = made
                return made

        return Memory()

    def __call__(self, text: str) -> bytes:
        words = text.split()
        if not self.plain or not words or len(text) != sum(map(len, words)) + len(words) - 1 or text.count(" ") + text.count("\n") != len(words) - 1:
            return self.encode(text) + self.end
        parts = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            parts.append(self.first[head])
            parts += map(self.later.__getitem__, rest)
            parts.append(self.line_end)
        parts[-1] = self.end
        for memory in (self.first, self.later):
            if len(memory) > self.MOST:
                memory.clear()
        return b"".join(parts)


def encoder(path: str, end_id: int) -> Encoder:
    """A worker's encoder, which remembers words from one task to the next."""
    return remembered(("encoder", path, end_id), lambda: Encoder(path, end_id))


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces; only the first may be shorter than the capacity where there are several."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    ends = range(first, n + 1, capacity)
    view, out, start = memoryview(ids), [], 0
    for end in ends:
        out.append((start, end - start, zlib.crc32(view[4 * start : 4 * end])))
        start = end
    return out


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text: str, id_col: str) -> DataFrame:
    """(doc_id, _tie, piece, start, length, ids_crc32), a row for each piece."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        for batch in batches:
            rows = [(k, *p) for k, x in enumerate(batch.column(1)) for p in enumerate(cut(encode(x.as_py()), capacity))]
            at = pa.array([x[0] for x in rows], pa.int64())
            piece = [pa.array([x[1] for x in rows], pa.int32())]
            three = [pa.array([x[2][k] for x in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *piece, *three], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _placer(plan: list[tuple[Pattern, int]]) -> Callable[[Iterator[tuple[pd.Series, pd.Series]]], Iterator[pd.DataFrame]]:
    """From length and rank to sequence and offset, by the ranks that each configuration takes of each length."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, n in pattern:
            rows.append((length, taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        sequence += times
    rows.sort()
    lengths, ranks, each, first, offsets = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
    span = np.int64(1) << np.int64(48)
    keys = lengths * span + ranks

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, rank in batches:
            length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
            k = np.searchsorted(keys, length * span + rank, side="right") - 1
            past = rank - ranks[k]
            yield pd.DataFrame({"sequence_id": first[k] + past // each[k], "offset": offsets[k] + past % each[k] * length})

    return place


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the program finds.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null
    text counts as empty and is the end token alone; repeated rows are packed each; only documents
    longer than a sequence are cut; no rows give no rows. Other input columns stay behind.
    """
    bound_batches(docs.sparkSession)
    pieces = stage(cut_documents(docs, tokenizer, capacity, end_id, text, id_col), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row.length] = row["count"]
    place = F.pandas_udf(_placer(plan_sequences(histogram, capacity)), "sequence_id long, offset long")
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", int(histogram.sum()))
    return ranked.withColumn("_at", place("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
