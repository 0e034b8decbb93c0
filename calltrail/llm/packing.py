"""Packing token sequences: a configuration linear program over the histogram of lengths, rounded, then dealt out by arithmetic.

A text becomes its tokens and an end; only what is longer than ``capacity`` is cut, into full pieces and a rest. How many pieces there are of each length is all
that the choice of a packing needs: at most ``capacity`` numbers, however large the corpus. A configuration says how many pieces of which lengths share a sequence.
The linear program (fewest sequences, fractions allowed, that hold all pieces) is solved by multiplicative weights: each length has a price that falls as
it gets covered; a knapsack by dynamic programming finds the dearest configuration, and for every length the dearest one that it is in; those within a tolerance of the
best are used a little more. Prices over the best configuration's value are a dual solution, so every round also gives a proven lower bound.
Rounding takes whole multiples of the configurations, as far as there are pieces, and fits what is left, longest first, into the tightest place (which
may be in a new sequence). Several thresholds of rounding are tried, and smaller steps of the weights, until a plan is within 0.01 % of the bound, or (of over 100 lengths) one sequence, or the work is spent.

The result is a list of patterns with multiplicities, made from the histogram on the driver. A piece's number among those of its length (``operators.scans``, so that a length of a
third of all pieces is spread over tasks) then determines its sequence and offset by a binary search in the patterns' table; nothing is grouped.

Null text is empty: one piece, the end alone. Very long texts are encoded in steps and cut as they are encoded. Repeated rows are packed each, with null ids too. Extra columns are ignored. No rows, no
pieces. A tokenizer is named by its file, which every machine must have.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.llm.shared import written
from calltrail.operators import scans

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), in how many sequences

#: Words an encoder remembers (about 160 MB), and the longest that it does.
KNOWN_WORDS, LONGEST_WORD = 1_000_000, 64
#: Sums of prices, in thousands, that a plan may cost, and the part of the lower bound by which it may miss it and still be enough.
WORK, ENOUGH = 1_500, 1e-4
_STEP = 1 << 20
_WHITE = b" \n\t\r\x0b\x0c"
_MARKS, _LETTERS = b".,;:!?#$%&()*+-/=_\"'~", b"abcdefghijklmnopqrstuvwxyz"


def _steps(blob: bytes) -> Iterator[bytes]:
    """blob in steps of about 1 MB that end at white space."""
    at, n = 0, len(blob)
    while n - at > _STEP:
        cut = max(blob.rfind(c, at, at + _STEP) for c in (_WHITE[i : i + 1] for i in range(len(_WHITE))))
        if cut <= at:
            found = [c for c in (blob.find(_WHITE[i : i + 1], at + _STEP) for i in range(len(_WHITE))) if c >= 0]
            cut = min(found, default=n)
        yield blob[at:cut]
        at = cut
    yield blob[at:]


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    by_words: for tokenizers that read no case, drop white space, join nothing across it and always part a letter from what follows it if that is neither letter nor digit.
    Words between white space of ASCII, without the marks at their end, are then encoded once and remembered.
    """

    def __init__(self, path: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words, self.known = Tokenizer.from_file(path), by_words, {}

    def _encode(self, blobs: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([b.decode("utf-8", "replace") for b in blobs], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Many words in one call, a digit between them that is a token of its own and in none of them: half the cost of a call each."""
        gap = np.frombuffer(self._encode([b"0"])[0], "<u4")
        plain, odd = [w for w in words if b"0" not in w], [w for w in words if b"0" in w]
        out = dict(zip(odd, self._encode(odd), strict=True))
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = np.frombuffer(self._encode([b" 0 ".join(some)])[0], "<u4")
            cuts = np.flatnonzero(ids == gap[0])
            if len(gap) == 1 and len(cuts) == len(some) - 1:
                out.update((w, ids[lo:hi].tobytes()) for w, lo, hi in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True))
            else:
                out.update(zip(some, self._encode(some), strict=True))
        return out

    def ids(self, blob: bytes) -> Iterator[bytes]:
        if not self.by_words:
            yield self._encode([blob])[0]
            return
        for part in _steps(blob):
            # special tokens are found as they are written, before the tokenizer lowers the case
            words = (part if b"<|" in part else part.lower()).split()
            try:
                yield b"".join([self.known[w] for w in words])
            except KeyError:
                long = self._learn(set(words))
                yield b"".join([self.known[w] for w in words])
                for w in long:
                    del self.known[w]

    def _learn(self, words: set[bytes]) -> list[bytes]:
        """Remembers words; those that should be forgotten again are returned."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        new = words.difference(self.known)
        cut = {}
        for w in new:
            stem = w.rstrip(_MARKS)
            if stem != w and stem[-1:] in _LETTERS and stem:
                cut[w] = (stem, w[len(stem) :])
        missing = list((new.difference(cut) | {p for pair in cut.values() for p in pair}).difference(self.known))
        self.known.update(self._encode_words(missing))
        self.known.update({w: self.known[a] + self.known[b] for w, (a, b) in cut.items()})
        return [w for w in {*missing, *new} if len(w) > LONGEST_WORD]


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, by_words: bool) -> Encoder:
    """One for each worker, which several tasks use."""
    if (path, by_words) not in _encoders:
        _encoders[path, by_words] = Encoder(path, by_words)
    return _encoders[path, by_words]


def cut(parts: Iterator[bytes], end: int, capacity: int) -> Iterator[bytes]:
    """A text's ids, which come in parts, with the end after them: pieces of capacity ids, the last one may be shorter."""
    held, size = bytearray(), 4 * capacity
    for part in parts:
        held += part
        if len(held) >= size:
            whole = len(held) // size * size
            for at in range(0, whole, size):
                yield bytes(held[at : at + size])
            del held[:whole]
    held += int(end).to_bytes(4, "little")
    yield bytes(held)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, by_words: bool = False, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit) of every piece of every row."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]

    def run(batches):
        encoder, out, size = _encoder(tokenizer, by_words), [], 0
        for b in batches:
            for doc, blob in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                for k, ids in enumerate(cut(encoder.ids(blob.as_py() or b""), end, capacity)):
                    out.append((doc, k, k * capacity, len(ids) // 4, zlib.crc32(ids), *[ids] * with_ids))
                    size += 1 + len(ids) * with_ids
                    if size >= 1 << 23 or len(out) >= 1 << 14:
                        yield _batch(out, types, names)
                        out, size = [], 0
        if out:
            yield _batch(out, types, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room 0 to capacity the best sum of prices, and the index of an item that is in it (-1: room for nothing)."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        k = fits[room]
        sums = best[room - lengths[:k]] + prices[:k]
        at = sums.argmax()
        if sums[at] > best[room - 1]:
            best[room], item[room] = sums[at], at
        else:
            best[room], item[room] = best[room - 1], -2  # as with less room
    return best, item


def configurations(lengths: np.ndarray, prices: np.ndarray, capacity: int, tolerance: float) -> tuple[float, list[tuple[tuple[int, int], ...]]]:
    """The dearest configuration's value, and for each length the dearest configuration with it, where that is within the tolerance; items by their index."""
    best, item = _knapsack(lengths, prices, capacity)
    value = prices + best[capacity - lengths]
    chosen = np.flatnonzero(value >= (1 - tolerance) * best[capacity])
    room, rows = capacity - lengths[chosen], [[int(i)] for i in chosen]
    live = np.arange(len(chosen))
    while len(live):
        at = item[room[live]]
        live, at = live[at != -1], at[at != -1]
        less = at == -2
        room[live[less]] -= 1
        taken, at = live[~less], at[~less]
        room[taken] -= lengths[at]
        for r, i in zip(taken.tolist(), at.tolist(), strict=True):
            rows[r].append(i)
    out = {}
    for r in rows:
        items, n = np.unique(r, return_counts=True)
        out[tuple(zip(items.tolist(), n.tolist(), strict=True))] = None
    return float(best[capacity]), list(out)


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float) -> Iterator[tuple[dict[tuple[tuple[int, int], ...], float], float]]:
    """After every round: how often each configuration (over indices of lengths) is used, as far as all lengths are covered, and a lower bound on the number of sequences.

    A length is covered by step more in a round at most; the rounds end when all are covered. A smaller step comes closer to the optimum.
    """
    used: dict[tuple[tuple[int, int], ...], float] = {}
    covered, bound, steepness = np.zeros(len(lengths)), 0.0, np.log(len(lengths) + 1)
    while covered.min() < 1:
        # what is covered least costs most
        prices = (lengths / capacity) * np.exp(np.maximum(-steepness * (covered - covered.min()) / min(1.0, 4 * step), -60))
        best, found = configurations(lengths, prices, capacity, step / 5)
        bound = max(bound, float((prices * counts).sum() / best))
        add, amounts = np.zeros(len(lengths)), []
        for config in found:
            i, n = np.array(config).T
            amounts.append(float((counts[i] / n).min()))
            add[i] += n * amounts[-1]
        scale = step / (add / counts).max()
        for config, amount in zip(found, amounts, strict=True):
            used[config] = used.get(config, 0.0) + amount * scale
        covered += scale * add / counts
        yield {c: x / max(covered.min(), 1.0) for c, x in used.items()}, bound


def best_fit(left: dict[int, int], open_: list[Pattern], capacity: int) -> list[Pattern]:
    """Pieces (length: how many) into open and new sequences, longest first, each where the least room stays; alike sequences are handled together."""
    rooms: list[int] = []
    by_room: dict[int, list[Pattern]] = {}

    def put(room: int, items: tuple[tuple[int, int], ...], n: int) -> None:
        if n:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((items, n))

    for items, n in open_:
        put(capacity - sum(x * k for x, k in items), items, n)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                items, there = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, items, there = capacity, (), n
            fit = room // length
            full = min(there, n // fit)
            put(room - fit * length, (*items, (length, fit)), full)
            n -= full * fit
            rest = there - full
            if rest and n:  # fewer than fit, or there would be more full ones
                put(room - n * length, (*items, (length, n)), 1)
                n, rest = 0, rest - 1
            if items:
                put(room, items, rest)
    return [p for group in by_room.values() for p in group]


def _rounded(used: dict, lengths: np.ndarray, counts: np.ndarray, capacity: int, threshold: float) -> list[Pattern]:
    """Whole multiples of the configurations, those used most first, a fraction up from the threshold on; the rest by best fit."""
    left = counts.copy()
    made: list[Pattern] = []
    for config, x in sorted(used.items(), key=lambda c: (-c[1], c[0])):
        i, n = np.array(config).T
        times = int(min(np.floor(x + 1 - threshold), (left[i] // n).min()))
        if times > 0:
            left[i] -= times * n
            made.append((tuple((int(lengths[k]), m) for k, m in config), times))
    return best_fit({int(length): int(n) for length, n in zip(lengths, left, strict=True) if n}, made, capacity)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], float]:
    """Patterns that hold every piece of the histogram, in few sequences, and a lower bound on how many there must be."""
    full = histogram.get(capacity, 0)
    whole: list[Pattern] = [(((capacity, 1),), full)] if full else []
    rest = {length: n for length, n in sorted(histogram.items()) if length < capacity and n}
    if not rest:
        return whole, float(full)
    lengths, counts = np.array(list(rest)), np.array(list(rest.values()))
    bound, best, rounds, step = float((lengths * counts).sum() / capacity), None, 0, 0.1
    number = lambda ps: sum(n for _, n in ps)
    good = lambda: number(best) <= max(np.ceil(bound - 1e-6) + (len(lengths) > 100), bound * (1 + ENOUGH))
    most = WORK * 1000 // (capacity * (1 + len(lengths) // 100)) + 10
    # until the plan is proved to be good or the rounds of pricing have had their share of work
    while best is None or (not good() and rounds < most):
        for used, least in solve(lengths, counts, capacity, step):
            rounds, bound = rounds + 1, max(bound, least)
            if rounds % 10 == 0:
                best = min([best] * (best is not None) + [_rounded(used, lengths, counts, capacity, t) for t in (1.0, 0.0)], key=number)
                if good() or rounds >= most:
                    break
        best = min([best] * (best is not None) + [_rounded(used, lengths, counts, capacity, t) for t in (1.0, 0.5, 0.05, 0.0)], key=number)
        step /= 2
    return whole + best, full + bound


def places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first, each, sequence, offset): pieces of a length from number first on lie in sequences from this one on, each of them in one, the first of them at offset."""
    rows, taken, sequence = [], {}, 0
    for items, n in patterns:
        offset = 0
        for length, each in items:
            first = taken.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            taken[length] = first + n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = 4096, hot_rows: int = 1_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table that gives the same rows each time it is read)."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return found.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    table = places(plan(histogram, capacity)[0])
    starts = (table[:, 0] << 48) | table[:, 1]
    spread = F.xxhash64("doc_id", "piece")
    numbered = scans.running(found, ["length"], spread, [F.col(c) for c in ("doc_id", "piece", "ids_crc32")], {"_number": ("count", F.lit(1))}, hot_rows)

    kept = found.columns

    def run(batches):
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            at = np.searchsorted(starts, (length << 48) | (number - 1), side="right") - 1
            later, inside = np.divmod(number - 1 - table[at, 1], table[at, 2])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(table[at, 3] + later), pa.array(table[at, 4] + inside * length)], [*kept, "sequence_id", "offset"])

    schema = found.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}).schema
    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, by_words: bool = False, with_ids: bool = False, **names: str) -> DataFrame:
    """Pieces of all documents with their places; a text is encoded once."""
    return pack(written(pieces(docs, tokenizer, capacity, end, by_words, with_ids=with_ids, **names), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids, one row per sequence, from packed pieces with their ids; at most capacity ids are put together."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"))
