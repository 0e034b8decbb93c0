"""Language-model scores by a probabilistic suffix tree over words, its counts kept in hash buckets.

Symbols are lower-cased words and one end per text. The root predicts by smoothed frequencies, (c + 0.5) / (N + 0.5 (V + 1)), where
all unknown words are one symbol. A context (the last 1 to ``max_depth`` words) is a node of the tree if it was seen ``least_count``
times in training and its next-symbol distribution diverges from its parent's: the log-likelihood ratio of its own training symbols,
each left out of the counts in turn and shrunk towards the parent by ``PRIOR`` symbols, must be ``least_gain`` nats or more. A node predicts w by
(c(s, w) + d P(w | parent)) / (c(s) + d), d being the number of different symbols seen after it; a context that is no node hands on its
parent's prediction, so a symbol is scored in the state of the longest suffix that is a node.

The corpus is cut into blocks of about ``block_tokens`` words, in file order. For each order (words, then contexts of one word, of two, ...) a block
sends every distinct gram once, with its training count, to the bucket of its context's number; a bucket sums the
blocks, tests its contexts, and answers each block with the sums, in the order asked. So what is shuffled are
distinct grams per block, never one row per occurrence, and a task holds one block or one bucket, whose number
follows the bytes of text. Answers are a table in the shared folder, partitioned by block, which the next pass reads for its own block.

Buckets give numbers to what they sum: to words by falling frequency, and to grams that are contexts of the next order by their order. Requests name contexts and
symbols by these, sorted and as differences, and travel as byte planes that are packed each; so they are small, and no two contexts can be taken for one. An answer
leaves out counts that nobody asks of it: those of rare grams after contexts that are no nodes.

How often a context occurs in all is known from the order before. One that would fill a bucket is dealt over several by symbol; each of
these adds up its part of the context's gain and of its d, and the parts are summed in one small table (a row per such context, of which there are fewer than
four a bucket) that every task reads. So each context meets the same test with the same numbers, whatever the number of buckets, blocks or partitions.

Null text counts as empty (an end only). Rows are scored each, also with repeated ids; a very long text is a block of its own, so it must fit a task's memory
(about 150 bytes a word). No training row: N = V = 0 and every symbol is unknown. Extra columns are ignored. No rows, no output.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.llm.shared import shared_dir, without_leftovers, written
from calltrail.llm.text import mix, word_hashes
from calltrail.tables import delete

END = np.uint64(0x5851F42D4C957F2D)
#: Symbols of the parent's prediction that the divergence test mixes in.
PRIOR = 4.0
#: Answer for a context whose test is in the table of dealt contexts.
_DEALT = np.uint32(0xFFFFFFFF)
#: In the place of a bucket: a block's state, and its words, which are deleted once they are answered.
STATE, WORDS = -1, -2
REQUEST = "block long, bucket int, payload binary, lengths array<long>"
_REQUEST_NAMES = ["block", "bucket", "payload", "lengths"]


def _pack(*arrays: np.ndarray) -> tuple[bytes, list[int]]:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), [len(a) for a in arrays]


def _unpack(payload: bytes, lengths: list[int], *types) -> list[np.ndarray]:
    out, at = [], 0
    for n, t in zip(lengths, types, strict=True):
        out.append(np.frombuffer(payload, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _squeezed(*arrays: np.ndarray) -> tuple[bytes, list[int]]:
    """_pack of unsigned integers, byte by byte of their width: planes of zeros are left out, others packed where that makes them smaller."""
    out, codec = [], pa.Codec("zstd")
    for a in arrays:
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
        parts = [b"" if not x.any() else min((x.tobytes(), codec.compress(x.tobytes(), asbytes=True)), key=len) for x in planes]
        out += [bytes([width]), np.array([len(x) for x in parts], "<u4").tobytes(), *parts]
    return b"".join(out), [len(a) for a in arrays]


def _spread(payload: bytes, lengths: list[int]) -> list[np.ndarray]:
    """The arrays of _squeezed, as 64-bit ones."""
    out, at, codec = [], 0, pa.Codec("zstd")
    for n in lengths:
        width = payload[at]
        sizes = np.frombuffer(payload, "<u4", width, at + 1)
        at += 1 + 4 * width
        planes = np.zeros((8, n), np.uint8)
        for k, size in enumerate(sizes.tolist()):
            if size:
                part = payload[at : at + size]
                planes[k] = np.frombuffer(part if size == n else codec.decompress(part, decompressed_size=n, asbytes=True), np.uint8)
            at += size
        out.append(np.ascontiguousarray(planes.T).view("<u8").reshape(n).astype(np.uint64, copy=False))
    return out


def _steps(rising: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, the first from 0."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], _REQUEST_NAMES)


@dataclass
class Block:
    """One block's texts as places of its distinct words, which are ordered by bucket, then hash."""

    key: int
    buckets: int
    ids: np.ndarray
    held: np.ndarray
    offsets: np.ndarray
    n_words: int
    ranks: np.ndarray

    @classmethod
    def of(cls, key: int, buckets: int, ids: list, held: list, hashes: list[np.ndarray]) -> tuple[Block, np.ndarray]:
        """The block and its words' hashes, which only the first requests need."""
        n = np.array([len(h) + 1 for h in hashes], np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)])
        flat = np.empty(offsets[-1], np.uint64)
        flat[offsets[1:] - 1] = END
        inner = np.ones(len(flat), bool)
        inner[offsets[1:] - 1] = False
        flat[inner] = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        words, ranks = np.unique(flat, return_inverse=True)
        order = np.lexsort((words, words % np.uint64(buckets)))
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        return cls(key, buckets, np.array(ids, object), np.array(held, bool), offsets, len(words), place[ranks]), words[order]

    def state(self) -> tuple:
        """A row that holds the block; words are numbered by falling frequency, then place, and tokens written byte by byte, which compresses best."""
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        null = np.array([i is None for i in self.ids], np.uint8)
        order = np.argsort(-np.bincount(self.ranks, minlength=self.n_words), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        planes = number[self.ranks].view(np.uint8).reshape(-1, 4).T.ravel()
        # places rise within a frequency, so most of their differences are small; they are taken modulo 2**32
        steps = _steps(order.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.ravel()
        payload, lengths = _pack(ids, null, self.held.astype(np.uint8), self.offsets, steps, planes)
        return self.key, STATE, payload, lengths

    @classmethod
    def back(cls, key: int, buckets: int, payload: bytes, lengths: list[int]) -> Block:
        ids, null, held, offsets, steps, planes = _unpack(payload, lengths, np.int64, np.uint8, np.uint8, np.int64, np.uint8, np.uint8)
        whole = lambda x: np.ascontiguousarray(x.reshape(4, -1).T).view(np.uint32).ravel()
        order = np.cumsum(whole(steps), dtype=np.uint32)
        return cls(key, buckets, np.array([None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], object), held.astype(bool), offsets, len(order), order[whole(planes)])

    @property
    def trained(self) -> np.ndarray:
        """Whether each token is in a training text."""
        return np.repeat(~self.held, np.diff(self.offsets))

    def spans(self, bucket: np.ndarray) -> np.ndarray:
        return np.searchsorted(bucket, np.arange(self.buckets + 1))


def _words_of(block: Block, words: np.ndarray) -> tuple:
    """A row with all that a block asks about its words."""
    counts = np.bincount(block.ranks, block.trained, len(words)).astype(np.uint32)
    return block.key, WORDS, *_pack(words, counts)


def _words_asked(key: int, buckets: int, payload: bytes, lengths: list[int]) -> list[tuple]:
    words, counts = _unpack(payload, lengths, np.uint64, np.uint32)
    at = np.searchsorted(words % np.uint64(buckets), np.arange(buckets + 1))
    return [(key, k, *_squeezed(_steps(words[lo:hi]), counts[lo:hi])) for k, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]


class Grams:
    """The distinct (context, symbol) pairs of a block, ordered by bucket; where says which one a position has (-1: none)."""

    def __init__(self, block: Block, at: np.ndarray, context: np.ndarray, numbers: np.ndarray, totals: np.ndarray, share: float, parent: np.ndarray, symbol: np.ndarray, symbols: np.ndarray):
        """at: positions; context: the place of each one's context in numbers and totals; share: most tokens of one bucket's part of a context; parent: ln P; symbol: the places of all tokens in symbols. numbers and symbols rise."""
        m = np.int64(len(symbols))
        key = context.astype(np.int64) * m + symbol[at]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        first = order[new]
        self.context, named = np.divmod(key[new], m)
        self.symbol = symbols[named]
        own = mix(numbers + np.uint64(1))[self.context]
        fan = np.maximum(1, np.ceil(totals[self.context] / share)).astype(np.uint64)
        self.bucket = np.where(fan > 1, mix(own + mix(self.symbol % fan)), own) % np.uint64(block.buckets)
        by_bucket = np.argsort(self.bucket.astype(np.uint16 if block.buckets < 1 << 16 else np.int64), kind="stable")
        place = np.empty(len(by_bucket), np.int64)
        place[by_bucket] = np.arange(len(by_bucket))
        self.where = np.full(len(block.ranks), -1, np.int32)
        self.where[at[order]] = place[np.cumsum(new) - 1]
        self.block, self.bucket, self.context, self.symbol, self.dealt = block, self.bucket[by_bucket], self.context[by_bucket], self.symbol[by_bucket], fan[by_bucket] > 1
        self.number, self.total, self.parent = numbers[self.context], totals[self.context], parent[first[by_bucket]]
        self.count = np.bincount(self.where[at], block.trained[at], len(place)).astype(np.uint32)
        # where a context's grams begin in a bucket
        self.starts = np.flatnonzero(np.concatenate([[True], (self.context[1:] != self.context[:-1]) | (self.bucket[1:] != self.bucket[:-1])])) if len(place) else np.zeros(0, np.int64)

    def asked(self) -> list[tuple]:
        at, out = self.block.spans(self.bucket), []
        level = np.clip(np.round(-2048 * self.parent), 0, 65535).astype(np.uint16)
        sizes = np.diff(np.append(self.starts, len(self.bucket))).astype(np.uint64)
        spans = np.searchsorted(self.starts, at)
        step = _steps(self.symbol)
        step[self.starts] = self.symbol[self.starts]
        for k in np.flatnonzero(np.diff(at)).tolist():
            lo, hi = at[k], at[k + 1]
            s, n = self.starts[spans[k] : spans[k + 1]], self.count[lo:hi]
            # grams of held-out texts only need no level: n log n of nothing is nothing
            out.append((self.block.key, k, *_squeezed(_steps(self.number[s]), sizes[spans[k] : spans[k + 1]] * np.uint64(2) + self.dealt[s], step[lo:hi], level[lo:hi][n > 0], n)))
        return out


def _sum_words(table: pa.Table) -> pa.Table:
    """A bucket's answers to each block: the words' counts and places by falling frequency; block -1 carries the number of tokens and of known words."""
    parts = [_spread(p, n) for p, n in zip(table.column("payload").to_pylist(), table.column("lengths").to_pylist(), strict=True)]
    words, at = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
    place = np.empty(len(words), np.uint64)
    place[np.argsort(-total, kind="stable")] = np.arange(len(words), dtype=np.uint64)
    ends = np.cumsum([len(p[0]) for p in parts])
    bucket = table.column("bucket")[0].as_py()
    rows = [(b, bucket, *_squeezed(total[at[e - len(p[0]) : e]], place[at[e - len(p[0]) : e]])) for b, p, e in zip(table.column("block").to_pylist(), parts, ends.tolist(), strict=True)]
    return pa.Table.from_batches([_batch([*rows, (-1, bucket, b"", [int(total.sum()), int((total > 0).sum())])])])


def _sum_grams(least_gain: float, least_count: int | None):
    """A bucket's answers to each block: d of each context it asked for (0: no node), each gram's count (0 where it is of no use), and the places of those seen least_count times among all such grams (None: nobody asks on); block -1 carries its part of dealt contexts."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_spread(p, n) for p, n in zip(table.column("payload").to_pylist(), table.column("lengths").to_pylist(), strict=True)]
        join = lambda k: np.concatenate([p[k] for p in parts])
        contexts, at, c = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_index=True, return_inverse=True)
        sizes = join(1)
        dealt, sizes = sizes[at] % np.uint64(2) > 0, (sizes // np.uint64(2)).astype(np.int64)
        owner = np.repeat(c, sizes)
        symbol, begin = np.cumsum(join(2)), np.cumsum(sizes) - sizes
        # sums run on from one context to the next and around 2**64
        symbol -= np.repeat(np.where(begin > 0, symbol[begin - 1], np.uint64(0)), sizes)
        _, first, gram = np.unique((owner.astype(np.uint64) << np.uint64(40)) | symbol, return_index=True, return_inverse=True)
        count = join(4)
        n, level = np.bincount(gram, count), np.zeros(len(first), np.uint16)
        level[gram[count > 0]] = join(3)
        s = owner[first]
        # n can be 0 where only held-out texts have the gram
        different, total = np.bincount(s, n > 0, len(contexts)), np.bincount(s, n, len(contexts))
        parent = np.exp(level / -2048.0)
        # the gain but for what all symbols of a context have in common
        part = np.bincount(s, n * (np.log(np.maximum(n - 1, 0) + PRIOR * parent) - np.log(parent)), len(contexts))
        gain = part - total * np.log(np.maximum(total - 1, 0) + PRIOR)
        d = np.where(dealt, _DEALT, np.where(gain >= least_gain, np.maximum(different, 1), 0)).astype(np.uint32)
        often = n >= least_count if least_count is not None else np.zeros(len(n), bool)
        place = np.cumsum(often, dtype=np.uint64) - np.uint64(1)
        counts, bucket = np.where(often | (d[s] > 0), n, 0).astype(np.int64), table.column("bucket")[0].as_py()
        rows, i, j = [], 0, 0
        for b, p in zip(table.column("block").to_pylist(), parts, strict=True):
            mine = gram[j : j + len(p[2])]
            rows.append((b, bucket, *_squeezed(d[c[i : i + len(p[0])]], counts[mine], _steps(place[mine[often[mine]]]))))
            i, j = i + len(p[0]), j + len(p[2])
        if dealt.any():
            rows.append((-1, bucket, *_pack(contexts[dealt], part[dealt], different[dealt], total[dealt])))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _dealt_parts(batches):
    for b in batches:
        for payload, lengths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            contexts, *sums = _unpack(payload, lengths, np.uint64, np.float64, np.float64, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(contexts.view(np.int64)), *map(pa.array, sums)], ["context", "part", "different", "total"])


def _dealt_contexts(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (sorted) and d of the contexts that were dealt over buckets."""
    where, path = fs.FileSystem.from_uri(folder)
    parts = []
    for info in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                parts.append(pq.ParquetFile(f).read(["context", "d"]))
    t = pa.concat_tables(parts) if parts else pa.table({"context": pa.array([], pa.int64()), "d": pa.array([], pa.int64())})
    numbers, d = t.column("context").to_numpy().view(np.uint64), t.column("d").to_numpy()
    order = np.argsort(numbers)
    return numbers[order], d[order]


def _answers(folder: str, block: int) -> tuple[list[list[np.ndarray]], list[int]]:
    """A block's answers and their buckets, in the order of these."""
    where, path = fs.FileSystem.from_uri(folder)
    rows = []
    for info in where.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True)):
        if info.is_file and info.base_name.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                rows += pq.ParquetFile(f).read(["bucket", "payload", "lengths"]).to_pylist()
    rows.sort(key=lambda r: r["bucket"])
    return [_spread(r["payload"], r["lengths"]) for r in rows], [r["bucket"] for r in rows]


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([a.astype(kind, copy=False) for a in arrays]) if arrays else np.zeros(0, kind)


@dataclass
class Totals:
    tokens: int = 0
    known: int = 0

    def root(self, c: np.ndarray) -> np.ndarray:
        return np.log((c + 0.5) / (self.tokens + 0.5 * (self.known + 1)))


@dataclass
class Walk:
    """What a block knows after the answers so far: ln P of each token, the depth of its state, and the grams of the last order."""

    block: Block
    totals: Totals
    least_count: int

    def _numbers(self, places: list[np.ndarray], buckets: list[int]) -> np.ndarray:
        """What buckets number from 0 each, as numbers that no other bucket gives."""
        return _joined([p * np.uint64(self.block.buckets) + np.uint64(k) for p, k in zip(places, buckets, strict=True)], np.uint64)

    def words(self, answer: str) -> None:
        parts, buckets = _answers(answer, self.block.key)
        self.c = _joined([p[0] for p in parts], np.int64)
        self.p = self.totals.root(self.c)[self.block.ranks]
        self.depth = np.zeros(len(self.p), np.uint8)
        place = self._next(self.c, self._numbers([p[1] for p in parts], buckets))
        self.symbol, self.symbols = place[self.block.ranks], self.numbers
        self.context = self.symbol

    def _next(self, seen: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Takes what has these counts and numbers as the next order's contexts; returns the place of each."""
        order = np.argsort(numbers)
        self.numbers, self.seen = numbers[order], seen[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return place

    def grams(self) -> Grams:
        """Those of the next order: a context ends right before each position, in the same text."""
        inner = np.ones(len(self.p), bool)
        inner[self.block.offsets[:-1][np.diff(self.block.offsets) > 0]] = False
        at = np.flatnonzero(inner)
        at = at[self.context[at - 1] >= 0]
        context = self.context[at - 1]
        often = self.seen[context] >= self.least_count
        at, context = at[often], context[often]
        return Grams(self.block, at, context, self.numbers, self.seen, self.totals.tokens / (4 * self.block.buckets), self.p[at], self.symbol, self.symbols)

    def take(self, grams: Grams, answer: str, dealt: str) -> None:
        """Moves tokens whose context is a node from their parent's prediction to the node's, and goes on to the next order."""
        parts, buckets = _answers(answer, self.block.key)
        d_of, n = _joined([p[0] for p in parts], np.int64), _joined([p[1] for p in parts], np.int64)
        large, d_large = _dealt_contexts(dealt)
        ask = np.flatnonzero(d_of == _DEALT)
        if len(ask):
            d_of[ask] = d_large[np.searchsorted(large, grams.number[grams.starts[ask]])]
        d = np.repeat(d_of, np.diff(np.append(grams.starts, len(grams.bucket))))
        at = np.flatnonzero(grams.where >= 0)
        g = grams.where[at]
        node = d[g] > 0
        at, g = at[node], g[node]
        self.p[at] = np.log((n[g] + d[g] * np.exp(self.p[at])) / (grams.total[g] + d[g]))
        self.depth[at] += 1
        # only grams that were seen often are contexts, and have numbers
        often = np.flatnonzero(n >= self.least_count)
        numbers = self._numbers([np.cumsum(p[2]) for p in parts], buckets)
        place = np.full(len(n) + 1, -1, np.int32)
        if len(numbers):
            place[often] = self._next(n[often], numbers)
        self.context = place[grams.where]


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", max_depth: int = 3, least_count: int = 8, least_gain: float = 2.0, block_tokens: int = 1_500_000, files: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and mean_depth (of the states used) for every row.

    files: docs is a plain read of files, whose splits then name the blocks; otherwise docs is first written to the shared folder.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    if not files:
        rows = written(rows, "texts")
    # about six bytes a word; only the size of tasks hangs on it
    buckets = int((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (6 * block_tokens)) + 1
    # the file and the place in it where the split begins
    rows = rows.select("*", F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("split"))
    folder = shared_dir(spark)

    def encode(batches):
        at, part, size, ids, held, hashes = None, 0, 0, [], [], []

        def flush():
            nonlocal part, size, ids, held, hashes
            key_of = int(mix(np.array([np.int64(at).view(np.uint64) + np.uint64(part)], np.uint64))[0] >> np.uint64(2))
            block, words = Block.of(key_of, buckets, ids, held, hashes)
            part, size, ids, held, hashes = part + 1, 0, [], [], []
            return _batch([block.state(), _words_of(block, words)])

        for b in batches:
            key_col, split, out = b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(2).to_pylist()
            for first, h, off in word_hashes(b.column(1).cast(pa.binary()).to_pylist()):
                for i in range(len(off) - 1):
                    r = first + i
                    if ids and (split[r] != at or size >= block_tokens):
                        yield flush()
                    if split[r] != at:
                        at, part = split[r], 0
                    ids.append(key_col[r])
                    held.append(bool(out[r]))
                    hashes.append(h[off[i] : off[i + 1]])
                    size += int(off[i + 1] - off[i])
        if ids:
            yield flush()

    def stored(df: DataFrame, name: str, *by: str) -> str:
        with without_leftovers(spark):
            df.write.partitionBy(*by).option("compression", "zstd").parquet(f"{folder}/{name}")
        return f"{folder}/{name}"

    def answered(df: DataFrame, name: str) -> str:
        # one file for each block, found by its name
        with without_leftovers(spark):
            df.repartition("block").write.partitionBy("block").option("compression", "zstd").parquet(f"{folder}/{name}")
        return f"{folder}/{name}"

    encoded = stored(rows.mapInArrow(encode, REQUEST), "blocks", "bucket")
    held_as = lambda kind: spark.read.schema("block long, payload binary, lengths array<long>").parquet(f"{encoded}/bucket={kind}")
    # without rows there are no such folders
    some = spark.read.schema(REQUEST).parquet(encoded).head(1)
    blocks, asked = (held_as(STATE), held_as(WORDS)) if some else [spark.createDataFrame([], "block long, payload binary, lengths array<long>")] * 2

    def ask_words(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield _batch(_words_asked(b.column(0)[i].as_py(), buckets, b.column(1)[i].as_py(), b.column(2)[i].as_py()))

    a0 = answered(asked.mapInArrow(ask_words, REQUEST).groupBy("bucket").applyInArrow(_sum_words, REQUEST), "word_counts")
    sums = spark.read.schema(REQUEST).parquet(f"{a0}/block=-1").agg(F.sum(F.element_at("lengths", 1)), F.sum(F.element_at("lengths", 2))).first() if some else (0, 0)
    delete(spark, f"{encoded}/bucket={WORDS}")
    totals = Totals(int(sums[0] or 0), int(sums[1] or 0))
    known: list[tuple[str, str]] = []

    def each(batches, answers):
        for b in batches:
            for i in range(b.num_rows):
                w = Walk(Block.back(b.column(0)[i].as_py(), buckets, b.column(1)[i].as_py(), b.column(2)[i].as_py()), totals, least_count)
                w.words(a0)
                for answer, dealt in answers:
                    w.take(w.grams(), answer, dealt)
                yield w

    def asking(answers):
        def ask(batches):
            for w in each(batches, answers):
                asked = w.grams().asked()
                if asked:
                    yield _batch(asked)

        return ask

    for k in range(1, max_depth + 1):
        summed = _sum_grams(least_gain, least_count if k < max_depth else None)
        answer = answered(blocks.mapInArrow(asking(tuple(known)), REQUEST).groupBy("bucket").applyInArrow(summed, REQUEST), f"counts_{k}")
        parts = spark.read.schema(REQUEST).parquet(answer).where("block = -1").select("payload", "lengths")
        large = parts.mapInArrow(_dealt_parts, "context long, part double, different double, total double").groupBy("context").agg(F.sum("part").alias("part"), F.sum("different").cast("long").alias("d"), F.sum("total").alias("total"))
        gain = F.col("part") - F.col("total") * F.log(F.greatest(F.col("total") - 1, F.lit(0.0)) + PRIOR)
        node = F.when(gain >= least_gain, F.greatest("d", F.lit(1))).otherwise(0)
        known.append((answer, stored(large.select("context", node.alias("d")).coalesce(1), f"dealt_{k}")))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_depth"]

    def finish(batches):
        for w in each(batches, tuple(known)):
            block, lo = w.block, w.block.offsets[:-1]
            n = np.diff(block.offsets)
            sums = lambda x: np.add.reduceat(x, lo) if len(lo) else x
            seen = sums((w.c[block.ranks] > 0).astype(np.int64))
            cols = [pa.array(block.ids.tolist(), pa.int64()), pa.array(block.held), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(np.full(len(n), totals.tokens), pa.int64())]
            cols += [pa.array(sums(x) / np.log(10), pa.float64()) for x in (totals.root(w.c)[block.ranks], w.p)] + [pa.array(sums(w.depth.astype(np.float64)) / n, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return blocks.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_depth double")
