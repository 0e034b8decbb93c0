"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

Benchmark items and documents are cut into passages of ``2 * half`` words, a half passage apart. Features are the items' words
(others cannot add to a product with an item), weighted by tf-idf with document frequencies over all documents; no word weighs
nothing, for a word may be common because the leaked document is. A randomised SVD finds the latent space: every document passage and every
item passage is a row of A, items scaled up to the same total weight as the corpus; tasks compute their part of A'(A G) for a random
matrix G, the parts are summed by Spark, and the leading left singular vectors of the sum (words x rank, at the driver) span the
space. Each document passage with a latent cosine of ``least_cosine`` or more to an item passage is a candidate, and so, whatever
the weights, is each place where a document and an item have ``RUN`` words in a row in common (found exactly, by hash).

A candidate's neighbourhood is compared with the whole item: lcs is the share of the item's words in the longest common subsequence,
answer the share of the item's ``answer_words`` rarest words that occur there. It is a leak when lcs >= ``exact``, or lcs >=
``paraphrase`` and answer >= ``least_answer``. Where RUN words in a row are shared, each of the item's passages of ``2 * half`` words around
them (a quarter of half apart) is compared with the neighbourhood too, so that a part of a long item is found: with an lcs of a passage >= ``exact`` it
is a leak named excerpt. Its lcs and answer are those of the whole item.

Items are handled in blocks of ``block_items``, each searched against all documents, so what is sent to the tasks is bounded.
Items of fewer than RUN words are leaks where all their words stand in a row; fewer than ``min_words`` are no evidence and are left out. Whatever a candidate's
words, it is refused before its longest common subsequence is worked out only where the item's words that occur in the neighbourhood at all are too few.

Null or empty texts and items leak nothing. A very long text is read whole, its passages in steps. Repeated rows
give their own results; a repeated item is reported under each id. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.llm.shared import slices, written
from calltrail.llm.text import mix, word_hashes

#: Words in a row that make a candidate without a cosine.
RUN = 8
SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answer double, leak string"


def lcs_length(words: np.ndarray, item: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit of one integer for each of the item's words."""
    where: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for x in words.tolist():
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _runs(h: np.ndarray, at: np.ndarray, length: int = RUN) -> np.ndarray:
    """Hashes of the words, as many as length, that begin at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out = mix(out + h[at + k])
    return out


class Items:
    """One block of items: words, vocabulary, and (once fitted) weights, space and passage vectors."""

    def __init__(self, rows: list[tuple[int, str]], half: int, min_words: int):
        self.half = half
        kept = []
        for first, h, off in word_hashes([t.encode() for _, t in rows]):
            kept += [(rows[first + i][0], h[off[i] : off[i + 1]]) for i in range(len(off) - 1) if off[i + 1] - off[i] >= min_words]
        self.ids = [k for k, _ in kept]
        self.words = [w for _, w in kept]
        self.vocab = np.unique(np.concatenate(self.words)) if kept else np.zeros(0, np.uint64)
        self.idf = np.ones(len(self.vocab), np.float32)
        at = [np.arange(max(0, len(w) - RUN + 1)) for w in self.words]
        runs = np.concatenate([_runs(w, a) for w, a in zip(self.words, at, strict=True)]) if kept else np.zeros(0, np.uint64)
        order = np.argsort(runs, kind="stable")
        self.run_item = np.repeat(np.arange(len(at)), [len(a) for a in at])[order]
        self.run_place = np.concatenate(at)[order] if kept else np.zeros(0, np.int64)
        self.runs, first = np.unique(runs[order], return_index=True)
        self.run_first = np.append(first, len(runs))
        self.short: dict[int, dict[int, list[int]]] = {}  # by length, then by the hash of all words
        for k, w in enumerate(self.words):
            if len(w) < RUN:
                self.short.setdefault(len(w), {}).setdefault(int(_runs(w, np.zeros(1, np.int64), len(w))[0]), []).append(k)

    def term(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary, and whether the word is there."""
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return at, self.vocab[at] == h

    def cut(self, h: np.ndarray, off: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Term and piece of each weighted word, and the text and the first word of each piece of step words."""
        n = np.diff(off)
        pieces = np.maximum(1, -(-n // step))
        base = np.concatenate([[0], np.cumsum(pieces)])
        owner = np.repeat(np.arange(len(n)), pieces)
        begin = (np.arange(base[-1]) - base[owner]) * step
        at, known = self.term(h)
        where = np.flatnonzero(known)
        text = np.searchsorted(off, where, side="right") - 1
        piece = base[text] + (where - off[text]) // step
        return at[where], piece, owner, begin

    def shared_runs(self, h: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, place in it, item, place in it) where a run of RUN or more words in common begins."""
        unknown, out = np.concatenate([[0], np.cumsum(~self.term(h)[1])]), []
        for n, items in self.short.items():
            p = np.flatnonzero(unknown[n:] == unknown[:-n]) if len(h) >= n else np.zeros(0, np.int64)
            p = p[np.searchsorted(off, p, side="right") == np.searchsorted(off, p + n - 1, side="right")]
            run = _runs(h, p, n)
            hit = np.isin(run, np.array(list(items), np.uint64))
            for x, r in zip(p[hit].tolist(), run[hit].tolist(), strict=True):
                t = int(np.searchsorted(off, x, side="right")) - 1
                out += [(t, x - int(off[t]), k, 0) for k in items[r]]
        if not len(self.runs) or len(h) < RUN:
            return out
        p = np.flatnonzero(unknown[RUN:] == unknown[:-RUN])
        p = p[np.searchsorted(off, p, side="right") == np.searchsorted(off, p + RUN - 1, side="right")]
        run = _runs(h, p)
        g = np.minimum(np.searchsorted(self.runs, run), len(self.runs) - 1)
        hit = self.runs[g] == run
        p, g = p[hit], g[hit]
        for x, t, lo, hi in zip(p.tolist(), (np.searchsorted(off, p, side="right") - 1).tolist(), self.run_first[g].tolist(), self.run_first[g + 1].tolist(), strict=True):
            for k, q in zip(self.run_item[lo:hi].tolist(), self.run_place[lo:hi].tolist(), strict=True):
                if not q or x == off[t] or h[x - 1] != self.words[k][q - 1]:
                    out.append((t, x - int(off[t]), k, q))
        return out

    def vectors(self, h: np.ndarray, off: np.ndarray, cut: tuple | None = None):
        """Latent vectors (length 1) of all overlapping passages, the text of each and its first word."""
        term, piece, owner, begin = cut or self.cut(h, off, self.half)
        halves = _piece_sums(self.space, term, None, piece, len(owner))
        follows = np.concatenate([owner[1:] == owner[:-1], [False]])
        both = halves.copy()
        at = np.flatnonzero(follows)
        both[at] += halves[at + 1]
        alone = follows | np.concatenate([[True], owner[1:] != owner[:-1]])  # a last half is kept only where it is the whole text
        length = np.linalg.norm(both, axis=1)
        keep = np.flatnonzero(alone & (length > 1e-6))
        return both[keep] / length[keep][:, None], owner[keep], begin[keep]


def _sums(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Row sums by a sorted group number."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(group):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def _piece_sums(table: np.ndarray, term: np.ndarray, weight: np.ndarray | None, piece: np.ndarray, n: int) -> np.ndarray:
    """Sums of the table's rows of terms by a sorted piece number: all first words, then all second words, and so on, as pieces are short."""
    out = np.zeros((n, table.shape[1]), np.float32)
    if not len(piece):
        return out
    starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    size = np.diff(np.append(starts, len(piece)))
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    row = (lambda at: table[term[at]]) if weight is None else (lambda at: table[term[at]] * weight[at][:, None])
    total = row(starts)
    for k in range(1, int(size[0])):
        m = np.searchsorted(-size, -k)  # those with more than k words
        total[:m] += row(starts[:m] + k)
    out[piece[starts]] = total
    return out


def _gram(items: Items, h, off, g: np.ndarray) -> np.ndarray:
    """A'(A g) for the passages of some texts, rows of A scaled to length 1."""
    term, piece, owner, _ = items.cut(h, off, 2 * items.half)
    w = items.idf[term]
    length = np.sqrt(np.bincount(piece, w * w, len(owner)))  # repeats within a passage count as they are
    scaled = (w / np.maximum(length[piece], 1e-6)).astype(np.float32)
    y = _piece_sums(g, term, scaled, piece, len(owner))
    order = np.argsort(term, kind="stable")
    return _sums(y[piece[order]] * scaled[order][:, None], term[order], len(items.vocab))


def fit(items: Items, docs: DataFrame, text: str, rank: int, seed: int = 11) -> None:
    """Document frequencies, then the latent space, each by a pass over all documents."""
    m = len(items.vocab)
    texts = docs.select(F.col(text).alias("text"))

    def frequencies(batches):
        df, n = np.zeros(m, np.int64), 0
        for b in slices(batches, 512):
            n += b.num_rows
            for _, h, off in word_hashes(b.column(0).cast(pa.binary()).to_pylist()):
                at, known = items.term(h)
                where = np.flatnonzero(known)
                pair = np.unique((np.searchsorted(off, where, side="right") - 1) * m + at[where])
                df += np.bincount(pair % m, minlength=m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, m), pa.int64()), pa.array(np.concatenate([[n], df]), pa.int64())], ["term", "n"])

    got = dict(texts.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    n = max(1, got.get(-1, 0))
    df = np.array([got.get(i, 0) for i in range(m)])
    items.idf = np.maximum(0.05, np.log((n + 1) / (df + 0.5))).astype(np.float32)
    width = min(m, rank + 8)
    g = np.random.default_rng(seed).standard_normal((m, width)).astype(np.float32)

    def sketch(batches):
        total = np.zeros((m, width), np.float64)
        for b in slices(batches, 512):
            for _, h, off in word_hashes(b.column(0).cast(pa.binary()).to_pylist()):
                total += _gram(items, h, off, g)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m), pa.int32()), *[pa.array(total[:, j].astype(np.float32), pa.float32()) for j in range(width)]], ["term", *[f"c{j}" for j in range(width)]])

    summed = texts.mapInArrow(sketch, "term int, " + ", ".join(f"c{j} float" for j in range(width))).groupBy("term").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)])
    corpus = np.zeros((m, width))
    for r in summed.collect():
        corpus[r[0]] = r[1:]
    h = np.concatenate(items.words)
    off = np.concatenate([[0], np.cumsum([len(w) for w in items.words])])
    own = _gram(items, h, off, g).astype(np.float64)
    b = own + corpus * (np.linalg.norm(own) / max(1e-9, np.linalg.norm(corpus)))
    u, _, _ = np.linalg.svd(b, full_matrices=False)
    items.space = (u[:, :rank] * items.idf[:, None]).astype(np.float32)
    items.passages, items.passage_of = items.vectors(h, off)[:2]


def search(items: Items, docs: DataFrame, key: str, text: str, least_cosine: float, exact: float, paraphrase: float, least_answer: float, answer_words: int) -> DataFrame:
    """Leaks of one block's items in all documents."""
    rare = []
    for w in items.words:
        at, _ = items.term(np.unique(w))
        rare.append(items.vocab[at[np.lexsort((at, -items.idf[at]))[:answer_words]]])
    tokens = [dict(zip(*(x.tolist() for x in np.unique(w, return_counts=True)), strict=True)) for w in items.words]
    rare_words = [r.tolist() for r in rare]
    wide = np.array([-(-len(w) // items.half) for w in items.words])
    # an absent word takes at least one token from the longest common subsequence
    enough = np.array([len(n) - (1 - paraphrase) * len(w) for n, w in zip(tokens, items.words, strict=True)])
    longs = -(-len(items.vocab) // 64)
    of_item = np.zeros((len(items.words), longs), np.uint64)
    for k, n in enumerate(tokens):
        at = items.term(np.array(list(n), np.uint64))[0]
        np.bitwise_or.at(of_item[k], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    def windows(term: np.ndarray, piece: np.ndarray, first: int, n: int, reach: int) -> np.ndarray:
        """Which terms, as bits, occur in the reach pieces from each of n pieces on, beginning with first."""
        bits = np.zeros((n + reach, longs), np.uint64)
        at = slice(*np.searchsorted(piece, [first, first + n + reach]))
        np.bitwise_or.at(bits.reshape(-1), (piece[at] - first) * longs + (term[at] >> 6), np.uint64(1) << (term[at] & 63).astype(np.uint64))
        size = 1
        while size < reach:
            more = min(size, reach - size)
            bits[: len(bits) - more] |= bits[more:]
            size += more
        return bits

    def likely(term, piece, near, k):
        """Which candidates have enough different words of item k in the pieces around piece near: leaks() would refuse the others."""
        keep = np.zeros(len(k), bool)
        for w in np.unique(wide[k]).tolist():
            mine = np.flatnonzero(wide[k] == w)
            first = int(near[mine].min()) - w
            seen = windows(term, piece, first, int(near[mine].max()) - w - first + 1, 2 + 2 * w)
            for lo in range(0, len(mine), 4096):
                c = mine[lo : lo + 4096]
                keep[c] = np.bitwise_count(seen[near[c] - w - first] & of_item[k[c]]).sum(axis=1) >= enough[k[c]]
        return keep

    def excerpt(words: np.ndarray, begin: int, k: int, place: int) -> bool:
        """Whether one of the item's passages around a shared run (at begin, and at place in the item) is in the text."""
        item, size = items.words[k], 2 * items.half
        if len(item) <= size:
            return False  # it is its only passage
        near = words[max(0, begin - size) : begin + RUN + size]
        known = np.isin(item[max(0, place - 2 * size) : place + 2 * size], near)
        for at in sorted({min(max(0, place - i), len(item) - size) for i in range(0, size - RUN + 1, max(1, items.half // 4))}, reverse=True):
            lo = at - max(0, place - 2 * size)
            if known[lo : lo + size].sum() >= exact * size and lcs_length(near, item[at : at + size]) >= exact * size:
                return True
        return False

    def leaks(words: np.ndarray, begin: int, end: int, k: int, least: bool = True):
        item, n = items.words[k], tokens[k]
        near = words[max(0, begin - len(item)) : end + len(item)]
        there = set(near.tolist())
        if least and sum(c for x, c in n.items() if x in there) < paraphrase * len(item):
            return None  # the longest common subsequence can't be longer than that
        share = lcs_length(near, item) / len(item)
        return share, sum(x in there for x in rare_words[k]) / max(1, len(rare_words[k]))

    def run(batches):
        for b in slices(batches, 512):
            ids, out = b.column(0).to_pylist(), []
            for first, h, off in word_hashes(b.column(1).cast(pa.binary()).to_pylist()):
                cut = items.cut(h, off, items.half)
                vectors, owner, begin = items.vectors(h, off, cut)
                pieces = np.searchsorted(cut[2], np.arange(len(off)))  # the first piece of each text
                found: dict[tuple[int, int], tuple] = {}

                def note(t, k, begin, end, cosine, place=None):
                    if place is None and len(items.words[k]) < RUN:
                        return  # only a run is evidence
                    words = h[off[t] : off[t + 1]]  # noqa: B023
                    got = leaks(words, begin, end, k)
                    kind = "" if not got else "exact" if got[0] >= exact else "paraphrase" if got[0] >= paraphrase and got[1] >= least_answer else ""
                    if not kind and place is not None and excerpt(words, begin, k, place):
                        got, kind = leaks(words, begin, end, k, least=False), "excerpt"
                    if kind:
                        found[t, k] = max(found.get((t, k), (False, 0, 0, -1, "")), (kind != "excerpt", got[0], got[1], cosine, kind))  # noqa: B023

                step = max(256, min(4096, (1 << 24) // len(items.vocab)))
                for lo in range(0, len(vectors), step):
                    part = np.arange(lo, min(lo + step, len(vectors)))
                    cosines = vectors[part] @ items.passages.T
                    i, j = np.nonzero(cosines >= least_cosine)
                    if not len(i):
                        continue
                    cosine, p, k = cosines[i, j], part[i], items.passage_of[j]
                    order = np.lexsort((-cosine, k, p))
                    best = order[np.concatenate([[True], (np.diff(p[order]) != 0) | (np.diff(k[order]) != 0)])]
                    cosine, p, k = cosine[best], p[best], k[best]
                    piece, t = pieces[owner[p]] + begin[p] // items.half, owner[p]
                    keep = likely(cut[0], cut[1], piece, k)
                    for c, x, y in zip(cosine[keep].tolist(), p[keep].tolist(), k[keep].tolist(), strict=True):
                        note(int(owner[x]), y, int(begin[x]), int(begin[x]) + 2 * items.half, c)
                for t, at, k, place in items.shared_runs(h, off):
                    lo, hi = np.searchsorted(owner, [t, t + 1])
                    over = lo + np.flatnonzero((begin[lo:hi] <= at) & (at < begin[lo:hi] + 2 * items.half))
                    cosines = vectors[over] @ items.passages[items.passage_of == k].T
                    note(t, k, at, at + RUN, float(cosines.max(initial=0)), place)
                out += [(ids[first + t], items.ids[k], c, s, a, kind) for (t, k), (_, s, a, c, kind) in sorted(found.items())]
            if out:
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "item_id", "cosine", "lcs", "answer", "leak"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", half: int = 16, rank: int = 64,
    least_cosine: float = 0.5, exact: float = 0.8, paraphrase: float = 0.5, least_answer: float = 0.5, answer_words: int = 8, min_words: int = 3, block_items: int = 2000,
) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, leak (exact, paraphrase or excerpt) for every pair found."""
    numbered = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    n = numbered.count()
    blocks = max(1, math.ceil(n / block_items))
    if blocks > 1:  # parts by hash are even enough
        numbered = written(numbered.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) + 1), "items")
    out = None
    for k in range(1, blocks + 1):
        rows = numbered.where(F.col("part") == k).select("item_id", "text") if blocks > 1 else numbered
        items = Items([tuple(r) for r in rows.orderBy("item_id").collect()], half, min_words)
        if not len(items.vocab):
            continue
        fit(items, docs, text, rank)
        found = search(items, docs, key, text, least_cosine, exact, paraphrase, least_answer, answer_words)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out
