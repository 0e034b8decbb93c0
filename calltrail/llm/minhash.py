"""Near-duplicate groups by b-bit MinHash: bands give candidates, packed low bits an estimate, full sets the proof.

A document's set is its distinct shingles of ``width`` lower-cased words (the whole sequence where there are fewer). Documents
with 100 * intersection >= 80 * union are linked, and a component is all that links reach.

Documents with equal sets are one class, and only its smallest id goes on. Each class has ``bands`` x ``rows`` minima. A band's
minima, hashed together, are a bucket; a pair at similarity 0.8 shares none of the buckets with probability (1 - 0.8**5)**32 = 3e-6. The
two low bits of each minimum are packed into longs, which travel with the bucket's rows; with m the share of equal fields, (m - 1/4) / (3/4)
estimates the similarity by counting bits in the join itself, and pairs five standard deviations under 0.8 are never made. All others are proved on whole texts.

Copies never give all their pairs. First the shingles of all candidates are counted: what a set shares with no other candidate can't be in an intersection, so
classes with too few others leave (``settled`` gives the bound, which loses no link). Each bucket's leader is the member with the smallest share of such shingles, the
middle of its group, and every class meets the leaders of its buckets, each pair once: a group of copies makes about as many pairs as it has members. Links found
merge components; buckets that hold one component, and members without a possible partner in another, are done. Only what is then left is compared pair by pair, by the bits of longer
signatures, whose five deviations are a third as wide: a bucket is cut into blocks of ``block`` members, two blocks are a task's work, and a pair is
handed on from its first common band only. The cost of this last step grows with the square of the classes of a bucket that are no link of its leader but may be one of each other; it
has no cap. All pairs handed on are proved.

Null text or text without words: an empty set, linked with nothing. Rows with equal ids are one document whose rows' links all count; each
row is returned. A null id is its own component (null). Extra columns are ignored. No rows, no output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.llm.shared import slices, written
from calltrail.llm.text import mix, word_hashes

BANDS, ROWS, BITS = 32, 5, 2
_FIELDS = 64 // BITS
_LONGS = BANDS * ROWS // _FIELDS
_FINE_LONGS = 32
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, _FINE_LONGS * _FIELDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, _FINE_LONGS * _FIELDS, dtype=np.uint64)
_ONES = 0x5555555555555555
BROADCAST_ROWS = 1_000_000


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    if len(h) == 0:
        return h
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = mix(out + h[i : i + n])
    return out if len(h) >= width else mix(out + np.uint64(len(h)))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, pa.int64())


def _sets(column: pa.Array, width: int):
    """(index of the first text, its distinct shingles and those of the texts after it) for a column of texts, a piece at a time."""
    for first, h, off in word_hashes(column.cast(pa.binary()).to_pylist()):
        yield first, [np.unique(shingles(h[lo:hi], width)) for lo, hi in zip(off[:-1], off[1:], strict=True)]


def _minima(every: np.ndarray, start: np.ndarray, fields: int) -> np.ndarray:
    """The least of each hash function over each set; sets lie one after the other in every, from start on."""
    low = np.empty((len(start), fields), np.uint64)
    for k in range(fields):
        low[:, k] = np.minimum.reduceat(every * _A[k] + _B[k], start)
    return low


def _packed(low: np.ndarray) -> np.ndarray:
    """The minima's low bits, _FIELDS of them in a long."""
    bits = (low >> np.uint64(40)) & np.uint64((1 << BITS) - 1)
    return (bits.reshape(len(low), -1, _FIELDS) << (np.arange(_FIELDS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, d0, d1 (digest of the set), buckets (one hash per band), s0.. (packed low bits)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packs = [f"s{i}" for i in range(_LONGS)]

    def run(batches):
        for b in slices(batches, 512):
            ids, out = b.column(0), []
            for _, sets in _sets(b.column(1), width):
                n = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets)
                full = np.flatnonzero(n)
                start = np.concatenate([[0], np.cumsum(n)])[:-1][full]
                digest, low = np.zeros((len(n), 2), np.uint64), np.full((len(n), BANDS * ROWS), (1 << 64) - 1, np.uint64)
                if len(full):
                    for k, x in enumerate((every, mix(every))):
                        digest[full, k] = np.add.reduceat(mix(x + np.uint64(k)), start)
                    low[full] = _minima(every, start, BANDS * ROWS)
                bucket = np.zeros((len(n), BANDS), np.uint64)
                for r in range(ROWS):
                    bucket = mix(bucket + low[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
                packed = _packed(low)
                out.append((n, digest, bucket, packed))
            if out:
                n, digest, bucket, packed = (np.concatenate(x) for x in zip(*out, strict=True))
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * BANDS + 1, BANDS), pa.int32()), _signed(bucket.ravel()))
                yield pa.RecordBatch.from_arrays([ids, _signed(n), _signed(np.ascontiguousarray(digest[:, 0])), _signed(np.ascontiguousarray(digest[:, 1])), buckets, *[_signed(np.ascontiguousarray(packed[:, i])) for i in range(_LONGS)]], ["doc_id", "n_shingles", "d0", "d1", "buckets", *packs])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, d0 long, d1 long, buckets array<long>, " + ", ".join(f"{p} long" for p in packs))


def estimate(a: str, b: str, longs: int) -> Column:
    """The collision-corrected similarity of two packed signatures, by counting fields whose bits differ."""
    differ = " + ".join(f"bit_count((({a}.s{i} ^ {b}.s{i}) | shiftrightunsigned({a}.s{i} ^ {b}.s{i}, 1)) & {_ONES}L)" for i in range(longs))
    chance = 0.5**BITS
    return F.expr(f"(1 - ({differ}) / {longs * _FIELDS}D - {chance}D) / {1 - chance}D")


def least_estimate(percent: int, longs: int) -> float:
    """Five standard deviations under the threshold."""
    chance = 0.5**BITS
    m = chance + (1 - chance) * percent / 100
    return percent / 100 - 5 * (m * (1 - m) / (longs * _FIELDS)) ** 0.5 / (1 - chance)


def if_small(ids: DataFrame) -> DataFrame:
    """A table of ids with a hint to broadcast it where it was counted to be small; else Spark joins as it sees fit."""
    ids = written(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def proved(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    used = texts.join(if_small(ids), "doc_id", "left_semi")
    both = pairs.join(used.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(used.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets = []
                for name in ("text_a", "text_b"):
                    sets.append([x for _, part in _sets(b.column(name), width) for x in part])
                keep = []
                for x, y in zip(*sets, strict=True):
                    i = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * i >= percent * (len(x) + len(y) - i))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id, comp (the smallest id reachable) for all ids in links (a, b) and in known (id, comp), by spreading and following minima."""
    if known is not None:
        name = lambda c: known.select(F.col("id").alias(c), F.col("comp").alias(f"{c}c"))
        mapped = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b")).where("a <> b").distinct()
    else:
        mapped = links
    edges = written(mapped.select("a", "b").union(mapped.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        spread = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        least = labels.join(spread, "id", "left").select("id", "comp", F.least("comp", F.coalesce("near", "comp")).alias("down"))
        jump = labels.select(F.col("id").alias("down"), F.col("comp").alias("further"))
        now = written(least.join(jump, "down", "left").select("id", F.least("down", F.coalesce("further", "down")).alias("comp"), (F.least("down", F.coalesce("further", "down")) != F.col("comp")).alias("changed")), "labels")
        labels = now.select("id", "comp")
        if now.where("changed").isEmpty():
            break
    if known is None:
        return labels
    root = labels.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    moved = known.join(root, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
    return written(moved.union(labels.join(known.select("id"), "id", "left_anti").select("id", "comp")), "components")


def _own_shingles(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """id, own: how many shingles of a set no other of these sets has."""
    used = texts.join(if_small(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")

    def run(batches):
        for b in slices(batches, 512):
            ids = np.array(b.column(0).to_pylist(), np.int64)
            for first, sets in _sets(b.column(1), width):
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(sets)), _signed(np.repeat(ids[first : first + len(sets)], [len(x) for x in sets]))], ["shingle", "id"])

    found = used.select("doc_id", "text").mapInArrow(run, "shingle long, id long")
    alone = found.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return alone.groupBy("id").agg(F.count("*").alias("own"))


def _finer(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """id, a longer signature (bytes) and the shingles themselves."""
    used = texts.join(if_small(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")

    def run(batches):
        for b in slices(batches, 512):
            for first, sets in _sets(b.column(1), width):
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                every = np.concatenate(sets)
                packed = _packed(_minima(every, ends[:-1].astype(np.int64), _FINE_LONGS * _FIELDS))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), pa.array([x.tobytes() for x in packed], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(every))], ["id", "sig", "shingles"])

    return used.select("doc_id", "text").mapInArrow(run, "id long, sig binary, shingles array<long>").dropDuplicates(["id"])


def _block_pairs(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): likely links between members (bucket, band, id, comp, n, e, buckets, sig) of other components in a bucket, two blocks at a time."""
    size = members.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = members.join(size, "bucket").withColumn("i", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    cells = mine.select("*", other).withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")}).drop("j", "blocks")
    chance, least = 0.5**BITS, least_estimate(percent, _FINE_LONGS)

    def run(t: pa.Table) -> pa.Table:
        band, lo, hi = t.column("band")[0].as_py(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        i, ids, comp, n, e = (t.column(c).to_numpy() for c in ("i", "id", "comp", "n", "e"))
        bands = np.array(t.column("buckets").to_pylist(), np.int64)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(len(ids), _FINE_LONGS)
        left, right = np.flatnonzero(i == lo), np.flatnonzero(i == hi)
        out = []
        for x in left.tolist():
            y = right[(comp[right] != comp[x]) & (ids[right] > ids[x])] if lo == hi else right[comp[right] != comp[x]]
            size = n[y] + n[x]
            y = y[((100 + percent) * np.minimum(e[y], e[x]) >= percent * size) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            differ = sig[y] ^ sig[x]
            differ = np.bitwise_count((differ | (differ >> np.uint64(1))) & np.uint64(_ONES)).sum(axis=1)
            y = y[(1 - differ / (_FINE_LONGS * _FIELDS) - chance) / (1 - chance) >= least]
            y = y[(bands[y] == bands[x]).argmax(axis=1) == band]
            out += [(min(ids[x], k), max(ids[x], k)) for k in ids[y].tolist()]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _proved_sets(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets, here as arrays, have 100 * intersection >= percent * union."""
    side = lambda c: fine.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for p, q in zip(x, y, strict=True):
                p, q = p.values.to_numpy(), q.values.to_numpy()
                i = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * i >= percent * (len(p) + len(q) - i))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def settled(members: DataFrame, percent: int) -> DataFrame:
    """The members (bucket, band, id, comp, n, e, far) that may still link to one of another component in their bucket.

    An intersection is at most e, the shingles shared with any candidate, so a link needs (100 + percent) * e >= percent * (n + the other's n),
    the same the other way round, and a share of percent between the sizes. A bucket's sizes are counted, and each member asks for a size that fits.
    """
    before = None
    while True:
        sizes = members.groupBy("bucket", F.col("n").alias("other")).agg(F.max("e").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        fits = f"(100 + {percent}) * least(e, most) >= {percent} * (n + other) AND 100 * least(n, other) >= {percent} * greatest(n, other) AND (lo <> comp OR hi <> comp)"
        live = written(members.alias("m").join(sizes.alias("s"), (F.col("m.bucket") == F.col("s.bucket")) & F.expr(fits), "left_semi"), "members")
        members, before = live, members.count() if before is None else before
        after = members.count()
        if before == after:
            return members
        before = after


def _renamed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with the components that they are in by now."""
    return members.join(comps.withColumnRenamed("comp", "now"), "id", "left").select("bucket", "id", F.coalesce("now", "comp").alias("comp"), "n", "e", "far", "band")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (it is the smallest of its component) for every row."""
    sigs = written(signatures(docs, key, text, width), "signatures")
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    packed = F.struct(*[f"s{i}" for i in range(_LONGS)])
    # equal sets have equal signatures, so any row of the class has its buckets
    reps = written(full.groupBy("n_shingles", "d0", "d1").agg(F.min_by(F.struct("doc_id", "buckets", packed.alias("sig")), "doc_id").alias("r")).select("n_shingles", "d0", "d1", F.col("r.doc_id").alias("id"), "r.buckets", "r.sig"), "classes")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = reps.select("id", F.posexplode("buckets").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    members = written(rows.join(shared, "bucket"), "members")
    candidates = written(members.select("id").distinct(), "candidates")
    own = F.coalesce("own", F.lit(0))
    # own shingles are what keeps a set from all others: the fewer, the nearer to the middle of its group
    far = own / F.col("n") + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 50))
    sizes = reps.select("id", F.col("n_shingles").alias("n"))
    known = candidates.join(sizes, "id").join(_own_shingles(candidates, texts, width), "id", "left").select("id", F.col("id").alias("comp"), "n", (F.col("n") - own).alias("e"), far.alias("far"))
    members, comps = settled(members.join(known, "id"), percent), reps.select("id", F.col("id").alias("comp"))
    side = lambda c: reps.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    if not members.isEmpty():
        leader = members.groupBy("bucket").agg(F.min_by("id", "far").alias("leader"))
        led = members.join(leader, "bucket")
        pairs = led.where("leader <> id").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
        likely = estimate("sig_a", "sig_b", _LONGS) >= least_estimate(percent, _LONGS)
        likely_pairs = written(pairs.join(side("b"), "b").join(side("a"), "a").where(likely).select("a", "b"), "pairs")
        comps = components(written(proved(likely_pairs, texts, width, percent), "links"))
        members = settled(_renamed(led.where("leader <> id"), comps), percent)
        if not members.isEmpty():
            fine = written(_finer(written(members.select("id").distinct(), "rest"), texts, width), "fine")
            wide = members.join(reps.select("id", "buckets"), "id").join(fine.select("id", "sig"), "id")
            comps = components(written(_proved_sets(written(_block_pairs(wide, percent, block), "pairs"), fine, percent), "links"), comps)
    by_class = reps.join(comps, "id", "left").select("n_shingles", "d0", "d1", F.coalesce("comp", "id").alias("comp"))
    named = sigs.select("doc_id", "n_shingles", "d0", "d1").join(by_class, ["n_shingles", "d0", "d1"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
