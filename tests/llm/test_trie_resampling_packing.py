"""Prefix trie, importance resampling and packing against brute force, SQL and the tokenizer itself, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import SF, assert_same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from calltrail.llm import importance, packing, prefixtrie, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance_resampling"])
def test_query_agrees_with_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def brute_trie(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, ends, size = defaultdict(set), defaultdict(list), {(): 0}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            size[tuple(turns[:d])] = len(turns[d - 1][1].encode()) if d else 0
        ends[tuple(turns)].append(c)
    below = {n: [m for m in members if m[: len(n)] == n] for n in members}
    kids = {n: [m for m in below[n] if len(m) == len(n) + 1] for n in members}
    return sorted(
        (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), sum(not kids[m] for m in below[n]), sum((len(members[m]) - 1) * size[m] for m in below[n]), hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n in members
    )


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out[c].append((role or "", text or ""))
    return out


def conversations():
    rows = [(c, t, ("user", "assistant")[t % 2], ["hi", "héllo", "bye", ""][(c * 7 + t * t) % 4 if t > 1 else c % 2]) for c in range(60) for t in range(c % 6)]
    rows += [(c, t, "user", "same") for c in range(100, 20_000, 97) for t in (1, 2)]  # a hot conversation, its ids far apart
    rows += [(-7, t, "user", f"turn {t}") for t in range(300)]  # a long one
    return rows + [(7, None, None, None), (7, None, None, None), (7, 3, "user", "again"), (7, 3, "user", "again"), (None, 1, "user", "nobody's"), (8, 0, "user", "x" * 200_000), (9, -2, None, "hi")]


def test_trie_against_brute_force(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("depth", "owner", "pos", "a", "p", "n_turns")})
    steps, ids = prefixtrie.steps_of(prefixtrie.hashed(prefixtrie.numbered(turns, hot_rows=20)))
    got = sorted(tuple(r) for r in prefixtrie.prefix_trie(steps, ids, hot_rows=20).collect())
    assert got == brute_trie(ordered(rows))
    shown = prefixtrie.with_turns(prefixtrie.trie(turns), turns)
    assert shown.where("depth = 0").select("text").first()[0] is None and shown.where("depth = 1 AND conv_id = 100").select("role", "text").first() == ("user", "same")


def test_rebuilt_conversations_against_brute_force(spark):
    rows = [r for r in conversations() if r[0] not in (5, 10, 15)]  # some groups lack their first conversation
    own = ordered(rows)
    convs = {}
    for c in own:
        h, first = zlib.crc32(str(c).encode()) % 9, own.get(c - int(math.fmod(c, 5)), [])
        convs[c] = first[:h] + own[c][h:]
    assert any(not t for t in convs.values())  # turnless
    turns = prefixtrie.hashed(prefixtrie.numbered(spark.createDataFrame(rows, TURNS)))
    got = prefixtrie.prefix_trie(*prefixtrie.rebuilt(turns, 5, F.crc32(F.col("conv_id").cast("string")) % 9, 8))
    assert sorted(tuple(r) for r in got.collect()) == brute_trie(convs)


def test_trie_of_no_conversation(spark):
    assert prefixtrie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixtrie.trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


RUN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_resample(docs, target, orders, buckets, percent, least):
    def grams(text):
        w = RUN.findall((text or "").translate(LOWER))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t)[1])
    t = Counter(bucket(g) for x in target for g in grams(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (nt * 0 + ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, gs = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in gs)
        rows.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


DOCS = [(i, f"{'Ab' * (i % 3)} the cat-{i % 7} SAT_on É{i % 5} mat; " * (i % 4)) for i in range(120)]
DOCS += [(5, DOCS[5][1]), (500, None), (501, ""), (502, " -- "), (None, "one two three four five"), (503, "mot " * 50_000), (504, "x y Zİ \U0001f600 é")]


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling_against_brute_force(spark, orders):
    target = [("the cat sat on a mat",), (None,), ("É3 mat",)]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "pos", "gram", "bucket", "gain", "rank", "score", "weight")})
    aim = spark.createDataFrame(target, "text string")
    got = importance.resample(docs, aim, orders=orders, buckets=50, percent=30, min_words=5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(DOCS, [t for t, in target], orders, 50, 30, 5)
    assert importance.drawn(docs, got).columns == docs.columns
    assert importance.resample(docs.where("false"), aim).count() == 0
    assert importance.resample(docs, aim.where("false")).where("rank IS NOT NULL").count() > 0


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_packed_pieces_are_the_tokenizers_ids(spark):
    plain = Tokenizer.from_file(WORDS)
    got = queries.op13_best_fit_packing(spark, SF).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*plain.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        want = [(k, k * 4096, len(ids[k * 4096 :][:4096]), zlib.crc32(np.array(ids[k * 4096 :][:4096], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[d["doc_id"]]) == want
    assert check_packed(got, 4096) <= math.ceil(packing.plan(Counter(r["length"] for r in got), 4096)[1]) + 1


def fewest(pieces, capacity):
    """By trying all ways."""
    best = len(pieces)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= pieces[k]}.values():
            go(k + 1, [*rooms[:i], rooms[i] - pieces[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - pieces[k]])

    go(0, [])
    return best


def test_plans_hold_all_pieces_in_few_sequences():
    rng = np.random.default_rng(5)
    for k in range(25):
        capacity = int(rng.integers(8, 40))
        pieces = sorted(rng.integers(1, capacity + 1, 9).tolist(), reverse=True)
        patterns, bound = packing.plan(Counter(pieces), capacity)
        held = Counter()
        for items, n in patterns:
            assert sum(x * m for x, m in items) <= capacity
            held.update({x: 0 for x, _ in items})
            for x, m in items:
                held[x] += m * n
        assert held == Counter(pieces)
        n = sum(m for _, m in patterns)
        assert bound <= n + 1e-6 and n == fewest(pieces, capacity), (k, pieces, capacity)
    # 7 = 4 + 3 fills sequences where the longest first would not: 5,000 of each of 2, 3, 4, 5 in sequences of 7
    patterns, bound = packing.plan({2: 5000, 3: 5000, 4: 5000, 5: 5000}, 7)
    assert sum(n for _, n in patterns) == math.ceil(bound) == 10_000
    # best fit alone needs 10,500
    histogram = {44: 3000, 24: 6000, 22: 3000, 21: 3000, 17: 6000, 8: 6000, 6: 6000}
    patterns, bound = packing.plan(histogram, 60)
    assert sum(n for _, n in patterns) <= min(1.01 * bound, 0.96 * sum(n for _, n in packing.best_fit(dict(histogram), [], 60)))


def test_packing_odd_rows(spark):
    rows = [(1, "un deux"), (1, "un deux"), (None, "x"), (2, None), (3, ""), (4, " \t\n"), (5, "Wort " * 30_000), (6, "z" * 5000), (8, "A<|EndOfText|>b <|ENDOFTEXT|> CATS'S He'LL."), (7, "it's <|endoftext|> \U0001f600 é.́ 0 10. a0. X!!!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("piece", "ids", "offset", "length")})
    plain = Tokenizer.from_file(WORDS)
    packed = packing.pack_documents(docs, WORDS, capacity=64, by_words=True, with_ids=True)
    got = packed.collect()
    check_packed(got, 64)
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: r["piece"]):
        whole[r["doc_id"]].append(bytes(r["ids"]))
    for i, text in dict(rows).items():
        n = sum(a == i for a, _ in rows)
        assert Counter(b"".join(whole[i])) == Counter(np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1] * n, "<u4").tobytes())
    slow = packing.pack_documents(docs, WORDS, capacity=64)
    assert sorted(map(tuple, slow.select("piece", "start", "length", "ids_crc32").collect())) == sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == sum(len(r["ids"]) for r in got)
    assert packing.pack_documents(docs.where("false"), WORDS).count() == 0


def test_a_length_of_a_third_of_all_pieces(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b c").otherwise(F.repeat(F.lit("w "), (F.col("id") % 200).cast("int"))).alias("text"))
    found = packing.written(packing.pieces(docs, WORDS, capacity=256, by_words=True))
    assert check_packed(packing.pack(found, 256, hot_rows=100).collect(), 256) <= math.ceil(found.agg(F.sum("length")).first()[0] / 256) + 1
