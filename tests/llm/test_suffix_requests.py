"""What the suffix tree's blocks and buckets send each other is small, and comes back as it was."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from calltrail.llm import suffixtree as tree


def test_squeezed_arrays_come_back():
    rng = np.random.default_rng(1)
    arrays = [np.zeros(0, np.uint32), np.zeros(5, np.int64), np.array([2**64 - 1, 0, 1], np.uint64), rng.zipf(1.5, 5000).clip(1, 2**40).astype(np.uint64), np.array([0, 255, 256, 65535], np.uint16)]
    back = tree._spread(*tree._squeezed(*arrays))
    assert [a.tolist() for a in back] == [a.tolist() for a in arrays]


def _block(seed, buckets=3):
    """Texts of 40,000 words by a falling frequency, each fifth one held out."""
    rng = np.random.default_rng(seed)
    names = tree.mix(np.arange(1, 3001, dtype=np.uint64))
    texts = [names[np.minimum(rng.zipf(1.3, 200) - 1, 2999)] for _ in range(200)]
    return tree.Block.of(seed, buckets, [None if i == 7 else i for i in range(200)], [i % 5 == 0 for i in range(200)], texts)


def test_a_block_comes_back_without_its_words():
    block, words = _block(1)
    back = tree.Block.back(1, 3, *block.state()[2:])
    assert (back.ranks == block.ranks).all() and back.n_words == len(words) and (back.offsets == block.offsets).all() and back.ids.tolist() == block.ids.tolist() and (back.held == block.held).all()
    assert len(block.state()[2]) < 8 * len(words) + 4 * len(block.ranks) + 3400


def _answer(folder, asked, sums):
    """What buckets say to requests, in the form that blocks read."""
    for k in {r[1] for r in asked}:
        t = sums(pa.Table.from_batches([tree._batch([r for r in asked if r[1] == k])]))
        for r in t.to_pylist():
            (to := folder / f"block={r['block']}").mkdir(parents=True, exist_ok=True)
            pq.write_table(pa.Table.from_pylist([r]), to / f"{k}.parquet")
    return folder.as_uri()


def test_requests_for_grams_take_few_bytes_and_are_answered_right(tmp_path):
    made = [_block(seed) for seed in (1, 2)]
    asked = [r for b, w in made for r in tree._words_asked(b.key, 3, *tree._words_of(b, w)[2:])]
    a0 = _answer(tmp_path / "words", asked, tree._sum_words)
    tokens = sum(int(b.trained.sum()) for b, _ in made)
    walks = [tree.Walk(b, tree.Totals(tokens, 3000), 8) for b, _ in made]
    for w in walks:
        w.words(a0)
    # both blocks call the same word by the same number
    named = [dict(zip(words.tolist(), w.symbols[w.symbol[np.unique(b.ranks, return_index=True)[1]]].tolist(), strict=True)) for (b, words), w in zip(made, walks, strict=True)]
    assert all(named[0][x] == named[1][x] for x in named[0].keys() & named[1].keys()) and len(set(named[0].values())) == len(named[0])
    grams = [w.grams() for w in walks]
    asked = [r for g in grams for r in g.asked()]
    # 16 bytes and more when each gram had a hash of its symbol, a level and a count, and each context a hash and a size
    assert sum(len(r[2]) for r in asked) < 6 * sum(len(g.count) for g in grams)
    a1 = _answer(tmp_path / "counts", asked, tree._sum_grams(2.0, 8))
    want = {}
    for g in grams:
        for key, n in zip(zip(g.number.tolist(), g.symbol.tolist(), strict=True), g.count.tolist(), strict=True):
            want[key] = want.get(key, 0) + n
    for g, w in zip(grams, walks, strict=True):
        parts, _ = tree._answers(a1, w.block.key)
        d, n = np.repeat(np.concatenate([p[0] for p in parts]), np.diff(np.append(g.starts, len(g.count)))), np.concatenate([p[1] for p in parts])
        whole = np.array([want[key] for key in zip(g.number.tolist(), g.symbol.tolist(), strict=True)])
        used = (d > 0) | (whole >= 8)
        assert (n[used] == whole[used]).all() and not n[~used].any() and used.any() and sum(len(p[2]) for p in parts) == (whole >= 8).sum()


def test_words_of_blocks_go_once_they_are_answered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "shared_dir", lambda spark: tmp_path.as_uri())
    docs = spark.createDataFrame([(i, f"a b c d{i % 3}") for i in range(50)], "doc_id long, text string")
    assert tree.score_texts(docs, F.lit(False)).count() == 50
    assert [p.name for p in tmp_path.glob("blocks/bucket=*")] == ["bucket=-1"]
