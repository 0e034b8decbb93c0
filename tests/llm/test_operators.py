"""The training-data operators against brute force, exact round trips and held-out rows, and on odd tables."""

import hashlib
import re
from collections import Counter
from itertools import combinations
from math import log, log10

import pytest
from oracle import SF
from pyspark.sql import functions as F

from calltrail.llm import chat, cws, decontaminate, langid, minhash, mixing, queries, suffixtree, toxicity, urllists, warc

BIG = "/root/testdata/sf0.01"
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Null, empty and blank texts, equal ids, a null id, a long text, and columns whose names the operators use themselves.
ODD = [(1, "un deux trois quatre cinq", "fr"), (1, "un deux trois quatre cinq", "fr"), (2, None, None), (3, "", "en"), (4, " \n\t ", "en"), (None, "one two three", "en"), (5, "word " * 60_000, "en"), (6, "été Ünïcode \U0001f600 x", None), (7, "the idiot is here, you idiot", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, l, "s") for i, t, l in ODD], "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in ("score", "predicted", "lang_pred", "block", "bucket", "n", "id", "comp", "key", "y", "topic", "tokens", "kept", "term", "variant")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(text):
    return [w for w in SPACE.split(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def test_suffix_tree_base_is_exact_and_contexts_help(spark, texts):
    got = {r["doc_id"]: r for r in queries.op1_suffix_tree(spark, SF).collect()}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    held = {i: __import__("zlib").crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(t in c for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def brute_tree(tokens, held, depth, least_count=8, least_gain=2.0, prior=suffixtree.PRIOR):
    """log10 P of each text by a tree of dictionaries, straight from the definition."""
    train = [t for i, t in tokens.items() if not held[i]]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    follow = {}
    for t in train:
        for i in range(len(t)):
            for k in range(1, min(depth, i) + 1):
                follow.setdefault(tuple(t[i - k : i]), Counter())[t[i]] += 1
    node = {}

    def p(context, w):
        if not context:
            return (c[w] + 0.5) / (n + 0.5 * (v + 1))
        low = p(context[1:], w)
        if not node.get(context):
            return low
        f = follow[context]
        return (f[w] + len(f) * low) / (sum(f.values()) + len(f))

    for context in sorted(follow, key=len):
        f = follow[context]
        total = sum(f.values())
        if total >= least_count:
            gain = sum(m * (log((m - 1 + prior * q) / (total - 1 + prior)) - log(q)) for w, m in f.items() for q in [p(context[1:], w)])
            node[context] = gain >= least_gain
    return {i: sum(log10(p(tuple(t[max(0, j - depth) : j]), t[j])) for j in range(len(t))) for i, t in tokens.items()}


def test_suffix_tree_scores_against_a_tree_of_dictionaries(spark, texts):
    """Whatever the number of buckets, blocks and partitions, and with contexts dealt over many buckets."""
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    held = {i: __import__("zlib").crc32(str(i).encode()) % 5 == 1 for i in texts}
    want = brute_tree(tokens, held, 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for block_tokens, parts in ((1_500_000, 4), (2_000, 64)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["doc_id"]: r["score"] for r in suffixtree.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, block_tokens=block_tokens).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        # the test's parent probabilities travel in steps of 1/2048 nat, so a context at the very bound may fall otherwise
        assert sum(abs(got[i] - want[i]) > 1e-6 * abs(want[i]) for i in want) <= 0.02 * len(want)
        assert all(got[i] == pytest.approx(want[i], rel=1e-3) for i in want)


def test_suffix_tree_depth_is_a_parameter(spark):
    rows = [(i, " ".join(f"a{i % 4} b c d{i % 4}" for _ in range(20))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda k: suffixtree.score_texts(docs, F.lit(False), max_depth=k).agg(F.sum("score"), F.max("mean_depth")).first()
    (p1, d1), (p2, _), (p3, d3) = score(1), score(2), score(3)
    assert p1 < p3 and p2 < p3 and d1 <= 1 < d3 <= 3


def test_suffix_tree_odd(odd, empty):
    got = suffixtree.score_texts(odd, F.coalesce(F.col("doc_id") == 7, F.lit(False))).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert suffixtree.score_texts(empty, F.lit(False)).count() == 0


def components(sets, percent=80):
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in sets}


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_against_all_pairs(spark, texts):
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in queries.op3_minhash_dedup(spark, SF).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == components(sets)
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_in_large_unlike_groups(spark):
    """Edits of one text a little too unlike each other, copies, and chains: more than a bucket settles at once."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join("x%d_%d" % (i, j) if (j * 7 + i * 13) % 60 < 2 else w for j, w in enumerate(base))) for i in range(60)]
    rows += [(100 + i, " ".join(base)) for i in range(40)] + [(200 + i, " ".join(base[: 120 - i])) for i in range(0, 40, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 7):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, block=block).collect()}
        assert got == components({i: shingles(t, 5) for i, t in rows})


def test_near_duplicates_of_edited_copies_against_all_pairs(spark):
    """Copies of two texts with one to seven words changed: many pairs lie a little under the bound, and few are links of the middle."""
    import random

    r = random.Random(5)
    bases = [[f"w{r.randrange(400)}" for _ in range(150)] for _ in range(2)]
    rows = []
    for i in range(160):
        w = list(bases[i % 2])
        for k in r.sample(range(150), 1 + i % 7):
            w[k] = f"e{i}_{k}" if i % 3 else f"e{k}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components({i: shingles(t, 5) for i, t in rows})


def test_near_duplicates_odd(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert all(r["component_id"] == r["doc_id"] for r in got) and {r["n_shingles"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert minhash.near_duplicates(empty).count() == 0


def test_estimates_are_near(spark):
    a, b = " ".join(f"w{i}" for i in range(1000)), " ".join(f"w{i}" for i in range(100, 1000))
    s = minhash.signatures(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"), "doc_id", "text", 1).orderBy("doc_id")
    x, y = (s.where(f"doc_id = {i}").select(F.struct(*[f"s{k}" for k in range(5)]).alias(n)) for i, n in ((0, "x"), (1, "y")))
    assert x.withColumn("j", F.lit(1)).join(y.withColumn("j", F.lit(1)), "j").select(minhash.estimate("x", "y", 5)).first()[0] == pytest.approx(0.9, abs=0.12)


def test_toxicity_on_held_out_rows(spark):
    """At sf0.1: some hundred held-out toxic rows are there; at sf0.01 there are six, two of them without any word that marks them."""
    large = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{large}/labels.parquet").where("toxic IS NOT NULL")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in queries.op4_toxicity(spark, large).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.01


def test_automaton_against_edit_distance():
    terms = dict.fromkeys(["idiot", "worthless", "scum"], 3.0)
    automaton = toxicity.Automaton(terms, {})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y and y not in toxicity.LOOKS_LIKE.get(x, "")))
        return row[-1]

    for w in ["idiot", "idjot", "idiott", "idit", "1diot", "idot", "idxyt", "worthles", "wrthlss", "w0rthless", "scum", "scam", "skum", "scumm", "table", "warthless", "worthy"]:
        near = [t for t in terms if (w[0] == t[0] or t[0] in toxicity.LOOKS_LIKE.get(w[0], "")) and distance(w[1:], t[1:]) <= toxicity.max_edits(len(t))]
        got = automaton.match(w)
        assert (got is not None) == bool(near), w


def test_automaton_accepts_all_near_variants():
    """Every word one or two edits from a term, against plain edit distance; no edit is special."""
    terms = dict.fromkeys(["idiot", "moron", "worthless", "disgusting", "scum"], 3.0)
    automaton = toxicity.Automaton(terms, {})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y and y not in toxicity.LOOKS_LIKE.get(x, "")))
        return row[-1]

    def edits(w):
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + b[1:] for a, b in cut if b} | {a + c + b[k:] for a, b in cut for c in "xo1" for k in (0, 1)}

    words = {v for t in terms for w in {t} | edits(t) for v in {w} | edits(w)} | {"ediot", "diot", "ldiot", "xmoron", "worthss", "disgting"}
    for w in words:
        least = min((d for t in terms if (d := distance(w, t)) <= toxicity.max_edits(len(t))), default=None)
        got = automaton.match(w)
        assert (got and got[2]) == least, w


def test_quotation_weighs_less_than_abuse():
    s = toxicity.Scorer(toxicity.Model())
    assert s.score('The report said the word "idiot" was used.') < s.score("You idiot, go away, you idiot.")
    assert s.score("a table and a chair") < 0.5


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (7, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, toxicity.fit(empty, labels.where("false")), ["doc_id"]).count() == 0


def test_fingerprints(spark, texts):
    order = sorted(texts)
    got = {r["doc_id"]: r for r in queries.op5_weighted_fingerprints(spark, SF).collect()}
    bag = lambda t: Counter(w.lower() for w in SPACE.split(t) if w)
    jaccard = lambda a, b: sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0
    off = []
    for i, at in enumerate(order):
        own, after = texts[at], texts[order[(i + 1) % len(order)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = got[at]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        off += [r["near_edited"] - jaccard(bag(own), bag(edited)), r["near_next"] - jaccard(bag(own), bag(after))]
    assert abs(sum(off) / len(off)) < 0.02 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.12
    same = {}
    for i, r in got.items():
        assert same.setdefault(texts[i], r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_odd(odd, empty):
    got = cws.fingerprints(odd).collect()
    assert len(got) == len(ODD) and cws.fingerprints(empty).count() == 0
    assert cws.fingerprints(odd.where("doc_id = 6")).first()["near_next"] == 1.0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "<<ROLE>>x<</ROLE>>", "", None, "a" * 300_000, "[\\INST]\\\\"]
    roles = ["user", "assistant", "system", "tool<<END>>", None]
    turns = spark.createDataFrame([(c, t, roles[(c + t) % 5], hard[(3 * c + t) % len(hard)], 1) for c in range(5) for t in range(8)], "conv_id long, turn long, role string, text string, loss int")
    formatted = chat.format_conversations(turns)
    got = {}
    for r in formatted.collect():
        got.setdefault(r["conv_id"], []).append("".join(s["text"] for s in r["segments"]))
    want = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    assert {c: list(chat.Template().parse("".join(x))) for c, x in got.items()} == want
    assert chat.read_back(formatted).count() == 5 and chat.read_back(chat.format_conversations(turns.where("false"))).count() == 0


def test_url_lists_odd(spark):
    pages = spark.createDataFrame([(1, "http://a.x.org/p", "2024-01-05"), (1, "http://a.x.org/p", "2024-01-05"), (2, None, "2024-01-05"), (3, "nothing", "2024-01-05"), (4, "http://x.org", None), (5, "http://a.x.org", "2024-01-10")], "page_id long, url string, at string").withColumn("fetched_at", F.to_timestamp("at")).withColumn("list", F.lit(1))
    history = spark.createDataFrame([("l", "x.org", "add", "2024-01-02"), ("l", "x.org", "add", "2024-01-03"), ("l", "x.org", "remove", "2024-01-10"), ("l", None, "add", "2024-01-01")], "list string, key string, action string, at string").withColumn("at", F.to_timestamp("at"))
    got = urllists.evaluate(pages, urllists.intervals(history)).collect()
    assert sorted((r["page_id"], r["blocked"]) for r in got) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False)]
    assert not urllists.evaluate(pages, urllists.intervals(history.where("false"))).where("blocked").count()
    assert urllists.evaluate(pages.where("false"), urllists.intervals(history)).count() == 0


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang")
    got = queries.op8_language_id(spark, BIG).where("held_out AND lang_pred <> 'und'").join(docs.where("lang IS NOT NULL"), "doc_id")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / n > 0.95


def test_languages_that_were_not_learned_and_junk_are_rejected(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    other = {"pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem", "ru": "Все люди рождаются свободными и равными в своем достоинстве", "junk": "xkq zzvbj qwrt kjhgf zxcvb qqq wrtplk mnbvc xzzk jkl qwx vbnm zzxq xqz kkjh", "none": "½ ² ³ 12"}
    got = {r["k"]: r for r in langid.identify(spark.createDataFrame(list(other.items()), "k string, text string"), model, ["k"]).collect()}
    assert got["none"]["lang_pred"] == langid.UNKNOWN and all(r["score"] < 0.1 for r in got.values())
    n, kept = langid.identify(docs.where("lang IS NOT NULL"), model, ["doc_id"]).where("lang_pred <> 'und'").agg(F.count("*"), F.count_if(F.col("score") >= 0.1)).first()
    assert kept >= 0.995 * n


def test_languages_odd(odd, empty):
    got = langid.identify(odd, langid.fit(odd), ["doc_id"]).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {langid.UNKNOWN}
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(empty), ["doc_id"]).collect()} == {langid.UNKNOWN}
    assert langid.identify(empty, langid.fit(empty), ["doc_id"]).count() == 0


def test_leaks_are_found_and_clean_documents_left(spark):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    whole = {(d, i) for i, t in items.items() for d, text in docs.items() if t and t in text}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, BIG).collect()}
    assert whole <= got and len({d for d, _ in got}) < 0.1 * len(docs)


def _prose(seed, n, vocabulary=3000):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize(("rows", "leaked"), [(40, 3), (300, 100), (60, 60)])
def test_leaks_carried_by_many_documents(spark, rows, leaked):
    """A document with an item, copied to many rows; every word of the item is common for that."""
    items = {k: " ".join(_prose(k, 40)) for k in range(8)}
    hot = " ".join([*_prose(50, 60), items[3], *_prose(51, 60)])
    docs = [(i, hot if i < leaked else " ".join(_prose(100 + i, 150))) for i in range(rows)]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["leak"]) for r in got) == [(i, 3, "exact") for i in range(leaked)]


@pytest.mark.parametrize(("length", "share", "first"), [(59, 28 / 59, 13), (500, 0.2, 37), (500, 0.4, 250), (200, 0.5, 99), (140, 0.2, 111)])
def test_leaks_of_a_part_of_an_item(spark, length, share, first):
    items = {k: _prose(k, length) for k in range(4)}
    part = items[2][first : first + round(share * length)]
    docs = [(i, " ".join([*_prose(60 + i, 70 + i), *(part if i % 2 else []), *_prose(90 + i, 80)])) for i in range(20)]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, 2) for i in range(1, 20, 2)]
    assert all(r["lcs"] >= len(part) / length for r in got)


def test_leaks_of_short_and_repetitive_items(spark):
    """Items under RUN words stand in a row; items that repeat their words are judged by their longest common subsequence."""
    items = {1: "quick brown fox", 2: "one two one two one two one two one two three", 3: "ab cd", 4: "quick brown fox jumps over it", 5: "la " * 30}
    docs = {1: "the quick brown fox sat", 2: "quick red brown fox", 3: "x one two one two one two one two one two three y", 4: "one two three", 5: "ab cd", 6: "quick brown fox jumps over it", 7: "la " * 25 + "di", 8: "la la la"}
    frame = lambda d, k: spark.createDataFrame([(i, t, 0) for i, t in [*d.items(), *list(d.items())[:1]]], f"{k} long, text string, leak int")
    got = decontaminate.find_leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (6, 1), (3, 2), (6, 4), (7, 5)}
    assert len([r for r in got if r["doc_id"] == 1]) == 4  # both rows, both items


def test_leaks_of_paraphrases_against_all_pairs(spark):
    """Items with words dropped, added and replaced: every pair whose longest common subsequence is long enough, over all places of a document."""
    import random

    import numpy as np

    r = random.Random(3)
    items = {k: _prose(k, 30 + 3 * k) for k in range(8)}
    docs = {}
    for i in range(120):
        w = list(items[i % 8])
        for _ in range(r.randrange(4, 20)):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], [f"n{i}"], [w[at], f"n{i}_{at}"]])
        docs[i] = [*_prose(200 + i, 90), *(w if i % 3 else _prose(400 + i, 40)), *_prose(600 + i, 90)]
    number: dict[str, int] = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws])
    want = {(i, k) for i, d in docs.items() for k, t in items.items() if decontaminate.lcs_length(code(d[90 - len(t) : len(d) - 90 + len(t)]), code(t)) >= 0.55 * len(t)}
    got = decontaminate.find_leaks(spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string"))
    found = {(x["doc_id"], x["item_id"]) for x in got.collect()}
    assert len(want) > 50 and len(want & found) >= 0.9 * len(want)
    assert all(i % 8 == k and i % 3 for i, k in found)


def test_lcs_against_the_table():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs_length(a, b) == t[-1, -1]


def test_leaks_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "word word"), (5, "a b c d e f g h i j k l m n o p q r s t u v w x y z")], "item_id long, text string")
    assert decontaminate.find_leaks(odd, items).count() == 0
    assert decontaminate.find_leaks(odd, items.where("item_id < 5")).count() == 0
    assert decontaminate.find_leaks(empty, items).count() == 0


def test_mixing_reaches_its_targets(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    aim = spark.createDataFrame([("en", 4.0), ("fr", 2.0), ("de", 1.0), ("es", 1.0), ("none", 9.0)], "value string, share double")
    got = mixing.mix(docs, {"lang": aim}, keep_share=0.05).select("_mix.*", "probability", "kept").cache()
    mass = {r[0]: r[1] for r in got.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability"))).collect()}
    total = sum(mass.values())
    present = {k: s for k, s in (("en", 4), ("fr", 2), ("de", 1), ("es", 1)) if k in mass}
    for k, s in present.items():
        assert mass[k] / total == pytest.approx(s / sum(present.values()), rel=0.05)
    assert got.count() == docs.count()


def test_mixing_odd(odd, empty):
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0


def test_archives(spark, tmp_path):
    html = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/1", html), (2, "http://a/2\n", html), (3, None, None), (4, "http://a/4", ""), (5, "u", "small"), (6, "u", "small"), (2, "http://a/2", html), (None, "u", html), (7, "u", "é" * 600)], "page_id long, url string, html string").withColumn("offset", F.lit(1))
    folder = (tmp_path / "w").as_uri()
    index = warc.write_archives(warc.with_revisits(pages), folder, archive_bytes=500)
    got = warc.read_records(index, folder).collect()
    assert len(got) == 9
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "response", None), (1, "revisit", 2), (2, "response", None), (2, "response", None), *[(k, "response", None) for k in range(3, 8)]]
    assert {bytes(r["payload"]) for r in got if r["page_id"] == 7} == {("é" * 600).encode()}
    some = warc.read_records(index.where("page_id = 5"), folder, max_gap=0).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in some] == [(5, b"small")]
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_report_the_payload_that_was_read(spark, tmp_path):
    """A payload that is not what the head says is seen; a damaged member raises."""
    import zlib

    html = "<p>" + "x" * 3000
    folder = tmp_path / "w"
    index = warc.write_archives(warc.with_revisits(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")), folder.as_uri())
    row = index.first()
    path = folder / row["archive"]
    raw = zlib.decompress(path.read_bytes(), 31).replace(b"xxxx\r\n", b"xxyx\r\n")
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    data = z.compress(raw) + z.flush()
    path.write_bytes(data)
    moved = index.withColumn("length", F.lit(len(data)).cast("long"))
    got = warc.read_records(moved, folder.as_uri()).first()
    changed = html[:-2] + "yx"
    assert (got["payload_digest"], got["payload_bytes"]) == (hashlib.sha1(changed.encode()).hexdigest(), 3003) and got["payload_digest"] != row["payload_digest"]
    path.write_bytes(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    with pytest.raises(Exception, match="(?i)error"):
        warc.read_records(moved, folder.as_uri()).collect()


def test_kept_columns_that_clash_get_another_name(spark, odd):
    labels = spark.createDataFrame([(1, 0), (7, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, labels), ["doc_id", "score", "predicted"])
    assert got.columns == ["doc_id", "score_in", "predicted_in", "score", "predicted"] and got.count() == len(ODD)
    got = langid.identify(odd, langid.fit(odd), ["doc_id", "lang_pred", F.lit(1).alias("Score")])
    assert got.columns == ["doc_id", "lang_pred_in", "Score_in", "lang_pred", "score"] and got.count() == len(ODD)
    whole = langid.identify(odd, langid.fit(odd))
    assert whole.select("row.*").columns == odd.columns
    mixed = mixing.mix(odd.withColumns({"probability": F.lit(1), "_mix": F.lit(2)}))
    assert {"probability_in", "_mix_in", "kept_in", "probability", "kept"} <= set(mixed.columns) and mixed.count() == len(ODD)


def test_mixing_reports_what_contradicts(spark):
    """Two dimensions that say the same can't have unlike targets: the residual tells, and no round runs for ever."""
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 30)], "source string, lang string, topic string, tokens long")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    agree = {"source": share({"a": 1.0, "b": 1.0}), "lang": share({"x": 1.0, "y": 1.0}), "topic": share({"t": 1.0})}
    factors, rate, residual = mixing.calibrated(cells, agree, keep_share=0.5)
    got = {r["source"]: r["tokens"] * r["factor"] for r in factors.collect()}
    assert residual <= 1e-6 and got["a"] == pytest.approx(20) and got["b"] == pytest.approx(20) and rate > 0
    assert mixing.calibrated(cells, agree | {"lang": share({"x": 3.0, "y": 1.0})}, rounds=3)[2] > 0.1


def test_archives_of_long_pages_and_extra_columns(spark, tmp_path):
    html = "".join(chr(97 + i * i % 26) for i in range(3_000_000))
    pages = spark.createDataFrame([(1, "u", html, 1, 2), (2, "u", html, 1, 2), (3, "v", "x", 1, 2)], "page_id long, url string, html string, archive int, length int")
    got = {r["page_id"]: r for r in warc.round_trip(pages, (tmp_path / "w").as_uri()).collect()}
    assert {i: (r["record_type"], r["refers_to"], r["payload_bytes"]) for i, r in got.items()} == {1: ("revisit", 2, 3_000_000), 2: ("response", None, 3_000_000), 3: ("response", None, 1)}
    assert got[1]["payload_digest"] == got[2]["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()


def test_url_lists_with_long_hosts_and_clashing_columns(spark):
    host = ".".join(["a" * 60] * 40) + ".x.org"
    pages = spark.createDataFrame([(1, f"http://{host}/p", 1, 2), (2, "http://x.org.evil.net/", 1, 2)], "page_id long, url string, host int, lists int").withColumn("fetched_at", F.to_timestamp(F.lit("2024-01-05")))
    history = spark.createDataFrame([("l", "x.org", "add", "2024-01-02")], "list string, key string, action string, at string").withColumn("at", F.to_timestamp("at"))
    got = {r["page_id"]: r["blocked"] for r in urllists.evaluate(pages, urllists.intervals(history)).collect()}
    assert got == {1: True, 2: False}


def test_blocks_of_sparse_ids_follow_each_other(spark):
    """Ids far apart, negative and next to each other: the next block is the next greater one, the last one's is the first."""
    blocks = sorted({-(1 << 40), -5, 0, 1, 2, 4095, 4096, 1 << 30, (1 << 52) + 3, (1 << 52) + 4, -(1 << 60)})
    got = dict(map(tuple, cws.next_block(spark.createDataFrame([(b,) for b in blocks], "block long")).collect()))
    assert got == dict(zip(blocks, blocks[1:] + blocks[:1], strict=True))


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    assert 0.2 < mixing.mix(docs).where("kept").count() / 2000 < 0.4
