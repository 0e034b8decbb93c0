"""Toxicity scores from a lexicon trie walked by a Levenshtein automaton, with context windows.

The lexicon holds seed terms and, learned from labelled rows, words and word beginnings (stems) that
mark the toxic class. Its trie is intersected with a Levenshtein automaton: a state is a set of (trie
node, edits spent) closed under omissions, and its successors are worked out the first time a character
needs them. Substitutions that look alike (0 for o, 1 for i, ...) cost no edit; otherwise it accepts
what plain edit distance does, whichever character is touched. Misspelt forms that occur in clean labelled rows
are ordinary words and are let pass.

Each hit is weighed by a window around it: inside quotation marks or beside a reporting word it counts
as quoted, beside a word of address it counts more. A logistic model over sums of hits gives the score.

Fitting reads about ``max_rows_per_class`` labelled rows of each class, picked by a hash of the id;
near copies among them count once, and an entry must
pass a likelihood test whose bar rises with the number of candidates. All entries that pass and all misspelt forms found in clean
rows of that sample are used; they and the sample's features are what reaches the driver, so its bound is the sample's. Scoring reads
every whole text, however long. Null text counts as empty; an empty text scores the model's intercept. With no labelled
row of both classes a fixed model over the seed terms is used. Repeated rows are scored each, and alike; a repeated label counts once, contrary labels of one id
both count. Kept columns that are called like a result get the ending ``_in``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from calltrail.llm.shared import apart, slices, written
from calltrail.llm.text import mix, word_hashes

#: Common English insults; labelled rows add to them or strike them out.
SEEDS = ("idiot", "moron", "stupid", "worthless", "pathetic", "disgusting", "loser", "scum", "trash", "clown", "imbecile", "garbage", "filthy")
REPORTING = frozenset("said says say called calls quote quoted quotes word words term wrote writes insult slur reported dit disait mot sagte schrieb wort dijo palabra".split())
ADDRESS = frozenset("you your youre yourself du dich dein tu vous toi te usted ustedes".split())
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
WINDOW = 6
#: States and words kept at once; beyond it they are worked out again.
MAX_STATES, MAX_WORDS = 8_000, 100_000
_WORD = re.compile(r"[^\W_](?:[\w@$!]*[^\W_])?")
_QUOTES = re.compile("[\"“”„«»‘]|(?<!\\w)'|'(?!\\w)")
NAMES = ("exact", "fuzzy", "stem", "quoted", "terms", "rate")


def max_edits(length: int) -> int:
    return 0 if length < 4 else 1 if length < 9 else 2


class Automaton:
    """Words within max_edits of a term, or beginning with a stem, read character by character."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.allowed = [0]
        for word, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            node = 0
            if not is_stem:
                self.allowed[0] = max(self.allowed[0], max_edits(len(word)))
            for ch in word:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                    self.stem.append(None)
                    self.allowed.append(0)
                node = self.next[node][ch]
                if not is_stem:
                    self.allowed[node] = max(self.allowed[node], max_edits(len(word)))
            if is_stem:
                self.stem[node] = word
            else:
                self.end[node] = word
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.start = self._state(self._closed({0: 0}))
        self.dead = self._state(frozenset())

    def _closed(self, best: dict[int, int]) -> frozenset:
        """The least edits of each node, with those reached by leaving out characters of a term."""
        todo = list(best)
        while todo:
            node = todo.pop()
            e = best[node] + 1
            for child in self.next[node].values():
                if e <= self.allowed[child] and e < best.get(child, 9):
                    best[child] = e
                    todo.append(child)
        return frozenset(best.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            found = [(e, self.end[n]) for n, e in items if self.end[n] and e <= max_edits(len(self.end[n]))]
            self.accepts.append(min(found) if found else None)
        return self.states[items]

    def _move(self, state: int, ch: str) -> int:
        best: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e < best.get(node, 9):
                best[node] = e

        for node, e in self.sets[state]:
            children = self.next[node]
            for c in (ch, *LOOKS_LIKE.get(ch, "")):
                if c in children:
                    put(children[c], e)
            if e < self.allowed[node]:
                put(node, e + 1)  # an extra character
                for child in children.values():
                    if e + 1 <= self.allowed[child]:
                        put(child, e + 1)  # another character
        to = self._state(self._closed(best))
        self.moves[state][ch] = to
        return to

    def match(self, word: str) -> tuple[str, str, int] | None:
        """(kind, lexicon entry, edits) or None; kind is exact, stem or fuzzy, in this order of preference."""
        if len(self.sets) > MAX_STATES:
            self._reset()
        state, stem, moves = self.start, None, self.moves
        for ch in word:
            to = moves[state].get(ch)
            if to is None:
                to = self._move(state, ch)
            state = to
            if state == self.dead:
                break
            for node, e in self.sets[state] if stem is None else ():
                if e == 0 and self.stem[node]:
                    stem = self.stem[node]
        got = self.accepts[state]
        if got and got[0] == 0:
            return "exact", got[1], 0
        if stem:
            return "stem", stem, 0
        return ("fuzzy", got[1], got[0]) if got else None


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS, 3.0))
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset = frozenset()
    weights: list[float] = field(default_factory=lambda: [1.5, 0.7, 1.0, 0.1, 0.5, 0.3])
    bias: float = -3.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(model.terms, model.stems)
        self.known: dict[str, tuple | None] = {}

    def hit(self, word: str):
        got = self.known.get(word, 0)
        if got == 0:
            if len(self.known) > MAX_WORDS:
                self.known.clear()
            got = self.automaton.match(word)
            if got and got[0] == "fuzzy" and word in self.model.clean:
                got = None
            self.known[word] = got
        return got

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, str, str, float, bool]], int]:
        """(start, end, kind, entry, weight, quoted) of each hit, and the number of words."""
        low = (text or "").lower()
        words = _WORD.findall(low)
        marked = {w for w in set(words) if self.hit(w)}
        if not marked:
            return [], len(words)
        out = []
        marks = [m.start() for m in _QUOTES.finditer(low)]
        at = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        for i, w in enumerate(words):
            if w not in marked:
                continue
            kind, entry, edits = self.hit(w)
            near = set(words[max(0, i - WINDOW) : i + WINDOW + 1])
            begin, end = at[max(0, i - 2 * WINDOW)][0], at[min(len(at) - 1, i + 2 * WINDOW)][1]
            lo, hi = np.searchsorted(marks, [begin, at[i][0]]) if marks else (0, 0)
            after = np.searchsorted(marks, [at[i][1], end]) if marks else (0, 0)
            quoted = bool((hi - lo) % 2 and after[1] > after[0])
            weight = (self.model.stems if kind == "stem" else self.model.terms)[entry] / 3.0
            weight *= 0.5**edits * (0.25 if quoted else 1.0) * (0.6 if near & REPORTING else 1.0) * (1.3 if near & ADDRESS else 1.0)
            out.append((*at[i], kind, entry, weight, quoted))
        return out, len(words)

    def features(self, text: str | None) -> list[float]:
        hits, n = self.spans(text)
        sums = Counter()
        for _, _, kind, _, weight, quoted in hits:
            sums["quoted" if quoted else kind] += weight
        own = [h for h in hits if not h[5]]
        return [float(np.log1p(sums[k])) for k in NAMES[:4]] + [float(np.log1p(len({h[3] for h in own}))), float(min(3.0, 100 * sum(h[4] for h in own) / (n + 20)))]

    def score(self, text: str | None) -> float:
        z = self.model.bias + float(np.dot(self.model.weights, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _marks(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in range(4, 10) if len(w) > k}


def _lexicon(rows: list) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems with their log odds from marks that passed the test of evidence."""
    odds = {r["mark"]: (r["odds"], r["pos"]) for r in sorted(rows, key=lambda r: (-r["odds"], r["mark"]))}
    stems: dict[str, float] = {}
    for mark in sorted((m for m in odds if m.endswith("*")), key=lambda m: (len(m), m)):
        stem = mark[:-1]
        if odds[mark][0] < 3.5 or any(stem.startswith(s) for s in stems):
            continue
        while True:  # as long as it stays (nearly) as frequent, a longer stem is as good and safer
            longer = [m[:-1] for m in odds if m.endswith("*") and len(m) == len(stem) + 2 and m.startswith(stem) and odds[m][1] >= 0.9 * odds[f"{stem}*"][1]]
            if not longer:
                break
            stem = longer[0]
        if not any(m.startswith(stem) and not m.endswith("*") and odds[m][1] >= 0.8 * odds[f"{stem}*"][1] for m in odds):
            stems[stem] = min(6.0, odds[f"{stem}*"][0])
    terms = {m: min(6.0, o) for m, (o, _) in odds.items() if not m.endswith("*") and len(m) >= 3 and not any(m.startswith(s) for s in stems)}
    return terms, stems


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep, x.T @ (w * (y - p)) - keep @ b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_rows_per_class: int = 3000) -> Model:
    """Learn from the rows of docs that labels (key and label) names; other labels than 0 and 1, and nulls, are left out.

    The sample is drawn from labels, so its ids are few enough to broadcast and no text is shuffled to find it.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).distinct()
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Model()
    spread = F.pmod(F.xxhash64("key", F.lit(4)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    chosen = rows.where(spread < F.when(F.col("y") == 1, min(1.0, max_rows_per_class / counts[1])).otherwise(min(1.0, max_rows_per_class / counts[0])))
    sample = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key").select("y", "text")

    def signed(batches):
        for b in batches:
            sig = []
            for first, h, off in word_hashes(b.column(1).cast(pa.binary()).to_pylist()):
                for lo, hi in zip(off[:-1], off[1:], strict=True):
                    x = h[lo:hi]
                    sig.append(int((mix(x[:-3] + mix(x[1:-2] + mix(x[2:-1] + mix(x[3:])))) if len(x) > 3 else mix(x + np.uint64(len(x)))).min(initial=(1 << 64) - 1) >> np.uint64(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig, pa.int64())], ["y", "text", "sig"])

    # copies are one piece of evidence, not many
    sample = written(sample.mapInArrow(signed, "y int, text string, sig long").dropDuplicates(["y", "sig"]).select("y", "text"), "toxicity_sample")
    drawn = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    if len(drawn) < 2:
        return Model()

    def marked(batches):
        for b in batches:
            pos, neg = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (pos if y else neg).update(_marks(t))
            both = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([pos[m] for m in both], pa.int64()), pa.array([neg[m] for m in both], pa.int64())], ["mark", "pos", "neg"])

    prior = drawn[1] / (drawn[0] + drawn[1])
    pos, neg = F.col("pos"), F.col("neg")
    log_odds = F.log((pos + 0.5) / (drawn[1] + 1)) - F.log((neg + 0.5) / (drawn[0] + 1))
    # the likelihood ratio against the prior; beyond ln(number of marks) chance is no explanation
    evidence = pos * F.log(pos / (pos + neg) / prior) + F.when(neg > 0, neg * F.log(neg / (pos + neg) / (1 - prior))).otherwise(0)
    stats = written(sample.mapInArrow(marked, "mark string, pos long, neg long").groupBy("mark").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxicity_marks")
    enough = float(np.log(max(2, stats.count()))) + 3
    best = stats.where((pos >= 3) & (log_odds >= 2.5) & (evidence >= enough)).select("mark", "pos", log_odds.alias("odds")).collect()
    terms, stems = _lexicon(best)
    contrary = {r["mark"] for r in stats.where(F.col("mark").isin(*SEEDS) & (log_odds < 1) & (F.col("pos") + F.col("neg") >= 5)).collect()}
    model = Model(dict.fromkeys([s for s in SEEDS if s not in contrary], 3.0) | terms, stems)

    def ordinary(batches):
        scorer = Scorer(model)
        for b in batches:
            found = Counter(w for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if not y for w in set(_WORD.findall(t.lower())) if (h := scorer.hit(w)) and h[0] == "fuzzy")
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["word"])

    clean = frozenset(r[0] for r in sample.mapInArrow(ordinary, "word string").distinct().collect())
    known = Model(model.terms, model.stems, clean)

    def featured(batches):
        scorer = Scorer(known)
        for b in batches:
            x = [np.array(scorer.features(t)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["y", "x"])

    got = sorted((r["y"], bytes(r["x"])) for r in sample.mapInArrow(featured, "y int, x binary").collect())
    y = np.array([g[0] for g in got], float)
    if len(set(y)) < 2:
        return known
    w = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    x = np.stack([np.frombuffer(g[1]) for g in got])
    b = _logistic(x, y, w * len(y) / w.sum())
    for k, part in ((1, 0.7), (3, 0.1)):  # a kind of hit that the sample lacks counts as a part of an exact one
        if not x[:, k].any():
            b[k] = part * max(b[0], b[2])
    known.weights, known.bias = b[:-1].tolist(), float(b[-1])
    return known


def score(docs: DataFrame, model: Model, keep: list[str | Column] | None = None, text: str = "text") -> DataFrame:
    """keep's columns (or, without, the whole row as one column ``row``) with score and predicted for every row of docs."""
    inside = keep is None
    kept = docs.select(F.struct("*").alias("row")) if inside else apart(docs.select(F.col(text).alias("_toxicity_text"), *keep), ("score", "predicted"))
    names = kept.schema.fields[0 if inside else 1 :]
    schema = StructType([*names, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        scorer = Scorer(model)
        for b in slices(batches):
            texts = (pc.struct_field(b.column(0), text) if inside else b.column(0)).to_pylist()
            p = [scorer.score(t) for t in texts]
            cols = [b.column(i) for i in range(0 if inside else 1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p, pa.float64()), pa.array([int(v >= 0.5) for v in p], pa.int32())], schema.names)

    return kept.mapInArrow(run, schema)
