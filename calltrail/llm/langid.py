"""Language identification in two steps: the family, then a vote of linear SVMs inside it.

Features are hashed character n-grams (1 to 3) of the lower-cased letters of a whole text, as
frequencies. One-versus-one linear support vector machines separate families; within a family,
one-versus-one machines separate its languages, and the language with most votes wins (ties: larger
sum of margins, then name).

A vote always has a winner, so the score also asks whether the text looks like the winner at all: its mean log probability under the winner's
n-gram profile is compared with those of the learning rows (their median and spread, as a function of length), and a text many spreads
below them, such as letter junk or a language that was not learned, scores near 0.

Fitting uses about ``max_train_rows`` labelled rows, shared evenly between languages and picked by
a hash of the id, whose n-gram counts reach the driver without zeros. Everything else reads every row.

A letter is what ``str.isalpha`` says. Null text, or text without a letter: ``und`` with score 0. Rows with null lang are not learned from.
No labelled row at all: every text is ``und``. Very long texts are read whole, in steps. Each row gives one result, also repeated ones; kept columns that are
called like a result get the ending ``_in``, others are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from calltrail.llm.shared import apart, slices, written

#: Language families by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic", "af": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "be": "slavic", "bg": "slavic", "sr": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic",
}
UNKNOWN = "und"
#: Spreads below the usual at which a text counts as half like its language.
SPREADS = 14.0
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STEP = 1 << 18
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Model:
    """Weights of each machine (column) over the hashed n-grams, and who wins on either sign."""

    dims: int
    families: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str, str]] = field(default_factory=list)  # (family or "", positive, negative)
    weights: np.ndarray | None = None  # after the machines' columns, one of log probabilities for each language
    bias: np.ndarray | None = None
    #: for each language the median of its learning rows' mean log probability, and a and b of its variance a + b / n-grams
    usual: dict[str, tuple[float, float, float]] = field(default_factory=dict)


def _codes(text: str | None) -> np.ndarray:
    letters = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not letters.isascii() and (odd := {c for c in set(letters) if c != " " and not c.isalpha()}):  # numerals such as \u00bd
        letters = letters.translate(dict.fromkeys(map(ord, odd), " "))
    letters = letters.strip()
    return np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32) if letters else np.zeros(0, np.uint32)


def _grams(c: np.ndarray, dims: int) -> Iterator[np.ndarray]:
    """Hashed n-grams of each order; the long text comes in overlapping steps."""
    shift = np.uint64(64 - dims.bit_length() + 1)
    for at in range(0, len(c), _STEP):
        x = c[at : at + _STEP + 2].astype(np.uint64)
        h = x * _K1
        n = min(_STEP, len(x))
        yield (h[:n] * _K2) >> shift
        for _ in range(2):
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _K2 + x[len(x) - len(h) + 1 :] * _K1
            if len(h):
                yield (h[:n] * _K2) >> shift


def counts(text: str | None, dims: int) -> np.ndarray:
    out = np.zeros(dims, np.int64)
    for g in _grams(_codes(text), dims):
        out += np.bincount(g.astype(np.int64), minlength=dims)
    return out


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear SVM by averaged subgradient steps on the whole (bounded) sample, classes weighted alike; products in x's own type, as another would copy x."""
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b, total, shift = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for t in range(rounds):
        g = np.where(y * (x @ w.astype(x.dtype) + b) < 1, y * cost, 0)
        rate = 1 / (penalty * (t + 10))
        w = (1 - rate * penalty) * w + min(rate, 2.0) * (g.astype(x.dtype) @ x)
        b += min(rate, 2.0) * 0.1 * g.sum()
        if t >= rounds // 2:
            total, shift = total + w, shift + b
    n = rounds - rounds // 2
    return total / n, shift / n


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", dims: int = 4096, max_train_rows: int = 2400, families: dict[str, str] | None = None) -> Model:
    """Learn from labelled rows; a language's share of the sample is max_train_rows over their number."""
    families = FAMILIES if families is None else families
    rows = labelled.where(F.col(lang).isNotNull())
    of_lang = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    model = Model(dims)
    if not of_lang:
        return model
    each = max(1, max_train_rows // len(of_lang))
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in of_lang.items() for x in (k, min(1.0, each / n))])
    sample = rows.where(F.col(text).isNotNull() & (spread < share[F.col(lang)])).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def featured(batches):
        for b in batches:
            found = [counts(t, dims) for t in b.column("text").to_pylist()]
            at = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column("lang").cast(pa.string()), pa.array([k.astype(np.uint32).tobytes() for k in at], pa.binary()), pa.array([x[k].astype(np.uint32).tobytes() for x, k in zip(found, at, strict=True)], pa.binary())], ["lang", "at", "n"])

    # all tasks write their share of the sample at once; what is read here then is that small table
    small = written(sample.mapInArrow(featured, "lang string, at binary, n binary"), "sample")
    got = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in small.toLocalIterator() if r["at"])
    if not got:
        return model
    names = np.array([g[0] for g in got])
    x, size = np.zeros((len(got), dims), np.float32), np.zeros(len(got))
    for i, (_, at, n) in enumerate(got):
        c = np.frombuffer(n, np.uint32)
        size[i] = c.sum()
        x[i, np.frombuffer(at, np.uint32)] = c / size[i]
    del got
    profiles = np.zeros((dims, len(set(names))), np.float32)
    for k, name in enumerate(sorted(set(names))):
        mean = x[names == name].mean(axis=0, dtype=np.float64)
        profiles[:, k] = np.log((mean + 0.1 / dims) / (mean + 0.1 / dims).sum())
        likely = x[names == name] @ profiles[:, k]
        n, middle = size[names == name], float(np.median(likely))
        off, long = 1.4826 * np.abs(likely - middle), n >= np.median(n)
        model.usual[name] = (middle, float(np.median(off[long]) ** 2), float(np.median(off[~long] ** 2 * n[~long])) if (~long).any() else 1.0)
    centre, scale = x.mean(axis=0), 1 / (x.std(axis=0) + 1e-3 / dims)
    z = x
    z -= centre
    z *= scale
    np.clip(z, -8, 8, out=z)
    z /= np.float32(np.sqrt(dims))
    for name in sorted(set(names)):
        model.families.setdefault(families.get(name, name), []).append(name)
    of = np.array([families.get(n, n) for n in names])
    model.pairs = [("", a, b) for a, b in combinations(sorted(model.families), 2)]
    model.pairs += [(f, a, b) for f, members in sorted(model.families.items()) for a, b in combinations(members, 2)]
    w, bias = np.zeros((dims, len(model.pairs) + profiles.shape[1]), np.float32), np.zeros(len(model.pairs) + profiles.shape[1])
    w[:, len(model.pairs) :] = profiles
    for k, (family, a, b) in enumerate(model.pairs):
        group = names if family else of
        rows_k = (group == a) | (group == b)
        y = np.where(group[rows_k] == a, 1.0, -1.0)
        v, c = _svm(z[rows_k], y)
        margin = z[rows_k] @ v + c
        unit = max(1e-9, np.median(np.abs(margin)))  # half of the sample lies beyond one unit
        v, c = v / unit, c / unit
        w[:, k] = v * scale / np.sqrt(dims)
        bias[k] = c - (centre * scale / np.sqrt(dims)) @ v
    model.weights, model.bias = w, bias
    return model


def margins(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The machines' margins and the languages' mean log probabilities for each text, and its number of n-grams (0 without a letter)."""
    out, size = np.zeros((len(texts), model.weights.shape[1])), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        c = _codes(text)
        n = 0
        for g in _grams(c, model.dims):
            n += len(g)
            out[i] += np.take(model.weights, g.astype(np.int64), axis=0).sum(axis=0, dtype=np.float64) if len(g) < 2 * model.dims else np.bincount(g.astype(np.int64), minlength=model.dims) @ model.weights
        size[i] = n
        out[i] = out[i] / max(1, n) + model.bias
    return out, size


def _vote(names: list[str], family: str, model: Model, m: np.ndarray) -> tuple[str, float]:
    if len(names) == 1:
        return names[0], 1.0
    votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
    for k, (f, a, b) in enumerate(model.pairs):
        if f == family:
            votes[a if m[k] >= 0 else b] += 1
            for x, s in ((a, m[k]), (b, -m[k])):
                sums[x] += s
                least[x] = min(least[x], s)
    best = max(sorted(names), key=lambda x: (votes[x], sums[x]))
    return best, float(1 / (1 + np.exp(-np.clip(3 * least[best], -50, 50))))


def likeness(model: Model, lang: str, m: np.ndarray, n: int) -> float:
    """Near 1 for texts whose mean log probability is usual for their length in the language, near 0 for those more than ``SPREADS`` spreads below it."""
    middle, a, b = model.usual[lang]
    z = (m[len(model.pairs) + sorted(model.usual).index(lang)] - middle) / np.sqrt(a + b / n + 1e-6)
    return float(1 / (1 + np.exp(-np.clip(z + SPREADS, -50, 50))))


def decide(model: Model, m: np.ndarray, n: int) -> tuple[str, float]:
    family, p = _vote(sorted(model.families), "", model, m)
    lang, q = _vote(model.families[family], family, model, m)
    return lang, p * q * likeness(model, lang, m, n)


def identify(docs: DataFrame, model: Model, keep: list[str | Column] | None = None, text: str = "text") -> DataFrame:
    """keep's columns (or, without, the whole row as one column ``row``) with lang_pred and score for every row of docs."""
    inside = keep is None
    kept = docs.select(F.struct("*").alias("row")) if inside else apart(docs.select(F.col(text).alias("_langid_text"), *keep), ("lang_pred", "score"))
    names = kept.schema.fields[0 if inside else 1 :]
    schema = StructType([*names, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        for b in slices(batches):
            texts = (pc.struct_field(b.column(0), text) if inside else b.column(0)).to_pylist()
            if model.weights is None:
                found = [(UNKNOWN, 0.0)] * len(texts)
            else:
                m, n = margins(texts, model)
                found = [decide(model, m[i], int(n[i])) if n[i] else (UNKNOWN, 0.0) for i in range(len(texts))]
            cols = [b.column(i) for i in range(0 if inside else 1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.names)

    return kept.mapInArrow(run, schema)
