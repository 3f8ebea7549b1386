"""A counterfactual-regularised toxicity classifier.

Features are whether a text holds a word, or one, two or four distinct words with the same first letters. Identity terms are swapped in the labelled texts
that hold them, and the change of the score is penalised, so that naming a group does not make a text toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import stored

# Bounds of training: labelled rows (a sample by hash beyond) and features kept.
MOST_ROWS, MOST_FEATURES = 20_000, 4_096
# Least chi-square of a feature: above what the best of a hundred thousand chance words reaches.
CHI = 25.0
PREFIXES, SEVERAL = (3, 4, 5, 6, 7, 8), (2, 4)
THRESHOLD = 0.3

# Groups of identity terms that stand for each other.
IDENTITY_TERMS = (
    "women men girls boys woman man".split(),
    "muslims christians jews hindus buddhists atheists muslim christian jewish".split(),
    "gay lesbian straight bisexual transgender".split(),
    "black white asian latino african european".split(),
    "immigrants refugees foreigners natives locals".split(),
    "disabled blind deaf elderly young".split(),
    "femmes hommes musulmans chrétiens juifs étrangers".split(),
    "frauen männer muslime christen juden ausländer".split(),
    "mujeres hombres musulmanes cristianos judíos extranjeros".split(),
)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text."""
    return set(_WORD.findall(text.lower())) if text else set()


def starts_of(word: str) -> list[str]:
    return ["^" + word[:n] for n in PREFIXES if len(word) > n]


def features_of(words: set[str]) -> set[str]:
    """The words, their first letters, and ``2^..``, ``4^..`` where several words share these."""
    starts = Counter(p for w in words for p in starts_of(w))
    found = words | starts.keys()
    return found.union(f"{k}{p}" for p, n in starts.items() for k in SEVERAL if n >= k)


def swapped(words: set[str], groups=IDENTITY_TERMS) -> list[set[str]]:
    """The word set with the identity terms of one group exchanged for every other term of it, and for none.

    Exchanges alone would let all terms of a group become toxic alike; the text without them stands for no group.
    """
    out = []
    for group in groups:
        named = words.intersection(group)
        if named:
            out += [(words - named) | {other} for other in group if other not in named] + [words - named]
    return out


@dataclass
class Model:
    """Weights by feature; ``score`` is the logistic function of their sum."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.starts = {f.lstrip("24") for f in self.weights if "^" in f}

    def of_word(self, word: str) -> tuple[str, ...]:
        """The word and its first letters, as far as they are features."""
        return tuple(f for f in (word, *starts_of(word)) if f in self.weights or f in self.starts)


class _Memo(dict):
    """Word to its weighted features, forgotten when too many words were seen."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        value = self[word] = self.model.of_word(word)
        return value


def score(model: Model, text: str | None, memo: _Memo) -> float:
    found = Counter(f for w in words_of(text) for f in memo[w])
    total = model.bias
    for f, n in found.items():
        total += model.weights.get(f, 0.0)
        if n > 1 and f[0] == "^":
            total += sum(model.weights.get(f"{k}{f}", 0.0) for k in SEVERAL if n >= k)
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _fit(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int,
         penalty: float, ridge: float, rounds: int) -> np.ndarray:
    """Logistic regression over sets of feature numbers, with the squared score change of ``pairs`` added.

    Nesterov's accelerated gradient with a step from a bound of the curvature; the last weight is the bias.
    """
    lens = np.array([len(r) for r in rows])
    flat, whose = np.concatenate([*rows, np.empty(0, int)]).astype(int), np.repeat(np.arange(len(rows)), lens)
    sign = [(np.concatenate([a, b]), np.concatenate([np.ones(len(a)), -np.ones(len(b))])) for a, b in pairs]
    p_flat = np.concatenate([*(s[0] for s in sign), np.empty(0, int)]).astype(int)
    p_val = np.concatenate([*(s[1] for s in sign), np.empty(0)])
    p_whose = np.repeat(np.arange(len(sign)), [len(s[0]) for s in sign]).astype(int)
    weight = 1 / max(1, len(rows))

    def times(v: np.ndarray, of_rows) -> np.ndarray:
        """The gradient of a loss of the rows' sums plus ridge and penalty, all linear in the weights but ``of_rows``."""
        error = weight * of_rows(np.bincount(whose, v[flat], len(rows)) + v[n])
        grad = np.append(np.bincount(flat, error[whose], n) + ridge * v[:n], error.sum())
        if len(sign):
            d = np.bincount(p_whose, p_val * v[p_flat], len(sign)) / len(sign)
            grad[:n] += penalty * np.bincount(p_flat, p_val * d[p_whose], n)
        return grad

    # The step comes from the largest curvature, found by power iteration.
    w = np.random.default_rng(5).standard_normal(n + 1)
    for _ in range(30):
        w = times(w / np.linalg.norm(w), lambda z: 0.25 * z)
    step, w, v = 0.9 / np.linalg.norm(w), np.zeros(n + 1), np.zeros(n + 1)
    for k in range(rounds):
        grad = times(v, lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        new = v - step * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def train(
    labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
    penalty: float = 10.0, ridge: float = 1e-4, rounds: int = 1000, most_rows: int = MOST_ROWS,
) -> Model:
    """Fit on at most ``most_rows`` labelled rows in expectation, a sample by hash of id and text beyond that.

    Rows with a null label are left out. Candidate features are counted by Spark over all these rows; the most
    telling ones (largest chi-square) and all identity terms are fitted on the driver, whose memory the two
    bounds above limit. With labels of one kind only, the model is a constant.
    """
    rows = labelled.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
        F.col(label_col).cast("double").alias("_y"),
    ).filter("_y is not null")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, pos = Counter(), Counter()

        def told() -> Iterator[pd.DataFrame]:
            names = list(n)
            for s in range(0, len(names), 50_000):
                part = names[s:s + 50_000]
                yield pd.DataFrame({
                    "f": pd.Series(part, dtype=object), "n": [n[f] for f in part], "p": [pos[f] for f in part],
                })

        for frame in batches:
            for text, y in zip(frame["_text"], frame["_y"]):
                found = features_of(words_of(text))
                n.update(found)
                if y > 0:
                    pos.update(found)
            if len(n) > 500_000:
                yield from told()
                n.clear()
                pos.clear()
        yield from told()

    totals = rows.agg(F.count("*"), F.sum("_y")).first()
    size, positive = int(totals[0]), float(totals[1] or 0)
    if not size or positive in (0, size):
        return Model(bias=8.0 if size and positive else -8.0)
    rate = positive / size
    least = max(3, size // 600)
    expected = F.col("n") * rate
    table = (
        rows.select("_text", "_y").mapInPandas(counted, "f string, n bigint, p bigint").groupBy("f")
        .agg(F.sum("n").alias("n"), F.sum("p").alias("p")).filter(F.col("n") >= least)
        .withColumn("chi", (F.col("p") - expected) ** 2 / (expected * (1 - rate)))
        .filter(F.col("chi") >= CHI).orderBy(F.desc("chi"), "f").limit(MOST_FEATURES).select("f").collect()
    )
    terms = sorted({t for group in IDENTITY_TERMS for t in group})
    names = list(dict.fromkeys([*(r["f"] for r in table), *terms]))
    number = {f: k for k, f in enumerate(names)}
    known_terms = {t for group in IDENTITY_TERMS for t in group}

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for text in frame["_text"]:
                words = words_of(text)
                own = sorted(number[f] for f in features_of(words) if f in number)
                # Swaps are bounded by the table of terms; only the features that change are kept.
                other = [
                    sorted(number[f] for f in features_of(w) if f in number) for w in swapped(words)
                ] if words & known_terms else []
                out.append((own, other))
            yield pd.DataFrame({"x": [o[0] for o in out], "swaps": [o[1] for o in out], "y": frame["_y"]})

    found = rows.select("_text", "_y").mapInPandas(listed, "x array<int>, swaps array<array<int>>, y double").collect()
    x = [np.array(r["x"], int) for r in found]
    y = np.array([min(1.0, max(0.0, r["y"])) for r in found])
    pairs = []
    for row, own in zip(found, x):
        for other in row["swaps"]:
            other = np.array(other, int)
            gone, come = np.setdiff1d(own, other), np.setdiff1d(other, own)
            if len(gone) or len(come):
                pairs.append((gone, come))
    w = _fit(x, y, pairs, len(names), penalty, ridge, rounds)
    return Model(float(w[-1]), {f: float(w[k]) for f, k in number.items() if abs(w[k]) > 1e-4})


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score``; reads the text alone, null and empty texts included."""
    @F.pandas_udf("double")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Memo(model)
        for texts in batches:
            yield pd.Series([score(model, t, memo) for t in texts], dtype=float)

    return docs.withColumn("_score", of_text(F.col(text_col).cast("string")))


def learnable(id_col: Column) -> Column:
    """Rows whose label may be learnt: the CRC-32 of the id as text, modulo 4, is not 2. A null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2


def toxicity_model(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id") -> Model:
    """Train on the labelled rows of ``docs``, held-out ids excepted.

    Where there are more than ``most_rows`` labels, ids are sampled by hash, so the labels that are broadcast to the
    texts, and all of training, have a fixed bound. Contradicting labels of one id count as the larger one.
    """
    known = labels.select(F.col("doc_id").alias("_lid"), F.col("toxic").alias("_toxic")).filter(
        F.col("_lid").isNotNull() & F.col("_toxic").isNotNull() & learnable(F.col("_lid"))
    ).groupBy("_lid").agg(F.max("_toxic").alias("_toxic"))
    total = known.count()
    if total > most_rows:
        known = known.filter(F.pmod(F.xxhash64("_lid", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * most_rows / total))
    joined = docs.join(F.broadcast(known), F.col(id_col) == F.col("_lid")).select(
        F.col(id_col).alias("_id"), F.col("text").alias("_t"), "_toxic"
    )
    return train(stored(joined, "labelled"), "_t", "_toxic", "_id", most_rows=most_rows)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``_held_out``, ``_score`` and ``_predicted`` (1 if the score reaches ``threshold``).

    Every row is scored from its whole text; null and empty texts get the score of a text without words. Ids may be
    null or repeated. An empty table gives an empty result; without usable labels the score is a constant.
    """
    model = toxicity_model(docs, labels, id_col=id_col)
    return scored(docs, model, id_col).withColumn("_held_out", ~learnable(F.col(id_col))).withColumn(
        "_predicted", (F.col("_score") >= threshold).cast("int")
    )
