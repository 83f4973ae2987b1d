"""Toxicity by a subsequence string kernel and a support vector machine with Nyström landmarks.

The kernel compares two words by the letter subsequences they share: four letters in order, word
ends included, within a span of six, each weighted by decay per letter of span. A letter put in
or left out, punctuation inside a word and letters spaced apart so change little. A sentence is
judged by its worst words, a text by its worst sentence and by the sum and density of all of them.

The machine is trained on the words of labelled texts, not on their sentences, so that sentences that
are toxic only as a whole are not told apart. Words of clean texts are clean. Of each
toxic text the word that the present machine finds worst stands for its toxic sentences, and so
do words that several toxic texts share and no clean one has; a few rounds of choosing and
training settle which. A toxic text in which nothing is found, as happens to wrong labels, teaches
nothing. Last, they also train with a letter put in. Words are mapped to the span
of the landmarks (Nyström), where the squared-hinge machine is solved by Newton steps. As the
kernel has explicit features, the trained machine folds into one weight per subsequence, so that
scoring reads a table instead of comparing with every landmark.

Defined results: null, empty and letterless texts get the score of a text without any known
subsequence. Long texts are scored whole, in slices of bounded size cut between words. Repeated
rows are scored alike; other columns pass through. Without labels of both kinds all scores are 0.

Fitting reads a bounded sample: at most about ``sample_bytes`` of toxic and three times as much of
clean texts, whole ones taken by a hash of the text, each no longer than an eighth of the clean part. Scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.llm.common import _tables, code_points, mix, shingle_set
from airmetrics.llm.jaccard_join import tree_keys

LETTERS = 4
SPAN = 6
DECAY = 0.7
TABLE = 1 << 20
LANDMARKS = 128
SAMPLE_BYTES = 1_500_000
#: Clean texts in the sample, as a multiple of that.
CLEAN_FACTOR = 3
ROUNDS = 4
_SLICE = 1 << 18
_SPACE = np.uint32(32)

#: Places of the letters after the first, and the weight of the span they make.
_SHAPES = [(rest, DECAY ** rest[-1]) for rest in combinations(range(1, SPAN), LETTERS - 1)]


def _spaced(text: str) -> np.ndarray:
    """Lower-cased letters, words parted by one space; runs of single letters joined."""
    lower, word = _tables()
    codes = code_points(text)
    kept = lower[codes]
    blank = (codes <= 32) | (codes == 0x85) | (codes == 0xA0)
    digits = (codes >= 48) & (codes <= 57)
    kept = np.where(blank, _SPACE, kept)[blank | (word[codes] & ~digits & (codes != 95))]
    kept = np.concatenate(([_SPACE], kept, [_SPACE]))
    space = kept == _SPACE
    kept = kept[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    if len(kept) > 4:
        space = kept == _SPACE
        between = np.zeros(len(kept), dtype=bool)
        between[2:-2] = space[2:-2] & space[:-4] & space[4:]
        kept = kept[~between]
    return kept


def _features(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Word numbers, table places and weight of each shape of subsequence."""
    spaces = np.cumsum(codes == _SPACE)
    wide = codes.astype(np.uint64)
    for rest, weight in _SHAPES:
        last = rest[-1]
        if len(codes) <= last:
            continue
        count = len(codes) - last
        value = wide[:count]
        for k in rest:
            value = value * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + count]
        inside = spaces[last - 1 : last - 1 + count] == spaces[:count]
        yield spaces[:count][inside] - 1, (mix(value[inside]) & np.uint64(TABLE - 1)).astype(np.int64), weight


def _slices(text: str | None) -> Iterator[np.ndarray]:
    at, text = 0, text or ""
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield _spaced(text[at:end])
        at = end


def _word_margins(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    count = int(np.count_nonzero(codes == _SPACE))
    total, square = np.zeros(count), np.zeros(count)
    for words, places, weight in _features(codes):
        total += weight * np.bincount(words, weights=table[places], minlength=count)
        square += weight**2 * np.bincount(words, minlength=count)
    return total / np.sqrt(np.maximum(square, 1e-12))


@dataclass
class ToxicityModel:
    """Weight per subsequence, the bias, and the logistic curve from evidence to probability."""

    table: np.ndarray
    bias: float = 0.0
    slope: np.ndarray = field(default_factory=lambda: np.zeros(3))
    offset: float = -60.0

    def evidence(self, text: str | None) -> np.ndarray:
        """Of a text: the margin of its worst word, the sum of all positive ones, and their density."""
        worst, total, count = 0.0, 0.0, 0
        for codes in _slices(text):
            margins = _word_margins(codes, self.table) + self.bias
            worst, total, count = max(worst, margins.max()), total + margins[margins > 0].sum(), count + len(margins)
        return np.array([worst, np.log1p(total), np.log1p(100.0 * total / (count + 100.0))])

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.evidence(text) @ self.slope + self.offset, -60, 60))))


def _words(codes: np.ndarray) -> list[str]:
    return codes.tobytes().decode("utf-32-le", "surrogatepass").split(" ")[1:-1]


def _kernel_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, place and normalised weight of every subsequence of the words."""
    codes = code_points(" " + " ".join(words) + " ")
    none = np.empty(0, dtype=np.int64)
    parts = [(none, none, none.astype(np.float32))]
    parts += [(w, p, np.full(len(w), weight, np.float32)) for w, p, weight in _features(codes)]
    at, place, weight = (np.concatenate(x) for x in zip(*parts))
    norm = np.sqrt(np.bincount(at, weights=weight**2, minlength=len(words)))
    return at, place, (weight / np.maximum(norm, 1e-6)[at]).astype(np.float32)


def _with_a_letter(word: str) -> list[str]:
    """One letter doubled or an ``x`` put in, at every inner place."""
    return [word[:k] + letter + word[k:] for k in range(1, len(word)) for letter in (word[k - 1], "x")]


def _solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge linear machine; the last column of ``x`` is the bias."""
    weights = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    active = np.ones(len(y), dtype=bool)
    for _ in range(30):
        square, side = np.diag(keep), np.zeros(x.shape[1])
        for at in range(0, len(y), 8192):
            own = np.flatnonzero(active[at : at + 8192]) + at
            rows = x[own].astype(np.float64)
            scaled = rows * cost[own, None]
            square += scaled.T @ rows
            side += scaled.T @ y[own]
        weights = np.linalg.solve(square, side)
        now = y * (x @ weights.astype(np.float32)) < 1
        if np.array_equal(now, active):
            break
        active = now
    return weights


def _logistic(evidence: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of the likeliest logistic curve."""
    centre, scale = evidence.mean(axis=0), evidence.std(axis=0) + 1e-9
    x = np.column_stack([(evidence - centre) / scale, np.ones(len(evidence))])
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.003 * len(label))
    ridge[-1] = 1e-3
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (label - p) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = beta[:-1] / scale
    return slope, float(beta[-1] - slope @ centre)


def _once(texts: list[str | None], labels: list[int]) -> list[int]:
    """One text of each group of copies and near copies of a label, which say nothing new."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for at, (text, label) in enumerate(zip(texts, labels)):
        keys = {(label, key) for key in tree_keys(shingle_set(text), 8, 2).tolist()}
        if not keys & seen:
            kept.append(at)
        seen |= keys
    return kept


def train(texts: list[str | None], labels: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> ToxicityModel:
    """Train on a sample that fits one machine; every fourth text only calibrates."""
    once = _once(texts, labels)
    texts, labels = [texts[k] for k in once], [labels[k] for k in once]
    label = np.array(labels)
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(TABLE, np.float32))
    rank = np.zeros(len(label), dtype=int)
    for kind in (0, 1):
        rank[label == kind] = np.arange(np.count_nonzero(label == kind))
    learning = rank % 4 != 3
    own = [sorted({w for codes in _slices(t) for w in _words(codes)}) if on else [] for t, on in zip(texts, learning)]
    vocabulary = sorted({w for words in own for w in words})
    if not vocabulary:
        return ToxicityModel(np.zeros(TABLE, np.float32))
    number = {w: k for k, w in enumerate(vocabulary)}
    held = [np.array([number[w] for w in words], dtype=int) for words in own]
    seen = np.zeros((2, len(vocabulary)))
    for words, kind in zip(held, label):
        seen[kind][words] += 1
    of = [max(1, np.count_nonzero(learning & (label == kind))) for kind in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (of[1] + 1)) - np.log((seen[0] + 0.5) / (of[0] + 1))
    telling = odds * np.sqrt(seen[1])

    # Landmarks: the most telling words, and as many taken evenly from the rest.
    ordered = np.argsort(-telling, kind="stable")
    half = min(landmarks // 2, len(ordered))
    rest = ordered[half:]
    marks = np.concatenate([ordered[:half], rest[:: max(1, len(rest) // max(1, landmarks - half))][: landmarks - half]])
    at, place, weight = _kernel_rows([vocabulary[k] for k in marks])
    known, column = np.unique(place, return_inverse=True)
    if not len(known):
        return ToxicityModel(np.zeros(TABLE, np.float32))
    base = np.zeros((len(known), len(marks)), dtype=np.float32)
    np.add.at(base, (column, at), weight)
    value, vector = np.linalg.eigh((base.T @ base).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])

    def mapped(words: list[str]) -> np.ndarray:
        """The words in the span of the landmarks, with a last column for the bias."""
        x = np.ones((len(words), root.shape[1] + 1), dtype=np.float32)
        for first in range(0, len(words), 4000):
            at, place, weight = _kernel_rows(words[first : first + 4000])
            spot = np.minimum(np.searchsorted(known, place), len(known) - 1)
            hit = known[spot] == place
            kernel = np.zeros((min(4000, len(words) - first), len(marks)), dtype=np.float32)
            order = np.argsort(at[hit], kind="stable")
            rows, spots, weights = at[hit][order], spot[hit][order], weight[hit][order]
            for some in range(0, len(rows), 40_000):
                r, s, w = rows[some : some + 40_000], spots[some : some + 40_000], weights[some : some + 40_000]
                starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                kernel[r[starts]] += np.add.reduceat(base[s] * w[:, None], starts, axis=0)
            x[first : first + len(kernel), :-1] = kernel @ root
        return x

    x = mapped(vocabulary)

    toxic_texts = [words for words, kind in zip(held, label) if kind == 1 and len(words)]
    # Words far more frequent in toxic texts stand for their sentences in any case, if chance would
    # hardly bring that about for any word of the vocabulary.
    size = [sum(len(texts[k]) for k in np.flatnonzero(learning & (label == kind))) for kind in (0, 1)]
    chance = min(0.9, max(0.05, size[1] / max(1, sum(size))))
    often = (seen[1] + 0.5) / size[1] > 8 * (seen[0] + 0.5) / size[0]
    plain = often & (seen[1] - 2 * seen[0] >= np.log(len(vocabulary)) / -np.log(chance))
    clean = (seen[0] > 0) & ~plain
    margin = telling.copy()
    solved = np.zeros(x.shape[1])
    for turn in range(rounds):
        worst = np.zeros(len(vocabulary))
        for words in toxic_texts:
            top = words[np.argmax(margin[words])]
            # A toxic text in which nothing is found may be wrongly labelled.
            worst[top] += margin[top] > 0 and (turn > 0 or not plain.any())
            worst[words[plain[words]]] += 1
        positive = (worst > 0) & ~clean
        used = positive | clean
        if not positive.any():
            break
        # A word of neither kind costs nothing.
        y = np.where(positive, 1.0, -1.0)
        cost = np.where(positive, worst / worst[positive].sum() * 2000.0, used.astype(float))
        solved = _solve(x, y, cost)
        margin = x @ solved.astype(np.float32)
    if np.any(solved):
        # Virtual examples: the words settled on, each with one letter put in.
        chosen = [vocabulary[k] for k in np.flatnonzero(positive) if len(vocabulary[k]) > LETTERS]
        altered = sorted({w for word in chosen for w in _with_a_letter(word)} - {vocabulary[k] for k in np.flatnonzero(clean)})
        more = mapped(altered) if altered else x[:0]
        spread = np.full(len(altered), 5000.0 / max(1, len(altered)))
        solved = _solve(np.concatenate([x, more]), np.append(y, np.ones(len(altered))), np.append(cost, spread))
    folded = base @ (root @ solved[:-1])
    table = np.zeros(TABLE, dtype=np.float32)
    table[known] = folded
    model = ToxicityModel(table, float(solved[-1]))
    apart = ~learning if len(set(label[~learning])) == 2 else learning
    evidence = np.array([model.evidence(t) for t, on in zip(texts, apart) if on])
    model.slope, model.offset = _logistic(evidence, label[apart])
    return model


def fit(documents: DataFrame, labels: DataFrame, sample_bytes: int = SAMPLE_BYTES, **options) -> ToxicityModel:
    """Learn from ``doc_id`` and ``text``, and labels of ``doc_id`` and ``toxic`` (0 or 1).

    Null labels teach nothing; of two labels for an id the worse one counts.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = documents.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("bytes"),
        F.crc32(F.col("text").cast("binary")).alias("place"),
        "text",
    ).where(F.col("bytes").between(1, CLEAN_FACTOR * sample_bytes // 8))
    # Sizes are joined without the texts, and then only the texts that can be in the sample.
    sizes = rows.select("doc_id", "bytes").join(known, "doc_id").groupBy("toxic").agg(F.sum("bytes").alias("bytes"))
    share = {0: CLEAN_FACTOR * sample_bytes, 1: sample_bytes}
    limits = {row.toxic: int(min(1.0, share[row.toxic] / row.bytes) * (1 << 32)) for row in sizes.collect()}
    taken = F.lit(False)
    for toxic, limit in limits.items():
        taken = taken | ((F.col("toxic") == toxic) & (F.col("place") < limit))
    chosen = rows.where(F.col("place") < max(limits.values(), default=0)).join(known, "doc_id")
    sample = chosen.where(taken).select("text", "toxic").toPandas()
    sample = sample.drop_duplicates().sort_values(["toxic", "text"], kind="stable")
    return train(sample.text.tolist(), sample.toxic.tolist(), **options)


def scorer(spark: SparkSession, model: ToxicityModel):
    """A column function ``text -> score``; the model has a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            yield pd.Series([known.score(text) for text in texts], dtype="float64")

    return score


def with_toxicity(documents: DataFrame, model: ToxicityModel, text: str | Column = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` to ``documents``."""
    scored = documents.withColumn("score", scorer(documents.sparkSession, model)(text))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
