"""Toxicity by weak supervision: voters, a generative model of their accuracies and correlations, a linear classifier."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ship
from .chunks import Memo

_WORD = re.compile(r"\w+")
#: Plain insults, the voter that needs no label.
INSULTS = frozenset("idiot moron scum loser stupid worthless clown trash pathetic disgusting".split())


def marks(word: str) -> list[str]:
    """What a word may be known by: itself, how it begins (inflections share a stem) and how it ends."""
    return [f"={word}", *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) >= n), *(f"-{word[-n:]}" for n in (4, 5) if len(word) > n)]


@dataclass
class LabelModel:
    """How often each voter fires on toxic and on clean rows, how much it counts beside voters it agrees with, the prior."""

    fires: np.ndarray  # 2 x voters
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        gain = np.log(self.fires[1]) - np.log(self.fires[0])
        logit = np.log(self.prior / (1 - self.prior)) + votes @ (gain * self.weight)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation-maximisation over votes (rows x voters, 1: fires, 0: abstains) from a first guess of the posterior.

    A voter that doesn't fire abstains, which says nothing: a lexicon knows one language's words, not the others'.
    Voters are not independent given the label: stems and words of one family fire together. The correlation of what
    the label leaves unexplained of two voters lowers the weight of both, to the share of own evidence each has.
    """
    n, p = votes.shape[0], start
    prior = float(np.clip(start.mean(), 1 / (n + 2), 1 - 1 / (n + 2)))  # that of the labels: unnamed toxicity isn't guessed at
    weight = np.ones(votes.shape[1])
    model = LabelModel(np.zeros((2, 0)), weight, 0.5)
    for step in range(rounds):
        mass = np.array([(1 - p).sum(), p.sum()])
        fires = np.stack([(1 - p) @ votes + 0.05, p @ votes + 0.5]) / (mass[:, None] + 1.0)
        model = LabelModel(np.clip(fires, 1e-5, 1 - 1e-5), weight, prior)
        if step in (5, 15):
            rest = votes - np.outer(1 - p, model.fires[0]) - np.outer(p, model.fires[1])
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            agree = np.clip((rest.T @ rest) / n / np.outer(spread, spread), 0, 1)
            np.fill_diagonal(agree, 1)
            weight = 1 / (agree**2).sum(1)
            model.weight = weight
        p = model.posterior(votes)
    return model


@dataclass
class Toxicity:
    """The linear classifier: a weight for each mark it knows."""

    weight: dict[str, float]
    bias: float

    def word(self, word: str) -> tuple[str, ...]:
        return tuple(m for m in marks(word) if m in self.weight)

    def score(self, found: set[str]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(map(self.weight.__getitem__, found)), -40, 40))))


def _gain(hot: np.ndarray, cold: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood gained by giving each mark its own share of hot rows; negative where that is below the common one."""
    n = np.maximum(hot + cold, 1)
    own = np.clip(hot / n, 1e-9, 1 - 1e-9)
    return np.sign(own - share) * (hot * np.log(own / share) + cold * np.log((1 - own) / (1 - share)))


def train(rows: Iterable[tuple[list[str], int]], voters: int = 120, features: int = 800, least_share: float = 0.9) -> Toxicity:
    """Fit on (distinct words, label) rows; voters are marks whose rows are toxic in at least ``least_share``. Without rows of both labels the fixed insults alone decide.

    Rows are taken one by one; what is held of one is the numbers of its marks, and a byte for each mark of the classifier."""
    # Marks as numbers, one array for a row: a few bytes for each mark of each row.
    number: dict[str, int] = {}
    of_word: dict[str, np.ndarray] = {}
    sets, labels = [], []
    for words, label in rows:
        for w in words:
            if w not in of_word:
                of_word[w] = np.array([number.setdefault(m, len(number)) for m in marks(w)], np.int32)
        sets.append(np.unique(np.concatenate([of_word[w] for w in words])) if words else np.zeros(0, np.int32))
        labels.append(label)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Toxicity({f"={w}": 6.0 for w in INSULTS}, -3.0)
    names = [*number]
    del of_word

    def tally(chosen: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), np.int64)
        for s, c in zip(sets, chosen, strict=True):
            if c:
                out[s] += 1
        return out

    def table(marked: list[int], more: int, kind: type = float) -> np.ndarray:
        at = np.full(len(names), -1)
        at[marked] = np.arange(len(marked))
        out = np.zeros((len(sets), len(marked) + more), kind)
        for i, s in enumerate(sets):
            found = at[s]
            out[i, found[found >= 0]] = 1
        return out

    toxic, clean = tally(y == 1), tally(y == 0)
    # Voters: marks that speak for toxicity more than any of so many marks would by chance, the strongest first.
    sure = np.log(len(names) + 1) + 2
    gain = _gain(toxic, clean, y.mean())
    right = toxic >= least_share * (toxic + clean)
    best = sorted(np.flatnonzero((gain > sure) & right).tolist(), key=lambda m: (-gain[m], names[m]))[:voters]
    votes = table(best, 4)
    insults = np.array([number[f"={w}"] for w in sorted(INSULTS) if f"={w}" in number], np.int32)
    votes[:, -4] = [np.isin(s, insults).any() for s in sets]
    # Voters for clean: no other voter fires. The given labels are two voters, with accuracies estimated like others'.
    votes[:, -3], votes[:, -2], votes[:, -1] = ~votes.any(1), y, 1 - y
    p = fit_label_model(votes, 0.02 + 0.96 * y).posterior(votes)
    # The classifier sees the marks that tell posterior toxic from clean rows, again beyond chance, and the fixed insults.
    hot = tally(p > 0.5)
    gain = np.abs(_gain(hot, toxic + clean - hot, float(np.clip((p > 0.5).mean(), 1e-6, 1 - 1e-6))))
    gain[insults] = np.maximum(gain[insults], sure + 1)
    chosen = sorted(np.flatnonzero(gain > sure).tolist(), key=lambda m: (-gain[m], names[m]))[:features]
    x = table(chosen, 1, np.uint8)
    x[:, -1] = 1
    parts = [slice(at, at + 500) for at in range(0, len(x), 500)]
    w = np.zeros(len(chosen) + 1)
    ridge = np.full(len(w), 0.005)
    ridge[-1] = 1e-6
    for _ in range(12):  # Newton's steps of a ridge logistic regression on soft labels
        hessian, slope = np.diag(ridge + 1e-6), -ridge * w
        for part in parts:
            some = x[part].astype(float)
            q = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            hessian += (some * (q * (1 - q))[:, None]).T @ some
            slope += some.T @ (p[part] - q)
        w += np.linalg.solve(hessian, slope)
    return Toxicity({names[m]: float(w[i]) for i, m in enumerate(chosen)}, float(w[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", train_rows: int = 5000) -> DataFrame:
    """The documents of at most ``train_rows`` labels, those of the lowest id hashes, with their label.

    The labels are chosen before they meet the documents: so few rows go to every task, and no text is shuffled.
    """
    few = labels.where(F.col(label).isin(0, 1)).select(doc_id, label).orderBy(F.xxhash64(doc_id), doc_id, label).limit(train_rows)
    return docs.join(F.broadcast(few), doc_id)


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", train_rows: int = 5000) -> Toxicity:
    """A classifier from at most ``train_rows`` labelled rows, those of the lowest text hashes; null labels are left out.

    Tasks reduce texts to their distinct words before these come to the driver; the trained model is a few hundred
    weights. Null and empty texts are rows without words.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("int").alias("y")).where("y IN (0, 1)")
    # The order is by hash first, so that the texts themselves are only compared where hashes are equal.
    key = F.xxhash64("text")
    bound = rows.select(key.alias("k")).orderBy("k").limit(train_rows).agg(F.max("k"), F.count("*")).first()
    sample = rows.where(key <= F.lit(bound[0])) if bound[1] == train_rows else rows

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(set(_WORD.findall((t or "").lower())))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(1), batch.column(2)], names=["words", "y", "k"])

    got = sample.select("text", "y", key.alias("k")).mapInArrow(words, "words string, y int, k long").orderBy("k", "words", "y").limit(train_rows).toArrow()
    return train(_pairs(got))


def _pairs(got: pa.Table) -> Iterator[tuple[list[str], int]]:
    """The rows' words and labels, a few rows at a time."""
    for batch in got.to_batches(200):
        for words, y in zip(batch.column("words").to_pylist(), batch.column("y").to_pylist(), strict=True):
            yield words.split(" ") if words else [], y


def toxicity(docs: DataFrame, model: Toxicity, text: str = "text", threshold: float = 0.5, most_words: int = 500_000) -> DataFrame:
    """Every row with score (0 to 1) and predicted (1 from ``threshold`` on), from its whole text alone.

    Null and empty texts get the classifier's base score. Columns of these two names are replaced; repeated rows stay.
    Nothing is shuffled; the model is a few hundred weights.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    flat = docs.select(*[f"`{c}`" for c in kept])
    place = kept.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda new: [model.word(w) for w in new], (), most_words)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                said = [set(_WORD.findall((t or "").lower())) for t in part.column(place).to_pylist()]
                memo.learn(said)
                score = [model.score({m for found in map(memo.__getitem__, s) if found for m in found}) for s in said]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())],
                                                 names=[*kept, "score", "predicted"])

    schema = T.StructType([*flat.schema.fields]).add("score", "double").add("predicted", "integer")
    return flat.mapInArrow(work, schema)
