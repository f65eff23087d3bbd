"""Quality classifier: naive Bayes support vectors.

The indicators of word and punctuation uni- and bigrams are scaled by the classes' log-count ratio, and a
linear model with hinge loss is fitted to the scaled rows by dual coordinate descent. The weights are
drawn towards their mean magnitude (Wang and Manning), and a logistic curve fitted on rows that the
descent did not see turns the margin into a score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm.common import (fit_logistic, is_held_out, labelled_sample, logistic_score, opened, query, ship, table)

# Bounds and settings of the fit: labelled rows learnt from, least document frequency of an n-gram, smoothing
# of the counts, hinge cost, passes of the descent, share of the fitted weights, every n-th row for the curve.
FIT_ROWS, LEAST_DOCS, SMOOTHING, COST, PASSES, FITTED_SHARE, CURVE_EVERY = 8000, 5, 1.0, 1.0, 12, 0.5, 4
# The contract's cut of `predicted`; the pipeline drops documents below REJECT_BELOW.
PREDICT_AT, REJECT_BELOW = 0.7, 0.5

# Terms that no word can equal: adjacent equal tokens, many of them, and mostly upper-case words.
_SAME, _MOSTLY_SAME, _SHOUTED = b"\x00same", b"\x00mostly same", b"\x00shouted"
_UPPER = re.compile(rb"[A-Z]{2,}")
_TOKEN = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^\x00-\x20a-z0-9\x80-\xff]+")


def terms(text: bytes | None) -> set[bytes]:
    """Distinct uni- and bigrams of words, numbers and punctuation runs (A-Z lower-cased) and of their shapes."""
    text = text or b""
    tokens = _TOKEN.findall(text.lower())
    found = set(tokens)
    found.update(map(b" ".join, zip(tokens, tokens[1:])))
    same = sum(map(eq, tokens, tokens[1:]))
    if same:
        found.add(_SAME)
    if 5 * same > len(tokens):
        found.add(_MOSTLY_SAME)
    if 3 * len(_UPPER.findall(text)) > len(tokens) > 3:
        found.add(_SHOUTED)
    return found


def hinge_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, cost: float = COST,
                  passes: int = PASSES, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of min |w|^2/2 + cost * sum of hinge losses, by dual coordinate descent.

    `rows` holds (distinct positions, values); y is -1 or 1. The bias is a feature of value 1.
    """
    weights, alpha = np.zeros(width + 1), np.zeros(len(rows))
    diagonal = [float(v @ v) + 1.0 for _, v in rows]
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            gradient = y[i] * (weights[at] @ value + weights[-1]) - 1.0
            moved = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost) - alpha[i]
            if moved:
                alpha[i] += moved
                weights[at] += moved * y[i] * value
                weights[-1] += moved * y[i]
    return weights


@dataclass
class QualityModel:
    """Term positions, per-term summand and squared scale, bias, and the score curve."""

    position: dict[bytes, int]
    summand: np.ndarray
    square: np.ndarray
    bias: float
    curve: tuple[np.ndarray, np.ndarray, np.ndarray]

    def margin(self, text: bytes | None) -> float:
        position = self.position
        at = [position[t] for t in terms(text) if t in position]
        if not at:
            return self.bias
        return float(self.summand[at].sum() / np.sqrt(self.square[at].sum())) + self.bias

    def scores(self, texts: pd.Series) -> np.ndarray:
        margins = np.fromiter((self.margin(t) for t in texts), float, len(texts))
        return logistic_score(margins[:, None], self.curve)


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for text, label in zip(frame["text"], frame["label"]):
            found = list(terms(text))
            yield pd.DataFrame({"term": found, "label": np.full(len(found), label, "int32")})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: Callable[[str], Column] | None = None,
        rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Learn from at most `rows` labelled documents that `held_out` (id column name -> boolean) leaves.

    Spark counts the n-grams of the sample by class; the driver sees the n-grams found in LEAST_DOCS
    documents of the sample and their positions in its rows, both bounded by `rows`. Without rows of both
    classes every score is the smoothed share of label 1.
    """
    keep_out = held_out or (lambda _name: F.lit(False))
    sample = land(labelled_sample(docs, labels, label, rows, keep_out, id_col, text_col), "quality-sample")
    spark = docs.sparkSession
    counts = (sample.mapInPandas(_exploded, "term binary, label int").groupBy("term")
              .agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
              .filter(F.col("good") + F.col("bad") >= LEAST_DOCS).orderBy("term").toPandas())
    good, bad = counts["good"].to_numpy(float) + SMOOTHING, counts["bad"].to_numpy(float) + SMOOTHING
    position = {bytes(t): i for i, t in enumerate(counts["term"])}
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum()) if len(counts) else np.zeros(0)
    shared = spark.sparkContext.broadcast(position)

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = shared.value
        for frame in batches:
            at = [np.array(sorted(where[t] for t in terms(x) if t in where), "int32").tobytes() for x in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "at": at})

    found = sample.mapInPandas(positions, f"id {sample.schema['id'].dataType.simpleString()}, label int, at binary").orderBy("id").toPandas()
    shared.unpersist()
    y = found["label"].to_numpy(float)
    at = [np.frombuffer(b, "int32") for b in found["at"]]
    curve_row = np.arange(len(y)) % CURVE_EVERY == 0
    if len(y) == 0 or y.min() == y.max():
        empty = np.zeros((0, 1))
        curve = fit_logistic(np.zeros((len(y), 1)) if len(y) else empty, y)
        return QualityModel({}, np.zeros(0), np.zeros(0), 0.0, curve)
    scaled = []
    for a in at:
        value = ratio[a]
        norm = np.sqrt(value @ value)
        scaled.append((a, value / norm if norm > 0 else value))
    learn = np.flatnonzero(~curve_row)
    weights = hinge_descent([scaled[i] for i in learn], np.where(y[learn] == 1, 1.0, -1.0), len(ratio))
    fitted, bias = weights[:-1], float(weights[-1])
    drawn = (1 - FITTED_SHARE) * np.abs(fitted).mean() * np.sign(fitted) + FITTED_SHARE * fitted
    model = QualityModel(position, ratio * drawn, ratio * ratio + 1e-18, bias, (np.zeros(1), np.ones(1), np.array([1.0, 0.0])))
    held = np.flatnonzero(curve_row)
    margins = np.array([(model.summand[at[i]].sum() / np.sqrt(model.square[at[i]].sum()) if len(at[i]) else 0.0) + bias for i in held])
    model.curve = fit_logistic(margins[:, None], y[held], l2=1e-2)
    return model


def score_column(model: QualityModel, docs: DataFrame, text_col: str = "text") -> Column:
    """The score of each whole text as a column of `docs`; a NULL text counts as empty."""
    shared = ship(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(opened(shared).scores(texts))

    return score(F.coalesce(docs[text_col], F.lit("")).cast("binary"))


@query("op7_nb_support_vectors")
def op7(spark, sf_dir):
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are never read."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out=lambda name: is_held_out(name, 4, 2))
    scored = docs.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), score_column(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
