"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

Both dictionaries hold the words that most ordinary documents share; each also holds the words and word
pieces that its own class has far more often than the other. A window (by default one word between blanks)
is compressed with each, and the bytes that the toxic dictionary saves are its gain. Log ratios of the gains by
window length, counted on other labelled rows than the dictionaries came from, turn a document's windows into a
few figures, and a logistic curve calibrates those to a score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm.common import fit_logistic, is_held_out, labelled_sample, logistic_score, opened, query, ship, table

# Labelled rows learnt from, and dictionary bytes that both classes share.
FIT_ROWS, SHARED_BYTES = 16000, 4000
# A class's own segment, of which its dictionary holds all: they are as many as FIT_ROWS documents can give: at least so many of its documents, so much more frequent than in the other class.
LEAST_DOCS, LEAST_RATIO, LEAST_EVIDENCE, PIECE_BYTES = 4, 3.0, 12.0, 6
WINDOW_WORDS, LEVEL = 1, 6
PREDICT_AT = 0.3

# zstandard looks for no match in the last 8 bytes of a block and stores blocks raw that shrink by less than
# 3 bytes, so each window is followed by a text that both dictionaries end with.
_TAIL = b"#0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_LONGEST, _LEAST_GAIN, _MOST_GAIN = 16, -4, 12
_MEMO = 150_000


def words(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


def segments(text: bytes | None) -> set[bytes]:
    """Distinct words and their pieces of PIECE_BYTES bytes."""
    found = set(words(text))
    for word in list(found):
        found.update(word[i:i + PIECE_BYTES] for i in range(len(word) - PIECE_BYTES))
    return {s for s in found if 4 <= len(s) <= 40}


class WindowCoder:
    """Compressed window lengths under two dictionaries, remembered for the latest distinct windows."""

    def __init__(self, shared: list[bytes], toxic: list[bytes], ordinary: list[bytes]):
        self.shared, self.toxic, self.ordinary = shared, toxic, ordinary
        self._coders, self._memo = None, {}

    def __getstate__(self):
        return self.shared, self.toxic, self.ordinary

    def __setstate__(self, state):
        self.__init__(*state)

    @staticmethod
    def _coder(parts: list[bytes]) -> zstandard.ZstdCompressor:
        content = b" " + b" ".join([*parts, _TAIL]) + b" "
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, window_log=max(16, (len(content) + 256).bit_length()), write_content_size=False, write_checksum=False, write_dict_id=False)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)

    def gain(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves against the ordinary one."""
        known = self._memo.get(window)
        if known is None:
            if self._coders is None:
                self._coders = self._coder(self.shared + self.ordinary), self._coder(self.shared + self.toxic)
            if len(self._memo) >= _MEMO:
                self._memo.clear()
            block = b" " + window + b" " + _TAIL
            plain, toxic = (len(c.compress(block)) for c in self._coders)
            known = self._memo[window] = plain - toxic
        return known

    def cells(self, text: bytes | None) -> np.ndarray:
        """Per window: its cell in the (length, gain) table."""
        found = words(text)
        if WINDOW_WORDS > 1:
            found = [b" ".join(found[i:i + WINDOW_WORDS]) for i in range(0, len(found), WINDOW_WORDS)]
        gain = np.fromiter(map(self.gain, found), np.int64, len(found))
        length = np.fromiter(map(len, found), np.int64, len(found))
        wide = _MOST_GAIN - _LEAST_GAIN + 1
        return np.minimum(length // WINDOW_WORDS, _LONGEST) * wide + np.clip(gain, _LEAST_GAIN, _MOST_GAIN) - _LEAST_GAIN


_CELLS = (_LONGEST + 1) * (_MOST_GAIN - _LEAST_GAIN + 1)


class ToxicityModel:
    def __init__(self, coder: WindowCoder, ratio: np.ndarray, curve):
        self.coder, self.ratio, self.curve = coder, ratio, curve

    def figures(self, text: bytes | None) -> list[float]:
        """Mean, scaled sum, largest and top-three mean of the windows' log ratios, share of high ones, log count."""
        value = self.ratio[self.coder.cells(text)]
        n = len(value)
        if n == 0:
            return [0.0] * 7
        top = np.sort(value)[-3:]
        return [float(value.mean()), float(value.sum() / np.sqrt(n)), float(top[-1]), float(top.mean()),
                float((value > 1.0).sum() / np.sqrt(n)), float((value > 1.0).mean()), float(np.log1p(n))]

    def scores(self, texts: pd.Series) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return logistic_score(np.array([self.figures(t) for t in texts]), self.curve)


def _packed(ranked: list[bytes], size: int) -> list[bytes]:
    """The first segments that fit, best last: near matches cost least."""
    out, used = [], 0
    for segment in ranked:
        if used + len(segment) + 1 > size:
            continue
        out.append(bytes(segment))
        used += len(segment) + 1
    return out[::-1]


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for text, label in zip(frame["text"], frame["label"]):
            found, whole = segments(text), set(words(text))
            yield pd.DataFrame({"segment": list(found), "whole": [s in whole for s in found],
                                "label": np.full(len(found), label, "int32")})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: Callable[[str], Column] | None = None,
        rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from at most `rows` labelled documents that `held_out` (id column name -> boolean) leaves.

    Spark counts segments by class on three fifths of the sample and gains by class on the rest; the driver gets
    the ranked segments that fit the dictionaries, a table of a few hundred counts and seven figures a row. Without
    rows of both classes every score is the smoothed share of label 1.
    """
    keep_out = held_out or (lambda _name: F.lit(False))
    sample = land(labelled_sample(docs, labels, label, rows, keep_out, id_col, text_col), "toxicity-sample")
    spark = docs.sparkSession
    fold = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(5))
    first, second = sample.filter(fold < 3), sample.filter(fold >= 3)
    totals = {r["label"]: r["n"] for r in first.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    counted = (first.mapInPandas(_exploded, "segment binary, whole boolean, label int").groupBy("segment")
               .agg(F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0"), F.max("whole").alias("whole")))
    counted = land(counted.filter(F.col("c1") + F.col("c0") >= LEAST_DOCS), "toxicity-segments")

    def typical(own: str, other: str, n_own: int, n_other: int) -> list[bytes]:
        ratio = ((F.col(own) + 0.5) / (n_own + 1.0)) / ((F.col(other) + 0.5) / (n_other + 1.0))
        evidence = F.col(own) * F.log(ratio)
        ranked = (counted.filter((F.col(own) >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (evidence >= LEAST_EVIDENCE))
                  .orderBy(-evidence, "segment"))
        return [bytes(r["segment"]) for r in ranked.collect()][::-1]

    shared = [r["segment"] for r in counted.filter("whole").orderBy(F.col("c0").desc(), "segment").limit(SHARED_BYTES // 5).collect()]
    coder = WindowCoder(_packed(shared, SHARED_BYTES), typical("c1", "c0", n1, n0), typical("c0", "c1", n0, n1))
    told = ship(spark, coder)

    def cell_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, _CELLS), np.int64)
        for frame in batches:
            for text, is_toxic in zip(frame["text"], frame["label"]):
                total[is_toxic] += np.bincount(opened(told).cells(text), minlength=_CELLS)
        kind, cell = np.nonzero(total)
        yield pd.DataFrame({"label": kind.astype("int32"), "cell": cell.astype("int32"), "n": total[kind, cell]})

    table_ = np.zeros((2, _CELLS))
    for r in second.mapInPandas(cell_counts, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect():
        table_[r["label"], r["cell"]] = r["n"]
    share = (table_ + 0.5) / (table_.sum(1, keepdims=True) + 0.5 * _CELLS)
    model = ToxicityModel(coder, np.log(share[1]) - np.log(share[0]), None)
    half = ship(spark, model)

    def figure_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"id": frame["id"].astype("int64"), "label": frame["label"], "x": [opened(half).figures(t) for t in frame["text"]]})

    rows_ = second.withColumn("id", F.xxhash64("id")).mapInPandas(figure_rows, "id long, label int, x array<double>").orderBy("id").toPandas()
    x = np.array(rows_["x"].tolist()).reshape(-1, 7)
    model.curve = fit_logistic(x, rows_["label"].to_numpy(float))
    told.unpersist()
    half.unpersist()
    return model


def score_column(model: ToxicityModel, docs: DataFrame, text_col: str = "text") -> Column:
    """The score of each whole text as a column of `docs`; a NULL text counts as empty."""
    shared = ship(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(opened(shared).scores(texts))

    return score(F.coalesce(docs[text_col], F.lit("")).cast("binary"))


@query("op6_compression_distance")
def op6(spark, sf_dir):
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are never read."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out=lambda name: is_held_out(name, 4, 2))
    scored = docs.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), score_column(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
