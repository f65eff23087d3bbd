import numpy as np
import pandas as pd
import pytest

from tallyrisk.llm import quality, toxicity
from tallyrisk.llm.common import QUERIES, fit_logistic, is_held_out, labelled_sample, logistic_score
from tallyrisk.llm.quality import hinge_descent, terms

SMALL = "/root/testdata/sf0.01"


def test_terms_are_grams_and_shapes():
    assert terms(b"Ab ab, 12") == {b"ab", b",", b"12", b"ab ab", b"ab ,", b", 12", b"\x00same", b"\x00mostly same"}
    assert terms(None) == terms(b"") == set()
    assert b"\x00shouted" in terms(b"LOUD WORDS IN HERE") and b"\x00shouted" not in terms(b"Loud words In here")


def test_descent_minimises_the_hinge_objective():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0, 1]) + rng.normal(size=80) > 0, 1.0, -1.0)
    w = hinge_descent([(np.arange(6), r) for r in x], y, 6, cost=0.5, passes=400)
    full = np.c_[x, np.ones(80)]

    def objective(v):
        return v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (full @ v)).sum()

    near = min(objective(w + rng.normal(scale=s, size=7)) for s in (1e-3, 1e-2, 1e-1) for _ in range(300))
    assert objective(w) <= near + 1e-6


def test_logistic_fit_with_one_class_is_the_smoothed_share():
    fit = fit_logistic(np.zeros((4, 2)), np.ones(4))
    assert np.allclose(logistic_score(np.array([[3.0, 4.0]]), fit), 4.5 / 5)
    assert np.allclose(logistic_score(np.zeros((1, 1)), fit_logistic(np.zeros((0, 1)), np.zeros(0))), 0.5)


def test_sample_is_bounded_and_leaves_held_out_rows(spark, documents):
    docs = documents([(i, f"t{i}") for i in range(40)] + [(3, "zz"), (None, "n")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (90, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 15, lambda name: is_held_out(name, 4, 2)).toPandas()
    import zlib
    assert len(got) == 15 and got["id"].is_unique
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in got["id"])
    three = got[got["id"] == 3]
    assert three.empty or (bytes(three["text"].iloc[0]), three["label"].iloc[0]) == (b"zz", 1)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_get_scores(spark, documents, prose, module, label):
    rows = [(i, prose(i, 30) + (" grimword %%% grimword" if i % 3 == 0 else "")) for i in range(90)]
    odd = [(200, None), (201, ""), (202, "   \n"), (None, "no id"), (203, prose(5, 20000)), (203, prose(5, 20000))]
    docs = documents(rows + odd)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], f"doc_id long, {label} int")
    model = module.fit(docs, labels, label)
    got = docs.select("doc_id", "text", module.score_column(model, docs).alias("s")).toPandas()
    assert len(got) == 96 and got["s"].between(0, 1).all()
    marked = got["text"].fillna("").str.contains("grimword")
    assert got["s"][marked].min() > got["s"][~marked & (got["doc_id"] < 90)].max()
    assert got[got["doc_id"].isin([200, 201, 202])]["s"].nunique() == 1
    empty = documents([])
    assert empty.select(module.score_column(model, empty).alias("s")).count() == 0
    unlearnt = module.fit(docs, labels.limit(0), label)
    assert set(docs.select(module.score_column(unlearnt, docs).alias("s")).toPandas()["s"].round(6)) == {0.5}


@pytest.mark.parametrize("name,label,least", [("op7_nb_support_vectors", "quality", 0.97), ("op6_compression_distance", "toxic", 0.75)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, SMALL).toPandas()
    told = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().merge(got, on="doc_id")
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    held = told[told["held_out"]]
    rank, y = pd.Series(held["score"]).rank().to_numpy(), held[label].to_numpy()
    area = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert area >= least
    assert (told["predicted"] == told[label]).mean() >= 0.9


def test_gain_is_for_the_toxic_dictionary():
    coder = toxicity.WindowCoder([b"the", b"and"], [b"horrid", b"grimword"], [b"pleasant"])
    assert coder.gain(b"grimword") >= 4 and coder.gain(b"horrid") >= 2 and coder.gain(b"pleasant") <= -2
    assert abs(coder.gain(b"the")) <= 1 and len(coder.cells(b"")) == 0
