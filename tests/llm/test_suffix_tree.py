import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrisk.llm import suffix_tree
from tallyrisk.llm.common import is_held_out
from tallyrisk.llm.suffix_tree import END, fit, learn_and_score, scored, tokens


def texts_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("text")).repartition(3)


def test_tokens():
    assert tokens(b"Ab\x0bC\xc3\x89 d") == [b"ab", b"c\xc3\x89", b"d", END] and tokens(None) == [END]


def test_states_are_distributions(spark):
    rng = np.random.default_rng(0)
    text = " ".join("abc"[i] if i < 3 else "de"[rng.integers(2)] for i in rng.integers(0, 4, 3000))
    tree, _ = fit(texts_of(spark, [text.replace("a b", "a b c"), "b c a " * 400, "", None]))
    assert [len(level.total) > 0 for level in tree.levels] == [True, True, True] and any(level.retained.any() for level in tree.levels[1:])
    alphabet = tree.vocabulary
    for prefix in (b"", b"a", b"a b", b"b c a", b"zz a", b"c zz"):
        before = tree.numbers(prefix.split())
        total = 0.0
        for number in range(len(alphabet)):
            total += 10 ** tree.log_probabilities(np.r_[before, number])[-1]
        total += 10 ** tree.log_probabilities(np.r_[before, -1])[-1] * tree.unseen
        assert total == pytest.approx(1.0, abs=1e-9)


def test_contexts_help(spark):
    tree, _ = fit(texts_of(spark, ["x y z w " * 300]))
    words = tree.numbers(b"x y z w x y z w".split())
    assert tree.log_probabilities(words)[3:].mean() > -0.05 and tree.log_probabilities(words)[0] < -0.5


def test_base_equals_plain_counts(spark, documents, prose):
    rows = [(i, prose(i % 50, 30) + f" rare{i}") for i in range(120)] + [(500, None), (501, ""), (502, prose(7, 9000)), (None, "Ka lo"), (3, prose(3, 30))]
    docs = documents(rows)
    got = learn_and_score(docs, lambda name: is_held_out(name, 10, 0)).collect()
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 != 0]
    counts = Counter(w for t in train for w in tokens((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    plain = sorted((str(i), len(tokens((t or "").encode())), sum(counts[w] > 0 for w in tokens((t or "").encode())),
                    round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens((t or "").encode())), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == plain
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)


def test_empty_tables(spark, documents):
    tree, counts = fit(texts_of(spark, []))
    assert tree.n == 0 and tree.vocabulary == []
    got = scored(documents([(1, "some words"), (2, None)]), tree, counts).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"]) for r in got) == [(1, 3, 0), (2, 1, 0)]
    assert learn_and_score(documents([]), lambda name: is_held_out(name, 10, 0)).count() == 0


def test_rare_runs_are_met_in_a_join(spark, documents, prose, monkeypatch):
    rows = [(i, prose(i % 60, 40) + f" rare{i % 30} zu za zi") for i in range(150)] + [(500, None), (501, "")]
    held_out = lambda name: is_held_out(name, 10, 0)
    want = {r["doc_id"]: r["score"] for r in learn_and_score(documents(rows), held_out).collect()}
    monkeypatch.setattr(suffix_tree, "HEAD_SHARE", 2e-3)
    monkeypatch.setattr(suffix_tree, "VOCABULARY_SHARE", 2e-3)
    got = {r["doc_id"]: r["score"] for r in learn_and_score(documents(rows), held_out).collect()}
    assert want.keys() == got.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_rare_contexts_stay_in_a_large_corpus(spark, documents):
    rng = np.random.default_rng(1)
    filler = [" ".join(f"w{i}" for i in rng.integers(0, 50, 2000)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(filler)] + [(1000 + i, "ab cd ef gh") for i in range(5)]
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in learn_and_score(
        documents([*rows, (2000, "ab cd ef gh")]), lambda name: F.col(name) == 2000).collect()}
    # 5 in 300,000 tokens: under the base model each word costs about 4.8, after its context nearly nothing.
    assert got[2000] > 10


def test_packed_keys_come_back():
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 1 << 63, 5000), rng.integers(0, 1 << 10, 5000), np.array([1 << 62]), np.zeros(0, np.int64), np.array([0, (1 << 63) - 1])):
        keys = np.sort(keys.astype(np.uint64) << np.uint64(1))
        assert np.array_equal(suffix_tree._unpacked(suffix_tree._packed(keys)), keys)
    assert suffix_tree._widened(suffix_tree._narrow(np.array([0, 70_000]))).tolist() == [0, 70_000]


def plain_scores(texts, rows, add=suffix_tree.DISCOUNT):
    """log10 probabilities of `rows` by a tree of dictionaries learnt from `texts`."""
    said = [tokens(t.encode()) for t in texts]
    counts = [Counter(tuple(w[i:i + k]) for w in said for i in range(len(w) - k + 1)) for k in range(1, suffix_tree.DEPTH + 2)]
    n = sum(counts[0].values())
    unseen = (sum(c == 1 for c in counts[0].values()) + 1) / (n + 2)
    p = {g: c * (1 - unseen) / n for g, c in counts[0].items()}
    value, after = {}, {}
    for level in counts[1:]:
        listed = {}
        for g, c in level.items():
            if c >= suffix_tree.LEAST_COUNT:
                listed.setdefault(g[:-1], {})[g] = c
        for context, next_words in listed.items():
            total, under = counts[len(context) - 1][context], sum(p[g[1:]] for g in next_words)
            rest = 1 - sum(next_words.values()) / total
            gain = sum(c / total * math.log(c / total / p[g[1:]]) for g, c in next_words.items())
            gain += rest * math.log(rest / max(1 - under, 1e-9)) if rest > 1e-9 else 0
            spare = max(1 - (sum(next_words.values()) - add * len(next_words)) / total, 1e-12)
            kept = gain >= suffix_tree.LEAST_DIVERGENCE and gain * total >= suffix_tree.LEAST_GAIN
            for g, c in next_words.items():
                p[g] = (c - add) / total + spare * p[g[1:]] if kept else p[g[1:]]
                value[g] = math.log10(p[g] / spare / p[g[1:]]) if kept else 0
            if kept:
                after[context] = math.log10(spare)

    def score(words):
        out = 0.0
        for i, w in enumerate(words):
            out += math.log10(p.get((w,), unseen))
            for k in range(1, suffix_tree.DEPTH + 1):
                out += value.get(tuple(words[i - k:i + 1]), 0) if i >= k else 0
                out += after.get(tuple(words[i - k:i]), 0) if i >= k else 0
        return out
    return [score(tokens(t.encode())) for t in rows]


@pytest.mark.parametrize("head", [suffix_tree.HEAD_SHARE, 3e-3])
def test_scores_equal_a_plain_tree(spark, documents, monkeypatch, head):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 12, 200) * rng.integers(0, 3, 200)) + " a b c d e" for _ in range(60)]
    monkeypatch.setattr(suffix_tree, "HEAD_SHARE", head)
    monkeypatch.setattr(suffix_tree, "_FLUSH_KEYS", 1000)
    monkeypatch.setattr(suffix_tree, "_SLICE_WORDS", 700)
    big = 1 << 60
    got = {r["doc_id"]: r["score"] for r in learn_and_score(documents([(big + i, t) for i, t in enumerate(texts)]), lambda name: F.col(name) >= big + 50).collect()}
    want = plain_scores(texts[:50], texts)
    assert len(got) == 60 and all(got[big + i] == pytest.approx(w, abs=1e-8) for i, w in enumerate(want))


def test_runs_that_occur_once_are_let_go_before_they_are_counted(spark):
    once = [" ".join(f"w{(i * 1009 + j * j * 31 + j * 7) % 4001}" for j in range(3000)) for i in range(8)]
    texts, bits = texts_of(spark, [*once, "a b c d", "a b c d"]), suffix_tree._FILTER_BITS
    words = sorted({w for t in once for w in t.split()} | set("abcd"))
    every = spark.createDataFrame([(int(h),) for h in suffix_tree.hashes([w.encode() for w in words], suffix_tree._Hashes())], "gram long")
    found = suffix_tree._met_twice(texts, 1, suffix_tree._filter(every, "gram", 4), 4)
    pairs = Counter(p for t in [*once, "a b c d", "a b c d"] for p in zip(t.split(), t.split()[1:]))
    twice = [p for p, n in pairs.items() if n > 1]
    rows = suffix_tree._counted_runs(texts, 1, found, 4).collect()
    held = np.unpackbits(np.frombuffer(suffix_tree.zlib.decompress(found), np.uint8)).sum()
    assert len(pairs) > 10_000 and bits >= 20 and len(rows) == len(twice) and held <= len(twice) + 3
    assert Counter(r["n"] for r in rows) == Counter(n for n in pairs.values() if n > 1)


def test_tables_of_the_levels_are_deleted(spark, documents, prose):
    from pathlib import Path

    def written():
        return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("tallyrisk/lm-*")}

    before = written()
    learn_and_score(documents([(i, prose(i % 20, 60)) for i in range(60)]), lambda name: is_held_out(name, 10, 0)).count()
    kinds = Counter(name.rpartition("-")[0] for name in written() - before)
    assert kinds == {"lm-counts": 1, "lm-adds": 1, "lm-parts": suffix_tree._PARTS} and suffix_tree._PARTS > 1


@pytest.mark.parametrize("hot, vocabulary, head", [(40, 5e-7, 1e-6), (250, 5e-7, 2e-2), (40, 3e-3, 3e-3), (1 << 20, 3e-3, 1e-6)])
def test_hot_contexts_and_rare_words_score_as_a_plain_tree(spark, documents, monkeypatch, hot, vocabulary, head):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 9, 150) * rng.integers(0, 3, 150)) + " a b c d e" * (1 + i % 3) + f" r{i // 4} s t{i // 4}" for i in range(60)]
    monkeypatch.setattr(suffix_tree, "_HOT_TOKENS", hot)
    monkeypatch.setattr(suffix_tree, "VOCABULARY_SHARE", vocabulary)
    monkeypatch.setattr(suffix_tree, "HEAD_SHARE", head)
    monkeypatch.setattr(suffix_tree, "_FLUSH_KEYS", 1500)
    monkeypatch.setattr(suffix_tree, "_SLICE_WORDS", 700)
    got = {r["doc_id"]: r["score"] for r in learn_and_score(documents(list(enumerate(texts))), lambda name: F.col(name) >= 50).collect()}
    want = plain_scores(texts[:50], texts)
    assert len(got) == 60 and all(got[i] == pytest.approx(w, abs=1e-8) for i, w in enumerate(want))
