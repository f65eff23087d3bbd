import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tallyrisk.llm.spelling import neighbours, roots, rotations, variants, word_counts


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by its definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(counts, times):
    out = {}
    for w, n in counts.items():
        close = sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v))
        good = bool(close) and counts[close[0]] >= times * n
        out[w] = (n, len(close), close[0] if good else None, counts[close[0]] if good else None)
    for w in counts:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = (*out[w], root)
    return out


@pytest.mark.parametrize("letters,times", [("ab", 2), ("abé𝒳", 3)])
def test_variants_equal_brute_force(spark, letters, times):
    r = random.Random(letters)
    counts = {"".join(r.choice(letters) for _ in range(r.randint(1, 6))): int(10 ** r.uniform(0, 4)) for _ in range(250)}
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    got = {row["word"]: (row["n"], row["n_near"], row["form"], row["form_n"], row["root"]) for row in variants(words, times=times).collect()}
    expected = plain(counts, times)
    assert got == expected
    chains = [w for w in counts if expected[w][2] and expected[expected[w][2]][2]]
    assert len(chains) > 5  # a root further than the form


def test_rotations_put_near_words_in_one_group(spark):
    words = spark.createDataFrame([("abc", 5), ("axc", 2), ("ac", 9), ("aac", 1)], "word string, n long")
    rows = {(r["turned"], r["skipped"]) for r in rotations(words).collect()}
    assert {("c\0a", "b"), ("c\0a", "x"), ("c\0a", None), ("c\0a", "a")} <= rows and len(rows) == sum(2 * n + 1 for n in (3, 3, 2, 3))
    found = Counter()
    for r in neighbours(words).collect():
        found[r["word"]] += r["near"]
    # "aac" and "ac" share two groups but are near once.
    assert found == {"abc": 3, "axc": 3, "ac": 3, "aac": 3}


def test_odd_rows(spark):
    words = spark.createDataFrame([(None, 4), ("", 3), ("a", 2), ("a", 28), ("q\0r", 7), ("é" * 3000, 1), ("é" * 2999, 10), ("zz", None)], "word string, n long")
    got = {r["word"]: r for r in variants(words).collect()}
    assert set(got) == {"", "a", "é" * 3000, "é" * 2999, "zz"} and got["a"]["n"] == 30
    assert got[""]["form"] == "a" and got[""]["root"] == "a" and got["é" * 3000]["root"] == "é" * 2999
    assert got["zz"]["n"] is None and got["zz"]["form"] is None and got["zz"]["root"] == "zz"
    assert variants(words.limit(0)).count() == 0


def test_ties_go_to_the_first_in_code_point_order(spark):
    words = spark.createDataFrame([("bat", 1), ("cat", 50), ("bbt", 50), ("Bat", 50), ("𝒳at", 50)], "word string, n long")
    got = {r["word"]: r for r in variants(words).collect()}
    assert got["bat"]["form"] == "Bat" and got["bat"]["n_near"] == 4


def test_roots_of_long_chains(spark):
    chain = [("w%02d" % i, 10 ** i) for i in range(19)]
    told = spark.createDataFrame([(w, n, chain[i + 1][0] if i < 18 else None, chain[i + 1][1] if i < 18 else None) for i, (w, n) in enumerate(chain)],
                                 "word string, n long, form string, form_n long")
    got = {r["word"]: r["root"] for r in roots(told, 10).collect()}
    assert got == {w: "w18" for w, _ in chain[:18]}


def test_word_counts_equal_a_plain_count(spark, documents):
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcÀÿdeFGH") for _ in range(r.randint(5, 10))) for _ in range(200)) for _ in range(6)]
    rows = [(i, t + "\n" + texts[0]) for i, t in enumerate(texts)] + [(3, texts[0]), (3, texts[0]), (None, texts[1]), (7, None), (8, ""), (9, "short 12345678 x" + "y" * 50000)]
    expected = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                expected[run] += 1
    got = {row["word"]: row["n"] for row in word_counts(documents(rows)).collect()}
    assert got == {w: n for w, n in expected.items() if n >= 2} and len(got) > 200
    assert word_counts(documents([])).count() == 0
