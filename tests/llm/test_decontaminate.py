import random
from itertools import combinations

import numpy as np

from tallyrisk.llm import decontaminate
from tallyrisk.llm.decontaminate import PASSAGE_WORDS, Benchmark, BlockMaxIndex, is_clean, leaks, parts, pieces, words


def test_search_equals_scoring_every_entry(prose):
    entries = [prose(i % 90, 8 + i % 40).encode().split() for i in range(150)]
    index, r = BlockMaxIndex(entries), random.Random(4)
    found = 0
    for trial in range(60):
        query = {index.number[w] for w in prose(trial % 100, 60).encode().split()} - {-1}
        for threshold in (0.05, 0.3, 0.6, 0.95):
            plain = {}
            for t in query:
                for e, w in zip(index.ids[t], index.weights[t]):
                    plain[e] = plain.get(e, 0.0) + w
            expected = {e: s for e, s in plain.items() if s >= threshold - 1e-9}
            got = dict(index.search(query, threshold))
            assert got.keys() == expected.keys() and all(abs(got[e] - expected[e]) < 1e-9 for e in got)
            found += len(got)
    assert found > 200 and r


def test_no_passage_is_passed_over(prose):
    import numpy as np
    items = [prose(i, 20) for i in range(60)]
    bench = Benchmark(list(range(60)), items)
    for seed in range(40):
        text = " ".join([prose(900 + seed, 150), items[seed], prose(950 + seed, 70)]).encode()
        number = np.array([bench.index.number[w] for w in words(text)])
        hopeful = set(bench.index.hopeful(number).tolist())
        for start in range(0, len(number), PASSAGE_WORDS // 2):
            if bench.index.search(set(number[start:start + PASSAGE_WORDS].tolist()) - {-1}):
                assert start in hopeful


def test_parts_and_pieces():
    assert parts("What is it? It is red. ") == ([b"what", b"is", b"it"], [b"it", b"is", b"red"])
    assert parts("only one") == ([b"only", b"one"], [b"only", b"one"])
    assert parts("") == ([], []) and pieces([]) == []
    long = [str(i).encode() for i in range(150)]
    assert [len(p) for p in pieces(long)] == [64, 64, 64] and pieces(long)[-1][-1] == b"149"


def test_leaks_and_odd_rows(spark, documents, prose):
    items = [(i, f"{prose(i, 14)}? {prose(100 + i, 9)}.") for i in range(12)] + [(20, f"{prose(1, 14)}? {prose(101, 9)}."), (21, None), (22, ""), (23, prose(55, 200))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = items[1][1]
    rows = [(1, prose(500, 300) + " " + one.upper() + " " + prose(501, 10)), (2, prose(502, 90)), (3, one), (4, None), (5, ""), (None, one),
            (6, prose(503, 30000) + "\n" + items[2][1]), (7, prose(1, 14)), (8, prose(55, 200)), (3, one), (9, prose(101, 9) + " " + prose(510, 40))]
    docs = documents(rows)
    got = sorted(((r["doc_id"], r["item_id"]) for r in leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1), (1, 20), (3, 1), (3, 20), (3, 1), (3, 20), (None, 1), (None, 20), (6, 2), (8, 23)], key=str)
    clean = docs.filter(is_clean(docs, bench)).select("doc_id").collect()
    assert sorted(r[0] for r in clean) == [2, 4, 5, 7, 9]
    assert leaks(documents([]), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0
    assert docs.filter(is_clean(docs, bench.limit(0))).count() == len(rows)


def test_long_documents_are_bounded_in_slices(prose, monkeypatch):
    entries = [prose(i, 12).encode().split() for i in range(50)]
    index = BlockMaxIndex(entries)
    text = " ".join([prose(900, 3000), *(prose(i, 12) + " " + prose(800 + i, 700) for i in range(8))]).encode().split()
    numbers = np.array([index.number[w] for w in text])
    whole = index.hopeful(numbers).tolist()
    sizes, bincount = [], np.bincount
    monkeypatch.setattr(decontaminate.np, "bincount", lambda *a: sizes.append(len(out := bincount(*a))) or out)
    monkeypatch.setattr(decontaminate, "CELLS", 200, raising=False)
    assert index.hopeful(numbers).tolist() == whole and len(whole) >= 8 and max(sizes) <= 200


def test_short_answers_with_one_changed_word_are_found(spark, documents, prose):
    """Every place of a changed, a left-out and an added word, in answers of 4 to 11 words; unlike answers stay clean."""
    r, items, rows = random.Random(8), [], []
    for n in range(4, 12):
        question, answer = prose(n, 14), prose(100 + n, n).split()
        items.append((n, f"{question}? {' '.join(answer)}."))
        for place in range(n):
            changed, left_out, added = answer[:], answer[:], answer[:]
            changed[place], left_out[place:place + 1] = "chilly", []
            added.insert(place, "quite")
            for kind, edited in enumerate((changed, left_out, added)):
                rows.append((n * 1000 + place * 10 + kind, f"{prose(r.random(), 60)} {question}? {' '.join(edited)}. {prose(r.random(), 60)}"))
        rows.append((n, f"{prose(r.random(), 60)} {question}? {prose(700 + n, n)}. {prose(r.random(), 60)}"))
        scattered = " ".join(w + " " + prose(r.random(), 9) for w in answer)
        rows.append((n + 500, f"{prose(r.random(), 20)} {question}? {scattered}"))
    found = {(x["doc_id"], x["item_id"]) for x in leaks(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # Of a four-word answer three words in order are enough, as in all of these.
    assert found == {(i, i // 1000) for i, _ in rows if i >= 1000}


def test_words_in_order_equal_a_plain_search():
    r = random.Random(3)

    def longest(a, b):
        return max((len(p) for k in range(len(a) + 1) for p in combinations(a, k) if is_subsequence(p, b)), default=0)

    def is_subsequence(p, b):
        rest = iter(b)
        return all(w in rest for w in p)

    for _ in range(150):
        part = [bytes([r.choice(b"abcde")]) for _ in range(r.randint(1, 7))]
        around = [bytes([r.choice(b"abcdefgh")]) for _ in range(r.randint(0, 30))]
        width = len(part) + decontaminate.SLACK_WORDS
        best = max(longest(part, around[i:i + width]) for i in range(len(around) + 1)) / len(part)
        assert decontaminate.in_order(part, around) == (best if best >= decontaminate.LEAST_IN_ORDER else 0.0)
