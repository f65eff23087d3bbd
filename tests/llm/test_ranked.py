import math
import random
import re
from collections import Counter

from tallyrisk.llm import ranked as R
from tallyrisk.llm.ranked import Items, Search, ranked, terms


def split(text):
    fold = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", fold)


def plain(rows, items, best=10):
    """Every score of every item and document, then the best."""
    held = [(i, split(t)) for i, t in rows if split(t)]
    n_docs, n_terms, out = len(held), sum(len(t) for _, t in held), []
    df = Counter(t for _, found in held for t in set(found))
    for item, text in dict.fromkeys(items):
        scores = []
        for doc_id, found in held:
            tf, m = Counter(found), 10 + 90 * len(found) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(split(text)) if t in tf)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


def test_terms():
    assert terms("Ab-C_9 é·x É\tÀb".encode()) == [t.encode() for t in split("Ab-C_9 é·x É\tÀb")] and terms(None) == []


def test_ranked_equals_scoring_everything(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    r = random.Random(8)
    rows = [(i, " ".join([prose(i % 40, r.randint(1, 60)), prose(500 + i % 7, 8)]).title()) for i in range(260)]
    rows += [(300, None), (301, ""), (302, "--- !"), (None, prose(3, 30)), (5, rows[5][1]), (5, rows[5][1]), (303, prose(1, 9) + "\n" + prose(600, 40000))]
    items = [(i, prose(i, 25)) for i in range(30)] + [(30, prose(500, 8)), (31, None), (32, ""), (30, prose(500, 8)), (30, prose(2, 5)), (33, "É é " + prose(4, 6)), (None, prose(6, 9))]
    bench = spark.createDataFrame([(*i, 1.5) for i in items], "item_id long, text string, rank double")
    docs = documents(rows, parts=5)
    got = sorted([(x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in ranked(docs, bench).collect()], key=str)
    expected = plain(rows, [i for i in items if i[1]])
    assert got == expected and len(got) > 200
    # Items in several blocks of their own.
    monkeypatch.setattr(R, "ITEM_BYTES", 900)
    assert sorted([(x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in ranked(docs, bench).collect()], key=str) == expected
    assert ranked(documents([]), bench).count() == 0 and ranked(docs, bench.limit(0)).count() == 0
    assert ranked(docs, bench).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_cover_scores_and_spare_work(prose):
    texts = [prose(i % 50, 30 + i % 20).encode() for i in range(400)]
    items = Items(list(range(20)), [prose(i, 30).encode() for i in range(20)])
    frequency = Counter(t for x in texts for t in set(terms(x)))
    items.learn(400, sum(len(terms(t)) for t in texts), frequency)
    search = Search(items, 10)
    for low in range(0, 400, 50):
        search.take(list(range(low, low + 50)), texts[low:low + 50])
    scored = [items.shares(t) for t in texts]
    for item in range(20):
        every = sorted(((items.score(item, s), -d) for d, s in enumerate(scored) if s is not None), reverse=True)[:10]
        assert [(s, d) for s, d in search.found[item]] == [(s, -d) for s, d in every if s > 0]
    assert search.scored < 400 * 20 // 3


def test_slots_shared_by_terms_keep_results(spark, documents, prose, monkeypatch):
    rows = [(i, prose(i, 40)) for i in range(120)]
    items = [(i, prose(i, 12)) for i in range(15)]
    monkeypatch.setattr(R, "SLOTS", 3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([(x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in ranked(documents(rows), bench).collect()], key=str)
    assert got == plain(rows, items)
