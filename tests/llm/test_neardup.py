import numpy as np
import pytest

from tallyrisk.llm import neardup
from tallyrisk.llm.graph import components
from tallyrisk.llm.neardup import Sketcher, estimate, merge, near_duplicates, shingle_set, split_words


def plain_components(rows, width):
    sets = [shingle_set(split_words((t or "").encode()), width) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    groups = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            groups[top(i)] = min(groups.get(top(i), id_), id_)
    return sorted(((r[0], len(s), groups.get(top(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def told(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=str)


def edited(text, seed, n):
    r, words = np.random.default_rng(seed), text.split()
    for i in r.choice(len(words), n, replace=False):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def test_matches_plain_comparison(documents, prose):
    rows = [(i, prose(i, 40 + i % 30)) for i in range(40)]
    rows += [(100 + i, edited(prose(i % 8, 40 + i % 8), 1000 + i, i % 3)) for i in range(40)]
    chain = prose(77, 200)
    for i in range(6):  # each near its predecessor only
        chain = edited(chain, 50 + i, 4)
        rows.append((300 - i, chain))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One two"), (404, "one  TWO\n"), (405, "one"), (0, prose(0, 40)), (0, prose(0, 40)), (None, prose(1, 41)),
             (None, "only here without an id at all"), (406, prose(9, 30000)), (407, edited(prose(9, 30000), 3, 500))]
    got = near_duplicates(documents(rows), width=4)
    assert told(got) == plain_components(rows, 4)
    kept = {(r["doc_id"], r["kept"]) for r in got.collect() if r["doc_id"] is not None}
    assert all(k == (i == c) for (i, _, c), k in zip(told(got), [r["kept"] for r in sorted(got.collect(), key=lambda r: str((r["doc_id"], r["n_shingles"], r["component_id"])))]))
    assert (404, False) in kept and (403, True) in kept and (400, True) in kept


def test_dense_group_in_tiles_equals_plain(documents, prose, monkeypatch):
    """Texts that mostly fall just short of each other share buckets in which nothing but tiles can tell them apart."""
    for name, value in (("ONE_ROW", 6), ("TILE", 4), ("PACKED_ROWS", 20)):
        monkeypatch.setattr(neardup, name, value)
    base = prose(5, 90)
    rows = [(500, base)] + [(i, edited(base, i, 3 + i % 3)) for i in range(60)]
    assert told(near_duplicates(documents(rows), width=4)) == plain_components(rows, 4)


def test_stays_picks_one_row_key_of_a_group(documents, prose):
    rows = [(5, prose(1, 30)), (4, prose(1, 30)), (4, prose(1, 30)), (None, prose(2, 30)), (None, prose(2, 30)), (6, "")]
    got = near_duplicates(documents(rows)).filter("stays").select("doc_id", "row_key").distinct().collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["4", "6", "None"]


def test_empty_table_and_string_ids(documents, prose):
    assert near_duplicates(documents([])).count() == 0
    got = near_duplicates(documents([("b", prose(1, 20)), ("a", prose(1, 20)), ("c", prose(2, 20))], ids="string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[400:3000]
    ra, rb = Sketcher.registers(a), Sketcher.registers(b)
    assert (merge(ra, rb) == Sketcher.registers(pool)).all()
    assert (Sketcher.registers(np.zeros(0, np.uint64)) == 0).all()
    j = []
    for _ in range(30):
        pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        j.append(estimate(Sketcher.registers(pool[:540])[None], Sketcher.registers(pool[60:])[None], np.array([540.0]), np.array([540.0]))[0])
    assert abs(np.mean(j) - 0.8) < 0.02 and np.std(j) < 0.05


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 61)], []])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([(max(e), min(e)) for e in edges], "u long, v long")).collect()}
    nodes = {n for u, v in edges if u != v for n in (u, v)}
    assert got == {n: 60 if n in (60, 61) else 0 for n in nodes}
