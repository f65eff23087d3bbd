import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyrisk.llm.mixing import BUCKETS, mixed, targets


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 30, None: 7}, {"z": 5}, {"a": 0, "b": 4, "é": 9, "B": 2, "~": 100, "d": 1}, {"a": 0}])
def test_targets_equal_repeated_sharing(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(frame).collect()}
    expected = plain_targets(sizes)
    assert got.keys() == expected.keys() and all(got[s] == pytest.approx(expected[s], abs=1e-6) for s in got)


def plain_mix(rows):
    def unit(i, t):
        inner = hashlib.md5((t or "").encode()).hexdigest()
        return (int(hashlib.md5(f"mix-1|{'none' if i is None else i}|{inner}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sums = {}
    for (_, _, s), n in zip(rows, size):
        sums[s] = sums.get(s, 0) + n
    target, copies = plain_targets(sums), [0] * len(rows)
    for s, total in sums.items():
        own = [k for k, r in enumerate(rows) if r[2] == s]
        expected = min(2.0, target[s] / total) if total else 0.0
        whole, p = int(expected), expected - int(expected)
        left = target[s] - whole * total
        for k in own:
            copies[k] = whole
        if p > 1e-12:
            odds = {k: unit(*rows[k][:2]) / (1 - unit(*rows[k][:2])) * (1 - p) / p for k in own}
            before = 0
            for k in sorted((k for k in own if size[k]), key=lambda k: odds[k]):
                if before + size[k] / 2 < left:
                    copies[k] += 1
                before += size[k]
    return sorted(((rows[k][0], size[k], size[k] * copies[k]) for k in range(len(rows))), key=str)


def test_mix_equals_ordering_each_source(documents, prose):
    rows = [(i, prose(i, 1 + i * 7 % 40), f"s{'aaaaabbc'[i % 8]}") for i in range(160)]
    rows += [(200, None, "sa"), (201, "", "sb"), (202, " \n", None), (203, prose(3, 4000), "sb"), (204, "one two", "only"), (205, "x", None), (206, "y z", None)]
    got = mixed(documents(rows, parts=5))
    assert sorted(((r["doc_id"], r["mix_size"], r["mix_size"] * r["mix_copies"]) for r in got.collect()), key=str) == plain_mix(rows)
    assert got.columns[:7] == ["doc_id", "text", "source", "score", "label", "id", "n_chars"]
    taken = {r["source"]: r["t"] for r in got.groupBy("source").agg({"mix_size": "sum"}).withColumnRenamed("sum(mix_size)", "t").collect()}
    assert taken


def test_many_rows_end_inside_a_cell(spark):
    """With far more rows than cells the end lies in a part of a cell."""
    docs = spark.range(6 * BUCKETS).selectExpr("id doc_id", "concat('w ', id) text", "case when id % 3 = 0 then 'b' else 'a' end source")
    got = mixed(docs).selectExpr("source", "mix_size * mix_copies taken", "mix_target").groupBy("source").agg({"taken": "sum", "mix_target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(mix_target)"]) <= 1 for r in got)


def test_repeated_rows_nulls_and_empty(documents):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "d", "s"), (1, "d", "s"), (2, "e f", None)]
    got = mixed(documents(rows)).collect()
    assert len(got) == 5 and all(0 <= r["mix_copies"] <= 2 for r in got)
    assert len({(r["mix_copies"]) for r in got if r["doc_id"] == 1}) == 1
    assert mixed(documents([])).count() == 0


def test_own_weights_change_chances(documents, prose):
    rows = [(i, prose(i, 20), "ab"[i % 2]) for i in range(200)]
    docs = documents(rows).selectExpr("*", "case when doc_id < 100 then 3.0 else 0.2 end as w")
    got = mixed(docs, weight_col="w").collect()
    low, high = (sum(r["mix_copies"] for r in got if (r["doc_id"] < 100) is h) for h in (False, True))
    assert high > 3 * low and max(r["mix_copies"] for r in got) <= 2


def test_names_of_other_columns_do_not_matter(documents):
    rows = [(i, "a b c " * (i % 5), f"src{i % 3}") for i in range(40)]
    named = documents(rows).withColumns({n: F.lit(i) for i, n in enumerate(["mix_size", "MIX_COPIES", "copies", "a.b", "row", "u", "end_left"])})
    out = mixed(named)
    assert out.columns == [*named.columns, "mix_size_", "mix_source_size", "mix_target", "mix_copies_"] and out.count() == 40
    plain = {r["doc_id"]: r["mix_copies"] for r in mixed(documents(rows)).collect()}
    assert {r["doc_id"]: r["mix_copies_"] for r in out.collect()} == plain
