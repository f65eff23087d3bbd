import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrisk.llm import personal as P
from tallyrisk.llm.common import QUERIES

SMALL = "/root/testdata/sf0.001"
# The contract's patterns as it states them.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, whole):
    digits = [int(d) for d in whole if d.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in whole.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    kinds = list(BASE)
    return sorted((m.start(), k, m.end()) for k, name in enumerate(kinds) for m in re.finditer(BASE[name], text or "") if passes(name, m.group()))


def card(r, n=16):
    digits = [4] + [r.randint(0, 9) for _ in range(n - 2)]
    return next(t for t in ("".join(map(str, digits)) + str(c) for c in range(10)) if passes("card", t))


@pytest.fixture(scope="module")
def planted(prose):
    """(rows, texts that must be found by id): prose with personal data of all kinds, and numbers that are none."""
    r, rows, truth = random.Random(5), [], {}
    make = {
        "email": lambda: ("write to ", f"a{r.randint(1, 99)}.b+c@mail{r.randint(1, 9)}.example.com"), "ip": lambda: ("client ", ".".join(str(r.randint(1, 255)) for _ in range(4))),
        "card": lambda: ("card ", " ".join(re.findall("....", card(r)))), "phone": lambda: ("call ", f"+49 (0{r.randint(10, 99)}) {r.randint(10 ** 6, 10 ** 7 - 1)}"),
        "ssn": lambda: ("her ssn ", f"{r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"), "iban": lambda: ("account ", "GB82 WEST 1234 5698 7654 32"),
        "local_phone": lambda: ("phone ", f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"),
        "at_mail": lambda: ("contact ", f"jo{r.randint(1, 99)} (at) host{r.randint(1, 9)} (dot) org"),
        "person": lambda: ("signed by ", f"{r.choice(['Mrs. ', 'Dr. ', ''])}Maria {r.choice(['Keller', 'Öztürk', 'Smith'])}".replace("Maria", r.choice(["Anna", "Peter", "Emma"]))),
        "birth": lambda: ("born ", f"{r.randint(1, 28)}.{r.randint(1, 12)}.19{r.randint(30, 99)}"),
    }
    decoys = [lambda: f"version {r.randint(300, 900)}.{r.randint(1, 9)}.{r.randint(300, 999)}.7", lambda: f"released {r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 20)}",
              lambda: f"order x{r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", lambda: f"isbn {r.randint(10 ** 12, 10 ** 13)}", lambda: f"serial {r.randint(100, 999)}-00-0000"]
    for i in range(240):
        words = prose(i, 40)
        if i % 3 == 0:
            kind = list(make)[i // 3 % len(make)]
            cue, found = make[kind]()
            rows.append((i, f"{words} {cue}{found}, {prose(i + 500, 12)}"))
            truth[i] = (list(make).index(kind), found)
        else:
            rows.append((i, f"{words} {r.choice(decoys)() if i % 3 == 1 else ''} {prose(i + 500, 12)}"))
    return rows, truth


def test_base_spans_equal_the_plain_patterns(spark, documents):
    r, alphabet = random.Random(11), ["1", "25", "255", "256", "007", ".", ".", "-", " ", "@", "+", "a", "Zq", "_", "é", "𝒳", "(", ")", "%", "com", "4", "9", "00"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 120)))) for i in range(900)]
    rows += [(1000 + i, f"{r.choice('x-. ')}{card(r, r.randint(12, 19))}{r.choice(' .-7')}") for i in range(200)]
    rows += [(2000, "a@b.com_x@d.org@e.f"), (2001, "é+1 (743) 555-3824é"), (2002, None), (2003, ""), (2004, "9" * 30000), (2005, "a" * 30000 + "@b.c"), (2006, "1." * 9000),
             (2007, "4111 1111 1111 1111 " * 2000), (2008, "x@y." + "z." * 8000), (2000, "a@b.com_x@d.org@e.f"), (None, "a@b.c"), (2009, "00000001.0000256.1.1 0.0.0.00000000000000000255")]
    texts = [(i, t if t is None else t.replace("  ", " ")) for i, t in rows]
    frame = documents(texts)
    found = frame.select("doc_id", "text", P.candidates(F.col("text")).alias("c")).collect()
    wrong = [(x["text"][:200]) for x in found if [(c["start"], c["kind"], c["end"]) for c in x["c"] if c["base"]] != plain_base(x["text"])]
    assert not wrong and sum(len(plain_base(t)) for _, t in rows) > 300


def test_fits_equal_plain_ones(spark, documents, planted):
    """Expectation-maximisation and descent in numpy, from the same codes."""
    docs = documents(planted[0])
    model = P.fit(docs)
    got = model.first()
    codes = [c["code"] for x in docs.select(P.candidates(F.col("text")).alias("c")).collect() for c in x["c"]]
    labelers, kinds = len(P.LABELERS), len(P.KINDS)
    kind = np.array([c // P._SHAPES // 3 ** labelers for c in codes])
    cast = np.array([[c // P._SHAPES // 3 ** (labelers - 1 - i) % 3 for i in range(labelers)] for c in codes])
    shape = np.array([c % P._SHAPES for c in codes])
    prior, rates, presumed = np.full(kinds, 0.5), np.tile(np.array(P.SHARES), (labelers, 1, 1)), P.PRESUMED * len(codes) + 1

    def posterior():
        odds = np.log(prior[kind] / (1 - prior[kind]))
        for i in range(labelers):
            odds = odds + np.log(rates[i, 1, cast[:, i]] / rates[i, 0, cast[:, i]])
        return 1 / (1 + np.exp(-odds))

    for _ in range(P.EM_ROUNDS):
        yes = posterior()
        prior = np.array([(yes[kind == k].sum() + 2) / ((kind == k).sum() + 4) for k in range(kinds)])
        rates = np.array([[[(m[cast[:, i] == v].sum() + presumed * P.SHARES[y][v]) / (m.sum() + presumed) for v in range(3)] for y, m in enumerate((1 - yes, yes))] for i in range(labelers)])
    assert np.allclose(got["prior"], prior, atol=1e-9) and np.allclose(got["rates"], rates.ravel(), atol=1e-9)
    x = np.column_stack([kind == k for k in range(kinds)] + [cast[:, i] == v for i in range(labelers) for v in (0, 2)] + [shape >= 2, shape % 2 == 1]).astype(float)
    weights, soft = np.zeros(P.N_FEATURES), posterior()
    for _ in range(P.STEPS):
        weights = weights + P.STEP * (x.T @ (soft - 1 / (1 + np.exp(-x @ weights))) / len(codes) - P.RIDGE * weights)
    assert np.allclose(got["weights"], weights, atol=1e-9)
    # The labelers came out better than chance.
    assert rates[0, 1, 2] > rates[0, 0, 2] and rates[3, 1, 2] > rates[3, 0, 2]


def test_planted_data_is_found_and_the_rest_left_alone(spark, documents, planted):
    rows, truth = planted
    model = P.fit(documents(rows))
    found = {x["doc_id"]: x for x in P.personal_spans(documents(rows), model=model).collect()}
    missed = [(P.KINDS[k].name, t) for i, (k, t) in truth.items() if not any(s["kind"] == k and found[i]["text"][s["start"]:s["end"]] == t for s in found[i]["personal_spans"])]
    false = [(i, found[i]["text"][s["start"]:s["end"]]) for i in found if i not in truth for s in found[i]["personal_spans"] if s["kind"] >= P.BASE_KINDS]
    assert not missed and not false, (missed, false)
    hidden = {x["doc_id"]: x["text"] for x in P.masked(documents(rows), model=model).collect()}
    texts = dict(rows)
    for i, (_, t) in truth.items():
        assert t not in hidden[i] and "[personal]" in hidden[i]
    assert all(hidden[i] == texts[i] for i in texts if not found[i]["personal_spans"])


def test_labelers():
    assert re.fullmatch(P.IP.replace("*+", "*"), "1.02.255.0") and not re.fullmatch(P.IP.replace("*+", "*"), "1.2.3.256")
    assert P.MOST_CODES == len(P.KINDS) * 243 * 4 < 10_000


def test_odd_tables(spark, documents):
    rows = [(1, None), (2, ""), (3, "call +1 (743) 555-3824 now"), (3, "call +1 (743) 555-3824 now"), (None, "x@y.com")]
    named = documents(rows).withColumns({"personal_spans": F.lit(1), "Personal_Candidates": F.lit(2), "a.b": F.lit("z"), "weights": F.lit(0)})
    out = P.personal_spans(named)
    assert out.columns == [*named.columns, "personal_spans_"]
    assert sorted(len(x["personal_spans_"]) for x in out.collect()) == [0, 0, 1, 1, 1]
    assert P.masked(named).columns == named.columns and sorted(str(x["text"]) for x in P.masked(named).collect()) == sorted(
        ["None", "", "call [personal] now", "call [personal] now", "[personal]"])
    assert P.personal_spans(documents([])).count() == 0 and P.masked(documents([])).count() == 0
    dotted = documents(rows).withColumnRenamed("text", "the.text")
    assert P.masked(dotted, "the.text").columns == dotted.columns


def test_query_base_columns(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_weak_labels"](spark, SMALL).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        base = plain_base(text)
        said = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(b[1] == j for b in base) for j in range(4)] and set(said.split(",")) <= set(got[i]["spans"].split(","))
