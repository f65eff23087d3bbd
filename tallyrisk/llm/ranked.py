"""Ranked lexical search by hashed max-sketches.

Every document's term impacts fold into SLOTS hashed coordinates, each holding the largest. Looking the items' terms up in the
sketches of a block of documents, all items at once, gives a bound that no score exceeds. Each item then takes the documents in
falling order of their bounds and scores them exactly until the bounds fall below the last of its best so far. Tasks keep their
best few for each item, and one ranking over those ends the search.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrisk.llm.common import opened, query, ship, table

# SLOTS coordinates in a sketch; BLOCK documents are bounded at once, against items of at most ITEM_BYTES of text.
SLOTS, BLOCK, ITEM_BYTES = 2048, 512, 1 << 20
BEST = 10
# Scales of weights and shares, and the length part of a document's m in hundredths.
WEIGHT, SHARE, SHARE_TF, SHARE_M, LENGTH = 1000, 1_000_000_000, 1000, 8, 90
# Bytes of terms in lower case; ASCII other than letters and digits parts terms.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Items:
    """Search items: the places of their terms, their weights, and the lookup of all items in sketches at once."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        found = [sorted(set(terms(t))) for t in texts]
        self.number = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        self.terms = [np.array([self.number[t] for t in f], np.int64) for f in found]
        self.slot = np.array([crc32(t) % SLOTS for t in self.number], np.int64)
        self.weight = None

    def learn(self, n_docs: int, n_terms: int, frequency: dict[bytes, int]) -> None:
        """Weights of the terms from the corpus; its size and length for the documents' m."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in self.number], np.int64)
        # Only looked-up coordinates are held; a sketch's other ones bound nothing.
        self.held, place = np.unique(self.slot, return_inverse=True)
        self.place = place
        self.lookup = np.zeros((len(self.held), len(self.ids)))
        for item, numbers in enumerate(self.terms):
            np.add.at(self.lookup[:, item], place[numbers], self.weight[numbers].astype(float))

    def shares(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """(term numbers, their shares) of the items' terms in a document: the impacts without the terms' weights."""
        found = terms(text)
        counts = [(self.number[t], c) for t, c in Counter(found).items() if t in self.number]
        if not counts:
            return None
        numbers, tf = np.array(counts, np.int64).T
        m = 100 - LENGTH + LENGTH * len(found) * self.n_docs // self.n_terms
        return numbers, SHARE * tf // (SHARE_TF * tf + SHARE_M * m)

    def score(self, item: int, impacts: tuple[np.ndarray, np.ndarray]) -> int:
        numbers, shares = impacts
        # Each term has weight times share; sums of int64 stay exact.
        mine = np.isin(numbers, self.terms[item], assume_unique=True)
        return int((self.weight[numbers[mine]] * shares[mine]).sum())


def _key(doc_id):
    """Order of equal scores: smaller ids first, a NULL id last."""
    return (doc_id is None or doc_id != doc_id, doc_id)


class Search:
    """The best documents of every item over the blocks seen so far."""

    def __init__(self, items: Items, best: int):
        self.items, self.best = items, best
        self.found: list[list] = [[] for _ in items.ids]
        self.scored = 0

    def take(self, ids: list, texts: list[bytes]) -> None:
        items, held, impacts = self.items, [], []
        for doc_id, text in zip(ids, texts):
            if (one := items.shares(text)) is not None:
                held.append(doc_id)
                impacts.append(one)
        if not held:
            return
        sketch = np.zeros((len(held), len(items.held)))
        for row, (numbers, shares) in enumerate(impacts):
            np.maximum.at(sketch[row], items.place[numbers], shares)
        # Weights and shares are whole numbers whose sums stay below 2^53, so the bounds are exact in doubles.
        bounds = sketch @ items.lookup
        for item, best in enumerate(self.found):
            mine = bounds[:, item]
            least = best[self.best - 1][0] if len(best) >= self.best else 1
            hopeful = np.flatnonzero(mine >= least)
            for row in hopeful[np.argsort(-mine[hopeful], kind="stable")].tolist():
                if len(best) >= self.best and mine[row] < best[self.best - 1][0]:
                    break
                self.scored += 1
                if (score := items.score(item, impacts[row])) > 0:
                    best.append((score, held[row]))
                    best.sort(key=lambda b: (-b[0], _key(b[1])))
                    del best[self.best:]

    def rows(self) -> list[tuple]:
        return [(self.items.ids[i], doc_id, score) for i, best in enumerate(self.found) for score, doc_id in best]


def blocks(items: DataFrame) -> Iterator[Items]:
    """Items in blocks of about ITEM_BYTES of text, each small enough for the driver and a task."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // ITEM_BYTES) + 1
    for block in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text", F.lit(3)), F.lit(n)) == block) if n > 1 else items
        rows = part.collect()  # about ITEM_BYTES
        if any(terms(r["text"]) for r in rows):
            yield Items([r["item"] for r in rows], [r["text"] for r in rows])


def statistics(texts: DataFrame, items: Items) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and how many documents hold each of the items' terms; summed in tasks first."""
    told = ship(texts.sparkSession, items)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, frequency, docs, n = opened(told).number, Counter(), 0, 0
        for frame in batches:
            for text in frame["text"]:
                found = terms(text)
                docs, n = docs + bool(found), n + len(found)
                frequency.update(t for t in set(found) if t in number)
        yield pd.DataFrame([(None, docs, n), *((t, c, 0) for t, c in frequency.items())], columns=["term", "docs", "n"])

    total = texts.select("text").mapInPandas(count, "term binary, docs long, n long").groupBy("term").agg(F.sum("docs"), F.sum("n"))
    rows = {None if t is None else bytes(t): (d, n) for t, d, n in total.collect()}  # the items' terms and one row
    docs, n = rows.pop(None, (0, 0))
    return docs, n, {t: d for t, (d, _) in rows.items()}


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): each item's `best` documents of largest score above 0; equal scores by ascending id, NULL last.

    NULL and empty texts have no terms: such documents are never found, such items find none. Rows of `docs` are ranked one by
    one, so a repeated row takes as many ranks as it has copies; rows of `items` are equal searches each, told apart by id and
    text, equal ones as one. Other columns are not read. Without items or documents there are no rows.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"item {item_type}, place long, id {id_type}, score long"
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("text")).distinct()
    out, place = None, 0
    for block in blocks(asked):
        n_docs, n_terms, frequency = statistics(texts, block)
        if not n_terms:
            break
        block.learn(n_docs, n_terms, frequency)
        told, first = ship(docs.sparkSession, block), place
        place += len(block.ids)

        def search(batches: Iterator[pd.DataFrame], told=told, first=first) -> Iterator[pd.DataFrame]:
            state = Search(opened(told), best)
            for frame in batches:
                ids, held = frame["id"].astype(object).where(frame["id"].notna(), None).tolist(), frame["text"].tolist()
                for low in range(0, len(ids), BLOCK):
                    state.take(ids[low:low + BLOCK], held[low:low + BLOCK])
            rows = [(state.items.ids[i], first + i, doc_id, score) for i, kept in enumerate(state.found) for score, doc_id in kept]
            yield pd.DataFrame(rows, columns=["item", "place", "id", "score"])

        found = texts.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.range(0).select(F.lit(None).cast(item_type).alias("item"), F.lit(0).cast("long").alias("place"),
                                                F.lit(None).cast(id_type).alias("id"), F.lit(0).cast("long").alias("score"))
    # A task sends at most `best` rows an item.
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS t
  FROM documents),
e AS MATERIALIZED (SELECT row, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM e),
i AS MATERIALIZED (SELECT row_number() OVER () AS place, item_id, list_distinct(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS MATERIALIZED (SELECT place, item_id, unnest(t) AS term FROM i),
p AS MATERIALIZED (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM e) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor({WEIGHT} * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT place, item_id, row, doc_id, sum(w * (({SHARE} * tf) // ({SHARE_TF} * tf + {SHARE_M} * (100 - {LENGTH} + ({LENGTH} * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {BEST}"""


@query("op13_max_sketch", sql=_ORACLE)
def op13(spark, sf_dir):
    """item_id, rank, doc_id and score of each benchmark item's ten best documents."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
