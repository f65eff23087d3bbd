"""Benchmark decontamination: BM25 inverted index of benchmark items, searched by block-max WAND.

Every passage of every document (PASSAGE_WORDS words, half overlapping) is a query; all items at or above THRESHOLD of
their own BM25 score are retrieved, and then the item's question and answer must each be found in the text around.
Items longer than half a passage are indexed in pieces, so that a copied piece always lies whole in one passage.

The index is sent to the tasks in shards of at most SHARD_BYTES of item text; documents are read once per shard.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.llm.common import opened, query, ship, table

# Words of a passage and of an indexed piece, BM25 settings, least share of an item's own score.
PASSAGE_WORDS, PIECE_WORDS, K1, B, THRESHOLD = 128, 64, 1.2, 0.75, 0.6
# Cells (passages by entries) that are bounded at once.
CELLS = 1 << 22
# Word runs compared when confirming, and the share of the question's and of the answer's runs that must be there.
RUN_WORDS, LEAST_OVERLAP = 4, 0.6
# Parts of fewer words may instead have this share of their words in order, within so many more words than they have.
SHORT_WORDS, LEAST_IN_ORDER, SLACK_WORDS = 12, 0.75, 2
# Share of an entry's score, in its commonest terms, that is presumed before a passage is searched.
PRESUMED = 0.2
# Postings in a block, and item text in one broadcast index.
BLOCK, SHARD_BYTES = 16, 16 << 20

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters and digits, case folded, so that a copy in capitals is still a copy."""
    return _WORD.findall((text or b"").decode("utf-8", "replace").casefold().encode())


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """(question, answer) words: the last sentence is the answer; a single sentence is both."""
    sentences = [s for s in _SENTENCE_END.split(text.strip()) if words(s.encode())]
    if len(sentences) < 2:
        return words(text.encode()), words(text.encode())
    return words(" ".join(sentences[:-1]).encode()), words(sentences[-1].encode())


def overlap(part: Sequence[bytes], found: set[tuple[bytes, ...]], run: int) -> float:
    """Share of the distinct runs of `run` words of `part` that are in `found`."""
    own = {tuple(part[i:i + run]) for i in range(len(part) - run + 1)}
    return len(own & found) / len(own) if own else 0.0


class _Numbers(dict):
    def __missing__(self, _word):
        return -1


class BlockMaxIndex:
    """Postings by term, in ascending entry order, with the largest weight of each block and each term.

    A weight is the term's BM25 share of its entry's own score, so one threshold holds for all entries.
    """

    def __init__(self, entries: list[list[bytes]], frequency: dict[bytes, int] | None = None, total: int | None = None,
                 mean_words: float | None = None):
        total = len(entries) if total is None else total
        if frequency is None:
            frequency = Counter(t for e in entries for t in set(e))
        mean_words = mean_words or (sum(map(len, entries)) / len(entries) if entries else 1.0)
        self.number, postings = _Numbers(), []
        self.spare, essential = np.zeros(len(entries)), []
        for e, entry in enumerate(entries):
            count = Counter(entry)
            norm = K1 * (1 - B + B * len(entry) / mean_words)
            raw = {t: np.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in count.items()}
            own, common = sum(raw.values()), 0.0
            for t, w in sorted(raw.items(), key=lambda x: (x[1], x[0])):
                if t not in self.number:
                    self.number[t] = len(postings)
                    postings.append([])
                share = float(w / own)
                postings[self.number[t]].append((e, share))
                # The entry's commonest terms are taken as present when bounding a passage, the others are looked up.
                if common + share <= PRESUMED:
                    common += share
                else:
                    essential.append((self.number[t], e, share))
            self.spare[e] = common
        self.ids = [[e for e, _ in p] for p in postings]
        self.weights = [[w for _, w in p] for p in postings]
        self.most = [max(w) for w in self.weights]
        self.block_most = [[max(w[i:i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.weights]
        essential.sort()
        term = np.array([t for t, _, _ in essential], np.int64)
        self.e_start = np.searchsorted(term, np.arange(len(postings) + 1))
        self.e_entry = np.array([e for _, e, _ in essential], np.int64)
        self.e_share = np.array([s for _, _, s in essential])

    def search(self, terms: set[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (entry, score) at or above `threshold` for a query of distinct terms, by block-max WAND."""
        ids, weights, most, block_most = self.ids, self.weights, self.most, self.block_most
        at = {t: 0 for t in terms}
        live = sorted(terms)
        found = []
        least = threshold - 1e-9
        while live:
            live.sort(key=lambda t: ids[t][at[t]])
            bound, pivot = 0.0, None
            for k, t in enumerate(live):
                bound += most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return found
            entry = ids[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and ids[live[pivot + 1]][at[live[pivot + 1]]] == entry:
                pivot += 1
            ahead = live[:pivot + 1]
            blocks = [(t, bisect_left(ids[t], entry, at[t]) // BLOCK) for t in ahead]
            limit = sum(block_most[t][b] for t, b in blocks if b < len(block_most[t]))
            if limit < least:
                # No entry before the first of these blocks ends, or the next list begins, can reach the threshold.
                ends = [ids[t][min((b + 1) * BLOCK, len(ids[t])) - 1] + 1 for t, b in blocks if b < len(block_most[t])]
                if pivot + 1 < len(live):
                    ends.append(ids[live[pivot + 1]][at[live[pivot + 1]]])
                target = max(min(ends), entry + 1) if ends else entry + 1
            else:
                score = 0.0
                for t in ahead:
                    i = bisect_left(ids[t], entry, at[t])
                    if i < len(ids[t]) and ids[t][i] == entry:
                        score += weights[t][i]
                if score >= least:
                    found.append((entry, score))
                target = entry + 1
            for t in ahead:
                at[t] = bisect_left(ids[t], target, at[t])
            live = [t for t in live if at[t] < len(ids[t])]
        return found

    def hopeful(self, numbers: np.ndarray) -> np.ndarray:
        """First words of the passages in which some entry's essential terms and all its others could reach THRESHOLD.

        An upper bound for all passages at once: the others need no search.
        """
        place = np.flatnonzero(numbers >= 0)
        step, terms = PASSAGE_WORDS // 2, len(self.ids)
        half = place // step
        passage_term = np.unique(np.r_[half * terms + numbers[place], np.maximum(half - 1, 0) * terms + numbers[place]])
        passage, term = passage_term // max(terms, 1), passage_term % max(terms, 1)
        n = self.e_start[term + 1] - self.e_start[term]
        passage, term, n = passage[n > 0], term[n > 0], n[n > 0]
        if not len(n):
            return n
        entries = len(self.spare)
        rows, out = max(1, CELLS // entries), []
        # Slices of passages, so that a long document takes no more than CELLS cells at once.
        for low in range(0, int(passage[-1]) + 1, rows):
            part = slice(*np.searchsorted(passage, [low, low + rows]))
            m = n[part]
            take = np.repeat(self.e_start[term[part]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            cell = np.repeat(passage[part] - low, m) * entries + self.e_entry[take]
            total = np.bincount(cell, self.e_share[take], min(rows, int(passage[-1]) + 1 - low) * entries).reshape(-1, entries) + self.spare
            out.append(np.flatnonzero((total >= THRESHOLD - 1e-9).any(axis=1)) + low)
        return np.concatenate(out) * step


def in_order(part: list[bytes], around: list[bytes]) -> float:
    """Largest share of a part's words that stand in its order within as many words and SLACK_WORDS more; 0 if under LEAST_IN_ORDER.

    One changed word breaks every run of a short part, and costs one word here.
    """
    n, width = len(part), len(part) + SLACK_WORDS
    least, known = ceil(LEAST_IN_ORDER * n), set(part)
    held = [0, *accumulate(w in known for w in around)]
    best = 0
    for i in range(max(1, len(around) - width + 1)):
        if held[min(i + width, len(around))] - held[i] >= max(least, best + 1):
            longest = [0] * (n + 1)
            for word in around[i:i + width]:
                before = longest[:]
                for j in range(n):
                    longest[j + 1] = before[j] + 1 if part[j] == word else max(before[j + 1], longest[j])
            best = max(best, longest[n])
    return best / n if best >= least else 0.0


class Benchmark:
    """One shard of items: their pieces in an index, and what confirms a retrieved item."""

    def __init__(self, item_ids: list, texts: list[str], frequency=None, total=None, mean_words=None):
        self.item_ids, entries, self.of = item_ids, [], []
        self.parts = [parts(t) for t in texts]
        self.length = [len(words(t.encode())) for t in texts]
        for i, text in enumerate(texts):
            for piece in pieces(words(text.encode())):
                entries.append(piece)
                self.of.append(i)
        self.index = BlockMaxIndex(entries, frequency, total, mean_words)

    def matches(self, text: bytes | None) -> dict[int, tuple[float, float, float, int]]:
        """item place -> (score, question overlap, answer overlap, first word of the passage) of confirmed items."""
        tokens = words(text)
        numbers = np.fromiter(map(self.index.number.__getitem__, tokens), np.int64, len(tokens))
        best: dict[int, tuple[float, float, float, int]] = {}
        for start in self.index.hopeful(numbers):
            passage = set(numbers[start:start + PASSAGE_WORDS].tolist()) - {-1}
            for entry, score in self.index.search(passage):
                item = self.of[entry]
                if item in best and best[item][0] >= score:
                    continue
                around = tokens[max(0, start - self.length[item]):start + PASSAGE_WORDS + self.length[item]]
                shares = []
                for part in self.parts[item]:
                    run = min(RUN_WORDS, len(part))
                    share = overlap(part, {tuple(around[i:i + run]) for i in range(len(around) - run + 1)}, run) if run else 1.0
                    if share < LEAST_OVERLAP and len(part) < SHORT_WORDS:
                        share = max(share, in_order(part, around))
                    shares.append(share)
                if min(shares) >= LEAST_OVERLAP:
                    best[item] = score, shares[0], shares[1], int(start)
        return best


def pieces(item: list[bytes]) -> list[list[bytes]]:
    """An item whole, or its runs of PIECE_WORDS words; a short rest joins the last run's end."""
    if len(item) <= PIECE_WORDS:
        return [item] if item else []
    starts = list(range(0, len(item) - PIECE_WORDS + 1, PIECE_WORDS))
    if starts[-1] + PIECE_WORDS < len(item):
        starts.append(len(item) - PIECE_WORDS)
    return [item[s:s + PIECE_WORDS] for s in starts]


def shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Benchmark]:
    """The benchmark in indexes of about SHARD_BYTES of text, with frequencies counted over all items."""
    clean = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    size = clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // SHARD_BYTES) + 1

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for text in frame["text"]:
                for piece in pieces(words(text.encode())):
                    distinct = sorted(set(piece))
                    yield pd.DataFrame({"term": distinct, "n": [len(piece)] + [0] * (len(distinct) - 1)})

    counted = clean.mapInPandas(tokens, "term binary, n long")
    total, length = counted.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    for shard in range(n):
        part = clean.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(n)) == shard)
        rows = part.orderBy("id", "text").collect()  # at most about SHARD_BYTES
        if rows:
            mine = part.mapInPandas(tokens, "term binary, n long").select("term").distinct()
            frequency = {bytes(r[0]): r[1] for r in counted.join(mine, "term").groupBy("term").count().collect()}
            yield Benchmark([r["id"] for r in rows], [r["text"] for r in rows], frequency, total, length / total if total else None)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, score, question_overlap, answer_overlap, first_word) of every document and item confirmed in it.

    Rows of `docs` are searched one by one, so repeated rows and ids give repeated results. NULL and empty texts and items
    match nothing; equal items under different ids are both reported. Without items or documents there are no rows.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, score double, question_overlap double, answer_overlap double, first_word long"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for benchmark in shards(items, item_col, item_text_col):
        told = ship(docs.sparkSession, benchmark)

        def search(batches: Iterator[pd.DataFrame], told=told) -> Iterator[pd.DataFrame]:
            bench = opened(told)
            for frame in batches:
                rows = [(i, bench.item_ids[item], *found) for i, text in zip(frame["id"], frame["text"])
                        for item, found in bench.matches(text).items()]
                yield pd.DataFrame(rows, columns=["id", "item", "score", "question_overlap", "answer_overlap", "first_word"])

        found = texts.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def is_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Column:
    """True for rows of `docs` in which no item is confirmed; a NULL text is clean."""
    text, clean = F.coalesce(docs[text_col], F.lit("")).cast("binary"), F.lit(True)
    for benchmark in shards(items, item_col, item_text_col):
        clean = clean & _without(ship(docs.sparkSession, benchmark))(text)
    return clean


def _without(told):
    @F.pandas_udf("boolean")
    def without(texts: pd.Series) -> pd.Series:
        return pd.Series([not opened(told).matches(t) for t in texts], dtype=bool)

    return without


@query("op1_block_max_wand")
def op1(spark, sf_dir):
    """doc_id, item_id, score, overlaps and place of every benchmark item confirmed in a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
