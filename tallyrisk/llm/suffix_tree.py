"""Language-model scoring by a probabilistic suffix tree (Ron, Singer and Tishby).

Contexts are the last one to DEPTH words. A next word is listed under a context where the two together occur LEAST_COUNT times;
every context with a listed word is a candidate, and is retained where its next words diverge enough from those of its own
suffix. Listed words give up DISCOUNT of a count each, and that and everything unlisted is spread as under the longest retained
suffix. The root gives words their share of the tokens, less the share of words seen once for words never seen. Each word is
scored in the longest retained state.

`learn_and_score` deals each place of the documents by the last word of its context: all longer contexts over that word are a subtree of
the tree, so a hash range counts, retains and scores its places by itself. A context that occurs _HOT_TOKENS times is too much for a
task: such hot contexts are grown as Spark tables a level at a time, their places are dealt by longer contexts, and the subtrees ask for
what they take from outside, as for the probabilities of rare words. What makes up HEAD_SHARE of the tokens is sent to tasks.

`fit` keeps all levels as Spark tables, for `scored`: common runs are sent to tasks, all others meet their values by hash range, after a filter of
fixed size has let go most that have none. Runs that occur once are let go by a first pass a level, which sends 48 bits of each
run's hash as sorted gaps of about four bytes.

Runs and words are known by 64-bit hashes; of 2e10 runs about ten pairs share one and mix their values. What is written on the way
is deleted once it is read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrisk.landing import discard, land, land_at
from tallyrisk.llm.common import is_held_out, opened, query, ship, table

DEPTH = 3
# Shares of the tokens from which words are numbered, and runs sent to tasks; of no effect on results.
VOCABULARY_SHARE, HEAD_SHARE = 5e-7, 1e-6
# Least count of anything listed, count given up, and the nats a token and in all by which a context has to diverge.
LEAST_COUNT, DISCOUNT, LEAST_DIVERGENCE, LEAST_GAIN = 2, 0.5, 0.002, 10.0
BASE_ADD = 0.1

END = b""  # no word is empty, so the end token is
_FLUSH_WORDS, _FLUSH_KEYS, _SLICE_WORDS = 300_000, 1 << 20, 1 << 18
# Bits of a filter's cells and of what is sent of a run in the first pass; tokens for which there is one hash range more.
_FILTER_BITS, _SENT_BITS, _RANGE_TOKENS = 28, 48, 1 << 19
# Documents are scored in so many parts, one after another: the disk holds the runs of one.
_PARTS = 2
# Training tokens from which a context is hot: its places are dealt by longer contexts.
_HOT_TOKENS = 1 << 19
# In place of a word's number: one without that may occur LEAST_COUNT times, and one that does not.
_RARE, _NONE = -2, -1
# Bits of a word's hash by which tasks look up its number.
_CELL_BITS = 20


def tokens(text: bytes | None) -> list[bytes]:
    """Words between the blanks 0x20 and 0x09 to 0x0D, A-Z lower-cased, then the end."""
    found = (text or b"").lower().split()
    found.append(END)
    return found


class _Numbers(dict):
    def __missing__(self, _word):
        return -1


class _Hashes(dict):
    """Hashes of words met; see `hashes`."""


def hashes(words: list[bytes], _known: _Hashes | None = None) -> np.ndarray:
    """64-bit hashes of words (SipHash under a fixed key)."""
    held = np.empty(len(words), object)
    held[:] = words
    return hash_array(held, categorize=False).view(np.int64)


def longer(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of the run whose words but the last are `context`, and but the first `suffix` (for two words, their hashes)."""
    x = context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + suffix.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def runs(word: np.ndarray, longest: int) -> list[np.ndarray]:
    """Keys of the runs of 1 to `longest` words that end at each position; the first of longer ones is at their own length - 1."""
    out = [word]
    for _ in range(longest - 1):
        out.append(longer(out[-1][:-1], out[-1][1:]))
    return out


def _places_of(among: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where `keys` are in sorted `among`; -1 for those that are not."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


@dataclass
class Level:
    """Contexts of one length. Tables: `entries` (gram, n, p, value) and `contexts` (context, total, spare, retained); the arrays
    hold total and retained of those contexts that tasks are sent."""

    entries: DataFrame
    contexts: DataFrame
    total: np.ndarray
    retained: np.ndarray


@dataclass
class SuffixTree:
    vocabulary: list[bytes]
    count: np.ndarray  # by word number
    n: int
    distinct: int
    once: int
    levels: list[Level] = field(default_factory=list)
    # Sent to tasks: sorted keys of runs, what each adds where it ends, and what to the word after it.
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    after: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self._number = self._hashes = None

    def __getstate__(self):
        return {**self.__dict__, "_number": None, "levels": []}

    def light(self) -> SuffixTree:
        """This tree for tasks that know words by their hashes only."""
        self.hashes(np.zeros(0, np.int64))
        out = SuffixTree([], self.count, self.n, self.distinct, self.once, [], self.key, self.value, self.after)
        out._hashes = self._hashes
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if self._number is None:
            self._number = _Numbers((w, i) for i, w in enumerate(self.vocabulary))
        return np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        """Hashes of numbered words; 0 for number -1."""
        if self._hashes is None:
            self._hashes = np.append(hashes(self.vocabulary), 0)
        return self._hashes[numbers]

    @property
    def unseen(self) -> float:
        """Probability of the class of words never seen."""
        return (self.once + 1.0) / (self.n + 2.0)

    def root(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, (1 - self.unseen) * count / max(self.n, 1), self.unseen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + BASE_ADD) / (self.n + BASE_ADD * (self.distinct + 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of runs among those sent to tasks; -1 for others."""
        return _places_of(self.key, keys)

    def log_probabilities(self, words: np.ndarray) -> np.ndarray:
        """log10 of each numbered word's probability, by the runs sent to tasks; of one without number, without its root factor."""
        known = words >= 0
        out = np.where(known, np.log10(self.root(self.count[words])), 0.0)
        known_as = _Hashes()
        word = np.where(known, hashes([self.vocabulary[i] for i in words], known_as), hashes([b" "], known_as))  # no word is a blank
        for length, keys in enumerate(runs(word, min(DEPTH + 1, len(word)))):
            at = self.find(keys)
            out[length:] += np.where(at >= 0, self.value[at] if len(self.value) else 0.0, 0.0)
            out[length + 1:] += np.where(at >= 0, self.after[at] if len(self.after) else 0.0, 0.0)[:-1]
        return out


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counted: Counter = Counter()
    for frame in batches:
        for text in frame["text"]:
            counted.update(tokens(text))
            if len(counted) >= _FLUSH_WORDS:
                yield pd.DataFrame({"token": list(counted), "n": list(counted.values())})
                counted.clear()
    yield pd.DataFrame({"token": list(counted), "n": list(counted.values())})


def _counted(texts: DataFrame) -> tuple[SuffixTree, DataFrame]:
    """The tree's root, and the table (token, n), from `texts` (text binary)."""
    counts = land(texts.mapInPandas(_word_counts, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
                  .select(F.col("token").cast("string").alias("token"), "n"), "lm-counts")
    n, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    # The end is always numbered, so that only words are ever sent to meet their counts.
    frequent = (counts.filter((F.col("n") >= max(LEAST_COUNT, VOCABULARY_SHARE * n)) | (F.col("token") == ""))
                .orderBy(F.col("n").desc(), "token").toPandas())
    return SuffixTree([t.encode() for t in frequent["token"]], frequent["n"].to_numpy(np.int64), n, distinct, once), counts


def _cut(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes], np.ndarray, np.ndarray]]:
    """Rows of about _SLICE_WORDS words together: (rows, their words end to end, whose word each is, its place there)."""
    words: list[bytes] = []
    sizes: list[int] = []
    for i, text in enumerate(frame["text"]):
        found = tokens(text)
        words += found
        sizes.append(len(found))
        if len(words) >= _SLICE_WORDS or i == len(frame) - 1:
            of = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield frame.iloc[i + 1 - len(sizes):i + 1], words, of, place
            words, sizes = [], []


def _slices(frame: pd.DataFrame, known: _Hashes) -> Iterator[tuple[pd.DataFrame, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """As `_cut`, with the words' hashes: (rows, words, hashes, whose, place)."""
    for rows, words, of, place in _cut(frame):
        yield rows, words, hashes(words, known), of, place


def _range_bits(n: int) -> int:
    """Hash ranges are 2 to this power: in proportion to the tokens, so that no range grows with the input."""
    return min(max(int(n // _RANGE_TOKENS).bit_length(), 3), 16)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as the first one and gaps, in planes of as many bytes as the widest gap needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=keys[:1])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(blob, np.uint8, offset=9).reshape(blob[0], -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :blob[0]] = planes.T
    return np.frombuffer(blob, np.uint64, 1, 1) + np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)


def _narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 in 1, 2, 4 or 8 bytes each, as the largest needs."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _widened(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"u{blob[0]}", offset=1).astype(np.int64)


def _by_range(keys: np.ndarray, range_bits: int) -> Iterator[tuple[int, slice]]:
    """(hash range, where its keys are) of sorted unsigned keys."""
    found, starts = np.unique(keys >> np.uint64(64 - range_bits), return_index=True)
    for which, start, end in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield which, slice(start, end)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct one of sorted keys starts."""
    return np.flatnonzero(np.r_[np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]])


def _piece(which: int, cells: np.ndarray, range_bits: int) -> pd.DataFrame:
    bits = np.zeros(1 << (_FILTER_BITS - range_bits), bool)
    bits[cells & ((1 << (_FILTER_BITS - range_bits)) - 1)] = True
    return pd.DataFrame({"range": [which], "bits": [zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)]})


def _gathered(pieces: DataFrame, range_bits: int) -> bytes:
    """A filter of one piece a hash range; it is kept and sent compressed."""
    out = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    width = len(out) >> range_bits
    for row in pieces.collect():
        out[row["range"] * width:(row["range"] + 1) * width] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return zlib.compress(out.tobytes(), 1)


def _filter(keys: DataFrame, name: str, range_bits: int) -> bytes:
    """Bits of a fixed number of cells that are set where `keys` has a key of the cell: a key without its bit is not there."""
    cells = keys.select(F.shiftrightunsigned(name, 64 - _FILTER_BITS).cast("int").alias("cell")).withColumn("range", F.shiftright("cell", _FILTER_BITS - range_bits))
    return _gathered(cells.groupBy("range").applyInPandas(
        lambda frame: _piece(int(frame["range"].iloc[0]), frame["cell"].to_numpy(np.int64), range_bits), "range int, bits binary"), range_bits)


def _opened_bits(shipped) -> list[np.ndarray]:
    """The filters of a `ship`, opened once per worker process."""
    if not hasattr(shipped, "bits"):
        shipped.bits = [np.frombuffer(zlib.decompress(b), np.uint8) for b in opened(shipped)]
    return shipped.bits


def _may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys.view(np.uint64) >> np.uint64(64 - _FILTER_BITS)
    return bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 > 0


def _met_twice(train: DataFrame, length: int, below: bytes, range_bits: int) -> bytes:
    """A filter that has all runs of `length` + 1 words that occur twice in `train`, and few others.

    A run occurs no more often than its context and suffix, so only runs whose both are in the filter `below` are sent.
    """
    shipped, dropped = ship(train.sparkSession, [below]), np.uint64(64 - _SENT_BITS)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (bits,), known = _opened_bits(shipped), _Hashes()
        kept, size = [], 0

        def sent() -> pd.DataFrame:
            keys = np.sort(np.concatenate(kept) if kept else np.zeros(0, np.uint64))
            first = _firsts(keys)
            again, keys = np.diff(first, append=len(keys)) > 1, keys[first]
            rows = [(which, _packed(keys[at][~again[at]]), _packed(keys[at][again[at]])) for which, at in _by_range(keys << dropped, range_bits)]
            return pd.DataFrame(rows, columns=["range", "once", "again"])

        for frame in batches:
            for _, _, word, _, place in _slices(frame, known):
                keys = runs(word, length)[-1]
                has = _may_have(bits, keys)
                on = (place[length:] >= length) & has[:-1] & has[1:]
                kept.append(longer(keys[:-1][on], keys[1:][on]).view(np.uint64) >> dropped)
                size += len(kept[-1])
                if size >= _FLUSH_KEYS:
                    yield sent()
                    kept, size = [], 0
        yield sent()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        once = np.sort(np.concatenate([_unpacked(b) for b in frame["once"]]))
        keys = np.concatenate([once[1:][once[1:] == once[:-1]], *[_unpacked(b) for b in frame["again"]]])
        return _piece(int(frame["range"].iloc[0]), (keys >> np.uint64(_SENT_BITS - _FILTER_BITS)).astype(np.int64), range_bits)

    return _gathered(train.select("text").mapInPandas(seen, "range int, once binary, again binary").groupBy("range")
                     .applyInPandas(merged, "range int, bits binary"), range_bits)


def _counted_runs(train: DataFrame, length: int, twice: bytes | None, range_bits: int,
                  contexts: np.ndarray | None = None, hot: frozenset[bytes] = frozenset()) -> DataFrame:
    """(gram, context, suffix, n) of the runs of `length` + 1 words in `train` that occur LEAST_COUNT times; the filter `twice` has them,
    or, without one, those under the sorted keys `contexts`, of words in `hot`.

    Runs are summed in the tasks before the shuffle.
    """
    shipped = ship(train.sparkSession, [twice] if twice is not None else contexts)

    def summed(context: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        gram = longer(context, suffix).view(np.uint64)
        order = np.argsort(gram)
        gram = gram[order]
        first = _firsts(gram)
        return gram[first], context[order][first], suffix[order][first], np.add.reduceat(n[order], first) if len(first) else n[:0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = _opened_bits(shipped)[0] if twice is not None else opened(shipped)
        kept, size = [], 0

        def sent() -> pd.DataFrame:
            context, suffix = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 2
            gram, context, suffix, n = summed(context, suffix, np.ones(len(context), np.int64))
            rows = [(which, context[at].tobytes(), suffix[at].tobytes(), _narrow(n[at])) for which, at in _by_range(gram, range_bits)]
            return pd.DataFrame(rows, columns=["range", "context", "suffix", "n"])

        def over(words: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            on = place >= length
            of_hot = np.fromiter(map(hot.__contains__, words), bool, len(words))
            for back in range(1, length + 1):
                on[back:] &= of_hot[:-back]
            at = np.flatnonzero(on)
            said = np.zeros(len(words), bool)
            for back in range(length + 1):
                said[at - back] = True
            key = np.zeros(len(words), np.int64)
            key[said] = hashes([words[i] for i in np.flatnonzero(said).tolist()])
            at = at[_places_of(wanted, _run_ending(key, at - 1, length)) >= 0]
            return _run_ending(key, at - 1, length), _run_ending(key, at, length)

        for frame in batches:
            for _, words, _, place in _cut(frame):
                if twice is None:
                    kept.append(over(words, place))
                    size += len(kept[-1][0])
                elif length < len(words):
                    *_, keys, grams = runs(hashes(words), length + 1)
                    on = (place[length:] >= length) & _may_have(wanted, grams)
                    kept.append((keys[:-1][on], keys[1:][on]))
                    size += len(kept[-1][0])
                if size >= _FLUSH_KEYS:
                    yield sent()
                    kept, size = [], 0
        yield sent()

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        gram, context, suffix, n = summed(*(np.concatenate([np.frombuffer(b, np.int64) for b in frame[c]]) for c in ("context", "suffix")),
                                          np.concatenate([_widened(b) for b in frame["n"]]))
        on = n >= LEAST_COUNT
        return pd.DataFrame({"gram": gram.view(np.int64)[on], "context": context[on], "suffix": suffix[on], "n": n[on]})

    return (train.select("text").mapInPandas(count, "range int, context binary, suffix binary, n binary").groupBy("range")
            .applyInPandas(merged, "gram long, context long, suffix long, n long"))


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Files of a shuffle are deleted when its query has ended: all that is read again here is a written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _words(counts: DataFrame, tree: SuffixTree) -> DataFrame:
    """(gram, n, p) of the words that occur LEAST_COUNT times."""
    hashed = F.pandas_udf(lambda t: pd.Series(hashes([w.encode() for w in t], _Hashes())), "long")
    return counts.filter((F.col("n") >= LEAST_COUNT)).select(
        hashed("token").alias("gram"), "n", (F.col("n") * ((1 - tree.unseen) / max(tree.n, 1))).alias("p"))


def _level(counted: DataFrame, below: DataFrame, totals: DataFrame, landed: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entries, contexts) of a `Level` from its counted runs, the entries of the level below and (context, total)."""
    rows_at, rows = land_at(counted.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("under")), "suffix")
                            .select("context", "gram", "n", "under"), "lm-rows")
    n, total, rest = F.col("n"), F.col("total"), 1 - F.col("listed") / F.col("total")
    gain = ((F.col("gain") - F.col("listed") * F.log(total)) / total
            + F.when(rest > 1e-9, rest * F.log(rest / F.greatest(1 - F.col("under"), F.lit(1e-9)))).otherwise(0.0))
    contexts = landed(rows.groupBy("context").agg(F.sum("n").alias("listed"), F.count("*").alias("words"), F.sum("under").alias("under"),
                                                F.sum(n * F.log(n / F.col("under"))).alias("gain"))
                    .join(totals, "context")
                    .select("context", "total", F.greatest(1 - (F.col("listed") - DISCOUNT * F.col("words")) / total, F.lit(1e-12)).alias("spare"),
                            ((gain >= LEAST_DIVERGENCE) & (gain * total >= LEAST_GAIN)).alias("retained")), "lm-contexts")
    own = (n - DISCOUNT) / total + F.col("spare") * F.col("under")
    # What is not retained has its suffix's probability, and nothing over it.
    entries = landed(rows.join(contexts, "context").select(
        "gram", "n", F.when(F.col("retained"), own).otherwise(F.col("under")).alias("p"),
        F.when(F.col("retained"), F.log10(own) - F.log10("spare") - F.log10("under")).otherwise(0.0).alias("value")), "lm-level")
    discard(counted.sparkSession, rows_at)
    return entries, contexts


def _grown(tree: SuffixTree, counts: DataFrame, train: DataFrame, depth: int) -> tuple[SuffixTree, DataFrame, bytes]:
    """(tree with its levels, (gram, add) of the runs that tasks are not sent, the filter of all runs that add); two passes over `train`
    a level."""
    spark, range_bits = train.sparkSession, _range_bits(tree.n)
    below = land(_words(counts, tree), "lm-words")
    filters = [_filter(below, "gram", range_bits)]
    for length in range(1, depth + 1):
        filters.append(_met_twice(train, length, filters[-1], range_bits))
    for length in range(1, depth + 1):
        counted_at, counted = land_at(_counted_runs(train, length, filters[length], range_bits), "lm-runs")
        below, contexts = _level(counted, below, below.select(F.col("gram").alias("context"), F.col("n").alias("total")), land)
        discard(spark, counted_at)
        if contexts.isEmpty():
            break
        sent = contexts.filter(F.col("total") >= HEAD_SHARE * tree.n).select("total", "retained").toPandas()
        tree.levels.append(Level(below, contexts, sent["total"].to_numpy(np.float64), sent["retained"].to_numpy(bool)))
    adds = [x for level in tree.levels for x in (
        level.entries.filter("value <> 0").select("gram", "n", "value", F.lit(0.0).alias("after")),
        level.contexts.filter("retained").select(F.col("context").alias("gram"), F.col("total").alias("n"), F.lit(0.0).alias("value"), F.log10("spare").alias("after")))]
    none = spark.createDataFrame([], "gram long, n long, value double, after double")
    every = land(reduce(DataFrame.unionByName, adds, none), "lm-adds")
    sent = every.filter(F.col("n") >= HEAD_SHARE * tree.n).groupBy("gram").agg(F.sum("value").alias("value"), F.sum("after").alias("after")).toPandas().sort_values("gram")
    tree.key, tree.value, tree.after = sent["gram"].to_numpy(np.int64), sent["value"].to_numpy(np.float64), sent["after"].to_numpy(np.float64)
    left = every.filter(F.col("n") < HEAD_SHARE * tree.n).select("gram", (F.col("value") + F.col("after")).alias("add"))
    return tree, left, _filter(every, "gram", range_bits)


def fit(texts: DataFrame, depth: int = DEPTH) -> tuple[SuffixTree, DataFrame]:
    """(tree, counts) learnt from `texts` (text binary): counts (token, n) of all tokens stay a table, as do the tree's levels.

    The driver gets what is sent to tasks only. Without texts the tree holds no word.
    """
    with _shuffles_dropped(texts.sparkSession):
        tree, counts = _counted(texts)
        tree, tree.left, tree.bits = _grown(tree, counts, texts, depth)
    return tree, counts


def _scored(docs: DataFrame, tree: SuffixTree, counts: DataFrame, left: DataFrame, bits: bytes, id_col: str, depth: int = DEPTH) -> DataFrame:
    shipped = ship(docs.sparkSession, SuffixTree(tree.vocabulary, tree.count, tree.n, tree.distinct, tree.once, [], tree.key, tree.value, tree.after))
    shipped_bits, range_bits = ship(docs.sparkSession, [bits]), _range_bits(tree.n)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, (bits,), hashed = opened(shipped), _opened_bits(shipped_bits), _Hashes()
        add = model.value + model.after
        log_base, log_root = np.log10(model.base(model.count)), np.log10(model.root(model.count))
        left, whose, size, some = [], [], 0, None

        def sent() -> pd.DataFrame:
            """Distinct runs by hash range, how often each occurs, and in which rows, counted from the first of them; any id."""
            keys, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, whose))
            keys, base = keys.view(np.uint64), of.min(initial=np.iinfo(np.int64).max)
            order = np.argsort(keys)
            keys, of, rows = keys[order], of[order] - base, []
            for which, at in _by_range(keys, range_bits):
                first = _firsts(keys[at])
                rows.append((which, base, some, _packed(keys[at][first]), _narrow(np.diff(first, append=at.stop - at.start)), _narrow(of[at])))
            return pd.DataFrame(rows, columns=["range", "row", "id", "keys", "times", "whose"]).reindex(columns=columns)

        for frame in batches:
            for rows, words, word, of, place in _slices(frame, hashed):
                n, number, row = len(rows), model.numbers(words), rows["row"].to_numpy(np.int64)
                known = number >= 0
                total = np.bincount(of[known], log_root[number[known]], n)
                for length, keys in enumerate(runs(word, min(depth + 1, len(word)))):
                    inside = (place[length:] >= length) & _may_have(bits, keys)
                    keys, of_run = keys[inside], of[length:][inside]
                    at = model.find(keys)
                    total += np.bincount(of_run[at >= 0], add[at[at >= 0]], n)
                    whose.append(row[of_run[at < 0]])
                    left.append(keys[at < 0])
                    size += len(left[-1])
                # Without any training text the end has no number; it is counted as unseen below.
                rare: list[list[bytes]] = [[] for _ in range(n)]
                for i in np.flatnonzero(~known).tolist():
                    rare[of[i]].append(words[i])
                some = rows["id"].iloc[0]
                yield pd.DataFrame({
                    "range": row // _PARTS & ((1 << range_bits) - 1), "row": row, "id": rows["id"].to_numpy(), "n_tokens": np.bincount(of, minlength=n),
                    "n_known": np.bincount(of[known], minlength=n), "base_score": np.bincount(of[known], log_base[number[known]], n),
                    "score": total, "rare": [b" ".join(r) for r in rare], "n_rare": np.bincount(of[~known], minlength=n)}).reindex(columns=columns)
                if size >= _FLUSH_KEYS:
                    yield sent()
                    left, whose, size = [], [], 0
        yield sent()

    id_type = docs.schema["id"].dataType.simpleString()
    told = f"row long, id {id_type}, n_tokens long, n_known long, base_score double, score double, rare binary, n_rare long"
    of_rows = ["row", "id", "n_tokens", "n_known", "base_score", "score", "rare", "n_rare"]
    columns = ["range", *of_rows, "keys", "times", "whose"]
    part = F.pmod(F.xxhash64("id", "text"), F.lit(_PARTS))
    numbered = docs.select((F.col("row") * _PARTS + part).alias("row"), "id", "text", part.alias("part"))

    def worth(adds: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        """The rows of this range as they are, and what its runs add to the rows of each flush."""
        gram, add = adds["gram"].to_numpy(np.int64).view(np.uint64), adds["add"].to_numpy(np.float64)
        order = np.argsort(gram)
        gram, add = gram[order], add[order]
        first = _firsts(gram)
        gram, add = np.append(gram[first], np.uint64(0)), np.append(np.add.reduceat(add, first) if len(first) else add, 0.0)
        whole = sent["keys"].isna()
        out = [sent.loc[whole, of_rows]]
        for base, some, keys, times, whose in sent.loc[~whole, ["row", "id", "keys", "times", "whose"]].itertuples(index=False):
            keys, times, of = _unpacked(keys), _widened(times), _widened(whose)
            at = np.searchsorted(gram[:-1], keys)
            met = np.repeat((gram[at] == keys) & (at < len(gram) - 1), times)
            value = np.bincount(of[met], np.repeat(add[at], times)[met])
            found = np.flatnonzero(np.bincount(of[met]))
            out.append(pd.DataFrame({"id": [some], "flush": [base], "whose": [_narrow(found)], "adds": [value[found].tobytes()]}))
        return pd.concat(out).reindex(columns=[*of_rows, "flush", "whose", "adds"])

    dealt = left.select(F.shiftrightunsigned("gram", 64 - range_bits).cast("int").alias("range"), "gram", "add")
    written = reduce(DataFrame.unionByName, [
        land(dealt.groupBy("range").cogroup(
            numbered.filter(F.col("part") == i).drop("part").mapInPandas(score, f"range int, {told}, keys binary, times binary, whose binary")
            .groupBy("range")).applyInPandas(worth, f"{told}, flush long, whose binary, adds binary"), "lm-parts") for i in range(_PARTS)])
    return _summed(written, tree, counts, id_col)


def _run_ending(key: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Keys of the runs of `length` words that end at the places `at` of the words' hashes `key`."""
    return key[at] if length == 1 else longer(_run_ending(key, at - 1, length - 1), _run_ending(key, at, length - 1))


class _Words:
    """(number, hash) of words: number _RARE for those without one that may occur LEAST_COUNT times, _NONE for those that do not."""

    def __init__(self, model: SuffixTree, bits: np.ndarray):
        self.bits, self.top = bits, np.uint64(64 - _CELL_BITS)
        key = model.hashes(np.arange(len(model.count))).view(np.uint64)
        self.number = np.append(np.argsort(key).astype(np.int32), np.int32(_NONE))
        self.key = np.append(key[self.number[:-1]], np.uint64(0))
        self.first = np.searchsorted(self.key[:-1] >> self.top, np.arange(1 << _CELL_BITS, dtype=np.uint64)).astype(np.int32)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        key = hashes(words).view(np.uint64)
        at = self.first[key >> self.top]
        # Keys of a cell are in order: a word's own is there, or a larger one or the end.
        more = np.flatnonzero((self.key[at] < key) & (at < len(self.key) - 1))
        while len(more):
            at[more] += 1
            more = more[(self.key[at[more]] < key[more]) & (at[more] < len(self.key) - 1)]
        number = np.where((self.key[at] == key) & (at < len(self.key) - 1), self.number[at], np.int32(_NONE))
        unknown = np.flatnonzero(number < 0)
        number[unknown] = np.where(_may_have(self.bits, key[unknown]), _RARE, _NONE)
        return number, key.view(np.int64)


def _words_of(shipped) -> _Words:
    """The words of a `ship` of (tree, ..., filter of words), opened once per worker process."""
    if not hasattr(shipped, "words"):
        model, *_, bits = opened(shipped)
        shipped.words = _Words(model, np.frombuffer(zlib.decompress(bits), np.uint8))
    return shipped.words


def _dealt(model: SuffixTree, number: np.ndarray, key: np.ndarray, place: np.ndarray, salt: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places that have a context, key of the shortest of their contexts that is not hot, how many are).

    All longer contexts over the same word end with that one, so the first bits of its key deal whole subtrees. Where all contexts are hot, nothing is left
    to count and the key is `salt`.
    """
    at = np.flatnonzero((place[1:] >= 1) & (number[:-1] != _NONE)) + 1
    sub, hot = key[at - 1], np.zeros(len(at), np.int64)
    more = np.flatnonzero(model.find(sub) >= 0)
    hot[more] = 1
    for length in range(2, depth + 1):
        goes = place[at[more]] >= length
        goes[goes] = number[at[more[goes]] - length] != _NONE
        sub[more[~goes]] = salt
        more = more[goes]
        sub[more] = _run_ending(key, at[more] - 1, length)
        more = more[model.find(sub[more]) >= 0]
        hot[more] = length
    sub[more] = salt
    return at, sub, hot


def _salt(row: int) -> int:
    return int(longer(np.array([row]), np.array([row]))[0])


def _in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each key, numbered in the keys' order; place of one key of each group)."""
    order = np.argsort(keys)
    first = _firsts(keys[order])
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
    return group, order[first]


def _asked(docs: DataFrame, shipped, entries: DataFrame, range_bits: int, depth: int) -> DataFrame:
    """(range, and packed together gram, p, value) of the `entries` (gram, p, value) that the subtrees of each hash range take from outside: rare words that
    occur LEAST_COUNT times in `train` rows of `docs` after the context a subtree starts with, and runs under its hot contexts."""
    top = np.uint64(64 - range_bits)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, head, _ = opened(shipped)
        met = _words_of(shipped)
        kept, size, salt = [], 0, None

        def sent() -> pd.DataFrame:
            keys, sub, n = (np.concatenate(x) for x in zip(*kept))
            keys, sub, n = _pairs(keys, sub, n)
            rows = [(which, _packed(keys[on]), sub[on].tobytes(), _narrow(n[on])) for which, on in _by_range(keys, range_bits)]
            return pd.DataFrame(rows, columns=["range", "keys", "sub", "n"])

        for frame in batches:
            for rows, words, of, place in _cut(frame):
                number, key = met(words)
                salt = _salt(int(rows["row"].iloc[0])) if salt is None else salt
                at, sub, hot = _dealt(model, number, key, place, salt, depth)
                on = (hot == 0) & (number[at] == _RARE) & rows["train"].to_numpy(bool)[of[at]]
                kept.append((key[at[on]].view(np.uint64), sub[on].view(np.uint64), np.ones(int(on.sum()), np.int64)))
                for length in range(1, int(hot.max(initial=0)) + 1):
                    on = np.flatnonzero((hot >= length) & (number[at] != _NONE))
                    keys = _run_ending(key, at[on], length + 1)
                    other = _places_of(head[0], keys) < 0
                    # These are asked for however often they occur, once by a range.
                    kept.append((keys[other].view(np.uint64), sub[on[other]].view(np.uint64) >> top << top, np.full(int(other.sum()), LEAST_COUNT)))
                size += len(words)
                if size >= _FLUSH_KEYS:
                    yield sent()
                    kept, size, salt = [], 0, None
        if kept:
            yield sent()

    def answered(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(asked):
            keys, sub, n = _pairs(np.concatenate([_unpacked(b) for b in asked["keys"]]), np.concatenate([np.frombuffer(b, np.uint64) for b in asked["sub"]]),
                                  np.concatenate([_widened(b) for b in asked["n"]]))
            on = n >= LEAST_COUNT
            # Keys of a hash range share their first bits, so that signed and unsigned order are one.
            entries = entries.sort_values("gram")
            gram, p, value = entries["gram"].to_numpy(np.int64).view(np.uint64), entries["p"].to_numpy(np.float64), entries["value"].to_numpy(np.float64)
            at = _places_of(gram, keys[on])
            which, found, _ = _pairs(sub[on][at >= 0] >> top, at[at >= 0].astype(np.uint64), n[on][at >= 0])
            first = _firsts(which)
            for here, start, end in zip(which[first].tolist(), first.tolist(), [*first[1:].tolist(), len(which)]):
                places = found[start:end].astype(np.int64)
                rows.append((here, _packed(gram[places]), p[places].tobytes(), value[places].tobytes()))
        return pd.DataFrame(rows, columns=["range", "gram", "p", "value"])

    dealt = entries.select(F.shiftrightunsigned("gram", 64 - range_bits).cast("int").alias("range"), "gram", "p", "value")
    asked = docs.select("row", "train", "text").mapInPandas(ask, "range int, keys binary, sub binary, n binary")
    return dealt.groupBy("range").cogroup(asked.groupBy("range")).applyInPandas(answered, "range int, gram binary, p binary, value binary")


def _pairs(keys: np.ndarray, sub: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with their sums of n."""
    order = np.lexsort((sub, keys))
    keys, sub, n = keys[order], sub[order], n[order]
    first = np.flatnonzero(np.r_[np.ones(min(len(keys), 1), bool), (keys[1:] != keys[:-1]) | (sub[1:] != sub[:-1])])
    return keys[first], sub[first], np.add.reduceat(n, first) if len(first) else n


def _body(number: list[np.ndarray], key: list[np.ndarray], whose: np.ndarray) -> bytes:
    """Places of a hash range: numbers of the word and of those before it in planes of a byte each, hashes of rare words, rows."""
    planes = [(n >> shift).astype(np.uint8).tobytes() for n in number for shift in (0, 8, 16)]
    return zlib.compress(b"".join([*planes, *(k[n == _RARE].tobytes() for n, k in zip(number, key)), _narrow(whose)]), 1)


def _opened_bodies(bodies: list[bytes], places: list[int], words: int, model: SuffixTree) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Numbers, hashes and rows of the places of some bodies, end to end."""
    ends = np.cumsum(places).tolist()
    number = [np.empty(sum(places), np.int32) for _ in range(words)]
    rare: list[list[bytes]] = [[] for _ in range(words)]
    whose = []
    for body, end, size in zip(bodies, ends, places):
        body, start = memoryview(zlib.decompress(body)), 3 * size * words
        for i, all_of in enumerate(number):
            low, middle, high = np.frombuffer(body, np.uint8, 3 * size, 3 * size * i).reshape(3, size)
            n = all_of[end - size:end]
            n[:] = high.view(np.int8)  # numbers are below 2 to the 23, so that the first bit is the sign
            n <<= 8
            n |= middle
            n <<= 8
            n |= low
            many = 8 * int(np.count_nonzero(n == _RARE))
            rare[i].append(body[start:start + many])
            start += many
        whose.append(_widened(body[start:]))
    key = []
    for n, hashed in zip(number, rare):
        key.append(model.hashes(np.maximum(n, -1)))
        key[-1][n == _RARE] = np.frombuffer(b"".join(hashed), np.int64)
    return number, key, np.concatenate(whose)


def _worth(model: SuffixTree, number: list[np.ndarray], key: list[np.ndarray], train: np.ndarray, gram: np.ndarray, p_of: np.ndarray, value_of: np.ndarray) -> np.ndarray:
    """What the contexts of each place add to the root's log10 probability of its word.

    Of words and hashes the first is each place's own, the next the one before it, and so on. `gram`, sorted, has probability and value
    of what is not counted here. Only places whose context has listed words are looked at with a longer one.
    """
    add, n_before = np.zeros(len(train)), len(number) - 1
    p = model.root(model.count[np.maximum(number[0], 0)]) if len(model.count) else np.zeros(len(train))
    rare = np.flatnonzero(number[0] == _RARE)
    at = _places_of(gram, key[0][rare])
    p[rare[at >= 0]] = p_of[at[at >= 0]]
    here, listed = np.arange(len(train)), number[0] != _NONE
    below_context, below_gram = None, key[0]
    ending = {}  # by length: keys of the runs that end before the word before, for the context after next
    for length in range(1, n_before + 1):
        on = number[length][here] != _NONE
        here, listed, below_gram = here[on], listed[on], below_gram[on]
        if length == 1:
            context = key[1][here]
            gram_key = longer(context, below_gram)
        else:
            context = longer(_back(key, here, length, length - 1), below_context[on])
            gram_key = longer(context, below_gram)
        hot = model.find(context)
        cold, goes = np.flatnonzero(hot < 0), np.ones(len(here), bool)
        add[here[hot >= 0]] += model.after[hot[hot >= 0]]
        asked = np.flatnonzero((hot >= 0) & listed)
        at = _places_of(gram, gram_key[asked])
        listed[asked[at < 0]] = False
        asked, at = asked[at >= 0], at[at >= 0]
        p[here[asked]] = p_of[at]
        add[here[asked]] += value_of[at]

        of, _ = _in_order(context[cold])
        contexts = int(of.max(initial=-1)) + 1
        total = np.bincount(of, train[here[cold]], contexts)
        may = np.flatnonzero(listed[cold] & (total[of] >= LEAST_COUNT))
        run, one = _in_order(gram_key[cold[may]])
        n = np.bincount(run, train[here[cold[may]]], len(one))
        under, under_of = p[here[cold[may]]][one], of[may][one]
        often = n >= LEAST_COUNT
        n, under, under_of, place = n[often], under[often], under_of[often], np.cumsum(often) - 1
        words, said = np.bincount(under_of, minlength=contexts), np.bincount(under_of, n, contexts)
        of_all = np.maximum(total, 1)
        rest = 1 - said / of_all
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (np.bincount(under_of, n * np.log(n / under), contexts) - said * np.log(of_all)) / of_all
            gain += np.where(rest > 1e-9, rest * np.log(rest / np.maximum(1 - np.bincount(under_of, under, contexts), 1e-9)), 0.0)
        spare = np.maximum(1 - (said - DISCOUNT * words) / of_all, 1e-12)
        retained = (words > 0) & (gain >= LEAST_DIVERGENCE) & (gain * total >= LEAST_GAIN)
        kept = retained[under_of]
        own = np.where(kept, (n - DISCOUNT) / of_all[under_of] + spare[under_of] * under, under)
        value = np.where(kept, np.log10(own) - np.log10(spare[under_of]) - np.log10(under), 0.0)
        add[here[cold]] += np.where(retained, np.log10(spare), 0.0)[of]
        listed[cold] = False
        met = often[run]
        listed[cold[may[met]]] = True
        p[here[cold[may[met]]]] = own[place[run[met]]]
        add[here[cold[may[met]]]] += value[place[run[met]]]
        goes[cold] = words[of] > 0
        here, listed, below_context, below_gram = here[goes], listed[goes], context[goes], gram_key[goes]
    return add


def _back(key: list[np.ndarray], here: np.ndarray, back: int, length: int) -> np.ndarray:
    """Keys of the runs of `length` words that start `back` words before the places `here`."""
    if length == 1:
        return key[back][here]
    return longer(_back(key, here, back, length - 1), _back(key, here, back - 1, length - 1))


def _hot(tree: SuffixTree, words: DataFrame, train: DataFrame, range_bits: int, depth: int,
         landed: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gram, p, value) of what subtrees take from outside, see `_asked`, as a table, and in arrays those under hot contexts that make up HEAD_SHARE of
    the tokens, which tasks are sent; the tree gets its hot contexts and what each adds to the word after it.

    A context is hot that occurs _HOT_TOKENS times: too often for a task. There are no more of them than DEPTH tokens in so many; they are grown a level at a time.
    """
    spark = train.sparkSession
    entries = [words.filter(F.col("n") < VOCABULARY_SHARE * tree.n).select("gram", "p", F.lit(0.0).alias("value"))]
    often = np.flatnonzero(tree.count >= _HOT_TOKENS)
    hot, n, below = tree.hashes(often), tree.count[often], words
    hot_words = frozenset(tree.vocabulary[i] for i in often.tolist())
    keys, after = [], []
    head = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    for length in range(1, depth + 1):
        if not len(hot):
            break
        order = np.argsort(hot)
        hot, n = hot[order], n[order]
        counted = landed(_counted_runs(train, length, None, range_bits, hot, hot_words), "lm-runs")
        totals = F.broadcast(spark.createDataFrame(pd.DataFrame({"context": hot, "total": n})))
        below, contexts = _level(counted, below, totals, landed)
        common = F.col("n") >= HEAD_SHARE * tree.n
        entries.append(below.filter(~common).select("gram", "p", "value"))
        sent = below.filter(common).select("gram", "p", "value").toPandas()
        head.append((sent["gram"].to_numpy(np.int64), sent["p"].to_numpy(np.float64), sent["value"].to_numpy(np.float64)))
        kept = contexts.filter("retained").select("context", F.log10("spare").alias("after")).toPandas()
        at, adds = _places_of(hot, kept["context"].to_numpy(np.int64)), np.zeros(len(hot))
        adds[at] = kept["after"].to_numpy(np.float64)
        keys.append(hot)
        after.append(adds)
        longer_ones = below.filter(F.col("n") >= _HOT_TOKENS).select("gram", "n").toPandas()
        hot, n = longer_ones["gram"].to_numpy(np.int64), longer_ones["n"].to_numpy(np.int64)
    if keys:
        tree.key, tree.after = np.concatenate(keys), np.concatenate(after)
        order = np.argsort(tree.key)
        tree.key, tree.after = tree.key[order], tree.after[order]
    head = [np.concatenate(x) for x in zip(*head)]
    order = np.argsort(head[0])
    return reduce(DataFrame.unionByName, entries), tuple(x[order] for x in head)


def _scored_by_subtrees(docs: DataFrame, train: DataFrame, tree: SuffixTree, counts: DataFrame, id_col: str, depth: int) -> DataFrame:
    """Learns from the rows of `docs` (row, train, id, text) that `train` is of, and scores all, each place with the subtree of its context."""
    spark, range_bits, done = docs.sparkSession, _range_bits(tree.n), []

    def landed(df: DataFrame, label: str) -> DataFrame:
        path, df = land_at(df, label)
        done.append(path)
        return df

    words = landed(_words(counts, tree), "lm-words")
    entries, head = _hot(tree, words, train, range_bits, depth, landed)
    shipped = ship(spark, (tree.light(), head, _filter(words, "gram", range_bits)))
    asked = land(_asked(docs, shipped, entries, range_bits, depth), "lm-adds")
    for path in done:
        discard(spark, path)

    id_type = docs.schema["id"].dataType.simpleString()
    of_rows = ["row", "id", "n_tokens", "n_known", "base_score", "score", "rare", "n_rare"]
    told = f"row long, id {id_type}, n_tokens long, n_known long, base_score double, score double, rare binary, n_rare long"
    columns = ["range", *of_rows, "flush", "places", "body"]

    def send(part: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, *_ = opened(shipped)
            met = _words_of(shipped)
            log_base, log_root = np.log10(model.base(model.count)), np.log10(model.root(model.count))
            kept, size, first, some = [], 0, None, None

            def dealt() -> pd.DataFrame:
                number, key, place, at, sub, whose = (np.concatenate(x) for x in zip(*kept))
                # In the order of their subtrees as far as the first bits of the key tell, and as they came: that packs best.
                low = np.uint64(max(len(sub), 1).bit_length())
                sub = np.sort(sub >> low << low | np.arange(len(sub), dtype=np.uint64))
                order = (sub & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
                at, whose, rows = at[order], whose[order], []
                for which, on in _by_range(sub, range_bits):
                    here = at[on]
                    numbers, there = [number[here]], np.ones(len(here), bool)
                    for back in range(1, depth + 1):
                        there = there & (place[here] >= back)
                        there[there] = number[here[there] - back] != _NONE
                        numbers.append(np.where(there, number[here - back], _NONE))
                    rows.append((which, first, some, len(here), _body(numbers, [key[here - back] for back in range(depth + 1)], whose[on])))
                return pd.DataFrame(rows, columns=["range", "flush", "id", "places", "body"]).reindex(columns=columns)

            for frame in batches:
                for rows, words, of, place in _cut(frame):
                    number, key = met(words)
                    row, n = rows["row"].to_numpy(np.int64), len(rows)
                    first, some = (int(row[0]), rows["id"].iloc[0]) if first is None else (first, some)
                    at, sub, _ = _dealt(model, number, key, place, _salt(first), depth)
                    sub = sub.view(np.uint64)
                    on = (sub >> np.uint64(64 - range_bits)) % np.uint64(_PARTS) == part
                    at, sub = at[on], sub[on]
                    whose = (row[of[at]] - first) * 2 + rows["train"].to_numpy(np.int64)[of[at]]
                    kept.append((number, key, place.astype(np.int32), at + size, sub, whose))
                    size += len(words)
                    if part == 0:
                        known_words = number >= 0
                        rare: list[list[bytes]] = [[] for _ in range(n)]
                        for i in np.flatnonzero(~known_words).tolist():
                            rare[of[i]].append(words[i])
                        of_known, of_number = of[known_words], number[known_words]
                        which = row & ((1 << range_bits) - 1)
                        yield pd.DataFrame({
                            "range": which - which % _PARTS, "row": row, "id": rows["id"].to_numpy(), "n_tokens": np.bincount(of, minlength=n),
                            "n_known": np.bincount(of_known, minlength=n), "base_score": np.bincount(of_known, log_base[of_number], n),
                            "score": np.bincount(of_known, log_root[of_number], n), "rare": [b" ".join(r) for r in rare],
                            "n_rare": np.bincount(of[~known_words], minlength=n)}).reindex(columns=columns)
                    if size >= _FLUSH_KEYS:
                        yield dealt()
                        kept, size, first = [], 0, None
            if kept:
                yield dealt()
        return sent

    def worth(asked: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        """Rows as they are; of what was sent of places, what they add to its rows."""
        model, head, _ = opened(shipped)
        whole = sent["places"].isna()
        out, sent = [sent.loc[whole, of_rows]], sent.loc[~whole, ["flush", "id", "places", "body"]]
        if len(sent):
            places = sent["places"].to_numpy(np.int64)
            number, key, whose = _opened_bodies(sent["body"].tolist(), places.tolist(), depth + 1, model)
            gram, p, value = (np.concatenate(x) for x in zip(head, *(
                (_unpacked(g).view(np.int64), np.frombuffer(p), np.frombuffer(v)) for g, p, v in asked[["gram", "p", "value"]].itertuples(index=False))))
            order = np.argsort(gram)
            add = _worth(model, number, key, whose & 1, gram[order], p[order], value[order])
            rows = []
            for flush, some, end, n in zip(sent["flush"], sent["id"], np.cumsum(places).tolist(), places.tolist()):
                sums = np.bincount(whose[end - n:end] >> 1, add[end - n:end])
                found = np.flatnonzero(sums)
                rows.append((some, flush, _narrow(found), sums[found].tobytes()))
            out.append(pd.DataFrame(rows, columns=["id", "flush", "whose", "adds"]))
        return pd.concat(out).reindex(columns=[*of_rows, "flush", "whose", "adds"])

    written = reduce(DataFrame.unionByName, [
        land(asked.filter(F.col("range") % _PARTS == i).groupBy("range").cogroup(
            docs.select("row", "id", "train", "text").mapInPandas(send(i), f"range int, {told}, flush long, places long, body binary")
            .groupBy("range")).applyInPandas(worth, f"{told}, flush long, whose binary, adds binary"), "lm-parts") for i in range(_PARTS)])
    return _summed(written, tree, counts, id_col)


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """(row, run_score) of the rows of one flush."""
    whose = np.concatenate([_widened(b) for b in frame["whose"]])
    sums = np.bincount(whose, np.concatenate([np.frombuffer(b, np.float64) for b in frame["adds"]]))
    found = np.unique(whose)
    return pd.DataFrame({"row": found + int(frame["flush"].iloc[0]), "run_score": sums[found]})


def _summed(written: DataFrame, tree: SuffixTree, counts: DataFrame, id_col: str) -> DataFrame:
    """The scores of documents from their rows, what was added to the rows of each flush, and the counts of their rare words."""
    parts = written.filter("n_tokens IS NOT NULL").drop("flush", "whose", "adds")
    met = written.filter("n_tokens IS NULL").select("flush", "whose", "adds").groupBy("flush").applyInPandas(_added, "row long, run_score double")
    n = F.coalesce(F.col("n"), F.lit(0))
    root = F.when(n > 0, n * ((1 - tree.unseen) / max(tree.n, 1))).otherwise(tree.unseen)
    base = (n + BASE_ADD) / (tree.n + BASE_ADD * (tree.distinct + 1))
    # An end without a number leaves an empty last piece, which has no count and scores as unseen.
    rare = (parts.filter("n_rare > 0").select("row", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("token"))
            .join(counts, "token", "left").groupBy("row")
            .agg(F.count_if(n > 0).alias("more_known"), F.sum(F.log10(base)).alias("more_base"), F.sum(F.log10(root)).alias("more_score")))
    whole = parts.drop("rare", "n_rare").join(rare, "row", "left").join(met, "row", "left")

    def plus(name: str, more: list[str], kind: str) -> Column:
        return reduce(Column.__add__, [F.coalesce(F.col(m), F.lit(0)) for m in more], F.col(name)).cast(kind).alias(name)

    return whole.select(F.col("id").alias(id_col), "n_tokens", plus("n_known", ["more_known"], "long"),
                        plus("base_score", ["more_base"], "double"), plus("score", ["more_score", "run_score"], "double"))


def _rows(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), train.alias("train"),
                       F.col(text_col).cast("binary").alias("text"))


def scored(docs: DataFrame, tree: SuffixTree, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) of every row of `docs`: log10 probabilities of the whole text.

    Common words and runs are scored in the tasks; a document's other words and runs are joined with their counts and values. A NULL text is an empty one,
    which is the end token alone. Repeated rows and ids repeat their results; an empty table gives no rows.
    """
    with _shuffles_dropped(docs.sparkSession):
        return _scored(_rows(docs, id_col, text_col, F.lit(False)), tree, counts, tree.left, tree.bits, id_col)


def learn_and_score(docs: DataFrame, held_out: Callable[[str], Column], id_col: str = "doc_id", text_col: str = "text",
                    depth: int = DEPTH) -> DataFrame:
    """`scored` with train_tokens added, learnt from the rows that `held_out` (id column name -> boolean) leaves."""
    rows = _rows(docs, id_col, text_col, ~held_out(id_col))
    train = rows.filter("train").select("text")
    with _shuffles_dropped(docs.sparkSession):
        tree, counts = _counted(train)
        return _scored_by_subtrees(rows, train, tree, counts, id_col, depth).withColumn("train_tokens", F.lit(tree.n).cast("long"))


@query("op5_suffix_tree")
def op5(spark, sf_dir):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = learn_and_score(docs, lambda name: is_held_out(name, 10, 0))
    return told.select("doc_id", is_held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
