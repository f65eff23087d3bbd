"""Near-duplicate documents by SetSketch registers (Ertl 2021): band, estimate by likelihood, confirm on full sets.

A register holds the rank of the smallest of exponential hash values on the scale BASE^-k, cut to 16 bits. Registers of
a union are the larger of two, and registers of two sets are equal about as often as their sets agree, so that runs of
equal registers (bands) find likely pairs.

Texts of the same words are one class from the start. In each bucket every class is compared with two of the
bucket's classes (that of the smallest id and the smallest in an order of the bucket's own), and then with its most linked
class, which joins groups of any size by a linear number of links. Buckets that then still hold several components are
searched whole, but only across components: small ones from one row, large ones in tiles of bounded size. No partner is left out and no group is
expanded to its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm.common import query, table
from tallyrisk.llm.graph import components

SHINGLE_WORDS, THRESHOLD_PERCENT = 5, 80
# Scale of the registers, rate of the exponential values, largest register, registers and registers in a band:
# of pairs at the threshold 3 in a million share none of the 42 bands.
BASE, RATE, LARGEST, REGISTERS, BAND = 1.001, 20.0, (1 << 16) - 1, 252, 6
# A pair is confirmed on full sets if its estimate is at most so many deviations under the threshold.
DEVIATIONS = 5.0
# Buckets up to this size are searched whole, about so many rows at a time; larger ones in tiles of so many classes a side.
ONE_ROW, PACKED_ROWS, TILE = 256, 2000, 256

_BLOCK, _MEMO = 1024, 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(20210614).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(20210615).integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def split_words(text: bytes | None) -> list[bytes]:
    """Words between the blanks 0x20 and 0x09 to 0x0D, A-Z lower-cased."""
    return (text or b"").lower().split()


def shingle_set(words: list[bytes], width: int) -> set:
    """Distinct runs of `width` words; a shorter text is one run, and no words give no run."""
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(width))))


class Sketcher:
    """Shingle hashes and registers; word hashes are remembered for the latest words."""

    def __init__(self, width: int):
        self.width, self._memo = width, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Distinct 64-bit hashes of the text's shingles."""
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
        memo = self._memo
        if len(memo) > _MEMO:
            memo.clear()
        for word in set(words).difference(memo):
            memo[word] = xxhash.xxh3_64_intdigest(word)
        code = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        last = len(words) - self.width + 1
        rolled = code[:last].copy()
        for i in range(1, self.width):
            rolled = rolled * _MIX + code[i:i + last]
        rolled ^= rolled >> np.uint64(32)
        rolled *= np.uint64(0xD6E8FEB86659FD93)
        rolled ^= rolled >> np.uint64(32)
        return np.unique(rolled)

    @staticmethod
    def registers(hashes: np.ndarray) -> np.ndarray:
        """The REGISTERS registers of a set of hashes; all 0 for the empty set."""
        low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), _BLOCK):
            block = hashes[at:at + _BLOCK, None] * _FACTORS
            block += _SHIFTS
            np.minimum(low, block.min(0), out=low)
        if not len(hashes):
            return np.zeros(REGISTERS, np.uint16)
        uniform = (low.astype(np.float64) + 1.0) / 2.0 ** 64
        value = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
        return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(one, other)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Most likely similarity of row pairs, from how many registers are larger left, larger right and equal.

    left, right: (pairs, registers); n_left, n_right: the known set sizes.
    """
    above, below = (left > right).sum(1), (left < right).sum(1)
    equal = left.shape[1] - above - below
    u = n_left / np.maximum(n_left + n_right, 1)
    v = 1 - u

    def share(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        only_left, only_right = share(np.maximum(u - v * j, 1e-12)), share(np.maximum(v - u * j, 1e-12))
        return above * np.log(only_left) + below * np.log(only_right) + equal * np.log(np.maximum(1 - only_left - only_right, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(28):  # the likelihood is concave in j
        one, two = high - golden * (high - low), low + golden * (high - low)
        rising = likelihood(one) < likelihood(two)
        low, high = np.where(rising, one, low), np.where(rising, high, two)
    return (low + high) / 2


def least_estimate(percent: int = THRESHOLD_PERCENT) -> float:
    t = percent / 100
    return t - DEVIATIONS * np.sqrt(t * (1 - t) / REGISTERS)


def row_digest(id_: Column, text: Column) -> Column:
    """Digest of a row's id and text, by which a document is found again."""
    told = F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("none")), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(told.cast("binary")))


def _sketched(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, digest of id and text, class key (NULL without words), set size, registers."""
    id_type = docs.schema[id_col].dataType.simpleString()
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher(width)
        for frame in batches:
            keys, sizes, registers = [], [], []
            for text in frame["text"]:
                words = split_words(text)
                hashes = sketcher.hashes(words)
                keys.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                sizes.append(len(hashes))
                registers.append(sketcher.registers(hashes).tobytes() if words else None)
            yield pd.DataFrame({"id": frame["id"], "row_key": frame["row_key"], "key": keys, "n": sizes, "registers": registers})

    texts = docs.select(F.col(id_col).alias("id"), row_digest(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInPandas(sketch, f"id {id_type}, row_key binary, key binary, n long, registers binary")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least `least`."""

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                left, right = (np.frombuffer(b"".join(frame[c]), np.uint16).reshape(len(frame), -1) for c in ("r_a", "r_b"))
                likely = estimate(left, right, frame["n_a"].to_numpy(float), frame["n_b"].to_numpy(float)) >= least
                yield frame.loc[likely, ["a", "b"]]

    # Sizes alone rule out many pairs before any register moves.
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * THRESHOLD_PERCENT)
    return joined.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInPandas(check, "a long, b long")


def _bodies(asked: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, words) of the classes in `asked` (cid): their texts are read again, from rows of each class's smallest id."""
    wanted = land(asked.join(classes.select("cid", "key", "first"), "cid"), "neardup-wanted")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.join(wanted.select("first").distinct(), F.expr("id <=> first"), "left_semi")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            joined = [b" ".join(split_words(t)) for t in frame["text"]]
            yield pd.DataFrame({"key": [hashlib.md5(t).digest() for t in joined], "words": joined})

    return land(rows.mapInPandas(keyed, "key binary, words binary").join(wanted.select("cid", "key"), "key")
                .groupBy("cid").agg(F.max("words").alias("words")), "neardup-texts")


def _confirmed(pairs: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that agree on full sets, as (u, v)."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, set()
        for frame in batches:
            good = np.zeros(len(frame), bool)
            for i, (left, right) in enumerate(zip(frame["left"], frame["right"])):
                if left != last:
                    last, known = left, shingle_set(left.split(), width)
                other = shingle_set(right.split(), width)
                both = len(known & other)
                good[i] = 100 * both >= percent * (len(known) + len(other) - both)
            yield frame.loc[good, ["u", "v"]]

    return (pairs.join(bodies.select(F.col("cid").alias("a"), F.col("words").alias("left")), "a")
            .join(bodies.select(F.col("cid").alias("b"), F.col("words").alias("right")), "b")
            .select(F.col("a").alias("u"), F.col("b").alias("v"), "left", "right").mapInPandas(check, "u long, v long"))


def _with_hubs(dense: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's most linked class and those of its classes that are in other components."""
    degree = land(links.select(F.explode(F.array("u", "v")).alias("cid")).groupBy("cid").agg(F.count("*").alias("degree")), "neardup-degrees")
    members = (dense.select("bucket", "cid").join(roots, "cid", "left").join(degree, "cid", "left")
               .withColumn("root", F.coalesce("root", "cid")).withColumn("degree", F.coalesce("degree", F.lit(0))))
    hubs = (members.groupBy("bucket").agg(F.max(F.struct("degree", "cid", "root")).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high"))
            .filter("low < high").select("bucket", F.col("hub.cid").alias("hub"), F.col("hub.root").alias("hub_root")))
    hubs = land(hubs, "neardup-hubs")
    return (members.join(hubs, "bucket").filter("root <> hub_root")
            .select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct())


def _likely_pairs(frame: pd.DataFrame, at: np.ndarray, registers: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of likely pairs of different components among the rows `at` of one bucket.

    A pair counts in the first band that both share only. In tiles of the largest component and the rest (kind 1) only pairs
    across the two are new.
    """
    one, two = np.triu_indices(len(at), 1)
    root, n, top = (frame[c].to_numpy()[at] for c in ("root", "n", "is_top"))
    size_small, size_large = np.minimum(n[one], n[two]), np.maximum(n[one], n[two])
    open_ = (root[one] != root[two]) & (size_small * 100 >= size_large * THRESHOLD_PERCENT)
    if frame["kind"].iat[at[0]] == 1:
        open_ &= top[one] != top[two]
    one, two, band = at[one[open_]], at[two[open_]], frame["band"].iat[at[0]]
    sizes, kept = frame["n"].to_numpy(float), []
    for i in range(0, len(one), 4096):
        left, right = registers[one[i:i + 4096]], registers[two[i:i + 4096]]
        first = (left == right).reshape(len(left), -1, BAND).all(2).argmax(1) == band
        good = np.zeros(len(left), bool)
        good[first] = estimate(left[first], right[first], sizes[one[i:i + 4096]][first], sizes[two[i:i + 4096]][first]) >= least
        kept.append(good)
    likely = np.concatenate(kept) if kept else np.zeros(0, bool)
    return one[likely], two[likely]


def _segments(frame: pd.DataFrame) -> list[np.ndarray]:
    """Row positions of each bucket in a group of rows."""
    bucket = frame["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)


def _registers(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["registers"]), np.uint16).reshape(len(frame), -1)


def _across(dense: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Links (u, v) between different components that share a bucket, compared inside tasks.

    Small buckets are packed many to a group; larger ones are cut into tiles of at most TILE classes a side. A first pass
    over the registers finds the classes that have a likely partner; only their texts are then brought to the tiles, and
    only confirmed links leave a task.
    """
    labelled = dense.select("bucket", "band", "cid").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    by_root = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = (by_root.groupBy("bucket").agg(F.sum("n").alias("rows"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top"))
             .filter("roots > 1").select("bucket", "rows", F.col("top.root").alias("top"), F.col("top.n").alias("n_top")))
    members = land(labelled.join(mixed, "bucket").withColumn("is_top", F.col("root") == F.col("top")), "neardup-mixed")
    packs = max(1, members.count() // PACKED_ROWS)
    small = (members.filter(F.col("rows") <= ONE_ROW).withColumn("kind", F.lit(0))
             .withColumn("tile", F.pmod(F.xxhash64("bucket", F.lit(9)), F.lit(packs))))
    large = (members.filter(F.col("rows") > ONE_ROW)
             .withColumn("rest_tiles", F.ceil((F.col("rows") - F.col("n_top")) / F.lit(TILE)).cast("int"))
             .withColumn("top_tiles", F.ceil(F.col("n_top") / F.lit(TILE)).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("cid"), F.when(F.col("is_top"), F.col("top_tiles")).otherwise(F.col("rest_tiles"))).cast("int")))

    def tiled(rows: DataFrame, count: str, kind: int, low: Column, high: Column) -> DataFrame:
        placed = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(count) - 1))).withColumn("kind", F.lit(kind))
        return placed.withColumn("tile", F.xxhash64("bucket", "kind", low, high))

    rest, top, own, other = large.filter("not is_top"), large.filter("is_top"), F.col("own"), F.col("other")
    named = ["tile", "kind", "bucket", "band", "cid", "root", "is_top"]
    tiles = small.select(named)
    for part in (tiled(rest, "rest_tiles", 0, F.least(own, other), F.greatest(own, other)), tiled(rest, "top_tiles", 1, own, other),
                 tiled(top, "rest_tiles", 1, other, own)):
        tiles = tiles.unionByName(part.select(named))
    with_sketch = tiles.join(classes.select("cid", "n", "registers"), "cid")
    least = least_estimate()

    def flag(frame: pd.DataFrame) -> pd.DataFrame:
        registers, hit = _registers(frame), np.zeros(len(frame), bool)
        for at in _segments(frame):
            for side in _likely_pairs(frame, at, registers, least):
                hit[side] = True
        return frame.loc[hit, named]

    types = "tile long, kind int, bucket long, band int, cid long, root long, is_top boolean"
    flagged = land(with_sketch.groupBy("tile", "kind").applyInPandas(flag, types), "neardup-flagged")
    bodies = _bodies(flagged.select("cid").distinct(), classes, docs, id_col, text_col)

    def confirm(frame: pd.DataFrame) -> pd.DataFrame:
        registers, sets, links = _registers(frame), {}, []
        cid, words = frame["cid"].to_numpy(), frame["words"].to_list()

        def of(i: int) -> set:
            if cid[i] not in sets:
                sets[cid[i]] = shingle_set(words[i].split(), width)
            return sets[cid[i]]

        for at in _segments(frame):
            for i, j in zip(*_likely_pairs(frame, at, registers, least)):
                both = len(of(i) & of(j))
                if 100 * both >= THRESHOLD_PERCENT * (len(of(i)) + len(of(j)) - both):
                    links.append((cid[i], cid[j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return (flagged.join(classes.select("cid", "n", "registers"), "cid").join(bodies, "cid").groupBy("tile", "kind")
            .applyInPandas(confirm, "u long, v long").distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id, kept, and row_key and stays for filters.

    Rows are linked where their word shingles agree to THRESHOLD_PERCENT. component_id is the smallest id reachable (NULL
    where the group has none), kept says whether it is the row's own. `row_key` is a digest of id and text, and `stays`
    is true for one row_key of each group (the smallest id's; a group without ids keeps its smallest digest). A text
    without words, or NULL, is linked with nothing. Repeated rows are copies of each other. An empty table gives no rows.
    """
    rows = land(_sketched(docs, width, id_col, text_col), "neardup-rows")
    classes = land(rows.filter("key is not null").groupBy("key")
                   .agg(F.min("id").alias("first"), F.max("n").alias("n"), F.max("registers").alias("registers"))
                   .orderBy("first").withColumn("cid", F.monotonically_increasing_id()), "neardup-classes")
    at = F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))
    bands = classes.select("cid", F.posexplode(F.transform(at, lambda i: F.xxhash64(
        i, F.substring(F.col("registers"), i * (2 * BAND) + 1, F.lit(2 * BAND))))).alias("band", "bucket"))
    turned = F.xxhash64(F.lit(3), F.col("bucket")).bitwiseAND(F.lit((1 << 62) - 1))
    full = (bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cid").alias("one"),
                                        F.min(F.col("cid").bitwiseXOR(turned)).alias("two"))
            .filter("n > 1").select("bucket", "one", F.col("two").bitwiseXOR(turned).alias("two")))
    dense = land(bands.join(full, "bucket"), "neardup-buckets")
    stars = (dense.select("cid", F.explode(F.array("one", "two")).alias("centre")).filter("cid <> centre")
             .select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b")).distinct())
    least, spark = least_estimate(), docs.sparkSession
    links = tried = spark.createDataFrame([], "u long, v long")
    roots = spark.createDataFrame([], "cid long, root long")
    for search in ("stars", "hubs", "across"):
        if search == "across":
            found = land(_across(dense, roots, classes, docs, width, id_col, text_col), "neardup-links")
        else:
            pairs = stars if search == "stars" else _with_hubs(dense, roots, links)
            untried = pairs.join(tried.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
            likely = land(_estimated(untried, classes, least), "neardup-likely")
            tried = tried.unionByName(likely.select(F.col("a").alias("u"), F.col("b").alias("v")))
            bodies = _bodies(likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), classes, docs, id_col, text_col)
            found = land(_confirmed(likely, bodies, width, THRESHOLD_PERCENT), "neardup-links")
        if found.isEmpty():
            continue
        links = links.unionByName(found)
        roots = components(links, "neardup-components").select(F.col("node").alias("cid"), "root")

    grouped = land(classes.select("cid", "key", "first").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "neardup-groups")
    # What joins a group's many rows is written first: with a plain table on both sides Spark can split a group.
    smallest = land(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "neardup-smallest")
    of_key = land(grouped.join(smallest, "root").select("key", "root", "component_id"), "neardup-keys")
    told = land(rows.select("id", "row_key", "key", "n").join(of_key, "key", "left").withColumn(
        "component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))), "neardup-told")
    winners = land(told.filter("key is not null and id <=> component_id").groupBy("root")
                   .agg(F.min("row_key").alias("winner")), "neardup-winners")
    return told.join(winners, "root", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.expr("id <=> component_id").alias("kept"),
        "row_key", F.expr("key is null or row_key <=> winner").alias("stays"))


@query("op3_setsketch", sql=r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
matches AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM matches JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN edges e ON e.a = r.other)
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id)
""")
def op3(spark, sf_dir):
    """doc_id, n_shingles, component_id, kept of every document, on distinct runs of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")
