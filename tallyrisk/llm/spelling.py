"""Spelling variants by permuterm rotations, in DataFrame expressions.

A word is marked with a terminator. Taking its character at place i out and turning the rest so that it begins behind that place
gives `after + terminator + before`: the prefix that all rotations share whose words differ from it at place i alone, and at the
same time a whole rotation of the word without that character. So rows sorted by this text lie in groups of words one replacement
apart (at most one for each letter of the alphabet) and at most one word that is one deletion away from all of them. A scan of
the groups gives every word its number of near words and the best of them; the pairs themselves are never written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm.common import query, table

# The contract's runs, their shortest length, fewest occurrences, how much commoner a form is, and which runs lose a character.
RUN, LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGED = "[A-Za-z\\u00C0-\\u00FF]+", 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\0"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all texts, in lower case, some of them without one character as the contract has it.

    A NULL id counts as an empty one, a NULL text holds no run. Repeated rows count as they come.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(RUN.replace("+", f"{{{least_length},}}")), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (crc % F.length("run")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = each.select(F.when(crc % DAMAGED == 0, left).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(turned, skipped, n): every rotation of every word, whole (skipped NULL) and with the character before its start skipped."""
    word, size = F.col("word"), F.length("word")

    def turned(i: Column, skip: int) -> Column:
        return F.concat(word.substr(i + 1 + skip, size), F.lit(END), F.substring(word, F.lit(1), i))

    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(i, 0).alias("turned"), F.lit(None).cast("string").alias("skipped")))
    skipping = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        turned(i, 1).alias("turned"), word.substr(i + 1, F.lit(1)).alias("skipped")))
    return words.select("n", F.explode(F.concat(whole, skipping)).alias("r")).select("r.turned", "r.skipped", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, best): for every group in which a word has near ones, their number and the best as (-n, word).

    A deletion is counted once where equal characters stand side by side: where its character differs from the one before.
    """
    group = Window.partitionBy("turned")
    met = rotations(words).withColumn("held", F.count(F.lit(1)).over(group)).filter("held > 1")
    after, before = (F.substring_index("turned", END, side) for side in (1, -1))
    member = F.struct((-F.col("n")).alias("rank"), F.concat(before, F.coalesce("skipped", F.lit("")), after).alias("word"),
                      F.col("skipped").isNull().alias("whole"), (F.coalesce("skipped", F.lit("")) != F.right(before, F.lit(1))).alias("first"))
    groups = met.groupBy("turned").agg(F.array_sort(F.collect_list(member)).alias("members"))

    def others(x: Column) -> Column:
        return F.filter("members", lambda y: (x["word"] != y["word"]) & (~x["whole"] | y["first"]) & (~y["whole"] | x["first"]))

    seen = F.transform("members", lambda x: F.struct(x["word"].alias("word"), others(x).alias("others")))
    rows = groups.select(F.explode(seen).alias("s")).filter(F.size("s.others") > 0)
    return rows.select("s.word", F.size("s.others").cast("long").alias("near"),
                       F.struct(F.col("s.others")[0]["rank"].alias("rank"), F.col("s.others")[0]["word"].alias("word")).alias("best"))


def variants(words: DataFrame, word_col: str = "word", count_col: str = "n", times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every distinct word; other columns are not read.

    Near words differ by one inserted, deleted or replaced code point. `form` is the near word of largest count (of equal ones
    the first in code-point order) if that is at least `times` the word's own, `root` the end of the chain of forms. NULL words
    and words that hold U+0000 take no part, counts of repeated words are added, no words give no rows.
    """
    given = words.select(F.col(word_col).alias("word"), F.col(count_col).cast("long").alias("n"))
    given = land(given.filter(~F.contains("word", F.lit(END))).groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    none = F.lit(None).cast("struct<rank:bigint,word:string>")
    rows = given.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("best")).unionByName(
        neighbours(given).withColumn("n", F.lit(None).cast("long")))
    told = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    good = -F.col("best.rank") >= times * F.col("n")
    told = land(told.select("word", "n", "n_near", F.when(good, F.col("best.word")).alias("form"),
                            F.when(good, -F.col("best.rank")).alias("form_n")), "spelling-forms")
    return told.join(roots(told, times), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(told: DataFrame, times: int) -> DataFrame:
    """(word, root) of the words that have a form, by doubling: counts grow `times`-fold along a chain, which bounds its length."""
    chains = told.filter("form is not null").select("word", F.col("form").alias("root"))
    high, low = told.agg(F.max("form_n"), F.min(F.when(F.col("form").isNotNull(), F.col("n")))).first()
    longest = math.log(high / max(low, 1), max(times, 2)) + 1 if high else 0
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chains = land(chains.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return chains


_ORACLE = f"""
WITH k AS MATERIALIZED (SELECT list_transform(range(256), lambda x: list_reduce(range(8),
    lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x::BIGINT)) AS tab),
r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS raw FROM documents),
l AS (SELECT id, translate(raw, '{UPPER}', '{LOWER}') AS run, count(*) AS c FROM r WHERE length(raw) >= {LEAST_LENGTH} GROUP BY ALL),
h AS (SELECT *, hex(encode(id || run)) AS x FROM l),
b AS (SELECT *, list_transform(range(1, 1 + length(x) // 2), lambda i: (strpos('0123456789ABCDEF', substr(x, 2*i-1, 1)) - 1) * 16
    + strpos('0123456789ABCDEF', substr(x, 2*i, 1)) - 1) AS bytes FROM h),
z AS (SELECT run, c, xor(list_reduce(bytes, lambda a, y: xor(tab[1 + (xor(a, y) & 255)], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b, k),
d AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM z),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM d WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
s AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM s a JOIN s b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM s JOIN w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM s JOIN w ON s.rest = w.word),
g AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
t AS (SELECT g.word, g.n_near, g.m, min(encode(other)) AS best FROM g JOIN p ON p.word = g.word AND p.m = g.m GROUP BY ALL),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN decode(best) END AS form,
    CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM w LEFT JOIN t USING (word)),
c AS (WITH RECURSIVE c(word, root, step) AS (SELECT word, coalesce(form, word), 0 FROM f
    UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL) SELECT word, arg_max(root, step) AS root FROM c GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c USING (word)"""


@query("op12_permuterm", sql=_ORACLE)
def op12(spark, sf_dir):
    """word, form, root, n, n_near and form_n of every word of the documents."""
    return variants(word_counts(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
