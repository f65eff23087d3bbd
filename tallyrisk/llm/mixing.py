"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only.

Each source gets a share of TOTAL_PERCENT of all words by its weight, at most MOST_COPIES times its own words, what is
over being shared out again. Within a source a document is expected `target / words` times (times its own weight, if one
is given): the whole part of that are certain copies, and the fraction is its inclusion chance p in a sample. The
sample takes documents in ascending order of their random odds over their inclusion odds, (u/(1-u)) / (p/(1-p)), up to
the words that are left, to the nearest document.

The place where a source's sample ends is found without ordering the source: sums by BUCKETS cells of the order, then
by BUCKETS cells of the one cell that holds the end, and only what lies in that last cell is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm.common import free_name, query, quoted, table

# Fixed values of the contract: weights by source in code point order, repeating; share of all words; copies at most.
WEIGHTS, TOTAL_PERCENT, MOST_COPIES = (5, 2, 1), 150, 2
SEED, BUCKETS = "mix-1", 4096
# Per-source rows up to this number are broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 100_000

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def unit(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from a digest of seed, id and text: reruns agree, and only equal rows are tied."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("none")),
                               F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above its cap.

    One row per source is ordered in one task. With sources in ascending order of cap over weight, the level is the largest
    of (total - caps before) / (weights from here on): capping more or fewer sources would lower it.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    ranked = (sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
              .withColumn("cap", F.col("source_size") * MOST_COPIES))
    level = ((F.sum("source_size").over(everything) * F.lit(TOTAL_PERCENT / 100.0)
              - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    return (ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
            .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")))


def _with_order(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds certain copies, inclusion chance and `v`, the order key scaled to (0, 1)."""
    matched = rows.join(plan, F.expr("source <=> plan_source")).drop("plan_source")
    expected = F.when(F.col("source_weighted") > 0, F.least(F.lit(float(MOST_COPIES)), F.col("target") * F.col("weight") / F.col("source_weighted"))).otherwise(0.0)
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    return (matched.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
            .withColumn("p", F.col("expected") - F.col("whole"))
            .withColumn("v", F.when(F.col("p") > 0, odds / (1 + odds))))


def _end_cells(cells: DataFrame) -> DataFrame:
    """Of (source, cell, words, left): the one cell of a source in which its sample ends, and what is left there."""
    running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(running), F.lit(0))
    return (cells.withColumn("before", before).filter("before < left and before + words > left")
            .select(F.col("source").alias("end_source"), F.col("cell").alias("end_cell"), (F.col("left") - F.col("before")).alias("end_left")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """The rows of `docs` with mix_size, mix_source_size, mix_target and mix_copies (0 to MOST_COPIES) added (see `added_names`).

    A NULL source is one source, the last. A NULL or empty text has size 0; it may be copied, which takes no words. Rows equal
    in id and text are tied and taken together or not at all; rows without words of their source give it target 0. A NULL or
    negative weight counts as 0. Other columns, whatever their names, stay as they are.
    """
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(quoted(weight_col)).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = land(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"),
                            word_count(F.col(quoted(text_col))).alias("size"), weight.alias("weight"),
                            unit(F.col(quoted(id_col)), F.col(quoted(text_col))).alias("u")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("source_weighted"))
    plan = targets(sizes.select("source", "source_size"))
    plan = land(plan.join(sizes.withColumnsRenamed({"source": "plan_source"}).select("plan_source", "source_weighted"), F.expr("source <=> plan_source"))
                .select(F.col("source").alias("plan_source"), "source_size", "target", "source_weighted"), "mix-targets")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    ordered = _with_order(rows, plan)
    left = ordered.groupBy("source").agg(F.greatest(F.first("target") - F.sum(F.col("whole") * F.col("size")), F.lit(0.0)).alias("left"))
    left = land(left.select(F.col("source").alias("left_source"), "left"), "mix-left")
    cell = F.floor(F.col("v") * BUCKETS)
    within = F.floor((F.col("v") * BUCKETS - cell) * BUCKETS)
    chosen = ordered.filter("p > 0 and size > 0")

    by_cell = chosen.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
    ends = _end_cells(by_cell.join(left, F.expr("source <=> left_source")))
    inside = chosen.join(ends, F.expr(f"source <=> end_source and floor(v * {BUCKETS}) = end_cell"))
    by_part = inside.groupBy("source", within.alias("cell"), F.col("end_left").alias("left"), F.col("end_cell").alias("outer")).agg(F.sum("size").alias("words"))
    parts = _end_cells(by_part.select("source", F.struct("outer", "cell").alias("cell"), "words", "left"))
    last = (chosen.join(parts, F.expr("source <=> end_source")).filter((cell == F.col("end_cell.outer")) & (within == F.col("end_cell.cell")))
            .groupBy("source", "v", "id", "size", "end_left").agg(F.sum("size").alias("words")))
    in_order = Window.partitionBy("source").orderBy("v", "id", "size")
    until = F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    cut = (last.withColumn("until", until).filter(F.col("until") - F.col("words") / 2 < F.col("end_left"))
           .groupBy("source").agg(F.max(F.struct("v", "id", "size")).alias("cut")).select(F.col("source").alias("cut_source"), "cut"))
    # Cells before the end, and parts of the last cell before the end, are taken whole.
    edge = (by_cell.join(left, F.expr("source <=> left_source"))
            .withColumn("until", F.sum("words").over(Window.partitionBy("source").orderBy("cell")))
            .groupBy("source").agg(F.coalesce(F.max(F.when(F.expr("until <= left"), F.col("cell") + 1)), F.lit(0)).alias("cells")))
    part_edge = (by_part.withColumn("until", F.sum("words").over(Window.partitionBy("source").orderBy("cell")))
                 .groupBy("source").agg(F.max("outer").alias("outer"), F.max(F.when(F.expr("until <= left"), F.col("cell") + 1)).alias("parts")))
    ending = land(plan.select("plan_source", "source_size", "target", "source_weighted")
                  .join(edge.select(F.col("source").alias("edge_source"), "cells"), F.expr("plan_source <=> edge_source"), "left")
                  .join(part_edge.select(F.col("source").alias("part_source"), "outer", "parts"), F.expr("plan_source <=> part_source"), "left")
                  .join(cut, F.expr("plan_source <=> cut_source"), "left")
                  .select("plan_source", "source_size", "target", "source_weighted", F.coalesce("outer", "cells", F.lit(0)).alias("cells"),
                          F.coalesce("parts", F.lit(0)).alias("parts"), "cut"), "mix-ends")
    ending = F.broadcast(ending) if ending.count() <= BROADCAST_SOURCES else ending
    return _decided(docs, ending, id_col, text_col, source_col, weight)


def added_names(docs: DataFrame) -> list[str]:
    """What `mixed` calls its columns of size, source size, target and copies; underscores follow where `docs` has such a name."""
    return [free_name(docs.columns, n) for n in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]


def _decided(docs: DataFrame, ending: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column) -> DataFrame:
    text = F.col(quoted(text_col))
    facts = F.struct(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), word_count(text).alias("size"),
                     weight.alias("weight"), unit(F.col(quoted(id_col)), text).alias("u"))
    held = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), facts.alias("facts")).select("row", "facts.*")
    cell = F.floor(F.col("v") * BUCKETS)
    within = F.floor((F.col("v") * BUCKETS - cell) * BUCKETS)
    taken = F.coalesce((cell < F.col("cells")) | ((cell == F.col("cells")) & (within < F.col("parts")))
                       | (F.struct("v", "id", "size") <= F.col("cut")), F.lit(False)) & (F.col("p") > 0)
    size, source_size, target, copies = added_names(docs)
    return _with_order(held, ending).select(
        "row.*", F.col("size").alias(size), F.col("source_size").alias(source_size), F.col("target").alias(target),
        (F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")).alias(copies))


@query("op2_pareto_mix", sql=r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'none') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5)
         / 4503599627370496.0 AS u FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, [5, 2, 1][(place % 3 + 1)::INT] AS weight FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, (max(level) OVER ()) * weight::DOUBLE) AS target FROM l),
e AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size::DOUBLE) ELSE 0 END AS expected
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM e),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS odds FROM p),
r AS (
  SELECT *, greatest(target - sum(whole * size) OVER (PARTITION BY source), 0) AS rest,
         sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size) AS until FROM o)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN p > 0 AND until - size / 2.0 < rest THEN 1 ELSE 0 END) AS taken FROM r
""")
def op2(spark, sf_dir):
    """doc_id, size, source_size, target, taken of every document."""
    return mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
