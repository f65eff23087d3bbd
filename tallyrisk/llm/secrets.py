"""Secret scans by a trigram inverted index, in DataFrame expressions only.

Each rule's regular expression gives a Boolean query of trigrams. Postings (trigram, text digest) hold the trigrams that
some rule needs; a text is a candidate of a rule where one of the rule's alternatives is in its postings as a whole. Only
candidates are tried with the expression. Rules without a needed trigram are tried on every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm.common import free_name, query, quoted, table
from tallyrisk.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A match is a secret where its `group` has `least` or more characters."""

    kind: str
    pattern: str
    group: int
    least: int


def either_case(text: str) -> str:
    """The text as a pattern that takes ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in text)


# The rules in the order in which they are listed; the first three are the contract's base.
RULES = (
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE_KINDS = 3
_WORD_BITS = 60


def _queries() -> tuple[list[str], list[list[frozenset[str]]]]:
    queries = [trigram_query(r.pattern) for r in RULES]
    return sorted({g for q in queries for alternative in q for g in alternative}), queries


def postings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, digest) of the needed trigrams of every distinct text: gram is the trigram's place in the sorted list."""
    grams, _ = _queries()
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    folded = docs.select(F.lower(text).alias("low"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return folded.select(F.explode(held).alias("gram"), "digest").distinct()


def candidates(index: DataFrame) -> DataFrame:
    """(digest, rules): a bit for each rule one of whose alternatives is in the text's postings as a whole."""
    grams, queries = _queries()
    words = range(len(grams) // _WORD_BITS + 1)
    bits = index.groupBy("digest").agg(*[F.bit_or(F.when(F.floor(F.col("gram") / _WORD_BITS) == w, F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("gram") - w * _WORD_BITS)).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words])

    def holds(alternative: frozenset[str]) -> Column:
        masks = [sum(1 << (i - w * _WORD_BITS) for i, g in enumerate(grams) if g in alternative and i // _WORD_BITS == w) for w in words]
        return reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in enumerate(masks) if m])

    rules = sum((F.when(reduce(lambda a, b: a | b, map(holds, q)), F.lit(1 << r)).otherwise(0) for r, q in enumerate(queries) if q), F.lit(0))
    return bits.select("digest", rules.alias("rules")).filter("rules > 0")


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, kind, end) of a rule's secrets: leftmost matches that do not overlap, then those long enough.

    Starts follow from the lengths of what lies between matches, in code points.
    """
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
                         F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(state: Column, one: Column) -> Column:
        start = state["at"] + F.length(one["gap"])
        end = start + F.coalesce(F.length(one["whole"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        good = F.coalesce(F.length(one["value"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def _short_test(rule: Rule) -> str:
    """A pattern that every secret of a rule without trigrams holds, cheaper to refuse with than to list matches."""
    return f"{rule.pattern[:-1]}{{{rule.least}}}" if rule.group == 0 and rule.pattern.endswith("+") else rule.pattern


def _told(spans: Column) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with secret_spans added (see `spans_name`): (start, kind, end) of every secret, kind being the place in RULES.

    Other columns stay as they are, whatever their names. A NULL text is empty and holds none. Repeated rows are scanned as they come; an empty table gives an empty one.
    """
    _, queries = _queries()
    text, digest, rules = (free_name(docs.columns, n) for n in ("secret_text", "secret_digest", "secret_rules"))
    # Written first, so that both sides of the join are plain tables and Spark can split the copies of one text.
    found = land(candidates(land(postings(docs, text_col), "secret-postings")), "secret-candidates")
    held = docs.withColumn(text, F.coalesce(F.col(quoted(text_col)), F.lit("")))
    held = held.withColumn(digest, F.unhex(F.md5(F.col(text).cast("binary"))))
    tried = held.join(found.withColumnsRenamed({"digest": digest, "rules": rules}), digest, "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = []
    for order, rule in enumerate(RULES):
        wanted = F.col(rules).bitwiseAND(1 << order) > 0 if queries[order] else F.col(text).rlike(_short_test(rule))
        spans.append(F.when(wanted, _spans(F.col(text), rule, order)).otherwise(none))
    return tried.withColumn(spans_name(docs), F.concat(*spans)).drop(text, digest, rules)


def spans_name(docs: DataFrame) -> str:
    """What `scanned` calls its column: secret_spans, with underscores behind it where `docs` has one of that name."""
    return free_name(docs.columns, "secret_spans")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """The rows of `docs` with every secret replaced by `mark`; overlapping secrets are one. Rows without one stay as they are.

    `length_col`, where there is one, follows the new text. A NULL text stays NULL.
    """
    spans, found = spans_name(docs), scanned(docs, text_col)
    text = found[quoted(text_col)]  # a bare name would mean the new text in the columns after it

    def step(state: Column, span: Column) -> Column:
        further = span["end"] > state["at"]
        gap = F.when(span["start"] >= state["at"], F.concat(text.substr(state["at"] + 1, span["start"] - state["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.when(further, span["end"]).otherwise(state["at"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    cut = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                      lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    changed = F.size(spans) > 0
    new = {text_col: F.when(changed, cut).otherwise(text)}
    if length_col in docs.columns:
        new[length_col] = F.when(changed, F.length(cut).cast(docs.schema[length_col].dataType)).otherwise(found[quoted(length_col)])
    return found.select(*[new[c].alias(c) if c in new else found[quoted(c)] for c in docs.columns])


def _oracle() -> str:
    """The same spans by listing all matches of every rule in every text."""
    parts = []
    for order, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT row, {order} AS kind, '{r.kind}' AS name,
  list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'v': length(v[i])}}), lambda x: x.v >= {r.least}) AS l
FROM (SELECT row, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS v, regexp_split_to_array(t, '{p}') AS g FROM d)""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
s AS (SELECT row, kind, name, unnest(l) AS x FROM f),
a AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT, ',' ORDER BY x.s, kind) FILTER (kind < {BASE_KINDS}) AS base,
         string_agg(name || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT, ',' ORDER BY x.s, kind) AS spans
  FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row)"""


@query("op9_trigram_index", sql=_oracle())
def op9(spark, sf_dir):
    """doc_id, counts of the base kinds, digest of the base spans and all spans of every document."""
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: int) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("secret_spans", lambda s: s["kind"] < BASE_KINDS)
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                        F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("secret_spans")).alias("spans"))
