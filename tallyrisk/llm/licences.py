"""Licence scans: one Aho-Corasick automaton for notice phrases and identifier tags, and a shunting-yard reading of licence
expressions with AND, OR, WITH, + and brackets.

Base labels come from the contract's phrases alone. The method adds the licences of further phrases and of the expression
behind each `SPDX-License-Identifier` tag. An expression is worth its freedom: OR takes the freer side, AND the stricter,
WITH relaxes its left side a little. A document scores as its strictest notice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrisk.llm.common import query, table

# The contract's phrases, whose words have to stand consecutively.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further phrases, the label of each.
PHRASES = {
    "licensed under the mit": "mit", "permission is hereby granted free of charge": "mit",
    "licensed under the apache": "apache", "apache software license": "apache",
    "gnu general public": "gpl", "gnu gpl": "gpl", "lesser general public license": "lgpl", "gnu lesser general public": "lgpl",
    "affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "creative commons": "cc", "cc by": "cc-by", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0", "public domain": "public-domain", "the unlicense": "unlicense", "all rights reserved": "proprietary",
}
# Identifiers of expressions by their first letters, the longest that fits; and how free a licence is, from 0 to 1.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "bsd": "bsd", "0bsd": "bsd",
    "isc": "isc", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc0": "cc0", "unlicense": "unlicense",
}
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "apache": 0.9, "cc-by": 0.85, "mpl": 0.7,
    "epl": 0.65, "lgpl": 0.6, "cc-by-sa": 0.5, "cc": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.15, "proprietary": 0.0,
}
NO_NOTICE, UNKNOWN, EXCEPTION_GAIN = 0.5, 0.25, 0.1

TAG = "spdx license identifier"
_TAG_LINE = re.compile(rb"spdx-license-identifier:[\x20\t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}
# Letters and digits stay (A-Z lower-cased), bytes from 0x80 stay, everything else becomes a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def label_of(identifier: str) -> str | None:
    name = identifier.lower().rstrip("+")
    fitting = [p for p in IDENTIFIERS if name == p or name.startswith(p + "-")]
    return IDENTIFIERS[max(fitting, key=len)] if fitting else None


def postfix(expression: str) -> list[str]:
    """Operands and operators in evaluation order, up to the first token that cannot go on the expression."""
    out, waiting, wants_operand = [], [], True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _BINDS and not wants_operand:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
            wants_operand = True
        elif token == "(" and wants_operand:
            waiting.append(token)
        elif token == ")" and not wants_operand and "(" in waiting:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif wants_operand and low not in _BINDS and token not in "()":
            out.append(token)
            wants_operand = False
        else:
            break
    if wants_operand and waiting and waiting[-1] != "(":
        waiting.pop()  # an operator without its right side
    while waiting:
        if (operator := waiting.pop()) != "(":
            out.append(operator)
    return out


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """(labels, freedom) of an expression; None without a licence. Unknown identifiers have no label."""
    values: list[tuple[set[str], float]] = []
    for token in postfix(expression):
        if token not in _BINDS:
            label = label_of(token)
            values.append(({label} if label else set(), FREEDOM[label] if label else UNKNOWN))
            continue
        if len(values) < 2:
            break
        right, left = values.pop(), values.pop()
        if token == "with":  # the right side names an exception, not a licence
            values.append((left[0], min(1.0, left[1] + EXCEPTION_GAIN)))
        else:
            pick = max if token == "or" else min
            values.append((left[0] | right[0], pick(left[1], right[1])))
    return values[-1] if values else None


class Scanner:
    """The automaton over ` word word ` texts, and what its hits say of a text."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for phrase, label in PHRASES.items():
            self.automaton.add_word(f" {phrase} ", (False, label, len(phrase) + 2))
        self.automaton.add_word(f" {TAG} ", (False, None, len(TAG) + 2))
        for phrase, label in BASE_PHRASES.items():
            self.automaton.add_word(f" {phrase} ", (True, label, len(phrase) + 2))
        self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        text = text or b""
        words = text.translate(_WORD_BYTES).split()
        joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
        n_base, starts, base, labels, freedom, tagged = 0, [], set(), set(), [], False
        for end, (is_base, label, length) in self.automaton.iter(joined):
            if is_base:
                n_base += 1
                base.add(label)
                starts.append(end - length + 1)
            if label is None:
                tagged = True
            else:
                labels.add(label)
                freedom.append(FREEDOM[label])
        if tagged:
            for line in _TAG_LINE.findall(text.lower()):
                found = evaluate(line.decode("utf-8", "replace"))
                if found:
                    labels |= found[0]
                    freedom.append(found[1])
        first = joined.count(" ", 0, min(starts)) if starts else None
        last = joined.count(" ", 0, max(starts)) if starts else None
        score = min(freedom) if freedom else NO_NOTICE
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def licence_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of `docs`.

    A NULL text is empty. score is the freedom of the strictest notice, NO_NOTICE without one. Rows are scanned one by one, so
    repeated rows and ids repeat their results; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for frame in batches:
            rows = [scanner.scan(t) for t in frame["text"]]
            found = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            found = found.astype({"first_word": "Int64", "last_word": "Int64"})
            found.insert(0, "id", frame["id"].to_numpy())
            yield found

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInPandas(scan, f"id {id_type}, n_words long, n_base long, first_word long, last_word long, "
                                   "base_labels string, labels string, score double").withColumnRenamed("id", id_col)


@query("op8_licence_notices")
def op8(spark, sf_dir):
    """Word count, base phrase places, labels and score of every document."""
    return licence_notices(table(spark, sf_dir, "documents"))
