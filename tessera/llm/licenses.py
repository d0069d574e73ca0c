"""License scans: Aho-Corasick finds notice phrases and identifier tags, and tagged expressions are parsed and evaluated.

Texts are lower-cased and cut to words of letters and digits; a phrase counts wherever its words stand consecutively.
Where a tag stands comes from the automaton too: its words are mapped to their places in the text, and must share a
line. After an identifier tag the rest of the line is read as an expression of `and`, `or` and `with`, brackets included, by
the shunting-yard algorithm; what it evaluates to is the set of its licences, and whether one may choose a permissive
one. The automaton is built from the fixed phrases below, so its size does not depend on the data.

Nulls and odd rows: a null or empty text has no words, labels or places, and score 0; a broken expression gives the
identifiers that it names. Repeated rows get equal results, an empty table an empty one; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.base import table
from tessera.llm.decontaminate import WORD, plain_words
from tessera.llm.words import chunks

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases of well-known notices, their labels, and how sure each makes the label.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "licensed under the apache license": ("apache-2", 0.8),
    "gnu general public license": ("gpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission to use copy modify and or distribute this software": ("isc", 0.9),
    "creative commons attribution": ("cc-by", 0.7),
    "creative commons zero": ("cc0", 0.7),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "boost software license": ("bsl", 0.8),
    "all rights reserved": ("proprietary", 0.3),
}
TAG = "spdx license identifier"
#: What may stand between a tag and its expression.
BEFORE = re.compile(r"^[^A-Za-z0-9(]*")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
#: What comment signs put before the words of a line.
LEADER = re.compile(r"^[^A-Za-z0-9()]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "cc-by-4", "unlicense", "bsl", "zlib", "0bsd")
BASE_WEIGHT, TAG_WEIGHT = 0.8, 0.95
FOUND = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:array<string>,labels:array<string>,expressions:array<string>,permissive:boolean,score:double>"


def postfix(expression: str) -> list[str] | None:
    """The tokens of an expression, operators after their operands; None if it is broken. What follows a whole one is prose and left out."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # one is expected next
    for token in TOKEN.findall(expression):
        low = token.lower()
        if low in PRECEDENCE:
            if operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif token == "(":
            if not operand:
                break
            held.append(token)
        elif token == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            if not operand:
                break
            out.append(low)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def walk(line: str, operand: bool = True, depth: int = 0) -> tuple[list[str], bool, int, bool]:
    """The identifiers of a line up to where prose begins, whether one is expected next, how many brackets are open, and whether prose was met."""
    names: list[str] = []
    for token in TOKEN.findall(line):
        low = token.lower()
        if low in PRECEDENCE:
            operand = True
        elif token == ")":
            if not depth:
                return names, operand, depth, True
            operand, depth = False, depth - 1
        elif not operand:
            return names, operand, depth, True
        elif token == "(":
            depth += 1
        else:
            names.append(low)
            operand = False
    return names, operand, depth, False


def tags_of(text: str, numbers: list[int]) -> list[tuple[int, int]]:
    """Start and end in the text of the tags whose first words have these numbers, ascending; those broken by a line's end are left out."""
    places, wanted = {}, {n for first in numbers for n in (first, first + len(TAG.split()) - 1)}
    for n, word in enumerate(WORD.finditer(text)):
        if n in wanted:
            places[n] = word.span()
            if len(places) == len(wanted):
                break
    spans = [(places[n][0], places[n + len(TAG.split()) - 1][1]) for n in numbers]
    return [(a, b) for a, b in spans if "\n" not in text[a:b]]


def expressions_of(text: str, tags: list[tuple[int, int]]) -> Iterator[tuple[str, list[str]]]:
    """What stands after each tag, and the identifiers that it names. Lines are joined while brackets are open or an operator ends the line; a blank line, a further tag or a line of prose ends it."""
    starts = sorted(a for a, _ in tags)
    for _, stop in tags:
        at = text.find("\n", stop)
        at = at if at >= 0 else len(text)
        first = BEFORE.sub("", text[stop:at])
        parts, (names, operand, depth, prose) = [first], walk(first)
        while not prose and TOKEN.search(parts[-1]) and (operand or depth) and at < len(text):
            end = text.find("\n", at + 1)
            end = end if end >= 0 else len(text)
            line = LEADER.sub("", text[at + 1 : end])
            if not line or (i := bisect_left(starts, at)) < len(starts) and starts[i] < end:
                break
            more, operand, left, prose = walk(line, operand, depth)
            words = [x.lower() for x in TOKEN.findall(line)[:2]]
            if prose and (left or len(words) == 2 and not {"(", ")", *PRECEDENCE} & set(words)):
                break
            names, depth, at = names + more, left, end
            parts.append(line)
        yield " ".join(parts), names


def evaluate(tokens: list[str]) -> tuple[frozenset[str], bool]:
    """The licences of an expression in postfix, and whether its terms can be met by permissive ones alone."""
    stack: list[tuple[frozenset[str], bool]] = []
    for token in tokens:
        if token in PRECEDENCE:
            (b, free_b), (a, free_a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((frozenset(f"{x} with {y}" for x in a for y in b), free_a))
            else:
                stack.append((a | b, free_a or free_b if token == "or" else free_a and free_b))
        else:
            stack.append((frozenset([token]), token.startswith(PERMISSIVE)))
    return stack[0]


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase, label in BASE.items():
            self.automaton.add_word(f" {phrase} ", (phrase, label, BASE_WEIGHT, True))
        for phrase, (label, weight) in NOTICES.items():
            self.automaton.add_word(f" {phrase} ", (phrase, label, weight, False))
        self.automaton.add_word(f" {TAG} ", (TAG, None, TAG_WEIGHT, False))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> dict:
        words = plain_words(text)
        line = f" {b' '.join(words).decode()} "
        n_base, places, base, sure, expressions, free = 0, [], set(), {}, [], None
        tags = []
        for end, (phrase, label, weight, is_base) in self.automaton.iter(line):
            if is_base:
                n_base += 1
                base.add(label)
                places.append(end - len(phrase) - 1)
            if label is None:
                tags.append(end - len(phrase) - 1)
            else:
                sure[label] = max(weight, sure.get(label, 0.0))
        if tags:
            at, n, numbers = 0, 0, []
            for place in tags:  # blanks before a place are words before it
                n += line.count(" ", at, place)
                at = place
                numbers.append(n)
            for rest, names in expressions_of(text, tags_of(text, numbers)):
                tokens = postfix(rest)
                if tokens is None:
                    found, own = frozenset(names), False
                else:
                    found, own = evaluate(tokens)
                    expressions.append(" ".join(tokens))
                free = own if free is None else free and own
                for x in found:
                    sure[x] = max(TAG_WEIGHT, sure.get(x, 0.0))
        miss = 1.0
        for _, weight in sorted(sure.items()):
            miss *= 1 - weight
        first, last = (line.count(" ", 0, f(places)) if places else None for f in (min, max))
        return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": sorted(base), "labels": sorted(sure), "expressions": expressions, "permissive": free, "score": 1 - miss}


def scan(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """docs with a struct column `out`: counts and places of base phrases, labels, parsed expressions, and a score from 0 to 1."""
    before = docs.drop(out)
    schema = before.withColumn(out, F.lit(None).cast(FOUND)).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        look, kind = Scanner(), to_arrow_schema(schema).field(out).type
        for batch in chunks(batches, text=text):
            found = pa.array([look(x) for x in batch.column(text).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return before.mapInArrow(each, schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "licenses.n_words", "licenses.n_base", "licenses.first_word", "licenses.last_word", F.array_join("licenses.base_labels", ",").alias("base_labels"), F.array_join("licenses.labels", ",").alias("labels"), "licenses.score")
