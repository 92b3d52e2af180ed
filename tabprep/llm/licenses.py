"""Licence scans: Aho-Corasick over words, shunting-yard over expressions (operator 7).

One automaton finds every notice phrase and identifier tag in a pass over a
text's lower-cased words. What follows an identifier tag on its line is parsed
by a shunting-yard parser (or < and < with) and evaluated: whether the terms
can be met with permissive licences only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.words import LOWER, MARK, slices

# Notice phrases (words of lower case) and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons": "cc",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
# Identifiers and prefixes of identifiers with permissive terms.
PERMISSIVE = ("0bsd", "apache", "bsd", "bsl-1.0", "cc-by-3.0", "cc-by-4.0", "cc0", "isc", "mit", "unlicense", "zlib")
#: How sure a document is licensed, by kind of evidence.
SURE = {"tag": 0.95, "base": 0.8, "notice": 0.6}

_FOLD = bytes(np.where(MARK[LOWER], 32, LOWER).astype(np.uint8))
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_RANK = {"or": 1, "and": 2, "with": 3}


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    """Of the phrases, each between two spaces."""
    a = ahocorasick.Automaton()
    for phrase in phrases:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def parse(text: str) -> list[str] | None:
    """Postfix form of the longest licence expression at the start of ``text`` (shunting-yard); None if it has none
    or is badly formed. Operators in any case; identifiers in lower case."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand comes next
    at = depth = 0
    while m := _TOKEN.match(text, at):
        token = (m[1] or m[2]).lower()
        if token == "(":
            if not operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif token in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                break
            out.append(token.rstrip(".:"))
            operand = False
        at = m.end()
    if operand or depth:
        return None
    return out + stack[::-1]


def allowed(postfix: list[str]) -> bool:
    """Whether the expression can be met with permissive licences only; an exception (with) adds to its licence."""
    values: list[bool] = []
    for token in postfix:
        if token in _RANK:
            right, left = values.pop(), values.pop()
            values.append(left if token == "with" else left and right if token == "and" else left or right)
        else:
            values.append(token.startswith(PERMISSIVE))
    return values[0]


def identifiers(postfix: list[str]) -> set[str]:
    """Licences that the expression names, exceptions left out, in short form."""
    stack: list[set[str]] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left | right)
        else:
            stack.append({_short(token)})
    return stack[0]


def _short(name: str) -> str:
    for start in ("apache", "lgpl", "agpl", "gpl", "mpl", "epl", "bsd", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by", "cc0"):
        if name.startswith(start):
            return start
    return name


def scan_text(text: str, found: ahocorasick.Automaton, phrases: dict[str, str]) -> tuple[int, list[tuple[int, str]], list[tuple[str, str | None, bool]]]:
    """Words of the text, (word, phrase) of every place, and (expression, postfix, allowed) after every tag."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places: list[tuple[int, str]] = []
    index = at = 0
    for end, phrase in found.iter(line):
        # matches come by their end, so starts may step back by a phrase
        start = end - len(phrase) - 1
        index += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        places.append((index, phrase))
    expressions = []
    tags = [i for i, p in places if p == TAG]
    if tags:
        ends = [m.end() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.lower())]
        for i in tags:
            after = raw[ends[i + TAG.count(" ")] :].split(b"\n", 1)[0].decode("utf-8", "replace").lstrip(" \t:")
            postfix = parse(after)
            expressions.append((after.strip(), " ".join(postfix) if postfix else None, bool(postfix) and allowed(postfix)))
    return len(words), sorted(places), expressions


_OUT = ("id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, "
        "places array<struct<word:long,phrase:string>>, expressions array<struct<text:string,postfix:string,allowed:boolean>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base (places of BASE_PHRASES), first_word and last_word (their
    smallest and largest start), base_labels, labels (those of notices and valid expressions too), score (how sure a
    licence is, 0 to 1), permissive (every valid expression can be met permissively; null without one), places and
    expressions.

    A null or empty text has no words and no places; overlapping places all count; a badly formed expression adds no
    label. Whole texts are scanned. Rows with equal ids are rows of their own; an empty table gives an empty result.
    """
    phrases = {**(NOTICES if notices is None else notices), **BASE_PHRASES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton({**phrases, TAG: ""})
        schema = pa.schema([("id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()),
                            ("score", pa.float64()), ("permissive", pa.bool_()), ("places", pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))),
                            ("expressions", pa.list_(pa.struct([("text", pa.string()), ("postfix", pa.string()), ("allowed", pa.bool_())])))])
        for batch in slices(batches, "text"):
            rows = []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, places, expressions = scan_text(text or "", found, phrases)
                base = [i for i, p in places if p in BASE_PHRASES]
                own = {BASE_PHRASES[p] for _, p in places if p in BASE_PHRASES}
                noted = {phrases[p] for _, p in places if p != TAG}
                valid = [x for x in expressions if x[1]]
                tagged = set().union(*(identifiers(x[1].split()) for x in valid))
                doubt = 1.0
                for kind, labels in (("tag", tagged), ("base", own), ("notice", noted - own)):
                    doubt *= (1 - SURE[kind]) ** len(labels)
                rows.append({"id": id_, "n_words": n, "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None),
                             "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | noted | tagged)), "score": 1 - doubt,
                             "permissive": all(x[2] for x in valid) if valid else None, "places": [{"word": i, "phrase": p} for i, p in places],
                             "expressions": [{"text": a, "postfix": b, "allowed": c} for a, b, c in expressions]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _OUT)
