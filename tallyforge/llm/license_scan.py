"""Licences that documents name: notice phrases, and expressions after identifier tags.

One Aho-Corasick automaton reads the words of a text for notice phrases, another the
text itself for tags such as ``SPDX-License-Identifier:``. Both are linear in the text,
whatever it holds. What follows a tag is read as a licence expression, as far as it is
one, and turned into postfix order by a shunting-yard parser: ``with`` binds closer
than ``and``, ``and`` closer than ``or``. It is evaluated to the terms that bind who
uses the text: the laxest side of an ``or``, the strictest of an ``and``; an exception
granted by ``with`` leaves no more than weak copyleft. A document's terms are the
strictest of all it names.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower
case. A phrase is found where its words stand one after the other, whatever is between
them. A licence is known by its family, ``gpl`` of ``GPL-3.0-or-later``, and families
are the labels. The score is that of independent hints: each label leaves half of the
doubt, each expression a tenth.

A null text is empty; one without words has 0 words, no places, empty label strings,
null terms and score 0. Very long texts are read whole. Ids may be null or repeat: rows
are read one by one. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Phrases of the contract and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

TERMS = ["public domain", "permissive", "weak copyleft", "copyleft", "network copyleft", "restricted"]
WEAK = TERMS.index("weak copyleft")

# Licence families and their terms.
FAMILIES = {
    "public domain": "cc0 unlicense 0bsd mit-0 wtfpl pddl",
    "permissive": "apache mit bsd isc zlib bsl artistic psf openssl ncsa x11 cc-by odc-by ofl upl afl",
    "weak copyleft": "lgpl mpl epl cddl cpl eupl ms-pl",
    "copyleft": "gpl cc-by-sa odbl osl gfdl",
    "network copyleft": "agpl sspl",
    "restricted": "cc-by-nc cc-by-nd cc-by-nc-sa cc-by-nc-nd busl reserved proprietary licenseref",
}
LEVELS = {name: TERMS.index(terms) for terms, names in FAMILIES.items() for name in names.split()}

# Notices and the families they name.
NOTICES = {
    "apache license": "apache",
    "apache software license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "open font license": "ofl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "server side public license": "sspl",
    "free documentation license": "gfdl",
    "open database license": "odbl",
    "business source license": "busl",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "released into the public domain": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "proprietary and confidential": "proprietary",
    "no part of this publication may be reproduced": "reserved",
}

# What stands before an expression, in lower case.
TAGS = ["spdx-license-identifier:", "license:", "licence:", '"license":', "licensed under", "licenced under"]

LABEL_DOUBT = 0.5
EXPRESSION_DOUBT = 0.1

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# All that is not of a word becomes a space.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in _LOWER)
_TOKEN = re.compile(r"[ \t\"']*([()]|[a-z0-9][a-z0-9.+:-]*)")
BINDING = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """The family of a licence identifier: the longest known name that begins it."""
    name = identifier.rstrip("+")
    while name and name not in LEVELS:
        name = name.rpartition("-")[0]
    return name or None


@dataclass(frozen=True)
class Expression:
    """A licence expression: its tokens, the families in it, its terms, and its end."""

    text: str
    families: frozenset[str]
    level: int
    end: int = 0


def postfix(tokens: list[str]) -> list[str]:
    """A well-formed expression in postfix order, by the shunting-yard algorithm."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in BINDING:
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(tokens: list[str], end: int = 0) -> Expression:
    """Terms and families of a well-formed expression."""
    levels: list[int] = []
    families = set()
    for token in postfix(tokens):
        if token in BINDING:
            right, left = levels.pop(), levels.pop()
            if token == "with":
                levels.append(min(left, WEAK))
            else:
                levels.append((min if token == "or" else max)(left, right))
        elif name := family(token):
            families.add(name)
            levels.append(LEVELS[name])
        else:  # an exception, which has no terms of its own
            levels.append(0)
    return Expression(" ".join(tokens), frozenset(families), levels[0], end)


def read_expression(text: str, at: int) -> Expression | None:
    """The longest expression that begins at a place of a text in lower case, if any.

    It ends before the first thing that is no known licence, operator or parenthesis.
    """
    tokens: list[str] = []
    depth = complete = end = 0
    operand_next = True
    while m := _TOKEN.match(text, at):
        at = m.end()
        token = m[1].rstrip(".:")
        after_with = bool(tokens) and tokens[-1] == "with"
        if operand_next:
            if token == "(" and not after_with:
                depth += 1
            elif after_with and "exception" in token or not after_with and family(token):
                operand_next = False
            else:
                break
        elif token == ")" and depth:
            depth -= 1
        elif token in BINDING and not (token == "with" and (tokens[-1] == ")" or tokens[-2:-1] == ["with"])):
            operand_next = True
        else:
            break
        tokens.append(token)
        if not operand_next and not depth:
            complete, end = len(tokens), m.start(1) + len(token)
        if m[1] != token:  # a full stop ends the expression
            break
    return evaluate(tokens[:complete], end) if complete else None


def _automaton(patterns: dict) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        automaton.add_word(pattern, value)
    automaton.make_automaton()
    return automaton


class Scanner:
    """Phrases and tags, ready to be searched for in texts."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: list[str]):
        # Spaces around a phrase keep it from beginning or ending inside a word. A phrase
        # of both tables is one of the contract's and of the method's.
        both = base | notices
        self._phrases = _automaton(
            {f" {p} ": (len(p) + 1, base.get(p), notices.get(p)) for p in both}
        )
        self._tags = _automaton({tag: len(tag) for tag in tags})

    def _expressions(self, data: bytes) -> tuple[dict[str, Expression], list[tuple[int, int]]]:
        """Expressions by their text, and from which word to which they stand."""
        lower = data.translate(_LOWER).decode("latin-1")
        expressions, spans = {}, []
        at = word = 0
        for end, length in self._tags.iter(lower):
            start = end - length + 1
            if start and _WORDS[data[start - 1]] != 32:  # inside a word
                continue
            if read := read_expression(lower, end + 1):
                expressions.setdefault(read.text, read)
                word += len(data[at:start].translate(_WORDS).split())
                at = read.end
                n = len(data[start:at].translate(_WORDS).split())
                spans.append((word, word + n))
                word += n
        return expressions, spans

    def scan(self, text: str | None) -> dict:
        """What one text names; the keys are those of ``SCANNED``."""
        data = (text or "").encode()
        words = data.translate(_WORDS).split()
        # A character for each byte, so that all patterns are plain ASCII.
        line = f" {b' '.join(words).decode('latin-1')} "
        expressions, spans = self._expressions(data)
        levels = [e.level for e in expressions.values()]
        n_base, first, last = 0, None, None
        base_labels, labels = set(), set()
        for read in expressions.values():
            labels |= read.families
        found = [(end - length, -end, b, n) for end, (length, b, n) in self._phrases.iter(line)]
        at, word, reach, span = 0, 0, -1, 0
        for start, end, base, notice in sorted(found, key=lambda f: f[:2]):
            word += line.count(" ", at, start)
            at = start
            while span < len(spans) and spans[span][1] <= word:
                span += 1
            # Terms are set by expressions, and by phrases outside them and longer phrases.
            if -end > reach and not (span < len(spans) and spans[span][0] <= word):
                levels.append(LEVELS[notice or base])
            reach = max(reach, -end)
            if notice:
                labels.add(notice)
            if base:
                n_base += 1
                first = word if first is None else first
                last = word
                base_labels.add(base)
        labels |= base_labels
        doubt = LABEL_DOUBT ** len(labels) * EXPRESSION_DOUBT ** len(expressions)
        return {
            "n_words": len(words),
            "n_base": n_base,
            "first_word": first,
            "last_word": last,
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)),
            "score": 1 - doubt,
            "terms": TERMS[max(levels)] if levels else None,
            "expressions": sorted(expressions),
        }


SCANNED = (
    T.StructType()
    .add("n_words", "long")
    .add("n_base", "long")
    .add("first_word", "long")
    .add("last_word", "long")
    .add("base_labels", "string")
    .add("labels", "string")
    .add("score", "double")
    .add("terms", "string")
    .add("expressions", T.ArrayType(T.StringType()))
)


def scan(
    documents: DataFrame,
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, str] = NOTICES,
    tags: list[str] = TAGS,
) -> DataFrame:
    """``doc_id`` and the columns of ``SCANNED`` for every document.

    ``base`` and ``notices`` map phrases, words in lower case joined by one space, to
    families of ``LEVELS``. ``n_base``, ``first_word``, ``last_word`` and
    ``base_labels`` are on places of ``base`` alone.
    """
    narrow = documents.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], *SCANNED.fields])

    def scan_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            found = [scanner.scan(text.as_py()) for text in batch.column("text")]
            columns = [batch.column("doc_id")]
            for name, kind in zip(SCANNED.names, kinds):
                columns.append(pa.array([f[name] for f in found], kind))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return narrow.mapInArrow(scan_task, schema)
