"""License scan: Aho-Corasick over words, SPDX tags, and a shunting-yard expression parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.common import text_blocks

# Phrases that the contract names, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices, as words. A longer notice also counts what it contains.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl-2",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0-1",
    "boost software license": "bsl-1",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "open data commons open database license": "odbl",
    "sil open font license": "ofl-1",
    "python software foundation license": "psf",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: Tags in front of a licence expression, in lower case; blanks may stand between tag and colon.
TAGS = ["spdx-license-identifier", "license-expression"]

# Identifiers of licences in lower case. Families with versions come from the rules below.
PERMISSIVE_NAMES = """
    0bsd afl-2.1 afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent
    bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 bzip2-1.0.6 cc0-1.0 curl fsfap ftl hpnd icu ijg isc libpng
    libpng-2.0 mit mit-0 mit-cmu ms-pl mulanpsl-2.0 ncsa ofl-1.1 openssl pddl-1.0 php-3.01 postgresql psf-2.0
    python-2.0 ruby tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
"""
OTHER_NAMES = """
    apache-1.0 apsl-2.0 artistic-1.0 busl-1.1 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 ecl-2.0
    efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ipl-1.0 json lppl-1.3c mpl-1.0 mpl-1.1 mpl-2.0 ms-rl nasa-1.3
    nposl-3.0 odbl-1.0 odc-by-1.0 osl-3.0 qpl-1.0 rpl-1.5 rpsl-1.0 sleepycat spl-1.0 sspl-1.0 sugarcrm-1.1.3 watcom-1.0
"""
_GNU = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "gfdl": ("1.1", "1.2", "1.3")}
_CC_KINDS, _CC_VERSIONS = ("by", "by-nc", "by-nc-nd", "by-nc-sa", "by-nd", "by-sa"), ("1.0", "2.0", "2.5", "3.0", "4.0")

PERMISSIVE = {*PERMISSIVE_NAMES.split(), *(f"cc-by-{v}" for v in _CC_VERSIONS)}
KNOWN = {
    *PERMISSIVE, *OTHER_NAMES.split(),
    *(f"{name}-{v}{end}" for name, versions in _GNU.items() for v in versions for end in ("", "-only", "-or-later")),
    *(f"cc-{kind}-{v}" for kind in _CC_KINDS for v in _CC_VERSIONS),
}
#: A tag's expression label that has a base label's meaning.
TAG_LABELS = {"apache-2.0": "apache-2", "gpl-3.0": "gpl-3", "gpl-2.0": "gpl-2"}

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COLON = re.compile(rb"[ \t]*:")
_LINE_END = re.compile(rb"[\r\n]")
_PART = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("expressions", T.StringType()),
    T.StructField("permissive", T.BooleanType()),
])


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: operators and/or/with to postfix order. Raises ValueError on a malformed expression.

    Text after a complete expression (a comment's end, prose) is left out.
    """
    out, held, want_operand, depth = [], [], True, 0
    for found in _PART.finditer(expression):
        part = found[0]
        word = part.lower()
        if part == "(":
            if not want_operand:
                break
            held.append(part)
            depth += 1
        elif part == ")":
            if want_operand or not depth:
                raise ValueError("a bracket without its operand")
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        elif word in _BINDS:
            if want_operand:
                raise ValueError("an operator without its operand")
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[word]:
                out.append(held.pop())
            held.append(word)
            want_operand = True
        elif want_operand:
            out.append(word.rstrip(".:"))
            want_operand = False
        else:
            break
    if want_operand or depth:
        raise ValueError("the expression breaks off")
    return out + held[::-1]


def is_known(name: str) -> bool:
    """Whether a lower-case name is a licence identifier: one of KNOWN, with "+" or not, or a reference of its own."""
    return name.removesuffix("+") in KNOWN or name.startswith("licenseref-") or name.startswith("documentref-") and ":licenseref-" in name


def evaluate(postfix: list[str], allowed: set[str] = PERMISSIVE) -> tuple[bool, list[str]]:
    """Whether ``allowed`` licences satisfy the expression, and its known licence names in order.

    Unknown names satisfy nothing and are not among the names. An exception behind ``with``
    changes neither; it has to be a single name (else ValueError), what it excepts may be compound.
    """
    stack: list[tuple[bool, list[str], bool]] = []
    for part in postfix:
        if part not in _BINDS:
            stack.append((part.removesuffix("+") in allowed, [part] if is_known(part) else [], True))
            continue
        right, left = stack.pop(), stack.pop()
        if part == "with":
            if not right[2]:
                raise ValueError("an exception has to be a name")
            stack.append((left[0], left[1], False))
        else:
            stack.append((left[0] and right[0] if part == "and" else left[0] or right[0], left[1] + right[1], False))
    held, names, _ = stack.pop()
    return held, list(dict.fromkeys(names))


def tag_values(data: bytes) -> Iterator[str]:
    """What stands behind each tag of a UTF-8 text, up to the line's end or the next tag."""
    found = tag_automaton().iter(data.lower().decode("latin-1"))
    tags = [(end + 1 - len(tag), colon.end()) for end, tag in found if (colon := _COLON.match(data, end + 1))]
    for (_, start), after in zip(tags, [*(first for first, _ in tags[1:]), len(data)], strict=True):
        line = _LINE_END.search(data, start, after)
        yield data[start : line.start() if line else after].decode("utf-8", "replace")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Phrases over a text's words, each between spaces; a tag's words have no label."""
    found = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for base, phrases in ((True, BASE_PHRASES), (False, NOTICE_PHRASES), (False, {t.replace("-", " "): "" for t in TAGS})):
        for phrase, label in phrases.items():
            entries.setdefault(phrase, []).append((base, label))
    for phrase, marks in entries.items():
        found.add_word(f" {phrase} ", (len(phrase), marks))
    found.make_automaton()
    return found


@lru_cache(1)
def tag_automaton() -> ahocorasick.Automaton:
    """Tags as they stand in lower-cased text."""
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, tag)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """One text's row of SCHEMA without the id."""
    data = (text or "").encode()
    words = data.translate(_TO_WORDS).split()
    flat = b" " + b" ".join(words) + b" "
    base, labels, weight, tagged = [], set(), 0, False
    base_labels = set()
    for end, (length, marks) in automaton().iter(flat.decode("latin-1")):
        start = end - length - 1
        for is_base, label in marks:
            if is_base:
                base.append(start)
                base_labels.add(label)
            elif not label:
                tagged = True
                continue
            labels.add(label)
            weight += 2 if is_base else 1
    expressions, permissive = [], None
    for raw in tag_values(data) if tagged else ():
        try:
            postfix = to_postfix(raw)
            ok, names = evaluate(postfix)
        except ValueError:
            continue
        if not names:
            continue
        permissive = ok if permissive is None else permissive and ok
        expressions.append(" ".join(postfix))
        plain = [x.removesuffix("+").removesuffix("-only").removesuffix("-or-later") for x in names]
        labels |= {TAG_LABELS.get(x, x) for x in plain}
        weight += 3
    at = [flat.count(b" ", 0, x) for x in ((min(base), max(base)) if base else ())]
    return (
        len(words), len(base), at[0] if base else None, at[1] if base else None, ",".join(sorted(base_labels)),
        ",".join(sorted(labels)), 1 - 0.5 ** min(weight, 50), "; ".join(expressions) or None, permissive,
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices and tags of every whole text, one row per row of ``docs``.

    A map without a shuffle: one pass of an Aho-Corasick automaton over each text's words.
    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are the
    smallest and largest start (words from 0), ``labels`` adds further notices and the known
    licences in tags (TAGS, found by an automaton too), whose expression a shunting-yard parser
    evaluates (``permissive``: whether permissive licences satisfy every tag). ``score`` is
    1 - 0.5 ** evidence, with 2 for a base place, 1 for another notice and 3 for a tag.

    Null text counts as empty: no words, no labels, score 0. Malformed tags and those without a
    known licence identifier give no label and no evidence.
    Repeated rows give repeated results; null ids stay null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("permissive", pa.bool_())])
        for part, texts in text_blocks(batches, "text"):
            rows = list(zip(*map(scan, texts), strict=True))
            yield pa.record_batch([part.column("doc_id"), *(pa.array(v, schema.field(i + 1).type) for i, v in enumerate(rows))], schema=schema)

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)
