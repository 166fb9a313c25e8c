"""Licence scan: Aho-Corasick over words, and a shunting-yard evaluator.

One automaton finds the notice phrases and the identifier tags in the words of
a whole text in one pass. What follows a tag, to the next tag or the line's end, is a
licence expression; a shunting-yard parser turns it into postfix form, which is
evaluated to the set of licences it names and to whether it can be met by permissive terms.

Null text counts as empty: no words, no labels, score 0. Texts of any length are
scanned whole, in time linear in it. Places that two phrases share belong to the longer
one, the base phrases' counts to all. Repeated rows give repeated results, empty
tables none. Extra columns stay; output columns that clash with an
existing name get a leading underscore.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import WORD_TABLE, fresh

#: Phrases whose places are counted.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notice phrases that the operator knows besides; the longest at a place wins.
NOTICE_PHRASES = {
    "the mit license": "mit",
    "apache license": "apache",
    "apache license 2 0": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public licence": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "isc license": "isc",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain",
}

#: Words of an identifier tag; an expression follows.
TAG = "spdx license identifier"

#: Labels whose terms ask no more than notices.
PERMISSIVE = {"mit", "apache", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "cc0", "public-domain", "bsl-1", "cc-by", "unlicense", "zlib"}

#: Identifiers of the public SPDX list that may stand in an expression.
IDENTIFIERS = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0
BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0
CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1
EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU ISC
LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1
MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby
SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, permissive boolean, expressions array<string>")

#: Exceptions of the public SPDX list that may follow ``with``.
EXCEPTIONS = """
Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0 FLTK-exception
Font-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 GPL-3.0-linking-exception LGPL-3.0-linking-exception Libtool-exception Linux-syscall-note
LLVM-exception OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Swift-exception
u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1
""".split()

_AFTER_TAG = re.compile(rb"[ \t]*:?[ \t]*([^\r\n]*)")
_WORD = re.compile(rb"[^ ]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def licence_label(name: str) -> str:
    """An identifier as a label: lower case, without -only, -or-later, + and .0."""
    name = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    return re.sub(r"(?<=-\d)\.0$", "", name)


@cache
def _labels() -> set[str]:
    return {licence_label(name) for name in IDENTIFIERS}


def is_licence(name: str) -> bool:
    """A listed identifier, or one that the text defines for itself."""
    return licence_label(name) in _labels() or re.fullmatch(r"(documentref-[a-z0-9.\-]+:)?licenseref-[a-z0-9.\-]+", name.lower()) is not None


@cache
def _exceptions() -> set[str]:
    return {name.lower() for name in EXCEPTIONS}


def is_exception(name: str) -> bool:
    """A listed exception, or one that the text defines for itself."""
    return name.lower() in _exceptions() or re.fullmatch(r"(documentref-[a-z0-9.\-]+:)?additionref-[a-z0-9.\-]+", name.lower()) is not None


def postfix(expression: str) -> list[str]:
    """Postfix form by the shunting-yard algorithm; with binds before and, and
    before or. Reading ends at the first token that can't continue the
    expression; unclosed brackets are closed."""
    out: list[str] = []
    ops: list[str] = []
    operand = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if token == "(":
            if not operand:
                break
            ops.append(token)
        elif token == ")":
            if operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif word in _PRECEDENCE:
            if operand:
                break
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[word]:
                out.append(ops.pop())
            ops.append(word)
            operand = True
        else:
            if not operand:
                break
            out.append(token)
            operand = False
    if operand and ops and ops[-1] != "(":  # a dangling operator
        ops.pop()
    return out + [o for o in reversed(ops) if o != "("]


def evaluate(expression: str) -> tuple[set[str], bool | None]:
    """Labels named, and whether permissive terms alone can meet it: any side
    of an ``or``, both of an ``and``, the licence before a ``with``. What is no
    licence names none and grants nothing, and a licence with an exception that isn't
    listed is named but not permissive. None where there is no licence."""
    stack: list[tuple[set[str], bool, str]] = []
    for token in postfix(expression):
        if token in _PRECEDENCE and len(stack) >= 2:
            (rn, rp, exception), (ln, lp, _) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((ln, lp and is_exception(exception), ""))  # it grants more, it names no licence
            else:
                stack.append((ln | rn, (lp or rp) if token == "or" else (lp and rp), ""))
        elif token not in _PRECEDENCE:
            label = licence_label(token)
            stack.append(({label} if is_licence(token) else set(), label in PERMISSIVE, token))
    return stack[-1][:2] if stack and stack[-1][0] else (set(), None)


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**NOTICE_PHRASES, **BASE_PHRASES, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _after_tags(raw: bytes, first_words: list[int]) -> Iterator[str]:
    """What follows each tag, from its last word to the line's end or the next tag;
    ``first_words`` are the tags' first words, counted from 0."""
    places = [m.span() for m in _WORD.finditer(raw.translate(WORD_TABLE))]  # translation keeps places
    stops = [places[w][0] for w in first_words[1:]] + [len(raw)]
    for w, stop in zip(first_words, stops):
        yield _AFTER_TAG.match(raw, places[w + len(TAG.split()) - 1][1], stop)[1].decode("utf-8", "replace").strip()


def scan(text: str | None) -> tuple:
    """One text's row of SCHEMA."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.translate(WORD_TABLE).split()
    line = " " + b" ".join(tokens).decode("latin-1") + " "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    expressions: list[str] = []
    tags, permissive = [], None
    spans = []
    for end, phrase in _automaton().iter(line):
        begin = end - len(phrase) - 1
        if phrase in BASE_PHRASES:
            starts.append(begin)
            base.add(BASE_PHRASES[phrase])
        if phrase == TAG:
            tags.append(begin)
        else:
            spans.append((begin, end, phrase))
    if starts or tags:  # from places in the line to words
        begins = list(accumulate((len(t) + 1 for t in tokens), initial=0))
        starts, tags = ([bisect_left(begins, s) for s in places] for places in (starts, tags))
    reach = -1
    for begin, end, phrase in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end > reach:  # not inside a longer phrase
            labels.add(BASE_PHRASES.get(phrase) or NOTICE_PHRASES[phrase])
            reach = end
    if tags:
        for expression in _after_tags(raw, tags):
            names, free = evaluate(expression)
            if names:
                expressions.append(expression)
                labels |= names
                permissive = free if permissive is None else permissive and free
    labels |= base
    if permissive is None and labels:
        permissive = labels <= PERMISSIVE
    score = 1.0 if expressions else 0.95 if base else 0.8 if labels else 0.0
    return (len(tokens), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive, expressions)


def _scan_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for texts in batches:
        frame = pd.DataFrame([scan(t) for t in texts], columns=names, dtype=object)
        for c in ("first_word", "last_word"):
            frame[c] = frame[c].astype("Int64")
        yield frame.astype({"n_words": "int64", "n_base": "int64", "score": "float64"})


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of SCHEMA. Rows are scanned where they lie:
    nothing is shuffled, so no source or group of copies can be hot."""
    run = F.pandas_udf(_scan_batches, SCHEMA)
    (hit,) = fresh(df, "hit")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    scanned = df.withColumn(hit, run(F.col(text)))
    return scanned.select(*df.columns, *(F.col(hit)[a].alias(b) for a, b in zip(names, fresh(df, *names))))


def labelled(labels: Column) -> Column:
    """Whether a row has any licence."""
    return F.length(labels) > 0


def op4_license_scan(spark, sf_dir):
    """One row per document; see the module for null and empty texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).drop("text")
