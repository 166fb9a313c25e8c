"""Labels and expressions of licence scans against a plain reading of the words."""

import re

import numpy as np

from ruleloom.llm import licenses

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PARTS = ["MIT", "Apache-2.0", "GPL-3.0-only", "LicenseRef-own", "Nothing-1.0"]


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain(text):
    """(base labels, labels, n_base, expressions): phrases word by word, tags and their lines one by one."""
    w = [(m.group(), m.start(), m.end()) for m in WORDS.finditer(lowered(text))]
    phrases = {**licenses.NOTICE_PHRASES, **licenses.BASE_PHRASES}
    at = lambda i, p: [x[0] for x in w[i:i + len(p.split())]] == p.split()
    base = [licenses.BASE_PHRASES[p] for i in range(len(w)) for p in licenses.BASE_PHRASES if at(i, p)]
    labels, reach = set(base), -1
    for i in range(len(w)):
        longest = max((len(p.split()) for p in phrases if at(i, p)), default=0)
        if longest and i + longest - 1 > reach:
            labels |= {phrases[p] for p in phrases if at(i, p) and len(p.split()) == longest}
            reach = i + longest - 1
    tags = [i for i in range(len(w)) if at(i, licenses.TAG)]
    expressions = []
    for k, i in enumerate(tags):
        rest = text[w[i + 2][2]: w[tags[k + 1]][1] if k + 1 < len(tags) else len(text)]
        rest = re.split(r"[\r\n]", rest)[0].strip(" \t")
        rest = rest.removeprefix(":").strip()
        named = re.findall("|".join(map(re.escape, PARTS)), rest)
        if any(x != "Nothing-1.0" for x in named):
            expressions.append(rest)
            labels |= {licenses.licence_label(x) for x in named if x != "Nothing-1.0"}
    return ",".join(sorted(set(base))), ",".join(sorted(labels)), len(base), expressions


def test_labels_against_a_plain_reading():
    rng = np.random.default_rng(4)
    phrases = [*licenses.NOTICE_PHRASES, *licenses.BASE_PHRASES]
    met = 0
    for _ in range(600):
        out = []
        for _ in range(int(rng.integers(1, 9))):
            kind = rng.integers(0, 4)
            if kind == 0:
                out.append(phrases[int(rng.integers(0, len(phrases)))].title())
            elif kind == 1:
                terms = [PARTS[int(k)] for k in rng.integers(0, len(PARTS), int(rng.integers(1, 4)))]
                out.append("SPDX-License-Identifier: " + f" {['AND', 'OR'][int(rng.integers(0, 2))]} ".join(terms))
            else:
                out.append(["wörd", "license", "mit", "under the", "version 2", "cc"][int(rng.integers(0, 6))])
        text = [" ", "\n", "\t", "; "][int(rng.integers(0, 4))].join(out)
        # an expression goes on over words that follow it on its line; what is read ends at the first that doesn't fit
        row = licenses.scan(text)
        base, labels, n, expressions = plain(text)
        assert (row[4], row[5], row[1]) == (base, labels, n), text
        assert row[8] == expressions, text
        met += len(expressions)
    assert met > 100


def test_tags_on_one_line_and_exceptions():
    row = licenses.scan("SPDX-License-Identifier: MIT text here SPDX-License-Identifier: Apache-2.0 spdx_license-identifier (GPL-2.0-only)")
    assert row[5] == "apache-2,gpl-2,mit" and row[8] == ["MIT text here", "Apache-2.0", "(GPL-2.0-only)"]
    assert licenses.evaluate("MIT WITH LLVM-exception") == ({"mit"}, True)
    assert licenses.evaluate("MIT WITH ANYTHING") == ({"mit"}, False)
    assert licenses.evaluate("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT WITH AdditionRef-x") == ({"gpl-2", "mit"}, True)
    assert licenses.scan("SPDX-License-Identifier:")[5] == "" and licenses.scan("x SPDX License Identifier\nMIT")[5] == ""
    long = "lorem ipsum " * 200_000 + "SPDX-License-Identifier: MIT"
    assert licenses.scan(long)[5] == "mit"
