"""Skewed, heavily edited and large inputs of the training-data operators."""

import numpy as np
import pytest

from ruleloom.llm import decontaminate, language, near, packing, toxicity
from ruleloom.llm.common import words
from ruleloom.llm.graph import components


def test_language_of_copies_has_a_dictionary(spark):
    copies = [(f"{'abcdefghij'[k % 10]} word{'abcdefghij'[k // 10]} text", "xx") for k in range(20) for _ in range(2_000)]
    few = [(f"other {chr(97 + k)}", "yy") for k in range(5)]
    rows = spark.createDataFrame(copies + few, "text string, lang string")
    found = [r["g"] for r in language.sample_pieces(rows, "text", "lang").collect()]
    assert found.count("xx") == 20 and found.count("yy") == 5
    assert sorted(language.fit_dictionaries(rows)) == ["xx", "yy"]


def whole_score(a, b):
    """Smith-Waterman over whole texts, cell by cell."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


@pytest.mark.parametrize("block", [20, 26, 33, 39, 40, 41, 60])
def test_copies_with_a_block_put_in(block):
    item = [f"i{k}" for k in range(50)]
    foreign = [f"f{k}" for k in range(300)]
    for cut in (10, 25, 42):
        text = foreign[:90] + item[:cut] + foreign[100:100 + block] + item[cut:] + foreign[200:]
        items = decontaminate.Items([(1, " ".join(item))])
        got = decontaminate.matches(items.read(" ".join(text)), items)
        best = whole_score(item, text) / 100
        assert [s for _, s, _ in got] == ([best] if best >= decontaminate.THRESHOLD else [])


def brute_matches(text, items):
    """Best similarity of each item of at least LEAST_WORDS words that reaches the threshold."""
    out = {}
    for i, item in items:
        w = words(item)
        if len(w) >= decontaminate.LEAST_WORDS and (s := whole_score(w, words(text)) / (2 * len(w))) >= decontaminate.THRESHOLD:
            out[i] = s
    return out


def edited(rng, item):
    """Words put in, left out, changed or moved, at random strength."""
    out, kind, p = [], rng.integers(0, 4), rng.uniform(0, 0.6)
    for w in item:
        if rng.random() < p:
            out += {0: [w, "new"], 1: [], 2: ["other"], 3: ["new", w, "words"]}[int(kind)]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_all_pairs_of_documents_and_items(seed):
    """Rarest seeds against Smith-Waterman over whole texts, with common words all over."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 40)))) for i in range(25)] + [(50, None), (51, "")]
    texts = []
    for _ in range(60):
        parts = [list(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(2)]
        texts.append(" ".join(parts[0] + edited(rng, (items[int(rng.integers(0, 25))][1]).split()) + parts[1]))
    group = decontaminate.Items(items)
    frequency = {int(s): int(rng.integers(1, 60)) for s in group.unique}
    if seed % 2:
        group.rare(frequency)
    found = 0
    for t in texts:
        got = {int(group.ids[k]): s for k, s, _ in decontaminate.matches(group.read(t), group)}
        assert got == pytest.approx(brute_matches(t, items))
        found += len(got)
    assert found > 25


def test_words_put_in_after_every_second_one():
    item = [f"i{k}" for k in range(60)]
    text = [w for k, w in enumerate(item) for w in ([w, "new"] if k % 2 else [w])]
    items = decontaminate.Items([(1, " ".join(item))])
    items.rare({int(s): 9 if k < 20 else 1 for k, s in enumerate(items.flat)})
    assert [s for _, s, _ in decontaminate.matches(items.read(" ".join(text)), items)] == [whole_score(item, text) / 120]


def test_contamination_of_odd_rows(spark):
    item = " ".join(f"i{k}" for k in range(20))
    rows = [(1, item, "x"), (1, item, "x"), (2, None, "y"), (3, "", "z"), (None, item, "n"), (4, "word " * 60_000 + item, "l"), (5, "i1 i2", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad_id string").repartition(3)
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id long, text string")
    found = decontaminate.contamination(docs, items).select("id", "item_id").distinct().collect()
    assert {tuple(r) for r in found} == {(1, 7), (4, 7), (None, 7)}
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["bad_id"] for r in kept.collect()) == ["n", "s", "y", "z"]
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == 7 and decontaminate.contamination(docs.limit(0), items).count() == 0


def test_components(spark):
    """Chains, stars, rings, loops and repeated edges, in any order of numbers."""
    rng = np.random.default_rng(2)
    name = rng.permutation(400).tolist()
    edges = [(k, k + 1) for k in range(99)] + [(100, k) for k in range(101, 160)] + [(k, 160 + (k - 159) % 40) for k in range(160, 200)] + [(200, 200), (201, 202), (202, 201), (201, 202)]
    edges += [tuple(rng.integers(210, 400, 2).tolist()) for _ in range(90)]
    edges = [(name[a], name[b]) for a, b in edges]
    root = {n: n for e in edges for n in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    joined = {n for a, b in edges if a != b for n in (a, b)}
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["label"] for r in got.collect()} == {n: find(n) for n in joined} and got.count() == len(joined)
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_language_against_plain_compression(spark):
    """The same sizes and choices, text by text, from the compressor alone."""
    import zstandard as z

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = language.fit_dictionaries(docs, "text", "lang")
    assert len(dictionaries) > 1 and all(0 < len(d) <= language.DICTIONARY_BYTES for d in dictionaries.values())
    for r in language.identify_language(docs.drop("lang"), dictionaries).collect():
        body = " ".join("".join(c if c.isalpha() else " " for c in (r["text"] or "").lower()).split()).encode()
        sizes = {}
        for g, d in dictionaries.items():
            coder = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), level=language.LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes[g] = sum(len(coder.compress(body[k:k + language.BLOCK_BYTES])) for k in range(0, len(body), language.BLOCK_BYTES))
        best = sorted((n, g) for g, n in sizes.items())
        assert r["lang_pred"] == (best[0][1] if body else "und")
        if body:
            margin = (best[1][0] - best[0][0]) / best[0][0]
            assert r["margin"] == pytest.approx(margin) and r["accepted"] == (margin >= language.MARGIN)


def test_language_signs_are_no_letters_and_pieces_come_from_all_of_a_text(spark):
    odd = spark.createDataFrame([("² ½ ①",), ("Ⅷ 12",), ("a²",), ("_",)], "text string")
    got = [r["lang_pred"] for r in language.identify_language(odd, {"xx": b"word", "yy": b"other"}).collect()]
    assert got[0] == got[1] == got[3] == "und" and got[2] != "und"
    text = "x" * 70_000 + " " + "late words " * 400
    pieces = language.sample_pieces(spark.createDataFrame([(text, "aa")], "text string, lang string"), "text", "lang").collect()
    assert any("late words" in r["t"] for r in pieces) and len(pieces) == -(-len(text) // language.PIECE)


def test_toxicity_against_plain_sums(spark):
    """Scores by the formula of the machine, pair by pair; repeated and null labels."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    more = labels.unionByName(labels.limit(20)).unionByName(spark.createDataFrame([(1, None), (None, 1)], labels.schema))
    model = toxicity.fit_toxicity(docs, more)
    place = {int(b): k for k, b in enumerate(model["terms"])}
    assert len(place) > 0
    for r in toxicity.score_toxicity(docs.limit(150), model).collect():
        own = sorted({place[b] for w in set(words(r["text"])) for b in toxicity.terms_of(w) if b in place})
        z = model["w0"] + sum(model["w"][k] for k in own) + sum(float(model["v"][a] @ model["v"][b]) for i, a in enumerate(own) for b in own[:i])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z))) and r["predicted"] == (r["score"] >= 0.5)


def test_packing_evolves_every_piece(spark, monkeypatch):
    """No sequence but by the islands: a full piece set goes in, what is packed poorly once more."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, 0, int(z)) for k, z in enumerate(rng.integers(1, 300, 400))], "row long, piece int, length long")
    met, islands = [], packing._islands
    monkeypatch.setattr(packing, "BLOCK", 100)
    monkeypatch.setattr(packing, "_islands", lambda dealt, capacity: met.append({r["row"] for r in dealt.select("row").collect()}) or islands(dealt, capacity))
    packed = packing.pack_lengths(rows).collect()
    assert met[0] == set(range(400)) and met[1] < met[0] and {r["row"] for r in packed} == met[0] and len(packed) == 400
    fill = {}
    for r in packed:
        fill[r["block"], r["bin"]] = fill.get((r["block"], r["bin"]), 0) + r["length"]
    assert max(fill.values()) <= 1024


def test_near_groups_take_nothing_from_a_sample(spark, monkeypatch):
    """No text is drawn and no measured recall is asked: joined at the fixed floor alone."""
    def refuse(*_):
        raise AssertionError("a sample")

    for name in ("draw_probes", "recall", "adapted_depth"):
        monkeypatch.setattr(near, name, refuse)
    base = " ".join(f"w{j}" for j in range(120))
    docs = spark.createDataFrame([(1, base), (2, base + " end"), (3, base.replace("w60 ", "x ")), (4, "some other text")], "doc_id long, text string")
    assert {r["id"]: (r["class_id"], r["n_links"]) for r in near.near_links(docs).collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}
