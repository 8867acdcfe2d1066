from __future__ import annotations

import random

import numpy as np
import pytest

from loomfold.llm import canonical_form, packing, spans, text_quality
from loomfold.llm.expansion import expanded


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _texts():
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    part = make(60)
    return [make(90) + part + make(30), part + make(100), make(50), make(120), make(20) + part[:50], None, "", make(80)]


def _brute(texts, span):
    grams = [{t[i : i + span] for i in range(len(t or "") - span + 1)} if t else set() for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] & grams[j]}


def test_index_is_opened_again_appended_and_compacted(spark, tmp_path):
    texts = _texts()
    root = f"file://{tmp_path}/index"
    met = set()
    for step in range(4):
        index = spans.SpanIndex(spark, root)
        assert len(index.runs) <= spans.FAN
        docs = _docs(spark, texts).filter(f"doc_id % 4 = {step}")
        met |= {(r.a, r.b) for r in index.add(spans.fingerprints(docs, "doc_id", "text", 40, 20).select("h", "doc", "pos", "before")).collect()}
        index.close()
    assert _brute(texts, 40) <= met
    last = spans.SpanIndex(spark, root)
    assert last.version >= 5 and sum(spark.table(r).count() for r in last.runs) == spans.fingerprints(_docs(spark, texts), "doc_id", "text", 40, 20).count()
    folders = [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("loomfold_run")]
    assert len(folders) == len(last.runs)
    last.close()


def test_links_of_folded_classes(spark):
    texts = _texts()
    texts += [texts[0], texts[0], texts[3]]
    want = _brute(texts, 40)
    got = {r.doc_id: (r.rep, r.n_links) for r in spans.shared_links(_docs(spark, texts), span=40, gram=20).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (texts.index(t) if t and len(t) >= 40 else i, sum(i in p for p in want))


def test_expansion_in_parts(spark):
    members = spark.createDataFrame([("x", i) for i in range(30)] + [("y", 100 + i) for i in range(7)] + [("z", 200)], "cls string, id long")
    pairs = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "x")], "a string, b string")
    got = [(r.id_a, r.id_b) for r in expanded(pairs, members, part=4).collect()]
    x, y = range(30), range(100, 107)
    want = {(i, j) for i in x for j in y} | {(i, 200) for i in y} | {(i, j) for i in x for j in x}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("Videо", "Video"),  # Latin letters that only Latin shows decide
        ("Москва", None),  # one script
        ("Moсквa", "Москва"),  # к and в small are Cyrillic only
        ("ТОМ", "TOM"),  # no letter tells the script
        ("λόyoς", None),  # y has no Greek look-alike
    ],
)
def test_dominant_script(word, want):
    assert canonical_form.reading(word) == want


def test_repair_towards_the_dominant_script_needs_the_corpus(spark):
    rows = [("a", 1, "Moсквa"), ("a", 2, "Москва"), ("a", 3, "Хylem"), ("a", 4, None), ("a", 5, "")]
    df = spark.createDataFrame(rows, "src string, id long, text string")
    assert [(r.id_a, r.id_b) for r in canonical_form.same_look(df).collect()] == [(1, 2)]
    got = {r.id: r.text for r in canonical_form.canonical_text(df).collect()}
    assert got == {1: rows[1][2], 2: rows[1][2], 3: rows[2][2], 4: None, 5: ""}


def test_ranks_of_a_hot_length_in_parts(spark):
    rows = spark.range(5000).selectExpr("id AS k", "CASE WHEN id % 3 = 0 THEN 7 ELSE CAST(id % 11 AS INT) END AS n")
    got = packing.pack(rows, "k", "n", 20, part=100).filter("size > 0").collect()
    used: dict = {}
    for r in got:
        used.setdefault(r.container, []).append((r.offset, r.offset + r.size))
    for spans_ in used.values():
        spans_.sort()
        assert spans_[-1][1] <= 20 and all(a[1] <= b[0] for a, b in zip(spans_, spans_[1:], strict=False))
    assert len(got) == rows.filter("n > 0").count()


def test_model_is_fitted_on_labelled_texts():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9)))
    make = {
        "table": lambda: "\n".join(f"{word()}\t{r.randrange(99)}\t{word()}\t{r.randrange(9)}" for _ in range(r.randrange(4, 20))),
        "list": lambda: "\n".join(f"- {word()} {word()}" for _ in range(r.randrange(4, 20))),
        "prose": lambda: "\n".join(" ".join(["the", word(), "of", word(), "is", word(), "and", word(), "in", "the", word()] * 2) + "." for _ in range(r.randrange(2, 9))),
        "junk": lambda: "".join(r.choice("~^<>=;|*+#�") for _ in range(200)),
    }
    data = [(k, f()) for k, f in make.items() for _ in range(60)]
    features = lambda t: [text_quality.measure(t)[f] for f in text_quality.FEATURES]
    model = {k: np.array(v) for k, v in text_quality.fit(np.array([features(t) for _, t in data]), [k for k, _ in data], steps=300).items()}
    fresh = [(k, f()) for k, f in make.items() for _ in range(20)]
    scores = text_quality._terms(np.array([features(t) for _, t in fresh]), model["mean"], model["spread"]) @ model["weights"].T
    best = np.concatenate([np.zeros((len(fresh), 1)), scores], axis=1).argmax(1)
    assert np.mean([text_quality.KINDS[i] == k for (k, _), i in zip(fresh, best, strict=True)]) > 0.97


def test_periods_and_columns():
    assert text_quality.autocorrelation([0, 4, 0, 4, 0, 4, 0, 4], 2) > 0.7 > 0 > text_quality.autocorrelation([0, 4, 0, 4, 0, 4, 0, 4], 1)
    m = text_quality.measure("ab   cd   ef\ngh   ij   kl\nmn   op   qr")
    assert m["column_share"] == 1 and m["cells_share"] == 1
