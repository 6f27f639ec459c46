import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import language_id as L

KIND = "doc_id long, text string, lang string"
EN, DE = "the king of the north and the queen of the south were there ", "der hund und die katze sind nicht in dem haus gewesen "


def plain_phrases(text, reference):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in reference:
            k += 1
        i, n = i + k, n + 1
    return n


def symbols(model, text):
    return model.codes[[ord(c) for c in text]].astype(np.int32)


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=1, max_size=40), st.text("bcd ", min_size=1, max_size=40), st.lists(st.text("abcdé ", min_size=1, max_size=60), min_size=1, max_size=6), st.integers(1, 9))
def test_parses_equal_greedy_search(one, two, texts, segment):
    """Whole texts, whatever the segments and however many are parsed in step."""
    model = L.LanguageModel({"x": one, "y": two})
    expected = [[plain_phrases(t, one), plain_phrases(t, two)] for t in texts]
    kept = L.SEGMENT, L.LANES
    try:
        L.SEGMENT = segment
        for L.LANES in (2, 6, 1000):
            assert model.phrases([symbols(model, t) for t in texts]).tolist() == expected
    finally:
        L.SEGMENT, L.LANES = kept


def test_long_texts_are_parsed_whole():
    rng = random.Random(1)
    word = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(n))
    samples = {"x": f" {word(150)} ", "y": f" {word(150)} "}
    model = L.LanguageModel(samples)
    text = word(3000)
    folded = model.fold(text)
    assert len(folded) > 5 * L.SEGMENT
    assert model.phrases([folded, folded[:5]])[0].tolist() == [plain_phrases(f" {text} ", samples[k]) for k in "xy"]


def test_tables_of_many_letters_stay_small():
    rng = random.Random(2)
    model = L.LanguageModel({k: " " + "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(3000)) + " " for k in "abc"})
    assert model.table.nbytes < 4 << 20 and model.first.nbytes < 1 << 20


@pytest.fixture
def docs(table):
    rows = [(i, (EN if i % 2 else DE) * 5, "en" if i % 2 else "de") for i in range(20)]
    rows += [(50, None, "en"), (51, "", None), (52, "123 !!", "de"), (53, EN * 400, None), (54, "THE NORTH", None), (54, "THE NORTH", None), (None, "the queen", "en"), (55, DE * 300 + EN, None)]
    return table(rows, KIND, ["score", "_found"])


def test_prediction_equals_brute_force(docs):
    model = L.learn(docs)
    sample = {"en": " ", "de": " "}
    texts = sorted({(r.lang, r.text) for r in docs.collect() if r.lang and r.text and any(c.isalpha() for c in r.text)})
    out = L.predict(docs, model).collect()
    assert len(out) == 28 and len(texts) == 3
    order = [L.learn(docs.where(f"lang = '{k}'")).languages for k in sample]
    assert order == [["en"], ["de"]]
    # the languages' texts as the model holds them: each distinct row once, by hash
    for r in out:
        folded = " ".join("".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split())
        if not folded:
            assert (r.lang_pred, r.score, r.phrase_rate) == ("und", 0, None)
            continue
        rates = model.rates([model.fold(r.text)])[0]
        best = min(range(2), key=lambda k: (rates[k], model.languages[k]))
        assert r.lang_pred == model.languages[best] == ("en" if "the " in folded[:30] else "de")
        assert math.isclose(r.phrase_rate, rates[best]) and math.isclose(r.score, 1 / sum(2 ** (rates[best] - x) for x in rates)) and 0 <= r.score <= 1


def test_rates_equal_brute_force():
    samples = {"de": f" {DE.strip()} ", "en": f" {EN.strip()} "}
    model = L.LanguageModel(samples)
    for text in ("the king!", "Der HUND und the cat", "x", DE * 30):
        folded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        expected = [plain_phrases(folded, samples[k]) * math.log2(len(samples[k])) / len(folded) for k in ("de", "en")]
        assert np.allclose(model.rates([model.fold(text)])[0], expected)


def test_ties_go_by_name_and_empty_tables_work(table):
    same = table([(1, EN, "b"), (2, EN, "a")], KIND)
    assert {r.lang_pred for r in L.predict(same, L.learn(same)).collect()} == {"a"}
    model = L.learn(same)
    empty = table([], KIND)
    assert L.learn(empty) is None and L.predict(empty, model).count() == 0
    assert {r.lang_pred for r in L.predict(same, None).collect()} == {"und"}
    few = L.learn(table([(i, EN, f"l{i % 5}") for i in range(20)], KIND), most_languages=3)
    assert few.languages == ["l0", "l1", "l2"]
