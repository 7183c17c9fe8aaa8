import math
import unicodedata
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import language_id as li
from tidewheel.session import table

TOY = ["▁a", "a", "b", "ab", "▁ab", "bb", "▁", "abb"]


def cuts(text, chance, pieces):
    """Probability of a text by trying every cut."""
    if not text:
        return 1.0
    total = 0.0
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            total += chance[pieces.index(text[:n])] * cuts(text[n:], chance, pieces)
        elif n == 1:
            total += chance[len(pieces)] * cuts(text[1:], chance, pieces)
    return total


def test_forward_sums_all_cuts():
    rng = np.random.default_rng(0)
    chance = rng.random((len(TOY) + 1, 3))
    words = [b"a", b"ab", b"abb", b"abbab", b"axb", b"bbabbabb"]
    found = li.log_chances(li.Pieces(TOY), chance, words)
    for w, row in zip(words, found, strict=True):
        for k in range(3):
            assert np.exp(row[k]) == pytest.approx(cuts("▁" + w.decode(), chance[:, k], TOY))


def plain_log(word, chance, pieces):
    """Log probability of a long word by the plain recursion over positions, in exact fractions."""
    text, sums = "▁" + word.decode(), [Fraction(1)]
    for end in range(1, len(text) + 1):
        total = Fraction(0)
        for start in range(max(0, end - 8), end):
            part = text[start:end]
            if part in pieces:
                total += sums[start] * Fraction(chance[pieces.index(part)])
            elif end - start == 1:
                total += sums[start] * Fraction(chance[len(pieces)])
        sums.append(total)
    last = sums[-1]
    return math.log(last.numerator) - math.log(last.denominator)


@pytest.mark.parametrize("n", [15, 16, 17, 50, 200])
def test_long_words_are_scored_whole(n):
    rng = np.random.default_rng(n)
    chance = rng.random((len(TOY) + 1, 2)) / 1e5
    words = ["".join(rng.choice(list("abx"), 2 * n)).encode(), b"ab" * n, b"ba" * n]
    found = li.log_chances(li.Pieces(TOY), chance, words)
    for w, row in zip(words, found, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(plain_log(w, chance[:, k], TOY))


def test_long_words_teach_as_plain_counts():
    """Expected counts of a word of several stretches, against the change of its log probability."""
    rng = np.random.default_rng(4)
    chance, word = rng.random((len(TOY) + 1, 1)) / 10, b"abbab" * 30
    pieces = li.Pieces(TOY)
    (own, chars), = li.by_length([word])
    found = li._expected(pieces, chars, np.ones((1, 1)), chance, [])
    for i in range(len(TOY) + 1):
        more = chance.copy()
        more[i] *= 1 + 1e-6
        slope = (li.log_chances(pieces, more, [word]) - li.log_chances(pieces, chance, [word]))[0, 0] / 1e-6
        assert found[i, 0] == pytest.approx(slope, abs=1e-3)


def test_whole_texts_by_brute_force():
    rng = np.random.default_rng(2)
    chance = rng.random((len(TOY) + 1, 3)) / 4
    prior = np.log([0.5, 0.3, 0.2])
    model = li.Model(["x", "y", "z"], prior, li.Pieces(TOY), chance)
    texts = ["ab abb, axb", "b", "bbab" * 4 + " a 12 ab", None, "1 2", "ab " * 50]
    answers, scores = model.judge(texts)
    for text, answer, score in zip(texts, answers, scores, strict=True):
        words = "".join(c if c.isalpha() else " " for c in text or "").split()
        if not words:
            assert (answer, score) == ("und", 0)
            continue
        total = [prior[k] + sum(math.log(cuts("▁" + w, chance[:, k], TOY)) for w in words) for k in range(3)]
        share = np.exp(np.array(total) - max(total))
        assert answer == "xyz"[int(np.argmax(total))] and score == pytest.approx(share.max() / share.sum())


@pytest.mark.parametrize(("text", "want"), [("² ½", False), ("①", False), ("٣ 1_", False), ("", False), ("² é", True), ("漢", True), ("1a", True)])
def test_letters_are_category_l(text, want):
    assert li.has_letter(text) is want is any(unicodedata.category(c)[0] == "L" for c in text)


def test_a_language_may_have_any_name(spark):
    rows = [(1, "the cat sat", "word"), (2, "der hund", "n"), (3, "le chat", "lang"), (4, "² ½", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = li.predict(docs, li.train(docs))
    assert {r["doc_id"]: r["lang_pred"] for r in found.collect()} == {1: "word", 2: "n", 3: "lang", 4: "und"}


def test_fitting_raises_the_likelihood():
    words, counts = [b"abb", b"ab", b"bbb", b"axa"], np.array([[5.0, 1], [9, 0], [0, 7], [1, 1]])
    pieces = li.Pieces(TOY)
    seen = [(counts * li.log_chances(pieces, li.fit(pieces, words, counts, r, 1e-9), words)).sum(0) for r in (0, 1, 2, 5)]
    assert all((b >= a - 1e-9).all() for a, b in zip(seen, seen[1:], strict=False))


def test_held_out_accuracy(spark):
    rows = li.op8_language_unigrams(spark, "/root/testdata/sf0.01")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    held = rows.where("held_out").join(docs, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score"))
    right, low, high = held.first()
    assert right >= 0.97 and 0 <= low <= high <= 1
    assert rows.count() == docs.count()


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 .. !", "en"), (6, "the " * 30_000, None), (None, "und der", None), (1, "the cat sat on the mat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "key": F.lit(0)})
    model = li.train(docs.select("text", "lang"))
    found = [(r["doc_id"], r["lang_pred"]) for r in li.predict(docs, model).collect()]
    assert sorted(found, key=repr) == sorted([(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "de")], key=repr)
    assert li.predict(docs.limit(0), model).count() == 0
    nothing = li.train(docs.where("lang is null").select("text", "lang"))
    assert {r["lang_pred"] for r in li.predict(docs, nothing).collect()} == {"und"}


def test_the_sample_is_bounded_whatever_the_ids_and_copies(spark, monkeypatch):
    rows = [(None, f"word{k} und noch {k}", "de") for k in range(400)] + [(7, "the same words", "en")] * 3000 + [(k, f"an other text {k}", "en") for k in range(50)]
    held = {}
    monkeypatch.setattr(li, "fit", lambda pieces, words, counts, rounds: held.update(total=counts.sum(0)) or np.ones((pieces.size, counts.shape[1])))
    model = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=20)
    assert model.languages == ["de", "en"]
    assert held["total"][0] == 20 * 3 and 0 < held["total"][1] <= 20 * 4  # texts of three and of three or four words


def test_many_languages_in_smaller_batches():
    words = [b"abc"] * 5000
    assert max(len(own) for own, _ in li.by_length(words, 200)) * 25 <= max(len(own) for own, _ in li.by_length(words * 30, 1)) * 1.1
