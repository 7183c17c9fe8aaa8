import random
import re
import string
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import private_data as pd_
from tidewheel.session import table


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write the.72@mail3.example.com now", [("email", "the.72@mail3.example.com")]),
        ("ENDS ÑÚ.01@MAIL8.EXAMPLE.COM.", [("email", "ÑÚ.01@MAIL8.EXAMPLE.COM")]),
        ("call +1 (076) 555-8046!!", [("phone", "+1 (076) 555-8046")]),
        ("at 126.40.69.100!! or 300.1.1.1", [("ip", "126.40.69.100")]),
        ("953013749 4550997810720808 x", [("number", "953013749"), ("card", "4550997810720808")]),
        ("4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
        ('token = "99168226c4d3cee7e953ef6959c77215d0cbdfc9"', [("secret", "99168226c4d3cee7e953ef6959c77215d0cbdfc9")]),
        ("password: hunter2hunter2", [("secret", "hunter2hunter2")]),
        ("GB82 WEST 1234 5698 7654 32", [("iban", "GB82 WEST 1234 5698 7654 32")]),
        ("ssn 078-05-1120.", [("ssn", "078-05-1120")]),
        ("Mrs. Mary Poppins met John Smith", [("person", "Mrs. Mary Poppins"), ("person", "John Smith")]),
        ("In 2024 some 12,345 words, v1.2.3 and 10-12-2024. Mary had", []),
    ],
)
def test_detection(text, want):
    assert [(k, text[a:b]) for a, b, k in pd_.detect(text)] == want


@pytest.mark.parametrize(("left", "right"), [(1, 1), (1, 7), (10, 1), (2, 2), (3, 5), (26, 26), (90, 156)])
def test_permutation_is_one_to_one_and_leaves_none(left, right):
    n = left * right
    made = [pd_.moved(k, left, right, b"k", "t") for k in range(n)]
    assert sorted(made) == list(range(n)) and (n < 2 or all(a != b for a, b in enumerate(made)))
    assert n < 50 or made != [pd_.moved(k, left, right, b"j", "t") for k in range(n)]


def shape(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text)))


@pytest.mark.parametrize(
    ("kind", "every"),
    [
        ("email", [f"{a}@{b}.co" for a in string.ascii_lowercase for b in string.ascii_lowercase]),
        ("ip", [f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(10)]),
        ("ip", [f"{a}.0{b}.00{c}.{d}" for a in range(98, 101) for b in range(10) for c in range(10) for d in range(250, 256)]),
        ("ssn", [f"{a:09d}" for a in range(3000)]),
        ("card", [f"{a:013d}" for a in range(3000)]),
        ("secret", [f"{a}{b}{c}9" for a in "Ab" for b in "xY" for c in string.ascii_lowercase]),
    ],
)
def test_short_formats_hold_all_their_entities(kind, every):
    made = [pd_.surrogate(kind, e) for e in every]
    assert len(set(made)) == len(every) and all(m != e for m, e in zip(made, every, strict=True))
    assert kind == "ip" or [shape(m) for m in made] == [shape(e) for e in every]
    assert kind != "ip" or all([len(x) for x in m.split(".")] == [len(x) for x in e.split(".")] and all(int(x) < 256 for x in m.split(".")) for m, e in zip(made, every, strict=True))
    assert kind != "card" or all(pd_._luhn_ok(m) == pd_._luhn_ok(e) for m, e in zip(made, every, strict=True))
    if kind in ("email", "ip") and len(every) in (676, 10_000):
        assert set(made) == set(every)


def test_other_scripts_keep_theirs():
    for mention, pattern in [("ñandú7", "[à-þ][a-z]{3}[à-þ][0-9]"), ("Жук1", "[А-Я][а-я]{2}[0-9]"), ("漢字x", "漢字[a-z]"), ("٣1", "[٠-٩][0-9]")]:
        made = pd_.surrogate("secret", mention)
        assert re.fullmatch(pattern, made) and made != mention


def test_all_addresses_of_a_short_format(spark):
    rows = [(k, f"write {a}@{b}.co or 1.2.3.{k % 10}") for k, (a, b) in enumerate((a, b) for a in string.ascii_lowercase for b in string.ascii_lowercase)]
    found = pd_.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["text"].split()[1] for r in found}) == 676 and len({r["text"].split()[3] for r in found}) == 10


@pytest.mark.parametrize("mention", ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"])
def test_same_entity_same_surrogate(mention):
    made = pd_.surrogate("card", pd_.canonical("card", mention))
    assert made == pd_.surrogate("card", "4111111111111111") != "4111111111111111"
    assert pd_._luhn_ok(made)
    shown = pd_.rendered("card", mention, made)
    assert re.sub(r"\d", "0", shown) == re.sub(r"\d", "0", mention)


def test_formats_are_kept():
    iban = "GB82 WEST 1234 5698 7654 32"
    made = pd_.rendered("iban", iban, pd_.surrogate("iban", pd_.canonical("iban", iban)))
    assert pd_._iban_ok(made) and re.sub("[A-Z]", "A", re.sub(r"\d", "0", made)) == re.sub("[A-Z]", "A", re.sub(r"\d", "0", iban))
    assert pd_.detect(pd_.surrogate("ip", "9.88.7.254"))[0][2] == "ip"
    mail = pd_.rendered("email", "Ab.72@Mail3.example.com", pd_.surrogate("email", "ab.72@mail3.example.com"))
    assert re.fullmatch(r"[A-Z][a-z]\.\d\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com", mail)
    for name, (script, gender) in [("Mary Smith", ("latin", "f")), ("Иван Петров", ("cyrillic", "m"))]:
        first, last = pd_.Surrogates(pd_.KEY).of("person", name, name, {}).split()
        assert first in pd_.FIRST[script, gender] and last != name.split()[1]


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    mapping, n = {}, 0
    for r in pd_.replaced(docs).collect():
        text, at, out = before[r["doc_id"]], 0, []
        for s in r["entities"]:
            mention = text[s["start"] : s["start"] + s["length"]]
            entity = (s["kind"], pd_.canonical(s["kind"], mention))
            made = s["surrogate"].removeprefix(mention.split(" ")[0] + " ") if s["kind"] == "person" and mention.split(" ")[0].rstrip(".") in pd_.TITLES else s["surrogate"]
            made = made if s["kind"] == "person" else pd_.canonical(s["kind"], made)
            assert mapping.setdefault(entity, made) == made and mention != s["surrogate"]
            out += [text[at : s["start"]], s["surrogate"]]
            at, n = s["start"] + s["length"], n + 1
        assert r["text"] == "".join([*out, text[at:]])
        assert r["n_entities"] == len(r["entities"])
        for secret in re.findall(r"\S+@\S+\.com|[0-9a-f]{40}|\+1 \(\d{3}\) 555-\d{4}|\b\d{16}\b", text):
            assert secret not in r["text"]
    assert n > 5 and len({(k[0], v) for k, v in mapping.items()}) == len(mapping)


def plain_numbers(text):
    """Runs of nine digits and more that stand alone, and addresses of four numbers up to 255, found without regular expressions."""
    out = set()
    for word in "".join(c if c.isalnum() or c in "._" else " " for c in text).split():
        bare = word.strip(".")
        if bare.isdigit() and bare.isascii() and len(bare) >= 9 and word in (bare, bare + "."):
            out.add(bare)
        parts = bare.split(".")
        if word in (bare, bare + ".") and len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) < 256 for p in parts):
            out.add(bare)
    return out


def test_against_another_detector(spark, sf_dir):
    """What a plain search finds is gone, unless it is a surrogate that another entity was given."""
    docs = table(spark, sf_dir, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    found, n = pd_.replaced(docs).collect(), 0
    for r in found:
        for number in plain_numbers(before[r["doc_id"]]):
            spans = [before[r["doc_id"]][s["start"] : s["start"] + s["length"]] for s in r["entities"]]
            assert any(number in s for s in spans), number
            n += 1
    assert n > 3


@pytest.mark.parametrize("sent", [100_000, 0])
def test_names_that_meet_are_parted(spark, monkeypatch, sent):
    """Few surrogates at first: nearly all surnames meet; each keeps one, with and without a first name."""
    real = pd_.surrogate
    monkeypatch.setattr(pd_, "surrogate", lambda kind, entity, attempt=0, key=pd_.KEY: real(kind, entity, attempt, key) if attempt > 1 else "Same")
    names = [f"K{chr(97 + i)}{chr(97 + i // 2)}mer" for i in range(26)]
    rows = [(i, f"Mr {n} saw John {n} and Mary {n}") for i, n in enumerate(names)]
    made = {}
    for r in pd_.replaced(spark.createDataFrame(rows, "doc_id long, text string"), sent=sent).collect():
        surnames = [s["surrogate"].split()[-1] for s in r["entities"]]
        firsts = [s["surrogate"].split()[0] for s in r["entities"]]
        assert len(surnames) == 3 and len(set(surnames)) == 1 and firsts[0] == "Mr" and firsts[1] != "John" and firsts[2] != "Mary"
        made[rows[r["doc_id"]][1]] = surnames[0]
    assert len(set(made.values())) == 26


def test_the_session_names_the_key(spark):
    docs = spark.createDataFrame([(1, "at 12.13.14.15")], "doc_id long, text string")
    before = pd_.replaced(docs).first()["text"]
    spark.conf.set("tidewheel.surrogate.key", "other")
    try:
        assert pd_.replaced(docs).first()["text"] != before
    finally:
        spark.conf.unset("tidewheel.surrogate.key")


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "clean words only"), (4, "x@y.example.com " * 5_000), (None, "x@y.example.com"), (4, "x@y.example.com " * 5_000), (5, "a" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kind": F.lit("clash"), "entities": F.lit(0), "spans_": F.lit("x"), "late_": F.lit("y")})
    found = pd_.replaced(docs).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 7 and by_id[1]["text"] is None and by_id[2]["text"] == "" and by_id[3]["text"] == "clean words only"
    assert by_id[4]["n_entities"] == 5_000 and set(by_id[4]["text"].split()) == {by_id[None]["text"]} != {"x@y.example.com"}
    assert by_id[5]["text"] == rows[-1][1] and (by_id[1]["kind"], by_id[1]["spans_"], by_id[1]["late_"]) == ("clash", "x", "y")
    assert pd_.replaced(docs.limit(0)).count() == 0


def test_foreign_digits_are_kept_and_never_raise(spark):
    texts = ["GB٨٢ WEST 1234 5698 7654 32", "١٢.١٢.١.١", "+٤٩ ٣٠ ١٢٣٤٥٦٧", "१२३-४५-६७८९", "٥٥٥-١٢٣-٤٥٦٧ and 555-123-4567", "४५३२०१५११२८३०३६६", "DE٨٩ 3704 0044 0532 0130 00", "a٣b@example.com", "token=abcdef٣٤٥٦", "１２３４５６７８９０"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r["doc_id"]: r for r in pd_.replaced(rows).collect()}
    kinds = lambda t: [unicodedata.name(c).split(" ")[0] if c.isdecimal() else c if not c.isalnum() else "" for c in t]
    for k, text in enumerate(texts):
        assert len(made[k]["text"]) == len(text) and kinds(made[k]["text"]) == kinds(text)
    for k in (1, 2, 3, 4, 5, 9):
        assert made[k]["n_entities"] and made[k]["text"] != text
    arabic, ascii_ = made[4]["text"].split(" and ")
    assert "".join(str(unicodedata.decimal(c, c)) for c in arabic) == ascii_


def test_digits_are_one_entity_whatever_the_kind():
    said = "Call 555-123-4567 or (555) 123-4567; ref 5551234567."
    docs = [said[a:b] for a, b, _ in pd_.detect(said)]
    made = {"".join(c for c in pd_.Surrogates(pd_.KEY).of(k, pd_.canonical(k, said[a:b]), said[a:b], {}) if c.isdigit()) for a, b, k in pd_.detect(said)}
    assert len(docs) == 3 and len(made) == 1 and made != {"5551234567"}


def test_country_codes_stay():
    for number in ("+49 30 1234567", "+1 (212) 555-0199", "+352 26 12 34", "+7 495 123-45-67", "+44 20 7946 0958"):
        made = pd_.Surrogates(pd_.KEY).of("phone", pd_.canonical("phone", number), number, {})
        code = number.split(" ")[0]
        assert made.split(" ")[0] == code and made != number and [c.isdigit() for c in made] == [c.isdigit() for c in number]


def test_many_entities_in_one_text():
    text = " ".join(f"user{k}@mail{k % 977}.example.com 10.{k % 250}.{k // 250 % 250}.7" for k in range(50_000))
    began = time.perf_counter()
    assert len(pd_.detect(text)) == 100_000
    assert time.perf_counter() - began < 5


def test_overlaps_go_to_the_earlier_kind():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["555-123-4567", "a@b.com", " ", "-", "1.2.3.4", "12345", "+49", "x", "."]) for _ in range(rng.randrange(12)))
        spans = pd_.detect(text)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(spans, spans[1:]))
