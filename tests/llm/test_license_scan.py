import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from oracle import connect, rows_of

from tidewheel.llm import license_expression as le
from tidewheel.llm import license_scan as ls
from tidewheel.session import table

BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_base(text):
    words = words_of(text)
    at = sorted((k, label) for k in range(len(words)) for phrase, label in BASE.items() if tuple(words[k : k + len(phrase)]) == phrase)
    starts = [k for k, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at})))


def plain_notices(text):
    """Labels of notices within no longer one, by comparing words at every place."""
    words = words_of(text)
    spans = [(k, k + len(p.split()), p) for k in range(len(words)) for p in ls.NOTICES if words[k : k + len(p.split())] == p.split()]
    outer = [s for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and o[:2] != s[:2] for o in spans)]
    return {le.family(ls.NOTICES[p])[0] for _, _, p in outer}


def climb(tokens):
    """Value of an expression by precedence climbing, to hold the shunting yard to."""

    def side(least):
        token = tokens.pop(0)
        if token == "(":
            left = side(1)
            tokens.pop(0)
        else:
            left = le.Value(frozenset([le.family(token)[0]]), le.family(token)[1])
        while tokens and tokens[0] in le.BINDS and le.BINDS[tokens[0]] >= least:
            op = tokens.pop(0)
            if op == "with":
                tokens.pop(0)
                left = le.Value(left.labels, 2 if left.burden == 3 else left.burden)
            else:
                right = side(le.BINDS[op] + 1)
                left = le.Value(left.labels | right.labels, (min if op == "or" else max)(left.burden, right.burden))
        return left

    return side(1)


simple = st.sampled_from(["mit", "gpl-3.0-only", "lgpl-2.1+", "apache-2.0", "bsd-3-clause", "cc0-1.0", "agpl-3.0-or-later", "gpl-2.0 with classpath-exception-2.0"])
expression = st.recursive(simple, lambda e: st.tuples(e, st.sampled_from(["and", "or"]), e, st.booleans()).map(lambda t: f"({t[0]} {t[1]} {t[2]})" if t[3] else f"{t[0]} {t[1]} {t[2]}"), max_leaves=12)


@given(expression)
def test_expressions_against_climbing(text):
    tokens = re.findall(r"[()]|[^ ()]+", text)
    assert le.evaluate(le.postfix(text)) == climb(tokens)


@pytest.mark.parametrize(
    "text, labels, burden",
    [
        ("mit or apache-2.0", "apache,mit", 1),
        ("mit and gpl-3.0-only", "gpl,mit", 3),
        ("mit or gpl-3.0 and agpl-3.0", "agpl,gpl,mit", 1),
        ("(mit or gpl-3.0) and agpl-3.0", "agpl,gpl,mit", 3),
        ("gpl-2.0-only with classpath-exception-2.0", "gpl", 2),
        ("gpl-2.0 with classpath-exception-2.0 or mit and lgpl-3.0", "gpl,lgpl,mit", 2),
        ("mit or later", "mit", 1),
        ("mit.", "mit", 1),
        ("mit. and gpl-3.0", "mit", 1),
        ("(mit or (apache-2.0", "apache,mit", 1),
        ("mit) and gpl-3.0", "mit", 1),
        ("mit or (see file", "mit", 1),
        ("licenseref-own", "custom", 4),
        ("cc-by-nc-4.0 */", "cc-by-nc", 4),
        ("mitigate", None, None),
        ("see the file", None, None),
        ("and mit", None, None),
        ("", None, None),
        ("(", None, None),
        ("()", None, None),
        ("gpl-2.0 with", "gpl", 3),
        ("gpl-2.0 with (x)", "gpl", 3),
    ],
)
def test_expressions(text, labels, burden):
    postfix = le.postfix(text)
    if labels is None:
        assert postfix == []
    else:
        value = le.evaluate(postfix)
        assert (",".join(sorted(value.labels)), value.burden) == (labels, burden)


@given(st.lists(st.sampled_from(["mit", "gpl-3.0", "(", ")", "and", "or", "with", "x", "mit.", "and."]), max_size=12).map(" ".join))
def test_any_words_evaluate(text):
    postfix = le.postfix(text)
    if postfix:
        assert le.evaluate(postfix).labels


@given(st.text(alphabet=" \n.-:MmIiTtLlÉß0", max_size=30) | st.lists(st.sampled_from([*ls.NOTICES, "MIT", "License", "general public", "xyz", "é", "\x00", "cc", "by", "K"]), max_size=12).map("\n".join))
def test_phrases_against_plain(text):
    found = ls.scan(text)
    assert found[:5] == plain_base(text)
    base = set(filter(None, found.base_labels.split(",")))
    assert set(filter(None, found.labels.split(","))) == plain_notices(text) | base
    assert 0 <= found.score <= 1 and (found.score > 0) == bool(found.labels)


def test_tags_and_notices():
    found = ls.scan("x\n// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause */\ncode")
    assert (found.labels, found.burden, found.base_labels) == ("bsd,gpl,mit", 1, "")
    assert found.expressions == ["mit gpl-2.0-only or bsd-3-clause and"]
    assert ls.scan("License: Apache-2.0\nLicense: none").labels == "apache"
    assert ls.scan("the license, MIT").labels == ""
    lesser = ls.scan("GNU Lesser General Public License")
    assert (lesser.base_labels, lesser.labels, lesser.burden) == ("gpl", "gpl,lgpl", 2)
    assert ls.scan("Licensed under CC BY-NC 4.0.").labels == "cc-by-nc"


def test_long_texts_in_linear_time():
    text = "MIT License: MIT general public license " * 200_000
    found = ls.scan(text)
    assert (found.n_words, found.n_base, found.last_word) == (1_200_000, 400_000, 1_199_997)


def test_odd_rows(spark):
    rows = [(None, "MIT license"), (1, None), (1, ""), (2, "Apache  LICENSE\x0bmit"), (2, "Apache  LICENSE\x0bmit"), (3, "\x00"), (4, "İ mıt license ẞ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS labels", "1 AS score")
    got = sorted((tuple(r)[:6] for r in ls.scanned(docs).collect()), key=repr)
    assert got == sorted(((i, *plain_base(t)) for i, t in rows), key=repr)
    assert ls.scanned(docs.limit(0)).count() == 0


def test_documents_against_sql(spark, sf_dir):
    """The base columns of the whole table, in SQL; labels against the plain version."""
    sql = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    at_ AS (
        SELECT doc_id, w, len(w) AS n_words,
               list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS m,
               list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS a,
               list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g FROM w)
    SELECT doc_id, n_words, len(m) + len(a) + len(g) AS n_base, list_min(m || a || g) AS first_word, list_max(m || a || g) AS last_word,
           concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels
    FROM at_"""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = ls.op11_license_scan(spark, sf_dir)
    want = connect(sf_dir).execute(sql).fetchall()
    assert rows_of(names, found.select(*names).collect()) == rows_of(names, want)
    assert sum(r[2] for r in want) > 0
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    for r in found.collect():
        if not re.search(r"(?i)licen[sc]es?\s*:", texts[r["doc_id"]] or ""):
            assert set(filter(None, r["labels"].split(","))) == plain_notices(texts[r["doc_id"]]) | set(filter(None, r["base_labels"].split(",")))


def test_a_place_in_prose():
    rng = random.Random(1)
    prose = [rng.choice("abcdefg") * 3 for _ in range(2000)]
    prose[1234:1236] = ["Mit", "LICENSE"]
    assert ls.scan(" ".join(prose))[1:4] == (1, 1234, 1234)
