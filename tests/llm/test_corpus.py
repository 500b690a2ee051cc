import os
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataql.llm import frequencies as fr
from strataql.llm import mixing, tokenizer
from strataql.llm.residue import residue, spans
from tests.llm import held_out


# -- frequencies
def test_frequencies_by_brute_force(spark):
    rows = [(i, i % 7 if i % 5 else None, " Hot" if i % 3 else f"t{i % 40}", [None, "", " ", "X", "y"][i % 5]) for i in range(600)] + [(1, 1, "HOT ", "x")]
    df = spark.createDataFrame(rows, "issue long, stmt long, rule string, sev string").selectExpr("*", "'clash' AS term", "1 AS term_id", "2 AS n")
    issues, stmts = defaultdict(set), defaultdict(set)
    for i, s, r, v in rows:
        for f, t in (("rule", r), ("sev", v)):
            if t is not None and t.strip():
                issues[f, t.strip().lower()].add(i)
                if s is not None:
                    stmts[f, t.strip().lower()].add(s)
    n = len({s for _, s, _, _ in rows if s is not None})
    want = {(f, t, len(x), len(stmts[f, t]), n, len(x) < 5, len(stmts[f, t]) > 0.2 * n) for (f, t), x in issues.items()}
    for hot_share in (fr.HOT_SHARE, 0.05, 2.0):  # all terms hot, some, none
        assert {tuple(r) for r in fr.frequencies(df, ["rule", "sev"], "issue", "stmt", hot_share).collect()} == want
    assert fr.frequencies(df.limit(0), ["rule", "sev"], "issue", "stmt").collect() == []


# -- tokenizer
TEXTS = ["Hello world, hello  worlds!\r\n\tx", "<|endoftext|> isn't special", "naïve café Ω≈ç ½ 👩🏽‍💻 日本語", "a" * 5000, "", None, " ", "12 345678 x_y-- ​﻿\x07", "don't DON'T we'll"]


@pytest.fixture(scope="module")
def bpe():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenizer.tokenizer_folder()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


def test_encode(spark, bpe):
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(TEXTS * 3)], "key long, body string, id string")
    for size in (5, 60_000):
        got = {r.id: r.ids for r in tokenizer.encode(df, "key", "body", size=size).collect()}
        assert got == {i: bpe(t) for i, t in enumerate(TEXTS * 3)}
    counts = {r.id: (r.kind, r.n_tokens) for r in tokenizer.token_counts(df.withColumnRenamed("id", "kind"), "key", "body", keep=("kind",)).collect()}
    assert counts == {i: ("a", len(bpe(t))) for i, t in enumerate(TEXTS * 3)}
    assert tokenizer.encode(df.limit(0), "key", "body").collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "日", "7", "½", "'s", "'", ".", "_", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "👩🏽", "x" * 300]), max_size=25).map("".join) | st.text(max_size=40))
def test_words_hold_whole_pieces(text):
    path = f"{tokenizer.tokenizer_folder()}/byte_bpe_50k.tiktoken"
    words = tokenizer.cut(text)
    assert "".join(words) == text
    assert [i for w in words for i in tokenizer.merge(w, path)] == tokenizer._merger(path).encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=8), st.lists(st.integers(0, 9), max_size=3), max_size=30), st.lists(st.binary(max_size=9), max_size=30))
def test_lexicon(words, others):
    lex = tokenizer.Lexicon.build(words)
    asked = list(words) + others
    for word, number in zip(asked, lex.numbers(asked)):
        assert (number >= 0) == (word in words)
        if number >= 0:
            assert lex.ids_of(number) == words[word]


def test_lexicon_is_minimal_and_maps(tmp_path):
    words = {f"{a}{b}ing".encode(): [i] for i, (a, b) in enumerate((x, y) for x in "abcdef" for y in "uvwxyz")}
    lex = tokenizer.Lexicon.build(words)
    assert len(lex.final) == 6  # root, two letters and the shared "ing"
    (tmp_path / "x.bin").write_bytes(lex.to_bytes())
    again = tokenizer.Lexicon.load(tmp_path / "x.bin")
    assert list(again.numbers(list(words))) == list(lex.numbers(list(words))) and again.numbers([b"auin"])[0] == -1


# -- mixing
def test_water_fill():
    got = {s.source: s.allotted for s in mixing.water_fill([("a", 0.5, 1, 10), ("b", 0.25, 4, 100), ("c", 0.25, 4, 100), ("d", 0.0, 1, 5), ("e", 0.1, 3, 0)], 100)}
    assert got == {"a": 10.0, "b": 45.0, "c": 45.0, "d": 0.0, "e": 0.0}
    got = {s.source: s.allotted for s in mixing.water_fill([("a", 0.5, 2, 10), ("b", 0.5, 1, 10)], 100)}
    assert got == {"a": 20.0, "b": 10.0}


def test_water_fill_does_not_depend_on_hash_seeds():
    code = "from strataql.llm.mixing import water_fill; print([s.allotted.hex() for s in water_fill([(f's{i}', 0.1 + i / 7, 1 + i % 3, 1000 + 37 * i) for i in range(40)], 123456.7)])"
    root = os.path.dirname(os.path.dirname(mixing.__file__.rsplit("/", 1)[0]))
    runs = {subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONHASHSEED": str(seed)}, capture_output=True, text=True, check=True).stdout for seed in (1, 2, 3)}
    assert len(runs) == 1


def test_mix(spark):
    docs = [(i, ["a", "b", "c", None][i % 4], 10 + i % 3, "z") for i in range(4000)]
    sized = spark.createDataFrame(docs, "id long, source string, n_tokens long, copies string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(sized, targets, total=25_000)
    rows = mixed.collect()
    assert {r.source for r in rows} == {"a", "b"} and len({r.id for r in rows}) == len(rows)
    by = Counter()
    for r in rows:
        by[r.source] += r.n_tokens * r.copies
        assert r.copies <= {"a": 1, "b": 2}[r.source]
    got = {r.source: r for r in shares.collect()}
    assert got["a"].mixed_tokens == by["a"] == got["a"].available_tokens  # clamped
    assert abs(by["b"] - (25_000 - by["a"])) < 60 and got["gone"].mixed_tokens == 0
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in rows}
    assert mixing.mix(sized.limit(0), targets)[0].collect() == [] and len(mixing.mix(sized.limit(0), targets)[1].collect()) == 3
    assert mixing.mix(sized, targets.limit(0))[0].collect() == []


# -- residue
RESIDUE = [
    "All is well here.\n\nOwner: {{ team_name }}",
    "Hello [[ .FirstName ]], the quote_lines review is done.",
    "Contact <%= owner %> or __TEAM_NAME__ today.",
    "Report by [object Object].",
    "Lorem ipsum dolor sit amet.",
    "Hier folgt Platzhaltertext, bitte ersetzen.",
    "Menu\n\n404 Not Found",
    "Die Seite konnte nicht gefunden werden.",
    "La página no responde.",
    "このページが見つかりません。",
    "<html><title>502 Bad Gateway</title></html>",
    '{"status": 503, "error": "Service Unavailable"}',
    "Please enable JavaScript to read this.",
    "Cette page exige JavaScript.",
    "Good content first. " * 50 + "Something went wrong while loading the rest.",
]
CONTENT = [
    "Write `{{ team_name }}` in the file.",
    'Users saw "Die Seite wurde nicht gefunden." for 3 minutes.',
    "```\n-- [FIRST_NAME]\nSELECT '{{x}}'\n```",
    "    SELECT [OWNER_TEAM] FROM [ORDER_LINES]",
    "The link returned 404 Not Found in May; the redirect is in place.",
    "Front-end asked us to enable JavaScript source maps.",
    "Reviewers should reject comments that still contain lorem ipsum.",
    "The variable is read as %CUT% literally.",
    "The jinja block {% if x %} is stripped.",
    "Names such as [total_amount] are T-SQL quoting.",
    "The view hides a column, yet two dashboards still ask for it.",
    "",
    "  \n",
    None,
]


def test_reports_govern_what_follows_only():
    found = [
        "The page could not be displayed because the server did not respond.",
        "This service is temporarily unavailable; the backend returned an error.",
        "The server returned an error: the page could not be found.",
        "You are asked to enable JavaScript.",
        "As you asked, this page could not be found.",
        "Users said hello, but this page could not be found.",
        "Resources such as this page could not be found.",
        "Check the syntax, since {{ owner_team }} owns it.",
        "{{ owner_team }} mentioned the backlog.",
        "Die Seite wurde nicht gefunden, und niemand meldete das.",
    ]
    content = [
        "Support said the page could not be found.",
        "Two users saw access denied on Monday.",
        "The proxy returned page could not be found until May.",
        "Security told us to enable JavaScript.",
        "Reviewers should reject scripts that still hold lorem ipsum.",
        "The token {{ owner_team }} is kept since the value is read as {{ owner_team }} on that host.",
        "It was seen that {{ owner_team }} stands for the owner.",
    ]
    for t in found:
        assert spans(t), t
    for t in content[:5] + content[6:]:
        assert not spans(t), t
    assert len(spans(content[5])) == 1


def test_blocks_decide():
    prose = "The nightly job reads all partitions and writes one row for each of them, which takes about an hour on the old hosts. " * 3
    message = "This page could not be found."
    assert not spans(prose + message + " " + prose) and spans(prose + "\n" + message + "\n" + prose) and spans(prose + message)
    assert not spans(prose + "Please enable JavaScript." + prose) and spans(prose + "Owner is {{ owner }} " + prose)


def test_held_out_lines():
    cases, content = held_out.CASES + held_out.LATER_CASES + held_out.LAST_CASES, held_out.CONTENT + held_out.LATER_CONTENT + held_out.LAST_CONTENT
    missed = [t for t in cases if not spans(t)]
    wrong = [t for t in content if spans(t)]
    assert len(missed) <= 0.1 * len(cases) and len(wrong) <= 0.1 * len(content), (missed, wrong)


def test_fillers_of_no_language():
    for t in ["asdf qwer hjkl asdfasdf xxx jkl; asdf", "blah blah etc etc yada yada foo bar baz", "Text.\n\nxxx xxx xxx\n\nMore text."]:
        assert spans(t), t
    for t in ["The alias foo is used for bar in two views.", "Rows, columns, etc. are counted.", "SELECT foo, bar FROM baz WHERE qux = 1 AND total > 2", "See page xxx of the manual."]:
        assert not spans(t), t


def test_residue(spark):
    for t in RESIDUE:
        assert spans(t), t
    for t in CONTENT:
        assert not spans(t), t
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(RESIDUE + CONTENT)], "key long, body string, id string")
    got = {r.id: r for r in residue(df, "key", "body").collect()}
    assert {i for i, r in got.items() if r.n_spans} == set(range(len(RESIDUE)))
    assert got[4].coverage == 1.0 and got[14].coverage < 0.1 and got[4].kinds == ["filler"]
    assert residue(df.limit(0), "key", "body").collect() == []
