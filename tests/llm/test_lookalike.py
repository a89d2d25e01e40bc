"""Look-alike texts: equal looks get one form, visible differences stay."""

import pytest

from quern.llm import lookalike as L

CORPUS = ["the quick brown fox jumps over the lazy dog and copies paper", "сохранить подготовленные строки из файла и вернуть снимок", "die Größe der Datei wurde geändert", "Its façade view, the résumé page"]

SAME = [
    ("paper copies", "раpеr сорiеs"),
    ("сохранить строки", "сохpaнить cтpoки"),
    ("naïve façade", "naïve façade"),
    ("full width 42!", "ｆｕｌｌ　ｗｉｄｔｈ　４２！"),
    ("no gaps", "n​o­ g⁠a﻿ps‎"),
    ("a b c", "a b c"),
    ("office flat", "oﬃce ﬂat"),
    ("well-known", "well‐known"),
    ("well-known", "well‑known"),
    ("Time", "Τіmе"),
    ("co-op", "cо-օp"),
    ("line\nend", "line\r\nend"),
    ("й", "й"),
    ("ё", "ë"),
]
DIFFERENT = [
    ("km²", "km2"), ("Paper", "paper"), ("resume", "résumé"), ("end.", "end!"), ("one two", "onetwo"), ("rows 1", "rows l"), ("a b", "a  b"), ("a-b", "a–b"),
    ("👩‍🌾", "👩🌾"), ("…", "x"), ("и", "й"), ("か", "が"), ("a\nb", "a b"), ("می‌خواهم", "میخواهم"),
]


@pytest.fixture(scope="module")
def spelling():
    return L.Spelling(L.count_bigrams(iter(CORPUS * 5)))


@pytest.mark.parametrize("a,b", SAME)
def test_same(spelling, a, b):
    assert a != b and spelling.canonical(a) == spelling.canonical(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(spelling, a, b):
    assert spelling.canonical(a) != spelling.canonical(b)


def test_spelling_keeps_to_one_script(spelling):
    assert spelling.canonical("сохpaнить") == "сохранить"
    assert spelling.canonical("раpеr") == "paper" and spelling.canonical("paper").isascii()


def test_canonical_is_stable(spelling):
    for a, b in SAME + DIFFERENT:
        for t in (a, b):
            assert spelling.canonical(spelling.canonical(t)) == spelling.canonical(t)


def test_pairs(spark, rows):
    data = [(1, "paper one"), (2, "paper one"), (3, "рaper one"), (4, "paper one"), (5, "Paper one"), (6, None), (7, ""), (8, " "), (9, " "), (10, "​"), (4, "paper one"), (11, "other"), (12, "other")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id long, text string, look string")
    assert rows(L.look_alike_pairs(df)) == sorted([(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)], key=repr)
    assert L.look_alike_pairs(df.limit(0)).count() == 0


def test_hot_text_is_not_paired_with_itself(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(400)] + [(1000, "same text")], "doc_id long, text string")
    assert L.look_alike_pairs(df).count() == 400


def test_long_text(spelling):
    assert spelling.canonical("а" * 100_000) == spelling.canonical("a" * 100_000)


@pytest.mark.parametrize("a,b", [("data", "dαtα"), ("value", "valυe"), ("table", "τable"), ("none", "ոone"), ("Ace", "Ꭺce"), ("option", "ᴏption"), ("SVG", "ЅѴG")])
def test_other_scripts(spelling, a, b):
    assert spelling.canonical(a) == spelling.canonical(b)


@pytest.mark.parametrize("a,b", [("file", "fıle"), ("bold", "𝐛old"), ("Ace", "ace"), ("café", "cafe"), ("x2", "x²")])
def test_visible_differences_stay(spelling, a, b):
    assert spelling.canonical(a) != spelling.canonical(b)


def test_many_at_once_are_as_one_by_one(spelling):
    texts = ["plain words", "сор and cop", "сор", "caf́e​", "ａｂｃ d", "", "Привет, мир", "日本語 text", "a\r\nb", "ﬁle ‑ x"]
    assert spelling.canonical_all(texts) == [spelling.canonical(t) for t in texts]


def test_folding_is_the_same_where_nothing_is_odd():
    import unicodedata

    from quern.llm import lookalike as L

    for o in [*range(0x20, 0x3000), *range(0xA000, 0xA100), *range(0xF900, 0x10000)]:
        t = f"x{chr(o)}y"
        if 0xD800 <= o < 0xE000:
            continue
        if not L._odd().search(t):
            slow = L._SPACE.sub(" ", L._LINE.sub("\n", L._JOIN.sub(L._joiner, L._DROP.sub("", t)))).translate(L._folds())
            assert slow == t and L.fold(t) == unicodedata.normalize("NFD", t)


def test_classes(spark, rows):
    docs = spark.createDataFrame([(5, "cop a"), (3, "сop a"), (9, "cop a"), (2, "other"), (8, "other"), (7, None), (6, " "), (3, "сop a")], "doc_id long, text string")
    from quern.llm import lookalike as L

    got = rows(L.look_alike_classes(docs).drop("look", "exact"))
    assert got == [(3, 3, 3, 2), (5, 3, 5, 2), (9, 3, 5, 2)]
    assert L.look_alike_classes(docs.limit(0)).count() == 0
