"""Defects of prompt and response pairs, case by case and over a table."""

import pytest

from quern.llm import defects as D

BAD = [
    ("How long is it?", None, "empty"), ("How long is it?", "​ \n", "empty"), ("How long is it?", "N/A", "empty"), ("List the steps.", "[]", "empty"), ("How many rows?", "...", "empty"), ("Why?", "[answer missing]", "empty"),
    ("How do I merge?", "I'm sorry, but I can't help with that.", "refusal"), ("How do I merge?", "As a language model, I have to pass on this request.", "refusal"), ("Wie geht das Zusammenführen?", "Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"),
    ("Comment fusionner deux branches ?", "Je suis désolé, mais je ne peux pas répondre à cette demande.", "refusal"), ("¿Cómo combino dos ramas?", "Lo siento, pero no puedo ayudar con eso.", "refusal"), ("Как объединить две ветки?", "К сожалению, я не вправе отвечать на такой вопрос.", "refusal"),
    ("Which files should stay out of it?", "WHICH FILES SHOULD STAY OUT OF IT", "copy"), ("Which files should stay out of it?", "> Which files should stay out of it?", "copy"), ("Which files should stay out of it?", "And which files should really stay out of it?", "copy"),
    ("How are copies compared?", "The rows are matched by their keys, and every remaining", "truncated"), ("How are copies compared?", "By keys. ```python\nrows = load(", "truncated"), ("How are copies compared?", "The rows are matched … (max length)", "truncated"),
    ("How are copies compared?", '{"rows": 3, "files": ["a.csv",', "truncated"), ("List the steps.", "There are 3 steps:\n1. Check.\n2. Merge.\n3.", "truncated"),
    ("How are copies compared?", "Die Zeilen werden über ihre Schlüssel zugeordnet und dann verglichen.", "language"), ("Wie werden zwei Kopien verglichen?", "The rows are matched by their keys and then compared.", "language"), ("How are copies compared?", "Строки сопоставляются по ключам.", "language"),
]
GOOD = [
    ("Which delimiter does a.csv use?", ","), ("Which sign joins the words?", "-"), ("Which JSON literal stands for a missing cell?", "null"), ("How many rows does it have?", "0"), ("What type has it?", "str"),
    ("What does the tool print when the password is wrong?", "It prints: \"I'm sorry, I can't open this repository.\" and ends with code 2."), ("Write a polite note that turns down a request.", "Thank you. Unfortunately, we are unable to grant access."),
    ("May I rename it?", "You can't rename a branch that is open elsewhere. I cannot stress this enough: ask first."), ("How many rows were rejected?", "Sorry, the earlier figure was wrong; 3 rows were rejected."),
    ("Repeat this line without any change: a holds 3 rows", "a holds 3 rows"), ("Translate into German: The rows are matched by their keys.", "Die Zeilen werden über ihre Schlüssel zugeordnet."),
    ("Quote the unfinished sentence at the end.", 'The last line reads: "and after 4 rows the"'), ("Write a loop.", "n = sum(1 for _ in open('a.csv'))"), ("Write a loop.", "```sh\nwc -l a.csv\n```"), ("List the steps.", "- check a.csv\n- merge b\n- push"),
    ("Which message does it show?", "Sending..."), ("Show a record as JSON.", '[{"a": null, "rows": 3}]'), ("Antworte bitte auf Englisch: Was bedeutet die Kennung root?", "It marks boxes where the object is visible."), ("Is it allowed?", "yes, in every split"),
]


@pytest.mark.parametrize("q,a,want", BAD)
def test_defective(q, a, want):
    assert D.judge(q, a)[:1] == [want]


@pytest.mark.parametrize("q,a", GOOD)
def test_fine(q, a):
    assert D.judge(q, a) == []


def test_table(spark, rows):
    data = [(i, q, a) for i, (q, a, _) in enumerate(BAD)] + [(100 + i, q, a) for i, (q, a) in enumerate(GOOD)] + [(0, *BAD[0][:2]), (500, None, "Fine as it is, thanks."), (501, None, None)]
    df = spark.createDataFrame([(*r, None, "clash") for r in data], "pair_id long, question string, answer string, context string, defects string")
    out = D.pair_defects(df)
    assert rows(out.selectExpr("pair_id", "defects[0]")) == sorted([*((i, w) for i, (_, _, w) in enumerate(BAD)), (501, "empty")], key=repr)
    assert D.pair_defects(df.limit(0)).count() == 0


def test_very_long_answer():
    assert D.judge("How are copies compared?", "By keys. " * 50_000) == []
    assert D.judge("How are copies compared?", "(" * 50_000) != []


def test_context_given_back_with_the_question():
    q, c = "Which files should stay out of it?", "The archive grew by 3 percent."
    assert D.judge(q, f"{c}\n{q}", c) == ["copy"] and D.judge(q, f"{q}\n\n{c}", c) == ["copy"]
    assert D.judge(q, f"{c} Leave out caches and exports.", c) == []


PREAMBLE = "The archive that you ask about has grown a good deal over the last few weeks, with many new folders, " * 6


@pytest.mark.parametrize("q,a,want", [
    ("How do I merge?", PREAMBLE + "and so on. I can't help with that.", ["refusal"]),
    ("How do I merge?", "I'm sorry, but I can't help with that. It is a matter of rules. They are strict. They hold for all. I must decline. No exception is made. Ask elsewhere.", ["refusal"]),
    ("Why did the server refuse the connection?", "I'm sorry, but I can't help with that.", ["refusal"]),
    ("Write a polite note that declines an invitation.", "I'm sorry, but I must decline.", []),
    ("How do I merge?", "Check both branches first. Merge them then. Push the result. Ask the owner if it fails. I can't help with that.", []),
    ("How many rows?", ". " * 100, ["empty"]), ("How many rows?", "-" * 61, ["empty"]),
    ("How do I copy a branch to another place?", "How do I copy a branch to another place?", ["copy"]),
    ("Repeat this line: Copy all files into the folder and push the branch.", "Copy all files into the folder and push the branch.", []),
    ("Repeat this question back to me, please.", "Repeat this question back to me, please.", []),
])
def test_whole_answer_is_judged(q, a, want):
    assert D.judge(q, a) == want


@pytest.mark.parametrize("a", [
    "Das Wort „Haus“ ist ein Nomen.", "He said “hello” and then went home.", "It spans (a, b] on the axis, and [0; 1) as well.", "Er sagte: „Ich komme.“", "Use “a” or „b” as you like.", "See [1] and (2).",
    "There are three steps:\n1. Check it.\n2. Merge it.\n3. Push it.", "The values are 0.5, 1: and more.", "At 10:30 two people meet:\nboth are late.",
])
def test_balanced_answers_are_whole(a):
    assert not D.is_truncated("Explain the word.", a)


@pytest.mark.parametrize("a", [
    "He said “hello and then went home.", "Das Wort „Haus ist ein Nomen.", "It spans (a, b of the axis.", "There are 6 steps:\n1. Check it.\n2. Merge it.", "Es sind vier Schritte:\n- Prüfen.\n- Senden.", "Hay 5 pasos:\n1. Revisar.\n2. Unir.",
])
def test_open_answers_are_truncated(a):
    assert D.is_truncated("Explain the word.", a)


@pytest.mark.parametrize("a", [
    "That's not a topic I discuss.", "You'll have to find this out elsewhere, as I don't provide such information.", "No. Answering this would break my rules. Feel free to ask about something different.",
    "I understand why you ask. Still, this isn't something I will write. Is there anything else you need?", "Darüber spreche ich nicht.", "Je ne discute pas de ce sujet.", "No hablo de ese tema.", "Я не обсуждаю эту тему.",
    "x " * 600 + ". I cannot help with that.", "Thank you for asking.\nI\ncannot   answer this.",
])
def test_more_refusals(a):
    assert D.is_refusal("How many rows are there?", a) or a.startswith("x ")


def test_a_late_refusal_in_a_long_answer_of_refusals_counts():
    a = "I hope you understand. " * 40 + "I cannot help with that request. " * 3
    assert D.is_refusal("How many rows are there?", a)


@pytest.mark.parametrize("core", [p for cores, _ in D._GATES.values() for p in cores])
def test_gates_hold_a_word_of_each_phrase(core):
    # the gate words of a language that a phrase is made of: each alternative of a core names one of them, or it could never be searched for
    lang = next(k for k, (cores, _) in D._GATES.items() if core in cores)
    gate = D._GATES[lang][1].split()
    import re

    assert any(re.search(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])", re.sub(r"\\b|\\s\+|\\w|\(\?:|[()|?+*{}\[\].!^,0-9]", " ", core)) for w in gate), core


def test_long_pairs_are_judged_quickly():
    import random
    import time

    rnd = random.Random(3)
    q = " ".join(f"w{rnd.randrange(5000)}" for _ in range(50_000))
    words = q.split()
    altered = " ".join(w for i, w in enumerate(words) if i % 40)
    other = " ".join(f"w{rnd.randrange(5000)}" for _ in range(50_000))
    began = time.process_time()
    assert D.is_copy(q, altered) and not D.is_copy(q, other)
    assert time.process_time() - began < 2


@pytest.mark.parametrize("seed", range(6))
def test_alignment_is_the_longest_common_subsequence(seed):
    import random

    rnd = random.Random(seed)
    for _ in range(60):
        q = [str(rnd.randrange(9)) for _ in range(rnd.randrange(1, 25))]
        a = [w for w in q if rnd.random() > 0.1] + [str(rnd.randrange(9)) for _ in range(rnd.randrange(3))]
        table = [[0] * (len(a) + 1) for _ in range(len(q) + 1)]
        for i, x in enumerate(q):
            for j, y in enumerate(a):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        want = table[-1][-1]
        alike = 2 * want >= D._ALIKE * (len(q) + len(a))
        assert (2 * D._aligned(q, a) >= D._ALIKE * (len(q) + len(a))) == alike


@pytest.mark.parametrize("q,a,want", [
    ("Was bedeutet die Kennung pod in x.jpg?", "Sie markiert Rahmen, in denen das Objekt zwar sichtbar, aber zu klein ist.", []),
    ("Was bedeutet die Kennung pod in x.jpg?", "It marks boxes where the object is visible but too small to measure.", ["language"]),
    ("How many rows are there?", "n/a" + " " * 200, ["empty"]),
    ("How many rows are there?", "[[[[ " * 30 + "no   answer" + " ]]]]" * 30, ["empty"]),
])
def test_language_and_wide_placeholders(q, a, want):
    assert D.judge(q, a) == want


@pytest.mark.parametrize("n", [900, 1100, 20_000])
def test_copies_are_judged_alike_at_any_length(n):
    # every eighth word exchanged: seven of eight stay in order
    q = [f"w{i * 7919 % 100_003}" for i in range(n)]
    a = [f"x{i}" if i % 8 == 3 else w for i, w in enumerate(q)]
    assert D._aligned(q, a) == n - sum(i % 8 == 3 for i in range(n))
    every_fourth = [f"x{i}" if i % 4 == 3 else w for i, w in enumerate(q)]
    assert D._gives_back(q, a) and not D._gives_back(q, every_fourth)
    assert not D._gives_back(q, q[n // 2 :] + q[: n // 2])
    # short runs in common, yet nine words of eleven in order
    assert D._gives_back(q, [f"x{i}" if i % 11 in (0, 5) else w for i, w in enumerate(q)])
    # each word kept, but pairs of neighbours exchanged: half of every pair stays in order
    assert D._aligned(q, [w for i in range(0, n, 2) for w in (q[i + 1], q[i])]) < 0.8 * n


def test_blocks_of_the_alignment_join(monkeypatch):
    q, a = list("abcabba" * 9), list("cbabac" * 11)
    whole = D._aligned(q, a)
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(D, "_BLOCK", block)
        assert D._aligned(q, a) == whole
