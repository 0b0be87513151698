from __future__ import annotations

import pytest
from convolith.llm import pairs as P
from convolith.llm import refusals
from convolith.llm.language import language, languages_asked
from hypothesis import given, settings
from hypothesis import strategies as st

ASK = "How can I sort the files without losing the old ones?"


@pytest.mark.parametrize(
    ("prompt", "reply", "expected"),
    [
        (ASK, "", "empty"),
        (ASK, None, "empty"),
        (ASK, " ​\n", "empty"),
        (ASK, "N/A", "empty"),
        (ASK, "<p></p>", "empty"),
        (ASK, "[no response]", "empty"),
        (ASK, "No.", None),
        (ASK, "Only by name", None),
        (ASK, "I'm sorry, but I can't help with that.", "refusal"),
        (ASK, "I’m sorry, I cannot assist with this request. Is there anything else you need?", "refusal"),
        ("Wie geht das denn bitte?", "Leider kann ich diese Frage nicht beantworten.", "refusal"),
        (ASK, "I'm sorry to hear that. Sort them by date first, then move the old ones.", None),
        (ASK, "The server refuses the request, and that is expected. Try it with another port.", None),
        (ASK, ASK, "copied_question"),
        (ASK, "> how can i sort the files  without losing the old ones", "copied_question"),
        (ASK, ASK + "\n" + ASK, "copied_question"),
        (ASK, ASK + " You can sort them by date first, and then move whatever is left to another folder by hand.", None),
        (ASK, "Man sollte zuerst die Dateien nach dem Datum sortieren und dann die alten verschieben.", "other_language"),
        ("Translate this into German: sort the files by date and then move the old ones.", "Man sollte zuerst die Dateien nach dem Datum sortieren und dann die alten verschieben.", None),
        (ASK, "先按日期排序,再移动旧文件。", "other_language"),
        (ASK, "Sort them by date first. After that the old ones can be moved to", "truncated"),
        (ASK, "Use this:\n\n```\nfor x in files:\n    move(x", "truncated"),
        (ASK, "Use this:\n\n```\nmove(x)\n```", None),
        (ASK, "There are three ways:\n- sort by date\n- sort by name\n- split the folder", None),
        (ASK, "There are ways.\n1. sort by date\n2. The old ones could be mov", "truncated"),
    ],
)
def test_defects(prompt, reply, expected):
    assert P.defect(prompt, reply) == expected


def test_very_long_texts():
    long = "Sort the files by date and keep the old ones. " * 5000
    assert P.defect(ASK, long) is None
    assert P.defect(long, long) == "copied_question"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs_against_table(a, b):
    assert P.lcs_length(a, b) == slow_lcs(a, b)


def test_languages():
    assert language("The parser keeps all the old files, and that is fine.") == "en"
    assert language("Weil der Puffer geteilt wird, zählt der Parser die Dateien nicht.") == "de"
    assert language("Потом сервис импорта считает файлы.") == "ru"
    assert language("ok") is None
    assert languages_asked("Please answer in French") == {"fr"}


SCHEMA = "msg_no long, session_id string, seq int, role string, content string, tool_calls array<struct<name: string, arguments: string, id: string>>, prompt string"


def test_pairing(spark):
    call = [("look", "{}", None)]
    data = [
        (1, "s", 1, "user", ASK, None, "x"),
        (2, "s", 2, "model", "", call, "x"),
        (3, "s", 3, "tool", "ok", None, None),
        (4, "s", 4, "assistant", "", None, None),
        (5, "s", 5, "user", ASK, None, None),
        (6, "s", 6, "user", ASK, None, None),
        (7, "s", 7, "thought", "hm", None, None),
        (8, "s", 8, "model", ASK, None, None),
        (9, "s", 9, "model", "", None, None),
        (10, "t", 1, "model", "", None, None),
        (11, None, 1, "user", ASK, None, None),
        (12, None, 2, "model", "", None, None),
        (13, "u", 1, "user", None, None, None),
        (14, "u", 2, "model", None, None, None),
        (15, "u", None, None, "x", None, None),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    expected = {(1, 4, "empty"), (6, 8, "copied_question"), (13, 14, "empty")}
    assert {tuple(r) for r in P.broken_pairs(df).collect()} == expected
    assert {tuple(r) for r in P.broken_pairs(df.limit(0)).collect()} == set()


def test_long_refusals():
    one = "I cannot help with that.\n"
    for reply in (one * 40, one + " " * 2000 + "\n" + one, (one + "Is there anything else you need?\n") * 30):
        assert len(reply) > 600 and P.defect("Name the capital of Peru, please.", reply) == "refusal"
        assert P.defect("Name the capital of Peru, please.", reply + "The capital is called Lima and lies by the sea.") is None
    for text in ("", "a. b! c", "\n\na\n", "。a。b", "x.  \n y"):
        assert list(refusals.sentences(text)) == refusals._SENTENCE.split(text)
