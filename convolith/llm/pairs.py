"""Broken prompt and response pairs.

Pairs are formed by the order of messages in their session; each is then aligned, token by token: the
reply against its prompt (shingle containment and longest common subsequence) to find copies, and
each of its sentences against refusal frames to find refusals.  Empty, truncated and wrong-language
replies are told by what is visible, by how the text ends and by the languages of both sides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolith.llm.language import language, languages_asked
from convolith.llm.personal import Gazetteer, candidates
from convolith.llm.refusals import is_refusal, lcs_length, may_refuse, sentences, tokens
from convolith.operators.ordering import next_row

REPLY_ROLES = ("model", "assistant")
SHINGLE = 3
COPIED = 0.8  # least containment of the reply's shingles, and least share of the prompt in the common subsequence

#: Replies that say nothing, without punctuation, white space and letter case.
FILLERS = frozenset("null none nil na nan undefined void empty blank noresponse noanswer nooutput nocontent nodata noreply nothing tbd todo tba placeholder missing keineantwort leer nichts keine sansréponse aucuneréponse vide rien sinrespuesta vacío vacio nada нетответа пусто ничего 无 空 没有回答 无回答 暂无 暂无回答 notapplicable emptyresponse emptymessage emptyreply noresponsegenerated responsemissing deleted removed inserttexthere xxx".split())

_INVISIBLE = re.compile(r"[\s​-‏⁠-⁤﻿­͏ ‪-‮⠀ㅤ]+")
_SAYS_MORE = re.compile(rf"(?:[\W_]*[^\W_]){{{1 + max(map(len, FILLERS))}}}")  # more letters and digits than any filler has
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&nbsp;|&#160;")
_FINISHED = re.compile(r"[.!?…。！？．‼⁇⁉؟।][\s\"'”’»)\]}*_`~>|]*$|[`\]})»”\">|]$|[\U0001F300-\U0001FAFF☺-➿]$")
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)]|[a-z][.)])\s+(.*)$")
_MARKER = re.compile(r"[-*•+]|\d{1,3}[.)]|[a-z][.)]")
#: A line that names a thing and gives it: a field of a form or a letter head.
_FIELD = re.compile(r"^\W*[^\W\d][\w ]{1,24}\.?\s?:\s?\S.{0,90}$")
_NOBODY = Gazetteer([])
#: Small words no finished text ends with.
_OPEN_WORDS = frozenset("the a an and or but of to in on at by for from with that which as than if when while because is are was were be not no its their der die das und oder zu mit auf für von dass bevor weil le la les de du des et ou que qui un une dans pour avec el los las y o del al por con para и или но что чем когда если в на с к по за не".split())


def containment(part: list[str], whole: list[str], n: int = SHINGLE) -> float:
    """Share of the shingles of ``part`` that occur in ``whole``."""
    n = min(n, len(part))
    if not n:
        return 0.0
    have = {tuple(whole[i : i + n]) for i in range(len(whole) - n + 1)}
    own = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(s in have for s in own) / len(own)


def _is_copy(prompt: list[str], reply: list[str]) -> bool:
    known = set(prompt)
    if not prompt or not reply or sum(t in known for t in reply) < 0.5 * (len(reply) - SHINGLE + 1):
        return False  # too few words for half of the shingles
    inside = containment(reply, prompt)
    if inside < 0.5:
        return False
    common = lcs_length(prompt, reply)
    if common >= 0.95 * len(reply) and common >= 0.7 * len(prompt):  # nothing added, few words lost
        return True
    if common < COPIED * len(prompt):
        return False
    if len(reply) > 1.5 * len(prompt):  # repeated more than once: every shingle must still be the prompt's
        return inside >= COPIED
    return inside >= COPIED or common >= COPIED * len(reply)


def _contact(sentence: str) -> bool:
    """The sentence gives contact details or speaks of a person, and so answers nothing."""
    found = candidates(sentence, _NOBODY)
    return any(kind != "name" or form == 1 for kind, _, _, _, _, form, *_ in found)


def _is_empty(reply: str) -> bool:
    text = _MARKUP.sub("", reply) if "<" in reply or "&" in reply else reply
    if _SAYS_MORE.match(text):
        return False
    text = _INVISIBLE.sub("", text)
    bare = "".join(c for c in text if unicodedata.category(c)[0] in "LN").lower()
    return not bare and not any(unicodedata.category(c) == "So" for c in text) or bare in FILLERS


def _is_truncated(reply: str) -> bool:
    text = _INVISIBLE.sub(" ", reply).strip() if "\n" not in reply else reply.strip().strip("​﻿ ")
    if text.count("```") % 2:
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    while len(lines) > 1 and not _FINISHED.search(lines[-1].strip()) and (_FIELD.match(lines[-1].strip()) or _contact(lines[-1])):
        lines.pop()
    if not lines:
        return False
    last = lines[-1].strip()
    if len(lines) > 1 and _MARKER.fullmatch(last):  # a list that stops at the mark of its next item
        return True
    if _FINISHED.search(last):
        return False
    item = _ITEM.match(last)
    if item:
        body = item[1]
        words = tokens(body)
        if not words or words[-1] in _OPEN_WORDS or last[-1] in ",:-–—":
            return True
        others = [m[1] for x in lines[:-1] if (m := _ITEM.match(x))]
        sentence_like = body[:1].isupper()
        alike = [o for o in others if o[:1].isupper() == sentence_like and not _FINISHED.search(o.strip())]
        if others and not alike:
            return True
        # an item that stops inside what an earlier one says
        if any(len(o.strip()) > len(body) and o.strip().startswith(body) for o in others):
            return True
        return sentence_like and not alike and len(words) > 3
    if last[-1] in ",:-–—(":
        return True
    words = tokens(text)
    if not words:
        return False
    if words[-1] in _OPEN_WORDS:
        return True
    if len(words) <= 4 and not re.search(r"[㐀-鿿]", text):
        return False
    parts = [s for s in sentences("\n".join(lines)) if s.strip()]
    tail, rest = parts[-1].strip(), parts[:-1]
    if not rest:
        return not (_FIELD.match(last) or _contact(last))
    return not (len(tokens(tail)) <= 4 and tail[:1].isupper() and all(map(_contact, rest)))


def _is_other_language(prompt: str, reply: str) -> bool:
    b = language(reply)
    if b is None:
        return False
    a = language(prompt) or language(next((s for s in sentences(prompt) if s.strip()), ""))
    return a is not None and a != b and b not in languages_asked(prompt)


def defect(prompt: str | None, reply: str | None) -> str | None:
    """The defect of a reply, or None.  A null text counts as empty."""
    reply = unicodedata.normalize("NFC", reply or "")
    prompt = unicodedata.normalize("NFC", prompt or "")
    if _is_empty(reply):
        return "empty"
    words = tokens(reply)
    if _is_copy(tokens(prompt), words):
        return "copied_question"
    if may_refuse(words) and is_refusal(prompt, reply, _contact):
        return "refusal"
    if _is_other_language(prompt, reply):
        return "other_language"
    if _is_truncated(reply):
        return "truncated"
    return None


def reply_pairs(messages: DataFrame, session: str = "session_id", order: str = "seq", row_no: str = "msg_no", role: str = "role", content: str = "content", calls: str = "tool_calls") -> DataFrame:
    """prompt_no, reply_no, prompt, reply for each user row and the row that answers it.

    Of the rows that matter - user rows, and replies without tool calls - a pair is a user row whose
    next one is a reply.  Only numbers pass through the ordering; texts are joined afterwards.
    """
    reply = F.col(role).isin(*REPLY_ROLES) & F.col(calls).isNull()
    marks = messages.where((F.col(role) == "user") | reply).where(F.col(session).isNotNull() & F.col(order).isNotNull())
    marks = marks.select(F.col(session).alias("s"), F.col(order).cast("long").alias("o"), F.col(row_no).alias("n"), (F.col(role) == "user").alias("asks"))
    linked = next_row(marks, "s", "o", ["n", "asks"]).where("asks and next_asks = false").select(F.col("n").alias("prompt_no"), F.col("next_n").alias("reply_no"))
    texts = messages.select(F.col(row_no).alias("no"), F.col(content).alias("text"))
    out = linked.join(texts.select(F.col("no").alias("prompt_no"), F.col("text").alias("prompt")), "prompt_no")
    return out.join(texts.select(F.col("no").alias("reply_no"), F.col("text").alias("reply")), "reply_no").select("prompt_no", "reply_no", "prompt", "reply")


def broken_pairs(messages: DataFrame, **columns: str) -> DataFrame:
    """prompt_no, reply_no, defect for each defective pair.

    Defined cases: rows with a null session, order or role pair with nothing; a null reply is empty; a
    null or blank prompt can be neither copied nor in a language; two rows of one place in a session are
    ordered by their number; repeated rows give repeated marks but one result row; an empty table gives
    an empty result; texts of any length are aligned whole; extra columns are ignored.
    """
    pairs = reply_pairs(messages, **columns)
    kind = pairs.schema["prompt_no"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            found = [defect(p, r) for p, r in zip(pdf["prompt"], pdf["reply"], strict=True)]
            out = pd.DataFrame({"prompt_no": pdf["prompt_no"], "reply_no": pdf["reply_no"], "defect": found})
            yield out[out["defect"].notna()]

    return pairs.mapInPandas(run, f"prompt_no {kind}, reply_no {kind}, defect string").distinct()
