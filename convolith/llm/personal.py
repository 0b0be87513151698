"""Personal information inside free text, by aggregated weak supervision.

Candidate spans are proposed by patterns and by a gazetteer of name parts.  Labelers of three kinds -
patterns, gazetteer, context - vote yes, no or nothing on each candidate.  The context labelers are not
listed but learnt: the words on either side of a span get the odds that spans there are mentions, first
from candidates whose form alone is telling, then again from the posteriors.  Expectation-maximisation
over the counts of vote patterns (all data, a bounded number of patterns) estimates how reliable each
labeler is for each type and how likely each pattern is a mention.  On those soft labels a logistic
span classifier over votes and pairs of votes is trained; it decides, and overlaps go to the better
span.  Names beyond the gazetteer are helped by a word's company: parts seen beside a known name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolith.llm.language import SMALL_WORDS
from convolith.shared import materialise

TYPES = ("email", "phone", "identity_number", "street_address", "name")
VOTES = ("v_form", "v_check", "v_known", "v_label", "v_left", "v_right", "v_words", "v_company")
SUPPORT = 3  # least spans a context must stand beside to vote
TELLING = 1.0  # least log-odds, for or against, of a context that votes
ROUNDS = 2  # of learning contexts
ANCHOR = 0.01  # of all spans, those taken for settled on either side
PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}
NAME_PARTS_BYTES = 64 << 20  # most bytes of gazetteer that are broadcast
USED_BYTES = 8 << 20  # most bytes of the words of candidate names that are broadcast to the word count
ORDINARY_LEAST = 3  # lower-case uses that make a word ordinary

_L = r"[^\W\d_]"
_EMAIL = re.compile(r"(?<![\w.+%-])[\w][\w.+%'-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[A-Za-z]{2,24}(?![\w-])")
_AT = r"(?:\s*[(\[{<]\s*(?:at|arroba|arobase|ät)\s*[)\]}>]\s*|\s+(?:at|arroba|arobase)\s+)"
_DOT = r"(?:\s*[(\[{<]\s*(?:dot|punto|point|punkt)\s*[)\]}>]\s*|\s+(?:dot|punto|point|punkt)\s+|\.(?=\w))"
_SPELLED = re.compile(rf"(?<![\w.+%@-])\w(?:[\w.+%-]|{_DOT}(?=[\w.+%-]*\s*[(\[{{<]?\s*(?:at|dot)\b))*?(?P<at>{_AT})[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_PHONES = (
    (1, re.compile(r"\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ ./-]?\d{1,5}){1,7}")),
    (1, re.compile(r"(?<!\d)00[1-9]\d(?:[ ./-]?\(\d{1,4}\))?(?:[ ./-]?\d{2,7}){1,5}")),
    (1, re.compile(r"\(\+?\d{2,5}\)[ .-]?\d{3,5}(?:[ .-]\d{2,5}){0,3}")),
    (1, re.compile(r"(?<!\d)(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}")),
    (0, re.compile(r"(?<!\d)0\d{1,5}[ /-]\d{3,8}(?:[ -]\d{1,5}){0,3}")),
    (1, re.compile(r"(?<!\d)0\d(?:[ .]\d{2}){4}")),
    (0, re.compile(r"(?<!\d)0\d{9,10}")),
    (0, re.compile(r"(?<!\d)[6-9]\d{2} \d{3} \d{3}")),
    (0, re.compile(r"(?<!\d)\d{3}[ -]\d{4}")),
    (0, re.compile(r"(?<!\d)\d{10,11}")),
    (-1, re.compile(r"(?<!\d)\d(?:[ .-]?\d){6,14}(?!\d)")),
)
_IDS = (
    (1, re.compile(r"\d{3}-\d{2}-\d{4}")),
    (0, re.compile(r"\d{3} \d{2} \d{4}")),
    (1, re.compile(r"[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-Z]")),
    (1, re.compile(r"[A-Z]-?\d{7}-?[A-Z]")),
    (1, re.compile(r"\d{8}[ -]?[A-Z]")),
    (1, re.compile(r"\d{6}[-+]\d{4}")),
    (1, re.compile(r"\d{2} \d{3} \d{3} \d{3}")),
    (0, re.compile(r"[A-Z]{1,2}\d{6,9}")),
    (0, re.compile(r"\d{3} \d{3} \d{3}")),
    (0, re.compile(r"\d{9}|\d{11}")),
    (-1, re.compile(r"(?<!\d)\d(?:[ .-]?\d){6,14}(?!\d)")),
)
_STREETS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Terrace|Crescent|Row|Wharf|Boulevard|Blvd|Close|Court|Ct|Place|Square|Sq|Way|Walk|Hill|Gardens|Mews|Quay|Parade|Grove|Highway|Parkway|Alley|Yard|Green|Rise|Path|Circus|Embankment"
_UNIT = r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Room|Floor|Wohnung|Appartement|Piso)\s+\w{1,5},?\s+)?"
_PLACE = rf"(?:,\s*(?:\d{{4,6}}\s+)?[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+)?(?:\s+\d{{4,6}}\b)?)?"
_ADDRESSES = (
    re.compile(rf"{_UNIT}(?<![\w.-])\d{{1,5}}[A-Za-z]?\s+(?:[A-ZÀ-Þ][\w'’-]+\s+){{1,4}}(?:{_STREETS})\b\.?{_PLACE}"),
    re.compile(rf"{_UNIT}(?<![\w.-])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Qq]uai|[Ii]mpasse|[Aa]llée|[Cc]ours|[Rr]oute)\s+(?:(?:de la|de l['’]|des|de|du|d['’]|la|le|les)\s*)*[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+)*{_PLACE}"),
    re.compile(rf"{_UNIT}(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino|[Vv]ia|[Vv]iale|[Pp]iazza|[Rr]ua|[Aa]vda\.?|C/)\s+(?:(?:de la|de los|de las|del|de|la|el|los|las)\s+)*[A-ZÀ-Þ][\w'’-]+(?:\s[A-ZÀ-Þ][\w'’-]+)*,?\s+(?:n\.?º\s*)?\d{{1,4}}(?![\w-]){_PLACE}"),
    re.compile(rf"{_UNIT}(?<!\w)(?:(?!Der |Die |Das |In |An |Im )[A-ZÄÖÜ][\wäöüß-]*\s+){{0,2}}(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig|pfad|hof|markt|chaussee|graben|twiete|stieg)|(?<=\s)(?:Straße|Ring|Weg|Platz|Allee|Gasse|Damm|Ufer|Steig|Pfad|Markt|Hof|Graben)|(?:Straße|Ring|Weg|Platz|Allee|Gasse|Damm|Ufer))\s+\d{{1,4}}\s?[a-z]?(?![\w-]){_PLACE}"),
)
#: Words that name a kind of detail; the same in any text, as labels of a form are.
LABELS = {
    "email": frozenset("email e-mail mail mailto courriel correo e-mail-adresse".split()),
    "phone": frozenset("phone telephone tel telefon telefonnummer teléfono téléphone telefono mobile cell handy fax call ring dial sms whatsapp".split()),
    "identity_number": frozenset("passport passeport pasaporte reisepass ssn nino security insurance identity identité identidad id dni nie cpf tax steuernummer ausweisnummer sozialversicherungsnummer licence license".split()),
    "street_address": frozenset("address adresse anschrift dirección indirizzo street".split()),
    "name": frozenset("name named nom nombre nome mr mrs ms dr prof herr frau monsieur madame señor señora dear sincerely signed".split()),
}
_RIVAL = {"phone": "identity_number", "identity_number": "phone"}
#: A number is an amount before these, and part of something longer before more letters, digits or a sign.
_AMOUNT = re.compile(r"^(?:\s*(?:bytes?|[kmgt]i?b|ms|s|sec(?:ond)?s?|min(?:ute)?s?|hours?|days?|rows?|lines?|files?|records?|items?|tokens?|users?|events?|percent|eur|usd)\b|[-:/.]?\w|\s*%)", re.I)

_SMALL = frozenset(w for words in SMALL_WORDS.values() for w in words.split()) | frozenset("about after again all also any ask atentamente best bitte call called can cc cordialement dear did do does first found from get give gruß grüße had has have hello her here his how its just keep last let like look made make many may me mein meine mi mon more my name need new next no notes now off on one only our out over own please regards said saludos see send set she should since some still summarise take tell than thanks they too took try two under until up us use used very via viele was way were what where which while who will without would write yes your".split())
_PARTICLES = frozenset("van von de der den del della di da la le ter ten bin ibn al el zu zur dos das du des vom af av".split())
_WORD = re.compile(rf"{_L}+(?:['’-]{_L}+)*")
_BESIDE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|\n|[^\w\s]")
_RUN = re.compile(r"\d(?:[ ().\-/]{0,3}\d){5}")
_CAPITALS = re.compile(r"(?<![^\W_])[^\W\d_a-zß-öø-ÿа-яё][\w.'’-]*,?[ \t\u00a0]+(?:[a-z]{1,3}[ \t\u00a0]+){0,3}[^\W\d_a-zß-öø-ÿа-яё]")
_HOUSE = re.compile(r"\d[A-Za-z]?(?:\s?(?:bis|ter))?,?\s+[A-ZÀ-Þracpbqi]|[a-zß.)]\s+(?:n\.?º\s*)?\d|[A-ZÀ-Þ]\w*,?\s+\d")
_AT_WORD = re.compile(r"\b(?:at|arroba|arobase|ät)\b")
_DETERMINER = re.compile(r"(?:^|\W)(?:the|a|an|this|that|der|die|das|den|dem|ein|eine|le|la|les|un|une|el|los|las|una|our|your|their)\s+$", re.I)


def _plain(name: str) -> str:
    return name.lower().replace("’", "'")


class Gazetteer:
    """Known given and family names, families also without their particles."""

    def __init__(self, parts: list[tuple[str, str]]) -> None:
        self.given = frozenset(_plain(t.strip()) for t, k in parts if k == "given")
        family = {_plain(t.strip()) for t, k in parts if k == "family"}
        self.family = frozenset(family | {f.split()[-1] for f in family})
        self.all = self.given | self.family


def _shape(word: str) -> str:
    if len(word) == 1:
        return "I" if word.isupper() else "l"
    bare = [p for p in re.split(r"['’-]", word) if p]
    if word.isupper():
        return "U"
    if word.islower():
        return "l"
    return "T" if bare[-1][:1].isupper() and bare[0][:1].isupper() or word[:1].isupper() else "m"


def _case(given: str, initial: bool, family: str) -> int:
    """1 if both words are written alike as names, -1 if one is and the other isn't, 0 if neither."""
    f, g = _shape(family), _shape(given)
    if initial:
        return 1 if f in "TU" and g == "I" else 0 if f == "l" and g == "l" else -1
    if f == g:
        return 1 if f in "TU" else 0
    return -1


def _name_candidates(text: str, gaz: Gazetteer) -> Iterator[tuple]:
    """(start, end, given, family, initial, case, given known, family known) of what may be a name.

    Either a part is known, or both are written as names, or a label of names stands before.
    """
    words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    for i, (a, b, w) in enumerate(words):
        low = _plain(w)
        initial = len(w) == 1
        if a and (text[a - 1].isalnum() or text[a - 1] in "_@"):
            continue
        # given name or initial, further initials, particles, family name
        j, end, ok = i + 1, b, True
        if initial and text[b : b + 1] == ".":
            end = b + 1
        elif initial:
            ok = False
        if low in _SMALL and low not in gaz.given:
            ok = False
        particles = 0
        while ok and j < len(words):
            s, e, x = words[j]
            gap = text[end:s]
            if not gap or gap.strip(" \t  ") or len(gap) > 3:
                ok = False
                break
            if len(x) == 1 and text[e : e + 1] == "." and j < i + 4:
                end, j = e + 1, j + 1
                continue
            if _plain(x) in _PARTICLES and particles < 3 and j + 1 < len(words):
                end, j, particles = e, j + 1, particles + 1
                continue
            break
        if ok and j < len(words):
            s, e, x = words[j]
            family = _plain(x)
            if len(x) > 1 and (family not in _SMALL or family in gaz.family):
                case = _case(w, initial, x)
                known = (low in gaz.given) + (family in gaz.family)
                if known or case == 1 or case == 0 and _label("name", text, a, e, 2) == 1:
                    yield a, e, w, x, initial, case, low in gaz.given, family in gaz.family
        # family name, comma, given name
        if not initial and low not in _SMALL and i + 1 < len(words) and re.fullmatch(r",[ \t ]{1,2}", text[b : words[i + 1][0]]):
            s, e, x = words[i + 1]
            single = len(x) == 1 and text[e : e + 1] == "."
            follows = words[i + 2] if i + 2 < len(words) else (0, 0, "")
            # of three capitals after each other the last two are the name, what stands before is said to them
            signed = follows[0] == e + 1 and _shape(follows[2]) in "TU" and text[e : e + 1] == " " and low not in gaz.family
            if (len(x) > 1 or single) and not signed:
                given, family = _plain(x), low
                known = (given in gaz.given) + (family in gaz.family)
                start = a
                k = i - 1
                while k >= 0 and _plain(words[k][2]) in _PARTICLES and text[words[k][1] : start].strip() == "" and text[words[k][1] : start]:
                    start, k = words[k][0], k - 1
                case = _case(x, single, w)
                if (given not in _SMALL or given in gaz.given) and (known and (family in gaz.family or _shape(w) != "l" or single) or case == 1):
                    yield start, e + single, x, w, single, case, given in gaz.given, family in gaz.family


def _beside(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """The last three, two and one tokens before a span, and the first three, two and one after it."""
    tell = lambda x: "0" if x.isdigit() else x.lower().replace("’", "'")
    left = ["^", "^", "^", *map(tell, _BESIDE.findall(text[max(0, a - 64) : a]))]
    right = [*map(tell, _BESIDE.findall(text[b : b + 64])), "$", "$", "$"]
    return [" ".join(left[-n:]) for n in (3, 2, 1)], [" ".join(right[:n]) for n in (3, 2, 1)]


def _label(kind: str, text: str, a: int, b: int, reach: int = 4) -> int:
    """Whether a word near before the span says what it is, or that it is something else."""
    near = _BESIDE.findall(text[max(0, a - 40) : a].lower())[-reach:]
    if not LABELS[kind].isdisjoint(near):
        return 1
    if kind == "name":
        return -1 if _DETERMINER.search(text[max(0, a - 12) : a]) else 0
    if kind in _RIVAL and (not LABELS[_RIVAL[kind]].isdisjoint(near) or _AMOUNT.search(text[b : b + 24])):
        return -1
    return 0


def candidates(text: str, gaz: Gazetteer) -> list[tuple]:
    """(type, start, end, given, family, form, check, known, label) of all spans worth a vote."""
    out: list[tuple] = []

    def add(kind: str, a: int, b: int, form: int, check: int, known: int) -> None:
        out.append((kind, a, b, None, None, form, check, known, _label(kind, text, a, b)))

    low = text.lower()
    if "@" in text:
        for m in _EMAIL.finditer(text):
            local = re.split(r"[._+-]", m[0].split("@")[0].lower())
            add("email", *m.span(), 1, 0 if m[0].count("@") == 1 else -1, int(not gaz.all.isdisjoint(local)))
    if _AT_WORD.search(low):
        for m in _SPELLED.finditer(text):
            if not re.search(r"[(\[{<]", m["at"]) and not re.search(r"\bdot\b|\bpunto\b|\bpoint\b|\bpunkt\b", m[0], re.I):
                continue
            local = re.split(r"[._+\s-]", m[0][: m.start("at") - m.start()].lower())
            add("email", *m.span(), 1, 1, int(not gaz.all.isdisjoint(local)))
    if _RUN.search(text):
        for form, pattern in _PHONES:
            for m in pattern.finditer(text):
                a, b = m.span()
                n = sum(map(str.isdigit, m[0]))
                if text[b : b + 1].isalnum() or text[b : b + 2][1:2].isdigit() and text[b] in "-/" or a and (text[a - 1].isalnum() or text[a - 1] in "#_@+" or text[a - 1] in ".-/" and a > 1 and text[a - 2].isalnum()):
                    continue
                if not 7 <= n <= 15 or form <= 0 and text[b : b + 1] in (" ", "-", "/") and text[b + 1 : b + 2].isdigit():
                    continue
                add("phone", a, b, form, 1 if m[0][0] in "+(" else 0, 0)
        for form, pattern in _IDS:
            for m in pattern.finditer(text):
                a, b = m.span()
                if text[b : b + 1].isalnum() or text[b : b + 1] in ("-", "_") and text[b + 1 : b + 2].isalnum() or a and (text[a - 1].isalnum() or text[a - 1] in "-_+.#/@" or text[a - 1] == " " and text[a - 2 : a - 1].isdigit()):
                    continue
                if text[b : b + 1] == " " and text[b + 1 : b + 2].isdigit():
                    continue
                add("identity_number", a, b, form, 1 if any(map(str.isalpha, m[0])) else 0, 0)
    if _HOUSE.search(text):
        for pattern in _ADDRESSES:
            for m in pattern.finditer(text):
                add("street_address", *m.span(), 1, 1 if "," in m[0] else 0, 0)
    if _CAPITALS.search(text) or not gaz.all.isdisjoint(_WORD.findall(low.replace("’", "'"))):
        out += map(partial(_as_name, text), _name_candidates(text, gaz))
    return out


def _as_name(text: str, found: tuple) -> tuple:
    a, b, given, family, initial, case, known_given, known_family = found
    return ("name", a, b, _plain(given), _plain(family), case, 0 if initial else 1, int(known_given) + int(known_family), _label("name", text, a, b))


def reliabilities(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None, rounds: int = 40) -> tuple[np.ndarray, list[np.ndarray]]:
    """Posterior of each vote pattern and, for each labeler, P(vote | no) and P(vote | yes), by EM.

    ``patterns`` holds votes shifted to 0..K.  It starts from ``start``, or else from the votes' sum.
    """
    post = 1 / (1 + np.exp(-1.0 * (patterns - 1).sum(axis=1))) if start is None else start.copy()
    values, k = int(patterns.max()) + 1, patterns.shape[1]
    # what all labelers agree on is settled: a share of such spans keeps EM from splitting one class in two
    weight = max(1.0, ANCHOR * float(counts.sum()))
    rows = np.concatenate([patterns, np.zeros((1, k), int), np.full((1, k), values - 1)])
    mass = np.concatenate([counts, [weight, weight]])
    tables: list[np.ndarray] = []
    for _ in range(rounds):
        full = np.concatenate([post, [0.0, 1.0]])
        prior = float(np.clip((full * mass).sum() / mass.sum(), 0.01, 0.99))
        tables = []
        logit = np.full(len(post), np.log(prior / (1 - prior)))
        for j in range(k):
            # smoothed by how votes fall overall, so that a labeler that always says the same says nothing
            overall = np.bincount(rows[:, j], weights=mass + 1, minlength=values)
            overall = (overall + 1e-9) / overall.sum()
            yes = np.bincount(rows[:, j], weights=full * mass, minlength=values) + overall
            no = np.bincount(rows[:, j], weights=(1 - full) * mass, minlength=values) + overall
            t = np.stack([no / no.sum(), yes / yes.sum()])
            tables.append(t)
            logit += np.log(t[1, patterns[:, j]] / t[0, patterns[:, j]])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, tables


def _design(patterns: np.ndarray, values: int) -> np.ndarray:
    one = np.concatenate([np.eye(values)[patterns[:, j]] for j in range(patterns.shape[1])], axis=1)
    votes = patterns - 1.0
    pairs = [votes[:, i] * votes[:, j] for i in range(votes.shape[1]) for j in range(i)]
    return np.concatenate([np.ones((len(votes), 1)), one, np.stack(pairs, axis=1)], axis=1)


def span_classifier(patterns: np.ndarray, counts: np.ndarray, soft: np.ndarray, penalty: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Score of each pattern by a logistic classifier trained on soft labels (Newton steps, ridge)."""
    x = _design(patterns, int(patterns.max()) + 1)
    w = np.zeros(x.shape[1])
    weight = np.minimum(counts, 1e6)
    weight = np.sqrt(weight)  # no single pattern drowns the rest
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (soft - p)) - penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


@lru_cache(maxsize=1)
def _greedy():
    @F.pandas_udf("array<struct<type: string, start: int, end: int, score: double>>")
    def choose(spans: pd.Series) -> pd.Series:
        """Spans of one text that do not overlap: names last, then the better, the longer, the earlier first."""
        out = []
        for row in spans:
            taken: list[dict] = []
            rank = sorted(row, key=lambda s: (s["type"] == "name", -round(s["score"], 1), -(s["end"] - s["start"]), s["start"], TYPES.index(s["type"])))
            starts: list[tuple[int, int]] = []
            for s in rank:
                if all(s["end"] <= a or b <= s["start"] for a, b in starts):
                    starts.append((s["start"], s["end"]))
                    taken.append({"type": s["type"], "start": s["start"], "end": s["end"], "score": s["score"]})
            out.append(sorted(taken, key=lambda s: s["start"]))
        return pd.Series(out)

    return choose


_SEED = """case pii_type when 'email' then 0.9 when 'street_address' then 0.9
  when 'name' then case when v_form = -1 then 0.05 when v_known = 2 then 0.95 when v_known = 1 then 0.5 + 0.2 * v_form else 0.05 + 0.15 * v_form + 0.3 * greatest(v_label, 0) end
  else (case v_form when 1 then 0.6 + 0.3 * v_check when 0 then 0.1 + 0.1 * v_check else 0.03 end) * case v_label when -1 then 0.3 else 1 end
    + case when v_label = 1 and v_form < 1 then 0.3 else 0 end end"""
#: How much a vote adds to the log-odds a pattern starts from.
_START = {"v_label": 1.5, "v_left": 1.5, "v_right": 1.5, "v_words": 0.5, "v_company": 0.75}


def _known_parts(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """``texts`` with given and family, the known parts among the words of each text, by a join."""
    pieces = F.split(F.lower(F.regexp_replace("text", "’", "'")), r"[^\p{L}\p{M}'-]+")
    words = F.array_distinct(F.concat(pieces, F.split(F.array_join(pieces, "-"), "-")))
    keyed = parts.select(F.element_at(F.split(F.lower(F.regexp_replace(F.trim("t"), "’", "'")), r"\s+"), -1).alias("w"), "k").where("w <> ''").distinct()
    marked = texts.select("place", "row_no", F.explode(words).alias("w")).distinct().join(keyed, "w")
    known = marked.groupBy("place", "row_no").agg(*[F.collect_set(F.when(F.col("k") == k, F.col("w"))).alias(k) for k in ("given", "family")])
    return texts.join(known, ["place", "row_no"], "left")


def _proposed(rows: DataFrame, gazetteer) -> DataFrame:
    """The candidates of each text; the gazetteer is broadcast, or else in columns of the rows."""
    columns = ["pii_type", "start", "end", "given", "family", "v_form", "v_check", "v_known", "v_label"]
    row_type = rows.schema["row_no"].dataType.simpleString()

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            each = None if gazetteer is not None else zip(pdf["given"], pdf["family"], strict=True)
            for p, n, t in zip(pdf["place"], pdf["row_no"], pdf["text"], strict=True):
                if each is None:
                    gaz = gazetteer.value
                else:
                    given, family = next(each)
                    gaz = Gazetteer([(x, "given") for x in (given if given is not None else ())] + [(x, "family") for x in (family if family is not None else ())])
                found += [(p, n, *c, *_beside(t, c[1], c[2])) for c in candidates(t, gaz)]
            yield pd.DataFrame(found, columns=["place", "row_no", *columns, "left", "right"])

    schema = f"place string, row_no {row_type}, pii_type string, start int, end int, given string, family string, v_form int, v_check int, v_known int, v_label int, left array<string>, right array<string>"
    return rows.mapInPandas(propose, schema)


_ID = ["place", "row_no", "pii_type", "start", "end"]


def _contexts(weighed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_ID, side, rank, key) of all spans, and (pii_type, side, key, n, odds) of each context seen often enough."""
    flat = [F.posexplode(F.col(side)).alias("rank", "key") for side in ("left", "right")]
    keys = weighed.select(*_ID, "p", F.lit("left").alias("side"), flat[0]).unionByName(weighed.select(*_ID, "p", F.lit("right").alias("side"), flat[1]))
    base = weighed.groupBy("pii_type").agg(F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.avg("p"))).alias("base"))
    told = keys.groupBy("pii_type", "side", "key").agg(F.sum("p").alias("yes"), F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    b = F.col("base")
    odds = F.log((F.col("yes") + b) / (F.col("n") - F.col("yes") + 1 - b)) - F.least(F.lit(0.0), F.log(b / (1 - b)))  # against the rate of the type, or even odds where most are mentions
    return keys, told.join(F.broadcast(base), "pii_type").select("pii_type", "side", "key", "n", odds.alias("odds"))  # five rows


def _voted(spans: DataFrame, weighed: DataFrame) -> DataFrame:
    """``spans`` with v_left and v_right, the votes of the longest context known on either side."""
    keys, told = _contexts(weighed)
    vote = F.when(F.col("odds") > TELLING, 1).when(F.col("odds") < -TELLING, -1).otherwise(0)
    best = keys.drop("p").join(told.select("pii_type", "side", "key", vote.alias("vote")), ["pii_type", "side", "key"]).groupBy(*_ID).agg(*[F.min_by("vote", F.when(F.col("side") == side, F.col("rank"))).alias(f"v_{side}") for side in ("left", "right")])
    return spans.join(best, _ID, "left").na.fill(0, ["v_left", "v_right"])


def _scores(voted: DataFrame) -> pd.DataFrame | None:
    """Each pattern of votes with its posterior and the classifier's score: at most 4 ** 8 of a type."""
    counted = voted.withColumn("seed", F.expr(_SEED)).groupBy("pii_type", *VOTES, "seed").count().orderBy("pii_type", *VOTES).toPandas()
    scored = []
    for _, group in counted.groupby("pii_type"):
        patterns = group[list(VOTES)].to_numpy(int) + 1
        counts = group["count"].to_numpy(float)
        seed = group["seed"].to_numpy(float)
        lift = sum(w * group[v].to_numpy(float) for v, w in _START.items())
        soft, _ = reliabilities(patterns, counts, 1 / (1 + np.exp(-(np.log(seed / (1 - seed)) + lift))))
        scored.append(group.assign(em=soft, score=span_classifier(patterns, counts, soft)))
    return pd.concat(scored)[["pii_type", *VOTES, "em", "score"]] if scored else None


def mentions(texts: DataFrame, name_parts: DataFrame, name: str = "name_text", kind: str = "name_kind", broadcast_bytes: int = NAME_PARTS_BYTES) -> DataFrame:
    """place, row_no, pii_type, start_at (1-based code points), end_at, score for each mention.

    ``texts`` has place, row_no, text; name parts that are null are left out.

    Defined cases: null and empty texts hold nothing; texts of any length are read whole; a place and
    number repeated with the same text gives each mention once; without name parts only patterns and
    context find names; an empty table gives an empty result; extra columns are ignored.  The
    gazetteer is broadcast up to ``broadcast_bytes``; of a larger one each text gets its own parts by a join.
    """
    spark = texts.sparkSession
    parts = name_parts.where(F.col(name).isNotNull() & F.col(kind).isNotNull()).select(F.col(name).alias("t"), F.col(kind).alias("k")).distinct()
    rows = texts.select("place", "row_no", "text").where("text is not null and text <> ''")
    gaz = None
    if (parts.agg(F.sum(F.octet_length("t") + 80)).first()[0] or 0) <= broadcast_bytes:
        gaz = spark.sparkContext.broadcast(Gazetteer([(r["t"], r["k"]) for r in parts.collect()]))
        read = rows
    else:
        read = _known_parts(rows, parts)
    spans = materialise(_proposed(read, gaz).dropDuplicates(_ID), "candidates")

    # how the words of candidate names are used elsewhere, and how often beside a known name
    is_name = F.col("pii_type") == "name"
    parts_of = F.explode(F.array(F.struct(F.col("given").alias("w"), F.lit("given").alias("part")), F.struct(F.col("family").alias("w"), F.lit("family").alias("part")))).alias("x")
    sure = (F.col("v_form") == 1) & (F.col("v_known") >= 1) & (F.col("v_label") >= 0)
    used = spans.where(is_name).select(sure.cast("int").alias("sure"), parts_of).groupBy("x.w", "x.part").agg(F.sum("sure").alias("beside"))
    used = materialise(used.groupBy("w").agg(*[F.max(F.when(F.col("part") == part, F.col("beside"))).alias(f"{part}_beside") for part in ("given", "family")]), "used")
    lower = F.lower(F.regexp_replace("w", "’", "'"))
    word = rows.select(F.explode(F.split("text", r"[^\p{L}\p{M}'’-]+")).alias("w")).where("w <> ''").select(lower.alias("w"), (F.col("w") == F.lower("w")).cast("long").alias("low"))
    wanted = used.select("w")
    if (used.agg(F.sum(F.octet_length("w") + 40)).first()[0] or 0) <= USED_BYTES:
        word = word.join(F.broadcast(wanted), "w", "left_semi")  # the size was just checked
        usage = word.groupBy("w").agg(F.sum("low").alias("n_lower"), F.count("*").alias("n"))
    else:
        usage = word.groupBy("w").agg(F.sum("low").alias("n_lower"), F.count("*").alias("n")).join(wanted, "w", "left_semi")
    ordinary = (F.coalesce("n_lower", F.lit(0)) >= ORDINARY_LEAST) & (F.col("n_lower") * 2 > F.col("n"))
    told = used.join(usage, "w", "left").select("w", ordinary.alias("ordinary"), "given_beside", "family_beside")
    for part in ("given", "family"):
        spans = spans.join(told.select(F.col("w").alias(part), F.col("ordinary").alias(f"{part}_ordinary"), f"{part}_beside"), part, "left")
    odd = F.coalesce("given_ordinary", F.lit(False)) | F.coalesce("family_ordinary", F.lit(False))
    words = F.when(is_name & odd, -1).when(is_name, 1).otherwise(0)
    company = F.when(is_name, (F.coalesce("given_beside", F.lit(0)) > 0).cast("int") + (F.coalesce("family_beside", F.lit(0)) > 0).cast("int")).otherwise(0)
    spans = materialise(spans.select(*_ID, "v_form", "v_check", F.least("v_known", F.lit(2)).alias("v_known"), "v_label", words.alias("v_words"), company.alias("v_company"), "left", "right"), "spans")

    weighed = spans.withColumn("p", F.expr(_SEED))
    for k in range(ROUNDS):
        voted = materialise(_voted(spans, weighed), f"voted{k}")
        scores = _scores(voted)
        if scores is None:
            return spark.createDataFrame([], f"place string, row_no {spans.schema['row_no'].dataType.simpleString()}, pii_type string, start_at int, end_at int, score double")
        table = spark.createDataFrame(scores)
        weighed = voted.join(F.broadcast(table), ["pii_type", *VOTES]).withColumn("p", F.col("em"))  # one row a pattern
    kept = weighed.where("score >= 0.5")
    chosen = kept.groupBy("place", "row_no").agg(F.collect_set(F.struct(F.col("pii_type").alias("type"), "start", "end", "score")).alias("spans"))
    best = chosen.select("place", "row_no", F.explode(_greedy()("spans")).alias("s"))
    return best.select("place", "row_no", F.col("s.type").alias("pii_type"), (F.col("s.start") + 1).alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.score").alias("score"))


def redact(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` with every mention replaced by the placeholder of its type, the rest unchanged."""
    spans = found.groupBy("place", "row_no").agg(F.collect_list(F.struct("start_at", "end_at", "pii_type")).alias("spans"))

    @F.pandas_udf("string")
    def replace(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, row in zip(text, spans, strict=True):
            if row is not None and t is not None:
                for s in sorted(row, key=lambda s: -s["start_at"]):
                    t = t[: s["start_at"] - 1] + PLACEHOLDERS[s["pii_type"]] + t[s["end_at"] :]
            out.append(t)
        return pd.Series(out)

    joined = texts.join(spans, ["place", "row_no"], "left")
    return joined.withColumn("text", F.when(F.col("spans").isNotNull(), replace("text", "spans")).otherwise(F.col("text"))).drop("spans")
