from __future__ import annotations

import numpy as np
from convolith.llm import personal as P

PARTS = [("Ines", "given"), ("Ruben", "given"), ("Robin", "given"), ("Holm", "family"), ("van der Meer", "family"), ("Oak-Lind", "family")]
TEXTS = {
    1: ("Write to ines.holm@mail.example or ring +44 20 7946 0123.", {("email", 10), ("phone", 41)}),
    2: ("My name is Ines Holm.", {("name", 12)}),
    3: ("I spoke to ruben van der meer and they agreed.", {("name", 12)}),
    4: ("notes from Holm, R. on restore", {("name", 12)}),
    5: ("reset mail for ines at post dot example", {("email", 16)}),
    6: ("We met at Flat 3, 84 Larkspur Terrace, Brimford yesterday.", {("street_address", 11)}),
    7: ("Lieferung an Alte Gartengasse 98, 04598 Dunfeld.", {("street_address", 14)}),
    8: ("My social security number is X4071640W.", {("identity_number", 30)}),
    9: ("The total is 4 333 409 bytes. Block 037 275 745 starts here. Version 1.2.3 of pack@1.4.0.", set()),
    10: ("The Robin build and the Ruben cache are green. Run 14 Lanes in parallel.", set()),
    11: ("", set()),
    12: (None, set()),
    13: ("Please ask Robin Oak-Lind about it. " + "The parser keeps old files. " * 3000, {("name", 12)}),
}


def frames(spark):
    filler = [(f"The robin build {i} and the ruben cache keep files at noon.", i) for i in range(20)]
    rows = [("content", k, t, "x") for k, (t, _) in TEXTS.items()]
    rows += [("content", 100 + i, f"I spoke to {a} {b} and they agreed.", "x") for i, (a, b) in enumerate([(a, b) for a in ("Ines", "Ruben", "Robin") for b in ("Holm", "Oak-Lind", "Tarn")])]
    rows += [("content", 200 + i, t, None) for t, i in filler]
    return spark.createDataFrame(rows, "place string, row_no long, text string, start string"), spark.createDataFrame(PARTS, "name_text string, name_kind string")


def test_mentions_and_redaction(spark):
    texts, parts = frames(spark)
    found = P.mentions(texts.unionByName(texts.limit(3)), parts)
    got = {}
    for r in found.collect():
        got.setdefault(r["row_no"], set()).add((r["pii_type"], r["start_at"]))
    for k, (_, expected) in TEXTS.items():
        assert got.get(k, set()) == expected, (k, got.get(k))
    clean = {r["row_no"]: r["text"] for r in P.redact(texts, found).collect()}
    assert clean[1] == "Write to [EMAIL] or ring [PHONE]."
    assert clean[6] == "We met at [STREET_ADDRESS] yesterday."
    assert clean[9] == TEXTS[9][0] and clean[12] is None


def test_empty(spark):
    texts, parts = frames(spark)
    assert P.mentions(texts.limit(0), parts).count() == 0
    assert P.mentions(texts.where("row_no = 1"), parts.limit(0)).count() == 2


def test_reliabilities_recover_good_labelers():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < acc, np.where(truth, 2, 0), np.where(truth, 0, 2)) for acc in (0.95, 0.9, 0.85)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    soft, tables = P.reliabilities(patterns, counts.astype(float))
    assert tables[0][1, 2] > 0.9 and tables[0][0, 0] > 0.9
    score = P.span_classifier(patterns, counts.astype(float), soft)
    assert score[(patterns == 2).all(axis=1)][0] > 0.9 and score[(patterns == 0).all(axis=1)][0] < 0.1


#: Sentences that stand in no table of the library: what leads to a detail must be learnt from the texts.
CARRIERS = {
    "phone": ["Best reached through {} on weekdays", "Switchboard gave us {} yesterday", "Please try {} twice"],
    "identity_number": ["Registered under {} since May", "The clerk typed {} by mistake"],
    "name": ["Minutes taken by {} again", "Badge issued for {} today", "Desk next to {} is free"],
    "street_address": ["Parcels go near {} only", "Keys are kept in {} now"],
    "email": ["Bounced from {} twice", "Forwarded it over {} then"],
}
DETAILS = {
    "phone": ["+44 20 7946 01{:02d}", "(020) 7946 01{:02d}", "+1 212-555-01{:02d}"],
    "identity_number": ["AB 12 34 {:02d} C", "X12345{:02d}L", "123-45-67{:02d}"],
    "name": ["Ines Holm", "Ruben Oak-Lind", "Ines Tarnow", "Ruben Holm", "Robin Tarnow", "Tilda Oak-Lind"],
    "street_address": ["{} Larkspur Terrace", "{} Old Mill Road, Brimford", "Gartengasse {}"],
    "email": ["ines{:02d}@mail.example", "r.holm{:02d} [at] post.example"],
}
DECOYS = ["Batch 0{0} {1} {0} ran out of space", "Frame 9{0} {1} {0} was dropped here", "The Cobalt queue {0} and the Rowan index are warm", "Set of 4 {0} {1} bytes was written", "Pack {0}-{1}-{0}-77 came late"]


def unseen(spark):
    rows, expected, n = [], set(), 0
    for kind, carriers in CARRIERS.items():
        for c in carriers:
            for i in range(12):
                n += 1
                d = DETAILS[kind][i % len(DETAILS[kind])].format(10 + i)
                rows.append(("content", n, f"The run ended. {c.format(d)}.", None))
                expected.add((n, kind, rows[-1][2].index(d) + 1))
    for c in DECOYS:
        for i in range(20):
            n += 1
            rows.append(("content", n, f"The run ended. {c.format(100 + 7 * i, 310 + 11 * i)}.", None))
    return spark.createDataFrame(rows, "place string, row_no long, text string, note string"), expected


def test_unseen_contexts(spark):
    texts, expected = unseen(spark)
    parts = spark.createDataFrame(PARTS, "name_text string, name_kind string")
    got = {(r["row_no"], r["pii_type"], r["start_at"]) for r in P.mentions(texts, parts).collect()}
    assert len(got & expected) >= 0.9 * len(expected), sorted(expected - got)
    assert len(got & expected) >= 0.9 * len(got), sorted(got - expected)
    # a gazetteer too large to broadcast gives each text its own parts, and the same result
    joined = {(r["row_no"], r["pii_type"], r["start_at"]) for r in P.mentions(texts, parts, broadcast_bytes=0).collect()}
    assert joined == got


def test_names_in_small_letters(spark):
    known = [f"Minutes taken by {g} {f} again" for g in ("Ines", "Ruben", "Robin") for f in ("Holm", "Oak-Lind")] * 3
    small = ["minutes taken by ines tarnow again", "minutes taken by tilda holm again"] * 3
    rows = [("content", i, f"All good. {t}.") for i, t in enumerate([*known, *small])]
    rows += [("content", 100 + i, f"The Cobalt Queue {i} and the robin index are warm by noon.") for i in range(20)]
    texts, parts = spark.createDataFrame(rows, "place string, row_no long, text string"), spark.createDataFrame(PARTS, "name_text string, name_kind string")
    got = {(r["row_no"], r["start_at"]) for r in P.mentions(texts, parts).where("pii_type = 'name'").collect()}
    assert got == {(i, 28) for i, t in enumerate([*known, *small])}
