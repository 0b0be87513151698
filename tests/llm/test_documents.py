from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pytest
from convolith.llm import leakage as L
from convolith.llm import packing as K
from convolith.llm import spam as S
from hypothesis import given, settings
from hypothesis import strategies as st

ITEM = "In old Harwick the seven millers near the tide pool kept thirty copper bells, which nobody had counted before the long winter. Who knew why?"
TEN = "the seven millers near the tide pool kept thirty copper"


def scan(*texts, items=((1, ITEM),)):
    return [set(h) for h in L.Windows(list(items), 10).scan([L.unmarked(t) for t in texts])]


@pytest.mark.parametrize(
    ("text", "held"),
    [
        (f"Someone wrote: {TEN} bells.", True),
        (TEN.upper(), True),
        (TEN.replace(" ", "\n> "), True),
        (TEN.replace("millers", "mil-\nlers").replace("copper", "cop​per"), True),
        (TEN.replace("seven", "<b>seven</b>").replace(" tide ", "&nbsp;<i>tide</i> "), True),
        (TEN.replace("tide", "t&#105;de"), True),
        ("the seven millers near the tide pool kept thirty", False),
        (TEN.replace("seven", "seventy"), False),
        (TEN.replace("copper", "coppery"), False),
        ("x" + TEN, False),
        (TEN.replace("pool", "pool and pond"), False),
        ("", False),
    ],
)
def test_what_counts_as_held(text, held):
    assert scan(text) == [{1} if held else set()]


@given(st.lists(st.sampled_from("aa bb cc dd e-e".split()), min_size=0, max_size=60), st.lists(st.sampled_from("aa bb cc dd e-e".split()), min_size=10, max_size=30))
@settings(max_examples=150, deadline=None)
def test_scan_against_brute_force(doc, item):
    text = " ".join(doc)
    plain = [w.replace("-", "") for w in doc]
    target = [w.replace("-", "") for w in item]
    windows = {tuple(target[i : i + 10]) for i in range(len(target) - 9)}
    expected = any(tuple(plain[i : i + 10]) in windows for i in range(len(plain) - 9))
    assert scan(text, items=[(1, " ".join(item))]) == [{1} if expected else set()]


def test_leaks(spark):
    docs = spark.createDataFrame([(1, f"Before. {TEN} after.", 9), (2, "nothing here", 9), (3, None, 9), (4, "", 9), (5, f"Before. {TEN} after.", None), (6, "word " * 200_000 + TEN, 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, 1), (8, "Passage: " + TEN + " spoons.", 1), (9, "too short", 1), (10, None, 1)], "item_id long, text string, doc_id int")
    expected = {(i, d) for i in (7, 8) for d in (1, 5, 6)}
    for chunk in (L.CHUNK_CHARS, 10):
        leaks = L.find_leaks(docs, items, broadcast_chars=chunk)
        assert {(r["item_id"], r["doc_id"]) for r in leaks.collect()} == expected
    assert {r["doc_id"] for r in L.without_leaks(docs, leaks).collect()} == {2, 3, 4}
    cut = {r["doc_id"]: r["text"] for r in L.without_leaks(docs, leaks, spans=True).collect()}
    assert cut[1] == "Before.  after." and cut[2] == "nothing here" and cut[3] is None
    assert L.find_leaks(docs.limit(0), items).count() == 0 and L.find_leaks(docs, items.limit(0)).count() == 0


SPAM = [
    "\n".join(f"https://a{i}.example/page/{i}?ref=x" for i in range(8)),
    "\n".join(f"- [best price {i}](https://a.example/{i})" for i in range(8)),
    ", ".join(["free download", "best price", "cloud sync", "best price"] * 8),
    "\n".join(f"SKU-{i:05d} backup vault tag:red tag:blue" for i in range(9)),
    "#BestPrice #Free_Download #BestPrice #CloudSync #BestPrice " * 6,
    "One real sentence stands here before the rest.\n" + "\n".join(f"Cloud Sync Coupon | Best Price {i} EUR" for i in range(12)),
    "best price for best price with best price and best price. cloud sync for cloud sync with cloud sync and best price. " * 3,
]
FINE = [
    "The parser keeps the old files. Nobody noticed that the second run was slower than the first one. After the upgrade three users asked for a list, and two of them got it within a day.",
    "\n".join(f"- [notes {i}](https://a.example/{i}): The parser keeps file {i}, and nobody noticed it for a long while in the staging setup." for i in range(6)),
    "```\n" + "\n".join(f"move(x{i}, y)" for i in range(30)) + "\n```",
    "\n".join(f"--option-{i}  Keeps {i} files open while the second run is going on." for i in range(8)),
    "\n".join(f"cache layer: The layer keeps item {i} until the disk is nearly full." for i in range(8)),
    "> Every traveller to the old\n> harbour paid seven small coins\n> at the gate, a custom that the\n> millers had kept since the\n> first flood of the river",
]


def test_long_tags_are_blanked():
    tag = '<a href="https://example.org/' + "x" * 5000 + '">'
    assert L.unmarked(f"one {tag}two</a>") == "one " + L._BLANK * len(tag) + "two" + L._BLANK * 4


def test_features_of_spam_and_prose():
    for t in SPAM:
        assert dict(zip(S.FEATURES, S.features(t), strict=True))["sentence"] < 0.5, t
    for t in ("Buy red lamp today red lamp red lamp now.", "red lamp cheap red lamp.", "red lamp for red lamp with red lamp and blue vase."):
        assert not S._says_something(t)
    for t in ("Both the search path and the search index depend on it.", "Version 1.0.0 of the parser follows 0.9.0 of last year."):
        assert S._says_something(t)


def stuffed(rng, n):
    """Pages of a kind that no labeler was written for: prose with pseudo-sentences that repeat keywords."""
    nouns = "kettle lantern saddle violin hammock compass teapot umbrella".split()
    out = []
    for _ in range(n):
        a, b = rng.choice(nouns, 2, replace=False)
        out.append(" ".join(rng.permutation([f"Find {a} online {a} {b} {a} here.", f"{b} with {a} {b} beats {b}.", f"Why {a}? {a} {b} {a} {b}!", f"{a} {b} {a} offers {b}."])))
    return out


def test_trees_and_hosts_against_votes(spark):
    """On held-out pages the trees find what the labelers' vote finds, and most of what it leaves open."""
    rng = np.random.default_rng(3)
    good = [f"We moved the {x} on day {k} because the {y} was late. Nobody had asked for it before, so the team wrote a note about what went wrong." for k in range(40) for x, y in (("shelf", "order"), ("server", "report"))]
    pages = [(k, t, f"h{k % 5}") for k, t in enumerate(good + [f"{t} page {k}" for k in range(12) for t in SPAM] + stuffed(rng, 40))]
    bad = {k for k, _, _ in pages if k >= len(good)}
    found = {r["doc_id"] for r in S.spam_pages(spark.createDataFrame(pages, "doc_id long, text string, source string")).collect()}
    assert len(found & bad) >= 0.95 * len(bad) and len(found & bad) >= 0.95 * len(found)


def test_letters_and_digits_of_the_whole_text():
    got = dict(zip(S.FEATURES, S.features("word " * 1000 + "ABC12 " * 1000), strict=False))
    assert abs(got["upper"] - 3000 / 11000) < 1e-9 and abs(got["digits"] - 2000 / 11000) < 1e-9


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.random((1200, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.6)).astype(float)
    model = S.BaggedTrees(x[:800], y[:800])
    assert ((model.predict(x[800:]) > 0.5) == (y[800:] > 0.5)).mean() > 0.95


def test_spam_pages(spark):
    rows, n = [], 0
    for k in range(12):
        for t in SPAM + FINE:
            n += 1
            rows.append((n, f"{t}\nNumber {k} of the pages was made on a quiet day.", None if k == 0 else f"h{k % 3}", "x"))
    marks = {r[0]: r[1].split("\nNumber")[0] in SPAM for r in rows}
    rows += [(1001, None, "h", "x"), (1002, "  \n", "h", "x"), (1003, "", "h", "x"), (1, rows[0][1], None, "x"), (1004, SPAM[0] * 4000, "h1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, share string")
    found = {r["doc_id"] for r in S.spam_pages(docs).collect()}
    expected = {k for k, bad in marks.items() if bad} | {1004}
    assert found == expected
    assert S.spam_pages(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in S.spam_pages(docs.where("doc_id in (1, 2)")).collect()} == {1, 2}


TOKENIZER = pytest.mark.skipif(not Path(K.TOKENIZER).exists(), reason="no vocabulary files here")


@TOKENIZER
@given(st.text(alphabet=st.sampled_from("ab1 \n\t.é漢  "), max_size=60))
@settings(max_examples=300, deadline=None)
def test_counts_are_the_tokenizer_s(text):
    m = K.measure(K.TOKENIZER)
    assert m(text)[0] == len(m.encoding.encode_ordinary(text)) if text else True


@TOKENIZER
def test_pattern_belongs_to_the_file():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(K.TOKENIZER).read_bytes().splitlines() if x)}
    own = tiktoken.Encoding("t", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    text = "I'll say it's  done,\n we've 12 tries left 'mid' x're."
    assert K.measure(K.TOKENIZER).encoding.encode_ordinary(text) == own.encode_ordinary(text)


def test_hilbert_neighbours():
    side = 8
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    key = K.hilbert_key(grid, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@given(st.lists(st.integers(1, 40), max_size=80))
@settings(max_examples=150, deadline=None)
def test_packer(sizes):
    capacity = 16
    p = K.Packer(capacity)
    placed = p.place(sizes)
    room: dict[int, int] = {}
    for n, parts in zip(sizes, placed, strict=True):
        assert sum(size for _, _, size in parts) == n and (len(parts) == 1 or n > capacity)
        assert [s for _, s, _ in parts] == [i * capacity for i in range(len(parts))]
        for c, _, size in parts:
            room[c] = room.get(c, capacity) - size
    assert all(v >= 0 for v in room.values())
    # first fit bounds: no two containers are both less than half full
    assert sum(v > capacity / 2 for v in room.values()) <= 1


@TOKENIZER
def test_pack(spark):
    docs = spark.createDataFrame([(i, "The parser keeps old files. " * (1 + i * 7 % 40), 1) for i in range(200)] + [(900, None, 1), (901, "", 1), (902, " ", 1), (903, "word " * 5000, 1), (5, "again", 1)], "doc_id long, text string, part_no int")
    kinds = spark.createDataFrame([("small", 64, 1), ("large", 1000, 1), (None, 10, 1), ("zero", 0, 1), ("small", 32, 1)], "container_name string, capacity_tokens int, doc_id int")
    out = K.pack(docs, kinds).toPandas()
    assert set(out["container_name"]) == {"small", "large"}
    for name, capacity in (("small", 64), ("large", 1000)):
        g = out[out["container_name"] == name]
        load = g.groupby("container_no")["n_tokens"].sum()
        assert load.max() <= capacity and load.sum() / (len(load) * capacity) > 0.9
        assert not set(g["doc_id"]) & {900, 901} and 902 in set(g["doc_id"])
    assert K.pack(docs.limit(0), kinds).count() == 0
    # kinds beyond what one pass takes, and the rules counted where they are broken
    columns = ["container_name", "container_no", "doc_id", "part_no", "first_token", "n_tokens"]
    assert {tuple(r) for r in K.pack(docs, kinds, kinds_at_once=1).select(*columns).collect()} == set(out[columns].itertuples(index=False, name=None))
    once = docs.where("text <> 'again'")
    rules = {r["container_name"]: (r["over_full"], r["split"], r["uncovered"], r["texts"]) for r in K.broken_rules(once, K.pack(once, kinds), kinds).collect()}
    assert rules == {"small": (0, 0, 0, 202), "large": (0, 0, 0, 202)}
    report = {r["container_name"]: r for r in K.fill_report(K.pack(docs, kinds), kinds).collect()}
    assert report["small"]["filled"] > 0.9 and report["small"]["containers"] >= report["small"]["least"]
