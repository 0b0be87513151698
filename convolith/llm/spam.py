"""Keyword-stuffed and link-list pages.

Each page is described by content and link features, measured over its whole text.  Five labelers, each
looking at another side of a page - its links, its repetitions, its small words, its sentences, its marks of
tags and products - vote spam, no spam or nothing; expectation-maximisation over the counts of vote
patterns of all pages makes weak labels of the votes.  Bagged decision trees are trained on a bounded
sample of pages whose weak label is plain; every page is then scored by the trees, and the scores are
smoothed with the spam rate of the page's host, shrunk towards the overall rate.  The smoothed score
decides; no rule follows it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolith.llm.language import SMALL_WORDS
from convolith.llm.personal import reliabilities
from convolith.shared import materialise

FEATURES = ("sentence", "link", "tag", "product", "code", "loose", "stuffed", "named", "distinct", "pairs", "top_phrase", "short", "small", "line_length", "links_per_line", "upper", "digits")
SAMPLE = 20_000  # most weakly labelled pages the trees are trained on
TREES, DEPTH, LEAST = 25, 6, 5
HOST_WEIGHT = 0.3  # of the host's log-odds in the smoothed score
HOST_PRIOR = 20.0  # pages by which a host's rate is shrunk towards the overall one
PLAIN = 0.1, 0.9  # weak labels below and above these train the trees
REPEATED = 0.4  # of the words of a sentence that stuffs keywords

_LINK = re.compile(r"""<li>\s*<a\s[^<>]*>[^<>]*</a>\s*</li>|<a\s[^<>]*>[^<>]*</a>|!?\[[^\[\]\n]*\]\([^()\s]*\)|(?:https?://|www\.)[^\s<>"')\]]+""", re.I)
_TAG = re.compile(r"#[^\W\d]\w*|\btags?:\s?[\w-]+|\B@[a-z]\w+", re.I)
_PRODUCT = re.compile(r"\b(?:SKU|EAN|ISBN|ASIN|ART|ITEM)[-: #]*[\w-]*\d[\w-]*|[€$£]\s?\d+(?:[.,]\d+)?|\b\d+(?:[.,]\d+)?\s?(?:EUR|USD|GBP|CHF|€|\$|£)(?!\w)", re.I)
#: One of these is in whatever the next pattern finds.
_HINTS = ("http", "www.", "<a", "](", "#", "tag", "sku", "€", "$", "£", "eur", "usd")
_SUSPECT = re.compile(r"https?:|www\.|<a\s|\]\(|#\w|\btags?:|\bSKU|[€$£]|\b(?:EUR|USD)\b", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")
_ENDED = re.compile(r"[.!?。！？…]['\"”’»)\]*_]*$")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_GAPS = str.maketrans(dict.fromkeys("!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~", " "))
_GAP = re.compile(r"[!-&(-,./:-@\[-`{-~…。！？、，；：“”„«»]+")
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]+")
_DIGITS = re.compile(r"\d+")
_PART = re.compile(r"\s*(?:[,;|/•·*]+|\s[-–—]\s|\n)\s*")
_SMALL = frozenset(w for words in SMALL_WORDS.values() for w in words.split())
_STYLE = re.compile(r"</?(?:b|i|u|p|br|em|strong|span|code|small|sub|sup|div)(?:\s[^<>]*)?/?>", re.I)
_FENCE = re.compile(r"^\s*(?:```|~~~)")


def _says_something(piece: str) -> bool:
    """A finished sentence of at least four words that is not made of repetitions."""
    if not _ENDED.search(piece):
        return False
    cjk = len(_CJK.findall(piece))
    if cjk >= 5:
        return len(set(piece)) * 3 > min(len(piece), 60)
    words = _words(piece)
    return len(words) >= 4 and not _repeats(words)


def _repeats(words: list[str]) -> bool:
    """Stuffed keywords come again within one sentence, also if joined by small words; in prose hardly any does."""
    telling = [w for w in words if w not in _SMALL and not w[0].isdigit()]
    if len(set(telling)) < len(telling) and sum(n for n in Counter(telling).values() if n > 1) > REPEATED * len(words):
        return True
    return len(words) >= 8 and len(set(words)) <= 0.7 * len(words) and len(set(zip(words, words[1:], strict=False))) <= 0.7 * (len(words) - 1)


def _words(piece: str) -> list[str]:
    return (piece.lower().translate(_GAPS) if piece.isascii() else _GAP.sub(" ", piece.lower())).split()


def features(text: str) -> tuple[float, ...]:
    """The values named in FEATURES."""
    size = dict.fromkeys(("sentence", "link", "tag", "product", "code", "loose", "stuffed", "named"), 0)
    loose: list[str] = []
    fenced = False
    n_lines = n_links = 0
    if "<" in text:
        text = _STYLE.sub("", text)
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            size["code"] += len(line)
            continue
        line = line.strip()
        if not line:
            continue
        if fenced:
            size["code"] += len(line)
            continue
        n_lines += 1
        marks = 0
        rest = line
        low = line.lower()
        if any(x in low for x in _HINTS) and _SUSPECT.search(line):
            found = _LINK.findall(line)
            n_links += len(found)
            marks = len(found)
            size["link"] += sum(map(len, found))
            rest = _LINK.sub(" ", line) if found else line
            for name, pattern in (("product", _PRODUCT), ("tag", _TAG)):
                got = pattern.findall(rest)
                if got:
                    marks += len(got)
                    size[name] += sum(map(len, got))
                    rest = pattern.sub(" ", rest)
        for piece in _SENTENCE_END.split(rest):
            piece = piece.strip(" \t-*:|>#")
            if not piece:
                continue
            if _says_something(piece):
                size["sentence"] += len(piece)
                continue
            loose.append(piece)
            if _repeats(_words(piece)):
                size["stuffed"] += len(piece)
            elif piece.count(" ") < 8 * marks:  # the name of what is linked, tagged or sold
                size["named"] += len(piece)
            else:
                size["loose"] += len(piece)
    words = [w.lower() for p in loose for w in (_CJK.findall(p) if len(_CJK.findall(p)) > 3 else _WORD.findall(p))]
    phrases = [x.strip().lower() for p in loose for x in _PART.split(p) if x.strip()]
    distinct = len(set(words)) / len(words) if words else 1.0
    pairs = len(set(zip(words, words[1:], strict=False))) / (len(words) - 1) if len(words) > 1 else 1.0
    top = max(Counter(phrases).values()) / len(phrases) if phrases else 0.0
    short = len(words) / len(phrases) if phrases else 0.0
    every = _words(text)
    small = sum(w in _SMALL for w in every) / len(every) if every else 0.0
    total = sum(size.values()) or 1
    upper = sum(map(len, _UPPER.findall(text))) / max(1, len(text))
    digits = sum(map(len, _DIGITS.findall(text))) / max(1, len(text))
    return (*(v / total for v in size.values()), distinct, pairs, top, min(20.0, short), small, min(400.0, len(text) / max(1, n_lines)), n_links / max(1, n_lines), upper, digits)


#: The labelers: spam if the first holds, no spam if the second does, else no vote.
LABELERS = {
    "links": ("link + named > 0.6", "link < 0.2"),
    "repetitions": ("stuffed > 0.4 or loose + stuffed > 0.4 and distinct < 0.6 and pairs < 0.8", "stuffed < 0.1 and distinct > 0.7"),
    "small_words": ("small < 0.12 and code < 0.5", "small > 0.3"),
    "sentences": ("sentence + code < 0.25", "sentence + code > 0.6"),
    "marks": ("tag + product + link > 0.4", "tag + product + link < 0.05"),
}


def described(documents: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """doc_id, host and the features of each page with a visible text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            got = np.array([features(t) for t in pdf["text"]], dtype=np.float32)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "host": pdf["host"].to_numpy(), **{name: got[:, k] for k, name in enumerate(FEATURES)}})

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]"))
    return rows.mapInPandas(run, f"doc_id {documents.schema[doc_id].dataType.simpleString()}, host string, " + ", ".join(f"{f} float" for f in FEATURES))


def labelled(pages: DataFrame) -> DataFrame:
    """``pages`` with weak, the posterior of spam by the labelers' votes: EM over at most 3 ** 5 patterns."""
    voted = pages.withColumns({f"v_{name}": F.expr(f"case when {spam} then 1 when {ham} then -1 else 0 end") for name, (spam, ham) in LABELERS.items()})
    votes = [f"v_{name}" for name in LABELERS]
    counted = voted.groupBy(*votes).count().orderBy(*votes).toPandas()
    if not len(counted):
        return pages.withColumn("weak", F.lit(None).cast("double"))
    patterns = counted[votes].to_numpy(int) + 1
    weak, _ = reliabilities(patterns, counted["count"].to_numpy(float), 1 / (1 + np.exp(-2.0 * (patterns - 1).sum(axis=1))))
    table = pages.sparkSession.createDataFrame(counted[votes].assign(weak=weak))
    return voted.join(F.broadcast(table), votes).drop(*votes)  # a row for each pattern


class BaggedTrees:
    """Decision trees on bootstrap samples, Gini splits over quantile cuts; plain numpy arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            pick = rng.integers(0, len(y), len(y))
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(x[pick], y[pick], depth, least, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int, nodes: list) -> int:
        at = len(nodes)
        mean = float((y.sum() + 0.5) / (len(y) + 1))
        nodes.append((-1, 0.0, -1, -1, mean))
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return at
        best = (1e-9, -1, 0.0)
        gini = 2 * y.mean() * (1 - y.mean())
        for j in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25))):
                left = x[:, j] <= cut
                n = int(left.sum())
                if n < least or len(y) - n < least:
                    continue
                p, q = y[left].mean(), y[~left].mean()
                gain = gini - (n * 2 * p * (1 - p) + (len(y) - n) * 2 * q * (1 - q)) / len(y)
                if gain > best[0]:
                    best = (gain, j, float(cut))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            a = self._grow(x[left], y[left], depth - 1, least, nodes)
            b = self._grow(x[~left], y[~left], depth - 1, least, nodes)
            nodes[at] = (best[1], best[2], a, b, mean)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, a, b, mean in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(64):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, a[at], b[at]), at)
            out += mean[at]
        return out / len(self.trees)


def train(pages: DataFrame, sample: int = SAMPLE) -> BaggedTrees | None:
    """Trees from pages with a plain weak label; None where all are of one kind.

    At most ``sample`` pages of the two labels are taken to the driver, those with the least hash.
    """
    plain = pages.withColumn("y", F.when(F.col("weak") > PLAIN[1], 1).when(F.col("weak") < PLAIN[0], 0)).where("y is not null")
    got = [plain.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").select(*FEATURES, "y").limit(sample // 2).toPandas() for y in (0, 1)]
    if not len(got[0]) or not len(got[1]):
        return None
    both = pd.concat(got)
    return BaggedTrees(both[list(FEATURES)].to_numpy(float), both["y"].to_numpy(float))


def spam_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, host_rate for each page that is spam.

    Defined cases: null, empty and blank texts are no pages; pages with a null host share one host; a
    repeated row gives one row; where the weak labels are all of one kind they decide by themselves; an
    empty table gives an empty result; texts of any length are measured whole; extra columns are
    ignored.
    """
    spark = documents.sparkSession
    pages = labelled(materialise(described(documents, doc_id, text, host), "pages"))
    model = train(pages, sample)
    if model is None:
        return pages.where("weak > 0.5").select("doc_id", F.col("weak").alias("score"), F.lit(1.0).alias("host_rate")).distinct()
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(*x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(np.stack([c.to_numpy(float) for c in x], axis=1)))

    scored = materialise(pages.select("doc_id", "host", predict(*FEATURES).alias("p")), "scored")
    total = scored.agg(F.avg("p").alias("p")).first()["p"]
    # a host that holds a third of all pages is combined map-side; the rates are joined back by host
    rates = scored.groupBy("host").agg(((F.sum("p") + F.lit(HOST_PRIOR * total)) / (F.count("*") + F.lit(HOST_PRIOR))).alias("host_rate"))
    joined = scored.join(rates, scored["host"].eqNullSafe(rates["host"]))
    logit = lambda c: F.log(c / (1 - c))
    clip = lambda c: F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), c))
    shift = logit(clip(F.col("host_rate"))) - float(np.log(max(1e-3, total) / max(1e-3, 1 - total)))
    smoothed = joined.withColumn("score", 1 / (1 + F.exp(-(logit(clip(F.col("p"))) + HOST_WEIGHT * shift))))
    return smoothed.where("score > 0.5").select("doc_id", "score", "host_rate").distinct()
