"""Evaluation texts leaking into training text.

The held-out items are cut into windows of ``n`` consecutive words, normalised to bare letters and
digits.  A set of the hashes of the windows' first ``width`` characters is broadcast; every training
text is normalised the same way, a rolling hash is taken at each place a token starts, and what the
set contains is verified against the full windows.  As windows are compared without their spaces, a
line break or an invisible character inside a word does no harm.

The scan is a map over documents: no shuffle of texts, no pairs.  Items are broadcast in chunks of
bounded size; a larger item set only means more passes.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolith.shared import materialise  # noqa: F401

CHUNK_CHARS = 4_000_000  # most characters of items in one broadcast
PIECE_CHARS = 1_000_000  # characters of documents normalised at once
_TABLED = 0x30000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_BLANK = "\x00"


def _plain(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold()) if c.isalnum())


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Code point -> code point of its bare form, 0 for none, the maximum for more than one character."""
    out = np.zeros(_TABLED, np.uint32)
    for cp in range(_TABLED):
        p = _plain(chr(cp))
        out[cp] = 0 if not p else ord(p) if len(p) == 1 else 0xFFFFFFFF
    return out


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE))


def unmarked(text: str) -> str:
    """Tags blanked and entities resolved, every other character at its old place."""
    if "<" in text:
        text = _TAG.sub(lambda m: _BLANK * len(m[0]), text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0])[: len(m[0])].ljust(len(m[0]), _BLANK), text)
    return text


def bare(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letters and digits of ``text``, lower-cased and without accents, and where each one stood."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _table()
    if len(cp) and cp.max() >= _TABLED:
        wide = cp >= _TABLED
        codes = table[np.where(wide, 0, cp)]
        codes[wide] = [ord(p) if len(p := _plain(chr(c))) == 1 else 0 for c in cp[wide]]
    else:
        codes = table[cp]
    if (codes == 0xFFFFFFFF).any():
        parts, at, last = [], [], 0
        for i in np.flatnonzero(codes == 0xFFFFFFFF):
            more = [ord(c) for c in _plain(chr(cp[i]))]
            parts += [codes[last:i], np.array(more, np.uint32)]
            at += [np.arange(last, i), np.full(len(more), i)]
            last = i + 1
        codes, at = np.concatenate([*parts, codes[last:]]), np.concatenate([*at, np.arange(last, len(cp))])
        keep = codes != 0
        return codes[keep], at[keep]
    at = np.flatnonzero(codes)
    return codes[at], at


def _prefix(codes: np.ndarray) -> np.ndarray:
    power, _ = _powers(_capacity(len(codes)))
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)])])


def _capacity(n: int) -> int:
    """Powers are kept for one length at a time, grown in doublings."""
    size = PIECE_CHARS * 2
    while size < n:
        size *= 2
    return size


def hashes(codes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` characters from each start, which must all lie within."""
    total = _prefix(codes)
    _, inverse = _powers(_capacity(len(codes)))
    with np.errstate(over="ignore"):
        h = (total[starts + width] - total[starts]) * inverse[starts]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xBF58476D1CE4E5B9)


class Windows:
    """All windows of ``n`` words of some items, with the hash set that is broadcast."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        found: dict[bytes, set[int]] = {}
        for item, text in items:
            words = [w for w in (bare(x)[0] for x in unmarked(text or "").replace(_BLANK, "").split()) if len(w)]
            for k in range(len(words) - n + 1):
                found.setdefault(np.concatenate(words[k : k + n]).tobytes(), set()).add(item)
        self.windows = [(np.frombuffer(b, np.uint32), tuple(sorted(i))) for b, i in found.items()]
        self.width = min((len(w) for w, _ in self.windows), default=0)
        self.by_hash: dict[int, list[int]] = {}
        for k, (w, _) in enumerate(self.windows):
            self.by_hash.setdefault(int(hashes(w, np.zeros(1, np.int64), self.width)[0]), []).append(k)
        self.sorted = np.sort(np.fromiter(self.by_hash, np.uint64, len(self.by_hash)))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.sorted >> np.uint64(44)] = True

    def scan(self, texts: list[str]) -> list[dict[int, list[tuple[int, int]]]]:
        """For each text, item -> character spans (from, to) in which windows of it were found."""
        out: list[dict[int, list[tuple[int, int]]]] = [{} for _ in texts]
        if not self.windows:
            return out
        joined = "\n".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes, at = bare(joined)
        if len(codes) < self.width:
            return out
        first = np.ones(len(codes) + 1, bool)
        first[1:-1] = at[1:] - at[:-1] > 1
        # a character that became several keeps its place, so only gaps start a token
        starts = np.flatnonzero(first[:-1])
        starts = starts[starts + self.width <= len(codes)]
        h = hashes(codes, starts, self.width)
        maybe = np.flatnonzero(self.bits[h >> np.uint64(44)])
        hit = maybe[self.sorted[np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)] == h[maybe]]
        for s, key in zip(starts[hit].tolist(), h[hit].tolist(), strict=True):
            for k in self.by_hash[key]:
                w, items = self.windows[k]
                e = s + len(w)
                if e > len(codes) or not first[e] or not np.array_equal(codes[s:e], w):
                    continue
                doc = int(np.searchsorted(ends, at[s], "right"))
                if at[e - 1] >= ends[doc]:
                    continue
                base = int(ends[doc]) - len(texts[doc]) - 1
                for item in items:
                    out[doc].setdefault(item, []).append((int(at[s]) - base, int(at[e - 1]) - base + 1))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    i, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= PIECE_CHARS or k == len(texts) - 1:
            yield ids[i : k + 1], texts[i : k + 1]
            i, n = k + 1, 0


def _chunks(items: DataFrame, item_id: str, text: str, n: int, broadcast_chars: int) -> Iterator[Windows]:
    """Item sets small enough to broadcast, one after the other."""
    held: list[tuple[int, str]] = []
    size = 0
    for item, t in items.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).toLocalIterator():
        held.append((item, t))
        size += len(t)
        if size >= broadcast_chars:
            yield Windows(held, n)
            held, size = [], 0
    if held:
        yield Windows(held, n)


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, broadcast_chars: int = CHUNK_CHARS) -> DataFrame:
    """item_id, doc_id, n_windows, spans (array of from, to) for each document that holds ``n`` consecutive words of an item.

    Letter case, accents, punctuation, spacing, line breaks, markup, entities and invisible characters
    are disregarded.  Spans count characters from 0.

    Defined cases: null or blank texts hold nothing; items of fewer than ``n`` words can't be found;
    repeated documents are found each under its own id, repeated rows of one id once each; a
    passage shared by several items counts for each of them; empty tables give an empty result; extra
    columns are ignored; texts of any length are scanned whole.
    """
    spark = documents.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in [*documents.schema, *items.schema]}
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, doc_id {kinds[doc_id]}, n_windows long, spans array<struct<from: long, to: long>>"
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    out = None
    for windows in _chunks(items, item_id, item_text, n, broadcast_chars):
        shared = spark.sparkContext.broadcast(windows)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = []
                for ids, texts in _pieces(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                    plain = [unmarked(t) for t in texts]
                    for doc, hits in zip(ids, shared.value.scan(plain), strict=True):
                        found += [(item, doc, len(spans), [{"from": a, "to": b} for a, b in _merged(spans)]) for item, spans in hits.items()]
                yield pd.DataFrame(found, columns=["item_id", "doc_id", "n_windows", "spans"])

        part = rows.mapInPandas(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """``documents`` without those found in ``leaks``; with ``spans``, only the leaked passages are cut out."""
    hit = leaks.groupBy(F.col("doc_id").alias("_doc")).agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    if not spans:
        return documents.join(hit, documents[doc_id] == hit["_doc"], "left_anti")

    @F.pandas_udf("string")
    def cut(text: pd.Series, where: pd.Series) -> pd.Series:
        out = []
        for t, w in zip(text, where, strict=True):
            if w is not None:
                for a, b in reversed(_merged([(int(x["from"]), int(x["to"])) for x in w])):
                    t = t[:a] + t[b:]
            out.append(t)
        return pd.Series(out)

    joined = documents.join(hit, documents[doc_id] == hit["_doc"], "left")
    return joined.withColumn(text, F.when(F.col("_doc").isNotNull(), cut(text, "_spans")).otherwise(F.col(text))).drop("_doc", "_spans")
