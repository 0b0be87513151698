"""Filling fixed-capacity containers with items along a space-filling curve.

Each text is measured in tokens of a public tokenizer and given a hashed document vector: every
word has a pseudo-random direction drawn from its hash, the text is their normalised sum, projected to
three dimensions.  The three coordinates become one Hilbert key.  The texts are range-sorted by that
key, so that a partition holds a stretch of the curve, and packed there in order: best fit, decreasing,
within windows of neighbouring items, with the open containers carried from window to window.

No stage compares texts with each other, and no container spans partitions; what a partition leaves
open is at most one partly filled container for each window's remainder at its end.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolith.shared import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BITS = 10  # of each coordinate of the Hilbert key
WINDOW = 1024  # neighbouring items sorted by size before they are placed
MEMO = 400_000  # pieces of text whose measure a worker remembers

_UNEVEN = re.compile(r"\s\s|\s\Z|\A\s")
_BREAK = re.compile(r"(?<=\S)(?= \S)")


class Measure:
    """Token counts and vector sums of texts, remembered by piece.

    A single space between two visible characters always begins a pre-token, so a text may be cut
    there and its count is the sum over the pieces.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("measure", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.count: list[int] = []
        self.vector: list[tuple[float, float, float]] = []
        self.arrays: tuple[int, np.ndarray, np.ndarray] = (0, np.empty(0), np.empty((0, 3)))

    def _learn(self, piece: str) -> int:
        self.count.append(len(self.encoding.encode_ordinary(piece)))
        word = piece.strip().lower().strip(".,;:!?\"'()[]`*_#").encode("utf-8", "surrogatepass")
        h = zlib.crc32(word)
        self.vector.append(tuple(((h * k >> 7) % 2048) / 1023.5 - 1 for k in (2654435761, 2246822519, 3266489917)) if word else (0.0, 0.0, 0.0))
        self.index[piece] = len(self.count) - 1
        return len(self.count) - 1

    def pieces(self, text: str) -> list[str]:
        if _UNEVEN.search(text):
            return _BREAK.split(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def __call__(self, text: str) -> tuple[int, float, float, float]:
        if len(self.index) > MEMO:
            self._reset()
        get = self.index.get
        learn = self._learn
        at = [i if (i := get(p)) is not None else learn(p) for p in self.pieces(text)]
        if self.arrays[0] != len(self.count):
            done, n, v = self.arrays
            self.arrays = (len(self.count), np.concatenate([n, self.count[done:]]), np.concatenate([v, np.array(self.vector[done:]).reshape(-1, 3)]))
        _, n, v = self.arrays
        idx = np.array(at)
        s = v[idx].sum(axis=0) / sqrt(len(at) / 3)
        return int(n[idx].sum()), *s.tolist()


@lru_cache(maxsize=2)
def measure(path: str) -> Measure:
    return Measure(path)


def hilbert_key(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of points with integer coordinates (n, d), 0 <= x < 2**bits."""
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def measured(documents: DataFrame, doc_id: str, text: str, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, curve: the size of each text and its place on the curve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = measure(tokenizer)
        for pdf in batches:
            if not len(pdf):
                continue
            got = np.array([m(t) for t in pdf["text"]], float).reshape(-1, 4)
            spread = np.array([[0.5 + 0.5 * erf(v / 1.4142) for v in row] for row in got[:, 1:]]).reshape(-1, 3)
            grid = np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": got[:, 0].astype(np.int64), "curve": hilbert_key(grid)})

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    return rows.mapInPandas(run, f"doc_id {documents.schema[doc_id].dataType.simpleString()}, n_tokens long, curve long")


class Packer:
    """Best fit, decreasing within windows, into containers of one capacity."""

    def __init__(self, capacity: int, keep_open: int = 512) -> None:
        self.capacity, self.keep_open = capacity, keep_open
        self.open: list[tuple[int, int]] = []  # (room, container), sorted
        self.made = 0

    def place(self, sizes: list[int]) -> list[list[tuple[int, int, int]]]:
        """For each item its parts (container, first token, tokens); only items beyond the capacity have several."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
        rest: list[tuple[int, int, int]] = []
        for k, n in enumerate(sizes):
            whole = n // self.capacity if n > self.capacity else 0
            for i in range(whole):
                out[k].append((self.made, i * self.capacity, self.capacity))
                self.made += 1
            if n - whole * self.capacity:
                rest.append((n - whole * self.capacity, k, whole * self.capacity))
        for n, k, start in sorted(rest, key=lambda x: (-x[0], x[1])):
            i = bisect.bisect_left(self.open, (n, -1))
            if i < len(self.open):
                room, container = self.open.pop(i)
            else:
                room, container = self.capacity, self.made
                self.made += 1
            out[k].append((container, start, n))
            if room > n:
                bisect.insort(self.open, (room - n, container))
        del self.open[: max(0, len(self.open) - self.keep_open)]  # the fullest can't take much more
        return out


def pack(documents: DataFrame, kinds: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "container_name", capacity: str = "capacity_tokens", tokenizer: str = TOKENIZER, window: int = WINDOW, partitions: int | None = None, kinds_at_once: int = 10_000) -> DataFrame:
    """container_name, container_no, doc_id, part_no, first_token, n_tokens: which tokens of which text go where.

    ``container_no`` is unique within a kind.  A text of at most the capacity is in one container; a
    larger one fills whole containers of its own and its remainder is packed like a text.

    Defined cases: null and empty texts have no tokens and are in no container; kinds with a null name,
    or a null or non-positive capacity, are left out, and of several kinds of one name the largest capacity
    holds; repeated rows are items of their own; an empty table gives an empty result; texts of any
    length are measured whole; extra columns are ignored.  The kinds are the only data taken to the
    driver; beyond ``kinds_at_once`` there is a pass over the measured texts for each so many.
    """
    spark = documents.sparkSession
    wanted = kinds.where(F.col(name).isNotNull() & (F.col(capacity) > 0)).groupBy(F.col(name).cast("string").alias("name")).agg(F.max(F.col(capacity).cast("long")).alias("c")).orderBy("name")
    items = materialise(measured(documents, doc_id, text, tokenizer), "measured")
    n = partitions or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + items.count() // 20_000))

    def run(sizes: list[tuple[str, int]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 40
        packers = [(kind, Packer(c)) for kind, c in sizes]
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            pdf = pd.concat(held, ignore_index=True)
            held.clear()
            ids = pdf["doc_id"].to_numpy()
            for a in range(0, len(pdf), window):
                part = pdf["n_tokens"].iloc[a : a + window].tolist()
                for kind, packer in packers:
                    placed = [(a + k, i, *p) for k, parts in enumerate(packer.place(part)) for i, p in enumerate(parts)]
                    if placed:
                        k, i, c, start, size = (np.array(x) for x in zip(*placed, strict=True))
                        yield pd.DataFrame({"container_name": kind, "container_no": task + c, "doc_id": ids[k], "part_no": i, "first_token": start, "n_tokens": size})

        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= window * 8:
                yield from flush()
        if held:
            yield from flush()

    ordered = items.repartitionByRange(n, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    schema = f"container_name string, container_no long, doc_id {documents.schema[doc_id].dataType.simpleString()}, part_no long, first_token long, n_tokens long"
    def bound(sizes: list[tuple[str, int]]):
        return lambda batches: run(sizes, batches)

    # more kinds than one task's packers should hold are packed in several passes over the measured texts
    passes, held = [], []
    for r in wanted.toLocalIterator():
        held.append((r["name"], int(r["c"])))
        if len(held) == kinds_at_once:
            passes.append(held)
            held = []
    passes += [held] if held or not passes else []
    return reduce(DataFrame.unionByName, [ordered.mapInPandas(bound(sizes), schema) for sizes in passes])


def broken_rules(documents: DataFrame, packed: DataFrame, kinds: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "container_name", capacity: str = "capacity_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """For each kind, how often a rule of packing is broken: over_full containers, texts split though they fit,
    texts whose parts don't cover each token once; and the number of texts packed."""
    size = kinds.groupBy(F.col(name).alias("container_name")).agg(F.max(F.col(capacity).cast("long")).alias("capacity"))
    full = packed.groupBy("container_name", "container_no").agg(F.sum("n_tokens").alias("held")).join(size, "container_name").groupBy("container_name").agg(F.count(F.when(F.col("held") > F.col("capacity"), 1)).alias("over_full"))
    spans = Window.partitionBy("container_name", "doc_id").orderBy("first_token")
    gap = F.col("first_token") != F.coalesce(F.lag(F.col("first_token") + F.col("n_tokens")).over(spans), F.lit(0))
    parts = packed.withColumn("gap", gap.cast("int")).groupBy("container_name", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"), F.sum("gap").alias("gaps"))
    counted = measured(documents, doc_id, text, tokenizer).select("doc_id", F.col("n_tokens").alias("all_tokens"))
    each = parts.join(counted, "doc_id", "full").join(size, "container_name", "left")
    rules = each.groupBy("container_name").agg(
        F.count(F.when((F.col("parts") > 1) & (F.col("all_tokens") <= F.col("capacity")), 1)).alias("split"),
        F.count(F.when((F.col("gaps") > 0) | ~F.col("tokens").eqNullSafe(F.col("all_tokens")), 1)).alias("uncovered"),
        F.count("*").alias("texts"),
    )
    return full.join(rules, "container_name", "full")


def fill_report(packed: DataFrame, kinds: DataFrame, name: str = "container_name", capacity: str = "capacity_tokens") -> DataFrame:
    """For each kind: containers, tokens, the share of their room that is filled, the least containers possible."""
    used = packed.groupBy("container_name").agg(F.countDistinct("container_no").alias("containers"), F.sum("n_tokens").alias("tokens"))
    size = kinds.groupBy(F.col(name).alias("container_name")).agg(F.max(F.col(capacity).cast("long")).alias("capacity"))
    got = used.join(size, "container_name")
    return got.select("container_name", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least"))
