"""Benchmark decontamination by SimHash windows.

Words are runs of letters and digits of the lower-cased text. A window has as many words as the
item it is held against. Windows and items have 64-bit SimHash fingerprints of their weighted 5-word
shingles. Items are found by multi-index Hamming blocks: a fingerprint within RADIUS of an item differs
from it in some of the BLOCKS by at most RADIUS // BLOCKS bits, so every block's hash table lists an item
under all values within that many bits of its own, and looking up the window's values misses none. What
is found is verified by the exact weighted Jaccard similarity of the shingle multisets (0.8 or more).

An addition to the method, which costs no result: windows that share no shingle with any item have
similarity 0, so only windows around shared shingles are fingerprinted. A radius of 20 of 64 bits, which
similarity 0.8 needs, lets the tables admit about half of the items of a length; the shared shingles
keep the number of windows small.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import rows_of, table, work_table

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 20
#: Bits of each block: 64 in seven, which are probed within two bits like eight would be, at fewer values.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
#: Words with shared shingles that are looked at together, so that a task's memory is bounded by this and by the
#: longest item, however long the text. Windows over an edge are judged twice.
STRETCH = 8192
#: Pairs of a window and an item that are held against each other at once.
PAIRS = 1 << 19
#: Text of items held in each task at once; a larger benchmark runs in as many parts as it takes.
PART_BYTES = 8_000_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str], width: int = WIDTH) -> list[str]:
    """Runs of ``width`` words, repeats included; fewer words: the whole sequence; none: nothing."""
    if len(words) <= width:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def hash_of(shingle: str) -> int:
    return xxhash.xxh64_intdigest(shingle.encode("utf-8", "surrogatepass"), 42)


def _bits(of: list[str]) -> np.ndarray:
    """+1 and -1 by bit of each shingle's hash."""
    hashes = np.array([hash_of(s) for s in of], np.uint64)
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1, bitorder="little")


def _fold(marks: np.ndarray) -> np.ndarray:
    """Packed fingerprints (n, 8) as unsigned numbers."""
    return np.ascontiguousarray(marks).view("<u8").reshape(-1)


def _block(prints: np.ndarray, k: int) -> np.ndarray:
    return (prints >> np.uint64(sum(BLOCKS[:k]))) & np.uint64((1 << BLOCKS[k]) - 1)


class Tables:
    """Hash tables of some items' fingerprints, one a block: value -> the items whose block differs from it in
    at most RADIUS // len(BLOCKS) bits, as a bitmap over the items (some 450 bytes an item in all)."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.near = prints, []
        for k, bits in enumerate(BLOCKS):
            own, values = _block(prints, k).astype(np.uint16), np.arange(1 << bits, dtype=np.uint16)
            self.near.append(np.packbits(np.bitwise_count(values[:, None] ^ own[None, :]) <= RADIUS // len(BLOCKS), axis=1))

    def search(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item): places in ``prints`` and items within RADIUS, in batches, each pair once."""
        n = len(self.prints)
        batch = max(1, PAIRS // n)
        for low in range(0, len(prints), batch):
            some = prints[low : low + batch]
            hit = self.near[0][_block(some, 0)]
            for k in range(1, len(BLOCKS)):
                hit |= self.near[k][_block(some, k)]
            at, item = np.nonzero(np.unpackbits(hit, axis=1, count=n))
            close = np.bitwise_count(some[at] ^ self.prints[item]) <= RADIUS
            yield at[close] + low, item[close]


class Spread(NamedTuple):
    """In how many items of the whole benchmark a shingle is: the number of items, and the sorted hashes and
    numbers of the shingles in two or more. A shingle in one item weighs what one in none does."""

    items: int
    hashes: np.ndarray
    numbers: np.ndarray

    def weight(self, shingle: str) -> float:
        h = np.uint64(hash_of(shingle))
        at = np.searchsorted(self.hashes, h)
        return math.log1p(self.items / (int(self.numbers[at]) if at < len(self.hashes) and self.hashes[at] == h else 1))


class Items:
    """Benchmark items, ready to be searched. ``whole``: the spread of shingles where these are a part only."""

    def __init__(self, items: list[tuple[int, str]], whole: Spread | None = None):
        known = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.ids = [i for i, _ in known]
        self.bags = [Counter(shingles(w)) for _, w in known]
        self.lengths = np.array([len(w) for _, w in known], np.int64)
        spread = Counter(s for bag in self.bags for s in bag)
        self.whole = whole
        self.weights = {s: whole.weight(s) if whole else math.log1p(len(known) / n) for s, n in spread.items()}
        self.other = math.log1p(len(known))  # the weight of a shingle that no item has
        self.starts: dict[str, set[str]] = defaultdict(set)  # first word -> shingles; short items have shorter ones
        for s in self.weights:
            self.starts[s.split(" ", 1)[0]].add(s)
        self.short = sorted({len(w) for _, w in known if len(w) < WIDTH})
        marks = [_pack((_bits(list(bag)) * np.array([[n * self.weights[s]] for s, n in bag.items()])).sum(0)) for bag in self.bags]
        prints = _fold(np.array(marks, np.uint8).reshape(-1, 8))
        self.by_length = {}
        for n in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == n)
            self.by_length[int(n)] = (own, Tables(prints[own]))

    def weight(self, shingle: str) -> float:
        found = self.weights.get(shingle)
        if found is None:
            return self.whole.weight(shingle) if self.whole else self.other
        return found

    def similarity(self, bag: Counter, item: int) -> float:
        """Weighted Jaccard of two multisets of shingles."""
        theirs = self.bags[item]
        both = sum(min(n, theirs[s]) * self.weight(s) for s, n in bag.items() if s in theirs)
        total = sum(n * self.weight(s) for s, n in bag.items()) + sum(n * self.weight(s) for s, n in theirs.items())
        return both / (total - both) if total > both else 1.0

    def shared(self, words: list[str]) -> dict[int, list[int]]:
        """Shingle width -> places where the document has a shingle of some item."""
        found = defaultdict(list)
        starts = self.starts
        for at in [i for i, w in enumerate(words) if w in starts]:
            for width in (WIDTH, *self.short):
                piece = words[at : at + width]
                if len(piece) == width and " ".join(piece) in starts[words[at]]:
                    found[width].append(at)
        return found

    def search(self, words: list[str]) -> dict[int, tuple[float, int]]:
        """Item -> (best similarity, first such window's start)."""
        out: dict[int, tuple[float, int]] = {}
        longest = int(self.lengths.max(initial=0))
        for width, places in self.shared(words).items():
            at = np.array(places)
            for run in np.split(at, np.flatnonzero((np.diff(at) > longest) | (np.diff(at // STRETCH) > 0)) + 1):
                self._region(words, width, int(run[0]), int(run[-1]), longest, out)
        return out

    def _region(self, words, width, first, last, longest, out) -> None:
        """All windows that hold one of the shared shingles at the places first..last."""
        low = max(0, first - longest)
        pieces = shingles(words[low : last + longest + width], width)
        weights = np.array([[self.weight(s)] for s in pieces])
        sums = np.concatenate([np.zeros((1, 64)), np.cumsum(_bits(pieces) * weights, axis=0)])
        for n, (own, tables) in self.by_length.items():
            size = min(n, len(words))  # a text shorter than the item is one window
            if min(WIDTH, n) != width or size < width:
                continue
            count = size - width + 1
            start, stop = max(0, first - count + 1), min(last, len(words) - size) + 1
            marks = _pack(sums[start - low + count : stop - low + count] - sums[start - low : stop - low])
            for at, item in tables.search(_fold(marks)):
                for w, i in zip(at.tolist(), own[item].tolist(), strict=True):
                    bag = Counter(pieces[start - low + w : start - low + w + count])
                    similarity = self.similarity(bag, i)
                    if similarity >= SIMILARITY and similarity > out.get(i, (0.0, 0))[0]:
                        out[i] = (similarity, start + w)


def _spread(items: DataFrame) -> Spread:
    """Counted by Spark over all ``items``; twelve bytes for every shingle of two or more items are held."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([[h - (1 << 63) for h in {hash_of(s) for s in shingles(words_of(t))}] for t in texts])

    hashed = work_table(items.select(hashes("text").alias("hashes")).where(F.size("hashes") > 0), "item-shingles")
    shared = hashed.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").cast("int").alias("n")).where("n > 1").toPandas()
    shared = shared.sort_values("h")
    return Spread(hashed.count(), shared.h.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63), shared.n.to_numpy(np.int32))


def _parts(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark in parts of about PART_BYTES, each shared with all tasks; every part comes with the
    spread of shingles over all of them."""
    items = rows_of(benchmark, item_id="item_id", text="text").where("text is not null and item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size // PART_BYTES))
    whole = _spread(items) if parts > 1 else None
    for part in range(parts):
        held = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).select("item_id", "text").collect()  # about PART_BYTES
        yield benchmark.sparkSession.sparkContext.broadcast((sorted((int(r.item_id), r.text) for r in held), whole))


def _found(shared: Broadcast, text: F.Column | str) -> F.Column:
    """array<struct>: the benchmark items in each whole text, by item_id."""

    @F.pandas_udf("array<struct<item_id: long, similarity: double, start_word: long, n_words: long>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Items(*shared.value)
        for texts in batches:
            found = [known.search(words_of(t)) for t in texts]
            yield pd.Series([[{"item_id": known.ids[i], "similarity": s, "start_word": at, "n_words": int(known.lengths[i])} for i, (s, at) in sorted(f.items())] for f in found])

    return find(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of every document and item
    with similarity 0.8 or more.

    The benchmark is held in each task in parts of about PART_BYTES, one pass over the documents a
    part. Null and wordless texts on either side match nothing, nor do items without an id. Rows of
    repeated doc_ids are judged each by itself; repeated item_ids too. Other input columns are
    ignored.
    """
    rows = rows_of(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    out = [rows.select("doc_id", F.inline(_found(shared, "text"))) for shared in _parts(benchmark)]
    return reduce(DataFrame.unionAll, out)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) whose text holds no benchmark item."""
    for shared in _parts(benchmark):
        docs = docs.where(F.size(_found(shared, "text")) == 0)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` in every row of ``documents``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
