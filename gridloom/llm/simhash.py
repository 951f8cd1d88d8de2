"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits. Its embedding is the number of one bits
of every segment, kept as a thermometer code (0 -> 00, 1 -> 01, 2 -> 11), so that the Manhattan
distance of two embeddings is the number of differing bits of their codes. It never exceeds the
Hamming distance of the fingerprints.

Range join under Manhattan distance ``radius``: the 32 coordinates form ``radius + shared`` groups. A
pair within the radius differs in at most ``radius`` groups, so it shares at least ``shared`` whole
ones: the cells of the grids over every choice of that many groups meet every pair. More groups mean
finer cells and more grids (radius 3: 10 grids of some 2**19 cells, 20 of 2**24, 56 of 2**30, 220 of
2**36); the number follows from the number of distinct fingerprints, so that cells stay small at any
size, and never changes which pairs are found. Inside a cell the Manhattan distance prunes, then the
Hamming distance decides.

Cells with more than ``HOT`` distinct fingerprints are dealt into blocks; every pair of blocks is a
small task row of its own that returns only a spanning forest of its links. So no cell is collected
whole; a member of a cell of m fingerprints takes part in m / HOT such rows. Equal fingerprints are
merged before anything else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridloom.llm.graph import connected_components
from gridloom.llm.work import join_hot, rows_of, table, work_table

SEED = 42
HOT = 64
PIECE = 1 << 15


def shingles(words: list[bytes], width: int) -> Iterator[bytes]:
    """Space-joined runs of ``width`` words; fewer words: the whole sequence; none: nothing."""
    if len(words) <= width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) text; null or no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # splits at \x20, \x09-\x0D only
    n = max(len(words) - width + 1, min(len(words), 1))
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles(words, width)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), one row per input row."""

    @F.pandas_udf(LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    rows = rows_of(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", fp("text").alias("fp"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


LOW = 0x5555555555555555  # the lower bit of every segment


def thermometer(fp: Column) -> Column:
    """The packed per-segment counts of one bits."""
    half = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseOR(half).bitwiseAND(F.lit(LOW))
    two = fp.bitwiseAND(half).bitwiseAND(F.lit(LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def shared_groups(n: int, radius: int) -> int:
    """How many groups a cell shares, so that ``n`` fingerprints fill it with about four or fewer: a
    segment's count tells one and a half bits."""
    for shared in (2, 3, 5, 9):
        if 48 * shared / (radius + shared) >= math.log2(max(n, 1)) - 2:
            return shared
    return 12


def grid_masks(radius: int, shared: int = 3) -> list[int]:
    """For every choice of ``shared`` of ``radius + shared`` groups of segments, the bits of their codes."""
    groups = [sum(0b11 << (2 * int(s)) for s in part) for part in np.array_split(range(32), radius + shared)]
    return [signed(sum(groups[g] for g in some)) for some in combinations(range(radius + shared), shared)]


def spanning_forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of a symmetric boolean matrix that join what all of its links join."""
    left, out = np.ones(len(near), bool), []
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start], front = False, [start]
        while front:
            at = front.pop()
            fresh = np.flatnonzero(near[at] & left)
            left[fresh] = False
            front.extend(fresh.tolist())
            out.extend((at, int(x)) for x in fresh)
    return out


def _forest(block: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among one block's distinct fingerprints."""
    fp = block.view(np.uint64)
    half = fp >> np.uint64(1)
    code = ((fp | half) & np.uint64(LOW)) | ((fp & half & np.uint64(LOW)) << np.uint64(1))
    near = np.bitwise_count(code[:, None] ^ code[None, :]) <= radius
    near &= np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    return [(int(block[i]), int(block[j])) for i, j in spanning_forest(near)]


def links(unique: DataFrame, radius: int = 3, shared_of: int | None = None) -> DataFrame:
    """``unique`` (fp, distinct) -> (a, b): links whose components are those of all pairs within
    ``radius``. Cells of at most HOT fingerprints give all their pairs, larger ones a forest.
    ``shared_of`` sets the number of groups that a cell shares; else shared_groups() does."""
    masks = grid_masks(radius, shared_of or shared_groups(unique.count(), radius))
    cells = F.array(*[F.struct(F.lit(k).alias("grid"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)])
    keyed = unique.select("fp", thermometer(F.col("fp")).alias("code")).select("fp", "code", F.inline(cells))
    sizes = keyed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = work_table(keyed.join(sizes, ["grid", "cell"]), "cells")

    cold = shared.where(F.col("n") <= HOT)
    left = cold.select("grid", "cell", F.col("fp").alias("a"), F.col("code").alias("a_code"))
    right = cold.select("grid", "cell", F.col("fp").alias("b"), F.col("code").alias("b_code"))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    pairs = left.join(right, ["grid", "cell"]).where("a < b").where(apart("a_code", "b_code") <= radius).where(apart("a", "b") <= radius).select("a", "b")

    blocks = F.ceil(F.col("n") / HOT).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    hot = shared.where(F.col("n") > HOT).withColumn("blocks", blocks).withColumn("own", own)
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hot = hot.groupBy("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for fps in batch.fps for x in _forest(np.asarray(fps, dtype=np.int64), radius)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return pairs.unionAll(hot.select("fps").mapInPandas(forests, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents linked at ``radius`` or fewer differing bits.

    component_id is the smallest doc_id that links reach, the document itself included. Null and
    empty texts have fingerprint 0 and link like any other. Every input row returns, repeated
    doc_ids included; a null doc_id stays null and names a component only if it has no other.
    Other columns of the input are ignored.
    """
    prints = work_table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    unique = work_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "unique")
    roots = connected_components(links(unique.select("fp"), radius))
    linked = work_table(roots.select(F.col("node").alias("fp"), "root").join(unique.drop("n"), "fp"), "linked")
    tops = work_table(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "tops")
    named = join_hot(linked, tops, ["root"], linked.count()).select("fp", "component_id")
    named = unique.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return join_hot(prints, work_table(named, "named"), ["fp"], prints.count()).select("doc_id", "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
