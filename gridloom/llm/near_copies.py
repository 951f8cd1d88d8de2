"""Groups of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two sides. SimHash: fingerprints of the five-word shingles within radius 3, by the
segment-popcount range join. A 64-bit SimHash of two texts at similarity 0.8 differs in about ten
bits, though, and no grid finds such pairs without nearly all others, so min-wise samples of the same
shingle hashes are added: 16 bands of 4 minima, of which a pair at 0.8 shares one with probability
0.9998. Every candidate pair is verified exactly on the whole texts; groups are the components of
the verified pairs.

A band's bucket of up to ALL_PAIRS different texts gives all its pairs. In a larger bucket every text is
held against two leaders: the most central one (whose buckets are the largest over all bands: for
edited copies of one source that is the source) and one by hash. That joins most buckets to one group;
where it does not, the members are dealt into blocks, and every pair of blocks is a small task row of its
own, in which all pairs of members of different groups are held against each other and a spanning forest
of their links returned. So no pair of a bucket is left out that could join two groups, no bucket is
collected whole, and no row is made per pair. Copies of a text are one node from the start.

Similarities are exact: the numbers of common and of all shingles, told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.graph import connected_components
from gridloom.llm.simhash import SEED, fingerprint, links, shingles, spanning_forest
from gridloom.llm.work import join_hot, rows_of, work_table

BANDS, ROWS = 16, 4
ALL_PAIRS = 8
#: Members of a block, and shingles in it, about.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Cells of a matrix of members by shingles that is multiplied at once.
CELLS = 1 << 23
_rng = np.random.default_rng(5)
MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bands(text: str | None, width: int = 5) -> list[int]:
    """A 64-bit key for every band of minima; no words: the same keys for all such texts."""
    words = words_of(text)
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(words, width)], np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * MULTIPLY + ADD
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    keys = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(k.tobytes(), b) - (1 << 63) for b, k in enumerate(keys)]


def jaccard(a: str | None, b: str | None, width: int = 5) -> float:
    x, y = (set(shingles(words_of(t), width)) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _bucket_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of nodes to verify, from their bands; and (band, key, node): the members of large
    buckets."""
    member = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = member.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = work_table(member.join(sizes, ["band", "key"]), "members")
    small = member.where(F.col("n") <= ALL_PAIRS)
    pairs = small.select("band", "key", F.col("node").alias("a")).join(small.select("band", "key", F.col("node").alias("b")), ["band", "key"]).where("a < b").select("a", "b")
    weight = member.groupBy("node").agg(F.sum("n").alias("weight"))
    large = member.where(F.col("n") > ALL_PAIRS).join(weight, "node")
    leaders = large.groupBy("band", "key").agg(F.max(F.struct("weight", "node")).alias("central"), F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node")).alias("chosen"))
    leaders = leaders.select("band", "key", F.explode(F.array("central.node", "chosen.node")).alias("b"))
    led = large.select("band", "key", F.col("node").alias("a")).join(leaders, ["band", "key"]).where("a <> b")
    return pairs.unionAll(_ordered(led)).distinct(), work_table(large.select("band", "key", "node"), "large-buckets")


def _undecided(left: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, key, node, root): the members of buckets that still hold more than one group."""
    member = left.join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root"))
    several = member.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return work_table(member.join(several.select("band", "key"), ["band", "key"]), "undecided")


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` with groups joined by the links ``found``: only the groups' roots are looked at, each once."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    tops = connected_components(between).select(F.col("node").alias("old"), F.col("root").alias("top"))
    kept = roots.join(tops.withColumnRenamed("old", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = tops.join(roots.select(F.col("root").alias("old")).distinct(), "old", "left_anti").select(F.col("old").alias("node"), F.col("top").alias("root"))
    return work_table(kept.unionByName(alone), "roots")


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles' hashes of a text, in order."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(words_of(text), width)], np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ordered sets of hashes; of two empty ones 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes every two of the sets share."""
    sizes = np.array([len(x) for x in sets])
    found, place, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = number > 1
    column = np.cumsum(use) - 1
    rows, columns = np.repeat(np.arange(len(sets)), sizes)[use[place]], column[place[use[place]]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, CELLS // len(sets))
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for low in range(0, int(use.sum()), step):
        at = slice(*np.searchsorted(columns, [low, low + step]))
        part = np.zeros((len(sets), min(step, int(use.sum()) - low)), np.float32)
        part[rows[at], columns[at] - low] = 1
        out += part @ part.T
    return out


def block_links(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links at ``similarity`` or more between members of different roots."""
    sizes = np.array([len(x) for x in sets], np.float64)
    both = common(sets)
    every = sizes[:, None] + sizes[None, :] - both
    near = (both >= similarity * every - 1e-9) & (roots[:, None] != roots[None, :])
    return spanning_forest(near)


def _all_pairs(member: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between members (band, key, node, root) of one bucket and different roots."""
    rows = member.join(sets, "node").withColumn("size", F.octet_length("hashes") / 8)
    total = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    dealt = rows.select("band", "key", "node", "root", "hashes").join(total.select("band", "key", blocks), ["band", "key"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "hashes")

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        nodes, roots = group.node.to_numpy(np.int64), group.root.to_numpy(np.int64)
        found = block_links([np.frombuffer(x, "<u8") for x in group.hashes], roots, similarity)
        return pd.DataFrame({"a": nodes[[i for i, _ in found]], "b": nodes[[j for _, j in found]]}, dtype="int64")

    return dealt.groupBy("band", "key", "i", "j").applyInPandas(judge, "a long, b long")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of equal fingerprint against the smallest, and the smallest of linked fingerprints."""
    first = work_table(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select("fp")).distinct()
    ends = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("fb")), "b")
    return same.unionAll(ends.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")))


def near_copy_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, doc_id, group): one row per input row; k1, k2 are hashes of id and text, group a long.

    Texts without words are one group. Null ids and repeated rows are kept as rows; other input
    columns are ignored; an empty table gives no rows.
    """
    keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("again"), "doc_id", "text").alias("k2")]
    rows = rows_of(docs, doc_id=id_col, text=text_col)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("text")
            batch["node"] = [xxhash.xxh64_intdigest(b" ".join(words_of(t)), SEED) - (1 << 63) for t in texts]
            batch["fp"] = [fingerprint(t, width) for t in texts]
            batch["bands"] = [bands(t, width) for t in texts]
            yield batch

    kind = "doc_id long, k1 long, k2 long, node long, fp long, bands array<long>"
    sketched = work_table(rows.select(F.col("doc_id").cast("long"), *keys, "text").mapInPandas(sketch, kind), "sketches")
    nodes = sketched.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("k1", "k2")).alias("k"), F.count("*").alias("n"))
    nodes = work_table(nodes, "nodes")
    pairs, left = _bucket_pairs(nodes)
    pairs = work_table(pairs.unionAll(_simhash_pairs(nodes)).distinct(), "pairs")

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()  # all members of large buckets among them
    holder = nodes.join(asked, "node", "left_semi").select("node", "k.k1", "k.k2")
    texts = rows.select(*keys, "text").join(holder, ["k1", "k2"]).groupBy("node").agg(F.min("text").alias("text"))

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, width).tobytes() for t in texts])

    sets = work_table(texts.select("node", hashed("text").alias("hashes")), "candidate-shingles")

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= similarity - 1e-12 for x, y in zip(a, b, strict=True)])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    roots = connected_components(work_table(both.where(similar("x", "y")).select("a", "b"), "verified"))
    several = _undecided(left, roots)
    if not several.isEmpty():
        roots = _joined(roots, work_table(_all_pairs(several, sets, similarity), "verified"))
    named = work_table(nodes.select("node", "n").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group"), "n"), "groups")
    return join_hot(sketched.select("k1", "k2", "doc_id", "node"), named, ["node"], sketched.count()).select("k1", "k2", "doc_id", "group")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without near copies: of every group the row of
    the smallest doc_id stays (null ids last, then by hash), once."""
    taken = {c.lower() for c in docs.columns}
    names = [next(n for k in range(len(taken) + 1) if (n := f"_{kind}{'_' * k}") not in taken) for kind in ("k1", "k2")]
    groups = near_copy_groups(docs, width, similarity)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("k"))
    kept = first.select(F.col("k.k1").alias(names[0]), F.col("k.k2").alias(names[1]))
    keyed = docs.withColumns({names[0]: F.xxhash64("doc_id", "text"), names[1]: F.xxhash64(F.lit("again"), "doc_id", "text")})
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).select(*docs.columns)
