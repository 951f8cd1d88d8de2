"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens is n + n * n / QUADRATIC (linear layers plus attention). Full-length
pieces are cut off first and are sequences by themselves. What remains of every document is dealt
by hash into groups of about GROUP_TOKENS tokens; in a group, pieces in descending order of length
go to the sequence of the lowest cost that has room, and are cut where the room ends. A group
opens just as many sequences as its tokens need, so padding is less than one sequence a group.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokens import encoder, public_path
from gridloom.llm.work import rows_of, table, work_table

QUADRATIC = 4096
GROUP_TOKENS = 1 << 19
PIECES = "doc_id long, uid long, doc_tokens long, start long, length long, ids_crc32 long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: int) -> float:
    return n + n * n / QUADRATIC


def place(lengths: list[int], room: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, cut start, cut length, sequence, offset) for pieces of the given lengths."""
    total = sum(lengths)
    if not total:
        return []
    heap = [(0.0, s, 0) for s in range(-(-total // room))]
    out = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, left = 0, lengths[piece]
        while left:
            spent, s, filled = heapq.heappop(heap)
            take = min(left, room - filled)
            out.append((piece, at, take, s, filled))
            at, left, filled = at + take, left - take, filled + take
            if filled < room:
                heapq.heappush(heap, (spent + cost(take), s, filled))
    return out


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, room: int, id_col: str, text_col: str) -> DataFrame:
    """Full pieces (ids null) and the rest of each document (with its ids)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc_id, uid, text in zip(batch.doc_id, batch.uid, batch.text, strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for at in range(0, n - n % room, room):
                    rows.append((doc_id, uid, n, at, room, zlib.crc32(ids[4 * at : 4 * (at + room)]), None))
                if n % room:
                    at = n - n % room
                    rows.append((doc_id, uid, n, at, n - at, zlib.crc32(ids[4 * at :]), ids[4 * at :]))
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    rows = rows_of(docs, doc_id=id_col, text=text_col).withColumn("uid", F.monotonically_increasing_id())
    return rows.select(F.col("doc_id").cast("long"), "uid", "text").mapInPandas(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PACKED rows, one per piece. ``end_id`` follows every document; a null text is empty and so
    is that one id. Repeated and null doc_ids are documents of their own; other input columns are
    ignored; an empty table gives no rows."""
    pieces = work_table(tokenised(docs, tokenizer, end_id, room, id_col, text_col), "pieces")
    whole = pieces.where("ids is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where("ids is not null")
    tokens = rest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    groups = max(1, round(tokens / GROUP_TOKENS))

    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["uid", "start"], ignore_index=True)
        base = (1 << 62) + (int(group.bin.iloc[0]) << 24)
        rows = []
        for piece, at, n, sequence, offset in place(group.length.tolist(), room):
            ids = group.ids[piece][4 * at : 4 * (at + n)]
            rows.append((group.doc_id[piece], group.start[piece] + at, n, zlib.crc32(ids), group.doc_tokens[piece], base + sequence, offset))
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    packed = rest.withColumn("bin", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("long")).groupBy("bin").applyInPandas(pack_group, PACKED)
    return work_table(whole.unionByName(packed), "packed")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of every row of ``documents`` in sequences of 2048."""
    return pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=1, room=2048)
