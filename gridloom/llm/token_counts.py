"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both agree.

A byte-level tokenizer cuts a text from left to right into pieces by a pattern that looks no further
back than the piece's start and a few characters ahead, and encodes every piece alone. So what follows a
position depends on the text from there on only, if the position is a boundary of pieces. Two overlapping chunks
that share such a boundary agree from there on: the first is right up to it (by induction from the
document's start), the second from it on. A boundary close to a chunk's end proves nothing, as the
pattern or a special string may reach over the end: the longest special string and MARGIN characters are
left out. Where an overlap holds no common boundary (one long word, say), the second chunk
starts GROW times further back, and takes the first one in when it reaches its start.

Chunks are rows, so that many tasks share a huge document; a chunk gives back its number of tokens and
the boundaries in its overlaps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokens import BYTE_SPEC, encoder, public_path
from gridloom.llm.work import partitions_for, rows_of, table, work_table

#: Longer texts (UTF-8 bytes) go in chunks of CHUNK characters that overlap by OVERLAP.
HUGE, CHUNK, OVERLAP, GROW = 1 << 14, 1 << 13, 256, 8
#: Characters behind a piece that the pattern may look at: two of a contraction's three, one behind white space.
MARGIN = 3
COUNTS = "doc_id long, n_bytes long, n_tokens long"
MARKS = "uid long, chunk int, chunks int, n_tokens long, heads array<struct<at: long, before: long>>, tails array<struct<at: long, behind: long>>"
SPANS = "uid long, starts array<long>, stops array<long>"


def splice_margin(path: str) -> int | None:
    """Characters before a chunk's end where boundaries prove nothing, or None if the tokenizer's texts
    can't be spliced: another kind of tokenizer, one that adds or drops ids around a text, and one with
    added strings that look at what stands around them or overlap themselves."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["model"]["dropout"] or (spec["normalizer"], spec["pre_tokenizer"]) != BYTE_SPEC:
        return None
    if spec["post_processor"] or spec["truncation"] or spec["padding"]:
        return None
    added = [t["content"] for t in spec["added_tokens"]]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    if any(a[i:] == b[: len(a) - i] or b in a[i:] for a in added for b in added for i in range(1, len(a))):
        return None
    return max([0, *map(len, added)]) + MARGIN


@lru_cache(maxsize=2)
def _pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def n_tokens(path: str, text: str | None) -> int:
    """Tokens of one text as the path's library gives them, without begin, end or added special tokens."""
    if not text:
        return 0
    return len(encoder(path).encode(text)) // 4 if path.endswith(".json") else len(_pieces(path).encode(text))


def boundaries(path: str, text: str) -> tuple[int, list[tuple[int, int]]]:
    """Tokens of a chunk, and (character, tokens before it) of every start of a piece."""
    found = encoder(path).tokenizer.encode(text, add_special_tokens=False)
    piece, spans = found.word_ids, found.offsets
    return len(piece), [(spans[i][0], i) for i in range(len(piece)) if not i or piece[i] != piece[i - 1]]


def widened(starts: list[int], stops: list[int], failed: set[int]) -> tuple[list[int], list[int]]:
    """Spans in which every chunk of ``failed`` overlaps its predecessor GROW times as far; one that
    reaches the predecessor's start takes it in."""
    out: list[tuple[int, int]] = []
    for k, (start, stop) in enumerate(zip(starts, stops, strict=True)):
        if k in failed:
            start = max(stops[k - 1] - GROW * (stops[k - 1] - start), starts[k - 1])
            if start <= starts[k - 1]:
                start = out.pop()[0]
        out.append((start, stop))
    return [a for a, _ in out], [b for _, b in out]


def _marked(texts: DataFrame, spans: DataFrame | None, tokenizer: str, margin: int) -> DataFrame:
    """MARKS of every chunk: ``heads`` are boundaries in the overlap with the chunk before, ``tails`` in
    that with the next, both as characters of the document; ``before`` are minus the tokens before a
    boundary, ``behind`` minus those behind it."""
    cut = texts.join(spans, "uid") if spans is not None else texts
    one = F.explode(F.sequence(F.lit(0), F.size("starts") - 1)).alias("chunk")
    rows = cut.select("uid", "text", "starts", "stops", F.size("starts").alias("chunks"), one)
    at = lambda c, k: F.get(c, F.col("chunk") + k)
    rows = rows.select("uid", "chunk", "chunks", at("starts", 0).alias("start"), at("stops", -1).alias("head"), at("starts", 1).alias("tail"), F.substring("text", at("starts", 0) + 1, at("stops", 0) - at("starts", 0)).alias("part"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uid, chunk, chunks, start, head, tail, part in zip(*[batch[c] for c in ("uid", "chunk", "chunks", "start", "head", "tail", "part")], strict=True):
                n, found = boundaries(tokenizer, part)
                sure = [(start + p, c) for p, c in found if p <= len(part) - margin]
                heads = [(p, -c) for p, c in sure if p <= head] if chunk else []
                tails = [(p, c - n) for p, c in sure if p >= tail] if chunk + 1 < chunks else []
                out.append((uid, chunk, chunks, n, heads, tails))
            yield pd.DataFrame(out, columns=["uid", "chunk", "chunks", "n_tokens", "heads", "tails"])

    return rows.repartition(partitions_for(texts.sparkSession), "uid", "chunk").mapInPandas(encode, MARKS)


def _spliced(texts: DataFrame, tokenizer: str, margin: int, chunk: int, overlap: int) -> DataFrame:
    """(uid, n_tokens) of texts of any length over ``chunk``. Rounds end when every overlap holds a common
    boundary; a round that fails makes an overlap GROW times as wide, up to the whole text."""
    first = F.sequence(F.lit(0).cast("long"), F.ceil(F.length("text") / chunk) - 1)
    starts = F.transform(first, lambda k: F.greatest(k * chunk - overlap, F.lit(0)).cast("long"))
    stops = F.transform(first, lambda k: F.least((k + 1) * chunk, F.length("text")).cast("long"))
    texts, done = texts.select("uid", "text"), []
    spans = work_table(texts.select("uid", starts.alias("starts"), stops.alias("stops")), "spans")
    while True:
        marks = work_table(_marked(texts, spans, tokenizer, margin), "marks")
        tails = marks.select("uid", (F.col("chunk") + 1).alias("chunk"), F.inline("tails"))
        heads = marks.select("uid", "chunk", F.inline("heads"))
        seams = tails.join(heads, ["uid", "chunk", "at"]).groupBy("uid", "chunk").agg(F.min(F.struct("at", (F.col("before") + F.col("behind")).alias("gain")))["gain"].alias("gain"))
        sums = marks.select("uid", "chunk", "chunks", "n_tokens").join(seams, ["uid", "chunk"], "left")
        failed = F.collect_set(F.when((F.col("chunk") > 0) & F.col("gain").isNull(), F.col("chunk")))  # at most a number a chunk
        sums = work_table(sums.groupBy("uid").agg(F.sum(F.col("n_tokens") + F.coalesce("gain", F.lit(0))).alias("n_tokens"), failed.alias("failed")), "sums")
        done.append(sums.where(F.size("failed") == 0).select("uid", "n_tokens"))
        again = spans.join(sums.where(F.size("failed") > 0).select("uid", "failed"), "uid")

        def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(u, *widened(list(a), list(b), set(f))) for u, a, b, f in zip(batch.uid, batch.starts, batch.stops, batch.failed, strict=True)]
                yield pd.DataFrame(rows, columns=["uid", "starts", "stops"])

        spans = work_table(again.mapInPandas(widen, SPANS), "spans")
        if spans.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """COUNTS rows, one per input row: UTF-8 bytes and tokens of the whole text.

    A null or empty text has no bytes and no tokens. Repeated and null ids are rows like any other;
    other input columns are ignored, whatever their names; an empty table gives no rows. Texts of over
    ``huge`` bytes are encoded in chunks and counted exactly as the library counts the whole text; the
    chunks are cut by position, which takes time in proportion to length times number of chunks (seconds at
    10 MB). A tokenizer whose texts can't be spliced (splice_margin) encodes every text whole."""
    margin = splice_margin(tokenizer)
    text = F.coalesce("text", F.lit(""))
    rows = rows_of(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["n_tokens"] = [n_tokens(tokenizer, t) for t in batch.pop("text")]
            yield batch.astype({"doc_id": "Int64"})

    if margin is None:
        return rows.mapInPandas(count, COUNTS)
    small = rows.where(F.col("n_bytes") <= huge).mapInPandas(count, COUNTS)
    texts = work_table(rows.where(F.col("n_bytes") > huge).withColumn("uid", F.monotonically_increasing_id()), "huge")
    spliced = _spliced(texts, tokenizer, margin, chunk, overlap)
    return small.unionByName(texts.select("uid", "doc_id", "n_bytes").join(spliced, "uid").select("doc_id", "n_bytes", "n_tokens"))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of ``documents``; over_limit: more than 512 tokens."""
    found = token_counts(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)
