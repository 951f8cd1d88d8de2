"""Token ids in seekable files: independent zstandard frames and a trailing seek table.

A file holds, for consecutive documents, one frame each (its ids, little-endian unsigned 32-bit),
then an index frame (per document: id, whether the id is null, number of ids), then a skippable
frame with the seek table of the public zstd seekable format: compressed size, uncompressed size and
checksum (low 32 bits of XXH64 of the content) of every frame, number of frames, descriptor, magic.
A reader takes the table from the end of the file and decompresses only the frames asked for.

Files are numbered in ascending order of document id (nulls first, equal ids by a hash of the text).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.tokens import encoder, public_path
from gridloom.llm.work import partitions_for, rows_of, table, work_path, work_table

# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n_tokens", "<u4")])


def _digest(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class Writer:
    """Appends documents to an open binary stream; ``close`` adds index and seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.docs, self.table = stream, [], []
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def _frame(self, content: bytes) -> None:
        frame = self.zstd.compress(content)
        self.stream.write(frame)
        self.table.append((len(frame), len(content), _digest(content)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(ids)
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))

    def close(self) -> None:
        self._frame(np.array(self.docs, INDEX).tobytes())
        body = b"".join(struct.pack("<III", *entry) for entry in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body) + len(foot)) + body + foot)


class Reader:
    """Reads documents of an open, seekable binary file by their number in it."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        file.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.zstd = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.frames(n - 1, n)[0], INDEX)

    def frames(self, first: int, last: int) -> list[bytes]:
        """Contents of the frames [first, last): one read, each checked against its digest."""
        self.file.seek(int(self.starts[first]))
        raw = self.file.read(int(self.starts[last] - self.starts[first]))
        out = []
        for k in range(first, last):
            at = int(self.starts[k] - self.starts[first])
            content = self.zstd.decompress(raw[at : at + int(self.table[k, 0])])
            if len(content) != self.table[k, 1] or _digest(content) != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            out.append(content)
        return out


#: Text that goes into a file.
FILE_BYTES = 256_000_000
MANIFEST = "part long, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, root: str, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, write files under ``root`` -> manifest
    (part, path, n_docs, n_ids), one row per file, as a written table.

    ``files``: how many; else one for every FILE_BYTES of text, and as many as the session has shuffle
    partitions at least. A null text is empty. Repeated doc_ids and null doc_ids are written as rows of
    their own, in order of a hash of the text, so that no range of files has to hold all of them; other
    input columns are ignored. An empty table gives an empty manifest or files without documents.
    Texts are encoded whole. A task that runs again writes a file of another name; only the names in
    the manifest count.
    """
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        docs_in, ids_in = 0, 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as stream:
            writer = Writer(stream)
            for batch in batches:
                for doc_id, null, text in zip(batch.doc_id, batch.no_id, batch.text, strict=True):
                    ids = encode(text) + end
                    writer.add(None if null else int(doc_id), ids)
                    docs_in, ids_in = docs_in + 1, ids_in + len(ids) // 4
            writer.close()
        yield pd.DataFrame({"part": [part], "path": [f"{root}/{name}"], "n_docs": [docs_in], "n_ids": [ids_in]})

    rows = rows_of(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    if files is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        files = max(partitions_for(docs.sparkSession), -(-size // FILE_BYTES))
    order = [F.col("no_id").desc(), F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    return work_table(dealt.mapInPandas(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, frames_a_row: int = 512) -> DataFrame:
    """(part, nth, doc_id, start, n_tokens, ids): every document of the files; ``start`` is the
    number of ids of all documents before it, over all files."""
    files = manifest.orderBy("part").collect()  # a row per file: as many as write tasks
    before, plan = 0, []
    for f in files:
        plan.append((f.part, f.path, f.n_docs, before))
        before += f.n_ids
    spark = manifest.sparkSession
    plan = spark.createDataFrame(plan, "part long, path string, n_docs long, before long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(frames_a_row).cast("long"))
    parts = plan.where("n_docs > 0").withColumn("first", F.explode(starts))
    parts = parts.repartitionByRange(partitions_for(spark), "part", "first").sortWithinPartitions("part", "first")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, reader, file, starts = None, None, None, None  # a task reads a file's table once: its rows stand together
        try:
            for batch in batches:
                for part, path, n_docs, before, first in batch.itertuples(index=False):
                    if path != opened:
                        if file:
                            file.close()
                        store, name = pafs.FileSystem.from_uri(path)
                        file = store.open_input_file(name)
                        opened, reader = path, Reader(file)
                        counts = reader.index["n_tokens"].astype(np.int64)
                        starts = before + np.cumsum(counts) - counts
                    last = min(n_docs, first + frames_a_row)
                    own = reader.index[first:last]
                    yield pd.DataFrame({
                        "part": part, "nth": np.arange(first, last),
                        "doc_id": pd.array(np.where(own["is_null"], None, own["doc_id"].astype(object)), "Int64"),
                        "start": starts[first:last], "n_tokens": own["n_tokens"].astype(np.int64), "ids": reader.frames(first, last),
                    })
        finally:
            if file:
                file.close()

    kind = T.StructType([T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("part", "nth", "doc_id", "start", "n_tokens", "ids")])
    return parts.select("part", "path", "n_docs", "before", "first").mapInPandas(read, kind)


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` from the files that it was written to."""
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, public_path("word_bpe_49k.json"), 1, work_path(spark, "token-files"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
