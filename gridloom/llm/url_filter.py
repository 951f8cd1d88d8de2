"""URL filters over a sorted digest array.

A list of keys (host plus path, as ``example.org/en/``) becomes files of a sorted array of 64-bit
xxhash digests with the full strings beside it, split by digest range. A task memory-maps them,
probes with a vectorised binary search, and compares the stored string of every equal digest, so a
collision never decides. A list of any length is neither collected nor broadcast; tasks touch the
pages that their probes need.

Which keys a url can match: its host and every parent domain, times the prefixes of its path whose
length occurs in the list.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import rows_of, table, work_path, work_table

SEED = 42  # that of Spark's xxhash64, so that Spark can sort by the digest
#: Of an index file, about: what a task that writes one holds.
FILE_BYTES = 64_000_000
MANIFEST = "path string, n long, low long"


def with_host_path(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; a null url or one without ``://``: both empty."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.substring(F.col(url_col), at + 3, F.length(url_col))).otherwise(F.lit(""))
    rows = urls.withColumn("_rest", F.coalesce(rest, F.lit("")))
    rows = rows.withColumn("host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    rows = rows.withColumn("path", F.regexp_extract(F.substring(F.col("_rest"), F.length("host") + 1, F.length("_rest")), "^[^?#]*", 0))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rows.withColumn("host", F.translate("host", upper, upper.lower())).drop("_rest")


def build_index(keys: DataFrame, root: str, files: int = 1) -> DataFrame:
    """``keys`` (key, value strings; of a repeated key the larger value counts, nulls go) -> manifest
    (path, n, low) of files under ``root``, as a written table."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        keys, values = ([x.encode() for x in rows[c]] for c in ("key", "value"))
        ends = [np.cumsum([0, *map(len, x)], dtype="<i8") for x in (keys, values)]
        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        name = f"digests-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for block in (np.array([len(rows), ends[0][-1]], "<i8"), rows.digest.to_numpy("<i8"), *ends):
                out.write(block.tobytes())
            out.write(b"".join(keys) + b"".join(values))
        yield pd.DataFrame({"path": [f"{root}/{name}"], "n": [len(rows)], "low": [rows.digest.iloc[0]]})

    rows = keys.where("key is not null and value is not null").groupBy("key").agg(F.max("value").alias("value"))
    rows = rows.withColumn("digest", F.xxhash64("key"))
    return work_table(rows.repartitionByRange(files, "digest").sortWithinPartitions("digest", "key").mapInPandas(write, MANIFEST), "digest-manifest")


class DigestFile:
    """One file of the array, memory-mapped where it lies in a mounted folder, else read whole."""

    def __init__(self, path: str):
        store, name = pafs.FileSystem.from_uri(path)
        if isinstance(store, pafs.LocalFileSystem):
            raw = np.memmap(name, np.uint8, "r")
        else:
            with store.open_input_file(name) as f:
                raw = np.frombuffer(f.read_buffer(), np.uint8)
        n, key_bytes = (int(x) for x in raw[:16].view("<i8"))
        at = 16
        self.digests = raw[at : at + 8 * n].view("<i8")
        at += 8 * n
        self.key_ends = raw[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.value_ends = raw[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.keys, self.values = raw[at : at + key_bytes], raw[at + key_bytes :]

    def find(self, keys: list[bytes], digests: np.ndarray) -> list[str | None]:
        """The value stored with each key, else None."""
        out: list[str | None] = [None] * len(keys)
        at = np.searchsorted(self.digests, digests, "left")
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests)):
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == digests[i]:
                if self.keys[self.key_ends[k] : self.key_ends[k + 1]].tobytes() == keys[i]:
                    out[i] = self.values[self.value_ends[k] : self.value_ends[k + 1]].tobytes().decode()
                    break
                k += 1
        return out


@lru_cache(maxsize=256)
def digest_file(path: str) -> DigestFile:
    return DigestFile(path)


class DigestArray:
    """All files of a list, in order of digest."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = sorted(files, key=lambda f: f[1])
        self.lows = np.array([low for _, low in self.files], np.int64)

    def find(self, keys: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(keys)
        if not self.files or not keys:
            return out
        raw = [k.encode() for k in keys]
        digests = np.array([xxhash.xxh64_intdigest(k, SEED) for k in raw], np.uint64).view(np.int64)
        part = np.searchsorted(self.lows, digests, "right") - 1
        for p in np.unique(part[part >= 0]):
            own = np.flatnonzero(part == p)
            for i, value in zip(own, digest_file(self.files[p][0]).find([raw[i] for i in own], digests[own]), strict=True):
                out[i] = value
        return out


def probes(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys that can match, the longest first; of equal length, the longer host first."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    keys = [(len(h) + n, len(h), h + path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [k for *_, k in sorted(keys, reverse=True)]


class UrlList:
    """An indexed list: manifest rows and the path lengths that occur, both small whatever the list.
    ``keys`` is a table (key, value) of any length; ``files``: how many, else one for every FILE_BYTES."""

    def __init__(self, keys: DataFrame, name: str, files: int | None = None):
        spark = keys.sparkSession
        keys = work_table(keys.select("key", "value"), name)
        if files is None:
            size = keys.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value") + 24), F.lit(0)).alias("n")).first().n
            files = max(1, -(-size // FILE_BYTES))
        self.manifest = build_index(keys, work_path(spark, name), files)
        length = F.when(F.instr("key", "/") > 0, F.length("key") - F.instr("key", "/") + 1).otherwise(0)
        self.lengths = sorted(r.n for r in keys.where("key is not null").select(length.alias("n")).distinct().collect())  # at most the longest path
        self.files = [(r.path, r.low) for r in self.manifest.collect()]  # a row per file


def judge(urls: DataFrame, rules: UrlList, blocked: UrlList, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, verdict), one row per input row.

    ``rules``: key -> allow or block; the longest rule that fits decides (rule is null if none does).
    Else a url that any key of ``blocked`` fits is blocked and every other allowed. A null url has
    an empty host and path and is allowed. Other input columns are ignored.
    """
    rule_files, rule_lengths, block_files, block_lengths = rules.files, rules.lengths, blocked.files, blocked.lengths

    def first_match(array: DigestArray, lengths: list[int], batch: pd.DataFrame) -> tuple[list[str | None], list[str | None]]:
        asked = [probes(h, p, lengths) for h, p in zip(batch.host, batch.path, strict=True)]
        found = array.find([k for keys in asked for k in keys])
        keys_out, values_out, at = [], [], 0
        for keys in asked:
            hit = next(((k, v) for k, v in zip(keys, found[at : at + len(keys)], strict=True) if v is not None), (None, None))
            keys_out.append(hit[0])
            values_out.append(hit[1])
            at += len(keys)
        return keys_out, values_out

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ruled, listed = DigestArray(rule_files), DigestArray(block_files)
        for batch in batches:
            rule, verdict = first_match(ruled, rule_lengths, batch)
            block, _ = first_match(listed, block_lengths, batch)
            batch["rule"] = rule
            batch["verdict"] = [v or ("block" if b is not None else "allow") for v, b in zip(verdict, block, strict=True)]
            yield batch

    rows = with_host_path(rows_of(urls, page_id=id_col, url=url_col), "url")
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(decide, f"{kinds}, rule string, verdict string")


#: Rules of the query: the longest that fits decides.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The method's list: sites of the kinds blocked by default, under each of the test domains.
BLOCKED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED = tuple(f"{site}.example.{top}" for site in BLOCKED_SITES for top in ("com", "net", "org"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Rule and verdict of every row of ``pages``."""
    rules = UrlList(spark.createDataFrame(RULES, "key string, value string"), "url-rules")
    blocked = UrlList(spark.createDataFrame([(k, "block") for k in BLOCKED], "key string, value string"), "url-blocked")
    return judge(table(spark, sf_dir, "pages"), rules, blocked).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
blocked(host) AS (VALUES {", ".join(f"('{k}')" for k in BLOCKED)}),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (
  SELECT p.page_id, rules.host || rules.path AS rule, rules.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC) AS nth
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path))
SELECT p.page_id, p.host, p.path, m.rule,
       coalesce(m.verdict, CASE WHEN EXISTS (SELECT 1 FROM blocked b WHERE p.host = b.host OR ends_with(p.host, '.' || b.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.nth = 1
"""
