"""Sharding by balanced label propagation, in DataFrame functions only.

Rows with equal texts are linked through their group (a hub), so a group costs one row per shard that
it lies on, not one per pair. Members of a group are alike, so the propagation moves numbers of
members between shards; rows follow once, at the end.

Labels start by hash: every member of a group lies on a shard of its own. A group larger than a
shard's quota is cut into as few pieces as it needs. Then, round by round, the pieces move towards
their neighbours' shards: a piece asks for the shard that holds most of its group (the second piece
for the second, and so on), and the shard admits askers while its quota has room, those with the
most members there first. Pieces that no shard of a neighbour has room for take any shard with room.
The largest pieces settle first: a round is for those over half of the largest size left; room is
counted in places of that size, so that a round fills shards exactly, without chance. Only a
piece that fits no shard at all is halved. Rounds end when every piece is settled; as sizes halve, that
is after about log2(quota) rounds. Unlinked rows fill what is left.
Law ``rows``: row counts of any two shards differ by at most one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.work import join_hot, rows_of, table, work_table

ROWS_A_BUCKET = 50_000
GROUP = ["g1", "g2"]


def _numbered(rows: DataFrame, by: list[str], total: int, spread: int, name: str, order: list[str]) -> DataFrame:
    """Adds ``name``: 0.. without gaps within ``by``, in two levels, so that no task holds all rows
    of a key: a number inside each of many buckets plus the size of the buckets before."""
    buckets = max(8, -(-total // (spread * ROWS_A_BUCKET)))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(name), *order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    if not by:
        sizes = sizes.withColumn("one", F.lit(0))
    upto = W.partitionBy(*(by or ["one"])).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*by, "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy(*by, "bucket").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(before, [*by, "bucket"]).withColumn(name, (F.col("before") + F.col("inside")).cast("long")).drop("bucket", "inside", "before")


def _ends(places: list[int]) -> list[int]:
    out, upto = [], 0
    for n in places:
        upto += n
        out.append(upto)
    return out


def _slot_of(number: str, places: list[int]) -> F.Column:
    """The shard whose places hold this number, when they stand one behind the other; else null."""
    ends = _ends(places)
    shard = F.lit(None).cast("int")
    for s in reversed(range(len(ends))):
        shard = F.when(F.col(number) < ends[s], F.lit(s)).otherwise(shard)
    return shard


def _pieces(linked: DataFrame, cap: int) -> DataFrame:
    """(g1, g2, piece, size, wish): pieces of groups, none over ``cap``; wish is the shard that holds most
    of the group, for a group's piece number p the p-th such."""
    held = linked.groupBy(*GROUP, "shard").agg(F.count("*").alias("n"))
    groups = held.groupBy(*GROUP).agg(F.sum("n").alias("members"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.xxhash64("g1", "shard").alias("tie"), "shard"))).alias("held"))  # at most a struct per shard
    cut = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("members") - 1) / cap))))
    favourite = F.get("held", F.col("piece").cast("int"))
    return cut.select(*GROUP, F.col("piece").cast("string").alias("piece"), F.least(F.lit(cap).cast("long"), F.col("members") - F.col("piece") * cap).alias("size"), favourite["shard"].alias("wish"), (-favourite["n"]).alias("there"))


def _loads(settled: DataFrame) -> dict[int, int]:
    return {r.shard: r.n for r in settled.groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row per shard


def _admit_wishes(asking: DataFrame, places: list[int], total: int) -> DataFrame:
    """Adds ``shard``: the wish, for as many askers of a shard as it has places, else null. Askers with the
    most members there come first, by powers of two."""
    level = F.floor(F.log2(F.coalesce("there", F.lit(1)).cast("double"))).cast("int")
    asked = asking.withColumn("level", F.when(F.col("wish").isNotNull(), level))
    sizes = asked.where("wish is not null").groupBy("wish", "level").agg(F.count("*").alias("n"))  # a row per shard and power of two
    above = F.coalesce(F.sum("n").over(W.partitionBy("wish").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = _numbered(asked.where("wish is not null"), ["wish", "level"], total, len(places), "nth", [*GROUP, "piece"])
    ranked = ranked.join(F.broadcast(sizes.select("wish", "level", above.alias("above"))), ["wish", "level"])
    room = F.get(F.array(*[F.lit(int(p)) for p in places]), F.col("wish"))
    admitted = ranked.withColumn("shard", F.when(F.col("above") + F.col("nth") < room, F.col("wish")))
    columns = [*GROUP, "piece", "size", "wish", "there", "shard"]
    return admitted.select(*columns).unionByName(asked.where("wish is null").withColumn("shard", F.lit(None).cast("int")).select(*columns))


def _halved(pieces: DataFrame) -> DataFrame:
    """Every piece as two: half of its members ask where their group's piece asked, the rest anywhere."""
    half = F.floor(F.col("size") / 2)
    two = F.array(F.struct(F.lit("a").alias("part"), (F.col("size") - half).alias("size"), F.col("wish").alias("wish")), F.struct(F.lit("b").alias("part"), half.alias("size"), F.lit(None).cast("int").alias("wish")))
    return pieces.select(*GROUP, "piece", "there", F.explode(two).alias("x")).select(*GROUP, F.concat("piece", "x.part").alias("piece"), "x.size", "x.wish", "there")


def _propagate(pieces: DataFrame, quota: list[int]) -> DataFrame:
    """(g1, g2, shard, size) of settled pieces; all are, as long as quotas hold them all."""
    room, done = list(quota), []

    def settle(placed: DataFrame) -> DataFrame:
        placed = work_table(placed, "placed")
        settled = placed.where("shard is not null").select(*GROUP, "shard", "size")
        done.append(settled)
        for s, n in _loads(settled).items():
            room[s] -= n
        return placed.where("shard is null").drop("shard")

    left = pieces
    while top := left.agg(F.max("size").alias("size"), F.count("*").alias("n")).first():
        if not top.n:
            break
        large = F.col("size") > top.size // 2
        later, now = left.where(~large), left.where(large)
        now = settle(_admit_wishes(now, [r // top.size for r in room], top.n))
        if not now.isEmpty():
            places = [r // top.size for r in room]
            if any(places):
                now = settle(_numbered(now, [], top.n, 1, "nth", [*GROUP, "piece"]).withColumn("shard", _slot_of("nth", places)).drop("nth"))
            widest = max(room)
            now = now.where(F.col("size") <= widest).unionByName(_halved(now.where(F.col("size") > widest)))
        left = work_table(later.unionByName(now), "left")
    none = pieces.select(*GROUP, F.col("wish").alias("shard"), "size").limit(0)
    return reduce(DataFrame.unionByName, done, none)


def balanced_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, g1, g2, shard, slot), one row per input row.

    size: UTF-8 bytes plus 16. A null text counts as empty (size 16, crc 0) and is linked to empty
    texts. Repeated and null doc_ids are rows like any other; other input columns are ignored. An
    empty table gives no rows. Texts of any length are one row.
    """
    text = F.coalesce("text", F.lit(""))
    rows = rows_of(docs, doc_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit("again"), text).alias("g2"),
    )
    rows = work_table(rows, "rows")
    total = rows.count()
    groups = work_table(rows.groupBy(*GROUP).agg(F.count("*").alias("members")), "groups")
    single = rows.join(groups.where("members = 1").select(*GROUP), GROUP, "left_semi")
    linked = join_hot(rows, groups.where("members > 1").withColumn("many", F.col("members")), GROUP, total, "many")
    linked = work_table(linked, "linked")
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    labelled = linked.select(*GROUP, F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"))
    settled = _propagate(work_table(_pieces(labelled, max(1, min(quota))), "pieces"), quota)
    parts = settled.groupBy(*GROUP, "shard").agg(F.sum("size").alias("n"))
    lies = parts.groupBy(*GROUP).agg(F.sum("n").alias("members"), F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("parts"))  # at most a struct per shard
    load = {r.shard: r.n for r in settled.groupBy("shard").agg(F.sum("size").alias("n")).collect()}

    one = lies.where(F.size("parts") == 1).select(*GROUP, "members", F.col("parts")[0]["shard"].alias("shard"))
    more = lies.where(F.size("parts") > 1)
    columns = ["uid", "doc_id", "size", "text_crc32", *GROUP, "shard"]
    whole = join_hot(linked.drop("members"), one, GROUP, total, "members").select(*columns)
    cut = join_hot(linked.drop("members"), more, GROUP, total, "members")
    cut = _numbered(cut, GROUP, total, 1, "nth", ["uid"])
    upto = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("shard")), lambda s, p: F.struct((s["sum"] + p["n"]).alias("sum"), F.coalesce(s["shard"], F.when(F.col("nth") < s["sum"] + p["n"], p["shard"])).alias("shard")), lambda s: s["shard"])
    cut = cut.withColumn("shard", upto).select(*columns)

    rest = _numbered(single, [], total, 1, "nth", ["uid"]).withColumn("shard", _slot_of("nth", [q - load.get(s, 0) for s, q in enumerate(quota)]))
    placed = work_table(whole.unionByName(cut).unionByName(rest.select(*columns)), "placed")
    return _numbered(placed, ["shard"], total, shards, "slot", ["uid"]).select("doc_id", "size", "text_crc32", "g1", "g2", "shard", "slot")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """``documents`` over 40 shards under the law ``rows``; groups are equal texts."""
    found = balanced_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
