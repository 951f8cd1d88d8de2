"""Repair of conversation structure by least edits, solved once for every shared prefix of signatures.

A conversation's signature has a letter for every row: its role's initial (s, u, a, or o for any
other) as it is, in upper case if the row ends cut off, or ``x`` and the like (DELETED) if it must go. Which
edits are cheapest depends on the signature alone, so equal signatures are solved once; sorted, they are walked
as a prefix trie, whose current path keeps a layer of the dynamic programme for every letter. The next
signature goes back to the layer where it branches off and adds only its own letters; its answer
is read off at its end.

A layer holds, for each state of the output (nothing yet, after system, after user, after assistant), the
least cost and the ASCII-least edits of that cost. Two edit sequences that reach the same state after
the same rows at the same cost never begin one another (the longer one would hold more
inserts, at 5 each), so the lesser prefix stays the lesser whatever follows.

Texts are never gathered: signatures come from digests, and hashes from rows that stream past in
order. A conversation of any number of rows takes one task's time, but only a letter a row of its memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.llm.work import join_hot, partitions_for, rows_of, table, work_table

WHITE, END = " \t\n\x0b\x0c\r", ".!?"
#: Letters of rows that must be deleted, whatever their role.
DELETED = "x"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Output states and where a role's initial leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
FINAL = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
#: Depth to which every layer of the current path is kept, and edits after which common beginnings are set aside.
KEPT, ASIDE = 4096, 256
STRUCTURE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
HASHED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Layer:
    """Least (cost, edits) by output state after some rows; ``before`` are the edits that all states share, as
    nested (earlier, string) pairs, ``of`` those behind it."""

    __slots__ = ("before", "length", "of")

    def __init__(self, of: dict[int, tuple[int, str]], before: tuple | None = None, length: int = 0):
        self.of, self.before, self.length = of, before, length

    def _with_inserts(self) -> Layer:
        of = self.of
        for _ in range(3):
            for state, (cost, edits) in sorted(of.items(), key=lambda x: x[1]):
                to, found = NEXT[state][WANTED[state]], (cost + INSERT, edits + "I")
                if to not in of or found < of[to]:
                    of[to] = found
        # What an assistant's turn reaches as cheaply, nothing or a system's turn needn't: the same edits may
        # follow, but for a system's row, which is then deleted.
        if ASSISTANT in of:
            for state, more in ((START, DELETE), (SYSTEM, 0)):
                if state in of and of[state][0] > of[ASSISTANT][0] + more:
                    del of[state]
        shared = commonprefix([e for _, e in of.values()]) if max(len(e) for _, e in of.values()) > ASIDE else ""
        if shared:
            self.before, self.length = (self.before, shared), self.length + len(shared)
            self.of = {s: (c, e[len(shared) :]) for s, (c, e) in of.items()}
        return self

    def after(self, letter: str) -> Layer:
        """The layer behind one more row."""
        of: dict[int, tuple[int, str]] = {}
        role, cut_off = letter.lower(), CUT_OFF * letter.isupper()
        for state, (cost, edits) in self.of.items():
            ways = [(state, (cost + DELETE, edits + "D"))]
            if role != DELETED:
                if role in NEXT[state]:
                    ways.append((NEXT[state][role], (cost + cut_off, edits + "K")))
                ways.append((NEXT[state][WANTED[state]], (cost + REROLE + cut_off, edits + "R")))
            for to, found in ways:
                if to not in of or found < of[to]:
                    of[to] = found
        return Layer(of, self.before, self.length)._with_inserts()

    def answer(self) -> tuple[int, str]:
        cost, edits = min(self.of[s] for s in FINAL if s in self.of)
        parts, at = [edits], self.before
        while at:
            at, part = at
            parts.append(part)
        return cost, "".join(reversed(parts))


def root() -> Layer:
    return Layer({START: (0, "")})._with_inserts()


class Trie:
    """The path of a prefix trie that the last signature took, with a layer for each letter."""

    def __init__(self):
        self.path, self.layers, self.steps = "", [root()], 0

    def solve(self, signature: str) -> tuple[int, str]:
        shared = min(len(commonprefix([self.path, signature])), len(self.layers) - 1)
        del self.layers[shared + 1 :]
        layer = self.layers[-1]
        for depth in range(shared, len(signature)):
            layer = layer.after(signature[depth])
            self.steps += 1
            if depth < KEPT:
                self.layers.append(layer)
        self.path = signature
        return layer.answer()


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures, each task a sorted range of them."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie()
        for batch in batches:
            found = [trie.solve(s) for s in batch.signature]
            yield pd.DataFrame({"signature": batch.signature, "cost": [c for c, _ in found], "audit": [a for _, a in found]})

    ranged = signatures.repartitionByRange(partitions_for(signatures.sparkSession), "signature").sortWithinPartitions("signature")
    return ranged.mapInPandas(walk, "signature string, cost long, audit string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) of (conv_id, turn, role, text) after damage by crc32(`conv_id:turn`) % 20;
    a row that was dropped stays with a null copy, so that its conversation is not lost."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", END, "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("hit") == 0, F.array(F.lit(None).cast("int"))).when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _digest() -> Column:
    """Of role and text, which a row of the same digest shares; rows of one turn follow by role and digest."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


#: Ascending, nulls first.
ORDER = ["turn", "role", "digest", "copy"]


def _structures(rows: DataFrame) -> DataFrame:
    """STRUCTURE of every conversation, from rows without their texts."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(last == "", "b").when(~last.isin(*END), "t").otherwise("")
    light = rows.select("conv_id", "turn", "role", "copy", fault.alias("fault"), F.when(F.col("copy").isNotNull(), _digest()).alias("digest"))
    light = light.repartition(partitions_for(rows.sparkSession), "conv_id")
    seen = F.row_number().over(W.partitionBy("conv_id", "digest").orderBy(*ORDER)) > 1
    light = light.withColumn("seen", seen & F.col("copy").isNotNull()).sortWithinPartitions("conv_id", *ORDER)
    light = light.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "seen", F.col("copy").isNotNull().alias("there"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, began, letters, faults, illegal, turns, distinct, before, turn_before = None, False, [], {}, 0, None, 0, "", None

        def given() -> tuple:
            gaps = turns[1] - turns[0] + 1 - distinct if turns else 0
            return (now, gaps, faults["b"], faults["d"], faults["t"], illegal, "".join(letters))

        for batch in batches:
            out = []
            turn_known = batch.turn.notna().tolist()
            conv_known = batch.conv_id.notna().tolist()
            for conv, has_conv, turn, has_turn, initial, fault, seen, there in zip(batch.conv_id, conv_known, batch.turn, turn_known, batch.initial, batch.fault, batch.seen, batch.there, strict=True):
                conv, turn = int(conv) if has_conv else None, int(turn) if has_turn else None
                if not began or conv != now:
                    if began:
                        out.append(given())
                    now, began, letters, faults, illegal, turns, distinct, before, turn_before = conv, True, [], {"b": 0, "d": 0, "t": 0}, 0, None, 0, None, None
                if not there:
                    continue
                fault = fault if fault == "b" else "d" if seen else fault
                if fault:
                    faults[fault] += 1
                if turn is not None:
                    distinct += turn != turn_before
                    turns, turn_before = (turns[0] if turns else turn, turn), turn
                illegal += before is not None and before + initial not in LEGAL
                before = initial
                letter = initial if initial in ("s", "u", "a") else "o"
                letters.append(DELETED if fault in ("b", "d") else letter.upper() if fault == "t" else letter)
            if out:
                yield _frame(out, STRUCTURE)
        if began:
            yield _frame([given()], STRUCTURE)

    wide = light.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})
    return wide.select("conv_id", F.col("turn").cast("string").alias("turn"), "initial", "fault", "seen", "there").withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(read, STRUCTURE)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})


def _hashed(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """HASHED of every conversation: its head comes first, then its rows, which its edits repair as they pass."""
    facts = [c.split()[0] for c in HASHED.split(", ")][1:-1]
    head = heads.select(F.lit(0).alias("kind"), F.struct(*facts).alias("head"), "conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("copy", "int"), ("text", "string"))])
    body = rows.where("copy is not null").withColumn("digest", _digest())
    body = body.select(F.lit(1).alias("kind"), F.lit(None).cast(head.schema["head"].dataType).alias("head"), "conv_id", "turn", "role", "digest", "copy", "text")
    both = head.unionByName(body).repartition(partitions_for(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None

        class Repaired:
            def __init__(self, conv, head):
                self.conv, self.head, self.audit, self.at = conv, head, head["audit"], 0
                self.hash, self.state, self.first = hashlib.sha256(), START, True

            def _put(self, role: str, text: str) -> None:
                self.state = NEXT[self.state][role[0]]
                self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
                self.first = False

            def _wanted(self) -> str:
                return "user" if WANTED[self.state] == "u" else "assistant"

            def inserts(self) -> None:
                while self.audit[self.at : self.at + 1] == "I":
                    self.at += 1
                    self._put(self._wanted(), "")

            def row(self, role: str, text: str) -> None:
                self.inserts()
                edit, self.at = self.audit[self.at], self.at + 1
                if edit != "D":
                    self._put(role if edit == "K" else self._wanted(), text)

            def given(self) -> tuple:
                self.inserts()
                return (self.conv, *[self.head[c] for c in facts], self.hash.hexdigest())

        for batch in batches:
            out = []
            for kind, head, conv, role, text in zip(batch.kind, batch["head"], batch.conv_id, batch.role, batch.text, strict=True):
                if kind == 0:
                    if now:
                        out.append(now.given())
                    now = Repaired(None if conv is None else int(conv), head)
                else:
                    now.row(role, text)
            if out:
                yield _frame(out, HASHED)
        if now:
            yield _frame([now.given()], HASHED)

    return both.select("kind", "head", F.col("conv_id").cast("string").alias("conv_id"), "role", "text").mapInPandas(read, HASHED)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> DataFrame:
    """HASHED rows, one per conv_id (a null conv_id is a conversation too).

    Null roles and texts are one space; null turns come first and count in no gap. Rows of one turn follow by
    role, then by a digest of role and text; repeated rows are duplicates of the first. A role other than system, user
    and assistant, an empty one included, counts by its initial; what begins otherwise is kept by no edit but Rerole. A conversation
    without rows, or all dropped, has zeros, an empty audit and the hash of an empty string. Other columns are
    ignored; an empty table gives no rows; texts and conversations may have any length."""
    rows = rows_of(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})
    if damage:
        rows = damaged(rows)
    else:
        rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}).withColumn("copy", F.lit(0))
    convs = work_table(_structures(rows), "structures")
    signatures = work_table(convs.groupBy("signature").agg(F.count("*").alias("n")), "signatures")
    answers = work_table(solved(signatures.select("signature")), "answers").join(signatures, "signature")
    return _hashed(join_hot(convs, answers, ["signature"], convs.count()).drop("signature"), rows)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every damaged conversation's faults, cheapest repair and the hash of the repaired text."""
    return repaired(table(spark, sf_dir, "conversations"))
