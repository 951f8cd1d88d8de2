"""Token counts, source divergence and conversation repair against brute force, the library and SQL."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import conversations, divergence, token_counts
from gridloom.llm.tokens import public_path

SF = "/root/testdata/sf0.001"
BYTES = public_path("byte_bpe_50k.json")
CLASH = {"uid": 1, "chunk": 2, "n_tokens": "x", "source": 1.5, "term": None, "n": 3, "copy": 1, "digest": "d", "kind": 1, "head": "h", "value": 0, "rank": 9, "signature": "s", "p0": 1, "text_": "t"}


def library(text):
    return len(token_counts.encoder(BYTES).tokenizer.encode(text, add_special_tokens=False).ids)


def spliced(text, chunk, overlap):
    """What the Spark job does with one text, and how many rounds it takes."""
    n, rounds = len(text), 0
    starts = [max(0, k * chunk - overlap) for k in range(-(-n // chunk))]
    stops = [min(n, (k + 1) * chunk) for k in range(-(-n // chunk))]
    margin = token_counts.splice_margin(BYTES)
    while True:
        total, before, failed, rounds = 0, None, set(), rounds + 1
        for k, (a, b) in enumerate(zip(starts, stops)):
            m, found = token_counts.boundaries(BYTES, text[a:b])
            sure = {a + p: c for p, c in found if p <= b - a - margin}
            total += m
            if before is not None:
                common = before[1].keys() & sure.keys()
                if common:
                    at = min(common)
                    total += before[1][at] - before[0] - sure[at]
                else:
                    failed.add(k)
            before = (m, sure)
        if not failed:
            return total, rounds
        starts, stops = token_counts.widened(starts, stops, failed)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Be", " ", "\n", "'s", "'re", "'", "é", "漢", "1", "!", "<|endoftext|>", "<|", "endoftext", "  ", "wordwordword", " ", "𝔘"]), max_size=150).map("".join), st.integers(20, 60), st.integers(1, 19))
def test_spliced_counts_are_the_librarys(text, chunk, overlap):
    if text:
        assert spliced(text, chunk, overlap)[0] == library(text)


def test_overlaps_widen_over_long_pieces():
    text = "plain words before " + "x" * 5000 + " and after it " + " " * 3000 + "end"
    got, rounds = spliced(text, 200, 20)
    assert got == library(text) and rounds > 2


def test_token_counts(spark):
    long = " ".join(f"word{i % 977} and{'!' * (i % 5)}" for i in range(9000))
    texts = ["A b c d", None, "", " \n\t ", "<|endoftext|> x", "x" * 90_000, long, " " * 40_000 + "<|endoftext|>" * 3000, "漢字" * 20_000, long, "<|endof" * 9000]
    rows = [(i % 7 or None, t) for i, t in enumerate(texts)] + [(1, "A b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    got = token_counts.token_counts(docs, BYTES, chunk=4096, overlap=64)
    want = [(i, len((t or "").encode()), library(t or "")) for i, t in rows]
    key = lambda r: (r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(docs.where("false"), BYTES).count() == 0
    pieces = public_path("piece_bpe_32k.model")
    assert token_counts.splice_margin(pieces) is None and token_counts.splice_margin(public_path("word_bpe_49k.json")) is None
    assert token_counts.token_counts(docs.where("doc_id = 1"), pieces).count() == 3


def test_token_counts_of_the_table(spark):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op11_token_counts(spark, SF).collect()}
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text.to_dict()
    assert got == {i: (len(t.encode()), n := library(t), n > 512) for i, t in texts.items()}


def plain_divergence(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [(lang, source, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(t for la, _, c in terms if la == lang for t in c)
        kept = [t for t, n in docs.items() if n >= least]
        count = {s: Counter() for la, s, _ in terms if la == lang}
        for la, s, c in terms:
            if la == lang:
                count[s].update({t: c[t] for t in kept})
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in count if o != s]
            best = [(t, f(ps[s][t], q[t])) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", best, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


ODD = [("en", "a", "One one TWO two Éa"), ("en", "a", "one Two"), ("en", "b", "two one one"), ("en", "b", None), (None, None, "x x x"), (None, "", "X"), ("", "c", "x"), ("de", "a", "einmal"), ("de", "b", "123 !?"), ("fr", None, ""), ("en", "c", "zzz"), ("en", "a", "one two ﬁ 漢字 éa"), ("en", "d", "éa 漢字 éa"), ("en", "d", "éa 漢字 " + "lang " * 30_000)]


def test_divergence(spark):
    docs = spark.createDataFrame(ODD, "lang string, source string, text string").withColumns({k: F.lit(v) for k, v in CLASH.items() if k != "source"})
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == plain_divergence(ODD)
    assert divergence.divergence(docs.where("false")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "l"]), st.sampled_from("abc"), st.lists(st.sampled_from(["t", "u", "v", "w", "Z", "z"]), max_size=6).map(" ".join)), max_size=25))
def test_divergence_of_random_tables(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.divergence(docs, documents=2, top=3).collect())) == plain_divergence(rows, 2, 3)


def test_divergence_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = divergence.op12_divergence(spark, SF)
    theirs = c.execute(divergence.OP12_SQL).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(theirs.itertuples(index=False, name=None))


def cheapest(letters):
    """Least (cost, audit) over all edit sequences, by exhaustion; rows are (initial, must go, cut off)."""
    found = []

    def go(i, out, cost, audit, inserts):
        if cost > 2 * len(letters):  # deleting everything is cheaper
            return
        if i == len(letters) and re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, audit))
        if inserts < 3:
            for r in "ua":
                go(i, out + r, cost + 5, audit + "I", inserts + 1)
        if i < len(letters):
            initial, gone, cut_off = letters[i]
            go(i + 1, out, cost + 2, audit + "D", 0)
            if not gone:
                go(i + 1, out + initial, cost + 5 * cut_off, audit + "K", 0)
                for r in "ua":
                    go(i + 1, out + r, cost + 1 + 5 * cut_off, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_every_short_signature_is_solved_at_least_cost():
    alphabet = [("s", 0, 0), ("u", 0, 0), ("a", 0, 0), ("o", 0, 0), ("u", 0, 1), ("a", 0, 1), ("s", 0, 1), ("o", 1, 0)]
    trie = conversations.Trie()
    word = lambda rows: "".join("x" if gone else r.upper() if cut else r for r, gone, cut in rows)
    cases = {word(rows): rows for n in range(4) for rows in product(alphabet, repeat=n)}
    for signature in sorted(cases):
        assert trie.solve(signature) == cheapest(cases[signature]), signature
    assert trie.steps == len(cases) - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("suaoxUAS", max_size=40), max_size=8))
def test_shared_prefixes_give_what_each_signature_gives_alone(signatures):
    trie = conversations.Trie()
    assert [trie.solve(s) for s in sorted(signatures)] == [conversations.Trie().solve(s) for s in sorted(signatures)]


def test_long_signatures(monkeypatch):
    long = "sua" + "uauaUxo" * 9000
    trie = conversations.Trie()
    cost, audit = trie.solve(long)
    assert len(audit) - audit.count("I") == len(long)
    assert trie.solve(long + "ua")[0] == cost and trie.steps < 2 * len(long)
    short = "sua" + "uauaUxo" * 90
    plain = conversations.Trie().solve(short)
    monkeypatch.setattr(conversations, "ASIDE", 10**9)
    monkeypatch.setattr(conversations, "KEPT", 0)
    assert conversations.Trie().solve(short) == plain


WHITE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """The contract read line by line: conv_id -> everything but the conv_id."""
    convs = {}
    for conv, turn, role, text in rows:
        there = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        there += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv, there in convs.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        there.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        faults, seen, letters = Counter(), set(), []
        for _, role, text in there:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            letters.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in there if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(there, there[1:]))
        cost, audit = conversations.Trie().solve("".join("x" if g else r.upper() if c else r for r, g, c in letters))
        lines, want, at = [], "u", 0
        for e in audit:
            if e != "I":
                row, at = there[at], at + 1
            if e == "D":
                continue
            role, text = ("user" if want == "u" else "assistant", "") if e == "I" else ("user" if want == "u" else "assistant", row[2]) if e == "R" else row[1:]
            lines.append(f"{role}:{text}")
            want = "a" if role[:1] == "u" else "u"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def same(got, rows):
    got = got.collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(found) == len(got)
    assert found == plain_repair(rows)


def test_conversation_repair_of_the_table(spark):
    frame = pd.read_parquet(f"{SF}/conversations.parquet")
    same(conversations.op13_conversation_repair(spark, SF), list(frame[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)))


def test_conversation_repair_of_odd_rows(spark):
    roles, texts = ["system", "user", "assistant", None, "", "tool", "User", "usher"], ["Fine.", "cut off", "", None, " \n\t\x0b", "Yes!", "Ünï ", " ", "Fine.\u0085", "long " * 20_000 + "?"]
    rows = [(c, t, roles[(c * 5 + t * 3) % 8], texts[(c * 7 + t * t) % 10]) for c in range(40) for t in range(c % 9)]
    rows += [(None, None, "user", "No turn."), (None, 3, "assistant", "No id."), (50, None, "user", "b."), (50, None, "user", "a."), (50, 2, "user", "a."), (50, 2, "user", "a."), (51, -3, "user", "Early."), (51, 9, "assistant", "Late.")]
    dropped = next(t for t in range(200) if zlib.crc32(f"60:{t}".encode()) % 20 == 0)
    rows += [(60, dropped, "user", "Goes.")] + [(61, t, "user" if t % 2 else "assistant", f"Turn {t % 37}.") for t in range(700)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    same(conversations.repaired(table), rows)
    assert plain_repair(rows)[60] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert conversations.repaired(table.where("false")).count() == 0


def test_repair_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Answer."), (2, 5, "assistant", "Alone.")]
    got = {r.conv_id: (r.cost, r.audit) for r in conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), damage=False).collect()}
    assert got == {1: (1, "KR"), 2: (2, "D")}
