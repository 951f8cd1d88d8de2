"""Operators against brute force, round trips and held-out accuracy."""

import math
import re
import unicodedata
import zlib
from collections import Counter
from functools import cache
from io import BytesIO
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import decontaminate, html_text, importance, lm_score, near_copies, packing, quality_rules, queries, sharding, simhash, token_files, tokens, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text.to_dict()


def plain_fingerprint(text, width=3):
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, texts):
    got = {r.doc_id: r for r in simhash.op1_simhash(spark, SF).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all(got[i].fingerprint == f"{f:016x}" for i, f in prints.items())
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            low = min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
            changed |= low < root[i]
            root[i] = min(root[i], low)
    assert {i: got[i].component_id for i in prints} == root


def test_dense_cells_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3)
    prints = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 14, (400, 2))} | {int(x) for x in rng.integers(0, 1 << 63, 200)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.connected_components(simhash.links(frame)).collect()}
    x = np.array(prints).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        assert roots[prints[i]] == roots[prints[j]]
    assert all((roots[p] == p) or near[prints.index(p)].sum() > 1 for p in roots)


def test_manhattan_never_exceeds_hamming():
    rng = np.random.default_rng(2)
    for a, b in rng.integers(0, 1 << 63, (200, 2)).tolist():
        code = lambda x: ((x | x >> 1) & simhash.LOW) | ((x & x >> 1 & simhash.LOW) << 1)
        counts = [abs((a >> 2 * s & 3).bit_count() - (b >> 2 * s & 3).bit_count()) for s in range(32)]
        assert (code(a) ^ code(b)).bit_count() == sum(counts) <= (a ^ b).bit_count()


TEXT = st.text(st.sampled_from("ab cdéß'’ \n\t0１²İΣς€日本́ﬁ!<|>"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_ids_are_the_librarys(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.encoder(tokens.public_path(name))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, texts):
    got = {r.doc_id: r for r in token_files.op2_token_output(spark, SF).collect()}
    e, at = tokens.encoder(tokens.public_path("word_bpe_49k.json")), 0
    for i in sorted(texts):
        ids = np.array([*e.tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_one_document_is_read_alone_and_damage_is_seen():
    out = BytesIO()
    writer = token_files.Writer(out)
    for i in range(5):
        writer.add(i, np.full(100, i, "<u4").tobytes())
    writer.close()
    reader = token_files.Reader(BytesIO(out.getvalue()))
    assert np.frombuffer(reader.frames(3, 4)[0], "<u4").tolist() == [3] * 100
    raw = bytearray(out.getvalue())
    raw[int(reader.starts[2]) + 14] ^= 1
    with pytest.raises(Exception):
        token_files.Reader(BytesIO(bytes(raw))).frames(2, 3)
    assert token_files.Reader(BytesIO(bytes(raw))).frames(3, 4)


def test_decontamination_against_all_windows(spark, texts):
    items = pd.read_parquet(f"{SF}/benchmark.parquet").set_index("item_id").text.to_dict()
    planted = {1000 + k: " ".join(t.split()[:-1] + ["changed"]) for k, t in items.items()} | {2000 + k: "before it " + t.upper() + " after it" for k, t in items.items()}
    some = dict(list(texts.items())[:60]) | planted
    frame = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    known, want = decontaminate.Items(sorted(items.items())), {}
    for d, t in some.items():
        words = decontaminate.words_of(t)
        for k, i in enumerate(known.ids):
            n = min(int(known.lengths[k]), len(words))
            best = max((known.similarity(Counter(decontaminate.shingles(words[s : s + n])), k) for s in range(len(words) - n + 1)), default=0)
            if best >= 0.8:
                want[d, i] = best
    assert got == pytest.approx(want) and len(want) >= len(items)


def test_digest_collisions_are_told_apart(tmp_path, spark):
    listed = [(f"host{i}.example/{i}", str(i)) for i in range(500)]
    u = url_filter.UrlList(spark.createDataFrame(listed, "key string, value string"), "c", files=3)
    array = url_filter.DigestArray(u.files)
    assert array.find([k for k, _ in listed] + ["other"]) == [v for _, v in listed] + [None]
    file = url_filter.digest_file(u.files[0][0])
    assert file.find([b"not the stored string"], file.digests[:1].copy()) == [None]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_places_are_whole_and_gapless(lengths):
    out = packing.place(lengths, 16)
    for i, n in enumerate(lengths):
        pieces = sorted((at, k) for p, at, k, _, _ in out if p == i)
        assert [at for at, _ in pieces] == [sum(k for _, k in pieces[:j]) for j in range(len(pieces))] and sum(k for _, k in pieces) == n
    fill = Counter()
    for _, _, k, s, offset in sorted(out, key=lambda x: (x[3], x[4])):
        assert offset == fill[s]
        fill[s] += k
    assert all(v <= 16 for v in fill.values()) and len(fill) == -(-sum(lengths) // 16)


def test_resampling_keeps_good_and_rejects_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = importance.resample(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.2


def test_kth_largest(spark):
    values = [1.0, 5.0, 5.0, 2.0, -7.0, 5.0, 100.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, 8):
        assert importance.kth_largest(frame, "v", k, bins=3) == sorted(values, reverse=True)[k - 1]


def test_pages_are_read_right_on_held_out_layouts():
    model, right, total = html_text.trained(), 0, 0
    for html, words in html_text.labelled_pages(120, seed=99):
        nodes, blocks = html_text.parse(html)
        belief, _ = model.marginals(nodes, html_text.features(nodes))
        for node, text in blocks:
            if text.strip():
                total += 1
                right += (belief[node] > 0.5) == bool(words & set(text.split()))
    assert right / total > 0.98


def test_marginals_are_those_of_the_joint_distribution():
    model = html_text.trained()
    nodes, _ = html_text.parse("<body><div class=ad><p>x y</p></div><article><h1>t</h1><p>a b</p></article>")
    found = html_text.features(nodes)
    belief, _ = model.marginals(nodes, found)
    n, mass, total = len(nodes), np.zeros(len(nodes)), 0.0
    for states in range(1 << n):
        s = [states >> i & 1 for i in range(n)]
        log = sum(sum(model.node.get(f, 0) for f in found[i]) for i in range(n) if s[i])
        log += sum(model.edge.get((nodes[i].tag, s[nodes[i].parent], s[i]), 0) for i in range(1, n))
        total += math.exp(log)
        mass += np.array(s) * math.exp(log)
    assert np.allclose(mass / total, belief)


IDS = 16 * 16 + lm_score.BANDS


def test_gradients_and_carried_state():
    rng = np.random.default_rng(0)
    v = lm_score.start_weights(np.ones(IDS), 16) + np.concatenate([[0, 0], rng.normal(0, 0.1, len(lm_score.start_weights(np.ones(IDS), 16)) - 2)]).astype(np.float32)
    docs = [rng.integers(0, IDS, n) for n in (20, 20, 20, 20)]
    inputs, targets, mask, _ = next(lm_score.windows(docs))
    h = np.zeros((4, lm_score.HIDDEN), np.float32)
    g = lm_score.flat(lm_score.gradients(lm_score.unflat(v), inputs, targets, mask, h)[0])

    def loss(vector):
        w = lm_score.unflat(vector)
        states, _ = lm_score.run_states(w, inputs, h)
        return -(lm_score.log_probs(w, states.reshape(-1, lm_score.HIDDEN), targets.reshape(-1)) * mask.reshape(-1)).sum() / mask.sum()

    for k in rng.choice(np.flatnonzero(abs(g) > 2e-3), 6):
        e = np.zeros(len(v), np.float32)
        e[k] = 1e-2
        assert (loss(v + e) - loss(v - e)) / 2e-2 == pytest.approx(g[k], rel=0.05, abs=1e-4)
    long = rng.integers(0, IDS, 150)  # over three windows, alone and beside others
    alone, beside = lm_score.score_docs(v, [long]), lm_score.score_docs(v, [docs[0], long, docs[1]])
    w, state, total, last = lm_score.unflat(v), np.zeros((1, lm_score.HIDDEN), np.float32), 0.0, 0
    for y in long:
        states, _ = lm_score.run_states(w, np.array([[last]]), state)
        state, last = states[-1], y
        total += float(lm_score.log_probs(w, state, np.array([y]))[0])
    assert alone[0] == pytest.approx(total, rel=1e-4) and beside[1] == pytest.approx(total, rel=1e-4)


def test_lm_base_scores_and_gain(spark, texts):
    got = {r.doc_id: r for r in lm_score.op9_lm_score(spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    words = {i: [*lm_score.words_of(t), None] for i, t in texts.items()}
    c = Counter(w for i in texts if not held[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words[i]), sum(c[w] > 0 for w in words[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]))
    kept = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)


def test_near_copy_groups_against_all_pairs(spark, texts):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r.doc_id for r in near_copies.one_of_each(frame).select("doc_id").collect()}
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and root[i] != root[j] and near_copies.jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert left == set(root.values())


@pytest.mark.parametrize("turn", range(3))
def test_shards_are_even_and_keep_groups_together(spark, turn):
    rows = [(i, "hot") for i in range(330)] + [(1000 + i, f"group {i // 5}") for i in range(400)] + [(5000 + i, f"alone {i}") for i in range(275)]
    rows = [rows[i] for i in np.random.default_rng(turn).permutation(len(rows))]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).toPandas()
    assert sorted(got.doc_id) == sorted(i for i, _ in rows)
    sizes = got.groupby("shard").size()
    assert len(sizes) == 10 and sizes.max() - sizes.min() <= 1
    for _, of in got.groupby("shard"):
        assert sorted(of.slot) == list(range(len(of)))
    spans = got.groupby(["g1", "g2"]).shard.nunique()
    members = got.groupby(["g1", "g2"]).size()
    assert (spans[members == 5] == 1).mean() > 0.8
    assert spans[members == 330].max() <= 5


def least_cut(sizes, quota):
    """The fewest pieces into which groups must fall to fill the shards exactly, by trying all ways."""

    @cache
    def fewest(left, room):
        if not left:
            return 0
        best = math.inf
        for parts in product(*(range(min(left[0], r) + 1) for r in room)):
            if sum(parts) == left[0]:
                after = tuple(sorted(r - p for r, p in zip(room, parts, strict=True)))
                best = min(best, sum(p > 0 for p in parts) + fewest(left[1:], after))
        return best

    return fewest(tuple(sorted(sizes, reverse=True)), tuple(sorted(quota)))


@pytest.mark.parametrize("sizes", [(7, 5, 4, 3, 2, 2, 1), (12, 4, 4, 2, 2), (3, 3, 3, 3, 3, 3, 3, 3), (24,), (1,) * 24, (6, 6, 6, 6)])
def test_shards_cut_little_more_than_they_must(spark, sizes):
    rows = [(100 * g + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).toPandas()
    assert sorted(got.groupby("shard").size()) == [6] * 4
    pieces = got.groupby(["g1", "g2"]).shard.nunique().sum()
    assert pieces <= least_cut(sizes, (6, 6, 6, 6)) + 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert plain(ours) == plain(theirs)


def fails_stage(text):
    """Rules of the pipeline's stage, plainly."""
    white = " \t\n\x0b\x0c\r"
    words = [w for w in re.split(f"[{white}]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(white)]
    letters = [c for c in text if unicodedata.category(c)[0] == "L"]
    upper = [c for c in letters if unicodedata.category(c) == "Lu"]
    n = len(words)
    return (
        n == 0 or 100 * len(covered) > (60 if n < 40 else 30) * n or sum(c in "#*$%&|<>" for c in text) > 0.1 * n or sum(map(len, words)) > 40 * n
        or len(lines) - len(set(lines)) > 0.4 * len(lines) or text.count("!") > 0.5 * n or (len(letters) >= 20 and len(upper) > 0.5 * len(letters))
    )


def test_passing_keeps_what_plain_rules_keep(spark):
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").text.to_dict()
    texts |= {-1: "same eight words in a row come here " * 4, -2: "", -3: "!" * 9, -4: None, -5: "a line\n\na line\nother", -6: "x" * 90}
    frame = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, words long")
    got = quality_rules.passing(frame)
    assert {r.doc_id for r in got.collect()} == {i for i, t in texts.items() if not fails_stage(t or "")}
    assert got.columns == frame.columns


def test_cascade_stops_at_the_first_rule_that_rejects(spark):
    rules = [quality_rules.Rule("all", "<n_words> >= 0"), quality_rules.Rule("never", "raise_error('reached') IS NULL")]
    frame = spark.createDataFrame([("some words",), ("",)], "text string")
    failed = frame.selectExpr(f"{quality_rules.first_failed(rules)} AS f")
    assert [r.f for r in failed.collect()] == ["all", "all"]
    with pytest.raises(Exception, match="reached"):
        frame.selectExpr(f"{quality_rules.first_failed(rules[::-1])} AS f").collect()


def test_cascade_computes_windows_in_branches_only(spark):
    plan = quality_rules.passing(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64(slice") <= 2 and "Project" not in plan  # one filter over the scan, no column of windows below it
    order = quality_rules.order_for(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), (*quality_rules.STAGE_BASE, *quality_rules.RULES))
    assert len(order) == 7
