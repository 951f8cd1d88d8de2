"""Cases that an operator once cut short: long batches, odd pages, large buckets, benchmarks in parts."""

import resource
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from gridloom.llm import decontaminate, graph, html_text, importance, lm_score, near_copies, packing, simhash, tokens


IDS = 16 * 16 + lm_score.BANDS


def test_lm_lanes_hold_every_token_once():
    rng = np.random.default_rng(3)
    docs = [rng.integers(1, IDS, n) for n in (1, 2 * lm_score.STRETCH + 7, *rng.integers(1, 200, 60), lm_score.STRETCH)]
    seen = []
    for inputs, targets, mask, before in lm_score.lanes(docs, 8):
        assert inputs.shape == targets.shape == mask.shape and len(before) == inputs.shape[1] <= 8
        seen += list(zip(inputs[mask > 0].tolist(), targets[mask > 0].tolist(), strict=True))
    assert sorted(seen) == sorted((a, b) for d in docs for a, b in zip([0, *d[:-1].tolist()], d.tolist(), strict=True))



def test_network_reads_no_padding_and_keeps_its_memory(monkeypatch):
    """Scoring computes no logits past a document's end, and training doesn't have every window's arrays faulted in again."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, IDS, n) for n in rng.integers(1, 400, 300)]
    start, read, plain = lm_score.start_weights(np.ones(IDS), 16), [], lm_score._log_probs
    monkeypatch.setattr(lm_score, "_log_probs", lambda w, states, targets: (read.append(len(targets)), plain(w, states, targets))[1])
    lm_score.score_docs(start, docs)
    assert sum(read) == sum(map(len, docs))
    lm_score.train(start, docs, 0.02)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    lm_score.train(start, docs, 0.02)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 2000


def test_lm_learns_from_the_shortest_document_of_a_long_batch(spark):
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, IDS, 480) for _ in range(2700)]
    start = lm_score.start_weights(np.ones(IDS), 16)
    found = []
    for last in (np.arange(1, 41), np.arange(40, 0, -1)):
        rows = [(d.astype("<u4").tobytes(),) for d in [*docs, last]]
        found.append(lm_score._average(spark, spark.createDataFrame(rows, "ids binary").coalesce(1), start, 0.02))
    assert np.abs(found[0] - found[1]).max() > 0


@pytest.mark.parametrize(
    "before",
    [
        '<svg class="icon"/>',
        "<div><svg><path d='m'></div>",
        "<svg><title/><path d='m'><p>start</p>",
        "<div><svg><g><text>drawn</text></g></svg></div>",
        "<datalist><option value=a><option value=b></datalist>",
        "<form><select><option>gone<option>gone too</select></form>",
        "<form><select><optgroup><option>gone</form>",
        "<option>gone",
        "<div><object data=x><p>gone</p></div>",
        "<div><template><p>gone</p></div>",
    ],
)
def test_html_text_after_hollow_elements_is_kept(before):
    _, blocks = html_text.parse(f"<body>{before}<article><p>kept <b>words</b></p><p>more</p></article></body>")
    text = " ".join(t for _, t in blocks)
    assert "kept words" in text and "more" in text and "gone" not in text and "drawn" not in text


def test_html_hollow_elements_do_not_split_a_block():
    _, blocks = html_text.parse("<p>one <svg><g><br><text>no</text></g></svg>two <a href=x><svg></a>three</p><p>four")
    assert [t for _, t in blocks] == ["one two three", "four"]


def test_near_copies_of_an_absent_source(spark):
    rng = np.random.default_rng(6)
    source = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    texts = {}
    for i in range(150):
        words = list(source)
        for at in rng.choice(300, rng.integers(3, 10), replace=False):
            words[at] = f"edit{rng.integers(0, 10**9)}"
        texts[i] = " ".join(words)
    keys = {i: near_copies.bands(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in range(i):  # all pairs of a bucket
            if root[i] != root[j] and any(x == y for x, y in zip(keys[i], keys[j], strict=True)) and near_copies.jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    left = near_copies.one_of_each(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in left.select("doc_id").collect()} == set(root.values())


def test_decontamination_is_the_same_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    common = [" ".join(f"c{x}" for x in rng.integers(0, 999, 12)) for _ in range(4)]
    own = lambda n: " ".join(f"o{x}" for x in rng.integers(0, 10**6, n))
    items = [(i, f"{own(9)} {common[i % 4]} {own(9)}") for i in range(40)]
    docs = []
    for i, text in items:
        for at in (1, 3, 5, 12, 27):
            words = text.split()
            words[at] = "changed"
            docs.append((len(docs), f"{own(5)} {' '.join(words)} {common[(i + 1) % 4]}"))
    docs = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    find = lambda: sorted(tuple(r) for r in decontaminate.contaminated(docs, benchmark).collect())
    whole = find()
    monkeypatch.setattr(decontaminate, "PART_BYTES", 2500)
    assert whole and find() == whole


def shuffled(n):
    return np.random.default_rng(9).permutation(n).tolist()


@pytest.mark.parametrize("order", [range(4000), range(3999, -1, -1), shuffled(4000)], ids=["up", "down", "shuffled"])
def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch, order):
    turns, hooks = [], graph._hooks
    monkeypatch.setattr(graph, "_hooks", lambda pairs, total, turn: turns.append(turn) or hooks(pairs, total, turn))
    nodes = list(order)
    found = graph.connected_components(spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long").coalesce(1)).collect()
    assert len(found) == 4000 and {r.root for r in found} == {0} and len(turns) <= 9


def test_components_of_stars_and_repeated_pairs(spark, monkeypatch):
    turns, hooks = [], graph._hooks
    monkeypatch.setattr(graph, "_hooks", lambda pairs, total, turn: turns.append(turn) or hooks(pairs, total, turn))
    pairs = [(5000, i) for i in range(3000)] + [(6000, 6000 + i) for i in range(3000)] + [(7, 7), (None, 3), (3, None), (20001, 20000), (20000, 20001)]
    found = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long").coalesce(1)).collect()}
    want = {i: 0 for i in [*range(3000), 5000]} | {6000 + i: 6000 for i in range(3000)} | {20000: 20000, 20001: 20000}
    assert found == want and len(turns) <= 3
    assert graph.connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


@pytest.mark.parametrize("shared", [2, 3, 5, 9])
def test_every_grid_meets_every_pair_within_the_radius(shared):
    rng = np.random.default_rng(shared)
    masks = simhash.grid_masks(3, shared)
    code = lambda x: ((x | x >> 1) & simhash.LOW) | ((x & x >> 1 & simhash.LOW) << 1)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        assert any(code(a) & (m & (1 << 64) - 1) == code(b) & (m & (1 << 64) - 1) for m in masks)


#: Written by hand, in the manner of real pages; what is to be kept stands beside each.
PAGES = {
    """<!doctype html><html><head><title>Tide tables</title><style>p{x:1}</style></head><body>
<header id="masthead"><a href="/">Harbour Gazette</a><nav class="menu"><ul><li><a href="/n">News</a><li><a href="/s">Sport</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies. <button>Accept</button></p></div>
<article class="post"><h1>Tides run high this week</h1><p class=lead>The spring tide of Tuesday reached <b>5.2&nbsp;metres</b>, the harbour office says.
<p>Boats were kept in port until noon; the ferry ran an hour late.<blockquote><p>We have not seen the like since 1998.</p></blockquote>
<p>The next high water is due on Friday at 06:40.</article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href=1>Ten walks by the sea</a></ul></aside>
<section class="comments" id="comments"><h3>2 comments</h3><div class="comment"><p>Same in my street!</p></div></section>
<footer>&copy; Harbour Gazette <a href="/legal">Legal</a></footer><script>var x = "<p>no</p>";</script></body></html>""":
    "Tides run high this week\n\nThe spring tide of Tuesday reached 5.2 metres, the harbour office says.\n\nBoats were kept in port until noon; the ferry ran an hour late.\n\nWe have not seen the like since 1998.\n\nThe next high water is due on Friday at 06:40.",
    """<html><body><div class="topbar"><a href=a>Home</a> <a href=b>Recipes</a></div><div class="content"><h2>Plain bread</h2>
<p>Mix flour, water and salt.</p><ul><li>500 g flour</li><li>350 g water</li></ul><div class="ad"><p>Knives now half price</p></div><p>Bake for 40 minutes.</p></div>
<form class="newsletter"><label>Your mail</label><input name=m><button>Subscribe</button></form><div class="footer"><p>Copyright 2020</p></div></body></html>""":
    "Plain bread\n\nMix flour, water and salt.\n\n500 g flour\n\n350 g water\n\nBake for 40 minutes.",
    """<body><nav><a href=/>Start</a></nav><main><article><h1>On moss</h1><p>Moss has no roots.<br>It drinks by its leaves.</p><p>It is old.</p></article></main><footer><ul><li><a href=x>Contact</a></ul></footer></body>""":
    "On moss\n\nMoss has no roots. It drinks by its leaves.\n\nIt is old.",
}


def test_pages_labelled_by_hand():
    for html, want in PAGES.items():
        assert "\n\n".join(html_text.extract(html, html_text.trained())) == want


@pytest.mark.parametrize("page", ["<b>x" * 16000, "<i>" * 8000 + "<p>y</p>" * 8000, "<a " * 50000, '<a href="x>' * 20000 + "<p>text</p>", "<div>" * 4000 + "</b>" * 4000, "<h1>" * 4000 + "<p></p>" * 4000])
def test_odd_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 3  # 0.1 s; tens of seconds if quadratic


def test_a_quote_left_open_loses_no_paragraph():
    assert [t for _, t in html_text.parse('<body><p><a href="x>link</a></p><p class="y">kept</p><p title="a<b">one<img alt="x > y"></p>')[1]] == ["link", "kept", "one"]


def test_packing_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = tokens.encoder(tokens.public_path("byte_bpe_50k.json")).tokenizer
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    pieces, fill = Counter(), {}
    rows = sorted(packing.op5_packing(spark, "/root/testdata/sf0.001").collect(), key=lambda r: (r.doc_id, r.start))
    for r in rows:
        own = ids[r.doc_id]
        assert r.start == pieces[r.doc_id] and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id] += r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces == {i: len(x) for i, x in ids.items()}
    for parts in fill.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(fill) <= -(-sum(pieces.values()) // 2048) + 1


def test_importance_weights_and_sample_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ids = docs.limit(120).toPandas().doc_id.tolist()
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in ids], "doc_id long, quality int")
    got = {r.doc_id: r for r in importance.resample(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    fit = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).collect()}
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        words = (t or "").split()
        grams = importance.features(t).tolist()
        assert len(grams) == max(0, 2 * len(words) - 1)
        raw.update(grams)
        if i in fit and i % 3 > 0:
            target.update(grams)
    share = lambda c, k: (c[k] + 1) / (sum(c.values()) + importance.BUCKETS)
    ratio = {k: np.log(share(target, k) / share(raw, k)) for k in raw}
    for i, t in texts.items():
        grams = importance.features(t).tolist()
        assert got[i].log_weight == pytest.approx(256 * sum(ratio[k] for k in grams) / (len(grams) + 20))
    judged = [got[i] for i in ids if i not in fit]
    cuts = sorted({r.log_weight for r in judged})
    loss = lambda cut: 50 * sum(r.log_weight < cut for r in judged if r.doc_id % 3) + sum(r.log_weight >= cut for r in judged if r.doc_id % 3 == 0)
    best = min([cuts[0], *cuts], key=loss)
    below = [c for c in cuts if c < best]
    k = sum(r.log_weight >= ((best + max(below)) / 2 if below else -np.inf) for r in got.values())
    least = sorted((r.gumbel_key for r in got.values()), reverse=True)[k - 1]
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if r.gumbel_key >= least}


def test_near_copies_made_from_templates(spark):
    rng = np.random.default_rng(12)
    core = [f"c{x}" for x in range(400)]
    texts = {}
    for pair in range(40):
        own = [f"o{pair}x{k}" for k in range(56)]
        one = core[:200] + own + core[200:]
        two = list(one)
        for at in rng.choice(len(one), 9, replace=False):
            two[at] = f"edit{pair}x{at}"
        texts[2 * pair], texts[2 * pair + 1] = " ".join(one), " ".join(two)
    root = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if root[i] != root[j] and near_copies.jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    left = near_copies.one_of_each(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in left.select("doc_id").collect()} == set(root.values()) and len(set(root.values())) < 80


def test_the_pipeline_is_its_stages_in_order(spark):
    from test_llm_exact import fails_stage

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in importance.resample(docs, labels).where("kept").collect()}
    kept = {i for i in kept if not fails_stage(texts[i] or "")}
    root = {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            if j < i and root[i] != root[j] and near_copies.jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    known = decontaminate.Items(sorted(pd.read_parquet(f"{sf}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False, name=None)))
    kept = {i for i in set(root.values()) if not known.search(decontaminate.words_of(texts[i]))}
    out = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in out} == kept and all(r.n == r["all"] for r in out)


def test_word_counts_move_once(spark, monkeypatch):
    stored, keep = [], lm_score.work_table
    monkeypatch.setattr(lm_score, "work_table", lambda df, name: (stored.append(name), keep(df, name))[1])
    texts = ["a b a", "b c", None, "a d"]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert stored == ["lm-counts", "lm-encoded"]  # the words' lists were stored once more before they were counted
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(4)}
    known = {w for i, t in enumerate(texts) if not held[i] for w in (t or "").split()}
    assert {i: r.n_known for i, r in got.items()} == {i: 1 + sum(w in known for w in (t or "").split()) for i, t in enumerate(texts)}
