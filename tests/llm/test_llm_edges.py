"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns in every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontaminate, html_text, importance, lm_score, near_copies, packing, quality_rules, sharding, simhash, token_files, url_filter
from gridloom.llm.tokens import public_path
from gridloom.llm.work import work_path

LONG = " ".join(f"word{i % 977} and" for i in range(20_000))
TEXTS = [(1, "A b c d"), (2, None), (3, ""), (4, " \n\t "), (5, "A b c d"), (5, "A b c d"), (None, "x y z"), (7, LONG), (8, LONG + " end"), (9, None)]
CLASH = {"fp": 1, "component_id": 2, "size": "s", "shard": 3, "slot": 4, "words": "w", "windows": 1, "row": 5, "uid": 6, "ids": b"x", "start": 1, "length": 2, "chunk": 1, "good": True, "fit": False, "n": 1, "node": 2, "bands": "b", "kept": None}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a B c d"), (2, None), (3, ""), (None, "x y z"), (4, "no such words at all here")], "item_id long, text string")


def counted(docs, none, f):
    assert f(none).count() == 0
    out = f(docs).collect()
    assert len(out) == len(TEXTS)
    return out


def test_simhash(docs, none):
    out = counted(docs, none, simhash.near_duplicates)
    of = {r.doc_id: r for r in out}
    assert of[1].component_id == of[5].component_id == 1
    assert {of[i].fp for i in (2, 3, 4, 9)} == {0} and {of[i].component_id for i in (2, 3, 4, 9)} == {2}
    assert of[None].component_id is None and of[8].component_id == 7


def test_token_files(spark, docs, none):
    run = lambda d: token_files.read_token_files(token_files.write_token_files(d, public_path("word_bpe_49k.json"), 1, work_path(spark, "t")))
    out = sorted(counted(docs, none, run), key=lambda r: r.start)
    assert out[0].doc_id is None and [r.doc_id for r in out[1:]] == [1, 2, 3, 4, 5, 5, 7, 8, 9]
    assert [r.start for r in out[1:]] == [sum(x.n_tokens for x in out[:i]) for i in range(1, len(out))]
    assert {r.n_tokens for r in out if r.doc_id in (2, 3, 4, 9)} == {1}


def test_decontamination(spark, docs, none, benchmark):
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect())
    assert got == [(1, 1), (5, 1), (5, 1)]
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 3


def test_url_filter(spark):
    urls = [(1, "HTTPS://A.Example.ORG/es/x?q#f"), (2, None), (3, "no scheme"), (4, ""), (5, "://"), (6, "x://com"), (6, "x://com"), (None, "x://sub.free-bets.example.com/p#?")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    lists = [url_filter.UrlList(spark.createDataFrame([*rows, (None, "block")], "key string, value string"), "u") for rows in (url_filter.RULES, [(k, "block") for k in url_filter.BLOCKED])]
    assert url_filter.judge(pages.where("false"), *lists).count() == 0
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, *lists).collect()}
    assert got == {1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("com", "", None, "allow"), None: ("sub.free-bets.example.com", "/p", None, "block")}
    empty = url_filter.UrlList(spark.createDataFrame([], "key string, value string"), "u")
    assert {r.verdict for r in url_filter.judge(pages, empty, empty).collect()} == {"allow"}


def test_packing(docs, none):
    assert packing.pack(none, public_path("byte_bpe_50k.json")).count() == 0
    out = packing.pack(docs, public_path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in out if r.doc_id in (2, 3, 9)) == 3
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_quality_classifier(docs, none, labels):
    out = counted(docs, none, lambda d: importance.resample(d, labels))
    assert {r.log_weight for r in out if r.doc_id in (2, 3, 4, 9)} == {0.0}
    assert all(r.kept for r in importance.resample(docs, labels.where("false")).collect())


def test_quality_rules(docs, none):
    out = counted(docs, none, quality_rules.judged)
    assert {r.n_words for r in out if r.doc_id in (2, 3, 4, 9)} == {0}
    assert quality_rules.passing(docs).columns == docs.columns
    repeated = [r.n_repeat_words for r in out if r.doc_id == 7]
    assert repeated == [len(LONG.split())]


def test_html(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<article><p>One &amp;\n two<p>three"), (3, None, "<article><p>One &amp;\n two<p>three"), (None, "u", "<nav><a href=x>menu</a></nav>"), (5, "u", "<p>" * 3000), (6, "u", "<script>never ends <p>no</p>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert html_text.main_text(table.where("false")).count() == 0
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(table).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("One & two\n\nthree", 16), None: ("", 0), 5: ("", 0), 6: ("", 0)}


def test_lm(docs, none):
    out = counted(docs, none, lm_score.score)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3, 4, 9)} == {1}
    assert len({r.train_tokens for r in out}) == 1 and all(r.score < 0 and r.base_score < 0 for r in out)


def test_sharding(docs, none):
    out = counted(docs, none, lambda d: sharding.balanced_shards(d, shards=3))
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sorted(sum(r.shard == s for r in out) for s in range(3)) == [3, 3, 4]
    assert {(r.size, r.text_crc32) for r in out if r.doc_id in (2, 3, 9)} == {(16, 0)}


def test_near_copies(docs, none):
    assert near_copies.one_of_each(none).count() == 0
    left = near_copies.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.select("doc_id").collect()) == [(False, 1), (False, 2), (False, 7), (True, 0)]


def test_stages_take_such_rows(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out.collect()
