"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import (
    common,
    decontamination,
    embeddings,
    html_text,
    language,
    licenses,
    line_chunks,
    minhash,
    mixing,
    sharding,
    toxicity,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, size string, "
    "hash string, key string, row string, node string, bands string, `group` string, shard string, slot string"
)
LONG = "the long text goes on and on " * 20_000
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
ROWS = [
    (1, "one two three four five six seven\nReleased under the MIT License.", "en", "a", 5),
    (1, "one two three four five six seven\nReleased under the MIT License.", "en", "a", 5),
    (2, "one two three four five six seven\nReleased under the MIT License.", "en", "b", None),
    (None, "you are an idiot and a moron", None, None, None),
    (None, None, None, None, None),
    (3, None, "en", "a", 1),
    (4, "", "de", "b", 0),
    (5, "", None, None, 0),
    (6, LONG, "en", "c", len(LONG)),
    (7, "  \n\t ?!", "fr", "c", 1),
    (8, "Ünïcode wörter ßind hier", "de", "", 1),
    (9, "a\nb\n\nc", "en", "a", 1),
]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [row + (0.5, *["x"] * 9) for row in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (6, 1, 0), (77, 1, 1)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "three, four FIVE"), (1, "wörter"), (None, "two three"), (2, None), (3, ""), (4, "absent words")],
        "item_id long, text string",
    )


def test_licenses(documents, nothing):
    rows = licenses.scan_licenses(documents).collect()
    assert len(rows) == len(ROWS)
    first = [row for row in rows if row.doc_id == 1]
    assert len(first) == 2 and first[0] == first[1]
    assert first[0].base_labels == "mit" and first[0].labels == "mit,mit-notice"
    assert (first[0].n_words, first[0].n_base, first[0].first_word, first[0].score) == (12, 1, 10, 1.0)
    for row in rows:
        if row.doc_id in (3, 4, 5, 7):
            assert (row.n_words, row.n_base, row.labels, row.score) == (0, 0, "", 0.0)
            assert row.first_word is None and row.last_word is None
    assert next(row.n_words for row in rows if row.doc_id == 6) == 7 * 20_000
    assert licenses.scan_licenses(nothing).collect() == []


def test_toxicity(documents, nothing, labels):
    model = toxicity.fit_toxicity(documents, labels)
    rows = toxicity.score_documents(documents, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= row.score <= 1 for row in rows)
    assert all(row.predicted == (row.score >= 0.3) for row in rows)
    assert all(row.held_out == (zlib.crc32(str(row.doc_id or "").encode()) % 4 == 2) for row in rows if row.doc_id)
    empty = {row.score for row in rows if row.doc_id in (3, 4, 5)}
    assert len(empty) == 1
    assert max(row.score for row in rows if row.doc_id is None) > max(empty)
    model = toxicity.fit_toxicity(nothing, labels.limit(0))
    assert toxicity.score_documents(nothing, model).collect() == []
    assert len(toxicity.score_documents(documents, model).collect()) == len(ROWS)


def test_samples_are_bounded_where_a_third_of_all_ids_is_null(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else i if i % 3 == 1 else -5, f"text {i} mill{i % 7}", "en") for i in range(3000)]
    rows += [(None, "the same text", "en")] * 300
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(-5, 0)] + [(i, i % 2) for i in range(1, 100, 3)], "doc_id long, toxic int")
    trained = []
    linear = toxicity._linear
    monkeypatch.setattr(toxicity, "_linear", lambda active, targets, many, width: trained.append((len(active), many.sum())) or linear(active, targets, many, width))
    toxicity.fit_toxicity(documents, labels, sample_rows=200)
    assert trained[0][0] < 100 and 200 < trained[0][1] < 500
    learned = []
    monkeypatch.setattr(language, "hash_share", lambda columns: learned.append(columns) or common.hash_share(columns))
    language.fit_profiles(documents, sample_texts=200)
    assert learned == [["doc_id", "text"]]
    shares = documents.select(common.hash_share(["doc_id", "text"]).alias("share"), "doc_id")
    assert 50 < shares.filter("doc_id IS NULL AND share < 0.1").distinct().count() < 150


def test_hot_copies_push_no_text_out_of_the_samples(spark, monkeypatch):
    """One text makes up nearly all of its language and of its label."""
    words = {"en": "the house and the river with a bird", "de": "das Haus und der Fluss mit einem Vogel"}
    rows = [(i, f"{text} {i}", lang) for lang, text in words.items() for i in range(300)]
    hot = spark.range(20_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("the same english text again").alias("text"), F.lit("en").alias("lang")
    )
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(hot)
    learned = []
    count = language.Profiles
    monkeypatch.setattr(language, "Profiles", lambda *own: learned.append(own[0]) or count(*own))
    profiles = language.fit_profiles(documents, sample_texts=300)
    assert learned == [["de", "en"]]
    found = language.identify(documents.filter("doc_id IS NOT NULL"), profiles)
    assert found.filter("lang_pred = 'en'").count() == 300 and found.filter("lang_pred = 'de'").count() == 300

    hot = hot.withColumn("doc_id", F.lit(1000).cast("long"))
    documents = documents.filter("doc_id IS NOT NULL").unionByName(hot)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1000, 0)], "doc_id long, toxic int")
    trained = []
    linear = toxicity._linear
    monkeypatch.setattr(toxicity, "_linear", lambda *own: trained.append((own[1], own[2])) or linear(*own))
    toxicity.fit_toxicity(documents, labels, sample_rows=300)
    # Labelled texts of both kinds, and no more than about twice the sample in all.
    assert 200 < trained[0][1].sum() < 800 and min(trained[0][1]) > 100


def test_more_values_than_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(i, f"text in language number {i % 5} {i}", f"l{i % 5}") for i in range(40)] + [(50, "one more text", "l3")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = [sum(lang == f"l{i}" and zlib.crc32(str(n).encode()) % 4 != 2 for n, _, lang in rows) for i in range(5)]
    most = sorted(range(5), key=lambda i: (-sizes[i], i))[:2]
    assert language.fit_profiles(documents).languages == sorted(f"l{i}" for i in most)


def test_mixing(documents, nothing):
    rows = mixing.mix(documents).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= row.taken <= 2 * row["size"] for row in rows)
    assert sorted(rows, key=repr) == sorted(mixing.mix(documents).collect(), key=repr)
    assert mixing.mix(nothing).collect() == []
    kept = mixing.mixed_documents(documents)
    assert kept.columns == documents.columns
    assert mixing.mixed_documents(nothing).count() == 0
    blank = documents.filter("doc_id IN (3, 4, 5)")
    assert [row.taken for row in mixing.mix(blank).collect()] == [0, 0, 0]


def test_repeated_rows_at_a_threshold_are_told_apart(spark):
    """A source of equal rows without ids ends as near to its target as one row allows."""
    rows = [(None, "eight words are in each of these rows", "b")] * 900 + [(None, "a b c", "c")] * 7
    rows += [(i, "word " * (1 + i % 50), "a") for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix(documents).collect()
    assert len(found) == len(rows)
    by_source = {}
    for row in found:
        by_source.setdefault((row.source_size, row.target), []).append(row)
    assert len(by_source) == 3
    for (size, target), own in by_source.items():
        largest = max(row["size"] for row in own)
        assert abs(sum(row.taken for row in own) - target) <= largest / 2 + 1e-6
        assert all(row.taken in (0, row["size"], 2 * row["size"]) for row in own)
    mixed = mixing.mixed_documents(documents)
    assert mixed.count() == sum(row.taken // row["size"] for row in found)
    again = mixing.mix(documents.repartition(2)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)


def test_more_lengths_of_vectors_than_axes(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "_LENGTHS", 1)
    rows = [(i, [float(i % 3), 1.0] + [0.5] * (i % 4), 0) for i in range(24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {row.vec_id: (row.n_links, row.component_id) for row in embeddings.near_vectors(frame).collect()}
    assert found == {i: (1, i % 12) for i in range(24)}


def test_repeated_items_are_one(spark):
    items = spark.createDataFrame([(7, "some words of the test")] * 500, "item_id long, text string")
    blocks = decontamination.benchmark_blocks(items, block_bytes=100)
    assert len(blocks) == 1
    documents = spark.createDataFrame([(1, "here are some words of the test again")], "doc_id long, text string")
    row = decontamination.scan_contamination(documents, items).first()
    assert (row.n_hit, row.n_items) == (5, 1)


def test_line_chunks(spark, documents, nothing):
    rows = line_chunks.without_repeated_chunks(documents).collect()
    assert len(rows) == len(ROWS)
    assert [row.n_lines for row in rows if row.doc_id == 3] == [0]
    assert [row.text for row in rows if row.doc_id == 6] == [LONG]
    assert [row.text for row in rows if row.doc_id == 3] == [None]
    assert line_chunks.without_repeated_chunks(nothing).collect() == []


def test_minhash(documents, nothing):
    rows = minhash.near_duplicates(documents).collect()
    assert len(rows) == len(ROWS)
    assert {row.class_id for row in rows if row.doc_id in (1, 2)} == {1}
    assert all(row.class_id == row.doc_id and row.kept for row in rows if row.doc_id in range(3, 10))
    assert minhash.near_duplicates(nothing).collect() == []
    kept = minhash.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(row.doc_id or 0 for row in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert minhash.without_near_duplicates(nothing).count() == 0


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>" + "word " * 100_000, "x"), (2, "u", "<p", "x"), (3, "u", "plain", "x")],
        "page_id long, url string, html string, text string",
    )
    rows = html_text.extract_pages(pages).collect()
    assert sorted((row.page_id or 0, row.n_chars) for row in rows) == [(0, 0), (1, 0), (2, 0), (2, 499_999), (3, 5)]
    assert html_text.extract_pages(pages.limit(0)).collect() == []


def test_sharding(documents, nothing):
    rows = sharding.shard_documents(documents, 3).collect()
    assert len(rows) == len(ROWS)
    for shard in {row.shard for row in rows}:
        assert sorted(row.slot for row in rows if row.shard == shard) == list(range(sum(row.shard == shard for row in rows)))
    assert {row["size"] for row in rows if row.doc_id in (3, 4, 5)} == {8}
    assert all(row.text_crc32 == zlib.crc32(b"") for row in rows if row.doc_id in (4, 5))
    assert len({row.shard for row in rows if row.doc_id in (4, 5)}) == 1
    assert sharding.shard_documents(nothing).collect() == []
    whole = sharding.sharded(documents, 3)
    assert sorted(whole.columns) == sorted(documents.columns)
    assert whole.count() == len(ROWS)


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0),
        (5, [0.0, 0.0], 0), (6, [1.0, nan], 0), (7, [inf, 0.0], 0), (8, [1.0, None], 0), (None, [1.0, 0.1], 0),
        (9, [1.0], 0), (10, [], 0), (11, [1e-200, 0.0], 0), (12, [1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(
        [row + ("x",) for row in rows], "vec_id long, embedding array<double>, label int, node string"
    )
    found = embeddings.near_vectors(frame).collect()
    assert len(found) == len(rows)
    by_id = {}
    for row in found:
        by_id.setdefault(row.vec_id, []).append((row.n_links, row.component_id, row.kept))
    assert by_id[1] == [(4, 1, True)] * 2
    assert by_id[2] == [(4, 1, False)] and by_id[11] == [(4, 1, False)] and by_id[None] == [(4, 1, False)]
    for alone in (3, 4, 5, 6, 7, 8, 9, 10, 12):
        assert by_id[alone] == [(0, alone, True)]
    assert embeddings.near_vectors(frame.limit(0)).collect() == []


def test_decontamination(documents, nothing, benchmark):
    rows = decontamination.scan_contamination(documents, benchmark).collect()
    assert len(rows) == len(ROWS)
    first = next(row for row in rows if row.doc_id == 1)
    assert (first.n_words, first.n_hit, first.n_items, first.contaminated) == (12, 4, 1, True)
    assert first.items_sha256 == hashlib.sha256(b"1").hexdigest()
    none = [row for row in rows if row.doc_id in (3, 4, 5, 6, 7, 9)]
    assert all((row.n_hit, row.n_items, row.contaminated) == (0, 0, False) for row in none)
    assert {row.items_sha256 for row in none} == {hashlib.sha256(b"").hexdigest()}
    assert decontamination.scan_contamination(nothing, benchmark).collect() == []
    clean = decontamination.scan_contamination(documents, benchmark.limit(0)).collect()
    assert not any(row.contaminated for row in clean)
    kept = decontamination.without_contaminated(documents, benchmark)
    assert kept.columns == documents.columns and kept.count() == 8


def test_language(documents, nothing):
    profiles = language.fit_profiles(documents)
    rows = language.identify(documents, profiles).collect()
    assert len(rows) == len(ROWS) and all(0 <= row.score <= 1 for row in rows)
    assert {row.lang_pred for row in rows if row.doc_id in (3, 4, 5, 7)} == {"und"}
    assert {row.lang_pred for row in rows} <= {"en", "de", "fr", "und"}
    empty = language.fit_profiles(nothing)
    assert {row.lang_pred for row in language.identify(documents, empty).collect()} == {"und"}
    assert language.identify(nothing, profiles).collect() == []


def test_pipeline_stages_keep_columns(spark, documents, nothing, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (documents, nothing):
        docs = start
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if number < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == start.columns
            assert docs.schema is not None
        rows = docs.count()
        assert rows == 0 if start is nothing else rows > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mix", "shard"]
    assert docs.filter(F.col("shard").isNull()).count() == 0
