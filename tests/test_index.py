import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from wordloom import (
    append_index,
    compact_index,
    create_index,
    optimize_index,
    read_index,
    refresh_document_frequency,
    search_any_position,
    search_word,
    search,
    stream_index,
    write_index,
)
from wordloom.operators import indexing
from wordloom.sources.index import commits, index_settings

POSTING = ["bin", "hash", "text_id", "positions", "term_frequency", "words_total"]


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "index")


def content(index):
    return (
        sorted(map(tuple, index.postings.select(POSTING).collect())),
        sorted(map(tuple, index.word_counts.collect())),
        sorted(map(tuple, index.hash_metadata.select("bin", "hash", "document_count").collect())),
        tuple(index.stats.first()),
        index.bins,
        index.hash_function,
    )


def test_index_invariants(spark, micro_texts, micro_index):
    lengths = dict(micro_index.word_counts.collect())
    assert lengths == {1: 4, 2: 6, 3: 5, 4: 4, 5: 0, 6: 4, 7: 6, 8: 3}
    rows = micro_index.postings.collect()
    for text_id, words in lengths.items():
        places = [p for row in rows if row.text_id == text_id for p in row.positions]
        assert sorted(places) == list(range(words))
    assert all(row.positions == sorted(row.positions) for row in rows)
    assert all(row.term_frequency == len(row.positions) for row in rows)
    assert all(row.words_total == lengths[row.text_id] for row in rows)
    assert all(int(row.hash, 16) % 7 + 1 == row.bin for row in rows)
    counts = micro_index.hash_metadata.agg(F.sum("document_count"), F.count("hash")).first()
    assert tuple(counts) == (len(rows), len({row.hash for row in rows}))
    assert tuple(micro_index.stats.first()) == (8, 4.0)
    assert tuple(indexing.index_totals(micro_index.word_counts).first()) == (8, 32)
    report = indexing.index_bin_report(micro_index.postings).collect()
    assert sum(row.postings for row in report) == len(rows)


def test_stored_index_equals_index_in_memory(micro_texts, micro_index):
    assert content(micro_index) == content(indexing.build_index(micro_texts, 7))


def test_grouping_in_the_row_equals_grouping_by_shuffle(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("text_id"), "text"
    )
    from wordloom.functions.text import with_tokens

    exploded = (
        with_tokens(texts)
        .select("text_id", F.posexplode("tokens").alias("position", "word"))
        .groupBy("text_id", "word")
        .agg(F.sort_array(F.collect_list("position")).alias("positions"))
    )
    rows = indexing.text_words(texts).select("text_id", "word", "positions")
    assert rows.exceptAll(exploded).isEmpty() and exploded.exceptAll(rows).isEmpty()


def test_null_text_has_no_words(spark, path):
    texts = spark.sql("SELECT 1L AS text_id, CAST(NULL AS STRING) AS text")
    index = write_index(texts, path)
    assert index.word_counts.collect() == [(1, 0)] and index.postings.isEmpty()


def test_batches_and_layout_change_nothing(spark, micro_texts, micro_index, tmp_path):
    path, target = str(tmp_path / "parts"), str(tmp_path / "sorted")
    create_index(spark, path, 7)
    for part in range(3):
        assert append_index(micro_texts.filter(F.col("text_id") % 3 == part), path)[0] in (2, 3)
    refresh_document_frequency(spark, path)
    assert content(read_index(spark, path)) == content(micro_index)

    assert optimize_index(spark, path, target) == (8, 32)
    assert content(read_index(spark, target)) == content(micro_index)
    files = spark.read.parquet(f"{target}/postings").withColumn("file", F.input_file_name())
    per_bin = files.groupBy("bin").agg(F.count_distinct("file").alias("files")).collect()
    assert all(row.files <= 2 for row in per_bin)


def test_create_twice_fails(spark, path):
    create_index(spark, path, 5, "blake2b")
    assert index_settings(spark, path) == (5, "blake2b")
    with pytest.raises(Exception, match="already exists"):
        create_index(spark, path)
    with pytest.raises(ValueError):
        create_index(spark, path + "2", 0)
    with pytest.raises(ValueError):
        create_index(spark, path + "3", 5, "crc")


def test_duplicates(spark, micro_texts, micro_index, path):
    create_index(spark, path, 7)
    some = micro_texts.filter("text_id < 4")
    append_index(some, path, batch="first")
    with pytest.raises(ValueError, match="3 texts are in the index"):
        append_index(micro_texts, path)
    with pytest.raises(ValueError, match="no two the same"):
        append_index(some.union(some), path)
    assert append_index(micro_texts, path, "rest", on_duplicate="skip") == (5, 17)
    # The same batch again replaces itself.
    assert append_index(micro_texts.filter("text_id >= 4"), path, "rest") == (5, 17)
    refresh_document_frequency(spark, path)
    assert content(read_index(spark, path)) == content(micro_index)
    assert commits(spark, path).agg(F.sum("texts")).first()[0] == 8


def test_unfinished_append_is_invisible(spark, micro_texts, micro_index, path):
    create_index(spark, path, 7)
    append_index(micro_texts, path)
    refresh_document_frequency(spark, path)
    rows = indexing.postings_and_lengths(
        spark.sql("SELECT 99L AS text_id, 'green' AS text"), 7
    )
    rows.write.partitionBy("bin").parquet(f"{path}/postings/batch=lost")
    rows.write.partitionBy("bin").parquet(f"{path}/hash_metadata/version=5")
    assert content(read_index(spark, path)) == content(micro_index)


def test_stale_document_frequency(spark, ask, path):
    texts = spark.sql("SELECT * FROM VALUES (1L, 'a b'), (2L, 'b'), (3L, 'c') AS t(text_id, text)")
    more = spark.sql("SELECT * FROM VALUES (4L, 'b new'), (5L, 'new') AS t(text_id, text)")
    create_index(spark, path, 3)
    append_index(texts, path)
    refresh_document_frequency(spark, path)
    append_index(more, path)
    index = read_index(spark, path)
    assert index.stats.first().total_documents == 5
    found = search_word(index, ask("new")).collect()
    assert [(r.text_id, r.bm25_score, r.matching_words) for r in found] == [(4, None, 1), (5, None, 1)]
    for method in ("exact_phrase", "any_position"):
        assert [r.text_id for r in search(index, ask("new"), method=method).collect()] == [4, 5]
    # Among several words the uncounted one is dropped, though the counted one finds new texts.
    found = search_any_position(index, ask("b new"))
    assert sorted(r.text_id for r in found.collect()) == [1, 2, 4]
    refresh_document_frequency(spark, path)
    found = search_any_position(read_index(spark, path), ask("b new"))
    assert [r.text_id for r in found.collect()] == [4]


def test_scan_reads_only_the_bins_and_columns_of_the_request(spark, micro_index, ask):
    found = search_any_position(micro_index, ask("green energy"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans
    for scan in scans:
        assert "bin#" in scan.split("PartitionFilters:")[1].split("]")[0]
        assert "positions" not in scan.split("ReadSchema:")[1]
        assert "hash" in scan.split("PushedFilters:")[1]
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_best_rows_are_cut_before_the_shuffle(micro_index, ask):
    plan = search_any_position(micro_index, ask("green energy", "the market"), k=10)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    plan = search_any_position(micro_index, ask("green energy"), k=10)
    assert "TakeOrderedAndProject" in plan._jdf.queryExecution().executedPlan().toString()


def test_index_is_built_without_python_or_shuffle(spark, micro_texts):
    plan = indexing.postings(micro_texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_streamed_index(spark, micro_texts, micro_index, tmp_path):
    source, path, checkpoint = (str(tmp_path / name) for name in ("in", "index", "progress"))
    create_index(spark, path, 7)

    def run():
        stream = spark.readStream.schema("text_id long, text string").option(
            "maxFilesPerTrigger", 1
        ).parquet(source)
        stream_index(stream, path, checkpoint).awaitTermination()
        refresh_document_frequency(spark, path)
        return content(read_index(spark, path))

    micro_texts.filter("text_id <= 5").repartition(2).write.parquet(source)
    run()
    micro_texts.filter("text_id > 5").repartition(2).write.mode("append").parquet(source)
    assert run() == content(micro_index)
    # A restart finds nothing to do, and a text that comes again is left out.
    assert run() == content(micro_index)
    micro_texts.filter("text_id = 3").write.mode("append").parquet(source)
    assert run() == content(micro_index)


@pytest.mark.parametrize("broadcasts", ["10MB", "-1"])
def test_candidates_are_rows_of_fixed_size(spark, monkeypatch, micro_index, ask, broadcasts):
    """What moves in the wide route is a posting, or a request with a text: nothing that grows with a text's words."""
    import wordloom.plans.matching as matching

    monkeypatch.setattr(matching, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(matching, "DIRECT_POSTINGS", 0)
    plan = matching.compile_requests(micro_index, ask("the market", "the green energy market report"))
    assert set(plan.routes) == {"wide"} and plan.most_words == 5
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    try:
        hits = matching.route_hits(micro_index, plan, "wide", ["term_frequency"])
        node = hits._jdf.queryExecution().sparkPlan()
        nodes = [node]
        for node in nodes:
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
        assert any("SortMergeJoin" in node.nodeName() or "BroadcastHashJoin" in node.nodeName() for node in nodes)
        assert not any("array" in node.schema().simpleString() for node in nodes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_requests_go_to_the_texts_without_a_shuffle(spark, monkeypatch, micro_index, ask):
    import wordloom.plans.matching as matching
    from wordloom.plans.search import _any_position_matches, _phrase_matches

    monkeypatch.setattr(matching, "DIRECT_POSTINGS", 0)
    for matches in (_any_position_matches, _phrase_matches):
        plan = matching.compile_requests(micro_index, ask("the market", "green energy"), "require", by_text=True)
        assert set(plan.routes) == {"text"}
        text = matches(micro_index, plan, 10, 1.5, 0.75)._jdf.queryExecution().executedPlan().toString()
        of_texts = [line for line in text.splitlines() if "FileScan" in line]
        assert of_texts and "Exchange hashpartitioning" not in text and "postings" not in text
        unread = "positions" if matches is _any_position_matches else "frequencies"
        assert all(unread not in line.split("ReadSchema:")[1] for line in of_texts)


def test_the_index_by_text_is_that_by_word(spark, micro_texts, tmp_path):
    """Made in memory or stored, with either hash, appended, rewritten and compacted."""
    for hash_function in ("md5", "blake2b"):
        path, target = str(tmp_path / hash_function), str(tmp_path / f"{hash_function}-sorted")
        create_index(spark, path, 7, hash_function)
        for part in range(3):
            append_index(micro_texts.filter(F.col("text_id") % 3 == part), path, f"part{part}")
        refresh_document_frequency(spark, path)
        compact_index(spark, path, ["part0", "part2"])
        optimize_index(spark, path, target)
        memory = indexing.build_index(micro_texts, 7, hash_function)
        expected = sorted(map(tuple, memory.postings.select(POSTING).collect()))
        for index in (memory, read_index(spark, path), read_index(spark, target)):
            own = indexing.postings_of_texts(index.text_words, 7)
            assert sorted(map(tuple, own.filter("bin > 0").select(POSTING).collect())) == expected
            assert sorted(own.filter("bin = 0").select("text_id", "words_total").collect()) == sorted(
                index.word_counts.collect()
            )


def test_document_frequency_adds_up_batches(spark, micro_texts, micro_index, path, monkeypatch):
    """A refresh reads no posting; a batch that is written again is counted as it is now."""
    from wordloom.sources import index as store

    create_index(spark, path, 7)
    append_index(micro_texts.filter("text_id < 3"), path, "first")
    read = []
    of_batches = store._of_batches

    def spied(spark, folder, batches, schema):
        read.append((folder.removeprefix(f"{path}/"), sorted(batches)))
        return of_batches(spark, folder, batches, schema)

    monkeypatch.setattr(store, "_of_batches", spied)
    refresh_document_frequency(spark, path)
    assert read == [("batch_frequency", ["first"])]
    read.clear()
    append_index(micro_texts.filter("text_id IN (3, 4)"), path, "second")
    append_index(micro_texts.filter("text_id > 4"), path, "third")
    # An append looks for its ids among the lengths of others, and otherwise reads only what it wrote.
    assert {(folder, *names) for folder, names in read if names not in (["second"], ["third"])} == {
        ("postings", "first"), ("postings", "first", "second"),
    }
    read.clear()
    refresh_document_frequency(spark, path)
    assert read == [("batch_frequency", ["second", "third"])]
    assert content(read_index(spark, path)) == content(micro_index)
    full = indexing.document_frequency(read_index(spark, path).postings)
    assert sorted(map(tuple, full.collect())) == content(micro_index)[2]

    read.clear()
    append_index(micro_texts.filter("text_id = 3"), path, "second")
    assert read_index(spark, path).uncounted_texts == 1
    read.clear()
    refresh_document_frequency(spark, path)
    assert read == [("batch_frequency", ["first", "second", "third"])]
    index = read_index(spark, path)
    full = indexing.document_frequency(index.postings)
    assert sorted(map(tuple, index.hash_metadata.select("bin", "hash", "document_count").collect())) == sorted(
        map(tuple, full.collect())
    )
    assert index.uncounted_texts == 0 and index.known_postings == index.postings.count()


def test_a_micro_batch_looks_at_no_batch_of_its_stream(spark, micro_texts, micro_index, tmp_path, monkeypatch):
    from wordloom.sources import index as store

    source, path, checkpoint = (str(tmp_path / name) for name in ("in", "index", "progress"))
    create_index(spark, path, 7)
    append_index(micro_texts.filter("text_id <= 2"), path, "before")
    for part in range(3, 9):
        # Each file has one new text, and all that came before it.
        micro_texts.filter(f"text_id <= {part}").coalesce(1).write.mode("append").parquet(source)
    looked = []
    of_batches, finished = store._of_batches, store._finished
    monkeypatch.setattr(
        store, "_of_batches", lambda *own: looked.append((own[1].split("/")[-1], sorted(own[2]))) or of_batches(*own)
    )
    monkeypatch.setattr(store, "_finished", lambda *own: looked.append("commits") or finished(*own))
    stream = spark.readStream.schema("text_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    stream_index(stream, path, checkpoint).awaitTermination()
    monkeypatch.undo()
    assert looked.count("commits") == 1
    batches = {name for entry in looked if entry != "commits" for name in entry[1]} - {"before"}
    assert len(batches) == 6
    # Each batch is read while it is written, and by no other.
    assert all(len(entry[1]) == 1 for entry in looked if entry != "commits")
    runs = [entry[1][0] for entry in looked if entry != "commits" and entry[1] != ["before"]]
    assert sum(one != two for one, two in zip(runs, runs[1:])) == 5
    refresh_document_frequency(spark, path)
    assert content(read_index(spark, path)) == content(micro_index)


def test_a_micro_batch_is_computed_once(spark, micro_texts, micro_index, tmp_path, monkeypatch):
    from wordloom.streaming import append as streaming

    source, path, checkpoint = (str(tmp_path / name) for name in ("in", "index", "progress"))
    create_index(spark, path, 7)
    micro_texts.union(micro_texts).repartition(2).write.parquet(source)
    plans = []

    def append(texts, *own):
        conf = texts.sparkSession.conf.get("spark.sql.adaptive.enabled")
        plans.append((texts._jdf.queryExecution().executedPlan().toString(), conf))
        return append_index(texts, *own)

    monkeypatch.setattr(streaming, "append_index", append)
    stream = spark.readStream.schema("text_id long, text string").parquet(source)
    stream_index(stream, path, checkpoint).awaitTermination()
    # What is indexed is a table: no job over it meets the state again, and bins are brought together.
    assert plans and all("Deduplicate" not in plan and conf == "true" for plan, conf in plans)
    batch = next((tmp_path / "index" / "postings").iterdir())
    assert all(len(list(own.glob("*.parquet"))) == 1 for own in batch.glob("bin=*"))
    assert not list((tmp_path / "index" / "incoming").iterdir())
    refresh_document_frequency(spark, path)
    assert content(read_index(spark, path)) == content(micro_index)


def rows_read(frame):
    """Rows that came out of the scans of files."""
    frame.collect()
    nodes = [frame._jdf.queryExecution().executedPlan()]
    total = 0
    for node in nodes:
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_rare_words_skip_batches_without_them(spark, path):
    """Unsorted batches, one bin: the Bloom filter of a row group tells that it does not have the word."""
    create_index(spark, path, 1)
    for part in range(6):
        rows = spark.range(part * 500, part * 500 + 500, 1, 1)
        texts = rows.select(F.col("id").alias("text_id"), F.concat(F.lit(f"word{'abcdef'[part]} "), "id").alias("text"))
        append_index(texts, path, f"part{part}")
    refresh_document_frequency(spark, path)
    index = read_index(spark, path)
    word = index.postings.filter(F.col("hash") == F.md5(F.lit("wordd"))).select("text_id")
    keys = ("parquet.filter.bloom.enabled", "parquet.filter.dictionary.enabled")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    read = {}
    try:
        for bloom in ("true", "false"):
            conf.set(keys[0], bloom)
            conf.set(keys[1], "false")
            own = read_index(spark, path).postings.filter(F.col("hash") == F.md5(F.lit("wordd"))).select("text_id")
            read[bloom] = rows_read(own)
    finally:
        for key in keys:
            conf.unset(key)
    assert word.count() == 500
    # One batch of six.
    assert read["true"] <= 1_500 and read["false"] > 4 * read["true"]


def test_positions_take_little_room(spark, tmp_path):
    """Rising numbers are stored as differences: less than two bytes each, where plain ones take four."""
    import glob
    import os

    texts = spark.range(200).select(F.col("id").alias("text_id"), F.repeat(F.lit("a b c d e "), 200).alias("text"))
    write_index(texts, str(tmp_path / "index"), 1)
    size = sum(map(os.path.getsize, glob.glob(str(tmp_path / "index/postings/*/bin=1/*.parquet"))))
    assert size < 2 * 200 * 1000


def test_blocks_bound_every_score(spark, tmp_path, ask):
    """The best score of a block is never above its bound, for any tuning and any document frequency."""
    from wordloom.plans import matching
    from wordloom.plans.early_stop import block_bounds
    from wordloom.plans.search import _scored_hits
    from wordloom.functions.ranking import bm25

    path, target = str(tmp_path / "index"), str(tmp_path / "sorted")
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("text_id"), "text")
    write_index(texts, path)
    optimize_index(spark, path, target, block_texts=64)
    index = read_index(spark, target)
    plan = matching.compile_requests(index, ask("the", "of the", "la de"))
    assert plan.direct
    total, average = index.statistics()
    for k1, b, documents in ((1.5, 0.75, total), (0.3, 1.0, total), (2.0, 0.0, 700)):
        def score(tf, df, words):
            return bm25(tf, df, words, F.lit(documents), F.lit(average), k1, b)

        own = score(F.col("term_frequency"), F.col("document_count"), F.col("words_total"))
        found = [_scored_hits(route, hits, own) for route, hits in matching.all_hits(index, plan, ["term_frequency", "words_total"])]
        best = found[0].groupBy("query_id", F.floor(F.col("text_id") / 64).alias("block")).agg(F.max("bm25_score").alias("best"))
        bounds = block_bounds(index, plan, score)
        both = best.join(bounds, ["query_id", "block"], "left")
        assert both.count() > 20
        assert both.filter("bound IS NULL OR best > bound + 1e-9").count() == 0
        # A word alone is bounded by what it has: exactly, unless frequency and length are of different texts.
        assert both.filter("query_id = 0 AND best = bound").count() > 0


def test_early_stop_reads_less_and_finds_the_same(spark, tmp_path, ask):
    path, target = str(tmp_path / "index"), str(tmp_path / "sorted")
    # A few texts are short and full of both words; they are what the best are among.
    texts = spark.range(0, 40_000, 1, 4).select(
        F.col("id").alias("text_id"),
        F.when(F.col("id").isin(17, 500, 901, 1502), F.lit("of the of the"))
        .when(F.col("id") % 3 == 0, F.concat(F.lit("of the "), F.repeat(F.lit("filler "), 20), F.col("id") % 7))
        .otherwise(F.lit("something else"))
        .alias("text"),
    )
    write_index(texts, path, 3)
    optimize_index(spark, path, target, block_texts=256)
    index = read_index(spark, target)
    for request in ("of the", "the"):
        full = search_any_position(index, ask(request), k=4)
        early = search_any_position(index, ask(request), k=4, early_postings=1000)
        assert sorted(full.collect()) == sorted(early.collect())
        assert {row.text_id for row in early.collect()} == {17, 500, 901, 1502}
        assert rows_read(early) < 0.5 * rows_read(full)


def test_pairs_of_frequent_words(spark, micro_texts, tmp_path, ask):
    from test_search import PHRASE, answers
    from wordloom import search_phrase
    from wordloom.operators.pairs import pair_hash

    path, target = str(tmp_path / "index"), str(tmp_path / "sorted")
    write_index(micro_texts, path, 7)
    optimize_index(spark, path, target, pair_least=2)
    index = read_index(spark, target)
    name = pair_hash(*(__import__("hashlib").md5(word).hexdigest() for word in (b"green", b"energy")))
    own = index.pairs.filter(F.col("hash") == name).select("text_id", "positions", "term_frequency").collect()
    assert sorted(map(tuple, own)) == [(1, [0], 1)]
    requests = ask(*PHRASE, "the the the", "the market the", "energy and energy green green", "the market report")
    plain = answers(search_phrase(read_index(spark, path), requests), requests)
    assert answers(search_phrase(index, requests), requests) == plain
    assert {text: plain[text] for text in PHRASE} == PHRASE
    # Neither word's own postings are looked for.
    text = search_phrase(index, ask("green energy"))._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" in text and name in text
    assert __import__("hashlib").md5(b"green").hexdigest() not in text


def test_a_batch_with_repeated_ids(spark, micro_texts, micro_index, path):
    create_index(spark, path, 7)
    twice = micro_texts.union(micro_texts.withColumn("text", F.concat("text", F.lit(" zzz"))))
    assert append_index(twice, path, "all", on_duplicate="skip") == (8, 32)
    refresh_document_frequency(spark, path)
    assert content(read_index(spark, path)) == content(micro_index)
    with pytest.raises(ValueError, match="no two the same"):
        append_index(spark.sql("SELECT CAST(NULL AS LONG) AS text_id, 'x' AS text"), path, on_duplicate="skip")


def test_rebuilding_batches_and_bins(spark, micro_texts, micro_index, path):
    create_index(spark, path, 7)
    for part in range(3):
        append_index(micro_texts.filter(F.col("text_id") % 3 == part), path, f"part{part}")
    refresh_document_frequency(spark, path)
    fullest = micro_index.postings.groupBy("bin").count().orderBy(F.desc("count")).first().bin
    compact_index(spark, path, bins=[fullest])
    assert content(read_index(spark, path)) == content(micro_index)
    own = read_index(spark, path).postings.filter(F.col("bin") == fullest)
    files = own.select(F.input_file_name()).distinct()
    assert files.count() == 1
    compact_index(spark, path, ["part0", "part1"])
    assert content(read_index(spark, path)) == content(micro_index)
    compact_index(spark, path)
    index = read_index(spark, path)
    assert content(index) == content(micro_index)
    assert len(index.postings.inputFiles()) <= 8
    with pytest.raises(ValueError, match="no such batches"):
        compact_index(spark, path, ["part0"])
    # An append after a rewrite is one more batch.
    assert append_index(spark.sql("SELECT 50L AS text_id, 'green' AS text"), path) == (1, 1)
    with pytest.raises(ValueError, match="in the index already"):
        append_index(micro_texts.filter("text_id = 1"), path)


def test_only_finished_batches_are_listed(spark, micro_texts, path):
    create_index(spark, path, 7)
    append_index(micro_texts, path, "done")
    micro_texts.write.parquet(f"{path}/postings/batch=broken/bin=1")
    assert read_index(spark, path).postings.count() > 0
    assert all("batch=done" in name for name in read_index(spark, path).postings.inputFiles())


def test_old_document_frequencies_go(spark, micro_texts, path):
    import os

    create_index(spark, path, 7)
    append_index(micro_texts, path)
    for _ in range(4):
        refresh_document_frequency(spark, path)
    assert sorted(os.listdir(f"{path}/hash_metadata")) == ["version=2", "version=3"]


def test_postings_are_made_in_generated_code(spark, micro_texts):
    """A posting's hash and positions are looked up row by row; a function inside an array is interpreted."""
    postings_of_texts = indexing.postings_of_texts
    by_text = indexing.words_by_text(micro_texts)
    stored = spark.createDataFrame(by_text.collect(), by_text.schema)
    plan = postings_of_texts(stored, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "namedlambda" not in plan.lower()
    rows = postings_of_texts(stored, 16)
    assert rows.filter("bin = 0").count() == micro_texts.count()
    empty = "hash IS NULL AND positions IS NULL AND term_frequency IS NULL"
    assert rows.filter(f"(bin = 0) != ({empty})").count() == 0
    assert rows.filter("bin > 0 AND size(positions) != term_frequency").count() == 0


def test_words_are_grouped_a_batch_at_a_time(spark):
    """Not by sorting arrays of structs in each row; ids may repeat or be missing, texts too."""
    long = " ".join(f"w{n % 97} é" for n in range(5000))
    rows = [(1, "b a b"), (1, "a"), (None, "ß ẞ 12 b"), (4, None), (5, ""), (6, "a " * 300), (7, long)]
    texts = spark.createDataFrame(rows, "text_id long, text string").repartition(2)
    for hash_function in ("md5", "blake2b"):
        by_text = indexing.words_by_text(texts, hash_function)
        plan = by_text._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "sort_array" not in plan and "hashpartitioning" not in plan
        columns = ["bin", "hash", "text_id", "positions", "term_frequency", "words_total"]
        found = indexing.postings_of_texts(by_text, 7).filter("bin > 0").select(*columns)
        expected = indexing.postings(texts, 7, hash_function).select(*columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
        counts = sorted((str(row.text_id), row.words_total) for row in by_text.collect())
        assert counts == sorted((str(row.text_id), row.words_total) for row in indexing.word_counts(texts).collect())


def test_pairs_and_blocks_of_many_small_batches(spark, path):
    """Pairs and blocks do not depend on how rows are cut into batches, files and tasks; blocks are not shuffled."""
    from wordloom.operators.blocks import score_blocks, sorted_score_blocks
    from wordloom.operators.pairs import pair_hash

    rows = [(n, " ".join(["a", "b"] * (n % 3) + ["c"] + ["a"] * (n % 4) + [f"r{'abcdefg'[n % 7]}"])) for n in range(-40, 260)]
    create_index(spark, f"{path}-one", 3)
    append_index(spark.createDataFrame([*rows, (900, ""), (901, None)], "text_id long, text string"), f"{path}-one")
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.files.maxPartitionBytes": "8192"}
    old = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        optimize_index(spark, f"{path}-one", f"{path}-two", 8, 5)
        index = read_index(spark, f"{path}-two")
        kept = ["bin", "hash", "block", "texts", "profile"]
        found = index.blocks.select(*kept).collect()
        segments = index.postings.withColumn("segment", F.lit(1).cast("long"))
        plan = sorted_score_blocks(segments, index.hash_metadata, 8)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        pairs = {(row.hash, row.text_id): row.positions for row in index.pairs.collect()}
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    expected = score_blocks(index.postings, index.hash_metadata, 8).select(*kept).collect()
    assert found and sorted(map(str, found)) == sorted(map(str, expected))
    brute = {}
    frequent = {row.hash for row in index.hash_metadata.collect() if row.document_count >= index.pair_least}
    digest = lambda word: hashlib.md5(word.encode()).hexdigest()
    for text_id, text in rows:
        words = [digest(word) for word in text.split()]
        for place, (one, two) in enumerate(zip(words, words[1:])):
            if one in frequent and two in frequent:
                brute.setdefault((pair_hash(one, two), text_id), []).append(place)
    assert pairs == brute


def test_postings_move_packed(spark):
    """A bin of an Arrow batch is one row, with each hash once; unpacked it is the same postings."""
    from wordloom.operators.packing import packed_postings, unpacked_postings

    long = " ".join("a" if n % 300 else f"w{n % 97}" for n in range(70_000))
    # Words that come 70 000 times and a text that comes alone, so that numbers need one, two and four bytes.
    rows = [(-3, "b a b"), (10**15, "a"), (4, None), (5, ""), (6, "a " * 300), (7, long), (8, "ß ẞ 12 b")]
    rows += [(100 + n, f"a b c{'xyz'[n % 3]} {n}") for n in range(400)]
    texts = spark.createDataFrame(rows, "text_id long, text string").repartition(2)
    by_text = indexing.words_by_text(texts)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for records in (old, "7"):
            spark.conf.set(key, records)
            for bins in (1, 7, 16, 1_000_000):
                found = unpacked_postings(packed_postings(by_text, bins).repartition(3)).select(POSTING)
                expected = indexing.postings_of_texts(by_text, bins).select(POSTING)
                assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
        spark.conf.set(key, old)
        short = indexing.words_by_text(texts.filter("text_id >= 100"))
        packed = packed_postings(short, 16)
        assert packed.groupBy(F.spark_partition_id(), "bin").count().filter("count > 1").isEmpty()
        size = sum(F.size(name) * width for name, width in (("text_ids", 8), ("lengths", 4)))
        size += sum(F.octet_length(name) for name in ("digests", "counts", "places", "frequencies", "positions"))
        moved = packed.agg(F.sum(size)).first()[0]
        plain = indexing.postings_of_texts(short, 16)
        # A hash takes 32 bytes, a position 4 and the four numbers of a posting 20.
        whole = plain.agg(F.sum(F.coalesce(F.size("positions"), F.lit(0)) * 4 + 52)).first()[0]
        assert moved < whole / 2
    finally:
        spark.conf.set(key, old)
    nothing = unpacked_postings(packed_postings(indexing.words_by_text(texts.filter("false")), 7))
    assert nothing.isEmpty()


def test_an_index_is_built_with_little_moved(spark, micro_texts, path, monkeypatch):
    """Postings are packed where they are moved, and the counts of one batch are not moved to be added up."""
    from wordloom.sources import index as store

    plans, sizes, stored = {}, {}, store._store
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    asked = spark.conf.get(key)

    def spied(rows, folder, *args, **options):
        name = folder.removeprefix(path).split("/")[1]
        plans[name] = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        sizes[name] = spark.conf.get(key)
        stored(rows, folder, *args, **options)

    monkeypatch.setattr(store, "_store", spied)
    try:
        spark.conf.set(key, "6m")
        create_index(spark, path, 7)
        append_index(micro_texts, path, "one")
        refresh_document_frequency(spark, path)
        assert spark.conf.get(key) == "6m"
        assert int(sizes["postings"]) < 6 << 20 and sizes["batch_frequency"] == "6m"
        monkeypatch.setattr(store, "_store", lambda *args, **options: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            append_index(micro_texts.withColumn("text_id", F.col("text_id") + 100), path, "two")
        assert spark.conf.get(key) == "6m"
    finally:
        spark.conf.set(key, asked)
    lines = plans["postings"].splitlines()
    moved, *_ = [n for n, line in enumerate(lines) if "Exchange" in line]
    assert any("MapInArrow" in line for line in lines[:moved]) and any("MapInArrow" in line for line in lines[moved:])
    assert "Exchange" not in plans["hash_metadata"]
    index = read_index(spark, path)
    counted = index.postings.groupBy("bin", "hash").agg(F.count("text_id").alias("document_count"))
    assert sorted(counted.collect()) == sorted(index.hash_metadata.select(counted.columns).collect())


def test_hashes_of_a_sorted_index_move_as_bytes(spark, micro_texts, path):
    from wordloom.sources import index as store

    rows = indexing.postings_and_lengths(micro_texts, 7).withColumn("text_id", F.col("text_id").cast("long"))
    found = store._sorted_rows(rows)
    assert found.schema["hash"].dataType.simpleString() == "string" and found.columns == rows.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("lower(hex(") < plan.index("RepartitionByExpression") < plan.index("unhex(")
    # Files are in order still: the writer sorts nothing again.
    store._store(found, path)
    for file in sorted(pathlib.Path(path).glob("bin=*/*.parquet")):
        own = spark.read.parquet(str(file)).select("hash", "text_id").collect()
        assert own == sorted(own, key=lambda row: (row.hash or "", row.text_id))
