import datetime
import re

import pytest
from pyspark.sql import functions as F

from wordloom import index_texts, ingest_corpus, search_phrase
from wordloom.operators import numbering
from wordloom.sources import corpus


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "source")
    spark.range(0, 200, 1, 8).select(
        F.concat(F.lit("news "), "id").alias("title"),
        F.lit(datetime.date(2024, 1, 1)).alias("published_date"),
        F.concat(F.lit("Text number "), "id").alias("plain_text"),
        F.element_at(F.array(F.lit("en"), F.lit("bg"), F.lit("de")), (F.col("id") % 3 + 1).cast("int"))
        .alias("language"),
        (F.lit(0.8) + (F.col("id") % 4) * 0.05).alias("language_score"),
        F.lit("unused").alias("html"),
    ).write.parquet(path)
    return path


COLUMNS = {
    "title": "title",
    "published_date": "date",
    "plain_text": "text",
    "language": "language",
    "language_score": "language_score",
}


def expected_titles():
    return sorted(
        f"news {i}" for i in range(200) if i % 3 in (0, 1) and 0.8 + (i % 4) * 0.05 >= 0.85
    )


def test_ingest_index_and_search(spark, source, tmp_path, ask):
    texts_path, index_path = str(tmp_path / "texts"), str(tmp_path / "index")
    rows = corpus.read_corpus(spark, source, COLUMNS)
    ingest_corpus(rows, texts_path, 5, ["title"], ["bg", "en"], 0.85)
    stored = corpus.read_texts(spark, texts_path).texts
    found = stored.orderBy("text_id").collect()
    assert [row.title for row in found] == expected_titles()
    assert [row.text_id for row in found] == list(range(1, len(found) + 1))
    assert all(row.text_bin == row.text_id % 5 + 1 for row in found)
    assert stored.columns == ["text_id", "title", "date", "text", "text_bin"]

    # More texts continue the numbers.
    more = rows.withColumn("title", F.concat(F.lit("more "), "title"))
    ingest_corpus(more, texts_path, 5, ["title"], ["bg"], 0.85, max_texts=10, existing=True)
    ids = sorted(row.text_id for row in corpus.read_texts(spark, texts_path).texts.collect())
    assert ids == list(range(1, len(found) + 11))

    index = index_texts(spark, texts_path, index_path, bins=4)
    hit = search_phrase(index, ask("number 9")).collect()
    titles = {row.title for row in corpus.read_texts(spark, texts_path).texts.join(
        spark.createDataFrame(hit).select("text_id"), "text_id").collect()}
    assert {title.removeprefix("more ") for title in titles} == {"news 9"}


def test_numbers_do_not_depend_on_partitions(spark, source):
    rows = corpus.read_corpus(spark, source, ["title"])
    numbers = [
        sorted(map(tuple, corpus.assign_text_ids(rows.repartition(n), ["title"]).collect()))
        for n in (1, 3, 16)
    ]
    assert numbers[0] == numbers[1] == numbers[2]
    assert [title for _, title in numbers[0]] == sorted(title for _, title in numbers[0])


def test_copies_and_null_keys_have_ids_of_their_own(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1, 'a'), (1, 'b'), (NULL, 'c'), (1, 'a'), (NULL, NULL), (0, 'z') AS t(k, text)"
    )
    runs = [
        sorted(map(tuple, corpus.assign_text_ids(rows.repartition(n), ["k"]).collect())) for n in (1, 4)
    ]
    assert runs[0] == runs[1]
    assert [text_id for text_id, _, _ in runs[0]] == [1, 2, 3, 4, 5, 6]
    assert [k for _, k, _ in runs[0]] == [None, None, 0, 1, 1, 1]
    assert corpus.assign_text_ids(rows.limit(0), ["k"]).collect() == []


def test_one_key_in_all_rows_is_numbered_in_parts(spark, monkeypatch):
    rows = spark.range(0, 50_000, 1, 8).select(F.lit("hot").alias("k"), F.lit("same").alias("text"))
    ranges = []
    written = numbering.written
    monkeypatch.setattr(numbering, "written", lambda *args: ranges.append(written(*args)) or ranges[-1])
    # Without joining small partitions again.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = corpus.assign_text_ids(rows, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = ranges[0].groupBy(F.input_file_name()).count().collect()
    assert len(parts) >= 3 and max(row["count"] for row in parts) < 35_000
    assert numbered.agg(F.count_distinct("text_id"), F.max("text_id")).first() == (50_000, 50_000)


def test_range_keys_hold_no_payload(spark, monkeypatch):
    """Spark samples range keys to the driver, so no text may be in them."""
    rows = spark.sql("SELECT id % 5 AS k, repeat(concat('x', id), 500) AS text, named_struct('t', id) AS row, map(1, 2) AS m FROM range(50)")
    plans = []
    written = numbering.written

    def spied(frame, name):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return written(frame, name)

    monkeypatch.setattr(numbering, "written", spied)
    numbered = numbering.numbered(rows, ["k"], "number")
    keys = next(line for line in plans[0].split("\n") if "RepartitionByExpression" in line)
    assert re.findall(r"[\[ (](\w+)#\d+L? ASC", keys) == ["k", "__hash", "__more", "__spread"]
    found = numbered.collect()
    assert sorted(row.number for row in found) == list(range(50))
    assert [row.k for row in sorted(found, key=lambda row: row.number)] == sorted(row.k for row in found)
    assert numbered.columns == [*rows.columns, "number"]


def test_text_store_knows_its_bins_and_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    texts = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'b') AS t(text_id, text)")
    store = corpus.write_texts(texts, path, 3)
    assert store.bins == 3 and store.texts.count() == 2
    with pytest.raises(Exception, match="already exists"):
        corpus.create_texts(spark, path, 4)
    with pytest.raises(ValueError, match="in the store already"):
        corpus.append_texts(texts.filter("text_id = 2"), path)
    with pytest.raises(ValueError, match="no two the same"):
        corpus.append_texts(texts.union(texts).withColumn("text_id", F.col("text_id") + 10), path)
    more = texts.withColumn("text_id", F.col("text_id") + 10)
    assert corpus.append_texts(more, path, "more") == corpus.append_texts(more, path, "more") == 2
    assert sorted(row.text_id for row in corpus.read_texts(spark, path).texts.collect()) == [1, 2, 11, 12]
    with pytest.raises(ValueError):
        corpus.create_texts(spark, path + "0", 0)
    empty = corpus.write_texts(texts.limit(0), path + "1", 2)
    assert empty.texts.count() == 0


def test_filter_reaches_the_scan(spark, source):
    rows = corpus.filter_corpus(corpus.read_corpus(spark, source, COLUMNS), ["en"], 0.85)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan
    assert "html" not in plan.split("ReadSchema:")[1]


def test_no_shared_folder_outside_local_mode():
    from wordloom.session import shared_folder

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return default

    for master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        session = Session()
        session.sparkContext = Context(master)
        with pytest.raises(RuntimeError):
            shared_folder(session)


def test_stored_texts_take_little_space(spark, tmp_path):
    import pathlib

    import pyarrow.parquet as pq

    texts = spark.createDataFrame([(n, f"text {n}") for n in range(20)], "text_id long, text string")
    store = corpus.write_texts(texts, str(tmp_path / "texts"), 3)
    files = list(pathlib.Path(tmp_path / "texts" / "texts").rglob("*.parquet"))
    assert {pq.read_metadata(file).row_group(0).column(1).compression for file in files} == {"ZSTD"}
    assert sorted(store.texts.select("text_id", "text").collect()) == sorted(texts.collect())
