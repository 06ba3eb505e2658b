"""One word in every text, one bin for everything: no task may get it all."""

from pyspark.sql import functions as F

from wordloom import append_index, create_index, optimize_index, read_index, search_any_position


def test_a_hot_bin_is_written_and_read_in_parts(spark, tmp_path, ask):
    path, target = str(tmp_path / "index"), str(tmp_path / "sorted")
    texts = spark.range(0, 20_000, 1, 8).select(
        F.col("id").alias("text_id"), F.concat(F.lit("hot hot word"), F.col("id") % 50).alias("text")
    )
    create_index(spark, path, bins=1)
    keys = (
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize",
    )
    before = {key: spark.conf.get(key) for key in keys}
    for key in keys:
        spark.conf.set(key, "64k")
    try:
        append_index(texts, path)
        optimize_index(spark, path, target)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    for folder in (path, target):
        files = (
            spark.read.parquet(f"{folder}/postings")
            .filter("bin = 1")
            .groupBy(F.input_file_name().alias("file"))
            .agg(F.count("hash").alias("rows"))
        )
        sizes = [row.rows for row in files.collect()]
        assert sum(sizes) == 60_000
        assert len(sizes) >= 3 and max(sizes) < 45_000
    index = read_index(spark, target)
    found = search_any_position(index, ask("hot", "hot word"), k=3).collect()
    assert sorted((row.query_id, row.text_id) for row in found) == [
        (query, text) for query in (0, 1) for text in (0, 1, 2)
    ]
