import pytest
from pyspark.sql import functions as F

from wordloom import build_index, match_all, search, search_any_position, search_phrase, search_word
from wordloom.plans.matching import match_all_by_intersection

WORD = {
    "green": [(7, 0.670, 3), (1, 0.646, 2), (2, 0.369, 1)],
    "the": [(3, -0.406, 1), (8, -0.509, 1), (2, -0.556, 2), (6, -0.646, 2), (4, -0.753, 3)],
    "2024": [(3, 1.447, 1)],
    "zzz": [],
}
ANY = {
    "green energy": [(7, 1.226, 2), (1, 1.098, 2), (2, 0.738, 2)],
    "the market": [(2, 0.000, 2), (3, 0.000, 2), (6, -0.194, 2)],
    "cafe zzz": [(3, 1.447, 1)],
    "the the": [(3, -0.406, 1), (8, -0.509, 1), (2, -0.556, 1), (6, -0.646, 1), (4, -0.753, 1)],
    "green": [(7, 0.670, 1), (1, 0.646, 1), (2, 0.369, 1)],
    "": [],
    "?!": [],
    "zzz yyy": [],
}
PHRASE = {
    "green energy": [(1, 0.452, 2)],
    "energy green": [(7, 0.556, 4), (1, 0.452, 2)],
    "the the": [(4, -0.646, 4)],
    "cafe zzz": [],
    "the market": [(6, 0.452, 2)],
    "green": [(7, 0.670, 3), (1, 0.646, 2), (2, 0.369, 1)],
    "": [],
    "?!": [],
}


def answers(results, requests):
    """Results per request text, in the order of their numbers."""
    texts = dict(requests.collect())
    found = {text: [] for text in texts.values()}
    for row in sorted(results.collect(), key=lambda row: (row.query_id, row.result_number)):
        found[texts[row.query_id]].append((row.text_id, row.bm25_score, row.matching_words))
        assert row.result_number == len(found[texts[row.query_id]])
    return found


def test_word(micro_index, ask):
    requests = ask(*WORD, "two words")
    assert answers(search_word(micro_index, requests), requests) == WORD | {"two words": []}


def test_any_position(micro_index, ask):
    requests = ask(*ANY)
    assert answers(search_any_position(micro_index, requests), requests) == ANY


def test_phrase(micro_index, ask):
    requests = ask(*PHRASE)
    assert answers(search_phrase(micro_index, requests), requests) == PHRASE


def test_unknown_word_can_be_required(micro_index, ask):
    requests = ask("cafe zzz", "green energy")
    found = search_any_position(micro_index, requests, unknown_terms="require")
    assert answers(found, requests) == {"cafe zzz": [], "green energy": ANY["green energy"]}
    with pytest.raises(ValueError):
        search_any_position(micro_index, requests, unknown_terms="maybe")


def test_dispatch(micro_index, ask):
    requests = ask(*PHRASE)
    assert answers(search(micro_index, requests), requests) == PHRASE
    found = search(micro_index, requests, method="any_position")
    assert answers(found, requests) == {text: ANY.get(text) for text in PHRASE} | {
        "energy green": ANY["green energy"]
    }
    with pytest.raises(ValueError):
        search(micro_index, requests, method="fuzzy")


def test_k_and_ties(micro_index, ask):
    requests = ask("the market")
    found = answers(search_any_position(micro_index, requests, k=1), requests)
    assert found == {"the market": [(2, 0.0, 2)]}


def test_big_k_ranks_in_slices(spark, micro_index, ask):
    requests = ask(*ANY)
    assert answers(search_any_position(micro_index, requests, k=5000), requests) == ANY


def test_tuning(micro_index, ask):
    requests = ask("green")
    flat = answers(search_word(micro_index, requests, k1=1.2, b=0.0), requests)["green"]
    # Without length normalization only the term frequency counts.
    assert [text_id for text_id, _, _ in flat] == [7, 1, 2]
    assert flat[2][1] == pytest.approx(round(__import__("math").log(5.5 / 3.5), 3))


@pytest.mark.parametrize(
    "limit, salts, by_text",
    [*((limit, salts, False) for limit in (0, 3, 10, 40) for salts in (False, True)), (0, True, True), (3, False, True), (10, False, True)],
)
def test_every_route_gives_the_same(monkeypatch, micro_index, ask, limit, salts, by_text):
    """The limits choose routes and joins; they must not change a result."""
    import wordloom.plans.matching as matching
    import wordloom.plans.search as searching

    monkeypatch.setattr(matching, "DIRECT_POSTINGS", 0)
    monkeypatch.setattr(matching, "TEXT_SHARE", 0 if by_text else 100)
    monkeypatch.setattr(searching, "LITERALS", limit)
    monkeypatch.setattr(matching, "ROWS_PER_SALT", 2)
    if not salts and limit < 40:
        # Requests stay broadcastable, their candidates do not.
        monkeypatch.setattr(matching, "BROADCAST_ROWS", 25)
    elif salts:
        monkeypatch.setattr(matching, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(searching, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(matching, "LITERALS", limit)
    if limit != 10:
        monkeypatch.setattr(matching, "LOCAL_ROWS", limit)
    requests = ask(*ANY)
    assert answers(search_any_position(micro_index, requests), requests) == ANY
    requests = ask(*PHRASE)
    assert answers(search_phrase(micro_index, requests), requests) == PHRASE
    requests = ask(*WORD)
    assert answers(search_word(micro_index, requests), requests) == WORD


def test_batch_equals_single_requests(micro_index, ask):
    together = ask(*ANY)
    found = answers(search_any_position(micro_index, together), together)
    for text in ("green energy", "the market", "cafe zzz"):
        alone = ask(text)
        assert answers(search_any_position(micro_index, alone), alone)[text] == found[text]


def test_index_in_memory_and_other_layouts(spark, micro_texts, ask):
    requests = ask(*ANY)
    for bins, hash_function, parts in ((1, "md5", 1), (3, "blake2b", 5), (64, "md5", 8)):
        index = build_index(micro_texts.repartition(parts), bins, hash_function)
        assert answers(search_any_position(index, requests), requests) == ANY


def test_match_all_equals_intersection(micro_index, ask):
    requests = ask("the market", "green energy", "the the")
    matched = match_all(micro_index, requests)
    for query_id in range(3):
        ids = matched.filter(F.col("query_id") == query_id).select("text_id").distinct()
        chain = match_all_by_intersection(micro_index, requests, query_id)
        assert sorted(ids.collect()) == sorted(chain.collect())
    row = matched.filter("query_id = 0 and text_id = 2").collect()
    assert sorted(r.positions for r in row) == [[0, 3], [2, 5]]


def test_phrase_is_subset_of_any_position(micro_index, ask):
    requests = ask(*PHRASE)
    anywhere = search_any_position(micro_index, requests, k=100).select("query_id", "text_id")
    phrases = search_phrase(micro_index, requests, k=100).select("query_id", "text_id")
    assert phrases.join(anywhere, ["query_id", "text_id"], "left_anti").isEmpty()


@pytest.mark.parametrize("literals, broadcast", [(200, 1000), (1, 1000), (1, 1)])
def test_texts_are_attached(monkeypatch, micro_index, micro_texts, ask, tmp_path, literals, broadcast):
    from wordloom.operators import results
    from wordloom.sources import corpus

    monkeypatch.setattr(results, "LITERALS", literals)
    monkeypatch.setattr(results, "BROADCAST_ROWS", broadcast)
    rows = micro_texts.filter("text_id <> 7").withColumn("title", F.concat(F.lit("t"), "text_id"))
    store = corpus.write_texts(rows, str(tmp_path / "store"), 5)
    found = search(micro_index, ask("energy green"), texts=store)
    assert found.columns == [
        "query_id", "result_number", "bm25_score", "matching_words", "text_id", "title", "text",
    ]
    rows = found.collect()
    assert [(r.text_id, r.title, r.text) for r in rows] == [
        (7, None, None),
        (1, "t1", "Green energy, green jobs."),
    ]


def test_few_texts_are_looked_up_by_id(spark, micro_index, ask, tmp_path):
    from wordloom.sources import corpus

    rows = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("text_id"), F.repeat(F.lit("long "), 40).alias("text"))
    store = corpus.write_texts(rows, str(tmp_path / "store"), 4)
    found = search(micro_index, ask("energy green"), texts=store)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "text_bin" in line)
    assert "EqualTo(text_id,1)" in scan.split("PushedFilters:")[1]
    assert "text_bin" in scan.split("PartitionFilters:")[1].split("]")[0]


def test_many_results_are_not_sorted_in_one_task(monkeypatch, micro_index, micro_texts, ask, tmp_path):
    """However few texts many requests share."""
    from wordloom.operators import results
    from wordloom.sources import corpus

    store = corpus.write_texts(micro_texts, str(tmp_path / "store"), 3)
    settled_rows = results.settled_rows
    requests = ask(*["green energy", "the market"] * 4)
    expected = search(micro_index, requests, method="any_position", texts=store).collect()
    for rows, one_task in ((10_000, True), (2, False)):
        monkeypatch.setattr(results, "settled_rows", lambda frame, rows=rows: settled_rows(frame, rows))
        found = search(micro_index, requests, method="any_position", texts=store)
        assert ("Coalesce 1" in found._jdf.queryExecution().executedPlan().toString()) == one_task
        assert found.collect() == expected


def test_many_literals_are_pushed_one_by_one(micro_index):
    from wordloom.plans.matching import Pruning

    hashes = [f"{n:032x}" for n in range(150)]
    plan = Pruning(hashes=hashes).apply(micro_index.postings)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "Or(" in scan.split("PushedFilters:")[1] and "In(hash" not in scan


@pytest.mark.parametrize("ids", [[1, 1], [1, None]])
def test_requests_need_ids_of_their_own(spark, micro_index, ids):
    requests = spark.createDataFrame([(ids[0], "green"), (ids[1], "market")], "query_id long, request string")
    for find in (search_any_position, search_phrase, search_word, search):
        with pytest.raises(ValueError, match="no two the same"):
            find(micro_index, requests)


def test_a_phrase_requires_all_words(micro_index, ask):
    with pytest.raises(ValueError):
        search(micro_index, ask("green"), unknown_terms="drop")


def test_intersection_of_nothing(micro_index, ask):
    assert match_all_by_intersection(micro_index, ask("zzz", "?!"), 0).collect() == []
    assert match_all_by_intersection(micro_index, ask("zzz", "?!"), 1).collect() == []


def test_phrases_are_compared_once(monkeypatch, micro_index, ask):
    import wordloom.plans.matching as matching

    # Where positions are compared in columns, not inside the texts.
    monkeypatch.setattr(matching, "TEXT_SHARE", 100)
    for postings in (matching.DIRECT_POSTINGS, 0):
        monkeypatch.setattr(matching, "DIRECT_POSTINGS", postings)
        plan = search_phrase(micro_index, ask("green energy", "the market"))
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("array_intersect(") == 1


def jobs_of(spark, work):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    before = len(tracker.getJobIdsForGroup("counted"))
    try:
        work()
    finally:
        spark.sparkContext.setJobGroup("other", "other")
    return len(tracker.getJobIdsForGroup("counted")) - before


def test_a_request_starts_few_jobs(spark, micro_index, micro_texts, ask, tmp_path):
    from wordloom.sources import corpus

    store = corpus.write_texts(micro_texts, str(tmp_path / "store"), 5)
    asked = {text: ask(text) for text in ("green", "the market")}
    assert jobs_of(spark, lambda: search_word(micro_index, asked["green"]).collect()) <= 4
    assert jobs_of(spark, lambda: search_any_position(micro_index, asked["the market"]).collect()) <= 4
    assert jobs_of(spark, lambda: search_phrase(micro_index, asked["the market"]).collect()) <= 4
    assert jobs_of(spark, lambda: search(micro_index, asked["the market"], texts=store).collect()) <= 6


def test_stale_counts_never_become_literals(spark, ask, tmp_path, monkeypatch):
    """Words that were rare when they were counted, and are not any more."""
    import wordloom.plans.matching as matching
    from wordloom import append_index, create_index, read_index, refresh_document_frequency

    path = str(tmp_path / "index")
    create_index(spark, path, 3)
    append_index(spark.sql("SELECT * FROM VALUES (1L, 'a b'), (2L, 'b c') AS t(text_id, text)"), path)
    refresh_document_frequency(spark, path)
    more = spark.range(10, 2010).select(F.col("id").alias("text_id"), F.lit("a b").alias("text"))
    append_index(more, path)
    index = read_index(spark, path)
    assert index.uncounted_texts == 2000
    monkeypatch.setattr(matching, "DIRECT_POSTINGS", 0)
    named = []
    apply = matching.Pruning.apply
    monkeypatch.setattr(
        matching.Pruning, "apply", lambda self, frame: named.append(self.text_ids or []) or apply(self, frame)
    )
    for limit, route in ((matching.BROADCAST_ROWS, "narrow"), (100, "wide")):
        monkeypatch.setattr(matching, "BROADCAST_ROWS", limit)
        plan = matching.compile_requests(index, ask("a b"))
        assert set(plan.routes) == {route}
        assert search_any_position(index, ask("a b"), k=3000).count() == 2001
    assert all(len(ids) <= matching.LITERALS for ids in named)
    refresh_document_frequency(spark, path)
    assert read_index(spark, path).uncounted_texts == 0


def test_big_batches_are_folded_and_take_the_wide_route(spark):
    import __spark_entry__ as entry
    import wordloom.plans.matching as matching

    sf_dir = "/root/testdata/sf0.01"
    index = entry.stored_index(spark, sf_dir)
    plan = matching.compile_requests(index, entry.word_pairs(spark, sf_dir), fold=True)
    assert plan.folded is not None and {"wide"} <= set(plan.routes)


@pytest.mark.parametrize("kept", [1 << 20, 40, 6])
@pytest.mark.parametrize("k", [1, 3])
def test_the_best_are_kept_in_the_texts_tasks(monkeypatch, kept, k):
    """Whatever a task keeps at a time, the k best by rounded score are among what it hands on; and not much more."""
    import numpy as np
    from wordloom.plans import by_text

    monkeypatch.setattr(by_text, "_KEPT", kept)
    rng = np.random.default_rng(k)
    sizes = rng.integers(1, 5, 30)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    requests = by_text.Requests(np.array([], "S16"), np.arange(begins[-1]) % 7, begins)
    counts = rng.integers(1, 900, begins[-1])
    counts[0] = 2000
    ranking = by_text.Ranking.of(k, counts, 1000, 50.0, 1.5, 0.75)
    best, handed, every = by_text._Best(requests, ranking), [], []
    for step in range(40):
        places = rng.integers(0, 30, 25)
        ids, lengths = step * 25 + np.arange(25), rng.integers(5, 9, 25)
        frequencies = rng.integers(1, 3, sizes[places].sum()).astype(np.int32)
        scores = ranking.scores(requests, places, frequencies, lengths)
        part = by_text._Matches(places, ids, lengths, frequencies, scores)
        handed += best.add(part)
        every.append(part)
    handed += best.rest()
    assert (np.isfinite(scores)).all()

    def rounded(part):
        rows, at = [], 0
        for place, text_id, length in zip(part.places.tolist(), part.text_ids.tolist(), part.lengths.tolist()):
            own = part.frequencies[at : at + sizes[place]]
            at += sizes[place]
            norm = 1.5 * (0.25 + 0.75 * length / 50.0)
            words = ranking.weights[begins[place] : begins[place + 1]] * own * 2.5 / (own + norm)
            rows.append((place, -round(sum(round(word, 3) for word in words), 3) if np.isfinite(words).all() else 0, text_id))
        return rows

    def best_of(rows):
        rows = sorted(rows)
        return [row for n, row in enumerate(rows) if n < k or rows[n - k][0] != row[0]]

    given = [row for part in handed for row in rounded(part)]
    assert len(given) == len(set(given)) and best_of(given) == best_of([row for part in every for row in rounded(part)])
    assert kept < 40 or len(given) < 1000


def test_overlapping_occurrences(spark, ask):
    texts = spark.createDataFrame([(1, "a a a a"), (2, "b"), (3, "c")], "text_id long, text string")
    found = search_phrase(build_index(texts, 4), ask("a a")).collect()
    assert [(row.text_id, row.matching_words) for row in found] == [(1, 6)]


@pytest.mark.parametrize("broadcast", [1_000, 2])
def test_repeated_requests_share_an_answer(monkeypatch, micro_index, ask, broadcast):
    import wordloom.plans.matching as matching
    import wordloom.plans.search as searching

    monkeypatch.setattr(matching, "LOCAL_ROWS", 0)
    monkeypatch.setattr(matching, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(searching, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(searching, "LOCAL_ROWS", 0)
    texts = ["energy green", "Energy, green!", "green energy", "the the", "energy green", "the", "zzz"]
    found = search_phrase(micro_index, ask(*texts)).collect()
    rows = [
        [tuple(row)[2:] for row in sorted(found) if row.query_id == query_id]
        for query_id in range(len(texts))
    ]
    assert rows == [
        PHRASE["energy green"],
        PHRASE["energy green"],
        PHRASE["green energy"],
        PHRASE["the the"],
        PHRASE["energy green"],
        WORD["the"],
        [],
    ]
    found = sorted(search_word(micro_index, ask("green", "Green!", "the", "a b", "green")).collect())
    assert [row.text_id for row in found] == 2 * [7, 1, 2] + [3, 8, 2, 6, 4] + [7, 1, 2]
    found = search(micro_index, ask(*texts), method="any_position").collect()
    assert [row.text_id for row in sorted(found) if row.query_id == 4] == [7, 1, 2]


@pytest.fixture
def many_blocks(monkeypatch):
    """Requests all go to the texts, in blocks of very few words."""
    import wordloom.plans.matching as matching

    monkeypatch.setattr(matching, "DIRECT_POSTINGS", 0)
    monkeypatch.setattr(matching, "TEXT_SHARE", 0)
    monkeypatch.setattr(matching, "LOCAL_ROWS", 0)
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(matching, "TEXT_BLOCK", 1)
    return matching


@pytest.mark.parametrize("search_all, wanted", [(search_any_position, ANY), (search_phrase, PHRASE)])
def test_the_driver_holds_one_block_of_requests(many_blocks, monkeypatch, micro_index, ask, search_all, wanted):
    """Each block is answered and given up before the next is collected."""
    import weakref

    from wordloom.plans import by_text

    seen, collect = [], by_text.Block.collect.__func__

    class Seen(by_text.Block):
        @classmethod
        def collect(cls, words):
            assert len([block for block in seen if block() is not None]) <= 1
            block = collect(cls, words)
            seen.append(weakref.ref(block))
            return block

    monkeypatch.setattr(many_blocks, "Block", Seen)
    requests = ask(*wanted)
    found = search_all(micro_index, requests)
    assert len(seen) > 2
    # What is left to do joins answers that are stored; no block is part of the plan.
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert answers(found, requests) == wanted


def test_words_of_a_block_are_made_from_its_requests(many_blocks, micro_index, ask):
    """However many blocks there are, the words of the batch are neither joined nor shuffled again for each."""
    blocks = []

    def find(block, terms):
        blocks.append(terms._jdf.queryExecution().executedPlan().toString())
        return block.phrases(micro_index.text_words, terms).selectExpr("query_id", "text_id", "0D AS bm25_score")

    requests = ask(*["energy green", "Energy, green!", "green energy", "the market", "the energy market", "the the"])
    plan = many_blocks.compile_requests(micro_index, requests, "require", fold=True, by_text=True)
    many_blocks.text_matches(plan, find, 10)
    assert len(blocks) > 2 and not any("Join" in text or "Exchange" in text for text in blocks)
    assert plan.folded.different == 5
    assert "Join" not in plan.terms._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_batch_of_texts_are_looked_up_at_once(monkeypatch):
    """Digests that begin alike among them, a text without words and a null one."""
    import numpy as np
    import pyarrow as pa
    from wordloom.plans import by_text

    digests = [bytes([i]) * 8 + bytes([j]) * 8 for i, j in ((1, 1), (1, 2), (2, 0), (3, 9), (7, 7))]
    asked = np.array([digests[1], digests[3], digests[0]], "S16")
    requests = by_text.Requests.of(np.array([0, 0, 1]), np.array([1, 2, 1]), asked, 2)
    texts = [digests[:2], [], None, digests[1:], [digests[2]], digests[::-1]]
    calls, known = [], by_text.Requests.known
    monkeypatch.setattr(by_text.Requests, "known", lambda *own: calls.append(1) or known(*own))
    batch = pa.record_batch([pa.array([None if t is None else b"".join(t) for t in texts], pa.binary())], ["hashes"])
    found = {row: (at.tolist(), numbers.tolist()) for row, at, numbers in by_text._texts(batch, requests)}
    number = {bytes(own).ljust(16, b"\0"): i for i, own in enumerate(requests.digests)}
    wanted = {
        row: ([i for i, own in enumerate(t) if own in number], [number[own] for own in t if own in number])
        for row, t in enumerate(texts)
        if t and any(own in number for own in t)
    }
    assert found == wanted and len(calls) == 1
