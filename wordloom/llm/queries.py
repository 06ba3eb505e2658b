"""Queries of the operators over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import (
    centroids,
    decontamination,
    embeddings,
    hidden_markov,
    html_text,
    language,
    licenses,
    line_chunks,
    minhash,
    mixing,
    sharding,
    shared_search,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(documents, model)


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def repeated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.without_repeated_chunks(_table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "kept")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan_contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.drop("matches")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return language.identify(documents, language.fit_profiles(documents))


def item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_search.search_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_texts(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan,
        "op2_toxicity": toxicity_scores,
        "op3_source_mix": source_mix,
        "op4_line_chunks": repeated_chunks,
        "op5_minhash": near_dedup,
        "op6_html_text": page_texts,
        "op7_shards": shards,
        "op8_embedding_links": embedding_links,
        "op9_contamination": contamination,
        "op10_language": languages,
        "op11_shared_search": item_search,
        "op12_centroids": vector_clusters,
        "op13_hidden_markov": text_scores,
    }


# The same in SQL

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _words(column: str) -> str:
    return _WORDS.format(f"coalesce({column}, '')")


def _license_sql() -> str:
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.PHRASES.items())
    templates = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(licenses.TEMPLATES))
    half = licenses.BLOCK // 2
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text, {_words("text")} AS words FROM documents),
    phrases AS (SELECT {_words("phrase")} AS phrase, label FROM (VALUES {phrases}) t(phrase, label)),
    places AS (SELECT row, words, unnest(range(len(words))) AS place FROM docs),
    base AS (
        SELECT row, place, label FROM places, phrases
        WHERE words[place + 1] = phrase[1] AND list_slice(words, place + 1, place + len(phrase)) = phrase
    ),
    templates AS (
        SELECT n, label, list_distinct({_words("text")}) AS asked FROM (VALUES {templates}) t(n, label, text)
    ),
    lines AS (SELECT row, {_words("line")} AS words FROM (
        SELECT row, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs)),
    blocks AS (
        SELECT row, start, list_distinct(list_slice(words, start + 1, start + {licenses.BLOCK})) AS own FROM (
            SELECT row, words, unnest(range(0, greatest(len(words) - {half}, 1), {half})) AS start FROM lines
        )
    ),
    met AS (
        SELECT row, start, label, own, len(list_intersect(own, asked)) AS shared, len(asked) AS size
        FROM blocks, templates
        WHERE len(list_intersect(own, asked)) * 100 >= len(asked) * {licenses.CONTAINMENT}
    ),
    base_sums AS (
        SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY row
    ),
    met_sums AS (SELECT row, max(shared / size) AS best FROM met GROUP BY row),
    block_sums AS (SELECT row, count(*) AS n_blocks FROM (
        SELECT m.row FROM (SELECT row, words, unnest(range(0, greatest(len(words) - {half}, 1), {half})) AS start
            FROM lines) m
        WHERE EXISTS (SELECT 1 FROM templates WHERE
            len(list_intersect(list_distinct(list_slice(m.words, m.start + 1, m.start + {licenses.BLOCK})), asked))
            * 100 >= len(asked) * {licenses.CONTAINMENT})) GROUP BY row),
    both_labels AS (
        SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM (SELECT row, label FROM base UNION ALL SELECT row, label FROM met) GROUP BY row
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score,
        coalesce(n_blocks, 0) AS n_blocks
    FROM docs LEFT JOIN base_sums USING (row) LEFT JOIN met_sums USING (row)
        LEFT JOIN block_sums USING (row) LEFT JOIN both_labels USING (row)"""


_MIX_SQL = f"""
    WITH docs AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15)
                AS BIGINT) AS hash
        FROM documents
    ),
    sources AS (
        SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)
    ),
    ordered AS (
        SELECT *, 2.0 * source_size / weight AS ratio,
            {mixing.SHARE}::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS wanted,
            coalesce(sum(2 * source_size) OVER earlier, 0) AS capped,
            sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open
        FROM sources
        WINDOW earlier AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    -- Sources in the order in which their limits are reached: the first that its share does not reach ends it.
    level AS (
        SELECT capped, open FROM ordered WHERE ratio >= (wanted - capped)::DOUBLE / open::DOUBLE
        ORDER BY ratio, source NULLS LAST LIMIT 1
    ),
    targets AS (
        SELECT source, source_size,
            CASE WHEN 2 * source_size < (wanted - level.capped)::DOUBLE * weight / level.open::DOUBLE
                THEN CAST(2 * source_size AS DOUBLE)
                ELSE (wanted - level.capped)::DOUBLE * weight / level.open::DOUBLE END AS target
        FROM ordered, level
    ),
    placed AS (
        SELECT doc_id, size, source_size, target, floor(target / nullif(source_size, 0)) AS passes,
            CAST(sum(size) OVER (PARTITION BY docs.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS BIGINT) AS up_to,
            CAST(sum(size) OVER (PARTITION BY docs.source, hash) AS BIGINT) AS same,
            count(*) OVER (PARTITION BY docs.source, hash) AS n,
            row_number() OVER (PARTITION BY docs.source, hash) AS nth
        FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
    )
    SELECT doc_id, size, source_size, target, CAST(size * (coalesce(passes, 0) + CASE
            WHEN up_to <= target - passes * source_size THEN 1
            WHEN up_to - same <= target - passes * source_size
                AND nth <= floor((2 * (target - passes * source_size - (up_to - same)) * n + same) / (2.0 * same)) THEN 1
            ELSE 0 END) AS BIGINT) AS taken
    FROM placed"""

_CHUNKS_SQL = """
    WITH docs AS (
        SELECT doc_id, text, coalesce(md5(text), '') AS node, string_split(text, chr(10)) AS lines FROM documents
    ),
    different AS (SELECT DISTINCT doc_id, node, lines FROM docs WHERE text IS NOT NULL),
    flat AS (SELECT doc_id, node, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM different),
    pairs AS (
        SELECT doc_id, node, place, lead(place) OVER document AS till,
            line || chr(10) || lead(line) OVER document AS bytes
        FROM flat WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
        WINDOW document AS (PARTITION BY doc_id, node ORDER BY place)
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id NULLS FIRST, node, place) AS occurrence
        FROM pairs WHERE till IS NOT NULL
    ),
    gone AS (
        SELECT *, lag(till) OVER (PARTITION BY doc_id, node ORDER BY place) IS NOT DISTINCT FROM place AS goes_on
        FROM ranked WHERE occurrence > 1
    ),
    gone_lines AS (SELECT DISTINCT doc_id, node, unnest(range(place, till + 1)) AS place FROM gone),
    sums AS (
        SELECT * FROM (SELECT doc_id, node, count(*) FILTER (NOT goes_on) AS removed_chunks FROM gone
            GROUP BY doc_id, node) chunks
        JOIN (SELECT doc_id AS own_id, node AS own_node, count(*) AS removed_lines FROM gone_lines
            GROUP BY doc_id, node) ON doc_id IS NOT DISTINCT FROM own_id AND node = own_node
    ),
    kept AS (
        SELECT flat.doc_id, flat.node, string_agg(line, chr(10) ORDER BY flat.place) AS text
        FROM flat LEFT JOIN gone_lines g
            ON flat.doc_id IS NOT DISTINCT FROM g.doc_id AND flat.node = g.node AND flat.place = g.place
        WHERE g.node IS NULL GROUP BY flat.doc_id, flat.node
    )
    SELECT docs.doc_id, CASE WHEN removed_chunks IS NULL THEN docs.text ELSE coalesce(kept.text, '') END AS text,
        CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, coalesce(removed_chunks, 0) AS removed_chunks,
        coalesce(removed_lines, 0) AS removed_lines
    FROM docs LEFT JOIN sums ON docs.doc_id IS NOT DISTINCT FROM sums.doc_id AND docs.node = sums.node
        LEFT JOIN kept ON docs.doc_id IS NOT DISTINCT FROM kept.doc_id AND docs.node = kept.node"""

_EMBEDDINGS_SQL = f"""
    WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
    links AS (
        SELECT a.vec_id AS one, b.vec_id AS two FROM vectors a JOIN vectors b
        ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.vector, b.vector) >= {embeddings.COSINE}
    ),
    reached AS (
        SELECT vec_id, vec_id AS other FROM vectors
        UNION SELECT reached.vec_id, links.two FROM reached JOIN links ON reached.other = links.one
    ),
    smallest AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
    counts AS (SELECT one AS vec_id, count(*) AS n_links FROM links GROUP BY one)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM smallest LEFT JOIN counts USING (vec_id)"""

_CONTAMINATION_SQL = f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_words("text")} AS words FROM documents),
    items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, words, least(len(words), {decontamination.WINDOW}) AS size
        FROM (SELECT item_id, {_words("text")} AS words FROM benchmark) WHERE len(words) > 0),
    windows AS (
        SELECT DISTINCT item_id, size, array_to_string(list_slice(words, start + 1, start + size), ' ') AS words
        FROM (SELECT item_id, words, size, unnest(range(len(words) - size + 1)) AS start FROM items)
    ),
    places AS (
        SELECT row, start, size, array_to_string(list_slice(words, start + 1, start + size), ' ') AS words
        FROM (SELECT row, words, size, unnest(range(len(words) - size + 1)) AS start
            FROM docs, (SELECT DISTINCT size FROM items) WHERE len(words) >= size)
    ),
    hits AS (SELECT row, start, size, item_id FROM places JOIN windows USING (size, words)),
    marked AS (
        SELECT row, count(DISTINCT place) AS n_hit
        FROM (SELECT row, unnest(range(start, start + size)) AS place FROM hits) GROUP BY row
    ),
    named AS (
        SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
        FROM hits GROUP BY row
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
        coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN marked USING (row) LEFT JOIN named USING (row)"""


_SEARCH_SQL = f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_words("text")} AS words FROM documents),
    corpus AS (SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS length FROM docs WHERE len(words) > 0),
    asked AS (
        SELECT item, item_id, term, count(*) AS times
        FROM (SELECT row_number() OVER () AS item, item_id, unnest({_words("text")}) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark))
        GROUP BY ALL
    ),
    counted AS (
        SELECT row, doc_id, n, term, count(*) AS tf
        FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS term FROM docs)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL
    ),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight
        FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus
    ),
    worth AS (
        SELECT row, doc_id, term,
            weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // length)))) AS value
        FROM counted JOIN weights USING (term), corpus
    ),
    scored AS (
        SELECT item, item_id, row, doc_id, CAST(sum(times * value) AS BIGINT) AS score
        FROM asked JOIN worth USING (term) GROUP BY ALL
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scored WHERE score > 0
    ) WHERE rank <= {shared_search.RESULTS}"""


def _clusters_sql() -> str:
    def assigned(number: int) -> str:
        return f"""assigned{number} AS (
            SELECT row, arg_min(number, (distance, number)) AS number, min(distance) AS distance FROM (
                SELECT row, number, sum((x - c) * (x - c)) AS distance
                FROM flat JOIN centroids{number} USING (place) GROUP BY row, number
            ) GROUP BY row
        )"""

    def moved(number: int) -> str:
        # Floors of quotients, as integer division cuts towards zero.
        return f"""centroids{number + 1} AS (
            SELECT number, place, coalesce((s - ((s % n) + n) % n) // n, c) AS c
            FROM centroids{number} LEFT JOIN (
                SELECT number, place, sum(x) AS s, count(*) AS n
                FROM assigned{number} JOIN flat USING (row) GROUP BY number, place
            ) USING (number, place)
        )"""

    steps = ", ".join(f"{assigned(n)}, {moved(n)}" for n in range(centroids.ROUNDS))
    last = centroids.ROUNDS
    return f"""
    WITH vectors AS (
        SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
        WHERE len(embedding) = {centroids.DIMENSIONS}
            AND len(list_filter(embedding, lambda x: isfinite(x))) = {centroids.DIMENSIONS}
    ),
    flat AS (
        SELECT row, unnest(range({centroids.DIMENSIONS})) AS place,
            CAST(floor({centroids.SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
        FROM vectors
    ),
    first AS (
        SELECT row, row_number() OVER (
            ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS number
        FROM vectors QUALIFY number < {centroids.CENTROIDS}
    ),
    centroids0 AS (SELECT number, place, CAST(x AS HUGEINT) AS c FROM first JOIN flat USING (row)),
    {steps}, {assigned(last)},
    named AS (
        SELECT number, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256
        FROM centroids{last} GROUP BY number
    )
    SELECT vec_id, CAST(number AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
        CAST(sum(distance) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM vectors JOIN assigned{last} USING (row) JOIN named USING (number)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested in ``tests/llm``."""
    return {
        "op1_license_scan": _license_sql(),
        "op3_source_mix": _MIX_SQL,
        "op4_line_chunks": _CHUNKS_SQL,
        "op8_embedding_links": _EMBEDDINGS_SQL,
        "op9_contamination": _CONTAMINATION_SQL,
        "op11_shared_search": _SEARCH_SQL,
        "op12_centroids": _clusters_sql(),
    }
