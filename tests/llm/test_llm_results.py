"""Results next to brute force, held-out accuracy, and hand-made cases."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

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

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def frame(spark, texts, **columns):
    rows = [(i, text) for i, text in enumerate(texts)]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in columns.items():
        found = found.withColumn(name, F.lit(value))
    return found


# Shared


def test_words_are_those_of_the_pattern():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    letters = [chr(i) for i in range(0x300)] + ["中", " ", "😀", "É"]
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choices(letters, k=40))
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        assert [w.decode() for w in common.words_of(text.encode())] == pattern.findall(lower)


@pytest.mark.parametrize("hot_links", [10_000, 8, 1])
def test_components_of_paths_stars_and_rings(spark, monkeypatch, hot_links):
    monkeypatch.setattr(common, "HOT_LINKS", hot_links)
    monkeypatch.setattr(common, "HOT_NODES", 50)
    random.seed(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)]
    links += [(200 + i, 200 + (i + 1) % 30) for i in range(30)]
    links += [tuple(random.sample(range(300, 400), 2)) for _ in range(70)] + [(500, 500)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = common.components(spark.createDataFrame(links, "left long, right long")).collect()
    assert {row.node: row.component for row in found} == {x: find(x) for x in parent if x != 500}
    assert len(found) == len(parent) - 1


# Licences


def test_prefix_filter_loses_no_template(spark):
    random.seed(7)
    words = [f"w{i}" for i in range(14)]
    templates = tuple((f"t{i}", " ".join(random.sample(words, random.randint(1, 10)))) for i in range(12))
    lines = [" ".join(random.choices(words + ["x", "y"], k=random.randint(0, 130))) for _ in range(150)]
    for percent in (50, 80, 90, 100):
        rows = licenses.scan_licenses(frame(spark, lines), templates, percent).collect()
        for row in rows:
            met = set()
            all_words = lines[row.doc_id].split()
            for start in range(0, max(len(all_words) - 25, 1), 25):
                own = set(all_words[start : start + 50])
                for label, text in templates:
                    if len(own & set(text.split())) * 100 >= percent * len(set(text.split())):
                        met.add(label)
            assert row.labels == ",".join(sorted(met))


def test_license_phrases(spark):
    texts = [
        "MIT license, mit License: mit\nlicense",
        "mit licenses; admit license; cc-by and CC, BY",
        "GNU general general public license GNU General Public License",
    ]
    rows = sorted(licenses.scan_licenses(frame(spark, texts)).collect())
    assert [(row.n_base, row.first_word, row.last_word, row.base_labels) for row in rows] == [
        (3, 0, 4, "mit"),
        (2, 4, 7, "cc-by"),
        (1, 5, 5, "gpl"),
    ]


def test_notices_broken_over_lines(spark):
    texts = [
        "MIT\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
        'of this software and associated documentation files (the "Software"), to deal',
        "# Redistribution and use in source and binary forms, with or without\n"
        "# modification, are permitted provided that the following conditions are met:\n# 1.",
        "This Source Code Form is subject to the terms of the\nMozilla Public\nLicense, v. 2.0.",
        "made available under the terms of the Eclipse\nPublic License 2.0",
        "wir kommen mit dem Zug\nLicensed under the Apache License, Version 2.0",
        "Licensed under\nthe\n" + "x " * 20 + "\nMIT License",
        "all rights\nreserved, all rights reserved",
    ]
    rows = sorted(licenses.scan_licenses(frame(spark, texts)).collect())
    assert [(row.labels, row.score, row.n_blocks) for row in rows] == [
        ("mit-text", 1.0, 1),
        ("bsd", 1.0, 1),
        ("mpl-2.0", 1.0, 1),
        ("epl-2.0", 1.0, 1),
        ("apache,apache-2.0", 1.0, 1),
        ("mit", 1.0, 0),
        ("all-rights-reserved", 1.0, 1),
    ]


# Toxicity


def test_toxicity_on_held_out_rows(documents, labels):
    model = toxicity.fit_toxicity(documents, labels)
    scored = toxicity.score_documents(documents, model).join(labels, "doc_id").collect()
    held = [row for row in scored if row.held_out]
    assert len(held) > 50
    right = sum(row.predicted == row.toxic for row in held)
    assert right / len(held) >= 0.93
    clean = [row for row in scored if row.toxic == 0]
    assert sum(row.predicted for row in clean) <= 0.02 * len(clean)
    assert model.label_model.accuracies["insults"] > 0.5


def test_label_model_finds_accuracies_and_correlations():
    random.seed(11)
    voters = ("good", "copy", "weak", "noise")
    counts = np.zeros(16)
    labelled = np.zeros((16, 2))
    for i in range(20_000):
        toxic = random.random() < 0.2
        good = random.random() < (0.9 if toxic else 0.02)
        copy = good if random.random() < 0.95 else not good
        weak = random.random() < (0.6 if toxic else 0.1)
        noise = random.random() < 0.3
        pattern = good | copy << 1 | weak << 2 | noise << 3
        counts[pattern] += 1
        if i < 400:
            labelled[pattern, int(toxic)] += 1
    model = toxicity.fit_label_model(counts, labelled, voters)
    assert ("good", "copy") in model.correlated and ("weak", "noise") not in model.correlated
    assert model.accuracies["good"] > model.accuracies["weak"] > model.accuracies["noise"]
    assert abs(model.prior - 0.2) < 0.08
    assert model.posterior[0b0111] > 0.8 > 0.2 > model.posterior[0b1000]


# Mixing


def test_mix_by_sorting(documents):
    rows = mixing.mix(documents).join(documents.select("doc_id", "text", "source"), "doc_id").collect()
    assert len(rows) == documents.count()
    by_source = collections.defaultdict(list)
    for row in rows:
        assert row["size"] == len(re.findall(r"[^\x20\x09-\x0d]+", row.text))
        by_source[row.source].append(row)
    total = sum(row["size"] for row in rows)
    names = sorted(by_source)
    sizes = {name: sum(row["size"] for row in by_source[name]) for name in names}
    weight = {name: (5, 2, 1)[i % 3] for i, name in enumerate(names)}
    target, budget, open_ = {}, 1.5 * total, set(names)
    while True:
        level = budget / sum(weight[name] for name in open_)
        over = {name for name in open_ if weight[name] * level > 2 * sizes[name]}
        if not over:
            break
        for name in over:
            target[name] = 2.0 * sizes[name]
            budget -= target[name]
        open_ -= over
    target |= {name: level * weight[name] for name in open_}
    for name, own in by_source.items():
        assert own[0].target == pytest.approx(target[name]) and own[0].source_size == sizes[name]
        assert abs(sum(row.taken for row in own) - target[name]) <= max(row["size"] for row in own)
        assert all(row.taken in (0, row["size"], 2 * row["size"]) for row in own)


def test_mix_plan_has_no_python(documents):
    plan = mixing.mixed_documents(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mixed_documents_are_the_rows_of_the_mix(documents):
    times = {row.doc_id: row.taken // row["size"] for row in mixing.mix(documents).collect() if row["size"]}
    kept = collections.Counter(row.doc_id for row in mixing.mixed_documents(documents).select("doc_id").collect())
    assert kept == collections.Counter({i: n for i, n in times.items() if n})


# Line chunks


def test_line_chunks_are_removed_after_their_first_place(spark):
    random.seed(13)
    passage = [f"shared line {i} of the passage" for i in range(40)]
    texts = []
    for i in range(12):
        own = [f"line {i} {random.random()}" for _ in range(random.randint(0, 9))]
        tail = [f"tail {i} {random.random()}" for _ in range(5)]
        texts.append("\n".join(own + passage + tail))
    rows = sorted(line_chunks.without_repeated_chunks(frame(spark, texts)).collect())
    assert rows[0].text == texts[0] and rows[0].removed_chunks == 0
    assert all(row.removed_lines >= 20 for row in rows[1:])
    for row in rows:
        lines = row.text.split("\n")
        assert row.n_lines - row.removed_lines == len(lines)
        assert [line for line in texts[row.doc_id].split("\n") if not line.startswith("shared")] == [
            line for line in lines if not line.startswith("shared")
        ]


def lines_left(rows):
    """(doc_id, text): text, chunks and lines removed, line by line."""
    full = {
        key: [(i, line) for i, line in enumerate(key[1].split("\n")) if line.strip(" \t\r")]
        for key in rows
        if key[1] is not None
    }
    found, seen = {}, set()
    for key in sorted(full, key=lambda k: (k[0] is not None, k[0] or 0, hashlib.md5(k[1].encode()).hexdigest())):
        gone, chunks, end = set(), 0, None
        for (place, line), (till, following) in itertools.pairwise(full[key]):
            if (line, following) in seen:
                gone |= set(range(place, till + 1))
                chunks += place != end
                end = till
            seen.add((line, following))
        lines = key[1].split("\n")
        found[key] = ("\n".join(line for i, line in enumerate(lines) if i not in gone), chunks, len(gone))
    return found


def texts_with_passages(size):
    random.seed(29 + size)
    rows = []
    for passage in range(6):
        planted = [f"passage {passage} {random.random()}" for _ in range(size)]
        for _ in range(random.randint(2, 5)):
            before = [f"before {random.random()}" for _ in range(random.randint(0, 6))]
            after = [f"after {random.random()}" for _ in range(random.randint(0, 6))]
            rows.append((len(rows), "\n".join(before + planted + after)))
    return rows


def test_passages_of_two_to_ten_lines_are_removed_everywhere_but_once(spark):
    rows = [(f"{size}", text) for size in range(2, 11) for _, text in texts_with_passages(size)]
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    kept = line_chunks.without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = collections.Counter(line for row in kept for line in row.text.split("\n") if line)
    assert left == collections.Counter({line for _, text in rows for line in text.split("\n")})


@pytest.mark.parametrize("hashes, few, share", [("good", 100, 50_000), ("good", 0, 3), ("clashing", 100, 50_000)])
def test_line_chunks_next_to_line_by_line(spark, monkeypatch, hashes, few, share):
    """Also with hot hashes and with lines that share a hash although they differ."""
    monkeypatch.setattr(line_chunks, "FEW", few)
    monkeypatch.setattr(line_chunks, "HOT_SHARE", share)
    if hashes == "clashing":
        monkeypatch.setattr(line_chunks, "_hash_of", lambda line: F.xxhash64(F.substring(line, 1, 1)))
    random.seed(31)
    lines = [f"{letter}{i}" for letter in "abcd" for i in range(6)] + ["", "", " ", "\t\r"]
    rows = [(i, "\n".join(random.choices(lines, k=random.randint(0, 12)))) for i in range(150)]
    rows += [(None, "a1\n\nb2\nc3"), (None, "a1\nb2"), (3, None), (4, ""), (None, None)] + [(7, "x\ny\nz")] * 5
    rows += [(8, "x\ny\nz"), (9, "x\nx\nx\nx"), (10, "q\n" * 3000)]
    wanted = lines_left(rows)
    found = line_chunks.without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = collections.Counter((r.doc_id, r.text, r.removed_chunks, r.removed_lines) for r in found.collect())
    assert seen == collections.Counter(
        (key[0], *wanted[key]) if key[1] is not None else (key[0], None, 0, 0) for key in rows
    )


# Near copies


@pytest.mark.parametrize("small, block", [(64, 2048), (0, 7)])
def test_near_duplicates_next_to_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    random.seed(17)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(25):
        base = random.choices(words, k=random.randint(40, 160))
        texts.append(" ".join(base))
        for _ in range(random.randint(0, 6)):
            copy = list(base)
            for place in random.sample(range(len(copy)), random.randint(0, 4)):
                copy[place] = random.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + ["", "two words", "Two, words!", "?"]
    documents = frame(spark, texts)
    idf = minhash.inverse_frequencies(documents)
    weighted = [minhash._weighted(text.encode(), idf) for text in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if minhash.weighted_jaccard(weighted[a], weighted[b]) >= 0.8 - 1e-9:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {row.doc_id: row.class_id for row in minhash.near_duplicates(documents).collect()}
    wrong = [i for i in range(len(texts)) if found[i] != find(i)]
    assert len(wrong) <= 1, wrong


@pytest.mark.parametrize("small", [64, 0])
def test_links_only_through_a_text_that_is_no_pivot(spark, monkeypatch, small):
    """A chain of texts, each like the next and unlike the one after that, is one class."""
    monkeypatch.setattr(minhash, "SMALL", small)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[8 * i : 8 * i + 150]) for i in range(12)]
    rows = minhash.near_duplicates(frame(spark, texts)).collect()
    assert {row.class_id for row in rows} == {0} and sum(row.kept for row in rows) == 1


def test_consistent_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 300, dtype=np.uint64)
    one = rng.integers(1, 6, 300).astype(np.float32)
    two = np.where(rng.random(300) < 0.3, rng.integers(1, 6, 300), one).astype(np.float32)
    similarity = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    owner = np.zeros(300, np.int64)
    size = 1500
    a = minhash.samples(owner, hashes, one, 1, size)
    b = minhash.samples(owner, hashes, two, 1, size)
    assert abs((a == b).mean() - similarity) < 0.05


def test_shingles_next_to_plain_python():
    texts = [b"A b c d e f, a B c D e", b"", b"one two", b"x " * 30, "ä ö ü".encode(), b"a b c d e f"]
    owner, hashes, often = minhash.shingles(texts)
    counts = []
    for text in texts:
        words = common.words_of(text)
        step = min(5, len(words)) or 1
        counts.append(collections.Counter(tuple(words[i : i + step]) for i in range(len(words) - step + 1)))
    for i, expected in enumerate(counts):
        assert sorted(often[owner == i]) == sorted(n for shingle, n in expected.items() if shingle)
    assert set(hashes[owner == 5]) <= set(hashes[owner == 0])


# Pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p {}</style><script>var a = "<p>no</p>";</script></head>
<body class="page"><header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>
 text&nbsp;here &#233;.<br>same block</p><div class="ad">Buy <div>now</div></div><!-- <p>no</p> -->
<p>Second with <a href="x">a link</a>.<p>Third, never closed<aside>Side</aside>
<form><p>Mail</p></form><p><a href="y">Only a link</a></p></article>
<section id="comments"><article><p>Reader's remark</p></article></section>
<footer>&copy; me</footer></body></html>"""


def test_html_article():
    assert html_text.main_text(PAGE).split("\n") == [
        "Title & more",
        "First bold text here é. same block",
        "Second with a link .".replace(" .", "."),
        "Third, never closed",
        "Only a link",
    ]


def test_html_without_an_article_by_surge_and_dive():
    long = "This is a paragraph of running text that is long enough to be told from a menu. " * 2
    page = (
        "<div><a href=1>One</a></div><div><a href=2>Two</a></div><h2>Heading</h2>"
        f"<p>{long}</p><p>Short one.</p><div><a href=3>Promo</a></div><p>{long}</p><div><a href=4>Next</a></div>"
    )
    assert html_text.main_text(page).split("\n") == ["Heading", long.strip(), "Short one.", long.strip()]


@pytest.mark.parametrize("anchor", ["<a name=x>", "<a id='x'/>", "<a name='top'><b>", "<a href='/x'>"])
def test_html_anchors_end_no_text(anchor):
    long = "This is a paragraph of running text that is long enough to be told from a menu. " * 2
    page = f"<p>{long}</p><p>{anchor}</p><p>One {long}</p><p>Two {long}</p><p>Three <a href=1>link</a></p>"
    expected = [long.strip(), f"One {long}".strip(), f"Two {long}".strip(), "Three link"]
    assert html_text.main_text(page).split("\n") == expected
    assert html_text.main_text(f"<article>{anchor}<p>The only text</p></article>") == "The only text"


def test_html_keeps_all_articles():
    long = "One sentence of running text that goes on and on. " * 3
    page = (
        f"<nav>Menu</nav><main><h1>All</h1><article><h2>One</h2><p>{long}</p></article><p>Between.</p></main>"
        f"<article><p>Short.</p></article><aside>{long}</aside><article><h2>Two</h2><p>{long}{long}</p></article>"
        f"<article class='comment'><p>{long}</p></article><footer>Foot</footer>"
    )
    text, twice = long.strip(), (long + long).strip()
    assert html_text.main_text(page).split("\n") == ["All", "One", text, "Between.", "Short.", "Two", twice]


def test_html_distribution_inside_an_article():
    """Surge and dive find the text, which goes on over short lines and linked paragraphs, but not over bare links."""
    long = "One sentence of running text that goes on and on. " * 3
    links = "<div><a href='/a'>First</a></div><div><a href='/b'>Second</a></div>"
    page = f"<article>{links}<h1>Title</h1><p><a href='/c'>By us</a></p><p>{long}</p><p>End.</p>{links}</article>"
    assert html_text.main_text(page).split("\n") == ["Title", "By us", long.strip(), "End."]
    inner = f"<article><p>{long}</p>{links}<p>{long}</p></article>"
    assert html_text.main_text(inner).split("\n") == [long.strip(), "First", "Second", long.strip()]


def test_html_windows_by_brute_force():
    random.seed(11)
    for size in (*range(6), 40):
        lengths = [random.choice([0, 0, 5, 60, 300]) for _ in range(size)]
        expected = [sum(lengths[i : i + html_text.WINDOW]) for i in range(size)]
        assert html_text.window_sums(lengths) == expected


@pytest.mark.parametrize("box", ["<div class='ad'>x", "<nav>", "<li class='menu'>x", "<p class='ad'>x", "<article>y", "<a href='x'>z", "</div>"])
def test_html_of_unclosed_elements_takes_linear_time(box):
    import time

    start = time.perf_counter()
    html_text.main_text(box * 100_000 + "<p>The end of it.</p>")
    assert time.perf_counter() - start < 10


def test_html_link_paragraphs_within_running_text():
    long = "This is a paragraph of running text that is long enough to be told from a menu. " * 2
    page = f"<div><a href=1>Home</a></div><p>{long}</p><p><a href=2>The source</a></p><h2><a href=3>Part</a></h2><p>{long}</p>"
    assert html_text.main_text(page).split("\n") == [long.strip(), "The source", "Part", long.strip()]


def test_html_boxes_within_a_line():
    page = (
        "<article><p>First <button>Subscribe</button> text <span class='ad'>Buy <div>this</div> now</span> goes on "
        "<select><option>One<option>Two</select>here.</p><p class='share'>Share<div class='promo'>Offer</div>"
        "<table><tr><td class='sidebar'>Side</td><td>Cell</td></tr></table><p><a class='share' href=1>Tweet</a> End.</p></article>"
    )
    assert html_text.main_text(page).split("\n") == ["First text goes on here.", "Cell", "End."]


@pytest.mark.parametrize("page", ["<", "<p", "<!--", "<script>x", "<a href='", "&amp", "</p></p>", "<nav>x", "x > y"])
def test_html_broken_markup(page):
    assert isinstance(html_text.main_text(page), str)


# Shards


def test_best_fit_by_scanning_all_bins():
    random.seed(19)
    for _ in range(60):
        capacity = random.randint(10, 60)
        sizes = sorted((random.randint(1, capacity) for _ in range(80)), reverse=True)
        bins, expected = [], []
        for size in sizes:
            fitting = [(left, i) for i, left in enumerate(bins) if left >= size]
            if fitting:
                i = min(fitting)[1]
            else:
                i = len(bins)
                bins.append(capacity)
            bins[i] -= size
            expected.append(i)
        assert sharding.pack(sizes, capacity) == expected
        runs = sorted(collections.Counter(sizes).items(), reverse=True)
        in_runs = sharding.pack_runs(runs, capacity)
        assert [bin_ for _, bin_, n in in_runs for _ in range(n)] == expected
        assert [runs[run][0] for run, _, n in in_runs for _ in range(n)] == sizes


@pytest.mark.parametrize("bits, fine", [(16, 1_000), (3, 1_000), (16, 2)])
def test_every_group_is_packed_by_its_size(spark, monkeypatch, bits, fine):
    """All groups are far smaller than a shard; the result is the packing of them all, one after another."""
    monkeypatch.setattr(sharding, "SIZE_BITS", bits)
    monkeypatch.setattr(sharding, "FINE", fine)
    random.seed(37)
    texts = [f"{i} " + "x" * random.randint(0, 60) for i in range(900)]
    texts += random.choices(texts, k=300)
    rows = sharding.shard_documents(frame(spark, texts), 5).collect()
    sizes = collections.Counter()
    shard_of = {}
    for row in rows:
        sizes[texts[row.doc_id]] += row["size"]
        assert shard_of.setdefault(texts[row.doc_id], row.shard) == row.shard

    def rounded(size):
        unit = 2 ** max(size.bit_length() - bits, 0)
        return -(-size // unit) * unit

    ordered = sorted(sizes, key=lambda text: (-rounded(sizes[text]), hashlib.md5(text.encode()).digest()))
    runs = [(rounded(sizes[text]), 1) for text in ordered]
    expected = [shard for _, shard, _ in sharding.pack_into(runs, 5)]
    assert [shard_of[text] for text in ordered] == expected


def test_shards_are_near_equal_and_keep_groups(spark, documents):
    rows = sharding.shard_documents(documents).join(documents.select("doc_id", "text"), "doc_id").collect()
    sums = collections.Counter()
    groups = collections.defaultdict(set)
    for row in rows:
        assert row["size"] == len(row.text.encode()) + 8
        sums[row.shard] += row["size"]
        groups[row.text].add(row.shard)
    assert len(sums) == 24 and max(sums.values()) <= 1.02 * min(sums.values())
    assert all(len(shards) == 1 for shards in groups.values())


def test_a_group_beyond_a_shard_is_cut(spark):
    texts = ["the same text in a third of all rows"] * 600 + [f"text {i} " * 5 for i in range(900)]
    rows = sharding.shard_documents(frame(spark, texts), 8).collect()
    sums = collections.Counter()
    for row in rows:
        sums[row.shard] += row["size"]
    assert len(sums) == 8 and max(sums.values()) <= 1.02 * min(sums.values())


def test_null_texts_beyond_a_shard_are_cut(spark):
    rows = [(i, None) for i in range(90)] + [(i, "") for i in range(90, 100)] + [(100, "some text")]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(found) == 101
    sums = collections.Counter()
    for row in found:
        sums[row.shard] += row["size"]
    assert len(sums) == 4 and max(sums.values()) - min(sums.values()) <= 17
    for shard in sums:
        assert sorted(row.slot for row in found if row.shard == shard) == list(range(sum(row.shard == shard for row in found)))


# Vectors


def test_vectors_next_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 64)
    rng = np.random.default_rng(23)
    centres = rng.normal(size=(60, 24))
    rows = []
    for i in range(700):
        vector = centres[rng.integers(60)] + rng.normal(size=24) * rng.choice([0.02, 0.14, 0.2])
        rows.append((int(i), [float(x) for x in vector * rng.uniform(0.1, 9)], int(rng.integers(2))))
    rows += [(700 + i, rows[i][1], rows[i][2]) for i in range(20)]
    units = np.array([embeddings.unit(np.array(v)) for _, v, _ in rows])
    labels = np.array([label for _, _, label in rows])
    linked = (units @ units.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    component = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.minimum(component, np.where(linked, component, len(rows)).min(1))
        if (new == component).all():
            break
        component = new
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert linked.sum() > 1000
    assert {row.vec_id: (row.n_links, row.component_id) for row in found} == {
        i: (int(linked[i].sum()), int(component[i])) for i in range(len(rows))
    }


# Decontamination


def test_suffix_search_next_to_all_windows():
    random.seed(29)
    for _ in range(150):
        words = [bytes([97 + i]) for i in range(random.choice([2, 3, 8]))]
        texts = [b" ".join(random.choices([*words, b"zz"], k=random.randint(0, 30))) for _ in range(5)]
        items = [(str(i), b" ".join(random.choices(words, k=random.randint(0, 7)))) for i in range(4)]
        suffixes = decontamination.benchmark_suffixes(items, 4)
        tokens, begins = [], []
        for text in texts:
            begins.append(len(tokens))
            tokens += [suffixes.vocabulary.get(word, 0) for word in common.words_of(text)] + [0]
        places, numbers = decontamination.search_shard(np.array(tokens), suffixes)
        found = {(int(p), suffixes.item_of[suffixes.items[n]]) for p, n in zip(places, numbers, strict=True)}
        expected = set()
        for text, begin in zip(texts, begins, strict=True):
            own = common.words_of(text)
            for name, item in items:
                asked = common.words_of(item)
                size = min(4, len(asked))
                for i, j in itertools.product(range(len(own) - size + 1), range(len(asked) - size + 1)):
                    if size and own[i : i + size] == asked[j : j + size]:
                        expected.add((begin + i, name))
        assert found == expected


def test_one_document_shards_of_a_benchmark_with_thousands_of_words():
    random.seed(31)
    words = [f"w{i}".encode() for i in range(6000)]
    items = [(str(i), b" ".join(random.choices(words, k=40))) for i in range(200)]
    suffixes = decontamination.benchmark_suffixes(items)
    assert len(suffixes.vocabulary) > 4000
    for _ in range(60):
        asked = [random.choice(items)[1].split() for _ in range(2)]
        text = [*random.choices(words, k=20), *asked[0][5:30], b"zz", *random.choices(words, k=9), *asked[1][:12]]
        tokens = np.array([suffixes.vocabulary.get(word, 0) for word in text] + [0])
        places, _ = decontamination.search_shard(tokens, suffixes)
        windows = {tuple(item.split()[j : j + 10]) for _, item in items for j in range(31)}
        expected = {i for i in range(len(text) - 9) if tuple(text[i : i + 10]) in windows}
        assert set(places.tolist()) == expected and len(expected) >= 19


def test_longest_match_and_blocks(spark, monkeypatch):
    item = " ".join(f"i{n}" for n in range(30))
    text = "x y " + " ".join(f"i{n}" for n in range(5, 25)) + " z " + " ".join(f"i{n}" for n in range(12))
    benchmark = spark.createDataFrame([(1, item), (2, " ".join(f"k{n}" for n in range(12)))], "item_id long, text string")
    documents = frame(spark, [text, "x y z"])
    for size in (8 << 20, 50):
        blocks = decontamination.benchmark_blocks(benchmark, block_bytes=size)
        found = documents.select("doc_id", decontamination.contamination("text", blocks).alias("f")).select("doc_id", "f.*")
        row = found.filter("doc_id = 0").first()
        assert [tuple(match) for match in row.matches] == [("1", 5, 2, 20)]
        assert (row.n_words, row.n_hit, row.n_items) == (35, 32, 1)
    assert decontamination.without_contaminated(documents, benchmark).select("doc_id").collect() == [(1,)]


# Language


def test_language_on_held_out_rows(documents):
    found = language.identify(documents, language.fit_profiles(documents)).join(documents.select("doc_id", "lang"), "doc_id")
    held = [row for row in found.collect() if row.held_out]
    assert sum(row.lang_pred == row.lang for row in held) / len(held) >= 0.97


def test_rank_order_distance():
    letters = language.letter_table()
    codes, counts = language.ngrams("Aa, b", letters)
    assert counts.sum() == 3 + 5 + 3
    top = language.most_frequent(codes, counts)
    assert top[0] == ord("a")
    profiles = language.Profiles(["x"], np.sort(top), np.argsort(np.argsort(top))[:, None] * 0)
    assert 0 <= profiles.distances(top)[0] <= 1
