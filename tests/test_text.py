import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions.text import with_tokens

GOLDEN = [
    ("don't stop", ["don", "t", "stop"]),
    ("covid19", ["covid", "19"]),
    ("3.14 1,000", ["3", "14", "1", "000"]),
    ("foo_bar", ["foo", "bar"]),
    ("C++ & C#", ["c", "c"]),
    ("€5", ["€", "5"]),
    ("😀hi", ["😀", "hi"]),
    ("→", ["→"]),
    ("½ x² Ⅷ", ["½", "x", "²", "ⅷ"]),
    ("naïve Ёлка йод", ["naive", "елка", "иод"]),
    ("ΟΔΟΣ", ["οδοσ"]),
    ("हिन्दी", ["हनद"]),
    ("중국", ["중국"]),
    ("값 a한b", ["값", "a한b"]),
    ("中文，分词。", ["中文", "分词"]),
    ("", []),
    ("   \n\t ", []),
    ('"`~^|<>"', []),
    ("tel:+49-30", ["tel", "49", "30"]),
    ("“quoted” – dash—em…", ["quoted", "dash", "em"]),
    ("€€! €.€", ["€€", "€", "€"]),
    ("straße ﬁne", ["straße", "ﬁne"]),
    ("ß ẞ", ["ß", "ß"]),
    ("İstanbul ıI", ["istanbul", "ıi"]),
    (None, []),
]


def tokens_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    found = with_tokens(rows).select("n", "tokens").collect()
    return [row.tokens for row in sorted(found)]


def test_golden_tokens(spark):
    import unicodedata

    expected = [[unicodedata.normalize("NFD", w) if "가" <= min(w) or "한" in w or "값" in w
                 else w for w in words] for _, words in GOLDEN]
    assert tokens_of(spark, [text for text, _ in GOLDEN]) == expected


def library():
    pytest.importorskip("tokenizers")
    from tokenizers import normalizers, pre_tokenizers

    normalizer = normalizers.Sequence(
        [normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()]
    )
    splitter = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Whitespace(),
            pre_tokenizers.Punctuation("removed"),
            pre_tokenizers.Digits(False),
        ]
    )
    return lambda text: [w for w, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]


def test_every_character_folds_like_the_library(spark):
    pytest.importorskip("tokenizers")
    from tokenizers import normalizers

    from wordloom.functions.text import normalize

    normalizer = normalizers.Sequence(
        [normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()]
    )
    characters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    # Blocks of one kind of character, so that the Hangul path sees Hangul.
    texts = ["".join(characters[i : i + 64]) for i in range(0, len(characters), 64)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    found = dict(rows.select("n", normalize("text")).collect())
    wrong = [
        n
        for n, text in enumerate(texts)
        if found[n] != "".join(normalizer.normalize_str(char) for char in text)
    ]
    assert wrong == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_text_cuts_like_the_library(spark, seed):
    cut = library()
    dice = random.Random(seed)
    pools = [
        "abc XYZ 019 .,;'_-+$~\n\t",
        "éàßñçØøŁ üÄ Éœ",
        "ёЙщ Дж їЄ",
        "Σς ΐ Ωμέγα",
        "한국어 값닭 가힣",
        "हिन्दी देवनागरी १२३",
        "العربية ١٢٣ أإ",
        "中文，分词。「」ー、カタカナひらがな",
        "½²Ⅷ€£→😀🎉©™¼٣",
        "́̈‌‍  ­\x00\x1f\x7f",
    ]
    texts = [
        "".join(dice.choice(dice.choice(pools)) for _ in range(dice.randint(1, 40)))
        for _ in range(3000)
    ]
    found = tokens_of(spark, texts)
    wrong = [(t, f, cut(t)) for t, f in zip(texts, found) if f != cut(t)]
    assert wrong == []


def test_plan_has_no_python(spark, micro_texts):
    plan = with_tokens(micro_texts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_hash_and_bins(spark):
    import hashlib

    from wordloom.functions.hashing import hash_bin, text_bin, word_hash

    words = ["the", "café", "", "елка", "😀"]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    for name, digest in (
        ("md5", lambda w: hashlib.md5(w.encode()).hexdigest()),
        ("blake2b", lambda w: hashlib.blake2b(w.encode(), digest_size=16).hexdigest()),
    ):
        bins = [1, 7, 64, 100, 1000, 1_000_000]
        row_bins = [hash_bin("hash", n).alias(f"b{n}") for n in bins]
        found = rows.withColumn("hash", word_hash("word", name)).select("word", "hash", *row_bins)
        for row in found.collect():
            assert row.hash == digest(row.word)
            assert [row[f"b{n}"] for n in bins] == [int(row.hash, 16) % n + 1 for n in bins]
    assert [r[0] for r in spark.range(5).select(text_bin("id", 3)).collect()] == [1, 2, 3, 1, 2]
    with pytest.raises(ValueError):
        word_hash(F.col("word"), "sha1")
