"""Word hashes and bin numbers."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_FUNCTIONS = ("md5", "blake2b")
JVM_HASHES = ("md5",)

# A bin is a folder; more than so many are never of use.
MAX_BINS = 1_000_000

# 128-bit digests written as hexadecimal digits.
DIGEST_BYTES = 16
DIGEST_DIGITS = 32


def _blake2b(word: Column) -> Column:
    # Nested, so that workers get the function itself and need no copy of this package.
    def digests_of(words: pa.Array) -> pa.Array:
        encoded = words.dictionary_encode()
        digests = pa.array(
            [
                hashlib.blake2b(word.encode(), digest_size=DIGEST_BYTES).hexdigest()
                for word in encoded.dictionary.to_pylist()
            ],
            pa.string(),
        )
        return digests.take(encoded.indices)

    return F.arrow_udf(digests_of, T.StringType())(word)


def digest_at(digests: Column, place: Column) -> Column:
    """The digest at a place, from 0, as hexadecimal digits."""
    return F.lower(F.hex(F.substring(digests, place * DIGEST_BYTES + 1, F.lit(DIGEST_BYTES))))


def word_hash(word: Column | str, hash_function: str = "md5") -> Column:
    """128-bit digest of a word as 32 hexadecimal digits.

    ``md5`` stays in the JVM and is the default; ``blake2b`` gives the same digests as an index hashed
    with BLAKE2b-128, one Arrow batch at a time.
    """
    word = F.col(word) if isinstance(word, str) else word
    if hash_function == "md5":
        return F.md5(word)
    if hash_function == "blake2b":
        return _blake2b(word)
    raise ValueError(f"unknown hash function {hash_function!r}, choose one of {HASH_FUNCTIONS}")


def hash_bin(digest: Column | str, bins: int) -> Column:
    """``(digest as a 128-bit number) % bins + 1``, digit group by digit group.

    The remainder so far is below ``bins``, so a group of 8 digits keeps the sum within a long for up to
    2^31 bins.  Where ``bins`` divides 2^32 the last group alone decides.
    """
    if not 1 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be between 1 and {MAX_BINS}, not {bins}")
    digest = F.col(digest) if isinstance(digest, str) else digest
    group = 8
    first_digit = DIGEST_DIGITS - group + 1 if 2**32 % bins == 0 else 1
    remainder = F.lit(0).cast("long")
    for start in range(first_digit, DIGEST_DIGITS + 1, group):
        number = F.conv(F.substring(digest, start, group), 16, 10).cast("long")
        remainder = F.pmod(remainder * F.lit(2**32) + number, F.lit(bins).cast("long"))
    return (remainder + 1).cast("int")


def text_bin(text_id: Column | str, bins: int) -> Column:
    """``text_id % bins + 1``."""
    if not 1 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be between 1 and {MAX_BINS}, not {bins}")
    text_id = F.col(text_id) if isinstance(text_id, str) else text_id
    return (F.pmod(text_id, F.lit(bins)) + 1).cast("int")
