"""Lexical search over positional indexes, as Spark jobs."""

from wordloom.operators.indexing import Index, build_index
from wordloom.operators.results import attach_texts
from wordloom.plans.ingest import index_texts, ingest_corpus
from wordloom.plans.matching import match_all
from wordloom.plans.search import search, search_any_position, search_phrase, search_word
from wordloom.sources.index import (
    append_index,
    compact_index,
    create_index,
    optimize_index,
    read_index,
    refresh_document_frequency,
    write_index,
)
from wordloom.streaming.append import stream_index

__all__ = [
    "Index",
    "append_index",
    "attach_texts",
    "build_index",
    "compact_index",
    "create_index",
    "index_texts",
    "ingest_corpus",
    "match_all",
    "optimize_index",
    "read_index",
    "refresh_document_frequency",
    "search",
    "search_any_position",
    "search_phrase",
    "search_word",
    "stream_index",
    "write_index",
]
