"""Table layouts and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Collections, and the search tool that reads each.
COLLECTIONS = ("code", "docs", "tests", "tutorials")
TOOLS = {
    "search_codebase": "code",
    "search_docs": "docs",
    "search_tests": "tests",
    "search_tutorials": "tutorials",
}

# Chunk window and result counts.
CHUNK_TOKENS = 512
CHUNK_OVERLAP = 64
DEFAULT_RESULTS = 5
MAX_RESULTS = 20
MIN_PAGE_CHARS = 100
DEFAULT_PRIORITY = 99
DEFAULT_MAX_PRIORITY = 2

METADATA = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "file_path", "url", "title", "source", "repo", "branch",
        "language", "format", "doc_type", "category",
    )]
    + [T.StructField("priority", T.IntegerType())]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("collection", T.StringType()),
        T.StructField("doc_key", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
    + METADATA.fields
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("doc_key", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("content_hash", T.StringType()),
    ]
    + METADATA.fields
    + [
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embed_model", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

REGISTRY_ENTRY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("priority", T.IntegerType()),
])

FILES = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("content", T.BinaryType()),
])
