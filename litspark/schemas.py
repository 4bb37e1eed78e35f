"""Column lists and schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, order, types and labels of the tables this library exchanges.
RECORD = T.StructType(
    [
        T.StructField("search_engine_internal_id", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("isOpenAccess", T.BooleanType()),
        T.StructField("doi", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("citationCount", T.IntegerType()),
        T.StructField("referenceCount", T.IntegerType()),
        T.StructField("entry_source", T.StringType()),
        T.StructField("pdf_filename", T.StringType()),
        T.StructField("txt_filename", T.StringType()),
        T.StructField("markdown_filename", T.StringType()),
        T.StructField("pdf_downloaded", T.BooleanType()),
    ]
)
RECORD_COLUMNS = RECORD.fieldNames()

SOURCE_ENGINE_1 = "Semantic Scholar"
SOURCE_ENGINE_2 = "OpenAlex"
SOURCE_MANUAL = "manually added"

DEFAULT_YEARS = "2020-2025"
DEFAULT_OPEN_ACCESS = False

IDENTITY_COLUMNS = [
    "ID",
    "code",
    "prompt",
    "tokens_estimate",
    "original_data",
    "model_name",
    "provider_name",
]
COMMON_PARAMS = ["profile_name", "temperature", "top_p", "max_tokens"]
PROVIDER_PARAMS = {
    "ollama": ["ollama_context_window", "ollama_repeat_penalty"],
    "vllm": ["vllm_min_p", "vllm_best_of"],
    "openai": ["openai_seed"],
    "gemini": ["gemini_thinking_level"],
}
HASH_COLUMNS = ["prompt_hash", "original_data_hash"]

EXPERIMENT_TYPES = {
    "ID": "bigint",
    "code": "string",
    "prompt": "string",
    "tokens_estimate": "int",
    "original_data": "string",
    "model_name": "string",
    "provider_name": "string",
    "profile_name": "string",
    "temperature": "double",
    "top_p": "double",
    "max_tokens": "int",
    "ollama_context_window": "int",
    "ollama_repeat_penalty": "double",
    "vllm_min_p": "double",
    "vllm_best_of": "int",
    "openai_seed": "int",
    "gemini_thinking_level": "string",
    "response_text": "string",
    "usage_tokens": "int",
    "status": "string",
    "state": "string",
    "call_count": "int",
    "total_tokens": "int",
    "elapsed_seconds": "double",
    "timestamp": "timestamp",
    "response_json": "string",
    "prompt_hash": "string",
    "original_data_hash": "string",
}
RESULT_COLUMNS = [
    "response_text",
    "usage_tokens",
    "status",
    "state",
    "call_count",
    "total_tokens",
    "elapsed_seconds",
    "timestamp",
    "response_json",
]
# End of fixed values.

ALL_PARAMS = COMMON_PARAMS + [c for cols in PROVIDER_PARAMS.values() for c in cols]
EXPERIMENT_COLUMNS = IDENTITY_COLUMNS + ALL_PARAMS + RESULT_COLUMNS + HASH_COLUMNS

# DDL strings: they need no running session.
PAGE_ENGINE_1 = (
    "data array<struct<paperId: string, title: string, authors: array<struct<name: string>>, "
    "abstract: string, isOpenAccess: boolean, externalIds: struct<DOI: string>, year: int, "
    "referenceCount: int, citationCount: int>>, token string, total bigint"
)
PAGE_ENGINE_2 = (
    "results array<struct<id: string, display_name: string, publication_year: int, doi: string, "
    "authorships: array<struct<author: struct<display_name: string>>>, "
    "open_access: struct<is_oa: boolean>, abstract_inverted_index: map<string, array<int>>, "
    "referenced_works: array<string>, cited_by_count: int>>, "
    "meta struct<count: bigint, next_cursor: string>"
)
SEARCH_CONFIG = "search_id string, query string, year string, onlyOpenAccess boolean"


def provider_columns(provider: str) -> list[str]:
    """Columns of one provider's table, in order."""
    extra = PROVIDER_PARAMS.get(provider.lower(), [])
    return IDENTITY_COLUMNS + COMMON_PARAMS + extra + RESULT_COLUMNS + HASH_COLUMNS
