"""JSON documents around a model call and around a DOI lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litspark.functions.text import as_col


def _object(**members: Column) -> Column:
    """JSON object of the members that are not null."""
    return F.struct(*[value.alias(name) for name, value in members.items()])


def _extra(**members: Column) -> Column:
    """Nested object, null (so that it is left out) where all members are null."""
    return F.when(F.coalesce(*[m.cast("string") for m in members.values()]).isNotNull(), _object(**members))


def provider_request(provider: Column | str = "provider_name") -> Column:
    """Parameters of one call in the names its provider uses; nulls are left out."""
    provider = F.lower(as_col(provider))
    common = {"temperature": F.col("temperature"), "top_p": F.col("top_p")}
    max_tokens = F.col("max_tokens")
    shapes = {
        "openai": _object(**common, max_completion_tokens=max_tokens, seed=F.col("openai_seed")),
        "ollama": _object(
            **common,
            extra_body=_extra(
                num_ctx=F.col("ollama_context_window"),
                num_predict=max_tokens,
                repeat_penalty=F.col("ollama_repeat_penalty"),
            ),
        ),
        "vllm": _object(
            **common,
            max_tokens=max_tokens,
            extra_body=_extra(min_p=F.col("vllm_min_p"), best_of=F.col("vllm_best_of")),
        ),
        "gemini": _object(
            **common,
            max_tokens=max_tokens,
            extra_body=_extra(thinking_level=F.col("gemini_thinking_level")),
        ),
    }
    request = F.to_json(_object(**common))
    for name, shape in shapes.items():
        request = F.when(provider == name, F.to_json(shape)).otherwise(request)
    return request


def raw_response(body: Column | str) -> Column:
    """A backend's whole answer as a variant; null unless it is a JSON object."""
    parsed = F.try_parse_json(as_col(body))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def response_payload(raw: Column, provider: Column | str = "provider") -> Column:
    """The document kept per call: request, answer, status and the raw answer."""
    return F.to_json(
        F.struct(
            F.col("model_name").alias("model"),
            as_col(provider).alias("provider"),
            F.col("prompt"),
            F.col("profile_name").alias("profile"),
            F.col("response_text"),
            F.col("usage_tokens"),
            F.col("status"),
            F.col("timestamp"),
            raw.alias("raw_response"),
        ),
        {"ignoreNullFields": "false"},
    )


def parse_resolution(body: Column | str) -> Column:
    """Struct of PDF URL and outcome of a DOI lookup: ``ok``, ``no_oa``, ``no_pdf``, ``bad_json``."""
    body = as_col(body)
    location = F.get_json_object(body, "$.best_oa_location")
    pdf_url = F.nullif(F.get_json_object(body, "$.best_oa_location.url_for_pdf"), F.lit(""))
    is_object = F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT")
    outcome = (
        F.when(~F.coalesce(is_object, F.lit(False)), F.lit("bad_json"))
        .when(location.isNull() | location.isin("", "{}", "[]", "false", "0"), F.lit("no_oa"))
        .when(pdf_url.isNull(), F.lit("no_pdf"))
        .otherwise(F.lit("ok"))
    )
    return F.struct(F.when(outcome == "ok", pdf_url).alias("pdf_url"), outcome.alias("outcome"))
