"""The tables of a data folder in the shapes the operators take."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import schemas
from litspark.functions.filenames import structured_filename
from litspark.functions.text import as_col, once
from litspark.sources.readers import file_parts

# Stated, not inferred: inference reads file footers in a job of its own per read.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

MODELS = [
    ("llama3:8b", "Ollama", "", 0),
    ("mixtral/8x7", "vllm", "", 1),
    ("gpt-x", "openai", "", 2),
    ("gem-pro", "gemini", "", 3),
]
# Columns of ALL_PARAMS after provider and model name, then the row order.
PARAMS = [
    ("ollama", "llama3:8b", "base", 0.7, 0.9, 256, 4096, 1.1, None, None, None, None, 0),
    ("ollama", "llama3:8b", "cold", 0.0, 1.0, None, None, None, None, None, None, None, 1),
    ("vllm", "mixtral/8x7", "base", 0.5, 0.8, 128, None, None, 0.05, 2, None, None, 2),
    ("openai", "gpt-x", "base", 0.2, None, 512, None, None, None, None, 42, None, 3),
    ("gemini", "gem-pro", "base", None, 0.95, 64, None, None, None, None, None, "low", 4),
    ("openai", "unlisted", "base", 0.2, 1.0, 512, None, None, None, None, 1, None, 5),
]
PROMPTS = [
    ("prompt01", "Summarize {{ title }} ({{id}}):\n{{ abstract }}\nKeep {{ tone }}."),
    ("prompt02", "Is {{title}} relevant?"),
]
PROVIDERS = ["ollama", "vllm", "openai", "gemini"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}.parquet")


def stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table as a stream, one file or a folder of part files.

    A stream's path must be a folder or a pattern; the braces make it a pattern that fits this table alone.
    """
    return spark.readStream.schema(TABLES[table]).parquet(f"{folder}/{{{table}}}.parquet")


def _every(n: int, rest: int = 0, column: str = "doc_id") -> Column:
    return F.col(column) % n == rest


def title_and_abstract() -> tuple[Column, Column]:
    """First line and the rest of a document."""
    text = F.col("text")
    end = F.instr(text, "\n")
    return F.substring_index(text, "\n", 1), F.when(end > 0, F.substr(text, end + 1))


def author_list() -> Column:
    """Two authors; the first has no name on some rows."""
    first = F.when(~_every(17), F.concat(F.lit("Ada Q"), (F.col("doc_id") % 13).cast("string")))
    return F.array(first, F.concat(F.lit("Bo "), F.col("source")))


def publication_columns(df: DataFrame) -> DataFrame:
    title, rest = title_and_abstract()
    doi = F.concat(F.lit("10.1/AbC"), (F.col("doc_id") % 187).cast("string"))
    return df.withColumns(
        {
            "title": title,
            "abstract": F.when(~_every(5), rest),
            "names": author_list(),
            "doi": F.when(~_every(3), F.when(_every(2), F.lower(doi)).otherwise(doi)),
            "year": F.when(~_every(11), (2015 + F.col("doc_id") % 11).cast("int")),
        }
    )


def publications(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as the records of 20 searches, with ``search_id`` and the row order ``ord``."""
    docs = publication_columns(read(spark, folder, "documents"))
    last_name = F.try_element_at(
        F.split(F.coalesce(F.get("names", F.lit(0)), F.get("names", F.lit(1))), " "), F.lit(-1)
    )
    return docs.select(
        F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("search_engine_internal_id"),
        "year",
        "title",
        F.array_join("names", "; ").alias("authors"),
        "abstract",
        _every(4).alias("isOpenAccess"),
        "doi",
        F.col("lang").alias("language"),
        (F.col("n_chars") % 100).cast("int").alias("citationCount"),
        (F.col("n_chars") % 7).cast("int").alias("referenceCount"),
        F.when(_every(2), schemas.SOURCE_ENGINE_1)
        .otherwise(schemas.SOURCE_ENGINE_2)
        .alias("entry_source"),
        structured_filename("year", last_name, "title", "doi").alias("pdf_filename"),
        F.lit(None).cast("string").alias("txt_filename"),
        F.lit(None).cast("string").alias("markdown_filename"),
        _every(7).alias("pdf_downloaded"),
        F.col("source").alias("search_id"),
        F.col("doc_id").alias("ord"),
    )


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Names of files: PDFs, texts and Markdown of records, and PDFs no record lists."""
    name = F.col("pdf_filename")
    stem = F.regexp_replace(name, r"\.pdf$", "")
    files = F.array(
        F.when(_every(2, column="ord"), name),
        F.when(_every(6, column="ord"), F.concat(stem, F.lit(".txt"))),
        F.when(_every(10, column="ord"), F.concat(stem, F.lit(".md"))),
        F.when(
            _every(50, column="ord"), F.format_string("extra_%d.pdf", F.col("ord"))
        ),
        F.when(
            _every(100, column="ord"), F.format_string("extra_%d.txt", F.col("ord"))
        ),
    )
    rows = publications(spark, folder).select(F.explode(files).alias("file_name"))
    return file_parts(rows.where("file_name is not null"))


def resolutions(spark: SparkSession, folder: str) -> DataFrame:
    """One lookup answer per DOI: without location, without URL, broken, or with a URL."""
    dois = publications(spark, folder).select("doi").where("doi is not null").distinct()
    number = F.regexp_extract("doi", r"(\d+)$", 1).cast("int")
    url = F.concat(F.lit('"https://files.example.org/'), number.cast("string"), F.lit('.pdf"'))
    answer = (
        F.when(number % 5 == 0, F.lit('{"best_oa_location": null}'))
        .when(number % 5 == 1, F.lit('{"best_oa_location": {"url_for_pdf": null}}'))
        .when(number % 10 == 2, F.lit("<html>busy</html>"))
        .otherwise(F.concat(F.lit('{"best_oa_location": {"url_for_pdf": '), url, F.lit("}}")))
    )
    return dois.select("doi", answer.alias("response"))


def failed_fetches(spark: SparkSession, folder: str) -> DataFrame:
    return publications(spark, folder).where(_every(23, 1, "ord")).select("ord")


def data(spark: SparkSession, folder: str) -> DataFrame:
    title, rest = title_and_abstract()
    return read(spark, folder, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("ID"),
        title.alias("Title"),
        rest.alias("Abstract"),
    )


def mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with one or two prompts, plus ids that lead nowhere."""
    number = F.col("doc_id").cast("string")
    own = F.concat(F.lit(" D"), number)

    def entry(k: int, data_id: Column, prompt: str) -> Column:
        return F.struct(
            data_id.alias("data_id"),
            F.lit(prompt).alias("prompt_id"),
            (F.col("doc_id") * 10 + k).alias("ord"),
        )

    entries = F.array(
        entry(0, own, "prompt01 "),
        F.when(_every(2), entry(1, own, "prompt02")),
        F.when(_every(97), entry(2, F.concat(F.lit("X"), number), "prompt01")),
        F.when(_every(97), entry(3, own, "prompt99")),
    )
    rows = read(spark, folder, "documents").select(F.explode(entries).alias("e"))
    return rows.where("e is not null").select("e.*")


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table whose size Spark knows (rows of Python objects would have none)."""
    names = [field.split()[0] for field in schema.split(", ")]
    typed = pa.table([pa.array(column) for column in zip(*rows, strict=True)], names=names)
    fields = [f.split() for f in schema.split(", ")]
    return spark.createDataFrame(typed).select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def prompts(spark: SparkSession) -> DataFrame:
    return _local(spark, PROMPTS, "prompt_id string, template string")


def models(spark: SparkSession) -> DataFrame:
    return _local(spark, MODELS, "name string, provider string, notes string, ord bigint")


def params(spark: SparkSession) -> DataFrame:
    columns = ", ".join(f"{c} {schemas.EXPERIMENT_TYPES[c]}" for c in schemas.ALL_PARAMS)
    return _local(spark, PARAMS, f"provider string, model_name string, {columns}, ord bigint")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_columns(read(spark, folder, "events"))


def run_columns(events: DataFrame) -> DataFrame:
    """Events as finished, failed and open runs."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("ID"),
        "ts",
        F.get(F.lit(PROVIDERS), (F.col("user_id") % 4).cast("int")).alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_name"),
        F.when(kind.isin("click", "purchase"), "success")
        .when(kind == "error", "Error: boom")
        .alias("status"),
        F.when(kind == "view", "running").alias("state"),
        F.when(~_every(10, column="event_id"), (F.col("event_id") % 1000).cast("int")).alias(
            "total_tokens"
        ),
        (F.col("event_id") % 500).cast("int").alias("usage_tokens"),
        F.col("value").alias("elapsed_seconds"),
    )


def experiment_rows(documents: DataFrame) -> DataFrame:
    """Documents as experiment rows, one per document; works on a stream as well."""
    which = (F.col("doc_id") % 4).cast("int")

    def by_provider(*values) -> Column:
        cases = F.when(which == 0, values[0])
        for i, value in enumerate(values[1:], start=1):
            cases = cases.when(which == i, value)
        return cases

    provider = F.get(F.lit(PROVIDERS), which)
    model = F.get(F.lit([m[0] for m in MODELS]), which)
    code = F.concat_ws("_", F.concat(F.lit("D"), F.col("doc_id").cast("string")), F.lit("prompt01"), model, F.lit("base"))
    return documents.select(
        provider.alias("provider"),
        (F.col("doc_id") + 1).alias("ID"),
        code.alias("code"),
        model.alias("model_name"),
        provider.alias("provider_name"),
        F.col("text").alias("prompt"),
        F.lit("base").alias("profile_name"),
        by_provider(0.7, 0.5, 0.2, None).cast("double").alias("temperature"),
        by_provider(0.9, 0.8, None, 0.95).cast("double").alias("top_p"),
        by_provider(256, None, 512, 64).cast("int").alias("max_tokens"),
        F.when((which == 0) & ~_every(3), 4096).alias("ollama_context_window"),
        F.when((which == 0) & ~_every(3), F.lit(1.1)).cast("double").alias("ollama_repeat_penalty"),
        F.when((which == 1) & _every(3), F.lit(0.05)).cast("double").alias("vllm_min_p"),
        F.when((which == 1) & _every(3), 2).alias("vllm_best_of"),
        F.when(which == 2, 42).alias("openai_seed"),
        F.when((which == 3) & ~_every(3), "low").alias("gemini_thinking_level"),
        F.when(_every(6), "success").when(_every(6, 1), "Error: before").alias("status"),
        F.lit(None).cast("string").alias("state"),
        F.when(_every(6), "kept").alias("response_text"),
        F.when(_every(6), 7).alias("usage_tokens"),
        F.when(_every(6), 7).alias("total_tokens"),
        F.when(_every(6) | _every(6, 1), 1).alias("call_count"),
    )


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as document files: some hold nothing but tags, some are not valid text."""
    content = (
        F.when(_every(20, column="page_id"), F.encode(F.lit("<p> </p>"), "UTF-8"))
        .when(_every(20, 5, "page_id"), F.concat(F.unhex(F.lit("FF")), F.encode("html", "UTF-8")))
        .otherwise(F.encode("html", "UTF-8"))
    )
    return read(spark, folder, "pages").select(
        F.format_string("page_%d.pdf", F.col("page_id")).alias("file_name"),
        content.alias("content"),
        F.col("page_id"),
    )


def extracted_files(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory of the page files: the PDFs and what was extracted before."""
    n = F.col("page_id")
    names = F.array(
        F.format_string("page_%d.pdf", n),
        F.when(_every(4, 3, "page_id"), F.format_string("page_%d.txt", n)),
        F.when(_every(9, column="page_id"), F.format_string("page_%d.md", n)),
    )
    rows = read(spark, folder, "pages").select(F.explode(names).alias("file_name"))
    return rows.where("file_name is not null")


def dialogue(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """User turns as rows, assistant turns as the results of the turn before them."""
    turns = read(spark, folder, "conversations")
    row_id = F.col("conv_id") * 1000
    asked = turns.where("role = 'user'").select(
        F.lit("chat").alias("provider"),
        (row_id + F.col("turn")).alias("ID"),
        F.col("text").alias("prompt"),
        F.lit(None).cast("string").alias("response_text"),
        F.lit(None).cast("string").alias("status"),
    )
    answered = turns.where("role = 'assistant'").select(
        F.lit("chat").alias("provider"),
        (row_id + F.col("turn") - 1).alias("ID"),
        F.col("text").alias("response_text"),
        F.lit("success").alias("status"),
    )
    return asked, answered


def landed_pages(spark: SparkSession, folder: str, engine: int) -> DataFrame:
    """Documents as response pages of 100 works, one JSON text per page."""
    page = F.floor(F.col("doc_id") / 100).alias("page_no")
    # The works of a page come together first, as plain texts; the pages are built there.
    docs = read(spark, folder, "documents").select("*", page).repartition("page_no")
    docs = publication_columns(docs)
    doc_id = F.col("doc_id")
    if engine == 1:
        work = F.struct(
            F.concat(F.lit("P"), doc_id.cast("string")).alias("paperId"),
            "title",
            F.transform("names", lambda n: F.struct(n.alias("name"))).alias("authors"),
            "abstract",
            _every(4).alias("isOpenAccess"),
            F.struct(F.col("doi").alias("DOI")).alias("externalIds"),
            "year",
            (F.col("n_chars") % 7).cast("int").alias("referenceCount"),
            (F.col("n_chars") % 100).cast("int").alias("citationCount"),
        )
        rows = docs.select(doc_id, "page_no", F.to_json(work).alias("json"))
    else:
        prefix = F.get(F.lit(["https://doi.org/", "HTTP://DOI.ORG/", "doi.org/", ""]), (doc_id % 4).cast("int"))
        work = F.struct(
            F.concat(F.lit("https://openalex.org/W"), doc_id.cast("string")).alias("id"),
            F.col("title").alias("display_name"),
            F.col("year").alias("publication_year"),
            F.concat(prefix, F.col("doi")).alias("doi"),
            F.transform(
                "names", lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))
            ).alias("authorships"),
            F.struct(_every(4).alias("is_oa")).alias("open_access"),
            F.when(
                ~_every(13), F.array_repeat(F.lit("W1"), (doc_id % 7).cast("int"))
            ).alias("referenced_works"),
            (F.col("n_chars") % 100).cast("int").alias("cited_by_count"),
        )
        index = F.concat(F.lit('{"abstract_inverted_index":'), inverted_index("abstract"), F.lit(","))
        json = F.concat(F.coalesce(index, F.lit("{")), F.substr(F.to_json(work), F.lit(2)))
        rows = docs.select(doc_id, "page_no", json.alias("json"))
    # A page holds at most 100 works: the ids are unique.
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", "json")))
    works = F.array_join(F.transform(ordered, lambda w: w["json"]), ",")
    field = "data" if engine == 1 else "results"
    return rows.groupBy("page_no").agg(works.alias("works")).select(
        "page_no",
        F.concat(
            F.lit('{"page_no": '),
            F.col("page_no").cast("string"),
            F.lit(f', "{field}": ['),
            F.col("works"),
            F.lit("]}"),
        ).alias("value"),
    )


def inverted_index(abstract: Column | str) -> Column:
    """Word -> positions of a text as JSON: sorted words, a new list where a new word starts.

    The text is escaped as a whole, which neither joins words nor makes different ones equal; the members
    are joined as texts. A map of them would be built entry by entry and then written as JSON.
    """
    abstract = as_col(abstract)
    # Without the brackets and quotes around it.
    escaped = F.to_json(F.array(abstract))
    words = F.split(F.substr(escaped, F.lit(3), F.length(escaped) - 4), " ")
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))

    def members(p: Column) -> Column:
        def member(x: Column, k: Column) -> Column:
            known = x["word"] == F.get(p, k - 1)["word"]
            opened = F.concat(F.lit('],"'), x["word"], F.lit('":['), x["pos"].cast("string"))
            return F.when(known, F.concat(F.lit(","), x["pos"].cast("string"))).otherwise(opened)

        return F.array_join(F.transform(p, member), "")

    # The first member has nothing to close.
    index = F.concat(F.lit("{"), F.substr(once(placed, members), F.lit(3)), F.lit("]}"))
    return F.when(abstract.isNotNull(), index)


def parse_pages(landed: DataFrame, engine: int) -> DataFrame:
    schema = schemas.PAGE_ENGINE_1 if engine == 1 else schemas.PAGE_ENGINE_2
    page = F.from_json("value", f"page_no bigint, {schema}")
    return landed.select(page.alias("p")).select("p.*")


def write_files(files: DataFrame, folder: str) -> None:
    """A file per row of ``name, content``, written by the tasks; a name may lead through folders."""

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                path = f"{base}/{name.as_py()}"
                within = path.rpartition("/")[0]
                if within not in made:
                    store.create_dir(within, recursive=True)
                    made.add(within)
                with store.open_output_stream(path) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    files.select("name", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
