"""One query per operator or group of operators, over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark import schemas
from litspark.functions import filenames, language_model, requests, templates, text
from litspark.functions.language import detect_language, detect_text
from litspark.operators import curate, inference, inventory, ledger, many, search, selection, stats, text_index
from litspark.operators.extract import extract_text
from litspark.operators.offline import connect_dying, connect_offline, html_pages
from litspark.plans import bindings as b
from litspark.plans import experiment
from litspark.session import materialize, work_dir
from litspark.sources import listing, pages, readers, split_text, versions, writers
from litspark.streaming import state, streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

CHAIN = {
    "language": "de",
    "source": schemas.SOURCE_ENGINE_2,
    "doi": "10.1/abc8",
    "downloaded": True,
}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# Curation


@query
def merge_searches(spark: SparkSession, folder: str) -> DataFrame:
    return curate.newest_first(curate.merge_searches(b.publications(spark, folder)))


@query
def merge_filtered(spark: SparkSession, folder: str) -> DataFrame:
    kept = curate.exclude(b.publications(spark, folder), language="fr")
    return curate.newest_first(curate.merge_searches(kept, role="filtered"))


@query
def dedup_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = b.publications(spark, folder)
    return rows.select(
        F.col("ord").alias("doc_id"),
        text.dedup_key().alias("dedup_key"),
        text.is_missing("doi").alias("no_doi"),
        text.normalize_text("title").alias("title_norm"),
    )


@query
def exclude_chain(spark: SparkSession, folder: str) -> DataFrame:
    kept = curate.exclude(b.publications(spark, folder), **CHAIN)
    return kept.select(F.col("ord").alias("doc_id"), "search_id", "language", "doi")


@query
def exclude_audit(spark: SparkSession, folder: str) -> DataFrame:
    return curate.exclude_audit(b.publications(spark, folder), **CHAIN)


@query
def exclude_again(spark: SparkSession, folder: str) -> DataFrame:
    """A second run reads the filtered rows of the searches that have some."""
    results = b.publications(spark, folder)
    before = results.where("search_id < 'src15'")
    filtered = curate.exclude(before, language="en")
    done = curate.list_searches_of(before)
    rows = curate.exclude(curate.latest_rows(results, filtered, done), language="fr")
    return rows.select(F.col("ord").alias("doc_id"), "search_id", "language")


@query
def keep_downloaded(spark: SparkSession, folder: str) -> DataFrame:
    kept = curate.exclude(b.publications(spark, folder), downloaded=True)
    return kept.select(F.col("ord").alias("doc_id"), "pdf_filename")


@query
def combine_engines(spark: SparkSession, folder: str) -> DataFrame:
    rows = b.publications(spark, folder)
    first = rows.where(F.col("entry_source") == schemas.SOURCE_ENGINE_1)
    second = rows.where(F.col("entry_source") == schemas.SOURCE_ENGINE_2)
    combined = curate.combine_new(first, second)
    return combined.select(F.col("ord").alias("doc_id"), "doi", "title", "is_new")


# Search


KEYWORDS = '(the + "of the") | (que -"de la") | und'


@query
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search.keyword_filter(b.publications(spark, folder), KEYWORDS)
    return found.select(F.col("ord").alias("doc_id"), "title")


@query
def year_oa_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search.year_filter(b.publications(spark, folder), "2017-2021", only_open_access=True)
    return found.select(F.col("ord").alias("doc_id"), "year", "isOpenAccess")


@query
def limited_search(spark: SparkSession, folder: str) -> DataFrame:
    found = search.search_corpus(b.publications(spark, folder), "the | la", "2016-2024", limit=150)
    return found.select(F.col("ord").alias("doc_id"), "year")


@query
def exclude_emptied(spark: SparkSession, folder: str) -> DataFrame:
    """A search whose rows were all excluded before stays empty."""
    results = b.publications(spark, folder)
    before = results.where("search_id = 'src3'")
    emptied = curate.exclude(before, language="en").where("false")
    rows = curate.latest_rows(results, emptied, curate.list_searches_of(before))
    return rows.groupBy("search_id").agg(F.count("*").alias("papers"))


@query
def search_truncated(spark: SparkSession, folder: str) -> DataFrame:
    """A search under quotas: how many rows come back, and whether the quota cut them."""
    results, out = b.publications(spark, folder), []
    for cap, limit in ((100, None), (100, 50), (1 << 30, None)):
        rows, cut = search.capped_search(results, cap, "the | la", "2016-2024", limit=limit)
        counted = rows.agg(F.count("*").alias("papers"))
        out.append(counted.join(cut).select(F.lit(cap).cast("bigint").alias("cap"), F.lit(limit).cast("int").alias("max_rows"), "papers", "truncated"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def phrase_search(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases with marks in them, groups, and a term that is only a mark."""
    found = search.keyword_filter(b.publications(spark, folder), '("of-the" | "de - la") -(und + der) *')
    return found.select(F.col("ord").alias("doc_id"))


@query
def selected_half(spark: SparkSession, folder: str) -> DataFrame:
    """The newer half of all records, found by counting ranges; no task holds more than its share."""
    rows = materialize(b.publications(spark, folder).select("year", "title", "ord"))
    order = [selection.By("year", descending=True), selection.By("title"), selection.By("ord")]
    half = rows.count() // 2
    return selection.first_rows(rows, order, half, ranges=16).select(F.col("ord").alias("doc_id"), "year")


def _many_searches(spark: SparkSession, folder: str) -> DataFrame:
    """Every record in three of 5,000 searches."""
    n = F.col("ord")
    ids = F.array(*[F.format_string("s%04d", F.pmod(n * k, F.lit(5000))) for k in (1, 37, 1009)])
    return b.publications(spark, folder).withColumn("search_id", F.explode(ids))


@query
def merge_5000_searches(spark: SparkSession, folder: str) -> DataFrame:
    """5,000 searches merged: membership as rows, counters and first values beside it."""
    rows = _many_searches(spark, folder)
    merged, membership = many.merge_many(rows, many.number_searches(rows))
    shown = merged.select("number", "merge_key", "title", "pdf_filename", "duplicates_counter")
    return membership.join(shown, "number").drop("number")


@query
def searches_together(spark: SparkSession, folder: str) -> DataFrame:
    """What groups of ten among 5,000 searches have found, any or all of them, from their bitmaps."""
    rows = _many_searches(spark, folder)
    searches = many.number_searches(rows)
    _, membership = many.merge_many(rows, searches)
    maps = many.add_bitmaps(*(many.bitmaps(membership.where(F.col("number") % 2 == k)) for k in (0, 1)))
    group = F.substring("search_id", 1, 4)
    return many.together(maps, searches.select(group.alias("name"), "search_id"))


@query
def listed_by_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Folders of documents by language and source, listed by tasks and by Spark's own reader."""
    base = f"{work_dir(spark)}/tree"
    docs = b.read(spark, folder, "documents").select("lang", "source", "text")
    docs.repartition("lang", "source").write.partitionBy("lang", "source").json(base)
    found = listing.list_files(spark, [base], recursive=True, per_task=5)
    usual = readers.read_file_inventory(spark, base, recursive=True)
    # The reader tells a path with other slashes before it.
    plain = F.regexp_replace("path", "^file:/+", "/")
    both = found.select(plain.alias("path"), "length", F.lit(1).alias("by_tasks"), F.lit(0).alias("by_spark")).unionAll(
        usual.select(plain, "length", F.lit(0), F.lit(1))
    )
    same = both.groupBy("path", "length").agg(F.sum("by_tasks").alias("by_tasks"), F.sum("by_spark").alias("by_spark"))
    place = F.split(F.regexp_extract("path", "(lang=[^/]*/source=[^/]*)/", 1), "/")
    return same.groupBy(place[0].alias("lang"), place[1].alias("source")).agg(
        F.bool_and((F.col("by_tasks") == 1) & (F.col("by_spark") == 1)).alias("same")
    )


INDEXED = {
    "keywords": KEYWORDS,
    "phrases": '("of-the" | "de - la") -(und + der) *',
    "rare": '"the of" | "la de la"',
    "without": "-the -la NOT (und OR de)",
    "absent": "qqqq | (the qqqq)",
}


@query
def index_search(spark: SparkSession, folder: str) -> DataFrame:
    """Searches over the positional index: keywords, phrases, only NOT, words that stand nowhere."""
    path = f"{work_dir(spark)}/index"
    text_index.build(b.publications(spark, folder), path, "ord")
    found = text_index.row_ids(spark, path, text_index.search_index(spark, path, INDEXED))
    return found.select("query", F.col("ord").alias("doc_id"))


@query
def query_notation(spark: SparkSession, folder: str) -> DataFrame:
    """Titles read as queries, and years as ranges."""
    rows = b.publications(spark, folder)
    words = F.split(F.regexp_replace("title", r"[^\p{L} ]", ""), " ")
    written = F.concat_ws("", F.lit("-"), F.array_join(words, " + -"), F.lit(" | state-of-art"))
    span = F.concat_ws("-", "year", F.when(F.col("ord") % 2 == 0, F.col("year") + 3))
    return rows.select(
        F.col("ord").alias("doc_id"),
        text.translate_query(written).alias("translated"),
        text.year_range(span)["from"].alias("year_from"),
        text.year_range(span)["to"].alias("year_to"),
    )


@query
def search_configs(spark: SparkSession, folder: str) -> DataFrame:
    return readers.search_config_defaults(_configs(spark, folder))


def _configs(spark: SparkSession, folder: str) -> DataFrame:
    """A config per search; some leave out the year or the open-access flag."""
    n = F.regexp_extract("search_id", r"(\d+)", 1).cast("int")
    per_search = b.publications(spark, folder).groupBy("search_id").agg(F.min("title").alias("query"))
    return per_search.select(
        "search_id",
        "query",
        F.when(n % 3 != 0, F.lit("2019-2023")).alias("year"),
        F.when(n % 2 != 0, F.lit(True)).alias("onlyOpenAccess"),
    )


# Response pages


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in schemas.RECORD_COLUMNS if c not in ("txt_filename", "markdown_filename")])


@query
def flatten_engine1(spark: SparkSession, folder: str) -> DataFrame:
    landed = b.landed_pages(spark, folder, 1)
    return _flat(pages.flatten_s2_pages(b.parse_pages(landed, 1)))


def _land(spark: SparkSession, folder: str, engine: int) -> str:
    path = f"{work_dir(spark)}/landed"
    b.landed_pages(spark, folder, engine).select("value").write.text(path)
    return path


@query
def raw_pages_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to the raw zone and read back."""
    path = f"{work_dir(spark)}/raw"
    writers.write_raw_pages(b.parse_pages(b.landed_pages(spark, folder, 1), 1), path)
    return _flat(pages.flatten_s2_pages(pages.read_pages(spark, path, 1)))


@query
def raw_pages_array(spark: SparkSession, folder: str) -> DataFrame:
    """Files that hold one indented array of pages each, 20 pages at most: more pages are more files."""
    path = f"{work_dir(spark)}/arrays"
    landed = b.landed_pages(spark, folder, 1)
    joined = F.array_join(F.collect_list("value"), ",\n  ")
    files = landed.groupBy(F.floor(F.col("page_no") / 20)).agg(F.concat(F.lit("[\n  "), joined, F.lit("\n]")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _flat(pages.flatten_s2_pages(pages.read_pages(spark, path, 1, layout="array")))


@query
def raw_pages_broken(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of which every third is broken: works read, and pages set aside."""
    base = work_dir(spark)
    landed = b.landed_pages(spark, folder, 1)
    cut = F.substring("value", F.lit(1), F.length("value") - 7)
    landed.select(F.when(F.col("page_no") % 3 == 1, cut).otherwise(F.col("value")).alias("value")).write.text(f"{base}/in")
    good = pages.read_pages(spark, f"{base}/in", 1, rejected=f"{base}/rejected")
    works = pages.flatten_s2_pages(good).agg(F.count("*").alias("n")).select(F.lit("works").alias("kind"), "n")
    bad = spark.read.parquet(f"{base}/rejected").agg(F.count("*").alias("n")).select(F.lit("rejected").alias("kind"), "n")
    return works.unionByName(bad)


@query
def flatten_engine2(spark: SparkSession, folder: str) -> DataFrame:
    landed = b.landed_pages(spark, folder, 2)
    return _flat(pages.flatten_oa_pages(b.parse_pages(landed, 2)))


@query
def union_engines(spark: SparkSession, folder: str) -> DataFrame:
    first = pages.flatten_s2_pages(b.parse_pages(b.landed_pages(spark, folder, 1), 1))
    second = pages.flatten_oa_pages(b.parse_pages(b.landed_pages(spark, folder, 2), 2))
    both = pages.union_pages(first, second)
    return both.groupBy("entry_source", "year").agg(
        F.count("*").alias("papers"), F.sum("referenceCount").cast("bigint").alias("references")
    )


@query
def structured_filenames(spark: SparkSession, folder: str) -> DataFrame:
    rows = b.publications(spark, folder)
    return rows.select(
        F.col("ord").alias("doc_id"),
        "pdf_filename",
        filenames.sanitize_filename("doi").alias("doi_filename"),
        filenames.companion("pdf_filename", "txt").alias("txt_name"),
        text.safe_name(F.concat_ws(":", "search_id", "doi")).alias("safe"),
        text.sequence_code("P", "ord").alias("code"),
        text.format_duration(F.when(F.col("ord") % 9 != 0, F.col("ord") * 61)).alias("duration"),
    )


@query
def detect_languages(spark: SparkSession, folder: str) -> DataFrame:
    rows = b.publications(spark, folder)
    return rows.select(
        F.col("ord").alias("doc_id"), detect_language("title", "abstract").alias("detected")
    )


@query
def language_agreement(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.read(spark, folder, "documents")
    found = docs.select("lang", detect_text("text").alias("detected"))
    return found.groupBy("lang", "detected").agg(F.count("*").alias("documents"))


# Statistics


@query
def fitted_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages by a model fitted on all documents: of the whole text, and of title and abstract."""
    pubs = b.publications(spark, folder).select("ord", "title", "abstract")
    docs = b.read(spark, folder, "documents").select("doc_id", "text", "lang")
    detector = language_model.Detector(language_model.fit(docs, "text", "lang"))
    whole = detector.detect(docs, "detected", "text").select("doc_id", "lang", "detected")
    agreed = detector.detect(pubs, "agreed", "title", "abstract").select(F.col("ord").alias("doc_id"), "agreed")
    return whole.join(agreed, "doc_id")


@query
def papers_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return stats.papers_by_year(b.publications(spark, folder))


@query
def stats_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = inventory.sync(b.publications(spark, folder), b.file_inventory(spark, folder))
    return stats.by_frequency(stats.breakdown(rows))


@query
def stats_by_role(spark: SparkSession, folder: str) -> DataFrame:
    results = b.publications(spark, folder)
    filtered = curate.exclude(results, language="de")
    merged = curate.merge_searches(results).select(schemas.RECORD_COLUMNS)
    tables = [
        df.select(F.lit(role).alias("role"), *schemas.RECORD_COLUMNS)
        for role, df in (("results", results), ("filtered", filtered), ("merged", merged))
    ]
    return stats.breakdown(pages.union_pages(*tables), by=["role"])


# Files


@query
def sync_inventory(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = inventory.sync(b.publications(spark, folder), b.file_inventory(spark, folder))
    return rows.select(
        F.col("ord").alias("doc_id"),
        "pdf_downloaded",
        "txt_filename",
        "markdown_filename",
        "changed",
    )


@query
def sync_extra_files(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = inventory.sync(
        b.publications(spark, folder), b.file_inventory(spark, folder), add_extra=True
    )
    return rows.where("added").select(
        "pdf_filename", "pdf_downloaded", "entry_source", "txt_filename", "markdown_filename"
    )


@query
def sync_counts(spark: SparkSession, folder: str) -> DataFrame:
    _, counts = inventory.sync(
        b.publications(spark, folder), b.file_inventory(spark, folder), add_extra=True
    )
    return counts


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.download_plan(
        b.publications(spark, folder),
        b.resolutions(spark, folder),
        b.file_inventory(spark, folder),
        b.failed_fetches(spark, folder),
    )


@query
def download_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder).withColumnRenamed("ord", "doc_id").drop("title")


@query
def download_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return stats.outcome_counts(_plan(spark, folder))


@query
def download_failures(spark: SparkSession, folder: str) -> DataFrame:
    return writers.failure_rows(_plan(spark, folder))


@query
def resolve_filenames(spark: SparkSession, folder: str) -> DataFrame:
    """Names for pages to download: from a header, the final URL, the URL, or a fallback."""
    n = F.col("page_id")
    header = F.when(n % 3 == 0, F.format_string('inline; FileName="doc %d.PDF"; filename=x', n)).when(
        n % 3 == 1, F.lit("inline")
    )
    final = F.when(n % 2 == 0, F.concat(F.col("url"), F.lit("/a.pdf?x=1"))).otherwise(F.lit(""))
    return b.read(spark, folder, "pages").select(
        "page_id",
        filenames.resolve_pdf_filename(
            header, final, "url", F.when(n % 5 != 0, F.format_string("page_%d.pdf", n))
        ).alias("file_name"),
        filenames.resolve_pdf_filename(header, final, "url", None, F.lit("given.pdf")).alias("forced"),
    )


@query
def extract_documents(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(b.raw_documents(spark, folder), html_pages).select(
        "file_name", "text", "outcome"
    )


@query
def extract_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    plan = inventory.extract_plan(b.extracted_files(spark, folder), skip_if_md=True)
    return stats.outcome_counts(extract_text(b.raw_documents(spark, folder), html_pages, plan))


@query
def add_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Page files to copy into the folder of the records' PDFs."""
    n = F.col("page_id")
    path = F.when(n % 4 == 0, F.format_string("/in/%d/extra_%d.pdf", n, n)).otherwise(
        F.format_string("/in/page_%d.PDF", n)
    )
    sources = b.read(spark, folder, "pages").select(
        F.when(n % 7 == 0, F.lit("/in/notes.html")).otherwise(path).alias("path")
    )
    return inventory.add_plan(sources, b.file_inventory(spark, folder)).select("path", "outcome")


@query
def clean_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with image marks put between their lines, on one line and over several."""
    marks = F.when(F.col("doc_id") % 6 == 0, "\r\n  <!-- image -->  \r\n\n\n\n").when(
        F.col("doc_id") % 6 == 1, "\n![a](data:image/png;base64,AAAA==)\n<!-- image:chart -->\n"
    )
    marks = marks.when(F.col("doc_id") % 6 == 3, "\n<!--\r\nimage\n\n-->\n\n\n\n").when(
        F.col("doc_id") % 6 == 4, "\n![a\nb](data:image/png;base64,AA\nAA==)\t\n <!--image: one\n> two\n-->\n"
    )
    marked = F.replace(F.col("text"), F.lit("\n"), F.coalesce(marks, F.lit("\n")))
    docs = b.read(spark, folder, "documents")
    return docs.select("doc_id", text.clean_markdown_images(marked).alias("cleaned"))


@query
def search_list(spark: SparkSession, folder: str) -> DataFrame:
    """Searches with a flag whether a row of theirs is open access and before 2017."""
    results = search.year_filter(b.publications(spark, folder), "2015-2016", only_open_access=True)
    return inventory.list_searches(_configs(spark, folder), results).select("search_id", "has_results")


def _project_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per search a project folder with some of its input tables and snapshots."""
    n = F.col("doc_id")
    name = (
        F.when(n % 6 < 4, F.get(F.lit(list(inventory.PROJECT_INPUTS)), (n % 6).cast("int")))
        .when(n % 6 == 4, F.format_string("experiment_20260101_%02d.db", F.floor(n / 20) % 100))
        .otherwise(F.format_string("note_%d.txt", n))
    )
    return b.read(spark, folder, "documents").select(
        F.concat_ws("-", "source", "lang").alias("project"),
        name.alias("file_name"),
        F.timestamp_seconds(n * 60).alias("modificationTime"),
    )


@query
def project_list(spark: SparkSession, folder: str) -> DataFrame:
    listed = inventory.list_projects(_project_files(spark, folder))
    newest = inventory.sorted_list(listed, "created", descending=True)
    return newest.select("project", "initialized", F.unix_timestamp("created").alias("created"))


@query
def project_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.project_snapshots(_project_files(spark, folder))


@query
def next_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    files = _project_files(spark, folder)
    backups = files.select(
        F.regexp_replace("file_name", r"^experiment_(.*)\.db$", "data_backup_$1.csv").alias("file_name")
    )
    rows = [
        writers.next_snapshot(files, "20260301").select(F.lit("next").alias("kind"), "file_name"),
        writers.latest_snapshot(files).select(F.lit("latest").alias("kind"), "file_name"),
        writers.next_backup(backups, "20260101").select(F.lit("backup").alias("kind"), "file_name"),
        writers.next_backup(backups, "20260102").select(F.lit("new day").alias("kind"), "file_name"),
    ]
    return pages.union_pages(*rows)


# Experiments


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    return b.mapping(spark, folder), b.data(spark, folder), b.prompts(spark), b.models(spark), b.params(spark)


def _grid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return experiment.generate(*_inputs(spark, folder))


@query
def generate_grid(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _grid(spark, folder)
    return rows.select(
        "ID",
        "code",
        "tokens_estimate",
        "model_name",
        "provider",
        "temperature",
        "max_tokens",
        "prompt_hash",
        "original_data_hash",
    )


TEMPLATES = {
    "brief": """{# with and without abstract #}{% if abstract and year is not none -%}
Summarize "{{ title|lower|trim }}" ({{ id }}, {{ year }}):
{{ abstract }}
{%- elif not abstract %}No abstract: {{ title }}{% else %}Undated: {{ title[0] }}{{ title[-1] }}{% endif %}.
""",
    "people": """{% for a in authors.split('; ') -%}
{{ loop.index }}/{{ loop.length }} {{ a.upper() if a.startswith('Ada') else a }}{% if not loop.last %}, {% endif %}
{%- else %}nobody{% endfor %} {{ '!' if isopenaccess and year >= 2020 else '?' }} {{ tone }}""",
    "figures": "{{ (year or 2000) % 7 + referencecount * 2 }}|{{ doi|default('no DOI')|replace('10.1/', '') }}|{{ missing|default(title|length) }}|"
    "{{ 'en' in language or language == 'de' }}{% for w in missing %}never{% else %}-{% endfor %}",
}


@query
def template_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Every record under one of three templates with conditions, loops, filters and arithmetic."""
    names = F.get(F.lit(list(TEMPLATES)), (F.col("ord") % 3).cast("int"))
    data = b.publications(spark, folder).withColumn("prompt_id", names)
    prompt = templates.render_templates(data, TEMPLATES, "prompt_id", row_id="search_engine_internal_id")
    return data.select(F.col("ord").alias("doc_id"), "prompt_id", prompt.alias("prompt"))


@query
def generate_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return experiment.unmatched(b.mapping(spark, folder), b.data(spark, folder), b.prompts(spark))


@query
def grid_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids are dense, and each model has one run of them."""
    rows, _ = _grid(spark, folder)
    return rows.groupBy("model_name").agg(
        F.min("ID").alias("first_id"),
        F.max("ID").alias("last_id"),
        F.count_distinct("ID").alias("ids"),
    )


@query
def provider_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The grid stored by provider, each text once, and read back, one provider's columns."""
    path = work_dir(spark)
    experiment.write_grid(*_inputs(spark, folder), path)
    stored = experiment.read_grid(spark, path, texts=False)
    return writers.provider_view(stored, "Ollama").select(
        "ID", "code", "ollama_context_window", "ollama_repeat_penalty", "status", "prompt_hash"
    )


@query
def provider_requests(spark: SparkSession, folder: str) -> DataFrame:
    rows = b.experiment_rows(b.read(spark, folder, "documents"))
    return rows.select("ID", "provider", requests.provider_request("provider").alias("request"))


@query
def copy_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which some are there as text, some as Markdown, some as both."""
    n = F.col("doc_id")
    versions = F.array(
        F.when(n % 3 != 0, F.struct(F.lit("txt").alias("ext"), F.col("text").alias("content"))),
        F.when(n % 2 == 0, F.struct(F.lit("md").alias("ext"), F.upper("text").alias("content"))),
    )
    docs = b.read(spark, folder, "documents")
    files = docs.select("doc_id", F.explode(versions).alias("v")).where("v is not null")
    stem = F.format_string("paper%d", n)
    named = files.select(
        F.concat(stem, F.lit("."), F.col("v.ext")).alias("file_name"),
        stem.alias("stem"),
        "v.ext",
        "v.content",
    )
    return experiment.copy_papers(named)


@query
def copy_search(spark: SparkSession, folder: str) -> DataFrame:
    return experiment.copy_search(b.publications(spark, folder), ["search_id", "ord"])


# Runs


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return b.experiment_rows(b.read(spark, folder, "documents"))


RESULT_KEYS = ["provider", "ID"]
RESULT_VALUES = ["response_text", "usage_tokens", "status", "state", "call_count", "total_tokens"]


@query
def records_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as text files with a column more, one fewer and another order, read by name."""
    path = f"{work_dir(spark)}/records"
    rows = b.publications(spark, folder)
    names = [c for c in reversed(schemas.RECORD_COLUMNS) if c != "citationCount"]
    given = rows.select(F.col("ord").alias("in.merged"), *names)
    given.write.option("sep", ";").option("header", "true").option("escape", '"').csv(path)
    back = readers.read_records(spark, path, extra=True)
    return back.select(F.col("`in.merged`").cast("bigint").alias("doc_id"), "title", "year", "doi", "citationCount")


@query
def records_split(spark: SparkSession, folder: str) -> DataFrame:
    """Records written in order as ``;`` files with line ends in their cells, read back by byte ranges."""
    path = f"{work_dir(spark)}/records"
    rows = b.publications(spark, folder).withColumn("authors", F.concat(F.lit('"'), "authors", F.lit('";')))
    writers.write_records(rows.select(*schemas.RECORD_COLUMNS), path, fmt="csv")
    back = split_text.read_records_split(spark, path)
    return back.select(
        "search_engine_internal_id", "title", "year", "authors", text.sha256_hex("abstract").alias("abstract_hash")
    )


@query
def searches_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """A file per search and role, read by role; merged outputs beside them are left out."""
    base = f"{work_dir(spark)}/searches"
    rows = b.publications(spark, folder)
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(";", cell("title"), F.coalesce(F.col("year").cast("double").cast("string"), F.lit("nan")), cell("doi"), F.col("ord"))
    per_file = rows.groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    whole = F.concat(F.lit("title;year;doi;citationCount\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    roles = F.explode(F.array(F.lit("__results.csv"), F.lit("__filtered.csv"), F.lit("__merged__results.csv"))).alias("role")
    files = per_file.select("search_id", roles, whole.alias("content"))
    b.write_files(files.select(F.concat("search_id", "role").alias("name"), "content"), base)
    found = readers.read_searches(spark, base, "results").unionByName(readers.read_searches(spark, base, "filtered"))
    return found.select("search_id", "file_name", "title", "year", "doi", F.col("citationCount").alias("doc_id"))


@query
def search_config_files(spark: SparkSession, folder: str) -> DataFrame:
    """A config file per search; the name of the file stands for an id that is left out."""
    base = f"{work_dir(spark)}/configs"
    configs = _configs(spark, folder)
    own = F.when(F.col("search_id").endswith("7"), F.lit(None).cast("string")).otherwise(F.col("search_id"))
    content = F.to_json(F.struct(own.alias("search_id"), "query", "year", "onlyOpenAccess"))
    b.write_files(configs.select(F.concat("search_id", F.lit(".json")).alias("name"), content.alias("content")), base)
    return readers.read_search_configs(spark, base)


@query
def parsed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text and Markdown files, and as prompt templates, read back.

    The files are dealt to folders of about a thousand, so that no task and no driver lists them all.
    """
    base = f"{work_dir(spark)}/parsed"
    docs = b.read(spark, folder, "documents")
    within = F.pmod(F.xxhash64("doc_id"), F.lit(docs.count() // 1000 + 1))
    ending = F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")
    name = F.concat(within, F.lit("/d"), F.col("doc_id"), ending)
    b.write_files(docs.select(name.alias("name"), F.concat("text", F.lit("\n")).alias("content")), base)
    texts = listing.read_texts(listing.list_files(spark, [base], recursive=True, per_task=20))
    read = readers.parsed_documents(texts).select(
        F.lit("document").alias("kind"), "file_name", text.sha256_hex("content").alias("hash")
    )
    prompts = readers.prompt_templates(texts).select(
        F.lit("prompt"), F.col("prompt_id"), text.sha256_hex("template")
    )
    return read.unionAll(prompts)


@query
def responses_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON document per finished call, by provider, read back."""
    rows, path = _rows(spark, folder), f"{work_dir(spark)}/responses"
    kept = inference.with_response_json(rows, inference.run_experiment(rows, connect_offline))
    writers.write_responses(kept.withColumn("response_json", F.when(F.col("status") == "success", F.col("response_json"))), path)
    json = F.col("value")
    return spark.read.text(path).select(
        "provider",
        F.get_json_object(json, "$.model").alias("model"),
        F.get_json_object(json, "$.response_text").alias("response_text"),
        text.sha256_hex(F.get_json_object(json, "$.prompt")).alias("prompt_hash"),
    )


@query
def filter_log(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of two exclusion runs in one log."""
    path = f"{work_dir(spark)}/log"
    for language in ("de", "en"):
        writers.append_filter_log(curate.exclude_audit(b.publications(spark, folder), language=language), path)
    log = spark.read.parquet(path)
    return log.where("applied_at <= current_timestamp()").drop("applied_at")


@query
def guarded_writes(spark: SparkSession, folder: str) -> DataFrame:
    """A dry run, a write, one that is refused since the output is there, and one that may replace it."""
    path = f"{work_dir(spark)}/out"
    rows = b.publications(spark, folder)
    old, new = rows.where("year < 2020"), rows.where("year >= 2020")
    planned = writers.plan_counts(old=old, new=new).select(F.lit("dry run").alias("step"), "table", "rows")
    written = []
    for step, table, rewrite in (("write", old, False), ("refused", new, False), ("rewrite", new, True)):
        try:
            writers.write_records(table, path, rewrite=rewrite)
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
        n = spark.read.parquet(path).agg(F.count("*").alias("rows"))
        written.append(materialize(n.select(F.lit(step).alias("step"), F.lit("out").alias("table"), "rows")))
    return reduce(DataFrame.unionAll, written, planned)


@query
def run_single_row(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row, run again whether or not it has an answer, and the time it took."""
    rows = _rows(spark, folder)
    last = rows.agg(F.max_by("code", "ID").alias("code")).first()["code"]
    result = inference.run_one(rows, last, connect_offline)
    fast = F.col("elapsed_seconds").between(0, 60).alias("timed")
    return result.select(*RESULT_KEYS, *RESULT_VALUES, fast)


@query
def run_offline(spark: SparkSession, folder: str) -> DataFrame:
    results = inference.run_experiment(_rows(spark, folder), connect_offline)
    return results.select(*RESULT_KEYS, *RESULT_VALUES)


@query
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    results = inference.resume(_rows(spark, folder), connect_offline)
    return results.select(*RESULT_KEYS, "status", "call_count")


@query
def merge_repeated_results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows run twice, a failure before each result: one row each, the success before the failure."""
    rows = _rows(spark, folder)
    results = materialize(inference.resume(rows, connect_offline))
    failed = results.withColumns(
        {
            "status": F.lit("Error: earlier"),
            "response_text": F.lit("early"),
            "timestamp": F.col("timestamp") - F.expr("INTERVAL 1 HOUR"),
        }
    )
    merged = inference.merge_results(rows, results.unionByName(failed))
    return merged.select("code", *RESULT_KEYS, *RESULT_VALUES)


@query
def merge_results(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    results = materialize(inference.resume(rows, connect_offline))
    return inference.merge_results(rows, results).select("code", *RESULT_KEYS, *RESULT_VALUES)


@query
def run_with_lost_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """A run whose tasks die after some calls, and the run after it, which calls for the rest.

    ``repeated`` is how many rows were called again although an answer was kept.
    """
    rows, kept = _rows(spark, folder), f"{work_dir(spark)}/ledger"
    try:
        ledger.run_logged(rows, kept, connect_dying(after=30), concurrency=8, chunk_rows=8)
    except Exception as lost:
        if "TaskLost" not in str(lost):
            raise
    ledger.run_logged(rows, kept, connect_offline, concurrency=8, chunk_rows=8)
    answers = ledger.read_ledger(spark, kept)
    times = answers.groupBy(*RESULT_KEYS).agg(
        F.count("*").alias("answers"), F.max(F.col("status") == "success").alias("good")
    )
    # A failed answer of the first run is asked for again; a success never is.
    twice = times.where("good AND answers > 1").agg(F.count("*").alias("repeated"))
    merged = ledger.settled(rows, kept).select("code", *RESULT_KEYS, *[c for c in RESULT_VALUES if c != "call_count"])
    return merged.withColumn("repeated", F.lit(twice.first()[0]).cast("bigint"))


def _versioned(spark: SparkSession, folder: str) -> tuple[str, int]:
    """The experiment as a versioned table: all rows first, then the answers of each third of the ids."""
    rows, root = _rows(spark, folder), f"{work_dir(spark)}/experiment"
    rows = rows.withColumn("elapsed_seconds", F.lit(None).cast("double"))
    results = materialize(inference.resume(rows, connect_offline))
    ends = rows.agg(F.min("ID").alias("low"), F.max("ID").alias("high")).first()
    version = versions.create(rows, root, width=max((ends.high - ends.low) // 50, 1))
    third = (ends.high - ends.low) // 3 + 1
    for i in range(3):
        part = results.where(F.col("ID").between(ends.low + i * third, ends.low + (i + 1) * third - 1))
        versions.statistics(spark, root, version)
        version = versions.merge(part, root)
    return root, version


@query
def committed_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Answers merged in three steps, each a committed version; the first and the last version."""
    root, last = _versioned(spark, folder)
    shown = ["code", *RESULT_KEYS, *RESULT_VALUES]
    first, now = (versions.read_version(spark, root, n).select(F.lit(n).alias("version"), *shown) for n in (1, last))
    return first.unionByName(now)


@query
def versioned_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Run statistics kept up to date over the versions by what changed."""
    root, last = _versioned(spark, folder)
    sums = versions.statistics(spark, root, last)
    shown = ["model_name", "requests", "finished", "open", "tokens"]
    totals = stats.totals_from_sums(sums).select(
        F.lit(None).cast("string").alias("model_name"), F.col("total").alias("requests"), "finished",
        F.col("errors").alias("open"), F.col("total_tokens").alias("tokens"),
    )
    return stats.by_model_from_sums(sums).select(shown).unionByName(totals)


@query
def response_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The document per call, without its time."""
    rows = _rows(spark, folder)
    results = inference.run_experiment(rows, connect_offline)
    kept = inference.with_response_json(rows, results)
    fields = ("model", "provider", "profile", "response_text", "status")
    json = F.col("response_json")
    return kept.select(
        "ID",
        *[F.get_json_object(json, f"$.{f}").alias(f) for f in fields],
        text.sha256_hex(F.get_json_object(json, "$.prompt")).alias("prompt_hash"),
        F.get_json_object(json, "$.raw_response.size").cast("int").alias("size"),
    )


@query
def rows_with_defaults(spark: SparkSession, folder: str) -> DataFrame:
    rows = inference.with_defaults(_rows(spark, folder))
    return rows.select("ID", "response_text", "call_count", "total_tokens", "status")


@query
def rows_by_id_or_code(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    by_number = inference.pick(rows, "17")
    by_code = inference.pick(rows, "D42_prompt01_gpt-x_base")
    openai = inference.for_provider(rows, "OpenAI")
    tagged = inference.across_providers(
        by_number.withColumn("picked", F.lit("number")),
        by_code.withColumn("picked", F.lit("code")),
        openai.withColumn("picked", F.lit("provider")),
    )
    return inference.by_id(tagged).select("picked", "ID", "code", "provider")


@query
def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    return stats.run_totals(b.runs(spark, folder))


@query
def run_by_provider(spark: SparkSession, folder: str) -> DataFrame:
    return stats.by_provider(b.runs(spark, folder))


def _rounded(per_model: DataFrame) -> DataFrame:
    """Sums of doubles depend on the order of adding in their last digits."""
    return per_model.withColumns(
        {
            "duration": text.format_duration(F.round("elapsed_seconds", 2)),
            "elapsed_seconds": F.round("elapsed_seconds", 2),
            "avg_elapsed_seconds": F.round("avg_elapsed_seconds", 6),
        }
    )


@query
def run_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.by_model(b.runs(spark, folder)))


@query
def dialogue_results(spark: SparkSession, folder: str) -> DataFrame:
    rows, results = b.dialogue(spark, folder)
    merged = inference.merge_results(rows, results)
    return merged.select(
        "ID",
        text.estimate_tokens("prompt").alias("tokens_estimate"),
        "status",
        text.sha256_hex("response_text").alias("response_hash"),
    )


# Streams


@query
def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    base = work_dir(spark)
    landed = _land(spark, folder, 1)
    streams.stream_pages(spark, landed, 1, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return _flat(spark.read.parquet(f"{base}/out"))


@query
def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    docs = b.publication_columns(b.stream(spark, folder, "documents"))
    arriving = docs.select("doi", "title", F.col("doc_id").alias("ord"))
    base = work_dir(spark)
    streams.stream_first_seen(arriving, f"{base}/out", f"{base}/keys", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("dedup_key")


@query
def stream_late_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Records in three parts, the oldest last: late ones count as any other."""
    docs = b.publication_columns(b.read(spark, folder, "documents"))
    base = work_dir(spark)
    for number, part in enumerate((2, 1, 0)):
        rows = docs.where(F.col("doc_id") % 3 == part).select("doi", "title", F.col("doc_id").alias("ord"))
        streams.first_seen_batch(rows, number, f"{base}/keys", f"{base}/out")
    return spark.read.parquet(f"{base}/out").groupBy("dedup_key").agg(F.count("*").alias("times"))


@query
def stream_run(spark: SparkSession, folder: str) -> DataFrame:
    base = work_dir(spark)
    rows = b.experiment_rows(b.stream(spark, folder, "documents"))
    streams.stream_run(rows, f"{base}/out", f"{base}/checkpoint", connect_offline).awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*RESULT_KEYS, "response_text", "status")


@query
def stream_run_stats(spark: SparkSession, folder: str) -> DataFrame:
    base = work_dir(spark)
    runs = b.run_columns(b.stream(spark, folder, "events"))
    streams.stream_run_stats(runs, f"{base}/sums", f"{base}/checkpoint").awaitTermination()
    out = streams.run_stats(spark, f"{base}/sums")
    start: Column = F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")
    return _rounded(out.select(start.alias("window_start"), *[c for c in out.columns if c != "window"]))


@query
def stream_keyed_state(spark: SparkSession, folder: str) -> DataFrame:
    """First records by the state store: three landings in small batches, each a new start of the stream."""
    docs = b.publication_columns(b.read(spark, folder, "documents"))
    rows = docs.select("doi", "title", F.col("doc_id").alias("ord"))
    base = work_dir(spark)
    for part in (2, 1, 0):
        rows.where(F.col("ord") % 3 == part).repartition(2).write.mode("append").parquet(f"{base}/landed")
        arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/landed")
        state.stream_first_seen(arriving, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("dedup_key", "ord")


@query
def stream_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Closed windows and late rows over three landings out of order, and one later event that closes all.

    The first half of the time lands first, then the second half, then every tenth event, late.
    """
    runs = b.runs(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    middle = runs.agg(F.expr("timestamp_micros((unix_micros(min(ts)) + unix_micros(max(ts))) div 2)")).first()[0]
    tenth = F.col("ID") % 10 == 0
    early = F.col("ts") < F.lit(middle)
    clock = runs.agg(F.max("ts").alias("ts")).select(F.expr("ts + INTERVAL 2 DAYS").alias("ts"))
    parts = [runs.where(~tenth & early), runs.where(~tenth & ~early), runs.where(tenth)]
    base = work_dir(spark)
    for landed in [*parts, clock]:
        whole = landed.select(*[c if c in landed.columns else F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in runs.columns])
        whole.write.mode("append").parquet(f"{base}/landed")
        arriving = spark.readStream.schema(runs.schema).parquet(f"{base}/landed")
        state.stream_windows(arriving, base)
    late = state.late_rows(spark, base).groupBy(F.window("ts", "1 hour").alias("window"), "model_name")
    late = late.agg(F.count("*").alias("late"))
    out = state.whole_windows(spark, base).join(late, ["window", "model_name"], "left")
    start: Column = F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")
    out = out.withColumn("late", F.coalesce("late", F.lit(0)))
    return _rounded(out.select(start.alias("window_start"), *[c for c in out.columns if c != "window"]))
