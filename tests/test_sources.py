import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from litspark import schemas
from litspark.sources import pages, readers, writers

HEADER = ";".join(schemas.RECORD_COLUMNS)


def _line(**values):
    return ";".join(str(values.get(c, "")) for c in schemas.RECORD_COLUMNS)


@pytest.fixture
def searches(tmp_path):
    folder = tmp_path / "searches"
    folder.mkdir()
    quoted = '"say ""hi""; then\n\nmore"'
    (folder / "a__results.csv").write_text(
        "\n".join([HEADER, _line(title="One", year="2021.0", abstract=quoted, isOpenAccess="True"),
                   _line(title="nan", year="", pdf_downloaded="0"), _line(title="Zwei", year="2020")]) + "\n",
        encoding="utf-8",
    )
    (folder / "b__results.csv").write_text(HEADER + "\n" + _line(title="B") + "\n")
    (folder / "p__merged_results.csv").write_text(HEADER + "\n" + _line(title="M") + "\n")
    (folder / "a__filtered.csv").write_text(HEADER + "\n" + _line(title="F") + "\n")
    return folder


def test_read_searches(spark, searches):
    rows = readers.read_searches(spark, str(searches)).orderBy("search_id", "ord").collect()
    assert [(r["search_id"], r["title"], r["year"]) for r in rows] == [
        ("a", "One", 2021), ("a", None, None), ("a", "Zwei", 2020), ("b", "B", None),
    ]
    assert rows[0]["abstract"] == 'say "hi"; then\n\nmore'
    assert rows[0]["isOpenAccess"] is True and rows[1]["pdf_downloaded"] is False
    filtered = readers.read_searches(spark, str(searches), "filtered").collect()
    assert [(r["search_id"], r["title"]) for r in filtered] == [("a", "F")]
    with pytest.raises(ValueError):
        readers.read_searches(spark, str(searches), "merged")


def test_records_round_trip(spark, records, tmp_path):
    df = records(
        {"title": "b", "year": 2020, "abstract": 'x; "y"\nz', "isOpenAccess": True},
        {"title": "a", "year": 2020}, {"title": "c", "year": None}, {"title": "d", "year": 2022},
    ).select(schemas.RECORD_COLUMNS)
    assert [r["title"] for r in writers.sort_records(df).collect()] == ["d", "a", "b", "c"]
    for fmt, read in (("csv", readers.read_records), ("parquet", lambda s, p: s.read.parquet(p))):
        path = str(tmp_path / fmt)
        writers.write_records(df, path, fmt=fmt)
        back = read(spark, path).select(schemas.RECORD_COLUMNS)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
        with pytest.raises(AnalysisException):
            writers.write_records(df, path, fmt=fmt)
        writers.write_records(df.limit(1), path, rewrite=True, fmt=fmt)
        assert read(spark, path).count() == 1


def test_dry_run_counts(records):
    counts = writers.plan_counts(kept=records({}, {}), lost=records({}).where("false"))
    assert {r["table"]: r["rows"] for r in counts.collect()} == {"kept": 2, "lost": 0}


def test_configs(spark, tmp_path):
    (tmp_path / "s1.json").write_text('{"query": "a"}\n')
    (tmp_path / "s2.json").write_text('{"query": "b", "year": "2023", "onlyOpenAccess": true}\n')
    got = {r["search_id"]: tuple(r)[1:] for r in readers.read_search_configs(spark, str(tmp_path)).collect()}
    assert got == {"s1": ("a", "2020-2025", False), "s2": ("b", "2023", True)}


def test_documents_prompts_and_inventory(spark, tmp_path):
    papers = tmp_path / "papers"
    (papers / "deep").mkdir(parents=True)
    (papers / "a.b.md").write_text("# A\n\ntext\n")
    (papers / "c.txt").write_text("c")
    (papers / "c.pdf").write_bytes(b"%PDF")
    (papers / "deep" / "d.pdf").write_bytes(b"%PDF")
    docs = {r["file_name"]: tuple(r)[1:] for r in readers.read_parsed_documents(spark, str(papers)).collect()}
    assert docs == {"a.b.md": ("a.b", "md", "# A\n\ntext\n"), "c.txt": ("c", "txt", "c")}
    flat = readers.read_file_inventory(spark, str(papers))
    assert "content" not in flat.columns
    assert sorted(r["file_name"] for r in flat.collect()) == ["a.b.md", "c.pdf", "c.txt"]
    assert readers.read_file_inventory(spark, str(papers), recursive=True).count() == 4
    prompts = tmp_path / "prompts"
    prompts.mkdir()
    (prompts / "p1.txt").write_text("Say {{ title }}\n")
    assert [tuple(r) for r in readers.read_prompts(spark, str(prompts)).collect()] == [("p1", "Say {{ title }}")]


def test_open_table(spark, tmp_path):
    (tmp_path / "data.csv").write_text("ID;Title;Note\n01;nan;\n02;x;y\n")
    rows = readers.read_table(spark, str(tmp_path / "data.csv")).orderBy("ord").collect()
    assert [tuple(r)[:3] for r in rows] == [("01", None, None), ("02", "x", "y")]


def _s2(i, **values):
    return {"paperId": f"P{i}", "title": f"T{i}", "authors": [{"name": "Ada Lovelace"}, {"name": None}], "abstract": None,
            "isOpenAccess": True, "externalIds": {"DOI": f"10.1/{i}"}, "year": 2020, "referenceCount": 1,
            "citationCount": 2, "unknown": 1} | values


def test_engine_1_pages(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps(
        [{"total": 3, "token": "x", "data": [_s2(1), _s2(2, externalIds=None, authors=[])]}, {"data": [_s2(3, year=None)]}]))
    df = pages.flatten_s2_pages(pages.read_pages(spark, str(tmp_path / "raw.json"), 1, "array"))
    rows = df.orderBy("page_no", "pos").collect()
    assert [(r["search_engine_internal_id"], r["authors"], r["doi"], r["year"]) for r in rows] == [
        ("P1", "Ada Lovelace; ", "10.1/1", 2020), ("P2", "", None, 2020), ("P3", "Ada Lovelace; ", "10.1/3", None)]
    assert rows[0]["pdf_filename"] == "2020_Lovelace_T1_10.1_1.pdf"
    assert rows[1]["pdf_filename"] == "2020_NO_author_T2_NO_doi.pdf"
    assert (rows[0]["entry_source"], rows[0]["pdf_downloaded"], rows[0]["txt_filename"]) == ("Semantic Scholar", False, None)
    assert df.columns[:15] != [] and set(schemas.RECORD_COLUMNS) <= set(df.columns)


def test_engine_2_pages(spark, tmp_path):
    work = {"id": "https://openalex.org/W9", "display_name": "Title", "publication_year": 2021, "doi": "https://doi.org/10.1/Q",
            "authorships": [{"author": {"display_name": " "}}, {"author": None}, {"author": {"display_name": "Bo Li"}}],
            "open_access": {"is_oa": False}, "abstract_inverted_index": {"the": [0, 2], "of": [1]}, "referenced_works": ["a", "b"],
            "cited_by_count": 4}
    bare = {"id": None, "display_name": None, "abstract_inverted_index": None, "referenced_works": None}
    (tmp_path / "raw.json").write_text(json.dumps({"results": [work, bare], "meta": {"count": 2, "next_cursor": None}}))
    rows = pages.flatten_oa_pages(pages.read_pages(spark, str(tmp_path / "raw.json"), 2)).orderBy("pos").collect()
    r = rows[0]
    assert (r["search_engine_internal_id"], r["doi"], r["authors"], r["abstract"], r["referenceCount"], r["citationCount"],
            r["pdf_filename"], r["isOpenAccess"]) == ("W9", "10.1/Q", "Bo Li", "the of the", 2, 4, "2021_Li_Title_10.1_q.pdf", False)
    r = rows[1]
    assert (r["search_engine_internal_id"], r["abstract"], r["referenceCount"], r["authors"], r["language"]) == (None, None, 0, "", "unclear")


def test_raw_pages_are_appended(spark, tmp_path):
    page = spark.createDataFrame([("a",)], "token string")
    writers.write_raw_pages(page, str(tmp_path / "raw"))
    writers.write_raw_pages(page, str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == 2


def test_provider_tables(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "Ollama", float("nan"), 4096, "x"), (2, "openai", 0.5, None, "x")],
        "ID bigint, provider_name string, temperature double, ollama_context_window int, junk string",
    )
    path = str(tmp_path / "rows")
    writers.write_experiment(rows, path)
    stored = spark.read.parquet(path)
    assert "junk" not in stored.columns
    ollama = writers.provider_view(stored, "OLLAMA")
    assert ollama.columns == schemas.provider_columns("ollama")
    assert [(r["ID"], r["temperature"], r["ollama_context_window"]) for r in ollama.collect()] == [(1, None, 4096)]
    assert "ollama_context_window" not in writers.provider_view(stored, "openai").columns
    plan = ollama._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(provider" in plan


def test_filter_log_and_failures(spark, tmp_path):
    audit = spark.createDataFrame([("s", 1, "f", 2, 1)], "search_id string, step int, filter string, rows_in bigint, rows_out bigint")
    writers.append_filter_log(audit, str(tmp_path / "log"))
    writers.append_filter_log(audit, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and log.where(F.col("applied_at").isNull()).count() == 0
    outcomes = spark.createDataFrame([("d", "t", None, "f.pdf", "skipped")], "doi string, title string, pdf_url string, pdf_filename string, outcome string")
    writers.write_failures(outcomes, str(tmp_path / "failed"))
    written = [path.read_text() for path in (tmp_path / "failed").glob("*.csv")]
    assert any("d;t;;f.pdf;false" in text for text in written)


def test_json_lines_give_every_page(spark, tmp_path):
    lines = [json.dumps({"data": [_s2(2 * i), _s2(2 * i + 1)]}) for i in range(3)]
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n\n")
    rows = pages.flatten_s2_pages(pages.read_pages(spark, str(tmp_path / "a.json"), 1)).orderBy("page_no", "pos").collect()
    assert [r["search_engine_internal_id"] for r in rows] == [f"P{i}" for i in range(6)]
    writers.write_raw_pages(spark.read.schema(schemas.PAGE_ENGINE_1).json(str(tmp_path / "a.json")), str(tmp_path / "raw"))
    assert pages.flatten_s2_pages(pages.read_pages(spark, str(tmp_path / "raw"), 1)).count() == 6


def test_unreadable_pages_are_told(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"data": [_s2(1)]}) + '\n{"data": [\n' + json.dumps({"data": [_s2(2)]}) + "\n")
    with pytest.raises(Exception, match="unreadable page"):
        pages.read_pages(spark, str(tmp_path / "in"), 1).collect()
    good = pages.read_pages(spark, str(tmp_path / "in"), 1, rejected=str(tmp_path / "bad"))
    assert sorted(r["search_engine_internal_id"] for r in pages.flatten_s2_pages(good).collect()) == ["P1", "P2"]
    assert [r["_corrupt"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ['{"data": [']
    # An array of pages is no line of pages.
    (tmp_path / "array.json").write_text(json.dumps([{"data": [_s2(1)]}], indent=1))
    with pytest.raises(Exception, match="unreadable page"):
        pages.read_pages(spark, str(tmp_path / "array.json"), 1).collect()


def test_records_by_header_name(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("in_search_a;title;year\n1;One;2021\n")
    (tmp_path / "m" / "b.csv").write_text('year;doi;title;odd.name\n2020;10.1/x;"Two; b";z\n')
    rows = readers.read_records(spark, str(tmp_path / "m"), extra=True).orderBy("title").collect()
    assert [(r["title"], r["year"], r["doi"], r["in_search_a"], r["odd.name"], r["abstract"]) for r in rows] == [
        ("One", 2021, None, "1", None, None), ("Two; b", 2020, "10.1/x", None, "z", None)]
    assert "in_search_a" not in readers.read_records(spark, str(tmp_path / "m")).columns


def test_array_pages_do_not_carry_their_file(spark):
    file = json.dumps([{"data": [_s2(1)]}, None, {"data": 5}, {"data": [_s2(2)]}])
    rows = pages.parse_pages(spark.createDataFrame([(file,), ("[]",), ("[{",)], "value string"), 1, "array").collect()
    bad = sorted(r["_corrupt"] for r in rows if r["_corrupt"] is not None)
    assert len(rows) == 6 and bad == sorted(["null", '{"data":5}', "[]", "[{"])


def test_array_files_grow_with_the_pages(spark, tmp_path, monkeypatch):
    from litspark.plans import queries

    landed = spark.range(100).selectExpr("id AS page_no", """concat('{"page_no": ', id, ', "data": []}') AS value""")
    monkeypatch.setattr(queries, "work_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(queries.b, "landed_pages", lambda *_: landed)
    queries.raw_pages_array(spark, "")
    files = [json.loads(p.read_text()) for p in (tmp_path / "arrays").glob("part-*")]
    assert sorted(len(x) for x in files) == [20] * 5
    back = pages.read_pages(spark, str(tmp_path / "arrays"), 1, layout="array")
    assert back.count() == 100
