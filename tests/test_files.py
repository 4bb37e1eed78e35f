import datetime

import pytest
from pyspark.sql import functions as F

from litspark.operators import inventory, stats
from litspark.operators.extract import extract_text, load_path
from litspark.operators.offline import html_pages
from litspark.sources import readers, writers


@pytest.fixture
def files(spark):
    return lambda *names: spark.createDataFrame([(n,) for n in names], "file_name string")


def test_sync_updates(records, files):
    df = records(
        {"pdf_filename": "a.pdf"},
        {"pdf_filename": " b.PDF ", "pdf_downloaded": None},
        {"pdf_filename": "c.pdf", "txt_filename": "own.txt", "pdf_downloaded": True},
        {"pdf_filename": "gone.pdf", "pdf_downloaded": True},
        {"pdf_filename": None},
        {"pdf_filename": "plain"},
    )
    there = files("a.pdf", "a.pdf", "a.txt", "b.PDF", "b.md", "c.pdf", "c.txt", "gone.txt", "plain", "x.pdf", "x.md", "y.PDF")
    rows, counts = inventory.sync(df, there)
    got = [
        (r["pdf_downloaded"], r["txt_filename"], r["markdown_filename"], r["changed"])
        for r in rows.orderBy("ord").collect()
    ]
    assert got == [
        (True, "a.txt", None, True),
        (True, None, "b.md", True),
        (True, "own.txt", None, False),
        (True, "gone.txt", None, True),
        (False, None, None, False),
        (True, None, None, True),
    ]
    assert tuple(counts.first()) == (4, 0)


def test_sync_is_case_sensitive(records, files):
    rows, counts = inventory.sync(records({"pdf_filename": "a.PDF"}), files("a.pdf", "A.pdf", "a.TXT"))
    assert rows.first()["pdf_downloaded"] is False
    assert counts.first()["updated"] == 0


def test_sync_adds_unlisted(records, files):
    df = records({"pdf_filename": "a.pdf"})
    rows, counts = inventory.sync(df, files("a.pdf", "x.pdf", "x.txt", "z.PDF", "n.md"), add_extra=True)
    extra = rows.where("added").collect()
    assert [(r["pdf_filename"], r["txt_filename"], r["markdown_filename"], r["entry_source"], r["pdf_downloaded"], r["title"])
            for r in extra] == [("x.pdf", "x.txt", None, "manually added", True, None)]
    assert tuple(counts.first()) == (1, 1)
    _, second = inventory.sync(rows.drop("changed", "added"), files("a.pdf", "x.pdf", "x.txt"), add_extra=True)
    assert tuple(second.first()) == (0, 0)


OK = '{"best_oa_location": {"url_for_pdf": "http://x/%s.pdf"}}'


def test_download_plan(spark, records, files):
    df = records(
        {"doi": "1", "pdf_filename": "one.pdf", "title": "t1"},
        {"doi": "2", "pdf_filename": "two.pdf"},
        {"doi": "3", "pdf_filename": "there.pdf"},
        {"doi": None, "pdf_filename": "none.pdf"},
        {"doi": "4", "pdf_filename": "same.pdf"},
        {"doi": "5", "pdf_filename": "same.pdf"},
        {"doi": "6", "pdf_filename": "same.pdf"},
        {"doi": "7", "pdf_filename": "seven.pdf"},
        {"doi": "8", "pdf_filename": "broken.pdf"},
    )
    answers = [(d, OK % d) for d in "134568"] + [("2", "{}"), ("1", OK % 1)]
    answers = spark.createDataFrame(answers, "doi string, response string")
    failed = spark.createDataFrame([(4,), (8,)], "ord bigint")
    plan = inventory.download_plan(df, answers, files("there.pdf"), failed)
    got = {r["doi"]: (r["outcome"], r["resolution"]) for r in plan.collect()}
    assert got == {
        "1": ("succeeded", "ok"),
        "2": ("skipped", "no_oa"),
        "3": ("exists", "ok"),
        "4": ("failed", "ok"),
        "5": ("succeeded", "ok"),
        "6": ("exists", "ok"),
        "7": ("skipped", "no_answer"),
        "8": ("failed", "ok"),
    }
    counts = {r["outcome"]: r["count"] for r in stats.outcome_counts(plan).collect()}
    assert counts == {"succeeded": 2, "skipped": 2, "exists": 2, "failed": 2}
    lost = {r["doi"]: (r["url"], r["pdf_downloaded"]) for r in writers.failure_rows(plan).collect()}
    assert lost["3"] == ("http://x/3.pdf", True) and lost["2"] == (None, False) and "1" not in lost


def test_extract_plan(files):
    there = files("a.pdf", "a.txt", "b.PDF", "b.md", "c.pdf", "n.txt")

    def todo(**options):
        plan = inventory.extract_plan(there, **options)
        return sorted(r["file_name"] for r in plan.where("outcome = 'to_extract'").collect())

    assert todo() == ["b.PDF", "c.pdf"]
    assert todo(skip_if_md=True) == ["c.pdf"]
    assert todo(rewrite=True) == ["a.pdf", "b.PDF", "c.pdf"]
    assert todo(rewrite=True, skip_if_md=True) == ["a.pdf", "c.pdf"]
    assert todo(ext="md") == ["a.pdf", "c.pdf"]


def test_extract_text(spark, files):
    contents = [("a.pdf", b"<p>A</p>"), ("b.pdf", b"<p> </p>"), ("c.pdf", b"\xff"), ("d.pdf", b"d")]
    df = spark.createDataFrame(contents, "file_name string, content binary")
    got = {r["file_name"]: (r["text"], r["outcome"]) for r in extract_text(df, html_pages).collect()}
    assert got == {"a.pdf": (" A ", "extracted"), "b.pdf": (None, "skipped"), "c.pdf": (None, "error"), "d.pdf": ("d", "extracted")}
    plan = inventory.extract_plan(files("a.pdf", "b.pdf", "c.pdf", "d.pdf", "d.txt"))
    counts = stats.outcome_counts(extract_text(df, html_pages, plan)).collect()
    assert {r["outcome"]: r["count"] for r in counts} == {"extracted": 1, "skipped": 1, "error": 1, "existing": 1}


def test_tasks_read_the_files(spark, files, tmp_path):
    for name in ("a b.pdf", "old.pdf"):
        (tmp_path / name).write_bytes(b"<p>" + name.encode())
    df = readers.read_file_inventory(spark, str(tmp_path))
    gone = spark.createDataFrame([("gone.pdf", "file:/none/gone.pdf")], "file_name string, path string")
    df = df.select("file_name", "path").unionByName(gone)
    plan = inventory.extract_plan(files("a b.pdf", "old.pdf", "gone.pdf", "old.txt"))
    got = extract_text(df, html_pages, plan, load=load_path).collect()
    assert {r["file_name"]: (r["text"], r["outcome"]) for r in got} == {
        "a b.pdf": (" a b.pdf", "extracted"), "old.pdf": (None, "existing"), "gone.pdf": (None, "error")}


def test_pages_are_joined(spark):
    df = spark.createDataFrame([("a.pdf", b"1|2|")], "file_name string, content binary")
    got = extract_text(df, lambda content: [p or None for p in content.decode().split("|")])
    assert got.first()["text"] == "1\n2\n"


def test_add_plan(spark, files):
    sources = spark.createDataFrame([("/x/a.pdf",), ("/x/y/b.PDF",), ("/x/c.txt",)], "path string")
    plan = inventory.add_plan(sources, files("a.pdf"))
    assert {r["file_name"]: r["outcome"] for r in plan.collect()} == {"a.pdf": "exists", "b.PDF": "copied"}


def test_search_and_project_lists(spark, records):
    configs = spark.createDataFrame([("s1", "q"), ("s2", "q")], "search_id string, query string")
    results = records({"search_id": "s1"}, {"search_id": "s1"})
    flags = inventory.list_searches(configs, results).collect()
    assert {r["search_id"]: r["has_results"] for r in flags} == {"s1": True, "s2": False}
    names = [("p", n) for n in inventory.PROJECT_INPUTS]
    names += [("p", "experiment_1_02.db"), ("p", "experiment_1_01.db"), ("q", "data.csv"), ("q", "data.csv")]
    rows = [(p, n, datetime.datetime(2026, 1, 9 - i)) for i, (p, n) in enumerate(names)]
    df = spark.createDataFrame(rows, "project string, file_name string, modificationTime timestamp")
    projects = inventory.list_projects(df)
    assert {r["project"]: r["initialized"] for r in projects.collect()} == {"p": True, "q": False}
    snapshots = inventory.project_snapshots(df).orderBy("file_name").collect()
    assert [tuple(r) for r in snapshots] == [("p", "experiment_1_01.db"), ("p", "experiment_1_02.db")]

    def order(by, descending):
        return [r["project"] for r in inventory.sorted_list(projects, by, descending).collect()]

    assert order("project", False) == ["p", "q"] and order("project", True) == ["q", "p"]
    assert order("created", False) == ["q", "p"] and order("created", True) == ["p", "q"]


def test_snapshots(files):
    def name(df):
        return df.first()["file_name"]

    there = files("experiment_20260101_09.db", "experiment_20260102_03.db", "experiment_x.db", "data_backup_20260101_04.csv", "note.txt")
    assert name(writers.next_snapshot(there, "20260103")) == "experiment_20260103_10.db"
    assert name(writers.latest_snapshot(there)) == "experiment_20260101_09.db"
    assert name(writers.next_snapshot(files("a"), "20260103")) == "experiment_20260103_01.db"
    assert name(writers.latest_snapshot(files("a"))) is None
    assert name(writers.next_backup(there, "20260101")) == "data_backup_20260101_05.csv"
    assert name(writers.next_backup(there, "20260102")) == "data_backup_20260102_01.csv"
