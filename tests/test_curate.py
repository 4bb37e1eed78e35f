import pytest
from pyspark.sql import functions as F

from litspark.functions.text import dedup_key
from litspark.operators import curate, search, stats
from litspark.schemas import RECORD_COLUMNS

A, B = "20260101-aaaaaaaa", "20260102-bbbbbbbb"


def test_merge_shared_doi(records):
    df = records(
        {"search_id": A, "doi": "10.1/X", "title": "one"},
        {"search_id": A, "doi": "10.1/y", "title": "two"},
        {"search_id": B, "doi": "10.1/x ", "title": "other title"},
        {"search_id": B, "doi": "10.1/z", "title": "three"},
    )
    rows = {r["title"]: r for r in curate.merge_searches(df).collect()}
    assert set(rows) == {"one", "two", "three"}
    assert (rows["one"]["duplicates_counter"], rows["one"][A], rows["one"][B]) == (1, 1, 1)
    assert (rows["two"]["duplicates_counter"], rows["two"][A], rows["two"][B]) == (0, 1, 0)


def test_merge_title_fallback_and_fill(records):
    df = records(
        {"search_id": A, "title": "A Shared  Title", "abstract": " "},
        {"search_id": B, "title": "a shared title", "abstract": "text", "year": 2020},
        {"search_id": A, "title": None, "authors": "x"},
        {"search_id": A, "title": " ", "authors": "y"},
    )
    rows = curate.merge_searches(df).collect()
    shared = [r for r in rows if r["title"] == "A Shared  Title"]
    assert len(rows) == 3 and len(shared) == 1
    assert (shared[0]["abstract"], shared[0]["year"], shared[0]["duplicates_counter"]) == ("text", 2020, 1)


def test_repeats_in_one_search_count_once(records):
    df = records({"search_id": A, "doi": "d"}, {"search_id": A, "doi": "D"}, {"search_id": B, "doi": "d"})
    row = curate.merge_searches(df).first()
    assert row["duplicates_counter"] == 1


def test_first_value_follows_file_names(records):
    """``s1__results.csv`` is read after ``s10__results.csv``: a digit sorts before ``_``."""
    df = records(
        {"search_id": "s1", "doi": "d", "title": "from s1"},
        {"search_id": "s10", "doi": "d", "title": "from s10"},
    )
    assert curate.merge_searches(df).first()["title"] == "from s10"


def test_merge_order(records):
    years = [2019, None, 2024, 2021]
    df = records(*[{"doi": f"d{i}", "year": y} for i, y in enumerate(years)])
    merged = curate.newest_first(curate.merge_searches(df))
    assert [r["year"] for r in merged.collect()] == [2024, 2021, 2019, None]


def test_many_searches(records):
    """More searches than fit one membership word."""
    rows = [{"search_id": f"s{i:03d}", "doi": "all"} for i in range(150)]
    rows += [{"search_id": "s149", "doi": "last"}, {"search_id": "s000", "doi": "first"}]
    merged = {r["doi"]: r for r in curate.merge_searches(records(*rows)).collect()}
    assert merged["all"]["duplicates_counter"] == 149
    assert all(merged["all"][f"s{i:03d}"] == 1 for i in range(150))
    assert merged["last"]["s149"] == 1 and merged["last"]["s148"] == 0
    assert merged["first"]["s000"] == 1 and merged["first"]["duplicates_counter"] == 0


def _merge_by_hand(rows):
    entries = {}
    for row in sorted(rows, key=lambda r: (f"{r['search_id']}__results.csv", r["ord"])):
        doi, title = ((row[c] or "").strip().lower() for c in ("doi", "title"))
        key = doi and f"d{doi}" or title and f"t{title}" or (row["search_id"], row["ord"])
        entry = entries.setdefault(key, ({}, set()))
        entry[1].add(row["search_id"])
        for c in RECORD_COLUMNS:
            if entry[0].get(c) is None and row[c] is not None and str(row[c]).strip():
                entry[0][c] = row[c]
    return sorted((str(e.get("title")), str(e.get("abstract")), str(e.get("year")), len(s) - 1) for e, s in entries.values())


def test_merge_with_hot_key_against_brute_force(records):
    """One key holds a third of the rows."""
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        rows.append(
            {
                "search_id": f"s{i % 7}",
                "doi": "hot" if hot else (f"d{i % 50}" if i % 2 else None),
                "title": None if i % 11 == 0 else f"t{i % 40}",
                "abstract": f"a{i}" if i % 5 == 0 else " ",
                "year": 2000 + i % 9 if i % 4 == 0 else None,
            }
        )
    df = records(*rows)
    got = curate.merge_searches(df).collect()
    wanted = _merge_by_hand([r.asDict() for r in df.collect()])
    found = sorted((str(r["title"]), str(r["abstract"]), str(r["year"]), r["duplicates_counter"]) for r in got)
    assert found == wanted
    for r in got:
        assert sum(r[f"s{i}"] for i in range(7)) == r["duplicates_counter"] + 1


def test_merge_is_idempotent(records):
    df = records(*[{"doi": f"d{i % 3}", "title": f"t{i}", "search_id": f"s{i % 2}"} for i in range(9)])
    once = curate.merge_searches(df)
    again = curate.merge_searches(
        once.select(*RECORD_COLUMNS, F.lit("m").alias("search_id"), F.monotonically_increasing_id().alias("ord"))
    )
    assert sorted(map(tuple, once.select(RECORD_COLUMNS).collect()), key=str) == sorted(
        map(tuple, again.select(RECORD_COLUMNS).collect()), key=str
    )


@pytest.fixture
def three(records):
    return records(
        {"language": "en", "entry_source": "OpenAlex", "doi": "a", "pdf_downloaded": True},
        {"language": "de", "entry_source": "Semantic Scholar", "doi": "b"},
        {"language": None, "entry_source": None, "doi": None, "pdf_downloaded": None},
    )


@pytest.mark.parametrize(
    ("criteria", "left"),
    [
        ({"language": "de"}, 2),
        ({"source": "OpenAlex"}, 2),
        ({"doi": "b"}, 2),
        ({"doi": "B"}, 3),
        ({"downloaded": True}, 1),
        ({"language": "de", "downloaded": True}, 1),
    ],
)
def test_exclude(three, criteria, left):
    assert curate.exclude(three, **criteria).count() == left


def test_exclude_needs_a_criterion(three):
    with pytest.raises(ValueError):
        curate.exclude(three)


def test_audit(three):
    rows = curate.exclude_audit(three, language="de", source="OpenAlex", downloaded=True).collect()
    assert [(r["step"], r["filter"], r["rows_in"], r["rows_out"]) for r in rows] == [
        (1, "language=de", 3, 2),
        (2, "source=OpenAlex", 2, 1),
        (3, "downloaded", 1, 0),
    ]


def test_latest_rows(records):
    results = records({"search_id": A, "doi": "1"}, {"search_id": A, "doi": "2"}, {"search_id": B, "doi": "3"})
    filtered = results.where("doi = '2'")
    assert sorted(r["doi"] for r in curate.latest_rows(results, filtered, [A]).collect()) == ["2", "3"]
    with pytest.raises(ValueError):
        curate.latest_rows(results, filtered)
    assert curate.latest_rows(results, None).count() == 3
    emptied = results.where("false")
    assert [r["doi"] for r in curate.latest_rows(results, emptied, [A]).collect()] == ["3"]


def test_combine_new(records):
    existing = records({"doi": "A"}, {"title": "t"}, {"doi": "a"}, {"title": None})
    new = records(
        {"doi": "a"}, {"doi": "b", "title": "first"}, {"doi": "B", "title": "second"}, {"title": None},
        {"title": None}, {"title": " T "},
    )
    got = curate.combine_new(existing, new)
    fresh = got.where("is_new").orderBy("ord").collect()
    assert got.where("not is_new").count() == 4
    assert [(r["doi"], r["title"]) for r in fresh] == [("b", "first"), (None, None), (None, None)]


def test_combine_with_itself_adds_keyless_rows_only(records):
    df = records({"doi": "a"}, {"title": "t"}, {"title": None})
    assert curate.combine_new(df, df).where("is_new").count() == 1


def test_search(records):
    df = records(
        {"title": "Deep-learning for Études", "abstract": None, "year": 2020, "isOpenAccess": True},
        {"title": "Shallow", "abstract": "deep, learning!", "year": 2022, "isOpenAccess": False},
        {"title": "Other learning", "abstract": "", "year": None},
    )

    def found(query):
        return [r["ord"] for r in search.keyword_filter(df, query).orderBy("ord").collect()]

    assert found('"deep learning"') == [0, 1]
    assert found("études") == [0]
    assert found("learning -deep") == [2]
    assert found("(shallow | other) + learning") == [1, 2]
    assert found("learn") == []
    assert [r["ord"] for r in search.year_filter(df, "2020-2021").collect()] == [0]
    assert [r["ord"] for r in search.year_filter(df, "2022").collect()] == [1]
    assert [r["ord"] for r in search.year_filter(df, None, True).collect()] == [0]


def test_limit_and_ceiling(spark):
    rows = spark.range(200).withColumnRenamed("id", "ord")
    pages = spark.createDataFrame([(1000,), (1000,)], "count bigint")
    assert search.limited(rows, ["ord"], None, 150).count() == 150
    assert search.truncated(pages, None, 150).first()[0] is True
    assert search.limited(rows, ["ord"], 20, 150).count() == 20
    assert search.truncated(pages, 20, 150).first()[0] is False
    assert search.truncated(pages, None, 1000).first()[0] is False
    assert search.limited(rows, ["ord"]).count() == 200
    assert search.truncated(pages).first()[0] is False


def test_papers_by_year(records):
    df = records(*[{"year": y} for y in [2020] * 5 + [2021] * 2 + [None]])
    rows = stats.papers_by_year(df).collect()
    assert [tuple(r) for r in rows] == [(2021, 2, 28.6), (2020, 5, 71.4)]


def test_breakdown(records):
    df = records(
        {"isOpenAccess": True, "language": "en", "entry_source": "OpenAlex", "txt_filename": "a.txt"},
        {"isOpenAccess": None, "language": None, "entry_source": None, "pdf_downloaded": True, "txt_filename": " "},
        {"isOpenAccess": False, "language": "en", "entry_source": "OpenAlex", "pdf_downloaded": None},
    )
    got = {(r["stat"], r["value"]): (r["count"], r["pct"]) for r in stats.breakdown(df).collect()}
    assert got == {
        ("Total", "papers"): (3, 100.0),
        ("Open Access", "True"): (1, 33.3),
        ("Entry Source", "OpenAlex"): (2, 66.7),
        ("Entry Source", ""): (1, 33.3),
        ("Language", "en"): (2, 66.7),
        ("PDF", "existing"): (1, 33.3),
        ("PDF", "missing"): (2, 66.7),
        ("TXT", "existing"): (1, 33.3),
        ("TXT", "missing"): (2, 66.7),
        ("Markdown", "existing"): (0, 0.0),
        ("Markdown", "missing"): (3, 100.0),
    }
    assert stats.by_frequency(stats.breakdown(df)).first()["count"] == 3


def test_half_rounds_to_even(spark):
    df = spark.createDataFrame([(2020,)] * 9 + [(2021,)] * 391, "year int")
    assert {r["year"]: r["pct"] for r in stats.papers_by_year(df).collect()} == {2020: 2.2, 2021: 97.8}


def test_key_of_keyless_rows_is_null(records):
    df = records({"title": None}, {"title": "x"})
    assert [r[0] for r in df.select(dedup_key()).collect()] == [None, "title:x"]


def test_a_quota_that_does_not_bind_sets_no_limit(spark):
    rows = spark.range(200).selectExpr("id AS ord")
    for cap, limit, n, cut, bound in ((1 << 30, None, 200, False, False), (200, None, 200, False, False), (150, None, 150, True, True), (1 << 30, 20, 20, False, True)):
        found, told = search.capped_search(rows, cap, limit=limit)
        assert found.count() == n and [r.truncated for r in told.collect()] == [cut]
        assert ("Limit" in found._jdf.queryExecution().optimizedPlan().toString()) == bound
