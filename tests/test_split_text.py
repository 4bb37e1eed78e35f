import csv
import io

import pytest

from litspark.sources import readers, split_text

TEXTS = ['plain', 'two\nlines', 'a "quoted" word', '"', '""\n""', '; semi\n;\n', 'é\n\nß', '', ' x ', "\n", 'end"\n']


def written(rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator=end)
    writer.writerow(["title", "year", "abstract", "odd"])
    writer.writerows(rows)
    return out.getvalue()


@pytest.fixture
def small_ranges(spark):
    """Reads in ranges of a few bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def use(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")

    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [7, 16, 41, 1 << 20])
def test_cut_anywhere(spark, tmp_path, small_ranges, size, end):
    rows = [[t, 2000 + i, u, i] for i, (t, u) in enumerate(zip(TEXTS, TEXTS[::-1]))]
    (tmp_path / "a__results.csv").write_text(written(rows, end), encoding="utf-8", newline="")
    small_ranges(size)
    found = split_text.read_split(spark, str(tmp_path)).orderBy("ord").collect()
    assert [[r.title or "", int(r.year), r.abstract or "", int(r.odd)] for r in found] == rows


def test_same_records_as_the_reader_of_whole_files(spark, tmp_path, small_ranges):
    for name, part in (("b__results.csv", TEXTS), ("a__results.csv", TEXTS[:4]), ("x__merged__results.csv", TEXTS[:2])):
        rows = [[t, 2000 + i, u, i] for i, (t, u) in enumerate(zip(part, part[::-1]))]
        (tmp_path / name).write_text(written(rows), encoding="utf-8")
    want = readers.read_searches(spark, str(tmp_path))
    small_ranges(20)
    got = split_text.read_searches_split(spark, str(tmp_path))
    shown = ["search_id", "title", "year", "abstract", "doi"]
    assert got.rdd.getNumPartitions() > 10
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(shown).collect()), key=key) == sorted(map(tuple, want.select(shown).collect()), key=key)
