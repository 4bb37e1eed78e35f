import hashlib
import json

import pytest
from pyspark.sql import functions as F

from litspark import schemas
from litspark.plans import experiment


@pytest.fixture
def inputs(spark):
    def make(mapping, data=None, prompts=None, models=None, params=None):
        data = data or [("D1", "T1", "A1"), ("D2", "T2", None)]
        prompts = prompts or [("p1", "Rate {{ title }}: {{ abstract }}"), ("p2", "{{ id }}")]
        models = models or [("m1", "Ollama"), ("m2", "openai")]
        params = params or [("m1", "base", 0.5), ("m2", "base", 0.7)]

        def numbered(rows, schema):
            return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", ord bigint")

        settings = numbered([(m, p, t) for m, p, t in params], "model_name string, profile_name string, temperature double")
        for c in schemas.ALL_PARAMS:
            if c not in settings.columns:
                settings = settings.withColumn(c, F.lit(None).cast(schemas.EXPERIMENT_TYPES[c]))
        return (
            numbered(mapping, "data_id string, prompt_id string"),
            spark.createDataFrame(data, "ID string, Title string, Abstract string"),
            spark.createDataFrame(prompts, "prompt_id string, template string"),
            numbered(models, "name string, provider string"),
            settings,
        )

    return make


def test_grid_is_model_major(inputs):
    rows, skipped = experiment.generate(*inputs([("D1", "p1"), (" D2 ", "p1")]))
    got = [(r["ID"], r["code"]) for r in rows.orderBy("ID").collect()]
    assert got == [(1, "D1_p1_m1_base"), (2, "D2_p1_m1_base"), (3, "D1_p1_m2_base"), (4, "D2_p1_m2_base")]
    assert skipped.count() == 0


def test_row_contents(inputs):
    rows, _ = experiment.generate(*inputs([("D1", "p1"), ("D2", "p1")]))
    by_code = {r["code"]: r for r in rows.collect()}
    r = by_code["D1_p1_m1_base"]
    assert r["prompt"] == "Rate T1: A1" and r["tokens_estimate"] == 2
    assert r["prompt_hash"] == hashlib.sha256(b"Rate T1: A1").hexdigest()
    original = json.dumps({"ID": "D1", "Title": "T1", "Abstract": "A1"})
    assert r["original_data"] == original
    assert r["original_data_hash"] == hashlib.sha256(original.encode()).hexdigest()
    assert (r["provider"], r["provider_name"], r["temperature"]) == ("ollama", "Ollama", 0.5)
    other = by_code["D1_p1_m2_base"]
    assert (r["prompt_hash"], r["original_data_hash"]) == (other["prompt_hash"], other["original_data_hash"])
    assert by_code["D2_p1_m1_base"]["prompt"] == "Rate T2: "


def test_skipped_rows_are_reported(inputs):
    rows, skipped = experiment.generate(*inputs([("X", "none"), ("D1", "p1"), ("D1", "none")]))
    assert [r["code"] for r in rows.orderBy("ID").collect()] == ["D1_p1_m1_base", "D1_p1_m2_base"]
    assert [tuple(r) for r in skipped.orderBy("ord").collect()] == [(0, "data_id", "X"), (2, "prompt_id", "none")]


def _ids_by_hand(mapping, models, params):
    rows = []
    for d, p in mapping:
        for name, _ in models:
            for model, profile, _ in params:
                if model == name:
                    rows.append((name, f"{d}_{p}_{name}_{profile}"))
    order = [name for name, _ in models]
    rows.sort(key=lambda r: order.index(r[0]))
    return [code for _, code in rows]


def test_ids_equal_a_stable_sort(inputs):
    """A repeated model, two profiles per model, a model without profiles, an unlisted model."""
    mapping = [("D2", "p2"), ("D1", "p1"), ("D1", "p2"), ("D2", "p2")]
    models = [("b", "x"), ("a", "y"), ("b", "z"), ("lone", "y")]
    params = [("a", "one", 0.1), ("b", "one", 0.2), ("b", "two", 0.3), ("unlisted", "one", 0.4), ("a", "two", 0.5)]
    rows, _ = experiment.generate(*inputs(mapping, models=models, params=params))
    got = rows.orderBy("ID").collect()
    assert [r["code"] for r in got] == _ids_by_hand(mapping, models, params)
    assert [r["ID"] for r in got] == list(range(1, len(got) + 1))


def test_no_pairs(inputs):
    rows, _ = experiment.generate(*inputs([("D1", "p1")], params=[("other", "base", 0.1)]))
    assert rows.count() == 0


def test_duplicate_data_ids_raise(inputs):
    with pytest.raises(ValueError, match="D1"):
        experiment.generate(*inputs([("D1", "p1")], data=[("D1", "a", "b"), ("D1", "c", "d")]))


def test_copy_papers_prefers_markdown(spark):
    docs = [("b.txt", "b", "txt", "no"), ("b.md", "b", "md", "yes"), ("c.MD", "c", "MD", "c"), ("a.txt", "a", "txt", "a"), ("d.pdf", "d", "pdf", "")]
    df = spark.createDataFrame(docs, "file_name string, stem string, ext string, content string")
    rows = experiment.copy_papers(df).orderBy("ID").collect()
    assert [tuple(r) for r in rows] == [("P01", "a.txt", "a"), ("P02", "b.md", "yes"), ("P03", "c.MD", "c")]


def test_copy_search(records):
    df = records({"title": "z", "doi": None, "abstract": "x"}, {"title": "a", "authors": "me"})
    rows = experiment.copy_search(df, ["search_id", "ord"]).orderBy("ID").collect()
    assert [tuple(r) for r in rows] == [("S01", "z", "x", "", ""), ("S02", "a", "", "", "me")]
    with pytest.raises(ValueError, match="doi, authors"):
        experiment.copy_search(df.drop("doi", "authors"), ["ord"])
