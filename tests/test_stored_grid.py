from test_experiment import inputs  # noqa: F401

from litspark import schemas
from litspark.plans import experiment
from litspark.sources import writers


def _bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_stored_grid_holds_each_text_once(spark, inputs, tmp_path):  # noqa: F811
    """What is stored equals the grid written in whole, and grows with the mapping, not with its pairs."""
    noise = [(f"D{i}", f"T{i}", "".join(chr(33 + hash((i, k)) % 90) for k in range(4000))) for i in range(40)]
    mapping = [(f"D{i}", p) for i in range(40) for p in ("p1", "p2")] + [("X", "p1")]
    few, many = ([("m1", f"s{k}", k / 10) for k in range(n)] for n in (2, 20))
    for name, params in (("few", few), ("many", many)):
        given = inputs(mapping, data=noise, params=params)
        skipped = experiment.write_grid(*given, str(tmp_path / name))
        assert [r["missing_id"] for r in skipped.collect()] == ["X"]
        stored = experiment.read_grid(spark, str(tmp_path / name))
        rows, _ = experiment.generate(*given)
        writers.write_experiment(rows, str(tmp_path / f"whole_{name}"))
        whole = spark.read.parquet(str(tmp_path / f"whole_{name}"))
        assert sorted(map(repr, stored.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))
        assert writers.provider_view(stored, "ollama").columns == schemas.provider_columns("ollama")
        bare = writers.provider_view(experiment.read_grid(spark, str(tmp_path / name), texts=False), "ollama")
        assert bare.columns == [c for c in schemas.provider_columns("ollama") if c not in experiment.TEXTS]
        assert bare.count() == whole.where("provider = 'ollama'").count()
    assert _bytes(tmp_path / "many" / "texts") < 1.1 * _bytes(tmp_path / "few" / "texts")
