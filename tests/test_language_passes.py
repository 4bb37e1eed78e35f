import numpy as np

from litspark.functions import language_model


def test_texts_are_gone_through_once_for_a_model(spark):
    """The model follows from the counted n-grams; the words are not split again for each use of the counts."""
    rows = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "de"), ("x", None)]
    model = language_model.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert "split(" not in model._jdf.queryExecution().optimizedPlan().toString()
    detector = language_model.Detector(model)
    assert detector.words([]).shape == (0, 3)
    words = ["the", "zzz", "katze", "q"]
    together = detector.words(words)
    assert np.array_equal(together, np.concatenate([detector.words([w]) for w in words]))
    for word, row in zip(words, together.tolist()):
        p = f" {word} "
        grams = [*word, *(p[i : i + n] for n in (2, 3, 4) for i in range(len(p) - n + 1))]
        known = [detector.place[g] for g in grams if g in detector.place]
        assert row == [len(known), *detector.weights[known].sum(axis=0).tolist()]
