import hashlib
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litspark.functions import filenames, requests, text
from litspark.functions.language import detect_language, detect_text
from litspark.functions.prompts import data_context, render_prompt, template_text
from litspark.operators.search import keyword_filter, query_condition


@pytest.mark.parametrize("raw", [None, "", "  ", " \t", "nan", " NaN "])
def test_missing(value, raw):
    assert value(text.is_missing(F.lit(raw).cast("string"))) is True


@pytest.mark.parametrize("raw", ["0", "nano", "a"])
def test_not_missing(value, raw):
    assert value(text.is_missing(F.lit(raw))) is False


def test_normalize_and_key(value):
    assert value(text.normalize_text(F.lit(" A \n  Shared\tTitle "))) == "a shared title"
    assert value(text.dedup_key(F.lit("10.1/AB"), F.lit("x"))) == "doi:10.1/ab"
    assert value(text.dedup_key(F.lit("nan"), F.lit(" X  y"))) == "title:x y"
    assert value(text.dedup_key(F.lit(None).cast("string"), F.lit(" "))) is None


@pytest.mark.parametrize(
    ("raw", "bare"),
    [
        ("https://doi.org/10.1/x", "10.1/x"),
        ("HTTP://DOI.ORG/10.1/x", "10.1/x"),
        ("doi.org/10.1/x", "10.1/x"),
        ("10.1/doi.org/x", "10.1/doi.org/x"),
    ],
)
def test_doi_prefix(value, raw, bare):
    assert value(text.strip_doi_prefix(F.lit(raw))) == bare


def test_work_id_prefix(value):
    assert value(text.strip_work_id_prefix(F.lit("https://openalex.org/W7"))) == "W7"


def test_rebuild_abstract(spark, value):
    index = F.from_json(F.lit('{"b": [1, 3], "a": [0], "z": [2], "c": [2]}'), "map<string, array<int>>")
    assert value(text.rebuild_abstract(index)) == "a b z c b"
    empty = F.from_json(F.lit("{}"), "map<string, array<int>>")
    assert value(text.rebuild_abstract(empty)) is None
    assert value(text.rebuild_abstract(F.lit(None).cast("map<string, array<int>>"))) is None


def test_authors(value):
    names = F.array(F.lit(None).cast("string"), F.lit("  "), F.lit("Ada  B. Lovelace "), F.lit("X"))
    assert value(text.first_author_last_name(names)) == "Lovelace"
    assert value(text.join_authors(names)) == ";   ; Ada  B. Lovelace ; X"
    none = F.array().cast("array<string>")
    assert value(text.first_author_last_name(none)) is None
    assert value(text.join_authors(none)) == ""


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("a + b", "a AND b"),
        ("a | b", "a OR b"),
        ("-a b", "NOT a b"),
        ("(a | b) -c", "(a OR b) NOT c"),
        ("state-of-the-art + x", "state-of-the-art AND x"),
        ('"big data" + (-x)', '"big data" AND (NOT x)'),
        ("a - b -", "a - b -"),
        ("(-) (-x) y(-", "(-) (NOT x) y(-"),
        ("", ""),
    ],
)
def test_query_notation(value, raw, wanted):
    assert value(text.translate_query(F.lit(raw))) == wanted


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("2020-2025", (2020, 2025)), (" 2023 ", (2023, 2023)), ("2020-", (2020, 2020)), ("", None), ("-2020", None)],
)
def test_year_range(value, raw, wanted):
    got = value(text.year_range(F.lit(raw)))
    assert (tuple(got) if got else None) == wanted


@pytest.mark.parametrize(
    ("seconds", "wanted"),
    [(0, "00:00:00"), (3661, "01:01:01"), (59, "00:00:59"), (90061, "25:01:01"), (None, "00:00:00"), (59.9, "00:00:59")],
)
def test_duration(value, seconds, wanted):
    assert value(text.format_duration(F.lit(seconds).cast("double"))) == wanted


def test_small_ones(value):
    assert value(text.estimate_tokens(F.lit("äöüß5"))) == 1
    assert value(text.sequence_code("S", F.lit(7))) == "S07"
    assert value(text.sequence_code("S", F.lit(107))) == "S107"
    assert value(text.safe_name(F.lit("a/b:c"))) == "a-b-c"
    assert value(text.clean_value(F.lit(float("nan")))) is None
    assert value(text.clean_value(F.lit(1.5))) == 1.5
    assert value(text.combo_code(F.lit("D1"), F.lit("p"), F.lit("m"))) == "D1_p_m"
    assert value(text.provider_key(F.lit("OLLama"))) == "ollama"


def _clean(part):
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in part).strip("_")


def _file_name(year, author, title, doi):
    return "_".join(
        [
            _clean(year) if year.strip() else "NO_year",
            _clean(author) if author.strip() else "NO_author",
            _clean(title).lower()[:60].title() if title.strip() else "NO_title",
            _clean(doi).lower() if doi.strip() else "NO_doi",
        ]
    ) + ".pdf"


WORDS = st.text(alphabet="abzAZéÉßñ中1-_. \t/:'", max_size=90)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(WORDS, WORDS, WORDS, WORDS), min_size=40, max_size=60))
def test_structured_filename(spark, rows):
    df = spark.createDataFrame(rows, "y string, a string, t string, d string")
    got = [r[0] for r in df.select(filenames.structured_filename("y", "a", "t", "d")).collect()]
    assert got == [_file_name(*row) for row in rows]


def test_structured_filename_nulls(value):
    none = F.lit(None).cast("string")
    assert value(filenames.structured_filename(none, none, none, none)) == (
        "NO_year_NO_author_NO_title_NO_doi.pdf"
    )
    assert value(filenames.sanitize_filename(F.lit("10.1/a(b)"))) == "10.1_a_b_.pdf"


@pytest.mark.parametrize(
    ("header", "final", "url", "fallback", "forced", "wanted"),
    [
        ('attachment; filename="a.pdf"', "http://x/b.pdf", "http://x/c.pdf", None, None, "a.pdf"),
        (None, "http://x/b.pdf?q=1", "http://x/c.pdf", None, None, "b.pdf"),
        ("", "", "http://x/c.PDF", None, None, "c.PDF"),
        (None, "http://x/view", "http://x/c.pdf", "f.pdf", None, "f.pdf"),
        (None, "http://x/view/", "http://x/c.pdf", None, None, None),
        ("filename=", "http://x/b.pdf", "u", None, None, "b.pdf"),
        ("filename=a.pdf", "http://x/b.pdf", "u", None, "z.pdf", "z.pdf"),
    ],
)
def test_resolve_filename(value, header, final, url, fallback, forced, wanted):
    columns = [F.lit(x).cast("string") for x in (header, final, url, fallback, forced)]
    assert value(filenames.resolve_pdf_filename(*columns)) == wanted


def test_stems(value):
    assert value(filenames.stem(F.lit("a.b.PDF"))) == "a.b"
    assert value(filenames.companion(F.lit("a.pdf"), "md")) == "a.md"
    assert value(filenames.search_id(F.lit("20260101-aa__results.csv"))) == "20260101-aa"
    assert value(filenames.search_id(F.lit("20260101-aa__filtered.csv"))) == "20260101-aa"
    assert value(filenames.search_id(F.lit("20260101-aa.yaml"))) == "20260101-aa"


NOTE = "<!--  Image has been removed. Keeping placeholder only -->"


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("a\r\n<!-- image -->\r\n\r\n\r\n\r\nb ", f"a\n{NOTE}\n\nb"),
        (" <!-- image: a chart -->\n![x](data:image/png;base64,AA==)\nrest", f"{NOTE}\n{NOTE}\nrest"),
        ("text <!-- image --> inline stays\n![a](http://x/y.png)", "text <!-- image --> inline stays\n![a](http://x/y.png)"),
        ("<!--image:-->\n<!-- image: a-b -->\n<!-- images -->", f"{NOTE}\n<!-- image: a-b -->\n<!-- images -->"),
        ("![](data:image/png;base64,AA)\t\n![a](data:image/;base64,AA)\n![a](data:image/x;base64,A) b", f"{NOTE}\n![a](data:image/;base64,AA)\n![a](data:image/x;base64,A) b"),
        ("  \n\n\n", ""),
        ("a\n![x](data:image/png;base64,AAAA\nBBBB==)\nb", f"a\n{NOTE}\nb"),
        ("<!--\nimage\n-->", NOTE),
        ("a\n<!-- image: x\ny -->\nb\n<!-- image\n: y -->", f"a\n{NOTE}\nb\n<!-- image\n: y -->"),
        ("![a\nb](data:image/x\ny;base64,A) \n![c](data:image/x;base64,A", f"{NOTE}\n![c](data:image/x;base64,A"),
        ("\u2028<!-- image -->\u2028x\r<!-- image -->", "<!-- image -->\u2028x\r<!-- image -->"),
    ],
)
def test_clean_markdown(value, raw, wanted):
    assert value(text.clean_markdown_images(F.lit(raw))) == wanted


def test_original_data_is_plain_json(spark):
    rows = [("D1", 'Ä "q" \\ \n\t/', None), ("D2", "", "b")]
    df = spark.createDataFrame(rows, "ID string, Title string, `Ab str` string")
    got = [r[0] for r in df.select(text.original_data("ID", ["Title", "Ab str"])).collect()]
    wanted = [json.dumps({"ID": i, "Title": t, "Ab str": a}, ensure_ascii=False) for i, t, a in rows]
    assert got == wanted
    hashes = [r[0] for r in df.select(text.sha256_hex(text.original_data("ID", ["Title", "Ab str"]))).collect()]
    assert hashes == [hashlib.sha256(w.encode()).hexdigest() for w in wanted]


def test_render_prompt(spark):
    template = "{{ title }}/{{abstract}}/{{ id }}/{{ Title }}/{{unknown}}/$1 \\d {{{{ x y }}"
    df = spark.createDataFrame([("D1", "T {{ id }} $0", None)], "ID string, Title string, Abstract string")
    rendered = render_prompt(F.lit(template), data_context("ID", ["Title", "Abstract"]))
    assert df.select(rendered).first()[0] == (
        "T {{ id }} $0//D1/{{ Title }}/{{ unknown }}/$1 \\d {{{{ x y }}"
    )


def test_template_text(value):
    assert value(template_text(F.lit("a\n\n"))) == "a\n"
    assert value(template_text(F.lit("a"))) == "a"


PARAMS = dict.fromkeys(
    ["temperature", "top_p", "max_tokens", "ollama_context_window", "ollama_repeat_penalty", "vllm_min_p",
     "vllm_best_of", "openai_seed", "gemini_thinking_level"]
)


@pytest.mark.parametrize(
    ("provider", "given_params", "wanted"),
    [
        ("Ollama", {"temperature": 0.7, "max_tokens": 5, "ollama_context_window": 9},
         {"temperature": 0.7, "extra_body": {"num_ctx": 9, "num_predict": 5}}),
        ("ollama", {"top_p": 1.0}, {"top_p": 1.0}),
        ("openai", {"max_tokens": 5, "openai_seed": 3, "vllm_best_of": 2},
         {"max_completion_tokens": 5, "seed": 3}),
        ("vllm", {"max_tokens": 5, "vllm_min_p": 0.1, "vllm_best_of": 2},
         {"max_tokens": 5, "extra_body": {"min_p": 0.1, "best_of": 2}}),
        ("gemini", {"max_tokens": 5, "gemini_thinking_level": "low"},
         {"max_tokens": 5, "extra_body": {"thinking_level": "low"}}),
        ("other", {"temperature": 0.1, "max_tokens": 5}, {"temperature": 0.1}),
    ],
)
def test_provider_request(spark, provider, given_params, wanted):
    kinds = ("double", "double", "int", "int", "double", "double", "int", "int", "string")
    schema = ", ".join(f"{n} {k}" for n, k in zip(PARAMS, kinds, strict=True))
    row = (*(PARAMS | given_params).values(), provider)
    df = spark.createDataFrame([row], f"{schema}, provider_name string")
    assert json.loads(df.select(requests.provider_request()).first()[0]) == wanted


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        ('{"best_oa_location": {"url_for_pdf": "http://x/a.pdf"}}', ("http://x/a.pdf", "ok")),
        ('{"best_oa_location": {"url_for_pdf": null}}', (None, "no_pdf")),
        ('{"best_oa_location": {"url_for_pdf": ""}}', (None, "no_pdf")),
        ('{"best_oa_location": null}', (None, "no_oa")),
        ('{"best_oa_location": {}}', (None, "no_oa")),
        ("{}", (None, "no_oa")),
        ("<html>", (None, "bad_json")),
        ("[]", (None, "bad_json")),
    ],
)
def test_parse_resolution(value, body, wanted):
    assert tuple(value(requests.parse_resolution(F.lit(body)))) == wanted


def test_raw_response(value):
    kept = F.to_json(F.struct(requests.raw_response(F.lit('{"eval_count": 3}')).alias("v")))
    assert json.loads(value(kept)) == {"v": {"eval_count": 3}}
    assert value(requests.raw_response(F.lit("[1]")).isNull()) is True
    assert value(requests.raw_response(F.lit("oops")).isNull()) is True


EN, FR = "the cat is in the house", "le chat est dans la maison pour une"


@pytest.mark.parametrize(
    ("title", "abstract", "wanted"),
    [(EN, EN, "en"), (EN, FR, "unclear"), (FR, None, "fr"), (None, EN, "en"), (" ", "", "unclear"),
     (None, None, "unclear"), ("xyz", "xyz", "unclear"), ("Der Hund und die Katze", "Das ist nicht mit", "de"),
     ("El perro", "los gatos para una casa y las", "es")],
)
def test_language(value, title, abstract, wanted):
    columns = [F.lit(x).cast("string") for x in (title, abstract)]
    assert value(detect_language(*columns)) == wanted


def test_language_counts_whole_words(value):
    assert value(detect_text(F.lit("thereof withthe theend"))) == "unclear"
    assert value(detect_text(F.lit("LA casa DE-la"))) == "fr"  # a tie goes to the earlier language


@pytest.mark.parametrize(
    ("query", "wanted"),
    [
        ("red cat", [0]),
        ("red -cat", [2]),
        ('"x-y z" | (cat + blue)', [1, 3]),
        ("cat AND NOT red", [1]),
        ("it's", [3]),
        ("cat -*", [0, 1]),
        ("red * cat", [0]),
        ("dog | -(red | cat)", [2, 3]),
    ],
)
def test_query_condition(spark, query, wanted):
    texts = ["red cat", "blue cat", "red dog", "x y z, it's"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, title string").withColumn("abstract", F.lit(None).cast("string"))
    assert sorted(r["ord"] for r in keyword_filter(df, query).collect()) == wanted


@pytest.mark.parametrize(
    ("query", "place"),
    [("c++", "at 2"), ("cat |", "at the end"), ("()", "at 1"), ("cat) | dog", "at 3"), ('a "b', "quote at 2"), ("(a", "bracket at 0"), ("-", "no words"), ("", "no words")],
)
def test_queries_that_cannot_be_read(query, place):
    with pytest.raises(ValueError, match=place):
        query_condition(query, F.lit(" a "))


def test_rebuild_abstract_at_odd_places(value):
    """A null position comes first, negative ones and the largest in their order."""
    index = F.from_json(F.lit('{"b": [2147483647, -2147483648], "a": [0, null], "c": [0]}'), "map<string, array<int>>")
    assert value(text.rebuild_abstract(index)) == "a b a c b"
    holes = F.from_json(F.lit('{"b": [1], "a": null}'), "map<string, array<int>>")
    assert value(text.rebuild_abstract(holes)) is None


@pytest.mark.parametrize("given", ["", "a", 'b "a" b\\ \n a  é "a"', "\t x \x01 x", " ", None])
def test_inverted_index_as_json(value, given):
    from litspark.plans import bindings

    index = value(bindings.inverted_index(F.lit(given).cast("string")))
    if given is None:
        assert index is None
        return
    wanted = {}
    for i, word in enumerate(given.split(" ")):
        wanted.setdefault(word, []).append(i)
    assert json.loads(index) == wanted and len(json.loads(index, object_pairs_hook=list)) == len(wanted)
