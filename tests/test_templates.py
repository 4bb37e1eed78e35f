import pytest

from litspark.functions.templates import TemplateError, compile_template, render_templates

KIND = """ID string, Title string, Year int, score double, flag boolean, tags array<string>,
    authors array<struct<Name: string, papers: array<int>>>, extra map<string,string>, nothing string"""
ROW = ("D1", 'A "b"', 2021, 1.5, True, ["x", None, "z"], [("Ada", [1, 2]), ("Bo", [])], {"k": "v"}, None)


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([ROW, ("D2", "", None, None, None, None, None, None, None)], KIND)


@pytest.mark.parametrize(
    ("template", "first", "second"),
    [
        ("plain { } {{ id }}\n", "plain { } D1", "plain { } D2"),
        ("a\n\n", "a\n", "a\n"),
        ("{{title}}|{{ nothing }}|{{ Title }}|{{ other.field }}", 'A "b"||{{ Title }}|{{ other.field }}', "||{{ Title }}|{{ other.field }}"),
        ("{% if year > 2020 and not nothing %}new{% elif year %}old{% else %}?{% endif %}", "new", "?"),
        ("{% if title == 'A \"b\"' or flag %}y{% endif %}", "y", ""),
        ("{{ flag }} {{ year + 1 }} {{ 7 // 2 * 3 - 10 % 4 }} {{ -year }} {{ score * 2 }}", "True 2022 7 -2021 3.0", "  7  "),
        ("{{ (1 + 2) * 3 }}{{ 'a' ~ 1 ~ nothing ~ 'b' }}{{ 'a' + 'b' }}", "9a1bab", "9a1bab"),
        ("{% for t in tags %}{{ loop.index }}{{ t }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", "1x,2,3z", "none"),
        (
            "{% for a in authors %}{{ loop.index0 }}/{{ loop.length }} {{ a.name }}{% for p in a.papers %} p{{ p }}{{ a.name|lower }}{% else %} -{% endfor %};{% endfor %}",
            "0/2 Ada p1ada p2ada;1/2 Bo -;",
            "",
        ),
        ("{{ tags|join('+') }} {{ tags|length }} {{ tags|first }} {{ title|last }} {{ tags[-1] }}{{ title[0] }}", 'x++z 3 x " zA', " 0   "),
        ("{{ nope|default('d') }} {{ nothing|default(year) }} {{ nope|upper }}", "d 2021 {{ nope }}", "d  {{ nope }}"),
        ("{{ 'b' in title }}{{ 'q' not in title }}{{ 'x' in tags }}{{ extra.k }}{{ extra['k'] }}", "TrueTrueTruevv", "FalseTrueFalse"),
        ("{{ nope is defined }}{{ year is none }}{{ year is not none }}", "FalseFalseTrue", "FalseTrueFalse"),
        ("a  {%- if true -%}  b  {%- endif %} c {#- no -#} d", "ab cd", "ab cd"),
        ("{{ 'it''s' if false else \"}} %}\" }}", None, None),
        ("{{ 'x' if flag else 'y' }}{{ 'x' if false }}{{ title.replace('b', 'c').lower() }}", 'xa "c"', "y"),
        ("{{ 'a;b;;c'.split(';')|join('|') }}{{ ' 12 '|trim|int + 1 }}{{ 'z'|int }}{{ 'hELLO'|capitalize }}", "a|b||c130Hello", "a|b||c130Hello"),
        ("{% for x in nope %}n{% endfor %}{% for x in nothing_at_all|default(tags) %}{{ x }}{% endfor %}", "xz", ""),
        ("{{ '\\n\\'' }}", "\n'", "\n'"),
        ("{{ (year or 7) % 5 }}{{ title or nope or 'none' }}{{ 1 and 'x' }}", '1A "b"x', "2nonex"),
        ("{% if title and false or nothing %}a{% else %}b{% endif %}{{ not (flag or 0) }}", "bFalse", "bTrue"),
    ],
)
def test_rendering(data, template, first, second):
    if first is None:
        with pytest.raises(TemplateError):
            compile_template(template, data)
        return
    rows = data.select("ID", compile_template(template, data).alias("t")).collect()
    assert {r.ID: r.t for r in rows} == {"D1": first, "D2": second}


@pytest.mark.parametrize(
    ("template", "place"),
    [
        ("{% if a %}\nx", "line 2, column 2: {% endif %}"),
        ("ab\n {{ a + }}", "line 2, column 9: an expression"),
        ("{{ a", "line 1, column 5: the tag is not closed"),
        ("{% while a %}", "line 1, column 1: the tag 'while'"),
        ("{{ a|nope }}", "line 1, column 6: 'nope'"),
        ("{{ title|join(1, 2, 3) }}", "'join' takes other arguments"),
        ("{% for x in year %}{% endfor %}", "a loop needs a list"),
        ("{{ year + title }}", "line 1, column 9: + needs two numbers"),
        ("{{ title < year }}", "needs two numbers or two texts"),
        ("{# open", "line 1, column 1: the comment"),
        ("{{ ? }}", "line 1, column 3: this mark"),
        ("{% if a }}", "'%}' is missing"),
    ],
)
def test_errors_name_the_place(data, template, place):
    with pytest.raises(TemplateError) as error:
        compile_template(template, data)
    assert place in str(error.value)


def test_each_row_its_own_template(data):
    out = render_templates(data, {"D1": "one {{ year }}", "D3": "x"}, "ID")
    assert [r[0] for r in data.select(out).collect()] == ["one 2021", None]
