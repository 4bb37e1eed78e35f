"""The same results as SQL for DuckDB over the data folder's tables."""

from __future__ import annotations

from litspark import schemas
from litspark.functions import language_model
from litspark.functions.language import PROFILES, UNCLEAR
from litspark.functions.text import IMAGE_REMOVED
from litspark.operators.inventory import PROJECT_INPUTS
from litspark.plans.bindings import MODELS, PARAMS, PROMPTS, PROVIDERS

SQL: dict[str, str] = {}

NL = "chr(10)"
SEARCHES = [f"src{i}" for i in range(20)]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def norm(expr: str) -> str:
    return rf"lower(trim(regexp_replace({expr}, '\s+', ' ', 'g')))"


def key(doi: str = "doi", title: str = "title") -> str:
    return (
        f"coalesce('doi:' || nullif({norm(doi)}, ''), 'title:' || nullif({norm(title)}, ''))"
    )


def part(expr: str, missing: str, shape: str = "{}") -> str:
    cleaned = rf"trim(regexp_replace({expr}, '[^\p{{L}}\p{{N}}\-_.]', '_', 'g'), '_')"
    return f"CASE WHEN trim(coalesce({expr}, '')) <> '' THEN {shape.format(cleaned)} ELSE '{missing}' END"


def title_case(expr: str) -> str:
    runs = rf"regexp_extract_all({expr}, '\p{{L}}+|[^\p{{L}}]+')"
    return (
        f"array_to_string(list_transform({runs}, "
        "lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || w[2:]), '')"
    )


def pdf_name(year: str, author: str, title: str, doi: str) -> str:
    title_shape = title_case("substr(lower({}), 1, 60)")
    # The braces of the pattern are doubled for the formatting of the part.
    title_shape = title_shape.replace(r"\p{L}", r"\p{{L}}")
    return " || '_' || ".join(
        [
            part(f"cast({year} AS VARCHAR)", "NO_year"),
            part(author, "NO_author"),
            part(title, "NO_title", title_shape),
            part(doi, "NO_doi", "lower({})"),
        ]
    ) + " || '.pdf'"


DOC_CTE = f"""
docs AS (
    SELECT doc_id, lang, source, n_chars, text,
        split_part(text, {NL}, 1) AS title,
        CASE WHEN contains(text, {NL}) THEN substr(text, strpos(text, {NL}) + 1) END AS rest,
        CASE WHEN doc_id % 17 <> 0 THEN 'Ada Q' || (doc_id % 13) END AS author1,
        'Bo ' || source AS author2,
        CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN '10.1/abc' || (doc_id % 187)
            ELSE '10.1/AbC' || (doc_id % 187) END AS doi,
        CASE WHEN doc_id % 11 <> 0 THEN CAST(2015 + doc_id % 11 AS INTEGER) END AS year
    FROM documents
)"""

PUB_CTE = f"""{DOC_CTE},
pubs AS (
    SELECT 'P' || doc_id AS search_engine_internal_id, year, title,
        concat_ws('; ', author1, author2) AS authors,
        CASE WHEN doc_id % 5 <> 0 THEN rest END AS abstract,
        doc_id % 4 = 0 AS "isOpenAccess", doi, lang AS language,
        CAST(n_chars % 100 AS INTEGER) AS "citationCount",
        CAST(n_chars % 7 AS INTEGER) AS "referenceCount",
        CASE WHEN doc_id % 2 = 0 THEN '{schemas.SOURCE_ENGINE_1}'
            ELSE '{schemas.SOURCE_ENGINE_2}' END AS entry_source,
        {pdf_name("year", "split_part(coalesce(author1, author2), ' ', 2)", "title", "doi")}
            AS pdf_filename,
        CAST(NULL AS VARCHAR) AS txt_filename, CAST(NULL AS VARCHAR) AS markdown_filename,
        doc_id % 7 = 0 AS pdf_downloaded, source AS search_id, doc_id AS ord, doc_id
    FROM docs
)"""

FILES_CTE = r"""
files AS (
    SELECT pdf_filename AS file_name FROM pubs WHERE ord % 2 = 0
    UNION SELECT regexp_replace(pdf_filename, '\.pdf$', '.txt') FROM pubs WHERE ord % 6 = 0
    UNION SELECT regexp_replace(pdf_filename, '\.pdf$', '.md') FROM pubs WHERE ord % 10 = 0
    UNION SELECT 'extra_' || ord || '.pdf' FROM pubs WHERE ord % 50 = 0
    UNION SELECT 'extra_' || ord || '.txt' FROM pubs WHERE ord % 100 = 0
)"""


def with_pubs(select: str) -> str:
    return f"WITH {PUB_CTE} {select}"


# Curation


def _present(column: str) -> str:
    return f"{column} IS NOT NULL AND trim(CAST({column} AS VARCHAR)) <> ''"


def _merged(source: str, role: str) -> str:
    firsts = ", ".join(
        f'arg_min("{c}", (search_id || \'__{role}.csv\', ord)) FILTER ({_present(chr(34) + c + chr(34))}) AS "{c}"'
        for c in schemas.RECORD_COLUMNS
    )
    flags = ", ".join(
        f"CAST(max(CASE WHEN search_id = '{s}' THEN 1 ELSE 0 END) AS INTEGER) AS {s}" for s in SEARCHES
    )
    place = "list_position((SELECT list(f ORDER BY f) FROM names), search_id || '__" + role + ".csv')"
    return f"""
    , names AS (SELECT DISTINCT search_id || '__{role}.csv' AS f FROM {source})
    SELECT {firsts}, CAST(count(DISTINCT search_id) - 1 AS INTEGER) AS duplicates_counter, {flags},
        CAST(min({place}) - 1 AS INTEGER) AS first_file,
        arg_min(ord, ({place}, ord)) AS first_row
    FROM {source} GROUP BY coalesce({key()}, 'row:' || search_id || ':' || ord)"""


SQL["merge_searches"] = with_pubs(_merged("pubs", "results"))
SQL["merge_filtered"] = with_pubs(
    ", kept AS (SELECT * FROM pubs WHERE language IS DISTINCT FROM 'fr')" + _merged("kept", "filtered")
)
SQL["dedup_keys"] = with_pubs(
    f"SELECT doc_id, {key()} AS dedup_key, coalesce(trim(doi), '') = '' AS no_doi, "
    f"{norm('title')} AS title_norm FROM pubs"
)
_CHAIN = [
    ("language=de", "language IS DISTINCT FROM 'de'"),
    (f"source={schemas.SOURCE_ENGINE_2}", f"entry_source IS DISTINCT FROM '{schemas.SOURCE_ENGINE_2}'"),
    ("doi=10.1/abc8", "doi IS DISTINCT FROM '10.1/abc8'"),
    ("downloaded", "pdf_downloaded"),
]
SQL["exclude_chain"] = with_pubs(
    "SELECT doc_id, search_id, language, doi FROM pubs WHERE "
    + " AND ".join(f"({c})" for _, c in _CHAIN)
)
SQL["exclude_audit"] = with_pubs(
    " UNION ALL ".join(
        f"SELECT search_id, {i + 1} AS step, '{label}' AS filter, "
        f"count(*) FILTER ({' AND '.join(f'({c})' for _, c in _CHAIN[:i]) or 'true'}) AS rows_in, "
        f"count(*) FILTER ({' AND '.join(f'({c})' for _, c in _CHAIN[: i + 1])}) AS rows_out "
        "FROM pubs GROUP BY search_id"
        for i, (label, _) in enumerate(_CHAIN)
    )
)
SQL["exclude_again"] = with_pubs(
    """
    , filtered AS (SELECT * FROM pubs WHERE search_id < 'src15' AND language <> 'en'),
    input AS (SELECT * FROM filtered UNION ALL SELECT * FROM pubs
        WHERE search_id NOT IN (SELECT search_id FROM pubs WHERE search_id < 'src15'))
    SELECT doc_id, search_id, language FROM input WHERE language <> 'fr'"""
)
SQL["exclude_emptied"] = with_pubs(
    "SELECT search_id, count(*) AS papers FROM pubs WHERE search_id <> 'src3' GROUP BY search_id"
)
SQL["keep_downloaded"] = with_pubs("SELECT doc_id, pdf_filename FROM pubs WHERE pdf_downloaded")
SQL["combine_engines"] = with_pubs(
    f"""
    , keyed AS (SELECT *, {key()} AS k FROM pubs),
    first_engine AS (SELECT * FROM keyed WHERE entry_source = '{schemas.SOURCE_ENGINE_1}'),
    second_engine AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn FROM keyed
        WHERE entry_source = '{schemas.SOURCE_ENGINE_2}')
    SELECT doc_id, doi, title, false AS is_new FROM first_engine
    UNION ALL SELECT doc_id, doi, title, true FROM second_engine
    WHERE k IS NULL OR (rn = 1 AND k NOT IN (SELECT k FROM first_engine WHERE k IS NOT NULL))"""
)

# Search

_HAY = r"' ' || regexp_replace(lower(concat_ws(' ', title, abstract)), '[^\p{L}\p{N}]+', ' ', 'g') || ' '"
_SEARCH = f"SELECT *, {_HAY} AS hay FROM pubs"
SQL["keyword_search"] = with_pubs(
    f"""SELECT doc_id, title FROM ({_SEARCH}) WHERE (contains(hay, ' the ') AND contains(hay, ' of the '))
    OR (contains(hay, ' que ') AND NOT contains(hay, ' de la ')) OR contains(hay, ' und ')"""
)
SQL["year_oa_search"] = with_pubs(
    'SELECT doc_id, year, "isOpenAccess" FROM pubs WHERE year BETWEEN 2017 AND 2021 AND "isOpenAccess"'
)
SQL["limited_search"] = with_pubs(
    f"""SELECT doc_id, year FROM ({_SEARCH}) WHERE year BETWEEN 2016 AND 2024
    AND (contains(hay, ' the ') OR contains(hay, ' la ')) ORDER BY ord LIMIT 150"""
)
SQL["search_truncated"] = with_pubs(
    f"""SELECT cap, max_rows, least(n, cap, coalesce(max_rows, cap)) AS papers,
        coalesce(max_rows, cap) >= cap AND n > cap AS truncated
    FROM (SELECT count(*) AS n FROM ({_SEARCH}) WHERE year BETWEEN 2016 AND 2024
        AND (contains(hay, ' the ') OR contains(hay, ' la '))),
        (VALUES (100::BIGINT, NULL::INTEGER), (100, 50), (1073741824, NULL)) v(cap, max_rows)"""
)
SQL["phrase_search"] = with_pubs(
    f"""SELECT doc_id FROM ({_SEARCH}) WHERE (contains(hay, ' of the ') OR contains(hay, ' de la '))
    AND NOT (contains(hay, ' und ') AND contains(hay, ' der '))"""
)
SQL["selected_half"] = with_pubs(
    """SELECT doc_id, year FROM (SELECT *, row_number() OVER (ORDER BY year DESC NULLS LAST, title NULLS LAST, ord) AS place FROM pubs)
    WHERE place <= (SELECT count(*) // 2 FROM documents)"""
)
_MANY = f""", found AS (SELECT *, coalesce({key()}, 'row:' || s || ':' || ord) AS merge_key FROM (
        SELECT p.* EXCLUDE (search_id), printf('s%04d', (ord * k) % 5000) AS s FROM pubs p, (VALUES (1), (37), (1009)) v(k)))"""
SQL["merge_5000_searches"] = with_pubs(
    _MANY
    + """, firsts AS (SELECT merge_key, arg_min(title, (s, ord)) AS title, arg_min(pdf_filename, (s, ord)) AS pdf_filename,
        CAST(count(DISTINCT s) - 1 AS INTEGER) AS duplicates_counter FROM found GROUP BY merge_key)
    SELECT DISTINCT merge_key, s AS search_id, f.title, f.pdf_filename, duplicates_counter FROM found JOIN firsts f USING (merge_key)"""
)
SQL["searches_together"] = with_pubs(
    _MANY
    + """, groups AS (SELECT DISTINCT s, s[1:4] AS name FROM found),
    per_key AS (SELECT name, merge_key, count(DISTINCT s) AS n FROM found JOIN groups USING (s) GROUP BY ALL)
    SELECT name, count(*) AS found_by_any, count(*) FILTER (n = size) AS found_by_all
    FROM per_key JOIN (SELECT name, count(*) AS size FROM groups GROUP BY name) USING (name) GROUP BY name"""
)
SQL["listed_by_tasks"] = "SELECT DISTINCT 'lang=' || lang AS lang, 'source=' || source AS source, true AS same FROM documents"
SQL["index_search"] = with_pubs(
    f"""SELECT query, doc_id FROM ({_SEARCH}), (VALUES ('keywords'), ('phrases'), ('rare'), ('without'), ('absent')) q(query)
    WHERE CASE query
        WHEN 'keywords' THEN (contains(hay, ' the ') AND contains(hay, ' of the '))
            OR (contains(hay, ' que ') AND NOT contains(hay, ' de la ')) OR contains(hay, ' und ')
        WHEN 'phrases' THEN (contains(hay, ' of the ') OR contains(hay, ' de la '))
            AND NOT (contains(hay, ' und ') AND contains(hay, ' der '))
        WHEN 'rare' THEN contains(hay, ' the of ') OR contains(hay, ' la de la ')
        WHEN 'without' THEN NOT contains(hay, ' the ') AND NOT contains(hay, ' la ')
            AND NOT (contains(hay, ' und ') OR contains(hay, ' de '))
        ELSE contains(hay, ' qqqq ') END"""
)
SQL["query_notation"] = with_pubs(
    r"""SELECT doc_id, array_to_string(list_transform(
            string_split(regexp_replace(title, '[^\p{L} ]', '', 'g'), ' '),
            lambda w: CASE WHEN w = '' THEN '-' ELSE 'NOT ' || w END), ' AND ') || ' OR state-of-art' AS translated,
        year AS year_from, CASE WHEN ord % 2 = 0 THEN year + 3 ELSE year END AS year_to FROM pubs"""
)
_CONFIGS = """, configs AS (SELECT search_id, min(title) AS query,
    CASE WHEN CAST(substr(search_id, 4) AS INTEGER) % 3 <> 0 THEN '2019-2023' END AS year,
    CASE WHEN CAST(substr(search_id, 4) AS INTEGER) % 2 <> 0 THEN true END AS oa
    FROM pubs GROUP BY search_id)"""
SQL["search_configs"] = with_pubs(
    f"""{_CONFIGS} SELECT search_id, query, coalesce(year, '{schemas.DEFAULT_YEARS}') AS year,
    coalesce(oa, false) AS "onlyOpenAccess" FROM configs"""
)

# Language


def score(tokens: str, lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in PROFILES[lang])
    return f"len(list_filter({tokens}, lambda w: w IN ({words})))"


def lang_cte(name: str, source: str, columns: dict[str, str], keep: str) -> str:
    """CTEs that add the language of each expression as ``lang_<name>``."""
    tokens = ", ".join(
        rf"string_split_regex(lower({expr}), '[^\p{{L}}]+') AS tok_{c}" for c, expr in columns.items()
    )
    scores = ", ".join(f"{score(f'tok_{c}', lang)} AS {c}_{lang}" for c in columns for lang in PROFILES)

    def pick(c: str) -> str:
        best = "greatest(" + ", ".join(f"{c}_{lang}" for lang in PROFILES) + ")"
        cases = " ".join(f"WHEN {c}_{lang} = {best} THEN '{lang}'" for lang in PROFILES)
        return f"CASE WHEN coalesce({best}, 0) = 0 THEN '{UNCLEAR}' {cases} END AS lang_{c}"

    picks = ", ".join(pick(c) for c in columns)
    return f"""
    {name}_tok AS (SELECT {keep}, {tokens} FROM {source}),
    {name}_score AS (SELECT {keep}, {scores} FROM {name}_tok),
    {name} AS (SELECT {keep}, {picks} FROM {name}_score)"""


def publication_language(abstract: str, source: str) -> str:
    ctes = lang_cte(
        "spoken", source, {"t": "title", "a": abstract, "j": f"concat_ws(' ', title, {abstract})"}, "doc_id"
    )
    return f"""{ctes},
    languages AS (SELECT s.doc_id, CASE WHEN trim(coalesce(d.title, '')) <> '' AND trim(coalesce({abstract}, '')) <> ''
        THEN CASE WHEN lang_t = lang_a THEN lang_t ELSE '{UNCLEAR}' END ELSE lang_j END AS detected
        FROM spoken s JOIN {source} d USING (doc_id))"""


SQL["detect_languages"] = with_pubs(
    "," + publication_language("abstract", "pubs") + " SELECT doc_id, detected FROM languages"
)
SQL["language_agreement"] = (
    "WITH " + lang_cte("spoken", "documents", {"x": "text"}, "doc_id, lang")
    + " SELECT lang, lang_x AS detected, count(*) AS documents FROM spoken GROUP BY ALL"
)

# Response pages

_ABSTRACT = "CASE WHEN doc_id % 5 <> 0 THEN rest END"


def _flattened(engine: int) -> str:
    first = engine == 1
    author = "split_part(coalesce(author1, author2), ' ', 2)"
    joined = "coalesce(author1, '') || '; ' || author2" if first else "concat_ws('; ', author1, author2)"
    references = (
        "CAST(n_chars % 7 AS INTEGER)"
        if first
        else "CAST(CASE WHEN doc_id % 13 = 0 THEN 0 ELSE doc_id % 7 END AS INTEGER)"
    )
    name = schemas.SOURCE_ENGINE_1 if first else schemas.SOURCE_ENGINE_2
    abstract = "abstract" if first else "nullif(abstract, '')"
    return f"""WITH {DOC_CTE}, works AS (SELECT *, {_ABSTRACT} AS abstract FROM docs),
    {publication_language("abstract", "works")}
    SELECT '{'P' if first else 'W'}' || doc_id AS search_engine_internal_id, year, title,
        {joined} AS authors, {abstract} AS abstract, doc_id % 4 = 0 AS "isOpenAccess", doi,
        detected AS language, CAST(n_chars % 100 AS INTEGER) AS "citationCount",
        {references} AS "referenceCount", '{name}' AS entry_source,
        {pdf_name("year", author, "title", "doi")} AS pdf_filename, false AS pdf_downloaded
    FROM works JOIN languages USING (doc_id)"""


SQL["flatten_engine1"] = _flattened(1)
SQL["flatten_engine2"] = _flattened(2)
SQL["stream_pages"] = _flattened(1)
SQL["raw_pages_round_trip"] = _flattened(1)
SQL["raw_pages_array"] = _flattened(1)
SQL["raw_pages_broken"] = """
    SELECT 'works' AS kind, count(*) FILTER (doc_id // 100 % 3 <> 1) AS n FROM documents
    UNION ALL SELECT 'rejected', count(DISTINCT doc_id // 100) FILTER (doc_id // 100 % 3 = 1) FROM documents"""
SQL["union_engines"] = f"""WITH {DOC_CTE}
    SELECT '{schemas.SOURCE_ENGINE_1}' AS entry_source, year, count(*) AS papers,
        CAST(sum(n_chars % 7) AS BIGINT) AS "references" FROM docs GROUP BY year
    UNION ALL SELECT '{schemas.SOURCE_ENGINE_2}', year, count(*),
        CAST(sum(CASE WHEN doc_id % 13 = 0 THEN 0 ELSE doc_id % 7 END) AS BIGINT) FROM docs GROUP BY year"""


def duration(seconds: str) -> str:
    s = f"CAST(trunc(coalesce({seconds}, 0)) AS BIGINT)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, {s} // 60 % 60, {s} % 60)"


SQL["structured_filenames"] = with_pubs(
    rf"""SELECT doc_id, pdf_filename,
        regexp_replace(doi, '[^\p{{L}}\p{{N}}\-_.]', '_', 'g') || '.pdf' AS doi_filename,
        regexp_replace(pdf_filename, '\.pdf$', '.txt') AS txt_name,
        translate(concat_ws(':', search_id, doi), '/:', '--') AS safe,
        printf('P%02d', ord) AS code,
        {duration("CASE WHEN ord % 9 <> 0 THEN ord * 61 END")} AS duration FROM pubs"""
)

# Statistics

_GRAMS = ", ".join(
    f"list_transform(range({1 + (n == 1)}, length(p) - {max(n - 2, 0)}), lambda i: substr(p, i, {n}))"
    for n in range(1, language_model.LONGEST + 1)
)


def _split(part: str, text: str, table: str) -> str:
    return rf"SELECT doc_id, '{part}' AS part, unnest(regexp_split_to_array(lower({text}), '[^\p{{L}}]+')) AS word FROM {table}"


SQL["template_prompts"] = with_pubs(
    f"""SELECT doc_id, ({listed(["brief", "people", "figures"])})[doc_id % 3 + 1] AS prompt_id, CASE doc_id % 3
        WHEN 0 THEN CASE WHEN coalesce(abstract, '') <> '' AND year IS NOT NULL
                THEN 'Summarize "' || trim(lower(title)) || '" (P' || doc_id || ', ' || year || '):' || {NL} || rtrim(abstract || {NL}, {NL} || ' ')
            WHEN coalesce(abstract, '') = '' THEN 'No abstract: ' || title ELSE 'Undated: ' || title[1] || title[-1] END || '.'
        WHEN 1 THEN array_to_string(list_transform(string_split(authors, '; '), lambda a, i: i || '/' || len(string_split(authors, '; '))
                || ' ' || CASE WHEN starts_with(a, 'Ada') THEN upper(a) ELSE a END), ', ')
            || CASE WHEN "isOpenAccess" AND year >= 2020 THEN ' ! ' ELSE ' ? ' END || '{{{{ tone }}}}'
        ELSE coalesce(year, 2000) % 7 + "referenceCount" * 2 || '|' || replace(coalesce(doi, 'no DOI'), '10.1/', '') || '|' || length(title)
            || '|' || CASE WHEN contains(language, 'en') OR language = 'de' THEN 'True' ELSE 'False' END || '-' END AS prompt FROM pubs"""
)
SQL["fitted_languages"] = with_pubs(
    rf""", asked AS (SELECT * FROM ({_split("text", "text", "documents")} UNION ALL {_split("title", "title", "pubs")}
        UNION ALL {_split("abstract", "abstract", "pubs")}) WHERE word <> ''),
    words AS (SELECT lang, word, count(*) AS n FROM asked JOIN documents USING (doc_id) WHERE part = 'text' GROUP BY ALL),
    grams AS (SELECT word, unnest(list_concat({_GRAMS})) AS gram FROM (SELECT DISTINCT word, ' ' || word || ' ' AS p FROM words)),
    counts AS (SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM words JOIN grams USING (word) WHERE lang IS NOT NULL GROUP BY ALL),
    chosen AS (SELECT DISTINCT gram FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM counts)
        WHERE r <= {language_model.TOP}),
    totals AS (SELECT lang, CAST(sum(n) AS DOUBLE) AS total FROM counts GROUP BY lang),
    model AS (SELECT a.gram, t.lang, CAST(round(ln(((coalesce(c.n, 0) + 0.5::DOUBLE) / (t.total + 1))
            / ((a.n - coalesce(c.n, 0) + 0.5::DOUBLE) / (s.total - t.total + 1))) * 1000) AS INTEGER) AS weight
        FROM (SELECT gram, CAST(sum(n) AS DOUBLE) AS n FROM counts SEMI JOIN chosen USING (gram) GROUP BY gram) a
        CROSS JOIN totals t CROSS JOIN (SELECT sum(total) AS total FROM totals) s
        LEFT JOIN counts c ON c.gram = a.gram AND c.lang = t.lang),
    per_word AS (SELECT word, lang, sum(weight) AS score, count(*) AS known FROM grams JOIN model USING (gram) GROUP BY ALL),
    scores AS (SELECT doc_id, part, lang, sum(score) AS score, sum(known) AS known FROM asked JOIN per_word USING (word) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER best AS r, score - lead(score) OVER best AS ahead FROM scores
        WINDOW best AS (PARTITION BY doc_id, part ORDER BY score DESC, lang)),
    parts AS (SELECT doc_id, 'text' AS part FROM documents
        UNION ALL SELECT doc_id, 'title' FROM pubs WHERE trim(title) <> '' UNION ALL SELECT doc_id, 'abstract' FROM pubs WHERE trim(abstract) <> ''),
    told AS (SELECT p.doc_id, p.part, CASE WHEN ahead >= {language_model.MARGIN} * known THEN lang ELSE '{UNCLEAR}' END AS answer
        FROM parts p LEFT JOIN ranked k ON k.doc_id = p.doc_id AND k.part = p.part AND k.r = 1),
    agreed AS (SELECT doc_id, CASE WHEN count(DISTINCT answer) = 1 THEN min(answer) ELSE '{UNCLEAR}' END AS agreed
        FROM told WHERE part <> 'text' GROUP BY doc_id)
    SELECT d.doc_id, d.lang, t.answer AS detected, coalesce(a.agreed, '{UNCLEAR}') AS agreed FROM documents d
    JOIN told t ON t.doc_id = d.doc_id AND t.part = 'text' LEFT JOIN agreed a ON a.doc_id = d.doc_id"""
)
SQL["papers_by_year"] = with_pubs(
    """SELECT year, count(*) AS count,
    round_even(count(*) / sum(count(*)) OVER () * 100, 1) AS pct FROM pubs WHERE year IS NOT NULL GROUP BY year"""
)


def _breakdown(source: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""

    def fact(stat: str, value: str, count: str) -> str:
        return f"SELECT {keys}'{stat}' AS stat, '{value}' AS value, {count} AS count FROM {source} {group}"

    facts = [
        fact("Total", "papers", "count(*)"),
        fact("Open Access", "True", 'count(*) FILTER ("isOpenAccess")'),
        f"SELECT {keys}'Entry Source', coalesce(entry_source, ''), count(*) FROM {source} GROUP BY ALL",
        f"SELECT {keys}'Language', language, count(*) FROM {source} WHERE language IS NOT NULL GROUP BY ALL",
    ]
    for stat, test in (
        ("PDF", "coalesce(pdf_downloaded, false)"),
        ("TXT", "coalesce(trim(txt_filename), '') <> ''"),
        ("Markdown", "coalesce(trim(markdown_filename), '') <> ''"),
    ):
        facts.append(fact(stat, "existing", f"count(*) FILTER ({test})"))
        facts.append(fact(stat, "missing", f"count(*) FILTER (NOT ({test}))"))
    union = " UNION ALL ".join(facts)
    over = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {keys}stat, value, count, round_even(count /
        max(CASE WHEN stat = 'Total' THEN count END) OVER ({over}) * 100, 1) AS pct FROM ({union})"""


# Files

_SYNCED = r"""
synced AS (
    SELECT *, regexp_replace(pdf_filename, '\.pdf$', '') AS stem,
        pdf_filename IN (SELECT file_name FROM files) AS has_pdf,
        regexp_replace(pdf_filename, '\.pdf$', '.txt') IN (SELECT file_name FROM files) AS has_txt,
        regexp_replace(pdf_filename, '\.pdf$', '.md') IN (SELECT file_name FROM files) AS has_md
    FROM pubs
),
after AS (
    SELECT * REPLACE (pdf_downloaded OR has_pdf AS pdf_downloaded,
        CASE WHEN has_txt THEN stem || '.txt' END AS txt_filename,
        CASE WHEN has_md THEN stem || '.md' END AS markdown_filename),
        (has_pdf AND NOT pdf_downloaded) OR has_txt OR has_md AS changed
    FROM synced
)"""
_EXTRA = """SELECT file_name AS pdf_filename, true AS pdf_downloaded,
    'manually added' AS entry_source,
    CASE WHEN replace(file_name, '.pdf', '.txt') IN (SELECT file_name FROM files)
        THEN replace(file_name, '.pdf', '.txt') END AS txt_filename,
    CASE WHEN replace(file_name, '.pdf', '.md') IN (SELECT file_name FROM files)
        THEN replace(file_name, '.pdf', '.md') END AS markdown_filename
    FROM files WHERE file_name LIKE '%.pdf' AND file_name NOT IN (SELECT pdf_filename FROM pubs)"""


def with_files(select: str) -> str:
    return f"WITH {PUB_CTE}, {FILES_CTE}, {_SYNCED} {select}"


SQL["stats_breakdown"] = with_files(_breakdown("after"))
SQL["stats_by_role"] = with_pubs(
    f""", merged AS (SELECT * FROM ({_merged("pubs", "results").replace(", names AS", "WITH names AS", 1).strip()})),
    tables AS (
        SELECT 'results' AS role, entry_source, language, "isOpenAccess", pdf_downloaded, txt_filename, markdown_filename FROM pubs
        UNION ALL SELECT 'filtered', entry_source, language, "isOpenAccess", pdf_downloaded, txt_filename, markdown_filename
            FROM pubs WHERE language IS DISTINCT FROM 'de'
        UNION ALL SELECT 'merged', entry_source, language, "isOpenAccess", pdf_downloaded, txt_filename, markdown_filename FROM merged)
    {_breakdown("tables", "role")}"""
)
SQL["sync_inventory"] = with_files(
    "SELECT doc_id, pdf_downloaded, txt_filename, markdown_filename, changed FROM after"
)
SQL["sync_extra_files"] = with_files(_EXTRA)
SQL["sync_counts"] = with_files(
    f"""SELECT (SELECT count(*) FROM after WHERE changed) AS updated,
    (SELECT count(*) FROM ({_EXTRA})) AS added"""
)
_PLAN = """
resolved AS (
    SELECT ord, doi, title, pdf_filename, ord % 23 = 1 AS failed,
        pdf_filename IN (SELECT file_name FROM files) AS there,
        CASE WHEN n % 5 = 0 THEN 'no_oa' WHEN n % 5 = 1 THEN 'no_pdf' WHEN n % 10 = 2 THEN 'bad_json'
            ELSE 'ok' END AS resolution,
        CASE WHEN n % 5 >= 2 AND n % 10 <> 2 THEN 'https://files.example.org/' || n || '.pdf' END AS pdf_url
    FROM (SELECT *, ord % 187 AS n FROM pubs WHERE doi IS NOT NULL)
),
firsts AS (
    SELECT *, min(CASE WHEN resolution = 'ok' AND NOT there AND NOT failed THEN ord END)
        OVER (PARTITION BY pdf_filename) AS first_ord FROM resolved
),
plan AS (
    SELECT ord AS doc_id, doi, title, pdf_url, pdf_filename, resolution,
        CASE WHEN resolution <> 'ok' THEN 'skipped' WHEN there OR ord > first_ord THEN 'exists'
            WHEN failed THEN 'failed' ELSE 'succeeded' END AS outcome FROM firsts
)"""
_DOWNLOADS = f"WITH {PUB_CTE}, {FILES_CTE}, {_PLAN}"
SQL["download_plan"] = (
    f"{_DOWNLOADS} SELECT doc_id, doi, pdf_url, pdf_filename, resolution, outcome FROM plan"
)
SQL["download_outcomes"] = f"{_DOWNLOADS} SELECT outcome, count(*) AS count FROM plan GROUP BY outcome"
SQL["download_failures"] = f"""{_DOWNLOADS} SELECT doi, title, pdf_url AS url, pdf_filename,
    outcome = 'exists' AS pdf_downloaded FROM plan WHERE outcome <> 'succeeded'"""
_URL_NAME = r"regexp_extract(regexp_replace(split_part(url, '?', 1), '/+$', ''), '[^/]*$')"
SQL["resolve_filenames"] = f"""
    WITH found AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'doc ' || page_id || '.PDF'
        WHEN page_id % 2 = 0 THEN CASE WHEN contains(url, '?') THEN {_URL_NAME} ELSE 'a.pdf' END
        ELSE {_URL_NAME} END AS name FROM pages)
    SELECT page_id, CASE WHEN lower(name) LIKE '%.pdf' THEN name
        WHEN page_id % 5 <> 0 THEN 'page_' || page_id || '.pdf' END AS file_name,
        'given.pdf' AS forced FROM found"""
_EXTRACTED = """SELECT page_id, 'page_' || page_id || '.pdf' AS file_name,
    CASE WHEN page_id % 20 = 0 THEN NULL WHEN page_id % 20 = 5 THEN NULL
        ELSE regexp_replace(html, '<[^>]*>', ' ', 'g') END AS text,
    CASE WHEN page_id % 20 = 0 THEN 'skipped' WHEN page_id % 20 = 5 THEN 'error'
        ELSE 'extracted' END AS outcome FROM pages"""
SQL["extract_documents"] = f"SELECT file_name, text, outcome FROM ({_EXTRACTED})"
SQL["extract_outcomes"] = f"""SELECT CASE WHEN page_id % 4 = 3 OR page_id % 9 = 0 THEN 'existing'
    ELSE outcome END AS outcome, count(*) AS count FROM ({_EXTRACTED}) GROUP BY 1"""
SQL["add_papers"] = with_files(
    """, sources AS (SELECT CASE WHEN page_id % 7 = 0 THEN '/in/notes.html'
        WHEN page_id % 4 = 0 THEN '/in/' || page_id || '/extra_' || page_id || '.pdf'
        ELSE '/in/page_' || page_id || '.PDF' END AS path FROM pages)
    SELECT path, CASE WHEN split_part(path, '/', -1) IN (SELECT file_name FROM files) THEN 'exists'
        ELSE 'copied' END AS outcome FROM sources WHERE lower(path) LIKE '%.pdf'"""
)
_MARK = quoted(IMAGE_REMOVED)
SQL["clean_markdown"] = rf"""
    SELECT doc_id, trim(regexp_replace(CASE
        WHEN doc_id % 3 = 0 THEN replace(text, {NL}, {NL} || {_MARK} || {NL} || {NL} || {NL})
        WHEN doc_id % 3 = 1 THEN replace(text, {NL}, {NL} || {_MARK} || {_MARK})
        ELSE text END, '\n{{3,}}', {NL} || {NL}, 'g'), chr(10) || ' ') AS cleaned FROM documents"""
SQL["search_list"] = with_pubs(
    """SELECT search_id, bool_or(coalesce(year BETWEEN 2015 AND 2016 AND "isOpenAccess", false)) AS has_results
    FROM pubs GROUP BY search_id"""
)
_PROJECTS = f"""WITH project_files AS (SELECT source || '-' || lang AS project, CASE
    WHEN doc_id % 6 < 4 THEN ({listed(list(PROJECT_INPUTS))})[doc_id % 6 + 1]
    WHEN doc_id % 6 = 4 THEN printf('experiment_20260101_%02d.db', doc_id // 20 % 100)
    ELSE 'note_' || doc_id || '.txt' END AS file_name, doc_id FROM documents)"""
SQL["project_list"] = f"""{_PROJECTS} SELECT project, min(doc_id) * 60 AS created,
    count(DISTINCT file_name) FILTER (file_name IN ({listed(list(PROJECT_INPUTS))[1:-1]})) = 4 AS initialized
    FROM project_files GROUP BY project"""
SQL["project_snapshots"] = f"""{_PROJECTS} SELECT DISTINCT project, file_name FROM project_files
    WHERE file_name LIKE 'experiment%.db'"""
_TOP = "coalesce((SELECT max(CAST(substr(file_name, 21, length(file_name) - 23) AS INTEGER)) FROM project_files WHERE file_name LIKE 'experiment%.db'), 0)"
SQL["next_snapshot"] = f"""{_PROJECTS}, top AS (SELECT {_TOP} AS n)
    SELECT 'next' AS kind, printf('experiment_20260301_%02d.db', n + 1) AS file_name FROM top
    UNION ALL SELECT 'latest', printf('experiment_20260101_%02d.db', n) FROM top
    UNION ALL SELECT 'backup', printf('data_backup_20260101_%02d.csv', n + 1) FROM top
    UNION ALL SELECT 'new day', 'data_backup_20260102_01.csv'"""

# Experiments

_RANK = {name: i for i, (name, *_rest) in enumerate(MODELS)}
_PAIRS = ", ".join(
    f"({i}, {quoted(p[1])}, {quoted(MODELS[_RANK[p[1]]][1].lower())}, {quoted(p[2])}, "
    f"{'NULL' if p[3] is None else p[3]}, {'NULL' if p[5] is None else p[5]})"
    for i, p in enumerate(sorted((p for p in PARAMS if p[1] in _RANK), key=lambda p: (_RANK[p[1]], p[-1])))
)


def sql_prompt(template: str) -> str:
    text = quoted(template)
    for slot, column in (("title", "title"), ("abstract", "coalesce(rest, '')"), ("id", "data_id")):
        for form in ("{{ " + slot + " }}", "{{" + slot + "}}"):
            text = text.replace(form, f"' || {column} || '")
    return text


def sql_json(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'null' ELSE CAST(to_json({expr}) AS VARCHAR) END"


_GRID = f"""WITH {DOC_CTE},
mapped AS (
    SELECT doc_id * 10 AS ord, 'prompt01' AS prompt_id, doc_id FROM docs
    UNION ALL SELECT doc_id * 10 + 1, 'prompt02', doc_id FROM docs WHERE doc_id % 2 = 0
),
numbered AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS map_idx FROM mapped),
rendered AS (
    SELECT map_idx, prompt_id, 'D' || doc_id AS data_id,
        CASE prompt_id WHEN 'prompt01' THEN {sql_prompt(PROMPTS[0][1])}
            ELSE {sql_prompt(PROMPTS[1][1])} END AS prompt,
        '{{"ID": "D' || doc_id || '", "Title": ' || {sql_json("title")} || ', "Abstract": '
            || {sql_json("rest")} || '}}' AS original_data
    FROM numbered JOIN (SELECT doc_id, title, rest, 'D' || doc_id AS data_id FROM docs) USING (doc_id)
),
pairs(pair_idx, model_name, provider, profile_name, temperature, max_tokens) AS (VALUES {_PAIRS}),
grid AS (
    SELECT row_number() OVER (ORDER BY (SELECT min(q.pair_idx) FROM pairs q WHERE q.model_name = p.model_name),
            map_idx, pair_idx) AS "ID",
        data_id || '_' || prompt_id || '_' || model_name || '_' || profile_name AS code,
        CAST(length(prompt) // 4 AS INTEGER) AS tokens_estimate, model_name, provider,
        CAST(temperature AS DOUBLE) AS temperature, CAST(max_tokens AS INTEGER) AS max_tokens,
        sha256(prompt) AS prompt_hash, sha256(original_data) AS original_data_hash
    FROM rendered, pairs p
)"""
SQL["generate_grid"] = f"{_GRID} SELECT * FROM grid"
SQL["generate_unmatched"] = """
    SELECT doc_id * 10 + 2 AS ord, 'data_id' AS kind, 'X' || doc_id AS missing_id FROM documents WHERE doc_id % 97 = 0
    UNION ALL SELECT doc_id * 10 + 3, 'prompt_id', 'prompt99' FROM documents WHERE doc_id % 97 = 0"""
SQL["grid_ids"] = f"""{_GRID} SELECT model_name, min("ID") AS first_id, max("ID") AS last_id,
    count(DISTINCT "ID") AS ids FROM grid GROUP BY model_name"""
SQL["provider_tables"] = f"""{_GRID} SELECT "ID", code,
    CASE WHEN code LIKE '%_base' THEN 4096 END AS ollama_context_window,
    CASE WHEN code LIKE '%_base' THEN CAST(1.1 AS DOUBLE) END AS ollama_repeat_penalty,
    CAST(NULL AS VARCHAR) AS status, prompt_hash FROM grid WHERE provider = 'ollama'"""
_ROWS = f"""rows_in AS (
    SELECT doc_id, doc_id + 1 AS "ID", ({listed(PROVIDERS)})[doc_id % 4 + 1] AS provider,
        ({listed([m[0] for m in MODELS])})[doc_id % 4 + 1] AS model_name, text AS prompt,
        'D' || doc_id || '_prompt01_' || ({listed([m[0] for m in MODELS])})[doc_id % 4 + 1] || '_base' AS code,
        CASE WHEN doc_id % 6 = 0 THEN 'success' WHEN doc_id % 6 = 1 THEN 'Error: before' END AS status,
        CASE WHEN doc_id % 6 = 0 THEN 'kept' END AS response_text,
        CASE WHEN doc_id % 6 = 0 THEN 7 END AS usage_tokens,
        CASE WHEN doc_id % 6 = 0 THEN 7 END AS total_tokens,
        CASE WHEN doc_id % 6 < 2 THEN 1 END AS call_count
    FROM documents
),
called AS (
    SELECT provider, "ID", starts_with(md5(prompt), '0') AS bad, length(prompt) AS size, call_count AS calls, model_name
    FROM rows_in
),
answers AS (
    SELECT provider, "ID", CASE WHEN bad THEN '' ELSE model_name || ' read ' || size || ' characters' END AS response_text,
        CASE WHEN NOT bad THEN CAST(size // 4 AS INTEGER) END AS usage_tokens,
        CASE WHEN bad THEN 'Error: refused' ELSE 'success' END AS status,
        CASE WHEN bad THEN 'error' ELSE 'finished' END AS state,
        CAST(coalesce(calls, 0) + 1 AS INTEGER) AS call_count,
        CASE WHEN bad THEN 0 ELSE CAST(size // 4 AS INTEGER) END AS total_tokens FROM called
)"""
_EVEN = "doc_id % 3 <> 0"
SQL["provider_requests"] = f"""WITH {_ROWS} SELECT "ID", provider, CASE doc_id % 4
    WHEN 0 THEN '{{"temperature":0.7,"top_p":0.9,"extra_body":{{' ||
        CASE WHEN {_EVEN} THEN '"num_ctx":4096,"num_predict":256,"repeat_penalty":1.1' ELSE '"num_predict":256' END || '}}}}'
    WHEN 1 THEN '{{"temperature":0.5,"top_p":0.8' ||
        CASE WHEN {_EVEN} THEN '' ELSE ',"extra_body":{{"min_p":0.05,"best_of":2}}' END || '}}'
    WHEN 2 THEN '{{"temperature":0.2,"max_completion_tokens":512,"seed":42}}'
    ELSE '{{"top_p":0.95,"max_tokens":64' ||
        CASE WHEN {_EVEN} THEN ',"extra_body":{{"thinking_level":"low"}}' ELSE '' END || '}}'
    END AS request FROM rows_in"""
SQL["copy_papers"] = """
    WITH versions AS (
        SELECT 'paper' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS filename,
            CASE WHEN doc_id % 2 = 0 THEN upper(replace(text, 'ß', 'SS')) ELSE text END AS content
        FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0)
    SELECT printf('P%02d', row_number() OVER (ORDER BY filename)) AS "ID", filename, content FROM versions"""
SQL["copy_search"] = with_pubs(
    """SELECT printf('S%02d', row_number() OVER (ORDER BY search_id, ord)) AS "ID", title AS "Title",
    coalesce(abstract, '') AS "Abstract", coalesce(doi, '') AS doi, authors FROM pubs"""
)

# Runs

_VALUES = "response_text, usage_tokens, status, state, call_count, total_tokens"
SQL["run_offline"] = f'WITH {_ROWS} SELECT provider, "ID", {_VALUES} FROM answers'
SQL["resume_pending"] = f"""WITH {_ROWS} SELECT provider, "ID", a.status, a.call_count FROM answers a
    JOIN rows_in r USING (provider, "ID") WHERE r.status IS DISTINCT FROM 'success'"""
SQL["merge_results"] = f"""WITH {_ROWS} SELECT code, provider, "ID",
    {", ".join(f"CASE WHEN r.status = 'success' THEN {'NULL' if c == 'state' else 'r.' + c} ELSE a.{c} END AS {c}"
               for c in _VALUES.split(", "))}
    FROM rows_in r JOIN answers a USING (provider, "ID")"""
SQL["merge_repeated_results"] = f"""WITH {_ROWS} SELECT code, provider, "ID",
    {", ".join(f"CASE WHEN r.status = 'success' THEN {'NULL' if c == 'state' else 'r.' + c} ELSE a.{c} END AS {c}"
               for c in _VALUES.split(", "))}
    FROM rows_in r JOIN answers a USING (provider, "ID")"""
SQL["run_with_lost_tasks"] = f"""WITH {_ROWS} SELECT code, provider, "ID",
    {", ".join(f"CASE WHEN r.status = 'success' THEN {'NULL' if c == 'state' else 'r.' + c} ELSE a.{c} END AS {c}"
               for c in _VALUES.split(", ") if c != "call_count")}, 0::BIGINT AS repeated
    FROM rows_in r JOIN answers a USING (provider, "ID")"""
_MERGED = f"""SELECT code, provider, "ID", r.model_name,
    {", ".join(f"CASE WHEN r.status = 'success' THEN {'NULL' if c == 'state' else 'r.' + c} ELSE a.{c} END AS {c}"
               for c in _VALUES.split(", "))}
    FROM rows_in r JOIN answers a USING (provider, "ID")"""
SQL["committed_versions"] = f"""WITH {_ROWS} SELECT 1 AS version, code, provider, "ID", {_VALUES.replace("state", "NULL AS state")}
    FROM rows_in UNION ALL SELECT 4, code, provider, "ID", {_VALUES} FROM ({_MERGED})"""
SQL["versioned_statistics"] = f"""WITH {_ROWS}, merged AS ({_MERGED}), counts AS (SELECT model_name, count(*) AS requests,
        count(*) FILTER (status = 'success') AS finished, count(*) FILTER (status IS NULL) AS open,
        count(*) FILTER (status ILIKE 'Error%') AS errors,
        CAST(coalesce(sum(coalesce(total_tokens, usage_tokens, 0)) FILTER (status = 'success'), 0) AS BIGINT) AS tokens,
        CAST(sum(coalesce(total_tokens, usage_tokens, 0)) AS BIGINT) AS all_tokens
    FROM merged GROUP BY model_name)
    SELECT model_name, requests, finished, open, tokens FROM counts
    UNION ALL SELECT NULL, CAST(sum(requests) AS BIGINT), CAST(sum(finished) AS BIGINT), CAST(sum(errors) AS BIGINT),
        CAST(sum(all_tokens) AS BIGINT) FROM counts"""
SQL["records_split"] = with_pubs(
    """SELECT search_engine_internal_id, title, year, '"' || authors || '";' AS authors, sha256(abstract) AS abstract_hash FROM pubs"""
)
SQL["searches_from_files"] = with_pubs(
    """SELECT search_id, search_id || role AS file_name, title, year, doi, CAST(ord AS INTEGER) AS doc_id
    FROM pubs, (VALUES ('__results.csv'), ('__filtered.csv')) v(role)"""
)
SQL["search_config_files"] = SQL["search_configs"]
SQL["parsed_documents"] = """SELECT 'document' AS kind, 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS file_name,
    sha256(text || chr(10)) AS hash FROM documents
    UNION ALL SELECT 'prompt', 'd' || doc_id, sha256(text) FROM documents WHERE doc_id % 2 = 1"""
SQL["responses_round_trip"] = f"""WITH {_ROWS} SELECT provider, r.model_name AS model, a.response_text, sha256(prompt) AS prompt_hash
    FROM rows_in r JOIN answers a USING (provider, "ID") WHERE a.status = 'success'"""
SQL["filter_log"] = with_pubs(
    " UNION ALL ".join(
        f"""SELECT search_id, 1 AS step, 'language={x}' AS filter, count(*) AS rows_in,
        count(*) FILTER (language IS DISTINCT FROM '{x}') AS rows_out FROM pubs GROUP BY search_id""" for x in ("de", "en")
    )
)
SQL["guarded_writes"] = with_pubs(
    """, n AS (SELECT count(*) FILTER (year < 2020) AS old, count(*) FILTER (year >= 2020) AS new FROM pubs)
    SELECT 'dry run' AS step, 'old' AS "table", old AS rows FROM n UNION ALL SELECT 'dry run', 'new', new FROM n
    UNION ALL SELECT 'write', 'out', old FROM n UNION ALL SELECT 'refused', 'out', old FROM n UNION ALL SELECT 'rewrite', 'out', new FROM n"""
)
SQL["run_single_row"] = f"""WITH {_ROWS} SELECT provider, "ID", {_VALUES}, true AS timed FROM answers
    WHERE "ID" = (SELECT max("ID") FROM answers)"""
SQL["response_payloads"] = f"""WITH {_ROWS} SELECT "ID", r.model_name AS model, provider, 'base' AS profile,
    a.response_text, a.status, sha256(prompt) AS prompt_hash,
    CASE WHEN a.status = 'success' THEN CAST(length(prompt) AS INTEGER) END AS size
    FROM rows_in r JOIN answers a USING (provider, "ID")"""
SQL["rows_with_defaults"] = f"""WITH {_ROWS} SELECT "ID", coalesce(response_text, '') AS response_text,
    coalesce(call_count, 0) AS call_count, coalesce(total_tokens, 0) AS total_tokens, status FROM rows_in"""
SQL["rows_by_id_or_code"] = f"""WITH {_ROWS}
    SELECT 'number' AS picked, "ID", code, provider FROM rows_in WHERE "ID" = 17
    UNION ALL SELECT 'code', "ID", code, provider FROM rows_in WHERE code = 'D42_prompt01_gpt-x_base'
    UNION ALL SELECT 'provider', "ID", code, provider FROM rows_in WHERE provider = 'openai'"""
SQL["stream_run"] = f"""WITH {_ROWS} SELECT provider, "ID", a.response_text, a.status FROM answers a
    JOIN rows_in r USING (provider, "ID") WHERE r.status IS DISTINCT FROM 'success'"""
_RUNS = f"""WITH runs AS (SELECT event_id, ts, ({listed(PROVIDERS)})[user_id % 4 + 1] AS provider,
    'm' || (user_id % 5) AS model_name,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'success' WHEN event_type = 'error' THEN 'Error: boom' END AS status,
    CASE WHEN event_type = 'view' THEN 'running' END AS state,
    CASE WHEN event_id % 10 <> 0 THEN event_id % 1000 ELSE event_id % 500 END AS tokens, value AS seconds
    FROM events)"""
SQL["run_totals"] = f"""{_RUNS} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS finished,
    count(*) FILTER (state = 'running') AS running, count(*) FILTER (status ILIKE 'Error%') AS errors,
    CAST(sum(tokens) AS BIGINT) AS total_tokens FROM runs"""
SQL["run_by_provider"] = f"{_RUNS} SELECT provider, count(*) AS requests FROM runs GROUP BY provider"
_PER_MODEL = f"""count(*) AS requests, count(*) FILTER (status = 'success') AS finished,
    count(*) FILTER (status IS NULL) AS open,
    CAST(coalesce(sum(tokens) FILTER (status = 'success'), 0) AS BIGINT) AS tokens,
    round(coalesce(sum(seconds) FILTER (status = 'success'), 0), 2) AS elapsed_seconds,
    round(coalesce(avg(seconds) FILTER (status = 'success'), 0), 6) AS avg_elapsed_seconds,
    {duration("round(sum(seconds) FILTER (status = 'success'), 2)")} AS duration"""
SQL["run_by_model"] = f"{_RUNS} SELECT model_name, {_PER_MODEL} FROM runs GROUP BY model_name"
SQL["stream_run_stats"] = f"""{_RUNS} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    model_name, {_PER_MODEL} FROM runs GROUP BY date_trunc('hour', ts), model_name"""
SQL["stream_event_windows"] = f"""{_RUNS}, middle AS (
        SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS m FROM events),
    parted AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN 2 WHEN ts < m THEN 0 ELSE 1 END AS part FROM runs, middle),
    clocks AS (SELECT p.part, max(q.ts) - INTERVAL 1 HOUR AS latest FROM (SELECT DISTINCT part FROM parted) p
        LEFT JOIN (SELECT part, max(ts) AS ts FROM parted GROUP BY part) q ON q.part < p.part GROUP BY p.part)
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, model_name, {_PER_MODEL},
        count(*) FILTER (date_trunc('hour', ts) + INTERVAL 1 HOUR <= latest) AS late
    FROM parted JOIN clocks USING (part) GROUP BY date_trunc('hour', ts), model_name"""
SQL["stream_keyed_state"] = with_pubs(
    f"""SELECT dedup_key, arg_min(ord, (ord % 3 <> 2, ord % 3 <> 1, ord)) AS ord
    FROM (SELECT ord, coalesce({key()}, 'row:' || ord) AS dedup_key FROM pubs) GROUP BY dedup_key"""
)
SQL["dialogue_results"] = """
    SELECT q.conv_id * 1000 + q.turn AS "ID", CAST(length(q.text) // 4 AS INTEGER) AS tokens_estimate,
        CASE WHEN a.text IS NOT NULL THEN 'success' END AS status, sha256(a.text) AS response_hash
    FROM conversations q LEFT JOIN conversations a
        ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
    WHERE q.role = 'user'"""
SQL["stream_first_seen"] = with_pubs(
    f"SELECT DISTINCT coalesce({key()}, 'row:' || ord) AS dedup_key FROM pubs"
)
SQL["stream_late_keys"] = with_pubs(
    f"SELECT coalesce({key()}, 'row:' || ord) AS dedup_key, 1::BIGINT AS times FROM pubs GROUP BY ALL"
)
SQL["records_round_trip"] = with_pubs(
    """SELECT ord AS doc_id, title, year, doi, NULL::INTEGER AS "citationCount" FROM pubs"""
)
