"""Line parsing written once more in SQL, as a chain of common table expressions.

``candidates`` has (src, a, b, k, text): the whole line as k = 0 and its alternatives as 1, 2, ...
The patterns here are the direct forms, one repetition per character or word.
"""

from __future__ import annotations

from basketloom.catalog import bindings as b
from basketloom.functions.fixed_values import (
    COUNT_UNITS,
    LOST_SLASH,
    NUMBER_WORDS,
    STANDARD_UNITS,
    WHITE_SPACE,
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _forms(units) -> str:
    return "|".join(form for _, forms in units for form in forms)


_STD, _CNT = _forms(STANDARD_UNITS), _forms(COUNT_UNITS)
_WORDS = "|".join(word for word, _ in NUMBER_WORDS)
_MEASURE = quoted(
    rf"^\*?\-? ?((?:[0-9]|/| |\.|\-|x|to|\(|\)|{_WORDS}|{_STD}|{_CNT})*) (.*)"
)
_UNIT = quoted(f"(?:{_STD}|{_CNT})")
_SIZED = quoted(rf"\([1-9][0-9]?(?: 1/?2)?[ -]*(?:{_STD})\) (?:{_CNT})")
_BARE = quoted(rf"[1-9][0-9]?[ -]*(?:{_STD}) (?:{_CNT})")
_WS = quoted(WHITE_SPACE)


def strip(expr: str, chars: str = _WS) -> str:
    return f"trim({expr}, {chars})"


def without_parentheses(expr: str) -> str:
    for _ in range(6):
        expr = f"regexp_replace({expr}, '\\([^()]*\\)', '', 'g')"
    return expr


def normalised(expr: str) -> str:
    return f"replace(lower({expr}), 'possibly ', '')"


def _canonical(expr: str, units) -> str:
    cases = " ".join(
        f"WHEN regexp_full_match({expr}, {quoted('|'.join(forms))}) THEN {quoted(name)}"
        for name, forms in units
    )
    return f"CASE {cases} END"


def canonical_unit(unit: str) -> str:
    spaced = f"string_split(replace(replace({unit}, '-', ' '), '  ', ' '), ' ')"
    std = _canonical(f"{spaced}[-2]", STANDARD_UNITS)
    cnt = _canonical(f"{spaced}[-1]", COUNT_UNITS)
    compound = (
        f"CASE WHEN len({spaced}) IN (3, 4) THEN array_to_string({spaced}[:-3], ' ') || ' ' || "
        f"{std} || ' ' || {cnt} END"
    )
    return f"coalesce({compound}, {_canonical(unit, STANDARD_UNITS + COUNT_UNITS)}, {unit})"


def _number(token: str) -> str:
    words = " ".join(
        f"WHEN regexp_matches({token}, {quoted('^' + word)}) THEN {float(value)}::DOUBLE"
        for word, value in NUMBER_WORDS
    )
    return f"""CASE
        WHEN contains({token}, '/') THEN CASE
            WHEN regexp_full_match({token}, '[0-9]+/[0-9]+')
            THEN string_split({token}, '/')[1]::DOUBLE
                / nullif(string_split({token}, '/')[2]::DOUBLE, 0.0) END
        WHEN contains({token}, '.') THEN CASE
            WHEN regexp_full_match({token}, '[0-9]+\\.[0-9]*|\\.[0-9]+') THEN {token}::DOUBLE END
        WHEN regexp_full_match({token}, '[0-9]+') THEN {token}::DOUBLE
        {words} END"""


def _repaired(value: str) -> str:
    cases = " ".join(f"WHEN {number} THEN {fraction}::DOUBLE" for number, fraction in LOST_SLASH)
    return f"(CASE {value} {cases} ELSE {value} END)"


def _is_whole(token: str, value: str) -> str:
    return f"(NOT regexp_matches({token}, '[/.]') AND ({value} >= 1 OR regexp_matches({token}, '^0+$')))"


_SPLIT_OR = "string_split(t, ' or ')"

PARSED = f"""normal AS (SELECT src, a, b, text, {normalised('text')} AS t FROM source),
    pieces AS (SELECT src, a, b, generate_subscripts({_SPLIT_OR}, 1) AS i,
        unnest({_SPLIT_OR}) AS piece, {_SPLIT_OR} AS parts FROM normal WHERE contains(t, ' or ')),
    -- a cut inside parentheses is followed by their closing before any opening
    cuts AS (SELECT *, i = 1 OR NOT regexp_matches(array_to_string(parts[i:], ' or '),
        '^[^(]*\\)') AS starts FROM pieces),
    grouped AS (SELECT *, sum(starts::INT) OVER (PARTITION BY src, a, b ORDER BY i)::BIGINT AS k
        FROM cuts),
    options AS (SELECT src, a, b, k, string_agg(piece, ' or ' ORDER BY i) AS text FROM grouped
        GROUP BY src, a, b, k),
    candidates AS MATERIALIZED (
        SELECT src, a, b, 0::BIGINT AS k, t AS text FROM normal
        UNION ALL
        SELECT src, a, b, k, text FROM options
        QUALIFY count(*) OVER (PARTITION BY src, a, b) > 1),
    measured AS MATERIALIZED (SELECT *, regexp_matches(text, {_MEASURE}) AS has_measure,
        {strip(f"regexp_extract(text, {_MEASURE}, 1)")} AS measure,
        {strip(f"regexp_extract(text, {_MEASURE}, 2)")} AS rest FROM candidates),
    sized AS (SELECT *, regexp_extract(measure, {_SIZED}) AS w1,
        regexp_extract(measure, {_BARE}) AS w2,
        {without_parentheses('measure')} AS bare FROM measured),
    united AS MATERIALIZED (SELECT *,
        nullif(CASE WHEN w1 <> '' THEN regexp_replace(w1, '[()]', '', 'g')
            WHEN w2 <> '' THEN regexp_replace(w2, '[()]', '', 'g')
            ELSE regexp_extract(bare, {_UNIT}) END, '') AS raw_unit,
        replace(CASE WHEN w1 <> '' THEN regexp_replace(measure, {_SIZED}, '', 'g')
            WHEN w2 <> '' THEN regexp_replace(measure, {_BARE}, '', 'g')
            ELSE regexp_replace(bare, {_UNIT}, '', 'g') END, 'whole', '') AS lq,
        {without_parentheses(strip('rest', "' ,'"))} AS ext FROM sized),
    worded AS (SELECT *, CASE WHEN has_measure AND lq <> '' THEN {strip('lq')} END AS quantity_str,
        CASE WHEN has_measure THEN {canonical_unit('raw_unit')} END AS unit,
        regexp_extract(ext, '^(.+?)(?:,|:|;|- | -)', 1) AS cut FROM united),
    sided AS MATERIALIZED (SELECT *, CASE
        WHEN contains(quantity_str, '-') OR contains(quantity_str, ' to ') THEN
            CASE WHEN len(string_split(quantity_str, '-')) = 2 THEN string_split(quantity_str, '-')
                WHEN len(string_split(quantity_str, ' to ')) = 2
                THEN string_split(quantity_str, ' to ') END
        ELSE [quantity_str] END AS sides FROM worded),
    sides AS (SELECT src, a, b, k, raw_unit, len(sides) AS n,
        generate_subscripts(sides, 1) AS side,
        CASE WHEN len(sides) = 2 THEN {strip('unnest(sides)')} ELSE unnest(sides) END AS q
        FROM sided WHERE sides IS NOT NULL AND quantity_str IS NOT NULL),
    tokens AS (SELECT *, len(string_split(q, ' ')) AS m, string_split(q, ' ')[1] AS t1,
        string_split(q, ' ')[2] AS t2 FROM sides),
    numbers AS (SELECT *, {_number('t1')} AS v1, {_number('t2')} AS v2 FROM tokens),
    valued AS (SELECT *, CASE
        WHEN m = 1 THEN CASE WHEN raw_unit IS NULL OR NOT (raw_unit LIKE '%s' OR raw_unit = 'g')
            THEN {_repaired('v1')} ELSE v1 END
        WHEN m = 2 AND {_is_whole('t1', 'v1')} AND {_repaired('v2')} < 1
        THEN v1 + {_repaired('v2')} END AS v FROM numbers),
    bounds AS (SELECT src, a, b, k,
        CASE WHEN count(v) = max(n) THEN max(v) FILTER (side = 1) END AS quantity_low,
        CASE WHEN count(v) = max(n) THEN max(v) FILTER (side = n) END AS quantity_high
        FROM valued GROUP BY src, a, b, k),
    parsed AS MATERIALIZED (SELECT src, a, b, k, text, has_measure, measure, rest, raw_unit, unit,
        quantity_str, quantity_low, quantity_high,
        CASE WHEN NOT has_measure THEN string_split(text, ',')[1]
            ELSE {strip("regexp_replace(CASE WHEN cut = '' THEN " + strip('ext') + " ELSE cut END, '^of ', '')")}
            END AS name,
        nullif(CASE WHEN NOT has_measure THEN
                CASE WHEN contains(text, ',') THEN substr(text, strpos(text, ',') + 1) END
            WHEN cut = '' THEN '' ELSE {strip('substr(ext, length(cut) + 2)')} END, '') AS modifier
        FROM sided LEFT JOIN bounds USING (src, a, b, k)),
    agreed AS (SELECT src, a, b, bool_and((p.unit IS NOT NULL) = (f.unit IS NOT NULL)
            AND (p.quantity_str IS NOT NULL) = (f.quantity_str IS NOT NULL)) AS split,
        string_agg(p.name, '|' ORDER BY p.k) FILTER (p.k > 1) AS others
        FROM parsed p JOIN parsed f USING (src, a, b) WHERE p.k > 0 AND f.k = 1
        GROUP BY src, a, b)"""

# measure phrases and document lines alike
ALL = "source AS (SELECT * FROM all_lines)"


def over_all_lines(body: str, *extra: str) -> str:
    return b.with_ctes(body, b.LINES, ALL, PARSED, *extra)
