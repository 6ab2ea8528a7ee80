"""The text operators bound to the given tables, each beside its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketloom.llm import (
    bit_sliced_search,
    chat_format,
    decontaminate,
    html_extract,
    jaccard_join,
    packing,
    pii,
    pseudo_likelihood,
    quality_rules,
    repeats,
    toxic_grammar,
    vector_codes,
    weak_labels,
)
from basketloom.llm.common import sha256_hex, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return weak_labels.quality_classifier(
        table(spark, sf, "documents"), table(spark, sf, "labels")
    )


@query(
    "op2_decontamination",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS words FROM benchmark),
windows AS (SELECT DISTINCT item_id, m, array_to_string(words[k:k + m - 1], ' ') AS said
    FROM (SELECT item_id, words, least(13, len(words)) AS m,
        unnest(range(1, len(words) - least(13, len(words)) + 2)) AS k
        FROM i WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, m, k, array_to_string(words[k:k + m - 1], ' ') AS said
    FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS k
        FROM w, lengths WHERE len(words) >= m)),
found AS (SELECT doc_id, p.m, k, item_id FROM places p JOIN windows USING (m, said)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(said, ',' ORDER BY said) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS said FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.decontamination_report(
        spark, table(spark, sf, "documents"), table(spark, sf, "benchmark")
    )


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf, "pages"))


@query("op4_repeats")
def op4_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents")).drop("spans")


def _quality_sql() -> str:
    """The statistics in SQL, and the estimation unrolled step by step over the vote patterns."""
    q = quality_rules
    m = len(q.RULES)
    without = "length(text) - length(regexp_replace(text, '[{}]', '', 'g'))"
    cells = [
        f"CASE WHEN {bad} THEN {3 * j} WHEN {good} THEN {3 * j + 2} ELSE {3 * j + 1} END AS c{j}"
        for j, (_, good, bad) in enumerate(q.RULES)
    ]
    names = ", ".join(f"c{j}" for j in range(m))
    start = ", ".join(
        f"({3 * j + k}, CAST({x} AS DOUBLE))" for j in range(m) for k, x in enumerate(q.START)
    )
    parts = [
        f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\x09-\\x0D]+'),
    lambda x: x <> '') AS words FROM d),
places AS (SELECT doc_id, k, words[k:k + 2] AS said FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS k FROM w WHERE len(words) > 2)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, said) AS n
    FROM places) WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS p FROM again) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_different FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^ \\x09-\\x0D]') GROUP BY 1),
s AS MATERIALIZED (SELECT w.doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[ \\x09-\\x0D]', '', 'g')) AS word_chars,
    {without.format("#*$%&|<>")} AS n_symbols,
    coalesce(n_lines - n_different, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, {without.format("A-Z")} AS n_upper,
    {without.format("0-9")} AS n_digits, {without.format(".!?")} AS n_ends
    FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN l USING (doc_id)),
v AS MATERIALIZED (SELECT *, {q.BASE_FAILED} AS base_failed, {", ".join(cells)} FROM s),
patterns AS MATERIALIZED (SELECT row_number() OVER () AS id, n, unnest([{names}]) AS c FROM (
    SELECT {names}, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL)),
w0 AS (SELECT * FROM (VALUES {start}, ({3 * m}, {q.START_ODDS})) AS t(c, w))"""
    ]
    for t in range(q.ITERATIONS):
        parts.append(
            f"""q{t} AS MATERIALIZED (SELECT id, 1 / (1 + exp(-(sum(w) + (SELECT w FROM w{t}
    WHERE c = {3 * m})))) AS good FROM patterns JOIN w{t} USING (c) GROUP BY id),
m{t} AS MATERIALIZED (SELECT a.c, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM
    (SELECT unnest(range({3 * m})) AS c) a LEFT JOIN (SELECT c, sum(n * good) AS g,
    sum(n * (1 - good)) AS b FROM patterns JOIN q{t} USING (id) GROUP BY c) USING (c)),
a{t} AS MATERIALIZED (SELECT sum(g) AS g, sum(b) AS b FROM m{t} WHERE c < 3),
w{t + 1} AS MATERIALIZED (SELECT m{t}.c, CASE m{t}.c % 3 WHEN 1 THEN 0
    WHEN 0 THEN least(greatest(r, {q.BAD_RANGE[0]}), {q.BAD_RANGE[1]})
    ELSE least(greatest(r, {q.GOOD_RANGE[0]}), {q.GOOD_RANGE[1]}) END AS w
    FROM (SELECT m.c, ln(((m.g + {q.SMOOTHING}) / (a.g + 3 * {q.SMOOTHING}))
        / ((m.b + {q.SMOOTHING}) / (a.b + 3 * {q.SMOOTHING}))) AS r FROM m{t} m, a{t} a) m{t}
    UNION ALL SELECT {3 * m}, least(greatest(ln((g + {q.SMOOTHING}) / (b + {q.SMOOTHING})),
        {q.ODDS_RANGE[0]}), {q.ODDS_RANGE[1]}) FROM a{t})"""
        )
    last = f"w{q.ITERATIONS}"
    odds = " + ".join(
        f"list_extract(ws, c{j} + 1)" for j in range(m)
    )
    return (
        ",\n".join(parts)
        + f""",
fit AS (SELECT list(w ORDER BY c) AS ws FROM {last})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND list_extract(ws, {3 * m + 1}) + {odds} >= 0 AS kept FROM v, fit"""
    )


@query("op5_quality_rules", _quality_sql())
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf, "documents"), carry=["doc_id"])
    return judged.drop("good_probability")


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"))


@query(
    "op7_chat_format",
    r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>')
    AS t, replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>',
    '\</turn>'), ':', '\:') AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
        AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
        FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(r) + length(t) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
)
def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf, "conversations"))
    return chat_format.read_back(chat_format.format_chat(rows))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf, "documents"), path)


@query("op8_pseudo_likelihood")
def op8_pseudo_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf, "documents"))


@query("op9_personal_data")
def op9_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf, "documents"), carry=["doc_id"])
    return found.select(
        "doc_id",
        *[pii.count_kind("base", kind).alias(f"n_{kind}") for kind in pii.KINDS],
        sha256_hex(pii.spans_text("base")).alias("base_sha256"),
        pii.spans_text("spans").alias("spans"),
    )


def _codes_sql() -> str:
    """The rounds unrolled: squared distances to all entries, then floors of the means."""
    v = vector_codes
    width = f"(SELECT CAST(ceil(max(len(embedding)) / {v.PARTS}.0) AS BIGINT) FROM kept)"
    nearest = """a{t} AS MATERIALIZED (SELECT rn, part, arg_min(entry, (apart, entry)) AS entry, min(apart) AS apart
    FROM (SELECT p.rn, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS apart
        FROM p JOIN b{t} b ON p.part = b.part AND p.pos = b.pos GROUP BY ALL) GROUP BY rn, part)"""
    steps = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rn,
    vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rn, k // {width} AS part, k % {width} AS pos,
    CAST(floor({v.SCALE} * CAST(coalesce(embedding[k + 1], 0) AS DOUBLE)) AS HUGEINT) AS x
    FROM (SELECT rn, embedding, unnest(range({v.PARTS} * {width})) AS k FROM kept)),
b0 AS MATERIALIZED (SELECT rn AS entry, part, pos, x FROM p WHERE rn < {v.ENTRIES})"""
    ]
    for t in range(v.ROUNDS):
        steps.append(nearest.format(t=t))
        steps.append(f"""b{t + 1} AS MATERIALIZED (SELECT entry, part, pos,
    CASE WHEN n IS NULL THEN old ELSE (s - ((s % n) + n) % n) // n END AS x
    FROM (SELECT entry, part, pos, x AS old FROM b{t}) LEFT JOIN (
        SELECT a.entry, p.part, p.pos, sum(p.x) AS s, count(*) AS n
        FROM p JOIN a{t} a USING (rn, part) GROUP BY ALL) USING (entry, part, pos))""")
    last = v.ROUNDS
    return (
        ",\n".join([*steps, nearest.format(t=last)])
        + f""",
coded AS (SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
    CAST(sum(apart) AS BIGINT) AS error FROM a{last} GROUP BY rn),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS d FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    d AS codebooks_sha256 FROM kept JOIN coded USING (rn), digest"""
    )


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.product_codes(table(spark, sf, "embeddings"))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxic_grammar.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).select(
        "doc_id", "held_out", "score", "predicted"
    )


@query(
    "op13_ranked_search",
    r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(regexp_replace(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS words FROM documents),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(regexp_replace(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')) AS term FROM benchmark),
size AS MATERIALIZED (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(words)) AS BIGINT) AS total
    FROM d WHERE len(words) > 0),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d)
    WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), size),
parts AS MATERIALIZED (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(words) * docs) // total)))
    AS worth FROM tf JOIN d USING (r) JOIN w USING (term), size),
scores AS (SELECT item_id, r, CAST(sum(worth) AS BIGINT) AS score FROM i JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
        AS rank FROM scores JOIN d USING (r) WHERE score > 0) WHERE rank <= 10""",
)
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return bit_sliced_search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
