"""The corpus operators as queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.html_blocks import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarn.llm.tokens import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


OP5_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
urls AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
fits AS (SELECT u.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f USING (page_id)
"""


OP4_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM texts),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
    WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


def op1_sql() -> str:
    """The scan's definition: places of the phrases, and the notices that a block of a line or of the whole text holds."""
    from tarn.llm import licenses as L

    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda text: f"[w FOR w IN regexp_split_to_array(translate({text}, '{L.UPPER}', '{L.LOWER}'), '{gap}') IF w <> '']"
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({listed(L.plain_words(p))}, '{label}')" for p, label in L.PHRASES)
    notices = ", ".join(f"({listed(sorted(set(L.plain_words(t))))}, '{label}')" for label, t in L.NOTICES)
    half = L.BLOCK // 2
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, {split("coalesce(text, '')")} AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}), notices(t, label) AS (VALUES {notices}),
places AS (SELECT doc_id, label, unnest([i - 1 FOR i IN range(1, len(w) + 1) IF w[i:i + len(p) - 1] = p]) AS pos FROM texts, phrases),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, {split("line")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) UNION ALL SELECT doc_id, w FROM texts),
blocks AS (SELECT doc_id, list_distinct(w[pos + 1:pos + {L.BLOCK}]) AS b FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - {half} - 1) + 1, {half})) AS pos FROM lines)),
hits AS (SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks, notices WHERE len(list_intersect(b, t)) >= ceil({L.THRESHOLD} * len(t))),
found AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(share) AS share FROM hits GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
    coalesce(array_to_string(b.labels, ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
    CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.share, 0.0::DOUBLE) END AS score
FROM texts t LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)"""


def op9_sql() -> str:
    """The rules' definition, with the thresholds of the operator."""
    from tarn.llm import quality as Q

    shares = ", ".join(f"max(chars) FILTER (n = {n}) AS c{n}" for n in Q.MOST_REPEATED)
    fine = " AND ".join(f"coalesce(c{n}, 0) / whole <= {most}" for n, most in Q.MOST_REPEATED.items())
    worst = "greatest(" + ", ".join(f"coalesce(c{n}, 0)" for n in Q.MOST_REPEATED) + ") / whole"
    frame = "OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"
    grams = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, string_agg(x, ' ') {frame.format(n - 1)} AS g, count(*) {frame.format(n - 1)} AS held FROM words" for n in Q.MOST_REPEATED)
    failed = f"len(w) < {Q.MIN_WORDS} OR 100 * coalesce(r{Q.BASE_N}, 0) > {Q.BASE_PERCENT} * len(w)"
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts),
grams AS ({grams}),
twice AS (SELECT doc_id, n, i FROM grams WHERE held = n QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
covered AS (SELECT k.doc_id, k.n, length(x) AS size FROM (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM twice) k JOIN words USING (doc_id, i)),
per_n AS (SELECT doc_id, n, sum(size) AS chars, count(*) AS words FROM covered GROUP BY doc_id, n),
per_doc AS (SELECT doc_id, {shares}, max(words) FILTER (n = {Q.BASE_N}) AS r{Q.BASE_N} FROM per_n GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM texts)),
again AS (SELECT doc_id, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') AS bare FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1),
dup AS (SELECT doc_id, count(*) AS n, sum(length(bare)) AS chars FROM again WHERE bare <> '' GROUP BY doc_id),
all_ AS (SELECT t.doc_id, w, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars, greatest(coalesce(list_sum([length(x) FOR x IN w]), 0), 1)::DOUBLE AS whole,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(d.chars, 0) AS line_chars, p.* EXCLUDE (doc_id)
    FROM texts t LEFT JOIN per_doc p USING (doc_id) LEFT JOIN dup d USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r{Q.BASE_N}, 0) AS BIGINT) AS n_repeat_words, ({failed}) AS base_failed,
    NOT ({failed}) AND {fine} AND line_chars / whole <= {Q.MOST_LINES} AND n_symbols <= {Q.MOST_SYMBOLS} * whole AS kept,
    line_chars / whole AS dup_line_share, {worst} AS dup_ngram_share
FROM all_"""


def queries() -> dict[str, Query]:
    own = (op1_license_scan, op2_personal_data, op3_packing, op4_jaccard_join, op5_url_filter, op6_decontamination, op7_repeated_strings, op8_html_text, op9_quality, op10_token_output)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": op1_sql(), "op4_jaccard_join": OP4_SQL, "op5_url_filter": OP5_SQL, "op9_quality": op9_sql()}
