"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from vecspark.llm import mixing, quality, sharding

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _fraction(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(2**52)!r}"


def _sharding(shards: int) -> str:
    pick = lambda n: f"(SELECT arg_min(s, -ln({_fraction('d.k || chr(47) || s')})) FROM range({n}) r(s))"
    crc_table = (
        "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    )
    crc_step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    codes = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"""
WITH crc(t) AS (SELECT {crc_table}),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(octet_length(encode(text)), 0) + 1 AS size,
        CASE WHEN coalesce(text, '') = '' THEN 0
             ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {crc_step}), 4294967295) END AS text_crc32
      FROM documents, crc),
s AS (SELECT d.*, {pick(shards)}::INTEGER AS shard, {pick(shards + 1)}::INTEGER AS grown_shard FROM d)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, '{sharding.LAW}' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws('/', doc_id::VARCHAR, text_crc32::VARCHAR)), 1, 3),
    doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM s"""


def _mixing() -> str:
    n = len(mixing.WEIGHTS)
    weights = "[" + ", ".join(f"{float(w)!r}" for w in mixing.WEIGHTS) + "]"
    step = lambda k: f"floor(rate * ({k})::DOUBLE + off)"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'null') AS k,
    coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size FROM documents),
s AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
l AS (SELECT *, {weights}[(n % {n}) + 1] AS w, {float(mixing.MOST_COPIES)} * source_size AS lim FROM w),
f AS (SELECT *, lim / w AS full_at FROM l),
v AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER e, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER e, 0.0)) AS level
      FROM f WINDOW e AS (ORDER BY full_at, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(lim, coalesce(max(CASE WHEN level < full_at THEN level END) OVER (), 'inf'::DOUBLE) * w) AS target FROM v),
r AS (SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN least({float(mixing.MOST_COPIES)}, target / source_size) ELSE 0.0 END AS rate,
    {_fraction(f"'{mixing.SEED}:' || k")} AS off,
    row_number() OVER (PARTITION BY k ORDER BY size, doc_id) AS rank FROM d JOIN t USING (k))
SELECT doc_id, size::BIGINT AS size, source_size, target, (({step('rank')} - {step('rank - 1')}) * size)::BIGINT AS taken FROM r"""


def _quality() -> str:
    width = quality.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words FROM d),
g AS (SELECT row, unnest(list_transform(range(1, len(words) - {width - 2}), lambda i: {{'i': i, 'x': array_to_string(words[i:i + {width - 1}], ' ')}})) AS g
      FROM w WHERE len(words) > {width}),
m AS (SELECT row, g.i AS i, count(*) OVER (PARTITION BY row, g.x) AS n FROM g),
c AS (SELECT row, least({width}, i - coalesce(lag(i) OVER (PARTITION BY row ORDER BY i), i - {width})) AS c FROM m WHERE n > 1),
r AS (SELECT row, sum(c)::BIGINT AS n_repeat_words FROM c GROUP BY row),
b AS (SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[{quality.SYMBOLS}]'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r USING (row)),
e AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS failed FROM e WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(failed / n) AS m, var_samp(failed / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v IS NULL THEN {quality.STRENGTH[0]} WHEN v <= 0 THEN {quality.STRENGTH[1]}
    ELSE greatest({quality.STRENGTH[0]}, least({quality.STRENGTH[1]}, m * (1 - m) / v - 1)) END AS s FROM p),
x AS (SELECT source FROM h, q WHERE (failed + m * s) / (n + s) > {quality.MAX_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM x)) AS kept FROM e"""


SQL: dict[str, str] = {
    "op5_quality_rules": _quality(),
    "op7_source_mixing": _mixing(),
    "op9_sharding": _sharding(sharding.SHARDS),
}
