"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontam, jaccard, main_text, quality, secret_scan, sharding, suffixes, token_store, turns, unigram, url_rules, whitening
from ._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: The url rules of ``op9_url_filters``.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(byte_bpe.encode(table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _quality_sql() -> str:
    def level(tag: str, keys: tuple[str, ...]) -> str:
        by = "".join(f"{k}, " for k in keys)
        part = f"PARTITION BY {by}rate"
        pick = ", ".join(f"max(high + {r.spreads} * greatest(high - low, {r.least})) FILTER (rate = '{r.name}') AS {r.name}_{tag}" for r in quality.RATES)
        return f"""
{tag}1 AS (SELECT {by}rate, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
{tag}2 AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS up_to, sum(n) OVER ({part}) AS n_docs,
  CASE WHEN bucket = 0 THEN 0 ELSE floor(pow({quality.GAMMA}::DOUBLE, bucket - 1))::BIGINT END AS v FROM {tag}1),
{tag}3 AS (SELECT {by}rate, n_docs, min(v) FILTER (up_to * 100 >= n_docs * 25) AS low, min(v) FILTER (up_to * 100 >= n_docs * 75) AS high FROM {tag}2 GROUP BY ALL),
{tag} AS (SELECT {by}n_docs AS n_{tag}, {pick} FROM {tag}3 GROUP BY ALL)"""

    rates = [r.name for r in quality.RATES]
    fence = {r: f"CASE WHEN n_a >= {quality.MIN_GROUP} THEN {r}_a WHEN n_b >= {quality.MIN_GROUP} THEN {r}_b ELSE {r}_c END" for r in rates}
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i+2], ' ')) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win2, unnest([0, 1, 2]) AS t(k) WHERE c > 1 GROUP BY doc_id),
base AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(len(array_to_string(words, '')), 0)::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_caps,
  len(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs FROM w LEFT JOIN rep USING (doc_id)),
rated AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol_rate, CASE WHEN n_words > 0 THEN 1000 * n_bangs // n_words ELSE 0 END AS bang_rate,
  CASE WHEN word_chars > 0 THEN 1000 * n_caps // word_chars ELSE 0 END AS caps_rate, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate,
  CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length FROM base),
long AS (UNPIVOT (SELECT lang, source, {', '.join(rates)} FROM rated WHERE NOT base_failed) ON {', '.join(rates)} INTO NAME rate VALUE v),
sketch AS (SELECT lang, source, rate, CASE WHEN v <= 0 THEN 0 ELSE ceil(ln(v::DOUBLE) / ln({quality.GAMMA}::DOUBLE))::INT + 1 END AS bucket, count(*) AS n FROM long GROUP BY ALL),
{level('a', ('lang', 'source'))},{level('b', ('lang',))},{level('c', ())},
f AS (SELECT r.*, {', '.join(f'({fence[r]})::BIGINT AS {r}_fence' for r in rates)} FROM rated r LEFT JOIN a ON r.lang IS NOT DISTINCT FROM a.lang AND r.source IS NOT DISTINCT FROM a.source
  LEFT JOIN b ON r.lang IS NOT DISTINCT FROM b.lang LEFT JOIN c ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f'coalesce({r} > {r}_fence, false)' for r in rates)}) AS kept, {', '.join(rates)}, {', '.join(f'{r}_fence' for r in rates)} FROM f"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_DECONTAM_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {decontam.WINDOW}) AS size, array_to_string(w[i:i+least(len(w), {decontam.WINDOW})-1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontam.WINDOW - 1}, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (SELECT doc_id, i, size, array_to_string(w[i:i+size-1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, i, size, item_id FROM dwin JOIN win USING (size, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _secret_sql() -> str:
    def spans(place: int, rule: secret_scan.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        value = f"regexp_extract_all(text, '{pattern}', {rule.group})"
        return f"""SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s, length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, {value} AS v, string_split_regex(text, '{pattern}') AS b FROM d)) WHERE length(v[i]) >= {rule.least}"""

    def listed(where: str) -> str:
        return f"coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) {where}, '')"

    base = len(secret_scan.BASE_RULES)
    counts = ", ".join(f"count(kind) FILTER (place = {i}) AS n_{r.kind}" for i, r in enumerate(secret_scan.BASE_RULES))
    every = " UNION ALL ".join(spans(i, r) for i, r in enumerate(secret_scan.RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), x AS ({every})
SELECT doc_id, {counts}, sha256({listed(f'FILTER (place < {base})')}) AS base_sha256, {listed('')} AS spans FROM d LEFT JOIN x USING (doc_id) GROUP BY doc_id"""


def _url_sql() -> str:
    rules = ", ".join(f"('{kind}', '{key}', '{url_rules.split_rule(key)[0]}', '{url_rules.split_rule(key)[1]}')" for kind, key in URL_RULES)
    return f"""WITH r(kind, key, rhost, rpath) AS (VALUES {rules}),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (SELECT k, arg_max(key, length(key)) AS rule, arg_max(kind, length(key)) AS kind FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM p LEFT JOIN m USING (k)"""


def _turns_sql() -> str:
    """The least (cost, audit, repaired text) of each grammar state (0, s, u, a), turn by turn."""

    def step(state: str, letter: str, cost: str, added: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {added}}}"

    def first(*found: str) -> str:
        return f"list_sort([{', '.join(found)}])[1]"

    def into(role: str, initial: str, befores: tuple[str, ...]) -> str:
        keeps = [f"CASE WHEN NOT go AND initial = '{initial}' THEN {step(s, 'K', 'more', 'line')} ELSE none END" for s in befores]
        roles = [f"CASE WHEN NOT go THEN {step(s, 'R', f'{turns.REROLE} + more', f"chr(10) || '{role}:' || text")} ELSE none END" for s in befores]
        return first(step(f"e{initial}", "D", str(turns.DELETE)), *keeps, *roles)

    def inserted(state: str, role: str) -> str:
        return step(state, "I", str(turns.INSERT), f"chr(10) || '{role}:'")

    none = "{'c': 1000000, 'a': '', 't': ''}"
    space = r"\x20\x09-\x0D"
    keep_s = f"CASE WHEN NOT go AND initial = 's' THEN {step('e0', 'K', 'more', 'line')} ELSE none END"
    closed_u = first("bu", *(inserted(s, "user") for s in ("b0", "bs", "ba")))
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
p AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT p.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS act FROM p, crc),
d AS (SELECT key, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN act = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE act <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) AS i FROM d),
f AS (SELECT *, role[1] AS initial, NOT regexp_matches(text, '[^{space}]') AS blank, row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][{space}]*$') AS cut,
  lag(role[1]) OVER (PARTITION BY key ORDER BY i) || role[1] AS pair FROM o),
x AS (SELECT key, i, initial, text, chr(10) || role || ':' || text AS line, blank OR again AS go, CASE WHEN cut THEN {turns.TRUNCATED} ELSE 0 END AS more, {none} AS none FROM f),
r AS (SELECT DISTINCT key, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS b0, {none} AS bs, {none} AS bu, {none} AS ba FROM f
  UNION ALL SELECT key, i, {step('e0', 'D', str(turns.DELETE))}, {first(step('es', 'D', str(turns.DELETE)), keep_s)}, {into('user', 'u', ('e0', 'es', 'ea'))}, {into('assistant', 'a', ('eu',))}
  FROM (SELECT x.*, e0, es, eu, {first('ba', inserted('eu', 'assistant'))} AS ea FROM (SELECT key, i, b0 AS e0, bs AS es, ba, {closed_u} AS eu FROM r) r JOIN x ON x.key = r.key AND x.i = r.i + 1)),
z AS (SELECT key, {first('b0', 'ba', inserted('eu', 'assistant'))} AS best FROM (SELECT DISTINCT ON (key) key, b0, ba, {closed_u} AS eu FROM r ORDER BY key, i DESC)),
n AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.key = coalesce(conv_id::VARCHAR, ' ') LEFT JOIN z ON z.key = coalesce(conv_id::VARCHAR, ' ')"""


_QUERIES = (
    op1_quality_rules,
    op2_decontamination,
    op3_sharding,
    op4_token_store,
    op5_token_counts,
    op6_jaccard_join,
    op7_suffix_dedup,
    op8_secret_scans,
    op9_url_filters,
    op10_byte_bpe,
    op11_conversation_repair,
    op12_html_extraction,
    op13_embedding_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _quality_sql(),
        "op2_decontamination": _DECONTAM_SQL,
        "op8_secret_scans": _secret_sql(),
        "op9_url_filters": _url_sql(),
        "op11_conversation_repair": _turns_sql(),
    }
