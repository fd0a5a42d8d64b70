"""Registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm import (
    bpe, chat, decontaminate, language, lm_score, merkle, ngram_join, quality, spelling, substring_dedup, suffix_dedup, toxicity, url_filter,
)
from rowferry.llm.url_filter import Rule

TOKENIZER = "word_bpe_49k.json"
# fixed values: the rules of the URL query
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
# fixed values: host names whose pages make up the URL list of the query
LISTED_HOSTS = r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\."
# fixed value: a passage of so many words is one of over 50
REPEATED_WORDS = 51

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids and of the decoded text of every document."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
OP6_SQL = rf"""
WITH parts AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
canon AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^(www|m)\.', '') ||
    regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') END AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host, '{LISTED_HOSTS}')),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
ruled AS (
  SELECT c.*, (SELECT arg_max(struct_pack(r := h || p, v := rules.verdict), length(h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM canon c)
SELECT page_id, host, path, best.r AS rule,
  coalesce(best.v, CASE WHEN canonical <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""


@query("op6_url_filter", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page; the list holds the canonical URLs of the listed hosts' pages."""
    pages = table(spark, sf_dir, "pages")
    host = url_filter.host_of(F.col("url"))
    listed = pages.filter(host.rlike(LISTED_HOSTS)).select(
        url_filter.canonical(host, url_filter.path_of(F.col("url"))).alias("url")
    )
    return url_filter.judge(pages, listed, URL_RULES)


@query("op2_ngram_jaccard")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps, and its passages of over 50 words that repeat."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"), words=REPEATED_WORDS)


@query("op4_chat_format")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered turns of every transcript: their lines, role and the digest of the canonical form."""
    found = chat.predict(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "line", "n_lines", "opens", "held_out", "role", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


@query("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return lm_score.predict(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("spans")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.predict(table(spark, sf_dir, "documents"))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8_SQL = rf"""
WITH tests AS (SELECT item_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
    SELECT item_id, unnest([w[i:i + 9] FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS win FROM tests WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM patterns),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, s.n, item_id FROM spots s JOIN patterns p ON s.n = p.n AND s.win = p.win),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op8_decontaminate", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SP = r"[\x20\x09-\x0D]+"
_CLOSED = quality.CLOSED.replace("'", "''")
_RUN = " AND ".join(f"short[pos - k + {j}]" for j in range(1, quality.MENU_RUN))
OP10_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SP}'), lambda x: x <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS lines,
    list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) <= {quality.MAX_MENU}
      AND regexp_matches(x, '{quality.FEW_WORDS}') AND NOT regexp_matches(x, '{_CLOSED}')) AS short FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
doubled AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) >= 2),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM doubled) GROUP BY doc_id),
figures AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_SP}', '', 'g'))::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(lines, lambda x: regexp_replace(x, '{_SP}', '', 'g') <> '')) -
     len(list_distinct(list_filter(lines, lambda x: regexp_replace(x, '{_SP}', '', 'g') <> ''))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    coalesce(list_sum(list_transform(list_filter(lines, lambda x, pos:
      length(x) - length(regexp_replace(x, '{quality.SYMBOLS}', '', 'g')) > {quality.MAX_LINE_SYMBOLS} * length(x)
      OR len(regexp_extract_all(x, '{quality.SEPARATORS}')) >= {quality.MIN_BARS}
      OR (regexp_matches(x, '[^\x20\x09-\x0D]') AND NOT regexp_matches(x, '{quality.LETTER}'))
      OR (length(x) <= {quality.MAX_TEASER} AND regexp_matches(x, '{quality.TEASER}'))
      OR list_bool_or([pos > k AND coalesce(short[pos - k] AND {_RUN}, false) FOR k IN {list(range(quality.MENU_RUN))}])
      OR list_bool_or([contains(lower(x), p) FOR p IN {list(quality.BOILERPLATE)}])),
      lambda x: length(regexp_replace(x, '{_SP}', '', 'g')))), 0) AS lost
  FROM docs d LEFT JOIN repeats r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {quality.MAX_LOST} * word_chars AS kept
FROM figures"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("cleaned")


OP11_SQL = r"""
WITH RECURSIVE
rows_ AS (
  SELECT doc_id, source, array_to_string(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text],
      lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END), '') AS body,
    array_to_string(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, replace(text, chr(10), '')],
      lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END), '') AS cut,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
        lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(body) AS leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(cut) ELSE sha256(body) END AS start,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM rows_),
low(source, level, place, total, digest) AS (
  SELECT source, 0::BIGINT, place, total, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 3, (total + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM low WHERE total > 1 GROUP BY source, level, place // 3, total),
subroots AS (
  SELECT source, digest AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS total
  FROM low WHERE total = 1),
high(level, place, total, digest) AS (
  SELECT 0::BIGINT, place, total, subroot FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (total + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM high WHERE total > 1 GROUP BY level, place // 3, total),
way(doc_id, source, level, place, total, digest, sent) AS (
  SELECT doc_id, source, 0::BIGINT, place, total, start, '' FROM leaves
  UNION ALL
  SELECT w.doc_id, w.source, w.level + 1, w.place // 3, (w.total + 2) // 3,
    sha256(coalesce(a2.digest, '') || coalesce(a1.digest, '') || w.digest || coalesce(b1.digest, '') || coalesce(b2.digest, '')),
    w.sent || coalesce(a2.digest, '') || coalesce(a1.digest, '') || coalesce(b1.digest, '') || coalesce(b2.digest, '')
  FROM way w
  LEFT JOIN low a2 ON w.source IS NOT DISTINCT FROM a2.source AND a2.level = w.level AND a2.place = w.place - 2 AND w.place % 3 = 2
  LEFT JOIN low a1 ON w.source IS NOT DISTINCT FROM a1.source AND a1.level = w.level AND a1.place = w.place - 1 AND w.place % 3 >= 1
  LEFT JOIN low b1 ON w.source IS NOT DISTINCT FROM b1.source AND b1.level = w.level AND b1.place = w.place + 1 AND w.place % 3 <= 1
  LEFT JOIN low b2 ON w.source IS NOT DISTINCT FROM b2.source AND b2.level = w.level AND b2.place = w.place + 2 AND w.place % 3 = 0
  WHERE w.total > 1),
over_(doc_id, source, level, place, total, digest, sent) AS (
  SELECT w.doc_id, w.source, 0::BIGINT, s.place, s.total, w.digest, w.sent
  FROM way w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source WHERE w.total = 1
  UNION ALL
  SELECT w.doc_id, w.source, w.level + 1, w.place // 3, (w.total + 2) // 3,
    sha256(coalesce(a2.digest, '') || coalesce(a1.digest, '') || w.digest || coalesce(b1.digest, '') || coalesce(b2.digest, '')),
    w.sent || coalesce(a2.digest, '') || coalesce(a1.digest, '') || coalesce(b1.digest, '') || coalesce(b2.digest, '')
  FROM over_ w
  LEFT JOIN high a2 ON a2.level = w.level AND a2.place = w.place - 2 AND w.place % 3 = 2
  LEFT JOIN high a1 ON a1.level = w.level AND a1.place = w.place - 1 AND w.place % 3 >= 1
  LEFT JOIN high b1 ON b1.level = w.level AND b1.place = w.place + 1 AND w.place % 3 <= 1
  LEFT JOIN high b2 ON b2.level = w.level AND b2.place = w.place + 2 AND w.place % 3 = 0
  WHERE w.total > 1)
SELECT l.doc_id, l.leaf, s.subroot, h.digest AS root, sha256(o.sent) AS proof_sha256, o.digest AS folded_root, o.digest = h.digest AS verified
FROM leaves l JOIN over_ o ON l.doc_id = o.doc_id AND o.total = 1
JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN high h ON h.total = 1"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it still folds to the root after tampering."""
    return merkle.report(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
lost AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM lost),
places AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY k) AS body FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.k = g.k GROUP BY w.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs d LEFT JOIN places USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op12_substring_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document loses to earlier documents, and the digest of the others."""
    return substring_dedup.report(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE
bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
step AS (SELECT i, c FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY doc_id, run),
coded AS (SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS bytes FROM runs WHERE length(run) >= 6),
sums(doc_id, run, n, bytes, byte, crc) AS (
  SELECT doc_id, run, n, bytes, 1, 4294967295::BIGINT FROM coded
  UNION ALL
  SELECT doc_id, run, n, bytes, byte + 2, xor(crc >> 8, c)
  FROM sums JOIN step ON i = xor(crc, ('0x' || substr(bytes, byte, 2))::BIGINT) & 255 WHERE byte < length(bytes)),
checked AS (SELECT run, n, xor(crc, 4294967295) AS h FROM sums WHERE byte > length(bytes)),
slipped AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM checked),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
shorter AS (
  SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM shorter a JOIN words b ON a.rest = b.word),
best AS (
  SELECT p.word, count(*) AS n_near, min(struct_pack(minus := -w.n, name := p.near)) AS top FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -top.minus >= 5 * w.n THEN top.name END AS form,
    CASE WHEN -top.minus >= 5 * w.n THEN -top.minus END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain(word, root, next) AS (
  SELECT word, word, form FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent form and root of every word of the documents."""
    return spelling.report(table(spark, sf_dir, "documents"))
