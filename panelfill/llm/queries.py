"""Named queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelfill.llm import (
    chat, decontaminate, lexicon_bpe, line_crf, order_minhash, pii, quality_rules, spelling, suffix_levels, target_resampling, token_files,
    url_rules, window_repeats)
from panelfill.llm.common import table
from panelfill.sources.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


SHA = "sha256(coalesce({}, ''))"

_WORDS = r"""
  SELECT {id}, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {table}"""

OP1_SQL = f"""
WITH items AS ({_WORDS.format(id='item_id', table='benchmark')}), docs AS ({_WORDS.format(id='doc_id', table='documents')}),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
         array_to_string(w[i + 1:i + least(len(w), 13)], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM docs, sizes WHERE len(w) >= size),
hits AS (
  SELECT s.doc_id, s.i, s.size, x.item_id FROM starts s JOIN windows x
  ON x.size = s.size AND x.words = array_to_string(s.w[s.i + 1:s.i + s.size], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words h USING (doc_id) LEFT JOIN found f USING (doc_id)"""


@query("op1_benchmark_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.checksums(token_files.read_tokens(spark, path))


@query("op9_lexicon_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lexicon_bpe.with_ids(docs, decode=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.with_score(docs, model)
    return scored.select("doc_id", line_crf.held_out().alias("held_out"), "score", line_crf.predicted().alias("predicted"))


@query("op10_order_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.with_class(docs, columns=["doc_id"]).select("doc_id", "class_id")


@query("op3_suffix_levels")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_levels.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split_up AS (
  SELECT row_number() OVER () AS r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM split_up WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
measured AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals, length(t) - length(replace(t, '!', '')) AS shouts,
         length(t) - length(translate(t, '0123456789', '')) AS digits
  FROM split_up LEFT JOIN repeated USING (r)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > word_chars OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 30 * n_lines OR 2 * capitals > word_chars OR 10 * shouts > word_chars OR 3 * digits > word_chars
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) < 6 * n_words) AS kept
FROM based"""


@query("op2_quality_rules", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.with_verdict(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
                  count(*) OVER (PARTITION BY conv_id) AS size FROM turns),
prefixes AS (SELECT conv_id, place, size, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY place) AS so_far FROM placed),
texts AS (SELECT conv_id, place, size, CAST(so_far AS VARCHAR) AS so_far FROM prefixes),
longest AS (SELECT min(conv_id) AS conv_id, place, so_far FROM texts WHERE place = size GROUP BY place, so_far),
kept AS (SELECT conv_id FROM longest l WHERE NOT EXISTS (
  SELECT 1 FROM texts p WHERE p.place < p.size AND p.place = l.place AND p.so_far = l.so_far))
SELECT conv_id, max(size) AS n_turns, CAST((place - 1) // 1024 AS BIGINT) AS part,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY place) AS text
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, part"""


@query("op4_chat_formatting", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH cut AS (SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (SELECT page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(verdict, length(r.host || r.path)) AS verdict
         FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN
         regexp_matches(lower(url), '://([^/?#]*\.)?spam-farm\.') OR regexp_matches(lower(url), '://([^/?#]*[.-])?cheap-pills?[.-]')
         OR regexp_matches(lower(url), '://([^/?#]*[.-])?casino([.-]|[0-9])') OR regexp_matches(lower(url), '://([^/?#]*[.-])?(xxx|porn)[.-]')
         OR regexp_matches(lower(url), '/(redirect|out)\?(.*&)?url=https?(:|%3a)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)"""


@query("op7_url_filter", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.with_verdict(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.counted("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


# The remainders of one byte, and the checksum of a text from them.
_CRC_TABLE = """
bytes AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS c
          FROM (SELECT unnest(range(256)) AS i))"""


def _crc(text: str) -> str:
    raw = f"list_transform(range(CAST(length(hex(encode({text}))) // 2 AS BIGINT)), lambda p: CAST('0x' || substr(hex(encode({text})), 2 * p + 1, 2) AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {raw}, lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295)"


OP11_SQL = f"""
WITH {_CRC_TABLE.strip()},
docs AS ({_WORDS.format(id='doc_id', table='documents')}), aim AS ({_WORDS.format(id='item_id', table='benchmark')}),
numbered AS (SELECT row_number() OVER () AS r, doc_id, w FROM docs),
doc_words AS (SELECT r, unnest(w) AS word FROM numbered), aim_words AS (SELECT unnest(w) AS word FROM aim),
hashed AS MATERIALIZED (SELECT word, {_crc('word')} % 10000 AS bucket
                        FROM (SELECT word FROM doc_words UNION SELECT word FROM aim_words), bytes),
counted AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM (
  SELECT bucket, 1 AS s, 0 AS t FROM doc_words JOIN hashed USING (word) UNION ALL
  SELECT bucket, 0, 1 FROM aim_words JOIN hashed USING (word)) GROUP BY bucket),
gained AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE))
                  / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counted),
weights AS (SELECT r, sum(gain) AS weight FROM doc_words JOIN hashed USING (word) JOIN gained USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
                       / 4294967296.0))) AS BIGINT) AS score FROM numbered LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)"""


@query("op11_target_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = target_resampling.with_score(docs, table(spark, sf_dir, "benchmark"))
    return target_resampling.with_rank(scored.select("doc_id", "n_features", "weight", "score"))


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE.strip()},
found AS (SELECT doc_id, word, count(*) AS n FROM (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS word
  FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT word, n, {_crc("doc_id || ':' || word")} AS h FROM found, bytes WHERE length(word) >= 6),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(word, 1, CAST(h % length(word) AS BIGINT)) || substr(word, CAST(h % length(word) + 2 AS BIGINT)) ELSE word END AS word, n FROM hashed),
vocabulary AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS left_over FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
changed AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.left_over = b.left_over AND a.i = b.i AND a.word <> b.word),
shorter AS (SELECT DISTINCT h.word, h.n, v.word AS near, v.n AS near_n FROM holes h JOIN vocabulary v ON v.word = h.left_over),
pairs AS (SELECT word, near, near_n FROM changed UNION ALL SELECT word, near, near_n FROM shorter UNION ALL SELECT near, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM pairs GROUP BY word),
firsts AS (SELECT p.word, min(p.near) AS near, max(b.near_n) AS near_n, max(b.n_near) AS n_near FROM pairs p JOIN best b ON b.word = p.word AND b.near_n = p.near_n GROUP BY p.word),
judged AS MATERIALIZED (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
                  CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM vocabulary v LEFT JOIN firsts f ON f.word = v.word),
steps AS (SELECT word, form AS root, 1 AS k FROM judged WHERE form IS NOT NULL
          UNION ALL SELECT s.word, j.form, s.k + 1 FROM steps s JOIN judged j ON j.word = s.root WHERE j.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word)
SELECT j.word, form, coalesce(root, j.word) AS root, n, n_near, form_n FROM judged j LEFT JOIN roots r ON r.word = j.word"""


@query("op12_spelling_variants", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.with_forms(spelling.vocabulary(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS d, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS MATERIALIZED (SELECT r, d, i, array_to_string(w[i:i + 12], ' ') AS words FROM (SELECT r, d, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
late AS (SELECT r, i FROM (SELECT r, d, i, min(d) OVER (PARTITION BY words) AS least FROM windows) WHERE least < d),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM late),
held AS (SELECT w.r, w.p, w.word FROM (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs) w LEFT JOIN gone g ON g.r = w.r AND g.p = w.p WHERE g.p IS NULL),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS words FROM held GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""


@query("op13_window_repeats", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
