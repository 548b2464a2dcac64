"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import load, written
from .bpe import round_trip
from .chat import format_chats, read_back
from .decontamination import contaminated
from .filter_audit import METRICS, filter_audit
from .importance import importance_resample
from .licenses import license_scan
from .ngram_join import ngram_join
from .quality_classifier import classify, train
from .quality_rules import quality_rules
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .token_counts import length_histogram, suffix_sums, with_quantiles
from .token_files import token_files


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(load(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def byte_bpe() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return got.select("doc_id", F.element_at("item_ids", 1).alias("item_id"), "item_ids", "n_item_words", "start", "n_overlap", "n_equal")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = round_trip(load(spark, sf_dir, "documents"), *byte_bpe())
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(load(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan(load(spark, sf_dir, "documents"))
    return got.select("doc_id", "license", F.round("dice", 6).alias("dice"), F.sort_array(F.array_distinct("found.license")).alias("licenses"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = token_files(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return got.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written, since the sums read it more than once and it holds the encoding.
    sums = suffix_sums(written(length_histogram(load(spark, sf_dir, "documents"), *byte_bpe()), "token-lengths"))
    return with_quantiles(sums, [1, 5, 10, 25, 50, 75, 90, 95, 99, 100])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 poor, 1 toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return load(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    got = classify(docs, train(docs, grades(spark, sf_dir), n_grades=3), wanted=2)
    return got.select("doc_id", F.round("graded.expected_grade", 6).alias("expected_grade"), F.round("graded.p_tail", 6).alias("p_tail"), F.col("graded.kept").alias("kept"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = importance_resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionAll(spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema))
    return read_back(format_chats(turns)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).select("part", "filter_order", "step", *METRICS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_ngram_join": op4_ngram_join,
    "op5_sharding": op5_sharding,
    "op6_license_scan": op6_license_scan,
    "op7_token_files": op7_token_files,
    "op8_token_counts": op8_token_counts,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_filter_audit": op13_filter_audit,
}

_SKETCHED = "CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) END"

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM p) WHERE n > 1),
cov AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY id),
l AS (SELECT id, sum(n) AS n_lines, sum(n - 1) AS dup FROM (SELECT id, line, count(*) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id, line) GROUP BY id),
m AS (SELECT w.id, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (id) LEFT JOIN l USING (id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  coalesce(word_chars * 1000 // nullif(n_words, 0), 0) AS word_milli, coalesce(n_symbols * 10000 // nullif(word_chars, 0), 0) AS symbol_rate,
  coalesce(n_dup_lines * 10000 // nullif(n_lines, 0), 0) AS dup_line_rate, coalesce(n_repeat_words * 10000 // nullif(n_words, 0), 0) AS repeat_rate FROM m),
u AS (SELECT lang, source, rate, v FROM b UNPIVOT (v FOR rate IN (word_milli, symbol_rate, dup_line_rate, repeat_rate)) WHERE NOT base_failed),
s AS (SELECT lang, source, rate, {_SKETCHED} AS value FROM u),
lv AS (SELECT 2 AS level, lang, source, rate, value FROM s UNION ALL SELECT 1, lang, NULL, rate, value FROM s UNION ALL SELECT 0, NULL, NULL, rate, value FROM s),
n AS (SELECT level, lang, source, rate, value, count(*) AS n FROM lv GROUP BY level, lang, source, rate, value),
c AS (SELECT level, lang, source, rate, value, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY value) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM n),
q AS (SELECT level, lang, source, rate, max(total) AS total, min(CASE WHEN upto * 100 >= total * 25 THEN value END) AS q1, min(CASE WHEN upto * 100 >= total * 75 THEN value END) AS q3 FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, rate, total, q1 - 3 * greatest(q3 - q1, CASE rate WHEN 'symbol_rate' THEN 500 ELSE 1000 END) AS low, q3 + 3 * greatest(q3 - q1, CASE rate WHEN 'symbol_rate' THEN 500 ELSE 1000 END) AS high FROM q),
k AS (SELECT g.lang, g.source, max(CASE WHEN f.total >= 50 THEN f.level WHEN f.level = 0 THEN 0 END) AS level FROM (SELECT DISTINCT lang, source FROM b) g
  JOIN f ON f.level = 0 OR (f.lang IS NOT DISTINCT FROM g.lang AND (f.level = 1 OR f.source IS NOT DISTINCT FROM g.source)) GROUP BY ALL),
t AS (SELECT k.lang, k.source, f.rate, f.low, f.high FROM k JOIN f ON f.level = k.level AND (k.level = 0 OR f.lang IS NOT DISTINCT FROM k.lang) AND (k.level < 2 OR f.source IS NOT DISTINCT FROM k.source)),
bad AS (SELECT DISTINCT b.id FROM (SELECT id, lang, source, rate, v FROM b UNPIVOT (v FOR rate IN (word_milli, symbol_rate, dup_line_rate, repeat_rate))) b
  JOIN t ON t.rate = b.rate AND t.lang IS NOT DISTINCT FROM b.lang AND t.source IS NOT DISTINCT FROM b.source WHERE b.v < t.low OR b.v > t.high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.id IS NULL AS kept FROM b LEFT JOIN bad USING (id)
""",
    "op11_importance_resampling": r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
tw AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT id, unnest(ws) AS w FROM tw),
c AS (SELECT id, w, count(*) AS n FROM dw GROUP BY ALL),
v AS (SELECT w, xor(list_reduce(list_transform(range(len(hex(w)) // 2), lambda j: CAST('0x' || substr(hex(w), 2 * j + 1, 2) AS BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM (SELECT w FROM c UNION ALL SELECT w FROM bw)) CROSS JOIN crc),
s AS (SELECT bucket, sum(n) AS s FROM c JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (w) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
g AS (SELECT b.range AS bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM range(10000) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range CROSS JOIN tot),
m AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS gain FROM c JOIN v USING (w) JOIN g USING (bucket) GROUP BY id),
w AS (SELECT id, doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN gain // n_features - CAST(gain % n_features < 0 AS BIGINT) ELSE 0 END AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h FROM tw LEFT JOIN m USING (id)),
sc AS (SELECT id, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM w),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (id)
""",
    "op12_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(\[/?(?:SYS|INST|ROLE)\]|\[AS\]|</?s>|<\|(?:image|audio|document)\|>)', '\1#', 'g')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CAST(len(ws) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INTEGER)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
  list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(filter_order[j]) - 65))) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT part, filter_order, step, bit,
  sum(n) FILTER (mask & bit = 0 AND mask & coalesce(earlier, 0)::INTEGER = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::INTEGER = 0) AS removed,
  sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::INTEGER <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(n) FILTER (good AND mask & bit <> 0 AND mask & coalesce(earlier, 0)::INTEGER = 0) AS good_lost, sum(n) FILTER (toxic AND mask & bit <> 0 AND mask & coalesce(earlier, 0)::INTEGER = 0) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM m
""",
}
