"""Registered queries of the training-data operators.

A query applies its operator to its whole table and derives the digest columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, lm_score, mixing, ngram_join, quality, secrets, sharding, suffix_dedup
from .common import staged, table

#: The conversation that op1 adds: control strings and an escape inside its texts.
HOSTILE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat_format.parse_chats(chat_format.format_chats(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat_format.learned_text(read)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), '<next/>', '\x') AS body,
    replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), '<next/>', '\x'), chr(10), '\n') AS head,
    lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN opens THEN length(head) + 6 ELSE 0 END + CASE WHEN closes THEN 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.quality_rules(table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# Fixed values, written out again so that a wrong list does not pass on both sides.
_OP2_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that for it as was with be by on not he are this",
    "es": "de la que el en y a los se del las un por con no una su para es al",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
}
_OP2_CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"[\x20\x09-\x0D]+", r"""[.,;:!?'"()\-]+""", r"[#*$%&|<>=_{}\[\]/\\+~^@`]+")


def _op2_sql() -> str:
    """The base rules and the divergence verdict."""
    common = " UNION ALL ".join(f"SELECT '{lang}' AS lang, string_split('{ws}', ' ') AS ws" for lang, ws in _OP2_WORDS.items())
    rest, chars = "coalesce(text, '')", []
    for p in _OP2_CLASSES:
        after = f"regexp_replace({rest}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
        chars.append(f"length({rest}) - length({after})")
        rest = after
    chars.append(f"length({rest})")
    n = len(chars)
    js = lambda p, q: (
        f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: "
        f"(CASE WHEN z[1] > 0 THEN z[1] / list_sum({p}) * log2(2 * (z[1] / list_sum({p})) / (z[1] / list_sum({p}) + z[2] / list_sum({q}))) ELSE 0 END"
        f" + CASE WHEN z[2] > 0 THEN z[2] / list_sum({q}) * log2(2 * (z[2] / list_sum({q})) / (z[1] / list_sum({p}) + z[2] / list_sum({q}))) ELSE 0 END) / 2))))"
    )
    return rf"""
WITH c AS ({common}), w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, coalesce(c.ws, CAST([] AS VARCHAR[])) AS common
  FROM documents LEFT JOIN c USING (lang)
), b AS (
  SELECT *, row_number() OVER () AS rid, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    [{', '.join(chars)}] AS chars
  FROM w
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM b, unnest(range(1, n_words - 3)) AS r(i) WHERE n_words >= 5
), again AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS k FROM g) WHERE k > 1
), cover AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM (SELECT *, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid
), f AS (
  SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed,
    list_transform(common, lambda v: len(list_filter(ws, lambda x: x = v))) AS hits
  FROM b LEFT JOIN cover USING (rid)
), h AS (
  SELECT *, list_append(hits, n_words - coalesce(list_sum(hits), 0)) AS hist FROM f
), r AS (
  SELECT lang, [{', '.join(f'sum(chars[{k}])' for k in range(1, n + 1))}] AS ref_chars,
    [{', '.join(f'sum(hist[{k}])' for k in range(1, 22))}] AS ref_all, sum(n_words) AS ref_words
  FROM h WHERE NOT base_failed GROUP BY lang
), j AS (
  SELECT h.*, r.ref_words, r.ref_chars, list_slice(r.ref_all, 1, len(hist)) AS ref_hist FROM h LEFT JOIN r ON h.lang IS NOT DISTINCT FROM r.lang
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed
    AND NOT coalesce(ref_words >= 1000 AND length(text) >= 200 AND {js('chars', 'ref_chars')} > 0.3, false)
    AND NOT coalesce(ref_words >= 1000 AND n_words >= 80 AND len(hist) > 1 AND {js('hist', 'ref_hist')} > 0.3, false) AS kept
FROM j
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))


OP5_SQL = r"""
WITH q AS (SELECT doc_id, CASE max(quality) WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT documents.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(documents.doc_id AS VARCHAR), 'null') || ':17'), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / coalesce(weight, 1.0) AS key
  FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id
), s AS (
  SELECT *, 3.0::DOUBLE * source_size AS lim, (3.0::DOUBLE * source_size) / w AS ratio FROM (
    SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, row_number() OVER (ORDER BY source NULLS LAST) AS n
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source))
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(lim) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN lim ELSE w * (SELECT level FROM l WHERE ratio > level ORDER BY ratio, n LIMIT 1) END AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS epochs FROM t
), p0 AS (
  SELECT d.doc_id, d.source, size, key, source_size, target, epochs, greatest(target - epochs * source_size, 0.0) AS rest, false AS picked
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), o0 AS (SELECT *, rest - coalesce(sum(size) FILTER (WHERE picked) OVER (PARTITION BY source), 0) AS room FROM p0),
f0 AS (SELECT *, CASE WHEN NOT picked AND size > 0 AND room > 0 AND size <= room THEN size ELSE 0 END AS part FROM o0),
p1 AS (SELECT * EXCLUDE (picked, room, part, ahead), picked OR (part > 0 AND ahead + size <= room) AS picked FROM (SELECT *, coalesce(sum(part) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM f0)),
o1 AS (SELECT *, rest - coalesce(sum(size) FILTER (WHERE picked) OVER (PARTITION BY source), 0) AS room FROM p1),
f1 AS (SELECT *, CASE WHEN NOT picked AND size > 0 AND room > 0 AND size <= room THEN size ELSE 0 END AS part FROM o1),
p2 AS (SELECT * EXCLUDE (picked, room, part, ahead), picked OR (part > 0 AND ahead + size <= room) AS picked FROM (SELECT *, coalesce(sum(part) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM f1)),
o2 AS (SELECT *, rest - coalesce(sum(size) FILTER (WHERE picked) OVER (PARTITION BY source), 0) AS room FROM p2),
f2 AS (SELECT *, CASE WHEN NOT picked AND size > 0 AND room > 0 AND size <= 2 * room THEN size ELSE 0 END AS part FROM o2),
p3 AS (SELECT * EXCLUDE (picked), picked OR (part > 0 AND 2 * ahead + size <= 2 * room) AS picked FROM (SELECT *, coalesce(sum(part) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM f2))
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN picked THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p3
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    blobs = staged(secrets.blob_store(versions), "blobs")
    # One run with the base rules fills the ledger; the next has more rules, and scans only the pairs that it lacks.
    ledger = staged(secrets.unseen(blobs, None, secrets.RULES[: len(secrets.BASE_KINDS)]), "ledger")
    found, _ = secrets.scan(versions, ledger, secrets.RULES, blobs)
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *[count(k) for k in secrets.BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: The rules again, as the contract words them: kind, pattern, group whose length counts, least length.
_OP7_RULES = (
    ("assign", r"""((?:(?i)password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)


def _op7_sql() -> str:
    """Matches by position: the pieces between them are what the pattern splits off."""
    parts = []
    for k, (kind, pattern, group, least) in enumerate(_OP7_RULES):
        pattern = pattern.replace("'", "''")
        good = f"length(regexp_extract(m[k], '{pattern}', {group})) >= {least}"
        parts.append(
            f"SELECT rid, {k} AS rank, '{kind}' AS kind, k, m, s, {good} AS good FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS s FROM d), unnest(range(1, len(m) + 1)) AS u(k)"
        )
    base = ("assign", "access", "hex")
    kinds, listed = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base), ", ".join(f"'{k}'" for k in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({' UNION ALL '.join(parts)}),
y AS (SELECT rid, rank, kind, length(m[k]) AS size, coalesce(list_sum(list_transform(s[1:k], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda v: length(v))), 0) AS start FROM x WHERE good),
z AS (SELECT rid, {kinds},
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, rank) FILTER (WHERE kind IN ({listed})) AS base,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, rank) AS spans FROM y GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z USING (rid)
"""


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"), width=4, percent=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS r(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT c.x, e.b FROM c JOIN e ON e.a = c.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.m, w.doc_id) AS component_id, coalesce(d.k, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) AS d ON d.a = w.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM c GROUP BY x) AS r ON r.x = w.doc_id
"""


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = (op1_chat_format, op2_quality_rules, op3_decontaminate, op4_suffix_dedup, op5_mixing, op6_sharding, op7_secret_scan, op8_ngram_join, op9_lm_score, op10_line_dedup)


def queries() -> dict:
    import corpus_pipeline

    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_quality_rules": _op2_sql(), "op5_mixing": OP5_SQL, "op7_secret_scan": _op7_sql(), "op8_ngram_join": OP8_SQL}
