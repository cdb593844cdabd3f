"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import chat, decontam, fingerprint, language, licenses, lm, mixture, neardup, sharding, toxicity
from cohortlab.llm.common import id_crc, materialize, table


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, toxicity.train_rows(table(spark, sf_dir, "labels")))
    rows = docs.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "text")
    return toxicity.score(rows, net, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.training_texts(language.train_rows(docs)))
    rows = docs.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "text")
    return language.identify(rows, model, ["doc_id", "held_out"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprint.fingerprint_edits(table(spark, sf_dir, "documents")), compression="zstd")
    return fingerprint.near_classes(prints)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc("doc_id") % 5 == 1
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    scored, model = lm.score(rows, ~F.col("held_out"), ["doc_id", "held_out"])
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    return chat.read_back(chat.format_turns(told.union(probe)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  substr(md5('0|' || coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(text, '')), 1, 12) AS h FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS w, source_size * 3.0::DOUBLE AS room FROM s),
l AS (SELECT *, room / w AS fill, (sum(source_size) OVER () - (sum(room) OVER u - room)) / (sum(w) OVER () - (sum(w) OVER u - w)) AS level FROM w
      WINDOW u AS (ORDER BY room / w, k ROWS UNBOUNDED PRECEDING)),
t AS (SELECT k, source_size, least(room, w * coalesce((SELECT arg_min(level, (fill, k)) FROM l WHERE fill >= level), 0)) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT k, h, sum(size) AS s FROM d GROUP BY k, h),
c AS (SELECT g.*, sum(s) OVER (PARTITION BY g.k ORDER BY h ROWS UNBOUNDED PRECEDING) AS cum, target - whole * source_size AS need FROM g JOIN f USING (k)),
x AS (SELECT k, h, cum <= need OR (cum - s <= need AND s <= 2 * (need - (cum - s))) AS yes FROM c)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN yes THEN 1 ELSE 0 END))::BIGINT AS taken FROM d JOIN f USING (k) JOIN x USING (k, h)
"""


def _crc32(text: str) -> str:
    """SQL: crc32 of a text's UTF-8 bytes, byte after byte; the table's entry is the sum of those of its bits."""

    def entry(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c

    step = "(c >> 8)"
    for bit in range(8):
        step = f"xor({step}, ((xor(c & 255, b) >> {bit}) & 1) * {entry(1 << bit)})"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step}), 4294967295::BIGINT)"


def _strength(counts: str, once: str, places: str) -> str:
    """SQL: 10 ^ x where the chance of a new successor is once / places, found by halving.

    counts: a list of structs (c, n)."""
    new = f"list_sum(list_transform({counts}, lambda e: e.c * e.n * pow(10, x + s) / (e.c - 1 + pow(10, x + s)))) / list_sum(list_transform({counts}, lambda e: e.c * e.n))"
    steps = ", ".join(f"{9 / 2**k!r}::DOUBLE" for k in range(1, 61))
    x = f"list_reduce([-3.0::DOUBLE, {steps}], lambda x, s: CASE WHEN {new} < {once} / {places}::DOUBLE THEN x + s ELSE x END)"
    return f"CASE WHEN {places} > 0 THEN pow(10, {x} + {9 / 2**61!r}) ELSE 1.0::DOUBLE END"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The end of a text is the empty word, its begin a space.
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_crc32("coalesce(doc_id::VARCHAR, '')")} % 5 = 1 AS held,
                  list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ 	-
]+'), '') AS w FROM documents),
p AS (SELECT r, held, w[i] AS c, CASE WHEN i = 1 THEN ' ' ELSE w[i - 1] END AS b, CASE WHEN i = 2 THEN ' ' WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT c, count(*) AS n FROM p WHERE NOT held GROUP BY c),
c2 AS (SELECT b, c, count(*) AS n FROM p WHERE NOT held GROUP BY b, c),
c3 AS (SELECT a, b, c, count(*) AS n FROM p WHERE NOT held AND a IS NOT NULL GROUP BY a, b, c),
k1 AS (SELECT c AS b, n FROM c1 WHERE c <> '' UNION ALL SELECT ' ', n FROM c1 WHERE c = ''),
cc AS (SELECT o, n >> low << low AS c, count(*) AS n FROM (SELECT *, greatest(floor(log2(n))::INT - 9, 0) AS low FROM (SELECT 1 AS o, n FROM c1 UNION ALL SELECT 2, n FROM c2 WHERE c <> '')) GROUP BY ALL),
g AS (SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM c1) AS nn, (SELECT count(*) FROM c1) AS v, (SELECT count(*) FROM c1 WHERE n = 1) AS n1, (SELECT count(*) FROM c1 WHERE n = 2) AS n2,
             (SELECT list({{'c': c, 'n': n}}) FROM cc WHERE o = 1) AS l1, (SELECT list({{'c': c, 'n': n}}) FROM cc WHERE o = 2) AS l2,
             (SELECT count(*) FROM c2 WHERE n = 1) AS s2, (SELECT coalesce(sum(n >> greatest(floor(log2(n))::INT - 9, 0) << greatest(floor(log2(n))::INT - 9, 0)), 0)::BIGINT FROM c2) AS t2,
             (SELECT count(*) FROM c3 WHERE n = 1) AS s3, (SELECT coalesce(sum(n >> greatest(floor(log2(n))::INT - 9, 0) << greatest(floor(log2(n))::INT - 9, 0)), 0)::BIGINT FROM c3) AS t3),
m AS (SELECT nn, v, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2)::DOUBLE ELSE 0.5::DOUBLE END AS dd, {_strength("l1", "s2", "t2")} AS m2, {_strength("l2", "s3", "t3")} AS m3 FROM g),
x AS (SELECT p.r, coalesce(c1.n, 0) AS x1, coalesce(c2.n, 0) AS x2, coalesce(c3.n, 0) AS x3, coalesce(k1.n, 0) AS h1, CASE WHEN p.a IS NULL THEN 0 ELSE coalesce(k2.n, 0) END AS h2
      FROM p LEFT JOIN c1 USING (c) LEFT JOIN c2 ON p.b = c2.b AND p.c = c2.c LEFT JOIN c3 ON p.a = c3.a AND p.b = c3.b AND p.c = c3.c LEFT JOIN k1 ON p.b = k1.b LEFT JOIN c2 k2 ON p.a = k2.b AND p.b = k2.c),
q1 AS (SELECT x.*, m.*, CASE WHEN x1 > 0 THEN (x1 - dd) / nn ELSE dd * v / nn END AS p1 FROM x, m),
q2 AS (SELECT *, CASE WHEN h1 > 0 THEN (x2 + m2 * p1) / (h1 + m2) ELSE p1 END AS p2 FROM q1),
q3 AS (SELECT r, log10((x1 + 0.5::DOUBLE) / (nn + 0.5::DOUBLE * (v + 1))) AS base, x1, nn, log10(CASE WHEN h2 > 0 THEN (x3 + m3 * p2) / (h2 + m3) ELSE p2 END) AS s FROM q2)
SELECT doc_id, held AS held_out, n_tokens, n_known, base_score, score, nn AS train_tokens
FROM d JOIN (SELECT r, count(*) AS n_tokens, count(*) FILTER (x1 > 0) AS n_known, sum(base) AS base_score, sum(s) AS score, any_value(nn) AS nn FROM q3 GROUP BY r) USING (r)
"""

_NUMBER = r"^\p{Nd}"
OP5_SQL = rf"""
WITH u AS (SELECT 0 AS side, row_number() OVER () AS r, id, text FROM (SELECT DISTINCT doc_id AS id, text FROM documents WHERE text IS NOT NULL)
           UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark WHERE text IS NOT NULL),
y AS (SELECT side, r, unnest(p) AS s, generate_subscripts(p, 1) AS i
      FROM (SELECT side, r, regexp_extract_all(regexp_replace(text, '[{decontam.NAME}-{decontam.UNIT}]', ' ', 'g'), '\p{{Nd}}+(?:[.,:/]\p{{Nd}}+)*|[\p{{L}}\p{{M}}\p{{Nl}}\p{{No}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+') AS p FROM u)),
z AS (SELECT *, coalesce(regexp_matches(lag(s) OVER o, '{_NUMBER}'), false) AS after_number, coalesce(lag(s) OVER o IN (' ', chr(9)) AND regexp_matches(lag(s, 2) OVER o, '{_NUMBER}'), false) AS near_number,
             coalesce(regexp_matches(lead(s) OVER o, '{_NUMBER}'), false) AS before_number FROM y WINDOW o AS (PARTITION BY side, r ORDER BY i)),
k AS (SELECT side, r, i, lower(s) AS v, CASE WHEN regexp_matches(s, '{_NUMBER}') THEN 'n'
        WHEN NOT after_number AND regexp_matches(s, '^\p{{Lu}}\p{{Ll}}') AND (before_number OR NOT regexp_full_match(s, '{decontam.OPENERS}')) THEN 'm'
        WHEN (after_number OR near_number) AND NOT before_number AND regexp_full_match(s, '(?i:{decontam.UNITS})') THEN 'u' ELSE '' END AS kind FROM z WHERE regexp_matches(s, '^[\p{{L}}\p{{M}}\p{{N}}]')),
w AS (SELECT side, r, list(v ORDER BY i) AS v, list(kind ORDER BY i) AS kd, list(CASE WHEN kind = '' THEN v ELSE '#' || kind END ORDER BY i) AS t FROM k GROUP BY side, r),
b0 AS (SELECT u.id AS item, w.*, least(len(t), 8) AS n FROM w JOIN u USING (side, r) WHERE side = 1),
b1 AS (SELECT item, n, bpos, kd[bpos : bpos + n - 1] AS kd, v[bpos : bpos + n - 1] AS bv, t[bpos : bpos + n - 1] AS t FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS bpos FROM b0)),
b AS (SELECT *, 2 * len(list_filter(kd, lambda x: x <> '')) > n AS heavy, array_to_string(t, ' ') || CASE WHEN 2 * len(list_filter(kd, lambda x: x <> '')) > n THEN '|' || array_to_string(bv, ' ') ELSE '' END AS h FROM b1),
d1 AS (SELECT r, n, pos, kd[pos : pos + n - 1] AS kd, v[pos : pos + n - 1] AS dv, t[pos : pos + n - 1] AS t
       FROM (SELECT w.*, n, unnest(range(1, len(t) - n + 2)) AS pos FROM w, (SELECT DISTINCT n FROM b0) WHERE side = 0 AND len(t) >= n AND (n >= {decontam.LEAST_TOKENS} OR len(t) = n))),
d AS (SELECT *, array_to_string(t, ' ') || CASE WHEN 2 * len(list_filter(kd, lambda x: x <> '')) > n THEN '|' || array_to_string(dv, ' ') ELSE '' END AS h FROM d1),
hits AS (SELECT d.r, item, pos - bpos AS shift, bpos, heavy, list_transform(list_filter(range(1, n + 1), lambda i: kd[i] <> ''), lambda i: {{'b': bv[i], 'd': dv[i]}}) AS ps
         FROM (SELECT d.r, d.pos, d.dv, b.* FROM d JOIN b ON d.h = b.h AND d.n = b.n) d),
pl AS (SELECT r, item, shift, coalesce(list(DISTINCT bpos) FILTER (NOT heavy), []) AS lat, coalesce(list(DISTINCT bpos) FILTER (heavy), []) AS hat,
              coalesce(list_distinct(flatten(list(ps) FILTER (NOT heavy))), []) AS pairs, coalesce(list_distinct(flatten(list(ps) FILTER (heavy))), []) AS eq FROM hits GROUP BY ALL),
sh AS (SELECT *, CASE WHEN len(pairs) > 0 THEN least(len(list_distinct(list_transform(pairs, lambda e: e.b))), len(list_distinct(list_transform(pairs, lambda e: e.d)))) / len(pairs)::DOUBLE ELSE 1.0::DOUBLE END AS share FROM pl),
ok AS (SELECT r, item, hat, CASE WHEN share >= 0.75 THEN lat ELSE [] END AS lat, CASE WHEN share >= 0.75 THEN list_distinct(list_concat(pairs, eq)) ELSE eq END AS pairs, CASE WHEN share >= 0.75 THEN share ELSE 1.0::DOUBLE END AS share
       FROM sh WHERE share >= 0.75 OR len(hat) > 0),
f AS (SELECT r, item, len(list_distinct(flatten(list(lat)))) AS in_text, len(list_distinct(flatten(list(hat)))) AS dense, sum(len(pairs))::BIGINT AS slots, min(share) AS consistency,
             bool_and(len(list_filter(pairs, lambda e: e.b <> e.d)) = 0) AS verbatim FROM ok GROUP BY r, item),
sz AS (SELECT item, count(DISTINCT bpos) AS item_windows, count(DISTINCT bpos) FILTER (NOT heavy) AS text_windows FROM b GROUP BY item)
SELECT u.id AS doc_id, item AS item_id, in_text + dense AS windows, item_windows, (in_text + dense) / item_windows::DOUBLE AS coverage, slots, consistency, verbatim
FROM f JOIN sz USING (item) JOIN u ON u.side = 0 AND u.r = f.r WHERE in_text >= greatest(least(3, text_windows), 1) OR in_text + dense >= greatest(least(3, item_windows), 1)
"""

_ESCAPED = rf"[<\[]{chat.ESCAPE}*{chat.REST}".replace("'", "''")
OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
o AS (SELECT *, substr(sha256(role || chr(10) || text), 1, 16) AS tie, len(regexp_extract_all(role, '{_ESCAPED}')) + len(regexp_extract_all(text, '{_ESCAPED}')) AS escapes FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, tie)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({sum(map(len, chat.CONTROL))} + length(role) + length(text) + escapes)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce('0' || source, '1') AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc32("coalesce(text, '')")} AS crc,
                  ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(text, '')), 1, 13))::BIGINT AS h FROM documents),
f AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY h, doc_id NULLS FIRST, crc, size) - 1 + (('0x' || substr(md5('0|' || k), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY k) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, k, h, doc_id NULLS FIRST, crc, size) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (pos * 8 // n)::INT AS shard, (pos - ((pos * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM p
"""


def queries() -> dict:
    return {"op1_neardup": op1_neardup, "op2_toxicity": op2_toxicity, "op3_licenses": op3_licenses, "op4_language": op4_language, "op5_decontamination": op5_decontamination, "op6_fingerprint": op6_fingerprint, "op7_lm": op7_lm, "op8_mixture": op8_mixture, "op9_chat": op9_chat, "op10_sharding": op10_sharding}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op7_lm": OP7_SQL, "op8_mixture": OP8_SQL, "op9_chat": OP9_SQL, "op10_sharding": OP10_SQL}
