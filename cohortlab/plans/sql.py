"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations


def number(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(f"({p})::VARCHAR" for p in parts) + "), 1, 8))::BIGINT"


def padded(x: str, width: int) -> str:
    return f"CASE WHEN length(({x})::VARCHAR) >= {width} THEN ({x})::VARCHAR ELSE lpad(({x})::VARCHAR, {width}, '0') END"


M = f"""
e AS (SELECT event_id, ts, CASE WHEN event_type IN ('click', 'purchase') THEN 'flip' ELSE 'notflip' END AS label,
             CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS target, {padded('user_id', 4)} AS video_id,
             CASE WHEN {number("'s'", 'event_id')} % 5 = 0 THEN 'testing' ELSE 'training' END AS supplied_split FROM events),
mf AS (SELECT *, substr(sha256(event_id::VARCHAR), 1, 16) AS sample_id, label || '::' || video_id AS source_key,
              row_number() OVER (PARTITION BY label, video_id ORDER BY ts, event_id) AS frame_number FROM e),
m AS (SELECT *, supplied_split || '/' || label || '/' || video_id || '_' || {padded('frame_number', 6)} || '.jpg' AS relative_path FROM mf),
src AS (SELECT DISTINCT source_key, label FROM m),
rk AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY frame_number, sample_id) AS rn, count(*) OVER (PARTITION BY source_key) AS n FROM m)
"""


def held(name: str, table: str, key: str, fraction: float, seed: int = 42) -> str:
    return f"""
{name}_c AS (SELECT label, count(*) AS c FROM {table} GROUP BY label),
{name}_t AS (SELECT label, c, sum(c) OVER ()::BIGINT AS a, ceil({fraction}::DOUBLE * (sum(c) OVER ())::BIGINT)::BIGINT AS total FROM {name}_c),
{name}_b AS (SELECT label, total * c // a AS base, total, row_number() OVER (ORDER BY total * c % a DESC, label) AS r FROM {name}_t),
{name}_a AS (SELECT label, base + CASE WHEN r <= total - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM {name}_b),
{name} AS (SELECT key FROM (SELECT {key} AS key, label, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || {key}), {key}) AS r FROM {table}) JOIN {name}_a USING (label) WHERE r <= take)"""


S = f"""{M},
tr AS (SELECT sample_id, label FROM m WHERE supplied_split = 'training'),{held('ho', 'tr', 'sample_id', 0.1)},
so AS (SELECT *, CASE WHEN supplied_split = 'testing' THEN 'test' WHEN sample_id IN (SELECT key FROM ho) THEN 'validation' ELSE 'train' END AS role FROM m),
{held('hs', 'src', 'source_key', 0.2)},
dv AS (SELECT * FROM src WHERE source_key NOT IN (SELECT key FROM hs)),{held('hv', 'dv', 'source_key', 0.1)},
ss AS (SELECT *, CASE WHEN source_key IN (SELECT key FROM hs) THEN 'test' WHEN source_key IN (SELECT key FROM hv) THEN 'validation' ELSE 'train' END AS role FROM m),
st AS (SELECT * EXCLUDE (rn, n), CASE WHEN rn <= n - 2 * greatest(1, round_even(0.1::DOUBLE * n, 0)::BIGINT) THEN 'train' WHEN rn <= n - greatest(1, round_even(0.1::DOUBLE * n, 0)::BIGINT) THEN 'validation' ELSE 'test' END AS role FROM rk),
sx AS (SELECT * EXCLUDE (rn, n), CASE WHEN source_key IN (SELECT key FROM hs) THEN CASE WHEN rn <= n - greatest(1, round_even(0.2::DOUBLE * n, 0)::BIGINT) THEN 'context_unseen_early' ELSE 'test' END
             WHEN rn <= n - greatest(1, round_even(0.2::DOUBLE * n, 0)::BIGINT) THEN 'train' ELSE 'validation' END AS role FROM rk),
al AS (SELECT *, 'O' AS regime FROM so UNION ALL BY NAME SELECT *, 'S' AS regime FROM ss UNION ALL BY NAME SELECT *, 'T' AS regime FROM st UNION ALL BY NAME SELECT *, 'ST' AS regime FROM sx)
"""


def predicted(name: str, table: str, salt: str = "p") -> str:
    p = f"greatest(0, least(9999, {number(repr(salt), 'event_id')} % 10000 // 2 + CASE WHEN target = 1 THEN 4000 - 20 * frame_number ELSE 1000 + 20 * frame_number END)) / 10000.0::DOUBLE"
    return f"{name}_p AS (SELECT *, {p} AS prob_flip FROM {table}), {name} AS (SELECT *, (prob_flip >= 0.5)::INT AS prediction, (prob_flip >= 0.5)::INT = target AS correct FROM {name}_p)"


CELLS = "count(*) FILTER (target = 0 AND prediction = 0) AS tn, count(*) FILTER (target = 0 AND prediction = 1) AS fp, count(*) FILTER (target = 1 AND prediction = 0) AS fn, count(*) FILTER (target = 1 AND prediction = 1) AS tp"


def div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def zero(x: str) -> str:
    return f"coalesce({x}, 0)"


F1P, F1N = zero(div("2 * tp", "2 * tp + fp + fn")), zero(div("2 * tn", "2 * tn + fp + fn"))
MACRO = f"(({F1P} + {F1N}) / 2)"
RECALL, PRECISION = zero(div("tp", "tp + fn")), zero(div("tp", "tp + fp"))
CONF = "CASE WHEN prediction = 1 THEN prob_flip ELSE 1 - prob_flip END"
T = f"{S}, te AS (SELECT * FROM al WHERE role = 'test'), {predicted('pt', 'te')}, cf AS (SELECT regime, {CELLS} FROM pt GROUP BY regime)"
PTS = f"""{M},{held('hs', 'src', 'source_key', 0.2)},
cv AS (SELECT *, greatest(2, floor(coverage_percent / 100.0::DOUBLE * n))::BIGINT AS observed, source_key IN (SELECT key FROM hs) AS unseen FROM rk, (SELECT unnest([25, 50, 75, 90]) AS coverage_percent)),
pa AS (SELECT *, CASE WHEN rn <= greatest(1, observed - greatest(1, floor(0.2::DOUBLE * observed))) THEN 'train' WHEN rn <= observed THEN 'validation' ELSE 'future' END AS part FROM cv),
pts AS (SELECT pa.*, regime, CASE WHEN part = 'future' THEN rn - observed END AS horizon_position, CASE WHEN part = 'future' THEN rn / n::DOUBLE * 100 END AS frame_position_percent
        FROM pa, (SELECT unnest(['T', 'ST']) AS regime) WHERE regime = 'T' OR unseen = (part = 'future'))
"""
FU = f"{PTS}, fu AS (SELECT * FROM pts WHERE part = 'future'), {predicted('pf', 'fu')}"
MS = f"""{FU},
wh AS (SELECT regime, coverage_percent, count(*) AS n_future, {CELLS} FROM pf GROUP BY ALL),
lt AS (SELECT regime, coverage_percent, count(*) AS n_matched, {CELLS} FROM pf WHERE frame_position_percent > 90 GROUP BY ALL),
ms AS (SELECT regime, coverage_percent, n_future, round({MACRO}, 6) AS future_macro_f1, round({RECALL}, 6) AS future_flip_recall,
              round(2 * {PRECISION} * {RECALL} / greatest({PRECISION} + {RECALL}, 1e-12), 6) AS future_flip_f1, fn AS false_negatives, fp AS false_positives, n_matched, matched_macro_f1, matched_flip_recall
       FROM wh LEFT JOIN (SELECT regime, coverage_percent, n_matched, round({MACRO}, 6) AS matched_macro_f1, round({RECALL}, 6) AS matched_flip_recall FROM lt) USING (regime, coverage_percent))
"""
ACC = """ac AS (SELECT regime, (SELECT count(DISTINCT sample_id) FROM m) - count(*) FILTER (known) AS missing, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (c > 1) AS repeated
 FROM (SELECT regime, sample_id, count(*) AS c, sample_id IN (SELECT sample_id FROM m) AS known FROM al GROUP BY ALL) GROUP BY regime)"""
LEAK = """lk AS (SELECT regime, count(*) FILTER (t) AS test_sources, count(*) FILTER (t AND d) AS also_in_development, count(*) FILTER (r > 1) AS sources_with_many_roles
 FROM (SELECT regime, source_key, bool_or(role = 'test') AS t, bool_or(role IN ('train', 'validation')) AS d, count(DISTINCT role) AS r FROM al GROUP BY ALL) GROUP BY regime)"""
CHRON = """bd AS (SELECT regime, source_key, max(frame_number) FILTER (role = 'train') AS a, min(frame_number) FILTER (role = 'validation') AS b, max(frame_number) FILTER (role = 'validation') AS c,
  min(frame_number) FILTER (role = 'test') AS d, max(frame_number) FILTER (role = 'context_unseen_early') AS x FROM al WHERE regime IN ('T', 'ST') GROUP BY ALL),
ch AS (SELECT regime, count(*) AS sources, count(*) FILTER (NOT coalesce(CASE WHEN regime = 'T' THEN a < b AND c < d WHEN a IS NOT NULL THEN a < b ELSE x < d END, false)) AS violations FROM bd GROUP BY regime)"""


def boot(table: str, reps: int, seed: int = 42) -> str:
    """Resamples of sources of each regime of a prediction table."""
    return f"""
pn AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY source_key) - 1 AS idx, count(*) OVER (PARTITION BY regime) AS k FROM (SELECT regime, source_key, {CELLS} FROM {table} GROUP BY ALL)),
dr AS (SELECT regime, rep, {number(f"'{seed}'", 'rep', 'slot')} % k AS idx FROM (SELECT regime, k, rep, unnest(range(1, k + 1)) AS slot FROM (SELECT DISTINCT regime, k, unnest(range(1, {reps + 1})) AS rep FROM pn))),
sm AS (SELECT regime, rep, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM dr JOIN pn USING (regime, idx) GROUP BY ALL),
sc AS (SELECT regime, {MACRO} AS s FROM sm),
iv AS (SELECT regime, count(*) AS n_resamples, round(avg(s), 6) AS bootstrap_mean, round(stddev_samp(s), 6) AS bootstrap_std, round(quantile_cont(s, 0.025), 6) AS ci_lower, round(quantile_cont(s, 0.975), 6) AS ci_upper,
       round(quantile_cont(s, 0.975) - quantile_cont(s, 0.025), 6) AS ci_width FROM sc GROUP BY regime),
po AS (SELECT regime, n_sources, round({MACRO}, 6) AS point_macro_f1 FROM (SELECT regime, count(DISTINCT source_key) AS n_sources, {CELLS} FROM {table} GROUP BY regime))"""


def pool(role: str, where: str, order: str) -> str:
    return f"SELECT regime, '{role}' AS role, row_number() OVER (PARTITION BY regime ORDER BY {order}, sample_id) AS nth, sample_id, relative_path, target, prob_flip, prediction FROM pt WHERE {where}"


BY_CONF, BY_DIST = f"{CONF} DESC", "abs(prob_flip - 0.5)"


def pick(roles: list[tuple[str, str, str]]) -> str:
    """Role after role, the first row that no earlier role has."""
    parts, used = [], []
    for i, (role, where, order) in enumerate(roles):
        free = " AND ".join(["true", *[f"(regime, sample_id) NOT IN (SELECT (regime, sample_id) FROM r{j})" for j in used]])
        parts.append(f"r{i} AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY nth) AS q FROM ({pool(role, where, order)}) WHERE {free}) WHERE q = 1)")
        used.append(i)
    return ", ".join(parts)


WRONG, RIGHT = "prediction <> target", "prediction = target"
FOUR = [("Correct notflip", f"{RIGHT} AND target = 0", BY_CONF), ("Correct flip", f"{RIGHT} AND target = 1", BY_CONF), ("High-confidence error", WRONG, BY_CONF), ("Borderline error", WRONG, BY_DIST)]
MANY = [("correct_notflip", f"{RIGHT} AND target = 0", BY_CONF), ("correct_flip", f"{RIGHT} AND target = 1", BY_CONF), ("highest_conf_error", WRONG, BY_CONF), ("near_threshold_error", WRONG, BY_DIST), ("near_threshold_correct", RIGHT, BY_DIST), ("additional_borderline", "regime = 'O'", BY_DIST)]
BATCHES = f"ba AS (SELECT run, epoch, batch, ({number(chr(39) + 'l' + chr(39), 'run', 'epoch', 'batch')} % 10000 + 100000 // epoch) / 10000.0::DOUBLE AS loss FROM (SELECT unnest(range(1, 21)) AS run), (SELECT unnest(range(1, 31)) AS epoch), (SELECT unnest(range(0, 8)) AS batch))"
SCORES = f"es AS (SELECT run, epoch, ({number(chr(39) + 'v' + chr(39), 'run', 'epoch')} % 300 + 20 * least(epoch, 12)) / 1000.0::DOUBLE AS f1 FROM (SELECT unnest(range(1, 21)) AS run), (SELECT unnest(range(1, 31)) AS epoch))"
TRIALS = f"""t0 AS (SELECT sweep, attempt, {number(chr(39) + 'k' + chr(39), 'sweep', 'attempt')} % 10 AS k, {number(chr(39) + 't' + chr(39), 'sweep', 'attempt')} AS t FROM (SELECT unnest(range(1, 5)) AS sweep), (SELECT unnest(range(1, 151)) AS attempt)),
tr AS (SELECT sweep, attempt, CASE WHEN k = 0 THEN 'failed' ELSE 'finished' END AS status, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 0.0::DOUBLE ELSE (t % 900 + 50) / 1000.0::DOUBLE END AS f1,
       CASE WHEN t % 3 = 0 THEN 'zero' ELSE 'positive' END AS weight_decay_mode, (t % 50 + 1) / 10000.0::DOUBLE AS positive_weight_decay FROM t0),
tq AS (SELECT *, status = 'finished' AND coalesce(f1 > 0, false) AS qualifies FROM tr),
tm AS (SELECT * FROM (SELECT *, coalesce(sum(qualifies::INT) OVER (PARTITION BY sweep ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM tq) WHERE had < 30 AND attempt <= 150)"""
ROLE = "sample_id, source_key, label, role"
ODD = "('training/flip/0001.jpg'), ('testing/other/0001_2.jpg'), ('training/flip/notflip/0001_2.jpg'), ('training/FLIP/0007_010.x.PNG'), ('notflip/0007_010' || chr(10) || '.png')"
SCORE_TIES = """ti AS (SELECT regime, prob_flip, count(*) FILTER (target = 1) AS tp, count(*) FILTER (target = 0) AS fp FROM pt GROUP BY ALL),
cu AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER (PARTITION BY regime) AS pos, sum(fp) OVER (PARTITION BY regime) AS neg FROM ti WINDOW w AS (PARTITION BY regime ORDER BY prob_flip DESC ROWS UNBOUNDED PRECEDING))"""
PAIR = f"{S}, te AS (SELECT * FROM sx WHERE role = 'test'), {predicted('pa', 'te')}, {predicted('pb', 'te', 'g')}"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def _paired(table: str, side: str) -> str:
    hit = lambda t, p: f"count(*) FILTER (target = {t} AND p{side} = {p})"
    return f"{hit(0, 0)} AS tn{side}, {hit(0, 1)} AS fp{side}, {hit(1, 0)} AS fn{side}, {hit(1, 1)} AS tp{side}"


def _macro(side: str) -> str:
    out = MACRO
    for p in ("tn", "fp", "fn", "tp"):
        out = out.replace(f" {p}", f" {p}{side}").replace(f"({p})", f"({p}{side})")
    return out


ORACLE: dict[str, str] = {
    "parse_name": with_(M, f"""SELECT p AS relative_path, label, supplied_split, video_id, coalesce(frame_number, -1) AS frame_number, substr(sha256(p), 1, 16) AS sample_id, CASE WHEN label IS NULL THEN -1 WHEN label = 'flip' THEN 1 ELSE 0 END AS target,
  CASE WHEN label IS NOT NULL AND video_id IS NOT NULL THEN label || '::' || video_id END AS source_key, label IS NOT NULL AND video_id IS NOT NULL AS valid FROM (
  SELECT p, CASE WHEN len(list_distinct(c)) = 1 THEN c[-1] END AS label, list_filter(list_transform(string_split(p, '/'), lambda x: lower(x)), lambda x: x IN ('training', 'testing'))[1] AS supplied_split,
    CASE WHEN regexp_full_match(s, '[0-9]+_[0-9]+') THEN string_split(s, '_')[1] END AS video_id, CASE WHEN regexp_full_match(s, '[0-9]+_[0-9]+') THEN string_split(s, '_')[2]::BIGINT END AS frame_number FROM (
    SELECT p, list_filter(list_transform(string_split(p, '/')[:-2], lambda x: lower(x)), lambda x: x IN ('flip', 'notflip')) AS c, regexp_replace(string_split(p, '/')[-1], '\\.[^.]*$', '') AS s
    FROM (SELECT relative_path AS p FROM m UNION ALL SELECT * FROM (VALUES {ODD}))))"""),
    "class_counts": with_(M, "SELECT label, count(*) AS n FROM m GROUP BY label"),
    "frames_per_source": with_(M, "SELECT source_key, count(*) AS n FROM m GROUP BY source_key"),
    "source_describe": with_(M, "SELECT count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n) AS max FROM (SELECT count(*) AS n FROM m GROUP BY source_key)"),
    "source_hist": with_(M, "SELECT CASE WHEN lo = hi THEN bins // 2 ELSE least((n - lo) * bins // (hi - lo), bins - 1) END AS bin, count(*) AS sources, min(n) AS least, max(n) AS most FROM (SELECT *, min(n) OVER () AS lo, max(n) OVER () AS hi, least(count(*) OVER (), 20) AS bins FROM (SELECT count(*) AS n FROM m GROUP BY source_key)) GROUP BY bin"),
    "collisions": with_(M, "SELECT video_id AS shared_numeric_environment_id FROM m GROUP BY video_id HAVING count(DISTINCT label) = 2"),
    "dup_positions": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1",
    "dup_content": "SELECT doc_id, content_sha256, n FROM (SELECT doc_id, h AS content_sha256, count(*) OVER (PARTITION BY h) AS n FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)) WHERE n > 1",
    "audit": with_(M, """SELECT count(*) AS n_images, count(*) FILTER (label = 'flip') AS n_flip, count(*) FILTER (label = 'notflip') AS n_notflip, count(DISTINCT source_key) AS n_reconstructed_sources, count(DISTINCT video_id) AS n_numeric_ids,
  (SELECT count(*) FROM (SELECT video_id FROM m GROUP BY video_id HAVING count(DISTINCT label) = 2)) AS cross_label_numeric_collisions,
  (SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM m GROUP BY source_key, frame_number HAVING count(*) > 1)) AS repeated_source_frames,
  (SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM m GROUP BY event_id % 997 HAVING count(*) > 1)) AS duplicate_content_rows FROM m"""),
    "fingerprint": with_(S, "SELECT regime, sha256(string_agg(b || ':' || d, chr(10) ORDER BY b)) AS sha256 FROM (SELECT regime, substr(sample_id, 1, 3) AS b, sha256(string_agg(x, chr(10) ORDER BY x)) AS d FROM (SELECT regime, sample_id, sample_id || '|' || source_key || '|' || role AS x FROM al) GROUP BY ALL) GROUP BY regime"),
    "first_per_label": with_(M, "SELECT label, arg_min(relative_path, sample_id) AS relative_path, min(sample_id) AS sample_id FROM m GROUP BY label"),
    "split_o": with_(S, f"SELECT {ROLE} FROM so"),
    "split_s": with_(S, f"SELECT {ROLE} FROM ss"),
    "split_t": with_(S, f"SELECT {ROLE} FROM st"),
    "split_st": with_(S, f"SELECT {ROLE} FROM sx"),
    "split_summary": with_(S, "SELECT regime, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'validation') AS validation, count(*) FILTER (role = 'test') AS test, count(*) FILTER (role = 'context_unseen_early') AS context_unseen_early, count(*) AS total FROM al GROUP BY regime"),
    "role_label_crosstab": with_(S, "SELECT regime, role, count(*) FILTER (label = 'flip') AS flip, count(*) FILTER (label = 'notflip') AS notflip FROM al GROUP BY ALL"),
    "accounting": with_(f"{S}, {ACC}", "SELECT * FROM ac"),
    "leakage": with_(f"{S}, {LEAK}", "SELECT * FROM lk"),
    "chronology": with_(f"{S}, {CHRON}", "SELECT * FROM ch"),
    "constraints": with_(f"{S}, {ACC}, {LEAK}, {CHRON}, cl AS (SELECT regime, count(*) FILTER (k = 2) AS good FROM (SELECT regime, role, count(DISTINCT label) AS k FROM al WHERE role <> 'context_unseen_early' GROUP BY ALL) GROUP BY regime), ln AS (SELECT count(*) AS n FROM m GROUP BY source_key)", """
  SELECT regime, 'row_accounting' AS rule, missing + unknown + repeated AS violations FROM ac UNION ALL SELECT regime, 'both_classes', 3 - good FROM cl
  UNION ALL SELECT regime, 'test_sources_disjoint', also_in_development FROM lk WHERE regime IN ('S', 'ST') UNION ALL SELECT regime, 'one_role_a_source', sources_with_many_roles FROM lk WHERE regime = 'S'
  UNION ALL SELECT regime, 'fitting_rows', (SELECT count(*) FROM (SELECT source_key FROM al x WHERE x.regime = ch.regime GROUP BY source_key HAVING count(*) FILTER (role IN ('train', 'context_unseen_early')) = 0)) FROM ch
  UNION ALL SELECT regime, 'chronology', violations FROM ch UNION ALL SELECT r, 'minimum_length', (SELECT count(*) FROM ln WHERE n < k) FROM (VALUES ('S', 1), ('T', 3), ('ST', 2), ('progressive', 4)) v(r, k)"""),
    "coverage": with_(PTS, "SELECT regime, coverage_percent, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'validation') AS n_validation, count(*) FILTER (part = 'future') AS n_future, count(DISTINCT source_key) FILTER (part = 'future') AS n_future_sources FROM pts GROUP BY ALL"),
    "progressive_rules": with_(f"""{PTS},
  f AS (SELECT regime, coverage_percent, count(*) FILTER (part = 'train') AS a, count(*) FILTER (part = 'validation') AS b, count(*) FILTER (part = 'future') AS c,
    count(DISTINCT label) FILTER (part = 'train') AS la, count(DISTINCT label) FILTER (part = 'validation') AS lb, count(DISTINCT label) FILTER (part = 'future') AS lc FROM pts GROUP BY ALL),
  tw AS (SELECT regime, coverage_percent, count(*) FILTER (k > 1) AS v FROM (SELECT regime, coverage_percent, sample_id, count(DISTINCT part) AS k FROM pts GROUP BY ALL) GROUP BY ALL),
  so AS (SELECT regime, coverage_percent, count(*) FILTER (regime = 'ST' AND x AND y) AS v FROM (SELECT regime, coverage_percent, source_key, bool_or(part = 'future') AS x, bool_or(part <> 'future') AS y FROM pts GROUP BY ALL) GROUP BY ALL)""", """
  SELECT regime, coverage_percent, 'rows_in_every_part' AS rule, ((a = 0)::INT + (b = 0)::INT + (c = 0)::INT)::BIGINT AS violations FROM f
  UNION ALL SELECT regime, coverage_percent, 'both_classes', ((la <> 2)::INT + (lb <> 2)::INT + (lc <> 2)::INT)::BIGINT FROM f
  UNION ALL SELECT regime, coverage_percent, 'samples_disjoint', v FROM tw UNION ALL SELECT regime, coverage_percent, 'sources_disjoint', v FROM so"""),
    "st_cohort": with_(f"{M},{held('hs', 'src', 'source_key', 0.2)}", "SELECT source_key, label, CASE WHEN source_key IN (SELECT key FROM hs) THEN 'unseen' ELSE 'known' END AS cohort FROM src"),
    "frozen_cohort": with_(f"{S}, bs AS (SELECT source_key, count(*) FILTER (role IN ('train', 'validation')) AS k, count(*) FILTER (role = 'context_unseen_early') AS c, count(*) FILTER (role = 'test') AS t FROM sx GROUP BY source_key)", "SELECT count(*) FILTER (k > 0) AS known_sources, count(*) FILTER (c + t > 0) AS unseen_sources, count(*) FILTER (k > 0 AND c + t > 0) AS in_both, count(*) FILTER (c + t > 0 AND (c = 0 OR t = 0)) AS incomplete_unseen, sum(c)::BIGINT AS n_context, sum(t)::BIGINT AS n_late, (SELECT count(DISTINCT source_key) FROM m WHERE source_key NOT IN (SELECT source_key FROM sx)) AS missing_sources FROM bs"),
    "future_enrich": with_(FU, "SELECT regime, coverage_percent, sample_id, prob_flip, prediction, correct, horizon_position, round(frame_position_percent, 6) AS frame_position_percent FROM pf"),
    "horizon": with_(f"{FU}, hz AS (SELECT regime, coverage_percent, (horizon_position - 1) // 3 AS k, count(*) AS n_frames, count(DISTINCT source_key) AS n_sources, count(*) FILTER (label = 'flip') AS n_flip, count(*) FILTER (label = 'notflip') AS n_notflip, count(DISTINCT source_key) FILTER (label = 'flip') AS flip_sources, count(DISTINCT source_key) FILTER (label = 'notflip') AS notflip_sources, {CELLS} FROM pf GROUP BY ALL), hr AS (SELECT *, n_flip >= 20 AND n_notflip >= 20 AND flip_sources >= 8 AND notflip_sources >= 8 AS reportable FROM hz)",
        f"SELECT regime, coverage_percent, k * 3 + 1 AS start_horizon, k * 3 + 3 AS end_horizon, n_frames, n_sources, n_flip, n_notflip, flip_sources, notflip_sources, reportable, CASE WHEN reportable THEN round({MACRO}, 6) END AS macro_f1, CASE WHEN reportable THEN round({RECALL}, 6) END AS flip_recall, CASE WHEN reportable THEN fn::DOUBLE END AS false_negatives, CASE WHEN reportable THEN fp::DOUBLE END AS false_positives FROM hr"),
    "matched_suffix": with_(MS, "SELECT * FROM ms"),
    "coverage_delta": with_(MS, "SELECT regime, arg_min(matched_macro_f1, coverage_percent) AS first_macro_f1, arg_max(matched_macro_f1, coverage_percent) AS last_macro_f1, round(arg_max(matched_macro_f1, coverage_percent) - arg_min(matched_macro_f1, coverage_percent), 6) AS delta, coalesce(bool_and(step > 0), false) AS rises FROM (SELECT *, matched_macro_f1 - lag(matched_macro_f1) OVER (PARTITION BY regime ORDER BY coverage_percent) AS step FROM ms) GROUP BY regime"),
    "score": with_(f"{M}, {predicted('pm', 'm')}", "SELECT sample_id, target, prob_flip, prediction, correct FROM pm"),
    "confidence": with_(f"{M}, {predicted('pm', 'm')}", f"SELECT sample_id, round({CONF}, 6) AS confidence, round(abs(prob_flip - 0.5), 6) AS distance FROM pm"),
    "confusion": with_(T, "SELECT * FROM cf"),
    "metrics": with_(T, f"SELECT regime, tn + fp + fn + tp AS n_images, round({div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round(coalesce(({div('tp', 'tp + fn')} + {div('tn', 'tn + fp')}) / 2, {div('tp', 'tp + fn')}, {div('tn', 'tn + fp')}), 6) AS balanced_accuracy, round({MACRO}, 6) AS macro_f1, round({PRECISION}, 6) AS flip_precision, round({RECALL}, 6) AS flip_recall, tn, fp, fn, tp FROM cf"),
    "metrics_ext": with_(T, f"SELECT regime, round({zero(div('tn', 'tn + fn'))}, 6) AS notflip_precision, round({zero(div('tn', 'tn + fp'))}, 6) AS notflip_recall, round({F1N}, 6) AS notflip_f1, round({F1P}, 6) AS flip_f1, round(({F1P} * (tp + fn) + {F1N} * (tn + fp)) / (tp + fn + tn + fp), 6) AS weighted_f1, round({zero(div('tp * tn - fp * fn', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))'))}, 6) AS mcc FROM cf"),
    "roc_auc": with_(f"{T}, {SCORE_TIES}", "SELECT regime, round(sum(fp * (ctp - tp / 2.0::DOUBLE)) / nullif(max(pos) * max(neg), 0), 6) AS roc_auc_flip FROM cu GROUP BY regime"),
    "avg_precision": with_(f"{T}, {SCORE_TIES}", "SELECT regime, round(CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(tp / pos::DOUBLE * (ctp / (ctp + cfp)::DOUBLE)) END, 6) AS pr_auc_flip FROM cu GROUP BY regime"),
    "missed_rate": with_(T, f"SELECT regime, tp + fn AS positives, fn AS missed, round({div('fn', 'tp + fn')}, 6) AS missed_rate FROM cf"),
    "errorbars": with_(f"{T},{boot('pt', 5000)}", "SELECT list_position(['O', 'S', 'T', 'ST'], regime)::INT AS position, regime, point_macro_f1, round(greatest(point_macro_f1 - ci_lower, 0), 6) AS below, round(greatest(ci_upper - point_macro_f1, 0), 6) AS above FROM po JOIN iv USING (regime)"),
    "errors": with_(f"{T}, er AS (SELECT regime, count(*) AS n, count(*) FILTER ({WRONG}) AS e, count(*) FILTER ({WRONG} AND {CONF} >= 0.9) AS h, {CELLS} FROM pt GROUP BY regime)", f"SELECT regime, e AS n_errors, round({div('e', 'n')}, 6) AS error_rate, fp, fn, h AS high_confidence_errors, round({zero(div('h', 'e'))}, 6) AS high_confidence_error_share FROM er"),
    "errors_ext": with_(f"{T}, ee AS (SELECT *, {CONF} AS c FROM pt WHERE {WRONG})", "SELECT regime, CASE WHEN count(*) FILTER (target = 1) >= count(*) FILTER (target = 0) THEN 'false_negative' ELSE 'false_positive' END AS dominant_error_type, round(avg(c), 6) AS mean_error_confidence, round(quantile_cont(c, 0.5), 6) AS median_error_confidence, round(1 - avg(c), 6) AS mean_error_true_class_probability FROM ee GROUP BY regime"),
    "cases4": with_(f"{T}, {pick(FOUR)}, pk AS ({' UNION ALL '.join(f'SELECT * FROM r{i}' for i in range(4))})", "SELECT regime, role, sample_id, relative_path, target, prob_flip, prediction, sample_id IS NOT NULL AS found FROM (SELECT DISTINCT regime FROM pt) CROSS JOIN (VALUES " + ", ".join(f"('{r}')" for r, _, _ in FOUR) + ") v(role) LEFT JOIN pk USING (regime, role)"),
    "cases21": with_(f"{T}, {pick(MANY)}, pk AS ({' UNION ALL '.join(f'SELECT * FROM r{i}' for i in range(6))})", "SELECT regime, role AS selection_role, sample_id, relative_path, target, prob_flip, prediction AS predicted FROM pk"),
    "bootstrap": with_(f"{T},{boot('pt', 5000)}", "SELECT regime, n_sources, point_macro_f1, n_resamples, bootstrap_mean, bootstrap_std, ci_lower, ci_upper, ci_width FROM po JOIN iv USING (regime)"),
    "paired_join": with_(f"{PAIR}, j AS (SELECT a.sample_id AS x, b.sample_id AS y FROM pa a FULL JOIN (SELECT * FROM pb WHERE frame_number % 7 > 0) b USING (sample_id))", "SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS paired, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b, 0::BIGINT AS repeated FROM j"),
    "paired_bootstrap": with_(f"""{PAIR}, jn AS (SELECT a.source_key, a.target, a.prediction AS pa, b.prediction AS pb FROM pa a JOIN pb b USING (sample_id)),
  pn AS (SELECT *, row_number() OVER (ORDER BY source_key) - 1 AS idx, count(*) OVER () AS k FROM (SELECT source_key, {_paired('jn', 'a')}, {_paired('jn', 'b')} FROM jn GROUP BY source_key)),
  dr AS (SELECT rep, {number("'42'", 'rep', 'slot')} % k AS idx FROM (SELECT k, rep, unnest(range(1, k + 1)) AS slot FROM (SELECT DISTINCT k, unnest(range(1, 5001)) AS rep FROM pn))),
  sm AS (SELECT rep, {', '.join(f'sum({p}{s}) AS {p}{s}' for s in 'ab' for p in ('tn', 'fp', 'fn', 'tp'))} FROM dr JOIN pn USING (idx) GROUP BY rep),
  tt AS (SELECT {', '.join(f'sum({p}{s}) AS {p}{s}' for s in 'ab' for p in ('tn', 'fp', 'fn', 'tp'))} FROM pn),
  dl AS (SELECT {_macro('b')} - {_macro('a')} AS s FROM sm)""", f"SELECT (SELECT round({_macro('b')} - {_macro('a')}, 6) FROM tt) AS point_delta, count(*) AS n_resamples, round(quantile_cont(s, 0.025), 6) AS ci_lower, round(quantile_cont(s, 0.975), 6) AS ci_upper FROM dl"),
    "frame_bootstrap": with_(f"""{T}, ct AS (SELECT regime, count(*) AS k, {CELLS} FROM pt GROUP BY regime),
  dr AS (SELECT regime, rep, {number("'42'", 'rep', 'slot')} % k AS idx, tn, fp, fn FROM (SELECT *, unnest(range(1, k + 1)) AS slot FROM (SELECT *, unnest(range(1, 5001)) AS rep FROM ct))),
  sm AS (SELECT regime, rep, count(*) FILTER (idx < tn) AS tn, count(*) FILTER (idx >= tn AND idx < tn + fp) AS fp, count(*) FILTER (idx >= tn + fp AND idx < tn + fp + fn) AS fn, count(*) FILTER (idx >= tn + fp + fn) AS tp FROM dr GROUP BY ALL),
  sc AS (SELECT regime, {MACRO} AS s FROM sm),
  po AS (SELECT regime, round({MACRO}, 6) AS point_macro_f1 FROM ct)""", "SELECT regime, point_macro_f1, count(*) AS n_resamples, round(avg(s), 6) AS bootstrap_mean, round(stddev_samp(s), 6) AS bootstrap_std, round(quantile_cont(s, 0.025), 6) AS ci_lower, round(quantile_cont(s, 0.975), 6) AS ci_upper, round(quantile_cont(s, 0.975) - quantile_cont(s, 0.025), 6) AS ci_width FROM sc JOIN po USING (regime) GROUP BY regime, point_macro_f1"),
    "epoch_log": with_(BATCHES, "SELECT run, epoch, round(avg(loss), 9) AS train_loss, count(*) AS batches FROM ba GROUP BY ALL"),
    "best_epoch": with_(SCORES, "SELECT run, max(f1) AS best_f1, arg_max(epoch, (f1, -epoch)) AS best_epoch FROM es GROUP BY run"),
    "early_stop": with_(f"""{SCORES}, im AS (SELECT *, f1 > coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM es),
  la AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last FROM im),
  sp AS (SELECT run, min(epoch) FILTER (epoch - last >= 5) AS stop FROM la GROUP BY run)""", "SELECT run, max(epoch) AS last_epoch, max(last) AS best_epoch, max(f1) AS best_f1, bool_or(stop IS NOT NULL) AS stopped_early FROM la JOIN sp USING (run) WHERE epoch <= coalesce(stop, 30) GROUP BY run"),
    "best_stage": with_(SCORES, "SELECT run, arg_max(stage, (f1, -o)) AS selected_stage, max(f1) AS f1 FROM (SELECT run, CASE WHEN epoch <= 5 THEN 'head' WHEN epoch <= 20 THEN 'full' ELSE 'continued' END AS stage, CASE WHEN epoch <= 5 THEN 1 WHEN epoch <= 20 THEN 2 ELSE 3 END AS o, max(f1) AS f1 FROM es GROUP BY ALL) GROUP BY run"),
    "best_trial": with_(TRIALS, "SELECT sweep, arg_max(attempt, (f1, -attempt)) AS attempt, max(f1) AS f1 FROM tm WHERE status = 'finished' AND f1 IS NOT NULL GROUP BY sweep"),
    "sweep_stop": with_(TRIALS, "SELECT sweep, attempt, status, f1, qualifies FROM tm"),
    "sweep_summary": with_(TRIALS, "SELECT sweep, count(*) AS attempts, count(*) FILTER (status = 'finished') AS finished, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (f1 = 0) AS zero_f1, count(*) FILTER (qualifies) AS qualifying, max(f1) AS best_f1, count(*) FILTER (qualifies) >= 30 AS target_reached FROM tm GROUP BY sweep"),
    "resolve_config": with_(TRIALS, "SELECT sweep, attempt, weight_decay_mode, positive_weight_decay, CASE WHEN weight_decay_mode = 'zero' THEN 0.0::DOUBLE ELSE positive_weight_decay END AS weight_decay FROM tr"),
    "bce": with_(f"{M}, {predicted('pm', 'm')}, lg AS (SELECT sample_id, target, (prob_flip - 0.5) * 20 AS x FROM pm)", "SELECT sample_id, round(1 / (1 + exp(-x)), 9) AS prob, round(greatest(x, 0) - x * target + ln(1 + exp(-abs(x))), 9) AS loss FROM lg"),
    "cnn_channels": "SELECT depth, filters, layer, least(filters * (1 << layer), 256)::INT AS channels FROM (SELECT depth, filters, unnest(range(0, depth))::INT AS layer FROM (SELECT unnest(range(1, 8))::INT AS depth), (SELECT unnest([8, 16, 33, 64]) AS filters))",
    "activation_stats": """WITH a AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS a FROM embeddings),
  c AS (SELECT vec_id, unnest(range(0, len(a))) AS i, unnest(list_transform(a, lambda v: (v - list_min(a)) / (list_max(a) - list_min(a) + 1e-8))) AS v FROM a)
  SELECT vec_id, round(avg(v), 6) AS mean_normalized_activation, round(avg((v >= 0.5)::INT), 6) AS fraction_ge_50, round(avg((v >= 0.75)::INT), 6) AS fraction_ge_75, round(avg((v >= 0.9)::INT), 6) AS fraction_ge_90,
  round(sum(i % 8 * v) / nullif(sum(v), 0) / 7, 6) AS center_x, round(sum(i // 8 * v) / nullif(sum(v), 0) / (count(*) / 8.0 - 1), 6) AS center_y, max(v) <= 0 AS degenerate FROM c GROUP BY vec_id""",
    "archive_read": "SELECT * FROM (VALUES (0, 'O', 'near, ceiling', 0.994969::DOUBLE), (1, 'S', 'lower \"than\"', 0.958387), (2, 'T', 'a > b', 0.90914), (3, 'ST', NULL, NULL)) v(\"index\", regime, finding, point)",
    "md_table": "SELECT * FROM (VALUES ('1', 'T', '579', '2291', '0.739814'), ('2', 'T', '1208', '1510', '0.707684'), ('3', 'ST', '460', '467', '66.2')) v(run, regime, n_train, n_future, macro_f1)",
    "drift": "SELECT * FROM (VALUES (2, 'n_future', 1510::DOUBLE, 1511::DOUBLE), (3, 'macro_f1', 66.2, 66.3)) v(run, \"column\", reported, measured)",
    "round_trip": with_(M, "SELECT way, label, count(*) AS n FROM m, (VALUES ('csv'), ('cells'), ('table'), ('document')) v(way) GROUP BY way, label"),
    "report_rules": "SELECT * FROM (VALUES ('eight_runs', 0::BIGINT), ('run_order', 0), ('coverage_cycle', 0), ('future_sources', 0), ('accounting', 1), ('shares', 0), ('address', 0), ('address_in_evidence', 1)) v(rule, violations)",
    "class_activation": """WITH c AS (SELECT vec_id, k, list_transform(embedding[16 * k + 1 : 16 * k + 16], lambda v: v::DOUBLE) AS a, list_avg(list_transform(embedding[16 * ((k + 1) % 4) + 1 : 16 * ((k + 1) % 4) + 16], lambda v: v::DOUBLE)) AS w FROM embeddings, (SELECT unnest(range(0, 4)) AS k)),
  s AS (SELECT vec_id, i, greatest(sum(w * a[i]), 0) AS v FROM (SELECT *, unnest(range(1, 17)) AS i FROM c) GROUP BY vec_id, i),
  h AS (SELECT vec_id, i, (v - min(v) OVER o) / (max(v) OVER o - min(v) OVER o + 1e-8) AS v FROM s WINDOW o AS (PARTITION BY vec_id))
  SELECT vec_id, round(sum(v), 6) AS total, round(max(v) FILTER (i = 1), 6) AS first, round(max(v) FILTER (i = 16), 6) AS last FROM h GROUP BY vec_id""",
    "run_numbers": with_(PTS, "SELECT regime, coverage_percent, row_number() OVER (ORDER BY CASE WHEN regime = 'T' THEN 1 ELSE 2 END, coverage_percent) AS run_number FROM (SELECT DISTINCT regime, coverage_percent FROM pts)"),
    "global_epoch": with_(SCORES, "SELECT run, CASE WHEN epoch <= 5 THEN 'head' ELSE 'full' END AS stage, CASE WHEN epoch <= 5 THEN epoch ELSE epoch - 5 END AS epoch, epoch AS global_epoch FROM es"),
    "prefixed_metrics": with_(f"{S}, te AS (SELECT * FROM al WHERE role IN ('validation', 'test')), {predicted('pt', 'te')}, cf AS (SELECT regime, role, {CELLS} FROM pt GROUP BY ALL), ml AS (SELECT regime, role, round({MACRO}, 6) AS f, round({div('tp + tn', 'tp + tn + fp + fn')}, 6) AS a FROM cf)", "SELECT regime, max(f) FILTER (role = 'validation') AS val_macro_f1, max(a) FILTER (role = 'validation') AS val_accuracy, max(f) FILTER (role = 'test') AS test_macro_f1, max(a) FILTER (role = 'test') AS test_accuracy FROM ml GROUP BY regime"),
}
ORACLE["audit_rows"] = f"SELECT name, value::VARCHAR AS value FROM (UNPIVOT ({ORACLE['audit']}) ON COLUMNS(*) INTO NAME name VALUE value)"
ORACLE["case_preview"] = f"SELECT * FROM ({ORACLE['cases21']}) ORDER BY list_position(['O', 'S', 'T', 'ST'], regime), selection_role, sample_id LIMIT 4"
