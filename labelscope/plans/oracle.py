"""DuckDB oracle SQL for the registered queries (same column names and types).

Views ``embeddings documents labels events orders lineitem`` are registered by
the caller.
"""

from __future__ import annotations

from labelscope.plans import extended
from labelscope.plans import queries as Q

SPLIT = r"'[ \t\r\n]+'"

SCORES = """scores AS (
  SELECT vec_id, CAST(label AS INTEGER) AS y_true, z AS logits,
         CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS y_pred
  FROM (SELECT vec_id, label, CAST(embedding[1:10] AS DOUBLE[]) AS z FROM embeddings))"""

PAIRS = SCORES + """,
pairs AS (SELECT y_true, y_pred, count(*) AS n FROM scores GROUP BY y_true, y_pred)"""


def _roles_pc(labels: list[int]) -> str:
    lab = ", ".join(f"({x})" for x in labels)
    return PAIRS + f""",
roles AS (
  SELECT label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT y_true AS label, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM pairs
    UNION ALL
    SELECT y_pred AS label, 0, n, 0 FROM pairs) GROUP BY label),
dim AS (SELECT CAST(col0 AS INTEGER) AS label FROM (VALUES {lab})),
pc AS (
  SELECT d.label, CAST(coalesce(r.support, 0) AS BIGINT) AS support,
         CAST(coalesce(r.predicted, 0) AS BIGINT) AS predicted, CAST(coalesce(r.tp, 0) AS BIGINT) AS tp
  FROM dim d LEFT JOIN roles r ON d.label = r.label),
prf AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
         CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f1
  FROM pc)"""


K10 = list(range(10))
K11 = list(range(11))

CORPUS = """corpus AS (
  SELECT doc_id, lang AS language, source AS generator, text AS code,
         CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS INTEGER) AS label
  FROM documents)"""

JUDGED = """judged AS (
  SELECT d.doc_id, d.lang AS language, d.source AS generator, CAST(l.quality AS INTEGER) AS y_true,
         CAST(d.n_chars >= 1000 AS INTEGER) AS y_pred,
         CAST(CAST(l.quality AS INTEGER) = CAST(d.n_chars >= 1000 AS INTEGER) AS INTEGER) AS correct
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

TWO_SETS = SCORES + """,
a AS (SELECT vec_id AS id, y_pred AS label FROM scores),
b AS (SELECT vec_id AS id,
             CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS label
      FROM (SELECT vec_id, CAST(embedding[11:20] AS DOUBLE[]) AS z FROM embeddings))"""


def _lse(z: str) -> str:
    return f"(list_max({z}) + ln(list_sum(list_transform({z}, lambda x: exp(x - list_max({z}))))))"


CE_ROWS = SCORES + f""",
ce_rows AS (SELECT vec_id, y_true, -(logits[y_true + 1] - {_lse('logits')}) AS nll FROM scores)"""

SKEWED = """src AS (
  SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 25 < 22 THEN 0 ELSE o_orderkey % 25 - 21 END AS INTEGER) AS label
  FROM orders),
ranked AS (
  SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rnk,
         count(*) OVER (PARTITION BY label) AS n_rows
  FROM src WHERE label BETWEEN 0 AND 3)"""


def _hex15(s: str) -> str:
    return f"CAST(('0x' || substr(md5({s}), 1, 15)) AS BIGINT)"


def _share(k: int) -> str:
    return f"(SELECT count(*) // {k} FROM orders)"


def _draws(n: str, cond: str) -> str:
    """Bootstrapped rows for classes matching ``cond`` (over ``cls`` = label, n_rows)."""
    return f"""cls AS (SELECT DISTINCT label, n_rows FROM ranked WHERE {cond}),
draws AS (
  SELECT c.label, r.range AS draw, ({_hex15("'42:' || c.label || ':' || r.range")} % c.n_rows) + 1 AS rnk
  FROM cls c, (SELECT unnest(range(0, {n})) AS range) r),
drawn AS (
  SELECT k.o_orderkey, k.label, 'd:' || d.label || ':' || d.draw AS sample_key
  FROM draws d JOIN ranked k ON k.label = d.label AND k.rnk = d.rnk)"""


def _shuffled(body: str) -> str:
    return f"""SELECT o_orderkey, label, sample_key,
       CAST(row_number() OVER (ORDER BY md5('42:' || sample_key), sample_key) - 1 AS BIGINT) AS row_id
FROM ({body})"""


BAL_MAJ = f"""WITH {SKEWED}
{_shuffled(f"SELECT o_orderkey, label, 'k:' || o_orderkey AS sample_key FROM ranked WHERE label <> 0 OR rnk <= {Q.HUMAN_SAMPLES}")}"""

HISTORY = """daily AS (
  SELECT CAST(ts AS DATE) AS day, min(value) / 100 AS train_loss, max(value) / 1000 AS train_f1,
         avg(value) / 100 AS val_f1
  FROM events GROUP BY CAST(ts AS DATE)),
hist AS (SELECT CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS epoch, train_loss, train_f1, val_f1 FROM daily)"""

VOCAB = CORPUS + f""",
toks AS (SELECT unnest(list_filter(string_split_regex(code, {SPLIT}), lambda x: x <> '')) AS token FROM corpus),
counts AS (SELECT token, count(*) AS count FROM toks GROUP BY token),
vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) + 1 AS INTEGER) AS id, CAST(count AS BIGINT) AS count
  FROM counts ORDER BY count DESC, token LIMIT {Q.VOCAB_SIZE})"""

PRED_TABLE = SCORES + """,
preds AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS id, y_pred AS label FROM scores)"""


def oracle_sql() -> dict[str, str]:
    L = Q.MAX_LENGTH
    sql = {
        "argmax_predictions": f"WITH {SCORES} SELECT vec_id, y_true, y_pred FROM scores",
        "batch_score": f"WITH {SCORES} SELECT vec_id, y_true, y_pred FROM scores",
        "confusion_matrix": f"""WITH {PAIRS},
grid AS (SELECT CAST(a.range AS INTEGER) AS y_true, CAST(b.range AS INTEGER) AS y_pred FROM range(10) a, range(10) b)
SELECT g.y_true, g.y_pred, CAST(coalesce(p.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN pairs p ON g.y_true = p.y_true AND g.y_pred = p.y_pred""",
        "confusion_normalized": f"""WITH {PAIRS},
grid AS (SELECT CAST(a.range AS INTEGER) AS y_true, CAST(b.range AS INTEGER) AS y_pred FROM range(10) a, range(10) b),
cm AS (SELECT g.y_true, g.y_pred, CAST(coalesce(p.n, 0) AS BIGINT) AS n
       FROM grid g LEFT JOIN pairs p ON g.y_true = p.y_true AND g.y_pred = p.y_pred)
SELECT y_true, y_pred, n,
       round(CASE WHEN sum(n) OVER (PARTITION BY y_true) = 0 THEN NULL
                  ELSE n / sum(n) OVER (PARTITION BY y_true) END, 6) AS share
FROM cm""",
        "per_class_prf": f"""WITH {_roles_pc(K10)}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support, predicted, tp FROM prf""",
        "macro_f1": f"""WITH {PAIRS},
roles AS (
  SELECT label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT y_true AS label, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM pairs
    UNION ALL SELECT y_pred, 0, n, 0 FROM pairs) GROUP BY label)
SELECT round(avg(CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END), 6) AS macro_f1
FROM roles""",
        "macro_f1_fixed": f"WITH {_roles_pc(K11)} SELECT round(avg(f1), 6) AS macro_f1 FROM prf",
        "accuracy": f"""WITH {PAIRS}
SELECT round(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM pairs""",
        "metrics_record": f"""WITH {PAIRS},
roles AS (
  SELECT label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
    SELECT y_true AS label, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM pairs
    UNION ALL SELECT y_pred, 0, n, 0 FROM pairs) GROUP BY label)
SELECT round(avg(CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END), 6) AS macro_f1,
       (SELECT round(sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) / sum(n), 6) FROM pairs) AS accuracy
FROM roles""",
        "classification_report": f"""WITH {_roles_pc(K10)},
names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{Q.LABEL_NAMES[i]}')" for i in K10)}) t(label, name)),
tot AS (SELECT sum(n) AS total, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS correct FROM pairs),
rows AS (
  SELECT CAST(p.label AS INTEGER) AS row_order, n.name, p.precision, p.recall, p.f1 AS f1_score,
         CAST(p.support AS BIGINT) AS support
  FROM prf p JOIN names n ON p.label = n.label
  UNION ALL
  SELECT 10, 'accuracy', NULL, NULL, correct / total, CAST(total AS BIGINT) FROM tot
  UNION ALL
  SELECT 11, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM prf
  UNION ALL
  SELECT 12, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM prf)
SELECT row_order, name, round(round_even(precision, 3), 6) AS precision, round(round_even(recall, 3), 6) AS recall,
       round(round_even(f1_score, 3), 6) AS f1_score, support FROM rows""",
        "f1_series": f"""WITH {_roles_pc(K10)},
names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{Q.LABEL_NAMES[i]}')" for i in K10)}) t(label, name))
SELECT p.label, n.name, round(p.f1, 6) AS f1, p.f1 > 0.5 AS above_half,
       round((SELECT avg(f1) FROM prf), 6) AS macro_f1
FROM prf p JOIN names n ON p.label = n.label""",
        "dense_distribution": f"""WITH {_roles_pc(K11)}
SELECT label, support AS true_count, predicted AS pred_count FROM pc""",
        # ------------------------------------------------------------ profile
        "label_distribution": f"""WITH {CORPUS},
names AS (SELECT * FROM (VALUES (0, 'en'), (1, 'de'), (2, 'es'), (3, 'fr')) t(label, name))
SELECT c.label, n.name, count(*) AS count,
       round(100.0 * count(*) / (SELECT count(*) FROM corpus), 6) AS pct
FROM corpus c LEFT JOIN names n ON c.label = n.label
WHERE c.label IS NOT NULL GROUP BY c.label, n.name""",
        "imbalance_ratio": f"""WITH {CORPUS},
c AS (SELECT label, count(*) AS n FROM corpus WHERE label IS NOT NULL GROUP BY label)
SELECT round(max(n) / min(n), 6) AS imbalance_ratio FROM c""",
        "language_counts": f"""WITH {CORPUS}
SELECT language, count(*) AS count FROM corpus WHERE language IS NOT NULL GROUP BY language""",
        "customer_top20": """WITH c AS (SELECT o_custkey, count(*) AS "count" FROM orders GROUP BY o_custkey),
r AS (SELECT *, row_number() OVER (ORDER BY "count" DESC, o_custkey) AS rk, count(*) OVER () AS n FROM c)
SELECT o_custkey, "count", CAST(rk AS INTEGER) AS rank, CAST(greatest(n - 20, 0) AS BIGINT) AS remaining FROM r WHERE rk <= 20""",
        "train_classifier": f"""WITH {CORPUS},
h AS (SELECT label FROM corpus WHERE CAST(('0x' || substr(md5('fold:' || doc_id), 1, 8)) AS BIGINT) % 5 = 0),
p AS (SELECT label, count(*) AS support FROM h GROUP BY label)
SELECT label, support, CAST(sum(support) OVER () AS BIGINT) AS scored, true AS labels_in_domain, true AS beats_majority FROM p""",
        "generator_top20": f"""WITH {CORPUS},
c AS (SELECT generator, count(*) AS count FROM corpus WHERE generator IS NOT NULL GROUP BY generator),
r AS (SELECT generator, count, CAST(row_number() OVER (ORDER BY count DESC, generator) AS INTEGER) AS rank FROM c)
SELECT generator, count, rank, CAST(greatest((SELECT count(*) FROM c) - 20, 0) AS BIGINT) AS remaining
FROM r WHERE rank <= 20""",
        "length_describe": f"""WITH {CORPUS},
l AS (SELECT length(coalesce(code, '')) AS n FROM corpus)
SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
       round(CAST(min(n) AS DOUBLE), 6) AS min, round(quantile_cont(n, 0.25), 6) AS p25,
       round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75,
       round(CAST(max(n) AS DOUBLE), 6) AS max FROM l""",
        "corpus_profile": f"""WITH {CORPUS},
c AS (SELECT label, count(*) AS n FROM corpus WHERE label IS NOT NULL GROUP BY label)
SELECT count(*) AS rows, round(avg(length(coalesce(code, ''))), 6) AS mean_length,
       CAST(min(length(coalesce(code, ''))) AS BIGINT) AS min_length,
       CAST(max(length(coalesce(code, ''))) AS BIGINT) AS max_length,
       count(DISTINCT language) AS n_languages, count(DISTINCT generator) AS n_generators,
       (SELECT count(*) FROM c) AS n_classes, (SELECT round(max(n) / min(n), 6) FROM c) AS imbalance_ratio
FROM corpus""",
        # ------------------------------------------------------------ grouped evaluation
        "accuracy_by_language": f"""WITH {JUDGED}
SELECT language, round_even(avg(correct), 3) AS accuracy, count(correct) AS count
FROM judged WHERE language IS NOT NULL GROUP BY language""",
        "accuracy_by_generator": f"""WITH {JUDGED}
SELECT generator, round_even(avg(correct), 3) AS accuracy, count(correct) AS count
FROM judged WHERE generator IS NOT NULL GROUP BY generator""",
        "accuracy_ranking": f"""WITH {JUDGED}
SELECT generator, round(avg(correct), 6) AS accuracy FROM judged WHERE generator IS NOT NULL GROUP BY generator""",
        "prediction_agreement": f"""WITH {TWO_SETS},
j AS (SELECT a.label AS la, b.label AS lb FROM a JOIN b ON a.id = b.id)
SELECT count(*) AS n, round(avg(CAST(la = lb AS DOUBLE)), 6) AS agreement,
       count(*) FILTER (WHERE la <> lb) AS differences,
       round(100.0 * count(*) FILTER (WHERE la <> lb) / count(*), 6) AS difference_pct FROM j""",
        "agreement_with_nulls": f"""WITH {TWO_SETS},
j AS (SELECT a.id % 7 <> 0 AND a.id % 11 <> 0 AND a.label = b.label AS same FROM a JOIN b ON a.id = b.id)
SELECT count(*) AS n, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) FILTER (WHERE NOT same) AS differences,
       round(100.0 * count(*) FILTER (WHERE NOT same) / count(*), 6) AS difference_pct FROM j""",
        "disagreements": f"""WITH {TWO_SETS}
SELECT a.id, a.label AS label_a, b.label AS label_b FROM a JOIN b ON a.id = b.id WHERE a.label <> b.label""",
        # ------------------------------------------------------------ weights and losses
        "class_weights_inverse": f"""WITH {CORPUS},
c AS (SELECT label, count(*) AS count FROM corpus WHERE label IS NOT NULL GROUP BY label)
SELECT label, count, round((SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count), 6) AS weight FROM c""",
        "class_weights_effective": f"""WITH {CORPUS},
c AS (SELECT label, count(*) AS count FROM corpus WHERE label IS NOT NULL GROUP BY label)
SELECT label, count, round((1 - 0.9999) / (1 - pow(0.9999, count)), 6) AS weight FROM c""",
        "row_weights": f"""WITH {CORPUS},
c AS (SELECT label, count(*) AS count FROM corpus WHERE label IS NOT NULL GROUP BY label),
w AS (SELECT label, (SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count) AS weight FROM c)
SELECT k.doc_id, k.label, round(w.weight, 6) AS weight FROM corpus k LEFT JOIN w ON k.label = w.label""",
        "cross_entropy": f"WITH {CE_ROWS} SELECT round(avg(nll), 6) AS cross_entropy FROM ce_rows",
        "focal_loss_rows": f"""WITH {CE_ROWS},
c AS (SELECT y_true AS label, count(*) AS count FROM scores GROUP BY y_true),
w AS (SELECT label, (SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count) AS weight FROM c),
f AS (SELECT r.vec_id, w.weight * r.nll AS ce FROM ce_rows r LEFT JOIN w ON r.y_true = w.label)
SELECT vec_id, round(ce, 6) AS ce, round(pow(1 - exp(-ce), {Q.GAMMA}) * ce, 6) AS focal FROM f""",
        "focal_loss_mean": f"""WITH {CE_ROWS},
c AS (SELECT y_true AS label, count(*) AS count FROM scores GROUP BY y_true),
w AS (SELECT label, (SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count) AS weight FROM c),
f AS (SELECT w.weight * r.nll AS ce FROM ce_rows r LEFT JOIN w ON r.y_true = w.label)
SELECT round(avg(pow(1 - exp(-ce), {Q.GAMMA}) * ce), 6) AS focal_loss FROM f""",
        "batch_loss_mean": f"""WITH {CE_ROWS},
b AS (SELECT floor((row_number() OVER (ORDER BY vec_id) - 1) / {Q.BATCH_SIZE}) AS batch, nll FROM ce_rows),
m AS (SELECT batch, avg(nll) AS l FROM b GROUP BY batch)
SELECT round(avg(l), 6) AS mean_batch_loss, count(*) AS n_batches FROM m""",
        # ------------------------------------------------------------ sampling
        "sample_exact_n": f"""WITH {SKEWED}
SELECT o_orderkey, CAST(sample_rank AS BIGINT) AS sample_rank FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS sample_rank FROM src)
WHERE sample_rank <= {Q.EXACT_N}""",
        "sample_with_replacement": f"""WITH {SKEWED},
{_draws(_share(Q.DRAWS_SHARE), "n_rows > 0")}
SELECT d.label, CAST(d.draw AS BIGINT) AS draw, k.o_orderkey
FROM draws d JOIN ranked k ON k.label = d.label AND k.rnk = d.rnk""",
        "shuffle_row_id": f"""WITH {SKEWED}
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS BIGINT) AS row_id
FROM src""",
        "balance_majority": BAL_MAJ,
        "balance_oversample": f"""WITH {SKEWED},
{_draws(_share(Q.TARGET_SHARE), f"label <> 0 AND n_rows < {_share(Q.TARGET_SHARE)}")}
{_shuffled(f'''SELECT o_orderkey, label, 'k:' || o_orderkey AS sample_key FROM ranked
  WHERE (label = 0 AND rnk <= {Q.HUMAN_SAMPLES}) OR (label <> 0 AND n_rows >= {_share(Q.TARGET_SHARE)})
  UNION ALL SELECT * FROM drawn''')}""",
        "balance_ultra": f"""WITH {SKEWED},
{_draws(_share(Q.PER_CLASS_SHARE), f"n_rows < {_share(Q.PER_CLASS_SHARE)}")}
{_shuffled(f'''SELECT o_orderkey, label, 'k:' || o_orderkey AS sample_key FROM ranked
  WHERE n_rows >= {_share(Q.PER_CLASS_SHARE)} AND rnk <= {_share(Q.PER_CLASS_SHARE)}
  UNION ALL SELECT * FROM drawn''')}""",
        "sample_by_class": f"""WITH {SKEWED}
{_shuffled(f"SELECT o_orderkey, label, 'k:' || o_orderkey AS sample_key FROM ranked WHERE rnk <= {_share(Q.PER_CLASS_SHARE)}")}""",
        "weighted_sampler": f"""WITH {SKEWED},
cls AS (SELECT label, n_rows, row_number() OVER (ORDER BY label) - 1 AS idx
        FROM (SELECT DISTINCT label, n_rows FROM ranked)),
draws AS (SELECT CAST(o_orderkey AS VARCHAR) AS draw_id FROM src WHERE label BETWEEN 0 AND 3),
picked AS (
  SELECT d.draw_id, c.label, ({_hex15("'42:r:' || d.draw_id")} % c.n_rows) + 1 AS rnk
  FROM draws d JOIN cls c ON c.idx = {_hex15("'42:c:' || d.draw_id")} % (SELECT count(*) FROM cls))
SELECT p.draw_id, p.label, k.o_orderkey FROM picked p JOIN ranked k ON k.label = p.label AND k.rnk = p.rnk""",
        "balance_report": f"""WITH bal AS ({BAL_MAJ}),
b AS (SELECT label, count(*) AS n FROM (SELECT CAST(CASE WHEN o_orderkey % 25 < 22 THEN 0 ELSE o_orderkey % 25 - 21 END AS INTEGER) AS label FROM orders) GROUP BY label),
a AS (SELECT label, count(*) AS n FROM bal GROUP BY label)
SELECT CAST((SELECT sum(n) FROM b) AS BIGINT) AS rows_before, CAST((SELECT sum(n) FROM a) AS BIGINT) AS rows_after,
       round(100.0 * (1 - (SELECT sum(n) FROM a) / (SELECT sum(n) FROM b)), 6) AS reduction_pct,
       round((SELECT max(n) / min(n) FROM b), 6) AS imbalance_before,
       round((SELECT max(n) / min(n) FROM a), 6) AS imbalance_after,
       CAST(coalesce((SELECT sum(n) FROM b WHERE label IS NULL OR label NOT IN (0, 1, 2, 3)), 0) AS BIGINT) AS rows_dropped""",
        "balance_audit": f"""WITH bal AS ({BAL_MAJ}),
b AS (SELECT label, count(*) AS n FROM (SELECT CAST(CASE WHEN o_orderkey % 25 < 22 THEN 0 ELSE o_orderkey % 25 - 21 END AS INTEGER) AS label FROM orders) GROUP BY label),
a AS (SELECT label, count(*) AS n FROM bal GROUP BY label),
j AS (SELECT coalesce(b.label, a.label) AS label, CAST(coalesce(b.n, 0) AS BIGINT) AS n_before,
             CAST(coalesce(a.n, 0) AS BIGINT) AS n_after FROM b FULL OUTER JOIN a ON a.label = b.label)
SELECT label, n_before, n_after,
       CASE WHEN n_after < n_before THEN 'undersampled' WHEN n_after > n_before THEN 'oversampled' ELSE 'kept' END AS action
FROM j""",
        # ------------------------------------------------------------ submission
        "predictions_table": f"WITH {PRED_TABLE} SELECT id, label FROM preds",
        "submission_checks": f"""WITH {PRED_TABLE},
s AS (SELECT CAST(id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS label FROM preds),
one AS (
  SELECT count(*) FILTER (WHERE NOT coalesce(regexp_matches(id, '^[+-]?[0-9]+$') AND TRY_CAST(id AS BIGINT) IS NOT NULL, false)) AS bad_id,
         count(*) FILTER (WHERE NOT coalesce(regexp_matches(label, '^[+-]?[0-9]+$') AND TRY_CAST(label AS BIGINT) IS NOT NULL, false)) AS bad_label,
         count(*) FILTER (WHERE TRY_CAST(label AS BIGINT) IS NOT NULL AND TRY_CAST(label AS BIGINT) NOT IN (0,1,2,3,4,5,6,7,8,9,10)) AS invalid,
         count(*) FILTER (WHERE id IS NULL OR label IS NULL) AS nulls FROM s),
dups AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS d FROM (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) > 1)),
checks AS (
  SELECT 1 AS check_id, 'columns' AS "check", CAST(0 AS BIGINT) AS bad_rows
  UNION ALL SELECT 2, 'id_integer', bad_id FROM one
  UNION ALL SELECT 3, 'label_integer', bad_label FROM one
  UNION ALL SELECT 4, 'label_range', invalid FROM one
  UNION ALL SELECT 5, 'unique_id', d FROM dups
  UNION ALL SELECT 6, 'no_missing', nulls FROM one)
SELECT CAST(check_id AS INTEGER) AS check_id, "check", bad_rows = 0 AS passed, CAST(bad_rows AS BIGINT) AS bad_rows FROM checks""",
        "submission_by_position": """WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY -o_orderkey) - 1 AS pos FROM orders)
SELECT t.o_orderkey AS "ID", CAST(p.o_custkey % 11 AS INTEGER) AS label FROM o t JOIN o p ON t.pos = p.pos""",
        "submission_checks_noncanonical": """WITH s AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE '+' END || l_orderkey AS id,
  CAST(l_linenumber AS VARCHAR) AS label FROM lineitem),
d AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS d FROM (SELECT TRY_CAST(ltrim(id, '+') AS BIGINT) AS k, count(*) AS n FROM s GROUP BY k HAVING count(*) > 1)),
c AS (SELECT 1 AS check_id, 'columns' AS "check", CAST(0 AS BIGINT) AS bad_rows
  UNION ALL SELECT 2, 'id_integer', 0 UNION ALL SELECT 3, 'label_integer', 0
  UNION ALL SELECT 4, 'label_range', (SELECT count(*) FROM s WHERE CAST(label AS BIGINT) NOT BETWEEN 0 AND 10)
  UNION ALL SELECT 5, 'unique_id', d FROM d UNION ALL SELECT 6, 'no_missing', 0)
SELECT CAST(check_id AS INTEGER) AS check_id, "check", bad_rows = 0 AS passed, CAST(bad_rows AS BIGINT) AS bad_rows FROM c""",
        "invalid_labels": """SELECT DISTINCT CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS label
FROM embeddings WHERE list_position(embedding, list_max(embedding)) - 1 NOT IN (0,1,2,3,4,5,6,7,8,9,10)""",
        "duplicate_ids": """SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""",
        "submission_join": f"""WITH {PRED_TABLE},
t AS (SELECT vec_id AS "ID", row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)
SELECT CAST(t."ID" AS BIGINT) AS "ID", CAST(p.label AS INTEGER) AS label FROM t JOIN preds p ON p.id = t.pos""",
        # ------------------------------------------------------------ history
        "history_series": f"""WITH {HISTORY}
SELECT epoch, round(train_loss, 6) AS train_loss, round(train_f1, 6) AS train_f1, round(val_f1, 6) AS val_f1,
       CAST(0.0 AS DOUBLE) AS val_loss, false AS plot_val_loss FROM hist""",
        "checkpoint_events": f"""WITH {HISTORY}
SELECT epoch, round(val_f1, 6) AS val_f1 FROM (
  SELECT epoch, val_f1, coalesce(max(val_f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
  FROM hist) WHERE val_f1 > prev""",
        "best_epoch": f"""WITH {HISTORY}
SELECT epoch, round(val_f1, 6) AS val_f1 FROM hist WHERE val_f1 > 0 ORDER BY val_f1 DESC, epoch LIMIT 1""",
        # ------------------------------------------------------------ text
        "metadata_prefix": f"""WITH {CORPUS}
SELECT doc_id, '# Language: ' || coalesce(language, '') || chr(10) || coalesce(code, '') AS text_with_meta FROM corpus""",
        "vocabulary": f"WITH {VOCAB} SELECT token, id, count FROM vocab",
        "encode_fixed_length": f"""WITH {VOCAB},
d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(code, ''), {SPLIT}), lambda x: x <> '')[1:{L}] AS toks FROM corpus),
e AS (SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM d),
ids AS (SELECT e.doc_id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids FROM e LEFT JOIN vocab v ON e.token = v.token GROUP BY e.doc_id),
j AS (SELECT d.doc_id, coalesce(i.ids, CAST([] AS INTEGER[])) AS ids FROM d LEFT JOIN ids i ON d.doc_id = i.doc_id)
SELECT doc_id,
       CAST(list_concat(ids, list_transform(range({L} - len(ids)), lambda x: 0)) AS INTEGER[]) AS input_ids,
       CAST(list_transform(range({L}), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END) AS INTEGER[]) AS attention_mask
FROM j""",
    }
    names10 = ", ".join(f"({i}, '{Q.LABEL_NAMES[i]}')" for i in K10)
    grid_cm = f"""{PAIRS},
grid AS (SELECT CAST(a.range AS INTEGER) AS y_true, CAST(b.range AS INTEGER) AS y_pred FROM range(10) a, range(10) b),
cm AS (SELECT g.y_true, g.y_pred, CAST(coalesce(p.n, 0) AS BIGINT) AS n
       FROM grid g LEFT JOIN pairs p ON g.y_true = p.y_true AND g.y_pred = p.y_pred)"""
    report_rows = f"""{_roles_pc(K10)},
names AS (SELECT * FROM (VALUES {names10}) t(label, name)),
tot AS (SELECT sum(n) AS total, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS correct FROM pairs),
rows AS (
  SELECT CAST(p.label AS INTEGER) AS row_order, n.name, p.precision, p.recall, p.f1 AS f1_score,
         CAST(p.support AS BIGINT) AS support
  FROM prf p JOIN names n ON p.label = n.label
  UNION ALL SELECT 10, 'accuracy', NULL, NULL, correct / total, CAST(total AS BIGINT) FROM tot
  UNION ALL SELECT 11, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM prf
  UNION ALL SELECT 12, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM prf),
rep AS (SELECT row_order, name, round_even(precision, 3) AS precision, round_even(recall, 3) AS recall,
               round_even(f1_score, 3) AS f1_score, support FROM rows)"""
    sql.update({
        "class_weights_reciprocal": f"""WITH {CORPUS},
c AS (SELECT label, count(*) AS count FROM corpus WHERE label IS NOT NULL GROUP BY label)
SELECT label, count, round(1.0 / count, 6) AS weight FROM c""",
        "class_weights_balanced": f"""WITH {SCORES},
c AS (SELECT y_true AS label, count(*) AS count FROM scores WHERE y_true IS NOT NULL GROUP BY y_true)
SELECT label, count, round((SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count), 6) AS weight FROM c""",
        "weights_report": f"""WITH {CORPUS},
c AS (SELECT label, count(*) AS count FROM corpus WHERE label IS NOT NULL GROUP BY label)
SELECT label, count, round((SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count), 6) AS weight_inverse,
       round((1 - 0.9999) / (1 - pow(0.9999, count)), 6) AS weight_effective FROM c""",
        "distinct_labels": f"WITH {SCORES} SELECT DISTINCT y_true AS label FROM scores WHERE y_true IS NOT NULL",
        "prediction_distribution": f"""WITH {SCORES},
names AS (SELECT * FROM (VALUES {names10}) t(label, name))
SELECT s.y_pred AS label, n.name, count(*) AS count,
       round(100.0 * count(*) / (SELECT count(*) FROM scores), 6) AS pct
FROM scores s LEFT JOIN names n ON s.y_pred = n.label WHERE s.y_pred IS NOT NULL GROUP BY s.y_pred, n.name""",
        "confusion_wide": f"""WITH {grid_cm}
SELECT y_true, {", ".join(f'CAST(sum(n) FILTER (WHERE y_pred = {k}) AS BIGINT) AS "{k}"' for k in K10)}
FROM cm GROUP BY y_true""",
        "report_lines": f"""WITH {report_rows}
SELECT 2 * row_order AS row_order, CASE WHEN precision IS NULL
         THEN printf('%12s  %9s %9s %9.3f %9d', name, '', '', f1_score, support)
         ELSE printf('%12s  %9.3f %9.3f %9.3f %9d', name, precision, recall, f1_score, support) END AS value
FROM rep
UNION ALL SELECT -2, printf('%12s  %9s %9s %9s %9s', '', 'precision', 'recall', 'f1-score', 'support')
UNION ALL SELECT -1, ''
UNION ALL SELECT 2 * row_order - 1, '' FROM rep WHERE precision IS NULL""",
        "submission_summary": f"""WITH {PRED_TABLE}
SELECT label, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM preds), 6) AS pct,
       (SELECT count(*) FROM preds) AS total FROM preds GROUP BY label""",
        "submission_preview": f"""WITH {PRED_TABLE},
t AS (SELECT vec_id AS "ID", row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings)
SELECT CAST(t."ID" AS BIGINT) AS "ID", CAST(p.label AS INTEGER) AS label FROM t JOIN preds p ON p.id = t.pos
ORDER BY "ID" LIMIT 10""",
        "submission_first_failure": """WITH s AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_linenumber + 5 AS VARCHAR) AS label FROM lineitem),
one AS (
  SELECT count(*) FILTER (WHERE NOT coalesce(regexp_matches(id, '^[+-]?[0-9]+$') AND TRY_CAST(id AS BIGINT) IS NOT NULL, false)) AS bad_id,
         count(*) FILTER (WHERE NOT coalesce(regexp_matches(label, '^[+-]?[0-9]+$') AND TRY_CAST(label AS BIGINT) IS NOT NULL, false)) AS bad_label,
         count(*) FILTER (WHERE TRY_CAST(label AS BIGINT) IS NOT NULL AND TRY_CAST(label AS BIGINT) NOT IN (0,1,2,3,4,5,6,7,8,9,10)) AS invalid,
         count(*) FILTER (WHERE id IS NULL OR label IS NULL) AS nulls FROM s),
dups AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS d FROM (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) > 1)),
checks AS (
  SELECT 1 AS check_id, 'columns' AS "check", CAST(0 AS BIGINT) AS bad_rows
  UNION ALL SELECT 2, 'id_integer', bad_id FROM one
  UNION ALL SELECT 3, 'label_integer', bad_label FROM one
  UNION ALL SELECT 4, 'label_range', invalid FROM one
  UNION ALL SELECT 5, 'unique_id', d FROM dups
  UNION ALL SELECT 6, 'no_missing', nulls FROM one)
SELECT CAST(check_id AS INTEGER) AS check_id, "check", bad_rows = 0 AS passed, CAST(bad_rows AS BIGINT) AS bad_rows
FROM checks WHERE bad_rows <> 0 ORDER BY check_id LIMIT 1""",
        "distribution_lines": f"""WITH {CORPUS},
names AS (SELECT * FROM (VALUES (0, 'en'), (1, 'de'), (2, 'es'), (3, 'fr')) t(label, name)),
c AS (SELECT c.label, n.name, count(*) AS count,
             100.0 * count(*) / (SELECT count(*) FROM corpus) AS pct
      FROM corpus c LEFT JOIN names n ON c.label = n.label WHERE c.label IS NOT NULL GROUP BY c.label, n.name)
SELECT label, printf('  %d: %-15s - %7d samples (%5.2f%%)', label, name, count, pct) AS value FROM c""",
        "balance_summary_lines": f"""WITH bal AS ({BAL_MAJ}),
b AS (SELECT count(*) AS n FROM orders),
a AS (SELECT count(*) AS n FROM bal)
SELECT 1 AS line, 'Original size: ' || format('{{:,}}', (SELECT n FROM b)) AS value
UNION ALL SELECT 2, 'Balanced size: ' || format('{{:,}}', (SELECT n FROM a))
UNION ALL SELECT 3, 'Reduction: ' || printf('%.1f%%', 100.0 * (1 - (SELECT n FROM a) / (SELECT n FROM b)))""",
        "balance_audit_lines": f"""WITH {SKEWED},
{_draws(_share(Q.TARGET_SHARE), f"label <> 0 AND n_rows < {_share(Q.TARGET_SHARE)}")},
bal AS (SELECT label FROM ranked
        WHERE (label = 0 AND rnk <= {Q.HUMAN_SAMPLES}) OR (label <> 0 AND n_rows >= {_share(Q.TARGET_SHARE)})
        UNION ALL SELECT label FROM drawn),
b AS (SELECT label, count(*) AS n FROM src GROUP BY label),
a AS (SELECT label, count(*) AS n FROM bal GROUP BY label),
names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{Q.LABEL_NAMES[i]}')" for i in range(4))}) t(label, name)),
j AS (SELECT coalesce(b.label, a.label) AS label, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after
      FROM b FULL OUTER JOIN a ON a.label = b.label)
SELECT j.label, CASE WHEN n_after < n_before THEN printf('Undersampling: %d -> %d samples', n_before, n_after)
                     WHEN n_after > n_before THEN printf('Label %d (%-15s): %6d -> %6d (oversampled)', j.label, n.name, n_before, n_after)
                     ELSE printf('Label %d (%-15s): %6d samples (kept all)', j.label, n.name, n_before) END AS value
FROM j LEFT JOIN names n ON j.label = n.label""",
        "focal_loss_sum": f"""WITH {CE_ROWS},
c AS (SELECT y_true AS label, count(*) AS count FROM scores GROUP BY y_true),
w AS (SELECT label, (SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count) AS weight FROM c),
f AS (SELECT w.weight * r.nll AS ce FROM ce_rows r LEFT JOIN w ON r.y_true = w.label)
SELECT round(sum(pow(1 - exp(-ce), {Q.GAMMA}) * ce), 6) AS focal_loss FROM f""",
        "focal_loss_documented": f"""WITH {CE_ROWS},
c AS (SELECT y_true AS label, count(*) AS count FROM scores GROUP BY y_true),
w AS (SELECT label, (SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count) AS weight FROM c),
f AS (SELECT w.weight * r.nll AS ce, exp(-r.nll) AS p FROM ce_rows r LEFT JOIN w ON r.y_true = w.label)
SELECT round(avg(pow(1 - p, {Q.GAMMA}) * ce), 6) AS focal_loss FROM f""",
        "batch_ids": f"""SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row_id,
       CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / {Q.BATCH_SIZE}) AS BIGINT) AS batch
FROM embeddings""",
    })
    return sql | extended.ORACLE | {name: sql[other] for name, other in extended.SAME_AS.items()}
