"""Queries of whole runs: general weighted sampling, subword encoding, training
with epochs and a saved model, alignment by file position, files written and
read back. Each with its DuckDB SQL beside it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelscope.functions.hashing import hex_prefix_int
from labelscope.operators import checked_write, cube, groups, sample_layout, sketches, subword, trainer, weighted
from labelscope.operators import history as hist
from labelscope.plans import roles, runs
from labelscope.session import ensure_checkpoint_dir, stage_table
from labelscope.sources.committed import CommittedJson
from labelscope.sources.io import read_csv, read_table, write_csv, write_history, write_table
from labelscope.sources.positions import align_positions, read_positions

SEED = 42
#: Rows taken without replacement, as one in so many.
TAKEN_SHARE = 10

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a function ``q_<name>`` with its SQL."""
    def add(fn):
        QUERIES[fn.__name__[2:]] = fn
        ORACLE[fn.__name__[2:]] = sql
        return fn
    return add


# ------------------------------------------------------------------ R5, arbitrary weights

def _priced(spark, d):
    """Orders weighted by their price."""
    return roles.table(spark, d, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"])


@query(f"""WITH top AS (SELECT max(o_totalprice) AS t FROM orders),
p AS (SELECT o_orderkey, o_orderpriority, greatest(floor(o_totalprice / t * 1125899906842624.0 + 0.5)::BIGINT, 1) AS parts,
        md5('{SEED}:row:' || o_orderkey) AS k FROM orders, top WHERE o_totalprice > 0),
l AS (SELECT *, sum(parts) OVER (ORDER BY k, o_orderkey ROWS UNBOUNDED PRECEDING) AS upto FROM p),
line AS (SELECT *, upto - parts AS lo FROM l),
n AS (SELECT count(*) AS n FROM orders),
h AS (SELECT draw, md5('{SEED}:place:' || draw) AS h FROM (SELECT unnest(range(n)) AS draw FROM n)),
d AS (SELECT draw, (('0x' || substr(h, 1, 15))::BIGINT::HUGEINT * 1152921504606846976::HUGEINT + ('0x' || substr(h, 16, 15))::BIGINT)
        % (SELECT sum(parts) FROM p) AS at FROM h)
SELECT draw, o_orderkey, o_orderpriority FROM d ASOF JOIN line ON d.at >= line.lo""")
def q_weighted_draws(spark, d):
    """As many draws as there are orders, by price."""
    orders = _priced(spark, d)
    return weighted.weighted_draws(orders, "o_totalprice", orders.count(), seed=SEED, id_cols=["o_orderkey"],
                                   columns=["o_orderkey", "o_orderpriority"])


@query(f"""WITH k AS (SELECT o_orderkey, o_totalprice,
  -ln((('0x' || substr(md5('{SEED}:key:' || o_orderkey), 1, 12))::BIGINT + 1) / 281474976710656.0) / o_totalprice AS key
  FROM orders WHERE o_totalprice > 0)
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM k
QUALIFY row_number() OVER (ORDER BY key, o_orderkey) <= (SELECT count(*) // {TAKEN_SHARE} FROM orders)""")
def q_weighted_without_replacement(spark, d):
    """A tenth of the orders, by price."""
    orders = _priced(spark, d).drop("o_orderpriority")
    taken = weighted.weighted_without_replacement(orders, "o_totalprice", orders.count() // TAKEN_SHARE, seed=SEED,
                                                  id_cols=["o_orderkey"])
    return taken.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


# ------------------------------------------------------------------ T5, T7, W-1, T2: epochs and a saved model

DIMS, EPOCHS, STEPS, RATE, DECAY, GAMMA = 256, 3, 2, 0.1, 0.01, 2.0
CLASSES = list(range(len(roles.CORPUS_LANGS)))


def _split(spark, d):
    """Labelled documents: four fifths to train on, the rest held out."""
    c = roles.corpus(spark, d).where("label is not null")
    fold = hex_prefix_int(F.md5(F.concat(F.lit("fold:"), F.col("doc_id").cast("string"))), 8) % 5
    return c.where(fold != 0), c.where(fold == 0)


def _trained(spark, d):
    train, held = _split(spark, d)
    state_dir = f"{ensure_checkpoint_dir(spark).rstrip('/')}/labelscope-train-{uuid.uuid4().hex}"
    return trainer.train_epochs(spark, train, held, "doc_id", labels=CLASSES, state_dir=state_dir, epochs=EPOCHS, steps=STEPS, dims=DIMS,
                                loss="focal", gamma=GAMMA, rate=RATE, decay=DECAY, seed=SEED)


def _training_sql() -> str:
    """The training as SQL: one chain of tables per step, unrolled."""
    k = len(CLASSES)
    cases = " ".join(f"WHEN '{lang}' THEN {i}" for i, lang in enumerate(roles.CORPUS_LANGS))
    out = [f"""c AS (SELECT doc_id, text, CASE lang {cases} END AS y,
  (('0x' || substr(md5('fold:' || doc_id), 1, 8))::BIGINT % 5 = 0) AS held,
  ('0x' || substr(md5('{SEED}:step:' || doc_id), 1, 12))::BIGINT % {STEPS} AS step FROM documents),
tok AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+')) AS t FROM c WHERE y IS NOT NULL),
cnt AS (SELECT doc_id, f, count(*)::DOUBLE AS n FROM (
    SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIMS} AS f FROM tok WHERE t <> '') GROUP BY doc_id, f),
x AS MATERIALIZED (SELECT doc_id, f, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS v FROM cnt
  UNION ALL SELECT doc_id, {DIMS}, 1.0 FROM c WHERE y IS NOT NULL),
lab AS (SELECT doc_id, y, held, step FROM c WHERE y IS NOT NULL),
a AS (SELECT y, (SELECT count(*) FROM lab WHERE NOT held) / ((SELECT count(DISTINCT y) FROM lab WHERE NOT held) * count(*)) AS alpha
  FROM lab WHERE NOT held GROUP BY y),
w0 AS (SELECT k, f, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM range({k}) r(k), range({DIMS + 1}) s(f))"""]
    total, t = EPOCHS * STEPS, 0
    for e in range(1, EPOCHS + 1):
        for s in range(STEPS):
            rate = RATE * trainer.cosine_rate(t, total, int(0.1 * total))
            t += 1
            out.append(f"""z{t} AS MATERIALIZED (SELECT lab.doc_id, lab.y, w.k, sum(x.v * w.w) AS z FROM lab JOIN x USING (doc_id)
  JOIN w{t - 1} w ON w.f = x.f WHERE NOT lab.held AND lab.step = {s} GROUP BY lab.doc_id, lab.y, w.k),
q{t} AS (SELECT *, max(z) OVER d + ln(sum(exp(z)) OVER d) - max(z) OVER d AS lse FROM z{t} WINDOW d AS (PARTITION BY doc_id)),
r{t} AS MATERIALIZED (SELECT q.doc_id, q.y, alpha, -alpha * (max(z) FILTER (WHERE k = q.y) - max(lse)) AS ce,
    arg_min(k, struct_pack(z := -z, k := k)) AS guess FROM q{t} q JOIN a ON a.y = q.y GROUP BY q.doc_id, q.y, alpha),
s{t} AS (SELECT *, pow(1 - exp(-ce), {GAMMA}) + {GAMMA} * pow(1 - exp(-ce), {GAMMA - 1}) * exp(-ce) * ce AS by_ce FROM r{t}),
g{t} AS MATERIALIZED (SELECT q.k, x.f, sum(by_ce * alpha * (exp(q.z - q.lse) - (q.k = q.y)::INT) * x.v) / (SELECT count(*) FROM r{t}) AS g
  FROM q{t} q JOIN s{t} s USING (doc_id) JOIN x USING (doc_id) GROUP BY q.k, x.f),
n{t} AS (SELECT least(1.0, 1.0 / (sqrt(sum(g * g)) + 1e-6)) AS clip FROM g{t}),
u{t} AS (SELECT k, f, w, 0.9 * m + 0.1 * coalesce(g, 0) * clip AS m, 0.999 * v + 0.001 * pow(coalesce(g, 0) * clip, 2) AS v
  FROM w{t - 1} LEFT JOIN g{t} USING (k, f), n{t}),
w{t} AS MATERIALIZED (SELECT k, f, w * (1 - {rate!r} * {DECAY}) - {rate!r} * (m / (1 - pow(0.9, {t}))) / (sqrt(v / (1 - pow(0.999, {t}))) + 1e-8) AS w, m, v
  FROM u{t})""")
        steps = range(t - STEPS + 1, t + 1)
        loss = " UNION ALL ".join(f"SELECT avg(pow(1 - exp(-ce), {GAMMA}) * ce) AS l FROM r{i}" for i in steps)
        seen = " UNION ALL ".join(f"SELECT y, guess FROM r{i}" for i in steps)
        out.append(f"""hz{e} AS (SELECT lab.doc_id, lab.y, w.k, sum(x.v * w.w) AS z FROM lab JOIN x USING (doc_id)
  JOIN w{t} w ON w.f = x.f WHERE lab.held GROUP BY lab.doc_id, lab.y, w.k),
hp{e} AS (SELECT y, arg_min(k, struct_pack(z := -z, k := k)) AS guess FROM hz{e} GROUP BY doc_id, y),
tp{e} AS ({seen}),
""" + ",\n".join(f"""{p}f{e} AS (SELECT coalesce(avg(2.0 * hit / n), 0) AS f1 FROM (SELECT k, sum(hit) AS hit, sum(n) AS n FROM (
    SELECT y AS k, (y = guess)::INT AS hit, 1 AS n FROM {p}p{e} UNION ALL SELECT guess, 0, 1 FROM {p}p{e}) GROUP BY k))""" for p in "th") + f""",
e{e} AS (SELECT {e} AS epoch, (SELECT avg(l) FROM ({loss})) AS train_loss, (SELECT f1 FROM tf{e}) AS train_f1, (SELECT f1 FROM hf{e}) AS val_f1)""")
    rows = " UNION ALL ".join(f"SELECT * FROM e{e}" for e in range(1, EPOCHS + 1))
    out.append(f"""hist AS MATERIALIZED ({rows}),
best AS (SELECT CASE WHEN max(val_f1) > 0 THEN arg_min(epoch, struct_pack(f := -val_f1, e := epoch)) ELSE {EPOCHS} END AS e FROM hist)""")
    return "WITH " + ",\n".join(out)


@query(_training_sql() + """
SELECT epoch::INTEGER AS epoch, round(train_loss, 6) AS train_loss, round(train_f1, 6) AS train_f1, round(val_f1, 6) AS val_f1,
  val_f1 > coalesce(max(val_f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved,
  epoch = (SELECT e FROM best) AS best FROM hist""")
def q_train_epochs(spark, d):
    """Focal loss with balanced class weights: the history, the epochs that would
    have saved a checkpoint and the best one."""
    h, path = _trained(spark, d)
    saved = hist.checkpoint_events(h).select(F.col("epoch").alias("_saved"))
    best = int(path.rsplit("-", 1)[1])
    return h.join(saved, F.col("epoch") == F.col("_saved"), "left").select(
        "epoch", *(F.round(c, 6).alias(c) for c in ("train_loss", "train_f1", "val_f1")),
        F.col("_saved").isNotNull().alias("saved"), (F.col("epoch") == best).alias("best"))


@query(_training_sql() + f""",
wb AS ({" UNION ALL ".join(f"SELECT * FROM w{e * STEPS} WHERE (SELECT e FROM best) = {e}" for e in range(1, EPOCHS + 1))}),
every AS (SELECT doc_id, f, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS v FROM (
    SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIMS} AS f, count(*)::DOUBLE AS n FROM (
      SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \\t\\r\\n]+')) AS t FROM documents) WHERE t <> '' GROUP BY 1, 2)
  UNION ALL SELECT doc_id, {DIMS}, 1.0 FROM documents)
SELECT doc_id, arg_min(k, struct_pack(z := -z, k := k))::INTEGER AS y_pred, round(max(z), 6) AS logit FROM (
  SELECT doc_id, k, sum(every.v * wb.w) AS z FROM every JOIN wb USING (f) GROUP BY doc_id, k) GROUP BY doc_id""")
def q_score_texts(spark, d):
    """All texts scored with the saved model of the best epoch."""
    _, path = _trained(spark, d)
    scored = trainer.score_texts(spark, path, roles.corpus(spark, d), "doc_id")
    return scored.select("doc_id", "y_pred", F.round(F.array_max("logits"), 6).alias("logit"))


# ------------------------------------------------------------------ tables written to files and read back

def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/labelscope-{name}-{uuid.uuid4().hex}"


def _in_files(df, path: str, parts: int, key: str) -> str:
    """``df`` in ``key`` order as ``parts`` Parquet files."""
    df.repartitionByRange(parts, key).sortWithinPartitions(key).drop(key).write.parquet(path)
    return path


_SCORED = """s AS (SELECT vec_id, label::INTEGER AS y_true, (list_position(embedding[1:10]::DOUBLE[], list_max(embedding[1:10]::DOUBLE[])) - 1)::INTEGER AS y_pred,
  (list_position(embedding[11:20]::DOUBLE[], list_max(embedding[11:20]::DOUBLE[])) - 1)::INTEGER AS y_other FROM embeddings)"""


@query(f"""WITH {_SCORED}
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, y_true, y_pred, (y_true = y_pred)::INTEGER AS correct FROM s""")
def q_positional_alignment(spark, d):
    """Truth and predictions in files of different numbers and sizes, without ids,
    paired by row position (P7, J1, P8)."""
    scored, where = roles.scores(spark, d), _folder(spark, "positions")
    truth = read_positions(spark, _in_files(scored.select("vec_id", "y_true"), f"{where}/truth", 5, "vec_id"))
    predicted = read_positions(spark, _in_files(scored.select("vec_id", "y_pred"), f"{where}/predicted", 3, "vec_id"))
    return groups.with_correct(align_positions(truth, predicted)).select("position", "y_true", "y_pred", "correct")


@query(f"""WITH {_SCORED},
p AS (SELECT CASE WHEN vec_id % 7 <> 0 THEN y_pred END AS a, CASE WHEN vec_id % 5 <> 0 THEN y_other END AS b FROM s)
SELECT count(*) AS n, round(avg(coalesce(a = b, false)::INTEGER), 6) AS agreement, count(*) FILTER (WHERE NOT coalesce(a = b, false)) AS differences,
  round(100.0 * count(*) FILTER (WHERE NOT coalesce(a = b, false)) / count(*), 6) AS difference_pct FROM p""")
def q_compare_files(spark, d):
    """Two prediction files with missing labels, written, read and compared (T11, IO2, IO5)."""
    where = _folder(spark, "compare")
    for name, df, gap in (("a", roles.scores(spark, d), 7), ("b", roles.scores_b(spark, d), 5)):
        label = F.when(F.col("vec_id") % gap != 0, F.col("y_pred"))
        write_csv(df.select(F.col("vec_id").alias("id"), label.alias("label")), f"{where}/{name}", order_by=["id"])
    row, _ = runs.compare_run(spark, f"{where}/a", f"{where}/b")
    return row.select("n", F.round("agreement", 6).alias("agreement"), "differences", F.round("difference_pct", 6).alias("difference_pct"))


@query("""WITH j AS (SELECT d.lang AS language, l.quality::INTEGER AS t, (d.n_chars >= 1000)::INTEGER AS p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
k AS (SELECT k, count(*) FILTER (WHERE t = k AND p = k) AS hit, count(*) FILTER (WHERE t = k) + count(*) FILTER (WHERE p = k) AS n
  FROM j, (VALUES (0), (1)) v(k) GROUP BY k),
r AS (SELECT 'metrics' AS output, 'macro_f1' AS item, avg(2.0 * hit / n) AS value FROM k WHERE n > 0
  UNION ALL SELECT 'metrics', 'accuracy', avg((t = p)::INTEGER) FROM j
  UNION ALL SELECT 'language_stats', language || ' accuracy', round_even(avg((t = p)::INTEGER), 3) FROM j WHERE language IS NOT NULL GROUP BY language
  UNION ALL SELECT 'language_stats', language || ' count', count(*) FROM j WHERE language IS NOT NULL GROUP BY language
  UNION ALL SELECT 'confusion_normalized', a.k || ' as ' || b.k, coalesce((SELECT count(*) FROM j WHERE t = a.k AND p = b.k)
    / nullif((SELECT count(*) FROM j WHERE t = a.k), 0), 0) FROM (VALUES (0), (1)) a(k), (VALUES (0), (1)) b(k)
  UNION ALL SELECT 'classification_report', 'accuracy', round_even(avg((t = p)::INTEGER), 3) FROM j)
SELECT output, item, round(value::DOUBLE, 6) AS value FROM r""")
def q_evaluation_files(spark, d):
    """A full evaluation written to files (T8, IO5, IO6, IO7, IO9), read back."""
    where, judged = _folder(spark, "evaluation"), roles.judged(spark, d)
    runs.evaluation_run(spark, judged.select("doc_id", "y_pred"), judged.drop("y_pred"), "doc_id", where, labels=[0, 1],
                        names=["poor", "good"], pred_col="y_pred", true_col="y_true")
    record = spark.read.json(f"{where}/metrics")
    stats = read_csv(spark, f"{where}/language_stats", schema="language STRING, accuracy DOUBLE, count BIGINT")
    cells = read_csv(spark, f"{where}/confusion_normalized", schema="y_true INT, y_pred INT, n BIGINT, share DOUBLE")
    lines = spark.read.text(f"{where}/classification_report")
    out = [record.select(F.lit("metrics").alias("output"), F.lit(c).alias("item"), F.col(c).cast("double").alias("value"))
           for c in ("macro_f1", "accuracy")]
    out += [stats.select(F.lit("language_stats"), F.concat("language", F.lit(f" {c}")), F.col(c).cast("double")) for c in ("accuracy", "count")]
    out.append(cells.select(F.lit("confusion_normalized"), F.concat("y_true", F.lit(" as "), "y_pred"), "share"))
    accuracy = F.regexp_extract("value", r"^ +accuracy +([0-9.]+)", 1)
    out.append(lines.where(accuracy != "").select(F.lit("classification_report"), F.lit("accuracy"), accuracy.cast("double")))
    rows = out[0]
    for df in out[1:]:
        rows = rows.union(df)
    return rows.select("output", "item", F.round("value", 6).alias("value"))


@query("""WITH daily AS (SELECT ts::DATE AS day, min(value) / 100 AS train_loss, max(value) / 1000 AS train_f1, avg(value) / 100 AS val_f1,
    count(*) AS n FROM events GROUP BY ts::DATE),
h AS (SELECT row_number() OVER (ORDER BY day)::INTEGER AS epoch, train_loss, train_f1, val_f1, CASE WHEN n % 2 = 0 THEN n / 10.0 END AS val_loss FROM daily)
SELECT epoch, round(train_loss, 6) AS train_loss, round(train_f1, 6) AS train_f1, round(val_f1, 6) AS val_f1,
  round(coalesce(val_loss, 0.0)::DOUBLE, 6) AS val_loss, coalesce(bool_or(val_loss <> 0) OVER (), false) AS plot_val_loss,
  val_f1 > coalesce(max(val_f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved FROM h""")
def q_history_file(spark, d):
    """A history with some validation losses, written as one JSON array and read
    back (IO3, IO8): the curve table (P12, P13) and the checkpoints (W-1)."""
    path = f"{_folder(spark, 'history')}/history.json"
    days = roles.table(spark, d, "events", ["ts"]).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = days.select(F.row_number().over(Window.orderBy("day")).cast("int").alias("epoch"), "n")  # one row a day
    losses = days.select("epoch", F.when(F.col("n") % 2 == 0, F.col("n") / 10.0).alias("val_loss"))
    write_history(roles.history(spark, d).join(losses, "epoch"), path)
    series, events, _ = runs.history_run(spark, path)
    saved = events.select(F.col("epoch").cast("int").alias("_saved"))
    numbers = [F.round(c, 6).alias(c) for c in ("train_loss", "train_f1", "val_f1", "val_loss")]
    return series.join(saved, F.col("epoch") == F.col("_saved"), "left").select(
        "epoch", *numbers, "plot_val_loss", F.col("_saved").isNotNull().alias("saved"))


@query("""SELECT o_orderkey AS "ID", (o_custkey % 11)::INTEGER AS label, (o_orderkey % 4)::INTEGER AS part FROM orders""")
def q_written_tables(spark, d):
    """A labelled table through partitioned Parquet (IO4), a sorted CSV (IO5, S-2)
    and back, rows matched by id; part files that are not in id order raise."""
    where = _folder(spark, "written")
    src = roles.table(spark, d, "orders", ["o_orderkey", "o_custkey"]).select(
        F.col("o_orderkey").alias("ID"), (F.col("o_custkey") % 11).cast("int").alias("label"), (F.col("o_orderkey") % 4).cast("int").alias("part"))
    write_table(src, f"{where}/parquet", partition_by=["part"])
    stored = read_table(spark, f"{where}/parquet", ["ID", "label", "part"])
    write_csv(stored.select("ID", "label"), f"{where}/csv", order_by=["ID"])
    back = read_csv(spark, f"{where}/csv", schema="ID BIGINT, label INT")
    files = back.withColumn("_file", F.input_file_name()).groupBy("_file").agg(F.min("ID").alias("_low"), F.max("ID").alias("_high"))
    before = F.max("_high").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    disorder = files.withColumn("_bad", F.coalesce(before >= F.col("_low"), F.lit(False))).agg(F.max("_bad").alias("_bad"))
    checked = back.join(F.broadcast(disorder)).withColumn(  # one row
        "label", F.when(F.col("_bad"), F.raise_error(F.lit("the files are not in id order")).cast("int")).otherwise(F.col("label")))
    return checked.join(stored.select("ID", F.col("label").alias("_label"), "part"), "ID").where("label = _label").select("ID", "label", "part")


# ------------------------------------------------------------------ T1 with a given subword vocabulary

MAX_LENGTH = 512


def _vocabulary() -> str:
    """Path of a public byte-level vocabulary; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _subword_sql(path: str, texts: str) -> str:
    """Types of ``texts(doc_id, t)`` and their tokens: the lowest-ranked pair of
    every type is merged at all its places, round by round."""
    letters = ", ".join("'" + c.replace("'", "''") + "'" for c in subword.byte_letters())
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+".replace("'", "''")
    return rf"""WITH RECURSIVE file AS (SELECT content::JSON AS j FROM read_text('{path}')),
vocab AS MATERIALIZED (SELECT unnest(map_entries(json_extract(j, '$.model.vocab')::MAP(VARCHAR, INTEGER))) AS e FROM file),
pairs AS MATERIALIZED (SELECT m[1] AS l, m[2] AS r, n FROM (
  SELECT unnest(ms) AS m, unnest(range(len(ms))) AS n FROM (SELECT json_extract(j, '$.model.merges')::VARCHAR[][] AS ms FROM file))),
texts AS ({texts}),
cut AS MATERIALIZED (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(coalesce(t, ''), '(\s+)(\s[^\s])', '\1' || chr(1) || '\2', 'g'),
  '{pattern}'), lambda x: x <> chr(1)) AS types FROM texts),
alphabet AS (SELECT [{letters}] AS letters),
kinds AS (SELECT DISTINCT unnest(types) AS type FROM cut),
start AS (SELECT type, list_transform(range(strlen(type)), lambda i: letters[('0x' || substr(hex(encode(type)), (2 * i + 1)::BIGINT, 2))::INT + 1]) AS ps
  FROM kinds, alphabet),
steps AS (SELECT type, ps, 0 AS round FROM start UNION ALL
  SELECT type, list_reduce(list_transform(ps, lambda x: [x]), lambda acc, x: CASE WHEN acc[len(acc)] = b.l AND x[1] = b.r
      THEN list_append(acc[1:len(acc) - 1], b.l || b.r) ELSE list_append(acc, x[1]) END), round + 1
  FROM (SELECT type, round, any_value(ps) AS ps, arg_min(struct_pack(l := pairs.l, r := pairs.r), n) AS b FROM (
      SELECT type, round, ps, unnest(ps[1:len(ps) - 1]) AS l, unnest(ps[2:]) AS r FROM steps) x
    JOIN pairs ON pairs.l = x.l AND pairs.r = x.r GROUP BY type, round)),
done AS (SELECT type, arg_max(ps, round) AS ps FROM steps GROUP BY type),
tokens AS MATERIALIZED (SELECT type, list(e.value ORDER BY i) AS ids FROM (SELECT type, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM done)
  JOIN vocab ON e.key = p GROUP BY type)"""


def _register_subwords() -> None:
    try:
        path = _vocabulary()
    except ModuleNotFoundError:  # no vocabulary files on this machine
        return

    @query(_subword_sql(path, "SELECT doc_id, text AS t FROM documents") + """
SELECT type, count(*) AS count, any_value(ids) AS token_ids FROM (SELECT unnest(types) AS type FROM cut) JOIN tokens USING (type) GROUP BY type""")
    def q_subword_types(spark, d):
        """Every type of the corpus with its count and tokens."""
        return subword.subword_types(roles.corpus(spark, d), _vocabulary(), "code")

    @query(_subword_sql(path, "SELECT doc_id, '# Language: ' || coalesce(lang, '') || chr(10) || coalesce(text, '') AS t FROM documents") + f""",
f AS (SELECT doc_id, flatten(list(ids ORDER BY i))[1:{MAX_LENGTH - 2}] AS ids FROM (
    SELECT doc_id, unnest(types) AS type, generate_subscripts(types, 1) AS i FROM cut) JOIN tokens USING (type) GROUP BY doc_id)
SELECT doc_id, list_concat([50256], ids, [50256], list_transform(range({MAX_LENGTH - 2} - len(ids)), lambda x: 50256))::INTEGER[] AS input_ids,
  list_transform(range({MAX_LENGTH}), lambda i: (i < len(ids) + 2)::INT)::INTEGER[] AS attention_mask FROM f""")
    def q_subword_encode(spark, d):
        """Texts with their language prefix as 512 tokens between marks; the
        vocabulary's one special id marks both ends and pads."""
        return subword.subword_encode(roles.corpus(spark, d), _vocabulary(), "doc_id", "code", MAX_LENGTH, bos=50256, eos=50256,
                                      pad=50256, language_col="language")


_register_subwords()


# ------------------------------------------------------------------ T9 in one aggregate, V1-V7 in the writing pass

def _cube(spark, d):
    """The corpus cube, stored: the tables below read it, not the texts."""
    return stage_table(cube.profile_cube(roles.corpus(spark, d)), "profile-cube")


@query("""WITH c AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END::INTEGER AS label, lang AS language,
  source AS generator, length(coalesce(text, ''))::INTEGER AS length FROM documents)
SELECT CASE grouping(label, language, generator, length) WHEN 7 THEN 'label' WHEN 11 THEN 'language' WHEN 13 THEN 'generator' ELSE 'length' END AS part,
  label, language, generator, length, count(*) AS rows FROM c GROUP BY GROUPING SETS ((label), (language), (generator), (length))""")
def q_profile_cube(spark, d):
    """Counts by label, language, generator and text length from one scan; the
    two halves of the corpus are counted apart and added up."""
    c = roles.corpus(spark, d)
    half = F.col("doc_id") % 2 == 0
    return cube.merge_cubes(cube.profile_cube(c.where(half)), cube.profile_cube(c.where(~half)))


def q_cube_distribution(spark, d):
    t = cube.cube_distribution(spark, _cube(spark, d), CLASSES, roles.CORPUS_LANGS)
    return t.select("label", "name", "count", F.round("pct", 6).alias("pct"))


def q_cube_languages(spark, d):
    return cube.cube_values(_cube(spark, d), "language")


def q_cube_top_generators(spark, d):
    return cube.cube_top(_cube(spark, d), "generator", 20)


def q_cube_lengths(spark, d):
    t = cube.cube_lengths(_cube(spark, d))
    return t.select(*("count" if c == "count" else F.round(c, 6).alias(c) for c in t.columns))


def q_cube_summary(spark, d):
    t = cube.cube_summary(_cube(spark, d))
    return t.select(*(F.round(c, 6).alias(c) if c in ("mean_length", "imbalance_ratio") else c for c in t.columns))


def _written(spark, d):
    """Line items as a submission: order numbers as ids, so many repeat."""
    items = roles.table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"])
    rows = items.select(F.col("l_orderkey").cast("string").alias("id"), (F.col("l_linenumber") + 5).cast("string").alias("label"))
    return checked_write.write_checked(spark, rows, f"{_folder(spark, 'submission')}/submission")


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber + 5 AS label FROM lineitem),
c AS (SELECT 1 AS check_id, 'columns' AS "check", 0 AS bad_rows UNION ALL SELECT 2, 'id_integer', 0 UNION ALL SELECT 3, 'label_integer', 0
  UNION ALL SELECT 4, 'label_range', count(*) FROM s WHERE label NOT BETWEEN 0 AND 10
  UNION ALL SELECT 5, 'unique_id', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM s GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 6, 'no_missing', count(*) FROM s WHERE id IS NULL OR label IS NULL)
SELECT check_id::INTEGER AS check_id, "check", bad_rows = 0 AS passed, bad_rows::BIGINT AS bad_rows FROM c""")
def q_submission_written(spark, d):
    return _written(spark, d)[0]


@query("""SELECT (l_linenumber + 5)::INTEGER AS label, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS pct,
  (SELECT count(*) FROM lineitem) AS total FROM lineitem WHERE l_linenumber + 5 <= 10 GROUP BY l_linenumber""")
def q_submission_written_summary(spark, d):
    return _written(spark, d)[1].withColumn("pct", F.round("pct", 6))


# ------------------------------------------------------------------ stored sketches

def _sketched(spark, d):
    """Sketch rows by language, appended one language at a time, read back."""
    path, c = _folder(spark, "sketches"), roles.corpus(spark, d)
    for lang in roles.CORPUS_LANGS:
        sketches.add_parts(sketches.sketch_parts(c.where(F.col("language") == lang), "language"), path)
    sketches.add_parts(sketches.sketch_parts(c.where(~F.coalesce(F.col("language").isin(roles.CORPUS_LANGS), F.lit(False))), "language"), path)
    return spark.read.parquet(path)


@query("""SELECT count(*) AS rows, count(DISTINCT source) AS n_values, min(length(coalesce(text, ''))) AS least,
  quantile_disc(length(coalesce(text, '')), 0.25) AS p25, quantile_disc(length(coalesce(text, '')), 0.5) AS p50,
  quantile_disc(length(coalesce(text, '')), 0.75) AS p75, max(length(coalesce(text, ''))) AS most FROM documents""")
def q_sketch_profile(spark, d):
    """The profile from merged sketches; exact while a corpus has at most 4,096 rows."""
    return sketches.merged_profile(_sketched(spark, d))


@query("""SELECT source AS value, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY source
QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 5000""")
def q_sketch_top(spark, d):
    """Sources by frequency from merged sketches, up to 5,000 of them (exact for up to 6,000)."""
    return sketches.merged_top(_sketched(spark, d), 5000)


# ------------------------------------------------------------------ record files with a commit step

@query("""SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderkey % 3 = 0 AS third FROM orders""")
def q_committed_files(spark, d):
    """Orders written in two commits through the committed data source, read back."""
    spark.dataSource.register(CommittedJson)
    orders = roles.table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"]).withColumn("third", F.col("o_orderkey") % 3 == 0)
    path = _folder(spark, "committed")
    for mode, part in (("overwrite", orders.where("third")), ("append", orders.where("not third"))):
        part.repartition(4).write.format("committed_json").mode(mode).save(path)
    back = spark.read.format("committed_json").load(path)
    return back.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 6).alias("o_totalprice"), "third")


# ------------------------------------------------------------------ samples from a stored layout

def q_sample_layout(spark, d):
    """An eighth of the orders per class, from the table stored in sample order."""
    path, orders = _folder(spark, "layout"), roles.skewed(spark, d)
    sample_layout.write_layout(orders, path, seed=SEED, id_cols=["o_orderkey"])
    taken = sample_layout.sample_layout(spark, path, orders.count() // 8, labels=roles.SKEWED_CLASSES, shuffle=True)
    return taken.select("o_orderkey", "label", "sample_key", "row_id")


#: Queries that must equal an older one: their SQL is the same.
SAME_AS = {"cube_distribution": "label_distribution", "cube_languages": "language_counts", "cube_top_generators": "generator_top20",
           "cube_lengths": "length_describe", "cube_summary": "corpus_profile", "sample_layout": "sample_by_class"}
QUERIES |= {name: globals()[f"q_{name}"] for name in SAME_AS}
