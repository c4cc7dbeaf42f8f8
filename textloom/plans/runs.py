"""Queries over runs of experiments, and over scores of documents under two models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import ngrams, selection
from ..sources import corpus, files
from .registry import D, query, windows_sql

#: Runs to compare, invented: name, arm, parameters, seed, best score, score but labels, steps, step of the best, commit, 16-bit, state.
RUNS = [
    ("sweep-char-1", "char", 2400, 1, 1.6100, 1.5800, 9000, 8300, "c0ffee1", False, "done"),
    ("sweep-char-2", "char", 2400, 2, 1.6180, 1.5860, 9000, 8100, "c0ffee1", False, "done"),
    ("sweep-char-3", "char", 2400, 3, 1.6140, 1.5790, 9000, 7900, "c0ffee1", False, "done"),
    ("sweep-char-1-again", "char", 2400, 1, 1.6120, 1.5820, 9000, 8200, "c0ffee1", False, "done"),
    ("sweep-pair-1", "pair", 2600, 1, 1.6300, 1.5900, 4200, 4100, "c0ffee1", False, "done"),
    ("sweep-pair-2", "pair", 2600, 2, 1.6220, 1.5880, 4200, 2100, "c0ffee1", False, "done"),
    ("sweep-pair-3", "pair", 2600, 3, 1.6410, 1.6010, 4200, 3900, "c0ffee1", False, "done"),
    ("sweep-word-1", "word", 3100, 1, 1.7010, 1.6600, 3800, 3700, "c0ffee1", False, "done"),
    ("sweep-word-2", "word", 3100, 2, 1.7100, 1.6650, 3800, 3300, "c0ffee1", False, "done"),
    ("sweep-word-3", "word", 3100, 3, 1.6950, 1.6570, 3800, 3600, "c0ffee1", False, "done"),
    ("late-char-1", "char", 2400, 1, 1.6000, None, 9000, 8800, "beef002", False, "done"),
    ("late-char-4", "char", 2400, 4, 1.5900, None, 9000, 8800, "c0ffee1", False, "done"),
    ("late-char-2", "char", 2400, 2, 1.5950, None, 9000, 8800, "c0ffee1", True, "done"),
    ("pilot-word-1", "word", 3100, 1, None, None, 5000, None, "c0ffee1", False, "diverged"),
    ("pilot-word-1001", "word", 3100, 1001, 1.7200, None, 5000, 4900, "c0ffee1", False, "replaced"),
    ("pilot-pair-1", "pair", 2600, 1, None, None, 5000, None, "c0ffee1", False, "interrupted"),
    ("pilot-char-1", "char", 2400, 1, None, None, 5000, None, "c0ffee1", False, "to do"),
]
COMMIT, SEEDS = "c0ffee1", (1, 2, 3)
NAMES = ["run", "arm", "parameters", "seed", "best", "everything_else", "steps", "best_step", "git_commit", "sixteen_bit", "state"]


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


#: The same records as rows, for SQL; a run that was replaced after it diverged is done.
ALL_SQL = f"a({', '.join(NAMES)}) AS (VALUES " + ", ".join("(" + ", ".join(_literal("done" if x == "replaced" else x) for x in r) + ")" for r in RUNS) + ")"
SQL = ALL_SQL + ", r AS (SELECT * FROM a WHERE starts_with(run, 'sweep-'))"


def _grouped(score: str) -> str:
    return SQL + f", s AS (SELECT arm, parameters, seed, avg({score}) AS best, max({score}) - min({score}) AS repeats FROM r GROUP BY ALL), g AS (SELECT arm, parameters, count(*) AS seeds, avg(best) AS mean, stddev_samp(best) AS sd, max(repeats) AS repeat_range FROM s GROUP BY ALL)"


def _pooled(score: str) -> str:
    return _grouped(score) + f", p AS (SELECT sqrt(sum(sd * sd * (seeds - 1)) / sum(seeds - 1)) AS pooled_sd, sum(seeds - 1)::BIGINT AS df, ({rules.T_95}::DOUBLE[])[least(sum(seeds - 1), {len(rules.T_95)})::INT] AS t FROM g)"


GROUPED, POOLED = _grouped("best"), _pooled("best")


def _folder(spark: SparkSession) -> str:
    """Run folders with these records, written anew."""
    folder, made = files.scratch(spark, "runs"), []
    for run, arm, parameters, seed, best, rest, steps, best_step, commit, sixteen, state in RUNS:
        own: dict = {"config.json": {"name": run, "arm": arm, "seed": seed, "steps": steps, "parameters": parameters, "git_commit": commit, "sixteen_bit": sixteen, "vocabulary": 98}}
        if best is not None:
            own["result.json"] = {"best": {"validation_bpc": best, "step": best_step, "passes": 8.5, "seen_bpc": 1.4}, "final_validation_bpc": best + 0.01, "minutes": steps / 250}
            own["log.csv"] = "step,passes,learning_rate,training_loss,validation_bpc,tokens_per_second\n" + "".join(f"{n},{n / 1000},0.001,{'nan' if n == 0 else 1.5},{best + 1 / (n + 1)},{800 + seed * 10 + n % 7}\n" for n in range(0, 500, 100))
        if rest is not None:
            own["evaluation-best.json"] = {"everything_else": {"bits_per_character": rest}}
        if state == "diverged":
            own["DIVERGED"] = ""
        if state == "interrupted":
            own["last.pt"] = ""
        made.append(own)
    files.write_runs(spark, folder, made)
    return folder


def _runs(spark: SparkSession, prefix: str = "sweep-") -> DataFrame:
    return files.read_runs(spark, _folder(spark), prefix)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("q_runs", f"WITH {ALL_SQL} SELECT run, arm, seed, best, steps, state, round(best + 0.01, 6) AS final FROM a")
def _(spark, sf_dir):
    """All run folders: settings with their results, null where a run did not finish."""
    return _round(_runs(spark, "").select("run", "arm", "seed", "best", "steps", "state", F.col("final_validation_bpc").alias("final")), "final")


@query("q_runlog", f"""WITH {SQL}, l AS (SELECT run, seed, best, n, 800 + seed * 10 + n % 7 AS speed, CASE WHEN n = 0 THEN 'nan'::DOUBLE ELSE 1.5 END AS loss FROM r, (SELECT unnest(range(0, 500, 100)) AS n))
    SELECT run, count(*) AS n, count(*) FILTER (WHERE isnan(loss)) AS n_nan, round(avg(loss) FILTER (WHERE NOT isnan(loss)), 6) AS mean, round(min(best + 1.0::DOUBLE / (n + 1)), 6) AS lowest FROM l GROUP BY run""")
def _(spark, sf_dir):
    """Logs' NaN stays NaN: it is neither null nor part of a mean."""
    log, nan = files.read_logs(spark, _folder(spark), "sweep-"), F.isnan("training_loss")
    return _round(log.groupBy("run").agg(F.count("*").alias("n"), F.count_if(nan).alias("n_nan"), F.avg(F.when(~nan, F.col("training_loss"))).alias("mean"), F.min("validation_bpc").alias("lowest")), "mean", "lowest")


@query("q_timings", f"WITH {SQL}, l AS (SELECT arm, (800 + seed * 10 + n % 7)::DOUBLE AS v FROM r, (SELECT unnest(range(0, 500, 100)) AS n)) SELECT arm, quantile_cont(v, 0.5) AS median, min(v) AS lowest, max(v) AS highest FROM l GROUP BY arm")
def _(spark, sf_dir):
    """Median and range of the speeds in the logs of each arm."""
    folder = _folder(spark)
    speeds = files.read_logs(spark, folder, "sweep-").join(files.read_runs(spark, folder, "sweep-").select("run", "arm"), "run")
    return speeds.groupBy("arm").agg(F.percentile("tokens_per_second", F.lit(0.5)).alias("median"), F.min("tokens_per_second").alias("lowest"), F.max("tokens_per_second").alias("highest"))


SETTINGS = ["arm", "steps", "parameters", "sixteen_bit", "vocabulary"]


@query("q_varying", f"WITH {ALL_SQL}, k AS (SELECT 'arm' AS key, arm AS v FROM a UNION ALL SELECT 'steps', steps::VARCHAR FROM a UNION ALL SELECT 'sixteen_bit', sixteen_bit::VARCHAR FROM a UNION ALL SELECT 'parameters', parameters::VARCHAR FROM a UNION ALL SELECT 'vocabulary', '98' FROM a) SELECT key, count(DISTINCT v) AS kinds FROM k GROUP BY key HAVING count(DISTINCT v) > 1")
def _(spark, sf_dir):
    told = F.explode(F.create_map(*[x for k in SETTINGS for x in (F.lit(k), F.col(k).cast("string"))]))
    return _runs(spark, "").select(told.alias("key", "v")).groupBy("key").agg(F.count_distinct("v").alias("kinds")).where("kinds > 1")


WHY = f"CASE WHEN state <> 'done' THEN 'not finished' WHEN git_commit <> '{COMMIT}' THEN 'another commit' WHEN seed NOT IN {SEEDS} THEN 'another seed' WHEN sixteen_bit THEN 'sixteen bits' WHEN steps <> 9000 THEN 'another length' END"


def _eligible(spark: SparkSession) -> DataFrame:
    why = selection.reason(not_finished=F.col("state") != "done", another_commit=F.col("git_commit") != COMMIT, another_seed=~F.col("seed").isin(*SEEDS), sixteen_bits=F.col("sixteen_bit"), another_length=F.col("steps") != 9000)
    return _runs(spark, "").where("arm = 'char'").withColumn("excluded_because", why)


@query("q_eligible", f"WITH {ALL_SQL} SELECT run, seed, best, git_commit, {WHY} AS excluded_because FROM a WHERE arm = 'char'")
def _(spark, sf_dir):
    return _eligible(spark).select("run", "seed", "best", "git_commit", "excluded_because")


@query("q_release", f"""WITH {ALL_SQL}, e AS (SELECT *, row_number() OVER (ORDER BY best, seed, run) AS place FROM a WHERE arm = 'char' AND ({WHY}) IS NULL) SELECT (SELECT run FROM e WHERE place = 1) AS run, (SELECT place FROM e WHERE run = 'sweep-char-3') AS place_of_third, min(best) AS best, round(avg(best), 6) AS mean, round(stddev_samp(best), 6) AS sd,
    round(max(best) - min(best), 6) AS spread, round(avg(best) - min(best), 6) AS gap FROM e""")
def _(spark, sf_dir):
    """The eligible run of the lowest score (then seed, then name), the place of another one, and what choosing gained."""
    w = Window.partitionBy(F.lit(0)).orderBy("best", "seed", "run")  # a handful of runs
    e = _eligible(spark).where("excluded_because IS NULL").withColumn("place", F.row_number().over(w).cast("long"))
    got = e.agg(F.min_by("run", "place").alias("run"), F.max(F.when(F.col("run") == "sweep-char-3", F.col("place"))).alias("place_of_third"), F.min("best").alias("best"), F.avg("best").alias("mean"), F.stddev_samp("best").alias("sd"), (F.max("best") - F.min("best")).alias("spread"), (F.avg("best") - F.min("best")).alias("gap"))
    return _round(got, "mean", "sd", "spread", "gap")


@query("q_run_state", f"WITH {ALL_SQL} SELECT run, state FROM a")
def _(spark, sf_dir):
    """By the files of each folder."""
    return _runs(spark, "").select("run", "state")


@query("q_run_groups", f"WITH {GROUPED} SELECT arm, parameters, seeds, round(mean, 6) AS mean, round(sd, 6) AS sd, round(repeat_range, 6) AS repeat_range FROM g")
def _(spark, sf_dir):
    return _round(selection.groups(_runs(spark)), "mean", "sd", "repeat_range")


def _test_sql(score: str) -> str:
    return f"WITH {_pooled(score)} SELECT a.arm AS first, b.arm AS second, round(b.mean - a.mean, 6) AS difference, round(t * pooled_sd * sqrt(1.0 / a.seeds + 1.0 / b.seeds), 6) AS threshold, CASE WHEN abs(b.mean - a.mean) > t * pooled_sd * sqrt(1.0 / a.seeds + 1.0 / b.seeds) THEN 'DIFFERENT' ELSE 'tie' END AS verdict FROM g a JOIN g b ON a.arm < b.arm, p"


@query("q_pooled_test", _test_sql("best"))
def _(spark, sf_dir):
    runs = _runs(spark)
    return _round(selection.verdicts(selection.groups(runs), selection.complete(runs)), "difference", "threshold")


@query("q_secondary_test", _test_sql("everything_else"))
def _(spark, sf_dir):
    """The same test on the score of everything but labels: it decides nothing."""
    runs = _runs(spark)
    return _round(selection.verdicts(selection.groups(runs, "everything_else"), selection.complete(runs)), "difference", "threshold")


@query("q_partial_test", f"WITH {ALL_SQL}, f AS (SELECT arm, count(DISTINCT seed) FILTER (WHERE state = 'done') AS seeds, bool_or(state IN ('interrupted', 'to do')) AS unfinished, bool_or(state = 'diverged') AS replaced FROM a GROUP BY arm) SELECT arm, seeds, unfinished, replaced, CASE WHEN (SELECT count(DISTINCT seeds) = 1 AND min(seeds) >= 3 AND NOT bool_or(unfinished) FROM f) THEN 'complete' ELSE 'PARTIAL' END AS status FROM f")
def _(spark, sf_dir):
    """Over all folders there is no verdict yet: some runs are unfinished."""
    return selection.completeness(_runs(spark, ""))


@query("q_choice", f"WITH {POOLED}, b AS (SELECT min(mean) AS lowest, arg_min(seeds, mean) AS bs FROM g) SELECT arm AS chosen FROM g, b, p WHERE mean - lowest <= t * pooled_sd * sqrt(1.0 / seeds + 1.0 / bs) ORDER BY parameters, mean, arm LIMIT 1")
def _(spark, sf_dir):
    runs = _runs(spark)
    return selection.choice(selection.groups(runs), selection.complete(runs))


@query("q_lengths", "WITH f(arm, steps) AS (VALUES ('char', 9000), ('pair', 4200), ('word', 3800)) SELECT arm, steps, arm AS taken_from FROM f UNION ALL SELECT 'pair-large', steps, 'pair' FROM f WHERE arm = 'pair' UNION ALL SELECT 'word-small', steps, 'word' FROM f WHERE arm = 'word'")
def _(spark, sf_dir):
    """Lengths that were searched, and those that arms between two of them borrow."""
    found = _runs(spark).select("arm", "steps").distinct()
    return rules.borrowed(found, {"pair-large": "pair", "word-small": "word"}, ("pair", "word"))


TRIED = {5000: (1.780, 4900), 10_000: (1.752, 9000), 20_000: (1.745, 9500)}
TRIED_SQL = "t(steps, best, best_step) AS (VALUES " + ", ".join(f"({n}, {b}::DOUBLE, {s})" for n, (b, s) in TRIED.items()) + ")"


@query("q_choose_length", f"WITH {TRIED_SQL} SELECT min(steps) AS chosen FROM t WHERE best <= (SELECT min(best) FROM t) + 0.01")
def _(spark, sf_dir):
    t = spark.createDataFrame([(n, *x) for n, x in TRIED.items()], "steps int, best double, best_step int")
    return t.crossJoin(t.agg(F.min("best").alias("lowest"))).where(F.col("best") <= F.col("lowest") + 0.01).agg(F.min("steps").alias("chosen"))


@query("q_next_length", f"WITH {TRIED_SQL} SELECT max(steps) // 2 AS next_length FROM t WHERE best_step < steps * 2 / 3 AND steps // 2 >= 625 AND steps // 2 NOT IN (SELECT steps FROM t)")
def _(spark, sf_dir):
    return rules.next_length(spark.createDataFrame([(n, *x) for n, x in TRIED.items()], "steps int, best double, best_step int"))


@query("q_verdict", "WITH v(train, held) AS (VALUES (66, 40), (44, 0), (50, 25), (50, 26), (49, 39), (49, 38), (30, 45)) SELECT train, held, CASE WHEN train >= 50 AND train >= 2 * held THEN 'recites' WHEN train < 50 AND train - held <= 10 THEN 'does not recite' ELSE 'between' END AS verdict FROM v")
def _(spark, sf_dir):
    v = spark.createDataFrame([(66, 40), (44, 0), (50, 25), (50, 26), (49, 39), (49, 38), (30, 45)], "train int, held int")
    t, h = F.col("train"), F.col("held")
    return v.withColumn("verdict", F.when((t >= 50) & (t >= 2 * h), "recites").when((t < 50) & (t - h <= 10), "does not recite").otherwise("between"))


@query("q_lr_schedule", "SELECT step, round(CASE WHEN step < 100 THEN 0.001 * (step + 1) / 100 WHEN step >= 2000 THEN 0.0001 ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(pi() * (step - 100) / 1900.0)) END, 9)::DOUBLE AS rate FROM (SELECT unnest(range(0, 2101, 50)) AS step)")
def _(spark, sf_dir):
    steps = spark.range(0, 2101, 50).withColumnRenamed("id", "step")
    return steps.select("step", F.round(rules.learning_rate(F.col("step"), 100, 2000, 0.001, 0.0001), 9).alias("rate"))


@query("q_eval_stops", "SELECT DISTINCT round_even(i * 9985 / 40.0, 0)::BIGINT AS stop FROM (SELECT unnest(range(0, 41)) AS i)")
def _(spark, sf_dir):
    return spark.range(41).select(F.bround(F.col("id") * 9985 / 40.0, 0).cast("long").alias("stop")).distinct()


@query("q_params", "SELECT width, layers, vocabulary, 12 * width * width * layers + (2 * layers + 1) * width + vocabulary * width + 256 * width AS parameters FROM (VALUES (384, 6, 98), (384, 6, 1024), (256, 4, 98)) AS v(width, layers, vocabulary)")
def _(spark, sf_dir):
    v = spark.createDataFrame([(384, 6, 98), (384, 6, 1024), (256, 4, 98)], "width int, layers int, vocabulary int")
    return v.withColumn("parameters", rules.parameters(F.col("width"), F.col("layers"), F.col("vocabulary"), F.lit(256)))


@query("q_window_plan", """WITH c AS (SELECT n AS targets, s AS stride FROM (VALUES (1), (16), (17), (100), (1000)) AS t(n), (VALUES (4), (8), (16)) AS u(s)), f AS (SELECT *, greatest((targets - 16) // stride, 0) AS fit FROM c)
    SELECT targets, stride, 0 AS begin, 0 AS first_scored FROM f UNION ALL SELECT targets, stride, i * stride, 16 - stride FROM (SELECT *, unnest(range(1, fit + 1)) AS i FROM f)
    UNION ALL SELECT targets, stride, targets - 16, (16 + fit * stride) - (targets - 16) FROM f WHERE targets > 16 AND 16 + fit * stride < targets""")
def _(spark, sf_dir):
    rows = [(n, s, b, f) for n in (1, 16, 17, 100, 1000) for s in (4, 8, 16) for b, f in rules.window_plan(n, 16, s)]
    return spark.createDataFrame(rows, "targets int, stride int, begin int, first_scored int")


@query("q_seen_slices", f"WITH {D}, n AS (SELECT sum(length(text) + 1)::BIGINT AS n FROM d WHERE \"set\" = 'train') SELECT i AS slice, floor(i * (n - 4096 // 16 - 1) / 15.0)::BIGINT AS begin, least(256, floor(i * (n - 4096 // 16 - 1) / 15.0))::BIGINT AS run_up FROM n, (SELECT unnest(range(0, 16)) AS i)")
def _(spark, sf_dir):
    n = corpus.load_set(spark, sf_dir, "train").agg(F.sum(F.length("text") + 1).alias("n"))
    begin = F.floor(F.col("slice") * (F.col("n") - 4096 // 16 - 1) / 15.0)
    return spark.range(16).withColumnRenamed("id", "slice").crossJoin(n).select("slice", begin.alias("begin"), F.least(F.lit(256).cast("long"), begin).alias("run_up"))


@query("q_random_windows", f"""WITH {D}, n AS (SELECT sum(length(text) + 1)::BIGINT AS n FROM d WHERE "set" = 'train') SELECT i AS slot, ('0x' || substr(md5('0|' || i || '|0|0'), 1, 8))::BIGINT % (n - 256) AS begin FROM n, (SELECT unnest(range(0, 64)) AS i)""")
def _(spark, sf_dir):
    n = corpus.load_set(spark, sf_dir, "train").agg(F.sum(F.length("text") + 1).alias("n"))
    rows = spark.range(64).withColumnRenamed("id", "slot").crossJoin(n)
    return rows.select("slot", selection.dice(0, F.col("slot"), F.lit(0), F.lit(0), F.col("n") - 256).alias("begin"))


@query("q_blocks", f"WITH {D} SELECT doc_id, b AS block, least(5000, length(text) - 5000 * b)::BIGINT AS n_chars FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 4999) // 5000)) AS b FROM d WHERE \"set\" = 'validation')")
def _(spark, sf_dir):
    n = F.length("text")
    v = corpus.load_set(spark, sf_dir, "validation").where(n > 0).select("doc_id", n.cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), selection.block_of(n - 1))).alias("block"))
    return v.select("doc_id", "block", F.least(F.lit(5000).cast("long"), F.col("n") - 5000 * F.col("block")).alias("n_chars"))


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, block, chars, and bits under orders 2 and 3: two arms to compare."""
    d = corpus.documents(spark, sf_dir)
    scored = ngrams.score_orders(d.where("set = 'validation'"), d.where("set = 'train'"), 3, ngrams.alphabet_size(d), "doc_id", block=selection.BLOCK)
    return scored.select("doc_id", "block", F.col("n_chars").alias("chars"), "bits2", "bits3")


def _arms_sql() -> str:
    from .texts import _model_sql

    return f"{D}, {_model_sql(3)}, b AS (SELECT doc_id, pos // 5000 AS block, count(*) AS chars, -sum(log2(p2)) AS bits2, -sum(log2(p3)) AS bits3 FROM wv JOIN p3 USING (piece) GROUP BY ALL)"


@query("q_finalists", f"WITH {_arms_sql()} SELECT round(avg(CASE WHEN bits3 < bits2 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share_better, round(sum(bits3 - bits2) / sum(chars), 6) AS difference, count(*) AS blocks FROM b")
def _(spark, sf_dir):
    got = _arms(spark, sf_dir).agg(F.avg((F.col("bits3") < F.col("bits2")).cast("double")).alias("share_better"), (F.sum(F.col("bits3") - F.col("bits2")) / F.sum("chars")).alias("difference"), F.count("*").alias("blocks"))
    return _round(got, "share_better", "difference")


@query("q_bootstrap", f"""WITH {_arms_sql()}, s AS (SELECT doc_id, chars, bits3 - bits2 AS bits, count(*) OVER (PARTITION BY doc_id) AS sides, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS slot FROM b),
    t AS (SELECT doc_id, slot, sides, unnest(range(0, 10000)) AS r FROM s), x AS (SELECT doc_id, r, ('0x' || substr(md5('0|' || r || '|' || doc_id || '|' || slot), 1, 8))::BIGINT % sides AS pick FROM t),
    q AS (SELECT r, sum(bits) / sum(chars) AS v FROM x JOIN s ON x.doc_id = s.doc_id AND x.pick = s.slot GROUP BY r) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM q""")
def _(spark, sf_dir):
    blocks = _arms(spark, sf_dir).select("doc_id", "block", "chars", (F.col("bits3") - F.col("bits2")).alias("bits"))
    return _round(selection.bootstrap(blocks, 10_000), "low", "high")
