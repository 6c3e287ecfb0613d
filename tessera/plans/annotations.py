"""Annotation records, made of the rating tables as JSON text, and the log of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import annotations as A
from tessera.functions.vocab import PURPOSES, TRAITS
from tessera.plans.ratings import RATINGS, r6, ratings
from tessera.session import table


def score_records(spark: SparkSession, sf_dir: str, rater: str = "score_rater1") -> DataFrame:
    """essay_id and record: a scoring record by essay of round 1, as JSON text, with the data's defects.

    A missing score has the reason that it is insufficient where there is feedback, else none.
    """
    r = ratings(spark, sf_dir).where("rating_round = 1").where(F.col("trait").isin(list(TRAITS)))
    reason = F.when(F.col(rater).isNull() & F.col("feedback").isNotNull(), F.lit("insufficient_evidence"))
    entry = F.struct(F.col(rater).alias("score"), (F.col("essay_id") % 11 / 10).alias("confidence"), F.array(F.col("essay_id") % 3).alias("span_refs"), reason.alias("reason"))
    g = r.groupBy("essay_id").agg(F.max("purpose").alias("purpose"), F.map_from_entries(F.collect_list(F.struct("trait", entry))).alias("scores"))  # at most eight traits
    return g.select("essay_id", F.to_json(F.struct("essay_id", "purpose", "scores"), {"ignoreNullFields": "false"}).alias("record"))


def score_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by their first violation; NULL are the valid ones."""
    s = score_records(spark, sf_dir).withColumn("violation", A.score_violation(A.variant(F.col("record"))))
    return s.groupBy("violation").agg(F.count("*").alias("n_records"), F.min("essay_id").alias("first_essay"))


def _violation_sql() -> str:
    cases = ["WHEN NOT coalesce(purpose IN (" + ", ".join(f"'{p}'" for p in PURPOSES) + "), false) THEN 'bad purpose'"]
    for t in TRAITS:
        cases += [
            f"WHEN n_{t} = 0 THEN 'scores missing trait {t}'",
            f"WHEN s_{t} IS NULL AND f_{t} IS NULL THEN 'scores.{t}: null score requires a reason'",
            f"WHEN s_{t} NOT BETWEEN 1 AND 5 THEN 'scores.{t}.score out of range'",
        ]
    return "CASE " + " ".join(cases) + " END"


def score_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records in long form again."""
    return A.long_scores(score_records(spark, sf_dir), ["essay_id"], "record").withColumn("confidence", F.round("confidence", 3))


def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of missing scores by trait, and whether it stays below a fifth."""
    l = A.long_scores(score_records(spark, sf_dir), ["essay_id"], "record")
    rate = F.avg(F.col("is_na").cast("double"))
    return l.groupBy("trait").agg(F.count("*").alias("n"), F.sum(F.col("is_na").cast("bigint")).alias("n_null"), r6(rate).alias("null_rate"), (rate < 0.20).alias("axis_c_pass"))


def rerun_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the records, matched by essay and trait; two missing scores match."""
    a = A.long_scores(score_records(spark, sf_dir), ["essay_id"], "record").select("essay_id", "trait", F.col("score").alias("x"))
    b = A.long_scores(score_records(spark, sf_dir, "score_rater2"), ["essay_id"], "record").select("essay_id", "trait", F.col("score").alias("y"))
    j = a.join(b, ["essay_id", "trait"])
    same = F.col("x").eqNullSafe(F.col("y")).cast("bigint")
    n, m = F.count("*"), F.sum(same)
    return j.agg(F.count_distinct("essay_id").alias("n_essays_compared"), n.alias("n_trait_decisions"), m.alias("n_matches"), r6(m / n).alias("trait_match_rate"), (m / n >= 0.95).alias("axis_e_pass"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as attempts: a user is an essay, the remainder of value a stage, time orders."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    return e.select(F.col("user_id").alias("essay_id"), F.concat(F.lit("s"), (F.floor("value") % 3).cast("string")).alias("stage"), "event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")


ATT = "att AS (SELECT user_id AS essay_id, 's' || (floor(value)::BIGINT % 3) AS stage, event_id, ts, event_type, json_extract(props, '$.k')::INT AS k, value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"


def latest_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last attempt of every call, with the number of attempts."""
    a = attempts(spark, sf_dir).where("stage IS NOT NULL")
    return a.groupBy("essay_id", "stage").agg(F.count("*").alias("n_attempts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("final_kind"), F.max_by("event_id", F.struct("ts", "event_id")).alias("final_event"))


def unresolved_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that failed and never succeeded, by stage: purchases count as successes."""
    a = attempts(spark, sf_dir).where("stage IS NOT NULL")
    ok = a.where("event_type = 'purchase'").select("essay_id", "stage").distinct()
    err = a.where("event_type = 'error'").groupBy("essay_id", "stage").agg(F.max_by("k", F.struct("ts", "event_id")).alias("final_k"))
    u = err.join(ok, ["essay_id", "stage"], "left_anti")
    kind = F.when(F.col("final_k") < 3, "schema").when(F.col("final_k") < 7, "validator").otherwise("api")
    return u.groupBy("stage", kind.alias("kind")).agg(F.count("*").alias("n_calls"))


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by stage against an estimate, and the relative deviation."""
    g = attempts(spark, sf_dir).where("stage IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n_calls"), F.avg("value").alias("m"))
    est = F.lit(50.0)
    dev = F.abs(F.col("m") - est) / F.greatest(est, F.lit(1.0))
    return g.select("stage", "n_calls", r6(F.col("m")).alias("mean_tokens"), r6(dev).alias("relative_deviation"), (dev <= 0.5).alias("axis_d_pass"))


def pending_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls still to make: all essays by all stages, less those done."""
    a = attempts(spark, sf_dir)
    stages = F.explode(F.array(*[F.lit(f"s{i}") for i in range(3)])).alias("stage")
    todo = a.select("essay_id").distinct().select("essay_id", stages)
    done = a.where("event_type = 'purchase'").select("essay_id", "stage")
    return todo.join(done, ["essay_id", "stage"], "left_anti")


def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essays that were submitted (signup) and not retrieved since (purchase)."""
    a = attempts(spark, sf_dir)
    when = lambda k: F.max(F.when(F.col("event_type") == k, F.struct("ts", "event_id")))
    g = a.groupBy("essay_id").agg(when("signup").alias("s"), when("purchase").alias("p"))
    return g.where("s IS NOT NULL AND (p IS NULL OR s > p)").select("essay_id", F.col("s.event_id").alias("submit_event"))


def prior_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call of the second stage with the last record of the first; without one it is left out."""
    a = attempts(spark, sf_dir)
    first = a.where("stage = 's0'").groupBy("essay_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("prior_event"), F.max_by("k", F.struct("ts", "event_id")).alias("prior_k"))
    return a.where("stage = 's1'").select("essay_id", "event_id").join(first, "essay_id")


def span_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of essays with shifted offsets, put back where they stand."""
    e = table(spark, sf_dir, "essays").where("essay_id IS NOT NULL AND char_length(text) >= 40").groupBy("essay_id").agg(F.max("text").alias("text"))
    e = e.select("essay_id", "text", F.substring("text", 11, 20).alias("excerpt"), F.lit(3).alias("start"), F.lit(9).alias("end"))
    s = e.withColumn("span", A.repaired_span(F.col("text"), F.col("start"), F.col("end"), A.find_excerpt(F.col("text"), F.col("excerpt"))))
    return s.select("essay_id", F.get("span", 0).alias("span_start"), F.get("span", 1).alias("span_end"))


QUERIES = {
    "score_validation": score_validation,
    "score_long": score_long,
    "null_rates": null_rates,
    "rerun_consistency": rerun_consistency,
    "latest_attempts": latest_attempts,
    "unresolved_errors": unresolved_errors,
    "token_usage": token_usage,
    "pending_calls": pending_calls,
    "in_flight": in_flight,
    "prior_stage": prior_stage,
    "span_repair": span_repair,
}

_ROUND1 = f"{RATINGS}, r AS (SELECT * FROM ratings WHERE rating_round = 1 AND trait IN ({', '.join(f'''{t!r}''' for t in TRAITS)}))"
SQL = {
    "score_validation": f"""WITH {_ROUND1}, g AS (SELECT essay_id, max(purpose) AS purpose, {', '.join(f"count(*) FILTER (WHERE trait = '{t}') AS n_{t}, max(score_rater1) FILTER (WHERE trait = '{t}') AS s_{t}, max(feedback) FILTER (WHERE trait = '{t}') AS f_{t}" for t in TRAITS)} FROM r GROUP BY essay_id), v AS (SELECT essay_id, {_violation_sql()} AS violation FROM g)
SELECT violation, count(*) AS n_records, min(essay_id) AS first_essay FROM v GROUP BY violation""",
    "score_long": f"WITH {_ROUND1} SELECT essay_id, trait, score_rater1 AS score, round(essay_id % 11 / 10.0, 3)::DOUBLE AS confidence, CASE WHEN score_rater1 IS NULL AND feedback IS NOT NULL THEN 'insufficient_evidence' END AS reason, score_rater1 IS NULL AS is_na FROM r",
    "null_rates": f"WITH {_ROUND1} SELECT trait, count(*) AS n, sum((score_rater1 IS NULL)::INT)::BIGINT AS n_null, round(avg((score_rater1 IS NULL)::INT), 6) AS null_rate, avg((score_rater1 IS NULL)::INT) < 0.2 AS axis_c_pass FROM r GROUP BY trait",
    "rerun_consistency": f"WITH {_ROUND1} SELECT count(DISTINCT essay_id) AS n_essays_compared, count(*) AS n_trait_decisions, sum((score_rater1 IS NOT DISTINCT FROM score_rater2)::INT)::BIGINT AS n_matches, round(avg((score_rater1 IS NOT DISTINCT FROM score_rater2)::INT), 6) AS trait_match_rate, avg((score_rater1 IS NOT DISTINCT FROM score_rater2)::INT) >= 0.95 AS axis_e_pass FROM r",
    "latest_attempts": f"WITH {ATT}, k AS (SELECT *, count(*) OVER (PARTITION BY essay_id, stage) AS n, row_number() OVER (PARTITION BY essay_id, stage ORDER BY ts DESC, event_id DESC) AS j FROM att WHERE stage IS NOT NULL) SELECT essay_id, stage, n AS n_attempts, event_type AS final_kind, event_id AS final_event FROM k WHERE j = 1",
    "unresolved_errors": f"""WITH {ATT}, e AS (SELECT *, row_number() OVER (PARTITION BY essay_id, stage ORDER BY ts DESC, event_id DESC) AS j FROM att WHERE event_type = 'error' AND stage IS NOT NULL)
SELECT stage, CASE WHEN k < 3 THEN 'schema' WHEN k < 7 THEN 'validator' ELSE 'api' END AS kind, count(*) AS n_calls FROM e WHERE j = 1 AND NOT EXISTS (SELECT 1 FROM att a WHERE a.event_type = 'purchase' AND a.essay_id = e.essay_id AND a.stage = e.stage) GROUP BY ALL""",
    "token_usage": f"WITH {ATT} SELECT stage, count(*) AS n_calls, round(avg(value), 6) AS mean_tokens, round(abs(avg(value) - 50) / 50, 6) AS relative_deviation, abs(avg(value) - 50) / 50 <= 0.5 AS axis_d_pass FROM att WHERE stage IS NOT NULL GROUP BY stage",
    "pending_calls": f"WITH {ATT}, t AS (SELECT essay_id, unnest(['s0', 's1', 's2']) AS stage FROM (SELECT DISTINCT essay_id FROM att)) SELECT essay_id, stage FROM t WHERE NOT EXISTS (SELECT 1 FROM att a WHERE a.event_type = 'purchase' AND a.essay_id = t.essay_id AND a.stage = t.stage)",
    "in_flight": f"""WITH {ATT}, g AS (SELECT essay_id, max(ts) FILTER (WHERE event_type = 'signup') AS s, arg_max(event_id, ts) FILTER (WHERE event_type = 'signup') AS ev, max(ts) FILTER (WHERE event_type = 'purchase') AS p FROM att GROUP BY essay_id) SELECT essay_id, ev AS submit_event FROM g WHERE s IS NOT NULL AND (p IS NULL OR s > p)""",
    "prior_stage": f"WITH {ATT}, f AS (SELECT *, row_number() OVER (PARTITION BY essay_id ORDER BY ts DESC, event_id DESC) AS j FROM att WHERE stage = 's0') SELECT a.essay_id, a.event_id, f.event_id AS prior_event, f.k AS prior_k FROM att a JOIN f ON f.essay_id = a.essay_id AND f.j = 1 WHERE a.stage = 's1'",
    "span_repair": "WITH e AS (SELECT essay_id, max(text) AS text FROM essays WHERE essay_id IS NOT NULL AND length(text) >= 40 GROUP BY essay_id) SELECT essay_id, (instr(text, text[11:30]) - 1)::INT AS span_start, (instr(text, text[11:30]) + 19)::INT AS span_end FROM e",
}
