"""Readers of documents, records, tables and lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vocab import PURPOSES, TRAITS

#: Names of essay files.
ESSAY_NAME = r"^14-2-[EM]\d-N-0[A-Z]-[A-Z]-\d+\.json$"
_LENGTHS = "len_syllable: int, len_word: int"
ESSAY = f"""essay_question struct<id: string, type: string, subject: string, topic: string, level: string, grade: string, purpose: string, prompt: string, {_LENGTHS}>,
essay_answer struct<id: bigint, region: string, gender: string, reference: string, text: string, {_LENGTHS}, feature: map<string, int>>,
score struct<personal: struct<holistic: struct<score: array<int>, feedback: string, {_LENGTHS}, min_syllable: int, total_word: int>, analytic: map<string, struct<rubric_key: string, score: array<int>, feedback: string, {_LENGTHS}>>>>,
rubric struct<type: string, purpose: string, achievement: string, analytic: map<string, map<string, string>>>, expert map<string, string>, _corrupt string"""


def essay_files(spark: SparkSession, root: str, strict: bool = False, purposes: tuple[str, ...] | None = PURPOSES, names: str | None = ESSAY_NAME) -> DataFrame:
    """Nested essays of all JSON files below ``root``, with their source_path.

    Only files whose name fits ``names`` count (None: all ``.json``).  A malformed file is left out,
    or raises in ``strict`` mode.  The purpose is filtered after parsing; None keeps all.
    """
    reader = spark.read.schema(ESSAY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    reader = reader.option("mode", "FAILFAST") if strict else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    df = reader.json(root).select("*", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("_name"))
    if names:
        df = df.where(F.col("_name").rlike(names))
    if not strict:
        df = df.where("_corrupt IS NULL AND essay_question IS NOT NULL AND essay_answer IS NOT NULL")
    if purposes:
        df = df.where(F.col("essay_question.purpose").isin(list(purposes)))
    return df.drop("_corrupt", "_name")


def essay_problems(df: DataFrame, strict_traits: bool = True) -> DataFrame:
    """essay_id and problem of the essays that break the format, the first problem each.

    Every trait needs two scores; the rubric's purpose may differ (a warning) from the question's.
    """
    a = F.col("score.personal.analytic")
    checks = [F.when(F.size("score.personal.holistic.score") < 2, "holistic: fewer than two scores")]
    for t in TRAITS:
        if strict_traits:
            checks.append(F.when(a[t].isNull(), f"{t}: missing"))
        checks.append(F.when(a[t].isNotNull() & (F.coalesce(F.size(a[t]["score"]), F.lit(0)) < 2), f"{t}: fewer than two scores"))
    checks.append(F.when(F.col("rubric.purpose") != F.col("essay_question.purpose"), "warning: purposes differ"))
    return df.select(F.col("essay_answer.id").alias("essay_id"), F.coalesce(*checks).alias("problem")).where("problem IS NOT NULL")


def long_scores(df: DataFrame) -> DataFrame:
    """One row by essay and trait, and one for the holistic score; a missing trait has NULLs.

    ``trait_present`` is NULL for the holistic row, which has no such flag.
    """
    q, s = F.col("essay_question"), F.col("essay_answer")
    base = [
        s["id"].alias("essay_id"), q["grade"].alias("grade"), q["subject"].alias("subject"), q["topic"].alias("topic"), q["level"].alias("level"), q["purpose"].alias("purpose"),
        s["region"].alias("region"), s["gender"].alias("gender"), s["reference"].alias("reference"), s["len_syllable"].alias("len_syllable"), s["len_word"].alias("len_word"),
    ]
    a, h = F.col("score.personal.analytic"), F.col("score.personal.holistic")
    entry = lambda t: F.struct(F.lit(t).alias("trait"), a[t]["rubric_key"].alias("rubric_key"), a[t]["score"].alias("score"), a[t]["feedback"].alias("feedback"), a[t].isNotNull().alias("trait_present"))
    rows = [entry(t) for t in TRAITS] + [F.struct(F.lit("_holistic").alias("trait"), F.lit(None).cast("string").alias("rubric_key"), h["score"].alias("score"), h["feedback"].alias("feedback"), F.lit(None).cast("boolean").alias("trait_present"))]
    e = df.select(*base, F.inline(F.array(*rows)))
    r1, r2 = F.get("score", 0), F.get("score", 1)
    return e.select(*[c for c in e.columns if c not in ("score", "feedback", "trait_present")], r1.alias("score_rater1"), r2.alias("score_rater2"), ((r1 + r2) / 2).alias("score_mean"), (r1 == r2).alias("exact_agreement"), F.coalesce(F.char_length("feedback"), F.lit(0)).alias("feedback_len"), "feedback", "trait_present")


def jsonl(spark: SparkSession, path: str, schema: str, drop_malformed: bool = True) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, malformed ones dropped or raised.

    A path without files gives an empty table of the same schema.
    """
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_malformed else "FAILFAST").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def repeated_runs(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Records of several runs with their run_id (from 1, by place); runs without files are skipped."""
    out = None
    for i, p in enumerate(paths, 1):
        d = jsonl(spark, p, schema).withColumn("run_id", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out


def table_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet or CSV table by its suffix; in CSV only the empty field is NULL, ``NA`` is a value."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith(".csv"):
        r = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "").option("multiLine", True).option("escape", '"')
        return r.schema(schema).csv(path) if schema else r.csv(path)
    raise ValueError(f"neither .parquet nor .csv: {path}")


def required(df: DataFrame, columns: list[str], hint: str = "") -> DataFrame:
    """``df``, or KeyError naming the columns that it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}. {hint}".strip())
    return df


def optional_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table file, or an empty table of the schema where there is none, so that plans keep their shape."""
    try:
        return table_file(spark, path, schema)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def coder_file(spark: SparkSession, path: str, flag: str) -> DataFrame:
    """A coder's sheet: essay_id, trait, family, ``flag`` as a strict boolean."""
    from tessera.functions.rules import strict_bool

    df = required(table_file(spark, path), ["essay_id", "trait", "family", flag], "Is it the coder's sheet?")
    return df.withColumn("essay_id", F.col("essay_id").cast("bigint")).withColumn(flag, strict_bool(F.col(flag)))


def partition_keys(path: Column) -> list[Column]:
    """purpose and embedding from names like ``feature_matrix__<purpose>__<embedding>``; NULL where they don't fit."""
    pattern = r"feature_matrix__([^_/]+(?:_[^_/]+)*)__([^./]+)"
    part = lambda i: F.when(path.rlike(pattern), F.regexp_extract(path, pattern, i))
    return [part(1).alias("purpose"), part(2).alias("embedding")]


def call_id(essay_id: Column, stage: Column, repeat: Column) -> Column:
    """The custom id of a call."""
    return F.concat_ws("_", F.concat(F.lit("e"), essay_id.cast("string")), stage, repeat.cast("string"))


def call_parts(custom: Column) -> Column:
    """essay_id, stage and repeat of a custom id; NULL where it is none."""
    p = F.split(custom, "_")
    ok = custom.rlike(r"^e\d+_[^_]+_\d+$")
    return F.when(ok, F.struct(F.substring(F.get(p, 0), 2, 20).cast("bigint").alias("essay_id"), F.get(p, 1).alias("stage"), F.get(p, 2).cast("int").alias("repeat")))


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
