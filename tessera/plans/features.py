"""Feature extraction: one row by essay, all families of columns from one scan."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T
from tessera.functions.sets import pipe
from tessera.functions.vocab import CASE_TAGS, FAMILY_KEYWORDS, MORPH_TAGS, POS_FAMILIES, SENTENCES
from tessera.plans.ratings import RATINGS, latest, r6, ratings
from tessera.session import table

ESSAY_ORDER = ["received_at", "written_at", "prompt_id", "source", "region", "gender", "reference", "author_id"]


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each essay once, as delivered last; maps can't be compared and follow their row."""
    cols = ["essay_id", "text", "len_syllable", "len_word", "feature", *ESSAY_ORDER]
    return latest(table(spark, sf_dir, "essays").select(*cols), ["essay_id"], ESSAY_ORDER)


ESSAYS = f"""e0 AS (SELECT *, row_number() OVER (PARTITION BY essay_id ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in ESSAY_ORDER)}) AS k FROM essays WHERE essay_id IS NOT NULL), e AS (SELECT * FROM e0 WHERE k = 1)"""


def tag(name: str) -> Column:
    return F.coalesce(F.col("feature")[name], F.lit(0))


def tag_sum(names) -> Column:
    return sum((tag(n) for n in names), F.lit(0))


def at_least_1(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(F.lit(1))


def meta_columns() -> dict[str, Column]:
    n = tag(SENTENCES)
    syl, word = F.coalesce("len_syllable", F.lit(0)), F.coalesce("len_word", F.lit(0))
    per = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    return {"meta_syllables": syl.cast("double"), "meta_words": word.cast("double"), "meta_sentences": n.cast("double"), "meta_syllables_per_sentence": per(syl), "meta_words_per_sentence": per(word)}


def total_tags() -> Column:
    """All tags of the essay but the count of sentences, also those outside the vocabulary."""
    return F.coalesce(F.aggregate(F.map_values("feature"), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) - tag(SENTENCES), F.lit(0))


def morph_columns() -> dict[str, Column]:
    n = F.col("_total")
    return {f"morph_prop__{i:02d}": F.when(n > 0, tag(t) / n).otherwise(F.lit(0.0)) for i, t in enumerate(MORPH_TAGS[:-1])}


def lexical_columns() -> dict[str, Column]:
    toks = T.words(F.col("text"))
    types = F.size(F.array_distinct(toks))
    sums = [tag_sum(v).cast("double") for v in POS_FAMILIES.values()]
    all_ = sum(sums, F.lit(0.0))
    entropy = sum((F.when(s > 0, -(s / all_) * F.log2(s / all_)).otherwise(F.lit(0.0)) for s in sums), F.lit(0.0))
    return {"lex_ttr": F.when(F.size(toks) > 0, types / F.size(toks)).otherwise(F.lit(0.0)), "lex_types": types.cast("double"), "lex_pos_entropy": F.when(all_ > 0, entropy).otherwise(F.lit(0.0))}


def syntax_columns() -> dict[str, Column]:
    n, m, w = at_least_1(tag(SENTENCES)), at_least_1(F.col("_total")), at_least_1(F.coalesce("len_word", F.lit(0)))
    s = {k: tag_sum(v) for k, v in POS_FAMILIES.items()}
    return {
        "syn_connective_per_sentence": s["connective_ending"] / n, "syn_final_per_sentence": s["final_ending"] / n, "syn_adnominal_ratio": s["adnominal_ending"] / m,
        "syn_verb_ratio": s["verb"] / m, "syn_adjective_ratio": s["adjective"] / m, "syn_noun_ratio": s["noun"] / m,
        "dis_connective_adverb_per_sentence": tag("접속 부사") / n, "dis_pronoun_density": s["pronoun"] / w, "dis_conjunctive_particle_per_sentence": tag("접속 조사") / n,
    }


def case_columns() -> dict[str, Column]:
    counts = {k: tag(t) for k, t in CASE_TAGS.items()}
    n = sum(counts.values(), F.lit(0))
    out = {f"josa_{k}_count": c.cast("double") for k, c in counts.items()} | {"josa_total_count": n.cast("double")}
    out |= {f"josa_{k}_ratio": F.when(n > 0, c / n).otherwise(F.lit(0.0)) for k, c in counts.items()}
    return out | {"case_diversity": sum(((c > 0).cast("double") for c in counts.values()), F.lit(0.0))}


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features that need no analyser, encoder or lexicon, by essay.

    An essay without a tag map has NULL in the families made of tags, not zeros.
    """
    e = essays(spark, sf_dir).withColumn("_total", total_tags())
    has = F.col("feature").isNotNull()
    tagged = morph_columns() | syntax_columns() | case_columns()
    meta, lex = meta_columns(), lexical_columns()
    lex["lex_pos_entropy"] = F.when(has, lex["lex_pos_entropy"])
    cols = meta | {k: F.when(has, c) for k, c in tagged.items()} | lex
    return e.select("essay_id", *[r6(c).alias(k) for k, c in cols.items()])


def _tag_sql(t: str) -> str:
    return f"coalesce(feature['{t}'], 0)"


def _sum_sql(names) -> str:
    return "(" + " + ".join(map(_tag_sql, names)) + ")"


def _parts_sql() -> dict[str, dict[str, str]]:
    """The SQL of each feature by family."""
    s = {k: _sum_sql(v) for k, v in POS_FAMILIES.items()}
    n = f"CASE WHEN {_tag_sql(SENTENCES)} > 0 THEN {_tag_sql(SENTENCES)} ELSE 1 END"
    m, w = "CASE WHEN total > 0 THEN total ELSE 1 END", "CASE WHEN coalesce(len_word, 0) > 0 THEN len_word ELSE 1 END"
    ns = _tag_sql(SENTENCES)
    all_ = "(" + " + ".join(s.values()) + ")"
    meta = {"meta_syllables": "coalesce(len_syllable, 0)", "meta_words": "coalesce(len_word, 0)", "meta_sentences": ns, "meta_syllables_per_sentence": f"CASE WHEN {ns} > 0 THEN coalesce(len_syllable, 0) / {ns}::DOUBLE ELSE 0 END", "meta_words_per_sentence": f"CASE WHEN {ns} > 0 THEN coalesce(len_word, 0) / {ns}::DOUBLE ELSE 0 END"}
    morph = {f"morph_prop__{i:02d}": f"CASE WHEN total > 0 THEN {_tag_sql(t)} / total::DOUBLE ELSE 0 END" for i, t in enumerate(MORPH_TAGS[:-1])}
    syn = {
        "syn_connective_per_sentence": f"{s['connective_ending']} / ({n})::DOUBLE", "syn_final_per_sentence": f"{s['final_ending']} / ({n})::DOUBLE", "syn_adnominal_ratio": f"{s['adnominal_ending']} / ({m})::DOUBLE",
        "syn_verb_ratio": f"{s['verb']} / ({m})::DOUBLE", "syn_adjective_ratio": f"{s['adjective']} / ({m})::DOUBLE", "syn_noun_ratio": f"{s['noun']} / ({m})::DOUBLE",
    }
    dis = {
        "dis_connective_adverb_per_sentence": f"{_tag_sql('접속 부사')} / ({n})::DOUBLE", "dis_pronoun_density": f"{s['pronoun']} / ({w})::DOUBLE", "dis_conjunctive_particle_per_sentence": f"{_tag_sql('접속 조사')} / ({n})::DOUBLE",
    }
    josa = _sum_sql(CASE_TAGS.values())
    case = {f"josa_{k}_count": _tag_sql(t) for k, t in CASE_TAGS.items()} | {"josa_total_count": josa}
    case |= {f"josa_{k}_ratio": f"CASE WHEN {josa} > 0 THEN {_tag_sql(t)} / {josa}::DOUBLE ELSE 0 END" for k, t in CASE_TAGS.items()}
    case["case_diversity"] = " + ".join(f"({_tag_sql(t)} > 0)::INT" for t in CASE_TAGS.values())
    entropy = " + ".join(f"CASE WHEN {x} > 0 THEN -({x} / {all_}::DOUBLE) * log2({x} / {all_}::DOUBLE) ELSE 0 END" for x in s.values())
    tagged = lambda cols: {k: f"CASE WHEN feature IS NOT NULL THEN {c} END" for k, c in cols.items()}
    lex = tagged({"lex_pos_entropy": f"CASE WHEN {all_} > 0 THEN {entropy} ELSE 0 END"})
    lex |= {"lex_ttr": "CASE WHEN len(toks) > 0 THEN len(list_distinct(toks)) / len(toks)::DOUBLE ELSE 0 END", "lex_types": "len(list_distinct(toks))"}
    return {"meta": meta, "morph_prop": tagged(morph), "lex": lex, "case_marker": tagged(case), "syn": tagged(syn), "dis_nonSBERT": tagged(dis)}


VOCAB = (*(f"vocab_grade_{k}_ratio" for k in range(1, 6)), "vocab_out_of_grade_ratio", "vocab_grade_mean", "vocab_graded_count")
COHERENCE = ("coh_adjacent_mean", "coh_adjacent_std", "coh_adjacent_min", "coh_all_mean")
#: The family of every feature, by what makes it.
FAMILY_OF = {c: f for f, cols in _parts_sql().items() for c in cols} | dict.fromkeys(VOCAB, "vocab_grade") | dict.fromkeys(COHERENCE, "dis_SBERT")


def _matrix_sql() -> str:
    cols = {k: c for part in _parts_sql().values() for k, c in part.items()}
    ns = _tag_sql(SENTENCES)
    return f"""WITH {ESSAYS}, t AS (SELECT *, coalesce(list_sum(map_values(feature)) - {ns}, 0)::BIGINT AS total, list_filter(string_split_regex(coalesce(text, ''), '[\\s\\x{{0b}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '') AS toks FROM e)
SELECT essay_id, {', '.join(f'round(({c})::DOUBLE, 6) AS {k}' for k, c in cols.items())} FROM t"""


def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By feature: its family, count, NULLs, mean, deviation, least and most."""
    m = feature_matrix(spark, sf_dir)
    names = m.columns[1:]
    long = m.unpivot(["essay_id"], names, "feature", "value")
    fam = F.create_map(*[F.lit(x) for c in names for x in (c, FAMILY_OF[c])])
    v = F.col("value")
    g = long.groupBy("feature").agg(F.count(v).alias("n"), F.sum(v.isNull().cast("bigint")).alias("n_null"), F.round(F.avg(v), 5).alias("mean"), F.round(F.stddev_samp(v), 5).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return g.withColumn("family", fam[F.col("feature")])


def _summary_sql() -> str:
    m = _matrix_sql()
    names = [x.rsplit(" AS ", 1)[1] for x in m.rsplit("SELECT essay_id, ", 1)[1].rsplit(" FROM t", 1)[0].split(", round(")]
    fam = "CASE feature " + " ".join(f"WHEN '{c}' THEN '{FAMILY_OF[c]}'" for c in names) + " END"
    return f"""WITH m AS ({m}), u AS (SELECT * FROM m UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(names)})))
SELECT feature, count(value) AS n, sum((value IS NULL)::INT)::BIGINT AS n_null, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS min, max(value) AS max, {fam} AS family FROM u GROUP BY feature"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word and grade (1-5) from a raw list of (grade text, word): the least grade of each word.

    The documents' words stand for the list, graded by length; grades off the scale are dropped.
    """
    raw = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).withColumn("grade", F.concat((1 + F.char_length("word") % 7).cast("string"), F.lit("등급")))
    return clean_lexicon(raw)


def clean_lexicon(raw: DataFrame) -> DataFrame:
    """The least grade of each trimmed word whose grade text is a number from 1 to 5 with a suffix."""
    g = F.expr("try_cast(regexp_replace(trim(grade), '(등급|학년)$', '') AS int)")
    return raw.select(F.trim("word").alias("word"), g.alias("grade")).where("grade BETWEEN 1 AND 5 AND word <> ''").groupBy("word").agg(F.min("grade").alias("grade"))


def vocab_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of each essay's words: shares by grade, share without grade, mean grade, graded count.

    Words are counted within the essay before they meet the lexicon.
    """
    w = essays(spark, sf_dir).select("essay_id", F.explode_outer(T.tokens(F.col("text"))).alias("word")).groupBy("essay_id", "word").agg(F.count("word").alias("n"))
    j = w.join(lexicon(spark, sf_dir), "word", "left")
    n, g = F.col("n"), F.col("grade")
    total, graded = F.sum("n"), F.sum(F.when(g.isNotNull(), n).otherwise(0))
    per = lambda c: r6(F.when(total > 0, c / total).otherwise(F.lit(0.0)))
    cols = [per(F.sum(F.when(g == k, n).otherwise(0))).alias(f"vocab_grade_{k}_ratio") for k in range(1, 6)]
    mean = F.when(graded > 0, F.sum(F.when(g.isNotNull(), n * g).otherwise(0)) / graded).otherwise(F.lit(0.0))
    return j.groupBy("essay_id").agg(*cols, per(F.sum(F.when(g.isNull(), n).otherwise(0))).alias("vocab_out_of_grade_ratio"), r6(mean).alias("vocab_grade_mean"), graded.alias("vocab_graded_count"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents, sentences by end marks, words and their means."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", F.size(T.sentences(F.translate(F.col("text"), "　", " "))).alias("s"), F.size(T.tokens(F.col("text"))).alias("t"))
    return d.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("s").alias("n_sentences"), F.sum("t").alias("n_tokens"), r6(F.avg("s")).alias("mean_sentences"))


def feedback_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families that each round-1 feedback names, by exact token sequences."""
    t = ratings(spark, sf_dir).where("rating_round = 1 AND trim(feedback) <> ''").select("essay_id", "trait", T.tokens(F.col("feedback")).alias("t"))
    f = t.select("essay_id", "trait", F.size("t").alias("n_tokens"), T.families(F.col("t")).alias("f"))
    return f.select("essay_id", "trait", "n_tokens", pipe(F.col("f")).alias("llm_families"), F.size("f").alias("n_families"))


def _families_sql() -> str:
    def seq(k):
        if len(k) == 1:
            return f"list_contains(t, '{k[0]}')"
        at = " AND ".join(f"t[i + {x}] = '{w}'" for x, w in enumerate(k))
        return f"len(list_filter(range(1, len(t) - {len(k) - 2}), lambda i: {at})) > 0"

    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(map(seq, ks))} THEN '{f}' END" for f, ks in FAMILY_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"


def owners(claims: DataFrame, keyword: str, owner: str) -> DataFrame:
    """``keyword``, n_owners and owners of the keywords that more than one owner claims."""
    kept = claims.where(F.col(keyword).isNotNull() & F.col(owner).isNotNull()).select(keyword, owner).distinct()
    return kept.groupBy(keyword).agg(F.count("*").alias("n_owners"), pipe(F.array_sort(F.collect_set(owner))).alias("owners")).where("n_owners > 1")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_sums(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and total, the sum of its vectors: summed by numpy within each batch, then once more."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys, at = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                rows = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
                total = np.zeros((len(keys), rows.shape[1]))
                np.add.at(total, at, rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys).cast(b.schema.field(0).type), pa.array(list(total), pa.list_(pa.float64()))], names=[key, "total"])

    parts = df.select(key, F.col(vector).cast("array<double>").alias("_v")).mapInArrow(run, f"`{key}` {kind}, total array<double>")
    # a batch leaves one row a key, so few vectors meet here
    return parts.groupBy(key).agg(F.collect_list("total").alias("_t")).select(key, F.aggregate(F.slice("_t", 2, 1 << 30), F.get("_t", 0), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("total"))


def hashed_vectors(sentences: pd.Series, size: int = 64) -> pd.Series:
    """A vector of each sentence's character trigrams, hashed: the encoder where none is given."""
    def one(t: str) -> list[float]:
        v = np.zeros(size)
        for i in range(max(1, len(t) - 2)):
            v[zlib.crc32(t[i : i + 3].encode("utf-8", "surrogatepass")) % size] += 1
        return v.tolist()

    return sentences.map(one)


def essay_coherence(spark: SparkSession, sf_dir: str, encode=hashed_vectors) -> DataFrame:
    """Coherence of each essay's sentences: divided, encoded batch by batch, aggregated by essay.

    Essays without sentences have no row.
    """
    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield encode(s)

    s = essays(spark, sf_dir).select("essay_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence"))
    return coherence(s.select("essay_id", "at", vectors("sentence").alias("v")), "essay_id", "at", "v").drop("n_sentences")


def all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of all eight families by essay: the matrix with vocabulary grades and coherence joined to it."""
    m = feature_matrix(spark, sf_dir).join(vocab_features(spark, sf_dir).withColumn("vocab_graded_count", F.col("vocab_graded_count").cast("double")), "essay_id", "left")
    return m.join(essay_coherence(spark, sf_dir), "essay_id", "left")


def coherence(df: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """By ``key``: mean, population deviation and least of adjacent cosines, and mean of all pairs'.

    All pairs follow from the sum of the unit vectors, so none are made; zero vectors have cosine 0
    to any other.  Fewer than two vectors give zeros.
    """
    v = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, order, F.col(vector).alias("v"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("norm"))
    v = v.select(key, order, F.when(F.col("norm") > 0, F.transform("v", lambda x: x.cast("double") / F.col("norm"))).otherwise(F.transform("v", lambda x: F.lit(0.0))).alias("u"), (F.col("norm") > 0).cast("bigint").alias("nz"))
    w = W.partitionBy(key).orderBy(order)
    adjacent = v.withColumn("p", F.lag("u").over(w)).withColumn("c", dot(F.col("u"), F.col("p")))
    a = adjacent.groupBy(key).agg(F.count("*").alias("n"), F.sum("nz").alias("nz"), F.avg("c").alias("m"), F.stddev_pop("c").alias("s"), F.min("c").alias("least"))
    sums = vector_sums(v.select(key, "u"), key, "u").select(key, dot(F.col("total"), F.col("total")).alias("q"))
    n = F.col("n")
    some = lambda c: F.when(n > 1, c).otherwise(F.lit(0.0))
    j = a.join(sums, key)
    return j.select(key, n.alias("n_sentences"), r6(some(F.col("m"))).alias("coh_adjacent_mean"), r6(some(F.col("s"))).alias("coh_adjacent_std"), r6(some(F.col("least"))).alias("coh_adjacent_min"), r6(some((F.col("q") - F.col("nz")) / (n * (n - 1)))).alias("coh_all_mean"))


def coherence_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of every document's text, its slugged source and a shortened preview."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), T.slug(F.concat_ws(" ", "source", "purpose")).alias("slug"), T.shortened(F.col("text"), 40).alias("preview"))


QUERIES = {
    "feature_matrix": feature_matrix,
    "feature_summary": feature_summary,
    "vocab_features": vocab_features,
    "sentence_stats": sentence_stats,
    "feedback_families": feedback_families,
    "coherence_by_label": coherence_by_label,
    "essay_coherence": essay_coherence,
    "all_features": all_features,
    "text_digests": text_digests,
}

_TOKENS = "list_transform(regexp_extract_all(coalesce({0}, ''), '([0-9A-Za-z가-힣]+)'), lambda x: lower(x))"
SQL = {
    "feature_matrix": _matrix_sql(),
    "feature_summary": _summary_sql(),
    "vocab_features": f"""WITH {ESSAYS}, lx AS (SELECT w AS word, min(1 + length(w) % 7) AS grade FROM (SELECT unnest({_TOKENS.format('text')}) AS w FROM documents) WHERE 1 + length(w) % 7 <= 5 GROUP BY w),
t AS (SELECT essay_id, unnest({_TOKENS.format('text')}) AS word FROM e), j AS (SELECT essay_id, t.word, grade FROM t LEFT JOIN lx USING (word)),
g AS (SELECT essay_id, count(*) AS n, count(grade) AS c, sum(grade) AS s, {', '.join(f'sum((grade = {k})::INT) AS g{k}' for k in range(1, 6))} FROM j GROUP BY essay_id)
SELECT essay_id, {', '.join(f'round(coalesce(coalesce(g{k}, 0) / n::DOUBLE, 0), 6) AS vocab_grade_{k}_ratio' for k in range(1, 6))}, round(coalesce((n - c) / n::DOUBLE, 0), 6) AS vocab_out_of_grade_ratio, round(CASE WHEN c > 0 THEN s / c::DOUBLE ELSE 0 END, 6) AS vocab_grade_mean, coalesce(c, 0) AS vocab_graded_count FROM e LEFT JOIN g USING (essay_id)""",
    "sentence_stats": f"""WITH d AS (SELECT source, len(list_filter(list_transform(string_split(regexp_replace(replace(text, '　', ' '), '([.!?。？！])[ \\t\\n\\x0b\\f\\r]+', '\\1␞', 'g'), '␞'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS s, len({_TOKENS.format('text')}) AS t FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS n_documents, sum(s)::BIGINT AS n_sentences, sum(t)::BIGINT AS n_tokens, round(avg(s), 6) AS mean_sentences FROM d GROUP BY source""",
    "feedback_families": f"""WITH {RATINGS}, k AS (SELECT essay_id, trait, {_TOKENS.format('feedback')} AS t FROM ratings WHERE rating_round = 1 AND trim(feedback) <> ''), f AS (SELECT essay_id, trait, len(t) AS n_tokens, {_families_sql()} AS f FROM k)
SELECT essay_id, trait, n_tokens, array_to_string(f, '|') AS llm_families, len(f) AS n_families FROM f""",
    "coherence_by_label": """WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), n AS (SELECT label, vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM v),
u AS (SELECT label, vec_id, list_transform(v, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE 0 END) AS u, (norm > 0)::INT AS nz FROM n), a AS (SELECT label, nz, list_dot_product(u, lag(u) OVER (PARTITION BY label ORDER BY vec_id)) AS c FROM u),
g AS (SELECT label, count(*) AS n, sum(nz) AS nz, avg(c) AS m, stddev_pop(c) AS s, min(c) AS least FROM a GROUP BY label), p AS (SELECT a.label, sum(list_dot_product(a.u, b.u)) AS t FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label)
SELECT label, n AS n_sentences, round(CASE WHEN n > 1 THEN m ELSE 0 END, 6) AS coh_adjacent_mean, round(CASE WHEN n > 1 THEN s ELSE 0 END, 6) AS coh_adjacent_std, round(CASE WHEN n > 1 THEN least ELSE 0 END, 6) AS coh_adjacent_min, round(CASE WHEN n > 1 THEN t / (n * (n - 1)) ELSE 0 END, 6) AS coh_all_mean FROM g LEFT JOIN p USING (label)""",
    "text_digests": "SELECT doc_id, sha256(text) AS sha256, translate(concat_ws(' ', source, purpose), ' /', '__') AS slug, CASE WHEN length(text) > 40 THEN text[1:40] || '…' ELSE text END AS preview FROM documents WHERE text IS NOT NULL",
}
