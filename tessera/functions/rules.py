"""The decision table that turns a cell's evidence into a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.nulls import fired
from tessera.functions.vocab import AREA_FAMILIES, CODE_LEVEL, TRAIT_AREA

JUSTIFICATION_MAX = 0.10
LEAST_CONDITIONS = 2


def level(code: Column) -> Column:
    """The number of an ordinal code; NULL for NA and unknown codes."""
    return F.create_map(*[F.lit(x) for kv in CODE_LEVEL.items() for x in kv])[code]


def family_match(trait: Column, families: Column) -> Column:
    """Does any family fit the trait's area, first or second? NULL for unknown traits."""
    area = F.create_map(*[F.lit(x) for kv in TRAIT_AREA.items() for x in kv])[trait]
    out = F.lit(None).cast("boolean")
    for a, (first, second, _) in AREA_FAMILIES.items():
        out = F.when(area == a, F.arrays_overlap(families, F.array(*map(F.lit, first + second)))).otherwise(out)
    return out


def negative_cue(trait: Column, families: Column) -> Column:
    """Does a family speak against the trait's area?"""
    area = F.create_map(*[F.lit(x) for kv in TRAIT_AREA.items() for x in kv])[trait]
    out = F.lit(False)
    for a, (_, _, against) in AREA_FAMILIES.items():
        if against:
            out = F.when(area == a, F.arrays_overlap(families, F.array(*map(F.lit, against)))).otherwise(out)
    return out


def classify(compat: bool = False) -> dict[str, Column]:
    """label, priority_rank and triggered_rules of rows with the evidence columns.

    Columns: tau_unstable_any, jaccard_unstable, family_rubric_match, justification_rate, llm_code,
    llm_is_na, human_code, feedback_impure_50.  Missing evidence doesn't fire a rule, and a missing
    match counts as none; in ``compat`` mode missing flags fire, and a missing match doesn't.
    """
    flag = lambda c: fired(F.col(c), compat)
    tau, jac, impure = flag("tau_unstable_any"), flag("jaccard_unstable"), flag("feedback_impure_50")
    llm_na = F.coalesce(F.col("llm_code") == "NA", F.lit(False)) | flag("llm_is_na")
    human_na = F.coalesce(F.col("human_code") == "NA", F.lit(False))
    match = F.coalesce(F.col("family_rubric_match"), F.lit(False))
    no_match = F.coalesce(~F.col("family_rubric_match"), F.lit(not compat))
    conditions = {"both_tau_and_jaccard_unstable": tau & jac, "llm_na": llm_na, "human_na": human_na, "feedback_impure_50": impure}
    n = sum((c.cast("int") for c in conditions.values()), F.lit(0))
    many = n >= LEAST_CONDITIONS
    ur = tau | jac | no_match
    civ = F.coalesce(F.col("justification_rate") <= JUSTIFICATION_MAX, F.lit(False))
    aligned = match & F.coalesce(F.col("llm_code") == "상", F.lit(False)) & F.coalesce(F.col("human_code").isin("상", "중"), F.lit(False))
    label = F.when(many, "Indeterminate").when(ur, "UR").when(civ, "CIV").when(aligned, "Aligned").otherwise("Indeterminate")
    rank = F.when(many, 1).when(ur, 2).when(civ, 3).when(aligned, 4).otherwise(1)
    named = lambda d: F.concat_ws("|", *[F.when(c, F.lit(k)) for k, c in d.items()])
    rules = F.when(many, named(conditions)).when(ur | civ, named({"shap_absent_or_unstable": ur, "rationale_mapping_below_10pct": civ, "also_civ_triggered": ur & civ})).when(aligned, "converge_on_rubric_relevant").otherwise("residual_no_decisive_evidence")
    return {"label": label, "priority_rank": rank, "triggered_rules": rules}


def closer(a: Column, b: Column, left: str = "SHAP", right: str = "LLM", band: float = 0.05) -> Column:
    """Which of two agreements is higher; tied within the band or where both are missing."""
    return F.when(a.isNull() & b.isNull(), "tied").when(a.isNull(), right).when(b.isNull(), left).when(F.abs(a - b) < band, "tied").when(a > b, left).otherwise(right)


def reliability_weight(q: Column) -> Column:
    return F.least(F.greatest(F.coalesce(q, F.lit(0.0)) / 0.70, F.lit(0.20)), F.lit(1.00))


def strict_bool(c: Column) -> Column:
    """A boolean from 0, 1, true or false in any case; anything else, blanks included, is an error."""
    t = F.lower(F.trim(c.cast("string")))
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(t, F.lit("NULL")))).cast("boolean")
    return F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False).otherwise(bad)
