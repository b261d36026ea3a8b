"""Scores of all candidate outputs against all expected ones, and their one-to-one assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two candidates closer than this are too alike to choose; a free candidate at least this good is worth a look.
TOO_CLOSE, WORTH_A_LOOK = 0.02, 0.5


def score_columns(ordered: Column | bool = False) -> dict[str, Column]:
    """Scores from matched_columns (count), expected_columns, row counts, value_mismatch_count and order_mismatch_count."""
    rows = F.greatest(F.col("row_count_answer"), F.lit(1))
    near = lambda x: F.greatest(F.lit(0.0), 1 - x / rows)
    schema = F.when(F.col("expected_columns") > 0, F.col("matched_columns") / F.col("expected_columns")).otherwise(0.0)
    count = near(F.abs(F.col("row_count_answer") - F.col("row_count_student")))
    value = near(F.col("value_mismatch_count"))
    order = F.when(F.coalesce("order_mismatch_count", F.lit(0)) == 0, 1.0).otherwise(0.0)
    in_order = ordered if isinstance(ordered, Column) else F.lit(ordered)
    total = F.when(in_order, 0.2 * schema + 0.2 * count + 0.5 * value + 0.1 * order).otherwise((2 * schema + 2 * count + 5 * value) / 9)
    return {"schema_score": schema, "row_count_score": count, "value_score": value, "order_score": order, "total_match_score": total}


_RESULT = "submission_id string, expected_view string, student_view string, match_method string, status string, total_match_score double"


def assign(scores: DataFrame) -> DataFrame:
    """One row per submission and expected view: the candidate it gets.

    scores: submission_id, expected_view, student_view, total_match_score, hint_score, candidate_status, ordinal (the order of
    equal pairs). Pairs are taken from the best down while both sides are free. The choice depends on its order, so
    it runs per submission, whose views are few.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["total_match_score", "hint_score", "ordinal"], ascending=[False, False, True], kind="stable")
        taken: dict[str, dict] = {}
        used: set[str] = set()
        for r in frame.to_dict("records"):
            if r["expected_view"] not in taken and r["student_view"] not in used:
                taken[r["expected_view"]] = r
                used.add(r["student_view"])
        out = []
        for view, own in frame.groupby("expected_view", sort=True):
            if view in taken:
                r = taken[view]
                rest = own.loc[own["student_view"] != r["student_view"], "total_match_score"]
                close = len(rest) > 0 and r["total_match_score"] > 0 and abs(r["total_match_score"] - rest.iloc[0]) < TOO_CLOSE
                method = "ambiguous" if close else "no_matching_output" if r["total_match_score"] == 0 else "name_hint_then_output" if r["hint_score"] == 1 else "output_based"
                out.append((r["submission_id"], view, r["student_view"], method, "VIEW_MAPPING_AMBIGUOUS" if close else r["candidate_status"], float(r["total_match_score"])))
            else:
                best = own.iloc[0]
                look = best["total_match_score"] >= WORTH_A_LOOK
                out.append((best["submission_id"], view, best["student_view"] if look else None, "no_matching_output", "VIEW_MAPPING_AMBIGUOUS" if look else "VIEW_NO_MATCHING_OUTPUT", 0.0))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _RESULT.split(", ")])

    return scores.groupBy("submission_id").applyInPandas(walk, _RESULT)


def best_two(scores: DataFrame, by: list[str], score: str = "total_match_score", tie: str = "ordinal") -> DataFrame:
    """The best and the second best candidate of each group; only two rows of a group are ever held."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"), "student_view"))), 1, 2)
    return scores.groupBy(*by).agg(top.alias("top")).select(*by, F.col("top")[0]["student_view"].alias("best"), (-F.col("top")[0]["s"]).alias("best_score"), F.get("top", F.lit(1))["student_view"].alias("second"), (-F.get("top", F.lit(1))["s"]).alias("second_score"))
