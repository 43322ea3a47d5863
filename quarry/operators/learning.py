"""Small operators over users, grades and trainings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with the user whose token hash they carry, if that user is active."""
    return sessions.join(users.where("active").drop("active"), "token_hash")


def score_ratios(log: DataFrame, grades: DataFrame) -> DataFrame:
    """Changes with the score ratio of the grade they come from; changes without a grade, or whose grade has no score, go."""
    scored = grades.where("total_score IS NOT NULL").select(F.col("grade_id").alias("source_grade_id"), F.try_divide("total_score", "max_score").alias("ratio"))
    return log.join(scored, "source_grade_id")


def trainings(questions: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Keys with enough questions for a training, and how many they have."""
    return questions.groupBy(*keys).agg(F.count("*").alias("n_questions")).where(F.col("n_questions") >= least)


def is_mistake(ratio: Column, uncertain: Column, high: float = 0.8) -> Column:
    """Whether a grade enters the mistake book: a low ratio, or an uncertain one."""
    return (ratio < high) | F.coalesce(uncertain, F.lit(False))
