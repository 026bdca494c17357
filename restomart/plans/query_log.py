"""Jobs over logged statements: audit, cleanup of generated text, voting among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restomart.functions.sql_guard import read_only, starts_as_query, write_keywords
from restomart.functions.text import SPACE, col, trim_all


def audit(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Every statement with ``is_read_only`` and the write keywords it holds, joined by comma."""
    return log.withColumns({
        "is_read_only": read_only(sql),
        "offending": F.array_join(write_keywords(sql), ",")})


def offending_keywords(log: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per statement and write keyword."""
    return log.withColumn("keyword", F.explode(write_keywords(sql))).drop(sql)


def clean_statement(raw, repaired: bool = False) -> Column:
    """Bare SQL out of a generated answer: no fences, no trailing remarks, no last semicolon.

    Text that is not yet a query gets a SELECT in front. ``repaired`` applies the rules for
    corrected statements, which also end at a line that starts with "This query".
    """
    text = F.regexp_replace(trim_all(raw), "(?i)```sql\n?", "")
    text = F.regexp_replace(text, "```\n?", "")
    begins = F.upper(text).rlike("^(SELECT|WITH)")
    text = F.when(begins, text).otherwise(F.concat(F.lit("SELECT "), text))
    lines = F.split(text, "\n")

    def stops(line: Column) -> Column:
        bare = trim_all(line)
        low = F.lower(bare)
        stop = low.startswith("note:") | low.startswith("explanation:")
        if repaired:
            return stop | low.startswith("this query")
        remark = (bare.startswith("--") & ~F.contains(low, F.lit("select"))
                  & (F.contains(bare, F.lit("explanation")) | F.contains(bare, F.lit("note:"))))
        return stop | remark

    marks = F.transform(lines, lambda line, i: F.when(stops(line), i))
    first = F.array_min(F.array_compact(marks))
    kept = F.when(first.isNull(), lines).otherwise(F.slice(lines, F.lit(1), F.coalesce(first, F.lit(0))))
    return F.regexp_replace(trim_all(F.array_join(kept, "\n")), f";[{SPACE}]*$", "")


def vote(candidates: DataFrame) -> DataFrame:
    """The answer most candidates agree on, per question.

    ``candidates``: question_id, candidate_id, sql, result (JSON text), error. Results count as
    equal when their text is; on a tie the group seen first wins; its first candidate stands
    for it. Failed candidates do not vote.
    """
    good = candidates.filter(F.col("error").isNull())
    groups = good.groupBy("question_id", F.sha2("result", 256).alias("_answer")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("candidate_id").alias("candidate_id"),
        F.min_by("sql", "candidate_id").alias("sql"),
        F.min_by("result", "candidate_id").alias("result"))
    best = F.struct(F.negative("votes"), "candidate_id", "result")
    return (
        groups.groupBy("question_id").agg(
            F.min_by(F.struct("candidate_id", "sql", "result", "votes"), best).alias("w"),
            F.sum("votes").alias("successes"), F.count(F.lit(1)).alias("answers"))
        .select("question_id", "w.*", "successes", "answers",
                (F.col("w.votes") / F.col("successes")).alias("confidence"))
    )
