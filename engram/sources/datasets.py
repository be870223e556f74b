"""Evaluation sets of long conversations, and transcripts from their turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "struct<role: string, content: string, has_answer: boolean>"
INSTANCE = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, "
    f"haystack_dates array<string>, haystack_sessions array<array<{TURN}>>, answer_session_ids array<string>"
)


def haystacks(spark: SparkSession, path: str) -> DataFrame:
    """One row a question from a JSON array, with ``abstention``: a question that has no answer in its sessions."""
    return spark.read.schema(INSTANCE).json(path, multiLine=True).withColumn("abstention", F.coalesce(F.col("question_id").endswith("_abs"), F.lit(False)))


def haystack_turns(instances: DataFrame) -> DataFrame:
    """(question_id, session_id, date, turn, role, content, has_answer): a turn a row, blank ones left out. Sessions, their ids and
    dates go together as far as the shortest of the three lists."""
    n = F.least(F.size("haystack_session_ids"), F.size("haystack_dates"), F.size("haystack_sessions"))
    zipped = F.slice(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions"), F.lit(1), F.greatest(n, F.lit(0)))
    own = instances.select("question_id", F.explode(zipped).alias("s"))
    own = own.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("date"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    return own.select("question_id", "session_id", "date", "turn", "t.role", "t.content", "t.has_answer").where(F.trim("content") != "")


def personas(spark: SparkSession, path: str) -> DataFrame:
    """Questions about personas from CSV: ``updated`` as boolean and ``gold`` the contents of the snippet that answers."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    return rows.withColumn("updated", F.coalesce(F.col("updated") == "True", F.lit(False))).withColumn("gold", snippet_contents(F.col("related_conversation_snippet")))


def snippet_contents(json: Column) -> Column:
    """Contents of a JSON array of turns; what can't be read has none."""
    parsed = F.from_json(json, "array<struct<role: string, content: string>>")
    return F.coalesce(F.filter(F.transform(parsed, lambda t: t["content"]), lambda c: c.isNotNull()), F.array().cast("array<string>"))


def chat_histories(spark: SparkSession, path: str) -> DataFrame:
    """(link, turn, role, content) from one JSON file a persona."""
    rows = spark.read.schema("chat_history array<struct<role: string, content: string>>").json(path, multiLine=True)
    own = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("link"), F.posexplode("chat_history").alias("turn", "t"))
    return own.select("link", "turn", "t.role", "t.content")


def transcripts(turns: DataFrame, *by: str) -> DataFrame:
    """(by, transcript): a line "role: content" for each turn, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda t: F.concat(t["role"], F.lit(": "), t["content"], F.lit("\n")))
    return turns.groupBy(*by).agg(lines.alias("ls")).select(*by, F.array_join("ls", "").alias("transcript"))


def with_answers(questions: DataFrame, ingested: DataFrame) -> DataFrame:
    """Questions of which one gold content at least was ingested (content)."""
    hit = questions.select("question_id", F.explode("gold").alias("content")).join(ingested.select("content").distinct(), "content", "left_semi").select("question_id").distinct()
    return questions.join(hit, "question_id", "left_semi")
