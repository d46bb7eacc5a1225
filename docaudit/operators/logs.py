"""Conversation tables and progress events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import clip_text


def split_reasoning(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reasoning, visible; an unclosed <think> runs to the end."""
    parts = F.regexp_extract_all("text", F.lit(r"(?s)<think>(.*?)(?:</think>|$)"), 1)
    return messages.select("conv_id", "turn", F.array_join(parts, "\n").alias("reasoning"), F.trim(F.regexp_replace("text", r"(?s)<think>.*?(?:</think>|$)", "")).alias("visible"))


def agent_transcript(messages: DataFrame, per_message: int = 200, total: int = 1000) -> DataFrame:
    """conv_id, n_kept, chars: how much of the end of each conversation fits, each message clipped."""
    m = messages.select("conv_id", "turn", F.length(F.concat(F.col("role"), F.lit(": "), clip_text(F.col("text"), per_message))).alias("n"))
    back = W.Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = m.withColumn("upto", F.sum("n").over(back)).filter(F.col("upto") <= total)
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("n").alias("chars"))


# What a message is called in a transcript, by role and type.
LABELS = {("assistant", "message"): "[рассуждение агента]", ("assistant", "code"): "[исполненный код]", ("computer", None): "[вывод кода]"}
CUT = "... [начало протокола обрезано]\n\n"


def transcript(messages: DataFrame, per_message: int = 1500, total: int = 60_000) -> DataFrame:
    """conv_id, transcript: labelled messages, long ones clipped, and of all the last ``total`` characters.

    messages: conv_id, turn, role, type, text. Other roles and blank texts are left out. Only messages that can reach into
    the last characters are gathered, or whose blank line after them can.
    """
    label = F.lit(None).cast("string")
    for (role, kind), name in reversed(LABELS.items()):
        label = F.when((F.col("role") == role) & ((F.col("type") == kind) if kind else F.lit(True)), name).otherwise(label)
    n = F.length("text")
    clipped = F.when(n > per_message, F.concat(F.substring("text", 1, per_message), F.lit("\n... [обрезано, всего "), n.cast("string"), F.lit(" символов]"))).otherwise(F.col("text"))
    rows = messages.withColumn("label", label).filter("label is not null and trim(text) <> ''").select("conv_id", "turn", F.concat("label", F.lit("\n"), clipped).alias("part"))
    back = W.Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = rows.withColumn("after", F.sum(F.length("part") + 2).over(back) - F.length("part") - 2)
    rows = rows.withColumn("all", F.sum(F.length("part") + 2).over(W.Window.partitionBy("conv_id")) - 2).filter(F.col("after") - 2 < total)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n\n")
    whole = rows.groupBy("conv_id", "all").agg(text.alias("t"))
    return whole.select("conv_id", F.when(F.col("all") > total, F.concat(F.lit(CUT), F.right("t", F.lit(total)))).otherwise(F.col("t")).alias("transcript"))


def prompt_messages(messages: DataFrame, files: DataFrame) -> DataFrame:
    """conv_id, messages: role and content in order; the texts of files follow a user's own. files: conv_id, turn, pos, name, body (null: not readable)."""
    body = F.when(F.col("body").isNull(), F.concat(F.lit("[Приложен файл «"), "name", F.lit("»]"))).otherwise(F.concat(F.lit("[Содержимое файла «"), "name", F.lit("»]\n"), "body"))
    more = files.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("more"))
    rows = messages.join(more, ["conv_id", "turn"], "left")
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    own = F.coalesce("text", F.lit(""))
    content = F.when((role == "assistant") | F.col("more").isNull(), own).otherwise(F.concat_ws("\n\n", F.nullif(own, F.lit("")), "more"))
    rows = rows.select("conv_id", F.struct("turn", role.alias("role"), content.alias("content")).alias("m"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages")).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
