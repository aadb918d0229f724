"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as the assistant, all others
as users with their names, and system turns as they are. The mask marks what the assistant
says. Everything is built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turn numbers of one rendered piece. Longer dialogues give several pieces, whose texts joined
#: in order are the whole rendering, so no task ever holds an unbounded dialogue.
PIECE_TURNS = 512
#: Stands for the piece of turns without a number while pieces are grouped.
UNNUMBERED = -(1 << 63)
START, END = "<|im_start|>", "<|im_end|>"


def _plain(column: Column) -> Column:
    """Text in which the format's own marks lose their bars, so that no turn can forge one."""
    return F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit(START), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))


def rotate_perspectives(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row per conversation, participant and piece.

    Columns: ``conversation``; ``speaker``, who is the assistant here; ``piece`` (turn number
    div ``piece_turns``); ``n_turns`` and ``n_target_turns`` of the piece; ``text``; ``mask``,
    runs ``flag:characters`` joined by commas that cover ``text`` exactly, flag 1 for the
    assistant's words with their end mark.

    A participant is any speaker but ``system``. Null or blank speakers are named ``unknown``,
    null texts are empty. Rows that repeat a whole turn (number, speaker, text) count once;
    different rows with one turn number stand in the order of speaker and text. Turns without
    a number form a last piece, with null ``piece``. A row without a conversation is a dialogue
    of its own. A conversation of system turns alone has no participant and no row; an empty
    table gives an empty result. Other columns are not read.
    """
    name = _plain(F.trim(F.col(speaker).cast("string")))
    turns = df.select(
        F.col(conversation).cast("long").alias("c"),
        F.col(turn).cast("long").alias("n"),
        F.when(name == "", F.lit("unknown")).otherwise(name).alias("who"),
        _plain(F.col(text).cast("string")).alias("said"),
    )
    own = F.when(F.col("c").isNull(), F.xxhash64(F.coalesce("n", F.lit(-1)), "who", "said")).otherwise(F.lit(0))
    turns = turns.select("*", F.col("c").isNull().alias("alone"), own.alias("own"), F.coalesce(F.floor(F.col("n") / piece_turns), F.lit(UNNUMBERED)).alias("at"))
    turns = turns.withColumn("key", F.coalesce("c", "own"))
    dialogue = ["key", "own", "alone"]
    # the text is shuffled once, by the keys that the join uses too; speakers come to every piece as small rows
    speakers = turns.where("who != 'system'").select(*dialogue, F.col("who").alias("speaker")).distinct()
    roles = turns.select(*dialogue, "at").distinct().join(speakers, dialogue)
    pieces = turns.groupBy(*dialogue, "at").agg(F.array_sort(F.collect_set(F.struct("n", "who", "said"))).alias("turns"))
    rotated = pieces.join(roles, [*dialogue, "at"]).select(
        F.when(~F.col("alone"), F.col("key")).alias("c"), F.nullif("at", F.lit(UNNUMBERED)).alias("piece"), "turns", "speaker"
    )

    def header(t: Column) -> Column:
        return F.when(t["who"] == F.col("speaker"), F.lit(f"{START}assistant\n")).when(t["who"] == "system", F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), t["who"], F.lit("\n")))

    def rendered(t: Column) -> Column:
        return F.concat(header(t), t["said"], F.lit(f"{END}\n"))

    def runs(t: Column) -> Column:
        target = F.concat(F.lit("0:"), F.length(header(t)).cast("string"), F.lit(",1:"), (F.length(t["said"]) + len(END)).cast("string"), F.lit(",0:1"))
        return F.when(t["who"] == F.col("speaker"), target).otherwise(F.concat(F.lit("0:"), F.length(rendered(t)).cast("string")))

    return rotated.select(
        F.col("c").alias(conversation),
        "speaker",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["who"] == F.col("speaker"))).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("turns", rendered), "").alias("text"),
        F.array_join(F.transform("turns", runs), ",").alias("mask"),
    )


def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every participant's side."""
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id AS c, turn AS n,
    CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown'
         ELSE replace(replace(trim(role), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') END AS who,
    replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS said
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT DISTINCT c, who AS speaker FROM t WHERE who <> 'system'),
r AS (
  SELECT t.*, speaker, CAST(floor(n / 512) AS BIGINT) AS piece, t.who = speaker AS target,
    CASE WHEN t.who = speaker THEN '<|im_start|>assistant' WHEN t.who = 'system' THEN '<|im_start|>system'
         ELSE '<|im_start|>user name=' || t.who END || chr(10) AS head
  FROM t JOIN s ON t.c = s.c
)
SELECT c AS conv_id, speaker, piece, count(*) AS n_turns, count(*) FILTER (target) AS n_target_turns,
  string_agg(head || said || '<|im_end|>' || chr(10), '' ORDER BY n, who, said) AS text,
  string_agg(CASE WHEN target THEN '0:' || length(head) || ',1:' || (length(said) + 10) || ',0:1'
                  ELSE '0:' || (length(head) + length(said) + 11) END, ',' ORDER BY n, who, said) AS mask
FROM r GROUP BY c, speaker, piece
"""
