"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is a line with its escape level and its turns; a turn is opener, role, line feed,
text, closer. Assistant turns stand between <s> and </s> and are the loss mask; all others stand
between [INST] and [/INST]. The parser cuts at closers, and a body that still holds a control
string is an error.

Each turn is rendered without escapes, parsed, and compared with its source; where they
differ, control strings are escaped, and where they still differ, the escape character as well, which
always agrees: level 0, 1 and 2. As a turn ends at its own closer, turns that come back alone come
back together, so a conversation has the least level at which all its turns do. `~1` stands
for a `<`, `~2` for a `[` that opens a control string, `~3` for a line feed in a role, `~0` for `~`.

Turns are in the order of turn, role, text, nulls last. Null roles and texts count as empty. Rows
that repeat are turns of their own; rows without conv_id are one conversation. An empty table
gives an empty result; further columns are ignored. Rendering, parsing and comparing take a row at
a time, and places in the text are running sums over sorted rows, so the work of a conversation
grows with its length only. Its finished text is one value, which Spark
limits to 2 GB. Turns of a table's own conversation -1 join the query's probe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CONTROLS = r"(\[/?INST\]|</?s>)"
CLOSERS = r"\[/INST\]|</s>"
#: The role whose text is learned from.
LEARNED = "assistant"
#: Conversation that every run of the query formats besides the table's.
PROBE = "</s>[INST] ok [/INST]"


def escaped(text: Column, level: int) -> Column:
    if not level:
        return text
    if level == 2:
        text = F.replace(text, F.lit("~"), F.lit("~0"))
    return F.regexp_replace(F.regexp_replace(text, r"<(/?s>)", "~1$1"), r"\[(/?INST\])", "~2$1")


def unescaped(text: Column, level: int) -> Column:
    if not level:
        return text
    for code, plain in (("~1", "<"), ("~2", "["), ("~3", "\n")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return F.replace(text, F.lit("~0"), F.lit("~")) if level == 2 else text


def turn_parts(turn: Column, level: int) -> tuple[Column, Column, Column, Column]:
    """Opener, role, text and closer as they are written."""
    learned = turn["role"] == LEARNED
    role = escaped(turn["role"], level)
    if level:
        role = F.replace(role, F.lit("\n"), F.lit("~3"))
    return F.when(learned, "<s>").otherwise("[INST]"), F.concat(role, F.lit("\n")), escaped(turn["text"], level), F.when(learned, "</s>").otherwise("[/INST]")


def rendered(turns: Column, level: int) -> Column:
    return F.concat(F.lit(f"{level}\n"), F.array_join(F.transform(turns, lambda t: F.concat(*turn_parts(t, level))), ""))


def parsed(formatted: Column, level: int) -> Column:
    """The turns of a rendered text; null if it isn't one."""
    pieces = F.split(F.substr(formatted, F.lit(3)), CLOSERS)
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(body: Column) -> Column:
        inner = F.when(F.startswith(body, F.lit("<s>")), F.substr(body, F.lit(4))).when(F.startswith(body, F.lit("[INST]")), F.substr(body, F.lit(7)))
        cut = F.instr(inner, "\n")
        fine = (cut > 0) & ~F.rlike(inner, F.lit(CONTROLS))
        return F.when(fine, F.struct(unescaped(F.substr(inner, F.lit(1), cut - 1), level).alias("role"), unescaped(F.substr(inner, cut + 1), level).alias("text")))

    turns = F.transform(bodies, turn)
    return F.when((F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def by_level(level: Column, of) -> Column:
    return F.when(level == 0, of(0)).when(level == 1, of(1)).otherwise(of(2))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, level, formatted, loss_spans) of each conversation of rows (conv_id, turn, role, text).

    A span has the place of a learned text in the formatted one: start (from 0) and length in code
    points, byte_start and byte_length in UTF-8.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turn, alone = F.struct("role", "text"), F.array(F.struct("role", "text"))
    same = lambda level: F.coalesce(parsed(rendered(alone, level), level) == alone, F.lit(False))
    turns = rows.select("conv_id", "turn", text("role"), text("text")).withColumn("fine0", same(0))
    plain = F.col("fine0") & (F.instr(F.concat("role", "text"), "~") == 0)  # nothing to escape and nothing that looks escaped: level 1 writes and reads the same
    turns = turns.withColumn("fine1", F.when(plain, True).otherwise(same(1)))
    chat = Window.partitionBy("conv_id")
    order = chat.orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    level = F.when(F.bool_and("fine0").over(chat), 0).when(F.bool_and("fine1").over(chat), 1).otherwise(2)
    turns = turns.withColumns({"level": level, "place": F.row_number().over(order)}).drop("fine0", "fine1")
    parts = by_level(F.col("level"), lambda n: F.struct(*(p.alias(x) for p, x in zip(turn_parts(turn, n), ("opener", "head", "body", "closer"), strict=True))))
    turns = turns.select("conv_id", "turn", "level", "place", (F.col("role") == LEARNED).alias("learned"), parts.alias("p"))
    turns = turns.select("conv_id", "level", "place", "learned", F.concat("p.opener", "p.head").alias("front"), "p.body", F.concat("p.opener", "p.head", "p.body", "p.closer").alias("piece"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = lambda size: (F.lit(2) + F.sum(size("piece")).over(before) - size("piece") + size("front")).cast("int")
    span = F.struct(start(F.length).alias("start"), F.length("body").alias("length"), start(F.octet_length).alias("byte_start"), F.octet_length("body").alias("byte_length"))
    turns = turns.select("conv_id", "level", F.struct("place", "piece", F.when(F.col("learned"), span).alias("span")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.first("level").alias("level"), F.array_sort(F.collect_list("t")).alias("t"))
    formatted = F.concat(F.col("level").cast("string"), F.lit("\n"), F.array_join("t.piece", ""))
    return chats.select("conv_id", "level", formatted.alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """chats with the turns and the loss text that their formatted text holds."""
    level = F.substr("formatted", F.lit(1), F.lit(1)).cast("int")
    raw = F.array(F.encode("formatted", "UTF-8"))  # encoded once, as bytes can be cut without counting characters from the start
    cut = lambda data: F.transform("loss_spans", lambda s: F.decode(F.substr(data, s["byte_start"] + 1, s["byte_length"]), "UTF-8"))
    masked = F.flatten(F.transform(raw, cut))
    unmasked = by_level(level, lambda n: F.array_join(F.transform(masked, lambda x: unescaped(x, n)), ""))
    return chats.withColumns({"turns": by_level(level, lambda n: parsed(F.col("formatted"), n)), "loss_text": unmasked})


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(PROBE).alias("text"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chats(format_chats(rows.unionByName(probe))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), l AS (
  SELECT conv_id, CASE
    WHEN NOT bool_or(regexp_matches(role, '\[/?INST\]|</?s>|\n') OR regexp_matches(text, '\[/?INST\]|</?s>')) THEN 0
    WHEN NOT bool_or(regexp_matches(role, '~[123]') OR regexp_matches(text, '~[123]')) THEN 1 ELSE 2 END AS level
  FROM t GROUP BY conv_id
), e AS (
  SELECT t.*, level, CASE level WHEN 2 THEN replace(role, '~', '~0') ELSE role END AS r, CASE level WHEN 2 THEN replace(text, '~', '~0') ELSE text END AS x
  FROM t JOIN l ON t.conv_id IS NOT DISTINCT FROM l.conv_id
), f AS (
  SELECT *, CASE level WHEN 0 THEN length(r) + length(x)
    ELSE length(regexp_replace(replace(r, chr(10), '~3'), '(\[/?INST\]|</?s>)', 'x\1', 'g')) + length(regexp_replace(x, '(\[/?INST\]|</?s>)', 'x\1', 'g')) END
    + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END + 1 AS chars
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(2 + sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
