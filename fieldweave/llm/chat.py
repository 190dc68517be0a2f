"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, only its reply is trainable.
A conversation that ends otherwise (or has no assistant turn) also gives one example without a reply, so that the
output holds every turn and can be read back whole.

The template puts each turn between control strings. The escape sign ``~`` marks text that would read as one:
``~`` is written ``~0``, and a control string inside a text gets ``~1`` after its first character. Both are undone
by ``unescape``; texts without control strings or ``~`` stay as they are.

Defined cases: a null text is the empty text; a null role reads back as the empty role; a role other than user,
assistant and system is written out in the template; turns are ordered by turn (null first), role and text, repeated
rows stay; rows without conv_id form one conversation; very long texts are written whole; an empty table gives no
rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[AS]", "[/ROLE]"]
USER, ASSISTANT, SYSTEM = ("[INST] ", " [/INST]"), ("<s> ", " </s>"), ("<<SYS>> ", " <</SYS>>")


def escape(text: Column) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(f"{s[0]}~1{s[1:]}")), CONTROL, F.replace(text, F.lit("~"), F.lit("~0")))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~1"), F.lit("")), F.lit("~0"), F.lit("~"))


def opening(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE] "), escape(role), F.lit(" [AS] "))
    return F.when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0]).when(role == "system", SYSTEM[0]).otherwise(other)


def closing(role: Column) -> Column:
    return F.when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).when(role == "system", SYSTEM[1]).otherwise(" [/ROLE]")


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): one row per example; the loss mask covers the characters
    from loss_start (from 0) up to loss_end of formatted, none where both are null."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    parts = turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("reply"),
        opening(t["role"]).alias("open"), escape(t["text"]).alias("body"), closing(t["role"]).alias("close"))).alias("parts"))
    last = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("parts", i)["reply"] | (i == last))
    rows = parts.select("conv_id", "parts", F.posexplode(ends).alias("example", "end"))
    before = F.transform(F.slice("parts", 1, F.col("end") - 1), lambda p: F.concat(p["open"], p["body"], p["close"]))
    rows = rows.select("conv_id", "example", F.array_join(before, "").alias("context"), F.element_at("parts", F.col("end")).alias("turn"))
    start = F.char_length(F.concat("context", "turn.open"))
    trained = F.col("turn.reply")
    return rows.select(
        "conv_id", "example",
        F.concat("context", "turn.open", "turn.body", "turn.close").alias("formatted"),
        F.when(trained, start).alias("loss_start"),
        F.when(trained, start + F.char_length("turn.body")).alias("loss_end"),
    )


#: One turn of the formatted text: kinds by opening string, each body up to its own closing string.
_TURN = r"(?s)\[INST\] (.*?) \[/INST\]|<s> (.*?) </s>|<<SYS>> (.*?) <</SYS>>|\[ROLE\] (.*?) \[AS\] (.*?) \[/ROLE\]"


def read_turns(formatted: Column) -> Column:
    """The (role, text) of every turn of a formatted example."""
    def turn(raw: Column) -> Column:
        def inner(marks: tuple[str, str]) -> Column:
            return F.substring(raw, F.lit(len(marks[0]) + 1), F.char_length(raw) - len(marks[0]) - len(marks[1]))

        split = F.instr(raw, " [AS] ")
        role = F.when(raw.startswith("[INST]"), "user").when(raw.startswith("<s>"), "assistant").when(raw.startswith("<<SYS>>"), "system").otherwise(unescape(F.substring(raw, F.lit(8), split - 8)))
        tail = F.substring(raw, split + 6, F.char_length(raw) - split - 5 - 8)
        body = F.when(raw.startswith("[INST]"), inner(USER)).when(raw.startswith("<s>"), inner(ASSISTANT)).when(raw.startswith("<<SYS>>"), inner(SYSTEM)).otherwise(tail)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted examples alone."""
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = examples.select("conv_id", "example", F.char_length("formatted").alias("chars"), F.when(F.col("loss_start").isNotNull(), loss).alias("loss"), "formatted")
    by = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    by = by.select("*", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("trained"))
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(format_examples(rows.unionByName(more)))


_ESC = "replace(text, '~', '~0')"
for _s in CONTROL:
    _ESC = f"replace({_ESC}, '{_s}', '{_s[0]}~1{_s[1:]}')"
_ESC_ROLE = _ESC.replace("(text,", "(role,")
OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             length({_ESC}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 21 + length({_ESC_ROLE}) END AS chars FROM c),
     p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
