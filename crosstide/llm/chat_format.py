"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that
reply is trainable. Turns are marked ``<turn>role``, a line end, the text and ``</turn>`` with a
line end. Inside roles and texts a backslash is written ``\\s``, ``<`` is written ``\\l`` and, in roles, a line end
``\\n``; so no text can hold a mark, and unescaping gives back every text exactly. Turns
after the last reply stand in one closing example without a trainable part, so nothing is lost.

An example holds its whole context, so a conversation is gathered in one row, as it must
be to be trained on; the expansion then makes one row per reply from that row, without a join.

Defined cases: turns are ordered by turn (null first), then role and text; repeated rows are turns of their
own. A null role or text is empty. Rows with a null conv_id form one conversation. Only the role
``assistant`` is trainable. An empty table gives no examples. Other input columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crosstide.llm.common import let, table

OPEN, CLOSE = "<turn>", "</turn>\n"
TRAINABLE = "assistant"
PROBE = (-7, "\\### Assistant: </turn> ok")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def expand(turns: DataFrame) -> DataFrame:
    """Examples (conv_id, target, text, loss_start, loss_length, complete): ``target`` is the index of
    the trainable turn, null in a closing example; the loss span counts characters from 0; the
    complete example of a conversation holds all its turns."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def marked(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))
        return let(F.struct(head.alias("h"), escape(t["text"]).alias("b")), lambda x: F.struct(
            F.concat(x["h"], x["b"], F.lit(CLOSE)).alias("all"), F.length(x["h"]).alias("head"), F.length(x["b"]).alias("body"),
            (t["role"] == TRAINABLE).alias("trained")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<target:int,loss_start:int,loss_length:int,upto:int>>").alias("spans"))
    talks = talks.select("conv_id", F.transform("turns", marked).alias("turns"))
    # where each turn starts: running lengths, kept with the spans in one pass over the turns
    spans = F.aggregate(
        F.transform("turns", lambda t, i: F.struct(i.alias("i"), t["head"].alias("head"), t["body"].alias("body"), t["trained"].alias("trained"))),
        start, lambda a, t: F.struct(
            (a["at"] + t["head"] + t["body"] + len(CLOSE)).alias("at"),
            F.when(t["trained"], F.concat(a["spans"], F.array(F.struct(
                t["i"].cast("int").alias("target"), (a["at"] + t["head"]).alias("loss_start"), t["body"].alias("loss_length"),
                (a["at"] + t["head"] + t["body"] + len(CLOSE)).alias("upto"))))).otherwise(a["spans"]).alias("spans")))
    whole = talks.select("conv_id", F.array_join(F.transform("turns", lambda t: t["all"]), "").alias("text"), spans.alias("s"))
    closing = F.when(~F.exists("s.spans", lambda x: x["upto"] == F.col("s.at")),
                     F.array(F.struct(F.lit(None).cast("int").alias("target"), F.col("s.at").alias("loss_start"),
                                      F.lit(0).alias("loss_length"), F.col("s.at").alias("upto"))))
    spans_and_rest = F.concat(F.col("s.spans"), F.coalesce(closing, F.array().cast("array<struct<target:int,loss_start:int,loss_length:int,upto:int>>")))
    return whole.select("conv_id", "text", F.col("s.at").alias("at"), F.explode(spans_and_rest).alias("e")).select(
        "conv_id", F.col("e.target").alias("target"), F.substring("text", F.lit(1), F.col("e.upto")).alias("text"),
        F.col("e.loss_start").alias("loss_start"), F.col("e.loss_length").alias("loss_length"),
        (F.col("e.upto") == F.col("at")).alias("complete"))


def trained_text(example: DataFrame) -> Column:
    """What an example trains on, unescaped."""
    return unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))


def read_turns(text: Column) -> Column:
    """The turns (role, text) of an example, parsed back."""
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")
    return F.transform(pieces, lambda p: let(F.instr(p, "\n"), lambda at: F.struct(
        unescape_role(F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(p, at + 1, F.length(p))).alias("text"))))


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The table and one conversation whose texts hold the template's own marks."""
    number, text = PROBE
    probe = spark.range(2).select(F.lit(number).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(TRAINABLE)).alias("role"), F.lit(text).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def report(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Digests per conversation, read back from the examples; each example is digested before rows are grouped."""
    examples = expand(with_probe(spark, turns))
    read = examples.select(
        "conv_id", "target", F.length("text").cast("long").alias("chars"), trained_text(examples).alias("reply"),
        F.when(F.col("complete"), read_turns(F.col("text"))).alias("turns"))
    back = read.select("conv_id", "target", "chars", F.when(F.col("target").isNotNull(), F.col("reply")).alias("reply"),
                       F.size("turns").alias("n"),
                       F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"))
    replies = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "reply")))),
                                       lambda x: x["reply"]), "")
    grouped = back.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max_by("sha", "n").alias("turns_sha256"), replies.alias("replies"),
        F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length("replies").cast("long").alias("loss_chars"),
                          F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, table(spark, sf_dir, "conversations"))


_probe = PROBE[1].replace("'", "''")
SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select {PROBE[0]}, 0, 'user', '{_probe}' union all select {PROBE[0]}, 1, '{TRAINABLE}', '{_probe}'),
l as (select *, {len(OPEN) + 1 + len(CLOSE)} + length(replace(replace(replace(role, '\\', '\\s'), '<', '\\l'), chr(10), '\\n'))
        + length(replace(replace(text, '\\', '\\s'), '<', '\\l')) as n from c),
r as (select *, sum(n) over w as upto, row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as back
      from l window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = '{TRAINABLE}'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = '{TRAINABLE}'), '')) as loss_sha256,
  cast(sum(case when role = '{TRAINABLE}' or back = 1 then upto else 0 end) as bigint) as formatted_chars
from r group by conv_id"""
