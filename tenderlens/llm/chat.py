r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and that reply alone under the
loss mask. The template writes a turn as

    ### role:
    text
    </turn>

Backslash, ### and </turn> inside a text get a backslash before them, so no text can end a turn or open one, and the
texts are read back exactly. Roles are written in URL encoding. An example is one string with its mask as a range of
code points. A conversation that does not end with a reply gets a last example without a mask, so no turn is lost.

Turns are grouped by conversation, the unit that an example must hold whole; within it rows are ordered by turn, then role,
then text. Defined cases: null texts and roles are empty ones; repeated rows are turns each; rows without conversation form
one; other columns are not read; an empty table has no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed strings of the template.
OPEN, SEP, CLOSE = "### ", ":\n", "\n</turn>\n"
CONTROL = r"\\|###|</turn>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def prefix_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text", reply_role: str = "assistant") -> DataFrame:
    """conv_id, example (position of its last turn), formatted, loss_start, loss_end (null without a mask), whole (holds
    all turns of its conversation)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    body = escape(F.col("text"))
    pieces = rows.select("conv_id", "turn", "role", "text", F.length(body).alias("size"),
                         F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(SEP), body, F.lit(CLOSE)).alias("piece"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = pieces.select(
        "conv_id", F.row_number().over(ordered).alias("example"), "piece", "size", (F.col("role") == reply_role).alias("reply"),
        F.sum(F.length("piece")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", "piece", "size", "reply", "end"))).alias("t")).select(
        "conv_id", F.array_join(F.col("t.piece"), "").alias("all"), F.size("t").alias("n"),
        F.filter("t", lambda t: t["reply"] | (t["example"] == F.size("t"))).alias("shown"))
    each = whole.select("conv_id", "all", "n", F.explode(F.transform("shown", lambda t: F.struct(
        t["example"].alias("example"), t["size"].alias("size"), t["reply"].alias("reply"), t["end"].alias("end")))).alias("e"))
    end = F.col("e.end") - len(CLOSE)
    return each.select(
        "conv_id", "e.example", F.substring("all", F.lit(1), F.col("e.end").cast("int")).alias("formatted"),
        F.when(F.col("e.reply"), end - F.col("e.size")).alias("loss_start"), F.when(F.col("e.reply"), end).alias("loss_end"),
        (F.col("e.example") == F.col("n")).alias("whole"))


def trainable(examples: DataFrame) -> DataFrame:
    """The examples with loss_text: what lies under the mask, as it was said."""
    start = F.col("loss_start")
    return examples.withColumn("loss_text", unescape(F.substring(
        "formatted", (start + 1).cast("int"), (F.col("loss_end") - start).cast("int"))))


def read_turns(examples: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) parsed out of the examples that hold whole conversations."""
    parts = F.split("formatted", CLOSE, -1)

    def parse(t: Column) -> Column:
        at = F.instr(t, SEP)
        return F.struct(F.url_decode(F.substring(t, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"),
                        unescape(F.substring(t, at + len(SEP), F.length(t))).alias("text"))

    return examples.where("whole").select(
        "conv_id", F.transform(F.slice(parts, 1, F.size(parts) - 1), parse).alias("turns"))


def digests(examples: DataFrame) -> DataFrame:
    """What the examples hold, by conversation."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns = read_turns(examples).select(F.col("conv_id").alias("of"), F.size("turns").cast("bigint").alias("n_turns"),
                                        F.sha2(said, 256).alias("turns_sha256"))
    loss = trainable(examples).groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss_text"))), lambda e: e["loss_text"]), "")
        .alias("loss"), F.sum(F.length("formatted")).alias("formatted_chars"), F.count("*").alias("n_examples"))
    return loss.join(turns, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
