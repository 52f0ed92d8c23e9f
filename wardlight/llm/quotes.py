"""Chat formatting by quotation linking, in DataFrame functions.

A line's quote level is the number of ``>`` marks before its text. Quoted
lines and the lines a message wrote itself are normalised (marks and edges
off, white space folded, lower case) and hashed. A quoted line's original is
the first message of the conversation that wrote that line; it must stand
before the quoting one. The message that wrote most of the words quoted at
level 1 is the parent (ties: the later one). Following parents by pointer
doubling gives each message's root and depth; replies come after what they
answer, so (root_turn, turn) is a reply order.

Originals are one pre-aggregated row for each line, so a line that a hot
conversation repeats is never paired with itself.

Defined results: null text is empty; a message without linked quotes is a
root of depth 0; a null conversation or turn links nothing; messages that
share (conversation, turn) are one message for linking and rows of their own
in the result; a quoted line without a word links nothing; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.textio import handed_over, release, text_of

MARKS = r"^[\x20\x09]*((?:>[\x20\x09]?)+)"
ATTRIBUTION = r"(?i)^[\x20\x09]*on .{0,200} wrote:[\x20\x09]*$"
BLANKS = r"[\x20\x09-\x0D]+"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normal(line: Column) -> Column:
    """A line as it is compared: without marks, white space folded, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), BLANKS, " ")))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, ``own`` lines, ``quoted`` (level, line) and the text without quotes."""
    lines = F.split(text_of(), "\n", -1)
    own = F.filter(lines, lambda x: (level(x) == 0) & ~F.rlike(x, F.lit(ATTRIBUTION)))
    quoted = F.transform(F.filter(lines, lambda x: level(x) > 0), lambda x: F.struct(
        level(x).alias("level"), normal(x).alias("line")))
    rows = messages.select("conv_id", "turn", "role", own.alias("_own"), quoted.alias("quoted"))
    return rows.select("conv_id", "turn", "role", F.transform("_own", normal).alias("own"), "quoted",
                       F.regexp_replace(F.array_join("_own", "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
                       .alias("text"))


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, original, words, lines: what each message quotes of which earlier one."""
    words = F.regexp_count("line", F.lit(r"[^ ]+"))
    wordy = F.rlike("line", F.lit(r"[\p{L}\p{N}]"))
    written = (rows.select("conv_id", "turn", F.explode("own").alias("line")).where(wordy)
               .groupBy("conv_id", F.sha2("line", 256).alias("hash")).agg(F.min("turn").alias("original")))
    quotes = (rows.select("conv_id", "turn", F.explode("quoted").alias("q"))
              .select("conv_id", "turn", "q.level", "q.line").where(wordy)
              .select("conv_id", "turn", "level", F.sha2("line", 256).alias("hash"), words.alias("words")))
    return (quotes.join(written, ["conv_id", "hash"]).where("original < turn")
            .groupBy("conv_id", "turn", "level", "original")
            .agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("lines")))


def reply_tree(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn, depth for each message key."""
    found = links(rows)
    parents = (found.where("level = 1").groupBy("conv_id", "turn")
               .agg(F.max(F.struct("words", "original")).alias("best"))
               .select("conv_id", "turn", F.col("best.original").alias("parent_turn")))
    tree = handed_over(parents.select("*", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"),
                                      F.lit(True).alias("rising")), "replies")
    while True:
        up = tree.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("_root"),
                         F.col("depth").alias("_depth"))
        # a message whose top has no parent has arrived; only the others go on
        raised = tree.where("rising").join(up, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", "parent_turn", F.coalesce("_root", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.col("_root").isNotNull().alias("rising"))
        after = handed_over(tree.where("not rising").unionByName(raised), "replies")
        release(tree.sparkSession, tree)
        tree = after
        if tree.where("rising").limit(1).count() == 0:
            return tree.drop("rising")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Each message with its place in the reply tree and its text without quotes.

    ``messages`` has conv_id, turn, role and text.
    """
    rows = handed_over(parsed(messages), "messages")
    keys = [F.col("conv_id"), F.col("turn")]
    counts = links(rows).groupBy(*keys).agg(F.sum("lines").alias("_linked"))
    tree = reply_tree(rows)
    return (rows.join(tree, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "role", "parent_turn",
                    F.coalesce("root_turn", "turn").alias("root_turn"),
                    F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
                    F.size("quoted").cast("long").alias("n_quoted"),
                    F.coalesce("_linked", F.lit(0)).cast("long").alias("n_linked"),
                    F.coalesce(F.array_max(F.transform("quoted", lambda q: q["level"])), F.lit(0)).cast("long")
                    .alias("max_level"),
                    "text",
                    F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "text").alias("message")))


def as_mail(conversations: DataFrame) -> DataFrame:
    """The turns written as mail: each quotes the message it answers, and what that one quoted, one level deeper.

    A turn answers the one before it, every third one the one before that.
    The given conversations hold no quotes, so the registered query derives
    them by this; linking sees only the resulting texts.
    """
    third = F.pmod("turn", F.lit(3)) == 2
    first = conversations.groupBy("conv_id", "turn").agg(F.min(F.struct(text_of().alias("text"), "role")).alias("_m"))
    rows = conversations.select("conv_id", "turn", "role", "text")
    for k in (1, 2):
        earlier = first.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("_m.text").alias(f"_t{k}"),
                               F.col("_m.role").alias(f"_r{k}"))
        rows = rows.join(earlier, ["conv_id", "turn"], "left")
    marked = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark))
    answered = F.when(third, F.col("_t2")).otherwise(F.col("_t1"))
    deeper = F.when(third, F.lit(None)).otherwise(F.col("_t2"))
    head = F.concat(F.lit("On an earlier turn "), F.coalesce(
        F.when(third, F.col("_r2")).otherwise(F.col("_r1")), F.lit("someone")), F.lit(" wrote:\n"))
    mail = F.when(answered.isNull(), text_of()).otherwise(F.concat(
        head, F.coalesce(F.concat(marked(deeper, "> > "), F.lit("\n")), F.lit("")), marked(answered, "> "), F.lit("\n\n"),
        text_of()))
    return rows.select("conv_id", "turn", "role", mail.alias("text"))
