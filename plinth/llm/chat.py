"""Chat formatting in budgeted windows, in DataFrame operations only.

A conversation's turns, in order, become marked text: ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a
line end. Prefix sums of the turns' token counts cut it into turn-aligned windows: a window takes new turns while they
fit in the budget less the system turn (if the conversation starts with one) and the history, which come before them:
the system turn, then as many of the turns just before as fit in the history budget and in what the system turn and
the new turns leave of the whole budget. A system turn larger than the whole budget stands in the first window alone.
So a window passes the budget only if its one new turn, with the system turn before it, does. Loss falls on the texts of
new assistant turns only, so each is learnt once; repeated turns are masked. Control strings within roles and texts are escaped with backslashes and come back unharmed.

Defined results: null texts and roles count as empty; turns go by (turn, role, escaped text) with nulls first, so
ties and repeated rows keep a fixed order; a null conversation id is one conversation; a turn over what is left of the budget has a window of
its own and stays whole, however long; an empty table gives no windows; columns beside the four aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import WORD_PATTERN

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens (words and marks) of a window, and of repeated turns in it.
BUDGET, HISTORY = 512, 128
MARKS = 4


def escape(text: Column) -> Column:
    """``text`` without any ``<|``, reversibly: a backslash goes before each backslash and after such a ``<``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """As ``escape``, with line ends too, for they close a role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a line end is a backslash and an n, where the backslash isn't itself escaped
    parts = F.transform(F.split(role, r"\\\\", -1), lambda x: unescape(F.replace(x, F.lit("\\n"), F.lit("\n"))))
    return F.array_join(parts, "\\")


def _turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the marked turns of each conversation in order, with their lengths and tokens."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head, body = F.concat(F.lit(START), escape_role(role), F.lit("\n")), escape(text)
    tokens = F.regexp_count(text, F.lit(WORD_PATTERN)) + MARKS
    marked = rows.select("conv_id", F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), head.alias("h"), body.alias("b"), tokens.alias("tokens"))
    one = F.struct("known", "turn", "role", F.concat("h", "b", F.lit(END)).alias("piece"), F.length("h").alias("head"), F.length("b").alias("body"), "tokens")
    return marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_context, n_new, formatted, loss, tokens) from rows (conv_id, turn, role, text).

    ``n_context`` repeated turns come first in ``formatted``; ``loss`` lists (start, length) in code points of its
    escaped texts under the mask. A conversation's rows meet in one task, as its text is one sequence.
    """
    convs = _turns(rows)
    # One pass over the prefix sums: a turn whose sum would pass the budget since the window's first turn opens the next.
    first = F.col("turns")[0]
    convs = convs.withColumn("sys", F.when((first["role"] == "system") & (first["tokens"] <= budget), first["tokens"]).otherwise(0))
    room = F.greatest(budget - history - F.col("sys"), F.lit(1))
    opened = F.aggregate(
        F.transform("turns", lambda x: x["tokens"]),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"), F.lit(0).alias("base"), F.array(F.lit(1)).alias("firsts")),
        lambda acc, t: F.when(
            (acc["sum"] + t - acc["base"] > room + F.when(F.size(acc["firsts"]) == 1, F.col("sys")).otherwise(0)) & (acc["i"] > 0),
            F.struct((acc["i"] + 1).alias("i"), (acc["sum"] + t).alias("sum"), acc["sum"].alias("base"), F.when(acc["i"] + 1 > F.element_at(acc["firsts"], -1), F.concat(acc["firsts"], F.array(acc["i"] + 1))).otherwise(acc["firsts"]).alias("firsts")),
        ).otherwise(F.struct((acc["i"] + 1).alias("i"), (acc["sum"] + t).alias("sum"), acc["base"].alias("base"), acc["firsts"].alias("firsts"))),
        lambda acc: acc["firsts"],
    )
    convs = convs.withColumn("firsts", opened).withColumn("lasts", F.concat(F.transform(F.slice(F.col("firsts"), F.lit(2), F.size("firsts")), lambda x: x - 1), F.array(F.size("turns"))))
    reach = history // MARKS  # no more turns than that fit in the history budget

    def span(x: Column, k: Column) -> Column:
        """The turns of one window, so that windows carry no others."""
        earlier = F.when((F.col("turns")[0]["role"] == "system") & (x["first"] > 1), F.lit(2)).otherwise(F.lit(1))  # the system turn isn't history
        least = F.greatest(earlier, x["first"] - reach)
        system = F.when((earlier == 2) & (F.col("sys") > 0), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        return F.struct(
            k.alias("window"),
            system.alias("system"),
            F.slice(F.col("turns"), least, F.greatest(x["first"] - least, F.lit(0))).alias("earlier"),
            F.slice(F.col("turns"), x["first"], x["last"] - x["first"] + 1).alias("new"),
        )

    bounds = F.zip_with("firsts", "lasts", lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    spans = convs.select("conv_id", F.explode(F.transform(bounds, span)).alias("w")).select("conv_id", "w.*")
    tokens_of = lambda *turns: F.aggregate(F.transform(F.concat(*turns), lambda x: x["tokens"]), F.lit(0), lambda acc, t: acc + t)
    spans = spans.withColumn("left", F.least(F.lit(history), budget - tokens_of("system", "new")))
    fitting = F.aggregate(
        F.reverse(F.transform("earlier", lambda x: x["tokens"])),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
        lambda acc, t: F.struct((acc["sum"] + t).alias("sum"), F.when(acc["sum"] + t <= F.col("left"), acc["n"] + 1).otherwise(acc["n"]).alias("n")),
        lambda acc: acc["n"],
    )
    spans = spans.withColumn("fit", fitting)
    recent = F.when(F.col("fit") > 0, F.slice(F.col("earlier"), F.size("earlier") - F.col("fit") + 1, F.col("fit"))).otherwise(F.slice("earlier", 1, 0))
    spans = spans.select("conv_id", "window", F.concat("system", recent).alias("repeated"), "new")
    spans = spans.withColumn("context", F.array_join(F.transform("repeated", lambda x: x["piece"]), ""))
    masks = F.aggregate(
        F.transform("new", lambda x: F.struct(x["role"].alias("role"), F.length(x["piece"]).alias("all"), x["head"].alias("head"), x["body"].alias("body"))),
        F.struct(F.length("context").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["all"]).alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    after = F.array_join(F.transform("new", lambda x: x["piece"]), "")
    return spans.select("conv_id", "window", F.size("repeated").alias("n_context"), F.size("new").alias("n_new"), F.concat("context", after).alias("formatted"), masks.alias("loss"), tokens_of("repeated", "new").alias("tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation from its windows alone: its turns without the repeated ones, and what is under the mask."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_context") + 2, F.col("n_new"))
    turns = F.transform(
        pieces,
        lambda x: F.concat(unescape_role(F.substring_index(x, "\n", 1)), F.lit("\n"), unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x) - F.length(F.substring_index(x, "\n", 1)) - 1 - len(END))), F.lit("\n")),
    )
    learnt = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["length"])))
    w = formatted.select("conv_id", "window", F.size(pieces).alias("n"), F.array_join(turns, "").alias("turns"), F.array_join(learnt, "").alias("learnt"), F.length("formatted").alias("chars"))
    convs = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "n", "turns", "learnt", "chars"))).alias("w"))
    learnt_all = F.array_join(F.transform("w", lambda x: x["learnt"]), "")
    return convs.select(
        "conv_id",
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda x: x["turns"]), ""), 256).alias("turns_sha256"),
        F.length(learnt_all).cast("long").alias("loss_chars"),
        F.sha2(learnt_all, 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + x["chars"]).alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )
