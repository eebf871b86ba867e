"""Chat formatting, in DataFrame functions only.

A conversation's turns are collected, sorted and cut into blocks of neighbours with one role; every block becomes

    <s>[ROLE] role [/ROLE] text [NEXT] text ... </s>        and of user blocks    <s>[INST] text [NEXT] text [/INST]

with user, assistant and system as in the table below. Control strings inside roles and texts are broken by a backslash, which is undone on
reading, so that no text can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template. Each control string begins with [ or < and holds none of them again.
OPEN = {"user": "<s>[INST]", "assistant": "<s>[ANSWER]", "system": "<s>[SYSTEM]"}
OPEN_ROLE, CLOSE_ROLE = "<s>[ROLE]", "[/ROLE]"
CLOSE = {"user": "[/INST]", "assistant": "</s>"}
CLOSE_OTHER = "[/END]"
NEXT = "[NEXT]"
#: What is broken inside texts: the opening sign, and the rest of the control string.
CONTROLS = r"([<\[])(/?s>|/?INST\]|ANSWER\]|SYSTEM\]|/?ROLE\]|/END\]|NEXT\])"


def escape(text: Column) -> Column:
    r"""Backslashes doubled, and one put after the first sign of a control string: [INST] becomes [\INST]."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROLS, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, and mask: (chars, loss) runs over its code points, a mark and a text in turn (empty after a closing).

    ``turns`` (conv_id, turn, role, text): sorted by turn, equal or null turns (first) then by role and text; null texts and roles are empty; repeated rows are
    turns of their own; a null conv_id is a conversation; other columns are ignored. The texts of assistant turns, as escaped, are
    under the mask. Turns are gathered by an aggregate that combines before the shuffle; a conversation is one row, as is its output.
    """
    slim = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gathered = slim.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    n = F.size("turns")
    # Where a role begins; each block runs to the next of these.
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]))
    started = gathered.withColumn("begins", begins)
    blocks = F.transform(
        "begins",
        lambda b, k: F.struct(
            F.get("turns", b)["role"].alias("role"),
            F.transform(F.slice("turns", b + 1, F.coalesce(F.get("begins", k + 1), n) - b), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    merged = started.select("conv_id", blocks.alias("blocks"))

    def opening(role: Column) -> Column:
        out = F.concat(F.lit(OPEN_ROLE), escape(role), F.lit(CLOSE_ROLE))
        for name, mark in OPEN.items():
            out = F.when(role == name, mark).otherwise(out)
        return out

    def closing(role: Column) -> Column:
        out = F.lit(CLOSE_OTHER)
        for name, mark in CLOSE.items():
            out = F.when(role == name, mark).otherwise(out)
        return out

    def runs(block: Column) -> Column:
        """The pieces of a block: its opening, its texts with a mark between them, its end."""
        loss = block["role"] == "assistant"
        texts = F.transform(
            block["texts"],
            lambda t, i: F.array(
                F.struct(F.when(i == 0, opening(block["role"])).otherwise(F.lit(NEXT)).alias("piece"), F.lit(False).alias("loss")),
                F.struct(t.alias("piece"), loss.alias("loss")),
            ),
        )
        end = F.struct(closing(block["role"]).alias("piece"), F.lit(False).alias("loss"))
        return F.concat(F.flatten(texts), F.array(end, F.struct(F.lit("").alias("piece"), F.lit(False).alias("loss"))))

    pieces = merged.select("conv_id", F.flatten(F.transform("blocks", runs)).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["piece"]).alias("chars"), p["loss"].alias("loss"))).alias("mask"),
    )


#: A piece that is no text: an opening, a separator or a closing.
_MARK = r"(?s)<s>\[ROLE\].*?\[/ROLE\]|<s>\[(?:INST|ANSWER|SYSTEM)\]|\[NEXT\]|\[/INST\]|</s>|\[/END\]"
_REST = 1 << 30


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, formatted, turns (array of role and text) and loss_text (all text under the mask, unescaped).

    Turns come from the marks alone. For the loss text the output is split at its marks once; the runs of the mask are a mark
    and a text in turn, so the n-th text run covers the n-th part. A run whose length is not that of its part is an error.
    """

    def block(b: Column) -> Column:
        general = F.struct(
            unescape(F.regexp_extract(b, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)).alias("role"),
            F.regexp_replace(b, r"(?s)^\[ROLE\].*?\[/ROLE\]", "").alias("body"),
        )
        role = F.when(b.startswith("[INST]"), "user").when(b.startswith("[ANSWER]"), "assistant").otherwise("system")
        named = F.struct(role.alias("role"), F.regexp_replace(b, r"^\[[A-Z]+\]", "").alias("body"))
        return F.when(b.startswith("[ROLE]"), general).otherwise(named)

    blocks = F.transform(F.slice(F.split("formatted", "<s>"), 2, _REST), block)
    parsed = formatted.select("conv_id", "formatted", "mask", blocks.alias("blocks"), F.slice(F.split("formatted", _MARK), 2, _REST).alias("parts"))
    turns = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                F.split(F.regexp_replace(b["body"], r"(\[/INST\]|</s>|\[/END\])\z", ""), r"\[NEXT\]"),
                lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    wrong = F.raise_error(F.lit("the mask does not fit the formatted text"))
    covered = F.transform(
        "parts",
        lambda part, i: F.when(F.length(part) != F.get("mask", 2 * i + 1)["chars"], wrong).when(F.get("mask", 2 * i + 1)["loss"], unescape(part)).otherwise(""),
    )
    return parsed.select("conv_id", "formatted", turns.alias("turns"), F.array_join(covered, "").alias("loss_text"))


def summary(turns: DataFrame) -> DataFrame:
    """Format ``turns`` and read them back: one row of counts and digests per conversation."""
    back = read_conversations(format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
