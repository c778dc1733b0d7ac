"""Chat formatting with typed content parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template: a turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>", "</s>"
#: Inside texts each control character is written as itself after the escape character, so no control string is left.
ESCAPE = "\\"
CONTROL = "<>[]|"
#: Placeholder of each typed part, and the tokens that it stands for: a fixed count, or one for so many units of size.
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Image: one token for each patch of 14 x 14 pixels; audio: one for 40 ms; document: one for 4 bytes.
IMAGE_PATCH, AUDIO_MS, DOCUMENT_BYTES = 14, 40, 4
PART = "struct<type: string, text: string, ref: string, width: long, height: long, ms: long, bytes: long>"


def escaped(text: Column) -> Column:
    """Each of the control characters and the escape character gets the escape character before it."""
    return F.regexp_replace(text, r"([\\<>\[\]|])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    null = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), *[null.cast(t).alias(n) for n, t in (("ref", "string"), ("width", "long"), ("height", "long"), ("ms", "long"), ("bytes", "long"))])
    return F.array(part).cast(f"array<{PART}>")


def _units(size: Column, each: int) -> Column:
    return F.ceil(F.coalesce(size, F.lit(0)) / F.lit(float(each))).cast("long")


def visit(parts: Column) -> dict[str, Column]:
    """Flatten typed parts in order: the text with placeholders, the attachments' references, the expanded tokens.

    `body` has texts escaped and a placeholder for each attachment; `refs` lists (n, type, ref, tokens) in order, n
    from 0; `tokens` is the sum that placeholders expand to. A part of unknown type stands as its text, if any. A null
    or empty content has an empty body.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    kind = lambda p: F.lower(F.coalesce(p["type"], F.lit("text")))
    attached = lambda p: kind(p).isin(*PLACEHOLDER)

    def mark(p: Column) -> Column:
        out = escaped(F.coalesce(p["text"], F.lit("")))
        for name, placeholder in PLACEHOLDER.items():
            out = F.when(kind(p) == name, F.lit(placeholder)).otherwise(out)
        return out

    def tokens(p: Column) -> Column:
        patches = _units(p["width"], IMAGE_PATCH) * _units(p["height"], IMAGE_PATCH)
        return F.when(kind(p) == "image", patches).when(kind(p) == "audio", _units(p["ms"], AUDIO_MS)).otherwise(_units(p["bytes"], DOCUMENT_BYTES))

    only = F.filter(parts, attached)
    return {
        "body": F.array_join(F.transform(parts, mark), ""),
        "refs": F.transform(only, lambda p, n: F.struct(n.cast("long").alias("n"), kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens"))),
        "tokens": F.aggregate(only, F.lit(0).cast("long"), lambda a, p: a + tokens(p)),
    }


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content: Column | None = None) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans, refs, placeholder_tokens, n_turns.

    `content` is an array of typed parts (see PART); by default the column text is one text part. Turns go by number,
    then role, then text; null roles and texts are empty, null numbers come first, rows repeated whole count each. A
    conversation is a row, so its turns meet in one task at last, after they are joined up map-side; a null conv_id is
    a conversation too. loss_spans are (start, length) in code points of `formatted`, from 1: each assistant turn's
    body, without marks.
    """
    parts = text_part(F.col("text")) if content is None else content
    seen = visit(parts)
    role = escaped(F.coalesce(F.col(role_col), F.lit("")))
    one = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), seen["body"].alias("body"), role.alias("mark"), seen["refs"].alias("refs"), seen["tokens"].alias("tokens")
    ).withColumn("head", F.concat(F.lit(OPEN), "mark", F.lit(CLOSE)))
    # where each turn begins: a running sum, in the shuffle by conversation that the grouping needs too
    upto = F.sum(F.length("head") + F.length("body") + len(END)).over(Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1))
    one = one.withColumn("at", F.coalesce(upto, F.lit(0)).cast("int"))
    chats = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "at", "head", "refs", "tokens"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct((t["at"] + F.length(t["head"]) + 1).alias("start"), F.length(t["body"]).alias("length")))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t, n: F.transform(t["refs"], lambda r: F.struct(n.cast("long").alias("turn"), r["n"].alias("n"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens"))))).alias("refs"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("placeholder_tokens"),
        F.size("turns").cast("long").alias("n_turns"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text), texts unescaped, placeholders left as they are.

    No text or role holds a control string once it is escaped, so the marks alone split the turns.
    """
    turns = F.split(formatted, END, -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, CLOSE, 1)
        role, text = F.substring(head, len(OPEN) + 1, 1 << 30), F.substr(x, F.length(head) + len(CLOSE) + 1)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(turns, turn)
