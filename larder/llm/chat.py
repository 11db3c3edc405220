"""Chat formatting of typed content parts, in DataFrame functions only.

A turn is an array of parts. A visitor over the parts renders text as escaped text and every other
part as an ordered placeholder, and records its attachment: kind, reference, place and expanded
token count. Turns are framed by control strings, which escaping keeps out of texts and roles; the
loss mask says for each turn whether its body counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template. Every control string starts with MARK, which no escaped text contains.
MARK = "<|"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded token counts: an image has one token for each tile of TILE pixels a side and one more, audio TOKENS_PER_SECOND, a document TOKENS_PER_PAGE.
TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512
KINDS = ("image", "audio", "document")


def escape(text: Column) -> Column:
    """Double back-slashes, then break every MARK with one; reversible, and no MARK is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A plain text as the only part of its turn; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(f"array<{PART_TYPE}>")


def expanded_tokens(p: Column) -> Column:
    """Tokens that stand for a part that is not text; unknown sizes count as one tile, second or page."""
    tiles = lambda n: F.ceil(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) / F.lit(TILE))
    return (
        F.when(p["type"] == "image", tiles(p["width"]) * tiles(p["height"]) + 1)
        .when(p["type"] == "audio", F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(1.0)), F.lit(0.0)) * TOKENS_PER_SECOND))
        .when(p["type"] == "document", F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)).cast("long") * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(parts: Column) -> tuple[Column, Column]:
    """A turn's body and its attachments in order. An unknown kind is text if it has text, else nothing.

    Neighbouring texts are one text: they are joined before they are escaped, so that no control string
    can arise where they meet.
    """
    placeholder = lambda p: F.concat(F.lit(MARK), p["type"], F.lit(":"), escape(F.replace(F.coalesce(p["ref"], F.lit("")), F.lit("|>"), F.lit("%7C%3E"))), F.lit("|>"))
    state = lambda body, run: F.struct(body.alias("body"), run.alias("run"))
    body = F.aggregate(
        parts,
        state(F.lit(""), F.lit("")),
        lambda s, p: F.when(p["type"].isin(*KINDS), state(F.concat(s["body"], escape(s["run"]), placeholder(p)), F.lit(""))).otherwise(state(s["body"], F.concat(s["run"], F.coalesce(p["text"], F.lit(""))))),
        lambda s: F.concat(s["body"], escape(s["run"])),
    )
    found = F.transform(parts, lambda p, i: F.struct(i.cast("int").alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("n_tokens")))
    found = F.filter(found, lambda f: f["type"].isin(*KINDS))
    return body, found


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: id, n_turns, formatted, loss_mask, attachments, expanded_tokens.

    loss_mask is one boolean for each turn of ``formatted``: whether its body is under the loss.
    Turns are in order of turn, then role, then body (ties and repeated rows all stay). A null role
    is empty, null parts are none, a null turn comes first, a null conversation id is a conversation.
    Very long texts stay whole, an empty table has no rows. Columns other than the named ones are not read.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART_TYPE}>"))
    body, found = visit(parts)
    role = escape(F.coalesce(F.col(role_col).cast("string"), F.lit("")))
    rows = turns.select(F.col(conv_col), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), body.alias("body"), found.alias("found")).alias("_x"))
    conv = rows.columns[0]
    own = rows.groupBy(conv).agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    x = F.col("_x")
    return own.select(
        conv,
        F.size(x).cast("long").alias("n_turns"),
        F.array_join(F.transform(x, lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(x, lambda t: t["role"].isin(*loss_roles)).alias("loss_mask"),
        F.flatten(F.transform(x, lambda t, i: F.transform(t["found"], lambda f: F.struct(i.cast("int").alias("turn_place"), f["place"].alias("place"), f["type"].alias("type"), f["ref"].alias("ref"), f["n_tokens"].alias("n_tokens"))))).alias("attachments"),
        F.aggregate(F.flatten(F.transform(x, lambda t: F.transform(t["found"], lambda f: f["n_tokens"]))), F.lit(0).cast("long"), lambda s, n: s + n).alias("expanded_tokens"),
    )


def read_back(formatted: Column, loss_mask: Column) -> tuple[Column, Column, Column]:
    """From the output alone: the turns as array<struct<role, body>> in escaped form, all unescaped text under the mask, and the turns unescaped as role, newline, text, newline each.

    Placeholders in a body are given as they stand.
    """
    pieces = F.slice(F.split(formatted, "<\\|im_start\\|>"), 2, 2_000_000_000)
    turns = F.transform(pieces, lambda p: F.struct(F.substring_index(p, SEP, 1).alias("role"), p.alias("raw")))
    turns = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.substring_index(F.substring_index(t["raw"], SEP, -1), END, 1).alias("body")))
    loss = F.array_join(F.transform(F.filter(F.arrays_zip(turns.alias("t"), loss_mask.alias("m")), lambda z: z["m"]), lambda z: unescape(z["t"]["body"])), "")
    text = F.array_join(F.transform(turns, lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["body"]), F.lit("\n"))), "")
    return turns, loss, text
