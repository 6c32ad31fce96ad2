"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an ordered list of parts (type, text, ref, width, height, seconds, pages). One visitor, an expression by
the part's type, flattens each part: text is escaped; an image, audio or document part becomes a placeholder that names
its type and its place among the conversation's attachments, records its reference there, and counts the tokens that it
will expand to. Messages are joined by a template; character spans of assistant bodies form the loss mask.

Control strings of the template begin with '<' or '['. Texts are escaped by writing '&' as '&amp;', then '<' as '&lt;'
and '[' as '&lsqb;', so no text can spell a control string, and reading in the reverse order gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Fixed strings of the template. A role stands between HEAD and BODY, escaped as texts are.
BEGIN, HEAD, BODY, END = "<s>", "[TURN]", "[/TURN]", "</s>"
#: Characters of text, pixels of an image's side, a second of audio and a page of a document, in tokens.
CHARS_A_TOKEN, PATCH, TOKENS_A_SECOND, TOKENS_A_PAGE = 4, 28, 25, 512


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lsqb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A message of plain text as its only part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), *(F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def visited(part: Column) -> Column:
    """(text, attachment, tokens) of a part: a text is escaped, any other part's text is the head of its placeholder, to
    which formatted() adds its place. Unknown types are kept as placeholders of one token; a null part is an empty text."""
    kind = F.coalesce(part["type"], F.lit("text"))
    body = escaped(F.coalesce(part["text"], F.lit("")))
    whole = lambda x, least=1: F.greatest(F.lit(least).cast("long"), F.coalesce(x, F.lit(0)).cast("long"))
    tokens = (
        F.when(kind == "text", F.ceil(F.char_length(F.coalesce(part["text"], F.lit(""))) / CHARS_A_TOKEN).cast("long"))
        .when(kind == "image", whole(F.ceil(F.coalesce(part["width"], F.lit(PATCH)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(PATCH)) / PATCH)))
        .when(kind == "audio", whole(F.ceil(part["seconds"] * TOKENS_A_SECOND)))
        .when(kind == "document", whole(part["pages"] * TOKENS_A_PAGE))
        .otherwise(F.lit(1).cast("long"))
    )
    place = F.concat(F.lit("[PART:"), escaped(kind), F.lit(":"))
    return F.struct(F.when(kind == "text", body).otherwise(place).alias("text"), F.when(kind != "text", F.struct(kind.alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))).alias("attachment"), tokens.alias("tokens"))


def formatted(messages: DataFrame) -> DataFrame:
    """Per conversation of messages (conv_id, turn, role, parts array<PART>): conv_id, formatted (one string), mask
    (array of the first character, from 1, and length of each assistant body in it), attachments (turn, type, ref, tokens in
    the order of their placeholders, which name their places from 1), n_tokens (with placeholders expanded).

    Rows are ordered by turn, nulls first; ties by role and then parts. A null role is an empty one, null parts are
    none. A null conv_id is a conversation of its own. A conversation's rows meet in one string, as its format asks."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visited).alias("parts"))
    # ties of a turn go by the text that a reader sees
    turn = F.struct("turn", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("plain"), F.col("parts").alias("parts"), F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p["tokens"]).alias("tokens"))
    met = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # how many attachments stand before each turn, then before each part of it
    many = lambda parts: F.size(F.filter(parts, lambda p: p["attachment"].isNotNull()))
    before = F.aggregate("turns", F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + many(t["parts"]))))
    spelt_part = lambda t, k: lambda p, i: F.when(p["attachment"].isNull(), p["text"]).otherwise(F.concat(p["text"], (k + 1 + many(F.slice(t["parts"], 1, i))).cast("string"), F.lit("]")))
    attached = lambda t: F.transform(F.filter(t["parts"], lambda p: p["attachment"].isNotNull()), lambda p: F.struct(t["turn"].alias("turn"), p["attachment"]["type"].alias("type"), p["attachment"]["ref"].alias("ref"), p["attachment"]["tokens"].alias("tokens")))
    has = F.exists("turns", lambda t: many(t["parts"]) > 0)
    body = lambda t, k: F.when(has, F.array_join(F.transform(t["parts"], spelt_part(t, k)), "")).otherwise(t["plain"])
    numbered = met.withColumn("before", F.when(has, before).otherwise(F.array_repeat(F.lit(0), F.size("turns") + 1)))
    whole = numbered.select("conv_id", F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), body(t, F.get("before", i)).alias("body"), attached(t).alias("attachments"), t["tokens"].alias("tokens"))).alias("turns"))
    head = lambda t: F.concat(F.lit(BEGIN + HEAD), escaped(t["role"]), F.lit(BODY))
    spelt = whole.select("conv_id", "turns", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("loss"), F.char_length(head(t)).alias("lead"), F.char_length(t["body"]).alias("size"))).alias("sizes"), F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    step = lambda acc, s: F.struct((acc["at"] + s["lead"] + s["size"] + len(END)).alias("at"), F.when(s["loss"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + s["lead"]).alias("start"), s["size"].alias("length"))))).otherwise(acc["mask"]).alias("mask"))
    return spelt.select(
        "conv_id",
        "formatted",
        F.aggregate("sizes", start, step, lambda acc: acc["mask"]).alias("mask"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"]).alias("n_tokens"),
    )


def read_back(rows: DataFrame) -> DataFrame:
    """Of formatted()'s rows: conv_id, turns (role and text, unescaped), loss (the text under the mask, unescaped) and
    formatted, taken from the formatted string and the mask alone. Placeholders of parts stay in the texts."""
    pieces = F.slice(F.split("formatted", "</s>", -1), 1, F.greatest(F.size(F.split("formatted", "</s>", -1)) - 1, F.lit(0)))
    role = lambda p: F.substring_index(F.substring(p, len(BEGIN + HEAD) + 1, F.char_length(p)), BODY, 1)
    turn = lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substring(p, len(BEGIN + HEAD + BODY) + F.char_length(role(p)) + 1, F.char_length(p))).alias("text"))
    loss = F.array_join(F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"], m["length"]))), "")
    return rows.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), loss.alias("loss"))
