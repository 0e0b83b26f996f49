"""Operator 3: chat formatting with typed content parts, built-in functions only.

A turn has ``parts``: an array of (type, text, ref, width, height, seconds, pages).
The visitor flattens them in order: text is escaped, an image, audio or document part
becomes a placeholder ``<|type:k|>`` (k counts the turn's attachments), and its
reference and expanded token count are recorded.  Other types read as text.

Template: an assistant turn is ``<s>role\\ncontent</s>``, any other turn
``[INST]role\\ncontent[/INST]``; roles are URL-encoded.  Control strings inside
texts (``<s>``, ``</s>``, ``[INST]``, ``[/INST]`` and ``<|``) get a backslash after their
first character, and those that look escaped already one more, so the output can
be cut at the markers and every text read back exactly.

The loss mask holds the content of each assistant turn as (turn, start, length) in
characters of that turn's own piece of the output.

One row a conversation, so its turns meet in one group (the partial aggregation
ships each task's part once); a conversation must fit a row.

Defined results: a null text or no parts is an empty text, a null role an empty role;
rows without a turn number come first, rows of equal number by role and content, so
repeated rows are repeated turns; rows without an id are one conversation; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
ATTACHMENT = "array<struct<turn:int,index:int,type:string,ref:string,tokens:long>>"
MEDIA = ("image", "audio", "document")
#: Expansion of placeholders: one token for 28 x 28 pixels, 12.5 a second, 256 a page.
PIXELS, PER_SECOND, PER_PAGE = 28, 12.5, 256

_TAIL = r"(/?s>|/?INST\]|\|)"
_CONTROL = r"(<|\[)(\\*)" + _TAIL
_ESCAPED = r"(<|\[)\\(\\*)" + _TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def tokens_of(part: Column) -> Column:
    """Tokens that a media part's placeholder expands to."""
    image = F.ceil(part["width"] / PIXELS) * F.ceil(part["height"] / PIXELS)
    audio = F.ceil(part["seconds"] * PER_SECOND)
    return F.coalesce(F.when(part["type"] == "image", image).when(part["type"] == "audio", audio)
                      .when(part["type"] == "document", part["pages"] * PER_PAGE).cast("long"), F.lit(0).cast("long"))


def _media(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*MEDIA), F.lit(False))


def _content(parts: Column) -> Column:
    """The visitor: placeholders numbered by the media parts before them."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("k"))

    def visit(a: Column, part: Column) -> Column:
        mark = F.concat(F.lit("<|"), part["type"], F.lit(":"), a["k"].cast("string"), F.lit("|>"))
        piece = F.when(_media(part), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
        return F.struct(F.concat(a["out"], F.array(piece)).alias("out"),
                        (a["k"] + _media(part).cast("int")).alias("k"))

    return F.aggregate(parts, start, visit, lambda a: F.array_join(a["out"], ""))


def text_parts(text: Column) -> Column:
    """One text part a turn, for plain conversations."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[
        F.lit(None).cast(t).alias(n) for n, t in
        (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def format_conversations(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role",
                         parts: str = "parts") -> DataFrame:
    """(id, formatted, loss, attachments, expanded_tokens) of each conversation."""
    parts_col = F.coalesce(F.col(f"`{parts}`").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), parts_col.alias("parts"))
    rows = rows.select("id", "turn", (F.col("role") == "assistant").alias("own"),
                       F.url_encode("role").alias("role"), _content(F.col("parts")).alias("content"),
                       F.filter("parts", _media).alias("media"))
    open_, close = (F.when(F.col("own"), a).otherwise(b) for a, b in (("<s>", "[INST]"), ("</s>", "[/INST]")))
    head = F.concat(open_, "role", F.lit("\n"))
    rows = rows.select("id", F.struct(
        "turn", "role", F.concat(head, "content", close).alias("piece"), "own",
        F.char_length(head).alias("start"), F.char_length("content").alias("length"),
        F.transform("media", lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"),
                                                tokens_of(p).alias("tokens"))).alias("media")).alias("t"))
    talks = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    numbered = F.transform("ts", lambda t, i: F.struct(i.alias("turn"), t.alias("t")))
    loss = F.transform(F.filter(numbered, lambda x: x["t"]["own"]), lambda x: F.struct(
        x["turn"].alias("turn"), x["t"]["start"].alias("start"), x["t"]["length"].alias("length")))
    attachments = F.flatten(F.transform("ts", lambda t, i: F.transform(t["media"], lambda m, k: F.struct(
        i.alias("turn"), k.alias("index"), m["type"].alias("type"), m["ref"].alias("ref"),
        m["tokens"].alias("tokens")))))
    return talks.select(
        F.col("id").alias(id), F.array_join("ts.piece", "").alias("formatted"), loss.alias("loss"),
        attachments.cast(ATTACHMENT).alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda n, t: n + t))


def pieces(formatted: Column) -> Column:
    """The turns' pieces of a formatted conversation."""
    return F.filter(F.split(formatted, r"(?<=\[/INST\])|(?<=</s>)"), lambda x: x != "")


def read_back(df: DataFrame) -> DataFrame:
    """Add ``turns`` (role and unescaped text of each) and ``loss_texts`` (each text
    under the mask, unescaped) from ``formatted`` and ``loss`` alone."""
    body = lambda p: F.regexp_replace(p, r"^(?:<s>|\[INST\])|(?:</s>|\[/INST\])\z", "")
    head = lambda b: F.substring_index(b, "\n", 1)
    turns = F.transform(F.transform("pieces", body), lambda b: F.struct(
        F.url_decode(head(b)).alias("role"),
        unescape(F.substr(b, F.char_length(head(b)) + 2)).alias("text")))
    under = F.transform("loss", lambda s: unescape(F.substr(
        F.element_at("pieces", s["turn"] + 1), s["start"] + 1, s["length"])))
    return (df.withColumn("pieces", pieces(F.col("formatted")))
            .withColumn("turns", turns).withColumn("loss_texts", under).drop("pieces"))
