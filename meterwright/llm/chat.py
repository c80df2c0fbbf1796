"""Chat formatting: typed content parts flattened into one training text (native).

A turn holds typed parts. The visitor goes over them in order: a text part
gives its escaped text, an image, audio or document part gives a placeholder
``<kind turn.part/>``, a reference to the attachment, and the number of tokens
it will expand to; a text that such a part has (a caption) follows its
placeholder. Turns are written as ``<turn ROLE>BODY</turn>\\n``.

Inside texts and roles ``&``, ``<`` and ``>`` are written as entities, so a
``<`` in the output always opens a marker of the template, and the output can
be split and read back without loss.

Only DataFrame functions are used. Turns get their place in the output by a
running sum over the conversation, then a conversation's turns are joined into
one string: one shuffle by conv_id.

Defined results: null text or role is empty; null parts in a list are left
out; a part without a kind is a text; a part of any other kind gives the
placeholder ``<other turn.part/>`` and a reference that names its kind, with an
unknown (null) number of tokens, which the sum leaves out; rows are ordered by (turn, role, body) with null turns first, so ties and
repeated rows have one order and all are kept; rows with null conv_id form one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import hex_digest

#: Type of the optional column ``parts``.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = ("image", "audio", "document")
#: Replaced strings in the order in which they are escaped.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
#: Tokens that an attachment expands to: per image patch side, audio second and document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024

CONTROL_TEXT = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, F.coalesce(text, F.lit("")))


def unescape(text: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[1]), F.lit(pair[0])), reversed(ENTITIES), text)


def expanded_tokens(part: Column) -> Column:
    """Tokens that take the place of an attachment's placeholder; null for a kind without a rule."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / PATCH)
    return (
        F.when(part["kind"] == "image", side("width") * side("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .cast("long")
    )


def format_chat(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text or parts) rows -> one row per conversation:

    conv_id, n_turns, formatted, loss_spans (start, length in code points of
    ``formatted``), loss_turns (for every turn, whether its text is under the loss mask), attachments (ordinal, kind, ref, turn, part, tokens),
    attachment_tokens.
    """
    text_part = F.array(
        F.struct(
            F.lit("text").alias("kind"),
            (F.col("text") if "text" in rows.columns else F.lit(None).cast("string")).alias("text"),
            *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))],
        )
    ).cast(PARTS)
    parts = F.coalesce(F.col("parts").cast(PARTS), text_part) if "parts" in rows.columns else text_part
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.filter(parts, lambda p: p.isNotNull()).alias("parts"))
    whole = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    turns = turns.withColumn("nth", F.row_number().over(whole))

    def is_text(part: Column) -> Column:
        return F.coalesce(part["kind"], F.lit("text")) == "text"

    def visited(part: Column, k: Column) -> Column:
        kind = F.when(part["kind"].isin(*ATTACHMENTS), part["kind"]).otherwise("other")
        mark = F.concat(F.lit("<"), kind, F.lit(" "), F.col("nth"), F.lit("."), k + 1, F.lit("/>"))
        return F.concat(F.when(is_text(part), "").otherwise(mark), escape(part["text"]))

    def reference(part: Column, k: Column) -> Column:
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), F.col("nth").alias("turn"), (k + 1).alias("part"), expanded_tokens(part).alias("tokens"))

    turns = turns.select(
        "conv_id",
        "nth",
        (F.col("role") == loss_role).alias("in_loss"),
        F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">")).alias("head"),
        F.array_join(F.transform("parts", visited), "").alias("body"),
        F.filter(F.transform("parts", reference), lambda a: ~is_text(a)).alias("refs"),
    )
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit("</turn>\n")))
    before = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(before), F.lit(0)))
    gathered = turns.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "nth",
                    "piece",
                    "in_loss",
                    (F.col("start") + F.char_length("head")).alias("start"),
                    F.char_length("body").cast("long").alias("length"),
                    "refs",
                )
            )
        ).alias("t")
    )
    refs = F.flatten(F.transform("t", lambda t: t["refs"]))
    return gathered.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["in_loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
        F.transform("t", lambda t: t["in_loss"]).alias("loss_turns"),
        F.transform(refs, lambda a, k: F.struct((k + 1).alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["turn"].alias("turn"), a["part"].alias("part"), a["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(refs, F.lit(0).cast("long"), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0))).alias("attachment_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """A formatted conversation -> array of (role, text), as they went in."""
    pieces = F.filter(F.split(formatted, "<turn ", -1), lambda _, k: k > 0)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">", 1)
        n = F.char_length(head)
        body = F.substring(piece, n + 2, F.char_length(piece) - n - 1 - len("</turn>\n"))
        return F.struct(unescape(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped; each span is looked for from the beginning, so this is for short conversations."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def loss_text_of_turns(turns: Column, loss_turns: Column) -> Column:
    """The same from the turns read back, in one pass over them."""
    return F.array_join(F.zip_with(turns, loss_turns, lambda t, m: F.when(m, t["text"]).otherwise("")), "")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: digests read back from the formatted conversations."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    done = format_chat(rows.unionByName(extra))
    done = done.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text_of_turns(F.col("turns"), F.col("loss_turns")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_digest(F.array_join(line, "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        hex_digest(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
            + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 15 AS n
  FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
