r"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds an array of parts.  A visitor turns each part into template text
by its kind: text is escaped, an attachment (image, audio, document) becomes a
placeholder `[MEDIA:<turn index>.<part index>]`, and its reference and the tokens
it will expand to are recorded beside the formatted text.

The template writes a turn as `<s>[INST]role[/INST]content</s>`.  In roles and
texts a backslash is doubled, and a backslash is set inside every control string
(`<\/s>`, `[\INST]`, ...), so that none of them occurs there.  Where one text part
follows another and the first ends like the start of a control string, `\.` stands
between them, so none comes about across their border either.  Taking `\.` away,
and each other backslash but not what follows it, gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The control strings of the template, without their first character.
_CONTROL = r"([<\[])(/?s>|/?INST\]|MEDIA:)"
#: A text that ends with the first characters of a control string, but not with all of them.
_BEGUN = r"(<(/?s?)|\[(/?(I(N(ST?)?)?)?|M(E(D(IA?)?)?)?))\z"
_BREAK = "\\."
PART_TYPE = "array<struct<kind:string,text:string,ref:string,units:long>>"
#: Tokens that one unit of an attachment expands to: an image tile, a second of sound, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(?:\.|(.))", "$1")


def text_part(text: Column) -> Column:
    """parts of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def _is_media(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")).isin(*UNIT_TOKENS)


def _visit(parts: Column, turn: Column, index: Column) -> Column:
    """Template text of the part at index (from 0)."""
    part, after = F.get(parts, index), F.get(parts, index + 1)
    placeholder = F.concat(F.lit("[MEDIA:"), turn.cast("string"), F.lit("."), index.cast("string"), F.lit("]"))
    text = F.coalesce(part["text"], F.lit(""))
    begun = (index + 1 < F.size(parts)) & ~_is_media(after) & text.rlike(_BEGUN)
    return F.when(_is_media(part), placeholder).when(begun, F.concat(escape(text), F.lit(_BREAK))).otherwise(escape(text))


def chat_format(messages: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans, attachments.

    messages needs conv_id, turn, role and parts (PART_TYPE); other columns are left
    out, whatever their names.  Turns stand by turn (nulls first), then role and
    formatted content, so that ties and repeated rows have one order; repeated rows
    are turns of their own.  A null conv_id is a conversation like another.  Null
    role, parts and text count as empty; a part of unknown kind is taken as text.
    An empty table gives no rows.

    Returns conv_id, n_turns, formatted, loss_spans (start from 0 and length, in
    code points of formatted, one for each `learn_from` turn), attachments (turn and
    part index, kind, ref, start of the placeholder, tokens) and expanded_tokens
    (their sum).  The offsets are running sums over a window, so the work is linear
    in a conversation; the conversation itself must fit in a row.
    """
    by_conv = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "raw")
    rows = messages.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(F.col("parts"), F.expr(f"cast(array() as {PART_TYPE})")).alias("parts"),
    ).withColumn("raw", F.concat_ws("\n", F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit("")))))
    rows = rows.withColumn("index", F.row_number().over(by_conv) - 1)
    rows = rows.withColumn("pieces", F.transform("parts", lambda p, i: _visit(F.col("parts"), F.col("index"), i)))
    head = F.concat(F.lit("<s>[INST]"), escape(F.col("role")), F.lit("[/INST]"))
    rows = rows.withColumns({"head": head, "content": F.array_join("pieces", ""), "lengths": F.transform("pieces", lambda x: F.length(x).cast("long"))})
    rows = rows.withColumn("turn_text", F.concat("head", "content", F.lit("</s>")))
    rows = rows.withColumn("from", F.sum(F.length("turn_text").cast("long")).over(by_conv) - F.length("turn_text") + F.length("head"))
    media = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: _is_media(x["p"]))
    attached = F.transform(
        media,
        lambda x: F.struct(
            F.col("index").alias("turn_index"),
            x["i"].alias("part_index"),
            x["p"]["kind"].alias("kind"),
            x["p"]["ref"].alias("ref"),
            (F.col("from") + F.aggregate(F.slice("lengths", F.lit(1), x["i"]), F.lit(0).cast("long"), lambda a, n: a + n)).alias("start"),
            (F.coalesce(x["p"]["units"], F.lit(0)) * _unit_tokens(x["p"]["kind"])).alias("tokens"),
        ),
    )
    span = F.when(F.col("role") == learn_from, F.struct(F.col("index"), F.col("from").alias("start"), F.length("content").cast("long").alias("length")))
    rows = rows.select("conv_id", "index", "turn_text", span.alias("span"), attached.alias("attached"))
    grouped = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("index", "turn_text"))).alias("turns"),
        F.array_sort(F.collect_list("span")).alias("spans"),
        F.array_sort(F.collect_list(F.when(F.size("attached") > 0, F.struct("index", "attached")))).alias("by_turn"),
    )
    return grouped.select(
        "conv_id",
        "n_turns",
        F.array_join(F.col("turns.turn_text"), "").alias("formatted"),
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        F.flatten("by_turn.attached").alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate(F.col("attachments.tokens"), F.lit(0).cast("long"), lambda a, x: a + x))


def _unit_tokens(kind: Column) -> Column:
    out = F.lit(0)
    for name, tokens in UNIT_TOKENS.items():
        out = F.when(kind == name, F.lit(tokens)).otherwise(out)
    return out


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay in the text as they are."""
    turns = F.filter(F.split(formatted, "</s>", -1), lambda t: t != "")
    cut = lambda t: F.instr(t, "[/INST]")
    start = len("<s>[INST]")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring(t, F.lit(start + 1), cut(t) - F.lit(start + 1))).alias("role"),
            unescape(F.substring(t, cut(t) + F.lit(len("[/INST]")), F.length(t))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
