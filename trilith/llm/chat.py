r"""Chat formatting with a grammar round trip (DataFrame functions only).

Grammar of a formatted conversation, a plain sequence of turns::

    user       [INST] text [/INST]
    system     <<SYS>> text <</SYS>>
    assistant  <s> text </s>
    any other  <turn:HEX> text </turn>      HEX: the role's UTF-8 bytes

The parser is deterministic: turns follow each other without a gap, a text
ends at the first closing marker of its kind, and inside a text a backslash
stands for nothing unless a second one follows it.  Escaping doubles every
backslash and puts one after the first character of each control string, so
an escaped text holds no control string and unescaping restores it.

Each conversation is first rendered as it is and parsed again.  Where the
recovered turns differ from the source, the conflicting texts are escaped and
the result is parsed again; ``identical`` reports the last comparison.

Defined results: null text or role counts as the empty string; turns are
ordered by turn (null first), then role, then text, so ties and repeated rows
have one result and stay; a null ``conv_id`` is a conversation of its own; an
empty table gives an empty result.  Only the four named columns are used,
extra columns are ignored.  A conversation becomes one value, so its rows
must meet in one task; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKERS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("<s> ", " </s>")}
OTHER_OPEN, OTHER_CLOSE = "<turn:", " </turn>"
TURN_RE = (r"(?s)\G(?:\[INST\] .*? \[/INST\]|<<SYS>> .*? <</SYS>>|<s> .*? </s>"
           r"|<turn:[0-9A-F]*> .*? </turn>)")
CONTROL_RE = r"(\[(?=/?INST\])|<(?=<SYS>>|</SYS>>|/?s>|turn:|/turn>))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL_RE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _wrapped(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER_OPEN), F.hex(F.encode(role, "UTF-8")), F.lit("> "), text, F.lit(OTHER_CLOSE))
    for name, (opening, closing) in MARKERS.items():
        out = F.when(role == name, F.concat(F.lit(opening), text, F.lit(closing))).otherwise(out)
    return out


def _inner(turn: Column, opening: Column | int, closing: int) -> Column:
    start = F.lit(opening) if isinstance(opening, int) else opening
    return unescape(turn.substr(start + 1, F.length(turn) - start - closing))


def _parsed_turn(turn: Column) -> Column:
    code = F.regexp_extract(turn, r"^<turn:([0-9A-F]*)> ", 1)
    role = F.decode(F.unhex(code), "UTF-8")
    text = _inner(turn, F.length(code) + len(OTHER_OPEN) + 2, len(OTHER_CLOSE))
    for name, (opening, closing) in MARKERS.items():
        hit = F.startswith(turn, F.lit(opening))
        role = F.when(hit, F.lit(name)).otherwise(role)
        text = F.when(hit, _inner(turn, len(opening), len(closing))).otherwise(text)
    return F.struct(role.alias("role"), text.alias("text"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> recovered from a formatted conversation."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN_RE), F.lit(0)), _parsed_turn)


def render(turns: Column, escaped: bool) -> Column:
    return F.array_join(F.transform(
        turns, lambda t: _wrapped(t["role"], escape(t["text"]) if escaped else t["text"])), "")


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (as parsed from ``formatted``), identical,
    escaped: one row per conversation."""
    turns = df.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_s"))
    convs = convs.select("conv_id", F.transform("_s", lambda t: F.struct(t["role"].alias("role"),
                                                                        t["text"].alias("text"))).alias("_source"))
    plain = convs.withColumn("_plain", render(F.col("_source"), escaped=False))
    tried = plain.withColumn("_clash", parse(F.col("_plain")) != F.col("_source"))
    final = tried.withColumn("formatted", F.when(F.col("_clash"), render(F.col("_source"), escaped=True))
                             .otherwise(F.col("_plain")))
    back = final.withColumn("turns", parse(F.col("formatted")))
    return back.select("conv_id", "formatted", "turns", (F.col("turns") == F.col("_source")).alias("identical"),
                       F.col("_clash").alias("escaped"))


def loss_spans(formatted: DataFrame) -> DataFrame:
    """conv_id, start, end (code points of ``formatted``, end exclusive): the
    assistant texts, read from the formatted value turn by turn."""
    pieces = formatted.select("conv_id", F.posexplode(
        F.regexp_extract_all("formatted", F.lit(TURN_RE), F.lit(0))).alias("_pos", "_turn"))
    before = Window.partitionBy("conv_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    at = pieces.withColumn("_at", F.coalesce(F.sum(F.length("_turn")).over(before), F.lit(0)))
    opening, closing = MARKERS["assistant"]
    return at.where(F.startswith("_turn", F.lit(opening))).select(
        "conv_id", (F.col("_at") + len(opening)).alias("start"),
        (F.col("_at") + F.length("_turn") - len(closing)).alias("end"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all derived from the parsed output."""
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return (formatted.withColumn("_loss", loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"), "identical"))
