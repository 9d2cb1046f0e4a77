r"""Chat formatting in DataFrame expressions only.

Template: `<|im_start|>ROLE\nTEXT<|im_end|>\n` for each run of adjacent turns of one role; the texts of a run are joined by
`<|im_sep|>`. Inside texts and roles `\` becomes `\\` and `<|` becomes `<\|`, so no marker can arise from them; a line
feed in a role becomes `<|im_nl|>`. unescape() is the exact inverse.

Turns are gathered in pieces of PIECE turn numbers first, each sorted and its adjacent runs merged; then the pieces of a
conversation, of which there are few, are put in order and merged where they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import tuned

PIECE = 64
START, END, SEP, LINE = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|im_nl|>"
_BLOCK = "array<struct<role:string,texts:array<string>>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _merged(acc: Column, turn: Column) -> Column:
    """Adds a turn to the last run if the role is the same, else as a new run."""
    last = F.try_element_at(acc, F.lit(-1))
    head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    new = lambda texts: F.array(F.struct(turn["role"].alias("role"), texts.alias("texts")))
    return F.when((F.size(acc) > 0) & (last["role"] == turn["role"]), F.concat(head, new(F.concat(last["texts"], F.array(turn["text"]))))).otherwise(F.concat(acc, new(F.array(turn["text"]))))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation; loss has (chars, loss) runs that cover `formatted` in order.

    turns: conv_id, turn, role, text. Rows go by turn, ties by role, then text; repeated rows are turns of their own; null
    turns come first; null role and text are empty; rows without conv_id are left out; other columns are ignored. Runs
    are in code points; loss is true for the texts of role assistant, a run for each, and false for everything else.
    """
    tuned(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.replace(escape(_text("role")), F.lit("\n"), F.lit(LINE)).alias("role"), escape(_text("text")).alias("text")).where("conv_id is not null")
    pieces = rows.groupBy("conv_id", F.floor(F.col("turn") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = pieces.select("conv_id", "piece", F.aggregate("turns", F.array().cast(_BLOCK), _merged).alias("runs"))
    # array_sort puts nulls last, and a null piece is the first one.
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("piece", F.lit(-(2**62))).alias("piece"), "runs"))).alias("pieces"))
    whole = whole.select("conv_id", F.flatten(F.transform("pieces", lambda p: p["runs"])).alias("runs"))
    # Runs of one role still meet where two pieces did.
    meets = lambda k: (k > 0) & (F.get("runs", k - 1)["role"] == F.get("runs", k)["role"])
    head = lambda r, k: F.when(meets(k), F.lit(SEP)).otherwise(F.concat(F.when(k > 0, END).otherwise(""), F.lit(START), r["role"], F.lit("\n")))
    body = F.transform("runs", lambda r, k: F.concat(head(r, k), F.array_join(r["texts"], SEP)))
    is_loss = lambda r: r["role"] == "assistant"
    run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))
    masks = F.transform("runs", lambda r, k: F.flatten(F.transform(r["texts"], lambda t, j: F.array(run(F.when(j == 0, F.length(head(r, k))).otherwise(F.lit(len(SEP))), F.lit(False)), run(F.length(t), is_loss(r))))))
    return whole.select("conv_id", F.concat(F.array_join(body, ""), F.lit(END)).alias("formatted"), F.concat(F.flatten(masks), F.array(run(F.lit(len(END)), F.lit(False)))).alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted): roles and texts, and the texts under the mask, read from the formatted text alone and its mask."""
    quoted = lambda s: "".join(f"\\{c}" if c in "<|>" else c for c in s)
    chats = chats.withColumn("segments", F.filter(F.split("formatted", quoted(START), -1), lambda s, k: k > 0))
    cut = F.transform("segments", lambda s: F.struct(F.substring_index(s, "\n", 1).alias("role"), F.substring(s, F.instr(s, "\n") + 1, F.length(s)).alias("rest")))
    chats = chats.withColumn("runs", F.transform(cut, lambda s: F.struct(F.replace(s["role"], F.lit(LINE), F.lit("\n")).alias("role"), F.split(F.substring(s["rest"], F.lit(1), F.length(s["rest"]) - len(END)), quoted(SEP), -1).alias("texts"))))
    chats = chats.withColumn("raw", F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda t: F.struct(unescape(r["role"]).alias("role"), t.alias("text"))))))
    # Runs 1, 3, 5 ... of the mask are the texts; their lengths must be those of the texts found.
    under = F.filter("raw", lambda t, k: F.get("loss", 2 * k + 1)["loss"] & (F.get("loss", 2 * k + 1)["chars"] == F.length(t["text"])))
    return chats.select("conv_id", F.transform("raw", lambda t: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text"))).alias("turns"), F.transform(under, lambda t: unescape(t["text"])).alias("loss_texts"), "formatted")


def digest(chats: DataFrame) -> DataFrame:
    back = read_back(chats).withColumn("loss_text", F.array_join("loss_texts", ""))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
