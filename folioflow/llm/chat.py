"""Chat formatting in budgeted windows (native DataFrame operations only).

Running sums of turn tokens place every turn at an offset of its conversation.  Turns
whose offsets share a cell of ``span`` tokens form a window; a turn larger than a
span stands alone, so spans are aligned to turns and hold less than two spans of tokens
unless one turn alone is larger.  Each window starts with the conversation's system turn
(its first turn of that role), repeats the turns that start at most ``history`` tokens
before the window, and goes on with its own turns.  Repeated turns are masked: an
assistant text carries loss in the one window that owns the turn.

Running sums are made in two levels (blocks of turn numbers, then block totals), and
history is found by an equi-join on offset cells, so that a conversation with a third of
all rows is spread over many tasks.

Template, per turn: ``<|role|>`` newline, text, ``</s>`` newline.  Inside roles and texts a
backslash is doubled and one is put into each control string after its first character;
taking the backslashes off again gives the original.

Defined cases: a null text or role is an empty one; a null conv_id is a conversation of
its own; equal (conv_id, turn) rows are ordered by role, then text, and all kept; a null
turn comes first; an empty table gives no windows; other columns are not carried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, salted_join, table, written

BUDGET = 1024
HISTORY = 128
SYSTEM_RESERVE = 256
#: Tokens that a turn costs besides its words; keeps offsets of empty turns apart.
TURN_COST = 3
#: Turn numbers summed together before block totals are.
BLOCK = 256
#: Fixed strings of common chat templates, this one's own included.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TURN = r"(?s)^<\|(.*?)\|>\n(.*)</s>\n$"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def span_tokens(budget: int, history: int, system_reserve: int) -> int:
    span = (budget - history - system_reserve) // 2
    if span < history or span < 1:
        raise ValueError("the budget must leave at least two spans as large as the history")
    return span


def placed_turns(turns: DataFrame, span: int) -> DataFrame:
    """Turns with their offset (tokens before them), token count, number and window cell."""
    t = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    t = t.withColumns({
        "tokens": (F.regexp_count("text", F.lit(WORD)) + TURN_COST).cast("long"),
        "block": F.floor(F.col("turn") / BLOCK),
    })
    t = t.withColumn("is_big", (F.col("tokens") > span).cast("long"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    within = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"tokens": "start", "is_big": "bigs", "one": "number"}
    t = t.withColumn("one", F.lit(1).cast("long"))
    t = t.withColumns({new: F.coalesce(F.sum(c).over(within), F.lit(0)) for c, new in sums.items()})
    totals = t.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"all_{new}") for c, new in sums.items()])
    across = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        *[F.coalesce(F.sum(f"all_{new}").over(across), F.lit(0)).alias(f"all_{new}") for new in sums.values()],
    )
    t = t.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    t = t.withColumns({new: F.col(new) + F.col(f"all_{new}") for new in sums.values()})
    cell = F.struct(F.floor(F.col("start") / span).alias("at"), (F.col("bigs") * 2 + F.col("is_big")).alias("bigs"))
    return t.select("conv_id", "number", "role", "text", "tokens", "start", cell.alias("cell"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, system_reserve: int = SYSTEM_RESERVE) -> DataFrame:
    """turns (conv_id, turn, role, text) to one row per window: conv_id, first_number, tokens, over_budget,
    formatted, and segments, an array of (number, repeated, start, length, loss_start, loss_length): where a
    turn stands in the text, and which of its code points carry loss (a length of 0 for none)."""
    span = span_tokens(budget, history, system_reserve)
    t = written(placed_turns(turns, span), "turns")  # placed once; what follows reads the columns it needs
    own = t.withColumn("repeated", F.lit(False)).withColumn("system", F.lit(False))
    windows = t.groupBy("conv_id", "cell").agg(F.min("start").alias("from"), F.min("number").alias("first_number"))
    windows = windows.withColumn("near", F.floor(F.col("from") / span))
    # a window looks back less than one span: into the cell that it starts in and the one before
    w = windows.select(F.col("conv_id").alias("c"), F.col("cell").alias("to_cell"), "from", "near")
    before = t.withColumn("at", F.explode(F.array(F.floor(F.col("start") / span), F.floor(F.col("start") / span) + 1)))
    before = before.join(w, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("near")))
    before = before.where((F.col("start") < F.col("from")) & (F.col("start") >= F.col("from") - history))
    kept = ["conv_id", "number", "role", "text", "tokens", "start"]
    past = before.select(*kept, F.col("to_cell").alias("cell"), F.lit(True).alias("repeated"), F.lit(False).alias("system"))
    # the system turn, where the window has it neither as its own nor as history
    first = t.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by(F.struct("number", "role", "text", "tokens", "start"), "number").alias("s"))
    lead = salted_join(windows, first, ["conv_id"], F.col("cell"), "inner")
    lead = lead.where((F.col("s.start") < F.col("from") - history))
    lead = lead.select("conv_id", "s.*", "cell", F.lit(True).alias("repeated"), F.lit(True).alias("system"))
    every = own.select(*kept, "cell", "repeated", "system").unionByName(past).unionByName(lead.select(*kept, "cell", "repeated", "system"))
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    every = every.withColumns({"head": head, "body": escape(F.col("text"))})
    every = every.withColumn("piece", F.concat("head", "body", F.lit("</s>\n")))
    part = F.struct("number", "repeated", "tokens", "piece", F.length("head").alias("lead"), F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.length("body")).otherwise(0).alias("loss"))
    out = every.groupBy("conv_id", "cell").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    lengths = F.transform("parts", lambda p: F.length(p["piece"]))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(lengths, empty, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    segments = F.transform(F.arrays_zip("parts", "starts"), lambda z: F.struct(
        z["parts"]["number"].alias("number"), z["parts"]["repeated"].alias("repeated"),
        z["starts"].alias("start"), F.length(z["parts"]["piece"]).alias("length"),
        (z["starts"] + z["parts"]["lead"]).alias("loss_start"), z["parts"]["loss"].alias("loss_length"),
    ))
    tokens = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    out = out.withColumn("starts", starts)
    return out.select(
        "conv_id",
        F.array_min(F.transform(F.filter("parts", lambda p: ~p["repeated"]), lambda p: p["number"])).alias("first_number"),
        tokens.alias("tokens"), (tokens > budget).alias("over_budget"),
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), segments.alias("segments"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Turns read back from formatted windows: conv_id, number, role, text, loss (the text under the mask)."""
    s = windows.select("conv_id", "formatted", F.explode("segments").alias("s")).where("NOT s.repeated")
    piece = F.substr("formatted", F.col("s.start") + 1, F.col("s.length"))
    loss = F.substr("formatted", F.col("s.loss_start") + 1, F.col("s.loss_length"))
    s = s.select("conv_id", F.col("s.number").alias("number"), piece.alias("piece"), F.when(F.col("s.loss_length") > 0, loss).otherwise("").alias("loss"))
    get = lambda k: unescape(F.regexp_extract("piece", _TURN, k))
    return s.select("conv_id", "number", get(1).alias("role"), get(2).alias("text"), unescape(F.col("loss")).alias("loss"))


#: A conversation of nothing but control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CONVERSATION[0][3]).alias("text"),
    )
    windows = format_windows(turns.unionByName(extra))
    sizes = windows.groupBy("conv_id").agg(F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    per = read_windows(windows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("number", "role", "text", "loss"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("t", lambda x: x["loss"]), "")
    per = per.select(
        F.col("conv_id").alias("c"), F.size("t").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
    )
    return per.join(sizes, F.col("c").eqNullSafe(F.col("conv_id"))).drop("c")


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for k in CONTROL:
        out = f"replace({out}, '{k}', '{k[0]}\\{k[1:]}')"
    return out


_SPAN = span_tokens(BUDGET, HISTORY, SYSTEM_RESERVE)
OP2_SQL = f"""
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT *, len(regexp_extract_all(text, '{WORD}')) + {TURN_COST} AS tokens,
    length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len("<||>") + len("</s>") + 2} AS chars FROM src),
b AS (SELECT *, row_number() OVER w AS number, coalesce(sum(tokens) OVER p, 0) AS start,
    coalesce(sum((tokens > {_SPAN})::INT) OVER p, 0) * 2 + (tokens > {_SPAN})::INT AS bigs
  FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text),
    p AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
win AS (SELECT conv_id, start // {_SPAN} AS cell, bigs, min(start) AS f FROM b GROUP BY ALL),
sys AS (SELECT conv_id, min_by(start, number) AS start, min_by(chars, number) AS chars FROM b WHERE role = 'system' GROUP BY conv_id),
f AS (SELECT conv_id, sum(chars) AS chars FROM (
    SELECT conv_id, chars FROM b
    UNION ALL SELECT w.conv_id, b.chars FROM win w JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.start < w.f AND b.start >= w.f - {HISTORY}
    UNION ALL SELECT w.conv_id, s.chars FROM win w JOIN sys s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.start < w.f - {HISTORY}) GROUP BY conv_id),
t AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY number) AS all_text,
    coalesce(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant'), '') AS loss FROM b GROUP BY conv_id)
SELECT t.conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, f.chars::BIGINT AS formatted_chars
FROM t JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id
"""
