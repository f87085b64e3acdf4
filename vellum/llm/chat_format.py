"""Preference formatting: a chosen and a rejected conversation become one prompt and two masked completions.

The longest common prefix of turns (equal role and text) is rendered once, as the prompt. If both go on with an assistant turn, that turn's
header belongs to the prompt too, so completions start with the reply. Each completion comes with its mask, the character ranges on
which a loss may be taken: assistant texts and their end marks. Everything else (headers, other roles) is context.

A turn is rendered as ``<|role|>`` newline text ``<|end|>`` newline. A null role reads as "unknown", a null text as empty, a
null or empty conversation as one without turns. If one conversation is a prefix of the other, its completion is empty; ``usable``
says that both completions hold something to learn and differ. Repeated pairs are formatted alike; empty tables give no rows;
further columns pass through unless their names are those of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
SPAN = "array<struct<start:bigint,stop:bigint>>"
ADDED = {"n_common": "bigint", "prompt": "string", "chosen_completion": "string", "chosen_mask": SPAN, "rejected_completion": "string", "rejected_mask": SPAN, "usable": "boolean"}
END = "<|end|>\n"
HEAD, ASSISTANT = ("<|", "|>\n"), "assistant"


def header(role: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), role, F.lit(HEAD[1]))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), t["text"], F.lit(END))), "")


def completion(turns: Column, opened: Column) -> Column:
    """The turns after the prompt; opened: the first header is in the prompt already."""
    head = lambda t, k: F.when(opened & (k == 0), F.lit("")).otherwise(header(t["role"]))
    return F.array_join(F.transform(turns, lambda t, k: F.concat(head(t, k), t["text"], F.lit(END))), "")


def mask(turns: Column, opened: Column) -> Column:
    """Where the assistant's texts and end marks stand in the completion: one pass with the place reached and the spans so far."""
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("first"), none.alias("spans"))

    def step(s: Column, t: Column) -> Column:
        head = F.when(opened & s["first"], F.lit(0)).otherwise(F.length(t["role"]) + len(HEAD[0]) + len(HEAD[1]))
        begin = (s["at"] + head).cast("bigint")
        stop = (begin + F.length(t["text"]) + len(END)).cast("bigint")
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.lit(False).alias("first"), F.concat(s["spans"], F.when(t["role"] == ASSISTANT, span).otherwise(none)).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs: chosen and rejected (arrays of role and text), and columns that pass through. Adds the columns of ADDED."""
    rest = [c for c in pairs.columns if c not in ("chosen", "rejected", *ADDED)]
    or_else = lambda c, x: F.when(F.coalesce(c, F.lit("")) == "", F.lit(x)).otherwise(c)
    turn = lambda t: F.struct(or_else(t["role"], "unknown").alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    turns = lambda c: F.transform(F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS)), turn)
    whole = lambda c: F.col("_p")[c]
    # what is computed from rows goes into one value, whatever names the other columns have
    p = pairs.select(*(F.col(f"`{c}`") for c in rest), F.struct(turns("chosen").alias("a"), turns("rejected").alias("b")).alias("_p"))
    first = F.array_position(F.zip_with(whole("a"), whole("b"), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    n = F.when(first > 0, first - 1).otherwise(F.size(whole("a"))).cast("int")
    p = p.withColumn("_p", F.struct(whole("a").alias("a"), whole("b").alias("b"), n.alias("n")))
    after = lambda c: F.slice(whole(c), whole("n") + 1, F.size(whole(c)))
    p = p.withColumn("_p", F.struct(F.slice(whole("a"), F.lit(1), whole("n")).alias("head"), after("a").alias("a"), after("b").alias("b"), whole("n").alias("n")))
    opened = F.coalesce((F.get(whole("a"), F.lit(0))["role"] == ASSISTANT) & (F.get(whole("b"), F.lit(0))["role"] == ASSISTANT), F.lit(False))
    prompt = F.concat(rendered(whole("head")), F.when(opened, header(F.lit(ASSISTANT))).otherwise(F.lit("")))
    p = p.withColumn("_p", F.struct(
        whole("n").cast("bigint").alias("n_common"), prompt.alias("prompt"),
        completion(whole("a"), opened).alias("chosen_completion"), mask(whole("a"), opened).alias("chosen_mask"),
        completion(whole("b"), opened).alias("rejected_completion"), mask(whole("b"), opened).alias("rejected_mask"),
    ))
    usable = (F.size(whole("chosen_mask")) > 0) & (F.size(whole("rejected_mask")) > 0)
    return p.select(*(F.col(f"`{c}`") for c in rest), *(whole(c).alias(c) for c in list(ADDED)[:-1]), usable.alias("usable"))


def shortened_reply_pairs(turns: DataFrame, *, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation, rejected the same with one of its assistant turns cut to the first half
    of its words (by single spaces, rounded down). Which one follows from an MD5 of the id, so prefixes of all lengths occur and both
    sides go on after the turn. Without an assistant turn both are the conversation. Turns go by number, then role and text; a
    null number comes first. One conversation is one value, so it is gathered whole."""
    gathered = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(turn), F.lit(-(1 << 62))).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text")))).alias("all"))
    replies = F.filter(F.transform("all", lambda t, i: F.when(t["role"] == ASSISTANT, i + 1)), lambda i: i.isNotNull())
    pick = F.conv(F.substring(F.md5(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")
    g = gathered.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), replies.alias("replies"), pick.alias("pick"))
    g = g.withColumn("at", F.get("replies", F.when(F.size("replies") > 0, F.pmod("pick", F.size("replies"))).otherwise(F.lit(0)).cast("int")))
    words = lambda t: F.split(t["text"], " ", -1)
    half = lambda t: F.array_join(F.slice(words(t), F.lit(1), F.floor(F.size(words(t)) / 2).cast("int")), " ")
    rejected = F.transform("turns", lambda t, i: F.when(i + 1 == F.col("at"), F.struct(t["role"].alias("role"), half(t).alias("text"))).otherwise(t))
    return g.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def digest(formatted: DataFrame) -> DataFrame:
    """What op9 returns; masks as text, start:stop with commas between."""
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias(c)
    return formatted.select("conv_id", "n_common", "prompt", "chosen_completion", spans("chosen_mask"), "rejected_completion", spans("rejected_mask"), "usable")


ORACLE = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) k, role, text, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) r from conversations),
l as (select conv_id, list(k order by k) filter (where role = 'assistant') ks, count(*) n from t group by conv_id),
p as (select conv_id, n, ks[(('0x' || substr(md5(conv_id::varchar), 1, 15))::bigint % len(ks))::int + 1] q from l),
s as (select conv_id, n, q, text reply, array_to_string(list_slice(string_split(text, ' '), 1, len(string_split(text, ' ')) // 2), ' ') short from p left join (select conv_id, k, text from t) using (conv_id) where k = q or (q is null and k = 1)),
d as (select *, q is not null and short <> reply differ from s),
f as (select t.conv_id, t.k, t.role, t.r, sum(length(t.r)) over (partition by t.conv_id order by t.k) - length(t.r) off, length('<|' || t.role || '|>' || chr(10)) h from t join d on t.conv_id = d.conv_id and d.differ and t.k > d.q),
rest as (select conv_id, string_agg(r, '' order by k) txt, list((off + h) order by k) filter (where role = 'assistant') a, list((off + length(r)) order by k) filter (where role = 'assistant') b from f group by conv_id),
m as (select conv_id, string_agg(r, '' order by k) filter (where not differ or k < q) before from t join d using (conv_id) group by conv_id),
span as (select d.*, coalesce(before, '') before, coalesce(txt, '') txt, coalesce(a, []) a, coalesce(b, []) b from d left join m using (conv_id) left join rest using (conv_id)),
w as (select *, length(reply) + 8 c, length(short) + 8 z from span)
select conv_id, (case when differ then q - 1 else n end)::bigint n_common, case when differ then before || '<|assistant|>' || chr(10) else before end prompt,
  case when differ then reply || '<|end|>' || chr(10) || txt else '' end chosen_completion,
  case when differ then array_to_string(list_prepend('0:' || c, list_transform(range(1, len(a) + 1), lambda i: (a[i] + c)::bigint || ':' || (b[i] + c)::bigint)), ',') else '' end chosen_mask,
  case when differ then short || '<|end|>' || chr(10) || txt else '' end rejected_completion,
  case when differ then array_to_string(list_prepend('0:' || z, list_transform(range(1, len(a) + 1), lambda i: (a[i] + z)::bigint || ':' || (b[i] + z)::bigint)), ',') else '' end rejected_mask,
  differ usable
from w
"""
