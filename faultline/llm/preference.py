"""Chat formatting (operator 6): pairs of chosen and rejected conversations as one prompt and two masked completions.

Turns are matched by their number.  The common prefix of a pair ends before the first turn that differs; it is rendered
once, as the prompt, and what follows on each side is that side's completion.  ``paired`` has one row a turn, with the
prompt's turn or the turns of both completions side by side, so a conversation of any length is never held by one row;
``segments`` has one row a rendered turn, ``examples`` puts the rows of a pair together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Template = tuple[str, str, str]
#: Before the role, between role and text, after the text.
TEMPLATE: Template = ("<|", "|>\n", "<|end|>\n")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, k, role, text: ``k`` numbers rows that share a turn, in order of role and text."""
    base = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return base.where("conv_id is not null and turn is not null").withColumn("k", F.row_number().over(order))


def header(role: Column, template: Template = TEMPLATE) -> Column:
    return F.concat(F.lit(template[0]), role, F.lit(template[1]))


def paired(chosen: DataFrame, rejected: DataFrame, trained: str = "assistant", template: Template = TEMPLATE) -> DataFrame:
    """``conv_id, turn, k, part, chosen, rejected``: a row a turn of a pair, in the order of ``turn, k``.

    ``part`` is prompt (the turn is the same on both sides and none differs before it; it is rendered once, in ``chosen``)
    or completion.  ``chosen`` and ``rejected`` are structs of ``role, rendered, mask_from``, null where that side has no
    such turn; characters before ``mask_from`` don't count for training.  Nulls, repeats and pairs without a partner: see
    ``segments``.
    """
    key = ["conv_id", "turn", "k"]
    c, r = _turns(chosen), _turns(rejected)
    both = c.select(*key, F.struct("role", "text").alias("c")).join(r.select(*key, F.struct("role", "text").alias("r")), key, "full_outer")
    differs = F.col("c").isNull() | F.col("r").isNull() | (F.col("c") != F.col("r"))
    # one row a pair, combined before the shuffle
    cut = both.groupBy("conv_id").agg(F.min(F.when(differs, F.struct("turn", "k"))).alias("cut"))
    at = both.join(cut, "conv_id").withColumn("common", F.col("cut").isNull() | (F.struct("turn", "k") < F.col("cut")))

    def rendered(t: str) -> Column:
        text = F.concat(header(F.col(f"{t}.role"), template), F.col(f"{t}.text"), F.lit(template[2]))
        counts = ~F.col("common") & (F.col(f"{t}.role") == trained)
        mask = F.when(counts, F.length(header(F.col(f"{t}.role"), template))).otherwise(F.length(text))
        return F.when(F.col(t).isNotNull(), F.struct(F.col(f"{t}.role").alias("role"), text.alias("rendered"), mask.cast("int").alias("mask_from")))

    part = F.when(F.col("common"), "prompt").otherwise("completion")
    return at.select(*key, part.alias("part"), rendered("c").alias("chosen"), F.when(~F.col("common"), rendered("r")).alias("rejected"))


def segments(chosen: DataFrame, rejected: DataFrame, trained: str = "assistant", template: Template = TEMPLATE) -> DataFrame:
    """``conv_id, part, turn, k, role, rendered, mask_from``: part is prompt, chosen or rejected.

    ``chosen`` and ``rejected``: (conv_id, turn, role, text), pairs share a conv_id.  ``mask_from``: characters of
    ``rendered`` before this one don't count for training; in the prompt, and in turns of other roles, none does.  Pairs
    that are equal throughout are all prompt; a conversation without a partner is all completion.  Null text and role are
    empty; rows without conv_id or turn have no place and are left out; rows that repeat a turn follow each other.  Other
    columns are ignored.
    """
    turns = paired(chosen, rejected, trained, template)
    side = lambda part, column: F.struct(F.lit(part).alias("part"), F.col(column).alias("t"))
    parts = F.when(F.col("part") == "prompt", F.array(side("prompt", "chosen"))).otherwise(F.array(side("chosen", "chosen"), side("rejected", "rejected")))
    rows = turns.select("conv_id", "turn", "k", F.inline(parts)).where("t is not null")
    return rows.select("conv_id", "part", "turn", "k", "t.role", "t.rendered", "t.mask_from")


def examples(rows: DataFrame) -> DataFrame:
    """``conv_id, prompt, chosen, rejected`` and, for both completions, ``.._spans``: the trained character ranges.  For
    pairs that fit in memory: a pair is one row here."""
    one = F.struct("turn", "k", "rendered", "mask_from")
    by = rows.groupBy("conv_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == p, one))).alias(p) for p in ("prompt", "chosen", "rejected")])
    text = lambda p: F.array_join(F.transform(p, lambda x: x["rendered"]), "")

    def spans(p: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.length(x["rendered"])
            span = F.struct((acc["at"] + x["mask_from"]).alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["mask_from"] < F.length(x["rendered"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(p, start, add, lambda acc: acc["out"])

    return by.select("conv_id", text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"), spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"))
