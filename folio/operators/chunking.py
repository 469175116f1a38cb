"""Cutting long texts into pieces of bounded token estimates.

Packing is greedy and its state depends on all that came before, so it is a fold
over the pieces: `aggregate` with a struct of the finished chunks and the open one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text


def _state(done: Column, now: Column, size: Column) -> Column:
    return F.struct(done.cast("array<string>").alias("done"), now.cast("array<string>").alias("now"), size.cast("int").alias("size"))


def packed(pieces: Column, most: int, carry: int, glue: str, further: Callable[[Column], Column] = F.array) -> Column:
    """Pieces joined to chunks of up to `most` tokens; a chunk begins with the last piece of the one before if that is below `carry` tokens.

    `further` makes the chunks of a piece of more than `most` tokens (by default one). Sizes are sums of the pieces' estimates.
    """
    none = F.array().cast("array<string>")

    def step(state: Column, piece: Column) -> Column:
        n, now, done = text.token_estimate(piece), state["now"], state["done"]
        closed = F.when(F.size(now) > 0, F.concat(done, F.array(F.array_join(now, glue)))).otherwise(done)
        last = F.element_at(now, -1)
        kept = F.when(F.size(now) > 0, text.token_estimate(last)).otherwise(F.lit(most))
        carried = (F.size(now) > 0) & (kept < carry)
        return (
            F.when(n > most, _state(F.concat(closed, further(piece)), none, F.lit(0)))
            .when(state["size"] + n <= most, _state(done, F.concat(now, F.array(piece)), state["size"] + n))
            .otherwise(F.when(carried, _state(closed, F.array(last, piece), kept + n)).otherwise(_state(closed, F.array(piece), n)))
        )

    return F.aggregate(pieces, _state(none, none, F.lit(0)), step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], glue)))).otherwise(s["done"]))


def _paragraphs(column: Column) -> Column:
    return F.filter(F.transform(F.split(column, r"\n\s*\n"), text.stripped), lambda p: p != "")


def _sentences(column: Column) -> Column:
    return F.filter(F.transform(F.split(column, r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*\n"), text.stripped), lambda p: p != "")


def by_paragraph(column: Column, most: int = 512, carry: int = 50) -> Column:
    """Chunks of whole paragraphs (blank lines between), however long one is."""
    return packed(_paragraphs(column), most, carry, "\n\n")


def by_sentence(column: Column, most: int = 512, carry: int = 50) -> Column:
    """Chunks of whole sentences (ends followed by a capital, or by a line break), however long one is."""
    return packed(_sentences(column), most, carry, " ")


def split_sentences(column: Column, most: int = 512, carry: int = 50) -> Column:
    """As `by_sentence`, with a sentence of more than `most` tokens cut by words."""
    return packed(_sentences(column), most, carry, " ", lambda s: by_words(s, most, carry))


def split_paragraphs(column: Column, most: int = 512, carry: int = 50) -> Column:
    """As `by_paragraph`, with a paragraph of more than `most` tokens cut by sentences, and those by words."""
    return packed(_paragraphs(column), most, carry, "\n\n", lambda p: split_sentences(p, most, carry))


def by_words(column: Column, most: int = 512, overlap: int = 50) -> Column:
    """Chunks of three quarters of `most` words, each beginning three quarters of `overlap` words early."""
    words, step, back = text.parts(column), int(most * 0.75), int(overlap * 0.75)
    chunk = lambda i: F.array_join(F.slice(words, F.greatest(i - back, F.lit(0)) + 1, i + step - F.greatest(i - back, F.lit(0))), " ")
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), chunk)).otherwise(F.array().cast("array<string>"))


def by_strategy(column: Column, most: int = 512, carry: int = 50) -> Column:
    """By paragraph where there are several, else by sentence; longer ones are cut further."""
    return F.when(F.size(F.split(column, r"\n\s*\n")) > 1, split_paragraphs(column, most, carry)).otherwise(split_sentences(column, most, carry))


def pieces(docs: DataFrame, chunks: Column) -> DataFrame:
    """(doc_id, chunk, part): one row for each chunk, from 0."""
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk", "part"))


def conversations(turns: DataFrame, most: int = 256) -> DataFrame:
    """(conv_id, part, first_turn, last_turn, tokens): turns packed in order; a turn beyond `most` stays alone."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.token_estimate(F.col("text")).alias("n")))).alias("t"))
    kind = "array<struct<first:bigint,last:bigint,n:int>>"

    def step(done: Column, turn: Column) -> Column:
        last = F.element_at(done, -1)
        fits = (F.size(done) > 0) & (F.coalesce(last["n"], F.lit(0)) + turn["n"] <= most)
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), turn["turn"].alias("last"), (last["n"] + turn["n"]).alias("n"))))
        return F.when(fits, grown).otherwise(F.concat(done, F.array(F.struct(turn["turn"].alias("first"), turn["turn"].alias("last"), turn["n"].alias("n"))))).cast(kind)

    packed_turns = F.aggregate("t", F.array().cast(kind), lambda d, t: F.when(F.size(d) > 0, step(d, t)).otherwise(F.array(F.struct(t["turn"].alias("first"), t["turn"].alias("last"), t["n"].alias("n"))).cast(kind)))
    return rows.select("conv_id", F.posexplode(packed_turns).alias("part", "p")).select("conv_id", "part", F.col("p.first").alias("first_turn"), F.col("p.last").alias("last_turn"), F.col("p.n").alias("tokens"))
