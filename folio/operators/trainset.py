"""Construction of training sets from documents, pairs and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import filters

PROMPTS = (
    "Rewrite the following scientific paragraph in a clear, precise academic style:", "Transform this text into polished scientific prose:", "Improve this paragraph for an academic research paper:",
    "Rewrite this passage with better scientific clarity and flow:", "Edit this scientific text for publication quality:", "Refine this paragraph for a peer-reviewed journal:", "Polish this research paragraph for journal submission:",
    "Paraphrase this research paragraph in formal academic English:", "Rewrite this scientific content with improved structure and clarity:", "Express the same scientific ideas with better academic writing:",
    "Improve the clarity and logical flow of this scientific paragraph:", "Enhance the academic tone and precision of this text:", "Revise this paragraph to be more concise and impactful:",
    "Write this paragraph in a clear, authoritative scientific voice:", "Rewrite this text to match the style of a well-written research paper:", "Transform this into professional scientific writing:",
)
CONTINUE = "Continue writing in this scientific style:"


def split(rows: DataFrame, key: str, cuts: tuple[tuple[str, float], ...] = (("train", 0.9), ("val", 1.0)), seed: int = 42) -> DataFrame:
    """`rows` with `split`: the part of the hashed key's place, cut at whole numbers of rows.

    Places come from the hashes sorted over 4096 ranges and the ranges' counts, so no
    partition holds all rows.
    """
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_r", F.shiftrightunsigned("_h", 52))
    counts = hashed.groupBy("_r").agg(F.count(F.lit(1)).alias("_k"))
    before = counts.select(F.col("_r"), F.coalesce(F.sum("_k").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    placed = hashed.join(F.broadcast(before), "_r").withColumn("_p", F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)))
    out = F.lit(cuts[-1][0])
    for name, share in reversed(cuts[:-1]):
        out = F.when(F.col("_p") <= F.floor(F.col("_n") * F.lit(share)), name).otherwise(out)
    return placed.withColumn("split", out).drop("_h", "_r", "_b", "_n", "_p")


def weighted(docs: DataFrame, weights: DataFrame, excluded: DataFrame, priority: float = 2.5) -> DataFrame:
    """(doc_id, copy, weight): documents repeated by the whole part of their weight, once at least; copies from 1."""
    rows = docs.join(F.broadcast(excluded), "doc_id", "left_anti").join(F.broadcast(weights), "doc_id", "left")
    weight = F.when(F.col("is_priority"), F.lit(priority)).otherwise(F.coalesce("weight", F.lit(1.0)))
    return rows.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), weight.cast("int")))).alias("copy"), weight.alias("weight"))


def alpaca(paragraphs: DataFrame, pairs: DataFrame, instruction: str = "Rewrite the paragraph in the author's style.") -> DataFrame:
    """(doc_id, instruction, input, output, variant): pairs where there are any (the last of a key wins), else the text as output.

    Whole texts, joined by document; `alpaca_chunks` is the builder that cuts and filters them.
    """
    last = F.row_number().over(Window.partitionBy("doc_id", "variant").orderBy(F.desc("line")))
    latest = pairs.withColumn("_r", last).where("_r = 1").select("doc_id", "generic", "variant")
    rows = paragraphs.where(F.length(text.stripped(F.col("text"))) >= 100).join(latest, "doc_id", "left")
    return rows.select("doc_id", F.lit(instruction).alias("instruction"), F.coalesce("generic", F.lit("")).alias("input"), F.col("text").alias("output"), F.coalesce("variant", F.lit("none")).alias("variant"))


def pair_paragraphs(column: Column, least: int = 100, most: int = 1500) -> Column:
    """Blocks between blank lines, of `least` characters or more; longer ones than `most` by lines joined with blanks, and the last of those by sentences.

    A single line or sentence of more than `most` characters stays whole unless it is the last group of lines.
    """

    def joined(pieces: Column) -> Column:
        def step(done: Column, piece: Column) -> Column:
            last = F.element_at(done, -1)
            grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(" "), piece)))
            return F.when((F.size(done) > 0) & (F.length(last) + F.length(piece) + 1 <= most), grown).otherwise(F.concat(done, F.array(piece)))

        return F.aggregate(pieces, F.array().cast("array<string>"), step)

    def shorter(block: Column) -> Column:
        def ended(lines: Column) -> Column:
            last = F.element_at(lines, -1)
            return F.when(F.length(last) > most, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), joined(F.split(F.replace(last, F.lit(". "), F.lit(".\n")), "\n")))).otherwise(lines)

        lines = joined(F.filter(F.transform(F.split(block, "\n"), text.stripped), lambda x: x != ""))
        return F.flatten(F.transform(F.array(lines), ended))

    blocks = F.filter(F.transform(F.split(column, "\n\n"), text.stripped), lambda x: x != "")
    cut = F.flatten(F.transform(blocks, lambda x: F.when(F.length(x) > most, shorter(x)).otherwise(F.array(x))))
    return F.filter(cut, lambda x: F.length(x) >= least)


def paragraph_chunks(docs: DataFrame, least: int = 100, most: int = 1500) -> DataFrame:
    """(doc_id, chunk, text): stripped texts of `least` characters or more, those of more than `most` in pieces, numbered from 0."""
    rows = docs.select("doc_id", text.stripped(F.col("text")).alias("text")).where(F.length("text") >= least)
    return rows.select("doc_id", F.posexplode(F.when(F.length("text") <= most, F.array("text")).otherwise(pair_paragraphs(F.col("text"), least, most))).alias("chunk", "text"))


def alpaca_chunks(chunks: DataFrame, pairs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, chunk, instruction, input, output, variant): every chunk's pairs v1 to v3 with the pair's original as output, else the chunk alone.

    `pairs` has (doc_id, chunk, variant, line, generic, original); the last line of a key wins.
    Reference lists are left out: such chunks, and chunks whose v1 has such an original. v2 and v3 need a v1.
    """
    names = ("v1", "v2", "v3")
    latest = pairs.groupBy("doc_id", "chunk").agg(*(F.max_by(F.struct("generic", "original"), F.when(F.col("variant") == v, F.col("line"))).alias(v) for v in names))
    rows = chunks.where(filters.bibliography_b(F.col("text")) < 3).join(latest, ["doc_id", "chunk"], "left")
    rows = rows.where(F.col("v1").isNull() | (filters.bibliography_b(F.col("v1.original")) < 3))
    entry = lambda given, output, variant: F.struct(given.alias("input"), output.alias("output"), F.lit(variant).alias("variant"))
    paired = F.filter(F.array(*(F.when(F.col(v).isNotNull(), entry(F.col(f"{v}.generic"), F.col(f"{v}.original"), v)) for v in names)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "chunk", F.explode(F.when(F.col("v1").isNull(), F.array(entry(F.lit(""), F.col("text"), "none"))).otherwise(paired)).alias("e")).select("doc_id", "chunk", "e.*")
    drawn = F.element_at(F.array(*map(F.lit, PROMPTS)), (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "chunk", "variant"), F.lit(len(PROMPTS))) + 1).cast("int"))
    return rows.withColumn("instruction", F.when(F.col("variant") == "none", CONTINUE).otherwise(drawn))


def sharegpt(turns: DataFrame) -> DataFrame:
    """(conv_id, conversations): the turns in order as structs of from and value."""
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("from"), F.col("text").alias("value")))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def completion(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the stripped texts of 100 characters or more."""
    return docs.select("doc_id", text.stripped(F.col("text")).alias("text")).where(F.length("text") >= 100)


def contrastive(docs: DataFrame, instruction: str = "Continue in the author's style.") -> DataFrame:
    """(doc_id, instruction, input, chosen, rejected): rejected is filled later."""
    return completion(docs).select("doc_id", F.lit(instruction).alias("instruction"), F.col("text").alias("input"), F.col("text").alias("chosen"), F.lit("").alias("rejected"))


def context_windows(paragraphs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, first, n, context): windows of `size` paragraphs, each beginning size - 1 after the last; what is left over stays alone."""
    step = max(1, size - 1)
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = paragraphs.select("doc_id", (F.row_number().over(order) - 1).alias("first"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("total"), F.collect_list("para").over(order.rowsBetween(0, size - 1)).alias("w"))
    windows = F.greatest(F.lit(0), F.floor((F.col("total") - size) / step) + 1)
    covered = F.when(F.col("total") < size, 0).otherwise((windows - 1) * step + size)
    whole = (F.col("first") % step == 0) & (F.size("w") == size)
    alone = F.col("first") >= covered
    context = F.when(whole, F.array_join("w", "\n\n")).otherwise(F.element_at("w", 1))
    return rows.where(whole | alone).select("doc_id", "first", F.when(whole, size).otherwise(1).alias("n"), context.alias("context"))


def prompt(instruction: Column, given: Column, output: Column) -> Column:
    """The text of an instruction row."""
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), given, F.lit("\n\n### Response:\n"), output)


def kind_of(row: DataFrame) -> Column:
    """completion, alpaca, sharegpt or unknown, by the columns that are set."""
    has = lambda c: F.col(c).isNotNull() if c in row.columns else F.lit(False)
    return F.when(has("text"), "completion").when(has("instruction"), "alpaca").when(has("conversations"), "sharegpt").otherwise("unknown")
