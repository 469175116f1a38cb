"""Checks, prompts and work lists around the generation of training pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import chunking

#: What a model's answer may begin with without being part of it; the last two with variants only.
META = ("Here is", "Here's", "Rewritten:", "Output:", "Sure,", "Restructured:", "Condensed:")


def answer(column: Column, original: Column, least: Column | float = 0.3, prefixes: tuple[str, ...] = META) -> Column:
    """A model's answer without its introduction: null if shorter than `least` of the original, cut to twice it if longer than thrice.

    An introduction is a first line that begins with one of `prefixes`; they are tried in turn.
    """
    size = F.length(original)
    out = F.when(F.length(column) > size * 3, F.substring(column, F.lit(1), size * 2)).otherwise(column)

    def without(now: Column, prefix: Column) -> Column:
        return F.when(F.startswith(now, prefix) & F.contains(now, F.lit("\n")), text.stripped(F.regexp_replace(now, r"^[^\n]*\n", ""))).otherwise(now)

    out = F.aggregate(F.array(*map(F.lit, prefixes)), out, without)  # a fold: nested, the expression would treble with each prefix
    return F.when(F.length(column) >= size * F.lit(least), out)


def request_errors(requests: DataFrame) -> Column:
    """Names of the fields of a request (text, n_variants, max_tokens, variant_index, role) that break their bounds; null fields have their defaults."""
    bad = {
        "text": ~F.coalesce(F.length("text").between(10, 10000) & (text.stripped(F.col("text")) != ""), F.lit(False)),
        "n_variants": ~F.coalesce(F.col("n_variants").between(1, 5), F.lit(True)),
        "max_tokens": ~F.coalesce(F.col("max_tokens").between(1, 4096), F.lit(True)),
        "variant_index": ~F.coalesce(F.col("variant_index").between(0, 4), F.lit(True)),
        "role": ~F.coalesce(F.col("role").rlike("^(system|user|assistant)$"), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(broken, name) for name, broken in bad.items())))


def health(files: DataFrame, large_mb: float = 500.0) -> DataFrame:
    """One row: files, priority ones, MB, and the warnings on number, priority and size. `files` has (bytes, is_priority)."""
    rows = files.agg(F.count(F.lit(1)).alias("files"), F.count_if("is_priority").alias("priority"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / F.lit(1048576.0), 4).alias("mb"))
    n = F.col("files")
    few = F.when(n == 0, "none").when(n < 5, "too few").when(n < 10, "few")
    return rows.withColumn("warnings", F.concat_ws("; ", few, F.when((F.col("priority") == 0) & (n > 0), "no priority"), F.when(F.col("mb") > large_mb, "large")))


def templates(instruction: Column, given: Column, output: Column) -> dict[str, Column]:
    """The text of an instruction row by trainer; a row without input has no input section (but in `library`)."""
    some = F.coalesce(given != "", F.lit(False))

    def made(begin: str, middle: str, end: str, after: str) -> Column:
        return F.concat(F.lit(begin), instruction, F.lit(after), F.when(some, F.concat(F.lit(middle), given, F.lit(after))).otherwise(""), F.lit(end), output)

    return {
        "library": F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Input:\n"), given, F.lit("\n\n### Response:\n"), output),
        "distributed": made("### Instruction:\n", "### Input:\n", "### Response:\n", "\n\n"),
        "one_line": made("### Instruction: ", "### Input: ", "### Response: ", "\n"),
        "command": made("### Instruction:\n", "### Input:\n", "### Response:\n", "\n"),
    }


def evaluation_record(rows: DataFrame) -> DataFrame:
    """(doc_id, instruction, input, reference, prompt_length): texts cut for the record, and the length of the prompt.

    A prompt of more than 2000 characters has the instruction and the first 500 of the input with '...'.
    """
    begin, end = len("### Instruction:\n"), len("\n\n### Response:\n")
    size, given = F.length("instruction"), F.length("input")
    whole = size + F.when(given > 0, given + 2).otherwise(0) + begin + end
    cut = size + F.when(given > 0, F.least(given, F.lit(500)) + 5).otherwise(0) + begin + end
    return rows.select("doc_id", F.substring("instruction", 1, 200).alias("instruction"), F.substring("input", 1, 200).alias("input"), F.substring("output", 1, 500).alias("reference"), F.when(whole > 2000, cut).otherwise(whole).alias("prompt_length"))


def first_half(column: Column) -> Column:
    """The first half of the characters, rounded down."""
    return F.substring(column, F.lit(1), F.floor(F.length(column) / 2).cast("int"))


def sentences_by_stop(column: Column) -> Column:
    """Pieces after each full stop and blank, and between lines; the blank goes."""
    return F.split(F.replace(column, F.lit(". "), F.lit(".\n")), "\n")


def config_hash(**values: Column) -> Column:
    """Eight hex digits of the MD5 of the values as JSON with sorted keys and ', ' and ': ' between; strings must need no escape."""
    parts = [F.concat(F.lit(f'"{k}": '), values[k]) for k in sorted(values)]
    return F.substring(F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))), 1, 8)


def judged(answers: DataFrame) -> DataFrame:
    """(id, overall, dimensions, suggestions) from the JSON between the first and the last brace of `answer`.

    Scores are clamped (overall to 100, dimensions to 10; without overall it is 50), at most 5 suggestions stay. Answers without JSON give no row.
    """
    shape = "overall_score double, dimensions array<struct<name:string,score:double,feedback:string>>, suggestions array<string>"
    rows = answers.select("id", F.from_json(F.nullif(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), F.lit("")), shape).alias("j")).where("j IS NOT NULL")
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c.cast("int")))
    none = F.array().cast("array<string>")
    return rows.select(
        "id", clamp(F.coalesce("j.overall_score", F.lit(50.0)), 100).alias("overall"),
        F.coalesce(F.transform("j.dimensions", lambda d: F.struct(d["name"].alias("name"), clamp(d["score"], 10).alias("score"))), F.array().cast("array<struct<name:string,score:int>>")).alias("dimensions"),
        F.slice(F.coalesce("j.suggestions", none), 1, 5).alias("suggestions"),
    )


def weights_by_part(files: DataFrame, weights: DataFrame) -> DataFrame:
    """`files` (name, weight) with the weight of the last by `place` of `weights` (place, part, value) whose part the name holds.

    `weights` is a table of settings, of a few rows: it goes along as one array.
    """
    all_ = weights.agg(F.array_sort(F.collect_list(F.struct("place", "part", "value"))).alias("_w"))
    held = lambda w: F.contains(F.col("name"), w["part"])
    return files.crossJoin(F.broadcast(all_)).withColumn("weight", F.coalesce(F.try_element_at(F.filter("_w", held), F.lit(-1))["value"], F.col("weight"))).drop("_w")


def with_session(feedback: DataFrame, sessions: DataFrame) -> DataFrame:
    """Feedback (session_id, variant_index, feedback_type) with its variant's text and strategy: by place in the session's `variants`.

    Null where the session is unknown or has fewer variants; model_version is then 'unknown' (no session) or the session's.
    """
    rows = feedback.join(sessions, "session_id", "left")
    at = F.get("variants", F.col("variant_index"))
    return rows.select("session_id", "variant_index", "feedback_type", at["text"].alias("original_text"), at["strategy"].alias("strategy"), F.coalesce("model_version", F.lit("unknown")).alias("model_version"))


def work_list(pairs: DataFrame, variants: tuple[str, ...] = ("v2", "v3")) -> DataFrame:
    """(para_id, variant) still to be made: every first pair (variant v1 or null) with each of `variants` but those that exist."""
    first = pairs.where("coalesce(variant, 'v1') = 'v1'").select("para_id", F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    return first.join(pairs.where("variant <> 'v1'").select("para_id", "variant"), ["para_id", "variant"], "left_anti")


def strategies(requested: Column, n: Column) -> Column:
    """The requested strategies in turn, `n` of them; without any the first `n` of A to D (so never more than four)."""
    default = F.slice(F.array(*map(F.lit, "ABCD")), F.lit(1), F.least(n, F.lit(4)))
    turn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(requested, F.pmod(i, F.size(requested))))
    return F.when(F.coalesce(F.size(requested), F.lit(0)) > 0, turn).otherwise(default)


def temperatures(base: Column, spread: Column, n: Column) -> Column:
    """A temperature for each of `n` variants: spread evenly about the base, between 0.1 and 1."""
    middle = F.floor(n / 2)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), base + (i - middle) * spread)), 6))


def phrases(sentence: Column, most: int) -> Column:
    """A long sentence cut at semicolons, else before conjunctions after a comma, else at commas, whatever first gives parts that fit; else by words.

    Parts are joined with blanks up to `most` tokens; the marks they were cut at are lost.
    """
    cuts = (r";\s*", r",\s+(?=and|or|but|however|therefore|moreover)", r",\s*")
    packs = []
    for cut in cuts:
        parts = F.split(sentence, cut)
        pack = chunking.packed(F.filter(F.transform(parts, text.stripped), lambda x: x != ""), most, 0, " ")
        packs.append(F.when((F.size(parts) > 1) & (F.size(pack) > 0) & F.forall(pack, lambda c: text.token_estimate(c) <= most), pack))
    step = most * 3 // 4
    words = text.parts(sentence)
    by_words = F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(step)), " ")))
    return reduce(lambda a, b: F.coalesce(a, b), [*packs, by_words])
