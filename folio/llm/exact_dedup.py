"""Exact dedup by deterministic block naming.

Each text is cut into blocks of fixed size. Equal blocks get one integer name:
the rows of a hash bucket are sorted by the block and numbered densely, so the
name is (bucket, rank). Adjacent names of a document are then named in pairs by
the same rule, round after round, until one name is left. Texts of as many
blocks have one name if and only if they are equal byte by byte: names come from
sorting the contents, never from a digest, so there are no collisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import by_ids, fresh, stored

#: Bytes of a block.
BLOCK = 4096


def _buckets(df: DataFrame) -> int:
    """Buckets to sort in: many times the shuffle's partitions, so each is small."""
    return 64 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _named(df: DataFrame, content: list[str], buckets: int, keep: list[str]) -> DataFrame:
    """`keep` and the integer `name`, equal for equal contents."""
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*content), F.lit(buckets)).cast("long"))
    rank = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*content))
    return bucketed.select(*keep, (F.col("_bucket") * F.lit(1 << 40) + rank).alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, row, digest, blocks, name): texts are equal iff (blocks, name) is.

    `row` numbers the input's rows, so rows that repeat a doc_id stay apart;
    `digest` only tells the rows of one id apart. Null
    texts and null ids have no row. The empty text is one empty block.
    """
    buckets = _buckets(docs)
    data = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("binary").alias("data"), F.xxhash64(text_col).alias("digest")
    ).where("doc_id IS NOT NULL AND data IS NOT NULL")
    size = F.octet_length("data")
    cut = data.withColumn("blocks", F.greatest(F.lit(1), F.ceil(size / F.lit(block))).cast("int")).select(
        "doc_id", "row", "digest", "blocks", F.posexplode(F.expr(f"transform(sequence(0, blocks - 1), i -> substring(data, i * {block} + 1, {block}))")).alias("pos", "block")
    )
    names = stored(_named(cut, ["block"], buckets, ["doc_id", "row", "digest", "blocks", "pos"]), "names")
    most = names.agg(F.max("blocks")).first()[0] or 1
    done = names.where("blocks = 1").select("doc_id", "row", "digest", "blocks", "name")
    rest = names.where("blocks > 1")
    left = most
    while left > 1:
        halves = rest.groupBy("doc_id", "row", "digest", "blocks", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos").bitwiseAND(1) == 0, F.col("name"))).alias("one"),
            F.coalesce(F.max(F.when(F.col("pos").bitwiseAND(1) == 1, F.col("name"))), F.lit(-1)).alias("two"),
        )
        rest = _named(halves, ["one", "two"], buckets, ["doc_id", "row", "digest", "blocks", "pos"])
        left = (left + 1) // 2
    return done.unionByName(rest.select("doc_id", "row", "digest", "blocks", "name")) if most > 1 else done


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Every redundant copy: (doc_id, keep_id), keep_id being the least id of that text.

    Null ids have no row, an empty table has none; other columns, whatever their names, aren't
    read. Null texts are copies of nothing; empty texts are copies of each other. Rows
    that repeat an id with the same text give no row, as the id is kept.
    """
    found = identities(docs, id_col, text_col, block)
    keep = F.min("doc_id").over(Window.partitionBy("blocks", "name"))
    return found.select("doc_id", keep.alias("keep_id")).where("doc_id <> keep_id").distinct()


def without_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`docs` with one row for each text, the one of least doc_id; columns as given.

    Rows with a null text or null id stay. Of rows that repeat both id and text
    one stays; an id that has several texts keeps those that are not copies (its texts, and those
    alone, are told apart by a 64-bit digest when their names are brought back to the rows).
    """
    found = identities(docs, block=block)
    keep = F.min("doc_id").over(Window.partitionBy("blocks", "name"))
    marked = stored(found.select("doc_id", "digest", (F.col("doc_id") != keep).alias("copy")), "marked")
    rows = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("copy"))
    plain = stored(rows.where("n = 1 AND copy").select("doc_id"), "dropped")
    again = stored(rows.where("n > 1").select("doc_id"), "repeated")
    kept = by_ids(docs, plain, "doc_id", "left_anti")
    if again.isEmpty():
        return kept
    # ids of several rows: decided by id and text, on those rows alone
    twice = by_ids(docs, again, "doc_id", "left_semi")
    (digest,) = fresh(docs, "digest_of_text")
    lost = stored(marked.where("copy").join(again, "doc_id", "left_semi").select("doc_id", F.col("digest").alias(digest)).distinct(), "lost")
    texts = twice.where("text IS NOT NULL").dropDuplicates(["doc_id", "text"]).withColumn(digest, F.xxhash64("text"))
    texts = texts.join(lost, ["doc_id", digest], "left_anti").select(*docs.columns)
    return by_ids(kept, again, "doc_id", "left_anti").unionByName(twice.where("text IS NULL")).unionByName(texts)


SQL = """
SELECT doc_id, keep_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
WHERE doc_id <> keep_id GROUP BY ALL
"""
