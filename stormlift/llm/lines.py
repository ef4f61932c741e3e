"""Line dedup: long lines that many documents share are dropped from all but one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlift.llm.common import BLANKS, ascii_lower, fresh, keep, query, table, text_of


def line_keys(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``key``: the line without outer blanks, A-Z lower-cased."""
    return lines.withColumn("key", ascii_lower(F.btrim(F.col(line), F.lit(BLANKS))))


def dropped_positions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, digest, drop): for every text that loses lines, their positions from 0 in any order.

    ``digest`` is a hash of the text, so that rows which share an id keep their own positions. Lines
    are written once, as 128-bit hashes. The documents that hold a line are counted from distinct
    (line, document) pairs, so a line of a third of all documents is counted map-side.
    """
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("digest"), F.split(text_of(text_col), "\n", -1).alias("split"))
    lines = texts.select("id", "digest", F.posexplode("split").alias("pos", "line"))  # the hash is a text's, not taken again for every line
    lines = (
        line_keys(lines.where(F.char_length("line") >= min_chars))
        .where(F.char_length("key") >= min_chars)
        .select("id", "digest", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    lines = keep(lines, "lines")
    common = (
        lines.groupBy("h1", "h2", "id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    common = keep(common, "common-lines")  # read again, it is dealt out anew, and adaptive execution may split the hot lines
    gone = lines.join(common.hint("merge"), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("id", "digest").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``df`` with common long lines dropped from its texts, and the counts of lines.

    A text splits at newlines; a line's key is the line without outer ASCII blanks, A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines, except in the largest id that holds the key. The other lines stay, joined as before.

    Defined cases: null and empty texts are one empty line and come back empty; rows with a null id
    count as one document, smaller than all others; rows that share an id count once for a line, and
    each keeps its own text; a document whose lines all go becomes empty; an empty table stays empty.
    All other columns pass through, whatever their names.

    Returns the columns of ``df``, then (lines, dropped, row key) named by ``counted_columns(df)``.
    """
    n_lines, n_dropped = counted_columns(df)
    at, digest, drop = fresh(df, "line_id"), fresh(df, "line_digest"), fresh(df, "line_drop")
    gone = dropped_positions(df, id_col, text_col, min_chars, min_docs).select(F.col("id").alias(at), F.col("digest").alias(digest), F.col("drop").alias(drop))
    text = text_of(text_col)
    joined = df.join(gone, df[id_col].eqNullSafe(gone[at]) & (F.xxhash64(text) == gone[digest]), "left")
    lines = F.split(text, "\n", -1)

    def without(held):
        stay = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col(drop))
        return F.array_join(F.transform(stay, lambda p: F.get(held, p)), "\n")

    once = F.get(F.transform(F.array(lines), without), 0)  # bound to a name, the text is split once and not for every line
    kept = F.when(F.col(drop).isNull(), text).otherwise(once)
    counts = {n_lines: F.size(lines).cast("long"), n_dropped: F.coalesce(F.array_size(drop), F.lit(0)).cast("long")}
    out = joined.withColumns(counts).withColumn(text_col, kept)
    return out.select(*(f"`{c}`" for c in df.columns), n_lines, n_dropped)


def counted_columns(df: DataFrame) -> tuple[str, str]:
    """The names of the two counts that ``dedup_lines`` adds to ``df``."""
    return fresh(df, "n_lines"), fresh(df, "n_dropped")


@query(
    "op5_line_dedup",
    """
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents
    ), k AS (
      SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l
    ), c AS (
      SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), m AS (
      SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key
    )
    SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
