"""4, Quality rules: base rules on one document, and lines that many documents of a host share. Built-in functions only.

Lines are normalised (lower case, white space runs to one blank) and hashed with their host (`source`). For
each, the distinct documents of the host are counted; copies must not make their own text look like
boilerplate, so documents with the same normalised lines in the same order count as one. Lines in more than
`limit` documents are removed, and a document left with under `least_words` words or `least_share` of its
words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelock.llm.common import SPACE, stored

BLANKS = " \t\n\x0b\f\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
LIMIT, LEAST_WORDS, LEAST_SHARE = 50, 20, 0.3
#: A frequent line is met by this many groups of documents, so that none holds all of a common line's rows.
SALTS = 32


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    return F.when(trimmed(text) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed(text), SPACE))


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(line), SPACE, " "))


def row_key(docs: DataFrame) -> DataFrame:
    """_id, _row (a hash: rows of one doc_id are told apart by their text and source), _text."""
    return docs.withColumns({"_id": F.col("doc_id").cast("long"), "_text": F.coalesce(F.col("text"), F.lit("")), "_row": F.xxhash64("text", "source")})


def base_counts(docs: DataFrame) -> DataFrame:
    """_id, _row and the counts of the base rules, for docs with row_key()."""
    w = docs.select("_id", "_row", "_text", words(F.col("_text")).alias("_w"))
    at = lambda i: F.get(F.col("_w"), i)
    # A window's hash and place, by hash: equal windows stand side by side, so no pairs are compared.
    windows = F.slice(F.transform("_w", lambda x, i: F.struct(F.xxhash64(x, at(i + 1), at(i + 2)).alias("h"), i.alias("i"))), F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0)))
    w = w.withColumn("_s", F.sort_array(windows))
    s = lambda i: F.get(F.col("_s"), i)["h"]
    w = w.withColumn("_d", F.filter("_s", lambda x, i: (F.when(i > 0, s(i - 1)) == x["h"]) | (s(i + 1) == x["h"])))
    w = w.withColumn("_p", F.sort_array(F.transform("_d", lambda x: x["i"])))
    covered = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(3))))
    lines = F.filter(F.split("_text", "\n"), lambda x: trimmed(x) != "")
    w = w.withColumn("_lines", lines)
    return w.select(
        "_id",
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )


def line_rows(docs: DataFrame) -> DataFrame:
    """_id, _row, _doc (the identity that copies share), _key (host and line), _n (words): a row for each line with a word; _at is its place."""
    lines = F.filter(F.transform(F.split("_text", "\n"), normal_line), lambda x: x != "")
    d = docs.select("_id", "_row", F.col("source").cast("string").alias("_host"), lines.alias("_l")).where(F.size("_l") > 0)
    d = d.select("_id", "_row", F.xxhash64("_l").alias("_doc"), "_host", F.posexplode("_l").alias("_at", "_line"))
    return d.select("_id", "_row", "_doc", "_at", F.xxhash64(F.col("_host").isNull(), "_host", "_line").alias("_key"), F.size(F.split("_line", " ")).cast("long").alias("_n"))


def frequent_hits(docs: DataFrame, limit: int) -> DataFrame:
    """The line_rows of lines in more than `limit` documents of their host."""
    rows = line_rows(docs)
    # Distinct (line, document) first, then a count: both combine before their shuffle, whatever the line.
    frequent = rows.select("_key", "_doc").distinct().groupBy("_key").agg(F.count("*").alias("_docs")).where(F.col("_docs") > limit)
    frequent = frequent.select("_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_row"), F.lit(SALTS)).cast("int")).join(frequent, ["_key", "_salt"])


def verdicts(docs: DataFrame, hits: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """_id, _row, the base counts, base_failed, removed words (n_removed), kept; a row for each row of row_key() docs. hits: their frequent_hits."""
    # Repeated rows have the same places, so a line counts once however often its row is repeated.
    removed = hits.select("_id", "_row", "_at", "_n").distinct().groupBy("_id", "_row").agg(F.sum("_n").alias("_removed"))
    removed = removed.select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), "_removed")
    base = base_counts(docs)
    d = base.join(removed, base["_id"].eqNullSafe(removed["_id2"]) & (base["_row"] == removed["_row2"]), "left").drop("_id2", "_row2")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumns({"base_failed": failed, "n_removed": F.coalesce("_removed", F.lit(0))})
    left = F.col("n_words") - F.least("n_removed", "n_words")
    depleted = (F.col("n_removed") > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return d.withColumn("kept", ~(F.col("base_failed") | depleted)).drop("_removed")


def quality(docs: DataFrame, limit: int = LIMIT, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row for each distinct row of docs (doc_id, text, source), repeated rows as often as they come.

    Null texts have no words and fail the base rules; a null doc_id or source is a value like another (null
    sources form one host); a repeated row is one document among those that share a line, and loses its own
    lines once; ties do not occur, as lines are in more than `limit` documents or not; a very long text is one
    row's arrays in memory, its lines a row each; an empty table gives an empty result; other columns are ignored.
    """
    d = told_apart(docs)
    v = verdicts(d, frequent_hits(d, limit), least_words, least_share)
    return v.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def told_apart(docs: DataFrame) -> DataFrame:
    return row_key(docs.select("doc_id", "text", "source"))


def cleaned(docs: DataFrame, limit: int = LIMIT, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The kept rows of docs, with docs' columns; lines above the limit are gone from their texts.

    Other columns and their order stay; defined for the odd cases as `quality`. Only documents with a line
    to remove meet the list of those lines; the texts are shuffled once.
    """
    d = row_key(docs)
    found = stored(frequent_hits(told_apart(docs), limit).select("_id", "_row", "_at", "_n", "_key"), "hits")
    # Stored before it is filtered: a pushed-down filter would work out the counts' array expressions anew for each element.
    v = stored(verdicts(told_apart(docs), found, least_words, least_share).select("_id", "_row", "kept"), "verdicts")
    v = v.where("kept").select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2")).distinct()
    hits = found.groupBy("_id", "_row").agg(F.collect_set("_key").alias("_hits"))
    v = v.join(hits, v["_id2"].eqNullSafe(hits["_id"]) & (v["_row2"] == hits["_row"]), "left").select("_id2", "_row2", "_hits")
    d = d.join(v, d["_id"].eqNullSafe(v["_id2"]) & (d["_row"] == v["_row2"]))
    host = F.col("source").cast("string")
    stays = lambda line: ~F.array_contains("_hits", F.xxhash64(host.isNull(), host, normal_line(line)))
    text = F.when(F.col("_hits").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("_text", "\n"), stays), "\n"))
    return d.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns))
