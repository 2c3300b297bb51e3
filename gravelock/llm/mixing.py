"""9, Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets. Built-in functions only.

Every document draws the key -ln(u) / w, u from a digest of its doc_id and the seed, w its quality weight. A
source with budget t and s words in all takes t div s complete epochs of itself, then documents by ascending
key until their words, summed, reach the rest; of the last one a part. No task sorts a source: keys are monotone in their
bin, the bins' sums are accumulated (a source has at most BINS rows then), and only the bin in which the
budget ends is sorted. The result is one cut-off key for each source, against which every document decides
for itself, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelock.llm.common import WORD, stored

WEIGHTS, MAX_EPOCHS, SEED, BINS = 3, 3, 7, 4096


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs' columns and _size (words), _key and _mark (breaks ties between keys)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumns({"_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "_mark": F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text)))})
    # Weight: more words count for more, up to a point; odd mean word lengths for less.
    mean = F.char_length(text) / F.col("_size")
    weight = (F.col("_size") / (F.col("_size") + 50.0)) / (1.0 + F.abs(mean - 6.0) / 6.0)
    u = (F.conv(F.substring(F.md5(F.concat("_mark", F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return d.withColumn("_key", F.when(F.col("_size") > 0, -F.log(u) / weight))


def key_bin(key: Column) -> Column:
    """Which of BINS bins: monotone in the key, and near even."""
    return F.least(F.lit(BINS - 1), F.floor(BINS * (key / (key + 2.0)))).cast("int")


def targets(found: DataFrame) -> DataFrame:
    """source, source_size, target for each source of sizes(): weights 1, 2, 3, 1, ... by code point (null last) share
    100 percent of all words; a source stops at MAX_EPOCHS times its words, the excess is shared again by weight.

    Windows here see a row for each source, not for each document.
    """
    s = found.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum("_size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumns({"_nth": nth, "_w": ((nth - 1) % WEIGHTS + 1).cast("double"), "_cap": (MAX_EPOCHS * F.col("source_size")).cast("double"), "_all": F.sum("source_size").over(everything).cast("double")})
    by_room = everything.orderBy(F.col("_cap") / F.col("_w"), "_nth")
    filled = F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("_all") - filled) / F.sum("_w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumns({"_level": level, "_rank": F.row_number().over(by_room)})
    # Sources are full up to the first that the level of what is left does not fill; that level holds from there.
    open_at = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_rank", "_level"))).over(everything)
    target = F.when(open_at.isNull() | (F.col("_rank") < open_at["_rank"]), F.col("_cap")).otherwise(open_at["_level"] * F.col("_w"))
    return s.select("source", "source_size", target.alias("target"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def cutoffs(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """_source, source_size, target, _epochs, _cut: a row for each source, written to the shared folder."""
    found = sizes(docs.select("doc_id", "text", "source"), seed).select(F.col("source").cast("string").alias("source"), "_size", "_key", "_mark", key_bin(F.col("_key")).alias("_bin"))
    bins = stored(found.groupBy("source", "_bin").agg(F.sum("_size").alias("_size")), "bins")
    goal = targets(bins).withColumn("_epochs", F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    goal = stored(goal.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")), "targets")
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = bins.where("_bin IS NOT NULL").withColumn("_before", before).alias("b")
    g = goal.alias("g")
    b = b.join(g, same(F.col("b.source"), F.col("g.source"))).where("_before < _rest AND _before + b._size >= _rest")
    ends = stored(b.select(F.col("b.source").alias("_source"), F.col("_bin").alias("_end"), "_before", "_rest"), "ends")
    # The documents of the one bin in which each source's budget ends; equal documents count together.
    inside = found.join(ends, same(found["source"], ends["_source"]) & (found["_bin"] == ends["_end"])).groupBy("_source", "_key", "_mark", "_before", "_rest").agg(F.sum("_size").alias("_size"))
    so_far = F.coalesce(F.sum("_size").over(Window.partitionBy("_source").orderBy("_key", "_mark").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The one document that the budget ends in: a part of it, by words, is taken.
    inside = inside.withColumn("_so_far", F.col("_before") + so_far).where((F.col("_so_far") < F.col("_rest")) & (F.col("_so_far") + F.col("_size") >= F.col("_rest")))
    last = inside.select("_source", F.col("_key").alias("_cut"), F.col("_mark").alias("_cut_mark"), ((F.col("_rest") - F.col("_so_far")) / F.col("_size")).alias("_share"))
    e = ends.select(F.col("_source").alias("_s2"), "_end")
    out = goal.withColumnRenamed("source", "_s1").join(e, same(F.col("_s1"), F.col("_s2")), "left")
    out = out.join(last, same(F.col("_s1"), F.col("_source")), "left")
    return stored(out.select(F.col("_s1").alias("_source"), "source_size", "target", "_epochs", "_end", "_cut", "_cut_mark", "_share"), "cutoffs")


def decided(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs' columns, and _size, source_size, target, _times and _share: the mix takes the document _times whole, and this share of it."""
    cut = cutoffs(docs, seed)
    d = sizes(docs, seed)
    d = d.join(cut, same(d["source"].cast("string"), cut["_source"]), "left")
    at_cut = (F.col("_key") == F.col("_cut")) & (F.col("_mark") == F.col("_cut_mark"))
    up_to = (F.col("_key") < F.col("_cut")) | ((F.col("_key") == F.col("_cut")) & (F.col("_mark") < F.col("_cut_mark")))
    more = F.coalesce((key_bin(F.col("_key")) < F.col("_end")) | up_to, F.lit(False))
    share = F.when(F.coalesce(at_cut, F.lit(False)), F.col("_share")).otherwise(0.0)
    return d.withColumns({"_times": F.when(F.col("_size") > 0, F.col("_epochs") + more.cast("long")).otherwise(0), "_share": share})


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, size, source_size, target, taken.

    Null texts have size 0 and are never taken; null sources are one source, the last; a null doc_id draws
    by its text; repeated rows (one doc_id) draw one key and are taken or left together; equal keys go by doc_id;
    a very long text counts as its words, and is taken in part if the budget ends in it; an empty table gives an
    empty result; other columns are ignored. Reruns agree, as keys depend on doc_id and seed only.
    """
    d = decided(docs.select("doc_id", "text", "source"), seed)
    taken = F.col("_size") * F.col("_times") + F.floor(F.col("_size") * F.col("_share") + 1e-6).cast("long")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))


def sampled(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows that the mix takes, each as often as it does, with docs' columns; whole documents, so that
    the one in which a source's budget ends stays if at least half of it does."""
    d = decided(docs, seed).withColumn("_n", F.col("_times") + (F.col("_share") >= 0.5).cast("int")).where("_n > 0")
    return d.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*docs.columns)
