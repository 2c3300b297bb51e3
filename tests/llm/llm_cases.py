"""Small tables with the awkward cases that every operator must take."""

from pyspark.sql import types as T

#: documents, with columns whose names clash with those the operators make.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("size", "fingerprint", "kept", "h", "key", "line", "component_id", "spans", "length")])
PLAIN = T.StructType(SCHEMA.fields[:5])


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, *["x"] * 9) for r in rows], SCHEMA)


LONG = " ".join(f"word{i % 997} Ünit{i % 13}" for i in range(30_000))
AWKWARD = [
    (1, "One two three. It's 42 o'clock!", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n ", "b"),
    (5, "One two three. It's 42 o'clock!", "b"),
    (5, "One two three. It's 42 o'clock!", "b"),
    (None, "no id at all", None),
    (6, LONG, "c"),
    (7, "é   İstanbul ΣΑΣ ﬁ <|endoftext|>x <|startoftext|> 漢字 😀 ½²", "c"),
    (8, "\u0000\u0085  a​b", "c"),
    (-9, "aaaa " * 300, "c"),
]
