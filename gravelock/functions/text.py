"""Labels and names."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_words(text: Column, n: int = 20) -> Column:
    return F.concat_ws(" ", F.slice(F.split(text, " "), 1, n))


def exploit_label(id_: Column, text: Column, n: int = 20) -> Column:
    return F.concat(id_.cast("string"), F.lit(": "), first_words(text, n))


def sanitised(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("_")))


def random_colour(key: Column, seed: int = 1) -> Column:
    part = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(256)).cast("string")
    return F.concat(F.lit("rgb("), part(0), F.lit(","), part(1), F.lit(","), part(2), F.lit(")"))
