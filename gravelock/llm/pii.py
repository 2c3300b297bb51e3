"""7, PII: plain patterns for four kinds, and terms that give the protected entities away. Built-in functions only.

The values found by the patterns are the protected entities. All counts are of documents (rows): n(x) have the
entity x, n(t) the term t, n(x,t) both, anywhere in their texts, N there are. A term discloses an entity if
PMI(t; x) >= ALPHA * IC(x), where IC(x) = -log2 p(x), p(x) = n(x) / N, and PMI(t; x) = log2 p(x|t) / p(x), with
p(x|t) = (n(x,t) + PRIOR p(x)) / (n(t) + PRIOR): a pair seen once or twice counts, but less than its face value.
A word that hardly any other document has thus discloses, whatever its distance from the entity: whoever knows it
has found the document. Every occurrence of a disclosing term in a document with its entity becomes a span of
kind `term`; `sanitised` generalises entities to their kind and removes the terms. Terms come from documents with
an entity only, so a document without one is untouched.

Entities that are in exactly the same documents have the same counts, so they are one class: a directory page of
thousands of entities and words is one class against its words, not all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelock.llm.common import stored

#: The patterns asked for; possessive, so that Java neither backtracks nor recurses on long runs. At a start
#: that a longer run would have taken, the look-behinds skip what cannot match anyway.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone", "term")
#: Stands for the characters of entities while terms are looked for; a word that touches one is no term.
BLANK = "\uffff"
TERM = rf"(?<![\p{{L}}\p{{N}}_{BLANK}])[\p{{L}}\p{{N}}_]{{2,}}+(?!{BLANK})"
WORDS = r"[\p{L}\p{N}_]{2,}+"
ALPHA, PRIOR = 0.8, 1.0
SPAN = "struct<k:int,s:int,e:int>"
SALTS = 16


def located(text: Column, pattern: str, needs: Column) -> Column:
    """array of (s, e, v): the matches in order, with code points from s to before e; looked for where `needs` holds."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The gaps between matches give their places.
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.char_length(x["g"])
        e = s + F.char_length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))).alias("out"))

    placed = F.aggregate(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m")), start, step, lambda a: a["out"])
    return F.when(needs, placed).otherwise(none)


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with _base: array of (k, s, e, v), k the place in KINDS, by k and start."""
    t = F.col("_text")
    digit = F.rlike(t, F.lit(r"[0-9]"))
    d = docs.withColumns({
        "_0": located(t, EMAIL, F.contains(t, F.lit("@")) & F.rlike(t, F.lit(r"@[A-Za-z0-9-]"))),
        "_1": located(t, IP, F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]"))),
        "_2": located(t, CARD, F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}"))),
        "_3": located(t, PHONE, F.contains(t, F.lit("+")) & digit),
    })
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    good = {
        0: lambda x: F.lit(True),
        1: lambda x: F.rlike(x["v"], F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        2: lambda x: F.char_length(digits(x["v"])).between(16, 19) & luhn(digits(x["v"])),
        3: lambda x: F.char_length(digits(x["v"])).between(8, 15),
    }
    value = {0: F.lower, 1: lambda v: v, 2: digits, 3: digits}

    def kind(k: int) -> Column:
        return F.transform(F.filter(f"_{k}", good[k]), lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), value[k](x["v"]).alias("v")))

    # Exploding an array of one keeps later filters on _base from being pushed below, where they would search the texts again.
    return d.withColumn("_base", F.explode(F.array(F.concat(*map(kind, range(4)))))).drop("_0", "_1", "_2", "_3")


def keyed(docs: DataFrame) -> DataFrame:
    """_id, _row (a hash: tells rows of one doc_id apart) and _text."""
    return docs.withColumns({"_id": F.col("doc_id").cast("long"), "_text": F.coalesce(F.col("text"), F.lit("")), "_row": F.xxhash64("text")})


def blanked(text: Column, spans: Column) -> Column:
    """text with the characters of the spans (k, s, e, v) blanked out."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(F.lit(0), x["s"] - a["at"]))
        e = F.greatest(a["at"], x["e"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(gap, F.repeat(F.lit(BLANK), e - F.greatest(a["at"], x["s"])))).alias("out"))

    by_start = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    return F.aggregate(by_start, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))


def entity_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each different row that has an entity: (_id, _row, _rows (how often it is there), _entities (digests); and
    a row for each term outside the entities: _id, _row, _term, s, e)."""
    found = base_spans(docs.select("_id", "_row", "_text")).where(F.size("_base") > 0)
    found = found.select("_id", "_row", F.transform("_base", lambda b: F.xxhash64(b["k"], b["v"])).alias("_entities"), blanked(F.col("_text"), F.col("_base")).alias("_rest"))
    found = stored(found.groupBy("_id", "_row").agg(F.count("*").alias("_rows"), F.first("_entities").alias("_entities"), F.first("_rest").alias("_rest")), "entity_texts")
    # The lengths of words and of what stands between them, summed in order, give the places.
    words, gaps = F.regexp_extract_all("_rest", F.lit(TERM), F.lit(0)), F.split("_rest", TERM, -1)
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(words)).alias("g"), words.alias("m"))
    t = found.select("_id", "_row", F.posexplode(parts).alias("_at", "_p"))
    t = t.select("_id", "_row", "_at", F.char_length("_p.g").alias("_gap"), F.char_length("_p.m").alias("_len"), F.xxhash64(F.lower("_p.m")).alias("_term"))
    e = F.sum(F.col("_gap") + F.col("_len")).over(Window.partitionBy("_id", "_row").orderBy("_at")).cast("int")
    return found.drop("_rest"), stored(t.select("_id", "_row", "_term", (e - F.col("_len")).alias("s"), e.alias("e")), "terms")


def told_terms(found: DataFrame, places: DataFrame, docs: DataFrame, alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """_id, _row, _term: the disclosing terms of each document with an entity. found, places: entity_texts of docs."""
    key = F.struct("_id", "_row")
    ents = found.select("_id", "_row", "_rows", F.explode(F.array_distinct("_entities")).alias("_entity"))
    # Entities of the same documents are one class.
    of = ents.groupBy("_entity").agg(F.sum("_rows").alias("_x"), F.count("*").alias("_n"), F.bit_xor(F.xxhash64(key)).alias("_a"), F.bit_xor(F.xxhash64(F.lit(7), key)).alias("_b"))
    of = of.select("_entity", "_x", F.xxhash64("_x", "_n", "_a", "_b").alias("_class"))
    classes = stored(ents.join(of, "_entity").select("_id", "_row", "_rows", "_class", "_x").distinct(), "classes")
    terms = places.select("_id", "_row", "_term").distinct()
    c, t = classes.alias("c"), terms.alias("t")
    both = c.join(t, F.col("c._id").eqNullSafe(F.col("t._id")) & (F.col("c._row") == F.col("t._row")))
    both = stored(both.select("c._id", "c._row", "_rows", "_class", "_x", "_term"), "both")
    pairs = both.groupBy("_class", "_term").agg(F.sum("_rows").alias("_both"), F.first("_x").alias("_x"))
    # A row for each different term of a document; they are combined before their shuffle.
    in_text = docs.select(F.explode(F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("_text", F.lit(WORDS), F.lit(0))), lambda w: F.xxhash64(F.lower(w))))).alias("_term"))
    counts = in_text.groupBy("_term").agg(F.count("*").alias("_t"))
    total = docs.agg(F.count("*").cast("double").alias("_all"))  # one row
    told = pairs.join(counts, "_term").join(F.broadcast(total))
    p = F.col("_x") / F.col("_all")
    given = (F.col("_both") + prior * p) / (F.col("_t") + prior)
    told = told.where((p < 1) & (F.log2(given / p) >= alpha * -F.log2(p)))
    # Both sides are dealt by salt as well: a class of a third of all documents is SALTS groups.
    told = told.select("_class", "_term", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    hit = both.withColumn("_salt", F.pmod(F.xxhash64("_id", "_row"), F.lit(SALTS)).cast("int")).join(told, ["_class", "_term", "_salt"])
    return hit.select("_id", "_row", "_term").distinct()


def term_spans(docs: DataFrame) -> DataFrame:
    """_id, _row, _terms (array of (k, s, e)): the disclosing terms of the documents that have any. docs: keyed()."""
    found, places = entity_texts(docs)
    p, t = places.alias("p"), told_terms(found, places, docs).alias("t")
    hit = p.join(t, F.col("p._id").eqNullSafe(F.col("t._id")) & (F.col("p._row") == F.col("t._row")) & (F.col("p._term") == F.col("t._term")))
    return hit.groupBy("p._id", "p._row").agg(F.sort_array(F.collect_list(F.struct(F.lit(4).alias("k"), "p.s", "p.e"))).alias("_terms"))


def with_terms(d: DataFrame, terms: DataFrame) -> DataFrame:
    t = terms.select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), "_terms")
    d = d.join(t, d["_id"].eqNullSafe(t["_id2"]) & (d["_row"] == t["_row2"]), "left").drop("_id2", "_row2")
    return d.withColumn("_terms", F.coalesce("_terms", F.array().cast(f"array<{SPAN}>")))


def shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts are empty and have no spans; a null doc_id is a value like another; repeated rows each get
    their row and each count as a document; a very long text is one row's arrays in memory; an empty table gives
    an empty result; other columns are ignored. Texts are never shuffled, but for the words of those with an
    entity; what is counted over the corpus is combined before each shuffle.
    """
    d = keyed(docs.select("doc_id", "text"))
    base = base_spans(d).select("_id", "_row", F.transform("_base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))).alias("_base"))
    d = with_terms(base, term_spans(d))
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    return d.select(F.col("_id").alias("doc_id"), *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(shown(F.col("_base")).cast("binary"), 256).alias("base_sha256"), shown(F.concat("_base", "_terms")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """All rows of docs with docs' columns: in their texts entities stand as <kind> and disclosing terms are gone.

    Where spans overlap, the first takes all of them. Documents without a span keep their text as it is, and
    are not shuffled.
    """
    d = base_spans(keyed(docs)).withColumn("_base", F.transform("_base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    d = stored(d, "searched")
    clean = d.where(F.size("_base") == 0).select(*docs.columns)
    d = with_terms(d.where(F.size("_base") > 0), term_spans(keyed(docs)))
    by_start = F.sort_array(F.transform(F.concat("_base", "_terms"), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    tags = F.array(*[F.lit(f"<{k}>") for k in KINDS[:4]], F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(F.col("_text"), a["at"] + 1, x["s"] - a["at"])
        fresh = F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(gap, F.get(tags, x["k"]))).alias("out"))
        return F.when(x["s"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))

    whole = F.aggregate(by_start, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("_text"), a["at"] + 1, F.char_length("_text"))))
    return clean.unionByName(d.select(*(whole.alias("text") if c == "text" else F.col(c) for c in docs.columns)))
