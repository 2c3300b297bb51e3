"""Quality rules, personal data and mixing against DuckDB and plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import regex
from llm_cases import AWKWARD, frame

from gravelock.llm import oracles
from gravelock.llm.mixing import mix, sampled
from gravelock.llm.pii import personal_data, sanitised
from gravelock.llm.quality import cleaned, quality


def by_duckdb(sql, rows):
    documents = pd.DataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64", "text": "string", "source": "string"})
    return sorted(query(sql, documents), key=str)


def query(sql, documents):
    con = duckdb.connect()
    con.register("documents", documents)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    return [tuple(dict(zip(names, r, strict=True)).items()) for r in found.fetchall()]


def rows_of(df, sql_rows):
    names = [k for k, _ in sql_rows[0]] if sql_rows else df.columns
    return sorted((tuple((n, r[n]) for n in names) for r in df.collect()), key=str)


LINES = "All rights of this page are reserved by its owners."
BOILER = [(100 + i, "\n".join([f"Own words of page {i} " + " ".join(f"w{i}x{j}" for j in range(60)), LINES, f"and the end {i}"]), "h") for i in range(60)]
COPIES = [(300 + i, "One text, copied often.\n" + " ".join(f"c{j}" for j in range(60)) + "\nLast line of it.", "h") for i in range(80)]
DEPLETED = [(500, "\n".join([LINES] * 4 + ["x " + " ".join(f"q{j}" for j in range(12))]), "h")]


def test_quality(spark):
    rows = AWKWARD + BOILER + COPIES + DEPLETED + [(600, "a b c d\n" * 30 + "#$%", "h"), (601, "a b c a b c a b", None)] + [BOILER[0]] * 3 + [(100, BOILER[7][1], "h")]
    want = by_duckdb(oracles.QUALITY, rows)
    got = quality(frame(spark, rows))
    assert rows_of(got, want) == want
    rows = rows[:-4]
    got = quality(frame(spark, rows))
    kept = {r.doc_id: r for r in got.collect()}
    assert all(kept[r[0]].kept for r in BOILER + COPIES) and not kept[500].kept and kept[100].n_removed == 10 and kept[300].n_removed == 0
    assert quality(frame(spark, [])).count() == 0 and quality(frame(spark, AWKWARD)).count() == len(AWKWARD)
    texts = {r.doc_id: r.text for r in cleaned(frame(spark, rows)).collect()}
    assert cleaned(frame(spark, rows)).columns == frame(spark, rows).columns and cleaned(frame(spark, [])).count() == 0
    assert texts[100] == BOILER[0][1].replace(LINES + "\n", "") and texts[300] == COPIES[0][1] and 500 not in texts
    assert set(texts) == {i for i, r in kept.items() if r.kept}


def test_quality_counts_different_pages_and_repeated_rows(spark):
    shared = [f"Shared line {j} of this host." for j in range(10)]
    own = lambda i, n: " ".join(f"p{i}x{j}" for j in range(n))
    # 200 pages share ten lines, so most have the same least and greatest digest.
    rows = [(i, "\n".join([*shared, own(i, 60)]), "h") for i in range(200)]
    rows += [(900, "\n".join([*shared, own(900, 45)]), "h")] * 2
    got = quality(frame(spark, rows)).collect()
    assert len(got) == 202 and {r.n_removed for r in got} == {60} and all(r.kept for r in got)
    assert rows_of(quality(frame(spark, rows)), want := by_duckdb(oracles.QUALITY, rows)) == want


def test_mixing(spark):
    rows = AWKWARD + [(700 + i, "w " * (i * 37 % 91), f"s{i % 5}") for i in range(200)]
    want = by_duckdb(oracles.MIXING, rows)
    d = frame(spark, rows)
    assert rows_of(mix(d), want) == want
    got = pd.DataFrame(mix(d).collect(), columns=["doc_id", "size", "source_size", "target", "taken"])
    assert (got["taken"] <= 3 * got["size"]).all() and abs(got["taken"].sum() - got["size"].sum()) < 10
    assert mix(frame(spark, [])).count() == 0 and sampled(frame(spark, [])).count() == 0
    assert mix(frame(spark, AWKWARD)).count() == len(AWKWARD)
    out = sampled(d)
    assert out.columns == d.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for r in got.itertuples():
        if r.size and r.doc_id == r.doc_id:
            assert abs(times.get(int(r.doc_id), 0) / sum(got["doc_id"] == r.doc_id) - r.taken / r.size) <= 0.5


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = (("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))), ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in tests for m in p.finditer(text or "") if ok(m)]


ODD = [
    "mail a.b+c%d@ex-ample.co.uk, x@y and q@b.c%d@e.f z@a..b @x.y é😀 me@host.org",
    "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.02.3.255 1.2.3 999.1.2.3.4 12.34.56.78a",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559 4 1 1 1 " + "4" * 5000,
    "call +49 (0)30 1234-567 or +1.2 or ++4912345678 +123456789012345678 +1-800-555-0199.",
    "+4111111111111111 1.1.1.1@a.b 4111111111111111@x.org",
    "." * 3000 + "a@b" + ".c" * 6000,
    "1." * 5000,
    "x" * 50_000 + " a@",
]


def test_personal_data_base_and_odd_cases(spark, sf_dir):
    rows = AWKWARD + [(800 + i, t) for i, t in enumerate(ODD)]
    rows += [(10_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, personal_data(frame(spark, rows)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        spans = base(t)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, *(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")), hashlib.sha256(shown.encode()).hexdigest(), shown))
    want.sort(key=str)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert all(g[6].startswith(w[6]) and set(x.split(":")[0] for x in g[6].split(",") if x) <= {"email", "ip", "card", "phone", "term"} for g, w in zip(got, want, strict=True))
    assert personal_data(frame(spark, [])).count() == 0


WORD = regex.compile(r"[\p{L}\p{N}_]{2,}+")


def entities(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    value = {"email": str.lower, "ip": str, "card": digits, "phone": digits}
    return {(k, value[k]((text or "")[a:b])) for k, a, b in base(text)}


def told(rows):
    """The `term` spans of every row, by counts of documents in dictionaries."""
    n = len(rows)
    spans = [[(a, b) for _, a, b in base(t)] for _, t in rows]
    words = [[(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(t or "")] for _, t in rows]
    ents = [entities(t) for _, t in rows]
    x, t, both = Counter(), Counter(), Counter()
    free = []
    for e, w, s in zip(ents, words, spans, strict=True):
        x.update(e)
        t.update({v for _, _, v in w})
        free.append([(a, b, v) for a, b, v in w if not any(c < b and a < d for c, d in s)] if e else [])
        both.update((i, v) for i in e for v in {v for _, _, v in free[-1]})
    out = []
    for e, w in zip(ents, free, strict=True):
        p = {i: x[i] / n for i in e}
        ok = lambda i, v: x[i] < n and math.log2((both[i, v] + p[i]) / (t[v] + 1) / p[i]) >= -0.8 * math.log2(p[i])  # noqa: B023, E731
        out.append([(a, b) for a, b, v in w if any(ok(i, v) for i in e)])
    return out


def term_rows(df):
    return sorted(((r.doc_id, [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term")]) for r in df.collect()), key=str)


def test_disclosing_terms_by_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = [r[:2] for r in AWKWARD] + [(800 + i, t) for i, t in enumerate(ODD)] + [(None, "Qwertz a@b.cd"), (None, "Qwertz a@b.cd"), (5, "Other q@b.cd Qwertz")]
    page = [(900, " ".join(f"Name{i} mail{i}@page.example" for i in range(300))), (901, "Name7 Name8")]
    for rows in (docs, odd + page, docs[:50] + odd + page):
        want = sorted(((i, s) for (i, _), s in zip(rows, told(rows), strict=True)), key=str)
        assert term_rows(personal_data(frame(spark, rows))) == want
    assert sum(len(s) for s in told(docs))


def test_planted_terms_are_found_wherever_they_stand(spark):
    rng = random.Random(5)
    common = [f"word{i}" for i in range(400)]
    text = lambda n: rng.choices(common, k=n)
    rows = [(i, " ".join(text(150))) for i in range(400)]
    planted = {}
    for i in range(40):  # a name and an address, far apart, in one to four documents
        for j in range(1 + i % 4):
            words = text(200)
            words[3], words[180] = f"Zorbulon{i}", f"person{i}@mail.example"
            rows.append((1000 + 10 * i + j, " ".join(words)))
            planted[1000 + 10 * i + j] = f"Zorbulon{i}"
    text_of = dict(rows)
    got = {i: {text_of[i][a:b] for a, b in s} for i, s in term_rows(personal_data(frame(spark, rows)))}
    caught = sum(got[i] == {t} for i, t in planted.items())
    assert caught >= 0.9 * len(planted), caught
    assert not any(got[i] for i, _ in rows[:400])
    out = {r.doc_id: r.text for r in sanitised(frame(spark, rows)).collect()}
    assert all(out[i] == t for i, t in rows[:400])
    assert out[1000] == text_of[1000].replace("Zorbulon0", "").replace("person0@mail.example", "<email>")


def test_sanitised_odd_cases(spark):
    assert sanitised(frame(spark, AWKWARD)).count() == len(AWKWARD)
    assert {(r.doc_id, r.text) for r in sanitised(frame(spark, AWKWARD)).collect()} == {(i, t) for i, t, _ in AWKWARD}
    text = "é 1.1.1.1@a.b then +49 30 1234567" + " é" * 3
    assert sanitised(frame(spark, [(1, text)])).first().text == "é <email> then <phone>" + " é" * 3
