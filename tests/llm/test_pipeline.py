import numpy as np
from llm_cases import PLAIN
from test_native import base

import corpus_pipeline
from gravelock.llm.common import scratch


def staged(spark, docs):
    out = {}
    for name, f in corpus_pipeline.STAGES:
        path = scratch(spark, name)
        f(spark, docs, "none").write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages(spark, sf_dir):
    rng = np.random.default_rng(1)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 9000, n)]
    rows, copies, near = [], set(), set()
    for i in range(40):
        rows.append((i, " ".join(text(120 + i)), "en", f"s{i % 3}", 0))
    for i in range(10):
        rows.append((100 + i, rows[i][1], "en", "s0", 0))
        copies.add(100 + i)
        words = rows[i][1].split()
        words[60] = "edited"
        rows.append((200 + i, " ".join(words), "en", "s1", 0))
        near.add(200 + i)
    rows += [(300 + i, " ".join(text(80)) + f" write to user{i}@mail.example or +49 30 123456{i} now", "en", "s2", 0) for i in range(5)]
    rows += [(400, "too short", "en", "s0", 0), (401, None, "en", None, 0), (402, "again and again " * 60, "en", "s0", 0)]
    docs = spark.createDataFrame(rows, PLAIN)
    out = staged(spark, docs)
    ids = {k: {r.doc_id for r in d.select("doc_id").collect()} for k, d in out.items()}
    first = {r[0] for r in rows}
    assert ids["quality"] == first - {400, 401, 402}
    assert ids["near_dedup"] == ids["quality"] - copies - near
    assert ids["personal_data"] == ids["near_dedup"]
    for name in ("quality", "near_dedup", "personal_data", "mixing"):
        assert out[name].columns == docs.columns
    before = {r.doc_id: r.text for r in out["near_dedup"].collect()}
    after = {r.doc_id: r.text for r in out["personal_data"].collect()}
    for i, t in after.items():
        assert not base(t) and (t == before[i]) == (not base(before[i]))
    assert ids["mixing"] <= ids["personal_data"] and out["mixing"].count() >= 0.8 * len(after)
    pieces = out["packing"]
    assert ids["packing"] == ids["mixing"] and pieces.agg({"offset": "max"}).first()[0] < 4096


def test_run_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([], PLAIN).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
