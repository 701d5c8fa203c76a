"""The pipeline on a small corpus, stage by stage against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
from test_llm_operators import SCHEMA, brute_lines, brute_near, brute_repeats, check_packing, prose

from marginalia.llm import common


def corpus():
    rng = random.Random(21)
    out = []
    for i in range(80):
        out.append("\n".join(prose(rng, 40, 10**6) for _ in range(3)))
    shared = prose(rng, 55, 10**6)
    out += [out[3], out[4] + " tail", prose(rng, 100, 10**6) + " " + shared, prose(rng, 100, 10**6) + " " + shared, "short", None, ""]
    out.append(prose(rng, 80, 10**6) + " password=f3a9c1d7b2e84f60a1c5d9e7")
    return out


def test_stages(spark, tmp_path):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), i, "p") for i, t in enumerate(texts)], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    now = {i: t for i, t in enumerate(texts)}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == docs.columns
            got = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_rules":
            now = {i: now[i] for i, v in brute_lines([(i, t, f"s{i % 3}") for i, t in now.items()]).items() if v[6]}
        elif name == "minhash_near_dedup":
            now = {i: now[i] for i, v in brute_near(list(now.items()), 5).items() if v[2]}
        elif name == "substring_dedup":
            want = brute_repeats(list(now.items()))
            assert sum(v[1] for v in want.values()) > 50 and set(got) == set(now)
            assert all(brute_repeats([(i, got[i])])[i][0] == v[0] - v[1] for i, v in want.items())
            now = got
        elif name == "secret_scans":
            now = {i: t.replace("password=f3a9c1d7b2e84f60a1c5d9e7", "[secret]") for i, t in now.items()}
        else:
            check_packing(out.collect(), now, 4096)
            break
        assert got == now
        docs = out
    common.clear_scratch()


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    common.clear_scratch()
