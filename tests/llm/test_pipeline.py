"""The pipeline and each of its stages on a small corpus, against brute force."""

from collections import Counter

import numpy as np

import corpus_pipeline
from folia.llm import decontaminate, mixing


def _shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(11)
    passage = [f"bench{chr(97 + k)}" for k in range(16)]
    texts, toxic, leaked = {}, set(), set()
    for i in range(600):
        words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 600, 60)]
        if i % 5 == 0:
            words[3] = "nastyish"
            toxic.add(i)
        if i % 50 == 7:
            words[10:26] = passage
            leaked.add(i)
        texts[i] = " ".join(words)
    for i in range(1, 600, 31):
        if i not in toxic:
            texts[1000 + i] = texts[i] + " tail"
    leaked |= {1000 + i for i in leaked if 1000 + i in texts}
    rows = [(i, t, "en", "pq"[i % 2], len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/after-{name}")
        docs = spark.read.parquet(f"{tmp_path}/after-{name}")
        kept[name] = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else docs.collect()
        if name == "mixing":
            taken = sum(r.taken for r in mixing.op3_mixing(before).collect())
            assert sum(len(t.split()) for _, t in kept[name]) == taken and all(texts[i] == t for i, t in kept[name])
    assert sorted(kept["toxicity"]) == sorted((i, t) for i, t in texts.items() if i not in toxic)
    left, sets = [], [(i, _shingles(t)) for i, t in sorted(texts.items()) if i not in toxic]
    for k, (i, s) in enumerate(sets):
        if not any(len(s & o) >= 0.8 * len(s | o) for _, o in sets[:k]):
            left.append(i)
    assert sorted(i for i, _ in kept["near_dedup"]) == left and len(left) < len(sets)
    assert sorted(i for i, _ in kept["decontamination"]) == [i for i in left if i not in leaked]
    assert decontaminate.WINDOW <= len(passage)
    mixed = Counter(i for i, _ in kept["mixing"])
    assert Counter(r.doc_id for r in kept["sharding"]) == mixed
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == mixed
