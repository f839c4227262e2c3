"""The pipeline's stages, one after the other, against brute force."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from orderlens.llm import mixing, pieces, tokens
from tests.llm.test_operators import brute_jaccard, docs, docs_of, empty, near_copies  # noqa: F401


def test_stages(spark, tmp_path):
    items = [(i, f"{t}") for i, t in near_copies(36)] + [(900, "???"), (901, ""), (None, "a word or two")]
    path = str(tmp_path / "documents.parquet")
    docs_of(spark, items).write.parquet(path)
    rows = spark.read.parquet(path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "distinct", "mixture", "segmented"]
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        after = stage(spark, rows, str(tmp_path))
        if name != "segmented":
            assert after.columns == rows.columns and after.distinct().exceptAll(before.distinct()).count() == 0
        after.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        if name == "language":
            kept = [(r["doc_id"], r["text"]) for r in rows.collect()]
            assert {d for d, _ in kept} >= set(range(36))
        if name == "distinct":
            _, root = brute_jaccard(kept)
            assert rows.count() == len(set(root))
        if name == "mixture":
            want = Counter()
            for r in mixing.mixed(before, "text").collect():
                want[r["text"]] += (r["position"] is not None) + (r["again_at"] is not None)
            assert Counter(r["text"] for r in rows.collect()) == +want
        if name == "segmented":
            model = pieces.Lattice(tokens.vocabulary("piece_bpe_32k.model"))
            texts = Counter(r["text"] for r in before.collect())
            import numpy as np

            assert Counter(model.decode(np.array(r["ids"])) for r in rows.collect()) == texts
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows.count()
