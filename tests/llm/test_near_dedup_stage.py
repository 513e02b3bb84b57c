"""The pipeline's near_dedup stage and other similarities than op8's, against brute force at the same similarity."""

import re

import numpy as np
import pytest

import corpus_pipeline
from lexiphyte.llm import near_duplicates


def kept(rows, similarity):
    """Ids of brute force: a row goes when the links of its group reach a smaller id."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    return {d for i, (d, _) in enumerate(rows) if d == min(e for (e, _), x in zip(rows, root, strict=True) if x == root[i])}


def pairs(least, most):
    """Pairs of texts of 200 words that differ in one run at the end, so that their similarities lie between the two."""
    rng, rows = np.random.default_rng(8), []
    for g in range(40):
        base = [f"w{g}x{k}" for k in range(200)]
        cut = round(196 - 196 * 2 * (s := rng.uniform(least, most)) / (1 + s))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: 200 - cut] + [f"e{g}x{k}" for k in range(cut)]))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_at_80(spark):
    rows = pairs(0.78, 0.86)
    want = kept(rows, 80)
    assert len(want) < len(kept(rows, 85)) < len(rows)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), None).collect()} == want


@pytest.mark.parametrize("similarity", [50, 70])
def test_lower_similarities(spark, similarity):
    rows = pairs(similarity / 100 - 0.03, similarity / 100 + 0.05)
    assert {r["doc_id"] for r in near_duplicates.drop_near_duplicates(frame(spark, rows), similarity=similarity).collect()} == kept(rows, similarity)


def test_matches():
    assert [near_duplicates.matches(s) for s in (100, 85, 80, 50, 5)] == [64, 34, 29, 9, 1]
