"""Near-duplicate classes against all pairs."""

import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from vellumix.llm import neardup

DOCS = "doc_id long, text string, source string"


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(texts):
    sets = [plain_set(t) for t in texts]
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if (5 * shared >= 4 * union) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    return comp


def near_texts():
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [None, "", " \n", "one two", "ONE  two", "a b c d e", "a b c d f"]
    for _ in range(25):
        base = fresh(200)
        texts.append(" ".join(base))
        for swaps in (1, 3, 4, 5, 8):
            other = list(base)
            for at in rng.sample(range(200), swaps):
                other[at] = "changed"
            texts.append(" ".join(other))
    hub = fresh(150)
    for _ in range(40):  # copies of one text, many of them less than 0.8 from each other
        other = list(hub)
        for at in rng.sample(range(150), 3):
            other[at] = fresh(1)[0]
        texts.append(" ".join(other))
    return texts


def test_near_dedup_equals_all_pairs(spark):
    texts = near_texts()
    comp = plain_classes(texts)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:10], DOCS)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(comp))


def test_classes_without_or_with_shared_ids_keep_one_row_each(spark):
    x, y = " ".join(f"x{i}" for i in range(100)), " ".join(f"y{i}" for i in range(100))
    z = " ".join(f"z{i}" for i in range(100))
    docs = spark.createDataFrame([(1, x, "s"), (1, y, "s"), (2, y + " more", "s"), (None, z, "s"), (None, z + " more", "s")], DOCS)
    got = neardup.keep_one_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in got) == [(0, "z"), (1, "x"), (1, "y")]
    assert neardup.keep_one_of_each(docs.where(F.lit(False))).collect() == []
