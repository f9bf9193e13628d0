"""The whole pipeline against a plain version, one document at a time."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from vellumix.llm import crf, langid

EN = "the of and house river stone with which there where think water light people know come made over such time".split()
DE = "der und nicht haus fluss stein mit welche dort wo denken wasser licht leute wissen kommen gemacht sehr zeit".split()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def corpus(rng):
    """(documents, labels, benchmark): good and bad texts of two languages, near copies, passages of the benchmark, odd texts."""
    fresh = lambda own, n: ".\n".join(" ".join([f"{rng.choice(own)}" for _ in range(12)] + [f"id{rng.randrange(10**6)}"]) for _ in range(n)) + "."
    bench = [(i, " ".join(f"{rng.choice(EN)}q{rng.randrange(900)}" for _ in range(30))) for i in range(4)] + [(9, None)]
    docs, labels = [], []
    for i in range(60):
        docs.append([i, fresh(EN if i % 2 else DE, 12), "en" if i % 2 else "de"])
        labels.append((i, 1, 0))
    for i in range(60, 90):
        docs.append([i, "\n".join(f"$$$ CLICK {rng.choice(EN)} {rng.randrange(10**5)} !!!" for _ in range(8)), "en"])
        labels.append((i, 0, 0))
    for k in range(20):  # near and exact copies
        text = docs[k][1]
        docs.append([100 + k, text if k % 3 == 0 else text.replace(text.split()[50], "changed", 1), None])
    for k in range(6):
        docs.append([200 + k, docs[21 + k][1] + " " + bench[k % 4][1].upper() + " " + fresh(EN, 3), "en"])
    docs += [[300, None, None], [301, "", "en"], [302, "12 34", None], [303, docs[5][1], "en"], [303, docs[5][1], "en"], [None, fresh(EN, 12), None]]
    docs.append([304, docs[40][1] + "\n" + fresh(DE, 300), "de"])
    return docs, labels, bench


def plain_near(kept):
    sets = [set(zip(*[(t or "").encode().lower().split()[k:] for k in range(5)])) for _, t in kept]
    comp = list(range(len(kept)))
    for a, b in itertools.combinations(range(len(kept)), 2):
        if comp[a] != comp[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    out = {}
    for c, d in zip(comp, kept):
        out[c] = min(out.get(c, d), d, key=lambda x: (x[0] is None, x[0] or 0))
    return list(out.values())


def plain_cut(text, bench):
    low = text.lower()
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    own, hit = [low[a:b] for a, b in at], set()
    for _, item in bench:
        w = words((item or "").lower())
        windows = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        for i in range(len(own) - 9):
            if tuple(own[i : i + 10]) in windows:
                hit.update(range(i, i + 10))
    for a, b in sorted(((i, i) for i in hit if i - 1 not in hit), reverse=True):
        while b + 1 in hit:
            b += 1
        text = text[: at[a][0]] + text[at[b][1] :]
    return text


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs, labels, bench = corpus(random.Random(12))
    schema = "doc_id long, text string, lang string, source string, n_chars long, `found` string, id_ int"
    rows = [(i, t, x, "s", len(t or ""), "clash", 1) for i, t, x in docs]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)

    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.Mixture(*langid.fit(langid.train_rows(given)))
    kept = []
    for i, t, _ in docs:
        (name,), (score,), _ = model.predict([None if t is None else t.encode()])
        if name != "und" and score >= 0.5:
            kept.append((i, t))
    field = crf.fit(given.where(given.doc_id.isin([i for i, _ in kept if i is not None])), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [(i, t) for i, t in kept if field.score([t.encode()])[0] >= 0.3]
    assert {i for i, _ in kept}.isdisjoint(range(60, 90)) and set(range(60)) <= {i for i, _ in kept}
    kept = plain_near(kept)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in kept:
        t = plain_cut(t, bench)
        ids = lib.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert not any(100 <= (i or 0) < 120 for i, *_ in got)


def test_stages_pass_empty_tables_and_keep_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != "bpe_encoding":
            assert out.columns == docs.columns
