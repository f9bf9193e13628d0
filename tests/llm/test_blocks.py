"""Benchmark blocks, overlapping sections and the shared rank queue against one-piece versions."""

import random
import sys

import numpy as np

from vellumix.llm import bpe, fmindex


def plain_merge(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_shared_queue_equals_one_merge_at_a_time():
    rng = random.Random(5)
    # ranks in random order, so that a merge may open a lower rank than its own
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(150)}
    order = sorted(words)
    rng.shuffle(order)
    ranks = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate(order)}
    codec = bpe.ByteBpe(ranks, r"\S+|\s+")
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [b"a" * 500]
    got = codec.merge(pieces)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain_merge(ranks, p) if p else [] for p in pieces]
    text = "ab  cab\nabc " * 20
    assert codec.decode(codec.encode(text)) == text.encode()


def test_pre_tokens_share_the_steps_of_the_queue():
    rng = random.Random(6)
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(2, 5))) for _ in range(400)})
    rng.shuffle(words)
    ranks = {bytes([b]): b for b in b"abc"} | {w: 300 + i for i, w in enumerate(words)}  # d has no rank
    codec = bpe.ByteBpe(ranks, r"\S+|\s+")
    pieces = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 12))) for _ in range(30000)]

    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        got = codec.merge(pieces)
    finally:
        sys.setprofile(None)
    merges = sum(map(len, pieces)) - sum(map(len, got)) // 4
    assert merges > 50000 and calls < 3 * merges  # one position at a time takes six
    none = {bytes([b]): 2**32 - 1 for b in range(256)}
    for p, x in list(zip(pieces, got))[::50]:
        assert np.frombuffer(x, "<u4").tolist() == plain_merge_or(ranks, p, none)


def plain_merge_or(ranks, piece, otherwise):
    parts = [bytes([b]) for b in piece]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks.get(p, otherwise.get(p)) for p in parts]


def items_and_texts():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    items = [(str(k), " ".join(rng.choice(words) for _ in range(n)).encode()) for k, n in enumerate([3, 10, 25, 60, 1, 0, 60])]
    items += [(None, items[2][1]), ("9", None)]
    texts = [b"nothing to find here"] * 5
    for _ in range(30):
        own = [rng.choice(words) for _ in range(80)]
        source = items[rng.randrange(len(items))][1] or b""
        cut = source.decode().split()[:20]
        own[10 : 10 + len(cut)] = cut
        texts.append(" ".join(own).encode())
    return items, [*texts, None, b"", b"!!"]


def test_blocks_and_sections_find_what_one_index_finds(monkeypatch):
    items, texts = items_and_texts()

    def found(block_windows):
        hit, named = None, [set() for _ in texts]
        for phrases in fmindex.blocks_of(items, 10, block_windows):
            hit = fmindex._search(texts, phrases, phrases.pairs(), hit, named)
        return [m.tolist() for m in hit], named

    whole = found(10**6)
    assert any(any(m) for m in whole[0])
    assert found(7) == whole
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 37)
    monkeypatch.setattr(fmindex, "PIECE", 16)
    assert found(7) == whole and found(10**6) == whole


def test_blocks_in_a_query(spark):
    items, texts = items_and_texts()
    docs = spark.createDataFrame([(i, None if t is None else t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, None if t is None else t.decode()) for i, t in items], "item_id string, text string")
    one, many = (sorted(map(tuple, fmindex.contamination_report(docs, bench, block_windows=n).collect())) for n in (10**6, 9))
    assert one == many and any(r[2] for r in one)
    assert fmindex.contamination_report(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in fmindex.contamination_report(docs, bench.limit(0)).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # batches with and without a hit follow each other
    odd = docs.selectExpr("doc_id", "text", "doc_id as row", "length(text) as n_chars", "text as `a.b`")
    kept = fmindex.remove_contamination(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(texts)
    assert all((r.text is None) == (r["a.b"] is None) for r in kept.collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
