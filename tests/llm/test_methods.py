"""Byte-level BPE, SimHash, FM-index, language ID, quality and toxicity against brute force and held-out truth."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from vellumix.llm import crf, langid, toxicity
from vellumix.llm.bpe import bpe_roundtrip
from vellumix.llm.fmindex import contamination_report, remove_contamination
from vellumix.llm.simhash import simhash_components

DOCS = "doc_id long, text string, source string"
ODD = [None, "", " \n\t", "é", "a" * 70_000, "x y " * 20_000, "0 1 2"]
RNG = random.Random(7)
EN = "the of and house river stone with which there where think water light people".split()
DE = "der und nicht haus fluss stein mit welche dort wo denken wasser licht leute".split()


def table(spark, texts):
    """Rows with ids from 0 and a last row that repeats the first."""
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1], DOCS)


def prose(words, n):
    return " ".join(RNG.choice(words) for _ in range(n))


def test_bpe_equals_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD[:4] + [ODD[4][:5000], " two  spaces\n\nand 12345 l'été 日本語 🙂", "qzxjk" * 300, prose(EN, 50)]
    got = bpe_roundtrip(table(spark, texts), path, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r.doc_id] or ""
        ids = lib.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def plain_simhash(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_all_pairs(spark):
    texts = list(ODD)
    for _ in range(12):
        base = prose(EN, 150).split()
        texts.append(" ".join(base))
        for k in (1, 2):
            base[RNG.randrange(len(base))] = "changed"
            texts.append(" ".join(base).upper() if k == 2 else " ".join(base))
    fps = [plain_simhash(t) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(texts)), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    got = simhash_components(table(spark, texts)).collect()
    assert len(got) == len(texts) + 1
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, comp))}


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def test_contamination_equals_all_windows(spark):
    long_item, short_item, repeated = prose([f"b{i}" for i in range(90)], 40), "only four words here", "again " * 12
    items = [(10, long_item), (9, short_item), (8, repeated), (7, None), (6, "!?"), (5, short_item), (4, "one")]
    texts = [None, "", "clean text", "x " + " ".join(long_item.split()[5:30]) + " y", "Only, FOUR words\nhere", "again " * 40, "four words here", "one", prose(EN, 3000) + " " + long_item]
    got = contamination_report(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words, hit, found = plain_words(texts[r.doc_id]), set(), []
        for item, text in items:
            own = plain_words(text)
            size = min(10, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            at = [i for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in windows] if own else []
            hit.update(j for i in at for j in range(i, i + size))
            found += [str(item)] if at else []
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_removal_cuts_passages_and_keeps_clean_texts(spark):
    item = prose([f"b{i}" for i in range(90)], 30)
    docs = table(spark, ["The Words before " + item + " After It.", "clean text, kept as it is", None, "A B C " + item.upper()])
    got = {r.doc_id: r.text for r in remove_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[0] == "The Words before  After It." and got[3] == "A B C "
    assert got[1] == "clean text, kept as it is" and got[2] is None


def test_languages_and_mixtures(spark):
    pure = [(prose(EN, 60), "en") for _ in range(40)] + [(prose(DE, 60), "de") for _ in range(40)]
    rest = [(t, None) for t in ODD] + [(prose(EN, 300) + " " + prose(DE, 900), None)]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(pure + rest)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    assert len(got) == len(pure) + len(rest)
    assert all(got[i].lang_pred == lang for i, (_, lang) in enumerate(pure))
    at = len(pure)
    assert [got[at + i].lang_pred == "und" for i in range(len(ODD))] == [True, True, True, False, False, False, True]
    mixed = got[at + len(ODD)]
    assert mixed.lang_pred == "de" and 0.65 < mixed.score < 0.85 and 0.15 < mixed.mixture["en"] < 0.35
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.identify_languages(docs.where("lang is null")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify_languages(docs.limit(0)).collect() == []


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(3)
    unary, move, per_text = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([4, 1, 3, 1])
    got, pairs = crf.forward_backward(unary, move, per_text)
    at = 0
    for k, n in enumerate(per_text):
        u, mass, one, two = unary[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum((2 * a - 1) * x / 2 for a, x in zip(y, u)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            mass += w
            one += w * np.array(y)
            for a, b in zip(y, y[1:]):
                two[a, b] += w
        assert np.allclose(got[at : at + n], one / mass) and np.allclose(pairs[k], two / mass)
        at += n


def test_quality_learns_and_holds_out(spark):
    good = [".\n".join(prose(EN, 12).capitalize() for _ in range(5)) + "." for _ in range(60)]
    bad = ["\n".join("$$$ CLICK 12345 !!!" for _ in range(5)) for _ in range(60)]
    docs = table(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = crf.score_quality(docs, labels).collect()
    assert len(got) == 120 + len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id < 60) for r in got if r.doc_id < 120)
    flat = {r.score for r in crf.score_quality(docs, labels.where("quality = 1")).collect()}
    assert len(flat) == 1 and flat.pop() > 0.9


def test_disguised_words_are_restored():
    corpus = np.frombuffer(("  " + "stupid idiot people a man " * 50 + prose(EN, 500) + " ").encode(), np.uint8)
    counts = np.bincount(toxicity.cells_of(corpus), minlength=28**3)
    counts[0] = 0
    model = toxicity.Letters(toxicity.letter_costs(counts.reshape(28, 28, 28).astype(float)))
    for seen in ("id1ot", "!d!ot", "i.d.i.o.t", "idiooooot", "i d i o t", "ídìöt", "idiiot", "idio*", "*diot"):
        assert toxicity.decode(seen, model) == "idiot"
    assert toxicity.decode("st*pid", model) == "stupid"
    assert toxicity.decode("a s t u p i d", model).split()[-1] == "stupid"
    assert len(toxicity.decode("ab1" * 20_000, model)) >= 20_000  # read whole, in bounded pieces


def test_decoding_equals_all_readings(monkeypatch):
    rng = np.random.default_rng(2)
    model = toxicity.Letters((rng.random((28, 28, 28)) * 6).tolist())

    def cost(reading, channel):
        total, a, b = channel, 0, 0
        for x in reading:
            if x == " ":
                total, a, b = total + (model.costs[a][b][0] if a or b else 0.0), 0, 0
            else:
                total, a, b = total + model.costs[a][b][toxicity.symbol(x)], b, toxicity.symbol(x)
        return total + model.costs[a][b][0]

    chars = "aab1*-é 0l"
    for n in range(60):
        token = "".join(rng.choice(list(chars), 1 + n % 6))
        token = token.replace("**", "*a")  # two wild characters alone are 729 readings
        ways = itertools.product(*toxicity.lattice(token))
        best = min(cost("".join(x for x, _, _ in way), sum(c for _, _, c in way)) for way in ways)
        whole = toxicity.decode(token, model)
        monkeypatch.setattr(toxicity, "SEGMENT", 2)
        assert toxicity.decode(token, model) == whole
        monkeypatch.setattr(toxicity, "SEGMENT", 512)
        least = min(sum(c for _, _, c in way) for way in itertools.product(*toxicity.lattice(token)) if "".join(x for x, _, _ in way) == whole)
        assert abs(cost(whole, least) - best) < 1e-6


def test_letter_cells_follow_the_words():
    text = "Ab cd, é9xyz  q"
    want = np.zeros(28**3, int)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        s = [0, 0, *map(toxicity.symbol, word), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            want[(a * 28 + b) * 28 + c] += 1
    got = np.bincount(toxicity.cells_of(np.frombuffer(("  " + text + " ").encode(), np.uint8)), minlength=28**3)
    got[0] = 0
    assert (got == want).all()


def test_toxicity_learns_and_reads_disguises(spark):
    clean, toxic = [prose(EN, 40) for _ in range(80)], [prose(EN, 20) + (" stupid " if i % 2 else " idiot ") + prose(EN, 20) for i in range(40)]
    texts = clean + toxic + ODD + [prose(EN, 20) + " 1d1ot st*pid", prose(EN, 20) + " i d i o t"]
    labels = spark.createDataFrame([(i, int(i >= 80)) for i in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(table(spark, texts), labels).collect()}
    assert all(got[i].predicted == int(i >= 80) for i in range(120))
    assert all(got[i].predicted == 0 for i in range(120, 120 + len(ODD)))
    assert got[len(texts) - 2].predicted == got[len(texts) - 1].predicted == 1
