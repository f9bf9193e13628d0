"""Mixture inference against plain loops over one text at a time."""

import numpy as np

from vellumix.llm import langid


def plain_shares(model, text):
    """Best penalised set of languages by expectation-maximisation, block by block."""
    lik, _ = model.evidence([text])
    lik = lik[(lik != 0).any(axis=1)]
    langs = lik.shape[1]
    if not len(lik):
        return np.eye(langs)[0]
    weights = np.exp(lik - lik.max(axis=1, keepdims=True))

    def em(p):
        for _ in range(langid.ROUNDS):
            each = weights * p
            p = (each / each.sum(axis=1, keepdims=True)).mean(axis=0)
        return p, np.log((weights * p).sum(axis=1)).sum()

    single = np.log(np.maximum(weights, 1e-300)).sum(axis=0)
    best, value = np.eye(langs)[single.argmax()], single.max()
    free, _ = em(np.full(langs, 1 / langs))
    order = np.argsort(-free, kind="stable")
    for k in range(2, langs + 1):
        start = np.zeros(langs)
        start[order[:k]] = 1 / k
        p, got = em(start)
        got -= langid.PENALTY * (k - 1) * np.log(len(lik) + 1)
        if got > value:
            best, value = p, got
    return best


def test_mixtures_equal_plain_loops():
    rng = np.random.default_rng(6)
    names = [f"l{i}" for i in range(7)]
    words = [["".join(rng.choice(list(letters), 5)) for _ in range(30)] for letters in ("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "bdyz")]
    lang, bucket, n = [], [], []
    for name, own in zip(names, words):
        data = np.frombuffer((" " + " ".join(own * 20) + " ").encode(), np.uint8)
        at, k = np.unique(langid.trigrams(data), return_counts=True)
        keep = at > 0
        lang += [name] * int(keep.sum())
        bucket += at[keep].tolist()
        n += k[keep].tolist()
    model = langid.Mixture(*langid.log_likelihoods(lang, np.array(bucket), np.array(n)))
    texts = []
    for k in (1, 2, 3, 5, 6, 7):
        texts.append(" ".join(" ".join(rng.choice(words[j], 60)) for j in range(k)).encode())
    texts += [b"a", b"   ", b"zz 12"]
    got = model._shares(texts)
    for text, share in zip(texts, got):
        assert np.allclose(share, plain_shares(model, text), atol=1e-6)
    assert [int((s > 0.05).sum()) for s in got[:6]] == [1, 2, 3, 5, 6, 7]


def test_only_letters_make_a_text_determinable(spark):
    texts = ["²", "½ ①", "12 !", "é", "日", None, "x"]
    train = [(100 + i, "plain words here", "en") for i in range(10)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + train + [(101, "plain words here", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [True, True, True, False, False, True, False]
