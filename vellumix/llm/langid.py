"""Language identification by multilingual mixture inference.

Each language has a model of letter trigrams, hashed into BUCKETS cells. A document is cut
into blocks of BLOCK bytes and taken as a mixture: expectation-maximisation estimates the
language proportions from the n-gram likelihoods of its blocks, for the 1, 2, 3, ...
languages that weigh most, and the set with the best penalised likelihood is kept; larger sets are
tried until the penalty alone rules them out. A document
whose best single language can't be beaten by any set, because no block favours another
enough, keeps it without further rounds; that bound is exact. Everything runs in numpy over
the bytes of an Arrow batch, some hundred thousand positions at a time.

Counts cover every training document. Each task adds up its own counts per language and
bucket, Spark sums them, and the model that is broadcast has languages x BUCKETS cells however
large the corpus is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, give_back, held_once, held_out, tidy

BUCKETS = 1 << 16
BLOCK = 32
#: More learnt languages than this raise an error: the model has 256 KB for each, and is broadcast.
MOST_LANGS = 1000
ROUNDS = 12
PENALTY = 1.0
SMOOTHING = 0.5
#: Positions worked on at once.
PIECE = 1 << 19
UNDETERMINED = "und"

# letters of ASCII in lower case 1 to 26, bytes beyond ASCII 27 to 154, all else 0
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)
_ascii_letter = re.compile(rb"[A-Za-z]").search


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two; 0 where none is a letter."""
    c = _CODE[data]
    return (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) & (BUCKETS - 1)


def has_letter(text: bytes) -> bool:
    return bool(_ascii_letter(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all of docs(lang, text); rows with a null in either are left out."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, []).append(text.as_py())
            for lang, texts in by.items():
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                data = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)
                for at in range(0, len(data) - 2, PIECE):
                    total += np.bincount(trigrams(data[at : at + PIECE + 2]), minlength=BUCKETS)
        for lang, total in sums.items():
            total[0] = 0
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names and the log-likelihood of each bucket, languages x buckets."""
    counted = ngram_counts(docs)
    table = counted.limit(MOST_LANGS * BUCKETS + 1).toArrow()
    if table.num_rows > MOST_LANGS * BUCKETS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    lang, bucket, n = (table.column(i) for i in range(3))
    return log_likelihoods(lang.to_pylist(), bucket.to_numpy(), n.to_numpy())


def log_likelihoods(lang: list[str], bucket: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
    names = sorted(set(lang))
    at = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS))
    counts[[at[x] for x in lang], bucket] = n
    out = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)
    out[:, 0] = 0.0  # no letters, no evidence
    return names, out


class Mixture:
    """The fitted model in a worker."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text: language, its proportion, and all proportions of the chosen set."""
        n, langs = len(texts), len(self.names)
        has = np.array([bool(t) and has_letter(t) for t in texts], bool)
        share = np.zeros((n, langs))
        if langs and has.any():
            own = np.flatnonzero(has)
            share[own] = self._shares([texts[i] for i in own.tolist()])
        best = share.argmax(axis=1) if langs else np.zeros(n, int)
        names = [self.names[b] if h and langs else UNDETERMINED for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        score = np.where(has, share[np.arange(n), best], 0.0) if langs else np.zeros(n)
        return names, np.clip(score, 0.0, 1.0), share

    def evidence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of every block (blocks x languages), and how many blocks each text has."""
        data = np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)
        size = np.array([len(t) + 2 for t in texts], np.int64)
        per_text = -(-size // BLOCK)
        first = np.cumsum(per_text) - per_text
        block = np.arange(per_text.sum()) - np.repeat(first, per_text)
        begin = np.append(np.repeat(np.cumsum(size) - size, per_text) + BLOCK * block, size.sum())
        out = np.empty((len(block), len(self.names)))
        at, step = 0, PIECE // BLOCK
        while at < len(block):
            to = min(at + step, len(block))
            cells = trigrams(data[begin[at] : begin[to] + 2])
            edge = begin[at:to] - begin[at]
            for j, row in enumerate(self.table):
                out[at:to, j] = np.add.reduceat(row[cells], edge)
            at = to
        return out, per_text

    def _shares(self, texts: list[bytes]) -> np.ndarray:
        loglik, per_text = self.evidence(texts)
        edge = np.cumsum(per_text) - per_text
        informed = (loglik != 0).any(axis=1)
        total = np.add.reduceat(informed.astype(float), edge)
        lik = loglik - loglik.max(axis=1, keepdims=True)
        alone = np.add.reduceat(lik, edge, axis=0)  # against the best that each block could have
        best = np.zeros_like(alone)
        best[np.arange(len(texts)), alone.argmax(axis=1)] = 1.0
        # no set has a value above 0, and one of two languages pays the penalty once at least
        open_ = np.flatnonzero(alone.max(axis=1) < -PENALTY * np.log(total + 1))
        if len(open_):
            of = np.repeat(np.arange(len(texts)), per_text)
            take = np.isin(of, open_) & informed
            best[open_] = self._em(np.exp(lik[take]), of[take], open_, alone[open_].max(axis=1), best[open_])
        return best

    @staticmethod
    def _em(lik: np.ndarray, of: np.ndarray, texts: np.ndarray, value: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Best set and proportions for texts, whose best single language has the given value and share."""
        where = np.searchsorted(texts, of)
        edge = np.searchsorted(where, np.arange(len(texts)))
        count = np.diff(np.append(edge, len(of)))
        langs = lik.shape[1]

        def em(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(ROUNDS):
                each = lik * p[where]
                p = np.add.reduceat(each / np.maximum(each.sum(axis=1, keepdims=True), 1e-300), edge, axis=0)
                p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
            return p, np.add.reduceat(np.log(np.maximum((lik * p[where]).sum(axis=1), 1e-300)), edge)

        free, _ = em(np.full((len(texts), langs), 1.0 / langs))
        order = np.argsort(-free, axis=1, kind="stable")
        for k in range(2, langs + 1):
            # a set of k has at most the value 0 before its penalty
            if (value >= -PENALTY * (k - 1) * np.log(count + 1)).all():
                break
            start = np.zeros_like(free)
            np.put_along_axis(start, order[:, :k], 1.0 / k, axis=1)
            p, got = em(start)
            got = got - PENALTY * (k - 1) * np.log(count + 1)
            better = got > value
            share[better], value[better] = p[better], got[better]
        return share


def language_of(spark, model: tuple[list[str], np.ndarray]):
    """A Column function: text -> struct(lang_pred string, score double, mixture map<string,double>)."""
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    bounded_batches(spark)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])

    @F.arrow_udf("struct<lang_pred string, score double, mixture map<string,double>>")
    def detect(text: pa.Array) -> pa.Array:
        m = held_once(key, lambda: Mixture(*shared.value))
        names, score, share = m.predict(text.to_pylist())
        give_back()
        mixed = [[(m.names[j], float(s[j])) for j in np.flatnonzero(s > 0.01)] for s in share]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score), pa.array(mixed, kind.field(2).type)], fields=list(kind))

    return lambda text: detect(text.cast("binary"))


def train_rows(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: those of the folds other than 0 of 5."""
    return docs.select("doc_id", "lang", "text").where(~held_out("doc_id", 5, 0))


def identify_languages(docs: DataFrame) -> DataFrame:
    """Predicted language of every row of docs(doc_id, text, lang).

    Returns doc_id, held_out, lang_pred, score (proportion of lang_pred in the chosen mixture)
    and mixture (proportions above 0.01). A text that is null or has no letter gets `und` with
    score 0, and so does every text when no row can be learnt from. Ties go to the name that
    sorts first. Repeated rows give repeated results; other columns are ignored.
    """
    got: Column = language_of(docs.sparkSession, fit(train_rows(docs)))(F.col("text"))
    rows = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), got.alias("g"))
    return rows.select("doc_id", "held_out", "g.lang_pred", "g.score", "g.mixture")
