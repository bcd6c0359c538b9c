"""Language identification with interpolated Kneser-Ney character models.

Letters are mapped to 63 classes (a-z, and the other letters by code point), everything
else to a boundary, so an n-gram of order 4 is a 24-bit key and a model is a set of
sorted key arrays with their log-probabilities, at most 64^4 keys whatever the corpus.
The counts are taken over all training texts in one pass; lower orders count distinct
left contexts (Kneser-Ney).  A text goes to the language with the lowest cross-entropy
per character, unless that is far above what the language's own training texts have.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import carried, documents, map_batches, strings
from ._runs import sliced

ORDER, CLASSES = 4, 64
#: Characters scored at a time, so that a long text needs no more memory than a short one.
STEP = 1 << 18


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point: 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return table


def classes(text: str) -> np.ndarray:
    """The classes of a text between boundaries; runs of boundaries are one."""
    c = class_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([np.zeros(1, np.uint8), c, np.zeros(1, np.uint8)])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep]


def gram_keys(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The key of the ``order``-gram that ends at each character but the first boundary,
    which is taken as often as needed for a full context."""
    c = np.concatenate([np.zeros(order - 2, np.uint32), codes.astype(np.uint32)])
    n = len(c) - order + 1
    key = np.zeros(max(n, 0), np.uint32)
    for i in range(order):
        key = (key << np.uint32(6)) | c[i:i + n]
    return key


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, key, n) over all texts of (lang, text): summed in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, parts: list[np.ndarray]) -> None:
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            if lang in sums:
                both = np.concatenate([sums[lang][0], keys])
                keys, where = np.unique(both, return_inverse=True)
                counts = np.bincount(where, np.concatenate([sums[lang][1], counts])).astype(np.int64)
            sums[lang] = keys, counts

        for b in sliced(batches, 1):
            waiting: dict[str, list[np.ndarray]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                keys = gram_keys(classes(text))
                waiting.setdefault(lang, []).append(keys)
                size[lang] = size.get(lang, 0) + len(keys)
                if size[lang] > 4 * STEP:
                    add(lang, waiting.pop(lang))
                    size[lang] = 0
            for lang, parts in waiting.items():
                add(lang, parts)
        for lang, (keys, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)),
                                              pa.array(counts, pa.int64())], names=["lang", "key", "n"])
    return labelled.select("lang", "text").mapInArrow(run, "lang string, key int, n long").groupBy("lang", "key").agg(
        F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Per order: sorted keys, log-probabilities and log back-off weights, one column per language."""
    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    mean: np.ndarray      # cross-entropy of each language's own training text
    spread: np.ndarray    # and the deviation of one character from it

    def gram_scores(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """(grams, languages) log-probabilities of the last character given those before."""
        keys = self.keys[order - 1]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out = self.logp[order - 1][at]
        missing = np.flatnonzero(keys[at] != grams)
        if len(missing) and order > 1:
            rest = grams[missing]
            context = rest >> np.uint32(6)
            lower = rest & np.uint32((1 << 6 * (order - 1)) - 1)
            scores = self.gram_scores(lower, order - 1)
            ck = self.keys[order - 2]
            ca = np.minimum(np.searchsorted(ck, context), len(ck) - 1)
            known = ck[ca] == context
            scores[known] += self.back[order - 2][ca[known]]
            out[missing] = scores
        return out

    def entropies(self, codes: np.ndarray) -> tuple[np.ndarray, int]:
        """Cross-entropy per character in each language, and the number of characters."""
        total = np.zeros(len(self.langs))
        grams = gram_keys(codes)
        for i in range(0, len(grams), STEP):
            total -= self.gram_scores(grams[i:i + STEP]).sum(axis=0, dtype=np.float64)
        return total / max(len(grams), 1), len(grams)

    def predict(self, text: str, slack: float, deviations: float) -> tuple[str, float, bool]:
        """(language, score, rejected); ``und`` for a text without a letter."""
        codes = classes(text)
        if not codes.any() or not self.langs:
            return "und", 0.0, True
        return self.decide(*self.entropies(codes), slack, deviations)

    def decide(self, h: np.ndarray, n: int, slack: float, deviations: float) -> tuple[str, float, bool]:
        best = int(np.argmin(h))
        # The posterior of at most 100 characters' worth of evidence: neighbours in a text depend on each other.
        score = 1.0 / np.exp((h[best] - h) * min(n, 100)).sum()
        limit = self.mean[best] + slack + deviations * self.spread[best] / np.sqrt(n)
        return self.langs[best], float(score), bool(h[best] > limit)


def fit(counts: DataFrame, discount: float = 0.75) -> LanguageModel:
    """The model of (lang, key, n) counts.  Collected are at most 64^4 numbers per language,
    whatever the size of the corpus."""
    rows = counts.where("lang is not null").toPandas()
    langs = sorted(rows.lang.unique())
    tables = []  # per language and order: sorted keys and (continuation) counts
    for lang in langs:
        own = rows[rows.lang == lang].sort_values("key")
        keys, n = own.key.to_numpy().astype(np.uint32), own.n.to_numpy(np.float64)
        levels = [(keys, n)]
        for order in range(ORDER - 1, 0, -1):
            lower = levels[0][0] & np.uint32((1 << 6 * order) - 1)
            k, c = np.unique(lower, return_counts=True)
            levels.insert(0, (k, c.astype(np.float64)))
        tables.append(levels)
    union = [functools.reduce(np.union1d, [t[o][0] for t in tables], np.zeros(0, np.uint32)) for o in range(ORDER)]
    for o in range(ORDER - 1, 0, -1):  # a context at the start of a text ends no gram
        union[o - 1] = np.union1d(union[o - 1], union[o] >> np.uint32(6))
    union[0] = np.arange(CLASSES, dtype=np.uint32)
    model = LanguageModel(langs, union, [np.zeros((len(k), len(langs)), np.float32) for k in union],
                          [np.zeros((len(k), len(langs)), np.float32) for k in union],
                          np.zeros(len(langs)), np.zeros(len(langs)))
    for col, levels in enumerate(tables):
        one = LanguageModel([langs[col]], union, [p[:, col:col + 1] for p in model.logp],
                            [w[:, col:col + 1] for w in model.back], model.mean, model.spread)
        for order in range(1, ORDER + 1):
            keys, counts = levels[order - 1]
            contexts, where = np.unique(keys >> np.uint32(6), return_inverse=True)
            total, kinds = np.bincount(where, counts), np.bincount(where)
            weight = discount * kinds / total
            if order == 1:
                p = np.full(CLASSES, weight[0] / CLASSES)
                p[keys] += (counts - discount) / total[0]
                one.logp[0][:, 0] = np.log(p)
                continue
            lower_keys = union[order - 2]
            one.back[order - 2][np.searchsorted(lower_keys, contexts), 0] = np.log(weight)
            # All grams that any language has: back-off first, then the language's own counts on top.
            grams = union[order - 1]
            lower = one.gram_scores(grams & np.uint32((1 << 6 * (order - 1)) - 1), order - 1)[:, 0].astype(np.float64)
            p = np.exp(lower + one.back[order - 2][np.searchsorted(lower_keys, grams >> np.uint32(6)), 0])
            at = np.searchsorted(grams, keys)
            p[at] += np.maximum(counts - discount, 0) / total[where]
            one.logp[order - 1][:, 0] = np.log(p)
        n = levels[-1][1]
        own = -one.logp[-1][np.searchsorted(union[-1], levels[-1][0]), 0].astype(np.float64)
        model.mean[col] = (own * n).sum() / n.sum()
        model.spread[col] = np.sqrt(max((own ** 2 * n).sum() / n.sum() - model.mean[col] ** 2, 0.0))
    return model


def held_out(doc_id, folds: int = 5, fold: int = 0):
    """Whether a row is kept from training: by the CRC-32 of its id as text (a null id as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model per value of ``lang`` over the rows that are not held out and have a language.  Null and empty
    texts add a boundary alone, repeated rows count as often as they are there, and an empty table gives a
    model without languages."""
    return fit(count_grams(docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))))


def identify(docs: DataFrame, model: LanguageModel, slack: float = 0.5, deviations: float = 8.0,
             id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, text, lang_pred, score, rejected) of every row; ``carry`` adds ``row``, its other columns.

    ``und``, score 0 and rejected: a null or empty text or one without a letter, and every
    text where no language was learned.  Rejected: a cross-entropy over that of the
    language's training text by ``slack`` nats and ``deviations`` standard errors for the
    text's length.  Ties go to the language that sorts first.  Nulls in other columns,
    repeated rows and an empty table need no care: a row is judged on its text alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 64^4 keys an order, see above

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        out = [m.predict(t, slack, deviations) for t in strings(b.column(1))]
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.string()),
                                           pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_()), *b.columns[2:]],
                                          names=["doc_id", "text", "lang_pred", "score", "rejected", *b.schema.names[2:]])
    rows = documents(docs, id_col, text_col, carry).drop("thash")
    return map_batches(rows, run, carried("doc_id long, text string, lang_pred string, score double, rejected boolean", rows))
