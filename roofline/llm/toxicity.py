"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of its words; a document is toxic when
one of its sentences is (noisy-or), so the weights are learned from document labels alone
and the sentence scores then tell where.  Training takes at most ``max_docs`` labelled
rows, chosen by a hash of their id; scoring reads every document whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, map_batches, strings

BITS, PER_WORD = 20, 4
EDGES = ".,;:!?\"'()[]{}<>*%&$#@~^_-+=/\\|`“”„‘’«»…"


def features(chunk: str) -> list[int]:
    """The slots of a word and of its first 4, 5 and 6 letters; -1 for none.

    The word is stripped of punctuation and lower-cased; the beginnings let a stem learned
    from some of its forms be known in others.
    """
    word = chunk.strip(EDGES).lower()
    if not word:
        return [-1] * PER_WORD
    parts = [word, *(f"{word[:k]}*" for k in range(4, 4 + PER_WORD - 1) if len(word) > k)]
    slots = [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) >> (32 - BITS) for p in parts]
    return slots + [-1] * (PER_WORD - len(slots))


def slots_of(words: list[str]) -> np.ndarray:
    """(words, PER_WORD) slots."""
    return np.array([features(w) for w in words], np.int64).reshape(-1, PER_WORD)


def tokenise(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct chunks, and per chunk of the batch its number, whether it ends a sentence, its
    document and (without a gap within a document) its sentence.  Chunks end at ASCII white space and at
    no-break spaces; the end of a line ends a sentence."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " . ")
    for blank in "\t\v\f\r\u00a0":
        texts = pc.replace_substring(texts, blank, " ")
    cut = pc.split_pattern(texts, " ")
    chunks = cut.flatten().dictionary_encode()
    which = chunks.indices.to_numpy()
    ends = pc.match_substring_regex(chunks.dictionary, r"[.!?]\W*$").to_numpy(zero_copy_only=False)[which]
    sizes = np.diff(cut.offsets.to_numpy())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(which), bool)
    new[1:] = ends[:-1] | (doc[1:] != doc[:-1])
    return chunks.dictionary, which, ends, doc, np.cumsum(new) - 1


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one per slot
    bias: float

    def sentence_logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logit, document) of every sentence with a word."""
        words, which, _, doc, sentence = tokenise(texts)
        slots = slots_of(words.to_pylist())
        if not len(which):
            return np.zeros(0), np.zeros(0, np.int64)
        w = np.where(slots >= 0, self.weights[slots], 0.0).sum(axis=1)[which]
        n = sentence[-1] + 1
        has = np.bincount(sentence, (slots[:, 0] >= 0)[which], n) > 0
        logit = np.bincount(sentence, w, n) + self.bias
        first = np.zeros(n, np.int64)
        first[sentence[::-1]] = doc[::-1]
        return logit[has], first[has]

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Noisy-or of the sentences of each text; 0 for a text without a word."""
        logit, doc = self.sentence_logits(texts)
        return -np.expm1(-np.bincount(doc, np.logaddexp(0, logit), len(texts)))


def held_out(doc_id, folds: int = 4, fold: int = 2):
    """Whether a row is kept from training: by the CRC-32 of its id as text (a null id as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def sample_rows(docs: DataFrame, labels: DataFrame, max_docs: int, id_col: str, text_col: str,
                label_col: str) -> DataFrame:
    """Words and labels of at most ``max_docs`` labelled rows that are not held out, a row per batch."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    text = documents(docs, id_col, text_col).select("doc_id", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        # One row per batch: its distinct words once (they hold no blank), and per word of a text
        # its number and whether it begins a sentence.
        words, which, _, doc, sentence = tokenise(b.column(1))
        new = np.diff(sentence, prepend=-1) > 0
        bounds = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype("<i4")
        return pa.RecordBatch.from_arrays(
            [pa.array([b.column(0).to_numpy().astype("<i4").tobytes()], pa.binary()), pa.array([bounds.tobytes()], pa.binary()),
             pa.array([" ".join(words.to_pylist())], pa.string()),
             pa.array([(which.astype("<i4") * 2 + new).astype("<i4").tobytes()], pa.binary())],
            names=["toxic", "bounds", "words", "which"])

    met = text.join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # at most max_docs rows
    return map_batches(met, run, "toxic binary, bounds binary, words string, which binary")


def summed(into: np.ndarray, values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values[index]`` by ``into``, a stretch at a time to bound the memory."""
    out = np.zeros(n)
    for i in range(0, len(into), 1 << 20):
        out += np.bincount(into[i:i + (1 << 20)], values[index[i:i + (1 << 20)]], n)
    return out


def fit(batches: list, rounds: int = 40, rate: float = 0.25, decay: float = 2e-3, min_docs: int = 3) -> ToxicityModel:
    """Gradient ascent (Adam) on the noisy-or likelihood of the rows of ``sample_rows``."""
    model = ToxicityModel(np.zeros(1 << BITS), -30.0)
    labels = [np.frombuffer(x[0], "<i4") > 0 for x in batches]
    y = np.concatenate(labels) if labels else np.zeros(0, bool)
    if not y.any():
        return model
    parts, in_docs, toxic_docs, n_sent, n_docs = [], np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32), 0, 0
    for toxic, row in zip(labels, batches):
        _, bounds, words, which = row
        which, bounds = np.frombuffer(which, "<i4"), np.frombuffer(bounds, "<i4")
        doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
        sentence = np.cumsum(which & 1) - 1
        slots = slots_of(words.split(" ")).astype(np.int32)[which >> 1]
        for k in range(PER_WORD):  # documents of each slot
            one = slots[:, k] >= 0
            pairs = np.unique(doc[one] * (1 << BITS) + slots[one, k].astype(np.int64))
            own = pairs & ((1 << BITS) - 1)
            in_docs += np.bincount(own, minlength=1 << BITS).astype(np.int32)
            toxic_docs += np.bincount(own[toxic[pairs >> BITS]], minlength=1 << BITS).astype(np.int32)
        owner = np.zeros(sentence[-1] + 1 if len(sentence) else 0, np.int32)
        owner[sentence[::-1]] = doc[::-1] + n_docs
        parts.append((slots, (sentence + n_sent).astype(np.int32), owner))
        n_sent, n_docs = n_sent + len(owner), n_docs + len(toxic)
    # Slots in fewer than ``min_docs`` documents carry no weight.
    used = np.flatnonzero(in_docs >= min_docs)
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    f, s = [], []
    owner = np.concatenate([p[2] for p in parts])
    while parts:
        slots, sentence, _ = parts.pop(0)
        got = np.where(slots >= 0, number[slots], -1)
        f.append(got[got >= 0])
        s.append(sentence[np.nonzero(got >= 0)[0]])
    f, s = np.concatenate(f), np.concatenate(s)
    n_pos = y.sum()
    # Start: each slot's log odds in toxic against other documents, shrunk towards none.
    pos, neg = toxic_docs[used], in_docs[used] - toxic_docs[used]
    odds = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_docs - n_pos + 2))
    w = 0.5 * np.clip(odds, 0, None) * (in_docs[used] / (in_docs[used] + 10.0))
    b = np.log(n_pos / max(n_sent, 1)) - 2.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        z = summed(s, w, f, n_sent) + b
        a = np.bincount(owner, np.logaddexp(0, z), n_docs)
        pull = np.where(y, 1 / np.expm1(np.clip(a, 1e-6, 50)), -1.0)
        gz = pull[owner] * np.exp(-np.logaddexp(0, -z))
        g = np.append(summed(f, gz, s, len(w)) - decay * n_pos * w, gz.sum()) / n_docs
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    model.weights[used], model.bias = w, float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 8_000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", **fitting) -> ToxicityModel:
    """A model of at most ``max_docs`` labelled documents that are not held out; the sample's
    words are all that reaches the driver.  Without a toxic one among them every score is about 0.

    A document with several labels is toxic if one says so; null labels and ids, and labels of documents that
    are not there, are left out; a null or empty text is a document without sentences."""
    return fit(sample_rows(docs, labels, max_docs, id_col, text_col, label_col).collect(), **fitting)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row from its text alone: null and empty texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^20 weights

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], names=["doc_id", "score"])
    return map_batches(documents(docs, id_col, text_col).select("doc_id", "text"), run, "doc_id long, score double")


def offending_sentences(docs: DataFrame, model: ToxicityModel, least: float = 0.3, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """(doc_id, sentence, score, text): the sentences of at least ``least``, numbered from 0 in their document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                one = pa.array([text])
                words, which, _, _, sentence = tokenise(one)
                chunks = words.to_pylist()
                spoken = (slots_of(chunks)[:, 0] >= 0)[which]
                numbers = np.unique(sentence[spoken])
                for i, p in enumerate(1 / (1 + np.exp(-shared.value.sentence_logits(one)[0]))):
                    if p >= least:
                        out.append((doc, i, float(p), " ".join(chunks[w] for w in which[sentence == numbers[i]] if chunks[w])))
            cols = list(zip(*out)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "sentence", "score", "text"])
    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(
        run, "doc_id long, sentence long, score double, text string")
