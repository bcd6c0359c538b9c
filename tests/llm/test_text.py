"""Archive, tokenisation, fingerprints, classifiers and packing."""

import functools
import gzip
import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import table, texts  # noqa: E402

from roofline.llm import fingerprints, language_id, packing, sentencepiece, toxicity, warc  # noqa: E402
from roofline.llm._common import shared_dir  # noqa: E402
from roofline.llm.word_bpe import WordEncoder  # noqa: E402

ODD = ["", " ", "  x", "a  b", "x ", "\n", "a \n b\n\nc", "日本語 🙂 ▁▁x", "a" * 240, "=" * 300, "x\t\t\x00", "don't DON'T",
       "<|endoftext|> q<b", "<|ENDOFTEXT|>", "ÀÉ naïve, ΑΣ. Σ́ x", "12 34%&*", "\x1c a b"]


# ---- WARC ----

PAGES = [(1, "u", None), (2, "v", ""), (3, None, "short"), (4, "x", "short"), (5, "y", "é" * 600), (6, "y", "é" * 600),
         (7, "z\r\nWARC-Type: evil", "é" * 600), (8, "w", "b" * 999), (9, "w", "b" * 999), (None, "n", "é" * 600),
         (10, "q", "c" * 1000), (10, "q", "c" * 1000), (11, "q", "d" * 500_000)]


@pytest.fixture(scope="module")
def archive(spark):
    path = f"{shared_dir(spark)}/warc"
    pages = spark.createDataFrame([(*p, b"x") for p in PAGES], "page_id long, url string, html string, payload binary")
    return path, warc.archive_pages(pages, path).collect()


def test_archive_reads_back_what_was_written(archive):
    got = Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive[1])
    want = Counter()
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        revisit = len(body) >= 1000 and i != max(same)
        want[(i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None)] += 1
    assert got == want and all(r.stated_digest == r.payload_digest for r in archive[1])


def test_records_are_rebuilt_byte_for_byte(spark, archive):
    recs = {(r.record_id, bytes(r.record)) for r in warc.reconstruct(spark, archive[0]).collect()}
    assert len(warc.reconstruct(spark, archive[0]).collect()) == len(PAGES)
    for _, raw in recs:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
    body = next(raw for i, raw in recs if i == 11)
    assert body.endswith(b"d" * 500_000 + b"\r\n\r\n")
    members = [gzip.decompress(r.warc) for r in warc.export_warc(spark, archive[0]).collect()]
    assert sorted(members) == sorted(bytes(r.record) for r in warc.reconstruct(spark, archive[0]).collect())


def test_payloads_are_stored_once(spark, archive):
    stored = [bytes(r.sha256) for r in warc.read_payloads(spark, archive[0]).collect()]
    assert set(stored) == {hashlib.sha256((h or "").encode()).digest() for _, _, h in PAGES}
    assert len(stored) == len(set(stored)) + 1  # the row that is repeated whole


def test_a_damaged_payload_fails(spark):
    path = f"{shared_dir(spark)}/bad"
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    recs = warc.records(pages).selectExpr("record_id", "sha2('other', 256) x", "payload", "header", "stored")
    warc.write_archive(recs.selectExpr("record_id", "unhex(x) sha256", "payload", "header", "stored"), path)
    with pytest.raises(Exception, match="does not match"):
        warc.read_payloads(spark, path).collect()


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/none"
    warc.write_archive(warc.records(pages), path)
    assert warc.read_headers(spark, path).count() == 0


# ---- SentencePiece ----

@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.PieceModel(sentencepiece.default_model())


def unigram(pieces):
    """The same pieces as a unigram model: the model type in the file changed."""
    with open(sentencepiece.default_model(), "rb") as f:
        proto = f.read()
    spec = dict(sentencepiece._fields(proto))[2]
    at = proto.index(spec) + spec.index(b"\x18\x02")
    return sentencepiece.PieceModel(proto=proto[:at] + b"\x18\x01" + proto[at + 2:])


def noise(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcthe  \nin.é日▁=") for _ in range(rng.randint(1, 300))) for _ in range(n)]


def test_ids_equal_the_librarys(pieces):
    data = ODD + noise(200) + [t or "" for _, t in texts()]
    for text, raw in zip(data, pieces.encode(pa.array(data))):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == pieces.lib.encode(text), text[:50]
        assert pieces.decode(ids) == pieces.lib.decode(ids)


def test_streaming_commits_the_same_ids(pieces):
    for text in ODD + noise(100):
        if text:
            assert list(pieces.stream(pieces.lib.normalize(text))) == pieces.lib.encode(text)


def test_streaming_window_is_bounded(pieces):
    """Ids of an endless word come out while it is read, not at its end."""
    read = 0

    def chars():
        nonlocal read
        for _ in range(20_000):
            yield "ab"[read % 2]
            read += 1
    stream = pieces.stream(chars())
    next(stream)
    assert read < 200


def test_steps_of_the_window_are_remembered(pieces, monkeypatch):
    """A text met before is walked without looking up a piece; the steps remembered are bounded."""
    looked = 0

    class Forms(dict):
        def get(self, *args):
            nonlocal looked
            looked += 1
            return super().get(*args)
    model = sentencepiece.PieceModel(sentencepiece.default_model())
    model.forms = Forms(model.forms)
    words = [model.lib.normalize(w) for w in ("thinginha", "aileèmentêeux", "licheinbeauung", "日本x")]
    ids = [model.encode_ids(w) for w in words]
    looked = 0
    assert [model.encode_ids(w) for w in words] == ids and looked == 0
    monkeypatch.setattr(sentencepiece, "STEPS", 7)
    model = sentencepiece.PieceModel(sentencepiece.default_model())
    for text in ODD + noise(40, 3):
        if text:
            assert list(model.stream(model.lib.normalize(text))) == model.lib.encode(text)
        assert model.steps <= 7 and sum(map(len, [model.root, *model.alive.values()])) <= 7


def test_words_and_closing_punctuation(pieces):
    """A word takes one place in the memo whatever punctuation stands behind it; the ids are the library's."""
    model = sentencepiece.PieceModel(sentencepiece.default_model())
    data = ["Thnrew", "Thnrew.", "Thnrew, Thnrew?! x.", "(Thnrew) Thnrew's ..", "\nThnrew.\nThnrew\n.", "Thnrew.ed é. 日本. ▁."]
    for text, raw in zip(data, model.encode(pa.array(data))):
        assert np.frombuffer(raw, "<i4").tolist() == model.lib.encode(text), text
    assert "Thnrew" in model.memo and not {"Thnrew.", "Thnrew,", "Thnrew?!"} & set(model.memo)
    assert unigram(pieces).closing == ""


def test_unigram_paths_are_the_best(pieces):
    model = unigram(pieces)
    assert model.kind == sentencepiece.UNIGRAM
    for text in noise(40, 2):
        text = text[:60].replace("\n", "x").replace("日", "z").replace("▁", " ")
        s = model.lib.normalize(text)
        best = [0.0] + [-math.inf] * len(s)
        for i in range(1, len(s) + 1):
            best[i] = max(best[j] + model.scores[s[j:i]] for j in range(max(0, i - model.longest), i) if s[j:i] in model.scores)
        ids = list(model.stream(s))
        assert "".join(model.lib.id_to_piece(i) for i in ids) == s
        assert sum(model.lib.get_score(i) for i in ids) == pytest.approx(best[-1])


def test_documents_round_trip(spark):
    got = sentencepiece.decode_documents(sentencepiece.encode_documents(table(spark))).collect()
    assert len(got) == len(texts()) and all(r.decoded == (r.text or "") for r in got)
    at_once = sentencepiece.encode_documents(table(spark), decode=True).collect()
    assert sorted(map(str, at_once)) == sorted(map(str, got))
    assert sentencepiece.encode_documents(table(spark, [])).count() == 0


# ---- fingerprints ----

def brute_winnow(text, k, w):
    """Windows one by one over the same gram hashes."""
    codes = np.array([ord(c) for c in text], np.uint32)
    if not len(codes):
        return []
    grams = [int(fingerprints.rolling_hashes(codes[i:i + k], min(k, len(codes)))[0]) for i in range(max(1, len(codes) - k + 1))]
    w, out = min(w, len(grams)), []
    for i in range(len(grams) - w + 1):
        spot = max(range(i, i + w), key=lambda p: (-grams[p], p))
        if not out or out[-1][1] != spot:
            out.append((grams[spot], spot))
    return out


@pytest.mark.parametrize("text", ["", "a", "ab" * 200, "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語のテキスト" * 20, texts()[20][1]])
def test_winnowing_takes_the_rightmost_smallest(text):
    h, p = fingerprints.winnow(text, 5, 8)
    assert list(zip(h.tolist(), p.tolist())) == brute_winnow(text, 5, 8)


def test_shared_stretches_share_a_hash():
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(fingerprints.K + fingerprints.WINDOW - 1))
    for _ in range(20):
        a, b = ("".join(rng.choice("xyz ") for _ in range(rng.randint(0, 300))) + shared + "q" * rng.randint(0, 9) for _ in "ab")
        assert len(np.intersect1d(fingerprints.winnow(a)[0], fingerprints.winnow(b)[0]))


def test_short_texts_share_a_hash_with_their_edit(spark):
    rng = random.Random(6)
    data = [(i, "".join(chr(rng.randint(97, 122)) for _ in range(rng.randint(32, 159)))) for i in range(200)]
    got = fingerprints.fingerprint_edits(table(spark, data)).collect()
    assert len(got) == 200 and all(r.near_edited > r.near_next for r in got)


def test_edited_fingerprints_equal_brute_force(spark):
    data = texts()
    got = Counter(tuple(r) for r in fingerprints.fingerprint_edits(table(spark, data)).collect())
    hashes = {(i, t): spark.sql("select xxhash64(cast(:t as string)) h", args={"t": t}).first().h for i, t in set(data)}
    order = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x]))
    want = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        e = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        f, g, n = (fingerprints.winnow(x) for x in (t, e, u))
        like = lambda a, b: (lambda p, q: len(p & q) / len(p | q) if p | q else 1.0)(set(a.tolist()), set(b.tolist()))
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.to_string(*f), fingerprints.to_string(*g),
              like(f[0], g[0]), like(f[0], n[0]))] += 1
    assert got == want


def test_fingerprints_of_one_document_and_of_none(spark):
    one = fingerprints.fingerprint_edits(table(spark, [(1, "ab" * 100)])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(("ab" * 100).encode()).hexdigest()
    assert fingerprints.fingerprint_edits(table(spark, [])).count() == 0


def test_positions_lead_to_equal_text(spark):
    got = fingerprints.fingerprint_documents(table(spark, [(1, "abc" * 50), (2, None)])).collect()
    assert {r.doc_id for r in got} == {1}
    text = "abc" * 50
    by = {}
    for r in got:
        assert by.setdefault(r.hash, text[r.pos:r.pos + fingerprints.K]) == text[r.pos:r.pos + fingerprints.K]


# ---- toxicity ----

def test_toxicity_on_held_out_documents(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    pos, neg = got[got.toxic == 1].score, got[got.toxic == 0].score
    assert np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]) > 0.75


def toxic_table(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice(["the", "sun", "rain", "tree", "walks", "sings", "over"]) for _ in range(8))
    data = []
    for i in range(400):
        sentences = [prose() + "." for _ in range(6)]
        if i % 4 == 0:
            sentences[rng.randrange(6)] = prose() + " blockhead" + rng.choice(["", "ed", "s"]) + "!"
        data.append((i, "\n".join(sentences)))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3, 1, None), (5, 0, 0), (5, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    return data, labels


def test_offending_sentences_are_found(spark):
    data, labels = toxic_table(spark)
    docs = table(spark, data + [(None, "blockhead."), (1000, None), (1001, ""), (1002, "--- !! ")])
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert scores[1000] == scores[1001] == scores[1002] == 0
    assert all((scores[i] >= 0.3) == (i % 4 == 0) for i in range(400))
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i in range(400) if i % 4 == 0} | {None}
    assert all("blockhead" in r.text for r in found)


def test_toxicity_without_labels_or_documents(spark):
    data, labels = toxic_table(spark)
    none = toxicity.train(table(spark, data), labels.where("toxic = 0"))
    assert all(r.score < 1e-6 for r in toxicity.score(table(spark, data), none).collect())
    assert toxicity.score(table(spark, []), toxicity.train(table(spark, []), labels.limit(0))).count() == 0


# ---- language ID ----

def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(docs, language_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.rejected.mean() < 0.01


@pytest.fixture(scope="module")
def small_model(spark):
    en, de = "the cat and the dog sat on the mat with this that", "der hund und die katze sitzen auf dem schönen großen stuhl"
    rows = [(i, en, "en") for i in range(50)] + [(100 + i, de, "de") for i in range(50)] + [(200, "x", None), (201, None, "en")]
    return language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_kneser_ney_probabilities_sum_to_one(small_model):
    rng = np.random.default_rng(1)
    for _ in range(50):
        context = int(rng.integers(0, 64**3)) if rng.random() < 0.5 else int(small_model.keys[3][rng.integers(len(small_model.keys[3]))]) >> 6
        grams = (context << 6 | np.arange(64)).astype(np.uint32)
        np.testing.assert_allclose(np.exp(small_model.gram_scores(grams)).sum(axis=0), 1.0, rtol=1e-4)


def test_language_cases(spark, small_model):
    long_text = "the cat and the dog sat on the mat " * 30_000
    rows = [(1, None), (2, ""), (3, "12 %%"), (4, "the dog and the cat"), (5, "DER HUND UND DIE KATZE"), (6, long_text),
            (7, "qxjzvkw" * 40), (None, "the cat"), (4, "the dog and the cat")]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language_id.identify(table(spark, rows), small_model).collect()]
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (5, "de", False), (6, "en", False),
                   (7, got[6][1], True), (None, "en", False), (4, "en", False)]


def test_languages_without_documents(spark):
    none = language_id.train(table(spark, []))
    assert language_id.identify(table(spark, []), none).count() == 0
    assert {r.lang_pred for r in language_id.identify(table(spark, [(1, "the")]), none).collect()} == {"und"}


def test_lower_orders_count_left_contexts(spark):
    rows = spark.createDataFrame([("a", "abab")], "lang string, text string")
    counts = {r.key: r.n for r in language_id.count_grams(rows).collect()}
    key = lambda *c: sum(x << 6 * (3 - i) for i, x in enumerate(c))
    assert counts == {key(0, 0, 0, 1): 1, key(0, 0, 1, 2): 1, key(0, 1, 2, 1): 1, key(1, 2, 1, 2): 1, key(2, 1, 2, 0): 1}


# ---- packing ----

def test_word_ids_equal_the_librarys():
    enc = WordEncoder(packing.default_tokenizer())
    data = ODD + noise(100) + [t or "" for _, t in texts()]
    for text, raw in zip(data, enc.encode(pa.array(data))):
        assert np.frombuffer(raw, enc.dtype).tolist() == enc.tok.encode(text, add_special_tokens=False).ids, text[:50]


def test_a_small_memo_changes_nothing():
    data = pa.array([t or "" for _, t in texts()])
    assert WordEncoder(packing.default_tokenizer(), memo=5).encode(data) == WordEncoder(packing.default_tokenizer()).encode(data)


def test_rare_words_of_a_batch_leave_the_frequent_ones_remembered():
    """a batch's rare words took the places of its frequent ones, and a word one more for each punctuation behind it."""
    enc = WordEncoder(packing.default_tokenizer(), memo=8000)
    seen, new = [], enc.memo.compute
    enc.memo.compute = lambda word: seen.append(word) or new(word)
    often = ["tree", "house", "chemin", "straße"]
    letters = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnpqrstvw"]
    for k in range(3):
        rare = [f"{x}{x[::-1]}{'xyz'[k]}{'.,'[i % 2]}" for i, x in enumerate(letters)]
        data = [" ".join([*often, *(w + "." for w in often), *(w + "," for w in often)]), " ".join(rare)]
        for text, raw in zip(data, enc.encode(pa.array(data))):
            assert np.frombuffer(raw, enc.dtype).tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    times = Counter(seen)
    assert {w: times[w] for w in often} == dict.fromkeys(often, 1)
    assert not [w for w in times if len(w) > 1 and w[-1] in ".,"]


def test_packing_covers_every_id_once(spark):
    data, window = texts(), 64
    pieces = packing.pack(table(spark, data).repartition(5), window).collect()
    enc = WordEncoder(packing.default_tokenizer())
    ids = [enc.tok.encode(t or "", add_special_tokens=False).ids + [1] for _, t in data]
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    spots = Counter(p.sequence_id * window + p.offset + i for p in pieces for i in range(p.length))
    assert set(spots.values()) == {1} and max(spots) == len(spots) - 1  # gapless, so padded at the end only
    want = Counter()
    for (doc, _), x in zip(data, ids):
        want[(doc, len(x))] += len(x)
    got = Counter()
    for p in pieces:
        assert p.offset + p.length <= window
        got[(p.doc_id, p.doc_tokens)] += p.length
    assert got == want
    by_doc = {(doc, len(x)): x for (doc, _), x in zip(data, ids) if doc is not None}
    for p in pieces:
        if (x := by_doc.get((p.doc_id, p.doc_tokens))) is not None:
            assert p.ids_crc32 == zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4"))


def test_packing_an_empty_table(spark):
    assert packing.pack(table(spark, [])).count() == 0


# ---- brute force of the two models ----

def test_noisy_or_equals_a_row_by_row_sum():
    rng = np.random.default_rng(8)
    vocabulary = ["bad", "worse", "good", "fine", "terribly", "plain", "Ünfein"]
    weights = np.zeros(1 << toxicity.BITS)
    for w in vocabulary:
        for slot in toxicity.features(w):
            if slot >= 0:
                weights[slot] += rng.normal()
    model = toxicity.ToxicityModel(weights, -0.7)
    seps = [" ", "  ", "\t", "\n", "\u00a0", "\r\n", ". ", "! ", ", ", "? "]
    texts_ = ["".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(rng.integers(0, 30))) for _ in range(200)]
    texts_ += ["", None, " . ! ", "bad\tworse", "bad\u00a0worse", "bad worse"]
    got = model.scores(pa.array(texts_, pa.string()))
    for text, score in zip(texts_, got):
        clean, sentence, sentences = (text or "").replace("\n", " . "), [], []
        for chunk in re.split("[ \t\x0b\x0c\r\u00a0]", clean):
            sentence.append(chunk)
            if re.search(r"[.!?]\W*$", chunk):
                sentences.append(sentence)
                sentence = []
        alive = 1.0
        for s in sentences + [sentence]:
            slots = [x for chunk in s for x in toxicity.features(chunk) if x >= 0]
            if slots:
                alive *= 1 - 1 / (1 + math.exp(-(model.bias + sum(weights[x] for x in slots))))
        assert abs(score - (1 - alive)) < 1e-9
    assert got[-1] == got[-2] == got[-3] > 0


def test_kneser_ney_equals_fractions_of_a_tiny_corpus(spark):
    from fractions import Fraction
    corpus = {"x": ["abab abba baab", "abc", None, ""], "y": ["bbb bcb", "été cab"]}
    rows = [(lang, t) for lang, ts in corpus.items() for t in ts]
    model = language_id.fit(language_id.count_grams(spark.createDataFrame(rows, "lang string, text string")))
    d, kinds = Fraction(3, 4), language_id.CLASSES
    tuples = lambda key, order: tuple(key >> 6 * (order - 1 - i) & 63 for i in range(order))
    for col, lang in enumerate(model.langs):
        levels = {4: Counter(tuples(int(k), 4) for t in corpus[lang] for k in language_id.gram_keys(language_id.classes(t or "")))}
        for order in (3, 2, 1):  # in how many contexts a gram is found
            levels[order] = Counter(g[1:] for g in levels[order + 1])

        def p(gram):
            own = {g: n for g, n in levels[len(gram)].items() if g[:-1] == gram[:-1]}
            total = sum(own.values())
            lower = p(gram[1:]) if len(gram) > 1 else Fraction(1, kinds)
            if not own:
                return lower
            n = own.get(gram, 0)
            return (max(n - d, 0) if n else Fraction(0)) / total + d * len(own) / total * lower
        rng = np.random.default_rng(3)
        grams = [g for lv in (levels[4],) for g in lv] + [tuple(rng.integers(0, 5, 4).tolist()) for _ in range(60)]
        keys = np.array([functools.reduce(lambda a, c: a << 6 | c, g) for g in grams], np.uint32)
        for g, got in zip(grams, model.gram_scores(keys)[:, col]):
            assert abs(math.exp(got) - float(p(g))) < 1e-5, (lang, g)


def test_queries_of_the_classifiers_equal_their_operators(spark, sf_dir):
    """The select of op8 and op9: folds by CRC-32, the threshold, every row once."""
    from roofline.llm import queries
    ids = Counter(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    for name, folds, fold in (("op8_toxicity", 4, 2), ("op9_language_id", 5, 0)):
        got = queries.QUERIES[name](spark, sf_dir).collect()
        assert Counter(r.doc_id for r in got) == ids
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 for r in got)
        if name == "op8_toxicity":
            assert all(r.predicted == int(r.score >= 0.3) for r in got)
