"""Exact, line, substring and near dedup against plain-Python statements of their rules."""

import hashlib
import os
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import LOWER, table, texts, words  # noqa: E402

from roofline.llm import exact_dedup, line_dedup, near_dedup, substring_dedup  # noqa: E402

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# ---- exact dedup ----

def test_exact_dedup_equals_brute_force(spark):
    data = texts()
    got = exact_dedup.exact_dedup(table(spark, data)).collect()
    groups = defaultdict(list)
    for i, t in data:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter()
    for i, t in data:
        norm = (t or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        want[(i, max(ids) if ids else None, len(groups[norm]), sha(norm))] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_chunks_cover_the_text_and_move_with_it():
    rng = np.random.default_rng(5)
    data = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    cut = lambda d: [d[a:b] for a, b in zip([0, *exact_dedup.chunk_ends(d)], exact_dedup.chunk_ends(d))]
    assert b"".join(cut(data)) == data and all(len(x) <= 8192 for x in cut(data))
    shifted = cut(b"inserted in front " + data)
    assert len(set(cut(data)) & set(shifted)) >= len(cut(data)) - 2
    assert exact_dedup.chunk_ends(b"") == [] and exact_dedup.chunk_ends(b"ab") == [2]
    assert max(len(x) for x in cut(b"a" * 50_000)) == 8192


def test_chunks_with_one_key_and_two_digests_keep_their_digests(spark):
    """A collision of the 64-bit keys must not make two texts equal."""
    chunk = lambda s: {"key": 7, "sha": hashlib.sha256(s).digest(), "len": len(s)}
    data = [(0, 1, "a", [chunk(b"one")]), (1, 2, "b", [chunk(b"two")]), (2, 3, "a", [chunk(b"one")])]
    got = exact_dedup.recipes(spark.createDataFrame(data, exact_dedup.CHUNK_SCHEMA)).collect()
    recipe = {r.doc_id: tuple(r.recipe) for r in got}
    assert recipe[1] == recipe[3] != recipe[2]


# ---- line dedup ----

def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(data, min_docs, keep_first=False):
    seen = defaultdict(set)
    for i, t in data:
        for x in (t or "").split("\n"):
            if key(x):
                seen[key(x)].add((i, t))
    count = defaultdict(int)
    for i, t in data:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            count[k] += 1
    out = Counter()
    for i, t in data:
        parts = (t or "").split("\n")
        gone = [count[key(x)] >= min_docs if key(x) else False for x in parts]
        kept = [x for x, g in zip(parts, gone) if not g]
        out[(i, len(parts), sum(gone), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("min_docs", [1, 3, 10])
def test_line_dedup_equals_brute_force(spark, min_docs):
    data = texts()
    got = line_dedup.line_dedup(table(spark, data), min_docs)
    assert rows(got.select("doc_id", "n_lines", "n_dropped", "text")) == brute_lines(data, min_docs)


def test_line_dedup_keeps_the_first_holder(spark):
    data = [(i, f"Shared\nown {i}") for i in range(1, 13)] + [(13, "shared")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(table(spark, data), 10, keep_first=True).collect()}
    assert got[1] == "Shared\nown 1" and got[2] == "own 2" and got[13] == ""


def test_line_dedup_carries_other_columns(spark):
    got = line_dedup.line_dedup(table(spark), carry=True)
    assert {r.row.seg for r in got.collect()} == {"seg"} and got.count() == len(texts())


def test_deleting_documents_reverses_inserting_them(spark):
    old = table(spark, [(i, f"Shared\nown {i}") for i in range(1, 12)])
    more = table(spark, [(i, "shared\nsecond") for i in range(20, 32)])
    index = line_dedup.insert(line_dedup.LineIndex.empty(spark, 10, shards=4), old)
    bigger = line_dedup.insert(index, more)
    back = line_dedup.delete(bigger, more)
    same = lambda a, b: rows(a.select("shard", "key", "n_docs")) == rows(b.select("shard", "key", "n_docs"))
    assert not same(index.counts, bigger.counts) and same(index.counts, back.counts)
    lines = line_dedup.line_keys(line_dedup.documents(more))
    known = lambda x: rows(line_dedup.known_lines(lines, x).select("doc_id", "key"))
    assert len(known(bigger)) == 24 and len(known(back)) == 12 == len(known(index))


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_cuckoo_filter_holds_what_was_put_in_and_only_few_others():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.sized(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    others = rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
    assert f.contains(others).mean() < 0.001
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    f.delete(keys[2500:])
    assert not f.slots.any()


def test_a_full_cuckoo_filter_says_so():
    f = line_dedup.CuckooFilter(16)
    assert not f.insert(np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# ---- substring dedup ----

def brute_windows(data, w):
    first = {}
    for i, t in data:
        ws = words(t)
        for p in range(len(ws) - w + 1):
            if i is not None:
                k = tuple(ws[p:p + w])
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, t in data:
        ws = words(t)
        gone = [False] * len(ws)
        for p in range(len(ws) - w + 1):
            if i is not None and first[tuple(ws[p:p + w])] < i:
                gone[p:p + w] = [True] * w
        out[(i, len(ws), sum(gone), " ".join(x for x, g in zip(ws, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("block", [2000, 2])
def test_substring_dedup_equals_brute_force(spark, block):
    """``block`` 2 sends every anchor with three segments the way of large groups."""
    data = texts()
    got = substring_dedup.substring_dedup(table(spark, data), 50, block)
    assert rows(got.select("doc_id", "n_words", "n_removed", "text")) == brute_windows(data, 50)


def test_substring_dedup_on_texts_of_few_words(spark):
    """Runs of one word and short periods give many equal grams."""
    rng = np.random.default_rng(9)
    data = [(i, " ".join(rng.choice(["a", "b"], rng.integers(5, 60), p=[0.9, 0.1]))) for i in range(60)]
    for block in (1000, 3):
        got = substring_dedup.substring_dedup(table(spark, data), 12, block)
        assert rows(got.select("doc_id", "n_words", "n_removed", "text")) == brute_windows(data, 12)


def test_substring_dedup_layout_and_empty(spark):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark), carry=True, layout=True).collect()}
    assert got[9].text == "a\n\n\nb\n" and got[9].row.c == "c"
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_fm_index_counts_like_a_scan():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 6, 400), 0)
    index = substring_dedup.FMIndex(text, 8)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        pattern = rng.integers(1, 6, n)
        lo, hi = np.array([0]), np.array([len(text)])
        for s in pattern[::-1]:
            lo, hi = index.extend(lo, hi, np.array([s]))
        scan = [i for i in range(len(text) - n + 1) if (text[i:i + n] == pattern).all()]
        assert hi[0] - lo[0] == len(scan) and sorted(index.sa[lo[0]:hi[0]]) == scan


def test_segments_of_a_long_text_do_not_depend_on_stretches(monkeypatch):
    raw = " ".join(str(x) for x in np.random.default_rng(4).integers(0, 50, 3000)).encode()
    cover = lambda s: {(g, w) for a, b, g in zip(*s[:3]) for w in range(a, b + 1)}
    whole = cover(substring_dedup.document_segments(raw, 50))
    monkeypatch.setattr(substring_dedup, "STRETCH", 500)
    assert cover(substring_dedup.document_segments(raw, 50)) == whole


# ---- near dedup ----

def brute_groups(data, k, percent):
    sets, parent = [], list(range(len(data)))
    for _, t in data:
        ws = words((t or "").translate(LOWER))
        n = min(k, len(ws))
        sets.append({tuple(ws[p:p + n]) for p in range(len(ws) - n + 1)} if ws else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(data):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return Counter((i, len(sets[x]), least.get(root(x))) for x, (i, _) in enumerate(data))


@pytest.mark.parametrize("k,percent,block", [(3, 85, 512), (5, 80, 3)])
def test_near_groups_equal_brute_force(spark, k, percent, block):
    data = texts()
    got = near_dedup.near_groups(table(spark, data), k, percent, block=block)
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == brute_groups(data, k, percent)


def test_chains_of_near_copies_are_one_group(spark):
    """Neighbours of the chain are linked, its ends are not."""
    base = [f"w{i}" for i in range(100)]
    data = [(i, " ".join([f"new{j}" for j in range(2 * i)] + base[2 * i:])) for i in range(12)]
    got = near_dedup.near_groups(table(spark, data), 3, 85)
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == brute_groups(data, 3, 85)


def test_near_groups_of_an_empty_table(spark):
    assert near_dedup.near_groups(table(spark, [])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(6)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (4000, 500, 500))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    rx, ry = near_dedup.registers(x), near_dedup.registers(y)
    assert (near_dedup.merge(rx, ry) == near_dedup.registers(np.concatenate([x, b]))).all()
    got = near_dedup.estimate((rx > ry).sum(), (rx < ry).sum(), len(x), len(y))
    assert abs(got - 0.8) < 0.15


# ---- long words ----

def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048])
def test_long_words_that_differ_by_a_pattern_are_different(spark, size):
    """Polynomial sums modulo 2^64 over the letters are equal for these two, whatever the base."""
    rng = np.random.default_rng(1)
    common = " ".join(f"w{i}" for i in range(49))
    pair = [(1, f"{common} {thue_morse(size)}"), (2, f"{common} {thue_morse(size, 'ba')}"), (3, thue_morse(size)), (4, thue_morse(size, "ba"))]
    noise = ["".join(rng.choice(list("ab"), 4096)) for _ in range(4)]
    data = pair + [(10 + i, f"{common} {noise[i % 4]} {common}") for i in range(8)]
    got = substring_dedup.substring_dedup(table(spark, data), 50)
    assert rows(got.select("doc_id", "n_words", "n_removed", "text")) == brute_windows(data, 50)
    got = near_dedup.near_groups(table(spark, data), 3, 85)
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == brute_groups(data, 3, 85)
