"""Conversation repair, divergence audit and decontamination against plain statements of their rules."""

import functools
import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from cases import LOWER, table, texts  # noqa: E402

from roofline.llm import _runs, conversations, decontaminate, divergence, queries  # noqa: E402

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- words of a column ----

def test_runs_are_the_words_of_each_text():
    data = [t for _, t in texts()] + ["", None, "aB1é", "é", "ÀB c9", "a", "b", " a", "b ", "日x 9"]
    for inside, pattern in ((_runs.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (_runs.ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        for part in (data, data[3:], []):
            words, first, starts, ends = _runs.runs(pa.array([None, *part], pa.string()).slice(1), inside)
            words = words.to_pylist()
            for i, t in enumerate(part):
                raw = (t or "").encode()
                own = slice(first[i], first[i + 1])
                assert words[own] == [w.translate(LOWER) for w in re.findall(pattern, t or "")]
                assert [raw[a:b].decode().translate(LOWER) for a, b in zip(starts[own], ends[own])] == words[own]


def test_slices_are_the_whole_batch_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 9, None, "", "b" * 30, "c", "d"])], names=["i", "t"])
    parts = list(_runs.slices(batch, 1, 10))
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches([batch]).to_pylist() and len(parts) == 3
    data = [f"É{i} Ünï {'x' * (i % 9)} Ä" for i in range(400)]
    parts = _runs.slices(pa.RecordBatch.from_arrays([pa.array(data)], names=["t"]), 0, 900)
    lower = [x for b in parts for x in pc.ascii_lower(b.column(0).cast(pa.large_string())).to_pylist()]
    assert lower == [x.translate(LOWER) for x in data]


# ---- conversation repair ----

INITIALS = {"s": {"0": "s"}, "u": {"0": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}


def brute_repair(rows):
    """(cost, audit, lines) of (role, text) rows: the least of all edits, letter by letter."""
    faults, seen = [], set()
    for role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else
                      "truncated" if said[-1] not in ".!?" else "none")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in "0a":
            found.append((0, "", ()))
        if inserted < 3:
            initial = "a" if state == "u" else "u"
            cost, letters, lines = best(i, initial, inserted + 1)
            found.append((cost + 3, "I" + letters, ({"u": "user:", "a": "assistant:"}[initial], *lines)))
        if i < len(rows):
            role, text = rows[i]
            cost, letters, lines = best(i + 1, state, 0)
            found.append((cost + 4, "D" + letters, lines))
            if faults[i] in ("none", "truncated"):
                extra = 3 if faults[i] == "truncated" else 0
                if state in INITIALS.get(role[:1], {}):
                    cost, letters, lines = best(i + 1, role[0], 0)
                    found.append((cost + extra, "K" + letters, (f"{role}:{text}", *lines)))
                initial = "a" if state == "u" else "u"
                cost, letters, lines = best(i + 1, initial, 0)
                found.append((cost + extra + 3, "R" + letters, (f"{ {'u': 'user', 'a': 'assistant'}[initial]}:{text}", *lines)))
        return min(found) if found else (10**9, "", ())
    for i in range(len(rows), 0, -1):  # so that the recursion stays flat
        [best(i, state, 0) for state in "0sua"]
    return faults, best(0, "0", 0)


def brute_audit(rows):
    """The contract's row of each conversation of (conv_id, turn, role, text)."""
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        damaged[conv] += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(damaged[conv])
        turns = [t for known, t, _, _ in own if known]
        pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(own, own[1:])]
        faults, (cost, audit, lines) = brute_repair(tuple((r, t) for _, _, r, t in own))
        count = Counter(faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"],
                     count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost if own else 0, audit,
                     sha("\n".join(lines)))
    return out


def talks(seed=4):
    """Conversations with nulls, gaps, ties, repeated rows, other roles, blank and cut texts, and one long one."""
    rng = random.Random(seed)
    say = lambda: rng.choice(["One. ", "Two!", "Why?\n", "cut short", "", " \t", "é.", "é", "One. ", None])
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
    out = []
    for c in range(120):
        turns = [rng.choice([None, rng.randrange(9)]) if rng.random() < 0.2 else i for i in range(rng.randrange(1, 8))]
        out += [(None if c == 7 else c, t, role(), say()) for t in turns]
    out += [rng.choice(out) for _ in range(20)]
    out += [(500, i, ("system", "user", "assistant", "user")[i % 4] if i % 5 else role(), f"t{i % 40}." if i % 3 else say()) for i in range(700)]
    out += [(501, i, "user", " ") for i in range(60)] + [(501, 60, "assistant", "End.")]
    out += [(502, 5, "user", "Same.")] * 300 + [(503, 0, "user", "x" * 100_000), (503, 1, "assistant", "Yes.")]
    out.append((next(c for c in range(600, 10**4) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "Lost."))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, code int, k int, c string, part string"


@pytest.fixture(scope="module")
def talk_rows():
    return talks()


@pytest.mark.parametrize("size", [3, 4096])
def test_audit_equals_brute_force(spark, talk_rows, size):
    df = spark.createDataFrame([(*r, 1, None, "c", "p") for r in talk_rows], SCHEMA).repartition(5)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[c] for c in names) for r in conversations.audit(df, size=size).collect()}
    want = brute_audit(talk_rows)
    assert got == want
    assert any(v[6] == "" for v in want.values()) and {"D", "I", "K", "R"} <= set("".join(v[6] for v in want.values()))


def test_query_of_conversations(spark, sf_dir):
    got = queries.QUERIES["op11_conversations"](spark, sf_dir).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in got} == brute_audit(rows) and len(got) == len({r[0] for r in rows})


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    rng = random.Random(1)
    for _ in range(300):
        codes = [rng.randrange(12) for _ in range(rng.randrange(1, 12))]
        a, b = (conversations.vectors([rng.randrange(12) for _ in range(4)], conversations.END)[-1] for _ in range(2))
        again = conversations.fix_up(codes, a, b)
        old, new = conversations.vectors(codes, b)[-1], conversations.vectors(codes, a)[-1]
        assert (again or old) == new


def test_conversations_of_an_empty_table(spark):
    assert conversations.audit(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- divergence ----

def brute_divergence(rows, min_docs, top):
    """(lang, source, part, item, value, rank) of (text, lang, source), number by number."""
    in_docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        in_docs[lang].update(set(words))
        count[lang, source].update(words)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]

        def chance(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 1) // (total + len(kept)) for t in kept}
        p = {s: chance(count[lang, s]) for s in sources}
        q = chance(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pair))}
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(term)[:top])}
    return out


def test_divergence_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdéZ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary[:1 + int(300 * rng.random() ** 3)]) for _ in range(n))
    rows = [(prose(rng.randint(0, 200)), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "é", None, ""])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "xx", "a"), ("once only", "xx", "b"), ("12 34", "yy", "a"), ("the the", "zz", "a")]
    rows += [("hot word " * 3000, "en", "a"), rows[0], rows[0], ("one", "vv", "a"), ("one", "vv", "a"), ("one two", "vv", "b")]
    df = spark.createDataFrame([(i, t, l, s, None, "x", 1) for i, (t, l, s) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, term string, n string, p int")
    for top in (200, 5):
        got = [tuple(r) for r in divergence.divergence_audit(df.repartition(3), min_docs=3, top=top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, 3, top)
    assert divergence.divergence_audit(df.where("doc_id < 0")).count() == 0


def test_bitmaps_hold_every_term_once(spark):
    kept = spark.createDataFrame([("en" if i % 3 else "de", f"t{i // 2:04d}", f"s{i % 2}", 1 + i % 5, 10 + i // 40, True) for i in range(3000)],
                                 "lang string, term string, source string, n long, n_lang long, lead boolean")
    marks = divergence.bitmaps(kept).collect()
    terms = lambda r: {(r.lang, r.block, b) for b in range(64) if r.bits >> b & 1}
    got = Counter((r.lang, r.source, r.n) for r in marks for _ in terms(r))
    assert got == Counter((r.lang, r.source, r.n) for r in kept.collect())
    assert len(set().union(*map(terms, marks))) == kept.select("lang", "term").distinct().count()
    assert len({(r.lang, r.block, r.source, r.n) for r in marks}) == len(marks)


# ---- decontamination ----

def brute_scan(data, items, window):
    words = lambda t: [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))]
    windows = []
    for item, text in items:
        w = [m.group() for m in words(text)]
        windows += [(item, tuple(w[i:i + window])) for i in range(max(1, len(w) - window + 1)) if w]
    out = []
    for doc, text in data:
        found = words(text)
        w, hit, named = [m.group() for m in found], set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    named |= {str(item)} if item is not None else set()
        spans, ranges = [], sorted(hit)
        for i in ranges:
            if spans and i - 1 in hit:
                spans[-1][1] = found[i].end()
            else:
                spans.append([found[i].start(), found[i].end()])
        out.append((doc, len(w), len(hit), sorted(named), spans))
    return out


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it sleeps."), (2, "Ünïcode 7 is short"), (3, None), (4, " -- "),
         (10, "a a a a a a a a a a a a"), (None, "nobody has this name"), (2, "Zweite Zeile"), (5, "the quick brown fox jumps over the lazy dog and")]
LEAKS = [(1, None), (2, ""), (3, "x THE quick, brown FOX jumps over the\nlazy dog and... then it"), (4, "a " * 30), (5, "Ünïcode-7 is short Ünïcode 7 is"),
         (6, "nobody has this name! zweite zeile zweite"), (None, "日本 ünïcode 7\tis\tshort 日本"), (7, "the quick brown fox jumps over the lazy dog"),
         (8, "lorem " * 5000 + ITEMS[0][1]), (8, "lorem " * 5000 + ITEMS[0][1]), (9, "zweite-zeile" * 3), (11, "a a a a a"), (12, "ÜNÏCODE 7 is short")]


@pytest.mark.parametrize("window,max_words", [(10, 10**6), (10, 30), (3, 10**6)])
def test_scan_equals_brute_force(spark, window, max_words):
    items = spark.createDataFrame([(*x, "w") for x in ITEMS], "item_id long, text string, words string")
    got = decontaminate.scan(table(spark, LEAKS), items, window=window, max_words=max_words, carry=True).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [[s.start, s.end] for s in r.spans]) for r in got), key=key) == sorted(
        brute_scan(LEAKS, ITEMS, window), key=key)
    assert {r.row.lang for r in got} == {"en"} and {r.text for r in got} == {t for _, t in LEAKS}


def test_scan_of_generated_texts_and_empty_tables(spark):
    data = texts(n=12)
    items = [(i, " ".join((t or "").split()[5:30])) for i, t in data[:40:2]]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(table(spark, data), df).collect()
    assert Counter((r.doc_id, r.n_hit) for r in got) == Counter((d, n) for d, _, n, _, _ in brute_scan(data, items, 10))
    assert decontaminate.scan(table(spark, data), df.where("item_id < 0")).where("n_hit > 0 or size(items) > 0").count() == 0
    assert decontaminate.scan(table(spark, []), df).count() == 0


def test_queries_equal_their_sql(spark, sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name in ("op12_divergence", "op13_decontaminate"):
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(queries.ORACLE[name])
        order = [[d[0] for d in want.description].index(c) for c in got.columns]
        assert Counter(map(tuple, got.collect())) == Counter(tuple(np.take(np.array(r, object), order)) for r in want.fetchall())
