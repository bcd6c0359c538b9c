"""Source divergence audit by count-level bitmaps.

How far a source's words differ from its language's, and sources from each other, is a sum
over all terms of f(p, q); p and q depend on a term only through its counts in the two
groups.  So the terms of a language are numbered, and per (group, count) the numbers of
the terms with that count are a bitmap: words of 64 terms, kept where they are not zero.
AND and popcount of two groups' bitmaps give the joint cells of a pair: how many terms
have count c here and d there.  The cells are multiplied by f; those with a zero are what
is left of a level, or of the vocabulary, when the others are taken off.

Terms are numbered by falling count, so that the 64 terms of a word have few levels.  A
language's terms are dealt in ranges; a word never crosses a range, so its pairs need no
other task, and what leaves a task are sums per pair of sources.

All arithmetic is on integers: p is at most 10^9 + 1, f and its sums over the terms of a
language stay below 2^63 for vocabularies up to 10^9 terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, shared_dir, shuffle_partitions
from ._runs import LETTERS, runs, sliced

SCALE = 1_000_000_000
WIDTH = 64  # terms of a bitmap word


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): occurrences and rows with the term, summed
    in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            words, first, _, _ = runs(b.column(2), LETTERS)
            code = words.dictionary_encode()
            term, kinds = code.indices.to_numpy().astype(np.int64), len(code.dictionary)
            doc = np.repeat(np.arange(b.num_rows, dtype=np.int64), np.diff(first))
            group = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["lang", "source"])
            label, inverse = {}, np.empty(b.num_rows, np.int64)
            for i, g in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                inverse[i] = label.setdefault(g, len(label))
            cells, n = np.unique(doc * kinds + term, return_counts=True)  # a row's terms
            key, where = np.unique(inverse[cells // max(kinds, 1)] * kinds + cells % max(kinds, 1), return_inverse=True)
            pick = pa.array(np.unique(inverse, return_index=True)[1]).take(pa.array(key // max(kinds, 1)))
            rows = group.take(pick)
            yield pa.RecordBatch.from_arrays(
                [rows.field(0), rows.field(1), code.dictionary.take(pa.array(key % max(kinds, 1))).cast(pa.string()),
                 pa.array(np.bincount(where, n, len(key)).astype(np.int64)), pa.array(np.bincount(where, minlength=len(key)))],
                names=["lang", "source", "term", "n", "docs"])
    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # Dealt by (lang, term), so that the sums by source and those of the language need one shuffle.
    return counted.repartition(shuffle_partitions(docs.sparkSession), "lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, source, n, n_lang, lead): the counts of the terms in at least ``min_docs`` rows of their
    language; ``lead`` marks one row of each term."""
    own = Window.partitionBy("lang", "term")
    return counts.select("lang", "term", "source", "n", F.sum("n").over(own).alias("n_lang"),
                         (F.col("source") == F.min("source").over(own)).alias("lead"),
                         F.sum("docs").over(own).alias("in_docs")).where(F.col("in_docs") >= min_docs).drop("in_docs")


def bitmaps(kept: DataFrame) -> DataFrame:
    """(lang, block, source, n, bits): the terms with count ``n`` in a group, 64 numbers to a block.

    Terms are numbered by falling count in the language within ranges of (lang, count, term).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = TaskContext.get().partitionId() << 32, 0

        def numbered(table: pa.Table) -> np.ndarray:
            """The number of each row's term, counted on from ``base``; a language begins a block."""
            lang, term = (table[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
            tongue = np.diff(lang) != 0
            number = np.concatenate([[0], np.cumsum(tongue | (np.diff(term) != 0))]) + base
            for at in (np.flatnonzero(tongue) + 1).tolist():
                number[at:] += -number[at] % WIDTH
            return number

        def words(table: pa.Table, number: np.ndarray) -> pa.RecordBatch:
            source = table["source"].combine_chunks().dictionary_encode()
            code, n, block = source.indices.to_numpy(), table["n"].to_numpy(), number // WIDTH
            order = np.lexsort((n, code, block))
            code, n, block, bit = code[order], n[order], block[order], number[order] % WIDTH
            first = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(code) != 0) | (np.diff(n) != 0)]))
            bits = np.bitwise_or.reduceat(np.uint64(1) << bit.astype(np.uint64), first)
            return pa.RecordBatch.from_arrays([
                table["lang"].combine_chunks().take(pa.array(order[first])), pa.array(part + block[first]),
                source.dictionary.take(pa.array(code[first])), pa.array(n[first]), pa.array(bits.view(np.int64))],
                names=["lang", "block", "source", "n", "bits"])

        held: pa.Table | None = None  # the rows of a block that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            number = numbered(held)
            start = int(np.searchsorted(number, number[-1] // WIDTH * WIDTH))
            if start:
                yield words(held.slice(0, start), number[:start])
                held, base = held.slice(start), int(number[-1]) // WIDTH * WIDTH
        if held is not None:
            yield words(held, numbered(held))
    order = ["lang", F.desc("n_lang"), "term"]
    dealt = kept.repartitionByRange(shuffle_partitions(kept.sparkSession), *order).sortWithinPartitions(*order, "source")
    return dealt.select("lang", "term", "source", "n").mapInArrow(run, "lang string, block long, source string, n long, bits long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count: 1 + floor(10^9 (n + 1) / (total + terms)), exact."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + 1), whole(total + terms))


def divergence(p: Column, q: Column) -> Column:
    """f: floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


TILE = 2048


def cell_sums(levels: DataFrame) -> DataFrame:
    """(lang, source, item, value): over the joint cells of a pair with a count in both groups, cells times
    f(c, d) - f(c, 0) - f(0, d) + f(0, 0): what the cells add to the sums that take every count as zero
    on the other side.  ``levels``: bitmaps with ``p``, and ``zero``, p of the count 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}

        def f(p, q):
            return (p - q) * (p - q) // q

        def block(lang: str, source: list[str], p: np.ndarray, zero: np.ndarray, bits: np.ndarray) -> None:
            names: dict[str, int] = {}
            g = np.array([names.setdefault(x, len(names)) for x in source])
            name, kinds = list(names), len(names)
            for i in range(0, len(p), TILE):
                for j in range(0, len(p), TILE):
                    cells = np.bitwise_count(bits[i:i + TILE, None] & bits[None, j:j + TILE])
                    a, b = np.nonzero(cells)
                    n = cells[a, b].astype(np.int64)
                    a, b = a + i, b + j
                    other = g[a] != g[b]
                    a, b, n = a[other], b[other], n[other]
                    value = n * (f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b]))
                    pair, where = np.unique(g[a] * kinds + g[b], return_inverse=True)
                    total = np.zeros(len(pair), np.int64)
                    np.add.at(total, where, value)
                    for x, v in zip(pair.tolist(), total.tolist()):
                        key = lang, name[x // kinds], name[x % kinds]
                        sums[key] = sums.get(key, 0) + v

        def out() -> pa.RecordBatch:
            lang, source, item = zip(*sums) if sums else ((), (), ())
            return pa.RecordBatch.from_arrays([
                *(pa.array(x, pa.string()) for x in (lang, source, item)), pa.array(list(sums.values()), pa.int64())],
                names=["lang", "source", "item", "value"])

        held: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = pa.concat_tables([held, table]) if held is not None else table
            key = held["block"].to_numpy()
            tongue = held["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
            ends = np.flatnonzero((np.diff(key) != 0) | (np.diff(tongue) != 0)) + 1
            start = 0
            for end in ends.tolist():
                part = held.slice(start, end - start)
                block(part["lang"][0].as_py(), part["source"].to_pylist(), part["p"].to_numpy(), part["zero"].to_numpy(),
                      part["bits"].to_numpy().view(np.uint64))
                start = end
            held = held.slice(start).combine_chunks()
            if len(sums) > 500_000:
                yield out()
                sums.clear()
        if held is not None and held.num_rows:
            block(held["lang"][0].as_py(), held["source"].to_pylist(), held["p"].to_numpy(), held["zero"].to_numpy(),
                  held["bits"].to_numpy().view(np.uint64))
        yield out()
    n = shuffle_partitions(levels.sparkSession)
    dealt = levels.repartition(n, "lang", "block").sortWithinPartitions("lang", "block")
    return dealt.select("lang", "block", "source", "p", "zero", "bits").mapInArrow(
        run, "lang string, source string, item string, value long")


def divergence_audit(docs: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of each language.

    Terms are runs of letters and of everything beyond ASCII, A-Z lower-cased; a language
    keeps those in at least ``min_docs`` of its rows.  A group gives each kept term
    p = 1 + floor(10^9 (count + 1) / (N + V)).  Part ``pair``: every other source of the
    language with the sum of f(p, q) over all kept terms, q the other's p.  Part ``term``:
    the ``top`` terms that the group has and uses more than its language does, with f(p, q),
    q the language's p.  Ranks run by falling value, then by item.

    Null text, lang and source count as empty; a group without terms has pairs like any
    other; a language without kept terms has pairs of value 0.  Repeated rows count as often
    as they are there.  An empty table gives no rows; other columns are not read.
    """
    home = shared_dir(docs.sparkSession)
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(cell(lang_col).alias("lang"), cell(source_col).alias("source"), cell(text_col).alias("text"))
    kept = cut(kept_terms(term_counts(rows), min_docs), f"{home}/kept")
    marks = cut(bitmaps(kept), f"{home}/bitmaps")
    levels = cut(marks.groupBy("lang", "source", "n").agg(F.sum(F.bit_count("bits")).alias("terms")), f"{home}/levels")
    tongues = cut(kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("n_lang_all")), f"{home}/tongues")
    sizes = levels.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("own"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(tongues, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("own", F.lit(0)).alias("own"),
        F.coalesce("v", F.lit(0)).alias("v"), "n_lang_all")
    nothing = F.lit(0).cast("long")
    groups = cut(groups.withColumn("zero", F.when(F.col("v") > 0, share(nothing, F.col("total"), F.col("v")))), f"{home}/groups")

    facts = groups.where("v > 0").select("lang", "source", "total", "v", "zero")
    with_p = lambda table: table.join(facts, ["lang", "source"]).withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("v")))
    cells = cell_sums(with_p(marks)).groupBy("lang", "source", "item").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("cells"))
    # Every count against zero on the other side.
    level = with_p(levels).select("lang", "source", "p", "terms", "zero")
    other = facts.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    times = lambda n, f: n.cast("decimal(19,0)") * f.cast("decimal(19,0)")
    met = level.join(other, "lang").where("source != item")
    here = met.select("lang", "source", "item", times(F.col("terms"), divergence(F.col("p"), F.col("other"))).alias("edge"))
    there = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                       times(F.col("terms"), divergence(F.col("other"), F.col("p"))).alias("edge"))
    edges = here.unionByName(there).groupBy("lang", "source", "item").agg(F.sum("edge").alias("edges"))
    side = lambda item, own, zero: groups.select("lang", F.col("source").alias(item), F.col("own").alias(own),
                                                 F.col("zero").alias(zero), *(["v"] if item == "source" else []))
    pairs = side("source", "n_a", "z_a").join(side("item", "n_b", "z_b"), "lang").where("source != item")
    key = ["lang", "source", "item"]
    both_zero = times(F.col("v") - F.col("n_a") - F.col("n_b"), divergence(F.col("z_a"), F.col("z_b")))
    value = F.coalesce(both_zero, F.lit(0)) + F.coalesce("edges", F.lit(0)) + F.coalesce("cells", F.lit(0))
    pair = pairs.join(edges, key, "left").join(cells, key, "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(order))

    used = with_p(kept).join(tongues.select("lang", "n_lang_all"), "lang").withColumn(
        "q", share(F.col("n_lang"), F.col("n_lang_all"), F.col("v"))).where("p > q")
    term = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                       divergence(F.col("p"), F.col("q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.unionByName(term)
