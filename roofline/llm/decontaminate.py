"""Benchmark decontamination: one Aho-Corasick automaton over the items' windows of words.

Questions and answers are normalised to lower-case words.  Every ``window`` words of an
item in a row (all its words, if it has fewer) are one pattern, a sequence of word numbers.
A document's words get the same numbers; a word that no item has returns the automaton to
its root, so only the runs of known words are scanned, each once.  Every word keeps the
place it has in the text as written, so a hit is a span of the original.

The patterns are broadcast, so their size is checked: above ``max_words`` words they are
dealt into several automata by a hash of the pattern, and the documents are scanned with
one after the other, each pass adding its hits to those of the pass before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, documents, shared_dir
from ._runs import ALNUM, runs, sliced

#: Words after A-Z are lower-cased: runs of digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_windows(bench: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(words, items): every distinct window of the items with the ids, as text, of those that have it.

    Null, empty and wordless items have no window; an item without an id has windows but is
    named by none; items that share an id are one item.
    """
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = bench.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).groupBy(
        "words").agg(F.collect_set("item").alias("items"))


class Patterns:
    """What a task needs of one automaton: the numbers of the words, the windows and their items."""

    def __init__(self, rows: list[tuple[list[str], list[str]]]):
        self.rows = rows
        self.machine = None

    def build(self) -> None:
        import ahocorasick
        vocabulary = sorted({w for words, _ in self.rows for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = pa.array(vocabulary, pa.large_string())
        self.shortest = min((len(words) for words, _ in self.rows), default=0)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, (words, _) in enumerate(self.rows):
            self.machine.add_word(tuple(number[w] for w in words), i)
        if self.rows:
            self.machine.make_automaton()

    def find(self, words: pa.Array, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Per text with a hit: the word ranges hit and the items."""
        if self.machine is None:
            self.build()
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not self.rows or not len(words):
            return out
        ids = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy()
        known = ids >= 0
        edge = np.zeros(len(ids) + 1, bool)
        edge[first] = True
        start, end = known.copy(), known.copy()
        start[1:] &= ~known[:-1] | edge[1:-1]
        end[:-1] &= ~known[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        owner = np.searchsorted(first, starts, "right") - 1
        for s, e, doc in zip(starts.tolist(), ends.tolist(), owner.tolist()):
            base = s - int(first[doc])
            for at, i in self.machine.iter(tuple(ids[s:e].tolist())):
                spans, items = out.setdefault(doc, ([], set()))
                size = len(self.rows[i][0])
                if spans and base + at + 1 - size <= spans[-1][1] and base + at + 1 - size >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], base + at + 1))
                else:
                    spans.append((base + at + 1 - size, base + at + 1))
                items.update(self.rows[i][1])
        return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def automata(windows: DataFrame, max_words: int) -> Iterator[Patterns]:
    """The patterns of ``item_windows`` in automata of about ``max_words`` words; one, if that holds them."""
    total = windows.agg(F.sum(F.size("words") + F.size("items"))).first()[0] or 0
    shards = max(1, -(-total // max_words))
    for i in range(shards):
        own = windows.where(F.pmod(F.xxhash64("words"), F.lit(shards)) == i) if shards > 1 else windows
        yield Patterns([(list(w), list(x)) for w, x in own.collect()])  # at most about max_words words


def scan(docs: DataFrame, bench: DataFrame, window: int = 10, max_words: int = 1_000_000, id_col: str = "doc_id",
         text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, text, n_words, n_hit, spans, items) of every row; ``carry`` adds ``row``, its other columns.

    ``n_hit`` words lie inside an occurrence of a window of an item; ``spans`` are the
    stretches they form, as code points of the text as written (start, end); ``items`` are
    the ids of the items with a window in the text.  Null and empty texts have no words;
    ids may be null or repeat, each row is judged alone; an empty table gives no rows; an
    empty benchmark hits nothing.
    """
    home = shared_dir(docs.sparkSession)
    rows = documents(docs, id_col, text_col, carry).drop("thash")
    extra = [f.name for f in rows.schema if f.name == "row"]
    windows = cut(item_windows(bench, window), f"{home}/windows")
    schema = T.StructType.fromDDL("doc_id long, text string, n_words long, hits array<struct<a:long,b:long>>, "
                                  "spans array<struct<start:long,end:long>>, items array<string>")
    for x in extra:
        schema.add(x, rows.schema[x].dataType)
    hits_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scanner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = shared.value
            for b in sliced(batches, 1):
                words, first, starts, ends = runs(b.column(1), ALNUM)
                found = patterns.find(words, first)
                before = b.column("hits").to_pylist() if "hits" in b.schema.names else [[]] * b.num_rows
                named = b.column("items").to_pylist() if "items" in b.schema.names else [[]] * b.num_rows
                hits, spans, items = [], [], []
                for i in range(b.num_rows):
                    got, more = found.get(i, ([], set()))
                    ranges = merge_spans(got + [(x["a"], x["b"]) for x in before[i]])
                    hits.append([{"a": x, "b": y} for x, y in ranges])
                    items.append(sorted(more | set(named[i])))
                    places = []
                    if ranges:
                        raw, at = b.column(1)[i].as_py().encode("utf-8", "surrogatepass"), int(first[i])
                        done, seen = 0, 0  # bytes and code points so far
                        for x, y in ranges:
                            marks = []
                            for stop in (int(starts[at + x]), int(ends[at + y - 1])):
                                seen += len(raw[done:stop].decode("utf-8", "surrogatepass"))
                                done = stop
                                marks.append(seen)
                            places.append({"start": marks[0], "end": marks[1]})
                    spans.append(places)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.diff(first), pa.int64()), pa.array(hits, hits_type),
                     pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string())), *[b.column(x) for x in extra]],
                    names=["doc_id", "text", "n_words", "hits", "spans", "items", *extra])
        return run

    context = docs.sparkSession.sparkContext
    for i, patterns in enumerate(automata(windows, max_words)):
        if i:
            rows = cut(rows, f"{home}/pass{i}")
        rows = rows.mapInArrow(scanner(context.broadcast(patterns)), schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return rows.select("doc_id", "text", "n_words", n_hit.alias("n_hit"), "spans", "items", *extra)
