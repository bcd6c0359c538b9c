"""Near-duplicate groups by SetSketch registers.

A document's set of word shingles is sketched by registers of exponentially spaced,
truncated minima.  Registers of a union are the maxima of the registers, so sketches
merge; equal registers are as likely as the sets are similar, so bands of registers
bring likely pairs together; and the likelihood of the register comparison gives an
estimate of the similarity that drops hopeless pairs.  Every link is confirmed on the
full sets.

Documents with one set are a class and only classes are compared.  Within a bucket no
pairs are spread out: its members are first compared with its hubs.  The members that are
then still apart from the bucket's largest component are compared, by sketch and in
blocks, with the bucket's other components, the likeliest first, until a link is found
or no pair is left that the estimate allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, cut, documents, map_batches, same_row, shared_dir
from ._runs import FILLED, runs, sliced
from ._runs import word_hashes as batch_hashes
from .fingerprints import mix
from .substring_dedup import _unpack, packed_texts, range_hashes, word_hashes

#: Registers, their base and rate, and the largest value (16 bits).
M, B, A, Q = 128, 1.001, 20.0, (1 << 16) - 2
BAND = 4
_rng = np.random.default_rng(20260803)
MULTIPLY, ADD = (_rng.integers(0, 2**64, M, dtype=U64) for _ in range(2))
MULTIPLY |= U64(1)


def shingles(raw: bytes, k: int) -> np.ndarray:
    """The sorted distinct hashes of the ``k``-word shingles of a text, A-Z lower-cased; of a shorter
    text its whole sequence, of one without words none."""
    return shingle_set(word_hashes(raw.lower()), k)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The same of the hashes of a text's words."""
    if not len(words):
        return np.zeros(0, U64)
    k = min(k, len(words))
    at = np.arange(len(words) - k + 1)
    return np.unique(range_hashes(words, at, at + k))


def registers(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes: floor(1 - log_B of the smallest exponential variate)."""
    least = np.full(M, 0xFFFFFFFF, U64)
    for i in range(0, len(values), 2048):
        least = np.minimum(least, ((values[i:i + 2048, None] * MULTIPLY + ADD) >> U64(32)).min(axis=0))
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(variate) / np.log(B)), 0, Q + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


GRID = np.linspace(0.0, 1.0, 101)


def estimate(more, less, n_a, n_b) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets of n_a and n_b shingles, where ``more`` registers of the
    first are larger and ``less`` smaller (arrays of pairs)."""
    more, less, n_a, n_b = (np.asarray(x, np.float64)[..., None] for x in (more, less, n_a, n_b))
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.minimum(GRID, np.minimum(u / v, v / u))  # no larger than the sizes allow
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (B - 1) / B) / np.log(B)
    up, down = p(u - v * j), p(v - u * j)
    same = np.maximum(1 - up - down, 1e-12)
    like = more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(same)
    return np.take_along_axis(j, like.argmax(axis=-1)[..., None], -1)[..., 0]


def least_estimate(threshold: float) -> float:
    """Five standard errors of the estimate below the threshold."""
    return threshold - 5 * (threshold * (1 - threshold) / M) ** 0.5


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, thash, n_shingles, c, regs) of ``documents()``; ``c`` names the set, null for an empty one."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, c, regs = [], [], []
        words, place, _, _ = runs(b.column(1), FILLED)
        hashes = batch_hashes(words)
        for i in range(b.num_rows):
            s = shingle_set(hashes[place[i]:place[i + 1]], k)
            n.append(len(s))
            if len(s):
                c.append(np.array([mix(s).sum(), mix(s ^ MULTIPLY[0]).sum() + U64(len(s))], U64).tobytes())
                regs.append(registers(s).tobytes())
            else:
                c.append(None)
                regs.append(None)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(c, pa.binary()),
                                           pa.array(regs, pa.binary())], names=["doc_id", "thash", "n_shingles", "c", "regs"])
    return map_batches(docs, run, "doc_id long, thash long, n_shingles long, c binary, regs binary")


def bands(classes: DataFrame) -> DataFrame:
    """(band, bucket, c): a class is in one bucket per band of registers."""
    keys = [F.xxhash64(F.lit(i), F.substring("regs", 2 * BAND * i + 1, 2 * BAND)) for i in range(M // BAND)]
    return classes.select(F.posexplode(F.array(*keys)).alias("band", "bucket"), "c")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have 100 * intersection >= percent * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): those pairs whose full sets have 100 * intersection >= percent * union."""
    least = least_estimate(percent / 100)
    side = lambda x: sets.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"),
                                 F.col("z").alias(f"z_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b", "z_a", "z_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(64)(lambda z: shingles(_unpack(z), k))
        for batch in sliced(batches, 6):
            a, b, na, nb, ra, rb, za, zb = (c.to_pylist() for c in batch.columns)
            x, y = (np.frombuffer(b"".join(r), "<u2").reshape(-1, M) for r in (ra, rb))
            likely = estimate((x > y).sum(axis=1), (x < y).sum(axis=1), na, nb) >= least
            good = []
            for i in np.flatnonzero(likely).tolist():
                if similar(read(za[i]), read(zb[i]), percent):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in good], pa.binary()) for c in (a, b)], names=["a", "b"])
    return met.mapInArrow(run, "a binary, b binary")


def components(labels: DataFrame, edges: DataFrame, home: str) -> DataFrame:
    """(c, comp): ``labels`` after joining the components that edges (a, b) of their members connect.

    Labels spread over the edges between components and follow their own label's label, so
    that a chain takes as many rounds as its length has binary digits.
    """
    own = lambda x: labels.select(F.col("c").alias(x), F.col("comp").alias(f"comp_{x}"))
    links = edges.join(own("a"), "a").join(own("b"), "b").where("comp_a != comp_b").select(
        F.explode(F.array(F.struct(F.col("comp_a").alias("s"), F.col("comp_b").alias("t")),
                          F.struct(F.col("comp_b").alias("s"), F.col("comp_a").alias("t")))).alias("x"))
    links = cut(links.select("x.*").distinct(), f"{home}/links")
    first = links.groupBy("s").agg(F.min("t").alias("t"))
    state = cut(first.select(F.col("s").alias("v"), F.least("s", "t").alias("l")), f"{home}/state0")
    step = 0
    while True:
        step += 1
        near = links.join(state.select(F.col("v").alias("t"), "l"), "t").groupBy("s").agg(F.min("l").alias("near"))
        new = state.join(near, state["v"] == near["s"]).select("v", F.least("l", "near").alias("m"), F.col("l").alias("old"))
        up = state.select(F.col("v").alias("m"), F.col("l").alias("mm"))
        nxt = cut(new.join(up, "m").select("v", "mm", (F.col("mm") != F.col("old")).alias("moved")), f"{home}/state{step}")
        state = nxt.select("v", F.col("mm").alias("l"))
        if nxt.where("moved").isEmpty():
            break
    to = state.where("v != l")
    return cut(labels.join(to, labels["comp"] == to["v"], "left").select("c", F.coalesce("l", "comp").alias("comp")),
               f"{home}/labels")


def star_pairs(members: DataFrame, labels: DataFrame, hubs: int, home: str) -> DataFrame:
    """(a, b): of each bucket its hubs with the members outside the hub's component."""
    own = members.join(labels, "c")
    hub = F.array_distinct(F.array(*[F.min_by(F.struct("c", "comp"), F.xxhash64("c", F.lit(i))) for i in range(hubs)]))
    chosen = cut(own.groupBy("bucket").agg(hub.alias("hubs"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("lo != hi").select("bucket", F.explode("hubs").alias("hub")), f"{home}/hubs")
    return own.join(chosen, "bucket").where(F.col("comp") != F.col("hub.comp")).select(
        F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b")).distinct()


def rest_links(members: DataFrame, labels: DataFrame, sets: DataFrame, k: int, percent: int, block: int,
               home: str) -> DataFrame:
    """(a, b): confirmed links between components, from the members outside their bucket's largest one.

    Such a member is compared with the members of the bucket's other components, block by
    block: by sketch, then, the likeliest first, on the full sets, until a component is
    linked or has no member left that the estimate allows.  A pair is compared in the
    first band that its sketches share.  Only links leave a task.
    """
    threshold = percent / 100
    least = least_estimate(threshold)
    size = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    own = members.join(labels.join(size, "comp"), "c")
    main = own.groupBy("bucket").agg(F.max(F.struct("size", "comp")).alias("main"), F.min("comp").alias("lo"),
                                     F.max("comp").alias("hi")).where("lo != hi").select("bucket", F.col("main.comp").alias("main"))
    rows = cut(own.join(cut(main, f"{home}/main"), "bucket").select("bucket", "band", "c", "comp", "main"), f"{home}/open")
    parts = lambda n: F.ceil(n / block).cast("int")
    grid = cut(rows.groupBy("bucket").agg(parts(F.count(F.lit(1))).alias("blocks"),
                                          parts(F.count_if(F.col("comp") != F.col("main"))).alias("outer")), f"{home}/grid")
    full = rows.join(grid, "bucket").join(sets, "c")
    put = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = ["band", "c", "comp", "n", "regs", "z"]
    right = full.withColumn("i", put("blocks")).select("bucket", "i", over("outer").alias("o"), *data)
    left = full.where("comp != main").withColumn("o", put("outer")).select("bucket", over("blocks").alias("i"), "o", *data)
    left = left.toDF(*left.columns)  # names of its own: both sides come from one table

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes]] = []
        if left.num_rows and right.num_rows:
            band = left["band"][0].as_py()
            cl, cr, pl, pr, zl, zr = (t[c].to_pylist() for c in ("c", "comp", "z") for t in (left, right))
            nl, nr = left["n"].to_numpy(), right["n"].to_numpy()
            rl, rr = (np.frombuffer(b"".join(t["regs"].to_pylist()), "<u2").reshape(-1, M) for t in (left, right))
            number = {p: i for i, p in enumerate(set(pl) | set(pr))}
            comps = np.array([number[p] for p in pr])
            read = lru_cache(2 * block)(lambda i: shingles(_unpack(zr[i]), k))
            for i in range(len(cl)):
                on = np.flatnonzero(comps != number[pl[i]])
                equal = rl[i] == rr[on]
                # Equal registers are as likely as the sets are similar: a cheap bound before the likelihood.
                near = (equal.sum(axis=1) >= int(least * M)) & (
                    equal.reshape(len(on), M // BAND, BAND).all(axis=2).argmax(axis=1) == band)
                on = on[near]
                if not len(on):
                    continue
                e = estimate((rl[i] > rr[on]).sum(axis=1), (rl[i] < rr[on]).sum(axis=1), np.full(len(on), nl[i]), nr[on])
                s, linked = shingles(_unpack(zl[i]), k), set()
                for j in on[np.argsort(-e, kind="stable")][:int((e >= least).sum())].tolist():
                    if comps[j] not in linked and similar(s, read(j), percent):
                        linked.add(comps[j])
                        out.append((min(cl[i], cr[j]), max(cl[i], cr[j])))
        cols = list(zip(*out)) or [(), ()]
        return pa.table({x: pa.array(c, pa.binary()) for x, c in zip("ab", cols)})
    return left.groupBy("bucket", "i", "o").cogroup(right.groupBy("bucket", "i", "o")).applyInArrow(
        compare, "a binary, b binary").distinct()


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, hubs: int = 2, block: int = 512,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, thash, n_shingles, component_id, first): groups of linked documents.

    Documents are linked when 100 * intersection >= percent * union of their sets of
    ``k``-word shingles; ``component_id`` is the smallest doc_id that links reach,
    ``first`` the (doc_id, thash) of that row.  Null, empty and blank texts have no
    shingles and are linked with nothing.  Rows with equal sets are linked; a null doc_id
    is smaller than any other only in ``first``.  An empty table gives no rows.
    """
    home = shared_dir(docs.sparkSession)
    base = documents(docs, id_col, text_col)
    rows = cut(sketch_documents(base, k), f"{home}/rows")
    row = F.struct("doc_id", "thash")
    classes = cut(rows.where("c is not null").groupBy("c").agg(
        F.min("doc_id").alias("least"), F.min(row).alias("first"), F.first("n_shingles").alias("n"),
        F.first("regs").alias("regs")), f"{home}/classes")
    spread = bands(classes)
    buckets = cut(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), f"{home}/buckets")
    members = cut(spread.join(buckets, "bucket"), f"{home}/members")
    labels = cut(members.select("c").distinct().select("c", F.col("c").alias("comp")), f"{home}/labels")
    # The sets of the classes that share a bucket, as compressed texts.
    texts = packed_texts(base)
    holders = classes.join(labels.select("c"), "c").select("c", "n", "regs", "first.doc_id", "first.thash").alias("h")
    sets = cut(texts.join(holders, same_row(texts, holders)).select("c", "n", "regs", "z").dropDuplicates(["c"]), f"{home}/sets")
    pairs = cut(star_pairs(members, labels, hubs, f"{home}/star"), f"{home}/pairs")
    labels = components(labels, cut(confirm(pairs, sets, k, percent), f"{home}/confirmed"), f"{home}/star")
    links = cut(rest_links(members, labels, sets, k, percent, block, f"{home}/rest"), f"{home}/links")
    labels = components(labels, links, f"{home}/rest")
    ends = labels.join(classes, "c").groupBy("comp").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    named = labels.join(ends, "comp").select("c", "component_id", F.col("first").alias("whole"))
    out = cut(classes.join(named, "c", "left").select(
        "c", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("whole", "first").alias("first")), f"{home}/out")
    full = rows.join(out, "c", "left")
    return full.select("doc_id", "thash", "n_shingles",
                       F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                       F.when(F.col("c").isNull(), row).otherwise(F.col("first")).alias("first"))
