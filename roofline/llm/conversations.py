"""Conversation repair: rank-convergence parallel Viterbi over chunks of turns.

A repaired conversation is empty or has the role initials ``s?(ua)+``; keeping, reroling,
deleting and inserting turns cost what ``Costs`` says.  The cheapest edits are a shortest
path over four states: nothing yet, after ``s``, after ``u``, after ``a``.  Its cost-to-go
is a vector of four numbers per row, computed from the end; a step is a min-plus product.

Rows are dealt by range of (conversation, turn, role, text), so a conversation of any
length is spread over tasks, and cut into chunks.  Every chunk starts from a speculative
vector.  Fix-up passes then run a chunk again from the vector that the next chunk has
found, only as far as the new vectors and the old differ by more than a constant, until no
chunk's vector changes: a constant shifts all costs alike and no decision.  The stitched
vectors drive the tracing: of the edits that keep the cost, the least in ASCII.  A chunk's
tracing depends on what comes before it by its entry state alone, so it is done for all
four, the maps are composed in rounds that double their reach, and the right one is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, shared_dir, shuffle_partitions

BLANK = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a.  Where an inserted or reroled turn leads, and its initial.
NEXT, WRITES = (2, 2, 3, 2), "uuau"
#: From (state, initial) to the state after a kept turn; others are illegal.  Initials: s, u, a, any other.
KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: Cost to go after the last row: nothing to do, insert two turns, insert one, nothing to do.
END = (0, 2 * INSERT, INSERT, 0)
SPECULATIVE = (0, 0, 0, 0)
#: A row's code: its initial plus four times its kind (sound, truncated, to be deleted).
SOUND, CUT_SHORT, FORCED = 0, 1, 2


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times): rows with the faults that the CRC-32 of ``id:turn`` modulo 20 names:
    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 doubles it, 4 makes the role user.
    Null cells are one space; a null turn stays null as a place in the order."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", cell(id_col), cell(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(cell(text_col), ".!?", "")).otherwise(cell(text_col))
    return rows.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(cell(role_col)).alias("role"), text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times")).where("times > 0")


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Join condition by the named columns; the first may be null."""
    on = a[columns[0]].eqNullSafe(b[columns[0]])
    for c in columns[1:]:
        on = on & (a[c] == b[c])
    return on


def ordered_rows(rows: DataFrame, home: str) -> DataFrame:
    """(part, at, conv_id, turn, role, text, times, fault, code) of (conv_id, turn, role, text, times).

    Equal rows are one row with ``times``; all but the first of them are duplicates.  Rows
    run by turn (nulls first), then role and text; ``at`` counts the rows of range ``part``.
    """
    once = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").cast("long").alias("times")), f"{home}/once")
    kept = F.rtrim(F.col("text"), F.lit(BLANK))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    named = once.select("*", said.alias("said"), place.alias("place"), (kept == "").alias("blank"),
                        (~F.substring(kept, -1, 1).isin(".", "!", "?")).alias("short"))
    again = named.groupBy("conv_id", "said").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    told = named.join(again, named["conv_id"].eqNullSafe(again["c"]) & (named["said"] == again["s"]), "left")
    late = F.coalesce(F.col("first") < F.col("place"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(late, "duplicate").when(F.col("short"), "truncated").otherwise("none")
    kind = F.when(fault.isin("blank", "duplicate"), FORCED).when(fault == "truncated", CUT_SHORT).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    order = ["conv_id", "turn", "role", "text"]
    dealt = told.select(*order, "times", fault.alias("fault"), (initial + 4 * kind).alias("code")).repartitionByRange(
        shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), *b.columns],
                                             names=["part", "at", *b.schema.names])
            at += n
    return cut(dealt.mapInArrow(run, "part long, at long, conv_id long, turn long, role string, text string, times long, "
                                     "fault string, code int"), f"{home}/rows")


@lru_cache(1 << 16)
def step(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    """The cost-to-go before a row, given that after it, less its smallest."""
    cost = costs(after, code)
    least = min(cost)
    return tuple(x - least for x in cost)


def costs(after: tuple[int, ...], code: int) -> list[int]:
    kind, initial = divmod(code, 4)
    cost = [DELETE + x for x in after]
    if kind != FORCED:
        extra = TRUNCATED if kind == CUT_SHORT else 0
        for s in range(4):
            cost[s] = min(cost[s], REROLE + extra + after[NEXT[s]])
            if (s, initial) in KEEP:
                cost[s] = min(cost[s], extra + after[KEEP[s, initial]])
    cost[2], cost[3] = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return [min(cost[0], INSERT + cost[2]), min(cost[1], INSERT + cost[2]), cost[2], cost[3]]


@lru_cache(1 << 16)
def choose(after: tuple[int, ...], code: int, state: int) -> tuple[str, str, str, int, int]:
    """(initials inserted before the row, edit, initial it gets if reroled, state after, cost): the least in
    ASCII of the cheapest edits of a row; ``D`` < ``I`` < ``K`` < ``R``."""
    cost, (kind, initial), before, spent = costs(after, code), divmod(code, 4), "", 0
    extra = TRUNCATED if kind == CUT_SHORT else 0
    while True:
        if cost[state] == DELETE + after[state]:
            return before, "D", "", state, spent + DELETE
        if cost[state] == INSERT + cost[NEXT[state]]:
            before, state, spent = before + WRITES[state], NEXT[state], spent + INSERT
        elif (state, initial) in KEEP and cost[state] == extra + after[KEEP[state, initial]]:
            return before, "K", "", KEEP[state, initial], spent + extra
        else:
            return before, "R", WRITES[state], NEXT[state], spent + extra + REROLE


def vectors(codes: list[int], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The cost-to-go after each row of a chunk, and before its first, which comes last."""
    out = [end]
    for code in reversed(codes):
        out.append(step(out[-1], code))
    return out


def fix_up(codes: list[int], new: tuple[int, ...], old: tuple[int, ...]) -> tuple[int, ...] | None:
    """The vector before a chunk for a new one after it; None where it meets that of the old one on the way."""
    for code in reversed(codes):
        if new == old:
            return None
        new, old = step(new, code), step(old, code)
    return None if new == old else new


def trace(codes: list[int], after: list[tuple[int, ...]], state: int) -> tuple[list[tuple[str, str, str, int, int]], int]:
    """The edits of a chunk from an entry state, and the state it leaves."""
    out, last = [], len(codes) - 1
    for i, code in enumerate(codes):
        out.append(choose(after[last - i], code, state))
        state = out[-1][3]
    return out, state


def chunk_rows(rows: DataFrame, size: int, home: str) -> DataFrame:
    """(conv_id, part, seg, k, source, next_head, codes): chunks of at most ``size`` rows, numbered within their
    conversation; ``codes`` has (at, code, times).  ``next_head`` is the first initial of the next chunk.  Rows
    that must go leave a vector as it is, so a chunk of them passes it on: ``source`` is the next chunk
    that has other rows, the one whose vector comes after this chunk; null if there is none."""
    made = rows.groupBy("conv_id", "part", F.floor(F.col("at") / size).cast("long").alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("at", "code", "times"))).alias("codes"))  # at most ``size`` of them
    made = cut(made.withColumn("head", F.element_at("codes", 1)["code"] % 4).withColumn(
        "live", F.exists("codes", lambda x: x["code"] < 4 * FORCED)), f"{home}/made")
    order = Window.partitionBy("conv_id").orderBy("part", "seg")
    # One short row for ``size`` rows of a conversation.
    place = made.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seg").alias("s"), "live",
                        (F.row_number().over(order) - 1).alias("k"), F.lead("head").over(order).alias("next_head"))
    back = Window.partitionBy("c").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    place = place.withColumn("source", F.last(F.when(F.col("live"), F.col("k")), ignorenulls=True).over(back))
    met = made.join(place, made["conv_id"].eqNullSafe(place["c"]) & (made["part"] == place["p"]) & (made["seg"] == place["s"]))
    return cut(met.select("conv_id", "part", "seg", "k", "source", "next_head", "codes"), f"{home}/chunks")


def _codes(b: pa.RecordBatch) -> list[list[int]]:
    return [[x["code"] for x in row] for row in b.column("codes").to_pylist()]


VECTOR = pa.list_(pa.int32())


def end_vectors(chunks: DataFrame, home: str) -> DataFrame:
    """(conv_id, k, source, given, start) of the chunks of conversations with more than one: the vectors after
    and before them, right up to a constant."""
    many = chunks.where("next_head is not null or k > 0")

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [END if k is None else SPECULATIVE for k in b.column("source").to_pylist()]
            start = [vectors(c, g)[-1] for c, g in zip(_codes(b), given)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "k", "source")), pa.array(given, VECTOR),
                                              pa.array(start, VECTOR)], names=["conv_id", "k", "source", "given", "start"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, old, start = ([tuple(x) for x in b.column(c).to_pylist()] for c in ("new", "given", "start"))
            start = [fix_up(c, n, o) or s for c, n, o, s in zip(_codes(b), new, old, start)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("k"), pa.array(new, VECTOR), pa.array(start, VECTOR)],
                                             names=["conv_id", "k", "given", "start"])
    schema = "conv_id long, k int, given array<int>, start array<int>"
    state = cut(many.select("conv_id", "k", "source", "codes").mapInArrow(
        speculate, "conv_id long, k int, source int, given array<int>, start array<int>"), f"{home}/pass0")
    turn = 0
    while True:
        turn += 1
        found = state.select(F.col("conv_id").alias("c"), F.col("k").alias("j"), F.col("start").alias("new"))
        moved = state.join(found, state["conv_id"].eqNullSafe(found["c"]) & (state["source"] == found["j"])).where("new != given")
        moved = cut(moved.select("conv_id", "k", "given", "start", "new"), f"{home}/moved{turn}")
        if moved.isEmpty():
            return state
        rerun = many.select("conv_id", "k", "codes")
        rerun = moved.join(rerun, _same(moved, rerun, "conv_id", "k")).select(
            moved["conv_id"], moved["k"], "given", "start", "new", "codes").mapInArrow(again, schema)
        rerun = cut(rerun, f"{home}/rerun{turn}").toDF("c", "j", "g", "s")
        state = cut(state.join(rerun, state["conv_id"].eqNullSafe(rerun["c"]) & (state["k"] == rerun["j"]), "left").select(
            "conv_id", "k", "source", F.coalesce("g", "given").alias("given"), F.coalesce("s", "start").alias("start")), f"{home}/pass{turn}")


def entry_states(chunks: DataFrame, home: str) -> DataFrame:
    """(conv_id, k, state) of the chunks of (conv_id, k, codes, given): the state that the edits of all chunks
    before leave.  Maps of states are composed over 2, 4, 8 ... chunks."""
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for codes, given in zip(_codes(b), b.column("given").to_pylist()):
                after = vectors(codes, tuple(given))
                out.append([trace(codes, after, s)[1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("k"), pa.array(out, VECTOR)],
                                             names=["conv_id", "k", "f"])
    reach = cut(chunks.mapInArrow(maps, "conv_id long, k int, f array<int>"), f"{home}/maps")
    longest = reach.agg(F.max("k")).first()[0] or 0
    d = 1
    while d <= longest:
        back = reach.select(F.col("conv_id").alias("c"), (F.col("k") + d).alias("j"), F.col("f").alias("g"))
        both = F.transform("g", lambda s: F.element_at("f", s + 1))
        reach = cut(reach.join(back, reach["conv_id"].eqNullSafe(back["c"]) & (reach["k"] == back["j"]), "left").select(
            "conv_id", "k", F.coalesce(both, "f").alias("f")), f"{home}/reach{d}")
        d *= 2
    return reach.select("conv_id", (F.col("k") + 1).alias("k"), F.element_at("f", 1).alias("state"))


def repair(rows: DataFrame, size: int = 4096) -> DataFrame:
    """(conv_id, part, at, turn, role, text, times, fault, before, edit, to, tail, cost, illegal) of
    (conv_id, turn, role, text, times): every row with its cheapest edits.

    Rows of a conversation run by (part, at).  ``times`` equal rows are one: the edit is
    the first one's, the others are deleted.  ``before`` and ``tail`` have the initials of
    the turns inserted before it and after the conversation's last row, ``edit`` is D, K
    or R, ``to`` the initial of a reroled row, ``cost`` that of all these.  ``fault`` is the
    row's first: blank (no text but white space), duplicate (its role and text stand at an
    earlier turn; all but the first of equal rows are duplicates as well), truncated (its
    last character but white space is none of ``.!?``) or none.  ``illegal`` counts the row's
    followers, copies included, with which its role initial forms none of su, ua, au.

    A null conv_id is a conversation; null turns come first; role and text must not be
    null.  An empty table gives no rows; extra columns are not read.
    """
    home = shared_dir(rows.sparkSession)
    lines = ordered_rows(rows, home)
    chunks = chunk_rows(lines, size, home)
    ends = end_vectors(chunks, home).select(F.col("conv_id").alias("c"), F.col("k").alias("j"), "given")
    stitched = chunks.join(ends, chunks["conv_id"].eqNullSafe(ends["c"]) & (chunks["k"] == ends["j"]), "left")
    entries = entry_states(stitched.where("given is not null").select("conv_id", "k", "codes", "given"), home)
    entries = entries.select(F.col("conv_id").alias("e"), F.col("k").alias("i"), "state")
    ready = stitched.join(entries, stitched["conv_id"].eqNullSafe(entries["e"]) & (stitched["k"] == entries["i"]), "left").select(
        "part", "codes", "next_head", F.coalesce("given", F.array(*[F.lit(x) for x in END])).alias("given"),
        F.coalesce("state", F.lit(0)).alias("state"))
    legal = {(0, 1), (1, 2), (2, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for part, row, head, given, state in zip(*(b.column(c).to_pylist() for c in (
                    "part", "codes", "next_head", "given", "state"))):
                codes = [x["code"] for x in row]
                edits, state = trace(codes, vectors(codes, tuple(given)), state)
                tail = ""
                while head is None and END[state]:
                    tail, state = tail + WRITES[state], NEXT[state]
                follows = [c % 4 for c in codes[1:]] + ([] if head is None else [head])
                for i, (x, (before, edit, to, _, cost)) in enumerate(zip(row, edits)):
                    own, last = tail if i == len(row) - 1 else "", x["code"] % 4
                    bad = x["times"] - 1 + (i < len(follows) and (last, follows[i]) not in legal)
                    out.append((part, x["at"], before, edit, to, own, cost + DELETE * (x["times"] - 1) + INSERT * len(own), bad))
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["part", "at", "before", "edit", "to", "tail", "cost", "illegal"])
    edits = ready.mapInArrow(run, "part long, at long, before string, edit string, to string, tail string, cost long, illegal long")
    return lines.drop("code").join(edits, ["part", "at"]).select(
        "conv_id", "part", "at", "turn", "role", "text", "times", "fault", "before", "edit", "to", "tail", "cost", "illegal")


ROLE = {"u": "user", "a": "assistant"}


def spelled(rows: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of ``repair()``'s rows: the edits' initials, and the digest of the
    repaired ``role:text`` lines.  A digest needs the lines in order, so a conversation's rows are streamed
    through one task, a batch at a time; what is kept is its audit, a letter a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        at: tuple[int | None] | None = None
        audit, digest, empty = [], hashlib.sha256(), True

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array(["".join(audit)], pa.string()),
                                               pa.array([digest.hexdigest()], pa.string())],
                                              names=["conv_id", "audit", "repaired_sha256"])
        for b in batches:
            for conv, role, text, times, before, edit, to, tail in zip(*(b.column(c).to_pylist() for c in (
                    "conv_id", "role", "text", "times", "before", "edit", "to", "tail"))):
                if at != (conv,):
                    if at:
                        yield out()
                    at, audit, digest, empty = (conv,), [], hashlib.sha256(), True
                audit.append("I" * len(before) + edit + "D" * (times - 1) + "I" * len(tail))
                lines = [f"{ROLE[x]}:" for x in before]
                if edit != "D":
                    lines.append(f"{ROLE[to] if edit == 'R' else role}:{text}")
                for line in lines + [f"{ROLE[x]}:" for x in tail]:
                    digest.update(("" if empty else "\n").encode() + line.encode("utf-8", "surrogatepass"))
                    empty = False
        if at:
            yield out()
    dealt = rows.select("conv_id", "part", "at", "role", "text", "times", "before", "edit", "to", "tail").repartition(
        shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "at")
    return dealt.mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def audit(conversations: DataFrame, size: int = 4096) -> DataFrame:
    """One row per conv_id of the damaged and repaired conversations: gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256; zeros, an empty audit and the digest of nothing where no row is left."""
    done = cut(repair(damage(conversations), size), f"{shared_dir(conversations.sparkSession)}/repaired")
    times = F.col("times")
    duplicates = F.when(F.col("fault") == "duplicate", times).when(F.col("fault") != "blank", times - 1).otherwise(0)
    counts = done.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("fault") == "blank", times).otherwise(0)).alias("blank"), F.sum(duplicates).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated"), F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    words = spelled(done)
    counts, words = counts.withColumnRenamed("conv_id", "c"), words.withColumnRenamed("conv_id", "w")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(counts, ids["conv_id"].eqNullSafe(counts["c"]), "left").join(
        words, ids["conv_id"].eqNullSafe(words["w"]), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
