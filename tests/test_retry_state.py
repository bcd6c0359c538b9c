"""The keyed retry state (I4, B17) against a plain statement of its rule over all attempts at once."""
import random
import uuid
from datetime import datetime, timedelta

from roofline.session import ensure_checkpoint_dir
from roofline.streaming import retry_state as RS

START = datetime(2024, 5, 1)
SCHEMA = ("listing_id string, cycle bigint, cycle_end timestamp, attempt int, at timestamp, channel string, status int, "
          "retry_after string, end_us string, open int")
MARKER = "marker"


def attempt(listing, cycle, no, status, channel="email", retry_after=None, at=None):
    day = START + timedelta(days=cycle)
    return (listing, cycle, day + timedelta(days=1), no, at or day + timedelta(hours=3, minutes=no or 0), channel, status, retry_after, "x", 1)


def run(spark, landings, delay, **options):
    """Every landing as a batch; rows of the sink and the rows of state left behind."""
    base = f"{ensure_checkpoint_dir(spark)}/test-retry-{uuid.uuid4().hex}"
    for rows in landings:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = RS.start_retry_state(s, f"{base}/out", f"{base}/ckpt", delay=delay, **options)
    q.awaitTermination()
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else 0
    out = [tuple(r) for r in spark.read.parquet(f"{base}/out").select(
        "kind", "listing_id", "cycle", "n", "any_sent", "settled", "gave_up", "attempts", "delay_s", "next_attempt_at").collect()]
    assert len(out) == len(set(out))
    return set(out), state


def rule(rows, mark, limit, keep):
    """Cycles of each listing in order up to the settled one, anew with the first that ends more than ``keep`` after
    it, and the retries due at ``mark``."""
    by, out = {}, set()
    for r in rows:
        if None not in (r[0], r[1], r[2], r[3]):
            by.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    for listing, cycles in by.items():
        n, settled = 0, None
        for cycle in sorted(cycles):
            got = cycles[cycle]
            if got[0][2] > mark:
                break
            if settled is not None and got[0][2] <= settled + keep:
                continue
            n, settled = (n + 1, None) if settled is None else (1, None)
            sent = any(r[5] in ("telegram", "email", "ha") and r[6] is not None and r[6] < 400 for r in got)
            done = sent or n >= limit
            out.add(("attempt", listing, cycle, n, sent, done, n >= limit and not sent, None, None, None))
            last = max(got, key=lambda r: r[3])
            if (last[6] is None or last[6] in (429, 500, 502, 503, 504)) and last[4] is not None:
                wait = max(0.0, float(last[7])) if last[7] not in (None, "soon") else 2.0 ** last[3]
                if wait <= 1e12 and last[4] + timedelta(seconds=wait) <= mark:
                    out.add(("retry", listing, cycle, n, None, None, None, last[3], wait, last[4] + timedelta(seconds=wait)))
            if done:
                settled = got[0][2]
    return out


def test_shuffled_landings_equal_the_rule_and_leave_only_open_listings(spark):
    rnd, rows = random.Random(5), []
    for listing in ["hot", *map(str, range(25))]:
        for cycle in rnd.sample(range(12), rnd.randint(1, 8)):
            for no in range(1, 400 if listing == "hot" else rnd.randint(2, 4)):
                rows.append(attempt(listing, cycle, no, rnd.choice([None, 404, 429, 500, 503, 503, 503] if listing == "hot" else [200, None, 404, 429, 500, 503]),
                                    rnd.choice(["telegram", "email", "ha", "pigeon", None]), rnd.choice([None, "7", "-3", "soon", "90000", "400000"])))
    rows += rows[:50]  # handed over twice
    nulls = [(None, *rows[0][1:]), ("n", None, *rows[0][2:]), ("n", 1, None, *rows[0][3:]),
             attempt("n", 3, None, 200), attempt("no time", 4, 1, 503)]
    nulls[-1] = (*nulls[-1][:4], None, *nulls[-1][5:])
    rnd.shuffle(rows)
    rows = nulls + rows
    third = len(rows) // 3
    landings = [rows[:third], rows[third:2 * third], rows[2 * third:], [attempt(MARKER, 40, 1, 200)]]
    got, state = run(spark, landings, "15 days 12 hours", settled_for_s=86400)
    mark = START + timedelta(days=41) - timedelta(days=15, hours=12)
    want = rule(rows, mark, 5, timedelta(days=1))
    assert got == want and {r[0] for r in want} == {"attempt", "retry"} and any(r[6] for r in want)
    # Left: counters of listings whose last row is not settled, their retries not yet due, and the marker; the mark of
    # a listing is gone a day after it settled, a month before the watermark stands.
    last = {r[1]: r[5] for r in sorted((r for r in want if r[0] == "attempt"), key=lambda r: r[2])}
    open_listings = sum(not done for done in last.values())
    assert 0 < open_listings < len(last) and state <= 4 * (open_listings + 1), (state, open_listings)


def test_an_ended_cycle_takes_no_more_and_a_mark_is_forgotten(spark):
    landings = [[attempt("a", 0, 1, 503, retry_after="5"), attempt("s", 0, 1, 200)], [attempt(MARKER, 3, 1, 404, "pigeon")],
                [attempt("a", 0, 2, 200), attempt("a", 4, 1, 200), attempt("s", 4, 1, 404)],  # the first is too late
                [attempt(MARKER, 9, 1, 404, "pigeon")], [attempt("s", 10, 1, 200)], [attempt(MARKER, 14, 1, 404)]]
    got, _ = run(spark, landings, "1 hour", settled_for_s=5 * 86400)
    seen = sorted(r[1:7] for r in got if r[0] == "attempt" and r[1] != MARKER)
    assert seen == [("a", 0, 1, False, False, False), ("a", 4, 2, True, True, False),
                    ("s", 0, 1, True, True, False),  # cycle 4 lies within its five days, cycle 10 starts anew
                    ("s", 10, 1, True, True, False)]
    assert [r[1:4] + r[7:] for r in got if r[0] == "retry" and r[1] == "a"] == [("a", 0, 1, 1, 5.0, START + timedelta(hours=3, minutes=1, seconds=5))]


def test_nothing_landed_and_settings_are_given_back(spark):
    before = {k: spark.conf.get(k, None) for k in RS.STATE_CONF}
    assert run(spark, [[]], "1 hour")[0] == set()
    assert {k: spark.conf.get(k, None) for k in RS.STATE_CONF} == before
