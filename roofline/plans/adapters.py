"""Test-data adapters: the driver's tables seen as the model's tables.

Every adapter is a plain DataFrame plan over the parquet tables, so it scales with
them: joins are equi-joins on keys, small dimensions (nation, supplier) are the
build sides and the fact table (lineitem, events) is only scanned once.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stable_id

# Total fetch order of a listing row in the L adapter: search, then a unique
# lineitem key ((l_orderkey, l_linenumber) alone is not unique).
LISTING_ORDER = ["search_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                 "l_shipdate", "l_quantity"]
LINE_KEY = LISTING_ORDER[1:]
N_SEARCHES = 25
SEEN_CUTOFF = "1996-01-01"

# Fixed values of the S adapter: raw text cells chosen by n_nationkey % len(list).
SEARCH_CELLS = {
    "enabled": [None, "true", "yes", "1", "false"],
    "source_type": [None, " Kleinanzeigen ", "rss"],
    "search_type": ["Wohnung-Mieten", "", None, "haus-kaufen "],
    "radius_km": [None, "10", "25,7", "0"],
    "min_rent": [None, "5", "", "10,5", None, "2.000"],
    "max_rent": ["60", "45,5", "", None, "1.250,00"],
    "min_rooms": [None, "1", "", "2,5"],
    "max_rooms": ["3", None, ""],
    "min_sqm": [None, "10", "", "5 m²", None],
    "max_sqm": ["40", None, "45", ""],
    "required_keywords": [None, "red", "", "Brand#1", None, "ring, Small"],
    "excluded_keywords": [None, "economy", "blue, GREEN", "", None],
}
# Global default criteria used for inheritance.
DEFAULT_CRITERIA = {"min_rent": None, "max_rent": 80.0, "min_rooms": None, "max_rooms": None,
                    "min_sqm": 2.0, "max_sqm": None, "required_keywords": [],
                    "excluded_keywords": ["promo"]}
PORTAL_PATH = "https://www.kleinanzeigen.de/s-wohnung-mieten/"


_READERS: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


class Tables:
    """Lazy parquet readers for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._memo: dict = {}

    def memo(self, key: str, build):
        """Build a sub-plan once per query (DataFrames are immutable plans)."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # One reader per table and session: schema inference is a Spark job, and a
        # query reads some tables several times.
        key = (self.sf_dir, name)
        cache = _READERS.setdefault(self.spark, {})
        if key not in cache:
            cache[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return cache[key]


def _pick(values, n):
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (n % len(values) + 1).cast("int"))


# --------------------------------------------------------------------------- L
def listings(t: Tables) -> DataFrame:
    return t.memo("listings", lambda: _listings(t))


def _listings(t: Tables) -> DataFrame:
    """L: one listing row per lineitem, carrying its fetch order."""
    li = t.lineitem
    # Each dimension joins the fact table on its own, so the planner sizes each build
    # side from its own table statistics (broadcast while small, shuffle beyond);
    # joining supplier to nation first would size the pair as a product.
    part = t.part.select("p_partkey", "p_name", "p_type", "p_brand")
    supplier = t.supplier.select("s_suppkey", "s_nationkey")
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    j = (li.join(part, li.l_partkey == part.p_partkey)
         .join(supplier, li.l_suppkey == supplier.s_suppkey)
         .join(nation, "s_nationkey"))
    source = F.when(F.col("l_partkey") % 10 == 0, "feed").otherwise("board")
    native = F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    url = F.concat(F.lit("https://listings.example/"), source, F.lit("/"), native)
    return j.select(
        stable_id(source, native, url).alias("listing_id"),
        source.alias("source"),
        F.col("p_name").alias("title"),
        url.alias("url"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 1000).alias("price"),
        F.when(F.col("l_linenumber") != 1, F.col("l_linenumber") / 2.0).alias("rooms"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("sqm"),
        F.when(F.col("l_linestatus") == "O",
               F.concat((F.col("s_nationkey") + 10000).cast("string"), F.lit(" "), F.col("n_name")))
        .otherwise(F.col("n_name")).alias("location"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"),
        F.when(F.col("l_linenumber") % 3 != 0,
               F.concat(F.lit("https://img.example/"), F.col("l_partkey").cast("string"), F.lit(".jpg")))
        .alias("thumbnail"),
        F.when(F.col("l_linenumber") % 2 == 0, F.array("p_brand", F.initcap("p_type")))
        .otherwise(F.array().cast("array<string>")).alias("features"),
        (F.col("l_suppkey") % N_SEARCHES).alias("search_id"),
        *[F.col(c) for c in LINE_KEY],
        F.col("l_returnflag"), F.col("l_shipdate").alias("_shipdate"),
    )


def seen_stores(t: Tables):
    return t.memo("seen_stores", lambda: _seen_stores(t))


def _seen_stores(t: Tables):
    """Two seen stores: ids shipped before 1996 with return flag R, and with A."""
    base = listings(t).filter(F.col("_shipdate") < F.lit(SEEN_CUTOFF).cast("timestamp_ntz"))
    cols = [F.col("listing_id").alias("key"), "title", "url", "source"]
    one = base.filter(F.col("l_returnflag") == "R").select(*cols).dropDuplicates(["key"])
    two = base.filter(F.col("l_returnflag") == "A").select(*cols).dropDuplicates(["key"])
    return one, two


def detail_rows(t: Tables) -> DataFrame:
    return t.memo("detail_rows", lambda: _detail_rows(t))


def _detail_rows(t: Tables) -> DataFrame:
    li = t.lineitem.filter(F.col("l_linenumber") >= 4)
    part = t.part.select("p_partkey", "p_type", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    source = F.when(F.col("l_partkey") % 10 == 0, "feed").otherwise("board")
    lid = F.concat(source, F.lit(":"), F.col("l_partkey").cast("string"), F.lit("-"),
                   F.col("l_linenumber").cast("string"))
    # Pick the winning lineitem on raw columns; derive the fields once per listing.
    raw = F.struct("l_extendedprice", "l_linenumber", "l_quantity", "l_tax", "l_shipdate", "l_orderkey",
                   "p_type", "p_brand")
    order = F.struct(*[F.col(c) for c in LINE_KEY])
    w = j.groupBy(lid.alias("listing_id")).agg(F.min_by(raw, order).alias("d")).select("listing_id", "d.*")
    ln = F.col("l_linenumber")
    return w.select(
        "listing_id",
        (F.col("l_extendedprice") / 1000 + 1).alias("price"),
        (ln / 2.0 + 0.5).alias("rooms"),
        (F.col("l_quantity") + 1).alias("sqm"),
        F.when(ln % 2 == 0, F.concat_ws(" ", F.lit("detail"), "p_type", "p_brand")).otherwise(F.lit(""))
        .alias("description"),
        F.when(ln != 5, ln - 2.0).alias("bedrooms"),
        F.lit(1.0).alias("bathrooms"),
        ln.cast("string").alias("floor"),
        F.initcap("p_type").alias("apartment_type"),
        F.when(ln == 6, F.lit(None).cast("string")).otherwise(F.date_format("l_shipdate", "MMMM yyyy"))
        .alias("available_from"),
        (F.col("l_tax") * 1000).alias("additional_costs"),
        (F.col("l_extendedprice") / 1000 + F.col("l_tax") * 1000).alias("warm_rent"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit(" €")).alias("deposit"),
        F.when(ln % 3 == 0, F.array(F.lit("Balkon"), F.col("p_brand")))
        .otherwise(F.array().cast("array<string>")).alias("features"))


# --------------------------------------------------------------------------- S
def searches_raw(t: Tables) -> DataFrame:
    return t.memo("searches_raw", lambda: _searches_raw(t))


def _searches_raw(t: Tables) -> DataFrame:
    """S: one raw search row per nation; every cell is text or null."""
    n = F.col("n_nationkey")
    name = F.lower(F.col("n_name"))
    code = F.concat(F.lit("c203l"), (n + 3000).cast("string"))
    url = (F.when(n == 23, F.lit("  "))
           .when(n % 3 == 2, F.concat(F.lit("https://feeds.example/"), name, F.lit(".xml")))
           .when(n % 3 == 0, F.concat(F.lit(PORTAL_PATH), name, F.lit("/"), code))
           .otherwise(F.concat(F.lit(PORTAL_PATH), name, F.lit("/seite:2/"), code, F.lit("r25"))))
    cells = {k: _pick(v, n).alias(k) for k, v in SEARCH_CELLS.items()}
    label = F.when(n % 7 != 0, F.concat(F.lit(" "), F.col("n_name"), F.lit(" "))).alias("label")
    return t.nation.select(
        n.cast("bigint").alias("search_id"), cells["enabled"], label, cells["source_type"],
        cells["search_type"], url.alias("url"), cells["radius_km"],
        *[cells[k] for k in ("min_rent", "max_rent", "min_rooms", "max_rooms", "min_sqm",
                             "max_sqm", "required_keywords", "excluded_keywords")])


SEARCHES_PER_LIST = 20


def supplier_tables(t: Tables) -> Tables:
    """The same tables with one search per supplier, so that the searches grow with the data:
    the suppliers take the place of the nations in S (lists of 20 that of the regions), and
    every listing refers to its supplier's search."""
    g = Tables(t.spark, t.sf_dir)
    k = F.col("s_suppkey")
    g.nation = t.supplier.select(
        k.alias("n_nationkey"), F.concat(F.lit("supplier-"), k.cast("string")).alias("n_name"),
        F.floor(k / SEARCHES_PER_LIST).alias("n_regionkey"))
    g.memo("listings", lambda: listings(t).withColumn("search_id", F.col("l_suppkey")))
    return g


# --------------------------------------------------------------------------- R
def run_events(t: Tables) -> DataFrame:
    return t.memo("run_events", lambda: _run_events(t))


def _run_events(t: Tables) -> DataFrame:
    """R: the events table as run events of cycles (one run per user and day)."""
    e = t.events
    k = F.get_json_object("props", "$.k").cast("bigint")
    et = F.col("event_type")
    e = e.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    kk = F.col("k")
    crash, sent = (et == "error") & (kk % 25 == 3), et == "purchase"
    phase = (F.when(crash, "run_error").when(et.isin("error", "signup", "view"), "fetch_source")
             .when(et == "click", "dedup").otherwise("notify_item"))
    level = (F.when((et == "error") | (sent & (kk % 7 == 2)), "error")
             .when((et == "signup") | (sent & (kk % 7 == 1)), "warning").otherwise("info"))
    ks = kk.cast("string")
    message = (F.when(crash, F.concat(F.lit("in run_cycle: "), ks))
               .when(et == "error", F.concat(F.lit("failed: "), ks))
               .when((et == "signup") & (kk % 2 == 0), F.concat(F.lit("403_blocked: "), ks))
               .when(et == "signup", F.concat(F.lit("enrich failed: "), ks))
               .when(et == "view", F.concat(F.lit("ok: "), ks))
               .when(et == "click", F.concat(ks, F.lit(" new")))
               .when(kk % 7 == 0, F.lit("summary(3)")).when(kk % 7 == 1, F.lit("undelivered"))
               .when(kk % 7 == 2, F.lit("gave up")).otherwise(F.lit("delivered")))
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        phase.alias("phase"), level.alias("level"), message.alias("message"),
        F.concat(F.lit("src"), (F.col("k") % 4).cast("string")).alias("source"),
        F.when(et.isin("view", "click"), F.col("k")).alias("count"),
        F.col("ts").alias("at"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_id").alias("event_no"),
        F.col("user_id").cast("string").alias("host"),
    )


# --------------------------------------------------------------------------- V
# HTTP status by k % 10 (None = timeout) and channel by event type.
STATUS_BY_K = [200, 429, 429, 503, 500, 403, 400, 404, 410, None]
CHANNEL_BY_TYPE = {"view": "telegram", "error": "telegram", "click": "email",
                   "signup": "email", "purchase": "ha"}


def delivery_attempts(t: Tables) -> DataFrame:
    return t.memo("delivery_attempts", lambda: _delivery_attempts(t))


def _delivery_attempts(t: Tables) -> DataFrame:
    """V: one send attempt per event: listing = user, cycle = day, attempt = row
    number within (listing, cycle) by (ts, event_id)."""
    e = t.events
    k = F.get_json_object("props", "$.k").cast("bigint")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_BY_K]), (k % 10 + 1).cast("int"))
    chan = F.lit(None).cast("string")
    for et, ch in CHANNEL_BY_TYPE.items():
        chan = F.when(F.col("event_type") == et, F.lit(ch)).otherwise(chan)
    w = Window.partitionBy("listing_id", "cycle").orderBy("at", "event_id")
    base = e.select(
        F.col("user_id").cast("string").alias("listing_id"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint").alias("cycle"),
        F.col("ts").alias("at"), F.col("event_id"),
        chan.alias("channel"), status.alias("status"),
        F.when(k % 2 == 0, F.floor("value")).alias("retry_after"),
    )
    return base.withColumn("attempt", F.row_number().over(w))


# --------------------------------------------------------------------------- A
# Fixed values of the A adapter.
RESULT_STATUS_BY_SIZE = [None, "", "new", "interested"]
AVAILABLE_BY_SIZE = [True, False, None]
REMOVED_BODY = "Diese Anzeige ist nicht mehr verfügbar."
ALIVE_BODY = "Schöne Wohnung, Anzeige aktiv"


def results_table(t: Tables) -> DataFrame:
    return t.memo("results_table", lambda: _results_table(t))


def _results_table(t: Tables) -> DataFrame:
    """A: one results row per part."""
    p = t.part
    k = F.col("p_partkey")
    source = F.when(k % 10 == 0, "rss").otherwise("kleinanzeigen")
    status = F.element_at(F.array(*[F.lit(v).cast("string") for v in RESULT_STATUS_BY_SIZE]),
                          (F.col("p_size") % 4 + 1).cast("int"))
    avail = F.element_at(F.array(*[F.lit(v).cast("boolean") for v in AVAILABLE_BY_SIZE]),
                         (F.col("p_size") % 3 + 1).cast("int"))
    checked = F.when(k % 5 != 0, F.lit("2024-01-01").cast("timestamp_ntz")
                     + F.make_interval(days=(k % 7).cast("int")))
    return p.select(
        F.concat(source, F.lit(":"), k.cast("string")).alias("listing_id"),
        F.col("p_name").alias("title"),
        F.when(k % 13 != 0, F.concat(F.lit("https://www.kleinanzeigen.de/s-anzeige/"), k.cast("string"))).alias("url"),
        source.alias("source"),
        F.when(F.col("p_size") % 2 == 0, F.lit("wohnung-mieten")).alias("search_type"),
        status.alias("status"),
        F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("sqm"),
        avail.alias("available"), checked.alias("last_checked"),
        F.lit(None).cast("timestamp_ntz").alias("removed_at"))


def recheck_fetches(t: Tables) -> DataFrame:
    return t.memo("recheck_fetches", lambda: _recheck_fetches(t))


def _recheck_fetches(t: Tables) -> DataFrame:
    """A: the latest lineitem of each part stands in for its recheck fetch."""
    li = t.lineitem
    k = F.col("l_partkey")
    source = F.when(k % 10 == 0, "rss").otherwise("kleinanzeigen")
    code = (F.when(F.col("l_linenumber") == 1, 404).when(F.col("l_linenumber") == 2, 410)
            .when(F.col("l_linenumber") == 3, 403).when(F.col("l_linenumber") == 4, 500).otherwise(200))
    body = F.when(F.col("l_returnflag") == "R", F.lit(REMOVED_BODY)).otherwise(F.lit(ALIVE_BODY))
    order = F.struct("l_shipdate", *LINE_KEY)
    latest = li.groupBy(F.concat(source, F.lit(":"), k.cast("string")).alias("listing_id")).agg(
        F.max_by(F.struct(code.alias("http_status"), body.alias("body")), order).alias("f"))
    return latest.select("listing_id", "f.http_status", "f.body")
