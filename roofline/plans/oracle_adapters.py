"""The §5.3 adapters as DuckDB SQL CTEs, for the oracle queries.

Written independently of the Spark adapters; only the fixed value lists are shared.
``with_ctes("listings", "searches")`` returns a ``WITH`` prefix holding the named
CTEs and everything they depend on, in dependency order.
"""

from __future__ import annotations

from .adapters import (DEFAULT_CRITERIA, N_SEARCHES, PORTAL_PATH, SEARCH_CELLS, SEARCHES_PER_LIST, SEEN_CUTOFF,
                       STATUS_BY_K)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return repr(float(v)) + "::DOUBLE" if isinstance(v, float) else str(v)
    return "'" + str(v).replace("'", "''") + "'"


def _pick(values, expr: str) -> str:
    return "([" + ", ".join(_lit(v) for v in values) + "]::VARCHAR[])" + f"[({expr}) % {len(values)} + 1]"


def _kw_list(values) -> str:
    if not values:
        return "[]::VARCHAR[]"
    return "[" + ", ".join(_lit(v) for v in values) + "]"


_SOURCE = "CASE WHEN l.l_partkey % 10 = 0 THEN 'feed' ELSE 'board' END"
_NATIVE = "CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR)"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}

CTES["listings"] = ((), f"""
SELECT {_SOURCE} || ':' || {_NATIVE} AS listing_id,
       {_SOURCE} AS source,
       p.p_name AS title,
       'https://listings.example/' || {_SOURCE} || '/' || {_NATIVE} AS url,
       CASE WHEN l.l_linenumber <> 7 THEN l.l_extendedprice / 1000 END AS price,
       CASE WHEN l.l_linenumber <> 1 THEN l.l_linenumber / 2.0::DOUBLE END AS rooms,
       CASE WHEN l.l_discount <> 0 THEN l.l_quantity END AS sqm,
       CASE WHEN l.l_linestatus = 'O' THEN CAST(s.s_nationkey + 10000 AS VARCHAR) || ' ' || n.n_name
            ELSE n.n_name END AS location,
       p.p_type || ' ' || p.p_brand AS description,
       CASE WHEN l.l_linenumber % 3 <> 0 THEN 'https://img.example/' || CAST(l.l_partkey AS VARCHAR) || '.jpg' END AS thumbnail,
       CASE WHEN l.l_linenumber % 2 = 0
            THEN [p.p_brand, upper(substr(p.p_type, 1, 1)) || lower(substr(p.p_type, 2))]
            ELSE []::VARCHAR[] END AS features,
       l.l_suppkey % {N_SEARCHES} AS search_id,
       l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity,
       l.l_returnflag
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey""")

CTES["seen1"] = (("listings",), f"""
SELECT DISTINCT listing_id AS key FROM listings
WHERE l_shipdate < TIMESTAMP '{SEEN_CUTOFF}' AND l_returnflag = 'R'""")

CTES["seen2"] = (("listings",), f"""
SELECT DISTINCT listing_id AS key FROM listings
WHERE l_shipdate < TIMESTAMP '{SEEN_CUTOFF}' AND l_returnflag = 'A'""")

CTES["seen_all"] = (("seen1", "seen2"), "SELECT key FROM seen1 UNION SELECT key FROM seen2")

CTES["details"] = ((), f"""
SELECT listing_id,
       arg_min_null(l_extendedprice / 1000 + 1, okey) AS price,
       arg_min_null(l_linenumber / 2.0::DOUBLE + 0.5, okey) AS rooms,
       arg_min_null(l_quantity + 1, okey) AS sqm,
       arg_min_null(CASE WHEN l_linenumber % 2 = 0 THEN 'detail ' || p_type || ' ' || p_brand ELSE '' END, okey) AS description,
       arg_min_null(CASE WHEN l_linenumber <> 5 THEN l_linenumber - 2.0::DOUBLE END, okey) AS bedrooms,
       arg_min_null(1.0::DOUBLE, okey) AS bathrooms,
       arg_min_null(CAST(l_linenumber AS VARCHAR), okey) AS floor,
       arg_min_null(upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)), okey) AS apartment_type,
       arg_min_null(CASE WHEN l_linenumber <> 6 THEN strftime(l_shipdate, '%B %Y') END, okey) AS available_from,
       arg_min_null(l_tax * 1000, okey) AS additional_costs,
       arg_min_null(l_extendedprice / 1000 + l_tax * 1000, okey) AS warm_rent,
       arg_min_null(CAST(l_orderkey AS VARCHAR) || ' €', okey) AS deposit,
       arg_min_null(CASE WHEN l_linenumber % 3 = 0 THEN ['Balkon', p_brand] ELSE []::VARCHAR[] END, okey) AS features
FROM (SELECT {_SOURCE} || ':' || {_NATIVE} AS listing_id, l.*, p.p_type, p.p_brand,
             (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity) AS okey
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
      WHERE l.l_linenumber >= 4) x
GROUP BY listing_id""")

_N = "n_nationkey"
CTES["searches_raw"] = ((), f"""
SELECT CAST(n_nationkey AS BIGINT) AS search_id,
       {_pick(SEARCH_CELLS['enabled'], _N)} AS enabled,
       CASE WHEN n_nationkey % 7 <> 0 THEN ' ' || n_name || ' ' END AS label,
       {_pick(SEARCH_CELLS['source_type'], _N)} AS source_type,
       {_pick(SEARCH_CELLS['search_type'], _N)} AS search_type,
       CASE WHEN n_nationkey = 23 THEN '  '
            WHEN n_nationkey % 3 = 2 THEN 'https://feeds.example/' || lower(n_name) || '.xml'
            WHEN n_nationkey % 3 = 0 THEN '{PORTAL_PATH}' || lower(n_name) || '/c203l' || CAST(n_nationkey + 3000 AS VARCHAR)
            ELSE '{PORTAL_PATH}' || lower(n_name) || '/seite:2/c203l' || CAST(n_nationkey + 3000 AS VARCHAR) || 'r25'
       END AS url,
       {_pick(SEARCH_CELLS['radius_km'], _N)} AS radius_km,
       {_pick(SEARCH_CELLS['min_rent'], _N)} AS min_rent,
       {_pick(SEARCH_CELLS['max_rent'], _N)} AS max_rent,
       {_pick(SEARCH_CELLS['min_rooms'], _N)} AS min_rooms,
       {_pick(SEARCH_CELLS['max_rooms'], _N)} AS max_rooms,
       {_pick(SEARCH_CELLS['min_sqm'], _N)} AS min_sqm,
       {_pick(SEARCH_CELLS['max_sqm'], _N)} AS max_sqm,
       {_pick(SEARCH_CELLS['required_keywords'], _N)} AS required_keywords,
       {_pick(SEARCH_CELLS['excluded_keywords'], _N)} AS excluded_keywords
FROM nation""")


def german_number_sql(x: str) -> str:
    """B1 in DuckDB: first German number, thousands dots dropped, comma as point."""
    raw = f"regexp_extract({x}, '\\d{{1,3}}(?:\\.\\d{{3}})+(?:,\\d+)?|\\d+(?:,\\d+)?', 0)"
    return (f"CASE WHEN {raw} <> '' THEN TRY_CAST(replace(replace({raw}, '.', ''), ',', '.') AS DOUBLE) END")


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _cell_double(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL ELSE {german_number_sql(c)} END"


def _cell_keywords(c: str) -> str:
    items = f"list_filter(list_transform(string_split({c}, ','), lambda k: lower({strip_sql('k')})), lambda k: k <> '')"
    return f"CASE WHEN {c} IS NULL OR {c} = '' OR len({items}) = 0 THEN NULL ELSE {items} END"


_D = DEFAULT_CRITERIA
CTES["searches"] = (("searches_raw",), f"""
SELECT search_id,
       CASE WHEN enabled IS NULL OR enabled = '' THEN TRUE
            ELSE lower({strip_sql('enabled')}) IN ('1', 'true', 'yes', 'on', 'checked') END AS enabled,
       {strip_sql("coalesce(label, '')")} AS label,
       CASE WHEN lower(trim(source_type)) IN ('kleinanzeigen', 'rss') THEN lower(trim(source_type))
            WHEN contains(lower(url), 'kleinanzeigen') THEN 'kleinanzeigen' ELSE 'rss' END AS source_type,
       lower({strip_sql("coalesce(search_type, '')")}) AS search_type,
       {strip_sql('url')} AS url,
       {_cell_double('radius_km')} AS radius_km,
       coalesce({_cell_double('min_rent')}, {_lit(_D['min_rent'])}) AS min_rent,
       coalesce({_cell_double('max_rent')}, {_lit(_D['max_rent'])}) AS max_rent,
       coalesce({_cell_double('min_rooms')}, {_lit(_D['min_rooms'])}) AS min_rooms,
       coalesce({_cell_double('max_rooms')}, {_lit(_D['max_rooms'])}) AS max_rooms,
       coalesce({_cell_double('min_sqm')}, {_lit(_D['min_sqm'])}) AS min_sqm,
       coalesce({_cell_double('max_sqm')}, {_lit(_D['max_sqm'])}) AS max_sqm,
       coalesce({_cell_keywords('required_keywords')}, {_kw_list(_D['required_keywords'])}) AS required_keywords,
       coalesce({_cell_keywords('excluded_keywords')}, {_kw_list(_D['excluded_keywords'])}) AS excluded_keywords
FROM searches_raw
WHERE {strip_sql("coalesce(url, '')")} <> ''""")

CTES["run_events"] = ((), """
SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS run_id,
       CASE WHEN event_type = 'error' AND k % 25 = 3 THEN 'run_error'
            WHEN event_type IN ('error', 'signup', 'view') THEN 'fetch_source'
            WHEN event_type = 'click' THEN 'dedup' ELSE 'notify_item' END AS phase,
       CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND k % 7 = 2) THEN 'error'
            WHEN event_type = 'signup' OR (event_type = 'purchase' AND k % 7 = 1) THEN 'warning' ELSE 'info' END AS level,
       CASE WHEN event_type = 'error' AND k % 25 = 3 THEN 'in run_cycle: ' || CAST(k AS VARCHAR)
            WHEN event_type = 'error' THEN 'failed: ' || CAST(k AS VARCHAR)
            WHEN event_type = 'signup' AND k % 2 = 0 THEN '403_blocked: ' || CAST(k AS VARCHAR)
            WHEN event_type = 'signup' THEN 'enrich failed: ' || CAST(k AS VARCHAR)
            WHEN event_type = 'view' THEN 'ok: ' || CAST(k AS VARCHAR)
            WHEN event_type = 'click' THEN CAST(k AS VARCHAR) || ' new'
            WHEN k % 7 = 0 THEN 'summary(3)' WHEN k % 7 = 1 THEN 'undelivered' WHEN k % 7 = 2 THEN 'gave up'
            ELSE 'delivered' END AS message,
       'src' || CAST(k % 4 AS VARCHAR) AS source,
       CASE WHEN event_type IN ('view', 'click') THEN k END AS count,
       ts AS "at",
       CAST(event_id AS VARCHAR) AS event_id,
       event_id AS event_no,
       CAST(user_id AS VARCHAR) AS host
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e""")

_STATUS = "[" + ", ".join("NULL" if s is None else str(s) for s in STATUS_BY_K) + "]"
CTES["attempts"] = ((), f"""
SELECT listing_id, cycle, "at", event_id, channel, status, retry_after,
       row_number() OVER (PARTITION BY listing_id, cycle ORDER BY "at", event_id) AS attempt
FROM (SELECT CAST(user_id AS VARCHAR) AS listing_id,
             CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS cycle,
             ts AS "at", event_id,
             CASE WHEN event_type IN ('view', 'error') THEN 'telegram'
                  WHEN event_type IN ('click', 'signup') THEN 'email' ELSE 'ha' END AS channel,
             {_STATUS}[k % 10 + 1] AS status,
             CASE WHEN k % 2 = 0 THEN CAST(floor(value) AS BIGINT) END AS retry_after
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e) x""")


def with_ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` prefix for the named adapter CTEs (and their dependencies) plus
    ``extra`` query-specific CTEs (in the given order, after the adapters)."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)
    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in order]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


def per_supplier_sql(sql: str) -> str:
    """A copy of a query's SQL over one search per supplier."""
    suppliers = (f"(SELECT s_suppkey AS n_nationkey, 'supplier-' || CAST(s_suppkey AS VARCHAR) AS n_name, "
                 f"s_suppkey // {SEARCHES_PER_LIST} AS n_regionkey FROM supplier)")
    return (sql.replace("\nFROM nation)", f"\nFROM {suppliers} n)")
            .replace("JOIN nation n ON s.search_id", f"JOIN {suppliers} n ON s.search_id")
            .replace(f"l.l_suppkey % {N_SEARCHES} AS search_id", "l.l_suppkey AS search_id"))


def haystack_sql(a: str) -> str:
    return (f"lower(coalesce({a}.title, '') || ' ' || coalesce({a}.location, '') || ' ' || "
            f"coalesce({a}.description, ''))")


def criteria_sql(lst: str, s: str) -> str:
    """C3 in SQL for listing alias ``lst`` and search alias ``s``."""
    def within(v, lo, hi):
        return (f"({lst}.{v} IS NULL OR (({s}.{lo} IS NULL OR {lst}.{v} >= {s}.{lo}) AND "
                f"({s}.{hi} IS NULL OR {lst}.{v} <= {s}.{hi})))")
    hay = haystack_sql(lst)
    return " AND ".join([
        within("price", "min_rent", "max_rent"), within("rooms", "min_rooms", "max_rooms"),
        within("sqm", "min_sqm", "max_sqm"),
        f"len(list_filter(coalesce({s}.excluded_keywords, []::VARCHAR[]), lambda k: contains({hay}, k))) = 0",
        f"len(list_filter(coalesce({s}.required_keywords, []::VARCHAR[]), lambda k: NOT contains({hay}, k))) = 0",
    ])


def norm_location_sql(x: str) -> str:
    return (f"coalesce(trim(regexp_replace(regexp_replace(lower({x}), '\\b\\d{{5}}\\b', ' ', 'g'), "
            f"'[\\s\\-,]+', ' ', 'g')), '')")


def signature_sql(a: str) -> str:
    """B4 in SQL for alias ``a`` (half-even rounding via round_even)."""
    r = lambda c: f"CAST(CAST(round_even({a}.{c}, 0) AS BIGINT) AS VARCHAR)"
    key = (f"{r('price')} || '|' || {r('sqm')} || '|' || coalesce({r('rooms')}, '?') || '|' || "
           f"{norm_location_sql(a + '.location')}")
    return f"CASE WHEN {a}.price IS NOT NULL AND {a}.sqm IS NOT NULL THEN 'sig:' || substr(sha1({key}), 1, 16) END"


ORDER_SQL = "search_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity"


from .adapters import ALIVE_BODY, REMOVED_BODY  # noqa: E402

CTES["results"] = ((), """
SELECT CASE WHEN p_partkey % 10 = 0 THEN 'rss' ELSE 'kleinanzeigen' END || ':' || CAST(p_partkey AS VARCHAR) AS listing_id,
       p_name AS title,
       CASE WHEN p_partkey % 13 <> 0 THEN 'https://www.kleinanzeigen.de/s-anzeige/' || CAST(p_partkey AS VARCHAR) END AS url,
       CASE WHEN p_partkey % 10 = 0 THEN 'rss' ELSE 'kleinanzeigen' END AS source,
       CASE WHEN p_size % 2 = 0 THEN 'wohnung-mieten' END AS search_type,
       ([NULL, '', 'new', 'interested']::VARCHAR[])[p_size % 4 + 1] AS status,
       p_retailprice AS price, CAST(p_size AS DOUBLE) AS sqm,
       ([TRUE, FALSE, NULL]::BOOLEAN[])[p_size % 3 + 1] AS available,
       CASE WHEN p_partkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 7 AS INTEGER)) END AS last_checked,
       CAST(NULL AS TIMESTAMP) AS removed_at
FROM part""")

CTES["fetches"] = ((), f"""
SELECT listing_id,
       arg_max(CASE l_linenumber WHEN 1 THEN 404 WHEN 2 THEN 410 WHEN 3 THEN 403 WHEN 4 THEN 500 ELSE 200 END, okey) AS http_status,
       arg_max(CASE WHEN l_returnflag = 'R' THEN '{REMOVED_BODY}' ELSE '{ALIVE_BODY}' END, okey) AS body
FROM (SELECT CASE WHEN l_partkey % 10 = 0 THEN 'rss' ELSE 'kleinanzeigen' END || ':' || CAST(l_partkey AS VARCHAR) AS listing_id,
             l.*, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS okey
      FROM lineitem l) x
GROUP BY listing_id""")


def cycle_ctes(portal: str = "board", cap: int = 15) -> dict[str, str]:
    """The cycle chain (§3.1) as CTEs over ``listings``, ``searches``, ``seen_all``
    and ``details``."""
    hay = None  # noqa: F841
    return {
        "fetched": "SELECT l.* FROM listings l WHERE l.search_id IN (SELECT search_id FROM searches WHERE enabled AND url <> '')",
        "matched": f"SELECT l.*, s.search_type FROM fetched l JOIN searches s ON l.search_id = s.search_id WHERE {criteria_sql('l', 's')}",
        "firsts": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {ORDER_SQL}) AS rn
FROM matched) x WHERE rn = 1""",
        "new1": "SELECT f.* FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM seen_all s WHERE s.key = f.listing_id)",
        "enr": f"""SELECT n.listing_id, n.source, n.title, n.url,
  coalesce(n.price, d.price) AS price, coalesce(n.rooms, d.rooms) AS rooms, coalesce(n.sqm, d.sqm) AS sqm,
  n.location, coalesce(nullif(d.description, ''), n.description) AS description, n.thumbnail,
  CASE WHEN len(d.features) > 0 THEN d.features ELSE n.features END AS features,
  d.bedrooms, d.bathrooms, d.floor, d.apartment_type, d.available_from, d.additional_costs, d.warm_rent, d.deposit,
  n.search_id, n.search_type, n.l_orderkey, n.l_linenumber, n.l_partkey, n.l_suppkey, n.l_shipdate, n.l_quantity,
  d.listing_id IS NOT NULL AS has_detail
FROM new1 n LEFT JOIN details d ON d.listing_id = n.listing_id AND n.source = '{portal}'""",
        "refiltered": f"""SELECT e.* FROM enr e JOIN searches s ON s.search_id = e.search_id
WHERE s.enabled AND s.url <> '' AND {criteria_sql('e', 's')}""",
        "csigs": f"SELECT r.*, {signature_sql('r')} AS signature FROM refiltered r",
        "cranked": f"""SELECT *, first_value(listing_id) OVER (PARTITION BY signature ORDER BY {ORDER_SQL}) AS first_id
FROM csigs WHERE signature IS NOT NULL""",
        "kept": """SELECT * EXCLUDE (first_id) FROM cranked WHERE listing_id = first_id AND signature NOT IN (SELECT key FROM seen_all)
UNION ALL SELECT * FROM csigs WHERE signature IS NULL""",
        "cdropped": """SELECT * EXCLUDE (first_id) FROM cranked WHERE listing_id <> first_id OR signature IN (SELECT key FROM seen_all)""",
        "individual": f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS position FROM kept) x
WHERE position <= {cap}""",
        "overflow": f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS position FROM kept) x
WHERE position > {cap}""",
    }


def html_escape_sql(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


def format_attrs_sql(a: str) -> str:
    return (f"concat_ws(' · ', CASE WHEN {a}.price IS NOT NULL THEN CAST(CAST(round_even({a}.price, 0) AS BIGINT) AS VARCHAR) || ' €' END, "
            f"CASE WHEN {a}.rooms IS NOT NULL THEN format('{{:g}}', {a}.rooms) || ' Zi' END, "
            f"CASE WHEN {a}.sqm IS NOT NULL THEN format('{{:g}}', {a}.sqm) || ' m²' END, "
            f"CASE WHEN {a}.location <> '' THEN {a}.location END)")


def staged_ctes(batches: int, order: str, landed: str = "landed", details: str | None = None, portal: str = "board",
                sent: str | None = None, max_attempts: int = 5, cap: int = 15) -> str:
    """The cycle over the batches of ``landed`` (its column ``chunk``), one after the other, as CTEs: per batch b
    ``first{b}``, ``fresh{b}``, ``kept{b}``, ``dropped{b}``, ``status{b}`` (with ``sent``, SQL of a message's fate by
    ``listing_id`` and ``{b}``; without it everything is stored), ``stored{b}``, ``keys{b}`` (new seen keys),
    ``seen{b}`` (all so far) and ``tries{b}`` (retry counters carried on)."""
    out = ["seen_start AS MATERIALIZED (SELECT CAST(NULL AS VARCHAR) AS key WHERE false)",
           "tries_start AS MATERIALIZED (SELECT CAST(NULL AS VARCHAR) AS listing_id, 0 AS n WHERE false)"]
    active = "s.enabled AND s.url <> ''"
    plain = "l.* EXCLUDE (search_type, rn)"
    for b in range(batches):
        prev, tries = (f"seen{b - 1}", f"tries{b - 1}") if b else ("seen_start", "tries_start")
        steps = {
            f"first{b}": f"""SELECT * FROM (SELECT l.*, s.search_type, row_number() OVER (PARTITION BY listing_id ORDER BY {order.replace('search_id', 'l.search_id')}) AS rn
FROM {landed} l JOIN searches s ON l.search_id = s.search_id WHERE l.chunk = {b} AND {active} AND {criteria_sql('l', 's')}) x WHERE rn = 1""",
            f"new{b}": f"SELECT * FROM first{b} WHERE listing_id NOT IN (SELECT key FROM {prev})"}
        if details:
            steps[f"rich{b}"] = f"""SELECT n.* REPLACE (coalesce(n.price, d.price) AS price, coalesce(n.rooms, d.rooms) AS rooms,
  coalesce(n.sqm, d.sqm) AS sqm, coalesce(nullif(d.description, ''), n.description) AS description), d.floor, d.warm_rent,
  CASE WHEN len(d.features) > 0 THEN d.features ELSE []::VARCHAR[] END AS features
FROM new{b} n LEFT JOIN {details} d ON d.listing_id = n.listing_id AND n.source = '{portal}'"""
            steps[f"fresh{b}"] = f"""SELECT l.* FROM rich{b} l JOIN searches s ON l.search_id = s.search_id
WHERE {active} AND {criteria_sql('l', 's')}"""
        else:
            steps[f"fresh{b}"] = f"SELECT * FROM new{b}"
        steps |= {
            f"signed{b}": f"SELECT r.*, {signature_sql('r')} AS signature FROM fresh{b} r",
            f"ranked{b}": f"""SELECT *, signature IS NOT NULL AND (signature IN (SELECT key FROM {prev}) OR listing_id <>
  first_value(listing_id) OVER (PARTITION BY signature ORDER BY {order})) AS repost FROM signed{b}""",
            f"kept{b}": f"SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ranked{b} WHERE NOT repost",
            f"dropped{b}": f"SELECT * FROM ranked{b} WHERE repost"}
        if sent:
            steps[f"status{b}"] = f"""SELECT *, any_sent OR n >= {max_attempts} AS settled FROM (
SELECT k.listing_id, k.source, k.place > {cap} AS over, {sent.format(b=b)} AS any_sent, coalesce(t.n, 0) + 1 AS n
FROM kept{b} k LEFT JOIN {tries} t ON t.listing_id = k.listing_id) x"""
            steps[f"tries{b}"] = f"""SELECT listing_id, n FROM status{b} WHERE NOT settled UNION ALL
SELECT listing_id, n FROM {tries} WHERE listing_id NOT IN (SELECT listing_id FROM status{b})"""
            steps[f"stored{b}"] = f"SELECT * FROM kept{b} WHERE listing_id IN (SELECT listing_id FROM status{b} WHERE settled)"
        else:
            steps[f"stored{b}"] = f"SELECT * FROM kept{b}"
            steps[f"tries{b}"] = "SELECT listing_id, n FROM tries_start"
        steps[f"keys{b}"] = f"""SELECT key FROM (SELECT listing_id AS key FROM stored{b} UNION SELECT signature FROM stored{b} WHERE signature IS NOT NULL
UNION SELECT listing_id FROM dropped{b}) x WHERE key NOT IN (SELECT key FROM {prev})"""
        steps[f"seen{b}"] = f"SELECT key FROM {prev} UNION SELECT key FROM keys{b}"
        out += [f"{name} AS MATERIALIZED ({sql})" for name, sql in steps.items()]
    return ",\n".join(out) + "\n"
