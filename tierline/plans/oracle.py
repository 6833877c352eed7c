"""Oracle SQL (DuckDB dialect) for every registered query that SQL can state.

The same binding rules and the same arithmetic as the Spark side are written
out here: exact decimal sums, ``r2`` rounding, ``TRY_CAST`` with the number
guard. Tables are the pre-registered views named like the Parquet files.
"""

from __future__ import annotations

from tierline import settings as S
from tierline.functions.numeric import NUMBER_PATTERN


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def r2(x: str, digits: int = 2) -> str:
    scale = f"{float(10 ** digits)}"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale})"


def xsum(x: str, over: str = "") -> str:
    """Decimal sum (8 decimals), independent of the order of rows."""
    return f"CAST(SUM(CAST({x} AS DECIMAL(27,8))) {over} AS DOUBLE)"


def xmean(x: str) -> str:
    return f"({xsum(x)} / COUNT({x}))"


def xstd(x: str) -> str:
    return f"STDDEV_SAMP({x})"


def coerce(x: str, fill: str = "0.0") -> str:
    """Text or number to DOUBLE, non-numbers and non-finite values to ``fill``."""
    t = f"CAST({x} AS VARCHAR)"
    parsed = f"(CASE WHEN regexp_matches({t}, '{NUMBER_PATTERN}') THEN TRY_CAST(trim({t}) AS DOUBLE) END)"
    return (f"COALESCE(CASE WHEN NOT isnan({parsed}) AND abs({parsed}) <> 'inf'::DOUBLE "
            f"THEN {parsed} END, {fill})")


def coerce_num(x: str, fill: str = "0.0") -> str:
    v = f"CAST({x} AS DOUBLE)"
    return f"COALESCE(CASE WHEN NOT isnan({v}) AND abs({v}) <> 'inf'::DOUBLE THEN {v} END, {fill})"


E_COMPONENTS = ["c0", "c1", "c2", "c3", "c4", "c5"]
S_COMPONENTS = ["p1", "p2", "p3", "p4", "p5"]
S_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FUELS = ["natural_gas", "wind", "solar", "coal", "nuclear", "other"]


def share(parts: list[str], comps: list[str]) -> str:
    part = " + ".join(f"COALESCE({c}, 0.0)" for c in parts)
    total = " + ".join(f"COALESCE({c}, 0.0)" for c in comps)
    return r2(f"(({part}) / NULLIF({total}, 0.0) * 100.0)")


# --- binding E ---------------------------------------------------------------
PRICES_E = """
prices_e AS (
  SELECT event_type AS entity,
         ts AS interval_start,
         CAST(user_id AS VARCHAR) AS location,
         CASE WHEN user_id % 2 = 0 THEN 'HUB' ELSE 'NODE' END AS location_type,
         value AS price,
         CASE WHEN event_id % 10 = 0 THEN 'SYNTHETIC' ELSE 'REAL' END AS market
  FROM events)"""

_mix_cols = ",\n         ".join(
    f"{xsum(f'CASE WHEN event_id % 6 = {i} THEN value END')} AS {c}"
    for i, c in enumerate(E_COMPONENTS))

RAW_MIX_E = f"""
raw_mix_e AS (
  SELECT event_type AS entity,
         date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 15) * 15 AS BIGINT)) + INTERVAL 1 HOUR AS time,
         {_mix_cols}
  FROM events
  GROUP BY 1, 2)"""

# share is taken over the already filled components, as on the Spark side
MIX_E = f"""
mix_e0 AS (
  SELECT entity, time, {", ".join(f"{coerce_num(c)} AS {c}" for c in E_COMPONENTS)}
  FROM raw_mix_e),
mix_e AS (
  SELECT entity, time, {", ".join(E_COMPONENTS)},
         {share(["c1", "c2"], E_COMPONENTS)} AS share_pct
  FROM mix_e0)"""

COMPUTED_AT = "TIMESTAMP '2024-02-01 00:00:00'"


def hourly_prices_sql(src: str, name: str = "hp") -> str:
    return f"""
{name} AS (
  SELECT entity, date_trunc('hour', interval_start) AS window_start,
         {r2(xmean("price"))} AS avg_price,
         {r2("MAX(price)")} AS max_price,
         {r2("MIN(price)")} AS min_price
  FROM {src}
  GROUP BY 1, 2)"""


def hourly_mix_sql(src: str, comps: list[str], name: str = "hm", time_col: str = "time") -> str:
    cols = ",\n         ".join(f"{r2(xmean(c))} AS {c}" for c in comps)
    return f"""
{name} AS (
  SELECT entity, date_trunc('hour', {time_col}) AS window_start,
         {r2(xmean("share_pct"))} AS share_pct,
         {cols}
  FROM {src}
  GROUP BY 1, 2)"""


def gold_select(p: str, m: str, comps: list[str]) -> str:
    return f"""
  SELECT {p}.entity, {p}.window_start, {p}.window_start + INTERVAL 1 HOUR AS window_end,
         avg_price, max_price, min_price, share_pct, {", ".join(comps)},
         {COMPUTED_AT} AS computed_at
  FROM {p} LEFT JOIN {m} ON {p}.entity = {m}.entity AND {p}.window_start = {m}.window_start"""


GOLD_E_CTES = ",".join([PRICES_E, RAW_MIX_E, MIX_E, hourly_prices_sql("prices_e"),
                        hourly_mix_sql("mix_e", E_COMPONENTS)]) + f""",
gold AS ({gold_select("hp", "hm", E_COMPONENTS)})"""


def with_gold(body: str, *ctes: str) -> str:
    """A query over the binding-E gold table (as a CTE named ``gold``)."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {GOLD_E_CTES}{extra}\n{body}"


def spark_quantiles(src: str, col: str, qs: dict[str, float], name: str = "qt") -> str:
    """CTEs ``{name}_r``, ``{name}_b``, ``{name}``: per entity n and the exact
    quantiles with Spark's interpolation, (hi - pos) * v_lo + (pos - lo) * v_hi
    at pos = (n - 1) * p, so both engines do the same double operations."""
    def pos(p: float) -> str:
        return f"(CAST(n - 1 AS DOUBLE) * CAST({p!r} AS DOUBLE))"
    picks = ",\n    ".join(
        f"MAX(CASE WHEN rn = CAST(floor({pos(p)}) AS BIGINT) + 1 THEN v END) AS lo_{k},\n    "
        f"MAX(CASE WHEN rn = CAST(ceil({pos(p)}) AS BIGINT) + 1 THEN v END) AS hi_{k}"
        for k, p in qs.items())
    interp = ",\n    ".join(
        f"CASE WHEN ceil({pos(p)}) = floor({pos(p)}) OR hi_{k} = lo_{k} THEN lo_{k} "
        f"ELSE (ceil({pos(p)}) - {pos(p)}) * lo_{k} + ({pos(p)} - floor({pos(p)})) * hi_{k} END AS {k}"
        for k, p in qs.items())
    return f"""{name}_r AS (
  SELECT entity, {col} AS v,
         ROW_NUMBER() OVER (PARTITION BY entity ORDER BY {col}) AS rn,
         COUNT(*) OVER (PARTITION BY entity) AS n
  FROM {src} WHERE {col} IS NOT NULL),
{name}_b AS (
  SELECT entity, n,
    {picks}
  FROM {name}_r GROUP BY entity, n),
{name} AS (
  SELECT entity, n,
    {interp}
  FROM {name}_b)"""


# --- binding S ---------------------------------------------------------------
SUPPLIER_NATION = """
sn AS (
  SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PRICES_S = """
prices_s AS (
  SELECT n_name AS entity, l_shipdate AS interval_start,
         CAST(l_suppkey AS VARCHAR) AS location, 'SUPPLIER' AS location_type,
         CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price,
         'REAL' AS market
  FROM lineitem JOIN sn ON l_suppkey = s_suppkey)"""

_s_cols = ",\n         ".join(
    f"{xsum(f'CASE WHEN o_orderpriority = {chr(39)}{p}{chr(39)} THEN l_extendedprice END')} AS {c}"
    for p, c in zip(S_PRIORITIES, S_COMPONENTS))

RAW_MIX_S = f"""
raw_mix_s AS (
  SELECT n_name AS entity, date_trunc('day', l_shipdate) AS time,
         {_s_cols}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sn ON l_suppkey = s_suppkey
  GROUP BY 1, 2),
mix_s0 AS (
  SELECT entity, time, {", ".join(f"{coerce_num(c)} AS {c}" for c in S_COMPONENTS)} FROM raw_mix_s),
mix_s AS (
  SELECT entity, time, {", ".join(S_COMPONENTS)}, {share(["p1", "p2"], S_COMPONENTS)} AS share_pct
  FROM mix_s0)"""

GOLD_S_CTES = ",".join([SUPPLIER_NATION, PRICES_S, RAW_MIX_S, hourly_prices_sql("prices_s"),
                        hourly_mix_sql("mix_s", S_COMPONENTS)])

ORACLE: dict[str, str] = {}

ORACLE["gold_summary"] = with_gold("SELECT * FROM gold")
ORACLE["gold_summary_star"] = f"WITH {GOLD_S_CTES}\n{gold_select('hp', 'hm', S_COMPONENTS)}"
ORACLE["gold_summary_star_feeds"] = ORACLE["gold_summary_star"]
ORACLE["land_prices"] = f"WITH {PRICES_E}\nSELECT * FROM prices_e"
ORACLE["land_mix"] = f"WITH {RAW_MIX_E}\nSELECT * FROM raw_mix_e"

# --- snapshot and history (gold E) ---------------------------------------------
_E_MIX_COLS = ", ".join(["share_pct", *E_COMPONENTS])
LATEST = "(SELECT MAX(window_start) FROM gold)"

ORACLE["latest_rows"] = with_gold(f"SELECT * FROM gold WHERE window_start = {LATEST}")
ORACLE["latest_per_entity"] = with_gold(
    "SELECT g.* FROM gold g JOIN (SELECT entity, MAX(window_start) AS mw FROM gold GROUP BY entity) m "
    "ON g.entity = m.entity AND g.window_start = m.mw")
ORACLE["snapshot_lookback"] = with_gold(f"""
SELECT g.entity, g.window_start, g.window_end, g.avg_price, lb.range_min, lb.range_max,
       {", ".join("g." + c for c in ["share_pct", *E_COMPONENTS])}, g.computed_at
FROM gold g JOIN lb ON g.entity = lb.entity
WHERE g.window_start = {LATEST}
ORDER BY g.entity""", f"""lb AS (
  SELECT entity, MIN(avg_price) AS range_min, MAX(avg_price) AS range_max FROM gold
  WHERE window_start >= {LATEST} - INTERVAL 48 HOUR GROUP BY entity)""")
ORACLE["price_history"] = with_gold("SELECT entity, window_start, avg_price FROM gold ORDER BY entity, window_start")
ORACLE["mix_history"] = with_gold(
    f"SELECT entity, window_start, window_end, avg_price, {_E_MIX_COLS} FROM gold ORDER BY entity, window_start")
ORACLE["filter_entities"] = with_gold("SELECT * FROM gold WHERE entity IN ('click', 'purchase', 'view')")
ORACLE["filter_time_range"] = with_gold(
    "SELECT * FROM gold WHERE window_start BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 23:00:00'")
ORACLE["head_per_entity"] = f"""WITH {PRICES_E}
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY entity ORDER BY interval_start, location, price) AS INTEGER) AS rn
FROM prices_e QUALIFY rn <= 10"""
ORACLE["price_band"] = with_gold("""
SELECT entity, window_start, avg_price,
       CASE WHEN avg_price < 50.0 THEN 'normal' WHEN avg_price < 100.0 THEN 'off'
            WHEN avg_price IS NOT NULL THEN 'inverse' END AS band
FROM gold""")
_ZONE_ROWS = ", ".join(f"('{z}', {o}, '{a}', '{d}')" for z, (o, a, d) in S.ZONE_ABBREVIATIONS.items())
ORACLE["local_window"] = with_gold(f"""
SELECT entity, window_end, tz, local_start, local_end, zone_abbr,
       {q(S.WINDOW_LABEL_PREFIX)} || strftime(local_start, '%b %d %I:%M%p') || ' to '
         || strftime(local_end, '%b %d %I:%M%p') || ' ' || zone_abbr AS label
FROM (
  SELECT *, CASE WHEN zone_tz IS NULL THEN 'UTC'
                 WHEN std_offset IS NULL THEN printf('UTC%s%02d:%02d', CASE WHEN off < 0 THEN '-' ELSE '+' END,
                                                     abs(off) // 60, abs(off) % 60)
                 WHEN off = std_offset THEN std_abbr ELSE dst_abbr END AS zone_abbr
  FROM (
    SELECT g.entity, g.window_end, z.tz AS zone_tz, COALESCE(z.tz, 'UTC') AS tz,
           timezone(COALESCE(z.tz, 'UTC'), (g.window_end - INTERVAL 48 HOUR) AT TIME ZONE 'UTC') AS local_start,
           timezone(COALESCE(z.tz, 'UTC'), g.window_end AT TIME ZONE 'UTC') AS local_end,
           CAST((epoch_us(timezone(COALESCE(z.tz, 'UTC'), g.window_end AT TIME ZONE 'UTC'))
                 - epoch_us(g.window_end)) // 60000000 AS INTEGER) AS off,
           a.std_offset, a.std_abbr, a.dst_abbr
    FROM gold g LEFT JOIN zones z ON g.entity = z.entity LEFT JOIN abbr a ON z.tz = a.tz
    WHERE g.window_start = {LATEST}) t) u""", """zones AS (
  SELECT * FROM (VALUES ('click', 'America/Chicago'), ('purchase', 'America/New_York'),
                        ('signup', 'America/Los_Angeles'), ('view', 'Europe/Berlin')) v(entity, tz))""",
    f"abbr AS (SELECT * FROM (VALUES {_ZONE_ROWS}) v(tz, std_offset, std_abbr, dst_abbr))")

# --- anomaly (gold E) -----------------------------------------------------------
def r6(x: str) -> str:
    return r2(x, 6)


ANOMALY_CTES = (f"""cur AS (
  SELECT entity, avg_price AS current_price FROM gold WHERE window_start = {LATEST})""",
                f"""base AS (
  SELECT entity, COUNT(avg_price) AS n, {xmean("avg_price")} AS mean, {xstd("avg_price")} AS std
  FROM gold WHERE avg_price IS NOT NULL GROUP BY entity)""",
                """zj AS (
  SELECT cur.entity, current_price, n, mean, std, (current_price - mean) / NULLIF(std, 0.0) AS z
  FROM cur LEFT JOIN base ON cur.entity = base.entity)""",
                spark_quantiles("gold", "avg_price", {"q25": 0.25, "q75": 0.75}),
                f"""scores AS (
  SELECT zj.entity,
         CASE WHEN COALESCE(zj.n, 0) < 5 THEN 'grey'
              WHEN z IS NULL OR isnan(z) THEN 'grey'
              WHEN abs(z) < 1.0 THEN 'green' WHEN abs(z) < 2.0 THEN 'yellow'
              WHEN abs(z) < 3.0 THEN 'red' ELSE 'critical' END AS status,
         current_price,
         CASE WHEN COALESCE(zj.n, 0) >= 5 AND z IS NOT NULL AND NOT isnan(z) THEN {r2("z")} END AS z_score,
         CASE WHEN COALESCE(zj.n, 0) < 5 THEN {q(S.MSG_Z_SHORT % 5)}
              WHEN z IS NOT NULL AND NOT isnan(z) THEN printf({q(S.MSG_Z_SCORE)}, z)
              WHEN current_price IS NULL OR isnan(current_price) THEN {q(S.MSG_Z_NO_VALUE)}
              ELSE {q(S.MSG_Z_FLAT)} END AS reason,
         COALESCE(zj.n, 0) AS n, {r6("mean")} AS mean, {r6("std")} AS std,
         {r6("q25")} AS q25, {r6("q75")} AS q75, {r6("q75 - q25")} AS spread
  FROM zj LEFT JOIN qt ON zj.entity = qt.entity)""")

ORACLE["anomaly_scores"] = with_gold("SELECT * FROM scores", *ANOMALY_CTES)
ORACLE["status_board"] = with_gold(f"""
SELECT g.entity, g.window_start, g.avg_price, COALESCE(s.status, 'grey') AS status, s.z_score
FROM gold g LEFT JOIN scores s ON g.entity = s.entity
WHERE g.window_start = {LATEST}""", *ANOMALY_CTES)
ORACLE["anomaly_baseline"] = with_gold(f"""
SELECT m.entity, m.n, {r6("m.mean")} AS mean, {r6("m.std")} AS std, {r6("q.q25")} AS q25, {r6("q.q75")} AS q75,
       {r6("q.q75 - q.q25")} AS spread, m.n >= 5 AS has_baseline
FROM (SELECT entity, COUNT(avg_price) AS n, {xmean("avg_price")} AS mean, {xstd("avg_price")} AS std
      FROM gold WHERE avg_price IS NOT NULL GROUP BY entity) m
JOIN qt q ON m.entity = q.entity""", spark_quantiles("gold", "avg_price", {"q25": 0.25, "q75": 0.75}))

# --- distributions (gold E) -----------------------------------------------------
ORACLE["price_cdf"] = with_gold("""
SELECT entity, window_start, avg_price,
       ROW_NUMBER() OVER (PARTITION BY entity ORDER BY avg_price, window_start)
         / COUNT(*) OVER (PARTITION BY entity) * 100.0 AS cdf_pct
FROM gold WHERE avg_price IS NOT NULL""")
ORACLE["price_histogram"] = with_gold("""
SELECT entity, bin, lo + bin * w AS bin_lo, lo + (bin + 1) * w AS bin_hi, COUNT(*) AS count
FROM (SELECT entity, lo, w,
             CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((avg_price - lo) / w), 19) END AS INTEGER) AS bin
      FROM gold, rng WHERE avg_price IS NOT NULL) b
GROUP BY entity, bin, lo, w""", """rng AS (
  SELECT MIN(avg_price) AS lo, (MAX(avg_price) - MIN(avg_price)) / 20.0 AS w
  FROM gold WHERE avg_price IS NOT NULL)""")

_BOX_CTES = (spark_quantiles("gold", "avg_price", {"q1": 0.25, "median": 0.5, "q3": 0.75}),
             f"""fence AS (
  SELECT q.entity, q.n, q.q1, q.median, q.q3, m.mean,
         q.q1 - 1.5 * (q.q3 - q.q1) AS lower_fence, q.q3 + 1.5 * (q.q3 - q.q1) AS upper_fence
  FROM qt q JOIN (SELECT entity, {xmean("avg_price")} AS mean FROM gold
                  WHERE avg_price IS NOT NULL GROUP BY entity) m ON q.entity = m.entity)""")
ORACLE["box_stats"] = with_gold(f"""
SELECT f.entity, f.n, {r6("f.q1")} AS q1, {r6("f.median")} AS median, {r6("f.q3")} AS q3, {r6("f.mean")} AS mean,
       {r6("f.lower_fence")} AS lower_fence, {r6("f.upper_fence")} AS upper_fence,
       MIN(CASE WHEN g.avg_price >= f.lower_fence AND g.avg_price <= f.upper_fence THEN g.avg_price END) AS whisker_low,
       MAX(CASE WHEN g.avg_price >= f.lower_fence AND g.avg_price <= f.upper_fence THEN g.avg_price END) AS whisker_high,
       COUNT(*) FILTER (WHERE NOT (g.avg_price >= f.lower_fence AND g.avg_price <= f.upper_fence)) AS outliers
FROM gold g JOIN fence f ON g.entity = f.entity
WHERE g.avg_price IS NOT NULL
GROUP BY f.entity, f.n, f.q1, f.median, f.q3, f.mean, f.lower_fence, f.upper_fence""", *_BOX_CTES)
ORACLE["box_outliers"] = with_gold("""
SELECT g.entity, g.window_start, g.avg_price
FROM gold g JOIN fence f ON g.entity = f.entity
WHERE g.avg_price IS NOT NULL AND (g.avg_price < f.lower_fence OR g.avg_price > f.upper_fence)""", *_BOX_CTES)
ORACLE["quantile_spread"] = with_gold(
    f"SELECT entity, {r2('q25')} AS q25, {r2('q75')} AS q75, {r2('q75 - q25')} AS spread FROM qt",
    spark_quantiles("gold", "avg_price", {"q25": 0.25, "q75": 0.75}))

_long = " UNION ALL ".join(
    f"SELECT entity, window_start, '{c}' AS component, CAST({c} AS DOUBLE) AS value FROM gold" for c in E_COMPONENTS)
ORACLE["mix_timeseries"] = with_gold("""
SELECT l.entity, l.window_start, l.component, l.value FROM lg l
JOIN (SELECT entity, component FROM lg GROUP BY entity, component
      HAVING SUM(CAST(value AS DECIMAL(27,8))) <> 0) t
  ON l.entity = t.entity AND l.component = t.component""",
    f"lg AS (SELECT entity, window_start, component, COALESCE(value, 0.0) AS value FROM ({_long}) u)")
_long_latest = " UNION ALL ".join(
    f"SELECT entity, '{c}' AS component, CAST({c} AS DOUBLE) AS value FROM gold WHERE window_start = {LATEST}"
    for c in E_COMPONENTS)
ORACLE["mix_share"] = with_gold(f"""
SELECT entity, component, value,
       {r2("value / " + xsum("value", "OVER (PARTITION BY entity)") + " * 100.0")} AS pct
FROM (SELECT entity, component, {r2("value", 1)} AS value FROM ({_long_latest}) u WHERE value > 1.0) s""")
ORACLE["history_summary"] = with_gold("""
SELECT MIN(window_start) AS first_window, MAX(window_start) AS last_window, COUNT(*) AS rows,
       COUNT(DISTINCT entity) AS entities, CAST(floor(COUNT(*) / COUNT(DISTINCT entity)) AS BIGINT) AS hours_per_entity
FROM gold""")
ORACLE["hours_per_selected"] = with_gold("""
SELECT COUNT(*) AS rows, CAST(floor(COUNT(*) / 3) AS BIGINT) AS hours_per_entity
FROM gold WHERE entity IN ('click', 'purchase', 'view')""")

# --- binding X -----------------------------------------------------------------
def raw_x(since: str | None = None, until: str | None = None, name: str = "raw_x") -> str:
    cond = ["TRUE"]
    if since:
        cond.append(f"ts >= TIMESTAMP '{since}'")
    if until:
        cond.append(f"ts < TIMESTAMP '{until}'")
    return f"""{name}_0 AS (
  SELECT CASE WHEN event_id % 89 = 0 THEN NULL ELSE event_type END AS entity,
         CASE WHEN event_id % 7 = 0 THEN NULL
              WHEN event_id % 101 = 0 AND event_type = 'error' THEN 'not a time'
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS "Interval Start",
         CASE WHEN event_id % 7 = 0 THEN ts END AS time,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS "Location",
         CASE WHEN user_id % 2 = 0 THEN 'HUB' ELSE 'NODE' END AS "Location Type",
         CASE WHEN event_id % 97 = 0 THEN 'abc' WHEN event_id % 53 = 0 THEN ''
              WHEN event_id % 59 = 0 THEN '1e3' WHEN event_id % 61 = 0 THEN '12.5f'
              WHEN event_id % 67 = 0 THEN '1_000' WHEN event_id % 71 = 0 THEN NULL
              ELSE printf('%.2f', value) END AS "LMP",
         CASE WHEN event_id % 10 = 0 THEN 'SYNTHETIC' WHEN event_id % 10 = 1 THEN NULL ELSE 'REAL' END AS "Market",
         value AS energy, CAST(0.0 AS DOUBLE) AS congestion, event_id
  FROM events WHERE {" AND ".join(cond)}),
{name} AS (
  SELECT * EXCLUDE (event_id) FROM {name}_0
  UNION ALL SELECT * EXCLUDE (event_id) FROM {name}_0 WHERE event_id % 83 = 0)"""


def norm_x(src: str = "raw_x", name: str = "norm_x") -> str:
    return f"""{name} AS (
  SELECT entity,
         TRY_CAST(COALESCE("Interval Start", CAST(time AS VARCHAR)) AS TIMESTAMP) AS interval_start,
         "Location" AS location, "Location Type" AS location_type,
         {coerce('"LMP"')} AS price,
         COALESCE("Market", 'UNKNOWN') AS market
  FROM {src})"""


X_MIX_NAMES = ["Natural Gas", "Wind", "Solar", "Coal", "Nuclear", "Other"]


def raw_mix_x(since: str | None = None, until: str | None = None, name: str = "raw_mix_x") -> str:
    cond = ["TRUE"]
    if since:
        cond.append(f"time >= TIMESTAMP '{since}'")
    if until:
        cond.append(f"time < TIMESTAMP '{until}'")
    cols = []
    for src, nm in zip(E_COMPONENTS, X_MIX_NAMES):
        text = f"printf('%.2f', {src})"
        if nm == "Wind":
            text = f"CASE WHEN dayofmonth(time) % 5 = 0 AND minute(time) = 45 THEN 'n/a' ELSE {text} END"
        if nm == "Other":
            text = f"CASE WHEN dayofmonth(time) % 7 = 0 AND minute(time) = 30 THEN NULL ELSE {text} END"
        cols.append(f'CASE WHEN {src} IS NOT NULL THEN {text} END AS "{nm}"')
    return f"""{name} AS (
  SELECT entity, strftime(time, '%Y-%m-%d %H:%M:%S') AS "Time", {", ".join(cols)}
  FROM raw_mix_e WHERE {" AND ".join(cond)})"""


def norm_mix_x(src: str = "raw_mix_x", name: str = "norm_mix_x") -> str:
    fuels = ", ".join(f'{coerce(chr(34) + nm + chr(34))} AS {f}' for nm, f in zip(X_MIX_NAMES, FUELS))
    return f"""{name}_0 AS (
  SELECT entity, TRY_CAST("Time" AS TIMESTAMP) AS time, {fuels} FROM {src}),
{name} AS (
  SELECT entity, time, {", ".join(FUELS)}, {share(["wind", "solar"], FUELS)} AS share_pct FROM {name}_0)"""


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


ORACLE["first_present_column"] = w(raw_x()) + """
SELECT entity, TRY_CAST(COALESCE("Interval Start", CAST(time AS VARCHAR)) AS TIMESTAMP) AS interval_start,
       "Location" AS location FROM raw_x"""
ORACLE["rename_by_contract"] = w(raw_x()) + """
SELECT entity, TRY_CAST(COALESCE("Interval Start", CAST(time AS VARCHAR)) AS TIMESTAMP) AS interval_start,
       "Location" AS location, "Location Type" AS location_type, "LMP" AS price, "Market" AS market,
       energy, congestion FROM raw_x"""
ORACLE["normalize_timestamps"] = w(raw_x()) + """
SELECT entity, "Interval Start" AS start_text, TRY_CAST("Interval Start" AS TIMESTAMP) AS interval_start FROM raw_x"""
ORACLE["coerce_numeric"] = w(raw_x()) + f"""
SELECT entity, "LMP" AS price_text, {coerce('"LMP"')} AS price FROM raw_x"""
ORACLE["project_to_contract"] = w(raw_x()) + """
SELECT entity, TRY_CAST(COALESCE("Interval Start", CAST(time AS VARCHAR)) AS TIMESTAMP) AS interval_start,
       "Location" AS location, "Location Type" AS location_type, "LMP" AS price, "Market" AS market FROM raw_x"""
ORACLE["normalize_prices"] = w(raw_x(), norm_x()) + "SELECT * FROM norm_x"
ORACLE["normalize_mix"] = w(RAW_MIX_E, raw_mix_x(), norm_mix_x()) + "SELECT * FROM norm_mix_x"
ORACLE["renewable_share"] = w(RAW_MIX_E, raw_mix_x(), norm_mix_x()) + \
    "SELECT entity, time, wind, solar, share_pct FROM norm_mix_x"
ORACLE["union_feeds"] = w(raw_x(), norm_x(), PRICES_E) + """
SELECT * FROM norm_x
UNION ALL SELECT entity, interval_start, location, NULL AS location_type, price, market FROM prices_e"""
ORACLE["contract_presence"] = w(raw_x(), norm_x()) + """
SELECT v.field, v.status, v.message, c.non_null FROM (VALUES
  ('entity', 'ok', 'Field ''entity'' is present'),
  ('interval_start', 'ok', 'Field ''interval_start'' is present'),
  ('price', 'ok', 'Field ''price'' is present'),
  ('location', 'warning', 'Optional field ''location'' is missing from DataFrame'),
  ('location_type', 'ok', 'Field ''location_type'' is present'),
  ('market', 'ok', 'Field ''market'' is present')) v(field, status, message)
LEFT JOIN (
  SELECT 'entity' AS field, COUNT(entity) AS non_null FROM norm_x
  UNION ALL SELECT 'interval_start', COUNT(interval_start) FROM norm_x
  UNION ALL SELECT 'price', COUNT(price) FROM norm_x
  UNION ALL SELECT 'location_type', COUNT(location_type) FROM norm_x
  UNION ALL SELECT 'market', COUNT(market) FROM norm_x) c ON v.field = c.field"""

PRICE_REQUIRED = ["entity", "interval_start", "price"]
PRICE_FIELDS = [("entity", "string"), ("interval_start", "datetime"), ("price", "float"),
                ("location", "string"), ("location_type", "string"), ("market", "string")]


def null_counts(src: str, name: str = "nc") -> str:
    return f"""{name} AS (
  SELECT entity, COUNT(*) AS rows_checked,
         {", ".join(f"COUNT(*) FILTER (WHERE {f} IS NULL) AS n_{f}" for f, _ in PRICE_FIELDS)}
  FROM {src} GROUP BY entity)"""


ORACLE["contract_null_counts"] = w(raw_x(), norm_x(), null_counts("norm_x")) + " UNION ALL ".join(
    f"SELECT entity, '{f}' AS field, rows_checked, n_{f} AS nulls FROM nc" for f in PRICE_REQUIRED)

_num = NUMBER_PATTERN
ORACLE["contract_type_failures"] = w(raw_x(), """rn AS (
  SELECT entity, COALESCE("Interval Start", CAST(time AS VARCHAR)) AS interval_start,
         "Location" AS location, "Location Type" AS location_type, "LMP" AS price, "Market" AS market
  FROM raw_x)""", f"""tc AS (
  SELECT entity,
    {", ".join(f"COUNT({f}) AS v_{f}" for f, _ in PRICE_FIELDS)},
    COUNT(*) FILTER (WHERE interval_start IS NOT NULL AND TRY_CAST(interval_start AS TIMESTAMP) IS NULL) AS t_interval_start,
    COUNT(*) FILTER (WHERE price IS NOT NULL AND NOT regexp_matches(price, '{_num}')) AS t_price
  FROM rn GROUP BY entity)""") + " UNION ALL ".join(
    f"SELECT entity, '{f}' AS field, '{t}' AS expected, "
    f"{'v_price = 0' if f == 'price' else 'TRUE'} AS type_ok, "
    f"CASE WHEN v_{f} > 0 THEN {('t_' + f) if f in ('interval_start', 'price') else '0'} ELSE 0 END AS type_failures FROM tc"
    for f, t in PRICE_FIELDS)


def report_sql(src: str) -> str:
    msgs = ", ".join(
        f"CASE WHEN n_{f} > 0 THEN printf('Field ''%s'' has %d null values but is required non-null', '{f}', n_{f}) END"
        for f in PRICE_REQUIRED)
    nerr = " + ".join(f"CASE WHEN n_{f} > 0 THEN 1 ELSE 0 END" for f in PRICE_REQUIRED)
    return f"""rep AS (
  SELECT entity, ({nerr}) = 0 AS valid, ({nerr}) AS n_errors, 0 AS n_warnings,
         concat_ws('; ', {msgs}) AS errors, '' AS warnings, rows_checked,
         CASE WHEN ({nerr}) > 0 THEN rows_checked ELSE 0 END AS rows_failed
  FROM {src})"""


ORACLE["contract_report"] = w(raw_x(), norm_x(), null_counts("norm_x"), report_sql("nc")) + "SELECT * FROM rep"
ORACLE["contract_quarantine"] = w(raw_x(), norm_x(), null_counts("norm_x"), report_sql("nc")) + """
SELECT n.* FROM norm_x n
WHERE n.entity IS NULL OR EXISTS (SELECT 1 FROM rep r WHERE NOT r.valid AND r.entity = n.entity)"""
ORACLE["gate_by_entity"] = w(raw_x(), norm_x(), null_counts("norm_x"), report_sql("nc")) + """
SELECT n.* FROM norm_x n
WHERE n.entity IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM rep r WHERE NOT r.valid AND r.entity = n.entity)"""


def gated_new_prices(batch: str, name: str) -> str:
    """Contract gate, distinct, required-not-null of one normalized batch."""
    return f"""{name}_nc AS (
  SELECT entity, COUNT(*) FILTER (WHERE interval_start IS NULL) + COUNT(*) FILTER (WHERE price IS NULL) AS bad
  FROM {batch} GROUP BY entity),
{name} AS (
  SELECT DISTINCT entity, interval_start, location, location_type, price, market FROM {batch} b
  WHERE entity IS NOT NULL AND price IS NOT NULL AND interval_start IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM {name}_nc c WHERE c.entity = b.entity AND c.bad > 0))"""


ORACLE["silver_prices"] = w(
    raw_x(until="2024-01-16 00:00:00", name="rx1"), norm_x("rx1", "nx1"), gated_new_prices("nx1", "s1"),
    raw_x(since="2024-01-15 00:00:00", name="rx2"), norm_x("rx2", "nx2"), gated_new_prices("nx2", "s2")) + """
SELECT * FROM s2
WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.entity = s2.entity AND s1.interval_start = s2.interval_start
                  AND COALESCE(s1.location, '') = COALESCE(s2.location, ''))"""


ORACLE["silver_insert_counts"] = w(
    raw_x(until="2024-01-16 00:00:00", name="rx1"), norm_x("rx1", "nx1"), gated_new_prices("nx1", "s1"),
    raw_x(since="2024-01-15 00:00:00", name="rx2"), norm_x("rx2", "nx2"), gated_new_prices("nx2", "s2"),
    """s2new AS (
  SELECT * FROM s2 WHERE NOT EXISTS (
    SELECT 1 FROM s1 WHERE s1.entity = s2.entity AND s1.interval_start = s2.interval_start
      AND COALESCE(s1.location, '') = COALESCE(s2.location, '')))""") + """
SELECT (SELECT COUNT(*) FROM s2new) AS inserted, (SELECT COUNT(*) FROM s2new) + (SELECT COUNT(*) FROM s1) AS total"""


def gated_new_mix(batch: str, name: str) -> str:
    return f"""{name}_nc AS (
  SELECT entity, COUNT(*) FILTER (WHERE time IS NULL) AS bad FROM {batch} GROUP BY entity),
{name} AS (
  SELECT DISTINCT entity, time, {", ".join(FUELS)}, share_pct FROM {batch} b
  WHERE entity IS NOT NULL AND time IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM {name}_nc c WHERE c.entity = b.entity AND c.bad > 0))"""


ORACLE["silver_mix"] = w(
    RAW_MIX_E,
    raw_mix_x(until="2024-01-16 00:00:00", name="rm1"), norm_mix_x("rm1", "nm1"), gated_new_mix("nm1", "m1"),
    raw_mix_x(since="2024-01-15 00:00:00", name="rm2"), norm_mix_x("rm2", "nm2"), gated_new_mix("nm2", "m2")) + """
SELECT * FROM m2
WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.entity = m2.entity AND m1.time = m2.time)"""

# --- bronze (binding E) ----------------------------------------------------------
ORACLE["bronze_prices"] = w(PRICES_E) + """
SELECT entity, interval_start, CAST(NULL AS TIMESTAMP) AS interval_end, location, location_type, price, market,
       interval_start AS ingested_at FROM prices_e"""
ORACLE["bronze_mix"] = w(RAW_MIX_E) + f"""
SELECT entity, time, {", ".join(f"COALESCE({c}, 0.0) AS {c}" for c in E_COMPONENTS)}, time AS ingested_at
FROM raw_mix_e"""
ORACLE["raw_json_audit"] = w(PRICES_E) + "SELECT * FROM prices_e"

# --- gold maintenance (binding E) ------------------------------------------------
_OLD = "window_start < TIMESTAMP '2024-01-10 00:00:00'"
EVOLVED = f"""evolved AS (
  SELECT entity, window_start, window_end, avg_price, max_price, min_price, share_pct,
         {", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in E_COMPONENTS)}, computed_at
  FROM gold WHERE {_OLD}
  UNION ALL SELECT * FROM gold WHERE NOT ({_OLD}))"""
ORACLE["evolve_schema"] = with_gold("SELECT * FROM evolved", EVOLVED)
ORACLE["count_incomplete"] = with_gold(
    "SELECT COUNT(*) FILTER (WHERE c0 IS NULL OR c1 IS NULL OR c2 IS NULL) AS incomplete_rows FROM evolved", EVOLVED)
ORACLE["gold_backfill"] = with_gold(f"""
SELECT e.entity, e.window_start, e.window_end, e.avg_price, e.max_price, e.min_price,
       CASE WHEN e.c0 IS NULL THEN hm.share_pct ELSE e.share_pct END AS share_pct,
       {", ".join(f"CASE WHEN e.c0 IS NULL THEN hm.{c} ELSE e.{c} END AS {c}" for c in E_COMPONENTS)},
       e.computed_at
FROM evolved e LEFT JOIN hm ON e.entity = hm.entity AND e.window_start = hm.window_start""", EVOLVED)

_GI = f"""ex_p AS (SELECT * FROM prices_e WHERE interval_start < TIMESTAMP '2024-01-16 12:30:00'),
{hourly_prices_sql("ex_p", "ex_hp").strip()},
existing AS ({gold_select("ex_hp", "hm", E_COMPONENTS)}),
fresh AS (
  SELECT * FROM prices_e p WHERE interval_start >= TIMESTAMP '2024-01-15 00:00:00'
    AND NOT EXISTS (SELECT 1 FROM existing g WHERE g.entity = p.entity
                    AND g.window_start = date_trunc('hour', p.interval_start))),
{hourly_prices_sql("fresh", "new_hp").strip()},
new_rows AS ({gold_select("new_hp", "hm", E_COMPONENTS)})"""
ORACLE["gold_incremental"] = with_gold("SELECT * FROM existing UNION ALL SELECT * FROM new_rows", _GI)

# --- data health (binding E) ---------------------------------------------------------
BRONZE_E = """bp AS (
  SELECT entity, interval_start, CAST(NULL AS TIMESTAMP) AS interval_end, location, location_type, price, market,
         interval_start AS ingested_at FROM prices_e)"""
BRONZE_MIX_E = f"""bm AS (
  SELECT entity, time, {", ".join(f"COALESCE({c}, 0.0) AS {c}" for c in E_COMPONENTS)}, time AS ingested_at
  FROM raw_mix_e)"""
AS_OF = "((SELECT MAX(ingested_at) FROM bp) + INTERVAL 20 MINUTE)"


def minutes(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 60000000.0)"


def with_bronze(body: str, *ctes: str) -> str:
    return with_gold(body, BRONZE_E, BRONZE_MIX_E, *ctes)


ORACLE["last_ingest"] = with_bronze("""
SELECT 'prices' AS "table", MAX(ingested_at) AS last_ingested_at FROM bp
UNION ALL SELECT 'mix', MAX(ingested_at) FROM bm""")

_gap = r2(minutes(AS_OF, "last"), 1)
ORACLE["freshness_status"] = with_bronze(f"""
SELECT 'last_ingest' AS "check",
       CASE WHEN last IS NULL THEN 'warning' WHEN {_gap} >= 60 THEN 'error' WHEN {_gap} >= 15 THEN 'warning'
            ELSE 'ok' END AS status,
       CASE WHEN last IS NULL THEN {q(S.MSG_FRESH_NONE)}
            WHEN {_gap} >= 15 THEN printf({q(S.MSG_FRESH_STALE)}, {_gap})
            ELSE printf({q(S.MSG_FRESH_OK)}, {_gap}) END AS message,
       {_gap} AS value, last AS last_ingested_at
FROM (SELECT MAX(ingested_at) AS last FROM bp) t""")


def _missed(table: str, src: str) -> str:
    gap = minutes(AS_OF, "last")
    ratio = f"({gap} / 5.0)"
    exp = f"CAST(CASE WHEN {ratio} >= 0 THEN floor({ratio}) ELSE ceil({ratio}) END AS BIGINT)"
    g1 = r2(gap, 1)
    return f"""SELECT '{table}' AS "table", last AS last_ingested_at, {g1} AS gap_minutes,
       CASE WHEN last IS NOT NULL THEN greatest({exp} - 1, 0) END AS missed_intervals,
       COALESCE({exp} > 1, FALSE) AS has_gap,
       CASE WHEN last IS NULL THEN {q(S.MSG_GAP_NONE)}
            WHEN {exp} > 1 THEN printf({q(S.MSG_GAP_FOUND)}, {exp} - 1, {g1})
            ELSE printf({q(S.MSG_GAP_OK)}, {g1}) END AS message
FROM (SELECT MAX(ingested_at) AS last FROM {src}) t"""


ORACLE["missed_intervals"] = with_bronze(_missed("prices", "bp") + "\nUNION ALL\n" + _missed("mix", "bm"))

LAYER_COUNTS = """lc AS (
  SELECT 0 AS position, 'bronze_prices' AS layer, COUNT(*) AS rows FROM bp
  UNION ALL SELECT 1, 'bronze_mix', COUNT(*) FROM bm
  UNION ALL SELECT 2, 'silver_prices', COUNT(*) FROM prices_e
  UNION ALL SELECT 3, 'silver_mix', COUNT(*) FROM mix_e
  UNION ALL SELECT 4, 'gold', COUNT(*) FROM gold)"""
ROW_STATUS = """rs AS (
  SELECT 'row_counts' AS "check",
         CASE WHEN COUNT(*) FILTER (WHERE rows = 0) > 0 THEN 'warning' ELSE 'ok' END AS status,
         CASE WHEN COUNT(*) FILTER (WHERE rows = 0) > 0
              THEN 'Empty layers: ' || string_agg(CASE WHEN rows = 0 THEN layer END, ', ' ORDER BY position)
              ELSE printf('All layers populated — %s: %d rows', 'gold', MAX(CASE WHEN layer = 'gold' THEN rows END))
         END AS message,
         CAST(MAX(CASE WHEN layer = 'gold' THEN rows END) AS DOUBLE) AS value
  FROM lc)"""
ORACLE["layer_row_counts"] = with_bronze("SELECT * FROM lc", LAYER_COUNTS)
ORACLE["row_count_status"] = with_bronze("SELECT * FROM rs", LAYER_COUNTS, ROW_STATUS)

_sp = r2(f"({minutes('latest', 'earliest')} / NULLIF(rows - 1, 0))", 1)
GAPS = f"""gaps AS (
  SELECT entity, rows, earliest, latest, {_sp} AS avg_interval_minutes,
         COALESCE({_sp} > 0 AND {_sp} > 10.0, FALSE) AS has_gap
  FROM (SELECT entity, COUNT(*) AS rows, MIN(window_start) AS earliest, MAX(window_start) AS latest
        FROM gold GROUP BY entity) t)"""
ORACLE["gap_by_entity"] = with_gold("SELECT * FROM gaps", GAPS)
ORACLE["date_ranges_by_category"] = w(PRICES_E) + """
SELECT entity, market, COUNT(*) AS rows, MIN(interval_start) AS earliest, MAX(interval_start) AS latest,
       CASE WHEN market = 'SYNTHETIC' THEN 'synthetic' ELSE 'real' END AS data_type
FROM prices_e GROUP BY entity, market ORDER BY entity, market"""
ORACLE["gold_date_ranges"] = with_gold("""
SELECT entity, COUNT(*) AS rows, MIN(window_start) AS earliest, MAX(window_start) AS latest
FROM gold GROUP BY entity ORDER BY entity""")

FRESH = f"""fr AS (
  SELECT 'last_ingest' AS "check",
         CASE WHEN last IS NULL THEN 'warning' WHEN {_gap} >= 60 THEN 'error' WHEN {_gap} >= 15 THEN 'warning'
              ELSE 'ok' END AS status,
         CASE WHEN last IS NULL THEN {q(S.MSG_FRESH_NONE)}
              WHEN {_gap} >= 15 THEN printf({q(S.MSG_FRESH_STALE)}, {_gap})
              ELSE printf({q(S.MSG_FRESH_OK)}, {_gap}) END AS message,
         {_gap} AS value
  FROM (SELECT MAX(ingested_at) AS last FROM bp) t)"""
GAP_STATUS = """gs AS (
  SELECT 'data_gap' AS "check",
         CASE WHEN COUNT(*) = 0 OR COUNT(*) FILTER (WHERE has_gap) > 0 THEN 'warning' ELSE 'ok' END AS status,
         CASE WHEN COUNT(*) = 0 THEN 'No gold data available for gap analysis'
              WHEN COUNT(*) FILTER (WHERE has_gap) > 0 THEN printf('%d entities with gaps', COUNT(*) FILTER (WHERE has_gap))
              ELSE 'No significant data gaps detected' END AS message,
         CAST(COUNT(*) FILTER (WHERE has_gap) AS DOUBLE) AS value
  FROM gaps)"""
_texts = " + ".join(f"COALESCE(strlen({c}), 0)" for c in ("entity", "location", "location_type", "market"))
_values = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 8 END"
                     for c in ("interval_start", "interval_end", "price", "ingested_at"))
_gb, _mb = r2("(size_bytes / 1073741824.0)"), r2("(size_bytes / 1048576.0)", 1)
SIZE = f"""sz AS (
  SELECT 'dataset_size' AS "check",
         CASE WHEN {_gb} >= 2.0 THEN 'error' WHEN {_gb} >= 1.0 THEN 'warning' ELSE 'ok' END AS status,
         CASE WHEN {_gb} >= 2.0 THEN printf({q(S.MSG_SIZE_ERROR)}, {_gb})
              WHEN {_gb} >= 1.0 THEN printf({q(S.MSG_SIZE_WARNING)}, {_gb})
              ELSE printf({q(S.MSG_SIZE_OK)}, {_mb}) END AS message,
         {_mb} AS value, size_bytes
  FROM (SELECT CAST(COALESCE(SUM({_texts} + {_values}), 0) AS BIGINT) AS size_bytes FROM bp) t)"""
ORACLE["logical_size_status"] = with_bronze("SELECT * FROM sz", SIZE)
REPORT = """report AS (
  SELECT * FROM fr UNION ALL SELECT * FROM rs UNION ALL SELECT * FROM gs
  UNION ALL SELECT "check", status, message, value FROM sz
  UNION ALL SELECT 'schema', 'ok', 'All expected columns present', 8.0 FROM (SELECT COUNT(*) FROM gold) t)"""
_HEALTH = (LAYER_COUNTS, ROW_STATUS, GAPS, FRESH, GAP_STATUS, SIZE, REPORT)
ORACLE["health_report"] = with_bronze("SELECT * FROM report", *_HEALTH)
ORACLE["health_rollup"] = with_bronze("""
SELECT COUNT(*) AS checks,
       COUNT(*) FILTER (WHERE status = 'error') AS errors,
       COUNT(*) FILTER (WHERE status = 'warning') AS warnings,
       CASE WHEN COUNT(*) FILTER (WHERE status = 'error') > 0 THEN 'error'
            WHEN COUNT(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS overall,
       CASE WHEN COUNT(*) FILTER (WHERE status = 'error') > 0
              THEN array_to_string(list_sort(list_distinct(list(domain) FILTER (WHERE status = 'error'))), ', ')
            WHEN COUNT(*) FILTER (WHERE status = 'warning') > 0
              THEN array_to_string(list_sort(list_distinct(list(domain) FILTER (WHERE status = 'warning'))), ', ')
            ELSE '' END AS domains
FROM (SELECT r.*, COALESCE(d.domain, r."check") AS domain FROM report r LEFT JOIN dom d ON r."check" = d."check") t""",
    *_HEALTH, """dom AS (SELECT * FROM (VALUES ('connectivity', 'System'), ('dataset_size', 'Storage'),
      ('schema', 'System'), ('last_ingest', 'Data Freshness'), ('row_counts', 'Data Quality'),
      ('data_gap', 'Data Quality')) v("check", domain))""")
ORACLE["entity_coverage"] = with_bronze("""
SELECT COALESCE(c.entity, o.entity) AS entity, c.entity IS NOT NULL AS configured, o.entity IS NOT NULL AS observed,
       CASE WHEN c.entity IS NOT NULL AND o.entity IS NOT NULL THEN 'active'
            WHEN c.entity IS NOT NULL THEN 'not observed' ELSE 'not configured' END AS status
FROM (SELECT * FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup')) v(entity)) c
FULL OUTER JOIN (SELECT DISTINCT entity FROM bp WHERE entity IS NOT NULL) o ON c.entity = o.entity""")

# --- retention (binding E) -------------------------------------------------------------
MEDIAN = """med AS (
  SELECT COUNT(ingested_at) AS n, CAST(COUNT(ingested_at) / 2 AS BIGINT) AS k,
         (SELECT ingested_at FROM bp WHERE ingested_at IS NOT NULL ORDER BY ingested_at
          LIMIT 1 OFFSET (SELECT COUNT(ingested_at) / 2 FROM bp)) AS cutoff
  FROM bp)"""
ORACLE["retention_by_age"] = with_bronze(f"SELECT * FROM bp WHERE ingested_at >= {AS_OF} - INTERVAL 10 DAY")
ORACLE["median_cutoff"] = with_bronze("SELECT * FROM med", MEDIAN)
ORACLE["archive_export"] = with_bronze("SELECT * FROM bp WHERE ingested_at < (SELECT cutoff FROM med)", MEDIAN)
ORACLE["archive_contents"] = with_bronze("""
SELECT CAST(ingested_at AS DATE) AS archived_date, COUNT(*) AS rows, MIN(ingested_at) AS earliest, MAX(ingested_at) AS latest
FROM bp WHERE ingested_at < (SELECT cutoff FROM med) GROUP BY 1 ORDER BY 1 DESC""", MEDIAN)
ORACLE["archive_split"] = with_bronze("""
SELECT COUNT(*) FILTER (WHERE ingested_at < (SELECT cutoff FROM med)) AS archived,
       COUNT(*) FILTER (WHERE ingested_at >= (SELECT cutoff FROM med)) AS kept,
       COUNT(*) AS total FROM bp""", MEDIAN)
ORACLE["retention_by_size"] = with_bronze("""
SELECT CAST(5.5 AS DOUBLE) AS size_gb, 'aged off' AS action, (SELECT cutoff FROM med) AS cutoff,
       p.archived_prices, p.kept_prices, m.archived_mix, m.kept_mix
FROM (SELECT COUNT(*) FILTER (WHERE ingested_at < (SELECT cutoff FROM med)) AS archived_prices,
             COUNT(*) FILTER (WHERE ingested_at >= (SELECT cutoff FROM med)) AS kept_prices FROM bp) p,
     (SELECT COUNT(*) FILTER (WHERE ingested_at < (SELECT cutoff FROM med)) AS archived_mix,
             COUNT(*) FILTER (WHERE ingested_at >= (SELECT cutoff FROM med)) AS kept_mix FROM bm) m""", MEDIAN)

ORACLE["retention_by_size_stored"] = with_bronze("""
SELECT 'aged off' AS action, p.archived_prices, p.kept_prices, m.archived_mix, m.kept_mix
FROM (SELECT COUNT(*) FILTER (WHERE ingested_at < (SELECT cutoff FROM med)) AS archived_prices,
             COUNT(*) FILTER (WHERE ingested_at >= (SELECT cutoff FROM med)) AS kept_prices FROM bp) p,
     (SELECT COUNT(*) FILTER (WHERE ingested_at < (SELECT cutoff FROM med)) AS archived_mix,
             COUNT(*) FILTER (WHERE ingested_at >= (SELECT cutoff FROM med)) AS kept_mix FROM bm) m""", MEDIAN)
ORACLE["medallion_stored"] = w(
    PRICES_E, "silver_e AS (SELECT DISTINCT * FROM prices_e WHERE price IS NOT NULL AND interval_start IS NOT NULL)",
    hourly_prices_sql("silver_e"), RAW_MIX_E, MIX_E, hourly_mix_sql("mix_e", E_COMPONENTS)) + (
    gold_select("hp", "hm", E_COMPONENTS))

# --- streaming ------------------------------------------------------------------------
# A stream emits an hour once the watermark (max event time seen, no delay)
# passes its end; with two inputs the watermark is the smaller of the two.
_HOURLY_CLOSED = f"""
SELECT entity, window_start, window_start + INTERVAL 1 HOUR AS window_end, avg_price, max_price, min_price
FROM hp WHERE window_start + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events)"""
ORACLE["stream_gold"] = w(PRICES_E, hourly_prices_sql("prices_e")) + _HOURLY_CLOSED
ORACLE["stream_late_rows"] = ORACLE["stream_gold"]
ORACLE["stream_dedup"] = w(raw_x(), norm_x(), raw_x(until="2024-01-16 00:00:00", name="rx1"), norm_x("rx1", "nx1")) + """
SELECT DISTINCT * FROM (SELECT * FROM norm_x UNION ALL SELECT * REPLACE ('CORRECTED' AS market) FROM nx1) u
WHERE entity IS NOT NULL AND interval_start IS NOT NULL AND price IS NOT NULL"""
ORACLE["stream_gold_join"] = with_gold(f"""
SELECT entity, window_start, window_end, avg_price, max_price, min_price, share_pct, {", ".join(E_COMPONENTS)}
FROM gold
WHERE window_end <= least((SELECT MAX(ts) FROM events), (SELECT MAX(time) FROM raw_mix_e))""")
ORACLE["stream_medallion"] = w(
    raw_x(until="2024-01-16 00:00:00", name="rx1"), norm_x("rx1", "nx1"), gated_new_prices("nx1", "s1"),
    raw_x(since="2024-01-15 00:00:00", name="rx2"), norm_x("rx2", "nx2"), gated_new_prices("nx2", "s2"),
    """s2new AS (
  SELECT * FROM s2 WHERE NOT EXISTS (
    SELECT 1 FROM s1 WHERE s1.entity = s2.entity AND s1.interval_start = s2.interval_start
      AND COALESCE(s1.location, '') = COALESCE(s2.location, '')))""",
    RAW_MIX_E, MIX_E, hourly_mix_sql("mix_e", E_COMPONENTS),
    hourly_prices_sql("s1", "hp1"),
    f"g1 AS ({gold_select('hp1', 'hm', E_COMPONENTS)})",
    """fresh2 AS (
  SELECT * FROM s2new s WHERE NOT EXISTS (
    SELECT 1 FROM g1 WHERE g1.entity = s.entity AND g1.window_start = date_trunc('hour', s.interval_start)))""",
    hourly_prices_sql("fresh2", "hp2"),
    f"g2 AS ({gold_select('hp2', 'hm', E_COMPONENTS)})") + "SELECT * FROM g1 UNION ALL SELECT * FROM g2"

# --- landed-file sources ---------------------------------------------------------------
ORACLE["history_range_scan"] = w(PRICES_E) + """
SELECT * FROM prices_e
WHERE interval_start BETWEEN TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-30 00:00:00'"""
ORACLE["land_prices_json"] = ORACLE["land_prices"]
ORACLE["land_mix_csv"] = ORACLE["land_mix"]
ORACLE["gold_summary_sql"] = ORACLE["gold_summary"]

ORACLE["stream_two_feeds"] = w(
    raw_x(until="2024-01-16 00:00:00", name="rx1"), norm_x("rx1", "nx1"), gated_new_prices("nx1", "s1"),
    raw_x(since="2024-01-15 00:00:00", name="rx2"), norm_x("rx2", "nx2"), gated_new_prices("nx2", "s2"),
    """s2new AS (
  SELECT * FROM s2 WHERE NOT EXISTS (
    SELECT 1 FROM s1 WHERE s1.entity = s2.entity AND s1.interval_start = s2.interval_start
      AND COALESCE(s1.location, '') = COALESCE(s2.location, '')))""",
    RAW_MIX_E,
    raw_mix_x(until="2024-01-16 00:00:00", name="rm1"), norm_mix_x("rm1", "nm1"), gated_new_mix("nm1", "m1"),
    raw_mix_x(since="2024-01-15 00:00:00", name="rm2"), norm_mix_x("rm2", "nm2"), gated_new_mix("nm2", "m2"),
    """m2new AS (SELECT * FROM m2 WHERE NOT EXISTS (
  SELECT 1 FROM m1 WHERE m1.entity = m2.entity AND m1.time = m2.time))""",
    "silver_mix_all AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2new)",
    hourly_mix_sql("silver_mix_all", FUELS),
    hourly_prices_sql("s1", "hp1"),
    f"g1 AS ({gold_select('hp1', 'hm', FUELS)})",
    """fresh2 AS (
  SELECT * FROM s2new s WHERE NOT EXISTS (
    SELECT 1 FROM g1 WHERE g1.entity = s.entity AND g1.window_start = date_trunc('hour', s.interval_start)))""",
    hourly_prices_sql("fresh2", "hp2"),
    f"g2 AS ({gold_select('hp2', 'hm', FUELS)})") + "SELECT * FROM g1 UNION ALL SELECT * FROM g2"

ORACLE["evolve_schema_files"] = ORACLE["evolve_schema"]
ORACLE["retention_rewrite"] = ORACLE["retention_by_age"]

# --- retention in place, archive manifest -------------------------------------------------------
_UNDATED = ("up AS (SELECT CASE WHEN second(interval_start) <> 7 THEN ingested_at END AS t FROM bp)",
            "um AS (SELECT CASE WHEN hour(time) <> 5 THEN ingested_at END AS t FROM bm)",
            "cut AS (SELECT MAX(t) + INTERVAL 20 MINUTE - INTERVAL 10 DAY AS c FROM up)")
ORACLE["retention_by_age_both"] = with_bronze(" UNION ALL ".join(f"""
SELECT '{feed}' AS feed, COUNT(*) FILTER (WHERE t < c) AS removed, COUNT(*) FILTER (WHERE t IS NULL OR t >= c) AS kept,
       COUNT(*) FILTER (WHERE t IS NULL) AS undated, MIN(t) FILTER (WHERE t >= c) AS earliest,
       CAST(bool_or(t < c AND CAST(t AS DATE) = CAST(c AS DATE))
            AND bool_or(t >= c AND CAST(t AS DATE) = CAST(c AS DATE)) AS BIGINT) AS rewritten_partitions
FROM {src}, cut GROUP BY c""" for feed, src in (("prices", "up"), ("mix", "um"))), *_UNDATED)
ORACLE["archive_manifest"] = with_bronze("""
SELECT CAST(ingested_at AS DATE) AS archived_date, COUNT(*) AS rows, MIN(ingested_at) AS earliest, MAX(ingested_at) AS latest,
       CASE WHEN ingested_at < TIMESTAMP '2024-01-05 00:00:00' THEN TIMESTAMP '2024-02-01 00:00:00'
            ELSE TIMESTAMP '2024-02-02 00:00:00' END AS exported_at
FROM bp WHERE ingested_at < (SELECT cutoff FROM med) GROUP BY 1, 5""", MEDIAN)

# --- statistics of gold from daily summaries: below SKETCH_K values a sketch's quantiles are exact ----
_QD = """qd AS (
  SELECT entity, COUNT(avg_price) AS n, quantile_disc(avg_price, 0.25) AS q1, quantile_disc(avg_price, 0.5) AS median,
         quantile_disc(avg_price, 0.75) AS q3 FROM gold WHERE avg_price IS NOT NULL GROUP BY entity)"""
ORACLE["anomaly_baseline_incremental"] = with_gold(f"""
SELECT m.entity, m.n, {r6("m.mean")} AS mean, {r6("m.std")} AS std, q.q1 AS q25, q.q3 AS q75,
       {r6("q.q3 - q.q1")} AS spread, m.n >= 5 AS has_baseline
FROM (SELECT entity, COUNT(avg_price) AS n, {xmean("avg_price")} AS mean, {xstd("avg_price")} AS std
      FROM gold WHERE avg_price IS NOT NULL GROUP BY entity) m JOIN qd q ON m.entity = q.entity""", _QD)
ORACLE["box_stats_incremental"] = with_gold(f"""
SELECT f.entity, f.n, f.q1, f.median, f.q3, {r6("f.lo")} AS lower_fence, {r6("f.hi")} AS upper_fence, f.low, f.high,
       f.low < f.lo OR f.high > f.hi AS has_outliers
FROM (SELECT q.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, e.low, e.high FROM qd q
      JOIN (SELECT entity, MIN(avg_price) AS low, MAX(avg_price) AS high FROM gold GROUP BY entity) e ON q.entity = e.entity) f""", _QD)
ORACLE["anomaly_scores_incremental"] = with_gold(
    "SELECT entity, status, current_price, z_score, reason, n FROM scores", *ANOMALY_CTES)

# --- streams with every row accounted for ---------------------------------------------------------
_LEDGER = ("""b1 AS (SELECT * FROM prices_e WHERE interval_start < TIMESTAMP '2024-01-16 12:30:00'),
closed AS (SELECT * FROM prices_e WHERE interval_start >= TIMESTAMP '2024-01-15 00:00:00' AND interval_start < TIMESTAMP '2024-01-16 00:00:00'),
b2 AS (SELECT * FROM prices_e WHERE interval_start >= TIMESTAMP '2024-01-16 12:30:00'
  UNION ALL SELECT * FROM closed
  UNION ALL SELECT * FROM prices_e WHERE interval_start >= TIMESTAMP '2024-01-16 11:45:00' AND interval_start < TIMESTAMP '2024-01-16 12:30:00'
  UNION ALL SELECT * REPLACE (CAST(NULL AS TIMESTAMP) AS interval_start) FROM closed),
w1 AS (SELECT MAX(interval_start) - INTERVAL 2 HOUR AS w FROM b1),
w2 AS (SELECT MAX(interval_start) - INTERVAL 2 HOUR AS w FROM prices_e),
marked AS (
  SELECT *, NULL AS late_reason FROM b1
  UNION ALL SELECT b2.*, CASE WHEN interval_start IS NULL THEN 'no time'
    WHEN date_trunc('hour', interval_start) + INTERVAL 1 HOUR <= w THEN 'closed hour' END FROM b2, w1),
placed AS (SELECT marked.*, late_reason IS NULL AND date_trunc('hour', interval_start) + INTERVAL 1 HOUR <= w AS emitted FROM marked, w2)""",)
ORACLE["stream_row_accounts"] = w(PRICES_E, *_LEDGER) + """
SELECT entity, COUNT(*) AS landed, COUNT(*) FILTER (WHERE emitted) AS emitted, COUNT(late_reason) AS late,
       COUNT(*) FILTER (WHERE late_reason IS NULL AND NOT emitted) AS open FROM placed GROUP BY entity"""
ORACLE["stream_late_table"] = w(PRICES_E, *_LEDGER) + """
SELECT entity, interval_start, location, location_type, price, market, late_reason FROM placed WHERE late_reason IS NOT NULL"""
ORACLE["stream_ledger_gold"] = w(PRICES_E, *_LEDGER, "on_time AS (SELECT * FROM placed WHERE emitted)",
                                 hourly_prices_sql("on_time", "hp")) + """
SELECT hp.entity, hp.window_start, hp.window_start + INTERVAL 1 HOUR AS window_end, avg_price, max_price, min_price, rows
FROM hp JOIN (SELECT entity, date_trunc('hour', interval_start) AS window_start, COUNT(*) AS rows FROM on_time GROUP BY 1, 2) c
  ON hp.entity = c.entity AND hp.window_start = c.window_start"""


def _held_back(batch: str, gate: str) -> str:
    return (f"(SELECT COUNT(*) FROM {batch} b WHERE entity IS NULL OR EXISTS "
            f"(SELECT 1 FROM {gate}_nc c WHERE c.entity = b.entity AND c.bad > 0))")


ORACLE["stream_feed_accounts"] = w(
    raw_x(until="2024-01-16 00:00:00", name="rx1"), norm_x("rx1", "nx1"), gated_new_prices("nx1", "s1"),
    raw_x(since="2024-01-15 00:00:00", name="rx2"), norm_x("rx2", "nx2"), gated_new_prices("nx2", "s2"),
    """s2new AS (
  SELECT * FROM s2 WHERE NOT EXISTS (
    SELECT 1 FROM s1 WHERE s1.entity = s2.entity AND s1.interval_start = s2.interval_start
      AND COALESCE(s1.location, '') = COALESCE(s2.location, '')))""",
    RAW_MIX_E,
    raw_mix_x(until="2024-01-16 00:00:00", name="rm1"), norm_mix_x("rm1", "nm1"), gated_new_mix("nm1", "m1"),
    raw_mix_x(since="2024-01-15 00:00:00", name="rm2"), norm_mix_x("rm2", "nm2"), gated_new_mix("nm2", "m2"),
    """m2new AS (SELECT * FROM m2 WHERE NOT EXISTS (
  SELECT 1 FROM m1 WHERE m1.entity = m2.entity AND m1.time = m2.time))""") + " UNION ALL ".join(f"""
SELECT '{feed}' AS feed, (SELECT COUNT(*) FROM {r}1) + (SELECT COUNT(*) FROM {r}2) AS landing,
       (SELECT COUNT(*) FROM {r}1) + (SELECT COUNT(*) FROM {r}2) AS bronze,
       {_held_back(n + "1", g + "1")} + {_held_back(n + "2", g + "2")} AS quarantine,
       (SELECT COUNT(*) FROM {g}1) + (SELECT COUNT(*) FROM {g}2new) AS silver"""
    for feed, r, n, g in (("prices", "rx", "nx", "s"), ("mix", "rm", "nm", "m")))

# --- landing with a bad source, layers as a whole, any time zone, counted failures ---------------
ORACLE["land_isolated"] = w(PRICES_E) + """
SELECT entity AS source, CAST(1 AS BIGINT) AS files, CAST(1 AS BIGINT) AS files_read, 0 AS files_skipped, COUNT(*) AS rows,
       MIN(interval_start) AS earliest, MAX(interval_start) AS latest FROM prices_e GROUP BY entity
UNION ALL SELECT 'broken', 1, 0, 1, 0, NULL, NULL"""
_TABLES = """tc AS (
  SELECT 'bronze' AS layer, 'prices' AS "table", COUNT(*) AS rows FROM bp UNION ALL SELECT 'bronze', 'mix', COUNT(*) FROM bm
  UNION ALL SELECT 'silver', 'prices', COUNT(*) FROM prices_e UNION ALL SELECT 'silver', 'mix', COUNT(*) FROM mix_e
  UNION ALL SELECT 'gold', 'summary', COUNT(*) FROM gold)"""
ORACLE["layer_row_totals"] = with_bronze(
    'SELECT layer, "table", CAST(SUM(rows) AS BIGINT) AS rows FROM tc GROUP BY ROLLUP (layer, "table")', _TABLES)
ORACLE["layer_status"] = with_bronze("""
SELECT 'row_counts' AS "check", 'warning' AS status, 'Empty layers: platinum' AS message,
       CAST((SELECT COUNT(*) FROM gold) AS DOUBLE) AS value""")
_ANY_ZONES = """clock AS (
  SELECT * FROM (VALUES ('click', 'Australia/Adelaide', 630, 'ACDT'), ('click', 'Australia/Adelaide', 570, 'ACST'),
    ('purchase', 'America/St_Johns', -210, 'NST'), ('purchase', 'America/St_Johns', -150, 'NDT'),
    ('signup', 'Asia/Kolkata', 330, 'IST'), ('view', 'Europe/Lisbon', 0, 'WET'), ('view', 'Europe/Lisbon', 60, 'WEST'))
    v(entity, tz, off, abbr)),
moved AS (SELECT entity, window_end + to_days(CAST(30 * k AS INTEGER)) AS window_end FROM gold, range(12) r(k)
  WHERE window_start = (SELECT MAX(window_start) FROM gold)),
zoned AS (SELECT m.entity, m.window_end, COALESCE(z.tz, 'UTC') AS tz, z.tz AS known,
    timezone(COALESCE(z.tz, 'UTC'), (m.window_end - INTERVAL 48 HOUR) AT TIME ZONE 'UTC') AS local_start,
    timezone(COALESCE(z.tz, 'UTC'), m.window_end AT TIME ZONE 'UTC') AS local_end
  FROM moved m LEFT JOIN (SELECT DISTINCT entity, tz FROM clock) z ON m.entity = z.entity)"""
ORACLE["local_window_any_zone"] = with_gold(f"""
SELECT z.entity, z.window_end, z.tz, z.local_start, z.local_end, CASE WHEN known IS NULL THEN 'UTC' ELSE c.abbr END AS zone_abbr,
       {q(S.WINDOW_LABEL_PREFIX)} || strftime(local_start, '%b %d %I:%M%p') || ' to ' || strftime(local_end, '%b %d %I:%M%p')
         || ' ' || CASE WHEN known IS NULL THEN 'UTC' ELSE c.abbr END AS label
FROM zoned z LEFT JOIN clock c ON c.entity = z.entity AND CAST(c.off AS BIGINT) * 60000000 = epoch_us(z.local_end) - epoch_us(z.window_end)""", _ANY_ZONES)
_MIX_NAMES = {"natural_gas": "Natural Gas", "wind": "Wind", "solar": "Solar", "coal": "Coal", "nuclear": "Nuclear", "other": "Other"}
ORACLE["normalize_failures"] = w(raw_x(), RAW_MIX_E, raw_mix_x(), """rt AS (
  SELECT COALESCE("Interval Start", CAST(time AS VARCHAR)) AS t, "LMP" AS p FROM raw_x)""") + f"""
SELECT 'prices' AS feed, 'interval_start' AS "column", COUNT(*) FILTER (WHERE t IS NOT NULL AND TRY_CAST(t AS TIMESTAMP) IS NULL) AS failures,
       COUNT(*) AS rows FROM rt
UNION ALL SELECT 'prices', 'price', COUNT(*) FILTER (WHERE p IS NOT NULL AND NOT regexp_matches(p, '{_num}')), COUNT(*) FROM rt
UNION ALL SELECT 'mix', 'time', 0, COUNT(*) FROM raw_mix_x
""" + "".join(f"""UNION ALL SELECT 'mix', '{c}', COUNT(*) FILTER (WHERE CAST("{n}" AS VARCHAR) IS NOT NULL
  AND NOT regexp_matches(CAST("{n}" AS VARCHAR), '{_num}')), COUNT(*) FROM raw_mix_x
""" for c, n in _MIX_NAMES.items())
