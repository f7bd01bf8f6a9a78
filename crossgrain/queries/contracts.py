"""Queries A1 to A26."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.functions.columns import rank_percentile
from crossgrain.operators import contracts as O
from crossgrain.operators.calendar import calendar_index
from crossgrain.operators.labels import eligible_sample
from crossgrain.queries import labels as L
from crossgrain.queries.registry import query
from crossgrain.sources import proxy, scratch, tables

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
V = "check key detail"


def quoted(columns: str) -> str:
    return columns.replace("check", '"check"').replace("key", '"key"')


V = quoted(V)


@query("a1_scan_factor", "panel", "SELECT date, industry AS stock_code, max(post_close) AS factor_value FROM panel GROUP BY ALL HAVING max(post_close) IS NOT NULL", "date stock_code ~factor_value")
def _(spark, sf_dir):
    wide = proxy.panel(spark, sf_dir).groupBy("date").pivot("industry", REGIONS).agg(F.max("post_close"))
    return tables.scan_factor(wide)


@query("a1_factor_key_violations", "", "SELECT 'unique_keys' AS \"check\", date || '|' || stock_code AS \"key\", CAST(count(*) AS VARCHAR) AS detail FROM (SELECT CAST(l_shipdate AS DATE) AS date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock_code, try_cast(l_quantity AS DOUBLE) AS v FROM lineitem) WHERE v IS NOT NULL GROUP BY date, stock_code HAVING count(*) > 1", V)
def _(spark, sf_dir):
    # Codes that only differ before they are made uniform.
    code = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_suppkey").cast("string"), F.lit(".0"))).otherwise(F.col("l_suppkey").cast("string"))
    raw = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("date"), code.alias("stock_code"), F.col("l_quantity").alias("factor_value"))
    return O.check_unique_keys(tables.scan_factor(raw, unique=False))


RAW_CODE = "CASE l_suppkey % 4 WHEN 0 THEN CAST(l_suppkey AS {s}) WHEN 1 THEN ' ' || CAST(l_suppkey AS {s}) || '.0 ' WHEN 2 THEN 'S' || CAST(l_suppkey AS {s}) ELSE CAST(l_suppkey * 100003 AS {s}) || '.0' END"


@query("a2_normalize_stock_code", "", f"""SELECT CASE WHEN regexp_matches(c, '^[0-9]{{1,6}}$') THEN lpad(c, 6, '0') ELSE c END AS stock_code, count(*) AS n
  FROM (SELECT regexp_replace(trim({RAW_CODE.format(s='VARCHAR')}), '\\.0$', '') AS c FROM lineitem) GROUP BY 1""", "stock_code n")
def _(spark, sf_dir):
    raw = proxy.table(spark, sf_dir, "lineitem").select(F.expr(RAW_CODE.format(s="string")).alias("c"))
    return raw.groupBy(tables.normalize_stock_code("c").alias("stock_code")).agg(F.count(F.lit(1)).alias("n"))


@query("a3_normalize_keys", "", "SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS stock_code, count(*) AS n FROM orders GROUP BY 1, 2", "date stock_code n")
def _(spark, sf_dir):
    o = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date"), F.expr("CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE ' ' || o_custkey || '  ' END").alias("stock_code"))
    return tables.normalize_keys(o).groupBy("date", "stock_code").agg(F.count(F.lit(1)).alias("n"))


RAW_BOOL = "CASE l_linenumber % 8 WHEN 0 THEN ' Yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0' WHEN 3 THEN 'n ' WHEN 4 THEN 'T' WHEN 5 THEN NULL WHEN 6 THEN 'maybe' ELSE 'No' END"


@query("a4_parse_bool", "", f"""SELECT raw, CASE WHEN lower(trim(raw)) IN ('true', '1', 'yes', 'y') THEN TRUE WHEN lower(trim(raw)) IN ('false', '0', 'no', 'n') THEN FALSE END AS strict,
  CASE WHEN lower(trim(raw)) IN ('true', '1', 'yes', 'y', 't') THEN TRUE WHEN lower(trim(raw)) IN ('false', '0', 'no', 'n', 'f') THEN FALSE END AS model, count(*) AS n FROM (SELECT {RAW_BOOL} AS raw FROM lineitem) GROUP BY ALL""", "raw strict model n")
def _(spark, sf_dir):
    raw = proxy.table(spark, sf_dir, "lineitem").select(F.expr(RAW_BOOL).alias("raw"))
    return raw.groupBy("raw", tables.parse_bool("raw").alias("strict"), tables.parse_bool("raw", model=True).alias("model")).agg(F.count(F.lit(1)).alias("n"))


RAW_NUMBER = "CASE l_linenumber % 5 WHEN 0 THEN 'x1' WHEN 1 THEN 'Infinity' WHEN 2 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS {s}) END"


@query("a5_coerce_numeric", "", f"SELECT raw, CASE WHEN isfinite(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE) END AS number, raw IS NOT NULL AND try_cast(raw AS DOUBLE) IS NULL AS violates, count(*) AS n FROM (SELECT {RAW_NUMBER.format(s='VARCHAR')} AS raw FROM lineitem) GROUP BY ALL", "raw ~number violates n")
def _(spark, sf_dir):
    raw = proxy.table(spark, sf_dir, "lineitem").select(F.expr(RAW_NUMBER.format(s="string")).alias("raw"))
    bad = tables.numeric_violations(raw, "raw").select(F.col("value").alias("raw"), F.lit(True).alias("violates"))
    counts = raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(bad, "raw", "left").select("raw", tables.coerce_numeric("raw").alias("number"), F.coalesce("violates", F.lit(False)).alias("violates"), "n")


PANEL = [f.name for f in tables.PANEL_SCHEMA]
PANEL_OUT = "date stock_code in_universe is_st is_suspended ~post_close ~raw_open ~raw_close ~limit_up ~limit_down ~listing_days ~market_cap industry"


@query("a6_scan_market_panel", "panel", "SELECT * FROM panel", PANEL_OUT)
def _(spark, sf_dir):
    path = scratch.new_path(spark, "panel")
    as_text = proxy.panel(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in PANEL])
    as_text.write.option("header", True).csv(path)
    return tables.scan_market_panel(spark, path, "csv")


@query("a7_scan_window", "", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01'", "l_orderkey l_linenumber l_suppkey ~l_quantity")
def _(spark, sf_dir):
    return tables.scan_window(proxy.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"], "l_shipdate", "1997-01-01", "1997-03-31")


@query("a8_resolve_vendor_columns", "prices", "SELECT date, CASE WHEN pos % 3 <> 0 THEN stock_code || '.XSHG' END AS stock_code, close FROM prices", "date stock_code ~close")
def _(spark, sf_dir):
    p = proxy.prices(spark, sf_dir)
    # A note that no row has, and codes that some rows lack.
    code = F.when(F.col("pos") % 3 != 0, F.concat("stock_code", F.lit(".XSHG")))
    return tables.resolve_vendor_columns(p.select(F.col("date").alias("day"), F.lit(None).cast("string").alias("note"), code.alias("id"), F.col("close").alias("close"))).drop("note")


@query("a9_unpivot_matrix", "panel", "SELECT date, industry AS stock_code, bool_or(CASE WHEN k % 3 = 0 THEN is_st END) AS is_st FROM panel GROUP BY ALL", "date stock_code is_st")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    wide = p.groupBy("date").pivot("industry", REGIONS).agg(F.max(F.when(F.col("k") % 3 == 0, F.col("is_st"))))
    return tables.unpivot_matrix(wide, "is_st")


@query("a10_sink_table", "prices", "SELECT date, stock_code, close, CAST(year(date) AS INTEGER) AS year FROM prices", "date stock_code ~close year")
def _(spark, sf_dir):
    path = scratch.new_path(spark, "sink")
    tables.sink_table(proxy.prices(spark, sf_dir).select("date", "stock_code", "close"), path, partition="date")
    return spark.read.parquet(path)


def digest(columns: str, kinds: str) -> str:
    """The fingerprint in SQL, of rows of texts; kinds: names and types as the schema's hash has them."""
    row = " || ".join(f"coalesce(strlen({c}) || ':' || {c}, 'n')" for c in columns.split())
    sums = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {at}, 15)) AS BIGINT)) AS VARCHAR) AS digest_{n}" for at, n in ((1, "a"), (17, "b")))
    named = "".join(f"{len(x)}:{x}" for x in kinds.split())
    return f"SELECT md5('{named}') AS schema, count(*) AS rows, {sums} FROM (SELECT md5({row}) AS h FROM t)"


@query("a11_table_fingerprint", "", "WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b, o_orderstatus AS c, o_orderpriority AS d FROM orders) " + digest("a b c d", "o_orderkey bigint o_custkey bigint o_orderstatus string o_orderpriority string"), "schema rows digest_a digest_b")
def _(spark, sf_dir):
    return O.table_fingerprint(proxy.table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("a11_label_fingerprint", "ranked", "SELECT * FROM (WITH t AS (SELECT CAST(date AS VARCHAR) AS a, stock_code AS b, CAST(CAST(round(rank_target_10d * 1000000) AS BIGINT) AS VARCHAR) AS c FROM ranked) " + digest("a b c", "date date stock_code string millionths bigint") + ")", "schema rows digest_a digest_b")
def _(spark, sf_dir):
    r = L.ranked(proxy.panel(spark, sf_dir)).withColumn("millionths", F.round(F.col("rank_target_10d") * 1000000).cast("long"))
    return O.label_fingerprint(r, ["millionths"])


#: Columns that a panel gets besides its own, and whether each may be a feature.
EXTRA = {
    "rank_target_10d": False, "market_target_10d": False, "industry_target_10d": False, "alpha_target_10d": False, "TARGET_5d": False, "exit_date_10d": False, "split_x": False, "entry_tradeable": False, "entry_open": False, "future_x": False, "next_open": False,
    "ret_t+1": False, "vol_t_plus_2": False, "status_t_2": False, "status_t03": False, "status_tplus1": False, "st_status": True, "status_t0": True, "ret_t1": True, "rank_target": True, "my_target_10d": True, "exits": True,
}


@query("a12_schema_contract", "panel", "SELECT 'required' AS \"check\", 'post_low' AS \"key\", 'missing' AS detail FROM (SELECT 1 FROM panel LIMIT 1) UNION ALL SELECT 'feature', unnest([" + ", ".join(f"'{c}'" for c in ["date", "stock_code", *[c for c, ok in EXTRA.items() if not ok]]) + "]), 'forbidden' FROM (SELECT 1 FROM panel LIMIT 1)", V)
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return O.schema_contract(p.select("*", *[F.lit(None).cast("double").alias(c) for c in EXTRA]), ["post_close", "post_low"])


def stack(check: str, key: str, detail: str, rest: str) -> str:
    return f"SELECT '{check}' AS \"check\", CAST({key} AS VARCHAR) AS \"key\", CAST({detail} AS VARCHAR) AS detail {rest}"


@query("a13_check_unique_keys", "", stack("unique_keys", "l_orderkey || '|' || l_linenumber", "count(*)", "FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"), V)
def _(spark, sf_dir):
    return O.check_unique_keys(proxy.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a14_check_daily_size", "prices", stack("daily_size", "date", "count(*)", "FROM prices GROUP BY date HAVING count(*) <> 82"), V)
def _(spark, sf_dir):
    return O.check_daily_size(proxy.prices(spark, sf_dir), 82)


@query("a15_check_calendar_cover", "prices cal", stack("calendar_cover", "date", "'missing'", "FROM cal WHERE pos % 3 > 0 AND date NOT IN (SELECT date FROM prices WHERE pos % 5 > 0)") + " UNION ALL " + stack("calendar_cover", "date", "'unknown'", "FROM cal WHERE pos % 3 = 0 AND date IN (SELECT date FROM prices WHERE pos % 5 > 0)"), V)
def _(spark, sf_dir):
    p = proxy.prices(spark, sf_dir)
    return O.check_calendar_cover(p.where("pos % 5 > 0"), calendar_index(p).where("pos % 3 > 0"))


@query("a16_check_exact_key_match", "prices", stack("exact_key_match", "date || '|' || stock_code", "CASE WHEN k % 3 = 0 THEN 'only right' ELSE 'only left' END", "FROM prices WHERE (k % 3 > 0) <> (k % 4 > 0)"), V)
def _(spark, sf_dir):
    p = proxy.prices(spark, sf_dir)
    return O.check_exact_key_match(p.where("k % 3 > 0"), p.where("k % 4 > 0"))


WRONG = """CASE WHEN split IS NOT NULL AND NOT coalesce((split = 'train' AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AND x BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') OR (split = 'validation' AND date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND x BETWEEN DATE '1999-01-01' AND DATE '1999-12-31')
  OR (split = 'test' AND date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31' AND x BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'), FALSE) THEN 'outside period' WHEN split IS NOT NULL AND NOT coalesce(x - date BETWEEN 1 AND 31, FALSE) THEN 'exit distance'
  WHEN split IS NULL AND base_period IS NOT NULL AND target_5d IS NOT NULL AND coalesce(x <= CASE base_period WHEN 'train' THEN DATE '1998-12-31' WHEN 'validation' THEN DATE '1999-12-31' ELSE DATE '2001-12-31' END, FALSE) THEN 'unexplained' END"""


@query("a17_check_split_boundaries", "idx", stack("split_boundaries", "date || '|' || stock_code", "w", f"FROM (SELECT date, stock_code, {WRONG} AS w FROM (SELECT *, exit_date_5 AS x, CASE WHEN base_period = 'test' THEN split_10 ELSE base_period END AS split FROM idx)) WHERE w IS NOT NULL"), V)
def _(spark, sf_dir):
    index = L.index(proxy.panel(spark, sf_dir)).withColumn("split_5", F.when(F.col("base_period") == "test", F.col("split_10")).otherwise(F.col("base_period")))
    return O.check_split_boundaries(index, 5, L.PERIODS)


@query("a18_check_finite_features", "wide", " UNION ALL ".join(stack("finite_features", f"'{c}'", "n", f"FROM (SELECT count(*) FILTER (WHERE {c} IS NULL) AS n FROM wide) WHERE n > 0") for c in ("rev_1d", "rev_5d")) + " UNION ALL " + stack("finite_features", "'rev_9d'", "'missing'", ""), V)
def _(spark, sf_dir):
    return O.check_finite_features(L.wide(proxy.panel(spark, sf_dir)), ["rev_1d", "rev_5d", "rev_9d"])


@query("a19_check_return_rank_order", "ranked", stack("return_rank_order", "date || '|' || stock_code", "r", "FROM (SELECT *, lag(r) OVER (PARTITION BY date ORDER BY target_10d, r) AS b FROM (SELECT *, CAST(CASE WHEN CAST(substr(stock_code, 2) AS INTEGER) % 50 = 7 THEN 0 ELSE floor(rank_target_10d * 1000) END AS BIGINT) AS r FROM ranked)) WHERE r < b"), V)
def _(spark, sf_dir):
    r = L.ranked(proxy.panel(spark, sf_dir)).withColumn("r", F.expr("CAST(CASE WHEN CAST(substr(stock_code, 2) AS INT) % 50 = 7 THEN 0 ELSE floor(rank_target_10d * 1000) END AS BIGINT)"))
    return O.check_return_rank_order(r, "target_10d", "r")


@query("a20_data_quality_report", "eligible", """SELECT count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT stock_code) AS stocks, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE in_universe IS NULL OR NOT in_universe) AS outside_universe,
  count(*) FILTER (WHERE coalesce(entry_is_st, TRUE)) AS st, count(*) FILTER (WHERE coalesce(entry_is_suspended, TRUE)) AS suspended, count(*) FILTER (WHERE coalesce(entry_listing_days < 20, TRUE)) AS listed_too_short, count(*) FILTER (WHERE entry_raw_open IS NULL) AS no_open,
  count(*) FILTER (WHERE entry_raw_open >= entry_limit_up - 1e-10) AS at_limit_up, count(*) FILTER (WHERE entry_raw_open <= entry_limit_down + 1e-10) AS at_limit_down FROM eligible""", "rows dates stocks eligible outside_universe st suspended listed_too_short no_open at_limit_up at_limit_down")
def _(spark, sf_dir):
    p = proxy.panel(spark, sf_dir)
    return O.data_quality_report(eligible_sample(p, calendar_index(p), 20), 20)


@query("a21_label_coverage", "fwd", "SELECT date, count(*) AS total, count(t) AS valid, count(t) / count(*) AS coverage, count(*) FILTER (WHERE t IS NOT NULL AND m > 1) AS tied FROM (SELECT *, count(*) OVER (PARTITION BY date, t) AS m FROM (SELECT date, round(return_1, 1) AS t FROM fwd)) GROUP BY date", "date total valid ~coverage tied")
def _(spark, sf_dir):
    rows = L.O.forward_returns(proxy.panel(spark, sf_dir), (1,)).withColumn("t", F.round("return_1", 1))
    return O.label_coverage(rows, "t")


@query("a22_missing_feature_rates", "panel", "SELECT 'post_close' AS feature, avg(CASE WHEN post_close IS NULL THEN 1.0 ELSE 0.0 END) AS rate FROM panel UNION ALL SELECT 'limit_up', avg(CASE WHEN limit_up IS NULL THEN 1.0 ELSE 0.0 END) FROM panel UNION ALL SELECT '*', (avg(CASE WHEN post_close IS NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN limit_up IS NULL THEN 1.0 ELSE 0.0 END)) / 2 FROM panel", "feature ~rate")
def _(spark, sf_dir):
    from crossgrain.operators.cross_section import fill_missing_flags

    return O.missing_feature_rates(fill_missing_flags(proxy.panel(spark, sf_dir), ["post_close", "limit_up"]))


@query("a22_unknown_industry_rate", "panel", "SELECT avg(CASE WHEN industry IN ('ASIA', 'EUROPE') THEN 0.0 ELSE 1.0 END) AS unknown_industry_rate FROM panel", "~unknown_industry_rate")
def _(spark, sf_dir):
    return O.unknown_industry_rate(proxy.panel(spark, sf_dir), ["ASIA", "EUROPE"])


@query("a23_common_as_of", "", "SELECT *, (min(as_of) OVER () = max(as_of) OVER ()) AS agrees FROM (SELECT 'orders' AS source, CAST(max(o_orderdate) AS DATE) AS as_of FROM orders UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS DATE) FROM lineitem)", "source as_of agrees")
def _(spark, sf_dir):
    o = proxy.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return O.common_as_of({"orders": o, "lineitem": proxy.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))})


@query("a24_doctor", "prices cal", stack("daily_size", "date", "count(*)", "FROM prices GROUP BY date HAVING count(*) <> 82") + " UNION ALL " + stack("calendar_cover", "date", "'missing'", "FROM cal WHERE date NOT IN (SELECT date FROM prices WHERE pos % 5 > 0)"), V)
def _(spark, sf_dir):
    p = proxy.prices(spark, sf_dir)
    return O.doctor(spark, [O.check_unique_keys(p), O.check_keys_present(p), O.check_daily_size(p, 82), O.check_calendar_cover(p.where("pos % 5 > 0"), calendar_index(p))])


@query("a25_prediction_contract", "prices", stack("daily_size", "date", "count(*)", "FROM prices GROUP BY date HAVING count(*) <> 82") + " UNION ALL " + stack("calendar_cover", "date", "'unknown'", "FROM (SELECT DISTINCT date, pos FROM prices) WHERE pos % 7 = 0") + " UNION ALL "
       + stack("finite_features", "'score'", "n", "FROM (SELECT count(*) AS n FROM prices WHERE k % 10 = 0)") + " UNION ALL " + stack("split", "'split'", "n", "FROM (SELECT count(*) AS n FROM prices WHERE k % 6 = 0)") + " UNION ALL " + stack("period", "'period'", "n", "FROM (SELECT count(*) AS n FROM prices WHERE date < DATE '1996-01-01')"), V)
def _(spark, sf_dir):
    p = proxy.prices(spark, sf_dir)
    predictions = p.select("date", "stock_code", F.when(F.col("k") % 10 > 0, F.col("close")).alias("score"), F.when(F.col("k") % 6 > 0, "test").alias("split"), F.lit(10).alias("horizon"))
    return O.prediction_contract(predictions, calendar_index(p).where("pos % 7 > 0"), 82, "test", 10, ("1996-01-01", "2001-12-31"))
