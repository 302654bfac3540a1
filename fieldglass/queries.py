"""One query for each operator over the driver's tables, with the same result in plain SQL.

Customers stand in for players (their market segment for a position, their balance for points, their key for the
average draft position), events for weekly statistics, nations for teams. Floats are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass import functions as fn
from fieldglass import operators as op
from fieldglass.operators import ordered
from fieldglass.plans import athletic, draft, inseason, league
from fieldglass.shared import shared_path
from fieldglass.sources import catalog, documents
from fieldglass.streaming import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Stand-ins: market segment -> position.
SEGMENT = {"AUTOMOBILE": "QB", "BUILDING": "RB", "FURNITURE": "WR", "HOUSEHOLD": "TE", "MACHINERY": "K"}
LEAGUE = league.League(12, league.RosterConfig(def_=0))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


class Tables:
    """The driver's tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def r6(*names: str):
    return {n: F.round(F.col(n), 6) for n in names}


def pool(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), fn.lookup("c_mktsegment", SEGMENT).alias("position"), F.col("c_acctbal").alias("projected_points"), F.col("c_custkey").cast("double").alias("adp"))


POOL = """pool AS (SELECT c_custkey AS player_id, c_name AS name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'WR' WHEN 'HOUSEHOLD' THEN 'TE' ELSE 'K' END AS position,
    c_acctbal AS projected_points, c_custkey::DOUBLE AS adp FROM customer)"""
LEVELS = """depths(position, depth) AS (VALUES ('QB', 12), ('RB', 30), ('WR', 40), ('TE', 14), ('K', 12)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY projected_points DESC, player_id) AS rn FROM pool),
    levels AS (SELECT d.position, coalesce(max(r.projected_points), 0.0) AS replacement FROM depths d LEFT JOIN ranked r ON r.position = d.position AND r.rn = d.depth + 1 GROUP BY d.position)"""
GRADIENT = """g0 AS (SELECT *, lag(projected_points) OVER w AS b, lead(projected_points) OVER w AS a FROM pool WINDOW w AS (PARTITION BY position ORDER BY projected_points DESC, player_id)),
    g1 AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 0.0 WHEN b IS NULL THEN projected_points - a WHEN a IS NULL THEN b - projected_points ELSE (b - a) / 2 END + coalesce(abs(b - 2 * projected_points + a), 0.0) AS raw FROM g0),
    grad AS (SELECT player_id, (raw - min(raw) OVER p) / CASE WHEN max(raw) OVER p = min(raw) OVER p THEN 1.0 ELSE max(raw) OVER p - min(raw) OVER p END AS scarcity FROM g1 WINDOW p AS (PARTITION BY position))"""
VONA = """surv AS (SELECT * FROM pool WHERE player_id NOT IN (SELECT player_id FROM pool ORDER BY adp, player_id LIMIT 22)),
    s2 AS (SELECT position, player_id, projected_points, row_number() OVER (PARTITION BY position ORDER BY projected_points DESC, player_id) AS rn FROM surv),
    b AS (SELECT position, max(CASE WHEN rn = 1 THEN player_id END) AS id1, max(CASE WHEN rn = 1 THEN projected_points END) AS v1, max(CASE WHEN rn = 2 THEN projected_points END) AS v2 FROM s2 WHERE rn <= 2 GROUP BY position),
    vona AS (SELECT player_id, projected_points - coalesce(CASE WHEN id1 = player_id THEN v2 ELSE v1 END, 0.0) AS vona FROM pool LEFT JOIN b USING (position))"""


@query("""
    WITH latest AS (SELECT o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1),
    total AS (SELECT o_custkey, sum(o_totalprice) AS total_price FROM orders GROUP BY o_custkey)
    SELECT c_custkey, c_name, n_name, coalesce(o_orderstatus, '-') AS latest_status, round(coalesce(total_price, 0.0), 2) AS total_price
    FROM customer LEFT JOIN latest ON c_custkey = latest.o_custkey LEFT JOIN total ON c_custkey = total.o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    ORDER BY total_price DESC, c_custkey""")
def customer_pool(spark, sf_dir):
    """Flagship: latest status and total of each customer, in one aggregation of the orders (latest by max_by, not by a second shuffle)."""
    t = Tables(spark, sf_dir)
    last = F.min_by("o_orderstatus", F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey"))
    totals = t.orders.groupBy("o_custkey").agg(last.alias("latest"), F.sum("o_totalprice").alias("total"))
    out = t.customer.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    out = out.select("c_custkey", "c_name", "n_name", F.coalesce("latest", F.lit("-")).alias("latest_status"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total_price"))
    return out.orderBy(F.desc("total_price"), "c_custkey")


@query("""
    WITH v AS (SELECT p_partkey, p_brand, nullif(p_retailprice, 950.0) AS v FROM part)
    SELECT p_partkey, p_brand, round(CASE WHEN v IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY p_brand ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY p_brand, v) - 1) / 2.0) / count(v) OVER (PARTITION BY p_brand) * 10 END, 6) AS pct,
           round(CASE WHEN v IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY p_brand ORDER BY v DESC NULLS LAST) + (count(v) OVER (PARTITION BY p_brand, v) - 1) / 2.0) / count(v) OVER (PARTITION BY p_brand) * 10 END, 6) AS pct_down FROM v""")
def pct_rank_by_group(spark, sf_dir):
    v = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", F.nullif(F.col("p_retailprice"), F.lit(950.0)).alias("v"))
    v = ordered.percentiles(v, "v", ["p_brand"], "pct", "pct_down")
    return v.withColumns(r6("pct", "pct_down")).drop("v")


@query("""
    WITH n AS (SELECT p_brand, p_retailprice, count(*) AS n FROM part GROUP BY ALL),
    s AS (SELECT *, (coalesce(sum(n) OVER (PARTITION BY p_brand ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0) / sum(n) OVER (PARTITION BY p_brand) * 10 AS pct FROM n)
    SELECT p_partkey, p_brand, round(pct, 6) AS pct FROM part JOIN s USING (p_brand, p_retailprice)""")
def pct_rank_by_counts(spark, sf_dir):
    ranked = athletic.percentiles_by_value(Tables(spark, sf_dir).part, "p_retailprice", ["p_brand"], "pct")
    return ranked.select("p_partkey", "p_brand", F.round("pct", 6).alias("pct"))


@query("""
    WITH m AS (SELECT p_partkey, p_type, p_size::DOUBLE AS a, nullif(p_retailprice, 950.0) AS b FROM part),
    r AS (SELECT *, CASE WHEN a IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY p_type ORDER BY a NULLS LAST) + (count(a) OVER (PARTITION BY p_type, a) - 1) / 2.0) / count(a) OVER (PARTITION BY p_type) * 10 END AS pa,
                 CASE WHEN b IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY p_type ORDER BY b DESC NULLS LAST) + (count(b) OVER (PARTITION BY p_type, b) - 1) / 2.0) / count(b) OVER (PARTITION BY p_type) * 10 END AS pb FROM m),
    u AS (SELECT *, (coalesce(pa, 0.0) + coalesce(pb, 0.0)) / nullif((pa IS NOT NULL)::INT + (pb IS NOT NULL)::INT, 0) AS raw, (pa IS NOT NULL)::INT + (pb IS NOT NULL)::INT AS present FROM r),
    k AS (SELECT *, round(raw, 9) AS rk FROM u)
    SELECT p_partkey, p_type, round(pa, 6) AS a_percentile, round(pb, 6) AS b_percentile, round(raw, 6) AS score_raw, present AS measures_present FROM k""")
def athletic_composite(spark, sf_dir):
    m = Tables(spark, sf_dir).part.select("p_partkey", "p_type", F.col("p_size").cast("double").alias("a"), F.nullif(F.col("p_retailprice"), F.lit(950.0)).alias("b"))
    out = athletic.composite(m, ["p_type"], {"a": True, "b": False})
    return out.select("p_partkey", "p_type", F.round("a_percentile", 6).alias("a_percentile"), F.round("b_percentile", 6).alias("b_percentile"), F.round("score_raw", 6).alias("score_raw"), "measures_present")


@query("""
    WITH y AS (SELECT c_mktsegment, n_regionkey, c_nationkey, c_acctbal, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT a.c_custkey, round(count(*) FILTER (b.c_acctbal < a.c_acctbal) / count(*) * 10, 6) AS pct
    FROM y a JOIN y b ON a.c_mktsegment = b.c_mktsegment AND b.n_regionkey <= a.n_regionkey GROUP BY a.c_custkey""")
def expanding_percentile(spark, sf_dir):
    t = Tables(spark, sf_dir)
    y = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return ordered.expanding_percentiles(y, "c_acctbal", ["c_mktsegment"], "n_regionkey", "pct").select("c_custkey", F.round("pct", 6).alias("pct"))


@query("""
    WITH g(grp, p) AS (VALUES ('URGENT', '1-URGENT'), ('TOP', '1-URGENT'), ('TOP', '2-HIGH'), ('MID', '2-HIGH'), ('MID', '3-MEDIUM'), ('LOW', '5-LOW'))
    SELECT grp AS priority_group, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN g ON o_orderpriority = p GROUP BY grp""")
def position_expand(spark, sf_dir):
    groups = {"URGENT": ["1-URGENT"], "TOP": ["1-URGENT", "2-HIGH"], "MID": ["2-HIGH", "3-MEDIUM"], "LOW": ["5-LOW"]}
    rows = op.spread(Tables(spark, sf_dir).orders, "o_orderpriority", groups, "priority_group")
    return rows.groupBy("priority_group").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    WITH v AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal END AS v FROM customer),
    e AS (SELECT *, min(v) OVER (PARTITION BY c_mktsegment) AS lo, max(v) OVER (PARTITION BY c_mktsegment) AS hi FROM v)
    SELECT c_custkey, round(coalesce((v - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 0.0), 6) AS plain, round(coalesce(1 - (v - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 0.5), 6) AS inverted FROM e""")
def minmax_norm(spark, sf_dir):
    v = Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment", F.when(F.col("c_nationkey") != 3, F.col("c_acctbal")).alias("v"))
    out = fn.minmax_by(v, ["c_mktsegment"], {"plain": ("v", False, 0.0), "inverted": ("v", True, 0.5)})
    return out.select("c_custkey", *[F.round(c, 6).alias(c) for c in ("plain", "inverted")])


@query(f"""
    WITH {POOL}, g AS (SELECT *, row_number() OVER w AS position_rank, coalesce(projected_points - lead(projected_points) OVER w, 0.0) AS drop_, lag(projected_points) OVER w - projected_points AS above FROM pool WINDOW w AS (PARTITION BY position ORDER BY projected_points DESC, player_id))
    SELECT player_id, position_rank, round(drop_ / CASE WHEN max(drop_) OVER (PARTITION BY position) > 0 THEN max(drop_) OVER (PARTITION BY position) ELSE 1.0 END, 6) AS scarcity,
           1 + sum(CASE WHEN above >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY position ORDER BY position_rank)::BIGINT AS tier FROM g""")
def tier_gaps(spark, sf_dir):
    out = draft.tier_scarcity(pool(Tables(spark, sf_dir)), 50.0)
    return out.select("player_id", F.col("position_rank").cast("bigint").alias("position_rank"), F.round("scarcity", 6).alias("scarcity"), F.col("tier").cast("bigint").alias("tier"))


@query(f"WITH {POOL}, {GRADIENT} SELECT player_id, round(scarcity, 6) AS scarcity FROM grad")
def gradient_scarcity(spark, sf_dir):
    return draft.gradient_scarcity(pool(Tables(spark, sf_dir))).select("player_id", F.round("scarcity", 6).alias("scarcity"))


@query(f"WITH {POOL}, {LEVELS} SELECT position, replacement FROM levels")
def replacement_level(spark, sf_dir):
    return draft.levels(pool(Tables(spark, sf_dir)), LEAGUE).filter("position != 'DEF'")


@query(f"WITH {POOL}, {LEVELS} SELECT player_id, position, round(projected_points - coalesce(replacement, 0.0), 6) AS vor FROM pool LEFT JOIN levels USING (position)")
def vor(spark, sf_dir):
    p = pool(Tables(spark, sf_dir))
    return draft.value_over_replacement(p, draft.levels(p, LEAGUE)).select("player_id", "position", F.round("vor", 6).alias("vor"))


@query(f"WITH {POOL}, {VONA} SELECT player_id, round(vona, 6) AS vona FROM vona")
def best_other_survivor(spark, sf_dir):
    return draft.value_over_next(pool(Tables(spark, sf_dir)), 22).select("player_id", F.round("vona", 6).alias("vona"))


@query(f"""
    WITH {POOL}, p AS (SELECT *, position IN ('RB', 'WR', 'TE') AS f FROM pool), surv AS (SELECT * FROM p WHERE player_id NOT IN (SELECT player_id FROM pool ORDER BY adp, player_id LIMIT 22))
    SELECT a.player_id, round(a.projected_points - coalesce((SELECT max(b.projected_points) FROM surv b WHERE b.player_id <> a.player_id AND (b.position = a.position OR (a.position = 'RB' AND b.f))), 0.0), 6) AS vona FROM p a""")
def vona_with_flex(spark, sf_dir):
    counts = {"RB": 2}
    return draft.value_over_next(pool(Tables(spark, sf_dir)), 22, LEAGUE.roster, counts).select("player_id", F.round("vona", 6).alias("vona"))


@query(f"""
    WITH {POOL}, {LEVELS}, {VONA}, {GRADIENT}, need(position, need) AS (VALUES ('QB', 0.5), ('RB', 1 - 2 / 3.0), ('WR', 1.0), ('TE', 1.0), ('K', 1.0)),
    j AS (SELECT player_id, projected_points - replacement AS vor, vona, scarcity, need FROM pool JOIN levels USING (position) JOIN vona USING (player_id) JOIN grad USING (player_id) JOIN need USING (position))
    SELECT player_id, round(0.4 * (vor - min(vor) OVER ()) / (max(vor) OVER () - min(vor) OVER ()) + 0.3 * (vona - min(vona) OVER ()) / (max(vona) OVER () - min(vona) OVER ()) + 0.2 * scarcity + 0.1 * need, 6) AS total_score FROM j""")
def weighted_score(spark, sf_dir):
    p = pool(Tables(spark, sf_dir))
    counts = {"QB": 1, "RB": 2}
    league_ = league.League(12, league.RosterConfig(def_=0, flex=0))
    out = draft.draft_scores(p, league_, 22, counts, replacement=draft.levels(p, LEAGUE))
    return out.select("player_id", F.round("total_score", 6).alias("total_score"))


@query(f"""
    WITH {POOL}, slots(position, n) AS (VALUES ('QB', 1), ('RB', 2), ('WR', 3), ('TE', 1), ('K', 1)), r AS (SELECT p.*, c_nationkey AS team, n FROM pool p JOIN customer ON player_id = c_custkey JOIN slots USING (position)),
    a AS (SELECT *, row_number() OVER (PARTITION BY team, position ORDER BY projected_points DESC, player_id) <= n AS own FROM r),
    f AS (SELECT *, NOT own AND position IN ('RB', 'WR', 'TE') AS open FROM a), g AS (SELECT *, row_number() OVER (PARTITION BY team, open ORDER BY projected_points DESC, player_id) AS k FROM f)
    SELECT team, player_id, CASE WHEN own THEN position WHEN open AND k <= 1 THEN 'FLEX' ELSE 'BENCH' END AS seat FROM g""")
def lineup_topk_flex(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rosters = pool(t).join(t.customer.select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team")), "player_id")
    return draft.lineup(rosters, LEAGUE.roster, ["team"]).select("team", "player_id", "seat")


@query("""
    WITH o AS (SELECT DISTINCT c_nationkey AS team, year(o_orderdate) * 100 + month(o_orderdate) AS month, day(o_orderdate) AS d FROM orders JOIN customer ON o_custkey = c_custkey), p AS (SELECT DISTINCT team, month FROM o WHERE d <= 3)
    SELECT t.team, m.month FROM (SELECT DISTINCT team FROM p) t CROSS JOIN (SELECT DISTINCT month FROM p) m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.team = t.team AND p.month = m.month)""")
def bye_weeks_anti(spark, sf_dir):
    t = Tables(spark, sf_dir)
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint")
    played = t.orders.filter(F.dayofmonth("o_orderdate") <= 3).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("team"), month.alias("month")).distinct()
    return op.missing_pairs(played.select("team").distinct(), played.select("month").distinct(), played)


@query("""SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS rn FROM events WHERE nullif(event_type, 'error') IS NOT NULL) WHERE rn = 1""")
def latest_event(spark, sf_dir):
    known = Tables(spark, sf_dir).events.filter(F.nullif(F.col("event_type"), F.lit("error")).isNotNull())
    return fn.latest(known, ["user_id"], "ts", "event_id").select("user_id", "event_type", "value")


@query("""
    WITH by_key AS (SELECT * FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT *, 'customer#' || lpad((o_custkey)::VARCHAR, 9, '0') AS who FROM orders)
    SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS found, a.c_custkey IS NULL AND b.c_custkey IS NOT NULL AS by_name
    FROM o LEFT JOIN by_key a ON o_custkey = a.c_custkey LEFT JOIN customer b ON a.c_custkey IS NULL AND who = lower(trim(b.c_name)) AND b.c_acctbal > 0""")
def conditional_fallback_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    orders = t.orders.withColumn("who", F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    by_key = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("a_key"))
    by_name = t.customer.filter("c_acctbal > 0").select(fn.lower_trim("c_name").alias("b_name"), F.col("c_custkey").alias("b_key"))
    out = op.fallback_join(orders, by_key, F.col("o_custkey") == F.col("a_key"), by_name, F.col("who") == F.col("b_name"), "a_key")
    return out.select("o_orderkey", F.coalesce("a_key", "b_key").alias("found"), (F.col("a_key").isNull() & F.col("b_key").isNotNull()).alias("by_name"))


@query("""
    WITH s AS (SELECT s_suppkey, s_nationkey, regexp_extract(s_name, '[0-9]+') AS digits FROM supplier),
    m AS (SELECT c.c_custkey, c.tier, c.s_suppkey FROM (
        SELECT c_custkey, 1 AS tier, s_suppkey, s_suppkey AS o FROM customer JOIN s ON c_custkey = s_suppkey + 50 UNION ALL
        SELECT c_custkey, 2, s_suppkey, s_suppkey FROM customer JOIN s ON digits = regexp_extract(c_name, '[0-9]+') AND c_nationkey = s_nationkey UNION ALL
        SELECT c_custkey, 3, s_suppkey, s_suppkey FROM customer JOIN s ON c_nationkey = s_nationkey) c),
    b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, s_suppkey) AS rn FROM m)
    SELECT customer.c_custkey, s_suppkey FROM customer LEFT JOIN b ON customer.c_custkey = b.c_custkey AND rn = 1""")
def tiered_match(spark, sf_dir):
    t = Tables(spark, sf_dir)
    suppliers = t.supplier.withColumn("digits", F.regexp_extract("s_name", "[0-9]+", 0))
    tiers = [
        [(F.col("c_custkey"), F.col("s_suppkey") + 50)],
        [(F.regexp_extract("c_name", "[0-9]+", 0), F.col("digits")), (F.col("c_nationkey"), F.col("s_nationkey"))],
        [(F.col("c_nationkey"), F.col("s_nationkey"))],
    ]
    return op.tiered_match(t.customer, suppliers, ["s_suppkey"], tiers, F.col("s_suppkey")).select("c_custkey", "s_suppkey")


@query("""
    WITH k AS (SELECT p_partkey, p_name || '|' || p_brand AS key FROM part), u AS (SELECT key, max(p_partkey) AS p FROM k GROUP BY key HAVING count(*) = 1), i AS (SELECT p_partkey FROM part WHERE p_size <= 10)
    SELECT k.p_partkey, coalesce(i.p_partkey, u.p) AS found FROM k LEFT JOIN i USING (p_partkey) LEFT JOIN u USING (key)""")
def unique_name_lookup(spark, sf_dir):
    parts = Tables(spark, sf_dir).part.withColumn("key", F.concat_ws("|", "p_name", "p_brand"))
    right = parts.select(F.when(F.col("p_size") <= 10, F.col("p_partkey")).alias("r_id"), F.col("key").alias("r_key"), F.col("p_partkey").alias("value"))
    out = op.lookup_id_then_unique(parts, right, "value", (F.col("p_partkey"), F.col("r_id")), (F.col("key"), F.col("r_key")), "found")
    return out.select("p_partkey", "found")


@query("""
    WITH a AS (SELECT max(c_custkey) AS v, c_nationkey AS k FROM customer WHERE c_acctbal > 9900 GROUP BY c_nationkey), b AS (SELECT max(c_custkey) AS v, c_custkey % 1000 AS k FROM customer GROUP BY c_custkey % 1000)
    SELECT s_suppkey, coalesce(a.v, b.v) AS found FROM supplier LEFT JOIN a ON s_nationkey = a.k LEFT JOIN b ON s_suppkey = b.k""")
def two_key_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    right = t.customer.select(F.when(F.col("c_acctbal") > 9900, F.col("c_nationkey")).alias("k1"), (F.col("c_custkey") % 1000).alias("k2"), F.col("c_custkey").alias("v"))
    return op.lookup_keys(t.supplier, right, "v", (F.col("s_nationkey"), F.col("k1")), (F.col("s_suppkey"), F.col("k2")), into="found").select("s_suppkey", "found")


@query("""
    WITH b AS (SELECT c_custkey + 40 AS id, c_nationkey AS nation, c_name AS name FROM customer), s AS (SELECT s_suppkey AS id, s_nationkey AS nation, 'Customer#' || right(s_name, 9) AS name FROM supplier)
    SELECT id, nation, name FROM b UNION ALL SELECT DISTINCT id, nation, name FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = s.id OR (b.name = s.name AND b.nation = s.nation))""")
def anti_or_insert(spark, sf_dir):
    t = Tables(spark, sf_dir)
    shifted = (F.col("c_custkey") + 40).alias("id")  # so that suppliers match by id, by name and nation, or not at all
    base = t.customer.select(shifted, F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.concat(F.lit("Customer#"), F.right("s_name", F.lit(9))).alias("name"))
    return op.insert_missing(base, rows, [(F.col("id"), F.col("id"))], [(F.col("name"), F.col("name")), (F.col("nation"), F.col("nation"))])


@query("""
    WITH b AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS bal FROM customer), s AS (SELECT * FROM supplier WHERE s_acctbal > 0),
    k AS (SELECT s_nationkey, arg_min(s_acctbal, s_suppkey) AS v FROM s GROUP BY s_nationkey)
    SELECT c_custkey, coalesce(bal, i.s_acctbal, k.v) AS bal FROM b LEFT JOIN s i ON c_custkey = i.s_suppkey LEFT JOIN k ON c_nationkey = k.s_nationkey""")
def enrich_update(spark, sf_dir):
    t = Tables(spark, sf_dir)
    base = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("bal"))
    source = t.supplier.filter("s_acctbal > 0")
    out = op.enrich(base, source, {"bal": F.col("s_acctbal")}, [[(F.col("c_custkey"), F.col("s_suppkey"))], [(F.col("c_nationkey"), F.col("s_nationkey"))]], F.col("s_suppkey"))
    return out.select("c_custkey", "bal")


@query("""
    WITH a AS (SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
    c AS (SELECT l_returnflag, l_linestatus, max(l_discount) AS top FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, qty, n, top FROM a FULL JOIN b USING (l_returnflag, l_linestatus) FULL JOIN c USING (l_returnflag, l_linestatus)""")
def full_merge_measures(spark, sf_dir):
    rows, keys = Tables(spark, sf_dir).lineitem, ["l_returnflag", "l_linestatus"]
    return op.full_merge(
        [
            rows.filter("l_linestatus = 'F'").groupBy(*keys).agg(F.round(F.sum("l_quantity"), 2).alias("qty")),
            rows.filter("l_returnflag <> 'N'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")),
            rows.groupBy(*keys).agg(F.max("l_discount").alias("top")),
        ],
        keys,
    )


@query("""
    WITH w AS (SELECT user_id, day(ts) AS d, max(value) AS v FROM events GROUP BY user_id, day(ts))
    SELECT user_id, count(*) AS weeks_analyzed, round(avg(v), 6) AS mean_points, round(coalesce(stddev_samp(v), 0.0), 6) AS std_points, max(v) AS best_points,
           round(CASE WHEN count(*) >= 2 AND avg(v) > 0 THEN stddev_samp(v) / avg(v) END, 6) AS consistency_cv, round(CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(v, d), 0.0) ELSE 0.0 END, 6) AS trend_slope FROM w GROUP BY user_id""")
def recent_form(spark, sf_dir):
    weekly = Tables(spark, sf_dir).events.groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.max("value").alias("v"))
    return op.form(weekly, ["user_id"], "v", "d").withColumns(r6("mean_points", "std_points", "consistency_cv", "trend_slope"))


ALLOWED = """l AS (SELECT s_nationkey AS opponent, c_mktsegment AS position, l_extendedprice AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    allowed AS (SELECT opponent, position, avg(v) AS allowed FROM l GROUP BY ALL)"""


def allowed(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("s_nationkey").alias("opponent"), F.col("c_mktsegment").alias("position")).agg(F.avg("l_extendedprice").alias("allowed"))


@query(f"WITH {ALLOWED} SELECT opponent, position, round(allowed, 4) AS allowed FROM allowed")
def defence_allowed(spark, sf_dir):
    return allowed(Tables(spark, sf_dir)).withColumn("allowed", F.round("allowed", 4))


@query(f"""
    WITH {ALLOWED}, g AS (SELECT n_nationkey AS home, (n_nationkey * 7 + n_regionkey) % 25 AS away FROM nation), s AS (SELECT home AS team, away AS opponent FROM g UNION ALL SELECT away, home FROM g),
    p AS (SELECT DISTINCT c_mktsegment AS position FROM customer)
    SELECT team, p.position, round(avg(coalesce(allowed, 0.0)), 4) AS schedule_quality FROM s CROSS JOIN p LEFT JOIN allowed a ON s.opponent = a.opponent AND p.position = a.position GROUP BY ALL""")
def schedule_quality(spark, sf_dir):
    t = Tables(spark, sf_dir)
    games = t.nation.select(F.col("n_nationkey").alias("home"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("away"))
    out = op.mean_over_opponents(op.both_sides(games, "home", "away"), allowed(t), list(SEGMENT))
    return out.withColumn("schedule_quality", F.round("schedule_quality", 4))


@query("""
    WITH w AS (SELECT user_id, day(ts) AS d, max(value) AS v, max(event_type) AS e FROM events GROUP BY user_id, day(ts)),
    f AS (SELECT user_id, max(e) AS position, avg(v) AS m, CASE WHEN count(*) >= 2 AND avg(v) > 0 THEN stddev_samp(v) / avg(v) END AS cv, CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(v, d), 0.0) ELSE 0.0 END AS t, max(v) AS o FROM w GROUP BY user_id),
    n AS (SELECT user_id, coalesce((m - min(m) OVER p) / CASE WHEN max(m) OVER p = min(m) OVER p THEN 1.0 ELSE max(m) OVER p - min(m) OVER p END, 0.0) AS a,
        coalesce(1 - (cv - min(cv) OVER p) / CASE WHEN max(cv) OVER p = min(cv) OVER p THEN 1.0 ELSE max(cv) OVER p - min(cv) OVER p END, 0.5) AS b,
        coalesce((o - min(o) OVER p) / CASE WHEN max(o) OVER p = min(o) OVER p THEN 1.0 ELSE max(o) OVER p - min(o) OVER p END, 0.0) AS c,
        coalesce((t - min(t) OVER p) / CASE WHEN max(t) OVER p = min(t) OVER p THEN 1.0 ELSE max(t) OVER p - min(t) OVER p END, 0.0) AS d FROM f WINDOW p AS (PARTITION BY position))
    SELECT user_id, round(0.3 * a + 0.25 * b + 0.2 * 0 + 0.1 * c + 0.1 * d + 0.05 * 0, 5) AS composite FROM n""")
def fa_composite(spark, sf_dir):
    weekly = Tables(spark, sf_dir).events.groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.max("value").alias("v"), F.max("event_type").alias("e"))
    who = weekly.groupBy("user_id").agg(F.max("e").alias("position"), F.max("v").alias("mean_opportunity"))
    rows = op.form(weekly, ["user_id"], "v", "d").join(who, "user_id").withColumns({"mean_vs_expectation": F.lit(0.0), "schedule_quality": F.lit(0.0)})
    return inseason.blend(rows).select("user_id", F.round("composite", 5).alias("composite"))


@query("""
    SELECT c_custkey, 'YAMP_' || substring(md5(array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'None' END, 'None', c_name, c_nationkey::VARCHAR, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE regexp_replace(c_mktsegment || ' St.', '(?i) St\\.?$', ' State') END], lambda x: x <> ''), '|')), 1, 12) AS id FROM customer""")
def hash_id(spark, sf_dir):
    gsis = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string"))
    college = F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", F.lit(" St.")))
    return Tables(spark, sf_dir).customer.select("c_custkey", fn.identity_hash(gsis, F.lit(None).cast("string"), "c_name", F.col("c_nationkey").cast("string"), college).alias("id"))


@query("""
    WITH n AS (SELECT c_custkey, ' ' || c_name || CASE c_custkey % 5 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' WHEN 2 THEN ' sr' ELSE ' ' END AS name FROM customer)
    SELECT c_custkey, lower(regexp_replace(trim(name), '(?i) (jr\\.?|sr\\.?|ii|iii|iv|v)$', '')) AS key, regexp_replace(lower(regexp_replace(trim(regexp_replace(name, '[^a-zA-Z0-9 ]', '', 'g')), '(?i) (jr\\.?|sr\\.?|ii|iii|iv|v)$', '')), ' +', ' ', 'g') AS plain FROM n""")
def name_norm(spark, sf_dir):
    ending = F.when(F.col("c_custkey") % 5 == 0, " Jr.").when(F.col("c_custkey") % 5 == 1, " III").when(F.col("c_custkey") % 5 == 2, " sr").otherwise(" ")
    named = Tables(spark, sf_dir).customer.select("c_custkey", F.concat(F.lit(" "), F.col("c_name"), ending).alias("name"))
    return named.select("c_custkey", fn.name_key("name").alias("key"), fn.name_key_plain("name").alias("plain"))


@query("""
    WITH n AS (SELECT doc_id, source || CASE doc_id % 3 WHEN 0 THEN ' St' WHEN 1 THEN ' Col.' ELSE ' Stan' END AS c FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(trim(c), '(?i) St\\.?$', ' State'), '(?i) Col\\.?$', ' College') AS college FROM n""")
def college_norm(spark, sf_dir):
    ending = F.when(F.col("doc_id") % 3 == 0, " St").when(F.col("doc_id") % 3 == 1, " Col.").otherwise(" Stan")
    return Tables(spark, sf_dir).documents.select("doc_id", fn.college_key(F.concat("source", ending)).alias("college"))


@query("""
    WITH h AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE (p_size // 12)::VARCHAR || '-' || (p_size % 12)::VARCHAR END AS ht, CASE p_type WHEN 'ECONOMY' THEN 'LT' WHEN 'PROMO' THEN 'SAF' WHEN 'SMALL' THEN 'EDGE' ELSE p_type END AS pos FROM part)
    SELECT p_partkey, CASE WHEN ht LIKE '%-%' THEN split_part(ht, '-', 1)::INT * 12 + split_part(ht, '-', 2)::INT END AS inches, CASE pos WHEN 'LT' THEN 'OT' WHEN 'SAF' THEN 'S' ELSE pos END AS standard,
           try_cast(nullif(split_part(ht, '-', 1), '') AS INT) AS feet FROM h""")
def text_parsing(spark, sf_dir):
    ht = F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.concat_ws("-", F.floor(F.col("p_size") / 12).cast("string"), (F.col("p_size") % 12).cast("string")))
    pos = fn.lookup("p_type", {"ECONOMY": "LT", "PROMO": "SAF", "SMALL": "EDGE"})
    rows = Tables(spark, sf_dir).part.select("p_partkey", ht.alias("ht"), pos.alias("pos"))
    return rows.select("p_partkey", fn.height_inches("ht").alias("inches"), fn.position_standard("pos").alias("standard"), fn.to_int(F.split("ht", "-")[0]).alias("feet"))


@query("""
    WITH k AS (SELECT event_id, json_extract_string(props, '$.k')::INT / 50.0 AS rec FROM events)
    SELECT event_id, CASE WHEN rec >= 1 THEN 'ppr' WHEN rec >= 0.5 THEN 'half_ppr' ELSE 'standard' END AS scoring FROM k""")
def json_props(spark, sf_dir):
    doc = F.concat(F.lit('{"scoring_settings": {"rec": '), (F.get_json_object("props", "$.k").cast("int") / 50.0).cast("string"), F.lit("}}"))
    return Tables(spark, sf_dir).events.select("event_id", fn.json_scoring_type(doc).alias("scoring"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT key, 'left' AS side FROM (SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)) UNION ALL SELECT key, 'right' FROM (SELECT s_suppkey AS key FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer))")
def set_difference(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return op.only_in(t.customer.select(F.col("c_custkey").alias("key")), t.supplier.select(F.col("s_suppkey").alias("key")), "key")


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier")
def concat_by_name(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'legacy' ELSE 'modern' END AS side FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority <> '5-LOW'")
def router_split(spark, sf_dir):
    rows = Tables(spark, sf_dir).orders
    first, second = F.col("o_orderstatus") == "F", F.col("o_orderpriority") != "5-LOW"
    return rows.withColumn("side", F.when(first, "legacy").when(second, "modern")).filter("side IS NOT NULL").select("o_orderkey", "side")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def dup_detection(spark, sf_dir):
    return op.repeated_rows(Tables(spark, sf_dir).lineitem, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1")
def unique_counts(spark, sf_dir):
    return op.once_only(Tables(spark, sf_dir).lineitem, "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS rows, count(DISTINCT lang) AS keys, count(n_chars) AS n_chars_present, min(n_chars) AS n_chars_min, max(n_chars) AS n_chars_max FROM documents")
def table_profile(spark, sf_dir):
    return op.profile(Tables(spark, sf_dir).documents, "lang", "n_chars")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def group_sizes(spark, sf_dir):
    return op.group_sizes(Tables(spark, sf_dir).documents, "lang", "source")


@query("SELECT event_type, round(avg((nullif(value, 0.5) IS NOT NULL AND value < 60)::INT) * 100, 6) AS matched_pct FROM events GROUP BY event_type")
def match_coverage(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.withColumn("v", F.when((F.col("value") < 60) & (F.col("value") != 0.5), F.col("value")))
    return rows.groupBy("event_type").agg(F.round(op.coverage(rows, "v"), 6).alias("matched_pct"))


@query("""
    WITH e AS (SELECT user_id AS identity, event_id // 2 AS id FROM events)
    SELECT 'id' AS id, (SELECT count(*) FROM (SELECT id FROM e GROUP BY id HAVING count(DISTINCT identity) > 1)) AS collisions, (SELECT count(*) FROM (SELECT identity FROM e GROUP BY identity HAVING count(DISTINCT id) > 1)) AS splits""")
def id_integrity(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("identity"), F.floor(F.col("event_id") / 2).alias("id"))
    return op.id_integrity(e, "identity", "id")


@query("SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS BUILDING, count(*) FILTER (c_mktsegment = 'MACHINERY') AS MACHINERY FROM customer GROUP BY c_nationkey")
def position_counts(spark, sf_dir):
    return op.position_counts(Tables(spark, sf_dir).customer, "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("""
    WITH v AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
    c AS (SELECT *, max(CASE WHEN k = n // 3 THEN c_acctbal END) OVER (PARTITION BY c_mktsegment) AS a, max(CASE WHEN k = n * 2 // 3 THEN c_acctbal END) OVER (PARTITION BY c_mktsegment) AS b FROM v)
    SELECT c_custkey, CASE WHEN c_acctbal < a THEN 'low' WHEN c_acctbal < b THEN 'medium' ELSE 'high' END AS risk FROM c""")
def risk_terciles(spark, sf_dir):
    return ordered.thirds(Tables(spark, sf_dir).customer, "c_acctbal", ["c_mktsegment"]).select("c_custkey", "risk")


@query("""
    WITH w AS (SELECT c_custkey, c_nationkey, exp((c_acctbal / 1000 - max(c_acctbal / 1000) OVER (PARTITION BY c_nationkey)) / 2.0) AS e FROM customer)
    SELECT c_custkey, round(e / sum(e) OVER (PARTITION BY c_nationkey), 6) AS p FROM w""")
def softmax_share(spark, sf_dir):
    return Tables(spark, sf_dir).customer.select("c_custkey", F.round(fn.softmax(F.col("c_acctbal") / 1000, ["c_nationkey"], 2.0), 6).alias("p"))


CHART = "SELECT o_custkey % 500 AS pick, sum(o_totalprice) AS value FROM orders WHERE o_orderkey % 4 = {} GROUP BY 1"


@query(f"""
    WITH a AS ({CHART.format(0)}), b AS ({CHART.format(1)}), c AS ({CHART.format(2)}), d AS ({CHART.format(3)})
    SELECT a.pick, round(a.value / 30, 4) AS draft_values_fitzgerald_spielberger, round(b.value / 5, 4) AS draft_values_harvard, round(c.value / 30, 4) AS draft_values_jimmy_johnson, round(d.value / 10, 4) AS draft_values_rich_hill, round(CASE WHEN a.pick > 0 THEN log10(a.pick) END, 6) AS log_pick,
           round(log10(a.value / 30) * 50, 6) AS log_draft_values_fitzgerald_spielberger, round(log10(b.value / 5) * 50, 6) AS log_draft_values_harvard, round(log10(c.value / 30) * 50, 6) AS log_draft_values_jimmy_johnson, round(log10(d.value / 10) * 50, 6) AS log_draft_values_rich_hill
    FROM a JOIN b USING (pick) JOIN c USING (pick) JOIN d USING (pick)""")
def value_chart_compare(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    charts = {n: orders.filter(F.col("o_orderkey") % 4 == i).groupBy((F.col("o_custkey") % 500).alias("pick")).agg(F.sum("o_totalprice").alias("value")) for i, n in enumerate(catalog.CHARTS)}
    out = catalog.value_charts(charts)
    return out.select("pick", *[F.round(c, 6 if c.startswith("log") else 4).alias(c) for c in out.columns if c != "pick"])


@query("""
    WITH p AS (SELECT range AS pick FROM range(1, 181)), s AS (SELECT pick, (pick - 1) // 12 + 1 AS round, (pick - 1) % 12 + 1 AS in_round FROM p), o AS (SELECT *, CASE WHEN round % 2 = 1 THEN in_round ELSE 13 - in_round END AS slot FROM s)
    SELECT pick, round, in_round, slot, slot = 5 AS is_user, coalesce((SELECT min(b.pick) FROM o b WHERE b.pick > a.pick AND b.slot = 5), 181) - a.pick - 1 AS until_user FROM o a""")
def snake_order(spark, sf_dir):
    return league.snake_order(spark, 12, 15, 5)


@query("""
    WITH f AS (SELECT event_id, user_id, event_type = 'purchase' AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS at_ FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM f)
    SELECT event_id, coalesce(min(CASE WHEN flag THEN at_ END) OVER (PARTITION BY user_id ORDER BY at_ ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) - at_ - 1 AS gap FROM n""")
def next_pick_gap(spark, sf_dir):
    from pyspark.sql import Window

    rows = Tables(spark, sf_dir).events.withColumns({"flag": F.col("event_type") == "purchase", "at": (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint")})
    return rows.select("event_id", fn.next_true_distance("flag", "at", ["user_id"]).alias("gap"))


@query("""
    WITH e AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier) SELECT s_suppkey, (SELECT max(b.s_acctbal) FROM e b WHERE b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey) AS best_other FROM e a""")
def best_other_in_group(spark, sf_dir):
    return Tables(spark, sf_dir).supplier.select("s_suppkey", fn.best_other(["s_nationkey"], "s_acctbal", "s_suppkey").alias("best_other"))


@query("""
    SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, ((length(html) - length(replace(html, '<a href="', ''))) // 9)::BIGINT AS links FROM pages""")
def html_facts(spark, sf_dir):
    return documents.page_facts(Tables(spark, sf_dir).pages)


@query("""
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, round(round_even(c_acctbal, 0), 0)::BIGINT AS whole,
           round(CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END, 6) AS ratio, NULL::DOUBLE AS nothing, 'DST_' || c_nationkey::VARCHAR AS key FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name <> ''""")
def projections_and_filters(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_name").isNotNull() & (F.col("c_name") != ""))
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal").between(0, 5000), "mid").otherwise("high")
    return c.select(
        "c_custkey", band.alias("band"), fn.fallback(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("none")).alias("segment"), fn.cast_rounded("c_acctbal").alias("whole"),
        F.round(fn.ratio_or_null("c_acctbal", "c_nationkey"), 6).alias("ratio"), F.lit(None).cast("double").alias("nothing"), F.concat(F.lit("DST_"), F.col("c_nationkey").cast("string")).alias("key"),
    )


@query("""
    WITH t AS (SELECT n_nationkey AS code, 1990 + n_regionkey AS f, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 1996 + n_regionkey END AS e FROM nation), s AS (SELECT DISTINCT c_nationkey AS team, year(o_orderdate) AS season FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT team, season, f AS since FROM s LEFT JOIN t ON team = code AND season BETWEEN f AND coalesce(e, 9999)""")
def tenure_in_season(spark, sf_dir):
    from fieldglass.plans import tenure

    t = Tables(spark, sf_dir)
    terms = t.nation.select(F.col("n_nationkey").alias("nflverse_code"), F.col("n_name").alias("Person"), (F.col("n_regionkey") + 1990).alias("From"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey") + 1996).alias("To"))
    seasons = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("team"), F.year("o_orderdate").cast("bigint").alias("season")).distinct()
    out = tenure.in_charge(seasons, terms, "team", "season").join(terms.select("Person", F.col("From").alias("since")), "Person", "left")
    return out.select("team", "season", "since")


@query("SELECT player_id FROM (WITH " + POOL + " SELECT player_id FROM pool ORDER BY projected_points DESC, player_id LIMIT 20)")
def top_candidates(spark, sf_dir):
    return draft.best_candidates(pool(Tables(spark, sf_dir)).withColumn("total_score", F.col("projected_points"))).select("player_id")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_fold(spark, sf_dir):
    """The events table as a file stream, taken once to its end."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    totals = fold.taken(fold.running_totals(stream), shared_path(spark, "checkpoint"))
    return totals.select("user_id", "n", F.round("total", 4).alias("total"))


@query()
def simulate_candidates(spark, sf_dir):
    """Ten candidates of a twelve-team draft over the whole pool, two hundred drafts each. Seeded, so rows repeat."""
    from fieldglass.plans import simulate

    players = ordered.numbered(pool(Tables(spark, sf_dir)), [], [F.asc("adp"), F.asc("player_id")], "place")  # all: the user's weighted picks give every player a chance
    players = players.select("player_id", "position", (F.col("projected_points") / 30).alias("projected_points"), F.col("place").cast("double").alias("adp"), F.lit(4.0).alias("adp_std"))
    managers = tuple(league.Manager(f"m{i}", f"m{i}", i, i == 5) for i in range(1, 13))
    state = league.DraftState(league.League(12, league.RosterConfig(def_=0, bench=2)), managers)
    snap, first = simulate.pool_snapshot(spark, state, players, {p: 100.0 for p in league.POSITIONS})
    return simulate.simulate_candidates(spark, snap, first(10), 200, 50)


from fieldglass import composites  # noqa: E402, F401 - registers its queries with the names above
