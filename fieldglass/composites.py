"""Queries of the composed plans: each calls the plan itself over frames derived from the driver's tables, with the same result in SQL.

Customers stand in for players, nations for teams (``T0`` to ``T24``), orders for a season's statistics, rosters and games, events for injury reports.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass import functions as fn
from fieldglass.plans import athletic, draft, identity, inseason, league, pool, simulate, tenure
from fieldglass.queries import LEAGUE, SEGMENT, Tables, query, r6
from fieldglass.queries import POOL as DRAFT_POOL
from fieldglass.queries import pool as draft_pool
from fieldglass.operators import intervals, names, ordered
from fieldglass.shared import shared_path
from fieldglass.sources import catalog, csv_splits, documents, layout
from fieldglass.streaming import drafts, picks


def name_sql(x: str) -> str:
    return rf"lower(regexp_replace(trim({x}), '(?i) (jr\.?|sr\.?|ii|iii|iv|v)$', ''))"


def college_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(trim({x}), '(?i) St\.?$', ' State'), '(?i) Col\.?$', ' College')"


def derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``columns``: name -> Spark SQL expression over ``df``."""
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


# --- identity -------------------------------------------------------------------------------------------------

PLAYERS = {
    "gsis_id": "concat('G', c_custkey)",
    "pfr_id": "CASE WHEN c_custkey % 2 = 0 THEN concat('P', c_custkey) END",
    "display_name": "concat(c_name, CASE WHEN c_custkey % 3 = 0 THEN ' Jr.' ELSE '' END)",
    "birth_date": "CAST(NULL AS string)",
    "college_name": "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(c_mktsegment, ' St.') ELSE concat(c_mktsegment, ' Col.') END",
}
COMBINE = {
    "pfr_id": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('P', c_custkey) ELSE concat('Q', c_custkey) END",
    "player_name": "CASE WHEN c_custkey % 7 = 0 THEN concat('Rookie ', c_custkey) ELSE upper(c_name) END",
    "school": "concat(c_mktsegment, CASE WHEN c_custkey % 4 = 1 THEN ' State' ELSE ' St' END)",
}
DRAFTED = {
    "pfr_player_id": "CASE WHEN c_custkey % 11 = 0 THEN concat('R', c_custkey) END",
    "pfr_player_name": "CASE WHEN c_custkey % 7 = 0 THEN concat('Rookie ', c_custkey, ' III') ELSE concat('Drafted ', c_nationkey, ' ', c_custkey) END",
    "college": "concat(c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN ' St.' ELSE ' Col.' END)",
}


def sql_of(columns: dict[str, str], table: str) -> str:
    """The same derivation for the SQL side: both engines read these expressions alike."""
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}"


def absorb_sql(known: str, source: str, out: str, college: str) -> str:
    return f"""
    {out}_named AS (SELECT * FROM {source} WHERE s_name IS NOT NULL AND s_pfr IS NOT NULL),
    {out}_by_id AS (SELECT s_pfr AS k, min(s_ck) AS ck FROM {out}_named GROUP BY 1),
    {out}_by_name AS (SELECT s_key, s_ck, min(s_pfr) AS pfr FROM {out}_named WHERE s_ck IS NOT NULL GROUP BY 1, 2),
    {out}_updated AS (SELECT gsis_id, coalesce(b.pfr_id, i.k, m.pfr) AS pfr_id, name, merge_name, birthdate, coalesce(b.college, CASE WHEN i.k IS NOT NULL THEN i.ck ELSE m.s_ck END) AS college
        FROM {known} b LEFT JOIN {out}_by_id i ON b.pfr_id = i.k LEFT JOIN {out}_by_name m ON b.merge_name = m.s_key AND b.college = m.s_ck),
    {out} AS (SELECT * FROM {out}_updated UNION ALL SELECT DISTINCT NULL, s_pfr, s_name, s_key, NULL, {college} FROM {source} s
        WHERE s_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {out}_updated u WHERE u.pfr_id = s.s_pfr) AND NOT EXISTS (SELECT 1 FROM {out}_updated u WHERE u.merge_name = s.s_key AND u.college = s.s_ck))"""


def source_sql(columns: dict[str, str], pfr: str, name: str, college: str) -> str:
    return f"SELECT {pfr} AS s_pfr, {name} AS s_name, {name_sql(name)} AS s_key, {college} AS s_college, {college_sql(college)} AS s_ck FROM ({sql_of(columns, 'customer')})"


@query(f"""
    WITH base AS (SELECT DISTINCT gsis_id, pfr_id, display_name AS name, {name_sql('display_name')} AS merge_name, birth_date::VARCHAR AS birthdate, {college_sql('college_name')} AS college FROM ({sql_of(PLAYERS, 'customer')}) WHERE display_name IS NOT NULL),
    combine AS ({source_sql(COMBINE, 'pfr_id', 'player_name', 'school')}), drafted AS ({source_sql(DRAFTED, 'pfr_player_id', 'pfr_player_name', 'college')}),
    {absorb_sql('base', 'combine', 'first', 's_ck')}, {absorb_sql('first', 'drafted', 'second', 's_college')}, u AS (SELECT DISTINCT * FROM second)
    SELECT *, 'YAMP_' || substring(md5(array_to_string(list_filter([coalesce(gsis_id, 'None'), coalesce(pfr_id, 'None'), coalesce(name, 'None'), coalesce(birthdate, 'None'), coalesce({college_sql('college')}, '')], lambda x: x <> ''), '|')), 1, 12) AS yamplayer_id FROM u""")
def unified_players(spark, sf_dir):
    customers = Tables(spark, sf_dir).customer
    return identity.mapping_table(identity.unified_players(derived(customers, PLAYERS), derived(customers, COMBINE), derived(customers, DRAFTED)))


MAPPING = {
    "gsis_id": "concat('G', c_custkey)",
    "pfr_id": "CASE WHEN c_custkey % 2 = 0 THEN concat('P', c_custkey) END",
    "merge_name": "concat('customer#', lpad(CAST(c_custkey % 1000 AS string), 9, '0'))",
    "college": "CASE WHEN c_custkey % 2 = 0 THEN 'Ohio State' ELSE 'Iowa College' END",
    "birthdate": "concat('1990-01-', lpad(CAST(c_nationkey + 1 AS string), 2, '0'))",
    "yamplayer_id": "concat('Y', lpad(CAST(c_custkey AS string), 9, '0'))",
}
NAME = "concat('Customer#', lpad(CAST(o_custkey % 1000 AS string), 9, '0'))"
HYDRATED = {
    "combine": {"key": "o_orderkey", "pfr_id": "CASE WHEN o_orderkey % 3 = 0 THEN concat('P', o_custkey) END", "player_name": NAME, "school": "CASE WHEN o_orderkey % 2 = 0 THEN 'Ohio St.' ELSE 'Iowa Col.' END"},
    "rosters": {"key": "o_orderkey", "gsis_id": "CASE WHEN o_orderkey % 4 = 0 THEN concat('G', o_custkey) END", "pfr_id": "CASE WHEN o_orderkey % 4 = 1 THEN concat('P', o_custkey) END", "birth_date": "concat('1990-01-', lpad(CAST(o_custkey % 25 + 1 AS string), 2, '0'))", "full_name": NAME},
    "player_stats": {"key": "o_orderkey", "player_id": "CASE WHEN o_orderkey % 2 = 0 THEN concat('G', o_custkey) END", "player_display_name": NAME},
    "snap_counts": {"key": "o_orderkey", "pfr_player_id": "concat('P', o_custkey)"},
    "rosters_weekly": {"key": "o_orderkey", "gsis_id": "CASE WHEN o_orderkey % 4 = 0 THEN concat('G', o_custkey) END", "pfr_id": "concat('P', o_custkey)"},
    "depth_charts": {"key": "o_orderkey", "gsis_id": "concat('G', o_custkey + 40)"},
}


def hydrated(t: Tables) -> dict[str, DataFrame]:
    return identity.hydrate_all({n: derived(t.orders, c) for n, c in HYDRATED.items()}, derived(t.customer, MAPPING))


def _raw(name: str) -> str:
    return f"({sql_of(HYDRATED[name], 'orders')})".replace("AS string", "AS VARCHAR")


HYDRATED_SQL = f"""m AS ({sql_of(MAPPING, 'customer').replace('AS string', 'AS VARCHAR')}),
    by_gsis AS (SELECT gsis_id, max(yamplayer_id) AS hi, min(yamplayer_id) AS lo FROM m WHERE gsis_id IS NOT NULL GROUP BY 1), by_pfr AS (SELECT pfr_id, max(yamplayer_id) AS hi, min(yamplayer_id) AS lo FROM m WHERE pfr_id IS NOT NULL GROUP BY 1),
    by_college AS (SELECT merge_name, college, min(yamplayer_id) AS lo FROM m GROUP BY 1, 2), by_birth AS (SELECT birthdate, merge_name, min(yamplayer_id) AS lo FROM m GROUP BY 1, 2), once AS (SELECT merge_name, max(yamplayer_id) AS hi FROM m GROUP BY 1 HAVING count(*) = 1),
    h AS (
        SELECT 'combine' AS dataset, key, coalesce(p.lo, c.lo) AS yamplayer_id FROM {_raw('combine')} x LEFT JOIN by_pfr p USING (pfr_id) LEFT JOIN by_college c ON {name_sql('player_name')} = c.merge_name AND {college_sql('school')} = c.college UNION ALL
        SELECT 'rosters', key, coalesce(g.lo, p.lo, b.lo) FROM {_raw('rosters')} x LEFT JOIN by_gsis g USING (gsis_id) LEFT JOIN by_pfr p ON x.pfr_id = p.pfr_id LEFT JOIN by_birth b ON x.birth_date = b.birthdate AND {name_sql('full_name')} = b.merge_name UNION ALL
        SELECT 'player_stats', key, coalesce(g.hi, o.hi) FROM {_raw('player_stats')} x LEFT JOIN by_gsis g ON player_id = g.gsis_id LEFT JOIN once o ON {name_sql('player_display_name')} = o.merge_name UNION ALL
        SELECT 'snap_counts', key, p.hi FROM {_raw('snap_counts')} x LEFT JOIN by_pfr p ON pfr_player_id = p.pfr_id UNION ALL
        SELECT 'rosters_weekly', key, coalesce(g.hi, p.hi) FROM {_raw('rosters_weekly')} x LEFT JOIN by_gsis g USING (gsis_id) LEFT JOIN by_pfr p ON x.pfr_id = p.pfr_id UNION ALL
        SELECT 'depth_charts', key, g.hi FROM {_raw('depth_charts')} x LEFT JOIN by_gsis g USING (gsis_id))"""


@query(f"WITH {HYDRATED_SQL} SELECT * FROM h")
def hydrate_tiers(spark, sf_dir):
    out = None
    for name, df in hydrated(Tables(spark, sf_dir)).items():
        part = df.select(F.lit(name).alias("dataset"), "key", identity.ID)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {HYDRATED_SQL} SELECT dataset, count(*) AS rows, round(avg((yamplayer_id IS NOT NULL)::INT) * 100, 6) AS matched_pct FROM h GROUP BY dataset")
def match_report(spark, sf_dir):
    return identity.match_report(hydrated(Tables(spark, sf_dir))).withColumn("matched_pct", F.round("matched_pct", 6))


@query("""
    WITH x AS (SELECT DISTINCT o_custkey % 500 AS pfr_id, o_custkey AS gsis_id FROM orders), f AS (SELECT pfr_id, min(gsis_id) AS gsis_id FROM x GROUP BY 1)
    SELECT p_partkey, p_partkey % 600 AS pfr_id, gsis_id FROM part LEFT JOIN f ON p_partkey % 600 = pfr_id""")
def id_crosswalk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ids = t.orders.select((F.col("o_custkey") % 500).alias("pfr_id"), F.col("o_custkey").alias("gsis_id"))
    return identity.crosswalk(t.part.select("p_partkey", (F.col("p_partkey") % 600).alias("pfr_id")), ids)


# --- athletic scores ------------------------------------------------------------------------------------------

PARTS = {
    "player": "p_partkey",
    "pos": "CASE p_partkey % 8 WHEN 0 THEN 'QB' WHEN 1 THEN 'LT' WHEN 2 THEN 'ILB' WHEN 3 THEN 'OLB' WHEN 4 THEN 'CB/WR' WHEN 5 THEN 'SAF' WHEN 6 THEN 'WR' ELSE 'XX' END",
    "draft_year": "CASE WHEN p_partkey % 50 = 0 THEN 'none' ELSE CAST(1997 + p_partkey % 9 AS string) END",
    "bench": "CASE WHEN p_size > 8 THEN CAST(p_size AS double) END",
    "broad_jump": "CASE WHEN p_size % 5 > 0 THEN p_retailprice END",
    "cone": "CASE WHEN p_size % 3 > 0 THEN CAST(p_size % 17 AS double) END",
    "forty": "CAST(NULL AS double)",
    "ht": "concat(CAST(5 + p_size % 2 AS string), '-', CAST(p_size % 12 AS string))",
    "shuttle": "CAST(p_partkey % 13 AS double)",
    "vertical": "CASE WHEN p_size % 7 > 0 THEN CAST(p_partkey % 29 AS double) END",
    "wt": "p_retailprice",
}


def _pct(m: str, up: bool, by: str = "calculation_type, calculation_year, calculation_position") -> str:
    order = f"{m} NULLS LAST" if up else f"{m} DESC NULLS LAST"
    return f"CASE WHEN {m} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY {by} ORDER BY {order}) + (count({m}) OVER (PARTITION BY {by}, {m}) - 1) / 2.0) / count({m}) OVER (PARTITION BY {by}) * 10 END"


MEASURES = list(athletic.MEASURES)
GROUP_ROWS = ", ".join(f"('{g}', '{p}')" for g, ps in athletic.GROUPS.items() for p in ps)
SCORES = f"""c AS ({sql_of(PARTS, 'part').replace('AS string', 'AS VARCHAR')}), y AS (SELECT *, try_cast(draft_year AS INT) AS y FROM c),
    copies AS (SELECT *, 'historical' AS calculation_type, y AS calculation_year FROM y WHERE y BETWEEN 2000 AND 2004 UNION ALL SELECT *, 'current', 2004 FROM y WHERE y <= 2004),
    groups(g, p) AS (VALUES {GROUP_ROWS}), e AS (SELECT copies.*, g AS calculation_position, CASE pos WHEN 'LT' THEN 'OT' WHEN 'ILB' THEN 'LB' WHEN 'OLB' THEN 'EDGE' WHEN 'SAF' THEN 'S' ELSE pos END AS yas_position FROM copies JOIN groups ON pos = p),
    r AS (SELECT *, {', '.join(f'{_pct(m, up)} AS {m}_percentile' for m, up in athletic.MEASURES.items())} FROM e),
    n AS (SELECT *, {' + '.join(f'({m}_percentile IS NOT NULL)::INT' for m in MEASURES)} AS measurables_present, {' + '.join(f'coalesce({m}_percentile, 0.0)' for m in MEASURES)} AS total FROM r),
    q AS (SELECT *, total / nullif(measurables_present, 0) AS yas_score_unnormallized FROM n),
    scores AS (SELECT *, {_pct('yas_score_unnormallized', True)} AS yas_score FROM q)"""
PERCENTILES = ", ".join(f"round({m}_percentile, 6) AS {m}_percentile" for m in MEASURES)


def athletic_frame(t: Tables) -> DataFrame:
    return athletic.athletic_scores(derived(t.part, PARTS), 2004)


@query(f"WITH {SCORES} SELECT player, calculation_type, calculation_year, calculation_position, yas_position, measurables_present, {PERCENTILES}, round(yas_score_unnormallized, 6) AS yas_score_unnormallized, round(yas_score, 6) AS yas_score FROM scores")
def athletic_scores(spark, sf_dir):
    rounded = [f"{m}_percentile" for m in MEASURES] + ["yas_score_unnormallized", "yas_score"]
    out = athletic_frame(Tables(spark, sf_dir)).withColumns(r6(*rounded))
    return out.select("player", "calculation_type", "calculation_year", "calculation_position", "yas_position", "measurables_present", *rounded)


@query(f"WITH {SCORES} SELECT player, yas_position, measurables_present, round(yas_score, 6) AS yas_score FROM scores WHERE calculation_position = yas_position AND calculation_type = 'current' AND measurables_present >= 5")
def score_leaders(spark, sf_dir):
    return athletic.score_leaders(athletic_frame(Tables(spark, sf_dir))).select("player", "yas_position", "measurables_present", F.round("yas_score", 6).alias("yas_score"))


@query("""
    WITH v AS (SELECT p_partkey, p_brand, nullif(p_retailprice, 950.0) AS v FROM part)
    SELECT p_partkey, round(CASE WHEN v IS NULL THEN NULL ELSE (1 - (rank() OVER (PARTITION BY p_brand ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY p_brand, v) - 1) / 2.0) / count(v) OVER (PARTITION BY p_brand)) * 10 END, 6) AS pct FROM v""")
def pct_reversed(spark, sf_dir):
    v = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", F.nullif(F.col("p_retailprice"), F.lit(950.0)).alias("v"))
    return v.select("p_partkey", F.round(fn.percentile_reversed("v", ["p_brand"]), 6).alias("pct"))


# --- depth charts, tenures, pages, documents ------------------------------------------------------------------

CHART = {
    "season": "CASE WHEN o_orderstatus = 'F' THEN CAST(year(o_orderdate) AS string) WHEN o_orderstatus = 'O' THEN ' ' END",
    "dt": "CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(o_orderdate AS string) END",
    "club_code": "concat('T', o_custkey % 25)",
    "team": "concat('T', o_custkey % 25)",
    "gsis_id": "CAST(o_orderkey AS string)",
    "depth_position": "concat(o_orderpriority, '\n', o_orderstatus)",
    "other": "'x'",
}


@query("""
    WITH c AS (SELECT o_orderkey::VARCHAR AS gsis_id, 'T' || o_custkey % 25 AS team, o_orderstatus AS s, o_orderpriority AS p FROM orders)
    SELECT 'legacy' AS side, gsis_id, team, p || ' ' || s AS depth_position FROM c WHERE s = 'F' UNION ALL SELECT 'modern', gsis_id, team, NULL FROM c WHERE s <> 'F' AND p <> '5-LOW'""")
def split_depth_charts(spark, sf_dir):
    legacy, modern = tenure.split_depth_charts(derived(Tables(spark, sf_dir).orders, CHART))
    legacy = legacy.select(F.lit("legacy").alias("side"), "gsis_id", F.col("club_code").alias("team"), "depth_position")
    return legacy.unionByName(modern.select(F.lit("modern").alias("side"), "gsis_id", "team"), allowMissingColumns=True)


@query("""
    SELECT c_name AS Person, 'T' || c_nationkey AS pfr_team_code, CASE WHEN c_nationkey < 20 THEN 'N' || c_nationkey END AS nflverse_code, CASE WHEN c_nationkey < 20 THEN n_name END AS team_name, (1980 + c_custkey % 20)::INT AS "From",
           CASE WHEN c_custkey % 3 > 0 THEN (1990 + c_custkey % 30)::INT END AS "To", CASE WHEN c_custkey % 3 > 0 THEN (11 + c_custkey % 30 - c_custkey % 20)::INT END AS tenure_years, c_custkey % 3 = 0 AS is_current
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def tenures(spark, sf_dir):
    t = Tables(spark, sf_dir)
    people = derived(t.customer, {"Person": "c_name", "pfr_team_code": "concat('T', c_nationkey)", "From": "CAST(1980 + c_custkey % 20 AS string)", "To": "CASE WHEN c_custkey % 3 > 0 THEN concat(1990 + c_custkey % 30, '.0') ELSE '' END"})
    codes = derived(t.nation, {"pfr_code": "CASE WHEN n_nationkey < 20 THEN concat('T', n_nationkey) END", "nflverse_code": "concat('N', n_nationkey)", "team_name": "n_name"})
    return tenure.tenures(people, codes)


@query("""
    WITH p AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'DEF' WHEN 1 THEN 'QB' ELSE 'WR' END AS position FROM customer), k AS (SELECT *, abs(c_acctbal) AS fpts FROM p WHERE c_custkey % 10 > 0)
    SELECT c_name AS player_name, CASE WHEN c_custkey % 3 > 0 THEN 'T' || c_nationkey ELSE 'FA' END AS team, position, fpts FROM k WHERE position <> 'DEF'
    UNION ALL SELECT n, coalesce('T' || nullif(c_nationkey, 24), 'FA'), position, fpts FROM (SELECT DISTINCT CASE WHEN c_nationkey < 24 THEN 'ATION_' || c_nationkey || '.' ELSE 'nobody' END AS n, c_nationkey, position, fpts FROM k WHERE position = 'DEF')""")
def projection_pages(spark, sf_dir):
    """A page for each customer, with the table of projections as the second of two, and a row that is no number."""
    t = Tables(spark, sf_dir)
    number = "CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE format_number(abs(c_acctbal), 2) END"
    who = "CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_nationkey < 24 THEN concat('ATION_', c_nationkey, '.') ELSE 'nobody' END ELSE concat(c_name, CASE WHEN c_custkey % 3 > 0 THEN concat(' T', c_nationkey) ELSE '' END) END"
    html = f"concat('<p>x</p><table><tr><td>1</td></tr></table><table><tr><th>a</th></tr><tr><th>Player</th><th>FPTS</th></tr><tr><td><b>', {who}, '</b></td><td>', {number}, '</td></tr><tr><td>short</td></tr></table>')"
    pages = derived(t.customer, {"page_id": "c_custkey", "position": "CASE c_custkey % 4 WHEN 0 THEN 'DEF' WHEN 1 THEN 'QB' ELSE 'WR' END", "html": html})
    codes = derived(t.nation, {"team_name": "concat('The N', substring(n_name, 2), '.')", "nflverse_code": "concat('T', n_nationkey)"})
    return documents.projections(pages, codes)


@query("""
    WITH d AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 ELSE 1 END AS qb, CASE WHEN c_custkey % 2 = 0 THEN 8 + c_custkey % 12 END AS rounds FROM customer)
    SELECT 'd' || k AS draft_id, (k % 5 * 2) AS order_u, qb, CASE WHEN rounds IS NULL THEN CASE WHEN k % 5 = 1 THEN 9 ELSE 6 END ELSE greatest(rounds - (qb + 2 + 2 + 1 + 1 + 1 + 1), 0) END AS bench FROM d""")
def draft_documents(spark, sf_dir):
    doc = """concat('{"draft_id": "d', c_custkey, '", "draft_order": {"u": ', c_custkey % 5 * 2, '}, "settings": {"teams": 12', CASE WHEN c_custkey % 3 > 0 THEN concat(', "slots_qb": ', c_custkey % 4) ELSE '' END,
        CASE WHEN c_custkey % 2 = 0 THEN concat(', "rounds": ', 8 + c_custkey % 12) ELSE '' END, CASE WHEN c_custkey % 5 = 1 THEN ', "slots_bn": 9' ELSE '' END, '}}')"""
    out = documents.parse_draft(derived(Tables(spark, sf_dir).customer, {"value": doc}))
    return out.select("draft_id", F.col("draft_order")["u"].cast("bigint").alias("order_u"), F.col("roster.qb").cast("bigint").alias("qb"), F.col("roster.bench").cast("bigint").alias("bench"))


@query("""
    WITH t AS (SELECT p_partkey, p_name || ' ' || p_brand AS raw, p_name || ',' || p_type AS place, ' ' || p_name || chr(13) || chr(10) || chr(10) || p_type || ' ' AS lines FROM part)
    SELECT p_partkey, array_to_string(w[:-2], ' ') AS name, w[-1] AS team, replace(place, ',', '%2C') AS url, trim(regexp_replace(lines, '[\\r\\n]+', ' ', 'g')) AS line, round(exp(-0.5 * z * z), 6) AS weight
    FROM (SELECT *, string_split_regex(trim(raw), '\\s+') AS w, (p_partkey % 40 - 20) / greatest((p_partkey % 5)::DOUBLE, 1.0) AS z FROM t)""")
def text_and_weights(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    name, team = fn.team_suffix(F.concat_ws(" ", "p_name", "p_brand"))
    weight = fn.bernoulli_weight(F.col("p_partkey") % 40, F.lit(20.0), (F.col("p_partkey") % 5).cast("double"))
    return p.select("p_partkey", name.alias("name"), team.alias("team"), fn.url_safe(F.concat_ws(",", "p_name", "p_type")).alias("url"), fn.one_line(F.concat(F.lit(" "), "p_name", F.lit("\r\n\n"), "p_type", F.lit(" "))).alias("line"), F.round(weight, 6).alias("weight"))


# --- the pool and free agents ---------------------------------------------------------------------------------

POSITION = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT.items()) + " END"
SOURCES = {
    "players": ("customer", {"yamplayer_id": "concat('Y', c_custkey)", "display_name": "c_name", "position": POSITION, "latest_team": "CASE WHEN c_nationkey < 24 THEN concat('T', c_nationkey) END"}),
    "ff_playerids": ("customer", {"fantasypros_id": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey END", "yamplayer_id": "concat('Y', c_custkey)", "sleeper_id": "concat('S', c_custkey)", "gsis_id": "CASE WHEN c_custkey % 9 > 0 THEN concat('G', c_custkey) END", "name": "c_name", "position": POSITION}),
    "ff_rankings": ("customer", {"id": "CAST(c_custkey AS string)", "player": "concat(' ', upper(c_name))", "pos": POSITION, "ecr_type": "CASE WHEN c_custkey % 10 = 9 THEN 'wk' ELSE 'ro' END", "ecr": "c_custkey * 37 % 997 + 0.5", "sd": "CASE WHEN c_custkey % 4 > 0 THEN 1.0 + c_custkey % 7 END", "team": "concat('T', c_nationkey)"}),
    "dst_rankings": ("nation", {"id": "CAST(NULL AS string)", "player": "n_name", "pos": "'DST'", "ecr_type": "'ro'", "ecr": "100.5 + n_nationkey", "sd": "2.0", "team": "concat('T', n_nationkey)"}),
    "ff_projections": ("customer", {"player_name": "CASE WHEN c_custkey % 3 = 0 THEN 'nobody' ELSE lower(c_name) END", "position": POSITION, "team": "concat('T', c_nationkey)", "fpts_ppr": "abs(c_acctbal) / 32", "fpts_half_ppr": "abs(c_acctbal) / 64", "fpts_std": "abs(c_acctbal) / 128"}),
    "dst_projections": ("nation", {"player_name": "n_name", "position": "'DEF'", "team": "concat('T', n_nationkey)", "fpts_ppr": "n_nationkey * 4.0", "fpts_half_ppr": "0.0", "fpts_std": "0.0"}),
    "injuries": ("events", {"yamplayer_id": "concat('Y', user_id)", "gsis_id": "concat('G', user_id)", "season": "CASE WHEN event_id % 3 = 0 THEN 1995 ELSE 1994 END", "report_status": "CASE WHEN event_type <> 'error' THEN event_type END", "date_modified": "ts"}),
    "schedules": ("orders", {"season": "year(o_orderdate)", "game_type": "CASE WHEN o_orderstatus = 'F' THEN 'REG' ELSE 'PRE' END", "week": "day(o_orderdate)", "home_team": "concat('T', o_custkey % 25)", "away_team": "concat('T', o_orderkey % 25)"}),
    "player_stats": ("orders JOIN customer ON o_custkey = c_custkey", {
        "player_id": "concat('G', o_custkey)", "yamplayer_id": "concat('Y', o_custkey)", "player_display_name": "c_name", "position": POSITION, "team": "concat('T', c_nationkey)", "season": "year(o_orderdate)", "season_type": "CASE WHEN o_orderstatus = 'P' THEN 'POST' ELSE 'REG' END", "week": "month(o_orderdate)",
        "fantasy_points": "o_totalprice / 16384", "fantasy_points_ppr": "CASE WHEN o_orderkey % 17 > 0 THEN o_totalprice / 8192 END", "receptions": "CAST(o_orderkey % 9 AS double)", "carries": "CAST(o_orderkey % 4 AS double)", "passing_yards": "CAST(o_orderkey % 7 * 10 AS double)", "target_share": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 32 / 32.0 END", "opponent_team": "CASE WHEN o_orderkey % 6 > 0 THEN concat('T', o_orderkey % 25) END",
    }),
    "snap_counts": ("orders", {"yamplayer_id": "concat('Y', o_custkey)", "season": "year(o_orderdate)", "week": "month(o_orderdate)", "offense_pct": "o_orderkey % 16 / 16.0"}),
    "ff_opportunity": ("orders", {"player_id": "concat('G', o_custkey)", "season": "year(o_orderdate)", "week": "month(o_orderdate)", "total_fantasy_points_diff": "o_orderkey % 64 / 4.0 - 8"}),
}


def season_tables(t: Tables) -> dict[str, DataFrame]:
    found = {}
    for name, (source, columns) in SOURCES.items():
        first, _, rest = source.partition(" JOIN ")
        df = getattr(t, first)
        if rest:
            df = df.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        found[name] = derived(df, columns)
    for part, whole in (("dst_rankings", "ff_rankings"), ("dst_projections", "ff_projections")):
        found[whole] = found[whole].unionByName(found.pop(part))
    return found


SEASON_SQL = ", ".join(f"{n}0 AS ({sql_of(c, s)})".replace("AS string", "AS VARCHAR") for n, (s, c) in SOURCES.items()) + ", rankings AS (SELECT * FROM ff_rankings0 UNION ALL SELECT * FROM dst_rankings0), projections AS (SELECT * FROM ff_projections0 UNION ALL SELECT * FROM dst_projections0)"
POOL_SQL = f"""{SEASON_SQL},
    games AS (SELECT * FROM schedules0 WHERE season = 1995 AND game_type = 'REG'), played AS (SELECT home_team AS team, week FROM games UNION SELECT away_team, week FROM games),
    byes AS (SELECT team, week AS bye_week FROM (SELECT DISTINCT team FROM played) CROSS JOIN (SELECT DISTINCT week FROM played) WHERE (team, week) NOT IN (SELECT (team, week) FROM played)),
    found AS (SELECT coalesce(a.yamplayer_id, b.yamplayer_id) AS yamplayer_id, coalesce(a.sleeper_id, b.sleeper_id) AS sleeper_id, ecr::DOUBLE AS ecr, sd::DOUBLE AS sd FROM rankings r LEFT JOIN ff_playerids0 a ON r.id = a.fantasypros_id::VARCHAR
        LEFT JOIN ff_playerids0 b ON a.fantasypros_id IS NULL AND lower(trim(r.player)) = lower(trim(b.name)) AND r.pos = b.position WHERE ecr_type = 'ro'),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY yamplayer_id ORDER BY ecr NULLS LAST, sleeper_id NULLS LAST) AS rn FROM found WHERE yamplayer_id IS NOT NULL) WHERE rn = 1),
    points AS (SELECT yamplayer_id, sum(fantasy_points_ppr) AS season_points FROM player_stats0 WHERE season = 1995 AND season_type = 'REG' GROUP BY 1),
    hurt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY yamplayer_id ORDER BY date_modified DESC NULLS LAST, report_status) AS rn FROM injuries0 WHERE report_status IS NOT NULL) WHERE rn = 1),
    guess AS (SELECT yamplayer_id, fpts_half_ppr AS projection FROM projections p JOIN ff_playerids0 i ON lower(trim(p.player_name)) = lower(trim(i.name)) WHERE p.position <> 'DEF'),
    skill AS (SELECT p.yamplayer_id AS player_id, display_name AS name, position, latest_team AS team, coalesce(projection, season_points) AS projected_points, ecr AS adp, sd AS adp_std, bye_week, round_even(ecr, 0)::BIGINT AS ecr_rank, h.report_status AS injury_status, sleeper_id
        FROM players0 p JOIN best USING (yamplayer_id) LEFT JOIN guess USING (yamplayer_id) LEFT JOIN points USING (yamplayer_id) LEFT JOIN hurt h USING (yamplayer_id) LEFT JOIN byes ON latest_team = team),
    dst AS (SELECT 'DST_' || r.team, player, 'DEF', r.team, p.fpts_ppr::DOUBLE, ecr::DOUBLE, sd::DOUBLE, bye_week, round_even(ecr::DOUBLE, 0)::BIGINT, NULL, NULL FROM rankings r LEFT JOIN byes ON r.team = byes.team LEFT JOIN projections p ON p.position = 'DEF' AND p.team = r.team WHERE pos = 'DST')"""


@query(f"""
    WITH {POOL_SQL}, u AS (SELECT * FROM skill UNION ALL SELECT * FROM dst)
    SELECT player_id, name, position, coalesce(team, 'FA') AS team, round(coalesce(projected_points, 0.0), 6) AS projected_points, adp, coalesce(adp_std, 5.0) AS adp_std, bye_week, ecr_rank, injury_status, sleeper_id FROM u""")
def player_pool(spark, sf_dir):
    return pool.player_pool(season_tables(Tables(spark, sf_dir)), 1995, "half_ppr").withColumn("projected_points", F.round("projected_points", 6))


def _norm(x: str, invert: bool = False, null: float = 0.0) -> str:
    scaled = f"({x} - min({x}) OVER p) / CASE WHEN max({x}) OVER p = min({x}) OVER p THEN 1.0 ELSE max({x}) OVER p - min({x}) OVER p END"
    return f"coalesce({'1 - ' if invert else ''}{scaled}, {null})"


AGENTS_SQL = f"""{SEASON_SQL},
    v AS (SELECT *, coalesce(fantasy_points, 0.0) + 0.5 * coalesce(receptions, 0.0) AS value, carries / nullif(carries + receptions + passing_yards / 10, 0) AS rush FROM player_stats0 WHERE season = 1995 AND season_type = 'REG'),
    w AS (SELECT player_id, week, max(player_display_name) AS player_name, max(position) AS position, max(team) AS team, max(yamplayer_id) AS yamplayer_id, max(value) AS fpts, max(coalesce(target_share, 0.0)) AS target_share, max(coalesce(rush, 0.0)) AS rush_share FROM v WHERE week BETWEEN 4 AND 9 GROUP BY 1, 2),
    f AS (SELECT player_id, max(player_name) AS player_name, max(position) AS position, max(team) AS team, max(yamplayer_id) AS yamplayer_id, avg(target_share) AS ts, avg(rush_share) AS rs, count(*) AS weeks_analyzed, avg(fpts) AS mean_points, coalesce(stddev_samp(fpts), 0.0) AS std_points,
        CASE WHEN count(*) >= 2 AND avg(fpts) > 0 THEN stddev_samp(fpts) / avg(fpts) END AS cv, CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(fpts, week), 0.0) ELSE 0.0 END AS trend FROM w GROUP BY 1),
    sn AS (SELECT yamplayer_id, avg(offense_pct) AS snap FROM snap_counts0 WHERE season = 1995 AND week BETWEEN 4 AND 9 GROUP BY 1), ex AS (SELECT player_id, avg(total_fantasy_points_diff) AS vs FROM ff_opportunity0 WHERE season = 1995 AND week BETWEEN 4 AND 9 GROUP BY 1),
    ids AS (SELECT gsis_id AS player_id, sleeper_id, ecr AS ecr_rank FROM ff_playerids0 LEFT JOIN (SELECT * FROM rankings WHERE ecr_type = 'ro') r ON fantasypros_id::VARCHAR = r.id WHERE gsis_id IS NOT NULL),
    hurt AS (SELECT * FROM (SELECT gsis_id AS player_id, report_status AS injury_status, row_number() OVER (PARTITION BY gsis_id ORDER BY date_modified DESC NULLS LAST, report_status) AS rn FROM injuries0 WHERE report_status IS NOT NULL AND season = 1995) WHERE rn = 1),
    allowed AS (SELECT opponent_team AS opponent, position, avg(value) AS allowed FROM v WHERE week < 10 AND opponent_team IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT * FROM schedules0 WHERE season = 1995 AND game_type = 'REG' AND week BETWEEN 10 AND 13), sides AS (SELECT home_team AS team, away_team AS opponent FROM g UNION ALL SELECT away_team, home_team FROM g),
    sq AS (SELECT team, p.position, avg(coalesce(allowed, 0.0)) AS sq FROM sides CROSS JOIN (VALUES ('QB'), ('RB'), ('WR'), ('TE'), ('K')) p(position) LEFT JOIN allowed a ON sides.opponent = a.opponent AND p.position = a.position GROUP BY 1, 2),
    taken AS (SELECT DISTINCT 'S' || user_id AS sleeper_id FROM events), open AS (SELECT DISTINCT sleeper_id FROM ff_playerids0 WHERE sleeper_id NOT IN (SELECT sleeper_id FROM taken)),
    j AS (SELECT f.*, coalesce(vs, 0.0) AS vs, sleeper_id, ecr_rank, injury_status, coalesce(sq, 0.0) AS sq, 0.5 * coalesce(snap, 0.0) + 0.5 * CASE WHEN position = 'RB' THEN rs ELSE ts END AS opp FROM f LEFT JOIN sn USING (yamplayer_id) LEFT JOIN ex USING (player_id) LEFT JOIN ids USING (player_id) LEFT JOIN hurt USING (player_id) LEFT JOIN sq USING (team, position)
        WHERE sleeper_id IN (SELECT sleeper_id FROM open)),
    n AS (SELECT *, {_norm('mean_points')} AS n1, {_norm('cv', True, 0.5)} AS n2, {_norm('vs')} AS n3, {_norm('opp')} AS n4, {_norm('trend')} AS n5, {_norm('sq')} AS n6 FROM j WINDOW p AS (PARTITION BY position))"""


@query(f"""
    WITH {AGENTS_SQL}, adds AS (SELECT 'S' || l_partkey AS sleeper_id, count(*) AS c FROM lineitem GROUP BY 1)
    SELECT player_id, player_name, position, team, sleeper_id, ecr_rank, injury_status, weeks_analyzed, round(mean_points, 5) AS mean_points, round(opp, 5) AS mean_opportunity, round(sq, 5) AS schedule_quality, round(vs, 5) AS mean_vs_expectation,
           round(0.3 * n1 + 0.25 * n2 + 0.2 * n3 + 0.1 * n4 + 0.1 * n5 + 0.05 * n6, 4) AS composite, coalesce(c, 0) AS trending_adds FROM n LEFT JOIN adds USING (sleeper_id)""")
def free_agents(spark, sf_dir):
    """All six parts, over players on no roster; rosters are arrays of ids, from the events' users."""
    t = Tables(spark, sf_dir)
    tables = season_tables(t)
    held = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("events")).withColumn("team", F.floor(F.col("user_id") / 100))  # a roster holds a hundred players at most, however many users there are
    rosters = held.groupBy("event_type", "team").agg(F.collect_list(F.concat(F.lit("S"), "user_id")).alias("players"))
    trending = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("count")).select(F.concat(F.lit("S"), "l_partkey").alias("sleeper_id"), "count")
    out = inseason.free_agents(tables, 1995, 10, "half_ppr", inseason.unrostered(tables["ff_playerids"], rosters), trending, lookback=6)
    rounded = {c: F.round(c, 5) for c in ("mean_points", "mean_opportunity", "schedule_quality", "mean_vs_expectation")} | {"composite": F.round("composite", 4)}
    return out.withColumns(rounded).select("player_id", "player_name", "position", "team", "sleeper_id", "ecr_rank", "injury_status", "weeks_analyzed", *rounded, "trending_adds")


# --- drafts ---------------------------------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT range AS pick FROM range(1, 181)), o AS (SELECT pick, CASE WHEN ((pick - 1) // 12) % 2 = 0 THEN (pick - 1) % 12 + 1 ELSE 12 - (pick - 1) % 12 END AS slot FROM range(1, 220) t(pick))
    SELECT p.pick, least(min(o.pick) - p.pick, 12) AS picks_until_user FROM p JOIN o ON o.pick >= p.pick AND slot = 5 GROUP BY p.pick""")
def picks_until_user(spark, sf_dir):
    return league.user_turns(spark, 12, 15, 5)


@query(f"""
    WITH {DRAFT_POOL}, slots(position, n) AS (VALUES ('QB', 1), ('RB', 2), ('WR', 3), ('TE', 1), ('K', 1)), r AS (SELECT p.*, c_nationkey AS team, n FROM pool p JOIN customer ON player_id = c_custkey JOIN slots USING (position)),
    a AS (SELECT *, row_number() OVER (PARTITION BY team, position ORDER BY projected_points DESC, player_id) <= n AS own FROM r),
    f AS (SELECT *, NOT own AND position IN ('RB', 'WR', 'TE') AS open FROM a), g AS (SELECT *, row_number() OVER (PARTITION BY team, open ORDER BY projected_points DESC, player_id) AS k FROM f)
    SELECT team, round(sum(CASE WHEN own OR (open AND k <= 1) THEN projected_points ELSE 0 END), 4) AS total_points FROM g GROUP BY team""")
def lineup_points(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rosters = draft_pool(t).join(t.customer.select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team")), "player_id")
    return draft.lineup_points(rosters, LEAGUE.roster, ["team"]).withColumn("total_points", F.round("total_points", 4))


@query("""
    WITH k AS (SELECT o_orderkey, o_custkey, o_orderpriority AS p, o_custkey % 25 AS n FROM orders)
    SELECT o_orderkey, CASE WHEN p = '5-LOW' THEN 'DST_T' || n WHEN c_custkey IS NOT NULL THEN 'Y' || o_custkey ELSE 'unknown_S' || o_custkey END AS player_id, CASE WHEN p = '5-LOW' THEN n_name WHEN c_custkey IS NOT NULL THEN c_name ELSE 'Unknown (RB)' END AS name,
           CASE WHEN p = '5-LOW' THEN 'DEF' WHEN c_custkey IS NOT NULL THEN 'WR' ELSE 'RB' END AS position, CASE WHEN p = '5-LOW' THEN 7.0 WHEN c_custkey IS NOT NULL THEN c_acctbal ELSE 0.0 END AS projected_points
    FROM k LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON n = n_nationkey""")
def resolved_picks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    made = derived(t.orders, {"o_orderkey": "o_orderkey", "player_id": "concat('S', o_custkey)", "position": "CASE WHEN o_orderpriority = '5-LOW' THEN 'DST' ELSE 'RB' END", "team": "concat('T', o_custkey % 25)"})
    known = derived(t.customer.filter("c_acctbal > 0"), {"player_id": "concat('Y', c_custkey)", "sleeper_id": "concat('S', c_custkey)", "name": "c_name", "position": "'WR'", "team": "'T0'", "projected_points": "c_acctbal"})
    defences = derived(t.nation, {"player_id": "concat('DST_T', n_nationkey)", "sleeper_id": "CAST(NULL AS string)", "name": "n_name", "position": "'DEF'", "team": "concat('T', n_nationkey)", "projected_points": "CAST(7.0 AS double)"})
    return picks.resolve_picks(made, known.unionByName(defences)).select("o_orderkey", "player.player_id", "player.name", "player.position", "player.projected_points")


@query("""
    WITH p AS (SELECT 'd' || c_custkey % 20 AS draft_id, c_custkey // 20 + 1 AS pick_no, c_name FROM customer), s AS (SELECT *, CASE WHEN ((pick_no - 1) // 12) % 2 = 0 THEN (pick_no - 1) % 12 + 1 ELSE 12 - (pick_no - 1) % 12 END AS slot FROM p), t AS (SELECT draft_id, max(pick_no) AS picks, string_agg(c_name, ',' ORDER BY pick_no) FILTER (slot = 3) AS third FROM s GROUP BY 1)
    SELECT draft_id, picks, picks + 1 AS current_pick, CASE WHEN picks + 1 > 600 THEN 0 WHEN (picks // 12) % 2 = 0 THEN picks % 12 + 1 ELSE 12 - picks % 12 END AS on_the_clock, picks + 1 > 600 AS is_complete, coalesce(third, '') AS third FROM t""")
def state_fold(spark, sf_dir):
    """Picks of twenty drafts as a file stream, folded into draft states by the stateful operator, once to the stream's end."""
    made = derived(table_stream(spark, sf_dir, "customer"), {"draft_id": "concat('d', c_custkey % 20)", "pick_no": "CAST(c_custkey DIV 20 + 1 AS int)", "player_id": "c_name"})
    last = fn.keep_first(taken_once(drafts.fold_states(made, 12, 50, "append"), drafts.STATE), ["draft_id"], F.desc("picks"))
    third = F.array_join(F.coalesce(F.from_json("rosters", "map<string, array<string>>")["3"], F.array().cast("array<string>")), ",")
    return last.select("draft_id", "picks", "current_pick", "on_the_clock", "is_complete", third.alias("third"))


def table_stream(spark, sf_dir, name):
    """A table's files as a stream."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet")


def taken_once(stream, schema):
    """All a stream gives until its end, committed to an event log in the shared folder and read back."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    drafts.write_events(stream, f"{path}/log", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return drafts.read_events(spark, f"{path}/log", schema)


@query("""
    WITH p AS (SELECT 'd' || event_id // 180 AS draft_id, CAST(event_id * 7 % 180 + 1 AS INTEGER) AS pick_no, 'Y' || (event_id * 31 % 400) AS player_id FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY draft_id ORDER BY pick_no) AS place FROM p),
    k AS (SELECT *, (pick_no - 1) // 12 AS turn, (pick_no - 1) % 12 AS place_in, list(player_id) OVER (PARTITION BY draft_id ORDER BY pick_no) AS taken FROM r WHERE place = pick_no),
    e AS (SELECT *, unnest(CASE WHEN pick_no = 180 THEN ['pick', 'complete'] ELSE ['pick'] END) AS event FROM k)
    SELECT draft_id, event, pick_no, CAST(turn + 1 AS INTEGER) AS round, CAST(CASE WHEN turn % 2 = 0 THEN place_in + 1 ELSE 12 - place_in END AS INTEGER) AS slot, player_id, pick_no + 1 AS current_pick,
           CAST(CASE WHEN pick_no = 180 THEN 0 WHEN pick_no // 12 % 2 = 0 THEN pick_no % 12 + 1 ELSE 12 - pick_no % 12 END AS INTEGER) AS on_the_clock, pick_no = 180 AS is_complete,
           array_to_string(list_filter((SELECT list('Y' || x ORDER BY x) FROM range(183) t(x)), lambda y: NOT list_contains(taken, y))[1:3], ',') AS top
    FROM e""")
def draft_events(spark, sf_dir):
    """Events as the picks of drafts of 180, out of order: folded in order, an event each, a complete one last, with the best three left. The last draft has gaps, so its picks beyond the first gap wait in the state."""
    made = derived(table_stream(spark, sf_dir, "events"), {"draft_id": "concat('d', event_id DIV 180)", "pick_no": "CAST(event_id * 7 % 180 + 1 AS int)", "player_id": "concat('Y', event_id * 31 % 400)"})
    events = taken_once(drafts.fold_events(made, 12, 15), drafts.EVENT)
    ranked = drafts.with_candidates(events, [f"Y{i}" for i in range(183)], 3)
    return ranked.withColumn("top", F.array_join("top", ",")).drop("batch")


@query("""
    WITH r AS (SELECT c_custkey, c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), later(m) AS (VALUES (23), (24), (47), (48))
    SELECT c.c_custkey::VARCHAR AS player_id, round(any_value(c.v) + sum(o.v), 2) AS mean_score, 0.0 AS std_score, 20 AS n_simulations
    FROM r c CROSS JOIN later JOIN r o ON o.rank = CASE WHEN later.m < c.rank THEN later.m ELSE later.m + 1 END WHERE c.rank <= 8 GROUP BY c.c_custkey""")
def draft_deterministic(spark, sf_dir):
    """A draft of one position in which everybody takes the best player left: the simulation has one outcome, which SQL can say."""
    rows = ordered.numbered(Tables(spark, sf_dir).customer.select("c_custkey", F.col("c_acctbal").alias("v")), [], [F.desc("v"), F.asc("c_custkey")], "place")  # the draft's pool
    players = derived(rows, {"player_id": "CAST(c_custkey AS string)", "position": "'RB'", "projected_points": "v", "adp": "CAST(place AS double)", "adp_std": "CAST(4 AS double)"})
    managers = tuple(league.Manager(f"m{i}", f"m{i}", i, i == 1) for i in range(1, 13))
    roster = league.RosterConfig(qb=0, rb=5, wr=0, te=0, flex=0, k=0, def_=0, bench=0)
    greedy = simulate.PickModel(simulate.GREEDY_VOR)
    snap, first = simulate.pool_snapshot(spark, league.DraftState(league.League(12, roster), managers), players, {"RB": 10.0}, greedy, greedy)
    out = simulate.simulate_candidates(spark, snap, first(8), 20, 5)
    return out.select("player_id", F.round("mean_score", 2).alias("mean_score"), F.round("std_score", 6).alias("std_score"), "n_simulations")


@query("""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 200 END AS team, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders),
    e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 200 END AS team, event_id * 13 % 2400 AS low, event_id * 13 % 2400 + event_id % 5 AS high, value FROM events)
    SELECT o_orderkey, count(event_id) AS n, round(coalesce(sum(value), 0), 4) AS total FROM o LEFT JOIN e ON o.team = e.team AND day BETWEEN low AND high GROUP BY o_orderkey""")
def interval_join(spark, sf_dir):
    """Days of orders in ranges of days of events, within groups of which one holds a third of both."""
    t = Tables(spark, sf_dir)
    days = derived(t.orders, {"o_orderkey": "o_orderkey", "team": "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 200 END", "day": "CAST(datediff(o_orderdate, DATE '1992-01-01') AS long)"})
    spans = derived(t.events, {"event_id": "event_id", "team": "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 200 END", "low": "event_id * 13 % 2400", "high": "event_id * 13 % 2400 + event_id % 5", "value": "value"})
    found = intervals.range_totals(days, spans, ["team"], "day", "low", "high", {"n": F.col("event_id").isNotNull().cast("long"), "total": F.col("value")})
    return found.groupBy("o_orderkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 4).alias("total"))


@query("""
    WITH n AS (SELECT trim(unnest(string_split(text, '.'))) AS name, item_id FROM benchmark), k AS (SELECT name, min(item_id) AS place FROM n WHERE name <> '' GROUP BY name)
    SELECT doc_id, count(place) AS n, min(place) AS first FROM documents LEFT JOIN k ON contains(text, name) GROUP BY doc_id""")
def names_in_texts(spark, sf_dir):
    """How many sentences of the benchmark stand in each document, and the first item of theirs."""
    t = Tables(spark, sf_dir)
    sentences = t.benchmark.select(F.explode(F.split("text", r"\.")).alias("name"), F.col("item_id").alias("place")).withColumn("name", F.trim("name")).filter("name != ''")
    found = names.names_in(t.documents, sentences, "doc_id", "text", "name", "place")
    return t.documents.select("doc_id").join(found, "doc_id", "left").groupBy("doc_id").agg(F.count("place").alias("n"), F.min("place").alias("first"))


def ordered_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` of a sorted result with their places, by a limit on the sorted rows."""
    return df.orderBy(*order).limit(n).select("*", F.row_number().over(Window.orderBy(*order)).alias("row_no"))


@query(f"""
    WITH {DRAFT_POOL}
    SELECT player_id, row_number() OVER (ORDER BY adp, player_id) AS row_no, 'adp' AS by FROM pool QUALIFY row_no <= 200
    UNION ALL SELECT player_id, row_number() OVER (ORDER BY projected_points DESC, player_id) AS row_no, 'points' FROM pool QUALIFY row_no <= 200""")
def sorted_pool(spark, sf_dir):
    """The order of the pool's first 200 by rank ascending and by points descending."""
    pool_ = draft_pool(Tables(spark, sf_dir)).select("player_id", "adp", "projected_points")
    by_rank = ordered_rows(pool_, 200, F.asc("adp"), F.asc("player_id")).select("player_id", "row_no", F.lit("adp").alias("by"))
    return by_rank.unionByName(ordered_rows(pool_, 200, F.desc("projected_points"), F.asc("player_id")).select("player_id", "row_no", F.lit("points").alias("by")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 77 OR o_orderdate = (SELECT min(o_orderdate) FROM orders)")
def lookup_layout(spark, sf_dir):
    """Lookups by either of two columns of a table stored in Z-order of both, with a Bloom filter on the key."""
    orders = Tables(spark, sf_dir).orders
    stored = layout.store_for_lookup(orders, shared_path(spark, "orders"), ["o_custkey", "o_orderdate"], ["o_custkey"])
    first = stored.agg(F.min("o_orderdate")).first()[0]
    return stored.filter((F.col("o_custkey") == 77) | (F.col("o_orderdate") == F.lit(first))).select("o_orderkey", "o_custkey", "o_totalprice")


#: The datasets that ``hydrate_tiers`` leaves, with an id column of an earlier run that has to go first.
HYDRATED_MORE = {
    "draft_picks": {"key": "o_orderkey", "pfr_player_id": "CASE WHEN o_orderkey % 3 = 0 THEN concat('P', o_custkey) END", "pfr_player_name": "CASE WHEN o_orderkey % 5 = 0 THEN 'nobody' ELSE concat('Customer#', lpad(CAST(o_custkey AS string), 9, '0')) END", "college": "CASE o_custkey % 3 WHEN 0 THEN 'Ohio St.' ELSE 'Yale Col' END"},
    "injuries": {"key": "o_orderkey", "gsis_id": "CASE WHEN o_orderkey % 4 = 0 THEN concat('G', o_custkey) END", "full_name": "CASE WHEN o_orderkey % 5 = 0 THEN ' Nobody Jr.' ELSE concat('Customer#', lpad(CAST(o_custkey AS string), 9, '0')) END"},
    "players": {"key": "o_orderkey", "gsis_id": "concat('G', o_custkey)"},
    "nextgen_stats": {"key": "o_orderkey", "player_gsis_id": "CASE WHEN o_orderkey % 7 > 0 THEN concat('G', o_custkey) END"},
    "ff_opportunity": {"key": "o_orderkey", "player_id": "concat('G', o_custkey + o_orderkey % 2 * 100000000)"},
    "ff_playerids": {"key": "o_orderkey", "gsis_id": "CASE WHEN o_orderkey % 2 = 0 THEN concat('G', o_custkey) ELSE 'none' END", "pfr_id": "concat('P', o_custkey)"},
    "trades": {"key": "o_orderkey", "pfr_id": "concat('P', o_custkey)"},
}
MAPPED = {"yamplayer_id": "concat('YAMP_', c_custkey)", "gsis_id": "CASE WHEN c_custkey % 3 > 0 THEN concat('G', c_custkey) END", "pfr_id": "CASE WHEN c_custkey % 2 = 0 THEN concat('P', c_custkey) END", "merge_name": "lower(c_name)", "college": "CASE c_custkey % 3 WHEN 0 THEN 'Ohio State' ELSE 'Yale College' END", "birthdate": "CAST(NULL AS string)"}


def _more(name: str) -> str:
    return f"({sql_of(HYDRATED_MORE[name], 'orders')})".replace("AS string", "AS VARCHAR")


@query(f"""
    WITH m AS ({sql_of(MAPPED, 'customer').replace('AS string', 'AS VARCHAR')}), once AS (SELECT merge_name, max(yamplayer_id) AS hi FROM m GROUP BY 1 HAVING count(*) = 1)
    SELECT 'draft_picks' AS dataset, key, coalesce(p.yamplayer_id, c.yamplayer_id) AS yamplayer_id FROM {_more('draft_picks')} x LEFT JOIN m p ON pfr_player_id = p.pfr_id LEFT JOIN m c ON {name_sql('pfr_player_name')} = c.merge_name AND {college_sql('x.college')} = c.college UNION ALL
    SELECT 'injuries', key, coalesce(g.yamplayer_id, o.hi) FROM {_more('injuries')} x LEFT JOIN m g USING (gsis_id) LEFT JOIN once o ON {name_sql('full_name')} = o.merge_name UNION ALL
    SELECT 'players', key, yamplayer_id FROM {_more('players')} x LEFT JOIN m USING (gsis_id) UNION ALL
    SELECT 'nextgen_stats', key, yamplayer_id FROM {_more('nextgen_stats')} x LEFT JOIN m ON player_gsis_id = m.gsis_id UNION ALL
    SELECT 'ff_opportunity', key, yamplayer_id FROM {_more('ff_opportunity')} x LEFT JOIN m ON player_id = m.gsis_id UNION ALL
    SELECT 'ff_playerids', key, coalesce(g.yamplayer_id, p.yamplayer_id) FROM {_more('ff_playerids')} x LEFT JOIN m g USING (gsis_id) LEFT JOIN m p ON x.pfr_id = p.pfr_id UNION ALL
    SELECT 'trades', key, yamplayer_id FROM {_more('trades')} x LEFT JOIN m USING (pfr_id)""")
def hydrate_others(spark, sf_dir):
    """The other seven datasets get their players' ids; what an earlier run left is dropped."""
    t = Tables(spark, sf_dir)
    rows = {n: derived(t.orders, c).withColumns({f"{identity.ID}_old": F.lit("x"), identity.ID: F.lit("y")}) for n, c in HYDRATED_MORE.items()}
    found = identity.hydrate_all(rows, derived(t.customer, MAPPED))
    assert all(f"{identity.ID}_old" not in df.columns for df in found.values())
    parts = [df.select(F.lit(name).alias("dataset"), "key", identity.ID) for name, df in found.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || chr(10) || '"' || o_orderstatus || '", x' WHEN 1 THEN NULL ELSE o_orderpriority END AS note, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS a, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS b FROM orders""")
def csv_by_name(spark, sf_dir):
    """Two CSV sinks with a column of their own each and fields with line breaks and quotes, read in splits and united by name."""
    orders = Tables(spark, sf_dir).orders
    note = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(o_orderpriority, chr(10), '\"', o_orderstatus, '\", x') WHEN 1 THEN NULL ELSE o_orderpriority END")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("k"), note.alias("note"), F.col("o_custkey").cast("string").alias("a"), F.col("o_orderstatus").alias("b"), (F.col("o_orderkey") % 2).alias("side"))
    read = []
    for side, own in ((0, "a"), (1, "b")):
        path = shared_path(spark, "landed")
        catalog.write_csv(rows.filter(F.col("side") == side).select("k", "note", own), path)
        fields = csv_splits.fields(spark, path).filter(F.get("values", F.lit(0)) != "k")  # each file of the sink has a header
        read.append(fields.select(*[F.nullif(F.get("values", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("k", "note", own))]))
    return read[0].unionByName(read[1], allowMissingColumns=True)
