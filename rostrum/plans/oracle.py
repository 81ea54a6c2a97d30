"""The domain views for DuckDB, as common table expressions that oracle queries put together."""

from __future__ import annotations

SEASON = "(CAST(year({d}) - (CASE WHEN month({d}) < 9 THEN 1 ELSE 0 END) AS VARCHAR) || '-' || CAST(year({d}) - (CASE WHEN month({d}) < 9 THEN 1 ELSE 0 END) + 1 AS VARCHAR))"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bout": ((), f"""SELECT l_orderkey AS competition, l_linenumber AS line, l_suppkey AS a, l_partkey % (SELECT count(*) FROM supplier) AS b,
        CAST(floor(l_quantity) AS BIGINT) % 16 AS score_a, CAST(floor(l_extendedprice) AS BIGINT) % 16 AS score_b,
        CASE WHEN l_returnflag = 'R' THEN 'TABLEAU' ELSE 'POULE' END AS phase, CAST(l_shipdate AS DATE) AS day, {SEASON.format(d="l_shipdate")} AS season
        FROM lineitem WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier)"""),
    "oriented": (("bout",), """SELECT a AS me, b AS rival, score_a AS favor, score_b AS contra, 'A' AS side, competition, line, phase, day, season FROM bout
        UNION ALL SELECT b, a, score_b, score_a, 'B', competition, line, phase, day, season FROM bout"""),
    "result": ((), f"""SELECT o_orderkey AS fact, o_custkey AS person, o_totalprice AS points,
        row_number() OVER (PARTITION BY year(o_orderdate) * 100 + month(o_orderdate), substr(o_orderpriority, 1, 1) ORDER BY o_totalprice DESC, o_orderkey) AS place,
        CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR) || '-' || substr(o_orderpriority, 1, 1) AS competition, year(o_orderdate) * 100 + month(o_orderdate) AS ym,
        CASE (year(o_orderdate) * 100 + month(o_orderdate)) % 3 WHEN 0 THEN 'FLORETE' WHEN 1 THEN 'ESPADA' ELSE 'SABLE' END AS weapon,
        CASE WHEN (year(o_orderdate) * 100 + month(o_orderdate)) % 2 = 0 THEN 'nac' ELSE 'int' END AS source,
        CASE WHEN o_orderstatus = 'P' THEN 'EQUIPOS' ELSE 'INDIVIDUAL' END AS format, substr(o_orderpriority, 3) AS category,
        CAST(o_orderdate AS DATE) AS day, {SEASON.format(d="o_orderdate")} AS season FROM orders"""),
    "fencer": ((), "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS country, CASE WHEN s_suppkey % 10 = 9 OR s_suppkey % 100 = 98 THEN s_suppkey - 1 END AS merged_into FROM supplier"),
    "root": (("fencer",), """SELECT f.id, coalesce(f3.merged_into, f2.merged_into, f.merged_into, f.id) AS root,
        CASE WHEN f3.merged_into IS NOT NULL THEN 3 WHEN f2.merged_into IS NOT NULL THEN 2 WHEN f.merged_into IS NOT NULL THEN 1 ELSE 0 END AS hops
        FROM fencer f LEFT JOIN fencer f2 ON f2.id = f.merged_into LEFT JOIN fencer f3 ON f3.id = f2.merged_into"""),
    "athlete": ((), """SELECT c_custkey AS person, c_name AS name, c_nationkey AS country, n_name AS country_name, r_name AS zone, c_mktsegment AS club, c_acctbal AS balance
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""),
    "monthly": (("result",), "SELECT season, weapon, person, ym, round(sum(points), 2) AS month_points FROM result GROUP BY ALL"),
    "publication": (("monthly",), "SELECT season, weapon, person, ym, round(sum(month_points) OVER (PARTITION BY season, weapon, person ORDER BY ym ROWS UNBOUNDED PRECEDING), 2) AS points FROM monthly"),
    "edition": (("result",), """SELECT strftime(day, '%Y%m%d') || '-' || substr(category, 1, 1) AS edition, day AS start, day + CAST(count(*) % 4 AS INTEGER) AS stop, category AS city, any_value(season) AS season,
        CASE WHEN dayofyear(day) % 2 = 0 THEN 'nac' ELSE 'int' END AS source, count(*) AS n FROM result GROUP BY day, category"""),
    "observation": ((), "SELECT event_id AS id, user_id AS person, event_type AS source, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts, value, CAST(ts AS DATE) AS day FROM events"),
}

BALANCE = """count(*) AS bouts, count(*) FILTER (WHERE favor > contra) AS wins, count(*) FILTER (WHERE favor < contra) AS losses, count(*) FILTER (WHERE favor = contra) AS undecided,
    CAST(sum(favor) AS BIGINT) AS touches_for, CAST(sum(contra) AS BIGINT) AS touches_against"""
RATE = "round(wins / nullif(wins + losses, 0), 6)"


def using(sql: str, *views: str, **more: str) -> str:
    """A query with the named views, and those that they need, in front; `more` are further expressions in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + sql
