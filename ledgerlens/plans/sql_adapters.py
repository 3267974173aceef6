"""Oracle-side (DuckDB SQL) versions of the line adapters in sources.tables.

Written independently of the Spark code: they state the same definitions in
plain SQL so that the driver's DuckDB run is a real cross-check.
"""

MOV_LINES = ("SELECT CAST(l_orderkey AS VARCHAR) AS ref, CAST(l_quantity AS DECIMAL(18,4)) AS qty, "
             "CAST(l_shipdate AS DATE) AS mov_date, l_linestatus AS local, l_returnflag AS localisation "
             "FROM lineitem")
STOCK_LINES = "SELECT * FROM mov_lines WHERE localisation <> 'R'"
UNIT_LINES = "SELECT local AS unit, localisation AS atelier, * FROM mov_lines"
VALUE_LINES = ("SELECT CAST(l_orderkey AS VARCHAR) AS ref, "
               "CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))) "
               "AS DECIMAL(18,4)) AS qty FROM lineitem")
PART_DIFF = (
    "SELECT p.p_name || ' ' || p.p_brand || ' ' || CAST(p.p_partkey AS VARCHAR) AS Ref, a - n AS Difference "
    "FROM (SELECT l_partkey, "
    "ROUND(COALESCE(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(18,4)) END), 0), 2) AS a, "
    "ROUND(COALESCE(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,4)) END), 0), 2) AS n "
    "FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_partkey) x "
    "JOIN part p ON x.l_partkey = p.p_partkey")


def side_agg(src: str, out: str, round_lines: int | None = None, keys: str = "") -> str:
    q = f"ROUND(qty, {round_lines})" if round_lines is not None else "qty"
    k = f"{keys}, " if keys else ""
    return (f"SELECT {k}ref AS Ref, ROUND(COALESCE(SUM({q}), 0), 2) AS {out} FROM {src} "
            f"WHERE ref IS NOT NULL GROUP BY {k}ref")


def recon_select(src_join: str, keys: str = "", tolerance: float | None = None) -> str:
    """Final projection over a relation with Stock_Qty / Calc_Mov_Qty (nullable)."""
    k = f"{keys}, " if keys else ""
    cond = "d = 0" if tolerance is None else f"ABS(d) <= {tolerance}"
    return (f"SELECT {k}Ref, CAST(sq AS DOUBLE) AS Stock_Qty, CAST(mq AS DOUBLE) AS Calc_Mov_Qty, "
            f"CAST(d AS DOUBLE) AS Difference, CASE WHEN {cond} THEN 'match' ELSE 'discrepancy' END AS status "
            f"FROM (SELECT {k}Ref, COALESCE(Stock_Qty, 0) AS sq, COALESCE(Calc_Mov_Qty, 0) AS mq, "
            f"COALESCE(Stock_Qty, 0) - COALESCE(Calc_Mov_Qty, 0) AS d FROM {src_join}) t")


def full_join(s: str, m: str, keys: list[str] | None = None) -> str:
    keys = keys or []
    on = " AND ".join([f"{s}.{k} = {m}.{k}" for k in keys] + [f"{s}.Ref = {m}.Ref"])
    sel = ", ".join([f"COALESCE({s}.{k}, {m}.{k}) AS {k}" for k in keys]
                    + [f"COALESCE({s}.Ref, {m}.Ref) AS Ref", "Stock_Qty", "Calc_Mov_Qty"])
    return f"(SELECT {sel} FROM {s} FULL OUTER JOIN {m} ON {on})"


def recon_sql(stock_src: str, mov_src: str, keys: list[str] | None = None,
              tolerance: float | None = None, stock_round: int | None = None,
              mov_round: int | None = None, **ctes: str) -> str:
    """Complete oracle statement: CTEs, both side aggregates, full outer join."""
    keys = keys or []
    k = ", ".join(keys)
    parts = dict(mov_lines=MOV_LINES, stock_lines=STOCK_LINES)
    parts.update(ctes)
    parts["s_agg"] = side_agg(stock_src, "Stock_Qty", stock_round, k)
    parts["m_agg"] = side_agg(mov_src, "Calc_Mov_Qty", mov_round, k)
    body = ",\n".join(f"{n} AS ({v})" for n, v in parts.items())
    return f"WITH {body}\n" + recon_select(full_join("s_agg", "m_agg", keys), k, tolerance)


# Same whitespace class as ledgerlens.functions.text.WS_CLASS (RE2 accepts it).
from ledgerlens.functions.text import WS_CLASS  # noqa: E402

SQL_WS = WS_CLASS


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_sim(a: str, b: str) -> str:
    s1 = f"lower({sql_strip(f'COALESCE({a}, {chr(39)}{chr(39)})')})"
    s2 = f"lower({sql_strip(f'COALESCE({b}, {chr(39)}{chr(39)})')})"
    return (f"(CASE WHEN {s1} = {s2} THEN 1.0 WHEN length({s1}) = 0 OR length({s2}) = 0 THEN 0.0 "
            f"ELSE 1.0 - CAST(levenshtein({s1}, {s2}) AS DOUBLE) / greatest(length({s1}), length({s2})) END)")


PART_POS = "SELECT Ref, Difference, row_number() OVER (ORDER BY Difference DESC, Ref) AS pos FROM part_diff"
PAIRS_BRUTE = ("SELECT a.Ref AS ref1, b.Ref AS ref2, a.pos AS i, b.pos AS j, "
               "CAST(a.Difference AS DOUBLE) AS diff1, CAST(b.Difference AS DOUBLE) AS diff2, "
               + sql_sim("a.Ref", "b.Ref") + " AS sim FROM part_pos a JOIN part_pos b "
               "ON a.pos < b.pos AND a.Difference <> 0 AND abs(a.Difference + b.Difference) < 0.01")
