"""Pieces of DuckDB SQL that state the queries independently of Spark."""

from __future__ import annotations


def frame(digits: int | None = None) -> str:
    s = "s" if digits is None else f"round(s, {digits})"
    return f"""cal AS MATERIALIZED (
  SELECT row_id, {s} AS s, w, grade, CAST(CASE WHEN u < 1/(1+exp(-(0.7::DOUBLE*(ln(s)-ln(1-s))-0.4::DOUBLE))) THEN 1 ELSE 0 END AS DOUBLE) AS y
  FROM (SELECT o_orderkey AS row_id, 1/(1+exp(-(-1.2::DOUBLE + 5.0::DOUBLE*(o_totalprice/500000.0::DOUBLE-0.5::DOUBLE)))) AS s,
               CAST(1 + o_custkey % 4 AS DOUBLE) AS w, o_orderpriority AS grade,
               CAST((o_orderkey*7919 + 104729) % 100003 AS DOUBLE)/100003.0::DOUBLE AS u FROM orders))"""


def binned(n: int, strategy: str = "mass", w: str = "1.0::DOUBLE", x: str = "s", source: str = "cal", name: str = "b") -> str:
    levels = ", ".join(f"{k / n!r}::DOUBLE" for k in range(1, n))
    edges = f"SELECT list_sort(list_distinct(quantile_cont({x}, [{levels}]))) AS e FROM {source}" if strategy == "mass" else f"SELECT [{levels}] AS e"
    return f"""{name}_e AS MATERIALIZED ({edges}),
{name}_r AS MATERIALIZED (SELECT c.*, len(list_filter(e, lambda v: v <= {x})) AS bin FROM {source} c, {name}_e),
{name} AS MATERIALIZED (SELECT bin, count(*) AS n, sum({w}) AS w, sum({w}*{x})/sum({w}) AS p, sum({w}*y)/sum({w}) AS r, sum({w}*y) AS k FROM {name}_r GROUP BY bin)"""


def newton(xs: list[str], y: str = "y", w: str = "w", offset: str = "0.0", source: str = "cal", name: str = "nb", steps: int = 12) -> str:
    """CTEs that end in one row ``name`` with coefficients b0, b1, ... of a logistic regression by unrolled Newton steps."""
    k = len(xs)
    out = [f"{name}_x AS MATERIALIZED (SELECT {', '.join(f'CAST({x} AS DOUBLE) AS x{i}' for i, x in enumerate(xs))}, CAST({y} AS DOUBLE) AS y, CAST({w} AS DOUBLE) AS w, CAST({offset} AS DOUBLE) AS o FROM {source})"]
    out.append(f"{name}_0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))})")
    g = [f"sum(w*(y-mu)*x{i}) AS g{i}" for i in range(k)]
    h = [f"sum(w*mu*(1-mu)*x{i}*x{j}) AS h{i}{j}" for i in range(k) for j in range(i + 1)]
    at = lambda i, j: f"h{max(i, j)}{min(i, j)}"

    def det(cells: list[list[str]]) -> str:
        if len(cells) == 1:
            return cells[0][0]
        return "(" + " + ".join(f"({'' if c % 2 == 0 else '-'}{cells[0][c]})*{det([r[:c] + r[c + 1 :] for r in cells[1:]])}" for c in range(len(cells))) + ")"

    matrix = [[at(i, j) for j in range(k)] for i in range(k)]
    for s in range(steps):
        eta = " + ".join(f"b{i}*x{i}" for i in range(k))
        new = [f"b{c} + {det([[f'g{i}' if j == c else matrix[i][j] for j in range(k)] for i in range(k)])}/{det(matrix)} AS b{c}" for c in range(k)]
        out.append(f"{name}_s{s} AS MATERIALIZED (SELECT {', '.join(g + h)} FROM (SELECT t.*, 1/(1+exp(-(o + {eta}))) AS mu FROM {name}_x t, {name}_{s}))")
        out.append(f"{name}_{s + 1} AS MATERIALIZED (SELECT {', '.join(new)} FROM {name}_{s}, {name}_s{s})")
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_{steps})")
    return ",\n".join(out)


LOGIT = "(ln(s)-ln(1-s))"
#: Platt's smoothed targets.
SMOOTHED = "targets AS MATERIALIZED (SELECT c.*, CASE WHEN y > 0.5 THEN (k+1)/(k+2) ELSE 1/(n-k+2) END AS t FROM cal c, (SELECT sum(y) AS k, CAST(count(*) AS DOUBLE) AS n FROM cal))"
PLATT = f"{SMOOTHED},\n{newton(['1.0', LOGIT], y='t', source='targets', name='pl')}"

#: Isotonic blocks as the lower hull of the sums: from each corner the next one is where the mean is least, the nearest of several.
HULL = """g AS MATERIALIZED (SELECT s, sum(w) AS w, sum(w*y) AS wy, sum(w*s) AS ws, row_number() OVER (ORDER BY s) AS i FROM cal GROUP BY s),
sums AS MATERIALIZED (SELECT i, sum(w) OVER (ORDER BY i) AS cw, sum(wy) OVER (ORDER BY i) AS cy FROM g),
hull(i, cw, cy, fit, lo) AS (
  SELECT CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, CAST(-1 AS BIGINT)
  UNION ALL
  SELECT x.i, x.cw, x.cy, x.fit, lo FROM (SELECT h.i AS lo, arg_min({'i': b.i, 'cw': b.cw, 'cy': b.cy, 'fit': (b.cy-h.cy)/(b.cw-h.cw)}, {'m': (b.cy-h.cy)/(b.cw-h.cw), 'i': b.i}) AS x
    FROM hull h JOIN sums b ON b.i > h.i GROUP BY h.i)),
parts AS MATERIALIZED (SELECT lo, i AS hi, fit FROM hull WHERE lo >= 0),
iso AS MATERIALIZED (SELECT g.i, fit, lo FROM g JOIN parts ON g.i > lo AND g.i <= hi),
blocks AS MATERIALIZED (SELECT fit, min(s) AS first, max(s) AS last, sum(ws)/sum(w) AS centre FROM iso JOIN g USING (i) GROUP BY lo, fit)"""
