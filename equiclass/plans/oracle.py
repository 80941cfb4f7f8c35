"""Plain-SQL twins of the registered queries (DuckDB dialect).

Each function returns the SQL that computes, by brute force and without this library,
what the matching Spark query returns: per-class ranks by ``row_number`` over the
whole class, neighbours by comparing all pairs, and the same md5-based random numbers
(``functions.keys``). The tables are the driver's pre-registered views.
"""

from __future__ import annotations

from ..functions.keys import sql_hash_hex, sql_uniform01

DOTSUM = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda s, t: s + t)"
SQSUM = ("list_reduce(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])), "
         "lambda s, t: s + t)")


def dot(a: str, b: str) -> str:
    return DOTSUM.format(a=a, b=b)


def sqdist(a: str, b: str) -> str:
    return SQSUM.format(a=a, b=b)


def ranked(table: str, class_col: str, ids: list[str], seed: int = 42, where: str | None = None) -> str:
    """Rows of non-null classes with class size ``n`` and hash rank ``rk``."""
    h = sql_hash_hex(seed, ids)
    order = ", ".join(["h"] + ids)
    cond = f"{class_col} IS NOT NULL" + (f" AND ({where})" if where else "")
    return (f"SELECT *, count(*) OVER (PARTITION BY {class_col}) AS n, "
            f"row_number() OVER (PARTITION BY {class_col} ORDER BY {order}) AS rk "
            f"FROM (SELECT *, {h} AS h FROM {table} WHERE {cond}) q")


def oversample(table: str, class_col: str, ids: list[str], cols: list[str], seed: int = 42) -> str:
    c = ", ".join(cols)
    return f"""
WITH r AS ({ranked(table, class_col, ids, seed)}),
m AS (SELECT max(n) AS mx FROM r),
x AS (SELECT r.*, (m.mx // r.n) + CASE WHEN r.rk <= m.mx % r.n THEN 1 ELSE 0 END AS mult FROM r, m),
e AS (SELECT {c}, unnest(range(mult)) AS k FROM x)
SELECT {c} FROM e"""


def sample_exact(table: str, class_col: str, ids: list[str], cols: list[str], m: int,
                 seed: int = 42) -> str:
    return (f"SELECT {', '.join(cols)} FROM ({ranked(table, class_col, ids, seed)}) r "
            f"WHERE rk <= least(n, {m})")


def undersample_spread(table: str, class_col: str, ids: list[str], cols: list[str],
                       spread: float = 1.0, seed: int = 42) -> str:
    return f"""
WITH r AS ({ranked(table, class_col, ids, seed)}),
m AS (SELECT min(n) AS mn FROM r)
SELECT {', '.join(cols)} FROM r, m WHERE rk <= least(n, CAST(floor({spread!r}::DOUBLE * mn) AS BIGINT))"""


def draws_join(table: str, class_col: str, ids: list[str], cols: list[str], size_sql: str,
               seed: int = 42, extra_ctes: str = "") -> str:
    """Rows hit by ``size_sql`` (per class, may use n) uniform draws with replacement."""
    u = sql_uniform01(seed, [class_col, "j"])
    return f"""
WITH r AS ({ranked(table, class_col, ids, seed)}),
s AS (SELECT {class_col}, count(*) AS n FROM r GROUP BY {class_col}){extra_ctes},
z AS (SELECT s.{class_col}, s.n, {size_sql} AS size FROM s{', t' if extra_ctes else ''}),
d AS (SELECT {class_col}, n, unnest(range(1, size + 1)) AS j FROM z WHERE size > 0),
dr AS (SELECT {class_col}, CAST(floor({u} * n) + 1 AS BIGINT) AS rk FROM d)
SELECT {', '.join('r.' + c for c in cols)} FROM r JOIN dr ON r.{class_col} = dr.{class_col} AND r.rk = dr.rk"""


def resample_uniform(table: str, class_col: str, ids: list[str], cols: list[str],
                     bias: float = 1.0, seed: int = 42) -> str:
    extra = f""",
t AS (SELECT ceil(CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100.0::DOUBLE
               * CAST(count(*) AS DOUBLE) * 10.0::DOUBLE) / 10.0::DOUBLE AS pct,
             CAST(sum(n) AS DOUBLE) AS tot, CAST(count(*) AS DOUBLE) AS c FROM s)"""
    size = (f"CAST(floor(pct / 100.0::DOUBLE * ({1.0 - bias!r}::DOUBLE * CAST(s.n AS DOUBLE) "
            f"+ {bias!r}::DOUBLE * tot / c)) AS BIGINT)")
    return draws_join(table, class_col, ids, cols, size, seed, extra)


def pairs(table_sql: str, metric: str, k: int, seeds_sql: str | None = None) -> str:
    """Top-k same-class neighbours of the rows of ``seeds_sql`` (default: every row) by
    brute force over all pairs; columns label, seed_id, neighbor_id, k_rank, score, x, y."""
    seeds = seeds_sql or "SELECT * FROM e"
    if metric == "cosine":
        score = (f"CASE WHEN a.nv <> 0 AND b.nv <> 0 THEN {dot('a.v', 'b.v')} / (a.nv * b.nv) "
                 f"ELSE 0.0::DOUBLE END")
        order = "score DESC, neighbor_id"
    else:
        score = f"sqrt({sqdist('a.v', 'b.v')})"
        order = "score, neighbor_id"
    kk = k if isinstance(k, int) else "a." + k
    return f"""
e AS ({table_sql}),
en AS (SELECT *, sqrt({dot('v', 'v')}) AS nv FROM e),
sd AS (SELECT en.* FROM en WHERE vec_id IN (SELECT vec_id FROM ({seeds}) ss)),
pr AS (SELECT a.label, a.vec_id AS seed_id, b.vec_id AS neighbor_id, {score} AS score,
              a.v AS x, b.v AS y, {kk} AS kmax
       FROM sd a JOIN en b ON a.label = b.label AND a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY {order}) AS k_rank
                      FROM pr) q WHERE k_rank <= kmax)"""
