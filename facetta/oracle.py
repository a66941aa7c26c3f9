"""DuckDB SQL for the catalogue's queries. Simplex projection, folds and searches are written out by templates."""

from __future__ import annotations

from .fixtures import EVENT_TYPES, START


def q(*ctes: str, select: str) -> str:
    """A statement from CTEs, none given twice."""
    return "WITH " + ",\n".join(dict.fromkeys(ctes)) + "\n" + select


def emb(d: int) -> str:
    return f"""data AS (SELECT * FROM (SELECT vec_id AS t, embedding[1:{d}] AS x, [lead(embedding[1]) OVER (ORDER BY vec_id)] AS y FROM embeddings)
      WHERE t < (SELECT max(vec_id) FROM embeddings))"""


#: Number of rows of the series, and the first ``ratio`` of a number of rows.
N = "(SELECT count(*) FROM data)"


def part(rows: str, ratio: float) -> str:
    return f"CAST(floor({rows} * {ratio} + 1e-9) AS BIGINT)"


TRAIN = part(N, 0.8)
OUTER = (("0", TRAIN), (TRAIN, N))
INNER = (("0", part(TRAIN, 0.75)), (part(TRAIN, 0.75), TRAIN))


def sliding(folds: int) -> list:
    """Windows of two fifths, each validated on the next fifth."""
    a, b = part(N, 0.4), part(N, 0.2)
    return [((f"{k} * {b}", f"({k} * {b} + {a})"), (f"({k} * {b} + {a})", f"({k} * {b} + {a} + {b})")) for k in range(folds)]


HOURLY = f"""hourly AS (SELECT h.t, [{", ".join(f"CAST(coalesce(round(sum(value) FILTER (event_type = '{e}'), 4), 0) AS FLOAT)" for e in EVENT_TYPES)}] AS x
      FROM (SELECT unnest(range(0, (SELECT max(datesub('hour', TIMESTAMP '{START}', ts)) FROM events) + 1)) AS t) h LEFT JOIN (SELECT datesub('hour', TIMESTAMP '{START}', ts) AS t, event_type, value FROM events) e ON e.t = h.t
      GROUP BY h.t)"""


def ev(*, cross: bool, lead: int = 1) -> str:
    y = "[b.x[3]]" if cross else "b.x"
    return HOURLY + f",\n data AS (SELECT a.t, a.x, {y} AS y FROM hourly a JOIN hourly b ON b.t = a.t + {lead})"


LI = """data AS (SELECT CAST(dense_rank() OVER (ORDER BY day) - 1 AS BIGINT) AS t, x FROM (SELECT CAST(l_shipdate AS DATE) AS day,
      [round(sum(l_quantity), 4), round(sum(l_extendedprice), 4), round(sum(l_discount), 4), round(sum(l_tax), 4)] AS x FROM lineitem GROUP BY 1))"""


def states(rows: list[list[int]], name: str = "s") -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({r} AS BIGINT[]))" for i, r in enumerate(rows)) + ") v(sid, state))"


def arms(folds: list, source: str = "data", tag: str = "") -> str:
    """Library and query rows of contiguous folds ((train from, to), (validation from, to)); bounds are SQL."""
    out = []
    for name, k in (("lib", 0), ("qry", 1)):
        parts = [f"SELECT {i} AS fold_id, t - {f[k][0]} AS pos, x, y FROM {source} WHERE t >= {f[k][0]} AND t < {f[k][1]}" for i, f in enumerate(folds)]
        out.append(f"{name}{tag} AS (" + " UNION ALL ".join(parts) + ")")
    return ",\n".join(out)


LOO_ARMS = "lib AS (SELECT 0 AS fold_id, t AS pos, x, y FROM data), qry AS (SELECT * FROM lib)"


def simplex(d: int, *, within: bool = False, targets: int = 1, theiler: int | None = None, s: str = "s", tag: str = "", arm: str = "") -> str:
    """pred{tag}(sid, fold_id, tq, target, pred, obs)."""
    dist = " + ".join(f"pow(CAST(q.x[state[{j}] + 1] AS DOUBLE) - CAST(l.x[state[{j}] + 1] AS DOUBLE), 2)" for j in range(1, d + 1))
    out = f"AND abs(q.pos - l.pos) > {theiler}" if theiler is not None else ""
    n = d if within else targets
    y = "[state[k] + 1]" if within else "[k]"
    return f"""near{tag} AS (SELECT *, greatest(exp(-dist / greatest(min(dist) OVER (PARTITION BY sid, fold_id, tq), 1e-6)), 1e-6) AS w FROM (
        SELECT *, row_number() OVER (PARTITION BY sid, fold_id, tq ORDER BY dist, tl) AS rn FROM (
          SELECT sid, state, q.fold_id, q.pos AS tq, l.pos AS tl, q.y AS yq, l.y AS yl, sqrt({dist}) AS dist
          FROM {s}, qry{arm} q JOIN lib{arm} l ON q.fold_id = l.fold_id {out})) WHERE rn <= {d + 1}),
      pred{tag} AS (SELECT sid, fold_id, tq, k - 1 AS target, sum(w * yl{y}) / sum(w) AS pred, max(CAST(yq{y} AS DOUBLE)) AS obs
        FROM near{tag}, (SELECT unnest(range(1, {n + 1})) AS k) GROUP BY ALL)"""


def metric(name: str, tag: str = "") -> str:
    """m{tag}(sid, fold_id, value)."""
    if name == "mae":
        return f"m{tag} AS (SELECT sid, fold_id, avg(abs(pred - obs)) AS value FROM pred{tag} GROUP BY ALL)"
    if name == "rmse":
        return f"m{tag} AS (SELECT sid, fold_id, sqrt(avg(pow(pred - obs, 2))) AS value FROM pred{tag} GROUP BY ALL)"
    value = "CASE WHEN count(rho) = count(*) THEN avg(rho) END"
    value = value if name == "mean_rho" else f"1 - ({value})"
    return f"""m{tag} AS (SELECT sid, fold_id, {value} AS value FROM (SELECT sid, fold_id, target,
        covar_pop(pred, obs) / nullif(stddev_pop(pred) * stddev_pop(obs), 0) AS rho FROM pred{tag} GROUP BY ALL) GROUP BY ALL)"""


def fold_energy(temperature: float, context: str) -> str:
    """e(sid, energy, m): the weighted change against ``context``, a list expression."""
    return f"""c AS (SELECT sid, list(value ORDER BY fold_id) AS m, {context} AS ctx FROM m GROUP BY sid),
      w AS (SELECT *, list_transform(ctx, lambda v: exp((v - list_max(ctx)) / {temperature})) AS r FROM c),
      e AS (SELECT sid, m, list_sum(list_transform(range(1, len(m) + 1), lambda i: r[i] / list_sum(r) * (m[i] - ctx[i]))) AS energy FROM w)"""


def search(columns: int, depth: int, name: str, *, width: int = 1) -> str:
    """best{d}(state, energy) for d = 1..depth of a beam over ``lib``/``qry``; ``width`` states are expanded at each depth."""
    out = ["top0 AS (SELECT CAST([] AS BIGINT[]) AS state)"]
    for d in range(1, depth + 1):
        out.append(
            f"""s{d} AS (SELECT row_number() OVER () AS sid, list_append(state, j) AS state FROM top{d - 1}, (SELECT CAST(unnest(range(0, {columns})) AS BIGINT) AS j)
              WHERE NOT list_contains(state, j))"""
        )
        out += [simplex(d, s=f"s{d}", tag=str(d)), metric(name, str(d))]
        out.append(f"scored{d} AS (SELECT state, value AS energy FROM s{d} JOIN m{d} USING (sid) WHERE value IS NOT NULL)")
        out.append(f"top{d} AS (SELECT state FROM scored{d} ORDER BY energy LIMIT {width})")
        out.append(f"best{d} AS (SELECT {d} AS depth, state, energy FROM scored{d} ORDER BY energy LIMIT 1)")
    return ",\n".join(out)


def joined(state: str = "state") -> str:
    return f"array_to_string({state}, ',')"


def validation(depth: int, name: str, fold) -> str:
    """checked(depth, state, energy, validation) of best1..best{depth} on an outer fold."""
    out = [arms([fold], tag="v")]
    for d in range(1, depth + 1):
        out.append(f"sv{d} AS (SELECT {d} AS sid, state FROM best{d})")
        out += [simplex(d, s=f"sv{d}", tag=f"v{d}", arm="v"), metric(name, f"v{d}")]
    rows = " UNION ALL ".join(f"SELECT depth, state, energy, value AS validation FROM best{d}, mv{d}" for d in range(1, depth + 1))
    return ",\n".join([*out, f"checked AS ({rows})"])


def hash48(*key: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 12) AS BIGINT)"


def uniform(*key: str) -> str:
    return f"(({hash48(*key)} + 0.5) / {float(1 << 48)!r})"
