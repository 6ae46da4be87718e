"""SQL for oracles that take more than one line: recursive filters, spectra, eigenvectors, clusters."""

from __future__ import annotations

import numpy as np


def extended(source: str, pad: int) -> str:
    """(channel, i, x, n) of ``source`` (channel, i, value) with odd reflections of up to ``pad`` samples at both ends, and the length."""
    return f"""
len_ AS (SELECT channel, max(i) + 1 AS n, arg_min(value, i) AS first_, arg_max(value, i) AS last_, least({pad}, max(i)) AS pad FROM {source} GROUP BY channel),
ext AS MATERIALIZED (
  SELECT channel, i + pad AS i, value AS x, n, pad FROM {source} JOIN len_ USING (channel)
  UNION ALL SELECT channel, pad - i, 2 * first_ - value, n, pad FROM {source} JOIN len_ USING (channel) WHERE i BETWEEN 1 AND pad
  UNION ALL SELECT channel, 2 * (n - 1) - i + pad, 2 * last_ - value, n, pad FROM {source} JOIN len_ USING (channel) WHERE i BETWEEN n - 1 - pad AND n - 2)"""


def sections(name: str, source: str, sos: np.ndarray, settled: bool) -> str:
    """(channel, i, y): second-order sections run sample by sample over ``source`` (channel, i from 0, x), from rest or as if the first sample had stood for ever."""
    k = range(len(sos))
    c = [[f"{float(v)!r}::DOUBLE" for v in s] for s in sos]
    gain = [float(s[:3].sum() / s[3:].sum()) for s in sos]
    level, first = 1.0, []
    for s, g in zip(sos, gain, strict=True):  # what a section remembers of a constant input
        out = level * g
        first += [f"{float(out - s[0] * level)!r}::DOUBLE * x", f"{float(s[2] * level - s[5] * out)!r}::DOUBLE * x"]
        level = out
    start = ", ".join(f"{first[2 * j] if settled else '0.0::DOUBLE'} AS p{j}, {first[2 * j + 1] if settled else '0.0::DOUBLE'} AS q{j}" for j in k)
    step = f"SELECT s.channel, s.i, s.x AS o, {', '.join(f'r.p{j}, r.q{j}' for j in k)} FROM {name} r JOIN {source} s ON s.channel = r.channel AND s.i = r.i + 1"
    for j in k:
        b0, b1, b2, _, a1, a2 = c[j]
        rest = "".join(f", p{m}, q{m}" for m in k if m != j)
        step = f"SELECT channel, i, y AS o, {b1} * o - {a1} * y + q{j} AS p{j}, {b2} * o - {a2} * y AS q{j}{rest} FROM (SELECT *, {b0} * o + p{j} AS y FROM ({step}))"
    step = f"SELECT channel, i, o, {', '.join(f'p{j}, q{j}' for j in k)} FROM ({step})"
    return f"{name}(channel, i, y, {', '.join(f'p{j}, q{j}' for j in k)}) AS (SELECT channel, -1::BIGINT, 0.0::DOUBLE, {start} FROM {source} WHERE i = 0 UNION ALL {step})"


def zero_phase(source: str, sos: np.ndarray) -> str:
    """Tables up to ``zp`` (channel, i, value): forward and backward over the extended signal."""
    pad = 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))
    return f"""{extended(source, pad)},
{sections("fw", "ext", sos, True)},
back AS MATERIALIZED (SELECT fw.channel, n + 2 * pad - 1 - i AS i, y AS x, n, pad FROM fw JOIN len_ USING (channel) WHERE i >= 0),
{sections("bw", "back", sos, True)},
zp AS (SELECT bw.channel, n + pad - 1 - i AS i, y AS value FROM bw JOIN len_ USING (channel) WHERE n + pad - 1 - i >= 0 AND n + pad - 1 - i < n)"""


def cepstrum(kind: str, n_out: int, n_filters: int, size: int, hop: int, fs: float) -> str:
    """Tables from ``sig`` to ``cep`` (channel, frame, k, value)."""
    top = f"2595 * log10(1 + {fs / 2} / 700)"
    edge = f"700 * (power(10, {top} * j / {n_filters + 1} / 2595) - 1)" if kind == "mel" else f"{fs / 2} * j / {n_filters + 1}"
    return f"""
fr AS (SELECT channel, i // {hop} - o AS frame, i - (i // {hop} - o) * {hop} AS j, value FROM sig, range({size // hop}) r(o) WHERE i // {hop} - o >= 0),
ok AS (SELECT channel, frame FROM fr GROUP BY ALL HAVING count(*) = {size}),
win AS (SELECT channel, frame, j, value * (0.5 - 0.5 * cos(2 * pi() * j / {size})) AS y FROM fr SEMI JOIN ok USING (channel, frame)),
sp AS (SELECT channel, frame, k, power(sum(y * cos(2 * pi() * j * k / {size})), 2) + power(sum(y * sin(2 * pi() * j * k / {size})), 2) AS p FROM win, range({size // 2 + 1}) r(k) GROUP BY ALL),
ed AS (SELECT j, {edge} AS f FROM range({n_filters + 2}) r(j)),
tri AS (SELECT a.j AS m, a.f AS lo, b.f AS mid, c.f AS hi FROM ed a JOIN ed b ON b.j = a.j + 1 JOIN ed c ON c.j = a.j + 2),
bank AS (SELECT m, k, greatest(0, least((f - lo) / (mid - lo), (hi - f) / (hi - mid))) AS w FROM (SELECT *, k * {fs} / {size} AS f FROM tri, range({size // 2 + 1}) r(k))),
db AS (SELECT channel, frame, m, 10 * log10(greatest(sum(p * w), 1e-10)) AS v FROM sp JOIN bank USING (k) GROUP BY channel, frame, m),
cl AS (SELECT channel, frame, m, greatest(v, max(v) OVER (PARTITION BY channel, frame) - 80) AS v FROM db),
cep AS (SELECT channel, frame, k, sum(v * cos(pi() / {n_filters} * (m + 0.5) * k)) * sqrt(2.0 / {n_filters}) / CASE WHEN k = 0 THEN sqrt(2.0) ELSE 1 END AS value FROM cl, range({n_out}) r(k) GROUP BY channel, frame, k)"""


def rotations(columns: list[str], source: str, sweeps: int = 8, moment: str = "covar_pop") -> tuple[str, str]:
    """Tables up to the last one, whose name comes second: a diagonal (a_kk) and vectors (u_ik) of the covariance of ``columns``, by cyclic rotations."""
    n = len(columns)
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    names = [a(i, j) for i in range(n) for j in range(i, n)] + [f"u{i}{j}" for i in range(n) for j in range(n)]
    first = [f"{moment}({columns[i]}, {columns[j]}) AS {a(i, j)}" for i in range(n) for j in range(i, n)] + [f"{float(i == j)}::DOUBLE AS u{i}{j}" for i in range(n) for j in range(n)]
    means = [f"avg({c}) AS mean_{k}" for k, c in enumerate(columns)]
    out, last, k = f"mean_ AS (SELECT {', '.join(means)} FROM {source}),\njac0 AS MATERIALIZED (SELECT {', '.join(first)} FROM {source})", "jac0", 0
    for _ in range(sweeps):
        for p in range(n):
            for q in range(p + 1, n):
                k += 1
                theta = f"({a(q, q)} - {a(p, p)}) / (2 * {a(p, q)})"
                t = f"CASE WHEN {a(p, q)} = 0 THEN 0 ELSE CASE WHEN {theta} < 0 THEN -1 ELSE 1 END / (abs({theta}) + sqrt({theta} * {theta} + 1)) END"
                new = {a(p, p): f"{a(p, p)} - t * {a(p, q)}", a(q, q): f"{a(q, q)} + t * {a(p, q)}", a(p, q): "0.0::DOUBLE"}
                for r in range(n):
                    if r not in (p, q):
                        new[a(r, p)] = f"c * {a(r, p)} - s * {a(r, q)}"
                        new[a(r, q)] = f"s * {a(r, p)} + c * {a(r, q)}"
                    new[f"u{r}{p}"] = f"c * u{r}{p} - s * u{r}{q}"
                    new[f"u{r}{q}"] = f"s * u{r}{p} + c * u{r}{q}"
                rows = ", ".join(f"{new.get(x, x)} AS {x}" for x in names)
                out += f",\njac{k} AS MATERIALIZED (SELECT {rows} FROM (SELECT *, t * c AS s FROM (SELECT *, 1 / sqrt(t * t + 1) AS c FROM (SELECT *, {t} AS t FROM {last}))))"
                last = f"jac{k}"
    return out, last


def inverse_root(columns: list[str], source: str, eps: float = 1e-16) -> str:
    """Table ``root`` (w_ij): U diag(1 / sqrt(S + eps)) U' of the population covariance of ``columns``."""
    n = range(len(columns))
    out, last = rotations(columns, source)
    w = ", ".join(" + ".join(f"u{i}{k} * u{j}{k} / sqrt(greatest(a{k}{k}, 0) + {eps!r}::DOUBLE)" for k in n) + f" AS w_{i}{j}" for i in n for j in n)
    return f"{out},\nroot AS MATERIALIZED (SELECT {w} FROM {last})"


def principal(columns: list[str], source: str) -> str:
    """Table ``pcs`` (k, variance, u list): components of ``columns`` by falling variance, the largest loading positive."""
    n = range(len(columns))
    out, last = rotations(columns, source, moment="covar_samp")
    rows = " UNION ALL ".join(f"SELECT a{k}{k} AS variance, [{', '.join(f'u{i}{k}' for i in n)}] AS u FROM {last}" for k in n)
    sign = "list_transform(u, lambda v: v * CASE WHEN list_max(u) >= -list_min(u) THEN 1 ELSE -1 END)"
    return f"{out},\npcs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY variance DESC) - 1 AS k, variance, {sign} AS u FROM ({rows}))"


def whitened(columns: list[str], source: str) -> str:
    """Table ``white``: the columns of ``source`` (i, columns) times the inverse root of their covariance."""
    n = range(len(columns))
    values = ", ".join(" + ".join(f"({columns[j]} - mean_{j}) * w_{i}{j}" for j in n) + f" AS {columns[i]}" for i in n)
    return f"{inverse_root(columns, source)},\nwhite AS (SELECT i, {values} FROM {source}, mean_, root)"


def lloyd(source: str, first: str, steps: int) -> str:
    """Tables up to ``lab`` (id, cluster): rows of ``source`` (id, x) by the nearest centre, centres begun as ``first`` (c, x) and moved ``steps`` times."""
    out = f"cen0 AS MATERIALIZED (SELECT * FROM ({first}))"
    label = lambda k: f"SELECT p.id, arg_min(c, (list_distance(p.x, q.x), c)) AS cluster FROM {source} p, cen{k} q GROUP BY p.id"
    for k in range(steps):
        out += f""",
lab{k} AS MATERIALIZED ({label(k)}),
dim{k} AS (SELECT cluster AS c, j, avg(v) AS v FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM {source} JOIN lab{k} USING (id)) GROUP BY ALL),
cen{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM cen{k} o LEFT JOIN (SELECT c, list(v ORDER BY j) AS x FROM dim{k} GROUP BY c) m USING (c))"""
    return f"{out},\nlab AS ({label(steps)})"


def diagonal_mixture(source: str, first: str, k: int, steps: int, least: float) -> str:
    """Tables up to ``res`` (id, c, logp, total): responsibilities of a diagonal mixture after ``steps`` steps of expectation and maximisation."""
    out = f"""flat AS MATERIALIZED (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM {source}),
var_ AS (SELECT j, var_pop(v) + {least!r}::DOUBLE AS s FROM flat GROUP BY j),
mix0 AS MATERIALIZED (SELECT c, j, v AS m, s FROM (SELECT c, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM ({first})) JOIN var_ USING (j)),
wt0 AS MATERIALIZED (SELECT DISTINCT c, ln(1.0 / {k}) AS lw FROM mix0)"""
    dens = lambda t: f"""
den{t} AS (SELECT id, c, any_value(lw) - 0.5 * sum(ln(2 * pi() * s) + (v - m) * (v - m) / s) AS logp FROM flat JOIN mix{t} USING (j) JOIN wt{t} USING (c) GROUP BY id, c),
res{t} AS MATERIALIZED (SELECT id, c, logp, mx + ln(sum(exp(logp - mx)) OVER (PARTITION BY id)) AS total FROM (SELECT *, max(logp) OVER (PARTITION BY id) AS mx FROM den{t}))"""  # noqa: E731
    for t in range(steps):
        out += f""",{dens(t)},
wt{t + 1} AS MATERIALIZED (SELECT c, ln(sum(exp(logp - total)) / count(*)) AS lw FROM res{t} GROUP BY c),
mix{t + 1} AS MATERIALIZED (SELECT c, j, m, greatest(q / r - m * m, 0) + {least!r}::DOUBLE AS s FROM (SELECT *, sv / r AS m FROM (SELECT c, j, sum(exp(logp - total)) AS r, sum(exp(logp - total) * v) AS sv, sum(exp(logp - total) * v * v) AS q FROM res{t} JOIN flat USING (id) GROUP BY c, j)))"""
    return f"{out},{dens(steps)},\nres AS (SELECT * FROM res{steps})"
