"""The transforms as SQL of circular-convolution joins, for checking.

Decimating by spectral periodisation is keeping every k-th sample of a convolution, and a
filter at resolution 2^k has the time kernel ``2^k g[2^k t]``.  So every stage of a cascade
is a join of samples with kernel samples and a grouped sum; no Fourier transform is needed
beyond the kernels' own, which is a sum over cosines and sines.
"""

from __future__ import annotations

from ondula.plans.filters import Filter, periods
from ondula.plans.joint_plan import JointPlan
from ondula.plans.time_plan import TimePlan


def _values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


def kernels(name: str, n: int, banks: list[tuple[int, int, float | None, Filter]] | str) -> str:
    """CTE ``name``(bank, idx, t, h, re, im): time kernels of length n of filters given by bank, index and centre, or by a SELECT of such rows."""
    rows = banks if isinstance(banks, str) else "VALUES " + _values([(b, i, xi, f.sigma, min(periods(f.sigma), 5)) for b, i, xi, f in banks])
    return f"""
{name}_f(bank, idx, xi, sigma, p) AS ({rows}),
{name}_bell AS (SELECT bank, idx, xi, t % {n} AS w, sum(exp(-power(((1 - p) * {n} + t) / {n}::DOUBLE, 2) / (2 * sigma * sigma))) / any_value(2 * p - 1) AS low,
  sum(exp(-power(((1 - p) * {n} + t) / {n}::DOUBLE - coalesce(xi, 0), 2) / (2 * sigma * sigma))) / any_value(2 * p - 1) AS band
  FROM {name}_f, generate_series(0, 9 * {n} - 1) s(t) WHERE t < (2 * p - 1) * {n} GROUP BY bank, idx, xi, t % {n}),
{name}_h AS (SELECT bank, idx, w, CASE WHEN xi IS NULL THEN low ELSE band - first_value(band) OVER o / first_value(low) OVER o * low END AS h FROM {name}_bell WINDOW o AS (PARTITION BY bank, idx ORDER BY w)),
{name}_g AS (SELECT bank, idx, t, sum(h * cos(2 * pi() * ((w * t) % {n}) / {n})) / {n} AS re, sum(h * sin(2 * pi() * ((w * t) % {n}) / {n})) / {n} AS im FROM {name}_h, generate_series(0, {n} - 1) s(t) GROUP BY bank, idx, t),
{name}_l AS (SELECT bank, idx, sum(sqrt(re * re + im * im)) AS l FROM {name}_g GROUP BY bank, idx),
{name} AS (SELECT g.bank, g.idx, g.t, g.re / l AS re, g.im / l AS im FROM {name}_g g JOIN {name}_l USING (bank, idx))"""


def schedule(name: str, j: int, q: int) -> str:
    """CTE ``name``(idx, xi, sigma, j) of a bank's centres, widths and levels from J and Q alone: by constant ratio down to the least width, then by equal steps."""
    return f"""
{name}_0 AS (SELECT 0.1::DOUBLE / power(2, {j}) AS least, power(2, 1.0::DOUBLE / {q}) AS step, greatest(1 / (1 + power(2, 3.0::DOUBLE / {q})), 0.35::DOUBLE) AS xi),
{name}_1 AS (SELECT 1 AS i, xi, xi * (1 - 1 / step) / (1 + 1 / step) / sqrt(2 * ln(sqrt(2.0::DOUBLE))) AS sigma, step, least FROM {name}_0
  UNION ALL SELECT i + 1, xi / step, sigma / step, step, least FROM {name}_1 WHERE sigma > least * step),
{name}_2 AS (SELECT * FROM {name}_1 ORDER BY i DESC LIMIT 1),
{name}_3 AS (SELECT i, xi, sigma FROM {name}_1 UNION ALL SELECT e.i + m, e.xi - m * e.xi / {q}, e.least FROM {name}_2 e, generate_series(1, {q - 1}) g(m)),
{name} AS (SELECT i AS idx, xi, sigma, CAST(floor(-log2(least(abs(xi) + 5 * sigma, 0.5::DOUBLE))) - 1 AS INT) AS j FROM {name}_3)"""


def derived_time_sql(j: int, q: tuple[int, int], t: float, n: int, padded: tuple[int, int], source: str, digits: int = 6) -> str:
    """``time_sql`` of a local average and its widest stride from the arguments: filters, levels, pairs and path numbers are made in SQL, none is read off a plan.

    padded: samples after padding, and those before the signal.
    """
    length, left = padded
    stride = int(t).bit_length() - 1
    folds = "least(ceil(sqrt(-2 * sigma * sigma * ln(1e-7::DOUBLE)) + 1), 5)::INT"
    banks = f"SELECT 0, 0, NULL::DOUBLE, sigma, {folds} FROM (SELECT 0.1::DOUBLE / {t} AS sigma) UNION ALL SELECT 1, idx, xi, sigma, {folds} FROM f1 UNION ALL SELECT 2, idx, xi, sigma, {folds} FROM f2"
    start, end = -(-left // 2**stride), -(-(left + n) // 2**stride)
    return f"""WITH RECURSIVE {schedule('f1', j, q[0])},{schedule('f2', j, q[1])},{kernels('g', length, banks)},
x AS ({source}),
u0 AS (SELECT id, unnest(generate_series(0, {length} - 1)) AS s, unnest(list_concat(list_reverse(x[2:{left + 1}]), x, list_reverse(x[{n - (length - n - left)}:{n - 1}]))) AS v FROM x),
k1 AS (SELECT idx AS n1, least(j, {stride}) AS k FROM f1),
{_u1(length)},
pr AS (SELECT (SELECT count(*) FROM f1) + row_number() OVER (ORDER BY a.idx, b.idx) AS path, a.idx AS n1, b.idx AS n2, least(a.j, {stride}) AS k1, greatest(least(b.j, {stride}) - least(a.j, {stride}), 0) AS k2, least(b.j, {stride}) AS s2 FROM f1 a JOIN f2 b ON b.j > a.j),
{_u2(length)},
z AS (SELECT id, s AS t, v, 0 AS k FROM u0),
every AS (SELECT id, 0 AS path, t, v FROM ({_low('z', 'id', length, stride)}) UNION ALL SELECT id, n1, t, v FROM ({_low('u1', 'id, n1', length, stride)}) UNION ALL SELECT id, path, t, v FROM ({_low('u2', 'id, path', length, stride)}))
SELECT id, path::INT AS path_idx, (t - {start})::INT AS t, round(v, {digits}) + 0.0 AS value FROM every WHERE t >= {start} AND t < {end}"""


def _time_banks(plan: TimePlan) -> list[tuple[int, int, float | None, Filter]]:
    return [(0, 0, None, plan.phi), *((1, i, f.xi, f) for i, f in enumerate(plan.psi1, 1)), *((2, i, f.xi, f) for i, f in enumerate(plan.psi2, 1))]


def _padded(plan: TimePlan, source: str) -> str:
    left, right = plan.pad
    return f"""
x AS ({source}),
u0 AS (SELECT id, unnest(generate_series(0, {plan.n_padded} - 1)) AS s, unnest(list_concat(list_reverse(x[2:{left + 1}]), x, list_reverse(x[{plan.n - right}:{plan.n - 1}]))) AS v FROM x)"""


def _first(plan: TimePlan, stride: int) -> str:
    local = plan.local
    k1 = [(i, min(f.j, stride) if local else f.j) for i, f in enumerate(plan.psi1, 1)]
    return f"\nk1(n1, k) AS (VALUES {_values(k1)}),\n{_u1(plan.n_padded)}"


def _u1(n: int) -> str:
    """CTE u1(id, n1, k, t, v): moduli of the padded signals through the first-order filters, at resolution 2^k."""
    return f"""u1 AS (SELECT id, n1, k, t, sqrt(power(sum(v * re), 2) + power(sum(v * im), 2)) AS v FROM (
  SELECT u.id, k1.n1, k1.k, o.t, u.v, g.re, g.im FROM u0 u, k1, generate_series(0, {n} - 1) o(t) JOIN g ON g.bank = 1 AND g.idx = k1.n1 AND g.t = (((o.t << k1.k) - u.s) % {n} + {n}) % {n} WHERE o.t < ({n} >> k1.k)) GROUP BY id, n1, k, t)"""


def _u2(n: int) -> str:
    """CTE u2(id, path, k, t, v): moduli of u1 through the second-order filters of the pairs in pr."""
    return f"""u2 AS (SELECT id, path, s2 AS k, t, sqrt(power(sum(v * re), 2) + power(sum(v * im), 2)) * power(2, any_value(k1)) AS v FROM (
  SELECT u.id, pr.path, pr.s2, pr.k1, o.t, u.v, g.re, g.im FROM u1 u JOIN pr USING (n1), generate_series(0, {n} - 1) o(t)
  JOIN g ON g.bank = 2 AND g.idx = pr.n2 AND g.t = (((((o.t << pr.k2) - u.t) % ({n} >> pr.k1) + ({n} >> pr.k1)) % ({n} >> pr.k1)) << pr.k1) WHERE o.t < ({n} >> (pr.k1 + pr.k2))) GROUP BY id, path, s2, t)"""


def _low(source: str, keys: str, n: int, stride: int, k: str = "k") -> str:
    """Samples (keys, k, t, v) at resolution 2^k through the low-pass to resolution 2^stride."""
    m = f"({n} >> {k})"
    return f"""SELECT {keys}, o.t, sum(u.v * power(2, {k}) * g.re) AS v FROM {source} u, generate_series(0, ({n} >> {stride}) - 1) o(t)
  JOIN g ON g.bank = 0 AND g.t = (((((o.t << ({stride} - {k})) - u.t) % {m} + {m}) % {m}) << {k}) GROUP BY {keys}, o.t"""


def time_sql(plan: TimePlan, source: str, digits: int = 6) -> str:
    """id, path_idx, t, value of every coefficient. source: SELECT id, x (list of doubles)."""
    n, stride, local = plan.n_padded, plan.log2_stride, plan.local
    pairs = []
    for p in plan.paths:
        if p["order"] == 2:
            k1 = min(p["j1"], stride) if local else p["j1"]
            s2 = min(p["j2"], stride) if local else p["j2"]
            pairs.append((p["path_idx"], p["n1"], p["n2"], k1, max(s2 - k1, 0), s2))
    parts = [kernels("g", n, _time_banks(plan)), _padded(plan, source), _first(plan, stride)]
    second = f"\npr(path, n1, n2, k1, k2, s2) AS (VALUES {_values(pairs) if pairs else '(0, 0, 0, 0, 0, 0)'}),\n{_u2(n)}"
    parts.append(second)
    if local:
        s, e = plan.borders[stride]
        parts.append(f"""
z AS (SELECT id, s AS t, v, 0 AS k FROM u0),
every AS (SELECT id, 0 AS path, t, v FROM ({_low('z', 'id', n, stride)}) UNION ALL SELECT id, n1, t, v FROM ({_low('u1', 'id, n1', n, stride)}) UNION ALL SELECT id, path, t, v FROM ({_low('u2', 'id, path', n, stride)}))""")
        pick = f"SELECT id, path AS path_idx, t - {s} AS t, v FROM every WHERE t >= {s} AND t < {e}"
    else:
        parts.append("\nevery AS (SELECT id, 0 AS path, 0 AS k, s AS t, v FROM u0 UNION ALL SELECT id, n1, k, t, v FROM u1 UNION ALL SELECT id, path, k, t, v FROM u2)")
        if plan.average == "global":
            pick = "SELECT id, path AS path_idx, 0 AS t, sum(v) AS v FROM every GROUP BY id, path"
        else:
            ends = _values([(k, s, e) for k, (s, e) in enumerate(plan.borders)])
            pick = f"SELECT id, path AS path_idx, t - s AS t, v FROM every JOIN (VALUES {ends}) b(k, s, e) USING (k) WHERE t >= s AND t < e"
    most = len(plan.paths)
    return f"WITH {','.join(parts)}\nSELECT id, path_idx::INT AS path_idx, t::INT AS t, round(v, {digits}) + 0.0 AS value FROM ({pick}) WHERE path_idx < {most}" + ("" if pairs else " AND path_idx <= " + str(most - 1))


def _joint_tables(plan: JointPlan) -> tuple[str, str, str, str, str, str]:
    """Of the default averages and strides and the joint format: CTEs of the schedules, then SELECTs of the banks in time, of k1, of the
    frequential banks, of the members of each second-order input and of the branches, all from J, Q, J_fr, Q_fr and T."""
    op, stride, f = plan.time, plan.time.log2_stride, plan.J_fr
    if (plan.format, plan.out_type, plan.average_fr, plan.log2_stride_fr, plan.f) != ("joint", "array", "local", f, float(2**f)) or (op.average, stride) != ("local", op.log2_t):
        raise ValueError("Derived tables are for the default averages and strides and an array of joint paths.")
    folds = "least(ceil(sqrt(-2 * sigma * sigma * ln(1e-7::DOUBLE)) + 1), 5)::INT"
    schedules = f"""{schedule('f1', op.J, op.Q[0])},{schedule('f2', op.J, op.Q[1])},{schedule('f3', plan.J_fr, plan.Q_fr)},
fr AS (SELECT 1 AS idx, 0.0::DOUBLE AS xi, 0.1::DOUBLE / {2**f} AS sigma, CAST(floor(-log2(least(0.5::DOUBLE / {2**f}, 0.5::DOUBLE))) - 1 AS INT) AS j
  UNION ALL SELECT 1 + idx, xi, sigma, j FROM f3 UNION ALL SELECT 1 + (SELECT count(*) FROM f3) + idx, -xi, sigma, j FROM f3)"""
    time = f"SELECT 0, 0, NULL::DOUBLE, sigma, {folds} FROM (SELECT 0.1::DOUBLE / {op.t} AS sigma) UNION ALL SELECT 1, idx, xi, sigma, {folds} FROM f1 UNION ALL SELECT 2, idx, xi, sigma, {folds} FROM f2"
    k1 = f"SELECT idx, least(j, {stride}) FROM f1"
    frequency = f"SELECT 3, idx, nullif(xi, 0), sigma, {folds} FROM fr UNION ALL SELECT 4, 0, NULL, sigma, {folds} FROM fr WHERE idx = 1"
    members = f"SELECT b.idx, row_number() OVER (PARTITION BY b.idx ORDER BY a.idx) - 1, a.idx, least(a.j, {stride}), least(b.j - least(a.j, {stride}), {stride}) FROM f2 b JOIN f1 a ON a.j < b.j"
    inputs = "SELECT 0 AS n2, NULL::INT AS j UNION ALL SELECT idx, j FROM f2 WHERE EXISTS (SELECT 1 FROM f1 WHERE f1.j < f2.j)"
    branches = f"""SELECT row_number() OVER (ORDER BY n2 > 0, n2, fr.idx), n2, fr.idx, least(fr.j, {f}), sign(fr.xi)::INT, (fr.xi <> 0)::INT, least(fr.j, {f}),
  CASE WHEN fr.xi = 0 THEN {plan.n_padded_fr} >> least(fr.j, {f}) ELSE {plan.n_padded_fr} >> {f} END, fr.j, coalesce(i.j, {stride}) FROM ({inputs}) i, fr WHERE n2 > 0 OR fr.xi >= 0"""
    return schedules, time, k1, frequency, members, branches


def joint_sql(plan: JointPlan, source: str, digits: int = 6, renorm_eps: float | None = None, derived: bool = False) -> str:
    """id, path_idx, band, t, value of the joint format with a local time average; of the time format path_idx is the branch, from one.

    ``derived``: filters, levels, members and branches are made in SQL from the arguments, not read off the plan.
    """
    op = plan.time
    assert op.local
    n, nf, stride = op.n_padded, plan.n_padded_fr, op.log2_stride
    start, end = op.borders[stride]
    path_of = {k: i for i, (k, _) in enumerate(plan.layout, 1)} if plan.format == "joint" else {k: k + 1 for k in range(len(plan.branches))}
    branches, members, rows = [], [], []
    for k, b in enumerate(plan.branches):
        last = 1 if b.average == "global" else (nf >> plan.log2_stride_fr if b.average == "local" else nf >> plan.k_fr(b.j_fr))
        keep = min(last, plan.rows_kept(b)) if plan.trims else last
        kin = min(b.j_fr, plan.log2_f)
        if renorm_eps is not None and b.n2 and b.spin and b.average == "none":
            keep = min(keep, -(-len(b.bands) // (1 << b.j_fr)))
        branches.append((path_of[k], b.n2 or 0, b.n_fr, plan.k_fr(b.j_fr), b.spin, {"none": 0, "local": 1, "global": 2}[b.average], kin, keep, b.j_fr, op.psi2[b.n2 - 1].j if b.n2 else stride))
        if b.n2:
            members += [(b.n2, r, n1, min(op.psi1[n1 - 1].j, stride), min(op.psi2[b.n2 - 1].j - min(op.psi1[n1 - 1].j, stride), stride)) for r, n1 in enumerate(b.bands)] if not any(m[0] == b.n2 for m in members) else []
    banks = [(3, i, None if i == 1 else w.xi, w) for i, w in enumerate(plan.psi_fr, 1)] + [(4, 0, None, plan.phi_fr)]
    zero = f"z AS (SELECT id, s AS t, v, 0 AS k FROM u0)"
    in_time, first, member_rows, branch_rows, before = _time_banks(op), _first(op, stride), f"VALUES {_values(members)}", f"VALUES {_values(branches)}", []
    if derived:
        schedules, in_time, k1, banks, member_rows, branch_rows = _joint_tables(plan)
        first, before = f"\nk1(n1, k) AS ({k1}),\n{_u1(n)}", [schedules]
    parts = [
        *before, kernels("g", n, in_time), kernels("f", nf, banks), _padded(op, source), first, f"\n{zero}",
        f"\ns1 AS ({_low('u1', 'id, n1', n, stride)})",
        f"\nm(n2, r, n1, k1, k2) AS ({member_rows})",
        f"""
y AS (SELECT id, 0 AS n2, n1 - 1 AS r, t, v AS re, {'0.0::DOUBLE' if derived else '0.0'} AS im FROM s1 UNION ALL
  SELECT u.id, m.n2, m.r, o.t, sum(u.v * power(2, m.k1) * g.re), sum(u.v * power(2, m.k1) * g.im) FROM u1 u JOIN m USING (n1), generate_series(0, {n} - 1) o(t)
  JOIN g ON g.bank = 2 AND g.idx = m.n2 AND g.t = (((((o.t << m.k2) - u.t) % ({n} >> m.k1) + ({n} >> m.k1)) % ({n} >> m.k1)) << m.k1) WHERE o.t < ({n} >> (m.k1 + m.k2)) GROUP BY u.id, m.n2, m.r, o.t)""",
        f"\nb(path, n2, n_fr, kfr, spin, avg, kin, keep, jfr, j2) AS ({branch_rows})",
        f"""
c AS (SELECT id, path, n2, avg, kin, j2 AS k, q, t, sqrt(power(sum(re * fr - im * fi), 2) + power(sum(re * fi + im * fr), 2)) AS v FROM (
  SELECT y.id, b.path, b.n2, b.avg, b.kin, b.j2, o.q, y.t, y.re, y.im, f.re AS fr, f.im AS fi FROM y JOIN b USING (n2), generate_series(0, {nf} - 1) o(q)
  JOIN f ON f.bank = 3 AND f.idx = b.n_fr AND f.t = (((o.q << b.kfr) - y.r) % {nf} + {nf}) % {nf} WHERE o.q < ({nf} >> b.kfr)) GROUP BY id, path, n2, avg, kin, j2, q, t)""",
        f"\nct AS (SELECT id, path, avg, kin, q, t, v FROM c WHERE n2 = 0 UNION ALL SELECT id, path, avg, kin, q, t, v FROM ({_low('(SELECT * FROM c WHERE n2 > 0)', 'id, path, avg, kin, q', n, stride)}))",
        f"""
cf AS (SELECT id, path, q, t, v FROM ct WHERE avg = 0 UNION ALL SELECT id, path, 0, t, sum(v) FROM ct WHERE avg = 2 GROUP BY id, path, t UNION ALL
  SELECT u.id, u.path, o.q, u.t, sum(u.v * power(2, u.kin) * f.re) FROM ct u, generate_series(0, ({nf} >> {plan.log2_stride_fr}) - 1) o(q)
  JOIN f ON f.bank = 4 AND f.t = (((((o.q << ({plan.log2_stride_fr} - u.kin)) - u.q) % ({nf} >> u.kin) + ({nf} >> u.kin)) % ({nf} >> u.kin)) << u.kin) WHERE u.avg = 1 GROUP BY u.id, u.path, o.q, u.t)""",
    ]
    value = "cf.v"
    if renorm_eps is not None:
        step = plan.log2_stride_fr
        parts.append(f"""
sb AS (SELECT s1.id, m.n2, m.r, s1.t, s1.v FROM s1 JOIN m USING (n1)),
d AS (SELECT sb.id, b.path, 0 AS q, sb.t, sum(sb.v) AS v FROM sb JOIN b USING (n2) WHERE b.avg = 2 GROUP BY sb.id, b.path, sb.t UNION ALL
  SELECT sb.id, b.path, sb.r >> b.jfr, sb.t, sb.v FROM sb JOIN b USING (n2) WHERE b.avg = 0 AND b.spin <> 0 AND sb.r % (1 << b.jfr) = 0 UNION ALL
  SELECT sb.id, b.path, o.q, sb.t, sum(sb.v * f.re) FROM sb JOIN b USING (n2), generate_series(0, {nf} - 1) o(q)
  JOIN f ON f.bank = CASE WHEN b.spin = 0 THEN 3 ELSE 4 END AND f.idx = CASE WHEN b.spin = 0 THEN b.n_fr ELSE 0 END
    AND f.t = (((o.q << CASE WHEN b.spin = 0 THEN b.kfr ELSE {step} END) - sb.r) % {nf} + {nf}) % {nf}
  WHERE (b.avg = 1 OR b.spin = 0) AND o.q < ({nf} >> CASE WHEN b.spin = 0 THEN b.kfr ELSE {step} END) GROUP BY sb.id, b.path, o.q, sb.t)""")
        value = f"cf.v / (coalesce(d.v, 1.0 - {renorm_eps!r}) + {renorm_eps!r})"
    join = " LEFT JOIN d ON d.id = cf.id AND d.path = cf.path AND d.q = cf.q AND d.t = cf.t" if renorm_eps is not None else ""
    return f"""WITH{' RECURSIVE' * derived} {','.join(parts)},
every AS (SELECT id, 0 AS path, 0 AS q, t, v FROM ({_low('z', 'id', n, stride)}) UNION ALL SELECT cf.id, cf.path, cf.q, cf.t, {value} FROM cf JOIN b USING (path){join} WHERE cf.q < b.keep)
SELECT id, path::INT AS path_idx, q::INT AS band, (t - {start})::INT AS t, round(v, {digits}) + 0.0 AS value FROM every WHERE t >= {start} AND t < {end}"""


def time_format_sql(plan: JointPlan, source: str, digits: int = 6) -> str:
    """id, path_idx, t, value of the time format: each band row of a branch is a path, in the order of (first-order wavelet, n2, n_fr)."""
    rows = [(i, k + 1, row) for i, (k, row) in enumerate(plan.layout, 1)]
    return f"""SELECT c.id, l.path_idx::INT AS path_idx, c.t, c.value FROM ({joint_sql(plan, source, digits)}) c
JOIN (VALUES (0, 0, 0), {_values(rows)}) l(path_idx, branch, band) ON c.path_idx = l.branch AND c.band = l.band"""


def joint_paths_sql(plan: JointPlan) -> str:
    """The path table of the joint format from the filters alone: which branches there are, their order and labels."""
    assert plan.format == "joint"
    listed = lambda bank: _values([(i, float(f.xi or 0), float(f.sigma), f.j) for i, f in enumerate(bank, 1)])
    return f"""WITH p1(i, xi, sigma, j) AS (VALUES {listed(plan.time.psi1)}), p2(i, xi, sigma, j) AS (VALUES {listed(plan.time.psi2)}), fr(i, xi, sigma, j) AS (VALUES {listed(plan.psi_fr)}),
under AS (SELECT 1 AS ord, NULL::INT AS n2, NULL::INT AS j2, NULL::DOUBLE AS xi2, NULL::DOUBLE AS sigma2 UNION ALL SELECT 2, i, j, xi, sigma FROM p2 WHERE EXISTS (SELECT 1 FROM p1 WHERE p1.j < p2.j)),
b AS (SELECT ord, n2, j2, xi2, sigma2, fr.i AS n_fr, fr.j AS j_fr, fr.xi AS xi_fr, fr.sigma AS sigma_fr, sign(fr.xi)::INT AS spin FROM under, fr WHERE ord = 2 OR fr.xi >= 0),
every AS (SELECT 0 AS ord, NULL AS n2, NULL AS j2, NULL AS xi2, NULL AS sigma2, NULL AS n_fr, NULL AS j_fr, NULL AS xi_fr, NULL AS sigma_fr, NULL AS spin UNION ALL SELECT * FROM b)
SELECT (row_number() OVER (ORDER BY ord, n2, n_fr) - 1)::INT AS path_idx, ord::INT AS "order", NULL::INT AS n1, n2::INT AS n2, n_fr::INT AS n_fr, NULL::INT AS j1, j2::INT AS j2, j_fr::INT AS j_fr,
  NULL::DOUBLE AS xi1, xi2::DOUBLE AS xi2, xi_fr::DOUBLE AS xi_fr, NULL::DOUBLE AS sigma1, sigma2::DOUBLE AS sigma2, sigma_fr::DOUBLE AS sigma_fr, spin::INT AS spin,
  CASE ord WHEN 0 THEN 'S0' WHEN 1 THEN 'J1_' || n_fr ELSE 'J2_' || n2 || '_' || n_fr END || CASE WHEN ord = 0 THEN '' WHEN spin > 0 THEN 'u' WHEN spin < 0 THEN 'd' ELSE 'n' END AS label FROM every"""
