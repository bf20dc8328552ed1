"""The cascades over one Arrow batch of signals, as matrices: axis 0 is the signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ondula.plans.joint_plan import Branch, JointPlan
from ondula.plans.time_plan import TimePlan

Array = np.ndarray


def modulus(z: Array) -> Array:
    return np.sqrt(z.real * z.real + z.imag * z.imag)


def filtered(spectrum: Array, h: Array, k: int, axis: int = 1) -> Array:
    """The inverse transform of ``spectrum * h`` kept at every k-th sample: blocks of the product are averaged."""
    m = spectrum.shape[axis] // k
    shape = [1] * spectrum.ndim
    shape[axis] = -1
    product = spectrum * h.reshape(shape)
    blocks = product.reshape(*product.shape[:axis], k, m, *product.shape[axis + 1 :])
    return np.fft.ifft(blocks.sum(axis=axis) / k, axis=axis)


def padded(plan: TimePlan, x: Array) -> Array:
    return np.pad(x, ((0, 0), plan.pad), mode="reflect")


def _crop(plan: TimePlan, y: Array, level: int) -> Array:
    start, end = plan.borders[max(level, 0)]
    return y[..., start:end]


def scatter_time(plan: TimePlan, x: Array, wanted: set[int] | None = None) -> Iterator[tuple[int, Array]]:
    """(path, coefficients) of a batch, one path at a time; ``wanted`` prunes filters that no path needs."""
    need = (lambda i: True) if wanted is None else wanted.__contains__
    stride, local, phi = plan.log2_stride, plan.local, plan.phi
    by_pair = {(p["n1"], p["n2"]): p["path_idx"] for p in plan.paths}

    def finish(y: Array, level: int) -> Array:
        if plan.average == "global":
            return y.sum(axis=1, keepdims=True)
        return _crop(plan, y, stride if local else level)

    u0 = padded(plan, x)
    spectrum = np.fft.fft(u0, axis=1)
    if need(0):
        yield 0, finish(filtered(spectrum, phi.h, 1 << stride).real if local else u0, 0)
    for n1, f in enumerate(plan.psi1, 1):
        seconds = [(n2, g) for n2, g in enumerate(plan.psi2, 1) if (n1, n2) in by_pair and need(by_pair[n1, n2])]
        if not seconds and not need(by_pair[n1, None]):
            continue
        k1 = min(f.j, stride) if local else f.j
        u1 = modulus(filtered(spectrum, f.h, 1 << k1))
        hat = np.fft.fft(u1, axis=1) if local or seconds else None
        if need(by_pair[n1, None]):
            yield by_pair[n1, None], finish(filtered(hat, phi.level(k1), 1 << (stride - k1)).real if local else u1, f.j)
        for n2, g in seconds:
            s2 = min(g.j, stride) if local else g.j
            k2 = max(s2 - k1, 0)
            u2 = modulus(filtered(hat, g.level(k1), 1 << k2))
            if local:
                u2 = filtered(np.fft.fft(u2, axis=1), phi.level(k1 + k2), 1 << (stride - s2)).real
            yield by_pair[n1, n2], finish(u2, g.j)


def over_parents(plan: TimePlan, paths: Iterator[tuple[int, Array]], eps: float) -> Iterator[tuple[int, Array]]:
    """Second-order coefficients over their first-order parent plus eps, in the order of ``scatter_time``: a parent comes before its children."""
    kinds = {p["path_idx"]: (p["order"], p["n1"]) for p in plan.paths}
    parent: tuple[int | None, Array | None] = (None, None)
    for i, y in paths:
        order, n1 = kinds[i]
        if order == 1:
            parent = n1, y
        if order == 2:
            if parent[0] != n1 or parent[1].shape != y.shape:
                raise ValueError("Renormalisation needs the first-order parent of each second-order path, as long as the path.")
            y = y / (parent[1] + eps)
        yield i, y


def summarised(paths: list[tuple[int, Array]], p: float, least: float, none: float) -> Iterator[tuple[int, Array]]:
    """(path, [signal, (mean, sd, median, max)]) of log-compressed coefficients over each signal's floor, the p-quantile of its positive finite values."""
    every = np.concatenate([y for _, y in paths], axis=1)
    every = np.sort(np.where((every > 0) & np.isfinite(every), every, np.inf), axis=1)
    count = np.isfinite(every).sum(axis=1)
    h = np.maximum(count - 1, 0) * p
    low = np.floor(h).astype(np.int64)
    rows = np.arange(len(every))
    a, b = every[rows, low], every[rows, np.minimum(low + 1, np.maximum(count - 1, 0))]
    with np.errstate(invalid="ignore"):
        eps = np.where(count > 0, np.maximum(a + (h - low) * (b - a), least), none)[:, None]
    for i, y in paths:
        v = np.sign(y) * np.log1p(np.abs(y) / eps)
        sd = v.std(axis=1, ddof=1) if v.shape[1] > 1 else np.full(len(v), np.nan)
        yield i, np.stack([v.mean(axis=1), sd, np.median(v, axis=1), v.max(axis=1)], axis=1)


def scatter_joint(plan: JointPlan, x: Array, branches: set[int] | None = None, zero: bool = True, s1: bool = True) -> tuple[Array | None, Array | None, dict[int, Array]]:
    """(order 0, S1, coefficients by branch) of a batch; coefficients are [signal, band row, time].

    ``branches``: the places of the wanted ones, all for None.  What only others need is never filtered: read backwards, a
    branch needs the second-order input under it, an input the first-order bands it covers, and S1 all of them.
    Order 0 and S1 are None where they are not asked for.
    """
    op, stride, local = plan.time, plan.time.log2_stride, plan.time.local
    wanted = [(i, b) for i, b in enumerate(plan.branches) if branches is None or i in branches]
    along_s1 = any(b.n2 is None for _, b in wanted)
    bands = range(1, len(op.psi1) + 1) if s1 or along_s1 else sorted({n for _, b in wanted for n in b.bands})

    u0 = padded(op, x)
    spectrum = np.fft.fft(u0, axis=1) if bands or zero and local else None
    order0 = None
    if zero and local:
        order0 = _crop(op, filtered(spectrum, op.phi.h, 1 << stride).real, stride)
    elif zero:
        order0 = u0.sum(axis=1, keepdims=True) if op.average == "global" else _crop(op, u0, 0)
    k1 = {n: min(op.psi1[n - 1].j, stride) if local else op.psi1[n - 1].j for n in bands}
    hats = {n: np.fft.fft(modulus(filtered(spectrum, op.psi1[n - 1].h, 1 << k)), axis=1) for n, k in k1.items()}
    first = np.stack([filtered(hats[n], op.phi.level(k), 1 << (stride - k)).real for n, k in k1.items()], axis=1) if s1 or along_s1 else None

    out: dict[int, Array] = {}
    inputs: dict[int | None, Array] = {}
    for i, b in wanted:
        if b.n2 not in inputs:  # branches of one input follow each other; only its spectrum is held
            if b.n2 is None:
                rows = first
            else:
                g = op.psi2[b.n2 - 1]
                rows = np.stack([filtered(hats[n], g.level(k1[n]), 1 << (min(g.j - k1[n], stride) if local else g.j - k1[n])) for n in b.bands], axis=1)
            inputs = {b.n2: _along_bands(plan, rows)}
        out[i] = _branch(plan, b, inputs[b.n2])
    if not s1:
        return order0, None, out
    return order0, _crop(op, first, stride) if local else first, out


def _along_bands(plan: JointPlan, rows: Array) -> Array:
    return np.fft.fft(rows, n=plan.n_padded_fr, axis=1)  # zero rows up to the padded axis


def _branch(plan: JointPlan, b: Branch, spectrum: Array) -> Array:
    op = plan.time
    keep = plan.rows_kept(b)
    c = modulus(filtered(spectrum, plan.psi_fr[b.n_fr - 1].h, 1 << plan.k_fr(b.j_fr)))
    if plan.trims and b.average == "none":
        c = c[:, :keep]  # rows that nothing will average are dropped before the time average
    if op.average == "global":
        c = c.sum(axis=2, keepdims=True)
    elif op.local and b.n2:
        j2 = op.psi2[b.n2 - 1].j
        c = filtered(np.fft.fft(c, axis=2), op.phi.level(j2), 1 << (op.log2_stride - j2), axis=2).real
    if b.average == "global":
        c = c.sum(axis=1, keepdims=True)
    elif b.average == "local":
        k = min(b.j_fr, plan.log2_f)
        c = filtered(np.fft.fft(c, axis=1), plan.phi_fr.level(k), 1 << (plan.log2_stride_fr - k)).real
    if plan.trims:
        c = c[:, :keep]
    if op.average == "global":
        return c
    level = op.psi2[b.n2 - 1].j if op.average == "none" and b.n2 else op.log2_stride
    return _crop(op, c, level)


def joint_paths(plan: JointPlan, zero: Array | None, branches: dict[int, Array], wanted: set[int] | None = None) -> Iterator[tuple[int, Array]]:
    """(path, [signal, band row, time]) in output order; ``wanted``: the paths to give, all for None."""
    if wanted is None or 0 in wanted:
        yield 0, zero[:, None, :]
    for i, (k, row) in enumerate(plan.layout, 1):
        if wanted is None or i in wanted:
            yield i, branches[k] if row is None else branches[k][:, row : row + 1]


def denominator(plan: JointPlan, b: Branch, s1: Array) -> Array:
    """S1 of a branch's bands, laid out as the branch's rows: through its low-pass along frequency, without its wavelet."""
    picked = s1[:, [n - 1 for n in b.bands]]
    if b.average == "global":
        return picked.sum(axis=1, keepdims=True)
    if b.spin and b.average == "none":
        return picked[:, :: 1 << max(b.j_fr, 0)]
    low, k = (plan.phi_fr.h, plan.log2_stride_fr) if b.spin else (plan.psi_fr[b.n_fr - 1].h, plan.k_fr(b.j_fr))
    return filtered(_along_bands(plan, picked), low, 1 << k).real


def renormed(plan: JointPlan, s1: Array, branches: dict[int, Array], eps: float) -> dict[int, Array]:
    """Second-order branches over S1 plus eps. A numerator with a row more than its denominator loses that row."""
    out = dict(branches)
    for i, b in enumerate(plan.branches):
        if b.n2 and i in branches:
            d = denominator(plan, b, s1)
            rows = min(d.shape[1], branches[i].shape[1])
            out[i] = branches[i][:, :rows] / (d[:, :rows] + eps)
    return out
