"""The cascades against direct circular convolutions in the time domain, and the structure of their plans."""

import numpy as np
import pytest

from ondula.operators import kernels
from ondula.plans import filters
from ondula.plans.joint_plan import JointPlan
from ondula.plans.time_plan import TimePlan


def kernel_of(h, level, length):
    """Time kernel of a filter at a resolution: 2^k g[2^k t]."""
    g = np.fft.ifft(h)
    return (1 << level) * g[:: 1 << level][:length]


def conv(x, g, step):
    n = len(x)
    return np.array([sum(x[s] * g[(t - s) % n] for s in range(n)) for t in range(0, n, step)])


def reflect(plan, x):
    left, right = plan.pad
    return np.concatenate([x[1 : left + 1][::-1], x, x[-right - 1 : -1][::-1]])


def direct_time(plan, x):
    u0, out = reflect(plan, x), []
    stride, local = plan.log2_stride, plan.local

    def low(u, k):
        return conv(u, kernel_of(plan.phi.h, k, len(u)), 1 << (stride - k)).real

    def finish(y, level):
        if plan.average == "global":
            return np.array([y.sum()])
        s, e = plan.borders[stride if local else level]
        return y[s:e]

    u1s = {}
    out.append(finish(low(u0, 0) if local else u0, 0))
    for n1, f in enumerate(plan.psi1, 1):
        k1 = min(f.j, stride) if local else f.j
        u1s[n1] = np.abs(conv(u0, kernel_of(f.h, 0, len(u0)), 1 << k1)), k1
        out.append(finish(low(*u1s[n1]) if local else u1s[n1][0], f.j))
    for p in plan.paths:
        if p["order"] == 2:
            u1, k1 = u1s[p["n1"]]
            g = plan.psi2[p["n2"] - 1]
            s2 = min(g.j, stride) if local else g.j
            k2 = max(s2 - k1, 0)
            u2 = np.abs(conv(u1, kernel_of(g.h, k1, len(u1)), 1 << k2))
            out.append(finish(low(u2, k1 + k2) if local else u2, g.j))
    return out


@pytest.mark.parametrize("n,j,kw", [(64, 2, {"Q": 1}), (64, 3, {"Q": (2, 1)}), (100, 4, {"Q": (1, 2), "T": "global"}), (100, 4, {"Q": 1, "T": 0}), (128, 4, {"Q": (2, 1), "stride": 4}), (96, 3, {"Q": 1, "max_order": 1}), (150, 4, {"Q": 2, "T": 11})])
@pytest.mark.filterwarnings("ignore::UserWarning")
def test_time_cascade_is_a_chain_of_convolutions(n, j, kw):
    plan = TimePlan(n, j, **kw)
    x = np.random.default_rng(1).normal(size=(3, n))
    got = dict(kernels.scatter_time(plan, x))
    assert list(range(len(plan.paths))) == sorted(got)
    for b in range(3):
        for i, want in enumerate(direct_time(plan, x[b])):
            assert got[i][b].shape == want.shape
            np.testing.assert_allclose(got[i][b], want, atol=1e-10 * max(1, np.abs(want).max()))


def direct_joint(plan, x):
    op = plan.time
    stride, local = op.log2_stride, op.local
    u0 = reflect(op, x)
    u1s = []
    for f in op.psi1:
        k1 = min(f.j, stride) if local else f.j
        u1s.append((np.abs(conv(u0, kernel_of(f.h, 0, len(u0)), 1 << k1)), k1))
    s1 = np.array([conv(u, kernel_of(op.phi.h, k, len(u)), 1 << (stride - k)).real for u, k in u1s])
    out = []
    for b in plan.branches:
        if b.n2 is None:
            rows = s1
        else:
            g = op.psi2[b.n2 - 1]
            rows = np.array([conv(u1s[n - 1][0], kernel_of(g.h, k := u1s[n - 1][1], len(u1s[n - 1][0])), 1 << (min(g.j - k, stride) if local else g.j - k)) for n in b.bands])
        full = np.zeros((plan.n_padded_fr, rows.shape[1]), complex)
        full[: len(rows)] = rows
        w = plan.psi_fr[b.n_fr - 1]
        c = np.abs(np.stack([conv(full[:, t], np.fft.ifft(w.h), 1 << plan.k_fr(w.j)) for t in range(full.shape[1])], axis=1))
        if local and b.n2:
            c = np.stack([conv(r, kernel_of(op.phi.h, g.j, len(r)), 1 << (stride - g.j)).real for r in c])
        elif op.average == "global":
            c = c.sum(axis=1, keepdims=True)
        if b.average == "local":
            k = min(b.j_fr, plan.log2_f)
            c = np.stack([conv(c[:, t], kernel_of(plan.phi_fr.h, k, len(c)), 1 << (plan.log2_stride_fr - k)).real for t in range(c.shape[1])], axis=1)
        elif b.average == "global":
            c = c.sum(axis=0, keepdims=True)
        if plan.trims:
            c = c[: plan.rows_kept(b)]
        if op.average != "global":
            s, e = op.borders[op.psi2[b.n2 - 1].j if op.average == "none" and b.n2 else stride]
            c = c[:, s:e]
        out.append(c)
    return out


@pytest.mark.parametrize("kw", [{}, {"F": "global"}, {"F": 0}, {"format": "joint"}, {"format": "joint", "out_type": "list", "F": 0}, {"T": "global"}, {"T": 0, "format": "joint"}, {"T": 0}, {"stride_fr": 2}])
@pytest.mark.filterwarnings("ignore::UserWarning")
def test_joint_cascade_is_a_chain_of_convolutions(kw):
    kw = dict(kw)
    op = TimePlan(64, 3, Q=4, T=kw.pop("T", None))
    try:
        plan = JointPlan(op, J_fr=2, **kw)
    except ValueError as e:
        assert "default stride_fr" in str(e) and "stride_fr" in kw
        return
    x = np.random.default_rng(2).normal(size=(2, 64))
    _, _, got = kernels.scatter_joint(plan, x)
    for b in range(2):
        for i, want in enumerate(direct_joint(plan, x[b])):
            assert got[i][b].shape == want.shape
            np.testing.assert_allclose(got[i][b], want, atol=1e-10 * max(1, np.abs(want).max()))


@pytest.mark.filterwarnings("ignore::UserWarning")
def test_first_order_of_joint_is_time_scattering():
    op = TimePlan(256, 5, Q=4)
    plan = JointPlan(op, J_fr=2)
    x = np.random.default_rng(3).normal(size=(2, 256))
    time = dict(kernels.scatter_time(op, x))
    s1 = kernels.scatter_joint(plan, x)[1]
    for k in range(len(op.psi1)):
        np.testing.assert_array_equal(s1[:, k], time[k + 1])


@pytest.mark.parametrize("kw", [{}, {"F": "global"}, {"F": 0}, {"format": "joint"}, {"format": "joint", "out_type": "list", "F": 0}])
@pytest.mark.parametrize("scale", [0.01, 3.0, 1e4])
def test_renorm_removes_amplitude(kw, scale):
    plan = JointPlan(TimePlan(512, 5, Q=4), J_fr=2, **kw)
    x = np.random.default_rng(4).normal(size=(1, 512))

    def second(x):
        _, s1, br = kernels.scatter_joint(plan, x)
        out = kernels.renormed(plan, s1, br, 1e-16)
        return [out[i] for i, b in enumerate(plan.branches) if b.n2]

    for a, b in zip(second(x), second(scale * x)):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9 * np.abs(a).max())


def test_spin_tells_rising_from_falling_chirps():
    plan = JointPlan(TimePlan(2048, 8, Q=8), format="joint")
    t = np.arange(2048) / 2048
    rising = np.sin(2 * np.pi * 2048 * (0.02 * t + 0.09 * t**2))
    energy = {}
    for name, x in (("rising", rising), ("falling", rising[::-1])):
        br = kernels.scatter_joint(plan, x[None])[2]
        energy[name] = [sum(float((br[i] ** 2).sum()) for i, b in enumerate(plan.branches) if b.n2 and b.spin == s) for s in (1, -1)]
    assert (energy["rising"][0] - energy["rising"][1]) * (energy["falling"][0] - energy["falling"][1]) < 0


@pytest.mark.parametrize(
    "n,j,kw,padded,paths,samples",
    [(1800, 8, {"Q": (8, 1), "T": 30}, 4096, 234, 113), (2048, 6, {"Q": 8}, 4096, 126, 32), (4096, 7, {"Q": (8, 2), "stride": 16}, 8192, 350, 256), (3000, 6, {"Q": 12, "max_order": 1}, 8192, 53, 47), (720, 6, {"Q": (4, 1)}, 2048, 67, 11)],
)
def test_plan_sizes(n, j, kw, padded, paths, samples):
    plan = TimePlan(n, j, **kw)
    s, e = plan.borders[plan.log2_stride]
    assert (plan.n_padded, len(plan.paths), e - s) == (padded, paths, samples)


@pytest.mark.parametrize("n,j,kw,padded,paths", [(4096, 6, {}, 120, 152), (4096, 6, {"format": "joint", "out_type": "list"}, 120, 42), (4096, 6, {"F": 0}, 120, 763), (16000, 10, {}, 152, 442)])
def test_joint_plan_sizes(n, j, kw, padded, paths):
    plan = JointPlan(TimePlan(n, j, Q=8), **kw)
    assert (plan.n_padded_fr, len(plan.paths)) == (padded, paths)


def test_frequency_bank():
    plan = JointPlan(TimePlan(4096, 6, Q=8))
    assert [f.j for f in plan.psi_fr[:5]] == [3, 0, 0, 0, 1] and len(plan.psi_fr) == 9
    assert plan.psi_fr[5].xi == -plan.psi_fr[1].xi


@pytest.mark.parametrize(
    "kw,message",
    [
        ({"n": 0}, "n must be"), ({"J": 0}, "J must be"), ({"J": 9}, "Use J <= 8"), ({"Q": 0}, "Q must be at least 1"), ({"Q": (1, 2, 3)}, "one or two"), ({"max_order": 3}, "max_order must be 1 or 2"),
        ({"sr": -1.0}, "sr must be"), ({"T_sec": 1.0}, "T_sec needs sr"), ({"T": 0.5}, "0 or at least 1"), ({"T": float("nan")}, "0 or at least 1"), ({"T": 1000}, "exceeds the signal length"), ({"T": "all"}, "global"),
        ({"T": 0, "stride": 2}, "only applies"), ({"stride": 3}, "power of two"), ({"stride": 64}, "alias"),
    ],
)
def test_time_errors(kw, message):
    with pytest.raises(ValueError, match=message):
        TimePlan(**({"n": 256, "J": 4} | kw))


@pytest.mark.parametrize("kw,message", [({"J_fr": 0}, "J_fr must"), ({"Q_fr": 0}, "Q_fr must"), ({"J_fr": 9}, "first-order bands"), ({"format": "joint", "F": 0}, "needs frequential averaging"), ({"format": "x"}, "format must"), ({"out_type": "x"}, "out_type must"), ({"F": 0.5}, "F must be 0"), ({"F": 0, "stride_fr": 2}, "only applies")])
def test_joint_errors(kw, message):
    with pytest.raises(ValueError, match=message):
        JointPlan(TimePlan(256, 4, Q=4), **kw)


def test_joint_needs_averages_as_wide_as_its_wavelets():
    with pytest.raises(ValueError, match="shorter than the widest"):
        JointPlan(TimePlan(256, 5, Q=4, T=4))


def test_seconds_override_samples_and_round_to_even():
    assert TimePlan(100, 3, T=50, T_sec=2.5, sr=1).t == 2.0
    assert TimePlan(100, 3, T_sec=0.1, sr=1).average == "none"


def test_filters():
    for n, xi, s in ((256, 0.3, 0.05), (128, None, 0.02), (512, 0.1, 0.02)):
        h = filters.morlet(n, xi, s)
        assert abs(np.abs(np.fft.ifft(h)).sum() - 1) < 1e-12
        if xi is not None:
            assert abs(h[0]) < 1e-15
    assert filters.periods(0.1) == 2
    assert filters.xi_max(1) == 0.35
    assert filters.fftfreq(4).tolist() == [0.0, 0.25, -0.5, -0.25]
