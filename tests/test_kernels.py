import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from squallframe.kernels import model as M
from squallframe.kernels import raster as R
from squallframe.kernels import segment as S
from squallframe.kernels import solver as V

RNG = np.random.default_rng(3)


def flood(mask, diagonal):
    seen, out, k = np.zeros(mask.shape, int), [], 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            k += 1
            stack, n = [(y, x)], 0
            seen[y, x] = k
            while stack:
                a, b = stack.pop()
                n += 1
                for dy, dx in steps:
                    c, d = a + dy, b + dx
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                        seen[c, d] = k
                        stack.append((c, d))
            out.append(n)
    return seen, out


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("shape,share", [((17, 23), 0.5), ((40, 40), 0.6), ((1, 9), 0.5), ((5, 1), 0.5), ((6, 6), 0.0), ((6, 6), 1.0)])
def test_components(shape, share, diagonal):
    m = RNG.random(shape) < share
    lab, area = R.components(m, diagonal)
    want, sizes = flood(m, diagonal)
    assert (lab == want).all() and area.tolist() == sizes


def test_holes_boundary_dilation():
    m = np.zeros((7, 7), bool)
    m[1:6, 1:6] = True
    m[3, 3] = False
    assert R.fill_holes(m)[3, 3] and R.fill_holes(m).sum() == 25
    assert (R.dilate(m, 0) == m).all()
    assert R.dilate(np.eye(5, dtype=bool), 1).sum() == 13
    lab = np.repeat([[1, 1, 2, 2]], 4, 0)
    assert R.boundary(lab).sum() == 8 and R.boundary(np.ones((3, 3), int)).sum() == 0


def test_resampling():
    a = RNG.random((8, 8))
    assert np.allclose(R.resize_cubic(a, 8, 8), a) and R.resize_cubic(a, 16, 12).shape == (16, 12)
    assert np.allclose(R.resize_cubic(np.ones((4, 4)), 9, 7), 1)
    assert set(np.unique(R.resize_nearest(np.array([[1, 5], [7, 9]]), 5, 5))) == {1, 5, 7, 9}
    g = np.arange(5.0)
    v = g[:, None] * 2 + g[None] * 3
    assert np.allclose(R.grid_linear(g, g, v, np.array([0.5, 9.0]), np.array([1.25, 1.0])), [1 + 3.75, 0])
    assert R.grid_nearest(g, g, v, np.array([0.5]), np.array([2.6]), -1)[0] == 9


def test_flow_and_warp():
    y, x = np.mgrid[:48, :48]
    f = lambda s: 100 * np.exp(-((y - 24) ** 2 + (x - 22 - s) ** 2) / 60.0)
    flow = R.lucas_kanade(f(0), f(1))
    assert abs(flow[20:29, 18:28, 0].mean() - 1) < 0.2 and abs(flow[20:29, 18:28, 1].mean()) < 0.1
    moved = R.warp_back(f(0), np.dstack([np.ones((48, 48)), np.zeros((48, 48))]))
    assert np.allclose(moved[:, 2:-2], f(1)[:, 2:-2])
    a = R.gaussian(RNG.random((32, 32)), 2)
    assert R.phase_shift(a, np.roll(a, (3, -2), (0, 1))) == (3.0, -2.0)
    assert np.allclose(R.box_mean(np.ones((20, 20)), 5)[5:15, 5:15], 1)
    s = R.gaussian(np.eye(9), 1.0)
    assert math.isclose(s.sum(), 9, rel_tol=1e-6)


def test_rasterise_rejects_points_without_time():
    out = R.rasterise(np.array([0.0, 301, np.nan, -5]), np.array([1.0, 2, 1, 1]), np.array([1.0, 2, 1, 1]), (0, 2, 0, 2), 2, 4, 4)
    assert out.sum() == 2 and out[1, 0, 3] == 1 and out[0, 2, 2] == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    c = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    a = S.assign(c)
    used = [j for j in a if j >= 0]
    assert len(used) == min(n, m) == len(set(used))
    if n <= m:
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    else:
        best = min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
    assert sum(c[i, j] for i, j in enumerate(a) if j >= 0) == best


def test_segmentation_invariants():
    f = R.storm_cells(24, 24, 5, 2) / 255
    cube = np.stack([f, f], -1)
    lab, cent = S.kmeans_regions(cube[0], 9)
    assert lab.min() >= 1 and lab.shape == (24, 24) and len(cent) == 9
    seg = S.TemporalSegmenter(9)
    for frame in cube:
        lab, flow = seg.step(frame)
        assert (lab > 0).all()
    row = S.score_sequence(cube, 9)
    legacy = S.score_sequence(cube, 9, flow_align="legacy")
    assert 0 <= row["GED"] <= 1 and 0 <= row["boundary_recall_mean"] <= 1 and row["actual_N"] <= 9 and legacy["FAE"] != row["FAE"]
    vil = f[2] * 70
    cells = S.nested_cells(vil, 1.0, 500)
    assert not ((cells["high"] > 0) & ~(cells["med"] > 0)).any() and not ((cells["med"] > 0) & ~(cells["low"] > 0)).any()
    w = S.level_weights(cells, np.ones((24, 24)))
    assert all(math.isclose(sum(x.values()), 1) for x in w.values())
    fine, parent = S.split_regions(lab, f[2])
    assert (fine > 0).all() and all((lab[fine == k] == p).all() for k, p in parent.items())


def test_scores():
    a = np.zeros((10, 10), bool)
    a[2, 2:8] = True
    b = np.roll(a, 1, 0)
    assert S.hausdorff(a, b) == S.hausdorff(b, a) == 1 and S.hausdorff(a, a) == 0
    assert S.boundary_score(a, a, a, 0, 2)[2] > 0.999 and S.boundary_score(a, b, a, 1, 2)[0] > 0.999
    with pytest.raises(ValueError):
        S.boundary_score(a, a, a, 2, 2)
    cells, regions = np.zeros((6, 6), int), np.ones((6, 6), int)
    cells[:3], regions[:3] = 1, 2
    assert S.best_cells(cells, regions)[0] > 0.999
    empty = S.evaluate(np.zeros((12, 12)), np.ones((12, 12), int), margin=2)
    assert empty["zero_cell"] and empty["f1_multi_G"] == 0


def test_level_weights_by_hand():
    cells = {k: np.zeros((8, 8), int) for k in ("low", "med", "high")}
    cells["low"][1:7, 1:7], cells["med"][2:5, 2:5] = 1, 1
    border = {k: int(R.boundary(c, True).sum()) for k, c in cells.items()}
    w = S.level_weights(cells, np.ones((8, 8)))
    assert set(w["P"]) == {"low", "med"} and w["G"] == {"low": 0.5, "med": 0.5}
    assert math.isclose(w["P"]["low"], border["med"] / (border["low"] + border["med"]), rel_tol=1e-6) and w["P"]["med"] > w["P"]["low"]
    assert math.isclose(w["F"]["low"], 0.4) and math.isclose(w["F"]["med"], 0.6)


def test_edge_recall_by_hand():
    labels = np.ones((8, 8), int)
    labels[:, 4:] = 2
    frame = np.zeros((8, 8))
    frame[:, 4:] = 1.0
    assert S.edge_recall(labels, frame) == 1.0
    assert S.edge_recall(labels, frame * 0.01) == 1.0  # a weak frame has edges of its own
    assert S.edge_recall(np.ones((8, 8), int), frame) == 0.0 and S.edge_recall(labels, np.zeros((8, 8))) == 1.0
    labels[:, :4] = 0  # the side without a region does not count
    assert 0 < S.edge_recall(labels, frame) < 1


def test_tolerance_search_stops_at_a_run_that_fails(monkeypatch):
    runs = iter([(np.ones(2), True), (np.ones(2) * 2, True), (np.ones(2) * 2, False)])
    monkeypatch.setattr(V, "strang", lambda *a, **k: (lambda r: (r[0], {"imex_converged": r[1]}))(next(runs)))
    assert V.calibrate_tolerance(np.ones(2), None, None, None, start=0.08) == (0.04, False)
    monkeypatch.setattr(V, "strang", lambda *a, **k: (np.ones(2), {"imex_converged": False}))
    assert V.calibrate_tolerance(np.ones(2), None, None, None, start=0.08) == (0.08, False)


def slow_flood(height, markers, compactness):
    out, done, age = markers.copy(), markers > 0, 0
    todo = []
    for y, x in zip(*np.nonzero(markers)):
        todo.append((height[y, x], age, y, x, y, x))
        age += 1
    while todo:
        todo.sort()
        _, _, y, x, sy, sx = todo.pop(0)
        for ny, nx in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= ny < height.shape[0] and 0 <= nx < height.shape[1] and not done[ny, nx]:
                done[ny, nx], out[ny, nx] = True, out[y, x]
                todo.append((height[ny, nx] + compactness * math.hypot(ny - sy, nx - sx), age, ny, nx, sy, sx))
                age += 1
    return out


@pytest.mark.parametrize("compactness", [0.0, 0.1])
def test_watershed_against_a_plain_flood(compactness):
    z = RNG.random((15, 11)).round(1)
    marks = np.zeros((15, 11), np.int32)
    marks[2, 3], marks[9, 8], marks[14, 0] = 1, 2, 3
    assert (S.watershed(z, marks, compactness) == slow_flood(z, marks, compactness)).all()
    inside = RNG.random((15, 11)) < 0.7
    got = S.watershed(z, marks, compactness, inside)
    assert (got[~inside] == 0).all()


def test_distances_against_all_pairs():
    m = RNG.random((9, 13)) < 0.1
    m[4, 4] = True
    p = np.argwhere(m)
    want = ((np.argwhere(np.ones_like(m))[:, None] - p[None]) ** 2).sum(2).min(1).reshape(m.shape)
    assert (S.nearest_set(m) == want).all()


def test_tracking_gives_new_ids():
    flow = np.zeros((30, 30, 2))
    old, new = np.array([[5.0, 5.0], [20.0, 20.0]]), np.array([[20.0, 21.0], [5.0, 6.0], [12.0, 28.0]])
    assert S.track(np.array([1, 2]), old, new, flow, 3.0).tolist() == [2, 1, 3]


def test_birth_and_death():
    fused = np.zeros((40, 40, 1))
    fused[5:8, 5:8] = 0.9
    fused[30:34, 30:34] = 0.8
    assert S.die(np.array([[6.0, 6.0], [20.0, 20.0]]), fused).tolist() == [[6.0, 6.0]]
    born = S.be_born(np.array([[6.0, 6.0]]), fused, fused[..., 0])
    assert born.tolist() == [[6.0, 6.0], [31.5, 31.5]]


@pytest.mark.parametrize("method,order", [("tsit5", 5), ("dopri5", 5), ("sdirk4", 4)])
def test_integrators_follow_the_exact_solution(method, order):
    f, j = V.linear_decay(np.zeros((1, 1)), 1.3)
    errors = []
    for tol in (1e-4, 1e-7):
        h, tr = V.integrate(f, np.ones((1, 1)), 2.0, method, rtol=tol, atol=tol / 10, jac=j)
        errors.append(abs(float(h[0, 0]) - math.exp(-2.6)))
        assert tr.converged and tr.nfe == V.STAGES[method] * (tr.accepted + tr.rejected)
    assert errors[1] < errors[0] < 1e-3


def test_implicit_steps_do_not_shrink_with_stiffness():
    f, j = V.linear_decay(np.full((4, 3), 1000.0), 2000.0)
    h, tr = V.integrate(f, np.zeros((4, 3)), 300.0, "sdirk4", jac=j)
    assert np.allclose(h, 0.5, atol=1e-3) and tr.accepted < 100


def test_diffusion_and_reaction():
    n = 12
    s = np.concatenate([np.arange(n - 1), np.arange(1, n)])
    d = np.concatenate([np.arange(1, n), np.arange(n - 1)])
    w = np.tile(RNG.random(n - 1), 2)
    f = V.diffusion(s, d, w, n, 0.3)
    assert np.abs(f(RNG.random((n, 3))).sum(0)).max() < 1e-12
    lap = np.zeros((n, n))
    np.add.at(lap, (d, s), -w)
    np.add.at(lap, (d, d), w)
    assert math.isclose(V.lambda_max(n, s, d, w), np.linalg.eigvalsh(lap).max(), rel_tol=1e-3)
    assert 2 * np.bincount(d, w, n).max() >= V.lambda_max(n, s, d, w)
    env, h = RNG.random((n, 4)), RNG.random((n, 3))
    weights = V.make_weights(1.0, 0)
    rhs, jac = V.reaction(env, weights)
    num = np.stack([(rhs(h + 1e-6 * np.eye(3)[k]) - rhs(h - 1e-6 * np.eye(3)[k])) / 2e-6 for k in range(3)], 2)
    assert np.abs(jac(h) - num).max() < 1e-7
    assert V.spectral_norm(jac(h)) > 0 and V.gate_ceiling(weights, 3) > 0 and len(V.stability_profile(jac, h)) == 4
    scale = V.calibrate_scale(env, h, 0.5)
    assert abs(V.spectral_norm(V.reaction(env, V.make_weights(scale, 0))[1](h)) - 0.5) <= 0.06
    row = V.compare(h, f, rhs, jac, steps=2)
    assert row["imex_converged"] and row["dopri5_converged"] and row["nfe_dopri5"] > 0
    acc = V.accuracy(h, f, rhs, jac, steps=2)
    assert acc["eps_int"] < 1e-2 and acc["nfe_ref"] > acc["nfe_train"]
    assert V.calibrate_tolerance(h, f, rhs, jac, steps=1)[0] <= 1e-2
    best, every = V.calibrate_width(np.ones(len(s)), n, s, d, 1.0)
    assert best == min(every, key=every.get)


def test_stability_and_verdicts():
    assert 3.2 < V.stability_radius("dopri5") < 3.4 and 3.4 < V.stability_radius("tsit5") < 3.6
    assert math.isclose(V.calibrate_diffusion(3.5, 2.0), 3.5 / 60)
    assert V.verdict(V.Trace(10, 0, 0, True, [1.0] * 10, list(np.linspace(1, 1.1, 10))), 1.0) == "AMBIGUOUS"
    assert V.verdict(V.Trace(20, 0, 0, True, [1.0] * 10 + [0.01] * 10, [1.0] * 20), 1.0) == "STIFFNESS"
    assert V.verdict(V.Trace(20, 0, 0, True, list(np.geomspace(1, 1e-3, 20)), list(np.geomspace(1, 1e3, 20))), 1.0) == "DIVERGENCE"
    _, tr = V.integrate(lambda h: h * h, np.full((1, 1), 1.0), 5.0)
    assert not tr.converged and V.verdict(tr, 0.5) == "DIVERGENCE"


def test_model_shapes_and_clamp():
    f = R.storm_cells(20, 20, 3, 1) / 255
    cube = np.stack([f, f, f], -1)
    labels, _ = S.kmeans_regions(cube[0], 9)
    flow = R.lucas_kanade(f[0], f[1])
    code = M.encode(cube[0], labels, flow)
    assert code["route"].shape == (20, 20) and code["h"].shape == (9, 3)
    x, h = M.forecast(M.init_model(0), code, R.terrain(20, 20, 1), 2)
    out = M.decode(h, code["route"], flow, 2)
    assert out.min() >= 0 and out.max() <= 1 and out.shape == (20, 20, 3)
    assert M.balanced_mse(f[0], f[0]) == 0 and len(M.diffuse(M.init_model(0), x[:1], h[:1])) == 1
