"""Every core query against its SQL, and every other one by what must hold for its result."""

import math

import numpy as np
import pytest

from squallframe import registry
from squallframe.plans import sweep_queries

from .compare import connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def t_tail(t, df):
    """The two-sided tail of Student's t by plain integration of its density."""
    x = np.linspace(0, abs(t), 200_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)


def correlations(g, con):
    r = g.iloc[0]
    for k in ("pearson", "spearman"):
        t = r[k] * math.sqrt((r.n - 2) / (1 - r[k] ** 2))
        assert abs(r[f"{k}_p"] - t_tail(t, r.n - 2)) < 1e-4


def rank_sum(g, con):
    r = g.iloc[0]
    x = con.execute(f"with {sweep_queries.RUNS_SQL} select lifecycle_class = 'STEADY', J_imex from runs where lifecycle_class in ('STEADY', 'PLATEAU') and J_imex is not null").fetchall()
    a, b = np.array([v for s, v in x if s]), np.array([v for s, v in x if not s])
    d = a[:, None] - b[None]
    assert r.u == (d > 0).sum() + (d == 0).sum() / 2 and len(a) == r.n_a and len(b) == r.n_b
    both, rng = np.concatenate([a, b]), np.random.default_rng(0)
    order = both.argsort().argsort()
    sums = np.array([order[rng.permutation(len(both))[: len(a)]].sum() for _ in range(4000)])
    assert abs(r.p - (sums <= order[: len(a)].sum()).mean()) < 0.05


def events(con):
    return con.execute(f"with {sweep_queries.EVENTS_SQL} select count(*) from ev").fetchone()[0]


def sweep_rows(g, con):
    assert len(g) == 2 * events(con) and set(g.N) == {6, 12} and not g.duplicated(["event_id", "N"]).any()
    assert (g.actual_N <= g.N).all() and g.GED.between(0, 1).all() and g.boundary_recall_mean.between(0, 1).all() and (g[["FAE", "BDV", "MDV", "LFS", "intra_sp_var_mean", "runtime_s"]] >= 0).all().all()
    assert np.allclose(g.avg_sp_area, 256 / g.actual_N) and (g.VRAM_est_MB > 0).all()


def resumed(g, con):
    n = g.groupby("event_id").N.agg(list)
    assert len(n) == events(con) and set(map(len, n)) == {1, 2} and all(12 in x for x in n)


def regions(g, con):
    assert len(g) == 4 * events(con) and g.regions.between(1, 16).all() and not g.duplicated(["event_id", "t"]).any()


def cell_scores(g, con):
    assert len(g) == 2 * events(con) and g.filter(regex="f1_|precision|recall").stack().between(0, 1).all()
    some = g[g.active_levels != ""]
    levels = some.active_levels.str.split(",")
    one = some[levels.map(len) == 1]
    assert np.allclose(one.f1_multi_G, one.f1_multi_P) and np.allclose(one.f1_multi_P, one.f1_multi_F)


def solver_rows(g, con):
    assert len(g) == events(con) and (g.nfe_diffusion + g.nfe_reaction == g.nfe_imex_total).all() and g.imex_converged.all() and (g.solution_l2_error < 0.05).all()
    assert (g.lambda_max_weighted <= g.lambda_max_topo + 1e-9).all() and np.allclose(g.nfe_ratio, g.nfe_dopri5 / (g.nfe_imex_total + 1))


def accuracy_rows(g, con):
    assert len(g) == events(con) and (g.nfe_train < g.nfe_ref).all() and (g.eps_int < 0.05).all()
    assert np.allclose(g.nfe_ratio_train_over_ref, g.nfe_train / g.nfe_ref)


def triage(g, con):
    assert g.lifecycle_class.is_unique and set(g.verdict) <= {"DIVERGENCE", "STIFFNESS", "AMBIGUOUS"} and g.converged.all() and (g.accepted > 0).all()


def versions(g, con):
    assert g.n_files.sum() == con.execute("select count(*) from sweep_raw").fetchone()[0] and not g.duplicated(["print", "steps"]).any()
    assert (g.groupby("print").version.agg(lambda v: sorted(v) == list(range(1, len(v) + 1)))).all()


def components(g, con):
    assert len(g) == 4 * events(con) and ((g.n_cells == 0) == (g.max_area == 0)).all() and np.allclose(g.active * 256, (g.active * 256).round())


def forecasts(g, con):
    assert len(g) == events(con) and g.loss.between(0, 10).all() and g.regions.between(1, 9).all()  # about 8: three rows of three


def elevation(g, con):
    assert (g.cells == 64).all() and (g.least <= g.most).all() and g.id.is_unique


def streamed(g, con):
    assert len(g) == 4 * events(con) and g.n_regions.between(1, 16).all()


# What holds for the results that no SQL can check.
CHECKS = {
    "a26_correlations": correlations, "a27_mann_whitney": rank_sum, "c01_synthetic_components": components, "c12_temporal_regions": regions, "c17_adaptive_regions": regions, "e16_solver_rows": solver_rows, "e17_accuracy_rows": accuracy_rows,
    "e24_triage": triage, "l03_forecast": forecasts, "m15_cell_scores": cell_scores, "p3_versions": versions, "s25_elevation": elevation, "t02_segment_stream": streamed, "x05_region_sweep": sweep_rows, "x05_resumed_sweep": resumed,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data)
    if name in SQL:
        same(got, con, SQL[name])
    else:
        CHECKS[name](got.toPandas(), con)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_nothing_imports_the_text_package():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(import|from)\b.*\bllm\b", p.read_text()), p
