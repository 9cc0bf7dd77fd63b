import numpy as np
import pandas as pd
import pytest

from rebaja.operators import elasticity as E


def seeded(seed=5, n=600, beta=-1.5, boost=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        store, week = f"S{i % 4}", i % 60
        depth = rng.choice([0.0, 0.0, 0.15, 0.2, 0.3, 0.4])
        price = 50000 * (1 - depth) * np.exp(rng.normal(0, 0.05))
        md = boost if depth > 0 else 0.0
        y = 20 + beta * np.log(price) + 0.2 * (i % 4) + 0.003 * week + md + rng.normal(0, 0.2)
        rows.append(("A", "P1", f"P1-{i % 5}", store, price, 50000.0, float(np.exp(y)), np.log(price), y, 1 + week % 12, float(week),
                     "Footwear", "Run", depth == 0, depth))
    cols = ("brand codigo_padre sku centro avg_price avg_list_price units ln_price ln_units month week_num primera_jerarquia segunda_jerarquia "
            "is_normal_price discount_depth").split()
    return pd.DataFrame(rows, columns=cols)


def brute(pdf, extra=()):
    """Dummies for months and stores, trend and intercept, by least squares."""
    months = sorted(pdf.month.unique())[1:]
    stores = sorted(pdf.centro.unique())[1:]
    parts = [np.ones(len(pdf)), pdf.ln_price] + [pdf[c].astype(float) for c in extra]
    parts += [(pdf.month == m).astype(float) for m in months] + [(pdf.centro == s).astype(float) for s in stores] + [pdf.week_num]
    x = np.column_stack(parts)
    coef, *_ = np.linalg.lstsq(x, pdf.ln_units.values, rcond=None)
    res = pdf.ln_units - x @ coef
    return coef[1], 1 - (res ** 2).sum() / ((pdf.ln_units - pdf.ln_units.mean()) ** 2).sum()


def test_recovers_the_seeded_slope(spark):
    pdf = seeded()
    row = E.elasticity_by_parent(E.markdown_tiers(spark.createDataFrame(pdf))).first()
    slope, r2 = brute(pdf)
    assert row.elasticity == pytest.approx(slope, abs=1e-6) and row.r2 == pytest.approx(r2, abs=1e-6)
    assert row.elasticity == pytest.approx(-1.5, abs=0.2)
    assert row.n_observations == len(pdf) and row.price_cv == pytest.approx(pdf.avg_price.std() / pdf.avg_price.mean())
    assert row.confidence == "high"


def test_tiers_absorb_the_event_boost(spark):
    pdf = seeded(seed=9, boost=0.8)
    panel = E.markdown_tiers(spark.createDataFrame(pdf))
    naive = E.elasticity_by_parent(panel).first().elasticity
    tiered = E.elasticity_by_parent(panel, tiers=True).first().elasticity
    assert naive < -1.5 and -2.5 < tiered < -0.5
    full = panel.toPandas()
    assert tiered == pytest.approx(brute(full, E.TIERS)[0], abs=1e-5)


def test_gates(spark):
    flat = seeded(n=40).assign(avg_price=50000.0)
    panel = E.markdown_tiers(spark.createDataFrame(flat))
    assert E.elasticity_by_parent(panel).count() == 0
    assert E.price_variation_gate(panel).count() == 0
    assert E.elasticity_by_parent(E.markdown_tiers(spark.createDataFrame(seeded(n=9)))).count() == 0


def test_real_panel_against_brute_force(spark, run):
    got = {(r.brand, r.codigo_padre): r for r in E.elasticity_by_parent(run.panel).collect()}
    panel = run.panel.toPandas()
    checked = 0
    for key, pdf in panel.groupby(["brand", "codigo_padre"]):
        cv = pdf.avg_price.std() / pdf.avg_price.mean()
        assert (key in got) == (len(pdf) >= 10 and cv >= 0.05)
        stores = pdf.groupby("centro").size()
        if key not in got or len(pdf) < 18 + len(stores):
            continue  # more controls than rows: the slope is not identified
        slope, r2 = brute(pdf)
        assert got[key].elasticity == pytest.approx(slope, rel=1e-5, abs=1e-6)
        assert got[key].r2 == pytest.approx(r2, abs=1e-6)
        checked += 1
    assert checked > 5


def test_category_level(spark, run):
    got = {(r.brand, r.primera_jerarquia, r.segunda_jerarquia): r for r in E.elasticity_by_category(run.panel).collect()}
    panel = run.panel.toPandas()
    for key, pdf in panel.groupby(["brand", "primera_jerarquia", "segunda_jerarquia"]):
        if len(pdf) >= 30:
            assert got[key].elasticity == pytest.approx(brute(pdf)[0], rel=1e-5, abs=1e-6)


def test_dependent_controls_give_the_smallest_norm(spark):
    """Few rows, all months apart: more controls than rows; the scaled, store-demeaned system by numpy."""
    pdf = seeded(seed=3, n=12).assign(month=range(1, 13), centro=["S0", "S1"] * 6)
    fits = E.elasticity_by_parent(E.markdown_tiers(spark.createDataFrame(pdf)))
    row = fits.first()
    x = np.column_stack([pdf.ln_price] + [(pdf.month == m).astype(float) for m in range(2, 13)] + [pdf.week_num / 100])
    x, y = (v - pd.DataFrame(v).groupby(pdf.centro).transform("mean").values.reshape(v.shape) for v in (x, pdf.ln_units.values))
    scale = np.sqrt((x ** 2).sum(0))
    beta = np.linalg.pinv(x / scale, rcond=1e-6) @ y
    assert row.elasticity == pytest.approx(beta[0] / scale[0], abs=1e-6)
    assert row.r2 == pytest.approx(1 - ((y - x / scale @ beta) ** 2).sum() / ((pdf.ln_units - pdf.ln_units.mean()) ** 2).sum(), abs=1e-6)
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_price_constant_in_each_store(spark):
    pdf = seeded(n=40)
    pdf = pdf.assign(avg_price=np.where(pdf.centro < "S2", 40000.0, 60000.0))
    pdf["ln_price"] = np.log(pdf.avg_price)
    assert E.elasticity_by_parent(E.markdown_tiers(spark.createDataFrame(pdf))).first().elasticity == 0
