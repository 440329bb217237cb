"""The chain's fit ends at the minimum where full Newton steps overshoot."""

import numpy as np
import pytest

from seqloom.llm import toxicity


@pytest.mark.parametrize("seed", [1, 3])
def test_fit_where_full_newton_steps_diverge(seed):
    """One kind of toxic row, whose words the other kind shares: undamped steps ended at weights of 10 ** 7."""
    r = np.random.default_rng(seed)
    toxic = r.random(1000) < 0.1
    x = (r.random((1000, 20)) < np.where(toxic[:, None], 0.3, 0.0)).astype(float)
    y = toxicity.kinds(x, toxic)[:, 0].astype(float)
    w = toxicity._logistic(x, y)
    chance = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    slope = np.column_stack([x, np.ones(1000)]).T @ (chance - y) + np.append(np.full(20, toxicity.RIDGE), 1e-6) * w
    assert np.abs(w).max() < 10 and np.abs(slope).max() < 1e-3


@pytest.mark.parametrize("seed", [1, 3])
def test_clean_rows_stay_below_the_threshold(seed):
    r = np.random.default_rng(seed)
    toxic = r.random(1000) < 0.1
    x = (r.random((1000, 20)) < np.where(toxic[:, None], 0.3, 0.01)).astype(float)
    present = [np.flatnonzero(row).tolist() for row in x]
    marks = np.column_stack([toxicity.kinds(x, toxic), toxic])
    chain = toxicity.fit_chain({str(k): k for k in range(20)}, present, marks, np.arange(1000) % toxicity.FOLDS)
    kept = chain.predict(present)[:, -1] < chain.threshold
    assert kept[~toxic].mean() > 0.95 and kept[toxic].mean() < 0.2
