"""Parameter search of one exponential-smoothing series: all candidates of all forms at once.

One array operation per day advances every candidate. The search is a grid, then moves along every
quantity and along the last gain, repeated until no form improves and only then halved. Parameters come near
those of a numerical optimizer, not equal in all digits.
"""

from __future__ import annotations

from itertools import product

import numpy as np

# Forms as error, trend, season; the coarse grid; the move sizes; the limits.
FORMS = [
    ("A", "N", "N"), ("A", "A", "N"), ("A", "Ad", "N"), ("A", "N", "A"), ("A", "A", "A"), ("A", "Ad", "A"),
    ("M", "N", "N"), ("M", "A", "N"), ("M", "Ad", "N"), ("M", "N", "A"), ("M", "A", "A"), ("M", "Ad", "A"),
    ("M", "N", "M"), ("M", "A", "M"), ("M", "Ad", "M"),
]
# slope and cycle: trend and season speed as shares of alpha and of 1 - alpha. lift and tilt: initial
# level offset in standard deviations, and the share of the early slope taken as initial trend.
GRID = {
    "alpha": (0.02, 0.1, 0.3, 0.6), "slope": (0.01, 0.1, 0.4), "cycle": (0.01, 0.1, 0.4), "phi": (0.85, 0.95),
    "lift": (0.0,), "tilt": (0.0, 1.0),
}
AT_REST = {"alpha": 0.0, "slope": 0.0, "cycle": 0.0, "phi": 1.0, "lift": 0.0, "tilt": 0.0}
MOVES = (0.16, 0.08, 0.04, 0.02, 0.01, 0.005, 0.0025)
LEAST_GAIN = 1e-4  # of AICc, for a move to count as an improvement
MOVE_SCALE = {"alpha": 1, "slope": 1, "cycle": 1, "phi": 1, "lift": 5, "tilt": 5}
LIMITS = {
    "alpha": (0.0001, 0.9999), "slope": (0.0001, 0.9999), "cycle": (0.0001, 0.9999), "phi": (0.8, 0.98),
    "lift": (-3.0, 3.0), "tilt": (-2.0, 2.0),
}
STARTING_CYCLES = 4


def searched(form: tuple[str, str, str]) -> list[str]:
    """Names of the quantities the search may move for a form."""
    _, trend, season = form
    names = ["alpha", "lift"]
    names += ["slope", "tilt"] if trend != "N" else []
    names += ["cycle"] if season != "N" else []
    return names + (["phi"] if trend == "Ad" else [])


def parameter_count(form: tuple[str, str, str], period: int) -> int:
    """Smoothing parameters, initial states and the variance."""
    _, trend, season = form
    smoothing = 1 + (trend != "N") + (season != "N") + (trend == "Ad")
    states = 1 + (trend != "N") + (period - 1) * (season != "N")
    return smoothing + states + 1


def run_candidates(y: np.ndarray, forms: list, cells: np.ndarray, period: int, multiplicative: bool):
    """Smooth one series with every candidate at once.

    ``cells`` has one row per candidate, in the order of ``GRID``. A form without trend or season
    keeps that state at rest. Returns the AICc and the final level, trend and season per candidate.
    """
    n = len(y)
    trended = np.array([form[1] != "N" for form in forms])
    seasonal = np.array([form[2] != "N" for form in forms])
    alpha, slope_share, cycle_share, phi, lift, tilt = cells.T
    beta = alpha * slope_share * trended
    gamma = (1 - alpha) * cycle_share * seasonal

    head = y[: period * STARTING_CYCLES]
    overall = head.mean()
    cycle = np.array([head[j::period].mean() if len(head) > j else overall for j in range(period)])
    rise = (head[-period:].mean() - head[:period].mean()) / max(len(head) - period, 1)
    level = overall + lift * head.std()
    trend = trended * tilt * rise
    rest = 1.0 if multiplicative else 0.0
    effects = cycle / overall if multiplicative else cycle - overall
    season = np.where(seasonal, effects[:, None], rest)

    squared, relative, logs = (np.zeros(len(forms)) for _ in range(3))
    with np.errstate(all="ignore"):
        for t in range(n):
            slope = phi * trend
            base = level + slope
            effect = season[t % period]
            expected = base * effect if multiplicative else base + effect
            gap = y[t] - expected
            pull = gap / effect if multiplicative else gap
            level = base + alpha * pull
            trend = slope + beta * pull
            season[t % period] = effect + gamma * (gap / base if multiplicative else gap)
            squared += gap * gap
            relative += (gap / expected) ** 2
            logs += np.log(np.abs(expected))
        count = np.array([parameter_count(form, period) for form in forms])
        additive = np.array([form[0] == "A" for form in forms])
        floor = np.finfo(float).tiny  # a series that fits exactly, such as all zeros
        squared, relative = np.maximum(squared, floor), np.maximum(relative, floor)
        likelihood = np.where(additive, n * np.log(squared), n * np.log(relative) + 2 * logs)
        spare = n - count - 1
        aicc = likelihood + 2 * count + 2 * count * (count + 1) / np.where(spare > 0, spare, 1)
    usable = (spare > 0) & ~np.isnan(aicc)
    return np.where(usable, aicc, np.inf), level, trend, season


def fit_series(y: np.ndarray, period: int):
    """Best form of one series: (form, aicc, alpha, beta, gamma, phi, level, trend, season, lift, tilt) or None."""
    best = None
    for multiplicative in (False, True):
        forms = [
            form for form in FORMS
            if (form[2] == "M") == multiplicative
            and (form[0] == "A" or y.min() > 0)
            and (form[2] == "N" or len(y) >= 2 * period)
        ]
        if not forms:
            continue
        names = list(GRID)
        owner, cells = [], []
        for form in forms:
            used = searched(form)
            for cell in product(*[GRID[name] if name in used else (AT_REST[name],) for name in names]):
                owner.append(form)
                cells.append(cell)
        leaders: dict = {}
        gains: dict = {}

        def try_out(owner: list, cells: list) -> set:
            """Run the candidates; the forms whose leader improved."""
            aicc, level, trend, season = run_candidates(y, owner, np.array(cells), period, multiplicative)
            improved, before = set(), {form: leader[:2] for form, leader in leaders.items()}
            for i, form in enumerate(owner):
                if form not in leaders or aicc[i] < leaders[form][0]:
                    leaders[form] = (aicc[i], cells[i], level[i], trend[i], season[:, i].copy())
            for form, (score, cell) in before.items():
                if leaders[form][0] < score - LEAST_GAIN or not np.isfinite(score) and np.isfinite(leaders[form][0]):
                    improved.add(form)
                    gains[form] = np.array(leaders[form][1]) - np.array(cell)
            return improved

        try_out(owner, cells)
        for move in MOVES:
            moving = set(leaders)
            while moving:
                owner, cells = [], []
                for form in sorted(moving):
                    here = np.array(leaders[form][1])
                    steps = [np.eye(len(names))[names.index(n)] * s * move * MOVE_SCALE[n] for n in searched(form) for s in (-1, 1)]
                    steps += [gains[form] * s for s in (1, 2)] if form in gains else []
                    for step in steps:
                        cell = [min(max(v, LIMITS[n][0]), LIMITS[n][1]) if n in searched(form) else w for n, v, w in zip(names, here + step, here)]
                        owner.append(form)
                        cells.append(tuple(cell))
                moving = try_out(owner, cells)
        for form, (score, cell, level, trend, season) in leaders.items():
            if np.isfinite(score) and (best is None or score < best[1]):
                # Rotate the season so that its first entry belongs to the first forecast day.
                turned = np.roll(season, -(len(y) % period)).tolist() if form[2] != "N" else None
                best = (
                    "".join(form), score, cell[0], cell[0] * cell[1], (1 - cell[0]) * cell[2], cell[3],
                    level, trend, turned, cell[4], cell[5],
                )
    return best
