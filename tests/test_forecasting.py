import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelry.functions import smoothing
from panelry.operators import boosting, checks, ets, evaluation, naive, reports
from panelry.sources.contracts import ContractError
from published import METRICS, PREDICTED, RANKS

START = dt.date(2016, 4, 25)

# Published holdout demand, weekly naive forecasts and their metrics
# (mae, rmse, wape, bias, mean actual, mean predicted).
HOUSEHOLD_NAIVE = [917, 810, 869, 766, 900, 1252, 1346]
PUBLISHED_NAIVE = {
    "FOODS": [2886, 2488, 2490, 2533, 2960, 3655, 4053],
    "HOBBIES": [542, 495, 363, 410, 527, 670, 714],
    "HOUSEHOLD": HOUSEHOLD_NAIVE,
}
PUBLISHED_DEMAND = {
    "FOODS": [
        2893, 2518, 2467, 2446, 3032, 3950, 4254, 3278, 2997, 2840, 2735, 3303, 4106, 3630,
        3245, 2896, 2687, 2663, 3365, 4046, 4717, 3198, 2794, 2816, 2854, 2993, 3783, 4327,
    ],
    "HOBBIES": [
        589, 426, 451, 432, 584, 636, 684, 529, 628, 565, 439, 570, 646, 513,
        641, 389, 505, 596, 588, 806, 687, 417, 393, 381, 406, 539, 719, 646,
    ],
    "HOUSEHOLD": [
        990, 759, 797, 740, 957, 1312, 1459, 987, 969, 829, 744, 931, 1317, 1069,
        973, 819, 790, 790, 998, 1393, 1303, 953, 762, 798, 876, 901, 1262, 1316,
    ],
}
PUBLISHED_METRICS = {
    "FOODS": (272.821, 317.321, 8.41, -7.236, 3244.036, 3009.286),
    "HOBBIES": (75.964, 95.452, 13.807, -3.382, 550.179, 531.571),
    "HOUSEHOLD": (66.857, 86.746, 6.735, -1.274, 992.643, 980.0),
    "ALL": (138.548, 197.761, 8.683, -5.557, 1595.619, 1506.952),
}
PUBLISHED_RANKS = {
    "FOODS": [("ETS", 7.486, 290.176, 242.836), ("XGBoost", 8.377, 339.164, 271.739), ("Seasonal Naive", 8.41, 317.321, 272.821)],
    "HOBBIES": [("XGBoost", 10.191, 67.19, 56.068), ("ETS", 12.647, 81.603, 69.579), ("Seasonal Naive", 13.807, 95.452, 75.964)],
    "HOUSEHOLD": [("ETS", 4.711, 72.358, 46.76), ("Seasonal Naive", 6.735, 86.746, 66.857), ("XGBoost", 9.44, 119.533, 93.701)],
}


def test_published_naive_metrics(spark):
    days = [START + dt.timedelta(i) for i in range(28)]
    before = [START - dt.timedelta(7 - i) for i in range(7)]
    schema = "date date, cat_id string, units_sold double"
    train = [(d, c, float(v)) for c, week in PUBLISHED_NAIVE.items() for d, v in zip(before, week)]
    test = [(d, c, float(v)) for c, values in PUBLISHED_DEMAND.items() for d, v in zip(days, values)]
    forecasts = naive.seasonal_naive_forecast(spark.createDataFrame(train, schema), 28)
    holdout = spark.createDataFrame(test, schema)
    errors = evaluation.all_forecasts([forecasts], holdout)
    checks.check_forecasts(errors, holdout, 1)
    got = {
        r.cat_id: (r.mae, r.rmse, r.wape, r.forecast_bias, r.mean_actual, r.mean_predicted)
        for r in evaluation.all_model_metrics(errors).collect()
    }
    assert got == PUBLISHED_METRICS


def test_published_rankings(spark):
    data = [(c, *m) for c, models in PUBLISHED_RANKS.items() for m in reversed(models)]
    metrics = spark.createDataFrame(data, "cat_id string, model string, wape double, rmse double, mae double")
    got = {(r.cat_id, r.model): (r.model_rank, r.is_best_model) for r in evaluation.model_rankings(metrics).collect()}
    for category, models in PUBLISHED_RANKS.items():
        for place, (model, *_) in enumerate(models, 1):
            assert got[(category, model)] == (place, place == 1)


def test_published_run_of_three_models(spark):
    """All 252 published forecasts: three models, three categories, 28 days."""
    days = [START + dt.timedelta(i) for i in range(28)]
    schema = "date date, cat_id string, model string, predicted double"
    weeks = {("Seasonal Naive", c): [float(v) for v in week * 4] for c, week in PUBLISHED_NAIVE.items()}
    made = spark.createDataFrame([(d, c, m, v) for (m, c), values in (PREDICTED | weeks).items() for d, v in zip(days, values)], schema)
    holdout = spark.createDataFrame(
        [(d, c, float(v)) for c, values in PUBLISHED_DEMAND.items() for d, v in zip(days, values)], "date date, cat_id string, units_sold double"
    )
    errors = evaluation.all_forecasts([made.where(F.col("model") == m) for m in ("ETS", "XGBoost", "Seasonal Naive")], holdout)
    checks.check_forecasts(errors, holdout, 3)
    assert errors.count() == 252
    got = {(r.cat_id, r.model): (r.observations, r.mae, r.rmse, r.wape, r.forecast_bias) for r in evaluation.all_model_metrics(errors).collect()}
    assert got.keys() == METRICS.keys() and len(got) == 12
    for key, values in METRICS.items():
        assert got[key] == pytest.approx(values, abs=1.001e-3)
    ranks = evaluation.model_rankings(evaluation.category_model_metrics(errors)).collect()
    assert {(r.cat_id, r.model): r.model_rank for r in ranks} == RANKS


def weekly_frame(spark, weeks=3, values=HOUSEHOLD_NAIVE):
    data = [(START + dt.timedelta(i), "H", float(values[i % 7] + 100 * (i < 7 * (weeks - 1)))) for i in range(7 * weeks)]
    return spark.createDataFrame(data, "date date, cat_id string, units_sold double")


def test_seasonal_naive_repeats_the_last_training_week(spark):
    got = naive.seasonal_naive_forecast(weekly_frame(spark), 28).orderBy("date").collect()
    assert [r.predicted for r in got] == [float(v) for v in HOUSEHOLD_NAIVE * 4]
    assert got[0].date == START + dt.timedelta(21) and np.mean([r.predicted for r in got]) == 980.0


def test_seasonal_naive_with_a_season_longer_than_the_horizon(spark):
    got = naive.seasonal_naive_forecast(weekly_frame(spark), 5, season=7).orderBy("date").collect()
    assert [r.predicted for r in got] == [float(v) for v in HOUSEHOLD_NAIVE[:5]]


@pytest.fixture(scope="module")
def errors(spark):
    actual = {"A": [10.0, 0.0, 20.0, 30.0], "Z": [0.0] * 4}
    shift = {"m1": 1.0, "m2": -2.0, "m3": 3.0}
    test = [(START + dt.timedelta(i), c, v) for c, values in actual.items() for i, v in enumerate(values)]
    pred = [(d, c, m, v + s) for d, c, v in test for m, s in shift.items()]
    forecasts = spark.createDataFrame(pred, "date date, cat_id string, model string, predicted double")
    return evaluation.forecast_errors(forecasts, spark.createDataFrame(test, "date date, cat_id string, units_sold double"))


def test_row_errors(errors):
    row = errors.where("cat_id = 'A' and model = 'm2' and actual = 20").first()
    assert (row.residual, row.absolute_error, row.squared_error, row.absolute_percentage_error) == (2.0, 2.0, 4.0, 10.0)
    assert errors.where("actual = 0 and absolute_percentage_error is not null").isEmpty()


def test_metrics_and_overall_rows(errors):
    got = {(r.cat_id, r.model): r for r in evaluation.all_model_metrics(errors).collect()}
    assert len(got) == 9
    a = got[("A", "m3")]
    assert (a.observations, a.mae, a.rmse, a.wape, a.forecast_bias, a.mean_actual, a.mean_predicted) == (4, 3.0, 3.0, 20.0, 20.0, 15.0, 18.0)
    assert got[("Z", "m1")].wape is None and got[("Z", "m1")].forecast_bias is None and got[("Z", "m1")].mae == 1.0
    assert got[("ALL", "m2")].wape == pytest.approx(100 * 16 / 60, abs=5e-4)
    per_model = {r.model: r for r in evaluation.forecast_metrics(errors).collect()}
    assert per_model["m2"].wape == got[("ALL", "m2")].wape


def test_overall_label_survives_a_null_category(spark):
    df = spark.createDataFrame([(None, "m", 1.0, 2.0), ("A", "m", 1.0, 2.0)], "cat_id string, model string, actual double, predicted double")
    labels = [r.cat_id for r in evaluation.all_model_metrics(df).collect()]
    assert sorted(labels, key=str) == ["A", "ALL", None]


def test_metrics_published_for_a_constant_error(errors):
    ranks = evaluation.model_rankings(evaluation.category_model_metrics(errors))
    best = {r.cat_id: r.model for r in evaluation.best_models(ranks).collect()}
    assert best["A"] == "m1"
    ranked = evaluation.forecasts_with_rank(evaluation.forecasts_with_rank(errors, ranks), ranks)
    assert ranked.count() == errors.count() and ranked.columns.count("model_rank") == 1


def test_reports_on_metrics(errors):
    metrics = evaluation.all_model_metrics(errors)
    ranks = evaluation.model_rankings(evaluation.category_model_metrics(errors))
    rec = {r.cat_id: r for r in reports.model_recommendation(ranks).collect()}
    assert rec["A"].bias_direction == "overforecast" and rec["Z"].bias_direction == "remain unbiased"
    gain = {r.cat_id: r for r in reports.baseline_improvement(metrics, "m3").collect()}
    assert gain["A"].improvement_pct == pytest.approx(66.7) and gain["Z"].improvement_pct is None
    insight = {(r.cat_id, r.model): r.closest_to_zero for r in reports.residual_insight(errors).collect()}
    assert insight[("A", "m1")] and not insight[("A", "m3")]


def test_boxplot_whiskers(spark):
    data = [("A", "m", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 100]]
    row = reports.residual_boxplot(spark.createDataFrame(data, "cat_id string, model string, residual double")).first()
    assert (row.q1, row["median"], row.q3) == (2.75, 4.5, 6.25)
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 7.0, 1)


def test_split_and_checks(spark):
    data = [(START + dt.timedelta(i), c, 1.0) for i in range(60) for c in "AB"]
    df = spark.createDataFrame(data, "date date, cat_id string, units_sold double")
    train, test = evaluation.train_test_split(df, 28)
    assert (train.count(), test.count()) == (64, 56)
    checks.check_series(df)
    checks.check_split(train, test, 28)
    with pytest.raises(ContractError, match="holdout rows"):
        checks.check_split(train, test.where(F.col("date") > START + dt.timedelta(40)), 28)
    with pytest.raises(ContractError, match="overlap"):
        checks.check_split(df, test, 28)
    with pytest.raises(ContractError, match="length"):
        checks.check_series(df.where("cat_id = 'A' or date > '2016-05-01'"))
    with pytest.raises(ContractError, match="missing values"):
        checks.check_series(df.withColumn("units_sold", F.when(F.col("date") > "2016-05-01", F.col("units_sold"))))


def plain_smoothing(y, alpha, beta, gamma, phi, level, trend, season, kind):
    """Sum of squared one-step errors by the textbook recursion, and the final states."""
    sse = 0.0
    season = list(season)
    for t, value in enumerate(y):
        base = level + phi * trend
        s = season[t % 7]
        e = value - (base * s if kind == "M" else base + s)
        sse += e * e
        pull = e / s if kind == "M" else e
        level, trend = base + alpha * pull, phi * trend + beta * pull
        season[t % 7] = s + gamma * (e / base if kind == "M" else e)
    return sse, level, trend, season


@pytest.mark.parametrize("kind", ["A", "M"])
def test_candidate_run_equals_the_textbook_recursion(kind):
    rng = np.random.default_rng(1)
    y = 50 + np.tile([0, 2, 4, 6, 8, 10, 12], 12) + rng.normal(0, 1, 84)
    form, cell = ("A" if kind == "A" else "M", "Ad", kind), (0.3, 0.2, 0.1, 0.9, 0.5, 1.0)
    aicc, level, trend, season = smoothing.run_candidates(y, [form], np.array([cell]), 7, kind == "M")
    head = y[:28]
    cycle = np.array([head[j::7].mean() for j in range(7)])
    start = cycle - head.mean() if kind == "A" else cycle / head.mean()
    rise = (head[-7:].mean() - head[:7].mean()) / 21
    sse, l, b, s = plain_smoothing(y, 0.3, 0.06, 0.07, 0.9, head.mean() + 0.5 * head.std(), rise, start, kind)
    assert (level[0], trend[0]) == (pytest.approx(l), pytest.approx(b)) and season[:, 0] == pytest.approx(s)
    if kind == "A":
        k = smoothing.parameter_count(form, 7)
        n = len(y)
        assert k == 4 + 8 + 1 and aicc[0] == pytest.approx(n * np.log(sse) + 2 * k + 2 * k * (k + 1) / (n - k - 1))


def test_form_selection_finds_the_structure():
    rng = np.random.default_rng(2)
    flat = rng.normal(100, 10, 300)
    weekly = np.tile([0, 20, 40, 60, 80, 100, 120], 60) + rng.normal(200, 4, 420)
    growing = np.tile([0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3], 60) * (100 + np.arange(420)) * rng.normal(1, 0.01, 420)
    assert smoothing.fit_series(flat, 7)[0] in ("ANN", "MNN")
    assert smoothing.fit_series(weekly, 7)[0][-1] == "A"
    assert smoothing.fit_series(growing, 7)[0][-1] == "M" and "A" in smoothing.fit_series(growing, 7)[0]
    assert smoothing.fit_series(np.zeros(60), 7)[6] == 0.0
    assert smoothing.fit_series(np.array([1.0, 2.0]), 7) is None


def test_ets_forecast_follows_the_season_and_clamps(spark):
    wave = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    data = [(START + dt.timedelta(i), "up", 100 + wave[i % 7] + (i % 3) * 0.1) for i in range(143)]
    data += [(START + dt.timedelta(i), "down", 140.0 - i + (i % 2) * 0.1) for i in range(140)]
    df = spark.createDataFrame(data, "date date, cat_id string, units_sold double")
    got = ets.ets_forecast(ets.ets_selection(df, spread=2), 28)
    up = got.where("cat_id = 'up'").orderBy("date").collect()
    assert len(up) == 28 and up[0].date == START + dt.timedelta(143)
    for h, row in enumerate(up):
        assert row.predicted == pytest.approx(100 + wave[(143 + h) % 7], abs=3)
    assert got.where("cat_id = 'down'").agg(F.min("predicted")).first()[0] >= 0.0


@pytest.fixture(scope="module")
def boosted(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(300):
        for c, base in (("A", 100.0), ("B", 20.0), (None, 50.0)):
            price = None if i % 50 == 0 else float(rng.uniform(1, 3))
            data.append((START + dt.timedelta(i), c, base + 10 * (i % 7) + float(rng.normal(0, 1)), i % 7, price, 1))
    df = spark.createDataFrame(data, "date date, cat_id string, units_sold double, weekday_number int, average_price double, is_event int")
    names = boosting.gbt_predictors(df)
    train, test = evaluation.train_test_split(df, 28)
    return train, test, names, boosting.fit_gbt(train, names, trees=8)


def test_boosting_beats_the_mean_and_keeps_rows(boosted):
    train, test, names, model = boosted
    assert names == ["cat_id", "weekday_number", "is_event", "average_price"]
    joined = boosting.gbt_forecast(model, train.where("cat_id is not null"), names).join(train, ["date", "cat_id"])
    got = joined.agg(
        F.avg(F.pow(F.col("predicted") - F.col("units_sold"), 2)).alias("sse"), F.var_pop("units_sold").alias("var"),
        F.min("predicted").alias("low"),
    ).first()
    assert got["sse"] < 0.7 * got["var"] and got.low >= 0
    assert boosting.gbt_forecast(model, test, names).count() == 84
    unseen = test.withColumn("cat_id", F.lit("new"))
    assert boosting.gbt_forecast(model, unseen, names).where("predicted is null").isEmpty()


def test_boosting_is_repeatable(boosted):
    train, test, names, model = boosted
    again = boosting.fit_gbt(train, names, trees=8)
    order = ["date", "cat_id", "predicted"]
    one, two = (sorted(map(str, boosting.gbt_forecast(m, test, names).select(order).collect())) for m in (model, again))
    assert one == two


def test_importance_shares(boosted):
    train, _, names, model = boosted
    rows = boosting.gbt_importance(model, train, names).collect()
    for share in ("gain", "cover", "frequency"):
        assert sum(r[share] for r in rows) == pytest.approx(1.0)
    found = {r.feature for r in rows}
    assert "cat_id_A" in found and "is_event" not in found  # a constant column is dropped
    assert [r.gain for r in rows] == sorted((r.gain for r in rows), reverse=True)


def test_zero_variance(boosted):
    train, _, names, _ = boosted
    got = {r.feature: r.is_constant for r in boosting.zero_variance_columns(train, names).collect()}
    assert got == {"weekday_number": False, "is_event": True, "average_price": False}


def walked(nodes, weights, values):
    """A boosted prediction by plain descent through the saved nodes."""
    total = 0.0
    for tree, weight in weights.items():
        node = nodes[tree][0]
        while node["leftChild"] >= 0:
            split = node["split"]
            value, bounds = values[split["featureIndex"]], split["leftCategoriesOrThreshold"]
            left = value in bounds if split["numCategories"] >= 0 else value <= bounds[0]  # a level's 0 and 1 are categories
            node = nodes[tree][node["leftChild" if left else "rightChild"]]
        total += weight * node["prediction"]
    return total


def test_saved_trees_give_the_same_predictions_and_importance(spark, boosted, tmp_path):
    train, _, names, model = boosted
    path = f"{tmp_path}/trees"
    model.stages[-1].save(path)
    nodes, weights = {}, {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
    for r in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(r[0], {})[r.nodeData.id] = r.nodeData.asDict(recursive=True)
    assert len(weights) == 8
    for row in model.transform(boosting._model_frame(train, names)).limit(100).collect():
        assert row["_prediction"] == pytest.approx(walked(nodes, weights, row["features"].toArray()))
    gain, cover, uses = {}, {}, {}
    labels = boosting._feature_names(model, boosting._model_frame(train, names))
    for tree in nodes.values():
        for node in tree.values():
            if node["leftChild"] >= 0:
                name = labels[node["split"]["featureIndex"]]
                gain[name] = gain.get(name, 0.0) + node["gain"] * node["rawCount"]
                cover[name] = cover.get(name, 0) + node["rawCount"]
                uses[name] = uses.get(name, 0) + 1
    rows = boosting.gbt_importance(model, train, names).collect()
    assert {r.feature for r in rows} == set(gain)
    for r in rows:
        shares = [part[r.feature] / sum(part.values()) for part in (gain, cover, uses)]
        assert [r.gain, r.cover, r.frequency] == pytest.approx(shares)


def test_encoded_features_are_what_the_trees_see(boosted):
    train, _, names, _ = boosted
    rows = boosting.encoded_features(train, names).collect()
    assert {r.feature for r in rows} == {"cat_id_A", "cat_id_B", "cat_id_unknown", "weekday_number", "average_price"}
    assert len(rows) == 5 * train.count() and all(r.value is not None for r in rows)
    first = {(r.cat_id, r.feature): r.value for r in rows if r.date == START}
    assert first["A", "cat_id_A"] == 1 and first["B", "cat_id_A"] == 0 and first["unknown", "cat_id_unknown"] == 1
