"""SQL twins of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

from panelry.operators.boosting import PREDICTORS
from panelry.operators.cleaning import DAILY_KEYS
from panelry.operators.ets_cells import CELLS, TINY
from panelry.operators.features import FEATURE_DICTIONARY
from panelry.operators.reports import FEATURE_TABLE_COLUMNS, MISSINGNESS_FEATURES, ROUNDED_COLUMNS
from panelry.plans.catalog import (
    CATEGORY, DATE_FROM, DATE_TO, HISTORY_FEATURE, HORIZON, MODELS, PRICE_WIDTH, SEASONS, SELECTED, STATE_CELL, STORE,
)

UNITS = "case when l_returnflag <> 'R' then l_quantity else 0.0 end"
DAY = "cast(l_shipdate as date)"

PRICE_MEAN = "cast(sum(cast(sell_price as decimal(28, 10))) as double) / count(sell_price) average_price"

VIEWS = {
    "lines": f"""
        select n_name store_id, r_name state_id, l_partkey item_id, {DAY} as date, {UNITS} units,
               case when l_returnflag <> 'R' then floor(l_extendedprice / l_quantity * 100) / 100 end unit_price
        from lineitem join supplier on l_suppkey = s_suppkey
             join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "products": "select p_partkey item_id, p_brand dept_id, p_type cat_id from part",
    "bounds": f"select min({DAY}) lo, max({DAY}) hi from lineitem",
    "spine": """
        select lo, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from bounds""",
    "cal_events": """
        select *, cast((dayofweek(date) + 1) % 7 + 1 as int) wday,
               case when month(date) = 12 and day(date) = 25 then 'Christmas'
                    when month(date) = 1 and day(date) = 1 then 'NewYear'
                    when month(date) = 7 and day(date) = 4 then 'IndependenceDay'
                    when month(date) = 2 and day(date) = 14 then 'ValentinesDay'
                    when month(date) = 10 and day(date) = 31 then 'Halloween' end event_name_1
        from spine""",
    "cal": """
        select date, cast(isoyear(date) * 100 + week(date) as int) wm_yr_wk, dayname(date) weekday, wday,
               cast(month(date) as int) as month, cast(year(date) as int) as year,
               'd_' || cast(date_diff('day', lo, date) + 1 as varchar) d, event_name_1,
               case when event_name_1 in ('Christmas', 'NewYear', 'IndependenceDay') then 'National'
                    when event_name_1 is not null then 'Cultural' end event_type_1,
               case when month(date) = 2 and day(date) = 14 and wday = 2 then 'Carnival' end event_name_2,
               case when month(date) = 2 and day(date) = 14 and wday = 2 then 'Religious' end event_type_2,
               cast(day(date) <= 10 as int) snap_ca, cast(day(date) % 2 = 1 as int) snap_tx,
               cast(day(date) % 3 = 0 as int) snap_wi
        from cal_events""",
    "flagged": """
        select *, cast(event_name_1 is not null or event_name_2 is not null as int) is_event,
               cast(weekday in ('Saturday', 'Sunday') as int) is_weekend
        from cal""",
    "week": "select date, wm_yr_wk from cal",
    "prices": """
        select store_id, item_id, wm_yr_wk, max(unit_price) sell_price from lines join week using (date)
        where unit_price is not null group by all""",
    "item_prices": """
        select item_id, wm_yr_wk, max(unit_price) sell_price from lines join week using (date)
        where unit_price is not null group by all""",
    "item_days": """
        select store_id, state_id, item_id, date, sum(units) sales from lines group by all""",
    "fact": """
        select f.*, dept_id, cat_id, c.* exclude (date), sell_price, sales * sell_price revenue
        from item_days f join products using (item_id) left join flagged c using (date)
             left join prices p on p.store_id = f.store_id and p.item_id = f.item_id and p.wm_yr_wk = c.wm_yr_wk""",
    "cat_daily": """
        select cat_id, date, sum(sales) units_sold, coalesce(sum(revenue), 0) revenue,
               sum(sell_price * greatest(sales, 1))
                 / sum(case when sell_price is not null then greatest(sales, 1) end) average_price,
               count(distinct case when sales > 0 then item_id end) active_items
        from fact group by all""",
    "categories": "select distinct cat_id from cat_daily",
    "price_changes": """
        select cat_id, wm_yr_wk, sum(cents - coalesce(earlier, 0)) rise, count_if(earlier is null) new from
          (select item_id, wm_yr_wk, cast(round(sell_price * 100) as bigint) cents,
                  lag(cast(round(sell_price * 100) as bigint)) over (partition by item_id order by wm_yr_wk) earlier
           from item_prices) join products using (item_id) group by all""",
    "on_record": """
        select cat_id, w.wm_yr_wk, ((2 * sum(rise) + sum(new)) // (2 * nullif(sum(new), 0))) / 100 average_price
        from (select distinct wm_yr_wk from week) w join price_changes c on c.wm_yr_wk < w.wm_yr_wk group by all""",
    "panel": """
        select f.*, cat_id, coalesce(units_sold, 0) units_sold, coalesce(revenue, 0) revenue, r.average_price,
               coalesce(active_items, 0) active_items
        from flagged f cross join categories left join cat_daily using (cat_id, date)
             left join on_record r using (cat_id, wm_yr_wk)""",
    "event_fill": """
        select date, is_event,
               last_value(case when is_event = 1 then date end ignore nulls)
                 over (order by date rows between unbounded preceding and current row) prior,
               first_value(case when is_event = 1 then date end ignore nulls)
                 over (order by date rows between current row and unbounded following) next
        from flagged""",
    "events": """
        select date, cast(date - prior as int) days_since_event, cast(next - date as int) days_until_event,
               cast(coalesce(date - prior, 999) <= 3 or coalesce(next - date, 999) <= 3 as int) within_3_days_of_event,
               cast(coalesce(date - prior, 999) <= 7 or coalesce(next - date, 999) <= 7 as int) within_7_days_of_event
        from event_fill""",
    "product_days": f"""
        select item_id, dept_id, cat_id, date, sales from
          (select l_partkey item_id, {DAY} as date, sum({UNITS}) sales from lineitem group by all)
          join products using (item_id)""",
    "product_totals": "select item_id, cat_id, sum(sales) total_sales from product_days group by all",
    "selected": f"""
        select item_id from (select item_id, rank() over (order by total_sales desc) r from product_totals)
        where r <= {SELECTED}""",
    "product_panel": """
        select f.*, item_id, p.dept_id, p.cat_id, coalesce(sales, 0) sales, sell_price
        from flagged f cross join selected join products p using (item_id)
             left join product_days using (item_id, date) left join item_prices using (item_id, wm_yr_wk)""",
    "product_sales": """
        select date, item_id, dept_id, cat_id, sales, sell_price, is_event, is_weekend, snap_ca
        from product_panel""",
    "product_values": """
        select d.*, sell_price from product_days d join week using (date)
             left join item_prices using (item_id, wm_yr_wk)""",
    "dense_products": """
        select item_id, dept_id, cat_id, date, coalesce(v.sales, 0) sales, v.sell_price
        from products join (select distinct item_id from product_days) using (item_id) cross join spine
             left join (select item_id, date, sales, sell_price from product_values) v using (item_id, date)""",
    "product_table": """
        select item_id, dept_id, cat_id, sum(sales) total_sales, avg(sales) average_daily_sales,
               median(sales) median_daily_sales, 100.0 * count_if(sales = 0) / count(*) zero_sales_pct,
               cast(count_if(sales > 0) as bigint) active_days, avg(sell_price) average_price
        from dense_products group by all""",
}


def calendar_columns(date: str = "date") -> str:
    """Calendar feature columns of a date."""
    q = f"date_trunc('quarter', {date})"
    return f"""
        cast(year({date}) as int) calendar_year, cast(month({date}) as int) calendar_month,
        cast(week({date}) as int) calendar_week, cast(quarter({date}) as int) calendar_quarter,
        cast(day({date}) as int) day_of_month, cast(dayofyear({date}) as int) day_of_year,
        cast(isodow({date}) as int) weekday_number, cast(day({date}) = 1 as int) is_month_start,
        cast({date} = last_day({date}) as int) is_month_end, cast({date} = {q} as int) is_quarter_start,
        cast({date} = last_day(cast({q} + interval 2 month as date)) as int) is_quarter_end,
        sin(2 * pi() * month({date}) / 12) month_sin, cos(2 * pi() * month({date}) / 12) month_cos,
        sin(2 * pi() * isodow({date}) / 7) weekday_sin, cos(2 * pi() * isodow({date}) / 7) weekday_cos"""


def history_columns(key: str, target: str) -> str:
    """Sales-history feature columns of a dense panel."""
    series = f"over (partition by {key} order by date)"

    def before(days: int, call: str) -> str:
        frame = f"over (partition by {key} order by date rows between {days} preceding and 1 preceding)"
        return f"case when row_number() {series} >= {days} then {call} {frame} end"

    lag = f"lag({target}, 1) {series}"
    return f"""
        cast(row_number() {series} as int) series_day_index, {lag} lag_1, lag({target}, 7) {series} lag_7,
        lag({target}, 14) {series} lag_14, lag({target}, 28) {series} lag_28,
        {before(7, f"avg({target})")} rolling_mean_7, {before(14, f"avg({target})")} rolling_mean_14,
        {before(28, f"avg({target})")} rolling_mean_28, {before(7, f"stddev_samp({target})")} rolling_sd_7,
        {before(28, f"stddev_samp({target})")} rolling_sd_28, {before(7, f"min({target})")} rolling_min_7,
        {before(7, f"max({target})")} rolling_max_7,
        {before(28, f"avg(case when {target} = 0 then 1.0 else 0.0 end)")} zero_sales_rate_28,
        {lag} - lag({target}, 7) {series} difference_from_lag_7,
        {lag} - {before(28, f"avg({target})")} difference_from_mean_28"""


def price_columns(key: str, price: str) -> str:
    """Price feature columns of a dense panel."""
    series = f"over (partition by {key} order by date)"
    frame = f"over (partition by {key} order by date rows between 28 preceding and 1 preceding)"
    before = f"lag({price}, 1) {series}"
    usual = f"case when row_number() {series} >= 28 then avg({price}) {frame} end"
    return f"""
        cast({price} is null as int) price_missing, {before} previous_price, {usual} rolling_price_mean_28,
        {price} - {before} price_change_1,
        case when {before} <> 0 then ({price} - {before}) / {before} end price_pct_change_1,
        cast(coalesce({price} - {before} < 0, false) as int) is_price_decrease,
        cast(coalesce({price} - {before} > 0, false) as int) is_price_increase,
        case when ({usual}) <> 0 then {price} / ({usual}) end price_relative_to_28_day_mean"""


READY = "cast(lag_28 is not null and rolling_mean_28 is not null as int) has_complete_sales_history"
VIEWS["cat_features"] = f"""
    select *, {READY} from (
      select p.*, e.* exclude (date), {calendar_columns('p.date')}, {history_columns('cat_id', 'units_sold')},
             {price_columns('cat_id', 'average_price')}
      from panel p left join events e using (date))"""
VIEWS["features"] = "select * exclude (d, wm_yr_wk, snap_tx, snap_wi), d, wm_yr_wk, snap_tx, snap_wi from cat_features where has_complete_sales_history = 1"
VIEWS["prod_features"] = f"""
    select *, {READY} from (
      select p.*, e.* exclude (date), {calendar_columns('p.date')}, {history_columns('item_id', 'sales')},
             {price_columns('item_id', 'sell_price')}
      from product_sales p left join events e using (date))"""
VIEWS["pfeatures"] = "select * from prod_features where has_complete_sales_history = 1"
VIEWS["picked"] = (
    f"select * from features where cat_id = '{CATEGORY}'"
)
VIEWS["cutoff"] = f"select cast(max(date) - {HORIZON - 1} as date) test_from from panel"
VIEWS["train"] = "select panel.* from panel cross join cutoff where date < test_from"
VIEWS["test"] = "select panel.* from panel cross join cutoff where date >= test_from"
VIEWS["tails"] = """
    select cat_id, units_sold, row_number() over (partition by cat_id order by date desc) age,
           max(date) over (partition by cat_id) train_end from train"""
VIEWS["naive"] = " union all ".join(
    f"""select cast(train_end + cast(s.step as int) as date) as date, cat_id, '{label}' model, greatest(units_sold, 0) predicted
        from tails join (select unnest(generate_series(1, {HORIZON})) step) s
          on age = {season} - (s.step - 1) % {season}"""
    for label, season in SEASONS.items()
)
VIEWS["errors"] = """
    select n.*, t.units_sold actual, units_sold - predicted residual, abs(units_sold - predicted) absolute_error,
           (units_sold - predicted) * (units_sold - predicted) squared_error,
           case when units_sold <> 0 then abs(units_sold - predicted) / units_sold * 100 end absolute_percentage_error
    from naive n left join test t using (date, cat_id)"""
METRICS = """
    count(*) observations, round(avg(abs(actual - predicted)), 3) mae,
    round(sqrt(avg((actual - predicted) * (actual - predicted))), 3) rmse,
    case when sum(actual) <> 0 then round(sum(abs(actual - predicted)) / sum(actual) * 100, 3) end wape,
    case when sum(actual) <> 0 then round(sum(predicted - actual) / sum(actual) * 100, 3) + 0.0 end forecast_bias,
    round(avg(actual), 3) mean_actual, round(avg(predicted), 3) mean_predicted"""
VIEWS["metrics"] = f"select cat_id, model, {METRICS} from errors group by cat_id, model"
VIEWS["all_metrics"] = f"""
    select case when grouping(cat_id) = 1 then 'ALL' else cat_id end cat_id, model, {METRICS}
    from errors group by grouping sets ((cat_id, model), (model))"""
VIEWS["ranks"] = """
    select *, cast(row_number() over (partition by cat_id order by wape, rmse, mae, model) as int) model_rank,
           row_number() over (partition by cat_id order by wape, rmse, mae, model) = 1 is_best_model from metrics"""
VIEWS["ranked"] = """
    select e.*, model_rank, is_best_model from errors e left join ranks using (cat_id, model)"""
VIEWS["dictionary"] = "select * from (values " + ", ".join(
    "(" + ", ".join(f"'{text}'" for text in entry) + ")" for entry in FEATURE_DICTIONARY
) + ') v(feature, "group", description)'
VIEWS["feature_row"] = "select " + ", ".join(
    f"100.0 * count_if({name} is null) / count(*) {name}"
    for name in dict.fromkeys([n for n, _, _ in FEATURE_DICTIONARY] + MISSINGNESS_FEATURES)
) + " from features"
VIEWS["feature_gaps"] = "unpivot feature_row on * into name feature value missing_pct"
PERCENT = "regexp_replace(printf('%.2f', round({0}, 2)), '\\.?0+$', '') || '%'"


def percent(name: str) -> str:
    return PERCENT.format(name)


def sql(select: str, six: str = "", two: str = "") -> str:
    """A full statement: all views, then ``select`` with the named columns rounded to 6 or 2 decimals as ``tidy`` does."""
    views = ", ".join(f"{name} as ({text})" for name, text in VIEWS.items())
    rounded = [f"round({c}, 6) + 0.0 as {c}" for c in six.split()]
    rounded += [f"round({c}, 2) + 0.0 as {c}" for c in two.split()]
    replace = f"replace ({', '.join(rounded)})" if rounded else ""
    return f"with {views}, result as ({select}) select * {replace} from result"


CYCLIC = "month_sin month_cos weekday_sin weekday_cos"
HISTORY = (
    "lag_1 lag_7 lag_14 lag_28 rolling_mean_7 rolling_mean_14 rolling_mean_28 rolling_sd_7 rolling_sd_28 "
    "rolling_min_7 rolling_max_7 zero_sales_rate_28 difference_from_lag_7 difference_from_mean_28"
)
PRICING = "previous_price price_change_1 price_pct_change_1 rolling_price_mean_28 price_relative_to_28_day_mean"
ERROR_COLUMNS = "predicted actual residual absolute_error squared_error absolute_percentage_error"
KEYS = ", ".join(DAILY_KEYS)
AVERAGE = "avg(units_sold) average_units"
IN_RANGE = f"date between date '{DATE_FROM}' and date '{DATE_TO}'"
CHOSEN = "cat_id = '" + CATEGORY + "' and model in (" + ", ".join(f"'{m}'" for m in MODELS) + ")"
VALIDATION = """
    count(*) as rows, count(distinct {key}) series, min(date) min_date, max(date) max_date,
    cast(count_if({target} is null) as bigint) missing_target, cast(count_if(lag_28 is null) as bigint) missing_lag_28,
    cast(count_if(rolling_mean_28 is null) as bigint) missing_rolling_mean_28"""

def missing_sql(view: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' variable, cast(count_if({c} is null) as bigint) missing,
            round(100.0 * count_if({c} is null) / count(*), 2) percent from {view}""" for c in columns
    )


CALENDAR_COLUMNS = [
    "date", "wm_yr_wk", "weekday", "wday", "month", "year", "d", "event_name_1", "event_type_1", "event_name_2",
    "event_type_2", "snap_ca", "snap_tx", "snap_wi",
]
FACT_COLUMNS = [
    "store_id", "state_id", "item_id", "dept_id", "cat_id", "sales", *CALENDAR_COLUMNS, "sell_price", "is_event",
    "is_weekend", "revenue",
]
# Column counts of the two feature tables, less one: panel or product columns, then 15 calendar,
# 4 event, 15 history, 8 price features and the history flag.
CATEGORY_FEATURES = 21 + 15 + 4 + 15 + 8 + 1 - 1
PRODUCT_FEATURES = 9 + 15 + 4 + 15 + 8 + 1 - 1
FEATURE_SUMMARY = f"""
    select 'Category-level' dataset, count(*) as rows, count(distinct cat_id) series, {CATEGORY_FEATURES} feature_count,
           min(date) minimum_date, max(date) maximum_date from features
    union all
    select 'Product-level', count(*), count(distinct item_id), {PRODUCT_FEATURES}, min(date), max(date) from pfeatures"""
LEAKAGE = "select corr({0}, lag_1) correlation_target_lag_1, corr({0}, rolling_mean_7) correlation_target_rolling_7 from {1}"
LINEAR = """
    select cast(count_if({y} is not null and {x} is not null) as bigint) pairs, regr_slope({y}, {x}) slope,
           regr_intercept({y}, {x}) intercept, regr_r2({y}, {x}) r2 from {view}"""
BIG_TOTALS = "select item_id, total_sales from product_totals"
WIDE_LONG = """
    select state_id, cat_id, 'd_' || cast(date_diff('day', lo, date) + 1 as varchar) d, coalesce(sales, 0) sales, date
    from spine cross join (select distinct state_id, cat_id from lines join products using (item_id))
         left join (select state_id, cat_id, date, sum(units) sales from lines join products using (item_id) group by all)
         using (state_id, cat_id, date)"""
RAW_LONG = """
    select store_id, dept_id, copy, date d, sum(units) sales from lines join products using (item_id), range(2) t(copy)
    where copy = 0 or state_id = 'ASIA' group by all"""
STORE_LONG = f"""
    select store_id, item_id, 'd_' || cast(date_diff('day', lo, date) + 1 as varchar) d, coalesce(sales, 0) sales
    from spine cross join (select distinct store_id, item_id from lines where store_id = '{STORE}')
         left join (select store_id, item_id, date, sum(units) sales from lines group by all) using (store_id, item_id, date)"""
TRAINED = "(select f.* from features f cross join cutoff where f.date < test_from)"
ROUND_TRIP = sql(
    "select date, cat_id, units_sold, average_price, event_name_1, is_event from panel", "units_sold average_price"
)
EFFECT = "select {0}, avg(units_sold) average_units, case when {0} = 1 then '{1} day' else 'Non-{2} day' end {3} from panel group by {0}"



def smoothing_views(cells: list[tuple]) -> str:
    """Recursive views of every cell on every category: ``run`` has the state before day t, ``scored`` the AICc."""
    rows = ", ".join(f"({i}, '{f}', {a}, {b}, {g}, {p})" for i, (f, a, b, g, p) in enumerate(cells))
    views = ", ".join(f"{name} as ({text})" for name, text in VIEWS.items())
    return f"""with recursive {views},
    y as (select cat_id, date, cast(units_sold as double) y, row_number() over (partition by cat_id order by date) - 1 t from train),
    heads as (select cat_id, list(y order by t) filter (t < 28) h, count(*) n, max(date) last_date, min(y) low from y group by cat_id),
    means as (select *, list_sum(h) / len(h) overall from heads),
    starts as (
      select *, sqrt(list_sum([(v - overall) * (v - overall) for v in h]) / len(h)) spread,
        (list_sum(h[greatest(len(h) - 6, 1) :]) / len(h[greatest(len(h) - 6, 1) :]) - list_sum(h[:7]) / len(h[:7])) / greatest(len(h) - 7, 1) rise,
        [coalesce(list_sum([v for v, i in h if (i - 1) % 7 = j]) / len([v for v, i in h if (i - 1) % 7 = j]), overall) for j in range(7)] cycle
      from means
    ),
    cells(cell, form, alpha, beta, gamma, phi) as (values {rows}),
    run(cat_id, cell, form, alpha, beta, gamma, phi, t, level, trend, season, squared, relative, logs, expected, effect) as (
      select cat_id, cell, form, cast(alpha as double), cast(beta as double), cast(gamma as double), cast(phi as double), 0, overall,
        case when form[2] = 'A' then rise else 0.0 end,
        [case when form[-1] = 'N' then case when form[-1] = 'M' then 1.0 else 0.0 end when form[-1] = 'M' then c / overall else c - overall end for c in cycle],
        0.0::double, 0.0::double, 0.0::double, null::double, null::double
      from starts, cells
      union all
      select cat_id, cell, form, alpha, beta, gamma, phi, t + 1, base + alpha * pull, slope + beta * pull,
        [case when j - 1 = t % 7 then moved else s end for s, j in season],
        squared + gap * gap, relative + (gap / expected) * (gap / expected), logs + ln(nullif(abs(expected), 0)), expected, moved
      from (
        select *, case when form[-1] = 'M' then gap / effect else gap end pull,
          effect + gamma * case when form[-1] = 'M' then gap / base else gap end moved
        from (
          select *, y - expected gap from (
            select *, case when form[-1] = 'M' then base * effect else base + effect end expected from (
              select r.cat_id, cell, form, alpha, beta, gamma, phi, r.t, season, squared, relative, logs, y,
                phi * trend slope, level + phi * trend base, season[cast(r.t % 7 as int) + 1] effect
              from run r join y on y.cat_id = r.cat_id and y.t = r.t
            )
          )
        )
      )
    ),
    ended as (
      select r.*, n, last_date, low,
        1 + 2 * cast(form[2] = 'A' as int) + 7 * cast(form[-1] <> 'N' as int) + cast(contains(form, 'Ad') as int) + 2 k
      from run r join heads h on r.cat_id = h.cat_id and r.t = h.n
    ),
    scored as (
      select *, case when form[1] = 'M' then n * ln(greatest(relative, {TINY})) + 2 * logs else n * ln(greatest(squared, {TINY})) end
          + 2 * k + 2 * k * (k + 1) / (n - k - 1) aicc
      from ended where n - k - 1 > 0 and (form[1] <> 'M' and form[-1] <> 'M' or low > 0) and (form[-1] = 'N' or n >= 14)
    ),
    placed as (select *, row_number() over (partition by cat_id order by aicc, cell) place from scored where not isnan(aicc))"""


def rounded(select: str, names: str) -> str:
    return f", result as ({select}) select * replace ({', '.join(f'round({c}, 6) + 0.0 as {c}' for c in names.split())}) from result"


SMOOTHED = smoothing_views(CELLS)
STATES = smoothing_views([STATE_CELL])

ORACLES: dict[str, str] = {
    "csv_round_trip": ROUND_TRIP,
    "parquet_round_trip": ROUND_TRIP,
    "feature_dictionary": sql("select d.*, missing_pct from dictionary d join feature_gaps using (feature)", "missing_pct"),
    "snake_columns": sql("select * from cal"),
    "ensure_price_column": sql("select date, cat_id, average_price from panel", "average_price"),
    "unpivot_daily_sales": sql(f"select state_id, cat_id, d, sales from ({WIDE_LONG})"),
    "unpivot_store_sales": sql(f"select * from ({STORE_LONG})"),
    "history_feature_long": sql(
        f"""select date, 'Actual demand' series, units_sold as value from picked
            union all select date, 'Historical feature', {HISTORY_FEATURE} from picked""", "value"),
    "scope_store": sql(f"select * from fact where store_id = '{STORE}'", "sales sell_price", "revenue"),
    "price_demand_points": sql("select sell_price, sales from fact where sell_price is not null", "sell_price sales"),
    "filter_panel": sql(f"select * from panel where {IN_RANGE} and cat_id = '{CATEGORY}'", "average_price", "revenue"),
    "model_ready": sql(
        "select date, cat_id, units_sold, lag_28, rolling_mean_28, has_complete_sales_history from features", "rolling_mean_28"),
    "train_test_split": sql(
        """select cat_id, date, units_sold, 'train' part from train
           union all select cat_id, date, units_sold, 'test' from test"""),
    "duplicate_keys": sql("select store_id, item_id, date, count(*) n from lines group by all having count(*) > 1"),
    "join_calendar": sql(
        f"""select w.state_id, w.cat_id, w.d, w.sales, w.date, wm_yr_wk, weekday, event_name_1, snap_ca
            from ({WIDE_LONG}) w left join cal using (d)"""),
    "join_prices": sql(
        """select f.store_id, f.item_id, date, sales, wm_yr_wk, sell_price
           from item_days f join week using (date) left join prices using (store_id, item_id, wm_yr_wk)""",
        "sales sell_price"),
    "selected_product_sales": sql("select * from product_sales", "sales sell_price"),
    "join_event_calendar": sql("select cat_id, p.is_event, e.* from panel p left join events e using (date)"),
    "event_calendar": sql("select * from events"),
    "missing_summary": sql(missing_sql("cal", CALENDAR_COLUMNS)),
    "missing_summary_sales": sql(missing_sql("fact", FACT_COLUMNS)),
    "missing_summary_prices": sql(missing_sql("prices", ["store_id", "item_id", "wm_yr_wk", "sell_price"])),
    "duplicate_rows": """
        select cast((select count(*) from lineitem) - (select count(*) from (select distinct * from lineitem)) as bigint) duplicate_rows""",
    "duplicate_rows_wide": sql(
        f"""select cast(count(*) - count(distinct {{'s': store_id, 'i': dept_id, 'v': days}}) as bigint) duplicate_rows
            from (select store_id, dept_id, copy, list(struct_pack(d := d, s := sales) order by d) as days from ({RAW_LONG}) group by all)"""),
    "missing_summary_wide": sql(
        f"""select variable, missing, round(100.0 * missing / n, 2) "percent" from (
              select 'd_' || (date_diff('day', lo, date) + 1) variable, any_value(n) n, cast(any_value(n) - count(r.d) as bigint) missing
              from spine join (select count(*) n from (select distinct store_id, dept_id, copy from ({RAW_LONG}))) on true
                   left join ({RAW_LONG}) r on r.d = date group by all
              union all select unnest(['store_id', 'dept_id']), 1, 0)"""),
    "duplicate_rows_calendar": sql("select cast((select count(*) from cal) - (select count(*) from (select distinct * from cal)) as bigint) duplicate_rows"),
    "duplicate_rows_prices": sql("select cast((select count(*) from prices) - (select count(*) from (select distinct * from prices)) as bigint) duplicate_rows"),
    "sales_profile": sql(
        """select count(*) as rows, count(distinct item_id) items, count(distinct store_id) stores, min(date) min_date,
                  max(date) max_date, cast(count_if(date is null) as bigint) missing_dates,
                  cast(count_if(sell_price is null) as bigint) missing_prices,
                  round(100.0 * count_if(sell_price is null) / count(*), 2) missing_price_pct from fact"""),
    "price_missing_summary": sql(
        """select sell_price is null price_missing, count(*) as rows, cast(count_if(sales = 0) as bigint) zero_sales_rows,
                  cast(count_if(sales > 0) as bigint) positive_sales_rows, coalesce(sum(sales), 0) total_units_sold,
                  avg(sales) average_units_sold from fact group by 1""", "total_units_sold average_units_sold"),
    "price_missing_by_month": sql(
        """select cast(date_trunc('month', date) as date) year_month, count(*) as rows,
                  cast(count_if(sell_price is null) as bigint) missing_prices,
                  round(100.0 * count_if(sell_price is null) / count(*), 2) missing_price_pct from fact group by 1"""),
    "sales_complete": sql("select * from fact", "sales sell_price", "revenue"),
    "daily_category_sales": sql(
        f"""select {KEYS}, sum(sales) units_sold, coalesce(sum(revenue), 0) revenue,
               sum(sell_price * greatest(sales, 1))
                 / sum(case when sell_price is not null then greatest(sales, 1) end) average_price,
               count(distinct case when sales > 0 then item_id end) active_items
            from fact group by {KEYS}""", "units_sold average_price", "revenue"),
    "date_range": sql("select min(date) min_date, max(date) max_date from panel"),
    "feature_validation": sql(f"select {VALIDATION.format(key='cat_id', target='units_sold')} from features"),
    "product_feature_validation": sql(
        f"""select {VALIDATION.format(key='item_id', target='sales')},
                   cast(count_if(sell_price is null) as bigint) missing_prices,
                   round(100.0 * count_if(sell_price is null) / count(*), 2) missing_price_pct from pfeatures"""),
    "leakage_check": sql(LEAKAGE.format("units_sold", "features"), "correlation_target_lag_1 correlation_target_rolling_7"),
    "product_leakage_check": sql(LEAKAGE.format("sales", "pfeatures"), "correlation_target_lag_1 correlation_target_rolling_7"),
    "feature_summary": sql(FEATURE_SUMMARY),
    "series_validation": sql(
        """select cat_id, count(*) as rows, count(distinct date) unique_dates, min(date) minimum_date, max(date) maximum_date,
                  cast(count_if(units_sold is null) as bigint) missing_target from features group by cat_id"""),
    "series_agreement": sql(
        """select cast(sum(gaps) as bigint) missing_target,
                  count(distinct n) = 1 and count(distinct lo) = 1 and count(distinct hi) = 1 series_agree
           from (select cat_id, count(*) n, min(date) lo, max(date) hi, count_if(units_sold is null) gaps
                 from features group by cat_id)"""),
    "split_validation": sql(
        f"""select cat_id, count(*) test_rows, count(*) = {HORIZON} fills_horizon,
                   (select max(date) from train) >= min(date) train_overlap from test group by cat_id"""),
    "forecast_validation": sql(
        f"""select count(*) as rows, (select count(*) from test) * {len(SEASONS)} expected_rows,
                   cast(count_if(actual is null) as bigint) missing_actual,
                   cast(count_if(predicted is null) as bigint) missing_predicted from errors"""),
    "forecast_metadata": sql(
        f"""select 'ALL' project_store, {HORIZON} forecast_horizon_days, min(f.date) training_start_date,
                   max(f.date) training_end_date, (select min(date) from test) testing_start_date,
                   (select max(date) from test) testing_end_date, count(distinct cat_id) categories,
                   (select count(distinct model) from errors) models_evaluated,
                   'Fixed 28-day chronological holdout' evaluation_type, 'WAPE' ranking_metric
            from features f cross join cutoff where f.date < test_from"""),
    "active_items_rollup": sql(
        """with sold as (select l.*, n_nationkey from lines l join nation on n_name = store_id where units > 0)
           select 'day' grain, cast(date as varchar) member, count(distinct item_id) active_items from sold group by all
           union all select 'week', cast(wm_yr_wk as varchar), count(distinct item_id) from sold join week using (date) group by all
           union all select 'month', strftime(date, '%Y-%m'), count(distinct item_id) from sold group by all
           union all select 'store', cast(n_nationkey as varchar), count(distinct item_id) from sold group by all"""),
    "price_quartiles": """
        select flag, probability, round(value, 6) + 0.0 value from (
          select l_returnflag flag, unnest([0.25, 0.5, 0.75]) probability, unnest(quantile_cont(l_extendedprice, [0.25, 0.5, 0.75])) value
          from lineitem group by l_returnflag)""",
    "selected_medians": sql(
        "unpivot (select " + ", ".join(f"median(cast({n} as double)) {n}" for n in PREDICTORS if n != "cat_id")
        + " from (select f.* from features f cross join cutoff where date < test_from)) on * into name feature value median", "median"),
    "bucketed_prices": sql(
        """select n_nationkey store_no, f.item_id, wm_yr_wk, date, sales, sell_price
           from item_days f join nation on n_name = store_id join week using (date) left join prices using (store_id, item_id, wm_yr_wk)""",
        "sales sell_price"),
    "bucketed_selection": sql("select item_id, date, sales from product_days join selected using (item_id)", "sales"),
    "filter_panel_pruned": sql(
        f"select date, cat_id, units_sold, revenue, is_event from panel where {IN_RANGE} and cat_id = '{CATEGORY}'", "units_sold", "revenue"),
    "holdout_pruned": sql("select date, cat_id, units_sold, revenue, is_event from test", "units_sold", "revenue"),
    "rollup_kept_up": f"""
        select l_suppkey supplier, cast(date_trunc('month', {DAY}) as date) year_month, sum(l_quantity) quantity, count(*) lines
        from lineitem group by all""",
    "price_asof": sql(
        """with weekly as (
             select item_id, cast(date_trunc('week', date) as date) monday, max(unit_price) recorded_price from lines
             where unit_price is not null group by all)
           select p.item_id, p.date, p.sales, recorded_price from product_days p
                asof left join weekly w on p.item_id = w.item_id and date_trunc('week', p.date) > w.monday""",
        "sales recorded_price"),
    "daily_total": sql("select date, sum(units_sold) units, sum(revenue) revenue from panel group by date", "", "revenue"),
    "daily_total_ma30": sql(
        """select *, case when row_number() over (order by date) >= 30
                     then avg(units) over (order by date rows between 29 preceding and current row) end ma30
           from (select date, sum(units_sold) units, sum(revenue) revenue from panel group by date)""", "ma30", "revenue"),
    "monthly_seasonality": sql("select year, month, sum(units_sold) units from panel group by year, month"),
    "category_summary": sql(
        """select cat_id, sum(units_sold) total_sales, sum(revenue) total_revenue, avg(units_sold) avg_daily_sales
           from panel group by cat_id""", "avg_daily_sales", "total_revenue"),
    "weekday_totals": sql("select weekday, wday, sum(units_sold) sales from panel group by weekday, wday"),
    "event_effect": sql(EFFECT.format("is_event", "Event", "event", "event_status"), "average_units"),
    "snap_effect": sql(EFFECT.format("snap_ca", "SNAP", "SNAP", "snap_status"), "average_units"),
    "price_demand_curve": sql(
        f"""select cast(floor(sell_price / {PRICE_WIDTH}) as bigint) price_bin, count(*) as rows, {PRICE_MEAN},
                   avg(sales) average_units from fact where sell_price is not null group by 1""", "average_price average_units"),
    "price_demand_fit": sql(LINEAR.format(y="sales", x="sell_price", view="fact"), "slope intercept r2"),
    "product_totals": sql(f"{BIG_TOTALS} order by total_sales desc, item_id limit 20"),
    "product_summary": sql(
        f"""select t.* exclude (average_price), p.average_price
           from product_table t join (select item_id, {PRICE_MEAN} from product_values group by 1) p
             using (item_id)""",
        "average_daily_sales median_daily_sales zero_sales_pct average_price"),
    "top_products": sql(
        f"select item_id, total_sales from (select *, rank() over (order by total_sales desc) r from product_totals) where r <= 10"),
    "top_products_strict": sql(f"{BIG_TOTALS} order by total_sales desc, item_id limit 10"),
    "select_top_products": sql("select item_id from selected"),
    "top_products_per_category": sql(
        """select item_id, cat_id, total_sales from
             (select *, rank() over (partition by cat_id order by total_sales desc) r from product_totals) where r <= 10"""),
    "calendar_features": sql(f"select date, {calendar_columns()} from cal", CYCLIC),
    "sales_history_features": sql(
        f"select cat_id, date, units_sold, {history_columns('cat_id', 'units_sold')} from panel", HISTORY),
    "price_features": sql(
        f"select date, cat_id, average_price, {price_columns('cat_id', 'average_price')} from panel", f"average_price {PRICING}"),
    "category_features": sql("select * from features", f"average_price {CYCLIC} {HISTORY} {PRICING}", "revenue"),
    "product_features": sql("select * from pfeatures", f"sell_price {CYCLIC} {HISTORY} {PRICING}"),
    "seasonal_naive_forecast": sql("select * from naive where model = 'Seasonal Naive'"),
    "ets_cells": SMOOTHED + rounded(
        "select cat_id, last_date, cell, form, alpha, beta, gamma, phi, aicc, cast(place as int) rank, level, trend from placed",
        "alpha beta gamma phi aicc level trend",
    ),
    "ets_cell_forecast": SMOOTHED + rounded(
        """select cast(last_date + cast(h as int) as date) as date, cat_id, 'ETS' model, greatest(0.0, case
               when form[-1] = 'N' then base when form[-1] = 'M' then base * effect else base + effect end) predicted
           from (select *, level + trend * case when contains(form, 'Ad') then phi * (1 - power(phi, h)) / (1 - phi) else h end base,
                   season[cast((n + h - 1) % 7 as int) + 1] effect
                 from placed, range(1, 29) x(h) where place = 1)""",
        "predicted",
    ),
    "ets_states": STATES + rounded(
        "select cat_id, cast(t - 1 as int) day_number, expected, level, trend, effect from run where t > 0", "expected level trend effect"
    ),
    "ets_rescored": sql("select distinct cat_id, true agrees from train"),
    "forecasting_run_rows": sql(
        """select case when grouping(cat_id) = 1 then 'ALL' else cat_id end cat_id, model, count(*) observations, true errors_agree
           from test, (values ('Seasonal Naive'), ('ETS'), ('Gradient Boosting')) m(model) group by grouping sets ((cat_id, model), (model))"""),
    "gbt_forecast_rows": sql("select date, cat_id, 'Gradient Boosting' model, true not_negative from test"),
    "gbt_importance_totals": "select 1.0::double gain, 1.0::double cover, 1.0::double frequency",
    "gbt_predictors": sql(
        f"select date, units_sold, {', '.join(PREDICTORS)} from features", f"{CYCLIC} average_price price_relative_to_28_day_mean"),
    "median_imputed_features": sql(
        """select date, cat_id,
                  coalesce(average_price, (select median(average_price) from tr)) average_price,
                  coalesce(price_relative_to_28_day_mean,
                           (select median(price_relative_to_28_day_mean) from tr)) price_relative_to_28_day_mean
           from tr""".replace("from tr", "from (select f.* from features f cross join cutoff where f.date < test_from)"),
        "average_price price_relative_to_28_day_mean"),
    "zero_variance_columns": sql(
        " union all ".join(
            f"""select '{n}' feature, count(distinct coalesce({n}, (select median({n}) from tr))) = 1 is_constant
                from tr having count({n}) > 0"""
            for n in PREDICTORS if n != "cat_id"
        ).replace("from tr", "from (select f.* from features f cross join cutoff where f.date < test_from)")),
    "gbt_model_frame": sql(
        " union all ".join(
            [f"""select date, cat_id, 'cat_id_' || level feature, cast(cat_id = level as double) as value
                 from {TRAINED} cross join (select distinct cat_id level from {TRAINED})"""]
            + [f"""select date, cat_id, '{n}', coalesce(cast({n} as double), middle) from {TRAINED}
                   cross join (select median({n}) middle, min({n}) low, max({n}) high from {TRAINED})
                   where middle is not null and (low <> high or low <> middle)""" for n in PREDICTORS if n != "cat_id"]
        ), "value"),
    "forecast_errors": sql("select * from errors", ERROR_COLUMNS),
    "all_forecasts": sql("select date, cat_id, model, predicted, actual from errors"),
    "forecast_metrics": sql(f"select model, {METRICS} from errors group by model"),
    "category_model_metrics": sql("select * from metrics"),
    "all_model_metrics": sql("select * from all_metrics"),
    "model_rankings": sql("select * from ranks"),
    "best_models": sql("select cat_id, model, mae, rmse, wape, forecast_bias from ranks where is_best_model"),
    "forecasts_with_rank": sql("select * from ranked", ERROR_COLUMNS),
    "category_residuals": sql("select * from ranked", ERROR_COLUMNS),
    "overall_metrics": sql("select * from all_metrics where cat_id = 'ALL'"),
    "overview_kpis": sql(
        """select sum(units_sold) total_units, sum(revenue) total_revenue,
                  (select count(distinct item_id) from product_days) product_count,
                  strftime(min(date), '%b %Y') || ' – ' || strftime(max(date), '%b %Y') date_range from panel""",
        "", "total_revenue"),
    "category_mix": sql("select cat_id, sum(units_sold) total_units from panel group by cat_id"),
    "weekday_average": sql(f"select weekday, wday, {AVERAGE} from panel group by weekday, wday", "average_units"),
    "month_average": sql(f"select month, {AVERAGE} from panel group by month", "average_units"),
    "key_findings": sql(
        """(select 'top_category' finding, cat_id as value, sum(units_sold) units from panel group by cat_id
            order by units desc, cat_id limit 1)
           union all
           (select 'peak_day', strftime(date, '%B %d, %Y'), sum(units_sold) units from panel group by date
            order by units desc, date limit 1)"""),
    "demand_trend": sql(
        f"select date, cat_id, coalesce(sum(revenue), 0) metric_value from panel group by date, cat_id",
        "", "metric_value"),
    "monthly_category_trend": sql(
        "select cast(date_trunc('month', date) as date) year_month, cat_id, sum(units_sold) total_units from panel group by all"),
    "event_lift": sql(
        """select event_mean, non_event_mean, round((event_mean - non_event_mean) / non_event_mean * 100, 1) lift_pct,
                  case when event_mean >= non_event_mean then 'higher' else 'lower' end direction
           from (select avg(case when is_event = 1 then units_sold end) event_mean,
                        avg(case when is_event = 0 then units_sold end) non_event_mean from panel)""",
        "event_mean non_event_mean lift_pct"),
    "intermittency_histogram": sql(
        """select bin, bin * 2.5 from_pct, (bin + 1) * 2.5 to_pct, count(*) products
           from (select cast(least(floor(zero_sales_pct / 2.5), 39) as int) bin from product_table) group by bin"""
           .replace("bin * 2.5", "cast(bin * 2.5 as double)").replace("(bin + 1) * 2.5", "cast((bin + 1) * 2.5 as double)")),
    "series_intermittency_histogram": sql(
        """select bin, cast(bin * 2.5 as double) from_pct, cast((bin + 1) * 2.5 as double) to_pct, count(*) products from
             (select cast(least(floor(100.0 * count_if(coalesce(sales, 0) = 0) / count(*) / 2.5), 39) as int) bin
              from spine cross join (select distinct store_id, cat_id from fact)
                   left join (select store_id, cat_id, date, sum(sales) sales from fact group by all) using (store_id, cat_id, date)
              group by store_id, cat_id) group by bin"""),
    "feature_linear_fit": sql(LINEAR.format(y="units_sold", x=HISTORY_FEATURE, view="picked"), "slope intercept r2"),
    "feature_group_counts": sql(
        'select "group", count(*) feature_count from dictionary join feature_gaps using (feature) group by 1'),
    "feature_correlation": sql(f"select round(corr(units_sold, {HISTORY_FEATURE}), 3) correlation from picked"),
    "iso_weekday_average": sql(
        """select *, row_number() over (order by average_units desc, weekday_number) = 1 is_top
           from (select weekday_number, dayname(date) weekday, avg(units_sold) average_units from picked group by 1, 2)""",
        "average_units"),
    "event_proximity_effect": sql(
        f"""select case when is_event = 1 then 'Event day' when within_3_days_of_event = 1 then 'Within 3 days'
                   when within_7_days_of_event = 1 then 'Within 4–7 days' else 'More than 7 days away' end event_proximity,
                   {AVERAGE} from picked group by 1""", "average_units"),
    "feature_missingness": sql(
        "select * from feature_gaps where feature in (" + ", ".join(f"'{n}'" for n in MISSINGNESS_FEATURES) + ")",
        "missing_pct"),
    "feature_table": sql(
        "select " + ", ".join(FEATURE_TABLE_COLUMNS) + " from picked", "", " ".join(ROUNDED_COLUMNS)),
    "feature_kpis": sql(
        """select count(*) category_rows, count(distinct cat_id) series_count,
                  (select count(*) from dictionary join feature_gaps using (feature)) feature_count from features"""),
    "filter_choices": sql(
        """select 'cat_id' field, cat_id choice from errors group by 2
           union all select 'model', model from errors group by 2
           union all select 'date', cast(min(date) as varchar) from errors
           union all select 'date', cast(max(date) as varchar) from errors"""),
    "filter_forecasts": sql(f"select * from errors where {CHOSEN}", ERROR_COLUMNS),
    "forecast_kpis": sql(
        f"""select model best_model, {percent('wape')} best_wape, '{HORIZON} days' forecast_horizon,
                   (select count(distinct cat_id) from errors) category_count
            from all_metrics where cat_id = 'ALL' order by wape, rmse, mae, model limit 1"""),
    "forecast_series": sql(f"select date, cat_id, model, predicted from errors where {CHOSEN}"),
    "actual_series": sql(f"select distinct date, cat_id, actual from errors where {CHOSEN}"),
    "baseline_improvement": sql(
        """select cat_id, model best_model, round(wape, 2) best_wape, round(mae, 1) best_mae,
                  round(forecast_bias, 2) best_bias, baseline_wape,
                  case when baseline_wape <> 0 then round((baseline_wape - wape) / baseline_wape * 100, 1) + 0.0 end improvement_pct
           from (select *, row_number() over (partition by cat_id order by wape, rmse, mae, model) r from all_metrics)
                join (select cat_id, max(wape) baseline_wape from all_metrics where model = 'Seasonal Naive' group by 1)
                using (cat_id) where r = 1"""),
    "metric_comparison": sql(f"select cat_id, model, rmse metric_value from all_metrics where cat_id = '{CATEGORY}'"),
    "model_recommendation": sql(
        f"""select cat_id, model recommended_model, {percent('wape')} wape, round(rmse, 1) rmse,
                   case when forecast_bias > 0 then 'overforecast' when forecast_bias < 0 then 'underforecast'
                        else 'remain unbiased' end bias_direction, {percent('forecast_bias')} forecast_bias
            from ranks where model_rank = 1"""),
    "metrics_table": sql(
        f"""select cat_id, model, observations, round(mae, 1) mae, round(rmse, 1) rmse, round(mean_actual, 1) mean_actual,
                   round(mean_predicted, 1) mean_predicted, {percent('wape')} wape, {percent('forecast_bias')} forecast_bias
            from all_metrics"""),
    "residual_series": sql(f"select date, cat_id, model, residual from errors where {CHOSEN}", "residual"),
    "residual_boxplot": sql(
        """select e.cat_id, e.model,
                  min(case when residual between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then residual end) whisker_low,
                  max(q1) q1, max(q2) median, max(q3) q3,
                  max(case when residual between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then residual end) whisker_high,
                  cast(count_if(residual not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as bigint) outliers
           from errors e join (select cat_id, model, quantile_cont(residual, 0.25) q1, quantile_cont(residual, 0.5) q2,
                                      quantile_cont(residual, 0.75) q3 from errors group by 1, 2) q using (cat_id, model)
           group by 1, 2""", "whisker_low q1 median q3 whisker_high"),
    "residual_insight": sql(
        """select *, row_number() over (partition by cat_id order by abs(mean_residual), model) = 1 closest_to_zero
           from (select cat_id, model, avg(residual) mean_residual, max(absolute_error) largest_absolute_error
                 from errors group by 1, 2)""", "mean_residual largest_absolute_error"),
    "forecast_table": sql(
        """select date, cat_id, model, actual, round(predicted, 1) predicted, round(residual, 1) residual,
                  round(absolute_error, 1) absolute_error, round(absolute_percentage_error, 2) absolute_percentage_error,
                  model_rank, is_best_model from ranked"""),
}
