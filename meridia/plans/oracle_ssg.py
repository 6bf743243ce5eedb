"""SQL of the stock study. A series is rows (ticker, i, v), i from 1; an estimate is made for each number h of values held back."""

from __future__ import annotations

from .oracle import AS_OF, DEFINED, R
from .ssg import BLEND_WITHIN, ESTIMATORS, HORIZON, LARGE, MAX_DEBT, MAX_GROWTH, MAX_HIGH_PE, MIN_GROWTH, MIN_RATIO, MIN_ROE, MIN_UP, MIN_YEARS, RETURNS, SMALL


def _compound(first: str, n: str) -> str:
    return f"CASE WHEN {n} >= 2 AND {first} > 0 AND l[m] > 0 THEN pow(l[m] / {first}, 1.0 / ({n} - 1)) - 1 END"


_WAYS = {
    "logfit_trend": "CASE WHEN m >= 3 AND least_v > 0 THEN exp(slope) - 1 END",
    "cagr_5yr": _compound("l[greatest(1, m - 5)]", "least(m, 6)"),
    "cagr_3yr": _compound("l[greatest(1, m - 3)]", "least(m, 4)"),
    "mean_yoy": "steps / nullif(weights, 0)",
    "cagr_full": _compound("l[1]", "m"),
    "last_yoy": "CASE WHEN m >= 2 AND l[m - 1] > 0 THEN l[m] / l[m - 1] - 1 END",
}


def forecast(name: str, series: str, analyst: str = "SELECT NULL AS ticker, NULL::DOUBLE AS analyst_growth WHERE false") -> None:
    """Defines name_fc (ticker, method, growth, err, last) from a table series (ticker, i, v)."""
    ways = " UNION ALL ".join(f"SELECT ticker, n, h, m, l, {k} AS place, '{w}' AS method, {_WAYS[w]} AS g FROM {name}_train" for k, w in enumerate(ESTIMATORS))
    DEFINED[f"{name}_cut"] = f"""SELECT s.*, h, n - h AS m, CASE WHEN lag(v) OVER w > 0 THEN (v / lag(v) OVER w - 1) * (i - 1) END AS step, CASE WHEN lag(v) OVER w > 0 THEN i - 1 END AS weight
      FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM {series}) s, (SELECT unnest(range(4)) AS h) WHERE n >= 3 AND h <= n - 2 AND i <= n - h WINDOW w AS (PARTITION BY ticker, h ORDER BY i)"""
    DEFINED[f"{name}_train"] = f"""SELECT ticker, n, h, m, list(v ORDER BY i) AS l, min(v) AS least_v, regr_slope(ln(CASE WHEN v > 0 THEN v END), i) AS slope, sum(step) AS steps, sum(weight) AS weights
      FROM {name}_cut GROUP BY ticker, n, h, m"""
    DEFINED[f"{name}_ways"] = ways
    DEFINED[f"{name}_miss"] = f"""SELECT ticker, place, h, avg(CASE WHEN abs(a) + abs(p) > 0 THEN abs(a - p) / ((abs(a) + abs(p)) / 2) END) AS miss FROM (
        SELECT w.ticker, place, w.h, s.v AS a, l[m] * pow(1 + g, s.i - m) AS p FROM {name}_ways w JOIN {series} s ON s.ticker = w.ticker AND s.i > m WHERE w.h > 0 AND g IS NOT NULL) GROUP BY ALL"""
    DEFINED[f"{name}_best"] = f"""SELECT w.ticker, method, g, err, l[m] AS last FROM {name}_ways w LEFT JOIN (SELECT ticker, place, avg(miss) AS err FROM {name}_miss GROUP BY ALL) e ON e.ticker = w.ticker AND e.place = w.place
      WHERE h = 0 AND g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY w.ticker ORDER BY err IS NULL, {R('err', 12)}, w.place) = 1"""
    DEFINED[f"{name}_fc"] = f"""SELECT b.ticker, CASE WHEN near THEN method || '+analyst' ELSE method END AS method, greatest(-{MAX_GROWTH}, least({MAX_GROWTH}, CASE WHEN near THEN 0.5 * g + 0.5 * analyst_growth ELSE g END)) AS growth,
        {R('err', 12)} AS err, last FROM (SELECT b.*, analyst_growth, coalesce(abs(analyst_growth - g) <= {BLEND_WITHIN}, false) AS near FROM {name}_best b LEFT JOIN ({analyst}) a ON a.ticker = b.ticker) b"""


def _place(most: int) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= {most}"


def _mean_pe(c: str) -> str:
    top = f"CASE WHEN count(*) FILTER ({c} > 0) >= 5 THEN 1 ELSE 0 END"
    return f"(coalesce(sum({c}) FILTER ({c} > 0), 0) - {top} * coalesce(max({c}) FILTER ({c} > 0), 0)) / nullif(count(*) FILTER ({c} > 0) - {top}, 0)"


def _grown(s: str) -> str:
    return f"coalesce(nullif(CASE WHEN n_{s} >= 3 AND least_{s} > 0 THEN exp(slope_{s}) - 1 END, 0), CASE WHEN n_{s} >= 2 AND first_{s} > 0 AND last_{s} > 0 THEN pow(last_{s} / first_{s}, 1.0 / (n_{s} - 1)) - 1 END)"


def _of(s: str, v: str) -> str:
    return f"count({v}) AS n_{s}, min({v}) AS least_{s}, arg_min({v}, i_{s}) AS first_{s}, arg_max({v}, i_{s}) AS last_{s}, regr_slope(ln(CASE WHEN {v} > 0 THEN {v} END), i_{s}) AS slope_{s}"


DEFINED |= {
    "study_eps": f"""SELECT ticker, year(date) AS year, CAST(sum(CAST(eps_actual AS DECIMAL(18,4))) AS DOUBLE) AS eps FROM (SELECT * FROM growth_earnings WHERE eps_actual IS NOT NULL {_place(4 * (MIN_YEARS + 3) + 4)})
      GROUP BY 1, 2 HAVING count(*) >= 3""",
    "study_years": f"""SELECT y.*, e.eps, count(e.eps) OVER (PARTITION BY y.ticker) AS n_known, lag(total_revenue) OVER (PARTITION BY y.ticker ORDER BY y.date) AS before,
        row_number() OVER (PARTITION BY y.ticker ORDER BY y.date) AS i_sales, CASE WHEN e.eps IS NOT NULL THEN count(e.eps) OVER (PARTITION BY y.ticker ORDER BY y.date) END AS i_eps
      FROM (SELECT *, year(date) AS year FROM growth_statements {_place(MIN_YEARS + 4)}) y LEFT JOIN study_eps e ON e.ticker = y.ticker AND e.year = y.year""",
    "analyst_growth": """SELECT ticker, growth AS analyst_growth FROM earnings_trend WHERE growth IS NOT NULL AND period IN ('+5y', '+1y', '0y')
      QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CASE period WHEN '+5y' THEN 1 WHEN '+1y' THEN 2 ELSE 3 END, date DESC) = 1""",
    "eps_levels": f"SELECT ticker, i_eps AS i, eps AS v FROM study_years WHERE eps IS NOT NULL AND n_known >= {MIN_YEARS}",
    "sales_levels": "SELECT ticker, i_sales AS i, total_revenue AS v FROM study_years",
    "pe_history": f"""SELECT ticker, least({MAX_HIGH_PE}, {_mean_pe('hi')}) AS high_pe, {_mean_pe('lo')} AS low_pe FROM (SELECT x.ticker, high / eps AS hi, low / eps AS lo FROM (
        SELECT ticker, year(date) AS year, min(low) AS low, max(high) AS high FROM eod_prices WHERE date >= {AS_OF} - {365 * (MIN_YEARS + 1)} GROUP BY 1, 2) x JOIN study_eps e ON e.ticker = x.ticker AND e.year = x.year WHERE eps > 0) GROUP BY ticker""",
    "study_history": f"""SELECT *, CASE WHEN years < {MIN_YEARS} THEN ['too few years'] ELSE list_filter([CASE WHEN coalesce(sales_growth < {MIN_GROWTH}, true) THEN 'sales growth too low' END,
        CASE WHEN coalesce(eps_growth < {MIN_GROWTH}, true) THEN 'EPS growth too low' END, CASE WHEN ups / greatest(years - 1, 1) < {MIN_UP} THEN 'inconsistent sales' END,
        CASE WHEN coalesce(roe < {MIN_ROE}, true) THEN 'ROE too low' END, CASE WHEN debt_to_cap > {MAX_DEBT} THEN 'too much debt' END, CASE WHEN margin <= 0 THEN 'no margin' END], lambda x: x IS NOT NULL) END AS gates
      FROM (SELECT h.*, market_cap, dividend_yield, {_grown('sales')} AS sales_growth, CASE WHEN n_known >= {MIN_YEARS} THEN {_grown('eps')} END AS eps_growth, coalesce(return_on_equity, CASE WHEN equity > 0 AND net <> 0 THEN net / equity END) AS roe,
          CASE WHEN equity <> 0 AND debt + equity > 0 THEN debt / (debt + equity) END AS debt_to_cap, pretax / nullif(last_sales, 0) AS margin
        FROM (SELECT ticker, count(*) AS years, any_value(n_known) AS n_known, count(*) FILTER (total_revenue > before) AS ups, {_of('sales', 'total_revenue')}, {_of('eps', 'eps')},
            arg_max(total_stockholder_equity, date) AS equity, arg_max(coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0), date) AS debt, arg_max(net_income, date) AS net, arg_max(income_before_tax, date) AS pretax
          FROM study_years GROUP BY ticker) h LEFT JOIN fundamentals f ON f.ticker = h.ticker)""",
    "study_priced": f"""SELECT *, CASE WHEN cur <= buy_below THEN 'BUY' WHEN cur >= sell_above THEN 'SELL' WHEN buy_below IS NOT NULL THEN 'HOLD' END AS zone,
        CASE WHEN buy_below IS NULL THEN NULL WHEN cur - lo > 0 THEN (hi - cur) / (cur - lo) WHEN hi - cur > 0 THEN 'inf'::DOUBLE END AS updown,
        CASE WHEN buy_below IS NOT NULL THEN coalesce(appreciation, 0) + coalesce(dividend_yield, 0) END AS total_return
      FROM (SELECT *, CASE WHEN hi > lo THEN lo + (hi - lo) / 3 END AS buy_below, CASE WHEN hi > lo THEN hi - (hi - lo) / 3 END AS sell_above,
          CASE WHEN hi > lo AND cur > 0 AND hi > 0 THEN pow(hi / cur, 1 / {HORIZON}) - 1 END AS appreciation
        FROM (SELECT *, high_pe * projected AS hi, low_pe * base AS lo FROM (
          SELECT h.*, high_pe, low_pe, price AS cur, f.last AS base, f.method AS eps_method, least(f.growth, coalesce(s.growth, f.growth)) AS fc_eps, f.last * pow(1 + least(f.growth, coalesce(s.growth, f.growth)), {HORIZON}) AS projected
          FROM study_history h LEFT JOIN pe_history p ON p.ticker = h.ticker LEFT JOIN latest_price l ON l.ticker = h.ticker LEFT JOIN eps_fc f ON f.ticker = h.ticker AND len(gates) = 0 LEFT JOIN sales_fc s ON s.ticker = h.ticker AND len(gates) = 0)))""",
    "ssg_study": f"""SELECT {AS_OF} AS issue_date, ticker, cur AS current_price, len(reasons) = 0 AS is_buy, passed AS quality_pass, {", ".join(f"{R(c)} AS {c}" for c in ("sales_growth", "eps_growth", "roe", "debt_to_cap"))},
        CASE WHEN passed THEN zone END AS zone, CASE WHEN passed AND updown < 'inf'::DOUBLE THEN {R('updown')} END AS updown_ratio, CASE WHEN passed THEN {R('fc_eps')} END AS forecast_growth, CASE WHEN passed THEN {R('projected')} END AS projected_eps_5yr,
        {", ".join(f"CASE WHEN passed THEN {R(c)} END AS {c}" for c in ("high_pe", "low_pe", "buy_below", "sell_above", "total_return"))}, CASE WHEN passed THEN {R('appreciation')} END AS price_appreciation_cagr,
        CASE WHEN passed THEN eps_method END AS eps_method, array_to_string(reasons, '; ') AS reasons
      FROM (SELECT *, list_concat(gates, list_filter([CASE WHEN shut THEN 'price zones unavailable' END, CASE WHEN ready AND zone <> 'BUY' THEN 'not in the buy zone' END,
          CASE WHEN ready AND updown < {MIN_RATIO} THEN 'too little to gain for what can be lost' END, CASE WHEN ready AND total_return < hurdle THEN 'return below the hurdle' END], lambda x: x IS NOT NULL)) AS reasons
        FROM (SELECT *, passed AND (zone IS NULL OR updown IS NULL) AS shut, passed AND zone IS NOT NULL AND updown IS NOT NULL AS ready FROM (
          SELECT *, len(gates) = 0 AS passed, CASE WHEN market_cap < {SMALL} THEN {RETURNS['small']} WHEN market_cap >= {LARGE} THEN {RETURNS['large']} ELSE {RETURNS['medium']} END AS hurdle FROM study_priced)))""",
}
forecast("eps", "eps_levels", "SELECT * FROM analyst_growth")
forecast("sales", "sales_levels")
for _name in ("study_priced", "ssg_study"):  # after the forecasts that they read
    DEFINED[_name] = DEFINED.pop(_name)

SQL = {
    "analyst_growth": "SELECT * FROM analyst_growth",
    "pe_ratios": f"SELECT ticker, {R('high_pe', 6)} AS high_pe, {R('low_pe', 6)} AS low_pe FROM pe_history",
    "eps_forecast": f"SELECT ticker, method, {R('growth', 6)} AS growth, {R(f'last * pow(1 + growth, {HORIZON})')} AS projected_level, {R('err', 6)} AS backtest_error FROM eps_fc",
    "ssg_study": "SELECT * FROM ssg_study",
    "sig_ssg": "SELECT l.ticker, total_return AS value, CASE WHEN s.ticker IS NULL THEN 'not_covered' WHEN total_return IS NULL THEN 'no_projection' END AS reason FROM listed l LEFT JOIN ssg_study s ON s.ticker = l.ticker",
}
