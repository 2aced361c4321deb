"""DuckDB SQL for the panel queries, built from named common table expressions."""

from __future__ import annotations

import re

#: Each may use others by name; sql() puts in front of a query what it needs.
PARTS: dict[str, str] = {}


def _bars(unit: str) -> str:
    cents = "sum(round(l_extendedprice * 100)::bigint)::double / 100"
    return f"""select l_suppkey as asset_id, date_trunc('{unit}', l_shipdate)::date as date, {cents} / sum(l_quantity) as price,
        {cents} as dollar_volume from lineitem group by 1, 2"""


for _u, _s in (("month", "m"), ("week", "w"), ("day", "d")):
    PARTS[f"bars_{_s}"] = _bars(_u)
    PARTS[f"cal_{_s}"] = f"select date, row_number() over (order by date) as t from (select distinct date from bars_{_s})"
    PARTS[f"grid_{_s}"] = f"""select a.asset_id, c.date, c.t, b.price, b.dollar_volume from (select distinct asset_id from bars_{_s}) a
        cross join cal_{_s} c left join bars_{_s} b on a.asset_id = b.asset_id and c.date = b.date"""
    PARTS[f"raw_{_s}"] = f"select *, price / lag(price) over (partition by asset_id order by t) - 1 as r from grid_{_s}"
    PARTS[f"hard_{_s}"] = f"select *, coalesce(r >= 10 or r < -1, false) as hard from raw_{_s}"
    PARTS[f"clean_{_s}"] = f"select asset_id, date, t, case when not hard then price end as price, dollar_volume, hard from hard_{_s}"
    PARTS[f"ret_{_s}"] = f"""select *, price / lag(price) over (partition by asset_id order by t) - 1 as ret,
        lead(price) over (partition by asset_id order by t) / price - 1 as fwd_ret from clean_{_s}"""


def _compound(rows: int, lag: int = 0) -> str:
    w = f"(partition by asset_id order by t rows between {rows - 1 + lag} preceding and {f'{lag} preceding' if lag else 'current row'})"
    good = "(case when ret > -1 then ln(1 + ret) end)"
    return f"case when count({good}) over {w} = {rows} then exp(sum({good}) over {w}) - 1 end"


PARTS |= {
    "mkt_m": "select *, (sum(ret) over (partition by date) - ret) / nullif(count(ret) over (partition by date) - 1, 0) as mkt from ret_m",
    "lv_m": """select *, case when ret is not null and mkt is not null then ret end as y, case when ret is not null and mkt is not null then mkt end as x from mkt_m""",
    "priced_m": f"""select asset_id, date, t, price, dollar_volume, hard, ret, fwd_ret, {_compound(11, 1)} as momentum, -({_compound(3)}) as reversal,
        case when count(y) over w >= 12 and var_pop(x) over w > 0 then -sqrt(greatest(0, var_pop(y) over w - pow(covar_pop(y, x) over w, 2) / (var_pop(x) over w))) end as low_vol
        from lv_m window w as (partition by asset_id order by t rows between 11 preceding and current row)""",
    "sectors": "select s_suppkey as asset_id, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
}


def _winsorized(source: str, names: list[str], low: float = 0.01, high: float = 0.99, keep: str = "asset_id, date, t, price, fwd_ret") -> str:
    bounds = ", ".join(f"quantile_cont({n}, {low}) as {n}_lo, quantile_cont({n}, {high}) as {n}_hi" for n in names)
    clip = ", ".join(f"case when {n} is null then null else least(greatest({n}, {n}_lo), {n}_hi) end as {n}" for n in names)
    return f"select {keep}, {clip} from {source} join (select date as bound_date, {bounds} from {source} group by date) on date = bound_date"


def _standardized(source: str, names: list[str], keep: str = "asset_id, date, t, price, fwd_ret") -> str:
    z = ", ".join(f"({n} - avg({n}) over (partition by date)) / nullif(stddev_pop({n}) over (partition by date), 0) as {n}" for n in names)
    return f"select {keep}, {z} from {source}"


PRICED = ["momentum", "reversal", "low_vol"]
PARTS |= {
    "year_mkt": "select *, (sum(ret) over (partition by date) - ret) / nullif(count(ret) over (partition by date) - 1, 0) as mkt from ret_w",
    "year_xy": "select *, case when mkt is not null then ret end as y, case when ret is not null then mkt end as x from year_mkt",
    "year_w": """select asset_id, date, case when count(y) over w >= 200 and var_pop(x) over w > 0 then -sqrt(greatest(0, var_pop(y) over w - pow(covar_pop(y, x) over w, 2) / (var_pop(x) over w))) end as low_vol
        from year_xy window w as (partition by asset_id order by t rows between 251 preceding and current row)""",
    "wins_m": _winsorized("priced_m", PRICED),
    "std_m": _standardized("wins_m", PRICED),
    "beta_m": """select *, case when sum(case when ret is not null and m is not null then 1 else 0 end) over w >= 6 and count(m) over w >= 6
        then covar_samp(case when m is not null then ret end, case when ret is not null then m end) over w / nullif(var_samp(m) over w, 0) end as beta
        from (select *, avg(ret) over (partition by date) as m from priced_m) window w as (partition by asset_id order by t rows between 11 preceding and current row)""",
    "quality_w": """select asset_id, date, t, price, coalesce(count(*) over w = 12 and avg((price is not null)::int) over w >= 0.8 and sum(hard::int) over w <= 1, false) as quality_ok
        from clean_w window w as (partition by asset_id order by t rows between 12 preceding and 1 preceding)""",
    "adv_m": """select *, case when count(dollar_volume) over w = 3 then avg(dollar_volume) over w end as adv from grid_m
        window w as (partition by asset_id order by t rows between 3 preceding and 1 preceding)""",
    # universe
    "uni0": f"""select asset_id, date, t, price, ret, coalesce(count(*) over q = 12 and avg((price is not null)::int) over q >= 0.9 and sum(hard::int) over q <= 1, false) as quality_ok,
        ({_compound(11, 1)}) is not null as required_ok, case when count(dollar_volume) over a = 3 then avg(dollar_volume) over a end as adv,
        coalesce(lag(price) over (partition by asset_id order by t) >= 900, false) as floor_ok, -({_compound(3)}) as score
        from ret_m window q as (partition by asset_id order by t rows between 12 preceding and 1 preceding), a as (partition by asset_id order by t rows between 3 preceding and 1 preceding)""",
    "uni1": """select *, price is not null as has_price, adv is not null as liquid, price is not null and adv is not null and floor_ok as base,
        price is not null and adv is not null and floor_ok and quality_ok as good, price is not null and adv is not null and floor_ok and quality_ok and required_ok as complete from uni0""",
    "uni": """select *, good and (select count(*) from uni1 o where o.date = u.date and o.good and (o.adv > u.adv or (o.adv = u.adv and o.asset_id <= u.asset_id))) <= 20 as raw_selected,
        complete and (select count(*) from uni1 o where o.date = u.date and o.complete and (o.adv > u.adv or (o.adv = u.adv and o.asset_id <= u.asset_id))) <= 20 as in_universe from uni1 u""",
    # statements
    "sums": """select l_suppkey as asset_id, last_day(date_trunc('quarter', l_shipdate)::date + interval 2 month)::date as report_date,
        sum(l_extendedprice * (1 - l_discount)) as revenue, sum(l_extendedprice * (0.9 - l_discount)) as gross_profit, sum(l_extendedprice * (0.5 - l_discount - l_tax)) as operating_income,
        sum(l_extendedprice * (0.4 - l_discount - l_tax)) as net_income, sum(l_quantity * 2000.0) as total_assets, sum(l_quantity * l_tax * 10000.0) as total_debt, sum(l_quantity) as shares
        from lineitem group by 1, 2""",
    "stmts": """select *, 1 as ingest_seq from sums union all
        select asset_id, report_date, revenue * 1.01, gross_profit, operating_income, net_income, total_assets, total_debt, shares, 2 from sums where (asset_id + year(report_date)) % 7 = 0""",
    "known": """select * exclude (pub, rn), case isodow(pub) when 5 then pub + 3 when 6 then pub + 2 when 7 then pub + 1 else pub + 1 end as eff_date
        from (select *, report_date + 45 as pub, row_number() over (partition by asset_id, report_date order by ingest_seq desc) as rn from stmts) where rn = 1""",
    "grown": """select *, revenue / lag(revenue, 4) over w - 1 as sales_growth, operating_income / lag(operating_income, 4) over w - 1 as operating_income_growth,
        net_income / lag(net_income, 4) over w - 1 as earnings_growth, total_assets / lag(total_assets, 4) over w - 1 as assets_growth
        from known window w as (partition by asset_id order by eff_date)""",
    "sig": """select g.asset_id, g.date, (k.total_assets - k.total_debt) / nullif(g.price * k.shares, 0) as book_market, k.net_income / nullif(g.price * k.shares, 0) as earnings_yield,
        k.operating_income * 0.8 / nullif(g.price * k.shares, 0) as fcf_yield, k.net_income * 0.3 / nullif(g.price * k.shares, 0) as dividend_yield,
        k.net_income / nullif(k.total_assets, 0) as roa, k.revenue / nullif(k.total_assets, 0) as asset_turnover, k.total_debt / nullif(k.total_assets, 0) as debt_ratio,
        k.gross_profit / nullif(k.revenue, 0) as gross_profit_margin, k.operating_income / nullif(k.revenue, 0) as operating_margin,
        k.assets_growth, k.sales_growth, k.operating_income_growth, k.earnings_growth, g.t
        from grid_m g asof left join grown k on g.asset_id = k.asset_id and g.date >= k.eff_date""",
}
_SIGNALS = ["book_market", "earnings_yield", "fcf_yield", "dividend_yield", "roa", "asset_turnover", "debt_ratio", "gross_profit_margin", "sales_growth", "operating_income_growth", "earnings_growth", "assets_growth"]
PARTS |= {
    "daily": "select asset_id, date, t, " + ", ".join(
        f"last_value({n} ignore nulls) over (partition by asset_id order by t rows between 12 preceding and current row) as {n}" for n in _SIGNALS
    ) + " from sig",
    "comp_w": _winsorized("(select *, -debt_ratio as low_debt from daily)", [*_SIGNALS[:6], "low_debt", *_SIGNALS[7:11]], keep="asset_id, date, t"),
    "comp": _standardized("comp_w", [*_SIGNALS[:6], "low_debt", *_SIGNALS[7:11]], keep="asset_id, date, t"),
    # evaluation
    "mom1": _standardized("wins_m", ["momentum"]),
    "pairs": "select asset_id, date, t, momentum as score, fwd_ret, price from mom1",
}


def _ic(source: str, key: str, least: int = 5) -> str:
    return f"""select {key}, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) as ic, count(*) as n from (
        select {key}, rank() over (partition by {key} order by score) + (count(*) over (partition by {key}, score) - 1) / 2.0 as x,
               rank() over (partition by {key} order by fwd_ret) + (count(*) over (partition by {key}, fwd_ret) - 1) / 2.0 as y
        from {source} where score is not null and fwd_ret is not null) group by {key} having count(*) >= {least} and covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) is not null"""


def _period(source: str) -> str:
    """Forward returns between quarter ends of a panel (asset_id, date, t, price)."""
    return f"""select * from (select asset_id, date, t, case when lead(gone) over w then -1.0 else lead(price) over w / nullif(price, 0) - 1 end as fwd_ret, lead(date) over w as nxt from (
        select asset_id, date, t, price, price is null and t > coalesce(max(case when price is not null then t end) over (partition by asset_id), 0) as gone from {source})
        where date in (select max(date) from {source} group by date_trunc('quarter', date)) window w as (partition by asset_id order by t)) where nxt is not null"""


def _stats(source: str, key: str = "") -> str:
    """Newey-West statistics of (key, date, ic) rows."""
    k, on = (f"{key}, ", f"and a.{key} = b.{key}") if key else ("", "")
    part = f"partition by {key}" if key else ""
    group = f"group by {key}" if key else ""
    base = f"select {k}avg(ic) as mean_ic, stddev_samp(ic) as std_ic, count(*)::bigint as n_obs, greatest(1, least(floor(4 * pow(count(*) / 100.0, 2.0 / 9.0))::bigint, count(*) - 1))::bigint as nw_lag from {source} {group}"
    cen = f"select {'i.' + key + ', ' if key else ''}row_number() over ({part.replace(key, 'i.' + key) if key else ''} order by date) as p, ic - mean_ic as c, n_obs, nw_lag from {source} i {'join base b on i.' + key + ' = b.' + key if key else 'cross join base b'}"
    hac = f"""select {'a.' + key + ', ' if key else ''}sum(case when a.p = b.p then 1.0 else 2.0 * (1.0 - (a.p - b.p) / (a.nw_lag + 1.0)) end * a.c * b.c / a.n_obs) as v
        from cen a join cen b on a.p - b.p between 0 and a.nw_lag {on} {'group by a.' + key if key else ''}"""
    return f"""with base as ({base}), cen as ({cen}), hac as ({hac})
        select {'base.' + key + ', ' if key else ''}mean_ic, std_ic, mean_ic / nullif(std_ic / sqrt(n_obs), 0) as t_naive, mean_ic / nullif(sqrt(v / n_obs), 0) as t_newey_west, n_obs, nw_lag,
        std_ic / sqrt(n_obs) as se, sqrt(v / n_obs) as se_nw from base {'join hac on base.' + key + ' = hac.' + key if key else 'cross join hac'}"""


PARTS |= {
    "ic": _ic("pairs", "date"),
    "ic_st": _stats("ic"),
    "per": _period("pairs"),
    "ic_q": _ic("(select p.asset_id, p.date, p.score, per.fwd_ret from pairs p join per on p.asset_id = per.asset_id and p.date = per.date)", "date"),
}


def _backtest(prefix: str, source: str, key: str, cost: float, borrow: float) -> dict[str, str]:
    """The day-by-day recursion as a recursive query over (key, date number), held weights as two maps would
    be; written instead period by period, by each asset's growth since its period's start."""
    p = prefix
    return {
        f"{p}days": f"select {key}, date, row_number() over (partition by {key} order by date) as dn, date = max(date) over (partition by {key}, date_trunc('quarter', date)) as reb from (select distinct {key}, date from {source})",
        f"{p}per": f"select *, sum(reb::int) over (partition by {key} order by date) as period from {p}days",
        f"{p}rank": f"""select s.{key}, s.asset_id, s.date, period, row_number() over (partition by s.{key}, s.date order by score, asset_id) as place, count(*) over (partition by s.{key}, s.date) as n
            from {source} s join {p}per d on s.{key} = d.{key} and s.date = d.date and reb where score is not null""",
        f"{p}aim": f"""select {key}, asset_id, period, case when place <= k then 'short' else 'long' end as book, 1.0 / (case when place <= k then k else least(k, n - k) end) as aim
            from (select *, greatest(1, floor(n * 0.1))::bigint as k from {p}rank where n >= 2) where place <= k or place > n - least(k, n - k)""",
        f"{p}ret": f"""select {key}, asset_id, date, t, case when fwd_ret is null and t > coalesce(max(case when fwd_ret is not null then t end) over (partition by {key}, asset_id), 0) then -1.0 else coalesce(fwd_ret, 0) end as r from {source}""",
        f"{p}held": f"""select a.{key}, a.asset_id, a.period, a.book, d.date, r, aim * coalesce(product(1 + r) over (partition by a.{key}, a.asset_id, a.period, a.book order by d.date rows between unbounded preceding and 1 preceding), 1) as g
            from {p}aim a join {p}per d on a.{key} = d.{key} and a.period = d.period join {p}ret x on x.{key} = d.{key} and x.asset_id = a.asset_id and x.date = d.date""",
        f"{p}w": f"""select *, coalesce(g / nullif(sum(g) over b, 0), 0) as w, coalesce(g * (1 + r) / nullif(sum(g * (1 + r)) over b, 0), 0) as drifted,
            date = max(date) over (partition by {key}, period) as last from {p}held window b as (partition by {key}, date, book)""",
        f"{p}turn": f"""select coalesce(a.{key}, e.{key}) as {key}, coalesce(a.period, e.period + 1) as period, sum(abs(coalesce(aim, 0) - coalesce(drifted, 0))) as turnover
            from {p}aim a full join (select * from {p}w where last) e on a.{key} = e.{key} and a.asset_id = e.asset_id and a.book = e.book and a.period = e.period + 1 group by 1, 2""",
        f"{p}day": f"""select d.{key}, d.date, case when d.reb then coalesce(t.turnover, 0) end as turnover, coalesce(case when d.reb then t.turnover end, 0) * {cost} as tc,
            coalesce((select sum(w) from {p}w w where w.{key} = d.{key} and w.date = d.date and book = 'short'), 0) * {borrow} / 252.0 as bc,
            coalesce((select sum(case when book = 'long' then w * r else -w * r end) from {p}w w where w.{key} = d.{key} and w.date = d.date), 0) as gross
            from {p}per d left join {p}turn t on d.{key} = t.{key} and d.period = t.period""",
        f"{p}curve": f"select {key}, date, gross - tc - bc as ret, product(1 + gross - tc - bc) over (partition by {key} order by date rows between unbounded preceding and current row) as equity from {p}day",
        f"{p}sum": f"select {key}, avg(turnover) as turnover_mean, avg(tc) * 252 as turnover_cost_drag_ann, avg(bc) * 252 as borrow_cost_drag_ann from {p}day group by {key}",
        f"{p}perf": f"""select {key}, stddev_samp(m) * sqrt(252) as annual_vol, avg(m) / nullif(stddev_samp(m), 0) * sqrt(252) as sharpe, min(dd) as max_drawdown from (
            select {key}, equity / lag(equity) over w - 1 as m, equity / max(equity) over w - 1 as dd from {p}curve window w as (partition by {key} order by date)) group by {key}""",
    }


PARTS |= _backtest("b", "(select 1 as k1, * from pairs)", "k1", 0.001, 0.03)
PARTS |= {
    "train": "select * from std_m where date between '1996-01-01' and '1999-12-31'",
    "train_per": _period("train"),
    "train_long": "unpivot (select asset_id, date, momentum, reversal, low_vol from train) on momentum, reversal, low_vol into name factor value score",
    "train_pairs": "select l.asset_id, l.date, l.factor, l.score, p.fwd_ret from train_long l join train_per p on l.asset_id = p.asset_id and l.date = p.date",
    "train_ic": _ic("train_pairs", "factor, date"),
    "train_st": _stats("train_ic", "factor"),
    "report": """select s.factor, n_obs as train_ic_n_obs, mean_ic as train_ic_mean_spearman, t_newey_west as train_ic_t_nw_spearman,
        avg(case when date <= '1997-12-31' then ic end) as train_ic_mean_first_half, avg(case when date >= '1998-01-01' then ic end) as train_ic_mean_second_half
        from train_st s join train_ic i on s.factor = i.factor group by 1, 2, 3, 4""",
    "val": "select *, case when momentum is not null and (momentum is not null)::int + (reversal is not null)::int >= 2 then (momentum + reversal) / 2 end as mixed from std_m where date between '1997-01-01' and '2000-12-31'",
    "val_long": """select asset_id, date, t, price, fwd_ret, unnest(['momentum', 'reversal', 'both']) as construct, unnest([momentum, reversal, mixed]) as score from val""",
    "val_per": _period("(select asset_id, date, t, price from val)"),
    "val_ic": _ic("(select l.asset_id, l.date, l.construct, l.score, p.fwd_ret from val_long l join val_per p on l.asset_id = p.asset_id and l.date = p.date)", "construct, date"),
    "val_st": _stats("val_ic", "construct"),
}
PARTS |= _backtest("n", "val_long", "construct", 0.001, 0.03)
PARTS |= _backtest("g", "val_long", "construct", 0.0, 0.0)
PARTS |= {
    "rp": _period("(select asset_id, date, t, price from std_m where date in (select date from std_m))"),
    "rrows": "select s.asset_id, s.date, momentum, reversal, low_vol, p.fwd_ret as target from std_m s join rp p on s.asset_id = p.asset_id and s.date = p.date",
    "rgate": "select *, target is not null and (momentum is not null)::int + (reversal is not null)::int + (low_vol is not null)::int >= 3 as ok from rrows",
    # two cleaning passes of the weekly panel
    "tp1": "select asset_id, date, price, dollar_volume from clean_w where asset_id in (select asset_id from clean_w where price is not null)",
    "tp_cal": "select date, row_number() over (order by date) as t from (select date from tp1 group by date having count(price) >= 8)",
    "tp2": "select p.asset_id, p.date, c.t, p.price, p.price / lag(p.price) over (partition by asset_id order by c.t) - 1 as r from tp1 p join tp_cal c on p.date = c.date",
    "tp3": "select asset_id, date, t, coalesce(r >= 10 or r < -1, false) as hard, case when not coalesce(r >= 10 or r < -1, false) then price end as price from tp2",
}


def sql(query: str) -> str:
    """`query` with the parts that it needs, each before its users."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in PARTS:
            if name not in order and re.search(rf"\b(from|join)\s+\(*{name}\b", text) or name not in order and re.search(rf"\bin \(select \w+ from {name}\b", text):
                need(PARTS[name])
                if name not in order:
                    order.append(name)

    need(query)
    return "with " + ",\n".join(f"{n} as ({PARTS[n]})" for n in order) + "\n" + query if order else query


def r6(*names: str, of: str = "") -> str:
    return ", ".join(f"round({of}{n}, 6) + 0.0 as {n}" for n in names)


def cells(part: str, *names: str, where: str = "true") -> str:
    return f"select asset_id, date, {r6(*names)} from {part} where {where}"


def _flags(flag: str) -> str:
    moves = ", ".join(f"abs(lead(price, {k}) over w / price - 1)" for k in range(1, 6))
    return f"""with f as (select *, lead(r) over w as nr, [x for x in [{moves}] if x is not null] as mv,
          coalesce(sum(case when abs(r) <= 0.05 then 1 else 0 end) over (partition by asset_id order by t rows between 2 preceding and 1 preceding) >= 2, false) as stale from hard_w window w as (partition by asset_id order by t)),
        g as (select asset_id, date, coalesce(r > 0.5 and not hard, false) as candidate, coalesce(r > 0 and nr < 0 and abs(nr) >= 0.3 and abs((1 + r) * (1 + nr) - 1) <= 0.3, false) as spike,
          coalesce(list_median(mv) <= 0.2, false) as shift, stale from f)
        select asset_id, date, {flag}, spike or shift or stale as suspect from g where candidate"""


def _inner(query: str) -> str:
    """A query with its own WITH, its parts put first."""
    body = sql(query.removeprefix("with "))
    if not body.startswith("with "):
        return query
    cut = body.index(query.removeprefix("with "))
    return body[:cut].rstrip() + ",\n" + body[cut:]


def _style(parts: list[str], least: int) -> str:
    n = " + ".join(f"({p} is not null)::int" for p in parts)
    total = " + ".join(f"coalesce({p}, 0)" for p in parts)
    return f"case when {n} >= {least} then ({total}) / nullif({n}, 0) end"


_DIRTY = "case when asset_id % 11 = 0 then null when asset_id % 7 = 0 then null when asset_id % 5 = 0 then null else price end"

def _ridge(alphas: tuple[float, ...], window: int = 12, least: int = 6, refit: int = 2, rows: int = 50) -> dict[str, str]:
    """Walk-forward ridge on three factors: moments of the gated rows by date, summed over the dates before, and the
    system of three equations by Cramer's rule."""
    x = PRICED
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = [("n", "1"), ("sy", "target"), *((f"sx{i}", x[i]) for i in range(3)), *((f"sxy{i}", f"{x[i]} * target") for i in range(3)), *((f"sxx{i}{j}", f"{x[i]} * {x[j]}") for i, j in pairs)]
    by_date = ", ".join(f"coalesce(sum(case when ok then {e} end), 0)::double as {n}" for n, e in sums)
    over = ", ".join(f"sum({n}) over w as {n}" for n, _ in sums)
    spread = ", ".join(f"case when sxx{i}{i} - sx{i} * sx{i} / n > 0 then sqrt((sxx{i}{i} - sx{i} * sx{i} / n) / n) else 1 end as d{i}" for i in range(3))
    cells = ", ".join(f"(sxx{i}{j} - sx{i} * sx{j} / n) / (d{i} * d{j}){' + alpha' if i == j else ''} as a{i}{j}" for i, j in pairs)
    right = ", ".join(f"(sxy{i} - sx{i} * sy / n) / d{i} as r{i}" for i in range(3))

    def det(columns: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, i) = ([columns[k][r] for k in range(3)] for r in range(3))
        return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    matrix = [[f"a{min(r, k)}{max(r, k)}" for r in range(3)] for k in range(3)]
    solved = ", ".join(f"{det([['r0', 'r1', 'r2'] if k == i else matrix[k] for k in range(3)])} / {det(matrix)} / d{i} as c{i}" for i in range(3))
    score = " + ".join(["sy / n", *(f"c{i} * ({x[i]} - sx{i} / n)" for i in range(3))])
    return {
        "rmom": f"select date, row_number() over (order by date) - 1 as step, {by_date} from rgate group by date",
        "rspan": f"select step, {over} from rmom window w as (order by step rows between {window} preceding and 1 preceding)",
        "rbegin": f"select min(step) as begun from rspan where step >= {least} and n >= {rows}",
        "rsys": f"select *, {cells}, {right} from (select *, {spread} from rspan cross join (select unnest({list(alphas)}::double[]) as alpha) cross join rbegin where step >= begun and (step - begun) % {refit} = 0)",
        "rfit": f"select *, {solved} from rsys",
        "rpred": f"""select f.alpha, asset_id, g.date, target as fwd_ret, case when {' and '.join(f'{c} is not null' for c in x)} then {score} end as score
        from (select date as on_date, step as at_step from rmom) m cross join rbegin join rfit f on f.step = at_step - (at_step - rbegin.begun) % {refit} and at_step >= rbegin.begun join rgate g on g.date = on_date""",
    }


PARTS |= _ridge((0.1, 10.0, 1000.0))
PARTS["ric"] = _ic("(select * from rpred where date < '2000-01-01')", "alpha, date")


# the whole run: two cleaning passes of the monthly panel, seven factors, composite, universe, evaluation
_SEVEN = [*PRICED, "value", "quality", "invest", "growth"]
_PART_NAMES = [*_SIGNALS[:6], "low_debt", *_SIGNALS[7:11]]
_THERE = lambda names: " + ".join(f"({n} is not null)::int" for n in names)
_TOTAL = lambda names: " + ".join(f"coalesce({n}, 0)" for n in names)
PARTS |= {
    "rc1": "select asset_id, date, price, dollar_volume from clean_m where asset_id in (select asset_id from clean_m where price is not null)",
    "rc_cal": "select date, row_number() over (order by date) as t from (select date from rc1 group by date having count(price) >= 5)",
    "rc2": "select p.asset_id, p.date, c.t, p.price, p.dollar_volume, p.price / lag(p.price) over (partition by asset_id order by c.t) - 1 as r from rc1 p join rc_cal c on p.date = c.date",
    "rc3": "select asset_id, date, t, dollar_volume, coalesce(r >= 10 or r < -1, false) as hard, case when not coalesce(r >= 10 or r < -1, false) then price end as price from rc2",
    "rc4": """select *, coalesce(count(*) over w = 12 and avg((price is not null)::int) over w >= 0.95 and sum(hard::int) over w <= 3, false) as quality_ok, count(price) over (partition by asset_id) as n_prices
        from rc3 window w as (partition by asset_id order by t rows between 12 preceding and 1 preceding)""",
    "rc": """select asset_id, date, t, price, dollar_volume, quality_ok, price / lag(price) over w - 1 as ret, lead(price) over w / price - 1 as fwd_ret
        from rc4 where n_prices > 0 window w as (partition by asset_id order by t)""",
    "rc_mkt": "select *, (sum(ret) over (partition by date) - ret) / nullif(count(ret) over (partition by date) - 1, 0) as mkt from rc",
    "rc_xy": "select *, case when mkt is not null then ret end as y, case when ret is not null then mkt end as x from rc_mkt",
    "rc_price": f"""select asset_id, date, {_compound(11, 1)} as momentum, -({_compound(3)}) as reversal,
        case when count(y) over w >= 12 and var_pop(x) over w > 0 then -sqrt(greatest(0, var_pop(y) over w - pow(covar_pop(y, x) over w, 2) / (var_pop(x) over w))) end as low_vol
        from rc_xy window w as (partition by asset_id order by t rows between 11 preceding and current row)""",
    "rc_daily": "select r.asset_id, r.date, r.t, " + ", ".join(
        f"last_value({n} ignore nulls) over (partition by r.asset_id order by r.t rows between 12 preceding and current row) as {n}" for n in _SIGNALS
    ) + " from rc r left join sig s on r.asset_id = s.asset_id and r.date = s.date",
    "rc_parts": _standardized(f"({_winsorized('(select *, -debt_ratio as low_debt from rc_daily)', _PART_NAMES, keep='asset_id, date, t, assets_growth')})", _PART_NAMES, keep="asset_id, date, t, assets_growth"),
    "rc_fund": f"""select asset_id, date, {_style(_SIGNALS[:4], 2)} as value, {_style(['roa', 'gross_profit_margin', 'asset_turnover', 'low_debt'], 3)} as quality, -assets_growth as invest,
        {_style(['sales_growth', 'operating_income_growth', 'earnings_growth'], 2)} as growth from rc_parts""",
    "rc_all": f"""select r.*, {', '.join(f'p.{n}' for n in PRICED)}, {', '.join(f'f.{n}' for n in _SEVEN[3:])} from rc r
        left join rc_price p on r.asset_id = p.asset_id and r.date = p.date left join rc_fund f on r.asset_id = f.asset_id and r.date = f.date
        where r.date in (select date from rc where fwd_ret is not null)""",
    "rc_wins": _winsorized("rc_all", _SEVEN, keep="asset_id, date, t, price, dollar_volume, quality_ok, fwd_ret"),
    "rc_std": _standardized("rc_wins", _SEVEN, keep="asset_id, date, t, price, dollar_volume, quality_ok, fwd_ret"),
    "rc_score": f"""select *, case when momentum is not null and {_THERE(_SEVEN)} >= 5 and {_THERE(PRICED)} >= 2 and {_THERE(_SEVEN[3:])} >= 2 then ({_TOTAL(_SEVEN)}) / ({_THERE(_SEVEN)}) end as composite from rc_std""",
    "rc_uni": """select *, coalesce(price is not null and adv is not null and floor_ok and quality_ok and composite is not null, false) as complete from (
        select *, case when count(dollar_volume) over w = 3 then avg(dollar_volume) over w end as adv, coalesce(lag(price) over (partition by asset_id order by t) >= 1, false) as floor_ok
        from rc_score window w as (partition by asset_id order by t rows between 3 preceding and 1 preceding))""",
    "rc_core": "select *, complete and row_number() over (partition by date, complete order by adv desc, asset_id) <= 60 as tradable from rc_uni",
    "rc_panel": "select asset_id, date, t, price, fwd_ret, case when tradable then composite end as score from rc_core",
    "rc_per": _period("(select asset_id, date, t, price from rc_panel)"),
    "rc_ic": _ic("(select p.asset_id, p.date, p.score, n.fwd_ret from rc_panel p join rc_per n on p.asset_id = n.asset_id and p.date = n.date)", "date"),
    "rc_st": _stats("rc_ic"),
    "rc_bars": _ic("rc_panel", "date"),
    "qc_before": "select 'raw' as scope, price, r from raw_w",
    "qc_after": "select 'tradable' as scope, price, ret as r from ret_w",
    "qc_prices": "select scope, count(price)::double as observed_prices, min(r) as ret_min, quantile_cont(r, 0.01) as ret_p01, quantile_cont(r, 0.99) as ret_p99, quantile_cont(r, 0.999) as ret_p999, max(r) as ret_max from (select * from qc_before union all select * from qc_after) group by scope",
    "qc_gone": "select count(*) filter (hard)::double as removed_prices, count(distinct case when hard then asset_id end)::double as assets_affected, count(*) filter (hard) / count(price) as removed_frac from hard_w",
}
PARTS |= _backtest("u", "(select 1 as k1, * from rc_panel)", "k1", 0.001, 0.03)


_QUERIES: dict[str, str] = {
    "sql_over_views": f"select date, {r6('ic')}, n from rc_bars",
    "research_core": f"select asset_id, date, round(composite, 6) + 0.0 as score, {r6('fwd_ret')} from rc_core where tradable",
    "research_run": f"select {r6('mean_ic', 't_newey_west')}, n_obs, {r6('annual_vol', 'sharpe', 'max_drawdown')} from rc_st cross join uperf",
    "bars_month": cells("bars_m", "price", "dollar_volume"),
    "bars_week": cells("bars_w", "price", "dollar_volume"),
    "dense_panel": f"select asset_id, date, t, {r6('price')} from grid_w",
    "sanitize_prices": f"select asset_id, date, round({_DIRTY}, 6) + 0.0 as price from bars_m",
    "clean_hard_events": f"select asset_id, date, hard, {r6('price')} from clean_w",
    "sparse_date_filter": "select date, row_number() over (order by date) as t, n_prices from (select date, count(price) as n_prices from grid_w group by date having count(price) >= 8)",
    "drop_empty_assets": "select asset_id, count(price) as n_prices from grid_m where asset_id % 3 <> 0 group by asset_id having count(price) > 0",
    "quality_mask": "select asset_id, date, quality_ok from quality_w",
    "two_pass_clean": f"""select asset_id, date, t, {r6('price')}, quality_ok from (select *, count(price) over (partition by asset_id) as alive,
        coalesce(count(*) over w = 12 and avg((price is not null)::int) over w >= 0.8 and sum(hard::int) over w <= 1, false) as quality_ok
        from tp3 window w as (partition by asset_id order by t rows between 12 preceding and 1 preceding)) where alive > 0""",
    "returns": cells("ret_m", "ret"),
    "future_returns": cells("ret_m", "fwd_ret", where="date in (select date from ret_m where fwd_ret is not null)"),
    "rolling_compound": f"select asset_id, date, round({_compound(6)}, 6) + 0.0 as compounded from ret_m",
    "windows_by_blocks": f"select asset_id, date, {r6('ret', 'momentum', 'reversal', 'adv')} from (select *, case when count(dollar_volume) over w = 3 then avg(dollar_volume) over w end as adv from priced_m window w as (partition by asset_id order by t rows between 3 preceding and 1 preceding))",
    "momentum": cells("priced_m", "momentum"),
    "reversal": cells("priced_m", "reversal"),
    "loo_market": cells("mkt_m", "mkt"),
    "low_vol": cells("priced_m", "low_vol"),
    "low_vol_year": cells("year_w", "low_vol"),
    "adv": cells("adv_m", "adv"),
    "refreshed": f"""select asset_id, date, t, hard, quality_ok, {r6('price')}, {r6('momentum')}, {r6('adv')} from (
        select asset_id, date, t, hard, price, {_compound(11, 1)} as momentum, case when count(dollar_volume) over a = 3 then avg(dollar_volume) over a end as adv,
        coalesce(count(*) over q = 12 and avg((price is not null)::int) over q >= 0.8 and sum(hard::int) over q <= 1, false) as quality_ok
        from ret_m window q as (partition by asset_id order by t rows between 12 preceding and 1 preceding), a as (partition by asset_id order by t rows between 3 preceding and 1 preceding)
        ) where price is not null""",
    "terminal_missing": """select asset_id, count(*) as n_terminal, min(date) as since from (select *, coalesce(max(case when fwd_ret is not null then t end) over (partition by asset_id), 0) as last from ret_w)
        where fwd_ret is null and t > last group by asset_id""",
    "rebalance_me": "select max(date) as date from bars_d group by date_trunc('month', date)",
    "rebalance_wfri": "select max(date) as date from bars_d group by date_trunc('week', date + interval 2 day)",
    "period_forward_returns": f"""select asset_id, date, {r6('fwd_ret')} from (select asset_id, date, case when lead(gone) over w then -1.0 else lead(price) over w / price - 1 end as fwd_ret, lead(date) over w as nxt from (
        select asset_id, date, t, price, price is null and t > coalesce(max(case when price is not null then t end) over (partition by asset_id), 0) as gone from clean_w)
        where date in (select max(date) from cal_w group by date_trunc('month', date)) window w as (partition by asset_id order by t)) where nxt is not null""",
    "winsorize": f"select asset_id, date, {r6(*PRICED)} from (" + _winsorized("priced_m", PRICED, 0.05, 0.95) + ")",
    "zscore": f"select asset_id, date, {r6(*PRICED)} from (" + _standardized("priced_m", PRICED) + ")",
    "component_mean": f"select asset_id, date, round({_style(PRICED, 2)}, 6) + 0.0 as mean from priced_m",
    "sector_map": "select asset_id, case when asset_id % 4 <> 0 then sector else 'Unknown' end as sector from sectors",
    "sector_neutral": "select p.asset_id, p.date, " + ", ".join(f"round({n} - avg({n}) over (partition by date, sector), 6) + 0.0 as {n}" for n in PRICED) + " from priced_m p join sectors s on p.asset_id = s.asset_id",
    "rolling_beta": cells("beta_m", "beta"),
    "market_neutral": "select asset_id, date, " + ", ".join(
        f"""round(case when {n} is not null and beta is not null and count(case when beta is not null then {n} end) over d >= 2 then {n} - avg(case when beta is not null then {n} end) over d
        - coalesce(covar_pop(case when {n} is not null then beta end, case when beta is not null then {n} end) over d / nullif(var_pop(case when {n} is not null then beta end) over d, 0)
        * (beta - avg(case when {n} is not null then beta end) over d), 0) end, 6) + 0.0 as {n}""" for n in PRICED
    ) + " from beta_m window d as (partition by date)",
    "composite_ew": f"select asset_id, date, round({_style(PRICED, 3)}, 6) + 0.0 as composite from std_m",
    "composite_candidate": f"select asset_id, date, round(case when reversal is not null then {_style(['reversal', 'momentum', 'low_vol'], 2)} end, 6) + 0.0 as composite from std_m",
    "universe_mask": f"select asset_id, date, in_universe, raw_selected, {r6('adv')} from uni",
    "universe_diagnostics": """select date, count(*) filter (raw_selected) as raw_selected_count, count(*) filter (has_price and not liquid) as liquidity_excluded_count,
        count(*) filter (has_price and liquid and not floor_ok) as price_floor_excluded_count, count(*) filter (base and not good) as quality_excluded_count,
        count(*) filter (complete and not in_universe) as cap_excluded_count, count(*) filter (good and not complete) as data_completeness_excluded_count from uni group by date""",
    "tradable_scores": cells("uni", "score", where="in_universe and score is not null"),
    "publish_align": f"select asset_id, eff_date::date as eff_date, ingest_seq::bigint as ingest_seq, {r6('revenue')} from known",
    "dedupe_keep_last": f"""select asset_id, report_date as date, ingest_seq::bigint as ingest_seq, {r6('revenue')} from known where asset_id in (select asset_id from sectors where sector <> 'ASIA')""",
    "asof_signals": f"select g.asset_id, g.date, {r6('revenue', 'net_income')} from grid_m g asof left join known k on g.asset_id = k.asset_id and g.date >= k.eff_date",
    "asof_by_blocks": f"select g.asset_id, g.date, {r6('revenue', 'net_income')} from grid_m g asof left join known k on g.asset_id = k.asset_id and g.date >= k.eff_date",
    "daily_signal_ffill": """select asset_id, date, round(last_value(x ignore nulls) over (partition by asset_id order by t rows between 10 preceding and current row), 6) + 0.0 as roa
        from (select *, case when month(date) in (1, 7) then price end as x from grid_w)""",
    "growth_yoy": f"select asset_id, eff_date::date as eff_date, {r6('sales_growth')} from grown",
    "signals_all": cells("sig", "book_market", "earnings_yield", "roa", "asset_turnover", "debt_ratio", "operating_margin", "assets_growth", "sales_growth"),
    "value_factor": f"select asset_id, date, round({_style(_SIGNALS[:4], 2)}, 6) + 0.0 as value from comp",
    "quality_factor": f"select asset_id, date, round({_style(['roa', 'gross_profit_margin', 'asset_turnover', 'low_debt'], 3)}, 6) + 0.0 as quality from comp",
    "invest_factor": "select asset_id, date, round(-assets_growth, 6) + 0.0 as invest from daily",
    "growth_factor": f"select asset_id, date, round({_style(['sales_growth', 'operating_income_growth', 'earnings_growth'], 2)}, 6) + 0.0 as growth from comp",
    "align_left": """select asset_id, date, round(ret, 6) + 0.0 as ret, round(case when ret is not null then price end, 6) + 0.0 as x from ret_m
        where date in (select date from ret_m where ret is not null)""",
    "align_outer": "select asset_id, date, round(ret, 6) + 0.0 as ret, round(fwd_ret, 6) + 0.0 as fwd_ret from ret_m where ret is not null or fwd_ret is not null",
    "mask_reindex": "select asset_id, date, coalesce(ret > 0, false) as rose from ret_m",
    "ic_momentum": f"select date, {r6('ic')}, n from ic",
    "ic_period": f"select date, {r6('ic')}, n from ic_q",
    "ic_stats": """select round(mean_ic, 6) as mean_ic, round(std_ic, 6) as std_ic, round(t_naive, 6) as t_naive, round(t_newey_west, 6) as t_newey_west, n_obs, nw_lag,
        round(mean_ic - 1.96 * se, 6) as ci95_naive_low, round(mean_ic + 1.96 * se, 6) as ci95_naive_high, round(mean_ic - 1.96 * se_nw, 6) as ci95_nw_low, round(mean_ic + 1.96 * se_nw, 6) as ci95_nw_high from ic_st""",
    "ic_acf": """select k as lag, round(covar_pop(ic, b) / (stddev_pop(ic) * stddev_pop(b)), 6) + 0.0 as acf from (
        select a.ic, b.ic as b, a.p - b.p as k from (select ic, row_number() over (order by date) as p from ic) a join (select ic, row_number() over (order by date) as p from ic) b on a.p - b.p between 1 and 5) group by k""",
    "ic_coverage": """select count(*) filter (n < 90) as n_dates_below_min, round(quantile_cont(n / nullif(nb, 0), 0.1), 6) as coverage_p10 from (
        select date, count(*) filter (score is not null and fwd_ret is not null) as n, count(price) as nb from pairs group by date)""",
    "decile_weights": """select asset_id, date, case when place <= k then 'short' else 'long' end as book, round(1.0 / case when place <= k then k else least(k, n - k) end, 6) as weight from (
        select *, greatest(1, floor(n * 0.1))::bigint as k from (select asset_id, date, row_number() over (partition by date order by score, asset_id) as place, count(*) over (partition by date) as n from pairs where score is not null) where n >= 2)
        where place <= k or place > n - least(k, n - k)""",
    "backtest_equity": f"select date, {r6('ret', 'equity')} from bcurve",
    "equity_by_blocks": f"select date, {r6('equity', 'peak')} from (select date, equity, max(equity) over (order by date) as peak from bcurve)",
    "backtest_summary": f"select {r6('turnover_mean', 'turnover_cost_drag_ann', 'borrow_cost_drag_ann')} from bsum",
    "performance_stats": f"select {r6('annual_vol', 'sharpe', 'max_drawdown')} from bperf",
    "price_qc": """select 'raw' as scope, count(price) as n_observed_prices, round(min(r), 6) as ret_min, round(quantile_cont(r, 0.01), 6) as ret_p01, round(quantile_cont(r, 0.99), 6) as ret_p99,
        round(quantile_cont(r, 0.999), 6) as ret_p999, round(max(r), 6) as ret_max from raw_w""",
    "removed_prices": "select count(*) filter (hard) as removed_prices, count(distinct case when hard then asset_id end) as assets_affected, round(count(*) filter (hard) / count(price), 6) as removed_frac from hard_w",
    "factor_qc": """select factor, round(avg(nn), 6) as non_null_frac, round(any_value(dp), 6) as date_coverage_p50, round(any_value(sp), 6) as stock_coverage_p50, round(quantile_cont(v, 0.01), 6) as value_p01, round(quantile_cont(v, 0.99), 6) as value_p99 from (
        select *, (v is not null)::int as nn from (select asset_id, date, unnest(['momentum', 'reversal', 'low_vol']) as factor, unnest([momentum, reversal, low_vol]) as v from priced_m where price is not null and t > 6)) x
        join (select factor as f1, quantile_cont(s, 0.5) as dp from (select factor, date, count(v) / count(*) as s from (select date, unnest(['momentum', 'reversal', 'low_vol']) as factor, unnest([momentum, reversal, low_vol]) as v from priced_m where price is not null and t > 6) group by 1, 2) group by 1) on f1 = factor
        join (select factor as f2, quantile_cont(s, 0.5) as sp from (select factor, asset_id, count(v) / count(*) as s from (select asset_id, unnest(['momentum', 'reversal', 'low_vol']) as factor, unnest([momentum, reversal, low_vol]) as v from priced_m where price is not null and t > 6) group by 1, 2) group by 1) on f2 = factor group by factor""",
    "factor_report": f"select factor, train_ic_n_obs, {r6('train_ic_mean_spearman', 'train_ic_t_nw_spearman', 'train_ic_mean_first_half', 'train_ic_mean_second_half')} from report",
    "stable_negative_screen": "select factor from report where not (coalesce(train_ic_mean_spearman < 0, false) and coalesce(train_ic_mean_first_half < 0, false) and coalesce(train_ic_mean_second_half < 0, false))",
    "validation_matrix": """select s.construct, round(mean_ic, 6) + 0.0 as mean_ic, round(t_newey_west, 6) + 0.0 as t_ic_newey_west, round(g.sharpe, 6) + 0.0 as sharpe_gross, round(n.sharpe, 6) + 0.0 as sharpe_net, round(n.max_drawdown, 6) + 0.0 as max_drawdown_net,
        round(turnover_mean, 6) + 0.0 as turnover_mean, round(turnover_cost_drag_ann, 6) + 0.0 as turnover_cost_drag_ann, round(borrow_cost_drag_ann, 6) + 0.0 as borrow_cost_drag_ann
        from val_st s join nperf n on s.construct = n.construct join gperf g on s.construct = g.construct join nsum c on s.construct = c.construct""",
    "ridge_moments": """select date, count(*) filter (ok) as n, round(coalesce(sum(case when ok then target end), 0), 6) + 0.0 as sy, round(coalesce(sum(case when ok then momentum end), 0), 6) + 0.0 as sx_0,
        round(coalesce(sum(case when ok then momentum * target end), 0), 6) + 0.0 as sxy_0, round(coalesce(sum(case when ok then momentum * momentum end), 0), 6) + 0.0 as sxx_0_0,
        round(coalesce(sum(case when ok then momentum * reversal end), 0), 6) + 0.0 as sxx_0_1, round(coalesce(sum(case when ok then reversal * low_vol end), 0), 6) + 0.0 as sxx_1_2 from rgate group by date""",
    "ridge_scores": "select asset_id, date, round(score, 6) + 0.0 as score from rpred where alpha = 10",
    "ridge_alpha_table": "select alpha, round(avg(ic), 6) + 0.0 as pre_mean_ic, count(ic) as pre_n_obs from ric group by alpha",
    "event_bars": "select user_id as asset_id, ts::date as date, round(sum(value * 1.0) / sum(1.0), 6) + 0.0 as vwap, round(sum(1.0::double), 6) as volume, count(*) as n from events group by 1, 2",
    "renumbered": "select date, row_number() over (order by date) as t from (select distinct date from bars_m) where month(date) <> 2",
}

ORACLES: dict[str, str] = {k: sql(v) for k, v in _QUERIES.items()}
ORACLES |= {f"suspect_{name}": _inner(_flags(flag)) for name, flag in (("spike_reversal", "spike"), ("persistent_shift", "shift"), ("stale_jump", "stale"))}
ORACLES["clean_summary"] = _inner(
    _flags("spike").replace("0.05 then", "1e-12 then").replace("2 preceding and 1 preceding) >= 2", "5 preceding and 1 preceding) >= 5").replace("r > 0.5", "r > 3").replace("abs(nr) >= 0.3", "abs(nr) >= 0.6").replace("- 1) <= 0.3", "- 1) <= 0.2").split("\n        select asset_id, date, spike")[0]
    + """
        select count(*) as n_classify_candidates, count(*) filter (spike) as n_spike_reversal, count(*) filter (shift) as n_persistent_shift, count(*) filter (stale) as n_stale_jump,
        count(*) filter (spike or shift or stale) as n_suspect_events, count(distinct case when spike or shift or stale then asset_id end) as n_assets_with_any_suspect_event from g where candidate"""
)
_TAILS = ["ret_min", "ret_p01", "ret_p99", "ret_p999", "ret_max"]
ORACLES["qc_display"] = f"""
select * from ({sql("select 'overview' as view, scope, 'observed_prices' as name, observed_prices as value from qc_prices")})
union all select 'tails', scope, unnest({_TAILS}), round(unnest([{', '.join(_TAILS)}]), 6) + 0.0 from ({sql('select * from qc_prices')})
union all select 'cleaning_impact', null, unnest(['removed_prices', 'assets_affected', 'removed_frac']), round(unnest([removed_prices, assets_affected, removed_frac]), 6) + 0.0 from ({sql('select * from qc_gone')})
union all select 'suspect_event_qa', null, name, value::double from (unpivot ({ORACLES['clean_summary']}) on columns(*) into name name value value)"""
ORACLES["business_days"] = sql(
    "select date, " + ", ".join(f"list_filter([date + i::int for i in range(1, 15)], lambda y: isodow(y) <= 5)[{n}]::date as plus_{n}" for n in (1, 2, 7))
    + " from (select distinct date from bars_d)"
)
