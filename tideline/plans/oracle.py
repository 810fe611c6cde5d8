"""SQL equivalents of the registered queries, for an independent engine.

Shared pieces are common table expressions; :func:`sql` adds those a statement needs.
"""

from __future__ import annotations

import re

ORACLE: dict[str, str] = {}
CTE: dict[str, str] = {}


def sql(name: str, body: str, rounds: str = "") -> None:
    """Register ``body``; ``rounds`` lists the double columns to round at the edge."""
    if rounds:
        body = f"SELECT * REPLACE ({', '.join(f'CASE WHEN abs({c}) < 9007199254.740992e0 THEN floor({c} * 1e6 + 0.5001e0) / 1e6 ELSE {c} END AS {c}' for c in rounds.split())}) FROM ({body})"
    ORACLE[name] = with_ctes(body)


def with_ctes(body: str) -> str:
    used: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(CTE[name])
                if name not in used:
                    used.append(name)

    visit(body)
    return body if not used else "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in used) + "\n" + body


def days(a: str, b: str) -> str:
    return f"(epoch_us({a}) - epoch_us({b})) / 86400e6"


def uniform(*parts: str) -> str:
    text = " || ':' || ".join(p if not p.isidentifier() or p in ("id", "replicate", "rep", "seed", "o_orderkey", "doc_id") else f"'{p}'" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496e0)"


CTE["x_ix"] = "SELECT o_custkey AS id, min(o_orderdate) AS ix FROM orders GROUP BY 1"
CTE["x_od"] = f"SELECT o_custkey AS id, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, {days('o_orderdate', 'ix')} AS t FROM orders JOIN x_ix ON x_ix.id = o_custkey"
CTE["x_sp"] = f"""SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS acctbal,
  CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 7000 THEN 'mid' ELSE 'high' END AS balance,
  n_name AS nation, r_name AS region, {days("TIMESTAMP '2001-08-01'", 'ix')} AS study_end,
  CASE WHEN c_acctbal < 0 THEN (1000 + c_custkey % 1000)::DOUBLE END AS death
  FROM customer JOIN x_ix ON x_ix.id = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""
CTE["x_u"] = """SELECT id, o_orderkey, t, CASE WHEN o_totalprice > 250000 THEN 'major' END AS indicator,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS kind FROM x_od
  WHERE o_orderpriority = '1-URGENT' AND t > 0 AND o_orderstatus IN ('F', 'O', 'P')"""
CTE["x_log"] = "SELECT x_u.id, o_orderkey, t, kind, CASE WHEN indicator = 'major' THEN 'major' ELSE 'minor' END AS subtype, study_end FROM x_u JOIN x_sp USING (id) WHERE t <= study_end"
CTE["x_flags"] = """SELECT id, o_orderkey, t, kind, subtype, row_number() OVER (PARTITION BY id ORDER BY t, o_orderkey) = 1 AS first,
  count(*) OVER p AS n, count(*) FILTER (subtype = 'major') OVER p AS "n_major", count(*) FILTER (subtype = 'minor') OVER p AS "n_minor",
  bool_or(subtype = 'major') OVER p AND bool_or(subtype = 'minor') OVER p AS all_kinds FROM x_log WINDOW p AS (PARTITION BY id)"""
CTE["x_sw"] = "SELECT id, min(t) AS switch_t FROM x_od WHERE o_orderpriority = '2-HIGH' AND t > 0 GROUP BY id"
CTE["x_m"] = f"""SELECT o_custkey AS id, l_returnflag || l_linestatus AS measure, {days('l_shipdate', 'ix')} AS t, l_extendedprice AS value,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN x_ix ON x_ix.id = o_custkey"""
CTE["x_em"] = f"SELECT e.user_id AS id, event_type AS measure, {days('ts', 'f.ft')} AS t, value, event_id FROM events e JOIN (SELECT user_id, min(ts) AS ft FROM events GROUP BY 1) f USING (user_id)"
CTE["x_lab"] = "SELECT id, count(*) FILTER (t <= 365.25) AS n_prior, min(t) FILTER (t > 545.25) AS event_t, min(t) FILTER (t > 545.25) IS NOT NULL AS event FROM x_log GROUP BY id"
CTE["x_labs"] = "SELECT id, count(*) FILTER (t <= 180) AS n_prior, min(t) FILTER (t > 180) AS event_t, min(t) FILTER (t > 180) IS NOT NULL AS event FROM x_log GROUP BY id"
for _n, _l in (("x_le", "x_lab"), ("x_les", "x_labs")):
    CTE[_n] = f"""SELECT s.*, n_prior, event_t, event, switch_t, least(death, study_end) AS censor, least(death, study_end, event_t) AS landmark0
      FROM x_sp s LEFT JOIN {_l} USING (id) LEFT JOIN x_sw USING (id)"""
CTE["x_rl"] = f"""SELECT *, u1 * 180 AS jitter,
  CASE WHEN event THEN landmark0 WHEN landmark0 >= 545.25 THEN 545.25 + (landmark0 - 545.25) * u2 END + u1 * 180 AS landmark
  FROM (SELECT *, {uniform("'11'", 'jitter', 'id')} AS u1, {uniform("'11'", 'landmark', 'id')} AS u2 FROM x_le)"""
CTE["x_ss0"] = """SELECT * REPLACE (CASE WHEN switch = 0 THEN NULL ELSE switch_t END AS switch_t) FROM (
  SELECT *, CASE WHEN switch_t <= landmark - 180 THEN 1e0 WHEN switch_t <= landmark THEN NULL ELSE 0e0 END AS switch FROM x_rl)"""
CTE["x_ss"] = "SELECT * REPLACE (coalesce(switch, 0) AS switch) FROM x_ss0"
CTE["x_mc"] = """SELECT s.id, segment, acctbal, balance, nation, region, study_end, death, landmark, switch, coalesce(l.n_prior, 0) AS n_prior,
  CASE WHEN l.event THEN 1e0 ELSE 0e0 END AS event, least(death, study_end) AS censor
  FROM x_ss s LEFT JOIN x_lab l USING (id) WHERE least(death, study_end) > 545.25"""
CTE["x_ml"] = "SELECT id, measure, t, CASE WHEN measure = 'NO' THEN value ELSE ln(value + 1) END AS value, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM x_m WHERE measure <> 'RO'"


def stats(source: str, order: str, keys: str = "id, measure, period") -> str:
    """Seven statistics per key from rows (keys, t, value)."""
    slope = lambda y: f"CASE WHEN NOT isnan(regr_slope({y}, t)) THEN regr_slope({y}, t) END"
    return f"""SELECT {keys}, count(*) AS n_obs, avg(value) AS mean, max(value) AS max, stddev_samp(value) AS sd, avg(abs(value - prev)) AS tv,
      {slope('value')} AS slope, {slope('recent')} AS recent_slope FROM (
      SELECT *, CASE WHEN rn <= 3 THEN value END AS recent FROM (
        SELECT *, lag(value) OVER (PARTITION BY {keys} ORDER BY {order}) AS prev,
        row_number() OVER (PARTITION BY {keys} ORDER BY {', '.join(c + ' DESC' for c in order.split(', '))}) AS rn FROM {source}))
      GROUP BY {keys}"""


ORDER = "t, l_orderkey, l_linenumber, l_partkey, l_suppkey, value"
LATEST = "arg_max(value, (t, l_orderkey, l_linenumber, l_partkey, l_suppkey, value))"
CTE["x_pe"] = """SELECT m.*, CASE WHEN t >= landmark - 180 - 365.25 THEN 'accrual' ELSE 'preindex' END AS period
  FROM x_ml m JOIN x_ss USING (id) WHERE t <= landmark - 180"""
CTE["x_pi"] = "SELECT *, CASE WHEN t <= 0 THEN 'preindex' ELSE 'accrual' END AS period FROM x_ml"
CTE["x_ste"] = stats("(SELECT * FROM x_pe WHERE period = 'accrual')", ORDER)
CTE["x_sti"] = stats("x_pi", ORDER)
CTE["x_grid"] = "SELECT id, measure FROM x_ss, (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF')) v(measure)"
CTE["x_sum"] = f"""SELECT g.id, g.measure, coalesce(n_obs, 0) AS n_obs_accrual, coalesce(mean, recent_value) AS mean_accrual, coalesce(max, recent_value) AS max_accrual,
  sd AS sd_accrual, tv AS tv_accrual, coalesce(slope, 0) AS slope_accrual, coalesce(recent_slope, 0) AS recent_slope_accrual, recent_value
  FROM x_grid g LEFT JOIN x_ste USING (id, measure) LEFT JOIN (SELECT id, measure, {LATEST} AS recent_value FROM x_pe GROUP BY 1, 2) USING (id, measure)"""
_STATS = ["n_obs", "mean", "max", "sd", "tv", "slope", "recent_slope"]
_ZERO = {"n_obs", "slope", "recent_slope"}


def _at(p: str) -> str:
    pick = lambda s: f"max(CASE WHEN period = '{p}' THEN {s} END)"
    return ", ".join((f"coalesce({pick(s)}, 0)" if s in _ZERO else pick(s)) + f" AS {s}_{p}" for s in _STATS)


CTE["x_sumi"] = f"""SELECT g.id, g.measure, {_at('preindex')}, {_at('accrual')}, any_value(recent_value) AS recent_value
  FROM x_grid g LEFT JOIN x_sti USING (id, measure) LEFT JOIN (SELECT id, measure, {LATEST} AS recent_value FROM x_pi GROUP BY 1, 2) USING (id, measure) GROUP BY 1, 2"""
_FILL = ["mean_accrual", "max_accrual", "sd_accrual", "tv_accrual", "recent_value"]


def imputed(how: str) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"coalesce({c}, {how}({c}) OVER (PARTITION BY measure)) AS {c}" for c in _FILL) + ") FROM x_sum"


SUM_COLS = "mean_accrual max_accrual sd_accrual tv_accrual slope_accrual recent_slope_accrual recent_value"
KEPT = ["AF", "AO", "NF", "NO", "RF"]


def widened(source: str, values: list[str]) -> tuple[str, str]:
    cols = [(f"{v}_{m}", f"max(CASE WHEN measure = '{m}' THEN {v} END)") for v in values for m in KEPT]
    return f"SELECT id, {', '.join(f'{e} AS {n}' for n, e in cols)} FROM {source} GROUP BY id", " ".join(n for n, _ in cols if not n.startswith("n_obs"))


# sources and scalars
sql("scan_project", "SELECT o_orderkey AS order_id, o_custkey AS id, o_totalprice AS price, o_orderpriority AS priority, o_custkey::DOUBLE AS id_number FROM orders", "price id_number")
sql("tagged_union", "SELECT id, o_orderkey, t, kind, CASE WHEN kind = 'closed' THEN indicator END AS indicator FROM x_u", "t")
CTE["x_rg"] = "SELECT event_type AS method, user_id % 50 AS seed, user_id % 3 AS forecast, avg(value) AS metric, max(value) AS best FROM events GROUP BY 1, 2, 3"
sql("result_splits", """SELECT CASE method WHEN 'view' THEN 'View' WHEN 'click' THEN 'Click' ELSE method END AS method, seed, forecast, metric, split_mode FROM (
  SELECT method, seed, forecast, metric, 'validation' AS split_mode FROM x_rg UNION ALL SELECT method, seed, forecast, best, 'test' FROM x_rg)""", "metric")
sql("bucketize", """SELECT o_orderkey, id, balance, CASE WHEN try_cast(regexp_extract(o_orderpriority, '[0-9]+') AS DOUBLE) <= 3 THEN 'low' ELSE 'high' END AS priority,
  CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium' END AS price_band,
  list_position(['debt', 'low', 'mid', 'high'], balance)::INT - 1 AS balance_level FROM orders JOIN x_sp ON id = o_custkey""")
sql("flag_join", """SELECT id, segment, CASE WHEN id IN (SELECT id FROM x_od WHERE o_orderpriority = '3-MEDIUM') THEN 1e0 ELSE 0e0 END AS medium,
  CASE WHEN id IN (SELECT id FROM x_od WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F') THEN 1e0 ELSE 0e0 END AS medium_done FROM x_sp""")
sql("log_transform", """SELECT id, measure, t, l_orderkey, l_linenumber, l_partkey, l_suppkey, value AS raw, CASE WHEN measure IN ('NO', 'AF') THEN value ELSE ln(value + 1) END AS value,
  CASE WHEN value - 5000 > -1 THEN ln(value - 5000 + 1) END AS log_gap FROM x_m""", "t raw value log_gap")
sql("time_offsets", "SELECT id, study_end, study_end / 365.25 AS years_to_end, study_end / 30 AS months_to_end, (study_end - (SELECT min(study_end) FROM x_sp)) / 365.25 AS years_after_first FROM x_sp", "study_end years_to_end months_to_end years_after_first")


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


sql("relabel", f"""SELECT p_partkey, p_brand, raw_name, CASE WHEN s = 'meanvalue small' THEN 'Small' WHEN s LIKE '%steel%' THEN {title("regexp_replace(s, 'steel', 'stainless')")}
  WHEN s LIKE '%brushed' THEN {title("regexp_replace(s, 'brushed', 'matte')")} ELSE {title('s')} END AS label,
  CASE p_brand WHEN 'Brand#1' THEN 'First' WHEN 'Brand#2' THEN 'Second' ELSE p_brand END AS brand,
  CASE regexp_extract(p_brand, '[0-9]+') WHEN '0' THEN 'Nonlinear' WHEN '1' THEN 'Linear' ELSE 'Total' END AS mode,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#3', 'Brand#5') THEN 'odd' WHEN p_brand IN ('Brand#2', 'Brand#4') THEN 'even' ELSE p_brand END AS family
  FROM (SELECT *, regexp_replace(replace(regexp_replace(raw_name, '[.]', ''), '_', ' '), 'accrual ', '') AS s
  FROM (SELECT *, 'mean.value_accrual_' || lower(replace(p_type, ' ', '_')) AS raw_name FROM part))""")
sql("method_decode", """SELECT 'test_' || method || '_labs_' || forecast AS model_name, seed, metric, method, forecast::INT AS varset FROM x_rg""", "metric")

# events and entities
sql("event_filter", "SELECT id, o_orderkey, t, kind, subtype, study_end FROM x_log", "t study_end")
sql("event_flags", "SELECT * FROM x_flags", "t")
sql("first_event", "SELECT id, o_orderkey, t, kind, n FROM x_flags WHERE first", "t")
sql("union_count", "SELECT id, count(*) AS n_events FROM (SELECT id FROM x_u UNION ALL SELECT id FROM x_od WHERE o_orderpriority = '5-LOW') GROUP BY id")
sql("outcome_label", "SELECT * FROM x_lab", "event_t")
sql("outcome_label_survival", "SELECT * FROM x_labs", "event_t")
sql("outcome_label_fixed", "SELECT id, count(*) FILTER (t <= 365.25) AS n_prior, bool_or(t > 365.25 AND t <= 545.25) AS event FROM x_log GROUP BY id")
sql("prior_events", "SELECT id, t AS prior_t FROM x_log WHERE t <= 365.25", "prior_t")
sql("entity_assemble", """SELECT s.*, coalesce(n_events, 0) AS n_events, coalesce(medium, 0e0) AS medium, switch_t, coalesce(n_orders, 0) AS n_orders, total_price,
  switch_t / 365.25 AS years_to_switch, ln(coalesce(n_orders, 0) + 1) AS log_orders FROM x_sp s LEFT JOIN (SELECT id, count(*) AS n_events FROM x_u GROUP BY id) USING (id)
  LEFT JOIN (SELECT DISTINCT id, 1e0 AS medium FROM x_od WHERE o_orderpriority = '3-MEDIUM') USING (id) LEFT JOIN x_sw USING (id)
  LEFT JOIN (SELECT id, count(*) AS n_orders, sum(o_totalprice) AS total_price FROM x_od GROUP BY id) USING (id)""", "acctbal study_end death switch_t total_price years_to_switch log_orders")
sql("censor_time", "SELECT id, death, study_end, event_t, censor, landmark0 FROM x_les", "death study_end event_t censor landmark0")
sql("random_landmark", "SELECT id, event, landmark0, jitter, landmark FROM x_rl", "landmark0 jitter landmark")
sql("switch_status", "SELECT id, landmark, switch_t, switch FROM x_ss", "landmark switch_t switch")
sql("switch_status_censored", "SELECT id, landmark, switch_t, switch FROM x_ss0 WHERE switch IS NOT NULL", "landmark switch_t switch")
sql("merge_outcome", """SELECT id, death, study_end, event_t, CASE WHEN event_t IS NULL THEN 'None' ELSE kind END AS kind, CASE WHEN event_t IS NULL THEN 'None' ELSE subtype END AS subtype,
  coalesce(n, 0) AS n_prior, event_t IS NOT NULL AS event, least(death, study_end) AS censor, least(death, study_end, event_t) AS landmark FROM (
  SELECT s.id, death, study_end, CASE WHEN t < study_end THEN t END AS event_t, kind, subtype, n FROM x_sp s LEFT JOIN (SELECT * FROM x_flags WHERE first) f USING (id))""", "death study_end event_t censor landmark")
sql("merge_classification", "SELECT * FROM x_mc", "acctbal study_end death landmark switch event censor")
sql("attrition", """SELECT stage, kept, (SELECT count(*) FROM x_sp) - kept AS excluded FROM (SELECT 'all' AS stage, count(DISTINCT id) AS kept FROM x_sp
  UNION ALL SELECT 'with_event', count(DISTINCT id) FROM x_log UNION ALL SELECT 'analysed', count(DISTINCT id) FROM x_mc)""")

# measures
sql("period_label", """SELECT id, measure, period, count(*) AS n, min(t) AS first_t, max(t) AS last_t, mode FROM (
  SELECT id, measure, t, 'index' AS mode, CASE WHEN t <= 0 THEN 'preindex' ELSE 'accrual' END AS period FROM x_m UNION ALL
  SELECT id, measure, t, 'event', CASE WHEN t >= landmark - 180 - 365.25 THEN 'accrual' ELSE 'preindex' END FROM x_m JOIN x_ss USING (id) WHERE t <= landmark - 180) GROUP BY ALL""", "first_t last_t")
sql("latest_value", f"SELECT id, measure, {LATEST} AS recent_value FROM x_m GROUP BY 1, 2", "recent_value")
CTE["x_mi"] = "SELECT *, CASE WHEN t <= 0 THEN 'preindex' ELSE 'accrual' END AS period FROM x_m"
sql("measure_trend", stats("x_mi", ORDER), "mean max sd tv slope recent_slope")
CTE["x_emp"] = "SELECT *, CASE WHEN t <= 7 THEN 'accrual' ELSE 'later' END AS period FROM x_em"
sql("event_measure_trend", stats("x_emp", "t, event_id"), "mean max sd tv slope recent_slope")
sql("measure_summary", "SELECT * FROM x_sum", SUM_COLS)
sql("measure_summary_index", "SELECT * FROM x_sumi", " ".join(f"{s}_{p}" for s in _STATS if s != "n_obs" for p in ("preindex", "accrual")) + " recent_value")
sql("complete_grid", "SELECT g.id, g.measure, n FROM (SELECT id, measure FROM x_sp, (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO')) v(measure)) g LEFT JOIN (SELECT id, measure, count(*) AS n FROM x_m GROUP BY 1, 2) USING (id, measure)")
sql("impute_median", imputed("median"), SUM_COLS)
sql("impute_mean", imputed("avg"), SUM_COLS)
sql("impute_columns", """SELECT id, acctbal, coalesce(death, avg(death) OVER ()) AS death, coalesce(switch_t, avg(switch_t) OVER ()) AS switch_t,
  coalesce(death, median(death) OVER ()) AS death_median, coalesce(switch_t, median(switch_t) OVER ()) AS switch_median FROM x_sp LEFT JOIN x_sw USING (id)""", "acctbal death switch_t death_median switch_median")


def baseline(how: str) -> str:
    return f"""SELECT id, measure, 0e0 AS period, coalesce(value, {how}(value) OVER (PARTITION BY measure)) AS value FROM (
      SELECT g.id, g.measure, value FROM (SELECT id, measure FROM x_sp, (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF')) v(measure)) g
      LEFT JOIN (SELECT id, measure, avg(value) AS value FROM x_ml WHERE t <= 0 GROUP BY 1, 2) USING (id, measure))
      UNION ALL SELECT id, measure, t, avg(value) FROM x_ml WHERE t > 0 AND measure <> 'RO' GROUP BY 1, 2, 3"""


CTE["x_bm"] = baseline("avg")
sql("baseline_measures", baseline("median"), "period value")
sql("pivot_wide", *widened("x_sum", ["n_obs_accrual", "mean_accrual", "max_accrual", "slope_accrual", "recent_slope_accrual", "recent_value"]))
_ALL = ["n_obs_accrual", *SUM_COLS.split()]
CTE["x_impm"] = imputed("median")
CTE["x_wide"], _wide_cols = widened("x_impm", _ALL)
sql("feature_table", "SELECT x_mc.*, x_wide.* EXCLUDE (id) FROM x_mc LEFT JOIN x_wide USING (id)", "acctbal study_end death landmark switch event censor " + _wide_cols)
sql("unpivot_long", "SELECT id, segment, unnest(['acctbal', 'death', 'study_end']) AS name, unnest([acctbal, death, study_end]) AS value FROM x_sp", "value")
sql("varset_drop", *widened("x_sum", ["n_obs_accrual", "mean_accrual", "max_accrual", "sd_accrual", "tv_accrual", "recent_value"]))
sql("fill_zero", "SELECT id, CASE WHEN segment <> 'BUILDING' THEN segment ELSE 'other' END AS segment, coalesce(death, 0e0) AS death, coalesce(switch_t, 0e0) AS switch_t FROM x_sp LEFT JOIN x_sw USING (id)", "death switch_t")
sql("varset_select", *widened("x_sum", ["mean_accrual", "max_accrual", "recent_slope_accrual", "recent_value"]))
sql("dedup_first", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id, t, measure ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, value) AS rn FROM x_m) WHERE rn = 1", "t value")

# intervals
CTE["x_se"] = """SELECT s.id, segment, acctbal, balance, nation, region, study_end, death, switch_t, switch, n_prior,
  event_t IS NOT NULL AS event, event_t, least(death, study_end, event_t) AS landmark FROM (
  SELECT * EXCLUDE (switch, n_prior, event_t), coalesce(switch, 0) AS switch, coalesce(n_prior, 0) AS n_prior,
    CASE WHEN event_t < study_end THEN event_t END AS event_t FROM (
    SELECT * REPLACE (CASE WHEN switch = 0 THEN NULL ELSE switch_t END AS switch_t) FROM (
      SELECT *, CASE WHEN switch_t <= landmark0 - 180 THEN 1e0 WHEN switch_t <= landmark0 THEN NULL ELSE 0e0 END AS switch FROM x_les))) s"""
CTE["x_se2"] = "SELECT * REPLACE (landmark - 180 AS landmark) FROM x_se WHERE landmark - 180 > 0"
CTE["x_ti"] = """SELECT id, landmark, 'initial' AS treatment, 0e0 AS start, CASE WHEN switch = 1 THEN switch_t ELSE landmark END AS "end",
  CASE WHEN switch = 1 AND event_t > switch_t THEN 0e0 ELSE event::INT::DOUBLE END AS event FROM x_se2
  UNION ALL SELECT id, landmark, 'switched', switch_t, landmark, event::INT::DOUBLE FROM x_se2 WHERE switch = 1 AND landmark > switch_t"""
sql("treatment_intervals", "SELECT * FROM x_ti", 'landmark start "end" event')
_V = ["AF", "AO", "NF", "NO", "RF"]
CTE["x_ib0"] = f"""SELECT coalesce(a.id, b.id) AS id, coalesce(a.start, b.period) AS start, a."end" AS e0, a.treatment AS t0, {', '.join(f'b.v{m}' for m in _V)}
  FROM x_ti a FULL JOIN (SELECT x_bm.id, period, {', '.join(f"max(CASE WHEN measure = '{m}' THEN value END) AS v{m}" for m in _V)}
  FROM x_bm JOIN x_se2 ON x_se2.id = x_bm.id AND period < landmark GROUP BY 1, 2) b ON a.id = b.id AND a.start = b.period"""
CTE["x_ib"] = f"""SELECT i.id, i.start, i."end", i.treatment, {', '.join(f'i."{m}"' for m in _V)}, l.landmark, CASE WHEN i."end" = l.landmark THEN coalesce(t.event, 0) ELSE 0 END AS event FROM (
  SELECT id, start, coalesce(lead(start) OVER w, max(e0) OVER (PARTITION BY id)) AS "end", last_value(t0 IGNORE NULLS) OVER c AS treatment,
  {', '.join(f'last_value(v{m} IGNORE NULLS) OVER c AS "{m}"' for m in _V)} FROM x_ib0
  WINDOW w AS (PARTITION BY id ORDER BY start), c AS (PARTITION BY id ORDER BY start ROWS UNBOUNDED PRECEDING)) i JOIN x_se2 l USING (id)
  LEFT JOIN (SELECT id, max(event) AS event FROM x_ti WHERE "end" = landmark GROUP BY id) t USING (id)"""
sql("interval_build", "SELECT * FROM x_ib", 'start "end" AF AO NF NO RF landmark event')
sql("interval_check", """SELECT count(*) AS n_intervals, count(*) FILTER (NOT coalesce("end" > start, false)) AS n_bad FROM x_ti""")
sql("locf", """SELECT id, event_id, t, last_value(CASE WHEN measure = 'click' THEN value END IGNORE NULLS) OVER c AS click,
  last_value(CASE WHEN measure = 'view' THEN value END IGNORE NULLS) OVER c AS view FROM x_em
  WINDOW c AS (PARTITION BY id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)""", "t click view")
CTE["x_t"] = "SELECT unnest([182.625e0, 365.25e0, 547.875e0, 730.5e0, 913.125e0]) AS eval_t"
CTE["x_asof"] = """SELECT id, landmark, treatment, start, "end", event, fu AS follow_up, eval_t FROM (
  SELECT i.*, eval_t, row_number() OVER (PARTITION BY id, eval_t ORDER BY start DESC, "end" DESC) AS rn
  FROM (SELECT *, max("end") OVER (PARTITION BY id) AS fu FROM x_ti) i JOIN x_t ON start <= eval_t) WHERE rn = 1"""
sql("asof_at_times", "SELECT * FROM x_asof", 'landmark start "end" event follow_up eval_t')
CTE["x_st"] = """SELECT i.* EXCLUDE (rn), eval_t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start DESC, "end" DESC) AS rn FROM x_ti) i JOIN x_t ON eval_t >= start AND (rn = 1 OR eval_t < "end")"""
sql("stitch_predictions", "SELECT *, exp(-eval_t / (2000 + start)) AS surv FROM x_st", 'landmark start "end" event eval_t surv')
CTE["x_last"] = """SELECT * EXCLUDE (r) FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY "end" DESC) AS r FROM x_ti) WHERE r = 1"""
sql("last_interval", "SELECT * FROM x_last", 'landmark start "end" event')
sql("collapse_static", """SELECT id, segment, region, CASE WHEN bool_or(treatment = 'switched') THEN 'switched' ELSE 'initial' END AS treatment, max(event) AS event
  FROM x_ti JOIN x_sp USING (id) GROUP BY 1, 2, 3""", "event")
_E = [0.0, 365.25, 730.5, 1095.75, 1461.0, 2500.0]
CTE["x_bins"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}e0, {b}e0)" for i, (a, b) in enumerate(zip(_E, _E[1:]))) + ") v(bin, lo, hi)"
sql("person_period", """SELECT x_ti.*, bin, lo, hi, CASE WHEN event > 0 AND "end" > lo AND "end" <= hi THEN 1e0 ELSE 0e0 END AS y FROM x_ti JOIN x_bins ON start < hi AND "end" > lo""", 'landmark start "end" event lo hi')
CTE["x_et"] = """SELECT DISTINCT t FROM (SELECT "end" AS t FROM x_ti WHERE event > 0 UNION ALL SELECT eval_t FROM x_t)"""
sql("eval_times", "SELECT t FROM x_et", "t")

# sampling and features
sql("keyed_uniform", f"SELECT id, seed, {uniform('seed', 'draw', 'id')} AS u, CASE WHEN {uniform('seed', 'sign', 'id')} < 0.5 THEN 1e0 ELSE -1e0 END AS sign FROM x_sp, (SELECT unnest([1, 2, 3, 4, 5])::INT AS seed)", "u sign")
CTE["x_split"] = f"SELECT id, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.75 THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, {uniform(chr(39) + '11' + chr(39), 'split', 'id')} AS u FROM x_sp)"
sql("split_assign", """SELECT id, start, "end", split FROM x_ti JOIN x_split USING (id) WHERE split <> 'train'""", 'start "end"')
sql("stratified_split", f"""SELECT doc_id, quality, CASE WHEN i <= a THEN 'train' WHEN i <= a + round((n - a) * 0.5) THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN i <= a + round((n - a) * 0.5) THEN 'train' ELSE 'test' END AS test_mode FROM (SELECT *, round(n * 0.6) AS a FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {uniform("'11'", 'stratified', 'doc_id')}, doc_id) AS i, count(*) OVER (PARTITION BY quality) AS n FROM labels))""")
sql("subsample", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {uniform(chr(39) + '11' + chr(39), 'subsample', 'o_orderkey')} < 0.1", "o_totalprice")


def permuted(n: int) -> str:
    return f"""SELECT t.id, t.replicate, t.acctbal, s.acctbal AS permuted FROM (
      SELECT id, replicate, acctbal, row_number() OVER (PARTITION BY replicate ORDER BY id) AS pos FROM x_sp, (SELECT unnest(range(1, {n + 1})) AS replicate)) t JOIN (
      SELECT replicate, acctbal, row_number() OVER (PARTITION BY replicate ORDER BY {uniform("'11'", 'permute', 'replicate', 'id')}, id) AS pos
      FROM x_sp, (SELECT unnest(range(1, {n + 1})) AS replicate)) s ON s.replicate = t.replicate AND s.pos = t.pos"""


sql("permute_column", f"SELECT * REPLACE (replicate::INT AS replicate) FROM ({permuted(3)})", "acctbal permuted")
sql("permute_static", f"""SELECT i.id, i.start, i."end", p.acctbal, p.replicate::INT AS replicate, p.permuted FROM x_ti i JOIN ({permuted(2).replace('x_sp', '(SELECT * FROM x_sp WHERE id IN (SELECT id FROM x_ti))')}) p ON p.id = i.id""", 'start "end" acctbal permuted')


def ones(col: str, levels: list[str], expr: str | None = None) -> str:
    return ", ".join(f"CASE WHEN {expr or col} = '{v}' THEN 1e0 ELSE 0e0 END AS \"{col}_{v}\"" for v in levels)


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_BAL = ["debt", "high", "low", "mid"]
sql("one_hot", f"SELECT id, {ones('segment', _SEG)}, {ones('balance', _BAL)}, CASE WHEN death IS NULL THEN 1e0 ELSE 0e0 END AS vital_none FROM x_sp")
sql("one_hot_sparse", """SELECT l_orderkey, "column", level, index FROM (
  SELECT *, dense_rank() OVER (PARTITION BY "column" ORDER BY level)::BIGINT - 1 AS index FROM (
    SELECT l_orderkey, 'supplier' AS "column", min(l_suppkey)::VARCHAR AS level FROM lineitem GROUP BY l_orderkey
    UNION ALL SELECT l_orderkey, 'shipped', max(l_shipdate)::VARCHAR FROM lineitem GROUP BY l_orderkey))""")
sql("directory_union", "SELECT id, measure, t, value, l_orderkey, l_linenumber FROM x_m", "t value")
sql("one_hot_full_rank", f"SELECT id, {ones('balance', ['low', 'mid', 'high'])} FROM x_sp")
sql("standardize", "SELECT id, (acctbal - avg(acctbal) OVER ()) / stddev_pop(acctbal) OVER () AS acctbal, (study_end - avg(study_end) OVER ()) / stddev_pop(study_end) OVER () AS study_end, 0e0 AS constant FROM x_sp", "acctbal study_end")
sql("standardize_train", """SELECT id, (acctbal - ma) / sa AS acctbal, (study_end - ms) / ss AS study_end, split FROM x_sp JOIN x_split USING (id), (
  SELECT avg(acctbal) AS ma, stddev_samp(acctbal) AS sa, avg(study_end) AS ms, stddev_samp(study_end) AS ss FROM x_sp JOIN x_split USING (id) WHERE split = 'train')""", "acctbal study_end")
sql("attach_names", """SELECT method, seed, i::INT AS position, (CASE i WHEN 0 THEN a WHEN 1 THEN lo ELSE hi END) AS importance, ['average', 'lowest', 'highest'][i + 1] AS name
  FROM (SELECT method, seed, avg(metric) AS a, min(metric) AS lo, max(metric) AS hi FROM x_rg GROUP BY 1, 2), (SELECT unnest([0, 1, 2]) AS i)""", "importance")

# classifier metrics
CTE["x_sc"] = """SELECT l_orderkey % 5 AS seed, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, model,
  CASE model WHEN 'm1' THEN l_discount * 6e0 + l_linenumber / 100e0 ELSE l_quantity / 64e0 END AS score FROM lineitem, (VALUES ('m1'), ('m2')) v(model)"""
CTE["x_ld"] = "SELECT doc_id, quality AS y, n_chars::DOUBLE / (n_chars::DOUBLE + 1500e0) AS score, source, lang FROM labels JOIN documents USING (doc_id)"
sql("threshold_label", "SELECT *, CASE WHEN score > 0.6e0 THEN 1e0 ELSE 0e0 END AS label FROM x_ld", "score")
sql("accuracy_f1", """SELECT model, seed, avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END) AS accuracy,
  coalesce(2e0 * count(*) FILTER (y = 1 AND p = 1) / nullif(2 * count(*) FILTER (y = 1 AND p = 1) + count(*) FILTER (y <> p), 0), 0) AS f1
  FROM (SELECT *, CASE WHEN score > 0.5e0 THEN 1 ELSE 0 END AS p FROM x_sc) GROUP BY 1, 2""", "accuracy f1")


def curve(source: str, by: str, weight: str = "1") -> str:
    """Counts at or above each distinct score."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""SELECT *, sum(pos) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
      sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n, row_number() OVER ({part} ORDER BY score DESC) AS i,
      lead(pos) OVER ({part} ORDER BY score DESC) AS npos, lead(neg) OVER ({part} ORDER BY score DESC) AS nneg FROM (
      SELECT {cols}score, sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE {weight} END)::DOUBLE AS neg FROM {source} GROUP BY {cols}score)"""


AUROC = "sum(pos * (n - fp + neg / 2)) / nullif(any_value(p) * any_value(n), 0) AS auroc"
AP = "sum(pos * tp / nullif(tp + fp, 0)) / nullif(any_value(p), 0) AS average_precision"
CTE["x_curve"] = curve("x_sc", "model, seed")
sql("auroc", f"SELECT model, seed, {AUROC} FROM x_curve GROUP BY 1, 2", "auroc")
CTE["x_both"] = "SELECT 'chars' AS model, y, score FROM x_ld UNION ALL SELECT model, y, score FROM x_sc"
sql("average_precision", f"SELECT model, {AUROC}, {AP} FROM ({curve('x_both', 'model')}) GROUP BY 1", "auroc average_precision")
CTE["x_roc"] = """SELECT model, seed, fp / n AS fpr, tp / p AS tpr, score AS threshold, i FROM x_curve WHERE i = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
  UNION ALL SELECT DISTINCT model, seed, 0e0, 0e0, NULL::DOUBLE, 0 FROM x_curve"""
sql("roc_curve", "SELECT model, seed, fpr, tpr, threshold FROM x_roc", "fpr tpr threshold")
CTE["x_curve_l"] = curve("x_ld", "lang")
sql("roc_curve_all_points", "SELECT lang, fp / nullif(n, 0) AS fpr, tp / nullif(p, 0) AS tpr, score AS threshold, i AS position FROM x_curve_l UNION ALL SELECT DISTINCT lang, 0e0, 0e0, NULL::DOUBLE, 0 FROM x_curve_l", "fpr tpr threshold")
sql("best_cutoff", """SELECT model, seed, tpr AS sensitivity, 1 - fpr AS specificity, threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY round((1 - tpr) * (1 - tpr) + fpr * fpr, 12), i) AS r FROM x_roc) WHERE r = 1""", "sensitivity specificity threshold")
sql("calibration_bins", """SELECT model, seed, (CASE WHEN score <= q1 THEN 1 WHEN score <= q2 THEN 2 ELSE 3 END)::INT AS quantile, sum(y)::BIGINT AS observed, sum(score) AS predicted
  FROM x_sc JOIN (SELECT model, seed, quantile_cont(score, 0.33e0) AS q1, quantile_cont(score, 0.66e0) AS q2 FROM x_sc GROUP BY 1, 2) USING (model, seed) GROUP BY 1, 2, 3""", "predicted")
CTE["x_th"] = "SELECT i / 100e0 AS threshold FROM (SELECT unnest(range(100)) AS i)"
CTE["x_dc"] = """SELECT model, seed, threshold, count(*) FILTER (y = 1 AND score >= threshold) / count(*)::DOUBLE - count(*) FILTER (y = 0 AND score >= threshold) / count(*)::DOUBLE * (threshold / (1 - threshold)) AS net_benefit,
  avg(y) - (1 - avg(y)) * (threshold / (1 - threshold)) AS treat_all, 0e0 AS treat_none FROM x_sc, x_th GROUP BY 1, 2, 3"""
sql("decision_curve", "SELECT * FROM x_dc", "threshold net_benefit treat_all")


def poisson(u: str) -> str:
    import math

    total, term, parts = 0.0, math.exp(-1.0), []
    for k in range(60):
        if 1.0 - total <= 1e-15:
            break
        total += term
        parts.append(f"CASE WHEN {u} >= {total!r}::DOUBLE THEN 1 ELSE 0 END")
        term /= k + 1
    return "(" + " + ".join(parts) + ")"


CTE["x_boot"] = f"""SELECT y, score, replicate, {poisson('u')} AS w FROM (SELECT y, score, replicate, {uniform("'11'", 'bootstrap', 'replicate', 'doc_id')} AS u
  FROM x_ld, (SELECT unnest(range(1, 101))::INT AS replicate))"""
CTE["x_boot_c"] = curve("(SELECT * FROM x_boot WHERE w > 0)", "replicate", "w")
CTE["x_boot_h"] = """SELECT replicate, sum(CASE WHEN (y = 1) = (score > 0.5) THEN w ELSE 0 END) / sum(w)::DOUBLE AS accuracy,
  coalesce(2 * sum(CASE WHEN y = 1 AND score > 0.5 THEN w ELSE 0 END) / nullif(2 * sum(CASE WHEN y = 1 AND score > 0.5 THEN w ELSE 0 END)
    + sum(CASE WHEN (y = 1) <> (score > 0.5) THEN w ELSE 0 END), 0)::DOUBLE, 0) AS f1 FROM x_boot GROUP BY 1"""
sql("bootstrap_metric", f"SELECT * FROM (SELECT replicate, {AUROC}, {AP} FROM x_boot_c GROUP BY 1) JOIN x_boot_h USING (replicate)", "auroc average_precision accuracy f1")

# survival metrics
CTE["x_sr"] = "SELECT id, segment, region, acctbal, landmark, event::INT AS event, switch FROM x_se"


def life_table(source: str, by: str, t: str = "landmark", event: str = "event") -> str:
    return f"""SELECT *, sum(n_event + n_censor) OVER (PARTITION BY {by} ORDER BY t DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS n_risk FROM (
      SELECT {by}, {t} AS t, count(*) FILTER ({event} > 0) AS n_event, count(*) FILTER (NOT {event} > 0) AS n_censor FROM {source} GROUP BY {by}, {t})"""


def km(source: str, by: str, t: str = "landmark") -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {by}, t, n_risk, n_event, n_censor, CASE WHEN z = 0 THEN exp(l) ELSE 0 END AS surv, CASE WHEN z = 0 THEN sqrt(v) END AS std_err,
      CASE WHEN z = 0 THEN least(1, exp(l - 1.959963984540054e0 * sqrt(v))) END AS lower, CASE WHEN z = 0 THEN least(1, exp(l + 1.959963984540054e0 * sqrt(v))) END AS upper FROM (
      SELECT *, sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk::DOUBLE) ELSE 0 END) {w} AS l,
        sum(CASE WHEN n_event < n_risk THEN n_event / (n_risk::DOUBLE * (n_risk - n_event)) ELSE 0 END) {w} AS v,
        sum(CASE WHEN n_event < n_risk THEN 0 ELSE 1 END) {w} AS z FROM ({life_table(source, by, t)}))"""


KM_COLS = "t surv std_err lower upper"
sql("kaplan_meier", km("x_sr", "segment"), KM_COLS)


def censoring(source: str, by: str, t: str) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING)"
    c, n = "n_censor", "(n_risk - n_event)"
    return f"""SELECT {by}, t, CASE WHEN z = 0 THEN exp(l) ELSE 0 END AS g, CASE WHEN z - z0 = 0 THEN exp(l - l0) ELSE 0 END AS g_before FROM (
      SELECT *, sum(l0) {w} AS l, sum(z0) {w} AS z FROM (SELECT *, CASE WHEN {c} < {n} THEN ln(1 - {c} / {n}::DOUBLE) ELSE 0 END AS l0,
        CASE WHEN {c} > 0 AND {c} >= {n} THEN 1 ELSE 0 END AS z0 FROM ({life_table(source, by, t)})))"""


sql("censoring_survival", censoring("x_sr", "segment", "landmark"), "t g g_before")
CTE["x_bh"] = """SELECT region, start, "end", event, exp(acctbal / 20000 + CASE WHEN treatment = 'switched' THEN 0.3e0 ELSE 0e0 END) AS w FROM x_ti JOIN x_sp USING (id)"""
sql("baseline_hazard", """SELECT *, sum(d / risk_sum) OVER (PARTITION BY region ORDER BY t ROWS UNBOUNDED PRECEDING) AS cum_hazard FROM (
  SELECT e.region, e.t, any_value(e.d) AS d, sum(x_bh.w) AS risk_sum FROM (SELECT region, "end" AS t, count(*)::DOUBLE AS d FROM x_bh WHERE event > 0 GROUP BY 1, 2) e
  JOIN x_bh ON x_bh.region = e.region AND x_bh.start < e.t AND x_bh."end" >= e.t GROUP BY 1, 2)""", "t d risk_sum cum_hazard")
CTE["x_rr"] = """SELECT id, eval_t, follow_up, event, model, CASE model WHEN 'balance' THEN -acctbal ELSE -floor(acctbal / 2500) END AS risk
  FROM x_asof JOIN x_sp USING (id), (VALUES ('balance'), ('tied')) v(model) WHERE eval_t < 600"""


def concordance(source: str, by: str, t: str, tau: str | None = None, weight: str = "1e0") -> str:
    on = " AND ".join(f"i.{b} = j.{b}" for b in by.split(", ") if b) or "true"
    cols = ", ".join(f"i.{b}" for b in by.split(", ") if b)
    head = f"{cols}, " if cols else ""
    until = f" AND i.{t} <= i.{tau}" if tau else ""
    return f"""SELECT *, (concordant + tied / 2) / nullif(usable, 0) AS c_index FROM (
      SELECT {head}coalesce(sum({weight}), 0) AS usable, coalesce(sum(CASE WHEN i.risk > j.risk THEN {weight} ELSE 0 END), 0) AS concordant,
      coalesce(sum(CASE WHEN i.risk = j.risk THEN {weight} ELSE 0 END), 0) AS tied FROM {source} i JOIN {source} j
      ON {on} AND i.event > 0{until} AND (j.{t} > i.{t} OR (j.{t} = i.{t} AND NOT j.event > 0)) {'GROUP BY ' + cols if cols else ''})"""


sql("c_index", f"""SELECT g.model, g.eval_t, coalesce(usable, 0) AS usable, coalesce(concordant, 0) AS concordant, coalesce(tied, 0) AS tied, c_index
  FROM (SELECT DISTINCT model, eval_t FROM x_rr) g LEFT JOIN ({concordance('x_rr', 'model, eval_t', 'follow_up', 'eval_t')}) USING (model, eval_t)""", "usable concordant tied c_index eval_t")
CTE["x_sr2"] = "SELECT *, -acctbal AS risk FROM x_sr"
sql("c_index_overall", concordance("x_sr2", "", "landmark"), "usable concordant tied c_index")
CTE["x_g"] = censoring("x_rr", "model, eval_t", "follow_up")
CTE["x_rrw"] = "SELECT x_rr.*, 1 / nullif(g * g_before, 0) AS w FROM x_rr JOIN x_g ON x_g.model = x_rr.model AND x_g.eval_t = x_rr.eval_t AND x_g.t = x_rr.follow_up"
sql("c_index_ipcw", "SELECT model, eval_t, ln(usable) AS log_usable, concordant / nullif(usable, 0) AS concordant_share, tied / nullif(usable, 0) AS tied_share, c_index FROM (" + concordance("x_rrw", "model, eval_t", "follow_up", None, "i.w") + ")", "log_usable concordant_share tied_share c_index eval_t")
CTE["x_ps"] = "SELECT x_st.*, acctbal, segment, exp(-eval_t / 2000 * exp(acctbal / 20000)) AS surv FROM x_st JOIN x_sp USING (id)"
sql("risk_strata", "SELECT id, start, eval_t, segment, surv, CASE WHEN surv > median(surv) OVER (PARTITION BY eval_t, segment) THEN 'low' ELSE 'high' END AS risk FROM x_ps", "start eval_t surv")
CTE["x_strata"] = """SELECT x_ps.id, eval_t, CASE WHEN surv > median(surv) OVER (PARTITION BY eval_t) THEN 'low' ELSE 'high' END AS risk, l.event, l."end" / 365.25 AS years FROM x_ps JOIN x_last l USING (id)"""
sql("km_by_stratum", km("x_strata", "eval_t, risk", "years"), "eval_t " + KM_COLS)
CTE["x_sry"] = "SELECT *, landmark / 365.25 AS years FROM x_sr"
CTE["x_kmc"] = km("x_sry", "region, segment", "years")


def interpolated(cols: list[str]) -> str:
    def value(c):
        return f"CASE WHEN a.t = g.t OR b.t IS NULL OR b.t = a.t THEN a.{c} ELSE a.{c} + (g.t - a.t) / (b.t - a.t) * (b.{c} - a.{c}) END AS {c}"

    return f"""SELECT g.region, g.segment, g.step, g.t, {', '.join(value(c) for c in cols)} FROM (
      SELECT region, segment, i AS step, i * 0.01e0 AS t FROM (SELECT region, segment, unnest(range(0, floor(m / 0.01e0 + 1e-9)::BIGINT + 1)) AS i FROM (
        SELECT region, segment, max(t) AS m FROM x_kmc GROUP BY 1, 2))) g
      ASOF LEFT JOIN x_kmc a ON a.region = g.region AND a.segment = g.segment AND a.t <= g.t
      ASOF LEFT JOIN x_kmc b ON b.region = g.region AND b.segment = g.segment AND b.t >= g.t"""


sql("curve_interpolate", interpolated(["surv", "std_err"]), "t surv std_err")
CTE["x_ci"] = interpolated(["surv", "std_err", "lower", "upper"])
sql("km_average", "SELECT segment, step, avg(surv) AS surv, avg(std_err) AS std_err, avg(lower) AS lower, avg(upper) AS upper FROM x_ci GROUP BY 1, 2", "surv std_err lower upper")

# results
sql("grid_rollup", """SELECT g.method, g.forecast, n, m AS mean_metric, s AS sd_metric, s / sqrt(n) AS se_metric, cutoff, printf('%.2f (%.2f)', round(m, 6), round(s, 6)) AS label FROM (
  SELECT method, forecast, count(*) AS n, avg(metric) AS m, stddev_samp(metric) AS s FROM x_rg GROUP BY 1, 2) g
  LEFT JOIN (SELECT event_type AS method, user_id % 3 AS forecast, max(value) AS cutoff FROM events GROUP BY 1, 2) c USING (method, forecast)""", "mean_metric sd_metric se_metric cutoff")
sql("percentile_ci", """SELECT *, printf('(%.1f, %.1f)', lower, upper) AS label FROM (
  SELECT method, forecast, quantile_cont(metric, 0.025e0) AS lower, quantile_cont(metric, 0.975e0) AS upper FROM x_rg GROUP BY 1, 2)""", "lower upper")
sql("event_rate", "SELECT segment, region, sum(event) AS n_event, count(*) AS n, sum(event) / count(*) AS rate FROM x_mc GROUP BY 1, 2", "n_event rate")


def ranked(source: str, tag: str = "config") -> str:
    return f"""SELECT *, rank() OVER (PARTITION BY {tag} ORDER BY importance_mean DESC) + (count(*) OVER (PARTITION BY {tag}, importance_mean) - 1) / 2 AS importance_rank FROM (
      SELECT {tag}, variable, avg(importance) AS importance_mean FROM {source} GROUP BY 1, 2)"""


sql("importance_rank", ranked("""(SELECT o_orderstatus AS config, (o_custkey % 40)::VARCHAR AS variable, round(avg(round(o_totalprice / 50000)), 1) AS importance FROM orders GROUP BY 1, 2)"""), "importance_mean importance_rank")
sql("importance_top", f"""SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY importance_mean DESC, variable) AS i FROM ({ranked("(SELECT l_returnflag AS config, l_suppkey::VARCHAR AS variable, l_quantity AS importance FROM lineitem)")})) WHERE i <= 10""", "importance_mean importance_rank")
CTE["x_vo"] = """SELECT p_brand AS config, unnest([split_part(p_type, ' ', 1) || ': ' || split_part(p_type, ' ', 2), split_part(p_type, ' ', 1)]) AS variable, p_retailprice AS importance FROM part"""
CTE["x_vr"] = ranked("x_vo")
sql("variable_order", """SELECT config, root, variable, importance_rank, coalesce(min(CASE WHEN variable = root THEN importance_rank END) OVER p, min(importance_rank) OVER p) AS root_rank,
  CASE WHEN variable = root THEN '' ELSE variable END AS level_key FROM (SELECT *, split_part(variable, ':', 1) AS root FROM x_vr) WINDOW p AS (PARTITION BY config, root)""", "importance_rank root_rank")
CTE["x_diff"] = "SELECT a.forecast, a.seed, a.method, b.metric - a.metric AS diff FROM x_rg a JOIN x_rg b ON b.forecast = a.forecast AND b.seed = a.seed AND b.method = 'view' WHERE a.method <> 'view'"
sql("paired_diff_tests", f"""SELECT method, forecast, n, mean_diff, sd_diff, perm_pval, n_rank, signed_rank, mean_diff / (sd_diff / sqrt(n)) AS t_stat,
  CASE WHEN perm_pval < 0.001 THEN '***' WHEN perm_pval < 0.01 THEN '**' WHEN perm_pval < 0.05 THEN '*' ELSE '' END AS stars
  FROM (SELECT method, forecast, count(*) AS n, avg(diff) AS mean_diff, stddev_samp(diff) AS sd_diff FROM x_diff GROUP BY 1, 2)
  JOIN (SELECT method, forecast, avg(CASE WHEN s > o + 1e-12 * m THEN 1e0 ELSE 0e0 END) AS perm_pval FROM (
    SELECT method, forecast, replicate, sum(diff * CASE WHEN {uniform("'11'", 'flip', 'replicate', 'seed')} < 0.5 THEN 1 ELSE -1 END) AS s, sum(diff) AS o, sum(abs(diff)) AS m
    FROM x_diff, (SELECT unnest(range(1, 1001)) AS replicate) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (method, forecast)
  JOIN (SELECT method, forecast, count(*) AS n_rank, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS signed_rank FROM (
    SELECT *, rank() OVER (PARTITION BY method, forecast ORDER BY a) + (count(*) OVER (PARTITION BY method, forecast, a) - 1) / 2 AS r FROM (
      SELECT *, round(abs(diff), 12) AS a FROM x_diff WHERE diff <> 0)) GROUP BY 1, 2) USING (method, forecast)""", "mean_diff sd_diff perm_pval signed_rank t_stat")
CTE["x_oc0"] = "SELECT region, round((acctbal - avg(acctbal) OVER ()) / stddev_pop(acctbal) OVER (), 1) AS grid, avg(acctbal) OVER () AS m, stddev_pop(acctbal) OVER () AS s, price FROM x_sp JOIN (SELECT id, avg(o_totalprice) AS price FROM x_od GROUP BY id) USING (id)"
CTE["x_oc"] = "SELECT region, grid * any_value(s) + any_value(m) AS x, avg(price) AS average FROM x_oc0 GROUP BY region, grid"
CTE["x_pg"] = """SELECT region, point, gx AS x, y0 + slope * (gx - x0) AS y FROM (SELECT r.region, point, lo + (hi - lo) * point / 99e0 AS gx FROM (SELECT DISTINCT region FROM x_oc) r,
  (SELECT quantile_cont(x, 0.01e0) AS lo, quantile_cont(x, 0.99e0) AS hi FROM x_oc), (SELECT unnest(range(100))::INT AS point)) g
  JOIN (SELECT region, x AS kx, CASE WHEN nx IS NULL THEN px ELSE x END AS x0, CASE WHEN nx IS NULL THEN py ELSE average END AS y0,
    CASE WHEN nx IS NULL THEN (average - py) / (x - px) ELSE (ny - average) / (nx - x) END AS slope, CASE WHEN px IS NULL THEN -1e300 ELSE x END AS lo_x, coalesce(nx, 1e300) AS hi_x FROM (
    SELECT *, lag(x) OVER w AS px, lag(average) OVER w AS py, lead(x) OVER w AS nx, lead(average) OVER w AS ny FROM x_oc WINDOW w AS (PARTITION BY region ORDER BY x))) k
  USING (region) WHERE gx >= lo_x AND gx < hi_x"""
sql("pdp_common_grid", "SELECT * FROM x_pg", "x y")
sql("pdp_summary", "SELECT point, avg(y) AS mean, quantile_cont(y, 0.025e0) AS lower, quantile_cont(y, 0.975e0) AS upper FROM x_pg GROUP BY 1", "mean lower upper")

# profiles
_FLAGS = {"all": "true", "event": "event = 1", "no_event": "event <> 1", "switched": "switch = 1", "not_switched": "switch <> 1"}
CTE["x_sl"] = "SELECT unnest(['segment', 'balance', 'region']) AS variable, unnest([segment, balance, region]) AS category, event, switch FROM x_mc"
sql("strata_table", "SELECT variable, category, " + ", ".join(
    f"count(*) FILTER ({c}) AS n_{k}, count(*) FILTER ({c}) * 100e0 / any_value(t_{k}) AS pct_{k}, printf('%d (%.1f%%)', count(*) FILTER ({c}), count(*) FILTER ({c}) * 100e0 / any_value(t_{k})) AS label_{k}" for k, c in _FLAGS.items()
) + " FROM x_sl, (SELECT " + ", ".join(f"count(*) FILTER ({c}) AS t_{k}" for k, c in _FLAGS.items()) + " FROM x_mc) GROUP BY 1, 2", " ".join(f"pct_{k}" for k in _FLAGS))
sql("measure_coverage", """SELECT *, n_entities * 100e0 / (SELECT count(*) FROM x_sp) AS pct_entities, n_preindex * 100e0 / (SELECT count(*) FROM x_sp) AS pct_preindex FROM (
  SELECT measure, count(DISTINCT id) AS n_entities, count(DISTINCT id) FILTER (t <= 0) AS n_preindex, count(*) AS n_rows FROM x_m GROUP BY 1)""", "pct_entities pct_preindex")
sql("event_overview", """SELECT count(*) FILTER (first) AS n_with_event, avg(CASE WHEN kind = 'closed' THEN 1e0 ELSE 0e0 END) * 100 AS pct_closed, avg(CASE WHEN kind = 'open' THEN 1e0 ELSE 0e0 END) * 100 AS pct_open,
  count(*) FILTER (first) * 100e0 / (SELECT count(*) FROM x_sp) AS pct_with_event FROM x_flags""", "pct_closed pct_open pct_with_event")
sql("count_of_counts", "SELECT n_events, count(*) AS n_entities FROM (SELECT id, count(*) AS n_events FROM x_log GROUP BY id) GROUP BY 1")
CTE["x_pl"] = "SELECT unnest(['acctbal', 'death', 'study_end', 'switch_t']) AS variable, unnest([acctbal, death, study_end, switch_t]) AS value FROM x_sp LEFT JOIN x_sw USING (id)"
sql("profile_table", """SELECT variable, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS p0, quantile_cont(value, 0.25e0) AS p25,
  quantile_cont(value, 0.5e0) AS p50, quantile_cont(value, 0.75e0) AS p75, max(value) AS p100, count(value) / count(*)::DOUBLE AS complete_rate FROM x_pl GROUP BY 1""", "mean sd p0 p25 p50 p75 p100 complete_rate")
CTE["x_pt"] = "SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS variable, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders"
sql("profile_text", """SELECT variable, n, n_missing, n_distinct, top_counts FROM (SELECT variable, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(DISTINCT value) AS n_distinct FROM x_pt GROUP BY 1)
  JOIN (SELECT variable, string_agg(value || ': ' || k, ', ' ORDER BY k DESC, value) AS top_counts FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY k DESC, value) AS r FROM (
    SELECT variable, value, count(*) AS k FROM x_pt WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE r <= 4 GROUP BY 1) USING (variable)""")
_M6 = ["AF", "AO", "NF", "NO", "RF", "RO"]
CTE["x_cw"] = "SELECT id, month, " + ", ".join(f"max(CASE WHEN measure = '{m}' THEN value END) AS {m}" for m in _M6) + """ FROM (
  SELECT *, row_number() OVER (PARTITION BY id, month, measure ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, value) AS r FROM (SELECT *, floor(t / 90)::BIGINT AS month FROM x_m)) WHERE r = 1 GROUP BY 1, 2"""
sql("measure_corr", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, CASE WHEN NOT isnan(corr({a}, {b})) THEN corr({a}, {b}) END AS r FROM x_cw"
    for i, a in enumerate(_M6) for b in _M6[i + 1 :]), "r")
sql("histogram", "SELECT kind, floor(t / 365.25e0 / 0.25e0)::BIGINT AS bin, count(*) AS n FROM x_flags WHERE first GROUP BY 1, 2")
sql("histogram_equal", """SELECT measure, least(19, coalesce(floor((n - lo) * 20e0 / nullif(hi - lo, 0)), 0))::BIGINT AS bin, count(*) AS n FROM (
  SELECT *, min(n) OVER (PARTITION BY measure) AS lo, max(n) OVER (PARTITION BY measure) AS hi FROM (SELECT id, measure, count(*) AS n FROM x_m GROUP BY 1, 2)) GROUP BY 1, 2""")
CTE["x_ds"] = """SELECT *, 0.9e0 * least(sd, CASE WHEN q3 > q1 THEN (q3 - q1) / 1.34e0 END) * n ** -0.2e0 AS h FROM (
  SELECT measure, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25e0) AS q1, quantile_cont(value, 0.75e0) AS q3 FROM x_m GROUP BY 1)"""
CTE["x_db"] = """SELECT measure, n, lo, hi, h, k, (cell + 0.5e0) / 8 + m AS mean, greatest(q - m * m, 0) AS m2 FROM (
  SELECT measure, n, lo, hi, h, cell, count(*) AS k, avg(u - (cell + 0.5e0) / 8) AS m, avg((u - (cell + 0.5e0) / 8) * (u - (cell + 0.5e0) / 8)) AS q FROM (
    SELECT *, floor(u * 8)::BIGINT AS cell FROM (SELECT measure, n, lo, hi, h, (value - lo) / h AS u FROM x_m JOIN x_ds USING (measure))) GROUP BY ALL)"""
sql("density_curve", """SELECT measure, point, x, sum(CASE WHEN abs(z) <= 6 THEN k * exp(-0.5e0 * z * z) * (1 + (z * z - 1) * m2 / 2) ELSE 0 END) / any_value(n * h) / sqrt(2 * pi()) AS density FROM (
  SELECT *, (hi - lo) / h * point / 511e0 - mean AS z, lo + (hi - lo) * point / 511e0 AS x FROM x_db, (SELECT unnest(range(512))::INT AS point)) GROUP BY 1, 2, 3""", "x density")

# sinks: what is read back
sql("partition_sink", "SELECT method, forecast, count(*) AS n, avg(metric) AS mean_metric FROM x_rg GROUP BY 1, 2", "mean_metric")
sql("bundle_sink", "SELECT id, segment, n_intervals FROM x_sp LEFT JOIN (SELECT id, count(*) AS n_intervals FROM x_ti GROUP BY id) USING (id)")
sql("curve_sink", """SELECT model AS feature, threshold, count(*) FILTER (y = 1 AND score >= threshold) / count(*)::DOUBLE - count(*) FILTER (y = 0 AND score >= threshold) / count(*)::DOUBLE * (threshold / (1 - threshold)) AS net_benefit,
  avg(y) - (1 - avg(y)) * (threshold / (1 - threshold)) AS treat_all, 0e0 AS treat_none FROM x_sc, x_th GROUP BY 1, 2""", "threshold net_benefit treat_all")
sql("materialize", "SELECT * FROM x_lab", "event_t")

# models with given coefficients
CTE["x_hz"] = """SELECT x_ti.*, 0.2e0 * z - 0.1e0 * (segment = 'BUILDING')::INT + 0.3e0 * (treatment = 'switched')::INT AS lp FROM x_ti JOIN (
  SELECT id, segment, (acctbal - avg(acctbal) OVER ()) / stddev_pop(acctbal) OVER () AS z FROM x_sp) USING (id)"""
CTE["x_h0"] = """SELECT e.t, any_value(e.d) / sum(exp(x_hz.lp)) AS h FROM (SELECT "end" AS t, count(*)::DOUBLE AS d FROM x_hz WHERE event > 0 GROUP BY 1) e
  JOIN x_hz ON x_hz.start < e.t AND x_hz."end" >= e.t GROUP BY 1"""
sql("cox_predict_fixed", """SELECT x_st.id, x_st.start, x_st.eval_t, exp(-hz * exp(lp)) AS surv FROM x_st JOIN x_hz ON x_hz.id = x_st.id AND x_hz.start = x_st.start
  JOIN (SELECT g.eval_t, coalesce(sum(h), 0) AS hz FROM (SELECT DISTINCT eval_t FROM x_st) g LEFT JOIN x_h0 ON t <= g.eval_t GROUP BY 1) USING (eval_t)""", "start eval_t surv")
def newton(steps: int, ties: str = "efron", fitted: bool = False) -> str:
    """Newton's method for proportional hazards with three covariates, a step per table: the coefficient table, or the coefficients alone."""
    share = "unnest(range(d::BIGINT)) / d" if ties == "efron" else "0 * unnest(range(d::BIGINT))"
    ij = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"
    cof = lambda i, j: (lambda a, b: f"({h(a[0], b[0])} * {h(a[1], b[1])} - {h(a[0], b[1])} * {h(a[1], b[0])})" if (i + j) % 2 == 0 else f"({h(a[0], b[1])} * {h(a[1], b[0])} - {h(a[0], b[0])} * {h(a[1], b[1])})")(
        [k for k in (1, 2, 3) if k != i], [k for k in (1, 2, 3) if k != j]
    )
    det = " + ".join(f"h1{j} * {cof(1, j)}" for j in (1, 2, 3))
    sums = ["sum(w) AS s0"] + [f"sum(w * x{i}) AS s{i}" for i in (1, 2, 3)] + [f"sum(w * x{i} * x{j}) AS s{i}{j}" for i, j in ij]
    sums += ["sum(w * ev) AS e0"] + [f"sum(w * ev * x{i}) AS e{i}" for i in (1, 2, 3)] + [f"sum(w * ev * x{i} * x{j}) AS e{i}{j}" for i, j in ij]
    first = [f"(s{i} - u * e{i}) / r" for i in (1, 2, 3)]
    ctes = ["b0 AS MATERIALIZED (SELECT 0e0 AS b1, 0e0 AS b2, 0e0 AS b3)"]
    for k in range(steps):
        ctes.append(f"""s{k} AS MATERIALIZED (SELECT t, any_value(d) AS d, {", ".join(f"any_value(y{i}) AS y{i}" for i in (1, 2, 3))}, {", ".join(sums)} FROM (
          SELECT x_ce.*, x1, x2, x3, exp(b1 * x1 + b2 * x2 + b3 * x3) AS w, (event > 0 AND stop = t)::INT AS ev FROM x_ce JOIN x_cx ON start < t AND stop >= t, b{k}) GROUP BY t)""")
        ctes.append(f"""g{k} AS MATERIALIZED (SELECT {", ".join(f"(SELECT sum(y{i}) FROM s{k}) - sum({first[i - 1]}) AS g{i}" for i in (1, 2, 3))},
          {", ".join(f"sum((s{i}{j} - u * e{i}{j}) / r - {first[i - 1]} * {first[j - 1]}) AS h{i}{j}" for i, j in ij)} FROM (SELECT *, s0 - u * e0 AS r FROM (SELECT *, {share} AS u FROM s{k})))""")
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT {', '.join(f'b{i} + (' + ' + '.join(f'g{j} * {cof(i, j)}' for j in (1, 2, 3)) + f') / ({det}) AS b{i}' for i in (1, 2, 3))} FROM b{k}, g{k})")
    if fitted:
        return f"SELECT * FROM (WITH {', '.join(ctes)} SELECT b1, b2, b3 FROM b{steps})"
    tail = lambda z: f"1 - (SELECT sum(exp(n * ln(z2) - lgamma(2 * n + 2) + n * ln(2e0) + lgamma(n + 1))) FROM (SELECT unnest(range(200)) AS n, {z} * {z} AS z2)) * sqrt(2 / pi()) * abs({z}) * exp(-{z} * {z} / 2)"
    rows = " UNION ALL ".join(f"SELECT '{v}' AS variable, b{steps}.b{i} AS estimate, sqrt({cof(i, i)} / ({det})) AS se FROM b{steps}, g{steps - 1}" for i, v in enumerate(("acctbal", "building", "switched"), 1))
    return f"""SELECT variable, estimate, exp(estimate) AS hr, se, z, {tail("z")} AS p_value, abs(z) AS importance FROM (SELECT *, estimate / se AS z FROM (WITH {", ".join(ctes)} {rows}))"""


CTE["x_cx"] = """SELECT start, "end" AS stop, event, z AS x1, (segment = 'BUILDING')::INT::DOUBLE AS x2, (treatment = 'switched')::INT::DOUBLE AS x3 FROM x_ti
  JOIN (SELECT id, segment, (acctbal - avg(acctbal) OVER ()) / stddev_pop(acctbal) OVER () AS z FROM x_sp) USING (id)"""
CTE["x_ce"] = "SELECT stop AS t, count(*)::DOUBLE AS d, sum(x1) AS y1, sum(x2) AS y2, sum(x3) AS y3 FROM x_cx WHERE event > 0 GROUP BY 1"
sql("cox_fit", newton(8), "estimate hr se z p_value importance")
CTE["x_bb"] = newton(8, "breslow", fitted=True)
CTE["x_hb"] = """SELECT id, start, "end", event, b1 * z + b2 * (segment = 'BUILDING')::INT + b3 * (treatment = 'switched')::INT AS lp FROM x_ti
  JOIN (SELECT id, segment, (acctbal - avg(acctbal) OVER ()) / stddev_pop(acctbal) OVER () AS z FROM x_sp) USING (id), x_bb"""
CTE["x_b0"] = """SELECT e.t, any_value(e.d) / sum(exp(x_hb.lp)) AS h FROM (SELECT "end" AS t, count(*)::DOUBLE AS d FROM x_hb WHERE event > 0 GROUP BY 1) e
  JOIN x_hb ON x_hb.start < e.t AND x_hb."end" >= e.t GROUP BY 1"""
sql("cox_predict", """SELECT x_st.id, x_st.start, x_st.eval_t, exp(-hz * exp(lp)) AS surv FROM x_st JOIN x_hb ON x_hb.id = x_st.id AND x_hb.start = x_st.start
  JOIN (SELECT g.eval_t, coalesce(sum(h), 0) AS hz FROM x_t g LEFT JOIN x_b0 ON t <= g.eval_t GROUP BY 1) USING (eval_t)""", "start eval_t surv")
sql("asof_at_event_times", """SELECT id, start, fu AS follow_up, t AS eval_t FROM (
  SELECT *, lead(start) OVER (PARTITION BY id ORDER BY start, "end") AS nxt, max("end") OVER (PARTITION BY id) AS fu FROM x_ti) i JOIN x_et ON start <= t AND (nxt IS NULL OR t < nxt)""", "start follow_up eval_t")
CTE["x_ste"] = """SELECT i.* EXCLUDE (rn), t AS eval_t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start DESC, "end" DESC) AS rn FROM x_ti) i JOIN x_et ON t >= start AND (rn = 1 OR t < "end")"""
sql("stitch_at_event_times", "SELECT id, start, eval_t FROM x_ste", "start eval_t")
CTE["x_he"] = """SELECT g.t AS eval_t, coalesce(sum(h), 0) AS hz FROM x_et g LEFT JOIN x_h0 ON x_h0.t <= g.t GROUP BY 1"""
sql("cox_predict_event_times", """SELECT x_ste.id, x_ste.start, x_ste.eval_t, exp(-hz * exp(lp)) AS surv FROM x_ste JOIN x_hz ON x_hz.id = x_ste.id AND x_hz.start = x_ste.start JOIN x_he ON x_he.eval_t = x_ste.eval_t""", "start eval_t surv")
# a replicate permutes rows (for switched) and entities (for the others); -1 is the table as it is
CTE["x_pr"] = """SELECT id, start, event, CASE WHEN treatment = 'switched' THEN 2 ELSE 1 END AS k, (segment = 'BUILDING')::INT AS building, (treatment = 'switched')::INT AS switched, z,
  lead(start) OVER (PARTITION BY id ORDER BY start, "end") AS nxt, max("end") OVER (PARTITION BY id) AS follow_up
  FROM x_ti JOIN (SELECT id, segment, (acctbal - avg(acctbal) OVER ()) / stddev_pop(acctbal) OVER () AS z FROM x_sp) USING (id)"""
CTE["x_pe"] = "SELECT DISTINCT id, z, building FROM x_pr"
CTE["x_pp"] = f"""SELECT t.*, s.switched AS switched_m, se.z AS z_m, se.building AS building_m FROM (
    SELECT x_pr.*, replicate, row_number() OVER (PARTITION BY replicate ORDER BY id, k) AS pos FROM x_pr, range(1, 4) r(replicate)) t
  JOIN (SELECT switched, replicate, row_number() OVER (PARTITION BY replicate ORDER BY {uniform("'11'", 'permute', 'replicate', 'id', 'k::VARCHAR')}, id, k) AS pos FROM x_pr, range(1, 4) r(replicate)) s USING (replicate, pos)
  JOIN (SELECT id, replicate, row_number() OVER (PARTITION BY replicate ORDER BY id) AS epos FROM x_pe, range(1, 4) r(replicate)) e USING (id, replicate)
  JOIN (SELECT z, building, replicate, row_number() OVER (PARTITION BY replicate ORDER BY {uniform("'11'", 'permute', 'replicate', 'id')}, id) AS epos FROM x_pe, range(1, 4) r(replicate)) se USING (replicate, epos)"""
CTE["x_pv"] = """SELECT id, start, nxt, follow_up, event, replicate, 'acctbal' AS variable, 0.2e0 * z_m - 0.1e0 * building + 0.3e0 * switched AS lp FROM x_pp
  UNION ALL SELECT id, start, nxt, follow_up, event, replicate, 'building', 0.2e0 * z - 0.1e0 * building_m + 0.3e0 * switched FROM x_pp
  UNION ALL SELECT id, start, nxt, follow_up, event, replicate, 'switched', 0.2e0 * z - 0.1e0 * building + 0.3e0 * switched_m FROM x_pp
  UNION ALL SELECT id, start, nxt, follow_up, event, 0, 'none', 0.2e0 * z - 0.1e0 * building + 0.3e0 * switched FROM x_pr"""
CTE["x_h5"] = "SELECT eval_t, coalesce(sum(h), 0) AS hz FROM x_t LEFT JOIN x_h0 ON t <= eval_t GROUP BY 1"
CTE["x_ps5"] = "SELECT x_pv.*, eval_t, -exp(-hz * exp(lp)) AS risk FROM x_pv JOIN x_h5 ON start <= eval_t AND (nxt IS NULL OR eval_t < nxt)"
CTE["x_pc"] = concordance("x_ps5", "variable, replicate, eval_t", "follow_up", "eval_t")
sql("permutation_importance_fixed", """SELECT variable, avg(b.c_index - p.c) AS importance, count(*) AS n_times FROM (
    SELECT variable, eval_t, avg(c_index) AS c FROM x_pc WHERE variable <> 'none' GROUP BY 1, 2) p
  JOIN (SELECT eval_t, c_index FROM x_pc WHERE variable = 'none') b USING (eval_t) WHERE b.c_index IS NOT NULL GROUP BY 1""", "importance")
_Z = "({0} - avg({0}) OVER ()) / (CASE WHEN stddev_pop({0}) OVER () > 0 THEN stddev_pop({0}) OVER () ELSE 1 END)"
_FORMULA = [(c, _Z.format(f"{c}::DOUBLE")) for c in ("acctbal", "study_end", "n_prior")] + [("switch", "switch::DOUBLE")]
_FORMULA += [(f"segment_{v}", f"(segment = '{v}')::INT::DOUBLE") for v in _SEG]
sql("formula_expand", " UNION ALL ".join(f"SELECT id, {i}::INT AS position, '{n}' AS name, {e} AS value FROM x_mc" for i, (n, e) in enumerate(_FORMULA)), "value")
