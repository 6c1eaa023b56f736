"""Queries of learned models, decisions and inference, and their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom import queries as Q
from weekloom.operators import boosting, features, forest, inference, labeling, metrics, portfolio, scoring, trees
from weekloom.plans import backtest, decisions
from weekloom.queries import query, r6
from weekloom.sources import adapters as A
from weekloom.sources import models
from weekloom.sources.shared import shared_dir, written

# ---------------------------------------------------------------- given models
#: Small ensembles: (model, tree, node, feature, threshold, left, right, value).
MOMENTUM = [
    ("momentum", 0, 0, 4, 0.02, 1, 2, None), ("momentum", 0, 1, 2, -0.01, 3, 4, None), ("momentum", 0, 2, None, None, None, None, 0.21),
    ("momentum", 0, 3, None, None, None, None, -0.3), ("momentum", 0, 4, None, None, None, None, 0.05),
    ("momentum", 1, 0, 0, 0.0, 1, 2, None), ("momentum", 1, 1, None, None, None, None, -0.07), ("momentum", 1, 2, None, None, None, None, 0.11),
    ("momentum:click", 0, 0, 3, 0.05, 1, 2, None), ("momentum:click", 0, 1, None, None, None, None, 0.4), ("momentum:click", 0, 2, None, None, None, None, -0.4),
]
COMPOSITE = [
    ("composite", 0, 0, 0, 0.0, 1, 2, None), ("composite", 0, 1, 3, 30.0, 3, 4, None), ("composite", 0, 2, None, None, None, None, 0.9),
    ("composite", 0, 3, None, None, None, None, -0.8), ("composite", 0, 4, None, None, None, None, -1.7), ("composite", 1, 0, 1, 0.25, 1, 2, None),
    ("composite", 1, 1, None, None, None, None, 0.2), ("composite", 1, 2, None, None, None, None, 0.4),
]


def _isolation(counts: Sequence[float]) -> list[tuple]:
    """Three trees over five counts and five heats; leaves hold path lengths."""
    low, high = counts
    leaf = lambda t, i, v: ("isolation", t, i, None, None, None, None, v)
    return [
        ("isolation", 0, 0, 0, high, 1, 2, None), ("isolation", 0, 1, 4, low, 3, 4, None), leaf(0, 2, 1.0), leaf(0, 3, 2.0), ("isolation", 0, 4, 7, 0.01, 5, 6, None), leaf(0, 5, 9.5), leaf(0, 6, 8.0),
        ("isolation", 1, 0, 5, -0.02, 1, 2, None), leaf(1, 1, 4.5), ("isolation", 1, 2, 2, high, 3, 4, None), leaf(1, 3, 10.25), leaf(1, 4, 2.0),
        ("isolation", 2, 0, 9, 0.03, 1, 2, None), ("isolation", 2, 1, 3, low, 3, 4, None), leaf(2, 2, 3.0), leaf(2, 3, 3.5), leaf(2, 4, 11.0),
    ]


ISOLATION = _isolation((20.0, 60.0))


def _stored(spark: SparkSession, rows: list[tuple], name: str) -> DataFrame:
    """The nodes as a model of the shared folder gives them."""
    root = f"{shared_dir(spark)}/weekloom/models"
    return models.load(spark, root, name, models.save(spark.createDataFrame(rows, trees.NODES), root, name))


def _tree_sql(rows: list[tuple], columns: Sequence[str]) -> str:
    """A sum of trees as nested conditions."""
    found: dict = {}
    for _, t, i, f, threshold, left, right, v in rows:
        found.setdefault(t, {})[i] = f, threshold, left, right, v

    def at(tree: dict, i: int) -> str:
        f, threshold, left, right, v = tree[i]
        return f"{v!r}::double" if f is None else f"CASE WHEN {columns[f]} <= {threshold!r}::double THEN {at(tree, left)} ELSE {at(tree, right)} END"

    return "(" + " + ".join(at(t, 0) for _, t in sorted(found.items())) + ")"


# ---------------------------------------------------------------- isolation forest
_WINDOWS = Q.DAILY + """, w AS (SELECT period, industry, rn, n, """ + ", ".join(f"lead(v,{k}) OVER o AS c{k}, lead(coalesce(ht,0e0),{k}) OVER o AS h{k}" for k in range(5)) + " FROM ch WINDOW o AS (PARTITION BY industry ORDER BY period)), win AS (SELECT * FROM w WHERE rn < n-10)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.isolation_windows(features.changes(Q._daily(spark, sf_dir)).fillna(0.0, ["news_heat"]))


@query(f"""WITH {_WINDOWS}, s AS (SELECT period, industry, pow(2e0, -({_tree_sql(ISOLATION, [*(f'c{k}' for k in range(5)), *(f'h{k}' for k in range(5))])})/3/{forest.average_path(256)!r}) score FROM win),
b AS (SELECT cast(floor(score*10000) AS int) b, count(*) n FROM s GROUP BY 1), a AS (SELECT b, sum(n) OVER (ORDER BY b DESC) above, sum(n) OVER () total FROM b),
cut AS (SELECT max(b)/10000e0 c FROM a WHERE above >= 0.1e0*total)
SELECT period, industry, round(score,6) score, round(c-score,6)+0e0 decision, (score>=c)::int anomaly FROM s CROSS JOIN cut""")
def isolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of counts and heats scored by a stored forest, and the cut at a tenth of them."""
    windows = _windows(spark, sf_dir)
    nodes = _stored(spark, ISOLATION, "isolation")
    scored = written(trees.with_model(windows, nodes, "isolation", "trees").withColumn("score", forest.score(F.col("trees"), F.col("features"))).drop("trees", "features"), "scored")
    at = forest.cutoff(scored, 0.1)
    return r6(scored.select("period", "industry", "score", (F.lit(at) - F.col("score")).alias("decision"), (F.col("score") >= at).cast("int").alias("anomaly")), "score", "decision")


@query()
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest grown on the price changes of all line items, and the items it isolates."""
    line = A.table(spark, sf_dir, "lineitem")
    x = F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    rows = line.select("l_orderkey", "l_linenumber", x.alias("features"))
    cfg = forest.ForestConfig()
    nodes = written(forest.fit(rows, ("l_orderkey", "l_linenumber"), cfg), "forest")
    return forest.anomalies(rows, nodes, cfg).where("anomaly").select("l_orderkey", "l_linenumber", "score", "decision")


# ---------------------------------------------------------------- boosted trees
@query()
def boosted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for the price of a line item, grown on earlier orders and stopped on later ones, and their error."""
    line = A.table(spark, sf_dir, "lineitem")
    x = F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")), (F.col("l_partkey") % 1000).cast("double"))
    rows = line.select("l_orderkey", "l_linenumber", x.alias("features"), F.log("l_extendedprice").alias("y"), F.when(F.pmod(F.xxhash64("l_orderkey"), F.lit(5)) != 0, True).otherwise(False).alias("train"))
    rows = written(rows, "items")
    nodes, losses = boosting.fit(rows, boosting.BoostConfig(n_estimators=12, learning_rate=0.3, stopping_rounds=3), "prices")
    found = boosting.predicted(rows, written(nodes, "prices"), "prices")
    error = F.pow(F.col("prediction") - F.col("y"), F.lit(2))
    return found.groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mse"), F.var_pop("y").alias("variance"), F.lit(len(losses)).alias("trees"))


# ---------------------------------------------------------------- learned scores
_DATES = ("2024-01-03", "2024-01-08", "2024-01-25")


def _learned_sql(date: str) -> str:
    seq = [f"s{k}" for k in range(5, 0, -1)]
    own = [r for r in MOMENTUM if r[0] == "momentum:click"]
    common = [r for r in MOMENTUM if r[0] == "momentum"]
    last = ", ".join(f"max(CASE WHEN k={k} THEN s END) s{k}" for k in range(1, 11))
    return f"""SELECT date'{date}' as_of, f.industry, round(CASE WHEN n>=5 THEN lm ELSE m END,6)+0e0 momentum_score, round(CASE WHEN n>=5 THEN lh ELSE h END,6)+0e0 heat_anomaly,
 round(CASE WHEN n>=6 THEN greatest(-1e0,least(1e0,{_tree_sql(COMPOSITE, ['(s1-s6)', 'lh', '0e0', 'v1'])})) WHEN n>=5 THEN lm ELSE m*h END,6)+0e0 composite_score,
 CASE WHEN CASE WHEN n>=5 THEN lm ELSE m END>0.1e0 THEN 1 WHEN CASE WHEN n>=5 THEN lm ELSE m END<-0.1e0 THEN -1 ELSE 0 END trend_direction
FROM (SELECT i.industry, CASE WHEN g.m IS NULL THEN 0e0 ELSE greatest(-1e0,least(1e0,g.m)) END m, CASE WHEN g.m IS NULL THEN 0e0 ELSE CASE WHEN g.h IS NOT NULL THEN greatest(0e0,least(1e0,g.h/5)) END END h FROM (SELECT DISTINCT event_type industry FROM events UNION SELECT 'nothing') i
  LEFT JOIN (SELECT industry, avg(s) FILTER (k<=5) m, avg(ht) FILTER (k<=5) h FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY period DESC) k FROM ch WHERE period <= date'{date}') GROUP BY 1) g ON g.industry=i.industry) f
LEFT JOIN (SELECT *, CASE WHEN industry='click' THEN {_tree_sql(own, seq)} ELSE {_tree_sql(common, seq)} END lm, CASE WHEN n>=10 THEN 0e0 ELSE 0.5e0 END lh
  FROM (SELECT industry, count(*) n, max(CASE WHEN k=1 THEN v END) v1, {last} FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY period DESC) k FROM ch WHERE period <= date'{date}') WHERE k<=10 GROUP BY 1)) l ON l.industry=f.industry"""


@query(f"WITH {Q.DAILY} " + " UNION ALL ".join(_learned_sql(d) for d in _DATES))
def learned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all industries by stored ensembles, on dates with too few rows, with few, and with enough."""
    series = written(features.changes(Q._daily(spark, sf_dir)), "series")
    listed = written(A.table(spark, sf_dir, "events").select(F.col("event_type").alias("industry")).distinct().union(spark.range(1).select(F.lit("nothing"))), "industries")
    nodes = _stored(spark, MOMENTUM + COMPOSITE + ISOLATION, "signals")
    found = None
    for d in _DATES:
        rows = scoring.learned_scores(series, listed, nodes, d).withColumn("as_of", F.lit(d).cast("date"))
        found = rows if found is None else found.unionByName(rows)
    return r6(found, "momentum_score", "heat_anomaly", "composite_score")


# ---------------------------------------------------------------- normality
def _poly_sql(x: str, coefficients: Sequence[float]) -> str:
    out = f"{float(coefficients[0])!r}::double"
    for c in coefficients[1:]:
        out = f"(({out})*({x})+({float(c)!r}))"
    return out


def _quantile_sql(p: str) -> str:
    from weekloom.functions import normal as N

    q = f"(({p})-0.5e0)"
    tail = lambda x: (lambda t: f"({_poly_sql(t, N._TAIL_UP)})/({_poly_sql(t, N._TAIL_DOWN)})")(f"sqrt(-2e0*ln({x}))")
    return f"CASE WHEN ({p})<{N._TAIL} THEN {tail(p)} WHEN ({p})>1-{N._TAIL} THEN -{tail(f'(1-({p}))')} ELSE {q}*({_poly_sql(f'{q}*{q}', N._MID_UP)})/({_poly_sql(f'{q}*{q}', N._MID_DOWN)}) END"


def _upper_sql(z: str) -> str:
    from weekloom.functions import normal as N

    return f"CASE WHEN ({z})>37 THEN 0e0 WHEN ({z})>0 THEN exp(-({z})*({z})/2)*({_poly_sql(f'({z})', N._UP)})/({_poly_sql(f'({z})', N._DOWN)}) ELSE 1-exp(-({z})*({z})/2)*({_poly_sql(f'abs({z})', N._UP)})/({_poly_sql(f'abs({z})', N._DOWN)}) END"


@query(f"""WITH {Q._A7}, e AS (SELECT y_true-y_pred x FROM a7 ORDER BY day_no, doc_id LIMIT 5000), o AS (SELECT x, row_number() OVER (ORDER BY x) i, count(*) OVER () n FROM e),
q AS (SELECT *, {_quantile_sql('(i-0.375e0)/(n+0.25e0)')} m FROM o), s AS (SELECT sum(m*m) mm, max(m) m1, max(m) FILTER (i=n-1) m2, avg(x) mean, 1/sqrt(max(n)) u FROM q),
a AS (SELECT *, {_poly_sql('u', (*metrics._LAST, 0.0))}+m1/sqrt(mm) a1, {_poly_sql('u', (*metrics._LAST_BUT_ONE, 0.0))}+m2/sqrt(mm) a2 FROM s),
f AS (SELECT *, sqrt((mm-2*m1*m1-2*m2*m2)/(1-2*a1*a1-2*a2*a2)) phi FROM a),
w AS (SELECT max(n) n, pow(sum(CASE WHEN i IN (1,n) THEN sign(m)*a1 WHEN i IN (2,n-1) THEN sign(m)*a2 ELSE m/phi END*x),2)/sum(pow(x-mean,2)) w FROM q CROSS JOIN f),
z AS (SELECT *, (ln(1-w)-({_poly_sql('ln(n)', metrics._LARGE_MEAN)}))/exp({_poly_sql('ln(n)', metrics._LARGE_SCALE)}) z FROM w)
SELECT n, round(w,6) w, round({_upper_sql('z')},6)+0e0 p FROM z""")
def residual_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapiro-Wilk of the first 5000 residuals."""
    rows = A.evaluation(spark, sf_dir).withColumn("e", F.col("y_true") - F.col("y_pred"))
    return r6(metrics.shapiro_wilk(rows, "e", ("day_no", "doc_id")), "w", "p")


# ---------------------------------------------------------------- decisions
def _chain(d: str, x: str) -> str:
    """The backtest of the decisions ``d``, its steps named with ``x``; it needs weeks and wr."""
    return f"""t0{x} AS (SELECT ws, industry, CASE WHEN action IN ('buy','hold') AND weight>0 THEN weight ELSE 0e0 END w FROM {d}),
tt{x} AS (SELECT ws, industry, w/CASE WHEN sum(w) OVER (PARTITION BY ws)>1 THEN sum(w) OVER (PARTITION BY ws) ELSE 1e0 END w FROM t0{x}),
h{x} AS (SELECT ws, industry, w FROM tt{x} WHERE w>0.001e0), mv{x} AS (SELECT ws, industry, w FROM tt{x} WHERE w>0 UNION ALL SELECT e.ws, hh.industry, -hh.w FROM e JOIN h{x} hh ON hh.ws=e.pe WHERE e.has=1),
c{x} AS (SELECT ws, sum(abs(dw))*0.0008e0 cost FROM (SELECT ws, industry, sum(w) dw FROM mv{x} GROUP BY 1,2) y GROUP BY ws),
hw{x} AS (SELECT e.ws, hh.industry, hh.w FROM e JOIN h{x} hh ON hh.ws=e.pe), rr{x} AS (SELECT k.ws, sum(k.w*wr.r) r, sum(k.w) iw FROM hw{x} k JOIN wr ON wr.ws=k.ws AND wr.industry=k.industry GROUP BY 1),
g{x} AS (SELECT e.ws, coalesce(k.r,0e0) r, coalesce(cc.cost,0e0) cost FROM e LEFT JOIN rr{x} k ON k.ws=e.ws LEFT JOIN c{x} cc ON cc.ws=e.ws),
n{x} AS (SELECT ws, r, cost, 1e6 * product(1+r) OVER (ORDER BY ws ROWS UNBOUNDED PRECEDING) * coalesce(product(1-cost) OVER (ORDER BY ws ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1e0) nav FROM g{x})"""


@query(f"""WITH {Q.BT}, run AS (SELECT ws, r, sum((r>=0)::int) OVER (ORDER BY ws) k FROM g), len AS (SELECT ws, CASE WHEN r<0 THEN sum((r<0)::int) OVER (PARTITION BY k ORDER BY ws) ELSE 0 END n FROM run),
lose AS (SELECT ws, coalesce(lag(n) OVER (ORDER BY ws),0) losing FROM len),
a6c AS (SELECT a6.ws, a6.industry, action, CASE WHEN losing>=2 AND action IN ('buy','hold') AND weight>0
  THEN 0.8e0*weight/greatest(1e0, sum(CASE WHEN action IN ('buy','hold') AND weight>0 THEN weight ELSE 0e0 END) OVER (PARTITION BY a6.ws)) ELSE weight END weight FROM a6 JOIN lose ON lose.ws=a6.ws),
{_chain('a6c', '_c')}
SELECT n_c.ws, cast(losing AS int) losing, round(n_c.r,8) weekly_return, round(n_c.nav,2) nav FROM n_c JOIN lose ON lose.ws=n_c.ws""")
def losing_streak_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest with its weights cut by a fifth after two losing weeks."""
    daily, weekly, decided = market = Q._market(spark, sf_dir)
    plain = Q._records(spark, sf_dir, market).select("ws", F.col("weekly_return").alias("r"))
    cut = written(portfolio.cut_after_losses(decided, plain), "cut")
    found = backtest.run(daily, cut, scale=0.01, industry_returns=weekly).join(portfolio.losing_runs(plain), "ws")
    return r6(r6(found.select("ws", "losing", "weekly_return", "nav"), "weekly_return", places=8), "nav", places=2)


def _check_sql(d: str, x: str) -> str:
    """Violations of the decisions ``d``, and a row of flags for each week that has any."""
    return f"""b{x} AS (SELECT q.*, coalesce(beta,'medium') beta, coalesce(cl,industry) cl FROM {d} q LEFT JOIN tx ON small=industry WHERE action='buy'),
v{x} AS (SELECT ws, 'max_weight' AS r, industry AS s, weight AS v FROM b{x} WHERE weight>0.3e0 UNION ALL SELECT ws, 'max_total', 'all', sum(weight) FROM b{x} GROUP BY ws HAVING sum(weight)>1
UNION ALL SELECT q.ws, 'beta', q.industry, g.r FROM b{x} q JOIN g ON g.ws=q.ws AND g.r<0 WHERE beta='very_high' AND weight<>0 AND NOT EXISTS (SELECT 1 FROM hw WHERE hw.ws=q.ws AND hw.industry=q.industry)
UNION ALL SELECT ws, 'mirror', cl, cast(count(*) AS double) FROM b{x} WHERE weight>=0.15e0 AND cl<>'unknown' GROUP BY 1,3 HAVING count(*)>=2),
f{x} AS (SELECT ws, bool_or(r='max_weight') mw, bool_or(r='max_total') mt, bool_or(r='mirror') mi, max(v) FILTER (r='max_total') total, CASE WHEN bool_or(r<>'beta') THEN 'trader' ELSE 'researcher' END route FROM v{x} GROUP BY ws)"""


def _revise_sql(d: str, x: str) -> str:
    heavy = f"(action='buy' AND weight>=0.15e0 AND EXISTS (SELECT 1 FROM v{x} m WHERE m.ws=q.ws AND m.r='mirror' AND m.s=coalesce(cl,industry)))"
    return f"""o{x} AS (SELECT q.ws, industry, action, weight, mw, mt, mi, total, {heavy} hv, row_number() OVER (PARTITION BY q.ws, coalesce(cl,industry), {heavy} ORDER BY weight DESC, industry) k,
  action='buy' AND EXISTS (SELECT 1 FROM v{x} m WHERE m.ws=q.ws AND m.r='beta' AND m.s=industry) be FROM {d} q JOIN f{x} f ON f.ws=q.ws LEFT JOIN tx ON small=industry),
d{x} AS (SELECT ws, industry, CASE WHEN be AND NOT mw AND NOT mt AND NOT mi THEN 'hold' ELSE action END action,
  CASE WHEN mw THEN CASE WHEN action='buy' THEN least(weight,0.3e0) ELSE weight END WHEN mt THEN CASE WHEN action='buy' THEN weight*0.99e0/total ELSE weight END
  WHEN mi THEN CASE WHEN hv AND k>1 THEN 0.1e0 ELSE weight END WHEN be THEN 0e0 ELSE weight END weight FROM o{x})"""


@query(f"""WITH {Q.BT}, tx AS (SELECT r_name small, CASE r_regionkey%2 WHEN 0 THEN 'very_high' ELSE 'low' END beta, CASE WHEN r_regionkey<3 THEN 'k' ELSE 'unknown' END cl FROM region),
{_check_sql('a6', '1')}, {_revise_sql('a6', '1')}, {_check_sql('d1', '2')}, {_revise_sql('d1', '2')}, {_check_sql('d2', '3')},
last AS (SELECT w.ws, CASE WHEN f1.ws IS NULL THEN 1 WHEN f2.ws IS NULL THEN 2 ELSE 3 END attempts, (f3.ws IS NOT NULL)::int forced, coalesce(f3.route,f2.route,f1.route,'end') route
  FROM (SELECT DISTINCT ws FROM a6) w LEFT JOIN f1 ON f1.ws=w.ws LEFT JOIN f2 ON f2.ws=w.ws LEFT JOIN f3 ON f3.ws=w.ws),
acc AS (SELECT a6.*, 1 t FROM a6 UNION ALL SELECT *, 2 FROM d1 UNION ALL SELECT *, 3 FROM d2)
SELECT l.ws, l.attempts, l.forced, l.route, count(*) FILTER (action='buy') n_buys, round(coalesce(sum(weight) FILTER (action='buy'),0e0),6) total_weight FROM last l JOIN acc ON acc.ws=l.ws AND acc.t=l.attempts GROUP BY 1,2,3,4""")
def decision_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every week's decisions through three checks at most, revised by rule."""
    k = F.col("r_regionkey")
    tax = A.table(spark, sf_dir, "region").select(F.col("r_name").alias("small_cat"), F.when(k % 2 == 0, "very_high").otherwise("low").alias("beta"), F.when(k < 3, "k").otherwise("unknown").alias("correlation_cluster"))
    market = Q._market(spark, sf_dir)
    decided = market[2]
    pnl = Q._records(spark, sf_dir, market).select("ws", F.col("weekly_return").alias("r"))
    held = written(portfolio.held_into(pnl.select("ws"), decided), "held")
    accepted, log = decisions.checked(decided, decisions.RuleProvider(decided, tax), tax, held, pnl)
    buys = accepted.groupBy("ws").agg(F.count(F.when(F.col("action") == "buy", 1)).alias("n_buys"), F.coalesce(F.sum(F.when(F.col("action") == "buy", F.col("weight"))), F.lit(0.0)).alias("total_weight"))
    return r6(log.join(buys, "ws").select("ws", "attempts", F.col("forced").cast("int").alias("forced"), "route", "n_buys", "total_weight"), "total_weight")


# ---------------------------------------------------------------- networks
_CHANNELS, _KERNEL, _TIME = 3, 3, 5


def _weight(*place: int) -> float:
    """Given weights, from a rule: between -0.6 and 0.6."""
    h = 0
    for p in place:
        h = (h * 31 + p + 7) % 1009
    return (h % 13 - 6) / 10


def _tcn_weights() -> dict:
    blocks = []
    for layer in range(2):
        n = 1 if layer == 0 else _CHANNELS
        conv = lambda which, width: [[[_weight(layer, which, o, k, i) for i in range(width)] for k in range(_KERNEL)] for o in range(_CHANNELS)]  # noqa: B023, E731
        block = {"w1": conv(1, n), "b1": [_weight(layer, 3, o) for o in range(_CHANNELS)], "w2": conv(2, _CHANNELS), "b2": [_weight(layer, 4, o) for o in range(_CHANNELS)]}
        blocks.append(block | {"down": [[_weight(layer, 5, o, i) for i in range(n)] for o in range(_CHANNELS)] if n != _CHANNELS else None, "down_b": [0.1] * _CHANNELS if n != _CHANNELS else None})
    head = lambda h: [{"w": [[_weight(9, h, o, i) for i in range(_CHANNELS)] for o in range(2)], "b": [0.05, -0.05]}, {"w": [[_weight(8, h, i) for i in range(2)]], "b": [0.02 * h]}]
    return {"blocks": blocks, "reg": head(1), "cls": head(2)}


def _tcn_sql(source: str, inputs: Sequence[str]) -> str:
    """The network written out, a step a table: columns x{t}_{c}."""
    w, steps, name = _tcn_weights(), [], source
    cell = {(t, 0): x for t, x in enumerate(inputs)}
    for layer, b in enumerate(w["blocks"]):
        d = 2**layer
        for which in (1, 2):
            ws, bs = b[f"w{which}"], b[f"b{which}"]
            n = len(ws[0][0])
            prefix = f"y{layer}_{which}"
            columns = []
            for t in range(_TIME):
                for o in range(_CHANNELS):
                    terms = [f"({ws[o][k][i]!r}::double)*({(cell if which == 1 else mid)[t - (_KERNEL - 1 - k) * d, i]})" for k in range(_KERNEL) if t - (_KERNEL - 1 - k) * d >= 0 for i in range(n)]
                    columns.append(f"greatest(0e0, ({' + '.join(terms)}) + ({bs[o]!r}::double)) {prefix}_{t}_{o}")
            steps.append(f"{prefix} AS (SELECT *, {', '.join(columns)} FROM {name})")
            name, mid = prefix, {(t, o): f"{prefix}_{t}_{o}" for t in range(_TIME) for o in range(_CHANNELS)}
        columns = []
        for t in range(_TIME):
            for o in range(_CHANNELS):
                res = cell[t, o] if b["down"] is None else " + ".join(f"({v!r}::double)*({cell[t, i]})" for i, v in enumerate(b["down"][o])) + f" + {b['down_b'][o]!r}::double"
                columns.append(f"greatest(0e0, {mid[t, o]} + ({res})) z{layer}_{t}_{o}")
        steps.append(f"z{layer} AS (SELECT *, {', '.join(columns)} FROM {name})")
        name, cell = f"z{layer}", {(t, o): f"z{layer}_{t}_{o}" for t in range(_TIME) for o in range(_CHANNELS)}
    pooled = ", ".join(f"({' + '.join(cell[t, o] for t in range(_TIME))})/{_TIME} p{o}" for o in range(_CHANNELS))
    steps.append(f"pooled AS (SELECT *, {pooled} FROM {name})")

    def head(layers: list[dict]) -> str:
        hidden = [f"greatest(0e0, {' + '.join(f'({v!r}::double)*p{i}' for i, v in enumerate(row))} + ({b!r}::double))" for row, b in zip(layers[0]["w"], layers[0]["b"])]
        return " + ".join(f"({v!r}::double)*{h}" for v, h in zip(layers[1]["w"][0], hidden)) + f" + {layers[1]['b'][0]!r}::double"

    steps.append(f"heads AS (SELECT *, {head(w['reg'])} reg, {head(w['cls'])} cls FROM pooled)")
    return ",\n".join(steps)


@query(f"""WITH {Q.DAILY}, q AS (SELECT period, industry, rn, {', '.join(f'lag(s,{_TIME - k}) OVER w x{k}' for k in range(_TIME))} FROM ch WINDOW w AS (PARTITION BY industry ORDER BY period)), f AS (SELECT * FROM q WHERE rn>={_TIME}),
{_tcn_sql('f', [f'x{k}' for k in range(_TIME)])} SELECT period, industry, round((exp(2*reg)-1)/(exp(2*reg)+1),6)+0e0 momentum, round(1/(1+exp(-cls)),6) anomaly FROM heads""")
def tcn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum and anomaly of every lookback sequence by a temporal network of given weights."""
    rows = features.industry_sequences(Q._daily(spark, sf_dir), _TIME).select("period", "industry", F.transform("sequence", lambda v: F.array(v)).alias("x"))
    weights = spark.createDataFrame([(_tcn_weights(),)], f"model {inference.TCN}".replace("\n", ""))
    found = rows.withColumn("one", F.lit(1)).join(F.broadcast(weights.withColumn("one", F.lit(1))), "one")  # one row of a few hundred numbers
    return r6(found.select("period", "industry", inference.tcn(F.col("model"), F.col("x")).alias("y")).select("period", "industry", "y.*"), "momentum", "anomaly")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding[1:12], lambda x: x::double) z FROM embeddings),
m AS (SELECT *, [((label+i)%3>0)::int::double FOR i IN [0,1,2]] m FROM e), p AS (SELECT vec_id, m, [(m[1]*z[j]+m[2]*z[j+4]+m[3]*z[j+8])/greatest(list_sum(m),1e-9) FOR j IN [1,2,3,4]] p FROM m)
SELECT vec_id, round(p[1],6)+0e0 p0, round(p[2],6)+0e0 p1, round(p[3],6)+0e0 p2, round(p[4],6)+0e0 p3 FROM p""")
def masked_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three token vectors of four values, some masked."""
    z = F.col("embedding").cast("array<double>")
    h = F.array(*(F.slice(z, 4 * i + 1, 4) for i in range(3)))
    mask = F.array(*(((F.col("label") + i) % 3 > 0).cast("double") for i in range(3)))
    rows = A.table(spark, sf_dir, "embeddings").select("vec_id", inference.masked_mean(h, mask).alias("p"))
    return r6(rows.select("vec_id", *(F.col("p")[i].alias(f"p{i}") for i in range(4))), "p0", "p1", "p2", "p3")


# ---------------------------------------------------------------- labelling
_SIGNS = ("e", "n", "i", "u", "é")


def _layer(seed: int, n: int) -> tuple[list[list[float]], list[float]]:
    """Given weights of ``n`` classes over the features of a text."""
    return [[_weight(seed, o, i) for i in range(len(_SIGNS) + 1)] for o in range(n)], [_weight(seed, 77, o) for o in range(n)]


def _layer_sql(seed: int, n: int) -> str:
    w, b = _layer(seed, n)
    return "[" + ", ".join(" + ".join(f"({v!r}::double)*x[{i + 1}]" for i, v in enumerate(row)) + f" + ({c!r}::double)" for row, c in zip(w, b)) + "]"


_MAJORS, _MODELS = labeling.L1_CATEGORIES, 6
_SAFE = [m.replace("/", "_") for m in _MAJORS]
_L1 = "[" + ",".join(f"'{m}'" for m in _MAJORS) + "]"


@query(f"""WITH {Q.A2}, t AS (SELECT doc_id, CASE WHEN coalesce(title,'')<>'' AND coalesce(content,'')<>'' THEN concat(title,' [SEP] ',substring(content,1,256)) WHEN coalesce(content,'')<>'' THEN substring(content,1,256) ELSE '' END t FROM a2 WHERE NOT (title IS NULL AND content IS NULL)),
f AS (SELECT doc_id, [{', '.join(f"(length(t)-length(replace(t,'{c}','')))/10e0" for c in _SIGNS)}, length(t)/300e0] x FROM t),
l AS (SELECT doc_id, x, {_layer_sql(1, len(_MAJORS))} z, {_layer_sql(2, 3)} s FROM f),
m AS (SELECT *, list_position(z,list_max(z)) c, 1/list_sum(list_transform(z,lambda v: exp(v-list_max(z)))) p FROM l),
y AS (SELECT *, CASE c {' '.join(f'WHEN {k + 1} THEN {_layer_sql(10 + k, 4)}' for k in range(_MODELS))} END q FROM m)
SELECT doc_id, {_L1}[c] major_category, round_even(p,4) major_confidence, (ARRAY['negative','neutral','positive'])[list_position(s,list_max(s))] sentiment,
 CASE WHEN c=8 THEN '其他' WHEN q IS NULL THEN concat({_L1}[c],'-3') ELSE concat({_L1}[c],'-',least(list_position(q,list_max(q)),3)) END sub_category,
 round(CASE WHEN q IS NULL THEN 0e0 ELSE 1/list_sum(list_transform(q,lambda v: exp(v-list_max(q)))) END,6) sub_confidence FROM y""")
def news_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both phases of labelling from raw news: class and sentiment from given linear layers, then the class's own model for
    sub-categories (the last two classes have none; the last one has no labels either)."""
    news = labeling.selected(A.news_raw(spark, sf_dir))
    count = lambda c: (F.length("model_text") - F.length(F.replace("model_text", F.lit(c), F.lit("")))) / 10.0
    rows = news.select("doc_id", F.array(*map(count, _SIGNS), F.length("model_text") / 300.0).alias("x"))
    layer = lambda seed, n: inference.linear(*(F.lit(v) for v in _layer(seed, n)), F.col("x"))
    rows = rows.withColumn("z", layer(1, len(_MAJORS))).withColumn("s", layer(2, 3))
    rows = labeling.classified(labeling.classified(rows, "z", _MAJORS, "major", 4), "s", labeling.SENTIMENTS, "sentiment")
    given = {safe: _layer(10 + k, 4) for k, safe in enumerate(_SAFE[:_MODELS])}

    def load(name: str):
        if name not in given:
            return None
        import numpy as np

        return lambda part: inference.linear_rows(*given[name], np.stack(part["x"].to_list()))

    found = inference.routed(rows.select("doc_id", "major", "major_confidence", "sentiment", "x"), load, "doc_id")
    subs = spark.createDataFrame([(m, [f"{m}-{k}" for k in (1, 2, 3)]) for m in _MAJORS[:-1]], "major string, subs array<string>")
    found = labeling.sub_classified(found, subs)
    return r6(found.select("doc_id", F.col("major").alias("major_category"), "major_confidence", "sentiment", "sub_category", F.col("sub_category_confidence").alias("sub_confidence")), "sub_confidence")


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: A given vocabulary: special pieces, letters and their continuations, and short words and endings.
VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *".,;:!?#-/()", *_LETTERS, *(f"##{c}" for c in _LETTERS), "the", "and", "der", "die", "que", "##ing", "##er", "##en", "##tion", "##keit", "token", "##th", "un", "##and", "日"]


@query()
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, masks and types of all news texts, padded for a model of 64 pieces, with the batch of 32 that a row is in."""
    news = labeling.selected(A.news_raw(spark, sf_dir)).select("doc_id", "model_text")
    found = inference.token_batches(news, VOCABULARY, "model_text", 64).drop("model_text")
    return metrics.ranked(found, ("doc_id",)).select("doc_id", F.expr("(rank - 1) div 32").alias("batch"), "input_ids", "attention_mask", "token_type_ids")
