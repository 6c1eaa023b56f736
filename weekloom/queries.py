"""One query for each operator, over the driver's tables, and the SQL that must give its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.functions import exprs as X
from weekloom.functions import text as T
from weekloom.operators import calendar, features, labeling, metrics, portfolio, retrieval, returns, risk, scoring, sentiment, splits, taxonomy
from weekloom.plans import backtest
from weekloom.sources import adapters as A
from weekloom.sources import files
from weekloom.sources.shared import written

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in cols})


# ---------------------------------------------------------------- SQL of the adapters
A1 = """a1 AS (SELECT event_id, ts AS datetime, event_type AS major_category,
  CASE WHEN value<20 THEN 'negative' WHEN value<54 THEN 'neutral' ELSE 'positive' END AS sentiment,
  cast(json_extract_string(props,'$.k') AS double)/100 AS sentiment_confidence FROM events)"""
A2 = """a2 AS (SELECT doc_id, cast(date'2024-01-01'+cast(doc_id%30 AS int) AS date) AS d, split_part(text,chr(10),1) AS title,
  CASE WHEN doc_id%11=0 THEN NULL ELSE text END AS content, source FROM documents)"""
A3 = """a3 AS (SELECT r_name AS industry, n_name AS code, cast(l_shipdate AS date) AS d, avg(l_extendedprice/l_quantity) AS close
  FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2,3)"""
A4 = "a4 AS (SELECT p_partkey AS code, p_name AS name, p_type AS tracking_index, CASE WHEN p_partkey%97=0 THEN NULL ELSE p_retailprice END AS aum FROM part)"
A5 = """a5 AS (SELECT r_name AS large_cat, n_name AS small_cat, n_name AS index_name,
  CASE n_nationkey%4 WHEN 0 THEN 'very_high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS beta,
  CASE WHEN n_nationkey%7=6 THEN 'unknown' ELSE concat('c',cast(n_nationkey%7 AS varchar)) END AS correlation_cluster
  FROM nation JOIN region ON n_regionkey=r_regionkey)"""


def _bounds(end: str) -> str:
    return f"""cal AS (SELECT DISTINCT d FROM a3), wk AS (SELECT DISTINCT cast(date_trunc('week',d) AS date) ws FROM cal),
b AS (SELECT ws, max(CASE WHEN d<ws THEN d END) p, max(CASE WHEN {end} THEN d END) l FROM wk CROSS JOIN cal GROUP BY ws)"""


WEEK, DATA_END = "d>=ws AND d<ws+INTERVAL 7 DAY", "d>=ws"
WR = A3 + "," + _bounds(WEEK) + """,
wr AS (SELECT b.ws, c.industry, avg((c.close-q.close)/q.close)/100 r FROM b JOIN a3 c ON c.d=b.l JOIN a3 q ON q.d=b.p AND q.code=c.code GROUP BY 1,2)"""
A6 = WR + """,
a6 AS (SELECT ws, industry, CASE WHEN k<=3 THEN 'buy' WHEN k=4 THEN 'hold' ELSE 'sell' END AS action,
  CASE k WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.4e0 WHEN 3 THEN 0.3e0 WHEN 4 THEN 0e0 ELSE 0.2e0 END AS weight
  FROM (SELECT ws, industry, r, row_number() OVER (PARTITION BY ws ORDER BY r DESC, industry) k FROM wr) z WHERE day(ws)%5<>0)"""
BT = A6 + """,
weeks AS (SELECT ws FROM wk),
t0 AS (SELECT ws, industry, CASE WHEN action IN ('buy','hold') AND weight>0 THEN weight ELSE 0e0 END w FROM a6),
tt AS (SELECT ws, industry, w/CASE WHEN sum(w) OVER (PARTITION BY ws)>1 THEN sum(w) OVER (PARTITION BY ws) ELSE 1e0 END w FROM t0),
h AS (SELECT ws, industry, w FROM tt WHERE w>0.001e0),
e AS (SELECT weeks.ws, CASE WHEN q.ws IS NOT NULL THEN 1 ELSE 0 END has,
  max(q.ws) OVER (ORDER BY weeks.ws ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM weeks LEFT JOIN (SELECT DISTINCT ws FROM a6) q ON q.ws=weeks.ws),
mv AS (SELECT ws, industry, w FROM tt WHERE w>0 UNION ALL SELECT e.ws, h.industry, -h.w FROM e JOIN h ON h.ws=e.pe WHERE e.has=1),
c AS (SELECT ws, sum(abs(dw)) turnover, sum(abs(dw))*0.0008e0 cost FROM (SELECT ws, industry, sum(w) dw FROM mv GROUP BY 1,2) y GROUP BY ws),
hw AS (SELECT e.ws, h.industry, h.w FROM e JOIN h ON h.ws=e.pe),
rr AS (SELECT hw.ws, sum(hw.w*wr.r) r FROM hw JOIN wr ON wr.ws=hw.ws AND wr.industry=hw.industry GROUP BY 1),
g AS (SELECT e.ws, coalesce(rr.r,0e0) r, coalesce(c.cost,0e0) cost FROM e LEFT JOIN rr ON rr.ws=e.ws LEFT JOIN c ON c.ws=e.ws),
n AS (SELECT ws, r, cost, 1e6 * product(1+r) OVER (ORDER BY ws ROWS UNBOUNDED PRECEDING)
  * coalesce(product(1-cost) OVER (ORDER BY ws ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1e0) nav FROM g)"""
SC = A1 + """, sc AS (SELECT datetime, major_category AS industry, CASE sentiment WHEN 'positive' THEN 1e0 WHEN 'neutral' THEN 0e0 ELSE -1e0 END score, sentiment_confidence conf FROM a1)"""


def _agg(freq: str, name: str) -> str:
    return f"""{name} AS (SELECT cast(date_trunc('{freq}', datetime) AS date) AS period, industry, coalesce(sum(score*conf),0)/(coalesce(sum(conf),0)+1e-9) AS s, count(*) AS v FROM sc GROUP BY 1,2)"""


DAILY = SC + "," + _agg("day", "dd") + """,
dly AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY industry) AS n, lag(s) OVER w AS s1, lag(s,2) OVER w AS s2, lag(v) OVER w AS v1, lead(s) OVER w AS sn
  FROM dd WINDOW w AS (PARTITION BY industry ORDER BY period)),
ch AS (SELECT *, CASE WHEN s1 IS NOT NULL THEN greatest(-1e0, least(1e0, (s-s1)/(abs(s1)+1e-9))) END AS m, CASE WHEN v1 IS NOT NULL THEN greatest(-1e0, least(1e0, (v-v1)/(v1+1)::double)) END AS ht FROM dly)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.build(A.news_labeled(spark, sf_dir), "day")


# ---------------------------------------------------------------- returns
def _wir(end: str) -> str:
    return f"WITH {A3},{_bounds(end)} SELECT b.ws, c.industry, round(avg((c.close-q.close)/q.close),6) r, count(*) n FROM b JOIN a3 c ON c.d=b.l JOIN a3 q ON q.d=b.p AND q.code=c.code GROUP BY 1,2"


@query(_wir(WEEK))
def weekly_industry_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(returns.weekly_industry_returns(A.closes(spark, sf_dir)), "r")


@query(_wir(DATA_END))
def weekly_industry_return_end_of_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(returns.weekly_industry_returns(A.closes(spark, sf_dir), "end_of_data"), "r")


@query(f"WITH {WR}, i AS (SELECT r_name industry FROM region UNION SELECT 'NOWHERE') SELECT wk.ws, i.industry, round(coalesce(wr.r,0e0)*100,6) r FROM wk CROSS JOIN i LEFT JOIN wr ON wr.ws=wk.ws AND wr.industry=i.industry")
def weekly_industry_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = A.table(spark, sf_dir, "region").select(F.col("r_name").alias("industry")).union(spark.range(1).select(F.lit("NOWHERE")))
    return r6(returns.weekly_industry_grid(A.closes(spark, sf_dir), listed), "r")


@query(f"""WITH {A3}, g AS (SELECT code, cast(date_trunc('week',d) AS date) ws, min_by(close,d) week_open, max_by(close,d) week_close FROM a3 GROUP BY 1,2)
SELECT code, ws, round(week_open+1.23e-5,4) week_open, round(week_close+1.23e-5,4) week_close, round((week_close-week_open)/week_open+1.23e-6,5) weekly_return FROM g""")
def etf_weekly_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = returns.etf_weekly_return(A.prices(spark, sf_dir)).withColumns({c: F.col(c) + 1.23e-5 for c in ("week_open", "week_close")}).withColumn("weekly_return", F.col("weekly_return") + 1.23e-6)
    return r6(r6(rows, "week_open", "week_close", places=4), "weekly_return", places=5)  # shifted off the halves, which averages hit


@query(f"WITH {A3} SELECT code, d, round(close - lag(close,5) OVER (PARTITION BY code ORDER BY d)+1.23e-5,4) momentum FROM a3")
def price_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(returns.price_momentum(A.prices(spark, sf_dir)).select("code", "d", (F.col("momentum") + 1.23e-5).alias("momentum")), "momentum", places=4)


@query("SELECT cast(strftime(cast(l_shipdate AS date),'%Y%m%d') AS int) k, cast(min(cast(l_shipdate AS date)) AS date) d, count(*) n FROM lineitem GROUP BY 1")
def date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").groupBy(X.date_key(F.col("l_shipdate")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("k", X.from_date_key(F.col("k")).alias("d"), "n")


# ---------------------------------------------------------------- calendar
@query("SELECT cast(unnest(generate_series(date_trunc('week',min(cast(l_shipdate AS date)))::timestamp, max(cast(l_shipdate AS date))::timestamp, INTERVAL 7 DAY)) AS date) ws FROM lineitem")
def week_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Monday that the shipments span."""
    return calendar.weeks_of(A.table(spark, sf_dir, "lineitem"), "l_shipdate")


@query(f"WITH {A2} SELECT doc_id, d FROM a2 WHERE d BETWEEN date'2024-01-08' AND date'2024-01-14'")
def market_news_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.in_week(A.news_raw(spark, sf_dir), "d", "2024-01-08").select("doc_id", "d")


@query("SELECT count(*) n, max(cast(l_shipdate AS date)) last_day FROM lineitem WHERE cast(l_shipdate AS date) < (SELECT min(cast(l_shipdate AS date)) FROM lineitem) + INTERVAL 700 DAY")
def extract_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return calendar.first_weeks(rows, "d").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last_day"))


@query(f"WITH {BT} SELECT ws, has, pe AS previous FROM e")
def carry_forward_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = A.closes(spark, sf_dir)
    return calendar.previous_decisions(daily.select(X.week_start(F.col("d")).alias("ws")), A.decisions(daily))


# ---------------------------------------------------------------- sentiment
def _sent(freq: str) -> str:
    return f"WITH {SC},{_agg(freq, 't')} SELECT period, industry, round(s,6) sentiment_mean, v news_count FROM t"


@query(_sent("week"))
def weekly_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sentiment.build(A.news_labeled(spark, sf_dir), "week"), "sentiment_mean")


@query(_sent("day"))
def daily_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_daily(spark, sf_dir), "sentiment_mean")


_GRID = SC + "," + _agg("day", "t")


@query(f"WITH {_GRID} SELECT p.period, i.industry, round(t.s,6) sentiment_mean, coalesce(t.v,0) news_count FROM (SELECT DISTINCT period FROM t) p CROSS JOIN (SELECT DISTINCT industry FROM t) i LEFT JOIN t ON t.period=p.period AND t.industry=i.industry")
def sentiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sentiment.grid(_daily(spark, sf_dir)), "sentiment_mean")


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"WITH {_GRID} SELECT period, " + ", ".join(f"round(max(CASE WHEN industry='{x}' THEN s END),6) AS \"{x}\"" for x in _TYPES) + " FROM t GROUP BY 1")
def sentiment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each event type that occurs."""
    wide = sentiment.pivoted(written(_daily(spark, sf_dir), "daily"))
    return r6(wide, *wide.columns[1:])


@query(f"WITH {_GRID} SELECT p.period, i.industry, round(t.s,6) sentiment_mean FROM (SELECT DISTINCT period FROM t) p CROSS JOIN (SELECT DISTINCT industry FROM t) i LEFT JOIN t ON t.period=p.period AND t.industry=i.industry")
def sentiment_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(sentiment.unpivoted(sentiment.pivoted(written(_daily(spark, sf_dir), "daily"))), "sentiment_mean")


@query(f"WITH {SC},{_agg('day', 't')} SELECT count(*) cells, count(DISTINCT period) periods, count(DISTINCT industry) industries, min(period) first_period, max(period) last_period FROM t")
def sentiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.summary(_daily(spark, sf_dir))


# ---------------------------------------------------------------- features
@query(f"WITH {DAILY} SELECT period, industry, round(m,6) momentum FROM ch")
def sentiment_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features.changes(_daily(spark, sf_dir)).select("period", "industry", "momentum"), "momentum")


@query(f"WITH {DAILY} SELECT period, industry, round(ht,6) news_heat FROM ch")
def news_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features.changes(_daily(spark, sf_dir)).select("period", "industry", "news_heat"), "news_heat")


@query(f"WITH {DAILY} SELECT period, industry, round(CASE WHEN rn=0 THEN v::double ELSE v/(v1+1)::double END,6) vol_norm, round(CASE WHEN rn=0 THEN s-s ELSE s-s1 END,6) sent_diff, round(s,6) sent_cur FROM ch")
def iforest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features.isolation_features(_daily(spark, sf_dir)), "vol_norm", "sent_diff", "sent_cur")


def _text(col: str, places: int = 4):
    return F.array_join(F.transform(col, lambda x: F.format_string(f"%.{places}f", F.round(x, places) + F.lit(0.0))), ",")


def _lagged(name: str, n: int) -> str:
    return "concat_ws(','," + ",".join(f"printf('%.4f', round(lag({name},{k}) OVER w,4)+0e0)" for k in range(n, 0, -1)) + ")"


@query(f"""WITH {DAILY}, q AS (SELECT period, industry, rn, n, m, s, {_lagged('s', 5)} sequence FROM ch WINDOW w AS (PARTITION BY industry ORDER BY period))
SELECT period, industry, sequence, round(m,6) momentum, CASE WHEN abs(s*0.1e0)>0.03e0 THEN 1 ELSE 0 END anomaly FROM q WHERE n>=7 AND rn BETWEEN 5 AND n-2""")
def sequences_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _daily(spark, sf_dir).withColumn("return", F.col("sentiment_mean") * 0.1)  # both anomaly labels occur
    return r6(features.sequences(series).withColumn("sequence", _text("sequence")), "momentum")


@query(f"""WITH {DAILY}, q AS (SELECT period, industry, rn, n, m, ht, {_lagged('s', 5)} sequence FROM ch WINDOW w AS (PARTITION BY industry ORDER BY period))
SELECT period, industry, sequence, round(ht,6) delta, round(m,6) momentum FROM q WHERE rn>=5""")
def sequences_per_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.industry_sequences(_daily(spark, sf_dir))
    return r6(rows.select("period", "industry", _text("sequence").alias("sequence"), F.col("deltas")[0].alias("delta"), "momentum"), "delta", "momentum")


def _sql_text(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda x: printf('%.4f', round(x,4)+0e0)), ',')"


@query(f"""WITH {DAILY}, wide AS (SELECT period, row_number() OVER (ORDER BY period)-1 rn, list(s ORDER BY industry) s, list(ht ORDER BY industry) ht, list(m ORDER BY industry) m FROM ch GROUP BY period),
f AS (SELECT a.period, a.m, b.rn, list_concat(b.s, a.ht) x FROM wide a JOIN wide b ON b.rn BETWEEN a.rn-8 AND a.rn-1 WHERE a.rn>=8)
SELECT period, {_sql_text('any_value(m)')} labels, {_sql_text('flatten(list(x ORDER BY rn))')} features FROM f GROUP BY period""")
def sequences_cross_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.cross_sequences(_daily(spark, sf_dir))
    return rows.select("period", _text("labels").alias("labels"), _text(F.flatten("features")).alias("features"))


@query(f"""WITH {DAILY}, z AS (SELECT *, CASE WHEN rn=0 THEN 0e0 ELSE m END mm, CASE WHEN rn=0 THEN 0e0 ELSE ht END hh FROM ch),
q AS (SELECT period, industry, rn, n, {_lagged('mm', 4)} momenta, {_lagged('hh', 4)} heats, cast(sign(sn-s) AS int) AS label FROM z WINDOW w AS (PARTITION BY industry ORDER BY period))
SELECT period, industry, momenta, heats, label FROM q WHERE rn>=4 AND rn<=n-2""")
def rolling_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rolling_flatten(_daily(spark, sf_dir)).withColumns({"momenta": _text("momenta"), "heats": _text("heats")})


@query(f"""WITH {DAILY}, q AS (SELECT *, stddev_pop(v) OVER f cs, stddev_pop(s) OVER f ss FROM ch WINDOW f AS (PARTITION BY industry ORDER BY period ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT period, industry, round(s-s1,6) delta_1, round(s-s2,6) delta_2, v news_count, round(ht,6) news_heat, round(cs,6) count_std, round(ss,6) sentiment_std,
 round(s*s,6) model_reg, round(ht/2,6) model_cls, round(s*s-s1*s1,6) model_delta, round(s*s*ht,6)+0e0 model_heat, CASE WHEN sn>s THEN 1 WHEN sn<s THEN -1 ELSE 0 END AS label
FROM q WHERE n>=7 AND rn BETWEEN 6 AND n-2""")
def stacking_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten features, with given columns as the sequence model's outputs."""
    series = features.changes(_daily(spark, sf_dir)).drop("momentum")
    series = series.withColumn("reg", F.col("sentiment_mean") * F.col("sentiment_mean")).withColumn("cls", F.col("news_heat") / 2)
    rows = features.stacking_features(series, model_reg="reg", model_cls="cls")
    return r6(rows, "delta_1", "delta_2", "news_heat", "count_std", "sentiment_std", "model_reg", "model_cls", "model_delta", "model_heat")


@query(f"""WITH {DAILY}, q AS (SELECT period, industry, rn, n, [{', '.join(f'lead(v,{k}) OVER w' for k in range(5))}, {', '.join(f'lead(coalesce(ht,0e0),{k}) OVER w' for k in range(5))}] x FROM ch WINDOW w AS (PARTITION BY industry ORDER BY period))
SELECT period, industry, {_sql_text('x')} features FROM q WHERE rn < n-10""")
def iforest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.isolation_windows(features.changes(_daily(spark, sf_dir)).fillna(0.0, ["news_heat"]))
    return rows.withColumn("features", _text("features"))


# ---------------------------------------------------------------- scoring
def _scores(cond: str) -> str:
    return f"""WITH {DAILY}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY period DESC) k FROM ch WHERE {cond}) WHERE k<=5),
g AS (SELECT industry, greatest(-1e0,least(1e0,avg(s))) m, greatest(0e0,least(1e0,avg(ht)/5)) h FROM l GROUP BY 1),
i AS (SELECT DISTINCT event_type industry FROM events UNION SELECT 'nothing'), f AS (SELECT i.industry, coalesce(m,0e0) m, coalesce(h,0e0) h FROM i LEFT JOIN g ON g.industry=i.industry)
SELECT industry, round(m,6) momentum_score, round(h,6) heat_anomaly, round(m*h,6)+0e0 composite_score, CASE WHEN m>0.1e0 THEN 1 WHEN m<-0.1e0 THEN -1 ELSE 0 END trend_direction FROM f"""


def _scored(spark: SparkSession, sf_dir: str, as_of: str | None) -> DataFrame:
    listed = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("industry")).distinct().union(spark.range(1).select(F.lit("nothing")))
    return scoring.scores(features.changes(_daily(spark, sf_dir)), listed, as_of)


@query(_scores("true"))
def cpu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_scored(spark, sf_dir, None), "momentum_score", "heat_anomaly", "composite_score")


@query(_scores("period <= date'2024-01-12'"))
def cpu_scores_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_scored(spark, sf_dir, "2024-01-12"), "momentum_score", "heat_anomaly", "composite_score")


@query(_scores("true").partition("SELECT industry, round(m")[0] + """SELECT string_agg(printf('%s: momentum=%.3f heat=%.3f composite=%.3f trend=%d', industry, m, h, m*h, CASE WHEN m>0.1e0 THEN 1 WHEN m<-0.1e0 THEN -1 ELSE 0 END), chr(10) ORDER BY m*h DESC, industry) AS "text" FROM f""")
def ml_signals_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rendered(_scored(spark, sf_dir, None))


@query(f"WITH {DAILY} SELECT period, industry, round(s,6) sentiment_mean, v news_count FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY period DESC) k FROM ch) WHERE k<=3")
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features.last_rows(_daily(spark, sf_dir), 3), "sentiment_mean")


# ---------------------------------------------------------------- taxonomy
_BEST = A4 + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tracking_index ORDER BY aum DESC NULLS LAST, code) k FROM a4) WHERE k=1)"


@query(f"WITH {_BEST} SELECT code, name, tracking_index, aum FROM best")
def best_etf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.best_etf(A.etf_info(spark, sf_dir))


@query(f"WITH {A4} SELECT code, name, tracking_index, aum FROM (SELECT *, row_number() OVER (PARTITION BY tracking_index ORDER BY aum DESC NULLS FIRST, code) k FROM a4) WHERE k=1")
def best_etf_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.best_etf(A.etf_info(spark, sf_dir), nulls_first=True)


@query("""WITH f AS (SELECT s_suppkey code, n_name tracking_index, s_acctbal aum FROM supplier JOIN nation ON s_nationkey=n_nationkey),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tracking_index ORDER BY aum DESC NULLS LAST, code) k FROM f) WHERE k=1),
t AS (SELECT r_name large_cat, n_name small_cat, n_name index_name FROM nation JOIN region ON n_regionkey=r_regionkey)
SELECT DISTINCT large_cat AS industry, 'large' AS level, code FROM t JOIN best ON tracking_index=index_name UNION SELECT DISTINCT small_cat, 'small', code FROM t JOIN best ON tracking_index=index_name""")
def industry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.table(spark, sf_dir, "supplier").join(A.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    best = taxonomy.best_etf(s.select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("tracking_index"), F.col("s_acctbal").alias("aum")))
    return taxonomy.industry_codes(A.taxonomy(spark, sf_dir), best)


@query(f"WITH {A5}, x AS (SELECT n_nationkey pos, n_name index_name, correlation_cluster c FROM nation JOIN a5 ON index_name=n_name WHERE correlation_cluster<>'unknown') SELECT a.index_name AS \"first\", b.index_name AS \"second\", a.c AS \"cluster\" FROM x a JOIN x b ON a.c=b.c AND a.pos<b.pos")
def cluster_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("index_name"))
    return taxonomy.cluster_conflicts(names, A.taxonomy(spark, sf_dir))


@query(f"WITH {A5}, q AS (SELECT n_name index_name FROM nation UNION SELECT r_name FROM region) SELECT q.index_name, coalesce(large_cat,'未知') large_cat, coalesce(small_cat,'未知') small_cat, coalesce(beta,'medium') beta, coalesce(correlation_cluster,'unknown') correlation_cluster FROM q LEFT JOIN a5 ON a5.index_name=q.index_name")
def index_info_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("index_name")).union(A.table(spark, sf_dir, "region").select("r_name"))
    return taxonomy.index_info(names, A.taxonomy(spark, sf_dir))


@query(f"WITH {A5} SELECT large_cat, count(DISTINCT small_cat) small_cats, count(DISTINCT index_name) indices FROM a5 GROUP BY 1")
def industry_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.categories(A.taxonomy(spark, sf_dir))


@query("SELECT r_name large_cat, n_name small_cat, concat(n_name,'-',i.i) index_name, CASE WHEN n_nationkey%2=0 THEN 'high' ELSE 'medium' END beta, CASE WHEN n_nationkey%3=0 THEN 'c3' ELSE n_name END correlation_cluster FROM nation JOIN region ON n_regionkey=r_regionkey CROSS JOIN (VALUES ('a'),('b')) i(i)")
def taxonomy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "nation").join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    leaf = F.struct(F.array(F.concat("n_name", F.lit("-a")), F.concat("n_name", F.lit("-b"))).alias("indices"), F.when(k % 2 == 0, "high").alias("beta"), F.when(k % 3 == 0, "c3").alias("correlation_cluster"))
    docs = n.select(F.to_json(F.create_map("r_name", F.create_map("n_name", leaf))).alias("value"))  # documents of one category each
    return files.taxonomy_from_json(docs)


# ---------------------------------------------------------------- text and labels
@query(f"WITH {A2} SELECT doc_id, CASE WHEN title IS NOT NULL AND title<>'' AND content IS NOT NULL AND content<>'' THEN concat(title,' [SEP] ',substring(content,1,256)) WHEN content IS NOT NULL AND content<>'' THEN substring(content,1,256) ELSE '' END model_text FROM a2")
def model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.news_raw(spark, sf_dir).select("doc_id", T.model_text(F.col("title"), F.col("content")).alias("model_text"))


@query(f"WITH {A2} SELECT doc_id, CASE WHEN coalesce(content,'')='' THEN coalesce(title,'') ELSE concat(coalesce(title,''),'[SEP]',substring(content,1,256)) END training_text, coalesce(title,'')||' '||coalesce(content,'') joined FROM a2")
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = F.col("title"), F.col("content")
    return A.news_raw(spark, sf_dir).select("doc_id", T.training_text(t, c).alias("training_text"), T.joined(t, c).alias("joined"))


@query(f"WITH {A2}, t AS (SELECT doc_id, CASE WHEN doc_id%2=0 THEN NULL ELSE title END title, content FROM a2) SELECT doc_id FROM t WHERE NOT (title IS NULL AND content IS NULL)")
def text_null_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.news_raw(spark, sf_dir).withColumn("title", F.when(F.col("doc_id") % 2 != 0, F.col("title")))
    return labeling.selected(rows).select("doc_id")


@query(f"WITH {A2} SELECT doc_id FROM a2 WHERE NOT (title IS NULL AND content IS NULL) ORDER BY d DESC, doc_id LIMIT 100")
def news_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 in order: the limit is the feature."""
    rows = A.news_raw(spark, sf_dir).withColumn("before", -F.unix_date("d"))
    return labeling.selected(rows, 100, ("before", "doc_id")).select("doc_id")


@query("SELECT DISTINCT p_type, translate(p_type,'/\\ ','___') safe FROM part")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select("p_type", T.safe_name(F.col("p_type")).alias("safe")).distinct()


_POS, _NEG = ("the", "and", "de", "ering"), ("token", "der", "###", "!!")


@query(f"""WITH t AS (SELECT doc_id, {'+'.join(f"contains(text,'{w}')::int" for w in _POS)} p, {'+'.join(f"contains(text,'{w}')::int" for w in _NEG)} n FROM documents)
SELECT doc_id, round(coalesce(CASE WHEN p+n=0 THEN 0e0 ELSE (p-n)/(p+n)::double END,0e0),6) sentiment FROM t""")
def keyword_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(A.table(spark, sf_dir, "documents").select("doc_id", T.keyword_sentiment(F.col("text"), _POS, _NEG).alias("sentiment")), "sentiment")


# common letter groups of the texts, each standing for a keyword
_STANDS = dict(zip(("the ", "ung", "cion", "ment", "ering", "que", "token", "and ", "eau", "##"), [w for pair in zip(T.POSITIVE_KEYWORDS, T.NEGATIVE_KEYWORDS) for w in pair]))


def _replaced(text: str) -> str:
    for part, word in _STANDS.items():
        text = f"replace({text}, '{part}', '{word}')"
    return text


@query(f"""WITH t AS (SELECT doc_id, {_replaced('text')} says FROM documents),
c AS (SELECT doc_id, {'+'.join(f"contains(says,'{w}')::int" for w in T.POSITIVE_KEYWORDS)} p, {'+'.join(f"contains(says,'{w}')::int" for w in T.NEGATIVE_KEYWORDS)} n FROM t)
SELECT doc_id, round(coalesce(CASE WHEN p+n=0 THEN 0e0 ELSE (p-n)/(p+n)::double END,0e0),6)+0e0 sentiment FROM c""")
def keyword_sentiment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the fixed keyword lists, over whole texts in which letter groups are replaced by keywords."""
    says = F.col("text")
    for part, word in _STANDS.items():
        says = F.replace(says, F.lit(part), F.lit(word))
    docs = A.table(spark, sf_dir, "documents").select("doc_id", says.alias("says"))
    return r6(docs.select("doc_id", T.keyword_sentiment(F.col("says")).alias("sentiment")), "sentiment")


_A8 = "a8 AS (SELECT vec_id, label, list_transform(embedding[1:8],lambda x: x::double) z, list_transform(embedding[9:11],lambda x: x::double) s FROM embeddings)"


@query(f"""WITH {_A8} SELECT vec_id, cast(list_position(z,list_max(z))-1 AS int) l1, round(1/list_sum(list_transform(z,lambda x: exp(x-list_max(z)))),6) l1_p, cast(list_position(s,list_max(s))-1 AS int) sent, round(1/list_sum(list_transform(s,lambda x: exp(x-list_max(s)))),6) sent_p FROM a8""")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, s = F.col("l1_logits"), F.col("sent_logits")
    return r6(A.logits(spark, sf_dir).select("vec_id", X.argmax(z).alias("l1"), X.confidence(z).alias("l1_p"), X.argmax(s).alias("sent"), F.array_max(X.softmax(s)).alias("sent_p")), "l1_p", "sent_p")


@query(f"""WITH {_A8} SELECT vec_id, (ARRAY['negative','neutral','positive'])[list_position(s,list_max(s))] sentiment, (ARRAY['x','y','z'])[least(list_position(z,list_max(z)),3)] clamped FROM a8""")
def label_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labeling.classified(A.logits(spark, sf_dir), "sent_logits", labeling.SENTIMENTS, "sentiment")
    return labeling.classified(rows, "l1_logits", ("x", "y", "z"), "clamped").select("vec_id", "sentiment", "clamped")


@query(f"WITH {_A8} SELECT vec_id, round_even(1/list_sum(list_transform(z,lambda x: exp(x-list_max(z)))),4) l1_confidence FROM a8")
def confidence_four_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.logits(spark, sf_dir)
    return labeling.classified(rows, "l1_logits", labeling.L1_CATEGORIES, "l1", 4).select("vec_id", "l1_confidence")


# all forms of a sentiment, by the upper end of the values that take them
_FORMS = {"0": 8, "bearish": 14, "negative": 20, "1": 36, "neutral": 54, "2": 66, "bullish": 80}


@query(f"""SELECT word, CASE WHEN word IN ('negative','bearish','0') THEN 0 WHEN word IN ('neutral','1') THEN 1 ELSE 2 END code, count(*) n
FROM (SELECT CASE {' '.join(f"WHEN value<{v} THEN '{w}'" for w, v in _FORMS.items())} ELSE 'positive' END word FROM events) GROUP BY 1,2""")
def sentiment_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all words and numbers for a sentiment."""
    word = F.lit("positive")
    for w, v in reversed(_FORMS.items()):
        word = F.when(F.col("value") < v, w).otherwise(word)
    rows = A.table(spark, sf_dir, "events").select(word.alias("word"))
    return rows.select("word", labeling.sentiment_code(F.col("word")).alias("code")).groupBy("word", "code").agg(F.count(F.lit(1)).alias("n"))


_CLASSES = [*labeling.L1_CATEGORIES, "other"]


@query(f"""SELECT class, CASE WHEN class <> 'other' THEN cast(list_position([{','.join(f"'{w}'" for w in _CLASSES)}], class) - 1 AS int) END idx, count(*) n
FROM (SELECT [{','.join(f"'{w}'" for w in _CLASSES)}][label % {len(_CLASSES)} + 1] class FROM embeddings) GROUP BY 1,2""")
def class_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the first-level classes that the vectors' labels stand for; none for an unknown one."""
    name = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("label") % len(_CLASSES) + 1).cast("int"))
    rows = A.table(spark, sf_dir, "embeddings").select(name.alias("class"))
    return rows.select("class", labeling.class_index(F.col("class")).alias("idx")).groupBy("class", "idx").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS major, p_type AS sub, count(*) n, cast(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type)-1 AS int) idx FROM part GROUP BY 1,2")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.label_index(A.table(spark, sf_dir, "part"), "p_brand", "p_type").withColumnsRenamed({"p_brand": "major", "p_type": "sub"})


@query("SELECT p_brand AS major, count(DISTINCT p_type) labels, cast(count(*) AS bigint) n FROM part GROUP BY 1 HAVING count(DISTINCT p_type)>=2")
def trainable_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.trainable(A.table(spark, sf_dir, "part"), "p_brand", "p_type").withColumnRenamed("p_brand", "major")


@query(f"WITH {A1} SELECT sentiment, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END code, count(*) n FROM a1 GROUP BY 1,2")
def sentiment_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.news_labeled(spark, sf_dir).select("sentiment", labeling.sentiment_code(F.col("sentiment")).alias("code")).groupBy("sentiment", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_A8}, subs AS (SELECT label % 3 AS m, list(DISTINCT cast(label AS varchar) ORDER BY cast(label AS varchar)) subs FROM embeddings GROUP BY 1)
SELECT vec_id, CASE WHEN label=0 THEN subs[-1] ELSE subs[least(list_position(z,list_max(z)),len(subs))] END sub_category, round(CASE WHEN label=0 THEN 0e0 ELSE 1/list_sum(list_transform(z,lambda x: exp(x-list_max(z)))) END,6) p FROM a8 JOIN subs ON subs.m=label%3""")
def sub_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.logits(spark, sf_dir).withColumn("major", (F.col("label") % 3).cast("string")).withColumn("sub", F.col("label").cast("string"))
    found = labeling.sub_classified(rows.withColumn("sub_logits", F.when(F.col("label") != 0, F.col("l1_logits"))), labeling.sub_labels(rows))
    return r6(found.select("vec_id", "sub_category", F.col("sub_category_confidence").alias("p")), "p")


@query("SELECT p_type AS k, count(*) n, CASE WHEN count(*)>1500 THEN greatest(5, 20//3) WHEN count(*)>800 THEN greatest(5, 20//2) ELSE 20 END rounds FROM part GROUP BY 1")
def adaptive_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rounds", X.iterations(F.col("n"), 20))


# ---------------------------------------------------------------- retrieval
_QUERY = "the thing is ering and then token or eouble that"
_TFIDF = """tok AS (SELECT id, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]{2,}')) term FROM docs),
tf AS (SELECT id, term, count(*) tf FROM tok GROUP BY 1,2), vocab AS (SELECT term, sum(tf) cf, count(*) df FROM tf GROUP BY 1 ORDER BY cf DESC, term LIMIT 5000),
idf AS (SELECT term, ln((1e0+(SELECT count(*) FROM docs))/(1e0+df))+1 idf FROM vocab), x AS (SELECT id, term, idf, tf*idf x FROM tf JOIN idf USING(term)),
nrm AS (SELECT id, sqrt(sum(x*x)) nrm FROM x GROUP BY 1), qt AS (SELECT term, count(*) qtf FROM (SELECT unnest(regexp_extract_all(lower('%s'), '[\\p{L}\\p{N}_]{2,}')) term) GROUP BY 1),
qn AS (SELECT sqrt(sum((qtf*idf)*(qtf*idf))) qn FROM qt JOIN idf USING(term)),
dot AS (SELECT x.id, sum(x.x*qtf*x.idf)/max(nrm)/max(qn) s FROM x JOIN qt USING(term) JOIN nrm ON nrm.id=x.id CROSS JOIN qn GROUP BY 1)
SELECT docs.id, round(coalesce(s,0e0),6) similarity FROM docs LEFT JOIN dot ON dot.id=docs.id ORDER BY coalesce(s,0e0) DESC, docs.id LIMIT 5""" % _QUERY


@query(f"WITH docs AS (SELECT doc_id id, text t FROM documents), {_TFIDF}")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(retrieval.similar(A.table(spark, sf_dir, "documents"), _QUERY, 5, "doc_id", "text"), "similarity")


@query(f"WITH {A2}, docs AS (SELECT doc_id id, coalesce(title,'')||' '||coalesce(content,'') t FROM a2 WHERE d<=date'2024-01-15'), {_TFIDF}")
def history_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(retrieval.history(A.news_raw(spark, sf_dir), _QUERY, 5, ("d", "2024-01-15")), "similarity")


@query(f"""WITH {A2}, s AS (SELECT * FROM a2 WHERE d BETWEEN date'2024-01-08' AND date'2024-01-14')
SELECT row_number() OVER (ORDER BY d DESC, doc_id DESC) AS "rank", doc_id, concat_ws(' | ', cast(d AS varchar), coalesce(source,''), substring(coalesce(title,''),1,200)) "text", count(*) OVER () n FROM s""")
def market_news_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rendered(calendar.in_week(A.news_raw(spark, sf_dir), "d", "2024-01-08"))


# ---------------------------------------------------------------- portfolio
@query(f"WITH {BT} SELECT ws, round(turnover,6) turnover, round(cost,8) cost FROM c")
def rebalance_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = A.closes(spark, sf_dir)
    weeks = daily.select(X.week_start(F.col("d")).alias("ws")).distinct()
    return r6(r6(portfolio.turnover(weeks, A.decisions(daily)), "turnover"), "cost", places=8)


@query(f"WITH {BT} SELECT ws, industry, round(w,6) w FROM hw")
def held_into_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = A.closes(spark, sf_dir)
    weeks = daily.select(X.week_start(F.col("d")).alias("ws")).distinct()
    return r6(portfolio.held_into(weeks, A.decisions(daily)), "w")


def _market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily closes, weekly industry returns and decisions, each made once."""
    daily = A.closes(spark, sf_dir)
    weekly = A.industry_returns(daily)
    return daily, weekly, A.decisions(daily, weekly)


def _records(spark: SparkSession, sf_dir: str, market: tuple[DataFrame, DataFrame, DataFrame] | None = None, **options) -> DataFrame:
    daily, weekly, decided = _market(spark, sf_dir) if market is None else market
    return written(backtest.run(daily, decided, scale=0.01, industry_returns=weekly, **options), "records")  # a row a week


@query(f"WITH {BT} SELECT ws, round(r,8) weekly_return, round(cost,8) cost, round(nav,2) nav FROM n")
def nav_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(r6(_records(spark, sf_dir).select("ws", "weekly_return", "cost", "nav"), "weekly_return", "cost", places=8), "nav", places=2)


@query(f"""WITH {BT}, iv AS (SELECT ws, sum(w) w, count(*) k FROM hw GROUP BY 1)
SELECT n.ws, round(nav,2) nav, round(coalesce(iv.w,0e0),6) invested_weight, round(1-coalesce(iv.w,0e0),6) cash_weight, CASE WHEN r>0 THEN 'PROFIT' ELSE 'LOSS' END status, round(nav/1e6-1,6) cumulative_return, coalesce(iv.k,0) held FROM n LEFT JOIN iv ON iv.ws=n.ws""")
def backtest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select("ws", "nav", "invested_weight", "cash_weight", "status", "cumulative_return", F.coalesce(F.size("holdings"), F.lit(0)).cast("long").alias("held"))
    rows = rows.withColumn("held", F.greatest("held", F.lit(0)))
    return r6(r6(rows, "invested_weight", "cash_weight", "cumulative_return"), "nav", places=2)


@query(f"""WITH {BT}, o AS (SELECT *, lead(r) OVER (ORDER BY ws) r1, lead(ws,2) OVER (ORDER BY ws) after FROM n)
SELECT ws, round(CASE WHEN after IS NULL THEN nav*(1-cost)*(1+r1) ELSE nav END,2) nav, round(CASE WHEN after IS NULL THEN r1 ELSE r END,8) weekly_return FROM o WHERE r1 IS NOT NULL""")
def backtest_final_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(r6(_records(spark, sf_dir, final_flush=True).select("ws", "nav", "weekly_return"), "weekly_return", places=8), "nav", places=2)


@query(f"WITH {BT} SELECT hw.ws, hw.industry, round(hw.w*wr.r,8) contribution FROM hw JOIN wr ON wr.ws=hw.ws AND wr.industry=hw.industry")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select("ws", F.explode("contributions").alias("industry", "contribution"))
    return r6(rows, "contribution", places=8)


@query(f"WITH {BT} SELECT ws, round(max(nav) OVER w,2) peak, round((nav-max(nav) OVER w)/max(nav) OVER w,6) drawdown FROM n WINDOW w AS (ORDER BY ws ROWS UNBOUNDED PRECEDING)")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(r6(portfolio.drawdown(_records(spark, sf_dir)).select("ws", "peak", "drawdown"), "drawdown"), "peak", places=2)


@query(f"""WITH {BT}, dd AS (SELECT *, (nav-max(nav) OVER w)/max(nav) OVER w dw FROM n WINDOW w AS (ORDER BY ws ROWS UNBOUNDED PRECEDING)),
a AS (SELECT min_by(nav,ws) f, max_by(nav,ws) l, count(*) k, min(dw) mdd, avg(r-0.03e0/52) mean, stddev_pop(r) sd, stddev_pop(r) FILTER (r<0) dn, avg(CASE WHEN r>0 THEN 1e0 ELSE 0e0 END) win FROM dd),
fin AS (SELECT *, (l-f)/f tot, pow(1+(l-f)/f, 52e0/k)-1 ann FROM a)
SELECT round(tot,6) total_return, round(ann,6) annual_return, round(mdd,6) max_drawdown, round(CASE WHEN sd>0 THEN sqrt(52)*mean/sd ELSE 0 END,6) sharpe_ratio, round(CASE WHEN dn>0 THEN sqrt(52)*mean/dn ELSE 0 END,6) sortino_ratio,
 round(CASE WHEN mdd<>0 THEN ann/abs(mdd) ELSE 0 END,6) calmar_ratio, round(win,6) win_rate, k AS weeks, round(l,2) final_nav, round(f,2) initial_capital FROM fin""")
def perf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.performance(_records(spark, sf_dir))
    return r6(r6(rows, "total_return", "annual_return", "max_drawdown", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "win_rate"), "final_nav", "initial_capital", places=2)


@query(f"""WITH {BT} SELECT 'run' run_id, strftime(ws,'%Y-%m-%d') ws, round(nav,2) nav, round(r,8) weekly_return, CASE WHEN r>0 THEN 'PROFIT' ELSE 'LOSS' END status FROM n ORDER BY ws DESC LIMIT 1""")
def last_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record as JSON, read back."""
    rows = backtest.last_record(_records(spark, sf_dir)).select("run_id", F.from_json("record", "ws string, nav double, weekly_return double, status string").alias("r"))
    return r6(r6(rows.select("run_id", "r.*"), "nav", places=2), "weekly_return", places=8)


@query(f"WITH {BT}, p AS (SELECT ws, lag(ws) OVER (ORDER BY ws) before FROM weeks) SELECT p.ws, cast(count(a6.ws) AS int) decisions FROM p LEFT JOIN a6 ON a6.ws=p.before GROUP BY 1")
def previous_week_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = _market(spark, sf_dir)
    rows = backtest.with_previous(_records(spark, sf_dir, market), market[2])
    return rows.select("ws", F.when(F.col("agent_decisions").isNull(), 0).otherwise(F.size("agent_decisions")).alias("decisions"))


# ---------------------------------------------------------------- risk
_RISK = BT + "," + A5 + """, tx AS (SELECT r_name small, CASE r_regionkey%2 WHEN 0 THEN 'very_high' ELSE 'low' END beta, CASE WHEN r_regionkey<3 THEN 'k' ELSE 'unknown' END cl FROM region),
buys AS (SELECT a6.*, coalesce(beta,'medium') beta, coalesce(cl,industry) cl FROM a6 LEFT JOIN tx ON small=industry WHERE action='buy'),
v AS (SELECT ws, 'max_weight' AS "rule", industry AS subject, weight AS "value" FROM buys WHERE weight>0.3e0
UNION ALL SELECT ws, 'max_total', 'all', sum(weight) FROM buys GROUP BY ws HAVING sum(weight)>1
UNION ALL SELECT buys.ws, 'beta', buys.industry, g.r FROM buys JOIN g ON g.ws=buys.ws AND g.r<0 WHERE beta='very_high' AND weight<>0 AND NOT EXISTS (SELECT 1 FROM hw WHERE hw.ws=buys.ws AND hw.industry=buys.industry)
UNION ALL SELECT ws, 'mirror', cl, cast(count(*) AS double) FROM buys WHERE weight>=0.15e0 AND cl<>'unknown' GROUP BY 1,3 HAVING count(*)>=2)"""


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    tax = A.table(spark, sf_dir, "region").select(F.col("r_name").alias("small_cat"), F.when(k % 2 == 0, "very_high").otherwise("low").alias("beta"), F.when(k < 3, "k").otherwise("unknown").alias("correlation_cluster"))
    market = _market(spark, sf_dir)
    records, decided = _records(spark, sf_dir, market), market[2]
    held = written(portfolio.held_into(records.select("ws"), decided), "held")
    return risk.violations(decided, tax, held, records.select("ws", F.col("weekly_return").alias("r")))


@query(f"""WITH {_RISK} SELECT ws, "rule", subject, round("value",6) AS "value" FROM v""")
def risk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_violations(spark, sf_dir), "value")


@query(f"""WITH {_RISK} SELECT ws, CASE WHEN bool_or("rule" IN ('max_weight','max_total','mirror')) THEN 'trader' ELSE 'researcher' END route FROM v GROUP BY ws""")
def risk_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = risk.error_text(_violations(spark, sf_dir))
    return texts.select("ws", risk.route(F.lit(False), F.col("last_error")).alias("route"))


# ---------------------------------------------------------------- evaluation
_A7 = "a7 AS (SELECT d.doc_id, d.lang, cast(d.doc_id%100 AS int) day_no, cast(l.quality AS double) y_true, cast(length(d.source)+d.n_chars%10 AS double) y_pred FROM documents d JOIN labels l ON d.doc_id=l.doc_id)"


@query(f"WITH {_A7}, g AS (SELECT lang, count(*) n, covar_pop(y_true,y_pred) c, stddev_pop(y_true) a, stddev_pop(y_pred) b FROM a7 GROUP BY 1) SELECT lang, n, CASE WHEN n>=3 AND a*b<>0 THEN round(c/(a*b),6) END ic FROM g")
def group_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.group_ic(A.evaluation(spark, sf_dir), "lang"), "ic")


@query(f"""WITH {_A7}, e AS (SELECT y_true-y_pred e, row_number() OVER (ORDER BY day_no, doc_id) k, count(*) OVER () n FROM a7), m AS (SELECT avg(e) mu FROM e)
SELECT round(avg(e),6) "mean", round(stddev_pop(e),6) "std", round(avg(pow(e-mu,3))/pow(avg(pow(e-mu,2)),1.5e0),6) skew, round(avg(pow(e-mu,4))/pow(avg(pow(e-mu,2)),2)-3,6) kurt,
 round(avg(e) FILTER (k<=n//2),6) early_mean, round(avg(e) FILTER (k>n//2),6) late_mean, round(stddev_pop(e) FILTER (k<=n//2),6) early_std, round(stddev_pop(e) FILTER (k>n//2),6) late_std FROM e CROSS JOIN m""")
def residual_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.residual_moments(A.evaluation(spark, sf_dir), ("day_no", "doc_id"))
    return r6(rows, *rows.columns)


@query(f"WITH {_A7}, m AS (SELECT avg(y_true) mu FROM a7) SELECT round(1-sum(pow(y_true-y_pred,2))/sum(pow(y_true-mu,2)),6) r2 FROM a7 CROSS JOIN m")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.r2(A.evaluation(spark, sf_dir)), "r2")


@query(f"WITH {_A7} SELECT round(avg((y_true=(CASE WHEN y_pred>8 THEN 1 ELSE 0 END))::int),6) accuracy, round(sum(abs(y_true-y_pred)*(day_no+1))/sum(day_no+1),6) loss, count(*) n FROM a7")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("y_true") == F.when(F.col("y_pred") > 8, 1).otherwise(0)
    return r6(metrics.accuracy(A.evaluation(spark, sf_dir), hit, F.abs(F.col("y_true") - F.col("y_pred")), F.col("day_no") + 1), "accuracy", "loss")


@query(f"WITH {_A7} SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id,'-42')), doc_id) <= round(count(*) OVER (PARTITION BY lang)*0.15e0) THEN 'val' ELSE 'train' END part FROM a7")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(A.evaluation(spark, sf_dir), "lang", "doc_id").select("doc_id", "part")


@query(f"WITH {_A7} SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY day_no, doc_id) <= floor(count(*) OVER ()*0.8e0) THEN 'train' ELSE 'test' END part FROM a7")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.by_time(A.evaluation(spark, sf_dir), ("day_no", "doc_id")).select("doc_id", "part")


@query(f"WITH {DAILY} SELECT period, industry, CASE WHEN period<date'2024-01-20' THEN 'train' ELSE 'test' END part FROM ch")
def period_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.period_split(_daily(spark, sf_dir), "2024-01-20").select("period", "industry", "part")


@query("SELECT event_id, cast(value>20 AND value<=54 AND event_type IN ('click','view')  AS int) hit FROM events WHERE value>20 AND value<=54 AND event_type IN ('click','view') ")
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").where((F.col("value") > 20) & (F.col("value") <= 54) & F.col("event_type").isin("click", "view"))
    return e.select("event_id", F.lit(1).alias("hit"))


@query("SELECT o_orderpriority k, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r<=3")
def greatest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = A.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return o.withColumn("r", F.row_number().over(by)).where("r <= 3").select(F.col("o_orderpriority").alias("k"), "o_orderkey", "o_totalprice")


from weekloom import model_queries  # noqa: E402, F401  registers its queries here
