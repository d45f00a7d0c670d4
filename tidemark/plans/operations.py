"""Queries on text scans, allocators, event windows, streams, reports and the correlation dial."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import allocators, audit, joins, report, resample, risk, scans, textscan
from tidemark.plans.series import rounded
from tidemark.sources import files, views
from tidemark.sources.views import with_views
from tidemark.streaming import processors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _leak_sql() -> str:
    q = lambda p: p.replace("'", "''")
    lines = "l AS (SELECT kind, id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no FROM s)"
    parts = [f"SELECT kind, id, line_no, '{label}' AS label, line FROM l WHERE regexp_matches(line, '{q(p)}')" for label, p in textscan.LEAKS]
    parts.append(f"SELECT kind, id, line_no, 'credential value (' || regexp_extract(line, '{q(textscan.CREDENTIAL)}', 1) || ')' AS label, line FROM l WHERE regexp_matches(line, '{q(textscan.CREDENTIAL)}') AND NOT regexp_matches(regexp_extract(line, '{q(textscan.CREDENTIAL)}', 2), '{q(textscan.PLACEHOLDER)}')")
    return "WITH s AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations), " + lines + " SELECT kind, id, line_no, label, substr(trim(line, ' '), 1, 120) AS excerpt FROM (" + " UNION ALL ".join(parts) + ")"


@query(_leak_sql())
def leak_scan(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = views.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    turns = views.table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    corpus = documents.unionByName(pages).unionByName(turns).select(F.struct("kind", "id").alias("k"), "text")
    return textscan.leak_scan(corpus, "k", "text").select("k.kind", "k.id", "line_no", "label", "excerpt")


def _idiom_sql() -> str:
    """The scan with other means: line by line, each pattern that RE2 knows; look-behinds by cutting out what they forgive."""
    q = lambda p: p.replace("'", "''")
    parts = []
    for name, severity, patterns in textscan.IDIOMS:
        hit = " OR ".join(f"regexp_matches(line, '{q(p)}')" for p in patterns if not p.startswith("(?<!"))
        if hit:
            parts.append(f"SELECT doc_id, line_no, '{name}' AS pattern_id, '{severity}' AS severity FROM l WHERE {hit}")
    parts.append("""SELECT doc_id, line_no, 'B1_pos_times_ret_no_shift', 'major' FROM l WHERE regexp_matches(regexp_replace(line, '\\.shift\\(1\\)\\spositions?\\s*\\*|\\.shift\\(1\\)\\.fillna\\(0\\.0\\)\\spos\\s*\\*', '', 'g'), '\\bpositions?\\s*\\*\\s*(?:bar_)?returns?\\b|\\bpos\\s*\\*\\s*(?:bar_)?ret(?:s|urns)?\\b')""")
    parts.append("""SELECT doc_id, line_no, 'A3_periods_per_year_default', 'major' FROM l WHERE regexp_matches(line, '\\bsharpe\\s*\\(') AND NOT contains(line, 'periods_per_year') AND NOT regexp_matches(line, 'def\\s+\\w*sharpe') AND NOT contains(line, 'from ') AND NOT contains(line, 'import')""")
    return "WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no FROM documents), l AS (SELECT * FROM a WHERE trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '#')) " + " UNION ALL ".join(parts)


@query(_idiom_sql())
def methodology_scan(spark, sf_dir):
    found = textscan.idiom_scan(views.table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "line_no", "pattern_id", "severity")


def _moments(spark, sf_dir):
    return allocators.gather(views.returns(spark, sf_dir), "symbol", "ts", "r")


@query()
def ledoit_wolf(spark, sf_dir):
    m = _moments(spark, sf_dir)
    cov, share = allocators.shrink(m)
    rows = [(a, b, float(cov[i, j]), share) for i, a in enumerate(m.names) for j, b in enumerate(m.names) if i <= j]
    return spark.createDataFrame(rows, "a string, b string, cov double, shrinkage double")


@query()
def allocator_weights(spark, sf_dir):
    """Equal risk, hierarchical, nested-cluster and capped weights of one book."""
    m = _moments(spark, sf_dir)
    cov, _ = allocators.shrink(m)
    return allocators.weights_table(spark, m.names, erc=allocators.equal_risk(cov), hrp=allocators.hierarchical(cov), nco=allocators.nested_clusters(cov, m.n), hrp_capped=allocators.cap_weights(allocators.hierarchical(cov), 0.25))


@query()
def cdar_weights(spark, sf_dir):
    """Least conditional drawdown, from the aligned days of a book (days by members, gathered in order)."""
    panel = joins.aligned(views.returns(spark, sf_dir), "symbol", "ts", "r", 5)
    rows = panel.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("symbol", "r"))).alias("v")).orderBy("ts").select("v.r").toArrow()
    import numpy as np

    names = sorted(r[0] for r in panel.select("symbol").distinct().collect())
    return allocators.weights_table(spark, names, weight=allocators.conditional_drawdown(np.array(rows.column("r").to_pylist())))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tick_windows_tumbling(spark, sf_dir):
    out = processors.tumbling(views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "event_type")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH k AS (SELECT unnest(range(4)) AS k) SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events, k GROUP BY ALL""")
def tick_windows_sliding(spark, sf_dir):
    out = processors.sliding(views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "6 hours", "event_type")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def tick_windows_session(spark, sf_dir):
    out = processors.sessions(views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes", "user_id")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH RECURSIVE e AS (SELECT event_type, user_id, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_type, event_id, k, ts AS last, true AS kept FROM e WHERE k = 1
  UNION ALL SELECT e.event_type, e.event_id, e.k, CASE WHEN e.ts >= r.last + INTERVAL 3600 SECOND THEN e.ts ELSE r.last END, e.ts >= r.last + INTERVAL 3600 SECOND FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1)
SELECT event_type, event_id FROM r WHERE kept""")
def order_event_dedupe(spark, sf_dir):
    return report.dedupe_events(views.table(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", 3600).select("event_type", "event_id")


@query(with_views("ret", also="b AS (SELECT symbol, r, min(r) OVER (PARTITION BY symbol) AS lo, max(r) OVER (PARTITION BY symbol) AS hi FROM ret)") + "SELECT symbol, least(59, floor((r - lo) / (hi - lo) * 60)::INT) AS bin, count(*) AS n FROM b GROUP BY ALL")
def histogram_bins(spark, sf_dir):
    return report.histogram(views.returns(spark, sf_dir), ["symbol"])


@query(with_views("ret", also="q AS (SELECT symbol, quantile_cont(r, [" + ", ".join(f"{(i + 1) / 10}::DOUBLE" for i in range(9)) + "]) AS q FROM ret GROUP BY symbol), u AS (SELECT symbol, unnest(q) AS sample, unnest(range(9))::INT AS point FROM q)") + "SELECT symbol, point, round(sample, 8) AS sample FROM u")
def quantile_plot(spark, sf_dir):
    return rounded(report.quantile_plot(views.returns(spark, sf_dir), ["symbol"], 9), ["symbol", "point"], ["sample"], 8)


@query(with_views("ret", also="""f AS (SELECT ts FROM ret GROUP BY ts HAVING count(*) = 5), c AS (SELECT symbol, ts, r, dense_rank() OVER (ORDER BY ts) - 1 AS k FROM ret WHERE ts IN (SELECT ts FROM f)),
d AS (SELECT DISTINCT k, ts FROM c WHERE k >= 63 AND k % 5 = 0), m AS (SELECT d.k, d.ts, corr(x.r, y.r) AS c FROM d JOIN c x ON x.k < d.k AND x.k >= d.k - 63 JOIN c y ON y.k = x.k AND y.symbol > x.symbol GROUP BY d.k, d.ts, x.symbol, y.symbol),
a AS (SELECT k, ts, avg(c) AS avg_corr FROM m GROUP BY k, ts), z AS (SELECT *, CASE WHEN count(*) OVER w >= 50 AND stddev_samp(avg_corr) OVER w > 0 THEN (avg_corr - avg(avg_corr) OVER w) / stddev_samp(avg_corr) OVER w END AS z FROM a WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING))""") + "SELECT ts, round(avg_corr, 8) AS avg_corr, round(z, 5) AS z, round(coalesce(least(greatest(1 - 0.5e0 * z, 0.3e0), 1.5e0), 1e0), 5) AS leverage FROM z")
def correlation_dial(spark, sf_dir):
    """Average correlation of the trailing 63 bars before every fifth bar, its expanding score, and the leverage dial."""
    panel = joins.aligned(views.returns(spark, sf_dir), "symbol", "ts", "r", 5)
    days = panel.select("ts").distinct().withColumn("k", F.row_number().over(Window.orderBy("ts")) - 1)
    rows = panel.join(days, "ts")
    asked = days.where("k >= 63 AND k % 5 = 0").select(F.col("k").alias("at"), F.col("ts").alias("day"))
    # each bar belongs to the 12 or 13 sampled windows that follow it
    slots = F.explode(F.sequence((F.floor(F.col("k") / 5) + 1) * 5, F.floor((F.col("k") + 63) / 5) * 5, F.lit(5).cast("long"))).alias("at")
    windows = rows.select("symbol", "k", "r", slots).join(asked, "at")
    stats = windows.groupBy("at", "day", "symbol").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    z = windows.join(stats, ["at", "day", "symbol"]).withColumn("z", F.try_divide(F.col("r") - F.col("m"), F.col("s")))
    total = z.groupBy("at", "day", "k").agg(F.sum("z").alias("zs"), F.count("*").alias("n")).groupBy("at", "day").agg(F.sum(F.col("zs") * F.col("zs")).alias("ss"), F.count("*").alias("t"), F.max("n").alias("n"))
    avg = total.select(F.col("day").alias("ts"), "at", F.try_divide(F.col("ss") / (F.col("t") - 1) - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("avg_corr")).withColumn("book", F.lit(1))
    out = scans.expanding_zscore(avg, ["book"], "at", "avg_corr", 50)
    return out.select("ts", F.round("avg_corr", 8).alias("avg_corr"), F.round("z", 5).alias("z"), F.round(risk.scale_by_dial(F.col("z")), 5).alias("leverage"))


@query()
def amortised_mc(spark, sf_dir):
    """A trend threshold fitted once on early bars, shared with every path, and the paths' Sharpe quantiles."""
    ret = views.returns(spark, sf_dir)
    fitted = ret.where("seq < 500").groupBy("symbol").agg(F.percentile("r", 0.5).alias("threshold"))
    paths = resample.draw(ret, resample.stationary(resample.steps(ret, ["symbol"], 40, 252), ["symbol"], 21, 19), ["symbol"], ["r"])
    w = Window.partitionBy("symbol", "path").orderBy("t")
    run = paths.join(F.broadcast(fitted), "symbol").withColumn("held", F.when(F.lag("r").over(w) > F.col("threshold"), F.col("r")).otherwise(0.0))
    return resample.monte_carlo(run.drop("r"), ["symbol"], 0.35, 0.1, "held")


def _stream(spark, sf_dir, df):
    name = f"{files.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return processors.drain(df, f"{name}/out", f"{name}/state")


@query()
def stream_daily_last(spark, sf_dir):
    out = _stream(spark, sf_dir, processors.daily_last(processors.read_events(spark, sf_dir), "event_type"))
    return out.select(F.col("window.start").alias("start"), "event_type", "value")


@query()
def stream_throttle(spark, sf_dir):
    return _stream(spark, sf_dir, processors.throttle(processors.read_events(spark, sf_dir).withColumn("equity", 100 + F.col("value")), "event_type"))


@query()
def stream_cusum(spark, sf_dir):
    return _stream(spark, sf_dir, processors.cusum(processors.read_events(spark, sf_dir), "event_type", 50.0, 29.0))


@query()
def stream_kill_switch(spark, sf_dir):
    return _stream(spark, sf_dir, processors.kill_switch(processors.read_events(spark, sf_dir).withColumn("equity", 1000 + F.col("value")), "event_type", -0.08))


@query()
def stream_dedupe(spark, sf_dir):
    return _stream(spark, sf_dir, processors.suppress(processors.read_events(spark, sf_dir).select("ts", "event_type", "user_id"), ["event_type", "user_id"]))


@query()
def run_audit(spark, sf_dir):
    """Verdicts on a moving-average strategy per symbol."""

    def strategy(df, by):
        out = scans.price_returns(scans.trend_positions(df, by), by)
        return out.withColumn("r", F.coalesce(F.col("position") * F.col("simple"), F.lit(0.0)))

    config = audit.AuditConfig(is_years=2, paths=40)
    out = audit.run_audit(views.bars(spark, sf_dir).select("symbol", "seq", "ts", "close"), strategy, ["symbol"], config)
    return out.select("symbol", "ci_lo", "dsr", "mc_p", "sanctuary", "noise_worst", "noise_mean", "lucky", "severity", "verdict")


_TRIALS = "t AS (SELECT s_suppkey, ['shadow', 'paper', 'conditional', 'live', 'retired'][s_suppkey % 5 + 1] AS status, s_acctbal / 1e4 AS sharpe, s_suppkey % 7 AS cells FROM supplier)"


@query("WITH " + _TRIALS + " SELECT count(*) AS n_trials, sum(cells)::BIGINT AS n_cells, round(var_samp(sharpe), 8) AS sr_variance, count(CASE WHEN status IN ('shadow', 'paper', 'conditional') THEN 1 END)::INT AS shadow, count(CASE WHEN status = 'live' THEN 1 END)::INT AS live, count(CASE WHEN status = 'retired' THEN 1 END)::INT AS retired FROM t")
def program_ledger(spark, sf_dir):
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, ("shadow", "paper", "conditional", "live", "retired"))), (k % 5 + 1).cast("int"))
    trials = views.table(spark, sf_dir, "supplier").select(k.cast("string").alias("strategy_id"), status.alias("status"), (F.col("s_acctbal") / 1e4).alias("sharpe"), (k % 7).cast("int").alias("n_sweep_cells"))
    out = audit.ledger_summary(audit.checked_ledger(trials))
    return out.select("n_trials", "n_cells", F.round("sr_variance", 8).alias("sr_variance"), *[F.size(f"{s}_ids").alias(s) for s in ("shadow", "live", "retired")])
