"""Statistics, score, blind-spot and dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions import dates, risk as expressions, text
from riskframe.operators import dashboard, lookup, spots, stats
from riskframe.plans.blind_spots import blind_spots
from riskframe.plans.dashboard import dashboard_pack
from riskframe.plans.module_risk import module_risk
from riskframe.workloads import sqlviews as V, views
from riskframe.workloads.registry import query

_STATS = """module, total_bugs, open_bugs, closed_bugs, open_ratio, bug_density,
       weighted_priority_score, trend, recent_bug_count"""
_EVENTS = V.with_views(V.BUGS_EVENTS, V.scored_modules("bugs_events"))
_ORDERS = V.with_views(V.BUGS_ORDERS, V.scored_modules("bugs_orders"))


def _event_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_events(spark, sf_dir)
    return module_risk(bugs, views.EVENTS_NOW, classify_missing=False)


def _order_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_orders(spark, sf_dir)
    return module_risk(bugs, views.ORDERS_NOW, classify_missing=False)


@query("a1_module_stats", f"{_EVENTS} SELECT {_STATS} FROM modules")
def module_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.module_stats(views.bugs_events(spark, sf_dir), views.EVENTS_NOW)
    return rows.drop("priority_distribution")


@query(
    "a2_counts",
    f"""{V.with_views(V.BUGS_ORDERS)}
    SELECT component AS module, count(*) AS total_bugs,
           count(*) FILTER (WHERE NOT {V.CLOSED}) AS open_bugs,
           count(*) FILTER (WHERE {V.CLOSED}) AS closed_bugs
    FROM bugs_orders GROUP BY 1""",
)
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.module_stats(views.bugs_orders(spark, sf_dir), views.ORDERS_NOW)
    return rows.select("module", "total_bugs", "open_bugs", "closed_bugs")


@query(
    "a5_priority_histogram",
    f"""{V.with_views(V.BUGS_EVENTS)}
    SELECT component AS module, priority, count(*) AS bugs FROM bugs_events GROUP BY 1, 2""",
)
def priority_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.priority_histogram(views.bugs_events(spark, sf_dir))


@query(
    "r2_histogram_map",
    f"""{V.with_views(V.BUGS_EVENTS)},
    counted AS (SELECT component AS module, priority, count(*) AS n FROM bugs_events GROUP BY 1, 2)
    SELECT module, string_agg(priority || '=' || n, ';' ORDER BY priority) AS distribution
    FROM counted GROUP BY 1""",
)
def histogram_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.module_stats(views.bugs_events(spark, sf_dir), views.EVENTS_NOW)
    entries = F.array_sort(F.map_entries("priority_distribution"))
    pair = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return rows.select("module", F.array_join(pair, ";").alias("distribution"))


@query("a9_module_risk", f"{_EVENTS} SELECT {_STATS}, risk_score, risk_level FROM modules")
def module_risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_modules(spark, sf_dir).drop("priority_distribution")


@query("p1_module_risk", f"{_ORDERS} SELECT {_STATS}, risk_score, risk_level FROM modules")
def module_risk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship query."""
    return _order_modules(spark, sf_dir).drop("priority_distribution")


@query(
    "a10_density",
    f"{_EVENTS} SELECT module, bug_density, total_bugs, risk_score, risk_level FROM modules",
)
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.density_map(_event_modules(spark, sf_dir))


@query(
    "a11_risk_summary",
    f"""{_EVENTS}, {V.EVENT_RESULTS}
    SELECT (SELECT count(*) FROM bugs_events) AS total_bugs, count(*) AS analyzed_count,
           (SELECT count(*) FROM modules) AS modules, max(analyzed_at) AS last_updated
    FROM event_results""",
)
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_events(spark, sf_dir)
    results = views.event_results(spark, sf_dir)
    return stats.risk_summary(bugs, _event_modules(spark, sf_dir), results)


@query(
    "j13_module_risks",
    f"""{_EVENTS}, {V.scored_modules("bugs_events", "stored", "2024-01-01T00:00:00")}
    SELECT m.module, m.risk_score AS score, m.risk_level AS level, m.total_bugs AS bug_count,
           m.open_bugs AS open_count, s.bug_density AS stored_density
    FROM modules m JOIN stored s USING (module)""",
)
def module_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = _event_modules(spark, sf_dir)
    return stats.module_risks(modules, stats.density_map(modules))


@query(
    "a13_risk_kpi",
    f"""{_ORDERS}
    SELECT count(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical_modules,
           count(*) FILTER (WHERE risk_level = 'HIGH') AS high_modules,
           coalesce(string_agg(module, ', ' ORDER BY module) FILTER (WHERE risk_level = 'CRITICAL'), '')
             AS critical_names
    FROM modules""",
)
def risk_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.risk_kpis(_order_modules(spark, sf_dir))


@query("a14_shares", f"{_EVENTS} SELECT module, total_bugs AS bugs FROM modules")
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.module_shares(_event_modules(spark, sf_dir))


@query(
    "a15_weekly_created",
    f"""{V.with_views(V.BUGS_ORDERS)}
    SELECT strftime(date_trunc('week', CAST(left(created, 10) AS DATE)), '%Y-%m-%d') AS week,
           component AS module, count(*) AS bugs
    FROM bugs_orders GROUP BY 1, 2""",
)
def weekly_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dashboard.weekly_created(views.bugs_orders(spark, sf_dir))
    return rows.withColumn("week", F.col("week").cast("string"))


@query(
    "a16_open_closed",
    f"""{V.with_views(V.BUGS_EVENTS)}
    SELECT component AS module,
           CASE WHEN lower(status) IN ('to do', 'open', 'in progress', 'in review', 'reopened')
                THEN 'Açık' ELSE 'Kapalı' END AS state, count(*) AS bugs
    FROM bugs_events GROUP BY 1, 2""",
)
def open_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.open_closed(views.bugs_events(spark, sf_dir))


@query(
    "w1_cumulative",
    f"""{V.with_views(V.BUGS_ORDERS)},
    days AS (SELECT left(created, 10) AS day, count(*) AS created FROM bugs_orders GROUP BY 1)
    SELECT day, created, CAST(sum(created) OVER (ORDER BY day) AS BIGINT) AS total FROM days""",
)
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dashboard.cumulative_created(views.bugs_orders(spark, sf_dir))
    return rows.withColumn("day", F.col("day").cast("string"))


@query(
    "o5_ranking",
    f"""{_EVENTS}
    SELECT module, risk_score, risk_level, total_bugs, open_bugs,
           row_number() OVER (ORDER BY risk_score DESC, module) AS rank
    FROM modules""",
)
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.module_ranking(_event_modules(spark, sf_dir))


@query(
    "f5_levels",
    f"""SELECT doc_id, n_chars % 101 AS score, {V.LEVEL.format('n_chars % 101')} AS level
    FROM documents""",
)
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("n_chars") % 101
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", score.alias("score"), expressions.risk_level(score).alias("level")
    )


@query(
    "f6_f7_predicates",
    f"""{V.with_views(V.BUGS_EVENTS)}
    SELECT status, {V.CLOSED} AS closed, lower(status) IN ('in progress', 'in review') AS worked_on,
           count(*) AS bugs
    FROM bugs_events GROUP BY 1, 2, 3""",
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [
        expressions.is_closed().alias("closed"), expressions.is_worked_on().alias("worked_on"),
    ]
    bugs = views.bugs_events(spark, sf_dir)
    return bugs.groupBy("status", *flags).agg(F.count("*").alias("bugs"))


# --- blind spots -------------------------------------------------------------


@query(
    "j3_unanalyzed",
    f"""{_EVENTS}, {V.EVENT_RESULTS},
    named AS (SELECT first_module AS module FROM event_results
              UNION SELECT second_module FROM event_results)
    SELECT module, risk_level, risk_score, total_bugs AS bug_count, open_bugs,
           row_number() OVER (ORDER BY risk_score DESC, module) AS rank
    FROM modules WHERE risk_score >= 35 AND module NOT IN (SELECT module FROM named)""",
)
def unanalyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spots.unanalyzed_modules(
        _event_modules(spark, sf_dir), views.event_results(spark, sf_dir)
    )
    return found.drop("category", "code", "params")


_NEGLECTED = f"""
neglected AS (
  SELECT key, summary, priority, status, component, {V.days_open("bugs_events")} AS days_open, position
  FROM bugs_events
  WHERE priority IN ('Highest', 'High') AND lower(status) IN ('to do', 'open', 'backlog', 'new')),
neglected_ranked AS (
  SELECT *, row_number() OVER (ORDER BY priority = 'Highest' DESC, days_open DESC, position) AS rank
  FROM neglected)"""
_STALE = f"""
stale AS (
  SELECT key, summary, priority, status, component, {V.days_open("bugs_events")} AS days_open, position
  FROM bugs_events
  WHERE lower(status) IN ('to do', 'open', 'in progress', 'in review', 'backlog', 'new', 'reopened')),
stale_ranked AS (
  SELECT *, row_number() OVER (ORDER BY days_open DESC, position) AS rank
  FROM stale WHERE days_open >= 14)"""
_BUG_FINDING = "key, summary, priority, status, component, days_open, rank"


@query(
    "p2_neglected",
    f"{V.with_views(V.BUGS_EVENTS, _NEGLECTED)} SELECT {_BUG_FINDING} FROM neglected_ranked",
)
def neglected(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_events(spark, sf_dir)
    return spots.neglected_bugs(bugs, views.EVENTS_NOW, "position").drop("category", "code", "params")


@query(
    "p2_stale", f"{V.with_views(V.BUGS_EVENTS, _STALE)} SELECT {_BUG_FINDING} FROM stale_ranked"
)
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_events(spark, sf_dir)
    return spots.stale_bugs(bugs, views.EVENTS_NOW, order_by="position").drop(
        "category", "code", "params"
    )


@query(
    "o7_first_neglected",
    f"""{V.with_views(V.BUGS_EVENTS, _NEGLECTED)}
    SELECT {_BUG_FINDING} FROM neglected_ranked WHERE rank <= 3""",
)
def first_neglected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neglected(spark, sf_dir).orderBy("rank").limit(3)


# A clock inside the event month, so that some modules are on the rise.
_RISING_SQL = f"""{_EVENTS}
    SELECT module, total_bugs AS bug_count, open_bugs, recent_bug_count AS recent_bugs,
           0 AS in_progress, row_number() OVER (ORDER BY recent_bug_count DESC, module) AS rank
    FROM modules
    WHERE trend = 'increasing' AND module NOT IN (
      SELECT component FROM bugs_events WHERE lower(status) IN ('in progress', 'in review'))"""


@query("j4_rising", _RISING_SQL)
def rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spots.rising_modules(views.bugs_events(spark, sf_dir), _event_modules(spark, sf_dir))
    return found.drop("category", "code", "params")


_ATTENDED_BUGS = """
bugs_new AS (SELECT key, summary, description, priority,
                    CASE WHEN component = 'view' THEN status ELSE 'New' END AS status,
                    component, created, position FROM bugs_events)"""


@query(
    "j4_rising_untouched",
    f"""{V.with_views(V.BUGS_EVENTS, _ATTENDED_BUGS,
                      V.scored_modules("bugs_new", cutoff="2024-01-16T00:00:00"))}
    SELECT module, total_bugs AS bug_count, open_bugs, recent_bug_count AS recent_bugs,
           0 AS in_progress, row_number() OVER (ORDER BY recent_bug_count DESC, module) AS rank
    FROM modules
    WHERE trend = 'increasing' AND module NOT IN (
      SELECT component FROM bugs_new WHERE lower(status) IN ('in progress', 'in review'))""",
)
def rising_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_events(spark, sf_dir).withColumn(
        "status", F.when(F.col("component") == "view", F.col("status")).otherwise("New")
    )
    modules = module_risk(bugs, views.EVENTS_NOW, classify_missing=False)
    return spots.rising_modules(bugs, modules).drop("category", "code", "params")


def _event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blind_spots(
        views.bugs_events(spark, sf_dir),
        views.event_results(spark, sf_dir),
        views.EVENTS_NOW,
        order_by="position",
        ranked=False,
    )


_FINDINGS = f"""{_EVENTS}, {V.EVENT_RESULTS}, {_NEGLECTED}, {_STALE},
named AS (SELECT first_module AS module FROM event_results
          UNION SELECT second_module FROM event_results),
findings AS (
  SELECT 'unanalyzed_risky_modules' AS category, module AS subject, risk_level, 0 AS days_open,
         module || ' modülü ' || risk_level || ' risk seviyesinde ancak henüz analiz edilmemiş. '
         || 'Canlı Analiz sayfasından analiz yapın.' AS sentence
  FROM modules WHERE risk_score >= 35 AND module NOT IN (SELECT module FROM named)
  UNION ALL
  SELECT 'neglected_critical_bugs', key, NULL, days_open,
         key || ' — ' || priority || ' öncelikli bug ' || days_open || ' gündür ''' || status
         || ''' durumunda. Acil müdahale gerekiyor.' FROM neglected
  UNION ALL
  SELECT 'stale_bugs', key, NULL, days_open,
         key || ' — ' || days_open || ' gündür açık. Çözüm süresi beklentinin üzerinde.'
  FROM stale_ranked
  UNION ALL
  SELECT 'rising_unattended', module, NULL, 0,
         module || ' modülünde bug sayısı artıyor (' || recent_bug_count || ' yeni bug) ancak '
         || 'üzerinde çalışılan bug yok. Bu modüle kaynak ayrılması önerilir.'
  FROM modules WHERE trend = 'increasing' AND module NOT IN (
      SELECT component FROM bugs_events WHERE lower(status) IN ('in progress', 'in review')))"""


@query("c14_sentences", f"{_FINDINGS} SELECT category, subject, sentence FROM findings")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings (P2, X4, R3) with their sentences."""
    return _event_findings(spark, sf_dir).select(
        "category", F.coalesce("module", "key").alias("subject"),
        text.finding_sentence().alias("sentence"),
    )


@query(
    "a12_spot_summary",
    f"""{_FINDINGS}
    SELECT count(*) AS total_blind_spots,
           count(*) FILTER (WHERE category = 'neglected_critical_bugs' OR
             (category = 'unanalyzed_risky_modules' AND risk_level = 'CRITICAL')) AS critical_spots,
           count(*) FILTER (WHERE category = 'unanalyzed_risky_modules') AS unanalyzed_risky_modules,
           count(*) FILTER (WHERE category = 'neglected_critical_bugs') AS neglected_critical_bugs,
           count(*) FILTER (WHERE category = 'stale_bugs') AS stale_bugs,
           count(*) FILTER (WHERE category = 'rising_unattended') AS rising_unattended
    FROM findings""",
)
def spot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.spot_summary(_event_findings(spark, sf_dir))


@query(
    "c20_actions",
    f"""{_FINDINGS},
    counted AS (SELECT category, count(*) AS n FROM findings GROUP BY 1)
    SELECT CASE category WHEN 'unanalyzed_risky_modules' THEN 1 WHEN 'neglected_critical_bugs' THEN 2
                WHEN 'stale_bugs' THEN 3 ELSE 4 END AS line,
           CASE category
             WHEN 'unanalyzed_risky_modules' THEN '⚡ ' || n || ' riskli modülü **Canlı Analiz** sayfasından analiz edin'
             WHEN 'neglected_critical_bugs' THEN '🚨 ' || n || ' kritik bug''a kaynak atayın veya öncelik güncelleyin'
             WHEN 'stale_bugs' THEN '🕐 ' || n || ' bayat bug''ı gözden geçirin — kapatılabilir veya önceliklendirilebilir'
             ELSE '📈 ' || n || ' modüle ek test kaynağı ayrılması önerilir' END AS action
    FROM counted""",
)
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.action_lines(spots.spot_summary(_event_findings(spark, sf_dir)))


# --- lookups and lists -------------------------------------------------------


@query(
    "f1_lookup",
    f"{V.with_views(V.BUGS_EVENTS)} SELECT key, summary, status FROM bugs_events WHERE key = 'EV-77'",
)
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_events(spark, sf_dir)
    return lookup.first_with_key(bugs, "EV-77", ["position"]).select("key", "summary", "status")


@query(
    "f2_faceted_list",
    f"""{V.with_views(V.BUGS_EVENTS)}
    SELECT key, summary, priority, status, component FROM bugs_events
    WHERE priority IN ('Highest', 'Low') AND status IN ('To Do', 'Closed', 'In Review')
      AND component IN ('click', 'error')
      AND (contains(lower(key), 'r {{"k": 7') OR contains(lower(summary), 'r {{"k": 7'))""",
)
def faceted_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.faceted(
        views.bugs_events(spark, sf_dir),
        ["Highest", "Low"], ["To Do", "Closed", "In Review"], ["click", "error"], 'R {"K": 7',
    )
    return found.select("key", "summary", "priority", "status", "component")


@query(
    "f3_facets",
    f"""{V.with_views(V.BUGS_EVENTS)}
    SELECT 'priority' AS facet, priority AS value FROM bugs_events
    UNION SELECT 'status', status FROM bugs_events
    UNION SELECT 'component', component FROM bugs_events""",
)
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.facet_values(views.bugs_events(spark, sf_dir))


@query(
    "f4_listing",
    f"""{V.with_views(V.BUGS_ORDERS)}
    SELECT key, summary, priority, status, component, left(created, 10) AS created FROM bugs_orders""",
)
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.listing(views.bugs_orders(spark, sf_dir))


@query(
    "j1_bug_risk",
    f"""{_EVENTS}
    SELECT key, component, coalesce(risk_score, 0) AS module_risk_score,
           {V.LEVEL.format('coalesce(risk_score, 0)')} AS module_risk_level
    FROM bugs_events LEFT JOIN modules ON module = component""",
)
def bug_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bugs = views.bugs_events(spark, sf_dir)
    joined = lookup.with_module_risk(bugs, _event_modules(spark, sf_dir))
    return joined.select("key", "component", "module_risk_score", "module_risk_level")


@query(
    "d1_ages",
    f"""{V.with_views(V.BUGS_ORDERS)}
    SELECT key, {V.days_open("bugs_orders")} AS days_open FROM bugs_orders""",
)
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bugs_orders(spark, sf_dir).select(
        "key", dates.days_since(F.col("created"), views.ORDERS_NOW).alias("days_open")
    )


@query(
    "p10_dashboard_sizes",
    f"""{_EVENTS}
    SELECT 'ranking' AS part, (SELECT count(*) FROM modules) AS rows
    UNION ALL SELECT 'weekly_created', (SELECT count(*) FROM (
        SELECT DISTINCT date_trunc('week', CAST(left(created, 10) AS DATE)), component FROM bugs_events))
    UNION ALL SELECT 'open_closed', (SELECT count(*) FROM (SELECT DISTINCT component,
        lower(status) IN ('to do', 'open', 'in progress', 'in review', 'reopened') FROM bugs_events))
    UNION ALL SELECT 'cumulative', (SELECT count(DISTINCT left(created, 10)) FROM bugs_events)
    UNION ALL SELECT 'listing', (SELECT count(*) FROM bugs_events)""",
)
def dashboard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of the dashboard pack (P10) evaluated, as row counts."""
    modules = _event_modules(spark, sf_dir)
    pack = dashboard_pack(
        views.bugs_events(spark, sf_dir),
        views.event_results(spark, sf_dir),
        stats.density_map(modules),
        views.EVENTS_NOW,
    )
    parts = ("ranking", "weekly_created", "open_closed", "cumulative", "listing")
    sizes = [
        pack[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        for name in parts
    ]
    total = sizes[0]
    for size in sizes[1:]:
        total = total.unionByName(size)
    return total


@query(
    "p10_dashboard",
    f"""{_EVENTS}, {V.EVENT_RESULTS}, {V.scored_modules("bugs_events", "stored", "2024-01-01T00:00:00")},
    days AS (SELECT left(created, 10) AS day, count(*) AS created FROM bugs_events GROUP BY 1)
    SELECT 'summary' AS part, 'total_bugs' AS name, '' AS detail, count(*)::DOUBLE AS value FROM bugs_events
    UNION ALL SELECT 'summary', 'analyzed_count', max(analyzed_at), count(*) FROM event_results
    UNION ALL SELECT 'summary', 'modules', '', count(*) FROM modules
    UNION ALL SELECT 'module_risks', m.module, m.risk_level || ' ' || m.total_bugs || ' ' || m.open_bugs
        || ' ' || round(s.bug_density * 1000000)::BIGINT, m.risk_score FROM modules m JOIN stored s USING (module)
    UNION ALL SELECT 'kpis', 'critical',
        coalesce(string_agg(module, ', ' ORDER BY module) FILTER (WHERE risk_level = 'CRITICAL'), ''),
        count(*) FILTER (WHERE risk_level = 'CRITICAL') FROM modules
    UNION ALL SELECT 'kpis', 'high', '', count(*) FILTER (WHERE risk_level = 'HIGH') FROM modules
    UNION ALL SELECT 'ranking', module, risk_level, row_number() OVER (ORDER BY risk_score DESC, module) FROM modules
    UNION ALL SELECT 'shares', module, '', total_bugs FROM modules
    UNION ALL SELECT 'weekly_created', component,
        strftime(date_trunc('week', CAST(left(created, 10) AS DATE)), '%Y-%m-%d'), count(*)
        FROM bugs_events GROUP BY 2, 3
    UNION ALL SELECT 'open_closed', component,
        CASE WHEN lower(status) IN ('to do', 'open', 'in progress', 'in review', 'reopened')
             THEN 'Açık' ELSE 'Kapalı' END, count(*) FROM bugs_events GROUP BY 2, 3
    UNION ALL SELECT 'cumulative', day, created::VARCHAR, sum(created) OVER (ORDER BY day) FROM days
    UNION ALL SELECT DISTINCT 'facets', 'priority', priority, 1 FROM bugs_events
    UNION ALL SELECT DISTINCT 'facets', 'status', status, 1 FROM bugs_events
    UNION ALL SELECT DISTINCT 'facets', 'component', component, 1 FROM bugs_events
    UNION ALL SELECT 'listing', key, summary || '|' || priority || '|' || status || '|' || component || '|' || left(created, 10), 1
        FROM bugs_events""",
)
def dashboard_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: all ten parts of the dashboard pack with their values, as one table."""
    pack = dashboard_pack(
        views.bugs_events(spark, sf_dir),
        views.event_results(spark, sf_dir),
        stats.density_map(_event_modules(spark, sf_dir)),
        views.EVENTS_NOW,
    )

    def rows(part: str, frame: str, name, detail, value) -> DataFrame:
        text = lambda x: F.coalesce(x.cast("string"), F.lit("")) if not isinstance(x, str) else F.lit(x)
        return pack[frame].select(
            F.lit(part).alias("part"), text(name).alias("name"), text(detail).alias("detail"), value.cast("double").alias("value")
        )

    c = F.col
    millionths = F.round(c("stored_density") * 1_000_000).cast("bigint")
    parts = [
        rows("summary", "summary", "total_bugs", "", c("total_bugs")),
        rows("summary", "summary", "analyzed_count", c("last_updated"), c("analyzed_count")),
        rows("summary", "summary", "modules", "", c("modules")),
        rows("module_risks", "module_risks", c("module"), F.concat_ws(" ", "level", "bug_count", "open_count", millionths), c("score")),
        rows("kpis", "kpis", "critical", c("critical_names"), c("critical_modules")),
        rows("kpis", "kpis", "high", "", c("high_modules")),
        rows("ranking", "ranking", c("module"), c("risk_level"), c("rank")),
        rows("shares", "shares", c("module"), "", c("bugs")),
        rows("weekly_created", "weekly_created", c("module"), c("week"), c("bugs")),
        rows("open_closed", "open_closed", c("module"), c("state"), c("bugs")),
        rows("cumulative", "cumulative", c("day"), c("created"), c("total")),
        rows("facets", "facets", c("facet"), c("value"), F.lit(1)),
        rows("listing", "listing", c("key"), F.concat_ws("|", "summary", "priority", "status", "component", "created"), F.lit(1)),
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total
