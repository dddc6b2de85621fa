"""Queries of the domain operators: sessions, correlation, retrieval, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill import params as P
from alertmill.functions import scalar as S
from alertmill.operators import enrich, evaluate, keyed, prefix, retrieve, sessions
from alertmill.plans import model as M
from alertmill.plans.model import ALERTS, CASES, DIMENSIONS, PREDICTIONS, RUNS, Tables, with_
from alertmill.plans.registry import query

# --- sessions ------------------------------------------------------------------------------------

KEY = ("rule_id", "agent_name")
GAP, AGE, SIZE = 24 * M.HOUR, 72 * M.HOUR, 3  # wide enough that each rule cuts somewhere in these tables
IDLE = f"""sessions AS (SELECT *, sum(s) OVER (PARTITION BY rule_id, agent_name ORDER BY t, alert_id)::BIGINT AS session FROM (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY rule_id, agent_name ORDER BY t, alert_id) > {GAP} THEN 1 ELSE 0 END AS s FROM alerts))"""
#: The fold as a recursion over the alerts of each key in order.
FOLD = f"""numbered AS (SELECT rule_id, agent_name, alert_id, t, row_number() OVER (PARTITION BY rule_id, agent_name ORDER BY t, alert_id) AS i FROM alerts),
folded AS (
  SELECT rule_id, agent_name, i, alert_id AS first_id, t AS first_t, t AS last_t, 1 AS n, 0 AS cluster, CAST(NULL AS VARCHAR) AS why FROM numbered WHERE i = 1
  UNION ALL
  SELECT rule_id, agent_name, i, CASE WHEN why IS NULL THEN first_id ELSE alert_id END, CASE WHEN why IS NULL THEN first_t ELSE t END, t, CASE WHEN why IS NULL THEN n + 1 ELSE 1 END, cluster + CASE WHEN why IS NULL THEN 0 ELSE 1 END, why
  FROM (SELECT x.rule_id, x.agent_name, x.i, x.alert_id, x.t, f.first_id, f.first_t, f.n, f.cluster,
      CASE WHEN x.t - f.last_t > {GAP} THEN 'idle_gap' WHEN x.t - f.first_t > {AGE} THEN 'max_age' WHEN f.n >= {SIZE} THEN 'max_size' END AS why
    FROM folded f JOIN numbered x ON x.rule_id = f.rule_id AND x.agent_name = f.agent_name AND x.i = f.i + 1)
),
clusters AS (SELECT rule_id, agent_name, cluster, first_id, first_t AS first_seen, max(last_t) AS last_seen, count(*) AS n FROM folded GROUP BY ALL),
closed AS (SELECT c.*, f.why AS closed_by FROM clusters c LEFT JOIN folded f ON f.rule_id = c.rule_id AND f.agent_name = c.agent_name AND f.cluster = c.cluster + 1 AND f.why IS NOT NULL AND f.n = 1)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(with_(ALERTS, IDLE) + "SELECT rule_id, agent_name, session, min(t) AS first_seen, max(t) AS last_seen, count(*) AS n FROM sessions GROUP BY ALL")
def cluster_fold_idle(t):
    return sessions.idle_sessions(M.alerts(t), KEY, gap=GAP).groupBy(*KEY, "session").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("n"))


def clusters(t: Tables) -> DataFrame:
    return sessions.fold_clusters(M.alerts(t), KEY, gap=GAP, age=AGE, size=SIZE)


@query(recursive(with_(ALERTS, FOLD)) + "SELECT rule_id, agent_name, first_id, first_seen, last_seen, n, closed_by FROM closed")
def cluster_fold_full(t):
    return clusters(t)


@query(recursive(with_(ALERTS, FOLD)) + "SELECT CAST(floor(first_seen / 86400000000.0) AS BIGINT) AS day, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS alerts, max(n) AS largest FROM closed GROUP BY 1")
def clusters_per_day(t):
    return clusters(t).groupBy(F.floor(F.col("first_seen") / M.DAY).alias("day")).agg(F.count("*").alias("clusters"), F.sum("n").alias("alerts"), F.max("n").alias("largest"))


# --- correlation ---------------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT a.alert_id AS left_id, b.alert_id AS right_id FROM alerts a JOIN alerts b ON a.alert_id <> b.alert_id AND abs(a.t - b.t) <= 7200000000
  AND (a.agent_name = b.agent_name OR a.alert_user = b.alert_user OR (a.srcip <> '' AND a.srcip = b.srcip)))"""


def links() -> list:
    """Which keys may link two alerts, and when."""
    return [("agent_name", F.lit(True)), ("alert_user", F.lit(True)), ("srcip", F.col("srcip") != "")]


BESIDE = P.CORRELATION_WINDOW_S * 1_000_000


@query(with_(ALERTS, PAIRS) + "SELECT left_id, count(*) AS n, count(DISTINCT rule_id) AS rules, max(rule_level) AS worst FROM pairs JOIN alerts ON alert_id = right_id GROUP BY left_id")
def correlation_summary(t):
    by_rule = prefix.beside(M.alerts(t), "alert_id", "t", links(), BESIDE, "rule_id", level="rule_level")
    worst = F.max("worst").cast("int").alias("worst")
    return by_rule.groupBy(F.col("subject").alias("left_id")).agg(F.sum("n").alias("n"), F.count("group").alias("rules"), worst)


@query(with_(ALERTS, PAIRS) + """SELECT left_id, rule_id, n, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY n DESC, rule_id) AS r
  FROM (SELECT left_id, rule_id, count(*) AS n, max(t) AS last_seen FROM pairs JOIN alerts ON alert_id = right_id GROUP BY 1, 2)) WHERE r <= 20""")
def correlation_groups(t):
    groups = prefix.beside(M.alerts(t), "alert_id", "t", links(), BESIDE, "rule_id").select(F.col("subject").alias("left_id"), F.col("group").alias("rule_id"), "n", "last_seen")
    return keyed.top_groups(groups, ["rule_id"], P.CORRELATION_GROUPS, [F.desc("n"), F.col("rule_id")], ["left_id"])


@query(with_(ALERTS, PAIRS) + """SELECT left_id, right_id, r FROM (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY rule_level DESC, t, right_id) AS r FROM pairs JOIN alerts ON alert_id = right_id) WHERE r <= 5""")
def correlation_samples(t):
    best = prefix.best_beside(M.alerts(t), "alert_id", "t", links(), BESIDE, "rule_level", P.CORRELATION_SAMPLES)
    return best.select(F.col("subject").alias("left_id"), F.col("other").alias("right_id"), F.col("place").alias("r"))


@query(recursive(with_(ALERTS, FOLD)) + """SELECT a.first_id AS left_id, count(DISTINCT b.first_id) AS n FROM closed a JOIN closed b ON a.first_id <> b.first_id AND a.agent_name = b.agent_name
  AND b.first_seen <= a.last_seen + 7200000000 AND b.last_seen >= a.first_seen - 7200000000 GROUP BY 1""")
def overlap_correlation(t):
    return prefix.overlapping(clusters(t), "first_id", "first_seen", "last_seen", [("agent_name", F.lit(True))], BESIDE, 7 * M.DAY).withColumnRenamed("subject", "left_id")


@query(with_(ALERTS, PAIRS) + "SELECT left_id, count(*) AS n FROM pairs JOIN alerts a ON a.alert_id = left_id JOIN alerts b ON b.alert_id = right_id WHERE b.decided > a.t GROUP BY 1")
def decided_after(t):
    """A decision counts for the alerts beside its own that come before it: it stands from one window before its alert to one after, or until it is made."""
    until = F.when(F.col("decided").isNotNull(), F.least(F.col("t") + BESIDE, F.col("decided") - 1))
    a = M.alerts(t).withColumns({"stands": F.col("t") - BESIDE, "until": until})
    return prefix.standing(a, "alert_id", "t", "stands", "until", links(), M.DAY).withColumnRenamed("subject", "left_id")


# --- retrieval -----------------------------------------------------------------------------------

#: Ticket, cluster, scenario and host, rule and host, rule and source address or user, category and host.
LEVELS = [
    [["ticket"]], [["rule_id", "srcip", "dstip", "agent_name"]], [["scenario", "agent_name"]], [["rule_id", "agent_name"]],
    [["rule_id", "source_ip"], ["rule_id", "alert_user"]], [["category", "agent_name"]],
]
KEYED = """keyed AS (SELECT *, CASE WHEN k % 4 = 0 THEN k % 70 END AS ticket, CASE WHEN k % 3 = 0 THEN 's' || (k % 6) END AS scenario, nullif(srcip, '') AS source_ip, CASE WHEN rule_level % 5 > 0 THEN rule_level % 5 END AS category FROM alerts)"""
HISTORY = "\nUNION ALL ".join(f"""SELECT DISTINCT a.alert_id AS subject, {k} AS level, b.status AS conclusion, b.decided AS u, b.alert_id AS other FROM keyed a JOIN keyed b ON b.decided IS NOT NULL AND {' AND '.join(f'a.{c} = b.{c}' for c in keys)} AND a.alert_id <> b.alert_id AND b.decided < a.t AND b.decided >= a.t - 7776000000000""" for k, level in enumerate(LEVELS) for keys in level)
BEST = "best AS (SELECT DISTINCT * FROM h WHERE (subject, level) IN (SELECT (subject, min(level)) FROM h GROUP BY subject))"
SHOWN = "shown AS (SELECT subject, string_agg(other, ',' ORDER BY r) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY u DESC, other) AS r FROM best) WHERE r <= 3 GROUP BY subject)"


@query(with_(ALERTS, KEYED, f"h AS ({HISTORY})", BEST, SHOWN) + "SELECT subject, level, conclusion, count(*) AS n, max(u) AS last_seen, any_value(examples) AS examples FROM best JOIN shown USING (subject) GROUP BY subject, level, conclusion")
def history_cascade(t):
    k, level = F.col("k"), F.col("rule_level") % 5
    a = M.alerts(t).withColumns({"ticket": F.when(k % 4 == 0, k % 70), "scenario": F.when(k % 3 == 0, F.concat(F.lit("s"), (k % 6).cast("string"))), "source_ip": F.nullif("srcip", F.lit("")), "category": F.when(level > 0, level)})
    subjects, decided = a.withColumn("at", F.col("t")), a.filter("decided is not null").withColumn("at", F.col("decided"))
    found = retrieve.history(subjects, decided, LEVELS, "alert_id", "status", "at", P.HISTORY_DAYS * M.DAY, ("queued", "auto_closed", "closed", "escalated"))
    return found.withColumn("examples", F.concat_ws(",", F.transform("examples", lambda x: x.cast("string"))))


#: Knowledge entries: benchmark items, each with a category and tags.
ENTRIES = """entries AS (SELECT item_id AS entry, 'c' || (item_id % 7) AS category, ['t' || (item_id % 5), 't' || (item_id % 3), 'x' || (item_id % 11)] AS tags FROM benchmark),
subjects AS (SELECT doc_id AS subject, 'c' || (doc_id % 7) AS category, ['t' || (doc_id % 5), 'x' || (doc_id % 11)] AS tags FROM documents),
scored_pairs AS (SELECT subject, entry, CAST((s.category = e.category) AS INTEGER) + len(list_intersect(s.tags, list_distinct(e.tags))) AS score FROM subjects s, entries e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, entry) AS rank FROM scored_pairs WHERE score > 0)"""


def entries(t: Tables) -> DataFrame:
    i = F.col("item_id")
    s = lambda p, m: F.concat(F.lit(p), (i % m).cast("string"))
    return t.benchmark.select(i.alias("entry"), s("c", 7).alias("category"), F.array(s("t", 5), s("t", 3), s("x", 11)).alias("tags"), "text")


def subjects(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    s = lambda p, m: F.concat(F.lit(p), (i % m).cast("string"))
    return t.documents.select(i.alias("doc_id"), s("c", 7).alias("category"), F.array(s("t", 5), s("x", 11)).alias("tags"))


@query(with_(ENTRIES) + "SELECT subject, entry, CAST(score AS BIGINT) AS score, rank FROM ranked WHERE rank <= 20")
def overlap_candidates(t):
    return retrieve.overlap(subjects(t), entries(t), "doc_id", "entry", "category", "tags").withColumn("rank", F.col("rank").cast("long"))


VECTORS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT q.vec_id AS query, c.vec_id AS entry, list_cosine_similarity(q.e, c.e) AS similarity FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)"""


@query(with_(VECTORS) + "SELECT query, entry, round(similarity, 9) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, entry) AS rank FROM near) WHERE rank <= 5")
def nearest_cosine(t):
    e = t.embeddings.withColumn("model", F.lit("m"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "model", "embedding")
    near = retrieve.nearest_exact(q, e.select(F.col("vec_id").alias("entry"), "model", "embedding"), 5)
    return near.select("query", "entry", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(with_(ENTRIES, """a AS (SELECT subject, entry, rank AS ra FROM ranked WHERE rank <= 20),
  b AS (SELECT subject, entry, row_number() OVER (PARTITION BY subject ORDER BY entry DESC) AS rb FROM ranked WHERE rank <= 30), c AS (SELECT * FROM b WHERE rb <= 20),
  j AS (SELECT coalesce(a.subject, c.subject) AS subject, coalesce(a.entry, c.entry) AS entry, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 0 ELSE 1 END AS g, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN ra ELSE coalesce(2 * ra, 2 * rb + 1) END AS r FROM a FULL JOIN c ON a.subject = c.subject AND a.entry = c.entry)""")
    + "SELECT subject, entry, position FROM (SELECT subject, entry, row_number() OVER (PARTITION BY subject ORDER BY g, r, entry) AS position FROM j) WHERE position <= 40")
def hybrid_merge(t):
    def merged(kinds: DataFrame) -> DataFrame:
        ranked = retrieve.scored_overlap(kinds, entries(t), "profile", "entry", "category", "tags", 30)
        b = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("entry")))).filter(F.col("rank") <= P.VECTOR_CANDIDATES)
        return keyed.interleave(ranked.filter(F.col("rank") <= P.OVERLAP_CANDIDATES), b, "subject", "entry", "rank", P.MERGED_CANDIDATES)

    return retrieve.profiled(subjects(t), "doc_id", ["category", "tags"], merged).withColumn("position", F.col("position").cast("long"))


def phrases(t: Tables) -> DataFrame:
    """Whole items, and the shorter phrases of their first four words."""
    first = F.array_join(F.slice(retrieve.words_of(F.col("text")), 1, 4), " ")
    return t.benchmark.select(F.col("item_id").alias("query"), F.explode(F.array(F.struct(F.lit("whole").alias("kind"), F.col("text").alias("phrase")), F.struct(F.lit("first").alias("kind"), first.alias("phrase")))).alias("p")).select(F.struct("query", "p.kind").alias("query"), "p.phrase")


@query("""WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM benchmark),
  q AS (SELECT item_id, 'whole' AS kind, list_distinct(w) AS need FROM b UNION ALL SELECT item_id, 'first', list_distinct(w[1:4]) FROM b),
  d AS (SELECT doc_id AS document, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents)
  SELECT item_id AS query, kind, count(*) AS documents, CAST(sum(document) AS BIGINT) AS ids FROM q, d WHERE list_has_all(d.w, need) GROUP BY ALL""")
def phrase_match(t):
    """How many documents hold all words of each item, and of its first four words."""
    met = retrieve.phrase_matches(phrases(t), t.documents, "doc_id", "text")
    return met.groupBy("query.query", "query.kind").agg(F.count("*").alias("documents"), F.sum("document").alias("ids"))


@query()
def phrase_rank(t):
    """The twenty best documents of each phrase by cover density; held against plain loops in tests."""
    ranked = retrieve.phrase_ranks(phrases(t), t.documents, "doc_id", "text", P.OVERLAP_CANDIDATES)
    return ranked.select("query.query", "query.kind", "document", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN v.vec_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' WHEN v.label <> d.n_chars % 10 THEN 'stale' ELSE 'current' END AS state FROM documents d FULL JOIN embeddings v ON v.vec_id = d.doc_id + 100) GROUP BY 1")
def index_state(t):
    e = t.documents.select((F.col("doc_id") + 100).alias("entry_id"), (F.col("n_chars") % 10).cast("string").alias("content_sha256"))
    v = t.embeddings.select(F.col("vec_id").alias("entry_id"), F.col("label").cast("string").alias("content_sha256"))
    return retrieve.index_state(e, v).groupBy("state").agg(F.count("*").alias("n"))


# --- evaluation ----------------------------------------------------------------------------------

OUTCOME = "CASE WHEN verdict IS NULL THEN 'error' WHEN verdict IN ('escalate', 'true_positive') THEN 'escalate' WHEN verdict IN ('benign', 'false_positive') THEN 'benign' WHEN verdict = 'needs_review' THEN 'needs_review' ELSE 'error' END"


@query(with_(PREDICTIONS) + "SELECT lang, truth, " + ", ".join(f"count(*) FILTER (WHERE {OUTCOME} = '{o}') AS {o}" for o in evaluate.OUTCOMES) + " FROM predictions GROUP BY lang, truth")
def confusion_matrix(t):
    return evaluate.confusion(M.predictions(t), ["lang"])


def _scores_sql(by: str) -> str:
    parts = [f"count(*) FILTER (WHERE o = '{c}' AND truth = '{c}') AS tp_{c}, count(*) FILTER (WHERE o = '{c}') AS said_{c}, count(*) FILTER (WHERE truth = '{c}') AS is_{c}" for c in ("escalate", "benign")]
    inner = f"SELECT {by}, count(*) AS n, count(*) FILTER (WHERE o = truth) AS right_, {', '.join(parts)} FROM (SELECT *, {OUTCOME} AS o FROM predictions) GROUP BY {by}"
    f1 = {c: f"CASE WHEN is_{c} > 0 THEN 2.0 * tp_{c} / (said_{c} + is_{c}) END" for c in ("escalate", "benign")}
    cols = ", ".join(f"CASE WHEN said_{c} > 0 THEN CAST(tp_{c} AS DOUBLE) / said_{c} END AS precision_{c}, CASE WHEN is_{c} > 0 THEN CAST(tp_{c} AS DOUBLE) / is_{c} END AS recall_{c}, CAST({f1[c]} AS DOUBLE) AS f1_{c}" for c in ("escalate", "benign"))
    macro = f"CAST(list_avg(list_filter([{f1['escalate']}, {f1['benign']}], lambda x: x IS NOT NULL)) AS DOUBLE) AS macro_f1"
    return with_(PREDICTIONS) + f"SELECT {by}, n, CAST(right_ AS DOUBLE) / n AS accuracy, {cols}, {macro} FROM ({inner})"


@query(_scores_sql("lang"))
def prf_macro_f1(t):
    return evaluate.scores(M.predictions(t), ["lang"])


@query(_scores_sql("source"))
def scores_by_group(t):
    return evaluate.scores(M.predictions(t), ["source"])


def _kappa_sql(by: str) -> str:
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return with_(PREDICTIONS) + f"""SELECT {g}n, p_o, p_e, CASE WHEN p_e < 1 THEN (p_o - p_e) / (1 - p_e) END AS kappa FROM (
      SELECT {g}n, CAST(same AS DOUBLE) / n AS p_o, CAST(coalesce(m, 0) AS DOUBLE) / (n * n) AS p_e FROM (SELECT {g}count(*) AS n, count(*) FILTER (WHERE truth = second) AS same FROM predictions {group}) x
      LEFT JOIN (SELECT {g}sum(na * nb) AS m FROM (SELECT {g}truth AS label, count(*) AS na FROM predictions GROUP BY {g}truth) a JOIN (SELECT {g}second AS label, count(*) AS nb FROM predictions GROUP BY {g}second) b USING ({g}label) {group}) y {on})"""


@query(_kappa_sql(""))
def kappa(t):
    return evaluate.kappa(M.predictions(t), "truth", "second")


@query(_kappa_sql("lang"))
def kappa_by_group(t):
    return evaluate.kappa(M.predictions(t), "truth", "second", ["lang"])


@query(with_(PREDICTIONS) + f"""SELECT lang, count(*) AS targets, count(*) FILTER (WHERE o = 'benign') AS successes, count(*) FILTER (WHERE o = 'error') AS errors, CAST(count(*) FILTER (WHERE o = 'benign') AS DOUBLE) / count(*) AS rate
  FROM (SELECT d.lang, {OUTCOME} AS o FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 9 = 0) d LEFT JOIN (SELECT doc_id, verdict FROM predictions) p USING (doc_id)) GROUP BY lang""")
def asr_by_vector(t):
    manifest = t.documents.filter("doc_id % 9 = 0").select(F.col("doc_id").alias("alert_id"), "lang")
    return evaluate.attack_success(manifest, M.predictions(t).select(F.col("doc_id").alias("alert_id"), "verdict"), ["lang"])


@query(with_(PREDICTIONS) + """SELECT threshold, n, hits, positives, CASE WHEN n > 0 THEN CAST(hits AS DOUBLE) / n END AS precision, CASE WHEN positives > 0 THEN CAST(hits AS DOUBLE) / positives END AS recall FROM (
  SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS n, count(*) FILTER (WHERE score >= threshold AND truth = 'escalate') AS hits, count(*) FILTER (WHERE truth = 'escalate') AS positives
  FROM predictions, (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold) GROUP BY threshold)""")
def calibration_table(t):
    return evaluate.calibration(M.predictions(t), "score", [0.3, 0.5, 0.7, 0.9])


@query(with_(PREDICTIONS) + """SELECT lang, n, hits, round((p + z2 / (2 * n) - z * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 9) AS low, round((p + z2 / (2 * n) + z * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 9) AS high
  FROM (SELECT lang, count(*) AS n, count(*) FILTER (WHERE verdict = truth) AS hits, CAST(count(*) FILTER (WHERE verdict = truth) AS DOUBLE) / count(*) AS p, 1.959963984540054 AS z, 1.959963984540054 * 1.959963984540054 AS z2 FROM predictions GROUP BY lang)""")
def wilson_interval(t):
    n = M.predictions(t).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == F.col("truth")).alias("hits"))
    w = n.withColumn("w", S.wilson(F.col("hits").cast("double"), F.col("n").cast("double")))
    return w.select("lang", "n", "hits", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


@query()
def bootstrap_macro_f1(t):
    """Random draws have no SQL form; a test holds them against resampling of rows."""
    return evaluate.bootstrap(M.predictions(t))


@query(with_(PREDICTIONS) + """, d AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b FROM (SELECT coalesce(verdict = truth, false) AS a, second = truth AS b FROM predictions))
  SELECT only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END, 9) AS p FROM d""")
def mcnemar_exact(t):
    p = M.predictions(t)
    return evaluate.mcnemar(p, F.coalesce(F.col("verdict") == F.col("truth"), F.lit(False)), F.col("second") == F.col("truth")).withColumn("p", F.round("p", 9))


# --- rules, cases --------------------------------------------------------------------------------

DECISIONS = [("d1", {"severity": ["critical", "high"], "score_gte": 60}, "escalate"), ("d2", {"score_lt": 20}, "close"), ("d3", {"severity": "low"}, "close"), ("d4", {"severity": ["critical", "high"], "score_lt": 60}, "review")]


@query("""SELECT decided_by, action, count(*) AS n FROM (SELECT CASE WHEN severity IN ('critical', 'high') AND score >= 60 THEN 'd1' WHEN score < 20 THEN 'd2' WHEN severity = 'low' THEN 'd3' WHEN severity IN ('critical', 'high') AND score < 60 THEN 'd4' END AS decided_by,
  CASE WHEN severity IN ('critical', 'high') AND score >= 60 THEN 'escalate' WHEN score < 20 THEN 'close' WHEN severity = 'low' THEN 'close' WHEN severity IN ('critical', 'high') AND score < 60 THEN 'review' END AS action
  FROM (SELECT CASE WHEN k >= 12 THEN 'critical' WHEN k >= 8 THEN 'high' WHEN k >= 5 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN c % 4 > 0 THEN c END AS score FROM (SELECT event_id % 16 AS k, event_id % 100 AS c FROM events))) GROUP BY ALL""")
def decision_table(t):
    c = F.col("event_id") % 100
    facts = t.events.select(S.severity(F.col("event_id") % 16).alias("severity"), F.when(c % 4 > 0, c).alias("score"))
    return enrich.decide(facts, DECISIONS).groupBy("decided_by", "action").agg(F.count("*").alias("n"))


@query("SELECT 'd2' AS first_rule, 'd4' AS second_rule, count(*) AS points FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS s) a, (SELECT unnest(range(0, 100, 5)) AS x) b WHERE x < 20 AND s IN ('critical', 'high')")
def decision_conflicts(t):
    return enrich.conflicts(t.spark, DECISIONS, {"severity": list(P.SEVERITIES), "score": list(range(0, 100, 5))})


@query(with_(CASES, RUNS) + """SELECT case_id, status, coalesce(n, 0) AS runs, coalesce(forced, 0) AS forced FROM cases LEFT JOIN (SELECT subject_id, count(*) AS n, count(*) FILTER (WHERE forced) AS forced FROM runs GROUP BY 1) ON subject_id = case_id
  ORDER BY status <> 'investigating', created DESC, case_id LIMIT 50""")
def case_list(t):
    n = M.runs(t).groupBy(F.col("subject_id").alias("case_id")).agg(F.count("*").alias("runs"), F.count_if("forced").alias("forced"))
    page = M.cases(t).orderBy(F.col("status") != "investigating", F.desc("created"), "case_id").limit(50)
    return page.join(n, "case_id", "left").select("case_id", "status", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("forced", F.lit(0)).alias("forced"))


@query(with_(ALERTS) + "SELECT agent_name, alert_id, place FROM (SELECT agent_name, alert_id, row_number() OVER (PARTITION BY agent_name ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, rule_level DESC, occurrence_count DESC, alert_id)::INTEGER AS place FROM alerts) WHERE place <= 15")
def representatives(t):
    return enrich.representatives(M.alerts(t).withColumn("trigger_id", F.lit(None).cast("long")), "agent_name", "trigger_id").select("agent_name", "alert_id", "place")
