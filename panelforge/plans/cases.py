"""Queries on forecast cases, controls and their nulls (inventory 2.8, 2.9b, 2.9c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import catalogue as C
from panelforge.operators import cases as K
from panelforge.plans.metrics import CASES_SQL, cases
from panelforge.plans.panels import EVENT_SQL, UNIT_SQL, unit_daily
from panelforge.plans.registry import Tables, query

STATE_SQL = f"{CASES_SQL}, s AS (SELECT *, CASE WHEN toxic = 1 THEN 'CENSORED' WHEN y = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS state FROM cases)"


def stated(t: Tables) -> DataFrame:
    return cases(t).withColumn("state", F.when(F.col("toxic") == 1, "CENSORED").when(F.col("y") == 1, "POSITIVE").otherwise("NEGATIVE"))


@query("q474_unambiguous", f"WITH {STATE_SQL} SELECT doc_id, state FROM s WHERE state <> 'CENSORED'")
def unambiguous(t: Tables) -> DataFrame:
    return K.unambiguous(stated(t)).select("doc_id", "state")


@query("q480_eligible", f"WITH {STATE_SQL} SELECT doc_id, state FROM s WHERE state <> 'CENSORED' AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)")
def eligible(t: Tables) -> DataFrame:
    return K.eligible(stated(t), t.documents.filter("n_chars > 1000"), "doc_id").select("doc_id", "state")


@query("q458_aligned", "SELECT count(l.doc_id) AS n_truth, count(d.doc_id) AS n_prob, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS n_both, count(l.doc_id) = count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AND count(d.doc_id) = count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS aligned FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id")
def aligned(t: Tables) -> DataFrame:
    return K.aligned(t.labels, t.documents, "doc_id")


@query("q476_core_metrics", f"""WITH {CASES_SQL}, c AS (SELECT lang, p, sum(y) AS y, count(*) AS n FROM cases GROUP BY 1, 2), r AS (SELECT lang, sum(y) OVER w AS tp, sum(n) OVER w AS k, y, sum(y) OVER (PARTITION BY lang) AS total FROM c WINDOW w AS (PARTITION BY lang ORDER BY p DESC)), a AS (SELECT lang, sum(tp / k * y / nullif(total, 0)) AS auprc FROM r GROUP BY 1),
    b AS (SELECT lang, count(*) AS n, avg((p - y) * (p - y)) AS brier, count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (y = 1), 0) AS recall, count(*) FILTER (y = 0 AND p >= 0.5) / count(*) AS fa FROM cases GROUP BY 1)
    SELECT lang, n, round(brier, 8) AS brier, round(auprc, 8) AS auprc, round(recall, 8) AS event_recall, round(fa, 8) AS false_alarms FROM b JOIN a USING (lang)""")
def core(t: Tables) -> DataFrame:
    m = K.core_metrics(cases(t), ["lang"], "y", "p", 0.5)
    return m.select("lang", "n", *[F.round(c, 8).alias(c) for c in ("brier", "auprc", "event_recall", "false_alarms")])


FEEDS = [("all feeds", ""), ("no first", "src0"), ("no second", "src1"), ("no such", "src99")]


@query("q304_degradation", f"""WITH {CASES_SQL}, d AS (SELECT scenario, y, CASE WHEN source = fails THEN 0.0 ELSE p END AS p FROM cases, (VALUES {", ".join(f"('{a}', '{b}')" for a, b in FEEDS)}) v(scenario, fails))
    SELECT scenario, count(*) AS n, round(avg((p - y) * (p - y)), 8) AS brier, round(count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (y = 1), 0), 8) AS event_recall FROM d GROUP BY 1""")
def degradation(t: Tables) -> DataFrame:
    m = K.core_metrics(K.degraded(cases(t), FEEDS, "source", "p"), ["scenario"], "y", "p", 0.5)
    return m.select("scenario", "n", F.round("brier", 8).alias("brier"), F.round("event_recall", 8).alias("event_recall"))


@query("q385_scenario_applicability", f"""WITH {CASES_SQL} SELECT scenario, count(*) FILTER (source = fails) AS hit, CASE WHEN fails = '' THEN 'baseline' WHEN count(*) FILTER (source = fails) = 0 THEN 'no case uses it' WHEN count(*) FILTER (source = fails) = count(*) THEN 'nothing is left' ELSE 'applicable' END AS status
    FROM cases, (VALUES {", ".join(f"('{a}', '{b}')" for a, b in FEEDS)}) v(scenario, fails) GROUP BY scenario, fails""")
def applicability(t: Tables) -> DataFrame:
    wide = cases(t).withColumn("s", F.explode(F.array(*[F.struct(F.lit(a).alias("scenario"), F.lit(b).alias("fails")) for a, b in FEEDS]))).select("source", "s.*")
    g = wide.groupBy("scenario", "fails").agg(F.count(F.when(F.col("source") == F.col("fails"), 1)).alias("hit"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("fails") == "", "baseline").when(F.col("hit") == 0, "no case uses it").when(F.col("hit") == F.col("n"), "nothing is left").otherwise("applicable")
    return g.select("scenario", "hit", status.alias("status"))


@query("q479_scoped_opportunities", """WITH linked AS (SELECT DISTINCT o_orderstatus AS grp, c_nationkey AS scope, c_custkey AS id FROM orders JOIN customer ON o_custkey = c_custkey), never AS (SELECT c_custkey AS id, c_nationkey AS scope FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
    every AS (SELECT * FROM linked UNION SELECT l.grp, l.scope, n.id FROM (SELECT DISTINCT grp, scope FROM linked) l JOIN never n USING (scope)) SELECT grp, count(*) AS n FROM every GROUP BY 1""")
def scoped(t: Tables) -> DataFrame:
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderstatus").alias("grp"), F.col("c_nationkey").alias("scope"), F.col("c_custkey").alias("id"))
    return K.scoped_count(c, c, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("scope")), "grp", "id", "scope")


@query("q478_group_sizes", f"WITH {CASES_SQL} SELECT y::VARCHAR AS key, count(*) AS n, min(doc_id) AS first_id FROM cases GROUP BY 1")
def group_sizes(t: Tables) -> DataFrame:
    return cases(t).groupBy(F.col("y").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("q150_marginal_rate", f"WITH {CASES_SQL} SELECT source, count(*) AS n, round(avg(y), 8) AS rate FROM cases GROUP BY 1")
def marginal(t: Tables) -> DataFrame:
    """The rate of a training partition: what a forecast without features says. Partitions are the sources."""
    return cases(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 8).alias("rate"))


@query("q383_locked_regions", "SELECT array_to_string(list_filter([CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT n_regionkey FROM nation) WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name < 'B')) > 0 THEN 'unlocked' END, CASE WHEN (SELECT count(DISTINCT n_regionkey) FROM nation) < 2 THEN 'single' END], lambda x: x IS NOT NULL), ',') AS problems")
def locked(t: Tables) -> DataFrame:
    """Evaluation regions must be locked test groups, and at least two."""
    used = t.nation.select(F.col("n_regionkey").alias("r")).distinct()
    locked_ = t.region.filter("r_name < 'B'").select(F.col("r_regionkey").alias("r"), F.lit(1).alias("ok"))
    n = used.join(locked_, "r", "left").agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("ok"))
    return n.select(F.array_join(F.array_compact(F.array(F.when(F.col("ok") < F.col("n"), "unlocked"), F.when(F.col("n") < 2, "single"))), ",").alias("problems"))


@query("q389_holdout_binding", "SELECT side, count(*) AS outside FROM (SELECT 'event' AS side, c_nationkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000 UNION ALL SELECT 'control', s_nationkey FROM supplier) WHERE k NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')) GROUP BY 1")
def binding(t: Tables) -> DataFrame:
    """Events and controls that lie outside the held-out regions."""
    test = t.nation.join(t.region.filter("r_name IN ('ASIA', 'EUROPE')"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"))
    events = t.orders.filter("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.lit("event").alias("side"), F.col("c_nationkey").alias("k"))
    both = events.unionByName(t.supplier.select(F.lit("control").alias("side"), F.col("s_nationkey").alias("k")))
    return both.join(F.broadcast(test), "k", "left_anti").groupBy("side").agg(F.count(F.lit(1)).alias("outside"))


@query("q388_group_anchor", "SELECT o_custkey, min(o_orderdate + to_days((o_orderkey % 10)::INT) / 2)::DATE AS anchor FROM orders GROUP BY 1")
def anchors(t: Tables) -> DataFrame:
    """A group's anchor is its members' earliest interval midpoint."""
    middle = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 10) * 43200)
    return t.orders.groupBy("o_custkey").agg(F.to_date(F.min(middle)).alias("anchor"))


HOT = "hot AS (SELECT unit, day, (v > 200)::INT AS label FROM unit_daily)"
OFFSETS = [o for k in range(1, 13) for o in (-30 * k, 30 * k)]


def hot(t: Tables) -> DataFrame:
    return unit_daily(t).select("unit", "day", (F.col("v") > 200).cast("int").alias("label"))


def event_days(t: Tables) -> DataFrame:
    u = unit_daily(t)
    s = u.groupBy("unit").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return u.join(F.broadcast(s), "unit").filter("v > m + 2 * s").select("unit", "day")


@query("q293_shift_null", f"""WITH {UNIT_SQL}, {EVENT_SQL}, {HOT}, m AS (SELECT o, avg(label) AS m FROM (SELECT unit, (event_day + o::INT)::DATE AS day, o FROM e, (SELECT unnest([0, {", ".join(map(str, OFFSETS))}]) AS o)) JOIN hot USING (unit, day) GROUP BY 1)
    SELECT round(observed, 8) AS observed, count(*) AS n, count(*) FILTER (m >= observed) AS ge, round((count(*) FILTER (m >= observed) + 1) / (count(*) + 1), 8) AS p FROM m, (SELECT m AS observed FROM m WHERE o = 0) WHERE o <> 0 GROUP BY observed""")
def shift_null(t: Tables) -> DataFrame:
    r = K.shift_null(event_days(t), hot(t), "unit", "day", "label", OFFSETS)
    return r.select(F.round("observed", 8).alias("observed"), "n", "ge", F.round("p", 8).alias("p"))


@query("q387_shift_support", f"WITH {UNIT_SQL}, {EVENT_SQL}, {HOT} SELECT unit, event_day AS day, count(h.label) > 0 AS supported FROM (SELECT unit, event_day, (event_day + o::INT)::DATE AS day FROM e, (SELECT unnest([-400, 400]) AS o)) LEFT JOIN hot h USING (unit, day) GROUP BY 1, 2")
def shift_support(t: Tables) -> DataFrame:
    """Whether any shifted cell of an event has a label: others are censored."""
    moved = event_days(t).select("unit", "day", F.explode(F.array(F.lit(-400), F.lit(400))).alias("o")).withColumn("at", F.date_add("day", F.col("o")))
    labels = hot(t).select("unit", F.col("day").alias("at"), "label")
    return moved.join(labels, ["unit", "at"], "left").groupBy("unit", "day").agg((F.count("label") > 0).alias("supported"))


@query("q292_time_reversed", f"WITH {UNIT_SQL}, {EVENT_SQL}, {HOT} SELECT side, count(*) AS n, round(avg(label), 8) AS rate FROM (SELECT unit, side, (event_day + o::INT)::DATE AS day FROM e, (VALUES ('before', -15), ('after', 15)) v(side, o)) JOIN hot USING (unit, day) GROUP BY 1")
def time_reversed(t: Tables) -> DataFrame:
    """Labels at the midpoint of the 30 days before events against those after: what a time-reversed control sees."""
    sides = F.array(F.struct(F.lit("before").alias("side"), F.lit(-15).alias("o")), F.struct(F.lit("after").alias("side"), F.lit(15).alias("o")))
    at = event_days(t).withColumn("x", F.explode(sides)).select("unit", "x.side", F.date_add("day", F.col("x.o")).alias("day"))
    return at.join(hot(t), ["unit", "day"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 8).alias("rate"))


@query("q300_leave_one_group_out", """WITH r AS (SELECT c_nationkey AS g, o_totalprice > 200000 AS ev, c_acctbal AS x FROM orders JOIN customer ON o_custkey = c_custkey), o AS (SELECT g, count(x) AS n, sum(x) AS s, sum(x * x) AS q FROM r GROUP BY 1), a AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM o),
    k AS (SELECT g, (a.s - o.s) / (a.n - o.n) AS m, sqrt(greatest((a.q - o.q) / (a.n - o.n) - ((a.s - o.s) / (a.n - o.n)) ** 2, 0.0)) AS sd FROM o, a), z AS (SELECT r.*, (x - m) / sd AS z FROM r JOIN k USING (g) WHERE sd > 0), c AS (SELECT g, avg(z) AS c, count(*) AS nc FROM z WHERE NOT ev GROUP BY 1)
    SELECT g AS grp, nc AS n_controls, count(*) AS n_events, round(avg((z > c)::INT), 8) AS win_rate, CASE WHEN count(*) < 2 OR nc < 2 THEN 'INDETERMINATE' WHEN avg((z > c)::INT) > 0.5 THEN 'PASS' ELSE 'NULL' END AS verdict FROM z JOIN c USING (g) WHERE ev GROUP BY 1, 2""")
def logo(t: Tables) -> DataFrame:
    r = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("grp"), (F.col("o_totalprice") > 200000).alias("ev"), F.col("c_acctbal").alias("x"))
    return K.leave_one_group_out(r, "grp", "ev", "x").select("grp", "n_controls", "n_events", F.round("win_rate", 8).alias("win_rate"), "verdict")


@query("q260_occupancy_shift", """WITH c AS (SELECT c_nationkey AS g, c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1, 2), a AS (SELECT k, sum(n) / (SELECT sum(n) FROM c) AS q FROM c GROUP BY 1), s AS (SELECT g, sum(n) AS t FROM c GROUP BY 1),
    f AS (SELECT s.g, coalesce(c.n, 0) / s.t AS p, a.q FROM s CROSS JOIN a LEFT JOIN c ON c.g = s.g AND c.k = a.k) SELECT g AS grp, round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + q * ln(q / ((p + q) / 2))) / 2, 8) AS js FROM f GROUP BY 1""")
def occupancy(t: Tables) -> DataFrame:
    return K.occupancy_shift(t.customer.select(F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("k")), "grp", "k").select("grp", F.round("js", 8).alias("js"))


@query("q207_control_transitions", f"WITH {UNIT_SQL}, {HOT} SELECT a.label AS from_state, b.label AS to_state, count(*) AS n FROM hot a JOIN hot b ON a.unit = b.unit AND b.day = a.day + 1 GROUP BY 1, 2")
def transitions(t: Tables) -> DataFrame:
    return K.transition_counts(hot(t), "unit", "day", "label")


@query("q472_transition_table", f"WITH {UNIT_SQL}, {HOT}, r AS (SELECT unit, string_agg(DISTINCT month(day)::VARCHAR, '|' ORDER BY month(day)::VARCHAR) AS stratum, count(*) AS n, sum(label)::BIGINT AS hits FROM hot WHERE year(day) >= 1997 GROUP BY unit) SELECT stratum, count(*) AS units, sum(n)::BIGINT AS days, sum(hits)::BIGINT AS hits FROM r GROUP BY 1")
def transition_table(t: Tables) -> DataFrame:
    u = hot(t).filter(F.year("day") >= 1997).groupBy("unit").agg(F.array_join(F.array_sort(F.collect_set(F.month("day").cast("string"))), "|").alias("stratum"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
    return u.groupBy("stratum").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("days"), F.sum("hits").alias("hits"))


@query("q471_label_histogram", f"WITH {UNIT_SQL}, {EVENT_SQL}, {HOT}, d AS (SELECT unit, event_day, (event_day - o::INT)::DATE AS day FROM e, (SELECT unnest([0, 1, 2, 3]) AS o)) SELECT d.unit, d.event_day, coalesce(h.label::VARCHAR, 'unassigned') AS label, count(*) AS n FROM d LEFT JOIN hot h ON d.unit = h.unit AND d.day = h.day GROUP BY 1, 2, 3")
def histogram(t: Tables) -> DataFrame:
    d = event_days(t).select("unit", F.col("day").alias("event_day"), F.explode(F.sequence(F.date_sub("day", 3), F.col("day"))).alias("day"))
    return d.join(hot(t), ["unit", "day"], "left").groupBy("unit", "event_day", F.coalesce(F.col("label").cast("string"), F.lit("unassigned")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("q465_assignment_rows", f"WITH {UNIT_SQL} SELECT unit, day::VARCHAR AS day, 'r' || (v > 200)::INT::VARCHAR AS regime FROM unit_daily WHERE unit <> 'N'")
def assignment_rows(t: Tables) -> DataFrame:
    """Well-formed triples only."""
    raw = hot(t).select(F.when(F.col("unit") != "N", F.col("unit")).alias("unit"), F.col("day").cast("string").alias("day"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("regime"))
    return raw.filter("unit IS NOT NULL AND day IS NOT NULL AND regime IS NOT NULL")


@query("q390_assignment_digest", f"WITH {UNIT_SQL} SELECT count(*) AS n, sum(('0x' || substr(sha256(unit || '|' || day::VARCHAR || '|r' || (v > 200)::INT::VARCHAR), 1, 12))::BIGINT)::BIGINT AS digest FROM unit_daily WHERE unit <> 'N'")
def assignment_digest(t: Tables) -> DataFrame:
    """A digest of all assignments that their order does not change."""
    from panelforge.operators.tables import column_digests

    return column_digests(assignment_rows(t).select(F.concat_ws("|", "unit", "day", "regime").alias("k")), ["k"]).select("n", "digest")


@query("q410_target_states", """WITH w AS (SELECT o_orderkey, o_custkey, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS z, o_orderstatus FROM orders), l AS (SELECT l_orderkey, l_shipdate, l_returnflag, l_linestatus FROM lineitem),
    j AS (SELECT w.o_orderkey, any_value(o_orderstatus) AS st, bool_or(l_linestatus <> 'O') AS foreign_, bool_or(l_shipdate >= a AND l_shipdate < z AND l_returnflag = 'R') AS sure, bool_or(l_shipdate >= a AND l_shipdate < z) AS possible FROM w LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT o_orderkey, CASE WHEN coalesce(foreign_, FALSE) THEN 'CENSORED' WHEN coalesce(sure, FALSE) THEN 'POSITIVE' WHEN coalesce(possible, FALSE) OR st = 'P' THEN 'CENSORED' ELSE 'NEGATIVE' END AS state FROM j""")
def target_states(t: Tables) -> DataFrame:
    """Window states from typed labels: a label of another source censors its window first."""
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    inside = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    g = j.groupBy("o_orderkey").agg(F.max("o_orderstatus").alias("st"), F.bool_or(F.col("l_linestatus") != "O").alias("other"), F.bool_or(inside & (F.col("l_returnflag") == "R")).alias("sure"), F.bool_or(inside).alias("possible"))
    return g.select("o_orderkey", C.target_state(F.lit(True), F.col("other"), F.col("sure"), F.col("possible"), F.col("st") != "P").alias("state"))


@query("q411_control_states", """WITH w AS (SELECT c.o_orderkey, o.o_orderdate = c.o_orderdate AS same, c.o_orderstatus AS st FROM orders c JOIN (SELECT o_orderkey, o_orderdate + to_days(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS o_orderdate FROM orders) o USING (o_orderkey)),
    l AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS hit FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN NOT same THEN 'CENSORED' WHEN coalesce(hit, FALSE) THEN 'POSITIVE' WHEN st = 'P' THEN 'CENSORED' ELSE 'NEGATIVE' END AS state FROM w LEFT JOIN l ON o_orderkey = l_orderkey""")
def control_states(t: Tables) -> DataFrame:
    """A control's state counts only where its window equals its opportunity's."""
    theirs = t.orders.select("o_orderkey", F.date_add(F.to_date("o_orderdate"), (F.col("o_totalprice") > 400000).cast("int")).alias("other"))
    hits = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("hit"))
    w = t.orders.join(theirs, "o_orderkey").join(hits, "o_orderkey", "left")
    return w.select("o_orderkey", C.target_state(F.to_date("o_orderdate") == F.col("other"), F.lit(False), F.col("hit"), F.lit(False), F.col("o_orderstatus") != "P").alias("state"))


#: Feature names that become columns at most.
MOST_FEATURES = 1000


@query("q483_feature_matrix", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE 0.0 END AS balance, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey::DOUBLE ELSE 0.0 END AS nation FROM supplier")
def matrix(t: Tables) -> DataFrame:
    """Sparse feature maps as columns of all names; what is missing or not finite is 0."""
    k = F.col("s_suppkey")
    features = F.map_concat(F.when(k % 2 == 0, F.create_map(F.lit("balance"), F.col("s_acctbal"))).otherwise(F.create_map(F.lit("balance"), F.lit(float("nan")))), F.when(k % 3 > 0, F.create_map(F.lit("nation"), F.col("s_nationkey").cast("double"))).otherwise(F.create_map(F.lit("nation"), F.lit(float("inf")))))
    rows = t.supplier.select("s_suppkey", features.alias("f"))
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("f"))).distinct().limit(MOST_FEATURES + 1).collect())  # feature names, not rows
    if len(names) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features do not make columns")
    return rows.select("s_suppkey", *[F.coalesce(C.finite(F.try_element_at("f", F.lit(n))), F.lit(0.0)).alias(n) for n in names])


@query("q253_means_across_scalers", "WITH g AS (SELECT p_brand, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, avg(p_size) AS z FROM part GROUP BY 1), a AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part) SELECT p_brand, round((0.5 * g.s + g.m - a.m) / a.s, 8) AS mean FROM g, a")
def across(t: Tables) -> DataFrame:
    """A cluster mean given in one group's scale (here 0.5), in the scale of all."""
    stats = (F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    a = t.part.agg(*stats).select(F.col("m").alias("am"), F.col("s").alias("as_"))
    return t.part.groupBy("p_brand").agg(*stats).join(F.broadcast(a)).select("p_brand", F.round((0.5 * F.col("s") + F.col("m") - F.col("am")) / F.col("as_"), 8).alias("mean"))


@query("q279_cells", "SELECT c_custkey, floor(c_acctbal / 100)::BIGINT AS x, floor(c_nationkey / 4)::BIGINT AS y FROM customer")
def cells(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.floor(F.col("c_acctbal") / 100).alias("x"), F.floor(F.col("c_nationkey") / 4).alias("y"))


@query("q327_gate", """SELECT bool_and(ok) AS passed, array_to_string(list_sort(list(name) FILTER (NOT ok)), ',') AS failed FROM (SELECT 'inputs' AS name, count(*) > 0 AS ok FROM orders UNION ALL SELECT 'locked', count(*) = 5 FROM region UNION ALL SELECT 'stable', count(DISTINCT c_mktsegment) = 3 FROM customer)""")
def gate(t: Tables) -> DataFrame:
    """Named checks as rows; the gate is open if all hold."""
    check = lambda name, df, ok: df.agg(ok.alias("ok")).withColumn("name", F.lit(name))
    rows = check("inputs", t.orders, F.count(F.lit(1)) > 0).unionByName(check("locked", t.region, F.count(F.lit(1)) == 5)).unionByName(check("stable", t.customer, F.count_distinct("c_mktsegment") == 3))
    return rows.agg(F.bool_and("ok").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))), ",").alias("failed"))


@query("q334_reports", "SELECT CASE WHEN o_orderstatus <> 'F' THEN 'other generation' WHEN o_totalprice < 20000 THEN 'digest differs' ELSE 'accepted' END AS verdict, count(*) AS n FROM orders GROUP BY 1")
def reports(t: Tables) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") != "F", "other generation").when(F.col("o_totalprice") < 20000, "digest differs").otherwise("accepted")
    return t.orders.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("q335_lineage", "SELECT CASE WHEN l.p IS NULL THEN 'never used' WHEN p.p_partkey IS NULL THEN 'not declared' WHEN p.p_size > 40 THEN 'digest differs' ELSE 'verified' END AS status, count(*) AS n FROM (SELECT DISTINCT l_partkey AS p FROM lineitem) l FULL JOIN (SELECT * FROM part WHERE p_size > 3) p ON l.p = p.p_partkey GROUP BY 1")
def lineage_verify(t: Tables) -> DataFrame:
    """A manifest against what was used: every file declared, every declaration met, digests equal."""
    declared = t.part.filter("p_size > 3").select(F.col("p_partkey").alias("p"), F.sha2(F.col("p_size").cast("string").cast("binary"), 256).alias("d"), F.sha2(F.least("p_size", F.lit(40)).cast("string").cast("binary"), 256).alias("found"))
    used = t.lineitem.select(F.col("l_partkey").alias("p")).distinct().withColumn("used", F.lit(1))
    status = F.when(F.col("used").isNull(), "never used").when(F.col("d").isNull(), "not declared").when(F.col("d") != F.col("found"), "digest differs").otherwise("verified")
    return used.join(declared, "p", "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("q338_matrix_checks", "SELECT count(*) FILTER (l_quantity IS NULL) AS nulls, count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.05) AS out_of_range, count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS repeated FROM lineitem")
def matrix_checks(t: Tables) -> DataFrame:
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.agg(F.count(F.when(F.col("l_quantity").isNull(), 1)).alias("nulls"), F.count(F.when(~F.col("l_discount").between(0, 0.05), 1)).alias("out_of_range"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated"))
