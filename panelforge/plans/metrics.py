"""Queries on scores and labels: forecast verification, rank statistics, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import stats as S
from panelforge.operators import order as O
from panelforge.plans.registry import Tables, query

#: Labelled rows with a probability made from the id, so that both engines see the same numbers.
CASES_SQL = "cases AS (SELECT doc_id, lang, source, toxic, quality AS y, ((doc_id * 7919) % 1000) / 999.0 AS p FROM labels JOIN documents USING (doc_id))"


def cases(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", "toxic", F.col("quality").alias("y"), (((F.col("doc_id") * 7919) % 1000) / 999.0).alias("p"))


@query("q152_calibration_bins", f"""WITH {CASES_SQL}, g AS (SELECT CAST(least(9, floor(p * 10)) AS INT) AS bin, count(*) AS n, round(avg(p), 8) AS mean_prob, round(avg(y), 8) AS mean_truth FROM cases GROUP BY 1)
    SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n, mean_prob, mean_truth FROM range(10) r(b) LEFT JOIN g ON g.bin = b""")
def calibration(t: Tables) -> DataFrame:
    c = S.calibration_bins(cases(t).withColumn("k", F.lit(1)), ["k"], "y", "p", 10)
    return c.select("bin", "n", F.round("mean_prob", 8).alias("mean_prob"), F.round("mean_truth", 8).alias("mean_truth"))


@query("q153_brier", f"WITH {CASES_SQL} SELECT round(avg((p - y) * (p - y)), 8) AS brier, count(*) AS n FROM cases")
def brier(t: Tables) -> DataFrame:
    return cases(t).agg(F.round(F.avg((F.col("p") - F.col("y")) ** 2), 8).alias("brier"), F.count(F.lit(1)).alias("n"))


@query("q154_event_recall", f"WITH {CASES_SQL} SELECT coalesce(round(count(*) FILTER (y = 1 AND p >= 0.5) / nullif(count(*) FILTER (y = 1), 0), 8), 0.0) AS recall, coalesce(round(count(*) FILTER (y = 0 AND p >= 0.5) / nullif(count(*), 0), 8), 0.0) AS false_alarms FROM cases")
def recall(t: Tables) -> DataFrame:
    flag = F.col("p") >= 0.5
    hit, false = F.count(F.when(flag & (F.col("y") == 1), 1)), F.count(F.when(flag & (F.col("y") == 0), 1))
    ratio = lambda a, b, name: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 8), F.lit(0.0)).alias(name)
    return cases(t).agg(ratio(hit, F.count(F.when(F.col("y") == 1, 1)), "recall"), ratio(false, F.count(F.lit(1)), "false_alarms"))


@query("q156_metric_slices", f"""WITH {CASES_SQL} SELECT lang, source, count(*) AS n, round(avg((p - y) * (p - y)), 8) AS brier, round(avg(y), 8) AS rate FROM cases GROUP BY GROUPING SETS ((lang), (source), ())""")
def slices(t: Tables) -> DataFrame:
    c = cases(t)
    return c.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") - F.col("y")) ** 2), 8).alias("brier"), F.round(F.avg("y"), 8).alias("rate"))


@query("q144_threshold_rates", f"WITH {CASES_SQL} SELECT threshold, round(avg((p >= threshold)::INT) FILTER (y = 1), 8) AS detection, round(avg((p >= threshold)::INT) FILTER (y = 0), 8) AS false_positive FROM cases CROSS JOIN (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(threshold) GROUP BY 1")
def threshold_rates(t: Tables) -> DataFrame:
    c = cases(t).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)])))
    hit = (F.col("p") >= F.col("threshold")).cast("int")
    return c.groupBy("threshold").agg(F.round(F.avg(F.when(F.col("y") == 1, hit)), 8).alias("detection"), F.round(F.avg(F.when(F.col("y") == 0, hit)), 8).alias("false_positive"))


@query("q149_group_rates", f"WITH {CASES_SQL}, r AS (SELECT lang, source, avg(y) AS rate FROM cases WHERE doc_id % 2 = 0 GROUP BY 1, 2) SELECT c.doc_id, round(coalesce(r.rate, (SELECT avg(rate) FROM r)), 8) AS prob FROM cases c LEFT JOIN r USING (lang, source) WHERE c.doc_id % 2 = 1")
def group_rates(t: Tables) -> DataFrame:
    c = cases(t)
    r = c.filter("doc_id % 2 = 0").groupBy("lang", "source").agg(F.avg("y").alias("rate"))
    m = r.agg(F.avg("rate").alias("overall"))
    return c.filter("doc_id % 2 = 1").join(r, ["lang", "source"], "left").join(F.broadcast(m)).select("doc_id", F.round(F.coalesce("rate", "overall"), 8).alias("prob"))


@query("q276_auc", f"""WITH {CASES_SQL}, s AS (SELECT doc_id % 20 AS score, y, lang FROM cases) SELECT a.lang, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 8) AS auc FROM s a JOIN s b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY 1""")
def auc(t: Tables) -> DataFrame:
    return S.auc(cases(t).withColumn("score", F.col("doc_id") % 20), ["lang"], "y", "score").filter("auc IS NOT NULL").select("lang", F.round("auc", 8).alias("auc"))


@query("q277_stratified_auc", f"""WITH {CASES_SQL}, s AS (SELECT doc_id % 20 AS score, y, lang FROM cases), g AS (SELECT a.lang, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc, count(DISTINCT a.doc) AS np, count(DISTINCT b.doc) AS nn
    FROM (SELECT *, row_number() OVER () AS doc FROM s) a JOIN (SELECT *, row_number() OVER () AS doc FROM s) b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY 1) SELECT round(sum(auc * least(np, nn)) / sum(least(np, nn)), 8) AS auc, count(*) AS strata FROM g WHERE least(np, nn) >= 2""")
def stratified_auc(t: Tables) -> DataFrame:
    g = S.auc(cases(t).withColumn("score", F.col("doc_id") % 20), ["lang"], "y", "score").withColumn("w", F.least("n_pos", "n_neg")).filter("w >= 2")
    return g.agg(F.round(F.sum(F.col("auc") * F.col("w")) / F.sum("w"), 8).alias("auc"), F.count(F.lit(1)).alias("strata"))


@query("q217_pr_curve", f"""WITH {CASES_SQL}, c AS (SELECT doc_id % 50 AS threshold, sum(y) AS p, count(*) AS n FROM cases GROUP BY 1), r AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS allp FROM c WINDOW w AS (ORDER BY threshold DESC))
    SELECT threshold, round(tp / k, 8) AS precision, round(tp / allp, 8) AS recall FROM r""")
def pr_curve(t: Tables) -> DataFrame:
    r = S.precision_recall(cases(t).withColumn("score", F.col("doc_id") % 50).withColumn("k", F.lit(1)), ["k"], "y", "score")
    return r.select("threshold", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query("q169_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def pearson(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"), F.count(F.lit(1)).alias("n"))


@query("q170_collinearity", """WITH c AS (SELECT unnest([{'a': 'quantity', 'b': 'price', 'r': corr(l_quantity, l_extendedprice)}, {'a': 'quantity', 'b': 'discount', 'r': corr(l_quantity, l_discount)}, {'a': 'price', 'b': 'discount', 'r': corr(l_extendedprice, l_discount)}]) AS x FROM lineitem) SELECT x.a AS a, x.b AS b, round(x.r, 8) AS r FROM c WHERE abs(x.r) > 0.0""")
def collinearity(t: Tables) -> DataFrame:
    cols = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    pairs = [(a, b) for i, a in enumerate(cols) for b in list(cols)[i + 1 :]]
    one = t.lineitem.agg(*[F.corr(cols[a], cols[b]).alias(f"{a}_{b}") for a, b in pairs])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs])).alias("x"))
    return rows.select("x.*").filter(F.abs("r") > 0.0).withColumn("r", F.round("r", 8))


RANKED_SQL = "x AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rx, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS ry FROM part)"


@query("q281_spearman", f"WITH {RANKED_SQL} SELECT p_brand, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM x GROUP BY 1")
def spearman(t: Tables) -> DataFrame:
    return S.spearman(t.part, ["p_brand"], "p_size", "p_retailprice").withColumn("rho", F.round("rho", 8))


@query("q282_spearman_untied", f"WITH {RANKED_SQL} SELECT p_brand, round(abs(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*) * (count(*) * count(*) - 1))), 8) AS rho FROM x GROUP BY 1 HAVING count(*) > 1")
def spearman_untied(t: Tables) -> DataFrame:
    r = S.average_rank(S.average_rank(t.part, ["p_brand"], "p_size", "rx"), ["p_brand"], "p_retailprice", "ry")
    n = F.count(F.lit(1))
    return r.groupBy("p_brand").agg(F.round(F.abs(1 - 6 * F.sum((F.col("rx") - F.col("ry")) ** 2) / (n * (n * n - 1))), 8).alias("rho"), n.alias("n")).filter("n > 1").drop("n")


P_SQL = "pv AS (SELECT p_brand, p_partkey, ((p_partkey * 31) % 1009 + 1) / 5000.0 AS p FROM part)"


def p_values(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_partkey", (((F.col("p_partkey") * 31) % 1009 + 1) / 5000.0).alias("p"))


@query("q215_false_discovery", f"""WITH {P_SQL}, r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / rank() OVER (PARTITION BY p_brand ORDER BY p) AS raw FROM pv)
    SELECT p_brand, p_partkey, round(least(1.0, min(raw) OVER (PARTITION BY p_brand ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 8) AS q FROM r""")
def fdr(t: Tables) -> DataFrame:
    return S.false_discovery(p_values(t), ["p_brand"], "p").select("p_brand", "p_partkey", F.round("q", 8).alias("q"))


@query("q216_step_down", f"""WITH {P_SQL}, r AS (SELECT *, p <= 0.05 / (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) + 1) AS ok FROM pv)
    SELECT p_brand, p_partkey, bool_and(ok) OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS significant FROM r""")
def holm(t: Tables) -> DataFrame:
    return S.step_down(p_values(t), ["p_brand"], "p", 0.05).select("p_brand", "p_partkey", "significant")


@query("q299_wilson", f"""WITH {CASES_SQL}, g AS (SELECT source, sum(y) AS k, count(*) AS n, 1.959963984540054 AS z FROM cases GROUP BY 1) SELECT source, n, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) AS low, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) AS high FROM g""")
def wilson(t: Tables) -> DataFrame:
    g = cases(t).groupBy("source").agg(F.sum("y").cast("double").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


JS_SQL = "c AS (SELECT event_type AS label, count(*) FILTER (hour(ts) < 12) AS a, count(*) FILTER (hour(ts) >= 12) AS b FROM events GROUP BY 1), s AS (SELECT a / (SELECT sum(a) FROM c) AS p, b / (SELECT sum(b) FROM c) AS q FROM c), m AS (SELECT p, q, (p + q) / 2 AS m FROM s)"


@query("q247_js_distance", f"WITH {JS_SQL} SELECT round(sqrt(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2), 8) AS js FROM m")
def js_distance(t: Tables) -> DataFrame:
    return S.divergence(S.shares(t.events.withColumn("early", F.hour("ts") < 12), "event_type", "early"), base2=False).select(F.round("js", 8).alias("js"))


@query("q248_js_divergence", f"WITH {JS_SQL} SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 10) AS js FROM m")
def js_divergence(t: Tables) -> DataFrame:
    return S.divergence(S.shares(t.events.withColumn("early", F.hour("ts") < 12), "event_type", "early"), base2=True).select(F.round("js", 10).alias("js"))


@query("q250_adjusted_rand", """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS ra FROM (SELECT sum(n) AS n FROM c GROUP BY p_brand)), b AS (SELECT sum(n * (n - 1) / 2) AS rb FROM (SELECT sum(n) AS n FROM c GROUP BY p_type))
    SELECT round((s - ra * rb / (t * (t - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2)), 8) AS ari FROM s, a, b""")
def ari(t: Tables) -> DataFrame:
    return S.adjusted_rand(t.part, "p_brand", "p_type").select(F.round("ari", 8).alias("ari"))


@query("q167_rate_by_quartile", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT CAST((o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= c)::INT AS INT) AS quartile, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 8) AS rate FROM orders, q GROUP BY 1")
def by_quartile(t: Tables) -> DataFrame:
    q = O.quantiles(t.orders, [], "o_totalprice", [0.25, 0.5, 0.75])
    bucket = sum(((F.col("o_totalprice") >= F.col("q")[i]).cast("int") for i in (1, 2)), (F.col("o_totalprice") >= F.col("q")[0]).cast("int"))
    return t.orders.join(F.broadcast(q)).groupBy(bucket.alias("quartile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 8).alias("rate"))


@query("q168_five_numbers", "SELECT o_orderpriority, round(min(o_totalprice), 2) AS low, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(max(o_totalprice), 2) AS high FROM orders GROUP BY 1")
def five_numbers(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_orderpriority").agg(F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.max("o_totalprice"), 2).alias("high"))
    g = g.join(O.quantiles(t.orders, ["o_orderpriority"], "o_totalprice", [0.25, 0.5, 0.75]), "o_orderpriority")
    return g.select("o_orderpriority", "low", F.round(F.col("q")[0], 6).alias("q25"), F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2], 6).alias("q75"), "high")


@query("q273_robust_scale", "WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS m, quantile_cont(p_retailprice, 0.75) AS c FROM part GROUP BY 1) SELECT p_partkey, round((p_retailprice - m) / nullif(c - a, 0), 6) AS scaled FROM part JOIN q USING (p_brand)")
def robust(t: Tables) -> DataFrame:
    q = O.quantiles(t.part, ["p_brand"], "p_retailprice", [0.25, 0.5, 0.75])
    return t.part.join(q, "p_brand").select("p_partkey", F.round((F.col("p_retailprice") - F.col("q")[1]) / F.nullif(F.col("q")[2] - F.col("q")[0], F.lit(0.0)), 6).alias("scaled"))


@query("q245_train_only_scaling", "WITH f AS (SELECT quantile_cont(p_size, 0.5) AS med, avg(coalesce(p_size, 0)) AS m, stddev_pop(p_size) AS s FROM part WHERE p_partkey % 3 <> 0) SELECT p_partkey, round((coalesce(p_size, med) - m) / s, 8) AS scaled FROM part, f WHERE p_partkey % 3 = 0")
def train_only(t: Tables) -> DataFrame:
    learn = t.part.filter("p_partkey % 3 <> 0")
    middle = O.quantiles(learn, [], "p_size", [0.5]).select(F.col("q")[0].alias("med"))
    f = learn.agg(F.avg(F.coalesce("p_size", F.lit(0))).alias("m"), F.stddev_pop("p_size").alias("s"))
    return t.part.filter("p_partkey % 3 = 0").join(F.broadcast(f)).join(F.broadcast(middle)).select("p_partkey", F.round((F.coalesce("p_size", "med") - F.col("m")) / F.col("s"), 8).alias("scaled"))


@query("q102_hash_dropout", "SELECT doc_id, (('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT / 281474976710656.0) < 0.3 AS dropped FROM documents")
def dropout(t: Tables) -> DataFrame:
    part = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 12), 16, 10).cast("double")
    return t.documents.select("doc_id", (part / 281474976710656.0 < 0.3).alias("dropped"))


@query("q244_mixture_parameters", "SELECT k, d, family, CAST(CASE family WHEN 'full' THEN k * d + k * d * (d + 1) // 2 + k - 1 WHEN 'tied' THEN k * d + d * (d + 1) // 2 + k - 1 WHEN 'diag' THEN 2 * k * d + k - 1 ELSE k * d + k + k - 1 END AS BIGINT) AS params FROM (SELECT DISTINCT CAST(p_size % 5 + 1 AS INT) AS k FROM part) CROSS JOIN (VALUES (3), (6)) d(d) CROSS JOIN (VALUES ('full'), ('tied'), ('diag'), ('spherical')) f(family)")
def mixture_parameters(t: Tables) -> DataFrame:
    from panelforge.operators.models import free_parameters

    grid = t.part.select((F.col("p_size") % 5 + 1).cast("int").alias("k")).distinct().withColumn("d", F.explode(F.array(F.lit(3), F.lit(6)))).withColumn("family", F.explode(F.array(*map(F.lit, ("full", "tied", "diag", "spherical")))))
    return grid.select("k", "d", "family", free_parameters(F.col("k"), F.col("d"), F.col("family")).alias("params"))


@query("q274_stratified_subsample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r <= ceil(0.05 * n)")
def subsample(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"), F.lit(1).alias("one"))
    n = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    r = O.running(rows, ["o_orderpriority"], ["h", "o_orderkey"], "one", "r").join(F.broadcast(n), "o_orderpriority")
    return r.filter("r <= ceil(0.05D * n)").select("o_orderkey")
