"""Queries of stimulation, pooling and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracespark.functions.semantics import exact, exact_sql, median, rounded
from tracespark.operators import pooling, stats, stim
from tracespark.plans import bindings as b
from tracespark.plans.bindings import query
from tracespark.plans.signals import NULLS, RESPONSE, UNIT, bounds_of, responses
from tracespark.plans.timejoins import ALIGNED, MENDED, aligned, mended

CYCLES = MENDED + """, cy AS (SELECT rec, trial AS block, start, "end" FROM mended),
own AS (SELECT *, lead(start) OVER (PARTITION BY rec, block ORDER BY start) - "end" AS g FROM cy),
bm AS (SELECT rec, block, quantile_cont(g, 0.5) AS m FROM own GROUP BY 1, 2), am AS (SELECT rec, quantile_cont(g, 0.5) AS m FROM own GROUP BY 1)"""


@query("t35_cycle_gaps", f"""WITH {CYCLES} SELECT own.rec, own.block, start, coalesce(g, bm.m, am.m) AS gap
FROM own JOIN bm ON own.rec = bm.rec AND own.block = bm.block JOIN am ON own.rec = am.rec -- FROM ev JOIN trial""")
def t35(spark, d):
    return stim.cycle_gaps(mended(spark, d).select("rec", F.col("trial").alias("block"), "start", "end"), ["rec"]).select(
        "rec", "block", "start", "gap")


DFF = ALIGNED + """, f0 AS (SELECT roi, event_frame, avg(value) AS f0 FROM aligned WHERE rel < 0 AND (event_frame * 7 + rel) % 53 <> 0 GROUP BY 1, 2),
dff AS (SELECT a.roi, a.event_frame, rel, CASE WHEN (a.event_frame * 7 + rel) % 53 = 0 THEN NULL ELSE (value - f0) / f0 END AS dff FROM aligned a JOIN f0 ON a.roi = f0.roi AND a.event_frame = f0.event_frame WHERE f0 <> 0),
bk AS (SELECT roi, event_frame, rel, CASE WHEN bool_or(dff IS NULL) OVER (PARTITION BY roi, rel) THEN NULL ELSE dff END AS dff FROM dff)"""


def train_dff(spark, d):
    dark = aligned(spark, d).withColumn("value", F.when((F.col("event_frame") * 7 + F.col("rel")) % 53 != 0, F.col("value")))
    return stim.blanked_positions(stim.cycle_dff(dark, ["roi", "event_frame"]), UNIT)


@query("t36_train_dff", f"WITH {DFF} SELECT roi, event_frame, rel::BIGINT AS rel, round(dff, 6) AS dff FROM bk -- FROM fr")
def t36(spark, d):
    return train_dff(spark, d).select("roi", "event_frame", F.col("rel").cast("long").alias("rel"), rounded(F.col("dff")).alias("dff"))


#: Frames with a value that is missing now and then, and cycles of pulses: three to a block.
STIMULATED = MENDED + """, fv AS (SELECT rec, t, CASE WHEN row_number() OVER w % 19 <> 7 THEN value END AS value, value < 25 AS dark, row_number() OVER w - 1 AS frame
  FROM ev WHERE kind = 'view' WINDOW w AS (PARTITION BY rec ORDER BY t)),
cy AS (SELECT rec, trial // 3 AS block, trial AS cycle, trial % 2 AS condition, min(start) AS start, max("end") AS "end" FROM mended GROUP BY rec, trial),
st AS (SELECT rec, frame, t - lag(t) OVER (PARTITION BY rec ORDER BY frame) AS step FROM fv),
rt AS (SELECT rec, 1000.0::DOUBLE / (quantile_cont(step, 0.5) FILTER (step > 0)) AS rate, max(frame) + 1 AS n FROM st GROUP BY rec),
g0 AS (SELECT *, lead(start) OVER (PARTITION BY rec, block ORDER BY start) - "end" AS gap FROM cy),
g1 AS (SELECT * REPLACE (CASE WHEN gap > 0 THEN gap END AS gap) FROM g0),
gm AS (SELECT rec, block, quantile_cont(gap, 0.5) AS m FROM g1 GROUP BY 1, 2), ga AS (SELECT rec, quantile_cont(gap, 0.5) AS m FROM g1 GROUP BY 1),
sz AS (SELECT g1.rec, cycle, condition, start, "end", n, round_even(300000.0::DOUBLE * rate, 0)::BIGINT AS pre, ceil(("end" - start + coalesce(gap, gm.m, ga.m)) / 1000 * rate)::BIGINT AS post
  FROM g1 JOIN gm ON g1.rec = gm.rec AND g1.block = gm.block JOIN ga ON ga.rec = g1.rec JOIN rt ON rt.rec = g1.rec),
s1 AS (SELECT sz.*, f.frame AS first FROM sz ASOF LEFT JOIN fv f ON sz.rec = f.rec AND sz.start >= f.t),
s2 AS (SELECT s1.*, f.frame AS last FROM s1 ASOF LEFT JOIN fv f ON s1.rec = f.rec AND s1."end" >= f.t)"""
ANCHORED = """tr AS (SELECT o.rec, cycle, condition, onset, rel FROM o, unnest(range(-pre, post + 1)) AS u(rel) WHERE onset >= pre AND onset + post < n),
rw AS (SELECT tr.*, value FROM tr LEFT JOIN fv ON fv.rec = tr.rec AND fv.frame = onset + rel),
f0 AS (SELECT rec, cycle, avg(value) AS f0 FROM rw WHERE rel < 0 GROUP BY 1, 2 HAVING avg(value) <> 0),
df AS (SELECT rw.rec, rw.cycle, condition, rel, f0, (value - f0) / f0 AS dff FROM rw JOIN f0 ON f0.rec = rw.rec AND f0.cycle = rw.cycle),
k AS (SELECT rec, condition, count(DISTINCT cycle) AS cycles FROM df GROUP BY 1, 2)
SELECT df.rec, cycle, df.condition, rel, round(CASE WHEN count(dff) OVER (PARTITION BY df.rec, df.condition, rel) = cycles THEN dff END, 6) AS dff, round(f0, 6) AS f0
FROM df JOIN k ON k.rec = df.rec AND k.condition = df.condition -- FROM ev JOIN trial"""


def anchored(spark, d, anchor):
    number = F.row_number().over(Window.partitionBy("rec").orderBy("t"))
    frames = b.events(spark, d, "view").select(
        "rec", "t", F.when(number % 19 != 7, F.col("value")).alias("value"), (F.col("value") < 25).alias("dark"), (number - 1).cast("long").alias("frame"))
    cycles = mended(spark, d).groupBy("rec", F.col("trial").alias("cycle")).agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumns({
        "block": F.floor(F.col("cycle") / 3), "condition": F.col("cycle") % 2, "first_pulse": F.col("start")})
    return stim.anchored_dff(frames, cycles, ["rec"], anchor, 300_000.0).select(
        "rec", "cycle", "condition", "rel", rounded(F.col("dff")).alias("dff"), rounded(F.col("f0")).alias("f0"))


@query("t36_pulse_dff", f"WITH {STIMULATED}, o AS (SELECT *, first AS onset FROM s2 WHERE first IS NOT NULL), {ANCHORED}")
def t36_pulse(spark, d):
    """Aligned to the frame of a cycle's first pulse."""
    return anchored(spark, d, "pulse")


@query("t36_cutoff_dff", f"""WITH {STIMULATED}, dk AS (SELECT rec, frame FROM (SELECT rec, frame, dark, coalesce(lag(dark) OVER (PARTITION BY rec ORDER BY frame), false) AS was FROM fv) WHERE dark AND NOT was),
o AS (SELECT s2.*, (SELECT min(frame) FROM dk WHERE dk.rec = s2.rec AND dk.frame BETWEEN coalesce(first, 0) AND last) AS onset FROM s2 WHERE onset IS NOT NULL), {ANCHORED}""")
def t36_cutoff(spark, d):
    """Aligned to a cycle's first dark frame."""
    return anchored(spark, d, "cutoff")


@query("t36_rising_edges", """WITH g AS (SELECT roi, frame, value < 3000 AS dark, lag(value < 3000) OVER (PARTITION BY roi ORDER BY frame) AS was FROM fr)
SELECT roi, frame FROM g WHERE dark AND NOT coalesce(was, false)""")
def t36_edges(spark, d):
    return stim.rising_edges(b.traces(spark, d).withColumn("dark", F.col("value") < 3000), UNIT, "dark").select("roi", "frame")


@query("t37_condition_profiles", f"""WITH {DFF} SELECT roi % 4 AS condition, rel::BIGINT AS rel, round(avg(dff), 6) AS mean,
CASE WHEN count(dff) > 1 THEN round(stddev_samp(dff) / sqrt(count(dff)), 6) END AS sem, count(dff) AS n FROM bk GROUP BY 1, 2 -- FROM fr""")
def t37(spark, d):
    rows = train_dff(spark, d).withColumn("condition", F.col("roi") % 4)
    return stim.condition_profile(rows, ["condition"]).select(
        "condition", F.col("rel").cast("long").alias("rel"), rounded(F.col("mean")).alias("mean"), rounded(F.col("sem")).alias("sem"), "n")


@query("g1_pooled", """SELECT s_nationkey AS rec, s_acctbal AS a, NULL::VARCHAR AS segment, 'supplier' AS source FROM supplier
UNION ALL SELECT c_nationkey, c_acctbal, c_mktsegment, 'customer' FROM customer""")
def g1(spark, d):
    s = b.table(spark, d, "supplier").select(F.col("s_nationkey").alias("rec"), F.col("s_acctbal").alias("a"))
    c = b.table(spark, d, "customer").select(F.col("c_nationkey").alias("rec"), F.col("c_acctbal").alias("a"), F.col("c_mktsegment").alias("segment"))
    return pooling.pooled({"supplier": s, "customer": c})


@query("g2_side_by_side", """SELECT anm, round(avg(dose) FILTER (status = 'F'), 6) AS f_dose, round(avg(dose) FILTER (status = 'O'), 6) AS o_dose,
round(avg(dose) FILTER (status = 'P'), 6) AS p_dose FROM session GROUP BY anm""")
def g2(spark, d):
    means = b.sessions(spark, d).groupBy("anm", F.lower("status").alias("status")).agg(rounded(F.avg("dose")).alias("dose"))
    return pooling.side_by_side(means, ["anm"], "status", ["dose"], ["f", "o", "p"])


PAIR = "pr AS (SELECT anm, avg(dose) FILTER (status = 'F') AS a, avg(dose) FILTER (status = 'O') AS z FROM session GROUP BY anm)"


def dose_pairs(spark, d):
    """Paired values of the animals that have both conditions."""
    rows = b.sessions(spark, d)
    one = lambda k, n: rows.where(F.col("status") == k).groupBy("anm").agg(F.avg("dose").alias(n))
    return one("F", "a").join(one("O", "z"), "anm")


@query("g3_paired_keys", f"WITH {PAIR} SELECT anm, round(a, 6) AS a, round(z, 6) AS z FROM pr WHERE a IS NOT NULL AND z IS NOT NULL -- FROM session")
def g3(spark, d):
    return dose_pairs(spark, d).select("anm", rounded(F.col("a")).alias("a"), rounded(F.col("z")).alias("z"))


@query("g4_unique_merge", """SELECT a.anm, round(100 * a.m, 6) AS high, round(100 * z.m, 6) AS large FROM
(SELECT anm, avg((label LIKE '%HIGH%')::INT) AS m FROM session GROUP BY 1) a JOIN (SELECT anm, avg((dose > 100000)::INT) AS m FROM session GROUP BY 1) z USING (anm)""")
def g4(spark, d):
    percent = lambda c, n: b.sessions(spark, d).groupBy("anm").agg(rounded(F.avg(c.cast("double")) * 100).alias(n))
    return pooling.unique_merge(percent(F.col("label").contains("HIGH"), "high"), percent(F.col("dose") > 100_000, "large"), ["anm"])


@query("g5_group_condition", "SELECT session, anm FROM session WHERE anm IN (SELECT anm FROM session GROUP BY anm HAVING count(*) > 12 AND min(dose) < 20000)")
def g5(spark, d):
    return pooling.keep_groups(b.sessions(spark, d), ["anm"], (F.count("*") > 12) & (F.min("dose") < 20_000)).select("session", "anm")


@query("g6_first_days", """SELECT session, anm, k FROM session WHERE k <= 3 AND anm IN (SELECT anm FROM session WHERE label LIKE '%URGENT%')""")
def g6(spark, d):
    rows = b.sessions(spark, d)
    drug = rows.where(F.col("label").contains("URGENT")).select("anm").distinct()
    return rows.where("k <= 3").join(drug, "anm", "left_semi").select("session", "anm", "k")


@query("g7_class_shares", """WITH s AS (SELECT anm, date_trunc('year', date) AS year, avg((status = 'F')::INT) AS share FROM session GROUP BY 1, 2)
SELECT anm, year(year)::INT AS year, round(share, 6) AS share, round(share - lag(share) OVER (PARTITION BY anm ORDER BY year), 6) AS change FROM s""")
def g7(spark, d):
    s = b.sessions(spark, d).groupBy("anm", F.year("date").alias("year")).agg(F.avg((F.col("status") == "F").cast("double")).alias("share"))
    change = F.col("share") - F.lag("share").over(Window.partitionBy("anm").orderBy("year"))
    return s.select("anm", "year", rounded(F.col("share")).alias("share"), rounded(change).alias("change"))


@query("g8_conditional_shares", """SELECT anm, round(count(*) FILTER (status = 'F' AND dose > 80000) / nullif(count(*) FILTER (dose > 80000), 0), 6) AS share FROM session GROUP BY anm""")
def g8(spark, d):
    return b.sessions(spark, d).groupBy("anm").agg(rounded(pooling.share(F.col("status") == "F", F.col("dose") > 80_000)).alias("share"))


@query("g9_units_of_step", "SELECT roi, frame, value FROM fr WHERE roi IN (SELECT roi FROM fr WHERE frame = 0 AND value > 40000)")
def g9(spark, d):
    rows = b.traces(spark, d)
    return rows.join(rows.where("frame = 0 and value > 40000").select("roi"), "roi", "left_semi").select("roi", "frame", "value")


@query("g10_by_step", "SELECT frame % 60 AS step, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS mid, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM fr GROUP BY 1")
def g10(spark, d):
    return b.traces(spark, d).groupBy((F.col("frame") % 60).alias("step")).agg(
        rounded(F.avg("value")).alias("mean"), rounded(median("value")).alias("mid"), rounded(F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"))


VEC = """v AS (SELECT label, vec_id % 3 AS session, pos - 1 AS pos, x FROM embeddings, unnest(embedding::DOUBLE[]) WITH ORDINALITY AS u(x, pos)),
one AS (SELECT label, session, pos, avg(x) AS x FROM v GROUP BY 1, 2, 3), mean AS (SELECT label, pos, avg(x) AS mean, count(*) AS n FROM one GROUP BY 1, 2)"""


def profiles(spark, d):
    rows = b.table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3).alias("session"), F.col("embedding").cast("array<double>").alias("profile"))
    return pooling.mean_profiles(rows, ["label"], ["session"], "profile")


@query("g11_mean_profiles", f"WITH {VEC} SELECT label, pos::INT AS pos, round(mean, 6) AS mean, n FROM mean")
def g11(spark, d):
    return profiles(spark, d).select("label", "pos", rounded(F.col("mean")).alias("mean"), "n")


@query("g12_profile_correlation", f"""WITH {VEC} SELECT a.label, round(corr(a.mean, z.mean), 6) AS r, round(max(a.mean) - avg(a.mean) FILTER (a.pos < 20), 6) AS peak
FROM mean a JOIN mean z ON a.pos = z.pos AND z.label = a.label + 1 GROUP BY a.label""")
def g12(spark, d):
    p = profiles(spark, d).select("label", "pos", "mean")
    after = p.select((F.col("label") - 1).alias("label"), "pos", F.col("mean").alias("other"))
    return p.join(after, ["label", "pos"]).groupBy("label").agg(
        rounded(F.corr("mean", "other")).alias("r"), rounded(F.max("mean") - F.avg(F.when(F.col("pos") < 20, F.col("mean")))).alias("peak"))


@query("g13_first_rows", "SELECT anm, session FROM session WHERE k = 1")
def g13(spark, d):
    return pooling.first_rows(b.sessions(spark, d), ["anm"], ["date", "session"]).select("anm", "session")


@query("g14_population_order", f"""WITH {RESPONSE}, c AS (SELECT roi, CASE WHEN ratio > 1.02 THEN 'pyrUp' WHEN ratio < 1 / 1.02 THEN 'pyrDown' ELSE 'pyrStable' END AS class, effect, roi % 5 AS grp FROM resp),
o AS (SELECT *, row_number() OVER w AS place, lag(class) OVER w AS before FROM c WINDOW w AS (PARTITION BY grp ORDER BY class DESC, effect DESC, roi))
SELECT grp, roi, place, before IS NOT NULL AND before <> class AS changes FROM o -- FROM fr""")
def g14(spark, d):
    from tracespark.operators.response import ratio_class

    rows = responses(spark, d, step=0.01).select("roi", ratio_class(F.col("response_ratio"), 1.02).alias("class"), "effect_size", (F.col("roi") % 5).alias("grp"))
    return pooling.population_order(rows, ["grp"], "class", "effect_size", "roi").select("grp", "roi", F.col("place").cast("long").alias("place"), "changes")


#: Nine metrics of a session, from its lines.
METRICS = {
    "n_items": (F.count, "l_quantity", "count(*)"), "quantity": (F.sum, "l_quantity", "sum(l_quantity)"),
    "largest_quantity": (F.max, "l_quantity", "max(l_quantity)"), "price": (F.max, "l_extendedprice", "max(l_extendedprice)"),
    "lowest_price": (F.min, "l_extendedprice", "min(l_extendedprice)"), "discount": (F.max, "l_discount", "max(l_discount)"),
    "lowest_discount": (F.min, "l_discount", "min(l_discount)"), "tax": (F.max, "l_tax", "max(l_tax)"), "parts": (F.count_distinct, "l_partkey", "count(DISTINCT l_partkey)"),
}
LONG = "unnest([" + ", ".join(f"'{m}'" for m in METRICS) + "]) AS metric"
SIDE = "unnest([" + ", ".join(f"{{0}}.{m}::DOUBLE" for m in METRICS) + "])"
MEASURED = f"me AS (SELECT l_orderkey AS session, {', '.join(f'{x[2]} AS {m}' for m, x in METRICS.items())} FROM lineitem GROUP BY 1), sm AS (SELECT s.anm, s.date, s.status, s.label, me.* FROM session s JOIN me USING (session))"


def measured(spark, d, by=()):
    lines = b.table(spark, d, "lineitem").withColumn("type", F.col("l_linenumber") % 2)
    return lines.groupBy(F.col("l_orderkey").alias("session"), *by).agg(*[f(c).cast("double").alias(m) for m, (f, c, _) in METRICS.items()])


@query("g15_metric_pairs", f"""WITH {MEASURED}, f AS (SELECT *, count(*) OVER (PARTITION BY anm, year(date)) AS c FROM sm WHERE status = 'F'), o AS (SELECT *, count(*) OVER (PARTITION BY anm, year(date)) AS c FROM sm WHERE status = 'O')
SELECT f.anm, year(f.date)::INT AS day, {LONG}, {SIDE.format('f')} AS value_a, {SIDE.format('o')} AS value_b FROM f JOIN o ON f.anm = o.anm AND year(f.date) = year(o.date) WHERE f.c = 1 AND o.c = 1 -- FROM session""")
def g15(spark, d):
    """Days with exactly one session of either kind; metrics as long rows."""
    rows = b.sessions(spark, d).join(measured(spark, d), "session").withColumn("day", F.year("date"))
    side = lambda k: pooling.once_each(rows.where(F.col("status") == k), ["anm", "day"])
    return pooling.paired_metrics(side("F"), side("O"), ["anm", "day"], list(METRICS))


@query("g15_unpaired_groups", f"WITH {MEASURED}, x AS (SELECT session, label, {LONG}, {SIDE.format('sm')} AS value FROM sm WHERE label IN ('1-URGENT', '5-LOW')) SELECT * FROM x WHERE value IS NOT NULL -- FROM session s")
def g15_unpaired(spark, d):
    """Sessions of two treatments, unpaired."""
    rows = b.sessions(spark, d).where(F.col("label").isin("1-URGENT", "5-LOW")).join(measured(spark, d), "session")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m")
    return rows.select("session", "label", each).select("session", "label", "m.*").where("value is not null")


@query("g15_trial_types", f"""WITH ty AS (SELECT l_orderkey AS session, l_linenumber % 2 AS type, {', '.join(f'{x[2]} AS {m}' for m, x in METRICS.items())} FROM lineitem GROUP BY 1, 2)
SELECT a.session, {LONG}, {SIDE.format('a')} AS value_a, {SIDE.format('z')} AS value_b FROM ty a JOIN ty z ON a.session = z.session AND a.type = 0 AND z.type = 1""")
def g15_types(spark, d):
    """Two types of trials within each session that has both."""
    rows = measured(spark, d, ["type"])
    return pooling.paired_metrics(rows.where("type = 0"), rows.where("type = 1"), ["session"], list(METRICS))


@query("g16_condition_pairs", """WITH p AS (SELECT anm, year(date)::INT AS day, max(dose) FILTER (label = '1-URGENT') AS drug, max(dose) FILTER (label = '5-LOW') AS base FROM session GROUP BY 1, 2)
SELECT * FROM p WHERE drug IS NOT NULL AND base IS NOT NULL""")
def g16(spark, d):
    wide = b.sessions(spark, d).groupBy("anm", F.year("date").alias("day")).pivot("label", ["1-URGENT", "5-LOW"]).agg(F.max("dose"))
    return wide.select("anm", "day", F.col("1-URGENT").alias("drug"), F.col("5-LOW").alias("base")).where("drug is not null and base is not null")


SIMILAR = """v AS (SELECT label AS anm, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT anm, vec_id, list_transform(e, lambda x: x - list_avg(e)) AS c FROM v),
sim AS (SELECT a.anm, a.vec_id AS a, z.vec_id AS z, list_cosine_similarity(a.c, z.c) AS similarity FROM c a JOIN c z ON a.anm = z.anm AND a.vec_id < z.vec_id)"""


def vectors(spark, d):
    """Session vectors; a label is an animal."""
    return b.table(spark, d, "embeddings").select(F.col("label").alias("anm"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))


def similar(spark, d):
    return pooling.pairwise_similarity(vectors(spark, d), "anm", "vec_id", "v")


@query("g17_similarities", f"WITH {SIMILAR} SELECT anm, a, z, round(similarity, 6) AS similarity FROM sim")
def g17(spark, d):
    return similar(spark, d).select("anm", "a", "z", rounded(F.col("similarity")).alias("similarity"))


@query("g18_connected_sessions", f"""WITH RECURSIVE {SIMILAR}, l AS (SELECT anm, a, z FROM sim WHERE similarity > 0.3 UNION ALL SELECT anm, z, a FROM sim WHERE similarity > 0.3),
reach AS (SELECT anm, vec_id AS a, vec_id AS z FROM c UNION SELECT r.anm, r.a, l.z FROM reach r JOIN l ON r.anm = l.anm AND r.z = l.a),
m AS (SELECT anm, a, min(z) AS first FROM reach GROUP BY 1, 2)
SELECT anm, a AS vec_id, dense_rank() OVER (PARTITION BY anm ORDER BY first) AS "group" FROM m""")
def g18(spark, d):
    links = pooling.similarity_links(vectors(spark, d), "anm", "vec_id", "v", 0.3)
    nodes = vectors(spark, d).select("anm", F.col("vec_id").alias("node"))
    return pooling.connected_groups(links, nodes, "anm").select("anm", F.col("node").alias("vec_id"), "group")


@query("g19_both_conditions", """WITH a AS (SELECT roi, avg(value) AS m FROM fr WHERE frame % 2 = 0 GROUP BY roi), z AS (SELECT roi, avg(value) AS m FROM fr WHERE frame % 2 = 1 GROUP BY roi)
SELECT roi, round(a.m, 6) AS even, round(z.m, 6) AS odd FROM a JOIN z USING (roi) WHERE a.m > 38000 AND z.m > 38000""")
def g19(spark, d):
    half = lambda k, n: b.traces(spark, d).where(F.col("frame") % 2 == k).groupBy("roi").agg(F.avg("value").alias(n))
    return pooling.unique_merge(half(0, "even"), half(1, "odd"), UNIT).where("even > 38000 and odd > 38000").select(
        "roi", rounded(F.col("even")).alias("even"), rounded(F.col("odd")).alias("odd"))


SEG = "sg AS (SELECT c_mktsegment AS family, a, z FROM pr JOIN customer ON c_custkey = anm WHERE a IS NOT NULL AND z IS NOT NULL)"


def segment_pairs(spark, d):
    family = b.table(spark, d, "customer").select(F.col("c_custkey").alias("anm"), F.col("c_mktsegment").alias("family"))
    return dose_pairs(spark, d).join(family, "anm")


@query("z1_paired_t", f"""WITH {PAIR}, {SEG} SELECT family, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(z), 6) AS mean_b,
round(avg(a - z) / (stddev_samp(a - z) / sqrt(count(*))), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM sg GROUP BY family -- FROM session""")
def z1(spark, d):
    return stats.paired_t(segment_pairs(spark, d), ["family"], "a", "z").select(
        "family", "n", rounded(F.col("mean_a")).alias("mean_a"), rounded(F.col("mean_b")).alias("mean_b"), rounded(F.col("t")).alias("t"), "df")


@query("z1_signed_rank", f"""WITH {PAIR}, {SEG}, x AS (SELECT family, a - z AS d FROM sg WHERE a <> z), r AS (SELECT family, d, rank() OVER (PARTITION BY family ORDER BY abs(d)) + (count(*) OVER (PARTITION BY family, abs(d)) - 1) / 2.0::DOUBLE AS r FROM x)
SELECT family, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY family -- FROM session""")
def z1_ranks(spark, d):
    return stats.signed_rank(segment_pairs(spark, d), ["family"], "a", "z").select("family", "n", "w_plus", "w_minus")


@query("z1_p_values")
def z1_p(spark, d):
    t = stats.with_p(stats.paired_t(segment_pairs(spark, d), ["family"], "a", "z"), "t").select("family", F.lit("t").alias("test"), "p")
    w = stats.with_p(stats.signed_rank(segment_pairs(spark, d), ["family"], "a", "z"), "w").select("family", F.lit("signed rank").alias("test"), "p")
    return t.union(w)


def two_groups(spark, d):
    return b.traces(spark, d).select("roi", (F.col("frame") % 2).cast("int").alias("grp"), "second", "value")


@query("z2_welch_t", """WITH s AS (SELECT roi, avg(value) FILTER (frame % 2 = 0) m0, avg(value) FILTER (frame % 2 = 1) m1, var_samp(value) FILTER (frame % 2 = 0) / count(*) FILTER (frame % 2 = 0) a,
 var_samp(value) FILTER (frame % 2 = 1) / count(*) FILTER (frame % 2 = 1) z, count(*) FILTER (frame % 2 = 0) n0, count(*) FILTER (frame % 2 = 1) n1 FROM fr GROUP BY roi)
SELECT roi, round((m0 - m1) / sqrt(a + z), 6) AS t, round(pow(a + z, 2) / (a * a / (n0 - 1) + z * z / (n1 - 1)), 6) AS df FROM s""")
def z2(spark, d):
    return stats.two_sample_t(two_groups(spark, d), UNIT, "grp", "value").select("roi", rounded(F.col("t")).alias("t"), rounded(F.col("df")).alias("df"))


@query("z2_pooled_t", """WITH s AS (SELECT roi, avg(value) FILTER (frame % 2 = 0) m0, avg(value) FILTER (frame % 2 = 1) m1, var_samp(value) FILTER (frame % 2 = 0) v0, var_samp(value) FILTER (frame % 2 = 1) v1,
 count(*) FILTER (frame % 2 = 0) n0, count(*) FILTER (frame % 2 = 1) n1 FROM fr GROUP BY roi)
SELECT roi, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1)), 6) AS t, (n0 + n1 - 2)::DOUBLE AS df FROM s""")
def z2_pooled(spark, d):
    return stats.two_sample_t(two_groups(spark, d), UNIT, "grp", "value", equal=True).select("roi", rounded(F.col("t")).alias("t"), "df")


@query("z2_rank_sum", """WITH r AS (SELECT roi, frame % 2 AS g, rank() OVER (PARTITION BY roi ORDER BY second) + (count(*) OVER (PARTITION BY roi, second) - 1) / 2.0::DOUBLE AS r FROM fr),
s AS (SELECT roi, sum(r) FILTER (g = 0) AS w, count(*) FILTER (g = 0)::DOUBLE AS n0, count(*) FILTER (g = 1)::DOUBLE AS n1 FROM r GROUP BY roi)
SELECT roi, round((w - n0 * (n0 + n1 + 1) / 2) / sqrt(n0 * n1 * (n0 + n1 + 1) / 12), 6) AS z FROM s -- FROM fr""")
def z2_ranks(spark, d):
    return stats.rank_sum(stats.mann_whitney(two_groups(spark, d), UNIT, "grp", "second")).select("roi", rounded(F.col("z")).alias("z"))


@query("z3_mann_whitney", """WITH r AS (SELECT roi, frame % 2 AS g, rank() OVER (PARTITION BY roi ORDER BY second) + (count(*) OVER (PARTITION BY roi, second) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY roi, second) AS t FROM fr)
SELECT roi, count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, sum(CASE WHEN g = 0 THEN r ELSE 0 END) - count(*) FILTER (g = 0) * (count(*) FILTER (g = 0) + 1) / 2.0::DOUBLE AS u, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY roi -- FROM fr""")
def z3(spark, d):
    return stats.mann_whitney(two_groups(spark, d), UNIT, "grp", "second")


@query("z3_p_values")
def z3_p(spark, d):
    u = stats.with_p(stats.mann_whitney(two_groups(spark, d), UNIT, "grp", "second"), "u").select("roi", F.col("p").alias("p_u"))
    t = stats.with_p(stats.two_sample_t(two_groups(spark, d), UNIT, "grp", "value"), "t").select("roi", F.col("p").alias("p_t"))
    return u.join(t, "roi")


@query("z4_window_tests", f"""WITH {ALIGNED}, bs AS (SELECT roi, avg(value) AS m FROM aligned WHERE rel < 0 GROUP BY roi),
w AS (SELECT a.roi, rel // 10 AS win, roi % 2 AS grp, avg(value - m) AS x FROM aligned a JOIN bs USING (roi) WHERE rel >= 0 GROUP BY ALL),
q AS (SELECT win, grp, quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM w GROUP BY 1, 2),
s AS (SELECT win, avg(x) FILTER (grp = 0) m0, avg(x) FILTER (grp = 1) m1, var_samp(x) FILTER (grp = 0) / count(*) FILTER (grp = 0) a, var_samp(x) FILTER (grp = 1) / count(*) FILTER (grp = 1) z,
 count(*) FILTER (grp = 0) n0, count(*) FILTER (grp = 1) n1 FROM w GROUP BY 1),
r AS (SELECT win, grp, rank() OVER (PARTITION BY win ORDER BY x) AS r FROM w), u AS (SELECT win, sum(r) FILTER (grp = 0) - count(*) FILTER (grp = 0) * (count(*) FILTER (grp = 0) + 1) / 2.0::DOUBLE AS u FROM r GROUP BY 1)
SELECT q.win::BIGINT AS win, grp, round(mid, 6) AS mid, round(q1, 6) AS q1, round(q3, 6) AS q3, round((m0 - m1) / sqrt(a + z), 5) AS t, round(pow(a + z, 2) / (a * a / (n0 - 1) + z * z / (n1 - 1)), 4) AS df, u
FROM q JOIN s USING (win) JOIN u USING (win) -- FROM fr""")
def z4(spark, d):
    """Per window after the event, less the baseline: both groups' quartiles, Welch's t and U."""
    x = window_means(spark, d)
    q = lambda p: rounded(F.percentile("x", p))
    t = stats.two_sample_t(x, ["win"], "grp", "x").select("win", F.round("t", 5).alias("t"), F.round("df", 4).alias("df"))
    u = stats.mann_whitney(x, ["win"], "grp", "x").select("win", "u")
    return x.groupBy("win", "grp").agg(q(0.5).alias("mid"), q(0.25).alias("q1"), q(0.75).alias("q3")).join(t, "win").join(u, "win")


def window_means(spark, d):
    rows = aligned(spark, d)
    base = rows.where("rel < 0").groupBy("roi").agg(F.avg("value").alias("m"))
    return rows.where("rel >= 0").join(base, "roi").groupBy("roi", (F.col("roi") % 2).alias("grp"), F.floor(F.col("rel") / 10).alias("win")).agg(
        F.avg(F.col("value") - F.col("m")).alias("x"))


@query("z4_p_values")
def z4_p(spark, d):
    """p of both tests of each window."""
    x = window_means(spark, d)
    t = stats.with_p(stats.two_sample_t(x, ["win"], "grp", "x"), "t").select("win", "t", "df", F.col("p").alias("p_t"))
    return t.join(stats.with_p(stats.mann_whitney(x, ["win"], "grp", "x"), "u").select("win", "u", "n0", "n1", "ties", F.col("p").alias("p_u")), "win")


@query("z5_class_counts", f"""WITH {RESPONSE}, {NULLS[len(ALIGNED) + 2:]}, q AS (SELECT roi, quantile_cont(amplitude, 0.95) AS hi FROM nul GROUP BY roi)
SELECT rec, count(*) FILTER (amp > hi) AS k, count(*) AS n FROM resp JOIN q USING (roi) JOIN unit USING (roi) GROUP BY rec -- FROM fr""")
def z5(spark, d):
    return responses(spark, d).join(bounds_of(spark, d), "roi").join(b.units(spark, d), "roi").groupBy("rec").agg(
        F.count_if(F.col("response_amplitude") > F.col("hi")).alias("k"), F.count("*").alias("n"))


@query("z5_over_sessions", f"""WITH {RESPONSE}, {NULLS[len(ALIGNED) + 2:]}, q AS (SELECT roi, quantile_cont(amplitude, 0.95) AS hi FROM nul GROUP BY roi),
c AS (SELECT anm, rec, count(*) FILTER (amp > hi) / count(*) AS share FROM resp JOIN q USING (roi) JOIN unit USING (roi) GROUP BY 1, 2)
SELECT anm, count(*) AS n, round(avg(share), 6) AS mean, round((avg(share) - 0.05) / nullif(stddev_samp(share) / sqrt(count(*)), 0), 6) AS t, (count(*) - 1)::DOUBLE AS df FROM c GROUP BY anm -- FROM fr""")
def z5_sessions(spark, d):
    """Share of responding units over the sessions of an animal, against chance."""
    anm = b.units(spark, d).select("rec", "anm").distinct()
    shares = z5(spark, d).join(anm, "rec").withColumn("share", F.col("k") / F.col("n"))
    return stats.one_sample_t(shares, ["anm"], "share", 0.05).select("anm", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("t")).alias("t"), "df")


@query("z5_p_values")
def z5_p(spark, d):
    return stats.with_p(z5(spark, d).withColumn("chance", F.lit(0.05)), "binomial").select("rec", "k", "n", "p")


@query("z6_linear_fit", "SELECT roi, round(regr_slope(value, second), 6) AS slope, round(regr_intercept(value, second), 6) AS intercept, round(corr(value, second), 6) AS r FROM fr GROUP BY roi")
def z6(spark, d):
    return stats.linear_fit(b.traces(spark, d), UNIT, "value", "second").select("roi", *[rounded(F.col(c)).alias(c) for c in ("slope", "intercept", "r")])


@query("z6_p_values")
def z6_p(spark, d):
    """p of the fit's slope: t of r with two degrees of freedom less."""
    return stats.fit_p(stats.linear_fit(b.traces(spark, d), UNIT, "value", "second")).select("roi", "n", "r", "p")


@query("z7_ecdf", """WITH c AS (SELECT roi % 2 AS grp, second, count(*) AS n FROM fr GROUP BY 1, 2)
SELECT grp, second, round(sum(n) OVER (PARTITION BY grp ORDER BY second) / sum(n) OVER (PARTITION BY grp), 6) AS share FROM c -- FROM fr""")
def z7(spark, d):
    return stats.ecdf(b.traces(spark, d).withColumn("grp", F.col("roi") % 2), ["grp"], "second").withColumn("share", rounded(F.col("share")))


HISTOGRAM = "h AS (SELECT roi, least(floor((value - 0) / 5000), 19)::BIGINT AS bin, count(*) AS n FROM fr WHERE value BETWEEN 0 AND 100000 GROUP BY 1, 2)"


@query("z8_histogram", f"WITH {HISTOGRAM} SELECT roi, bin, n FROM h -- FROM fr")
def z8(spark, d):
    return stats.histogram(b.traces(spark, d), UNIT, "value", 0, 100_000, 20)


@query("z8_mode_bin", f"WITH {HISTOGRAM} SELECT roi, arg_max(bin, (n, -bin)) AS mode_bin FROM h GROUP BY roi -- FROM fr")
def z8_mode(spark, d):
    return z8(spark, d).groupBy("roi").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("mode_bin"))


#: A common multiple of the numbers of events that a unit may have (up to 12).
EVENTS = 27_720


@query("z9_unit_profile", f"""WITH {ALIGNED}, u AS (SELECT roi, rel, avg(value) AS m FROM aligned GROUP BY 1, 2)
SELECT rel::BIGINT AS rel, {exact_sql('avg(m)', f'{EVENTS} * 100 * count(*)')} AS mean, round(stddev_pop(m) / sqrt(count(*)), 6) AS sem FROM u GROUP BY rel -- FROM fr""")
def z9(spark, d):
    per_unit = aligned(spark, d).groupBy("roi", "rel").agg(F.avg("value").alias("m"))
    return per_unit.groupBy(F.col("rel").cast("long").alias("rel")).agg(
        exact(F.avg("m"), F.count("*") * (100 * EVENTS)).alias("mean"), rounded(F.stddev_pop("m") / F.sqrt(F.count("*"))).alias("sem"))
