"""Distances, nearest neighbours, Tomek links, SMOTE and the replicate driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens import schema as s
from stratalens.catalog.base import Tables, query
from stratalens.catalog.views import survey
from stratalens.functions import distance
from stratalens.operators import neighbours, resample
from stratalens.plans import modelling as m
from stratalens.plans import resampling as rs
from stratalens.runtime import materialise, scratch_path

ITEMS = s.HARD
CATS = rs.CATEGORIES
SEED = 7


def resampling_frame(t: Tables, complete: bool):
    """Model frame of all twelve outcomes over a stored, narrow analysis dataset."""
    narrow = materialise(t.analysis().select(*rs.needed_columns(ITEMS)))
    frame = m.model_frame(narrow, ITEMS, complete)
    return frame if complete else frame.filter("y is not null")


def frame_sql(complete: bool) -> str:
    known = " AND ".join(f"{x} IS NOT NULL" for x in s.PREDICTOR_LEVELS) if complete else "true"
    return "fr AS MATERIALIZED (SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{h}' AS outcome, VESTR_C AS stratum, VEREP AS psu, rid, ANALWT2_C AS w, EVER_{h} AS y, "
        + ", ".join(f"{x}_befor_{h} AS {x}_befor" for x in s.PRIOR_USE) + ", GENDER, ETHNIC, RLGINF "
        f"FROM analysis WHERE EVER_{h} IS NOT NULL" for h in ITEMS) + f") WHERE {known})"


MISMATCH = " + ".join(f"CASE WHEN a.{c} = b.{c} THEN 0 ELSE 1 END" for c in CATS)
HEOM = [
    "span AS (SELECT outcome, stratum, max(w) - min(w) AS span FROM fr GROUP BY ALL)",
    "near AS MATERIALIZED (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY outcome, stratum, rid "
    "ORDER BY CAST(mismatches AS HUGEINT) * span * span + CAST(gap AS HUGEINT) * gap, nn) AS n FROM ("
    f"SELECT outcome, stratum, a.rid, b.rid AS nn, a.y AS ya, b.y AS yb, {MISMATCH} AS mismatches, abs(a.w - b.w) AS gap, span "
    "FROM fr a JOIN fr b USING (outcome, stratum) JOIN span USING (outcome, stratum) WHERE a.rid <> b.rid)) WHERE n = 1)",
]
LINKS = ("links AS MATERIALIZED (SELECT a.outcome, a.stratum, a.rid AS minority, a.nn AS majority FROM near a JOIN near b "
         "ON a.outcome = b.outcome AND a.nn = b.rid AND b.nn = a.rid WHERE a.ya = 1 AND a.yb = 0)")


@query("nn_self_join", survey(
    "SELECT outcome, stratum, rid, nn, mismatches, CAST(gap AS DOUBLE) AS gap FROM near WHERE ya = 1", frame_sql(False), *HEOM))
def _(t: Tables):
    frame = resampling_frame(t, False)
    return neighbours.heom_nearest(frame.filter("y = 1"), frame, rs.GROUP, CATS, "w", "rid")


@query("tomek_links", survey("SELECT * FROM links", frame_sql(False), *HEOM, LINKS))
def _(t: Tables):
    return resample.tomek_links(resampling_frame(t, False), rs.GROUP, CATS, "w", "rid")


@query("group_modify", survey(
    "SELECT outcome, stratum, count(*) AS n, CAST(sum(y) AS BIGINT) AS ones FROM fr WHERE NOT EXISTS (SELECT 1 FROM links l "
    "WHERE l.outcome = fr.outcome AND l.majority = fr.rid) GROUP BY ALL", frame_sql(True), *HEOM, LINKS))
def _(t: Tables):
    """Per-stratum cleaning: the rows that stay, counted by stratum and outcome."""
    cleaned = rs.cleaned_frame(resampling_frame(t, True))
    return cleaned.groupBy("outcome", "stratum").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))


def knn_sql(rows: str) -> list[str]:
    probs = [f"p{i} AS (SELECT outcome, stratum, {c} AS v, CAST(sum(y) AS DOUBLE) / count(*) AS p FROM {rows} GROUP BY ALL)"
             for i, c in enumerate(CATS)]
    joins = " ".join(f"JOIN p{i} ON p{i}.outcome = f.outcome AND p{i}.stratum = f.stratum AND p{i}.v = f.{c}"
                     for i, c in enumerate(CATS))
    d2 = " + ".join(f"2 * ((a.c{i} - b.c{i}) * (a.c{i} - b.c{i}))" for i in range(len(CATS)))
    return [
        *probs,
        "var AS (SELECT outcome, stratum, CAST(count(w) * sum(w * w) - sum(w) * sum(w) AS DOUBLE) / "
        f"CAST(count(w) * (count(w) - 1) AS DOUBLE) AS v FROM {rows} GROUP BY ALL)",
        "pts AS MATERIALIZED (SELECT f.*, " + ", ".join(f"p{i}.p AS c{i}" for i in range(len(CATS)))
        + f" FROM {rows} f {joins} WHERE f.y = 1)",
        "knn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outcome, stratum, rid ORDER BY dist2, id) - 1 AS slot "
        f"FROM (SELECT outcome, stratum, a.rid, b.rid AS id, ({d2}) + CASE WHEN v > 0 THEN CAST((b.w - a.w) * (b.w - a.w) AS DOUBLE) "
        "/ (16 * v) ELSE 0 END AS dist2 FROM pts a JOIN pts b USING (outcome, stratum) JOIN var USING (outcome, stratum) "
        "WHERE a.rid <> b.rid)) WHERE slot < 5)",
    ]


@query("knn_self_join", survey(
    "SELECT outcome, stratum, rid, CAST(slot AS INTEGER) AS slot, id, round(dist2, 9) AS dist2 FROM knn",
    frame_sql(True), *knn_sql("fr")))
def _(t: Tables):
    knn = neighbours.hvdm_knn(resampling_frame(t, True), rs.GROUP, CATS, "w", "rid", "y")
    return knn.select(*rs.GROUP, "rid", F.posexplode("neighbours").alias("slot", "hit")).select(
        *rs.GROUP, "rid", "slot", "hit.id", F.round("hit.dist2", 9).alias("dist2"))


@query("top_k_neighbours", survey(
    "SELECT outcome, stratum, count(*) AS pairs, count(DISTINCT rid) AS rows, CAST(max(slot) + 1 AS INTEGER) AS k FROM knn GROUP BY ALL",
    frame_sql(True), *knn_sql("fr")))
def _(t: Tables):
    knn = neighbours.hvdm_knn(resampling_frame(t, True), rs.GROUP, CATS, "w", "rid", "y")
    return knn.groupBy(*rs.GROUP).agg(
        F.sum(F.size("neighbours")).alias("pairs"), F.count("*").alias("rows"), F.max(F.size("neighbours")).alias("k"))


REPLICATES = 3  # of the queries that SQL repeats
WHOLE_RUN = 1000
HEX = "CAST('0x' || substr(h, {0}, {1}) AS BIGINT)"
SMOTE = [
    "kept AS MATERIALIZED (SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.outcome = fr.outcome AND l.majority = fr.rid))",
    *knn_sql("kept"),
    "need AS (SELECT outcome, stratum, count(*) // 2 AS need FROM pts GROUP BY ALL)",
    f"draws AS (SELECT p.*, r AS replicate, md5('{SEED}|' || outcome || '|' || r || '|' || rid) AS h "
    f"FROM pts p, (SELECT unnest(range(1, {REPLICATES + 1})) AS r))",
    "chosen AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outcome, stratum, replicate ORDER BY "
    + HEX.format(1, 8) + ", rid) AS n FROM draws) JOIN need USING (outcome, stratum) WHERE n <= need)",
    "mates AS (SELECT c.*, k.id AS nn FROM chosen c JOIN (SELECT outcome, rid, count(*) AS size FROM knn GROUP BY ALL) z USING (outcome, rid) "
    f"JOIN knn k ON k.outcome = c.outcome AND k.rid = c.rid AND k.slot = {HEX.format(9, 4)} % size)",
    "synthetic AS MATERIALIZED (SELECT m.outcome, m.stratum, CAST(m.replicate AS INTEGER) AS replicate, m.rid, m.nn, "
    f"m.w + ({HEX.format(13, 8)} / 4294967296.0::DOUBLE) * (b.w - m.w) AS w, "
    + ", ".join(f"CASE WHEN {HEX.format(21 + i, 1)} % 2 = 1 THEN b.{c} ELSE m.{c} END AS {c}" for i, c in enumerate(CATS))
    + ", 1 AS y FROM mates m JOIN pts b ON b.outcome = m.outcome AND b.rid = m.nn)",
]


@query("smote", survey("SELECT * EXCLUDE (w), floor(w * 1000000) / 1000000 AS w FROM synthetic", frame_sql(True), *HEOM, LINKS, *SMOTE))
def _(t: Tables):
    cleaned = materialise(rs.cleaned_frame(resampling_frame(t, True)))
    parents = resample.smote_parents(cleaned, rs.GROUP, CATS, "w", "rid")
    rows = resample.smote(parents, rs.GROUP, CATS, "w", "rid", REPLICATES, SEED)
    # both engines draw the same doubles, so millionths are cut, not rounded
    return rows.withColumn("w", F.floor(F.col("w") * 1000000) / 1000000)


@query("replicate_cells", survey(
    "SELECT outcome, replicate, " + ", ".join(s.PREDICTOR_LEVELS) + ", CAST(sum(n) AS BIGINT) AS n, round(sum(w), 3) AS w FROM ("
    f"SELECT outcome, CAST(r AS INTEGER) AS replicate, {', '.join(s.PREDICTOR_LEVELS)}, 1 AS n, w FROM kept, (SELECT unnest(range(1, {REPLICATES + 1})) AS r) "
    f"UNION ALL SELECT outcome, replicate, {', '.join(s.PREDICTOR_LEVELS)}, 1, w FROM synthetic) GROUP BY ALL",
    frame_sql(True), *HEOM, LINKS, *SMOTE))
def _(t: Tables):
    cleaned = materialise(rs.cleaned_frame(resampling_frame(t, True)))
    cells = rs.replicate_cells(cleaned, REPLICATES, SEED)
    return cells.select("outcome", "replicate", *s.PREDICTOR_LEVELS, "n", F.round("w", 3).alias("w"))


@query("replicate_driver")
def _(t: Tables):
    metrics, coefs = rs.replicate_driver(resampling_frame(t, True), WHOLE_RUN, SEED)
    return metrics.unionByName(coefs)


# fits of one factor on the replicates: the logits of the weighted rates of its cells
GENDER_RUN = [
    *SMOTE,
    "gcell AS (SELECT outcome, replicate, GENDER, sum(w) AS w, sum(w * y) AS wy FROM ("
    f"SELECT outcome, CAST(r AS INTEGER) AS replicate, GENDER, w, y FROM kept, (SELECT unnest(range(1, {REPLICATES + 1})) AS r) "
    "UNION ALL SELECT outcome, replicate, GENDER, w, y FROM synthetic) GROUP BY ALL)",
    "gfit AS (SELECT a.outcome, a.replicate, ln(a.wy / (a.w - a.wy)) AS b0, ln(b.wy / (b.w - b.wy)) - ln(a.wy / (a.w - a.wy)) AS b1, "
    "a.wy / a.w AS p1, b.wy / b.w AS p2 FROM gcell a JOIN gcell b ON a.outcome = b.outcome AND a.replicate = b.replicate "
    "AND a.GENDER = 1 AND b.GENDER = 2)",
    "orig AS (SELECT outcome, CAST(sum(w) FILTER (GENDER = 1) AS DOUBLE) AS w1, CAST(sum(w * y) FILTER (GENDER = 1) AS DOUBLE) AS y1, "
    "CAST(sum(w) FILTER (GENDER = 2) AS DOUBLE) AS w2, CAST(sum(w * y) FILTER (GENDER = 2) AS DOUBLE) AS y2 FROM fr GROUP BY outcome)",
    "scored AS (SELECT *, (y1 + y2) / (w1 + w2) AS p0, p1 >= (y1 + y2) / (w1 + w2) AS h1, p2 >= (y1 + y2) / (w1 + w2) AS h2 "
    "FROM gfit JOIN orig USING (outcome))",
    "rates AS (SELECT outcome, replicate, CASE WHEN h1 = h2 THEN 0.0 WHEN h1 THEN y1 / (y1 + y2) ELSE y2 / (y1 + y2) END AS Recall, "
    "CASE WHEN h1 = h2 THEN 0.0 WHEN h1 THEN y1 / w1 ELSE y2 / w2 END AS Precision, "
    "0.5 + 0.5 * sign(p1 - p2) * (y1 * (w2 - y2) - y2 * (w1 - y1)) / ((y1 + y2) * (w1 + w2 - y1 - y2)) AS AUC FROM scored)",
    "run AS (SELECT outcome, replicate, 'coefs' AS kind, '(Intercept)' AS term, b0 AS value FROM gfit "
    "UNION ALL SELECT outcome, replicate, 'coefs', 'GENDER2', b1 FROM gfit "
    + "".join(f"UNION ALL SELECT outcome, replicate, 'metrics', '{x}', {x} FROM rates " for x in ("Recall", "Precision", "AUC")) + ")",
]
RUN_SQL = "SELECT outcome, replicate, kind, term, round(value, 6) AS value, true AS converged FROM run"


def run_rows(records):
    known = F.col("term").isin("(Intercept)", "GENDER2", "Recall", "Precision", "AUC")
    return records.filter(known).select("outcome", "replicate", "kind", "term", F.round("value", 6).alias("value"), "converged")


@query("replicate_driver_one_factor", survey(RUN_SQL, frame_sql(True), *HEOM, LINKS, *GENDER_RUN))
def _(t: Tables):
    """The driver with a model of one factor, whose fits have a closed form."""
    metrics, coefs = rs.replicate_driver(resampling_frame(t, True), REPLICATES, SEED, m.formula_of("GENDER"))
    return run_rows(metrics.withColumn("kind", F.lit("metrics")).unionByName(coefs.withColumn("kind", F.lit("coefs"))))


@query("replicate_run", survey(RUN_SQL, frame_sql(True), *HEOM, LINKS, *GENDER_RUN))
def _(t: Tables):
    """A stored run that ends after the first replicate and is taken up again."""
    frame, path, formula = materialise(resampling_frame(t, True)), scratch_path(t.spark, "run"), m.formula_of("GENDER")
    rs.replicate_run(frame, path, 1, SEED, formula)
    return run_rows(rs.replicate_run(frame, path, REPLICATES, SEED, formula, at_once=2))


# --- distances of respondents with neighbouring ids ----------------------------------------

PAIR_CATS = ["ETHNIC", "GENDER", "RLGINF", "SMK_befor_PNK"]


def neighbouring(t: Tables):
    rows = materialise(t.analysis().select("rid", "EVER_COC", F.col(s.WEIGHT).alias("w"), *PAIR_CATS))
    right = rows.withColumn("rid", F.col("rid") - 1)
    return rows, rows.alias("l").join(right.alias("r"), F.expr("l.rid = r.rid"))


@query("distance_heom", survey(
    "SELECT a.rid, round(sqrt(" + " + ".join(f"CASE WHEN a.{c} = b.{c} THEN 0 ELSE 1 END" for c in PAIR_CATS)
    + " + (abs(a.ANALWT2_C - b.ANALWT2_C) / span) ** 2), 9) AS dist FROM analysis a JOIN analysis b ON b.rid = a.rid + 1, "
    "(SELECT CAST(max(ANALWT2_C) - min(ANALWT2_C) AS DOUBLE) AS span FROM analysis)"))
def _(t: Tables):
    rows, pairs = neighbouring(t)
    span = rows.agg((F.max("w") - F.min("w")).cast("double")).scalar()
    return pairs.withColumn("span", span).select(
        "l.rid", F.round(F.expr(distance.heom(PAIR_CATS, "w", "span")), 9).alias("dist"))


HV = PAIR_CATS


@query("distance_hvdm", survey(
    "SELECT a.rid, round(sqrt(" + " + ".join(f"2 * (a{i}.p - b{i}.p) ** 2" for i in range(len(HV)))
    + " + (a.ANALWT2_C - b.ANALWT2_C) ** 2 / (16 * spread)), 9) AS dist FROM analysis a JOIN analysis b ON b.rid = a.rid + 1 "
    + " ".join(f"JOIN h{i} a{i} ON a{i}.v IS NOT DISTINCT FROM a.{c} JOIN h{i} b{i} ON b{i}.v IS NOT DISTINCT FROM b.{c}" for i, c in enumerate(HV))
    + ", (SELECT var_samp(ANALWT2_C) AS spread FROM analysis)",
    *[f"h{i} AS (SELECT {c} AS v, CAST(sum(EVER_COC) AS DOUBLE) / count(*) AS p FROM analysis GROUP BY {c})"
      for i, c in enumerate(HV)]))
def _(t: Tables):
    rows, pairs = neighbouring(t)
    p_one = neighbours.class_probabilities(rows, [], HV, "EVER_COC").scalar()
    variance = rows.agg(neighbours.variance_of(rows, "w")).scalar()
    at = lambda side: ", ".join(
        f"try_element_at(p_one, concat('{c}=', coalesce(cast({side}.{c} as string), '^n')))" for c in HV)
    joined = pairs.withColumn("p_one", p_one).withColumn("var", variance)
    d2 = distance.hvdm_squared(distance.vdm_squared("la", "ra", len(HV)), "(lw - rw)", "var")
    return joined.selectExpr("l.rid", "l.w as lw", "r.w as rw", "var", f"array({at('l')}) as la", f"array({at('r')}) as ra").select(
        "rid", F.round(F.sqrt(F.expr(d2)), 9).alias("dist"))
