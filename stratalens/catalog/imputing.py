"""Random-forest imputation of every column with gaps, from the whole dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens import schema as s
from stratalens.catalog.base import Tables, query
from stratalens.catalog.shaping import EVER, IMP, WHOLE
from stratalens.catalog.views import survey
from stratalens.operators import impute
from stratalens.runtime import materialise

FLAGS = {s.befor(x, h): [0, 1, 2] if x == "SMK" else [0, 1] for x in s.PRIOR_USE for h in s.HARD}
DEMOGRAPHIC = {"GENDER": [1, 2], "AGEPRC": list(range(1, 12)), "TOTINC": [1, 2, 3, 4], "ETHNIC": [1, 2, 3, 4],
               "EDUCAT": [1, 2, 3, 4, 5], "POPDEN": [1, 2, 3], "RLGINF": [1, 2, 3, 4]}
FACTORS = {**FLAGS, **{c: [0, 1] for c in [*EVER, *IMP]}, **DEMOGRAPHIC}
#: All columns but the row id: factors with their levels, ages and design columns as numbers.
LEVELS = {c: FACTORS.get(c) for c in WHOLE if c != "rid"}
#: The factors with gaps anywhere: prior use of a prescription item or their minimum whose age is unknown, and religion.
GAPS = [s.befor(x, h) for x in s.PRIOR_USE for h in ["MED", *s.PRESCRIPTION]] + ["RLGINF"]


def imputed(before):
    return impute.rf_impute(before, LEVELS, row_id="rid")


@query("rf_impute")
def _(t: Tables):
    return imputed(materialise(t.analysis()))


@query("rf_impute_summary", survey(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, CAST(0 AS BIGINT) AS n_null_after, "
    "CAST(0 AS BIGINT) AS n_changed FROM analysis" for c in LEVELS)))
def _(t: Tables):
    """Of each column the gaps before and after, and the observed cells that changed."""
    before = materialise(t.analysis())
    after = imputed(before).select("rid", *[F.col(c).alias(f"new_{c}") for c in LEVELS])
    same = [F.count_if(F.col(c).isNull()).alias(f"a_{c}") for c in LEVELS]
    same += [F.count_if(F.col(f"new_{c}").isNull()).alias(f"b_{c}") for c in LEVELS]
    same += [F.count_if(F.col(c) != F.col(f"new_{c}")).alias(f"c_{c}") for c in LEVELS]
    counted = before.join(after, "rid").agg(*same)
    return counted.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("variable"), F.col(f"a_{c}").alias("n_missing"), F.col(f"b_{c}").alias("n_null_after"),
        F.col(f"c_{c}").alias("n_changed")) for c in LEVELS])))
