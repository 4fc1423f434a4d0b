"""Registered queries and their DuckDB twins, grouped by family."""

from pyspark.sql import functions as F

from . import col, det, fn, joins  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
from .fixtures import dirty


def flagship(spark, sf_dir):
    from sparkscrub.operators import detect

    analysis = detect.analyze(dirty(spark, sf_dir, "dirty_lineitem"), only={"faltante", "atipico"})
    return analysis.findings().groupBy("tipo", "columna").agg(F.count(F.lit(1)).alias("hallazgos"))
