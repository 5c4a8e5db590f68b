"""Queries and SQL of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulario.operators.heavy_keys import folded, heavy_keys, summarise_keys
from cartulario.operators.packed_values import unpack
from cartulario.session import table


def _keys() -> dict:
    return {"destino": F.col("destino"), "rel": folded("rel")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least one hundredth of all rows of ``cita``."""
    return heavy_keys(table(spark, sf_dir, "cita").select("destino", "rel"), _keys(), 0.01).select("destino", "rel")


def p2_claves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct origins and sum of ``n`` of every key of ``cita``."""
    cita = table(spark, sf_dir, "cita").select("destino", "rel", "origen", "n")
    return summarise_keys(cita, _keys(), F.col("origen"), F.col("n"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each norm packed in ``normas`` and ``concordancias`` as one row."""
    parts = []
    for name, field in (("sentencias_judiciales", "normas"), ("doctrina_instituciones", "concordancias")):
        rows = unpack(table(spark, sf_dir, name), "id", field)
        parts.append(rows.select(F.lit(name).alias("tabla"), "id", "posicion", "valor"))
    return parts[0].unionByName(parts[1])


QUERIES = {"p2_found": p2_found, "p2_claves": p2_claves, "p5_found": p5_found}

_NORMAL = "lower(regexp_replace(rel, '^\\s+|\\s+$', '', 'g'))"
SQL = {
    "p2_found": f"""
        SELECT destino, {_NORMAL} AS rel FROM cita
        WHERE destino IS NOT NULL AND rel IS NOT NULL
        GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM cita)""",
    "p2_claves": f"""
        SELECT destino, {_NORMAL} AS rel, count(*) AS filas, count(DISTINCT origen) AS distintos,
               CAST(coalesce(sum(n), 0) AS BIGINT) AS suma
        FROM cita GROUP BY 1, 2""",
}
