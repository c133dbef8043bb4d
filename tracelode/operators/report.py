"""Report views over a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that a business template replaces.
ALIASES = {
    "finance": {
        "sum": "Volumen Total",
        "Avg": "Ticket Promedio",
        "count": "N° Operaciones",
        "std_dev": "Volatilidad/Riesgo",
        "Min": "Mínimo (H/L)",
        "Max": "Máximo (H/L)",
        "Unique": "Entidades Únicas",
    },
    "network": {
        "sum": "Bytes Totales / Tráfico",
        "count": "N° Paquetes / Eventos",
        "Avg": "Tamaño Promedio",
        "Unique": "Hosts Únicos",
    },
    "cybersecurity": {"count": "Alertas / Logs", "Unique": "IPs Atacantes", "sum": "Payload Total"},
    "sales": {"sum": "Ingresos Totales", "Avg": "Venta Promedio", "count": "N° Ventas"},
    "general": {},
}


def translate(label: str, template: str = "general") -> str:
    return ALIASES[template].get(label, label)


def with_aliases(df: DataFrame, template: str) -> DataFrame:
    """Columns under the template's labels."""
    return df.toDF(*[translate(c, template) for c in df.columns])


def _year(name: Column) -> Column:
    y = F.regexp_replace(name, '"', "").try_cast("int")
    return F.when((y > 1900) & (y < 2100), y)


def executive(profile: DataFrame) -> DataFrame:
    """One row over all columns: years, integrity, mean health and its grade."""
    low = F.lower("column")
    year = F.when(~F.col("is_categorical"), _year(F.col("column")))
    place = F.col("is_categorical") & low.rlike("country|país|location")
    study = F.col("is_categorical") & low.rlike("indicator|indicador|series name")
    values = F.sum(F.when(F.col("count") > 0, F.col("count") + F.col("null_count")))
    nulls = F.sum(F.when(F.col("count") > 0, F.col("null_count")))
    out = profile.agg(
        F.count("*").alias("columns"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.count(year).alias("n_years"),
        F.coalesce(F.sum(F.when(study, F.size("top_values"))), F.lit(0)).alias("n_indicators"),
        F.coalesce(F.max(F.when(place, F.col("distinct_count"))), F.lit(0)).alias("n_places"),
        F.coalesce((1 - F.try_divide(nulls, values)) * 100, F.lit(0.0)).alias("integrity"),
        F.coalesce(F.avg("health_score"), F.lit(0.0)).alias("health"),
    )
    grade = F.when(F.col("health") > 80, "excellent").when(F.col("health") > 50, "regular").when(F.col("health") > 0, "critical").otherwise("n/a")
    return out.withColumn("grade", grade)


def cards(profile: DataFrame) -> DataFrame:
    """One card per column: uniqueness class, outlier and symmetry flags, three top values with percentages."""
    unique = F.col("unique_ratio") * 100
    return profile.select(
        "column",
        "count",
        F.when(unique > 90, "primary").when(unique > 20, "high").otherwise("low").alias("uniqueness"),
        (F.abs("skewness") > 3).alias("has_outliers"),
        (F.abs("skewness") < 0.5).alias("is_symmetric"),
        F.transform(
            F.slice(F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")), 1, 3),
            lambda t: F.struct(t["value"].alias("value"), F.round(t["count"] * 100 / F.col("count"), 1).alias("percent")),
        ).alias("top"),
        "health_score",
        "warnings",
    )
