"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

CONTRACTS = T.StructType([
    T.StructField("buyer", T.StringType()),
    T.StructField("buyer_type", T.StringType()),
    T.StructField("province", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("municipality", T.StringType()),
    T.StructField("contract_type", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("cpv", T.StringType()),
    T.StructField("supplier", T.StringType()),
    T.StructField("supplier_key", T.StringType()),
    T.StructField("award_date", T.DateType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("file_url", T.StringType()),
])

# Codes are strings: leading zeros carry meaning. Amounts stay text and are cast per query.
BUDGET_LINES = T.StructType([
    T.StructField("idente", T.StringType()),
    T.StructField("tipreig", T.StringType()),
    T.StructField("cdcta", T.StringType()),
    T.StructField("importer", T.StringType()),
    T.StructField("imported", T.StringType()),
    T.StructField("importel", T.StringType()),
])
BUDGET_ENTITIES = T.StructType([
    T.StructField("idente", T.StringType()),
    T.StructField("nombreente", T.StringType()),
    T.StructField("codbdgel", T.StringType()),
])

MANIFEST = T.StructType([
    T.StructField("fecha_utc", T.StringType()),
    T.StructField("fuente", T.StringType()),
    T.StructField("destino", T.StringType()),
    T.StructField("urls_visitadas", T.ArrayType(T.StringType())),
    T.StructField("ultimo_url", T.StringType()),
    T.StructField("descargados", T.ArrayType(T.StringType())),
    T.StructField("omitidos", T.ArrayType(T.StringType())),
    T.StructField("extraidos", T.ArrayType(T.StringType())),
    T.StructField("errores", T.ArrayType(T.StringType())),
])

GROUP_KEYS = ("supplier", "buyer", "contract_type", "fiscal_year")
