"""Schemas of the tables that are read and written."""

from pyspark.sql import types as T

ANNOTATIONS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("cue_type", T.StringType()),
        T.StructField("multi_cue", T.BooleanType()),
        T.StructField("cue_notes", T.StringType()),
        T.StructField("region", T.StringType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("cue_type", T.StringType()),
        T.StructField("true_country", T.StringType()),
        T.StructField("predicted_country", T.StringType()),
        T.StructField("correct", T.BooleanType()),
        T.StructField("true_region", T.StringType()),
        T.StructField("region_correct", T.BooleanType()),
        T.StructField("model", T.StringType()),
        T.StructField("raw_response", T.StringType()),
    ]
)

COORDS = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("region", T.StringType()),
    ]
)

ANNOTATION_COLUMNS = ANNOTATIONS.fieldNames()
RESULT_COLUMNS = RESULTS.fieldNames()
