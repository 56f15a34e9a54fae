"""Schemas of the index's tables."""

from pyspark.sql import types as T

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content_digest", T.StringType()), T.StructField("mtime", T.DoubleType()), T.StructField("size", T.LongType()), T.StructField("status", T.StringType())])
CHUNKS = T.StructType(
    [T.StructField("content_digest", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("digest", T.StringType()), T.StructField("text", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("page", T.IntegerType())]
)
POSTINGS = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("content_digest", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]
)
LENGTHS = T.StructType([T.StructField("content_digest", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("length", T.IntegerType())])
VECTORS = T.StructType([T.StructField("content_digest", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
