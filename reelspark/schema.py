"""Types of the engine's tables. Missing text is '' and never null; only time_reference is nullable."""

from pyspark.sql import types as T

_STRINGS = "path form meta_project scene take tape note ubits tc_rate recorder date time family original_filename error project project_from".split()
_FLAGS = "float_samples circled drop_frame has_bext has_ixml truncated".split()

RECORDING = T.StructType(
    [T.StructField(n, T.StringType()) for n in _STRINGS]
    + [T.StructField(n, T.LongType()) for n in ("size", "frames", "time_reference")]
    + [T.StructField(n, T.IntegerType()) for n in ("sample_rate", "bits", "channels")]
    + [T.StructField("mtime", T.DoubleType())]
    + [T.StructField(n, T.BooleanType()) for n in _FLAGS]
    + [T.StructField("tracks", T.ArrayType(T.StringType()))]
)
CHUNK = T.StructType([T.StructField("id", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType()), T.StructField("truncated", T.BooleanType())])
CUE = T.StructType([T.StructField("frame", T.LongType()), T.StructField("label", T.StringType())])
HEADER = T.StructType([*RECORDING.fields, T.StructField("chunks", T.ArrayType(CHUNK)), T.StructField("cues", T.ArrayType(CUE)), T.StructField("parser_version", T.IntegerType())])
ACTION = "kind string, path string, dst string, reason string, level string, other string"
