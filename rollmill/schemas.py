"""Fixed schemas of the tables that are read and written."""

from __future__ import annotations

from pyspark.sql import types as T

QUESTION = T.StructType().add("question", "string").add("answer", "string")
MATH = T.StructType().add("problem", "string").add("answer", "string").add("level", "integer")
CODE_TASK = (
    T.StructType()
    .add("text", "string")
    .add("test_list", T.ArrayType(T.StringType()))
    .add("test_setup_code", "string")
)
QA_JSON = T.StructType().add("question", "string").add("answer_detail", "string")
META = T.StructType().add("plen", "integer").add("rmean", "double").add("rvar", "double")
_ROWS = T.ArrayType(T.ArrayType(T.DoubleType()))
_ROW = T.ArrayType(T.DoubleType())
BATCH = (
    T.StructType()
    .add("batch_id", "long")
    .add("plen", "integer")
    .add("rmean", "double")
    .add("rvar", "double")
    .add("num_items_in_batch", "double")
    .add("inputs", T.ArrayType(T.ArrayType(T.IntegerType())))
    .add("rewards", _ROW)
    .add("refs", _ROWS)
    .add("gen_logps", _ROWS)
    .add("a_gen_logps", _ROWS)
    .add("advantages", _ROWS)
    .add("acc_scores", _ROW)
    .add("format_scores", _ROW)
)
GENERATION = (
    T.StructType()
    .add("question", T.StructType().add("Q", "string").add("A", "string"))
    .add("answer", "string")
    .add("acc_score", "double")
    .add("format_score", "double")
)
UPLOAD = (
    T.StructType()
    .add("q", "string")
    .add("answer", "string")
    .add("reward", "double")
    .add("arrival", "long")
    .add("arrival_ts", "timestamp")
)
CURSOR = T.StructType().add("value", "long").add("step", "long")
