"""Explicit schemas; nothing in the library infers one."""

from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("root_dir", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
    ]
)

PLAN = T.StructType(
    [
        T.StructField("root_dir", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("op_type", T.StringType()),
        T.StructField("dest_path", T.StringType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("rule_idx", T.IntegerType()),
        T.StructField("matcher_idx", T.IntegerType()),
        T.StructField("folder", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("is_regex", T.BooleanType()),
    ]
)

IGNORE_RULES = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

HASH_CACHE = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("sha256", T.StringType()),
    ]
)

# Log as exchanged in JSON lines: one row per transaction, operations nested.
# The field names are fixed values: existing logs carry them.
TXN_JSON = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("TType", T.IntegerType()),
        T.StructField(
            "Operations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("OpType", T.IntegerType()),
                        T.StructField(
                            "File",
                            T.StructType(
                                [
                                    T.StructField("RootDir", T.StringType()),
                                    T.StructField("SourcePath", T.StringType()),
                                    T.StructField("Size", T.LongType()),
                                ]
                            ),
                        ),
                        T.StructField("DestPath", T.StringType()),
                        T.StructField("Size", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("Irreversible", T.BooleanType()),
        T.StructField("txn_seq", T.LongType()),
        T.StructField("first_op", T.LongType()),  # position of the line's first operation; null: 0
    ]
)

# Log as kept by this library: one row per operation, so that a transaction
# over a billion files is a billion rows rather than one row.
TXN_OPS = T.StructType(
    [
        T.StructField("txn_seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("ttype", T.IntegerType()),
        T.StructField("irreversible", T.BooleanType()),
        T.StructField("op_seq", T.LongType()),
        T.StructField("op_type", T.StringType()),
        T.StructField("root_dir", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("dest_path", T.StringType()),
    ]
)

# The numbers that stand for these types in a JSON log.
OP_TYPES = ["move", "rename", "dedupe", "delete", "skip", "undo"]
TXN_ACTION, TXN_UNDO = 0, 1
