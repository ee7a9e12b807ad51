"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T

_QUESTION_FIELDS = [
    ("Id", T.LongType(), False),
    ("Score", T.IntegerType(), True),
    ("ViewCount", T.IntegerType(), True),
    ("Body", T.StringType(), True),
    ("Title", T.StringType(), True),
    ("AnswerCount", T.IntegerType(), True),
    ("CommentCount", T.IntegerType(), True),
    ("AcceptedAnswerId", T.IntegerType(), True),
    ("OwnerUserId", T.IntegerType(), True),
    ("CreationDate", T.TimestampNTZType(), True),
    ("Tags", T.StringType(), True),
    ("ClosedDate", T.TimestampNTZType(), True),
]

QUESTION = T.StructType([T.StructField(*f) for f in _QUESTION_FIELDS])

LABELLED_QUESTION = T.StructType(
    QUESTION.fields
    + [
        T.StructField("label", T.IntegerType(), False),
        T.StructField("length", T.IntegerType(), True),
    ]
)

# Exports written elsewhere keep nullable integers as "35409.0" and prefix an
# unnamed index column, so those columns are read as text or double and cast.
LABELLED_CSV = T.StructType(
    [T.StructField("row_idx", T.LongType())]
    + [
        T.StructField(
            f.name,
            T.DoubleType() if f.name in ("AcceptedAnswerId", "OwnerUserId") else f.dataType,
        )
        for f in LABELLED_QUESTION.fields
    ]
)

TAGS_CSV = T.StructType(
    [T.StructField("row_idx", T.LongType()), T.StructField("TagName", T.StringType())]
)

SCORING_INPUT = T.StructType(
    [T.StructField("Id", T.LongType()), T.StructField("Body", T.StringType())]
)
