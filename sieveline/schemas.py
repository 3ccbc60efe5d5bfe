"""Schemas of the stored tables and the fixed label sets."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("url", "title", "content", "prevention", "scam_type", "source")]
    + [T.StructField(c, T.TimestampType()) for c in ("created_at", "updated_at")]
)
CHUNKS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("document_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("content", T.StringType())]
    + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(c, T.TimestampType()) for c in ("created_at", "updated_at")]
)

#: Fixed values.
KINDS = ("content", "query")
VERDICTS = ("red", "yellow", "green")
STYLES = ("short_question", "long_narration", "verbatim_message", "mixed")
SCAM_TYPES = (
    "ecommerce_scam", "fake_job", "impersonation_authority", "impersonation_service", "investment_fraud", "loan_scam", "other",
    "package_delivery", "prize_gift", "recovery_scam", "romance_scam", "tech_fraud", "vacation_contract",
)
EMBEDDING_WIDTH = 64
