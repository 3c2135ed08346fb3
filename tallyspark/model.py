"""The transaction row and the other row types."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: txn_seq is the total input order: files by path, lines within them. Every order-dependent operator breaks its ties by it.
TRANSACTION = _struct(
    txn_seq=_L, source_file=_S, date=T.DateType(), amount=MONEY, description=_S, account=_S, institution=_S,
    transaction_id=_S, category=_S, balance=MONEY, account_name=_S, account_type=_S,
)
ACCOUNT = _struct(institution=_S, account_id=_S, account_name=_S, account_type=_S, description=_S)
FILE_STATE = _struct(file_path=_S, file_hash=_S, last_processed=T.TimestampType(), output_file=_S, transaction_count=_L, success=_B, processing_time=_D, file_size=_L, institution=_S, modified=T.TimestampType())
ERROR = _struct(code=_S, severity=_S, category=_S, message=_S, file_path=_S, line=_L, context=T.MapType(_S, _S))

# Columns of the canonical files, in order.
STANDARD_COLUMNS = ["date", "amount", "description", "account", "account_name", "account_type", "institution", "transaction_id", "category", "balance"]
LEGACY_COLUMNS = ["date", "amount", "description", "account", "institution", "transaction_id", "category", "balance"]
REQUIRED_COLUMNS = ["date", "amount", "description", "account", "institution", "transaction_id", "category"]
