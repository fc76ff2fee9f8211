"""What an order-line pipeline promises, as data: schemas, reasons in rule order, limits, alerts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Field of an order line: wire type, required.
ORDER_LINE = {
    "order_id": ("string", True),
    "line_no": ("int", False),
    "customer_id": ("string", True),
    "order_ts": ("long", True),
    "order_ts_iso": ("string", False),
    "status": ("string", False),
    "channel": ("string", False),
    "payment_type": ("string", False),
    "currency": ("string", False),
    "sku": ("string", True),
    "qty": ("int", True),
    "unit_price": ("double", True),
    "line_total": ("double", False),
}
#: Raw reads carry every field as text; typing comes after validation.
RAW_LINE = T.StructType([T.StructField(name, T.StringType()) for name in ORDER_LINE])

#: Order in which a missing field is named.
REQUIRED = ("order_id", "sku", "customer_id", "qty", "unit_price", "order_ts")

QUARANTINE = (
    "reason",
    "detail",
    "batch_id",
    "source_file",
    "order_id",
    "line_no",
    "customer_id",
    "order_ts",
    "sku",
    "qty",
    "unit_price",
    "line_total",
    "currency",
    "status",
    "channel",
)
ITEM_KEYS = ("order_id", "line_no")
ITEM_COLUMNS = ("order_id", "line_no", "sku", "qty", "unit_price", "line_total", "category", "catalog_price")

REASONS = (
    "NULL_CRITICAL",
    "PARSE_ERROR",
    "RANGE_VIOLATION",
    "UNKNOWN_SKU",
    "UNKNOWN_CUSTOMER",
    "BAD_TIMESTAMP",
    "BAD_CURRENCY",
    "DUP_KEY",
    "READER_FAILURE",
)


#: The error codes of a data flow that have a text, and the texts.
DATA_FLOW_ERRORS = {
    -939524094: "The total number of outputs and error outputs is incorrect.",
    -939524093: "Cannot retrieve output with the given index.",
    -939524091: "The number of error outputs is incorrect.",
    -939524090: "Incorrect validation status value. It must be one of the values found in the DTSValidationStatus enumeration.",
    -939524089: "The input has no synchronous output.",
    -939524088: "The input has no synchronous error output.",
    -939524087: "The HowToProcessInput value is not valid. It must be one of the values from the HowToProcessInput enumeration.",
    -939524086: "Failed to get information for the given row/column from the buffer.",
    -939524085: "Failed to set information for the given row/column into the buffer.",
    -939524084: "The property is not valid.",
    -939524083: "The property was not found.",
    -939524080: "Error assigning a value to a read-only property.",
    -939524079: "The component does not allow the insertion of output columns.",
    -939524078: "The output columns' metadata does not match the associated input columns' metadata. The output columns' metadata will be updated.",
    -939524077: "There are input columns that do not have associated output columns. The output columns will be added.",
    -939524076: "There are output columns that do not have associated input columns. The output columns will be removed.",
    -939524075: "The output columns' metadata does not match the associated input columns' metadata. The input columns will be unmapped.",
    -939524074: "There are input columns that do not have associated output columns. The input columns will be unmapped.",
    -939524073: "An input column associated with an output column is already associated with another input column on the same input.",
    -939524072: "The component does not allow the insertion of external metadata columns.",
}


@dataclass(frozen=True)
class Limits:
    qty: tuple[int, int] = (1, 999)
    price: tuple[str, str] = ("0.01", "9999.99")
    window_days: int = 365
    currencies: tuple[str, ...] = ("INR", "USD", "EUR", "GBP")
    total_tolerance: str = "0.02"


@dataclass(frozen=True)
class Alert:
    name: str
    severity: str
    metric: str
    above: str


@dataclass(frozen=True)
class Contract:
    limits: Limits = field(default_factory=Limits)
    alerts: tuple[Alert, ...] = (
        Alert("HIGH_VALUE", "WARN", "line_total", "500"),
        Alert("SUSPICIOUS_QTY", "CRITICAL", "qty", "50"),
    )
