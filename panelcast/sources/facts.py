"""Raw tables and the transactional facts the period tables are built from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_text, _whole, _real = T.StringType(), T.IntegerType(), T.DoubleType()
_money = T.DecimalType(18, 2)

# The columns of the raw tables.  Timestamps stay text until
# ``coerce_timestamps`` has parsed them, so that a bad value becomes null
# instead of failing the read.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "orders": _schema(
        order_id=_text,
        customer_id=_text,
        order_status=_text,
        order_purchase_timestamp=_text,
        order_approved_at=_text,
        order_delivered_carrier_date=_text,
        order_delivered_customer_date=_text,
        order_estimated_delivery_date=_text,
    ),
    "payments": _schema(
        order_id=_text,
        payment_sequential=_whole,
        payment_type=_text,
        payment_installments=_whole,
        payment_value=_money,
    ),
    "items": _schema(
        order_id=_text,
        order_item_id=_whole,
        product_id=_text,
        seller_id=_text,
        shipping_limit_date=_text,
        price=_money,
        freight_value=_money,
    ),
    "customers": _schema(
        customer_id=_text,
        customer_unique_id=_text,
        customer_zip_code_prefix=_text,
        customer_city=_text,
        customer_state=_text,
    ),
    "products": _schema(
        product_id=_text,
        product_category_name=_text,
        product_name_lenght=_real,
        product_description_lenght=_real,
        product_photos_qty=_real,
        product_weight_g=_real,
        product_length_cm=_real,
        product_height_cm=_real,
        product_width_cm=_real,
    ),
    "sellers": _schema(
        seller_id=_text,
        seller_zip_code_prefix=_text,
        seller_city=_text,
        seller_state=_text,
    ),
    "reviews": _schema(
        review_id=_text,
        order_id=_text,
        review_score=_whole,
        review_comment_title=_text,
        review_comment_message=_text,
        review_creation_date=_text,
        review_answer_timestamp=_text,
    ),
    "translation": _schema(
        product_category_name=_text,
        product_category_name_english=_text,
    ),
    "geolocation": _schema(
        geolocation_zip_code_prefix=_text,
        geolocation_lat=_real,
        geolocation_lng=_real,
        geolocation_city=_text,
        geolocation_state=_text,
    ),
}


def read_raw_csv(
    spark: SparkSession, folder: str, files: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """The raw tables as CSV with a header line; ``files`` maps table name to file name.

    Only reviews hold text with line ends; the other files can be split between tasks.
    """
    files = files or {name: f"{name}.csv" for name in RAW_SCHEMAS}
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return {
        name: reader.schema(RAW_SCHEMAS[name]).csv(f"{folder}/{file}", multiLine=name == "reviews")
        for name, file in files.items()
    }


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Named parquet tables of one folder."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table of a catalog."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Facts:
    """The six tables the engine reads.

    ``lines`` may name one wide table that carries payments, reviews and items
    together (columns of all three, null where a row has none); the order-level
    measures then need one scan and one shuffle in place of three.
    Extra columns of ``customers`` or, with ``lines``, of ``products`` can serve as
    series keys.
    """

    orders: DataFrame
    payments: DataFrame
    reviews: DataFrame
    items: DataFrame
    customers: DataFrame
    products: DataFrame
    lines: DataFrame | None = None

    @classmethod
    def from_raw(cls, tables: dict[str, DataFrame]) -> "Facts":
        return cls(
            **{n: tables[n] for n in ("orders", "payments", "reviews", "items", "customers", "products")}
        )

    def customer_keys(self, series_keys: list[str]) -> list[str]:
        return [k for k in series_keys if k in self.customers.columns]

    def product_keys(self, series_keys: list[str]) -> list[str]:
        found = [k for k in series_keys if k in self.products.columns]
        if found and self.lines is None:
            raise ValueError("series by product need line-level values (Facts.lines)")
        unknown = set(series_keys) - set(found) - set(self.customer_keys(series_keys))
        if unknown:
            raise ValueError(f"unknown series keys: {sorted(unknown)}")
        return found
