"""A small bike shop with the rows the driver's tables lack: missing keys, orphans, empty bins."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from saleslens.sources.schemas import SHOP_TABLES, WAREHOUSE_TABLES


def frame(spark: SparkSession, columns: dict[str, str], rows: list[dict]) -> DataFrame:
    ddl = ", ".join(f"{name} {kind}" for name, kind in columns.items())

    def cell(row: dict, name: str, kind: str):
        value = row.get(name)
        return float(value) if kind == "double" and value is not None else value

    return spark.createDataFrame(
        [tuple(cell(row, name, kind) for name, kind in columns.items()) for row in rows], ddl
    )


def calendar(first: date, days: int) -> list[dict]:
    listed = []
    for offset in range(days):
        day = first + timedelta(days=offset)
        listed.append(
            {
                "date_key": day,
                "year": day.year,
                "quarter": (day.month + 2) // 3,
                "month": day.month,
                "month_name": day.strftime("%B"),
            }
        )
    return listed


def money(number, places="0.01") -> Decimal:
    return Decimal(str(number)).quantize(Decimal(places))


def random_shop_rows(seed: int, sales: int = 400) -> dict[str, list[dict]]:
    pick = random.Random(seed)
    missing = lambda value: None if pick.random() < 0.05 else value
    facts = []
    for sale in range(sales):
        ordered = datetime(2016, 1, 1) + timedelta(hours=pick.randrange(24 * 500))
        discount = money(pick.choice([0, 0.05, 0.07, 0.1, 0.15, 0.2, 0.25, 0.3, 1]))
        price, quantity = money(pick.randrange(100, 90000) / 100), pick.randrange(1, 4)
        gross = price * quantity
        facts.append(
            {
                "sale_id": sale,
                "order_id": missing(pick.randrange(sales // 3)),
                "customer_id": missing(pick.choice([1, 1, 1, pick.randrange(60)])),
                "product_id": missing(pick.randrange(25)),
                "store_id": missing(pick.randrange(5)),
                "staff_id": missing(pick.randrange(14)),
                "order_date": missing(ordered),
                "shipped_date": missing(ordered + timedelta(hours=pick.randrange(-40, 90))),
                "quantity": quantity,
                "list_price": price,
                "discount": missing(discount),
                "gross_amount": gross,
                "net_amount": money(gross * (1 - discount), "0.0001"),
            }
        )
    return {
        "fact_sales": facts,
        "dim_date": calendar(date(2016, 1, 1), 480),
        "dim_customers": [
            {
                "customer_id": key,
                "customer_fullname": f"Customer {key}",
                "customer_city": missing(f"City {key % 7}"),
                "customer_state": missing(f"S{key % 3}"),
            }
            for key in range(50)
        ],
        "dim_staffs": [
            {"staff_id": key, "staff_fullname": f"Staff {key % 11}", "store_id": key % 4}
            for key in range(13)
        ],
        "dim_products": [
            {
                "product_id": key,
                "product_name": f"Product {key % 15}",
                "brand_id": missing(key % 4),
                "category_id": key % 6,
                "model_year": 2016,
                "list_price": money(key * 7 + 10),
            }
            for key in range(22)
        ],
        "dim_brands": [{"brand_id": key, "brand_name": f"Brand {key}"} for key in range(3)],
        "dim_categories": [
            {"category_id": key, "category_name": f"Category {key}"} for key in range(5)
        ],
        "dim_stores": [{"store_id": key, "store_name": f"Store {key}"} for key in range(4)],
    }


def shop(spark: SparkSession, rows: dict[str, list[dict]]) -> dict[str, DataFrame]:
    return {name: frame(spark, kinds, rows.get(name, [])) for name, kinds in SHOP_TABLES.items()}


def warehouse(spark: SparkSession, rows: dict[str, list[dict]]) -> dict[str, DataFrame]:
    return {
        name: frame(spark, kinds, rows.get(name, [])) for name, kinds in WAREHOUSE_TABLES.items()
    }


def values(df: DataFrame) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
