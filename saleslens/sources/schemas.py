"""Declared columns and types of the two retail stars."""

from __future__ import annotations

Columns = dict[str, str]

# Bike shop: sales with a product snowflake (product -> brand, category), stores and staff.
SHOP_TABLES: dict[str, Columns] = {
    "fact_sales": {
        "sale_id": "bigint",
        "order_id": "bigint",
        "customer_id": "bigint",
        "product_id": "bigint",
        "store_id": "int",
        "staff_id": "bigint",
        "order_date": "timestamp_ntz",
        "shipped_date": "timestamp_ntz",
        "quantity": "double",
        "list_price": "double",
        "discount": "double",
        "gross_amount": "double",
        "net_amount": "double",
    },
    "dim_date": {
        "date_key": "date",
        "year": "int",
        "quarter": "int",
        "month": "int",
        "month_name": "string",
    },
    "dim_customers": {
        "customer_id": "bigint",
        "first_name": "string",
        "last_name": "string",
        "customer_fullname": "string",
        "customer_phone": "string",
        "customer_email": "string",
        "customer_street": "string",
        "customer_city": "string",
        "customer_state": "string",
        "customer_zipcode": "string",
    },
    "dim_staffs": {
        "staff_id": "bigint",
        "staff_fullname": "string",
        "staff_email": "string",
        "staff_phone": "string",
        "staff_active": "int",
        "store_id": "int",
        "manager_id": "bigint",
    },
    "dim_products": {
        "product_id": "bigint",
        "product_name": "string",
        "brand_id": "int",
        "category_id": "bigint",
        "model_year": "int",
        "list_price": "double",
    },
    "dim_brands": {
        "brand_id": "int",
        "brand_name": "string",
    },
    "dim_categories": {
        "category_id": "bigint",
        "category_name": "string",
    },
    "dim_stores": {
        "store_id": "int",
        "store_name": "string",
        "store_phone": "string",
        "store_email": "string",
        "store_street": "string",
        "store_city": "string",
        "store_state": "string",
        "store_zip_code": "string",
    },
}

# The cube's summary as it is exported.
SUMMARY: Columns = {
    "category_product": "string",
    "city_customer": "string",
    "revenue": "double",
    "profit": "double",
    "quantity": "bigint",
    "sales": "bigint",
}

# General sales warehouse: the product carries its category, employees sell.
WAREHOUSE_TABLES: dict[str, Columns] = {
    "fact_sales": {
        "sale_id": "bigint",
        "order_date_key": "date",
        "customer_key": "bigint",
        "employee_key": "bigint",
        "product_key": "bigint",
        "quantity": "double",
        "gross_amount": "double",
        "net_amount": "double",
        "shipping_fee": "double",
        "taxes": "double",
    },
    "dim_date": SHOP_TABLES["dim_date"],
    "dim_customers": {
        "customer_id": "bigint",
        "company_name": "string",
        "city": "string",
        "country_region": "string",
        "state_province": "string",
    },
    "dim_employees": {
        "employee_key": "bigint",
        "full_name": "string",
        "job_title": "string",
        "city": "string",
        "country_region": "string",
    },
    "dim_products": {
        "product_key": "bigint",
        "product_name": "string",
        "category": "string",
        "standard_cost": "double",
        "list_price": "double",
    },
}
