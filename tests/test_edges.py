"""Hand-written rows with literal expectations, for what the driver's tables do not contain."""

from datetime import date, datetime
from decimal import Decimal
from math import inf

import pytest
from pyspark.sql import functions as F

from saleslens.functions import measures
from saleslens.functions import display
from saleslens.functions.bins import LEFT_CLOSED, RIGHT_CLOSED
from saleslens.functions.measures import with_line_count, with_net_sales
from saleslens.functions.numeric import half_even_cents, margin_percent, row_amount
from saleslens.functions.periods import (
    with_period_columns,
    with_ship_lag,
    with_time_hierarchy,
)
from saleslens.operators import cube, customers, options, quality, sales, shipping, staff
from saleslens.operators.enrich import enrich, with_staff_names
from saleslens.operators.filters import SalesFilter, slice_cube
from saleslens.plans import pages
from shop import frame, shop, values, warehouse

SALE = {
    "quantity": 2,
    "list_price": Decimal("10.00"),
    "discount": Decimal("0.10"),
    "order_date": datetime(2016, 1, 15),
}


def star(spark, facts, **dims):
    rows = {
        "fact_sales": [{**SALE, **fact} for fact in facts],
        "dim_products": [
            {"product_id": 1, "product_name": "Road", "brand_id": 1, "category_id": 1},
            {"product_id": 2, "product_name": "Trail", "brand_id": 1, "category_id": 2},
        ],
        "dim_brands": [{"brand_id": 1, "brand_name": "Ace"}],
        "dim_categories": [
            {"category_id": 1, "category_name": "Bikes"},
            {"category_id": 2, "category_name": "Parts"},
        ],
        "dim_stores": [{"store_id": 1, "store_name": "North"}],
        "dim_customers": [
            {"customer_id": 1, "customer_city": "Rome", "customer_state": "NY"},
            {"customer_id": 2, "customer_city": "Troy", "customer_state": "NY"},
        ],
        "dim_staffs": [
            {"staff_id": 1, "staff_fullname": "Ann"},
            {"staff_id": 2, "staff_fullname": "Bo"},
            {"staff_id": 3, "staff_fullname": "Cy"},
        ],
        **dims,
    }
    return shop(spark, rows)


def test_missing_and_orphan_keys_leave_groups_but_stay_in_the_total(spark):
    tables = star(
        spark,
        [
            {"order_id": 1, "customer_id": 1, "product_id": 1, "store_id": 1},
            {"order_id": 2, "customer_id": 2, "product_id": 9, "store_id": None},
            {"order_id": None, "customer_id": None, "product_id": None, "store_id": 1},
        ],
    )
    frame_ = pages.sales_frame(tables)
    assert values(sales.sales_kpi(frame_)) == [(54.0, 2, 2, 27.0)]
    assert values(staff.performance(frame_, "store_name")) == [("North", 36.0, 1)]
    assert values(sales.top_products(frame_, "net_sales")) == [("Road", 18.0)]
    assert values(sales.brand_category_sales(frame_)) == [("Ace", "Bikes", 18.0)]


def test_a_repeated_dimension_key_multiplies_its_sales_and_is_reported(spark):
    brands = [{"brand_id": 1, "brand_name": "Ace"}, {"brand_id": 1, "brand_name": "Ace II"}]
    tables = star(spark, [{"order_id": 1, "product_id": 1}], dim_brands=brands)
    assert values(sales.sales_kpi(pages.sales_frame(tables))) == [(36.0, 1, 0, 36.0)]
    assert values(quality.repeated_keys(tables["dim_brands"], "brand_id")) == [(1, 2)]
    assert values(quality.repeated_keys(tables["dim_stores"], "store_id")) == []


def test_an_empty_slice_gives_zeros(spark):
    tables = star(spark, [{"order_id": 1, "customer_id": 1, "product_id": 1, "store_id": 1}])
    empty = pages.sales_frame(tables, SalesFilter(stores=("Nowhere",)))
    assert values(sales.sales_kpi(empty)) == [(0.0, 0, 0, 0.0)]
    assert values(customers.repeat_kpi(customers.rows_per_customer(empty))) == [(0, 0, 0.0)]
    assert values(sales.sales_trend(empty, "month")) == []
    assert values(staff.staff_kpi(empty, tables["dim_staffs"])) == [(3, 0.0)]
    assert [row[2:] for row in values(sales.discount_effect(empty, LEFT_CLOSED))] == [(0, 0.0)] * 6
    none = cube.shop_cube(tables["fact_sales"], tables).filter(F.lit(False))
    assert values(cube.cube_kpi(none)) == [(0.0, 0.0, 0, 0.0, 0.0, 0)]


def test_a_sale_that_never_shipped_is_late_but_has_no_days(spark):
    ordered = datetime(2016, 3, 10)
    shipped = [datetime(2016, 3, 9), None, datetime(2016, 3, 14)]
    facts = [{"store_id": 1, "order_date": ordered, "shipped_date": day} for day in shipped]
    lags = with_ship_lag(pages.sales_frame(star(spark, facts)))
    assert values(lags.select("order_to_ship_days", "on_time")) == [
        (-1, True),
        (None, False),
        (4, False),
    ]
    by_store = shipping.ship_performance(shipping.shipping_totals(lags, "store_name"))
    assert values(by_store) == [("North", 1.5, 0.333333)]


def test_days_to_ship_round_down_in_any_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [
        {"order_date": datetime(2020, 1, 2, 12), "shipped_date": datetime(2020, 1, 1)},
        {"order_date": datetime(2020, 1, 1, 12), "shipped_date": datetime(2020, 1, 3, 6)},
        # Clocks change in New York in between.
        {"order_date": datetime(2020, 3, 7, 12), "shipped_date": datetime(2020, 3, 9, 12)},
    ]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = frame(spark, {"order_date": "timestamp_ntz", "shipped_date": "timestamp_ntz"}, rows)
        days = values(with_ship_lag(df).select("order_to_ship_days"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert days == [(-2,), (1,), (2,)]


def test_margin_keeps_infinities_and_zeroes_the_undefined(spark):
    rows = [(0.0, 1.0), (0.0, -1.0), (0.0, 0.0), (None, None), (8.0, 2.0)]
    df = spark.createDataFrame(rows, "net double, profit double")
    got = values(df.select(margin_percent(F.col("profit"), F.col("net"))))
    assert got == [(inf,), (-inf,), (0.0,), (0.0,), (25.0,)]


def test_discount_bins_at_their_edges(spark):
    edges = ["-0.01", "0", "0.05", "0.10", "0.15", "0.20", "0.25", "0.30", "1.00", None]
    df = spark.createDataFrame([(e and Decimal(e),) for e in edges], "discount decimal(4,2)")
    both = df.select(
        LEFT_CLOSED.ordinal(F.col("discount")), RIGHT_CLOSED.ordinal(F.col("discount"))
    )
    assert values(both) == [
        (None, None),
        (0, 0),
        (1, 0),
        (2, 1),
        (3, 2),
        (4, 3),
        (5, None),
        (5, None),
        (None, None),
        (None, None),
    ]


def test_empty_bins_show_and_unbinned_sales_do_not(spark):
    facts = [{"discount": Decimal(d)} for d in ("0.05", "0.05", "0.30")]
    frame_ = pages.sales_frame(star(spark, facts), dims=())
    right = sorted(values(sales.discount_effect(frame_, RIGHT_CLOSED)))
    assert right == [
        (0, "0-5%", 4, 38.0),
        (1, "5-10%", 0, 0.0),
        (2, "10-15%", 0, 0.0),
        (3, "15-20%", 0, 0.0),
    ]
    left = sorted(values(sales.discount_effect(frame_, LEFT_CLOSED)))
    assert [(row[1], row[2]) for row in left if row[2]] == [("5-10%", 4), ("25%+", 2)]


def test_equal_measures_rank_by_name(spark):
    facts = [{"product_id": p, "staff_id": s, "order_id": p} for p, s in ((2, 2), (1, 1))]
    tables = star(spark, facts)
    frame_ = pages.sales_frame(tables)
    assert values(sales.top_products(frame_, "quantity")) == [("Road", 2), ("Trail", 2)]
    by_name = staff.performance(with_staff_names(frame_, tables["dim_staffs"]), "staff_fullname")
    assert values(staff.best_staff(by_name)) == [("Ann", 18.0)]


@pytest.mark.parametrize(
    "months, expected",
    [
        ([], (None, None)),
        ([("2016-01", 1)], (None, None)),
        ([("2016-01", 4), ("2016-02", 1), ("2016-03", 3)], (2.0, 0.0)),
        ([("2016-01", 0), ("2016-02", 3)], (None, 0.0)),
    ],
)
def test_growth_of_short_trends(spark, months, expected):
    facts = [
        {"order_id": n, "quantity": q, "order_date": datetime.fromisoformat(f"{m}-05")}
        for n, (m, q) in enumerate(months)
    ]
    frame_ = pages.sales_frame(star(spark, facts), dims=())
    trend = sales.sales_trend(frame_, "month")
    assert values(sales.period_growth(trend, "month")) == [expected]


def test_cents_round_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.375,)], "x double")
    assert values(df.select(half_even_cents(F.col("x")))) == [(0.12,), (2.68,), (0.38,)]


def test_period_keys_and_missing_dates(spark):
    df = frame(
        spark, {"order_date": "timestamp_ntz"}, [{"order_date": datetime(2016, 2, 3, 23)}, {}]
    )
    got = values(with_period_columns(df).select("year", "quarter", "month", "date"))
    assert got == [(2016, "2016Q1", "2016-02", date(2016, 2, 3)), (None, None, None, None)]
    days = spark.createDataFrame(
        [(2016, 1, 2), (None, None, None)], "year_date int, quarter_date int, month_date int"
    )
    keys = values(with_time_hierarchy(days).select("year_month", "year_quarter"))
    assert keys == [("2016-02", "2016-Q1"), (None, None)]


def test_range_includes_both_days_whole(spark):
    stamps = ["2016-01-31T23:59:59", "2016-02-01T00:00:00", "2016-02-29T23:59:59", "2016-03-01"]
    facts = [
        {"sale_id": n, "order_date": datetime.fromisoformat(s)} for n, s in enumerate(stamps)
    ] + [{"sale_id": 9, "order_date": None}]
    choice = SalesFilter(date_from=date(2016, 2, 1), date_to=date(2016, 2, 29))
    kept = pages.sales_frame(star(spark, facts), choice, dims=())
    assert values(kept.select("sale_id")) == [(1,), (2,)]
    assert pages.sales_frame(star(spark, facts), dims=()).count() == 4


def test_sales_without_a_date_leave_the_pages(spark):
    facts = [
        {"order_id": 1, "customer_id": 1, "product_id": 1, "store_id": 1},
        {"order_id": 2, "customer_id": 2, "product_id": 2, "store_id": 1, "order_date": None},
    ]
    tables = star(spark, facts)
    page = pages.sales_page(pages.sales_frame(tables))
    assert values(page["kpi"]) == [(18.0, 1, 1, 18.0)]
    assert values(page["top_quantity"]) == [("Road", 2)]


def test_date_limits_do_not_follow_the_choice(spark):
    stamps = [datetime(2016, 1, 1), datetime(2016, 3, 5, 12), datetime(2016, 9, 9)]
    tables = star(spark, [{"sale_id": n, "order_date": s} for n, s in enumerate(stamps)])
    choice = SalesFilter(date_from=date(2016, 3, 1), date_to=date(2016, 3, 31))
    page = pages.sales_page(pages.sales_frame(tables, choice), fact=tables["fact_sales"])
    assert values(page["dates"]) == [(date(2016, 1, 1), date(2016, 9, 9))]


def test_numbers_rank_by_size(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (2, None)], "n int, t string")
    shown = values(options.filter_options((df, {"month": "n", "name": "t"})))
    assert sorted(shown) == [("month", "10", 3), ("month", "2", 1), ("month", "9", 2), ("name", "a", 1), ("name", "b", 2)]


def test_two_meanings_of_a_repeat_customer(spark):
    facts = [
        {"customer_id": 1, "order_id": 1},
        {"customer_id": 1, "order_id": 1},
        {"customer_id": 2, "order_id": 2},
        {"customer_id": 2, "order_id": 3},
    ]
    tables = star(spark, facts)
    page = pages.customer_page(pages.sales_frame(tables), tables["dim_customers"])
    assert values(page["kpi"]) == [(2, 2, 1.0)]
    assert values(page["repeat_by_state"]) == [("NY", 2, 4, 1.0, 2, 0)]
    assert values(page["repeat_by_state_orders"]) == [("NY", 0.5, 2)]
    assert values(page["top_repeat_cities_orders"]) == []
    assert values(page["threshold"]) == [(2, 2)]
    assert values(page["top_repeat_states_orders"]) == [("NY", 0.5, 2)]


def test_sales_without_an_order_count_as_rows_but_not_as_orders(spark):
    facts = [{"customer_id": 1, "order_id": None}, {"customer_id": 1, "order_id": 1}]
    tables = star(spark, facts)
    page = pages.customer_page(pages.sales_frame(tables), tables["dim_customers"])
    assert values(page["kpi"]) == [(1, 1, 1.0)]
    assert values(page["repeat_by_state"]) == [("NY", 1, 1, 0.0, 0, 1)]


def test_staff_mean_is_over_those_who_sold(spark):
    tables = star(spark, [{"staff_id": 1}, {"staff_id": 1}, {"staff_id": 2}, {"staff_id": None}])
    frame_ = pages.sales_frame(tables, dims=())
    assert values(staff.staff_kpi(frame_, tables["dim_staffs"])) == [(3, 27.0)]
    assert values(staff.staff_kpi(frame_, tables["dim_staffs"].limit(0))) == [(0, 0.0)]


def test_shares_and_namesakes(spark):
    twins = [{"staff_id": 1, "staff_fullname": "Ann"}, {"staff_id": 2, "staff_fullname": "Ann"}]
    facts = [{"staff_id": s, "order_id": o} for s, o in ((1, 1), (2, 1), (2, 2))]
    tables = star(spark, facts, dim_staffs=twins)
    page = pages.employee_page(pages.sales_frame(tables), tables["dim_staffs"])
    assert values(page["top_staff_sales"]) == [("Ann", 54.0, 2)]
    assert values(page["staff_sales_share"]) == [("Ann", 54.0, 1.0)]


def test_cube_of_the_warehouse(spark):
    tables = warehouse(
        spark,
        {
            "fact_sales": [
                {
                    "sale_id": 1,
                    "order_date_key": date(2016, 2, 3),
                    "customer_key": 1,
                    "employee_key": 1,
                    "product_key": 1,
                    "quantity": 2,
                    "gross_amount": Decimal(20),
                    "net_amount": Decimal(18),
                    "taxes": Decimal("1.5"),
                },
                {
                    "sale_id": 2,
                    "order_date_key": date(2016, 5, 1),
                    "product_key": 2,
                    "quantity": 1,
                    "gross_amount": Decimal(5),
                    "net_amount": Decimal(5),
                    "shipping_fee": Decimal(2),
                },
            ],
            "dim_date": [
                {
                    "date_key": date(2016, 2, 3),
                    "year": 2016,
                    "quarter": 1,
                    "month": 2,
                    "month_name": "February",
                }
            ],
            "dim_customers": [{"customer_id": 1, "company_name": "Acme", "city": "Rome"}],
            "dim_employees": [{"employee_key": 1, "full_name": "Ann", "city": "Oslo"}],
            "dim_products": [
                {
                    "product_key": 1,
                    "product_name": "Tea",
                    "category": "Drinks",
                    "standard_cost": Decimal(4),
                },
                {"product_key": 2, "product_name": "Jam", "category": "Food"},
            ],
        },
    )
    whole = cube.warehouse_cube(tables["fact_sales"], tables)
    picked = whole.orderBy("sale_id").select(
        "city_customer",
        "city_employee",
        "year_quarter",
        row_amount(F.col("profit")),
        "profit_margin",
        row_amount(F.col("order_value")),
    )
    assert values(picked) == [
        ("Rome", "Oslo", "2016-Q1", 10.0, 10 / 18 * 100, 19.5),
        (None, None, None, 5.0, 100.0, 7.0),
    ]
    page = pages.warehouse_page(whole)
    assert values(page["kpi"]) == [(23.0, 15.0, 2, 13.25, 77.777778, 3)]
    assert values(page["top_cities"]) == [("Rome", 18.0)]
    assert values(page["months"]) == [("February", 18.0, 10.0)]
    assert values(page["summary"]) == [("Drinks", "Rome", 18.0, 10.0, 2, 1)]
    assert sorted(values(page["categories"])) == [("Drinks", 18.0), ("Food", 5.0)]
    assert slice_cube(whole, year=2016, month=2, city="Rome", category="Drinks").count() == 1
    assert slice_cube(whole, quarter=2).count() == 0
    assert slice_cube(whole).count() == 2


def test_display_text(spark):
    df = spark.createDataFrame(
        [(1234.5, 0.1235, 1234567, date(2016, 2, 3)), (None, None, None, None)],
        "x double, p double, n bigint, d date",
    )
    got = df.select(
        display.currency(F.col("x"), "฿"),
        display.currency(F.col("x")),
        display.percent(F.col("p")),
        display.whole(F.col("n")),
        display.day(F.col("d")),
    )
    assert values(got) == [
        ("฿1,234", "$1,234", "12.3%", "1,234,567", "03 Feb 2016"),
        ("-", "-", "-", "-", "-"),
    ]


def test_choices_and_preview(spark):
    tables = star(spark, [{"sale_id": n} for n in range(9, 0, -1)])
    assert sorted(values(pages.choices(tables))) == [
        ("brand", "Ace", 1),
        ("category", "Bikes", 1),
        ("category", "Parts", 2),
        ("store", "North", 1),
    ]
    shown = options.table_preview(
        {"fact_sales": tables["fact_sales"].select("sale_id", "store_id")}
    )
    assert [row[1] for row in values(shown)] == [f"{n}|-" for n in range(1, 6)]


def test_unknown_choices_are_refused(spark):
    tables = star(spark, [])
    with pytest.raises(ValueError, match="planet"):
        enrich(with_net_sales(with_line_count(tables["fact_sales"])), tables, ("planet",))
    with pytest.raises(ValueError, match="period"):
        pages.sales_page(pages.sales_frame(tables), "week")


def test_fractions_and_large_sales_agree_on_both_paths(spark):
    rows = spark.createDataFrame(
        [(1, 2.5, 0.125, 10.005), (1, 3.0, 0.0, 10.005), (2, 1.0, 0.0, 1e12)],
        "product_id long, quantity double, discount double, list_price double",
    )
    prices = rows.select("product_id", "list_price").distinct()
    by_row = measures.to_grain(measures.with_net_sales(rows), "product_id")
    units = measures.with_discounted_units(rows).select("product_id", "discounted_units")
    summed = measures.to_grain(units, "product_id").join(prices, "product_id")
    for df in (by_row, measures.with_priced_units(summed)):
        net = {row.product_id: int(row.net_sales) for row in df.collect()}
        assert abs(net[1] - 51_900_938) <= 1
        assert net[2] == 10**18
