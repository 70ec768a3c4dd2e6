"""A cube stored as a lattice of summed cuboids.

Every measure of the cube's reports adds up, so a report can start from sales already summed by the
columns it shows and the columns it is sliced by. The lattice holds the cube summed by several sets
of axes, each set summed from the smallest stored one that contains it; the fact is read once. A
slice answers each report from the smallest cuboid that knows its columns.

Distinct sales add up as well, as long as a sale lies in one cell. Those that lie in several are
counted in none; they are kept as bitmaps of the finest cells, which a slice combines with OR.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleslens.functions.bitmaps import BITS, WORD, bit_of, word_of
from saleslens.functions.numeric import exact
from saleslens.operators import cube
from saleslens.operators.filters import slice_cube
from saleslens.sources.store import stored

CALENDAR = ("year_date", "quarter_date", "month_date", "month_name_date")
#: Sets of axes that are kept, finest first; each but the first is contained in one before it.
KEPT = (
    ("calendar", "city", "category", "product"),
    ("calendar", "city", "category"),
    ("calendar", "category", "product"),
    ("calendar", "category"),
    ("calendar", "city"),
    ("city", "category"),
    ("calendar",),
)
SALES = "sales"
#: Amounts of the cube in millionths, which each row has as whole numbers of 64 bits.
AMOUNTS = ("revenue", "profit", "order_value")
STREWN = "strewn"


@dataclass(frozen=True)
class Axes:
    """The columns behind the axes of a cube."""

    city: str
    category: str
    product: str = "product_name_product"

    def columns(self, axes: tuple[str, ...]) -> list[str]:
        named = {"calendar": CALENDAR, "city": (self.city,), "category": (self.category,), "product": (self.product,)}
        return [column for axis in axes for column in named[axis]]


WAREHOUSE = Axes("city_customer", "category_product")
SHOP = Axes("customer_city_customer", "category_name_category")


@dataclass(frozen=True)
class Lattice:
    spark: SparkSession
    path: str
    axes: Axes
    #: Rows of each cuboid, under no axes those of the bitmaps.
    sizes: dict[tuple[str, ...], int] = field(default_factory=dict)

    def cuboid(self, axes: tuple[str, ...]) -> DataFrame:
        return self.spark.read.parquet(_place(self.path, axes))

    def smallest(self, *needed: str) -> tuple[str, ...]:
        """The kept axes with the fewest cells that contain the needed ones."""
        fit = [axes for axes in self.sizes if axes and set(needed) <= set(axes)]
        return min(fit, key=lambda axes: (self.sizes[axes], axes))

    def slice(
        self,
        year: int | None = None,
        quarter: int | None = None,
        month: int | None = None,
        city: str | None = None,
        category: str | None = None,
    ) -> Slice:
        return Slice(self, {"year": year, "quarter": quarter, "month": month, "city": city, "category": category})


@dataclass(frozen=True)
class Slice:
    """The reports of the cells that match every slicer that is set."""

    lattice: Lattice
    chosen: dict[str, int | str | None]

    def axes(self, *shown: str) -> tuple[str, ...]:
        """The cuboid that a report with the shown axes is read from."""
        sliced = {
            "calendar" if name in ("year", "quarter", "month") else name
            for name, value in self.chosen.items()
            if value is not None
        }
        return self.lattice.smallest(*shown, *sliced)

    def cells(self, *shown: str) -> DataFrame:
        axes = self.lattice.axes
        found = self.lattice.cuboid(self.axes(*shown))
        return slice_cube(found, **self.chosen, city_column=axes.city, category_column=axes.category)

    def counted(self, *shown: str) -> DataFrame:
        """The cells and, without sums, the numbers of the sales that lie in several of them."""
        cells = self.cells(*shown)
        if not self.lattice.sizes[()]:
            return cells
        axes = self.lattice.axes
        bits = slice_cube(
            self.lattice.cuboid(()), **self.chosen, city_column=axes.city, category_column=axes.category
        )
        words = bits.groupBy(*axes.columns(shown), WORD).agg(F.bit_or(BITS).alias(BITS))
        counted = words.select(*axes.columns(shown), F.bit_count(BITS).cast("bigint").alias(SALES))
        return cells.unionByName(counted, allowMissingColumns=True)

    def kpi(self) -> DataFrame:
        return cube.kpi_of_sums(self.counted(), F.coalesce(F.sum(SALES), F.lit(0)))

    def top_products(self) -> DataFrame:
        return cube.top_revenue(self.cells("product"), self.lattice.axes.product)

    def top_cities(self) -> DataFrame:
        return cube.top_revenue(self.cells("city"), self.lattice.axes.city)

    def categories(self) -> DataFrame:
        return cube.revenue_by(self.cells("category"), self.lattice.axes.category)

    def months(self) -> DataFrame:
        return cube.month_financial(self.cells("calendar"))

    def summary(self) -> DataFrame:
        category, city = self.lattice.axes.category, self.lattice.axes.city
        known = cube.with_known(self.counted("category", "city"), category, city)
        return cube.summary_of_sums(known, category, city, F.sum(SALES))


def _place(path: str, axes: tuple[str, ...]) -> str:
    return f"{path}/cuboid={'-'.join(axes)}"


def build(rows: DataFrame, axes: Axes, path: str, dealt: tuple[str, ...] = ()) -> Lattice:
    """Writes the cuboids of a cube's rows under ``path``; the fact behind ``rows`` is read once.

    ``dealt`` names columns that all rows of a sale have in common and that the rows are dealt by
    already, as a join by them leaves them. Without any, the rows are dealt by the word of their sale.
    """
    finest = axes.columns(KEPT[0])
    words = _with_margins(stored(_narrow(_with_shared(_words(rows, finest, dealt), dealt), finest), compression="zstd"))
    lattice = Lattice(rows.sparkSession, path, axes)

    def keep(kept: tuple[str, ...], cuboid: DataFrame) -> None:
        cuboid.write.parquet(_place(path, kept))
        lattice.sizes[kept] = lattice.cuboid(kept).count()

    keep((), words.filter(F.col(BITS).isNotNull()).select(*finest, WORD, BITS))
    sums = [F.sum(name).alias(name) for name in cube.sums()]
    keep(KEPT[0], words.groupBy(*finest).agg(*sums, F.sum(SALES).alias(SALES)))
    for kept in KEPT[1:]:
        parent = lattice.cuboid(lattice.smallest(*kept))
        keep(kept, parent.groupBy(*axes.columns(kept)).agg(*sums, F.sum(SALES).alias(SALES)))
    return lattice


def _words(rows: DataFrame, finest: list[str], dealt: tuple[str, ...] = ()) -> DataFrame:
    """The finest cells by word, as ``by_word`` gives them, dealt by word or by what the rows are dealt
    by already: what compares the cells of a word needs no shuffle of its own. Amounts are dealt as
    plain integers and margins made afterwards, so that little is moved. Rows without a sale have no
    word; they are dealt by their cell."""
    amounts = [F.col(name).cast("bigint") for name in AMOUNTS]
    narrow = rows.select("sale_id", *dealt, *finest, "quantity", *amounts).withColumn(WORD, word_of("sale_id"))
    if not dealt:
        strewn = F.when(F.col("sale_id").isNull(), F.hash(*finest))
        narrow = narrow.withColumn(STREWN, strewn).repartition(WORD, STREWN)
    facts = cube.with_margin(narrow.withColumns({name: exact(F.col(name)) for name in AMOUNTS}))
    sums = [total.alias(name) for name, total in cube.sums().items()]
    return facts.groupBy(*finest, WORD, *(dealt or (STREWN,))).agg(F.bit_or(bit_of("sale_id")).alias(BITS), *sums)


def _with_shared(words: DataFrame, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Words with the bits that other cells have too: those that a cell shares with any before it in
    its word, put together over the word."""
    by = dealt or (STREWN,)
    word = Window.partitionBy(*by, WORD)
    before = F.bit_or(BITS).over(word.orderBy(BITS).rowsBetween(Window.unboundedPreceding, -1))
    met = words.withColumn("met", F.col(BITS).bitwiseAND(F.coalesce(before, F.lit(0).cast("bigint"))))
    return met.withColumn("shared", F.col(BITS).bitwiseAND(F.bit_or("met").over(word))).drop("met", *by)


def _narrow(words: DataFrame, finest: list[str]) -> DataFrame:
    """What the cuboids are made of: sums and numbers of the sales in one cell; the word and its
    bits only where a cell shares some, the margin only where it is of several rows."""
    alone = F.coalesce(F.bit_count(F.col(BITS).bitwiseXOR(F.col("shared"))), F.lit(0)).cast("bigint")
    shares = F.col("shared") != 0
    kept = words.withColumns({
        SALES: alone,
        WORD: F.when(shares, F.col(WORD)),
        BITS: F.when(shares, F.col("shared")),
        "margin": F.when(F.col("margins") > 1, F.col("margin")),
    })
    return kept.select(*finest, *cube.sums(), SALES, WORD, BITS)


def _with_margins(words: DataFrame) -> DataFrame:
    """Words as ``_narrow`` leaves them, with the margins of single rows, which their sums give."""
    single = F.when(F.col("margins") == 1, F.col("profit_margin")).otherwise(F.col("margin"))
    return cube.with_margin(words).withColumn("margin", single).drop("profit_margin")


def opened(spark: SparkSession, axes: Axes, path: str) -> Lattice:
    """A lattice built before."""
    lattice = Lattice(spark, path, axes)
    lattice.sizes.update({kept: lattice.cuboid(kept).count() for kept in ((), *KEPT)})
    return lattice
