"""Records from JSON files, and made-up records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ("Ada", "Ben", "Cleo", "Dev", "Esa", "Fay", "Gus", "Hana")
LAST = ("Ashe", "Brook", "Crane", "Dale", "Elm", "Frost", "Grove", "Hale")
STREETS, CITIES, COUNTRIES, INDUSTRIES = ("High Street", "Mill Lane", "Park Road"), ("Northport", "Easton", "Southby"), ("Arden", "Borea", "Cindra"), ("mining", "software", "farming", "retail")


def _json_text(own: Column) -> Column:
    """A JSON value as text: a string's own, others as JSON; null for JSON's null."""
    kind = F.schema_of_variant(own)
    return F.when(kind == "STRING", F.try_variant_get(own, "$", "string")).when(kind != "VOID", F.to_json(own))


def json_records(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """key and value as JSON text from files of one array each, or of a line each; items with neither are left out.

    An array's items are read one after the other, a file by a task, so no text of a whole file is held; files of lines are split as well.
    """
    if array:
        items = spark.read.schema("key variant, value variant").option("multiLine", "true").json(path)
        rows = items.select(_json_text(F.col("key")).alias("key"), _json_text(F.col("value")).alias("value"))
    else:
        rows = spark.read.text(path).select(F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.value").alias("value"))
    return rows.where("key is not null or value is not null")


def pick(values: tuple[str, ...], row: Column, seed: int) -> Column:
    return F.element_at(F.lit(list(values)), (F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(len(values))) + 1).cast("int"))


def number(row: Column, seed: int, low: float, high: float) -> Column:
    """A number of [low, high) from the row's id: the same in every run and for every partitioning."""
    return F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(1_000_003)) / 1_000_003 * (high - low) + low


def customers(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Made-up customers."""
    row = F.col("id")
    first, last = pick(FIRST, row, seed + 1), pick(LAST, row, seed + 2)
    home = F.struct(F.floor(number(row, seed + 3, 1, 200)).cast("string").alias("building_number"), pick(STREETS, row, seed + 4).alias("street_name"), pick(CITIES, row, seed + 5).alias("city"), F.format_string("%05d", F.floor(number(row, seed + 6, 0, 99999))).alias("post_code"), pick(COUNTRIES, row, seed + 7).alias("country_name"))
    return spark.range(n).select(F.lower(F.concat(first, F.lit("."), last, row.cast("string"), F.lit("@example.com"))).alias("email_address"), F.concat_ws(" ", first, last).alias("full_name"), home.alias("home"), F.array(pick(INDUSTRIES, row, seed + 8)).alias("industry"))


def trips(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Made-up taxi trips."""
    row = F.col("id")
    return spark.range(n).select((F.pmod(row, F.lit(2)) + 1).alias("vendor_id"), row.alias("trip_id"), F.round(number(row, seed + 1, 0, 20), 2).alias("trip_distance"), F.round(number(row, seed + 2, 2, 90), 2).alias("fare_amount"), F.pmod(F.xxhash64(row, F.lit(seed + 3)), F.lit(2)).cast("int").alias("store_and_fwd"))
