"""Postal, district and municipality enrichment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.ordering import exact_quantiles, latest_before
from ebbtide.functions.text import plain_name

EARTH_RADIUS_KM = 6371.0

# Reference cities (latitude, longitude).
CITIES = {
    "sofia": (42.6977, 23.3219),
    "plovdiv": (42.1354, 24.7453),
    "varna": (43.2141, 27.9147),
    "burgas": (42.5048, 27.4626),
}

# Other spellings of place names.
PLACE_ALIASES = {
    "khaskovo": "haskovo", "kurdzhali": "kardzhali", "kurdjali": "kardzhali", "kjustendil": "kyustendil",
    "turgovishhe": "targovishte", "vraca": "vratsa", "jambol": "yambol", "sofija": "sofia",
    "sofija stolica": "sofia stolitsa", "smoljan": "smolyan", "peshhera": "peshtera",
    "panagjurishhe": "panagyurishte", "purvomaj": "parvomay", "khisarja": "hisarya",
    "veliko turnovo": "veliko tarnovo", "aksakovo": "aksakovo", "vulchi dol": "valchi dol",
    "vulchedrum": "valchedram", "shhipsko": "shipsko", "marica": "maritsa", "kazanluk": "kazanlak",
    "kharmanli": "harmanli", "stambolijski": "stamboliyski", "ljubimec": "lyubimets",
    "suedinenie": "saedinenie", "kalojanovo": "kaloyanovo", "bracigovo": "bratsigovo",
    "perushhica": "perushtitsa", "muglizh": "maglizh", "bratja daskalovi": "bratya daskalovi",
    "luki": "laki", "gulubovo": "galabovo", "carevo": "tsarevo", "berkovica": "berkovitsa",
    "ljaskovec": "lyaskovets", "zlatica": "zlatitsa", "bjala": "byala", "pavel banja": "pavel banya",
}


def aliased(name: Column, aliases: Mapping[str, str]) -> Column:
    """Replace whole names that have another spelling; the map is a small literal."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def place_name(value: Column | str, aliases: Mapping[str, str] = PLACE_ALIASES) -> Column:
    return aliased(plain_name(value), aliases)


def distance_km(lat: Column | str, lon: Column | str, city: tuple[float, float]) -> Column:
    """Great-circle distance to a fixed point."""
    lat1, lon1 = F.radians(lat), F.radians(lon)
    lat2, lon2 = F.radians(F.lit(city[0])), F.radians(F.lit(city[1]))
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return EARTH_RADIUS_KM * 2 * F.asin(F.sqrt(half))


def city_distances(lat: Column | str, lon: Column | str) -> dict[str, Column]:
    each = {f"km_{name}": distance_km(lat, lon, at) for name, at in CITIES.items()}
    return each | {"min_city_km": F.least(*each.values())}


def grouped_modes(rows: DataFrame, key: str, columns: Sequence[str], default: str = "Unknown") -> DataFrame:
    """Most frequent value per key and column, the smallest on a tie, ``default`` without any.

    Values are counted per (key, value) first, so neither many rows nor many values of one
    key meet in a single task.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    long = rows.where(F.col(key).isNotNull()).select(key, pairs.alias("p")).select(key, "p.c", "p.v")
    counts = long.where(F.col("v").isNotNull()).groupBy(key, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(*[
        F.min_by("v", F.when(F.col("c") == c, F.struct(-F.col("n"), F.col("v")))).alias(c) for c in columns
    ])
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(best, key, "left").select(key, *[F.coalesce(c, F.lit(default)).alias(c) for c in columns])


def postal_rollup(
    gazetteer: DataFrame, key: str, modes: Sequence[str], means: Sequence[str], medians: Sequence[str]
) -> DataFrame:
    """One row per postal code: size, modes, means and exact medians."""
    base = gazetteer.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("place_count"), *[F.avg(c).alias(c) for c in means])
    parts = [base, grouped_modes(gazetteer, key, modes)]
    known = gazetteer.where(F.col(key).isNotNull())
    parts += [exact_quantiles(known, c, {c + "_median": 0.5}, by=[key]).withColumnRenamed(c + "_median", c) for c in medians]
    return reduce(lambda a, b: a.join(b, key, "left"), parts)


def enrich(rows: DataFrame, dimension: DataFrame, on: Sequence[str], found: str, unknown: Sequence[str] = ()) -> DataFrame:
    """Left lookup with a 0/1 match flag; missing texts become "Unknown".

    No broadcast is forced: Spark broadcasts the dimension when its real size is small.
    """
    marked = dimension.withColumn(found, F.lit(1))
    wide = rows.join(marked, list(on), "left").withColumn(found, F.coalesce(found, F.lit(0)))
    return wide.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in unknown}) if unknown else wide


def with_headings(
    rows: DataFrame, document: str, order: str, label: Column, headings: Column, chunk: Column
) -> DataFrame:
    """Level and district of each row of ordered documents.

    A heading name opens a district, unless the same district is already open: then the
    name is a municipality of it. Rows below belong to the open district.
    """
    named = rows.withColumn("_name", label)
    candidate = F.when(headings, F.col("_name"))
    seen = latest_before(named.withColumn("_candidate", candidate), [document], [order], chunk,
                         F.col("_candidate"), "_open")
    opens = F.col("_candidate").isNotNull() & ~F.col("_candidate").eqNullSafe(F.col("_open"))
    return seen.select(
        *rows.columns,
        F.when(opens, "district").otherwise("municipality").alias("level"),
        F.when(opens, F.col("_candidate")).otherwise(F.coalesce("_open", F.lit(""))).alias("district"),
    )


def pivot_under_heading(
    rows: DataFrame, document: str, order: str, is_heading: Column, category: Column, value: Column,
    categories: Sequence[str], chunk: Column,
) -> DataFrame:
    """Category rows below each heading row as columns; a repeated category keeps its last value."""
    tagged = rows.withColumn("_category", category).withColumn("_value", value)
    below = latest_before(tagged, [document], [order], chunk, F.when(is_heading, F.col(order)), "heading", inclusive=True)
    cells = below.where(F.col("heading").isNotNull() & F.col("_category").isin(*categories))
    return cells.groupBy(document, "heading").agg(*[
        F.max_by("_value", F.when(F.col("_category") == c, F.col(order))).alias(c) for c in categories
    ])
