"""Map features to walking-resistance tiers: one ordered case expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexflow.params import AFFORDANCES, COSTS, IMPASSABLE

# The vocabulary of the classifier.
LAYERS = ["transportation", "building", "water", "landcover", "landuse", "park", "waterway", "aeroway"]
PATH_LIGHT = ["bridleway", "cycleway"]
ROAD_BARRED = ["motorway", "trunk", "primary", "raceway", "busway", "bus_guideway"]
ROAD_PAVED = ["secondary", "tertiary", "minor", "service"]
RAIL_CLASSES = ["rail", "transit", "railway"]
RAIL_SUBCLASSES = ["rail", "narrow_gauge", "preserved", "funicular", "subway", "light_rail", "monorail", "tram"]
COVER_BARRED = ["ice", "rock", "wetland"]
COVER_SUB_BARRED = ["glacier", "bare_rock", "scree", "swamp", "bog", "marsh", "mangrove", "reedbed", "saltern", "saltmarsh", "tidalflat", "tundra"]
COVER_SUB_HEAVY = ["forest", "wood", "scrub", "shrubbery", "heath", "sand", "beach", "dune", "fell", "mud"]
COVER_SUB_LIGHT = ["grass", "grassland", "meadow", "park", "garden", "golf_course", "village_green", "recreation_ground", "flowerbed", "wet_meadow", "allotments"]
COVER_SUB_FARMED = ["farm", "farmland", "orchard", "vineyard", "plant_nursery"]
COVER_HEAVY = ["wood", "farmland", "sand"]
USE_BARRED = ["military", "industrial", "quarry", "dam", "railway"]
USE_LIGHT = ["stadium", "pitch", "playground", "track", "theme_park", "zoo", "cemetery"]
SURFACE_PAVED = ["paved", "asphalt", "cobblestone", "concrete", "concrete:lanes", "concrete:plates", "metal", "paving_stones", "sett", "unhewn_cobblestone", "wood", "grade1"]
SURFACE_SOFT = ["unpaved", "compacted", "dirt", "earth", "fine_gravel", "grass", "grass_paver", "gravel", "gravel_turf", "ground", "ice", "mud", "pebblestone", "salt", "sand", "snow", "woodchips", "mulch"]

PROPS = ["source_layer", "class", "subclass", "surface", "brunnel", "foot", "access", "indoor", "layer"]


def vertical_layer(source_layer: Column, layer: Column, brunnel: Column) -> Column:
    """The numeric prefix of ``layer`` or '0'; a transport bridge or tunnel at '0' is '1' or '-1'."""
    number = F.regexp_extract(F.coalesce(layer, F.lit("")), r"^\s*([+-]?[0-9]+)", 1)
    base = F.coalesce(F.expr("cast(null as string)"), number.try_cast("long").cast("string"), F.lit("0"))
    lifted = F.when(brunnel == "bridge", "1").when(brunnel == "tunnel", "-1").otherwise(base)
    return F.when((source_layer == "transportation") & (base == "0"), lifted).otherwise(base)


def modulated(cost: Column, surface: Column) -> Column:
    soft = F.when(cost == "PAVEMENT", "LIGHT_PARK").when(cost == "LIGHT_PARK", "HEAVY_GRASS").otherwise(cost)
    return F.when(surface.isin(SURFACE_PAVED) & (cost == "LIGHT_PARK"), "PAVEMENT").when(surface.isin(SURFACE_SOFT), soft).otherwise(cost)


def tier_of_feature() -> Column:
    """Tier key of a row of ``features``; null for what leaves no trace on the ground."""
    source, cls, sub = (F.coalesce(F.col(c), F.lit("")) for c in ("source_layer", "class", "subclass"))
    surface, brunnel = F.coalesce("surface", F.lit("")), F.coalesce("brunnel", F.lit(""))
    restricted = F.coalesce(F.col("foot").isin("no", "private"), F.lit(False)) | F.coalesce(F.col("access").isin("no", "private"), F.lit(False))
    path = F.when(sub.isin(PATH_LIGHT), "LIGHT_PARK").when(sub == "steps", "HEAVY_GRASS").otherwise("PAVEMENT")
    transport = (
        F.when(restricted | cls.contains("_construction") | cls.isin("ferry", "aerialway"), "IMPASSABLE")
        .when(cls == "pier", modulated(F.lit("PAVEMENT"), surface))
        .when(cls == "path", modulated(path, surface))
        .when(brunnel == "ford", modulated(F.lit("HEAVY_GRASS"), surface))
        .when(cls.isin(ROAD_BARRED), "IMPASSABLE")
        .when(cls.isin(ROAD_PAVED), modulated(F.lit("PAVEMENT"), surface))
        .when(cls == "track", modulated(F.lit("LIGHT_PARK"), surface))
        .when(cls.isin(RAIL_CLASSES) | sub.isin(RAIL_SUBCLASSES), "IMPASSABLE")
        .otherwise(modulated(F.lit("PAVEMENT"), surface))
    )
    cover = (
        F.when(restricted | cls.isin(COVER_BARRED) | sub.isin(COVER_SUB_BARRED), "IMPASSABLE")
        .when(sub.isin(COVER_SUB_HEAVY), "HEAVY_GRASS")
        .when(sub.isin(COVER_SUB_LIGHT), "LIGHT_PARK")
        .when(sub.isin(COVER_SUB_FARMED) | cls.isin(COVER_HEAVY), "HEAVY_GRASS")
        .when(cls == "grass", "LIGHT_PARK")
        .otherwise("PAVEMENT")
    )
    use = F.when(restricted | cls.isin(USE_BARRED), "IMPASSABLE").when(cls.isin(USE_LIGHT), "LIGHT_PARK").otherwise("PAVEMENT")
    return (
        F.when(F.coalesce(F.col("indoor").isin("1", "true"), F.lit(False)), "IMPASSABLE")
        .when(source == "transportation", transport)
        .when(source == "landcover", cover)
        .when(source == "landuse", use)
        .when(source.isin("building", "water", "aeroway"), "IMPASSABLE")
        .when(source == "waterway", F.when(brunnel == "tunnel", F.lit(None)).otherwise("IMPASSABLE"))
        .when(source == "park", "LIGHT_PARK")
        .otherwise("PAVEMENT")
    )


def classify(features: DataFrame) -> DataFrame:
    """The features that leave a trace, with ``cost`` and ``vlayer``.

    The expression is evaluated in the scan's own stage: at a few tests a row it costs less than
    a distinct and a join back would.
    """
    out = features.withColumn("vlayer", vertical_layer(F.col("source_layer"), F.col("layer"), F.col("brunnel"))).withColumn("cost", tier_of_feature())
    return out.where(F.col("cost").isNotNull())


def friction_of(tier: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in COSTS.items():
        out = F.when(tier == name, value).otherwise(out)
    return out


def friction_tier(friction: Column) -> Column:
    return F.when(friction >= IMPASSABLE, "impassable").when(friction < 1.75, "pavement").when(friction < 3.25, "light_park").otherwise("heavy_grass")


def affordance_of(friction: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in AFFORDANCES.items():
        out = F.when(friction_tier(friction) == name.lower(), value).otherwise(out)
    return out


def known_class(surface_class: Column) -> Column:
    """A painted class; what is unknown counts as PAVEMENT."""
    return F.when(surface_class.isin(list(COSTS)), surface_class).otherwise("PAVEMENT")
