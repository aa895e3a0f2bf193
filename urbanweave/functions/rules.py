"""Ordered rules on the columns of a table: vertical references, causes of heights, declared layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The height system of the sources, and what a terrain must say of itself to be compared with them.
TP_EPSG = 6695
TERRAIN_TP = "T.P. inferred for ward; DEM datum realization and epoch unverified; identity height"


def says_tp(name: Column) -> Column:
    """Whether a vertical reference names the T.P. system, whatever stands between its letters; null is no name."""
    return F.coalesce(F.contains(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", ""), F.lit("tp")), F.lit(False))


def vertical_fit(building: Column, terrain: Column, status: Column) -> Column:
    """Why heights of a building and a terrain may not be put together: UNRESOLVED (the terrain's status is neither verified nor
    source-declared), INCOMPATIBLE (one of the two does not name T.P.); null if they may."""
    return F.when(~F.coalesce(status.isin("verified", "source-declared"), F.lit(False)), "UNRESOLVED").when(~says_tp(building) | ~says_tp(terrain), "INCOMPATIBLE")


def vertical_state(epsg: Column, source_epsg: Column, terrain: Column, operation: Column, quantity: Column, unit: Column) -> Column:
    """MISMATCH, UNRESOLVED or CONDITIONAL: a code other than T.P.'s comes first, then what is not said, then another terrain,
    then heights that were changed or are no gravity-related metres. It is never more than conditional."""
    other = lambda c: c.isNotNull() & (c != TP_EPSG)
    said = (operation == "identity_H") & (quantity == "gravity_related_height") & (unit == "metre")
    return (
        F.when(other(epsg) | other(source_epsg), "MISMATCH")
        .when(epsg.isNull() | source_epsg.isNull() | terrain.isNull() | terrain.isin("unresolved", "UNRESOLVED"), "UNRESOLVED")
        .when(terrain != TERRAIN_TP, "MISMATCH")
        .when(~F.coalesce(said, F.lit(False)), "UNRESOLVED")
        .otherwise("CONDITIONAL")
    )


def height_cause(height: Column, evidence: Column, replay: Column, nodata_zeroed: Column, low_zeroed: Column, outside: Column, zero: Column, median_offset: Column, least: float = 39.0) -> Column:
    """Why a derived height is odd: a struct of level and reason, the first rule that holds.

    height below `least` is not reviewed; evidence (saved values agree) and replay (the sampling can be repeated) must
    hold; then cells whose nodata, or whose valid low values, became 0, cells outside the raster, cells of 0, and the
    median of sampled against direct elevations beyond a metre. Null counts are 0 and null flags do not hold.
    """
    made = lambda level, reason: F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason"))
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    holds = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(holds(height < least) | height.isNull(), made("UNRESOLVED", "BELOW_REVIEW_HEIGHT"))
        .when(~holds(evidence) | ~holds(replay), made("UNRESOLVED", "EVIDENCE_OR_REPLAY_DIFFERS"))
        .when(some(nodata_zeroed), made("CONFIRMED", "NODATA_TAKEN_AS_ZERO"))
        .when(some(low_zeroed), made("CONFIRMED", "LOW_ELEVATION_TAKEN_AS_ZERO"))
        .when(some(outside), made("LIKELY", "CELLS_OUTSIDE_RASTER"))
        .when(some(zero), made("LIKELY", "ZERO_CELLS_LOWER_GROUND"))
        .when(holds(F.abs(median_offset) > 1), made("LIKELY", "SAMPLED_ELEVATIONS_DIFFER"))
        .otherwise(made("UNRESOLVED", "GROUND_AGREES"))
    )


def declared_layer(features: DataFrame, expected: DataFrame, attributes: list[str], finite: list[str] | None = None, key: str = "source_id") -> DataFrame:
    """A feature table held against what was declared of it: one row an id of either, and one of each blank id.

    expected: key and `attributes`, one row an id. Returns key and status, the first that holds: BLANK_ID, DUPLICATE, UNEXPECTED,
    MISSING, ATTRIBUTE (one of `attributes` differs, nulls being equal), NOT_FINITE (one of the columns `finite` is null or no
    finite number), OK.
    """
    named = F.coalesce(F.trim(F.col(key).cast("string")), F.lit(""))
    fine = F.lit(True)
    for c in finite or []:
        fine = fine & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    blank = features.where(named == "").select(F.col(key), F.lit("BLANK_ID").alias("status"))
    held = features.where(named != "").withColumn("fine_one", fine).groupBy(key).agg(F.count("*").alias("copies"), F.every("fine_one").alias("fine_all"), F.first(F.struct(*attributes)).alias("found"))
    j = held.join(expected.select(key, F.struct(*attributes).alias("declared")), key, "full")
    status = (
        F.when(F.col("copies") > 1, "DUPLICATE").when(F.col("declared").isNull(), "UNEXPECTED").when(F.col("copies").isNull(), "MISSING")
        .when(~F.col("found").eqNullSafe(F.col("declared")), "ATTRIBUTE").when(~F.col("fine_all"), "NOT_FINITE").otherwise("OK")
    )
    return j.select(key, status.alias("status")).unionByName(blank)


def accepted_layer(features: DataFrame, expected: DataFrame, attributes: list[str], finite: list[str] | None = None, key: str = "source_id") -> DataFrame:
    """The features, if every declared id is there as declared and no other; else the scan fails and names one that is not."""
    bad = F.concat(F.lit("feature "), F.coalesce(F.col(key).cast("string"), F.lit("without id")), F.lit(": "), "status")
    fine = declared_layer(features, expected, attributes, finite, key).where(F.when(F.col("status") != "OK", F.raise_error(bad).isNotNull()).otherwise(F.lit(True)))
    return features.join(fine.select(key), key, "left_semi")
