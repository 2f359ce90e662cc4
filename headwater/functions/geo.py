"""Sampling points around an entity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.constants import CATCHMENT_RADIUS_KM, KM_PER_DEGREE


def catchment_points(registry: DataFrame, radius_km: float = CATCHMENT_RADIUS_KM) -> DataFrame:
    """Five rows per entity: its centre, then a cross of the given radius."""
    lat, lon = F.col("lat"), F.col("lon")
    dlat = F.lit(radius_km / KM_PER_DEGREE)
    dlon = radius_km / (KM_PER_DEGREE * F.cos(F.radians(lat)))

    def point(a, b):
        return F.struct(a.alias("lat"), b.alias("lon"))

    cross = F.array(
        point(lat, lon),
        point(F.round(lat + dlat, 4), lon),
        point(F.round(lat - dlat, 4), lon),
        point(lat, F.round(lon + dlon, 4)),
        point(lat, F.round(lon - dlon, 4)),
    )
    return registry.select("dam", F.posexplode(cross).alias("point", "at")).select(
        "dam", "point", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon")
    )
