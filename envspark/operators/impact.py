"""What moving cells meet: the area they are over, the next one on their way, and how exposed it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.geo import destination
from envspark.operators.joins import points_in_areas

#: Minutes between looks ahead, the farthest of them, and what an area on the way counts against one that is hit.
STEP_MIN, LOOKAHEAD_MIN, APPROACHING = 2.0, 60.0, 0.7


def impact(cells: DataFrame, areas: DataFrame, step: float = STEP_MIN, ahead: float = LOOKAHEAD_MIN) -> DataFrame:
    """(id, over, approaching, eta_minutes, exposure) of cells (id, lon, lat, speed_ms, bearing_deg) and areas (area_id, weight, rings).

    over is the area that holds the cell, approaching the first other one on the way along its bearing, looked for every step minutes;
    where areas overlap, the smallest area_id counts. A cell without speed or bearing, or at rest, approaches nothing. exposure is the
    weight (0 to 1) of the area hit, else that of the one approached, less the later it is met, times APPROACHING, else 0.
    """
    looks = F.when((F.col("speed_ms") > 0) & F.col("bearing_deg").isNotNull(), F.sequence(F.lit(0), F.lit(int(ahead // step)))).otherwise(F.array(F.lit(0)))
    each = cells.select("id", "lon", "lat", "speed_ms", "bearing_deg", F.explode(looks).alias("k"))
    lon, lat = destination(F.col("lon"), F.col("lat"), F.col("bearing_deg"), F.col("speed_ms") * F.col("k") * (step * 60))
    at = each.select(F.struct("id", "k").alias("id"), F.when(F.col("k") == 0, F.col("lon")).otherwise(lon).alias("lon"), F.when(F.col("k") == 0, F.col("lat")).otherwise(lat).alias("lat"))
    met = points_in_areas(at, areas.select("area_id", "rings")).groupBy("id").agg(F.min("area_id").alias("area_id")).select("id.id", "id.k", "area_id")
    over = met.filter("k = 0").select("id", F.col("area_id").alias("over"))
    later = met.filter("k > 0").join(over, "id", "left").filter("over is null or over <> area_id")
    first = later.groupBy("id").agg(F.min(F.struct("k", "area_id")).alias("n")).select("id", F.col("n.area_id").alias("approaching"), (F.col("n.k") * step).alias("eta_minutes"))
    weights = areas.select("area_id", "weight")
    out = cells.select("id").join(over, "id", "left").join(first, "id", "left")
    out = out.join(weights.withColumnsRenamed({"area_id": "over", "weight": "w_over"}), "over", "left").join(weights.withColumnsRenamed({"area_id": "approaching", "weight": "w_next"}), "approaching", "left")
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("eta_minutes") / ahead))
    exposure = F.when(F.col("over").isNotNull(), F.col("w_over")).when(F.col("approaching").isNotNull(), F.col("w_next") * near * APPROACHING).otherwise(0.0)
    return out.select("id", "over", "approaching", "eta_minutes", F.greatest(F.lit(0.0), F.least(F.lit(1.0), exposure)).alias("exposure"))
