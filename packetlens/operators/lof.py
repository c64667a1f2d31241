"""Local outlier factor (Breunig et al. 2000) of new profiles against a table of past ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import feature_struct
from ..plans import workspace
from ..schemas import FEATURES
from .alerts import hit
from .detector import Detector
from .neighbours import Cells, nearest, plan_cells, vector_id

LIMIT = 1.5  # a factor above this is an outlier


class Lof(Detector):
    """Equal profiles are one point with a weight, so copies cost nothing and cannot pile up in a group."""

    name = "lof"
    adds_columns = False

    def __init__(self, k: int = 20, cell_rows: int = 200, model_version: str = "v1") -> None:
        super().__init__(model_version)
        self.k, self.cell_rows = k, cell_rows

    def _fit(self, rows: DataFrame) -> None:
        points = rows.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("weight")).withColumn("pid", vector_id())
        points = workspace.written(points, "lof_points")
        total = points.agg(F.sum("weight")).first()[0]
        k = min(self.k, total - 1)
        self.model = {"k": k, "tables": ["points"]}
        if k < 1:
            self.model = None
            return
        cells = plan_cells(points, self.cell_rows)
        self.model["cells"] = cells.as_lists()
        found = nearest(points.withColumnRenamed("pid", "qid"), points, cells, k, exclude_self=True)
        found = workspace.written(found, "lof_neighbours")
        reach = found.groupBy("qid").agg(F.max("distance").alias("k_distance"))
        density = self._density(found, reach.withColumnRenamed("qid", "pid"))
        table = points.join(reach.withColumnRenamed("qid", "pid"), "pid").join(density.withColumnRenamed("qid", "pid"), "pid")
        self.tables = {"points": workspace.written(table, "lof_model")}

    @staticmethod
    def _density(found: DataFrame, reach: DataFrame) -> DataFrame:
        """Local reachability density of every query: one over its mean reachability distance."""
        far = F.greatest("distance", "k_distance") * F.col("weight")
        return found.join(reach.select("pid", "k_distance"), "pid").groupBy("qid").agg(
            (1.0 / (F.sum(far) / F.sum("weight") + 1e-10)).alias("density"))

    def _scored(self, profiles: DataFrame) -> DataFrame:
        points, k = self.tables["points"], self.model["k"]
        doubles = [F.col(f).cast("double") for f in FEATURES]
        keyed = profiles.withColumn("qid", vector_id(*doubles))
        asked = keyed.select("qid", *[d.alias(f) for d, f in zip(doubles, FEATURES)]).dropDuplicates(["qid"])
        found = workspace.written(nearest(asked, points, Cells.from_lists(self.model["cells"]), k, exclude_self=False), "lof_found")
        around = found.join(points.select("pid", F.col("density").alias("its_density")), "pid").groupBy("qid").agg(
            (F.sum(F.col("its_density") * F.col("weight")) / F.sum("weight")).alias("around"))
        factors = around.join(self._density(found, points), "qid").select(
            "qid", (F.col("around") / F.col("density")).alias("lof_factor"))
        return keyed.join(factors, "qid", "left")

    def _hit(self) -> Column:
        details = F.struct(feature_struct().alias("features"))
        found = hit("ml:lof", "anomaly", F.lit(schemas.MEDIUM), F.lit(0.7), details, self.model_version)
        return F.when(F.col("lof_factor") > LIMIT, found)
