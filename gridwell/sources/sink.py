"""Results as files and as text."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("gridwell")


def labelled_text(x: str = "x", y: str = "y", flag: str = "flag", cluster: str = "cluster_id") -> Column:
    """A labelled point as text: ``(x, y) flag cluster``."""
    return F.format_string("(%s, %s) %s %s", F.col(x).cast("string"), F.col(y).cast("string"), F.col(flag), F.col(cluster).cast("string"))


def labelled_points(model) -> DataFrame:
    """(id, x, y, flag, cluster_id) of a model that keeps its points."""
    return model.points.select("id", "x", "y").join(model.labeled, "id").select("id", "x", "y", "flag", "cluster_id")


def write_labels(model, path: str, mode: str = "error") -> None:
    """A model's labelled points as header-less lines ``id,x,y,flag,cluster_id``."""
    labelled_points(model).write.mode(mode).csv(path)
    log.info("labels written to %s", path)
