"""Which clusters' tables can be read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ClusterStatus:
    cluster: str
    address: str
    connected: bool
    error: str = ""


def cluster_status(spark: SparkSession, addresses: dict[str, str]) -> tuple[list[ClusterStatus], int, int]:
    """(status of each cluster, how many there are, how many are connected)."""
    found = []
    for cluster, address in sorted(addresses.items()):
        try:
            if not address:
                raise ValueError("not registered")
            spark.read.parquet(address).schema  # noqa: B018  reads a footer
            found.append(ClusterStatus(cluster, address, True))
        except (PySparkException, ValueError) as e:
            found.append(ClusterStatus(cluster, address, False, str(e).splitlines()[0]))
    return found, len(found), sum(s.connected for s in found)
