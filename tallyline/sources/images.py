"""Container images of cluster dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.repositories import image_parts

_LABELS = "labels:struct<team:string,git_repository:string,chart:string>"
_CONTAINERS = "containers:array<struct<image:string>>"
CRON_JOB = f"metadata struct<{_LABELS}>, spec struct<jobTemplate:struct<spec:struct<template:struct<spec:struct<{_CONTAINERS}>>>>>"
POD = f"metadata struct<{_LABELS}>, spec struct<{_CONTAINERS}>"


def dump_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of a saved listing; ``item`` is CRON_JOB or POD."""
    fields = item.replace("metadata struct", "metadata:struct").replace("spec struct", "spec:struct")
    listing = spark.read.schema(f"items array<struct<{fields}>>").option("multiLine", True).json(path)
    return listing.select(F.explode("items").alias("i")).select("i.*")


def cluster_images(cron_jobs: DataFrame, pods: DataFrame, subscription_name: str, subscription_id: str) -> DataFrame:
    """Distinct image records: every container of a cron job, the first of a pod (label falls back to the chart)."""
    jobs = cron_jobs.select(F.explode("spec.jobTemplate.spec.template.spec.containers").alias("c"), "metadata.labels").select(
        F.col("c.image").alias("image"), "labels.team", F.col("labels.git_repository").alias("repo"))
    first = pods.select(F.get("spec.containers", F.lit(0))["image"].alias("image"), F.col("metadata.labels.team").alias("team"),
                        F.coalesce("metadata.labels.git_repository", "metadata.labels.chart").alias("repo"))
    rows = jobs.unionByName(first).filter(F.col("image").isNotNull())
    return (rows.select(image_parts("image").alias("p"), F.col("team").alias("team_label"), "repo").select(
        "p.*", "team_label", "repo", F.lit(subscription_name).alias("subscription_name"),
        F.lit(subscription_id).alias("subscription_id")).distinct())
