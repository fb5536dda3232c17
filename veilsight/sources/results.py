"""Result and verdict files read back for labelling and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "id string, url string, is_violation boolean, location string, evidence_text string, technique string, extra_finding string"
RESULT = f"meta struct<topic:string,entry_url:string,started_at:string,finished_at:string,elapsed_sec:double,tool_version:string>, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>"
VERDICTS = "id string, technique string, url string, location string, evidence_text string, verdict string"


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """One row per finding of result files, each a JSON document over many lines."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path).select(F.explode("findings").alias("f")).select("f.*")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Review CSV with its verdicts: quoted cells, doubled quotes, line breaks inside cells, a byte order mark."""
    return spark.read.schema(VERDICTS).csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Error lines; broken ones are null rows."""
    cause = "class string, message string, stack array<string>".replace(" ", ":").replace(",:", ",")
    schema = f"time string, thread string, site string, url string, class string, message string, stack array<string>, causes array<struct<{cause}>>"
    return spark.read.schema(schema).json(path)
