"""Frame snapshots: one JSON document per frame, read with an open schema into ``holders`` and ``roots``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "struct<v:double,r:int,how:string>"
HOLDER = (
    f"struct<e:int,t:string,f:string,ph:int,dn:int,fs:{VALUE},off:struct<r:int,how:string,indent:boolean,x:double,y:double>,op:{VALUE},"
    f"ca:{VALUE},sc:struct<v:double,r:int,fg:string,bg:string>,vis:int,clip:int,clipHow:string>"
)
ROOT = "struct<t:string,n:int,d:int,p:int,m:int>"
SNAPSHOT = f"struct<truncated:boolean,holders:array<{HOLDER}>,roots:map<string,{ROOT}>>"
MOST_HOLDERS = 20000


def parse(json: Column | str) -> Column:
    """Fields that are not known are passed over; what is no object is null."""
    return F.from_json(json, SNAPSHOT)


def _none(c: str) -> Column:
    """References below zero mean no element."""
    return F.when(F.col(c) >= 0, F.col(c))


def holders(snapshots: DataFrame) -> DataFrame:
    """``page_id, frame_id, ord`` and the fields of every holder, in document order."""
    rows = snapshots.select("page_id", "frame_id", F.posexplode(parse("json")["holders"]).alias("ord", "h"))
    rows = rows.select("page_id", "frame_id", "ord", "h.*")
    for c in ("ph", "dn", "vis", "clip"):
        rows = rows.withColumn(c, _none(c))
    return rows.where(F.col("ord") < MOST_HOLDERS)


def roots(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.select("page_id", "frame_id", F.explode(parse("json")["roots"]).alias("e", "r"))
    return rows.select("page_id", "frame_id", F.col("e").try_cast("int").alias("e"), "r.*").where("e is not null").withColumn("p", _none("p"))


def truncated(snapshots: DataFrame) -> DataFrame:
    """Frames cut short, and frames that could not be read."""
    s = parse("json")
    return snapshots.select("page_id", "frame_id", s["truncated"].alias("truncated"), s["holders"].isNull().alias("uninspected"))
