"""Mixer settings as a table (take, channel, gain_db, pan, mute, solo, link) and its JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import audio

MIXER = "struct<master:double,channels:array<struct<channel:int,gain_db:double,pan:double,mute:boolean,solo:boolean,link:boolean>>,points:array<struct<channel:int,param:string,frame:bigint,value:double>>>"


def parse_mixer(df: DataFrame, take: str, text: str) -> DataFrame:
    """A row for each channel of each take's settings; a null gain is an off fader."""
    d = df.select(take, F.from_json(text, MIXER).alias("m")).select(take, F.col("m.master").alias("master"), F.explode("m.channels").alias("c"))
    return d.select(take, F.coalesce("master", F.lit(0.0)).alias("master"), "c.channel", F.coalesce("c.gain_db", F.lit(float("-inf"))).alias("gain_db"), F.coalesce("c.pan", F.lit(0.0)).alias("pan"), *(F.coalesce(f"c.{x}", F.lit(False)).alias(x) for x in ("mute", "solo", "link")))


def automation(df: DataFrame, take: str, text: str) -> DataFrame:
    """The breakpoints of the settings; a null value is minus infinity."""
    d = df.select(take, F.explode(F.from_json(text, MIXER)["points"]).alias("p"))
    return d.select(take, "p.channel", "p.param", "p.frame", F.coalesce("p.value", F.lit(float("-inf"))).alias("value"))


def to_json(df: DataFrame, take: str) -> DataFrame:
    """One row for each take: the settings as JSON (an off fader as null)."""
    gain = F.when(F.col("gain_db") > float("-inf"), F.col("gain_db"))
    one = F.struct("channel", gain.alias("gain_db"), "pan", "mute", "solo", "link")
    return df.groupBy(take).agg(F.to_json(F.struct(F.max("master").alias("master"), F.array_sort(F.collect_list(one)).alias("channels"))).alias("mixer"))


def linked(df: DataFrame, take: str) -> DataFrame:
    """Channels linked to the next one give it their gain, mute and solo, and the opposite pan."""
    w = Window.partitionBy(take).orderBy("channel")
    follows = F.coalesce(F.lag("link").over(w), F.lit(False))
    given = lambda c, x=None: F.when(follows, x if x is not None else F.lag(c).over(w)).otherwise(F.col(c)).alias(c)
    return df.select(take, "master", "channel", given("gain_db"), given("pan", -F.lag("pan").over(w)), given("mute"), given("solo"), "link")


def matrix(df: DataFrame, take: str) -> DataFrame:
    """left and right gain of each channel: mute wins, then the soloed ones alone; over the root of
    the number of sounding channels."""
    w = Window.partitionBy(take)
    soloed = F.max(F.col("solo").cast("int")).over(w) == 1
    sounding: Column = ~F.col("mute") & (~soloed | F.col("solo"))
    left, right = audio.pan_gains(F.col("pan"))
    d = df.withColumn("_on", sounding.cast("int")).withColumn("_n", F.greatest(F.sum("_on").over(w), F.lit(1)))
    gain = F.when(F.col("_on") == 1, audio.db_to_gain(F.col("gain_db") + F.col("master"))).otherwise(0.0) / F.sqrt("_n")
    return d.select(take, "channel", (gain * left).alias("left"), (gain * right).alias("right"))


def soloed(df: DataFrame, edits: DataFrame, take: str, exclusive: bool = False) -> DataFrame:
    """df after solos are set (take, channel, on); if exclusive, a new solo replaces the take's others."""
    e = edits.select(take, "channel", F.col("on").alias("_on"))
    news = e.groupBy(take).agg(F.max("_on").alias("_new"))
    both = df.join(e, [take, "channel"], "left").join(news, take, "left")
    cleared = F.coalesce(F.col("_new"), F.lit(False)) if exclusive else F.lit(False)
    return both.select(*(F.coalesce("_on", F.when(cleared, False).otherwise(F.col("solo"))).alias("solo") if c == "solo" else F.col(c) for c in df.columns))
