"""Sports events: inverted index of video ids, first match, flat metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framerank.functions import scalars as S


def index(events: DataFrame, order: str) -> DataFrame:
    """(video_id, order) for each video that an event's playlist names; empty ids are left out, repeats stay. The
    parent is not copied: an index row is a key and the event's place."""
    vid = F.col("v.video_asset_id").cast("string")
    return events.select(order, F.explode("playlist.events").alias("v")).select(vid.alias("video_id"), order).where((F.col("video_id") != "") & (F.col("video_id") != "0"))


def index_lists(events: DataFrame, order: str) -> DataFrame:
    """The index as one row per video id with the ordered places of its events. A video's list is as long as its events."""
    return index(events, order).groupBy("video_id").agg(F.array_sort(F.collect_list(order)).alias("events"))


def first_match(keys: DataFrame, events: DataFrame, order: str, key: str = "video_id") -> DataFrame:
    """Each key row with matched and the first event (by order) of its video id. An aggregate with map-side partials
    finds the place of the first event, so no list is built."""
    first = index(events, order).groupBy("video_id").agg(F.min(order).alias("__first"))
    found = first.join(events.withColumn("__event", F.struct(*events.columns)).select(F.col(order).alias("__first"), "__event"), "__first").select(F.col("video_id").alias("__key"), F.col("__event").alias("event"))
    return keys.join(found, F.col(key) == F.col("__key"), "left").withColumn("matched", F.col("__key").isNotNull()).drop("__key")


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def metadata(event: Column | str = "event") -> list[Column]:
    """The 18 flat fields of an event struct, with their defaults."""
    e = F.col(event) if isinstance(event, str) else event
    p, tag = e["playlist"], e["tag"]
    game = p["game"]
    home, away = game["home_team"], game["visiting_team"]
    scorer = F.coalesce(F.nullif(tag["player_name"], F.lit("")), F.nullif(tag["scorer"], F.lit("")), F.lit(""))
    return [
        _or(e["score"], "0-0").alias("score"), S.clock(e["game_time"]).alias("game_time"), _or(e["game_phase"], "").alias("game_phase"),
        _or(tag["action"], "highlight").alias("event_type"), scorer.alias("scorer"),
        _or(home["name"], "").alias("home_team"), _or(home["short_name"], "").alias("home_team_short"), _or(home["logo_url"], "").alias("home_team_logo"),
        _or(away["name"], "").alias("visiting_team"), _or(away["short_name"], "").alias("visiting_team_short"), _or(away["logo_url"], "").alias("visiting_team_logo"),
        _or(game["stadium_name"], "").alias("stadium"), _or(game["tournament_name"], "").alias("tournament"), _or(game["date"], "").alias("date"),
        game["attendance"].alias("attendance"), _or(p["video_url"], "").alias("video_url"), _or(p["thumbnail_url"], "").alias("thumbnail_url"),
        _or(p["description"], "").alias("description"),
    ]


def records(events: DataFrame) -> DataFrame:
    """Flat rows of fetched events."""
    p = F.col("playlist")
    game = p["game"]
    return events.select(
        F.col("tag.action").alias("event_type"), game["home_team"]["name"].alias("team_home"), game["visiting_team"]["name"].alias("team_away"), game["id"].alias("game_id"),
        p["video_url"].alias("video_url"), "score", p["duration_ms"].alias("duration_ms"), game["phase"].alias("phase"), game["tournament_name"].alias("tournament_name"),
        p["recording_timestamp"].alias("recording_timestamp"), p["frontend_url"].alias("frontend_url"), p["thumbnail_url"].alias("thumbnail_url"),
    )
