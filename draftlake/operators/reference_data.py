"""Reference catalogs: player selection, media links, search, pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import scalars as S

IN_GAME_ROLES = ("Top", "Jungle", "Mid", "Bot", "Support")


def search(entities: DataFrame, name: str, typed: str, tie: str, most: int = 40) -> DataFrame:
    """Entities by rank: equal to the name's words or initials (0), a prefix (1), of two signs or more a prefix of the initials (2),
    a part (3); then by the length of the words, then by ``tie``; at most ``most``. Words are without case, marks and signs."""
    words, term = S.search_words(F.col(name)), F.array_join(S.search_words(F.lit(typed)), "")
    joined, initials = F.array_join(words, ""), F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    rank = F.when((joined == term) | (initials == term), 0).when(joined.startswith(term), 1).when((F.length(term) >= 2) & initials.startswith(term), 2).when(joined.contains(term), 3)
    return entities.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", F.length(joined), tie).limit(most)


def removable(current: DataFrame, key: str, keep: DataFrame, references: list[DataFrame]) -> DataFrame:
    """Keys of ``current`` that are neither kept nor referenced."""
    out = current.join(keep.select(key), key, "left_anti")
    return reduce(lambda df, r: df.join(r.select(key), key, "left_anti"), references, out)


def evidence(tournament: DataFrame, rosters: DataFrame) -> DataFrame:
    """Pages that a tournament names (column PlayerPage), or a roster in an in-game role, with the tags of their sources."""
    first = tournament.select(S.canonical_key(F.col("PlayerPage")).alias("page_key"), F.lit("TournamentPlayers").alias("source"))
    roles = F.exists(F.split("Role", r"\s*,\s*"), lambda r: r.isin(*IN_GAME_ROLES))
    second = rosters.where(roles).select(S.canonical_key(F.col("PlayerPage")).alias("page_key"), F.lit("ListplayerCurrent").alias("source"))
    return first.unionByName(second).where("page_key IS NOT NULL").groupBy("page_key").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def image_date(*dates: str, file: str = "FileName") -> F.Column:
    """When an image was taken: the first of the dates, else the last year in the file's name, as its first day."""
    years = F.regexp_extract_all(F.col(file), F.lit(r"(?<!\d)(20\d\d)(?!\d)"), F.lit(1))
    return F.coalesce(*(S.timestamp(F.col(d)) for d in dates), F.try_to_timestamp(F.concat(F.try_element_at(years, F.lit(-1)), F.lit("-01-01")), F.lit("yyyy-MM-dd")))


def select_players(catalog: DataFrame, shown: DataFrame, images: DataFrame) -> DataFrame:
    """Catalog players with evidence: page_key, handle, photo, n_same_handle.

    Personalities go; a page needs evidence; of several images the latest profile image counts,
    dates first, then file names.
    """
    players = catalog.where(~S.is_missing(F.col("SourcePageName")) & ~F.coalesce(F.lower("IsPersonality").isin("yes", "1", "true"), F.lit(False)))
    players = players.withColumn("page_key", S.canonical_key(F.col("SourcePageName"))).join(shown.select("page_key"), "page_key", "left_semi")
    pictures = images.where(F.lower("IsProfileImage").isin("yes", "1", "true")).select(
        S.canonical_key(F.col("PlayerPage")).alias("page_key"), "FileName", image_date("EffectiveSortDate", "SortDate", "TournamentDateStartFuzzy", "TournamentDate").alias("taken")
    )
    latest = pictures.groupBy("page_key").agg(F.max_by("FileName", F.struct(F.coalesce("taken", F.lit("1970-01-01").cast("timestamp")), F.col("FileName"))).alias("photo"))
    same = F.count(F.lit(1)).over(Window.partitionBy(F.lower("PlayerHandle")))
    return players.join(latest, "page_key", "left").select("page_key", F.col("PlayerHandle").alias("handle"), "photo", same.alias("n_same_handle"))


def link_media(media: DataFrame, entities: DataFrame, sole_photo: bool = False) -> DataFrame:
    """Media names to entities (id, name, photo): entity id and reason.

    A name matches without regard to case; of several the only one of exactly equal case counts, and
    with ``sole_photo`` (players) else the only one that has a photo.
    """
    named = entities.select(F.lower("name").alias("key"), "id", F.col("name").alias("entity_name"), "photo")
    both = media.select(F.col("name").alias("media_name"), F.lower("name").alias("key")).join(named, "key", "left")
    exact = F.col("entity_name") == F.col("media_name")
    has = F.col("photo").isNotNull()
    found = both.groupBy("media_name").agg(
        F.count("id").alias("n"), F.min("id").alias("one"), F.count_if(exact & F.col("id").isNotNull()).alias("n_exact"), F.min(F.when(exact, F.col("id"))).alias("one_exact"),
        F.count_if(has).alias("n_photo"), F.min(F.when(has, F.col("id"))).alias("one_photo"),
    )
    photo = (F.col("n_photo") == 1) & F.lit(sole_photo)
    target = F.when(F.col("n") == 1, F.col("one")).when(F.col("n_exact") == 1, F.col("one_exact")).when(photo, F.col("one_photo"))
    reason = F.when(F.col("n") == 0, "NO_MATCH").when(F.col("n") == 1, "UNIQUE_NAME").when(F.col("n_exact") == 1, "EXACT_CASE").when(photo, "SOLE_PHOTO").otherwise("AMBIGUOUS")
    return found.select("media_name", target.alias("id"), reason.alias("reason"))


def refresh_plan(current: DataFrame, fetched: DataFrame, key: str, value: str) -> DataFrame:
    """Media of both sides by key: ADD, REMOVE, CHANGE or KEEP; a removal of a photo is for review, never applied by itself."""
    both = current.select(F.col(key), F.col(value).alias("old")).join(fetched.select(F.col(key), F.col(value).alias("new")), key, "full")
    action = F.when(F.col("old").eqNullSafe(F.col("new")), "KEEP").when(F.col("old").isNull(), "ADD").when(F.col("new").isNull(), "REMOVE").otherwise("CHANGE")
    return both.select(key, "old", "new", action.alias("action"), (action == "REMOVE").alias("needs_review"))


def closed_aliases(aliases: DataFrame, passes: int = 2) -> DataFrame:
    """(name, target) with aliases of aliases followed, at most ``passes`` times."""
    out = aliases.select("name", "target")
    for _ in range(passes - 1):
        step = aliases.select(F.col("name").alias("target"), F.col("target").alias("next"))
        out = out.join(step, "target", "left").select("name", F.coalesce("next", "target").alias("target"))
    return out
