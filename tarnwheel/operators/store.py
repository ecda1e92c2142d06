"""Leaderboard, team and submission views of the result store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.session import reliable

from .aggregates import arg_first
from .joins import join_suffix
from .windows import ordinal_rank

HISTORY_LENGTH = 200
ACTIVE = ("queued", "running")


def leaderboard(submissions: DataFrame, teams: DataFrame) -> DataFrame:
    """Best finished global submission per team, ranked by its final score.

    Equal scores go to the earlier finish, then to the smaller id.
    """
    entered = submissions.where(
        (F.col("kind") == "global") & (F.col("status") == "done") & F.col("final_score").isNotNull()
    )
    best = arg_first(
        [F.col("id").alias("submission_id"), "final_score", "finished_at"],
        [-F.col("final_score"), F.col("finished_at"), F.col("id")],
        largest=False,
    )
    per_team = entered.groupBy("team_id").agg(best.alias("best")).select("team_id", "best.*")
    named = join_suffix(
        per_team,
        teams.select("id", F.col("name").alias("team_name"), F.col("slug").alias("team_slug")),
        left_on="team_id",
        right_on="id",
    ).withColumn("__lost", -F.col("final_score"))
    ranked = ordinal_rank(reliable(named), [], ["__lost", "finished_at", "submission_id"], "rank")
    return ranked.select(
        "rank", "team_id", "team_name", "team_slug", "submission_id", "final_score", "finished_at"
    )


def team_directory(teams: DataFrame, members: DataFrame) -> DataFrame:
    """All teams with their member count (0 without members), oldest first."""
    counted = members.groupBy("team_id").agg(F.count("user_id").alias("member_count"))
    joined = join_suffix(teams, counted, left_on="id", right_on="team_id", how="left")
    return joined.withColumn("member_count", F.coalesce("member_count", F.lit(0))).orderBy("created_at", "id")


def submission_history(
    submissions: DataFrame, teams: DataFrame, users: DataFrame, scope: Column, limit: int = HISTORY_LENGTH
) -> DataFrame:
    """The newest submissions in ``scope`` with team and submitter names.

    The top-k comes first: only its rows meet the teams and users.
    """
    newest = submissions.where(scope).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    team_names = teams.select(
        F.col("id").alias("t_id"), F.col("name").alias("team_name"), F.col("slug").alias("team_slug")
    )
    user_names = users.select(F.col("id").alias("u_id"), F.col("name").alias("user_name"))
    placed = join_suffix(newest, team_names, left_on="team_id", right_on="t_id")
    return join_suffix(placed, user_names, left_on="submitted_by_user_id", right_on="u_id", how="left")


def visible_submissions(submissions: DataFrame, members: DataFrame, viewer: Column) -> DataFrame:
    """Submissions a user may open; details only for those of the own team."""
    own = members.where(F.col("user_id") == viewer).select(F.col("team_id").alias("own_team")).distinct()
    joined = submissions.join(own, F.col("team_id") == F.col("own_team"), "left")
    inside = F.col("own_team").isNotNull()
    return (
        joined.where(inside | (F.col("kind") == "global"))
        .withColumn("include_details", inside)
        .drop("own_team")
    )


def submission_details(visible: DataFrame, results: DataFrame) -> DataFrame:
    """Per-question rows of the submissions whose details may be shown."""
    shown = visible.where("include_details").select(F.col("id").alias("shown_id"))
    return results.join(shown, F.col("submission_id") == F.col("shown_id"), "left_semi")


def team_members(teams: DataFrame, members: DataFrame, users: DataFrame, slug: Column) -> DataFrame:
    """Members of one team with their names."""
    team = teams.where(F.col("slug") == slug).select("id")
    inside = join_suffix(members, team, left_on="team_id", right_on="id")
    return join_suffix(
        inside, users.select(F.col("id").alias("u_id"), "name"), left_on="user_id", right_on="u_id"
    )


def progress(completed: Column, total: Column) -> Column:
    """Percent of the questions done; 0 where there are none."""
    return F.when(total > 0, completed / total * 100).otherwise(F.lit(0.0))


def active_runs(submissions: DataFrame) -> DataFrame:
    """Queued and running submissions per team; more than one breaks the rule."""
    active = F.sum(F.col("status").isin(*ACTIVE).cast("long"))
    return submissions.groupBy("team_id").agg(active.alias("active")).withColumn(
        "violation", F.col("active") > 1
    )
