"""Reads of the social graph, for whole tables of requests at once.

The friendship graph is a table of edges ``(owner, other, kind)``, one row per entry of a list, with kind ``confirmed`` or
``pending``. Lists as arrays are a view of it (``friendship.friend_lists``), and users that carry arrays turn into edges
with ``edges_of``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stalemark.schemas import PROFILE_FIELDS

CONFIRMED, PENDING = "confirmed", "pending"
# What a profile shows besides its counts.
PROFILE_COLUMNS = [
    "address", "dob", "email", "fname", "gender", "jdate", "ldate", "lname", "tel", "userid", "username",
]


def guard_ids(requests: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Requests whose ids are all 0 or more, and the others with status ERROR."""
    bad = F.lit(False)
    for name in columns:
        bad = bad | (F.col(name) < 0)
    bad = F.coalesce(bad, F.lit(False))
    return requests.where(~bad), requests.where(bad).withColumn("status", F.lit("ERROR"))


REFUSED_BY = {
    "list_friends": ["requester", "owner"],
    "view_friend_requests": ["owner"],
    "friend_ids": ["member"],
    "delete_comments": ["creatorid", "rid"],
}


def refused(operation: str, requests: DataFrame) -> DataFrame:
    """The requests that an operation of this module leaves out for a negative id, with status ERROR."""
    return guard_ids(requests, REFUSED_BY[operation])[1]


def edges_of(users: DataFrame) -> DataFrame:
    """Edges out of the friend arrays of users."""
    lists = F.array(
        F.struct(F.lit(CONFIRMED).alias("kind"), F.col("ConfFriends").alias("others")),
        F.struct(F.lit(PENDING).alias("kind"), F.col("PendFriends").alias("others")),
    )
    return users.select(F.col("userid").alias("owner"), F.explode(lists).alias("l")).select(
        "owner", F.explode("l.others").alias("other"), F.col("l.kind").alias("kind")
    )


def lookup_users(requests: DataFrame, users: DataFrame, key: str = "userid") -> DataFrame:
    """Requests with the row of the user they name; requests for a missing user fall away."""
    return requests.join(users, key)


def select_fields(users: DataFrame, fields: Sequence[str] | None = None, with_thumbnail: bool = False) -> DataFrame:
    """The chosen profile fields, or the default ones; those a table does not have are left out."""
    wanted = list(fields) if fields is not None else [f for f in PROFILE_FIELDS if f in users.columns]
    if with_thumbnail and "tpic" not in wanted:
        wanted.append("tpic")
    return users.select(*wanted)


def friend_ids(requests: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """One row per requested ``member`` and id on its list of that kind; negative members are refused (``refused``)."""
    ok, _ = guard_ids(requests, REFUSED_BY["friend_ids"])
    listed = edges.where(F.col("kind") == kind).select(F.col("owner").alias("member"), F.col("other").alias("friend"))
    return ok.join(listed, "member")


def _profiles_on_list(requests, users, edges, kind, fields, with_thumbnail) -> DataFrame:
    profiles = select_fields(users.withColumn("friend", F.col("userid")), [*_fields(users, fields), "friend"], with_thumbnail)
    listed = edges.where(F.col("kind") == kind).select("owner", F.col("other").alias("friend"))
    return requests.join(listed, "owner").join(profiles, "friend").drop("friend")


def _fields(users: DataFrame, fields: Sequence[str] | None) -> list[str]:
    chosen = list(fields) if fields is not None else [f for f in PROFILE_FIELDS if f in users.columns]
    return chosen if "userid" in chosen else ["userid", *chosen]  # the id of a friend is always returned


def list_friends(
    requests: DataFrame,
    users: DataFrame,
    edges: DataFrame,
    fields: Sequence[str] | None = None,
    with_thumbnail: bool = False,
) -> DataFrame:
    """For each request (requester, owner), the profile rows of the owner's confirmed friends."""
    ok, _ = guard_ids(requests.select("requester", "owner"), REFUSED_BY["list_friends"])
    return _profiles_on_list(ok, users, edges, CONFIRMED, fields, with_thumbnail)


def view_friend_requests(
    requests: DataFrame, users: DataFrame, edges: DataFrame, with_thumbnail: bool = False
) -> DataFrame:
    """For each requested owner, the profile rows of those who wait for an answer."""
    ok, _ = guard_ids(requests.select("owner"), REFUSED_BY["view_friend_requests"])
    return _profiles_on_list(ok, users, edges, PENDING, None, with_thumbnail)


def list_sizes(edges: DataFrame) -> DataFrame:
    """Per owner, the lengths of both lists."""

    def count(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    return edges.groupBy("owner").agg(count(CONFIRMED).alias("n_confirmed"), count(PENDING).alias("n_pending"))


def resource_counts(resources: DataFrame, by: str) -> DataFrame:
    """Resources per wall owner (``walluserid``) or per creator (``creatorid``)."""
    return resources.groupBy(by).agg(F.count("rid").alias("resourcecount"))


def view_profile(
    requests: DataFrame, users: DataFrame, edges: DataFrame, resources: DataFrame, with_picture: bool = False
) -> DataFrame:
    """For each request (requester, owner): the owner's profile and counts; pending requests are shown to oneself only.

    Counts are made per user before anything meets the requests, so a much requested profile is computed once.
    """
    shown = [c for c in PROFILE_COLUMNS if c in users.columns] + (["pic"] if with_picture else [])
    walls = resource_counts(resources, "walluserid").withColumnRenamed("walluserid", "owner")
    profiles = (
        users.select(F.col("userid").alias("owner"), *shown)
        .join(list_sizes(edges), "owner", "left")
        .join(walls, "owner", "left")
    )
    own = F.col("requester") == F.col("owner")
    return requests.select("requester", "owner").join(profiles, "owner").select(
        "requester",
        *shown,
        F.coalesce("n_confirmed", F.lit(0)).alias("friendcount"),
        F.when(own, F.coalesce("n_pending", F.lit(0))).alias("pendingcount"),
        F.coalesce("resourcecount", F.lit(0)).alias("resourcecount"),
    )


TOP_SHARES = 16


def top_k_resources(requests: DataFrame, resources: DataFrame, k: int | str) -> DataFrame:
    """For each requested owner, the ``k`` newest resources on its wall; ``k`` is a number or a column of the requests.

    A number is cut off before the shuffle, so a wall with very many resources sends k rows per task. A column gives every
    wall a cut of its own, the most that its own requests want: walls are ranked in ``TOP_SHARES`` shares first, so that one
    of very many resources is no single task's, and what is left of the shares is ranked again. What others ask for changes
    nothing. Resources with one rid on a wall are ranked in any order.
    """
    asked = requests.withColumnRenamed("owner", "walluserid")
    newest = Window.partitionBy("walluserid").orderBy(F.desc("rid"))
    if isinstance(k, int):
        walls = asked.select("walluserid").distinct()
        found = resources.join(walls, "walluserid", "left_semi").withColumn("place", F.row_number().over(newest))
        return asked.join(found.where(F.col("place") <= k), "walluserid")
    walls = asked.groupBy("walluserid").agg(F.max(k).alias("_most")).where("_most > 0")
    rows = resources.join(walls, "walluserid").withColumn("_share", F.pmod(F.xxhash64("rid"), F.lit(TOP_SHARES)))
    in_share = Window.partitionBy("walluserid", "_share").orderBy(F.desc("rid"))
    rows = rows.withColumn("place", F.row_number().over(in_share)).where("place <= _most")
    rows = rows.withColumn("place", F.row_number().over(newest)).where("place <= _most").drop("_share", "_most")
    return asked.join(rows, "walluserid").where(F.col("place") <= F.col(k))


def resources_of_user(requests: DataFrame, resources: DataFrame, by: str = "creatorid") -> DataFrame:
    """For each requested owner, the resources it created (or, by ``walluserid``, has on its wall).

    All rows are in the order of owners, newest first for each, from the first partition to the last. Bounds are sampled by
    (owner, rid), so an owner of very many resources takes several partitions in a row.
    """
    found = requests.select("owner").join(resources.withColumn("owner", F.col(by)), "owner")
    order = ["owner", F.desc("rid")]
    return found.repartitionByRange(*order).sortWithinPartitions(*order)


def comments_on_resource(resource_ids: DataFrame, manipulations: DataFrame) -> DataFrame:
    """The comments on each requested resource."""
    return resource_ids.select("rid").join(manipulations, "rid")


def post_comments(manipulations: DataFrame, new: DataFrame) -> DataFrame:
    """Manipulations with the new comments: ``creatorid`` is the resource's creator, ``modifierid`` the commenter."""
    posted = new.select(
        "mid",
        F.col("resource_creator").alias("creatorid"),
        "rid",
        F.col("comment_creator").alias("modifierid"),
        "timestamp",
        "type",
        "content",
    )
    return manipulations.unionByName(posted)


def delete_comments(manipulations: DataFrame, deletes: DataFrame) -> DataFrame:
    """Manipulations without those named by (mid, rid, creatorid); deletes with negative ids are refused."""
    ok, _ = guard_ids(deletes, REFUSED_BY["delete_comments"])
    return manipulations.join(ok.select("mid", "rid", "creatorid"), ["mid", "rid", "creatorid"], "left_anti")


def initial_stats(users: DataFrame, edges: DataFrame, resources: DataFrame, sample_user: bool = False) -> DataFrame:
    """One row: number of users, and friends, pending requests and resources per user.

    With ``sample_user`` the last three are those of the user with the lowest id instead of averages.
    """
    counted = (
        users.select(F.col("userid").alias("owner"))
        .join(list_sizes(edges), "owner", "left")
        .join(resource_counts(resources, "creatorid").withColumnRenamed("creatorid", "owner"), "owner", "left")
        .na.fill(0, ["n_confirmed", "n_pending", "resourcecount"])
    )

    def per_user(name: str) -> Column:
        return (F.min_by(name, "owner") if sample_user else F.avg(name)).cast("double")

    return counted.agg(
        F.count("*").alias("usercount"),
        per_user("n_confirmed").alias("avgfriendsperuser"),
        per_user("n_pending").alias("avgpendingperuser"),
        per_user("resourcecount").alias("resourcesperuser"),
    )


def first_user(users: DataFrame) -> DataFrame:
    """The user with the lowest id."""
    return users.orderBy("userid").limit(1)
