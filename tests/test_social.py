import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stalemark.operators import friendship, social
from stalemark.operators.slices import measure_slices


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def graph(spark):
    users = frame(spark, [(1, "ann", None), (2, "bob", "x"), (3, "cy", "y")], "userid bigint, username string, address string")
    edges = frame(
        spark,
        [(1, 2, "confirmed"), (2, 1, "confirmed"), (1, 3, "pending"), (1, 99, "confirmed"), (3, 1, "confirmed")],
        "owner bigint, other bigint, kind string",
    )
    resources = frame(
        spark,
        [(r, 1 + r % 2, 1 if r < 8 else 2) for r in range(10)],
        "rid bigint, creatorid bigint, walluserid bigint",
    )
    return users, edges, resources


def test_profiles(spark, graph):
    requests = frame(spark, [(1, 1), (2, 1), (1, 3), (1, 77)], "requester bigint, owner bigint")
    rows = social.view_profile(requests, *graph).collect()
    got = {(r.requester, r.userid): (r.friendcount, r.pendingcount, r.resourcecount) for r in rows}
    assert got == {(1, 1): (2, 1, 8), (2, 1): (2, None, 8), (1, 3): (1, None, 0)}
    assert "pw" not in rows[0].asDict()


def test_friend_listings(spark, graph):
    users, edges, _ = graph
    requests = frame(spark, [(1, 1), (-1, 1), (1, 3)], "requester bigint, owner bigint")
    rows = social.list_friends(requests, users, edges).collect()
    # A friend without a profile falls away, a null field stays null, a negative id is refused.
    assert sorted((r.owner, r.userid, r.username, r.address) for r in rows) == [(1, 2, "bob", "x"), (3, 1, "ann", None)]
    rows = social.list_friends(requests, users, edges, fields=["username"]).collect()
    assert rows[0].asDict().keys() == {"requester", "owner", "userid", "username"}
    rows = social.view_friend_requests(requests.select("owner").distinct(), users, edges).collect()
    assert [(r.owner, r.userid) for r in rows] == [(1, 3)]
    members = frame(spark, [(1,), (-3,)], "member bigint")
    assert sorted(r.friend for r in social.friend_ids(members, edges, "confirmed").collect()) == [2, 99]
    assert [r.friend for r in social.friend_ids(members, edges, "pending").collect()] == [3]


def test_guard(spark):
    requests = frame(spark, [(1, 1), (-1, 1), (1, -2), (None, 0)], "requester bigint, owner bigint")
    ok, refused = social.guard_ids(requests, ["requester", "owner"])
    assert ok.count() == 2
    assert {r.status for r in refused.collect()} == {"ERROR"} and refused.count() == 2


def test_edges_of_arrays_and_thumbnails(spark):
    users = frame(
        spark,
        [(1, [2, 2], [3], b"t")],
        "userid int, ConfFriends array<int>, PendFriends array<int>, tpic binary",
    )
    assert sorted(tuple(r) for r in social.edges_of(users).collect()) == [
        (1, 2, "confirmed"), (1, 2, "confirmed"), (1, 3, "pending")
    ]
    assert social.select_fields(users, with_thumbnail=True).columns == ["userid", "PendFriends", "ConfFriends", "tpic"]


def test_top_k(spark, graph):
    resources = graph[2]
    requests = frame(spark, [(5, 1, 2), (6, 1, 9), (7, 2, 1), (8, 9, 4), (9, 2, 0)], "requester bigint, owner bigint, k int")
    rows = social.top_k_resources(requests, resources, 3).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.place):
        got[r.requester].append(r.rid)
    assert got == {5: [7, 6, 5], 6: [7, 6, 5], 7: [9, 8], 9: [9, 8]}
    counts = Counter(r.requester for r in social.top_k_resources(requests, resources, "k").collect())
    assert counts == {5: 2, 6: 8, 7: 1}
    plan = social.top_k_resources(requests, resources, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_top_k_of_one_request_leaves_other_walls_alone(spark):
    resources = spark.range(6000).selectExpr("id AS rid", "id AS creatorid", "IF(id % 3 = 0, id % 20, 1) AS walluserid", "'t' AS type")
    small = frame(spark, [(5, w, 2) for w in range(20)], "requester bigint, owner bigint, k bigint")
    large = small.unionByName(frame(spark, [(6, 1, 10**9), (7, 99, 10**9)], small.schema))

    def run(requests):
        found = social.top_k_resources(requests, resources, "k")
        rows = Counter((r.requester, r.walluserid) for r in found.collect())
        return {w: n for (q, w), n in rows.items() if q == 5}, rows[6, 1]

    walls = Counter(i % 20 if i % 3 == 0 else 1 for i in range(6000))
    assert run(small) == ({w: 2 for w in range(20)}, 0)
    assert run(large) == ({w: 2 for w in range(20)}, walls[1])
    top = [r.rid for r in social.top_k_resources(large, resources, "k").where("requester = 6").orderBy("place").collect()]
    assert top == sorted((i for i in range(6000) if i % 3 or i % 20 == 1), reverse=True)


def test_resources_of_a_hot_owner_take_several_partitions(spark):
    resources = spark.range(20_000).selectExpr("id AS rid", "IF(id % 10 = 0, id % 50, 1) AS creatorid", "0 AS walluserid")
    requests = spark.range(50).selectExpr("id AS owner")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = social.resources_of_user(requests, resources)
        rows = found.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r.owner, r.rid) for r in rows] == sorted(((r.owner, r.rid) for r in rows), key=lambda x: (x[0], -x[1]))
    sizes = Counter(r.part for r in rows)
    assert len(rows) == 20_000 and len(sizes) == 4 and max(sizes.values()) < 2 * 20_000 / 4


def test_resources_and_stats(spark, graph):
    users, edges, resources = graph
    requests = frame(spark, [(2,), (1,)], "owner bigint")
    rows = social.resources_of_user(requests, resources).collect()
    assert [(r.owner, r.rid) for r in rows] == [(1, r) for r in (8, 6, 4, 2, 0)] + [(2, r) for r in (9, 7, 5, 3, 1)]
    assert len(social.resources_of_user(requests, resources, by="walluserid").collect()) == 10
    stats = social.initial_stats(users, edges, resources).collect()[0]
    assert tuple(stats) == (3, pytest.approx(4 / 3), pytest.approx(1 / 3), pytest.approx(10 / 3))
    assert tuple(social.initial_stats(users, edges, resources, sample_user=True).collect()[0]) == (3, 2.0, 1.0, 5.0)
    assert social.first_user(users).collect()[0].userid == 1


def test_comments(spark):
    schema = "mid int, creatorid int, rid int, modifierid int, timestamp date, type string, content string"
    comments = frame(spark, [(1, 10, 5, 20, None, "a", "x"), (2, 10, 5, 21, None, "a", "y"), (3, 11, 6, 20, None, "a", "z")], schema)
    wanted = frame(spark, [(5,)], "rid int")
    assert social.comments_on_resource(wanted, comments).count() == 2
    new = frame(
        spark,
        [(4, 11, 22, 6, None, "a", "new")],
        "mid int, resource_creator int, comment_creator int, rid int, timestamp date, type string, content string",
    )
    posted = social.post_comments(comments, new)
    row = posted.where("mid = 4").collect()[0]
    assert (row.creatorid, row.modifierid, posted.count()) == (11, 22, 4)
    deletes = frame(spark, [(1, 5, 10), (2, 5, 99), (3, -6, 11)], "mid int, rid int, creatorid int")
    left = social.delete_comments(comments, deletes)
    assert sorted(r.mid for r in left.collect()) == [2, 3]  # wrong creator, refused id


OPS = "op_seq bigint, op string, inviter bigint, invitee bigint"
EDGES = "owner bigint, other bigint, kind string"


def lists_after(ops, bag):
    """Two lists per user, edited call by call."""
    lists = {"confirmed": defaultdict(list), "pending": defaultdict(list)}

    def add(kind, owner, other):
        if bag or other not in lists[kind][owner]:
            lists[kind][owner].append(other)

    def drop(kind, owner, other):
        if other in lists[kind][owner]:
            lists[kind][owner].remove(other)

    for _, op, a, b in sorted(ops):
        if op != "invite" and (a < 0 or b < 0):
            continue
        if op == "invite":
            add("pending", b, a)
        elif op == "accept":
            for x, y in ((a, b), (b, a)):
                add("confirmed", x, y)
                drop("pending", x, y)
        elif op == "reject":
            drop("pending", b, a)
        else:
            drop("confirmed", a, b)
            drop("confirmed", b, a)
    return Counter((o, x, kind) for kind in lists for o, xs in lists[kind].items() for x in xs)


def random_ops(seed):
    rng = random.Random(seed)
    ops = []
    for i in range(600):
        a, b = rng.sample(range(-1, 6), 2)
        ops.append((i, rng.choice(["invite", "invite", "accept", "reject", "thaw"]), a, b))
    return ops


def test_friendship_as_sets_and_bags(spark):
    ops = random_ops(1)
    df = frame(spark, ops[::-1], OPS).repartition(3)
    none = frame(spark, [], EDGES)
    edges = friendship.apply_friendship_ops(none, df)
    assert Counter(map(tuple, edges.collect())) == lists_after(ops, bag=False)
    want = lists_after(ops, bag=True)
    hot = measure_slices([friendship.edge_facts(df)], time="op_seq", keys=friendship.EDGE, rows_per_slice=20)
    assert hot
    for slices in (None, hot):
        rows = friendship.count_friendship_ops(none, df, slices).collect()
        assert {(r.owner, r.other, r.kind): r.n for r in rows} == dict(want)
    # In two halves, the second on top of what the first left.
    half = friendship.apply_friendship_ops(none, df.where("op_seq < 300"))
    again = friendship.apply_friendship_ops(half, df.where("op_seq >= 300"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, edges.collect()))


@pytest.mark.parametrize(
    "ops,want",
    [
        (["accept"], {(1, 2, "confirmed"), (2, 1, "confirmed")}),
        (["invite"], {(2, 1, "pending")}),
        (["invite", "accept"], {(1, 2, "confirmed"), (2, 1, "confirmed")}),
        (["invite", "reject"], set()),
        (["accept", "thaw", "thaw"], set()),
        (["accept", "thaw", "invite"], {(2, 1, "pending")}),
    ],
)
def test_friendship_sequences(spark, ops, want):
    df = frame(spark, [(i, op, 1, 2) for i, op in enumerate(ops)], OPS)
    assert {tuple(r) for r in friendship.apply_friendship_ops(frame(spark, [], EDGES), df).collect()} == want


def test_refused_operations(spark):
    df = frame(spark, [(1, "accept", -1, 2), (2, "invite", -1, 2), (3, "thaw", 1, -2), (4, "poke", 1, 2), (5, None, 1, 2), (6, "invite", 3, 3)], OPS)
    ok, refused = friendship.accepted_ops(df)
    assert [r.op_seq for r in ok.collect()] == [2]
    want = [(1, "ERROR"), (3, "ERROR"), (4, "UNKNOWN"), (5, "UNKNOWN"), (6, "SELF")]
    assert sorted((r.op_seq, r.status) for r in refused.collect()) == want


def test_refused_requests(spark):
    asked = frame(spark, [(-1, 2), (1, 2), (1, -2)], "requester bigint, owner bigint")
    assert sorted((r.requester, r.owner, r.status) for r in social.refused("list_friends", asked).collect()) == [(-1, 2, "ERROR"), (1, -2, "ERROR")]
    assert social.refused("view_friend_requests", asked).count() == 1


def test_friend_lists_in_parts(spark):
    edges = frame(spark, [(1, n, "confirmed") for n in range(50)] + [(1, 3, "pending"), (2, 9, "confirmed")], EDGES)
    slices = measure_slices([edges], time="other", keys=["owner", "kind"], rows_per_slice=7)
    rows = friendship.friend_lists(edges, longest=10, slices=slices).collect()
    assert sorted(rows) == sorted(friendship.friend_lists(edges, longest=10).collect())
    hot = sorted((r for r in rows if r.owner == 1), key=lambda r: r.part)
    assert [(r.part, r.ConfFriends) for r in hot] == [(p, list(range(10 * p, 10 * p + 10))) for p in range(5)]
    assert sum((r.PendFriends for r in hot), []) == [3]
    assert [(r.part, r.ConfFriends, r.PendFriends) for r in rows if r.owner == 2] == [(0, [9], [])]
    whole = friendship.friend_lists(edges).collect()
    assert len(whole) == 2
    logs = frame(spark, [(1, "A", 5, 6), (1, "A", 2, 3)], "key bigint, attribute string, start_ns bigint, end_ns bigint")
    grouped = friendship.group_by_item(logs, ["key", "attribute"], ["start_ns", "end_ns"]).collect()
    assert [tuple(e) for e in grouped[0].entries] == [(2, 3), (5, 6)]
