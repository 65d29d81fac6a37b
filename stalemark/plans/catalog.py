"""One query per operator, over the driver's tables (see ``bindings``). Arrays are returned as comma-joined text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stalemark.functions.columns import is_resource_key, is_user_key
from stalemark.operators import friendship, matching, social, states
from stalemark.operators.slices import measure_slices
from stalemark.plans import bindings, validate
from stalemark.schemas import INITIAL, ITEM
from stalemark.session import register_written, shared_folder
from stalemark.sources import entities, logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
INTERVAL = (*ITEM, "start_ns", "end_ns")


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def text(array: str | Column) -> Column:
    return F.array_join(F.transform(array, lambda v: v.cast("string")), ",")


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bindings.reads(spark, sf_dir), bindings.updates(spark, sf_dir)


# ------------------------------------------------------------- scans, parsing, sinks


@query
def union_logs(spark, sf_dir):
    return logs.union_logs(bindings.read_lines(spark, sf_dir), bindings.update_lines(spark, sf_dir))


@query
def parse_logs(spark, sf_dir):
    return logs.parse_logs(union_logs(spark, sf_dir))[0]


@query
def parse_rejects(spark, sf_dir):
    return logs.parse_logs(union_logs(spark, sf_dir))[1]


@query
def classify_key(spark, sf_dir):
    # Comments stand in for the third attribute, whose key is a resource.
    items = (
        bindings.reads(spark, sf_dir)
        .select("key", "attribute")
        .unionByName(bindings.resources(spark, sf_dir).select(F.col("rid").alias("key"), F.lit("POSTCOMMENT").alias("attribute")))
    )
    kinds = logs.classify_key(items).withColumns(
        {"is_user": is_user_key(F.col("key_type")), "is_resource": is_resource_key(F.col("key_type"))}
    )
    return kinds.groupBy("attribute", "key_type", "is_user", "is_resource").agg(F.count("*").alias("n"))


@query
def load_users(spark, sf_dir):
    raw = bindings.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("address"),
        F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") % 5000).cast("int")), "yyyy/MM/dd").alias("jdate"),
        F.encode("c_name", "UTF-8").alias("PIC"),
    )
    users = entities.load_entities(raw, "users")
    return users.select(
        "userid", "username", "address", "jdate", "dob", text("ConfFriends").alias("conf"), text("PendFriends").alias("pend"),
        F.lit(len(users.columns)).alias("n_columns"),
    )


@query
def load_users_with_image(spark, sf_dir):
    raw = bindings.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.encode("c_name", "UTF-8").alias("PIC")
    )
    users = entities.load_entities(raw, "users", insert_image=True)
    return users.select("userid", F.decode("pic", "UTF-8").alias("pic"))


@query
def load_resources(spark, sf_dir):
    raw = bindings.resources(spark, sf_dir).select(
        F.col("rid").cast("string").alias("entity_id"),
        F.col("creatorid").cast("string").alias("creatorid"),
        F.col("walluserid").cast("string").alias("walluserid"),
        "type",
        "body",
    )
    return entities.load_entities(raw, "resources")


@query
def load_manipulations(spark, sf_dir):
    raw = bindings.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("entity_id"),
        F.col("l_orderkey").cast("string").alias("rid"),
        F.col("l_suppkey").cast("string").alias("modifierid"),
        F.date_format("l_shipdate", "yyyy/MM/dd HH:mm:ss").alias("timestamp"),
        F.col("l_returnflag").alias("type"),
    )
    loaded = entities.load_entities(raw, "manipulations")
    return loaded.withColumn("timestamp", F.unix_seconds("timestamp"))


@query
def report_sink(spark, sf_dir):
    reads, updates = both(spark, sf_dir)
    return validate.report_lines(validate.report_of(reads, updates, "running_value"))


def _log_folder(spark, sf_dir):
    folder = shared_folder(spark, "logs")
    register_written(folder)
    bindings.read_lines(spark, sf_dir).write.text(f"{folder}/read_log")
    bindings.update_lines(spark, sf_dir).write.text(f"{folder}/update_log")
    return folder


@query
def scan_logs(spark, sf_dir):
    return logs.scan_logs(spark, _log_folder(spark, sf_dir), "update").select("value")


@query
def scan_read_logs(spark, sf_dir):
    found = logs.scan_logs(spark, _log_folder(spark, sf_dir), "read")
    return found.select("value", F.col("file").startswith("part-").alias("is_part"))


@query
def report_directory_running(spark, sf_dir):
    return validate.report_directory(spark, _log_folder(spark, sf_dir), "running_value")


@query
def report_directory_possible(spark, sf_dir):
    return validate.report_directory(spark, _log_folder(spark, sf_dir), "possible_set")


@query
def report_directory_rejects(spark, sf_dir):
    return validate.report_directory(spark, _log_folder(spark, sf_dir), "running_value", with_rejects=True)


# ------------------------------------------------- projections, filters, predicates


@query
def filter_validatable(spark, sf_dir):
    reads = bindings.reads(spark, sf_dir)
    comments = bindings.resources(spark, sf_dir).select(F.col("rid").alias("seq_id"), F.lit("POSTCOMMENT").alias("attribute"))
    return validate.filter_validatable(reads.select("seq_id", "attribute").unionByName(comments))


@query
def filter_attribute(spark, sf_dir):
    return validate.filter_attribute(bindings.updates(spark, sf_dir), "PENDFRND").select("seq_id", "attribute", "op")


@query
def project_intervals(spark, sf_dir):
    return validate.project_intervals(bindings.updates(spark, sf_dir), "op")


@query
def split_intervals(spark, sf_dir):
    # Reads seen backwards: every one of them is rejected, the updates are kept.
    reads, updates = both(spark, sf_dir)
    backwards = reads.select(*ITEM, F.col("end_ns").alias("start_ns"), F.col("start_ns").alias("end_ns"), "seq_id")
    ok, rejects = validate.split_intervals(backwards.unionByName(updates.select(*INTERVAL, "seq_id")), closed=False)
    return ok.withColumn("reason", F.lit("")).unionByName(rejects)


@query
def select_fields(spark, sf_dir):
    return social.select_fields(bindings.users(spark, sf_dir))


@query
def point_lookup(spark, sf_dir):
    wanted = bindings.requests(spark, sf_dir).select(F.col("requester").alias("userid"), "owner")
    return social.lookup_users(wanted, bindings.users(spark, sf_dir))


@query
def guard_ids(spark, sf_dir):
    shifted = bindings.requests(spark, sf_dir).select((F.col("requester") - 100).alias("requester"), "owner")
    ok, refused = social.guard_ids(shifted, ["requester", "owner"])
    return ok.withColumn("status", F.lit("SUCCESS")).unionByName(refused)


@query
def contains_point(spark, sf_dir):
    reads, updates = both(spark, sf_dir)
    points = reads.select(*ITEM, F.col("start_ns").alias("at_ns"), F.col("seq_id").alias("read_id"))
    spans = updates.select(*INTERVAL, F.col("seq_id").alias("update_id"))
    slices = measure_slices([reads, updates])
    return matching.contains_point(points, "at_ns", spans, slices=slices).select("read_id", "update_id")


@query
def intersects(spark, sf_dir):
    updates = bindings.updates(spark, sf_dir).select(*INTERVAL, "seq_id")
    bounds = matching.interval_bounds(updates)
    return updates.join(bounds, list(ITEM)).select(
        "seq_id",
        matching.overlapping("", "lowest_", closed=True).alias("meets_lowest"),
        matching.overlapping("", "highest_", closed=True).alias("meets_highest"),
        matching.overlapping("", "lowest_", closed=False).alias("overlaps_lowest"),
    )


@query
def valid_only(spark, sf_dir):
    return validate.valid_only(validate.validate_reads(*both(spark, sf_dir), "possible_set")).select("seq_id", "value")


@query
def stale_only(spark, sf_dir):
    return validate.stale_only(validate.validate_reads(*both(spark, sf_dir), "running_value")).select("seq_id", "value")


# ---------------------------------------------------------------------------- joins


@query
def attach_updates(spark, sf_dir):
    return validate.attach_updates(*both(spark, sf_dir)).select("seq_id", *ITEM, "n_updates")


def _overlap(spark, sf_dir, closed):
    reads, updates = both(spark, sf_dir)
    left = reads.select(*INTERVAL, F.col("seq_id").alias("read_id"))
    right = updates.select(*INTERVAL, "seq_id", "op")
    pairs = matching.overlap_join(left, right, closed, slices=measure_slices([reads, updates]))
    return pairs.select("read_id", "update_seq_id", "update_start_ns", "update_end_ns", "update_op")


@query
def overlap_join_half_open(spark, sf_dir):
    return _overlap(spark, sf_dir, closed=False)


@query
def overlap_join_closed(spark, sf_dir):
    return _overlap(spark, sf_dir, closed=True)


@query
def overlap_values_closed(spark, sf_dir):
    reads, updates = both(spark, sf_dir)
    slices = measure_slices([reads, updates])
    cells = states.value_cells(states.running_value(updates, slices))
    return matching.values_at(reads, cells, slices, closed=True).select(*INTERVAL, text("possible").alias("found"))


@query
def any_overlap(spark, sf_dir):
    reads, updates = both(spark, sf_dir)
    slices = measure_slices([reads, updates])
    return matching.any_overlap(reads, updates, closed=True, slices=slices).select("seq_id", *INTERVAL)


@query
def search_overlap(spark, sf_dir):
    reads, updates = both(spark, sf_dir)
    return matching.search_overlap(reads, updates, closed=True, slices=measure_slices([reads, updates]))


@query
def interval_lookup(spark, sf_dir):
    reads, updates = both(spark, sf_dir)
    values = states.running_value(updates, measure_slices([updates]))
    return matching.interval_lookup(reads.select(*INTERVAL, "seq_id"), values)


@query
def interval_delete(spark, sf_dir):
    reads, updates = both(spark, sf_dir)
    values = states.running_value(updates, measure_slices([updates]))
    return matching.interval_delete(values, reads).select(*INTERVAL, "value")


def _neighborhood(updates, semantics):
    closed = semantics == "running_value"
    slices = measure_slices([updates])
    after = validate.update_states(updates, semantics, slices, INITIAL)
    cells = states.value_cells(after) if closed else states.set_cells(after)
    return matching.values_at(after, cells, slices, closed).select(*INTERVAL, text("possible").alias("around"))


@query
def neighborhood_running(spark, sf_dir):
    return _neighborhood(bindings.updates(spark, sf_dir), "running_value")


@query
def neighborhood_possible(spark, sf_dir):
    return _neighborhood(bindings.updates(spark, sf_dir), "possible_set")


def _state_before(spark, sf_dir, semantics):
    before = validate.state_before(*both(spark, sf_dir), semantics)
    return before.select(*INTERVAL, text("possible_values").alias("state"))


@query
def state_before_possible(spark, sf_dir):
    return _state_before(spark, sf_dir, "possible_set")


@query
def state_before_running(spark, sf_dir):
    return _state_before(spark, sf_dir, "running_value")


# --------------------------------------------------------------------- aggregations


@query
def group_by_item(spark, sf_dir):
    grouped = friendship.group_by_item(bindings.updates(spark, sf_dir), ITEM, ["start_ns", "end_ns", "seq_id", "op"])
    entry = F.transform("entries", lambda e: F.concat_ws(":", e["start_ns"], e["end_ns"], e["seq_id"], e["op"]))
    return grouped.select(*ITEM, "part", F.array_join(entry, ",").alias("entries"))


@query
def merge_same_interval(spark, sf_dir):
    return states.merge_same_interval(bindings.updates(spark, sf_dir))


@query
def dedup_interval_last(spark, sf_dir):
    return matching.dedup_interval_last(bindings.updates(spark, sf_dir)).select(*INTERVAL, "seq_id", "op")


@query
def lowest_interval(spark, sf_dir):
    return matching.interval_bounds(bindings.updates(spark, sf_dir)).select(*ITEM, "lowest_start_ns", "lowest_end_ns")


@query
def highest_interval(spark, sf_dir):
    return matching.interval_bounds(bindings.updates(spark, sf_dir)).select(*ITEM, "highest_start_ns", "highest_end_ns")


@query
def interval_count(spark, sf_dir):
    return matching.interval_count(bindings.updates(spark, sf_dir))


def _possible_values(spark, sf_dir, semantics):
    values = validate.possible_values(*both(spark, sf_dir), semantics)
    return values.select(*INTERVAL, text("possible_values").alias("possible_values"))


@query
def possible_values_possible(spark, sf_dir):
    return _possible_values(spark, sf_dir, "possible_set")


@query
def possible_values_running(spark, sf_dir):
    return _possible_values(spark, sf_dir, "running_value")


def _possible_runs(spark, sf_dir, semantics):
    runs = validate.possible_runs(*both(spark, sf_dir), semantics)
    shown = F.transform("runs", lambda r: F.concat_ws(":", r["low"].cast("string"), r["high"].cast("string")))
    return runs.select(*INTERVAL, F.array_join(shown, ",").alias("runs"), states.run_size("runs").alias("n_values"))


@query
def possible_runs_possible(spark, sf_dir):
    return _possible_runs(spark, sf_dir, "possible_set")


@query
def possible_runs_running(spark, sf_dir):
    return _possible_runs(spark, sf_dir, "running_value")


@query
def runs_hold_reads(spark, sf_dir):
    # The verdict by membership in the run-encoded set, next to the two sets of an item's first and last read united.
    reads, updates = both(spark, sf_dir)
    runs = validate.possible_runs(reads, updates, "possible_set")
    judged = reads.join(runs, list(INTERVAL)).withColumn("valid", states.run_holds("runs", F.col("value").cast("long")))
    time = F.struct("start_ns", "end_ns", "seq_id")
    ends = judged.groupBy(*ITEM).agg(
        F.count_if("valid").alias("n_valid"), F.min_by("runs", time).alias("first"), F.max_by("runs", time).alias("last")
    )
    either = states.run_union("first", "last")
    return ends.select(*ITEM, "n_valid", text(states.run_values(either)).alias("first_or_last"))


@query
def validate_reads_possible(spark, sf_dir):
    judged = validate.validate_reads(*both(spark, sf_dir), "possible_set")
    return judged.select("seq_id", *INTERVAL, "value", "valid")


@query
def validate_reads_running(spark, sf_dir):
    judged = validate.validate_reads(*both(spark, sf_dir), "running_value")
    return judged.select("seq_id", *INTERVAL, "value", "valid")


@query
def refused_reads(spark, sf_dir):
    # Some reads lose their value, some run backwards, some are of an attribute that isn't validated.
    reads, k = bindings.reads(spark, sf_dir), F.col("seq_id") % 20
    spoiled = reads.select(
        "seq_id",
        "key",
        F.when(k == 3, "POSTCOMMENT").otherwise(F.col("attribute")).alias("attribute"),
        F.when(k == 5, F.col("end_ns")).otherwise(F.col("start_ns")).alias("start_ns"),
        F.when(k == 5, F.col("start_ns")).when(k == 9, None).otherwise(F.col("end_ns")).alias("end_ns"),
        F.when(k != 7, F.col("value")).alias("value"),
    )
    ok, refused = validate.split_reads(spoiled, "possible_set")
    return ok.withColumn("reason", F.lit("")).unionByName(refused).select("seq_id", "value", "reason")


def _report(spark, sf_dir, semantics):
    return validate.report_of(*both(spark, sf_dir), semantics)


@query
def staleness_report_possible(spark, sf_dir):
    return _report(spark, sf_dir, "possible_set")


@query
def staleness_report_running(spark, sf_dir):
    return _report(spark, sf_dir, "running_value")


@query
def update_counts(spark, sf_dir):
    return validate.update_counts(*both(spark, sf_dir))


@query
def resource_count_by_wall(spark, sf_dir):
    return social.resource_counts(bindings.resources(spark, sf_dir), "walluserid")


@query
def resource_count_by_creator(spark, sf_dir):
    return social.resource_counts(bindings.resources(spark, sf_dir), "creatorid")


# -------------------------------------------------------------- windows and ordering


@query
def running_value(spark, sf_dir):
    updates = bindings.updates(spark, sf_dir)
    return states.running_value(updates, measure_slices([updates])).select(*INTERVAL, "value")


@query
def possible_set_states(spark, sf_dir):
    updates = bindings.updates(spark, sf_dir)
    after = states.possible_set_states(updates, measure_slices([updates]))
    return after.select(*INTERVAL, text(states.state_values()).alias("possible"))


@query
def prefix_max_end(spark, sf_dir):
    updates = bindings.updates(spark, sf_dir)
    return matching.sort_intervals(updates, measure_slices([updates])).select(*INTERVAL, "max_end")


@query
def sort_intervals(spark, sf_dir):
    updates = bindings.updates(spark, sf_dir)
    return matching.sort_intervals(updates, measure_slices([updates])).select(*INTERVAL, "position")


@query
def latest_end_first(spark, sf_dir):
    reads, updates = both(spark, sf_dir)
    spans = reads.select(*INTERVAL).distinct()
    return matching.anchor_possible(spans, updates, measure_slices([reads, updates]))


# ------------------------------------------------------------------------ the graph


def _edges(spark, sf_dir):
    return friendship.apply_friendship_ops(bindings.no_edges(spark), bindings.friendship_ops(spark, sf_dir))


def _requests(spark, sf_dir):
    return bindings.requests(spark, sf_dir)


@query
def view_profile(spark, sf_dir):
    return social.view_profile(
        _requests(spark, sf_dir), bindings.users(spark, sf_dir), _edges(spark, sf_dir), bindings.resources(spark, sf_dir)
    )


@query
def list_friends(spark, sf_dir):
    return social.list_friends(_requests(spark, sf_dir), bindings.users(spark, sf_dir), _edges(spark, sf_dir))


@query
def view_friend_requests(spark, sf_dir):
    return social.view_friend_requests(_requests(spark, sf_dir), bindings.users(spark, sf_dir), _edges(spark, sf_dir))


@query
def list_friends_with_thumbnail(spark, sf_dir):
    users = bindings.users(spark, sf_dir).withColumn("tpic", F.reverse("username"))
    return social.list_friends(_requests(spark, sf_dir), users, _edges(spark, sf_dir), ["address"], with_thumbnail=True)


@query
def view_profile_with_picture(spark, sf_dir):
    users = bindings.users(spark, sf_dir).withColumn("pic", F.reverse("username"))
    requests, resources = _requests(spark, sf_dir), bindings.resources(spark, sf_dir)
    shown = social.view_profile(requests, users, _edges(spark, sf_dir), resources, with_picture=True)
    return shown.select("requester", "userid", "pic", "friendcount")


@query
def refused_requests(spark, sf_dir):
    shifted = _requests(spark, sf_dir).select((F.col("requester") - 40).alias("requester"), "owner")
    users, edges = bindings.users(spark, sf_dir), _edges(spark, sf_dir)
    answered = social.list_friends(shifted, users, edges).groupBy("requester", "owner").agg(F.count("userid").alias("n"))
    refused = social.refused("list_friends", shifted).withColumn("n", F.lit(None).cast("bigint"))
    return answered.withColumn("status", F.lit("SUCCESS")).unionByName(refused)


@query
def pending_ids(spark, sf_dir):
    members = _requests(spark, sf_dir).select(F.col("owner").alias("member"))
    return social.friend_ids(members, _edges(spark, sf_dir), social.PENDING)


@query
def confirmed_ids(spark, sf_dir):
    members = _requests(spark, sf_dir).select(F.col("owner").alias("member"))
    return social.friend_ids(members, _edges(spark, sf_dir), social.CONFIRMED)


@query
def top_k_resources(spark, sf_dir):
    top = social.top_k_resources(_requests(spark, sf_dir).drop("k"), bindings.resources(spark, sf_dir), 3)
    return top.withColumn("place", F.col("place").cast("int"))


@query
def top_k_resources_per_request(spark, sf_dir):
    top = social.top_k_resources(_requests(spark, sf_dir), bindings.resources(spark, sf_dir), "k")
    return top.select("walluserid", "k", "rid", "place")


@query
def resources_of_user(spark, sf_dir):
    return social.resources_of_user(_requests(spark, sf_dir), bindings.resources(spark, sf_dir))


@query
def resources_on_wall(spark, sf_dir):
    return social.resources_of_user(_requests(spark, sf_dir), bindings.resources(spark, sf_dir), by="walluserid")


@query
def comments_on_resource(spark, sf_dir):
    wanted = bindings.resources(spark, sf_dir).where("body = 'P'")
    return social.comments_on_resource(wanted, bindings.manipulations(spark, sf_dir))


@query
def post_comments(spark, sf_dir):
    # Every supplier comments on the resource that has its number.
    suppliers = bindings.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("new-"), F.col("s_suppkey").cast("string")).alias("mid"),
        F.col("s_suppkey").alias("rid"),
        F.col("s_suppkey").alias("comment_creator"),
        F.lit("2024-01-01").cast("date").alias("timestamp"),
        F.lit("N").alias("type"),
        F.col("s_name").alias("content"),
    )
    creators = bindings.resources(spark, sf_dir).select("rid", F.col("creatorid").alias("resource_creator"))
    return social.post_comments(bindings.manipulations(spark, sf_dir), suppliers.join(creators, "rid"))


@query
def delete_comments(spark, sf_dir):
    # Returned comments are deleted; where the supplier's number is odd, under a creator that is not theirs.
    comments = bindings.manipulations(spark, sf_dir)
    deletes = comments.where("type = 'R'").select(
        "mid", "rid", F.when(F.col("modifierid") % 2 == 1, F.col("creatorid") + 1).otherwise(F.col("creatorid")).alias("creatorid")
    )
    return social.delete_comments(comments, deletes)


@query
def initial_stats(spark, sf_dir):
    return social.initial_stats(bindings.users(spark, sf_dir), _edges(spark, sf_dir), bindings.resources(spark, sf_dir))


@query
def initial_stats_sample_user(spark, sf_dir):
    return social.initial_stats(
        bindings.users(spark, sf_dir), _edges(spark, sf_dir), bindings.resources(spark, sf_dir), sample_user=True
    )


@query
def first_user(spark, sf_dir):
    return social.first_user(bindings.users(spark, sf_dir))


# ------------------------------------------------------------- friendship operations


@query
def apply_friendship_ops(spark, sf_dir):
    return _edges(spark, sf_dir)


@query
def refused_friendship_ops(spark, sf_dir):
    return friendship.accepted_ops(bindings.friendship_ops(spark, sf_dir))[1]


def _applied(spark, sf_dir, op):
    """The operations of one kind, applied to what all the others leave."""
    ops = bindings.friendship_ops(spark, sf_dir)
    others = friendship.apply_friendship_ops(bindings.no_edges(spark), ops.where(F.col("op") != op))
    return friendship.apply_friendship_ops(others, ops.where(F.col("op") == op))


@query
def op_invite(spark, sf_dir):
    return _applied(spark, sf_dir, "invite")


@query
def op_accept(spark, sf_dir):
    return _applied(spark, sf_dir, "accept")


@query
def op_reject(spark, sf_dir):
    return _applied(spark, sf_dir, "reject")


@query
def op_thaw(spark, sf_dir):
    return _applied(spark, sf_dir, "thaw")


@query
def create_friendship(spark, sf_dir):
    accepts = bindings.friendship_ops(spark, sf_dir).where("op = 'accept'")
    return friendship.apply_friendship_ops(bindings.no_edges(spark), accepts)


@query
def count_friendship_ops(spark, sf_dir):
    return friendship.count_friendship_ops(bindings.no_edges(spark), bindings.friendship_ops(spark, sf_dir))


@query
def friend_lists(spark, sf_dir):
    lists = friendship.friend_lists(_edges(spark, sf_dir))
    return lists.select("owner", "part", text("ConfFriends").alias("conf"), text("PendFriends").alias("pend"))
