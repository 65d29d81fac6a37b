from datetime import date, datetime

from stalemark.schemas import LOG
from stalemark.sources import entities, logs

# Sample lines of both kinds.
READ = "READ,ACCEPTFRND,70,2,555,1000000,1000900,12,GetProfile"
UPDATE = "UPDATE,ACCEPTFRND,71,3,556,1000200,1000700,1,I,AcceptFriend"


def test_parse(spark):
    lines = [
        READ,
        " " + UPDATE + "\t\r",
        "READ,PENDFRND,1,2,3,4,5,6",
        READ + ",x,y",
        "",
        READ.replace("555", "5s5"),
        READ.replace(",12,", ",99999999999,"),
        READ.replace("1000900", "5"),
        READ.replace("1000000", "1000900"),
    ]
    parsed, rejects = logs.parse_logs(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert parsed.schema.names == LOG.names
    assert [f.dataType for f in parsed.schema] == [f.dataType for f in LOG]
    rows = {(r.log_type, r.start_ns == r.end_ns): r for r in parsed.collect()}
    assert len(rows) == 3
    assert tuple(rows["READ", False]) == (
        "READ", "ACCEPTFRND", 70, 2, 555, 1_000_000, 1_000_900, 12, "N", "GetProfile"
    )
    assert tuple(rows["UPDATE", False])[7:] == (1, "I", "AcceptFriend")
    reasons = sorted((r.reason, r.value) for r in rejects.collect())
    assert [r for r, _ in reasons] == ["bad_number"] * 2 + ["field_count"] * 3 + ["start_after_end"]


def test_scan_picks_files_by_kind(spark, tmp_path):
    (tmp_path / "read-1.txt").write_text(READ + "\n" + READ + "\n")
    (tmp_path / "read-2.txt").write_text(READ + "\n")
    (tmp_path / "update-1.txt").write_text(UPDATE + "\n")
    (tmp_path / "thread-1.txt").write_text("not a log\n")
    found = logs.scan_logs(spark, str(tmp_path), "read")
    assert sorted(r.file for r in found.collect()) == ["read-1.txt", "read-1.txt", "read-2.txt"]
    assert logs.scan_logs(spark, f"{tmp_path}/", "update").count() == 1
    both = logs.union_logs(found, logs.scan_logs(spark, str(tmp_path), "update"))
    assert both.count() == 4


def test_classify(spark):
    df = spark.createDataFrame([("ACCEPTFRND",), ("POSTCOMMENT",)], "attribute string")
    assert {r.attribute: r.key_type for r in logs.classify_key(df).collect()} == {
        "ACCEPTFRND": "userID",
        "POSTCOMMENT": "resourceID",
    }


def test_load_entities(spark, tmp_path):
    raw = spark.createDataFrame(
        [("7", "ann", "2001/02/03", "no date", b"\x01", "extra")],
        "entity_id string, UserName string, dob string, jdate string, PIC binary, hobby string",
    )
    users = entities.load_entities(raw, "users")
    row = users.collect()[0]
    assert (row.userid, row.username, row.dob, row.jdate, row.ConfFriends, row.hobby) == (
        7, "ann", date(2001, 2, 3), None, [], "extra"
    )
    assert "pic" not in users.columns and "tpic" not in users.columns
    assert bytes(entities.load_entities(raw, "users", insert_image=True).collect()[0].pic) == b"\x01"
    entities.write_entities(users, str(tmp_path / "users"))
    entities.write_entities(users, str(tmp_path / "users"))
    assert spark.read.parquet(str(tmp_path / "users")).count() == 1

    raw = spark.createDataFrame([("1", "5", "2001/02/03 04:05:06")], "entity_id string, rid string, timestamp string")
    row = entities.load_entities(raw, "manipulations").collect()[0]
    assert (row.mid, row.rid, row.timestamp, row.content) == (1, 5, datetime(2001, 2, 3, 4, 5, 6), None)
