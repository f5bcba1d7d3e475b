"""The mailbox reader: nothing twice, new validities from the start, late and clamped uids left, restarts from the checkpoint."""

from __future__ import annotations

import pytest

from millrace.sources.mailbox import MailboxReader, read_mailboxes, store_messages

KIND = "mailbox string, validity long, uid long, raw string"


@pytest.fixture
def mail(spark, tmp_path):
    path, out = str(tmp_path / "mail"), str(tmp_path / "out")

    def put(*rows):
        store_messages(spark.createDataFrame([(m, v, u, f"{m}/{v}/{u}") for m, v, uids in rows for u in uids], KIND), path)

    def read():
        return sorted((r.mailbox, r.validity, r.uid) for r in read_mailboxes(spark, path, out, most=2).collect())

    return path, put, read


def test_only_what_is_new(mail):
    _, put, read = mail
    put(("a", 1, [1, 2, 2500, 7999]), ("b", 5, [10]))
    first = read()
    assert first == [("a", 1, 1), ("a", 1, 2), ("a", 1, 2500), ("a", 1, 7999), ("b", 5, 10)]
    assert read() == first  # nothing is new, nothing comes twice
    put(("a", 1, [8000, 8001, 5]), ("c", 1, [3]))  # 5 comes late, below the cursor
    second = read()
    assert sorted(set(second) - set(first)) == [("a", 1, 8000), ("a", 1, 8001), ("c", 1, 3)] and len(second) == len(first) + 3
    put(("a", 2, [1, 2]), ("a", 1, [9000]))  # a new validity starts anew, the old one is gone
    third = read()
    assert sorted(set(third) - set(second)) == [("a", 2, 1), ("a", 2, 2)]
    put(("a", 2, [3]), ("b", 4, [99]))  # a lower validity isn't live
    assert sorted(set(read()) - set(third)) == [("a", 2, 3)]


def test_ranges_are_replayed_alike_and_clamped(mail):
    path, put, _ = mail
    put(("a", 1, [1, 999, 1000, 4000]))
    reader = MailboxReader({"path": path, "most": "1"})
    end = reader.latestOffset()
    assert end == {"a": [1, 4000]}
    take = lambda start, stop: sorted(m[2] for p in reader.partitions(start, stop) for m in reader.read(p))
    assert take({}, end) == take({}, end) == [1, 999, 1000, 4000]
    put(("a", 1, [998, 5000]))
    assert take({"a": [1, 1]}, {"a": [1, 1000]}) == [998, 999, 1000]  # by the offsets, whatever has come since
    assert take({"a": [1, 4000]}, end) == [] and take({"a": [1, 9999]}, {"a": [1, 5000]}) == []  # the newest message isn't read again
    assert take({"a": [0, 4000]}, end) == [1, 998, 999, 1000, 4000]
    assert len(reader.partitions({}, reader.latestOffset())) == 4
    assert MailboxReader({"path": path + "/none"}).latestOffset() == {}


def test_raw_text_comes_whole(spark, mail):
    path, put, read = mail
    store_messages(spark.createDataFrame([("a", 1, 1, "Subject: ü\r\n\r\nline\n  \"quoted\" \\ " + "x" * 100_000)], KIND), path)
    read()
    assert len(list(MailboxReader({"path": path}).read(MailboxReader({"path": path}).partitions({}, {"a": [1, 1]})[0]))[0][3]) > 100_000


def test_wide_blocks_are_few_files(spark, tmp_path):
    """Two thin mailboxes that share their uids: a file each, not one a thousand uids, and the same messages."""
    path, out = tmp_path / "mail", str(tmp_path / "out")
    rows = spark.range(1, 60_001, 100).selectExpr("cast(id % 2 as string) as mailbox", "1L as validity", "id as uid", "'one two\\nthree' as raw")
    store_messages(rows.selectExpr("cast(uid div 100 % 2 as string) as mailbox", "validity", "uid", "raw"), str(path), 50_000)
    assert len(list(path.rglob("*.json"))) == 4
    reader = MailboxReader({"path": str(path), "most": "1", "block": "50000"})
    assert reader.latestOffset() == {"0": [1, 59_801], "1": [1, 59_901]}
    assert [len(list(reader.read(p))) for p in reader.partitions({"0": [1, 49_801]}, {"0": [1, 59_801]})] == [0, 50]
    got = read_mailboxes(spark, str(path), out, block=50_000)
    assert got.count() == 600 and got.select("raw").distinct().collect()[0][0] == "one two\nthree"
