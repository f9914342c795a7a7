import hashlib
import io
import zipfile

import pytest

from riskweave.llm import warc
from riskweave.llm.common import Workspace
from riskweave.llm.queries import ORACLES, QUERIES


class Memory:
    def __init__(self, data):
        self.data = data
        self.reads = []

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        self.reads.append((offset, n))
        return self.data[offset:offset + n]


def make_zip(members, note=b"", before=b"", packed=()):
    out = io.BytesIO(before)
    out.seek(0, 2)
    with zipfile.ZipFile(out, "a" if before else "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data,
                       zipfile.ZIP_DEFLATED if name in packed else zipfile.ZIP_STORED)
        z.comment = note
    return out.getvalue()


MEMBERS = {"a/one": b"x" * 1000, "deep/ünï": b"0123456789", "empty": b"", "packed": b"z" * 99}


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("note", [b"", b"a note", b"PK\x05\x06 in a note" * 30])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 7])
def test_directories(monkeypatch, wide, note, before):
    if wide:  # every size, offset and count goes to the ZIP64 records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", -1)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    data = make_zip(MEMBERS, note, before, packed=("packed",))
    file = Memory(data)
    found = warc.ZipMembers(file)
    assert set(found.members) == set(MEMBERS) - {"packed"}
    for name in found.members:
        assert found.read(name) == MEMBERS[name]
    assert found.read("deep/ünï", 3, 4) == b"3456"
    with pytest.raises(ValueError):
        found.read("deep/ünï", 8, 4)


def test_cut_and_foreign_files():
    data = make_zip(MEMBERS)
    for bad in (b"", b"PK", data[:-5], data[40:100]):
        with pytest.raises(ValueError):
            warc.ZipMembers(Memory(bad))


def test_ranges_only():
    big = {f"m{i}": bytes([i]) * 200_000 for i in range(20)}
    file = Memory(make_zip(big))
    found = warc.ZipMembers(file)
    found.read("m7", 100, 50)
    assert sum(n for _, n in file.reads) < 100_000


@pytest.mark.parametrize("payload", [b"", b"<p>\r\n\r\nx</p>", "é\U0001f600".encode(), b"q" * 500_000])
def test_record_round_trip(payload):
    digest = hashlib.sha256(payload).hexdigest()
    full = warc.read_record(warc.warc_record(5, "http://a/b c\r\nX: y", payload, digest, None, False))
    assert (full["payload"], full["page_id"], full["record_type"]) == (payload, 5, "response")
    assert full["url"] == "http://a/b%20c%0D%0AX:%20y"
    again = warc.read_record(warc.warc_record(None, None, payload, digest, 5, True))
    assert again["payload"] is None and again["refers_to"] == 5 and again["page_id"] is None
    assert (again["payload_bytes"], again["payload_digest"]) == (len(payload), digest)
    with pytest.raises(ValueError):
        warc.read_record(warc.warc_record(5, "u", payload, "0" * 64, None, False))


def test_pages_with_nulls_repeats_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    long, short = "ß" * 60, "y" * 99
    rows = [(3, "u3", long), (2, "u2", long), (2, "u2", long), (9, None, long), (None, "n", long),
            (4, "u4", short), (5, "u5", short), (6, "u6", None), (7, "u7", ""), (8, "u8", "z" * 100_000),
            (None, "a", "w" * 200), (None, "b", "w" * 200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "page_id long, url string, html string, digest string, size int")
    got = warc.round_trip(df.repartition(3)).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == long and page != 2
        want.append((page, len(data), hashlib.sha256(data).hexdigest(),
                     "revisit" if again else "response", 2 if again else None))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_and_manifest(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    work = Workspace(spark, "warc-test")
    manifest = warc.write_archives(pages, work)
    path = manifest.first()["path"]
    with warc._open(path) as file, zipfile.ZipFile(path.removeprefix("file://")) as theirs:
        ours = warc.ZipMembers(file)
        assert set(ours.members) == set(theirs.namelist())
        assert all(ours.read(n) == theirs.read(n) for n in theirs.namelist())
    index = warc.read_index(manifest)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = warc.read_records(index.where("page_id % 7 = 3"), payloads=True).collect()
    assert len(got) == sum(i % 7 == 3 for i in html)
    for r in got:
        assert r["payload"] is None or bytes(r["payload"]).decode() == (html[r["page_id"]] or "")


def test_query_equals_its_sql(spark):
    from oracle_check import connect

    folder = "/root/testdata/sf0.01"
    df = QUERIES["op5_warc"](spark, folder)
    relation = connect(folder).sql(ORACLES["op5_warc"])
    order = [relation.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        (tuple(r[i] for i in order) for r in relation.fetchall()), key=str)
