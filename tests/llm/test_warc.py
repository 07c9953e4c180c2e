import hashlib

from tidewright.llm import warc
from tidewright.llm.common import new_path, pages

SCHEMA = "page_id long, url string, html string, payload_digest string"


def brute(rows):
    first, out = {}, {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        raw = (r["html"] or "").encode()
        d = hashlib.sha256(raw).hexdigest()
        old = first.setdefault(d, r["page_id"])
        again = len(raw) >= 100 and old != r["page_id"]
        out[r["page_id"]] = (len(raw), d, "revisit" if again else "response", old if again else None)
    return out


def result(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_matches_brute_force(spark, sf):
    assert result(warc.op6_warc(spark, sf)) == brute(pages(spark, sf).collect())


def test_odd_rows_and_index(spark):
    big = "<p>é" + "x" * 200
    rows = [(0, None, None, "c"), (1, "http://a/\r\nb é", "", "c"), (5, "u", big, "c"), (3, "u", big, "c"), (4, "v", big, "c"), (6, "u", "x" * 99, "c"), (7, "u", "x" * 99, "c"), (8, "u", "\r\n\r\nWARC/1.1" * 20000, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    index = warc.write_archives(df, new_path(spark, "w"))
    assert index.count() == len(rows)
    got = warc.read_records(index, with_payload=True)
    assert result(got) == brute(df.collect())
    back = {r["page_id"]: r for r in got.collect()}
    assert back[8]["payload"].decode() == rows[-1][2] and back[1]["url"] == rows[1][1] and back[4]["payload"] == b""
    some = warc.read_records(index.where("page_id in (3, 8)"))
    assert sorted(r["page_id"] for r in some.collect()) == [3, 8]
    again = spark.createDataFrame([(3, "u", big, "c"), (3, "w", big, "c"), (None, "u", big, "c"), (None, "n", None, "c")], SCHEMA)
    kinds = sorted(r["record_type"] for r in warc.read_records(warc.write_archives(again, new_path(spark, "w"))).collect())
    assert kinds == ["response", "response", "revisit", "revisit"]
    twins = spark.createDataFrame([(2, "u", big, "c")] * 5 + [(3, "u", big, "c")] * 2 + [(1, "v", "x" * 99, "c")] * 3 + [(None, None, "y" * 200, "c")] * 2, SCHEMA)
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.read_records(warc.write_archives(twins, new_path(spark, "w"))).collect())
    assert got == [("1", "response", "None")] * 3 + [("2", "response", "None")] + [("2", "revisit", "2")] * 4 + [("3", "revisit", "2")] * 2 + [("None", "response", "None"), ("None", "revisit", "None")]
    assert warc.read_records(warc.write_archives(df.limit(0), new_path(spark, "w"))).count() == 0


def test_ranges_are_coalesced():
    got = warc.coalesced([(0, 10), (10, 10), (25, 5), (1000, 10)], gap=10, most=100)
    assert got == [(0, 30, [0, 1, 2]), (1000, 10, [3])]
