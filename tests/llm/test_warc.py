import base64
import hashlib
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import warc
from keyloom.llm.common import Scratch
from keyloom.llm.warc import Archive, Bundle, file_system, open_archive, parse, read_archives, read_index, round_trip, with_references, write_archives

ROWS = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 3_000_000), (6, "u", "WARC/1.1\r\n\r\nno record"), (7, "v", "<p>é</p>"), (None, "w", "only null"), (None, "w", "<p>é</p>"), (8, "z", "twice"), (8, "z", "twice")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, frame int")


def brute(rows, least=0):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        full = top.get(h or "")
        again = len(p) >= least and full is not None and i != full
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", full if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 1000])
def test_round_trip(spark, least):
    got = round_trip(pages(spark).repartition(3), least=least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS, least)


def test_index_finds_each_record(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEVEL", 1)
    with Scratch(spark) as s:
        index = s.table(write_archives(with_references(pages(spark), s, "page_id", "url", "html"), s.path("a"), frame=200, archive=100), "index")
        rows = index.collect()
        assert len(rows) == len(ROWS) and len({r.archive for r in rows}) > 1 and max(r.frame for r in rows) >= 1
        for r in rows:
            fields, block = open_archive(r.archive).record(r.frame, r.offset)
            assert fields.get("X-Key") == (None if r.key is None else str(r.key))
            assert "\n" not in fields.get("WARC-Target-URI", "")
        payload = {x.key: x.payload for x in read_archives(index.select("archive").distinct()).where("record_type = 'response' and key is not null").collect()}
        assert payload[5] == b"x" * 3_000_000 and payload[6] == b"WARC/1.1\r\n\r\nno record" and payload[7].decode() == "<p>é</p>"


def test_frames_stand_alone_and_plain_decoders_read_all():
    import zstandard

    out = pa.BufferOutputStream()
    b = Bundle(out, frame=50)
    places = [b.add(warc.record(i, None, b"p" * i, "D", None)) for i in range(5)]
    held = b.out
    b.flush()
    table_free = len(b.sizes)
    b.out = io.BytesIO()
    b.out.close, keep = (lambda: None), b.out
    b.close()
    data = held.getvalue().to_pybytes() + keep.getvalue()
    a = Archive(pa.BufferReader(data))
    assert table_free == len(a.sizes) == 5 and [p[0] for p in places] == list(range(5))
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert [f["X-Key"] for _, f, _ in parse(whole)] == [str(i) for i in range(5)]


def test_damage_is_noticed_and_empty_table(spark):
    with pytest.raises(ValueError):
        Archive(pa.BufferReader(b"\0" * 100))
    assert round_trip(pages(spark, [])).collect() == []


def test_a_part_of_an_index_is_read_by_several_tasks_and_by_its_frames_alone(spark, monkeypatch):
    with Scratch(spark) as s:
        many = [(i, "u", f"{i} " * 200) for i in range(400)]
        index = s.table(write_archives(with_references(pages(spark, many).coalesce(1), s, "page_id", "url", "html"), s.path("a"), frame=2000), "index")
        assert index.select("archive").distinct().count() == 1
        found = read_index(index)
        assert sorted(r.key for r in found.collect()) == list(range(400))
        used = found.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used > 1
        some = read_index(index.where("key % 50 = 7"))
        assert {r.key: r.payload.decode() for r in some.collect()} == {i: f"{i} " * 200 for i in range(7, 400, 50)}


def test_names_of_stores(tmp_path):
    assert file_system(f"file://{tmp_path}")[1] == str(tmp_path)
