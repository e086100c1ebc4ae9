import gzip
import hashlib
import os

import pytest

from lumenloom.llm.warc import Warc, archive_folder, read, write


def test_round_trip_and_determinism(spark, tmp_path):
    big = "<p>" + "ü" * 80
    rows = [(i, f"http://h/{i}", f"<p>{i}" * 30) for i in range(50)]
    rows += [(100, "http://x/\r\nEvil: 1", big), (101, None, big), (99, "u", big), (99, "u", big), (60, "s", "short"), (61, "s", "short"), (62, None, None), (None, "n", big), (63, "e", "")]
    pages = spark.createDataFrame([(*x, "d") for x in rows], "page_id long, url string, html string, digest string")
    how = Warc(roll_bytes=500, part_pages=10)
    sums = []
    for n in range(2):
        folder = f"file://{tmp_path}/a{n}"
        manifest = write(pages.repartition(3 + n), folder, how)
        sums.append(sorted((r.file, r.sha256, r.records) for r in manifest.collect()))
        assert {f for f in os.listdir(tmp_path / f"a{n}") if f.endswith(".gz")} == {r[0] for r in sums[-1]}
        for name, sha, _ in sums[-1]:
            data = (tmp_path / f"a{n}" / name).read_bytes()
            assert hashlib.sha256(data).hexdigest() == sha and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert sums[0] == sums[1] and len(sums[0]) > 5 and sum(r[2] for r in sums[0]) == len(rows)
    got = read(spark, folder).collect()
    assert len(got) == len(rows)
    for page_id in (100, 101, None):
        r = next(r for r in got if r.page_id == page_id)
        assert (r.record_type, r.refers_to, r.payload_bytes) == ("revisit", 99, 163)
    assert sorted(r.record_type for r in got if r.page_id == 99) == ["response", "revisit"]
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    want = {(i, h or "") for i, _, h in rows}
    assert {(r.page_id, r.html) for r in got if r.html is not None} <= want
    assert next(r for r in got if r.page_id == 100).url == "http://x/%0D%0AEvil:%201"


def test_a_wrong_digest_is_an_error(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    name = write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), folder).first().file
    path = tmp_path / "b" / name
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"abc", b"abd")))
    with pytest.raises(Exception, match="doesn't fit its digest"):
        read(spark, folder).collect()


def test_empty(spark):
    folder = archive_folder(spark)
    assert write(spark.createDataFrame([], "page_id long, url string, html string"), folder).collect() == []
    assert read(spark, folder).collect() == []
