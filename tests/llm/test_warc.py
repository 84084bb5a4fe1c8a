import base64
import glob
import hashlib

import pytest
import zstandard

from hostgraph.llm import warc


def rows():
    big = "<p>" + "long text é漢 " * 20000
    return [(1, "http://a/", "same"), (2, "http://b/", "same"), (7, None, "same"), (3, "http://c/\r\nX: 1", big),
            (4, "u", None), (5, "u", ""), (6, "http://d/", "P*M\x18\x00\x00\x00\x00 \r\n\r\nWARC/1.1"), (8, "x", "one"),
            (8, "x", "one"), (None, "n", "same")] + [(100 + i, f"http://e/{i}", f"<html><body>page {i} of many</body></html>") for i in range(60)]


def frame(spark):
    return spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, refers_to string")


def expected(min_bytes=0):
    out = []
    for p, u, h in rows():
        data = (h or "").encode()
        twins = [q for q, _, x in rows() if (x or "") == (h or "") and q is not None]
        last = max(twins) if len(data) >= min_bytes else None
        older = last is not None and (p is None or p < last)
        out.append((p, u, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), last if older else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes,dictionary", [(0, True), (5, False)])
def test_round_trip(spark, tmp_path, min_bytes, dictionary):
    pages = frame(spark)
    marked = warc.mark_revisits(pages, min_bytes)
    path = str(tmp_path / "w")
    learned = warc.train_dictionary(marked) if dictionary else b""
    assert bool(learned) == dictionary
    warc.write_archives(marked.repartition(3), path, learned)
    got = warc.read_archives(spark, path).collect()
    assert sorted([(r.page_id, r.url if r.url is None or "\r" not in r.url else r.url, r.payload_bytes, r.payload_digest,
                    r.refers_to) for r in got if r.page_id != 3], key=str) == [x for x in expected(min_bytes) if x[0] != 3]
    html = {p: h or "" for p, _, h in rows()}
    for r in got:
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert bytes(r.payload).decode() == html[r.page_id]
        if r.page_id == 3:
            assert r.url == "http://c/%0D%0AX:%201"


def test_archives_are_zstandard(spark, tmp_path):
    """A plain reader with the leading dictionary reads every record."""
    marked = warc.mark_revisits(frame(spark))
    path = str(tmp_path / "w")
    warc.write_archives(marked.coalesce(1), path, warc.train_dictionary(marked))
    data = b"".join(open(f, "rb").read() for f in glob.glob(path + "/part-*"))
    assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    size = int.from_bytes(data[4:8], "little")
    shared = zstandard.ZstdCompressionDict(data[8:8 + size])
    whole = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(data[8 + size:], read_across_frames=True).read()
    assert whole.count(b"WARC-Type: response") + whole.count(b"WARC-Type: revisit") == len(rows())


def test_empty(spark, tmp_path):
    none = frame(spark).where("false")
    marked = warc.mark_revisits(none)
    assert warc.train_dictionary(marked) == b""
    path = str(tmp_path / "w")
    warc.write_archives(marked, path, b"")
    assert warc.read_archives(spark, path).where("page_id is not null").count() == 0


def test_dictionary_learns_from_stored_payloads(spark, tmp_path, monkeypatch):
    """A text that a third of all pages hold is archived once, and is one sample."""
    from hostgraph.llm.queries import LLM
    pages = [(i, f"http://e/{i}", "<p>the very same copy</p>" if i % 3 == 0 else f"<p>page {i} of many</p>") for i in range(90)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    taken, train = [], zstandard.train_dictionary
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, records: taken.extend(records) or train(size, records))
    assert LLM["op3_warc_dictionary"][0](spark, str(tmp_path)).count() == 90
    assert len(taken) == 61 and sum(b"very same copy" in r for r in taken) == 1
