import hashlib
import io
import os

import pytest
import zstandard as zstd
from newsignal.llm import warc

PAGES = "page_id long, url string, html string"


def pages():
    twice = "<p>" + "same " * 40 + "</p>"
    rows = [(i, f"http://a/{i}?q=ü x", f"<html><body>page {i} {'text ' * i}</body></html>") for i in range(60)]
    rows += [(70, "http://b", twice), (69, "http://c", twice), (71, None, twice), (72, "http://d", "short"), (73, "http://e", "short")]
    rows += [(80, "http://f\r\nX: 1", None), (81, "", ""), (None, "http://g", "été " * 40), (69, "http://c", twice)]
    return rows


def test_round_trip(spark, tmp_path):
    written = warc.write_archives(spark.createDataFrame(pages(), PAGES), str(tmp_path), archive_bytes=4_000)
    assert written.count() > 2
    for records in (warc.read_archives(written), warc.read_folder(spark, str(tmp_path))):
        rows = warc.checked(records).collect()
        got = sorted((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to or "") for r in rows)
        wanted = []
        for i, _, html in pages():
            data = (html or "").encode()
            revisit = i in (70, 71)
            wanted.append(
                (
                    f"urn:page:{'' if i is None else i}",
                    "revisit" if revisit else "response",
                    len(data),
                    hashlib.sha256(data).hexdigest(),
                    "urn:page:69" if revisit else "",
                )
            )
        assert got == sorted(wanted)
        texts = {r.record_id: r.payload for r in rows if r.record_type == "response"}
        assert bytes(texts["urn:page:5"]).decode() == pages()[5][2]
        assert all("\n" not in r.target_uri for r in rows)


def archive(records, dictionary=None):
    out = warc.dictionary_frame(dictionary) if dictionary else b""
    shared = zstd.ZstdCompressionDict(dictionary) if dictionary else None
    return out + b"".join(zstd.ZstdCompressor(dict_data=shared).compress(r) for r in records)


def read(data):
    return list(warc.read_stream("a", io.BytesIO(data)))


@pytest.fixture(scope="module")
def dictionary():
    return zstd.train_dictionary(4096, [os.urandom(8) + b"<html>some page text %d</html>" % i * 9 for i in range(300)]).as_bytes()


def test_dictionary_plain_compressed_or_absent(dictionary):
    records = [warc.page_record(str(i), "u", "1970-01-01T00:00:00Z", b"<html>some page text", None) for i in range(4)]
    plain = (0x184D2A5D).to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    body = archive(records, dictionary)
    body = body[len(warc.dictionary_frame(dictionary)) :]
    skipped = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"xyz"
    for data in (archive(records), archive(records, dictionary), plain + body, archive(records) + skipped + archive(records[:1])):
        assert all(r["error"] is None and r["payload"] == b"<html>some page text" for r in read(data))
    assert len(read(archive(records, dictionary))) == 4 and read(b"") == []


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
        (lambda r: r.replace(b"WARC-Date: ", b"WARC-Late: "), "warc-date is missing"),
        (lambda r: r.replace(b"\r\nWARC-Type", b"\r\nno colon here\r\nWARC-Type", 1), "no name"),
        (lambda r: r[:-6] + r[-4:], "content-length"),
        (lambda r: r[:-4], "content-length"),
        (lambda r: r.replace(b"payload", b"PAYLOAD"), "block digest"),
        (lambda r: b"WARC/1.1\r\nbroken", "does not end"),
    ],
)
def test_damaged_record_is_reported_and_the_next_is_read(change, message):
    good = warc.page_record("1", "u", "1970-01-01T00:00:00Z", b"the payload", None)
    first, second = read(archive([change(good), good]))
    assert message in first["error"] and second["error"] is None


def test_damaged_frames(dictionary):
    good = warc.page_record("1", "u", "1970-01-01T00:00:00Z", b"the payload", None)
    whole = archive([good, good], dictionary)
    assert "cut off" in read(whole[:-3])[-1]["error"]
    assert "cut off" in read(whole[:20])[-1]["error"]
    assert "no dictionary" in read(warc.dictionary_frame(b"x" * 40))[0]["error"]
    assert "cannot be decoded" in read(archive([good]) + b"rubbish rubbish")[-1]["error"]


def test_no_pages(spark, tmp_path):
    written = warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.read_archives(written).count() == 0
