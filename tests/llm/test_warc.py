import base64
import hashlib
import io
import struct
from collections import Counter

import pytest
import zstandard

from lexivane.llm import warc

PAGES = "page_id long, url string, html string, record string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def rows(words):
    plain = [(i, f"http://h{i % 7}.example/p?q={i} é", f"<html><title>{words[i]}</title><body>{' '.join(words[i : i + 90])}</body></html>") for i in range(300)]
    return [*plain, (900, "u", plain[3][2]), (901, "u\r\nX: y", plain[3][2]), (902, None, plain[3][2]), (903, "", None), (904, "v", ""), (905, "w", None), (None, "n", plain[4][2]), (None, "n", "only null"), (906, "long", "ab" * 500_000), (-5, "neg", "é€😀\r\n\r\n"), (907, "r", "twice"), (907, "r", "twice"), (1, "r", "twice")]


def want(rows, least=0):
    out = Counter()
    for i, _, t in rows:
        same = [j for j, _, s in rows if (s or "") == (t or "")]
        top = max((j for j in same if j is not None), default=None)
        again = len(same) > 1 and i != top and len((t or "").encode()) >= least
        out[i, len((t or "").encode()), b32(t), "revisit" if again else "response", top if again else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 6, 10**9])
def test_round_trip(spark, rows, least):
    got = warc.read_archives(warc.write_archives(pages(spark, rows), least)).collect()
    assert Counter(map(tuple, got)) == want(rows, least)


def test_file_layout(spark, rows):
    path = warc.write_archives(pages(spark, rows).coalesce(1)).first()["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and 0x184D2A50 <= magic <= 0x184D2A5F
    known = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    assert known.dict_id() != 0
    rest, records = raw[8 + size :], []
    while rest:
        frame = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        records.append(frame.decompress(rest))
        rest = frame.unused_data
    assert len(records) == len(rows) and all(r.startswith(b"WARC/1.1\r\nWARC-Type: ") for r in records)
    assert sum(map(len, records)) > 3 * len(raw)
    heads = [warc.parse(r)[0] for r in records]
    ids = {h["WARC-Record-ID"] for h in heads}
    assert all(h["WARC-Refers-To"] in ids for h in heads if h["WARC-Type"] == "revisit")
    assert not any(c.isspace() for h in heads for c in h["WARC-Target-URI"])


def test_damage_is_noticed(tmp_path):
    raw = warc.record(1, "u", b"payload", None, False)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"payload", b"pavload"))
    out = io.BytesIO()
    warc.Writer(out, b"").add(raw)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_records(io.BytesIO(out.getvalue()[:-3])))
    assert list(warc.read_records(io.BytesIO(out.getvalue()))) == [raw]


def test_record_ids():
    for i in (None, 0, -1, 5, (1 << 63) - 1, -(1 << 63)):
        assert warc.page_of(warc.record_id(i)) == i and warc.record_id(i)[9 + 14] == "8"


def test_empty_and_few(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0
    assert warc.read_archives(warc.write_archives(pages(spark, [(1, None, None)]))).first()["record_type"] == "response"


def test_few_records_have_a_dictionary_too(spark):
    import struct
    import urllib.parse

    rows = [(None, f"http://x.example/{k}", "<p>the same page of some length</p>" * 5) for k in range(4)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    (path,) = [r["path"] for r in manifest.collect()]
    head = open(urllib.parse.urlparse(path).path, "rb").read(8)
    assert struct.unpack("<I", head[:4])[0] == warc.DICT_MAGIC and struct.unpack("<I", head[4:])[0] > 100
    got = warc.read_archives(manifest).collect()
    assert len(got) == 4 and {(r["record_type"], r["payload_bytes"]) for r in got} == {("response", len(rows[0][2]))}


def test_any_ids_give_a_sample(spark):
    """Without ids the draw is by the pages themselves, neither all of them nor none."""
    pages = spark.range(400).selectExpr("cast(null as long) as page_id", "concat('http://x.example/', id) as url", "repeat(concat('word', id, ' '), 40) as html")
    assert len(warc.dictionary_for(pages, 4_000_000, 40_000)) > 256
    one = spark.range(50).selectExpr("1L as page_id", "'u' as url", "'same' as html")
    assert warc.dictionary_for(one, 4_000_000, 40)
