import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexivane.llm import sstable
from lexivane.llm.queries import tokenizer_path
from lexivane.llm.tokens import Encoder

ODD = [
    "", " ", "  a  b", " a", "a ", "a\n b", "a \n\n b", "x<|endoftext|> y <|endoftext|>z", "it's  can't\t\tx", "  é   ü", "a b c\x1c d", "don't \x85 x",
    "日本語 テキスト　全角", "a" * 3000 + " " + "b" * 50, "it's. don't, a.b. x's, \n\nq z.\nY", "A.\nB c\n", "🙂 🙂🙂 x\r\n\r\n y", "ﬁ ſt ª. ʼn, ǅ! ß? ̀x", "١٢ 12, ½. x​y",
]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(tokenizer_path())


def test_encoder_equals_the_library(model, words, monkeypatch):
    rng = random.Random(2)
    marks = ["", "", "", ",", ".", "!", "'s", "\n", "\n\n", " ", "\t", "—", "é", "ñ.", "1", "x?"]
    texts = ODD + [" ".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    encoder = Encoder(tokenizer_path())
    for size in (400_000, 50):
        monkeypatch.setattr("lexivane.llm.tokens.CACHE_WORDS", size)
        for _ in range(2):
            for t, got in zip(texts, encoder.encode(texts), strict=True):
                assert np.frombuffer(got, "<u2").tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(make, edge, model):
    rows = [*edge, *((500 + k, t, "s") for k, t in enumerate(ODD)), (-7, "negative", "s"), ((1 << 63) - 1, "most", "s"), (-(1 << 63), "least", "s")]
    manifest = sstable.write_tables(make(rows), tokenizer_path())
    got = sorted((r.asDict() for r in sstable.read_tables(manifest).collect()), key=lambda r: r["start"])
    want = {}
    for i, t, _ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    order = [r["doc_id"] for r in got]
    assert order == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())


def test_lookup(make, edge, model):
    docs = [(i, t) for i, t, _ in edge]
    readers = [sstable.Reader(r["path"]) for r in sstable.write_tables(make(edge), tokenizer_path()).collect()]
    find = lambda i: [ids.tolist() for r in readers for ids in r.get(i)]
    for i in {i for i, _ in docs}:
        assert sorted(find(i)) == sorted([*model.encode(t or "", add_special_tokens=False).ids, 0] for j, t in docs if j == i)
    assert find(77_777) == find(-1) == []


def test_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    path = tmp_path / "x.sst"
    writer = sstable.Writer(open(path, "wb"), 2)
    keys = sorted([*range(-500, 500, 3), 7, 7, 7, *[8] * 40])
    for k in keys:
        writer.add(sstable.key_bytes(k), np.array([k & 0xFFFF] * (k % 5), "<u2").tobytes())
    writer.close()
    reader = sstable.Reader(str(path))
    assert [sstable.key_id(k) for k, _ in reader.scan()] == keys and reader.n_docs == len(keys)
    for k in range(-510, 510):
        assert [v.tolist() for v in reader.get(k)] == [[k & 0xFFFF] * (k % 5)] * keys.count(k)
    data = bytearray(path.read_bytes())
    data[5] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(str(path)).scan())


def test_files_are_cut_and_empty_tables_have_none(make, edge, monkeypatch):
    assert sstable.read_tables(sstable.write_tables(make([]), tokenizer_path())).count() == 0
    monkeypatch.setattr(sstable, "FILE_BYTES", 2_000)
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 500)
    manifest = sstable.write_tables(make(edge).coalesce(1), tokenizer_path())
    assert sstable.read_tables(manifest).count() == len(edge)
