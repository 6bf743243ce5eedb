import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as fs
import pytest

from meridia.llm.packing import SIZE, pack
from meridia.llm.queries import tokenizer
from meridia.llm.token_count import token_counts
from meridia.llm.token_files import ShardReader, ShardWriter, from_planes, read_token_files, to_planes, token_files, write_token_files
from meridia.llm.tokenize import load

from .cases import frame, rows

BYTES = tokenizer("byte_bpe_50k.json")
WORDS = tokenizer("word_bpe_49k.json")


def ids(path, text):
    return load(path).encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(array("I", x).tobytes())


def test_counts_are_the_librarys(spark):
    got = Counter(map(tuple, token_counts(frame(spark), WORDS, 100).collect()))
    want = Counter((r[0], len((r[1] or "").encode()), n := len(ids(WORDS, r[1])), n > 100) for r in rows())
    assert got == want


def test_counts_join_rare_pre_tokens(spark, monkeypatch):
    monkeypatch.setattr("meridia.llm.token_count.HOT", 3)
    got = Counter(r.n_tokens for r in token_counts(frame(spark), WORDS).collect())
    assert got == Counter(len(ids(WORDS, r[1])) for r in rows())


def test_long_pre_tokens_can_be_hot(spark):
    """One long pre-token in every document joins nothing."""
    from meridia.llm import token_count

    data = [(k, f"{'z' * 60} w{k}", "en", "a", 1, 1, 1, 1, 1, 1.0) for k in range(20)]
    docs = frame(spark, data)
    assert Counter(r.n_tokens for r in token_counts(docs, WORDS).collect()) == Counter(len(ids(WORDS, r[1])) for r in data)
    hot = {token_count.hot_key(b"z" * 60): 9}
    shared = spark.sparkContext.broadcast(hot)
    rows_ = docs.select("doc_id", "text").mapInArrow(token_count._frequencies(shared), "key long, doc_id long, n_bytes long, word binary, freq long").collect()
    assert not [r for r in rows_ if bytes(r.word).startswith(b"zz")] and {r.freq for r in rows_ if r.doc_id is not None} == {9}


def test_shards_follow_bytes(spark, tmp_path, monkeypatch):
    for least, most, n in ((1 << 30, 1 << 30, 1), (1, 1 << 30, 4), (1, 60_000, 6)):
        monkeypatch.setattr("meridia.llm.token_files.LEAST", least)
        monkeypatch.setattr("meridia.llm.token_files.MOST", most)
        shards = write_token_files(frame(spark), BYTES, f"file://{tmp_path}/{least}-{most}").where("n_docs > 0").count()
        assert abs(shards - n) <= 2


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert token_counts(empty, WORDS).count() == 0
    assert token_files(empty, BYTES).count() == 0
    assert pack(empty, BYTES).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_round_trip(spark, tmp_path, kind):
    folder = f"file://{tmp_path}/f"
    manifest = write_token_files(frame(spark), BYTES, folder, 2, kind)
    got = sorted(read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    known = [r for r in rows() if r[0] is not None]
    at = 0
    for g, r in zip(got, sorted(known, key=lambda r: r[0])):
        want = [*ids(BYTES, r[1]), 2]
        assert tuple(g) == (r[0], at, len(want), crc(want))
        at += len(want)
    assert [g.doc_id for g in got[len(known) :]] == [None, None]
    assert len(got) == len(rows())
    store, root = fs.FileSystem.from_uri(folder)
    first = manifest.where("n_tokens > 10").orderBy("shard").first()
    with store.open_input_file(f"{root}/{first.file}") as f:
        reader = ShardReader(f)
        whole = reader.ids(0, first.n_tokens)
        assert np.array_equal(reader.ids(3, 9), whole[3:9])


def test_planes(tmp_path):
    x = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint32)
    for kind, n in (("byte", 4), ("bit", 32)):
        planes = to_planes(x, kind)
        assert len(planes) == n
        assert np.array_equal(from_planes(planes, len(x), kind), x)
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "s")) as sink:
        w = ShardWriter(sink, chunk=64)
        for k in range(10):
            w.add(k, x[k * 100 : k * 100 + 100].tobytes())
        w.close()
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "s")) as f:
        reader = ShardReader(f)
        assert len(reader.index["chunks"]) == 16
        assert np.array_equal(np.concatenate([np.concatenate(p) for _, p in reader.documents()]), x)


@pytest.mark.parametrize("fan_in", [2, 256])
def test_packing_keeps_every_id_once(spark, monkeypatch, fan_in):
    monkeypatch.setattr("meridia.llm.packing.FAN_IN", fan_in)
    data = [r for r in rows() if r[0] is not None and r[0] != 107]
    pieces = pack(frame(spark, data), BYTES).collect()
    text, by_doc, by_sequence = {r[0]: r[1] for r in data}, defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(text)
    for d, got in by_doc.items():
        want, at = [*ids(BYTES, text[d]), 0], 0
        for p in sorted(got, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.length > 0
            assert p.ids_crc32 == crc(want[at : at + p.length])
            at += p.length
        assert at == len(want)
    for got in by_sequence.values():
        at = 0
        for p in sorted(got, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == SIZE or at & (at - 1) == 0


def test_packing_of_repeated_and_null_rows(spark):
    pieces = pack(frame(spark), BYTES).collect()
    assert sum(p.length for p in pieces) == sum(len(ids(BYTES, r[1])) + 1 for r in rows())


def test_encoder_is_the_library(monkeypatch):
    import random

    import pyarrow as pa

    from meridia.llm import tokenize

    r = random.Random(2)
    pieces = [*",.!?;:*%$)-\" \n\t\r\x0b\x0c\xa0 　\x1c\x85ab'sé1½<>|字😀_\x00ABC", "  ", "<|endoftext|>", "it's", "word ", "The,\nEnd"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [t[1] or "" for t in rows()]
    want = [array("I", e.ids).tobytes() for e in load(BYTES).encode_batch_fast(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokenize, "MEMO", 300)
    monkeypatch.setattr(tokenize, "AT_ONCE", 2000)
    encoder = tokenize.Encoder(BYTES)
    assert list(encoder.column(pa.array(texts))) == want
    assert list(map(encoder.encode, texts)) == want
    assert list(encoder.column(pa.array([None, ""], pa.string()))) == [b"", b""]


def test_words_reach_the_model_once_and_alone(monkeypatch):
    """Latin words skip the pre-tokenizer and stay in the memo; what is no word, or may be two pre-tokens, does not skip it."""
    import random

    import pyarrow as pa

    from meridia.llm import tokenize

    r = random.Random(3)
    letters = "aeiouñöéßłŸDŁstrnǃɏªº×÷ʼκж1́"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 5))) + r.choice(["", "", ",", ".)", "\n"]) for _ in range(40)) for _ in range(200)]
    want = [array("I", e.ids).tobytes() for e in load(BYTES).encode_batch_fast(texts, add_special_tokens=False)]
    asked = []
    whole, model = tokenize.Encoder._new, tokenize.Encoder._modelled
    monkeypatch.setattr(tokenize.Encoder, "_new", lambda self, parts: asked.extend(parts) or whole(self, parts))
    monkeypatch.setattr(tokenize.Encoder, "_modelled", lambda self, words: asked.extend(words.to_pylist()) or model(self, words))
    for most in (tokenize.WORDS, 50):
        monkeypatch.setattr(tokenize, "WORDS", most)
        encoder = tokenize.Encoder(BYTES)
        for k in range(0, 200, 20):
            assert list(encoder.column(pa.array(texts[k : k + 20]))) == want[k : k + 20]
    asked.clear()
    encoder = tokenize.Encoder(BYTES)
    monkeypatch.setattr(tokenize.Encoder, "_new", lambda self, parts: asked.extend(["whole"] * sum(any(c.isalpha() for c in p) for p in parts)) or whole(self, parts))
    for _ in range(2):
        list(encoder.column(pa.array(["Some words, söme wörds.", "words some"])))
    assert sorted(asked) == sorted(["Some", " words", " söme", " wörds", "words", " some"])
