"""Token counts, binary records and packing against the tokenizers library."""

import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemine.llm import encoding, packing, records, token_counts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", " ", "b", "the ", "\n", ".", ",", "é", "'s", "  ", "1", "<|endoftext|>", "ing", "日", "́", "\t", "\x85", "\xa0", "!", "_", "ß", "É", "\x1c", "²", "Ⅷ", "...", "\0", "I'LL", "zq"]


def ids(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if text else []


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_ids_of_the_whole(path, monkeypatch):
    monkeypatch.setattr(encoding, "PIECES", 50)
    whole, p = Tokenizer.from_file(path), encoding.Pieces(path)
    texts = random_texts(3000, 1)
    got = [x for k in range(0, 3000, 100) for x in p.encode(texts[k : k + 100])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_known_parts_cost_no_step_of_python_each(path):
    p, rng = encoding.Pieces(path), random.Random(4)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(8)) + rng.choice(["", ",", ".\nA"]) for _ in range(5000))
    steps = []
    first = p.encode([text])
    sys.setprofile(lambda frame, event, arg: steps.append(event))
    try:
        again = p.encode([text])
    finally:
        sys.setprofile(None)
    assert again == first and np.frombuffer(first[0], "<u4").tolist() == ids(path, text)
    assert len(steps) < 1000


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_any_character_may_be_in_a_text(path):
    p = encoding.Pieces(path)
    texts = ["", "\0 a.\nb \1\2 c, d", "".join(map(chr, range(12))) + "x.y  z", "a.\n\nb", None, "\U000f0000.\n"]
    for separable in (p.separable, False):
        p.separable = separable
        for some in (texts, [x for x in texts if x != texts[2]]):
            assert [np.frombuffer(x, "<u4").tolist() for x in p.encode(some)] == [ids(path, x or "") for x in some]
    assert p.encode([]) == []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_stops_behind_letters_that_end_in_a_mark(path):
    texts = [f"x{c}.y {c}, {c}\n{c}! {c} ." for c in "\u0130\u0958\u095f\u09dc\u09df\u0a33\u0a5e\u0b5d\u0f43\u0f69\ufb1d\ufb2a\ufb4e" + "é日²"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoding.Pieces(path).encode(texts)] == [ids(path, x) for x in texts]


def test_transducer_counts_like_the_library(monkeypatch):
    monkeypatch.setattr(token_counts, "PARTS", 200)
    monkeypatch.setattr(token_counts, "STATES", 300)
    whole, t = Tokenizer.from_file(BYTE), token_counts.Transducer(BYTE)
    rng, texts = random.Random(2), random_texts(3000, 3)
    for x, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert t.total(x) == len(e.ids), x
        if "<|" not in x and x:
            k = rng.randrange(1, 9)
            maps = [token_counts.chunk_map(t, x[i : i + k]) for i in range(0, len(x), k)]
            while len(maps) > 1:
                i = rng.randrange(len(maps) - 1)  # any grouping: the maps compose associatively
                maps[i : i + 2] = [token_counts.compose(t, maps[i], maps[i + 1])]
            assert token_counts.finish(t, maps[0]) == len(e.ids), x


@pytest.mark.parametrize("chunk", [token_counts.CHUNK, 700])
def test_token_counts(plain, texts, chunk, monkeypatch):
    plain = plain.withColumn("text", F.regexp_replace("text", r"<\|endoftext\|>", "<end>")) if chunk < 1000 else plain
    got = {r.doc_id: r for r in token_counts.token_counts(plain, BYTE, chunk=chunk).collect()}
    assert got.keys() == texts.keys()
    for d, x in texts.items():
        x = x.replace("<|endoftext|>", "<end>") if chunk < 1000 else x
        assert (got[d].n_bytes, got[d].n_tokens) == (len(x.encode()), len(ids(BYTE, x)))


def test_token_counts_keep_every_row(awkward, empty):
    assert token_counts.token_counts(awkward, BYTE).count() == awkward.count()
    assert token_counts.token_counts(empty, BYTE).count() == 0


@pytest.mark.parametrize("shard_bytes", [records.SHARD_BYTES, 20_000])
def test_records_round_trip(spark, plain, texts, shard_bytes, monkeypatch):
    monkeypatch.setattr(records, "SHARD_BYTES", shard_bytes)
    folder = records.records_folder(spark)
    records.write_records(plain, folder, BYTE, shards=3)
    assert (spark.read.format("binaryFile").load(f"{folder}/data").count() > 3) == (shard_bytes < 1e6)
    got = sorted(records.read_records(spark, folder).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in got] == sorted(texts)
    for r in got:
        want = np.array([*ids(BYTE, texts[r.doc_id]), 2], "<u4")
        assert bytes(r.ids) == want.tobytes() and r.start == start
        start += len(want)
    index = spark.read.parquet(f"{folder}/index").collect()
    files = {f.path.rsplit("/", 1)[1]: bytes(f.content) for f in spark.read.format("binaryFile").load(f"{folder}/data").collect()}
    for e in random.Random(0).sample(index, 20):  # a shuffled read by the index
        doc_id, found, after = records.unframe(files[e.shard], e.offset)
        assert (doc_id, len(found), after) == (e.doc_id, e.n_tokens, e.offset + e.length)


def test_damage_is_noticed():
    data = bytearray(records.frame(7, np.arange(10), False) + b"\n")
    assert records.unframe(bytes(data), 0)[1].tolist() == list(range(10))
    for at in range(len(data) - 1):
        broken = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1 :])
        with pytest.raises(ValueError):
            records.unframe(broken, 0)
    assert records.unframe(records.frame(None, np.array([70000]), True), 0)[:2] == (None, np.array([70000]))


def test_a_shard_is_read_in_splits(spark):
    """No reader holds a whole shard, and splits that end anywhere, also inside a mark, lose and repeat nothing."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(80)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    try:
        folder = records.records_folder(spark)
        records.write_records(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, BYTE, shards=1)
        read = records.read_records(spark, folder)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "307")  # splits may change between two jobs
        tasks, got = read.rdd.getNumPartitions(), sorted(read.collect(), key=lambda r: r.doc_id)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [[*ids(BYTE, x), 2] for x in texts]
    assert tasks > 10
    assert [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got] == list(enumerate(want))
    starts = [0, *np.cumsum([len(w) for w in want]).tolist()[:-1]]
    assert [r.start for r in got] == starts
    (shard,) = (bytes(f.content) for f in spark.read.format("binaryFile").load(f"{folder}/data").where("length > 0").collect())
    index = sorted(spark.read.parquet(f"{folder}/index").collect(), key=lambda e: e.offset)
    assert [(e.doc_id, e.start, e.n_tokens) for e in index] == [(i, s, len(w)) for i, (s, w) in enumerate(zip(starts, want))]
    for e in index:
        doc_id, found, after = records.unframe(shard, e.offset)
        assert (doc_id, found.tolist(), after) == (e.doc_id, want[e.doc_id], e.offset + e.length)


def test_a_cut_or_lengthened_record_is_noticed():
    whole = records.frame(7, np.arange(10), False)
    for bad in (whole[:-1], whole[:20], b"", whole + b"\0", whole + b"\n" + whole):
        batch = pa.RecordBatch.from_pydict({"shard": ["s"], "record": [bad]})
        heads = pa.RecordBatch.from_pydict({"shard": ["s"], "head": [bad[: records.HEAD + records.INFO]], "size": [len(bad)]})
        for read, b in ((records._sequences, batch), (records._entries, heads)):
            with pytest.raises(ValueError):
                list(read(iter([b])))


def test_slices_hold_every_text_once():
    texts = ["abc", None, "", "日本", "x" * 30, "y", None]
    for most in (1, 4, 7, 1000):
        got = list(encoding.slices(pa.array(texts), most))
        assert [x for _, some in got for x in some] == texts and [i for i, _ in got] == [0, *np.cumsum([len(s) for _, s in got]).tolist()[:-1]]
        assert all(sum(len((x or "").encode()) for x in some[1:]) < most for _, some in got)
    assert list(encoding.slices(pa.array([], pa.string()))) == []


def test_records_of_awkward_and_empty_tables(spark, awkward, empty):
    for df in (awkward, empty):
        folder = records.records_folder(spark)
        records.write_records(df, folder, BYTE)
        assert records.read_records(spark, folder).count() == df.count()


# --- packing ---


def test_first_fit_decreasing():
    rng = random.Random(5)
    for _ in range(50):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 80))]
        got, used = packing.first_fit_decreasing(sizes, 100)
        rooms: list[int] = []
        want = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            want[i] = next((b for b, r in enumerate(rooms) if r >= sizes[i]), len(rooms))
            if want[i] == len(rooms):
                rooms.append(100)
            rooms[want[i]] -= sizes[i]
        assert got == want and used == len(rooms)


@pytest.mark.parametrize("table", ["plain", "awkward"])
def test_pack(request, table):
    df = request.getfixturevalue(table)
    got = packing.pack(df, WORD, capacity=512, group_docs=20).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for q in sequences.values():
        at = 0
        for r in sorted(q, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(sequences) <= sum(r.length for r in got) / 512 * 1.1 + 8
    if table == "plain":
        for d, x in {r.doc_id: r.text or "" for r in df.collect()}.items():
            own = sorted(pieces[d], key=lambda r: r.start)
            assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == [*ids(WORD, x), 2]
            assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
    else:
        assert sum(r.length for r in got) == sum(len(ids(WORD, r.text)) + 1 for r in df.collect())


def test_pack_nothing(empty):
    assert packing.pack(empty, WORD).count() == 0


def test_checksums_of_the_query(spark, sf):
    from tablemine.llm.plans import all_queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    got = {r.doc_id: r for r in all_queries()["op7_token_records"](spark, sf).collect()}
    for d in sorted(texts):
        want = np.array([*ids(BYTE, texts[d]), 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
