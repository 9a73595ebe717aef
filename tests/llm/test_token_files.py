import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terrapane.llm.registry import tokens_written, vocabulary_path
from terrapane.llm.token_files import SEGMENT, Table, UnitEncoder, _lanes, decode_block, encode_block, read_tokens, write_tokens

JSON = open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_str(JSON)
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.integers(0, 5))
def test_block_round_trip(ids, spread):
    ids = np.array(ids, np.uint32) ** (1 + spread % 2)
    table = Table(np.bincount(ids, minlength=3))
    assert int(table.freq.sum()) == 1 << 20
    assert np.array_equal(decode_block(encode_block(ids, table), table), ids)


def test_segments_and_checksums():
    rng = np.random.default_rng(0)
    ids = (rng.pareto(1.0, 400_000) * 5).clip(0, 50_000).astype(np.uint32)
    table = Table(np.bincount(ids))
    data = encode_block(ids, table)
    assert len(data) < len(ids) * 2
    width = SEGMENT * _lanes(len(ids))
    assert len(ids) > width
    for s in range(-(-len(ids) // width)):
        assert np.array_equal(decode_block(data, table, s), ids[s * width : (s + 1) * width])
    broken = bytearray(data)
    broken[-50] ^= 255
    with pytest.raises(ValueError, match="checksum"):
        decode_block(bytes(broken), table)
    with pytest.raises(ValueError):
        decode_block(b"????" + data[4:], table)


TEXTS = ["a  b\n\n c ", "", " ", "\n", "x  y", "don't  I'll  \r\n 12 3", " a", "日本 語　x", "<|endoftext|>a", "x<|endoftext|>a <|endoftext|> <|endoftext", "b" * 70_000, "a" * 700, "tab\tt \t x", "é è  ", "\x1c\x1d a", "a\u0085 b"]


def test_units_make_the_tokenizers_ids(plain):
    for repeat in range(2):
        e = UnitEncoder(JSON, **({"bits": 3, "most": 30} if repeat else {}))
        for _ in range(2):
            ids, bound = e(pa.array(TEXTS + [None]))
            assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:])] == [plain(t) for t in TEXTS] + [[]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab' \n\té  !1", max_size=12), max_size=5))
def test_units_on_any_text(texts):
    t = Tokenizer.from_str(JSON)
    ids, bound = UnitEncoder(JSON)(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_files(spark, odd, empty, plain, tmp_path):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens_written(odd).collect())
    rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
    by_id = sorted([r["doc_id"] for r in odd.collect()], key=lambda x: (x is not None, x))
    assert [g[1] for g in got] == by_id
    at = 0
    for start, doc_id, n, crc in got:
        assert start == at
        at += n
        assert (n, crc) in {(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in (plain(t or "") + [0] for d, t in rows if d == doc_id)}
    assert tokens_written(empty).count() == 0
    write_tokens(odd, f"{tmp_path}/f", JSON)
    ids = [x for r in sorted(read_tokens(spark, f"{tmp_path}/f", ids=True).collect(), key=lambda r: r["start"]) for x in r["ids"]]
    assert len(ids) == at


def test_other_tokenizers_see_whole_texts():
    """A tokenizer that splits otherwise gets no units: nothing is assumed of it."""
    about = json.loads(JSON)
    about["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "ByteLevel", "add_prefix_space": True, "use_regex": False, "trim_offsets": True}]}
    other = json.dumps(about)
    t = Tokenizer.from_str(other)
    ids, bound = UnitEncoder(other)(pa.array([*TEXTS, None]))
    assert [ids[a:b].tolist() for a, b in zip(bound, bound[1:])] == [t.encode(x, add_special_tokens=False).ids for x in [*TEXTS, ""]]


def test_ids_beyond_the_tokenizer(spark, odd, tmp_path):
    """An end id that the tokenizer lacks, beyond 16 bits, comes back whole; one that the table can't hold is refused before anything is written."""
    write_tokens(odd, f"{tmp_path}/f", JSON, end_id=300_000)
    assert all(r["ids"][-1] == 300_000 for r in read_tokens(spark, f"{tmp_path}/f", ids=True).collect())
    with pytest.raises(ValueError):
        write_tokens(odd, f"{tmp_path}/g", JSON, end_id=1 << 20)


def test_repeated_rows_in_many_ranges(spark, plain, tmp_path):
    rows = spark.range(3000).selectExpr("CAST(7 AS BIGINT) AS doc_id", "'same text' AS text").repartition(4)
    write_tokens(rows, f"{tmp_path}/f", JSON)
    n = len(plain("same text")) + 1
    assert sorted(r["start"] for r in read_tokens(spark, f"{tmp_path}/f").collect()) == [i * n for i in range(3000)]
