import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievework.llm import rans, tokenfiles


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 5000])
@pytest.mark.parametrize("kind", ["one", "flat", "steep"])
def test_round_trip(n, kind):
    rng = np.random.default_rng(n)
    tokens = {"one": np.full(n, 7), "flat": rng.integers(0, 50_257, n), "steep": rng.zipf(1.4, n) % 50_257}[kind].astype(np.uint16)
    table = rans.Table.of(tokens)
    f, c = table.encoder()
    assert table.freq.sum() == 1 << rans.SCALE
    states, words = rans.encode(tokens, f, c, 16)
    assert (rans.decode(states, words, n, table, table.slots()) == tokens).all()


def test_checksums():
    tokens = np.arange(5000, dtype=np.uint16) % 50
    data = bytearray(tokenfiles.pack([1, None], np.array([2000, 3000]), tokens, 3, 4, 5, block=1000))
    part, file, before, ids, counts, blocks = tokenfiles.unpack(bytes(data))
    assert (part, file, before, ids) == (3, 4, 5, [1, None])
    assert np.array_equal(np.concatenate(list(tokenfiles.documents_of(counts, blocks))), tokens)
    data[-3] ^= 1
    with pytest.raises(ValueError):
        list(tokenfiles.unpack(bytes(data))[5])
    data[20] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.unpack(bytes(data))


def test_pieces_equal_whole_texts(tokenizer):
    odd = ["", " ", "  a", "a ", "a  b", "x \n y", "\n a b", "it's we'll 'd  've", "tab\t x", "a  b", "a  b", "<|endoftext|> a <|endoftext|>b", "é漢 字 🙂 x", "\x1c a\x1d b", "a" * 500 + " b", "1 22 333. !! ?x"]
    tool = tokenfiles.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=20)
    for part in (odd, odd[::-1], odd[3:5], [""], [], [None, *odd]):
        ids, n = tool.encode(pa.array(part, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(part)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def brute(rows, tokenizer):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_against_brute_force(spark, sf, local, tokenizer):
    got = tokenfiles.op9_token_files(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == brute(local, tokenizer)


def test_odd_rows(odd, none, tokenizer):
    got = [tuple(r) for r in tokenfiles.token_files(odd).collect()]
    want = brute([(r.doc_id, r.text) for r in odd.collect()], tokenizer)
    assert sorted((i is not None, i or 0, n, c) for i, _, n, c in got) == sorted((i is not None, i or 0, n, c) for i, _, n, c in want)
    assert sorted(s for _, s, _, _ in got)[-1] + 1 <= sum(n for _, _, n, _ in got)
    assert tokenfiles.token_files(none).count() == 0


def test_texts_of_repeating_patterns_have_ids_of_their_own():
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = "".join("ba"[bin(i).count("1") % 2] for i in range(2048))
    tool = tokenfiles.encoder("byte_bpe_50k.json")
    ids, n = tool.encode(pa.array([a, b, "x " + b]))
    want = [tool.tokenizer.encode(x, add_special_tokens=False).ids for x in (a, b, "x " + b)]
    assert np.split(ids, np.cumsum(n)[:-1])[1].tolist() == want[1] and ids.tolist() == sum(want, [])


def test_a_block_is_decoded_on_its_own():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 50_000, 20_000).astype(np.uint16)
    data = tokenfiles.pack([1, 2], np.array([5_000, 15_000]), tokens, 0, 0, 0, block=4096)
    assert tokenfiles.block_of(data, 3).tolist() == tokens[3 * 4096 : 4 * 4096].tolist()
