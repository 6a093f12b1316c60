"""The tree of joins against tiktoken and against merging a piece as a whole."""

import random

import public_tokenizers
import pytest
import tiktoken

from tillproof.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.Bpe(byte_bpe.read_ranks(PATH))


def test_pieces_above_a_leaf_are_joined(bpe, monkeypatch):
    calls = []
    whole = byte_bpe.Bpe.join
    monkeypatch.setattr(byte_bpe.Bpe, "join", lambda self, a, b: calls.append(1) or whole(self, a, b))
    own = byte_bpe.Bpe(bpe.ranks)
    assert own.piece(b"qzxwvkjq") == own.run(b"qzxwvkjq") and len(calls) == 1


def test_the_tree_equals_the_merge_of_the_whole_piece(bpe):
    draw = random.Random(7)
    words = [t for t in bpe.ranks if len(t) > 2]
    kinds = [
        lambda n: bytes(draw.randrange(256) for _ in range(n)),
        lambda n: bytes(draw.choice(b"abcdeorst") for _ in range(n)),
        lambda n: bytes(draw.choice(b"ab") for _ in range(n)),
        lambda n: b"".join(draw.choice(words) for _ in range(n // 4 + 1)),
        lambda n: draw.choice([b"x", b"=", b"ha", b"\xe4\xbd\xa0", b" "]) * n,
    ]
    for n in (1, 3, 4, 5, 8, 9, 17, 33, 80, 300, 1500):
        for kind in kinds:
            for _ in range(6):
                piece = kind(n)
                assert bpe.piece(piece) == bpe.run(piece), piece
                assert bpe.decode(bpe.piece(piece)) == piece


def test_long_runs_and_odd_texts_equal_tiktoken():
    encode = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    draw = random.Random(8)
    given = ["x" * 30_000, "=" * 9_999, "ab" * 12_345, " " * 5_000 + "a", "\n" * 3_000, "".join(draw.choice("abcdefghij") for _ in range(20_000)), "".join(chr(draw.randrange(1, 0x3000)) for _ in range(5_000)), "你好" * 4_000, "don't  can't\tI'LL\r\n\r\n  x", "\x00\x1f\x85\xa0 x"]
    for text in given:
        assert encode([text])[0].tolist() == library.encode_ordinary(text), text[:20]


@pytest.mark.parametrize("text", ["x" * 200_000, "the of and " * 30_000])
def test_texts_of_any_length_equal_the_merge_of_their_pieces(text, bpe):
    encode = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    want = [i for piece in encode.find(text) for i in bpe.run(piece.encode())]
    assert encode([text])[0].tolist() == want


def test_an_encoder_that_remembers_little_gives_the_same_ids():
    small, large = byte_bpe.encoder(PATH, public_tokenizers.PATTERN, 200), byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    for turn in range(20):
        given = [" ".join(f"again{k % 7}, once{turn * 1000 + k}." for k in range(60)), "", "x \0y"]
        for a, b in zip(small(given), large(given), strict=True):
            assert a.tolist() == b.tolist()
        assert len(small) <= 200 + 80 and small.bpe.small.cache_info().maxsize == 100
