"""Re-Pair grammars: round trips, random access, expansion lengths, and no frequent pair left."""

from collections import Counter

import numpy as np
import pytest

from tillproof.llm import repair

BASE = 300


def shards():
    draw = np.random.default_rng(5)
    yield "random", [draw.integers(0, BASE, n) for n in (0, 1, 700, 3)]
    yield "runs", [np.full(5000, 7), np.zeros(0, int), np.full(4001, 8), np.tile([1, 2, 3], 900)]
    phrase = [draw.integers(0, BASE, 40) for _ in range(6)]
    yield "copies", [np.concatenate([phrase[i] for i in draw.integers(0, 6, k)]) for k in draw.integers(1, 30, 60)]
    yield "large symbols", [draw.integers(0, 40, 30_000)]


@pytest.mark.parametrize("name,docs", list(shards()))
def test_round_trip_random_access_and_lengths(name, docs):
    ids, counts = np.concatenate(docs), np.array([len(d) for d in docs])
    shard = repair.Shard(repair.pack(ids, counts, BASE))
    assert (shard.all() == ids).all()
    for k, own in enumerate(docs):
        assert (shard.document(k) == own).all(), k
    for k in range(len(shard.rules)):
        assert shard.size[k] == len(repair.expand(np.array([BASE + k]), shard.rules, shard.firsts, BASE))


@pytest.mark.parametrize("name,docs", list(shards()))
@pytest.mark.parametrize("bins", [4, 18])
def test_no_frequent_pair_is_left(name, docs, bins):
    rules, firsts, seq = repair.compress(np.concatenate(docs), BASE, bins=bins)
    left = Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
    assert not left or max(left.values()) < 8 or len(seq) < 16
    assert (repair.expand(seq, rules, firsts, BASE) == np.concatenate(docs)).all()


def test_equal_documents_shrink_far_below_an_eighth():
    one = np.random.default_rng(1).integers(0, BASE, 500)
    rules, _, seq = repair.compress(np.tile(one, 200), BASE)
    assert len(seq) + len(rules) < 2000


ADDED = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "x<|endoftext|>", "in<|endoftext|>side", " <|endoftext|>  two  spaces", "<|endoftext", "é\n<|endoftext|>\n\nline", "plain text", "", "the of and " * 4000 + "<|endoftext|>"]


def test_added_tokens_are_what_the_library_makes_of_them(spark, tmp_path):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ADDED)], "doc_id long, text string")
    repair.write_shards(docs, path, 2, str(tmp_path / "shards"))
    ids = [i for r in spark.read.parquet(str(tmp_path / "shards")).orderBy("part", "shard").collect() for i in repair.Shard(r.shard_bytes).all()]
    assert ids == [i for t in ADDED for i in [*library.encode(t, add_special_tokens=False).ids, 2]] and ids.count(50256) == sum(t.count(ADDED[0]) for t in ADDED)


def test_null_and_repeated_keys(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(None, "a"), (None, None), (5, "b b"), (5, "b b"), (5, "<|endoftext|>")], "doc_id long, text string")
    got = repair.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 5, 5, 5] and sorted(r.n_tokens for r in got) == [1, 2, 2, 3, 3]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(5)]


def test_zero_characters_and_a_full_cache_change_no_ids():
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encode = tokenizers.Tokenizer.from_file(path), repair.LibraryEncoder(path)
    draw = np.random.default_rng(8)
    encode.cache.limit = 300
    for turn in range(30):
        given = ["a \0b", "\0", " \0 c\n\0d", "x, (y). z!", "", *(" ".join(f"often{i % 9}, rare{i}." for i in draw.integers(0, 10**6, 40)) for _ in range(5))]
        ids, n = encode(given)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(x, add_special_tokens=False).ids for x in given]
    assert turn and "often3," in encode.cache and "(y)." in encode.cache and len(encode.cache) <= 300 + 500


def test_stretches_that_come_again_outlive_a_full_cache():
    import public_tokenizers

    encode = repair.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encode.cache.limit, asked = 50, []
    many = encode.cache.pieces.encode
    encode.cache.pieces.encode = lambda pieces: asked.extend(pieces) or many(pieces)
    encode.cache.pieces.limit = 0  # pieces themselves are forgotten each time
    for turn in range(20):
        encode(["and again " + " ".join(f"w{turn}x{k}" for k in range(20))])
    assert asked.count(" again") == 1


def test_later_rounds_look_only_at_pairs_that_may_be_frequent(monkeypatch):
    draw, looked = np.random.default_rng(3), []
    words = [draw.integers(0, BASE, k) for k in draw.integers(2, 40, 400)]
    ids = np.concatenate([words[min(i, 399)] for i in draw.zipf(1.3, 5000)])
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **more: looked.append(len(x)) or count(x, *a, **more))
    rules, firsts, seq = repair.compress(ids, BASE)
    assert len(firsts) >= 5 and max(looked[-3:]) * 10 < len(seq)  # the last round, which finds nothing
    assert (repair.expand(seq, rules, firsts, BASE) == ids).all()


@pytest.mark.parametrize("least", [2, 3, 8])
@pytest.mark.parametrize("bins", [1, 3, 18])
def test_no_frequent_pair_is_left_in_small_alphabets_and_runs(least, bins):
    draw = np.random.default_rng(least)
    for turn in range(25):
        ids = np.repeat(draw.integers(0, 1 + turn % 7, 40 * turn), draw.integers(1, 5, 40 * turn))
        rules, firsts, seq = repair.compress(ids, BASE, bins=bins, least=least)
        left = Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
        assert not left or max(left.values()) < least or len(seq) < 2 * least
        assert (repair.expand(seq, rules, firsts, BASE) == ids).all()


def test_pieces_are_mapped_all_at_once():
    import public_tokenizers

    encode = repair.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = ["", "a", " é", "\0", "\ud7ff", "😀\U0010ffff", "\n\n", "", "í\xa0\x80"]
    assert encode.mapped(pieces) == [x.encode().decode("latin-1").translate(encode.letters) for x in pieces]
    ids, n = encode.merged(pieces)
    assert [[encode.tokenizer.id_to_token(i) for i in part] for part in np.split(ids, np.cumsum(n)[:-1])] == [[t.value for t in encode.merge(x)] for x in encode.mapped(pieces)]


def test_new_tokens_that_repeat_in_a_call_get_one_row():
    from tillproof.llm.common import TokenCache

    class Seen(TokenCache):
        def fill(self, new):
            self.filled = new

    cache = Seen()
    assert cache.rows(["a", "b", "a"]).tolist() == [0, 1, 0] and cache.filled == ["a", "b"]
    assert cache.rows(["c", "a", "c", "d"]).tolist() == [2, 0, 2, 3] and cache.filled == ["c", "d"]
    assert cache.rows(["d", "a"]).tolist() == [3, 0] and cache.rows([]).tolist() == []


def test_positions_of_ids_are_held_for_some_stretches_at_a_time(monkeypatch):
    import public_tokenizers
    import tokenizers

    from tillproof.llm import byte_bpe, common

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encode, held, plain = tokenizers.Tokenizer.from_file(path), repair.LibraryEncoder(path), [], common.spread
    for module in common, byte_bpe:
        monkeypatch.setattr(module, "spread", lambda starts, lengths: held.append(len(starts)) or plain(starts, lengths), raising=False)
    for given in (["", "one two " * 25_000, "", "x", "y " * 9], ["one two " * 25_000 + "　", "", "two\nthree " * 20_000, " "]):
        ids, n = encode(given)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(x, add_special_tokens=False).ids for x in given]
    assert max(held) <= 1 << 15
