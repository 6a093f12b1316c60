"""Byte-level BPE as a monoid: halves are encoded on their own and joined at their border.

A sequence of tokens is what the rank merges make of its bytes exactly if that holds for each two
neighbours (merges are local: a merge across a border that no pair of neighbours shows can't happen).
So two encoded halves join by encoding a window at the border anew, and the tokens outside the
window are final as soon as the pairs at both its ends hold; else the window grows.

Edge cases: null and empty texts have no ids (digests of the empty string); texts of any length and
runs of one character are encoded whole; equal texts get equal rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Grown, TokenCache, gathered, in_batches, texts

#: White space as the tokenizer's own pattern language has it; Python's \s also holds U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
#: Longest leaf of the tree; longest subtree that is remembered, and how many of these and of pairs' checks are.
LEAF, SMALL, KEPT = 4, 16, 1 << 18
#: Windows up to this length merge by plain search, longer ones with a heap.
SHORT = 48


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out."""
    out = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Bpe:
    """Encodes pieces by ranks; decodes ids."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.holds = functools.lru_cache(kept)(self._holds)
        self.small = functools.lru_cache(kept)(self._halves)

    def leaf(self, piece: bytes) -> list[int]:
        """Merges the lowest rank, leftmost first, until nothing merges."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def run(self, piece: bytes) -> list[int]:
        """The same with a heap, for windows that have grown long."""
        ranks, n = self.ranks, len(piece)
        end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                back[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := back[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _holds(self, left: int, right: int) -> bool:
        return self.leaf(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not a or not b or self.holds(a[-1], b[0]):
            return a + b
        w, of = 1, self.bytes_of
        while True:
            i, j = max(0, len(a) - w), min(len(b), w)
            window = b"".join([of[x] for x in a[i:]] + [of[x] for x in b[:j]])
            middle = self.leaf(window) if len(window) <= SHORT else self.run(window)
            if (i == 0 or self.holds(a[i - 1], middle[0])) and (j == len(b) or self.holds(middle[-1], b[j])):
                return a[:i] + middle + b[j:]
            w *= 2

    def _halves(self, piece: bytes) -> list[int]:
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def tree(self, piece: bytes) -> list[int]:
        """Leaves by merges, inner nodes by join(); lists given out are never changed."""
        if len(piece) <= LEAF:
            return self.leaf(piece)
        return self.small(piece) if len(piece) <= SMALL else self._halves(piece)

    def piece(self, piece: bytes) -> list[int]:
        """A match of the pattern: a token if it is one, else what the tree makes of it."""
        return [whole] if (whole := self.ranks.get(piece)) is not None else self.tree(piece)

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PieceCache(TokenCache):
    """Encodings of the pattern's matches; encode(pieces) gives the flat ids and their numbers."""

    def __init__(self, encode, limit: int = 500_000):
        super().__init__(limit)
        self.encode = encode
        self.reset()

    def reset(self) -> None:
        self.ids, self.start, self.length = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def fill(self, new: list[str]) -> None:
        ids, length = self.encode(new)
        self.start.add(self.ids.n + np.cumsum(length) - length)
        self.ids.add(ids)
        self.length.add(length)


class ChunkCache(TokenCache):
    """Encodings of the stretches between spaces, with the space or line break before them.

    No piece of the pattern spans the border between a character other than white space and a
    space or line break that another such character follows, so these stretches are independent.
    A text with a stretch that itself begins or ends with white space is split as a whole.
    """

    #: At the end of a stretch these are one piece of the pattern: neither letters, digits nor white space.
    TAIL = ".,;:!?&%$#*|)-"

    def __init__(self, pattern: str, encode, limit: int = 500_000):
        super().__init__(limit)
        self.find, self.pieces = splitter(pattern).findall, PieceCache(encode, min(limit, 500_000))
        self.reset()

    def reset(self) -> None:
        self.ids, self.start, self.length, self.uses = Grown(np.uint32), Grown(np.int64), Grown(np.int64), Grown(np.int64)

    def split(self, given: str) -> list[str]:
        """The pattern's matches; plain words with marks after them need no regular expression."""
        core = given.rstrip(self.TAIL)
        if core[1:].isalpha() and core[0] == " ":
            return [core, given[len(core) :]] if len(core) < len(given) else [core]
        return self.find(given)

    def many(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the strings, and how many each has; long pieces aren't remembered."""
        lists = [self.split(x) for x in given]
        return self.encoded(list(itertools.chain.from_iterable(lists)), list(map(len, lists)))

    def encoded(self, parts: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces of several strings, and how many each string has."""
        if max(map(len, parts), default=0) > 256:
            ids, length = self.pieces.encode(parts)
        else:
            rows = self.pieces.rows(parts)
            length = self.pieces.length.a[rows]
            ids = gathered(self.pieces.ids.a, self.pieces.start.a[rows], length)
        total = np.concatenate([[0], np.cumsum(length)])
        at = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        return ids, total[at[1:]] - total[at[:-1]]

    def fill(self, new: list[str]) -> None:
        parts, counts, odd = [], [], []
        for k, x in enumerate(new):
            if x.isalpha():
                parts.append(f" {x}")
                counts.append(1)
            elif x[-1:] in self.TAIL and (y := x[:-1]).isalpha():
                parts += f" {y}", x[-1]
                counts.append(2)
            else:
                y = x[1:] if x[:1] in ("\n", "\0") else x
                if not y or y[0].isspace() or y[-1].isspace():
                    odd.append(k)
                own = self.split(y if x[:1] == "\0" else x if x[:1] == "\n" else f" {x}")
                parts += own
                counts.append(len(own))
        self.told(*self.encoded(parts, counts), odd)

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Row numbers of the stretches of a batch, each given once."""
        if len(self) > self.limit:
            self.trim()
        out = super().rows(tokens)
        self.uses.a[out] += 1
        return out

    def trim(self) -> None:
        """Only stretches that several batches held stay, at most as many as half the limit: the rest rarely comes again."""
        uses, start, length = (x.a[: len(self)] for x in (self.uses, self.start, self.length))
        kept = np.flatnonzero((uses > 1) & (length >= 0))
        kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: self.limit // 2]])
        flag = np.zeros(len(self), bool)
        flag[kept] = True
        names = list(itertools.compress(self, flag))
        ids, length = gathered(self.ids.a, start[kept], length[kept]), length[kept]
        self.clear()
        self.reset()
        self.update(zip(names, range(len(names)), strict=True))
        self.told(ids, length, [])

    def told(self, ids: np.ndarray, length: np.ndarray, odd: list[int]) -> None:
        self.start.add(self.ids.n + np.cumsum(length) - length)
        self.ids.add(ids)
        length[odd] = -1
        self.length.add(length)
        self.uses.add(np.zeros(len(length), np.int64))

    def __call__(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has."""
        n = np.zeros(len(docs), np.int64)
        some = [k for k, text in enumerate(docs) if text]
        if not some:
            return np.zeros(0, np.uint32), n
        # A zero character marks where a text begins, so a text that holds one is split as a whole.
        marked = pa.array(["\0" + docs[k].replace("\n", " \n") for k in some], pa.large_string())
        parts = pc.split_pattern(marked, " ")
        met = parts.flatten().dictionary_encode()
        rows = self.rows(met.dictionary.to_numpy(zero_copy_only=False).tolist())[met.indices.to_numpy()]
        length = self.length.a[rows]
        first = parts.offsets.to_numpy()[:-1]  # every text has a stretch
        odd = np.minimum.reduceat(length, first) < 0
        whole = np.array([k for k, bad in zip(some, odd.tolist(), strict=True) if bad or "\0" in docs[k]], np.int64)
        if not len(whole):
            n[some] = np.add.reduceat(length, first)
            return gathered(self.ids.a, self.start.a[rows], length), n
        of = np.repeat(np.array(some), pc.list_value_length(parts).to_numpy())
        keep = ~np.isin(of, whole)
        flat = gathered(self.ids.a, self.start.a[rows[keep]], length[keep])
        n = np.bincount(of[keep], length[keep], len(docs)).astype(np.int64)
        cuts, out = np.concatenate([[0], np.cumsum(n)]), []
        rest = set(whole.tolist())
        for k in range(len(docs)):
            out.append(self.many([docs[k]])[0] if k in rest else flat[cuts[k] : cuts[k + 1]])
            n[k] = len(out[-1])
        return np.concatenate(out), n


class Encoder(ChunkCache):
    """Texts to ids: each match of the pattern through the tree."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 500_000):
        self.bpe = Bpe(ranks, min(KEPT, limit // 2))
        super().__init__(pattern, self.trees, limit)

    def trees(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.bpe.piece(x.encode()) for x in pieces]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(length.sum())), length


@functools.lru_cache(2)
def encoder(path: str, pattern: str, limit: int = 500_000) -> Encoder:
    """One for each worker, which keeps it; limit: how many stretches it remembers."""
    return Encoder(read_ranks(path), pattern, limit)


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", keep_ids: bool = False, limit: int = 500_000) -> DataFrame:
    """For each row: key, n_tokens, ids_sha256, decoded_sha256, lossless and, if asked for, the ids.

    lossless tells whether the decoded bytes are the text's UTF-8 bytes.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * keep_ids

    def make():
        encode = encoder(rank_file, pattern, limit)

        def step(batch: pa.RecordBatch):
            given = texts(batch)
            flat, n = encode(given)
            cut = np.concatenate([[0], np.cumsum(n)]).tolist()
            le = flat.astype("<u4")
            coded, plain, same = [], [], []
            for k, text in enumerate(given):
                a, b = cut[k], cut[k + 1]
                back = encode.bpe.decode(flat[a:b].tolist())
                coded.append(hashlib.sha256(le[a:b]).hexdigest())
                plain.append(hashlib.sha256(back).hexdigest())
                same.append(back == text.encode())
            columns = [batch.column(key), pa.array(n), pa.array(coded), pa.array(plain), pa.array(same)]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "lossless"]
            if keep_ids:
                columns.append(pa.array([flat[cut[k] : cut[k + 1]].tolist() for k in range(len(given))], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

        return step

    return in_batches(docs.select(key, "text"), make, schema)
