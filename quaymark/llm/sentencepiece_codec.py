"""SentencePiece BPE encoding and decoding by suffix-array matching and edge relaxation.

A batch's new words are laid out as one text and indexed by a suffix array that is sorted as deep as the longest
piece. Every piece of the vocabulary is binary-searched in it; the range found lists all of its occurrences. These
are the edges of the word lattice; they are sorted by the position they end at and relaxed in that order.

BPE is not the best path of that lattice but the one its merges lead to, and that path is unique: a prefix's last
piece is the only edge whose start is reached and that the piece before it may be followed by, where two pieces may
follow each other when merging their symbols leaves exactly these two. So an edge is relaxed where the pair is
allowed; no score is compared. Scores enter as the merge order that decides which pairs are allowed.

Text is prepared as the model asks: a leading space, spaces as U+2581. No piece of such a model has U+2581 after
another character, so words (spaces, then what is no space) are encoded on their own, each different word once.
Runs of several spaces, whose pieces share one score, and words a piece with an equal score could split, are merged
step by step instead. Characters without a piece become byte pieces.

Defined results: null text is empty and encodes to no id; decoding gives the text back, save that U+2581 in a text
comes back as a space (as in the library); unpaired surrogates cannot occur in Spark strings; ids that are no pieces
decode to nothing; repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

import heapq
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaymark.llm import common

SPACE = "▁"
#: Words (and piece pairs) a Python worker remembers, characters of the texts it holds at once, and symbols of new
#: words in one suffix array; all bound its memory.
REMEMBERED = 400_000
SLICE_CHARS = 1_000_000
LATTICE_SYMBOLS = 300_000
#: Longer words are merged step by step.
LONGEST_WORD = 64
NORMAL, UNKNOWN, BYTE = 1, 2, 6

_WORDS = re.compile(" *[^ ]+| +")
_WIDE = re.compile("  | $")


def _fields(data: bytes):
    """Field numbers and values of one protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 2:
            size, at = number(at)
            yield key >> 3, data[at : at + size]
            at += size
        elif key & 7 == 0:
            value, at = number(at)
            yield key >> 3, value
        else:
            size = 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Vocabulary:
    """Pieces, scores and kinds of a model file, and whether a space is put before the text."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    prefix: bool = True

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        pieces, scores, kinds, prefix = [], [], [], True
        with open(path, "rb") as file:
            for field, value in _fields(file.read()):
                if field == 1:
                    piece = dict(_fields(value))
                    pieces.append(piece[1].decode())
                    scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                    kinds.append(piece.get(3, NORMAL))
                elif field == 3:
                    prefix = bool(dict(_fields(value)).get(3, 1))
        return cls(pieces, np.array(scores), np.array(kinds), prefix)


def merged(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Plain BPE: the pair of least rank first, the leftmost of equals."""
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank]
    heapq.heapify(queue)
    while queue:
        _, i, piece = heapq.heappop(queue)
        if parts[i] is None or after[i] >= len(parts) or parts[after[i]] is None or parts[i] + parts[after[i]] != piece:
            continue
        gone = after[i]
        parts[i], parts[gone], after[i] = piece, None, after[gone]
        if after[i] < len(parts):
            before[after[i]] = i
            right = piece + parts[after[i]]
            if right in rank:
                heapq.heappush(queue, (rank[right], i, right))
        if before[i] >= 0:
            left = parts[before[i]] + piece
            if left in rank:
                heapq.heappush(queue, (rank[left], before[i], left))
    return [p for p in parts if p is not None]


class _Codes(dict):
    """Numbers words in the order in which they are first met."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.fresh.append(word)
        return code


class Codec:
    """Encodes and decodes with one vocabulary; remembers words and pairs within bounded memory."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        normal = np.flatnonzero(v.kinds == NORMAL)
        ranks = np.searchsorted(np.unique(-v.scores[normal]), -v.scores[normal])  # equal scores, equal rank
        self.rank = {v.pieces[i]: int(r) for i, r in zip(normal, ranks)}
        self.id = {v.pieces[i]: int(i) for i in normal}
        self.byte = {int(v.pieces[i][3:5], 16): int(i) for i in np.flatnonzero(v.kinds == BYTE)}
        self.unknown = int(np.flatnonzero(v.kinds == UNKNOWN)[0])
        spoken = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b""
            for p, k in zip(v.pieces, v.kinds.tolist())
        ]
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self.spoken_len = np.array([len(t) for t in spoken], np.int64)
        self.spoken_at = np.cumsum(self.spoken_len) - self.spoken_len
        self.edges = [p for p in self.rank if merged(list(p), self.rank) == [p]]  # others are never reached
        self.edge_id = np.array([self.id[p] for p in self.edges] + [-1], np.int64)
        self.edge_len = np.array([len(p) for p in self.edges] + [1], np.int64)
        self.stray = len(self.edges)  # the edge of a character without a piece
        self._trie()
        self.forget()
        self.pairs: dict[int, bool] = {}

    def forget(self) -> None:
        self.code = _Codes()
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _trie(self) -> None:
        """Prefixes of the pieces by length: the node each extends, its last symbol, and the piece it is."""
        symbols = sorted({c for p in self.edges for c in p})
        self.symbol = np.zeros(0x110000, np.int64)
        self.symbol[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        self.width = int(len(symbols)).bit_length()
        place, self.levels = {"": 0}, []
        whole = {p: i for i, p in enumerate(self.edges)}
        for depth in range(1, max(map(len, self.edges)) + 1):
            nodes = sorted({p[:depth] for p in self.edges if len(p) >= depth})
            parent = np.array([place[n[:-1]] for n in nodes])
            letter = self.symbol[[ord(n[-1]) for n in nodes]]
            self.levels.append((parent, letter, np.array([whole.get(n, -1) for n in nodes])))
            place = {n: i for i, n in enumerate(nodes)}

    def suffix_array(self, text: np.ndarray) -> np.ndarray:
        """Starts of all suffixes, sorted by as many symbols as the longest piece has, by doubling ranks."""
        n, depth = len(text), 1
        pack = max(1, 60 // self.width)
        padded = np.concatenate([text, np.zeros(64, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(pack):
            key = (key << self.width) | padded[j : j + n]
        depth = pack
        while True:
            order = np.argsort(key, kind="stable")
            if depth >= len(self.levels):
                return order
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            further = np.concatenate([rank[depth:] + 1, np.zeros(min(depth, n), np.int64)])
            key, depth = rank * np.int64(n + 2) + further, 2 * depth

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of a text of symbols: piece and start, from a binary search of every piece."""
        order = self.suffix_array(text)
        padded = np.concatenate([text, np.zeros(len(self.levels) + 1, np.int64)])
        lo, hi = np.zeros(1, np.int64), np.full(1, len(text))
        pieces, starts = [], []
        for depth, (parent, letter, piece) in enumerate(self.levels):
            bounds = []
            for wanted in (letter, letter + 1):
                a, b = lo[parent].copy(), hi[parent].copy()
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    middle = (a + b) >> 1
                    less = open_ & (padded[order[np.minimum(middle, len(text) - 1)] + depth] < wanted)
                    a = np.where(less, middle + 1, a)
                    b = np.where(open_ & ~less, middle, b)
                bounds.append(a)
            lo, hi = bounds
            count = np.where(piece >= 0, hi - lo, 0)
            ends = np.cumsum(count)
            starts.append(order[np.arange(ends[-1]) + np.repeat(lo - (ends - count), count)])
            pieces.append(np.repeat(piece, count))
        return np.concatenate(pieces), np.concatenate(starts)

    def may_follow(self, codes: np.ndarray) -> np.ndarray:
        """Whether merging the symbols of two pieces side by side ends in exactly these two, by pair code."""
        base, known = len(self.edges) + 1, self.pairs
        if len(known) > 2 * REMEMBERED:
            known.clear()
        distinct, back = np.unique(codes, return_inverse=True)
        out = np.empty(len(distinct), bool)
        for k, code in enumerate(distinct.tolist()):
            ok = known.get(code)
            if ok is None:
                left, right = divmod(code, base)
                if self.stray in (left, right):
                    ok = True
                else:
                    a, b = self.edges[left], self.edges[right]
                    ok = merged([*a, *b], self.rank) == [a, b]
                known[code] = ok
            out[k] = ok
        return out[back.ravel()]

    def _stepwise(self, word: str) -> list[int]:
        ids = []
        for piece in merged(list(word), self.rank):
            got = self.id.get(piece)
            ids += [got] if got is not None else self._bytes(piece)
        return ids

    def _bytes(self, piece: str) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in piece.encode("utf-8", "replace")]

    def _relaxed(self, words: list[str]) -> list[np.ndarray | None]:
        """Ids of words over the lattice of their pieces; None where the last position isn't reached."""
        joined = "\n".join(words)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        text = self.symbol[points]
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        text[(first + sizes)[:-1]] = 0  # what separates words is no symbol
        piece, start = self.occurrences(text)
        inside = np.ones(len(text), bool)
        inside[(first + sizes)[:-1]] = False
        strays = np.flatnonzero((text == 0) & inside)
        piece, start = np.concatenate([piece, np.full(len(strays), self.stray)]), np.concatenate([start, strays])
        word = np.searchsorted(first, start, "right") - 1
        stop = start + self.edge_len[piece] - first[word]  # place of the end within the word
        order = np.argsort(stop, kind="stable")
        piece, start, stop, word = piece[order], start[order], stop[order], word[order]
        last = np.full(len(text) + 1, -1, np.int64)  # piece that ends before a position
        cuts = np.searchsorted(stop, np.arange(1, int(sizes.max()) + 2))
        base = len(self.edges) + 1
        for p in range(int(sizes.max())):
            some = slice(cuts[p], cuts[p + 1])
            of, at = piece[some], start[some]
            begins = at == first[word[some]]
            before = last[at]
            fits = begins | (before >= 0)
            check = np.flatnonzero(fits & ~begins)
            fits[check] = self.may_follow(before[check] * base + of[check])
            last[(at + self.edge_len[of])[fits]] = of[fits]
        at = first + sizes
        reached = last[at] >= 0
        live = np.flatnonzero(reached)
        found_word, found_at, found_piece = [], [], []
        at = at[live]
        while len(live):
            now = last[at]
            at = at - self.edge_len[now]
            found_word.append(live)
            found_at.append(at)
            found_piece.append(now)
            on = at > first[live]
            live, at = live[on], at[on]
        if not found_word:
            return [None] * len(words)
        w, a, q = (np.concatenate(x) for x in (found_word, found_at, found_piece))
        order = np.lexsort((a, w))
        w, a, ids = w[order], a[order], self.edge_id[q[order]].astype(np.int32)
        ends = np.searchsorted(w, np.arange(1, len(words) + 1))
        out: list[np.ndarray | None] = [None] * len(words)
        for k, (i, j) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())):
            if j > i:
                part = ids[i:j]
                if part.min() < 0:
                    part = np.array(
                        [x for t, y in zip(part.tolist(), a[i:j].tolist()) for x in ([t] if t >= 0 else self._bytes(joined[y]))],
                        np.int32,
                    )
                out[k] = part
        return out

    def _learn(self) -> None:
        fresh, self.code.fresh = self.code.fresh, []
        plain = [w.replace(" ", SPACE) for w in fresh]
        simple = [k for k, w in enumerate(plain) if len(w) <= LONGEST_WORD and SPACE not in w[1:] and "\n" not in w]
        got: list = [None] * len(fresh)
        ends = np.cumsum([len(plain[k]) + 1 for k in simple])
        at = 0
        while at < len(simple):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LATTICE_SYMBOLS)))
            for k, ids in zip(simple[at:upto], self._relaxed([plain[k] for k in simple[at:upto]])):
                got[k] = ids
            at = upto
        got = [np.array(self._stepwise(w), np.int32) if ids is None else ids for w, ids in zip(plain, got)]
        size = np.array([len(x) for x in got], np.int64)
        self.begin = np.append(self.begin, np.cumsum(size) - size + len(self.flat))
        self.size = np.append(self.size, size)
        self.flat = np.concatenate([self.flat, *got])

    def _words(self, text: str) -> list[str]:
        text = (" " if self.vocabulary.prefix else "") + text
        if SPACE in text or _WIDE.search(text) or not text.startswith(" "):
            return _WORDS.findall(text.replace(SPACE, " "))
        return [" " + w for w in text[1:].split(" ")]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        return [ids for part in slices(texts) for ids in self._encode_slice(texts[part])]

    def _encode_slice(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.code) > REMEMBERED:
            self.forget()
        split = [self._words(t) if t else [] for t in texts]
        words = [w for part in split for w in part]
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if self.code.fresh:
            self._learn()
        count = self.size[codes]
        ends = np.cumsum(count)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[codes] - (ends - count), count)]
        cut = np.concatenate([[0], ends])[np.cumsum([0] + [len(p) for p in split])]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of id lists; bytes that are no UTF-8 become U+FFFD."""
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        real = (flat >= 0) & (flat < len(self.spoken_len))
        count = np.where(real, self.spoken_len[np.where(real, flat, 0)], 0)
        ends = np.cumsum(count)
        begin = self.spoken_at[np.where(real, flat, 0)]
        data = self.spoken[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)].tobytes()
        cut = np.concatenate([[0], ends])[np.cumsum([0] + [len(x) for x in ids])].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]
        return [t[1:] if self.vocabulary.prefix and t.startswith(" ") else t for t in texts]


def slices(texts: list[str]) -> list[slice]:
    """Consecutive texts of about SLICE_CHARS characters; a longer text is a slice of its own."""
    out, at = [], 0
    while at < len(texts):
        upto, chars = at + 1, len(texts[at])
        while upto < len(texts) and chars + len(texts[upto]) <= SLICE_CHARS:
            chars += len(texts[upto])
            upto += 1
        out.append(slice(at, upto))
        at = upto
    return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(Vocabulary.read(path))
    return _codecs[path]


def _listed(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))


def _encode(path: str):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                ids = codec(path).encode(texts[part])
                doc_ids = batch.column(0)[part.start : part.stop]
                yield pa.RecordBatch.from_arrays([doc_ids, _listed(ids)], ["doc_id", "token_ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, token_ids`` of every whole text."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", common.whole_text().alias("text")).mapInArrow(
        _encode(path), f"doc_id {kind}, token_ids array<int>"
    )


def _decode(path: str):
    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
                texts = pa.array(codec(path).decode(ids), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of every id list."""
    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "token_ids").mapInArrow(_decode(path), f"doc_id {kind}, text string")


def _round_trip(path: str):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            both = codec(path)
            for part in slices(texts):
                ids = both.encode(texts[part])
                same = [a.replace(SPACE, " ") == b for a, b in zip(texts[part], both.decode(ids))]
                crcs = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                counts = pa.array([len(x) for x in ids], pa.int64())
                doc_ids = batch.column(0)[part.start : part.stop]
                columns = [doc_ids, counts, crcs, _listed(ids), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "token_ids", "decodes"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, token_ids, decodes``; ``decodes`` says that decoding gave the text back."""
    kind = dict(docs.dtypes)["doc_id"]
    form = f"doc_id {kind}, n_tokens long, ids_crc32 long, token_ids array<int>, decodes boolean"
    return docs.select("doc_id", common.whole_text().alias("text")).mapInArrow(_round_trip(path), form)
