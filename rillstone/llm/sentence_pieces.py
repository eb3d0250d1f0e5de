"""SentencePiece encoding and decoding by a forward pass over a trie of distinct words.

Texts are marked (spaces become the word mark, one is put in front) and cut into marked
words, which no piece crosses. The distinct words of a batch are sorted, so walking them
in order is a depth-first walk of their trie: the forward scores at the places of the
prefix that a word shares with the one before it are reused, only the rest is computed.

For a unigram vocabulary the forward score of a place is the best sum of piece scores
(Viterbi). A BPE vocabulary's pieces are not chosen by such sums: there the state of a
place is the last piece of the encoding of the prefix that ends there, and a piece may
follow another only if merging the two, in order of score, leaves exactly these two. That
gives the same ids as merging the whole word, which a best sum does not.

Defined results: null and empty texts have no ids; characters that are no piece become
their bytes' pieces (or the unknown piece without byte pieces); an empty table gives no
rows; rows with null or repeated ids are encoded each for itself.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.common import bounded_batches

MARK = "▁"
#: Distinct words, pairs of pieces, and steps between states that a worker remembers.
CACHE_WORDS = 600_000
CACHE_PAIRS = 500_000
CACHE_STEPS = 300_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """A vocabulary: pieces with scores, byte pieces, the unknown piece, and whether it is a unigram model."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], unknown: int, unigram: bool, ids: dict[str, int]) -> None:
        self.text = [p for p, _ in pieces]
        self.scores = [s for _, s in pieces]
        self.ids, self.byte_ids, self.unknown, self.unigram = ids, byte_ids, unknown, unigram
        self.bytes = {i: b for b, i in byte_ids.items()}
        # Pieces as text; bytes beyond ASCII are no whole characters.
        self.high = frozenset(i for i, b in self.bytes.items() if b > 127)
        self.whole = [" ⁇ " if i == unknown else chr(self.bytes[i]) if i in self.bytes else p for i, p in enumerate(self.text)]
        self.longest = max(map(len, ids), default=1)
        self.least = min(self.scores, default=0.0) - 10.0
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece crosses words")
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        # Merge order.
        self.order = [0.0] * len(pieces)
        for n, i in enumerate(sorted(range(len(pieces)), key=lambda i: -self.scores[i])):
            self.order[i] = float(n)
        # Pieces that merging makes from their own characters; no other can follow anything. All that they start with.
        self.made = {} if unigram else {p: i for p, i in ids.items() if len(p) > 1 and self._halves(i)}
        self.starts = {p[:k] for p in self.made for k in range(len(p) + 1)} | {""}
        self.steps: dict[str, tuple[str, tuple[tuple[int, int], ...], int | None]] = {}

    @classmethod
    def from_model(cls, path: str, unigram: bool = False) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [(m.id_to_piece(i), m.get_score(i)) for i in range(n)]
        plain = {p: i for i, (p, _) in enumerate(pieces) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        return cls(pieces, {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}, m.unk_id(), unigram, plain)

    # -- one word

    def _halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merging ends a piece's own encoding; none for a character or a piece that merging never makes."""
        found = self.halves.get(piece, False)
        if found is False:
            symbols = list(self.text[piece])
            last = None
            while len(symbols) > 1:
                scored = [(self.scores[m], -k) for k in range(len(symbols) - 1) if (m := self.ids.get(symbols[k] + symbols[k + 1])) is not None]
                if not scored:
                    last = None
                    break
                at = -max(scored)[1]
                last = (self.ids.get(symbols[at]), self.ids.get(symbols[at + 1]))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            found = self.halves[piece] = last if last and None not in last else None
        return found

    def follows(self, before: int, piece: int) -> bool:
        """Whether merging the two pieces' characters ends with these two pieces.

        Undo the merges of both, the latest first: the pair stands unless at some step the
        pieces at the seam would have merged earlier than what was undone.
        """
        key = before * len(self.text) + piece
        found = self.pairs.get(key)
        if found is not None:
            return found
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        limit, found = float("inf"), True
        while True:
            joined = self.ids.get(self.text[before] + self.text[piece])
            if joined is not None and self.order[joined] < limit:
                found = False
                break
            a, b = self._halves(before), self._halves(piece)
            if a and (not b or self.order[before] > self.order[piece]):
                limit, before = self.order[before], a[1]
            elif b:
                limit, piece = self.order[piece] + 0.5, b[0]
            else:
                break
        self.pairs[key] = found
        return found

    def _best_sum(self, word: str, end: int, best: list[float]) -> tuple[int, float]:
        """Viterbi step of a unigram vocabulary: length of the last piece of the prefix up to end, and its forward score."""
        found = (1, best[end - 1] + self.least)
        for size in range(1, min(end, self.longest) + 1):
            piece = self.ids.get(word[end - size : end])
            if piece is not None and best[end - size] + self.scores[piece] > found[1]:
                found = (size, best[end - size] + self.scores[piece])
        return found

    def _step(self, read: str) -> tuple[str, tuple[tuple[int, int], ...], int | None]:
        """The state after a state and a character: the longest end of both that a made piece starts with.

        With it the made pieces that end there, (length, id), longest first, and the character's own.
        """
        if len(self.steps) >= CACHE_STEPS:
            self.steps.clear()
        state = next(read[k:] for k in range(len(read) + 1) if read[k:] in self.starts)
        pieces = tuple((len(state) - k, self.made[state[k:]]) for k in range(len(state)) if state[k:] in self.made)
        found = self.steps[read] = (state, pieces, self.ids.get(read[-1]))
        return found

    def learn(self, words: list[str]) -> None:
        """Encode distinct words in sorted order and remember them; forward states of shared prefixes are computed once.

        The state of a place is the last piece of the prefix up to it: its length and id, for a unigram
        vocabulary its forward score too, for another where it is in the trie of made pieces.
        """
        size_at, id_at, best, at, before = [0], [None], [0.0], [""], ""
        ids_get, steps_get, pairs_get, step, follows, count = self.ids.get, self.steps.get, self.pairs.get, self._step, self.follows, len(self.text)
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del size_at[shared + 1 :], id_at[shared + 1 :], best[shared + 1 :], at[shared + 1 :]
            state = at[-1]
            for end in range(shared + 1, len(word) + 1):
                if self.unigram:
                    size, score = self._best_sum(word, end, best)
                    best.append(score)
                    piece = ids_get(word[end - size : end])
                else:
                    read = state + word[end - 1]
                    state, longer, single = steps_get(read) or step(read)
                    at.append(state)
                    for size, piece in longer:
                        left = id_at[end - size]
                        if left is None:  # the word's start, or a character that is no piece
                            break
                        fits = pairs_get(left * count + piece)
                        if follows(left, piece) if fits is None else fits:
                            break
                    else:
                        size, piece = 1, single
                size_at.append(size)
                id_at.append(piece)
            before, end, ids = word, len(word), []
            while end:
                piece = id_at[end]
                if piece is not None:
                    ids.append(piece)
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in reversed(word[end - size_at[end] : end].encode())]
                else:
                    ids.append(self.unknown)
                end -= size_at[end]
            ids.reverse()
            self.words[word[1:]] = array("I", ids).tobytes()

    # -- texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as native unsigned 32-bit integers."""
        plain = lambda t: "  " not in t and MARK not in t and t[0] != " " != t[-1]
        # Every word starts with a mark, and is remembered without it.
        cut = [(t.split(" ") if plain(t) else [w[1:] for w in _WORD.findall(MARK + t.replace(" ", MARK))]) if t else [] for t in texts]
        every = set().union(*cut)
        fresh = every - self.words.keys()
        if len(self.words) + len(fresh) > CACHE_WORDS:
            self.words.clear()
            fresh = every
        self.learn([MARK + w for w in fresh])
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids: bytes joined into characters, marks back to spaces, the one in front dropped."""
        if self.high.isdisjoint(ids):  # every piece is whole characters
            text = "".join(map(self.whole.__getitem__, ids))
            return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            byte = self.bytes.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
            parts.append(self.text[i] if i != self.unknown else " ⁇ ")
        parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts)
        return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")


_LOADED: dict[str, Pieces] = {}


def load(name: str) -> Pieces:
    """One vocabulary a worker; name is a public tokenizer's file."""
    if name not in _LOADED:
        import public_tokenizers

        _LOADED[name] = Pieces.from_model(public_tokenizers.path(name))
    return _LOADED[name]


def _ids(rows: list[bytes]) -> pa.Array:
    sizes = array("i", [0])
    for r in rows:
        sizes.append(sizes[-1] + len(r) // 4)
    values = pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(rows))])
    offsets = pa.Array.from_buffers(pa.int32(), len(sizes), [None, pa.py_buffer(sizes)])
    return pa.ListArray.from_arrays(offsets, values)


def _digest(pieces: Pieces, rows: list[bytes]) -> list[pa.Array]:
    """n_tokens, ids_crc32 and decoded_sha256 of ids, each row's decoded from them."""
    texts = (pieces.decode(memoryview(r).cast("I").tolist()) for r in rows)
    return [pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array(map(zlib.crc32, rows), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]


_DIGEST = "ids array<int>, n_tokens long, ids_crc32 long, decoded_sha256 string"
_NAMES = ["id", "ids", "n_tokens", "ids_crc32", "decoded_sha256"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), docs.schema[id_col].dataType.simpleString()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, ids) of every whole text."""
    rows, kind = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids(pieces.encode([t.as_py() or "" for t in batch.column(1)]))], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>")


def decoded(rows: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, ids, n_tokens, ids_crc32, decoded_sha256): the ids with their checksum (little-endian 32-bit) and the decoded text's SHA-256."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            own = [array("I", ids.values.to_pylist() if ids.is_valid else []).tobytes() for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_digest(pieces, own)], names=_NAMES)

    return rows.select("id", "ids").mapInArrow(run, f"id {kind}, {_DIGEST}")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """decoded(encoded(docs)) in one pass, so that ids go through one worker and come out once."""
    rows, kind = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            own = pieces.encode([t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), _ids(own), *_digest(pieces, own)], names=_NAMES)

    return rows.mapInArrow(run, f"id {kind}, {_DIGEST}")
