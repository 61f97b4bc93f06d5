"""BPE encoding by a streaming transducer with bounded lookahead, and incremental decoding.

Merges apply by rank. Cutting a word at some place changes merges only in a stretch left of the cut: each change lets one more token, by a
later merge, take part. The longest such chain in the merge list is its sufficient lookahead. So the encoder reads a word's bytes into a
window, and once a token's end lies further from the window's end than the lookahead, all tokens up to it are final: they are emitted and
their bytes dropped. Memory is a few lookaheads, however long the word. Short words go through the same merging and are kept in a bounded
cache. A text is taken a stretch at a time, and each block of ids goes to the digests and through the decoder before the next is made.

Defined cases: a null or empty text has no tokens; texts of white space have none; strings of the two special tokens are their ids, as the
file says; bytes without a token are left out; repeated rows give equal rows; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, struct_of

#: Whole words up to this many characters are cached, so many at most: some 20 MB a cache.
CACHED_CHARS, CACHED_WORDS = 48, 1 << 16
#: Characters of a text that are taken at once, up to the next white space.
STRETCH = 1 << 16
_NONE = 1 << 30
_SPACE = regex.compile(r"\p{White_Space}")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it can be seen in Latin-1, else the next character from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Merges:
    """A merge list over token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", r"\p{White_Space}"))
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        #: Rank by pair of ids (in one number), and the id that each rank's merge makes.
        self.rank = {(self.vocab[a] << 20) | self.vocab[b]: rank for rank, (a, b) in reversed([*enumerate(pairs)])}
        self.made = [self.vocab[a + b] for a, b in pairs]
        letters = byte_alphabet()
        self.inner = [self.vocab.get(c, -1) for c in letters]
        self.final = [self.vocab.get(c + self.suffix, -1) for c in letters]
        self.names = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for name, number in chain(self.vocab.items(), self.special.items()):
            self.names[number] = name
        self.width = [max(1, len(n.removesuffix(self.suffix))) for n in self.names]
        self.lookahead = self._lookahead(pairs)
        self._bytes: dict[bool, list[bytes]] = {}

    def bytes_of(self, surface: bool) -> list[bytes]:
        """Per id the bytes that it decodes to: its own name after a space, or the text that it stands for."""
        if surface not in self._bytes:
            byte = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}

            def plain(name: str) -> bytes:
                core = name.removesuffix(self.suffix)
                return name.encode() if name in self.special else b"".join(byte[c] for c in core) + b" " * (len(core) < len(name))

            self._bytes[surface] = [f" {n}".encode() if surface else plain(n) for n in self.names]
        return self._bytes[surface]

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """The most symbols left of a cut whose tokens the cut can change.

        A merge (u, v) moves the leftmost changed place by the length of u if v starts there. v then begins with the token that the
        merge before, of lower rank, moved it by. So chains are followed in order of rank, by prefixes of v.
        """
        longest: dict[str, int] = {}
        for u, v in pairs:
            reach = max((longest.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
            longest[u] = max(longest.get(u, 0), len(u.removesuffix(self.suffix)) + reach)
        return max(longest.values(), default=1)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges by rank, leftmost first."""
        if len(symbols) < 2:
            return symbols
        if len(symbols) > 64:
            return self._merge_long(symbols)
        rank, out = self.rank.get, [*symbols]
        ranks = [rank((a << 20) | b, _NONE) for a, b in zip(out, out[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            out[i] = self.made[best]
            del out[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((out[i] << 20) | out[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank((out[i - 1] << 20) | out[i], _NONE)
        return out

    def _merge_long(self, symbols: list[int]) -> list[int]:
        rank, n = self.rank.get, len(symbols)
        token, after, before = [*symbols], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank((symbols[i] << 20) | symbols[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if (r := rank((token[i] << 20) | token[j], _NONE)) != _NONE:
                heapq.heappush(heap, (r, i, token[i], token[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if token[i] == a else n
            if j >= n or token[j] != b:
                continue
            token[i], token[j], after[i] = self.made[r], -2, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [t for t in token if t != -2]


class Transducer:
    """Encodes one word, fed in pieces of bytes, with a window of a few lookaheads."""

    def __init__(self, merges: Merges, window: int | None = None):
        self.merges, self.window = merges, window or 4 * merges.lookahead + 64
        self.symbols: list[int] = []
        self.held: int | None = None

    def whole(self, data: bytes) -> list[int]:
        """The tokens of a word that fits the window."""
        m = self.merges
        symbols = [*map(m.inner.__getitem__, data[:-1]), m.final[data[-1]]]
        return m.merge(symbols if min(symbols) >= 0 else [x for x in symbols if x >= 0])

    def feed(self, data: bytes) -> Iterator[int]:
        """Take bytes; yield tokens that are final."""
        for byte in data:
            if self.held is not None and (s := self.merges.inner[self.held]) >= 0:
                self.symbols.append(s)
                if len(self.symbols) >= self.window:
                    yield from self._stable()
            self.held = byte

    def _stable(self) -> Iterator[int]:
        end, safe = 0, len(self.symbols) - self.merges.lookahead - 1
        for token in self.merges.merge(self.symbols):
            if end + self.merges.width[token] > safe:
                break
            end += self.merges.width[token]
            yield token
        self.symbols = self.symbols[end:]

    def finish(self) -> Iterator[int]:
        """End the word; yield the rest."""
        if self.held is not None and (s := self.merges.final[self.held]) >= 0:
            self.symbols.append(s)
        yield from self.merges.merge(self.symbols)
        self.symbols, self.held = [], None


_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Text to ids."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.merges.special) + ")") if self.merges.special else None

    @staticmethod
    def load(path: str) -> Encoder:
        """The encoder of a file, once per process."""
        if path not in _LOADED:
            _LOADED[path] = Encoder(path)
        return _LOADED[path]

    def words(self, text: str) -> Iterable[str]:
        """Stretches without white space of a text, normalised. No token crosses white space."""
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes these for white space
            return [w for w in regex.split(r"\p{White_Space}+", text) if w]
        return text.split()

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one such stretch."""
        pieces_ = (word,) if word.isalpha() else self.merges.pattern.findall(word)
        if len(pieces_) == 1:
            return self.piece(pieces_[0])
        return tuple(chain.from_iterable(map(self.piece, pieces_)))

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of what the pattern takes as one word."""
        ids = self.pieces.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "replace")
            transducer = Transducer(self.merges)
            ids = tuple(transducer.whole(data) if len(data) < transducer.window else chain(transducer.feed(data), transducer.finish()))
            if len(piece) <= CACHED_CHARS:
                if len(self.pieces) >= CACHED_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def stream(self, text: str) -> Iterator[int]:
        """The ids of a text, one by one; only a window of a long word is held."""
        for part in self._parts(text):
            if part in self.merges.special:
                yield self.merges.special[part]
                continue
            for word in self.words(part):
                for piece in self.merges.pattern.finditer(word):
                    transducer = Transducer(self.merges)
                    for at in range(piece.start(), piece.end(), 4096):
                        yield from transducer.feed(word[at : min(at + 4096, piece.end())].encode("utf-8", "replace"))
                    yield from transducer.finish()

    def blocks(self, text: str, stretch: int = STRETCH) -> Iterator[list[int]]:
        """The ids of a text in order, a block for each stretch of it; a word beyond the stretch goes through the window alone."""
        for part in self._parts(text):
            if part in self.merges.special:
                yield [self.merges.special[part]]
                continue
            at = 0
            while at < len(part):
                space = _SPACE.search(part, at + stretch) if len(part) - at > stretch else None
                to = space.start() if space else len(part)
                if to - at <= 2 * stretch:
                    yield self._plain(part[at:to])
                else:
                    ids = self.stream(part[at:to])
                    while block := [*islice(ids, stretch)]:
                        yield block
                at = to

    def _parts(self, text: str) -> Iterable[str]:
        """The text cut at special tokens."""
        return self.cut.split(text) if self.cut and self.cut.search(text) else (text,)

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return [*chain.from_iterable(self.blocks(text))]

    def _plain(self, text: str) -> list[int]:
        cache, words = self.cache, self.words(text)
        try:
            return [*chain.from_iterable(map(cache.__getitem__, words))]
        except KeyError:
            out: list[int] = []
            for w in words:
                ids = cache.get(w)
                if ids is None:
                    ids = self.word(w)
                    if len(w) <= CACHED_CHARS:
                        if len(cache) >= CACHED_WORDS:
                            cache.clear()
                        cache[w] = ids
                out.extend(ids)
            return out


class Decoder:
    """Ids to text, block by block.

    surface=True gives what the library's decode gives where a file names no decoder: the tokens' own strings, spaces between.
    Else a word's end becomes a space. Either way bytes go through an incremental UTF-8 state machine, which holds what a block leaves
    open; bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, merges: Merges, surface: bool = False):
        self.table, self.surface = merges.bytes_of(surface), surface
        self.machine, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, number: int) -> str:
        """The text that this id completes."""
        return self.feed_block((number,))

    def feed_block(self, ids: Iterable[int]) -> str:
        """The text that these ids complete."""
        data = b"".join(map(self.table.__getitem__, ids))
        if self.surface and self.first and data:
            data, self.first = data[1:], False  # the first token has no space before it
        return self.machine.decode(data)

    def finish(self) -> str:
        """What is left."""
        return self.machine.decode(b"", True)


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        digits = [b" %d" % i for i in range(len(encoder.merges.names))]
        for batch in (p for whole in batches for p in pieces(whole, "text")):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                n, ids_digest, text_digest, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(encoder.merges, surface=True)
                for block in encoder.blocks(text.as_py() or ""):
                    data = b"".join(map(digits.__getitem__, block))
                    ids_digest.update(data if n else data[1:])
                    text_digest.update(decoder.feed_block(block).encode())
                    n += len(block)
                text_digest.update(decoder.finish().encode())
                counts.append(n)
                ids_sha.append(ids_digest.hexdigest())
                text_sha.append(text_digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def default_path() -> str:
    """The public tokenizer file that the queries use; it must be installed on the executors too."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids, spaces between) and decoded_sha256. Rows stay where they are."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_coder(path or default_path()), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _listed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path)
        for batch in (p for whole in batches for p in pieces(whole, "text")):
            ids, ends = array("i"), [0]
            for text in batch.column("text"):
                for block in encoder.blocks(text.as_py() or ""):
                    ids.extend(block)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(np.diff(ends), pa.int64()), lists], ["kept", "n_tokens", "ids"])

    return run


def encoded(docs: DataFrame, *, text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs, then n_tokens and ids (array<int>); keep can't hold columns of these two names."""
    small_batches(docs.sparkSession)
    if clash := {c.lower() for c in keep} & {"n_tokens", "ids"}:
        raise ValueError(f"columns that are made here can't be kept: {sorted(clash)}")
    rows = docs.select(struct_of(docs, keep).alias("kept"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_listed(path or default_path()), f"kept {rows.schema['kept'].dataType.simpleString()}, n_tokens bigint, ids array<int>").select("kept.*", "n_tokens", "ids")
