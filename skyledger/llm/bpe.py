"""Byte-level BPE as a streaming transducer, and the decoder that goes with it.

Encoding reads a text in chunks, keeps only what later characters can still change, and emits a token
as soon as it is stable:

* A special token's string is cut out first; a chunk keeps back as many characters as such a string
  may still need.
* The chunk is cut into pieces; the last two stay back, as later characters can change no earlier
  piece.  A run of one character class longer than a chunk is passed on in parts.
* Within a piece, tokens are stable once `lookahead` bytes follow them.  That number is computed from
  the merge list, see `Merges.lookahead`.

So memory is bounded by chunk, lookahead and a bounded cache of short pieces, whatever the text's
length.  Decoding is a state machine from bytes to text, which holds at most three pending bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import LETTER, OTHER, SPACE, classes, vocabulary_file

CHUNK = 1 << 16  # characters of text that the encoder takes at a time
SHORT = 48  # characters: pieces up to this length are remembered
REMEMBERED = 300_000  # pieces, and pairs of tokens; beyond, the cache starts anew
LONG_BUFFER = 4096  # bytes of a long piece between two emissions

# What an apostrophe that starts a piece takes with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def split(text: str) -> list[str]:
    """The pieces within which merging takes place.

    A piece is a run of letters, of numbers or of other characters, each with one blank before it if
    there is one; an apostrophe with a contraction; or spaces, of which the last stands alone before
    anything that is no space, unless it is that blank.
    """
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = classes()[points]
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    kind, ends = kinds[starts], np.append(starts[1:], len(points))
    # The last space before something else moves to a place of its own, or to the next run as its blank.
    inner = (kind == SPACE) & (ends < len(points))
    blank = points[ends - 1] == ord(" ")
    lead = np.append(False, (inner & blank)[:-1])  # runs that take a blank
    # Spaces that leave one of them: all of a run but the last one, if there are more.
    cuts = np.concatenate([starts - lead, (ends - 1)[inner & ~blank]])
    places = set(cuts.tolist())
    if "'" in text:
        single = (kind[:-1] == OTHER) & (ends[:-1] - starts[:-1] == 1) & ~lead[:-1] & (kind[1:] == LETTER)
        for run in (np.flatnonzero(single & (points[starts[:-1]] == ord("'"))) + 1).tolist():
            letters = int(starts[run])
            taken = next((c for c in CONTRACTIONS if text.startswith(c, letters)), "")
            if taken:
                places.remove(letters)
                places.add(letters + len(taken))
        places.discard(len(text))
    first = sorted(places)
    return [text[a:b] for a, b in zip(first, [*first[1:], len(text)])]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, inverted.

    Printable bytes of Latin-1 stand for themselves, the others follow from code point 256 on.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge list of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(vocabulary_file(path), encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        model = content["model"]
        raw = lambda token: bytes(letters[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.id_of = {raw(token): number for token, number in model["vocab"].items()}
        # A pair of ids -> (its place in the merge list, the id it becomes).
        self.rule = {}
        for place, (a, b) in enumerate(pairs):
            left, right = raw(a), raw(b)
            self.rule[self.id_of[left], self.id_of[right]] = (place, self.id_of[left + right])
        # By id: place of the rule that makes the token, and its two parts; -1 for a byte.
        self.made = {number: (-1, -1, -1) for number in self.id_of.values()}
        self.made |= {whole: (place, a, b) for (a, b), (place, whole) in reversed(self.rule.items())}
        self.longest = max(map(len, self.id_of))
        self.apart = Apart(self)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of = {number: token for token, number in self.id_of.items()}
        self.bytes_of |= {number: text.encode() for text, number in self.special.items()}
        self.spelled = np.empty(max(self.bytes_of) + 1, object)
        self.spelled[list(self.bytes_of)] = list(self.bytes_of.values())
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes after which no continuation changes a token any more.

        Compare a text's merging with that of the same text and other bytes behind it.  The place up to
        which both agree moves left only when one of them applies a rule (x, y) to the last common
        token x, where y starts with the x of the previous such move and the rule comes later in the
        list.  So the distance is at most the heaviest chain of rules in list order, rule (x, y)
        weighing len(x), in which each y has the previous x on its left edge.
        """
        heaviest: dict[int, int] = {}  # by the x of a chain's last rule
        left_of: dict[int, int] = {}
        for (x, y), (_, z) in sorted(self.rule.items(), key=lambda item: item[1][0]):
            edge, behind = y, heaviest.get(y, 0)
            while edge in left_of:
                edge = left_of[edge]
                behind = max(behind, heaviest.get(edge, 0))
            heaviest[x] = max(heaviest.get(x, 0), len(self.bytes_of[x]) + behind)
            left_of.setdefault(z, x)
        return max(heaviest.values(), default=0)

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart when they meet.

        Undo the rules that made them, the latest first; no rule may join what touches at the border
        before the rule undone last was applied.
        """
        made, rule, limit = self.made, self.rule, len(self.rule)
        while True:
            across = rule.get((a, b))
            if across and across[0] < limit:
                return False
            place_a, left_a, right_a = made[a]
            place_b, left_b, right_b = made[b]
            if place_a > place_b:
                limit, a = place_a, right_a
            elif place_b >= 0:
                # The same rule is applied from left to right: across the border before inside b.
                limit, b = place_b + 1, left_b
            else:
                return True

    def tokens(self, piece: bytes) -> list[int]:
        """Token ids of a whole piece.

        Merging by the list leaves the only sequence of tokens whose neighbours all stay apart.  It is
        found from left to right: the longest token that stays apart from the one before; if there is
        none, the one before becomes shorter.
        """
        id_of, apart, longest = self.id_of, self.apart, self.longest
        ids: list[int] = []
        starts: list[int] = []
        at, size, end = 0, len(piece), min(longest, len(piece))
        while at < size:
            before = ids[-1] if ids else -1
            while end > at:
                token = id_of.get(piece[at:end])
                if token is not None and (before < 0 or apart[before, token]):
                    break
                end -= 1
            if end > at:
                ids.append(token)
                starts.append(at)
                at, end = end, min(size, end + longest)
            else:
                ids.pop()
                end, at = at - 1, starts.pop()
        return ids


class Apart(dict):
    """Remembers which pairs of tokens stay apart."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        self[pair] = found = self.merges.stable(*pair)
        return found


class LongPiece:
    """Encodes one piece that arrives in parts; ids come out once they are stable."""

    def __init__(self, merges: Merges):
        self.merges, self.buffer = merges, b""

    def feed(self, part: bytes, final: bool = False) -> Iterator[int]:
        self.buffer += part
        if not final and len(self.buffer) < LONG_BUFFER + self.merges.lookahead:
            return
        stable = len(self.buffer) if final else len(self.buffer) - self.merges.lookahead
        at = 0
        for token in self.merges.tokens(self.buffer):
            if at + len(self.merges.bytes_of[token]) > stable:
                break
            at += len(self.merges.bytes_of[token])
            yield token
        self.buffer = self.buffer[at:]


class Remembered(dict):
    """Ids of short pieces, as little-endian unsigned 32-bit integers."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        if len(piece) <= SHORT:
            ids = np.array(self.merges.tokens(piece.encode()), "<u4").tobytes()
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
            return ids
        long, out = LongPiece(self.merges), bytearray()
        for start in range(0, len(piece), LONG_BUFFER):
            part = piece[start : start + LONG_BUFFER].encode()
            out += np.fromiter(long.feed(part, start + LONG_BUFFER >= len(piece)), "<u4").tobytes()
        return bytes(out)


class Encoder:
    """Text in, ids out (bytes of little-endian unsigned 32-bit integers), in bounded memory."""

    def __init__(self, merges: Merges, chunk: int = CHUNK):
        self.merges, self.chunk = merges, chunk
        self.known = Remembered(merges)
        self.keep = max(map(len, merges.special), default=1) - 1
        names = sorted(map(regex.escape, merges.special), key=len, reverse=True)
        self.special = regex.compile("|".join(names)) if names else None

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the text, part by part."""
        if len(text) <= self.chunk:
            yield from self._whole(text)
            return
        yield from self.encode_parts(text[i : i + self.chunk] for i in range(0, len(text), self.chunk))

    def encode_parts(self, parts: Iterable[str]) -> Iterator[bytes]:
        """Ids of a text that arrives in parts of any size."""
        segment, held = Segment(self), ""
        for part in parts:
            held += part
            while self.special and (found := self.special.search(held)):
                yield from segment.feed(held[: found.start()], final=True)
                yield np.array([self.merges.special[found[0]]], "<u4").tobytes()
                segment, held = Segment(self), held[found.end() :]
            if len(held) > self.keep:
                ready = len(held) - self.keep
                yield from segment.feed(held[:ready])
                held = held[ready:]
        yield from segment.feed(held, final=True)

    def _whole(self, text: str) -> Iterator[bytes]:
        """A text of one chunk needs nothing held back."""
        at = 0
        if self.special:
            for found in self.special.finditer(text):
                yield b"".join(map(self.known.__getitem__, split(text[at : found.start()])))
                yield np.array([self.merges.special[found[0]]], "<u4").tobytes()
                at = found.end()
        yield b"".join(map(self.known.__getitem__, split(text[at:] if at else text)))


class Segment:
    """Text between two special tokens: cuts it into pieces as it arrives."""

    def __init__(self, encoder: Encoder):
        self.known, self.merges, self.chunk = encoder.known, encoder.merges, encoder.chunk
        self.held = ""
        self.long: LongPiece | None = None  # a piece longer than a chunk, being passed on
        self.kind = OTHER

    def feed(self, part: str, final: bool = False) -> Iterator[bytes]:
        self.held += part
        if self.long:
            yield self._go_on(0, final)
            if self.long:
                return
        pieces = split(self.held)
        # Later characters can change the last piece, and "'" before a letter into "'re".
        back = [] if final else pieces[-2:]
        yield b"".join(map(self.known.__getitem__, pieces[: len(pieces) - len(back)]))
        self.held = "".join(back)
        if back and len(back[-1]) > self.chunk:
            yield b"".join(map(self.known.__getitem__, back[:-1]))
            self.held, self.long = back[-1], LongPiece(self.merges)
            self.kind = classes()[ord(self.held[-1])]
            # A blank before the run belongs to the piece.
            yield self._go_on(int(self.kind != SPACE), False)

    def _go_on(self, start: int, final: bool) -> bytes:
        """Pass on as much as certainly belongs to the long piece."""
        kinds = classes()[np.frombuffer(self.held[start:].encode("utf-32-le"), "<u4")]
        others = np.flatnonzero(kinds != self.kind)
        end = start + int(others[0]) if len(others) else len(self.held)
        ended = final or end < len(self.held)
        if self.kind == SPACE and not (final and end == len(self.held)):
            end = max(0, end - 1)  # the last space may belong to what follows
        ids: list[int] = []
        for at in range(0, end, LONG_BUFFER):
            ids += self.long.feed(self.held[at : min(end, at + LONG_BUFFER)].encode())
        if ended:
            ids += self.long.feed(b"", final=True)
            self.long = None
        self.held = self.held[end:]
        return np.array(ids, "<u4").tobytes()


class Decoder:
    """Ids in, text out: bytes that do not make a character become U+FFFD."""

    def __init__(self, merges: Merges):
        self.spelled = merges.spelled

    def decode(self, parts: Iterable[bytes]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for ids in parts:
            yield state.decode(b"".join(self.spelled[np.frombuffer(ids, "<u4")]))
        yield state.decode(b"", final=True)


@lru_cache(maxsize=2)
def tools(path: str) -> tuple[Encoder, Decoder]:
    """One encoder per worker process, with its cache."""
    merges = Merges(path)
    return Encoder(merges), Decoder(merges)


def digests(encoder: Encoder, decoder: Decoder, text: str) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids, SHA-256 of the text they decode to, all in one pass."""
    ids, decoded, count = hashlib.sha256(), hashlib.sha256(), 0

    def passing() -> Iterator[bytes]:
        nonlocal count
        for part in encoder.encode(text):
            count += len(part) // 4
            ids.update(part)
            yield part

    for part in decoder.decode(passing()):
        decoded.update(part.encode())
    return count, ids.hexdigest(), decoded.hexdigest()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `ids` (array of long) of every whole text, special tokens' strings included.

    A null text counts as empty and has no ids; rows are taken one by one, so repeated rows and null
    ids of documents come out as they came in.  Other columns are not looked at.
    """

    def run(batches):
        encoder, _ = tools(path)
        for batch in batches:
            ids = [
                np.frombuffer(b"".join(encoder.encode(t or "")), "<u4").astype("int64")
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    source = docs.select("doc_id", F.col("text").cast("string"))
    return source.mapInArrow(run, _with_id(docs, "ids array<bigint>"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `text` from `ids`; null ids decode to an empty text."""

    def run(batches):
        _, decoder = tools(path)
        for batch in batches:
            texts = [
                "".join(decoder.decode([np.array(ids or [], "<u4").tobytes()])) for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, _with_id(encoded, "text string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `n_tokens`, `ids_sha256`, `decoded_sha256`: every whole text encoded and decoded again.

    Cases as in `encode`.  No shuffle; a task holds one batch of rows.
    """

    def run(batches):
        encoder, decoder = tools(path)
        for batch in batches:
            rows = [digests(encoder, decoder, text or "") for text in batch.column("text").to_pylist()]
            counts, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select("doc_id", F.col("text").cast("string"))
    return source.mapInArrow(run, _with_id(docs, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))


def _with_id(rows: DataFrame, columns: str) -> str:
    return f"doc_id {dict(rows.dtypes)['doc_id']}, {columns}"
