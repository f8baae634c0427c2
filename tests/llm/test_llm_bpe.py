import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skyledger.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "é", "'", "r", "e", "l", "v", " ", "  ", "\n", "\t", "1", "22", "!", "?", "<|endoftext|>", "<|endo", "text|>",
         "中", "　", "𝒜", "the", "ing", "Ġ", "\x85", "\xa0", "'re", "'ll", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(PATH)


def ids_of(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()


def texts(seed, count):
    random.seed(seed)
    return ["".join(random.choice(PARTS) * random.choice([1, 1, 1, 2, 9, 30]) for _ in range(random.randint(0, 30))) for _ in range(count)]


@pytest.mark.parametrize("chunk", [5, 64, bpe.CHUNK])
def test_same_ids_as_the_library(library, merges, chunk):
    encoder = bpe.Encoder(merges, chunk)
    for text in texts(chunk, 400):
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids, text


def test_any_cut_gives_the_same_ids(library, merges):
    encoder = bpe.Encoder(merges, 16)
    for text in texts(9, 150):
        cuts = sorted(random.randint(0, len(text)) for _ in range(5))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        got = np.frombuffer(b"".join(encoder.encode_parts(parts)), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 30_000 + "x", "\n" * 20_000, "=" * 30_000, "7" * 9_000, "intolerguarantee" * 2_000])
def test_long_runs(library, merges, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(bpe.Encoder(merges), text) == want
    assert ids_of(bpe.Encoder(merges, 1000), text) == want


def test_tokens_are_stable_behind_the_lookahead(merges):
    random.seed(4)
    pieces = [merges.bytes_of[random.randrange(50_000)].strip() for _ in range(400)]
    for _ in range(200):
        head = b"".join(random.choices(pieces, k=120))
        cut = len(head) - merges.lookahead
        tokens = [merges.tokens(head + b"".join(random.choices(pieces, k=k))) for k in (0, 1, 3)]
        stable = []
        for ids in tokens:
            ends = np.cumsum([len(merges.bytes_of[t]) for t in ids])
            stable.append(np.array(ids)[ends <= cut].tolist())
        assert stable[0] == stable[1] == stable[2]


def test_memory_is_bounded_by_chunk_and_lookahead(merges):
    encoder = bpe.Encoder(merges, 1000)
    segment = bpe.Segment(encoder)
    held = []
    for _ in range(200):
        for _ in segment.feed("a" * 500):
            pass
        held.append(len(segment.held) + (len(segment.long.buffer) if segment.long else 0))
    assert max(held) < 2 * (1000 + bpe.LONG_BUFFER + merges.lookahead)


def test_decoder_like_the_library(library, merges):
    random.seed(5)
    decoder = bpe.Decoder(merges)
    for _ in range(300):
        ids = [random.randrange(50_257) for _ in range(random.randint(0, 30))]
        parts = [np.array(ids[i : i + 2], "<u4").tobytes() for i in range(0, len(ids), 2)]
        assert "".join(decoder.decode(parts)) == library.decode(ids, skip_special_tokens=False)


def test_round_trip(clashing, library):
    rows = [(1, "The house, isn't it?"), (1, "The house, isn't it?"), (2, None), (3, ""), (None, "<|endoftext|> x"), (4, "word " * 100_000)]
    got = bpe.round_trip(clashing(*rows), PATH).collect()
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_encode_and_decode(documents):
    docs = documents((1, "Ça va?"), (2, None))
    encoded = bpe.encode(docs, PATH)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH).collect()} == {1: "Ça va?", 2: ""}
    assert bpe.round_trip(documents(), PATH).collect() == []


def test_missing_file():
    with pytest.raises(FileNotFoundError):
        bpe.Merges("/nowhere.json")
