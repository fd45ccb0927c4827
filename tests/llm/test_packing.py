import zlib

import numpy as np
import pytest

from riftsplit.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
TEXTS = [
    (1, None),
    (2, ""),
    (3, "Hello, WORLD! it's 42 degrees now"),
    (4, "  spaces\tand\n\nlines  "),
    (5, "a" * 9000),
    (6, "many words of every kind, 'tis! " * 3000),
    (7, "<|endoftext|> inside é é ΟΔΟΣ İ"),
    (8, 'it\'s, "quoted", 1.5. x... é, e\u0301, a|b| c%%% <|ENDOFTEXT|>  end!'),
    (3, "Hello, WORLD! it's 42 degrees now"),
    (None, "no id"),
]


def test_pieces_restore_the_ids(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs(TEXTS), PATH, length=256, group_size=8).collect()
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in TEXTS}
    copies = {i: sum(1 for j, _ in TEXTS if j == i) for i, _ in TEXTS}
    sequences, covered = {}, {}
    for r in rows:
        ids = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert zlib.crc32(ids) == r["ids_crc32"] and len(want[r["doc_id"]]) == r["doc_tokens"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    assert covered == {i: len(want[i]) * copies[i] for i in want}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256


def test_empty_table(docs):
    assert packing.pack_documents(docs([]), PATH).count() == 0


def test_first_fit_decreasing_equals_the_plain_loop():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 300):
        sizes = rng.integers(1, 101, n)
        got, offset = packing.first_fit_decreasing(sizes, 100)
        rooms, want, at = [], {}, {}
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, room in enumerate(rooms) if room >= sizes[i]), len(rooms))
            if k == len(rooms):
                rooms.append(100)
            want[i], at[i] = k, 100 - rooms[k]
            rooms[k] -= sizes[i]
        assert got.tolist() == [want[i] for i in range(n)] and offset.tolist() == [at[i] for i in range(n)]


def test_word_memory_can_be_cleared(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHED_WORDS", 2)
    tokens = packing.WordTokens(PATH)
    texts = pa.array(["one two three", None, "", "three four one one"])
    first = tokens.encode(texts)
    again = tokens.encode(texts)
    assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()
    assert first[0].tolist() == [i for t in texts.to_pylist() for i in tokens.tokenizer.encode(t or "", add_special_tokens=False).ids]
