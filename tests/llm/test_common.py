"""Word hashes in blocks against plain arithmetic; what a worker keeps between tasks."""

import numpy as np

from hemicycle.llm import common


def plain_hash(word: bytes) -> int:
    h = sum(int(common._LOWER[c]) * pow(int(common._BASE), i, 1 << 64) for i, c in enumerate(word)) + len(word)
    return int(common.mix(np.array([h % (1 << 64)], np.uint64))[0])


def test_word_hashes_do_not_hang_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    for block in (8, 50, common.HASH_BYTES):
        monkeypatch.setattr(common, "HASH_BYTES", block)
        monkeypatch.setattr(common, "_powers", [])
        texts = [b" ".join(rng.integers(33, 127, size=n).astype(np.uint8).tobytes() for n in rng.integers(1, 60, size=40))
                 for _ in range(5)] + [b"", b"  ", b"x"]
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.cumsum([0, *map(len, texts)])
        start, end, first = common.words(data, off)
        want = [plain_hash(w) for t in texts for w in t.split()]
        assert common.word_hashes(data, start, end).tolist() == want
        assert np.diff(first).tolist() == [len(t.split()) for t in texts]
        assert max(len(p) for p in common._powers) == block + 1


def test_word_hashes_of_a_very_long_text():
    word = b"ab" * 200_000
    data = np.frombuffer(b"one " + word + b" two", np.uint8)
    start, end, _ = common.words(data, np.array([0, len(data)]))
    assert common.word_hashes(data, start, end).tolist()[::2] == [plain_hash(b"one"), plain_hash(b"two")]
    again = np.frombuffer(word.upper(), np.uint8)
    assert common.word_hashes(again, np.array([0]), np.array([len(again)]))[0] == common.word_hashes(data, start, end)[1]
    assert len(common._powers[0]) == common.HASH_BYTES + 1
    none = np.zeros(0, np.int64)
    assert len(common.word_hashes(data, none, none)) == 0


def test_kept_values_go_when_idle(monkeypatch):
    made = []
    make = lambda: made.append(1) or len(made)
    assert [common.kept("t", "a", make), common.kept("t", "a", make), common.kept("t", "b", make)] == [1, 1, 2]
    common.release()
    assert common.kept("t", "b", make) == 2
    monkeypatch.setattr(common, "IDLE_SECONDS", -1.0)
    common.release()
    assert common.kept("t", "b", make) == 3
