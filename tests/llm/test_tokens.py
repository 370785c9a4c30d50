import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arbora.llm import packing, token_store
from arbora.llm.tokens import Words, encoder, word_bpe


def expected(text):
    return Tokenizer.from_file(word_bpe()).encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZéİΣß'ts. ,!$_9²漢́̇\x1c \n<|>", max_size=30), max_size=4))
def test_cached_words_encode_as_whole_texts(texts):
    enc = encoder(word_bpe())
    assert enc.texts(texts) == [enc.whole(t).tobytes() for t in texts]


def test_special_tokens_and_eviction():
    enc = type(encoder(word_bpe()))(word_bpe(), most=3)
    texts = ["a<|endoftext|>b Word. word's WORD--x", "one two three four five", "Word. one"]
    for _ in range(3):
        assert enc.texts(texts) == [enc.whole(t).tobytes() for t in texts]


def test_store_round_trip(spark, docs, odd, tmp_path):
    path = str(tmp_path / "t.orc")
    n = token_store.write_tokens(docs(odd), path, word_bpe(), shards=3, stripe_mb=1)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_store.digest(spark, path, n).collect()))
    rows = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, t, _ in rows:
        ids = np.array(expected(t), "<u4")
        want.append((i is not None, i or 0, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert [list(r.token_ids) for r in token_store.read_tokens(spark, path, [7]).collect()] == [expected(odd[7][1])]
    assert "PushedFilters: [In(doc_id" in token_store.read_tokens(spark, path, [7, 4])._jdf.queryExecution().toString()


def check_pieces(pieces, rows, window):
    """Each id in one piece, sequences gapless, all but the last full."""
    left = sorted(((i is not None, i or 0), zlib.crc32(np.array(expected(t), "<u4").tobytes()), len(expected(t))) for i, t, _ in rows)
    assert sum(p.length for p in pieces) == sum(n for *_, n in left)
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in order:
        assert p.sequence_id * window + p.offset == at and p.offset + p.length <= window
        at += p.length
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(np.array(expected(t), "<u4"))
    for i, ps in by.items():
        for ids in texts[i]:
            mine = [p for p in ps if p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)]
            assert sorted((p.start, p.length) for p in mine)[0][0] == 0 and sum(p.length for p in mine) >= len(ids)


def test_pack_cuts_each_id_once(docs, odd):
    rows = odd + [(100 + i, "alpha beta gamma " * (i % 40), f"s{i % 5}") for i in range(150)]
    check_pieces(packing.pack(docs(rows), word_bpe(), window=256).collect(), rows, 256)


def test_windows_meet_shares(docs):
    rows = [(i, "word " * 50, "big" if i % 3 else "small") for i in range(300)]
    ps = packing.pack(docs(rows), word_bpe(), window=128).collect()
    last = max(p.sequence_id for p in ps)
    for w in range(last):
        assert abs(sum(p.length for p in ps if p.sequence_id == w and p.source == "big") - 128 * 2 / 3) <= 3


def test_targets_hold_until_a_queue_is_empty(docs):
    rows = [(i, "word " * 50, "a" if i % 2 else "b") for i in range(200)]
    ps = packing.pack(docs(rows), word_bpe(), window=128, targets={"a": 3.0, "b": 1.0}).collect()
    check_pieces(ps, rows, 128)
    for w in range(40):
        assert abs(sum(p.length for p in ps if p.sequence_id == w and p.source == "a") - 96) <= 3
    with pytest.raises(ValueError):
        packing.Plan([1], [0.0])


def test_deficits_match_a_round_by_round_scheduler():
    plan = packing.Plan([1000, 333, 7], None, window=64)
    served, deficit = [0, 0, 0], [0, 0, 0]
    for r in range(plan.b + 1):
        for s in range(3):
            assert plan.served(s, np.array([r]))[0] == served[s]
            deficit[s] += plan.a[s]
            take = min(deficit[s] // plan.b, [1000, 333, 7][s] - served[s])
            served[s], deficit[s] = served[s] + take, deficit[s] - take * plan.b


def test_empty(docs, spark, tmp_path):
    assert packing.pack(docs([]), word_bpe()).count() == 0
    path = str(tmp_path / "e.orc")
    assert token_store.digest(spark, path, token_store.write_tokens(docs([]), path, word_bpe())).count() == 0


def test_targets_hold_among_more_sources_than_queues(docs, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 4)
    rows = [(100 * s + i, "one two three four " * 10, None if s == 9 else f"s{s}") for s in range(10) for i in range(12)]
    ps = packing.pack(docs(rows), word_bpe(), window=200, targets={"s0": 6.0, "s1": 3.0, None: 3.0}).collect()
    check_pieces(ps, rows, 200)
    for seq in range(2):  # weights 6 + 3 + 3 + 7 sources of 1
        n = {s: sum(p.length for p in ps if p.sequence_id == seq and p.source == s) for s in ("s0", "s1", None)}
        assert abs(n["s0"] - 200 * 6 / 19) <= 3 and abs(n["s1"] - 200 * 3 / 19) <= 3 and abs(n[None] - 200 * 3 / 19) <= 3
    with pytest.raises(ValueError, match="targets"):
        packing.pack(docs(rows), word_bpe(), targets={f"s{s}": 1.0 for s in range(5)})


@pytest.mark.parametrize("most", [1, 40, 100_000])
def test_cache_of_any_size_holds_few_words_and_changes_nothing(most):
    enc = type(encoder(word_bpe()))(word_bpe(), most)
    r = random.Random(most)
    for _ in range(30):
        words = [r.choice(["the", "of.", "x" * 300, "a,b", "3.14", "««", "..", "é,"]) if r.random() < 0.3 else f"w{r.randrange(400)}q" for _ in range(200)]
        texts = [" ".join(words), None, "".join(words[:3]), " ".join(words[:50]).upper()]
        assert enc.texts(texts) == [enc.whole(t or "").tobytes() for t in texts]
        assert enc.now.count <= max(most, 2 * 260)


def test_words_of_one_hash_are_told_apart():
    words = Words(4)
    h, head = np.array([9, 9, 9 + (words.mask + 1)], np.uint64), np.array([1, 2, 3], np.uint64)
    words.put(h, head, np.array([1, 2, 1]), np.array([5, 6, 7, 8], np.uint32))
    slot = words.find(h, head)
    assert words.size[slot].tolist() == [1, 2, 1] and words.ids[words.first[slot]].tolist() == [5, 6, 8]
    assert words.find(np.array([9], np.uint64), np.array([4], np.uint64)).tolist() == [-1]
