import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventmill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text or "", add_special_tokens=False).ids)


CASES = ["", None, "a", "Hello, World!! it's 5% off...", "x" * 3000, "É éá naïve ", "a\xa0b c", "don't <|endoftext|> stop",
         "<|ENDOFTEXT|>", "日本語 テキスト", "tab\tand\x0bvt\x1fus", "ſtraße İstanbul ΟΔΟΣ.", "... !!! ,,,", "abc1.", "10.5, 7"]


@pytest.mark.parametrize("text", CASES)
def test_ids_are_those_of_whole_texts(tokenizer, text):
    assert packing.Encoder(PATH).encode(text) == ids_of(tokenizer, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60))
def test_ids_of_any_text(tokenizer, text):
    assert packing.encoder(PATH).encode(text) == ids_of(tokenizer, text)


def test_a_small_memory_changes_nothing(tokenizer):
    text = " ".join(f"word{i}a, w{i % 7}" for i in range(400))
    small = packing.Encoder(PATH, limit=50)
    assert small.encode(text) == ids_of(tokenizer, text)


def test_pieces_cover_every_document_once(spark, tokenizer, prose):
    rows = [(i, prose(i, 1 + (i * i * 37) % 1500)) for i in range(60)]
    rows += [(None, "null id"), (5, "again"), (100, None), (101, ""), (102, prose(9, 9000))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, ids int").repartition(3)
    found = packing.pack(docs, PATH, window_tokens=20_000, step_tokens=8192).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text) + b"\x02\0\0\0"
        pieces = sorted(by_doc[doc_id, len(ids) // 4], key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert zlib.crc32(b"".join(bytes(p.ids) for p in pieces)) == zlib.crc32(ids)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    short = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        total = sum(p.length for p in pieces)
        assert total <= 4096
        short += total & (total - 1) != 0
    assert short <= 3  # one per split at most


@pytest.mark.parametrize("splits", [1, 7])
@pytest.mark.parametrize("step", [1000, 8192, 12_000])
def test_steps_of_a_tier_are_balanced(spark, prose, splits, step):
    """Over all splits, every group of a tier but one is full; one tier, one shape."""
    rows = [(i, prose(i, 900 if i % 4 else 60)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(splits)
    found = packing.pack(docs, PATH, step_tokens=step).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.step_group, set()).add((r.tier, r.sequence_id))
    by_tier = {}
    for members in groups.values():
        (tier,) = {t for t, _ in members}
        by_tier.setdefault(tier, []).append(len(members))
    assert sum(map(sum, by_tier.values())) == len({r.sequence_id for r in found})
    for tier, counts in by_tier.items():
        full = max(1, step // tier)
        assert max(counts) <= full
        assert sum(n < full for n in counts) <= 1


def test_gaps_are_filled_from_shorter_tiers():
    full, left = packing.pack_window([(200, 0, 0), (150, 1, 0), (56, 2, 0), (100, 3, 0)])
    assert all(sum(p[0] for p in pieces) == tier for tier, pieces in full)
    assert sum(p[0] for _, pieces in full for p in pieces) + sum(p[0] for p in left) == 506


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).collect() == []
