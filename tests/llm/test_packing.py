"""Pieces against the tokenizer, sequences against their rules."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given as for_all
from hypothesis import settings
from hypothesis import strategies as st

from clickmart.llm import packing, queries
from tests.llm import brute
from tests.llm.conftest import ODD, expected, rows_of

PATH = queries._tokenizer("word_bpe_49k.json")
WORDS = ["it's", "don't!", "naïve,", "ÉÀ", "İstanbul", "ſtraße", "é", "a1b2", "...", "x\x00y", "\x1c", "\x85", "Ǆ", "ﬁ", "你好", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σς", "K", "don’t", "_a_", "'s", "a's."]


@settings(max_examples=150, deadline=None)
@for_all(st.lists(st.sampled_from(WORDS) | st.text(max_size=12), max_size=12), st.sampled_from([" ", "\n", "\t ", " ", ""]))
def test_ids_are_the_tokenizers(words, gap):
    text = gap.join(words).encode("utf-8", "ignore").decode()
    encoder = packing.encoder(PATH)
    wanted = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == wanted


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    encoder = packing.Encoder(PATH)
    text = "one two, three. four! five five two, a1 été ÉTÉ; one?! x.,; " * 3
    wanted = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(3):
        assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == wanted


def test_pieces(as_documents):
    assert rows_of(packing.pieces(as_documents(ODD), PATH, 512), "*") == expected(brute.token_pieces(ODD, PATH, 512))


def check_sequences(rows, length):
    """Whole pieces alone, no sequence too long, no gap; returns sequences and the least number possible."""
    sequences = defaultdict(list)
    for row in rows:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for members in sequences.values():
        ends = np.cumsum([n for _, n in sorted(members)])
        assert [o for o, _ in sorted(members)] == [0, *ends[:-1]] and ends[-1] <= length
    return len(sequences), -(-sum(r["length"] for r in rows) // length)


@pytest.mark.parametrize(("length", "group"), [(512, 4096), (512, 40), (64, 30), (1, 10)])
def test_sequences(as_documents, given, length, group):
    rows = [*ODD, *given[:60]] if length > 1 else [r for r in ODD if r[1] is None or len(r[1]) < 300]
    docs = as_documents(rows)
    packed = packing.pack(packing.pieces(docs, PATH, length), length, group_size=group)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows_of(packed.drop("sequence_id", "offset"), "*") == expected(brute.token_pieces(rows, PATH, length))
    used, least = check_sequences(packed.collect(), length)
    assert used <= least * 1.02 + 1


def test_nothing_to_pack(as_documents):
    assert packing.pack(packing.pieces(as_documents([(1, "x")]).where("doc_id = 2"), PATH)).count() == 0


def hard_sizes(seed, n=200):
    """Pieces of a third of a sequence and a bit more or less: best fit by length wastes some."""
    return np.random.default_rng(seed).integers(20, 60, n).astype(np.int64)


@pytest.mark.parametrize("seed", range(4))
def test_children_are_whole_packings(seed):
    sizes, random = hard_sizes(seed), np.random.default_rng(seed)
    a, b = (packing.Packing(sizes, 100).best_fit(random.permutation(len(sizes))).compact() for _ in range(2))
    child = packing.offspring(a, b, random)
    assert (child.bin_of >= 0).all() and child.fills().max() <= 100 and child.fills().min() > 0
    assert child.fills().sum() == sizes.sum()


def test_evolution_beats_its_first_generation():
    gained = 0
    for seed in range(6):
        sizes = hard_sizes(seed)
        first = packing.first_population(sizes, 100, 6, np.random.default_rng(seed))
        start = first[0].score()
        last = packing.evolve(first, 30, np.random.default_rng(seed))[0].score()
        assert last >= start
        gained += last > start
    assert gained >= 3
