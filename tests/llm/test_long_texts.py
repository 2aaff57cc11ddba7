"""Texts of a megabyte that used to take more than linear time, and patterns whose matches cross blanks."""

import time

import numpy as np
import public_tokenizers as P
import pytest
import regex

from motifspark.llm import rank_bpe, secret_scan
from motifspark.llm.common import cuts_at_blanks
from tests.llm.test_corpus import RANKS, SCANNER, secrets


def seconds(f, *args):
    began = time.process_time()
    return f(*args), time.process_time() - began


def test_a_megabyte_of_overlapping_secrets():
    text = "token=xtoken = " + "a-" * 500_000
    found, took = seconds(SCANNER, text)
    assert found == secrets(text) and took < 10


def test_a_megabyte_of_hex():
    found, took = seconds(SCANNER, "0123456789abcdef" * 65_536)
    assert found == [(0, 1 << 20, 2)] and took < 10


@pytest.mark.parametrize("text", ["token=xtoken = a-a-a- token = bcdefgh", "token=token=token = abcdef", "secret:passwd = aaaaaaa passwd=b", "token=xtoken = a- api_key=yapikey : bbbbbbb"])
def test_matches_behind_an_overlap(text):
    assert secret_scan.Scanner()(text * 3) == secrets(text * 3)


@pytest.mark.parametrize("letters", ["a", "ab", "aab"])
def test_a_megabyte_without_a_blank(letters):
    coder = rank_bpe.bpe(RANKS, P.PATTERN)
    text = letters * (1_000_000 // len(letters))
    ids, took = seconds(coder.encode, text)
    assert took < 30 and coder.decode(ids) == text.encode()


def test_long_runs_are_encoded_like_the_library():
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rank_bpe.read_ranks(RANKS), special_tokens={})
    coder = rank_bpe.bpe(RANKS, P.PATTERN)
    for text in ("a" * 5001, "ab" * 3000, "aab" * 2000 + "ba" * 999, "é" * 3000):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_patterns_that_cross_blanks_are_not_cut_there():
    import tiktoken

    crossing = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    assert cuts_at_blanks(regex.compile(P.PATTERN).findall) and not cuts_at_blanks(regex.compile(crossing).findall)
    ranks = rank_bpe.read_ranks(RANKS)
    coder, library = rank_bpe.RankBpe(ranks, crossing), tiktoken.Encoding("own", pat_str=crossing, mergeable_ranks=ranks, special_tokens={})
    for text in ("a.\nb", "x !\ny. z", "one two\n\nthree, 12345 four"):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)
