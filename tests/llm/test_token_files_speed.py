"""The search for rare characters skips from one possible first byte to the next; ends are part of the ids."""

import re

import numpy as np

from dossier.llm import token_files


def test_every_branch_of_the_rare_pattern_begins_with_one_byte():
    pattern = token_files.Encoder(token_files.default_vocabulary()).rare.pattern
    ((_, (_, branches)),) = re._parser.parse(pattern)
    assert {branch[0][0] for branch in branches} == {re._constants.LITERAL}


def test_rows_of_any_kind_equal_the_library():
    encoder = token_files.Encoder(token_files.default_vocabulary())
    texts = ["", "a b", "", "it's (done)!\n\nNext", "x<|endoftext|>y", "\x1c", "né　漢字 \xa0z", " \n ", "", "word\nword.word", ""]
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(b) for b in raw])]
    for end in (2, 7):  # the memory outlives a change of the end
        values, bounds = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offs, end)
        want = [[*encoder.library.encode(t, add_special_tokens=False).ids, end] for t in texts]
        assert [values[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
