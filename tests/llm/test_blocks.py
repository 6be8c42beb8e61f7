import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import blocks

TEXT = st.text(alphabet=st.sampled_from(list("abzAZ09 \n\t\x0b\x00.,é日\u00a0")), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(1, 40))
def test_words_are_those_of_the_patterns(texts, size):
    for delimiters, pattern in ((blocks.BLANKS, r"[^\x20\x09-\x0D]+"), (blocks.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        table = blocks.split_table(delimiters, lower=True)
        found = []
        for block in blocks.blocks(pa.array(texts, pa.string()), table, size):
            assert block.first == len(found)
            found += [[block.word(w).decode() for w in range(a, b)] for a, b in zip(block.word_at[:-1], block.word_at[1:])]
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        assert found == [re.findall(pattern, t.translate(low)) for t in texts]


def test_fingerprints_follow_the_words_alone():
    table = blocks.split_table(blocks.BLANKS, lower=False)
    block = next(blocks.blocks(pa.array(["one two one", "two", "neo one"]), table))
    by: dict[bytes, set[int]] = {}
    for i, h in enumerate(block.hashes().tolist()):
        by.setdefault(block.word(i), set()).add(h)
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == 3
    assert list(blocks.blocks(pa.array([], pa.string()), table)) == []
    assert len(np.unique(blocks.mix(np.arange(1000, dtype=np.uint64)))) == 1000
