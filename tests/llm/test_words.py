"""Word splitting and hashing against plain Python, on hypothesis texts."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import words

TEXT = st.text(alphabet=st.sampled_from("aB é\t\n\x0b\x1cß中  "), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_split_words(texts):
    w = words.split_words(*words.text_bytes(pa.array(texts, pa.string())))
    got = [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert got == [x for row in want for x in row]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    h = words.word_hashes(w)
    assert len(set(h.tolist())) == len(set(got))
    low = words.word_hashes(w, lower=True)
    assert len(set(low.tolist())) == len({re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in got})


def test_hashes_do_not_depend_on_place():
    a = words.word_hashes(words.split_words(*words.text_bytes(pa.array(["x yy zzz"]))))
    b = words.word_hashes(words.split_words(*words.text_bytes(pa.array(["", "zzz", None, "q x", "yy"]))))
    assert b.tolist()[0] == a[2] and b[2] == a[0] and b[3] == a[1]


def test_chunks_cover_all_rows():
    texts = pa.array(["a" * 10, None, "b" * 100, "", "c"] * 3)
    runs = list(words.chunks(texts, 50))
    assert runs[0][0] == 0 and runs[-1][1] == len(texts) and all(x[1] == y[0] for x, y in zip(runs, runs[1:]))
