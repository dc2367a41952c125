"""Words of a batch of texts, each different word once."""

from __future__ import annotations

import ctypes
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def coded_words(texts: pa.Array | list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words, the index of each word in order, and where each
    text begins and ends among them. Words are what single spaces and line
    feeds part, so an empty string stands between two of these in a row."""
    texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
    words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    ends = words.offsets.to_numpy() - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), ends


#: White space that parts words for a reader, beside space and line feed.
OTHER_GAPS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def read_words(texts: pa.Array | list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As ``coded_words``, but words are parted by any white space, and none is
    empty."""
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
    if pc.any(pc.match_substring_regex(texts, f"[{OTHER_GAPS}]")).as_py():
        texts = pc.replace_substring_regex(texts, f"[{OTHER_GAPS}]", " ")
    own, index, ends = coded_words(texts)
    if "" in own:
        full = index != own.index("")
        index, ends = index[full], np.r_[0, np.cumsum(full)][ends]
    return own, index, ends


@cache
def _trim():
    """The C library's call that hands free pages back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back(done: bool = False) -> None:
    """Arrow keeps freed memory, and so does the C library, which is asked for it
    once, when a task is done; executors count it."""
    pa.default_memory_pool().release_unused()
    if done and (trim := _trim()):
        trim(0)
