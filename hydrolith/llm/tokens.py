"""Token ids of a public word tokenizer, with a store of words seen before."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa

from hydrolith.llm.batches import coded_words, give_back

#: Vocabulary file, named in the tokenizers' package; a parameter everywhere.
VOCABULARY = "word_bpe_49k.json"
#: Closes each document.
END = 1
#: Words whose only pieces are a run of Latin-1 letters and then a run of ASCII
#: marks: normalising them is lower-casing, and they split between the runs.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-^`{-~]*)")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a byte that prints in Latin-1 is itself, the
    others are the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}


class WordIds:
    """Ids of texts. This tokenizer never joins ids across white space, so a
    text's ids are its words' ids in order; each word is encoded once. The
    store is emptied when it holds ``most`` words, which bounds its memory."""

    def __init__(self, vocabulary: str = VOCABULARY, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.model, self.letters, self.most = self.tokenizer.model, byte_letters(), most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.marks: dict[str, list[int]] = {"": []}
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _run(self, run: str) -> list[int]:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(run)]

    def _learn(self, new: list[str]) -> None:
        ids: list[list[int] | None] = []
        other = []
        for w in new:
            if m := PLAIN.fullmatch(w):
                run, mark = m.groups()
                if mark not in self.marks:
                    self.marks[mark] = self._run(mark)
                ids.append(self._run(run.lower()) + self.marks[mark])
            else:
                other.append((len(ids), w))
                ids.append(None)
        encoded = self.tokenizer.encode_batch([w for _, w in other], add_special_tokens=False)
        for (i, _), e in zip(other, encoded, strict=True):
            ids[i] = e.ids
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = len(self.flat) + np.cumsum(n) - n
        self.flat = np.r_[self.flat, np.fromiter((x for e in ids for x in e), np.uint32, int(n.sum()))]
        self.place.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
        self.starts, self.lengths = np.r_[self.starts, begin], np.r_[self.lengths, n]

    def __call__(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text and ``END``; a null text has only ``END``."""
        own, index, ends = coded_words(texts)
        new = [w for w in own if w not in self.place]
        if len(self.place) + len(new) > self.most:
            self._clear()
            new = [w for w in own if w]
        if new:
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))[index]
        n = self.lengths[place]
        after = np.cumsum(n)
        total = int(after[-1]) if len(after) else 0
        ids = self.flat[np.repeat(self.starts[place] - after + n, n) + np.arange(total)]
        at = np.r_[0, after][ends]
        give_back()
        return [np.r_[ids[a:b], np.uint32(END)] for a, b in zip(at[:-1], at[1:], strict=True)]


@cache
def word_ids(vocabulary: str = VOCABULARY) -> WordIds:
    """One store for each Python worker, which goes on from task to task."""
    return WordIds(vocabulary)
