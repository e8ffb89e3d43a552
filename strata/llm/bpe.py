"""Ids of whole texts with the tokenizers library, each distinct word encoded once.

Both public vocabularies split a text before merging, and never merge across a
blank that stands before a non-blank. So a text is cut at such blanks, a bounded
memo holds the ids of words met before, and the words not met yet are encoded
together by the library. The ids equal those of the undivided text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMO_WORDS = 750_000  # beyond so many words the memo keeps only those met more than once
_BEFORE_BLANK = re.compile("[ ](?=[\\s᠎]|$)")
_CUT = re.compile("[ ](?=[^\\s᠎])")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # blanks for Python, signs for the tokenizer
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?*#$%&|()]*)")  # letters, then perhaps signs: one run or two
_PIECE = re.compile("[^\t-\r \x85\xa0  -     　]+")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; it is looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts; ``spaces`` tells whether the blank before a word belongs to it."""

    def __init__(self, path: str, spaces: bool):
        from tokenizers import Tokenizer

        from tokenizers import pre_tokenizers as pre

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are plain text
        self.spaces = spaces
        self.size = self.tokenizer.get_vocab_size()
        # plain lower-case words need no normalising, and no more splitting than at blanks
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre.Sequence(
            [pre.Split(" ", "merged_with_next" if spaces else "removed"), pre.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.words.model._resize_cache(0)
        vocabulary = self.tokenizer.get_vocab().items()
        # a token with a leading blank opens a word; one with the end mark closes it
        self.edge = np.zeros(self.size, bool)
        self.edge[[i for w, i in vocabulary if (w.startswith("Ġ") if spaces else w.endswith("</w>"))]] = True
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.counts = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _forget(self) -> None:
        """Keep only words met again since they were learned, and none if those are too many."""
        old, starts, counts, uses, ids = self.memo, self.starts, self.counts, self.uses, self.ids
        self._clear()
        again = [(word, i) for word, i in old.items() if uses[i] > 1]
        if 2 * len(again) > MEMO_WORDS:
            return
        at = np.array([i for _, i in again], np.int64)
        ends = np.cumsum(counts[at])
        kept = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[at] - (ends - counts[at]), counts[at])
        self._remember([word for word, _ in again], ids[kept], ends - counts[at], counts[at])

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _parts(self, text: str) -> list[str]:
        """The words of a text; with ``spaces`` every one but the first follows a blank."""
        if not self.spaces:
            return _PIECE.findall(text) if _SEPARATORS.search(text) else text.split()
        first, *rest = _CUT.split(text) if _BEFORE_BLANK.search(text) else text.split(" ")
        # the first has no blank before it; no other starts with one, which keeps it apart in the memo
        return [" " + first, *rest]

    def _remember(self, words: list[str], ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.memo), len(self.memo) + len(words)
        if m > len(self.starts):
            size = 2 * max(m, len(self.starts))
            for name in ("starts", "counts", "uses"):
                setattr(self, name, np.concatenate([old := getattr(self, name), np.zeros(size - len(old), old.dtype)]))
        if self.used + len(ids) > len(self.ids):
            size = 2 * max(self.used + len(ids), len(self.ids))
            self.ids = np.concatenate([self.ids, np.zeros(size - len(self.ids), np.uint32)])
        self.memo.update(zip(words, range(n, m), strict=True))
        self.starts[n:m], self.counts[n:m] = self.used + starts, counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, new: list[str]) -> None:
        """Words of letters in groups, words with signs behind from their parts, others one by one."""
        stems, both, odd = {}, [], []
        for word in new:
            if simple := _SIMPLE.fullmatch(word):
                if simple[2]:
                    both.append((word, simple[1], simple[2] if not self.spaces else " " + simple[2]))
                if simple[1] not in self.memo:
                    stems[simple[1]] = None
            else:
                odd.append(word)
        plain = list(stems)
        for i in range(0, len(plain), 4096):
            group = plain[i : i + 4096]
            text = " " + " ".join(group) if self.spaces else " ".join(group).lower()
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            if self.spaces:
                starts = np.flatnonzero(self.edge[ids])
                ends = np.append(starts[1:], len(ids))
            else:
                ends = np.flatnonzero(self.edge[ids]) + 1
                starts = np.append(0, ends[:-1])
            if len(starts) == len(group):
                self._remember(group, ids, starts, ends - starts)
            else:
                odd += group
        odd += [sign for sign in dict.fromkeys(sign for _, _, sign in both) if sign not in self.memo]
        for word in dict.fromkeys(odd):
            text = word if not self.spaces else word[1:] if word.startswith(" ") else " " + word
            ids = np.array(self._plain(text), np.uint32)
            self._remember([word], ids, np.zeros(1, np.int64), np.array([len(ids)]))
        if both:
            parts = np.array([self.memo[x] for _, stem, sign in both for x in (stem, sign)], np.int64)
            ids, ends = self._joined(parts)
            ends = ends[1::2]
            starts = np.append(0, ends[:-1])
            self._remember([word for word, _, _ in both], ids, starts, ends - starts)

    def _joined(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these memo entries one after another, and the end of each."""
        counts = self.counts[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[index] - (ends - counts), counts)], ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's bounds (n + 1)."""
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        parts = [self._parts(text) for text in texts]
        flat = list(chain.from_iterable(parts))
        index = np.fromiter(map(self.memo.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(index < 0)
        if len(unknown):
            missed = [flat[i] for i in unknown]
            self._learn(list(dict.fromkeys(missed)))
            index[unknown] = list(map(self.memo.__getitem__, missed))
        self.uses[: len(self.memo)] += np.bincount(index, minlength=len(self.memo)).astype(np.int32)
        ids, ends = self._joined(index)
        words = np.concatenate([[0], np.cumsum([len(own) for own in parts], dtype=np.int64)]).astype(np.int64)
        return ids, np.concatenate([[0], ends]).astype(np.int64)[words]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One encoder for each worker process; its memo lives as long as the worker."""
    key = (path, spaces)
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaces)
    return _encoders[key]


def encoded(
    texts: list[str | None], coder: Encoder, end: int, limit: int = 1 << 20
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds) for runs of about ``limit`` characters; every row ends with ``end``."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= limit):
            size += len(texts[last] or "")
            last += 1
        ids, bounds = coder.encode([t or "" for t in texts[first:last]])
        yield first, np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))
        first = last
