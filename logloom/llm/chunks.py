"""Texts as sequences of chunks that a byte-level BPE encodes one by one.

A chunk starts at a space that stands between two characters that aren't white
space.  There every pattern of the public byte-level vocabularies starts a new
match, and no look-ahead reaches beyond it, so the ids of a text are the ids of
its chunks one after another.  Words repeat, so each task encodes each distinct
chunk once.

The pattern of GPT-2 also starts a new match where a letter stands before a sign, and at a
line feed between two characters that aren't white space.  Chunks of texts read by it are cut
there too (:func:`finer`): words with a point or comma behind them are then no words of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def _keys(parts: list[str]) -> list:
    parts[0] = parts[0].encode("utf-8", "surrogatepass")
    return parts


def split(text: str) -> list:
    """The chunks' keys: the first as bytes, the others as text without their leading space."""
    return _keys(_BETWEEN.split(text))


def _simple(text: str) -> list | None:
    """What ``split`` gives if single spaces alone are white space at chunks' ends; the first chunk is looked at here."""
    parts = text.split(" ")
    if len(parts) > 1 and (not parts[0] or parts[0][-1].isspace()):
        return None
    return _keys(parts)


def _ragged(key) -> bool:
    """A chunk but the first that has white space at an end, so that its space may not stand alone."""
    return isinstance(key, str) and (not key or key[0].isspace() or key[-1].isspace())


def _ragged_of(values: pa.Array) -> np.ndarray:
    """The same for a column; Arrow's white space is that of ``str.isspace``."""
    sizes = pc.binary_length(values).to_numpy()
    return (sizes == 0) | (sizes != pc.binary_length(pc.utf8_trim_whitespace(values)).to_numpy())


def finer(chunks: pa.Array) -> pa.Array:
    """Chunks with a space at each place where the pattern of GPT-2 starts a match for certain.

    They hold no spaces before, and no white space at their ends.  Letters are those of Latin-1,
    which are letters to every library; the apostrophe is no sign here.
    """
    lines = pc.replace_substring_regex(chunks, r"([!-~À-ÖØ-öø-ÿ])\n([!-~À-ÖØ-öø-ÿ])", "\\1 \n\\2")
    return pc.replace_substring_regex(lines, r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])", r"\1 \2")


def text_of(key) -> str:
    return key.decode("utf-8", "surrogatepass") if isinstance(key, bytes) else " " + key


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces ``flat[starts[i]:starts[i] + sizes[i]]`` one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat(starts - ends + sizes, sizes)
    places += np.arange(total)
    return flat[places]


class Vocabulary:
    """Ids of the chunks seen so far.

    ``encode_all`` gives an integer array for each text of a list, or a pair: all ids one
    after another, and the number of ids of each text.  Beyond ``most`` chunks new ones are
    encoded for their texts and not kept, as are those beyond ``IDS`` ids a chunk on average;
    after many of these all are forgotten, so what is kept follows the texts.  Memory is
    bounded and no result changes.  With ``fine`` columns are cut by :func:`finer` too.
    """

    IDS = 16

    def __init__(self, encode_all: Callable[[list[str]], list[np.ndarray] | tuple[np.ndarray, np.ndarray]], most: int = 250_000, fine: bool = False):
        self.encode_all, self.most, self.fine = encode_all, most, fine
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.passed = 0

    def _add(self, new: list[str]) -> None:
        if new:
            ids = self.encode_all(new)
            if isinstance(ids, tuple):
                flat, sizes = ids
            else:
                flat, sizes = np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.flat = np.concatenate([self.flat, flat]).astype(np.int32, copy=False)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def _drop(self, new: list[str]) -> None:
        """Of the chunks that came last those beyond ``most``."""
        room = min(self.most, int(np.searchsorted(self.ends, self.IDS * self.most, "right")) - 1)
        beyond = min(len(self.index) - room, len(new))
        if beyond > 0:
            for key in new[len(new) - beyond :]:
                del self.index[key]
            self.ends = self.ends[: len(self.index) + 1]
            self.flat = self.flat[: self.ends[-1]]
            self.passed += beyond
        if self.passed > 8 * self.most:
            self.forget()

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct chunks, and the number of ids of each."""
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        unseen = np.flatnonzero(at < 0)
        at[unseen] = len(self.index) + np.arange(len(unseen))
        new = [chunks[i] for i in unseen.tolist()]
        self._add(new)
        sizes = self.ends[at + 1] - self.ends[at]
        ids = gather(self.flat, self.ends[at], sizes)
        self._drop(new)
        return ids, sizes

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for a column of strings; null has no ids.

        Arrow cuts the texts at spaces and finds the distinct pieces.  Texts in which these
        may not be the chunks (white space at a piece's end) go to :meth:`encode`.
        """
        texts = texts.fill_null("").cast(pa.string())
        pieces = pc.split_pattern(texts, " ")
        starts = pieces.offsets.to_numpy()[:-1].astype(np.int64)
        counts = pieces.value_lengths().to_numpy().astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        if not len(coded):
            return np.empty(0, np.int32), counts
        starts -= starts[0]
        values, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        firsts = at[starts]
        inner = np.ones(len(at), bool)
        inner[starts] = False
        ragged = _ragged_of(values)
        odd = ragged[firsts] | np.logical_or.reduceat(ragged[at] & inner, starts)
        whole = np.repeat(~odd, counts)
        # Of the pieces that only begin texts nothing is looked up.
        used = np.zeros(len(values), bool)
        used[at[inner & whole]] = True
        looked = np.flatnonzero(used)
        wanted = pa.concat_arrays([values.take(pa.array(looked)), values.take(pa.array(firsts[~odd]))])
        cut = pc.split_pattern(finer(wanted) if self.fine else wanted, " ")
        n_parts = cut.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(n_parts) - n_parts
        spaced = np.zeros(int(n_parts.sum()), bool)
        spaced[first[: len(looked)]] = True
        parts = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), cut.flatten(), "").dictionary_encode()
        part = parts.indices.to_numpy()
        flat, sizes = self._ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        # From parts to chunks, and from these to the texts.
        begins = np.cumsum(sizes) - sizes
        flat = gather(flat, begins[part], sizes[part])
        sizes = np.add.reduceat(sizes[part], first) if len(first) else sizes
        begins = np.cumsum(sizes) - sizes
        number = np.zeros(len(values), np.int64)
        number[looked] = np.arange(len(looked))
        numbers = number[at]
        numbers[starts[~odd]] = len(looked) + np.arange(len(wanted) - len(looked))
        numbers = numbers[whole]
        begins, sizes = begins[numbers], sizes[numbers]
        ids = gather(flat, begins, sizes)
        upto, last = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(counts[~odd])
        n_ids = np.zeros(len(texts), np.int64)
        n_ids[~odd] = upto[last] - upto[last - counts[~odd]]
        if not odd.any():
            return ids, n_ids
        more, n_ids[odd] = self.encode(texts.filter(pa.array(odd)).to_pylist())
        begins = np.empty(len(texts), np.int64)
        for which, base in ((~odd, 0), (odd, len(ids))):
            begins[which] = base + np.cumsum(n_ids[which]) - n_ids[which]
        return gather(np.concatenate([ids, more]), begins, n_ids), n_ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after another, and the number of ids of each text."""
        parts = [(_simple(t) or split(t)) if t else [] for t in texts]
        keys = set().union(*parts)
        ragged = set(filter(_ragged, keys))
        if ragged:
            parts = [p if ragged.isdisjoint(p) else split(t) for p, t in zip(parts, texts)]
            keys = set().union(*parts)
        whole = {k: text_of(k) for k in keys}
        number = {t: i for i, t in enumerate(set(whole.values()))}  # a first chunk may be a later one elsewhere
        place = {k: number[t] for k, t in whole.items()}
        flat, sizes = self._ids(list(number))
        begins = np.cumsum(sizes) - sizes
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        begins, sizes = begins[at], sizes[at]
        ids = gather(flat, begins, sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        last = np.cumsum(counts)
        return ids, upto[last] - upto[last - counts]
