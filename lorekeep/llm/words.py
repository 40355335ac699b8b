"""Blank-separated words of a batch of texts, each distinct one once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of the texts that are worked on together; a longer text is worked on alone.
BYTES = 6 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def portions(texts: pa.Array, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows of at most `most` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi


def distinct(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the number of each text's words among them one after another, and where each text begins.

    A text is cut at every blank and line end, so words may be empty.  Null counts as empty.
    """
    whole = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
    lists = pc.split_pattern(whole, " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy()


@dataclass
class Cut:
    """The words of some texts one after another.

    data holds the texts' bytes, each text followed by one blank; starts and ends are the words'
    places in it, and begin the number of each text's first word, with their total at the end.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    begin: np.ndarray

    def named(self) -> tuple[np.ndarray, pa.Array]:
        """The words as numbers of distinct words, and these."""
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts], inside[self.ends] = 1, -1
        letters = self.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        places = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        coded = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(places), pa.py_buffer(letters)]).dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def kept(self, keep: np.ndarray) -> pa.Array:
        """Each text's words of keep, joined by one blank."""
        starts, ends = self.starts[keep], self.ends[keep] + 1
        data = self.data.copy()
        data[ends - 1] = 32
        first = np.concatenate([[0], np.cumsum(keep)])[self.begin]
        last = first[1:][first[1:] > first[:-1]] - 1
        ends[last] -= 1  # no blank after a text's last word
        inside = np.zeros(len(data) + 2, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        places = np.concatenate([[0], np.cumsum(ends - starts)])[first]
        out = data[np.cumsum(inside[:-2], dtype=np.int8).view(bool)]
        return pa.Array.from_buffers(pa.large_string(), len(self.begin) - 1, [None, pa.py_buffer(places), pa.py_buffer(out)]).cast(pa.string())


def cut(texts: pa.Array) -> Cut:
    """Words are runs of other bytes than blanks (0x20, 0x09-0x0D).  Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    data = np.frombuffer(b"".join(t + b" " for t in texts.to_pylist()), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return Cut(data, starts, ends, np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])))
