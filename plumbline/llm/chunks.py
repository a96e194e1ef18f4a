"""Encoding texts by their white-space-free chunks, each distinct chunk once per worker.

A tokenizer whose splitting never crosses white space gives a text the tokens of
its chunks, one after the other. Chunks are cut at ASCII white space in UTF-8
bytes; a chunk may hold other white space, which the encoder deals with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Chunks remembered per Python worker, about 200 bytes each. Results do not depend on it.
REMEMBERED = 300_000


def forget(known: dict, most: int) -> None:
    """Make room in a memory of more than ``most``: short keys come back more often than long ones."""
    if len(known) > most:
        middle = np.median(np.fromiter(map(len, known), dtype=np.int64, count=len(known)))
        for key in [k for k in known if len(k) >= middle and k]:
            del known[key]


class ChunkEncoder:
    """``encode(array of chunks) -> ids of each as bytes`` behind a memory.

    Texts are split and their distinct chunks found in Arrow; Python sees each distinct
    chunk of a batch once. So that there are fewer of them, ASCII letters become lower
    case and marks behind a word are set apart, as the tokenizer does itself; texts
    with combining marks, or with ``special``, how all special tokens begin, are left
    as they are. Ids are of numpy type ``kind``.
    """

    def __init__(
        self, encode: Callable[[pa.Array], Iterable[bytes]], kind: str = "<u4", special: str = "<|", remembered: int = REMEMBERED
    ):
        self._encode, self._kind, self._special, self._remembered = encode, np.dtype(kind), special, remembered
        self._known: dict[bytes, bytes] = {b"": b""}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text begins (and the last ends); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.or_(pc.match_substring(texts, self._special), pc.match_substring_regex(texts, r"\pM"))
        usual = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=r"(\pL)([[:punct:]]+)(\s)", replacement=r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(odd, texts, usual))
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        distinct = words.cast(pa.binary()).to_pylist()
        known = self._known
        forget(known, self._remembered)
        new = np.flatnonzero([c not in known for c in distinct])
        for lo in range(0, len(new), 50_000):
            part = words.take(pa.array(new[lo : lo + 50_000]))
            known.update(zip(part.cast(pa.binary()).to_pylist(), self._encode(part), strict=True))
        ids = list(map(known.__getitem__, distinct))
        table = np.frombuffer(b"".join(ids), dtype=self._kind)
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self._kind.itemsize
        start = np.cumsum(length) - length
        ends = np.concatenate([[0], np.cumsum(length[index])])
        source = np.repeat(start[index] - ends[:-1], length[index])
        source += np.arange(len(source))
        return table[source], ends[bounds - bounds[0]]

    def each(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        ids, at = self(texts)
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]
