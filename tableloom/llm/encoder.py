"""Token ids of whole texts, with a memory of the chunks seen before."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release

#: Letters and marks for which cutting a chunk is certain to agree with the tokenizer's own pattern.
_MARKS = ".,;:!?"
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: An entry of a memory takes some 200 bytes: a memory holds about 16 MB.
MEMORY_ENTRIES = (16 << 20) // 200
#: Characters of new chunks that the library encodes in one call: it takes a hundred bytes and more of its own for each.
CALL = 16 << 10
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library, as little-endian unsigned 32-bit bytes.

    The pattern of such tokenizers starts a new word at every single space between two other
    characters, so a text may be cut there, chunks be encoded once by the library, and their ids be
    joined. A chunk that is a word and marks is cut once more between the two. Both memories take
    ``limit`` entries, then stay as they are until ``forget``, which empties the full ones. Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str, limit: int = MEMORY_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.limit = limit
        #: ids of " word", by word; of marks that follow a word; and of all other chunks with a space before them
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.spaces = np.array([self.tokenizer.decode([i]).startswith(" ") for i in range(self.vocabulary)])

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _together(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks without a space, each with one before it, from calls of at most ``CALL`` characters (or one longer chunk)."""
        ends = np.cumsum([len(c) + 1 for c in chunks])
        found, begin = {}, 0
        while begin < len(chunks):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CALL, side="right")))
            found |= self._one_call(chunks[begin:end])
            begin = end
        return found

    def _one_call(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of some chunks without a space, each with one before it: each begins where an id begins with a space."""
        [coded] = self.tokenizer.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)
        ids = np.array(coded.ids, dtype="<u4")
        cuts = np.flatnonzero(self.spaces[ids])
        if len(cuts) != len(chunks):
            return {c: self._plain(" " + c) for c in chunks}
        data, edges = ids.tobytes(), [*(cuts * 4).tolist(), 4 * len(ids)]
        return dict(zip(chunks, [data[a:b] for a, b in zip(edges, edges[1:])]))

    def _known(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of different chunks with a space before each; None where that space is not a place to cut."""
        words, others, marks, rest = self.words, self.others, self.marks, []
        ids = list(map(words.get, chunks))
        for k, found in enumerate(ids):
            if found is None:
                chunk = chunks[k]
                core = chunk.rstrip(_MARKS)
                found, after = words.get(core), marks.get(chunk[len(core):])
                if found is not None and after is not None:
                    ids[k] = found + after
                elif (found := others.get(chunk)) is not None:
                    ids[k] = found
                else:
                    rest.append(k)
        if rest:
            cores = {chunks[k]: chunks[k].rstrip(_MARKS) for k in rest}
            cores = {c: core for c, core in cores.items() if _WORD.fullmatch(core)}
            odd = {c for c in map(chunks.__getitem__, rest) if c not in cores and _sound(c)}
            new = self._together(list(set(cores.values())))
            seen = self._together([c for c in odd if " " not in c]) | {c: self._plain(" " + c) for c in odd if " " in c}
            for k in rest:
                c = chunks[k]
                ids[k] = (new[cores[c]] + self._mark(c[len(cores[c]):])) if c in cores else seen.get(c)
            for memory, more in ((words, new), (others, seen)):
                memory.update(islice(more.items(), max(0, self.limit - len(memory))))  # the first words of a task are the frequent ones
        return ids

    def forget(self) -> None:
        """Empty full memories, which may hold the words of other texts than those to come; the rest serve the next task."""
        for memory in (self.words, self.marks, self.others):
            if len(memory) >= self.limit:
                memory.clear()
        release()

    def _mark(self, marks: str) -> bytes:
        if not marks:
            return b""
        found = self.marks.get(marks)
        if found is None:
            found = self._plain(marks)
            if len(marks) < 9:  # so that this memory stays small
                self.marks[marks] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of one text, cut only at single spaces between other characters; runs of white space stay inside a chunk."""
        if not text:
            return b""
        first, *rest = _SAFE_SPACE.split(text)
        return self._plain(first) + b"".join([self._plain(" " + c) if v is None else v for c, v in zip(rest, self._known(rest))])

    def encode_all(self, texts: pa.Array, most: int = 512 << 10) -> Iterator[bytes]:
        """Ids of many texts in order, null as none, some ``most`` bytes of text at a time.

        Chunks are split and told apart by Arrow, looked up once each, and put together by Arrow again.
        """
        texts = texts.fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + most, side="right")))
            yield from self._encode_some(texts.slice(begin, end - begin))
            begin = end

    def _encode_some(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self._known(chunks)
        whole = pa.array(ids, pa.binary()).take(coded.indices)
        at = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1, whole.offset * 4)
        data = memoryview(whole.buffers()[2]) if len(whole) and whole.buffers()[2] else memoryview(b"")
        unsound = np.array([v is None for v in ids], dtype=bool)[coded.indices.to_numpy()]
        odd = np.logical_or.reduceat(unsound, edges[:-1]) if len(unsound) else []
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if odd[k]:
                yield self.encode(texts[k].as_py())
            else:
                yield self._plain(chunks[coded.indices[a].as_py()]) + bytes(data[at[a + 1]:at[b]])


def _sound(chunk: str) -> bool:
    """Whether the spaces around a chunk stand between two other characters."""
    return chunk != "" and not chunk[0].isspace() and not chunk[-1].isspace()


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """The encoder of this Python worker, for one task: the file is read once, full memories go with the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    try:
        yield _ENCODERS[path]
    finally:
        _ENCODERS[path].forget()
