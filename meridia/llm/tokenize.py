"""Token ids of whole texts, with a memo of encodings in each worker.

A text is cut into units, runs of characters up to, not including, the next ASCII white space
that follows a character which is not white space. No pre-token of a byte-level BPE crosses
such a border, nor the one between letters and the punctuation or the single line end that
follows them, so the ids of a text are those of its parts in a row. The tokenizers library
encodes each part when a worker first meets it. Texts with other white space are encoded whole.

Columns of texts are cut, looked up and put together in Arrow, so Python sees each distinct unit
of a few megabytes of text once.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each of the two generations of the memo of odd texts and tails; when the young one is full it replaces the old one.
MEMO = 200_000
#: Entries of the memo of words; when it has more, only the words of the last column stay.
WORDS = 400_000
#: Bytes of text that are cut at once, about.
AT_ONCE = 6 << 20
_OTHER_SPACE = "\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_WHOLE = re.compile(f"[{_OTHER_SPACE}]")
_UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Texts that are not cut in columns: with other white space, two white spaces in a row, or the mark used in cutting.
_ODD = f"[ \t-\r][ \t-\r]|[\x00{_OTHER_SPACE}]"
#: One pre-token of a byte-level BPE in every version of Unicode.
_WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
#: Punctuation that may follow a word; neither the apostrophe of contractions nor what special strings end with.
_TAIL = ",.;:!?*&%$#)]}\"-"


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabulary of a byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _plain(tok) -> bool:
    """Whether nothing but the model sees a word: no normalizer, GPT-2's pre-tokenizer, no added token that a word can hold."""
    from tokenizers.pre_tokenizers import ByteLevel

    pre, added = tok.pre_tokenizer, tok.get_added_tokens_decoder().values()
    plain = isinstance(pre, ByteLevel) and pre.use_regex and not pre.add_prefix_space and tok.normalizer is None and tok.post_processor is None
    return plain and tok.truncation is None and tok.padding is None and not any(re.fullmatch(r"[^\W\d_]*", t.content.strip()) for t in added)


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.plain, self.letters = _plain(self.tok), _byte_letters()
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _new(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, parts: list[str]) -> list[bytes]:
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, parts))
        missing = [k for k, ids in enumerate(out) if ids is None]
        unknown = []
        for k in missing:
            if (ids := old.get(parts[k])) is None:
                unknown.append(k)
            else:
                out[k] = young[parts[k]] = ids
        for k, ids in zip(unknown, self._new([parts[k] for k in unknown])):
            out[k] = ids
            if len(parts[k]) <= 48:
                young[parts[k]] = ids
        return out

    def _modelled(self, words: pa.Array) -> pa.Array:
        """The ids of words that are one pre-token each, by the model alone."""
        tokenize, ids, ends = self.tok.model.tokenize, array("I"), array("i", [0])
        for word in "\n".join(words.to_pylist()).encode().decode("latin1").translate(self.letters).split(self.letters[10]):
            ids.extend([t.id for t in tokenize(word)])
            ends.append(4 * len(ids))
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def _encoded(self, parts: pa.Array) -> pa.Array:
        """The ids of parts that the memo does not have."""
        word = pc.match_substring_regex(parts, _WORD) if self.plain else pa.array([False] * len(parts), pa.bool_())
        words, others = parts.filter(word), parts.filter(pc.invert(word)).to_pylist()
        ids = pa.concat_arrays([self._modelled(words) if len(words) else self.ids[:0], pa.array(self._new(others), pa.binary())])
        first = word.to_numpy(zero_copy_only=False)
        at = np.where(first, np.cumsum(first) - 1, len(words) + np.cumsum(~first) - 1)
        return ids.take(pa.array(at))

    def _column(self, parts: pa.Array) -> pa.Array:
        coded = parts.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        missing = coded.dictionary.filter(at.is_null())
        known, words = pa.concat_arrays([self.ids, self._encoded(missing)]), pa.concat_arrays([self.words, missing])
        new = at.is_null().to_numpy(zero_copy_only=False)
        place = np.where(new, len(self.words) + np.cumsum(new) - 1, at.fill_null(0).to_numpy())
        ids = known.take(pa.array(place))
        self.words, self.ids = (words, known) if len(words) <= WORDS else (coded.dictionary, ids)
        return ids.take(coded.indices)

    def _tails(self, units: pa.Array, cores: pa.Array) -> pa.Array:
        """The ids of what follows the core of each unit; tails of one character are told by their byte, and only longer ones go to Python."""
        size = pc.subtract(pc.binary_length(units), pc.binary_length(cores)).to_numpy()
        ends = np.frombuffer(units.buffers()[1], np.int32, len(units) + 1, units.offset * 4)[1:]
        slot = np.zeros(128, np.int32)  # tails are ASCII
        slot[[ord(c) for c in _TAIL]] = np.arange(1, len(_TAIL) + 1)
        at, one, more = np.zeros(len(units), np.int32), size == 1, size > 1
        at[one] = slot[np.frombuffer(units.buffers()[2] or b"", np.uint8)[ends[one] - 1]]
        tails = [u[-n:] for u, n in zip(units.filter(pa.array(more)).to_pylist(), size[more].tolist())]
        coded = pa.array(tails, pa.string()).dictionary_encode()
        at[more] = coded.indices.to_numpy() + len(_TAIL) + 1
        return pa.array([b"", *self._known(list(_TAIL)), *self._known(coded.dictionary.to_pylist())], pa.binary()).take(pa.array(at))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _WHOLE.search(text):
            return self._new([text])[0]
        return b"".join(self._known(_UNIT.findall(text)))

    def _cut(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, _ODD)
        marked = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(odd)), " ", "\x00 "), "\n", "\x00\n\x00")
        units = pc.split_pattern(marked, "\x00")
        coded = units.flatten().dictionary_encode()
        core = pc.utf8_rtrim(coded.dictionary, _TAIL)
        core = pc.if_else(pc.utf8_is_alpha(pc.utf8_ltrim(core, " ")), core, coded.dictionary)
        ids = pc.binary_join_element_wise(self._column(core), self._tails(coded.dictionary, core), b"").take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4) if len(ids) else np.zeros(1, np.int32)
        first = units.offsets.to_numpy() - units.offsets[0].as_py() if len(units) else np.zeros(1, np.int32)
        raw, at = memoryview(ids.buffers()[2] or b""), iter(ends[first].tolist())
        begin = next(at)
        for k, is_odd in enumerate(odd.to_pylist()):
            if is_odd:
                yield self.encode(texts[k].as_py())
            else:
                end = next(at)
                yield raw[begin:end].tobytes()
                begin = end

    def rest(self) -> None:
        """At a task's end: the worker stays for other stages, so only the young part of the memo is kept."""
        self.old = {}

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column; null: none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + AT_ONCE)))
            yield from self._cut(texts.slice(start, stop - start).cast(pa.string()))
            start = stop


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    return Encoder(path)
