"""Encoding of whole texts with the tokenizers library, one call for each distinct chunk between spaces.

The rules of a word tokenizer never join characters over a space or a line feed, so a text's ids are its chunks' ids
in a row. A process keeps the ids of the chunks it has met, up to a bound; the library encodes only the others. That
holds for the rules below, which are compared with those of the file; with any others, whole texts are encoded. Texts
of plain letters are lower-cased, and parted before punctuation that follows a letter or digit, before that: the rules do
both, and far fewer chunks are distinct then.

Chunks are found in the bytes of some texts at a time, as places in one array; only the distinct ones become Python
objects.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa

from .common import MARKS, PORTION, marks_after_letters, portions, slices

_SHARED: dict = {}
_PLAIN = "\u0250"  # below: no combining marks, and each letter's lower case is one letter (but for U+0130)
_LOWER = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256))

# fixed values: the rules under which a text's chunks can be encoded apart
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _odd(x: np.ndarray, low: bytes, added: list[bytes]) -> np.ndarray:
    """Places of what makes a text not plain: characters from U+0250 on, U+0130, and added tokens in lower case."""
    found = [np.array([m.start() for t in added if t in low for m in re.finditer(re.escape(t), low)], np.int64)]
    if not low.isascii():
        at = np.flatnonzero(x >= 0xC4)
        after = x[np.minimum(at + 1, len(x) - 1)]
        found.append(at[(x[at] >= 0xCA) | ((x[at] == 0xC9) & (after >= 0x90)) | ((x[at] == 0xC4) & (after == 0xB0))])
    return np.concatenate(found)


class ChunkEncoder:
    """Ids of whole texts; ``keep`` bounds the number of chunks remembered, each of at most ``longest`` bytes."""

    def __init__(self, path: str, keep: int = 1_500_000, longest: int = 48, portion: int = PORTION):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        rules = json.loads(self.library.to_str())
        self.whole = any(rules[k] != v for k, v in _RULES.items()) or rules["post_processor"] is not None or any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"])
        # the same merges without the rules that lower-cased letters pass unchanged, over words joined by spaces
        bare = rules
        split = [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.bare = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": split}, "post_processor": None, "added_tokens": []}))
        self.added = [t["content"].lower().encode() for t in rules["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        end = rules["model"].get("end_of_word_suffix")  # of letters, only a word's last id can have it
        self.last = np.zeros(max(self.bare.get_vocab().values()) + 1, bool)
        self.last[[i for t, i in self.bare.get_vocab().items() if end and t.endswith(end)]] = True
        self.keep, self.longest, self.portion = keep, longest, portion
        self.known: dict[bytes, int] = {}  # the number of each chunk, in the order met
        self.ids = pa.array([], pa.binary())  # by number

    @classmethod
    def shared(cls, path: str) -> ChunkEncoder:
        if path not in _SHARED:
            _SHARED[path] = cls(path)
        return _SHARED[path]

    def bare_ids(self, words: list[bytes], at_once: int = 500) -> dict[bytes, bytes]:
        """Ids of lower-case words of plain letters, many in one call where each word's last id tells that it is that."""
        out, parts = {}, [words[k : k + at_once] for k in range(0, len(words), at_once)]
        for k in range(0, len(parts), 20):
            some = parts[k : k + 20]
            for part, e in zip(some, self.bare.encode_batch_fast([b" ".join(p).decode() for p in some], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(part) and ends[-1] == len(ids):
                    raw, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
                    out.update(zip(part, [raw[x:y] for x, y in zip([0, *ends], ends)]))
                else:
                    out.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(part, self.bare.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)))
        return out

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of unknown chunks.

        The rules part letters from the punctuation after them and lower-case them, so a chunk of plain letters and
        punctuation is put together from its lower-case letters and its punctuation, which many chunks share.
        """
        letters = [c for c in chunks if c.isalpha() and c.islower()]  # of ASCII
        ids = self.bare_ids(letters)
        ids[b""] = b""
        parts, need, more = [], set(), set()
        for b in chunks:
            if b in ids:
                continue
            c = b.decode()
            core = c.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or (max(core) < _PLAIN and "\u0130" not in core)):
                low, tail = core.lower().encode(), c[len(core) :].encode()
                more.add(low)
            else:
                low, tail = b"", b
            parts.append((b, low, tail))
            need.add(tail)
        ids |= self.bare_ids(list(more.difference(ids)))
        own = list(need.difference(ids))
        for at in range(0, len(own), 20_000):
            part = own[at : at + 20_000]
            ids.update((c, np.array(e.ids, self.dtype).tobytes()) for c, e in zip(part, self.library.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)))
        ids.update([(b, ids[low] + ids[tail]) for b, low, tail in parts])
        return ids

    def rest(self) -> None:
        """Goes back to the chunks met first, a quarter of ``keep``: those are the frequent ones. Called at the end of a
        task too, as an idle worker holds its memory while others work in the same executor."""
        few = self.keep // 4
        if len(self.known) > few:
            self.known = dict(islice(self.known.items(), few))
            self.ids = self.ids.take(pa.array(np.arange(few)))
            trim()

    def chunks(self, raw: bytes, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Chunks that have the texts' ids in a row, each with the space before it, and where each text's start."""
        low = raw.translate(_LOWER)
        x = np.frombuffer(low, np.uint8)
        part = marks_after_letters(x)  # no match of the rules reaches from a letter or digit into these
        odd = np.unique(np.searchsorted(offsets, _odd(x, low, self.added), "right") - 1)
        if len(odd):  # those stay as they are
            x = x.copy()
            for a, b in zip(offsets[odd].tolist(), offsets[odd + 1].tolist()):
                x[a:b] = np.frombuffer(raw[a:b].replace(b"\n", b" "), np.uint8)
                part[a:b] = False
        return slices(x, part | (x == 32), offsets)

    def encode_portion(self, raw: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        found, first = self.chunks(raw, offsets)
        distinct = [c[1:] if c[0] == 32 else c for c in found.dictionary.to_numpy(zero_copy_only=False).tolist()]
        new = list(set(distinct).difference(self.known))
        if any(len(c) > self.longest for c in new):  # those last, as they aren't remembered
            new.sort(key=lambda c: len(c) > self.longest)
        self.ids = pa.concat_arrays([self.ids, pa.array(list(map(self.learn(new).__getitem__, new)), pa.binary())])
        self.known.update(zip(new, range(len(self.known), len(self.ids))))
        own = self.ids.take(pa.array(np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))))
        all_ = own.take(found.indices)
        ids = np.frombuffer(all_.buffers()[2] or b"", self.dtype)
        ends = (np.frombuffer(all_.buffers()[1], np.int32)[first] // self.dtype.itemsize).tolist()
        while new and len(new[-1]) > self.longest:
            del self.known[new.pop()]
        self.ids = self.ids.slice(0, len(self.known))
        if len(self.known) > self.keep:
            self.rest()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        if self.whole:
            texts = texts if isinstance(texts, list) else texts.to_pylist()
            return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        return [x for raw, offsets in portions(column, self.portion) for x in self.encode_portion(raw, offsets)]


def vocabulary(path: str) -> int:
    return ChunkEncoder.shared(path).library.get_vocab_size()
