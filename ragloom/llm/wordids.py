"""Token ids of whole batches: pieces of texts are cut and numbered in array operations, each distinct piece is encoded once.

A vocabulary's own rule cuts a text into pieces that are encoded one by one. For
words of plain Latin letters, digits and ASCII marks that rule is followed here, for
all texts of a batch at once; a word with anything else (or an apostrophe) goes
to the tokenizer as it is, and a text whose white space or added tokens ask for
more goes as a whole. Tokenizers with other rules get every text as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress

import numpy as np
import pyarrow as pa

from ragloom.llm.common import LOWER, PIECE_BYTES, byte_view, kept, pieces
from ragloom.llm.spans import binary_array, byte_set

def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The rule by which the word vocabulary cuts a lower-cased text, as its file states it (a fixed value).
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOWER = np.frombuffer(LOWER, np.uint8)
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
for kind, ranges in (
    (MARK, [(0x21, 0x7E)]), (SPACE, [(0x09, 0x0D), (0x20, 0x20)]), (DIGIT, [(0x30, 0x39)]), (LETTER, [(0x41, 0x5A), (0x61, 0x7A)]),
):
    _CLASS[byte_set(*ranges)] = kind
#: Bytes that can begin white space, or a control character that counts as such, beyond 0x09-0x0D and 0x20.
_ODD = byte_set((0x1C, 0x1F), (0xC2, 0xC2), (0xE1, 0xE3))
_SPACES = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", *(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]


#: ASCII and the letters U+00C0 to U+00FF, without apostrophes and starts of added tokens.
_PLAIN = re.compile(rb"(?:[\x09-\x0d\x20-\x26\x28-\x3b\x3d-\x7e]++|<(?!\|)|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*+")

#: Pieces that are encoded in one go; the library's own objects of so many are held at once.
AT_ONCE = 4096


class Remembered(dict):
    """A dict that is emptied when its keys and values take more than ``limit`` bytes, objects included."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def of(self, keys: list[bytes]) -> list[bytes]:
        """The values of distinct keys; those of unknown keys are made together."""
        found = list(map(self.get, keys))
        if None in found:
            places = [i for i, value in enumerate(found) if value is None]
            new = [keys[i] for i in places]
            for i, key, value in zip(places, new, self.make(new), strict=True):
                found[i] = value
                self.held += len(key) + len(value) + 170
                if self.held > self.limit:
                    self.clear()
                    self.held = 0
                self[key] = value
        return found


def cut_bytes(data: bytes, bounds: list[int]) -> list[bytes]:
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of the letters U+00C0 to U+00FF are letters."""
    out = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    out[lead] = out[lead + 1] = LETTER
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and U+00C0 to U+00DE in lower case."""
    out = _LOWER[data]
    second = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[second] += 32
    return out


class BatchEncoder:
    """Ids (32-bit) of the texts of a batch."""

    def __init__(self, path: str, cache_bytes: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        self.added = [t["content"].encode() for t in known["added_tokens"]]
        steps = [n["type"] for n in (known["normalizer"] or {}).get("normalizers", [])]
        cuts = known["pre_tokenizer"] or {}
        rule = [p.get("pattern", {}).get("Regex") for p in cuts.get("pretokenizers", [])]
        #: white space is dropped and A-Z lower-cased, or kept with the piece behind it
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and rule[:1] == [WORD_RULE]
        self.by_byte = known["normalizer"] is None and cuts.get("type") == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"]
        self.known = Remembered(self.entries, cache_bytes)

    # what pieces or a text give; a subclass may count instead
    def of_pieces(self, made: list[bytes]) -> list[bytes]:
        """The values of plain pieces, which hold no zero byte."""
        letters = b"\0".join(made).decode("latin-1").translate(self.letters).split(self.letters[0])
        tokens = list(map(self.model.tokenize, letters))
        ids = array("I", [t.id for found in tokens for t in found])
        return cut_bytes(ids.tobytes(), [0, *(4 * n for n in accumulate(map(len, tokens)))])

    def of_text(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def entries(self, keys: list[bytes]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(key) is not None for key in keys]
        fit = list(compress(keys, plain))
        of_fit = chain.from_iterable(self.of_pieces(fit[lo : lo + AT_ONCE]) for lo in range(0, len(fit), AT_ONCE))
        return [next(of_fit) if fits else self.of_text(key.decode("utf-8", "replace")) for key, fits in zip(keys, plain)]

    def looked_up(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The values of all keys one after the other, and how many each key gave."""
        coded = keys.dictionary_encode()
        data, offsets = byte_view(coded.dictionary)
        found = self.known.of(cut_bytes(data.tobytes(), offsets.tolist()))
        flat = np.frombuffer(b"".join(found), np.uint32)
        # a batch is far from 2^31 ids; half as wide numbers are read and written here
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total < 1 << 31 else np.int64
        starts = (np.cumsum(sizes, dtype=kind) - sizes)[which]
        return flat[np.repeat(starts - ends.astype(kind) + n, n) + np.arange(total, dtype=kind)], n

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For pieces of a batch of texts in bytes: first text, text behind the last, ids, ids of each text."""
        data, offsets = byte_view(texts)
        for lo, hi in pieces(offsets, PIECE_BYTES):
            if not (self.by_word or self.by_byte):
                for i in range(lo, hi):
                    ids = np.frombuffer(self.of_text(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")), np.uint32)
                    yield i, i + 1, ids, np.array([len(ids)])
                continue
            bounds = offsets[lo : hi + 1] - offsets[lo]
            part = np.insert(data[offsets[lo] : offsets[hi]], bounds[1:], 0x20)  # one space behind each text
            ends = bounds[1:] + np.arange(hi - lo)  # places of these spaces
            keys, text, whole = self.cut(part, ends)
            ids, n = self.looked_up(keys)
            per_text = np.bincount(text, n, hi - lo).astype(np.int64)
            if len(whole):
                ids, per_text = self.put(ids, per_text, whole, part, ends)
            yield lo, hi, ids, per_text

    def put(self, ids: np.ndarray, per_text: np.ndarray, whole: np.ndarray, part: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the ids of the texts that are encoded as a whole."""
        starts = np.concatenate([[0], ends[:-1] + 1])
        made = {i: np.frombuffer(self.of_text(part[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")), np.uint32) for i in whole.tolist()}
        at = np.cumsum(per_text) - per_text
        out, before = [], 0
        for i in whole.tolist():
            out += [ids[before : at[i]], made[i]]
            before = at[i] + per_text[i]
            per_text[i] = len(made[i])
        return np.concatenate([*out, ids[before:]]), per_text

    def cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Keys of the pieces of all texts in order, the text of each, and the texts to be encoded as a whole."""
        kind = classes(data)
        inside = kind != SPACE
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))  # the last byte is a space
        starts, stops = edge[::2], edge[1::2]
        # words that hold what is not plain go as they are
        strange = (kind == OTHER) | (data == 0x27)
        strange[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        slow = np.logical_or.reduceat(strange, edge)[::2] if len(edge) else np.zeros(0, bool)
        changes = np.zeros(len(data) + 1, bool)
        changes[1:-1] = kind[1:] != kind[:-1]
        if self.by_word:
            changes[:-1] |= kind == DIGIT
        in_slow = np.zeros(len(data) + 1, np.int8)
        in_slow[starts[slow]] = 1
        in_slow[stops[slow]] = -1
        in_slow = np.cumsum(in_slow[:-1], dtype=np.int8).view(bool)
        opens = changes[:-1] & inside & ~in_slow
        opens[starts] = True
        limits = opens.copy()
        limits[stops] = True
        if self.by_word:
            data = np.where(in_slow, data, lowered(data))
            whole = np.zeros(0, np.int64)
        else:
            self._spaces(data, ends, starts, stops, opens, limits)
            whole = self._odd(data, ends)
        limit = np.flatnonzero(limits)
        here = np.flatnonzero(opens[limit])  # every piece begins at a limit
        begin, end = limit[here], np.append(limit, len(data))[here + 1]
        text = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(begin, ends, side="right"), prepend=0))
        if len(whole):
            keep = ~np.isin(text, whole)
            begin, end, text = begin[keep], end[keep], text[keep]
        size = end - begin
        offsets = np.concatenate([[0], np.cumsum(size)])
        if self.by_word:  # the pieces are all bytes but white space
            return binary_array(data[inside], offsets), text, whole
        at = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
        return binary_array(data[at], offsets), text, whole

    @staticmethod
    def _spaces(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, opens: np.ndarray, limits: np.ndarray) -> None:
        """Marks white space that is kept: the last space of a run joins the word behind it, the run up
        to its last character is a piece, and so is a last character that is no space."""
        first = np.concatenate([[0], ends[:-1] + 1])  # of each text
        text = np.searchsorted(ends, starts)
        opened = starts > first[text]  # white space stands before the word, in its text
        last = starts[opened] - 1
        joins = last[data[last] == 0x20]
        opens[joins + 1] = limits[joins + 1] = False
        opens[last] = limits[last] = True
        # where each run of white space begins: behind a word or at the start of a text
        begins = np.zeros(len(data) + 1, bool)
        begins[stops] = begins[first] = True
        runs = np.flatnonzero(begins[:-1])
        here = np.searchsorted(ends, runs)
        runs = runs[(runs < ends[here]) & np.isin(data[runs], np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))]
        opens[runs] = limits[runs] = True
        limits[ends] = True

    def _odd(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts with added tokens, or with white space beyond the plain one."""
        found: list[int] = []
        raw = data.tobytes()
        signs = self.added + (_SPACES if _ODD[data].any() else [])
        for sign in signs:
            at = raw.find(sign)
            while at >= 0:
                found.append(at)
                at = raw.find(sign, int(ends[np.searchsorted(ends, at)]))
        return np.unique(np.searchsorted(ends, np.array(found, np.int64)))


@kept
@lru_cache(2)
def batch_encoder(path: str, cache_bytes: int) -> BatchEncoder:
    """The encoder of a worker process, which keeps what it knows from task to task."""
    return BatchEncoder(path, cache_bytes)


def with_end(ids: np.ndarray, per_text: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind each text."""
    return np.insert(ids, np.cumsum(per_text), np.uint32(end_id)), per_text + 1
