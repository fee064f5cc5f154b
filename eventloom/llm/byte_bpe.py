"""Byte-level BPE of whole texts, by units that the pre-tokenizer never joins.

The pre-tokenizer starts a token at every space that stands between two characters other than white
space. So texts are cut at their single spaces, many texts at once, each distinct unit is encoded once, and a
text's ids are its units' ids in a row. Texts in which white space touches a cut, or that hold a special
token's string, go to the library whole.

Distinct units of common characters are cut again, into the pre-tokenizer's own tokens. Only tokens, and units
of other characters, that aren't in the table go through the library's merges.

Tokens hold all bytes of a text, so their spans follow from their lengths.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

#: Entries of a table's younger half; when it is full it becomes the older half. Longer pieces aren't kept.
MAX_UNITS, MAX_KEPT = 400_000, 48
#: Bytes of the rows whose texts are worth cutting at once: the more, the fewer distinct units a text; and characters that one call of the library gets (a longer unit alone).
RUN_BYTES, MAX_CALL = 1 << 24, 20_000
# Unicode's white space.
WHITE = frozenset("\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | frozenset(map(chr, range(0x2000, 0x200B)))

# The pre-tokenizer's rule, for characters whose classes no version of Unicode changes.
_PLAIN = [chr(c) for c in range(0xA1, 0x250)]
_LETTERS = "A-Za-z" + "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "0-9" + "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
OTHER = "[^\t\n\r -~\xa1-\u024f]"
TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
#: Bytes that stand for themselves in the vocabulary; the others follow from U+0100 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _SELF} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SELF))}
_MAPPED = np.array([ord(_BYTE[b]) for b in range(256)], "<u4")
_MAPPED[0] = ord(" ")  # between tokens


class Table:
    """A bounded map whose entries stay while they are used: two halves, the older one is dropped."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def get_all(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        if None in found:
            for i, x in enumerate(found):
                if x is None and (x := self.old.get(keys[i])) is not None:
                    found[i] = x
                    self.put(keys[i], x)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= MAX_UNITS:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """ids are uint32 arrays; only with offsets there are spans too."""

    def __init__(self, path: str, offsets: bool = False):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        white = "".join(sorted(WHITE))
        # with a special token of several words no text is cut
        never = "|" if any(" " in t for t in special) else ""
        self.uncut = "|".join([f"^ | $| [{white}]|[{white}] |[{white}]$", *map(_quoted, special)]) + never
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.lengths = np.zeros(len(self.spaced) if offsets else 0, np.int64)
        for token, i in vocabulary.items():
            self.spaced[i] = token[0] == "\u0120"
            if offsets:
                self.lengths[i] = len(token.encode()) if token in special else len(token)
        self.table = Table()

    def tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of tokens of the pre-tokenizer that hold common characters only."""
        ids, ends = [], [0]
        for t in _MAPPED[np.frombuffer("\0".join(tokens).encode(), np.uint8)].tobytes().decode("utf-32-le").split(" "):
            ids += [x.id for x in self.model.tokenize(t)]
            ends.append(len(ids))
        return _runs(ids, np.array(ends))

    def others(self, units: list[str]) -> list[bytes]:
        """Ids of any units, each with its space in front."""
        out: list[bytes] = []
        call = np.cumsum([len(u) for u in units]) // MAX_CALL
        for some in np.split(np.array(units, object), np.flatnonzero(np.diff(call)) + 1):
            ids = self.library.encode("".join(some), add_special_tokens=False).ids
            starts = np.flatnonzero(self.spaced[ids])  # a unit has no other space
            if len(starts) == len(some):
                out += _runs(ids, np.append(starts, len(ids)))
            else:  # the vocabulary lacks letters
                out += map(self.alone, some)
        return out

    def alone(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def kept(self, pieces: list[str], n_tokens: int) -> list[bytes]:
        """Ids of distinct pieces, the first of them tokens and the rest other units, from the table or made."""
        found = self.table.get_all(pieces)
        missing = [i for i, x in enumerate(found) if x is None]
        n = bisect.bisect_left(missing, n_tokens)
        for at, make in ((missing[:n], self.tokens), (missing[n:], self.others)):
            if at:
                for i, x in zip(at, make([pieces[i] for i in at]), strict=True):
                    found[i] = x
                    if len(pieces[i]) <= MAX_KEPT:
                        self.table.put(pieces[i], x)
        return found

    def units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and for each of these distinct units (with a space in front) where its ids begin and how many it has."""
        if not len(units):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        other = pc.match_substring_regex(units, OTHER)
        common = units.filter(pc.invert(other))
        tokens = TOKENS.findall(f" {pc.binary_join(pa.ListArray.from_arrays([0, len(common)], common), ' ')[0].as_py()}") if len(common) else []
        coded = pa.array(tokens + [f" {u}" for u in _list(units.filter(other))], pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        found = self.kept(_list(coded.dictionary), codes[: len(tokens)].max(initial=-1) + 1)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = _in_a_row(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(sizes) - sizes)[codes], sizes[codes])
        # a unit is its space's token and those up to the next unit's; other units come last
        starts = np.flatnonzero(pc.starts_with(coded.dictionary, " ").to_numpy(zero_copy_only=False)[codes])
        n = np.add.reduceat(sizes[codes], starts)
        order = np.argsort(np.argsort(other.to_numpy(zero_copy_only=False), kind="stable"))
        return ids, (np.cumsum(n) - n)[order], n[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all these texts (without nulls) in a row, and how many each text has."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        cut = pc.invert(pc.match_substring_regex(texts, self.uncut))
        parts = pc.split_pattern(pc.if_else(cut, texts, ""), " ")
        first = parts.offsets.to_numpy()[:-1]
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        rest = np.ones(len(codes), bool)
        rest[first] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[rest]] = True
        ids, begin, sizes = self.units(coded.dictionary.filter(pa.array(used)))
        # the first unit has no space in front, so it goes to the library; a text that isn't cut is one such unit
        alone = [self.alone(t) for t in pc.if_else(cut, pc.list_element(parts, 0), texts).to_pylist()]
        more = np.array([len(x) // 4 for x in alone])
        at = (np.cumsum(used) - 1)[codes]
        at[first] = np.arange(len(sizes), len(sizes) + len(texts))
        begin, sizes = np.r_[begin, len(ids) + np.cumsum(more) - more], np.r_[sizes, more]
        n = sizes[at]
        return _in_a_row(np.r_[ids, np.frombuffer(b"".join(alone), "<u4")], begin[at], n), np.add.reduceat(n, first)

    def encode_spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, and each token's first character and the place after its last one, in all these texts in a row; how many ids each text has."""
        ids, counts = self.encode(texts)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        if not np.array_equal(np.r_[0, ends][np.cumsum(counts)], np.cumsum(sizes)):  # tokens don't hold all bytes
            before = np.r_[0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)]
            spans = [np.array(self.library.encode(t, add_special_tokens=False).offsets, np.int64).reshape(-1, 2) + b for t, b in zip(texts.to_pylist(), before[:-1], strict=True)]
            return ids, *np.concatenate(spans).T, counts
        # a token that holds a part of a character spans all of it
        chars = np.cumsum((np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8) & 0xC0) != 0x80)
        return ids, chars[ends - lengths] - 1, chars[ends - 1], counts

    def ids(self, text: str) -> np.ndarray:
        return self.encode(pa.array([text]))[0]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and each token's first character and the place after its last one."""
        return self.encode_spans(pa.array([text]))[:3]


def _quoted(text: str) -> str:
    return re.sub(r"([!-/:-@\[-^`{-~])", r"\\\1", text)  # as RE2 has it


def _list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each


def _runs(ids: list[int], bounds: np.ndarray) -> list[bytes]:
    raw, at = np.array(ids, "<u4").tobytes(), (4 * bounds).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def _in_a_row(ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ids that begin there, so many each."""
    take = np.repeat((begin - (np.cumsum(n) - n)).astype(np.int32), n)  # a run of rows holds less than 2^31 ids
    take += np.arange(len(take), dtype=np.int32)
    return ids[take]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, offsets: bool = False) -> Encoder:
    """The process's encoder of this file; its table lives as long as the worker."""
    if (path, offsets) not in _encoders:
        _encoders[path, offsets] = Encoder(path, offsets)
    return _encoders[path, offsets]
