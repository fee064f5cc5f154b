"""SentencePiece BPE encoding and decoding by a prefix table.

A merge-type encoding is fixed by one fact for each prefix of a word: its unique last token. Going
through the automaton's matches (all vocabulary pieces that end at a position), a piece is that token
exactly if the prefix before it ends in a token with which the piece forms a compatible pair, one that
merging leaves as it is. The ids follow by walking back from the word's end. Work is linear in the
text's length for any text.

The model's pieces carry a space mark only in front, so a text is a row of words that merge apart from
each other. Runs of several spaces are the one exception: their pieces share one lowest score, so they
merge last, leftmost first, and are merged by that rule here. Characters outside the vocabulary become
byte pieces. Words are memoised in a bounded table.

Null texts count as empty and give no ids. Rows are independent: repeated rows give repeated results.
Operators keep no columns but doc_id and text, so clashing names can't occur.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from eventloom.llm.common import map_batches, texts

SPACE = "▁"
#: Entries of the word table's younger half, which becomes the older half when it is full; and of the pair
#: table, which is emptied. Longer words aren't kept.
MAX_WORDS, MAX_PAIRS, MAX_KEPT = 110_000, 300_000, 48
NORMAL = 1  # the piece type of the model file


def merge(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Merging by rank, leftmost first among equals; for tests of pieces and pairs, and for runs of spaces."""
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i] if 0 <= i else len(parts)
        if i >= 0 and j < len(parts) and (r := rank.get(both := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, j, both))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class Codec:
    def __init__(self, model_path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        sp = self.library
        size = sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        order = sorted(pieces, key=lambda p: -sp.get_score(pieces[p]))
        #: Rank of each piece; runs of spaces share the last one, as they share one score.
        self.rank, seen = {}, None
        for p in order:
            if sp.get_score(pieces[p]) != seen:
                seen, at = sp.get_score(pieces[p]), len(self.rank)
            self.rank[p] = at
        self.ids = pieces
        self.runs = {p for p in pieces if len(p) > 1 and not p.strip(SPACE)}
        self.word_rank = {p: r for p, r in self.rank.items() if p not in self.runs}
        if any(SPACE in p.lstrip(SPACE) or (p not in self.runs and p.startswith(SPACE * 2)) for p in pieces):
            raise ValueError("this model merges across words")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.known = {p for p in pieces if len(p) == 1}
        self.length = {i: len(p) for p, i in pieces.items()}
        self.piece = {i: p for p, i in pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.word_rank:
            if len(p) == 1 or merge(list(p), self.word_rank) == [p]:
                self.automaton.add_word(p, pieces[p])
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}
        self.space = pieces[SPACE]

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.piece[left], self.piece[right]
        ok = merge(list(a + b), self.word_rank) == [a, b]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = ok
        return ok

    def segment(self, s: str) -> list[int]:
        """Ids of a stretch of known characters, by its prefix table."""
        last = [0] * (len(s) + 1)  # ids of single pieces are never 0
        length, pairs = self.length, self.pairs
        for end, token in self.automaton.iter(s):
            end += 1
            if last[end]:
                continue
            start = end - length[token]
            if start:
                left = last[start]
                ok = pairs.get(left << 20 | token)
                if not (self.compatible(left, token) if ok is None else ok):
                    continue
            last[end] = token
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return out

    def word(self, part: str) -> tuple[tuple[int, ...], str]:
        """Ids of one space mark and what follows it up to the next, and the same in decimal."""
        if (found := self.older.get(part)) is not None:
            return self.keep(part, found)
        s, out, at = SPACE + part, [], 0
        if self.known.issuperset(s):
            out = self.segment(s)
        else:
            for i, c in enumerate(s):
                if c not in self.known:
                    if i > at:
                        out += self.segment(s[at:i])
                    out += [self.bytes[b] for b in c.encode()]
                    at = i + 1
            if at < len(s):
                out += self.segment(s[at:])
        return self.keep(part, (tuple(out), ",".join(map(str, out))))

    def keep(self, part: str, found: tuple[tuple[int, ...], str]) -> tuple[tuple[int, ...], str]:
        if len(part) <= MAX_KEPT:
            if len(self.words) >= MAX_WORDS:
                self.older, self.words = self.words, {}
            self.words[part] = found
        return found

    def units(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")  # the library puts one space in front
        found = list(map(self.words.get, parts))
        for i, x in enumerate(found):
            if x is None:
                found[i] = self.words.get(parts[i]) or self.word(parts[i])
        if "" in parts[:-1]:
            found = self.joined_runs(parts, found)
        return found

    def joined_runs(self, parts: list[str], found: list) -> list:
        """Merge runs of lone space marks; a word's own mark joins if nothing else took it."""
        out, count = [], 0

        def close() -> None:
            if count:
                ids = tuple(self.ids[p] for p in merge([SPACE] * count, {p: 0 for p in self.runs}))
                out.append((ids, ",".join(map(str, ids))))

        for part, (ids, decimal) in zip(parts, found, strict=True):
            if part == "":
                count += 1
                continue
            if count and ids[0] == self.space:
                count += 1
                ids, decimal = ids[1:], decimal.partition(",")[2]
            close()
            count = 0
            out.append((ids, decimal))
        close()
        return [x for x in out if x[0]]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(u[0] for u in self.units(text)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    """The process's codec of this model; its tables live as long as the worker."""
    if model_path not in _codecs:
        _codecs[model_path] = Codec(model_path)
    return _codecs[model_path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array of int) of each whole text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.encode(t) for t in texts(batch)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of each row's ids; null ids decode to the empty text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), each, "doc_id long, text string")


def digest_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, in one pass."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        counts, ids_sha, decoded_sha = [], [], []
        for t in texts(batch):
            units = c.units(t)
            ids = list(chain.from_iterable([u[0] for u in units]))
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join([u[1] for u in units]).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
