"""Exact byte-pair encoding with a public ``tokenizers`` vocabulary file.

A text is cut at ASCII white space into chunks.  The vocabularies used here drop
white space before merging, so the ids of a text are the ids of its chunks, one
after another; only distinct chunks of a piece are ever encoded.
"""

from __future__ import annotations

import heapq
import json
import os
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex

from marlstone.llm.bpe_batch import BatchMerger, KnownChunks

#: Text bytes encoded at a time; larger pieces hold fewer distinct chunks.
PIECE_BYTES = 12 << 20

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def library(path: str):
    """The ``tokenizers`` library's own tokenizer, without truncation or padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible Latin-1 bytes keep their place, others follow from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _kinds() -> np.ndarray:
    """1: ASCII letter; 2: mark that is plain after letters; 0: any other byte."""
    out = np.zeros(256, np.uint8)
    out[65:91] = out[97:123] = 1
    for b in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
        out[b] = 2
    out[[ord("'"), ord("<")]] = 0  # contractions and special tokens begin with these
    return out


_KIND = _kinds()


def merge_symbols(symbol: list[int | None], merges: dict[tuple[int, int], tuple[int, int]]) -> tuple[list[int | None], int]:
    """Merge the lowest-ranked adjacent pair, leftmost first, until none is left: the symbols, with ``None`` where one was merged away, and the merges made.

    Symbols are a doubly linked list and pairs a heap, in which entries that no longer hold are skipped, so that time
    grows with ``n log n``.
    """
    n = len(symbol)
    before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
    heap = [(m[0], k, m[1], symbol[k], symbol[k + 1]) for k in range(n - 1) if (m := merges.get((symbol[k], symbol[k + 1])))]
    heapq.heapify(heap)
    merged = 0
    while heap:
        _, k, new, left, right = heapq.heappop(heap)
        j = after[k]
        if symbol[k] != left or j >= n or symbol[j] != right:
            continue
        symbol[k], symbol[j] = new, None
        merged += 1
        after[k] = nxt = after[j]
        if nxt < n:
            before[nxt] = k
            if m := merges.get((new, symbol[nxt])):
                heapq.heappush(heap, (m[0], k, m[1], new, symbol[nxt]))
        if (p := before[k]) >= 0 and (m := merges.get((symbol[p], new))):
            heapq.heappush(heap, (m[0], p, m[1], symbol[p], new))
    return symbol, merged


class Vocabulary:
    """Merge ranks and ids of a byte-level BPE file whose words carry an end suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("unk_token"):
            raise ValueError("a byte-level BPE vocabulary with an end-of-word suffix is needed")
        self.path, self.suffix, self.ids = path, model["end_of_word_suffix"], dict(model["vocab"])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left id, right id) -> (rank, merged id)
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.final = [self.ids[c + self.suffix] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.ids.setdefault(content, i)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        tok = library(path)
        self.normalise, self.pretokenise = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(letters)}
        #: Plain chunks, for which normalising is lower-casing: Latin-1 letters, then marks other than an apostrophe.
        self.plain = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{|}~]*)")

    def parts(self, chunk: str) -> list[str | int]:
        """The words of a chunk as UTF-8-encodable strings, in order; a special token's string becomes its id."""
        if (m := self.plain.fullmatch(chunk)) and "<|" not in m[2]:
            return [m[1].lower(), m[2]] if m[2] else [m[1].lower()]
        out: list[str | int] = []
        for k, piece in enumerate(self.cut.split(chunk) if self.cut else [chunk]):
            if k % 2:
                out.append(self.special[piece])
            elif piece:
                for word, _ in self.pretokenise(self.normalise(piece)):
                    out.append(bytes(self.byte_of[c] for c in word).decode("utf-8", "surrogateescape"))
        return out

    def symbols(self, word: str) -> list[int]:
        body = word.encode("utf-8", "surrogateescape")
        return [*map(self.inner.__getitem__, body[:-1]), self.final[body[-1]]]

    def merge(self, word: str) -> list[int]:
        """Ids of one word of any length."""
        return [i for i in merge_symbols(self.symbols(word), self.merges)[0] if i is not None]

    @cached_property
    def batch(self) -> BatchMerger:
        return BatchMerger(self.merges, self.inner, self.final)

    @cached_property
    def known(self) -> KnownChunks:
        return KnownChunks(self.encode_distinct)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, as little-endian unsigned 32-bit integers; all distinct words are merged together."""
        index: dict[str, int] = {}
        plan: list[list[int]] = []
        for c in chunks:
            plan.append([-1 - p if isinstance(p, int) else index.setdefault(p, len(index)) for p in self.parts(c)])
        merged = self.batch.ids([w.encode("utf-8", "surrogateescape") for w in index], lambda w: self.merge(w.decode("utf-8", "surrogateescape")))
        packed = [a.tobytes() for a in merged]
        return [packed[r[0]] if len(r) == 1 and r[0] >= 0 else b"".join(packed[k] if k >= 0 else (-1 - k).to_bytes(4, "little") for k in r) for r in plan]

    def encode_distinct(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each chunk: a pool of ids, where each chunk's begin in it, and how many there are.

        Chunks of Latin-1 letters and then marks need no look at their characters one by one; the others go the long way.
        """
        n = len(chunks)
        ends = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + n + 1].astype(np.int64)
        body = np.frombuffer(chunks.buffers()[2], np.uint8) if n and chunks.buffers()[2] is not None else np.empty(0, np.uint8)
        start, size = ends[:-1], np.diff(ends)
        kind = _KIND[body]
        accent = np.zeros(len(body), bool)
        if len(body) > 1:
            accent[1:] = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0xBF) & (body[1:] != 0x97) & (body[1:] != 0xB7)
            kind = np.where(accent | np.append(accent[1:], False), 1, kind)
        letter, odd = np.concatenate([[0], np.cumsum(kind == 1)]), np.concatenate([[0], np.cumsum(kind == 0)])
        # letters come first, if no letter follows another character
        back = np.zeros(len(body) + 1, np.int64)
        if len(body) > 1:
            np.cumsum((kind[1:] == 1) & (kind[:-1] != 1), out=back[2:])
        first = np.minimum(start + 1, len(body))
        letters = letter[ends[1:]] - letter[start]
        plain = (letters > 0) & (odd[ends[1:]] == odd[start]) & (back[ends[1:]] == back[first]) & (np.append(kind, 0)[start] == 1)
        low = body + ((body >= 65) & (body <= 90) | accent & (body <= 0x9E)).astype(np.uint8) * 32
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        rest = easy[size[easy] > letters[easy]]
        one = lambda w: self.merge(w.decode())
        pool, at, many = self.batch.arrays(low, np.concatenate([start[easy], start[rest] + letters[rest]]), np.concatenate([letters[easy], size[rest] - letters[rest]]), one)
        long_way = [np.frombuffer(b, "<u4") for b in self.encode_chunks(chunks.take(pa.array(hard)).to_pylist())]
        # pieces of chunks, in the order of the chunks: letters, then marks; or what the long way gave
        owner = np.concatenate([easy, rest, hard])
        pool = np.concatenate([pool, *long_way])
        extra = np.array([len(x) for x in long_way], np.int64)
        at = np.concatenate([at, len(pool) - extra.sum() + np.cumsum(extra) - extra]) if len(hard) else at
        many = np.concatenate([many, extra])
        order = np.argsort(owner, kind="stable")
        at, many, owner = at[order], many[order], owner[order]
        total = np.cumsum(many)
        flat = pool[np.repeat(at - (total - many), many) + np.arange(total[-1] if len(total) else 0)]
        each = np.bincount(owner, many, n).astype(np.int64)
        return flat, np.cumsum(each) - each, each

    def token_strings(self) -> list[str]:
        """The string of every id."""
        out = [""] * (max(self.ids.values()) + 1)
        for s, i in self.ids.items():
            out[i] = s
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Recent:
    """A memo of bounded size: when the newer half is full, the older half is forgotten."""

    def __init__(self, limit: int = 600_000):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        if (v := self.new.get(key)) is None and (v := self.old.get(key)) is not None:
            self.put(key, v)
        return v

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit // 2:
            self.old, self.new = self.new, {}
        self.new[key] = value


def distinct(words: pa.StringArray) -> tuple[np.ndarray, list[str]]:
    """Codes of the words and the distinct words they stand for."""
    if not len(words):
        return np.empty(0, np.int64), []
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()
