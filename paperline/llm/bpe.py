"""BPE encoding and decoding with forced boundaries.

A merge makes a token of the vocabulary, so a byte pair that occurs inside no token can never be bridged by one. The vocabulary
gives the table of the pairs that do occur (some two thousand of 65,536); a text is cut between the two bytes of all others.
First come the cuts that need no pre-tokenizer: before a blank that follows a non-blank, and before a stop that follows a letter,
where the pre-tokenizers here end a word too (unless the table has such a pair). Each distinct fragment is then split into
pre-tokens and these are cut at every pair that the table lacks; the pieces are merged by rank, each by itself, and their ids
concatenated. Of a pre-token the last piece carries the mark of a word's end. Workers remember fragments and pieces within a
bounded number of characters.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fields, mapped

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Characters of fragments, and pieces, that a worker remembers before it starts anew; longer fragments are not remembered.
REMEMBERED_CHARS, REMEMBERED_PIECES, LONGEST = 6_000_000, 200_000, 200
#: Symbols from which a piece is merged by a heap.
MANY = 48


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def inside_pairs(tokens: list[bytes]) -> np.ndarray:
    """A 256 x 256 table: true where the byte pair occurs inside some token."""
    table = np.zeros((256, 256), bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8)
        table[b[:-1], b[1:]] = True
    return table


#: ASCII punctuation, before which a letter's word ends for every pre-tokenizer here; and the letters of Latin-1.
STOPS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Blanks and the word after them (up to its first stop, if it is of letters), or the blanks at the end.
WORD = re.compile(f"[{BLANKS}]*(?:[{LETTERS}]++(?=[{re.escape(STOPS)}])|[^{BLANKS}]+)|[{BLANKS}]+")
ASTRAL = "\U00010000-\U0010ffff"


def last_byte(text: str) -> int:
    """The last byte of a text's UTF-8 form."""
    c = ord(text[-1])
    return c if c < 128 else 128 | c & 63


class Memory(dict):
    """Fragments with their ids; an unknown one is learnt when it is asked for, and remembered if it is not long."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        super().__init__()
        self.learn, self.chars = learn, 0

    def __missing__(self, fragment: str) -> bytes:
        ids = self.learn(fragment)
        if len(fragment) <= LONGEST:
            self[fragment] = ids
            self.chars += len(fragment)
        return ids

    def trim(self) -> None:
        if self.chars > REMEMBERED_CHARS:
            self.clear()
            self.chars = 0


#: A pair of ids as one number, and the rank of a pair without a merge.
PAIR, NO_RANK = 1 << 20, 1 << 40


def merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """``symbols`` after all merges: always the pair of the lowest rank, the leftmost of equals.

    ``ranks``: first * PAIR + second -> rank; ``made``: the id that the merge of a rank makes.
    """
    if len(symbols) > MANY:
        return _merged_by_heap(symbols, ranks, made)
    get = ranks.get
    at = [get(a * PAIR + b, NO_RANK) for a, b in zip(symbols, symbols[1:], strict=False)]
    while at and (best := min(at)) != NO_RANK:
        i = at.index(best)
        symbols[i] = made[best]
        del symbols[i + 1], at[i]
        if i:
            at[i - 1] = get(symbols[i - 1] * PAIR + symbols[i], NO_RANK)
        if i < len(at):
            at[i] = get(symbols[i] * PAIR + symbols[i + 1], NO_RANK)
    return symbols


def _merged_by_heap(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The same in n log n steps: ``after`` and ``before`` chain the symbols left; an entry whose pair has changed is stale."""
    n, gone, get = len(symbols), -1, ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := get(symbols[i] * PAIR + symbols[i + 1], NO_RANK)) != NO_RANK]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        k = after[i]
        if k >= n or symbols[i] == gone or get(symbols[i] * PAIR + symbols[k], NO_RANK) != rank:
            continue
        symbols[i], symbols[k], after[i] = made[rank], gone, after[k]
        if after[k] < n:
            before[after[k]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (r := get(symbols[left] * PAIR + symbols[after[left]], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, left))
    return [x for x in symbols if x != gone]


class Codec:
    """A tokenizers file with its table of pairs. One for each worker and path."""

    _open: dict[tuple[str, bool], Codec] = {}

    def __init__(self, path: str, by_library: bool = False) -> None:
        """``by_library``: merge plain words by a library's ranks, if the file allows it, which is several times faster."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        alphabet, suffix = byte_alphabet(), spec["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.tokens[i] = token
        plain = [t.removesuffix(suffix) if suffix else t for t in self.tokenizer.get_vocab(with_added_tokens=False)]
        self.inside = inside_pairs([bytes(alphabet[c] for c in t) for t in plain if all(c in alphabet for c in t)])
        #: For each blank or stop, the bytes before it of the pairs that do occur inside a token: no cut between those.
        word_ends = [b for b in range(256) if chr(b) not in BLANKS]
        letter_ends = [b for b in range(256) if chr(b).isascii() and chr(b).isalpha() or 128 <= b < 192]
        pairs = {c: {b for b in ends if self.inside[b, ord(c)]} for chars, ends in ((BLANKS, word_ends), (STOPS, letter_ends)) for c in chars}
        self.bridged = {c: before for c, before in pairs.items() if before}
        #: Finds a place where such a pair may be; beyond the BMP any character before a blank is looked at.
        ends = set().union(*self.bridged.values())
        chars = "".join(re.escape(chr(c)) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and (c if c < 128 else 128 | c & 63) in ends)
        self.maybe_bridged = re.compile(f"[{chars}{ASTRAL}][{re.escape(''.join(self.bridged))}]") if self.bridged else None
        decoder = (spec.get("decoder") or {}).get("type")
        self.spell = {None: self._spaced, "ByteLevel": self._bytes}.get(decoder, lambda ids: self.tokenizer.decode(list(ids), skip_special_tokens=False))
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.raw = [added.get(i) or bytes(alphabet[c] for c in t if c in alphabet) for i, t in enumerate(self.tokens)] if decoder == "ByteLevel" else []
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.shown, self.alphabet = {b: c for c, b in alphabet.items()}, alphabet
        model = spec["model"]
        plainly = not model.get("continuing_subword_prefix") and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("dropout")
        if not plainly or any(c not in model["vocab"] or suffix and c + suffix not in model["vocab"] for c in alphabet):
            raise ValueError("a byte-level BPE file without prefixes, byte fallback or whole-word look-ups is asked for")
        of = model["vocab"]
        self.first = [of[self.shown[b]] for b in range(256)]
        self.last = [of[self.shown[b] + suffix] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = [(of[a] * PAIR + of[b], of[a + b]) for a, b in pairs]
        self.ranks, self.made = {key: rank for rank, (key, _) in enumerate(pairs)}, [made for _, made in pairs]
        self.joined = {(int(a), int(b)) for a, b in np.argwhere(self.inside)}
        self.pieces: dict[tuple[bytes, bool], list[int]] = {}
        #: How a fragment of one blank at most and letters becomes one pre-token, for the two pre-tokenizers known here.
        steps = json.dumps([spec.get("normalizer"), spec["pre_tokenizer"]])
        self.word = None
        if spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            self.word = str.encode
        elif '"Lowercase"' in steps and '"behavior": "Removed", "invert": true' in steps and r"[\\p{L}]+" in steps:
            self.word = lambda f: f.removeprefix(" ").lower().encode()
        self.library = self._ranked(model, alphabet) if by_library and self.word is str.encode else None
        self.memory = Memory(self.learn)

    @classmethod
    def of(cls, path: str, by_library: bool = False) -> Codec:
        if (path, by_library) not in cls._open:
            cls._open[path, by_library] = cls(path, by_library)
        return cls._open[path, by_library]

    @staticmethod
    def _ranked(model: dict, alphabet: dict[str, int]) -> Callable[[str], list[int]] | None:
        """A library's encoder of whole pre-tokens, if the ids are in the order of the merges."""
        vocabulary = model["vocab"]
        found = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
        if sorted(vocabulary.values()) != list(range(256 + len(found))) or found != list(range(256, 256 + len(found))):
            return None
        import tiktoken

        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("whole pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def fragments(self, text: str) -> list[str]:
        """A text cut before each blank after a non-blank and each stop after a letter, unless the two bytes there occur
        inside some token."""
        found = WORD.findall(text)
        if not self.maybe_bridged or not self.maybe_bridged.search(text):
            return found
        joined: list[str] = []
        for f in found:
            if joined and (bridged := self.bridged.get(f[0])) and last_byte(joined[-1]) in bridged:
                joined[-1] += f
            else:
                joined.append(f)
        return joined

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        self.memory.trim()
        return b"".join(map(self.memory.__getitem__, self.fragments(text or "")))

    def learn(self, fragment: str) -> bytes:
        """The ids of one fragment. A word of Latin-1 letters is one pre-token; others are split by the file's pre-tokenizer."""
        word = fragment.removeprefix(" ")
        if self.word and word.isalpha() and max(word) < "\u0100":
            ids = self.library(fragment) if self.library else self.forced(self.word(fragment))
        elif any(s in fragment for s in self.specials):
            ids = self.tokenizer.encode(fragment, add_special_tokens=False).ids
        else:
            normal = self.tokenizer.normalizer.normalize_str(fragment) if self.tokenizer.normalizer else fragment
            ids = []
            for pretoken, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                ids += self.forced(bytes(map(self.alphabet.__getitem__, pretoken)))
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def cuts(self, pretoken: bytes) -> list[int]:
        """The places in a pre-token, 0 and its length included, where the two bytes are inside no token."""
        b = np.frombuffer(pretoken, np.uint8)
        return [0, *(np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist(), len(b)]

    def forced(self, pretoken: bytes) -> list[int]:
        """The ids of a pre-token: its pieces between forced boundaries, each merged by itself."""
        if self.joined.issuperset(zip(pretoken, pretoken[1:], strict=False)):
            return self.piece(pretoken, True)
        at, ids = self.cuts(pretoken), []
        for a, b in zip(at, at[1:], strict=False):
            ids += self.piece(pretoken[a:b], b == len(pretoken))
        return ids

    def piece(self, piece: bytes, last: bool) -> list[int]:
        known = self.pieces.get((piece, last))
        if known is None:
            symbols = [self.first[b] for b in piece]
            if last and piece:
                symbols[-1] = self.last[piece[-1]]
            known = merged(symbols, self.ranks, self.made)
            if len(piece) <= LONGEST:
                if len(self.pieces) >= REMEMBERED_PIECES:
                    self.pieces.clear()
                self.pieces[piece, last] = known
        return known

    def decode(self, ids: bytes) -> str:
        return self.spell(np.frombuffer(ids, "<u4").tolist())

    def _spaced(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def _bytes(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ``ids`` (array<int>) and ``decoded`` (their text), a row for each row of ``docs``.

    Null and empty texts have no id and decode to the empty text. Very long texts, without any blank too, take time in proportion
    (n log n within one piece). Repeated rows and null doc_ids come back as they are. Other columns are neither read nor
    returned. An empty table gives an empty result.
    """

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.of(path)
        ids = [codec.encode(t) for t in part["text"].to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        columns = [part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), values), pa.array(map(codec.decode, ids), pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return mapped(docs.select("doc_id", "text"), f"{fields(docs, 'doc_id')}, ids array<int>, decoded string", of)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``encoded`` with n_tokens and the SHA-256 of ids and decoded text in place of them; nulls and odd rows as there."""
    return encoded(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
