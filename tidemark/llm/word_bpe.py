"""Word-end byte-pair vocabularies: reading them, splitting texts, merging symbols.

Serves the encoder (:mod:`.bpe_codec`) and the counter (:mod:`.token_counts`).
The vocabulary file is a parameter; it is read where it is used and never copied.
A file of another make than the word-end kind described below is refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

#: Bits that an id takes in a packed pair.
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1

#: The split pattern that vocabularies of this kind declare (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts whose characters all lie below this need no composition and a plain pattern splits them.
_PLAIN_BELOW = 0x250
_plain_text = re.compile(f"[\\x00-{chr(_PLAIN_BELOW - 1)}]*").fullmatch


def _of_category(first: str) -> str:
    chars = (chr(i) for i in range(_PLAIN_BELOW))
    return "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == first)


#: White space as the vocabulary's own pattern language has it; Python's class adds U+001C to U+001F.
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0"
_plain_piece = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[{l}]+|[{n}]|[^{s}{l}{n}]+".format(
        l=_of_category("L"), n=_of_category("N"), s=_SPACE
    )
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in kept}
    spare = (chr(0x100 + i) for i in range(256))
    return [symbols[b] if b in symbols else next(spare) for b in range(256)]


class _Shadow(dict):
    """Character to a plain one of the same class, as the library's own splitter sees it.

    Unicode versions differ between libraries, so the class of a character
    outside the plain range is asked of the vocabulary's splitter, once each.
    """

    def __init__(self, tokenizer):
        super().__init__((i, i) for i in range(_PLAIN_BELOW))
        split = tokenizer.pre_tokenizer.pre_tokenize_str
        self._count = lambda x: len(split(x))

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if not self._count(c):
            kind = " "
        elif self._count(c + c) == 2:
            kind = "1"
        else:
            kind = "\u00e9" if self._count("a" + c) == 1 else "#"
        self[code] = kind
        return kind


class WordBpe:
    """A vocabulary with its merge ranks and the ids of its base symbols.

    ``inner[b]`` and ``final[b]`` are the ids of byte b within and at the end of
    a piece; ``merges[a << ID_BITS | b]`` is ``rank << ID_BITS | id of the merged symbol``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        splits = [
            x["pattern"].get("Regex")
            for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
            if x["type"] == "Split"
        ]
        if model["type"] != "BPE" or not end or splits != [PIECES] or spec.get("decoder"):
            raise ValueError(f"{path} is not a word-end byte-pair vocabulary")
        vocab = model["vocab"]
        self.names = {i: s for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        self.inner = [vocab[s] for s in byte_symbols()]
        self.final = [vocab[s + end] for s in byte_symbols()]
        #: Base symbol at the end of a piece to the same within one.
        self.unended = dict(zip(self.final, self.inner))
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merged = a + b
            self.merges[vocab[a] << ID_BITS | vocab[b]] = rank << ID_BITS | vocab[merged]
        tokenizer = Tokenizer.from_file(path)
        self._normalise, self._shadow = tokenizer.normalizer.normalize_str, _Shadow(tokenizer)
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special_cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")

    def symbols(self, piece: str) -> list[int]:
        """Ids of the base symbols of one piece, the last one marked as its end."""
        raw = piece.encode("utf-8", "surrogatepass")
        inner = self.inner
        out = [inner[b] for b in raw]
        out[-1] = self.final[raw[-1]]
        return out

    def parts(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn, ordinary text first."""
        return self._special_cut.split(text) if "<|" in text or not self._quick else [text]

    def segments(self, text: str):
        """``(pieces, None)`` for ordinary text, ``(None, string)`` for a special string, in order."""
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                yield None, part
            elif part:
                yield split(*self.prepared(part)), None

    @cached_property
    def _quick(self) -> bool:
        """Whether every special string holds the mark that segments() looks for first."""
        return all("<|" in s for s in self.special)

    def prepared(self, text: str) -> tuple[str, str]:
        """A text without special strings, normalised, and the string of plain characters that it is split by."""
        if _plain_text(text):
            # Lower case may leave the plain range (U+0130 gives a combining dot).
            low = text.lower()
            if low.isascii() or _plain_text(low):
                return low, low
        real = self._normalise(text)
        return real, self.shadow(real)

    def shadow(self, real: str) -> str:
        """The string that a normalised text is split by; the text itself where all of it is plain."""
        return real if _plain_text(real) else real.translate(self._shadow)


def split(real: str, shadow: str) -> list[str]:
    """The pieces of a prepared text."""
    if shadow is real:
        return _plain_piece.findall(real)
    return [real[m.start() : m.end()] for m in _plain_piece.finditer(shadow)]


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """The vocabulary at path, read once in each Python worker."""
    return WordBpe(path)


class MergeList:
    """Heap-and-linked-list byte-pair merging over one run of symbols.

    The heap holds adjacent pairs by (rank, position); popping the lowest merges
    its two symbols, unlinks the right one and offers the two new neighbours.
    An entry is stale when the pair at its position is no longer the one pushed.
    """

    def __init__(self, symbols: list[int], merges: dict[int, int]):
        self.symbols, self.merges = list(symbols), merges

    def run(self) -> int:
        """Merge until no pair has a rank; returns the number of merges."""
        symbols, find = self.symbols, self.merges.get
        n = len(symbols)
        if n < 2:
            return 0
        width = n.bit_length()
        mask = (1 << width) - 1
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = []
        for i, (a, b) in enumerate(zip(symbols, symbols[1:])):
            if (x := find(a << ID_BITS | b)) is not None:
                heap.append(x << width | i)
        heapify(heap)
        merged = 0
        while heap:
            entry = heappop(heap)
            i, x = entry & mask, entry >> width
            j = after[i]
            if j >= n or symbols[i] < 0 or find(symbols[i] << ID_BITS | symbols[j]) != x:
                continue
            merged += 1
            new = x & ID_MASK
            symbols[i], symbols[j] = new, -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (x := find(new << ID_BITS | symbols[k])) is not None:
                    heappush(heap, x << width | i)
            if h >= 0 and (x := find(symbols[h] << ID_BITS | new)) is not None:
                heappush(heap, x << width | h)
        return merged

    def result(self) -> list[int]:
        """The symbols that are left, in order."""
        return [s for s in self.symbols if s >= 0]


#: Runs up to this length are scanned for the lowest rank instead of kept in a heap.
SCAN_SYMBOLS = 24


def encode_symbols(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Ids of one run of symbols by rank-ordered merging."""
    if len(symbols) > SCAN_SYMBOLS:
        run = MergeList(symbols, merges)
        run.run()
        return run.result()
    find, none = merges.get, 1 << 62
    out = list(symbols)
    ranks = [find(a << ID_BITS | b, none) for a, b in zip(out, out[1:])]
    while ranks:
        low = min(ranks)
        if low == none:
            break
        i = ranks.index(low)
        new = out[i] = low & ID_MASK
        del out[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = find(new << ID_BITS | out[i + 1], none)
        if i:
            ranks[i - 1] = find(out[i - 1] << ID_BITS | new, none)
    return out


class Remembered(dict):
    """A value for each piece, made on demand; the pieces of the last two generations are kept."""

    def __init__(self, make, pieces: int = 120_000, chars: int = 48):
        super().__init__()
        self.make, self.pieces, self.chars, self.old = make, pieces, chars, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
            if len(piece) > self.chars:
                return value
        if len(self) >= self.pieces:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value
