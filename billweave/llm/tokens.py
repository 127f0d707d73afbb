"""Public byte-level tokenizers inside Python workers; loaded once per worker process.

The vocabulary file's path is a parameter everywhere; nothing is copied or trained. Texts are
encoded without special tokens. A run that the tokenizer's pattern does not split (a *piece*)
longer than ``LEAF_BYTES`` is encoded by tree concatenation: both halves on their own, then a
window around the join is encoded again and grown until its first and last token equal the
tokens they replace. Every pair of neighbouring tokens then is one the tokenizer itself would
produce, which makes the whole sequence the piece's own encoding.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

#: The pattern by which the byte-level vocabularies split a text (fixed value).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_BYTES = 4096
FIRST_WINDOW = 4


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary file lies."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


class Encoder:
    """One vocabulary: whole texts, single pieces, and the tree form for long pieces."""

    def __init__(self, path: str, leaf_bytes: int = LEAF_BYTES) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._plain = tiktoken.Encoding("text", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile(SPLIT_PATTERN)
        self._unsplit = regex.compile(r"[^\s]{%d}|\s{%d}" % (leaf_bytes, leaf_bytes))
        self.leaf_bytes = leaf_bytes
        self.bytes_of = {i: b for b, i in ranks.items()}

    def piece(self, raw: bytes) -> list[int]:
        """One unsplit piece, directly."""
        return self._plain._encode_single_piece(raw)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches of one piece, from their encodings."""
        if not left or not right:
            return left + right
        k = FIRST_WINDOW
        while True:
            a, b = left[-k:], right[:k]
            window = self.piece(b"".join(self.bytes_of[i] for i in a + b))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Join neighbouring stretches of one piece pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def leaves(self, raw: bytes) -> list[bytes]:
        """A long piece in stretches of at most ``leaf_bytes``, halved until they fit."""
        if len(raw) <= self.leaf_bytes:
            return [raw]
        half = len(raw) // 2
        return self.leaves(raw[:half]) + self.leaves(raw[half:])

    def tree(self, raw: bytes) -> list[int]:
        """One piece of any length, by tree concatenation."""
        return self.join_all([self.piece(x) for x in self.leaves(raw)])

    def stretches(self, text: str, size: int) -> Iterator[tuple[int, bytes]]:
        """Cut a text where the split pattern cuts it anyway: (kind, bytes) in order.

        Kind 0 is ordinary text, 1 the first stretch of a piece, 2 a later stretch of the same
        piece. Ordinary text ends on a character that is no white space, so that the pattern's
        look-ahead sees the same in the stretch as in the whole.
        """
        start = safe = 0
        loose: list[str] = []
        for m in self._split.finditer(text):
            a, b = m.span()
            if b - a > self.leaf_bytes:
                if safe > start:
                    yield 0, text[start:safe].encode("utf-8", "surrogatepass")
                yield from ((1, x.encode("utf-8", "surrogatepass")) for x in loose)
                for i, x in enumerate(self.leaves(text[a:b].encode("utf-8", "surrogatepass"))):
                    yield 1 + (i > 0), x
                start = safe = b
                loose = []
            elif text[b - 1].isspace():
                loose.append(text[a:b])
            else:
                safe, loose = b, []
                if safe - start >= size:
                    yield 0, text[start:safe].encode("utf-8", "surrogatepass")
                    start = safe
        if safe > start:
            yield 0, text[start:safe].encode("utf-8", "surrogatepass")
        yield from ((1, x.encode("utf-8", "surrogatepass")) for x in loose)

    def stretch(self, kind: int, raw: bytes) -> list[int]:
        """The ids of one stretch."""
        return self._plain.encode_ordinary(raw.decode("utf-8")) if kind == 0 else self.piece(raw)

    def assemble(self, kinds: list[int], parts: list[list[int]]) -> list[int]:
        """The ids of a text from those of its stretches, in order."""
        out: list[int] = []
        piece: list[list[int]] = []
        for kind, part in zip(kinds, parts):
            if kind != 2 and piece:
                out += self.join_all(piece)
                piece = []
            if kind == 0:
                out += part
            else:
                piece.append(part)
        return out + self.join_all(piece)

    def text(self, text: str | None) -> list[int]:
        """A whole text; null and empty texts have no ids."""
        if not text:
            return []
        if len(text) > self.leaf_bytes and self._unsplit.search(text):
            cut = list(self.stretches(text, 1 << 62))
            return self.assemble([k for k, _ in cut], [self.stretch(k, x) for k, x in cut])
        return self._plain.encode_ordinary(text)


@lru_cache(maxsize=4)
def encoder(path: str, leaf_bytes: int = LEAF_BYTES) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path, leaf_bytes)
