"""Pre-tokens and exact token ids of whole texts.

A byte-level vocabulary never merges across its pre-tokenizer's cuts, so the ids of a text are
the ids of its pre-tokens, one after another. The cuts used here are coarser where that is safe:
a single space between two other characters always starts a piece, and a single line break
between two other characters is always a piece. A text with neighbouring white space takes the
vocabulary's own pattern instead. Strings of special tokens are cut out first, as the library does.
"""

from __future__ import annotations

import re

import numpy as np

# Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary. `\s` stands for the
# Unicode property, which leaves out the control characters that Python's `\s` takes in.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Any white space next to a space or a line break, or at the end of the text; also what only
# one of the two definitions of white space holds.
UNSAFE = re.compile(r"[ \n][\s\x85]|[\s\x85][ \n]|^[ \n]|[ \n]$|[\t\v\f\r\x1c-\x1f\x85]")


class Vocabulary:
    """A tokenizer file in a worker."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fine = regex.compile(PATTERN).findall
        self.ranked = None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text that holds no special token; joined they give the text."""
        if not text:
            return []
        if UNSAFE.search(text):
            return self.fine(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else self.fine(text)

    def parts(self, text: str) -> list[tuple[str | None, list[str]]]:
        """(special string or None, pre-tokens) in the order of the text."""
        if self.cuts is None or not any(s in text for s in self.special):
            return [(None, self.pieces(text))]
        return [(p, []) if p in self.special else (None, self.pieces(p)) for p in self.cuts.split(text)]

    def fresh(self, pieces: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in encoded]

    def ranks(self) -> dict[bytes, int]:
        """The vocabulary as byte strings. The file writes each byte as a printable character:
        printable Latin-1 stands for itself, the others follow from U+0100 upwards."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        return {bytes(byte[c] for c in name): i for name, i in names.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, equal to the tokenizer's own (see the tests).

        Merging by rank over the same vocabulary takes a fraction of the time and makes no object
        for each token.
        """
        if self.ranked is None:
            import tiktoken

            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=self.ranks(), special_tokens={})
        out = []
        for text in texts:
            parts = [text or ""]
            if self.cuts is not None and any(s in parts[0] for s in self.special):
                parts = self.cuts.split(text)
            out.append(b"".join(
                np.array([self.special[p]], "<u4").tobytes() if p in self.special
                else np.array(self.ranked.encode_ordinary(p), "<u4").tobytes()
                for p in parts
            ))
        return out


def vocabulary(path: str) -> Vocabulary:
    """One per worker and file: workers are reused, and reading the file takes a while."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_vocabularies", {})
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


def slices(texts: list, most: int = 4_000_000):
    """(start, end) of runs of texts with at most `most` characters, a longer one alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
