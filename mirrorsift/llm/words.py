"""Words of whole texts, in blocks of bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

#: The bytes that separate words: space and \t \n \v \f \r, which are those of bytes.split().
WHITE = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 22


def word_blocks(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Lists of consecutive words; every word once, none cut, each list from about ``block`` bytes."""
    if len(text) <= block:
        yield text.split()
        return
    rest = b""
    for at in range(0, len(text), block):
        piece = rest + text[at : at + block]
        if at + block >= len(text):
            yield piece.split()
            return
        cut = max(piece.rfind(c) for c in (bytes([w]) for w in WHITE))
        if cut < 0:
            rest = piece
            continue
        yield piece[:cut].split()
        rest = piece[cut:]


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
