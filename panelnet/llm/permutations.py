"""Keyed permutations of the strings of one format, without fixed points.

A string of a format is a number in mixed radix. A Feistel network pi over these numbers gives the permutation
x -> pi^-1(pi(x) + 1): one cycle through all strings, so a string never stands for itself. Where an image has to
keep a trait of the string, the walk goes on along the cycle to the next number with the trait, which is again one
cycle, through those that have it.
"""

from __future__ import annotations

import hashlib
import hmac
import math
from collections.abc import Callable, Sequence

ROUNDS = 6
#: Letters of one number; longer strings are permuted piece by piece, so work grows in proportion to the length.
PIECE = 96

Place = tuple[Sequence[str], int]


def _turned(key: bytes, n: int, x: int, back: bool) -> int:
    """pi, or its inverse, over 0 .. n-1: a Feistel network over the next rectangle, walked until it is below n."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    size, wide = (a.bit_length() + 7) // 8 + 8, (n.bit_length() + 7) // 8 + 1
    salt = n.to_bytes(wide, "big")
    while True:
        left, right = x % a, x // a
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            other = right if r % 2 == 0 else left
            f = int.from_bytes(hashlib.shake_128(key + bytes([r]) + salt + other.to_bytes(wide, "big")).digest(size), "big")
            f = -f if back else f
            if r % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        x = right * a + left
        if x < n:
            return x


def moved(key: bytes, n: int, x: int, fits: Callable[[int], bool] = lambda v: True) -> int:
    """The next number after x on the keyed cycle through 0 .. n-1 that fits; x itself only if nothing else does.

    fits has to hold for x: then the numbers that fit are permuted among themselves.
    """
    if n < 2:
        return x
    while True:
        x = _turned(key, n, (_turned(key, n, x, False) + 1) % n, True)
        if fits(x):
            return x


def low(text: str) -> str:
    """Lower case, letter by letter: a letter whose lower case is longer stays."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def same_format(key: bytes, text: str, alphabet: Callable[[str], Place | None], fits: Callable[[str], bool] = lambda s: True) -> str:
    """The image of text among the strings that differ from it in letters and digits of the same alphabets only.

    alphabet gives a character's alphabet and its place there, None where it stays. Case stays in place. fits is
    asked about each piece and has to hold for the pieces of text.
    """
    out, before = [], b""
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        out.append(_piece(hmac.digest(key, before, "sha256"), piece, alphabet, fits))
        before = piece.encode("utf-8", "surrogatepass")
    return "".join(out)


def _piece(key: bytes, text: str, alphabet: Callable[[str], Place | None], fits: Callable[[str], bool]) -> str:
    places = [alphabet(c) for c in text]
    n, x = 1, 0
    for p in places:
        if p:
            n, x = n * len(p[0]), x * len(p[0]) + p[1]

    def shown(v: int) -> str:
        out = []
        for c, p in zip(reversed(text), reversed(places)):
            if p:
                v, i = divmod(v, len(p[0]))
                new = p[0][i]
                c = new.upper() if c != c.lower() and len(new.upper()) == 1 else new
            out.append(c)
        return "".join(reversed(out))

    shape = "".join(p[0][0] if p else c for c, p in zip(text, places)).encode("utf-8", "surrogatepass")
    return text if n == 1 else shown(moved(hmac.digest(key, shape, "sha256"), n, x, lambda v: fits(shown(v))))
