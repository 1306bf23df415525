"""A walk over raw Deflate that looks for one thing zlib lets pass: length 258 in its long form.

Symbol 284 with all five extra bits set means 258 as well, which has symbol 285 of its
own. The walk follows the bit stream only as far as symbols go and copies nothing.
"""

from __future__ import annotations

# Extra bits by symbol, and the order of the code length codes.
LENGTH_BITS = (0,) * 8 + (1,) * 4 + (2,) * 4 + (3,) * 4 + (4,) * 4 + (5,) * 4 + (0,)
DISTANCE_BITS = (0, 0, 0, 0, *(b for b in range(1, 14) for _ in range(2)))
CODE_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


_ANY = 2**15 - 1


def _table(lengths: list[int]) -> list[int]:
    """For any 15 bits that may follow: 16 times the symbol they begin with, plus its code's length; 0 for none."""
    table, code = [0] * (_ANY + 1), 0
    for n in range(1, 16):
        for symbol, length in enumerate(lengths):
            if length == n:
                table[int(format(code, f"0{n}b")[::-1], 2) :: 1 << n] = [symbol << 4 | n] * (1 << (15 - n))
                code += 1
        code <<= 1
    return table


FIXED = _table([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _table([5] * 30)


class _Walk:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.left = data, 0, 8 * len(data)

    def window(self) -> int:
        """The next bits, 57 at least where there are so many."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        out = self.window() & ((1 << n) - 1)
        self.at += n
        if self.at > self.left:
            raise EOFError
        return out

    def symbol(self, table: list[int]) -> int:
        entry = table[self.window() & _ANY]
        if not entry:
            raise ValueError("no such code")
        self.take(entry & 15)
        return entry >> 4

    def tables(self) -> tuple[list[int], list[int]]:
        literals, distances, given = self.take(5) + 257, self.take(5) + 1, self.take(4) + 4
        lengths = [0] * 19
        for place in CODE_ORDER[:given]:
            lengths[place] = self.take(3)
        codes, found = _table(lengths), []
        while len(found) < literals + distances:
            s = self.symbol(codes)
            if s < 16:
                found.append(s)
            elif s == 16:
                found += found[-1:] * (3 + self.take(2))
            else:
                found += [0] * (3 + self.take(3) if s == 17 else 11 + self.take(7))
        return _table(found[:literals]), _table(found[literals:])

    def block(self, literals: list[int], distances: list[int]) -> bool:
        """Go to the end of a block; whether the long form came up."""
        data, at, left = self.data, self.at, self.left
        while at < left:
            window = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)
            entry = literals[window & _ANY]
            used, symbol = entry & 15, entry >> 4
            if not used:
                raise ValueError("no such code")
            at += used
            if symbol < 256:
                continue
            if symbol == 256:
                self.at = at
                return False
            # A length's code, its extra bits, and a distance's code and extra bits are 48 bits at most.
            window >>= used
            if symbol == 284 and window & 31 == 31:
                return True
            extra = LENGTH_BITS[symbol - 257]
            entry = distances[window >> extra & _ANY]
            if not entry:
                raise ValueError("no such code")
            at += extra + (entry & 15) + DISTANCE_BITS[entry >> 4]
        raise EOFError


def may_hold_258(out: bytes) -> bool:
    """Whether any 258 bytes of what a stream gave may be a copy; if not, there is no need to walk.

    Such a copy holds 16 bytes that begin at a multiple of 243, and these are in the 32 KiB before.
    """
    return any(out.find(out[at : at + 16], max(0, at - 2**15), at + 15) >= 0 for at in range(0, len(out) - 15, 243))


def long_form_258(data: bytes) -> bool:
    """Whether a valid raw stream holds length 258 in its long form."""
    walk, end = _Walk(data), False
    while not end:
        end, kind = bool(walk.take(1)), walk.take(2)
        if kind == 0:
            walk.at = -(-walk.at // 8) * 8
            size = walk.take(16)
            walk.at += 16 + 8 * size
        elif walk.block(*(FIXED if kind == 1 else walk.tables())):
            return True
    return False
