"""Burrows-Wheeler transforms of string collections and their merging by iterative interleave refinement.

The merge follows Holt and McMillan: start from any interleave of the shards' transforms and apply, again and again,
one stable bucket pass by the transform's symbols.  After h symbols the interleave is right for the first h symbols of
all suffixes, and the passes show where neighbours part, so common prefixes come for free (Egidi and Manzini).  No
suffix is sorted a second time.  A pass takes two symbols at once, and only suffixes that are long enough go on.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """The transform of some strings: suffixes in the order of their first ``depth`` symbols at least (a Burrows-Wheeler
    transform of limited depth), each with its place and the symbol before it.  Symbol 0 ends a string; ends are ordered
    as the strings are."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, depth: int):
        """``text``: symbols, bytes as 1 to 256 and 0 at each end; ``ends``: the places of the 0s, in order."""
        n = len(text)
        # seven symbols to a key; what follows a string's end counts as 0, and suffixes that end within the key are
        # told apart by their place, which is the order of the strings
        left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
        padded = np.zeros(n + FIRST, np.int64)
        padded[:n] = text
        key = np.zeros(n, np.int64)
        for i in range(FIRST):
            key <<= 9
            key |= np.where(left >= i, padded[i : i + n], 0)
        self.places, rank, width = *_ranks(key, left < FIRST), FIRST
        while width < depth and rank[self.places[-1]] < n - 1:
            # three ranks of at most 21 bits to a key: 7, 21, 63, 189 symbols
            key = rank << 42
            key[:-width] |= (rank[width:] + 1) << 21
            if 2 * width < n:
                key[: -2 * width] |= rank[2 * width :] + 1
            self.places, rank = _ranks(key)
            width *= 3
        starts = np.concatenate(([0], ends[:-1] + 1))
        before = np.concatenate((text[-1:], text[:-1]))
        before[starts] = 0
        self.before = before[self.places]


def _ranks(keys: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and their ranks; those that are ``apart`` share none."""
    order = np.argsort(keys, kind=None if apart is None else "stable")
    ordered = keys[order]
    new = ordered[1:] != ordered[:-1]
    if apart is not None:
        new |= apart[order][1:]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(new)))
    return order, rank


#: Symbols of 9 bits in a first key.
FIRST = 7
#: Places that one shard may have: ranks take 21 bits.
MOST = (1 << 21) - 2


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards in the order of the first ``depth`` symbols.

    Returns (row, number of its interval), in order, of all suffixes of at least ``depth`` symbols; rows count through
    the shards.  The suffixes of one interval share their first ``depth`` symbols."""
    starts = np.concatenate(([0], np.cumsum([len(s.places) for s in shards])))
    total = int(starts[-1])
    one = np.concatenate([s.before for s in shards]).astype(np.uint16)
    # last to first: the row of its shard to which a row's symbol leads; a string's first row leads nowhere
    leads = np.zeros(total, np.int64)
    for k, s in enumerate(shards):
        row_of = np.empty(len(s.places), np.int64)
        row_of[s.places] = np.arange(starts[k], starts[k + 1])
        leads[starts[k] : starts[k + 1]] = row_of[s.places - 1]
    # two symbols and two steps at once, with numbers for the symbols that occur, so that pairs take 16 bits
    symbols = np.unique(one[one > 0])
    number = np.zeros(258, np.uint16)
    number[symbols] = np.arange(1, len(symbols) + 1)
    wide = len(symbols) + 1
    short = number[one]
    second = short[leads]
    pairs = np.where((short > 0) & (second > 0), second * np.uint16(wide) + short, np.uint16(0)) if wide <= 255 else None
    twice = leads[leads]
    row, interval, h = np.arange(total), np.zeros(total, np.int32), 0
    while h < depth and len(row):
        double = pairs is not None and depth - h >= 2
        keys = (pairs if double else short)[row]
        order = np.argsort(keys, kind="stable")
        order = order[np.count_nonzero(keys == 0) :]  # what has no symbol before it ends here
        keys, interval = keys[order], interval[order]
        row = (twice if double else leads)[row[order]]
        interval = np.cumsum(np.concatenate(([False], (keys[1:] != keys[:-1]) | (interval[1:] != interval[:-1]))), dtype=np.int32) if len(row) else interval
        h += 2 if double else 1
    return row, interval


def repeated(strings: list[bytes], owners: np.ndarray, length: int, shards: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every ``length`` bytes that also lie in a string of a smaller owner.

    Equal strings have equal suffixes: they are in the transforms once, and each has its own owner when the intervals
    are read."""
    known: dict[bytes, int] = {}
    same = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))
    firsts = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(firsts, same, owners)
    of, offset, least = _least(list(known), firsts, length, shards)
    if not len(of):
        return of, offset
    # rows by string, then once for each string that is equal
    order = np.argsort(of, kind="stable")
    offset, least = offset[order], least[order]
    n = np.bincount(of, minlength=len(known))
    begin, count = (np.cumsum(n) - n)[same], n[same]
    which = np.repeat(np.arange(len(strings)), count)
    at = np.arange(len(which)) + np.repeat(begin - (np.cumsum(count) - count), count)
    hit = owners[which] > least[at]
    return which[hit], offset[at[hit]]


def _least(strings: list[bytes], owners: np.ndarray, length: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, smallest owner of its interval) of every ``length`` bytes of different strings."""
    none = np.zeros(0, np.int64)
    size = max(1, -(-sum(map(len, strings)) // shards))
    parts, starts, places, base, i = [], [], [], 0, 0
    while i < len(strings):
        first, bytes_in = i, 0
        while i < len(strings) and (i == first or bytes_in + len(strings[i]) + 1 <= min(size, MOST)):
            bytes_in += len(strings[i]) + 1
            i += 1
        if bytes_in > MOST:
            raise ValueError(f"a string of over {MOST} bytes: cut it into pieces that overlap")
        ends = np.cumsum(np.array([len(s) for s in strings[first:i]]) + 1) - 1
        text = np.frombuffer(b"\0".join([*strings[first:i], b""]), np.uint8).astype(np.int16) + 1
        text[ends] = 0
        parts.append(Shard(text, ends, length))
        places.append(parts[-1].places + base)
        starts.append(np.concatenate(([0], ends[:-1] + 1)) + base)
        base += len(text)
    row, interval = merge(parts, length) if parts else (none, none)
    if not len(row):
        return none, none, none
    place, starts = np.concatenate(places)[row], np.concatenate(starts)
    of = np.searchsorted(starts, place, "right") - 1
    least = np.minimum.reduceat(owners[of], np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1]))))
    return of, place - starts[of], least[interval]
