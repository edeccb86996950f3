"""Encoders for the codecs of `compression`: what the decoders are checked with.

All look for matches in the same way, greedily, by the last place of the next bytes, which numpy finds for all places at once;
what Python does one by one is in proportion to the matches, not to the bytes. They are not made for size.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np


#: Bytes of which places are looked for at a time; a match does not reach back beyond them.
SPAN = 1 << 20
#: Bytes of a block of an image, at most, and the number of blocks whose candidates are kept: an image is packed by one codec after the other.
BLOCK, KEPT = 65536, 4
#: Of tokens (numbers or lengths), the sizes of their heads and the heads' bytes as columns.
Head = Callable[[np.ndarray], tuple[np.ndarray, list[np.ndarray]]]


def _words(data: bytes, kind: str, more: int) -> np.ndarray:
    """The little-endian word that begins at each place, and at `more` places behind the end, where zeros are."""
    width = np.dtype(kind).itemsize
    return np.ndarray(len(data) + more, kind, data + bytes(more + width), strides=(1,))


def _earlier(data: bytes, least: int) -> np.ndarray:
    """Of each place, the last one before it with the same next `least` bytes (3 or 4), or -1: places in the order of those bytes."""
    m = max(0, len(data) - least + 1)
    key = _words(data, "<u4", 0)[:m].astype(np.uint64)
    if least == 3:
        key &= np.uint64(0xFFFFFF)
    key <<= np.uint64(32)
    key |= np.arange(m, dtype=np.uint64)
    key.sort()
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
    key >>= np.uint64(32)
    back = np.full(m, -1, np.int32)
    back[at[1:]] = np.where(key[1:] == key[:-1], at[:-1], -1)
    return back


def _alike(data: bytes, places: np.ndarray, back: np.ndarray, least: int, most: int) -> np.ndarray:
    """How many bytes from each place are those from `back`, `most` at most; the first `least` are. Eight bytes are held against eight at a time."""
    words = _words(data, "<u8", most + 8)
    length, left = np.full(len(places), least, np.int32), slice(None)
    for k in range(least, most, 8):
        other = words[places[left] + k] ^ words[back[left] + k]
        same = np.bitwise_count(~other & (other - np.uint64(1))) >> 3  # zero bits below the lowest one: all 64 of a zero
        length[left] += same
        full = np.flatnonzero(same == 8)
        left = full if isinstance(left, slice) else left[full]
        if not len(left):
            break
    return np.minimum(length, np.minimum(most, len(data) - places))


@functools.lru_cache(KEPT)
def _candidates(data: bytes, least: int, most: int, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places that have a match, the places that they match, and the lengths; of each byte, the number of the first such place at it or behind it."""
    back = _earlier(data, least)
    has = np.zeros(len(data) + 1, bool)
    has[: len(back)] = (back >= 0) & (np.arange(len(back), dtype=np.int32) - back <= far)
    places = np.flatnonzero(has).astype(np.int32)
    number = np.cumsum(has, dtype=np.int32) - has
    back = back[places]
    return places, back, _alike(data, places, back, least, most), number


def _found(data: bytes, least: int, most: int, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, distances and lengths of the matches, one after the other: the next place that has one counts, and then the first behind it."""
    cut = min(most, least + 16)
    of = _candidates if len(data) <= BLOCK else _candidates.__wrapped__
    places, back, lengths, number = of(data, least, cut, min(far, len(data) - least))
    # of each place the number of the next match, or -1 if the match may be longer: a step of the loop is a match
    long = lengths == cut if cut < most else np.zeros(len(places), bool)
    after, m, n, k, taken, longer = memoryview(np.where(long, -1, number[places + lengths])), len(places), len(data), 0, [], {}
    while k < m:
        taken.append(k)
        at, k = k, after[k]
        if k < 0:
            start, distance = int(places[at]), int(places[at] - back[at])
            end, stop = start + cut, min(start + most, n)
            if data[end:stop] == data[end - distance : stop - distance]:
                end = stop
            else:
                while data[end] == data[end - distance]:
                    end += 1
            longer[len(taken) - 1] = end - start
            k = int(number[end])
    taken = np.array(taken, np.int64)
    lengths = lengths[taken].astype(np.int64)
    if longer:
        lengths[list(longer)] = list(longer.values())
    return places[taken].astype(np.int64), (places[taken] - back[taken]).astype(np.int64), lengths


def matches(data: bytes, least: int, most: int, far: int) -> Iterator[tuple[bytes, int, int]]:
    """(literals, distance, length) that give the data one after the other; the last may be literals alone (0, 0)."""
    for whole in _runs(data, SPAN):
        start = 0
        for at, distance, length in zip(*(x.tolist() for x in _found(whole, least, most, far))):
            yield whole[start:at], distance, length
            start = at + length
        if start < len(whole):
            yield whole[start:], 0, 0


def _tokens(data: bytes, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places where tokens begin, literals and matches; whether each is a match; its value if it is a literal."""
    places, _, lengths = found
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, places + 1, 1)
    np.add.at(inside, places + lengths, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    pair = np.zeros(len(data), bool)
    pair[places] = True
    return at, pair[at], np.frombuffer(data, np.uint8)[at]


def _flagged(group: int, high: bool, ones: bool, pair: np.ndarray, sizes: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Tokens of `sizes` bytes, whose bytes are the columns, behind a word of flags for each group: from its high bit or its low one, a last word filled up with ones or zeros."""
    n = len(sizes)
    groups, width = -(-n // group), group // 8
    starts = np.cumsum(sizes) - sizes + (np.arange(n) // group + 1) * width
    out = np.zeros(int(sizes.sum()) + groups * width, np.uint8)
    for k, c in enumerate(columns):
        has = sizes > k
        out[starts[has] + k] = c[has]
    bits = np.full(groups * group, ones)
    bits[:n] = pair
    words = np.packbits(bits.reshape(groups, group), axis=1, bitorder="big" if high else "little")
    heads = starts[::group] - width
    for k in range(width):
        out[heads + k] = words[:, width - 1 - k if high else k]
    return out.tobytes()


def _runs(data: bytes, n: int) -> list[bytes]:
    return [data[k : k + n] for k in range(0, len(data), n)]


def _laid(data: bytes, places: np.ndarray, lengths: np.ndarray, run: int, literal: Head, match: Head) -> bytes:
    """The literals before, between and behind the matches of these places and lengths, in runs of `run` at most, and the matches, each behind (a match: as) its head. A head gives, for the lengths of runs or for the numbers of matches, its size and its bytes as columns."""
    gaps = np.append(places, len(data)) - (starts := np.append(0, places + lengths))
    runs = -(-gaps // run)
    first = np.cumsum(runs) - runs
    gap = np.repeat(np.arange(len(gaps)), runs)
    within = (np.arange(len(gap)) - first[gap]) * run
    literals = np.minimum(run, gaps[gap] - within)
    # a match comes behind the runs of its gap
    is_match = np.zeros(len(gap) + len(places), bool)
    is_match[(first + runs)[:-1] + np.arange(len(places))] = True
    heads, bodies = np.zeros(len(is_match), np.int64), np.zeros(len(is_match), np.int64)
    bodies[~is_match] = literals
    (heads[~is_match], of_runs), (heads[is_match], of_matches) = literal(literals), match(np.arange(len(places)))
    at = np.cumsum(heads + bodies) - heads - bodies
    out = np.zeros(int((heads + bodies).sum()), np.uint8)
    for mine, columns in ((~is_match, of_runs), (is_match, of_matches)):
        for k, c in enumerate(columns):
            has = heads[mine] > k
            out[at[mine][has] + k] = c[has]
    step = np.arange(int(literals.sum())) - np.repeat(np.cumsum(literals) - literals, literals)
    out[np.repeat((at + heads)[~is_match], literals) + step] = np.frombuffer(data, np.uint8)[np.repeat(starts[gap] + within, literals) + step]
    return out.tobytes()


def adc(data: bytes) -> bytes:
    return b"".join(_adc(p) for p in _runs(data, SPAN))


def _adc(data: bytes) -> bytes:
    places, distances, lengths = _found(data, 4, 67, 65536)

    def match(k: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        far, n = distances[k] - 1, lengths[k]
        short = (far < 1024) & (n <= 18)
        return np.where(short, 2, 3), [np.where(short, n - 3 << 2 | far >> 8, 0x40 | n - 4), np.where(short, far & 255, far >> 8), far & 255]

    return _laid(data, places, lengths, 128, lambda n: (np.ones_like(n), [0x7F + n]), match)


def lznt1(data: bytes) -> bytes:
    """Chunks of 4096 bytes, stored where packing does not pay."""
    return lznt1_each([data])[0]


def lznt1_each(texts: list[bytes]) -> list[bytes]:
    """The streams of many texts, whose chunks are laid out together, some BLOCK of bytes at a time."""
    chunks, out = [(k, chunk) for k, text in enumerate(texts) for chunk in _runs(text, 4096)], [[] for _ in texts]
    for first in range(0, len(chunks), BLOCK // 4096):
        some = chunks[first : first + BLOCK // 4096]
        for (k, _), packed in zip(some, _lznt1_chunks([chunk for _, chunk in some])):
            out[k].append(packed)
    return [b"".join(x) for x in out]


def _lznt1_chunks(chunks: list[bytes]) -> Iterator[bytes]:
    data = b"".join(chunks)
    sizes = np.array([len(c) for c in chunks])
    ends = np.cumsum(sizes)
    chunk_of = np.repeat(np.arange(len(chunks)), sizes)
    found = _found_within(data, ends - sizes, ends, chunk_of, 3, 18)
    places, distances, lengths = found
    at, pair, literals = _tokens(data, found)
    within = places - (ends - sizes)[chunk_of[places]]
    split = 16 - np.maximum(4, np.ceil(np.log2(np.maximum(within, 1))).astype(np.int64))  # the distance has the bits of the last place before
    values = literals.astype(np.int64)
    values[pair] = distances - 1 << split | lengths - 3
    # a byte of flags stands before every eighth token of a chunk, a head of two bytes before its first
    firsts = np.searchsorted(at, ends - sizes)
    turn = np.arange(len(at)) - firsts[chunk_of[at]]
    flagged = turn % 8 == 0
    cost = 1 + pair + flagged
    cost[firsts] += 2
    after = np.cumsum(cost)
    token = after - 1 - pair
    body = np.zeros(int(after[-1]), np.uint8)
    body[token] = values & 255
    body[token[pair] + 1] = values[pair] >> 8
    bits = np.zeros((int(flagged.sum()), 8), bool)
    bits[np.cumsum(flagged) - 1, turn % 8] = pair
    body[token[flagged] - 1] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
    body = body.tobytes()
    starts = (after - cost)[firsts].tolist()
    for chunk, start, end in zip(chunks, starts, [*starts[1:], len(body)]):
        n = end - start - 2
        yield struct.pack("<H", n - 1 | 0xB000) + body[start + 2 : end] if n < len(chunk) else struct.pack("<H", len(chunk) - 1 | 0x3000) + chunk


def _found_within(data: bytes, starts: np.ndarray, ends: np.ndarray, chunk_of: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _found, of data in chunks from `starts` to `ends`; matches lie within a chunk. The last earlier place of the same bytes is outside of it only if none is inside."""
    back = _earlier(data, least)
    m = len(back)
    has = np.zeros(len(data) + 1, bool)
    has[:m] = (back >= starts[chunk_of[:m]]) & (np.arange(least, least + m) <= ends[chunk_of[:m]])
    places = np.flatnonzero(has)
    number = np.cumsum(has, dtype=np.int32) - has
    back = back[places]
    lengths = np.minimum(_alike(data, places, back, least, most), ends[chunk_of[places]] - places)
    # matches that follow each other from the first of each chunk on: steps of 1, 2, 4, .. matches, the longest first
    steps = [np.append(number[places + lengths], np.int32(len(places)))]
    for _ in range(1, int(max(ends - starts) // least).bit_length()):
        steps.append(steps[-1][steps[-1]])
    reached = number[starts]
    for step in reversed(steps):
        reached = np.concatenate([reached, step[reached]])
    is_taken = np.zeros(len(places) + 1, bool)
    is_taken[reached] = True
    taken = np.flatnonzero(is_taken[:-1])
    return places[taken], places[taken] - back[taken], lengths[taken]


def lzvn(data: bytes) -> bytes:
    return b"".join(_lzvn(p) for p in _runs(data, SPAN)) + b"\x06" + bytes(7)


def _lzvn(data: bytes) -> bytes:
    places, distances, lengths = _found(data, 4, 281, 65535)

    def literal(n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.where(n > 15, 2, 1), [np.where(n > 15, 0xE0, 0xE0 | n & 15), n - 16]

    def match(k: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        first, far = np.minimum(lengths[k], 10), distances[k]
        rest = lengths[k] - first
        return 3 + (rest > 0) + (rest > 15), [first - 3 << 3 | 7, far & 255, far >> 8, np.where(rest > 15, 0xF0, 0xF0 | rest & 15), rest - 16]

    return _laid(data, places, lengths, 271, literal, match)


def lzfse(data: bytes) -> bytes:
    """A stream of one block of the LZVN kind."""
    raw = lzvn(data)
    return b"bvxn" + struct.pack("<II", len(data), len(raw)) + raw + b"bvx$"


def lzxpress(data: bytes) -> bytes:
    out, parts = b"", [_lzxpress_tokens(p) for p in _runs(data, SPAN)]
    if parts:
        pair, sizes, *columns = (np.concatenate(x) for x in zip(*parts))
        # the lengths of every two long matches share a byte: the second's half lies with the first, and goes from its own place
        long = np.flatnonzero(pair & (sizes > 2))
        first, second = long[: len(long) // 2 * 2 : 2], long[1::2]
        columns[2][first] |= columns[2][second] << 4
        columns[2][second] = columns[3][second]
        sizes[second] -= 1
        out = _flagged(32, True, True, pair, sizes, columns)
    return out


def _lzxpress_tokens(data: bytes) -> tuple[np.ndarray, ...]:
    _, distances, lengths = found = _found(data, 3, 279, 8192)
    _, pair, literals = _tokens(data, found)
    left = lengths - 3
    value = distances - 1 << 3 | np.minimum(left, 7)
    sizes, columns = np.ones(len(pair), np.int64), [literals.astype(np.int64), *(np.zeros(len(pair), np.int64) for _ in range(3))]
    sizes[pair] = 2 + (left >= 7) + (left >= 22)
    for c, v in zip(columns, (value & 255, value >> 8, np.minimum(left - 7, 15), left - 22)):
        c[pair] = v
    return pair, sizes, *columns


def lzxpress_huffman(data: bytes) -> bytes:
    """Blocks of 64 KiB whose 512 symbols have codes of 9 bits each, so a symbol is its own code."""
    out = bytearray()
    for block in _runs(data, 65536):
        out += bytes([0x99]) * 256
        _, distances, lengths = found = _found(block, 3, 3 + 15 + 254, 65535)
        _, pair, literals = _tokens(block, found)
        k, left = np.frexp(distances)[1].astype(np.int64) - 1, lengths - 3
        more, value = np.zeros(len(pair), np.int64), literals.astype(np.int64)
        more[pair] = k
        value[pair] = (256 | k << 4 | np.minimum(left, 15)) << k | distances - (1 << k)
        width = 9 + more
        ends = np.cumsum(width)
        # two words are begun ahead of what is written, so a byte follows the word after the next one of the bits before it
        words = (int(ends[-1]) - 1) // 16 + 2
        bits = np.zeros(16 * words, np.uint8)
        for j in range(int(width.max())):
            has = width > j
            bits[ends[has] - 1 - j] = value[has] >> j & 1
        stream = np.packbits(bits).view(">u2").astype("<u2").tobytes()
        at = 0
        for before, byte in zip((ends - more)[pair][left >= 15].tolist(), (left[left >= 15] - 15).tolist()):
            to = 2 * ((before - 1) // 16 + 2)
            out += stream[at:to]
            out.append(byte)
            at = to
        out += stream[at:]
    return bytes(out)
