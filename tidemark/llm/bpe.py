"""Byte-level BPE as a streaming transducer with bounded lookahead.

The encoder reads text in windows, cuts it into pretokens as soon as their end
can no longer move, and feeds each pretoken through :class:`PieceTransducer`,
byte by byte. The ids of a pretoken are remembered in a bounded cache; one that
is longer than a window is handed on as it comes.

The transducer keeps the last token of the encoding of each prefix of the open
end. A sequence of tokens is the BPE encoding of its bytes if and only if each
adjacent pair of tokens encodes to itself, so that last token is unique and
found by looking at the one before. A token is emitted as soon as the bytes read
after it are as many as the merge list's sufficient lookahead, which
:func:`sufficient_lookahead` computes: then no continuation can change it.
What is held is never more than that and the longest token.

:class:`ByteToText` is the decoder: an incremental UTF-8 state machine that
takes ids one at a time and gives back text without buffering the input.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import regex

#: Fixed value: the pretoken pattern of the byte-level BPE family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a pretoken runs on: white space, letters, digits, or other marks.
RUNS = [regex.compile(p) for p in (r"\s+", r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]
#: Code points after a pretoken that can still change where it ends.
TEXT_LOOKAHEAD = 3
#: Code points of text looked at together.
WINDOW = 1 << 16
#: Pretokens kept in the cache; it is emptied when full, so memory is constant.
CACHE = 1 << 18


class Merges:
    """A merge list: ranks of byte strings, the parts of each token, valid pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._lookahead: int | None = None
        self._parts: dict[int, tuple[int, int]] = {}
        self._valid: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Merges:
        """Read a file of base64 tokens and ranks, one pair a line."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """Encode a short byte string by repeated lowest-rank merges."""
        ranks = self.ranks
        top = len(ranks) + 1 if below is None else below
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = top, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    @property
    def lookahead(self) -> int:
        """The sufficient lookahead in bytes, computed once."""
        if self._lookahead is None:
            self._lookahead = sufficient_lookahead(self)
        return self._lookahead

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens merged into ``token``; a single byte gives itself twice."""
        got = self._parts.get(token)
        if got is None:
            b = self.tokens[token]
            if len(b) == 1:
                got = (token, token)
            else:
                left, right = self.merge(b, below=token)
                got = (left, right)
            self._parts[token] = got
        return got

    def valid(self, left: int, right: int) -> bool:
        """Whether the bytes of ``left`` and ``right`` together encode to just these two tokens."""
        key = (left, right)
        got = self._valid.get(key)
        if got is None:
            if len(self._valid) > CACHE:
                self._valid.clear()
            a, b = self.tokens[left], self.tokens[right]
            got = self._valid[key] = self.merge(a + b) == [left, right]
        return got


def sufficient_lookahead(merges: Merges) -> int:
    """Bytes after a position that decide whether a token ends there.

    Dynamic programming over the merges by rank. A merge (u, v) is settled once
    v is settled and no earlier-ranked merge (v, w) can take v away; that needs
    the bytes of w and the lookahead of w. Ranks fall strictly, so it ends.
    """
    by_left: dict[int, list[int]] = {}
    need = dict.fromkeys((i for i, b in merges.tokens.items() if len(b) == 1), 0)
    worst: dict[int, int] = {}  # of the merges so far that start with a token: the most bytes any needs
    far = 0
    for token in sorted(merges.tokens):
        b = merges.tokens[token]
        if len(b) == 1:
            continue
        left, right = merges.parts(token)
        need[token] = max(need[right], worst.get(right, 0))
        reach = len(merges.tokens[right]) + need[token]
        worst[left] = max(worst.get(left, 0), reach)
        by_left.setdefault(left, []).append(token)
        far = max(far, reach)
    return far


class PieceTransducer:
    """Encodes one pretoken of any length fed in parts, with a bounded open end."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.tail = bytearray()  # bytes after the last emitted token, at most
        self.last: list[int] = []  # last token of each prefix of the tail
        self.before: int | None = None  # last emitted token
        # emitted in turns, so that a turn's walk along the open end is shared by as many bytes
        self.hold = 2 * (merges.lookahead + merges.longest)

    def push(self, data: bytes) -> list[int]:
        m, out = self.m, []
        ranks, valid, longest, tail, last = m.ranks, m.valid, m.longest, self.tail, self.last
        for byte in data:
            tail.append(byte)
            n = len(tail)
            for size in range(min(n, longest), 0, -1):
                t = ranks.get(bytes(tail[n - size:n]))
                if t is None:
                    continue
                p = self.before if n == size else last[n - size - 1]
                if p is None or valid(p, t):
                    last.append(t)
                    break
            if n >= self.hold:
                out += self._emit(n - m.lookahead)
        return out

    def _emit(self, upto: int) -> list[int]:
        """Emit the tokens that end at ``upto`` or before."""
        ends, end = [], len(self.tail)
        while end > 0:
            if end <= upto:
                ends.append(end)
            end -= len(self.m.tokens[self.last[end - 1]])
        if not ends:
            return []
        out = [self.last[e - 1] for e in reversed(ends)]
        self.before = out[-1]
        del self.tail[:ends[0]]
        del self.last[:ends[0]]
        return out

    def finish(self) -> list[int]:
        out = self._emit(len(self.tail))
        self.before = None
        return out


class Encoder:
    """Text to ids; ``window`` code points are held at a time."""

    def __init__(self, merges: Merges, pattern: str = PATTERN, window: int = WINDOW):
        self.m, self.window = merges, window
        self.all = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            t = PieceTransducer(self.m)
            ids = t.push(piece.encode("utf-8", "replace")) + t.finish()
            if len(piece) > self.window:
                return ids
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty give the empty list."""
        if not text:
            return []
        if len(text) <= self.window:
            (ids, rest) = self.stream((text,))
            return ids + rest
        return [i for ids in self.stream(text[k:k + self.window] for k in range(0, len(text), self.window)) for i in ids]

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text given in chunks; a chunk's ids are given once they are stable.

        What is held is less than a window, even inside a pretoken that is
        longer: its run of letters, digits, marks or white space is handed to the
        piece transducer as it comes.
        """
        held = ""
        run: tuple[regex.Pattern, int, PieceTransducer] | None = None
        for chunk in chunks:
            held += chunk
            out: list[int] = []
            if run:
                # the last white space of a run belongs to what follows
                pattern, keep, piece = run
                m = pattern.match(held)
                end = (m.end() if m else 0) - keep
                out += piece.push(held[:end].encode("utf-8", "replace"))
                still = end + keep == len(held)
                held = held[end:]
                if still:
                    yield out
                    continue
                out += piece.finish()
                run = None
            sure = min(len(held) - TEXT_LOOKAHEAD, len(held.rstrip()))  # a run of white space ends differently if more follows
            pieces = self.all(held)  # without gaps
            done, last = len(held), 0
            while pieces and done > sure:
                last = done
                done -= len(pieces.pop())
            get = self.cache.get
            for x in pieces:
                out += get(x) or self._piece(x)
            if not done and last == len(held) > self.window:
                inner = held[1] if held[0] == " " and not held[1].isspace() else held[0]
                pattern = next(r for r in RUNS if r.match(inner))
                run = pattern, int(pattern is RUNS[0]), PieceTransducer(self.m)
                done = len(held) - run[1]
                out += run[2].push(held[:done].encode("utf-8", "replace"))
            held = held[done:]
            yield out
        if run:
            yield run[2].push(held.encode("utf-8", "replace")) + run[2].finish()
        else:
            get = self.cache.get
            yield [i for x in self.all(held) for i in get(x) or self._piece(x)]


class ByteToText:
    """Ids to text, one at a time: an incremental UTF-8 state machine."""

    def __init__(self, merges: Merges, errors: str = "replace"):
        self.m = merges
        self.state = codecs.getincrementaldecoder("utf-8")(errors)

    def push(self, token: int) -> str:
        return self.state.decode(self.m.tokens[token])

    def finish(self) -> str:
        return self.state.decode(b"", True)


def decode(merges: Merges, ids: Iterable[int]) -> str:
    """Text of ids."""
    machine = ByteToText(merges)
    return "".join([machine.push(i) for i in ids] + [machine.finish()])


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Merges.load(path))
    return _LOADED[path]
