"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

The encoding of a prefix ends in exactly one token, and a sequence of tokens is an encoding if and only if each
neighbouring pair is (merging the pair's bytes gives the pair back).  So reading one more byte has one right last
token: the suffix token that fits the last token before it.  A transducer state is the last emitted token and the
bytes read since; a position is still alive while the bytes after it begin some longer token, and what all alive
positions share is emitted, so the lookahead is bounded by the longest token.

States and transitions are made when first met and kept, in flat arrays, up to a bound; at the bound all go and only
the states of the pieces at hand are made anew.  Every piece that is no token itself runs through the transitions, many
pieces in lockstep; there is no other way to its tokens.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as c

#: Bounds of the worker's memory: transitions (some 100 bytes each, with their states), whole pieces (some 160 bytes each)
#: and pairs of tokens (some 100 bytes each).
MAX_TRANSITIONS = 700_000
MAX_PIECES = 150_000
MAX_PAIRS = 200_000
#: Pieces beyond this many characters are not kept; texts are taken in parts of about this many.
KEPT_CHARS, PART_CHARS = 64, 1 << 19
#: Longer pieces run one after another, with this many transitions at hand.
LOCKSTEP_BYTES, NEAR = 256, 50_000
_NO_RANK = 1 << 60
_BYTES = [bytes([k]) for k in range(256)]
_HASH = 0x9E3779B97F4A7C15


def load_ranks(path: str) -> bytes:
    """The vocabulary file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Moves:
    """Transitions in open-addressed arrays: (state, byte) -> (state, output)."""

    def __init__(self, most: int):
        bits = max(4, (7 * int(most) // 5).bit_length())
        self.shift, self.mask = 64 - bits, (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)  # a value is state << 32 | output
        self.n = 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_HASH) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State -1 where there is no transition yet."""
        value = np.full(len(keys), -1, dtype=np.int64)
        todo, at = np.arange(len(keys)), self._first(keys)
        while len(todo):
            held = self.keys[at]
            same = held == keys[todo]
            value[todo[same]] = self.values[at[same]]
            go = ~same & (held >= 0)
            todo, at = todo[go], at[go] + 1 & self.mask
        return value >> 32, value & 0xFFFFFFFF

    def one(self, key: int) -> tuple[int, int]:
        at = (key * _HASH & (1 << 64) - 1) >> self.shift
        while (held := self.keys.item(at)) >= 0:
            if held == key:
                value = self.values.item(at)
                return value >> 32, value & 0xFFFFFFFF
            at = at + 1 & self.mask
        return -1, 0

    def add(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        self.n += len(keys)
        value = to << 32 | out
        todo, at = np.arange(len(keys)), self._first(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]
            won = free & (self.keys[at] == keys[todo])
            self.values[at[won]] = value[todo[won]]
            todo, at = todo[~won], at[~won] + 1 & self.mask


class Transducer:
    """Encodes pieces (bytes) into token ids.  ``steps`` and ``made`` count bytes read and transitions made."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = MAX_TRANSITIONS):
        self.ranks, self.max_transitions = ranks, max_transitions
        self.tokens = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        #: For every string that begins a token: its own rank or -1, and whether it begins a longer one.
        self.table = {b: (i, False) for b, i in ranks.items()}
        for b in ranks:
            for k in range(1, len(b)):
                self.table[b[:k]] = (ranks.get(b[:k], -1), True)
        self._pairs: dict[int, bool] = {}
        self._split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.steps = self.made = 0
        self._reset()

    def _reset(self) -> None:
        self._moves = Moves(self.max_transitions)
        self._near: dict[int, tuple[int, array]] = {}
        # states in flat arrays, which go back to the system at once: their keys one after another, for each byte of a
        # key but its last four the token that ends there, and the alive positions before the end
        self._keys, self._lasts, self._alive = bytearray(), array("I"), array("H")
        self._key_ends, self._alive_ends, self._finals = array("I", [0]), array("I", [0]), array("i")
        self._numbers = array("i", [-1]) * (self._moves.mask + 1)
        self._outputs: dict[tuple[int, ...], int] = {}
        self._flat, self._ends = array("I"), array("q")
        self._output(())
        self.start = self._state((0).to_bytes(4, "little"), array("I"), [])

    def _state(self, key: bytes, lasts: array, alive: list[int]) -> int:
        """``key``: the bytes read since the last emitted token, and that token plus one.  ``lasts``: for each of
        these bytes the token that ends there if the text does.  ``alive``: the alive positions before the end."""
        numbers, ends, keys, mask = self._numbers, self._key_ends, self._keys, self._moves.mask
        slot = hash(key) & mask
        while (n := numbers[slot]) >= 0:
            if keys[ends[n] : ends[n + 1]] == key:
                return n
            slot = slot + 1 & mask
        n = numbers[slot] = len(self._finals)
        keys += key
        ends.append(len(keys))
        self._lasts += lasts
        self._alive.extend(alive)
        self._alive_ends.append(len(self._alive))
        self._finals.append(-1)
        return n

    def _parts(self, state: int) -> tuple[bytes, array, array]:
        begin, end = self._key_ends[state], self._key_ends[state + 1]
        return bytes(self._keys[begin:end]), self._lasts[begin - 4 * state : end - 4 * state - 4], self._alive[self._alive_ends[state] : self._alive_ends[state + 1]]

    def _output(self, tokens: tuple[int, ...]) -> int:
        n = self._outputs.get(tokens)
        if n is None:
            n = self._outputs[tokens] = len(self._ends)
            self._flat.extend(tokens)
            self._ends.append(len(self._flat))
        return n

    def merge(self, data: bytes, parts_left: int = 1) -> list[bytes]:
        """Plain rank-ordered merging, down to ``parts_left`` parts; only ever asked about one token's bytes."""
        parts, ranks = [data[k : k + 1] for k in range(len(data))], self.ranks
        while len(parts) > parts_left:
            best, at = min((ranks.get(parts[k] + parts[k + 1], _NO_RANK), k) for k in range(len(parts) - 1))
            if best == _NO_RANK:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes a token; None for a byte, and for what merging never makes."""
        known = self._split.get(token, 0)
        if known == 0:
            parts = self.merge(token, 2)
            known = self._split[token] = tuple(parts) if len(parts) == 2 else None
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends in just these two.

        Looks back through the merges beside the boundary, the latest first: had the parts that then met there a
        rank that comes before the merge being undone (on the left, ties would go to the boundary's left), they
        would have merged over the boundary.
        """
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        ranks = self.ranks
        b = self.tokens[right]
        if len(b) > 1 and self._halves(b) is None:
            return False
        if left < 0:
            return True
        a, next_a, next_b = self.tokens[left], left, right
        bound, split = _NO_RANK, self._split
        while True:
            over = ranks.get(a + b)
            if over is not None and over < bound:
                return False
            halves_a = split[a] if a in split else self._halves(a)
            halves_b = split[b] if b in split else self._halves(b)
            if halves_a is None and halves_b is None:
                return True
            # the later of the two merges is undone; of equal ranks the right one came later
            if halves_b is None or (halves_a is not None and next_a > next_b):
                bound, a = next_a, halves_a[1]
                next_a = ranks[a]
            else:
                bound, b = next_b + 1, halves_b[0]
                next_b = ranks[b]

    def _tokens_of(self, output: int) -> array:
        return self._flat[self._ends[output - 1] if output else 0 : self._ends[output]]

    def _chain(self, lasts: array, end: int) -> list[int]:
        """Where tokens begin or end on the way from ``end`` back to 0."""
        out = [end]
        while end:
            end -= self.sizes[lasts[end - 1]]
            out.append(end)
        return out

    def _final(self, state: int) -> int:
        """The output at a piece's end: the tokens of the bytes still held."""
        if self._finals[state] < 0:
            lasts = self._parts(state)[1]
            self._finals[state] = self._output(tuple([lasts[q - 1] for q in self._chain(lasts, len(lasts))[-2::-1]]))
        return self._finals[state]

    def _make(self, missing: list[int]) -> tuple[list[int], list[int]]:
        """The states and outputs that transitions (state << 8 | byte) lead to."""
        table, pairs, sizes, outputs = self.table, self._pairs, self.sizes, self._outputs
        to, spoken = [], []
        for move in missing:
            key, lasts, known_alive = self._parts(move >> 8)
            before, end = key[-4:], len(lasts)
            pending = key[:-4] + _BYTES[move & 255]
            token, alive = -1, []
            known_alive.append(end)
            for q in known_alive:  # the longest token first
                known = table.get(pending[q:])
                if known is None:
                    continue
                own, longer = known
                if token < 0 <= own:
                    left = lasts[q - 1] if q else int.from_bytes(before, "little") - 1
                    fit = pairs.get(left << 20 | own)
                    if fit if fit is not None else self.fits(left, own):
                        token = own
                if longer:
                    alive.append(q)
            if token < 0:
                raise ValueError("a byte has no token of its own")
            lasts.append(token)
            end += 1
            output = 0
            if not alive or alive[0]:  # what all ways share is certain
                ends = self._chain(lasts, end)
                cut = end
                for q in alive:
                    while q not in ends:
                        q -= sizes[lasts[q - 1]]
                    cut = min(cut, q)
                if cut:
                    out = tuple([lasts[q - 1] for q in ends[-2::-1] if q <= cut])
                    output = outputs.get(out) or self._output(out)
                    pending, lasts, before = pending[cut:], lasts[cut:], (out[-1] + 1).to_bytes(4, "little")
                    alive = [q - cut for q in alive]
            to.append(self._state(pending + before, lasts, alive))
            spoken.append(output)
        self.made += len(missing)
        return to, spoken

    def _again(self, states: np.ndarray) -> np.ndarray:
        """Drops all transitions and states but these, which get new numbers."""
        used, place = np.unique(states, return_inverse=True)
        held = [self._parts(s) for s in used.tolist()]
        self._reset()
        return np.array([self._state(*h) for h in held], dtype=np.int64)[place]

    def _spelled(self, who: list[np.ndarray], outputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of outputs, and whose they are."""
        if not who:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        who, outputs = np.concatenate(who), np.concatenate(outputs)
        ends, flat = np.array(self._ends, dtype=np.int64), np.array(self._flat, dtype=np.uint32)
        begins = np.append(0, ends[:-1])[outputs]
        size = ends[outputs] - begins
        at = np.arange(int(size.sum())) + np.repeat(begins - (np.cumsum(size) - size), size)
        return np.repeat(who, size), flat[at]

    def _lockstep(self, pieces: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Tokens of pieces that descend by length, with the pieces' numbers, in the order they are emitted."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        states = np.full(len(pieces), self.start, dtype=np.int64)
        done: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        who, outputs, t, n = [], [], 0, len(pieces)

        def spell():
            for all_of, some in zip(done, self._spelled(who, outputs)):
                all_of.append(some)
            who.clear(), outputs.clear()

        while n:
            still = int(np.searchsorted(-lengths, -t, "left"))  # longer pieces than t bytes; the others end here
            if still < n:
                used, place = np.unique(states[still:n], return_inverse=True)
                who.append(np.arange(still, n))
                outputs.append(np.array([self._final(s) for s in used.tolist()], dtype=np.int64)[place])
                n = still
                continue
            keys = states[:n] << 8 | data[starts[:n] + t]
            to, out = self._moves.find(keys)
            missing = np.unique(keys[to < 0])
            if len(missing):
                if self._moves.n + len(missing) > self.max_transitions:
                    spell()
                    states[:n] = self._again(states[:n])
                    continue
                self._moves.add(missing, *(np.array(x, dtype=np.int64) for x in self._make(missing.tolist())))
                to, out = self._moves.find(keys)
            self.steps += n
            spoke = np.flatnonzero(out)
            who.append(spoke)
            outputs.append(out[spoke])
            states[:n] = to
            t += 1
        spell()
        return np.concatenate(done[0]), np.concatenate(done[1])

    def _alone(self, piece: bytes) -> np.ndarray:
        """Tokens of one piece of any length; the transitions it has used last are at hand in a dictionary."""
        state, out = self.start, array("I")
        for byte in piece:
            key = state << 8 | byte
            step = self._near.get(key)
            if step is None:
                to, spoken = self._moves.one(key)
                if to < 0:
                    if self._moves.n >= self.max_transitions:
                        state = int(self._again(np.array([state]))[0])
                        key = state << 8 | byte
                    (to,), (spoken,) = self._make([key])
                    self._moves.add(np.array([key]), np.array([to]), np.array([spoken]))
                if len(self._near) >= NEAR:
                    self._near.clear()
                step = self._near[key] = (to, self._tokens_of(spoken))
            state = step[0]
            if step[1]:
                out += step[1]
        self.steps += len(piece)
        return np.array(out + self._tokens_of(self._final(state)), dtype=np.uint32)

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        walked = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > LOCKSTEP_BYTES:
                out[k] = self._alone(piece).astype("<u4").tobytes()
            else:
                walked.append(k)
        walked.sort(key=lambda k: -len(pieces[k]))
        lanes = max(1, self.max_transitions // 4)
        for at in range(0, len(walked), lanes):
            own = walked[at : at + lanes]
            who, tokens = self._lockstep([pieces[k] for k in own])
            data = tokens[np.argsort(who, kind="stable")].astype("<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(who, minlength=len(own)))).tolist()
            for k, lo, hi in zip(own, [0, *ends], ends):
                out[k] = data[lo:hi]
        return out

    def encode(self, piece: bytes) -> list[int]:
        return np.frombuffer(self.encode_many([piece])[0], dtype="<u4").tolist()


class Utf8Machine:
    """Incremental UTF-8: ``feed`` returns the text that is certain, holding back an unfinished character."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could finish."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:  # the second byte of some leads has a narrower range
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= data[len(data) - back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self.unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def disputed_characters(pattern: str) -> str:
    """Characters that the ``regex`` module counts to the pattern's letters or numbers and the tokenizer library does
    not, as the ranges of a character class: the two know different versions of Unicode.  Empty without the library."""
    try:
        import tiktoken
    except ModuleNotFoundError:
        return ""
    ranks = {_BYTES[k]: k for k in range(256)}
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    found: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        if kind in pattern:
            theirs = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=ranks, special_tokens={})
            found |= set(regex.findall(kind, every)) - set(theirs.decode(theirs.encode_ordinary(every)))
    codes = np.array(sorted(map(ord, found)), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(codes) > 1)
    first, last = codes[np.append(0, cuts + 1)] if len(codes) else [], codes[np.append(cuts, len(codes) - 1)] if len(codes) else []
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in zip(first, last))


def _latin(text: str) -> bool:
    """Whether no character is beyond U+00FF; those are letters and numbers in every version of Unicode."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def latin_pattern(pattern: str) -> str | None:
    """The same pattern for texts without characters beyond U+00FF, with its Unicode classes spelled out, which the
    standard library's faster ``re`` takes; None where it holds more than these."""
    every = "".join(map(chr, range(256)))
    inside = {kind: "".join(f"\\x{ord(x):02x}" for x in regex.findall(kind, every)) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, within = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part in inside:
            out.append(inside[part] if within else f"[{inside[part]}]")
        elif part == r"\S" and not within:
            out.append(f"[^{inside[r'\s']}]")
        elif part.startswith("\\") and part[1:2].isalpha() and part not in (r"\r", r"\n", r"\t"):
            return None
        else:
            within = part == "[" or (within and part != "]")
            out.append(part)
    return "".join(out)


class Splitter:
    """The matches of a pattern; in texts with ``disputed`` characters these are no letters and no numbers."""

    def __init__(self, pattern: str, disputed: str = ""):
        self.plain = regex.compile(pattern)
        self.latin = re.compile(own) if (own := latin_pattern(pattern)) else self.plain
        self.disputed = regex.compile(f"[{disputed}]") if disputed else None
        if disputed:
            for kind in (r"\p{L}", r"\p{N}"):
                pattern = pattern.replace(kind, f"[{kind}--[{disputed}]]")
            self.careful = regex.compile(f"(?V1){pattern}")

    def parts(self, text: str) -> Iterator[list[str]]:
        """The matches in order, a bounded number at a time."""
        if _latin(text):
            chosen = self.latin
        else:
            chosen = self.careful if self.disputed is not None and self.disputed.search(text) else self.plain
        if len(text) <= PART_CHARS:
            yield chosen.findall(text)
            return
        matches = (m[0] for m in chosen.finditer(text))
        while part := list(islice(matches, PART_CHARS // 4)):
            yield part


class Codec:
    """Encoder and streaming decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, disputed: str = ""):
        self.transducer = Transducer(ranks)
        self.pieces: dict[str, bytes] = {}
        self.parts = Splitter(pattern, disputed).parts
        self.token = [self.transducer.tokens.get(i, b"") for i in range(max(self.transducer.tokens) + 1)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        waiting, size = [], 0
        for text in texts:
            if len(text) > PART_CHARS:
                out += self._together(waiting)
                out.append(b"".join(x for part in self.parts(text) for x in self._together([part])))
                waiting, size = [], 0
                continue
            waiting += self.parts(text)
            size += len(text)
            if size >= PART_CHARS:
                out += self._together(waiting)
                waiting, size = [], 0
        return out + self._together(waiting)

    def _together(self, found: list[list[str]]) -> list[bytes]:
        pieces = self.pieces
        fresh = list({p for own in found for p in own if p not in pieces})
        if len(pieces) + len(fresh) > MAX_PIECES:
            pieces.clear()
            fresh = list(set().union(*found))
        pieces.update(zip(fresh, self.transducer.encode_many([p.encode("utf-8") for p in fresh])))
        out = [b"".join(map(pieces.__getitem__, own)) for own in found]
        for piece in fresh:
            if len(piece) > KEPT_CHARS:
                del pieces[piece]
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int], size: int = 4096) -> Iterator[str]:
        """Text pieces as ids arrive, ``size`` ids at a time; characters split over tokens wait for their end."""
        machine, ids = Utf8Machine(), iter(ids)
        while held := list(islice(ids, size)):
            yield machine.feed(self.decode_bytes(held))
        yield machine.close()


_codecs: dict[tuple[int, str], Codec] = {}


def worker_codec(data, pattern: str, disputed: str = "") -> Codec:
    """The worker's codec of a broadcast vocabulary: made once, kept between tasks."""
    key = (data.id if hasattr(data, "id") else hash(data.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(data.value), pattern, disputed)
    c.resident["bpe"] = _codecs.clear
    return _codecs[key]


def _encoded(data, pattern: str, disputed: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(data, pattern, disputed)
        for batch in c.chunks(batches, "text", 1 << 20, keep="bpe"):
            ids = [np.frombuffer(x, dtype="<u4") for x in codec.encode_texts([text or "" for text in batch.column("text").to_pylist()])]
            flat = np.concatenate(ids).astype(np.int32)
            offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return run


def encode_texts(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids): every whole text in token ids, each match of ``pattern`` on its own, no special tokens.

    ``vocabulary`` is the content of the rank file (its size is fixed by the tokenizer, about a megabyte, and it is
    broadcast).  Null and empty texts give no ids; null ids and repeated rows stay; an empty table gives an empty
    result; other columns are not used.  Texts of any length are taken in parts, a single piece of any length too.
    Letters and numbers are those of the tokenizer library's Unicode version where the driver has the library.
    """
    data = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select("doc_id", "text").mapInArrow(_encoded(data, pattern, disputed_characters(pattern)), "doc_id long, ids array<int>")


def _decoded(data, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(data, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = ["".join(codec.decode_stream(x or ())) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return run


def decode_ids(encoded: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): adds the text of ``ids``; unfinished or invalid UTF-8 becomes U+FFFD, null ids an
    empty text."""
    data = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    return encoded.mapInArrow(_decoded(data, pattern), "doc_id long, ids array<int>, decoded string")
