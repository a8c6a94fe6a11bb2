"""Byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer that is determinised lazily. A state of the underlying
automaton is a place inside a token (a node of the vocabulary's prefix tree) together with the last complete token
before it; a complete token is accepted only if it may stand after that last token. A state of the transducer is the
set of places that the bytes read so far allow, each with the tokens it has not emitted yet; tokens that all places
agree on are emitted, which happens after a bounded lookahead. Decoding checks UTF-8 with an incremental state machine.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cache
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, slices, struct, utf8


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Bytes in, token ids out; transitions are worked out when first taken. At most `max_states` are kept."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 120_000, max_memo: int = 500_000):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                node = self._child(node, byte)
            self.token_at[node] = i
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.fits: dict[int, bool] = {}
        self.max_states, self.max_memo = max_states, max_memo
        self._reset()
        #: Encodings met lately, as int32 bytes; what is used moves from the old half to the young one.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.written = [str(i) for i in range(max(ranks.values(), default=0) + 1)]

    def _child(self, node: int, byte: int) -> int:
        found = self.children[node].get(byte)
        if found is None:
            found = self.children[node][byte] = len(self.children)
            self.children.append({})
            self.token_at.append(-1)
        return found

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.states = {start: 0}
        self.sets = [start]
        #: state << 8 | byte to the next state << 1 | whether tokens are emitted on the way; those tokens.
        self.next: dict[int, int] = {}
        self.emitted: dict[int, tuple[int, ...]] = {}
        #: Where the first bytes of longer pieces lead, and what is emitted on the way.
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def _edges_of(self, token: int) -> tuple[list, list] | None:
        """The parts at the token's left and right edge while it is merged alone, each with the rank that ends it.

        None if merging doesn't give the token back; such a token only ever stands for a whole piece.
        """
        if token in self.edges:
            return self.edges[token]
        text, ranks = self.tokens[token], self.ranks
        parts = [text[i : i + 1] for i in range(len(text))]
        left, right = [[parts[0], NEVER]], [[parts[-1], NEVER]]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            for edge, at in ((left, 0), (right, -1)):
                if edge[-1][0] != parts[at]:
                    edge[-1][1] = rank
                    edge.append([parts[at], NEVER])
        self.edges[token] = (left, right) if len(parts) == 1 else None
        return self.edges[token]

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes merge to just these two; an encoding is one whose neighbours all do so.

        Ranks of merges only rise, so the parts that meet at the boundary follow from the tokens' own merges; the
        tokens stay apart unless a merge over the boundary comes before the next merge on either side.
        """
        both = left << 24 | right
        known = self.fits.get(both)
        if known is None:
            one, other = self._edges_of(left), self._edges_of(right)
            known = one is not None and other is not None and self._apart(one[1], other[0])
            if len(self.fits) > 400_000:
                self.fits.clear()
            self.fits[both] = known
        return known

    def _apart(self, lefts: list, rights: list) -> bool:
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = lefts[i], rights[j]
            across = self.ranks.get(a + b, NEVER)
            # of equal ranks the leftmost merges first: inside the left token, then across, then inside the right one
            if across < a_ends and across <= b_ends and across != NEVER:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _ends_at(self, state: int, byte: int) -> tuple[int, ...]:
        """What is still to be emitted if the text ends with this byte: one place of the state ends in a token there."""
        children, token_at = self.children, self.token_at
        for node, last, pending in self.sets[state]:
            node = children[node].get(byte)
            if node is not None:
                token = token_at[node]
                if token >= 0 and (self._edges_of(token) is not None if last < 0 else self._may_follow(last, token)):
                    return (*pending, token)
        raise AssertionError("every text has an encoding")

    def _step(self, state: int, byte: int) -> int:
        children, token_at, whole = self.children, self.token_at, None
        places = []
        for node, last, pending in self.sets[state]:
            node = children[node].get(byte)
            if node is None:
                continue
            token = token_at[node]
            if token >= 0 and whole is None and (self._edges_of(token) is not None if last < 0 else self._may_follow(last, token)):
                whole = (0, token, (*pending, token))
            if children[node]:
                places.append((node, last, pending))
        places.append(whole)
        emitted = places[0][2]
        for _, _, pending in places:
            if not emitted:
                break
            n = 0
            for x, y in zip(emitted, pending):
                if x != y:
                    break
                n += 1
            emitted = emitted[:n]
        n = len(emitted)
        key = tuple([(node, last, pending[n:]) for node, last, pending in places] if n else places)
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.sets)
            self.sets.append(key)
        at = state << 8 | byte
        if n:
            self.emitted[at] = emitted
        value = self.next[at] = number << 1 | (n > 0)
        return value

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the splitting pattern; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.sets) > self.max_states:
            self._reset()
        head, following = piece[:HEAD], self.next
        state, out, first = 0, [], 0
        if len(piece) > HEAD + 1:
            met = self.heads.get(head)
            if met is not None:
                state, first, out = met[0], HEAD, list(met[1])
        for i in range(first, len(piece) - 1):
            byte = piece[i]
            at = state << 8 | byte
            taken = following.get(at)
            if taken is None:
                taken = self._step(state, byte)
            if taken & 1:
                out += self.emitted[at]
            state = taken >> 1
            if i == HEAD - 1:
                self.heads[head] = state, tuple(out)
        out += self._ends_at(state, piece[-1])
        return out

    @staticmethod
    def _pieces(chunk: str, pattern: regex.Pattern) -> list[str]:
        """The matches of the pattern; plain words, alone or before one mark, need no regex."""
        if chunk.isascii() and chunk[0] == " " and len(chunk) > 2:
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[1:-1].isalpha() and chunk[-1] in ".,;:!?":
                return [chunk[:-1], chunk[-1]]
        return pattern.findall(chunk)

    def _met(self, text: str, pattern: regex.Pattern) -> bytes:
        found = self.old.get(text)
        if found is None:
            pieces = self._pieces(text, pattern)
            if len(pieces) == 1:
                found = array("i", self.encode_piece(text.encode())).tobytes()
            else:
                found = b"".join([self.young.get(p) or self._met(p, pattern) for p in pieces])
        if len(text) < 64:
            if len(self.young) * 2 >= self.max_memo:
                self.old, self.young = self.young, {}
            self.young[text] = found
        return found

    def encode(self, text: str, pattern: regex.Pattern) -> np.ndarray:
        """The ids, int32. Any other pattern than WORDS_APART is matched over the whole text, each match by itself.

        No match goes on over a space that stands between two characters that aren't white space, so the text is cut
        there, unless white space stands together.
        """
        if pattern.pattern != WORDS_APART:
            return np.concatenate([np.zeros(0, np.int32), *(np.array(self.encode_piece(m[0].encode()), np.int32) for m in pattern.finditer(text) if m[0])])
        known = self.young
        if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or _OTHER_WHITE.search(text):
            cut = pattern.findall(text)
        else:
            first, *rest = text.split(" ")
            cut = [first, *[" " + x for x in rest]]
        done = []
        for x in cut:
            ids = known.get(x)
            if ids is None and x:
                ids = self._met(x, pattern)
                known = self.young
            done.append(ids or b"")
        return np.frombuffer(b"".join(done), np.int32)

    def decimal(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by one space."""
        written = self.written
        return " ".join([written[i] for i in ids.tolist()])


#: No merge; comes after every rank.
NEVER = 1 << 60
#: Bytes of a piece that are looked up together.
HEAD = 6
#: White space other than the space and \n.
#: Fixed value: the pattern for which words met before are remembered with the space before them.
WORDS_APART = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER_WHITE = re.compile(r"[^\S \n]")


@cache
def transducer(path: str, max_states: int = 120_000, max_memo: int = 500_000) -> Transducer:
    """One for each Python worker; it keeps what it has determinised between batches."""
    return Transducer(load_ranks(path), max_states, max_memo)


class Utf8Stream:
    """An incremental UTF-8 state machine: bytes in pieces of any length in, only whole code points out.

    A sequence that isn't UTF-8 becomes one U+FFFD for each maximal ill-formed part, as the Unicode standard advises.
    """

    #: A lead byte's length, and the range that its second byte must be in.
    _LEADS = {b: (2, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (3, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)} | {b: (4, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)}

    def __init__(self) -> None:
        self.held = b""

    def push(self, data: bytes) -> str:
        joined = self.held + data
        end = len(joined) - self._unfinished(joined)
        self.held = joined[end:]
        try:
            return joined[:end].decode()
        except UnicodeDecodeError:
            return self._repaired(joined[:end])

    def _unfinished(self, data: bytes) -> int:
        """How many bytes at the end begin a sequence that more bytes may complete."""
        for k in range(1, min(3, len(data)) + 1):
            length, low, high = self._LEADS.get(data[-k], (1, 0, 0))
            if data[-k] < 0x80 or data[-k] >= 0xC0:
                return k if length > k and (k == 1 or low <= data[1 - k] <= high) else 0
        return 0

    def _repaired(self, data: bytes) -> str:
        out, i, plain = [], 0, 0
        while i < len(data):
            length, low, high = self._LEADS.get(data[i], (1 if data[i] < 0x80 else 0, 0, 0))
            n = 1
            while n < length and i + n < len(data) and low <= data[i + n] <= high:
                n, low, high = n + 1, 0x80, 0xBF
            if n != length:
                out += [data[plain:i].decode(), "\ufffd"]
                plain = i + n
            i += n
        return "".join([*out, data[plain:].decode()])

    def close(self) -> str:
        held, self.held = self.held, b""
        return "�" if held else ""


class Decoder:
    """Ids to bytes; every token's bytes stand in one buffer."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = dict(sorted((i, t) for t, i in ranks.items()))
        self.size = max(by_id) + 1
        lengths = np.zeros(self.size, np.int64)
        lengths[list(by_id)] = [len(t) for t in by_id.values()]
        self.lengths, self.offsets = lengths, np.cumsum(lengths) - lengths
        self.buffer = np.frombuffer(b"".join(by_id.values()), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.buffer[at].tobytes()


@cache
def decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def shipped(path: str) -> str:
    """The name under which tasks find the file: executors fetch it from the driver, whatever folders they share."""
    SparkSession.active().sparkContext.addFile(path)
    return Path(path).name


def encode(text: Column | str, vocabulary: str, pattern: str) -> Column:
    """The token ids of a text column, array<int>; null counts as empty."""
    name = shipped(vocabulary)

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        machine, split = transducer(SparkFiles.get(name)), regex.compile(pattern)
        ids = [machine.encode(t.decode("utf-8", "replace"), split) for part in slices(texts) for t in part]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.zeros(0, np.int32)]))

    return of(utf8(text))


def decode(ids: Column | str, vocabulary: str, block: int = 4096) -> Column:
    """The text of an array of token ids, decoded in blocks of ids through the UTF-8 state machine; null stays null."""
    name = shipped(vocabulary)

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        table, out = decoder(SparkFiles.get(name)), []
        for one in lists:
            values = None if not one.is_valid else np.array(one.as_py() or [], np.int64)
            if values is not None:
                stream = Utf8Stream()
                values = "".join([*(stream.push(table.decode(values[i : i + block])) for i in range(0, len(values), block)), stream.close()])
            out.append(values)
        return pa.array(out, pa.string())

    return of(F.col(ids) if isinstance(ids, str) else ids)


def token_digests(docs: DataFrame, *, vocabulary: str, pattern: str, text_col: str = "text", block: int = 65536, max_states: int = 120_000, max_memo: int = 500_000) -> DataFrame:
    """docs plus n_tokens, ids_sha256 and decoded_sha256 of a whole round trip: encoded, then decoded from the ids.

    Null counts as empty; an empty text has no tokens. Ids are never gathered over more than a batch. Columns with
    these names are replaced; all others, `text_col` included, pass through. An empty table gives an empty table.
    max_states and max_memo bound what a worker remembers (about 0.8 and 0.2 KB each); they change no result.
    """
    name = shipped(vocabulary)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def of(texts: pa.Array) -> pa.Array:
        path, split = SparkFiles.get(name), regex.compile(pattern)
        machine, table = transducer(path, max_states, max_memo), decoder(path)
        counts, ids_hex, decoded_hex = [], [], []
        for text in (text for part in slices(texts) for text in part):
            ids = machine.encode(text.decode("utf-8", "replace"), split)
            stream, digest = Utf8Stream(), sha256()
            for i in range(0, len(ids), block):
                digest.update(stream.push(table.decode(ids[i : i + block])).encode())
            digest.update(stream.close().encode())
            counts.append(len(ids))
            ids_hex.append(sha256(machine.decimal(ids).encode()).hexdigest())
            decoded_hex.append(digest.hexdigest())
        return struct(n_tokens=pa.array(counts, pa.int64()), ids_sha256=pa.array(ids_hex, pa.string()), decoded_sha256=pa.array(decoded_hex, pa.string()))

    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    rows, own = beside(docs, names, of(utf8(F.col(f"`{text_col}`"))))
    return rows.select(*own, *(F.col(f"value.{n}").alias(n) for n in names))
