"""Byte-level BPE as a bounded-lookahead streaming transducer, and decoding as an incremental byte-to-text machine.

For every prefix of a pretoken, the last token of that prefix's encoding is unique: it is the one token that ends
there and may follow the last token of the prefix before it. The transducer keeps that last token per position; an
automaton over the vocabulary names the tokens that end at a byte, longest first. Whatever follows, the encoding of a
longer prefix runs through one of the last ``longest`` positions, so tokens that all of these agree on are stable and
leave the buffer. ``lookahead`` bounds from the merge list how far back a later merge can still change a boundary, and
thereby the buffer. A pretoken's end makes all of its tokens stable.

Texts are read in chunks cut between pretokens, and a pretoken longer than a chunk goes through the transducer slice by
slice; a text of any length needs one chunk, one buffer and the hash states. Short pretokens that a worker has met
before are looked up in a table of bounded bytes instead.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import slices, worker_state

CHUNK = 1 << 16
CACHED_BYTES = 48 << 20  # of pretokens and their ids, in each of two generations
CACHED_PAIRS = 200_000
CACHED_LENGTH = 64
ENTRY_BYTES = 190  # of a cached pretoken beside its characters and ids: two objects and its share of the table

#: The pretoken pattern of the vocabulary family: letters, numbers, contractions, other marks, white space.
PRETOKENS = r" ?[<L>]+| ?[<N>]+|'(?:[stmd]|re|ve|ll)| ?[^<S><L><N>]+|[<S>]+(?![^<S>])|[<S>]+"
ANY_TEXT = {"<L>": r"\p{L}", "<N>": r"\p{N}", "<S>": r"\s"}
#: The same classes among the first 256 code points, for the standard library's faster matcher.
LATIN_1 = {"<L>": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "<N>": "0-9\xb2\xb3\xb9\xbc-\xbe", "<S>": "\t-\r \x85\xa0"}

ENCODED = "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _filled(classes: dict[str, str]) -> str:
    pattern = PRETOKENS
    for name, members in classes.items():
        pattern = pattern.replace(name, members)
    return pattern


class Transducer:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, definition: str):
        import regex

        spec = json.loads(definition)
        byte_of, vocab = byte_alphabet(), spec["model"]["vocab"]
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretokens = regex.compile(_filled(ANY_TEXT))
        self.pretokens_latin = re.compile(_filled(LATIN_1))
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = {i: -1 for t, i in vocab.items() if len(t) == 1}
        for r, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            if pair not in self.merged:
                self.merged[pair] = r
                self.parts.setdefault(whole, pair)
                self.rank.setdefault(whole, r)
        self.longest = max(len(self.bytes_of[i]) for i in self.rank)
        self.lookahead = self._lookahead()
        self._automaton()
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self.pairs: dict[int, bool] = {}
        self.cache = _Pieces(self)

    def _lookahead(self) -> int:
        """Bytes after a token that can still undo it.

        A merge (x, y) fails only if y, or a token on the right edge of y while y was built, went to a merge of lower
        rank with what follows; that merge may in turn be undone from the right by one of still lower rank. Ranks fall
        along such a chain, so it is finite; the longest, in bytes, is found in one pass by rising rank.
        """
        reach: dict[int, int] = {}  # by left operand: the furthest that a chain starting there looks
        most = 0
        for (x, y), _ in sorted(self.merged.items(), key=lambda m: m[1]):
            chain, edge = reach.get(y, 0), y
            while edge in self.parts:
                edge = self.parts[edge][1]
                chain = max(chain, reach.get(edge, 0))
            most = max(most, chain)
            reach[x] = max(reach.get(x, 0), len(self.bytes_of[y]) + chain)
        return most + self.longest

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes and b's bytes together is a, b."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        # Undo the merges of both sides, latest first. A merge across the boundary that would have come first, by rank
        # and then from the left, takes the boundary away.
        rank, merged, parts = self.rank, self.merged, self.parts
        bound = len(merged) + 1
        while True:
            across = merged.get((a, b))
            if across is not None and across < bound:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                bound, a = ra, parts[a][1]
            else:
                bound, b = rb + 1, parts[b][0]

    def _automaton(self) -> None:
        """Tries to extend the longest run of last bytes that begins some token; each state knows the longest token
        that ends there, and each token the next shorter one that ends where it does."""
        self.step: dict[int, int] = {}  # state << 8 | byte: the state after it
        own, children = [-1], [[]]
        for i in self.rank:
            node = 0
            for b in self.bytes_of[i]:
                following = self.step.get(node << 8 | b)
                if following is None:
                    following = self.step[node << 8 | b] = len(own)
                    own.append(-1)
                    children.append([])
                    children[node].append((b, following))
                node = following
            own[node] = i
        self.shorter: dict[int, int] = {}
        self.back, self.ending = [0] * len(own), own  # own becomes, level by level, the longest token that ends there
        level = [0]
        while level:
            below = []
            for node in level:
                for b, child in children[node]:
                    at = self.back[node]
                    while (to := self.step.get(at << 8 | b)) is None and at:
                        at = self.back[at]
                    self.back[child] = to if to is not None and to != child else 0
                    if own[child] >= 0:
                        self.shorter[own[child]] = own[self.back[child]]
                    else:
                        own[child] = own[self.back[child]]
                    below.append(child)
            level = below

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one pretoken that is at hand as a whole."""
        stream = Stream(self)
        return stream.push(piece) + stream.finish()

    def pieces(self, text: str) -> Iterator[list[str] | tuple[int, int]]:
        """Lists of pretokens, chunk by chunk; start and end of one that is about as long as a chunk or longer.

        The last two of a chunk wait for the next, as more text may change them.
        """
        at, n = 0, len(text)
        try:
            text.encode("latin-1")
            pattern = self.pretokens_latin
        except UnicodeEncodeError:
            pattern = self.pretokens
        while at < n:
            end = min(n, at + CHUNK)
            got = pattern.findall(text, at, end)
            if end < n:
                if len(got) <= 2:
                    end = pattern.match(text, at).end()
                    yield at, end
                    at = end
                    continue
                del got[-2:]
            yield got
            at += sum(map(len, got))

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in blocks."""
        lookup = self.cache.__getitem__
        for part in self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]:
            if part in self.special:
                yield struct.pack("<I", self.special[part])
                continue
            for got in self.pieces(part):
                if isinstance(got, list):
                    yield b"".join(map(lookup, got))
                    continue
                stream = Stream(self)
                for at in range(*got, CHUNK):
                    yield packed(stream.push(part[at : min(at + CHUNK, got[1])].encode()))
                yield packed(stream.finish())

    def decode(self, blocks: Iterator[bytes]) -> Iterator[str]:
        """Text of blocks of ids; bytes of a character that is not complete wait for the next block."""
        machine, of = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        for block in blocks:
            yield machine.decode(b"".join([of[i] for i in memoryview(block).cast("I")]))
        yield machine.decode(b"", True)


class Stream:
    """One pretoken's way through the transducer: bytes go in, tokens come out once nothing that follows can change them."""

    def __init__(self, owner: Transducer):
        self.owner, self.state = owner, 0
        self.last = [-1]  # the last token of each prefix from the latest stable position on
        self.check = owner.lookahead + owner.longest

    def push(self, data: bytes) -> list[int]:
        """The tokens that have become stable."""
        owner, last, state, out = self.owner, self.last, self.state, []
        step, back, ending, shorter, size, pairs = owner.step, owner.back, owner.ending, owner.shorter, owner.size, owner.pairs
        for b in data:
            while (to := step.get(state << 8 | b)) is None:
                state = back[state]
            state, end = to, len(last)
            token = ending[state]
            while True:
                before = end - size[token]
                if before >= 0:  # tokens do not reach back beyond a stable position
                    previous = last[before]
                    if previous < 0:
                        break
                    known = pairs.get(previous << 20 | token)
                    if known or (known is None and owner.may_follow(previous, token)):
                        break
                token = shorter[token]
            last.append(token)
            if end >= self.check:
                stable = self._agreed()
                out += self._path(stable)
                del last[:stable]  # the token before the position still decides what may follow it
                self.check = owner.lookahead + owner.longest if stable else 2 * end
        self.state = state
        return out

    def finish(self) -> list[int]:
        """The rest, at the pretoken's end."""
        return self._path(len(self.last) - 1)

    def _agreed(self) -> int:
        """The latest position through which the encodings of all recent prefixes run; 0 if none but the first."""
        last, size = self.last, self.owner.size
        at = set(range(max(0, len(last) - self.owner.longest), len(last)))
        while len(at) > 1:
            far = max(at)
            at.discard(far)
            at.add(max(0, far - size[last[far]]))
        return at.pop()

    def _path(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.last[end])
            end -= self.owner.size[self.last[end]]
        return out[::-1]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Encoded pretokens, without those that are long: this generation and the one before it, both of bounded bytes."""

    def __init__(self, owner: Transducer):
        self.owner, self.before, self.held = owner, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = packed(self.owner.encode_piece(piece.encode()))
        if len(piece) <= CACHED_LENGTH:
            size = ENTRY_BYTES + 2 * len(piece) + len(ids)
            if self.held + size > CACHED_BYTES:
                self.before, self.held = dict(self), 0
                self.clear()
            self.held += size
            self[piece] = ids
        return ids


def transducer(definition: str) -> Transducer:
    return worker_state("bpe", "transducer", hashlib.sha1(definition.encode()).hexdigest(), lambda: Transducer(definition))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Each document's ids (packed little-endian 32-bit, if ``keep_ids``), their count and hash, and the decoded text's hash.

    A null text counts as empty: no ids, the hashes of nothing. Null and repeated ids pass through; other columns of
    the input are not read. One row comes out for each row that goes in. No shuffle; the tokenizer file (a megabyte
    or two, whatever the corpus) is read on the driver and broadcast.
    """
    import pyarrow as pa

    with open(path or default_path(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = transducer(shared.value)
        for batch in slices(batches, 256):
            counts, packed, hashes, decoded = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids, back, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []

                def tee(text=text, ids=ids, kept=kept):
                    for block in bpe.encode(text or ""):
                        ids.update(block)
                        kept.append(block if keep_ids else len(block))
                        yield block

                for out in bpe.decode(tee()):
                    back.update(out.encode())
                n = sum(map(len, kept) if keep_ids else kept) // 4
                counts.append(n)
                packed.append(b"".join(kept) if keep_ids else None)
                hashes.append(ids.hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {id_type}, {ENCODED}")


def decode_ids(packed: bytes, path: str | None = None) -> str:
    """The text of packed ids."""
    with open(path or default_path(), encoding="utf-8") as f:
        return "".join(transducer(f.read()).decode(iter([packed])))
