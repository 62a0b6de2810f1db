"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

A tokenizer file (byte-level alphabet, merge list, word-end suffix) gives the merge rules. A text is a stream of bytes in
which a blank ends a word, and every byte goes through one transducer, whose state is the bytes read since the last token
that is stable. A token is stable once no continuation can change it. Tokens that begin later begin at an *open* place: one
from which the bytes read so far are the beginning of some token. The tokens before a cut are those of the bytes before it
alone, so the first tokens that all open places have in common are stable, and are emitted at that byte, before the word's end is
known. How long a token may have to wait is bounded by the list's *sufficient lookahead*: a merge at a place
depends on text to its right only through rules of higher priority that overlap its end, those on still higher ones, and so on;
following these chains through the list gives every rule's reach. Once a state holds that many bytes, its first token is emitted.

States and their steps are made when they are first met and remembered up to ``STATES``, then forgotten together, so that
memory stays bounded however long a text or word is. Long texts are read in pieces that end before white space.

Decoding reads ids only: a state machine takes the tokens' bytes and gives whole characters, an unfinished character
stays in the state.

Normalisation and word splitting follow the file: NFC, white space to blanks, lower case; words are runs of letters,
single digits, runs of other signs and seven contractions. The two special tokens keep their ids where they occur in
a text. Words repeat, so a bounded two-generation memory keeps what the transducer gave for recent short ones.

Defined cases: null is the empty text and has no tokens; an empty table gives an empty result; repeated rows are
encoded one by one; columns of the same names in the input are not read; null ids decode to the empty text.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: States that are remembered, and the longest run of bytes in one that is.
STATES, REMEMBERED = 100_000, 64
#: Characters of a text that are split into words at once, and tokens that are decoded at once.
PIECE, TOKENS = 1 << 16, 1 << 16
#: The rank of a rule that there isn't.
NEVER = float("inf")
#: The byte that ends a word: no word holds white space.
END = 0x20

_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
# the same for text within Latin-1, where these are all letters, numbers and spaces
_LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff \t\n\r\x0b\x0c\x85\xa0]+")


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    for i, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + i)
    return table


def reaches(rules: Iterable[tuple[str, str]], suffix: str) -> dict[str, int]:
    """For each merged text the symbols from its start that decide on the merge. ``rules``: merges by priority, highest first."""
    best: dict[str, int] = {}  # of the rules so far that start with the key and go on
    out: dict[str, int] = {}
    for left, right in rules:
        merged = text = left + right
        final = text.endswith(suffix)
        if final:
            text = text[: -len(suffix)]
        n = reach = len(text)
        if not final:
            for at in range(n):
                further = best.get(text[at:])
                if further is not None and at + further > reach:
                    reach = at + further
        for to in range(1, n + 1 if final else n):
            if best.get(text[:to], 0) < reach:
                best[text[:to]] = reach
        out[merged] = reach
    return out


#: What a state holds beside its steps: the bytes since the last stable token, and the places in them where a token may begin
#: that isn't over yet, each with the tokens before it (``packed``: many states are remembered).
READ, OPEN = -1, -2
#: For each byte met so far the next state and the ids that become stable at it, and the two above.
State = dict


def packed(places: list[tuple[int, tuple[int, ...]]]) -> array:
    """Places and the tokens before each in one array: place, number of tokens, tokens."""
    return array("i", chain.from_iterable((at, len(before), *before) for at, before in places))


def unpacked(numbers: array) -> list[tuple[int, tuple[int, ...]]]:
    places, i = [], 0
    while i < len(numbers):
        end = i + 2 + numbers[i + 1]
        places.append((numbers[i], tuple(numbers[i + 2 : end])))
        i = end
    return places


class Transducer:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str, states: int = STATES, window: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        rules = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._reach = reaches(rules, self.suffix)
        self.lookahead = max(self._reach.values(), default=1)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.strings = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.specials.items()}
        # a pair of tokens gives its rule's priority and what it becomes, in one number
        self._base = max(self.strings) + 1
        self._rank = {(self.vocabulary[a], self.vocabulary[b]): rank * self._base + self.vocabulary[a + b] for rank, (a, b) in enumerate(rules)}
        symbols = byte_symbols()
        self._bytes = {s: b for b, s in symbols.items()}
        self._special_ids = set(self.specials.values())
        # tokens by their bytes, at a word's end and elsewhere, and all that a token may have shown while a byte or the end is to come
        spelled = {s: self._spelling(s) for s in self.vocabulary}
        self._tokens = {data: self.vocabulary[s] for s, (data, final) in spelled.items() if not final}
        self._final_tokens = {data: self.vocabulary[s] for s, (data, final) in spelled.items() if final}
        self._unfinished = {data[:n] for data, final in spelled.values() for n in range(1, len(data) + final)}
        self.window, self._limit, self._states = window, states, {}
        # what each merged token is made of and by which rule; whether the merges leave a token alone, and its edges, as they are asked for
        self._made = {self.vocabulary[a + b]: (self.vocabulary[a], self.vocabulary[b], rank) for rank, (a, b) in enumerate(rules)}
        self._alone: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = {}, {}
        self._start: State = {READ: b"", OPEN: packed([(0, ())])}

    def _spelling(self, s: str) -> tuple[bytes, bool]:
        """The bytes of a token's string, and whether it ends a word."""
        final = s.endswith(self.suffix)
        return bytes(self._bytes[c] for c in (s[: -len(self.suffix)] if final else s) if c in self._bytes), final

    def _merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a bounded run of symbols, best rule first, left to right."""
        get, none = self._rank.get, len(self._rank) * self._base
        while len(ids) > 1:
            ranks = list(map(get, zip(ids, ids[1:]), repeat(none)))
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            if ranks.count(best) == 1:
                ids[at : at + 2] = [best % self._base]
                continue
            out, i, last = ids[:at], at, len(ids) - 1
            while i <= last:
                if i < last and ranks[i] == best:
                    out.append(best % self._base)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def width(self, token: int) -> int:
        """Bytes that a token stands for."""
        s = self.strings[token]
        return len(s) - len(self.suffix) if s.endswith(self.suffix) else len(s)

    def step(self, state: State, byte: int) -> tuple[State, str]:
        """The state after one more byte (a blank: the word's end), and the ids that are stable from then on."""
        places = unpacked(state[OPEN])
        if byte == END:
            return self._remembered(state, byte, self._start, self._ended(state[READ], places, self._final_tokens))
        read = state[READ] + bytes([byte])
        whole = self._ended(read, places, self._tokens)
        places = [(at, before) for at, before in places if read[at:] in self._unfinished]
        places.append((len(read), whole))
        shortest = min(len(before) for _, before in places)
        stable = next((n for n in range(shortest) if any(before[n] != whole[n] for _, before in places)), shortest)
        if not stable and len(read) >= self.lookahead:  # nothing that follows reaches back to the first token
            stable = 1
            places = [(at, before) for at, before in places if before[:1] == (whole[0],)]
        done = sum(map(self.width, whole[:stable]))
        read = read[done:]
        following = self._states.get(read) if read else self._start
        if following is None:
            following = {READ: read, OPEN: packed([(at - done, before[stable:]) for at, before in places])}
        return self._remembered(state, byte, following, whole[:stable])

    def _ended(self, read: bytes, places: list[tuple[int, tuple[int, ...]]], tokens: dict[bytes, int]) -> tuple[int, ...]:
        """The tokens of what has been read. The last one begins at an open place, and it is the one that the merges leave
        alone beside the token before it: whole token lists hold exactly where each two neighbours do."""
        for at, before in places:  # the longest first
            token = tokens.get(read[at:])
            if token is not None and self._holds(before[-1] if before else None, token):
                return *before, token
        raise ValueError(f"no token ends {read!r}")

    def _holds(self, left: int | None, token: int) -> bool:
        """Whether the merges make these two tokens, and not others, of their bytes.

        While a token is made, the symbol at its edge changes rule by rule. A merge across the cut happens if a rule joins the
        two edge symbols of some moment and comes before either is used up; at equal rank the place further left comes first."""
        alone = self._alone.get(token)
        if alone is None:
            alone = self._alone[token] = self._merge(self._symbols(token)) == [token]
        if left is None or not alone:
            return alone
        ours, theirs = self._edge(left, 1), self._edge(token, 0)
        i = j = 0
        while True:
            (a, used), (b, spent) = ours[i], theirs[j]
            rank = self._rank.get((a, b))
            if rank is not None and rank // self._base < used and rank // self._base <= spent:
                return False
            if used == spent == NEVER:
                return True
            if used <= spent:
                i += 1
            else:
                j += 1

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols at a token's left (0) or right (1) edge while it is made, each with the rank of the rule that uses it up."""
        known = self._edges[side].get(token)
        if known is None:
            known, at = [(token, NEVER)], token
            while at in self._made:
                *parts, rank = self._made[at]
                at = parts[side]
                known.append((at, rank))
            known = self._edges[side][token] = known[::-1]
        return known

    def _symbols(self, token: int) -> list[int]:
        s = self.strings[token]
        final = s.endswith(self.suffix)
        text = s[: -len(self.suffix)] if final else s
        return [self.vocabulary[c] for c in (text[:-1] if final else text)] + ([self.vocabulary[text[-1] + self.suffix]] if final else [])

    def _remembered(self, state: State, byte: int, following: State, ids: Iterable[int]) -> tuple[State, str]:
        step = following, " ".join(map(str, ids))
        if len(state[READ]) < self.window:
            if len(self._states) >= self._limit:
                for known in [*self._states.values(), self._start]:
                    for met in [k for k in known if k >= 0]:
                        del known[met]
                self._states.clear()
            if following is not self._start and len(following[READ]) < self.window:
                self._states[following[READ]] = following
            state[byte] = step
        return step

    def run(self, stream: bytes, emit: Callable[[str], None]) -> None:
        """Read words with a blank behind each; ids go out as soon as they are stable. The words' ends leave nothing behind."""
        state, rest = self._start, iter(stream)
        while True:
            try:
                for byte in rest:
                    state, ids = state[byte]
                    if ids:
                        emit(ids)
                return
            except KeyError:  # the first time that this byte comes in this state
                state, ids = self.step(state, byte)
                if ids:
                    emit(ids)

    def word(self, data: bytes) -> Iterator[int]:
        """Tokens of one word, each as soon as it is stable."""
        state = self._start
        for byte in data + b" ":
            state, ids = state.get(byte) or self.step(state, byte)
            yield from map(int, ids.split())

    def words(self, text: str) -> Iterator[list[str]]:
        """Words of a text in lists, the special tokens among them."""
        at = 0
        while len(text) - at > PIECE:
            end = next((m.start() for m in _BLANK.finditer(text, at + PIECE)), len(text))
            yield self._split(text[at:end])
            at = end
        yield self._split(text[at:] if at else text)

    def _split(self, text: str) -> list[str]:
        out, at = [], 0
        if self._special is not None and "<" in text:
            for m in self._special.finditer(text):
                out += self._split(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            text = text[at:] if at else text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return out + _WORD.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())
        return out + _LATIN_WORD.findall(text.lower())

    def _streams(self, text: str) -> Iterator[bytes | str]:
        """The words of a text as bytes, each with a blank behind it; a special token as its id."""
        special = self._special is not None and self._special.search(text) is not None
        for found in self.words(text):
            at = 0
            for i in [i for i, w in enumerate(found) if w in self.specials] if special else ():
                yield " ".join([*found[at:i], ""]).encode("utf-8")
                yield str(self.specials[found[i]])
                at = i + 1
            yield " ".join([*found[at:], ""]).encode("utf-8")

    def render(self, text: str | None) -> str:
        """Decimal ids of a text, joined by blanks."""
        out: list[str] = []
        for stream in self._streams(text or ""):
            if isinstance(stream, str):
                out.append(stream)
            else:
                self.run(stream, out.append)
        return " ".join(out)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.render(text).split()]

    @property
    def readable(self) -> dict[str, bytes]:
        """What each token stands for, as bytes: a word's end is a blank."""
        def of(i: int, s: str) -> bytes:
            if i in self._special_ids:
                return s.encode("utf-8")
            data, final = self._spelling(s)
            return data + b" " * final
        return {str(i): of(i, s) for i, s in self.strings.items()}

    @property
    def spelled(self) -> dict[str, bytes]:
        """Each token's string in the vocabulary and a blank, as a tokenizer without a decoder writes it."""
        return {str(i): s.encode("utf-8") + b" " for i, s in self.strings.items()}


def decode_stream(ids: str | None, table: dict[str, bytes]) -> Iterator[str]:
    """Text of decimal ids (blank-joined), piece by piece; bytes wait in the state until a character is whole."""
    state, at = codecs.getincrementaldecoder("utf-8")("replace"), 0
    ids = ids or ""
    while at < len(ids):
        end = ids.find(" ", at + TOKENS)
        end = len(ids) if end < 0 else end
        yield state.decode(b"".join(map(table.__getitem__, ids[at:end].split())))
        at = end
    yield state.decode(b"", True)


def decoded(ids: str | None, table: dict[str, bytes]) -> str:
    return "".join(decode_stream(ids, table)).removesuffix(" ")


_BLANK = re.compile(r"[ \t\n\r]")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per worker process and tokenizer file."""
    return Transducer(path)


@lru_cache(maxsize=4)
def _table(path: str, form: str) -> dict[str, bytes]:
    return getattr(transducer(path), form)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", form: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` (decimal, blank-joined: ``split`` and cast give an array), and with a ``form`` of ``decode`` also
    ``decoded``, read back from the ids in the same pass."""
    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if form else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        table = _table(tokenizer, form) if form else {}
        for whole in batches:
            for batch in slices(whole, 1):
                ids = [machine.render(t) for t in batch.column(1).to_pylist()]
                counts = [x.count(" ") + 1 if x else 0 for x in ids]
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string())]
                if form:
                    columns.append(pa.array([decoded(x, table) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids string" + (", decoded string" if form else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, tokenizer: str, form: str = "readable") -> DataFrame:
    """``tokens`` (``ids`` among its columns) and ``decoded``: ``readable`` text, lower-cased as the tokenizer sees it, or the
    tokens ``spelled`` as in the vocabulary; a ``decoded`` that was there is replaced."""
    own = [c for c in tokens.columns if c.lower() != "decoded"]
    where = own.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(tokenizer, form)
        for whole in batches:
            for batch in slices(whole, where):
                texts = [decoded(x, table) for x in batch.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*own, "decoded"])

    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in own)
    return tokens.select(*[f"`{c}`" for c in own]).mapInArrow(run, f"{kinds}, decoded string")
