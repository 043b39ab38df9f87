"""BPE as a streaming transducer, and incremental decoding.

A merge list defines one token sequence for each symbol string. Two facts make that left-to-right:

* the tokens of a string, cut after any of them, are the tokens of that prefix; so a prefix has one *last token*, and
  last tokens chain back to the start of the text;
* a chain is right if and only if each two neighbours would not have merged across their border (`borders_hold`).

The transducer keeps the last token of each live prefix. A token still to come starts within the last
``max_len`` symbols, so whatever all live prefixes' chains have in common can no longer change: it is emitted, and its
memory is freed. How far that lags behind is bounded by the merge list alone (`sufficient_lookahead`): what lies that
far back is emitted at once, so memory is constant in the text.

Normalisation and pre-tokenisation are the library's own; the merges, and the decoding, are done here.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesnap.llm.common import Cache, Memo, claim, small_batches

#: Ids that are decoded, and about the ids that are held, at a time.
STEP = 1 << 16
END = "\0"  # stands for the end-of-word suffix, attached to the last symbol
#: Bytes of the memos of pieces, of words and of token pairs, which only save time; characters of what enters them.
PIECES, WORDS, PAIRS, LONG = 128 << 20, 32 << 20, 24 << 20, 64
#: Characters at the start of a word whose walk is kept, and bytes of that memo.
HEAD, HEADS = 4, 8 << 20
#: Pieces of a text whose ids are put together at a time.
MANY = 1 << 13
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if visible, else the next from U+0100."""
    seen = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = (b for b in range(256) if b not in seen)
    seen |= {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [seen[b] for b in range(256)]


class Transducer:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        own = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) and t != suffix else t
        self.ids = {own(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for r, (a, b) in enumerate(merges):
            a, b = own(a), own(b)
            self.rank.setdefault((a, b), r)
            self.made.setdefault(a + b, (r, a, b))
        # A token counts if merging its own symbols gives it back; others never come out.
        self.tokens = {t for t in self.ids if len(t) == 1 or (len(t) == 2 and t[1] == END) or self._own_merge(t)}
        self.max_len = max(map(len, self.tokens), default=1)
        # the automaton over all tokens: a node is (next nodes by symbol, tokens that end here, the beginning of a token
        # that it stands for); nodes are made as they are met
        self._starts = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self._root = ({}, (), "")
        self._nodes = {"": self._root}
        self._holds = Memo("bpe", PAIRS, lambda uv: self.borders_hold(*uv), each=120)
        self._heads = Memo("bpe", HEADS, self._head, each=400)
        self.lookahead = self.sufficient_lookahead()

    def _next(self, node: tuple, symbol: str) -> tuple:
        """The node of the longest end of (node, symbol) that a token begins with; its tokens, longest first."""
        text = node[2] + symbol
        while text and text not in self._starts:
            text = text[1:]
        if text not in self._nodes:
            ends = (text[k:] for k in range(len(text)))
            self._nodes[text] = ({}, tuple((t, len(t)) for t in ends if t in self.tokens and t != END), text)
        node[0][symbol] = to = self._nodes[text]
        return to

    def _own_merge(self, t: str) -> bool:
        return t in self.made and self.plain(t) == [t]

    @staticmethod
    def symbols(text: str) -> list[str]:
        return [*text[:-2], text[-2:]] if text.endswith(END) and len(text) > 1 else list(text)

    def plain(self, text: str) -> list[str]:
        """The definition: apply the lowest-ranked merge, leftmost first, until none applies. For set-up and tests."""
        parts = self.symbols(text)
        while len(parts) > 1:
            best = min((self.rank.get(p, sys.maxsize), k) for k, p in enumerate(zip(parts, parts[1:])))
            if best[0] == sys.maxsize:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def sufficient_lookahead(self) -> int:
        """Symbols after which a token can't change any more, whatever follows.

        What follows a text can only change a merge near its end, and a merge that comes or goes can only change later
        ones (of higher rank) that take up one of its parts, or what it makes, at the same border: such a merge (a, b)
        has that token at the left edge of b, and moves the change to the left by a. So the merges that carry a change
        leftwards form a chain of rising ranks; the longest one is found rank by rank."""
        reach: dict[str, int] = {}  # token -> how far left of its end a change of it may have come from
        longest = 0
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            far = max((reach.get(x, 0) for x, _ in self._spine(b, 1)), default=0)
            now = len(a) + max(far, len(b))
            for x in (a, a + b):
                reach[x] = max(reach.get(x, 0), now)
            longest = max(longest, now)
        return longest + self.max_len

    def borders_hold(self, u: str, v: str) -> bool:
        """Whether u and v, side by side, stay apart: no part at the end of u meets a part at the start of v,
        while both exist, whose merge comes before those that build on them. Equal ranks go to the left one."""
        return not any(
            (m := self.rank.get((x, y), -1)) >= 0 and m < until_x and m <= until_y
            for x, until_x in self._spine(u, 2) for y, until_y in self._spine(v, 1)
        )

    def _spine(self, t: str, side: int) -> list[tuple[str, int]]:
        out, until = [], sys.maxsize
        while True:
            out.append((t, until))
            if len(t) == 1 or t not in self.made or (len(t) == 2 and t[1] == END):
                return out
            until, t = self.made[t][0], self.made[t][side]

    def _walk(self, symbols: Iterable[str], last: list, node: tuple) -> tuple:
        """Puts the last token of each further prefix on last; the node reached."""
        holds, put = self._holds, last.append
        for s in symbols:
            to = node[0].get(s)
            node = self._next(node, s) if to is None else to
            for t, k in node[1]:
                before = last[-k]
                if not before or holds[before, t]:
                    put(t)
                    break
            else:
                put(s)
        return node

    def _head(self, text: str) -> tuple[list, tuple]:
        last = [""]
        return last, self._walk(text, last, self._root)

    def window(self, word: str, suffix: bool) -> list[str]:
        """Tokens of a word (its last symbol with END, if suffix) that is no longer than the window of encode(), which
        then emits nothing before its end. What words begin with is kept."""
        k = min(HEAD, len(word) - 1)
        last, node = self._heads[word[:k]]
        last = last.copy()
        if suffix:
            node = self._walk(word[k:-1], last, node)
            last.append(None)  # inside a symbol no prefix ends
            self._walk((word[-1] + END,), last, node)
        else:
            self._walk(word[k:], last, node)
        return self._chain(last, len(last) - 1)

    def encode(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a stream of symbols, each as soon as it is stable."""
        last, n, node = [""], 0, self._root  # last[i]: last token of the prefix that ends at i
        step, holds = 2 * self.max_len, self._holds
        for s in symbols:
            n += len(s)
            if len(s) > 1:
                last.append(None)  # inside a symbol no prefix ends
            to = node[0].get(s)
            node = self._next(node, s) if to is None else to
            for t, k in node[1]:
                if k <= n and (before := last[n - k]) is not None and (not before or holds[before, t]):
                    last.append(t)
                    break
            else:
                last.append(s)
            if n > step:
                live = {i for i in range(max(0, n - self.max_len + 1), n + 1) if last[i] is not None}
                while len(live) > 1:
                    i = max(live)
                    live.remove(i)
                    live.add(i - len(last[i]))
                cut = live.pop()
                if n - cut > self.lookahead + self.max_len:  # never further back than the merge list demands
                    cut = n
                    while n - cut < self.lookahead:
                        cut -= len(last[cut])
                yield from self._chain(last, cut)
                last, n = last[cut:], n - cut  # last[0] is now the token before what comes
                step = n + 2 * self.max_len
        yield from self._chain(last, n)

    @staticmethod
    def _chain(last: list, end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]


#: White space beyond the space, tab and line ends; and what a plain split at spaces would cut wrongly.
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RUNS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")


BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def space_pieces(text: str) -> list[str]:
    """Parts that share no pre-token of a byte vocabulary: cut before the last space of each run of white space."""
    if any(x in text for x in RUNS) or text.endswith(" ") or ODD.search(text):
        return re.split(r"(?= \S)", text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


class Missing(dict):
    """Symbols that the vocabulary lacks have no id."""

    def __missing__(self, _: str) -> bytes:
        return b""


class Encoder:
    """Whole texts to ids for the two kinds of vocabulary files: words (lower case, white space dropped, word ends
    marked) and bytes (a space opens the word after it). Texts are cut where neither kind joins anything. What lies
    between cuts is normalised and pre-tokenised by the library, and goes through the transducer once; bounded memos
    keep the ids of short pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        model, before = spec["model"], spec["pre_tokenizer"]
        self.by_words = "Split" in [x["type"] for x in before.get("pretokenizers", [before])]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, self.suffix)
        self.id_bytes = Missing((t, i.to_bytes(4, "little")) for t, i in self.transducer.ids.items())
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        of = {c: b for b, c in enumerate(byte_symbols())}
        self.byte_parts = {i: bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode() for i, t in self.names.items()} if self.byte_level else {}
        self.memo = Memo("bpe", PIECES, self._short_piece, LONG)
        self.inner = Memo("bpe", WORDS, self._short_word, LONG)

    def _word(self, word: str) -> Iterator[bytes]:
        """Ids of one pre-token (its bytes as printable characters), as little-endian unsigned 32-bit integers, as soon
        as they are stable."""
        t, n, out = self.transducer, len(word), array("I")
        symbols = chain(islice(word, n - 1), (word[n - 1] + END,)) if self.suffix else word  # nothing is copied
        for x in t.encode(symbols):
            if x in t.ids:
                out.append(t.ids[x])
                if len(out) >= STEP:
                    yield out.tobytes()
                    out = array("I")
        yield out.tobytes()

    def _short_word(self, word: str) -> bytes:
        """_word() of up to LONG characters."""
        if len(word) > LONG:  # its bytes may be more than its characters
            return b"".join(self._word(word))
        return b"".join(map(self.id_bytes.__getitem__, self.transducer.window(word, bool(self.suffix))))

    def _short_piece(self, piece: str) -> bytes:
        """Ids of a piece of up to LONG characters; a word of a to z is its own only pre-token."""
        if self.by_words and piece.isascii() and piece.isalpha() and piece.islower():
            return self._short_word(piece)
        return b"".join(self._piece(piece))

    def _learn(self, pieces: list[str]) -> None:
        """Puts short pieces of a vocabulary of words into the memo: the library sees all of them at once."""
        text = self.normalizer.normalize_str(" ".join(pieces))
        parts = text.split(" ")
        if len(parts) != len(pieces) or self.cut.search(text):
            return  # one by one, then, when they are asked for
        memo, inner = self.memo, self.inner
        ends, k, own = list(accumulate(len(x) + 1 for x in parts)), 0, []
        for word, (start, _) in self.pre_tokenizer.pre_tokenize_str(text):
            while start >= ends[k]:
                if pieces[k] not in memo:
                    memo.put(pieces[k], own[0] if len(own) == 1 else b"".join(own))
                k, own = k + 1, []
            own.append(memo[word] if word.isascii() and word.isalpha() else inner[word])
        for x in pieces[k:]:
            memo.put(x, b"".join(own))
            own = []

    def _piece(self, piece: str) -> Iterator[bytes]:
        for k, part in enumerate(self.cut.split(piece)):
            if k % 2:
                yield self.special[part].to_bytes(4, "little")
                continue
            if self.normalizer is not None:
                part = self.normalizer.normalize_str(part)
            for word, _ in self.pre_tokenizer.pre_tokenize_str(part) if part else ():
                if len(word) <= LONG:
                    yield self.inner[word]
                else:
                    yield from self._word(word)

    def _pieces(self, text: str) -> list[str]:
        """Parts of a text that share no token: split at white space, or before the last space of a run."""
        if not self.by_words:
            return space_pieces(text)
        return [x for x in WHITE.split(text) if x] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def stream(self, text: str) -> Iterator[bytes]:
        """Ids of a text, as little-endian unsigned 32-bit integers, part by part: of MANY pieces at a time, or up to
        STEP of a long one."""
        pieces, known = self._pieces(text), self.memo.__getitem__
        for k in range(0, len(pieces), MANY):
            some = pieces[k : k + MANY]
            if max(map(len, some)) <= LONG:
                memo, old = self.memo, self.memo.old
                new = [x for x in set(some) if x not in memo and x not in old] if self.by_words else ()
                if len(new) > 1:
                    self._learn(new)
                yield b"".join(map(known, some))
                continue
            for x in some:
                if len(x) <= LONG:
                    yield known(x)
                else:
                    yield from self._piece(x)

    def encode(self, text: str) -> bytes:
        """All ids of a text at once."""
        return b"".join(self.stream(text))

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Ids to text, part by part. Its whole state: for byte-level decoders the bytes of an unfinished character, else
    whether a token has been written (tokens are then joined by spaces)."""

    def __init__(self, encoder: Encoder):
        self.byte_level = encoder.byte_level
        if self.byte_level:
            self.parts = encoder.byte_parts
            self.state = codecs.getincrementaldecoder("utf-8")("replace")
        else:
            self.parts, self.state = encoder.names, False

    def feed(self, ids: Iterable[int]) -> str:
        parts = map(self.parts.__getitem__, ids)
        if self.byte_level:
            return self.state.decode(b"".join(parts))
        text = " ".join(parts)
        text, self.state = (" " if self.state and text else "") + text, self.state or bool(text)
        return text

    def end(self) -> str:
        return self.state.decode(b"", True) if self.byte_level else ""


_encoders: dict[str, Encoder] = Cache("bpe")


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def round_trip(own: Encoder, text: str | None) -> tuple[int, str, str]:
    """Number of ids, sha256 of the ids and of the text that they decode to. Neither is ever held as a whole."""
    decoder, ids, back, n = own.decoder(), hashlib.sha256(), hashlib.sha256(), 0
    for part in own.stream(text or ""):
        n += len(part) // 4
        ids.update(part)
        back.update(decoder.feed(memoryview(part).cast("I")).encode())
    back.update(decoder.end().encode())
    return n, ids.hexdigest(), back.hexdigest()


def round_trip_column(text, path: str):
    """struct<n_tokens, ids_sha256, decoded_sha256> of a text column; null counts as the empty text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("bpe")
        own = encoder(path)
        for texts in batches:
            yield pd.DataFrame([round_trip(own, x) for x in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)


def encode_column(text, path: str):
    """array<int> of ids of a text column; null counts as the empty text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("bpe")
        for texts in batches:
            yield pd.Series([list(memoryview(encoder(path).encode(x or "")).cast("I")) for x in texts], dtype=object)

    return ids(text)


def decode_column(ids, path: str):
    """Text of a column of id arrays; null stays null, unknown ids are an error."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("bpe")
        for rows in batches:
            out = []
            for x in rows:
                if x is None:
                    out.append(None)
                    continue
                d = encoder(path).decoder()
                out.append("".join(d.feed(x[k : k + STEP]) for k in range(0, len(x), STEP)) + d.end())
            yield pd.Series(out, dtype=object)

    return text(ids)


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (repeated rows give repeated results; an empty
    or null text has no ids; columns other than doc_id and text are not read). One pass, no shuffle."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", round_trip_column(docs["text"], path).alias("found"))
    return found.select("doc_id", "found.n_tokens", "found.ids_sha256", "found.decoded_sha256")
