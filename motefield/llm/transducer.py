"""Token counts by a tokenizer compiled to a deterministic transducer.

A word-level BPE reads words left to right as an automaton: the last token of every prefix follows from the last tokens of
shorter prefixes, because a row of tokens is an encoding exactly if each two neighbours are. A state holds that knowledge for
the part of the word that can still lie within a token; a transition on a byte is annotated with the change of the token
count, one on the word's end with the change for the marked last token. States and transitions are compiled when first met.

Texts run through the tables in fixed chunks, all at once. From the first word end in a chunk its state is known, whatever came
before; only the head depends on the state it is entered with. So the map of a chunk is constant but for its head, maps are
composed from left to right by a scan, and heads run again with the states that it gives them.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.batches import id_and_text, text_slices
from motefield.llm.vocabulary import byte_symbols, tokenizer_path

TEXT_LIMIT = 2048
CHUNK = 192
# Symbols after the 256 bytes: the end of a word, and nothing.
END, NOTHING = 256, 257
# States kept before the tables are compiled anew.
MOST_STATES = 120_000
WORD_END = "</w>"
OTHER, LETTER, NUMBER, SPACE = range(4)
# What follows an apostrophe at the start of a word to be one with it (fixed values).
CONTRACTED = ("s", "t", "m", "d", "re", "ve", "ll")


# White space (fixed values), beside 0x09-0x0D and 0x2000-0x200A.
SPACES = (0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    out[[*SPACES, *range(0x09, 0x0E), *range(0x2000, 0x200B)]] = SPACE
    return out


class Machine:
    """A word-level BPE with end-of-word tokens, as lazily compiled tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.shown = {b: c for c, b in byte_symbols().items()}
        words = [t for t in model["vocab"] if t not in set(self.special)]
        self.inner = {t for t in words if not t.endswith(WORD_END)}
        self.final = {t.removesuffix(WORD_END) for t in words if t.endswith(WORD_END) and t != WORD_END}
        self.beginnings = {t[:n] for t in self.inner | self.final for n in range(len(t) + 1)}
        self.pairs: dict[tuple[str | None, str, bool], bool] = {}
        self.clear()

    def clear(self) -> None:
        # A state: the part of the word that matters; for each place in it, the last token before it (None at the word's start, "" where
        # no token can begin any more) and the count there less the count at the end.
        self.states: list[tuple[str, tuple, tuple]] = []
        self.numbers: dict[tuple, int] = {}
        self.columns = np.full(258, -1, dtype=np.int32)
        self.width, self.used = 64, 0
        self.next = np.full((4096, self.width), -1, dtype=np.int32)
        self.change = np.zeros((4096, self.width), dtype=np.int8)
        self.nothing = self.column(NOTHING)
        self.number(("", (None,), (0,)))

    def column(self, symbol: int) -> int:
        if self.columns[symbol] < 0:
            if self.used == self.width:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                self.change = np.concatenate([self.change, np.zeros_like(self.change)], axis=1)
                self.width *= 2
            self.columns[symbol] = self.used
            self.used += 1
        return int(self.columns[symbol])

    def number(self, state: tuple) -> int:
        k = self.numbers.setdefault(state, len(self.states))
        if k == len(self.states):
            self.states.append(state)
            if k == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
            self.next[k, self.nothing] = k
        return k

    def merged(self, symbols: list[str]) -> list[str]:
        """The vocabulary's own merging, for pairs of tokens."""
        while len(symbols) > 1:
            rank, at = min((self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.rank):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def follows(self, before: str | None, token: str, is_end: bool) -> bool:
        """Whether a token may stand after another, or at the start of a word."""
        key = before, token, is_end
        if key not in self.pairs:
            symbols = [*(before or ""), *token]
            wanted = [before, token] if before else [token]
            if is_end:
                symbols[-1] += WORD_END
                wanted[-1] += WORD_END
            self.pairs[key] = self.merged(symbols) == wanted
        return self.pairs[key]

    def compile(self, state: int, symbol: int) -> None:
        part, last, count = self.states[state]
        is_end = symbol == END
        text = part if is_end else part + self.shown[symbol]
        tokens = self.final if is_end else self.inner
        for s in range(len(text)):
            token = text[s:]
            if token in tokens and last[s] != "" and self.follows(last[s], token, is_end):
                break
        else:
            raise ValueError(f"the vocabulary has no token for {text!r}")
        change = count[s] + 1
        column = self.column(symbol)
        if is_end:
            target = 0
        else:
            last, count = (*last, token), (*(c - change for c in count), 0)
            first = next(k for k in range(len(text) + 1) if text[k:] in self.beginnings)
            live = [text[k:] in self.beginnings for k in range(first, len(text) + 1)]
            target = self.number((text[first:], tuple(t if on else "" for t, on in zip(last[first:], live)), tuple(c if on else 0 for c, on in zip(count[first:], live))))
        self.next[state, column] = target
        self.change[state, column] = change

    def advance(self, lanes: np.ndarray, state: np.ndarray, changes: np.ndarray) -> np.ndarray:
        """Run all lanes (one per column of symbols) from their states; adds the changes of the count, returns the last states."""
        for symbol in np.flatnonzero(np.bincount(lanes.ravel(), minlength=len(self.columns))).tolist():
            self.column(symbol)
        columns = self.columns[lanes]
        for t in range(len(lanes)):
            at = state * np.int32(self.width) + columns[t]
            target = self.next.ravel().take(at)
            if target.min(initial=0) < 0:
                missing = np.flatnonzero(target < 0)
                for s, x in set(zip(state[missing].tolist(), lanes[t, missing].tolist())):
                    self.compile(s, x)
                target = self.next.ravel().take(at)
            changes[t] += self.change.ravel().take(at)
            state = target
        return state

    def changes(self, stream: np.ndarray) -> np.ndarray:
        """Change of the token count at every symbol of a stream of whole words, each closed by END."""
        if len(self.states) > MOST_STATES:
            self.clear()
        n = -(-len(stream) // CHUNK)
        lanes = np.full(n * CHUNK, NOTHING, dtype=np.int16)
        lanes[: len(stream)] = stream
        lanes = lanes.reshape(n, CHUNK)
        ends = lanes == END
        has_end = ends.any(axis=1)
        head = np.where(has_end, ends.argmax(axis=1) + 1, CHUNK)
        in_head = np.arange(CHUNK)[None, :] < head[:, None]
        out = np.zeros((CHUNK, n), dtype=np.int8)
        # The constant part of each map: what follows the first word end.
        left = self.advance(np.where(in_head, NOTHING, lanes).T.copy(), np.zeros(n, dtype=np.int32), out)
        # The scan: a chunk is entered with the last state of the one before; a chunk without a word end passes its state on.
        entered = np.where(np.append(True, has_end[:-1]), np.append(0, left[:-1]), -1).astype(np.int32)
        heads = np.where(in_head, lanes, NOTHING)
        ready = np.flatnonzero(entered >= 0)
        while len(ready):
            longest = int(head[ready].max())
            some = np.zeros((longest, len(ready)), dtype=np.int8)
            last = self.advance(heads[ready, :longest].T.copy(), entered[ready], some)
            out[:longest, ready] += some
            passing = ~has_end[ready] & (ready + 1 < n)
            following = ready[passing] + 1
            entered[following] = last[passing]
            ready = following
        return out.T.reshape(-1)[: len(stream)]


@lru_cache(maxsize=1)
def machine(path: str) -> Machine:
    """One compiled machine per Python worker."""
    return Machine(path)


def normalised(text: str, split) -> tuple[str, int]:
    """A text in the vocabulary's normal form, and the number of special strings cut out of it; each of them ends a word."""
    parts = split.split(text) if split else [text]
    plain = [unicodedata.normalize("NFC", p) if not p.isascii() else p for p in parts]
    # Lower-casing goes letter by letter, so a sigma at a word's end is as any other.
    return " ".join(plain).replace("Σ", "σ").lower(), len(parts) - 1


def word_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, each closed by END, and the n+1 offsets of the texts in it.

    Words are runs of letters, single numbers, and runs of anything else but white space; an apostrophe that begins a word
    takes certain letters after it with it.
    """
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    kind = classes()[points]
    before = np.append(np.uint8(SPACE), kind[:-1])
    start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
    marks = np.flatnonzero((points == 0x27) & (before != OTHER))
    padded = np.append(points, [10, 10, 10]).astype(np.uint32)
    taken = np.zeros(len(marks), dtype=bool)
    for letters in CONTRACTED:
        hit = ~taken
        for k, letter in enumerate(letters):
            hit &= padded[marks + 1 + k] == ord(letter)
        taken |= hit
        at = marks[hit]
        for k in range(len(letters)):
            start[at + 1 + k] = False
        after = at + 1 + len(letters)
        start[after] = kind[after] != SPACE
    kept = kind != SPACE
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = kept & np.append(start[1:] | ~kept[1:], True)
    data = np.frombuffer(joined.encode(), dtype=np.uint8)
    held = data[np.repeat(kept, sizes)].astype(np.int16)
    kept_bytes = np.cumsum(sizes * kept)
    stream = np.insert(held, kept_bytes[ends], END)
    placed = np.concatenate([[0], kept_bytes + np.cumsum(ends)])
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return stream, placed[bounds]


def count_tokens(texts: list[str], path: str) -> list[int]:
    compiled = machine(path)
    plain, special = zip(*(normalised(t, compiled.split) for t in texts)) if texts else ((), ())
    stream, bounds = word_stream(list(plain))
    totals = np.append(0, np.cumsum(compiled.changes(stream), dtype=np.int64))
    return (totals[bounds[1:]] - totals[bounds[:-1]] + np.array(special, dtype=np.int64)).tolist()


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = TEXT_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    A null text counts as empty and has no tokens; ids may be null or repeat; an empty table gives an empty one; other columns
    are not read.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    docs = id_and_text(docs, id_col, text_col)

    def count(batches):
        for rows in text_slices(batches):
            texts = rows.column("text").to_pylist()
            tokens = count_tokens(texts, path)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
