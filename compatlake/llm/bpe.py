"""Byte-pair encoding and decoding with a public tokenizer's vocabulary, by dynamic programming over prefixes.

Of every prefix of a pre-token the encoding ends in exactly one token. It is the one vocabulary token which is a
suffix of the prefix and fits the last token of what comes before it: an automaton over the vocabulary lists the
suffixes, and a pair of tokens fits if no merge crosses their boundary while the two form. The last token of every
prefix is stored, and the ids come from following these back from the whole pre-token. Time grows with the length
of the pre-token alone, so that one of a million characters is no problem. Pre-tokens are remembered per task, up to
a bound; forgetting them changes no result.

The vocabulary file (a path, read by each Python worker from its own installation) names the rest: NFC, runs of
white space, lower case, the splitting pattern, byte-level symbols and the mark at a word's end. Special tokens are
found in the raw text and split it. Decoding joins the tokens by blanks, as a file without a decoder asks for.

A null text is empty and has no ids. Ids and order of rows don't matter; equal rows get equal results. Extra columns
pass through untouched; where the table has a column of the new one's name, the new one gets underscores before it.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .common import free_name, list_array, steps

#: Words and pre-tokens a task remembers; it starts anew beyond that.
REMEMBERED = 1 << 18
#: Stands between words that are cut into pre-tokens in one go; it is no letter, digit or blank.
_MARK = "\ue000"
#: Pre-tokens of more bytes go through the program alone.
TOGETHER = 48
#: Bits of the number of pair tests that are remembered.
_TESTED = 20
_NEVER = 1 << 60
#: White space as the vocabulary's own pattern language has it, for use within a character class.
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    places = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [places[b] for b in range(256)]


def _hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


class _Lookup:
    """Numbers by key for whole arrays of keys: a hash table with the next free slot as a way out."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        slots, left = _hashed(keys, self.bits), np.arange(len(keys))
        while len(left):
            free = self.keys[slots[left]] < 0
            self.keys[slots[left[free]]] = keys[left[free]]
            placed = self.keys[slots[left]] == keys[left]
            self.values[slots[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers; -1 for keys that there are not."""
        slots = _hashed(keys, self.bits)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[left]]
            out[left] = np.where(there == keys[left], self.values[slots[left]], -1)
            left = left[(there != keys[left]) & (there >= 0)]
        return out


class Vocabulary:
    """A vocabulary with merges. Units are bytes, and bytes that end a word; a token is a string of units."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        pattern = stored["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"\s", _SPACES))
        self.text = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.symbol_byte = {s: chr(b) for b, s in enumerate(byte_symbols())}
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.units = {}
        for token, number in model["vocab"].items():
            self.units[number] = self._units(token)
        self.rank, self.parts, self.formed = {}, {}, {}
        vocab = model["vocab"]
        for rank, (left, right) in enumerate(merges):
            a, b = vocab[left], vocab[right]
            whole = vocab[left + right]
            self.rank.setdefault((a, b), rank)
            if whole not in self.parts:
                self.parts[whole], self.formed[whole] = (a, b), rank
        self._suffixes()
        self._pairs()
        self.fits = functools.lru_cache(REMEMBERED)(self._fits)
        self.left_edge = functools.cache(lambda token: self._edge(token, 0))
        self.right_edge = functools.cache(lambda token: self._edge(token, 1))
        self.known_pieces = _Known(self._piece_ids)
        self.known_words = _Known(self._word_ids)

    def _units(self, token: str) -> str:
        """Bytes as characters 0-255; the last one of a word is moved up by 256."""
        ends = bool(self.suffix) and token.endswith(self.suffix)
        units = "".join(self.symbol_byte[c] for c in (token[: -len(self.suffix)] if ends else token))
        return units[:-1] + chr(ord(units[-1]) + 256) if ends else units

    def _suffixes(self) -> None:
        """The automaton of all tokens read from their ends: from (node, unit before) to a node, and the token of a node."""
        steps: dict[int, int] = {}
        tokens = [-1]
        self.lengths = np.zeros(max(self.units) + 1, dtype=np.int64)
        for number, units in self.units.items():
            self.lengths[number] = len(units)
            if len(units) > 1 and number not in self.parts:
                continue
            node = 0
            for unit in reversed(units):
                key = node << 9 | ord(unit)
                node = steps.setdefault(key, len(tokens))
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = number
        self.steps = _Lookup(np.array(list(steps)), np.array(list(steps.values())))
        self.plain_steps, self.tokens_of = steps, tokens
        self.node_token = np.array(tokens, dtype=np.int64)
        self.longest = int(self.lengths.max())

    def _pairs(self) -> None:
        """Merges by pair, and for each token the edges that it shows while it forms (see ``_edge``)."""
        pairs = np.array(list(self.rank), dtype=np.int64)
        self.crossing = _Lookup(pairs[:, 0] << 20 | pairs[:, 1], np.array(list(self.rank.values())))
        self.edges = []
        for side in (0, 1):
            first = np.zeros(len(self.lengths), dtype=np.int64)
            shown: list[tuple[int, int]] = []
            for number in self.units:
                first[number] = len(shown)
                shown += self._edge(number, side)
            self.edges.append((first, *np.array(shown, dtype=np.int64).T))
        self.tested = np.full(1 << _TESTED, -1, dtype=np.int64)
        self.passed = np.zeros(1 << _TESTED, dtype=bool)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens which stand at one edge of a token while it forms, and the rank at which each is taken up."""
        steps, taken = [], _NEVER
        while True:
            steps.append((token, taken))
            if token not in self.parts:
                return steps[::-1]
            taken = self.formed[token]
            token = self.parts[token][side]

    def _fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary at any moment while both tokens form. Of equal ranks the left one is first."""
        lefts, rights = self.right_edge(left), self.left_edge(right)
        a = b = 0
        while True:
            (one, one_taken), (two, two_taken) = lefts[a], rights[b]
            crossing = self.rank.get((one, two), _NEVER)
            if crossing < one_taken and crossing <= two_taken and crossing < _NEVER:
                return False
            if one_taken == two_taken == _NEVER:
                return True
            if one_taken <= two_taken:
                a += 1
            else:
                b += 1

    def word(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        data = piece.encode("utf-8")
        units = data.decode("latin-1")
        if self.suffix:
            units = units[:-1] + chr(ord(units[-1]) + 256)
        last: list[int] = [0] * len(units)
        size: list[int] = [0] * len(units)
        steps = self.plain_steps
        codes = [ord(unit) for unit in units]
        for end in range(len(units)):
            node, start = 0, end
            while start >= 0 and (node := steps.get(node << 9 | codes[start], -1)) >= 0:
                start -= 1
                token = self.tokens_of[node]
                if token >= 0 and (start < 0 or self.fits(last[start], token)):
                    last[end], size[end] = token, end - start
                    break
        ids, at = [], len(units) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split.findall(text.lower())

    def fit(self, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs; the results of the latest ones are kept."""
        keys = lefts << 20 | rights
        slots = _hashed(keys, _TESTED)
        out = self.passed[slots]
        fresh = np.flatnonzero(self.tested[slots] != keys)
        if len(fresh):
            new, where = np.unique(keys[fresh], return_inverse=True)
            good = self._all_fit(new >> 20, new & 0xFFFFF)
            slots = _hashed(new, _TESTED)
            self.tested[slots] = new
            kept = self.tested[slots] == new
            self.passed[slots[kept]] = good[kept]
            out[fresh] = good[where]
        return out

    def _all_fit(self, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
        """``_fits`` of many pairs, step by step."""
        (starts_two, tokens_two, taken_two), (starts_one, tokens_one, taken_one) = self.edges
        one, two = starts_one[lefts], starts_two[rights]
        good = np.ones(len(lefts), dtype=bool)
        at = np.arange(len(lefts))
        while len(at):
            left, right = taken_one[one], taken_two[two]
            crossing = self.crossing.get(tokens_one[one] << 20 | tokens_two[two])
            bad = (crossing >= 0) & (crossing < left) & (crossing <= right)
            good[at[bad]] = False
            going = ~bad & ((left < _NEVER) | (right < _NEVER))
            step = left <= right
            one, two = (one + step)[going], (two + ~step)[going]
            at = at[going]
        return good

    def together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens end to end, and how many each has."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(sizes + 1) - 1  # one mark behind each
        units = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8).astype(np.int64)
        if self.suffix:
            units[ends - 1] += 256
        starts = np.repeat(ends - sizes, sizes + 1)
        at = np.delete(np.arange(len(units)), ends)
        node, first, found = np.zeros(len(at), dtype=np.int64), at, []
        while len(at):
            node = self.steps.get(node << 9 | units[first])
            token = self.node_token[node]
            hit = (node >= 0) & (token >= 0)
            found.append((at[hit], token[hit]))
            going = (node >= 0) & (first > starts[at])
            at, first, node = at[going], first[going] - 1, node[going]
        stops, tokens = (np.concatenate(parts) for parts in zip(*found))
        column = stops - starts[stops]
        order = np.argsort(column.astype(np.uint16), kind="stable")
        stops, tokens = stops[order], tokens[order]
        bounds = np.searchsorted(column[order], np.arange(int(sizes.max()) + 1))
        last = np.zeros(len(units), dtype=np.int64)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            stop, token = stops[low:high], tokens[low:high]
            before = stop - self.lengths[token]
            whole = before < starts[stop]
            rest = np.flatnonzero(~whole)
            whole[rest[self.fit(last[before[rest]], token[rest])]] = True
            last[stop[whole]] = token[whole]
        at, alive, taken = ends - 1, np.arange(len(pieces)), []
        while len(alive):
            token = last[at]
            taken.append((alive, token))
            at = at - self.lengths[token]
            going = at >= starts[ends[alive]]
            at, alive = at[going], alive[going]
        counts = np.bincount(np.concatenate([who for who, _ in taken]), minlength=len(pieces))
        ids = np.empty(int(counts.sum()), dtype=np.int32)
        place = np.cumsum(counts)
        for turn, (who, token) in enumerate(taken):
            ids[place[who] - 1 - turn] = token
        return ids, counts

    def split_text(self, text: str) -> list[str | int]:
        """Pre-tokens, and the ids of special tokens among them."""
        if not (self.special and "<|" in text):
            return self.pieces(text)
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        out: list[str | int] = []
        for part in regex.split(f"({marks})", text):
            out += [self.special[part]] if part in self.special else self.pieces(part)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, its pre-tokens one by one."""
        out: list[int] = []
        for piece in self.split_text(text):
            out += [piece] if isinstance(piece, int) else self.word(piece)
        return out

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens: short ones together, long ones alone."""
        coded = [piece.encode("utf-8") for piece in pieces]
        long = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) > TOGETHER
        short = [piece for piece, alone in zip(coded, long.tolist()) if not alone]
        together = self.together(short) if short else None
        return _merged(long, together, [self.word(pieces[at]) for at in np.flatnonzero(long).tolist()])

    def _word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words: cut into pre-tokens in one go, parted by a mark. Those with special tokens or a mark go alone."""
        texts = [word.decode("utf-8") for word in words]
        odd = np.fromiter((_MARK in text or "<|" in text for text in texts), dtype=bool, count=len(texts))
        plain = [text for text, alone in zip(texts, odd.tolist()) if not alone]
        together = None
        if plain:
            pieces = self.pieces(f" {_MARK} ".join(plain) + f" {_MARK}")
            ids, counts = self.known_pieces.expand(pieces)
            marks = np.fromiter((piece == _MARK for piece in pieces), dtype=bool, count=len(pieces))
            ids, counts = ids[~np.repeat(marks, counts)], np.where(marks, 0, counts)
            together = ids, np.diff(np.cumsum(counts)[marks], prepend=0)
        return _merged(odd, together, [self.encode(texts[at]) for at in np.flatnonzero(odd).tolist()])

    def encode_all(self, data: bytes, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts (UTF-8, laid end to end) in a row, and how many each has.

        Nothing that the vocabulary does looks past an ASCII blank, so a word's ids are the same in every text.
        """
        words: list[bytes] = []
        ends = [0]
        for first, last in zip(offsets[:-1], offsets[1:]):
            words += data[first:last].split()
            ends.append(len(words))
        ids, counts = self.known_words.expand(words)
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[ends])

    @functools.cached_property
    def shown(self) -> pa.Array:
        """Text of every token, by id; null where there is none."""
        return pa.array([self.text.get(i) for i in range(max(self.text) + 1)], pa.string())

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks; ids that are in no vocabulary are left out."""
        shown = self.text
        return " ".join([shown[i] for i in ids if i in shown])


def _merged(alone: np.ndarray, together, single: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of some items in their order: those worked out together, and single ones where ``alone`` says."""
    ids, counts = together or (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
    if not single:
        return ids, counts
    sizes = np.empty(len(alone), dtype=np.int64)
    sizes[~alone], sizes[alone] = counts, [len(own) for own in single]
    own = np.repeat(alone, sizes)
    out = np.empty(len(own), dtype=np.int32)
    out[~own], out[own] = ids, np.fromiter(chain.from_iterable(single), dtype=np.int32)
    return out, sizes


class _Known:
    """What was met so far, as numbers, and the ids of each; ``code`` makes the ids of many new ones."""

    def __init__(self, code) -> None:
        self.code = code
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str | bytes, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def expand(self, met: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all in a row, and how many each has."""
        fresh = set(met).difference(self.number)
        if len(self.number) + len(fresh) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self._forget()
            fresh = set(met)
        if fresh:
            ids, counts = self.code(list(fresh))
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
        numbers = np.fromiter(map(self.number.__getitem__, met), dtype=np.int64, count=len(met))
        starts = self.bounds[numbers]
        counts = self.bounds[numbers + 1] - starts
        places = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        return self.ids[places], counts


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mapped(docs: DataFrame, column: str, name: str, kind: T.DataType, function) -> DataFrame:
    """The documents with a column that ``function`` makes of slices of another one: array to (first, last, array)."""
    place = docs.columns.index(column)
    (name,) = free_name(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, made in function(batch.column(place)):
                part = batch.slice(first, last - first)
                yield pa.record_batch([*part.columns, made], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """The documents and the ids of their texts."""

    def encoded(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
        words = vocabulary(path)
        for first, last, data, offsets in steps(texts):
            ids, counts = words.encode_all(data.tobytes(), offsets.tolist())
            yield first, last, list_array(ids, counts, pa.int32())

    return _mapped(docs, text, name, T.ArrayType(T.IntegerType(), False), encoded)


#: Rows whose ids are decoded at once.
STEP_ROWS = 512


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The documents and the texts of their ids, tokens joined by blanks; null ids give an empty text."""

    def decoded(lists: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
        shown = vocabulary(path).shown
        for first in range(0, len(lists), STEP_ROWS):
            part = lists.slice(first, STEP_ROWS)
            flat = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            good = (flat >= 0) & (flat < len(shown))
            good[good] = shown.is_valid().to_numpy(zero_copy_only=False)[flat[good]]
            ends = np.concatenate([[0], np.cumsum(good)])[ends]
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), shown.take(pa.array(flat[good])))
            yield first, first + len(part), pc.binary_join(tokens, " ")

    return _mapped(docs, ids, name, T.StringType(), decoded)


def default_path() -> str:
    """The file of the public 49k word vocabulary in this Python installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every whole text of documents, encoded and decoded again."""
    path = default_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, path).select("doc_id", "ids")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    found = decode(ids.withColumn("ids_sha256", F.sha2(joined.cast("binary"), 256)), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids_sha256",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
