"""Token counts that follow edits: a tree of pre-token sums per document; an edit re-encodes only what it touches and its context."""
from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level vocabularies of this family cut a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pre-tokens in a leaf of the tree when it is built
LEAF = 64
#: counts of pre-tokens that a worker remembers
REMEMBERED = 1_000_000
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
ANY = regex.compile(PATTERN)
LATIN = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
DIGITS = re.compile(r"\d+")


class _Known(dict):
    """Token counts of pre-tokens seen before, up to a bound."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class PieceCounter:
    """Cuts texts into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str = RANKS):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.encoding)

    def cutter(self, text: str):
        """The pattern for the text; for Latin-1 one with its classes spelt out, which cuts alike and runs faster."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return ANY
        return LATIN

    def count(self, pieces: list[str]) -> list[int]:
        return list(map(self.known.__getitem__, pieces))


class TokenTree:
    """Leaves hold runs of pre-tokens with their counts; inner nodes hold sums of characters and tokens below them."""

    def __init__(self, text: str, counter: PieceCounter):
        self.counter = counter
        pieces = counter.cutter(text).findall(text)
        n = counter.count(pieces)
        self.leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.counts = [n[i:i + LEAF] for i in range(0, len(n), LEAF)] or [[]]
        self.cap = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.cap), [0] * (2 * self.cap)
        self.encoded = 0
        for i, (leaf, n) in enumerate(zip(self.leaves, self.counts)):
            self.chars[self.cap + i], self.tokens[self.cap + i] = sum(map(len, leaf)), sum(n)
        for i in range(self.cap - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int) -> None:
        i = self.cap + leaf
        self.chars[i], self.tokens[i] = sum(map(len, self.leaves[leaf])), sum(self.counts[leaf])
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and where the leaf begins."""
        i, begin = 1, 0
        while i < self.cap:
            i *= 2
            if at - begin >= self.chars[i]:
                begin += self.chars[i]
                i += 1
        return min(i - self.cap, len(self.leaves) - 1), begin if i - self.cap < len(self.leaves) else self.chars[1] - self.chars[self.cap + len(self.leaves) - 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start..stop. Pieces that end two or more characters before the edit stay: the pattern looks no further
        ahead than one character past a piece. Behind the edit, pieces stay from the first old boundary that the new cut meets."""
        start, stop = max(0, min(start, self.chars[1])), max(0, min(stop, self.chars[1]))
        leaf, begin = self.find(max(0, start - 2))
        while leaf > 0 and begin > start - 2:      # never start inside what the edit may change
            leaf -= 1
            begin -= self.chars[self.cap + leaf]
        head, pos = 0, begin
        for p in self.leaves[leaf]:
            if pos + len(p) > start - 2:
                break
            pos += len(p)
            head += 1
        # old pieces from here on, leaf by leaf, until a new cut meets an old one
        shift, old, ends, end, last, meet = len(new) - (stop - start), [], [], pos, leaf - 1, None
        while meet is None:
            last += 1
            for p in self.leaves[last][head if last == leaf else 0:]:
                end += len(p)
                old.append(p)
                ends.append(end)
            whole = last == len(self.leaves) - 1
            if not whole and end < stop + 32:
                continue
            was = "".join(old)
            marks = {e + shift: k for k, e in enumerate(ends) if e >= stop}
            got, at = [], pos
            now = was[:start - pos] + new + was[stop - pos:]
            for m in self.counter.cutter(now).finditer(now):
                p = m.group()
                at += len(p)
                if not whole and at + 1 >= end + shift:
                    break                            # too close to what has not been read
                got.append(p)
                if at >= start + len(new) and at in marks:
                    meet = marks[at]
                    break
            if meet is None and whole:
                meet = len(old) - 1
        self.encoded += len(got)
        # pieces of the first leaf before, the new ones, and what remains of the leaves that were read
        kept = old[meet + 1:]
        n = self.counter.count(got)
        before, before_n = self.leaves[leaf][:head], self.counts[leaf][:head]
        old_n = self.counts[leaf][head:] + [c for k in range(leaf + 1, last + 1) for c in self.counts[k]]
        self.leaves[leaf], self.counts[leaf] = before + got + kept, before_n + n + old_n[len(old) - len(kept):]
        for k in range(leaf + 1, last + 1):
            self.leaves[k], self.counts[k] = [], []
            self._set(k)
        self._set(leaf)


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, new), ascending and apart: lines that repeat an earlier line of the text go, with their line end; elsewhere runs of
    digits become one zero."""
    out, seen, at = [], set(), 0
    for line in text.splitlines(keepends=True):
        body = line.strip()
        if body and body in seen:
            out.append((at, at + len(line), ""))
        else:
            seen.add(body)
            out += [(at + m.start(), at + m.end(), "0") for m in DIGITS.finditer(line) if m.group() != "0"]
        at += len(line)
    return out


_counters: dict[str, PieceCounter] = {}


def counts(docs: DataFrame, edits=cleaning_edits, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, n_pieces, n_edits, edited_tokens, reencoded, edited_chars of every row, in one pass.

    ``edits`` gives a text's edits; ``reencoded`` is how many pre-tokens they made anew. Null and empty texts have no tokens and no
    edits. Repeated rows stay; other columns are ignored. The vocabulary's path is a parameter and must exist on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks not in _counters:      # once a worker
            _counters[ranks] = PieceCounter(ranks)
        counter = _counters[ranks]
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                tree = TokenTree(text, counter)
                n, pieces, todo = tree.total, sum(map(len, tree.leaves)), edits(text)
                for start, stop, new in reversed(todo):      # from the end: earlier places stay as they are
                    tree.edit(start, stop, new)
                rows.append((n, pieces, len(todo), tree.total, tree.encoded, tree.chars[1]))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_tokens", "n_pieces", "n_edits", "edited_tokens", "reencoded", "edited_chars"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, n_pieces bigint, n_edits bigint, edited_tokens bigint, reencoded bigint, edited_chars bigint")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))
